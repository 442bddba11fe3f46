"""Chat formatting in DataFrame functions only.

A template says declaratively how a turn is marked, which roles are trained on and which role may
follow which: the last is a finite-state machine whose state is the role before, so each turn is
checked against its predecessor alone. Each turn gives three segments (head, text, tail) with a loss
flag; a conversation's segments in order are its training sample.

Control strings can't occur in a text: a backslash is doubled and ``<|`` becomes ``<\\|``, which
``unescape`` takes back exactly.

Defined cases: null text and null role count as empty; a null ``conv_id`` is a conversation of its
own; turns are ordered by (turn, role, text), null turns first, so ties and repeated rows give one
result; an empty table gives no rows; other columns are ignored. Conversations whose turns break the
machine's order are still formatted, with ``valid`` false and their number of breaks. Very long texts are formatted whole.

The rows of one conversation meet in one task, since its sample is one string, of which the digests
are taken; nothing else is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = ""


@dataclass(frozen=True)
class Template:
    """``follows``: the machine, from a role (or START) to the roles that may come next."""

    turn_start: str = "<|im_start|>"
    after_role: str = "\n"
    turn_end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    last_roles: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column) -> Column:
    """A text without any control string."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """What ``escape`` was given."""
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    """Like ``escape``; new lines too, as they end the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """What ``escape_role`` was given; between doubled backslashes, a single one begins an escape."""
    part = lambda x: F.replace(F.replace(x, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(role, r"\\\\", -1), part), "\\")


def segments(conversations: DataFrame, template: Template = CHATML, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: ``segments`` (text, loss) in order, ``n_breaks`` and ``valid``."""
    null_safe = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), null_safe(role_col).alias("role"), null_safe(text_col).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    allowed = [F.lit(f"{a}\x00{b}") for a, after in template.follows.items() for b in after]
    step = lambda t, i: F.concat(F.coalesce(F.get("turns", i - 1)["role"], F.lit(START)), F.lit("\x00"), t["role"])
    three = lambda t: F.array(
        F.struct(F.concat(F.lit(template.turn_start), escape_role(t["role"]), F.lit(template.after_role)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
        F.struct(F.lit(template.turn_end).alias("text"), F.lit(False).alias("loss")),
    )
    return turns.select(
        "conv_id",
        F.flatten(F.transform("turns", three)).alias("segments"),
        F.size(F.filter("turns", lambda t, i: ~step(t, i).isin(*allowed))).cast("long").alias("n_breaks"),
        F.element_at("turns", -1)["role"].isin(*template.last_roles).alias("ends_well"),
    ).select("conv_id", "segments", "n_breaks", ((F.col("n_breaks") == 0) & F.col("ends_well")).alias("valid"))


def formatted(samples: DataFrame) -> DataFrame:
    """``segments`` with ``formatted``, the sample as one string."""
    return samples.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(samples: DataFrame, template: Template = CHATML) -> DataFrame:
    """Turns (role, text) and the text under the loss mask, both parsed out of ``formatted``; of the segments only their loss flags are used."""
    parts = F.slice(F.split("formatted", r"\Q" + template.turn_start + r"\E", -1), 2, 2_000_000_000)
    role_end = lambda p: F.locate(template.after_role, p)
    tail, gap = len(template.turn_end), len(template.after_role)
    turn = lambda p: F.struct(
        unescape_role(F.substring(p, F.lit(1), role_end(p) - 1)).alias("role"),
        unescape(F.substring(p, role_end(p) + gap, F.char_length(p) - role_end(p) - gap + 1 - tail)).alias("text"),
    )
    flags = F.transform(F.filter("segments", lambda s, i: i % 3 == 1), lambda s: s["loss"])  # a turn's segments are its head, text and tail
    under = F.filter(F.arrays_zip(F.col("turns.text").alias("text"), flags.alias("loss")), lambda x: x["loss"])
    return samples.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", F.array_join(F.transform(under, lambda x: x["text"]), ""))


def digests(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """Format, read back and describe what was read."""
    back = read_back(formatted(segments(conversations, template)), template)
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "n_breaks",
        "valid",
    )
