"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for a document; the ledger keeps its measurements and one failure bit
a rule. Policies are versioned sets of rules, applied to the stored bits, so that a new policy or an
ablation never reads the texts again.

Defined cases: a null text counts as empty (no words: ``too_few_words`` fails); a null ``doc_id``
stays a row with a null id; repeated rows are measured each for itself; an empty table gives an empty
ledger; columns other than the id and the text are ignored, whatever their names; very long texts are measured whole, in
one row's memory.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, computed_once, words


@dataclass(frozen=True)
class Rule:
    """``bit``: its place in the mask, never given to another rule. ``fails``: over the measurements."""

    bit: int
    name: str
    fails: Callable[[], Column]


c = F.col
RULES = (
    Rule(0, "too_few_words", lambda: c("n_words") < 50),
    Rule(1, "repeated_windows", lambda: 100 * c("n_repeat_words") > 50 * c("n_words")),
    Rule(2, "symbols", lambda: 100 * c("n_symbols") > 30 * c("n_words")),
    Rule(3, "duplicate_lines", lambda: 100 * c("n_dup_lines") > 50 * c("n_lines")),
    Rule(4, "shouting", lambda: 100 * c("n_upper") > 50 * c("word_chars")),
    Rule(5, "short_words", lambda: c("word_chars") < 2 * c("n_words")),
    Rule(6, "long_words", lambda: c("word_chars") > 25 * c("n_words")),
    Rule(7, "exclamations", lambda: 100 * c("n_exclaim") > 50 * c("n_words")),
)
BIT = {r.name: 1 << r.bit for r in RULES}
#: Versioned policies: the rules a document must not fail. A version is never changed once used.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "2024-1": ("too_few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "2024-2": tuple(r.name for r in RULES),
}
CURRENT = "2024-2"


def mask_of(version: str) -> int:
    """The bits of a policy."""
    return sum(BIT[n] for n in POLICIES[version])


def _less(text: Column, pattern: str) -> Column:
    """Code points of ``text`` that match a pattern of one character."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))).cast("long")


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows (hashes, by position) that occur twice or more.

    Sorted by hash, equal windows are neighbours; their positions, sorted again, cover three words
    each, less what the next one covers as well."""
    by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
    places = lambda s: F.array_sort(F.transform(again(s), lambda x: x["i"]))
    covered = lambda p: F.aggregate(F.transform(p, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - v, F.lit(3)))), F.lit(0), lambda a, v: a + v)
    # a one-element transform binds a value, so that it is computed once
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return bind(by_hash, lambda s: bind(places(s), covered))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``doc_id`` and the measurements that the rules are made of; with ``carry`` the whole row as ``row``."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *([F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row")] if carry else []))
    d = d.withColumn("w", words(c("text"))).withColumn("l", F.filter(F.split(c("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    d = d.withColumn("g", F.transform(F.slice("h", 1, F.greatest(F.size("h") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2))))
    return computed_once(
        d,
        "doc_id",
        *(["row"] if carry else []),
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        _less(c("text"), r"[#*$%&|<>]").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("g")) < F.size("g"), _repeat_words(c("g"))).otherwise(0).cast("long").alias("n_repeat_words"),
        _less(c("text"), r"\p{Lu}").alias("n_upper"),
        _less(c("text"), "!").alias("n_exclaim"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Measurements and ``failures``, a bit for each rule that the document fails."""
    bits = [F.when(r.fails(), F.lit(1 << r.bit)).otherwise(0) for r in RULES]
    return measure(docs, id_col, text_col, carry).withColumn("failures", sum(bits[1:], bits[0]).cast("long"))


def apply_policy(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """A ledger with ``base_failed`` and ``kept`` under a policy; a base failure is never kept."""
    base = c("failures").bitwiseAND(F.lit(mask_of("base"))) != 0
    return book.withColumn("base_failed", base).withColumn("kept", ~base & (c("failures").bitwiseAND(F.lit(mask_of(version))) == 0))


def clean(docs: DataFrame, version: str = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with all their columns."""
    return apply_policy(ledger(docs, id_col, text_col, carry=True), version).where("kept").select("row.*")


def ablation(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: how many documents fail it, fail it alone, and are kept without it.

    The ledger is first counted by its bits (at most two to the number of rules), then those few rows
    are set against the rules."""
    mask = mask_of(version)
    by_bits = book.groupBy(c("failures").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n in POLICIES[version]])
    rows = by_bits.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = c("bits").bitwiseAND(c("bit")) != 0
    rest = c("bits").bitwiseAND(F.bitwise_not(c("bit")))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, c("n"))), F.lit(0)).cast("long")
    return rows.groupBy("rule").agg(count(hit).alias("n_failed"), count(hit & (rest == 0)).alias("n_failed_alone"), count(rest == 0).alias("n_kept_without"), count(c("bits") == 0).alias("n_kept"))
