"""Secrets: fixed kinds by pattern, sorted into copied examples and live-looking ones by who else has the same value.

Base, each kind leftmost and without overlap: ``assign`` (a password, secret, token or API key and its value of 12 characters or more),
``access`` (AKIA and so on, 18 characters or more), ``hex`` (16 digits or more). A span is the whole match.

Ownership, over the whole corpus:

1. Candidates are the values of base spans (of ``assign`` what is assigned) and, outside of them, key-like runs of 16 characters or more
   with ``LEAST_DIGITS`` digits and ``LEAST_LETTERS`` letters. Only digests of values leave a task.
2. Distinct (digest, owner, repository) are made first, then repositories are counted by (digest, owner), then owners and
   repositories by digest: three partial aggregates, so a value that a third of all rows share is summed before it is shuffled.
3. A value looks live if it has enough different characters, digits and letters and no word of ``PLACEHOLDERS``. One that more than
   ``MOST_OWNERS`` owners have is a copied example, as live as it looks; the others are owner-specific, and so live.
4. Key-like runs with a live value are spans of the added kind ``live``. Base spans stay, whatever their verdict.

Owner and repository are columns. Where there is no repository, as in ``documents``, each document counts as one.

Defined cases: null texts are empty; a null owner is an owner of its own, the empty string; null ids stay (as repositories they are the
empty string); repeated rows give the same spans and are one repository; an empty table gives no rows; other columns are ignored; very
long texts are searched whole in time linear in their length, but for runs of spaces behind many keywords. Positions are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import written

#: Kinds in the order of ties.
KINDS = ("assign", "access", "hex")
LIVE = "live"
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: One of them is in every text that ``ASSIGN`` matches, in lower case.
NAMES = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
LEAST_ASSIGNED = 12
LEAST_DIGITS = LEAST_LETTERS = 2
LEAST_DISTINCT = 8
MOST_OWNERS = 3
#: Parts of values that nobody uses.
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "placeholder", "your", "test", "xxxx", "1234", "abcd", "0000")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
SCANNED = "batch long, i int, doc_id long, owner string, repo string, base array<struct<start:int,place:int,kind:string,end:int>>, found array<struct<start:int,end:int,hash:binary,looks:boolean,base:boolean>>"


def key_like(value: str) -> bool:
    return len(_DIGIT.findall(value)) >= LEAST_DIGITS and len(_LETTER.findall(value)) >= LEAST_LETTERS


def looks_live(value: str) -> bool:
    low = value.lower()
    return key_like(value) and len(set(value)) >= LEAST_DISTINCT and not any(p in low for p in PLACEHOLDERS)


def searched(text: str) -> tuple[list[tuple], list[tuple]]:
    """Base spans (start, place, kind, end) in order, and candidates (start, end, value, base)."""
    base, values = [], []
    low = text.lower()
    for m in ASSIGN.finditer(text) if any(name in low for name in NAMES) else ():
        if m.end() - m.start(1) >= LEAST_ASSIGNED:
            base.append((m.start(), 0, "assign", m.end()))
            values.append((m.start(1), m.end(), m[1], True))
    for place, pattern in ((1, ACCESS), (2, HEX)):
        for m in pattern.finditer(text):
            base.append((m.start(), place, KINDS[place], m.end()))
            values.append((m.start(), m.end(), m[0], True))
    base.sort()
    at, reach = 0, -1
    for m in RUN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][3])
            at += 1
        if reach <= m.start() and key_like(m[0]):
            values.append((m.start(), m.end(), m[0], False))
    return base, values


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """A row for each row, with its base spans and the digests of its candidates. ``batch, i`` name a row; they are drawn, so this is to be written before use."""

    def run(batches):
        import pyarrow as pa

        digest = lambda v: hashlib.sha256(v.encode("utf-8", "surrogatepass")).digest()[:16]
        kinds = (pa.list_(pa.struct([("start", pa.int32()), ("place", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])),
            pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("hash", pa.binary()), ("looks", pa.bool_()), ("base", pa.bool_())])))
        for batch in batches:
            drawn = int.from_bytes(os.urandom(8), "little") >> 1
            bases, founds = [], []
            for text in batch.column("text"):
                base, values = searched(text.as_py())
                bases.append([dict(zip(("start", "place", "kind", "end"), b, strict=True)) for b in base])
                founds.append([{"start": a, "end": b, "hash": digest(v), "looks": looks_live(v), "base": known} for a, b, v, known in values])
            n = batch.num_rows
            head = [pa.array([drawn] * n, pa.int64()), pa.array(range(n), pa.int32()), *(batch.column(c) for c in ("doc_id", "owner", "repo"))]
            yield pa.RecordBatch.from_arrays([*head, pa.array(bases, kinds[0]), pa.array(founds, kinds[1])], ["batch", "i", "doc_id", "owner", "repo", "base", "found"])

    string = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), string(owner_col).alias("owner"), string(repo_col or id_col).alias("repo"), string(text_col).alias("text"))
    return given.mapInArrow(run, SCANNED)


def candidates(scan: DataFrame) -> DataFrame:
    """A row for each candidate of a scan."""
    return scan.select("batch", "i", "owner", "repo", F.explode("found").alias("x")).select("batch", "i", "owner", "repo", "x.*")


def ownership(scan: DataFrame) -> DataFrame:
    """For each candidate digest ``places, repos, owners`` and ``verdict``: live, copied or dull."""
    whose = candidates(scan).groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"), F.max("looks").alias("looks"))
    by_owner = whose.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"), F.max("looks").alias("looks"))
    by_value = by_owner.groupBy("hash").agg(F.sum("n").alias("places"), F.sum("r").alias("repos"), F.count("*").alias("owners"), F.max("looks").alias("looks"))
    verdict = F.when(~F.col("looks"), "dull").when(F.col("owners") > MOST_OWNERS, "copied").otherwise(LIVE)
    return by_value.select("hash", "places", "repos", "owners", verdict.alias("verdict"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """For each row: ``doc_id``, ``base`` and ``added`` spans; ``live`` and ``copied``: how many of its candidates have such values
    (base spans whose values look live and key-like runs); ``live_repos, live_owners``: the most repositories and owners of a live one."""
    scan = written(scanned(docs, id_col, text_col, owner_col, repo_col), "secrets")
    live = ownership(scan).where(F.col("verdict") == LIVE).select("hash", "repos", "owners")
    # copied values, which may be in a third of all rows, are not in this join
    at = candidates(scan).where("looks").select("batch", "i", "hash", "start", "end", "base").join(live, "hash")
    span = F.struct("start", F.lit(len(KINDS)).alias("place"), F.lit(LIVE).alias("kind"), "end")
    mine = at.groupBy("batch", "i").agg(F.collect_list(F.when(~F.col("base"), span)).alias("added"), F.count("*").alias("live"),
        F.max("repos").alias("live_repos"), F.max("owners").alias("live_owners"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    looks = F.size(F.filter("found", lambda x: x["looks"])).cast("long")
    none = F.from_json(F.lit("[]"), "array<struct<start:int,place:int,kind:string,end:int>>")
    joined = scan.select("batch", "i", "doc_id", "base", looks.alias("looks")).join(mine, ["batch", "i"], "left")
    out = joined.select("doc_id", "base", F.coalesce("added", none).alias("added"), zero("live"), "looks", zero("live_repos"), zero("live_owners"))
    return out.select("doc_id", "base", "added", "live", (F.col("looks") - F.col("live")).alias("copied"), "live_repos", "live_owners")


def shown(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts of base spans, the digest of them and all spans as text, and what ownership says."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = shown(F.array_sort(F.concat("base", "added"))).alias("spans")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(shown(F.col("base")), 256).alias("base_sha256"), spans, F.col("live").alias("n_live"),
        F.col("copied").alias("n_copied"), "live_repos", "live_owners")
