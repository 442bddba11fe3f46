"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates, exact links.

A document's set holds its distinct word shingles. Documents with the same set are one class from the start
(a group by the set's digest). Each class's one-permutation sketch splits its shingles over ``BINS`` bins
by hash and keeps each bin's least; empty bins take over the value of a bin that a random walk of their own
reaches (optimal densification). Bands of bins are hashed to buckets: two sets that are 80 % alike miss
each other in all of ``BANDS`` bands about once in a million pairs.

A bucket's candidates are stars: pairs of one centre and each other member, not all pairs. Pairs are
confirmed on full sets, and confirmed ones joined into components. There are two rounds of stars: the
first around the least id, the second around the member with the most confirmed links, in buckets whose
members still belong to several components. A centre has met every member and leaves its bucket. Members that are
still apart could be linked past both centres. So in each bucket that is still open, the members outside its
largest component are compared with all others of another component, in blocks of centres and members
that are bounded by their shingles, inside tasks: those that share one of their rarest shingles are compared on full sets. Only
confirmed links leave a task, and a pair is looked at in the first bucket that it shares. No cap is needed, and no link is lost.

Intermediate tables are Parquet in the shared folder. Hot buckets: their least member and their number are
partial aggregates, and members meet what belongs to their bucket in a sort-merge join of two tables, whose large partitions
Spark splits (it splits no others: see ``by_bucket``). Components are found once; later links are looked at between
components only.

Defined cases: null and empty texts have an empty set, are linked with nothing and kept; rows with the same id are
one document (its largest set counts); rows with a null id take no part in links and are kept with a null
component; an empty table gives no rows; other columns are ignored; very long texts count with all their shingles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import text_of, written
from quillon.llm.shingles import STEP, mix, shingle_sets
from quillon.llm.tokencount import column_chunks

SHINGLE = 5
SIMILARITY = 80  # per cent
BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: Shingles of the centres and of the members that are compared at once.
BLOCK, SLICE = 1 << 18, 1 << 20
MOST_ROUNDS = 64


def sketches(values: np.ndarray, many: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation sketches with optimal densification, a row for each non-empty set.

    ``values``: the sets' hashes one after another; ``many``: the size of each, above 0."""
    n = len(many)
    owner = np.repeat(np.arange(n), many)
    h = mix(values ^ STEP)
    cell = owner * bins + (h >> np.uint64(40)).astype(np.int64) % bins
    order = np.lexsort((h, cell))
    first = np.r_[True, np.diff(cell[order]) > 0]
    out = np.zeros(n * bins, np.uint64)
    full = np.zeros(n * bins, bool)
    out[cell[order][first]], full[cell[order][first]] = h[order][first], True
    todo = np.flatnonzero(~full)
    row, bin_ = todo // bins, (todo % bins).astype(np.uint64)
    k = 0
    source = np.zeros(len(todo), np.int64)
    live = np.arange(len(todo))
    while len(live):
        k += 1
        with np.errstate(over="ignore"):
            probe = (mix(bin_[live] * STEP + np.uint64(k)) >> np.uint64(20)).astype(np.int64) % bins
        at = row[live] * bins + probe
        hit = full[at]
        source[live[hit]] = at[hit]
        live = live[~hit]
    out[todo] = out[source]
    return out.reshape(n, bins)


def band_hashes(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A hash of each band's bins; the band's number is part of it."""
    n, bins = sketch.shape
    parts = sketch.reshape(n, bands, bins // bands)
    out = np.zeros((n, bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * STEP
    for r in range(parts.shape[2]):
        with np.errstate(over="ignore"):
            out = mix(out * np.uint64(3) + parts[:, :, r])
    return out


def _map_texts(docs: DataFrame, schema: str, make) -> DataFrame:
    """``make(ids, texts)`` gives the columns of ``schema`` for a chunk of rows."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for a, b in column_chunks(texts, 1 << 19):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in make(ids.slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist())], names)

    return docs.mapInArrow(run, schema)


def signatures(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, d1, d2`` (digest of the set) and ``bands`` (empty for an empty set) of each row."""

    def make(ids, texts):
        import pyarrow as pa

        values, many = shingle_sets(texts, shingle)
        some = many > 0
        owner = np.repeat(np.arange(len(many)), many)
        digest = []
        for seed in (1, 2):
            d = np.zeros(len(many), np.uint64)
            with np.errstate(over="ignore"):
                np.add.at(d, owner, mix(values + np.uint64(seed) * STEP))
            digest.append(d.view(np.int64))
        bands = band_hashes(sketches(values, many[some])) if some.any() else np.zeros((0, BANDS), np.uint64)
        offsets = np.r_[0, np.cumsum(np.where(some, BANDS, 0))].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel().view(np.int64)))
        return pa.array(ids, pa.int64()), pa.array(many.astype(np.int64)), *map(pa.array, digest), lists

    return _map_texts(text_of(docs, id_col, text_col), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>", make)


def shingle_table(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, shingles`` of rows of (doc_id, text)."""

    def make(ids, texts):
        import pyarrow as pa

        values, many = shingle_sets(texts, shingle)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), pa.array(values.view(np.int64)))
        return pa.array(ids, pa.int64()), lists

    return _map_texts(docs, "doc_id long, shingles array<long>", make)


def alike(common: Column, a: Column, b: Column, percent: int = SIMILARITY) -> Column:
    """Whether sets of sizes ``a`` and ``b`` with ``common`` shared members are similar enough."""
    return 100 * common >= percent * (a + b - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    return both.where(alike(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"), percent)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (least reachable id) of every id in links (a, b): large and small stars by turns."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = written(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """``id, component`` of known components and further links between their ids or new ones."""
    ends = links.join(known.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
    ends = ends.join(known.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    ends = written(ends.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "ends")
    new = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    fresh = ends.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(known, "id", "left_anti")
    every = known.unionByName(fresh.select("id", F.col("id").alias("component")))
    new = new.select(F.col("id").alias("component"), F.col("component").alias("least"))
    return written(every.join(new, "component", "left").select("id", F.coalesce("least", "component").alias("component")), "components")


def by_bucket(members: DataFrame, facts: DataFrame) -> DataFrame:
    """Members of buckets with a bucket's ``facts`` (a row for each bucket), in which a bucket may hold a third of all members.

    Spark splits a large partition only where both sides of a sort-merge join are shuffled for it; so the facts are a table."""
    return members.join(written(facts, "buckets").hint("merge"), "bucket")


def _open(members: DataFrame, known: DataFrame, links: DataFrame) -> DataFrame:
    """Members (id, n, bucket) of buckets with several components, with ``component`` and ``degree``."""
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    tagged = members.join(known, "id", "left").join(degree, "id", "left")
    tagged = written(tagged.select("bucket", "id", "n", F.coalesce("component", "id").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree")), "tagged")
    several = tagged.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    return written(by_bucket(tagged, several), "open")


def _star(met: DataFrame, percent: int) -> DataFrame:
    """Pairs of members with their bucket's centre (``centre, cn, cc``: its id, set size and component)."""
    close = (100 * F.least("n", "cn") >= percent * F.greatest("n", "cn")) & (F.col("component") != F.col("cc"))
    return met.where(close).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def _blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of other components that no centre has met, compared in blocks."""
    sizes = members.groupBy("bucket", "component").agg(F.sum("n").alias("k"))
    whole = sizes.groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("top"), F.sum("k").alias("k"))
    whole = whole.select("bucket", F.col("top.component").alias("main"), F.ceil(F.col("k") / SLICE).alias("slices"), F.ceil((F.col("k") - F.col("top.k")) / BLOCK).alias("blocks")).where("blocks > 0")
    rows = by_bucket(members, whole)
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    as_member = rows.select("bucket", "id", "component", F.lit(False).alias("head"), deal(F.col("slices"), 1).alias("slice"), each(F.col("blocks")).alias("block"))
    as_centre = rows.where("component <> main").select("bucket", "id", "component", F.lit(True).alias("head"), deal(F.col("blocks"), 2).alias("block"), each(F.col("slices")).alias("slice"))
    dealt = as_member.unionByName(as_centre).join(sets.withColumnRenamed("doc_id", "id"), "id")
    dealt = dealt.repartition("bucket", "block", "slice").sortWithinPartitions("bucket", "block", "slice")

    def run(batches):
        import pyarrow as pa

        key, kept = None, []

        def links():
            found = _compare(pa.Table.from_batches(kept), percent) if kept else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "block", "slice")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if key is not None and tuple(keys[a]) != key:
                    yield links()
                    kept = []
                key = tuple(keys[a])
                kept.append(batch.slice(a, b - a))
        yield links()

    return dealt.select("bucket", "block", "slice", "id", "component", "head", "bands", "shingles").mapInArrow(run, "a long, b long").distinct()


def _compare(group, percent: int) -> tuple[list[int], list[int]]:
    """Pairs of centres and members of a block whose full sets are similar enough.

    Similar sets share one of their rarest shingles (prefix filter): the first that they share is one of the first
    ``n - percent * n / 100 + 1`` of either, and of the first ``n - 2 * percent * n / (100 + percent) + 1`` of the smaller one.
    How rare a shingle is, is counted in the block; any order is right."""
    out: tuple[list[int], list[int]] = ([], [])
    head = group.column("head").to_numpy()
    if head.all() or not head.any():
        return out
    ids, component = group.column("id").to_numpy(), group.column("component").to_numpy()
    shingles = group.column("shingles").combine_chunks()
    offset = shingles.offsets.to_numpy().astype(np.int64)
    values, offset = shingles.values.to_numpy()[offset[0] : offset[-1]], offset - offset[0]
    bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    bucket = group.column("bucket")[0].as_py()
    size = np.diff(offset)
    owner = np.repeat(np.arange(len(ids)), size)
    known, place, many = np.unique(values, return_inverse=True, return_counts=True)
    rank = np.empty(len(known), np.int64)
    rank[np.argsort(many, kind="stable")] = np.arange(len(known))
    ranks = np.sort(owner * len(known) + rank[place]) - owner * len(known)  # each set's, the rarest first
    at = np.arange(len(ranks)) - offset[owner]
    long, short = (at < (size + (-percent * k * size) // (100 + percent * (k - 1)) + 1)[owner] for k in (1, 2))
    of_head = np.flatnonzero(long & head[owner])
    posted = [x[np.argsort(ranks[x], kind="stable")] for x in (np.flatnonzero(x & ~head[owner]) for x in (long, short))]
    # a centre's first shingles meet the long beginnings of members, its further ones the short beginnings
    begin, end = (
        np.where(short[of_head], np.searchsorted(ranks[posted[0]], ranks[of_head], side=x), len(posted[0]) + np.searchsorted(ranks[posted[1]], ranks[of_head], side=x))
        for x in ("left", "right")
    )
    of_rest = np.concatenate(posted)
    upto = np.r_[0, np.cumsum(end - begin)]
    starts = np.flatnonzero(np.r_[True, np.diff(owner[of_head]) != 0])  # where each centre's shingles begin
    mark = np.zeros(len(known), bool)
    for i, j in zip(starts, np.r_[starts[1:], len(of_head)], strict=True):
        if upto[i] == upto[j]:
            continue
        c = owner[of_head[i]]
        rest = np.unique(owner[of_rest[np.concatenate([np.arange(x, y) for x, y in zip(begin[i:j], end[i:j], strict=True) if x < y])]])
        rest = rest[(component[rest] != component[c]) & (100 * np.minimum(size[rest], size[c]) >= percent * np.maximum(size[rest], size[c]))]
        rest = rest[bands[c][(bands[rest] == bands[c]).argmax(1)] == bucket]  # others meet in an earlier bucket that both are in
        if not len(rest):
            continue
        mine = ranks[offset[c] : offset[c + 1]]
        mark[mine] = True
        span = np.concatenate([ranks[offset[r] : offset[r + 1]] for r in rest])
        common = np.add.reduceat(mark[span].astype(np.int64), np.cumsum(size[rest]) - size[rest])
        mark[mine] = False
        for r in rest[100 * common >= percent * (size[rest] + size[c] - common)]:
            out[0].append(int(min(ids[c], ids[r])))
            out[1].append(int(max(ids[c], ids[r])))
    return out


def class_links(reps: DataFrame, docs: DataFrame, shingle: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """``id, component`` of the representatives (doc_id, n_shingles, bands) that are linked with another."""
    rows = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    heads = rows.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("c"), F.count("*").alias("many")).where("many > 1")
    members = by_bucket(rows, heads.select("bucket", F.col("c.id").alias("centre"), F.col("c.n").alias("cn")))
    members = written(members, "members")
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    full = shingle_table(docs.join(wanted, "doc_id", "left_semi"), shingle)
    sets = written(full.join(reps, "doc_id").where(F.size("shingles") == F.col("n_shingles")).select("doc_id", "shingles", "bands"), "sets")
    members = members.where("id <> centre")
    links = written(confirmed(_star(members.withColumns({"component": F.col("id"), "cc": F.col("centre")}), percent), sets, percent), "confirmed")
    known = written(components(links), "components")
    apart = _open(members.select("bucket", "id", "n"), known, links)
    heads = apart.groupBy("bucket").agg(F.min(F.struct((-F.col("degree")).alias("degree"), "id", "n", "component")).alias("c"))
    met = by_bucket(apart, heads.select("bucket", F.col("c.id").alias("centre"), F.col("c.n").alias("cn"), F.col("c.component").alias("cc")))
    met = written(met.where("id <> centre"), "met")
    more = written(confirmed(_star(met, percent), sets, percent), "confirmed")
    known = merged(known, more)
    apart = _open(met.select("bucket", "id", "n"), known, links.unionByName(more))
    return merged(known, written(_blocks(apart, sets, percent), "blocks"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: ``doc_id, n_shingles, component_id, kept``."""
    texts = text_of(docs, id_col, text_col)
    signed = written(signatures(docs, shingle, id_col, text_col), "signatures")
    named = signed.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    classes = written(classes, "classes")
    # of classes that share a representative's id (rows with one id and several texts) the largest is searched for links
    one = classes.groupBy("rep").agg(F.max(F.struct("n_shingles", "d1", "d2")).alias("x")).select(F.col("rep").alias("doc_id"), "x.*")
    reps = named.join(one, ["doc_id", "n_shingles", "d1", "d2"], "left_semi").dropDuplicates(["doc_id"])
    linked = class_links(reps, texts.where("doc_id is not null"), shingle, percent)
    joined = signed.join(classes, ["n_shingles", "d1", "d2"], "left").join(linked.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "rep", "doc_id"))
    out = joined.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def clean(docs: DataFrame, shingle: int = SHINGLE, percent: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates, with all columns."""
    gone = near_duplicates(docs, shingle, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("_gone"), "left_anti")
