"""Scoring texts by a trigram model whose counts lie in a log-frequency Bloom filter, broadcast to the workers.

1. Tasks count the distinct words, bigrams and trigrams of chunks of training texts and deal them over hash parts as packed sorted arrays.
   Nothing is a row for each token.
2. Each part sums its own. Counts of words stay exact. Counts of bigrams and trigrams are quantised to levels (thresholds grow by
   ``BASE``), and every n-gram is put once for each level that it reaches into the part's segment of the filter, with ``BITS`` bits for each entry. Every
   n-gram of the training texts is in it. The segments are built once and written as a table.
3. The segments are broadcast in pieces of at most ``PIECE_BYTES``, trigrams first and words last. Tasks hold one piece at a time and probe it for
   the n-grams of their texts, level after level until one is missing, which gives the count back. Pieces lie on the workers' disks, so they
   go out in passes of ``PASS_BYTES``: what earlier passes found goes along with the texts as a byte for each token, and the last pass makes
   the scores. Where the filter fits one pass, nothing is written in between. Scores don't depend on pieces and passes.
4. P1 = (c + 0.5) / (N + 0.5 (V + 1)). P2 = WEIGHT * count(before word) / count(before) + (1 - WEIGHT) * P1, and P3 likewise from trigrams and P2.
   Where the words before are unknown, and for trigrams at the start of a text, the shorter one stands alone.

A pass reads all texts, and the filter has about half a byte for each byte of compressed text: the number of passes grows with the corpus,
so ``PASS_BYTES`` is to be as large as the workers' disks allow.

Training texts: those whose crc32(id as text) mod 5 isn't 1. Tokens: words in lower case (A-Z), then one end.

Defined cases: a null or empty text is its end alone; a null id counts as an empty text for the folds; repeated
rows count and are scored each for itself; an empty table gives no rows; other columns are ignored; a very long text is a chunk of
its own and scored whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, residue, stored, text_of, written
from quillon.llm.shingles import LOWER, STEP, mix, word_hashes
from quillon.llm.tokencount import column_chunks

CHUNK = 4 << 20
BASE = 1.5
BITS = 10
PROBES = 7
WEIGHT = 0.3
END = np.uint64(0x51ED270B7A3F4C15)
WORDS, PAIRS, TRIPLES = 0, 1, 2
#: Of the hashes of n-grams inside a part: there are more parts for more texts, so collisions stay at about one in 10,000.
PART_BITS = 34
PIECE_BYTES = 32 << 20
PASS_BYTES = 4 << 30
#: Keys that are probed at once.
PROBED = 1 << 16


def levels(most: int = 1 << 40) -> np.ndarray:
    """Thresholds of the quantised counts."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * BASE)))
    return np.array(out, np.int64)


def level_values() -> np.ndarray:
    """What a count of each level is taken for; 0 for none."""
    t = levels()
    return np.r_[0.0, np.sqrt(t[:-1] * (t[1:] - 1.0))]


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and each text's number of them (its end included)."""
    data = [t.encode("utf-8", "replace").translate(LOWER) for t in texts]
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    first = np.cumsum([0, *(len(d) + 1 for d in data)])
    h, start, _ = word_hashes(raw)
    many = np.bincount(np.searchsorted(first, start, "right") - 1, minlength=len(texts)) + 1
    out = np.full(int(many.sum()), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(many) - 1] = False
    out[inner] = h
    return out, many


def key_bits(parts: int) -> int:
    """Bits of the hashes of n-grams."""
    return min(64, PART_BITS + (parts - 1).bit_length())


def gram_hashes(tokens: np.ndarray, many: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``bits`` bits of each token with the one before and with the two before; before the first stands the end."""
    first = np.cumsum(many) - many
    before = np.r_[END, tokens[:-1]][: len(tokens)]
    before[first] = END
    earlier = np.r_[END, before[:-1]][: len(tokens)]
    earlier[first] = END
    with np.errstate(over="ignore"):
        pair = mix(before * np.uint64(3) + mix(tokens + STEP))
        triple = mix(earlier * np.uint64(5) + mix(pair + STEP))
    return pair >> np.uint64(64 - bits), triple >> np.uint64(64 - bits)


def part_of(h: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """The part of each hash of so many bits; parts are ranges, so that sorted hashes are sorted by part as well."""
    return ((h >> np.uint64(bits - 24)).astype(np.int64) * parts) >> 24


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences of 3, 4 or 8 bytes each, whichever is enough; the first key in 8 bytes."""
    steps = np.diff(keys)
    most = int(steps.max(initial=0))
    if most < 1 << 24:
        data = np.ascontiguousarray(steps.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
    else:
        data = steps.astype("<u4" if most < 1 << 32 else "<u8")
    return keys[:1].astype("<u8").tobytes() + data.tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=8)
    size = len(raw) // max(1, n - 1)
    if size == 3:
        steps = np.zeros((n - 1, 4), np.uint8)
        steps[:, :3] = raw.reshape(-1, 3)
        steps = steps.view("<u4").ravel()
    else:
        steps = raw.view("<u8" if size == 8 else "<u4")
    return np.cumsum(np.r_[np.frombuffer(data, "<u8", 1), steps.astype(np.uint64)], dtype=np.uint64)


def small(counts: np.ndarray) -> bytes:
    """Counts as bytes where that is enough."""
    return counts.astype(np.uint8 if len(counts) and counts.max() < 256 else np.uint32).tobytes()


def large(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == n else np.uint32).astype(np.int64)


def dealt(keys: np.ndarray, counts: np.ndarray, parts: int, kind: int) -> list[tuple]:
    """(kind, part, n, keys, counts) of sorted keys."""
    at = np.searchsorted(part_of(keys, parts, 64 if kind == WORDS else key_bits(parts)), np.arange(parts + 1)).tolist()
    return [(kind, p, j - i, packed(keys[i:j]), small(counts[i:j])) for p, (i, j) in enumerate(zip(at, at[1:], strict=False)) if j > i]


def counted(texts: DataFrame, parts: int) -> DataFrame:
    """Distinct words, bigrams and trigrams of every chunk of texts, by part."""

    def run(batches):
        import pyarrow as pa

        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        for batch in batches:
            for a, b in column_chunks(batch.column("text"), CHUNK):
                tokens, many = token_hashes(batch.column("text").slice(a, b - a).to_pylist())
                for kind, keys in zip((WORDS, PAIRS, TRIPLES), (tokens, *gram_hashes(tokens, many, key_bits(parts))), strict=True):
                    rows = dealt(*np.unique(keys, return_counts=True), parts, kind)
                    for i in range(0, len(rows), 64):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 64], strict=True), kinds, strict=True)], ["kind", "part", "n", "keys", "counts"])

    return texts.select("text").mapInArrow(run, "kind int, part int, n long, keys binary, counts binary")


def segments(rows: DataFrame, bits_each: int = BITS) -> DataFrame:
    """A row for each kind and part: ``n`` distinct keys, ``total`` counts, ``keys`` and ``counts`` of words, ``bits`` of n-grams, ``bytes`` of all."""

    def run(group):
        import pyarrow as pa

        kind, n = group.column("kind")[0].as_py(), group.column("n").to_pylist()
        every = np.concatenate([unpacked(x, k) for x, k in zip(group.column("keys").to_pylist(), n, strict=True)])
        given = np.concatenate([large(x, k) for x, k in zip(group.column("counts").to_pylist(), n, strict=True)])
        order = np.argsort(every, kind="stable")
        every, given = every[order], given[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        keys, counts = every[first], np.add.reduceat(given, first)
        bits = None if kind == WORDS else segment(keys, counts, bits_each).tobytes()
        data = (packed(keys), small(counts), None, 12 * len(keys)) if kind == WORDS else (None, None, bits, len(bits))
        row = (kind, group.column("part")[0].as_py(), len(keys), int(counts.sum()), *data)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        return pa.table([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["kind", "part", "n", "total", "keys", "counts", "bits", "bytes"])

    return rows.groupBy("kind", "part").applyInArrow(run, "kind int, part int, n long, total long, keys binary, counts binary, bits binary, bytes long")


def addresses(keys: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    """Bits (a row for each probe) of keys at a level, in a segment of ``size`` bits."""
    with np.errstate(over="ignore"):
        one = mix(keys + np.uint64(level) * STEP)
        two = mix(one + STEP) | np.uint64(1)
        k = np.arange(PROBES, dtype=np.uint64)[:, None]
        return (((one + k * two) >> np.uint64(8)) % np.asarray(size, np.uint64)).astype(np.int64)


def segment(keys: np.ndarray, counts: np.ndarray, bits_each: int = BITS) -> np.ndarray:
    """A part's segment of the filter, as bytes."""
    many = np.searchsorted(levels(), counts, "right")
    size = max(64, -(-int(many.sum()) * bits_each // 8) * 8)
    bits = np.zeros(size, bool)
    for level in range(1, int(many.max(initial=0)) + 1):
        bits[addresses(keys[many >= level], level, size).ravel()] = True
    return np.packbits(bits, bitorder="little")


class Filter:
    """The segments of some parts, one after another."""

    def __init__(self, held: dict[int, bytes], parts: int):
        data = [np.frombuffer(held.get(p, b""), np.uint8) for p in range(parts)]
        self.size = np.array([8 * len(x) for x in data], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.concatenate([*data, np.zeros(0, np.uint8)])
        self.parts = parts

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of keys, by probing one after another; 0 where the segment isn't here."""
        if len(keys) > PROBED:
            return np.concatenate([self.levels(keys[i : i + PROBED]) for i in range(0, len(keys), PROBED)])
        out = np.zeros(len(keys), np.uint8)
        part = part_of(keys, self.parts, key_bits(self.parts))
        live, level = np.flatnonzero(self.size[part] > 0), 0
        while len(live):
            level += 1
            ok = np.ones(len(live), bool)
            for row in addresses(keys[live], level, self.size[part[live]]):
                still = np.flatnonzero(ok)
                spot = row[still] + self.first[part[live[still]]]
                ok[still] = (self.bytes[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1
            live = live[ok]
            out[live] = level
        return out


class Piece:
    """What is broadcast at once: words with their exact counts, and segments of bigrams and trigrams."""

    def __init__(self, rows: list[dict], parts: int):
        of = lambda k: {r["part"]: r for r in rows if r["kind"] == k}
        words = [r for _, r in sorted(of(WORDS).items())]  # parts are ranges of hashes
        self.words = np.concatenate([np.zeros(0, np.uint64), *(unpacked(r["keys"], r["n"]) for r in words)])
        self.counts = np.concatenate([np.zeros(0, np.uint32), *(large(r["counts"], r["n"]).astype(np.uint32) for r in words)])
        self.grams = [Filter({p: r["bits"] for p, r in of(k).items()}, parts) for k in (PAIRS, TRIPLES)]

    def word_counts(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        return np.where(self.words[at] == keys, self.counts[at], 0).astype(np.int64)


def probed(pieces: list, tokens: np.ndarray, many: np.ndarray, parts: int) -> list[np.ndarray]:
    """(counts of words, levels of bigrams, levels of trigrams) of all tokens as far as the given pieces (broadcasts) know them."""
    keys = [np.unique(k, return_inverse=True) for k in (tokens, *gram_hashes(tokens, many, key_bits(parts)))]
    keys = [(k, place.astype(np.int32)) for k, place in keys]
    found = [np.zeros(len(k), kind) for (k, _), (_, kind) in zip(keys, KNOWN, strict=True)]
    for piece in pieces:
        here = piece.value
        found[0] += here.word_counts(keys[0][0])
        for n, held in enumerate(here.grams, 1):
            if len(held.bytes):
                found[n] += held.levels(keys[n][0])
        del here
        vars(piece).pop("_value", None)  # one piece at a time: the next use reads it from the worker's disk again
    return [x[place] for x, (_, place) in zip(found, keys, strict=True)]


def token_scores(words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, many: np.ndarray, log_total: float) -> np.ndarray:
    """log10 of each token's probability, from the counts of words and the levels of n-grams."""
    first, values = np.cumsum(many) - many, level_values()
    p = (words + 0.5) / 10.0**log_total
    ended = np.cumsum(many) - 1
    context = np.r_[0, words[:-1]][: len(words)]
    context[first] = words[ended]  # each text has one end, which stands before it
    pair = values[pairs]
    deeper = np.r_[0.0, pair[:-1]][: len(pair)]
    deeper[first] = 0
    for count, whole in ((pair, context.astype(float)), (values[triples], deeper)):
        p = np.where(whole > 0, WEIGHT * np.minimum(count, whole) / np.maximum(whole, 1e-9) + (1 - WEIGHT) * p, p)
    return np.log10(p)


#: What a pass knows of a row's tokens: counts of words (8 bytes each), levels of bigrams and trigrams (1 byte each).
KNOWN = (("words", np.int64), ("pairs", np.uint8), ("triples", np.uint8))
ROWS = "doc_id long, train boolean, text string, words binary, pairs binary, triples binary"
SCORES = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def passed(rows: DataFrame, pieces: list, parts: int, log_total: float, last: bool) -> DataFrame:
    """Rows with what this pass's pieces know, or after the last pass their scores."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in column_chunks(batch.column("text"), CHUNK):
                some = batch.slice(a, b - a)
                tokens, many = token_hashes(some.column("text").to_pylist())
                known = probed(pieces, tokens, many, parts)
                for i, (c, kind) in enumerate(KNOWN):
                    if not some.column(c).null_count:  # an earlier pass has been here
                        known[i] = known[i] + np.frombuffer(b"".join(some.column(c).to_pylist()), kind)
                first = np.cumsum(many) - many
                if not last:
                    states = [[x[i : i + n].tobytes() for i, n in zip(first.tolist(), many.tolist(), strict=True)] for x in known]
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("doc_id", "train", "text")), *(pa.array(x, pa.binary()) for x in states)],
                        ["doc_id", "train", "text", *(c for c, _ in KNOWN)])
                    continue
                words, pairs, triples = known
                total = lambda x: np.add.reduceat(x, first)  # noqa: B023, E731
                base = total(np.log10(words + 0.5)) - many * log_total
                columns = [many, total((words > 0).astype(np.int64)), base, total(token_scores(words, pairs, triples, many, log_total))]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("train"), *map(pa.array, columns)], ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    return rows.mapInArrow(run, SCORES if last else ROWS)


def pieces_of(sizes: list[tuple[int, int, int]], most: int) -> list[list[tuple[int, int]]]:
    """(kind, part) of each piece, from (kind, part, bytes): trigrams first, words last, ``most`` bytes a piece or one part."""
    out, held = [[]], 0
    for kind, part, size in sorted(sizes, key=lambda x: (-x[0], x[1])):
        if out[-1] and held + size > most:
            out.append([])
            held = 0
        out[-1].append((kind, part))
        held += size
    return out


def trained(texts: DataFrame, parts: int, bits_each: int = BITS) -> DataFrame:
    """The table of segments of some texts, written."""
    return written(segments(counted(texts, parts), bits_each), "segments")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE_BYTES, most: int = PASS_BYTES, bits_each: int = BITS) -> DataFrame:
    """A row for each row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; ``piece``, ``most``: bytes of a piece and of a pass."""
    spark = docs.sparkSession
    parts = max(12, 2 * docs.rdd.getNumPartitions())
    none = [F.lit(None).cast("binary").alias(c) for c, _ in KNOWN]
    rows = text_of(docs, id_col, text_col).select("doc_id", (residue("doc_id", 5) != 1).alias("train"), "text", *none)
    table = trained(rows.where("train"), parts, bits_each)
    words = table.where(F.col("kind") == WORDS)
    n, v = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    log_total = float(np.log10(n + 0.5 * (v + 1)))
    plan = pieces_of([tuple(r) for r in table.select("kind", "part", "bytes").collect()], piece)
    a_pass, path = max(1, most // piece), None
    for i in range(0, len(plan), a_pass):
        sent = [spark.sparkContext.broadcast(_piece(table, held, parts)) for held in plan[i : i + a_pass]]
        last = i + a_pass >= len(plan)
        rows = passed(rows, sent, parts, log_total, last)
        if not last:
            rows, new = stored(rows, "pass")
            for b in sent:
                b.destroy()
            discard(spark, [path] if path else [])
            path = new
    return rows.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _piece(table: DataFrame, held: list[tuple[int, int]], parts: int) -> Piece:
    """Read a piece of the filter to the driver, ``PIECE_BYTES`` at most."""
    mine = F.lit(False)
    for kind in {k for k, _ in held}:
        of = [p for k, p in held if k == kind]
        mine |= (F.col("kind") == kind) & F.col("part").between(min(of), max(of))  # parts of a piece follow one another
    return Piece(table.where(mine).select("kind", "part", "n", "keys", "counts", "bits").toArrow().to_pylist(), parts)
