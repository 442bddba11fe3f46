"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme-value theory.

1. Words and their first 4, 6 and 8 bytes are counted in toxic and other training documents, in
   2^``BUCKET_BITS`` hashed buckets: the model's size is fixed, and no word is left out. Tasks count for
   themselves before anything is shuffled. Log-odds have an informative Dirichlet prior and are
   drawn to zero by ``DOUBT`` standard deviations; a word scores as its most telling part does, less a drift.
2. A linear-time scan gives all maximal scoring segments of a text. With lambda the positive root of
   E[exp(lambda s)] = 1 over the words of other documents, and K from their documents' best segments
   (Gumbel moments), a segment of score S in n words has the expectation E = K n exp(-lambda S) and the p-value 1 - exp(-E);
   passages expected less than ``MOST_EXPECTED`` times are significant.
3. A document's evidence is -log p of its best segment and the sum of -log p over all its other segments that are expected
   less than ``EVIDENCE_EXPECTED`` times. With the text's length, they become a probability by logistic regression. Half of the
   training documents are described by the log-odds of the other half, so that the calibration sees texts as new as those it is for.

Training takes at most about ``MOST_TRAINING`` labelled rows (by a hash of the id); scoring covers every text.
Only texts are inputs of a score. Segments stay in their tasks; of each training text four numbers come to the driver.

Defined cases: null and empty texts have no segments and score as such; null ids count as held in training
folds by the empty text; repeated rows are scored alike; without labels of both kinds the score is the share
of toxic ones (0 without any); empty tables give no rows; other columns are ignored; very long texts are scanned whole, in time and memory
linear in their length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import residue, text_of, written
from quillon.llm.shingles import LOWER, STEP, mix, word_hashes
from quillon.llm.tokencount import chunks

BUCKET_BITS = 20
PREFIXES = (4, 6, 8)
PRIOR = 1000.0
DOUBT = 1.28
DRIFT = 0.2
MOST_TRAINING = 200_000
MOST_EXPECTED = 0.01
EVIDENCE_EXPECTED = 1.0
CHUNK = 1 << 19


@dataclass
class Model:
    """``table``: a score for each bucket; ``lam``, ``k``: extreme-value parameters; ``weights`` of (1, best, others, log n)."""

    table: np.ndarray
    lam: float = 1.0
    k: float = 0.1
    weights: tuple[float, ...] = (0.0,) * 4
    share: float = 0.0


def parts_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word and its prefixes (the last bucket: no such prefix), each word's text, start and end byte."""
    data = [t.encode("utf-8", "replace").translate(LOWER) for t in texts]
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    first = np.cumsum([0, *(len(d) + 1 for d in data)])
    h, start, end = word_hashes(raw)
    shift, none = np.uint64(64 - BUCKET_BITS), 1 << BUCKET_BITS
    out = np.empty((len(h), 1 + len(PREFIXES)), np.int32)
    out[:, 0] = h >> shift
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(raw) + 1, 8), (1, 1))[start]).view(np.uint64).ravel()
    for j, k in enumerate(PREFIXES, 1):
        with np.errstate(over="ignore"):
            p = mix((eight & np.uint64((1 << 8 * k) - 1)) + np.uint64(k) * STEP)
        out[:, j] = np.where(end - start > k, (p >> shift).astype(np.int64), none)
    doc = np.searchsorted(first, start, "right") - 1
    return out, doc, start - first[doc], end - first[doc]


def log_odds(toxic: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Scores of buckets from counts, with one more bucket of score 0."""
    both = toxic + other
    prior = PRIOR * both / max(1.0, both.sum())
    a, b = toxic + prior, other + prior
    with np.errstate(divide="ignore", invalid="ignore"):
        delta = np.log(a / np.maximum(1e-9, toxic.sum() + PRIOR - a)) - np.log(b / np.maximum(1e-9, other.sum() + PRIOR - b))
        sure = np.abs(delta) - DOUBT * np.sqrt(1 / a + 1 / b)
    return np.append(np.where(both > 0, np.sign(delta) * np.maximum(0, sure), 0), 0).astype(np.float32)


def word_scores(table: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The most telling part's score less the drift."""
    s = table[parts]
    return s[np.arange(len(s)), np.abs(s).argmax(1)].astype(np.float64) - DRIFT


def segments_of(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a sequence, in linear time.

    Each candidate keeps the sum before it and through it. A new one is joined to the last candidate
    whose sum before is less, if that one's sum through it isn't greater; ``link`` leads to that candidate without going
    through those between."""
    kept: list[list] = []  # first, end, sum before, sum through, place of the last with a lesser sum before
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total, -1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= new[3]:
                new[4] = j
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3], kept[j][4]]
            del kept[j:]
    return [(a, b, through - before) for a, b, before, through, _ in kept]


def text_segments(model_table: np.ndarray, texts: list[str]):
    """For each text: its number of words and its maximal segments (first word, end word, score); the words' scores and places."""
    parts, doc, start, end = parts_of(texts)
    s = word_scores(model_table, parts)
    many = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(many) - many
    # neighbours of one sign act as one
    sign = s > 0
    edge = np.flatnonzero(np.r_[True, (sign[1:] != sign[:-1]) | (doc[1:] != doc[:-1])]) if len(s) else np.zeros(0, np.int64)
    run = np.add.reduceat(s, edge) if len(s) else s
    run_doc = doc[edge]
    bounds = np.searchsorted(run_doc, np.arange(len(texts) + 1))
    ends = np.append(edge[1:], len(s))
    out = []
    for d in range(len(texts)):
        a, b = bounds[d], bounds[d + 1]
        found = segments_of(run[a:b].tolist()) if (run[a:b] > 0).any() else []
        out.append([(int(edge[a + x] - first[d]), int(ends[a + y - 1] - first[d]), score) for x, y, score in found])
    return many, out, s, doc, first, start, end


def evidence(score: np.ndarray | float, many: int, lam: float, k: float) -> np.ndarray:
    """-log p of segments of the given scores in a text of ``many`` words."""
    expected = np.exp(-np.clip(lam * np.asarray(score) - np.log(k * max(1, many)), -30, 700))
    return -np.log(-np.expm1(-expected))


def features(many: np.ndarray, found: list, lam: float, k: float) -> np.ndarray:
    """(1, log of 1 + the best segment's evidence, the same of the others' sum, log of words) of each text."""
    out = np.ones((len(many), 4))
    least = -np.log(-np.expm1(-EVIDENCE_EXPECTED))  # -log p of what is expected so often
    for row, n, segments in zip(out, many, found, strict=True):
        each = np.sort(evidence(np.array([x[2] for x in segments]), n, lam, k))[::-1]
        rest = each[1:]
        row[1:] = np.log1p(each[:1].sum()), np.log1p(rest[rest > least].sum()), np.log(max(1, n))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y is not null and doc_id is not null")
    known = known.where(residue("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = known.count()
    if n > MOST_TRAINING:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * MOST_TRAINING / n))
    rows = text_of(docs, id_col, text_col).join(F.broadcast(known.limit(2 * MOST_TRAINING)), "doc_id").select("text", "y", (residue("doc_id", 5) > 2).cast("int").alias("half"))
    size = 1 << BUCKET_BITS

    def count(batches):
        import pyarrow as pa

        counts = np.zeros((4, size + 1), np.int64)  # label + 2 * half
        for batch in batches:
            texts, kind = batch.column("text").to_pylist(), batch.column("y").to_numpy() + 2 * batch.column("half").to_numpy()
            for a, b in chunks(texts, CHUNK):
                parts, doc, *_ = parts_of(texts[a:b])
                for k in range(4):
                    counts[k] += np.bincount(parts[(kind[a:b] == k)[doc]].ravel(), minlength=size + 1)
        used = np.flatnonzero(counts[:, :size].any(0))
        for a in range(0, len(used), 1 << 16):
            cut = used[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(cut), *(pa.array(counts[k, cut]) for k in range(4))], ["bucket", *names])

    names = [f"n{k}" for k in range(4)]
    summed = rows.mapInArrow(count, "bucket long, n0 long, n1 long, n2 long, n3 long").groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])
    found = summed.toArrow()  # at most 2^BUCKET_BITS rows of numbers
    total = np.zeros((4, size))
    total[:, found.column("bucket").to_numpy()] = [found.column(n).to_numpy() for n in names]
    table = log_odds(total[1] + total[3], total[0] + total[2])
    shared = spark.sparkContext.broadcast([log_odds(total[3], total[2]), log_odds(total[1], total[0])])  # of the other half

    def described(make, schema: str) -> DataFrame:
        """``make(texts, y, table)`` gives the columns of ``schema`` for a chunk of one half's rows."""
        names = [x.split()[0] for x in schema.split(", ")]

        def run(batches):
            import pyarrow as pa
            import pyarrow.compute

            for batch in batches:
                for half in (0, 1):
                    mine = batch.filter(pa.compute.equal(batch.column("half"), half))
                    texts, y = mine.column("text").to_pylist(), mine.column("y").to_numpy()
                    for a, b in chunks(texts, CHUNK):
                        columns = make(texts[a:b], y[a:b], shared.value[half])
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        return rows.mapInArrow(run, schema)

    def calibrating(texts, y, table):
        many, segments, scores, doc = text_segments(table, texts)[:4]
        # e^(lambda s) is averaged over the words of other documents: a histogram of scores, with a chunk's first row
        level = np.clip(np.round(scores[(y == 0)[doc]] * 20), -200, 400).astype(int) + 200
        hists = [np.bincount(level, minlength=601).tolist(), *([] for _ in range(len(y) - 1))]
        calm = (y == 0) & (many > 0)
        best = np.array([max((x[2] for x in f), default=0.0) for f in segments])
        return y.astype(np.int32), np.where(calm, best, 0.0), np.where(calm, np.log(np.maximum(1, many)), 0.0), calm.astype(np.int64), hists

    seen = described(calibrating, "y int, best double, logn double, calm long, hist array<long>")
    seen = written(seen, "calibration")  # read twice
    share, kinds, best, logn, calm = seen.agg(F.avg("y"), F.count_distinct("y"), F.sum("best"), F.sum("logn"), F.sum("calm")).first()
    model = Model(table, share=float(share or 0.0))
    if kinds < 2:
        return model
    hist = np.zeros(601)
    for r in seen.select(F.posexplode("hist").alias("b", "n")).groupBy("b").agg(F.sum("n").alias("n")).collect():
        hist[r["b"]] = r["n"]
    model.lam = lam = positive_root(hist, (np.arange(601) - 200) / 20)
    if calm:
        model.k = float(np.exp(np.clip((lam * best - logn) / calm - 0.5772, -20, 5)))
    k = model.k

    def featured(texts, y, table):
        x = features(*text_segments(table, texts)[:2], lam, k)
        return y.astype(np.int32), x[:, 1], x[:, 2], x[:, 3]

    got = described(featured, "y int, best double, others double, logn double").toArrow()  # bounded by the training bound
    x = np.stack([np.ones(got.num_rows), *(got.column(c).to_numpy() for c in ("best", "others", "logn"))], 1)
    model.weights = tuple(logistic(x, got.column("y").to_numpy()).tolist())
    return model


def positive_root(hist: np.ndarray, scores: np.ndarray) -> float:
    """lambda > 0 with E[exp(lambda s)] = 1 for scores of negative mean."""
    p = hist / max(1.0, hist.sum())
    if not (p[scores > 0].sum() > 0 and (p * scores).sum() < 0):
        return 1.0
    low, high = 1e-4, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (p * np.exp(np.minimum(mid * scores, 500))).sum() > 1 else (mid, high)
    return low


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, n_passages, best`` of every row."""
    table = docs.sparkSession.sparkContext.broadcast(model.table)
    lam, k, weights, share = model.lam, model.k, np.array(model.weights), model.share

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for a, b in chunks(texts, CHUNK):
                many, found, *_ = text_segments(table.value, texts[a:b])
                x = features(many, found, lam, k)
                p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))) if weights.any() else np.full(b - a, share)
                n = [sum(lam * s[2] - np.log(k * max(1, m)) > -np.log(MOST_EXPECTED) for s in f) for f, m in zip(found, many, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(p), pa.array(n, pa.int64()), pa.array(x[:, 1])], ["doc_id", "score", "n_passages", "best"])

    return text_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, n_passages long, best double")


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every significant passage: ``doc_id, start, end`` (words), ``passage`` (its text), ``score, expected``."""
    table = docs.sparkSession.sparkContext.broadcast(model.table)
    lam, k = model.lam, model.k

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows = []
            for a, b in chunks(texts, CHUNK):
                many, found, _, _, first, start, end = text_segments(table.value, texts[a:b])
                for d, f in enumerate(found):
                    data = texts[a + d].encode("utf-8", "replace") if f else b""
                    for x, y, s in f:
                        expected = k * int(many[d]) * float(np.exp(-lam * s))
                        if expected < MOST_EXPECTED:
                            cut = data[start[first[d] + x] : end[first[d] + y - 1]].decode("utf-8", "replace")
                            rows.append((ids[a + d], x, y, cut, s, expected))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "start", "end", "passage", "score", "expected"])

    return text_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, end long, passage string, score double, expected double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its probability from a model of the training folds."""
    rows = score(docs, fit(docs, labels))
    return rows.select("doc_id", (residue("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_passages", "best")
