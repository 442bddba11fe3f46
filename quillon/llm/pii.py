"""Personal data: fixed kinds by pattern, further identifiers by bootstrapping. DataFrame functions only.

Base: e-mail addresses, IP addresses, card numbers and phone numbers, each kind leftmost and without overlap.
The patterns are written so that each run of characters is tried from its start alone; so long runs take
linear time and match as the plain patterns do.

Bootstrapping:

1. Seeds are all base spans, each as a whole, and secrets: quoted values of assignments (``name = "value"``) that look like a key,
   hexadecimal of 32 digits or more or 20 characters or more with three digits, capitals and small letters each. Secrets are
   spans of the kind ``secret`` themselves.
2. Instances are the seeds, other assigned quoted values of 8 characters or more, and words of six
   characters or more with a digit or @. The one, two or three tokens before an instance are its lexical patterns; tokens are words
   and single marks of punctuation, within ``REACH`` code points.
3. In each round a pattern's confidence is the share of all its occurrences in the corpus (whatever follows) that
   known instances follow; patterns with ``MIN_VALUES`` distinct known values and ``MIN_CONFIDENCE`` are trusted, and an
   instance is known if 1 - prod(1 - confidence) over its trusted patterns reaches ``MIN_CONFIDENCE``. Rounds end when
   nothing new is known. An instance whose value is known is marked wherever it occurs, as ``other`` where it is no seed.

Patterns and instances are rows, joined and aggregated. Occurrences are counted only of patterns with enough known values, found in the texts
through a Bloom filter of ``PATTERNS_A_PASS`` patterns at most; more patterns are counted in several passes.
Counts are taken over all documents; a common pattern or value is counted by partial aggregation.

Defined cases: null texts are empty; null ids stay; repeated rows give the same spans again;
an empty table gives no rows; other columns are ignored; very long texts are searched whole, in time that is linear in their length
(quadratic, with a small factor, in the number of matches in one text). Positions are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import computed_once, text_of, words, written

LOCAL = "A-Za-z0-9._%+-"
#: Kinds in the order of ties, with patterns that begin only where a run of theirs begins.
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds.
SECRET, OTHER = "secret", "other"
#: A quoted value behind a name and = or :, with that sign and the opening quote.
ASSIGNED = r"""[=:](?<=[A-Za-z0-9_.-]\x20{0,3}[=:])\x20{0,3}["'][A-Za-z0-9+/_=.@%-]{8,}+(?=["'])"""
OPENING = r"""^[=:]\x20*["']"""
HEX_KEY = r"^(?=[0-9A-Fa-f]*+$)(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9]).{32,}"
MIXED_KEY = r"^(?=[A-Za-z0-9+/_=-]{20,}+$)(?=(?:[^0-9]*+[0-9]){3})(?=(?:[^A-Z]*+[A-Z]){3})(?=(?:[^a-z]*+[a-z]){3})"
WORDLIKE = "A-Za-z0-9._%+@/-"
INSTANCE = rf"(?<![{WORDLIKE}])(?=[A-Za-z._%+/-]*+[0-9@])[{WORDLIKE}]{{6,}}+"
#: Marks that are tokens of their own.
MARKS = r"""["'`=:<>()\[\]{},;]"""
REACH = 96
WINDOWS = 3
MIN_VALUES = 3
MIN_CONFIDENCE = 0.5
ROUNDS = 3
#: One in so many documents is looked at first, to drop patterns that are too common to be trusted.
FIRST_LOOK = 16
PATTERNS_A_PASS = 1 << 21
BITS_A_PATTERN = 32
PROBES = (0, 11, 22, 33)
SPAN = "array<struct<start:int,place:int,kind:string,end:int>>"
FOUND = "array<struct<start:int,end:int,value:string,before:string,whole:boolean>>"


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern: array of (start, end, value, before, whole). The text between them tells where they are.

    ``before``: what lies between the last match and this one, its last ``REACH`` code points; ``whole``: its first token isn't cut."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    steps = F.filter(pairs, lambda x: x["value"].isNotNull())  # behind the last match there is a gap alone
    state = F.struct(F.lit(0).alias("at"), _none(FOUND).alias("out"))

    def put(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["value"])
        whole = (F.char_length(x["gap"]) <= REACH) & ((acc["at"] == 0) | x["gap"].rlike(r"^\s"))
        one = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), F.substring(x["gap"], -REACH, REACH).alias("before"), whole.alias("whole"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(steps, state, put, lambda acc: acc["out"])


def _none(kind: str) -> Column:
    """An empty array."""
    return F.from_json(F.lit("[]"), kind)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.char_length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return n.between(12, 19) & luhn(_digits(value))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_found(text: Column) -> Column:
    """All base matches: array of (start, place, kind, end, value, before, whole), sorted by start, then kind."""
    needs = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9]"), "phone": text.contains("+")}

    def part(place: int, kind: str, pattern: str) -> Column:
        ok = F.filter(located(text, pattern), lambda x: _valid(kind, x["value"]))
        found = F.transform(ok, lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), x["end"].alias("end"),
            x["value"].alias("value"), x["before"].alias("before"), x["whole"].alias("whole")))
        return F.when(needs[kind], found).otherwise(_none(SPAN[:-2] + ",value:string,before:string,whole:boolean>>"))

    return F.array_sort(F.concat(*[part(i, k, p) for i, (k, p) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))]))


def _spans(found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["place"].alias("place"), x["kind"].alias("kind"), x["end"].alias("end")))


def shown(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def assigned(text: Column) -> Column:
    """The quoted values of assignments, like ``located``."""

    def inner(x: Column) -> Column:
        value = F.regexp_replace(x["value"], OPENING, "")
        opening = F.regexp_extract(x["value"], OPENING, 0)
        return F.struct((x["start"] + F.char_length(opening)).alias("start"), x["end"].alias("end"), value.alias("value"), F.concat(x["before"], opening).alias("before"), x["whole"].alias("whole"))

    return F.when(text.rlike(r"""[=:]\x20{0,3}["']"""), F.transform(located(text, ASSIGNED), inner)).otherwise(_none(FOUND))


def tokens(text: Column) -> Column:
    """Words and marks in order, in lower case."""
    return words(F.regexp_replace(F.lower(text), f"({MARKS})", " $1 "))


def _window(t: Column, last: Column, k: int) -> Column:
    """The hash of ``k`` tokens up to place ``last``, the last first; null where there are fewer."""
    return F.when(last >= k - 1, F.xxhash64(F.lit(k), *[F.get(t, last - i) for i in range(k)]))


def _patterns(x: Column) -> Column:
    """The patterns of a located instance, each with a word at least; none if it begins inside a token."""
    begins = x["before"].rlike(rf"(?:\s|{MARKS})$")
    wordy = lambda t, k: F.exists(F.slice(t, F.greatest(F.size(t) - k + 1, F.lit(1)), k), lambda w: ~w.rlike(rf"^{MARKS}$"))
    of = lambda t: F.array_compact(F.array(*[F.when(wordy(t, k), _window(t, F.size(t) - 1, k)) for k in range(1, WINDOWS + 1)]))
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    all_ = bind(tokens(x["before"]), lambda t: of(F.when(x["whole"], t).otherwise(F.slice(t, 2, REACH))))
    return F.when(begins, all_).otherwise(F.array().cast("array<bigint>"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: ``doc_id``, a key of its text, ``base`` and ``secrets`` spans, and ``instances`` (start, end, value, patterns, seed)."""
    d = text_of(docs, id_col, text_col)
    text = F.col("text")
    d = d.select(
        "doc_id",
        F.xxhash64("text").alias("key"),
        base_found(text).alias("base"),
        assigned(text).alias("assigned"),
        F.when(text.rlike("[0-9@]"), located(text, INSTANCE)).otherwise(_none(FOUND)).alias("found"),
    )
    over = lambda name: lambda x: F.exists(name, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    is_key = lambda x: x["value"].rlike(HEX_KEY) | x["value"].rlike(MIXED_KEY)
    secret = F.transform(F.filter("assigned", is_key), lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("place"), F.lit(SECRET).alias("kind"), x["end"].alias("end")))

    def instance(x: Column, seed: Column) -> Column:
        value = F.when(seed, x["value"]).otherwise(F.regexp_replace(x["value"], r"[._%+/-]+$", ""))
        return F.struct(x["start"].alias("start"), (x["start"] + F.char_length(value)).alias("end"), value.alias("value"), _patterns(x).alias("patterns"), seed.alias("seed"))

    wordlike = F.filter("found", lambda x: ~over("base")(x) & ~over("assigned")(x))
    instances = F.concat(
        F.transform("base", lambda x: instance(x, F.lit(True))),
        F.transform(F.filter("assigned", lambda x: is_key(x) | ~over("base")(x)), lambda x: instance(x, is_key(x))),
        F.transform(wordlike, lambda x: instance(x, F.lit(False))),
    )
    return computed_once(d, "doc_id", "key", _spans(F.col("base")).alias("base"), secret.alias("secrets"), instances.alias("instances"))


def _among(patterns: DataFrame, count: int) -> Column:
    """A test of ``pattern`` that all given ones and about one in 5000 others pass: a Bloom filter of their hashes.

    Its bits are one value of at most ``PATTERNS_A_PASS * BITS_A_PATTERN`` bits (8 MB), which Spark sends with the stage."""
    bits = 1 << max(10, (BITS_A_PATTERN * count - 1).bit_length())
    places = [F.pmod(F.shiftright("pattern", k), F.lit(bits)) for k in PROBES]
    masks = patterns.select(F.explode(F.array(*places)).alias("b")).groupBy((F.col("b") / 64).cast("long").alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("m"))
    every = patterns.sparkSession.range(bits // 64).join(masks, "id", "left").select("id", F.coalesce("m", F.lit(0)).alias("m"))
    table = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "m"))), lambda x: x["m"]).alias("bits")).scalar()
    hits = [F.getbit(F.get(table, (x / 64).cast("int")), (x % 64).cast("int")) == 1 for x in places]
    return hits[0] & hits[1] & hits[2] & hits[3]


def occurrences(texts: DataFrame, patterns: DataFrame, count: int) -> DataFrame:
    """How often each of ``count`` patterns occurs in the texts, whatever follows: ``pattern, total``."""
    t = texts.select(tokens(F.col("text")).alias("t0"))
    late = [F.concat(F.array_repeat(F.lit(None).cast("string"), k), "t0").alias(f"t{k}") for k in range(WINDOWS)]  # each token beside those before it
    rows = t.select(F.inline(F.arrays_zip(*late))).toDF(*[f"t{k}" for k in range(WINDOWS)]).where("t0 is not null")
    ended = [F.when(F.col(f"t{k - 1}").isNotNull(), F.xxhash64(F.lit(k), *[f"t{i}" for i in range(k)])) for k in range(1, WINDOWS + 1)]
    places = rows.select(F.explode(F.array(*ended)).alias("pattern"))
    passes = -(-count // PATTERNS_A_PASS)
    out = None
    for k in range(passes):
        mine = patterns.select("pattern").where(F.pmod(F.hash("pattern"), F.lit(passes)) == k)
        some = places.where(_among(mine, min(count, PATTERNS_A_PASS))).groupBy("pattern").agg(F.count("*").alias("total")).join(mine, "pattern")
        out = some if out is None else out.unionByName(some)
    return out


def counted(texts: DataFrame, patterns: DataFrame) -> DataFrame | None:
    """``pattern, total`` of the given patterns (pattern, known) that can still be trusted.

    Occurrences in some documents bound those in all from below: what is below the confidence with them is so for good."""
    n = patterns.count()
    if not n:
        return None
    some = occurrences(texts.where(F.pmod(F.xxhash64("text"), F.lit(FIRST_LOOK)) == 0), patterns, n)
    hopeful = written(patterns.join(some, "pattern", "left").where(F.col("known") >= MIN_CONFIDENCE * F.coalesce("total", F.lit(0))).select("pattern"), "hopeful")
    n = hopeful.count()
    return written(occurrences(texts, hopeful, n), "totals") if n else None


def is_hidden(value: Column, hide: int) -> Column:
    """Whether a seed is hidden where one in ``hide`` is."""
    return F.pmod(F.xxhash64(value), F.lit(hide)) == 0


def bootstrap(docs: DataFrame, scan: DataFrame, rounds: int = ROUNDS, text_col: str = "text", id_col: str = "doc_id", hide: int = 0) -> DataFrame:
    """All known values: those of seeds and those that trusted patterns lead to.

    ``hide``: one in so many seeds is not known at first and counts half for its patterns' confidence, as nothing tells yet whether it is one; see ``recall``."""
    rows = scan.select(F.explode("instances").alias("x")).select("x.value", "x.patterns", "x.seed")
    every = written(rows.where("seed").select("value").distinct(), "seeds")
    seeds = every.where(~is_hidden(F.col("value"), hide)) if hide else every
    edges = written(rows.select("value", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.count("*").alias("n")), "edges")
    texts = text_of(docs, id_col, text_col)
    known, totals, before = seeds, None, 0
    for _ in range(rounds):
        hits = edges.join(known, "value").groupBy("pattern").agg(F.sum("n").alias("known"), F.count("*").alias("v")).where(F.col("v") >= MIN_VALUES)
        if hide:
            unsure = edges.join(every.join(known, "value", "left_anti"), "value").groupBy("pattern").agg((F.sum("n") / 2).alias("unsure"))
            hits = hits.join(unsure, "pattern", "left").select("pattern", (F.col("known") + F.coalesce("unsure", F.lit(0))).alias("known"), "v")
        hits = written(hits, "hits")
        more = counted(texts, hits if totals is None else hits.join(totals, "pattern", "left_anti"))
        totals = more if totals is None else totals if more is None else totals.unionByName(more)
        if totals is None:
            break
        trusted = hits.join(totals, "pattern").select("pattern", (F.col("known") / F.col("total")).alias("confidence")).where(F.col("confidence") >= MIN_CONFIDENCE)
        # the logarithm of 1 less a confidence of 1 would be minus infinity, and so the score 1
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-12))))
        scores = edges.join(trusted, "pattern").groupBy("value").agg((1 - F.exp(doubt)).alias("score")).where(F.col("score") >= MIN_CONFIDENCE)
        found = written(scores.select("value").join(seeds, "value", "left_anti"), "instances")
        known = seeds.unionByName(found)
        now = found.count()
        if now == before:  # known values only grow, so nothing changes any more
            break
        before = now
    return known


def recall(docs: DataFrame, hide: int = 2, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What bootstrapping is worth: one in ``hide`` seeds is hidden by a hash of its value, and found again only if patterns that the other seeds
    induce lead to it. A row for each kind: ``kind, hidden, recovered`` distinct values; ``beyond``: values found that are no seeds of any kind (kind ``other``)."""
    scan = written(scanned(docs, id_col, text_col), "scan")
    known = bootstrap(docs, scan, rounds, text_col, id_col, hide).distinct().withColumn("found", F.lit(True))
    seeds = scan.select(F.explode("instances").alias("x")).where("x.seed").select("x.value").distinct().withColumn("seed", F.lit(True))
    digits = _digits(F.col("value"))
    kind = F.when(F.col("value").contains("@"), "email").when(F.col("value").startswith("+"), "phone").when(F.col("value").rlike(r"^[0-9]+(\.[0-9]+){3}$"),
        "ip").when(F.col("value").rlike(r"^[0-9\x20-]+$") & (F.char_length(digits) <= 19), "card").otherwise(SECRET)
    both = seeds.join(known, "value", "full").select("value", F.coalesce("seed", F.lit(False)).alias("seed"), F.coalesce("found", F.lit(False)).alias("found"))
    rows = both.select(F.when(F.col("seed"), kind).otherwise(OTHER).alias("kind"), "seed", "found", (F.col("seed") & is_hidden(F.col("value"), hide)).alias("hidden"))
    return rows.groupBy("kind").agg(F.count_if("hidden").alias("hidden"), F.count_if(F.col("hidden") & F.col("found")).alias("recovered"), F.count_if(~F.col("seed")).alias("beyond"))


def find(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: ``doc_id``, ``key``, ``base`` and ``added`` spans."""
    scan = written(scanned(docs, id_col, text_col), "scan")
    known = bootstrap(docs, scan, rounds, text_col, id_col)
    at = scan.select("doc_id", "key", F.explode("instances").alias("x")).where("not x.seed").select("doc_id", "key", "x.start", "x.end", "x.value")
    spans = at.join(known, "value").groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", F.lit(len(KINDS) + 1).alias("place"), F.lit(OTHER).alias("kind"), "end")).alias("others"))
    spans = spans.withColumnsRenamed({"doc_id": "_d", "key": "_k"})
    joined = scan.select("doc_id", "key", "base", "secrets").join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    return joined.select("doc_id", "key", "base", F.concat("secrets", F.coalesce("others", _none(SPAN))).alias("added"))


def report(found: DataFrame) -> DataFrame:
    """Counts of base spans, the digest of them and all spans as text; ``n_secret``, ``n_other``: counts of the added ones."""
    count = lambda kind, of="base": F.size(F.filter(of, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
        shown(F.array_sort(F.concat("base", "added"))).alias("spans"), count(SECRET, "added"), count(OTHER, "added"))


def redact(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; all other columns stay.

    Overlapping spans are one, under the kind that begins first."""
    found = find(docs, rounds, id_col, text_col).dropDuplicates(["doc_id", "key"])
    spans = found.select(F.col("doc_id").alias("_pii_id"), F.col("key").alias("_pii_key"), F.array_sort(F.concat("base", "added")).alias("_pii_spans")).where(F.size("_pii_spans") > 0)
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.join(spans, F.col(id_col).cast("long").eqNullSafe(F.col("_pii_id")) & (F.xxhash64(text) == F.col("_pii_key")), "left")
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), s["kind"], F.lit(">")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate("_pii_spans", state, put, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))
    return joined.withColumn(text_col, F.when(F.col("_pii_spans").isNotNull(), whole).otherwise(F.col(text_col))).select(*[F.col(f"`{c}`") for c in docs.columns])
