"""Personal data against plain regular expressions; bootstrapping on planted contexts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from helpers import AWKWARD, clashing, docs

from quillon.llm import pii
from quillon.llm.common import table

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, v):
    g = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 12 <= len(g) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - (9 if int(c) > 4 else 0) for i, c in enumerate(reversed(g))) % 10 == 0
    return kind != "phone" or 9 <= len(g) <= 15


def brute(text):
    out = [(m.start(), o, k, m.end()) for o, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if valid(k, m.group())]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_base_against_plain_patterns(spark, sf_dir):
    random.seed(4)
    parts = ["a", "B.c", "@", "x.y", "1", "12", "255", "256", ".", "-", " ", "+", "(", ")", "4111111111111111", "4111 1111-1111 1111", "a@b.c", "_x@d.e", "%", "é", "😀", "1.2.3.4", "+1 (555) 010-9999", "00000000000000000000001"]
    rows = AWKWARD + [(100 + i, "".join(random.choices(parts, k=14))) for i in range(500)]
    rows += [(2000, "a" * 50_000), (2001, "1" * 50_000), (2002, "1." * 20_000), (2003, "@" * 5_000), (2004, "a@b.c " * 300)]
    rows += [(5000 + r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    got = pii.report(pii.find(clashing(docs(spark, rows)), rounds=1)).collect()
    text = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    want = Counter()
    for i, t in rows:
        spans = brute(t or "")
        n = Counter(k for k, *_ in spans)
        want[(i, *(n[k] for k in PLAIN), hashlib.sha256(text(spans).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want


def test_contexts_lead_to_unseen_identifiers(spark):
    filler = "some words that are of no use to anyone here "
    rows = [(i, f"{filler} my email is user{i}@mail.example and no more") for i in range(10)]
    rows += [(20, f"{filler} my email is jane_doe99/corp and no more"), (21, f"{filler} she wrote jane_doe99/corp twice"), (22, f"{filler} version of release-2024 was good")]
    rows += [(30 + i, f"{filler} contact no: jane_doe99/corp or {w}") for i, w in enumerate(("abc", "abd"))]
    rows += [(40 + i, f"{filler} the number u{i}@v.example was the number of words") for i in range(4)] + [(50 + i, "the number of words, the number of words, the number of 123456-7") for i in range(9)]
    got = {r["doc_id"]: r for r in pii.report(pii.find(docs(spark, rows))).collect()}
    text = dict(rows)
    for i in (20, 21, 30, 31):
        a = text[i].index("jane_doe99/corp")
        assert got[i]["spans"] == f"other:{a}:{a + 15}"
    assert got[22]["spans"] == "" and all(got[50 + i]["n_other"] == 0 for i in range(9))


def spans(got, kind):
    """The marked texts of a kind by document."""
    return {i: [text[int(a) : int(b)] for k, a, b in (x.split(":") for x in r.split(",") if r) if k == kind] for i, text, r in got}


def found(spark, rows, **more):
    by_id = dict(rows)
    return [(r["doc_id"], by_id[r["doc_id"]], r["spans"]) for r in pii.report(pii.find(docs(spark, rows), **more)).collect()]


KEYS = ["04dbebab91ab85687d33eeaaf9ac699e1188f962", "F3EF4D6B2755A36D7D9C25BD72C4D5F6", "sk_9dKq2LmX07pRtVwYzB31", "cb1a9fee807a05366fcb8b6c95c7c565ede51a72"]


def test_secrets_and_what_their_contexts_lead_to(spark):
    rows = [(i, f'words before token = "{k}" and words behind') for i, k in enumerate(KEYS)]
    rows += [(10, 'see token = "hunter-two-tree" too'), (11, "hunter-two-tree again, and 04dbebab91ab85687d33eeaaf9ac699e1188f962 bare")]
    rows += [(12, 'class = "main-container-wrapper" id = "release-2024-notes" href="https://a.example/x1234567890"'), (13, "def f(x): return x['some_key_name_1'] == \"abcdefgh\"")]
    rows += [(14, 'a "quoted word" and a 2024-10-11T00 stamp'), (15, "0" * 40), (16, 'n = "' + "a" * 40 + '"')]
    got = found(spark, rows)
    secret, other = spans(got, "secret"), spans(got, "other")
    assert [secret[i] for i in range(4)] == [[k] for k in KEYS] and not any(secret[i] for i in range(10, 17))
    assert other[10] == ["hunter-two-tree"] and other[11] == [KEYS[0]]  # a word without digit or @ is no instance outside quotes
    assert not any(other[i] for i in (0, 1, 2, 3, 12, 13, 14, 15, 16))


def test_phones_and_cards_with_spaces_are_seeds(spark):
    rows = [(i, f"please call phone: +1 (974) 555-34{i}6 soon") for i in range(5)] + [(10 + i, f"paid by card number 4111 1111 1111 {c} today") for i, c in enumerate(("1111", "1129", "1137"))]
    assert all(r for _, _, r in found(spark, rows))
    rows += [(20, "please call phone: ext.5512-9 soon"), (21, "paid by card number AB99-12-77 today"), (22, "phone calls and card number games of 1999-2000")]
    got = found(spark, rows)
    assert spans(got, "other") == {**{i: [] for i, *_ in rows}, 20: ["ext.5512-9"], 21: ["AB99-12-77"]}


def test_counting_in_several_passes(spark, monkeypatch):
    rows = [(i, f"{'x ' * (i % 3)}alpha beta{i % 7} gamma = {i}") for i in range(60)]
    texts = pii.text_of(docs(spark, rows))
    want = Counter()
    for _, t in rows:
        w = pii_tokens(t)
        want.update(tuple(w[i - k : i]) for k in (1, 2, 3) for i in range(k, len(w) + 1))
    from pyspark.sql import functions as F

    keys = spark.createDataFrame([(" ".join(k), len(k)) for k in want], "words string, k int")
    t = F.split("words", " ")
    keys = keys.select("words", F.coalesce(*[F.when(F.col("k") == k, pii._window(t, F.lit(k - 1), k)) for k in (1, 2, 3)]).alias("pattern"))
    for most in (1 << 21, 10):
        monkeypatch.setattr(pii, "PATTERNS_A_PASS", most)
        got = pii.occurrences(texts, keys.select("pattern"), keys.count()).join(keys, "pattern").collect()
        assert {tuple(r["words"].split()): r["total"] for r in got} == want


def pii_tokens(text):
    return re.sub(pii.MARKS, r" \g<0> ", text.lower()).split()


def test_redaction_keeps_the_rest(spark):
    frame = clashing(docs(spark, [(1, "mail a.b@c.de now, 10.0.0.1!"), (1, "mail a.b@c.de now, 10.0.0.1!"), (2, None), (None, "x@y.zz"), (3, "clean 😀 text"), (4, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"')]))
    out = pii.redact(frame)
    assert out.columns == frame.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(0, "<email>"), (1, "mail <email> now, <ip>!"), (1, "mail <email> now, <ip>!"), (2, ""), (3, "clean 😀 text"), (4, 'token = "<secret>"')]


def test_empty(spark):
    assert pii.report(pii.find(docs(spark, []))).count() == 0
    assert pii.redact(docs(spark, [])).count() == 0


def test_hidden_seeds_are_recovered_by_their_contexts(spark):
    """Half of the seeds are hidden; contexts of the others must lead to them, and to nothing else."""
    got = {r["kind"]: r for r in pii.recall(table(spark, "/root/testdata/sf0.1", "documents")).collect()}
    secrets = got["secret"]
    assert secrets["hidden"] >= 40 and secrets["recovered"] >= 0.9 * secrets["hidden"]
    assert "other" not in got or got["other"]["beyond"] <= 2
    assert all(r["recovered"] <= r["hidden"] for r in got.values())
    words = "some words of no use here"
    few = [(i, f"{words} my phone: +1 (974) 555-3{i}16 and {words}") for i in range(16)] + [(50 + i, f"{words} user{i}@mail.example {words}{i}") for i in range(8)]
    got = {r["kind"]: (r["hidden"], r["recovered"]) for r in pii.recall(docs(spark, few)).collect()}
    assert got["phone"][0] == got["phone"][1] > 3
