"""Decontamination against a plain search by edit distance."""

from __future__ import annotations

import random

from helpers import AWKWARD, clashing, docs

from quillon.llm import decontaminate as d
from quillon.llm.common import table

ITEM = "item_id long, text string"


def least_edits(passage, text):
    """Edits of the best place of a passage in a text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(passage):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def norm(text):
    return "".join(map(chr, d.letters(text)[0])).strip()


def test_scan_finds_what_brute_force_finds():
    random.seed(11)
    letters = "abcde fghij "
    items = [(i, "".join(random.choices(letters, k=random.randint(60, 150)))) for i in range(6)]
    p = d.Passages(items, passage=80)
    texts = []
    for _ in range(60):
        x = list(norm(random.choice(items)[1]))
        a = random.randrange(max(1, len(x) - 80))
        x = x[a : a + 80]
        for _ in range(random.randint(0, 6)):
            k = random.randrange(len(x))
            x[k : k + 1] = random.choice([[], [random.choice(letters)], [x[k], random.choice(letters)]])
        texts.append("".join(random.choices(letters, k=random.randint(0, 60))) + "".join(x) + "".join(random.choices(letters, k=random.randint(0, 60))))
    got = {(i, item) for i, item, *_ in d.scan_texts(p, list(range(len(texts))), texts)}
    want = {(i, p.item[k]) for i, t in enumerate(texts) for k, c in enumerate(p.code) if least_edits("".join(map(chr, c)), norm(t)) <= p.budget[k]}
    assert got == want and len(want) > 15


def test_planted_and_clean(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").collect()
    known = [r for r in table(spark, sf_dir, "documents").collect()]
    rows = AWKWARD + [(r["doc_id"] + 1000, r["text"]) for r in known] + [(9000, "word " * 100 + items[0]["text"].upper().replace(" ", " \n") + " end"), (9001, None), (9002, items[1]["text"][:40])]
    frame, bench = clashing(docs(spark, rows)), spark.createDataFrame([(r["item_id"], r["text"]) for r in items] + [(77_000, None), (None, ""), (77_001, "short")], ITEM)
    got = d.matches(frame, bench).collect()
    want = {(i, r["item_id"]) for i, t in rows for r in items if norm(r["text"]) in norm(t or "")}
    assert want <= {(r["doc_id"], r["item_id"]) for r in got}
    assert all(r["edits"] > 0 for r in got if (r["doc_id"], r["item_id"]) not in want)
    text = dict(rows)
    for r in got:
        assert norm(text[r["doc_id"]][r["start"] : r["end"]]) in norm(next(x["text"] for x in items if x["item_id"] == r["item_id"])) or r["edits"]
    cleaned = d.clean(frame, bench)
    assert cleaned.columns == frame.columns and cleaned.count() == len(rows) - sum(i in {r["doc_id"] for r in got} for i, _ in rows)


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "some benchmark passage of a good length, longer than nine letters")], ITEM)
    assert d.matches(docs(spark, []), bench).count() == 0
    assert d.matches(docs(spark, AWKWARD), bench.where("false")).count() == 0


def test_long_texts_are_scanned_in_overlapping_parts(monkeypatch):
    monkeypatch.setattr(d, "SCAN", 1000)
    p = d.Passages([(1, "the quick brown fox jumps over the lazy dog and runs away from the angry farmer's wife")])
    for at in (0, 900, 985, 1000, 1500):
        text = "x1 " * (at // 3) + "the quick brown fox jumps over the lazy dog, and runs away from the angry farmer's wife" + " y2" * 500
        assert len(d.scan_texts(p, [5], [text])) == 1


def test_excerpts_of_all_offsets_and_regions():
    random.seed(3)
    word = lambda: "".join(random.choices("abcdefghijklmnop", k=random.randint(2, 9)))
    item, other = (norm(" ".join(word() for _ in range(60)))[:224] for _ in range(2))
    p = d.Passages([(1, item), (2, other)])
    filler = " ".join(word() for _ in range(30))
    excerpts = [item[a : a + 60] for a in range(len(item) - 59)]
    got = {i for i, k, *_ in d.scan_texts(p, list(range(len(excerpts))), [f"{filler} {x} {filler}" for x in excerpts]) if k == 1}
    assert got == set(range(len(excerpts)))
    rows = d.scan_texts(p, [0], [f"{item[20:90]} {filler} {filler} {item[100:170]} {filler}"])
    assert len(rows) == 2 and rows[0][3] < rows[1][2]


def test_items_with_changed_words():
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefghijklmnop", k=random.randint(2, 9)))
    items, texts = [], []
    for i in range(200):
        w = [word() for _ in range(37)]
        items.append((i, " ".join(w)))
        for k in random.sample(range(37), 4):
            w[k] = word()
        texts.append(" ".join([word() for _ in range(20)] + w + [word() for _ in range(20)]))
    got = {(i, k) for i, k, *_ in d.scan_texts(d.Passages(items), list(range(200)), texts)}
    assert all(i == k for i, k in got) and len(got) >= 196
