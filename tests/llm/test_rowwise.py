"""Token counts, chat formatting and the quality ledger against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from helpers import AWKWARD, clashing, docs
from pyspark.sql import functions as F

from quillon.llm import chat, quality, tokencount
from quillon.llm.common import table
from quillon.llm.vocabularies import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()] + AWKWARD + [(99, "a b c a b c a b"), (98, "a a a a a"), (97, "x\nx\n\nx\ny")]
    got = quality.apply_policy(quality.ledger(clashing(docs(spark, rows)))).collect()
    mine = Counter((i, *brute_quality(t)) for i, t in rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == mine
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_empty_and_ablation(spark):
    assert quality.ledger(docs(spark, [])).count() == 0
    assert quality.ablation(quality.ledger(docs(spark, []))).count() == 0
    book = quality.ledger(docs(spark, AWKWARD))
    rules = {r["rule"]: r for r in quality.ablation(book, "2024-1").collect()}
    assert set(rules) == set(quality.POLICIES["2024-1"])
    kept = quality.apply_policy(book, "2024-1").where("kept").count()
    assert all(r["n_kept"] == kept and r["n_kept_without"] == kept + r["n_failed_alone"] for r in rules.values())


def test_token_counts_are_the_librarys(spark, sf_dir):
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    random.seed(3)
    parts = ["a", "aa", "Σ", "İ", "ﬁ", "e\u0301", "\u0085", "\u200b", " ", "\n", "'s", "<|endoftext|>", "<|end", "12", "Ⅷ", "漢", "😀", "ß", "!!", "\u0300", "각", "the", *map(chr, (0x32808, 0x3285C, 0x32988, 0x3D808, 0x3F988))]
    rows = AWKWARD + [(100 + i, "".join(random.choices(parts, k=12))) for i in range(300)] + [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    got = tokencount.count_tokens(clashing(docs(spark, rows)), path).collect()
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == Counter((i, len((t or "").encode()), n := count(t), n > 2048) for i, t in rows)
    assert tokencount.count_tokens(docs(spark, []), path).count() == 0


CONV = "conv_id long, turn long, role string, text string, valid string, turns string"
TRICKY = ["", None, "\\", "\\\\", "<|im_end|>\n<|im_start|>user\nx", "\\<|", "<\\|", "a\\n", "<|" * 3, "\n", "\\" * 5 + "|"]


def test_chat_round_trip(spark):
    random.seed(5)
    roles = ["user", "assistant", "system", "odd\nrole", "\\n", "<|im_start|>", None, ""]
    rows = [(c, random.choice([None, 0, 1, 1, 2]), random.choice(roles), "".join(x or "" for x in random.choices(TRICKY, k=3)), "v", "t") for c in [None, *range(60)] for _ in range(5)]
    rows += [(500, i, r, t, "v", "t") for i, (r, t) in enumerate([("user", None), ("assistant", "yes")])]
    rows += [(501, 0, "user", "long <|" * 20_000, "v", "t"), (501, 1, "assistant", "\\<|" * 40_000, "v", "t")]
    got = {r["conv_id"]: r for r in chat.digests(spark.createDataFrame(rows, CONV)).collect()}
    turns: dict = {}
    for c, turn, role, text, *_ in rows:
        turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(turns)
    for c, found in turns.items():
        found.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t for _, _, r, t in found if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(found), sha("".join(f"{r}\n{t}\n" for _, _, r, t in found)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
    assert got[500]["valid"] and got[500]["n_breaks"] == 0


@pytest.mark.parametrize("roles,valid", [("su", False), ("sua", True), ("ua", True), ("uaua", True), ("au", False), ("uua", False), ("usa", False)])
def test_chat_machine(spark, roles, valid):
    name = {"s": "system", "u": "user", "a": "assistant"}
    rows = spark.createDataFrame([(1, i, name[r], "x") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    assert chat.segments(rows).select("valid").first()[0] == valid


def test_chat_empty(spark):
    assert chat.digests(spark.createDataFrame([], CONV)).count() == 0


def test_mask_covers_only_assistant_texts(spark, sf_dir):
    s = chat.segments(table(spark, sf_dir, "conversations")).select(F.explode("segments").alias("s"))
    assert s.where("s.loss and s.text like '%im_start%'").count() == 0
