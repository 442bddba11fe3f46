"""Secrets: base spans against plain patterns, ownership on planted values."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from helpers import AWKWARD, clashing, docs

from quillon.llm import secrets
from quillon.llm.common import table

PLAIN = {"assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
LEAST = {"access": 18, "hex": 16}
DOCS = "doc_id long, text string, source string, repo string"


def brute(text):
    out = []
    for place, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text, re.IGNORECASE | re.ASCII if kind == "assign" else 0):
            if len(m[2]) >= 12 if kind == "assign" else len(m[0]) >= LEAST[kind]:
                out.append((m.start(), place, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


shown = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_against_plain_patterns(spark, sf_dir):
    random.seed(8)
    parts = ["password", "PassWd", "api_key", "APIKEY", "token", "secret", "=", ":", " ", '"', "'", "abcdef012345", "AKIA", "ABCDEFGH", "0123456789", "f", "é", "😀", ".", "-", "Z9", "\n"]
    rows = AWKWARD + [(100 + i, "".join(random.choices(parts, k=16))) for i in range(800)]
    rows += [(2000, "token" * 9000), (2001, "f" * 50_000), (2002, "AKIA" * 9000), (2003, "token = " * 9000), (2004, "ſecret = abcdefabcdef12"), (2005, "toKen=abcdefabcdef12")]
    rows += [(5000 + r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    got = secrets.report(secrets.find(clashing(docs(spark, rows)))).collect()
    want = Counter()
    for i, t in rows:
        spans = brute(t or "")
        n = Counter(k for k, *_ in spans)
        want[(i, *(n[k] for k in secrets.KINDS), hashlib.sha256(shown(spans).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    text = dict(rows)
    for r in got:  # base spans stay
        assert set(filter(None, shown(brute(text[r["doc_id"]] or "")).split(","))) <= set(r["spans"].split(","))


def test_ownership_tells_copied_from_live(spark):
    copied, live, shared, dull, upper = "f3a91bc07de2485961aa03bc77d5e210", "9c8b4543d718dcc700c184a7e303cdc6", "0a1b2c3d4e5f60718293a4b5c6d7e8f9", "a1a1a1a1a1a1a1a1", "7F3KQ9ZX2MP8LD4WB6"
    rows = [(i, f'the token = "{copied}" of the manual', f"s{i % 9}", f"r{i}") for i in range(60)]
    rows += [(100 + i, f"key {live} here", "s1", f"r{i % 4}") for i in range(10)]
    rows += [(200 + i, f"key {shared} here", f"o{i}", "r") for i in range(3)] + [(300, f"pad {dull} x", "s1", "r"), (301, f"bare {upper} and {upper}", "s2", None), (302, "bare Example7F3KQ9ZX2MP8LD4WB6", None, "q"), (303, f"{upper}", "s3", "q")]
    rows += [(400 + i, f"old {upper[::-1]} too", f"s{i}", "r") for i in range(4)] + [(500, None, None, None)]
    d = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in secrets.report(secrets.find(d, repo_col="repo")).collect()}
    assert all((got[i]["n_live"], got[i]["n_copied"]) == (0, 2) for i in range(60))  # an assign and a hex span
    assert all((got[100 + i]["n_live"], got[100 + i]["live_repos"], got[100 + i]["live_owners"]) == (1, 4, 1) for i in range(10))
    assert all((got[200 + i]["n_live"], got[200 + i]["live_owners"]) == (1, 3) for i in range(3))
    assert got[300]["n_hex"] == 1 and got[300]["n_live"] == 0 and got[300]["n_copied"] == 0
    assert got[301]["spans"] == "live:5:23,live:28:46" and got[303]["spans"] == "live:0:18"
    assert got[302]["spans"] == "" and all(got[400 + i]["spans"] == "" and got[400 + i]["n_copied"] == 1 for i in range(4))
    assert got[500]["spans"] == ""
    verdicts = {r["places"]: (r["owners"], r["repos"], r["verdict"]) for r in secrets.ownership(secrets.written(secrets.scanned(d, repo_col="repo"), "t")).collect()}
    assert verdicts[120] == (9, 60, "copied") and verdicts[10] == (1, 4, "live")


def test_empty_table(spark):
    assert not secrets.report(secrets.find(spark.createDataFrame([], DOCS))).collect()
