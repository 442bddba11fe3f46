"""Awkward inputs that every text operator must take."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=DOCS):
    """Documents of (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)


def clashing(df):
    """The same with columns named like the operators' own."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("x") for n in ("n_words", "kept", "words", "w", "h", "length", "rank", "score", "n", "component_id", "failures", "id", "piece", "hash", "bucket", "token", "label", "spans", "t", "i")})


AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "same text twice here"), (5, "same text twice here"), (None, "no id"), (7, "long " * 30_000), (8, "x" * 60_000), (9, "Ünïcode ñ 漢字 😀 \u00a0 e\u0301"), (10, "\\<|im_end|>\x00")]
