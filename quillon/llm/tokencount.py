"""Token counts of a BPE vocabulary by rank-synchronous merging in numpy.

A batch's distinct pre-tokens are one ragged array of symbols. In each round every pre-token finds
its lowest-ranked adjacent pair and merges all its occurrences, left to right; pre-tokens without a
mergeable pair leave the array. What survives is the count. As each token of the vocabulary comes from one
merge of tokens that earlier merges made (checked on loading), merging all of a pair at once gives
what merging one at a time gives.

Texts are taken in chunks of ``CHUNK_BYTES``; counts of pre-tokens already seen stay in a cache of at
most ``CACHE_WORDS`` short entries a worker, which changes the speed alone. Rows are independent:
no shuffle, nothing broadcast but the vocabulary's path.

Defined cases: null text has no bytes and no tokens; null ids, repeated rows and empty tables pass
through row by row; other columns are ignored; very long texts are counted whole, in memory linear in their length.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import text_of

CHUNK_BYTES = 1 << 20
CACHE_WORDS = 400_000
#: What the vocabulary's own file says; `load` refuses one that says something else.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Unassigned code points that are letters to the regular expressions here and not to the library's.
NO_LETTERS = [block + x for block in (0x32000, 0x3D000, 0x3E000, 0x3F000) for x in (0x808, 0x85C, 0x988)]


class Vocabulary:
    """Merges as sorted pair keys, and symbols of bytes inside and at the end of a pre-token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, ids = data["model"], data["model"]["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        split = data["pre_tokenizer"]["pretokenizers"][0]
        if split["pattern"]["Regex"] != SPLIT or [n["type"] for n in data["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: not the normalisation and splitting that this counter knows")
        shown = byte_letters()
        self.inner = np.array([ids[x] for x in shown])
        self.last = np.array([ids[x + suffix] for x in shown])
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges])
        right = np.array([ids[b] for _, b in merges])
        made = np.array([ids[a + b] for a, b in merges])
        born = np.full(max(ids.values()) + 1, -1)
        if len(np.unique(made)) != len(made):
            raise ValueError(f"{path}: a token comes from two merges")
        born[made] = np.arange(len(made))
        if (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError(f"{path}: a merge stands before one that it needs")
        self.width = len(born) + 1
        keys = left * self.width + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order, made
        special = [t["content"] for t in data["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(SPLIT)
        odd = "".join(map(chr, NO_LETTERS))
        self.odd = re.compile(f"[{odd[0]}-{odd[-1]}]")
        self.split_odd = regex.compile("(?V1)" + SPLIT.replace(r"[\p{L}]", rf"[\p{{L}}--[{odd}]]").replace(r"[^\s\p{L}\p{N}]", rf"[^\s\p{{N}}[\p{{L}}--[{odd}]]]"))
        self.cache: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; the number of merges where there is none."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.made))

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each (non-empty) pre-token."""
        none = len(self.made)
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(size) - 1
        symbol = self.inner[raw]
        symbol[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(words)), size)
        out = np.ones(len(words), np.int64)
        while len(symbol):
            pair = np.full(len(symbol), none)  # the rank of a symbol with the next of its pre-token
            same = owner[1:] == owner[:-1]
            pair[:-1][same] = self.rank(symbol[:-1][same], symbol[1:][same])
            first = np.flatnonzero(np.r_[True, ~same])
            least = np.minimum.reduceat(pair, first)
            length = np.diff(np.r_[first, len(symbol)])
            out[owner[first]] = length
            live = np.repeat(least < none, length)
            hit = live & (pair == np.repeat(least, length))
            # of a run of overlapping hits (aaa), the 1st, 3rd, ... merge
            at = np.flatnonzero(hit)
            start = np.r_[True, np.diff(at) > 1]
            run = np.arange(len(at)) - np.flatnonzero(start)[np.cumsum(start) - 1] if len(at) else at
            at = at[run % 2 == 0]
            symbol[at] = self.made[pair[at]]
            stay = live
            stay[at + 1] = False
            symbol, owner = symbol[stay], owner[stay]
        return out

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        split, cache, out, missing = self.split.findall, self.cache, [], set()
        parts: list[tuple[int, list[str]]] = []
        for text in texts:
            pieces, specials = [text], 0
            if self.special and "<|" in text:
                pieces = self.special.split(text)
                specials = len(pieces) - 1
            found: list[str] = []
            for piece in pieces:
                by = split
                if not piece.isascii():
                    piece = unicodedata.normalize("NFC", piece)
                    if self.odd.search(piece):
                        by = self.split_odd.findall
                found += by(lower(piece))
            parts.append((specials, found))
            missing.update(found)
        missing.difference_update(cache)
        if missing:
            if len(cache) + len(missing) > CACHE_WORDS:
                cache.clear()
                missing = {w for _, found in parts for w in found}
            todo = list(missing)
            cache.update(zip(todo, self.counts([w.encode() for w in todo]).tolist(), strict=True))
        for specials, found in parts:
            out.append(specials + sum(map(cache.__getitem__, found)))
        for w in missing:
            if len(w) > 64:  # long ones are rare and large
                del cache[w]
        return out


#: Letters whose lower case this Python's Unicode tables lack.
NEWER_LOWER = {0xA7CB: "\u0264", 0xA7DC: "\u019b"}


def lower(text: str) -> str:
    """Lower case letter by letter, without the rule for a final sigma."""
    if text.isascii():
        return text.lower()
    text = text.translate(NEWER_LOWER)
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next free one from 256."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """A worker's vocabulary."""
    return Vocabulary(path)


def chunks(texts: list[str], limit: int = CHUNK_BYTES):
    """Index ranges of about ``limit`` characters each, one text at least."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def column_chunks(column, limit: int = CHUNK_BYTES):
    """Like ``chunks`` for an Arrow column of texts, by bytes, without making Python strings of it."""
    import pyarrow.compute as pc

    total = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(total):
        end = int(np.searchsorted(total, (total[start - 1] if start else 0) + limit)) + 1
        yield start, min(end, len(total))
        start = end


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row."""

    def run(batches):
        import pyarrow as pa

        vocabulary = load(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found: list[int] = []
            for a, b in chunks(texts):
                found += vocabulary.count_texts(texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = text_of(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
