"""Evaluation items leaking into training text: a BM25 index of the items, searched by every passage with block-max WAND.

Index: each field of an item (question, answer) is one entry. A term's weight in an entry is its BM25 weight divided by the
entry's threshold, which is the least BM25 score any run of `RUN` of its words can have. A passage that holds such a run
therefore scores at least 1, and everything that scores at least 1 is retrieved: the search loses nothing.

Search: every document is cut into passages of 2*RUN words that overlap by RUN, so each run lies wholly in one of them.
A passage whose terms' greatest weights can't sum up to 1 is skipped (all passages of a document at once). The others are
searched with block-max WAND: entries are numbered in blocks, each list has the greatest weight of every block, and only in
blocks where these upper bounds sum up to 1 postings are read and scored. Bounds and scores are taken over whole
arrays, not pivot by pivot.

Verification: the words of a retrieved passage must share a run of RUN consecutive words with the entry. Runs are found
by their hashes and compared word by word.

The index is built from the items only, on the driver, and the arrays are sent to the executors, in shards of at most
`SHARD_TERMS` postings; more items mean more shards, each searched in turn. The corpus is read once per shard and is not shuffled.
"""

from __future__ import annotations

import html
import math
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame

#: Consecutive words that make a leak.
RUN = 12
#: BM25 parameters.
K1, B = 1.2, 0.75
#: Entries in a block.
BLOCK = 16
#: Postings in a shard of the index (about 100 bytes each on an executor).
SHARD_TERMS = 2_000_000

_TAG = regex.compile(r"<!--|-->|</?[a-zA-Z][a-zA-Z0-9]*(?:\s+[a-zA-Z-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>]+))?)*\s*/?>")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_MARK = regex.compile(r"\p{M}+")
_HIDDEN = regex.compile("[­​-‏⁠﻿]")


def words(text: str | None) -> list[str]:
    """Runs of letters or digits, without case and accents; tags, entities and other markup are no words. None has no words."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
        if "<" in text:
            text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFKD", _HIDDEN.sub("", text)))
    return _WORD.findall(text.lower())


def _window_hashes(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of RUN numbers."""
    if len(ids) < RUN:
        return np.zeros(0, dtype=np.uint64)
    factors = np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, RUN + 1, dtype=np.uint64)
    return (np.lib.stride_tricks.sliding_window_view(ids.astype(np.uint64) + np.uint64(1), RUN) * factors).sum(axis=1, dtype=np.uint64)


class Index:
    """Block-max inverted index of entries (item, field, words)."""

    def __init__(self, entries: list[tuple[int, str, list[str]]]) -> None:
        self.entries = [(i, f) for i, f, _ in entries]
        self.vocabulary: dict[str, int] = {}
        ids = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for _, _, ws in entries]
        n, mean = len(entries), sum(map(len, ids)) / max(1, len(entries))
        df = Counter(t for x in ids for t in set(x))
        idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
        lists: dict[int, list[tuple[int, float]]] = {t: [] for t in df}
        self.ids = [np.array(x, dtype=np.int64) for x in ids]
        self.runs = [np.unique(_window_hashes(x)) for x in self.ids]
        for e, x in enumerate(ids):
            weight = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(x) / mean)) for t, c in Counter(x).items()}
            windows = [x[k : k + RUN] for k in range(len(x) - RUN + 1)]
            least = min((sum(weight[t] for t in set(w)) for w in windows), default=0.0)
            if least > 0:
                for t, w in weight.items():
                    lists[t].append((e, w / least * (1 + 1e-9)))
        terms = len(self.vocabulary)
        self.docs = [np.array([e for e, _ in lists[t]], dtype=np.int64) for t in range(terms)]
        self.weights = [np.array([w for _, w in lists[t]]) for t in range(terms)]
        # The blocks of each list, and its greatest weight in each.
        self.blocks = [np.unique(d // BLOCK) for d in self.docs]
        self.greatest_in = [np.array([w[d // BLOCK == k].max() for k in b]) for d, w, b in zip(self.docs, self.weights, self.blocks, strict=True)]
        self.greatest = np.array([w.max() if len(w) else 0.0 for w in self.weights] + [0.0])

    def search(self, terms: Iterable[int]) -> list[tuple[int, float]]:
        """Entries that score at least 1 for a set of terms, with their scores: block-max WAND over all postings lists."""
        terms = [t for t in terms if len(self.docs[t])]
        if not terms:
            return []
        bounds = np.bincount(np.concatenate([self.blocks[t] for t in terms]), np.concatenate([self.greatest_in[t] for t in terms]), len(self.entries) // BLOCK + 1)
        live = bounds >= 1
        if not live.any():
            return []
        docs, weights = np.concatenate([self.docs[t] for t in terms]), np.concatenate([self.weights[t] for t in terms])
        if not live.all():
            kept = live[docs // BLOCK]
            docs, weights = docs[kept], weights[kept]
        scores = np.bincount(docs, weights)
        return [(int(e), float(scores[e])) for e in np.flatnonzero(scores >= 1)]

    def leaks(self, text: str | None) -> dict[tuple[int, str], int]:
        """For a document: (item, field) with a common run, and the words of the longest one."""
        ws = words(text)
        if len(ws) < RUN:
            return {}
        get, none = self.vocabulary.get, len(self.vocabulary)
        seq = np.fromiter((get(w, none) for w in ws), dtype=np.int64, count=len(ws))
        bounds = np.concatenate([[0.0], np.cumsum(self.greatest[seq])])
        starts = np.arange(0, max(1, len(seq) - RUN + 1), RUN)
        stops = np.minimum(starts + 2 * RUN, len(seq))
        # Repeated terms count twice here, so this bound is never below the one of the set.
        possible = np.flatnonzero(bounds[stops] - bounds[starts] >= 1)
        if not len(possible):
            return {}
        hashes = _window_hashes(seq)
        found: dict[tuple[int, str], int] = {}
        for start, stop in zip(starts[possible].tolist(), stops[possible].tolist(), strict=True):
            terms = set(seq[start:stop].tolist()) - {none}
            for e, _ in self.search(terms):
                if self.entries[e] not in found and self._common(seq, hashes[start : stop - RUN + 1], start, e):
                    found[self.entries[e]] = e
        return {key: self._longest(seq.tolist(), self.ids[e].tolist()) for key, e in found.items()}

    def _common(self, seq: np.ndarray, hashes: np.ndarray, start: int, e: int) -> bool:
        """Whether a window of the passage (its hashes, from `start` on) is a run of entry e."""
        for k in np.flatnonzero(np.isin(hashes, self.runs[e])).tolist():
            window, ids = seq[start + k : start + k + RUN], self.ids[e]
            if (np.lib.stride_tricks.sliding_window_view(ids, RUN) == window).all(axis=1).any():
                return True
        return False

    @staticmethod
    def _longest(a: list[int], b: list[int]) -> int:
        """Words of the longest common run; computed for verified pairs only."""
        where: dict[int, list[int]] = {}
        for j, t in enumerate(b):
            where.setdefault(t, []).append(j)
        best, before = 0, {}
        for t in a:
            now = {j: before.get(j - 1, 0) + 1 for j in where.get(t, ())}
            best = max(best, *now.values()) if now else best
            before = now
        return best


def shards(items: Iterable[tuple[int, dict[str, str | None]]], limit: int = SHARD_TERMS) -> Iterator[list[tuple[int, str, list[str]]]]:
    """Entries of at least RUN words, in shards of at most `limit` postings."""
    shard: list[tuple[int, str, list[str]]] = []
    size = 0
    for item, fields in items:
        for field, text in fields.items():
            ws = words(text)
            if len(ws) < RUN:
                continue
            if shard and size + len(set(ws)) > limit:
                yield shard
                shard, size = [], 0
            shard.append((item, field, ws))
            size += len(set(ws))
    if shard:
        yield shard


def leaked(documents: DataFrame, items: DataFrame, fields: tuple[str, ...] = ("prompt", "answer"), text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, field, run): every document with every item field of which it holds RUN consecutive words.

    `run` is the length of the longest common run of words. Nulls and texts under RUN words leak nothing; texts are read whole.
    Repeated rows give repeated results. Items are streamed to the driver shard by shard and never held as a whole.
    """
    spark = documents.sparkSession
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the executors need not have this package
    schema = f"{doc_id} bigint, {item_id} bigint, field string, run int"
    docs = documents.select(doc_id, text)
    rows = ((r[0], dict(zip(fields, r[1:], strict=True))) for r in items.select(item_id, *fields).toLocalIterator())
    out: DataFrame | None = None
    for shard in shards(rows):
        index = spark.sparkContext.broadcast(Index(shard))

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            built = index.value
            for batch in batches:
                hits = [(d, i, f, n) for d, t in zip(batch[doc_id], batch[text], strict=True) for (i, f), n in built.leaks(t).items()]
                yield pd.DataFrame(hits, columns=[doc_id, item_id, "field", "run"])

        part = docs.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out
