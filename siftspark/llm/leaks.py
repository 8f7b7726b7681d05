"""Evaluation passages in training text, found by greedy string tiling.

Words of seed runs shared with a passage join documents to items; each joined pair is tiled: the longest
common run of unmarked words, found by running Karp-Rabin hashes, is marked again and again until none reaches the
minimal length. The share of the passage under tiles catches passages whose sentences were reordered.

The passages are a stated query set. They are taken in blocks of at most BLOCK_WORDS words; each block's seeds
go to the executors and all documents are read once against them, so the corpus is never shuffled.

Defined cases: a word is a longest run of letters and digits, in lower case; null, empty and wordless texts and
passages match nothing; items with equal passages are each reported; a document with several items gives one row
per item; a passage shorter than the minimal run is never found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
SEED_WORDS = 5
MIN_RUN = 10
BLOCK_WORDS = 2_000_000
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


_powers: dict[str, np.ndarray] = {}


def _power(name: str, n: int) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2^64."""
    if len(_powers.get(name, ())) < n:
        base = _BASE if name == "up" else pow(_BASE, -1, 1 << 64)
        full = np.full(max(n, 4096), base, np.uint64)
        full[0] = 1
        _powers[name] = np.cumprod(full)
    return _powers[name][:n]


class Runs:
    """Running hashes: prefix sums give the hash of any run of words in one step, whatever its length."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((ids + 1).astype(np.uint64) * _power("up", self.n))])

    def __call__(self, length: int) -> np.ndarray:
        """Hash of every run of that length."""
        if length > self.n:
            return np.empty(0, np.uint64)
        return (self.upto[length:] - self.upto[: self.n + 1 - length]) * _power("down", self.n + 1 - length)


def tiles(doc: np.ndarray, passage: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word-id arrays: (passage start, doc start, length), longest first.

    Word ids below 0 stand for words outside the passages and match nothing.
    """
    free_p, free_d = np.ones(len(passage), bool), doc >= 0
    runs_p, runs_d = Runs(passage), Runs(doc)
    out: list[tuple[int, int, int]] = []

    def clear(free: np.ndarray, n: int) -> np.ndarray:
        full = np.concatenate([[0], np.cumsum(free)])
        return np.flatnonzero(full[n:] - full[:-n] == n) if len(full) > n else np.empty(0, int)

    def common(n: int) -> tuple[np.ndarray, ...] | None:
        """Starts in passage and document of unmarked runs of n words that occur in both, and their hashes."""
        ps, ds = clear(free_p, n), clear(free_d, n)
        if not len(ps) or not len(ds):
            return None
        hp, hd = runs_p(n)[ps], runs_d(n)[ds]
        in_d, in_p = np.isin(hp, hd), np.isin(hd, hp)
        return (ps[in_d], hp[in_d], ds[in_p], hd[in_p]) if in_p.any() else None

    top = len(passage)
    while True:
        lo, hi, best, n = least, min(top, int(free_p.sum()), int(free_d.sum())), None, 0
        while lo <= hi:  # the longest length at which a common run exists
            mid = lo if best is None and lo == least else (lo + hi + 1) // 2
            found = common(mid)
            if found:
                best, n, lo = found, mid, mid + 1
            else:
                hi = mid - 1
        if best is None:
            return out
        starts: dict[int, list[int]] = {}
        for p, h in zip(best[0][::-1].tolist(), best[1][::-1].tolist()):
            starts.setdefault(h, []).append(p)
        for d, h in zip(best[2].tolist(), best[3].tolist()):
            left = starts[h]
            while left and not free_p[left[-1] : left[-1] + n].all():
                left.pop()  # once marked, never free again
            if left and free_d[d : d + n].all() and np.array_equal(passage[left[-1] : left[-1] + n], doc[d : d + n]):
                p = left.pop()
                free_p[p : p + n] = False
                free_d[d : d + n] = False
                out.append((p, d, n))
        top = n - 1 if not out or out[-1][2] != n else n


class Block:
    """Seeds of some passages, ready for a pass over documents."""

    def __init__(self, items: list[tuple[int, str]], seed: int):
        self.seed, self.vocab = seed, {}
        self.passages: list[np.ndarray] = []
        self.ids = [i for i, _ in items]
        hashes, owners = [], []
        for k, (_, text) in enumerate(items):
            ids = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words(text)], np.int64)
            self.passages.append(ids)
            h = np.unique(Runs(ids)(seed))
            hashes.append(h)
            owners.append(np.full(len(h), k))
        h, o = np.concatenate(hashes or [np.empty(0, np.uint64)]), np.concatenate(owners or [np.empty(0, int)])
        order = np.argsort(h, kind="stable")
        self.hashes, self.owners = h[order], o[order]

    def candidates(self, text: str) -> tuple[np.ndarray, list[int]]:
        get = self.vocab.get
        doc = np.array([get(w, -1) for w in words(text)], np.int64)
        if len(doc) < self.seed or (doc >= 0).sum() < self.seed:
            return doc, []
        h = Runs(doc)(self.seed)
        known = np.concatenate([[0], np.cumsum(doc >= 0)])
        h = np.unique(h[known[self.seed :] - known[: -self.seed] == self.seed])
        left, right = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        got = set()
        for a, b in zip(left[right > left].tolist(), right[right > left].tolist()):
            got.update(self.owners[a:b].tolist())
        return doc, sorted(got)


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The stated query set, in blocks of bounded size, one block on the driver at a time."""
    rows, size = [], 0
    for r in items.select("item_id", "passage").where("passage is not null").toLocalIterator():
        rows.append((r.item_id, r.passage))
        size += len(r.passage) // 2 + 1
        if size > block_words:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def leaks(docs: DataFrame, items: DataFrame, seed: int = SEED_WORDS, least: int = SEED_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, longest (words of the longest tile), covered (words under tiles), coverage."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    schema = "doc_id long, item_id long, longest int, covered int, coverage double"
    out = spark.createDataFrame([], schema)
    for rows in _blocks(items, block_words):
        shared = spark.sparkContext.broadcast(Block(rows, seed))  # at most block_words words

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for b in batches:
                got: list[tuple] = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    doc, items = block.candidates(text)
                    for k in items:
                        passage = block.passages[k]
                        if found := tiles(doc, passage, least):
                            covered = sum(n for *_, n in found)
                            got.append((doc_id, block.ids[k], found[0][2], covered, round(covered / len(passage), 6)))
                cols = list(zip(*got)) if got else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))], ["doc_id", "item_id", "longest", "covered", "coverage"])

        out = out.unionByName(texts.mapInArrow(scan, schema))
    return out.dropDuplicates(["doc_id", "item_id"])


def leaked(docs: DataFrame, items: DataFrame, run: int = MIN_RUN, coverage: float | None = None) -> DataFrame:
    """Pairs with a tile of at least `run` words, or, if a coverage is given, with that much of the passage."""
    hit = F.col("longest") >= run
    if coverage is not None:
        hit = hit | (F.col("coverage") >= coverage)
    return leaks(docs, items).where(hit)
