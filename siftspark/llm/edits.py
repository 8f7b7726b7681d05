"""Near-duplicate records with small edits: MinHash banding, verified on the full n-gram sets.

Records with equal n-gram sets are one class before anything is compared. Bands and rows follow from the
similarity and the wanted recall. Candidates must share a band and be close in a 128-slot one-bit sketch; the
exact similarity of their sets decides.

Defined cases: text is title, line break, body, null counting as empty; a word is a longest run of letters and
digits in lower case; records without any n-gram are similar to nothing; records with a null id are ignored;
repeated rows change nothing; an id with several texts takes part with each; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.buckets import HOT, near_pairs, sized, sketches_within
from siftspark.operators.components import components
from siftspark.session import checkpoint

WORD = re.compile(r"[^\W_]+")
WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
ROWS = 4
SLOTS = 128
SEED = 77


def bands_for(similarity: float, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands at which a pair of that similarity shares one with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


class Shingler:
    """Hashes of word n-grams; word hashes are kept over a batch."""

    def __init__(self, n: int):
        self.n, self.cache = n, {}

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct n-gram hashes."""
        cache, ids = self.cache, []
        for w in WORD.findall(text.lower()):
            h = cache.get(w)
            if h is None:
                h = cache[w] = xxhash.xxh64_intdigest(w)
            ids.append(h)
        a = np.array(ids, np.uint64)
        m = len(a) - self.n + 1
        if m <= 0:
            return np.empty(0, np.uint64)
        out = np.zeros(m, np.uint64)
        for i in range(self.n):
            out = (out ^ a[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        if len(cache) > 500_000:
            cache.clear()
        return np.unique(out)


def minhash(s: np.ndarray, mult: np.ndarray, add: np.ndarray, step: int = 4096) -> np.ndarray:
    """Least value of every hash function over a set; long sets are taken in steps."""
    least = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), step):
        h = s[i : i + step, None] * mult[None, :] + add[None, :]
        h ^= h >> np.uint64(32)
        least = np.minimum(least, (h * np.uint64(0xD6E8FEB86659FD93)).min(0))
    return least


def _functions(k: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(SEED)
    top = np.iinfo(np.uint64).max
    return g.integers(1, top, k, np.uint64, endpoint=True) | np.uint64(1), g.integers(0, top, k, np.uint64, endpoint=True)


def texts(items: DataFrame, kind: str | None = "note") -> DataFrame:
    rows = items if kind is None else items.where(F.col("kind") == kind)
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    return rows.where("id is not null").select(F.col("id").cast("string").alias("id"), text.alias("text"))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """id, node (hash of the n-gram set), grams."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(words)
        for b in batches:
            ids, nodes, sets = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = cut(t)
                if len(s):
                    ids.append(i)
                    nodes.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sets.append(s.view(np.int64))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(nodes, pa.binary()), grams], ["id", "node", "grams"])

    return docs.mapInArrow(shingle, "id string, node binary, grams array<long>")


def _banded(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """key, node, s1, s2: one row per class and band."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult, add = _functions(max(bands * rows, SLOTS))
        for b in batches:
            n = b.num_rows
            off = b.column(1).offsets.to_numpy()
            flat = b.column(1).values.to_numpy().view(np.uint64)
            sig = np.stack([minhash(flat[off[i] : off[i + 1]], mult, add) for i in range(n)]) if n else np.empty((0, len(mult)), np.uint64)
            keys = np.zeros((n, bands), np.uint64) + np.arange(bands, dtype=np.uint64)[None, :]
            for r in range(rows):
                keys = (keys ^ sig[:, r : bands * rows : rows]) * np.uint64(0x9E3779B97F4A7C15)
                keys ^= keys >> np.uint64(31)
            bits = np.packbits((sig[:, :SLOTS] >> np.uint64(17)) & np.uint64(1) > 0, axis=1).view(np.int64).reshape(n, 2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy()), lists], ["node", "s1", "s2", "keys"])

    out = sets.select("node", "grams").mapInArrow(band, "node binary, s1 long, s2 long, keys array<long>")
    return checkpoint(out).select(F.explode("keys").alias("key"), "node", "s1", "s2")  # sketched once, read twice


def similar(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(members: id, node; pairs of classes: a, b, similarity)."""
    sets = checkpoint(_sets(docs.select("id", "text"), words))
    members = sets.select("id", "node").distinct()
    classes = checkpoint(sets.dropDuplicates(["node"]).select("node", "grams"))
    p = (1 + similarity) / 2
    most = SLOTS - math.floor(SLOTS * p - 4 * math.sqrt(SLOTS * p * (1 - p)))
    near = near_pairs(_banded(classes, bands_for(similarity, recall, rows), rows), sketches_within(most), hot=hot)
    one = near.join(classes.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    two = one.join(classes.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    both = F.size(F.array_intersect("ga", "gb"))
    two = two.select("a", "b", (both / (F.size("ga") + F.size("gb") - both)).alias("similarity"))
    return members, checkpoint(two.where(F.col("similarity") >= similarity))


def pairs(docs: DataFrame, **options) -> DataFrame:
    """id_a, id_b (id_a < id_b), similarity: pairs of distinct ids, copies included."""
    members, found = similar(docs, **options)
    left = members.select(F.col("node").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("node").alias("b"), F.col("id").alias("y"))
    across = found.join(left, "a").join(right, "b").select("x", "y", "similarity")
    # copies of a text: a large class is split, its left ids over salts, its right ids on every salt
    hot = options.get("hot", HOT)
    repeated = members.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node", F.ceil(F.col("n") / hot).cast("int").alias("salts"))
    twins = members.join(sized(checkpoint(repeated)), "node")
    left = twins.select("node", F.col("id").alias("x"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    right = twins.select("node", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    within = left.join(right, ["node", "salt"]).where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    every = across.unionByName(within).where("x <> y")
    return every.groupBy(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).agg(F.max("similarity").alias("similarity"))


def groups(docs: DataFrame, **options) -> DataFrame:
    """id, group_id, links: every id with the smallest id of its group of edits (itself if it has none) and the
    number of other texts it is similar to. Copies are in one group without being paired."""
    members, found = similar(docs, **options)
    roots = components(found.select("a", "b")).select("node", "root")
    links = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    # an id with several texts ties their classes together
    ties = members.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("a", "b")
    if not (ties := checkpoint(ties)).isEmpty():
        every = members.groupBy("id").agg(F.min("node").alias("a")).join(members, "id").where("a <> node").select("a", F.col("node").alias("b"))
        roots = components(found.select("a", "b").unionByName(every)).select("node", "root")
    placed = members.join(roots, "node", "left").join(links, "node", "left").select("id", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    names = placed.groupBy("root").agg(F.min("id").alias("group_id"))
    out = placed.join(names, "root").groupBy("id").agg(F.min("group_id").alias("group_id"), F.max("links").alias("links"))
    alone = docs.select("id").distinct().join(members.select("id").distinct(), "id", "left_anti")
    return out.unionByName(alone.select("id", F.col("id").alias("group_id"), F.lit(0).cast("long").alias("links")))
