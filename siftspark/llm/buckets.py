"""Pairs that stand in one bucket and are close.

Both similarity joins end in this kernel: rows of (key, node, ...), sorted within their bucket, are compared along
the sorted run by a function of Arrow columns, and only close pairs leave it. A bucket of more than `hot` rows is
cut into blocks and every pair of blocks becomes a bucket of its own, so that no task compares more than `hot`
rows with each other, however large a bucket is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.session import checkpoint

HOT = 16_384
SMALL = 1_000_000  # rows up to which a side is broadcast
OUT = 100_000  # pairs of one output batch
CHUNK = 100_000  # rows compared at once

# Given the rows of whole buckets: a function of row numbers and a distance d, telling of each row i of them
# whether i and i + d are close.
Close = Callable[[pa.Table], Callable[[np.ndarray, int], np.ndarray]]


def sized(df: DataFrame) -> DataFrame:
    """Broadcast a checkpointed side only if its counted size is small; else let it be shuffled."""
    return F.broadcast(df) if df.count() <= SMALL else df


def sketches_within(most: int) -> Close:
    """Sketches s1, s2 (128 bits) that differ in at most `most` bits."""

    def rows(t: pa.Table) -> Callable[[np.ndarray, int], np.ndarray]:
        # a signed number's bits are counted of its absolute value
        s1, s2 = (t.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2"))
        return lambda at, d: np.bitwise_count(s1[at] ^ s1[at + d]).astype(np.int16) + np.bitwise_count(s2[at] ^ s2[at + d]) <= most

    return rows


def runs(key: np.ndarray, close: Callable[[np.ndarray, int], np.ndarray], value: np.ndarray | None = None, width: float = np.inf) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of close pairs of one key, by distance along the sorted rows; with a value, rows are sorted by
    it within their key and a row's window ends where the value has grown by more than `width`."""
    at, d = np.arange(len(key)), 1
    while len(at := at[at < len(key) - d]):
        go = key[at] == key[at + d]
        if value is not None:
            go &= value[at + d] - value[at] <= width
        at = at[go]
        hit = at[close(at, d)]
        if len(hit):
            yield hit, hit + d
        d += 1


def _paired(rows: DataFrame, close: Close, window: tuple[str, float] | None) -> DataFrame:
    """Pairs of buckets of bounded size, in one shuffle: a sorted partition is read as a stream of runs."""
    node = rows.schema["node"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # ends in a key of which there may be more
        for b in batches:
            rest.append(b)
            if sum(x.num_rows for x in rest) >= CHUNK:
                t = pa.Table.from_batches(rest)
                key = t.column(0).to_numpy()
                cut = int(np.searchsorted(key, key[-1], "left"))
                if cut:
                    yield from pairs(t.slice(0, cut))
                    rest = t.slice(cut).to_batches()
        if rest:
            yield from pairs(pa.Table.from_batches(rest))

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        value, width = (t.column(window[0]).to_numpy(), window[1]) if window else (None, np.inf)
        for i, j in runs(t.column("key").to_numpy(), close(t), value, width):
            for k in range(0, len(i), OUT):
                both = [t.column("node").take(pa.array(x[k : k + OUT])).combine_chunks() for x in (i, j)]
                yield pa.RecordBatch.from_arrays(both, ["a", "b"])

    order = ["key", window[0]] if window else ["key"]
    placed = rows.repartition("key").sortWithinPartitions(*order)
    found = placed.mapInArrow(scan, f"a {node}, b {node}").where("a <> b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _blocked(rows: DataFrame, crowded: DataFrame, hot: int) -> DataFrame:
    """Rows of crowded buckets, once for every pair of blocks their own block is in, under the key of that pair."""
    blocks = F.ceil(2 * F.col("n") / hot).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(hot)), F.col("blocks")).cast("int")
    rows = rows.join(crowded.select("key", blocks.alias("blocks")), "key").withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).drop("blocks", "own", "other")


def near_pairs(rows: DataFrame, close: Close, window: tuple[str, float] | None = None, hot: int = HOT) -> DataFrame:
    """a, b (a < b): distinct nodes of one bucket that are close; window: a column rows are sorted by and how much
    of it a row looks ahead. rows are read twice (sizes of buckets, then pairs) and should be cheap to read."""
    crowded = checkpoint(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot))
    if crowded.isEmpty():
        near = _paired(rows, close, window)
    else:
        big = sized(crowded)
        near = _paired(rows.join(big.select("key"), "key", "left_anti").unionByName(_blocked(rows, big, hot)), close, window)
    return checkpoint(near.distinct())
