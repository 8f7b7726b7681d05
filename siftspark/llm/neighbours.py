"""Most similar vectors, by counting collisions in query-centred windows of sorted projections.

Every vector is projected on fixed random directions; a direction's projections, sorted, are its array. Two
vectors collide on a direction where they stand in each other's window of its array.

similar_pairs (all vectors against all) looks at a vector only from directions on which it is extreme: there the
array is thin, so that a window of the width that a pair at the least cosine needs holds few others, while a
similar vector is extreme there too. Only these tails are kept, as sorted runs, and each vector's window is
expanded along its run. What stands in a window is counted on COUNTED further single projections, each with its
own query-centred window (a code of 4 bits a projection); pairs whose count reaches the threshold are verified
exactly. The number of directions grows with the table so that runs stay short; how many tails a vector needs
for a pair at the least cosine to be found with probability RECALL is measured for these directions on random
pairs of that cosine before the table is read, so that recall does not depend on the table's size.

top_k (a stated query set against all rows): projections are kept as signs, and the window of a query widens, as by
virtual rehashing, until enough rows collide with it often enough; those are verified exactly.

Defined cases: a vector is usable if it is not null, has `dim` numbers, none null or not finite, and is not all
zero; others are left out. Vectors are scaled to length 1; score is minus the L2 distance. Row numbers are any
64-bit numbers; rows without one, or without id, space or model, are left out. Exact copies are
collapsed first and expanded at the end. An id with several vectors counts with its best one and is never its own
neighbour. Tables (space, model) never mix. Empty input gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftspark.functions.vectors import table_name
from siftspark.llm.buckets import HOT, near_pairs, sized
from siftspark.operators.components import components
from siftspark.session import checkpoint

DIM = 64
RECALL = 0.999  # of a pair at the least cosine
LOSS = 0.0005  # of such pairs, by the collision thresholds
COUNTED = 64
FIRST = 16  # counted projections that are looked at first
STEP = 0.5  # of a code of four bits; codes cover projections from -4 to 4
NEAR = 2.2  # half a counted window, in deviations of a pair at the least cosine
REACH = 3.5  # of a tail's window, likewise
PLAIN = 16_384  # directions up to which they are drawn one by one; more are sums of two drawn ones
WORK = 120  # directions are the square root of so many times the rows: projecting and comparing then cost alike
TRIALS = 10_000
MOST_TAILS = 256
SEED = 911
ROWS = 256  # vectors projected at once
QUERY_BLOCK = 16_384
KNN_BITS = 256
WIDEN = 16  # candidates a query has at least, as a multiple of k
PASS_SHARE = 0.01  # of unlike rows, that the first window of a query lets through
DATA_BLOCK = 65_536


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, n)).astype(np.float32)


def usable(v: Column, dim: int) -> Column:
    """array_contains is null where an array has a null and not the number, so a null is never usable."""
    odd = F.lit(False)
    for x in ("inf", "-inf", "nan"):
        odd = odd | F.array_contains(v, F.lit(float(x)).cast("float"))
    return (F.size(v) == dim) & ~odd & ((F.array_max(v) != 0) | (F.array_min(v) != 0))


def units(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of an Arrow column of usable vectors."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return (x / np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None]).astype(np.float32)


def pack(bits: np.ndarray) -> np.ndarray:
    """n x 64m booleans to n x m int64."""
    return np.packbits(bits, axis=1).view(np.int64)


def _base(vectors: DataFrame, dim: int) -> tuple[DataFrame, list[str]]:
    """node (tb, rowid), id, embedding of usable rows; tb numbers the tables, which are the few (space, model) pairs."""
    v = vectors.select(table_name(F.col("space"), F.col("model")).alias("vt"), F.col("rowid").cast("long").alias("rowid"), F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    v = v.dropna(subset=["vt", "rowid", "id"]).where(usable(F.col("embedding"), dim))
    names = sorted(r.vt for r in vectors.select(table_name(F.col("space"), F.col("model")).alias("vt")).distinct().dropna().collect())
    number = F.lit(0)
    for i, n in enumerate(names):
        number = F.when(F.col("vt") == n, i).otherwise(number)
    return v.select(F.struct(number.cast("int").alias("tb"), "rowid").alias("node"), "id", "embedding"), names


def _label(names: list[str], tb: Column) -> Column:
    return F.element_at(F.array([F.lit(n) for n in names] or [F.lit("")]), tb + 1)


class Directions:
    """Random directions and, for vectors, those on which they are most extreme.

    Up to PLAIN directions are drawn one by one. More are the sums of two drawn ones, with either sign, whose most
    extreme ones are found from the most extreme summands.
    """

    def __init__(self, dim: int, n: int, seed: int):
        self.n, self.sums = n, n > PLAIN
        size = math.isqrt(n // 2) if self.sums else n
        self.one = directions(dim, size, seed)
        self.two = directions(dim, size, seed + 7) if self.sums else None

    @staticmethod
    def _extreme(p: np.ndarray, tails: int) -> tuple[np.ndarray, np.ndarray]:
        size = np.abs(p)
        at = np.argpartition(size, -tails, axis=1)[:, -tails:] if tails < p.shape[1] else np.tile(np.arange(p.shape[1]), (len(p), 1))
        return at * 2 + (np.take_along_axis(p, at, 1) < 0), np.take_along_axis(size, at, 1)

    def tails(self, x: np.ndarray, tails: int) -> tuple[np.ndarray, np.ndarray]:
        """(ends of directions, projections on them), the most extreme ones first."""
        ends, value = self._extreme(x @ self.one, tails)
        if self.sums:
            other, more = self._extreme(x @ self.two, tails)
            both = (value[:, :, None] + more[:, None, :]).reshape(len(x), -1) / math.sqrt(2)
            k = np.argpartition(both, -tails, axis=1)[:, -tails:]
            ends = np.take_along_axis(ends, k // other.shape[1], 1) * (2 * self.two.shape[1]) + np.take_along_axis(other, k % other.shape[1], 1)
            value = np.take_along_axis(both, k, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        return np.take_along_axis(ends, order, 1), np.take_along_axis(value, order, 1)


def directions_for(rows: int) -> int:
    return 1 << max(8, round(math.log2(math.sqrt(WORK * max(rows, 1)))))


@lru_cache(maxsize=64)
def tails_for(dim: int, n: int, least: float, recall: float = RECALL, seed: int = SEED) -> int:
    """How many of its most extreme directions a vector is found by, so that a pair at the least cosine meets in a
    window with that probability; measured on TRIALS random pairs, with one deviation of that measure added."""
    g = np.random.default_rng(seed + 3)
    x, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in g.standard_normal((2, TRIALS, dim)))
    z -= (z * x).sum(1, keepdims=True) * x
    y = least * x + math.sqrt(max(0.0, 1 - least * least)) * z / np.linalg.norm(z, axis=1, keepdims=True)
    d, width = Directions(dim, n, seed), REACH * math.sqrt(max(0.0, 2 - 2 * least))
    wanted = min(1.0, recall + math.sqrt(recall * (1 - recall) / TRIALS))
    most = 16
    while most <= min(MOST_TAILS, n):
        need = np.full(TRIALS, most + 1)
        for i in range(0, TRIALS, 100):
            (ex, vx), (ey, vy) = (d.tails(v[i : i + 100].astype(np.float32), most) for v in (x, y))
            met = (ex[:, :, None] == ey[:, None, :]) & (np.abs(vx[:, :, None] - vy[:, None, :]) <= width)
            rank = np.maximum(np.arange(most)[:, None], np.arange(most)[None, :])[None]
            need[i : i + 100] = np.where(met, rank + 1, most + 1).min((1, 2))
        tails = int(np.sort(need)[min(TRIALS - 1, math.ceil(wanted * TRIALS) - 1)])
        if tails <= most:
            return tails
        most *= 2
    raise ValueError(f"not even the {most // 2} most extreme of {n} directions give a recall of {recall} at a cosine of {least}")


def _reached(n: int, p: float, loss: float) -> int:
    """How many of n collisions, each of probability p, all but `loss` of the pairs reach."""
    below, count = 0.0, 0
    while count < n:
        below += math.comb(n, count) * p**count * (1 - p) ** (n - count)
        if below > loss:
            break
        count += 1
    return count


def thresholds(least: float, loss: float = LOSS) -> tuple[int, int, int]:
    """(half a counted window in codes, collisions needed on the first projections, and on all)."""
    apart = math.sqrt(max(1e-12, 2 - 2 * least)) / STEP
    half = math.ceil(NEAR * apart)
    # two codes differ by at most half if the projections do, and by chance if they differ by up to one code more
    at = (np.arange(20_000) + 0.5) / 2000
    p = float((np.exp(-at * at / 2) * np.clip(half + 1 - at * apart, 0, 1)).sum() * 2 / 2000 / math.sqrt(2 * math.pi))
    return half, _reached(FIRST, p, loss / 2), _reached(COUNTED, p, loss / 2)


def _tails(base: DataFrame, dim: int, plans: dict[int, tuple[int, int]], seed: int) -> DataFrame:
    """node, c1 to c4 (codes of the counted projections, 16 in each), tails (key, value): one row a vector; plans holds
    directions and tails by table number."""

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = directions(dim, COUNTED, seed + 1)
        made = {p[0]: Directions(dim, p[0], seed) for p in set(plans.values())}
        for b in batches:
            table = b.column(0).to_numpy()
            for tb in np.unique(table):
                here = np.flatnonzero(table == tb)
                mine = b.take(pa.array(here))
                n, t = plans[int(tb)]
                x = units(mine.column(2), dim)
                code = np.clip((x @ counted + 4) / STEP, 0, 15).astype(np.uint8)
                code = (code[:, ::2] | code[:, 1::2] << 4).view(np.int64)
                ends, value = (np.concatenate(c) for c in zip(*(made[n].tails(x[k : k + ROWS], t) for k in range(0, len(x), ROWS))))
                pairs = pa.StructArray.from_arrays([pa.array((ends | (np.int64(tb) << 44)).ravel()), pa.array(value.ravel())], ["key", "value"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * ends.shape[1]), pairs)
                codes = [pa.array(code[:, i].copy()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([mine.column(0), mine.column(1), *codes, lists], ["tb", "rowid", "c1", "c2", "c3", "c4", "tails"])

    out = base.select("node.tb", "node.rowid", "embedding").mapInArrow(tails, "tb int, rowid long, c1 long, c2 long, c3 long, c4 long, tails array<struct<key:long,value:float>>")
    return out.select(F.struct("tb", "rowid").alias("node"), "c1", "c2", "c3", "c4", "tails")


_EACH, _TOP = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def colliding(half: int, first: int, every: int) -> Callable[[pa.Table], Callable[[np.ndarray, int], np.ndarray]]:
    """Pairs whose codes stand in each other's window on at least `first` of the first counted projections and
    `every` of all of them. Eight codes, a byte each, are compared at once."""

    def rows(t: pa.Table) -> Callable[[np.ndarray, int], np.ndarray]:
        words = [t.column(c).to_numpy().view(np.uint64) for c in ("c1", "c2", "c3", "c4")]
        lanes = [(w >> np.uint64(k)) & np.uint64(15) * _EACH for w in words for k in (0, 4)]
        # with 16 + half added, a byte of the difference lies in the window if it is 16 to 16 + 2 half
        raised = [x + np.uint64(16 + half) * _EACH for x in lanes]
        over, past = np.uint64(128 - 16) * _EACH, np.uint64(128 - 17 - 2 * half) * _EACH

        def count(at: np.ndarray, d: int, which: range) -> np.ndarray:
            n = 0
            for k in which:
                apart = raised[k][at] - lanes[k][at + d]
                n = n + np.bitwise_count((apart + over) & ~(apart + past) & _TOP)
            return n

        def close(at: np.ndarray, d: int) -> np.ndarray:
            n = count(at, d, range(FIRST // 8))
            out = n >= first
            left = np.flatnonzero(out)
            out[left] = n[left] + count(at[left], d, range(FIRST // 8, COUNTED // 8)) >= every
            return out

        return close

    return rows


def _hashed(base: DataFrame) -> DataFrame:
    """node, h1, h2: 128 bits of every vector."""
    return checkpoint(base.select("node", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")))


def _classes(hashed: DataFrame) -> DataFrame:
    """node, rep: rows whose vector stands in the table more than once, with the class's smallest node."""
    group = hashed.groupBy("node.tb", "h1", "h2").agg(F.min("node").alias("rep"), F.count("*").alias("n")).where("n > 1")
    group = sized(checkpoint(group.select("rep", "h1", "h2", "tb")))
    return checkpoint(hashed.withColumn("tb", F.col("node.tb")).join(group, ["tb", "h1", "h2"]).select("node", "rep"))


def linked(vectors: DataFrame, least: float, dim: int, recall: float, hot: int, seed: int) -> tuple[DataFrame, list[str], DataFrame, DataFrame]:
    """(base; names of tables; classes of exact copies: node, rep; pairs of representatives: a, b, cosine, x, y),
    x and y being the ids of a and b."""
    base, names = _base(vectors, dim)
    hashed = _hashed(base)
    classes = _classes(hashed)
    reps = base.join(sized(checkpoint(classes.where("node <> rep").select("node").distinct())), "node", "left_anti")
    plans = {}
    for tb, n in hashed.groupBy("node.tb").count().collect():  # one row a table
        d = directions_for(n)
        plans[tb] = (d, tails_for(dim, d, least, recall, seed))
    kept = checkpoint(_tails(reps, dim, plans, seed))
    rows = kept.select("node", "c1", "c2", "c3", "c4", F.explode("tails").alias("t")).select("t.key", "t.value", "node", "c1", "c2", "c3", "c4")
    near = near_pairs(rows, colliding(*thresholds(least)), ("value", REACH * math.sqrt(max(0.0, 2 - 2 * least))), hot)

    ids = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    vec = base.join(sized(checkpoint(ids)), "node", "left_semi")  # the vectors of candidates are the only ones to move
    ends = near.join(vec.select(F.col("node").alias("a"), F.col("id").alias("x"), F.col("embedding").alias("vx")), "a")
    ends = ends.join(vec.select(F.col("node").alias("b"), F.col("id").alias("y"), F.col("embedding").alias("vy")), "b").select("a", "x", "b", "y", "vx", "vy")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = (units(t.column(c), dim).astype(np.float64) for c in (4, 5))
            cos = np.einsum("ij,ij->i", x, y)
            keep = pa.array(np.flatnonzero(cos >= least))
            yield pa.RecordBatch.from_arrays([*(t.column(i).take(keep) for i in range(4)), pa.array(cos).take(keep)], ["a", "x", "b", "y", "cosine"])

    node = "struct<tb:int,rowid:long>"
    return base, names, classes, checkpoint(ends.mapInArrow(verify, f"a {node}, x string, b {node}, y string, cosine double"))


def similar_pairs(vectors: DataFrame, least: float = 0.90, dim: int = DIM, recall: float = RECALL, hot: int = HOT, seed: int = SEED) -> DataFrame:
    """vec_table, id_a, id_b (id_a < id_b), cosine: all pairs of ids of one table with that cosine or more.

    Copies take part in the pairs of their representative and in pairs of their own class, as the result asks
    for all pairs of ids; similar_groups lists them once.
    """
    base, names, classes, pairs = linked(vectors, least, dim, recall, hot, seed)
    copies = checkpoint(base.select("node", "id").join(sized(classes), "node").select("rep", F.col("id").alias("other")).distinct())
    more = sized(copies)
    pairs = pairs.unionByName(pairs.join(more, pairs.a == copies.rep).select("a", F.col("other").alias("x"), "b", "y", "cosine"))
    pairs = pairs.unionByName(pairs.join(more, pairs.b == copies.rep).select("a", "x", "b", F.col("other").alias("y"), "cosine"))
    # a large class is split: its left ids over salts, its right ids on every salt
    salts = copies.groupBy("rep").agg(F.ceil(F.count("*") / hot).cast("int").alias("salts"))
    left = copies.join(salts, "rep").select("rep", F.col("other").alias("x"), F.pmod(F.xxhash64("other"), F.col("salts")).cast("int").alias("salt"))
    right = copies.join(salts, "rep").select("rep", F.col("other").alias("y"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    twins = left.join(right, ["rep", "salt"]).where("x < y").select(F.col("rep").alias("a"), "x", F.col("rep").alias("b"), "y", F.lit(1.0).alias("cosine"))
    pairs = pairs.unionByName(twins).where("x <> y")
    return pairs.groupBy(_label(names, F.col("a.tb")).alias("vec_table"), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).agg(F.max("cosine").alias("cosine"))


def similar_groups(vectors: DataFrame, least: float = 0.90, dim: int = DIM, recall: float = RECALL, hot: int = HOT, seed: int = SEED) -> DataFrame:
    """vec_table, id, group_id, links: every id with a usable vector, the smallest id of its group of linked ones
    (itself if it has none) and the number of other vectors that its vectors are similar to, copies as one."""
    base, names, classes, pairs = linked(vectors, least, dim, recall, hot, seed)
    members = base.select("node", "id").join(sized(checkpoint(classes.where("node <> rep"))), "node", "left").select("id", F.coalesce("rep", "node").alias("node")).distinct()
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("links"))
    # an id with several vectors ties their classes together
    first = members.groupBy("id", "node.tb").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    ties = members.withColumn("tb", F.col("node.tb")).join(first, ["id", "tb"]).where("a <> node").select("a", F.col("node").alias("b"))
    roots = components(pairs.select("a", "b").unionByName(ties))
    placed = members.join(roots, "node", "left").join(links, "node", "left").select("id", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    named = placed.groupBy("root").agg(F.min("id").alias("group_id"))
    out = placed.join(named, "root").groupBy("root.tb", "id").agg(F.min("group_id").alias("group_id"), F.sum("links").alias("links"))
    return out.select(_label(names, F.col("tb")).alias("vec_table"), "id", "group_id", "links")


class Queries:
    """A bounded block of query vectors with their collision bits."""

    def __init__(self, rows: list, dim: int, seed: int):
        x = np.array([r.embedding for r in rows], np.float32).reshape(len(rows), dim)
        self.table = np.array([r.tb for r in rows], np.int32)
        self.row = np.array([r.rowid for r in rows], np.int64)
        self.id = pd.util.hash_array(np.array([r.id for r in rows], object)) if rows else np.empty(0, np.uint64)
        self.x = x / np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None].astype(np.float32)
        self.sig = pack(self.x @ directions(dim, KNN_BITS, seed) > 0).view(np.uint64).reshape(len(rows), KNN_BITS // 64)


class Best:
    """The k best different ids of every query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.cos = np.full((queries, k), -np.inf)
        self.row = np.zeros((queries, k), np.int64)
        self.oid = np.zeros((queries, k), np.uint64)

    def add(self, q: int, cos: np.ndarray, row: np.ndarray, oid: np.ndarray) -> None:
        new = cos > self.cos[q, -1]
        if not new.any():
            return
        cos, row, oid = np.r_[self.cos[q], cos[new]], np.r_[self.row[q], row[new]], np.r_[self.oid[q], oid[new]]
        order = np.lexsort((row, -cos))
        real = order[np.isfinite(cos[order])]
        first = np.sort(np.unique(oid[real], return_index=True)[1])  # the best of each id
        top = real[first][: self.k]
        n = len(top)
        self.cos[q, :n], self.row[q, :n], self.oid[q, :n] = cos[top], row[top], oid[top]


def _gathered(batches: Iterator[pa.RecordBatch], dim: int, rows: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(table, row number, hash of id, unit vectors), in blocks of about that many rows."""
    parts, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        oid = pd.util.hash_array(np.array(b.column(2).to_pylist(), object))
        parts.append((b.column(0).to_numpy(), b.column(1).to_numpy(), oid, units(b.column(3), dim)))
        size += b.num_rows
        if size >= rows:
            yield tuple(np.concatenate(c) for c in zip(*parts))
            parts, size = [], 0
    if parts:
        yield tuple(np.concatenate(c) for c in zip(*parts))


def top_k(vectors: DataFrame, k: int = 10, every: int = 50, dim: int = DIM, block: int = QUERY_BLOCK, seed: int = SEED, pass_share: float = PASS_SHARE) -> DataFrame:
    """vec_table, image_id, other_id, score, place: for every row whose rowid is divisible by `every`, the k most
    similar other ids of its table."""
    base, names = _base(vectors, dim)
    spark = vectors.sparkSession
    low = int(KNN_BITS / 2 - NormalDist().inv_cdf(pass_share) * math.sqrt(KNN_BITS) / 2)

    def scan_with(shared):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qs: Queries = shared.value
            dirs = directions(dim, KNN_BITS, seed)
            best = Best(len(qs.row), k)
            for table, row, oid, x in _gathered(batches, dim, DATA_BLOCK):
                sig = pack(x @ dirs > 0).view(np.uint64).reshape(len(x), KNN_BITS // 64)
                for tb in np.unique(table):
                    here = np.flatnonzero(table == tb)
                    words = [np.ascontiguousarray(sig[here, w]) for w in range(sig.shape[1])]
                    need = min(len(here), WIDEN * k)
                    for q in np.flatnonzero(qs.table == tb):
                        apart = np.bitwise_count(words[0] ^ qs.sig[q, 0])
                        for w in range(1, len(words)):
                            apart += np.bitwise_count(words[w] ^ qs.sig[q, w])
                        hit = np.flatnonzero(apart <= KNN_BITS - low)
                        if len(hit) < need:  # the window of this query widens
                            hit = np.argpartition(apart, need - 1)[:need]
                        hit = here[hit]
                        hit = hit[oid[hit] != qs.id[q]]
                        best.add(q, (x[hit] @ qs.x[q]).astype(np.float64), row[hit], oid[hit])
            q, at = np.nonzero(np.isfinite(best.cos))
            cols = (qs.table[q], qs.row[q], best.row[q, at], best.oid[q, at].view(np.int64), best.cos[q, at])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["tb", "q", "row", "oid", "cosine"])

        return scan

    flat = base.select("node.tb", "node.rowid", "id", "embedding")
    clean = checkpoint(flat.where(F.col("rowid") % every == 0).withColumn("block", F.pmod(F.xxhash64("tb", "rowid"), F.lit(2**31)).cast("int")))
    blocks = max(1, math.ceil(clean.count() / block))
    out = None
    for i in range(blocks):
        rows = clean.where(F.col("block") % blocks == i).select("tb", "rowid", "id", "embedding").collect()  # about `block` rows
        part = flat.mapInArrow(scan_with(spark.sparkContext.broadcast(Queries(rows, dim, seed))), "tb int, q long, row long, oid long, cosine double")
        out = part if out is None else out.unionByName(part)
    one = out.groupBy("tb", "q", "oid").agg(F.max_by("row", F.struct("cosine", -F.col("row"))).alias("row"), F.max("cosine").alias("cosine"))
    w = Window.partitionBy("tb", "q").orderBy(F.desc("cosine"), "row")
    top = checkpoint(one.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k))
    named = top.join(flat.select("tb", F.col("rowid").alias("row"), F.col("id").alias("other_id")), ["tb", "row"]).join(clean.select("tb", F.col("rowid").alias("q"), F.col("id").alias("image_id")), ["tb", "q"])
    score = F.round(-F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("cosine"))), 6)
    return named.select(_label(names, F.col("tb")).alias("vec_table"), "image_id", "other_id", score.alias("score"), "place")
