"""Mixing sources to target weights, in tokens of a public tokenizer.

Weights run down a domain > language > source tree, each source's share split over its leaves by their tokens; which
domain a source belongs to is an input, and without it all are in one. A leaf notes what it lacks of its own share,
which makes its source short. A leaf can give at most max_repeats times its tokens; what is short is taken over by siblings under the same
parent first, then by the parent's siblings, and so on up to the root. A leaf with an allotment of a tokens
gives a // tokens whole epochs and a token prefix of the next, in an order seeded by epoch.

The tree is bounded (stated sources x known languages) and is solved on the driver; documents are only ever
aggregated, cut at bucket totals and marked. A prefix is found by bucket sums first, so that no leaf is sorted
in one task.

Defined cases: sources are compared trimmed and in lower case; documents with a null or blank source belong to
no corpus; sources without a target count towards the corpus size but give nothing; null, empty or blank texts
have no tokens and are never taken; a stated source without documents is short by all of its share; an empty
table gives no mix and every source with a positive share is not found short (the corpus has no tokens).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftspark.llm.labels import label_code
from siftspark.session import checkpoint

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern of that vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 4096
ROUNDING = 1e-12  # of a share, that is no shortage
SEED = 20_24

_encoders: dict[bytes, object] = {}


def encoder(ranks: bytes):
    """The tokenizer of a vocabulary file's content, made once a process."""
    if ranks not in _encoders:
        import tiktoken

        rows = (line.split() for line in ranks.splitlines() if line.strip())
        _encoders[ranks] = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks={base64.b64decode(a): int(b) for a, b in rows}, special_tokens={})
    return _encoders[ranks]


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, lang, source (trimmed, lower case), tokens; texts never leave the counting stage. The vocabulary file is
    read on the driver and sent to the workers."""
    with open(tokenizer, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t and not t.isspace() else 0 for t in b.column(3).to_pylist()]
            langs = [label_code(x) or "und" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), b.column(2), pa.array(n, pa.int64())], ["doc_id", "lang", "source", "tokens"])

    src = F.lower(F.regexp_replace("source", r"^\s+|\s+$", ""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.when(src != "", src).alias("source"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "doc_id long, lang string, source string, tokens long")


@dataclass
class Node:
    name: str
    weight: float = 0.0
    room: float = 0.0  # tokens it can give
    own: float = 0.0  # tokens of its own share
    short: float = 0.0  # tokens of them that it cannot give
    given: float = 0.0
    below: list[Node] = field(default_factory=list)

    def total_room(self) -> float:
        return sum(c.total_room() for c in self.below) if self.below else self.room

    def share(self) -> float:
        return sum(c.share() for c in self.below) if self.below else self.weight


def propagate(node: Node, budget: float) -> None:
    """Pass a budget down by weight; leaves note what they lack of theirs."""
    node.own = budget
    node.short = 0.0 if node.below else max(0.0, budget - node.room)
    whole = node.share()
    for c in node.below:
        propagate(c, budget * c.share() / whole if whole else 0.0)


def allot(node: Node, budget: float) -> float:
    """Give `budget` tokens to the node's subtree by weight; siblings take over what others lack, and what
    the whole subtree lacks is returned to the caller."""
    if not node.below:
        node.given = min(budget, node.room)
        return budget - node.given
    want = {id(c): 0.0 for c in node.below}
    room = {id(c): c.total_room() for c in node.below}
    left, active = budget, [c for c in node.below if c.share() > 0 and room[id(c)] > 0]
    while active and left > 1e-9 * max(budget, 1):
        weight = sum(c.share() for c in active)
        spare = 0.0
        for c in active:
            part = left * c.share() / weight
            take = min(part, room[id(c)] - want[id(c)])
            want[id(c)] += take
            spare += part - take
        left = spare
        active = [c for c in active if room[id(c)] - want[id(c)] > 1e-9 * max(budget, 1)]
    for c in node.below:
        allot(c, want[id(c)])
    return left


def tree(leaves: list[tuple[str, str, float]], targets: list[tuple[str, float, int]], domains: dict[str, str]) -> tuple[Node, dict[tuple[str, str], Node]]:
    """The domain > language > source tree of (source, lang, tokens) leaves."""
    have: dict[str, list[tuple[str, float]]] = {}
    for source, lang, tokens in leaves:
        have.setdefault(source, []).append((lang, tokens))
    root, mids, found = Node("all"), {}, {}
    for source, share, repeats in targets:
        own = have.get(source) or [("und", 0.0)]
        total = sum(t for _, t in own)
        for lang, tokens in own:
            domain = domains.get(source, "other")
            if domain not in mids:
                mids[domain] = Node(domain)
                root.below.append(mids[domain])
            if (domain, lang) not in mids:
                mids[domain, lang] = Node(lang)
                mids[domain].below.append(mids[domain, lang])
            part = tokens / total if total else 1.0 / len(own)
            leaf = Node(source, weight=share * part, room=tokens * repeats)
            mids[domain, lang].below.append(leaf)
            found[source, lang] = leaf
    return root, found


@dataclass
class Plan:
    corpus: int
    leaves: dict[tuple[str, str], Node]
    tokens: dict[tuple[str, str], int]
    targets: list[tuple[str, float, int]]

    def shares(self) -> list[tuple]:
        """source, target_share, tokens, short: short if a leaf of the source lacks tokens for its own share."""
        out = []
        for source, share, _ in self.targets:
            mine = [(k, n) for k, n in self.leaves.items() if k[0] == source]
            lacks = sum(n.short for _, n in mine) > ROUNDING * sum(n.own for _, n in mine)
            out.append((source, share, sum(self.tokens.get(k, 0) for k, _ in mine), lacks))
        return out


def plan(counted: DataFrame, targets: DataFrame, domains: dict[str, str] | None = None, size: float | None = None) -> Plan:
    """Solve the tree; collects one row per (stated source, known language) and the corpus size."""
    wanted = [(r[0], float(r[1]), int(r[2])) for r in targets.select(F.lower(F.trim("source")), "target_share", "max_repeats").dropna().collect()]
    sums = counted.where("source is not null").withColumn("stated", F.col("source").isin([w[0] for w in wanted]))
    sums = sums.groupBy(F.when(F.col("stated"), F.col("source")).alias("source"), F.when(F.col("stated"), F.col("lang")).alias("lang")).agg(F.sum("tokens").alias("t")).collect()
    corpus = sum(r.t for r in sums)
    tokens = {(r.source, r.lang): r.t for r in sums if r.source is not None}
    root, leaves = tree([(s, l, t) for (s, l), t in sorted(tokens.items())], wanted, domains or {})
    size = corpus if size is None else size
    propagate(root, size * root.share())
    allot(root, size)
    return Plan(corpus, leaves, tokens, wanted)


def _marked(counted: DataFrame, p: Plan, seed: int, buckets: int) -> DataFrame:
    """counted documents of the mix with their number of copies."""
    spark = counted.sparkSession
    rows = []
    for (source, lang), node in p.leaves.items():
        have = p.tokens.get((source, lang), 0)
        if have and node.given >= 1:
            whole = int(node.given + 0.5) // have
            rows.append((source, lang, whole, int(node.given + 0.5) - whole * have))
    leaf = spark.createDataFrame(rows, "source string, lang string, epochs long, rest long")
    docs = counted.where("tokens > 0").join(F.broadcast(leaf), ["source", "lang"])  # one row per leaf of the stated tree
    docs = docs.withColumn("h", F.xxhash64(F.lit(seed), "epochs", "doc_id")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = docs.groupBy("source", "lang", "bucket", "rest").agg(F.sum("tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy("source", "lang").orderBy("bucket"))
    sums = sums.withColumn("upto", upto).select("source", "lang", "bucket", "upto", (F.col("upto") - F.col("t")).alias("before"))
    docs = docs.join(sums, ["source", "lang", "bucket"])
    edge = docs.where("before < rest and upto > rest")
    inside = F.sum("tokens").over(Window.partitionBy("source", "lang", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("extra", (F.col("before") + inside <= F.col("rest")).cast("long"))
    rest = docs.where("not (before < rest and upto > rest)").withColumn("extra", (F.col("upto") <= F.col("rest")).cast("long"))
    both = edge.unionByName(rest).withColumn("copies", F.col("epochs") + F.col("extra"))
    return both.where("copies > 0").select("doc_id", "source", "lang", "tokens", "copies")


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, domains: dict[str, str] | None = None, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, lang, tokens, copies: the mix as large as the corpus."""
    counted = checkpoint(count_tokens(docs, tokenizer))
    return _marked(counted, plan(counted, targets, domains), seed, buckets)


def shares(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, domains: dict[str, str] | None = None, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """source, target_share, available (tokens), reached (tokens in the mix), reached_share, short."""
    counted = checkpoint(count_tokens(docs, tokenizer))
    p = plan(counted, targets, domains)
    got = _marked(counted, p, seed, buckets).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"))
    want = counted.sparkSession.createDataFrame(p.shares(), "source string, target_share double, available long, short boolean")
    full = want.join(got, "source", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    total = got.agg(F.sum("reached").alias("all_reached"))
    share = F.round(F.col("reached") / F.when(F.col("all_reached") > 0, F.col("all_reached")), 6)
    return full.join(F.broadcast(total), how="cross").select("source", "target_share", "available", "reached", share.alias("reached_share"), "short")


def short_sources(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    counted = checkpoint(count_tokens(docs, tokenizer))
    p = plan(counted, targets)
    return counted.sparkSession.createDataFrame([(s,) for s, *_, short in p.shares() if short], "source string")
