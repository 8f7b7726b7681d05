"""Language of documents and of mixed segments, by compression.

Each language has a raw-content zstandard dictionary. A line belongs to the language whose dictionary makes it
smallest; narrow margins are rejected. Dictionaries are cut from a bounded sample of labelled documents
(SAMPLE a language, by small hashes over all rows, whole texts) and cleaned of wrong labels by the same classifier:
the sampled documents are halved, and a line stays if the dictionaries of the other half, at first cut from lines whose words are commonest under their own label, give it
its label too. Every
label that names a language is tried; one whose lines mostly go to other languages was a wrong label only, and is no
language of the collection.

Defined cases: null, empty and wordless texts have no language and no segment; a label is missing if it is
null, empty or no language's name, and right in any spelling of the right language; a rejected line belongs to
no language but does not end a segment; lines are those between line feeds; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import zip_longest

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftspark.llm.labels import label_expr

SAMPLE = 400  # labelled documents a language at most
DICTIONARY = 100_000  # bytes a language at most
ROUNDS = 2
FEW = 15  # lines that every label is taken to have besides, so that few lines do not make their words common
KEPT = 0.5  # share of its clear lines that a language keeps when labels are cleaned
MARGIN = 0.08  # of the second best size, for lines of LONG characters or more
SHORT_MARGIN = 0.15
TEXT_MARGIN = 0.02  # for a whole text without a clear line
LONG = 60
LEVEL = 3
_DROP = re.compile(r"[^\w\s'’]+|\d+|_+")
_SPACE = re.compile(r"\s+")


def plain(line: str) -> str:
    return _SPACE.sub(" ", _DROP.sub(" ", line.lower())).strip()


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.raw, self.names = dictionaries, sorted(dictionaries)
        self.made = []
        for n in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
        base = zstandard.ZstdCompressor(compression_params=p) if self.made else None
        self.empty = len(base.compress(b"")) if base else 0

    def line(self, line: str, least: float | None = None) -> tuple[str | None, float]:
        """(language or None, confidence); the confidence is the margin to the second best."""
        text = plain(line)
        if not text:
            return None, 0.0
        raw = text.encode()
        sizes = sorted((len(c.compress(raw)) - self.empty, n) for n, c in zip(self.names, self.made))
        if not sizes:
            return None, 0.0
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        (best, name), (second, _) = sizes[:2]
        margin = (second - best) / max(second, 1)
        if margin <= 0 or margin < (least or (MARGIN if len(text) >= LONG else SHORT_MARGIN)):
            return None, margin
        return name, margin


def _cut(lines: dict[str, list[str]]) -> dict[str, bytes]:
    """Dictionaries of at most DICTIONARY bytes; a line that does not fit any more is passed over."""
    out = {}
    for name, own in lines.items():
        parts, size = [], 0
        for x in dict.fromkeys(own):
            b = x.encode() + b"\n"
            if size + len(b) <= DICTIONARY:
                parts.append(b)
                size += len(b)
        if parts:
            out[name] = b"".join(parts)
    return out


def _in_turn(texts: list[str]) -> list[str]:
    """Lines of all texts, one of each in turn, up to twice a dictionary, so that a long text takes no other's place."""
    lines = [[p for x in t.split("\n") if len(p := plain(x)) >= 20] for t in texts]
    out, size = [], 0
    for k in range(max(map(len, lines), default=0)):
        for own in lines:
            if k < len(own) and size < 2 * DICTIONARY:
                out.append(own[k])
                size += len(own[k]) + 1
    return out


def train(samples: list[tuple[str, str]], rounds: int = ROUNDS) -> Classifier:
    """From (label, text) rows with noisy labels."""
    texts: dict[str, list[str]] = {}
    for label, text in samples:
        texts.setdefault(label, []).append(text)
    halves = [{label: _in_turn(own[k::2]) for label, own in texts.items()} for k in (0, 1)]
    held = [{label: _vouched(label, h) for label in h} for h in halves]
    for _ in range(rounds):
        kept: list[dict[str, list[str]]] = []
        clear, right = dict.fromkeys(texts, 0), dict.fromkeys(texts, 0)
        for k in (0, 1):
            model = Classifier(_cut(held[1 - k]))  # none of its dictionaries holds a line of this half
            kept.append({})
            for label, own in halves[k].items():
                got = [(x, model.line(x)[0]) for x in dict.fromkeys(own)]
                kept[k][label] = [x for x, lang in got if lang == label]
                clear[label] += sum(lang is not None for _, lang in got)
                right[label] += len(kept[k][label])
        real = {label for label in texts if right[label] > KEPT * clear[label]}
        halves = [{label: own for label, own in h.items() if label in real} for h in halves]
        held = [{label: own for label, own in h.items() if label in real} for h in kept]
    return Classifier(_cut({label: [x for pair in zip_longest(held[0][label], held[1][label]) for x in pair if x is not None] for label in held[0]}))


def _vouched(label: str, lines: dict[str, list[str]]) -> list[str]:
    """Lines whose words are commoner in the lines of their own label than in those of any other."""
    per_line = {}
    for name, own in lines.items():
        seen = Counter(w for x in own for w in set(x.split()))
        per_line[name] = {w: n / (len(own) + FEW) for w, n in seen.items()}
    weight = lambda x, name: sum(per_line[name].get(w, 0.0) for w in x.split())
    return [x for x in lines[label] if weight(x, label) >= max(weight(x, name) for name in lines)]


def sample(docs: DataFrame, languages=None, size: int = SAMPLE) -> list[tuple[str, str]]:
    """About `size` labelled texts a language at most, by small hashes of their ids over all rows: ids are cut at a
    hash that lets twice as many pass before they are ranked, so that no language is sorted as a whole."""
    rows = docs.where("text is not null").select(label_expr("lang").alias("label"), F.xxhash64("doc_id").alias("h"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("label").isin(*languages) if languages else F.col("label").isNotNull())
    bound = F.lit(False)
    for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect():  # one row a language
        share = min(1.0, (2 * size + 50) / r.n)
        bound = bound | ((F.col("label") == r.label) & (F.col("h") <= min(2**63 - 1, int(-(2**63) + share * 2**64))))
    w = Window.partitionBy("label").orderBy("h")
    top = rows.where(bound).withColumn("n", F.row_number().over(w)).where(F.col("n") <= size)
    return [(r.label, r.text) for r in sorted(top.select("label", "text", "h").collect(), key=lambda r: (r.label, r.h, r.text))]


def judge(text: str | None, model: Classifier) -> list[tuple[int, int, str, float, int, int]]:
    """Segments: (first line, last line, language, confidence, letters, lines)."""
    out: list[list] = []
    if not text:
        return []
    for no, line in enumerate(text.split("\n")):
        lang, margin = model.line(line)
        if lang is None:
            continue
        if out and out[-1][2] == lang:
            seg = out[-1]
            seg[1] = no
        else:
            out.append(seg := [no, no, lang, 0.0, 0, 0])
        seg[3] += margin * len(line)
        seg[4] += len(line)
        seg[5] += 1
    if not out:  # no single line is clear; the whole text may be
        lang, margin = model.line(text, TEXT_MARGIN)
        if lang is not None:
            return [(0, text.count("\n"), lang, round(margin, 6), len(text), 0)]
    return [(a, b, lang, round(c / n, 6), n, k) for a, b, lang, c, n, k in out]


def segments(docs: DataFrame, languages=None, size: int = SAMPLE) -> DataFrame:
    """doc_id, label, first_line, last_line, lang, confidence, letters, lines."""
    dictionaries = docs.sparkSession.sparkContext.broadcast(train(sample(docs, languages, size)).raw)  # at most DICTIONARY bytes a language

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries.value)
        types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int32())
        for b in batches:
            got = []
            for i, label, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                got += [(i, label, *s) for s in judge(text, model)]
            cols = list(zip(*got)) if got else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "label", "first_line", "last_line", "lang", "confidence", "letters", "lines"])

    rows = docs.select(F.col("doc_id").cast("long"), label_expr("lang").alias("label"), F.col("text").cast("string"))
    return rows.mapInArrow(scan, "doc_id long, label string, first_line int, last_line int, lang string, confidence double, letters long, lines int")


def documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, label, lang, confidence, languages: the language of most of the text, and all that fill a line."""
    seg = segments(docs, **options)
    by = seg.groupBy("doc_id", "label", "lang").agg(F.sum("letters").alias("letters"), F.sum("lines").alias("lines"), (F.sum(F.col("confidence") * F.col("letters")) / F.sum("letters")).alias("c"))
    return by.groupBy("doc_id", "label").agg(
        F.max(F.struct("letters", "c", "lang")).alias("most"), F.sort_array(F.collect_set("lang")).alias("languages")
    ).select("doc_id", "label", "most.lang", F.round("most.c", 6).alias("confidence"), "languages")


def mislabelled(docs: DataFrame, **options) -> DataFrame:
    """doc_id, lang: the languages of documents with a missing or wrong label or several languages."""
    d = documents(docs, **options)
    bad = F.col("label").isNull() | (F.col("label") != F.col("lang")) | (F.size("languages") > 1)
    return d.where(bad).select("doc_id", F.explode("languages").alias("lang"))
