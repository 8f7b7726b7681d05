"""Repair of text from scanned pages: page furniture, words broken over lines, misread characters.

A record is a scanned page text if its lines are wrapped: many go on in lower case. Furniture is removed by
page position: page numbers, and lines at a page's edge that stand apart, repeat in the record, head other pages
too, or are the record's title. Unknown words go to an averaged-perceptron character editor whose result must
be a known word; line ends are joined by a second averaged perceptron over the sign and both pieces.

Known words are those of texts that are no scans, by their share of all records (a bound on their number). The
editor is trained on a bounded sample of unknown words of scans (TRAIN) and their nearest known words.

Defined cases: null, empty and blank texts have no lines; screens and unwrapped texts have no faults; lines are
numbered from 0; several models of one image are separate records; repeated rows give one result; a furniture
line has no other fault; a misread inside a broken word counts for the line that holds the character.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Container, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.pages import key
from siftspark.llm.perceptron import Editor, Joiner, align
from siftspark.llm.residue import trusted
from siftspark.session import checkpoint

TRAIN = 4_000  # unknown words the editor is trained on, at most
JOIN_TRAIN = 4_000  # different texts the decision on line ends is trained on, at most; scans among them count
KNOWN = 2  # records that are no scans, for a known word
VOCABULARY = 1_000_000  # known words at most, the most frequent ones
COMMON_SHARE = 0.02  # of the scans: short tokens that often are what they are, such as units
WRAPPED = 0.25  # share of lines that go on in lower case
NARROWEST, WIDEST = 35, 120  # characters of the longest of the lines that are not too wide
FITTING = 0.8  # share of lines that are not too wide
HEADERS_SENT = 2_000_000  # shared headers up to which they are broadcast, as hashes
SHARED_EDITS = 3  # words that must show a difference before it is an operation
EDIT_EVERY = 6  # characters of a word for each edit beyond two
EDGE = 2  # lines from a page's edge
HYPHENS = "-‐‑¬\xad"
_NUMBER = re.compile(r"^\W*(?:(?:page|p|pg|seite|s)\b\.?\s*)?[\dlIOoSB|]{1,4}(?:\s*(?:/|of|von)\s*[\dlIOoSB|]{1,4})?\W*$", re.IGNORECASE)
_ROMAN = re.compile(r"^\W*[ivxlc]{1,7}\W*$")
_CHAPTER = re.compile(r"^\W*(?:chapter|kapitel|section|part)\s+\S{1,4}\s*:", re.IGNORECASE)
_OUTER = ".,;:\"'()[]{}“”„«»…–—‘’?"
_ENDED = re.compile(r"[.!?,;:][\"'”’)]*$")
_LETTER = re.compile(r"[^\W\d_]")
_DIGITISH = re.compile(r"^(?=.*\d)[\dlIOoSB|]+$|^(?=.*l)(?=.*O)[lO]{2,4}$")
_LOOKALIKE = str.maketrans("lI|OoSB", "1110058")


def wrapped(text: str | None) -> bool:
    if not text:
        return False
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    narrow = [len(x) for x in lines if len(x) <= WIDEST]
    if len(lines) < 2 or len(narrow) < FITTING * len(lines) or max(narrow) < NARROWEST or trusted(lines):
        return False
    return sum(x[0].islower() for x in lines) >= WRAPPED * len(lines)


def header_key(line: str) -> str:
    """Letters of a line, lower case, with look-alike signs as letters and page numbers dropped."""
    line = re.sub(r"\s{2,}\W*[\dlIO]{1,4}\W*$|^\W*[\dlIO]{1,4}\W*\s{2,}", "", line)
    line = unicodedata.normalize("NFC", line).lower().translate(str.maketrans("01!@+569|", "oliatsbgl"))
    return "".join(c for c in line if c.isalpha()).replace("i", "l")


def is_number(line: str) -> bool:
    if _ROMAN.match(line):
        return True
    return bool(_NUMBER.match(line)) and (any(c.isdigit() for c in line) or bool(re.search(r"\b[lIO]{2,3}\b|\bpage\b", line, re.IGNORECASE)))


def edges(lines: list[str]) -> list[int]:
    """Row numbers of non-blank lines near the top or bottom of a page; a page number is at an edge."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    near: set[int] = set(full[:EDGE] + full[-EDGE:])
    for k, i in enumerate(full):
        if is_number(lines[i].strip()):
            near.update(full[max(0, k - 1) : k + 2])
    return sorted(near)


def caps(line: str) -> bool:
    letters = [c for c in line if c.isalpha()]
    return len(letters) >= 4 and sum(c.isupper() for c in letters) >= 0.8 * len(letters)


def furniture(lines: list[str], title: str | None, shared: Container[int]) -> set[int]:
    """Row numbers of running headers and page numbers of a wrapped text."""
    at = [i for i, x in enumerate(lines) if x.strip()]
    text = [x.strip() for x in lines]
    out = {i for i in at if is_number(text[i])}
    width = max((len(text[i]) for i in at if i not in out), default=0)
    keys = {i: header_key(text[i]) for i in at}
    often = Counter(keys[i] for i in at)
    near = set(edges(lines))
    named = header_key(title) if title else ""
    place = {i: k for k, i in enumerate(at)}

    def apart(i: int) -> bool:
        """It has no end, although the next line's first word would have fitted or a gap follows."""
        if _ENDED.search(text[i]) or text[i][-1] in HYPHENS or not (text[i][0].isupper() or text[i][0].isdigit()):
            return False
        rest = [j for j in at[place[i] + 1 :] if j not in out]
        before = [j for j in at[: place[i]] if j not in out]
        if rest:
            nxt = text[rest[0]]
            if nxt[0].islower():
                return False
            fits = len(text[i]) + 1 + len(nxt.split()[0]) <= width
            return fits and (not before or not _open(text[before[-1]]) or rest[0] > i + 1)
        return len(text[i]) < 0.8 * width and bool(before) and not text[i].split()[0].islower()

    for i in at:
        if i in out:
            continue
        x, k = text[i], keys[i]
        letters = len(k) >= 4
        if caps(x) or (letters and _CHAPTER.match(x)):
            out.add(i)
        elif letters and named and (k == named or (len(k) >= 8 and named.startswith(k))):
            out.add(i)
        elif letters and not _ENDED.search(x) and (often[k] > 1 or (i in near and key(k) in shared)):
            out.add(i)
        elif i in near and re.search(r"\S\s{2,}\S", x) and not _ENDED.search(x):
            out.add(i)
    for i in at:
        if i not in out and i in near and apart(i):
            # only the first or last line of a page that is no furniture yet
            k = place[i]
            if k == 0 or k == len(at) - 1 or at[k - 1] in out or at[k + 1] in out:
                out.add(i)
    return out


def _open(line: str) -> bool:
    return not re.search(r"[.!?…][\"'”’)]*$", line)


@dataclass
class Reader:
    """Known words, common tokens and the editor."""

    known: frozenset[str]
    common: frozenset[str]
    editor: Editor
    joiner: Joiner = field(default_factory=Joiner)
    cache: dict[str, tuple[str, list[int]] | None] = field(default_factory=dict)

    def fine(self, token: str) -> bool:
        if token.isdigit():
            return True
        if not _LETTER.search(token) and not _DIGITISH.match(token):
            return not any(c in "!@+|#$" for c in token)
        low = token.lower()
        if low in self.known or low in self.common:
            return True
        parts = re.split(r"[-‐/’']", low)
        return len(parts) > 1 and all(p in self.known or p.isdigit() or not p for p in parts)

    def correct(self, token: str) -> tuple[str, list[int]] | None:
        """(text, edited positions) of a misread token; None if it is fine or cannot be repaired."""
        if token not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[token] = self._correct(token)
        return self.cache[token]

    def _correct(self, token: str) -> tuple[str, list[int]] | None:
        if not token or self.fine(token):
            return None
        if _DIGITISH.match(token):
            return token.translate(_LOOKALIKE), [i for i, c in enumerate(token) if not c.isdigit()]
        if token[-1] in "!|" and self.fine(token[:-1]):
            return None
        for score, text, at in self.editor.corrections(token, max(2, len(token) // EDIT_EVERY)):
            if score >= self.editor.margin and text.lower() in self.known and len(text) >= 2:
                return text, at
        # one sign among letters, of a kind the training sample did not show
        signs = [i for i, c in enumerate(token) if not c.isalpha()]
        if len(signs) == 1 and len(token) >= 4 and (token[signs[0]].isdigit() or token[signs[0]] in "!@+|#$%&*"):
            i = signs[0]
            fits = [w for c in string.ascii_lowercase if (w := token[:i] + c + token[i + 1 :]).lower() in self.known]
            if len(fits) == 1:
                return fits[0], [i]
        return None


def split_tokens(line: str) -> list[tuple[int, str]]:
    """(start, token) without outer punctuation."""
    out = []
    for m in re.finditer(r"\S+", line):
        raw = m.group(0)
        lead = len(raw) - len(raw.lstrip(_OUTER))
        token = raw.strip(_OUTER)
        if token:
            out.append((m.start() + lead, token))
    return out


def halves(line: str, nxt: str) -> tuple[str, str, str] | None:
    """(hyphen sign or nothing, last piece, first piece of the next line); None where no word can go on."""
    line = line.rstrip()
    if len(line) < 2 or not nxt:
        return None
    sign = line[-1] if line[-1] in HYPHENS else ""
    last = line[:-1] if sign else line
    if not last[-1:].isalpha() or not (nxt[0].islower() or not nxt[0].isalnum() and nxt[0] not in _OUTER):
        return None
    return sign, last.split()[-1].lstrip(_OUTER).lower(), nxt.split()[0].strip(_OUTER).lower()


def join_features(sign: str, left: str, right: str, known: frozenset[str]) -> list[str]:
    whole, pair = left + right in known, f"{left}-{right}" in known
    a, b = left in known, right in known
    return ["bias", f"sign{bool(sign)}", f"whole{whole}", f"pair{pair}", f"left{a}", f"right{b}", f"sign{bool(sign)}pair{pair}whole{whole}", f"sign{bool(sign)}left{a}right{b}whole{whole}"]


def joins(line: str, nxt: str, reader: Reader) -> bool:
    """Whether a line ends inside a word that goes on in the next line."""
    h = halves(line, nxt)
    return h is not None and reader.joiner.score(join_features(*h, reader.known)) > 0


def train_joiner(texts: list[str], known: frozenset[str]) -> Joiner:
    """From line ends of scans: those with a sign were broken unless the pieces make a known hyphened word and no
    known whole one; those without were only if the pieces make a known word and are not both words."""
    rows: list[tuple[list[str], bool]] = []
    for text in texts:
        lines = [s for x in text.split("\n") if (s := x.strip())]
        for line, nxt in zip(lines, lines[1:]):
            h = halves(line, nxt)
            if h is None:
                continue
            sign, left, right = h
            both, whole, pair = left in known and right in known, left + right in known, f"{left}-{right}" in known
            if sign:
                rows.append((join_features(*h, known), whole or not pair))
            else:
                rows.append((join_features(*h, known), whole and not both))
    pairs = [w.split("-") for w in known if w.count("-") == 1]
    rows += [(join_features("-", a, b, known), False) for a, b in pairs if a and b and a + b not in known] * 3
    return Joiner().train(rows)


@dataclass
class Page:
    faults: list[tuple[int, str]]
    text: str


def read(text: str, title: str | None, shared: Container[int], reader: Reader) -> Page:
    """Faults (line, fault) and the repaired paragraphs of a wrapped text."""
    lines = text.split("\n")
    gone = furniture(lines, title, shared)
    faults = [(i, "furniture") for i in sorted(gone)]
    body = [i for i, x in enumerate(lines) if x.strip() and i not in gone]
    misread: set[int] = set()
    paragraphs: list[list[str]] = []
    carry: tuple[int, str] | None = None  # (line, first half) of a broken word
    last = None
    for n, i in enumerate(body):
        line = lines[i].strip()
        nxt = lines[body[n + 1]].strip() if n + 1 < len(body) else ""
        broken = joins(line, nxt, reader)
        if broken:
            faults.append((i, "broken_word"))
        if last is None or (not any(j in gone for j in range(last + 1, i)) and i > last + 1) or (i > last + 1 and carry is None and not _open(lines[last].strip())):
            paragraphs.append([])
        words = line.split()
        for k, raw in enumerate(words):
            half = None
            if k == 0 and carry is not None:
                half, raw, carry = carry, carry[1] + raw, None
            if broken and k == len(words) - 1:
                carry = (half[0] if half else i, raw[:-1] if raw[-1] in HYPHENS else raw)
                continue
            lead, token = len(raw) - len(raw.lstrip(_OUTER)), raw.strip(_OUTER)
            fix = reader.correct(token)
            if fix:
                fixed, at = fix
                cut = len(half[1]) - lead if half else 0
                for p in at:
                    misread.add(half[0] if half and p < cut else i)
                raw = raw[:lead] + fixed + raw[lead + len(token) :]
            paragraphs[-1].append(raw)
        last = i
    if carry is not None:
        paragraphs[-1].append(carry[1])
    faults += [(i, "misread") for i in sorted(misread)]
    return Page(faults, "\n\n".join(" ".join(p) for p in paragraphs if p))


def nearest(unknown: list[str], known: dict[str, int]) -> list[tuple[str, str]]:
    """(unknown, known) words at the least edit distance up to 2, by shared deletions; ties by frequency."""

    def deletions(w: str, n: int) -> set[str]:
        out = {w}
        for _ in range(n):
            out |= {x[:i] + x[i + 1 :] for x in out for i in range(len(x))}
        return out

    index: dict[str, list[str]] = defaultdict(list)
    wanted: dict[str, set[str]] = {}
    reach: set[str] = set()
    for w in unknown:
        wanted[w] = deletions(w.lower(), 2)
        reach |= wanted[w]
    for k in known:
        if len(k) >= 3:
            for d in deletions(k, 2):
                if d in reach:
                    index[d].append(k)
    out = []
    for w in unknown:
        near = {k for d in wanted[w] for k in index.get(d, ())}
        best = sorted((_distance(w.lower(), k), -known[k], k) for k in near)
        best = [b for b in best if b[0] <= 2]
        if best and (len(best) == 1 or best[0][0] < best[1][0] or -best[0][1] > -best[1][1]):
            target = best[0][2]
            out.append((w, target.capitalize() if w[0].isupper() else target))
    return out


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def train(unknown: dict[str, int], known: dict[str, int]) -> Editor:
    """From unknown words of scans and known words, with their counts.

    Only pairs with one local difference teach, and only differences that several words share; words with a
    capital teach nothing, since a rare name is often near another name.
    """
    words = [w for w in unknown if 4 <= len(w) <= 30 and w == w.lower() and _LETTER.search(w) and not _DIGITISH.match(w)]
    pairs = [(s, t) for s, t in nearest(words, known) if 0 < len(_edit(s, t)[0]) <= 2 and 0 < len(_edit(s, t)[1]) <= 2]
    edits = Counter(_edit(s, t) for s, t in pairs)
    firm = [(s, t) for s, t in pairs if edits[_edit(s, t)] >= SHARED_EDITS]
    keep = sorted(known, key=lambda w: (-known[w], w))[: max(200, len(firm))]
    return Editor().train(firm + [(w, w) for w in keep], least=SHARED_EDITS)


def _edit(seen: str, true: str) -> tuple[str, str]:
    """(characters seen, characters meant) between the common beginning and end."""
    ops = align(seen, true)
    at = [i for i, op in enumerate(ops) if op is not None]
    return ("".join(seen[i] for i in at), "".join(ops[i] or "" for i in at)) if at else ("", "")


def records(items: DataFrame, ocr: DataFrame) -> DataFrame:
    """rec_table, rec_id, model, title, text of scan candidates; repeated rows stay, results are made distinct."""
    a = ocr.where("image_id is not null and text is not null").select(F.lit("ocr_text").alias("rec_table"), F.col("image_id").cast("string").alias("rec_id"), F.coalesce(F.col("model").cast("string"), F.lit("")).alias("model"), F.lit(None).cast("string").alias("title"), F.col("text").cast("string"))
    b = items.where("kind = 'pdf' and id is not null and body is not null").select(F.lit("items").alias("rec_table"), F.col("id").cast("string").alias("rec_id"), F.lit("").alias("model"), F.col("title").cast("string"), F.col("body").cast("string").alias("text"))
    return a.unionByName(b)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """scan, word, n of a batch: records that hold the word; scans as read, clean texts in lower case.

    Texts that are neither, such as screens with words cut off, have no say.
    """
    for b in batches:
        got: Counter = Counter()
        for text, typed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            scan = wrapped(text)
            if not scan and not typed and max(map(len, text.split("\n"))) <= WIDEST:
                continue
            words = {t if scan else t.lower() for _, t in split_tokens(text)}
            if scan:  # halves of broken words are no words
                words = {w for w in words if w[-1] not in HYPHENS}
            if not scan:
                words |= {p for w in words if "-" in w for p in w.split("-")}
            got.update((scan, w) for w in words)
            got[scan, ""] += 1
        rows = [(s, w, n) for (s, w), n in got.items()]
        cols = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.bool_(), pa.string(), pa.int64()))], ["scan", "word", "n"])


def learn(items: DataFrame, ocr: DataFrame, size: int = TRAIN) -> Reader:
    """Known words and common tokens over all records; the editor from a bounded sample of unknown words."""
    texts = items.where("body is not null").select(F.col("body").cast("string").alias("text"), (F.col("kind") != "pdf").alias("typed"))
    texts = texts.unionByName(ocr.where("text is not null").select(F.col("text").cast("string"), F.lit(False).alias("typed")))
    counts = checkpoint(texts.mapInArrow(_words, "scan boolean, word string, n long").groupBy("scan", "word").agg(F.sum("n").alias("n")))
    total = {r.scan: r.n for r in counts.where("word = ''").collect()}
    clean = counts.where(~F.col("scan") & (F.col("n") >= KNOWN) & F.col("word").rlike(r"^\p{L}[\p{L}'’-]*$")).orderBy(F.desc("n"), "word").limit(VOCABULARY)
    clean = checkpoint(clean.select("word", "n"))
    known = {r.word: r.n for r in clean.collect()}  # at most VOCABULARY words
    often = counts.where(F.col("scan") & (F.col("word") != "") & (F.col("n") >= max(5, COMMON_SHARE * total.get(True, 0))) & (F.length(F.regexp_replace("word", r"[^\p{L}]", "")) < 3))
    common = frozenset(r.word.lower() for r in often.select("word").collect())  # bounded by the share
    seen = counts.where("scan").select("word", "n", F.lower("word").alias("low"))
    unknown = seen.join(clean.select(F.col("word").alias("low")), "low", "left_anti").where(F.col("word").rlike(r"\p{L}") & (F.length("word") >= 4))
    rows = unknown.orderBy(F.xxhash64("word")).limit(size).select("word", "n").collect()
    hashed = texts.where(~F.col("typed")).select(F.xxhash64("text").alias("h"), "text")
    last = hashed.select("h").distinct().orderBy("h").limit(JOIN_TRAIN).agg(F.max("h")).first()[0]
    lines = hashed.where(F.col("h") <= F.lit(last).cast("long")).dropDuplicates(["h"]).orderBy("h").select("text").collect()  # at most JOIN_TRAIN
    joiner = train_joiner([r.text for r in lines if wrapped(r.text)], frozenset(known))
    return Reader(frozenset(known), common, train({r.word: r.n for r in rows if r.word.lower() not in common}, known), joiner)


def _edge_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for table, i, text in zip(*(b.column(k).to_pylist() for k in range(3))):
            if wrapped(text):
                lines = [s for x in text.split("\n") if (s := x.strip())]
                for j in edges(lines):
                    if len(k := header_key(lines[j])) >= 4:
                        beside = lines[j + 1] if j + 1 < len(lines) else lines[j - 1]
                        out.append((table, i, key(k), key(beside)))
        cols = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["rec_table", "rec_id", "key", "beside"])


def _edges(rows: DataFrame) -> DataFrame:
    return rows.select("rec_table", "rec_id", "text").mapInArrow(_edge_keys, "rec_table string, rec_id string, key long, beside long").distinct()


def shared_headers(rows: DataFrame) -> DataFrame:
    """key of edge lines that head several records, next to other lines.

    The line beside tells headers from the first lines of copied pages.
    """
    edge = checkpoint(_edges(rows).select(F.xxhash64("rec_table", "rec_id").alias("rec"), "key", "beside"))
    one = edge.select("rec", "key").distinct().groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return edge.select("key", "beside").distinct().groupBy("key").agg(F.count("*").alias("m")).where("m > 1").join(one, "key").select("key")


def readings(items: DataFrame, ocr: DataFrame) -> DataFrame:
    """rec_table, rec_id, model, scanned, faults, text: every record read, with its repaired text."""
    rows = records(items, ocr)
    spark = items.sparkSession
    reader = spark.sparkContext.broadcast(learn(items, ocr))
    heads = checkpoint(shared_headers(rows))
    if heads.count() <= HEADERS_SENT:
        every = spark.sparkContext.broadcast(frozenset(r.key for r in heads.collect()))
        full = rows.withColumn("shared", F.lit(None).cast("array<bigint>"))
    else:  # too many to send: each record gets its own, and is shuffled for it
        every = spark.sparkContext.broadcast(frozenset())
        own = _edges(rows).join(heads, "key").groupBy("rec_table", "rec_id").agg(F.collect_set("key").alias("shared"))
        full = rows.join(own, ["rec_table", "rec_id"], "left")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = reader.value
        names = ("rec_table", "rec_id", "model", "scanned", "faults", "text")
        fault = pa.list_(pa.struct([("line_no", pa.int32()), ("fault", pa.string())]))
        for b in batches:
            out = []
            for table, i, model, title, text, shared in zip(*(b.column(k).to_pylist() for k in range(6))):
                if wrapped(text):
                    p = read(text, title, every.value if shared is None else set(shared), r)
                    out.append((table, i, model, True, [{"line_no": n, "fault": f} for n, f in p.faults], p.text))
                else:
                    out.append((table, i, model, False, [], text))
            cols = list(zip(*out)) if out else [[]] * 6
            types = (pa.string(), pa.string(), pa.string(), pa.bool_(), fault, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], list(names))

    rows = full.select("rec_table", "rec_id", "model", "title", "text", "shared")
    return rows.mapInArrow(scan, "rec_table string, rec_id string, model string, scanned boolean, faults array<struct<line_no int, fault string>>, text string")


def faults(items: DataFrame, ocr: DataFrame) -> DataFrame:
    """rec_table, rec_id, model, line_no, fault."""
    return readings(items, ocr).select("rec_table", "rec_id", "model", F.explode("faults").alias("f")).select("rec_table", "rec_id", "model", "f.line_no", "f.fault").distinct()


def repaired(items: DataFrame, ocr: DataFrame) -> DataFrame:
    """rec_table, rec_id, model, text: continuous paragraphs of the scanned records."""
    return readings(items, ocr).where("scanned").select("rec_table", "rec_id", "model", "text").distinct()
