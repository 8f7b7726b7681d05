"""Files of a folder: a listing that never reads contents, and readers of notes, links and pdfs.

Defined cases: a missing folder gives no rows; undecodable bytes are replaced; extensions are compared in lower
case; empty files give empty texts; a links file without links gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftspark.functions import paths, text

IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".gif", ".tiff")
NOTES, LINKS, PDFS = (".md", ".txt"), (".links",), (".pdf",)
KINDS = {**dict.fromkeys(IMAGES, "image"), **dict.fromkeys(NOTES, "note"), **dict.fromkeys(LINKS, "links"), **dict.fromkeys(PDFS, "pdf")}
PAGES, PAGE_CHARS = 5, 4000


def _plain(path):
    return F.regexp_replace(path, "^file:/+", "/")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, mtime (epoch seconds), kind; the content column of the source is pruned, so only metadata is read."""
    if "://" not in folder and not os.path.isdir(folder):
        return spark.createDataFrame([], "path string, mtime double, kind string")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    rows = rows.select(F.url_decode(F.replace(_plain(F.col("path")), F.lit("+"), F.lit("%2B"))).alias("path"), F.col("modificationTime").cast("double").alias("mtime"))
    return rows.withColumn("kind", F.try_element_at(kind, paths.suffix(F.col("path")))).where("kind is not null")


def contents(spark: SparkSession, chosen: list[str]) -> DataFrame:
    """path, content of chosen files."""
    if not chosen:
        return spark.createDataFrame([], "path string, content binary")
    rows = spark.read.format("binaryFile").load(chosen)
    return rows.select(F.url_decode(F.replace(_plain(F.col("path")), F.lit("+"), F.lit("%2B"))).alias("path"), "content")


def content_id(content):
    return F.sha2(content, 256)


def notes(rows: DataFrame) -> DataFrame:
    """id, path, title, body from (path, content)."""
    rows = rows.select("path", content_id(F.col("content")).alias("id"), _utf8("content").alias("body"))
    return rows.select("id", "path", text.note_title(F.col("body"), paths.stem(F.col("path"))).alias("title"), "body")


@F.pandas_udf(StringType())
def _utf8(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("utf-8", "replace"), na_action="ignore")


def links(rows: DataFrame) -> DataFrame:
    """id, path, url, comment, seq of every link line of (path, content)."""
    lines = rows.select("path", F.posexplode(F.split(_utf8("content"), r"\r\n|[\n\r]")).alias("seq", "line"))
    lines = lines.withColumn("line", text.strip_ws(F.col("line")))
    url = F.regexp_extract("line", r"^(\S+)", 1)
    lines = lines.where(~F.col("line").startswith("#")).withColumn("url", url).where(F.col("url").rlike(r"^https?://\S+$"))
    comment = text.strip_ws(F.regexp_replace("line", r"^\S+", ""))
    return lines.select(F.sha2(F.concat(F.lit("link:"), "url"), 256).alias("id"), "path", "url", comment.alias("comment"), "seq")


def sampled_pages(total: int, n: int = PAGES) -> list[int]:
    """Page numbers from 0, evenly spread from the first to the last."""
    return list(range(total)) if total <= n else [round(i * (total - 1) / (n - 1)) for i in range(n)]


def pdfs(rows: DataFrame, ocr: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """id, path, title, body, error; needs a pdf library on the workers, and reports rows it cannot read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                stem = os.path.splitext(os.path.basename(path))[0]
                title, body, error = stem, "", None
                try:
                    import io

                    from pypdf import PdfReader

                    doc = PdfReader(io.BytesIO(content))
                    parts = []
                    for n in sampled_pages(len(doc.pages)):
                        got = (doc.pages[n].extract_text() or "").strip()
                        parts.append(got or (ocr(content, n) if ocr else ""))
                    title = str((doc.metadata or {}).get("/Title") or "").strip() or stem
                    body = "\n".join(p for p in parts if p)[: PAGES * PAGE_CHARS]
                except Exception as e:  # one bad file costs one file
                    error = f"{type(e).__name__}: {e}"
                out.append((hashlib.sha256(content).hexdigest(), path, title, body, error))
            yield pd.DataFrame(out, columns=["id", "path", "title", "body", "error"])

    return rows.select("path", "content").mapInPandas(read, "id string, path string, title string, body string, error string")


def _size(b: bytes) -> tuple[int, int] | None:
    """Width and height from the header of common image formats."""
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
        return struct.unpack(">II", b[16:24])
    if b[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", b[6:10])
    if b[:2] == b"BM" and len(b) >= 26:
        w, h = struct.unpack("<ii", b[18:26])
        return w, abs(h)
    if b[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(b):
            if b[i] != 0xFF:
                i += 1
                continue
            mark, n = b[i + 1], int.from_bytes(b[i + 2 : i + 4], "big")
            if mark in range(0xC0, 0xD0) and mark not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(b[i + 7 : i + 9], "big"), int.from_bytes(b[i + 5 : i + 7], "big")
            i += 2 + n
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        return _webp_size(b)
    if b[:4] in (b"II*\0", b"MM\0*"):
        return _tiff_size(b)
    return None


def _webp_size(b: bytes) -> tuple[int, int] | None:
    """Extended, lossless and lossy files hold their size in different places."""
    if b[12:16] == b"VP8X" and len(b) >= 30:
        return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1
    if b[12:16] == b"VP8L" and len(b) >= 25 and b[20] == 0x2F:
        bits = int.from_bytes(b[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if b[12:16] == b"VP8 " and len(b) >= 30 and b[23:26] == b"\x9d\x01\x2a":
        w, h = struct.unpack("<HH", b[26:30])
        return w & 0x3FFF, h & 0x3FFF
    return None


def _tiff_size(b: bytes) -> tuple[int, int] | None:
    """Tags 256 and 257 of the first directory, as short or long numbers."""
    order = "little" if b[:2] == b"II" else "big"
    at = int.from_bytes(b[4:8], order)
    found = {}
    for k in range(int.from_bytes(b[at : at + 2], order)):
        entry = b[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind = int.from_bytes(entry[:2], order), int.from_bytes(entry[2:4], order)
        if tag in (256, 257) and kind in (3, 4):
            found[tag] = int.from_bytes(entry[8 : 10 if kind == 3 else 12], order)
    return (found[256], found[257]) if len(found) == 2 else None


def images(rows: DataFrame) -> DataFrame:
    """id, path, width, height, error from (path, content); an unreadable header is the row's error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    s = _size(content)
                except Exception:
                    s = None
                out.append((hashlib.sha256(content).hexdigest(), path, *(s or (None, None)), None if s else "unreadable image header"))
            yield pd.DataFrame(out, columns=["id", "path", "width", "height", "error"]).astype({"width": "Int32", "height": "Int32"})

    return rows.select("path", "content").mapInPandas(read, "id string, path string, width int, height int, error string")
