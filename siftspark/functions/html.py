"""HTML to title and text, and the state of a fetched page.

A page is reduced, not walked: comments and silent parts are cut out (innermost first, so that they may be nested),
titles are taken out, and what lies between the tags that are left is the text.

Defined cases: null gives no title and an empty text; a part or tag that is never closed goes on to the end of the
page; a sign that opens no tag is text; several titles are one after the other; entities are decoded at last.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from siftspark.functions.urls import refusal_reason

# Subtrees without text, signs of a wall, and limits.
SILENT = ("script", "style", "noscript", "template")
WALLS = (
    "sign in to continue", "log in to continue", "please enable javascript",
    "subscribe to read", "subscribers only", "create a free account to",
    "verify you are human", "checking your browser", "enable cookies",
    "access denied", "403 forbidden",
)
WALL_CHARS, THIN_CHARS, KEPT_CHARS = 2000, 200, 5000
REFUSED = (401, 402, 403, 429)


_CUT = "<br>"  # any tag: what is left of a part that was cut out, so that texts on both sides stay apart
_CODE = re.compile(r"<!--.*?(?:--!?>|\Z)|<(script|style)\b[^>]*(?<!/)>.*?(?:</\1\b[^>]*>|\Z)", re.IGNORECASE | re.DOTALL)
_INNERMOST = re.compile(r"<({0})\b[^>]*(?<!/)>(?:(?!<(?:{0})\b).)*?</\1\b[^>]*>".format("|".join(SILENT)), re.IGNORECASE | re.DOTALL)
_UNCLOSED = re.compile(r"<(?:{0})\b[^>]*>.*\Z".format("|".join(SILENT)), re.IGNORECASE | re.DOTALL)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\b[^>]*>|\Z)", re.IGNORECASE | re.DOTALL)
_TAG = re.compile(r"<(?:/?[a-z]|[!?])(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|<(?:/?[a-z]|[!?])[^>]*>", re.IGNORECASE)


def parse(html: str) -> tuple[str | None, str]:
    page, cuts = _CODE.sub(_CUT, html), 1
    while cuts:
        page, cuts = _INNERMOST.subn(_CUT, page)
    page = _UNCLOSED.sub(_CUT, page)
    title = "".join(unescape(_TAG.sub("", t)) for t in _TITLE.findall(page))
    chunks = (unescape(x).strip() for x in _TAG.split(_TITLE.sub(_CUT, page)))
    return " ".join(title.split()) or None, " ".join(x for x in chunks if x)


@F.pandas_udf(StructType([StructField("title", StringType()), StructField("text", StringType())]))
def extract(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(h) if isinstance(h, str) else (None, "") for h in html], columns=["title", "text"])


def page_state(url: Column, content_type: Column, code: Column, text: Column) -> Column:
    """skipped, blocked, dead, thin or ok."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    head = F.lower(F.substring(text, 1, WALL_CHARS))
    wall = F.lit(False)
    for w in WALLS:
        wall = wall | F.contains(head, F.lit(w))
    return (
        F.when(refusal_reason(url) != "", "skipped")
        .when(code.isin(*REFUSED), "blocked")
        .when(code.isNull() | (code >= 400), "dead")
        .when(F.contains(kind, F.lit("pdf")) | ~(F.contains(kind, F.lit("html")) | F.contains(kind, F.lit("text"))), "skipped")
        .when(wall, "blocked")
        .when(F.length(F.coalesce(text, F.lit(""))) < THIN_CHARS, "thin")
        .otherwise("ok")
    )


def page_text(state: Column, text: Column) -> Column:
    return F.when(state == "ok", F.substring(text, 1, KEPT_CHARS)).otherwise("")
