"""Text expressions. Everything here stays in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a query that name a kind of image, and the facet each one means.
FACET_WORDS = {
    "graph": "chart", "graphs": "chart", "chart": "chart", "charts": "chart",
    "plot": "chart", "plots": "chart", "diagram": "chart",
    "meme": "meme", "memes": "meme", "comic": "meme", "comics": "meme",
    "screenshot": "screenshot", "screenshots": "screenshot",
    "document": "document", "documents": "document", "scan": "document",
    "photo": "photo", "photos": "photo", "photograph": "photo", "picture": "photo",
    "art": "art", "drawing": "art", "artwork": "art",
}
_PUNCT = ".,!?"
WHITE = r"[\s\x{A0}\x{85}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]+"


def _folding() -> tuple[str, str]:
    """Accented Latin letters and their plain ones, by canonical decomposition."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp))[0]
        if base != chr(cp) and base.isascii():
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _folding()


def strip_ws(c: Column) -> Column:
    """Both ends, any white space (trim() only knows blanks)."""
    return F.regexp_replace(c, f"^{WHITE}|{WHITE}$", "")


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WHITE, " "))


def plain_words(c: Column) -> Column:
    """Lower-case letters and digits of English, words by single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def fold(c: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}+", ""), FOLD_FROM, FOLD_TO)


def words(c: Column) -> Column:
    """Words as the keyword index sees them: folded runs of letters and digits."""
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def note_title(body: Column, stem: Column) -> Column:
    """The first line with text, without leading hashes; else the file's stem."""
    lines = F.filter(F.transform(F.split(body, r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"), strip_ws), lambda x: x != "")
    first = strip_ws(F.regexp_replace(F.try_element_at(lines, F.lit(1)), "^#+", ""))
    return F.coalesce(F.when(first != "", first), stem)


def searchable(title: Column, url: Column, body: Column) -> Column:
    return strip_ws(F.concat_ws("\n", *[F.when(c != "", c) for c in (title, url, body)]))


def snippet(body: Column, n: int = 300) -> Column:
    return F.substring(body, 1, n)


def facets_of(query: str) -> tuple[str, set[str]]:
    """(text to rank by, facets named in the query); a query of facet words alone keeps them."""
    named = [(t, FACET_WORDS.get(t.strip(_PUNCT).lower())) for t in query.split()]
    rest = " ".join(t for t, f in named if not f)
    return rest or query, {f for _, f in named if f}


def facets(query: Column) -> tuple[Column, Column]:
    """The same for a column of queries: (text, sorted facets)."""
    table = F.create_map(*[F.lit(x) for kv in FACET_WORDS.items() for x in kv])
    tokens = F.filter(F.split(query, WHITE), lambda t: t != "")
    facet = lambda t: F.try_element_at(table, F.lower(F.regexp_replace(t, r"^[.,!?]+|[.,!?]+$", "")))
    rest = F.array_join(F.filter(tokens, lambda t: facet(t).isNull()), " ")
    found = F.filter(F.transform(tokens, facet), lambda f: f.isNotNull())
    return F.when(rest != "", rest).otherwise(query), F.array_sort(F.array_distinct(found))


def phrases(query: str) -> list[list[str]]:
    """Phrases of a keyword query: one per blank-separated token, as folded words; punctuation alone is none."""
    import re

    def folded(t: str) -> str:
        t = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
        return t

    out = [[w for w in re.split(r"[\W_]+", folded(t)) if w] for t in query.split()]
    return [p for p in out if p]
