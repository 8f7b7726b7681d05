"""What is saved by hand or by a connector, turned into files of a landing folder.

Defined cases: a capture without url and text gives no file; blanks of comments collapse; the same note gives
the same name, so that saving it again changes nothing; link lines already in the folder are not added again.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions.text import collapse_ws, strip_ws
from siftspark.sources.files import IMAGES

LINKS_FILE = "saved.links"


def captured(rows: DataFrame) -> DataFrame:
    """kind (link, note), name, content of rows (url, text, title, comment); a url wins over a text."""
    clean = lambda c: strip_ws(F.coalesce(F.col(c), F.lit("")))
    url, body, title = clean("url"), clean("text"), clean("title")
    note = F.concat(F.when(title != "", F.concat(F.lit("# "), title, F.lit("\n\n"))).otherwise(""), body, F.lit("\n"))
    name = F.concat(F.lit("note-"), F.substring(F.sha2(note, 256), 1, 8), F.lit(".md"))
    line = F.concat(F.trim(F.concat_ws(" ", url, collapse_ws(F.coalesce("comment", F.lit(""))))), F.lit("\n"))
    kind = F.when(url != "", "link").when(body != "", "note")
    out = rows.select(kind.alias("kind"), F.when(url != "", F.lit(LINKS_FILE)).otherwise(name).alias("name"), F.when(url != "", line).otherwise(note).alias("content"))
    return out.where("kind is not null").distinct()


def saved_posts(rows: DataFrame) -> DataFrame:
    """kind (image, note, link), name, content or url of posts (id, title, url, text): pictures by their suffix,
    then posts with a text, then links."""
    title, body, url = collapse_ws(F.coalesce("title", F.lit(""))), strip_ws(F.coalesce("text", F.lit(""))), F.coalesce("url", F.lit(""))
    suffix = F.lower(F.regexp_extract(url, r"(\.[A-Za-z0-9]+)$", 1))
    kind = F.when(suffix.isin(*IMAGES), "image").when(body != "", "note").when(url != "", "link")
    name = F.when(kind == "image", F.concat(F.lit("post-"), "id", suffix)).when(kind == "note", F.concat(F.lit("post-"), "id", F.lit(".md"))).otherwise(LINKS_FILE)
    content = F.when(kind == "image", url).when(kind == "note", F.concat(F.lit("# "), title, F.lit("\n\n"), body, F.lit("\n"))).otherwise(F.concat(F.trim(F.concat_ws(" ", url, title)), F.lit("\n")))
    return rows.select(kind.alias("kind"), name.alias("name"), content.alias("content")).where("kind is not null")


def land(captures: DataFrame, folder: str) -> int:
    """Write links and notes of one person's captures into the folder; the number of changes."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for r in captures.where("kind <> 'image'").toLocalIterator():
        path = os.path.join(folder, os.path.basename(r.name))
        have = ""
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                have = f.read()
        if r.kind == "link":
            if r.content.split()[0] in have.split():
                continue
            with open(path, "a", encoding="utf-8") as f:
                f.write(r.content)
        elif have == r.content:
            continue
        else:
            with open(path, "w", encoding="utf-8") as f:
                f.write(r.content)
        n += 1
    return n
