"""Bookmarks of browsers.

Defined cases: a missing or broken store gives no rows; only http urls count; nameless folders and the tree's
root are left out of folder paths; a cycle of parents ends at the first repeated folder.
"""

from __future__ import annotations

import json
import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "url string, title string, folder string, browser string"
# Where each browser keeps its bookmarks, below the user's home.
CHROMIUM = {
    "chrome": "AppData/Local/Google/Chrome/User Data/Default/Bookmarks",
    "edge": "AppData/Local/Microsoft/Edge/User Data/Default/Bookmarks",
    "brave": "AppData/Local/BraveSoftware/Brave-Browser/User Data/Default/Bookmarks",
}


def folder_paths(nodes: DataFrame, deepest: int = 50) -> DataFrame:
    """id, folder of rows (id, parent, title): names from the root down, by recursion over parents."""
    nodes.select("id", "parent", F.coalesce("title", F.lit("")).alias("title")).createOrReplaceTempView("_bookmark_folders")
    return nodes.sparkSession.sql(f"""
        WITH RECURSIVE up(id, at, folder, depth, seen) AS (
          SELECT id, parent, CASE WHEN parent <> 0 THEN title ELSE '' END, 1, array(id) FROM _bookmark_folders
          UNION ALL
          SELECT up.id, f.parent, CASE WHEN f.parent <> 0 AND f.title <> '' THEN CASE WHEN up.folder = '' THEN f.title ELSE concat(f.title, '/', up.folder) END ELSE up.folder END, depth + 1, array_append(seen, f.id)
          FROM up JOIN _bookmark_folders f ON f.id = up.at WHERE depth < {deepest} AND NOT array_contains(seen, f.id))
        SELECT id, max_by(folder, depth) AS folder FROM up GROUP BY id""")


def firefox(places: DataFrame, marks: DataFrame) -> DataFrame:
    """From moz_places (id, url) and moz_bookmarks (id, type, fk, parent, title)."""
    tree = folder_paths(marks.where("type = 2").select("id", "parent", "title"))
    rows = marks.where("type = 1").select("fk", "parent", F.trim(F.coalesce("title", F.lit(""))).alias("title"))
    rows = rows.join(places.where(F.col("url").startswith("http")).select(F.col("id").alias("fk"), "url"), "fk")
    rows = rows.join(tree.select(F.col("id").alias("parent"), "folder"), "parent", "left")
    return rows.select("url", "title", F.coalesce("folder", F.lit("")).alias("folder"), F.lit("firefox").alias("browser"))


def firefox_profile(spark: SparkSession, profile: str) -> DataFrame:
    """Reads a profile's store on the driver; one person's bookmarks are small."""
    try:
        db = sqlite3.connect(f"file:{os.path.join(profile, 'places.sqlite')}?immutable=1", uri=True)
        places = db.execute("SELECT id, url FROM moz_places").fetchall()
        marks = db.execute("SELECT id, type, fk, parent, title FROM moz_bookmarks").fetchall()
        db.close()
    except sqlite3.Error:
        return spark.createDataFrame([], SCHEMA)
    return firefox(spark.createDataFrame(places, "id long, url string"), spark.createDataFrame(marks, "id long, type int, fk long, parent long, title string"))


def _leaves(node: dict, trail: tuple[str, ...]):
    stack = [(node, trail)]
    while stack:
        n, t = stack.pop()
        if n.get("type") == "url":
            if str(n.get("url", "")).startswith("http"):
                yield n["url"], (n.get("name") or "").strip(), "/".join(t)
            continue
        t = (*t, n["name"]) if n.get("name") else t
        stack.extend((c, t) for c in reversed(n.get("children") or []))


def chromium_json(raw: str, browser: str) -> list[tuple[str, str, str, str]]:
    try:
        roots = json.loads(raw).get("roots") or {}
    except (json.JSONDecodeError, AttributeError):
        return []
    return [(*x, browser) for r in roots.values() if isinstance(r, dict) for x in _leaves(r, ())]


def chromium(spark: SparkSession, home: str, browser: str) -> DataFrame:
    path = os.path.join(home, CHROMIUM[browser])
    rows = []
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            rows = chromium_json(f.read(), browser)
    return spark.createDataFrame(rows, SCHEMA)
