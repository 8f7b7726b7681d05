"""Command line: index, search, similar, dupes, facets, tag-backfill.

--models names a Python module with a function register(spark, registry) that registers models (see plans.registry); a
text_embed model for searches is registered as query_embed: a function from text to a vector.
"""

from __future__ import annotations

import argparse
import importlib
import json

from siftspark.operators import tags
from siftspark.plans.ingest import Processors, backfill_tags, ingest_all
from siftspark.plans.search import SearchEngine
from siftspark.plans.store import Store
from siftspark.session import get_spark
from siftspark.sources.config import load


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftspark")
    p.add_argument("--config", required=True)
    p.add_argument("--store", required=True)
    p.add_argument("--models")
    p.add_argument("--tsv", action="store_true", help="rows as tab-separated values with a header")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index")
    s = sub.add_parser("search")
    s.add_argument("folder")
    s.add_argument("query")
    s.add_argument("-k", type=int, default=20)
    s.add_argument("--tag", action="append", default=[], choices=[t for t in tags.LABELS if t != "nsfw"])
    s.add_argument("--field", choices=("ocr", "caption"))
    s.add_argument("--mode", choices=("concat", "rrf"), default="concat")
    m = sub.add_parser("similar")
    m.add_argument("folder")
    m.add_argument("image_id")
    m.add_argument("-k", type=int, default=20)
    for x in (s, m):
        x.add_argument("--private", action="store_true", help="show what is hidden from guests too")
    sub.add_parser("dupes")
    sub.add_parser("facets")
    sub.add_parser("tag-backfill")
    return p


def printed(rows, columns: list[str], tsv: bool) -> None:
    """One line a row: JSON, or values set apart by tabs, in which tabs and line ends become blanks."""
    if tsv:
        print("\t".join(columns))
    for r in rows:
        if tsv:
            print("\t".join("" if r[c] is None else " ".join(str(r[c]).split()) for c in columns))
        else:
            print(json.dumps(r.asDict(recursive=True), ensure_ascii=False))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark, config = get_spark(), load(a.config)
    store, models = Store(spark, a.store), Processors()
    if a.models:
        importlib.import_module(a.models).register(spark, models.models)
    embed = {m: models.models.get("query_embed", m) for m in models.models.models("query_embed")}
    engine = SearchEngine(store.read, config, embed)
    if a.command == "index":
        stats = ingest_all(store, config, models)
        print(json.dumps(stats, indent=1))
        return int(any(s["failed"] or s.get("error") for s in stats.values()))
    if a.command == "tag-backfill":
        labels = models.models.get("labels", "tagger")  # a table (pos, tag, embedding)
        print(json.dumps({"tagged": backfill_tags(store, config, models, labels)}))
        return 0
    if a.command == "search":
        out = engine.search_text(a.folder, a.query, a.k, a.tag, a.field, None if a.private else engine.hidden(), a.mode)
    elif a.command == "similar":
        out = engine.similar(a.folder, a.image_id, a.k, None if a.private else engine.hidden())
    elif a.command == "facets":
        out = tags.facet_counts(store.read("tags"))
    else:
        out = engine.duplicates()
    printed(out.toLocalIterator(), out.columns, a.tsv)
    return 0
