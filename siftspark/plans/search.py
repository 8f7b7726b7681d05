"""The search interface over a set of tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions.text import facets_of
from siftspark.operators import dedup, hits, keyword, nearest, tags
from siftspark.sources.config import Config


@dataclass
class SearchEngine:
    """Tables (see plans.store) and a configuration; embed maps a model's name to text -> vector."""

    tables: Callable[[str], DataFrame]
    config: Config
    embed: dict[str, Callable[[str], list[float]]]

    def hidden(self) -> DataFrame:
        return tags.hidden(self.tables("images"), self.tables("tags"), self.config.private)

    def search_text(self, folder: str, query: str, k: int = 20, facets: Iterable[str] = (), field: str | None = None, exclude: DataFrame | None = None, mode: str = "concat") -> DataFrame:
        """Hybrid search in one folder. concat: vector hits, then keyword hits of other ids, both cut before they
        are filtered, fetching five times k when filters are on; rrf: filtered first, fused by reciprocal ranks."""
        keyword.in_field(field)
        rest, parsed = facets_of(query)
        explicit = set(facets)
        filtered = bool(explicit or parsed or field or exclude is not None)
        fetch = max(5 * k, 100) if mode == "rrf" else 5 * k if filtered else k
        docs, model = self.tables("text_docs"), self.config.folders[folder].processors.get("text_embed")
        near = docs.sparkSession.createDataFrame([], "id string, score double")
        if model in self.embed:
            near = nearest.nearest(self.tables("vectors"), "text", model, self.embed[model](rest), None if mode == "rrf" else fetch).select("id", "score")
        words = keyword.bm25(docs, rest, None if mode == "rrf" else fetch, field).select("id", "score")
        ok = tags.allowed(self.tables("tags"), self.tables("items"), folder, explicit, parsed) if explicit or parsed else None

        def narrowed(h: DataFrame) -> DataFrame:
            h = hits.only(h, ok) if ok is not None else h
            return hits.without(h, exclude) if exclude is not None else h

        if mode == "rrf":
            near, words = ((narrowed(h).orderBy(F.desc("score"), "id").limit(fetch)) for h in (near, words))
            fused = hits.rrf(near, words, fetch).withColumn("part", F.lit(0))
        else:
            fused = narrowed(hits.concatenated(near, words))
        found = hits.resolved(fused, self.tables("images"), self.tables("items"), folder)
        return hits.cut(found, k).drop("part")

    def similar(self, folder: str, image_id: str, k: int = 20, exclude: DataFrame | None = None) -> DataFrame:
        """By the model of the image's own path, which an override may set."""
        known = self.tables("images").where(F.col("id") == image_id).select("path").first()
        settings = self.config.folders[folder]
        model = (settings.processors_for(known.path) if known else settings.processors).get("image_embed")
        if not model:
            raise ValueError(f"folder {folder!r} has no image_embed model")
        return nearest.similar(self.tables("vectors"), self.tables("images"), folder, model, image_id, k, exclude)

    def duplicates(self) -> DataFrame:
        return dedup.duplicate_groups(self.tables("files"))


def request(args: dict[str, str], folders: Iterable[str]) -> dict:
    """Checked parameters of a search request: folder must be known, k is cut to 1..100 (10 if it is no
    number), unknown facets and fields are dropped."""
    folder = args.get("folder", "")
    if folder not in set(folders):
        raise ValueError(f"unknown folder {folder!r}")
    try:
        k = int(args.get("k", 10))
    except (TypeError, ValueError):
        k = 10
    chips = [t for t in str(args.get("tags", "")).split(",") if t in tags.LABELS and t != "nsfw"]
    field = args.get("field")
    return {"folder": folder, "query": args.get("q", ""), "k": min(100, max(1, k)), "facets": chips, "field": field if field in keyword.FIELDS else None}
