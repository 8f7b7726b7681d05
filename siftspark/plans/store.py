"""A snapshot store on any file system that Spark can write to.

A commit writes the tables it is given under a new version, then one manifest that names the version of every table;
tables that did not change are carried over by name only. The newest manifest is the store's state.

Defined cases: a store without a manifest has empty tables; what a failed commit left behind is overwritten by the next
one; files of versions that none of the last KEEP manifests names are removed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "files": "path string, folder string, image_id string, mtime double",
    "images": "id string, path string, folder string, content_hash string, mtime double, width int, height int, indexed_at double",
    "items": "id string, kind string, folder string, src_path string, title string, url string, body string, status string, created_at double",
    "text_docs": "id string, text string, source string",
    "tags": "id string, tag string, source string, score double, rank int",
    "vectors": "space string, model string, rowid bigint, id string, embedding array<float>",
}
KEEP = 3


class Store:
    """Readers see whole versions only; a failed write leaves the current one as it is."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def _manifests(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests")))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _tables(self, version: int) -> dict[str, int]:
        """The version in which each table was written last."""
        text = self.spark.read.text(f"{self.root}/manifests/{version}.json", wholetext=True).first()[0]
        return json.loads(text)

    @property
    def version(self) -> int:
        return max(self._manifests(), default=0)

    def read(self, name: str) -> DataFrame:
        at = self._tables(self.version).get(name) if self.version else None
        if at is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/v{at}/{name}")

    def commit(self, **tables: DataFrame) -> int:
        """Write the given tables and carry the others over."""
        old = self.version
        new, names = old + 1, self._tables(old) if old else {}
        self._fs.delete(self._path(f"{self.root}/v{new}"), True)  # the rest of a failed commit
        for name, df in tables.items():
            writer = df.select(*(c.split(" ")[0] for c in SCHEMAS[name].split(", "))).write
            (writer.partitionBy("space", "model") if name == "vectors" else writer).parquet(f"{self.root}/v{new}/{name}")
            names[name] = new
        draft = self._path(f"{self.root}/manifests/.{new}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(names), "utf-8"))
        out.close()
        self._fs.rename(draft, self._path(f"{self.root}/manifests/{new}.json"))
        self._clean(new)
        return new

    def _clean(self, newest: int) -> None:
        kept = [v for v in self._manifests() if v > newest - KEEP]
        used = {at for v in kept for at in self._tables(v).values()}
        for v in self._manifests():
            if v not in kept:
                self._fs.delete(self._path(f"{self.root}/manifests/{v}.json"), False)
        for s in self._fs.listStatus(self._path(self.root)):
            name = s.getPath().getName()
            if name[:1] == "v" and name[1:].isdigit() and int(name[1:]) not in used:
                self._fs.delete(s.getPath(), True)
