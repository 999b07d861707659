"""Tables whose versions never change: immutable data folders, and a manifest that a rename puts in place.

A version says which folder holds each partition. A change writes the partitions that it touches once, into a folder of its own, and then
renames the next manifest into place; until then readers see the version before, and a job that dies in between leaves only a folder that no
manifest names. A reader is pinned to the version it opened, so a change never takes files away under it. One writer at a time: a second one that finds its
version taken fails and can run again. Old folders stay; delete those that no wanted version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekgrain.sources.ingest import inserted, upserted


class VersionTaken(RuntimeError):
    """Another writer has put this version in place."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, partition: str = "season", files: int = 8):
        self.spark, self.path, self.partition, self.files = spark, path.rstrip("/"), partition, files
        jvm = spark._jvm.org.apache.hadoop.fs
        self._at = lambda name: jvm.Path(f"{self.path}/{name}")
        self._fs = self._at("manifest").getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest version; 0 if nothing has been written."""
        if not self._fs.exists(self._at("manifest")):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifest"))]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> dict:
        """schema, and (partition value, folder) pairs."""
        version = self.version() if version is None else version
        if version == 0:
            return {"schema": None, "folders": []}
        lines = self.spark.sparkContext.wholeTextFiles(f"{self.path}/manifest/v{version:08d}.json").values().collect()  # one small file
        return json.loads(lines[0])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version, the latest if none is named."""
        have = self.manifest(version)
        if have["schema"] is None:
            raise FileNotFoundError(f"{self.path} has no version yet")
        return self._rows(have, None)

    def _rows(self, have: dict, wanted: Sequence | None) -> DataFrame:
        schema = T.StructType.fromJson(have["schema"])
        by_folder: dict[str, list] = {}
        for value, folder in have["folders"]:
            if wanted is None or value in wanted:
                by_folder.setdefault(folder, []).append(value)
        parts = []
        for folder, values in by_folder.items():
            known = [v for v in values if v is not None]
            cond = F.col(self.partition).isin(known) if known else F.lit(False)
            parts.append(self.spark.read.schema(schema).parquet(f"{self.path}/data/{folder}").where(cond | F.col(self.partition).isNull() if None in values else cond))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def _put(self, rows: DataFrame, touched: list, have: dict, base: int) -> int:
        folder = uuid.uuid4().hex[:12]
        spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c != self.partition]), F.lit(self.files))
        rows.repartition(F.col(self.partition), spread).write.partitionBy(self.partition).parquet(f"{self.path}/data/{folder}")
        self._switch({"schema": json.loads(rows.schema.json()), "folders": [x for x in have["folders"] if x[0] not in touched] + [[v, folder] for v in touched]}, base + 1)
        return base + 1

    def _switch(self, manifest: dict, version: int) -> None:
        """Puts a complete manifest in place by one rename."""
        draft, final = self._at(f"manifest/draft-{uuid.uuid4().hex}"), self._at(f"manifest/v{version:08d}.json")
        out = self._fs.create(draft)
        out.write(json.dumps(manifest).encode())
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise VersionTaken(f"version {version} of {self.path}")

    def _touched(self, rows: DataFrame) -> list:
        return [r[0] for r in rows.select(self.partition).distinct().collect()]

    def overwrite(self, rows: DataFrame) -> int:
        """Replaces the partitions that occur in ``rows``."""
        base = self.version()
        have = self.manifest(base)
        return self._put(rows if have["schema"] is None else self._like(rows, have), self._touched(rows), have, base)

    def _like(self, rows: DataFrame, have: dict) -> DataFrame:
        """Rows with the columns of the table (missing ones null) and then those that are new."""
        schema = T.StructType.fromJson(have["schema"])
        return self.spark.createDataFrame([], schema).unionByName(rows, allowMissingColumns=True)

    def _changed(self, rows: DataFrame, change) -> int:
        base = self.version()
        have = self.manifest(base)
        touched = self._touched(rows)
        old = self._rows(have, touched) if have["schema"] else rows.limit(0)
        return self._put(change(old, rows), touched, have, base)

    def upsert(self, updates: DataFrame, keys: Sequence[str], order: str | None = None) -> int:
        """INSERT OR REPLACE by key: the touched partitions are read from this version and written once into the next. Twice the same gives the same rows."""
        return self._changed(updates, lambda old, new: upserted(old, new, keys, order))

    def insert_missing(self, rows: DataFrame, keys: Sequence[str], order: str | None = None) -> int:
        """Only rows whose key the table lacks."""
        return self._changed(rows, lambda old, new: old.unionByName(inserted(old, new, keys, order), allowMissingColumns=True))

    def replace_up_to(self, rows: DataFrame, value, column: str, limit) -> int:
        """Within one partition, rows with ``column`` up to ``limit`` are replaced by those of ``rows``; later ones stay."""
        base = self.version()
        have = self.manifest(base)
        new = rows.where((F.col(self.partition) == value) & (F.col(column) <= limit))
        old = self._rows(have, [value]) if have["schema"] else new.limit(0)
        return self._put(old.where(F.col(column) > limit).unionByName(new, allowMissingColumns=True), [value], have, base)
