"""A kept table of chunks, upserted by parts.

Rows lie in folders by a hash of their file. An update reads and rewrites the folders of new,
changed and deleted files only, beside the old ones; then one small file, the manifest of the
new version, names the folder of every part. Readers take the newest manifest, so they see
all of an update or nothing of it; a failed update leaves the table as it was, and the same
update again repairs it. Untouched parts keep their files.

    path/data/version=3/part=17/...      path/manifest/version=3/...
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.sources.shared import delete

PARTS = 256


class Store:
    """The table at ``path``; ``key`` is the column by which rows are replaced (a null key is one too)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "file", parts: int = PARTS):
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), key, parts

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def manifest(self) -> dict | None:
        """``version``, ``schema`` and ``parts`` (the version of each) of the newest version; None if there is none."""
        try:
            rows = self.spark.read.schema("value string, version long").text(f"{self.path}/manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        newest = rows.where("value is not null").orderBy(F.col("version").desc()).first()
        return newest and json.loads(newest["value"]) | {"version": newest["version"]}

    def _read(self, manifest: dict, parts: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        at = [f"{self.path}/data/version={v}/part={p}" for p, v in manifest["parts"].items() if parts is None or int(p) in parts]
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*at)

    def read(self) -> DataFrame:
        """All rows of the newest version; no version is a ``LookupError``."""
        manifest = self.manifest()
        if manifest is None:
            raise LookupError(f"there is no table at {self.path} yet")
        return self._read(manifest)

    def update(self, gone: DataFrame, fresh: DataFrame) -> list[int]:
        """Put ``fresh`` rows in, for those of their keys and of ``gone`` (the column ``key``);
        the touched parts are returned, ``parts`` numbers at most.

        All rows of a key in ``fresh`` replace all that the table has of it.
        """
        manifest = self.manifest() or {"version": 0, "schema": fresh.schema.jsonValue(), "parts": {}}
        out = gone.select(self.key).union(fresh.select(self.key)).distinct()
        touched = sorted(r["part"] for r in out.select(self._part().alias("part")).distinct().collect())
        version = manifest["version"] + 1
        old = self._read(manifest, touched)
        stay = old.join(out.withColumnRenamed(self.key, "_gone"), F.col(self.key).eqNullSafe(F.col("_gone")), "left_anti")
        data = f"{self.path}/data/version={version}"
        rows = stay.unionByName(fresh.select(*stay.columns)).withColumn("part", self._part())
        # a rebalance splits a part that one file fills
        rows.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(data)
        written = self.spark.read.schema("part int").parquet(data).select("part").distinct().collect() if touched else []
        parts = {p: v for p, v in manifest["parts"].items() if int(p) not in touched} | {str(r["part"]): version for r in written}
        self._commit(version, {"schema": manifest["schema"], "parts": parts})
        return touched

    def _commit(self, version: int, manifest: dict) -> None:
        """From here on the version is there; of two writers the second fails."""
        said = self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1)
        said.write.mode("errorifexists").text(f"{self.path}/manifest/version={version}")

    def vacuum(self) -> None:
        """Delete what the newest version doesn't name; nobody may read an older one."""
        manifest = self.manifest()
        for version in range(1, manifest["version"] if manifest else 0):
            held = [int(p) for p, v in manifest["parts"].items() if v == version]
            for part in set(range(self.parts)) - set(held):
                delete(self.spark, f"{self.path}/data/version={version}/part={part}")
            delete(self.spark, f"{self.path}/manifest/version={version}")
