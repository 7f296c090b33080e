"""A store of vectors by id: versions that are added, merged when they are read, and compacted.

A version is a folder `base-<n>` or `delta-<n>`; it counts once Spark has marked it as written. A delta has the rows of one
upsert or delete (a delete's are tombstones). A read takes the newest base and the deltas after it, and of each id the
row of the highest version. A compaction writes that as a new base. A version's number is claimed by
creating an empty file of its name, which one writer only can do, so writers need no lock; what a writer
that died has begun is never read.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a row's text that its payload keeps.
TEXT_CHARS = 500
ROWS = "id string, version long, deleted boolean, vector array<float>, payload map<string,string>"


def payload(metadata: Column, text: Column) -> Column:
    """A row's metadata without nulls, and the beginning of its text."""
    own = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (k != "text"))
    return F.map_concat(own, F.create_map(F.lit("text"), F.substring(F.coalesce(text, F.lit("")), 1, TEXT_CHARS)))


class VectorStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self, written: bool = True) -> list[tuple[int, str]]:
        """(number, kind) of all versions, or of those that are written."""
        fs, p = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        found = sorted((int(m[2]), m[1]) for n in names if (m := re.fullmatch(r"(base|delta|claim)-(\d+)", n)))
        return [(v, kind) for v, kind in found if not written or kind != "claim" and fs.exists(self._fs(f"{kind}-{v}/_SUCCESS")[1])]

    def _claim(self) -> int:
        """The next number, for this writer alone."""
        fs, p = self._fs()
        fs.mkdirs(p)
        number = max((v for v, _ in self._versions(False)), default=0)
        while True:
            number += 1
            try:
                if fs.createNewFile(self._fs(f"claim-{number}")[1]):
                    return number
            except Py4JJavaError as e:
                if "FileAlreadyExistsException" not in str(e.java_exception):
                    raise

    def _write(self, rows: DataFrame, kind: str, number: int | None = None) -> int:
        number = number or self._claim()
        rows.withColumn("version", F.coalesce("version", F.lit(number)).cast("long") if "version" in rows.columns else F.lit(number).cast("long")).select(*[c.split()[0] for c in ROWS.split(", ")]).write.parquet(f"{self.path}/{kind}-{number}")
        return number

    def upsert(self, rows: DataFrame) -> int:
        """(id, vector, metadata map, text): adds rows and replaces those whose id is there; of rows of one id in one call one stays, the greatest. Returns the version."""
        own = rows.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct(F.col("text").alias("t"), F.col("vector").cast("array<float>").alias("v"), F.to_json("metadata").alias("m"))).alias("x"))
        held = F.from_json(F.col("x.m"), "map<string,string>")
        return self._write(own.select("id", F.lit(False).alias("deleted"), F.col("x.v").alias("vector"), payload(held, F.col("x.t")).alias("payload")), "delta")

    def delete(self, ids: DataFrame) -> int:
        """(id): forgets these ids."""
        return self._write(ids.where("id IS NOT NULL").select("id").distinct().select("id", F.lit(True).alias("deleted"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("map<string,string>").alias("payload")), "delta")

    def replace(self, rows: DataFrame) -> int:
        """Exactly these rows, whatever was there."""
        own = rows.where("id IS NOT NULL").dropDuplicates(["id"])
        return self._write(own.select("id", F.lit(False).alias("deleted"), F.col("vector").cast("array<float>").alias("vector"), payload(F.col("metadata"), F.col("text")).alias("payload")), "base")

    def _merged(self, version: int | None) -> DataFrame:
        known = [(v, kind) for v, kind in self._versions() if version is None or v <= version]
        base = max((v for v, kind in known if kind == "base"), default=0)
        parts = [f"{self.path}/{kind}-{v}" for v, kind in known if v == base or v > base and kind == "delta"]
        if not parts:
            return self.spark.createDataFrame([], ROWS)
        found = self.spark.read.schema(ROWS).parquet(*parts)
        if len(parts) == 1:
            return found
        return found.groupBy("id").agg(F.max_by(F.struct("version", "deleted", "vector", "payload"), "version").alias("x")).select("id", "x.*")

    def rows(self, version: int | None = None) -> DataFrame:
        """(id, vector, payload) as of a version, the latest by default."""
        return self._merged(version).where("NOT deleted").select("id", "vector", "payload")

    def compact(self) -> int:
        """The same rows as one base, for the versions that are written by now; deltas of other writers that come meanwhile stay valid. Nothing is removed."""
        until = max((v for v, _ in self._versions()), default=0)
        late = self._merged(until).where("NOT deleted")
        # the base takes the number of the newest version that it holds, so that later ones win over it
        fs, _ = self._fs()
        if until and not fs.exists(self._fs(f"base-{until}")[1]):
            late.write.parquet(f"{self.path}/base-{until}")
        return until

    def vacuum(self) -> None:
        """Remove the versions before the newest base. Older versions can't be read after that."""
        known = self._versions()
        base = max((v for v, kind in known if kind == "base"), default=0)
        for v, kind in known:
            if v < base or v == base and kind == "delta":
                fs, p = self._fs(f"{kind}-{v}")
                fs.delete(p, True)
