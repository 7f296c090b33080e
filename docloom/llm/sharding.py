"""Operator 6: size-tiered compaction of small immutable shards under a versioned manifest.

Under a root folder, data/set=<name>/part=<n> are immutable units of rows: an append adds a set with a
part for each arrival, a compaction one with a part for each file that it makes. A version's manifest
lists the live units. A compaction reads the latest manifest and the sets that came since, and rewrites
only what is due: in a size tier (a power of four of bytes) with FAN small units or more, these are
merged in order of arrival into files near the target; a unit far beyond the target is split. All
other units are carried over by name. A manifest is written whole under another name and published by
giving it its own in one step that fails where the name is taken: a reader sees the old units or the new
ones, of two writers with one base the second starts again, and a writer that dies leaves nothing that counts.
That step is a hard link on local file systems and a rename without overwriting elsewhere; HDFS and file systems like
it do this atomically, an object store without a conditional write does not, and needs one writer at a time.
Only DataFrame operations; the driver holds names of sets, not rows.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docloom.llm.common import discard, shared_dir, stash, table

#: Ids per arriving batch; bytes of text of a finished file; small units of a tier that make it due.
ARRIVAL_IDS, TARGET_BYTES, FAN = 2000, 64 << 20, 4
UNITS = "set string, part long, tier long, run long, piece long, unit_rows long, unit_bytes long, first_arrival long, last_arrival long"


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _create(spark: SparkSession, path: str, content: str) -> None:
    fs, p = _folder(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(content.encode()))
    out.close()


def _publish(spark: SparkSession, path: str, content: str) -> bool:
    """A new file that appears whole or not at all; False if the name is taken. A name that a dead writer left on an empty or cut file is taken too."""
    folder, _, name = path.rpartition("/")
    aside = f"{folder}/_{name}-{uuid.uuid4().hex}"
    _create(spark, aside, content)
    (fs, source), target = _folder(spark, aside), _folder(spark, path)[1]
    try:
        if fs.getScheme() == "file":
            place = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
            spark._jvm.java.nio.file.Files.createLink(place(target), place(source))
        else:
            context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(source, target, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        return False
    finally:
        fs.delete(source, False)


def _content(spark: SparkSession, path: str) -> str:
    fs, p = _folder(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def _add_set(rows: DataFrame, root: str, name: str, n: int | None = None) -> None:
    """Write rows (with a column part) aside and let the finished set appear by one rename to its new name."""
    spark, aside = rows.sparkSession, f"{root}/data/_{name}"
    rows.write.option("compression", "zstd").partitionBy("part").parquet(aside)
    _create(spark, f"{aside}/_schema", rows.drop("part").schema.json())
    fs, p = _folder(spark, aside)
    if not fs.rename(p, _folder(spark, f"{root}/data/set={name}")[1]):
        raise OSError(f"could not name set {name}")


def append(docs: DataFrame, root: str, arrival: Column, nbytes: Column, key: Column) -> None:
    """Add rows as a new set of small shards, one for each arrival (null: -1). Files are only ever added.

    All columns are kept, whatever their names, in one struct. nbytes (null: 0) is the size that tiers
    and files are measured by; key deals the rows of a shard that is split.
    """
    deal = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    own = [F.coalesce(arrival.cast("long"), F.lit(-1)).alias("arrival"), F.coalesce(nbytes.cast("long"), F.lit(0)).alias("bytes"), deal.alias("deal")]
    _add_set(docs.select(F.struct("*").alias("row"), *own).withColumn("part", F.col("arrival")), root, f"a-{uuid.uuid4().hex}")


def _merged(schemas: list[StructType]) -> StructType:
    """One schema for sets written at different times: a column that a set lacks is null in its rows."""
    fields: dict[str, StructField] = {}
    for f in (f for s in schemas for f in s["row"].dataType):
        if fields.setdefault(f.name, f).dataType != f.dataType:
            raise ValueError(f"column {f.name} has two types: {fields[f.name].dataType.simpleString()} and {f.dataType.simpleString()}")
    own = [StructField(c, LongType()) for c in ("arrival", "bytes", "deal")]
    return StructType([StructField("row", StructType([StructField(f.name, f.dataType) for f in fields.values()])), *own])


def _rows(spark: SparkSession, root: str, schema: StructType, sets: list[str]) -> DataFrame:
    full = StructType([*schema.fields, StructField("set", StringType()), StructField("part", LongType())])
    if not sets:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in full])
    return spark.read.schema(full).option("basePath", f"{root}/data").parquet(*[f"{root}/data/set={s}" for s in sets])


def plan(units: DataFrame, target_bytes: int = TARGET_BYTES, fan: int = FAN) -> DataFrame:
    """units -> also kind, group, pieces and move; tier for all, run and piece for those without.

    tier: half the bit length of the unit's bytes. kind: 2 for a unit over one and a half targets, 1 for
    one over half of it, else 0. Where a tier has `fan` units of kind 0 they form groups by the place
    of their first byte, in order of arrival, in units of the target; any other unit is its own group.
    A group makes `pieces` files (1, or for a large unit its size in targets); move: whether it is
    rewritten. A run is named by its group's first arrival. One row for each unit, not for each document.
    """
    b = F.col("unit_bytes")
    kind = F.when(b * 2 > 3 * target_bytes, 2).when(b * 2 >= target_bytes, 1).otherwise(0)
    df = units.withColumns({"tier": F.floor(F.length(F.bin("unit_bytes")) / 2).cast("long"), "kind": kind})
    peers = Window.partitionBy("tier", "kind")
    order = peers.orderBy("first_arrival", "set", "part")
    due = (F.col("kind") == 0) & (F.count("*").over(peers) >= fan)
    df = df.withColumn("group", F.when(due, F.floor((F.sum(b).over(order) - b) / target_bytes)).otherwise(-F.row_number().over(order)).cast("long"))
    group = Window.partitionBy("tier", "kind", "group")
    df = df.withColumns({
        "pieces": F.when(F.col("kind") == 1, 1).otherwise(F.greatest(F.lit(1), F.round(F.sum(b).over(group) / target_bytes))).cast("long"),
        "first": F.min("first_arrival").over(group), "members": F.count("*").over(group),
    })
    df = df.withColumn("move", (F.col("members") > 1) | (F.col("pieces") > 1))
    return df.withColumns({"run": F.when(F.col("move"), F.col("first")).otherwise(F.coalesce("run", "first")), "piece": F.coalesce("piece", F.lit(0).cast("long"))}).drop("first", "members")


def _numbers(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all manifest files, newest first."""
    found = (re.fullmatch(r"version-(\d+)", n) for n in _names(spark, f"{root}/manifest"))
    return sorted((int(m[1]) for m in found if m), reverse=True)


def _readable(spark: SparkSession, root: str, version: int) -> bool:
    """Whether a manifest is whole."""
    try:
        return {"units", "taken", "retired", "schema"} <= json.loads(_content(spark, f"{root}/manifest/version-{version}")).keys()
    except (ValueError, AttributeError):
        return False


def versions(spark: SparkSession, root: str) -> list[int]:
    """All versions whose manifests are whole."""
    return [v for v in reversed(_numbers(spark, root)) if _readable(spark, root, v)]


def latest(spark: SparkSession, root: str) -> int:
    """The newest version whose manifest is whole, or 0. An empty or cut file is passed over; its number is not used again."""
    return next((v for v in _numbers(spark, root) if _readable(spark, root, v)), 0)


def _manifest(spark: SparkSession, root: str, version: int) -> tuple[DataFrame, dict]:
    """The live units of a version, and what else its file names: the sets taken in so far, those without a live unit, and the rows' schema."""
    info = json.loads(_content(spark, f"{root}/manifest/version-{version}")) if version else {"units": None, "taken": [], "retired": [], "schema": None}
    held = spark.read.schema(UNITS)
    if info["units"]:
        return held.parquet(f"{root}/manifest/{info['units']}"), info
    return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in UNITS.split(", "))]), info


def _compacted(spark: SparkSession, root: str, base: int, target_bytes: int, fan: int) -> tuple[dict, list[str]]:
    """Rewrite what is due on a base version; what the next version's file says, and the folders to remove if it is not published."""
    held, info = _manifest(spark, root, base)
    there = [n.partition("=")[2] for n in _names(spark, f"{root}/data") if n.startswith("set=")]
    fresh = sorted(s for s in there if s.startswith("a-") and s not in info["taken"])
    schemas = [StructType.fromJson(json.loads(x)) for x in ([info["schema"]] if info["schema"] else []) + [_content(spark, f"{root}/data/set={s}/_schema") for s in fresh]]
    schema = _merged(schemas) if schemas else None
    if fresh:
        arrived = _rows(spark, root, schema, fresh).groupBy("set", "part").agg(
            F.count("*").alias("unit_rows"), F.sum("bytes").alias("unit_bytes"), F.min("arrival").alias("first_arrival"), F.max("arrival").alias("last_arrival")
        )
        held = held.unionByName(arrived, allowMissingColumns=True)
    # written out, the plan's size is known before the join: it is broadcast if small, and the rows then move only once
    planned = stash(plan(held, target_bytes, fan), "shard-plan")
    groups = planned.where("move").groupBy("tier", "kind", "group").agg(F.max("pieces").alias("pieces"), F.min("run").alias("run"))
    groups = groups.withColumn("base", F.sum("pieces").over(Window.orderBy("tier", "kind", "group")) - F.col("pieces"))  # a row for each group of files
    groups = stash(groups, "shard-groups")
    files = groups.agg(F.sum("pieces")).first()[0] or 0
    live, made = planned.where("NOT move").select(*held.columns), []
    if files:
        name = f"c-{uuid.uuid4().hex}"
        made.append(f"{root}/data/set={name}")
        due = planned.where("move").select("set", "part", "tier", "kind", "group").join(groups.select("tier", "kind", "group", "base", "pieces"), ["tier", "kind", "group"])
        due = stash(due.select("set", "part", "base", "pieces"), "shards-due")
        sets = [r["set"] for r in due.select("set").distinct().collect()]
        rows = _rows(spark, root, schema, sets).join(due, ["set", "part"])
        rows = rows.withColumn("part", F.col("base") + F.col("deal") % F.col("pieces")).select(*schema.fieldNames(), "part")
        _add_set(rows.repartitionById(files, F.col("part").cast("int")), root, name)
        new = _rows(spark, root, schema, [name]).groupBy("part").agg(
            F.count("*").alias("unit_rows"), F.sum("bytes").alias("unit_bytes"), F.min("arrival").alias("first_arrival"), F.max("arrival").alias("last_arrival")
        )
        named = groups.select("tier", "run", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
        named = named.select("tier", "run", "piece", (F.col("base") + F.col("piece")).alias("part"))
        live = live.unionByName(new.join(named, "part").withColumn("set", F.lit(name)).select(*held.columns))
    units = f"units-{uuid.uuid4().hex}"
    live.select(*[x.split()[0] for x in UNITS.split(", ")]).coalesce(1).write.parquet(f"{root}/manifest/{units}")
    made.append(f"{root}/manifest/{units}")
    kept = {r["set"] for r in spark.read.schema(UNITS).parquet(f"{root}/manifest/{units}").select("set").distinct().collect()}
    before = {r["set"] for r in planned.select("set").distinct().collect()}
    retired = sorted((before | {s for s in [*info["retired"], *fresh] if s in there}) - kept)
    discard(planned, groups)
    taken = [s for s in [*info["taken"], *fresh] if s in there]
    return {"units": units, "taken": taken, "retired": retired, "schema": schema.json() if schema else None}, made


def compact(spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan: int = FAN, attempts: int = 5) -> int:
    """Merge what is due of the live units and of the sets appended since, and publish the next version; returns its number.

    Nothing that a manifest names is changed or removed. A compaction that fails, or whose number
    another writer took meanwhile, leaves nothing that a manifest names; in the latter case it begins again.
    """
    for _ in range(attempts):
        version = max(_numbers(spark, root), default=0) + 1
        info, made = _compacted(spark, root, latest(spark, root), target_bytes, fan)
        if _publish(spark, f"{root}/manifest/version-{version}", json.dumps(info)):
            return version
        for path in made:
            _remove(spark, path)
    raise RuntimeError(f"other writers published first {attempts} times")


def vacuum(spark: SparkSession, root: str) -> None:
    """Delete the sets of which the latest version names no unit. Older versions can't be read after that."""
    version = latest(spark, root)
    for s in _manifest(spark, root, version)[1]["retired"]:
        _remove(spark, f"{root}/data/set={s}")


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a published version (the latest by default): row (a struct of all their columns), arrival, bytes, and shard (a struct of the unit that holds them)."""
    version = version or latest(spark, root)
    units, info = _manifest(spark, root, version)
    if info["schema"] is None:
        raise ValueError("nothing was ever appended")
    sets = [r["set"] for r in units.select("set").distinct().collect()]
    rows = _rows(spark, root, StructType.fromJson(json.loads(info["schema"])), sets).join(units, ["set", "part"])
    return rows.select("row", "arrival", "bytes", F.struct("set", "part", "tier", "run", "piece", "unit_rows", "unit_bytes", F.lit(version).cast("long").alias("version")).alias("shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents through append, compact and a read of the published version. A null text has 0 bytes, an empty table no rows."""
    root = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    key = F.concat_ws("/", F.col("doc_id").cast("string"), F.md5("text"))
    append(table(spark, sf_dir, "documents"), root, F.floor(F.col("doc_id") / ARRIVAL_IDS), F.octet_length("text"), key)
    version = compact(spark, root)
    vacuum(spark, root)
    own = [F.col(f"shard.{c}") for c in ("tier", "run", "piece")] + [F.col("shard.unit_rows").alias("file_rows"), F.col("shard.unit_bytes").alias("file_bytes"), F.col("shard.version")]
    return read(spark, root, version).select(F.col("row.doc_id").alias("doc_id"), F.col("bytes").alias("n_bytes"), "arrival", *own)


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, CAST(coalesce(floor(doc_id / {ARRIVAL_IDS}), -1) AS BIGINT) AS arrival,
         CAST('0x' || substr(md5(concat_ws('/', CAST(doc_id AS VARCHAR), md5(text))), 1, 8) AS BIGINT) AS deal
  FROM documents),
s AS (SELECT arrival, CAST(sum(n_bytes) AS BIGINT) AS b FROM d GROUP BY arrival),
t AS (SELECT *, CAST(length(bin(b)) // 2 AS BIGINT) AS tier, CASE WHEN b * 2 > 3 * {TARGET_BYTES} THEN 2 WHEN b * 2 >= {TARGET_BYTES} THEN 1 ELSE 0 END AS kind FROM s),
g AS (
  SELECT *, CASE WHEN kind = 0 AND count(*) OVER (PARTITION BY tier, kind) >= {FAN}
                 THEN CAST((sum(b) OVER (PARTITION BY tier, kind ORDER BY arrival) - b) // {TARGET_BYTES} AS BIGINT)
                 ELSE -row_number() OVER (PARTITION BY tier, kind ORDER BY arrival) END AS grp
  FROM t),
p AS (
  SELECT *, min(arrival) OVER w AS run, CASE WHEN kind = 1 THEN 1 ELSE greatest(1, CAST(round(sum(b) OVER w / {TARGET_BYTES}.0) AS BIGINT)) END AS pieces
  FROM g WINDOW w AS (PARTITION BY tier, kind, grp)),
f AS (SELECT doc_id, n_bytes, d.arrival, tier, run, CAST(deal % pieces AS BIGINT) AS piece FROM d JOIN p USING (arrival))
SELECT *, count(*) OVER w AS file_rows, CAST(sum(n_bytes) OVER w AS BIGINT) AS file_bytes, CAST(1 AS BIGINT) AS version
FROM f WINDOW w AS (PARTITION BY tier, run, piece)
"""
