"""Keyed collections that are appended to and merged when they are read.

Version n of a collection is a list of segments: folders of Parquet files
with at most one row per key. A batch is written as one segment, so what an
upsert writes follows its batch, not the collection. At reading, the newest
segment that has a key wins, column by column where batches merge. Small
segments are compacted like the digits of a binary number: two neighbours
become one when the older has no more than twice the rows of the newer one,
so a row is written again as often as its collection doubles.

Each segment has a filter: two bits for each of its keys in a bitmap. A
lookup reads only the segments whose filter has the bits of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "key string, schema string, segments array<struct<name: string, n: long, first: int, last: int>>"
#: Bits of a filter for each key, and in one of its rows; hash functions.
FILTER_BITS, ROW_BITS, HASHES = 16, 32_768, 2


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    """The key, schema and segments, oldest first, of version `version` of the collection at `path`."""
    row = spark.read.schema(MANIFEST).json(f"{path}/manifest/v={version}").first()
    return {"key": row["key"], "schema": row["schema"], "segments": [tuple(s) for s in row["segments"] or []]}


def _merged(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key of rows with `_v`, the number of their segment, and `_whole`, whether one replaces all that is older.

    A column's value is that of the newest row that has one, nulls counting
    as values in rows that replace. Partial results are built in each task,
    so a key with many rows costs a task no more than another.
    """
    values = [c for c in columns if c != key]
    held = rows.select(key, "_v", "_whole", *[F.when(F.col("_whole") | F.col(c).isNotNull(), F.struct(F.col(c).alias("x"))).alias(c) for c in values])
    newest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_v"))).alias(c)
    one = held.groupBy(key).agg(F.max("_whole").alias("_whole"), *map(newest, values))
    return one.select(*[F.col(key) if c == key else F.col(c)["x"].alias(c) for c in columns], "_whole")


def _read(spark: SparkSession, path: str, held: dict, segments: list[tuple]) -> DataFrame:
    """The rows of some segments with `_v` and `_whole`."""
    rows = spark.createDataFrame([], f"{held['schema']}, _whole boolean, _v int")
    for name, _, _, last in segments:
        rows = rows.unionByName(spark.read.schema(f"{held['schema']}, _whole boolean").parquet(f"{path}/rows/{name}").withColumn("_v", F.lit(last)))
    return rows


def _columns(spark: SparkSession, held: dict) -> list[str]:
    return spark.createDataFrame([], held["schema"]).columns


def collection(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The rows of version `version` of the collection at `path`; a single segment is read as it is."""
    held = _manifest(spark, path, version)
    rows = _read(spark, path, held, held["segments"])
    return rows.drop("_whole", "_v") if len(held["segments"]) == 1 else _merged(rows, held["key"], _columns(spark, held)).drop("_whole")


def _bits(key: Column, n: Column | int) -> list[Column]:
    """The places of a key in a filter for n keys."""
    size = F.greatest(F.lit(1), F.ceil(F.lit(n) * FILTER_BITS / ROW_BITS)) * ROW_BITS
    return [F.pmod(F.xxhash64(F.lit(i), key), size) for i in range(HASHES)]


def _write(spark: SparkSession, path: str, name: str, rows: DataFrame, key: str) -> int:
    """Writes a segment and its filter; returns its rows. What stands there from a failed run is replaced."""
    rows.sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/rows/{name}")
    kept = spark.read.parquet(f"{path}/rows/{name}")
    n = kept.count()
    place = kept.select(F.explode(F.array(*_bits(F.col(key), n))).alias("at"))
    row, bit = F.floor(F.col("at") / ROW_BITS).alias("row"), (F.col("at") % ROW_BITS).alias("bit")
    place.select(row, bit).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).write.mode("overwrite").parquet(f"{path}/filter/{name}")
    return n


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str, ts: str, version: int, merge: bool = True, keep: int = 3) -> int:
    """Writes version `version` of the collection at `path` from the one before; returns it, for `collection`.

    Repeated keys: the newest row by `ts` counts. merge: null columns of a
    row keep what the collection had; otherwise a row replaces the older one.
    A segment is named by its versions and a manifest is written last, so a
    failed run leaves the last version as it was and a repeated version gives
    the same rows. Segments that none of the last `keep` manifests names are
    removed.
    """
    held = _manifest(spark, path, version - 1) if version else {"key": key, "schema": _ddl(rows), "segments": []}
    columns = _columns(spark, held)
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), ts).alias("x")).select("x.*", F.lit(not merge).alias("_whole"))
    name = f"{version}-{version}"
    segments = [*held["segments"], (name, _write(spark, path, name, newest, key), version, version)]
    while len(segments) > 1 and segments[-2][1] <= 2 * segments[-1][1]:
        older, newer = segments[-2:]
        name = f"{older[2]}-{newer[3]}"
        one = _merged(_read(spark, path, held, [older, newer]), key, columns)
        segments[-2:] = [(name, _write(spark, path, name, one, key), older[2], newer[3])]
    line = spark.createDataFrame([(key, held["schema"], segments)], MANIFEST)
    line.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/v={version}")
    _expire(spark, path, version, keep)
    return version


def segments_of(spark: SparkSession, path: str, version: int, keys: DataFrame) -> list[tuple]:
    """The segments that may have one of the keys (one column), by their filters; none that has one is missing."""
    held = _manifest(spark, path, version)
    key, found = F.col(keys.columns[0]), None
    for name, n, first, last in held["segments"]:
        places = keys.select(*[b.alias(f"b{i}") for i, b in enumerate(_bits(key, n))]).distinct().withColumn("k", F.monotonically_increasing_id())
        each = places.select("k", F.explode(F.array(*[f"b{i}" for i in range(HASHES)])).alias("at"))
        bits = spark.read.parquet(f"{path}/filter/{name}")
        met = each.join(bits, F.floor(F.col("at") / ROW_BITS) == F.col("row"))
        byte = F.conv(F.hex(F.substr("bits", F.floor(F.col("at") % ROW_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.call_function("shiftright", byte, (F.col("at") % 8).cast("int")).bitwiseAND(1) == 1
        one = met.where(hit).groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") == HASHES).limit(1).select(F.lit(name).alias("name"))
        found = one if found is None else found.unionByName(one)
    names = {r["name"] for r in found.collect()} if found is not None else set()
    return [s for s in held["segments"] if s[0] in names]


def lookup(spark: SparkSession, path: str, version: int, keys: DataFrame) -> DataFrame:
    """The rows of version `version` that have one of the keys (a column of the key's name); segments whose filter has none aren't read."""
    held = _manifest(spark, path, version)
    asked = keys.select(held["key"]).distinct()
    rows = _read(spark, path, held, segments_of(spark, path, version, asked)).join(asked, held["key"], "left_semi")
    return _merged(rows, held["key"], _columns(spark, held)).drop("_whole")


def _expire(spark: SparkSession, path: str, version: int, keep: int) -> None:
    """Removes the manifest that is `keep` versions old, and the segments that only it named or that no manifest names."""
    old = version - keep
    if old < 0:
        return
    named = {s[0] for k in range(old + 1, version + 1) for s in _manifest(spark, path, k)["segments"]}
    at = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at(f"{path}/manifest/v={old}")):
        for part in ("rows", "filter"):
            for status in fs.listStatus(at(f"{path}/{part}")):
                if status.getPath().getName() not in named:
                    fs.delete(status.getPath(), True)
        fs.delete(at(f"{path}/manifest/v={old}"), True)
