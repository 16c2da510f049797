"""Changes to tables kept as immutable files: each returns the table as it is after the change."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_rows(old: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """Insert or replace: rows of ``new`` take the place of all rows with their key; columns that ``new`` lacks become NULL."""
    return old.join(new.select(*by).distinct(), list(by), "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_rows(old: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """Insert new keys; of known keys change the columns that ``new`` has, to NULL too."""
    return update_rows(old, new, by).unionByName(new.join(old.select(*by).distinct(), list(by), "left_anti"), allowMissingColumns=True)


def update_rows(old: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """Change known keys and ignore others. Of several new rows with one key the greatest by the changed columns counts, so no row is multiplied."""
    changed = [c for c in new.columns if c not in by and c in old.columns]
    one = new.groupBy(*by).agg(F.max(F.struct(F.lit(True).alias("hit"), *changed)).alias("_new"))
    joined = old.join(one, list(by), "left")
    return joined.select(*[F.when(F.col("_new.hit"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in old.columns])


def checked_update(old: DataFrame, new: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The table with known keys changed, and the new rows that were refused, with ``reason``: ``unknown key`` or ``repeated key``.

    Rows of a key that occurs more than once in ``new`` are all refused.
    """
    times = new.groupBy(*by).agg(F.count("*").alias("_times"))
    known = old.select(*by).distinct().withColumn("_known", F.lit(True))
    judged = new.join(times, list(by)).join(known, list(by), "left")
    reason = F.when(F.col("_known").isNull(), "unknown key").when(F.col("_times") > 1, "repeated key")
    refused = judged.withColumn("reason", reason).where("reason is not null").select(*new.columns, "reason")
    return update_rows(old, judged.where(reason.isNull()).select(*new.columns), by), refused


def checked_insert(old: DataFrame, new: DataFrame, by: Sequence[str], defaults: Mapping[str, Any] | None = None) -> tuple[DataFrame, DataFrame]:
    """The table with new keys added, and the rows refused, with ``reason``: ``known key`` or ``repeated key``.

    Columns that ``new`` lacks have their default, or NULL.
    """
    times = new.groupBy(*by).agg(F.count("*").alias("_times"))
    known = old.select(*by).distinct().withColumn("_known", F.lit(True))
    judged = new.join(times, list(by)).join(known, list(by), "left")
    reason = F.when(F.col("_known"), "known key").when(F.col("_times") > 1, "repeated key")
    refused = judged.withColumn("reason", reason).where("reason is not null").select(*new.columns, "reason")
    good = judged.where(reason.isNull()).select(*new.columns)
    types = dict(old.dtypes)
    good = good.withColumns({c: F.lit(v).cast(types[c]) for c, v in (defaults or {}).items() if c in types and c not in new.columns})
    return old.unionByName(good, allowMissingColumns=True), refused


def insert_rows(old: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """Insert new keys and leave known ones."""
    return old.unionByName(new.join(old.select(*by).distinct(), list(by), "left_anti"), allowMissingColumns=True)


def delete_rows(old: DataFrame, keys: DataFrame, by: Sequence[str]) -> DataFrame:
    return old.join(keys.select(*by).distinct(), list(by), "left_anti")


def purge_generations(df: DataFrame, current: DataFrame, by: Sequence[str], stamp: str) -> DataFrame:
    """Of the keys in ``current`` keep only rows of its stamp; other keys stay."""
    c = current.select(*by, F.col(stamp).alias("_stamp")).distinct()
    return df.join(c, list(by), "left").where(F.col("_stamp").isNull() | (F.col(stamp) == F.col("_stamp"))).drop("_stamp")


def add_columns(df: DataFrame, columns: Mapping[str, str | tuple[str, Any]]) -> DataFrame:
    """Columns that the table lacks: a type gives NULL, a type and a value that value. A column that is there stays as it is."""
    kind = lambda t: t if isinstance(t, tuple) else (t, None)
    return df.withColumns({c: F.lit(kind(t)[1]).cast(kind(t)[0]) for c, t in columns.items() if c not in df.columns})


def migrate(df: DataFrame, columns: Mapping[str, str | tuple[str, Any]]) -> DataFrame:
    """A table of an earlier schema as one of the present: columns it lacks are added, and a default takes the place of NULL where one is given."""
    filled = add_columns(df, columns)
    return filled.withColumns({c: F.coalesce(F.col(c), F.lit(t[1]).cast(t[0])) for c, t in columns.items() if isinstance(t, tuple) and t[1] is not None})


def duplicate_keys(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keys with several rows and how many."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def write_version(df: DataFrame, folder: str, version: int | None = None) -> int:
    """The table as the next numbered version under a folder; a version is complete or not there at all."""
    spark = df.sparkSession
    n = (latest_version(spark, folder) or 0) + 1 if version is None else version
    # What an earlier, failed write left under this number is no version and is written over.
    df.write.mode("overwrite").parquet(f"{folder}/v{n:06d}")
    return n


def latest_version(spark: SparkSession, folder: str) -> int | None:
    """The greatest finished version under a folder, by the marker that Spark writes last."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return None
    found = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    done = [int(n[1:]) for n in found if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return max(done, default=None)


def read_version(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    n = latest_version(spark, folder) if version is None else version
    if n is None:
        raise FileNotFoundError(f"no version under {folder}")
    return spark.read.parquet(f"{folder}/v{n:06d}")


#: Parts by key hash of a table that is kept up to date in place.
BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def keyed_versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions of a keyed table, the last one last."""
    fs, p = _fs(spark, f"{folder}/versions")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[1:-5]) for n in names if n[:1] == "v" and n.endswith(".json") and n[1:-5].isdigit())


def _manifest(spark: SparkSession, folder: str, version: int) -> dict:
    fs, p = _fs(spark, f"{folder}/versions/v{version:06d}.json")
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def read_keyed(spark: SparkSession, folder: str, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
    """A version (default: the last) of a table that ``change_keyed`` keeps, or only some of its parts."""
    versions = keyed_versions(spark, folder)
    if not versions:
        raise FileNotFoundError(f"no version under {folder}")
    m = _manifest(spark, folder, versions[-1] if version is None else version)
    paths = [f"{folder}/{path}" for part, path in sorted(m["parts"].items(), key=lambda x: int(x[0])) if only is None or int(part) in only]
    reader = spark.read.schema(m["schema"])
    return reader.parquet(*paths) if paths else spark.createDataFrame([], m["schema"])


def change_keyed(spark: SparkSession, folder: str, new: DataFrame, by: Sequence[str], change: Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame],
    buckets: int = BUCKETS) -> int:
    """Apply a change by key to a table that is kept in parts by key hash, and return the new version.

    Only the parts that keys of ``new`` fall into are read and written again; the others are taken over by name.
    A version exists once its list of parts does, and that is renamed into place, so a reader never sees half of
    one, and what a failed run left is written over. One writer per table; the number of parts stays as it was
    first. At most ``buckets`` numbers come to the driver.
    """
    versions = keyed_versions(spark, folder)
    last = _manifest(spark, folder, versions[-1]) if versions else {"parts": {}, "buckets": buckets}
    n = (versions[-1] if versions else 0) + 1
    part = F.pmod(F.xxhash64(*by), F.lit(last["buckets"])).cast("int")
    touched = [r[0] for r in new.select(part.alias("p")).distinct().collect()]
    if versions and not touched:
        return versions[-1]
    after = change(read_keyed(spark, folder, only=touched), new, by) if versions else new
    data = f"data/v{n:06d}"
    after.withColumn("key_hash", part).repartition("key_hash").write.mode("overwrite").partitionBy("key_hash").parquet(f"{folder}/{data}")
    fs, p = _fs(spark, f"{folder}/{data}")
    written = {s.getPath().getName().partition("=")[2] for s in fs.listStatus(p) if s.getPath().getName().startswith("key_hash=")}
    parts = {k: v for k, v in last["parts"].items() if int(k) not in touched} | {k: f"{data}/key_hash={k}" for k in written}
    text = json.dumps({"parts": parts, "buckets": last["buckets"], "schema": ", ".join(f"`{c}` {t}" for c, t in after.dtypes)})
    fs, made = _fs(spark, f"{folder}/versions/.v{n:06d}.json")
    out = fs.create(made, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(made, _fs(spark, f"{folder}/versions/v{n:06d}.json")[1])
    return n
