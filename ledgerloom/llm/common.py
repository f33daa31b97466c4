"""Helpers the operators share: scratch tables, exact distributed ranks, skew-safe lookups."""

from __future__ import annotations

import math
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one sort bucket should hold; a bucket is sorted inside one task.
ROWS_PER_BUCKET = 4096
#: Tables at or under this many (narrow) rows may be broadcast after they were counted.
BROADCAST_ROWS = 100_000
#: A key of more rows than this is dealt over several tasks in a lookup.
HOT_ROWS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = spark.sparkContext.getCheckpointDir()
    if not path:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
        path = spark.sparkContext.getCheckpointDir()
    return path


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what staged() wrote for these tables; no pending plan may read them any more."""
    for table in tables:
        spark = table.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows at most limit rows, else df as it is (a shuffle join)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def stratum(col: str | Column) -> Column:
    """A non-null key in which null and '' differ."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def hash_bits(n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(0, min(40, math.ceil(math.log2(max(1, n_rows / rows_per_bucket)))))


def portable_hash(seed: int, *cols: str | Column) -> Column:
    """A signed 64-bit hash of the columns' texts, from MD5, which other engines have too."""
    texts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *texts)), 1, 16), 16, -10).cast("long")


def hash_bucket(h: Column, bits: int) -> Column:
    """Order-preserving bucket of a signed 64-bit hash: its top bits."""
    return F.shiftright(h, 64 - bits) + F.lit(1 << (bits - 1)) if bits else F.lit(0).cast("long")


def running_before(counts: DataFrame, strata: list[str], bucket: str, value: str, out: str) -> DataFrame:
    """Add to each (strata, bucket) row the sum of value over the smaller buckets of its stratum.

    Two levels, so that no window holds more than 1,024 buckets and a stratum's coarse sums.
    """
    coarse = counts.withColumn("_coarse", F.col(bucket).cast("long").bitwiseAND(F.lit(~1023)))
    top = coarse.groupBy(*strata, "_coarse").agg(F.sum(value).alias("_v"))
    before = Window.partitionBy(*(strata or [F.lit(0)])).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    top = top.select(*strata, "_coarse", F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_top"))
    within = Window.partitionBy(*strata, "_coarse").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    fine = coarse.withColumn("_fine", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return fine.join(top, [*strata, "_coarse"]).withColumn(out, F.col("_top") + F.col("_fine")).drop("_coarse", "_top", "_fine")


def exact_rank(df: DataFrame, strata: list[str], bucket: str, order: list[str | Column], out: str) -> DataFrame:
    """Rank from 1 in each stratum by (bucket, order) without sorting a stratum in one task.

    bucket must be monotone in the order and cut each stratum into pieces that one task can sort.
    """
    counts = df.groupBy(*strata, bucket).agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_before(counts, strata, bucket, "_n", "_before").drop("_n")
    within = Window.partitionBy(*strata, bucket).orderBy(*order)
    ranked = df.join(offsets, [*strata, bucket]).withColumn(out, F.col("_before") + F.row_number().over(within))
    return ranked.drop("_before")


def salted_sides(rows: DataFrame, table: DataFrame, key: str, row_id: Column, salts: int) -> tuple[DataFrame, DataFrame]:
    """rows and table with a _salt: rows of a key that many share (or of none) are dealt over so many, and only such keys of table are repeated."""
    most = max(HOT_ROWS, rows.count() // BROADCAST_ROWS)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most)
    hot = F.broadcast(staged(hot.where(F.col(key).isNotNull()).select(key, F.lit(True).alias("_hot")), "hot-keys"))
    dealt = F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int")
    left = rows.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot") | F.col(key).isNull(), dealt).otherwise(0)).drop("_hot")
    last = F.when(F.col("_hot"), salts - 1).otherwise(0)
    return left, table.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot")


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, row_id: Column, salts: int = 32) -> DataFrame:
    """Left join rows with a table of unique keys; a hot key meets many tasks. rows is read three times.

    The planner takes an exploded table for as small as its file, so it must not be one whole table many times over.
    """
    left, right = salted_sides(rows, table, key, row_id, salts)
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def ship(module: str) -> None:
    """Send this module's functions to the Python workers by value: they need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def bound_batches(spark: SparkSession, n_bytes: int = 8 << 20) -> None:
    """Cap the bytes of an Arrow batch, so that long texts or wide vectors can't fill a Python worker.

    Sets spark.sql.execution.arrow.maxBytesPerBatch of the session, for good, unless it is that low already.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > n_bytes:
        spark.conf.set(key, str(n_bytes))
