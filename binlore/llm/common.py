"""Shared helpers: staged tables, gapless ranks and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors can reach, as the cluster names it.

    A folder of our own is made only in local mode where ``spark.checkpoint.dir`` is unset (tests); a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="binlore-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/binlore/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all tables and files that this application has staged, those under results not yet read included."""
    delete_path(spark, run_dir(spark))


#: Spark deletes a plan's shuffle files when the plan has ended; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of the tables that a staged plan reads for which a file of its own is worth while, files a core below that, and most files.
FILE_BYTES, FILES_A_CORE, MOST_FILES = 1 << 20, 8, 100_000


def file_count(df: DataFrame) -> int:
    """Files that are enough for ``df``: by the bytes of all tables that it reads (most, if they are not known), and by the cores for small ones."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return min(max(FILES_A_CORE * df.sparkSession.sparkContext.defaultParallelism, size // FILE_BYTES), MOST_FILES)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage; the files outlive any executor, and the shuffle files behind them go at once. Tables that a lazy result still
    reads stay until ``release``. Small partitions are written many to a file: where the folder is of Hadoop's local file
    system, an executor starts six processes for each file, and until such a process has its own program it shares all
    memory of the executor's JVM.
    """
    spark = df.sparkSession
    df = df.coalesce(file_count(df))
    path, before = fresh_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._binlore_path = path
    return out


def local_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A table of longs from the driver's rows, sent as Arrow; a list would go through Python workers of another kind on the executors, whose server stays."""
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return spark.createDataFrame(pa.table({name: pa.array(column, pa.int64()) for name, column in zip(names, columns)}))


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        delete_path(df.sparkSession, df._binlore_path)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def rank_buckets(spark: SparkSession) -> int:
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], out: str, bucket: Column | None = None) -> DataFrame:
    """Number the rows of each key from 0 without gaps, with no task holding a whole key.

    Rows of a key are dealt into buckets (default: of a hash of ``order``), numbered inside each
    bucket, and shifted by the counts of the buckets before it. The shift table has one row per key and bucket.
    """
    b = "__bl_bucket"
    bucket = F.pmod(F.xxhash64(*order), F.lit(rank_buckets(df.sparkSession))).cast("int") if bucket is None else bucket
    dealt = df.withColumn(b, bucket)
    counts = dealt.groupBy(*keys, b).agg(F.count("*").alias("__bl_n"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("__bl_shift", F.coalesce(F.sum("__bl_n").over(before), F.lit(0)))
    shifts = shifts.select(*[F.col(k).alias(f"__bl_k{i}") for i, k in enumerate(keys)], F.col(b).alias("__bl_b"), "__bl_shift")
    within = Window.partitionBy(*keys, b).orderBy(*order)
    ranked = dealt.withColumn("__bl_r", F.row_number().over(within))
    match = F.col(b) == F.col("__bl_b")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__bl_k{i}"))
    joined = ranked.join(shifts, match)
    return joined.withColumn(out, F.col("__bl_shift") + F.col("__bl_r") - 1).drop("__bl_shift", "__bl_r", "__bl_b", b, *[f"__bl_k{i}" for i in range(len(keys))])


#: Rows up to which a lookup side is broadcast after it has been counted.
BROADCAST_ROWS = 200_000
SALTS = 32


def lookup_join(rows: DataFrame, small: DataFrame, key: str, salt_by: Column, how: str = "left") -> DataFrame:
    """Join a hot key to a table with one row per key.

    ``small`` is broadcast if its counted rows are at most ``BROADCAST_ROWS``; beyond that both sides are
    dealt by (key, salt), so that one key's rows spread over ``SALTS`` tasks.
    """
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key, how)
    salted = small.withColumn("__bl_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("__bl_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")).join(salted, [key, "__bl_salt"], how).drop("__bl_salt")


#: A key with more than this share of the rows is hot; so there are at most as many hot keys.
HOT_SHARE = 10_000


def hot_join(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, spread: Column) -> DataFrame:
    """Left join to a table with one row per key, whose ``weight`` is the key's rows out of ``total``.

    Rows of hot keys (``HOT_SHARE`` at most) meet their table rows by broadcast and are dealt by ``spread`` for the other join.
    """
    value = [c for c in table.columns if c not in (key, weight)]
    is_hot = F.col(weight) * HOT_SHARE > total
    hot = table.where(is_hot).select(F.col(key).alias("__bl_hot"), F.struct(*value).alias("__bl_h"))
    rest = table.where(~is_hot).select(F.col(key).alias("__bl_key"), F.struct(*value).alias("__bl_c"))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("__bl_hot"), "left")
    met = met.withColumn("__bl_dealt", F.when(F.col("__bl_hot").isNull(), F.col(key)).otherwise(F.xxhash64(spread)))
    found = F.when(F.col("__bl_hot").isNotNull(), F.col("__bl_h")).otherwise(F.col("__bl_c"))
    out = met.join(rest, F.col("__bl_dealt") == F.col("__bl_key"), "left").withColumn("__bl_f", found)
    return out.select(*rows.columns, *[F.col("__bl_f")[c].alias(c) for c in value])


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for long texts, where the session has Spark's default of 10,000 rows.

    There is no such option for one plan, so this holds for the session; only its default is changed, and results do not depend on it.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
