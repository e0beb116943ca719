"""Tables that cut lineage, bounded membership bitmaps, and running totals over ordered rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a local session without that setting gets one of its own,
    which goes with the process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tradewind-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tradewind-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: computed once, and safe from lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Texts go to Python and back in batches of about 8 MB instead of 64 MB, unless the session asks for another size.

    A batch is held several times over, by the JVM and by each Python worker beside it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") == str(64 << 20):
        spark.conf.set(name, str(8 << 20))


def membership(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """A bitmap of ``bits`` bits with one bit set per hash ``key`` (bigint), as rows (bucket, bitmap) of 4 KB.

    It holds at most ``bits / 8`` bytes whatever the input, which is why ``may_contain`` may broadcast it. Fuller
    bitmaps only let more rows through: a set bit never replaces an exact comparison.
    """
    at = F.pmod(key, F.lit(bits)) + 1
    return keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")
    )


def may_contain(df: DataFrame, key: Column, bitmaps: DataFrame, bits: int, name: str) -> DataFrame:
    """``df`` with a boolean column ``name``: false if ``key`` surely isn't among the members."""
    at = F.pmod(key, F.lit(bits)) + 1
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = F.broadcast(bitmaps).withColumnRenamed("bucket", "bucket_of_members")
    return (
        df.join(found, F.bitmap_bucket_number(at) == F.col("bucket_of_members"), "left")
        .withColumn(name, F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False)))
        .drop("bucket_of_members", "bitmap")
    )


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds, for each (name -> column) of ``sums``, the total of that bigint column over all earlier rows of the same keys.

    Rows are dealt into ranges of (keys, order), so that a key with most of the rows is spread over many tasks; each
    range adds up its own rows, and gets what the ranges before it hold. ``order`` must settle every tie. The ranges
    are sampled, hence stored before they are used twice.
    """
    part = "part_of_running"
    ranged = stored(
        df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in [*keys, *order]]).withColumn(part, F.spark_partition_id())
    )
    totals = ranged.groupBy(part, *keys).agg(*[F.sum(v).alias(f"{n}_part") for n, v in sums.items()])
    # One row per range and key within it: as many as ranges and keys, not as rows.
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(
        totals.select(
            part,
            *[F.col(k).alias(f"{k}_of_range") for k in keys],
            *[F.coalesce(F.sum(f"{n}_part").over(before), F.lit(0)).alias(f"{n}_before") for n in sums],
        ).withColumnRenamed(part, "range_of_running")
    )
    inside = (
        Window.partitionBy(part, *keys)
        .orderBy(*[F.col(c).asc_nulls_last() for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = ranged.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(n) for n, v in sums.items()])
    match = F.col(part) == F.col("range_of_running")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"{k}_of_range"))
    return (
        local.join(offsets, match)
        .select(
            *[F.col(c) for c in df.columns], *[(F.col(n) + F.col(f"{n}_before")).cast("long").alias(n) for n in sums]
        )
    )
