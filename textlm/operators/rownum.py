"""Dense global row numbers without a single-partition window (§7.3).

``row_number() over (order by ...)`` with no partition moves every row into
one task.  Instead: range-partition + sort within partitions, materialise with
a reliable checkpoint (range bounds are sampled, so both passes must see the
same partitioning), count rows per partition (one row per partition reaches
the driver), and add each partition's offset to the local position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlm.session import ensure_checkpoint_dir

_PID_SHIFT = 1 << 33  # monotonically_increasing_id = partition id << 33 | position


def global_row_number(df: DataFrame, order: list[str | Column], name: str = "rn",
                      partitions: int | None = None) -> DataFrame:
    """``df`` plus a 0-based ``name`` column dense over ``order`` (ties keep scan order)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the scan-order tiebreaker lets the range partitioner split a run of equal
    # keys (one value may hold a third of all rows) over several partitions
    cols = [F.col(c) if isinstance(c, str) else c for c in order] + [F.col("_tb")]
    ranged = df.withColumn("_tb", F.monotonically_increasing_id()).repartitionByRange(n, *cols) \
        .sortWithinPartitions(*cols)
    fixed = ranged.checkpoint(eager=True).drop("_tb")
    tagged = fixed.select("*", F.spark_partition_id().alias("_pid"),
                          F.monotonically_increasing_id().alias("_mid"))
    off = _offsets(spark, [(r["_pid"], r["count"]) for r in tagged.groupBy("_pid").count().collect()])
    local = F.col("_mid") - F.col("_pid").cast("bigint") * F.lit(_PID_SHIFT)
    return tagged.join(F.broadcast(off), "_pid").withColumn(name, (F.col("_off") + local).cast("bigint")) \
        .drop("_pid", "_mid", "_off")


def _offsets(spark: SparkSession, totals: list[tuple[int, int]]) -> DataFrame:
    """``(_pid, _off)``: what lies before each partition; one row per partition, so it may be broadcast."""
    rows, acc = [], 0
    for pid, n in sorted(totals):
        rows.append((pid, acc))
        acc += n
    return spark.createDataFrame(rows, "_pid int, _off bigint")


def global_cumsum(df: DataFrame, order: list[str | Column], value: str, out: str,
                  partitions: int | None = None) -> DataFrame:
    """``df`` plus ``out`` = sum of ``value`` over all rows before it in ``order`` (exclusive).

    Same two passes as ``global_row_number``; the running sum inside a
    partition is a pandas ``cumsum`` over the partition's sorted batches.
    """
    from pyspark.sql import types as T

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order] + [F.col("_tb")]
    fixed = df.withColumn("_tb", F.monotonically_increasing_id()).repartitionByRange(n, *cols) \
        .sortWithinPartitions(*cols).checkpoint(eager=True).drop("_tb")
    # the partition is a column: a task may later read several of them
    tagged = fixed.withColumn("_pid", F.spark_partition_id())
    off = _offsets(spark, [(r["_pid"], r["s"] or 0)
                           for r in tagged.groupBy("_pid").agg(F.sum(value).alias("s")).collect()])
    schema = T.StructType(fixed.schema.fields + [T.StructField(out, T.LongType())])

    def run(batches):
        done = 0
        for pdf in batches:
            v = pdf[value].fillna(0).astype("int64")
            pdf[out] = (pdf["_off"] + done + v.cumsum() - v).astype("int64")
            done += int(v.sum())
            yield pdf.drop(columns=["_pid", "_off"])

    return tagged.join(F.broadcast(off), "_pid").select(*tagged.columns, "_off").mapInPandas(run, schema)
