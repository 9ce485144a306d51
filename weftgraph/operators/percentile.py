"""Exact percentiles of groups of any size, and dense numbers in a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.session import written

ACCURACY = 10_000


def exact_percentile(df: DataFrame, keys: list[str], x: str, share: float, out: str, few_keys: bool = False) -> DataFrame:
    """keys and ``out``: the percentile of x (no nulls or NaN), interpolated between the two neighbouring ranks.

    A quantile sketch brackets the ranks; values outside the bracket are only counted, those inside are counted by value, and
    running counts give the ranks. No task gathers a group: only about 1/2,500 of its values reach the last step. ``few_keys``
    says that the number of groups has a proven bound, so that the brackets may be broadcast.
    """
    low, high = max(0.0, share - 2 / ACCURACY), min(1.0, share + 2 / ACCURACY)
    rows = df.select(*keys, F.col(x).cast("double").alias("_x"))
    bracket = rows.groupBy(*keys).agg(F.percentile_approx("_x", [low, high], ACCURACY).alias("_b"), F.count(F.lit(1)).alias("_n"))
    if keys:
        rows = rows.join(F.broadcast(bracket) if few_keys else bracket, keys)
    else:
        b = bracket.first()
        if not b["_n"]:
            return df.sparkSession.createDataFrame([(None,)], f"`{out}` double")
        rows = rows.withColumns({"_b": F.array(*map(F.lit, b["_b"])), "_n": F.lit(b["_n"])})
    place = F.when(F.col("_x") < F.col("_b")[0], F.lit(float("-inf"))).when(F.col("_x") > F.col("_b")[1], F.lit(float("inf"))).otherwise(F.col("_x"))
    counts = rows.withColumn("_p", place).groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    # a rank just outside the bracket is the greatest value below or the least above it
    value = F.when(F.col("_p") == float("-inf"), F.col("_hi")).otherwise(F.col("_lo"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_p"))
    c = counts.withColumns({"_v": value, "_to": upto}).withColumn("_from", F.col("_to") - F.col("_c"))
    rank = F.lit(share) * (F.col("_n") - 1)

    def pick(k: Column) -> Column:
        return F.max(F.when((F.col("_from") < k) & (F.col("_to") >= k), F.col("_v")))

    a, b = pick(F.floor(rank) + 1), pick(F.ceil(rank) + 1)
    part = F.max(rank - F.floor(rank))
    return c.groupBy(*keys).agg((a + (b - a) * part).alias(out))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``, the place of each row from 0 on in a global order, by a range-partitioned sort.

    The sorted rows are written once; each task's rows are numbered by themselves and shifted by the counts of the tasks before.
    """
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    task = F.shiftrightunsigned("_at", 33)
    sizes = placed.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))  # one row per task
    shift = sizes.select("_task", F.coalesce(before, F.lit(0)).alias("_before"))
    rows = placed.withColumn("_task", task).join(F.broadcast(shift), "_task")
    return rows.withColumn("_at", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_task", "_before").withColumnRenamed("_at", name)


def running_sum(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over the rows up to each one in a global order, this one included. As ``numbered``, with sums of
    the tasks before in place of counts; a task sums its own rows."""
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "running")
    rows = placed.withColumn("_task", F.shiftrightunsigned("_at", 33))
    sums = rows.groupBy("_task").agg(F.sum(value).alias("_s"))
    before = F.sum("_s").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))  # one row per task
    rows = rows.join(F.broadcast(sums.select("_task", F.coalesce(before, F.lit(0)).alias("_before"))), "_task")
    own = F.sum(value).over(Window.partitionBy("_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.col("_before") + own).drop("_task", "_at", "_before")
