"""Top N of every group by a global range-partitioned sort and prefix-summed counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.session import written


def top_n(df: DataFrame, group: list[str], score: str, ties: list[str], n: int, partitions: int | None = None) -> DataFrame:
    """The ``n`` rows of each group with the greatest ``score``, with their exact ``position`` from 1 on.

    All rows are range-partitioned and sorted by group, falling score and rising ``ties``, so a group with very many rows
    spreads over many tasks. Each task numbers the rows of its groups; the counts of a group in the tasks before, summed
    up as prefixes, turn these into positions in the whole group. Rows with a null, NaN or infinite score have no rank and
    are left out; null groups form a group, null ties come first. Rows equal in group, score and all ties are
    interchangeable. Other columns of ``df`` are dropped; an empty input gives an empty result.
    """
    rows = df.select(*dict.fromkeys([*group, score, *ties])).where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")))
    by = [*(F.asc_nulls_first(g) for g in group), F.desc(score), *(F.asc_nulls_first(t) for t in ties)]
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(max(1, parts), *by).sortWithinPartitions(*by)
    schema = T.StructType([*ordered.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_place", T.LongType()), T.StructField("_rows", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their place among the rows of their group in this task, up to n; then one count row for the last group."""
        part = TaskContext.get().partitionId()
        last: tuple | None = None
        count, tail = 0, None
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            new = np.zeros(size, bool)
            for g in group:
                codes = batch.column(g).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            first = tuple(batch.column(g)[0].as_py() for g in group)
            carried = count if first == last else 0
            start = np.flatnonzero(np.r_[True, new[1:]])
            place = np.arange(size) - np.repeat(start, np.diff(np.r_[start, size])) + 1
            place[: start[1] if len(start) > 1 else size] += carried
            last, count, tail = tuple(batch.column(g)[size - 1].as_py() for g in group), int(place[-1]), batch.slice(size - 1, 1)
            take = np.flatnonzero(place <= n)
            kept = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([part] * len(take), pa.int32()), pa.array(place[take], pa.int64()), pa.array([0] * len(take), pa.int64())], names=schema.names)
        if tail is not None:
            yield pa.RecordBatch.from_arrays([*tail.columns, pa.array([part], pa.int32()), pa.array([None], pa.int64()), pa.array([count], pa.int64())], names=schema.names)

    numbered = ordered.mapInArrow(number, schema)
    # only a group that runs on into later tasks has a count that others need; these are at most n + 1 rows of it per task
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(*group).orderBy("_part").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = numbered.withColumn("position", F.col("_place") + before).where(F.col("_place").isNotNull() & (F.col("position") <= n))
    return placed.drop("_part", "_place", "_rows")


def top_rows_of_vertices(current: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with the greatest finite coulomb of every build and vertex, at either end of the edge.

    ``current`` has build_id, frame, edge_key, vertex1, vertex2, coulomb and frame_block and is partitioned by (build_id,
    frame_block), one row per record. Within a block only the best ``n`` of a vertex can be among its best ``n`` at all, so
    the rest stays out of the sort. Ties: smaller edge_key, then smaller frame.
    """
    ends = current.where(F.col("coulomb").isNotNull() & ~F.isnan("coulomb") & (F.abs("coulomb") < float("inf"))).select(
        "build_id", "frame_block", "frame", "edge_key", "coulomb", F.explode(F.array_distinct(F.array("vertex1", "vertex2"))).alias("vertex_id")
    )
    within = Window.partitionBy("build_id", "frame_block", "vertex_id").orderBy(F.desc("coulomb"), "edge_key", "frame")
    best = ends.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= n).drop("_n")
    best = written(best, "best")  # the range partitioning reads its input twice
    return top_n(best, ["build_id", "vertex_id"], "coulomb", ["edge_key", "frame"], n)
