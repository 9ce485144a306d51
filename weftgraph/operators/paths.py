"""Weighted graphs of networks and shortest-path profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.errors import SelectorError
from weftgraph.functions.selectors import vertex_condition
from weftgraph.functions.values import finite, graph_distance
from weftgraph.operators.neighbors import both_directions, residue_profile
from weftgraph.operators.percentile import numbered
from weftgraph.session import written

EPSILON = 2.220446049250313e-16
#: Directed arcs of one network that a single task may hold for its searches; sources that share one copy of them, and distances that are
#: relaxed at a time.
MAX_TASK_ARCS = 1_000_000
SOURCES_PER_TASK, DISTANCES_AT_ONCE = 1024, 4_000_000


def distance_graph(analysis: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Both directions of every usable edge: source, target, distance. Of several edges between two vertices the shortest stays;
    loops, values of 0 and values that are not finite are no edges."""
    by = by or []
    rows = analysis.where("vertex1 <> vertex2").select(*by, "vertex1", "vertex2", graph_distance(F.col("value"), value).alias("distance"))
    rows = rows.where(finite(F.col("distance")) & (F.col("distance") > EPSILON))
    return both_directions(rows).groupBy(*by, "source", "target").agg(F.min("distance").alias("distance"))


def _reached(source: np.ndarray, target: np.ndarray, length: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each start the vertices it reaches, itself left out, and their distances.

    Distances of many starts are relaxed together over all arcs, sorted by target, until none improves; lengths are positive, so this
    ends after as many rounds as the longest shortest path has arcs.
    """
    names, code = np.unique(np.concatenate([source, target, starts]), return_inverse=True)
    a, b, s = np.split(code, [len(source), 2 * len(source)])
    order = np.argsort(b, kind="stable")
    a, b, w = a[order], b[order], length[order]
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.empty(0, int)
    ends = b[first]
    step = max(1, DISTANCES_AT_ONCE // max(len(names), len(a), 1))
    for k in range(0, len(s), step):
        block = s[k : k + step]
        best = np.full((len(block), len(names)), np.inf)
        best[np.arange(len(block)), block] = 0.0
        while len(ends):
            new = np.minimum(np.minimum.reduceat(best[:, a] + w, first, axis=1), best[:, ends])
            if (new == best[:, ends]).all():
                break
            best[:, ends] = new
        for row, own in zip(best, block, strict=True):
            row[own] = np.inf
            found = np.flatnonzero(row < np.inf)
            yield int(names[own]), names[found], row[found]


def _prepared(graph: DataFrame, sources: DataFrame | None, by: list[str]) -> tuple[tuple[DataFrame, DataFrame] | None, tuple[DataFrame, DataFrame] | None]:
    """The stored graph and its sources, for the networks whose arcs fit one task and for the others; None where there are none."""
    graph = written(graph, "graph")
    large = graph.groupBy(*by).agg(F.count(F.lit(1)).alias("arcs")).where(F.col("arcs") > MAX_TASK_ARCS)
    starts = graph.select(*by, "source").distinct()
    if sources is not None:
        starts = starts.join(sources, [*[c for c in by if c in sources.columns], "source"], "left_semi")
    if large.isEmpty():
        return (graph, starts), None
    if not by:
        return None, (graph, starts)
    small, rest = (tuple(df.join(large, by, how) for df in (graph, starts)) for how in ("left_anti", "left_semi"))
    return small, rest


def shortest_distances(graph: DataFrame, sources: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Shortest distances from the sources (all vertices if None) to every other vertex they reach: source, target, distance.

    Networks whose arcs fit one task are searched by it from blocks of their sources; larger ones are relaxed round by
    round as joins, so that no task holds the graph.
    """
    by = by or []
    small, large = _prepared(graph, sources, by)
    schema = _schema(graph, [*by, "source", "target"]) + ", distance double"
    found = [_searched(*small, by, schema, lambda v, reached, d: [(v, w, x) for w, x in zip(reached.tolist(), d.tolist(), strict=True)])] if small else []
    if large:
        found.append(relaxed_distances(*large, by))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def vertex_path_metrics(graph: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``path_metrics`` of all vertices. Distances are summed up where they are found, so one row per vertex leaves the task
    rather than one per pair."""
    by = by or []
    small, large = _prepared(graph, None, by)
    schema = _schema(graph, by) + ", " * bool(by) + "vertex_id int, reachable_vertices long, mean_shortest_path double, median_shortest_path double, min_shortest_path double, max_shortest_path double"

    def stats(v: int, reached: np.ndarray, d: np.ndarray) -> list[tuple]:
        return [(v, len(d), d.mean(), np.median(d), d.min(), d.max())] if len(d) else []

    found = [_searched(*small, by, schema, stats)] if small else []
    if large:
        found.append(path_metrics(relaxed_distances(*large, by), by))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _schema(graph: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {graph.schema[c].dataType.simpleString()}" for c in columns)


def _searched(graph: DataFrame, starts: DataFrame, by: list[str], schema: str, rows_of: Callable[[int, np.ndarray, np.ndarray], list[tuple]]) -> DataFrame:
    """One group per network and block of sources; a group holds its network's arcs once and its block of sources, so the arcs are copied
    once for every ``SOURCES_PER_TASK`` sources."""
    block = F.pmod(F.xxhash64("source"), F.col("blocks").cast("long")).alias("block")
    blocks = starts.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / SOURCES_PER_TASK).cast("int").alias("blocks"))
    if by:
        s, g = starts.join(blocks, by), graph.join(blocks, by)
    else:
        n = F.lit(blocks.first().blocks or 1)
        s, g = starts.withColumn("blocks", n), graph.withColumn("blocks", n)
    s = s.select(*by, block, "source", F.lit(None).cast(graph.schema["target"].dataType).alias("target"), F.lit(None).cast("double").alias("distance"))
    g = g.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), "source", "target", "distance")

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        real = pdf["target"].notna()
        arcs, starts = pdf[real], pdf.loc[~real, "source"].to_numpy(np.int64)
        found = _reached(arcs["source"].to_numpy(np.int64), arcs["target"].to_numpy(np.int64), arcs["distance"].to_numpy(float), starts)
        return pd.DataFrame([(*key[:-1], *row) for v, reached, d in found for row in rows_of(v, reached, d)], columns=names)

    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return s.unionByName(g).groupBy(*by, "block").applyInPandas(search, schema)


def relaxed_distances(graph: DataFrame, starts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The same by rounds of joins: each round extends what the last one improved by one arc and keeps the shortest.

    Every round is written to the shared folder; it ends when nothing improves, which positive lengths make sure of.
    """
    by = by or []
    best = starts.select(*by, "source", F.col("source").alias("target"), F.lit(0.0).alias("distance"))
    frontier = best
    arcs = graph.select(*by, F.col("source").alias("target"), F.col("target").alias("next"), F.col("distance").alias("length"))
    key = [*by, "source", "target"]
    while True:
        step = frontier.join(arcs, [*by, "target"]).groupBy(*by, "source", F.col("next").alias("target")).agg(F.min(F.col("distance") + F.col("length")).alias("distance"))
        merged = best.withColumn("is_new", F.lit(False)).unionByName(step.withColumn("is_new", F.lit(True)))
        merged = merged.groupBy(*key).agg(F.min("distance").alias("distance"), F.min(F.when(~F.col("is_new"), F.col("distance"))).alias("old"))
        merged = written(merged, "distances")
        best = merged.drop("old")
        frontier = merged.where("old IS NULL OR distance < old").drop("old")
        if frontier.isEmpty():
            return best.where("source <> target")


def path_metrics(distances: DataFrame, by: list[str] | None = None, of: str = "source") -> DataFrame:
    """vertex_id with the count, mean, median, least and greatest distance over the vertices it reaches."""
    by = by or []
    stats = [F.count(F.lit(1)).alias("reachable_vertices")] + [f("distance").alias(f"{n}_shortest_path") for n, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))]
    return distances.groupBy(*by, F.col(of).alias("vertex_id")).agg(*stats)


def target_path_metrics(graph: DataFrame, vertices: DataFrame, target: str, by: list[str] | None = None) -> DataFrame:
    """Metrics of every vertex over its distances to the vertices of the target only; paths may lead through the whole graph."""
    by = by or []
    chosen = vertices.where(vertex_condition(target, vertices.columns)).select(F.col("vertex_id").alias("source"))
    if chosen.isEmpty():
        raise SelectorError(f"the target {target!r} matches no vertex")
    if graph.join(chosen, "source", "left_semi").isEmpty():
        raise SelectorError(f"no vertex of the target {target!r} lies in the graph")
    # distances are symmetric: search from the few targets, then group by the other end
    return path_metrics(shortest_distances(graph, chosen, by), by, of="target")


def path_profile(metrics: DataFrame, vertices: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Path metrics collapsed to residues."""
    by = by or []
    profile = residue_profile(metrics, vertices, "mean_shortest_path", by=by, category=False, prefix="shortest_path")
    rows = metrics.join(vertices.select("vertex_id", F.coalesce("molecule_type", F.lit("")).alias("molecule_type"), "molecule_instance", "residue_id"), "vertex_id").where("residue_id IS NOT NULL")
    keys = [*by, "molecule_type", "molecule_instance", "residue_id"]
    reach = rows.groupBy(*keys).agg(F.avg("reachable_vertices").alias("mean_reachable_vertices"))
    left, right = profile.alias("p"), reach.alias("r")
    same = " AND ".join(f"p.{k} <=> r.{k}" for k in keys)
    return left.join(right, F.expr(same)).select("p.*", "r.mean_reachable_vertices")


def high_res_profile(metrics: DataFrame, vertices: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Path metrics of atom vertices in order, with plot_index from 0."""
    by = by or []
    rows = metrics.join(vertices.where("kind = 'atom'").select("vertex_id", "molecule_type", "molecule_instance", "residue_id", "residue_name", "atom_nr", "atom_name", "label"), "vertex_id")
    order = [F.col("molecule_type"), F.asc_nulls_last("molecule_instance"), F.asc_nulls_last("residue_id"), F.asc_nulls_last("atom_nr"), F.col("vertex_id")]
    if not by:
        return numbered(rows, order, "plot_index").withColumn("plot_index", F.col("plot_index").cast("int"))
    return rows.withColumn("plot_index", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def path_statistics(metrics: DataFrame, vertices: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct means (to 12 decimals), their least, median and greatest, and the vertices that reach none."""
    by = by or []
    n = vertices.count()
    return metrics.groupBy(*by).agg(
        F.countDistinct(F.bround("mean_shortest_path", 12)).alias("n_distinct"),
        F.min("mean_shortest_path").alias("min_mean"),
        F.median("mean_shortest_path").alias("median_mean"),
        F.max("mean_shortest_path").alias("max_mean"),
        (F.lit(n) - F.count(F.lit(1))).alias("n_isolated"),
    )

