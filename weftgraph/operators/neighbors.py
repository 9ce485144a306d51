"""Summaries of the direct neighbours of every vertex, and profiles of residues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.errors import SelectorError
from weftgraph.functions.selectors import vertex_condition
from weftgraph.functions.values import finite
from weftgraph.operators.edges import Ends
from weftgraph.operators.percentile import numbered, running_sum

# Names of the summaries, with other spellings.
SUMMARIES = ("mean", "mean_abs", "sum", "sum_abs", "median", "median_abs")
SUMMARY_ALIASES = {"average": "mean", "avg": "mean", "average_abs": "mean_abs", "avg_abs": "mean_abs"}


def summary_name(name: str) -> str:
    n = SUMMARY_ALIASES.get(name.strip().lower(), name.strip().lower())
    if n not in SUMMARIES:
        raise ValueError(f"unknown summary {name!r}; known: {', '.join(SUMMARIES)}")
    return n


def both_directions(edges: DataFrame) -> DataFrame:
    """Every edge from either end: source, target and the other columns."""
    ends = F.array(F.struct(F.col("vertex1").alias("source"), F.col("vertex2").alias("target")), F.struct(F.col("vertex2").alias("source"), F.col("vertex1").alias("target")))
    rest = [c for c in edges.columns if c not in ("vertex1", "vertex2")]
    return edges.select(*rest, F.inline(ends))


def _summary(name: str) -> Column:
    value = F.abs("value") if name.endswith("_abs") else F.col("value")
    return {"mean": F.avg, "sum": F.sum, "median": F.median}[name.removesuffix("_abs")](value)


def neighbor_metrics(
    analysis: DataFrame,
    vertices: DataFrame,
    summary: str = "mean_abs",
    target: str | None = None,
    excluded: Ends | None = None,
    removed: Ends | None = None,
    split_excluded: bool = False,
    by: list[str] | None = None,
) -> DataFrame:
    """vertex_id, category, neighbor_edges and neighbor_value of every vertex with a finite edge.

    Removed vertices lose their edges. Excluded ones are only no source themselves; with ``split_excluded`` the edges towards
    them form a category of their own. With a target only edges towards its vertices count.
    """
    by = by or []
    excluded, removed = excluded or Ends(), removed or Ends()
    flags = vertices.select(
        "vertex_id",
        excluded.condition("kind", "residue_name", "label", "vertex_id").alias("is_excluded"),
        removed.condition("kind", "residue_name", "label", "vertex_id").alias("is_removed"),
        (vertex_condition(target, vertices.columns) if target else F.lit(True)).alias("is_target"),
    )
    if target and flags.where("is_target").isEmpty():
        raise SelectorError(f"the target {target!r} matches no vertex")
    if target and flags.where("is_target AND NOT is_removed").isEmpty():
        raise SelectorError(f"all vertices of the target {target!r} are removed")
    rows = both_directions(analysis.select(*by, "vertex1", "vertex2", "value")).where(finite(F.col("value")) & (F.col("source") != F.col("target")))
    for end in ("source", "target"):
        rows = rows.join(flags.select(F.col("vertex_id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("is_excluded", "is_removed", "is_target"))), end)
    rows = rows.where("NOT source_is_removed AND NOT target_is_removed AND NOT source_is_excluded AND target_is_target")
    category = F.when(F.col("target_is_excluded"), "excluded").otherwise("non_excluded") if split_excluded else F.lit("all")
    return (
        rows.withColumn("category", category)
        .groupBy(*by, F.col("source").alias("vertex_id"), "category")
        .agg(F.count(F.lit(1)).alias("neighbor_edges"), _summary(summary_name(summary)).alias("neighbor_value"))
    )


def first_name() -> Column:
    """The first residue name that is not blank, in the order of the vertices."""
    named = F.trim(F.coalesce("residue_name", F.lit(""))) != ""
    return F.coalesce(F.min_by("residue_name", F.when(named, F.col("vertex_id"))), F.lit("")).alias("residue_name")


RESIDUE = ["molecule_type", "molecule_instance", "residue_id"]


def residue_order(*more: str) -> list[Column]:
    return [F.asc("molecule_type"), F.asc_nulls_last("molecule_instance"), F.asc("residue_id"), *(F.asc(m) for m in more)]


def residue_profile(metrics: DataFrame, vertices: DataFrame, value: str, edges: str | None = None, by: list[str] | None = None, category: bool = True, prefix: str = "neighbor_value") -> DataFrame:
    """Metrics of vertices collapsed to residues: unweighted mean, median, least and greatest of the vertices' values.

    Vertices without a residue id belong to none and are left out, as are values that are not finite.
    """
    by, category_key = by or [], ["category"] if category else []
    rows = metrics.join(vertices.select("vertex_id", "kind", "residue_name", *RESIDUE), "vertex_id").where(F.col("residue_id").isNotNull() & finite(F.col(value)))
    rows = rows.withColumn("molecule_type", F.coalesce("molecule_type", F.lit("")))
    counts = [F.count(F.lit(1)).alias("n_vertices"), F.count_if(F.col("kind") == "atom").alias("n_high_res_vertices"), F.count_if(F.col("kind") == "residue").alias("n_residue_vertices")]
    more = [F.sum(edges).alias("n_neighbor_edges")] if edges else []
    stats = [f(value).alias(f"{n}_{prefix}") for n, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))]
    return rows.groupBy(*by, *RESIDUE, *category_key).agg(first_name(), *counts, *more, *stats)


def without_residue(metrics: DataFrame, vertices: DataFrame) -> DataFrame:
    """The vertices that a residue profile leaves out."""
    return metrics.select("vertex_id").distinct().join(vertices.where("residue_id IS NULL"), "vertex_id").select("vertex_id")


def compressed_axis(residues: DataFrame, by: list[str] | None = None, gap: int = 2) -> DataFrame:
    """Positions of residues on an axis: one step each, two where more than ``gap`` residues are missing within a molecule.

    Adds position (from 0), is_jump, block_start (first residue of a molecule) and index_in_molecule (from 1).
    """
    by = by or []
    rows = residues.select(*by, *RESIDUE).distinct()
    molecule = Window.partitionBy(*by, "molecule_type", "molecule_instance").orderBy("residue_id")
    missing = F.col("residue_id") - F.lag("residue_id").over(molecule) - 1
    rows = rows.withColumns({"is_jump": F.coalesce(missing > gap, F.lit(False)), "index_in_molecule": F.row_number().over(molecule)})
    rows = rows.withColumns({"block_start": F.col("index_in_molecule") == 1, "_step": F.when(F.col("is_jump"), 2).otherwise(1)})
    if by:
        along = Window.partitionBy(*by).orderBy(*residue_order()).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("position", F.sum("_step").over(along))
    else:
        rows = running_sum(rows, residue_order(), "_step", "position")
    return rows.withColumn("position", F.col("position") - 1).drop("_step")


def axis_columns(profile: DataFrame, delimiter_min_size: float = float("inf"), renumber: bool = False) -> DataFrame:
    """A profile of residues with what its axis shows: axis_residue_id (with ``renumber`` counted from 1 in each molecule) and
    molecule_border, true for the first residue of a molecule of at least ``delimiter_min_size`` residues."""
    molecule = ["molecule_type", "molecule_instance"]
    places = profile.select(*RESIDUE).distinct()
    w = Window.partitionBy(*molecule)
    places = places.withColumns({"_n": F.dense_rank().over(w.orderBy("residue_id")), "_size": F.count(F.lit(1)).over(w)})
    shown = F.col("_n") if renumber else F.col("residue_id")
    places = places.select(*RESIDUE, shown.cast("int").alias("axis_residue_id"), ((F.col("_n") == 1) & (F.col("_size") >= F.lit(delimiter_min_size))).alias("molecule_border"))
    same = F.expr(" AND ".join(f"p.{c} <=> a.{c}" for c in RESIDUE))
    return profile.alias("p").join(places.alias("a"), same).select("p.*", "axis_residue_id", "molecule_border")


def contiguous_ranges(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Runs of successive integers: first, last and n of each."""
    by = by or []
    rows = df.select(*by, column).where(F.col(column).isNotNull()).distinct()
    if by:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(column)))
    else:
        rows = numbered(rows, [F.col(column)], "_n")
    return rows.withColumn("_run", F.col(column) - F.col("_n")).groupBy(*by, "_run").agg(F.min(column).alias("first"), F.max(column).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")
