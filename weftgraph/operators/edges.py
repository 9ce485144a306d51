"""Edge tables over all frames: dense means, normalisation, exclusions, thresholds, strongest edges; rows of single frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.errors import NetworkError
from weftgraph.functions.values import finite, normalized, value_expr
from weftgraph.operators.percentile import exact_percentile


def member_counts(vertices: DataFrame, members: DataFrame, check: bool = False) -> DataFrame:
    """vertex_id and n_members of every vertex, 0 for a vertex without atoms. With ``check`` such a vertex is an error, as is
    a member of an unknown vertex."""
    counts = members.groupBy(F.col("vertex_id").cast("long").alias("vertex_id")).agg(F.count(F.lit(1)).alias("n_members"))
    if check and not counts.join(vertices, "vertex_id", "left_anti").isEmpty():
        raise NetworkError("vertex_members names vertices that do not exist")
    out = vertices.select("vertex_id").join(counts, "vertex_id", "left").select("vertex_id", F.coalesce("n_members", F.lit(0)).alias("n_members"))
    if check and not out.where("n_members = 0").isEmpty():
        raise NetworkError("some vertices have no members")
    return out


def edge_dictionary(values: DataFrame, n_vertices: int) -> DataFrame:
    """The distinct edges of a value table, with their ends decoded from the key."""
    keys = values.select("edge_key").where("edge_key IS NOT NULL").distinct()
    n = F.lit(n_vertices).cast("long")
    return keys.select("edge_key", F.expr(f"CAST(edge_key div {n_vertices} AS int)").alias("vertex1"), (F.col("edge_key") % n).cast("int").alias("vertex2"))


def unknown_edges(values: DataFrame, edges: DataFrame) -> DataFrame:
    return values.join(edges, "edge_key", "left_anti").select("edge_key").distinct()


def require_known_edges(values: DataFrame, edges: DataFrame) -> None:
    """Raise KeyError if a value belongs to no edge of the dictionary."""
    if bad := unknown_edges(values, edges).limit(5).collect():
        raise KeyError(f"unknown edge keys, such as {[r.edge_key for r in bad]}")


def frame_counts(values: DataFrame, by: list[str]) -> DataFrame:
    """n_frames with at least one row, per network. Empty frames do not count."""
    return values.groupBy(*by).agg(F.countDistinct("frame").alias("n_frames"))


def edge_sums(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Sum of the value and of n_atom_pairs of every edge over its frames."""
    return values.groupBy(*by, "edge_key").agg(F.sum(value_expr(value)).alias("value_sum"), F.sum("n_atom_pairs").alias("n_atom_pairs_sum"))


def with_endpoints(edges: DataFrame, vertices: DataFrame, members: DataFrame) -> DataFrame:
    """Kind, label, residue name and member count of both ends of every edge."""
    info = vertices.join(member_counts(vertices, members), "vertex_id").select("vertex_id", "kind", "label", F.coalesce("residue_name", F.lit("")).alias("resname"), "n_members")
    for i in ("1", "2"):
        end = info.select(F.col("vertex_id").alias(f"vertex{i}"), *(F.col(c).alias(c + i) for c in ("kind", "label", "resname", "n_members")))
        edges = edges.join(end, f"vertex{i}")
    return edges


def edge_analysis(values: DataFrame, edges: DataFrame, vertices: DataFrame, members: DataFrame, value: str = "vdw+cl", normalization: str = "none", by: list[str] | None = None) -> DataFrame:
    """Mean of every edge over the frames of its network, an absent row counting as 0.

    ``by`` are the columns that tell networks apart (none for a single one). Edges that a network never shows are 0 for a
    single network and left out for several. A normalisation that would divide by 0 or less gives 0.
    """
    by = by or []
    sums = edge_sums(values, value, by)
    frames = frame_counts(values, by)
    if by:
        rows = sums.join(edges, "edge_key").join(frames, by)
    else:
        n_frames = frames.first().n_frames
        if not n_frames:
            raise NetworkError("the network has no frames")
        rows = edges.join(sums, "edge_key", "left").withColumn("n_frames", F.lit(n_frames))
    zero = F.lit(0.0)
    rows = with_endpoints(rows, vertices, members).withColumns({"value_raw": F.coalesce("value_sum", zero) / F.col("n_frames"), "n_atom_pairs_sum": F.coalesce("n_atom_pairs_sum", F.lit(0))})
    scaled = normalized(F.col("value_raw"), normalization, F.col("n_atom_pairs_sum"), F.col("n_members1"), F.col("n_members2"), F.col("kind1"), F.col("kind2"), zero)
    rows = rows.withColumn("value", scaled).withColumns({"abs_value": F.abs("value"), "n_atom_pairs_mean": F.col("n_atom_pairs_sum") / F.col("n_frames")})
    ends = [f"{c}{i}" for c in ("n_members", "kind", "label", "resname") for i in ("1", "2")]
    return rows.select(*by, "edge_key", "vertex1", "vertex2", "value_raw", "value", "abs_value", "n_atom_pairs_sum", "n_atom_pairs_mean", *ends)


@dataclass(frozen=True)
class Ends:
    """Vertices named by kind, residue name, label or id."""

    kinds: tuple[str, ...] = ()
    resnames: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    vertex_ids: tuple[int, ...] = ()

    def condition(self, kind: str, resname: str, label: str, vertex: str) -> Column:
        """True where the vertex in these columns is named; kinds and labels as they stand, residue names whatever their case."""
        clean = lambda values: [v for v in (str(x).strip() for x in values) if v]
        parts = [
            F.coalesce(F.col(c).isin(*values), F.lit(False))
            for c, values in ((kind, clean(self.kinds)), (label, clean(self.labels)), (vertex, [int(v) for v in self.vertex_ids]))
            if values
        ]
        if names := [v.upper() for v in clean(self.resnames)]:
            parts.append(F.coalesce(F.upper(F.trim(resname)).isin(*names), F.lit(False)))
        c = F.lit(False)
        for p in parts:
            c = c | p
        return c

    def either(self) -> Column:
        """True where one of the ends of an edge of an analysis is named."""
        return self.condition("kind1", "resname1", "label1", "vertex1") | self.condition("kind2", "resname2", "label2", "vertex2")


def exclude_endpoints(analysis: DataFrame, excluded: Ends) -> DataFrame:
    """Without the edges of which either end is named."""
    return analysis.where(~excluded.either())


def auto_thresholds(analysis: DataFrame, percentile: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """The given percentile (in percent, interpolated) of the positive finite strengths, per network."""
    if not 0 <= percentile <= 100:
        raise ValueError("a percentile lies between 0 and 100")
    strong = analysis.where(finite(F.col("abs_value")) & (F.col("abs_value") > 0))
    return exact_percentile(strong, by or [], "abs_value", percentile / 100, "threshold")


def parse_threshold(text: object) -> float | None:
    """0 for none, a number, or None for auto."""
    t = str(text).strip().lower() if text is not None else "none"
    if t in ("none", "off", "0", "0.0", ""):
        return 0.0
    if t == "auto":
        return None
    try:
        return float(t)
    except ValueError:
        raise ValueError(f"{text!r} is no threshold: a number, auto or none") from None


def above_threshold(analysis: DataFrame, threshold: object, percentile: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """The edges at least as strong as the threshold; 0 or less keeps all, NaN too. The automatic one comes from the edges given."""
    by = by or []
    t = parse_threshold(threshold)
    if t is not None:
        return analysis if t <= 0 else analysis.where(finite(F.col("abs_value")) & (F.col("abs_value") >= t))
    limits = auto_thresholds(analysis, percentile, by)
    rows = analysis.join(limits, by, "left") if by else analysis.withColumn("threshold", F.lit(limits.first().threshold).cast("double"))
    keep = F.coalesce(F.col("threshold"), F.lit(0.0)) <= 0
    return rows.where(keep | (finite(F.col("abs_value")) & (F.col("abs_value") >= F.col("threshold")))).drop("threshold")


def strongest_edges(analysis: DataFrame, n: int | None, by: list[str] | None = None) -> DataFrame:
    """The ``n`` strongest edges of every network, NaN first, ties by edge_key. None keeps all."""
    if n is None:
        return analysis
    if n < 1:
        raise ValueError("at least one edge must be kept")
    order = [F.desc("abs_value"), F.asc("edge_key")]
    if not by:
        return analysis.orderBy(*order).limit(n)
    return analysis.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_place") <= n).drop("_place")


def filter_counts(analysis: DataFrame, excluded: Ends, threshold: object, percentile: float, by: list[str] | None, n: int | None) -> DataFrame:
    """How many edges of every network each step leaves: ``by``, step, n_edges. An automatic threshold comes from the edges that
    the exclusion leaves. One pass counts all steps; a network that loses all its edges counts 0."""
    by = by or []
    flagged = analysis.withColumn("_in", ~excluded.either())
    t = parse_threshold(threshold)
    if t is not None:
        flagged = flagged.withColumn("_limit", F.lit(t))
    elif by:
        flagged = flagged.join(auto_thresholds(flagged.where("_in"), percentile, by).withColumnRenamed("threshold", "_limit"), by, "left")
    else:
        flagged = flagged.withColumn("_limit", F.lit(auto_thresholds(flagged.where("_in"), percentile).first().threshold).cast("double"))
    strong = (F.coalesce("_limit", F.lit(0.0)) <= 0) | (finite(F.col("abs_value")) & (F.col("abs_value") >= F.col("_limit")))
    left = flagged.groupBy(*by).agg(F.count(F.lit(1)).alias("n1"), F.count_if("_in").alias("n2"), F.count_if(F.col("_in") & strong).alias("n3"))
    final = F.col("n3") if n is None else F.least("n3", F.lit(n).cast("long"))
    steps = (("before", F.col("n1")), ("after_exclusion", F.col("n2")), ("after_threshold", F.col("n3")), ("final", final))
    return left.select(*by, F.inline(F.array(*(F.struct(F.lit(s).alias("step"), c.alias("n_edges")) for s, c in steps))))


def edge_values(values: DataFrame, edges: DataFrame, vertices: DataFrame, members: DataFrame, value: str = "vdw+cl", normalization: str = "none", frames: list[int] | None = None, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """One row for each row of the value table, normalised by its own counts; nothing is filled in for absent rows.

    ``columns`` are further columns of the value table to return. A normalisation that would divide by 0 or less gives NaN.
    """
    by = by or []
    rows = values if frames is None else values.where(F.col("frame").isin(*[int(f) for f in frames]))
    rows = with_endpoints(rows.join(edges, "edge_key"), vertices, members).withColumn("value_raw", value_expr(value))
    scaled = normalized(F.col("value_raw"), normalization, F.col("n_atom_pairs"), F.greatest("n_members1", F.lit(1)), F.greatest("n_members2", F.lit(1)), F.lower("kind1"), F.lower("kind2"), F.lit(float("nan")))
    return rows.select(*by, F.col("frame").cast("long").alias("frame"), "edge_key", F.col("vertex1").cast("long").alias("vertex1"), F.col("vertex2").cast("long").alias("vertex2"), "value_raw", scaled.alias("value"), F.col("n_atom_pairs").cast("double").alias("n_atom_pairs"), *(columns or []))


def edge_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and mean strength of ``edge_values`` rows per edge, over the frames that show it only."""
    return rows.groupBy(*(by or []), "edge_key", "vertex1", "vertex2").agg(F.avg("value").alias("mean_value"), F.avg(F.abs("value")).alias("mean_abs_value"), F.count(F.lit(1)).alias("n_rows"))


def frames_of(values: DataFrame) -> DataFrame:
    return values.select("frame").distinct().orderBy("frame")


def values_summary(values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, frames, first and last frame, and edges per network."""
    return values.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("frame").alias("n_frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.countDistinct("edge_key").alias("n_edges"))
