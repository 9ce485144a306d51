"""Queries over the networks of frame_values (one per build), with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.selectors import vertex_condition
from weftgraph.functions.values import NORMALIZATIONS, VALUE_COLUMNS, finite, radius, value_expr
from weftgraph.operators import edges as E
from weftgraph.operators import info, neighbors, paths, regions, viewer
from weftgraph.operators.latest import current_rows
from weftgraph.session import table

BY = ["build_id"]
ENERGIES = ("vdw", "coulomb", "vdw_dif", "coulomb_dif")


@dataclass
class Networks:
    """The tables of all builds. Values are all current rows; an energy that is no finite number is null there and so left out of
    the sums that need it, while its row and the other energies count."""

    values: DataFrame
    edges: DataFrame
    vertices: DataFrame
    members: DataFrame


def networks(spark: SparkSession, sf_dir: str) -> Networks:
    edges = table(spark, sf_dir, "edges")
    rows = current_rows(table(spark, sf_dir, "frame_values"), edges, [*ENERGIES, "n_atom_pairs"])
    values = rows.select("build_id", "frame", "edge_key", *(F.when(finite(F.col(c)), F.col(c)).alias(c) for c in ENERGIES), "n_atom_pairs")
    return Networks(values, edges, table(spark, sf_dir, "vertices"), table(spark, sf_dir, "vertex_members"))


def analysis(spark: SparkSession, sf_dir: str, value: str = "vdw+cl", normalization: str = "none") -> DataFrame:
    n = networks(spark, sf_dir)
    return E.edge_analysis(n.values, n.edges, n.vertices, n.members, value, normalization, BY)


LARGE = 1e7


def near(x: str, digits: int) -> str:
    """SQL of ``rounded``."""
    return f"CASE WHEN abs({x}) < {LARGE} THEN round({x}, {digits}) ELSE TRY_CAST(printf('%.8e', {x}) AS DOUBLE) END"


# --- SQL shared by the queries ---------------------------------------------------------------------------------------

VALUES_SQL = f"""c AS (SELECT f.build_id, f.frame, f.edge_key, e.vertex1, e.vertex2, CAST(f.vdw AS DOUBLE) AS vdw, CAST(f.coulomb AS DOUBLE) AS coulomb,
  CAST(f.vdw_dif AS DOUBLE) AS vdw_dif, CAST(f.coulomb_dif AS DOUBLE) AS coulomb_dif, f.n_atom_pairs,
  row_number() OVER (PARTITION BY f.build_id, f.frame, f.edge_key ORDER BY f.written_at DESC NULLS LAST, f.row_id DESC) AS rn
  FROM frame_values f JOIN edges e ON f.edge_key = e.edge_key),
v AS (SELECT * REPLACE ({", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in ENERGIES)}) FROM c WHERE rn = 1),
mc AS (SELECT v.vertex_id, count(m.atom_index) AS n, any_value(v.kind) AS kind, any_value(v.label) AS label, coalesce(any_value(v.residue_name), '') AS resname
  FROM vertices v LEFT JOIN vertex_members m ON v.vertex_id = m.vertex_id GROUP BY v.vertex_id)"""


def expr_sql(value: str, prefix: str = "") -> str:
    return "(" + " + ".join(prefix + c for c in VALUE_COLUMNS[value]) + ")"


def norm_sql(normalization: str, value: str, pairs: str, otherwise: str) -> str:
    if normalization == "none":
        return value
    if normalization == "per_atom_pair":
        d = pairs
    else:
        m = [f"(CASE WHEN kind{i} IN ('low_res', 'bundle') THEN n_members{i} ELSE 1 END)" if "coarse" in normalization else f"n_members{i}" for i in (1, 2)]
        d = f"CAST({m[0]} * {m[1]} AS DOUBLE)"
        d = f"sqrt({d})" if normalization.endswith("sqrt") else d
    return f"(CASE WHEN {d} > 0 THEN {value} / {d} ELSE {otherwise} END)"


def analysis_sql(value: str = "vdw+cl", normalization: str = "none") -> str:
    return f"""{VALUES_SQL},
s AS (SELECT build_id, edge_key, any_value(vertex1) AS vertex1, any_value(vertex2) AS vertex2, sum({expr_sql(value)}) AS vs, coalesce(sum(n_atom_pairs), 0) AS np FROM v GROUP BY build_id, edge_key),
fr AS (SELECT build_id, count(DISTINCT frame) AS nf FROM v GROUP BY build_id),
a0 AS (SELECT s.build_id, s.edge_key, s.vertex1, s.vertex2, coalesce(vs, 0.0) / nf AS value_raw, CAST(np AS BIGINT) AS n_atom_pairs_sum, np / CAST(nf AS DOUBLE) AS n_atom_pairs_mean,
  m1.n AS n_members1, m2.n AS n_members2, m1.kind AS kind1, m2.kind AS kind2, m1.label AS label1, m2.label AS label2, m1.resname AS resname1, m2.resname AS resname2
  FROM s JOIN fr ON s.build_id = fr.build_id JOIN mc m1 ON s.vertex1 = m1.vertex_id JOIN mc m2 ON s.vertex2 = m2.vertex_id),
a AS (SELECT *, {norm_sql(normalization, "value_raw", "n_atom_pairs_sum", "0.0")} AS value, abs({norm_sql(normalization, "value_raw", "n_atom_pairs_sum", "0.0")}) AS abs_value FROM a0)"""


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Columns to so many decimals, and to nine significant digits from ``LARGE`` on, where decimals mean nothing: some readings are
    beyond 1e30, and sums in another order differ in their last digits."""
    nine = lambda c: F.format_string("%.8e", c).try_cast("double")
    return df.withColumns({c: F.when(F.abs(c) < LARGE, F.round(c, digits)).otherwise(nine(c)) for c in columns})


# --- edge tables -----------------------------------------------------------------------------------------------------


@query(
    "edge_mean_vdw_cl",
    f"WITH {analysis_sql()} SELECT build_id, edge_key, vertex1, vertex2, {near('value_raw', 4)} AS value_raw, {near('value', 4)} AS value, {near('abs_value', 4)} AS abs_value, n_atom_pairs_sum, {near('n_atom_pairs_mean', 4)} AS n_atom_pairs_mean, n_members1, n_members2, kind1, kind2, label1, label2, resname1, resname2 FROM a",
)
def edge_mean_vdw_cl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analysis(spark, sf_dir), "value_raw", "value", "abs_value", "n_atom_pairs_mean")


@query(
    "edge_each_value",
    f"WITH {VALUES_SQL}, fr AS (SELECT build_id, count(DISTINCT frame) AS nf FROM v GROUP BY build_id) "
    + " UNION ALL ".join(f"SELECT v.build_id, '{n}' AS value_name, count(DISTINCT edge_key) AS n_edges, {near(f'sum({expr_sql(n)}) / any_value(nf)', 3)} AS mean_sum FROM v JOIN fr ON v.build_id = fr.build_id GROUP BY v.build_id" for n in VALUE_COLUMNS),
)
def edge_each_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six values of every build, summed over its edges. One pass sums all of them."""
    n = networks(spark, sf_dir)
    sums = n.values.groupBy(*BY, "edge_key").agg(*(F.sum(value_expr(v)).alias(v) for v in VALUE_COLUMNS))
    names = F.array(*(F.struct(F.lit(v).alias("value_name"), F.col(f"`{v}`").alias("s")) for v in VALUE_COLUMNS))
    long = sums.join(E.frame_counts(n.values, BY), BY).select("build_id", "n_frames", F.inline(names))
    out = long.groupBy("build_id", "value_name").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("s") / F.col("n_frames")).alias("mean_sum"))
    return rounded(out, "mean_sum", digits=3)


def _norm(normalization: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analysis(spark, sf_dir, "vdw+cl", normalization).select("build_id", "edge_key", "value"), "value", digits=6)


for _n in NORMALIZATIONS:
    query(f"norm_{_n}", f"WITH {analysis_sql('vdw+cl', _n)} SELECT build_id, edge_key, {near('value', 6)} AS value FROM a")(partial(_norm, _n))

EXCLUDED = E.Ends(kinds=("bundle",), resnames=("phy", "QUE"), vertex_ids=(7,))
EXCLUDED_SQL = " OR ".join(f"kind{i} = 'bundle' OR upper(trim(resname{i}, ' ')) IN ('PHY', 'QUE') OR vertex{i} = 7" for i in (1, 2))


@query("edge_exclude_endpoints", f"WITH {analysis_sql()} SELECT build_id, edge_key, {near('value', 4)} AS value FROM a WHERE NOT ({EXCLUDED_SQL})")
def edge_exclude_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.exclude_endpoints(analysis(spark, sf_dir), EXCLUDED).select("build_id", "edge_key", "value"), "value")


_AUTO = "t AS (SELECT build_id, quantile_cont(abs_value, {p}) AS th FROM a WHERE abs_value > 0 GROUP BY build_id)"


@query("edge_auto_threshold", f"WITH {analysis_sql()}, {_AUTO.format(p=0.25)} SELECT a.build_id, edge_key, {near('value', 4)} AS value FROM a LEFT JOIN t ON a.build_id = t.build_id WHERE coalesce(th, 0) <= 0 OR abs_value >= th")
def edge_auto_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.above_threshold(analysis(spark, sf_dir), "auto", 25, BY).select("build_id", "edge_key", "value"), "value")


@query("edge_explicit_threshold", f"WITH {analysis_sql()} SELECT build_id, edge_key, {near('value', 4)} AS value FROM a WHERE abs_value >= 5.0")
def edge_explicit_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.above_threshold(analysis(spark, sf_dir), "5.0", by=BY).select("build_id", "edge_key", "value"), "value")


@query("edge_topk", f"WITH {analysis_sql()} SELECT build_id, edge_key, {near('abs_value', 4)} AS abs_value FROM a QUALIFY row_number() OVER (PARTITION BY build_id ORDER BY a.abs_value DESC, edge_key) <= 20")
def edge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.strongest_edges(analysis(spark, sf_dir), 20, BY).select("build_id", "edge_key", "abs_value"), "abs_value")


@query(
    "edge_filter_counts",
    f"WITH {analysis_sql()}, x AS (SELECT * FROM a WHERE NOT ({EXCLUDED_SQL})), t AS (SELECT build_id, quantile_cont(abs_value, 0.0005) AS th FROM x WHERE abs_value > 0 GROUP BY build_id), "
    "y AS (SELECT x.* FROM x LEFT JOIN t ON x.build_id = t.build_id WHERE coalesce(th, 0) <= 0 OR abs_value >= th), "
    "n AS (SELECT a.build_id, count(*) AS n1, count(x.edge_key) AS n2, count(y.edge_key) AS n3 FROM a LEFT JOIN x ON a.build_id = x.build_id AND a.edge_key = x.edge_key LEFT JOIN y ON a.build_id = y.build_id AND a.edge_key = y.edge_key GROUP BY a.build_id) "
    "SELECT build_id, unnest(['before', 'after_exclusion', 'after_threshold', 'final']) AS step, unnest([n1, n2, n3, least(n3, 100)]) AS n_edges FROM n",
)
def edge_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.filter_counts(analysis(spark, sf_dir), EXCLUDED, "auto", 0.05, BY, 100)


@query(
    "edge_dense_pooled",
    f"WITH {VALUES_SQL}, s AS (SELECT edge_key, coalesce(sum(vdw + coulomb), 0.0) AS vs, coalesce(sum(n_atom_pairs), 0) AS np FROM v GROUP BY edge_key), nf AS (SELECT count(DISTINCT build_id * 1000000 + frame) AS n FROM v) "
    f"SELECT e.edge_key, e.vertex1, e.vertex2, {near('coalesce(vs, 0.0) / n', 6)} AS value, CAST(coalesce(np, 0) AS BIGINT) AS n_atom_pairs_sum FROM edges e CROSS JOIN nf LEFT JOIN s ON e.edge_key = s.edge_key",
)
def edge_dense_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All builds pooled to one network: the mean of every edge of the dictionary over all frames, 0 for an edge never shown."""
    n = networks(spark, sf_dir)
    pooled = n.values.withColumn("frame", F.col("build_id") * 1_000_000 + F.col("frame"))
    a = E.edge_analysis(pooled, n.edges, n.vertices, n.members)
    return rounded(a.select("edge_key", "vertex1", "vertex2", "value", "n_atom_pairs_sum"), "value", digits=6)


def _rows(normalization: str, frames: list[int] | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    n = networks(spark, sf_dir)
    return rounded(E.edge_values(n.values, n.edges, n.vertices, n.members, "vdw+cl", normalization, frames, by=BY), "value", "value_raw")


def rows_sql(value: str = "vdw+cl", normalization: str = "none", where: str = "") -> str:
    scaled = norm_sql(normalization, expr_sql(value), "CAST(n_atom_pairs AS DOUBLE)", "CAST('nan' AS DOUBLE)")
    return f"""{VALUES_SQL}, r AS (SELECT build_id, CAST(frame AS BIGINT) AS frame, edge_key, CAST(vertex1 AS BIGINT) AS vertex1, CAST(vertex2 AS BIGINT) AS vertex2,
  {expr_sql(value)} AS value_raw, {scaled} AS value, CAST(n_atom_pairs AS DOUBLE) AS n_atom_pairs
  FROM (SELECT v.*, greatest(m1.n, 1) AS n_members1, greatest(m2.n, 1) AS n_members2, m1.kind AS kind1, m2.kind AS kind2 FROM v JOIN mc m1 ON v.vertex1 = m1.vertex_id JOIN mc m2 ON v.vertex2 = m2.vertex_id {where}))"""


_ROWS = f"SELECT build_id, frame, edge_key, vertex1, vertex2, {near('value_raw', 4)} AS value_raw, {near('value', 4)} AS value, n_atom_pairs FROM r"
FRAMES = [66, 110, 236, 250, 300, 355]
query("edge_values_rows", f"WITH {rows_sql()} {_ROWS}")(partial(_rows, "none", None))
query("edge_values_per_pair", f"WITH {rows_sql(normalization='per_atom_pair')} {_ROWS}")(partial(_rows, "per_atom_pair", None))
query("edge_values_frames", f"WITH {rows_sql(where=f'WHERE frame IN ({", ".join(map(str, FRAMES))})')} {_ROWS}")(partial(_rows, "none", FRAMES))


@query(
    "edge_summary_sparse",
    f"WITH {rows_sql(normalization='per_member_product')} SELECT build_id, edge_key, vertex1, vertex2, {near('avg(value)', 5)} AS mean_value, {near('avg(abs(value))', 5)} AS mean_abs_value, count(*) AS n_rows FROM r GROUP BY build_id, edge_key, vertex1, vertex2",
)
def edge_summary_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = networks(spark, sf_dir)
    rows = E.edge_values(n.values, n.edges, n.vertices, n.members, "vdw+cl", "per_member_product", by=BY)
    return rounded(E.edge_summary(rows, BY), "mean_value", "mean_abs_value", digits=5)


@query("frames_summary", f"WITH {VALUES_SQL} SELECT build_id, count(*) AS n_rows, count(DISTINCT frame) AS n_frames, min(frame) AS first_frame, max(frame) AS last_frame, count(DISTINCT edge_key) AS n_edges FROM v GROUP BY build_id")
def frames_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.values_summary(networks(spark, sf_dir).values, BY)


@query("frames_list", f"WITH {VALUES_SQL} SELECT DISTINCT frame FROM v")
def frames_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.frames_of(networks(spark, sf_dir).values)


@query("edge_dictionary", "SELECT DISTINCT edge_key, CAST(edge_key // 640 AS INT) AS vertex1, CAST(edge_key % 640 AS INT) AS vertex2 FROM frame_values WHERE edge_key IS NOT NULL")
def edge_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.edge_dictionary(table(spark, sf_dir, "frame_values"), table(spark, sf_dir, "vertices").count())


@query("unknown_edges", "SELECT DISTINCT f.edge_key FROM frame_values f WHERE f.edge_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.edge_key = f.edge_key)")
def unknown_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.unknown_edges(table(spark, sf_dir, "frame_values"), table(spark, sf_dir, "edges"))


SEEN_SQL = "seen AS (SELECT DISTINCT build_id, vertex_id FROM (SELECT build_id, vertex1 AS vertex_id FROM v UNION ALL SELECT build_id, vertex2 FROM v))"


def seen_vertices(n: Networks) -> DataFrame:
    """build_id and vertex_id of the vertices that the values of each build show."""
    ends = F.array(F.col("vertex1").cast("long"), F.col("vertex2").cast("long"))
    return n.values.select("build_id", "edge_key").distinct().join(n.edges, "edge_key").select("build_id", F.explode(ends).alias("vertex_id")).distinct()


@query("member_counts", f"WITH {VALUES_SQL}, {SEEN_SQL} SELECT build_id, count(*) AS n_vertices, CAST(sum(n) AS BIGINT) AS n_members FROM seen JOIN mc ON seen.vertex_id = mc.vertex_id GROUP BY build_id")
def member_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of each build and the atoms they have."""
    n = networks(spark, sf_dir)
    counted = seen_vertices(n).join(E.member_counts(n.vertices, n.members), "vertex_id")
    return counted.groupBy("build_id").agg(F.count(F.lit(1)).alias("n_vertices"), F.sum("n_members").alias("n_members"))


# --- selectors: rows of all builds whose first vertex is selected ------------------------------------------------------

SELECTORS = {
    "numeric": ("resid >= 30 and charge < 0.2", "coalesce(residue_id >= 30, FALSE) AND coalesce(isfinite(charge) AND charge < 0.2, FALSE)"),
    "range": ("resid 25-10", "coalesce(residue_id BETWEEN 10 AND 25, FALSE)"),
    "in": ("resname in PHY,QUE,CYL or vertex_id in 1,5-9", "coalesce(residue_name IN ('PHY', 'QUE', 'CYL'), FALSE) OR vertex_id = 1 OR vertex_id BETWEEN 5 AND 9"),
    "string": ("kind == residue and moltype != PROT_K", "kind = 'residue' AND coalesce(molecule_type, '') <> 'PROT_K'"),
    "not_null": ("not resid 4 and molinstance != 1", "NOT coalesce(residue_id = 4, FALSE) AND (molecule_instance IS NULL OR molecule_instance <> 1)"),
    "and_or": ("(kind atom or kind bundle) and not (resid < 10 or name CA)", "kind IN ('atom', 'bundle') AND NOT (coalesce(residue_id < 10, FALSE) OR coalesce(atom_name, '') = 'CA')"),
}


def _selected(selector: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every build whose vertex1 the selector selects, by vertex."""
    chosen = table(spark, sf_dir, "vertices").where(vertex_condition(selector)).select(F.col("vertex_id").alias("vertex1"))
    n = networks(spark, sf_dir)
    rows = n.values.join(n.edges, "edge_key").groupBy("vertex1").agg(F.count(F.lit(1)).alias("n"))
    return chosen.join(rows, "vertex1", "left").select(F.col("vertex1").alias("vertex_id"), F.coalesce("n", F.lit(0)).alias("n_rows"))


for _k, (_s, _w) in SELECTORS.items():
    query(f"selector_{_k}", f"WITH {VALUES_SQL}, w AS (SELECT vertex1, count(*) AS n FROM v GROUP BY vertex1) SELECT x.vertex_id, coalesce(w.n, 0) AS n_rows FROM vertices x LEFT JOIN w ON x.vertex_id = w.vertex1 WHERE {_w}")(partial(_selected, _s))

# --- regions -----------------------------------------------------------------------------------------------------------

REGIONS = ("kind atom", "kind bundle", "kind residue and resid 1-40")
REGION_SQL = """place AS (SELECT region_index, region, selector, vertex_id, molecule_type, molecule_instance, residue_id, residue_name,
  CAST(dense_rank() OVER (PARTITION BY region_index ORDER BY molecule_type, molecule_instance NULLS LAST, residue_id NULLS LAST, residue_name) AS INT) AS residue_index
  FROM (SELECT vertex_id, coalesce(molecule_type, '') AS molecule_type, molecule_instance, residue_id, coalesce(residue_name, '') AS residue_name,
    CASE WHEN kind = 'atom' THEN 1 WHEN kind = 'bundle' THEN 2 ELSE 3 END AS region_index, CASE WHEN kind = 'atom' THEN 'R1' WHEN kind = 'bundle' THEN 'R2' ELSE 'R3' END AS region,
    CASE WHEN kind = 'atom' THEN 'kind atom' WHEN kind = 'bundle' THEN 'kind bundle' ELSE 'kind residue and resid 1-40' END AS selector
    FROM vertices WHERE kind IN ('atom', 'bundle') OR (kind = 'residue' AND residue_id BETWEEN 1 AND 40)))"""


def cells_sql(normalization: str = "none") -> str:
    scaled = norm_sql(normalization, "(vdw + coulomb)", "CAST(n_atom_pairs AS DOUBLE)", "CAST('nan' AS DOUBLE)" if normalization == "per_atom_pair" else "(vdw + coulomb)")
    return f"""{VALUES_SQL}, {REGION_SQL},
x AS (SELECT build_id, frame, vertex1, vertex2, {scaled} AS val FROM (SELECT v.*, m1.n AS n_members1, m2.n AS n_members2, m1.kind AS kind1, m2.kind AS kind2 FROM v JOIN mc m1 ON v.vertex1 = m1.vertex_id JOIN mc m2 ON v.vertex2 = m2.vertex_id)),
d AS (SELECT build_id, frame, vertex1 AS a, vertex2 AS b, val FROM x WHERE isfinite(val) UNION ALL SELECT build_id, frame, vertex2, vertex1, val FROM x WHERE isfinite(val)),
cells AS (SELECT d.build_id, d.frame, s.region AS source_region, t.region AS target_region, s.selector AS source_selector, t.selector AS target_selector, s.molecule_type, s.molecule_instance, s.residue_id, s.residue_name, s.residue_index, sum(val) AS value, count(*) AS n_edges
  FROM d JOIN place s ON d.a = s.vertex_id JOIN place t ON d.b = t.vertex_id WHERE s.region_index <> t.region_index GROUP BY ALL)"""


def _cells(normalization: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    n = networks(spark, sf_dir)
    chosen = regions.resolve_regions(n.vertices, REGIONS)
    return regions.region_interactions(n.values, n.edges, n.vertices, n.members, chosen, "vdw+cl", normalization, BY)


def _rave(normalization: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_cells(normalization, spark, sf_dir), "value")


for _n in NORMALIZATIONS:
    query("rave_pairs" if _n == "none" else f"rave_norm_{_n}", f"WITH {cells_sql(_n)} SELECT * REPLACE ({near('value', 4)} AS value) FROM cells")(partial(_rave, _n))


@query(
    "rave_signed_root",
    f"WITH {cells_sql()}, m AS (SELECT build_id, max(abs(value)) AS vm FROM cells GROUP BY build_id) SELECT c.build_id, c.frame, source_region, target_region, residue_index, "
    "round(0.5 + 0.5 * sign(value) * pow(abs(value) / (CASE WHEN vm > 0 THEN vm ELSE 1.0 END), 0.4), 6) AS position FROM cells c JOIN m ON c.build_id = m.build_id",
)
def rave_signed_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions.with_color_position(_cells("none", spark, sf_dir), BY)
    return rounded(rows.select("build_id", "frame", "source_region", "target_region", "residue_index", "position"), "position", digits=6)


_SEEN_PLACE = f"{SEEN_SQL}, {REGION_SQL}, sp AS (SELECT s.build_id, region_index, region, p.vertex_id, residue_name, dense_rank() OVER (PARTITION BY s.build_id, region_index ORDER BY molecule_type, molecule_instance NULLS LAST, residue_id NULLS LAST, residue_name) AS k FROM seen s JOIN place p ON s.vertex_id = p.vertex_id)"


def _seen_regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The regions among the vertices of each build, and the vertices."""
    n = networks(spark, sf_dir)
    return seen_vertices(n).join(regions.resolve_regions(n.vertices, REGIONS), "vertex_id"), n.vertices


@query("rave_residue_index", f"WITH {VALUES_SQL}, {_SEEN_PLACE} SELECT build_id, region_index, region, vertex_id, CAST(k AS INT) AS residue_index FROM sp")
def rave_residue_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, v = _seen_regions(spark, sf_dir)
    return regions.residue_index(r, v, BY).select("build_id", "region_index", "region", "vertex_id", "residue_index")


@query("region_rows", f"WITH {VALUES_SQL}, {REGION_SQL} SELECT build_id, p.region, count(*) AS n_rows FROM v JOIN place p ON v.vertex1 = p.vertex_id GROUP BY build_id, p.region")
def region_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every build whose vertex1 lies in each region."""
    n = networks(spark, sf_dir)
    r = regions.resolve_regions(n.vertices, REGIONS).select("region", F.col("vertex_id").alias("vertex1"))
    return n.values.join(n.edges, "edge_key").join(r, "vertex1").groupBy("build_id", "region").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "pair_layout",
    f"WITH {VALUES_SQL}, {_SEEN_PLACE}, s AS (SELECT build_id, region_index, region, list(residue_name ORDER BY k) AS names FROM (SELECT DISTINCT build_id, region_index, region, k, residue_name FROM sp) GROUP BY ALL) "
    "SELECT a.build_id, a.region AS region1, b.region AS region2, CASE WHEN a.names = b.names THEN 'overlay' ELSE 'adjacent' END AS layout FROM s a JOIN s b ON a.build_id = b.build_id AND a.region_index < b.region_index",
)
def pair_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, v = _seen_regions(spark, sf_dir)
    return regions.pair_layout(r, v, BY)


@query("residue_keys", f"WITH {VALUES_SQL} SELECT DISTINCT x.vertex_id, x.molecule_instance, x.residue_id, coalesce(x.residue_name, '') AS residue_name FROM v JOIN vertices x ON v.vertex1 = x.vertex_id OR v.vertex2 = x.vertex_id")
def residue_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = networks(spark, sf_dir)
    seen = n.values.join(n.edges, "edge_key").select(F.explode(F.array(F.col("vertex1").cast("long"), F.col("vertex2").cast("long"))).alias("vertex_id")).distinct()
    return regions.residue_keys(n.vertices, seen)


# --- neighbours --------------------------------------------------------------------------------------------------------

NEIGHBOUR_SQL = "n AS (SELECT build_id, vertex1 AS s, vertex2 AS t, value FROM a WHERE vertex1 <> vertex2 UNION ALL SELECT build_id, vertex2, vertex1, value FROM a WHERE vertex1 <> vertex2)"
SUMMARY_SQL = {"mean": "avg(value)", "mean_abs": "avg(abs(value))", "sum": "sum(value)", "sum_abs": "sum(abs(value))", "median": "median(value)", "median_abs": "median(abs(value))"}
PROFILE_SQL = f"""SELECT q.build_id, coalesce(x.molecule_type, '') AS molecule_type, x.molecule_instance, x.residue_id, category,
  coalesce(arg_min(x.residue_name, x.vertex_id) FILTER (WHERE trim(coalesce(x.residue_name, ''), ' ') <> ''), '') AS residue_name, count(*) AS n_vertices,
  count(*) FILTER (WHERE x.kind = 'atom') AS n_high_res_vertices, count(*) FILTER (WHERE x.kind = 'residue') AS n_residue_vertices, CAST(sum(neighbor_edges) AS BIGINT) AS n_neighbor_edges,
  {near('avg(val)', 4)} AS mean_neighbor_value, {near('median(val)', 4)} AS median_neighbor_value, {near('min(val)', 4)} AS min_neighbor_value, {near('max(val)', 4)} AS max_neighbor_value
  FROM q JOIN vertices x ON q.vertex_id = x.vertex_id WHERE x.residue_id IS NOT NULL GROUP BY ALL"""


def metrics_sql(summary: str = "mean_abs", category: str = "'all'", where: str = "") -> str:
    return f"{analysis_sql()}, {NEIGHBOUR_SQL}, q AS (SELECT build_id, s AS vertex_id, {category} AS category, count(*) AS neighbor_edges, {SUMMARY_SQL[summary]} AS val FROM n JOIN vertices vs ON n.s = vs.vertex_id JOIN vertices vt ON n.t = vt.vertex_id {where} GROUP BY ALL)"


def _metrics(summary: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    m = neighbors.neighbor_metrics(analysis(spark, sf_dir), table(spark, sf_dir, "vertices"), summary, by=BY)
    return rounded(m, "neighbor_value")


for _n in neighbors.SUMMARIES:
    query(f"neighbors_{_n}", f"WITH {metrics_sql(_n)} SELECT build_id, vertex_id, category, neighbor_edges, {near('val', 4)} AS neighbor_value FROM q")(partial(_metrics, _n))


def _profile(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    v = table(spark, sf_dir, "vertices")
    m = neighbors.neighbor_metrics(analysis(spark, sf_dir), v, by=BY, **options)
    p = neighbors.residue_profile(m, v, "neighbor_value", "neighbor_edges", BY)
    return rounded(p, *(f"{s}_neighbor_value" for s in ("mean", "median", "min", "max")))


query("neighbors_profile", f"WITH {metrics_sql()} {PROFILE_SQL}")(_profile)
query("neighbors_target", f"WITH {metrics_sql(where='''WHERE vt.kind = 'atom' ''')} {PROFILE_SQL}")(partial(_profile, target="kind atom"))
query("neighbors_remove", f"WITH {metrics_sql(where='''WHERE vs.kind <> 'bundle' AND vt.kind <> 'bundle' ''')} {PROFILE_SQL}")(partial(_profile, removed=E.Ends(kinds=("bundle",))))
query("neighbors_split_excluded", f"WITH {metrics_sql(category='''CASE WHEN vt.kind = 'atom' THEN 'excluded' ELSE 'non_excluded' END''', where='''WHERE vs.kind <> 'atom' ''')} {PROFILE_SQL}")(
    partial(_profile, excluded=E.Ends(kinds=("atom",)), split_excluded=True)
)

AXIS_SQL = """r AS (SELECT DISTINCT build_id, molecule_type, molecule_instance, residue_id FROM residue_neighbors WHERE residue_id IS NOT NULL),
g AS (SELECT *, residue_id - lag(residue_id) OVER m - 1 AS missing, row_number() OVER m AS index_in_molecule FROM r WINDOW m AS (PARTITION BY build_id, molecule_type, molecule_instance ORDER BY residue_id))"""


@query(
    "compressed_axis",
    f"WITH {AXIS_SQL} SELECT build_id, molecule_type, molecule_instance, residue_id, coalesce(missing > 2, FALSE) AS is_jump, CAST(index_in_molecule AS INT) AS index_in_molecule, index_in_molecule = 1 AS block_start, "
    "CAST(sum(CASE WHEN missing > 2 THEN 2 ELSE 1 END) OVER (PARTITION BY build_id ORDER BY molecule_type, molecule_instance NULLS LAST, residue_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS position FROM g",
)
def compressed_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.compressed_axis(table(spark, sf_dir, "residue_neighbors").where("residue_id IS NOT NULL"), BY)


@query(
    "contiguous_ranges",
    f"WITH {VALUES_SQL}, f AS (SELECT DISTINCT build_id, frame FROM v), g AS (SELECT *, frame - row_number() OVER (PARTITION BY build_id ORDER BY frame) AS k FROM f) SELECT build_id, min(frame) AS first, max(frame) AS last, count(*) AS n FROM g GROUP BY build_id, k",
)
def contiguous_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.contiguous_ranges(networks(spark, sf_dir).values, "frame", BY)


# --- paths -------------------------------------------------------------------------------------------------------------


def graph_sql(value: str) -> str:
    length = "abs(value)" if value.startswith("d") else "1.0 / abs(value)"
    return f"""{analysis_sql(value)}, g AS (SELECT build_id, s, t, min(w) AS w FROM (SELECT build_id, vertex1 AS s, vertex2 AS t, {length} AS w FROM a WHERE value <> 0 UNION ALL SELECT build_id, vertex2, vertex1, {length} FROM a WHERE value <> 0)
  WHERE s <> t AND isfinite(w) AND w > 2.220446049250313e-16 GROUP BY build_id, s, t)"""


SQUARINGS = 5


def distances_sql(value: str) -> str:
    """All shortest distances by squaring the matrix of arcs in the (min, +) semiring; covers paths of 32 arcs."""
    out = f"{graph_sql(value)}, d0 AS MATERIALIZED (SELECT build_id, s, t, w FROM g UNION ALL SELECT DISTINCT build_id, s, s, 0.0 FROM g)"
    for k in range(SQUARINGS):
        out += f", d{k + 1} AS MATERIALIZED (SELECT x.build_id, x.s, y.t, min(x.w + y.w) AS w FROM d{k} x JOIN d{k} y ON x.build_id = y.build_id AND x.t = y.s GROUP BY x.build_id, x.s, y.t)"
    return out


def _graph(value: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paths.distance_graph(analysis(spark, sf_dir, value), value, BY), "distance", digits=6)


query("graph_edges_energy", f"WITH {graph_sql('vdw+cl')} SELECT build_id, s AS source, t AS target, {near('w', 6)} AS distance FROM g")(partial(_graph, "vdw+cl"))
query("graph_edges_derivative", f"WITH {graph_sql('dvdw+dcl')} SELECT build_id, s AS source, t AS target, {near('w', 6)} AS distance FROM g")(partial(_graph, "dvdw+dcl"))
_PATH = f"count(*) AS reachable_vertices, {near('avg(w)', 5)} AS mean_shortest_path, {near('median(w)', 5)} AS median_shortest_path, {near('min(w)', 5)} AS min_shortest_path, {near('max(w)', 5)} AS max_shortest_path"
_STATS = [f"{s}_shortest_path" for s in ("mean", "median", "min", "max")]


def _path_metrics(spark: SparkSession, sf_dir: str, value: str = "vdw+cl") -> DataFrame:
    g = paths.distance_graph(analysis(spark, sf_dir, value), value, BY)
    return paths.vertex_path_metrics(g, BY)


@query("shortest_path_vertex", f"WITH {distances_sql('vdw+cl')} SELECT build_id, s AS vertex_id, {_PATH} FROM d{SQUARINGS} WHERE s <> t GROUP BY build_id, s")
def shortest_path_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_path_metrics(spark, sf_dir), *_STATS, digits=5)


@query("shortest_path_derivative", f"WITH {distances_sql('dvdw+dcl')} SELECT build_id, s AS vertex_id, {_PATH} FROM d{SQUARINGS} WHERE s <> t GROUP BY build_id, s")
def shortest_path_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_path_metrics(spark, sf_dir, "dvdw+dcl"), *_STATS, digits=5)


@query("shortest_path_target", f"WITH {distances_sql('vdw+cl')} SELECT build_id, t AS vertex_id, {_PATH} FROM d{SQUARINGS} JOIN vertices x ON s = x.vertex_id WHERE s <> t AND x.kind = 'atom' GROUP BY build_id, t")
def shortest_path_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = paths.distance_graph(analysis(spark, sf_dir), "vdw+cl", BY)
    return rounded(paths.target_path_metrics(g, table(spark, sf_dir, "vertices"), "kind atom", BY), *_STATS, digits=5)


@query(
    "shortest_path_residue",
    f"WITH {distances_sql('vdw+cl')}, q AS (SELECT build_id, s AS vertex_id, count(*) AS reach, avg(w) AS val FROM d{SQUARINGS} WHERE s <> t GROUP BY build_id, s) "
    "SELECT q.build_id, coalesce(x.molecule_type, '') AS molecule_type, x.molecule_instance, x.residue_id, coalesce(arg_min(x.residue_name, x.vertex_id) FILTER (WHERE trim(coalesce(x.residue_name, ''), ' ') <> ''), '') AS residue_name, "
    f"count(*) AS n_vertices, count(*) FILTER (WHERE x.kind = 'atom') AS n_high_res_vertices, count(*) FILTER (WHERE x.kind = 'residue') AS n_residue_vertices, {near('avg(val)', 5)} AS mean_shortest_path, {near('median(val)', 5)} AS median_shortest_path, "
    f"{near('min(val)', 5)} AS min_shortest_path, {near('max(val)', 5)} AS max_shortest_path, {near('avg(reach)', 4)} AS mean_reachable_vertices FROM q JOIN vertices x ON q.vertex_id = x.vertex_id WHERE x.residue_id IS NOT NULL GROUP BY ALL",
)
def shortest_path_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths.path_profile(_path_metrics(spark, sf_dir), table(spark, sf_dir, "vertices"), BY)
    return rounded(rounded(p, *_STATS, digits=5), "mean_reachable_vertices")


@query(
    "path_statistics",
    f"WITH {distances_sql('vdw+cl')}, q AS (SELECT build_id, s, avg(w) AS val FROM d{SQUARINGS} WHERE s <> t GROUP BY build_id, s) SELECT build_id, count(DISTINCT round_even(val, 12)) AS n_distinct, {near('min(val)', 5)} AS min_mean, {near('median(val)', 5)} AS median_mean, {near('max(val)', 5)} AS max_mean, (SELECT count(*) FROM vertices) - count(*) AS n_isolated FROM q GROUP BY build_id",
)
def path_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = paths.path_statistics(_path_metrics(spark, sf_dir), table(spark, sf_dir, "vertices"), BY)
    return rounded(s, "min_mean", "median_mean", "max_mean", digits=5)


@query(
    "path_high_res",
    f"WITH {distances_sql('vdw+cl')}, q AS (SELECT build_id, s AS vertex_id, avg(w) AS val FROM d{SQUARINGS} WHERE s <> t GROUP BY build_id, s) SELECT build_id, q.vertex_id, CAST(row_number() OVER (PARTITION BY build_id ORDER BY x.molecule_type, x.molecule_instance NULLS LAST, x.residue_id NULLS LAST, x.atom_nr NULLS LAST, q.vertex_id) - 1 AS INT) AS plot_index, "
    f"x.label, {near('val', 5)} AS mean_shortest_path FROM q JOIN vertices x ON q.vertex_id = x.vertex_id WHERE x.kind = 'atom'",
)
def path_high_res(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths.high_res_profile(_path_metrics(spark, sf_dir), table(spark, sf_dir, "vertices"), BY)
    return rounded(p.select("build_id", F.col("vertex_id"), "plot_index", "label", "mean_shortest_path"), "mean_shortest_path", digits=5)


# --- information and viewer --------------------------------------------------------------------------------------------


@query("info_kind_counts", f"WITH {VALUES_SQL} SELECT x.kind, count(*) AS n FROM v JOIN vertices x ON v.vertex1 = x.vertex_id GROUP BY x.kind")
def info_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value rows of each kind of vertex1."""
    n = networks(spark, sf_dir)
    rows = n.values.join(n.edges, "edge_key").join(n.vertices.select(F.col("vertex_id").alias("vertex1"), "kind"), "vertex1")
    return info.kind_counts(rows)


@query(
    "info_vertex_listing",
    f"WITH {VALUES_SQL}, {SEEN_SQL}, u AS (SELECT vertex_id, count(*) AS n_builds FROM seen GROUP BY vertex_id), r AS (SELECT x.*, n_builds, CASE kind WHEN 'atom' THEN 0 WHEN 'low_res' THEN 1 WHEN 'bundle' THEN 2 WHEN 'residue' THEN 3 ELSE 4 END AS k FROM vertices x JOIN u ON x.vertex_id = u.vertex_id), n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY molecule_instance NULLS FIRST, residue_id NULLS FIRST, atom_nr NULLS FIRST, vertex_id) AS rn FROM r) "
    "SELECT vertex_id, kind, label, n_builds FROM n WHERE rn <= 40 ORDER BY k, molecule_instance NULLS FIRST, residue_id NULLS FIRST, atom_nr NULLS FIRST, vertex_id LIMIT 200",
)
def info_vertex_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The display listing of the vertices that any build shows, with the number of builds."""
    n = networks(spark, sf_dir)
    shown = n.vertices.join(seen_vertices(n).groupBy("vertex_id").agg(F.count(F.lit(1)).alias("n_builds")), "vertex_id")
    return info.vertex_listing(shown).select("vertex_id", "kind", "label", "n_builds")


@query("radius_transform", f"WITH {analysis_sql('vdw+cl', 'per_coarse_member_product')} SELECT build_id, edge_key, round(ln(1 + abs(value)) * 0.05, 6) AS r_log, round(sqrt(abs(value)) * 0.05, 6) AS r_sqrt, round(abs(value) * 0.05, 6) AS r_linear, CASE WHEN value < 0 THEN 'blue' ELSE 'red' END AS color FROM a WHERE abs(value) > 0")
def radius_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analysis(spark, sf_dir, "vdw+cl", "per_coarse_member_product").where("abs(value) > 0")
    radii = [F.round(radius(F.col("value"), m, 0.05), 6).alias(f"r_{m}") for m in ("log", "sqrt", "linear")]
    return a.select("build_id", "edge_key", *radii, F.when(F.col("value") < 0, "blue").otherwise("red").alias("color"))


def _coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every atom, with a mass: the mean over all frames that its embedding holds, three components a frame."""
    e = table(spark, sf_dir, "embeddings").where("size(embedding) >= 3")
    frames = e.select("vec_id", "embedding", F.explode(F.expr("sequence(0, CAST(size(embedding) div 3 - 1 AS INT))")).alias("frame"))
    at = lambda k: F.avg(F.get("embedding", F.col("frame") * 3 + k).cast("double"))
    mass = F.when(F.col("vec_id") % 7 != 0, (F.col("vec_id") % 5 + 1).cast("double"))
    return frames.groupBy("vec_id").agg(at(0).alias("x"), at(1).alias("y"), at(2).alias("z")).select(F.col("vec_id").cast("int").alias("atom_index"), "x", "y", "z", mass.alias("mass"))


CENTERS_SQL = (
    "p AS (SELECT CAST(vec_id AS INT) AS atom_index, " + ", ".join(f"avg(CAST(embedding[f * 3 + {k}] AS DOUBLE)) AS {a}" for k, a in enumerate("xyz", 1)) + ", any_value(CASE WHEN vec_id % 7 <> 0 THEN CAST(vec_id % 5 + 1 AS DOUBLE) END) AS mass "
    "FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 3)) AS f FROM embeddings) GROUP BY vec_id), "
    "ce AS (SELECT vertex_id, " + ", ".join(f"CASE WHEN count(*) = count(mass) THEN sum(mass * {a}) / sum(mass) ELSE avg({a}) END AS {a}" for a in "xyz") + " FROM vertex_members JOIN p ON vertex_members.atom_index = p.atom_index GROUP BY vertex_id)"
)


@query("vertex_centers", f"WITH {CENTERS_SQL} SELECT vertex_id, " + ", ".join(f"round({a}, 6) AS {a}" for a in "xyz") + " FROM ce")
def vertex_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(viewer.vertex_centers(table(spark, sf_dir, "vertex_members"), _coordinates(spark, sf_dir)), "x", "y", "z", digits=6)


@query(
    "drawn_edges",
    f"WITH {analysis_sql('vdw+cl', 'per_coarse_member_product')}, {CENTERS_SQL}, {_AUTO.format(p=0.0005)}, k AS (SELECT a.* FROM a LEFT JOIN t ON a.build_id = t.build_id WHERE (coalesce(th, 0) <= 0 OR abs_value >= th) AND abs_value > 0) "
    "SELECT build_id, edge_key, CASE WHEN value < 0 THEN 'blue' ELSE 'red' END AS color, round(ln(1 + abs_value) * 0.05, 4) AS radius, " + ", ".join(f"round(c{i}.{a} * 10, 3) AS {a}{i}" for i in (1, 2) for a in "xyz") + " FROM k JOIN ce c1 ON vertex1 = c1.vertex_id JOIN ce c2 ON vertex2 = c2.vertex_id",
)
def drawn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is drawn of the edges of all builds: colour, radius and both ends in angstrom."""
    centers = viewer.to_angstrom(viewer.vertex_centers(table(spark, sf_dir, "vertex_members"), _coordinates(spark, sf_dir)), "nm")
    a = E.above_threshold(analysis(spark, sf_dir, "vdw+cl", "per_coarse_member_product"), "auto", 0.05, BY)
    ends = [f"{a}{i}" for i in (1, 2) for a in "xyz"]
    return rounded(rounded(viewer.drawn_edges(a, centers).select("build_id", "edge_key", "color", "radius", *ends), "radius"), *ends, digits=3)


# --- streams -----------------------------------------------------------------------------------------------------------


@query(
    "stream_frame_totals",
    f"SELECT build_id, frame, count(*) AS n_rows, CAST(sum(coalesce(n_atom_pairs, 0)) AS BIGINT) AS n_atom_pairs, {near('sum(CASE WHEN isfinite(coulomb) THEN CAST(coulomb AS DOUBLE) END)', 3)} AS coulomb FROM frame_values GROUP BY build_id, frame",
)
def stream_frame_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.streaming.frames import stream_frame_totals as totals

    # a table is one file in the folder, or a folder of files
    folder = spark.read.parquet(f"{sf_dir}/frame_values.parquet").inputFiles()[0].rpartition("/")[0]
    single = not folder.endswith("frame_values.parquet")
    return rounded(totals(spark, folder, "frame_values.parquet" if single else None), "coulomb", digits=3)
