"""Queries over coordinates and atoms: the steps that build a network, with SQL that gives the same rows.

Atoms come from the parts; the coordinates of a frame are three components of the embeddings, in as many frames as they hold.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators import pairs, resolution, scale, topology
from weftgraph.plans.network_queries import Query, rounded
from weftgraph.session import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, atom_index, x, y, z, type, charge and vertex_id: one atom per embedding, one frame per three components."""
    e = table(spark, sf_dir, "embeddings").where("size(embedding) >= 3")
    frames = F.explode(F.expr("sequence(0, CAST(size(embedding) div 3 - 1 AS INT))")).alias("frame")
    rows = e.select(F.col("vec_id").cast("int").alias("atom_index"), "label", "embedding", frames)
    at = lambda k: F.get("embedding", F.col("frame") * 3 + k).cast("double")
    charge = (F.pmod("atom_index", F.lit(3)) - 1).cast("double")
    return rows.select("frame", "atom_index", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), F.col("label").cast("string").alias("type"), charge.alias("charge"), F.expr("atom_index div 5").cast("int").alias("vertex_id"))


POSITIONS_SQL = """p AS (SELECT f.frame, CAST(vec_id AS INT) AS atom_index, CAST(embedding[f.frame * 3 + 1] AS DOUBLE) AS x, CAST(embedding[f.frame * 3 + 2] AS DOUBLE) AS y, CAST(embedding[f.frame * 3 + 3] AS DOUBLE) AS z,
  CAST(label AS VARCHAR) AS type, CAST(vec_id % 3 - 1 AS DOUBLE) AS charge, CAST(vec_id // 5 AS INT) AS vertex_id FROM (SELECT *, CAST(unnest(range(0, len(embedding) // 3)) AS INT) AS frame FROM embeddings) f)"""


def pairs_sql(cutoff: float, side: float | None) -> str:
    d = {a: f"(a.{a} - b.{a})" if side is None else f"((a.{a} - b.{a}) - {side} * round_even((a.{a} - b.{a}) / {side}, 0))" for a in "xyz"}
    r2 = " + ".join(f"{d[a]} * {d[a]}" for a in "xyz")
    return f"""{POSITIONS_SQL}, q AS (SELECT a.frame, a.atom_index AS i, b.atom_index AS j, {r2} AS r2, a.type AS type_i, b.type AS type_j, a.charge AS charge_i, b.charge AS charge_j, a.vertex_id AS vertex_id_i, b.vertex_id AS vertex_id_j
  FROM p a JOIN p b ON a.frame = b.frame AND a.atom_index < b.atom_index WHERE {r2} <= {cutoff} * {cutoff})"""


def boxes(pos: DataFrame, side: float) -> DataFrame:
    return pos.select("frame").distinct().select("frame", *(F.lit(side).alias(f"l{a}") for a in "xyz"))


def _pairs(cutoff: float, side: float | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = positions(spark, sf_dir)
    return pairs.pairs_within(pos, cutoff, None if side is None else boxes(pos, side), ["type", "charge", "vertex_id"])


def _counted(cutoff: float, side: float | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of every frame and atom with the sum of their distances."""
    return rounded(_pairs(cutoff, side, spark, sf_dir).groupBy("frame", "i").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("r").alias("sum_r")), "sum_r", digits=5)


_COUNT = "SELECT frame, i, count(*) AS n_pairs, round(sum(sqrt(r2)), 5) AS sum_r FROM q GROUP BY frame, i"
for _name, _cut, _side in (("periodic", 0.12, 1.0), ("open", 0.12, None), ("two_cells", 0.2, 0.5), ("one_cell", 0.25, 0.3)):
    query(f"pair_join_cutoff_{_name}", f"WITH {pairs_sql(_cut, _side)} {_COUNT}")(partial(_counted, _cut, _side))


def _vdw_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of the labels as atom types; types 1 and 2 have parameters of their own together."""
    used = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("atom_type")).distinct()
    n = F.col("atom_type").cast("double")
    types = used.select("atom_type", (0.02 + n * 0.001).alias("sigma"), (1.0 + n * 0.1).alias("epsilon"))
    given = spark.createDataFrame([("2", "1", 0.025, 2.0)], "type_i string, type_j string, sigma double, epsilon double")
    return topology.vdw_type_pairs(types, used, given)


TYPES_SQL = """t AS (SELECT DISTINCT CAST(label AS VARCHAR) AS atom_type, 0.02 + CAST(label AS DOUBLE) * 0.001 AS sigma, 1.0 + CAST(label AS DOUBLE) * 0.1 AS epsilon FROM embeddings),
tp AS (SELECT a.atom_type AS type_i, b.atom_type AS type_j, CASE WHEN a.atom_type = '1' AND b.atom_type = '2' THEN 0.025 ELSE (a.sigma + b.sigma) / 2 END AS sigma,
  CASE WHEN a.atom_type = '1' AND b.atom_type = '2' THEN 2.0 ELSE sqrt(a.epsilon * b.epsilon) END AS epsilon, CASE WHEN a.atom_type = '1' AND b.atom_type = '2' THEN 'nonbond_params' ELSE 'combination_rule_2' END AS source
  FROM t a JOIN t b ON a.atom_type <= b.atom_type)"""


@query("vdw_type_pairs", f"WITH {TYPES_SQL} SELECT type_i, type_j, round(sigma, 9) AS sigma, round(epsilon, 9) AS epsilon, source FROM tp")
def vdw_type_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_vdw_types(spark, sf_dir), "sigma", "epsilon", digits=9)


RVDW, RCOULOMB = 0.1, 0.12
ENERGY_SQL = f"""{pairs_sql(0.12, 1.0)}, {TYPES_SQL},
e AS (SELECT q.*, sqrt(r2) AS r, sigma, epsilon FROM q JOIN tp ON least(q.type_i, q.type_j) = tp.type_i AND greatest(q.type_i, q.type_j) = tp.type_j
  WHERE vertex_id_i <> vertex_id_j AND NOT (i // 10 = j // 10 AND j = i + 1)),
en AS (SELECT frame, i, j, r, vertex_id_i, vertex_id_j, CASE WHEN r <= {RVDW} THEN 4 * epsilon * (pow(sigma / r, 12) - pow(sigma / r, 6)) ELSE 0.0 END AS vdw, CASE WHEN r <= {RCOULOMB} THEN 138.935458 * charge_i * charge_j / r ELSE 0.0 END AS coulomb,
  CASE WHEN r <= {RVDW} THEN 24 * epsilon / r * (pow(sigma / r, 6) - 2 * pow(sigma / r, 12)) ELSE 0.0 END AS vdw_dif, CASE WHEN r <= {RCOULOMB} THEN -138.935458 * charge_i * charge_j / (r * r) ELSE 0.0 END AS coulomb_dif FROM e)"""


def _energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energies of pairs between different vertices; successive atoms of a molecule (ten atoms) are excluded."""
    pos = positions(spark, sf_dir)
    excluded = pos.where("frame = 0 AND atom_index % 10 < 9").select(F.col("atom_index").alias("i"), (F.col("atom_index") + 1).alias("j"))
    atoms = pos.where("frame = 0").select("atom_index", F.col("type").alias("atom_type"), "charge", F.expr("atom_index div 10").alias("molecule_instance"), F.lit("M").alias("molecule_type"))
    members = pos.where("frame = 0").select("atom_index", "vertex_id")
    close = pairs.interacting_pairs(pos.select("frame", "atom_index", "x", "y", "z"), atoms, members, excluded, max(RVDW, RCOULOMB), boxes(pos, 1.0))
    return pairs.pair_energies(close, _vdw_types(spark, sf_dir), RVDW, RCOULOMB)


ENERGIES = ("vdw", "coulomb", "vdw_dif", "coulomb_dif")


#: Bits of an energy that are compared, about six digits: energies span many powers of ten, and engines differ in the last bits of a power.
BITS = 20


def significant(df: DataFrame, *columns: str) -> DataFrame:
    """Columns to ``BITS`` significant bits; what is below 1e-9 is 0."""

    def near(c: str) -> Column:
        x, scale = F.abs(c), F.pow(F.lit(2.0), BITS - F.floor(F.log2(F.abs(c))))
        return F.when(x < 1e-9, 0.0).when(F.isnan(c), F.col(c)).otherwise(F.signum(c) * F.floor(x * scale + 0.5) / scale)

    return df.withColumns({c: near(c) for c in columns})


def significant_sql(x: str) -> str:
    scale = f"pow(2.0, {BITS} - floor(log2(abs({x}))))"
    return f"CASE WHEN abs({x}) < 1e-9 THEN 0.0 ELSE sign({x}) * floor(abs({x}) * {scale} + 0.5) / {scale} END"


@query("pair_energies", f"WITH {ENERGY_SQL} SELECT frame, i, j, " + ", ".join(f"{significant_sql(c)} AS {c}" for c in ENERGIES) + " FROM en")
def pair_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return significant(_energies(spark, sf_dir).select("frame", "i", "j", *ENERGIES), *ENERGIES)


@query(
    "frame_edge_values",
    f"WITH {ENERGY_SQL}, su AS (SELECT frame, CAST(least(vertex_id_i, vertex_id_j) AS BIGINT) * 1000000 + greatest(vertex_id_i, vertex_id_j) AS edge_key, " + ", ".join(f"CAST(CAST(sum({c}) AS FLOAT) AS DOUBLE) AS {c}" for c in ENERGIES)
    + ", CAST(count(*) AS INT) AS n_atom_pairs FROM en GROUP BY ALL) SELECT frame, edge_key, " + ", ".join(f"{significant_sql(c)} AS {c}" for c in ENERGIES) + ", n_atom_pairs FROM su",
)
def frame_edge_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value table as the operator makes it, with all four sums."""
    return significant(pairs.frame_edge_values(_energies(spark, sf_dir), 1_000_000).withColumns({c: F.col(c).cast("double") for c in ENERGIES}), *ENERGIES)


# --- atoms and vertices: parts as atoms, their brands as molecules, their sizes as residues -----------------------------

ATOMS_SQL = """ta AS (SELECT CAST(p_partkey AS INT) AS atom_index, CAST(p_partkey + 1 AS INT) AS atom_nr, CAST(p_size AS INT) AS residue_id, upper(substr(p_type, 1, 3)) AS residue_name,
  p_brand AS molecule_type, CAST(p_partkey % 3 + 1 AS INT) AS molecule_instance, 'X' || CAST(p_partkey % 4 AS VARCHAR) AS atom_name, p_type AS atom_type, p_retailprice AS charge FROM part)"""


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("int")
    return part.select(
        key.alias("atom_index"), (key + 1).alias("atom_nr"), F.col("p_size").cast("int").alias("residue_id"), F.upper(F.substring("p_type", 1, 3)).alias("residue_name"), F.col("p_brand").alias("molecule_type"),
        (key % 3 + 1).alias("molecule_instance"), F.concat(F.lit("X"), (key % 4).cast("string")).alias("atom_name"), F.col("p_type").alias("atom_type"), F.col("p_retailprice").alias("charge"),
    )


HIGH, LOW, BUNDLE = ["resid 10-12 7"], ["STA", "resname lar and resid 1-40"], [["MED", "SMA:1-30"]]
_LOW1, _LOW2 = "residue_name = 'STA'", "(residue_name = 'LAR' AND residue_id BETWEEN 1 AND 40)"
RESOLVED_SQL = f"""{ATOMS_SQL}, k AS (SELECT *, CASE WHEN residue_id BETWEEN 10 AND 12 OR residue_id = 7 THEN 'atom' WHEN {_LOW1} OR {_LOW2} THEN 'low_res' WHEN residue_name = 'MED' OR (residue_name = 'SMA' AND residue_id BETWEEN 1 AND 30) THEN 'bundle' ELSE 'residue' END AS kind FROM ta),
l AS (SELECT *, CASE kind WHEN 'atom' THEN residue_name || ':' || residue_id || ':' || atom_name || ':' || atom_nr WHEN 'low_res' THEN CASE WHEN {_LOW1} THEN 'STA' ELSE 'resname lar and resid 1-40' END WHEN 'bundle' THEN 'MED+SMA:1-30' ELSE residue_name || ':' || residue_id END AS label,
  CASE kind WHEN 'atom' THEN 'a' || atom_index WHEN 'low_res' THEN CASE WHEN {_LOW1} THEN 'l0' ELSE 'l1' END WHEN 'bundle' THEN 'b0' ELSE 'r' || molecule_type || ':' || molecule_instance || ':' || residue_id || ':' || residue_name END AS key FROM k),
g AS (SELECT key, min(atom_index) AS first_atom, count(*) AS n, arg_min(label, atom_index) AS label, arg_min(kind, atom_index) AS kind, arg_min(residue_id, atom_index) AS residue_id FROM l GROUP BY key)"""


@query("vertex_resolution", f"WITH {RESOLVED_SQL} SELECT row_number() OVER (ORDER BY first_atom) - 1 AS vertex_id, label, kind, residue_id, n AS n_members FROM g")
def vertex_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = resolution.assign_vertices(atoms(spark, sf_dir), HIGH, LOW, BUNDLE)
    v = resolution.vertex_table(assigned)
    members = resolution.vertex_members(assigned, v).groupBy("vertex_id").agg(F.count(F.lit(1)).alias("n_members"))
    return v.join(members, "vertex_id").select("vertex_id", "label", "kind", "residue_id", "n_members")


def _system(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Brands as molecules with three instances each (four of the first), and their parts as templates."""
    a = atoms(spark, sf_dir)
    templates = a.select(F.col("molecule_type").alias("molecule"), F.col("atom_nr").alias("nr"), F.col("residue_id").alias("residue_nr"), "residue_name", "atom_name", "atom_type", "charge")
    w = Window.orderBy("molecule")  # over the few brands
    entries = templates.select("molecule").distinct().withColumn("ordinal", F.row_number().over(w) - 1)
    return entries.withColumn("count", F.when(F.col("ordinal") == 0, 4).otherwise(3)), templates


SYSTEM_SQL = f"""{ATOMS_SQL}, mt AS (SELECT molecule_type, row_number() OVER (ORDER BY molecule_type) - 1 AS ordinal, CASE WHEN row_number() OVER (ORDER BY molecule_type) = 1 THEN 4 ELSE 3 END AS cnt FROM (SELECT DISTINCT molecule_type FROM ta)),
tm AS (SELECT a.*, cnt, ordinal, row_number() OVER (PARTITION BY a.molecule_type ORDER BY atom_nr) AS place, min(atom_nr) OVER (PARTITION BY a.molecule_type, residue_id) AS rf FROM ta a JOIN mt ON a.molecule_type = mt.molecule_type),
tr AS (SELECT *, dense_rank() OVER (PARTITION BY molecule_type ORDER BY rf) AS rplace FROM tm),
sz AS (SELECT molecule_type, any_value(ordinal) AS ordinal, any_value(cnt) AS cnt, count(*) AS atoms_each, max(rplace) AS res_each FROM tr GROUP BY molecule_type),
off AS (SELECT *, coalesce(sum(cnt * atoms_each) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ab, coalesce(sum(cnt * res_each) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rb FROM sz)"""


@query(
    "molecule_expand",
    f"WITH {SYSTEM_SQL}, inst AS (SELECT off.*, unnest(range(1, cnt + 1)) AS k FROM off) SELECT CAST(ab + (k - 1) * atoms_each + place AS INT) AS atom_nr, CAST(rb + (k - 1) * res_each + rplace AS INT) AS residue_id, residue_name, tr.molecule_type, CAST(k AS INT) AS molecule_instance, atom_name FROM inst JOIN tr ON inst.molecule_type = tr.molecule_type",
)
def molecule_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.expand_molecules(*_system(spark, sf_dir)).select("atom_nr", "residue_id", "residue_name", "molecule_type", "molecule_instance", "atom_name")


@query("trailing_exclusion", f"WITH {SYSTEM_SQL} SELECT CAST(ordinal AS INT) AS ordinal, molecule_type AS molecule, CAST(cnt AS INT) AS count FROM off WHERE ordinal < (SELECT max(ordinal) FROM off)")
def trailing_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of a structure that lacks the last molecule type."""
    entries, templates = _system(spark, sf_dir)
    sized = entries.join(templates.groupBy("molecule").agg(F.count(F.lit(1)).alias("atoms_each")), "molecule")
    last = sized.agg(F.max("ordinal")).first()[0]
    n = sized.where(F.col("ordinal") < last).agg(F.sum(F.col("count") * F.col("atoms_each"))).first()[0]
    return topology.trailing_exclusion(sized, n).select("ordinal", "molecule", "count")


@query(
    "bonded_exclusions",
    "WITH r AS (SELECT DISTINCT CAST(build_id AS VARCHAR) || molecule_type || CAST(molecule_instance AS VARCHAR) AS molecule, residue_id AS i FROM residue_neighbors WHERE residue_id IS NOT NULL AND molecule_type IS NOT NULL AND molecule_instance IS NOT NULL), "
    "n AS (SELECT molecule, i, lead(i) OVER (PARTITION BY molecule ORDER BY i) AS j FROM r), b AS (SELECT molecule, i, j FROM n WHERE j IS NOT NULL UNION SELECT molecule, j, i FROM n WHERE j IS NOT NULL), "
    "h AS (SELECT molecule, i, j FROM b UNION SELECT x.molecule, x.i, y.j FROM b x JOIN b y ON x.molecule = y.molecule AND x.j = y.i), h3 AS (SELECT * FROM h UNION SELECT x.molecule, x.i, y.j FROM h x JOIN b y ON x.molecule = y.molecule AND x.j = y.i) SELECT molecule, i, j FROM h3 WHERE i < j",
)
def bonded_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residues joined by at most three bonds, where each residue of a molecule is bonded to the next."""
    key = F.concat(F.col("build_id").cast("string"), "molecule_type", F.col("molecule_instance").cast("string")).alias("molecule")
    r = table(spark, sf_dir, "residue_neighbors").select(key, F.col("residue_id").alias("i")).where("molecule IS NOT NULL AND i IS NOT NULL").distinct()
    bonds = r.withColumn("j", F.lead("i").over(Window.partitionBy("molecule").orderBy("i"))).where("j IS NOT NULL")
    return topology.bonded_exclusions(bonds, r.select("molecule", F.lit(3).alias("nrexcl")).distinct())


CUTOFF_NM = 1.2


@query(
    "scale_scores",
    "SELECT cand_id, round(10000 * too_close_fraction_nm + CASE WHEN p50_nm < 0.12 THEN 2000 * (0.12 - p50_nm) / 0.12 ELSE 0 END + CASE WHEN p05_nm < 0.05 THEN 1000 * (0.05 - p05_nm) / 0.05 ELSE 0 END + CASE WHEN p50_nm > 1.5 THEN 2000 * (p50_nm - 1.5) / 1.5 ELSE 0 END "
    "+ CASE WHEN p95_nm > 2.5 THEN 500 * (p95_nm - 2.5) ELSE 0 END + abs(ln(greatest(p50_nm, 1e-12) / 0.35)) + CASE WHEN cutoff_fraction_nm < 0.005 THEN 100 ELSE 0 END, 3) AS score FROM scale_candidates WHERE isfinite(p05_nm) AND isfinite(p50_nm) AND isfinite(p95_nm) AND isfinite(too_close_fraction_nm) AND isfinite(cutoff_fraction_nm)",
)
def scale_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the recorded hypotheses, from their percentiles."""
    c = table(spark, sf_dir, "scale_candidates")
    used = ("p05_nm", "p50_nm", "p95_nm", "too_close_fraction_nm", "cutoff_fraction_nm")
    c = c.where(" AND ".join(f"{x} IS NOT NULL AND NOT isnan({x}) AND abs({x}) < double('infinity')" for x in used))
    s = scale.score(*(F.col(x) for x in used), F.lit(CUTOFF_NM))
    return rounded(c.select("cand_id", s.alias("score")), "score", digits=3)


SCALE_SQL = (
    f"WITH {pairs_sql(0.12, None)}, h AS (SELECT frame, sqrt(r2) AS d, s.u, s.k FROM q CROSS JOIN (SELECT 'nm' AS u, 1.0 AS k UNION ALL SELECT 'angstrom', 0.1) s WHERE r2 > 0) SELECT frame, u AS inferred_input_unit, count(*) AS n_pairs_sampled, round(median(d), 6) AS median_input, round(quantile_cont(d * k, 0.01), 6) AS p01_nm, round(quantile_cont(d * k, 0.05), 6) AS p05_nm, "
    "round(quantile_cont(d * k, 0.5), 6) AS p50_nm, round(quantile_cont(d * k, 0.95), 6) AS p95_nm, round(avg(CASE WHEN d * k < 0.08 THEN 1.0 ELSE 0.0 END), 6) AS too_close_fraction_nm FROM h GROUP BY frame, u"
)


@query("scale_hypotheses", SCALE_SQL)
def scale_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _pairs(0.12, None, spark, sf_dir).where("r2 > 0").select("frame", F.col("r").alias("distance"))
    h = scale.scale_hypotheses(d, CUTOFF_NM, ["frame"]).drop("scale_to_nm", "cutoff_fraction_nm", "score")
    return rounded(h, "median_input", "p01_nm", "p05_nm", "p50_nm", "p95_nm", "too_close_fraction_nm", digits=6)
