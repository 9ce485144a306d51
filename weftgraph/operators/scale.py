"""The unit of raw coordinates, told from local distances."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.errors import ScaleError
from weftgraph.operators.pairs import AXES, minimum_image, pairs_within
from weftgraph.operators.percentile import exact_percentile
from weftgraph.session import written

MAX_PAIRS = 20_000
# Distances below which atoms are too close, and the units that coordinates may be in.
TOO_CLOSE_NM = 0.08
HYPOTHESES = (("nm", 1.0), ("angstrom", 0.1))


def pair_distances(positions: DataFrame, pairs: DataFrame, boxes: DataFrame | None = None, most: int = MAX_PAIRS) -> DataFrame:
    """Distances in raw units of the pairs (i, j) in one frame; of more than about ``most`` pairs a sample by hash.

    The sample is a feature of the inference: the unit needs no more, and the bound keeps it cheap.
    """
    n = pairs.count()
    p = pairs if n <= most else pairs.where(F.pmod(F.xxhash64("i", "j"), F.lit(n)) < most)
    side = {a: F.lit(None).cast("double") for a in AXES}
    a = positions.select(F.col("atom_index").alias("i"), "frame", *(F.col(x).alias(f"{x}_i") for x in AXES))
    b = positions.select(F.col("atom_index").alias("j"), "frame", *(F.col(x).alias(f"{x}_j") for x in AXES))
    rows = p.join(a, "i").join(b, ["frame", "j"])
    if boxes is not None:
        rows = rows.join(boxes.select("frame", *(f"l{x}" for x in AXES)), "frame", "left")
        side = {x: F.when(F.col(f"l{x}") > 0, F.col(f"l{x}")) for x in AXES}
    square = None
    for x in AXES:
        d = minimum_image(F.col(f"{x}_i") - F.col(f"{x}_j"), side[x])
        square = d * d if square is None else square + d * d
    return rows.select(F.sqrt(square).alias("distance")).where("distance > 0 AND distance < double('infinity')")


def nearest_distances(positions: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Distance of every atom of one frame to its nearest neighbour, in raw units; atoms in one place have none to each other.

    The cells of the join are as wide as two atoms lie apart on average; atoms that find no neighbour look twice as far, until all
    have one or nothing is left to look at.
    """
    extent = [F.max(a) - F.min(a) for a in AXES]
    n, *spans = positions.agg(F.count(F.lit(1)), *extent).first()
    nothing = positions.select(F.lit(None).cast("double").alias("distance")).where("false")
    if n < 2 or not max(spans):
        return nothing
    reach = 2 * math.prod(max(s, max(spans) * 1e-3) for s in spans) ** (1 / 3) / n ** (1 / 3)
    found, todo = nothing, positions.select("frame", "atom_index")
    while True:
        ends = F.explode(F.array("i", "j")).alias("atom_index")
        # those found before may still be neighbours of the others
        close = pairs_within(positions, reach, boxes).where("r > 0").select("r", ends).join(todo.select("atom_index"), "atom_index", "left_semi")
        near = written(close.groupBy("atom_index").agg(F.min("r").alias("distance")), "nearest")
        found = found.unionByName(near.select("distance"))
        todo = written(todo.join(near, "atom_index", "left_anti"), "alone")
        reach *= 2
        if todo.isEmpty() or reach > 4 * sum(spans):
            return found


def score(p05: Column, p50: Column, p95: Column, too_close: Column, within: Column, cutoff: Column) -> Column:
    """Penalty of a hypothesis; the lower the likelier. Distances in nm.

    Fixed values: weights and limits of the penalties.
    """
    far = F.greatest(F.lit(2.5), 2 * cutoff)
    return (
        10_000 * too_close
        + F.when(p50 < 0.12, 2000 * (0.12 - p50) / 0.12).otherwise(0.0)
        + F.when(p05 < 0.05, 1000 * (0.05 - p05) / 0.05).otherwise(0.0)
        + F.when(p50 > 1.5, 2000 * (p50 - 1.5) / 1.5).otherwise(0.0)
        + F.when(p95 > far, 500 * (p95 - far)).otherwise(0.0)
        + F.abs(F.ln(F.greatest(p50, F.lit(1e-12)) / 0.35))
        + F.when(within < 0.005, 100.0).otherwise(0.0)
    )


def scale_hypotheses(distances: DataFrame, cutoff_nm: float, by: list[str] | None = None) -> DataFrame:
    """For each hypothesis about the unit its distance percentiles in nm and its score. Exact, and no group is gathered: the percentiles
    are taken once in raw units, as a unit only scales them."""
    by = by or []
    d = written(distances.select(*by, "distance"), "distances")
    options = F.array(*(F.struct(F.lit(u).alias("inferred_input_unit"), F.lit(s).alias("scale_to_nm")) for u, s in HYPOTHESES))
    share = lambda limit, s: F.avg((F.col("distance") * s < limit).cast("double"))
    within = lambda s: F.avg((F.col("distance") * s <= cutoff_nm).cast("double"))
    counts = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs_sampled"), *(f(s).alias(f"{n}_{u}") for u, s in HYPOTHESES for n, f in (("close", lambda s: share(TOO_CLOSE_NM, s)), ("within", within))))
    got = counts.where("n_pairs_sampled > 0")
    for p in (1, 5, 50, 95):
        q = exact_percentile(d, by, "distance", p / 100, f"p{p:02d}")
        if by:
            same = F.expr(" AND ".join(f"a.{k} <=> b.{k}" for k in by))
            got = got.alias("a").join(q.alias("b"), same).select("a.*", f"p{p:02d}")
        else:
            got = got.withColumn(f"p{p:02d}", F.lit(q.first()[0]).cast("double"))
    pick = lambda n: F.when(F.col("inferred_input_unit") == HYPOTHESES[0][0], F.col(f"{n}_{HYPOTHESES[0][0]}")).otherwise(F.col(f"{n}_{HYPOTHESES[1][0]}"))
    rows = got.select("*", F.inline(options)).withColumns({f"p{p:02d}_nm": F.col(f"p{p:02d}") * F.col("scale_to_nm") for p in (1, 5, 50, 95)})
    rows = rows.withColumns({"too_close_fraction_nm": pick("close"), "cutoff_fraction_nm": pick("within")})
    rows = rows.withColumn("score", score(F.col("p05_nm"), F.col("p50_nm"), F.col("p95_nm"), F.col("too_close_fraction_nm"), F.col("cutoff_fraction_nm"), F.lit(float(cutoff_nm))))
    return rows.select(*by, "inferred_input_unit", "scale_to_nm", "n_pairs_sampled", F.col("p50").alias("median_input"), "p01_nm", "p05_nm", "p50_nm", "p95_nm", "too_close_fraction_nm", "cutoff_fraction_nm", "score")


def infer_scale(distances: DataFrame, cutoff_nm: float) -> dict:
    """The likelier hypothesis as a dict; an error if there are no distances or the two are about as likely."""
    rows = sorted((r.asDict() for r in scale_hypotheses(distances, cutoff_nm).collect()), key=lambda r: r["score"])
    if not rows:
        raise ScaleError("there are no usable distances to tell the unit from")
    if rows[1]["score"] - rows[0]["score"] < 1.0:
        raise ScaleError(f"the unit cannot be told: scores {rows[0]['score']:.6g} and {rows[1]['score']:.6g}")
    return rows[0]
