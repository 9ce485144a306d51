"""Pairs of atoms within a cut-off, their energies, and the edge values of every frame.

Space is cut into cells at least as wide as the cut-off, so the distance join becomes an equi-join on (frame, cell) with half of
the 27 cells around each atom, and the exact distance a residual condition of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.errors import NetworkError
from weftgraph.session import broadcast_if_bounded

# Fixed value: Coulomb's constant in kJ nm / (mol e^2).
COULOMB = 138.935458
AXES = ("x", "y", "z")
MAX_TYPE_PAIRS = 1_000_000


def check_boxes(boxes: DataFrame) -> None:
    """Only rectangular boxes are supported; sides that are missing or not positive mean no box."""
    tilted = boxes.where("abs(coalesce(alpha, 90) - 90) > 1e-4 OR abs(coalesce(beta, 90) - 90) > 1e-4 OR abs(coalesce(gamma, 90) - 90) > 1e-4")
    if not tilted.isEmpty():
        raise NetworkError("boxes with angles other than 90 degrees are not supported")


def with_cells(positions: DataFrame, cutoff: float, boxes: DataFrame | None = None) -> DataFrame:
    """Adds, for each axis, the cell c*, and in a box its side l* and number of cells n* (both null without a box).

    Cells of an open frame are counted from the origin of the coordinates, so nothing about the frame has to be known first.
    """
    cut = F.lit(float(cutoff))
    if boxes is None:
        rows = positions.withColumns({f"l{a}": F.lit(None).cast("double") for a in AXES})
    else:
        whole = F.col("lx").isNotNull() & (F.least("lx", "ly", "lz") > 0)
        rows = positions.join(boxes.select("frame", *(F.when(whole, F.col(f"l{a}")).alias(f"l{a}") for a in AXES)), "frame", "left")
    for a in AXES:
        side = F.when(F.col(f"l{a}") > 0, F.col(f"l{a}"))
        n = F.greatest(F.lit(1), F.floor(side / cut)).cast("int")
        wrapped = F.col(a) - side * F.floor(F.col(a) / side)
        inside = F.least(F.greatest(F.floor(wrapped / (side / n)), F.lit(0)), n - 1)
        rows = rows.withColumns({f"n{a}": F.when(side.isNotNull(), n), f"c{a}": F.when(side.isNotNull(), inside).otherwise(F.floor(F.col(a) / cut)).cast("int")})
    return rows


def _around(cell: Column, n: Column) -> Column:
    """The cells next to a cell on one axis, wrapped in a box, each once."""
    near = F.array(cell - 1, cell, cell + 1)
    return F.array_distinct(F.when(n.isNotNull(), F.transform(near, lambda c: F.pmod(c, n))).otherwise(near))


def minimum_image(d: Column, side: Column) -> Column:
    return F.when(side.isNotNull(), d - side * F.rint(d / F.when(side != 0, side))).otherwise(d)


def pairs_within(positions: DataFrame, cutoff: float, boxes: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """frame, i, j (i < j by atom_index), r2 and r of all pairs no further apart than the cut-off, in a box by the nearest image.

    ``columns`` of the positions come along as name_i and name_j.
    """
    columns = columns or []
    rows = with_cells(positions, cutoff, boxes)
    cells = ["cx", "cy", "cz"]
    left = rows.select("frame", *cells, F.col("atom_index").alias("a"), *(F.col(x).alias(f"{x}_a") for x in AXES), *(f"l{x}" for x in AXES), *(F.col(c).alias(f"{c}_a") for c in columns))
    right = rows.withColumn("home", F.struct(*cells))
    for x in AXES:  # three small explodes; each neighbouring cell comes up once even where an axis has one or two cells
        right = right.withColumn(f"c{x}", F.explode(_around(F.col(f"c{x}"), F.col(f"n{x}"))))
    # of two neighbouring cells only the atoms of the lesser one go to the other, so half the copies are never shuffled
    right = right.where(F.col("home") <= F.struct(*cells)).withColumn("own", F.col("home") == F.struct(*cells))
    right = right.select("frame", *cells, "own", F.col("atom_index").alias("b"), *(F.col(x).alias(f"{x}_b") for x in AXES), *(F.col(c).alias(f"{c}_b") for c in columns))
    # a number of partitions that is asked for stays: few bytes go in, but many pairs come out, so merged partitions would leave cores idle
    parts = int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (side.repartition(parts, "frame", *cells) for side in (left, right))
    joined = left.join(right, ["frame", *cells]).where("NOT own OR a < b")
    square = None
    for x in AXES:
        d = minimum_image(F.col(f"{x}_a") - F.col(f"{x}_b"), F.col(f"l{x}"))
        square = d * d if square is None else square + d * d
    joined = joined.withColumn("r2", square).where(F.col("r2") <= F.lit(float(cutoff) ** 2))
    ordered = F.col("a") < F.col("b")
    ends = [F.when(ordered, F.col(f"{c}_{s}")).otherwise(F.col(f"{c}_{t}")).alias(f"{c}_{n}") for c in columns for n, s, t in (("i", "a", "b"), ("j", "b", "a"))]
    return joined.select("frame", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "r2", F.sqrt("r2").alias("r"), *ends)


def lennard_jones(r: Column, sigma: Column, epsilon: Column) -> tuple[Column, Column]:
    """Energy and its derivative; NaN at r = 0."""
    safe = F.when(r != 0, r)
    s6 = F.pow(sigma / safe, F.lit(6.0))
    nan = F.lit(float("nan"))
    return F.coalesce(4 * epsilon * (s6 * s6 - s6), nan), F.coalesce(24 * epsilon / safe * (s6 - 2 * s6 * s6), nan)


def coulomb(r: Column, charges: Column) -> tuple[Column, Column]:
    """Energy and its derivative; NaN at r = 0."""
    safe = F.when(r != 0, r)
    nan = F.lit(float("nan"))
    return F.coalesce(COULOMB * charges / safe, nan), F.coalesce(-COULOMB * charges / (safe * safe), nan)


def pair_energies(pairs: DataFrame, vdw_types: DataFrame, rvdw: float, rcoulomb: float) -> DataFrame:
    """Adds vdw, coulomb, vdw_dif and coulomb_dif to pairs with type_i/j and charge_i/j. Beyond its own cut-off an energy is 0.

    ``vdw_types`` has each pair of types once, type_i <= type_j. Few types make very uneven keys, so up to ``MAX_TYPE_PAIRS`` of them
    are broadcast rather than the pairs of atoms shuffled.
    """
    types = vdw_types.select(F.least("type_i", "type_j").alias("_a"), F.greatest("type_i", "type_j").alias("_b"), "sigma", "epsilon")
    rows = pairs.withColumns({"_a": F.least("type_i", "type_j"), "_b": F.greatest("type_i", "type_j")}).join(broadcast_if_bounded(types, MAX_TYPE_PAIRS), ["_a", "_b"]).drop("_a", "_b")
    e, de = lennard_jones(F.col("r"), F.col("sigma"), F.col("epsilon"))
    c, dc = coulomb(F.col("r"), F.col("charge_i") * F.col("charge_j"))
    near_v, near_c, zero = F.col("r") <= rvdw, F.col("r") <= rcoulomb, F.lit(0.0)
    return rows.withColumns({"vdw": F.when(near_v, e).otherwise(zero), "coulomb": F.when(near_c, c).otherwise(zero), "vdw_dif": F.when(near_v, de).otherwise(zero), "coulomb_dif": F.when(near_c, dc).otherwise(zero)})


def interacting_pairs(positions: DataFrame, atoms: DataFrame, atom_vertices: DataFrame, exclusions: DataFrame, cutoff: float, boxes: DataFrame | None = None) -> DataFrame:
    """Pairs within the cut-off between different vertices that are not excluded, with types, charges and vertices of both atoms."""
    info = atoms.select("atom_index", F.col("atom_type").alias("type"), "charge", "molecule_instance", "molecule_type").join(atom_vertices.select("atom_index", "vertex_id"), "atom_index")
    rows = positions.join(info, "atom_index")
    pairs = pairs_within(rows, cutoff, boxes, ["type", "charge", "vertex_id"]).where("vertex_id_i <> vertex_id_j")
    return pairs.join(exclusions.select("i", "j").distinct(), ["i", "j"], "left_anti")


def frame_edge_values(energies: DataFrame, n_vertices: int) -> DataFrame:
    """The value table: sums of the pair energies of every frame and edge, stored as floats, with the number of pairs."""
    a, b = F.least("vertex_id_i", "vertex_id_j").cast("long"), F.greatest("vertex_id_i", "vertex_id_j").cast("long")
    sums = [F.sum(c).cast("float").alias(c) for c in ("vdw", "coulomb", "vdw_dif", "coulomb_dif")]
    return energies.groupBy("frame", (a * F.lit(n_vertices).cast("long") + b).alias("edge_key")).agg(*sums, F.count(F.lit(1)).cast("int").alias("n_atom_pairs"))


def stride(positions: DataFrame, every: int) -> DataFrame:
    """Every so-many-th frame, under its own number."""
    if every < 1:
        raise ValueError("the stride must be at least 1")
    return positions.where(F.pmod("frame", F.lit(every)) == 0)
