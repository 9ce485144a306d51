"""Tables for structure viewers: centres of vertices, drawn edges, and their text files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.errors import NetworkError
from weftgraph.functions.values import finite, radius
from weftgraph.sources.tsv import one_file, write_tsv

# First letter of the bead name of each kind.
BEAD = {"atom": "A", "residue": "R", "low_res": "L", "bundle": "B"}


def vertex_centers(members: DataFrame, coordinates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Centre of every vertex: of mass if all its masses are finite and add up to more than 0, else the mean place.

    ``coordinates``: atom_index, x, y, z, mass (may be null).
    """
    by = by or []
    rows = members.join(coordinates, "atom_index")
    known = F.bool_and(finite(F.col("mass"))) & (F.sum(F.coalesce(F.when(finite(F.col("mass")), F.col("mass")), F.lit(0.0))) > 0)
    total = F.sum(F.when(finite(F.col("mass")), F.col("mass")))
    axes = [F.when(known, F.sum(F.col("mass") * F.col(a)) / F.when(total != 0, total)).otherwise(F.avg(a)).alias(a) for a in ("x", "y", "z")]
    return rows.groupBy(*by, "vertex_id").agg(*axes)


def check_centers(vertices: DataFrame, members: DataFrame, n_atoms: int, centers: DataFrame) -> None:
    if not members.where((F.col("atom_index") < 0) | (F.col("atom_index") >= n_atoms)).isEmpty():
        raise NetworkError("members name atoms that the structure does not have")
    if bad := vertices.join(centers, "vertex_id", "left_anti").limit(5).collect():
        raise NetworkError(f"vertices without a centre: {[r.vertex_id for r in bad]}")


def to_angstrom(centers: DataFrame, unit: str = "auto") -> DataFrame:
    """Coordinates in angstrom. auto: an extent below 30 means nm."""
    if unit not in ("auto", "nm", "angstrom"):
        raise ValueError(f"unknown unit {unit!r}")
    if unit == "auto":
        e = centers.agg(*(F.max(a) - F.min(a) for a in ("x", "y", "z"))).first()
        unit = "nm" if max((v or 0.0) for v in e) < 30 else "angstrom"
    k = 10.0 if unit == "nm" else 1.0
    return centers.withColumns({a: F.col(a) * k for a in ("x", "y", "z")})


# The remarks of a bead file and the commands of a loader.
BEAD_REMARKS = ("REMARK pseudo-bead vertex centers", "REMARK coordinates are written in Angstrom", "REMARK atom serial and residue id are vertex_id + 1")
LOADER = (
    "set here [file dirname [info script]]", "mol new [file join $here network_beads.pdb] type pdb", "mol delrep 0 top", "mol representation VDW {radius:.4f} 12",
    "mol color Name", "mol selection all", "mol material Opaque", "mol addrep top", "source [file join $here drawer.tcl]",
)


def bead_lines(vertices: DataFrame, centers: DataFrame) -> DataFrame:
    """vertex_id and line: one PDB atom line per vertex, whose serial and residue id are vertex_id + 1."""
    clean = F.substring(F.upper(F.regexp_replace(F.coalesce("residue_name", F.lit("")), r"[^\p{L}\p{N}]", "")), 1, 3)
    letter = F.lit("V")
    for kind, c in BEAD.items():
        letter = F.when(F.col("kind") == kind, c).otherwise(letter)
    number = (F.col("vertex_id") + 1).cast("long")
    line = F.format_string("HETATM%5d  %s   %3s A%4d    %8.3f%8.3f%8.3f%6.2f%6.2f           X", number, letter, F.when(clean == "", "VTX").otherwise(clean), number, "x", "y", "z", F.lit(1.0), F.lit(0.0))
    return vertices.join(centers, "vertex_id").select("vertex_id", line.alias("line"))


def drawn_edges(analysis: DataFrame, centers: DataFrame, mode: str = "log", scale: float = 0.05) -> DataFrame:
    """Edges with both centres, radius and colour; those without a positive finite radius are not drawn."""
    rows = analysis.withColumn("radius", radius(F.col("value"), mode, scale)).where(finite(F.col("radius")) & (F.col("radius") > 0))
    for i in ("1", "2"):
        rows = rows.join(centers.select(F.col("vertex_id").alias(f"vertex{i}"), *(F.col(a).alias(a + i) for a in ("x", "y", "z"))), f"vertex{i}")
    return rows.withColumn("color", F.when(F.col("value") < 0, "blue").otherwise("red"))


def draw_lines(edges: DataFrame) -> DataFrame:
    """edge_key and line: the drawing commands of every edge, colour and cylinder."""
    line = F.format_string("draw color %s\ndraw cylinder {%.3f %.3f %.3f} {%.3f %.3f %.3f} radius %.4f filled yes resolution 12", "color", "x1", "y1", "z1", "x2", "y2", "z2", "radius")
    return edges.select("edge_key", line.alias("line"))


def write_lines(lines: DataFrame, order: str, path: str, head: tuple[str, ...] = (), tail: tuple[str, ...] = ()) -> None:
    """The lines in order as one text file, as viewers read no folders, between those of ``head`` and ``tail``."""
    spark = lines.sparkSession
    rows = lines.select(F.lit(1).alias("part"), F.col(order).cast("long").alias("place"), "line")
    for part, texts in ((0, head), (2, tail)):
        if texts:
            rows = rows.unionByName(spark.createDataFrame([(part, k, t) for k, t in enumerate(texts)], "part int, place long, line string"))
    one_file(spark, path, lambda folder: rows.orderBy("part", "place").select("line").coalesce(1).write.text(folder))


def write_viewer(vertices: DataFrame, centers: DataFrame, analysis: DataFrame, folder: str, mode: str = "log", scale: float = 0.05, bead_radius: float = 0.25) -> None:
    """The files that a viewer loads: network_beads.pdb with its labels, drawer.tcl, and load.tcl, which loads both."""
    write_lines(bead_lines(vertices, centers), "vertex_id", f"{folder}/network_beads.pdb", BEAD_REMARKS, ("END",))
    write_tsv(vertices.select("vertex_id", "label").orderBy("vertex_id"), f"{folder}/network_beads.labels.tsv")
    about = ("# coordinates are in Angstrom, matching network_beads.pdb", f"# radius_mode = {mode}", f"# radius_scale = {scale:g}", "draw delete all", "draw materials on")
    write_lines(draw_lines(drawn_edges(analysis, centers, mode, scale)), "edge_key", f"{folder}/drawer.tcl", about)
    loader = tuple(c.format(radius=bead_radius) for c in LOADER)
    write_lines(vertices.sparkSession.createDataFrame([], "place long, line string"), "place", f"{folder}/load.tcl", loader)
