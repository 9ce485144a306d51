"""Coordinates from GRO, PDB (several models) and XYZ text, read in splits of any file system that Spark reads.

Lines are numbered within their file by the counts of the splits before, so a file with all its frames is cut where Spark cuts
it; its frames follow from the line numbers. Frames of several files follow each other in the order of the file names. GRO is
in nm, PDB and XYZ in angstrom; coordinates are given as they stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.errors import NetworkError
from weftgraph.session import broadcast_if_bounded, written

COLUMNS = ["file", "frame", "atom_index", "atom_name", "residue_name", "residue_id", "x", "y", "z"]
BOX = ["lx", "ly", "lz", "alpha", "beta", "gamma"]
#: Rows of the tables of files, splits and boxes that are broadcast at most.
SMALL = 1_000_000


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, block (where its split begins), line (from 0 in the file) and value of every line; written once."""
    m = F.col("_metadata")
    rows = spark.read.text(paths).select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", r"\r$", "").alias("value"))
    rows = written(rows, "lines")
    splits = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    rows = rows.join(broadcast_if_bounded(splits, SMALL), ["file", "block"])
    return rows.select("file", "block", (F.col("before") + F.col("id") - F.col("first")).alias("line"), "value")


def _periodic(lines: DataFrame, head: int, tail: int) -> DataFrame:
    """Adds frame, place (of the line in its frame) and n to the lines of files whose frames have the same number of atoms n: ``head``
    lines, the atoms, ``tail`` lines. Blank lines behind the last frame are left out."""
    at = head - 1 if tail else 0  # the line with the number of atoms
    n = lines.where(F.col("line") == at).select("file", F.trim("value").try_cast("int").alias("n"))
    end = lines.where("trim(value) <> ''").groupBy("file").agg(F.max("line").alias("end"))
    sizes = n.join(end, "file").withColumn("length", F.col("n") + head + tail)
    # a line behind the atoms may be blank; a frame that ends before is cut short
    left = F.expr("(end + 1) % length")
    if bad := sizes.where((left != 0) & (left < F.col("length") - F.lit(tail))).first():
        raise NetworkError(f"{bad.file}: the last frame is cut short, or frames differ in their number of atoms")
    rows = lines.join(broadcast_if_bounded(sizes, SMALL), "file").where("line <= end")
    rows = rows.withColumns({"frame": F.expr("CAST(line div length AS INT)"), "place": F.expr("CAST(line % length AS INT)")})
    other = rows.where((F.col("place") == at) & ~F.trim("value").try_cast("int").eqNullSafe(F.col("n")))
    if wrong := other.first():
        raise NetworkError(f"{wrong.file}: {wrong.value!r} where the number of atoms should stand")
    return rows


def _gro(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames of a title, the number of atoms, atoms in fixed columns and the box."""
    rows = _periodic(lines, 2, 1)
    v = F.col("value")
    dot = F.instr(v, ".")
    width = F.instr(F.expr("substring(value, instr(value, '.') + 1)"), ".")  # decimals decide the column width
    xyz = [F.substring(v, 21 + k * width, width).try_cast("double").alias(c) for k, c in enumerate("xyz")]
    field = lambda a, b: F.trim(F.substring(v, F.lit(a), F.lit(b)))
    atoms = rows.where((F.col("place") >= 2) & (F.col("place") < F.col("n") + 2) & (dot > 0))
    atoms = atoms.select("file", "frame", (F.col("place") - 2).alias("atom_index"), field(11, 5).alias("atom_name"), field(6, 5).alias("residue_name"), field(1, 5).try_cast("int").alias("residue_id"), *xyz)
    side = F.transform(F.split(F.trim(v), r"\s+"), lambda x: x.try_cast("double"))
    tilted = F.exists(F.slice(side, 4, 6), lambda x: F.coalesce(x != 0, F.lit(False)))
    angle = F.when(tilted, 0.0).otherwise(90.0)
    boxes = rows.where((F.col("place") == F.col("n") + 2) & (F.size(side) >= 3))
    return atoms, boxes.select("file", "frame", *(F.get(side, k).alias(c) for k, c in enumerate(BOX[:3])), *(angle.alias(c) for c in BOX[3:]))


def _xyz(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames of the number of atoms, a comment, and a name and three numbers per atom."""
    rows = _periodic(lines, 2, 0)
    word = F.split(F.trim("value"), r"\s+")
    atoms = rows.where("place >= 2").select(
        "file", "frame", (F.col("place") - 2).alias("atom_index"), word[0].alias("atom_name"), F.lit("").alias("residue_name"), F.lit(0).alias("residue_id"), *(F.get(word, k).try_cast("double").alias(c) for k, c in enumerate("xyz", 1))
    )
    return atoms, atoms.where("false").select("file", "frame", *(F.lit(None).cast("double").alias(c) for c in BOX))


def _pdb(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Models that end with ENDMDL; the last CRYST1 before the end of a model is its box. All models have the same number of atoms."""
    tag = F.trim(F.substring("value", 1, 6))
    rows = lines.withColumn("tag", tag).where(F.col("tag").isin("CRYST1", "ATOM", "HETATM", "ENDMDL")).withColumns({"is_end": (F.col("tag") == "ENDMDL").cast("long"), "is_atom": F.col("tag").isin("ATOM", "HETATM").cast("long")})
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("file", "block").agg(F.sum("is_end").alias("ends"), F.sum("is_atom").alias("atoms"))
    splits = splits.select("file", "block", *(F.coalesce(F.sum(c).over(along), F.lit(0)).alias(f"{c}_before") for c in ("ends", "atoms")))
    inside = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)  # a split is bounded
    rows = rows.join(broadcast_if_bounded(splits, SMALL), ["file", "block"])
    rows = rows.withColumns({f"{c}_so_far": F.col(f"{c}_before") + F.coalesce(F.sum(f).over(inside), F.lit(0)) for c, f in (("ends", "is_end"), ("atoms", "is_atom"))})
    rows = rows.withColumn("frame", F.col("ends_so_far").cast("int"))
    models = rows.where("is_atom = 1").groupBy("file", "frame").agg(F.count(F.lit(1)).alias("n"), F.min("atoms_so_far").alias("first"))
    if bad := models.groupBy("file").agg(F.min("n").alias("low"), F.max("n").alias("high")).where("low <> high").first():
        raise NetworkError(f"{bad.file}: models of {bad.low} to {bad.high} atoms")
    cell = lambda a, b: F.trim(F.substring("value", a, b))
    atoms = rows.where("is_atom = 1").join(broadcast_if_bounded(models, SMALL), ["file", "frame"])
    atoms = atoms.select("file", "frame", (F.col("atoms_so_far") - F.col("first")).cast("int").alias("atom_index"), cell(13, 4).alias("atom_name"), cell(18, 4).alias("residue_name"), cell(23, 4).try_cast("int").alias("residue_id"), *(cell(31 + 8 * k, 8).try_cast("double").alias(c) for k, c in enumerate("xyz")))
    given = rows.where("tag = 'CRYST1'").groupBy("file", "frame").agg(F.max_by("value", "line").alias("value"))
    given = given.select("file", "frame", F.struct(*(cell(a, b).try_cast("double").alias(c) for (a, b), c in zip(((7, 9), (16, 9), (25, 9), (34, 7), (41, 7), (48, 7)), BOX, strict=True))).alias("box"))
    latest = F.last("box", ignorenulls=True).over(Window.partitionBy("file").orderBy("frame"))  # one row per model
    boxes = models.select("file", "frame").join(given, ["file", "frame"], "full").withColumn("box", latest)
    return atoms, boxes.where("box IS NOT NULL").select("file", "frame", "box.*")


READERS = {"gro": _gro, "pdb": _pdb, "xyz": _xyz}


def read_structure(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of file, frame, atom_index, atom_name, residue_name, residue_id, x, y, z and the box (null where there is none).

    ``paths`` may be patterns. All files have the format of their ending, one format for all; frames are numbered through all files, in
    the order of their names. An empty file has no frames.
    """
    lines = numbered_lines(spark, paths)
    kinds = [r.k for r in lines.select(F.lower(F.regexp_extract("file", r"\.(\w+?)(?:\.(?:gz|bz2))?$", 1)).alias("k")).distinct().limit(2).collect()]
    if len(kinds) > 1 or (kinds and kinds[0] not in READERS):
        raise NetworkError(f"structure files must be of one format of {', '.join(READERS)}, not {', '.join(kinds)}")
    atoms, boxes = READERS[kinds[0] if kinds else "gro"](lines)
    atoms = written(atoms, "atoms_of_frames")
    if bad := atoms.where("x IS NULL OR y IS NULL OR z IS NULL").first():
        raise NetworkError(f"{bad.file}: frame {bad.frame}, atom {bad.atom_index} has no coordinates that can be read")
    frames = atoms.groupBy("file").agg((F.max("frame") + 1).alias("frames"))
    before = F.coalesce(F.sum("frames").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")  # one row per file
    offset = broadcast_if_bounded(frames.select("file", before.alias("offset")), SMALL)
    rows = atoms.join(broadcast_if_bounded(boxes, SMALL), ["file", "frame"], "left").join(offset, "file")
    return rows.withColumn("frame", F.col("frame") + F.col("offset")).select(*COLUMNS, *BOX)


def positions_and_boxes(structure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables of positions and of boxes of a structure."""
    boxes = structure.where("atom_index = 0 AND lx IS NOT NULL").select("frame", *BOX)
    return structure.select("frame", "atom_index", "x", "y", "z"), boxes


def check_atom_names(structure: DataFrame, atoms: DataFrame) -> None:
    """The first frame must have the atoms of the topology, in number and name."""
    first = structure.where(F.col("frame") == 0).select("atom_index", F.col("atom_name").alias("found"))
    bad = first.join(atoms.select("atom_index", "atom_name"), "atom_index", "full").where("NOT (found <=> atom_name)").orderBy("atom_index").first()
    if bad:
        raise ValueError(f"atom {bad.atom_index}: {bad.found!r} in the structure, {bad.atom_name!r} in the topology")
