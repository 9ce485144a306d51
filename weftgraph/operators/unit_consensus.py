"""Lengths recorded in different units: read every unit text with the grammar, convert by what it states, and let the builds of a
source check each other.

Texts name the unit freely, wrongly or not at all; but apart from the unit the medians of one source lie close together.
So every possible unit of a build votes for the length it would mean, the texts of the build vote again for the unit they
state, and the length with most votes of a source (a histogram over the logarithm) is that of the source. A build is
converted from the unit that its texts state where this gives the length of its source, from the unit that does where the texts
are silent or contradict it, and from its texts alone where the source has no one length.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.units import Unit, parse_unit, unit_in_text
from weftgraph.session import broadcast_if_bounded, written

# The units a median may be in.
UNITS = ("nm", "angstrom", "pm", "bohr")
BIN = 0.05
REACH = 2
#: Lengths of one source lie within this of their centre, as a logarithm; a second length with this share of the votes is a tie.
NEAR, TIE = 0.2, 0.999
#: Sources whose lengths are broadcast at most.
MAX_SOURCES = 1_000_000
PARTS = T.StructType([T.StructField("factor", T.DoubleType()), T.StructField("offset", T.DoubleType()), T.StructField("dims", T.ArrayType(T.IntegerType()))])


def _parts(units: list[Unit | None]) -> pd.DataFrame:
    return pd.DataFrame({"factor": [u and u.factor for u in units], "offset": [u and u.offset for u in units], "dims": [u and list(u.dims) for u in units]})


@F.pandas_udf(PARTS)
def unit_parts(text: pd.Series) -> pd.DataFrame:
    """Factor, offset and exponent vector of a unit expression; nulls if it is none."""
    return _parts([parse_unit(t) if isinstance(t, str) else None for t in text])


@F.pandas_udf(PARTS)
def stated_unit_parts(text: pd.Series) -> pd.DataFrame:
    """The same of the unit of length that a free text states; nulls if it states none."""
    return _parts([unit_in_text(t) if isinstance(t, str) else None for t in text])


def converted(value: Column, parts: Column, canonical: str) -> Column:
    """``value`` of a unit given by its parts in the unit ``canonical``; null if the dimensions differ."""
    to = parse_unit(canonical)
    if to is None:
        raise ValueError(f"no unit: {canonical!r}")
    same = parts["dims"] == F.array(*(F.lit(d) for d in to.dims))
    return F.when(same, (value.cast("double") * parts["factor"] + parts["offset"] - F.lit(to.offset)) / F.lit(to.factor))


def to_unit(df: DataFrame, value: str, unit: str, canonical: str, out: str) -> DataFrame:
    """Adds ``out``: ``value`` of the unit spelled in column ``unit``, converted to the unit ``canonical``.

    Null where the value or unit is null, the unit cannot be read, or its dimension differs from that of ``canonical``.
    """
    return df.withColumn("_p", unit_parts(F.col(unit))).withColumn(out, converted(F.col(value), F.col("_p"), canonical)).drop("_p")


def _builds(inference: DataFrame, candidates: DataFrame, notes: DataFrame, use_texts: bool) -> DataFrame:
    """build_id, source_id, median_input and the length of one unit in nm that its note, its unit field and the remark of its source state."""
    good = lambda c: F.when((F.col(c) > 0) & (F.col(c) < float("inf")), F.col(c))
    one = F.lit(1.0)
    texts = inference.where("build_id IS NOT NULL").select("build_id", "source_id", good("median_distance_input").alias("m"), unit_parts("inferred_input_unit").alias("f"), stated_unit_parts("note").alias("n"))
    by_build = texts.groupBy("build_id").agg(F.max("source_id").alias("source_id"), F.max("m").alias("m1"), F.max(converted(one, F.col("n"), "nm")).alias("note_nm"), F.max(converted(one, F.col("f"), "nm")).alias("field_nm"))
    remarks = notes.select("source_id", converted(one, stated_unit_parts("remark"), "nm").alias("remark_nm")).dropDuplicates(["source_id"])
    given = candidates.where("build_id IS NOT NULL").select("build_id", good("median_input").alias("m")).groupBy("build_id").agg(F.max("m").alias("m2"))
    builds = by_build.join(given, "build_id", "full").join(broadcast_if_bounded(remarks, MAX_SOURCES), "source_id", "left")
    said = [F.col(c) if use_texts else F.lit(None).cast("double").alias(c) for c in ("note_nm", "field_nm", "remark_nm")]
    return builds.select("build_id", "source_id", F.coalesce("m2", "m1").alias("median_input"), *said)


def source_lengths(ballots: DataFrame) -> DataFrame:
    """source_id and centre: the logarithm of the length with most votes, null if another one has as many.

    ``ballots``: source_id, log_nm and the weight w of each vote. A length gathers the votes of the bins around it.
    """
    bins = ballots.groupBy("source_id", F.round(F.col("log_nm") / BIN).cast("int").alias("bin")).agg(F.sum("w").alias("w"), F.sum(F.col("log_nm") * F.col("w")).alias("s"))
    near = bins.select("source_id", "w", "s", F.explode(F.sequence(F.col("bin") - REACH, F.col("bin") + REACH)).alias("bin"))
    peaks = written(near.groupBy("source_id", "bin").agg(F.sum("w").alias("w"), F.sum("s").alias("s")), "peaks")
    best = peaks.groupBy("source_id").agg(F.max_by(F.struct("s", "w", "bin"), F.struct("w", F.negative(F.abs("bin")), "bin")).alias("p"))
    other = peaks.alias("a").join(broadcast_if_bounded(best, MAX_SOURCES).alias("b"), F.expr("a.source_id <=> b.source_id")).where(F.abs(F.col("bin") - F.col("p.bin")) > 2 * REACH)
    second = other.groupBy("a.source_id").agg(F.max("w").alias("second")).select(F.col("source_id").alias("other_id"), "second", F.lit(True).alias("there"))
    both = best.join(second, F.expr("source_id <=> other_id"), "left")
    return both.select("source_id", F.when(F.coalesce("second", F.lit(0)) < TIE * F.col("p.w"), F.col("p.s") / F.col("p.w")).alias("centre"))


def medians_in_nm(inference: DataFrame, candidates: DataFrame, notes: DataFrame, use_texts: bool = True) -> DataFrame:
    """One row per build: build_id, source_id, median_input, unit (of ``UNITS``), scale_to_nm, median_nm and decided_by: ``text`` if its
    texts state the unit and its source agrees, ``source`` if they are silent or contradict it, ``text alone`` if the source has no one
    length.

    The median of a build is that of its candidates, else of its inference records; repeats of a build agree in it or the
    greatest counts. Builds without a positive finite median, and those that neither texts nor source tell, have a null unit and
    median_nm. Builds without a source form a source of their own. Empty inputs give an empty result; other columns are
    ignored. ``use_texts=False`` leaves it all to the sources.
    """
    builds = written(_builds(inference, candidates, notes, use_texts), "builds")  # texts are read once, for the votes and for the builds
    lengths = {u: parse_unit(u).factor / parse_unit("nm").factor for u in UNITS}
    says = lambda c, nm: F.coalesce(F.abs(F.ln(F.col(c) / nm)) < 0.02, F.lit(False))
    votes = lambda nm: sum(F.when(says(c, nm), w).otherwise(0) for c, w in (("note_nm", 2), ("field_nm", 1), ("remark_nm", 1)))
    # a build's own words come before those about its source
    first = F.coalesce("note_nm", "field_nm", "remark_nm")
    fields = lambda u, nm: F.struct(F.lit(u).alias("unit"), F.lit(nm).alias("nm"), (votes(nm) + 1).cast("long").alias("w"), F.coalesce(F.abs(F.ln(first / nm)) < 0.02, F.lit(False)).alias("stated"))
    options = F.array(*(fields(u, nm) for u, nm in lengths.items()))
    ballots = builds.where("median_input IS NOT NULL").select("build_id", "source_id", "median_input", F.inline(options)).withColumn("log_nm", F.ln(F.col("median_input") * F.col("nm")))
    centres = broadcast_if_bounded(written(source_lengths(ballots), "lengths"), MAX_SOURCES).alias("b")
    away = F.abs(F.col("log_nm") - F.col("centre"))
    told = ballots.alias("a").join(centres, F.expr("a.source_id <=> b.source_id")).select("a.*", away.alias("away"))
    option = F.struct("unit", "nm")
    chosen = told.groupBy("build_id").agg(
        F.min_by(option, F.struct("away", "unit")).alias("nearest"), F.max("away").isNotNull().alias("known"), F.max(F.when(F.col("stated"), option)).alias("stated"), F.max(F.when(F.col("stated"), F.col("away") < NEAR)).alias("agrees")
    )
    by = F.when(F.col("known") & F.col("agrees"), "text").when(F.col("known"), "source").when(F.col("stated").isNotNull(), "text alone")
    told = chosen.select("build_id", by.alias("decided_by"), F.when(by == "source", F.col("nearest")).when(by.isNotNull(), F.col("stated")).alias("u"))
    return builds.join(told, "build_id", "left").select("build_id", "source_id", "median_input", F.col("u.unit").alias("unit"), F.col("u.nm").alias("scale_to_nm"), (F.col("median_input") * F.col("u.nm")).alias("median_nm"), "decided_by")
