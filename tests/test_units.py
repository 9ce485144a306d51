import pytest
from pyspark.sql import functions as F

from weftgraph.functions.units import BOHR_M, LENGTH, parse_unit, unit_in_text
from weftgraph.operators.unit_consensus import medians_in_nm, to_unit


@pytest.mark.parametrize(("text", "factor"), [("nm", 1e-9), ("1e-10 m", 1e-10), ("Å", 1e-10), ("ang.", 1e-10), ("ångström", 1e-10), ("nano-m", 1e-9), ("pm.", 1e-12), ("Bohr radii", BOHR_M), ("a.u.", BOHR_M), ("atomic units (length)", BOHR_M)])
def test_lengths(text, factor):
    u = parse_unit(text)
    assert u.dims == LENGTH and u.factor == pytest.approx(factor)


def test_compound_units_and_offsets():
    assert parse_unit("kJ/mol").factor == pytest.approx(1000)
    assert parse_unit("kg*m^2/s^2").dims == parse_unit("J").dims
    assert parse_unit("°C").offset == pytest.approx(273.15)
    assert parse_unit("m/(s*s)").dims == (1, 0, -2, 0, 0, 0, 0)
    assert parse_unit("unknown") is None and parse_unit(" ") is None and parse_unit(None) is None


@pytest.mark.parametrize(("text", "nm"), [("1 unit = 10 angstrom", 1.0), ("ten units make one nm", 0.1), ("exported x1000 against nm", 0.001), ("coords: A (not nm)", 0.1), ("coordinates taken as nm by the importer", None), ("a plain rerun", None), ("unit a0", BOHR_M * 1e9)])
def test_free_text(text, nm):
    u = unit_in_text(text)
    assert (u is None) if nm is None else u.factor * 1e9 == pytest.approx(nm)


def test_conversion_checks_dimensions(spark):
    df = spark.createDataFrame([(20.0, "°C"), (300.0, "K"), (5.0, "nm"), (None, "K"), (1.0, None)], "v double, u string")
    got = [r.k for r in to_unit(df, "v", "u", "K", "k").collect()]
    assert got[0] == pytest.approx(293.15) and got[1] == pytest.approx(300.0) and got[2:] == [None, None, None]


def test_consensus_against_planted_units(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    units = {"nm": 1.0, "angstrom": 0.1, "pm": 0.001, "bohr": BOHR_M * 1e9}
    rows, truth = [], {}
    for b in range(600):
        source, length = ("hot", 0.3) if b % 3 else ("s2", 0.14)
        unit = rng.choice(["nm", "angstrom"] if source == "hot" else ["bohr", "pm"], p=[0.7, 0.3])
        said = unit if rng.random() < 0.6 else rng.choice(["nm", "angstrom", "unknown"])
        rows.append((b, source, length * rng.uniform(0.92, 1.08) / units[unit], str(said), None))
        truth[b] = unit
    inference = spark.createDataFrame(rows + rows[:20] + [(None, "hot", 0.3, "nm", None), (9999, None, None, None, None)], "build_id long, source_id string, median_distance_input double, inferred_input_unit string, note string")
    candidates = spark.createDataFrame([(b, m, "x") for b, _, m, _, _ in rows[:300]] + [(b, None, "x") for b, *_ in rows[:300]], "build_id long, median_input double, unit string")
    notes = spark.createDataFrame([("hot", None), ("s2", "Bohr by habit")], "source_id string, remark string")
    got = {r.build_id: r.unit for r in medians_in_nm(inference, candidates, notes).collect()}
    assert got.pop(9999) is None
    assert got == truth
    assert medians_in_nm(inference.limit(0), candidates.limit(0), notes.limit(0)).count() == 0


def test_units_of_the_test_tables(spark, sf):
    from weftgraph.plans.core_problems import p2_medians

    m = p2_medians(spark, sf).groupBy("source_id").agg((F.max("median_nm") / F.min("median_nm")).alias("r"), F.count_if(F.col("unit").isNull()).alias("n"))
    assert all(r.r < 1.23 and r.n == 0 for r in m.collect())


def test_texts_decide_what_a_source_cannot(spark):
    """All medians of a source in one unit may mean several lengths; only its texts tell which."""
    rows = [(b, "one", 3.0 + 0.01 * b, "ang." if b % 2 else None, "lengths in angstroms" if b == 4 else None) for b in range(10)]
    rows += [(100 + b, "two", m, u, None) for b, (m, u) in enumerate([(0.3, "nm"), (3.0, "angstrom"), (3.1, "nm"), (0.31, None), (299.0, None)])]
    inference = spark.createDataFrame(rows, "build_id long, source_id string, median_distance_input double, inferred_input_unit string, note string")
    candidates = spark.createDataFrame([], "build_id long, median_input double")
    notes = spark.createDataFrame([("one", None)], "source_id string, remark string")
    got = {r.build_id: (r.unit, r.decided_by) for r in medians_in_nm(inference, candidates, notes).collect()}
    assert {got[b] for b in range(1, 10, 2)} == {("angstrom", "text")} and got[4] == ("angstrom", "text") and got[0] == ("angstrom", "source")
    assert [got[100 + b] for b in range(5)] == [("nm", "text"), ("angstrom", "text"), ("angstrom", "source"), ("nm", "source"), ("pm", "source")]
    silent = {r.build_id: (r.unit, r.decided_by) for r in medians_in_nm(inference, candidates, notes, use_texts=False).collect()}
    assert {silent[b] for b in range(10)} == {(None, None)} and {silent[100 + b][1] for b in range(5)} == {"source"}
    alone = spark.createDataFrame([(1, "s", 3.0, "angstrom", None), (2, "s", 0.9, "nm", None)], inference.schema)
    assert {r.build_id: (r.unit, r.decided_by) for r in medians_in_nm(alone, candidates, notes).collect()} == {1: ("angstrom", "text alone"), 2: ("nm", "text alone")}
