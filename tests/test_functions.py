import math

import pytest
from pyspark.sql import functions as F

from weftgraph.errors import SelectorError
from weftgraph.functions import values as V
from weftgraph.functions.selectors import atom_condition, selector_label, vertex_condition
from weftgraph.operators import pairs, scale


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_energy_kernels(spark):
    e, d = pairs.lennard_jones(F.lit(0.5), F.lit(0.47), F.lit(3.5))
    assert one(spark, e) == pytest.approx(-2.995292527384454) and one(spark, d) == pytest.approx(-44.01110256018106)
    e, d = pairs.lennard_jones(F.lit(0.47), F.lit(0.47), F.lit(2.0))
    assert one(spark, e) == pytest.approx(0.0, abs=1e-12) and one(spark, d) == pytest.approx(-102.1276595744681)
    e, d = pairs.coulomb(F.lit(0.5), F.lit(-1.0))
    assert one(spark, e) == pytest.approx(-277.870916) and one(spark, d) == pytest.approx(555.741832)
    assert math.isnan(one(spark, pairs.coulomb(F.lit(0.0), F.lit(1.0))[0]))


def test_signed_root(spark):
    got = [one(spark, V.signed_root(F.lit(float(v)), F.lit(8.0))) for v in (-8, -1, 0, 1, 8)]
    assert got == pytest.approx([0, 0.28236235917596897, 0.5, 0.717637640824031, 1])
    assert one(spark, V.signed_root_inverse(F.lit(0.717637640824031), F.lit(8.0))) == pytest.approx(1.0)


def test_names():
    assert V.value_name(" Coulomb ") == "cl" and V.normalization_name("raw") == "none" and V.is_derivative("dcoulomb")
    with pytest.raises(ValueError):
        V.value_name("x")
    assert selector_label("a" * 60) == "a" * 45 + "..."


VERTICES = [(0, "ARG", 4, 0.5), (1, "arg", None, None), (2, "LYS", 3, float("nan")), (3, None, 5, -1.0), (4, "POPC", 76, 0.0)]


def ids(spark, selector):
    df = spark.createDataFrame(VERTICES, "vertex_id long, residue_name string, residue_id int, charge double")
    return [r.vertex_id for r in df.where(vertex_condition(selector, df.columns)).orderBy("vertex_id").collect()]


@pytest.mark.parametrize(
    ("selector", "want"),
    [("resid 5-3", [0, 2, 3]), ("resid != 4", [1, 2, 3, 4]), ("not resid 4", [1, 2, 3, 4]), ("resname in ARG,LYS", [0, 2]), ("resname ARG", [0]), ("charge >= 0", [0, 4]), ("charge != 0", [0, 1, 2, 3]), ("resid in '(3, 5-6)'", [2, 3]), ("resname != ARG and ( id 1 or id 3 )", [1, 3]), ("kind atom", []), ("not kind atom", [0, 1, 2, 3, 4])],
)
def test_vertex_selector(spark, selector, want):
    assert ids(spark, selector) == want


@pytest.mark.parametrize("selector", ["", "resid>=5", "resname in POPC, POPE", "resid < 3-5", "(resid 4", "resname < ARG", "resid and", "resid x"])
def test_bad_vertex_selectors(spark, selector):
    with pytest.raises(SelectorError):
        ids(spark, selector)


def test_atom_selector(spark):
    df = spark.createDataFrame([(0, "ARG", 76, "CA"), (1, "LYS", 3, "cb"), (2, "ARG", 2, None)], "atom_index int, residue_name string, residue_id int, atom_name string")
    pick = lambda s: [r.atom_index for r in df.where(atom_condition(s)).orderBy("atom_index").collect()]
    assert pick("arg:76") == [0] and pick("76") == [0] and pick("resname ARG LYS and resid 1-3 7") == [1, 2] and pick("not name CA") == [1, 2] and pick("ARG:1:10") == [2]
    for bad in ("resid in 1,2", "resid 1 and resname", "foo 1", "(resid 1"):
        with pytest.raises(SelectorError):
            pick(bad)


def test_scale_inference(spark):
    d = spark.createDataFrame([(0.30 + 0.001 * i,) for i in range(100)], "distance double")
    assert scale.infer_scale(d, 1.2)["inferred_input_unit"] == "nm"
    assert scale.infer_scale(d.withColumn("distance", F.col("distance") * 10), 1.2)["inferred_input_unit"] == "angstrom"
    with pytest.raises(Exception):
        scale.infer_scale(d.limit(0), 1.2)
