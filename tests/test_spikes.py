import math

import numpy as np
import pandas as pd
import pytest

from weftgraph.operators import spikes
from weftgraph.operators.spikes import Rule, flag_readings, implausible_readings, judge_readings

RULE, SHARE = Rule(zero_is_normal=True), Rule(low=0.0, high=1.0)


def brute(pdf, keys, moment, row_id, field, rule):
    out = set()
    for _, g in pdf.dropna(subset=[*keys, moment]).groupby(keys):
        g = g[[x is not None and not (isinstance(x, float) and x != x and x is None) for x in g[field]]]
        readings = sorted({(m, x if x == x else math.inf, x == x) for m, x in zip(g[moment], g[field]) if x is not None}, key=lambda r: (r[0], r[1]))
        values = [(m, x if ok else math.nan) for m, x, ok in readings]
        bad = lambda x: not math.isfinite(x) or (rule.low is not None and x < rule.low) or (rule.high is not None and x > rule.high)
        used = [x for _, x in values if not bad(x) and not (rule.zero_is_normal and x == 0)]
        med = float(np.median(used)) if used else math.nan
        mad = float(np.median([abs(x - med) for x in used])) if used else math.nan
        flagged, i = set(), 0
        while i < len(values):
            j = i
            while j < len(values) and (values[j][1] == values[i][1] or (values[j][1] != values[j][1] and values[i][1] != values[i][1])):
                j += 1
            for m, x in values[i:j]:
                if rule.zero_is_normal and x == 0:
                    continue
                if bad(x) or j - i >= rule.run or abs(x - med) > rule.factor * 1.4826 * mad:
                    flagged.add((m, str(x)))
            i = j
        for m, x, r in zip(g[moment], g[field], g[row_id]):
            if x is not None and (m, str(float(x))) in flagged:
                out.add((field, int(r)))
    return out


def series(seed, n_series=6, n=80):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n_series):
        x = rng.normal(rng.normal(0, 20), rng.uniform(0.5, 3), n)
        for i in rng.choice(n, 4, replace=False):
            x[i] += rng.choice([-1, 1]) * 500
        at = int(rng.integers(0, n - 8))
        x[at : at + int(rng.integers(4, 7))] = x[at]
        x[rng.choice(n, 3)] = 0.0
        x[int(rng.integers(n))] = math.inf
        for m, v in enumerate(x.tolist()):
            rows.append((k, m, v))
            if rng.random() < 0.05:
                rows.append((k, m, v))
            if rng.random() < 0.03:
                rows.append((k, m, v + 0.1))
    pdf = pd.DataFrame(rows, columns=["s", "m", "x"]).astype({"x": object})
    pdf["id"] = np.arange(len(pdf))
    pdf.loc[rng.choice(len(pdf), 5), "x"] = None
    return pdf


@pytest.mark.parametrize("chunk", [100_000, 40])
def test_against_brute_force_whole_and_in_chunks(spark, chunk):
    pdf = series(3)
    df = spark.createDataFrame(list(pdf.itertuples(index=False, name=None)), "s int, m int, x double, id long")
    got = {(r.field, r.key_id) for r in implausible_readings(df, ["s"], "m", "id", {"x": RULE}, chunk).collect()}
    assert got == brute(pdf, ["s"], "m", "id", "x", RULE)
    assert got


def test_a_hot_series_in_many_chunks(spark):
    """One series holds nine tenths of the readings; runs lie across the cuts."""
    rng = np.random.default_rng(5)
    x = rng.normal(0.3, 0.01, 4000)
    for at in range(0, 4000, 97):
        x[at : at + 5] = x[at]
    x[::371] = 0.9
    x[50] = 1.5
    rows = [("hot", i, float(v), i) for i, v in enumerate(x)] + [("cold", i, 0.2 + 0.001 * (i % 7), 10_000 + i) for i in range(400)]
    df = spark.createDataFrame(rows, "s string, m int, x double, id long")
    got = {(r.field, r.key_id) for r in implausible_readings(df, ["s"], "m", "id", {"x": SHARE}, 300).collect()}
    assert got == brute(pd.DataFrame(rows, columns=["s", "m", "x", "id"]), ["s"], "m", "id", "x", SHARE)


def test_edge_cases(spark):
    schema = "s string, m int, x double, id long, _chunk int, n int"
    rows = [(None, 1, 9.0, 1, 0, 0), ("a", None, 9.0, 2, 0, 0), ("a", 1, None, 3, 0, 0), ("a", 1, 5.0, 4, 0, 0), ("b", 1, float("nan"), 5, 0, 0), ("b", 2, float("-inf"), 6, 0, 0), ("c", 1, 0.0, 7, 0, 0)]
    df = spark.createDataFrame(rows, schema)
    got = {(r.field, r.key_id) for r in implausible_readings(df, ["s"], "m", "id", {"x": RULE}).collect()}
    assert got == {("x", 5), ("x", 6)}
    assert implausible_readings(df.limit(0), ["s"], "m", "id", {"x": RULE}).count() == 0


def test_zero_run_is_normal_and_repeats_count_once():
    x = np.array([1.0, 3.0, 1.5, 2.5, 0, 0, 0, 0, 0, 0, 5.0, 2.0, 2.0, 2.0, 2.0, 2.0])
    m = np.r_[np.arange(15), 14]
    assert not flag_readings(np.zeros(16, int), m, x, RULE).any()
    m[-1] = 15
    assert flag_readings(np.zeros(16, int), m, x, RULE).tolist() == [False] * 11 + [True] * 5


@pytest.mark.parametrize("seed", range(12))
def test_the_model_proposes_all_that_the_rule_confirms(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    x = rng.choice([rng.normal(0, 1, n), np.round(rng.normal(0, 2, n)), rng.standard_cauchy(n), np.full(n, 3.0), rng.choice([1.0, 1.0, 5.0], n)])
    for _ in range(3):
        at = int(rng.integers(n))
        x[at : at + int(rng.integers(1, 9))] = rng.choice([x[at], 13.0, 1e30, -1e-30])
    group = np.sort(rng.integers(0, 3, n))
    _, group = np.unique(group, return_inverse=True)
    states, exact = judge_readings(group, np.arange(n), x, Rule(high=500.0))
    assert (states[exact, spikes.NORMAL] < 0.5).all() and np.allclose(states.sum(1), 1)


def test_the_model_sees_more_than_the_rule():
    """A spike of nine deviations and a run of three are no cases of the rule, but not normal either."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 300)
    x[40] = 9.0
    x[100:103] = 0.7
    states, exact = judge_readings(np.zeros(300, int), np.arange(300), x, Rule())
    flagged = np.flatnonzero(states[:, spikes.NORMAL] < 0.5)
    assert not exact.any() and {40, 100, 101, 102} <= set(flagged) and len(flagged) < 10
    assert spikes.STATES[states[40].argmax()] == "spike" and spikes.STATES[states[101].argmax()] == "stuck"
    # transitions follow the series: where spikes are common, a doubtful reading is taken for one sooner
    x[5::7] += 40
    x[42] = 5.2
    rounds, p = spikes.FIT_ROUNDS, []
    for spikes.FIT_ROUNDS in (0, rounds):
        p.append(judge_readings(np.zeros(300, int), np.arange(300), x, Rule())[0][42, spikes.NORMAL])
    assert p[1] < p[0] / 1.5


def test_states_and_probabilities_come_along(spark):
    x = [float(v) for v in np.random.default_rng(1).normal(5, 1, 60)]
    x[10], x[20:26], x[40] = 500.0, [5.5] * 6, math.inf
    df = spark.createDataFrame([("a", k, v, k) for k, v in enumerate(x)], "s string, m int, x double, id long")
    got = {r.key_id: (r.state, r.p_normal) for r in implausible_readings(df, ["s"], "m", "id", {"x": RULE}).collect()}
    assert {k: s for k, (s, _) in got.items()} == {10: "spike", 40: "out_of_range"} | dict.fromkeys(range(20, 26), "stuck")
    assert all(p < 0.5 for _, p in got.values())


def test_two_thousand_chunks_of_one_series(spark):
    """Work grows with the readings, not with readings times chunks."""
    import time

    took = []
    for n in (20_000, 80_000):
        df = spark.range(n).selectExpr("'s' AS s", "id AS m", "IF(id % 1000 = 7, 900D, sin(id * 12.9898D) * 3) AS x", "id")
        began = time.perf_counter()
        got = {r.key_id for r in implausible_readings(df, ["s"], "m", "id", {"x": RULE}, 40).collect()}
        took.append(time.perf_counter() - began)
        assert got == set(range(7, n, 1000))
    assert took[1] < 8 * took[0]


def test_a_reading_repeated_very_often(spark):
    rows = [("s", 5, 900.0, k) for k in range(3000)] + [("s", 10 + k, float(k % 7), 5000 + k) for k in range(500)]
    df = spark.createDataFrame(rows, "s string, m int, x double, id long")
    got = sorted(r.key_id for r in implausible_readings(df, ["s"], "m", "id", {"x": RULE}, 100).collect())
    assert got == list(range(3000))
