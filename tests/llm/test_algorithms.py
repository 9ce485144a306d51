import math
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import quantiles as Q
from weftgraph.llm.topn import top_n


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from(["normal", "heavy", "ties", "sorted"]), st.integers(1, 60_000))
def test_sketch_keeps_its_bound(seed, kind, n):
    rng = np.random.default_rng(seed)
    x = {"normal": rng.normal(size=n), "heavy": rng.pareto(0.5, n), "ties": rng.integers(0, 9, n).astype(float), "sorted": np.arange(n, dtype=float)}[kind]
    s = Q.RelativeSketch(16)
    for part in np.array_split(x, 5):
        s.merge(Q.RelativeSketch(16).update(part))
    s = Q.RelativeSketch.from_bytes(s.to_bytes())
    assert s.n == n and sum(len(a) * 2**h for h, a in enumerate(s.levels)) == n and len(s.edges) == len(s.state) == len(s.levels)
    x.sort()
    for p in (0.0, 0.25, 0.5, 0.95, 0.99, 0.999, 1.0):
        v, e = s.quantiles([p])[0], s.error_bound(p) * n + 1
        assert np.searchsorted(x, v, "left") - e <= p * (n - 1) <= np.searchsorted(x, v, "right") + e


def test_high_ranks_are_finer_than_the_middle():
    x = np.random.default_rng(0).normal(size=2_000_000)
    s = Q.RelativeSketch(64)
    for part in np.array_split(x, 20):
        s.update(part)
    x.sort()
    off = {p: abs(np.searchsorted(x, s.quantiles([p])[0]) / len(x) - p) for p in (0.5, 0.99, 0.9999)}
    assert off[0.5] < 0.01 and off[0.99] < 0.001 and off[0.9999] < 0.00002
    assert sum(map(len, s.levels)) < 30_000 and s.error_bound(0.9999) < 0.05 * 0.0001


@pytest.mark.parametrize("kind", ["normal", "sorted", "falling", "heavy"])
def test_the_bound_does_not_grow_with_merges(kind):
    """400 sketches of 100,000 values, merged one after the other and in rounds."""
    rng = np.random.default_rng(9)
    make = {"normal": lambda k: rng.normal(size=100_000), "sorted": lambda k: np.arange(100_000.0) + k * 100_000, "falling": lambda k: -np.arange(100_000.0) - k * 100_000, "heavy": lambda k: rng.pareto(0.5, 100_000)}[kind]
    whole, rounds = Q.RelativeSketch(), []
    for k in range(400):
        part = Q.RelativeSketch().update(make(k))
        if k % 20 == 0:
            rounds.append(Q.RelativeSketch())
        rounds[-1].merge(Q.RelativeSketch.from_bytes(part.to_bytes()))
        whole.merge(part)
    tree = Q.RelativeSketch()
    for r in rounds:
        tree.merge(r)
    for s in (whole, tree):
        assert s.n == 40_000_000 and s.error_bound(0.999) <= 0.05 * 0.001 and s.error_bound(0.9999) <= 0.05 * 0.0001 and s.error_bound(0.5) < 0.01
        assert len(s.to_bytes()) < 2_500_000


def test_groups_and_days_combine(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.5 else f"g{rnd.randrange(20)}" if rnd.random() < 0.95 else None, rnd.choice([rnd.gauss(0, 5), rnd.gauss(100, 1)]), rnd.randrange(4), 1) for _ in range(20_000)]
    rows += [("hot", float("nan"), 0, 1), ("hot", None, 0, 1), ("hot", float("inf"), 1, 1), ("void", None, 1, 1)]
    df = spark.createDataFrame(rows, "g string, v double, day int, n int").repartition(6)
    exact = defaultdict(list)
    for g, v, _, _ in rows:
        if v is not None and math.isfinite(v):
            exact[g].append(v)
    days = [Q.merge_sketches(Q.sketch_groups(df.where(f"day = {d}"), ["g"], "v", 16, 1000), ["g"]) for d in range(4)]
    stored = days[0]
    for d in days[1:]:
        stored = stored.unionByName(d)
    from pyspark.sql import functions as F

    merged = Q.sketch_quantiles(Q.merge_sketches(stored.withColumn("chunk", F.lit(0)), ["g"]), ["g"], [0.5, 0.95])
    for got in (merged.collect(), Q.group_quantiles(df, ["g"], "v", [0.5, 0.95], 16).collect()):
        assert {r.g: r.n for r in got} == {g: len(v) for g, v in exact.items()}
        for r in got:
            x = np.sort(exact[r.g])
            for p, v, e in ((0.5, r.p50, r.p50_error), (0.95, r.p95, r.p95_error)):
                assert np.searchsorted(x, v, "left") - e * r.n - 1 <= p * (r.n - 1) <= np.searchsorted(x, v, "right") + e * r.n + 1
                if r.n < 100:
                    assert v == pytest.approx(np.quantile(x, p))
    assert Q.group_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_top_n_against_sorting(spark, partitions):
    rnd = random.Random(partitions)
    rows = [("hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", "c", None]), rnd.choice([None, float("nan"), float("inf"), 1.0, 2.0, 2.0, rnd.random() * 3]), rnd.randrange(40), i, 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s double, t int, id long, _rows int").repartition(5)
    want = defaultdict(list)
    for g, s, t, i, _ in rows:
        if s is not None and math.isfinite(s):
            want[g].append((-s, t, i))
    for n in (1, 4, 700, 5000):
        got = defaultdict(list)
        for r in top_n(df, ["g"], "s", ["t", "id"], n, partitions).collect():
            got[r.g].append((r.position, r.s, r.t, r.id))
        assert got.keys() == want.keys()
        for g, v in want.items():
            assert sorted(got[g]) == [(k, -s, t, i) for k, (s, t, i) in enumerate(sorted(v)[:n], 1)]
    assert top_n(df.limit(0), ["g"], "s", ["id"], 3).count() == 0


def test_equal_rows_and_two_group_columns(spark):
    df = spark.createDataFrame([(1, None, 5.0, 1)] * 6 + [(1, "x", 5.0, 1), (2, None, 1.0, 1)], "a int, b string, s double, id long")
    got = sorted((r.a, r.b or "", r.position) for r in top_n(df, ["a", "b"], "s", ["id"], 3, 4).collect())
    assert got == [(1, "", 1), (1, "", 2), (1, "", 3), (1, "x", 1), (2, "", 1)]
