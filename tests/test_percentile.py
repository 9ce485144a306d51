import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators.percentile import exact_percentile, numbered


@pytest.mark.parametrize("share", [0.0, 0.0005, 0.25, 0.5, 0.95, 1.0])
def test_exact_for_small_and_large_groups(spark, share):
    rnd = random.Random(1)
    rows = [("hot", rnd.gauss(0, 1)) for _ in range(60_000)] + [("ties", float(rnd.randrange(3))) for _ in range(500)] + [(f"s{i}", rnd.random()) for i in range(20) for _ in range(i + 1)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    got = {r.g: r.q for r in exact_percentile(df, ["g"], "v", share, "q").collect()}
    assert got == pytest.approx({g: float(np.quantile(v, share)) for g, v in groups.items()})
    assert exact_percentile(df.where("g = 'hot'"), [], "v", share, "q").first().q == pytest.approx(float(np.quantile(groups["hot"], share)))
    assert exact_percentile(df.limit(0), [], "v", share, "q").first().q is None and exact_percentile(df.limit(0), ["g"], "v", share, "q").count() == 0


def test_numbers_are_dense_and_in_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(9)
    got = [(r.n, r.k) for r in numbered(df, [F.desc("k")], "n").collect()]
    assert sorted(got) == list(enumerate(sorted((k for _, k in got), reverse=True)))
    assert numbered(df.limit(0), [F.asc("k")], "n").count() == 0
