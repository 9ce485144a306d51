"""What the queries give on the test tables, where SQL cannot say it."""

from weftgraph.llm import queries as L


def test_days_and_whole_agree(spark, sf):
    days = {r.build_id: r for r in L.p3_by_day(spark, sf).collect()}
    whole = L.p3_quantiles(spark, sf).where("field = 'coulomb'").groupBy("build_id").sum("n").collect()
    assert {b: r.n for b, r in days.items()} == {r.build_id: r["sum(n)"] for r in whole}
    assert all(r.p5 <= r.p50 <= r.p95 <= r.p99 for r in days.values())


def test_containers_are_full_and_whole(spark, sf):
    import math

    c = L.p7_containers(spark, sf).toPandas()
    assert c.bytes.max() <= 8192 and len(c) <= math.ceil(c.bytes.sum() / 8192) * 1.02 + 1


def test_leak_shares_stand_apart(spark, sf):
    shares = [r.share for r in L.p8_shares(spark, sf).collect()]
    assert shares and min(shares) >= 1 / 3 and max(shares) <= 1


def test_sentences_are_distinct_and_clean(spark, sf):
    s = L.p9_found(spark, sf).toPandas()
    assert len(s) and not s.duplicated().any()
    assert (s.sentence == s.sentence.str.strip()).all() and not s.sentence.str.contains("\n").any() and not s.sentence.str.startswith(">").any()
