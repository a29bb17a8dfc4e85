from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from riskmart.operators.asof import as_of_join

DAY = datetime(2026, 1, 1)


@pytest.mark.parametrize("tolerance", [None, 40])
@pytest.mark.parametrize("block", [7, 1000])
def test_equals_a_search_of_all_rows(spark, tolerance, block):
    """One key has most rows; gaps over many blocks, equal moments, nulls, repeated rows, values from long before."""
    rng = random.Random(3)
    at = lambda: rng.choice([None] + [DAY + timedelta(seconds=rng.randrange(600)) for _ in range(20)])
    key = lambda: rng.choice(["hot", "hot", "hot", "b", "c", None])
    left = [(i, key(), at()) for i in range(200)] + [(500, "hot", DAY + timedelta(seconds=999_999))] * 2 + [(501, "late", DAY)]
    moments = {(k, t) for k, t in ((key(), at()) for _ in range(60))}  # one row a moment
    right = [(k, t, n, f"v{n}") for n, (k, t) in enumerate(sorted(moments, key=str))]
    got = as_of_join(spark.createDataFrame(left, "id int, k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, since timestamp_ntz, n int, v string"), ["k"], "t", "since", tolerance, block)
    expected = []
    for i, k, t in left:
        found = [r for r in right if None not in (k, t, r[1]) and r[0] == k and r[1] <= t]
        last = max(found, key=lambda r: r[1], default=None)
        if last and tolerance is not None and (t - last[1]).total_seconds() > tolerance:
            last = None
        expected.append((i, k, t, *(last[1:] if last else (None, None, None))))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))


def test_ties_are_settled_the_same_way_each_time(spark):
    right = spark.createDataFrame([("a", DAY, n) for n in range(9)], "k string, since timestamp_ntz, n int")
    left = spark.createDataFrame([("a", DAY), ("a", DAY + timedelta(days=30))], "k string, t timestamp_ntz")
    found = [{r.n for r in as_of_join(left, right.repartition(p), ["k"], "t", "since").collect()} for p in (1, 4)]
    assert found[0] == found[1] and len(found[0]) == 1
    with pytest.raises(ValueError, match="in both"):
        as_of_join(left.withColumnRenamed("t", "since"), right, ["k"], "since", "since")
    assert as_of_join(left.where("false"), right, ["k"], "t", "since").count() == 0
    assert [r.n for r in as_of_join(left, right.where("false"), ["k"], "t", "since").collect()] == [None, None]
