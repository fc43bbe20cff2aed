"""Running numbers over orders of every kind."""

import random

import pytest
from pyspark.sql import functions as F

from surgelight.config import Settings
from surgelight.operators import busy, order

R = random.Random(7)
ORDERS = {
    "dense": list(range(500)),
    "sparse": [R.randrange(1 << 60) for _ in range(500)],
    "crowded": [R.randrange(300) for _ in range(400)] + [10**15 + R.randrange(50) for _ in range(100)],
    "equal": [5] * 300 + [6] * 50 + [10**12],
    "nulls": [None] * 200 + [R.randrange(10**9) for _ in range(200)],
    "all null": [None] * 50,
    "extreme": [-(1 << 63), (1 << 63) - 1, 0, 5, 5] + [R.randrange(-(1 << 63), 1 << 63) for _ in range(100)],
    "negative": [-(10**17), -3, -3, 0, 10**17],
}


@pytest.mark.parametrize("name", ORDERS)
def test_ordinals(spark, name):
    rows = [(o, i) for i, o in enumerate(ORDERS[name])]
    df = spark.createDataFrame(rows, "seq bigint, v int").repartition(3)
    out = order.with_running_sum(df, "seq", F.lit(1), "n", rows=40).collect()
    assert sorted(r.n for r in out) == list(range(1, len(rows) + 1)) and sorted(r.v for r in out) == list(range(len(rows)))
    placed = [r.seq for r in sorted(out, key=lambda r: r.n)]
    assert placed == sorted(ORDERS[name], key=lambda o: (o is not None, o or 0))


def test_several_sums_at_once(spark):
    df = spark.createDataFrame([(5, 2), (1, 3), (9, None), (None, 7)], "seq bigint, v int")
    out = order.with_running_sums(df, "seq", {"a": F.col("v"), "seq2": F.lit(1)}, rows=2).orderBy("seq2").collect()
    assert [(r.seq, r.a, r.seq2) for r in out] == [(None, 7, 1), (1, 10, 2), (5, 12, 3), (9, 12, 4)]


def test_crowded_orders_make_several_ranges(spark):
    for name in ("crowded", "equal", "nulls"):
        df = spark.createDataFrame([(o, i) for i, o in enumerate(ORDERS[name])], "seq bigint, v int")
        assert max(r["count"] for r in order._ranged(df, "seq", 40)[0].groupBy("_r").count().collect()) <= 120


def test_a_column_of_small_integers(spark):
    df = spark.createDataFrame([(x,) for x in (-(1 << 31), (1 << 31) - 1, 7, 7)], "seq int")
    assert [r.seq for r in order.with_ordinal(df).orderBy("ordinal").collect()] == [-(1 << 31), 7, 7, (1 << 31) - 1]


def test_empty_table(spark):
    assert order.with_ordinal(spark.createDataFrame([], "seq bigint")).count() == 0


def test_both_ways_of_looking_words_up_agree(spark):
    s = Settings(bw_array_len=12)
    words = busy.dictionary(spark.createDataFrame([(b, f"word{i}", 1, i) for i in range(300) for b in (i % 3,)], "batch bigint, token string, n int, first_seq bigint"), s)
    hot = spark.createDataFrame([(b, c, part, pos, 9) for b in range(3) for c in range(2) for part in (1, 2, 3) for pos in range(12) if (b + c + part * pos) % 4], "batch bigint, class int, part int, pos int, c int")
    pairs, first = ({tuple(r) for r in busy.words_at(hot, words, z).collect()} for z in (3.5, 0.5))
    assert pairs == first and pairs
