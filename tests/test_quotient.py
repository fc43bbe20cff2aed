import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from surgelight.operators.quotient import QuotientTable, first_deliveries, mark_repeats, permute, repeated_deliveries, restored, _bounds, _shard_of

SCHEMA = "id_str string, seq bigint, is_repeat string, c0 int, _k int"


def test_permutation_has_no_collision():
    x = np.arange(200_000, dtype=np.uint64) * np.uint64(977)
    assert len(np.unique(permute(x))) == len(x)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=40), max_size=8))
def test_table_against_a_set(batches):
    table, known = QuotientTable(), set()
    for keys in batches:
        want = []
        for k in keys:
            want.append(k not in known)
            known.add(k)
        assert table.insert(np.array(keys, np.int64)).tolist() == want
    assert table.n == len(known)


def test_permutation_can_be_undone():
    x = np.random.default_rng(1).integers(0, 1 << 63, 10_000, dtype=np.uint64)
    assert (restored(permute(x)) == x).all()


def test_only_remainders_are_stored_and_give_the_identifiers_back():
    keys = np.unique(np.random.default_rng(2).integers(0, 10**18, 50_000))
    for shards in (1, 12, 500):
        shard = _shard_of(permute(keys), shards)
        low, high = _bounds(int(shard[0]), shards)
        own = keys[shard == shard[0]]
        table = QuotientTable(low, high)
        for part in np.array_split(own, 7):
            assert table.insert(part).all()
        back = np.concatenate([restored(level.members()) for level in table.levels])
        assert sorted(back.tolist()) == own.tolist() and all(level.remainders.max() < 1 << level.cut for level in table.levels)
        assert not table.insert(own).any()


def test_table_grows():
    table = QuotientTable()
    keys = np.arange(100_000)
    assert table.insert(keys).all() and not table.insert(keys[::-1]).any()


ROWS = [("12", 5), ("x12 ", 3), ("012", 1), (None, 2), (None, 9), ("", 4), ("--", 6), ("9" * 40, 8), ("'" + "9" * 40, 7), ("12", None), ("12", None), ("7", 10)]


def test_repeats(spark):
    df = spark.createDataFrame([(i, s, "old", 1, 2) for i, s in ROWS], SCHEMA).repartition(3)
    out = mark_repeats(df).collect()
    assert len(out) == len(ROWS)
    assert sorted((r.seq for r in out if r.is_repeat), key=str) == sorted([5, 8, None, None], key=str)
    assert set(out[0].asDict()) == {"id_str", "seq", "is_repeat", "c0", "_k"} and all(r.c0 == 1 and r["_k"] == 2 for r in out)
    assert first_deliveries(df).count() == len(ROWS) - 4
    assert sorted((r.seq for r in repeated_deliveries(df).collect()), key=str) == sorted([5, 8, None, None], key=str)


def test_a_hot_identifier_and_equal_orders(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "42").otherwise(F.col("id").cast("string")).alias("id_str"), (F.col("id") % 5).alias("seq"))
    kept = first_deliveries(df.where("id_str <> '42' OR seq >= 0"))
    assert kept.count() == df.select("id_str").distinct().count()
    assert kept.where("id_str = '42'").first().seq == 0


def test_empty_table(spark):
    assert mark_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
