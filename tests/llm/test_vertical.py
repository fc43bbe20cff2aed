from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from surgelight.llm import vertical as v


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 65535), max_size=60), st.sets(st.integers(0, 65535), max_size=60))
def test_union(a, b):
    pack = lambda s: v.pack(np.array(sorted(s), np.uint16))
    box, dense = v.union(pack(a), False, pack(b), False)
    assert set(v.unpack(box, dense).tolist()) == a | b


def test_dense_containers():
    rows = np.arange(0, 65536, 3)
    assert len(v.pack(rows)) == v.BITMAP_BYTES and (v.unpack(v.pack(rows), True) == rows).all()
    box, dense = v.union(v.pack(rows[:4000]), False, v.pack(rows[3000:8000]), True)
    assert dense and len(v.unpack(box, dense)) == 8000


def test_counts_against_a_loop(spark):
    lists = [["a", "a", "b"], ["a", None, ""], None, [], ["A", "b"], ["a", "a", "b"]] * 5
    df = spark.createDataFrame([(x, i) for i, x in enumerate(lists)], "tokens array<string>, records int").repartition(3)
    occurrences = Counter(t for x in lists for t in x or [] if t)
    records = Counter(t for x in lists for t in {t for t in x or [] if t})
    assert {r.term: (r.occurrences, r.records) for r in v.term_frequencies(df).collect()} == {t: (occurrences[t], records[t]) for t in occurrences}


def test_marks(spark):
    df = spark.createDataFrame([(["all", "one"] if i == 0 else ["all", "two"] if i < 3 else ["all", f"x{i % 5}"],) for i in range(100)], "tokens array<string>")
    got = {r.term: r.mark for r in v.marked_terms(df, max_share=0.2).collect()}
    assert got["all"] == "common" and got["one"] == "rare" and got["two"] == "rare" and got["x3"] is None
    assert v.marked_terms(df.limit(0)).count() == 0


def test_more_records_than_a_chunk(spark):
    df = spark.range(0, 150_000, 1, 1).select(F.array(F.lit("hot"), (F.col("id") % 1000).cast("string")).alias("tokens"))
    boxes = v.term_bitmaps(df).where("term = 'hot'").collect()
    assert len(boxes) == 3 and all(b.dense for b in boxes)
    got = {r.term: r.records for r in v.term_frequencies(df).where("term IN ('hot', '7')").collect()}
    assert got == {"hot": 150_000, "7": 150}


def test_long_records_and_containers_that_are_merged(spark, monkeypatch):
    """With few tokens held at a time, the containers of a chunk come in parts, which meet by union."""
    lists = [["a", "b"] * 40, ["a"], [], None, ["b", None, "c"], ["a"] * 300] * 3
    batch = pa.record_batch([pa.array(lists, pa.list_(pa.string()))], names=["t"])
    monkeypatch.setattr(v, "HELD", 90)
    parts = list(v._build(iter([batch, batch])))
    rows = sorted(r for b in parts for r in zip(*(c.to_pylist() for c in b.columns)) if r[0])
    assert len(rows) > len({r[0] for r in rows}) and len({r[1] for r in rows}) == 1
    table = pa.table(list(map(pa.array, zip(*rows))), names=["term", "chunk", "records", "dense", "occurrences"])
    got = [r for b in v._merge(iter(table.to_batches(max_chunksize=2))) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert got == [("a", 6 * 341, 18), ("b", 6 * 41, 12), ("c", 6, 6)]
