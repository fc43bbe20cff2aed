import math
import random
from collections import Counter, defaultdict

import pytest

from surgelight.config import Settings
from surgelight.operators import busy, order


def numbers(df, name):
    return {r.seq: r[name] for r in df.collect()}


def test_ordinals_over_gaps_nulls_and_negatives(spark):
    seqs = [5, -70_000, 1_000_000, 7, 65_536, 65_535]
    df = spark.createDataFrame([(s, "x") for s in seqs], "seq bigint, o string")
    assert numbers(order.with_ordinal(df), "ordinal") == {s: i for i, s in enumerate(sorted(seqs), 1)}
    with_null = spark.createDataFrame([(None,), (3,)], "seq bigint")
    assert numbers(order.with_ordinal(with_null), "ordinal") == {None: 1, 3: 2}
    assert order.with_ordinal(df.limit(0)).count() == 0


def test_batches_leave_out_the_incomplete_one(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 8)], "seq bigint")
    assert numbers(order.with_batch(df, Settings(batch=3)), "batch") == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: None}


def test_files_and_recent(spark):
    df = spark.createDataFrame([(1, ["a", "b", None]), (2, ["c", ""]), (3, ["d", "e"])], "seq bigint, tokens array<string>")
    s = Settings(window=4, token_persist_files=2, batch=1, window_batches=2)
    assert [(r.token, r.file_no) for r in order.with_file(df, s).orderBy("seq", "pos").collect()] == [("a", 0), ("b", 0), ("c", 1), ("d", 1), ("e", 2)]
    assert {r.seq for r in order.recent(df, s).collect()} == {2, 3}


def test_rebuild_schedule(spark):
    s = Settings(token_persist_files=4, rebuild_every_files=3)
    assert [order.rebuild_count(f, s) for f in (3, 4, 6, 7, 10)] == [0, 1, 1, 2, 3]
    files = spark.createDataFrame([(b, f) for b, f in enumerate([0, 3, 4, 6, 7, 12])], "batch bigint, first_file bigint")
    assert {r.batch: r.rebuild for r in order.rebuild_of_batch(files, s).collect()} == {2: 4, 3: 4, 4: 7, 5: 10}


@pytest.mark.parametrize("mode", ["sliding", "as_coded"])
def test_window_counts_against_a_loop(spark, mode):
    r = random.Random(2)
    files = [Counter(r.choices("abc", [5, 2, 1], k=6)) for _ in range(12)]
    s = Settings(token_persist_files=4, rebuild_every_files=3, window_mode=mode)
    rows = [(i, t, n) for i, c in enumerate(files) for t, n in c.items()]
    got = order.window_counts(spark.createDataFrame(rows, "file_no bigint, token string, n bigint"), s, 12)
    want = {}
    marks, counts = [4, 7, 10], Counter()
    for f in range(12):
        if mode == "as_coded":
            for t in "abc":
                counts[t] = max(0, counts[t] + files[f][t] - (files[f - 4][t] if f >= 4 else 0))
        if f + 1 in marks:
            now = sum(files[f - 3 : f + 1], Counter()) if mode == "sliding" else counts
            want |= {(f + 1, t): n for t, n in now.items() if n > 0}
            counts = Counter()
    assert {(x.rebuild, x.token): x.n for x in got.collect()} == want


@pytest.mark.parametrize("z, skip", [(2.0, ()), (3.0, (0,)), (-0.1, ())])
def test_busy_words_against_the_definition(spark, z, skip):
    r = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    messages = [r.choices(words, [60 - i for i in range(60)], k=5) + (["surge"] * 3 if 20 <= i < 30 else []) for i in range(45)]
    s = Settings(batch=10, freq_classes=3, bw_array_len=15 if z < 0 else 40, z_score=z, skip_frequency_classes=skip)
    classes = {w: i % 3 for i, w in enumerate([*words[:50], "surge"])}
    df = order.with_batch(spark.createDataFrame(list(enumerate(messages)), "seq bigint, tokens array<string>"), s)
    table = spark.createDataFrame(list(classes.items()), "token string, class int")
    got = {(x.batch, x["class"], x.token) for x in busy.busy_words(busy.batch_counts(df), table, s).collect()}
    assert got == model(messages, classes, s)
    assert got


def model(messages, classes, s):
    from hashlib import md5

    key = lambda t: tuple(int.from_bytes(md5((t + x).encode()).digest()[:4], "big") % s.bw_array_len for x in ("__0NE__", "__TW0__", "__THR33__"))
    first, out = {}, set()
    for b in range(len(messages) // s.batch):
        hits = defaultdict(Counter)
        for i in range(b * s.batch, (b + 1) * s.batch):
            for t in messages[i]:
                first.setdefault(t, i)
                if t in classes:
                    for part, pos in enumerate(key(t)):
                        hits[classes[t], part][pos] += 1
        owner = {}
        for t in sorted(first, key=lambda t: (first[t], t)):
            owner[key(t)] = t
        for c in set(range(s.freq_classes)) - set(s.skip_frequency_classes):
            hot = []
            for part in range(3):
                cells = [hits[c, part][i] for i in range(s.bw_array_len)]
                mean = sum(cells) / s.bw_array_len
                sd = math.sqrt(sum((x - mean) ** 2 for x in cells) / s.bw_array_len)
                hot.append([i for i, x in enumerate(cells) if sd and (x - mean) / sd >= s.z_score])
            out |= {(b, c, owner[x, y, z]) for x in hot[0] for y in hot[1] for z in hot[2] if (x, y, z) in owner}
    return out


def test_equal_counters_have_no_busy_word_and_unknown_tokens(spark):
    s = Settings(batch=2, freq_classes=2, bw_array_len=1, z_score=0.0)
    df = order.with_batch(spark.createDataFrame([(1, ["a"]), (2, ["b"])], "seq bigint, tokens array<string>"), s)
    counts = busy.batch_counts(df)
    classes = spark.createDataFrame([("a", 0)], "token string, class int")
    assert busy.busy_words(counts, classes, s).count() == 0
    kept = busy.with_class(counts, classes, Settings(freq_classes=2, unknown_tokens="least_frequent"))
    assert {(r.token, r["class"]) for r in kept.collect()} == {("a", 0), ("b", 1)}
    assert busy.with_class(counts, classes, s).count() == 1


def test_result_rows_and_messages(spark):
    s = Settings(freq_classes=2, batch=2)
    found = spark.createDataFrame([(0, 1, "b"), (0, 1, "a")], "batch bigint, class int, token string")
    batches = spark.createDataFrame([(0,), (1,)], "batch bigint")
    rows = {(r.Batch, r.Class): r.Tokens for r in busy.result_rows(found, batches, s).collect()}
    assert rows == {(0, 0): "", (0, 1): "a,b", (1, 0): "", (1, 1): ""}
    messages = spark.createDataFrame([(1, 0, ["a", "b", "x"]), (2, 0, ["a"]), (3, 0, ["b", "a"])], "seq bigint, batch bigint, tokens array<string>")
    hits = busy.messages_with(messages, found)
    assert {r.seq for r in hits.collect()} == {1, 3}
    assert [(r.words, r.messages) for r in busy.clusters(hits).collect()] == [("a,b", 2)]


def test_plan_has_no_cross_product(spark):
    s = Settings(batch=2)
    words = busy.dictionary(spark.createDataFrame([], "batch bigint, token string, n bigint, first_seq bigint"), s)
    hot = spark.createDataFrame([], "batch bigint, class int, part int, pos int, c bigint")
    plan = busy.words_at(hot, words)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
