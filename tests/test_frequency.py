import random

import pytest

from surgelight.operators import frequency


def walk(counts, classes):
    """The definition: down the counts, at most one class further with each token."""
    f = max(1, classes)
    order = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    share, used, now, out = sum(counts.values()) // f, 0, 0, {}
    for token, n in order:
        if now < f - 1 and used >= (now + 1) * share:
            now += 1
        out[token] = now
        used += n
    return out


def classes_of(spark, counts, f, **options):
    df = spark.createDataFrame(list(counts.items()), "token string, n bigint")
    return {r.token: r["class"] for r in frequency.frequency_classes(df, f, **options).collect()}


EIGHT = {"the": 100, "and": 80, "is": 60, "hello": 40, "world": 30, "test": 20, "data": 10, "example": 5}


def test_known_table(spark):
    assert classes_of(spark, EIGHT, 3) == dict(zip(EIGHT, [0, 0, 1, 2, 2, 2, 2, 2]))


def test_twenty_table(spark):
    words = "the and to of a in is it you that he was for on are as with his they at".split()
    n = [1000, 800, 600, 500, 400, 300, 250, 200, 150, 100, 80, 60, 40, 30, 20, 10, 5, 3, 2, 1]
    assert list(classes_of(spark, dict(zip(words, n)), 3).values()).count(2) == 15


@pytest.mark.parametrize("f", [0, -1, 1, 2, 5, 10])
def test_any_number_of_classes(spark, f):
    counts = {chr(97 + i): 100 - 10 * i for i in range(10)}
    assert classes_of(spark, counts, f) == walk(counts, f)


def test_random_counts_with_many_ties(spark):
    r = random.Random(4)
    for _ in range(6):
        counts = {f"t{r.randint(0, 999):03d}{i}": r.choice([1, 1, 1, 2, 2, 3, 9, 50, 400]) for i in range(r.randint(1, 300))}
        f = r.randint(1, 9)
        assert classes_of(spark, counts, f) == walk(counts, f)


def test_least_count_and_groups(spark):
    assert set(classes_of(spark, EIGHT, 3, min_count=40)) == {"the", "and", "is", "hello"}
    rows = [(g, t, n * (g + 1)) for g in (0, 1) for t, n in EIGHT.items()]
    df = spark.createDataFrame(rows, "g bigint, token string, n bigint")
    out = frequency.frequency_classes(df, 3, by="g").collect()
    assert {(r.g, r.token): r["class"] for r in out} == {(g, t): c for g in (0, 1) for t, c in walk(EIGHT, 3).items()}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "token string, n bigint")
    assert frequency.frequency_classes(empty, 3).count() == 0
    assert [r.tokens for r in frequency.class_sizes(frequency.frequency_classes(empty, 3), 3).collect()] == [0, 0, 0]
    assert frequency.totals(empty).first().total_tokens == 0


def test_updates(spark):
    rows = lambda w: spark.createDataFrame([(x,) for x in w], "token string")
    none = spark.createDataFrame([], "token string, n bigint")
    out = frequency.updated_counts(none, rows(["hello", "world", "hello", "test"]), rows(["hello", "world"]))
    assert {r.token: r.n for r in out.collect()} == {"hello": 1, "test": 1}


def test_lookup(spark):
    tokens = spark.createDataFrame([("the",), ("nobody",)], "token string")
    df = spark.createDataFrame(list(EIGHT.items()), "token string, n bigint")
    known = frequency.frequency_classes(df, 3)
    assert {r.token: r["class"] for r in frequency.class_of(tokens, known, 3).collect()} == {"the": 0, "nobody": 2}
    assert {r["class"] for r in frequency.class_of(tokens, known.limit(0), 3).collect()} == {0}


def test_growth_and_top(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", None, ""]), (3, ["c"]), (4, None), (5, ["d"])], "seq bigint, tokens array<string>")
    points = sorted((r.messages, r.distinct_tokens) for r in frequency.growth_curve(df, 2).collect())
    assert points == [(2, 2), (4, 3), (5, 4)]
    counts = frequency.token_counts(df)
    assert [r.token for r in frequency.top_tokens(counts, 2).collect()] == ["a", "b"]
    assert frequency.growth_curve(df.limit(0), 2).count() == 0
