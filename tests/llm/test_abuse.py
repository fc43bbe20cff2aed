import random

import numpy as np
import pytest

from surgelight.llm import abuse as ab

INSULTS = ["you are a filthy moron", "you utter halfwit , nobody likes you", "go away you useless moron", "all of you halfwit people should vanish", "what a filthy halfwit you are"]
MILD = ["i am such a moron today", "the filthy window needs a wash", "a useless lamp and a nice day", "nobody likes rain", "people vanish on fridays"]


def _texts(n, seed):
    r = random.Random(seed)
    words = [f"term{i}" for i in range(300)]
    texts, abusive = [], []
    for _ in range(n):
        lines = [" ".join(r.choices(words, k=8)) + "." for _ in range(r.randint(1, 5))]
        if r.random() < 0.5:
            lines.insert(r.randrange(len(lines) + 1), r.choice(MILD).capitalize() + ".")
        bad = r.random() < 0.1
        if bad:
            lines.insert(r.randrange(len(lines) + 1), r.choice(INSULTS).capitalize() + "!")
        texts.append("\n".join(lines))
        abusive.append(bad)
    return texts, np.array(abusive)


@pytest.mark.parametrize(
    "text, words",
    [
        ("f u n n y and F.u.n", ["funny", "and", "fun"]),
        ("b00bs mo-ron fuuuunny", ["boobs", "moron", "funny"]),
        ("m***n", ["*", "m*n"]),
        ("@someone http://x.example 12.5", ["@"]),
        ("Straße, café!", ["straße", "café"]),
        ("", []),
    ],
)
def test_plain_words(text, words):
    assert ab.plain_words(text) == words


def test_held_out_accuracy_with_unlabelled_positives():
    texts, abusive = _texts(3000, 1)
    r = np.random.default_rng(0)
    known = r.random(len(texts)) < 0.3
    model = ab.train(texts, abusive & known, ~abusive & known & (r.random(len(texts)) < 0.3), prior=0.02)
    fresh, truth = _texts(1000, 2)
    said = model.scores(fresh) > model.threshold
    assert (said & truth).sum() / truth.sum() > 0.95
    assert (said & truth).sum() / said.sum() > 0.9


def test_judged_harmless_documents_change_nothing_but_the_threshold():
    texts, abusive = _texts(600, 4)
    some = ~abusive & (np.arange(600) % 3 == 0)
    one, two = ab.train(texts, abusive, some, rounds=1), ab.train(texts, abusive, np.zeros(600, bool), rounds=1)
    assert (one.word == two.word).all() and (one.pair == two.pair).all() and one.threshold != two.threshold == 0


def test_a_stored_model_is_the_same(monkeypatch):
    texts, abusive = _texts(300, 5)
    model = ab.train(texts, abusive, ~abusive, rounds=1)
    again = ab.Model.restored(model.saved())
    assert (again.scores(texts) == model.scores(texts)).all() and again.threshold == model.threshold


def test_the_same_sample_is_trained_on_once(spark, monkeypatch):
    texts, abusive = _texts(60, 6)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(abusive)], "doc_id bigint, abusive int")
    one = ab.fitted(df, labels)
    monkeypatch.setattr(ab, "train", lambda *a: 1 / 0)
    assert ab.fitted(df, labels) is one


def test_operators(spark):
    texts, abusive = _texts(600, 3)
    rows = [(i, t, "a" if i % 2 else None, 1.5) for i, t in enumerate(texts)] + [(9000, None, "a", 1.5), (9001, "", "a", 1.5), (9002, "word " * 40_000, "b", 1.5), (None, "x", "b", None), (0, texts[0], None, 1.5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double")
    judged = [(i, "ann", int(b)) for i, b in enumerate(abusive) if i % 2 == 0] + [(2, "other", None), (None, "ann", 1), (4, "other", 1 - int(abusive[4]))]
    labels = spark.createDataFrame(judged, "doc_id bigint, annotator string, abusive int")
    model = ab.fitted(df, labels)
    out = ab.scored(df, model)
    got = out.collect()
    assert len(got) == len(rows) and sorted(out.columns) == ["abusive", "doc_id", "score", "source"]
    by = {r.doc_id: r for r in got}
    assert not by[9000].abusive and not by[9001].abusive and not by[9002].abusive and all(0 <= r.score <= 1 for r in got)
    agree = np.mean([by[i].abusive == bool(b) for i, b in enumerate(abusive)])
    assert agree > 0.97
    rates = {r.source: (r.n, r.n_abusive) for r in ab.rates(out).collect()}
    assert rates["b"] == (2, 0) and sum(n for n, _ in rates.values()) == len(rows)


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "you are a moron", "a")], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, annotator string, abusive int")
    assert [r.abusive for r in ab.scored(df, ab.fitted(df, labels)).collect()] == [False]
    empty = df.limit(0)
    assert ab.scored(empty, ab.fitted(empty, labels)).count() == 0 and ab.rates(ab.scored(empty, ab.fitted(empty, labels))).count() == 0
