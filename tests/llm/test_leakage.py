import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from surgelight.llm import leakage as lk


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=25), min_size=1, max_size=6))
def test_index_against_a_scan(documents):
    values = np.concatenate([np.append(np.array(d, np.int64), 0) for d in documents])
    order = lk.suffix_array(values)
    shown = lambda i: [(x, 0) if x else (0, j) for j, x in enumerate(values[i:].tolist(), i)]
    keys = [tuple((-1, j) if x == 0 else (x, 0) for x, j in shown(i)) for i in range(len(values))]
    assert [keys[i] for i in order] == sorted(keys)
    index = lk.FMIndex(values, 5)
    phrases = np.array([[a, b, c] for a in (-1, 2, 3) for b in (2, 3, 4) for c in (2, 3, 4)])
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high):
        p = p[p >= 0]
        want = [i for i in range(len(values)) if values[i : i + len(p)].tolist() == p.tolist()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_wavelet_matrix():
    r = np.random.default_rng(0)
    values = r.integers(0, 37, 1000)
    w = lk.WaveletMatrix(values, 40)
    at = r.integers(0, 1001, 200)
    symbols = r.integers(0, 37, 200)
    assert w.rank(symbols, at).tolist() == [(values[:i] == s).sum() for s, i in zip(symbols, at)]
    at = r.integers(0, 1000, 200)
    found, before = w.access_rank(at)
    assert found.tolist() == values[at].tolist() and before.tolist() == [(values[:i] == values[i]).sum() for i in at]


WORDS = [f"word{i}" for i in range(500)]


def _passage(seed, n=40):
    r = random.Random(seed)
    return r.sample(WORDS, n)


def _setup(spark, documents):
    items = spark.createDataFrame([(i, " ".join(_passage(i)).capitalize() + ".", "x") for i in range(5)] + [(7, None, "x"), (8, "", "x"), (9, "!!!", "x")], "item_id bigint, passage string, i string")
    return spark.createDataFrame(documents, "doc_id bigint, text string, i string"), items


def test_leaks(spark):
    p = _passage
    fuzzy = p(1)[:]
    fuzzy[5], fuzzy[20] = "other", "changed"
    fuzzy.insert(30, "added")
    reflowed = "> " + "\n> ".join(", ".join(w.upper() for w in p(2)[k : k + 7]) for k in range(0, 40, 7))
    broken = " ".join(p(3)).replace(p(3)[10], p(3)[10][:2] + "-\n" + p(3)[10][2:])
    documents = [
        (1, "before " * 30 + " ".join(p(0)) + " after" * 30, "x"),
        (2, " ".join(fuzzy), "x"),
        (3, reflowed, "x"),
        (4, broken, "x"),
        (5, "begin " + " ".join(p(4)[:22]) + " end", "x"),
        (6, "begin " + " ".join(p(4)[:15]) + " end", "x"),
        (7, " ".join(sorted(p(0))), "x"),
        (8, None, "x"),
        (9, "", "x"),
        (10, " ".join(w for pair in zip(p(0), WORDS[:40]) for w in pair), "x"),
        (11, " ".join(p(0)) + " gap" * 100 + " " + " ".join(p(1)), "x"),
        (12, "filler " * 60_000 + " ".join(p(2)), "x"),
        (12, "filler " * 10 + " ".join(p(2)), "x"),
        (None, " ".join(p(3)), "x"),
    ]
    df, items = _setup(spark, documents)
    rows = lk.leaks(df, items).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (11, 0), (11, 1), (12, 2), (None, 3)}
    assert sum(r.doc_id == 12 for r in rows) == 2
    one = next(r for r in rows if r.doc_id == 1)
    assert documents[0][1][one.start : one.end] == " ".join(p(0))
    spans = {r.doc_id: (r["items"], len(r.spans)) for r in lk.leaked_documents(df, items).collect()}
    assert spans[11] == ([0, 1], 2) and spans[1] == ([0], 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=30), st.lists(st.integers(2, 6), min_size=1, max_size=20))
def test_no_alignment_has_more_matches_than_common_words(text, passage):
    best = np.zeros((len(text) + 1, len(passage) + 1), int)
    for i, a in enumerate(text):
        for j, b in enumerate(passage):
            best[i + 1, j + 1] = best[i, j] + 1 if a == b else max(best[i, j + 1], best[i + 1, j])
    text, passage = np.array(text, np.int64), np.array(passage)
    common = lk.common_words(text, lk._masks(passage), len(passage))
    assert common == best[-1, -1] and (not len(text) or lk.align([text], passage)[0][0] <= common)


def test_half_a_passage_with_changed_words(spark):
    """31 words: half of it are 16, of which three or four changed ones leave few whole phrases; 46 words: five of 23."""
    items, documents = [], []
    for n, changed in ((31, (4, 8, 12)), (31, (2, 5, 8, 11)), (46, (3, 7, 11, 15, 19))):
        words = _passage(len(items), n)
        half = [f"other{k}" if k in changed else w for k, w in enumerate(words[: -(-n // 2)])]
        documents.append((len(items), "begin " * 5 + " ".join(half) + " end" * 5))
        items.append((len(items), " ".join(words)))
    found = lk.leaks(spark.createDataFrame(documents, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in range(3)}


def test_spans_against_alignment_of_everything(spark):
    """Every document aligned with every passage, again and again beside what was found, without any index."""
    r = random.Random(4)
    passages = {i: _passage(i, r.randint(13, 60)) for i in range(6)}
    documents = []
    for d in range(60):
        words = r.choices(WORDS, k=r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            p = passages[r.randrange(6)][:]
            p = p[r.randint(0, len(p) // 3) :]
            for _ in range(r.randint(0, len(p) // 10)):
                p[r.randrange(len(p))] = r.choice(WORDS)
            words += p + r.choices(WORDS, k=r.randint(0, 30))
        documents.append((d, " ".join(words)))

    def brute(text, passage):
        numbers = {w: k for k, w in enumerate(WORDS)}
        t, p = (np.array([numbers[w] for w in x]) for x in (text, passage))
        out, todo = [], [(0, len(t))]
        while todo:
            a, b = todo.pop()
            if b > a:
                matches, first, last, begin, end = lk.align([t[a:b]], p)[0]
                if last - first + 1 >= 0.5 * len(p) and matches >= lk.EQUAL * (last - first + 1):
                    out.append((a + begin, a + end))
                    todo += [(a, a + begin), (a + end + 1, b)]
        return out

    want = {(d, i, *span) for d, text in documents for i, p in passages.items() for span in brute(text.split(), p)}
    df = spark.createDataFrame(documents, "doc_id bigint, text string")
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in passages.items()], "item_id bigint, passage string")
    texts = dict(documents)
    place = lambda d, c: texts[d][:c].count(" ")
    got = {(r.doc_id, r.item_id, place(r.doc_id, r.start), place(r.doc_id, r.end)) for r in lk.leaks(df, items).collect()}
    assert got == want and len(want) > 60


def test_hits_in_blocks_and_long_stretches_in_windows(spark, monkeypatch):
    p = _passage(0)
    documents = [(k, "gap " * k + " ".join((p + ["gap"] * 3) * 12)) for k in range(3)]
    df, items = spark.createDataFrame(documents, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(p)) for i in range(4)], "item_id bigint, passage string")
    want = sorted(lk.leaks(df, items).collect())
    assert len(want) == 3 * 4 * 12
    monkeypatch.setattr(lk, "BLOCK_HITS", 50)
    monkeypatch.setattr(lk, "CELLS", 40 * 200)
    assert sorted(lk.leaks(df, items).collect()) == want


def test_copies_close_together(spark):
    p = " ".join(_passage(0))
    text = f"{p} gap gap gap {p} gap {p} end"
    df, items = _setup(spark, [(1, text, "x")])
    rows = lk.leaks(df, items).collect()
    assert sorted(text[r.start : r.end] for r in rows) == [p] * 3
    assert [len(r.spans) for r in lk.leaked_documents(df, items).collect()] == [3]


def test_empty_tables(spark):
    df, items = _setup(spark, [(1, "a b c", "x")])
    assert lk.leaks(df.limit(0), items).count() == 0
    assert lk.leaks(df, items.limit(0)).count() == 0
    assert lk.leaked_documents(df, items).count() == 0


def test_short_passages(spark):
    items = spark.createDataFrame([(1, "two words"), (2, "single")], "item_id bigint, passage string")
    df = spark.createDataFrame([(1, "here are Two, words indeed"), (2, "a single one"), (3, "none")], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in lk.leaks(df, items).collect()} == {(1, 1), (2, 2)}


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lk, "BLOCK_ITEMS", 2)
    df, items = _setup(spark, [(1, " ".join(_passage(0)), "x"), (2, " ".join(_passage(4)), "x")])
    assert {(r.doc_id, r.item_id) for r in lk.leaks(df, items).collect()} == {(1, 0), (2, 4)}


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abZ9é- \n\r\t>*_.ß\u0301"), max_size=30))
def test_words_with_and_without_places(text):
    assert lk.plain_words(text) == [w for w, _, _ in lk.words_of(text)]


def test_merged():
    assert lk.merged([(5, 9), (1, 3), (8, 12), (20, 21)]) == [(1, 3), (5, 12), (20, 21)]
