import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from surgelight.llm import minhash as m


def brute(rows, least=10, threshold=0.6):
    first = {}
    for i, text, seq in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[2] is None, r[2])):
        first.setdefault(i, text)
    sets = {i: set(re.findall(r"[^\W_]+", t.lower())) for i, t in first.items() if t}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def texts(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            base = r.choice(rows)[1].split()
            for _ in range(r.randint(0, 4)):
                base[r.randrange(len(base))] = r.choice(words)
            r.shuffle(base)
            text = " ".join(base)
        else:
            text = " ".join(r.choices(words, k=r.randint(8, 25)) + ["the", "and"])
        rows.append((r.randint(1, n), text, i))
    return rows


def test_pairs_against_brute_force(spark):
    rows = texts(400, 3) + [(None, "null", 1), (900, None, 2), (901, "", 3), (902, "word " * 100_000, 4)]
    df = spark.createDataFrame(rows, "id bigint, text string, seq bigint").repartition(3)
    got = [(r.id_a, r.id_b) for r in m.near_duplicate_pairs(df).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got)) >= 0.99 * len(want) and len(want) > 50


@pytest.mark.parametrize("cells", [False, True])
def test_a_hot_group_of_copies_and_near_copies(spark, monkeypatch, cells):
    """With small blocks, and with the keys of the group cut into cells before they meet."""
    monkeypatch.setattr(m, "BLOCK", 16)
    if cells:
        monkeypatch.setattr(m, "GROUP", 8)
        monkeypatch.setattr(m, "SAMPLE", 1)
    base = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(base) if i < 30 else " ".join([*base[:-1], f"own{i}"]), i) for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, text string, seq bigint")
    got = {(r.id_a, r.id_b) for r in m.near_duplicate_pairs(df).collect()}
    assert got == brute(rows) and len(got) == 90 * 89 // 2


@pytest.mark.parametrize(("base", "own"), [(20, 10), (30, 10), (18, 10)])
def test_a_hot_group_whose_copies_have_many_own_words(spark, base, own):
    """Every word of the base is in most texts; the pairs are just at the threshold on their full sets."""
    common = [f"word{i}" for i in range(base)]
    extra = lambda i, n: [f"own{i}x{k}" for k in range(n)]
    if base == 30:  # two copies with own words each: 30 / 50
        sets = [common + extra(i, own) for i in range(60)]
    elif base == 20:  # the base itself and copies with insertions: 20 / 30
        sets = [common] + [common + extra(i, own) for i in range(1, 60)]
    else:  # some copies that lost most of another's own words: 22 / 28
        sets = [common + extra(i, own) for i in range(200)] + [common + extra(i, 4) for i in range(30)]
    rows = [(i, " ".join(words), i) for i, words in enumerate(sets)]
    got = {(r.id_a, r.id_b) for r in m.near_duplicate_pairs(spark.createDataFrame(rows, "id bigint, text string, seq bigint")).collect()}
    want = brute(rows)
    assert got <= want and len(want) >= 59 and len(got) >= 0.97 * len(want)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 2000)), max_size=60), st.integers(1, 7))
def test_cells_keep_every_pair_of_a_hot_key(pairs, groups):
    pairs = sorted(set(pairs))
    keys, records = np.array([k for k, _ in pairs], np.uint64), np.array([r for _, r in pairs], np.int64)
    hot = m.HotKeys(np.array([3, 1], np.uint64), np.array([groups, 2], np.int64))
    cells, members = hot.cells(keys, records, np.arange(2001) * 7919 - 5)

    def met(ks, rs):
        groups = [[r for q, r in zip(ks, rs) if q == k] for k in set(ks)]
        return {(a, b) for g in groups for a in g for b in g if a < b}

    assert met(cells.tolist(), members.tolist()) >= met(keys.tolist(), records.tolist())
    assert max((cells == c).sum() for c in cells) <= len(pairs) if len(cells) else not pairs
    for k in (2, 4):
        assert sorted(members[cells == k].tolist()) == sorted(r for q, r in pairs if q == k)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.booleans())
def test_the_matrix_finds_what_the_pair_test_finds(seed, crossed):
    r = np.random.default_rng(seed)
    entries = np.zeros(60, m._SENT)
    base = r.integers(0, 1 << 62, 6, dtype=np.uint64)
    for f in ("bits", "more"):
        entries[f] = base[r.integers(0, 6, 60)] ^ (np.uint64(1) << r.integers(0, 60, 60, dtype=np.uint64))
    entries["cls"], entries["n"] = np.arange(60), r.integers(10, 40, 60)
    left, right = (entries[:25], entries[25:]) if crossed else (entries, None)
    got = {tuple(sorted(p)) for a, b in m._matrix_pairs(left, right, 0.6) for p in zip(a.tolist(), b.tolist())}
    other = left if right is None else right
    want = {tuple(sorted((x["cls"], y["cls"]))) for x in left for y in other if x["cls"] != y["cls"] and m._may_match(np.array([x]), np.array([y]), 0.6)[0]}
    assert got == want


def test_groups(spark):
    base = [f"a{i}" for i in range(20)]
    chain = [base, base[3:] + ["x1", "x2", "x3"], base[6:] + ["x1", "x2", "x3", "y1", "y2", "y3"]]
    rows = [(i, " ".join(c), i) for i, c in enumerate(chain)] + [(10, " ".join(chain[0]), 10), (20, " ".join(f"z{i}" for i in range(12)), 20), (21, "short", 21)]
    df = spark.createDataFrame(rows, "id bigint, text string, seq bigint")
    out = {r.id: (r.group, r.links) for r in m.near_duplicate_groups(df).collect()}
    assert set(out) == {0, 1, 2, 10, 20}
    assert len({out[i][0] for i in (0, 1, 2, 10)}) == 1 and out[20][0] != out[0][0]
    assert {i: n for i, (_, n) in out.items()} == {0: 1, 1: 2, 2: 1, 10: 1, 20: 0}


def test_connected(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 99)]
    r.shuffle(edges)
    out = {x.cls: x.group for x in m.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {out[i] for i in range(1, 61)} == {1} and {out[i] for i in (99, 100, 101)} == {99}
    assert m.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_empty_table_and_ties(spark):
    df = spark.createDataFrame([], "id bigint, text string, seq bigint")
    assert m.near_duplicate_pairs(df).count() == 0
    text = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, text, 1), (1, text, 1), (2, text, None), (2, None, None)], "id bigint, text string, seq bigint")
    assert m.near_duplicate_pairs(df).count() in (0, 1)


def test_bands_reach_the_recall():
    for rows in (2, 4, 6):
        assert 1 - (1 - 0.6**rows) ** m.bands_for(0.6, rows, 0.99) >= 0.99


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_filters_lose_no_pair(seed):
    r = random.Random(seed)
    one = {r.getrandbits(64) for _ in range(r.randint(10, 40))}
    two = {x for x in one if r.random() < 0.8} | {r.getrandbits(64) for _ in range(r.randint(0, 8))}
    if len(one & two) < 0.6 * len(one | two):
        return
    entry = np.zeros(2, m._ENTRY)
    for k, s in enumerate((one, two)):
        bits = 0
        for x in s:
            bits |= 1 << (x >> 58)
        entry[k] = (k, bits, len(s))
    assert m._may_match(entry[:1], entry[1:], 0.6).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 5)), min_size=1, max_size=50))
def test_packing(pairs):
    hashes, records = np.array([h for h, _ in pairs], np.uint32), np.array([r for _, r in pairs])
    entries = np.zeros(6, m._ENTRY)
    entries["cls"] = np.arange(6) * 7 - 3
    back, found = m._unpack(m._pack(hashes, records, entries))
    assert sorted(zip(back.tolist(), found["cls"].tolist())) == sorted((h, r * 7 - 3) for h, r in pairs)


@pytest.mark.parametrize("size", [2, 5, 16, 17, 50])
def test_every_pair_of_a_bucket(size, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 16)
    monkeypatch.setattr(m, "MATRIX", 4)
    entries = np.zeros(size, m._ENTRY)
    entries["cls"], entries["n"] = np.arange(size), 10
    got = set()
    for a, b in m._bucket_pairs(np.zeros(size, np.uint32), entries, 0.6):
        if isinstance(a, bytes):
            right = None if b is None else np.frombuffer(b, m._ENTRY)
            for x, y in m._matrix_pairs(np.frombuffer(a, m._ENTRY), right, 0.6):
                got |= {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())}
        else:
            got |= {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    assert len(got) == size * (size - 1) // 2
