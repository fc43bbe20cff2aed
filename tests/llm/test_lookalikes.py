import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from surgelight.llm import lookalikes as la

CASES = {
    "ｕｎｔｉｌ ３": ("until 3", {"width"}),
    "𝚝𝚘𝚖 ℂ": ("tom C", {"width"}),
    "café Å ộ": ("café Å ộ", {"accent"}),
    "fol­l​ow﻿⁠": ("follow", {"hidden"}),
    "a b c　d": ("a b c d", {"space"}),
    "mаrch ѕіgn": ("march sign", {"alphabet"}),
    "ΑΒc": ("ABc", {"alphabet"}),
    "abж": ("abж", {"alphabet"}),
    "е́a": ("éa", {"alphabet", "accent"}),
    "x‍🌈": ("x🌈", {"hidden"}),
}
#: Forms that look the same but are no cases of the kinds above.
SAME = {"300 \u212a": "300 K", "\u212bngstr\u00f6m": "\u00c5ngstr\u00f6m", "e\ufb03cient": "efficient", "\u2163 \u217c": "IV l", "\uff76\uff9e\uff77 \uff8a\uff9f": "ガキ パ", "\u1112\u1161\u11ab\u1100\u1173\u11af": "한글", "\uac00\u11a8": "각", "\uf900": "豈", "\u037e": ";"}
UNCHANGED = ["", "plain ASCII\ttext\r\n", "дождь музыка", "ΑΛΦΑ", "café naïve", "👨‍👩‍👧 🏳️‍🌈 ❤️ 🤷‍♀️", "‘it’s’ – — … ™ 1º", "今日は rain", "x̂x"]
KINDS = {"width": la.WIDTH, "accent": la.ACCENT, "hidden": la.HIDDEN, "space": la.SPACE, "alphabet": la.ALPHABET}


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    want, kinds = CASES[text]
    got, bits = la.transducer()(text)
    assert got == want
    assert bits == sum(KINDS[k] for k in kinds)


@pytest.mark.parametrize("text", SAME)
def test_equal_looks(text):
    got, bits = la.transducer()(text)
    assert (got, bits) == (SAME[text], la.SAME) and la.transducer()(got) == (got, 0)
    assert la.consistent(pa.array([text]))[0].to_pylist() == [got]


def test_joiners_stay_where_letters_need_them():
    text = "می\u200cخواهم a\u200cb क्\u200dष \u200cنه\u200c."
    assert la.transducer()(text)[0] == "میخواهم ab क्ष نه."
    kept, bits = la.transducer(keep_joiners=True)(text)
    assert kept == "می\u200cخواهم ab क्\u200dष نه." and bits == la.HIDDEN
    assert la.transducer(keep_joiners=True)(kept)[0] == kept


def test_states_are_kept_within_bounds(monkeypatch):
    monkeypatch.setattr(la, "STATES", 8)
    t = la.Transducer()
    text = "".join(chr(0xFF21 + i) + "\u0301" for i in range(26))
    want = la.transducer()(text)
    assert t(text) == want and t(text) == want and len(t.states) <= 9


@pytest.mark.parametrize("text", UNCHANGED)
def test_not_cases(text):
    got, bits = la.transducer()(text)
    assert bits == 0 and got == text


def test_mapping_is_free_of_conflicts():
    table = la.mapping()
    assert not any(t in table and table[t][1] != la.ALPHABET for t, _ in table.values())


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcé ｕ́ ​‍🌈👩аеж1-\n"), max_size=20))
def test_the_form_is_stable(text):
    once, _ = la.transducer()(text)
    twice, bits = la.transducer()(once)
    assert twice == once and not bits & ~la.ALPHABET


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab é ｕ́ а🌈"), max_size=8)), max_size=6))
def test_arrays_against_single_texts(texts):
    form, found = la.consistent(pa.array(texts, pa.string()))
    want = [None if t is None else la.transducer()(t) for t in texts]
    assert form.to_pylist() == [None if w is None else w[0] for w in want]
    assert [i for i, _ in found] == [i for i, w in enumerate(want) if w and w[1]]


def test_operator(spark):
    rows = [(1, "ａb", ["ｘ", None, "y"], 7), (2, None, None, 7), (3, "", [], 7), (3, "", [], 7), (None, "plain", ["а1b"], None), (5, "​" + "long " * 50_000, [""], 7)]
    df = spark.createDataFrame(rows, "seq bigint, text string, tokens array<string>, c0 int")
    out = {r.seq: r for r in la.with_consistent_form(df, "text", "tokens").collect()}
    assert (out[1].text, out[1].tokens, out[1].c0) == ("ab", ["x", None, "y"], 7)
    assert out[2].text is None and out[2].tokens is None and out[3].tokens == []
    assert len(out[5].text) == 250_000 and out[None].tokens == ["a1b"]
    found = sorted((str(r.seq), r.field) for r in la.odd_characters(df).collect())
    assert found == [("1", "text"), ("1", "tokens"), ("5", "text"), ("None", "tokens")]
    assert la.odd_characters(df.limit(0)).count() == 0 and la.with_consistent_form(df.limit(0)).count() == 0
