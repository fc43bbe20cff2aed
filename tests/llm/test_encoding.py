import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from surgelight.llm import encoding as e

VOCABULARY = e.default_vocabulary()
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def other():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=e.PATTERN, mergeable_ranks={p: i for i, p in enumerate(e.read_ranks(VOCABULARY))}, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_against_another_encoder_and_back(text):
    import tiktoken

    code = e.encoder(VOCABULARY)
    ids = code.encode([text])[0].tolist()
    assert code.decode(ids) == text
    own = test_against_another_encoder_and_back.__dict__.setdefault("own", tiktoken.Encoding("own", pat_str=e.PATTERN, mergeable_ranks={p: i for i, p in enumerate(code.pieces)}, special_tokens={}))
    assert ids == own.encode_ordinary(text)


@pytest.mark.parametrize("text", ["<|endoftext|> <unk> <s>", "▁ ▁a", "a" * 5000, " " * 3000 + "\n\n\t", "don't WE'LL 日本語 🏳️‍🌈", "\x00\x01\u0085 "])
def test_difficult_texts(other, text):
    assert e.encoder(VOCABULARY).encode([text])[0].tolist() == other.encode_ordinary(text)


def test_operator(spark, other):
    rows = [(1, "some text", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "word " * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = e.encoded(df).collect()
    assert len(out) == 5
    by = {r.doc_id: r.ids for r in out}
    assert by[2] == [] and by[3] == [] and by[1] == other.encode_ordinary("some text") and by[None] == other.encode_ordinary("word " * 30_000)
    back = {r.doc_id: r.text for r in e.decoded(e.encoded(df)).collect()}
    assert back[1] == "some text" and back[2] == "" and back[None] == "word " * 30_000
    assert e.encoded(df.limit(0)).count() == 0


def test_other_vocabulary(spark, tmp_path):
    import base64

    path = tmp_path / "tiny.tiktoken"
    path.write_text("\n".join(f"{base64.b64encode(p).decode()} {i}" for i, p in enumerate([bytes([b]) for b in range(256)] + [b"ab"])))
    df = spark.createDataFrame([(1, "abb")], "doc_id bigint, text string")
    assert e.encoded(df, vocabulary=str(path)).first().ids == [256, 98]
