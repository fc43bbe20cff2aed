import dataclasses

import pytest
from pyspark.sql import functions as F

from surgelight.config import Settings, TokenFilters
from surgelight.functions import keys, text

RULES = TokenFilters(max_length=10, min_character_diversity=0.3, min_character_diversity_lower_limit=8)
SETTINGS = Settings(token_filters=RULES)

# Texts and the tokens that must come of them (those up to the first non-ASCII one are expectations of the described tokeniser).
CASES = {
    "Hello World Test": ["hello", "world", "test"],
    "Short VeryLongTokenThatExceedsMaxLength Short": ["short", "short"],
    "HeLLo WoRld": [],
    "HELLO WORLD": [],
    "Hello #hashtag World": ["hello", "hashtag", "world"],
    "Hello http://example.com World": ["hello", "world"],
    "Hello abc123def World": ["hello", "world"],
    "Helllllo Worrrrld": ["helllllo", "worrrrld"],
    "Don't can't won't": ["don", "can", "won"],
    "RT @user123: Hello WORLD! This is a #hashtag with http://example.com and some VERYLONGTOKEN": ["rt", "hello", "this", "is", "hashtag", "with", "and", "some"],
    "café": ["caf"],
    "don’t": ["dont"],
    "aa bb　cc\u0085dd": ["aa", "bb", "cc", "dd"],
    "awww.x.com": [],
    "": [],
}


def _tokens(spark, settings, texts, words=None):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(text.tokens(F.col("t"), settings, words)).collect()]


def test_tokeniser_table(spark):
    assert _tokens(spark, SETTINGS, list(CASES)) == list(CASES.values())


def test_tokeniser_of_null_and_word_list(spark):
    assert _tokens(spark, SETTINGS, [None]) == [None]
    assert _tokens(spark, SETTINGS, ["Hello wide World"], ["world"]) == [["hello", "wide"]]


def test_links_survive_when_not_removed(spark):
    rules = dataclasses.replace(RULES, enabled=False, remove_urls=False)
    assert _tokens(spark, Settings(token_filters=rules), ["see http://example.com"]) == [["see", "httpexamplecom"]]


@pytest.mark.parametrize(
    "word, reason",
    [
        ("a" * 31, "max_length"),
        ("aaaaaaab", "diversity"),
        ("aaab", None),
        ("aaaab", "repetition"),
        ("aBaBaB", "case"),
        ("ab12", "digits"),
        ("abcd1", None),
        ("httpd", "url"),
        ("wwwabc", "url"),
        ("HELLO", "all_caps"),
        ("HELL", None),
        ("#tag", "hashtag"),
    ],
)
def test_quality_rules(spark, word, reason):
    row = spark.createDataFrame([(word,)], "w string").select(text.rejection(F.col("w"), TokenFilters())).first()
    assert row[0] == reason


def test_rules_off(spark):
    row = spark.createDataFrame([("a" * 99,)], "w string").select(text.rejection(F.col("w"), TokenFilters(enabled=False))).first()
    assert row[0] is None


def test_fields_of_events(spark):
    df = spark.createDataFrame([("@a @b http://x #c été ab1  x Über",)], "t string")
    counts = df.select(*(c.alias(k) for k, c in text.pattern_counts(F.col("t")).items()), text.alphabetic_words(F.col("t")).alias("w"), text.normalised_space(F.col("t")).alias("s")).first()
    assert (counts["at"], counts["http"], counts["hashtag"]) == (2, 1, 1)
    assert counts.w == "été über"
    assert counts.s == "@a @b http://x #c été ab1 x Über"


def test_three_part_key(spark):
    rows = spark.createDataFrame([("hello",), ("world",)], "token string").select("token", *keys.key_parts(F.col("token"), 1000)).collect()
    assert {r.token: (r.p1, r.p2, r.p3) for r in rows} == {"hello": (818, 930, 582), "world": (417, 245, 874)}


def test_settings(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "c.yaml"
    path.write_text("log_dir: logs\nwindow: 100\nfreq_classes: 3\nunknown: 1\nskip_frequency_classes: [1, 2]\ntoken_filters:\n  max_length: 9\n  enabled: false\nfilter:\n  enabled: true\n  filter_file: words.txt\n")
    s = Settings.read(str(path))
    assert (s.window, s.freq_classes, s.skip_frequency_classes, s.token_filters.max_length, s.token_filters.enabled, s.filter_file) == (100, 3, (1, 2), 9, False, "words.txt")
    path.write_text("window: 1\n")
    with pytest.raises(ValueError):
        Settings.read(str(path))
    with pytest.raises(ValueError):
        Settings(freq_classes=0)
