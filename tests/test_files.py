import csv
import datetime as dt
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from surgelight.config import Settings
from surgelight.sinks import files as sinks
from surgelight.sources import files

LINES = [
    "[",
    json.dumps({"id_str": "1", "text": "a @b http://x #c words here", "user": {"id_str": "u"}, "created_at": "Tue Jan 03 15:04:05 +0000 2006", "retweet_count": 3, "retweeted": True}) + ",",
    json.dumps({"delete": None}) + ",",
    json.dumps({"scrub_geo": {"x": 1}}),
    ",",
    "",
    '{"id_str": "2", "te',
    json.dumps({"id_str": "3", "text": "no user"}),
    json.dumps({"id_str": "4", "text": "", "user": {}}),
    "]",
]


@pytest.fixture
def events(spark, tmp_path):
    with gzip.open(tmp_path / "e.json.gz", "wt") as f:
        f.write("\n".join(LINES))
    return files.parse_events(files.read_events(spark, str(tmp_path / "*.json.gz")))


def test_event_kinds(events):
    kinds = {r.kind: r.n for r in files.event_counts(events).collect()}
    assert kinds == {"bracket": 2, "event": 2, "delete": 1, "scrub_geo": 1, "comma": 1, "blank": 1, "broken": 1, "incomplete": 1}


def test_event_fields(events):
    r = events.where("id_str = '1'").first()
    assert (r.user_id_str, r.retweet_count, r.retweeted, r["at"], r.http, r.hashtag, r.words) == ("u", "3", "True", "1", "1", "1", "words here")
    r = events.where("id_str = '4'").first()
    assert (r.user_id_str, r.retweet_count, r.retweeted, r.text) == ("", "0", "False", "")


def test_messages_there_and_back(spark, events, tmp_path):
    more = events.where("kind = 'event'").withColumn("text", F.concat("text", F.lit('\nsecond "line"')))
    sinks.write_messages(more, str(tmp_path / "m"))
    back = files.read_messages(spark, str(tmp_path / "m")).orderBy("id_str").collect()
    assert [r.text for r in back] == ['a @b http://x #c words here\nsecond "line"', '\nsecond "line"']
    lines = files.read_messages(spark, str(tmp_path / "m"), line_mode=True)
    assert lines.count() >= 5
    bodies = spark.createDataFrame([(",".join('"' + str(v).replace('"', '""') + '"' for v in back[0][:10]),)], "body string")
    tweet = files.tweets(bodies, Settings()).first()
    assert (tweet.unix, tweet.retweeted, tweet.retweet_count, tweet.tokens) == (1136300645, True, 0, ["words", "here", "second", "line"])
    assert files.tweets(bodies, Settings(), count_retweets=True).first().retweet_count == 3
    assert files.strict_counts(bodies.union(spark.createDataFrame([("x",)], "body string"))).first().asDict() == {"rows": 2, "good": 1, "bad": 1}
    assert files.lenient_texts(spark, str(tmp_path / "m")).count() == 2


def test_word_list_and_token_files(spark, tmp_path):
    df = spark.createDataFrame([(x,) for x in ["# comment", "test", "WORD", " mixedCase\t", "", "  ", "filtered", "test", None]], "line string")
    assert files.words_of(df) == ["filtered", "mixedcase", "test", "word"]
    assert files.words_of(df.limit(1)) == []
    assert {r.word for r in files.changed_words(files.word_list(df), ["New", " "], ["TEST"]).collect()} == {"filtered", "mixedcase", "word", "new"}
    assert files.first_messages(df.selectExpr("line AS body"), 2).count() == 2
    (tmp_path / "t.txt").write_text("a\n\n b \n" + "aVeryLongTokenWithCaseFlips\n")
    rows = files.inspect_tokens(files.read_token_files(spark, str(tmp_path / "t.txt")), 1).collect()
    assert {(r.token, r.odd) for r in rows} == {("a", False), ("aVeryLongTokenWithCaseFlips", True)}


def test_file_names(spark):
    dated = ["tweets_1201_1200.csv", "tweets_2359.csv", "tweets_0000.csv", "x_9999.csv"]
    df = spark.createDataFrame([(n,) for n in dated], "path string")
    assert [r.ms for r in df.select(files.start_millis(F.col("path")).alias("ms")).collect()] == [28900800000 + 0, 86340000, 0, None]
    names = ["d/feed.csv_1327796182986_1327796482986.csv", "tweets_20231201_120000.csv", "x_1701446400.csv", "none.csv", None]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r.path: r.ms for r in df.select("path", files.start_millis(F.col("path")).alias("ms")).collect()}
    assert list(got.values()) == [1327796182986, 1701432000000, 1701446400000, None, None]
    placed = [r.path for r in files.in_time_order(df.where("path IS NOT NULL")).orderBy("place").collect()]
    assert placed == [names[0], names[1], names[2], names[3]]


def test_busy_file_statistics_and_marker(spark, tmp_path):
    s = Settings(log_dir=str(tmp_path))
    rows = spark.createDataFrame([(1, 0, ""), (0, 1, "a,b")], "Batch int, Class int, Tokens string")
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    path = sinks.write_busy(rows, s, at)
    assert path.endswith("bw_20240102_030405_3.5.csv")
    assert [tuple(r) for r in spark.read.csv(path, header=True, inferSchema=False).orderBy("Batch").collect()] == [("0", "1", "a,b"), ("1", "0", None)]
    for _ in range(2):
        sinks.append_stats(str(tmp_path / "s.csv"), 1, 2, 3, at)
    assert len(list(csv.reader(open(tmp_path / "s.csv")))) == 3
    marker = str(tmp_path / "deep" / "marker")
    assert sinks.read_marker(marker) is None
    sinks.write_marker(marker, "file7.csv")
    assert sinks.read_marker(marker) == "file7.csv"
    assert "class 1: a, b" in sinks.batch_text(0, {0: [], 1: ["b", "a"]})
    assert sinks.growth_text([(10, 5), (20, 10)]).count("\n") == 1 and sinks.growth_text([]) == ""


def test_token_files_and_state(spark, tmp_path):
    s = Settings(window=4, token_persist_files=2)
    df = spark.createDataFrame([(2, 0, "b", 0), (1, 0, "a", 0), (3, 0, "c", 1), (4, 0, "d", 1), (5, 0, "e", 2)], "seq int, pos int, token string, file_no bigint")
    path = str(tmp_path / "files")
    assert sinks.write_token_files(df, path, s) == 2 and sinks.write_token_files(df, path, s) == 4
    assert sorted(n for n in os.listdir(path) if not n.startswith(".")) == [f"token_batch_{i:06d}" for i in range(4)]
    assert [r.token for r in files.read_token_files(spark, f"{path}/token_batch_000002").collect()] == ["a", "b"]
    sinks.keep_last_files(spark, path, s)
    assert sorted(r.token for r in files.read_token_files(spark, f"{path}/*").collect()) == ["a", "b", "c", "d"]
    sinks.write_state(df, str(tmp_path), "counts")
    assert files.read_state(spark, str(tmp_path), "counts").count() == 5
