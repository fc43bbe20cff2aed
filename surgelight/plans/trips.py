"""Queries that go through files, queues and streams, and the SQL of the same results."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surgelight.functions import text
from surgelight.operators import busy, frequency, order
from surgelight.plans import core
from surgelight.plans.core import SETTINGS
from surgelight.session import temporary_folder
from surgelight.sinks import files as sinks
from surgelight.sources import files
from surgelight.sources.queue import QueueSource
from surgelight.streaming.engine import BusyStream
from surgelight.streaming.statistics import statistics as rows_of_statistics


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------------------------------------- files


def gz_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events out of gzipped files of raw lines."""
    path = temporary_folder(spark, "events")
    core.raw_lines(spark, sf_dir).select("value").write.text(path, compression="gzip", lineSep="\n")
    return files.parse_events(files.read_events(spark, path)).where("kind = 'event'").select("id_str", "user_id_str", "text", "at", "http", "hashtag")


def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as message files and read again."""
    path = temporary_folder(spark, "messages")
    sinks.write_messages(files.parse_events(core.raw_lines(spark, sf_dir)).where("kind = 'event'"), path)
    return files.read_messages(spark, path).select("id_str", "user_id_str", "text", "at", "http", "hashtag")


def lenient_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of files whose header has the column in another case."""
    path = temporary_folder(spark, "lenient")
    tweets = _table(spark, sf_dir, "tweets").where("text IS NOT NULL").select("seq", F.col("text").alias("TeXt"))
    tweets.write.csv(path, header=True, quote='"', escape='"', quoteAll=True, lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.lenient_texts(spark, path)


def first_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the test sender would send: the first 500 bodies that are no headers (a limit by design)."""
    return files.first_messages(_table(spark, sf_dir, "csv_messages").select("line_no", "body"), 500, order_col="line_no")


def replay_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running numbers of the bodies in the order of the times of their files."""
    places = files.in_time_order(_table(spark, sf_dir, "source_files").select("path")).select("path", "place")
    rows = _table(spark, sf_dir, "csv_messages").select("line_no", "path").join(places, "path")
    return order.with_ordinal(rows.select("line_no", (F.col("place").cast("bigint") * (1 << 40) + F.col("line_no")).alias("o")), "o").select("line_no", "ordinal")


def token_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the tokens of all complete token files, written and read again; two writes, the second goes on with the numbers."""
    path, filed = temporary_folder(spark, "token-files"), order.with_file(_table(spark, sf_dir, "tweets"), SETTINGS)
    half = filed.agg(F.max("file_no")).first()[0] // 2
    for part in (filed.where(F.col("file_no") < half), filed.where(F.col("file_no") >= half).withColumn("file_no", F.col("file_no") - half)):
        n = sinks.write_token_files(part, path, SETTINGS)
    rows = files.read_token_files(spark, f"{path}/token_batch_*")
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("files", F.lit(n))


def saved_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes saved as state and read again."""
    folder = temporary_folder(spark, "state")
    sinks.write_state(core.frequency_classes(spark, sf_dir), folder, "classes")
    return files.read_state(spark, folder, "classes")


def busy_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result file, read again."""
    settings = dataclasses.replace(SETTINGS, log_dir=temporary_folder(spark, "logs"))
    path = sinks.write_busy(core.busy_rows(spark, sf_dir), settings, dt.datetime(2024, 1, 1))
    return spark.read.csv(path, header=True, schema="Batch bigint, Class int, Tokens string", quote='"', escape='"').fillna({"Tokens": ""})


# ------------------------------------------------------------------------------------------------- queue and stream


def queue_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies published to a queue, taken from it in limited micro-batches, published to another one and taken again."""
    spark.dataSource.register(QueueSource)
    queue, other, out = (temporary_folder(spark, n) for n in ("queue", "other", "taken"))
    client = {"client": "surgelight.sources.queue:LogClient", "partitions": "4"}
    bodies = _table(spark, sf_dir, "csv_messages").select("line_no", "body")
    bodies.write.format("surgelight_queue").options(path=queue, **client).mode("append").save()

    def run(source: str, sink: dict[str, str], kind: str, name: str) -> None:
        limit = max(1, bodies.count() // 3)
        stream = spark.readStream.format("surgelight_queue").options(path=source, maxMessagesPerTrigger=str(limit), progressPath=f"{out}/progress-{name}", **client).load()
        query = stream.writeStream.format(kind).options(checkpointLocation=f"{out}/checkpoint-{name}", **sink).start()
        query.processAllAvailable()
        query.stop()

    run(queue, {"path": other, **client}, "surgelight_queue", "one")
    run(other, {"path": f"{out}/table"}, "parquet", "two")
    return spark.read.parquet(f"{out}/table").select("body")


def _stream_settings(spark: SparkSession):  # noqa: ANN202
    return dataclasses.replace(SETTINGS, state_dir=temporary_folder(spark, "stream"))


def _tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "tweets").select("seq", text.tokens(F.col("text"), SETTINGS, core._words(spark, sf_dir)).alias("tokens"))


def stream_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busy words of a stream that comes in several micro-batches and is stopped and taken up again between them."""
    settings, source = _stream_settings(spark), temporary_folder(spark, "arrivals")
    rows = _tokenised(spark, sf_dir)
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    pieces = 4
    for k in range(pieces):
        edge = lambda i: low + (high - low + 1) * i // pieces
        rows.where((F.col("seq") >= edge(k)) & (F.col("seq") < edge(k + 1))).coalesce(1).write.mode("append").parquet(source)
        if k % 2:  # two files for each run
            arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
            BusyStream(spark, settings).start(arriving, f"{settings.state_dir}/checkpoint").awaitTermination()
    return BusyStream(spark, settings).busy()


def stream_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of recent messages that a stream holds."""
    stream = BusyStream(spark, _stream_settings(spark))
    stream.process(_tokenised(spark, sf_dir), 0)
    return stream.recent().select("seq")


def warm_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busy words of a stream that starts with saved counts."""
    stream = BusyStream(spark, _stream_settings(spark))
    if not stream.warm_start(core.saved_counts(spark, sf_dir)):
        raise ValueError("the saved counts make up no window")
    stream.process(_tokenised(spark, sf_dir), 0)
    return stream.busy()


def rebuilt_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that a stream has saved with the classes of its last rebuild."""
    stream = BusyStream(spark, _stream_settings(spark))
    stream.process(_tokenised(spark, sf_dir), 0)
    return frequency.frequency_classes(stream.saved_counts(), SETTINGS.freq_classes)


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals and the rate at the end of each half minute of arrivals."""
    return rows_of_statistics(_table(spark, sf_dir, "tweets"), "received_at").withColumn("until", F.unix_seconds("until"))


def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each token and the token that its key is read back as."""
    rows = order.with_batch(_table(spark, sf_dir, "tweets").select("seq", "tokens"), SETTINGS)
    words = busy.dictionary(busy.batch_counts(rows), dataclasses.replace(SETTINGS, bw_array_len=10))
    return words.select("token", "p1", "p2", "p3").join(busy.key_owners(words).withColumnRenamed("token", "owner"), ["p1", "p2", "p3"]).select("token", "owner")


QUERIES = {
    f.__name__: f
    for f in (
        gz_events, csv_files, lenient_texts, first_messages, replay_order, token_file_counts, saved_state, busy_file, queue_bodies, stream_restarted, stream_recent, warm_words,
        rebuilt_classes, statistics, key_lookup,
    )
}

_EVENTS = core.ORACLES["parsed_events"].replace("SELECT seq, ", "SELECT ", 1).replace(" CAST(coalesce(retweet_count, 0) AS VARCHAR) AS retweet_count, 'False' AS retweeted,", "")
_WINDOWS = core.ORACLES["busy_words_windows"]
_MILLIS = core.ORACLES["file_order"]
ORACLES = {
    "gz_events": _EVENTS,
    "csv_files": _EVENTS,
    "lenient_texts": "SELECT text FROM tweets WHERE text IS NOT NULL",
    "first_messages": "SELECT line_no, body FROM csv_messages WHERE NOT starts_with(body, 'id_str') ORDER BY line_no LIMIT 500",
    "replay_order": f"SELECT line_no, row_number() OVER (ORDER BY place, line_no) AS ordinal FROM csv_messages JOIN ({_MILLIS}) USING (path)",
    "token_file_counts": f"WITH {core._FILES}, whole AS (SELECT file_no FROM filed GROUP BY file_no HAVING count(*) = 1000) SELECT token, count(*) AS n, CAST((SELECT count(*) FROM whole) AS INT) AS files FROM filed SEMI JOIN whole USING (file_no) GROUP BY token",
    "saved_state": core.ORACLES["frequency_classes"],
    "busy_file": core.ORACLES["busy_rows"],
    "queue_bodies": "SELECT body FROM csv_messages WHERE body IS NOT NULL",
    "stream_restarted": _WINDOWS,
    "stream_recent": "SELECT seq FROM tweets ORDER BY seq DESC LIMIT 1500",
    "warm_words": _WINDOWS.replace("used AS MATERIALIZED (SELECT", f"{core._SAVED}, used AS MATERIALIZED (SELECT 0 AS rebuild, token, n FROM saved UNION ALL SELECT", 1).replace(
        "JOIN marks ON rebuild <= first_file", "JOIN (SELECT rebuild FROM marks UNION ALL SELECT 0) ON rebuild <= first_file"
    ),
    "rebuilt_classes": _WINDOWS[: _WINDOWS.index("sized AS")] + "nothing AS (SELECT 1) SELECT token, n, class FROM cls WHERE rebuild = (SELECT max(rebuild) FROM cls)",
    "statistics": f"""WITH {core._TWEET_TOKENS}, a AS (SELECT seq, (epoch_us(received_at) // 30000000 + 1) * 30 AS s FROM tweets WHERE received_at IS NOT NULL), m AS (SELECT s, count(*) AS m FROM a GROUP BY s),
k AS (SELECT s, count(*) AS k FROM tok JOIN a USING (seq) GROUP BY s), d AS (SELECT s, count(*) AS d FROM (SELECT token, min(s) AS s FROM tok JOIN a USING (seq) GROUP BY token) GROUP BY s)
SELECT s AS until, CAST(sum(m) OVER w AS BIGINT) AS total_tweets, CAST(sum(coalesce(k, 0)) OVER w AS BIGINT) AS total_tokens, CAST(sum(coalesce(d, 0)) OVER w AS BIGINT) AS distinct_tokens, round(m / 30, 6) AS rate
FROM m LEFT JOIN k USING (s) LEFT JOIN d USING (s) WINDOW w AS (ORDER BY s)""",
    "key_lookup": f"WITH {core._TWEET_TOKENS}, f AS (SELECT token, min(seq) AS first_seq FROM tok GROUP BY token), x AS (SELECT token, first_seq, {core._key(1, 10)} AS p1, {core._key(2, 10)} AS p2, {core._key(3, 10)} AS p3 FROM f) SELECT token, first_value(token) OVER (PARTITION BY p1, p2, p3 ORDER BY first_seq DESC, token DESC) AS owner FROM x",
}
