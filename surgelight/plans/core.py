"""Queries of the engine's own operators on the test tables, and the SQL of the same results."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surgelight.config import Settings
from surgelight.functions import keys, text
from surgelight.functions.text import SPACE
from surgelight.operators import busy, frequency, order
from surgelight.plans import pipeline
from surgelight.plans.general import LOADED, PARSED
from surgelight.sources import files
from surgelight.sources.messages import parse_messages
from surgelight.session import materialised, shared_folder
from surgelight.streaming.engine import BusyStream

#: Settings of the queries: batches and windows of the size of the test tables.
SETTINGS = Settings(batch=500, window=10_000, token_persist_files=10, rebuild_every_files=5)
CODED = dataclasses.replace(SETTINGS, window_mode="as_coded")
SMALL = dataclasses.replace(SETTINGS, batch=100, z_score=3.0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "tweets")


def _words(spark: SparkSession, sf_dir: str) -> list[str]:
    return files.words_of(_table(spark, sf_dir, "filter_words"))


def _spread(df: DataFrame) -> DataFrame:
    """Work spread over all cores where the table is a single small file; Spark splits larger ones by itself."""
    spark = df.sparkSession
    return df.repartition(spark.sparkContext.defaultParallelism) if df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else df


# ------------------------------------------------------------------------------------------------- text


def text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _tweets(spark, sf_dir).select("seq", text.normalised_space(t).alias("even"), *(c.alias(k) for k, c in text.pattern_counts(t).items()), text.alphabetic_words(t).alias("words"))


def rejection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.rejection_totals(_tweets(spark, sf_dir), SETTINGS, "text", _words(spark, sf_dir))


#: Rules under which those fire that cleaned tokens of the shipped settings never meet.
STRICT_RULES = dataclasses.replace(SETTINGS.token_filters, min_character_diversity=0.6, min_character_diversity_lower_limit=5, max_case_alternations=0.9)


def raw_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rule that rejects each raw piece of ASCII characters, as the rules stand alone: tags and links reach them whole."""
    w = F.col("w")
    rows = _tweets(spark, sf_dir).select(F.explode(text.fields(F.col("text"))).alias("w")).where(w.rlike(r"^[\x21-\x7e]+$"))
    return rows.groupBy(F.coalesce(text.rejection(w, STRICT_RULES), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def changed_word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list with words added and taken out."""
    return files.changed_words(word_list(spark, sf_dir), ["Surgelight", " lol ", ""], ["The", "RT", "u"])


def tweet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = text.tokens(F.col("text"), SETTINGS, _words(spark, sf_dir))
    return _tweets(spark, sf_dir).select("seq", F.posexplode(tokens).alias("pos", "token"))


def token_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rule that rejects each occurrence, and how many pass."""
    words = _words(spark, sf_dir)
    rows = _tweets(spark, sf_dir).select(F.explode(text.cleaned(F.col("text"))).alias("w")).where((F.length("w") >= SETTINGS.min_token_len) & ~F.lower("w").isin(words))
    return rows.groupBy(F.coalesce(text.rejection(F.col("w"), SETTINGS.token_filters), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def simple_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.explode(text.simple_tokens(F.col("text"))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.word_list(_table(spark, sf_dir, "filter_words"))


def without_listed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts without the words of the list, by an anti join."""
    counts = frequency.token_counts(_tweets(spark, sf_dir))
    return files.without_words(counts, word_list(spark, sf_dir))


# ------------------------------------------------------------------------------------------------- sources


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tweet as a raw event line (without the keys of null fields), and lines of the other kinds among them."""
    t = _tweets(spark, sf_dir)
    user = F.struct(F.coalesce("user_id_str", F.lit("")).alias("id_str")).alias("user")
    event = F.to_json(F.struct("id_str", "text", user, F.coalesce("retweet_count", F.lit(0)).alias("retweet_count")))
    k = F.col("seq") % 7
    junk = F.when(k == 1, '{"delete":{"status":null}},').when(k == 2, '{"scrub_geo":null}').when(k == 3, "  ").when(k == 4, "[").when(k == 6, '{"id_str": 1, "text"')
    lines = F.array_compact(F.array(F.when(k == 5, F.concat(event, F.lit(","))).otherwise(event), junk))
    return t.select("seq", F.explode(lines).alias("value"))


def event_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.event_counts(files.parse_events(raw_lines(spark, sf_dir)))


def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = files.parse_events(raw_lines(spark, sf_dir)).where("kind = 'event'")
    return events.select("seq", "id_str", "user_id_str", "retweet_count", "retweeted", "text", "at", "http", "hashtag")


def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.strict_counts(_table(spark, sf_dir, "csv_messages"))


def message_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the loadable bodies."""
    tweets = files.tweets(_table(spark, sf_dir, "csv_messages"), SETTINGS, _words(spark, sf_dir))
    return tweets.select("line_no", "unix", "retweeted", "retweet_count", F.array_join("tokens", " ").alias("tokens"))


def loaded_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tolerant parser makes of the bodies."""
    return parse_messages(_table(spark, sf_dir, "csv_messages")).select("line_no", "id_str", "unix", "user_id_str", "text", "retweeted")


def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.in_time_order(_table(spark, sf_dir, "source_files").select("path"))


# ------------------------------------------------------------------------------------------------- keys and counts


def three_part_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = frequency.token_counts(_tweets(spark, sf_dir))
    return counts.select("token", *keys.key_parts(F.col("token"), SETTINGS.bw_array_len))


def key_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token that each key stands for, with a short key so that keys collide."""
    rows = order.with_batch(_tweets(spark, sf_dir).select("seq", "tokens"), SETTINGS)
    words = busy.dictionary(busy.batch_counts(rows), dataclasses.replace(SETTINGS, bw_array_len=10))
    return busy.key_owners(words)


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.token_counts(_tweets(spark, sf_dir))


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.totals(frequency.token_counts(_tweets(spark, sf_dir)))


def saved_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.bulk_counts(_table(spark, sf_dir, "token_counts"))


def moved_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved counts plus the tokens of even batches minus those of odd ones."""
    t = _tweets(spark, sf_dir)
    part = lambda k: frequency.token_rows(t.where(F.col("batch_no") % 2 == k))
    return frequency.updated_counts(saved_counts(spark, sf_dir), part(0), part(1))


def frequency_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.frequency_classes(frequency.token_counts(_tweets(spark, sf_dir)), SETTINGS.freq_classes)


def adaptive_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of the saved counts without rare tokens."""
    return frequency.frequency_classes(saved_counts(spark, sf_dir), 5, min_count=100)


def class_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.class_sizes(frequency_classes(spark, sf_dir), SETTINGS.freq_classes)


def class_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every token of the tweets by the saved counts; unknown ones are in the last."""
    tokens = frequency.token_rows(_tweets(spark, sf_dir)).distinct()
    return frequency.class_of(tokens, frequency.frequency_classes(saved_counts(spark, sf_dir), SETTINGS.freq_classes), SETTINGS.freq_classes)


def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.top_tokens(frequency.token_counts(_tweets(spark, sf_dir)))


def growth_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.growth_curve(_tweets(spark, sf_dir), 1000)


# ------------------------------------------------------------------------------------------------- windows


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.with_batch(_tweets(spark, sf_dir).select("seq"), SETTINGS)


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    filed = order.with_file(_tweets(spark, sf_dir), SETTINGS)
    return filed.groupBy("file_no").agg(F.count(F.lit(1)).alias("tokens"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def recent_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.recent(_tweets(spark, sf_dir).select("seq", "id_str"), SETTINGS)


def _window_counts(spark: SparkSession, sf_dir: str, settings: Settings) -> DataFrame:
    filed = order.with_file(_tweets(spark, sf_dir), settings)
    counts = materialised(filed.groupBy("file_no", "token").agg(F.count(F.lit(1)).alias("n")), "files")
    last = counts.agg(F.max("file_no")).first()[0] or 0
    return order.window_counts(counts, settings, last)


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_counts(spark, sf_dir, SETTINGS)


def coded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_counts(spark, sf_dir, CODED)


def window_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of each rebuild."""
    return frequency.frequency_classes(sliding_counts(spark, sf_dir), SETTINGS.freq_classes, by="rebuild")


# ------------------------------------------------------------------------------------------------- busy words


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order.with_batch(_tweets(spark, sf_dir).select("seq", "tokens"), SETTINGS)
    counts = busy.batch_counts(rows)
    return busy.with_class(counts, frequency_classes(spark, sf_dir), SETTINGS)


def class_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences by batch and class."""
    return _classed(spark, sf_dir).groupBy("batch", "class").agg(F.sum("n").alias("n"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return busy.counters(_classed(spark, sf_dir), SETTINGS)


def counter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = busy.counter_stats(counters(spark, sf_dir), SETTINGS)
    return stats.select("batch", "class", "part", "total", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "min_z", "max_z")))


def hot_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return busy.hot_positions(counters(spark, sf_dir), SETTINGS)


def busy_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline: text to tokens to busy words."""
    return pipeline.busy_of_all(_spread(_tweets(spark, sf_dir)), SETTINGS, _words(spark, sf_dir))


def busy_words_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over documents, in order of their identifier, with five stop words."""
    settings = Settings(batch=100)
    documents = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return pipeline.busy_of_all(_spread(documents), settings, ["lol", "omg", "like", "follow", "u"], "doc_id", "text")


def busy_words_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busy words by the classes of the sliding window; nothing before the first rebuild."""
    return pipeline.busy_of_windows(_spread(_tweets(spark, sf_dir)), SETTINGS, _words(spark, sf_dir))


def stream_busy_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, through Structured Streaming over the files of the table."""
    settings = dataclasses.replace(SETTINGS, state_dir=f"{shared_folder(spark)}/surgelight-stream-{uuid.uuid4().hex}")
    raw = spark.readStream.schema(_tweets(spark, sf_dir).schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/tweets.parquet*")
    stream = BusyStream(spark, settings)
    stream.start(raw.select("seq", text.tokens(F.col("text"), settings, _words(spark, sf_dir)).alias("tokens")), f"{settings.state_dir}/checkpoint").awaitTermination()
    return stream.busy()


def inspected_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of tokens and all that are long and change between cases."""
    return files.inspect_tokens(frequency.token_rows(_tweets(spark, sf_dir)))


def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busy words by the classes of the saved counts; tokens that these do not know belong to the least frequent class."""
    settings = dataclasses.replace(SETTINGS, unknown_tokens="least_frequent")
    counts = materialised(busy.batch_counts(order.with_batch(_tweets(spark, sf_dir).select("seq", "tokens"), settings)), "counts")
    return busy.busy_words(counts, frequency.frequency_classes(saved_counts(spark, sf_dir), settings.freq_classes), settings)


def busy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A printable line for each batch."""
    return busy.summary_lines(busy_words(spark, sf_dir))


def busy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return busy.summary(busy_words(spark, sf_dir))


def busy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the result file, empty and skipped classes included."""
    settings = dataclasses.replace(SETTINGS, skip_frequency_classes=(0,))
    rows = pipeline.busy_of_all(_spread(_tweets(spark, sf_dir)), settings, _words(spark, sf_dir))
    return busy.result_rows(rows, batches(spark, sf_dir).where("batch IS NOT NULL"), settings)


def _messages_with_busy_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = materialised(busy_words(spark, sf_dir), "busy")
    rows = pipeline.tokenised(_tweets(spark, sf_dir), SETTINGS, _words(spark, sf_dir))
    return busy.messages_with(rows, words)


def busy_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages_with_busy_words(spark, sf_dir)


def busy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return busy.clusters(_messages_with_busy_words(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busy words of small batches."""
    return pipeline.busy_of_all(_tweets(spark, sf_dir), SMALL, _words(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        text_fields, tweet_tokens, token_rejections, rejection_totals, raw_rejections, changed_word_list, simple_tokens, word_list, without_listed_words, event_kinds, parsed_events, message_counts, message_tokens, loaded_messages,
        file_order, three_part_keys, key_owners, token_counts, token_totals, saved_counts, moved_counts, frequency_classes, adaptive_classes, class_sizes, class_lookup,
        top_tokens, growth_curve, batches, token_files, recent_tweets, sliding_counts, coded_counts, window_classes, class_tokens, counters, counter_stats, hot_positions,
        busy_words, busy_words_documents, busy_words_windows, stream_busy_words, inspected_tokens, unknown_words, busy_lines, busy_summary, busy_rows, busy_messages, busy_clusters,
    )
}

# ------------------------------------------------------------------------------------------------- SQL

_LINK = text.LINK


def _fields(column: str) -> str:
    return f"list_filter(string_split_regex({column}, '[{SPACE}]+'), lambda w: w <> '')"


def _cleaned(column: str) -> str:
    inner = f"regexp_replace(regexp_replace(regexp_replace({column}, '{_LINK}', '', 'g'), '''[^{SPACE}]*', '', 'g'), '[^a-zA-Z0-9{SPACE}]', '', 'g')"
    return _fields(inner)


_REASON = """CASE WHEN length(w) > 30 THEN 'max_length'
  WHEN length(w) >= 8 AND len(list_distinct(string_split(w, ''))) / length(w) < 3e-1 THEN 'diversity'
  WHEN len(list_filter(range(2, length(w) + 1), lambda i: w[i] = w[i - 1])) / length(w) > 5e-1 THEN 'repetition'
  WHEN len(list_filter(range(2, length(w) + 1), lambda i: (regexp_matches(w[i], '[A-Z]') AND regexp_matches(w[i - 1], '[a-z]')) OR (regexp_matches(w[i], '[a-z]') AND regexp_matches(w[i - 1], '[A-Z]')))) / length(w) > 4e-1 THEN 'case'
  WHEN length(regexp_replace(w, '[^0-9]', '', 'g')) / length(w) > 3e-1 THEN 'digits'
  WHEN starts_with(w, 'http') OR starts_with(w, 'www') THEN 'url'
  WHEN length(w) >= 5 AND regexp_full_match(w, '[A-Z]+') THEN 'all_caps' END"""
_LIST = r"SELECT DISTINCT lower(trim(line, E' \t\r\n')) AS word FROM filter_words WHERE trim(line, E' \t\r\n') <> '' AND NOT starts_with(trim(line, E' \t\r\n'), '#')"


def _tokens(source: str = "tweets", seq: str = "seq", column: str = "text", words: str = "SELECT word FROM list") -> str:
    """CTEs: ``list`` (words left out) and ``tok`` (seq, k, token), k the place among all cleaned pieces."""
    return f"""list AS MATERIALIZED ({_LIST}),
pieces AS MATERIALIZED (SELECT {seq} AS seq, {_cleaned(column)} AS ws FROM {source}),
piece AS (SELECT seq, generate_subscripts(ws, 1) AS k, unnest(ws) AS w FROM pieces),
good AS (SELECT seq, k, w FROM piece WHERE length(w) >= 2 AND lower(w) NOT IN ({words})),
tok AS MATERIALIZED (SELECT seq, k, lower(w) AS token FROM good WHERE {_REASON} IS NULL)"""


def _classes(counts: str, f: int, by: str = "") -> str:
    """CTE ``cls`` (token, n, class) from the CTE ``counts``."""
    part = f"PARTITION BY {by} " if by else ""
    also = f"{by}, " if by else ""
    return f"""ranked AS (SELECT {also}token, n, row_number() OVER ({part}ORDER BY n DESC, token) AS i,
  coalesce(sum(n) OVER ({part}ORDER BY n DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r, sum(n) OVER ({part.strip()}) // {f} AS c FROM {counts}),
stepped AS (SELECT *, CASE WHEN c = 0 THEN {f - 1} ELSE least({f - 1}, r // c) END AS t FROM ranked),
cls AS MATERIALIZED (SELECT {also}token, n, CAST(i + least(0, min(t - i) OVER ({part}ORDER BY i)) AS INT) AS class FROM stepped)"""


def _key(k: int, length: int = 1000) -> str:
    return f"CAST(CAST('0x' || substr(md5(token || '{keys.SUFFIXES[k - 1]}'), 1, 8) AS BIGINT) % {length} AS INT)"


_TWEET_TOKENS = "tok AS MATERIALIZED (SELECT seq, k, token FROM (SELECT seq, generate_subscripts(tokens, 1) AS k, unnest(tokens) AS token FROM tweets) WHERE token IS NOT NULL AND token <> '')"
_COUNTS = "cnt AS MATERIALIZED (SELECT token, count(*) AS n FROM tok GROUP BY token)"
_SAVED = "saved AS MATERIALIZED (SELECT token, max(n) AS n FROM token_counts WHERE token <> '' AND n > 0 GROUP BY token)"


def _batch(source: str = "tweets", seq: str = "seq", size: int = 500) -> str:
    return f"bat AS MATERIALIZED (SELECT {seq} AS seq, CASE WHEN b < total // {size} THEN b END AS batch FROM (SELECT {seq}, (row_number() OVER (ORDER BY {seq}) - 1) // {size} AS b, count(*) OVER () AS total FROM {source}))"


_HIT = "hit AS MATERIALIZED (SELECT batch, token, count(*) AS n, min(seq) AS first_seq FROM tok JOIN bat USING (seq) GROUP BY batch, token)"


def _busy(classed: str, z: str = "3.5e0", skip: str = "") -> str:
    """CTEs from ``hit`` and classed rows to ``bw`` (batch, class, token)."""
    parts = " UNION ALL ".join(f"SELECT batch, class, {k} AS part, {_key(k)} AS pos, n FROM classed" for k in (1, 2, 3))
    return f"""classed AS MATERIALIZED ({classed}),
cells AS MATERIALIZED (SELECT batch, class, part, pos, CAST(sum(n) AS BIGINT) AS c FROM ({parts}) {skip} GROUP BY ALL),
stats AS (SELECT batch, class, part, sum(c) AS total, sum(c) / 1000 AS mean, sqrt(CAST(sum(c * c) * 1000 - sum(c) * sum(c) AS DOUBLE)) / 1000 AS sd,
  CASE WHEN count(*) < 1000 THEN 0 ELSE min(c) END AS lo, max(c) AS hi FROM cells GROUP BY ALL),
hot AS MATERIALIZED (SELECT batch, class, part, pos, c FROM cells JOIN stats USING (batch, class, part) WHERE sd > 0 AND (c - mean) / sd >= {z}),
words AS MATERIALIZED (SELECT token, {_key(1)} AS p1, {_key(2)} AS p2, {_key(3)} AS p3, min(coalesce(batch, 1000000000000000000)) AS first_batch, min(first_seq) AS first_seq FROM hit GROUP BY token),
bw AS MATERIALIZED (SELECT batch, class, token FROM (SELECT a.batch, a.class, w.token, row_number() OVER (PARTITION BY a.batch, a.class, w.p1, w.p2, w.p3 ORDER BY w.first_seq DESC, w.token DESC) AS r
  FROM words w JOIN hot a ON a.part = 1 AND a.pos = w.p1 AND w.first_batch <= a.batch JOIN hot b ON b.part = 2 AND b.pos = w.p2 AND b.batch = a.batch AND b.class = a.class
  JOIN hot c ON c.part = 3 AND c.pos = w.p3 AND c.batch = a.batch AND c.class = a.class) WHERE r = 1)"""


_BY_ALL = "SELECT batch, class, token, h.n FROM hit h JOIN cls USING (token) WHERE batch IS NOT NULL"
_TWEET_BUSY = f"{_tokens()}, {_batch()}, {_HIT}, cnt AS (SELECT token, CAST(sum(n) AS BIGINT) AS n FROM hit GROUP BY token), {_classes('cnt', 7)}"
_COUNTER_BUSY = f"{_TWEET_TOKENS}, {_batch()}, {_HIT}, {_COUNTS}, {_classes('cnt', 7)}, {_busy(_BY_ALL)}"
_FILES = f"""{_TWEET_TOKENS}, filed AS MATERIALIZED (SELECT seq, token, (row_number() OVER (ORDER BY seq, k) - 1) // 1000 AS file_no FROM tok),
fc AS MATERIALIZED (SELECT file_no, token, count(*) AS n FROM filed GROUP BY ALL)"""
_AT = "marks AS (SELECT unnest(range(10, (SELECT max(file_no) FROM fc) + 1, 5)) AS rebuild)"
_SLIDING = f"{_FILES}, {_AT}, used AS MATERIALIZED (SELECT rebuild, token, CAST(sum(n) AS BIGINT) AS n FROM marks JOIN fc ON file_no >= rebuild - 10 AND file_no < rebuild GROUP BY ALL)"
_LINE_KINDS = """SELECT CASE WHEN text IS NULL OR id_str IS NULL THEN 'incomplete' ELSE 'event' END AS kind FROM tweets
UNION ALL SELECT CASE seq % 7 WHEN 1 THEN 'delete' WHEN 2 THEN 'scrub_geo' WHEN 3 THEN 'blank' WHEN 4 THEN 'bracket' ELSE 'broken' END FROM tweets WHERE seq % 7 NOT IN (0, 5)"""
_OCCURS = "(length({0}) - length(replace({0}, '{1}', ''))) // {2}"

ORACLES = {
    "text_fields": f"SELECT seq, array_to_string({_fields('text')}, ' ') AS even, {_OCCURS.format('text', '@', 1)} AS at, {_OCCURS.format('text', 'http', 4)} AS http, {_OCCURS.format('text', '#', 1)} AS hashtag, array_to_string(list_transform(list_filter({_fields('text')}, lambda w: regexp_full_match(w, '\\p{{L}}{{2,}}')), lambda w: lower(w)), ' ') AS words FROM tweets",
    "tweet_tokens": f"WITH {_tokens()} SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY k) - 1 AS INT) AS pos, token FROM tok",
    "token_rejections": f"WITH {_tokens()} SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM good GROUP BY 1",
    "simple_tokens": "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+')) AS token FROM documents) WHERE length(token) >= 2 AND NOT starts_with(token, 'http') GROUP BY token",
    "word_list": _LIST,
    "without_listed_words": f"WITH list AS ({_LIST}), {_TWEET_TOKENS}, {_COUNTS} SELECT token, n FROM cnt WHERE lower(token) NOT IN (SELECT word FROM list)",
    "event_kinds": f"SELECT kind, count(*) AS n FROM ({_LINE_KINDS}) GROUP BY 1",
    "parsed_events": f"SELECT seq, id_str, coalesce(user_id_str, '') AS user_id_str, CAST(coalesce(retweet_count, 0) AS VARCHAR) AS retweet_count, 'False' AS retweeted, text, CAST({_OCCURS.format('text', '@', 1)} AS VARCHAR) AS at, CAST({_OCCURS.format('text', 'http', 4)} AS VARCHAR) AS http, CAST({_OCCURS.format('text', '#', 1)} AS VARCHAR) AS hashtag FROM tweets WHERE text IS NOT NULL AND id_str IS NOT NULL",
    "message_counts": f"WITH {PARSED} SELECT count(*) AS rows, count_if(coalesce(good, false) AND NOT header) AS good, count_if(NOT (coalesce(good, false) AND NOT header)) AS bad FROM ok",
    "message_tokens": f"WITH {LOADED}, {_tokens('src', 'line_no')}, j AS (SELECT seq, string_agg(token, ' ' ORDER BY k) AS tokens FROM tok GROUP BY seq) SELECT line_no, unix, retweeted, 0 AS retweet_count, coalesce(j.tokens, '') AS tokens FROM src LEFT JOIN j ON j.seq = line_no",
    "loaded_messages": f"WITH {LOADED} SELECT line_no, id_str, unix, user_id_str, text, retweeted FROM src",
    "file_order": "SELECT path, name_ms, row_number() OVER (ORDER BY name_ms NULLS LAST, path) AS place FROM (SELECT path, CASE WHEN regexp_matches(path, '\\d{13}_\\d{13}') THEN CAST(regexp_extract(path, '(\\d{13})_\\d{13}', 1) AS BIGINT) ELSE epoch_ms(try_strptime(regexp_extract(path, '(\\d{8}_\\d{6})', 1), '%Y%m%d_%H%M%S')) END AS name_ms FROM source_files)",
    "three_part_keys": f"WITH {_TWEET_TOKENS}, {_COUNTS} SELECT token, {_key(1)} AS p1, {_key(2)} AS p2, {_key(3)} AS p3 FROM cnt",
    "key_owners": f"WITH {_TWEET_TOKENS}, f AS (SELECT token, min(seq) AS first_seq FROM tok GROUP BY token), x AS (SELECT token, first_seq, {_key(1, 10)} AS p1, {_key(2, 10)} AS p2, {_key(3, 10)} AS p3 FROM f) SELECT p1, p2, p3, token FROM (SELECT *, row_number() OVER (PARTITION BY p1, p2, p3 ORDER BY first_seq DESC, token DESC) AS r FROM x) WHERE r = 1",
    "token_counts": f"WITH {_TWEET_TOKENS}, {_COUNTS} SELECT * FROM cnt",
    "token_totals": f"WITH {_TWEET_TOKENS} SELECT count(*) AS total_tokens, count(DISTINCT token) AS distinct_tokens FROM tok",
    "saved_counts": f"WITH {_SAVED} SELECT * FROM saved",
    "moved_counts": f"WITH {_SAVED}, {_TWEET_TOKENS}, d AS (SELECT token, CASE WHEN batch_no % 2 = 0 THEN 1 ELSE -1 END AS n FROM tok JOIN tweets USING (seq) UNION ALL SELECT token, n FROM saved) SELECT token, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY token HAVING sum(n) > 0",
    "frequency_classes": f"WITH {_TWEET_TOKENS}, {_COUNTS}, {_classes('cnt', 7)} SELECT * FROM cls",
    "adaptive_classes": f"WITH {_SAVED}, few AS (SELECT * FROM saved WHERE n >= 100), {_classes('few', 5)} SELECT * FROM cls",
    "class_sizes": f"WITH {_TWEET_TOKENS}, {_COUNTS}, {_classes('cnt', 7)} SELECT g.class, coalesce(tokens, 0) AS tokens, coalesce(use, 0) AS use FROM (SELECT CAST(unnest(range(7)) AS INT) AS class) g LEFT JOIN (SELECT class, count(*) AS tokens, CAST(sum(n) AS BIGINT) AS use FROM cls GROUP BY class) USING (class)",
    "class_lookup": f"WITH {_TWEET_TOKENS}, {_SAVED}, {_classes('saved', 7)} SELECT token, coalesce(class, 6) AS class FROM (SELECT DISTINCT token FROM tok) LEFT JOIN cls USING (token)",
    "top_tokens": f"WITH {_TWEET_TOKENS}, {_COUNTS} SELECT * FROM cnt ORDER BY n DESC, token LIMIT 10",
    "growth_curve": f"WITH {_TWEET_TOKENS}, o AS (SELECT seq, row_number() OVER (ORDER BY seq) AS i, count(*) OVER () AS total FROM tweets), f AS (SELECT token, min(i) AS i FROM tok JOIN o USING (seq) GROUP BY token), p AS (SELECT DISTINCT least(CAST(ceil(i / 1000) AS BIGINT) * 1000, total) AS messages FROM o) SELECT messages, (SELECT count(*) FROM f WHERE f.i <= p.messages) AS distinct_tokens FROM p",
    "batches": f"WITH {_batch()} SELECT * FROM bat",
    "token_files": f"WITH {_FILES} SELECT file_no, count(*) AS tokens, min(seq) AS first_seq, max(seq) AS last_seq FROM filed GROUP BY file_no",
    "recent_tweets": "SELECT seq, id_str FROM tweets ORDER BY seq DESC LIMIT 1500",
    "sliding_counts": f"WITH {_SLIDING} SELECT * FROM used",
    "window_classes": f"WITH {_SLIDING}, {_classes('used', 7, 'rebuild')} SELECT * FROM cls",
    "coded_counts": f"""WITH {_FILES}, {_AT}, spans AS (SELECT rebuild, coalesce(lag(rebuild) OVER (ORDER BY rebuild), 0) AS since FROM marks),
steps AS (SELECT rebuild, unnest(range(since, rebuild)) AS step FROM spans),
moves AS (SELECT rebuild, step, step AS file_no, 1 AS sign FROM steps UNION ALL SELECT rebuild, step, step - 10, -1 FROM steps WHERE step >= 10),
d AS (SELECT rebuild, token, step, sum(n * sign) AS d FROM moves JOIN fc USING (file_no) GROUP BY ALL),
s AS (SELECT *, sum(d) OVER (PARTITION BY rebuild, token ORDER BY step) AS s FROM d)
SELECT rebuild, token, CAST(max_by(s, step) - least(0, min(s)) AS BIGINT) AS n FROM s GROUP BY ALL HAVING max_by(s, step) - least(0, min(s)) > 0""",
    "class_tokens": f"WITH {_COUNTER_BUSY} SELECT batch, class, CAST(sum(n) AS BIGINT) AS n FROM classed GROUP BY ALL",
    "counters": f"WITH {_COUNTER_BUSY} SELECT * FROM cells",
    "counter_stats": f"WITH {_COUNTER_BUSY} SELECT batch, class, part, CAST(total AS BIGINT) AS total, round(mean, 6) AS mean, round(sd, 6) AS sd, CASE WHEN sd > 0 THEN round((lo - mean) / sd, 6) END AS min_z, CASE WHEN sd > 0 THEN round((hi - mean) / sd, 6) END AS max_z FROM stats",
    "hot_positions": f"WITH {_COUNTER_BUSY} SELECT * FROM hot",
    "busy_words": f"WITH {_TWEET_BUSY}, {_busy(_BY_ALL)} SELECT * FROM bw",
    "busy_summary": f"WITH {_TWEET_BUSY}, {_busy(_BY_ALL)} SELECT batch, class, count(*) AS words, string_agg(token, ',' ORDER BY token) AS list FROM bw GROUP BY ALL",
    "busy_rows": f"WITH {_TWEET_BUSY}, {_busy(_BY_ALL, skip='WHERE class NOT IN (0)')} SELECT g.batch AS \"Batch\", g.class AS \"Class\", coalesce(list, '') AS \"Tokens\" FROM (SELECT DISTINCT batch, CAST(unnest(range(7)) AS INT) AS class FROM bat WHERE batch IS NOT NULL) g LEFT JOIN (SELECT batch, class, string_agg(token, ',' ORDER BY token) AS list FROM bw GROUP BY ALL) USING (batch, class)",
    "busy_messages": f"WITH {_TWEET_BUSY}, {_busy(_BY_ALL)}, m AS (SELECT DISTINCT seq, batch, token FROM tok JOIN bat USING (seq) SEMI JOIN bw USING (batch, token)) SELECT seq, batch, string_agg(token, ',' ORDER BY token) AS words FROM m GROUP BY ALL HAVING count(*) >= 2",
    "busy_clusters": f"WITH {_TWEET_BUSY}, {_busy(_BY_ALL)}, m AS (SELECT DISTINCT seq, batch, token FROM tok JOIN bat USING (seq) SEMI JOIN bw USING (batch, token)), g AS (SELECT seq, batch, string_agg(token, ',' ORDER BY token) AS words FROM m GROUP BY ALL HAVING count(*) >= 2) SELECT batch, words, count(*) AS messages FROM g GROUP BY ALL",
    "busy_words_documents": f"""WITH {_tokens("(SELECT * FROM documents WHERE text IS NOT NULL)", "doc_id", words="'lol', 'omg', 'like', 'follow', 'u'")}, {_batch("(SELECT * FROM documents WHERE text IS NOT NULL)", "doc_id", 100)}, {_HIT},
cnt AS (SELECT token, CAST(sum(n) AS BIGINT) AS n FROM hit GROUP BY token), {_classes("cnt", 7)}, {_busy(_BY_ALL)} SELECT * FROM bw""",
    "busy_words_windows": f"""WITH {_tokens()}, {_batch()}, {_HIT}, filed AS MATERIALIZED (SELECT seq, token, (row_number() OVER (ORDER BY seq, k) - 1) // 1000 AS file_no FROM tok),
fc AS MATERIALIZED (SELECT file_no, token, count(*) AS n FROM filed GROUP BY ALL), done AS (SELECT count(*) // 1000 AS files FROM tok),
marks AS (SELECT unnest(range(10, (SELECT files FROM done) + 1, 5)) AS rebuild),
used AS MATERIALIZED (SELECT rebuild, token, CAST(sum(n) AS BIGINT) AS n FROM marks JOIN fc ON file_no >= rebuild - 10 AND file_no < rebuild GROUP BY ALL), {_classes("used", 7, "rebuild")},
sized AS (SELECT bat.seq, batch, coalesce(sum(m) OVER (ORDER BY bat.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bat LEFT JOIN (SELECT seq, count(*) AS m FROM tok GROUP BY seq) USING (seq)),
begins AS (SELECT batch, min(before) // 1000 AS first_file FROM sized WHERE batch IS NOT NULL GROUP BY batch),
plan AS (SELECT batch, max(rebuild) AS rebuild FROM begins JOIN marks ON rebuild <= first_file GROUP BY batch),
{_busy("SELECT h.batch, class, token, h.n FROM hit h JOIN plan USING (batch) JOIN cls USING (rebuild, token)")} SELECT * FROM bw""",
}
ORACLES["stream_busy_words"] = ORACLES["busy_words_windows"]
ORACLES["inspected_tokens"] = f"""WITH {_TWEET_TOKENS}, {_COUNTS}, o AS (SELECT token, n, length(token) > 20 AND regexp_matches(token, '[a-z][A-Z]|[A-Z][a-z].*[A-Z]') AS odd FROM cnt)
SELECT * FROM o WHERE odd UNION ALL (SELECT * FROM o WHERE NOT odd ORDER BY token LIMIT 20)"""
_STRICT_REASON = _REASON.replace("length(w) >= 8", "length(w) >= 5").replace("< 3e-1", "< 6e-1").replace("> 4e-1 THEN 'case'", "> 9e-1 THEN 'case'").replace("  WHEN starts_with(w, 'http')", "  WHEN starts_with(w, '#') THEN 'hashtag'\n  WHEN starts_with(w, 'http')")
ORACLES["rejection_totals"] = f"""WITH {_tokens()}, r AS (SELECT {_REASON} AS reason FROM good)
SELECT (SELECT CAST(sum(len({_fields('text')})) AS BIGINT) FROM tweets) AS processed, count(reason) AS rejected, {', '.join(f"count_if(reason IS NOT DISTINCT FROM '{r}') AS {r}" for r in text.REASONS)} FROM r"""
ORACLES["raw_rejections"] = f"SELECT coalesce({_STRICT_REASON}, 'kept') AS reason, count(*) AS n FROM (SELECT unnest({_fields('text')}) AS w FROM tweets) WHERE regexp_full_match(w, '[\\x21-\\x7e]+') GROUP BY 1"
ORACLES["changed_word_list"] = f"SELECT DISTINCT word FROM ({_LIST} UNION ALL SELECT unnest(['surgelight', 'lol'])) WHERE word NOT IN ('the', 'rt', 'u')"
ORACLES["unknown_words"] = f"""WITH {_TWEET_TOKENS}, {_batch()}, {_HIT}, {_SAVED}, {_classes('saved', 7)},
{_busy("SELECT batch, token, coalesce(class, 6) AS class, h.n FROM hit h LEFT JOIN cls USING (token) WHERE batch IS NOT NULL")} SELECT * FROM bw"""
ORACLES["busy_lines"] = f"""WITH {_TWEET_BUSY}, {_busy(_BY_ALL)}, g AS (SELECT batch, class, count(*) AS words, string_agg(token, ',' ORDER BY token) AS list FROM bw GROUP BY ALL)
SELECT batch, 'batch ' || batch || ': ' || CAST(sum(words) AS BIGINT) || ' busy words in ' || count(*) || ' classes; ' || string_agg('class ' || class || ': ' || list, '; ' ORDER BY class) AS line FROM g GROUP BY batch"""
