"""Readers: raw events, message files, word lists, token files, saved state, and what file names tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surgelight.config import Settings
from surgelight.functions.text import alphabetic_words, pattern_counts, tokens
from surgelight.sources.messages import parse_messages
from surgelight.sources.strict import FIELDS, load_strict

MESSAGE = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])

# ------------------------------------------------------------------------------------------------- raw events


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Lines (``value``) of gzipped or plain files with one JSON object a line; undecodable bytes are replaced."""
    return spark.read.text(path)


def parse_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Each line with ``kind``: event, blank, bracket, comma, broken, delete, scrub_geo or incomplete; events have the ten message fields.

    Spaces around a line and commas after it do not count. A key counts as present even if its value is null.
    """
    even = F.rtrim(F.regexp_replace(F.trim(F.regexp_replace(value, r"^\s+|\s+$", "")), ",+$", ""))
    line = lines.withColumn("_l", even).withColumn("_t", F.trim(value))
    parsed = line.withColumn("_m", F.when(F.col("_l").startswith("{"), F.from_json("_l", T.MapType(T.StringType(), T.StringType()))))
    has = lambda k: F.map_contains_key("_m", F.lit(k))
    kind = (
        F.when(F.coalesce(F.col("_t"), F.lit("")) == "", "blank")
        .when(F.col("_t").isin("[", "]"), "bracket")
        .when(F.col("_t") == ",", "comma")
        .when(F.col("_m").isNull(), "broken")
        .when(has("delete"), "delete")
        .when(has("scrub_geo"), "scrub_geo")
        .when(~(has("id_str") & has("text") & has("user")), "incomplete")
        .otherwise("event")
    )
    get = lambda k, default: F.coalesce(F.col("_m")[k], F.lit(default))
    text = get("text", "")
    shown = {
        "id_str": get("id_str", ""),
        "created_at": get("created_at", ""),
        "user_id_str": F.coalesce(F.get_json_object(F.col("_m")["user"], "$.id_str"), F.lit("")),
        "retweet_count": get("retweet_count", "0"),
        "text": text,
        "retweeted": F.when(F.lower(get("retweeted", "false")) == "true", "True").otherwise("False"),
        **{k: c.cast("string") for k, c in pattern_counts(text).items()},
        "words": alphabetic_words(text),
    }
    typed = parsed.withColumn("kind", kind)
    keep = [c for c in lines.columns if c not in (value, "kind", *FIELDS)]
    return typed.select(*keep, "kind", *(F.when(F.col("kind") == "event", c).alias(k) for k, c in shown.items()))


def event_counts(parsed: DataFrame) -> DataFrame:
    """How many lines there are of each kind."""
    return parsed.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------------------------------- message files


#: A quoted empty field is an empty string, no null: the mark for nulls is one that does not occur.
_CSV = {"multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "\x00", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_messages(spark: SparkSession, path: str, line_mode: bool = False) -> DataFrame:
    """Messages of CSV files with a header, with ``path``; ``in_time_order`` of the paths gives the order of the files.

    Quoted line breaks are kept; an empty field is an empty string. With ``line_mode`` every physical line is a message of its own (column ``body``), as when
    files are replayed line by line: headers are among them, and messages with line breaks come in parts.
    """
    if line_mode:
        return spark.read.text(path).where("value <> ''").select(F.col("value").alias("body"), F.input_file_name().alias("path"))
    rows = spark.read.csv(path, schema=MESSAGE, header=True, **_CSV)
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in FIELDS), F.input_file_name().alias("path"))


def lenient_texts(spark: SparkSession, path: str) -> DataFrame:
    """(text) of CSV files whose header names a ``text`` column in any case; ragged rows are kept."""
    rows = spark.read.csv(path, header=True, inferSchema=False, **_CSV)
    name = next((c for c in rows.columns if c.strip().lower() == "text"), None)
    if name is None:
        raise ValueError(f"no text column in {path}")
    return rows.select(F.col(f"`{name}`").alias("text")).where("text IS NOT NULL")


def tweets(raw: DataFrame, settings: Settings, words: list[str] | None = None, body: str = "body", count_retweets: bool = False) -> DataFrame:
    """Tweets of the bodies that the tolerant parser loads: id_str, unix, user_id_str, text, tokens, retweeted, retweet_count; other columns stay.

    ``retweet_count`` is 0 as in the described engine, unless ``count_retweets`` (then null where it is no number).
    """
    loaded = parse_messages(raw, body)
    keep = [F.col(f"`{c}`") for c in loaded.columns if c not in ("id_str", "unix", "user_id_str", "text", "tokens", "retweeted", "retweet_count")]
    n = F.col("retweet_count").try_cast("int") if count_retweets else F.lit(0)
    return loaded.select(*keep, "id_str", "unix", "user_id_str", "text", tokens(F.col("text"), settings, words).alias("tokens"), "retweeted", n.alias("retweet_count"))


def strict_counts(raw: DataFrame, body: str = "body") -> DataFrame:
    """One row: rows, loadable ones and others."""
    good = load_strict(raw, body).agg(F.count(F.lit(1))).scalar()
    return raw.agg(F.count(F.lit(1)).alias("rows")).withColumn("good", good).withColumn("bad", F.col("rows") - F.col("good"))


# ------------------------------------------------------------------------------------------------- lists and state


def word_list(lines: DataFrame, line: str = "line") -> DataFrame:
    """(word): trimmed, lower-cased, each once; blank lines and comments are left out."""
    word = F.lower(F.trim(F.regexp_replace(line, r"^\s+|\s+$", "")))
    return lines.select(word.alias("word")).where("word <> '' AND NOT startswith(word, '#')").distinct()


#: Words that a list may have to be used in expressions.
MOST_WORDS = 20_000


def words_of(lines: DataFrame, line: str = "line") -> list[str]:
    """The word list on the driver, for use in expressions: a list kept by hand, of at most MOST_WORDS words (else an error; see ``without_words``)."""
    words = word_list(lines, line).limit(MOST_WORDS + 1).collect()
    if len(words) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words: take them out with without_words")
    return sorted(r.word for r in words)


def without_words(rows: DataFrame, words: DataFrame, token: str = "token") -> DataFrame:
    """Rows whose ``token``, lower-cased, is not in the list (word), of whatever size."""
    return rows.join(words, F.lower(token) == F.col("word"), "left_anti")


def changed_words(words: DataFrame, add: list[str] = (), remove: list[str] = ()) -> DataFrame:
    """The word list with words added and taken out, whatever their case."""
    spark = words.sparkSession
    more = spark.createDataFrame([(w.strip().lower(),) for w in add if w.strip()], "word string")
    return words.unionByName(more).distinct().where(~F.col("word").isin([w.strip().lower() for w in remove]))


def first_messages(messages: DataFrame, n: int = 500, body: str = "body", order_col: str | None = None) -> DataFrame:
    """The first ``n`` bodies (in order of ``order_col``, if given) that are no headers, for trying a queue out."""
    rows = messages.where(~F.col(body).startswith("id_str"))
    return (rows.orderBy(F.col(order_col).asc_nulls_last()) if order_col else rows).limit(n)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(token) of text files with one token a line; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("token")).where("token <> ''")


def inspect_tokens(found: DataFrame, samples: int = 20) -> DataFrame:
    """(token, n, odd): the first ``samples`` tokens, and all that are long and change between cases inside."""
    counts = found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    odd = counts.withColumn("odd", (F.length("token") > 20) & F.col("token").rlike("[a-z][A-Z]|[A-Z][a-z].*[A-Z]"))
    return odd.where("odd").unionByName(odd.where("NOT odd").orderBy("token").limit(samples))


def read_state(spark: SparkSession, state_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{state_dir}/{name}")


# ------------------------------------------------------------------------------------------------- file names


def start_millis(path: Column) -> Column:
    """Start time in epoch milliseconds from a file name; null if the name holds none.

    Names are ``..._START_END.csv`` or ``....csv_START_END.csv`` with 13-digit milliseconds, ``YYYYMMDD_HHMMSS`` (UTC), a
    10-digit epoch second, or without a year ``MMDD_HHMM`` or ``HHMM``, which count from the beginning of 1970: these order
    files of one year or one day only.
    """
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    millis = F.regexp_extract(name, r"(?<!\d)(\d{13})_\d{13}(?!\d)", 1)
    date = F.regexp_extract(name, r"(?<!\d)(\d{8}_\d{6})(?!\d)", 1)
    second = F.regexp_extract(name, r"(?<!\d)(\d{10})(?!\d)", 1)
    stamp = F.unix_millis(F.try_to_timestamp(F.when(date != "", date), F.lit("yyyyMMdd_HHmmss")))
    day, hour = F.regexp_extract(name, r"(?<!\d)(\d{4}_\d{4})(?!\d)", 1), F.regexp_extract(name, r"(?<!\d)(\d{4})(?!\d)", 1)
    short = F.unix_millis(F.try_to_timestamp(F.when(day != "", F.concat(F.lit("1970"), day)), F.lit("yyyyMMdd_HHmm")))
    clock = F.unix_millis(F.try_to_timestamp(F.when(hour != "", F.concat(F.lit("19700101"), hour)), F.lit("yyyyMMddHHmm")))
    return F.when(millis != "", millis.cast("bigint")).when(stamp.isNotNull(), stamp).when(second != "", second.cast("bigint") * 1000).when(short.isNotNull(), short).when(clock.isNotNull(), clock)


def in_time_order(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with ``name_ms`` and ``place``, 1, 2, ... by time and name; files without a time come last. A list of files, not of rows."""
    from pyspark.sql import Window

    timed = files.withColumn("name_ms", start_millis(F.col(path)))
    return timed.withColumn("place", F.row_number().over(Window.orderBy(F.col("name_ms").asc_nulls_last(), path)))
