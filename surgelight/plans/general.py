"""Queries of the two general problems (rows that fail to parse, messages delivered more than once), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surgelight.operators import quotient
from surgelight.sources import strict


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict.reject_reasons(table(spark, sf_dir, "csv_messages")).select("line_no")


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad rows and headers aside, how many rows fail for each reason."""
    return strict.reject_reasons(table(spark, sf_dir, "csv_messages")).groupBy("reason").agg(F.count("*").alias("n"))


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = strict.load_strict(table(spark, sf_dir, "csv_messages"))
    return loaded.select("line_no", "record.id_str", "record.unix", "record.user_id_str", "record.retweeted", "record.text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotient.repeated_deliveries(table(spark, sf_dir, "tweets"))


def p6_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    tweets = table(spark, sf_dir, "tweets").select("seq", "id_str", "unix", "text", "retweet_count")
    return quotient.first_deliveries(tweets)


QUERIES = {f.__name__: f for f in (p5_found, p5_reasons, p5_loaded, p6_found, p6_first)}

_FIELD = '("(?:[^"]|"")*"|[^",\\r\\n]*)'
_RECORD = "^" + ",".join([_FIELD] * 10) + "$"
_NAMES = "['id_str','created_at','user_id_str','retweet_count','text','retweeted','at','http','hashtag']"
PARSED = f"""
raw AS (SELECT line_no, body, regexp_full_match(coalesce(body, ''), '{_RECORD}') AS whole FROM csv_messages),
f AS (SELECT line_no, body, whole, regexp_extract(coalesce(body, ''), '^{_FIELD},{_FIELD}', ['a', 'b']) AS h,
  regexp_extract(coalesce(body, ''), '^{",".join([_FIELD] * 9)}', {_NAMES}) AS x FROM raw),
u AS (SELECT line_no, body, whole, {", ".join(f"CASE WHEN {src} LIKE '\"%' THEN replace(substr({src}, 2, length({src}) - 2), '\"\"', '\"') ELSE {src} END AS {name}" for name, src in [("h1", "h['a']"), ("h2", "h['b']")] + [(n, f"x['{n}']") for n in ("id_str", "created_at", "user_id_str", "retweet_count", "text", "retweeted", "at", "http", "hashtag")])} FROM f),
d AS (SELECT *, trim(regexp_replace(created_at, '\\s+', ' ', 'g')) AS even FROM u),
v AS (SELECT *, try_strptime(even, '%a %b %d %H:%M:%S %z %Y') AS stamp FROM d),
ok AS (SELECT *, whole AND regexp_full_match(id_str, '[0-9]+') AND stamp IS NOT NULL
  AND dayname(try_strptime(substr(even, 5, 6) || ' ' || right(even, 4), '%b %d %Y'))[1:3] = substr(even, 1, 3)
  AND user_id_str <> '' AND regexp_full_match(retweet_count, '[0-9]+') AND regexp_full_match("at", '[0-9]+') AND regexp_full_match(http, '[0-9]+')
  AND regexp_full_match(hashtag, '[0-9]+') AND retweeted IN ('True', 'False') AS good,
  coalesce(h1 = 'id_str' OR h2 = 'created_at', false) AS header FROM v)"""

# The tolerant parser: the first record, ten fields or more, and a date.
_LOOSE = '("(?:[^"]|"")*"|[^",\\n]*)'
_SIX = "['id_str','created_at','user_id_str','retweet_count','text','retweeted']"
LOADED = f"""
even AS (SELECT line_no, regexp_replace(body, '\\r(\\n|$)', '\\1', 'g') AS b FROM csv_messages WHERE body IS NOT NULL),
one AS (SELECT line_no, regexp_extract(b, '^\\n*{",".join([_LOOSE] * 6)}(?:,{_LOOSE.replace("(", "(?:", 1)}){{4,}}(?:\\n|$)', {_SIX}) AS x FROM even
  WHERE regexp_matches(b, '^\\n*{",".join([_LOOSE.replace("(", "(?:", 1)] * 6)}(?:,{_LOOSE.replace("(", "(?:", 1)}){{4,}}(?:\\n|$)')),
bare AS (SELECT line_no, {", ".join(f"CASE WHEN x['{n}'] LIKE '\"%' THEN replace(substr(x['{n}'], 2, length(x['{n}']) - 2), '\"\"', '\"') ELSE x['{n}'] END AS {n}" for n in ("id_str", "created_at", "user_id_str", "text", "retweeted"))} FROM one),
src AS (SELECT line_no, id_str, CAST(epoch(stamp) AS BIGINT) AS unix, user_id_str, text, retweeted = 'True' AS retweeted
  FROM (SELECT *, try_strptime(trim(regexp_replace(created_at, '\\s+', ' ', 'g')), '%a %b %d %H:%M:%S %z %Y') AS stamp FROM bare) WHERE stamp IS NOT NULL AND id_str <> 'id_str' AND created_at <> 'created_at')"""

_FIRST = r"row_number() OVER (PARTITION BY regexp_replace(id_str, '[^0-9]', '', 'g') ORDER BY seq) AS r"
_COUNTED = f"regexp_extract_all(',' || body, ',{_FIELD}', 1)"
_QUOTES = "length(body) - length(replace(body, '\"', ''))"
_REASONS = f"""WITH {PARSED}, n AS (SELECT *, {_COUNTED} AS parts FROM ok)
SELECT CASE WHEN body IS NULL THEN 'body is null' WHEN regexp_full_match(body, '\\s*') THEN 'body is blank'
  WHEN array_to_string(parts, ',') <> body AND ({_QUOTES}) % 2 = 1 THEN 'a quoted field does not end'
  WHEN array_to_string(parts, ',') <> body THEN 'quotes or line breaks outside a quoted field'
  WHEN len(parts) < 10 THEN 'too few fields' WHEN len(parts) > 10 THEN 'too many fields'
  WHEN NOT regexp_full_match(id_str, '[0-9]+') THEN 'id_str is not digits'
  WHEN stamp IS NULL OR dayname(try_strptime(substr(even, 5, 6) || ' ' || right(even, 4), '%b %d %Y'))[1:3] <> substr(even, 1, 3) THEN 'created_at is no real date'
  WHEN user_id_str = '' THEN 'user_id_str is empty'
  {" ".join(f"WHEN NOT regexp_full_match({chr(34)}{c}{chr(34)}, '[0-9]+') THEN '{c} is not digits'" for c in ("retweet_count", "at", "http", "hashtag"))}
  ELSE 'retweeted is neither True nor False' END AS reason, count(*) AS n
FROM n WHERE NOT header AND NOT coalesce(good, false) GROUP BY 1"""
ORACLES = {
    "p5_reasons": _REASONS,
    "p5_found": f"WITH {PARSED} SELECT line_no FROM ok WHERE NOT header AND NOT coalesce(good, false)",
    "p5_loaded": f"WITH {PARSED} SELECT line_no, id_str, CAST(epoch(stamp) AS BIGINT) AS unix, user_id_str, retweeted = 'True' AS retweeted, text FROM ok WHERE good AND NOT header",
    "p6_found": f"SELECT seq FROM (SELECT seq, {_FIRST} FROM tweets WHERE id_str IS NOT NULL) WHERE r > 1",
    "p6_first": f"SELECT seq, id_str, unix, text, retweet_count FROM (SELECT *, {_FIRST} FROM tweets) WHERE r = 1 OR id_str IS NULL",
}
