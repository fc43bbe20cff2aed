"""The tolerant parser of message bodies, as the described engine loads them.

A body is the first CSV record in it (leading empty lines do not count). It loads if the record has ten fields or more, is
no header, and its second field is a date. Only the fields that the engine uses are looked at: counts are not read,
``retweeted`` is true for ``True`` alone, and the user may be empty. The strict validator is in ``strict``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surgelight.functions.text import normalised_space

LEAST_FIELDS = 10
#: A field: quoted, with quotes doubled; or without any quote or line feed.
_FIELD = r'"(?:[^"]++|"")*+"|[^",\n]*+'
_FIRST = rf"^(?:\r?\n)*+((?:{_FIELD})(?:,(?:{_FIELD}))*+)(?:\n|$)"
_DATE = (
    r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun) (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec) ([0-9]{1,2}) "
    r"([0-9]{1,2}):([0-5][0-9]):([0-5][0-9])(?:[.,][0-9]+)? ([+-])([0-9]{2})([0-9]{2}) ([0-9]{4})$"
)
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def message_seconds(c: Column) -> Column:
    """Epoch seconds of ``Mon Jan 2 15:04:05 -0700 2006``: white space is evened, names may have any case, the day of the week
    has to be one but is not compared with the date; null if it is no date."""
    even = normalised_space(c)
    part = lambda i: F.regexp_extract(even, _DATE, i)
    number = lambda i: F.when(part(i) != "", part(i)).cast("bigint")
    month = ((F.instr(F.lit(_MONTHS), F.lower(part(1))) + 2) / 3).cast("int")
    start = F.when(even.rlike(_DATE), F.make_date(number(9).cast("int"), month, F.lit(1)))
    ok = number(2).between(1, F.day(F.last_day(start))) & (number(3) < 24) & (number(7) <= 24) & (number(8) <= 60)
    clock = number(3) * 3600 + number(4) * 60 + number(5)
    offset = (number(7) * 3600 + number(8) * 60) * F.when(part(6) == "-", -1).otherwise(1)
    return F.when(ok, (F.unix_date(start) + number(2) - 1) * 86400 + clock - offset)


def _fields(body: Column) -> Column:
    """The fields of the first record, unquoted; null if its quotes are not in order."""
    record = F.regexp_extract(F.regexp_replace(body, r"\r(?=\n|$)", ""), _FIRST, 1)
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({_FIELD})"), F.lit(1))
    plain = F.transform(raw, lambda x: F.when(x.startswith('"'), F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), '""', '"')).otherwise(x))
    return F.when(record != "", plain)


def parse_messages(raw: DataFrame, body: str = "body") -> DataFrame:
    """The rows of ``raw`` whose body loads, with id_str, unix, user_id_str, retweet_count (as written), text and retweeted; other columns stay.

    Null, blank and broken bodies, short records and headers are left out. A column of ``raw`` with one of these names, and
    ``body`` itself, is replaced. Repeated rows each load.
    """
    made = ("id_str", "unix", "user_id_str", "retweet_count", "text", "retweeted")
    names = [f"c{i}" for i in range(len(raw.columns))]
    keep = [(i, c) for i, c in zip(names, raw.columns) if c not in (body, *made)]
    rows = raw.toDF(*names).withColumn("_f", _fields(F.col(names[raw.columns.index(body)]))).where(F.size("_f") >= LEAST_FIELDS)
    at = lambda k: F.get("_f", F.lit(k))
    rows = rows.where((at(0) != "id_str") & (at(1) != "created_at")).withColumn("_u", message_seconds(at(1))).where("_u IS NOT NULL")
    shown = (at(0), F.col("_u"), at(2), at(3), at(4), at(5) == "True")
    return rows.select(*(F.col(i).alias(c) for i, c in keep), *(c.alias(n) for c, n in zip(shown, made)))
