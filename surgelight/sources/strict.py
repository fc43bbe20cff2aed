"""Strict load of CSV message bodies, and the rows that cannot be loaded with the reason.

The strict loader keeps conforming rows only. The offsets of what it loaded are taken from the offsets of all raw rows
by an anti join; only that remainder is diagnosed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of a message, in order.
FIELDS = ("id_str", "created_at", "user_id_str", "retweet_count", "text", "retweeted", "at", "http", "hashtag", "words")
#: One field with the comma before it: quoted with doubled quotes, or without any quote or line break.
_FIELD = r',("(?:[^"]++|"")*+"|[^",\r\n]*+)'
_DATE = (
    r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) ([0-9]{1,2}) "
    r"([01][0-9]|2[0-3]):([0-5][0-9]):([0-5][0-9]) ([+-])(0[0-9]|1[0-9]|2[0-3])([0-5][0-9]) ([0-9]{4})$"
)
_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def _unquoted(raw: Column) -> Column:
    inner = F.regexp_replace(F.substring(raw, F.lit(2), F.length(raw) - 2), '""', '"')
    return F.when(raw.startswith('"'), inner).otherwise(raw)


def spaces_evened(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def created_seconds(c: Column) -> Column:
    """Epoch seconds of ``Mon Jan 02 15:04:05 -0700 2006``, whatever the spaces; null unless it is a real date with the right day of the week."""
    even = spaces_evened(c)
    part = lambda i: F.regexp_extract(even, _DATE, i)
    month = ((F.instr(F.lit(_MONTHS), part(1)) + 2) / 3).cast("int")
    well = even.rlike(_DATE)
    start = F.when(well & (part(9).cast("int") > 0), F.make_date(part(9).cast("int"), month, F.lit(1)))
    day = F.when(well, part(2).cast("int"))
    real = (day >= 1) & (day <= F.day(F.last_day(start)))
    date = F.when(real, F.date_add(start, day - 1))
    right = F.date_format(date, "EEE") == F.substring(even, 1, 3)
    offset = (part(7).cast("bigint") * 3600 + part(8).cast("bigint") * 60) * F.when(part(6) == "-", -1).otherwise(1)
    clock = part(3).cast("bigint") * 3600 + part(4).cast("bigint") * 60 + part(5).cast("bigint")
    return F.when(right, F.unix_date(date).cast("bigint") * 86400 + clock - offset)


def _with_fields(df: DataFrame, body: str) -> DataFrame:
    """Adds ``_n`` (fields found), ``_whole`` (the fields make up the body again) and ``_f`` (the unquoted fields)."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), F.col(body)), F.lit(_FIELD), F.lit(1))
    out = df.withColumn("_r", raw)
    return out.withColumns(
        {"_n": F.size("_r"), "_whole": F.coalesce(F.array_join("_r", ",") == F.col(body), F.lit(False)), "_f": F.transform("_r", _unquoted)}
    ).drop("_r")


def _field(name: str) -> Column:
    return F.try_element_at(F.col("_f"), F.lit(FIELDS.index(name) + 1))


def _header() -> Column:
    return F.coalesce((_field("id_str") == "id_str") | (_field("created_at") == "created_at"), F.lit(False))


def _faults() -> list[tuple[Column, str]]:
    digits = lambda name: ~_field(name).rlike("^[0-9]+$")
    return [
        (digits("id_str"), "id_str is not digits"),
        (created_seconds(_field("created_at")).isNull(), "created_at is no real date"),
        (_field("user_id_str") == "", "user_id_str is empty"),
        *((digits(n), f"{n} is not digits") for n in ("retweet_count", "at", "http", "hashtag")),
        (~_field("retweeted").isin("True", "False"), "retweeted is neither True nor False"),
    ]


def load_strict(raw: DataFrame, body: str = "body") -> DataFrame:
    """The rows of ``raw`` whose body is one valid record, with a struct column ``record`` of the typed fields.

    ``record`` holds id_str, unix, user_id_str, retweet_count (bigint; null if it has more than 18 digits), text,
    retweeted, at, http, hashtag and words. All columns of ``raw`` stay. Headers, null, blank and broken bodies are left out.
    """
    names = [f"c{i}" for i in range(len(raw.columns))]
    well = _with_fields(raw.toDF(*names), names[raw.columns.index(body)]).where(F.col("_whole") & (F.col("_n") == len(FIELDS)))
    unix = created_seconds(_field("created_at"))
    bad = F.lit(False)
    for fault, _ in _faults():
        bad = bad | fault
    number = lambda n: _field(n).try_cast("bigint").alias(n)
    record = F.struct(
        _field("id_str").alias("id_str"),
        unix.alias("unix"),
        _field("user_id_str").alias("user_id_str"),
        number("retweet_count"),
        _field("text").alias("text"),
        (_field("retweeted") == "True").alias("retweeted"),
        number("at"),
        number("http"),
        number("hashtag"),
        _field("words").alias("words"),
    )
    return well.where(~bad & ~_header()).select(*(F.col(i).alias(c) for i, c in zip(names, raw.columns) if c != "record"), record.alias("record"))


def reject_reasons(raw: DataFrame, offset: str = "line_no", body: str = "body") -> DataFrame:
    """(``offset``, ``reason``) of every row of ``raw`` that is neither a header nor a valid row.

    Raw offsets minus loaded offsets, by an anti join, leave the bad rows and the headers; these are diagnosed. A row is
    known by its offset and a hash of its body, so that repeated or null offsets lose nothing. Null and blank bodies
    are bad rows. Rows sent twice count each. An empty table gives no row; other columns of ``raw`` are ignored.
    """
    lean = raw.select(F.col(offset).alias("_o"), F.col(body).alias("_b"))
    key = F.xxhash64("_b").alias("_h")
    loaded = load_strict(lean, "_b").select(F.col("_o").alias("_lo"), key.alias("_lh")).distinct()
    left = lean.withColumn("_h", F.xxhash64("_b"))
    rest = left.join(loaded, F.col("_o").eqNullSafe(F.col("_lo")) & (F.col("_h") == F.col("_lh")), "left_anti")
    seen = _with_fields(rest, "_b").where(~_header())
    quotes = F.length("_b") - F.length(F.regexp_replace("_b", '"', ""))
    reason = F.when(F.col("_b").isNull(), "body is null").when(F.col("_b").rlike(r"(?U)^\s*$"), "body is blank")
    reason = reason.when(~F.col("_whole") & (quotes % 2 == 1), "a quoted field does not end").when(~F.col("_whole"), "quotes or line breaks outside a quoted field")
    reason = reason.when(F.col("_n") < len(FIELDS), "too few fields").when(F.col("_n") > len(FIELDS), "too many fields")
    for fault, text in _faults():
        reason = reason.when(fault, text)
    return seen.select(F.col("_o").alias(offset), F.coalesce(reason, F.lit("unknown")).alias("reason"))
