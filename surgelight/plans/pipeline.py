"""Whole pipelines: messages to busy words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgelight.config import Settings
from surgelight.functions.text import tokens
from surgelight.operators import busy, order
from surgelight.operators.frequency import frequency_classes
from surgelight.session import materialised


def tokenised(df: DataFrame, settings: Settings, words: list[str] | None = None, order_col: str = "seq", text_col: str = "text", upto: bool = False) -> DataFrame:
    """(seq, batch, tokens) of every message, tokens made from the text; with ``upto`` also the tokens of all messages up to and with each."""
    rows = df.select(F.col(order_col).alias("seq"), tokens(F.col(text_col), settings, words).alias("tokens"))
    return order.with_batch(rows, settings, **({"upto": F.size("tokens")} if upto else {}))


def busy_of_all(df: DataFrame, settings: Settings, words: list[str] | None = None, order_col: str = "seq", text_col: str = "text") -> DataFrame:
    """Busy words of each complete batch, with one class table from the counts of all messages.

    Occurrences are summed by batch and token once and written to the shared folder; classes, dictionary and counters are all
    made from these sums.
    """
    counts = materialised(busy.batch_counts(tokenised(df, settings, words, order_col, text_col)), "counts")
    totals = counts.groupBy("token").agg(F.sum("n").alias("n"))
    classes = frequency_classes(totals, settings.freq_classes, settings.min_count_threshold)
    return busy.busy_words(counts, classes, settings)


def busy_of_windows(df: DataFrame, settings: Settings, words: list[str] | None = None, order_col: str = "seq", text_col: str = "text") -> DataFrame:
    """Busy words of each complete batch, with the classes of the last rebuild before the batch began; nothing before the first rebuild."""
    rows = materialised(tokenised(df, settings, words, order_col, text_col, upto=True), "messages")
    before = F.col("upto") - F.size("tokens")
    filed = rows.select(before.alias("b"), F.posexplode("tokens").alias("pos", "token")).select("token", F.floor((F.col("b") + F.col("pos")) / settings.file_tokens).alias("file_no"))
    counts = filed.groupBy("file_no", "token").agg(F.count(F.lit(1)).alias("n"))
    last = rows.agg(F.max("upto")).first()[0] or 0
    classes = frequency_classes(order.window_counts(counts, settings, last // settings.file_tokens), settings.freq_classes, settings.min_count_threshold, by="rebuild")
    begins = rows.where("batch IS NOT NULL").groupBy("batch").agg(F.min(F.floor(before / settings.file_tokens)).alias("first_file"))
    return busy.busy_words(busy.batch_counts(rows), classes, settings, order.rebuild_of_batch(begins, settings))
