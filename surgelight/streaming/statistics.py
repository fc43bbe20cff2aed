"""Running totals and the rate of processing, of a stream as it goes and of messages with a time of arrival."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from surgelight.sinks.files import append_stats
from surgelight.streaming.engine import BusyStream

#: Seconds between two rows of statistics.
EVERY = 30


class StatisticsListener(StreamingQueryListener):
    """Adds a row of totals to the statistics file when ``every`` seconds have gone by since the last; keeps the rate. ``close`` adds the last row."""

    def __init__(self, stream: BusyStream, path: str, every: float = EVERY):
        self.stream, self.path, self.every = stream, path, every
        self.last, self.rate = 0.0, 0.0

    def close(self) -> None:
        state = self.stream.state()
        append_stats(self.path, state["messages"], state["tokens"], state["words"], dt.datetime.now(dt.UTC))

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.last = time.monotonic()

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.rate = event.progress.processedRowsPerSecond
        if time.monotonic() - self.last >= self.every:
            self.last = time.monotonic()
            self.close()

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass


def statistics(df: DataFrame, time_col: str, tokens_col: str = "tokens", every: int = EVERY) -> DataFrame:
    """(until, total_tweets, total_tokens, distinct_tokens, rate): totals at the end of every interval in which messages came, and its messages a second.

    A token is new in the interval of its first occurrence. Messages without a time, and null and empty tokens, do not count.
    """
    slot = (F.floor(F.unix_micros(F.col(time_col).cast("timestamp")) / (every * 1_000_000)) + 1) * every
    rows = df.where(F.col(time_col).isNotNull()).select(slot.alias("until"), F.filter(tokens_col, lambda t: t.isNotNull() & (t != "")).alias("t"))
    sums = rows.groupBy("until").agg(F.count(F.lit(1)).alias("m"), F.sum(F.coalesce(F.size("t"), F.lit(0))).alias("k"))
    firsts = rows.select("until", F.explode("t").alias("token")).groupBy("token").agg(F.min("until").alias("until")).groupBy("until").agg(F.count(F.lit(1)).alias("d"))
    up_to = Window.orderBy("until").rowsBetween(Window.unboundedPreceding, 0)  # one row for each interval
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(up_to)
    return sums.join(firsts, "until", "left").select(
        F.timestamp_seconds("until").alias("until"), total("m").alias("total_tweets"), total("k").alias("total_tokens"), total("d").alias("distinct_tokens"), F.round(F.col("m") / every, 6).alias("rate")
    )
