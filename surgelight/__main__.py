"""The engine as a program: ``python -m surgelight CONFIG QUEUE_FOLDER CHECKPOINT``.

Reads the configuration, takes messages from the queue, looks for busy words batch by batch, keeps statistics, and writes the
result file when it ends.
"""

from __future__ import annotations

import argparse
import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession

from surgelight.config import Settings
from surgelight.operators.busy import result_rows
from surgelight.session import build_session
from surgelight.sinks.files import write_busy
from surgelight.sources import files
from surgelight.sources.queue import QueueSource
from surgelight.streaming.engine import BusyStream
from surgelight.streaming.statistics import StatisticsListener


def listed_words(spark: SparkSession, settings: Settings) -> list[str] | None:
    """The words of the filter file of the settings, if they name one."""
    if not settings.filter_file:
        return None
    return files.words_of(spark.read.text(settings.filter_file).withColumnRenamed("value", "line"))


def run(spark: SparkSession, settings: Settings, messages: DataFrame, checkpoint: str, once: bool = True, saved: DataFrame | None = None) -> str:
    """From a stream of (seq, body) to the result file, whose path is returned. ``saved`` counts (token, n) let it start warm.

    With ``once`` it ends when the queue is empty, else when the query is stopped; what was begun then is taken up by the next run.
    """
    started = dt.datetime.now(dt.UTC)
    stream = BusyStream(spark, settings)
    if saved is not None:
        stream.warm_start(saved)
    tweets = files.tweets(messages, settings, listed_words(spark, settings)).select("seq", "tokens")
    listener = StatisticsListener(stream, os.path.join(settings.log_dir, "stats.csv"))
    spark.streams.addListener(listener)
    try:
        query = stream.start(tweets, checkpoint, once=False)
        if once:
            query.processAllAvailable()
            query.stop()
        query.awaitTermination()
    finally:
        spark.streams.removeListener(listener)
    listener.close()
    batches = spark.range(stream.state()["batches"]).withColumnRenamed("id", "batch")
    return write_busy(result_rows(stream.busy(), batches, settings), settings, started)


def main(arguments: list[str] | None = None) -> str:
    parser = argparse.ArgumentParser(prog="surgelight", description=__doc__)
    parser.add_argument("config", help="YAML or JSON file of settings")
    parser.add_argument("queue", help="folder of the queue, or of what is drained from a broker")
    parser.add_argument("checkpoint", help="shared folder of the stream's checkpoint")
    parser.add_argument("--option", action="append", default=[], metavar="NAME=VALUE", help="further option of the queue, such as client, host, maxMessagesPerTrigger")
    parser.add_argument("--warm", metavar="STATE", help="state folder of an earlier run whose counts are the first window")
    parser.add_argument("--keep-running", action="store_true", help="wait for further messages")
    given = parser.parse_args(arguments)
    settings = Settings.read(given.config)
    spark = build_session()
    spark.dataSource.register(QueueSource)
    options = dict(x.split("=", 1) for x in given.option)
    messages = spark.readStream.format("surgelight_queue").options(path=given.queue, **options).load()
    saved = None
    if given.warm:
        import dataclasses

        saved = BusyStream(spark, dataclasses.replace(settings, state_dir=given.warm)).saved_counts()
    return run(spark, settings, messages, given.checkpoint, not given.keep_running, saved)


if __name__ == "__main__":
    print(main())
