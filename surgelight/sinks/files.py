"""Writers: message files, busy words, statistics, token files, saved state and the replay marker."""

from __future__ import annotations

import datetime as dt
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surgelight.config import Settings
from surgelight.sinks.shared import SharedFolder
from surgelight.sources.queue import file_system
from surgelight.sources.strict import FIELDS


def write_messages(events: DataFrame, path: str) -> None:
    """The ten message columns as CSV files with a header; quotes inside a field are doubled."""
    events.select(*FIELDS).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=True, lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def busy_name(settings: Settings, started: dt.datetime) -> str:
    return f"bw_{started:%Y%m%d_%H%M%S}_{settings.z_score:.1f}.csv"


def write_busy(rows: DataFrame, settings: Settings, started: dt.datetime) -> str:
    """Result rows as CSV under the log folder, sorted by batch and class; the folder's name is returned."""
    path = os.path.join(settings.log_dir, busy_name(settings, started))
    rows.sort("Batch", "Class").write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def append_stats(path: str, tweets: int, tokens: int, distinct: int, at: dt.datetime) -> None:
    """One row of running totals at the end of a small CSV file, on any file system that Arrow knows; the header is written first to a new file."""
    fs, target = file_system(path)
    fs.create_dir(os.path.dirname(target) or ".", recursive=True)
    try:
        with fs.open_input_stream(target) as f:
            before = f.read().decode()
    except FileNotFoundError:
        before = "timestamp,total_tweets,total_tokens,distinct_tokens\n"
    with fs.open_output_stream(f"{target}.new") as f:
        f.write(f"{before}{at:%Y-%m-%d %H:%M:%S},{tweets},{tokens},{distinct}\n".encode())
    fs.move(f"{target}.new", target)


def write_token_files(tokens: DataFrame, path: str, settings: Settings) -> int:
    """The tokens of each complete file of (seq, pos, token, file_no), one a line, as ``token_batch_NNNNNN`` under ``path``; how many files there are then.

    Numbers go on from the files that are there, and file_no is counted from the first one given. ``read_token_files`` of one
    of them, or of ``path/*``, gives the tokens back. Each file is sorted and written by one task, as it holds a bounded number of tokens.
    """
    spark = tokens.sparkSession
    folder = SharedFolder(spark, path)
    have = [int(n.rsplit("_", 1)[1]) for n in folder.names("") if re.fullmatch(r"token_batch_\d{6,}", n)]
    next_no = max(have, default=-1) + 1
    whole = tokens.groupBy("file_no").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == settings.file_tokens)
    rows = tokens.join(whole.select("file_no"), "file_no").select(F.concat(F.lit("token_batch_"), F.lpad((F.col("file_no") + next_no).cast("string"), 6, "0")).alias("file"), "seq", "pos", F.col("token").alias("value"))
    beside = f"new-{uuid.uuid4().hex}"
    rows.repartition("file").sortWithinPartitions("file", "seq", "pos").select("file", "value").write.partitionBy("file").text(f"{path.rstrip('/')}/{beside}")
    made = [n for n in folder.names(beside) if n.startswith("file=")]
    for name in made:
        folder.move(f"{beside}/{name}", name.removeprefix("file="))
    folder.delete(beside)
    return next_no + len(made)


def keep_last_files(spark: SparkSession, path: str, settings: Settings) -> None:
    """Removes all but the newest ``token_persist_files`` token files."""
    folder = SharedFolder(spark, path)
    names = sorted(n for n in folder.names("") if re.fullmatch(r"token_batch_\d{6,}", n))
    for name in names[: -settings.token_persist_files]:
        folder.delete(name)


def write_state(df: DataFrame, state_dir: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{state_dir}/{name}")


def write_marker(path: str, value: str) -> None:
    """Replaces a small file in one step: written beside it, flushed to disk, renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(value)
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, path)
    except BaseException:
        if os.path.exists(beside):
            os.unlink(beside)
        raise


def read_marker(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read().strip() or None
    except FileNotFoundError:
        return None


def batch_text(batch: int, words: dict[int, list[str]]) -> str:
    """A printable summary of one batch."""
    lines = [f"batch {batch}: {sum(map(len, words.values()))} busy words in {sum(map(bool, words.values()))} classes"]
    lines += [f"  class {c}: {', '.join(sorted(w))}" for c, w in sorted(words.items()) if w]
    return "\n".join(lines)


def growth_text(points: list[tuple[int, int]], width: int = 60) -> str:
    """The growth curve as bars of characters."""
    top = max((n for _, n in points), default=0)
    return "\n".join(f"{m:>12,} {'#' * (round(width * n / top) if top else 0)} {n:,}" for m, n in points)
