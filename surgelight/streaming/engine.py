"""Busy words of a stream, in batches that are counted in messages.

Every micro-batch is numbered on from the state before it. The state is a set of tables in a shared folder, each with one part
for every epoch: the messages of batches that are still open (and the recent ones), token counts by token file, the first
occurrence of every new word, and the frequency classes of each rebuild. An epoch reads what it needs of them: open
messages, the files of the window where a rebuild is due, the classes in use, the dictionary. Parts that no later epoch can
need are removed, parts of the dictionary are merged, so the cost of an epoch follows its own size, the window and the
vocabulary, not the length of the stream.

A marker is written when all parts of an epoch are there. An epoch with a marker is not run again; one without is
written anew in full. So a repeated micro-batch changes nothing. There is no event time: order is the order of arrival, and
nothing is ever late.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from surgelight.config import Settings
from surgelight.operators import busy, order
from surgelight.operators.frequency import frequency_classes
from surgelight.session import ship
from surgelight.sinks.shared import SharedFolder

TABLES = {
    "messages": "seq bigint, ordinal bigint, tokens array<string>, before bigint",
    "files": "file_no bigint, token string, n bigint",
    "words": "token string, first_batch bigint, first_seq bigint",
    "classes": "rebuild bigint, token string, n bigint, class int",
    "busy": "batch bigint, class int, token string",
}
#: Parts of the dictionary that are merged into one.
MERGE = 32
WARM = "warm"


class BusyStream:
    """State under ``settings.state_dir``, a folder that all machines share and that belongs to one checkpoint."""

    def __init__(self, spark: SparkSession, settings: Settings):
        ship(spark)  # for sources in Python
        self.spark, self.settings, self.dir = spark, settings, settings.state_dir.rstrip("/")
        self.folder = SharedFolder(spark, settings.state_dir)

    # ------------------------------------------------------------------------------------------------- state

    def state(self, before: int | None = None) -> dict:
        """What the last marker (of an epoch below ``before``) says: messages, tokens, words and batches so far, and ``parts`` of each table with their reach."""
        done = [int(n) for n in self.folder.names("epochs") if n.isdigit() and (before is None or int(n) < before)]
        marker = self.folder.read(f"epochs/{max(done)}") if done else None
        first = {"messages": 0, "tokens": 0, "words": 0, "batches": 0, "parts": {"messages": [], "files": [], "words": [], "classes": [[WARM, 0]] if self.folder.exists(WARM) else []}}
        return json.loads(marker) if marker else first

    def _read(self, table: str, parts: list) -> DataFrame:
        paths = [f"{self.dir}/{table}/{p}" for p in parts]
        return self.spark.read.schema(TABLES[table]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[table])

    def _write(self, table: str, part: str | int, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.dir}/{table}/{part}")
        return self._read(table, [part])

    def warm_start(self, saved: DataFrame) -> bool:
        """Classes for the first batches from saved counts (token, n), if these make up a whole window. Only before the first epoch."""
        if self.folder.names("epochs"):
            return False
        s = self.settings
        if (saved.agg(F.sum("n")).first()[0] or 0) < s.window:
            return False
        classes = frequency_classes(saved, s.freq_classes, s.min_count_threshold)
        self._write("classes", WARM, classes.select(F.lit(0).cast("bigint").alias("rebuild"), "token", "n", "class"))
        self.folder.write(WARM, "saved counts")
        return True

    def saved_counts(self) -> DataFrame:
        """(token, n) of the last rebuild, from which a later run can start warm; empty before the first."""
        parts = self.state()["parts"]["classes"]
        if not parts:
            return self.spark.createDataFrame([], "token string, n bigint")
        rows = self._read("classes", [parts[-1][0]])
        return rows.where(F.col("rebuild") == rows.agg(F.max("rebuild")).scalar()).select("token", "n")

    def log(self) -> DataFrame:
        """The messages that are still held, with ``batch``."""
        return self._batched(self._read("messages", [p[0] for p in self.state()["parts"]["messages"]]))

    def _batched(self, messages: DataFrame) -> DataFrame:
        return messages.withColumn("batch", F.floor((F.col("ordinal") - 1) / self.settings.batch))

    def recent(self) -> DataFrame:
        """The last ``window_batches * batch`` messages."""
        least = self.state()["messages"] - self.settings.window_batches * self.settings.batch
        return self.log().where(F.col("ordinal") > least)

    def busy(self) -> DataFrame:
        """All results so far."""
        return self._read("busy", self.folder.names("busy"))

    # ------------------------------------------------------------------------------------------------- one epoch

    def process(self, df: DataFrame, epoch: int) -> None:
        """One micro-batch with ``seq`` (order of arrival) and ``tokens``."""
        if self.folder.exists(f"epochs/{epoch}"):
            return
        s, state = self.settings, self.state(epoch)
        parts = state["parts"]
        clean = df.select("seq", F.filter("tokens", lambda t: t.isNotNull() & (t != "")).alias("tokens"))
        numbered = order.with_running_sums(clean, "seq", {"_n": F.lit(1), "_t": F.size("tokens")})
        rows = self._write("messages", epoch, numbered.select("seq", (F.col("_n") + state["messages"]).alias("ordinal"), "tokens", (F.col("_t") - F.size("tokens") + state["tokens"]).alias("before")))
        added = rows.agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("t")).first()
        after = {"messages": state["messages"] + added.m, "tokens": state["tokens"] + added.t}
        after["batches"] = after["messages"] // s.batch
        first_file = state["tokens"] // s.file_tokens
        parts["messages"].append([epoch, after["messages"], first_file])

        filed = rows.select("before", F.posexplode("tokens").alias("pos", "token")).select(F.floor((F.col("before") + F.col("pos")) / s.file_tokens).alias("file_no"), "token")
        self._write("files", epoch, filed.groupBy("file_no", "token").agg(F.count(F.lit(1)).alias("n")))
        parts["files"].append([epoch, after["tokens"] // s.file_tokens])

        known = self._read("words", parts["words"])
        seen = busy.batch_counts(self._batched(rows)).groupBy("token").agg(F.min("batch").alias("first_batch"), F.min("first_seq").alias("first_seq"))
        new = self._write("words", epoch, seen.join(known.select("token"), "token", "left_anti").select("token", "first_batch", "first_seq"))
        after["words"] = state["words"] + new.count()
        parts["words"].append(epoch)

        self._rebuild(state, after, parts, epoch)
        if after["batches"] > state["batches"]:
            self._write("busy", epoch, self._results(state["batches"], after["batches"], parts))
        self._forget(after, parts, epoch)
        self.folder.write(f"epochs/{epoch}", json.dumps(after | {"parts": parts}))
        self._remove(parts, epoch)

    def _rebuild(self, state: dict, after: dict, parts: dict, epoch: int) -> None:
        """The classes of all rebuilds that have become due."""
        s = self.settings
        files = after["tokens"] // s.file_tokens
        done, due = order.rebuild_count(state["tokens"] // s.file_tokens, s), order.rebuild_count(files, s)
        if due == done:
            return
        n, e = s.token_persist_files, max(1, s.rebuild_every_files)
        first, last = n + done * e, n + (due - 1) * e
        low = self._first_file_needed(done)
        counts = self._read("files", [p for p, reach in parts["files"] if reach >= low]).where((F.col("file_no") >= low) & (F.col("file_no") < files))
        counts = counts.groupBy("file_no", "token").agg(F.sum("n").alias("n"))
        used = order.window_counts(counts, s, files).where(F.col("rebuild").between(first, last))
        classes = frequency_classes(used, s.freq_classes, s.min_count_threshold, by="rebuild")
        self._write("classes", epoch, classes.select(F.col("rebuild").cast("bigint").alias("rebuild"), "token", "n", "class"))
        parts["classes"].append([epoch, last])

    def _first_file_needed(self, rebuilds: int) -> int:
        """The first token file that the rebuild after ``rebuilds`` others uses."""
        s = self.settings
        e = max(1, s.rebuild_every_files)
        return max(0, rebuilds * e - (e if s.window_mode == "as_coded" else 0))

    def _results(self, first: int, end: int, parts: dict) -> DataFrame:
        """(batch, class, token) of batches ``first`` to ``end`` - 1."""
        s = self.settings
        held = self._batched(self._read("messages", [p for p, reach, _ in parts["messages"] if reach > first * s.batch]))
        rows = held.where(F.col("batch").between(first, end - 1))
        begins = rows.groupBy("batch").agg(F.min(F.floor(F.col("before") / s.file_tokens)).alias("first_file"))
        schedule = order.rebuild_of_batch(begins, s, warm=self.folder.exists(WARM))
        cells = busy.counters(busy.with_class(busy.batch_counts(rows), self._read("classes", [p for p, _ in parts["classes"]]), s, schedule), s)
        words = self._read("words", parts["words"]).groupBy("token").agg(F.min("first_batch").alias("first_batch"), F.min("first_seq").alias("first_seq"))
        return busy.words_at(busy.hot_positions(cells, s), busy.keyed_words(words, s), s.z_score).select(F.col("batch").cast("bigint").alias("batch"), "class", "token")

    def _forget(self, after: dict, parts: dict, epoch: int) -> None:
        """Takes parts that no later epoch needs off the lists; many parts of the dictionary become one."""
        s = self.settings
        least = min(after["batches"] * s.batch, after["messages"] - s.window_batches * s.batch)
        parts["messages"] = [p for p in parts["messages"] if p[1] > least]
        low = self._first_file_needed(order.rebuild_count(after["tokens"] // s.file_tokens, s))
        parts["files"] = [p for p in parts["files"] if p[1] >= low]
        oldest = min((p[2] for p in parts["messages"]), default=after["tokens"] // s.file_tokens)
        used = lambda p: p[1] > oldest - s.rebuild_every_files or (p[0] == WARM and oldest < s.token_persist_files)
        parts["classes"] = [p for p in parts["classes"] if used(p) or p is parts["classes"][-1]]
        if len(parts["words"]) > MERGE:
            self._write("words", f"to-{epoch}", self._read("words", parts["words"]))
            parts["words"] = [f"to-{epoch}"]

    def _remove(self, parts: dict, epoch: int) -> None:
        """Removes the parts that are on no list any more, and old markers."""
        for table in ("messages", "files", "words", "classes"):
            kept = {str(p[0] if isinstance(p, list) else p) for p in parts[table]}
            for name in self.folder.names(table):
                if name not in kept and name != WARM and int(name.removeprefix("to-")) <= epoch:
                    self.folder.delete(f"{table}/{name}")
        for name in self.folder.names("epochs"):
            if name.isdigit() and int(name) < epoch - MERGE:
                self.folder.delete(f"epochs/{name}")

    def start(self, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Runs over a stream with ``seq`` and ``tokens``; with ``once`` it ends when all that is there has been read."""
        owner = self.folder.read("owner")
        if owner not in (None, checkpoint):
            raise ValueError(f"{self.dir} holds the state of the checkpoint {owner}; start warm from its saved counts in a new folder instead")
        self.folder.write("owner", checkpoint)
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
