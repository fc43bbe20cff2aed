import dataclasses
import datetime as dt
import json
import random
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import surgelight.__main__ as program
from surgelight.config import Settings
from surgelight.functions.text import tokens
from surgelight.plans import pipeline
from surgelight.sinks.replay import replay
from surgelight.sources.queue import BrokerClient, FolderClient, QueueSource
from surgelight.sources.strict import load_strict
from surgelight.streaming import engine
from surgelight.streaming.engine import BusyStream
from surgelight.streaming.statistics import statistics


def _messages(n):
    r = random.Random(5)
    words = [f"word{i:02d}".replace("0", "o").replace("1", "l") + "abcdefghij"[i % 10] for i in range(40)]
    return [(i, " ".join(r.choices(words, [40 - k for k in range(40)], k=6) + ["surging"] * (3 if 60 <= i < 70 else 0))) for i in range(n)]


def _settings(tmp_path):
    return Settings(batch=20, window=120, token_persist_files=4, rebuild_every_files=2, freq_classes=2, bw_array_len=50, z_score=2.0, state_dir=str(tmp_path / "state"))


def test_stream_equals_batch_and_repeats_change_nothing(spark, tmp_path):
    s = _settings(tmp_path)
    df = spark.createDataFrame(_messages(110), "seq bigint, text string")
    want = {tuple(r) for r in pipeline.busy_of_windows(df, s).select("batch", "class", "token").collect()}
    stream = BusyStream(spark, s)
    tokenised = df.select("seq", tokens(F.col("text"), s).alias("tokens"))
    cuts = [0, 35, 36, 80, 110]
    for epoch, (a, b) in enumerate(zip(cuts, cuts[1:])):
        for _ in range(2 if epoch == 2 else 1):
            stream.process(tokenised.where(F.col("seq").between(a, b - 1)), epoch)
    got = [tuple(r) for r in stream.busy().collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_state_stays_small_and_a_broken_epoch_is_done_again(spark, tmp_path, monkeypatch):
    """Over many epochs old parts go, and the results are still those of one batch run."""
    monkeypatch.setattr(engine, "MERGE", 3)
    s = dataclasses.replace(_settings(tmp_path), window_batches=1)
    df = spark.createDataFrame(_messages(160), "seq bigint, text string")
    want = {tuple(r) for r in pipeline.busy_of_windows(df, s).select("batch", "class", "token").collect()}
    tokenised = df.select("seq", tokens(F.col("text"), s).alias("tokens")).cache()
    stream = BusyStream(spark, s)
    for epoch in range(8):
        part = tokenised.where(F.col("seq").between(epoch * 20, epoch * 20 + 19))
        if epoch == 5:  # lost before its marker
            with monkeypatch.context() as m:
                m.setattr(stream.folder, "write", lambda *a: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    stream.process(part, epoch)
            stream = BusyStream(spark, s)
        stream.process(part, epoch)
    assert {tuple(r) for r in stream.busy().collect()} == want and want
    state = stream.state()
    assert state["messages"] == 160 and state["words"] == tokenised.select(F.explode("tokens")).distinct().count()
    for table in ("messages", "files", "words", "classes"):
        assert len(stream.folder.names(table)) <= 5
    assert sorted(r.seq for r in stream.recent().collect()) == list(range(140, 160))
    with pytest.raises(ValueError):
        stream.folder.write("owner", "another")
        stream.start(None, "mine")


def test_warm_start(spark, tmp_path):
    s = dataclasses.replace(_settings(tmp_path), state_dir=str(tmp_path / "one"))
    df = spark.createDataFrame(_messages(120), "seq bigint, text string")
    tokenised = df.select("seq", tokens(F.col("text"), s).alias("tokens"))
    one = BusyStream(spark, s)
    assert one.saved_counts().count() == 0
    one.process(tokenised, 0)
    saved = one.saved_counts()
    assert saved.agg(F.sum("n")).first()[0] == s.window  # the window of the last rebuild
    cold, warm = (BusyStream(spark, dataclasses.replace(s, state_dir=str(tmp_path / n))) for n in ("cold", "warm"))
    assert warm.warm_start(saved) and not cold.warm_start(saved.limit(1))
    for stream in (cold, warm):
        stream.process(tokenised, 0)
    early, late = ({r.batch for r in x.busy().collect()} for x in (warm, cold))
    assert min(early) < min(late)
    assert not warm.warm_start(saved)
    common = lambda x: {tuple(r) for r in x.busy().where(f"batch >= {min(late)}").collect()}
    assert common(warm) == common(cold)


def test_program(spark, tmp_path):
    rows = [f'"{i}","Tue Jan 03 15:04:05 +0000 2006","u","0","{t}","False","0","0","0","w"' for i, t in _messages(60)]
    (tmp_path / "queue").mkdir()
    (tmp_path / "queue" / "a.csv").write_text("\n".join(["id_str,created_at", *rows]))
    (tmp_path / "words.txt").write_text("# none\nsurging\n")
    s = _settings(tmp_path)
    values = {k: getattr(s, k) for k in ("batch", "window", "token_persist_files", "rebuild_every_files", "freq_classes", "bw_array_len", "z_score")}
    values |= {"log_dir": str(tmp_path / "logs"), "persistence": {"state_dir": str(tmp_path / "state")}, "filter": {"enabled": True, "filter_file": str(tmp_path / "words.txt")}}
    (tmp_path / "c.json").write_text(json.dumps(values))
    path = program.main([str(tmp_path / "c.json"), str(tmp_path / "queue"), str(tmp_path / "checkpoint"), "--option", "maxMessagesPerTrigger=25", "--option", f"progressPath={tmp_path}/progress"])
    got = spark.read.csv(path, header=True)
    assert got.count() == 3 * 2 and "surging" not in str(got.collect())
    stats = (tmp_path / "logs" / "stats.csv").read_text().splitlines()
    assert stats[0] == "timestamp,total_tweets,total_tokens,distinct_tokens" and stats[-1].split(",")[1] == "60"


def test_statistics(spark):
    rows = [(1, ["a", "b"]), (29, ["a"]), (30, None), (95, ["c", "", None]), (None, ["z"])]
    df = spark.createDataFrame([(None if t is None else dt.datetime(2020, 1, 1) + dt.timedelta(seconds=t), k) for t, k in rows], "t timestamp, tokens array<string>")
    got = [(str(r.until)[-8:], *r[1:]) for r in statistics(df, "t").orderBy("until").collect()]
    assert got == [("00:00:30", 2, 3, 2, 0.066667), ("00:01:00", 3, 3, 2, 0.033333), ("00:02:00", 4, 4, 3, 0.033333)]
    assert statistics(df.limit(0), "t").count() == 0


def test_structured_streaming_over_a_queue(spark, tmp_path):
    s = _settings(tmp_path)
    queue = tmp_path / "queue"
    queue.mkdir()
    rows = [f'"{i}","Tue Jan 03 15:04:05 +0000 2006","u","0","{t}","False","0","0","0","w"' for i, t in _messages(60)]
    (queue / "b.csv").write_text("\n".join(rows[30:]))
    (queue / "a.csv").write_text("id_str,created_at\n\n" + "\n".join(rows[:30]) + "\n")
    spark.dataSource.register(QueueSource)
    raw = spark.readStream.format("surgelight_queue").option("path", str(queue)).option("partitions", "2").load()
    messages = load_strict(raw).select("seq", tokens(F.col("record.text"), s).alias("tokens"))
    stream = BusyStream(spark, s)
    query = stream.start(messages, str(tmp_path / "checkpoint"), once=False)
    query.processAllAvailable()
    query.stop()
    assert stream.state()["messages"] == 60
    df = spark.createDataFrame(_messages(60), "seq bigint, text string")
    want = {tuple(r) for r in pipeline.busy_of_windows(df, s).select("batch", "class", "token").collect()}
    assert {tuple(r) for r in stream.busy().collect()} == want


def test_before_the_first_rebuild(spark, tmp_path):
    s = _settings(tmp_path)
    stream = BusyStream(spark, s)
    assert stream.busy().count() == 0
    stream.process(spark.createDataFrame([], "seq bigint, tokens array<string>"), 0)
    stream.process(spark.createDataFrame([(i, ["a"]) for i in range(25)], "seq bigint, tokens array<string>"), 1)
    assert stream.busy().count() == 0


def test_publishing_to_a_queue(spark, tmp_path):
    spark.dataSource.register(QueueSource)
    df = spark.createDataFrame([(i, f"body {i}") for i in range(20)], "seq bigint, body string").repartition(3)
    for _ in range(2):
        df.write.format("surgelight_queue").option("path", str(tmp_path / "q")).mode("append").save()
    assert FolderClient({"path": str(tmp_path / "q")}).inspect() == {"name": "q", "messages": 20, "consumers": 0}
    source = spark.readStream.format("surgelight_queue").option("path", str(tmp_path / "q")).load()
    query = source.writeStream.format("surgelight_queue").option("path", str(tmp_path / "copy")).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(FolderClient({"path": str(tmp_path / "copy")}).fetch(0, 99)) == sorted(f"body {i}" for i in range(20))


def test_a_limited_source_keeps_to_its_limit_and_goes_on_after_a_restart(spark, tmp_path):
    spark.dataSource.register(QueueSource)
    queue = tmp_path / "q"
    queue.mkdir()
    (queue / "a").write_text("\n".join(f"m{i}" for i in range(25)))
    sizes, got = [], []

    def take(df, epoch):
        rows = [(r.seq, r.body) for r in df.collect()]
        sizes.append(len(rows))
        got.extend(rows)

    def run():
        source = spark.readStream.format("surgelight_queue").option("path", str(queue)).option("maxMessagesPerTrigger", "10").option("progressPath", str(tmp_path / "p")).load()
        query = source.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()

    run()
    assert max(sizes) <= 10 and got == [(i, f"m{i}") for i in range(25)]
    (queue / "b").write_text("\n".join(f"m{i}" for i in range(25, 40)))
    run()
    assert max(sizes) <= 10 and got == [(i, f"m{i}") for i in range(40)]


class _Broker:
    """Stands for the package pika: queues in memory; what is taken and not acknowledged comes back."""

    waiting: list[bytes] = []

    def __init__(self):
        self.taken: list[bytes] = []

    def queue_declare(self, queue, durable=False, passive=False):
        return SimpleNamespace(method=SimpleNamespace(queue=queue, message_count=len(self.waiting), consumer_count=1))

    def basic_get(self, queue, auto_ack):
        if not self.waiting:
            return None, None, None
        self.taken.append(self.waiting.pop(0))
        return SimpleNamespace(delivery_tag=len(self.taken)), None, self.taken[-1]

    def basic_ack(self, delivery_tag, multiple):
        del self.taken[:delivery_tag]

    def basic_publish(self, exchange, routing_key, body, properties):
        self.waiting.append(body)


def test_broker_client(tmp_path, monkeypatch):
    class Connection:
        def __init__(self, parameters):
            self.open = _Broker()

        def channel(self):
            return self.open

        def close(self):
            _Broker.waiting[:0] = self.open.taken

    fake = SimpleNamespace(PlainCredentials=lambda *a: a, ConnectionParameters=lambda **k: k, BlockingConnection=Connection, BasicProperties=lambda **k: k)
    monkeypatch.setitem(sys.modules, "pika", fake)
    client = BrokerClient({"path": str(tmp_path / "log"), "queue": "q", "drain": "3"})
    bodies = ["a", 'two\nlines "x\\n"', "", "c", "d"]
    assert client.publish("x", bodies) == 5 and client.inspect() == {"name": "q", "messages": 5, "consumers": 1}
    assert client.latest() == 5 and list(client.fetch(0, 5)) == bodies and list(client.fetch(1, 3)) == bodies[1:3]
    client.publish("y", ["e"])
    with monkeypatch.context() as m:
        m.setattr(FolderClient, "publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            client.latest()
    assert client.latest() == 6 and list(client.fetch(5, 6)) == ["e"] and not _Broker.waiting
    monkeypatch.setitem(sys.modules, "pika", None)
    with pytest.raises(RuntimeError):
        client.inspect()


def test_replay_is_taken_up_again(tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for k in range(3):
        (folder / f"f{k}.csv").write_text(f"id_str\n\n{k},a\n{k},b\n")
    queue, marker = FolderClient({"path": str(tmp_path / "queue")}), str(tmp_path / "marker")

    class Breaks(FolderClient):
        def publish(self, name, bodies):
            if name == "f1.csv":
                raise OSError("gone")
            return super().publish(name, bodies)

    with pytest.raises(OSError):
        replay(str(folder), Breaks({"path": str(tmp_path / "queue")}), marker)
    assert queue.latest() == 3 and replay(str(folder), queue, marker) == 6 and queue.latest() == 9
    assert replay(str(folder), queue, marker) == 0
    assert list(queue.fetch(4, 8)) == ["1,a", "1,b", "id_str", "2,a"]
