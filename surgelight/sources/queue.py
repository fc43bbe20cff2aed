"""A source and sink for message queues: ``format("surgelight_queue")`` of ``readStream``, ``write`` and ``writeStream``.

The queue is reached through a client, a class with ``__init__(options)``, ``latest() -> int``,
``fetch(start, end) -> iterable of bodies``, ``publish(name, bodies)`` and ``inspect() -> dict``, named by the option ``client`` as
``module:Class``. Offsets are message numbers; a client must give the same messages for the same numbers again, as Spark
asks again after a failure. A client may also cut a range of offsets into parts that are read apart from each other, by
``parts(start, end, n) -> list`` and ``read(part) -> iterable of bodies``.

``FolderClient`` replays the lines of the files of a shared folder in order of their names, and publishes to a new file of it;
``LogClient`` does the same for bodies that may have line breaks.
``BrokerClient`` drains an AMQP broker (with the package pika) into such a folder before it acknowledges, so that nothing is
lost and everything can be read again. Publishing the same task again replaces its messages in a folder; a broker may get
them twice, as any queue that delivers at least once.

Options: ``maxMessagesPerTrigger`` (no limit by default), ``progressPath``, ``partitions``, and those of the client. Spark asks a
source for its latest offset without telling where its checkpoint stands, so a limited source notes in the shared folder
``progressPath`` how far it has gone; it is needed with the limit, one folder for each query.
"""

from __future__ import annotations

import importlib
import sys
import uuid
from collections.abc import Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage


def file_system(path: str):  # noqa: ANN201
    """The file system of a path or URI, and the path on it."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


class FolderClient:
    """The lines of all files of the folder ``path`` (any file system that Arrow knows), headers too, empty lines left out, numbered from 0.

    Files are written once and not changed; new ones have later names. Lines of a file are counted once.
    """

    def __init__(self, options: dict[str, str]):
        self.fs, self.path = file_system(options["path"])
        self.counted: dict[str, int] = {}

    def _files(self) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))

    def _lines(self, name: str) -> Iterator[str]:
        import io

        with self.fs.open_input_stream(name) as raw:
            for line in io.TextIOWrapper(raw, "utf-8", "replace", "\n"):
                if body := line.rstrip("\r\n"):
                    yield body

    def _counts(self) -> list[tuple[str, int]]:
        names = self._files()
        for name in names:
            if name not in self.counted:
                self.counted[name] = sum(1 for _ in self._lines(name))
        return [(n, self.counted[n]) for n in names]

    def latest(self) -> int:
        return sum(n for _, n in self._counts())

    def parts(self, start: int, end: int, n: int) -> list[tuple[int, list[tuple[str, int, int]]]]:
        """At most about ``n`` parts: the number of their first message, and (file, lines to pass over, lines to take)."""
        edges = [start + (end - start) * i // n for i in range(n + 1)]
        out = []
        for a, b in zip(edges, edges[1:]):
            pieces, at = [], 0
            for name, lines in self._counts():
                low, high = max(a, at), min(b, at + lines)
                if low < high:
                    pieces.append((name, low - at, high - low))
                at += lines
            if pieces:
                out.append((a, pieces))
        return out

    def read(self, part: tuple[int, list[tuple[str, int, int]]]) -> Iterator[str]:
        from itertools import islice

        for name, skip, take in part[1]:
            yield from islice(self._lines(name), skip, skip + take)

    def fetch(self, start: int, end: int) -> Iterator[str]:
        for part in self.parts(start, end, 1):
            yield from self.read(part)

    def publish(self, name: str, bodies: Iterable[str]) -> int:
        self.fs.create_dir(self.path, recursive=True)
        beside, n = f"{self.path}/.{name}-{uuid.uuid4().hex}", 0
        with self.fs.open_output_stream(beside) as out:
            for body in bodies:
                out.write((body + "\n").encode())
                n += 1
        self.fs.move(beside, f"{self.path}/{name}")
        return n

    def inspect(self) -> dict:
        return {"name": self.path.rstrip("/").rsplit("/", 1)[-1], "messages": self.latest(), "consumers": 0}


class LogClient(FolderClient):
    """A folder of messages of any content: line breaks inside a body are kept as escapes, one line for each message."""

    def read(self, part: tuple) -> Iterator[str]:
        return map(_unescaped, super().read(part))

    def publish(self, name: str, bodies: Iterable[str]) -> int:
        return super().publish(name, map(_escaped, bodies))


class BrokerClient(LogClient):
    """A durable queue of an AMQP broker. Options: host, port, username, password, queue, exchange, ``path`` (the shared folder), ``drain`` (messages taken at a time).

    ``latest`` moves what waits in the queue into a new file of the folder and acknowledges it only then: what is not
    acknowledged after a failure is delivered again, at least once, and the repeated delivery is settled by its identifier later.
    """

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.options = options

    def _channel(self):  # noqa: ANN202
        try:
            import pika
        except ImportError as e:
            raise RuntimeError("a broker needs the package pika") from e
        o = self.options
        login = pika.PlainCredentials(o.get("username", "guest"), o.get("password", "guest"))
        connection = pika.BlockingConnection(pika.ConnectionParameters(host=o.get("host", "localhost"), port=int(o.get("port", 5672)), credentials=login))
        channel = connection.channel()
        channel.queue_declare(queue=o.get("queue", "tweet_in"), durable=True)
        return pika, connection, channel

    def latest(self) -> int:
        _, connection, channel = self._channel()
        queue, most = self.options.get("queue", "tweet_in"), int(self.options.get("drain", 10_000))
        try:
            while True:
                bodies, tag = [], None
                while len(bodies) < most:
                    method, _, body = channel.basic_get(queue=queue, auto_ack=False)
                    if method is None:
                        break
                    bodies.append(body.decode("utf-8", "replace"))
                    tag = method.delivery_tag
                if not bodies:
                    break
                super().publish(f"drained-{len(self._files()):09d}", bodies)
                channel.basic_ack(delivery_tag=tag, multiple=True)
        finally:
            connection.close()
        return super().latest()

    def publish(self, name: str, bodies: Iterable[str]) -> int:
        pika, connection, channel = self._channel()
        n = 0
        try:
            for body in bodies:
                channel.basic_publish(
                    exchange=self.options.get("exchange", ""), routing_key=self.options.get("queue", "tweet_in"), body=body.encode(), properties=pika.BasicProperties(delivery_mode=2)
                )
                n += 1
        finally:
            connection.close()
        return n

    def inspect(self) -> dict:
        _, connection, channel = self._channel()
        try:
            found = channel.queue_declare(queue=self.options.get("queue", "tweet_in"), passive=True).method
            return {"name": found.queue, "messages": found.message_count, "consumers": found.consumer_count}
        finally:
            connection.close()


def _escaped(body: str) -> str:
    """On one line, and never empty."""
    return "=" + body.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r")


def _unescaped(line: str) -> str:
    import re

    return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r"}.get(m[1], m[1]), line[1:])


def plain_options(options) -> dict[str, str]:  # noqa: ANN001
    """Options by lower-case name: Spark does not keep the case in which they were given."""
    return {k.lower(): v for k, v in dict(options).items()}


def client_of(options: dict[str, str]):  # noqa: ANN201
    module, _, name = options.get("client", "surgelight.sources.queue:FolderClient").partition(":")
    own = {c.__name__: c for c in (FolderClient, LogClient, BrokerClient)}
    client = own[name] if module == "surgelight.sources.queue" else getattr(importlib.import_module(module), name)
    return client(options)


class _Part(InputPartition):
    def __init__(self, start: int, end: int, part: tuple | None = None):
        self.start, self.end, self.part = start, end, part


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.client = client_of(options)
        self.step = int(options.get("maxmessagespertrigger", 0))
        if self.step and "progresspath" not in options:
            raise ValueError("maxMessagesPerTrigger needs progressPath")
        self.given = self._noted()

    def _noted(self) -> int:
        if not self.step:
            return 0
        fs, folder = file_system(self.options["progresspath"])
        try:
            with fs.open_input_stream(f"{folder}/given") as f:
                return int(f.read())
        except FileNotFoundError:
            return 0

    def _note(self) -> None:
        fs, folder = file_system(self.options["progresspath"])
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/given.new") as f:
            f.write(str(self.given).encode())
        fs.move(f"{folder}/given.new", f"{folder}/given")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """What waits, at most ``maxMessagesPerTrigger`` after what was given last, in an earlier run too."""
        latest = self.client.latest()
        if not self.step:
            return {"n": latest}
        if (end := min(latest, self.given + self.step)) > self.given:
            self.given = end
            self._note()
        return {"n": self.given}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = max(1, int(self.options.get("partitions", 1)))
        a, b = start["n"], end["n"]
        if b <= a:
            return [_Part(a, a)]
        if hasattr(self.client, "parts"):
            return [_Part(p[0], b, p) for p in self.client.parts(a, b, parts)]
        edges = [a + (b - a) * i // parts for i in range(parts + 1)]
        return [_Part(x, y) for x, y in zip(edges, edges[1:]) if y > x]

    def read(self, partition: _Part) -> Iterator[tuple[int, str]]:
        if partition.end > partition.start:
            bodies = self.client.read(partition.part) if partition.part else self.client.fetch(partition.start, partition.end)
            yield from enumerate(bodies, partition.start)

    def commit(self, end: dict) -> None:
        pass


def _publish(options: dict[str, str], epoch: str, rows: Iterator) -> WriterCommitMessage:
    from pyspark import TaskContext

    client_of(options).publish(f"{options.get('prefix', 'part')}-{epoch}-{TaskContext.get().partitionId():06d}", (r["body"] for r in rows if r["body"] is not None))
    return WriterCommitMessage()


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        return _publish(self.options, "batch", iterator)


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        epoch = TaskContext.get().getLocalProperty("streaming.sql.batchId") or "0"
        return _publish(self.options, f"{int(epoch):09d}", iterator)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        pass

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        pass


class QueueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "surgelight_queue"

    def schema(self) -> str:
        return "seq bigint, body string"

    def streamReader(self, schema):  # noqa: ANN001, ANN201, N802
        return _Reader(plain_options(self.options))

    def writer(self, schema, overwrite):  # noqa: ANN001, ANN201
        return _Writer(plain_options(self.options))

    def streamWriter(self, schema, overwrite):  # noqa: ANN001, ANN201, N802
        return _StreamWriter(plain_options(self.options))


# The process in which Spark plans a Python source knows nothing of shipped packages: the classes above travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
