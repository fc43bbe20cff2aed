"""Frequency of every distinct term in a vertical layout: a compressed bitmap of record numbers for each term.

Every input partition numbers its records and cuts them into chunks of 65,536. For each chunk and term it builds
containers of the record numbers inside the chunk (sorted 16-bit numbers while at most 4,096 records have the term, a bitmap of
65,536 bits beyond) and, beside them, counts occurrences. It builds them as soon as a bounded number of tokens is held, so
a chunk of long records has several containers for a term. Containers of one term and chunk are then brought together and
merged by union, and document frequency is read from the cardinalities of the merged ones and summed by term. A term that
a third of all records have is spread by blocks of chunks; no task needs more than one block of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surgelight.session import map_arrow

CHUNK = 1 << 16
#: A sorted list of 16-bit numbers is smaller than the bitmap up to so many records.
SPARSE = 4096
BITMAP_BYTES = CHUNK // 8
#: Tokens held before containers are built.
HELD = 1 << 21
#: Chunks of a term that are brought to one task together: 2 ** BLOCK_BITS.
BLOCK_BITS = 6


def pack(records: np.ndarray) -> bytes:
    """Container of sorted distinct record numbers below 65,536."""
    if len(records) <= SPARSE:
        return records.astype("<u2").tobytes()
    bits = np.zeros(CHUNK, np.uint8)
    bits[records] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(container: bytes, dense: bool) -> np.ndarray:
    if dense:
        return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8), bitorder="little")).astype(np.uint16)
    return np.frombuffer(container, "<u2")


def union(a: bytes, a_dense: bool, b: bytes, b_dense: bool) -> tuple[bytes, bool]:
    """The container of the records in either, and whether it is a bitmap."""
    records = np.union1d(unpack(a, a_dense), unpack(b, b_dense))
    return pack(records), len(records) > SPARSE


def cardinality(container: bytes, dense: bool) -> int:
    return int(np.bitwise_count(np.frombuffer(container, np.uint8)).sum()) if dense else len(container) // 2


class _Chunk:
    """The records of one chunk, as (term, record) pairs of each batch."""

    def __init__(self, number: int):
        self.number, self.rows, self.held = number, 0, 0
        self.terms: list[pa.Array] = []
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, lists: pa.Array) -> None:
        values = lists.flatten()
        owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        words = values.dictionary_encode()
        keep = words.indices.is_valid().to_numpy(zero_copy_only=False)
        codes = pc.fill_null(words.indices, 0).to_numpy(zero_copy_only=False)
        self.terms.append(words.dictionary.cast(pa.large_string()))
        self.pairs.append((codes[keep].astype(np.int64), owner[keep].astype(np.int64) + self.rows))
        self.rows += len(lists)
        self.held += len(codes)

    def bitmaps(self) -> Iterator[pa.RecordBatch]:
        """Containers of what is held; the chunk may go on after them."""
        if not self.terms:
            return
        terms, pairs = self.terms, self.pairs
        self.terms, self.pairs, self.held = [], [], 0
        together = pa.chunked_array(terms).combine_chunks().dictionary_encode()
        to = together.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum([0, *map(len, terms)])
        codes = np.concatenate([to[s : s + len(t)][c] for (c, _), s, t in zip(pairs, starts, terms)])
        records = np.concatenate([r for _, r in pairs])
        if not len(codes):
            return
        both = np.sort(codes * CHUNK + records)
        first = np.flatnonzero(np.diff(both, prepend=-1))
        distinct = both[first]
        term, record = distinct >> 16, (distinct & (CHUNK - 1)).astype(np.uint16)
        begin = np.flatnonzero(np.diff(term, prepend=-1))
        end = np.append(begin[1:], len(term))
        occurrences = np.diff(np.append(first[begin], len(both)))
        size = end - begin
        dense = size > SPARSE
        words = together.dictionary.take(pa.array(term[begin])).cast(pa.string())
        for at in range(0, len(begin), 1 << 14):
            part = slice(at, at + (1 << 14))
            boxes = [pack(record[a:b]) for a, b in zip(begin[part], end[part])]
            n = len(boxes)
            yield pa.RecordBatch.from_arrays(
                [words.slice(at, n), pa.array(np.full(n, self.number), pa.int64()), pa.array(boxes, pa.binary()), pa.array(dense[part]), pa.array(occurrences[part], pa.int64())],
                names=["term", "chunk", "records", "dense", "occurrences"],
            )


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    chunk = _Chunk(number)
    for batch in batches:
        lists = batch.column(0)
        upto = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(lists):
            before = upto[at - 1] if at else 0
            fits = int(np.searchsorted(upto, before + HELD - chunk.held, side="right")) - at
            take = max(1, min(CHUNK - chunk.rows, len(lists) - at, fits))
            chunk.add(lists.slice(at, take))
            at += take
            if chunk.rows == CHUNK or chunk.held >= HELD or at < len(lists):
                yield from chunk.bitmaps()
            if chunk.rows == CHUNK:
                number += 1
                chunk = _Chunk(number)
    yield from chunk.bitmaps()


def term_bitmaps(df: DataFrame, terms_col: str = "tokens") -> DataFrame:
    """(term, chunk, records, dense, occurrences): for each term and chunk of records one compressed container, or several to be merged.

    Every row of ``df`` is a record, repeated rows too. Null lists, empty lists, null and empty terms hold nothing.
    Terms are compared exactly as stored. Only ``terms_col`` is read.
    """
    schema = T.StructType(
        [T.StructField("term", T.StringType()), T.StructField("chunk", T.LongType()), T.StructField("records", T.BinaryType()), T.StructField("dense", T.BooleanType()), T.StructField("occurrences", T.LongType())]
    )
    return map_arrow(df.select(F.col(f"`{terms_col}`").alias("t")), _build, schema).where("term <> ''")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by term and chunk: (term, occurrences, records) of each merged container."""
    last: list | None = None  # term, chunk, container, dense, occurrences of the group that may go on

    def rows(groups: list[list]) -> pa.RecordBatch:
        terms, _, boxes, dense, occurrences = zip(*groups)
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(occurrences, pa.int64()), pa.array([cardinality(c, d) for c, d in zip(boxes, dense)], pa.int64())], names=["term", "occurrences", "records"])

    for batch in batches:
        done: list[list] = []
        for group in zip(*(c.to_pylist() for c in batch.columns)):
            if last is not None and last[1] == group[1] and last[0] == group[0]:
                last[2], last[3] = union(last[2], last[3], group[2], group[3])
                last[4] += group[4]
            else:
                if last is not None:
                    done.append(last)
                last = list(group)
        if done:
            yield rows(done)
    if last is not None:
        yield rows([last])


def term_frequencies(df: DataFrame, terms_col: str = "tokens") -> DataFrame:
    """(term, occurrences, records) of every distinct term; no row for an empty table."""
    boxes = term_bitmaps(df, terms_col)
    met = boxes.repartition("term", F.shiftright("chunk", BLOCK_BITS)).sortWithinPartitions("term", "chunk").select("term", "chunk", "records", "dense", "occurrences")
    merged = map_arrow(met, _merge, "term string, occurrences bigint, records bigint")
    return merged.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(df: DataFrame, terms_col: str = "tokens", min_records: int = 3, max_share: float = 0.05) -> DataFrame:
    """``term_frequencies`` with ``mark``: ``rare`` in fewer than ``min_records`` records, ``common`` in more than ``max_share`` of all rows, else null.

    A term that is both (in a very small table) is marked rare.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    out = term_frequencies(df, terms_col)
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") > F.lit(max_share) * total, "common")
    return out.select("term", "occurrences", "records", mark.alias("mark"))
