"""Exactly one copy of every message: exact quotient hash tables over fixed-width identifiers.

An identifier of up to 18 digits becomes a 64-bit number, which an invertible mix permutes. The high bits of the permuted
number are the quotient: they pick the shard, a range of quotients that one task holds, and the home run in its table. The
low bits, the remainder, are stored complete; the quotient is not stored, it follows from the run. As the mix is a
permutation, run and remainder together are the identifier: no two identifiers can be confused.

Two passes. The first works inside each input partition, before any shuffle: it settles every local repetition, so that
an identifier that holds a third of all rows reaches its shard with at most one row per input partition. Only rows whose
answer is still open are shuffled when repetitions are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surgelight.session import map_arrow, shuffle_partitions

#: Digits that fit the 64-bit form; a leading 1 keeps leading zeros apart.
FIXED_DIGITS = 18
_MIX = ((32, 0x9E3779B97F4A7C15), (29, 0xBF58476D1CE4E5B9))


def permute(keys: np.ndarray) -> np.ndarray:
    """An invertible mix of 64-bit numbers (xor-shifts and odd multipliers)."""
    k = keys.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        for shift, odd in _MIX:
            k ^= k >> np.uint64(shift)
            k *= np.uint64(odd)
        k ^= k >> np.uint64(32)
    return k


def restored(keys: np.ndarray) -> np.ndarray:
    """What ``permute`` was given."""

    def unshifted(k: np.ndarray, shift: int) -> np.ndarray:
        out = k
        for _ in range(64 // shift):
            out = k ^ (out >> np.uint64(shift))
        return out

    k = unshifted(keys.astype(np.uint64, copy=True), 32)
    with np.errstate(over="ignore"):
        for shift, odd in reversed(_MIX):
            k = unshifted(k * np.uint64(pow(odd, -1, 1 << 64)), shift)
    return k


class _Level:
    """A static table: the remainders of all its members, in runs by quotient. ``starts`` has the place of each run."""

    def __init__(self, members: np.ndarray, low: int, size: int):
        """``members`` are sorted permuted numbers of the shard of ``size`` numbers from ``low``."""
        self.n = len(members)
        bits = max(4, int(self.n).bit_length())  # about one member a run; every doubling moves one bit to the quotient
        self.cut = max(0, size.bit_length() - bits)  # bits of the remainder
        offsets = members - np.uint64(low)
        runs = (offsets >> np.uint64(self.cut)).astype(np.int64)
        kind = np.uint32 if self.cut <= 32 else np.uint64
        self.remainders = (offsets & np.uint64((1 << self.cut) - 1)).astype(kind)
        self.starts = np.searchsorted(runs, np.arange((size >> self.cut) + 2)).astype(np.int32 if self.n < 1 << 31 else np.int64)
        self.low = low

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which of the permuted numbers are members: each run is walked, all keys at once."""
        offsets = keys - np.uint64(self.low)
        run = (offsets >> np.uint64(self.cut)).astype(np.int64)
        remainder = (offsets & np.uint64((1 << self.cut) - 1)).astype(self.remainders.dtype)
        at, end = self.starts[run].copy(), self.starts[run + 1]
        found = np.zeros(len(keys), bool)
        todo = np.flatnonzero(at < end)
        while len(todo):
            found[todo] = self.remainders[at[todo]] == remainder[todo]
            at[todo] += 1
            todo = todo[~found[todo] & (at[todo] < end[todo])]
        return found

    def members(self) -> np.ndarray:
        """The permuted numbers again, from run and remainder, in order."""
        run = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        return (run.astype(np.uint64) << np.uint64(self.cut)) + self.remainders.astype(np.uint64) + np.uint64(self.low)


class QuotientTable:
    """The set of identifiers of one shard. New members go to a small level; levels of like size are merged, so a member moves few times."""

    def __init__(self, low: int = 0, high: int = 1 << 64):
        self.low, self.size = low, high - low
        self.levels: list[_Level] = []
        self.wide: set[str] = set()

    @property
    def n(self) -> int:
        return sum(x.n for x in self.levels)

    def insert_permuted(self, keys: np.ndarray) -> np.ndarray:
        """Inserts permuted numbers in their order; True where the number was not a member yet."""
        distinct, first = np.unique(keys, return_index=True)
        new = np.ones(len(distinct), bool)
        for level in self.levels:
            new[new] = ~level.has(distinct[new])
        fresh = distinct[new]
        if len(fresh):
            while self.levels and self.levels[-1].n <= 2 * len(fresh):
                fresh = np.sort(np.concatenate([fresh, self.levels.pop().members()]), kind="stable")
            self.levels.append(_Level(fresh, self.low, self.size))
        out = np.zeros(len(keys), bool)
        out[first[new]] = True
        return out

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Inserts 64-bit identifiers in their order; True where the identifier was not known yet."""
        return self.insert_permuted(permute(keys))

    def insert_wide(self, ids: list[str]) -> np.ndarray:
        """Identifiers beyond the fixed width are kept whole."""
        out = np.zeros(len(ids), bool)
        for i, x in enumerate(ids):
            out[i] = x not in self.wide
            self.wide.add(x)
        return out


def _shard_of(permuted: np.ndarray, shards: int) -> np.ndarray:
    """The shard by the highest bits: equal ranges of quotients."""
    return ((permuted >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _bounds(shard: int, shards: int) -> tuple[int, int]:
    """The permuted numbers of a shard."""
    edge = lambda s: (-(-(s << 32) // shards)) << 32
    return edge(shard), edge(shard + 1)


def _settle_locally(shards: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = QuotientTable()
        for batch in batches:
            keys, wide = batch.column("_k"), batch.column("_w")
            fixed, other = np.asarray(keys.is_valid()), np.asarray(wide.is_valid())
            first, shard = np.zeros(batch.num_rows, bool), np.arange(batch.num_rows, dtype=np.int32) % shards
            permuted = np.zeros(batch.num_rows, np.uint64)
            if fixed.any():
                permuted[fixed] = permute(np.asarray(keys.drop_null()).astype(np.int64))
                first[fixed] = table.insert_permuted(permuted[fixed])
                shard[fixed] = _shard_of(permuted[fixed], shards)
            if other.any():
                first[other] = table.insert_wide(wide.drop_null().to_pylist())
                shard[other] = np.asarray(batch.column("_s"))[other]
            columns, names = list(batch.columns), batch.schema.names
            columns[names.index("_k")] = pa.array(permuted.view(np.int64), mask=~fixed)
            columns[names.index("_s")] = pa.array(shard)
            columns[names.index("_d")] = pa.array((fixed | other) & ~first)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def _settle_shard(shards: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, QuotientTable] = {}
        for batch in batches:
            keys, wide = batch.column("_k"), batch.column("_w")
            settled = np.asarray(batch.column("_d")).astype(bool)
            fixed, other = np.asarray(keys.is_valid()) & ~settled, np.asarray(wide.is_valid()) & ~settled
            shard = np.asarray(batch.column("_s"))
            repeat = settled.copy()
            for s in np.unique(shard[fixed | other]).tolist():
                table = tables.setdefault(s, QuotientTable(*_bounds(s, shards)))
                if (own := fixed & (shard == s)).any():
                    repeat[own] = ~table.insert_permuted(np.asarray(keys.filter(pa.array(own))).astype(np.int64).view(np.uint64))
                if (own := other & (shard == s)).any():
                    repeat[own] = ~table.insert_wide(wide.filter(pa.array(own)).to_pylist())
            columns = list(batch.columns)
            columns[batch.schema.names.index("_d")] = pa.array(repeat)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def _settled_locally(df: DataFrame, id_col: str, order_col: str, shards: int) -> tuple[DataFrame, dict[str, str]]:
    """``df`` after the first pass, and the inner name of each column: ``_k`` permuted number, ``_w`` wide identifier, ``_s`` shard, ``_d`` settled."""
    names = [c for c in df.columns if c != "is_repeat"]
    at = {n: f"c{i}" for i, n in enumerate(names)}
    digits = F.regexp_replace(F.col(at[id_col]).cast("string"), "[^0-9]", "")
    keyed = df.select(*(F.col(f"`{n}`").alias(i) for n, i in at.items())).withColumn("_x", F.when(F.length(digits) > 0, digits))
    short = F.length("_x") <= FIXED_DIGITS
    keyed = keyed.withColumns({"_k": F.when(short, F.concat(F.lit("1"), "_x")).cast("bigint"), "_w": F.when(~short, F.col("_x"))}).drop("_x")
    keyed = keyed.withColumns({"_s": F.pmod(F.xxhash64("_w"), F.lit(shards)).cast("int"), "_d": F.lit(False)})
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in keyed.schema])
    return map_arrow(keyed.sortWithinPartitions(F.col(at[order_col]).asc_nulls_last()), _settle_locally(shards), schema), at


def _by_shard(local: DataFrame, order: str, shards: int) -> DataFrame:
    """The second pass over rows of the first."""
    sorted_shards = local.repartitionById(shards, "_s").sortWithinPartitions(F.col(order).asc_nulls_last())
    return map_arrow(sorted_shards, _settle_shard(shards), local.schema)


def mark_repeats(df: DataFrame, id_col: str = "id_str", order_col: str = "seq", only_first: bool = False) -> DataFrame:
    """All rows of ``df`` with a boolean column ``is_repeat``: False for the first row (lowest ``order_col``) of each identifier.

    The identifier is the string of digits in ``id_col``; leading zeros count. Rows whose ``id_col`` is null, or holds
    no digit at all, have no identifier and are never repetitions. A null ``order_col`` comes after all others; of rows
    with equal ``order_col`` exactly one is the first. Other columns pass through; a column of the input that is called
    ``is_repeat`` is replaced. With ``only_first`` repetitions already settled inside an input partition are dropped
    before the shuffle (the caller keeps first rows only). An empty table gives an empty table.
    """
    shards = shuffle_partitions(df.sparkSession)
    local, at = _settled_locally(df, id_col, order_col, shards)
    if only_first:
        local = local.where(~F.col("_d"))
    return _by_shard(local, at[order_col], shards).select(*(F.col(i).alias(n) for n, i in at.items()), F.col("_d").alias("is_repeat"))


def first_deliveries(df: DataFrame, id_col: str = "id_str", order_col: str = "seq") -> DataFrame:
    """``df`` with exactly one row, the first, for each identifier; rows without an identifier all stay."""
    return mark_repeats(df, id_col, order_col, only_first=True).where(~F.col("is_repeat")).drop("is_repeat")


def repeated_deliveries(df: DataFrame, id_col: str = "id_str", order_col: str = "seq") -> DataFrame:
    """The ``order_col`` of every row that is not the first of its identifier.

    Rows settled inside their input partition, and rows without an identifier, are not shuffled. The first pass is run once for
    the settled rows and once for the open ones: two columns read again cost less than the shuffle of a settled hot identifier.
    """
    shards = shuffle_partitions(df.sparkSession)
    local, at = _settled_locally(df.select(order_col, id_col), id_col, order_col, shards)
    order = at[order_col]
    settled = local.where("_d").select(order)
    still = local.where("NOT _d AND (_k IS NOT NULL OR _w IS NOT NULL)").select(order, "_k", "_w", "_s", "_d")
    return settled.union(_by_shard(still, order, shards).where("_d").select(order)).toDF(order_col)
