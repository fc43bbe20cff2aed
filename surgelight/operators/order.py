"""Numbers in arrival order, and the windows that are counted in messages or tokens.

Running numbers and sums are taken in two steps: order is cut into ranges, each range is summed, the sums of earlier ranges
(one row a range) are added up, and only inside a range rows are put in order. Ranges follow the data: where the order column
is neither dense nor evenly filled, or has many equal values, crowded stretches are cut further. No task ever holds more than
about a range, or one row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surgelight.config import Settings

#: Rows of one range, about.
RANGE = 1 << 16
#: Stretches of equal width that are counted before crowded ones are cut further.
STRETCHES = 1 << 12


def _tie(df: DataFrame) -> Column:
    """A number in [0, 1) that puts rows of equal order in an order of their own, made from their columns."""
    plain = [F.col(f"`{f.name}`") for f in df.schema if f.dataType.simpleString().find("map<") < 0]
    return F.pmod(F.xxhash64(*plain), F.lit(1 << 40)) / float(1 << 40)


def _ranged(df: DataFrame, order_col: str, rows: int) -> tuple[DataFrame, int]:
    """Adds ``_r``, which never falls as (order, ``_h``) rises, and ``_h`` for the order among equals; null orders have the lowest ``_r``. Also how many rows there are."""
    order = F.col(order_col).cast("bigint")
    low, high, n, empty = df.agg(F.min(order), F.max(order), F.count(order), F.count(F.lit(1)) - F.count(order)).first()
    width = 1 if low is None else high - low + 1
    if n <= 4 * width and width <= 4 * n and empty <= rows:  # dense: ranges of equal width are evenly filled
        return df.withColumns({"_h": F.lit(0.0), "_r": F.coalesce(F.floor((order - F.lit(low)) / rows), F.lit(-1)) if n else F.lit(-1).cast("bigint")}), n + empty
    step = max(1, -(-width // STRETCHES))
    beyond = order.cast("double") - float(low) if n and width >= 1 << 62 else order - F.lit(low)  # no overflow
    stretch = F.coalesce(F.floor(beyond / float(step)), F.lit(-1)) if n else F.lit(-1).cast("bigint")
    cut = df.withColumns({"_h": _tie(df), "_s": stretch})
    within = cut.groupBy("_s").agg(F.count(F.lit(1)).alias("c"), F.min(order).alias("lo"), F.max(order).alias("hi"))
    crowded = within.where(F.col("c") > rows).collect()  # at most STRETCHES + 1 rows
    if not crowded:
        return cut.withColumn("_r", F.col("_s") * (1 << 31)).drop("_s"), n + empty
    of = lambda r: (r["_s"], -(-r["c"] // rows), r["lo"] or 0, 1 if r["lo"] is None else r["hi"] - r["lo"] + 1)
    parts = df.sparkSession.createDataFrame([of(r) for r in crowded], "_t bigint, _k bigint, _l bigint, _w bigint")
    inside = (F.coalesce((order - F.col("_l")).cast("double"), F.lit(0.0)) + F.col("_h")) / F.col("_w")
    joined = cut.join(F.broadcast(parts), F.col("_s") == F.col("_t"), "left")
    return joined.withColumn("_r", F.col("_s") * (1 << 31) + F.coalesce(F.floor(inside * F.col("_k")), F.lit(0))).drop("_s", "_t", "_k", "_l", "_w"), n + empty


def _summed(df: DataFrame, order_col: str, values: dict[str, Column], rows: int = RANGE) -> tuple[DataFrame, int]:
    """``with_running_sums``, and how many rows there are."""
    inner = {f"_v{i}": F.coalesce(v.cast("bigint"), F.lit(0)) for i, v in enumerate(values.values())}
    cut, total = _ranged(df.withColumns(inner), order_col, rows)
    sums = cut.groupBy(F.col("_r").alias("_q")).agg(*(F.sum(v).alias(v.replace("v", "s")) for v in inner))
    before = Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = sums.select("_q", *(F.coalesce(F.sum(v.replace("v", "s")).over(before), F.lit(0)).alias(v.replace("v", "o")) for v in inner))
    inside = Window.partitionBy("_r").orderBy(F.col(order_col).asc_nulls_first(), "_h").rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(offsets, F.col("_r") == F.col("_q"))
    out = joined.withColumns({name: F.col(v.replace("v", "o")) + F.sum(v).over(inside) for name, v in zip(values, inner)})
    return out.drop("_r", "_h", "_q", *inner, *(v.replace("v", "o") for v in inner)), total


def with_running_sums(df: DataFrame, order_col: str, values: dict[str, Column], rows: int = RANGE) -> DataFrame:
    """Adds for each name the sum of its value over all rows up to and with this one, in ascending order of the integer ``order_col``.

    Rows of equal order are taken in any order, the same for all sums; null orders come first, null values count 0.
    """
    return _summed(df, order_col, values, rows)[0]


def with_running_sum(df: DataFrame, order_col: str, value: Column, name: str, rows: int = RANGE) -> DataFrame:
    """``with_running_sums`` of one value."""
    return with_running_sums(df, order_col, {name: value}, rows)


def with_ordinal(df: DataFrame, order_col: str = "seq", name: str = "ordinal") -> DataFrame:
    """Adds ``name``: 1, 2, 3 ... in order of ``order_col``."""
    return with_running_sum(df, order_col, F.lit(1), name)


def with_batch(df: DataFrame, settings: Settings, order_col: str = "seq", **sums: Column) -> DataFrame:
    """Adds ``batch``, from 0: every ``settings.batch`` messages make one; an incomplete last batch is null. Further running sums by name come in the same pass."""
    numbered, total = _summed(df, order_col, {"_n": F.lit(1), **sums})
    batch = F.floor((F.col("_n") - 1) / settings.batch)
    return numbered.withColumn("batch", F.when(batch < total // settings.batch, batch)).drop("_n")


def with_file(df: DataFrame, settings: Settings, order_col: str = "seq", tokens_col: str = "tokens") -> DataFrame:
    """One row for each token: (order, token, ``file_no``), files holding ``settings.file_tokens`` tokens each, from 0."""
    lean = df.select(F.col(order_col).alias("seq"), F.filter(tokens_col, lambda t: t.isNotNull() & (t != "")).alias("t"))
    numbered = with_running_sum(lean, "seq", F.size("t"), "_n")
    rows = numbered.select("seq", "_n", F.size("t").alias("_k"), F.posexplode("t").alias("pos", "token"))
    return rows.select("seq", "pos", "token", F.floor((F.col("_n") - F.col("_k") + F.col("pos")) / settings.file_tokens).alias("file_no"))


def recent(df: DataFrame, settings: Settings, order_col: str = "seq") -> DataFrame:
    """The last ``window_batches * batch`` messages."""
    numbered, total = _summed(df, order_col, {"_n": F.lit(1)})
    return numbered.where(F.col("_n") > total - settings.window_batches * settings.batch).drop("_n")


def rebuild_count(files: int, settings: Settings) -> int:
    """How many rebuilds are done when ``files`` files are complete: the first when the window is full, then one every ``rebuild_every_files`` files."""
    over = files - settings.token_persist_files
    return 0 if over < 0 else over // max(1, settings.rebuild_every_files) + 1


def window_counts(file_counts: DataFrame, settings: Settings, files: int) -> DataFrame:
    """(rebuild, token, n): token counts that each rebuild uses, from (file_no, token, n) of ``files`` complete files.

    ``rebuild`` is the number of files complete by then: with N files a window and every E files, N, N + E, N + 2E ...
    In "sliding" mode the counts are those of the last N files. In "as_coded" mode they are what is left when, since the
    rebuild before, every new file is counted and the file that leaves the window is taken out, a token's count never falling
    below 0. Each row works out by itself which rebuilds it belongs to (about N / E of them).
    """
    n, e = settings.token_persist_files, max(1, settings.rebuild_every_files)
    file = F.col("file_no")
    if settings.window_mode == "sliding":
        first, last = F.greatest(F.lit(0), F.floor((file - n) / e) + 1), F.floor(file / e)
        rows = file_counts.where(first <= last).withColumn("_k", F.explode(F.sequence(first, last))).withColumn("rebuild", n + F.col("_k") * e)
        return rows.where(F.col("rebuild") <= files).groupBy("rebuild", "token").agg(F.sum("n").alias("n"))
    added = F.struct(F.when(file < n, F.lit(n)).otherwise(n + (F.floor((file - n) / e) + 1) * e).cast("bigint").alias("rebuild"), file.cast("bigint").alias("step"), F.col("n").alias("d"))
    gone = F.struct((n + (F.floor(file / e) + 1) * e).cast("bigint").alias("rebuild"), (file + n).cast("bigint").alias("step"), (-F.col("n")).alias("d"))
    moves = file_counts.select("token", F.inline(F.array(added, gone))).where(F.col("rebuild") <= files).groupBy("rebuild", "token", "step").agg(F.sum("d").alias("d"))
    steps = Window.partitionBy("rebuild", "token").orderBy("step")  # at most one row for each file between two rebuilds
    summed = moves.withColumn("s", F.sum("d").over(steps.rowsBetween(Window.unboundedPreceding, 0)))
    least = summed.groupBy("rebuild", "token").agg(F.min("s").alias("least"), F.max_by("s", "step").alias("last"))
    return least.select("rebuild", "token", (F.col("last") - F.least(F.lit(0), F.col("least"))).alias("n")).where("n > 0")


def rebuild_of_batch(batch_files: DataFrame, settings: Settings, warm: bool = False) -> DataFrame:
    """(batch, rebuild): the last rebuild done when a batch begins, from (batch, first_file); batches before any are left out.

    After a ``warm`` start there is a rebuild 0 from saved counts, which serves the batches before the first regular one.
    """
    n, e = settings.token_persist_files, max(1, settings.rebuild_every_files)
    file = F.col("first_file")
    rebuild = F.when(file >= n, (n + F.floor((file - n) / e) * e).cast("bigint"))
    if warm:
        return batch_files.select("batch", F.coalesce(rebuild, F.lit(0).cast("bigint")).alias("rebuild"))
    return batch_files.where(file >= n).select("batch", rebuild.alias("rebuild"))
