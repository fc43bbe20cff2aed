"""Busy words: in each batch and class, words whose three key positions are all hit unusually often.

Counts are hashed: every token hits one position of three arrays of its class. A position is hot if its count lies ``z_score``
standard deviations above the mean of all positions, empty ones included. A word is busy if all three of its positions are hot
and the word was known by the end of the batch. Instead of trying all triples of hot positions, the dictionary is
joined with the hot pairs of the first and second array and checked against the third, which gives the same words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surgelight.config import Settings
from surgelight.functions.keys import key_parts


def batch_counts(df: DataFrame, order_col: str = "seq", tokens_col: str = "tokens") -> DataFrame:
    """(batch, token, n, first_seq) from rows with ``batch``; rows of an incomplete batch keep a null batch, as they add to the dictionary."""
    rows = df.select("batch", F.col(order_col).alias("seq"), F.explode(tokens_col).alias("token")).where("token <> ''")
    return rows.groupBy("batch", "token").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def dictionary(counts: DataFrame, settings: Settings) -> DataFrame:
    """(token, p1, p2, p3, first_batch, first_seq) of every token that occurs."""
    first = counts.groupBy("token").agg(F.min(F.coalesce("batch", F.lit((1 << 62)))).alias("first_batch"), F.min("first_seq").alias("first_seq"))
    return keyed_words(first, settings)


def keyed_words(first: DataFrame, settings: Settings) -> DataFrame:
    """The dictionary from (token, first_batch, first_seq)."""
    return first.select("token", *key_parts(F.col("token"), settings.bw_array_len), "first_batch", "first_seq")


def key_owners(words: DataFrame) -> DataFrame:
    """(p1, p2, p3, token): of tokens with equal keys, the one seen first last."""
    latest = Window.partitionBy("p1", "p2", "p3").orderBy(F.desc("first_seq"), F.desc("token"))
    return words.withColumn("_r", F.row_number().over(latest)).where("_r = 1").select("p1", "p2", "p3", "token")


def with_class(counts: DataFrame, classes: DataFrame, settings: Settings, schedule: DataFrame | None = None) -> DataFrame:
    """(batch, class, token, n) of complete batches; ``schedule`` (batch, rebuild) picks the classes of each batch."""
    live = counts.where("batch IS NOT NULL")
    how = "left" if settings.unknown_tokens == "least_frequent" else "inner"
    if schedule is None:
        out = live.join(classes.select("token", "class"), "token", how)
    else:
        out = live.join(schedule, "batch").join(classes.select("rebuild", "token", "class"), ["rebuild", "token"], how)
    return out.select("batch", F.coalesce("class", F.lit(settings.freq_classes - 1)).alias("class"), "token", "n")


def counters(classed: DataFrame, settings: Settings) -> DataFrame:
    """(batch, class, part, pos, c): the counters that are not 0, of the classes that are not skipped.

    Rows are brought together by array (batch, class, part), which holds at most the tokens of a batch: the sums by position and
    all that is asked of whole arrays later need no further shuffle.
    """
    keyed = classed.where(~F.col("class").isin(list(settings.skip_frequency_classes))) if settings.skip_frequency_classes else classed
    parts = F.array(*(F.struct(F.lit(k).alias("part"), p.alias("pos")) for k, p in enumerate(key_parts(F.col("token"), settings.bw_array_len), 1)))
    return keyed.select("batch", "class", "n", F.inline(parts)).repartition("batch", "class", "part").groupBy("batch", "class", "part", "pos").agg(F.sum("n").alias("c"))


def counter_stats(cells: DataFrame, settings: Settings) -> DataFrame:
    """(batch, class, part, total, mean, sd, min_z, max_z) over all positions; the standard deviation is that of the population.

    From the sum and the sum of squares, both whole numbers, so that the order of addition does not matter.
    """
    size = settings.bw_array_len
    s = cells.groupBy("batch", "class", "part").agg(F.sum("c").alias("total"), F.sum(F.col("c") * F.col("c")).alias("q"), F.count(F.lit(1)).alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    sd = F.sqrt((F.col("q") * size - F.col("total") * F.col("total")).cast("double")) / size
    out = s.withColumns({"mean": F.col("total") / size, "sd": sd, "lo": F.when(F.col("k") < size, F.lit(0)).otherwise(F.col("lo"))})
    z = lambda c: F.when(F.col("sd") > 0, (F.col(c) - F.col("mean")) / F.col("sd"))
    return out.select("batch", "class", "part", "total", "mean", "sd", z("lo").alias("min_z"), z("hi").alias("max_z"))


def hot_positions(cells: DataFrame, settings: Settings) -> DataFrame:
    """(batch, class, part, pos, c): positions at or above the threshold; none where all counters are equal.

    Empty positions can be hot only for thresholds of 0 or less; only then all positions are written out.
    """
    size = settings.bw_array_len
    if settings.z_score <= 0:
        stats = counter_stats(cells, settings).select("batch", "class", "part", "mean", "sd").where("sd > 0")
        grid = stats.select("batch", "class", "part", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("pos"))
        joined = grid.join(cells, ["batch", "class", "part", "pos"], "left").withColumn("c", F.coalesce("c", F.lit(0))).join(stats, ["batch", "class", "part"])
    else:
        array = Window.partitionBy("batch", "class", "part")  # at most bw_array_len rows
        sums = cells.withColumns({"_t": F.sum("c").over(array), "_q": F.sum(F.col("c") * F.col("c")).over(array)})
        sd = F.sqrt((F.col("_q") * size - F.col("_t") * F.col("_t")).cast("double")) / size
        joined = sums.withColumns({"mean": F.col("_t") / size, "sd": sd}).where("sd > 0")
    return joined.where((F.col("c") - F.col("mean")) / F.col("sd") >= settings.z_score).select("batch", "class", "part", "pos", "c")


def words_at(hot: DataFrame, words: DataFrame, z_score: float = 3.5) -> DataFrame:
    """(batch, class, token): dictionary words known by the end of the batch, all three positions hot; of words with equal keys the one seen first last.

    The hot positions of a batch and class are three short arrays: at a threshold z at most 1 / (1 + z * z) of all positions
    lie above it. The pairs of its first and second positions meet the dictionary on both parts of the key at once, and the
    third is looked up in the array inside the join. So what is shuffled is the dictionary once and the hot pairs, whatever
    the number of words; the join has as many keys as there are pairs of positions. Low thresholds, where the arrays may
    be long, meet on the first part alone.
    """
    listed = lambda k: F.collect_list(F.when(F.col("part") == k, F.col("pos"))).alias(f"h{k}")
    groups = hot.groupBy("batch", "class").agg(listed(1), listed(2), listed(3)).where((F.size("h1") > 0) & (F.size("h2") > 0) & (F.size("h3") > 0))
    fits = (F.col("first_batch") <= F.col("batch")) & F.array_contains("h3", F.col("p3"))
    if z_score >= 2:
        pairs = groups.select("batch", "class", "h3", F.explode("h1").alias("p1"), "h2").select("batch", "class", "h3", "p1", F.explode("h2").alias("p2"))
        found = words.join(pairs, ["p1", "p2"]).where(fits)
    else:
        found = words.join(groups.select("batch", "class", "h2", "h3", F.explode("h1").alias("p1")), "p1").where(fits & F.array_contains("h2", F.col("p2")))
    latest = Window.partitionBy("batch", "class", "p1", "p2", "p3").orderBy(F.desc("first_seq"), F.desc("token"))
    return found.withColumn("_r", F.row_number().over(latest)).where("_r = 1").select("batch", "class", "token")


def busy_words(counts: DataFrame, classes: DataFrame, settings: Settings, schedule: DataFrame | None = None) -> DataFrame:
    """(batch, class, token) from ``batch_counts`` and frequency classes."""
    cells = counters(with_class(counts, classes, settings, schedule), settings)
    return words_at(hot_positions(cells, settings), dictionary(counts, settings), settings.z_score)


def summary(busy: DataFrame) -> DataFrame:
    """(batch, class, words, list) of every batch and class with a busy word."""
    return busy.groupBy("batch", "class").agg(F.count(F.lit(1)).alias("words"), F.array_join(F.array_sort(F.collect_list("token")), ",").alias("list"))


def summary_lines(busy: DataFrame) -> DataFrame:
    """(batch, line): one printable line for each batch with a busy word."""
    by_class = summary(busy).select("batch", F.struct("class", "words", "list").alias("c"))
    rows = by_class.groupBy("batch").agg(F.sum("c.words").alias("n"), F.array_sort(F.collect_list("c")).alias("cs"))
    shown = F.array_join(F.transform("cs", lambda c: F.concat(F.lit("class "), c["class"].cast("string"), F.lit(": "), c["list"])), "; ")
    return rows.select("batch", F.format_string("batch %d: %d busy words in %d classes; %s", "batch", "n", F.size("cs"), shown).alias("line"))


def result_rows(busy: DataFrame, batches: DataFrame, settings: Settings) -> DataFrame:
    """(Batch, Class, Tokens): a row for every batch and class, also for those without words and for skipped classes."""
    grid = batches.select("batch").distinct().select("batch", F.explode(F.sequence(F.lit(0), F.lit(settings.freq_classes - 1))).alias("class"))
    return grid.join(summary(busy), ["batch", "class"], "left").select(F.col("batch").alias("Batch"), F.col("class").alias("Class"), F.coalesce("list", F.lit("")).alias("Tokens"))


def messages_with(df: DataFrame, busy: DataFrame, least: int = 2, order_col: str = "seq", tokens_col: str = "tokens") -> DataFrame:
    """(seq, batch, words): messages with at least ``least`` busy words of their batch. An addition without a counterpart in the described engine."""
    rows = df.select(F.col(order_col).alias("seq"), "batch", F.explode(F.array_distinct(tokens_col)).alias("token"))
    hits = rows.join(busy.select("batch", "token").distinct(), ["batch", "token"])
    words = hits.groupBy("seq", "batch").agg(F.array_join(F.array_sort(F.collect_list("token")), ",").alias("words"), F.count(F.lit(1)).alias("_n"))
    return words.where(F.col("_n") >= least).drop("_n")


def clusters(messages: DataFrame) -> DataFrame:
    """(batch, words, messages): messages that share the same set of busy words."""
    return messages.groupBy("batch", "words").agg(F.count(F.lit(1)).alias("messages"))
