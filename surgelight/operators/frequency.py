"""Token counts, and frequency classes of nearly equal total use.

The class of a token is defined by a walk down the counts (ties by token): a token opens the next class when the use so
far has reached that class's share, at most one class a token. For row i with the use R before it and the share C of a class,
``t = min(F - 1, floor(R / C))`` and the class is ``i + min(0, min over j <= i of (t_j - j))``; from row 2F on it is t itself.

R comes from a histogram: one row for each distinct count, with the tokens and the use before it. Only tokens whose count
straddles a class boundary (at most F counts) and the first 2F rows need their place inside their count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surgelight.operators.order import with_ordinal


def token_rows(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(token) for each occurrence; null and empty tokens are left out."""
    return df.select(F.explode(tokens_col).alias("token")).where("token <> ''")


def token_counts(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(token, n) of all occurrences."""
    return token_rows(df, tokens_col).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def bulk_counts(saved: DataFrame) -> DataFrame:
    """Saved counts as a table with one row for each token: null and empty tokens and counts of 0 or less are left out, repeated rows count once with the largest value."""
    return saved.where("token <> '' AND n > 0").groupBy("token").agg(F.max("n").alias("n"))


def updated_counts(counts: DataFrame, added: DataFrame, expired: DataFrame) -> DataFrame:
    """Counts after adding and taking out occurrences (tables with ``token``); tokens at 0 or below disappear."""
    up = added.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    down = expired.groupBy("token").agg((-F.count(F.lit(1))).alias("n"))
    return counts.unionByName(up).unionByName(down).groupBy("token").agg(F.sum("n").alias("n")).where("n > 0")


def totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"), F.count(F.lit(1)).alias("distinct_tokens"))


def frequency_classes(counts: DataFrame, classes: int, min_count: int = 0, by: str | None = None) -> DataFrame:
    """(token, n, class) from (token, n); ``classes`` of 0 or less counts as 1, tokens below ``min_count`` are left out.

    With ``by`` (a column, such as the rebuild) every value has classes of its own, and the column is kept.
    """
    f = max(1, classes)
    group = by or "_g"
    rows = counts.select(*([F.col(by)] if by else [F.lit(0).alias("_g")]), "token", F.col("n").cast("bigint").alias("n"))
    if min_count > 0:
        rows = rows.where(F.col("n") >= min_count)
    histogram = rows.groupBy(group, "n").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy(group).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)  # distinct counts only
    whole = Window.partitionBy(group)
    places = histogram.select(
        group,
        "n",
        "k",
        F.coalesce(F.sum("k").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(F.col("k") * F.col("n")).over(before), F.lit(0)).alias("use_before"),
        F.floor(F.sum(F.col("k") * F.col("n")).over(whole) / f).alias("share"),
    )
    reach = lambda use: F.when(F.col("share") == 0, f - 1).otherwise(F.least(F.lit(f - 1), F.floor(use / F.col("share"))))
    places = places.withColumn("t", reach(F.col("use_before"))).withColumn(
        "split", (F.col("t") != reach(F.col("use_before") + (F.col("k") - 1) * F.col("n"))) | (F.col("rows_before") < 2 * f)
    )
    joined = rows.join(places, [group, "n"])
    plain = joined.where(~F.col("split")).select(group, "token", "n", F.col("t").alias("class"))
    # places inside a count: prefixes of the token are numbered first; tokens inside a prefix only where a boundary, or one
    # of the first 2F places, lies inside it
    split = joined.where("split").withColumn("_p", F.substring("token", 1, 3))
    prefixes = split.groupBy(group, "n", "_p").agg(F.count(F.lit(1)).alias("c"))
    earlier = Window.partitionBy(group, "n").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # distinct prefixes only
    prefixes = prefixes.select(group, "n", "_p", "c", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("o"))
    placed = split.join(prefixes, [group, "n", "_p"])
    at = lambda place: reach(F.col("use_before") + place * F.col("n"))
    whole_prefix = (F.col("rows_before") + F.col("o") >= 2 * f) & (at(F.col("o")) == at(F.col("o") + F.col("c") - 1))
    plain = plain.unionByName(placed.where(whole_prefix).select(group, "token", "n", at(F.col("o")).alias("class")))
    place = F.col("o") + F.row_number().over(Window.partitionBy(group, "n", "_p").orderBy("token"))
    split = placed.where(~whole_prefix).withColumn("_q", place)
    split = split.select(group, "token", "n", (F.col("rows_before") + F.col("_q")).alias("i"), at(F.col("_q") - 1).alias("t"))
    head = split.where(F.col("i") <= 2 * f)
    lag = F.min(F.col("t") - F.col("i")).over(Window.partitionBy(group).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))  # 2F rows
    head = head.select(group, "token", "n", (F.col("i") + F.least(F.lit(0), lag)).alias("class"))
    tail = split.where(F.col("i") > 2 * f).select(group, "token", "n", F.col("t").alias("class"))
    out = plain.unionByName(head).unionByName(tail).withColumn("class", F.col("class").cast("int"))
    return out if by else out.drop("_g")


def class_sizes(classes: DataFrame, count: int) -> DataFrame:
    """(class, tokens, use) of every class, empty ones too."""
    have = classes.groupBy("class").agg(F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("use"))
    every = classes.sparkSession.range(max(1, count)).select(F.col("id").cast("int").alias("class"))
    return every.join(have, "class", "left").select("class", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("use", F.lit(0)).alias("use"))


def top_tokens(counts: DataFrame, k: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("n"), "token").limit(k)


def class_of(tokens: DataFrame, classes: DataFrame, count: int) -> DataFrame:
    """``tokens`` (token) with the class of each: the last class for unknown tokens, 0 if there are no classes at all."""
    some = classes.agg(F.count(F.lit(1)) > 0).scalar()
    found = tokens.join(classes.groupBy("token").agg(F.min("class").alias("_c")), "token", "left")
    return found.withColumn("class", F.coalesce("_c", F.when(some, max(1, count) - 1).otherwise(0)).cast("int")).drop("_c")


def growth_curve(df: DataFrame, every: int, order_col: str = "seq", tokens_col: str = "tokens") -> DataFrame:
    """(messages, distinct_tokens): distinct tokens after every ``every`` messages, and after the last.

    Each token counts at the message that brings it first; those firsts are summed by step before they are added up.
    """
    numbered = with_ordinal(df.select(F.col(order_col).alias("_seq"), F.col(tokens_col).alias("_t")), "_seq", "_n")
    last = numbered.agg(F.max("_n").alias("_last"))
    step = lambda n: F.ceil(n / every)
    firsts = numbered.select("_n", F.explode("_t").alias("token")).where("token <> ''").groupBy("token").agg(F.min("_n").alias("_n"))
    new = firsts.groupBy(step(F.col("_n")).alias("s")).agg(F.count(F.lit(1)).alias("c"))
    steps = last.where("_last > 0").select(F.explode(F.sequence(F.lit(1), step(F.col("_last")))).alias("s"), "_last")
    up_to = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)  # one row for each step
    joined = steps.join(new, "s", "left")
    return joined.select(F.least(F.col("s") * every, F.col("_last")).alias("messages"), F.sum(F.coalesce("c", F.lit(0))).over(up_to).alias("distinct_tokens"))
