"""Text to tokens, as column expressions.

Links, apostrophes and punctuation are taken out of the whole text before it is split: none of the three patterns reaches
across white space, so the result is that of cleaning token by token, with three passes a text instead of three a token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surgelight.config import Settings, TokenFilters

#: White space of Unicode, inside a character class.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINK = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"

#: Rejection reasons in the order in which the rules are applied.
REASONS = ("max_length", "diversity", "repetition", "case", "digits", "hashtag", "url", "all_caps")


def fields(text: Column) -> Column:
    """Pieces between white space, none empty."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def normalised_space(text: Column) -> Column:
    return F.array_join(fields(text), " ")


def cleaned(text: Column, remove_urls: bool = True) -> Column:
    """Array of tokens without links, what follows an apostrophe, and all but ASCII letters and digits; none empty."""
    if remove_urls:
        text = F.regexp_replace(text, LINK, "")
    text = F.regexp_replace(text, f"'[^{SPACE}]*", "")
    return fields(F.regexp_replace(text, f"[^a-zA-Z0-9{SPACE}]", ""))


def rejection(word: Column, rules: TokenFilters) -> Column:
    """The first rule that rejects a cleaned token, null if none does."""
    n = F.length(word)
    chain = F.when(F.lit(False), F.lit(""))
    if not rules.enabled:
        return chain
    if rules.max_length > 0:
        chain = chain.when(n > rules.max_length, "max_length")
    if rules.min_character_diversity > 0:
        distinct = F.size(F.array_distinct(F.split(word, "(?!^)(?!$)")))
        chain = chain.when((n >= rules.min_character_diversity_lower_limit) & (distinct / n < rules.min_character_diversity), "diversity")
    if rules.max_character_repetition > 0:
        chain = chain.when(F.regexp_count(word, F.lit(r"(.)(?=\1)")) / n > rules.max_character_repetition, "repetition")
    if rules.max_case_alternations > 0:
        chain = chain.when(F.regexp_count(word, F.lit("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")) / n > rules.max_case_alternations, "case")
    if rules.max_number_letter_mix > 0:
        chain = chain.when(F.length(F.regexp_replace(word, "[^0-9]", "")) / n > rules.max_number_letter_mix, "digits")
    if rules.reject_hashtags:
        chain = chain.when(word.startswith("#"), "hashtag")
    if rules.reject_urls:
        chain = chain.when(word.startswith("http") | word.startswith("www"), "url")
    if rules.reject_all_caps_long:
        chain = chain.when((n >= rules.all_caps_lower_limit) & word.rlike("^[A-Z]+$"), "all_caps")
    return chain


def tokens(text: Column, settings: Settings, words: list[str] | None = None) -> Column:
    """Array of lower-cased tokens that pass the length, the word filter (``words``, lower-cased) and the quality rules."""

    def keep(w: Column) -> Column:
        ok = F.length(w) >= max(1, settings.min_token_len)
        if words:
            ok = ok & ~F.lower(w).isin(words)
        return ok & rejection(w, settings.token_filters).isNull() if settings.token_filters.enabled else ok

    return F.transform(F.filter(cleaned(text, settings.token_filters.remove_urls), keep), F.lower)


def rejection_totals(df: DataFrame, settings: Settings, text_col: str = "text", words: list[str] | None = None) -> DataFrame:
    """One row: ``processed``, all pieces between white space; ``rejected``, the tokens that fail a rule, and how many fail each rule first.

    Pieces dropped for another reason (nothing left after cleaning, too short, a listed word) are processed but not rejected.
    """
    w = F.col("_w")
    rows = df.select(F.coalesce(F.size(fields(F.col(text_col))), F.lit(0)).alias("_p"), cleaned(F.col(text_col), settings.token_filters.remove_urls).alias("_c"))
    pieces = rows.select("_p", F.posexplode_outer("_c").alias("_i", "_w"))
    live = (F.length(w) >= max(1, settings.min_token_len)) & (~F.lower(w).isin(words) if words else F.lit(True))
    reasons = pieces.select(F.when(F.coalesce("_i", F.lit(0)) == 0, F.col("_p")).otherwise(0).alias("_p"), F.when(live, rejection(w, settings.token_filters)).alias("_r"))
    counts = [F.coalesce(F.count_if(F.col("_r") == r), F.lit(0)).alias(r) for r in REASONS]
    return reasons.agg(F.coalesce(F.sum("_p"), F.lit(0)).alias("processed"), F.count("_r").alias("rejected"), *counts)


def simple_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores, two at least, none beginning with ``http``."""
    return F.filter(F.split(F.lower(text), r"\W+"), lambda w: (F.length(w) >= 2) & ~w.startswith("http"))


def pattern_counts(text: Column) -> dict[str, Column]:
    """Occurrences of ``@``, ``http`` and ``#``."""
    return {name: F.regexp_count(text, F.lit(p)) for name, p in (("at", "@"), ("http", "http"), ("hashtag", "#"))}


def alphabetic_words(text: Column) -> Column:
    """Lower-cased pieces of at least two letters and nothing else, joined by spaces."""
    return F.array_join(F.transform(F.filter(fields(text), lambda w: w.rlike(r"^\p{L}{2,}$")), F.lower), " ")
