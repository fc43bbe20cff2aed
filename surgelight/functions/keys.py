"""The three-part key of a token."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is appended to a token for the three parts of its key.
SUFFIXES = ("__0NE__", "__TW0__", "__THR33__")


def key_part(token: Column, part: int, length: int) -> Column:
    """Part 1, 2 or 3: the first 32 bits of the MD5 of token and suffix, modulo ``length``."""
    digest = F.md5(F.concat(token, F.lit(SUFFIXES[part - 1])))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % length).cast("int")


def key_parts(token: Column, length: int) -> list[Column]:
    return [key_part(token, k, length).alias(f"p{k}") for k in (1, 2, 3)]
