"""Surge-word analytics on Spark: find words whose use is suddenly rising in a stream of short texts."""
