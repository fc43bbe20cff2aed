"""Queries of the operators for language-model data, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surgelight.llm import abuse, encoding, leakage, lookalikes, minhash, personal, vertical


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = personal.read_names(_table(spark, sf_dir, "name_list"))
    return personal.personal_data(_table(spark, sf_dir, "tweets"), names).select("seq", "kind").distinct()


def p1_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with typed placeholders."""
    names = personal.read_names(_table(spark, sf_dir, "name_list"))
    return personal.with_placeholders(_table(spark, sf_dir, "tweets").select("seq", "text"), names)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.odd_characters(_table(spark, sf_dir, "tweets"))


def p2_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts and tokens in one consistent form."""
    return lookalikes.with_consistent_form(_table(spark, sf_dir, "tweets").select("seq", "text", "tokens"), "text", "tokens")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = vertical.marked_terms(_table(spark, sf_dir, "tweets"))
    return marked.where("mark IS NOT NULL").select(F.col("term").alias("token"), "mark")


def p3_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertical.term_frequencies(_table(spark, sf_dir, "tweets"))


def _with_number(tweets: DataFrame) -> DataFrame:
    """The digits of ``id_str`` as a number, beside text and order."""
    number = F.regexp_replace("id_str", "[^0-9]", "").try_cast("bigint")
    return tweets.select(number.alias("id"), "text", "seq")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_pairs(_with_number(_table(spark, sf_dir, "tweets")))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per identifier: its group of near-duplicates and the number of links of its class."""
    return minhash.near_duplicate_groups(_with_number(_table(spark, sf_dir, "tweets")))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encoded(_table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaking document with its items and the merged spans to remove."""
    found = leakage.leaked_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), F.to_json("spans").alias("spans"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = abuse.fitted(documents, _table(spark, sf_dir, "abuse_labels"))
    return abuse.scored(documents.select("doc_id", "source", "text"), model)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).where("abusive").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of abusive documents for each source."""
    return abuse.rates(p9_scores(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_replaced, p2_found, p2_form, p3_found, p3_frequencies, p4_found, p4_groups, p7_ids, p8_found, p8_spans, p9_found, p9_scores, p9_rates)}

_COUNTS = """
t AS (SELECT seq, unnest(tokens) AS term FROM tweets),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT seq) AS records FROM t WHERE term IS NOT NULL AND term <> '' GROUP BY term)"""
# What the transducer counts as a case, as patterns: forms of ASCII characters, invisible characters, odd spaces, emoji with what
# may follow them, and other alphabets.
_FORMS = r"\x{FF01}-\x{FF5E}\x{1D400}-\x{1D7FF}\x{2102}\x{210A}-\x{2113}\x{2115}\x{2119}-\x{211D}\x{2124}\x{2128}\x{212C}\x{212D}\x{212F}-\x{2131}\x{2133}\x{2134}\x{2145}-\x{2149}"
_HIDDEN = r"\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}"
_SPACES = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
_EMOJI = r"[\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}][\x{FE0F}\x{1F3FB}-\x{1F3FF}]*"
_WORD = rf"[\p{{L}}\p{{M}}\p{{Nd}}{_FORMS}{_HIDDEN}]*"
_OTHER = lookalikes.OTHER_ALPHABET
# Equivalents of other characters and single letters of syllables: changed, but no cases.
_SAME = r"\x{340}\x{341}\x{343}\x{344}\x{374}\x{37E}\x{387}\x{958}-\x{95F}\x{9DC}\x{9DD}\x{9DF}\x{A33}\x{A36}\x{A59}-\x{A5B}\x{A5E}\x{B5C}\x{B5D}\x{F43}-\x{FB9}\x{1100}-\x{11FF}\x{1F71}-\x{1FFD}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{2ADC}\x{F900}-\x{FAD9}\x{FB1D}-\x{FB4E}\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1D}"


def _odd(c: str) -> str:
    return f"""(regexp_matches({c}, '[{_FORMS}{_SPACES}]') OR nfc_normalize(regexp_replace({c}, '[{_SAME}]', '', 'g')) <> regexp_replace({c}, '[{_SAME}]', '', 'g') OR regexp_matches(regexp_replace({c}, '{_EMOJI}(\\x{{200D}}{_EMOJI})+', '', 'g'), '[{_HIDDEN}]')
  OR regexp_matches({c}, '[\\p{{Latin}}{_FORMS}]{_WORD}[{_OTHER}]|[{_OTHER}]{_WORD}[\\p{{Latin}}{_FORMS}]'))"""


def _translate(c: str, kind: int) -> str:
    """The rules of one kind from single characters to single ones, as ``translate``."""
    rules = [(k, v) for k, (v, x) in lookalikes.mapping().items() if x == kind and len(k) == 1 and len(v) == 1]
    a, b = ("".join(x).replace("'", "''") for x in zip(*rules))
    return f"translate({c}, '{a}', '{b}')"


def _form(c: str) -> str:
    """The consistent form: joiners inside emoji are set aside while invisible characters go, look-alikes change in mixed words."""
    pair = rf"({_EMOJI})\x{{200D}}([\x{{2190}}-\x{{2BFF}}\x{{1F000}}-\x{{1FAFF}}])"
    aside = f"regexp_replace(regexp_replace({c}, '{pair}', '\\1\ue000\\2', 'g'), '{pair}', '\\1\ue000\\2', 'g')"
    shown = f"replace(regexp_replace({aside}, '[{_HIDDEN}]', '', 'g'), '\ue000', '\u200d')"
    even = _translate(_translate(shown, lookalikes.SPACE), lookalikes.WIDTH)
    word = r"[\p{L}\p{M}\p{Nd}]"
    mixed = rf"regexp_matches(w, '\p{{Latin}}') AND regexp_matches(w, '[{_OTHER}]') AND regexp_matches(w, '\p{{L}}')"
    parts = f"list_transform(regexp_extract_all({even}, '{word}+|[^\\p{{L}}\\p{{M}}\\p{{Nd}}]+'), lambda w: CASE WHEN {mixed} THEN {_translate('w', lookalikes.ALPHABET)} ELSE w END)"
    return f"nfc_normalize(array_to_string({parts}, ''))"


_PAIRS = rf"""one AS (SELECT CAST(regexp_replace(id_str, '[^0-9]', '', 'g') AS BIGINT) AS id, min_by(text, seq) AS text FROM tweets WHERE regexp_matches(id_str, '[0-9]') GROUP BY 1),
s AS MATERIALIZED (SELECT id, list_sort(list_distinct(regexp_extract_all(lower({_form('text')}), '[\p{{L}}\p{{Nd}}]+'))) AS words FROM one WHERE text IS NOT NULL),
w AS MATERIALIZED (SELECT id, len(words) AS n, unnest(words) AS w FROM s WHERE len(words) >= 10),
c AS (SELECT a.id AS id_a, b.id AS id_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM w a JOIN w b ON a.w = b.w AND a.id < b.id GROUP BY a.id, b.id),
pairs AS MATERIALIZED (SELECT id_a, id_b FROM c WHERE c * 10 >= 6 * (na + nb - c))"""
_GROUPS = f"""WITH RECURSIVE {_PAIRS},
e AS MATERIALIZED (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
r AS (SELECT id, id AS root FROM s WHERE len(words) >= 10 UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a),
k AS (SELECT id, min(id) OVER (PARTITION BY words) AS cls FROM s WHERE len(words) >= 10),
l AS (SELECT x.cls, count(DISTINCT y.cls) AS links FROM e JOIN k x ON x.id = e.a JOIN k y ON y.id = e.b WHERE x.cls <> y.cls GROUP BY x.cls)
SELECT k.id, g."group", coalesce(l.links, 0) AS links FROM k JOIN (SELECT id, min(root) AS "group" FROM r GROUP BY id) g USING (id) LEFT JOIN l USING (cls)"""

ORACLES = {
    "p2_form": f"SELECT seq, {_form('text')} AS text, list_transform(tokens, lambda t: {_form('t')}) AS tokens FROM tweets",
    "p4_found": f"WITH {_PAIRS} SELECT * FROM pairs",
    "p4_groups": _GROUPS,
    "p2_found": f"SELECT seq, 'text' AS field FROM tweets WHERE {_odd('text')} UNION ALL SELECT seq, 'tokens' FROM tweets WHERE len(list_filter(tokens, lambda w: {_odd('w')})) > 0",
    "p3_found": f"WITH {_COUNTS} SELECT term AS token, CASE WHEN records < 3 THEN 'rare' ELSE 'common' END AS mark FROM c WHERE records < 3 OR records > 5e-2 * (SELECT count(*) FROM tweets)",
    "p3_frequencies": f"WITH {_COUNTS} SELECT * FROM c",
}
