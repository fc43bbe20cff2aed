"""One consistent form for text that looks the same: a longest-match transducer over grapheme clusters.

The mapping is computed once from the character database: full-width and mathematical letter forms to ASCII, base letter
plus separate accents to the composed letter, odd spaces to U+0020, invisible characters to nothing, look-alike
letters to Latin (only inside a word that also has Latin letters), and forms that look exactly like others (canonical
equivalents, ligatures, Roman numerals, half-width kana, syllables written in single letters) to those. Building the
mapping fails if two rules claim the same source with different targets, or if a target is itself a source.

Compiled, each cluster (a character with the accents and invisible characters that follow it) has one state: what it becomes
alone, what it becomes in a word of mixed alphabets, the kinds of change, and its alphabet. A state is worked out by longest
match when its cluster is first met and kept. Text then passes once: emoji sequences are copied, every word is put together
from the states of its clusters, all else is looked up by itself.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surgelight.session import map_arrow

# Letters of other alphabets and the Latin letters they look like.
LOOKALIKES = (
    ("аԁеѐёһіїјкӏмоорԛѕтухѵԝс", "adeèëhiïjklmoopqstyxvwc"),
    ("АВСЕЅНІЇЈКМОРԚТХУҮԜѴӀ", "ABCESHIÏJKMOPQTXYYWVl"),
    ("αεγηικνορστυχωϲϳ", "aeynikvopotuxwcj"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ABEZHIKMNOPTYXC"),
    ("աօոսհցզ", "wounhgq"),
    ("ՕՍՏԼ", "OUSL"),
)
# Invisible characters.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
# Spaces other than U+0020; tab and line breaks are not among them.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Letter-like symbols that fill the gaps of the mathematical letters.
LETTERLIKE = "ℂℊℋℌℍℎℐℑℒℓℕℙℚℛℜℝℤℨℬℭℯℰℱℳℴⅅⅆⅇⅈⅉ"
#: The alphabets whose letters can pose as Latin ones.
OTHER_ALPHABET = r"\p{Greek}\p{Cyrillic}\p{Armenian}\p{Hebrew}\p{Arabic}\p{Georgian}\p{Cherokee}\p{Coptic}"
#: Kinds of change.
WIDTH, ACCENT, HIDDEN, SPACE, ALPHABET = 1, 2, 4, 8, 16
#: Other forms that look the same; changed, but none of the cases of ``odd_characters``.
SAME = 32
#: Scripts in which a joiner between two letters changes their shape.
JOINING = r"\p{Arabic}\p{Syriac}\p{Nko}\p{Mongolian}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}"
JOINERS = "\u200c\u200d"
#: Kept states; beyond it they are worked out anew.
STATES = 1 << 17


def lookalike_pairs() -> dict[str, str]:
    return {a: b for letters, latin in LOOKALIKES for a, b in zip(letters, latin, strict=True)}


@cache
def mapping() -> dict[str, tuple[str, int]]:
    """Source string to (target, kind); conflict-checked."""
    table: dict[str, tuple[str, int]] = {}

    def add(source: str, target: str, kind: int) -> None:
        if table.setdefault(source, (target, kind)) != (target, kind):
            raise ValueError(f"two rules for {source!r}: {table[source]} and {(target, kind)}")

    for code in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *map(ord, LETTERLIKE)]:
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and plain.isascii():
            add(chr(code), plain, WIDTH)
    for ch in INVISIBLE:
        add(ch, "", HIDDEN)
    for ch in SPACES:
        add(ch, " ", SPACE)
    for code in range(0xC0, 0x1FFFF):
        ch = chr(code)
        apart = unicodedata.normalize("NFD", ch)
        if 1 < len(apart) and not 0xAC00 <= code < 0xD7A4 and unicodedata.normalize("NFC", apart) == ch and unicodedata.combining(apart[1]):
            add(apart, ch, ACCENT)
            for n in range(2, len(apart)):  # partly composed: composed letter, then further accents
                add(unicodedata.normalize("NFC", apart[:n]) + apart[n:], ch, ACCENT)
    for code in range(0xC0, 0x30000):
        ch = chr(code)
        if 0xD800 <= code < 0xE000 or ch in table or unicodedata.category(ch)[0] == "M":
            continue
        canonical = unicodedata.normalize("NFC", ch)
        if canonical != ch:  # equivalents that are never composed again
            add(ch, canonical, SAME)
    for code in (*range(0xFB00, 0xFB07), *range(0x2160, 0x2180), *range(0xFF61, 0xFF9E), *range(0xFFE0, 0xFFE7)):  # ligatures, Roman numerals, half-width forms
        shown = unicodedata.normalize("NFKC", chr(code))
        if " " not in shown and shown != chr(code):
            add(chr(code), shown, SAME)
        for mark in "\uff9e\uff9f":
            voiced = unicodedata.normalize("NFKC", chr(code) + mark)
            if 0xFF61 <= code < 0xFF9E and len(voiced) == 1:
                add(chr(code) + mark, voiced, SAME)
    add("\uff9e", "\u309b", SAME)
    add("\uff9f", "\u309c", SAME)
    for code in range(0xAC00, 0xD7A4):  # syllables
        letters = unicodedata.normalize("NFD", chr(code))
        add(letters, chr(code), SAME)
        if len(letters) == 3:
            add(unicodedata.normalize("NFC", letters[:2]) + letters[2], chr(code), SAME)
    for a, b in lookalike_pairs().items():
        add(a, b, ALPHABET)
    for source, (target, kind) in table.items():
        if target in table and table[target][1] != ALPHABET:
            raise ValueError(f"{source!r} becomes {target!r}, which another rule changes")
    return table


class Transducer:
    """Compiled form of the mapping. ``keep_joiners`` leaves joiners between letters of scripts that need them; they are reported all the same."""

    def __init__(self, keep_joiners: bool = False) -> None:
        self.table, self.keep_joiners = mapping(), keep_joiners
        self.longest = max(map(len, self.table))
        hidden, forms = "".join(INVISIBLE), "".join(k for k, (_, kind) in self.table.items() if kind == WIDTH and unicodedata.normalize("NFKC", k).isalnum())
        after = "[\ufe0f\U0001f3fb-\U0001f3ff]*"
        emoji = rf"\p{{Extended_Pictographic}}{after}(?:\u200d\p{{Extended_Pictographic}}{after})*"
        self.parts = regex.compile(rf"(?P<emoji>{emoji})|(?P<word>[\p{{L}}\p{{M}}\p{{Nd}}{forms}{hidden}]+)|(?P<other>[^\x00-\x7f]\p{{M}}*)")
        rest = rf"[\p{{M}}{hidden}]*"
        self.cluster = regex.compile(rf"[\u1100-\u1112]{rest}[\u1161-\u1175]{rest}(?:[\u11a8-\u11c2]{rest})?|[\uac00-\ud7a3]{rest}[\u11a8-\u11c2]{rest}|[\uff61-\uff9d][\uff9e\uff9f]|[^\p{{M}}{hidden}]{rest}|[\p{{M}}{hidden}]+", regex.S)
        self.latin = regex.compile(rf"[\p{{Latin}}{forms}]")
        self.alien = regex.compile(rf"(?=\p{{L}})[{OTHER_ALPHABET}]")
        self.hidden = regex.compile(f"[{hidden}]")
        self.joining = regex.compile(rf"[{JOINING}]")
        self.states: dict[str, tuple[str, int, str, int, int, str]] = {}

    def _rewritten(self, c: str, mixed: bool) -> tuple[str, int]:
        """A cluster without invisible characters, by longest match."""
        out, kinds, i, table = [], 0, 0, self.table
        while i < len(c):
            for n in range(min(self.longest, len(c) - i), 0, -1):
                hit = table.get(c[i : i + n])
                if hit and (hit[1] != ALPHABET or mixed):
                    kinds |= hit[1]
                    if hit[1] in (WIDTH, ALPHABET) and len(c) > i + n:  # its accents belong to the new letter
                        c, i = hit[0] + c[i + n :], 0
                    else:
                        out.append(hit[0])
                        i += n
                    break
            else:
                out.append(c[i])
                i += 1
        return "".join(out), kinds

    def _state(self, cluster: str) -> tuple[str, int, str, int, int, str]:
        """Output and kinds alone, the same in a mixed word, alphabets (1 Latin, 2 another), and a joiner that may have to stay behind it."""
        shown = self.hidden.sub("", cluster)
        kinds = HIDDEN if shown != cluster else 0
        if len(shown) > 2 and unicodedata.combining(shown[1]):  # accents in their standard order
            shown = shown[0] + "".join(sorted(shown[1:], key=unicodedata.combining))
        (one, a), (two, b) = self._rewritten(shown, False), self._rewritten(shown, True)
        alphabets = bool(self.latin.search(shown)) + 2 * bool(self.alien.search(shown))
        joiner = cluster[-1] if self.keep_joiners and cluster[-1] in JOINERS and self.joining.match(cluster) else ""
        if len(self.states) >= STATES:
            self.states.clear()
        self.states[cluster] = state = (one, a | kinds, two, b | kinds, alphabets, joiner)
        return state

    def _word(self, word: str) -> tuple[str, int]:
        states = [self.states.get(c) or self._state(c) for c in self.cluster.findall(word)]
        alphabets = 0
        for s in states:
            alphabets |= s[4]
        at = 2 if alphabets == 3 else 0
        kinds = ALPHABET if at else 0
        for s in states:
            kinds |= s[at + 1]
        if self.keep_joiners and any(s[5] for s in states):
            after = [*(bool(self.joining.match(s[0])) for s in states[1:]), False]
            return "".join(s[at] + (s[5] if follows else "") for s, follows in zip(states, after)), kinds
        return "".join([s[at] for s in states]), kinds

    def __call__(self, text: str) -> tuple[str, int]:
        """The consistent form and the kinds of change, as bits."""
        kinds = 0

        def one(m: regex.Match) -> str:
            nonlocal kinds
            if m.lastgroup == "emoji":
                return m[0]
            if m.lastgroup == "word":
                if m[0].isascii():
                    return m[0]
                new, k = self._word(m[0])
            else:
                new, k = "", 0
                for ch in m[0]:
                    target, kind = self.table.get(ch, (ch, 0))
                    new, k = new + target, k | kind
            kinds |= k
            return new

        return self.parts.sub(one, text), kinds


@cache
def transducer(keep_joiners: bool = False) -> Transducer:
    return Transducer(keep_joiners)


@cache
def suspicious() -> str:
    """A character class that every text with something to change matches (RE2 syntax)."""
    codes = {ord(ch) for source, (_, kind) in mapping().items() for ch in (source[1:] if kind in (ACCENT, SAME) and len(source) > 1 else source) if kind != ALPHABET}
    codes.update(range(0x300, 0x370))
    codes.update(i for i in range(0x370, 0x30000) if regex.match(rf"[{OTHER_ALPHABET}]", chr(i)))
    runs, start, last = [], None, None
    for c in sorted(codes):
        if last is None or c != last + 1:
            if last is not None:
                runs.append((start, last))
            start = c
        last = c
    runs.append((start, last))
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def consistent(texts: pa.Array, keep_joiners: bool = False) -> tuple[pa.Array, list[tuple[int, int]]]:
    """The texts in one form, and (position, kinds) of each text in which a case was found. Nulls stay null."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    look = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, suspicious()), False))
    found, new = [], []
    change = transducer(keep_joiners)
    for i, text in zip(look.to_pylist(), texts.take(look).to_pylist()):
        form, kinds = change(text)
        new.append(form)
        if kinds:
            found.append((i, kinds))
    if len(look):
        mask = pc.is_in(pa.array(range(len(texts)), pa.uint64()), value_set=look)
        texts = pc.replace_with_mask(texts, mask, pa.array(new, pa.large_string()))
    return texts.cast(pa.string()) if texts.nbytes < 2**31 - 1 else texts, found


def consistent_lists(lists: pa.Array, keep_joiners: bool = False) -> tuple[pa.Array, list[int]]:
    """Lists of strings in one form, and the positions of the lists with a case in any element."""
    values = lists.flatten()
    owner = pc.list_parent_indices(lists)
    words = values.dictionary_encode()
    form, found = consistent(words.dictionary, keep_joiners)
    hit = pa.array([i for i, kinds in found if kinds & ~SAME], pa.int32())
    rows = pc.unique(owner.filter(pc.fill_null(pc.is_in(words.indices, value_set=hit), False))).to_pylist()
    flat = form.take(words.indices)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
    rebuilt = pa.ListArray.from_arrays(offsets, flat, mask=lists.is_null())
    return rebuilt, rows


def with_consistent_form(df: DataFrame, text_col: str = "text", token_col: str | None = None, keep_joiners: bool = True) -> DataFrame:
    """``df`` with ``text_col`` (and the list ``token_col``) in one consistent form; all other columns unchanged.

    Joiners between letters of scripts whose letters they shape stay, as what is seen would change without them, unless
    ``keep_joiners`` is off (operators that compare texts take them out).

    Null and empty texts, null lists and null elements stay as they are. Repeated rows are each rewritten. The operator
    is idempotent, needs no shuffle and keeps no more than one batch in memory. An empty table gives an empty table.
    """
    names = df.columns
    inner = df.toDF(*[f"c{i}" for i in range(len(names))])
    text_at, token_at = names.index(text_col), names.index(token_col) if token_col else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[text_at] = consistent(columns[text_at], keep_joiners)[0].cast(batch.schema[text_at].type)
            if token_at >= 0:
                columns[token_at] = consistent_lists(columns[token_at], keep_joiners)[0].cast(batch.schema[token_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_arrow(inner, run, T.StructType([T.StructField(f.name, f.dataType, True) for f in inner.schema])).toDF(*names)


def odd_characters(df: DataFrame, id_col: str = "seq", text_col: str = "text", token_col: str = "tokens") -> DataFrame:
    """(``id_col``, ``field``) of every row whose text (field ``text``) or any token (field ``tokens``) the transducer would change for more than SAME.

    Rows with nulls, empty texts or empty lists have no case; repeated rows are each reported.
    """
    lean = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(token_col).alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, tokens = batch.columns
            for field, rows in (("text", [i for i, kinds in consistent(texts)[1] if kinds & ~SAME]), ("tokens", consistent_lists(tokens)[1])):
                if rows:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array([field] * len(rows), pa.string())], names=["i", "f"])

    kind = lean.schema["i"].dataType
    out = map_arrow(lean, run, T.StructType([T.StructField("i", kind, True), T.StructField("f", T.StringType(), True)]))
    return out.select(F.col("i").alias(id_col), F.col("f").alias("field"))
