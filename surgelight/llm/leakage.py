"""Evaluation passages in a training corpus: an FM-index for each training shard, searched for all test phrases at once.

A shard is a run of documents of one task, as a sequence of word numbers (only words of the test items have numbers of
their own). Its suffixes are sorted by prefix doubling; the Burrows-Wheeler transform is held in a wavelet matrix. All
phrases of a few words of all passages are searched backwards together, each step by two ranks. Occurrences are located by walking
to the next sampled suffix position (every 16th, and every beginning of a document). Hits of one item in one document
become spans of the passage; where they cover enough of it, the stretch is aligned word by word, and the spans
that pass are merged into spans of the text to remove.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surgelight.llm.batches import by_size
from surgelight.llm.lookalikes import consistent
from surgelight.session import map_arrow

#: Words of a searched phrase.
PHRASE = 3
#: Words of a shard; one document is never cut.
SHARD_WORDS = 400_000
SAMPLE = 16
#: Items searched together; further items are searched in further passes.
BLOCK_ITEMS = 20_000
#: Characters of all passages together.
MOST_ITEM_CHARACTERS = 1 << 28
#: Occurrences, each with an item, that are held at a time.
BLOCK_HITS = 1 << 22
#: Cells of the tables that are filled together.
CELLS = 1 << 22
#: Part of the words of an aligned stretch that must be equal.
EQUAL = 0.75
#: From this many words on, a stretch with a quarter of its words changed, in whatever places, still has two whole phrases.
TWO_PHRASES = 13
OTHER, SEPARATOR = 1, 0
_WORD = regex.compile(r"[\p{L}\p{Nd}](?:[\p{L}\p{M}\p{Nd}]|-[ \t]*\r?\n[ \t>*]*(?=\p{Ll}))*")
#: The same for texts of ASCII characters.
_ASCII_WORD = re.compile(r"[A-Za-z0-9]+(?:-[ \t]*\r?\n[ \t>*]*(?=[a-z])[A-Za-z0-9]+)*")
_BREAK = regex.compile(r"-[ \t]*\r?\n[ \t>*]*")


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(lower-cased word, start, end); a word broken by a hyphen at the end of a line is one word."""
    out = []
    for m in _WORD.finditer(text):
        w = m[0]
        out.append(((_BREAK.sub("", w) if "\n" in w else w).lower(), m.start(), m.end()))
    return out


def plain_words(text: str) -> list[str]:
    """The words of ``words_of`` without their places."""
    words = (_ASCII_WORD if text.isascii() else _WORD).findall(text)
    return [(_BREAK.sub("", w) if "\n" in w else w).lower() for w in words] if "\n" in text else [w.lower() for w in words]


class WaveletMatrix:
    """Ranks and access over a sequence of small numbers; one bit plane per bit, counted by blocks of 32."""

    def __init__(self, values: np.ndarray, top: int):
        self.n, self.levels = len(values), max(1, int(top).bit_length())
        self.planes, self.counts, self.zeros = [], [], []
        values = values.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bits = (values >> np.uint32(level)) & np.uint32(1)
            padded = np.zeros((self.n // 32 + 1) * 32, np.uint8)
            padded[: self.n] = bits
            plane = np.packbits(padded, bitorder="little").view("<u4")
            self.planes.append(plane)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(plane))]).astype(np.int64))
            self.zeros.append(self.n - int(bits.sum()))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        block = i >> 5
        below = (np.uint64(1) << (i & 31).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][block] + np.bitwise_count(self.planes[level][block] & below.astype(np.uint32))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i."""
        low = np.zeros(len(i), np.int64)
        high = i.astype(np.int64)
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            a, b = self._ones(k, low), self._ones(k, high)
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return high - low

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place i, and how often it stands before i."""
        low, at, symbol = np.zeros(len(i), np.int64), i.astype(np.int64), np.zeros(len(i), np.int64)
        for k in range(self.levels):
            one = (self.planes[k][at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1
            a, b = self._ones(k, low), self._ones(k, at)
            low = np.where(one, self.zeros[k] + a, low - a)
            at = np.where(one, self.zeros[k] + b, at - b)
            symbol = symbol * 2 + one
        return symbol, at - low


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; separators (0) are distinct, earlier ones first."""
    n = len(values)
    first = values.astype(np.int64) + n
    gaps = np.flatnonzero(values == SEPARATOR)
    first[gaps] = np.arange(len(gaps))
    order = np.argsort(first, kind="stable")
    head = np.concatenate([[True], np.diff(first[order]) != 0])
    start = np.flatnonzero(head)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))
    rank[n] = -1
    sizes = np.diff(np.append(start, n))
    active = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places of the order that are not settled
    step = 1
    while len(active):
        who = order[active]
        group, after = rank[who], rank[np.minimum(who + step, n)]
        by = np.lexsort((after, group))
        who, group, after = who[by], group[by], after[by]
        order[active] = who
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        at = np.flatnonzero(fresh)
        sizes = np.diff(np.append(at, len(who)))
        rank[who] = np.repeat(active[at], sizes)
        active = active[np.repeat(sizes > 1, sizes)]
        step *= 2
    return order


class FMIndex:
    def __init__(self, values: np.ndarray, top: int):
        """``values`` ends with a separator, and every document is followed by one."""
        order = suffix_array(values)
        self.last = WaveletMatrix(values[order - 1], top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(values, minlength=top + 1))])
        begins = np.zeros(len(values), bool)
        begins[0] = True
        begins[1:] = values[:-1] == SEPARATOR
        marked = begins[order] | (order % SAMPLE == 0)
        self.marked = marked
        self.position = np.zeros(len(values), np.int64)
        self.position = order[marked]
        self.slot = np.cumsum(marked) - 1

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase (rows of ``phrases``; -1 pads on the left)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.last.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, k]
            on = np.flatnonzero((symbol >= 0) & (low < high))
            base = self.before[symbol[on]]
            low[on] = base + self.last.rank(symbol[on], low[on])
            high[on] = base + self.last.rank(symbol[on], high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        at, walked, todo = rows.copy(), 0, np.arange(len(rows))
        while len(todo):
            here = self.marked[at]
            done = todo[here]
            out[done] = self.position[self.slot[at[here]]] + walked
            todo, at = todo[~here], at[~here]
            if len(todo):
                symbol, rank = self.last.access_rank(at)
                at = self.before[symbol] + rank
            walked += 1
        return out


@dataclass
class Items:
    """Test items ready for searching."""

    ids: list
    passages: list[np.ndarray]
    numbers: dict[str, int]
    phrases: np.ndarray
    #: phrase, item and place in the passage of every phrase occurrence, by phrase
    where: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        numbers: dict[str, int] = {}
        ids, passages = [], []
        texts = consistent(pa.array([t for _, t in rows], pa.string()))[0].to_pylist()
        for (key, _), text in zip(rows, texts):
            words = [w for w, _, _ in words_of(text)] if text else []
            if words:
                ids.append(key)
                passages.append(np.array([numbers.setdefault(w, len(numbers) + 2) for w in words]))
        table: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for item, p in enumerate(passages):
            size = min(PHRASE, len(p))
            for q in range(len(p) - size + 1):
                table[tuple([-1] * (PHRASE - size) + p[q : q + size].tolist())].append((item, q))
        phrases = np.array(list(table), np.int64).reshape(-1, PHRASE)
        where = np.array([x for v in table.values() for x in v], np.int64).reshape(-1, 2)
        start = np.concatenate([[0], np.cumsum([len(v) for v in table.values()])]).astype(np.int64)
        return cls(ids, passages, numbers, phrases, where, start)


def align(texts: list[np.ndarray], passage: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Best local alignment of each text with the passage, all texts together: matches, first and last place in the passage, first and last place in the text."""
    m, longest = len(passage), max(map(len, texts))
    words = np.full((len(texts), longest), -1, np.int64)
    for k, t in enumerate(texts):
        words[k, : len(t)] = t
    kind = np.int16 if m <= 10_000 else np.int32  # no score is above twice the passage
    table = np.zeros((len(texts), longest + 1, m + 1), kind)
    steps = np.arange(m + 1, dtype=kind)
    row = np.zeros((len(texts), m + 1), kind)
    equal, other = kind(2), kind(-1)
    for i in range(1, longest + 1):
        up = table[:, i - 1]
        row[:, 1:] = np.maximum(np.maximum(up[:, :-1] + np.where(words[:, i - 1, None] == passage, equal, other), up[:, 1:] - 1), 0)
        table[:, i] = np.maximum(np.maximum.accumulate(row + steps, axis=1) - steps, 0)
    return [_traced(table[k], t, passage) for k, t in enumerate(texts)]


def _traced(table: np.ndarray, text: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int, int]:
    i, j = map(int, np.unravel_index(int(np.argmax(table)), table.shape))
    end_i, end_j, matches = i, j, 0
    while i and j and (here := table[i, j]) > 0:
        same = passage[j - 1] == text[i - 1]
        if here == table[i - 1, j - 1] + (2 if same else -1):
            matches += int(same)
            i, j = i - 1, j - 1
        elif here == table[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return matches, j, end_j - 1, i, end_i - 1


def _masks(passage: np.ndarray) -> dict[int, int]:
    """For each word of the passage, its places as bits."""
    out: dict[int, int] = {}
    for place, w in enumerate(passage.tolist()):
        out[w] = out.get(w, 0) | 1 << place
    return out


def common_words(text: np.ndarray, masks: dict[int, int], size: int) -> int:
    """Length of the longest common subsequence with a passage of ``size`` words: no alignment has more matches."""
    every = free = (1 << size) - 1
    for w in text.tolist():
        if here := masks.get(w, 0) & free:
            free = ((free + here) | (free - here)) & every
    return size - free.bit_count()


def search_shard(documents: list[np.ndarray], items: Items, share: float) -> list[tuple[int, int, int, int, int]]:
    """(document, item, first word, last word, matches) of every leak."""
    values = np.concatenate([np.append(d, SEPARATOR) for d in documents])
    starts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in documents])])
    index = FMIndex(values, len(items.numbers) + 2)
    low, high = index.search(items.phrases)
    counts = high - low
    if not counts.any():
        return []
    lengths = np.array([len(p) for p in items.passages])
    longest, n = int(lengths.max()), len(items.ids)

    many = items.start[1:] - items.start[:-1]
    cost = np.cumsum(counts * many)

    def hits() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(pair of document and item, place in the passage, place in the shard) of every occurrence, in blocks: a phrase of many items that occurs often is never held with all of them."""
        at = 0
        while at < len(counts):
            end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + BLOCK_HITS, side="right")))
            phrase = np.repeat(np.arange(at, end), counts[at:end])
            rows = np.arange(len(phrase)) - np.repeat(np.cumsum(counts[at:end]) - counts[at:end], counts[at:end]) + np.repeat(low[at:end], counts[at:end])
            place = index.locate(rows)
            each = many[phrase]
            k = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(items.start[phrase], each)
            item, q = items.where[k].T
            place = np.repeat(place, each)
            yield (np.searchsorted(starts, place, side="right") - 1) * n + item, q, place
            at = end

    once = list(hits()) if cost[-1] <= BLOCK_HITS else None  # else they are located again below
    distinct = np.unique(np.concatenate([np.unique(pair * longest + q) for pair, q, _ in once or hits()])) // longest
    pairs, hit = np.unique(distinct, return_counts=True)
    least = np.ceil(share * lengths)
    need = np.where(least >= TWO_PHRASES, 2, 1)
    good = pairs[hit >= need[pairs % n]]
    out = []
    kept = [(pair[keep], at[keep]) for pair, _, at in once or hits() if (keep := np.isin(pair, good)).any()]
    if not kept:
        return []
    pair, at = (np.concatenate(x) for x in zip(*kept))
    order = np.lexsort((at, pair))
    pair, at = pair[order], at[order]
    document, item = np.divmod(pair, n)
    # stretches: hits of a pair that lie close together, with room for the rest of the passage on both sides
    fresh = np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(at) > lengths[item[1:]])])
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(at))
    room = lengths[item[head]]
    x, y = np.maximum(starts[document[head]], at[head] - room), np.minimum(starts[document[head] + 1] - 1, at[tail - 1] + PHRASE + room)
    enough = np.flatnonzero(tail - head >= need[item[head]])
    local = np.full(len(items.numbers) + 2, -1)  # place of each word among the words of the passage at hand
    by_item = enough[np.argsort(item[head[enough]], kind="stable")]
    for group in np.split(by_item, np.flatnonzero(np.diff(item[head[by_item]])) + 1) if len(by_item) else ():
        i = int(item[head[group[0]]])
        passage, m = items.passages[i], int(lengths[i])
        own, times = np.unique(passage, return_counts=True)
        local[own] = np.arange(len(own))
        masks, least_equal = _masks(passage), EQUAL * least[i]

        def may_leak(windows: list[tuple[int, int, int]], whole: bool) -> list[tuple[int, int, int]]:
            """By three bounds on the matches, the cheapest first: hits inside, words in common in any order, words in common in their order."""
            if not whole:  # whole stretches have enough hits
                windows = [w for w in windows if np.count_nonzero((at[head[w[0]] : tail[w[0]]] >= w[1]) & (at[head[w[0]] : tail[w[0]]] < w[2])) >= need[i]]
            out = []
            for part in _portions(windows, 8):
                size = np.array([b - a for _, a, b in part])
                known = local[np.concatenate([values[a:b] for _, a, b in part])]
                owner = np.repeat(np.arange(len(part)) * len(times), size)[known >= 0]
                counts = np.bincount(owner + known[known >= 0], minlength=len(part) * len(times)).reshape(len(part), -1)
                fit = np.minimum(counts, times).sum(axis=1) >= least_equal
                out += [w for w, yes in zip(part, fit) if yes and common_words(values[w[1] : w[2]], masks, m) >= least_equal]
            return out

        todo = [(int(s), int(a), int(b)) for s in group for a, b in _windows(int(x[s]), int(y[s]), m)]
        whole = len(todo) == len(group)
        while todo:
            live = may_leak(sorted(todo, key=lambda w: w[2] - w[1]), whole)
            todo, whole = [], False
            for part in _portions(live, m):
                for (s, a, b), (matches, first, last, begin, end) in zip(part, align([values[a:b] for _, a, b in part], passage)):
                    if (last - first + 1) >= share * m and matches >= EQUAL * (last - first + 1):
                        d = int(document[head[s]])
                        out.append((d, i, a + begin - int(starts[d]), a + end - int(starts[d]), matches))
                        todo += [(s, a, a + begin), (s, a + end + 1, b)]  # further copies beside it
        local[own] = -1
    return sorted(set(out))


def _windows(a: int, b: int, m: int) -> list[tuple[int, int]]:
    """The stretch itself, or where its table would be too large, windows of it that overlap by two passages."""
    if (b - a) * m <= CELLS or b - a <= 4 * m:
        return [(a, b)]
    size = max(4 * m, CELLS // m)
    return [(k, min(b, k + size)) for k in range(a, max(a + 1, b - 2 * m), size - 2 * m)]


def _portions(windows: list[tuple[int, int, int]], m: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows, in order of size, that are aligned together."""
    at = 0
    while at < len(windows):
        end = at + 1
        while end < len(windows) and (end + 1 - at) * (windows[end][2] - windows[end][1] + 1) * (m + 1) <= CELLS:
            end += 1
        yield windows[at:end]
        at = end


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def leaks(df: DataFrame, eval_items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", share: float = 0.5) -> DataFrame:
    """(``id_col``, ``item_col``, ``start``, ``end``): every document and item with at least ``share`` of the item's passage
    in one stretch of the text, and the characters [start, end) of that stretch; a pair has a row for each stretch.

    Null and empty texts and passages without a word leak nothing. Repeated rows are each searched. Whole texts are
    indexed. The test items (a table of fixed size, at most MOST_ITEM_CHARACTERS; more is an error) go to all tasks, at most BLOCK_ITEMS a pass.
    """
    size = eval_items.agg(F.coalesce(F.sum(F.length(passage_col)), F.lit(0))).first()[0]
    if size > MOST_ITEM_CHARACTERS:
        raise ValueError(f"passages of {size} characters: search them in parts of at most {MOST_ITEM_CHARACTERS}")
    rows = [(r[0], r[1]) for r in eval_items.select(item_col, passage_col).where(F.col(passage_col).isNotNull()).collect()]
    lean = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t <> ''")
    key, item_kind = lean.schema["i"].dataType, eval_items.schema[item_col].dataType
    schema = T.StructType([T.StructField("i", key), T.StructField("item", item_kind), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    out = None
    for at in range(0, max(1, len(rows)), BLOCK_ITEMS):
        part = map_arrow(lean, _searcher(Items.of(rows[at : at + BLOCK_ITEMS]), share), schema)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("i").alias(id_col), F.col("item").alias(item_col), "start", "end")


def _searcher(items: Items, share: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["i", "item", "start", "end"]
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = search_shard([w for _, w, _ in held], items, share)
            if found:
                spans = {d: words_of(held[d][2]) for d in {d for d, *_ in found}}  # places only of texts that leak
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([held[d][0] for d, *_ in found], key_type),
                        pa.array([items.ids[i] for _, i, *_ in found]),
                        pa.array([spans[d][a][1] for d, _, a, _, _ in found], pa.int32()),
                        pa.array([spans[d][b][2] for d, _, _, b, _ in found], pa.int32()),
                    ],
                    names=names,
                )

        key_type = None
        for part in by_size(batches, 1, 4 << 20):
            key_type = part.schema[0].type
            numbers = items.numbers
            for key, text in zip(part.column(0).to_pylist(), consistent(part.column(1))[0].to_pylist()):
                words = plain_words(text)
                if not words:
                    continue
                held.append((key, np.fromiter(map(numbers.get, words, repeat(OTHER)), np.int64, len(words)), text))
                size += len(words) + 1
                if size >= SHARD_WORDS and items.ids:
                    yield from flush()
                    held, size = [], 0
        if held and items.ids:
            yield from flush()

    return run


def leaked_documents(df: DataFrame, eval_items: DataFrame, **columns: str) -> DataFrame:
    """One row for each document with a leak: its items, and the merged spans of characters to remove."""
    id_col = columns.get("id_col", "doc_id")
    item_col = columns.get("item_col", "item_id")
    found = leaks(df, eval_items, **columns)
    spans = found.groupBy(id_col).agg(F.sort_array(F.collect_set(item_col)).alias("items"), F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    join = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )
    return spans.withColumn("spans", F.when(F.size("spans") > 0, join).otherwise(F.col("spans")))
