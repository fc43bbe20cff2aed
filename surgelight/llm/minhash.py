"""Near-duplicate records with small edits: MinHash banding, then verification on the full sets of words.

1. One text per identifier, in the consistent form, becomes its sorted set of distinct words; sets of equal words are one
   class, known by a 64-bit fingerprint. The table (id, class, words) is written once to the shared folder.
2. Every set is banded on all its words, so whether a pair is found depends on nothing but the two sets. Words that most
   texts have fill the buckets with pairs that step 4 rules out.
3. Each task signs its classes once and packs, for every target partition, the band hashes (sorted) and the class,
   size and word bitmap of the records behind them into one binary row. The shuffle carries these rows.
   A key that very many records have is cut into cells before that: its records fall into g groups, each pair of groups
   is a cell with a key of its own, and a record goes to the g cells of its group. So no task gathers a hot bucket. Which
   keys are hot is told by one record in 2,048; a wrong guess costs time and loses nothing, as every bucket is worked off in full.
4. A partition sorts its band hashes; records of equal hash are compared if their sizes and bitmaps allow the
   similarity. Both tests are exact bounds (the number of differing bits never exceeds that of differing words), so they lose
   no pair. A bucket of more than BLOCK records is cut into pairs of blocks, which are spread over all tasks.
5. The remaining class pairs are made distinct and verified on the full sets.

Bands: with r rows each, the least number that finds a pair at the threshold with probability ``recall``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surgelight.llm.batches import by_size
from surgelight.llm.lookalikes import consistent
from surgelight.session import checkpointed, map_arrow, materialised, shuffle_partitions

#: Records of one bucket that are compared in place; larger buckets are cut into blocks of this size.
BLOCK = 8192
#: Records of a group of a hot key; a key is hot from twice as many on. One record in SAMPLE tells which are.
GROUP, SAMPLE = 1 << 15, 2048
#: Hot keys that are told to all tasks at most (the hottest).
HOT_KEYS = 1 << 18
#: From this many records on a bucket is compared as a matrix.
MATRIX = 48
#: Classes packed together at most, and bytes of their words.
PACK, PACK_BYTES = 1 << 15, 16 << 20
#: Band hashes that one task brings together, about.
TASK_HASHES = 1_500_000
_ENTRY = np.dtype([("cls", "<i8"), ("bits", "<u8"), ("n", "<u2")])
#: What is sent: an entry with 64 more bits of the bitmap.
_SENT = np.dtype([*_ENTRY.descr, ("more", "<u8")])


def bands_for(threshold: float, rows: int, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def _hash_words(words: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def word_sets(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, cls, words) of every row with at least ``min_words`` distinct words; ``words`` is the sorted set, joined by spaces."""
    lean = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import xxhash

        cut = regex.compile(r"[\p{L}\p{Nd}]+")
        for part in by_size(batches, 1, PACK_BYTES):
            ids, kept, classes, sets = part.column(0), [], [], []
            for i, text in enumerate(consistent(part.column(1))[0].to_pylist()):
                words = set(cut.findall(text.lower())) if text else ()
                if len(words) >= min_words:
                    joined = " ".join(sorted(words))
                    kept.append(i)
                    classes.append(xxhash.xxh3_64_intdigest(joined) - (1 << 63))
                    sets.append(joined)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept, pa.int64())), pa.array(classes, pa.int64()), pa.array(sets, pa.string())], names=["id", "cls", "words"])

    schema = T.StructType([T.StructField("id", lean.schema["id"].dataType), T.StructField("cls", T.LongType()), T.StructField("words", T.StringType())])
    return map_arrow(lean, run, schema)


def _split(sets: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the code of every occurrence, and where each set starts."""
    lists = pc.split_pattern(sets, " ")
    words = lists.flatten().dictionary_encode()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


class Signer:
    """Band hashes of word sets."""

    def __init__(self, rows: int, bands: int, seed: int = 20250303):
        rng = np.random.default_rng(seed)
        self.rows, self.bands = rows, bands
        self.a = rng.integers(1, 2**63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, rows * bands, dtype=np.uint64)

    def keys(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """[bands, sets] 64-bit keys; no set may be empty."""
        out = np.empty((self.bands, len(starts)), np.uint64)
        with np.errstate(over="ignore"):
            for band in range(self.bands):
                key = np.full(len(starts), band + 1, np.uint64)
                for h in range(band * self.rows, (band + 1) * self.rows):
                    value = ((hashes * self.a[h] + self.b[h]) >> np.uint64(32)).astype(np.uint32)
                    least = np.minimum.reduceat(value[codes], starts).astype(np.uint64)
                    key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                out[band] = key
        return out

    def sign(self, sets: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, set) of every band, and the two halves of the bitmap and the size of each set."""
        words, codes, edges = _split(sets)
        hashes = _hash_words(words)
        sizes = np.diff(edges)
        place = hashes >> np.uint64(57)
        bit = np.uint64(1) << (place & np.uint64(63))
        halves = [np.bitwise_or.reduceat(np.where(place >> np.uint64(6) == half, bit, np.uint64(0))[codes], edges[:-1]) for half in (0, 1)]
        keys = self.keys(hashes, codes, edges[:-1])
        return keys.ravel(), np.tile(np.arange(len(sets)), self.bands), *halves, sizes


def _pack(hashes: np.ndarray, records: np.ndarray, entries: np.ndarray) -> bytes:
    """Sorted hashes, the record of each, and the records used."""
    order = np.argsort(hashes, kind="stable")
    used, index = np.unique(records[order], return_inverse=True)
    body = np.array([len(order), len(used)], "<u4").tobytes() + np.diff(hashes[order], prepend=np.uint32(0)).astype("<u4").tobytes() + index.astype("<u2").tobytes() + entries[used].tobytes()
    return pa.compress(body, codec="zstd", asbytes=True) + np.array([len(body)], "<u4").tobytes()


def _unpack(row: bytes, kind: np.dtype = _ENTRY) -> tuple[np.ndarray, np.ndarray]:
    body = pa.decompress(row[:-4], decompressed_size=int(np.frombuffer(row[-4:], "<u4")[0]), codec="zstd", asbytes=True)
    n, used = np.frombuffer(body[:8], "<u4").astype(int)
    hashes = np.cumsum(np.frombuffer(body, "<u4", n, 8), dtype=np.uint32)
    index = np.frombuffer(body, "<u2", n, 8 + 4 * n)
    return hashes, np.frombuffer(body, kind, used, 8 + 6 * n)[index]


def _may_match(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """False only where the sets cannot reach the threshold: sizes too far apart, or too many differing bits."""
    na, nb = a["n"].astype(np.float32), b["n"].astype(np.float32)
    unlike = (1 - threshold) / (1 + threshold) * (na + nb) + 1e-3
    bits = np.bitwise_count(a["bits"] ^ b["bits"])
    if "more" in a.dtype.names:
        bits += np.bitwise_count(a["more"] ^ b["more"])
    return (a["cls"] != b["cls"]) & (np.abs(na - nb) <= unlike) & (bits <= unlike)


def _matrix_pairs(left: np.ndarray, right: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes of the pairs that may match: of ``left`` with ``right``, or within ``left``. By the same bounds as ``_may_match``, sets in order of size, so that sizes too far apart are not looked at."""
    rows = left[np.argsort(left["n"], kind="stable")]
    columns = rows if right is None else right[np.argsort(right["n"], kind="stable")]
    sizes = columns["n"].astype(np.float32)
    planes = [(rows[f].copy(), columns[f].copy()) for f in ("bits", "more") if f in left.dtype.names]
    a, b = rows["cls"].copy(), columns["cls"].copy()
    factor = np.float32((1 - threshold) / (1 + threshold))
    step = max(1, (1 << 19) // max(1, len(columns)))
    for at in range(0, len(rows), step):
        own = rows["n"][at : at + step].astype(np.float32)
        low = at if right is None else int(np.searchsorted(sizes, np.floor(own[0] * threshold) - 1))
        high = int(np.searchsorted(sizes, np.ceil(own[-1] / threshold) + 1, side="right"))
        if low >= high:
            continue
        unlike = factor * (own[:, None] + sizes[None, low:high]) + np.float32(1e-3)
        differ = sum(np.bitwise_count(x[at : at + step, None] ^ y[None, low:high]) for x, y in planes)
        ok = (differ <= unlike) & (np.abs(own[:, None] - sizes[None, low:high]) <= unlike)
        i, j = np.nonzero(ok)
        i, j = i + at, j + low
        fit = a[i] != b[j] if right is not None else j > i
        yield a[i[fit]], b[j[fit]]


def _bucket_pairs(hashes: np.ndarray, entries: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray] | tuple[bytes, bytes | None]]:
    """Pairs of records with equal hash; blocks (as bytes) of buckets that are too large to compare here."""
    order = np.lexsort((entries["cls"], hashes))
    hashes, entries = hashes[order], entries[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (entries["cls"][1:] != entries["cls"][:-1])
    hashes, entries = hashes[fresh], entries[fresh]
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, int)
    sizes = np.diff(np.append(starts, len(hashes)))
    small = (sizes > 1) & (sizes < MATRIX)
    # small buckets: step d compares each record with the one d places on, all buckets at once
    place = np.arange(len(hashes)) - np.repeat(starts, sizes)
    left_over = np.repeat(np.where(small, sizes, 0), sizes) - place - 1
    at = np.flatnonzero(left_over > 0)
    step = 1
    while len(at):
        for part in np.array_split(at, max(1, len(at) >> 20)):
            a, b = entries[part], entries[part + step]
            ok = _may_match(a, b, threshold)
            if ok.any():
                yield a["cls"][ok], b["cls"][ok]
        step += 1
        at = at[left_over[at] >= step]
    for s, n in zip(starts[sizes >= MATRIX], sizes[sizes >= MATRIX]):
        if n <= BLOCK:
            yield from _matrix_pairs(entries[s : s + n], None, threshold)
            continue
        blocks = [entries[i : min(i + BLOCK, s + n)] for i in range(s, s + n, BLOCK)]
        for i, left in enumerate(blocks):
            yield left.tobytes(), None
            for right in blocks[i + 1 :]:
                yield left.tobytes(), right.tobytes()


class HotKeys:
    """Band keys that many records have, each with its number of groups."""

    def __init__(self, keys: np.ndarray, groups: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.groups = keys[order], groups[order]

    def cells(self, keys: np.ndarray, records: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and records, those of hot keys replaced by the cells of the record's group."""
        if not len(self.keys):
            return keys, records
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hot = self.keys[at] == keys
        g = self.groups[at[hot]]
        key, record = np.repeat(keys[hot], g), np.repeat(records[hot], g)
        other = (np.arange(len(key)) - np.repeat(np.cumsum(g) - g, g)).astype(np.uint64)
        with np.errstate(over="ignore"):
            mixed = (classes[record].astype(np.uint64) ^ key) * np.uint64(0x9E3779B97F4A7C15)
            own = (mixed >> np.uint64(33)) % np.repeat(g, g).astype(np.uint64)
            cell = (key ^ (np.minimum(own, other) * np.uint64(0xBF58476D1CE4E5B9) + np.maximum(own, other) + np.uint64(1))) * np.uint64(0x94D049BB133111EB)
            cell ^= cell >> np.uint64(29)
        return np.concatenate([keys[~hot], cell]), np.concatenate([records[~hot], record])


def hot_keys(sets: DataFrame, signer: Signer) -> HotKeys:
    """Keys that one class in SAMPLE lets expect in more than two groups of records."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, 0, PACK_BYTES):
            keys, *_ = signer.sign(part.column(0).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    drawn = sets.where(F.pmod(F.xxhash64("cls"), F.lit(SAMPLE)) == 0).dropDuplicates(["cls"]).select("words")
    counts = map_arrow(drawn, sign, "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2 * GROUP / SAMPLE)
    rows = counts.orderBy(F.desc("n"), "key").limit(HOT_KEYS).collect()
    return HotKeys(np.array([r.key for r in rows], np.int64).view(np.uint64), np.array([-(-r.n * SAMPLE // GROUP) for r in rows], np.int64))


def candidate_pairs(sets: DataFrame, threshold: float, rows: int, recall: float) -> DataFrame:
    """Distinct (a, b), a < b: classes with a common band whose sizes and bitmaps allow the similarity."""
    spark = sets.sparkSession
    bands = bands_for(threshold, rows, recall)
    parts = max(shuffle_partitions(spark), math.ceil(sets.count() * bands / TASK_HASHES))
    signer = Signer(rows, bands)
    hot = hot_keys(sets, signer)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            together = pa.Table.from_batches(held)
            classes = together.column("cls").combine_chunks().to_numpy(zero_copy_only=False)
            classes, first = np.unique(classes, return_index=True)
            words = pa.chunked_array(together.column("words").chunks).combine_chunks().cast(pa.large_string()).take(pa.array(first))
            keys, records, bits, more, sizes = signer.sign(words.cast(pa.string()))
            entries = np.empty(len(classes), _SENT)
            entries["cls"], entries["bits"], entries["more"], entries["n"] = classes, bits, more, np.minimum(sizes, 65535)
            keys, records = hot.cells(keys, records, classes)
            target = (keys % np.uint64(parts)).astype(np.int64)
            hashes = (keys >> np.uint64(32)).astype(np.uint32)
            order = np.argsort(target, kind="stable")
            edges = np.searchsorted(target[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(edges)):
                own = order[edges[p] : edges[p + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_pack(hashes[own], records[own], entries)], pa.binary())], names=["p", "packed"])

        size = 0
        for part in by_size(batches, 1, PACK_BYTES):
            held.append(part)
            size += pc.sum(pc.binary_length(part.column("words"))).as_py()
            if sum(map(len, held)) >= PACK or size >= PACK_BYTES:
                yield from flush()
                held.clear()
                size = 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = [_unpack(x, _SENT) for batch in batches for x in batch.column("packed").to_pylist()]
        if not packs:
            return
        hashes, entries = np.concatenate([h for h, _ in packs]), np.concatenate([e for _, e in packs])
        del packs
        seen_a, seen_b, held = [], [], 0
        for left, right in _bucket_pairs(hashes, entries, threshold):
            if isinstance(left, bytes):
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([left], pa.binary()), pa.array([right], pa.binary())], names=["a", "b", "l", "r"])
                continue
            seen_a.append(left)
            seen_b.append(right)
            held += len(left)
            if held >= 1 << 20:
                yield _pair_batch(seen_a, seen_b)
                seen_a, seen_b, held = [], [], 0
        if held:
            yield _pair_batch(seen_a, seen_b)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = batch.columns
            plain = a.is_valid()
            yield pa.RecordBatch.from_arrays([a.filter(plain), b.filter(plain)], names=["a", "b"])
            for x, y in zip(left.drop_null().to_pylist(), right.filter(pc.invert(plain)).to_pylist()):
                block = np.frombuffer(x, _SENT)
                for one, two in _matrix_pairs(block, None if y is None else np.frombuffer(y, _SENT), threshold):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])

    packed = map_arrow(sets.select("cls", "words"), sign, "p int, packed binary").repartitionById(parts, "p")
    met = map_arrow(packed.select("packed"), meet, "a bigint, b bigint, l binary, r binary")
    spread = met.repartition(parts, F.when(F.col("a").isNotNull(), F.xxhash64("a", "b")).otherwise(F.xxhash64("l", "r")))
    return map_arrow(spread, finish, "a bigint, b bigint").distinct()


def _pair_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    both = np.stack([np.concatenate(a), np.concatenate(b)])
    both = np.unique(np.sort(both, axis=0), axis=1)
    none = pa.nulls(both.shape[1], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), none, none], names=["a", "b", "l", "r"])


def similar_classes(sets: DataFrame, threshold: float, rows: int, recall: float) -> DataFrame:
    """(a, b), a < b: pairs of classes whose full sets reach the threshold."""
    pairs = candidate_pairs(sets, threshold, rows, recall)
    one = sets.select("cls", "words").dropDuplicates(["cls"])
    left = pairs.join(one.select(F.col("cls").alias("a"), F.col("words").alias("wa")), "a")
    both = left.join(one.select(F.col("cls").alias("b"), F.col("words").alias("wb")), "b")
    x, y = F.split("wa", " "), F.split("wb", " ")
    common = F.size(F.array_intersect(x, y))
    return both.where(common >= F.lit(threshold) * (F.size(x) + F.size(y) - common)).select("a", "b")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, order_col: str, min_words: int = 10, threshold: float = 0.6, rows: int = 4, recall: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``members`` (id, cls) of every record with ``min_words`` distinct words, ``links`` (a, b) between classes.

    Records of one identifier count once, with the text of lowest ``order_col``. Null identifiers, null or short texts
    are in neither table. Equal sets of words are one class, so exact copies are members of it and no links.
    """
    keyed = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(order_col).alias("o")).where("id IS NOT NULL")
    single = keyed.groupBy("id").agg(F.min_by("text", F.struct(F.col("o").isNull(), "o", "text")).alias("text"))
    sets = materialised(word_sets(single, "id", "text", min_words), "sets")
    return sets.select("id", "cls"), similar_classes(sets, threshold, rows, recall)


def near_duplicate_pairs(df: DataFrame, id_col: str = "id", text_col: str = "text", order_col: str = "seq", **options: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of different identifiers whose texts reach the threshold, exact copies included."""
    members, links = near_duplicates(df, id_col, text_col, order_col, **options)
    left = links.join(members.select(F.col("cls").alias("a"), F.col("id").alias("x")), "a").select("b", "x")
    across = left.join(members.select(F.col("cls").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    many = members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls")
    again = members.join(many, "cls", "left_semi")
    within = again.select("cls", F.col("id").alias("x")).join(again.select("cls", F.col("id").alias("y")), "cls").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicate_groups(df: DataFrame, id_col: str = "id", text_col: str = "text", order_col: str = "seq", **options: float) -> DataFrame:
    """(id, group, links) for every record with enough words: the least identifier among all that any chain of links and copies leads to, and the number of other classes its class is linked with.

    Groups spread by alternating large-star and small-star steps, each checkpointed, until nothing changes.
    """
    members, links = near_duplicates(df, id_col, text_col, order_col, **options)
    links = checkpointed(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    groups = connected(links)
    # one row for each class from here: its group, and the least identifier of that
    own = members.groupBy("cls").agg(F.min("id").alias("least")).join(groups, "cls", "left").select("cls", "least", F.coalesce("group", "cls").alias("g"))
    first = own.groupBy("g").agg(F.min("least").alias("group"))
    classes = own.join(first, "g").join(degree, "cls", "left").select("cls", "group", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(classes, "cls").select("id", "group", "links")


def connected(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(cls, group): the least node connected with each node of ``links`` (a, b)."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    for _ in range(most_rounds):
        # large star: larger neighbours are linked to the least neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours and the node itself are linked to the least neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        edges = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = checkpointed(edges)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return edges.groupBy("u").agg(F.min("v").alias("group")).select(F.col("u").alias("cls"), "group").union(edges.select(F.col("v").alias("cls"), F.col("v").alias("group")).distinct())
        before = state
    raise RuntimeError("the groups did not settle")
