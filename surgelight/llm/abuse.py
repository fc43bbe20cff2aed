"""Abusive, hateful or sexual content: a linear classifier trained by non-negative positive-unlabelled learning.

Confirmed abusive documents are the positive examples; all other documents of the training sample are unlabelled, a
mixture in which the share of abuse (the class prior) is small and estimated. The risk is
``prior * R(P, +) + max(0, R(U, -) - prior * R(P, -))``: what the positives would cost as negatives is taken out of the
unlabelled risk, and where the rest would turn negative it counts as nothing. The loss is the logistic one, as negative cut off
at a bound for all examples alike (the estimator needs a bounded loss: without it single passages run away). Documents
judged harmless are unlabelled like all others; they only set the threshold.

A document is a bag of passages (sentences and lines). Its score is that of its worst passage, and the passage that
speaks for a positive document is chosen anew by the model of the round before, so that the model learns passages although
only documents are labelled. Features of a passage are its words in plain spelling (spaced, masked, lengthened and
figure-for-letter forms are undone), the same without doubled letters, and pairs of near words.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surgelight.llm.batches import by_size
from surgelight.llm.lookalikes import consistent
from surgelight.session import map_arrow

WORD_BITS, PAIR_BITS = 18, 20
_CUT = regex.compile(r"(?<=[.!?。！？…])[\"”’)]*\s+|[\n\r]+|(?<=[。！？])|\s[/|]\s")
_TOKEN = regex.compile(r"https?://\S+|www\.\S+|@\w+|\S+")
_SPACED = regex.compile(r"(?<![^\s\"“(])(?:[^\W\d_][ .\-_*·]){2,}[^\W\d_](?![\w])")
_FIGURES = str.maketrans("0134578@$!", "oieastbasi")
_EDGE = regex.compile(r"^[^\w*@$!]+|[^\w*@$]+$")
_MASK = regex.compile(r"[\p{L}]+[*#%x\p{So}]*\*[*#%]*\p{L}*|\p{L}*\*{2,}\p{L}*|\p{L}[#%]{2,}\p{L}*")
_INNER = regex.compile(r"(?<=\p{L})[.\-_·'’*|]+(?=\p{L})")
_DOUBLE = regex.compile(r"(\p{L})\1+")
_LONG = regex.compile(r"(\p{L})\1{2,}")


def _plain(t: str) -> tuple[str, ...]:
    """The words of one token without spaces."""
    if t[0] == "@" and len(t) > 3:
        return ("@",)
    if t.startswith(("http", "www.")):
        return ()
    t = _EDGE.sub("", t)
    if not t:
        return ()
    if _MASK.fullmatch(t):
        letters = regex.sub(r"[^\p{L}]", "", t)
        return ("*", letters[:1] + "*" + letters[-1:] if letters else "*")
    bare = t.strip("*@$!")
    t = bare if bare.isalpha() else t
    if t.isalpha():
        return (_LONG.sub(r"\1", t),)
    if regex.search(r"\p{L}", t) and regex.search(r"[\d@$!]", t) and not regex.search(r"\d{4}", t):
        t = t.translate(_FIGURES)
    joined = _INNER.sub("", t)
    if joined.isalpha():
        parts = tuple(w for w in regex.findall(r"\p{L}{4,}", t)) if joined != t and regex.search(r"[-'’]", t) else ()
        return (_LONG.sub(r"\1", joined), *parts)
    return tuple(_LONG.sub(r"\1", w) for w in regex.findall(r"\p{L}+", t))


_KNOWN: dict[str, tuple[str, ...]] = {}


def plain_words(passage: str) -> list[str]:
    """The words of a passage in plain spelling, lower-cased."""
    if _SPACED.search(passage):
        passage = _SPACED.sub(lambda m: regex.sub(r"[^\p{L}]", "", m[0]), passage)
    out: list[str] = []
    for t in _TOKEN.findall(passage.lower()):
        words = _KNOWN.get(t)
        if words is None:
            words = _plain(t)
            if len(_KNOWN) > 200_000:  # what is kept saves time only
                _KNOWN.clear()
            if len(t) < 40:
                _KNOWN[t] = words
        out += words
    return out


def passages(text: str) -> list[list[str]]:
    out = [w for w in (plain_words(p) for p in _CUT.split(text) if p) if w]
    return out or [[]]


def _hash(s: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s)


class Vocabulary:
    """Numbers of distinct words, with the two hashed features of each: the word, and the word without doubled letters."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.hashes: list[int] = []
        self.shapes: list[int] = []

    def add(self, word: str) -> int:
        n = self.number.get(word)
        if n is None:
            n = self.number[word] = len(self.hashes)
            self.hashes.append(_hash(word))
            self.shapes.append(_hash("~" + _DOUBLE.sub(r"\1", word)))
        return n

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        cut = np.uint64((1 << WORD_BITS) - 1)
        return tuple((np.array(x, np.uint64) & cut).astype(np.int64) for x in (self.hashes, self.shapes))


@dataclass
class Bags:
    """Passages of documents as flat arrays."""

    words: np.ndarray  # word number of every occurrence
    passage: np.ndarray  # passage of every occurrence
    document: np.ndarray  # document of every passage
    pairs: np.ndarray  # hashed pair of near words
    pair_passage: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None], vocabulary: Vocabulary) -> Bags:
        words, sizes, document = [], [], []
        for d, text in enumerate(texts):
            for p in passages(text) if text else [[]]:
                words += [vocabulary.add(w) for w in p]
                sizes.append(len(p))
                document.append(d)
        w = np.array(words, np.int64)
        passage = np.repeat(np.arange(len(sizes)), sizes)
        h = np.array(vocabulary.hashes, np.uint64)[w] if len(w) else np.empty(0, np.uint64)
        pairs, owners = [], []
        with np.errstate(over="ignore"):
            for gap in (1, 2):
                if len(w) > gap:
                    same = passage[gap:] == passage[:-gap]
                    mixed = (h[:-gap] * np.uint64(0x9E3779B97F4A7C15 + 2 * gap)) ^ (h[gap:] * np.uint64(0xC2B2AE3D27D4EB4F))
                    pairs.append((mixed[same] >> np.uint64(64 - PAIR_BITS)).astype(np.int64))
                    owners.append(passage[gap:][same])
        none = np.empty(0, np.int64)
        return cls(w, passage, np.array(document, np.int64), np.concatenate(pairs) if pairs else none, np.concatenate(owners) if owners else none)


@dataclass
class Model:
    """Weights of words and of pairs; the score at which a document counts as abusive."""

    word: np.ndarray
    pair: np.ndarray
    bias: float
    threshold: float = 0.0

    def saved(self) -> bytes:
        """For storing a trained model; ``restored`` reads it."""
        out = io.BytesIO()
        at = [np.flatnonzero(x) for x in (self.word, self.pair)]
        np.savez_compressed(out, w=self.word[at[0]], p=self.pair[at[1]], at_w=at[0], at_p=at[1], rest=np.array([self.bias, self.threshold]))
        return out.getvalue()

    @classmethod
    def restored(cls, stored: bytes) -> Model:
        model, found = cls.empty(), np.load(io.BytesIO(stored))
        model.word[found["at_w"]], model.pair[found["at_p"]] = found["w"], found["p"]
        model.bias, model.threshold = found["rest"].tolist()
        return model

    @classmethod
    def empty(cls) -> Model:
        return cls(np.zeros(1 << WORD_BITS), np.zeros(1 << PAIR_BITS), -2.0)

    def passage_scores(self, bags: Bags, features: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        n = len(bags.document)
        own = self.word[features[0]] + self.word[features[1]]
        return self.bias + np.bincount(bags.passage, own[bags.words], n) + np.bincount(bags.pair_passage, self.pair[bags.pairs], n)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The score of the worst passage of each text; the lowest possible for a null or empty one."""
        vocabulary = Vocabulary()
        bags = Bags.of(texts, vocabulary)
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, bags.document, self.passage_scores(bags, vocabulary.features()))
        empty = np.bincount(bags.document, np.bincount(bags.passage, minlength=len(bags.document)), len(texts)) == 0
        out[empty] = self.bias
        return out


def sample(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", annotation: str = "abusive", most: int = 3000, most_unlabelled: int = 8000) -> tuple[list, np.ndarray, np.ndarray]:
    """Texts for training, and which are confirmed abusive and confirmed harmless.

    Bounded by parameters: about ``most`` documents judged abusive, as many judged harmless, and ``most_unlabelled``
    others, each drawn by a hash of the identifier over the whole table. A document is judged by the mean of its
    judgements; nulls do not count, and a tie is no judgement.
    """
    judged = labels.where(F.col(annotation).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.avg(annotation).alias("a")).where("i IS NOT NULL AND a <> 0.5")
    n = judged.agg(F.count_if(F.col("a") > 0.5).alias("p"), F.count_if(F.col("a") < 0.5).alias("q")).first()
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1_000_000)) / 1e6
    drawn = judged.where(place("i") < F.when(F.col("a") > 0.5, most / max(1, n.p)).otherwise(most / max(1, n.q)))
    texts = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    labelled = texts.join(drawn, "i").select("t", "a")  # about 2 * most rows
    share = min(1.0, most_unlabelled / max(1, texts.count()))
    others = texts.where((place("i") < share) | F.col("i").isNull()) if share >= 1 else texts.where(place("i") < share)
    others = others.join(judged.select("i").where(place("i") < share), "i", "left_anti").select("t", F.lit(None).cast("double").alias("a"))
    rows = labelled.union(others).orderBy(F.xxhash64("t"), "a").collect()
    a = np.array([np.nan if r.a is None else r.a for r in rows], float)
    return consistent(pa.array([r.t for r in rows], pa.string()))[0].to_pylist(), a > 0.5, a < 0.5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[str | None], positive: np.ndarray, negative: np.ndarray, prior: float = 0.01, lean: float = 1.5, rounds: int = 3, steps: int = 120, rate: float = 2.0, shrink: float = 1e-3, bound: float = 4.0) -> Model:
    """A model from texts of which some are confirmed abusive (``positive``); all others are unlabelled. Those confirmed harmless
    (``negative``) set the threshold.

    ``prior`` is the first guess of the share of abusive passages; later rounds estimate it from the shares of positives
    and of confirmed harmless documents above the threshold.
    """
    vocabulary = Vocabulary()
    bags = Bags.of(texts, vocabulary)
    n = len(bags.document)
    model = Model.empty()
    if not positive.any() or not len(bags.words):
        model.threshold = np.inf
        return model
    features = vocabulary.features()
    unlabelled, trusted = ~positive[bags.document], positive
    # first choice: the passage with the words that set positive documents apart from the others
    def word_documents(of: np.ndarray) -> np.ndarray:
        use = of[bags.document][bags.passage]
        seen = np.unique(bags.words[use] * len(texts) + bags.document[bags.passage[use]])
        return np.bincount(seen // len(texts), minlength=len(vocabulary.hashes))

    rate_p = (word_documents(positive) + 0.05) / (positive.sum() + 1)
    rate_u = (word_documents(~positive) + 0.5) / ((~positive).sum() + 1)
    odds = np.log(rate_p / rate_u)
    odds = np.where(word_documents(positive) >= 2, odds, 0)
    score = np.bincount(bags.passage, np.maximum(odds, 0)[bags.words], n)
    share = prior
    for _round in range(rounds):
        order = np.lexsort((score, bags.document))
        last = np.append(np.flatnonzero(np.diff(bags.document[order])), n - 1)
        speaks = np.zeros(n, bool)
        speaks[order[last]] = True
        chosen = speaks & trusted[bags.document]
        weight_p = chosen / max(1, chosen.sum())
        weight_u = unlabelled / max(1, unlabelled.sum())
        model = Model.empty()
        speed = [np.zeros_like(model.word), np.zeros_like(model.pair)]
        for _ in range(steps):
            x = model.passage_scores(bags, features)
            s = _sigmoid(x)
            # the loss as negative, log(1 + exp(x)), is constant beyond the bound, for all alike
            low = np.logaddexp(0, np.minimum(x, bound))
            g = share * weight_p * (s - 1)
            if float(((weight_u - share * weight_p) * low).sum()) > 0:  # else the negative part counts as nothing
                g += (weight_u - share * weight_p) * s * (x < bound)
            g = g / share
            by_word = np.bincount(bags.words, g[bags.passage], len(vocabulary.hashes))
            gradients = (
                np.bincount(features[0], by_word, len(model.word)) + np.bincount(features[1], by_word, len(model.word)),
                np.bincount(bags.pairs, g[bags.pair_passage], len(model.pair)),
            )
            for parameter, gradient, v in zip((model.word, model.pair), gradients, speed):
                v *= 0.9
                v -= rate * 0.1 * (gradient + shrink * parameter)
                parameter += v
            model.bias -= 0.1 * rate * float(g.sum())
        score = model.passage_scores(bags, features)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, bags.document, score)
        # a positive document without any passage that speaks for it was most likely judged wrongly
        trusted = positive & (best > model.bias) if (positive & (best > model.bias)).any() else positive
        model.threshold = _threshold(best, trusted, negative)
        hit, false = (best[positive] > model.threshold).mean(), (best[negative] > model.threshold).mean() if negative.any() else 0.0
        rest = ~(positive | negative)
        if rest.any() and hit > false:
            documents = max(1e-3, ((best[rest] > model.threshold).mean() - false) / (hit - false))
            share = float(np.clip(lean * documents * len(texts) / n, 1e-4, 0.2))
    return model


def _threshold(best: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> float:
    """The score that best parts confirmed abusive from confirmed harmless documents (F1, harmless ones weighted up to their true share)."""
    if not negative.any():
        return 0.0
    p, q = np.sort(best[positive]), np.sort(best[negative])
    at = np.unique(np.concatenate([p, q]))
    cuts = (at[1:] + at[:-1]) / 2 if len(at) > 1 else at
    hit = 1 - np.searchsorted(p, cuts, side="right") / len(p)
    false = 1 - np.searchsorted(q, cuts, side="right") / len(q)
    odds = 12.0
    f1 = 2 * hit / (1 + hit + odds * false)
    return float(cuts[int(np.argmax(f1))])


#: Models of this driver by the fingerprint of their sample.
_FITTED: dict[str, Model] = {}


def fitted(df: DataFrame, labels: DataFrame, **options: float) -> Model:
    """A model trained on a bounded sample of the table and its judgements. Without any confirmed case nothing counts as abusive.

    The same sample gives the same model, so it is trained once in a driver and kept (a few models at most).
    """
    texts, positive, negative = sample(df, labels, **options)
    mark = hashlib.sha256(repr(texts).encode("utf-8", "replace") + positive.tobytes() + negative.tobytes()).hexdigest()
    if mark not in _FITTED:
        while len(_FITTED) >= 4:
            _FITTED.pop(next(iter(_FITTED)))
        _FITTED[mark] = train(texts, positive, negative)
    return _FITTED[mark]


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without ``text_col``, with ``score`` (of the worst passage, 0 to 1) and ``abusive``.

    Every row is scored on its whole text. A null or empty text has the score of a passage without words and is not
    abusive. Columns called ``score`` or ``abusive`` are replaced; all others pass through. No shuffle.
    """
    names = [c for c in df.columns if c not in ("score", "abusive", text_col)]
    inner = df.select(F.col(f"`{text_col}`").alias("t"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    lean = Model(model.word.astype(np.float32), model.pair.astype(np.float32), model.bias, model.threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, 0, 2 << 20):
            raw = lean.scores(consistent(part.column(0))[0].to_pylist())
            score = _sigmoid(raw - lean.threshold) if np.isfinite(lean.threshold) else np.zeros(len(raw))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(score), pa.array(raw > lean.threshold)], names=[*part.schema.names[1:], "score", "abusive"])

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in inner.schema.fields[1:]] + [T.StructField("score", T.DoubleType()), T.StructField("abusive", T.BooleanType())])
    return map_arrow(inner, run, schema).toDF(*names, "score", "abusive")


def rates(scores: DataFrame, source_col: str = "source") -> DataFrame:
    """For each source, a null one too: documents, abusive ones, and their share."""
    counts = scores.groupBy(source_col).agg(F.count(F.lit(1)).alias("n"), F.count_if("abusive").alias("n_abusive"))
    return counts.withColumn("rate", F.round(F.col("n_abusive") / F.col("n"), 6))
