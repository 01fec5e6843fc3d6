"""Language identification from averaged hashed subword embeddings.

A text is the average of the embeddings of its words' character n-grams (2 to 4
long, with word boundaries) and of the words themselves, hashed into
:data:`BUCKETS` rows; a linear softmax over that average gives the language.
Embeddings and softmax are trained by stochastic gradient descent in numpy on the
driver, from a bounded sample: :data:`PER_LANGUAGE` texts a language, fewer (but :data:`LEAST_PER_LANGUAGE`) where
there are so many languages that all would exceed :data:`MOST_ROWS`.  Texts of any length are drawn; their features are made whole
on the executors, so the driver gets at most :data:`BUCKETS` buckets and shares for each.  A tenth of
the sample is kept apart: there a temperature is fitted, and the probability below which a
prediction is rejected is set so that no more than :data:`LOST` of right predictions there go; as long as that
is less than one row, the level is the least probability of a right prediction, and one half at most.

Scoring reads every character of a text.  The softmax weights are folded into the
embeddings, so a bucket has one number for each language, and each distinct word is
scored once in a slice.

Defined cases: a text without a letter (null, empty, digits) is ``und`` with score 0 and rejected;
with no training text at all every text is ``und``; with one language every text with a letter is that language; equal
texts get equal results; more than :data:`MOST_LANGUAGES` languages raise ``ValueError``, as none may be left out silently;
other input columns are not read, and input columns named like a result are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from tesserae.llm import common

BUCKETS = 1 << 14
DIM = 16
SIZES = (2, 3, 4)
PER_LANGUAGE, LEAST_PER_LANGUAGE, MOST_ROWS = 1000, 50, 8000
#: The model has BUCKETS numbers for each language.
MOST_LANGUAGES = 2048
EPOCHS, BATCH, RATE, SPARSE_RATE, DECAY = 8, 32, 2.0, 50.0, 1e-4
LOST = 0.001
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
#: Numbers that aren't decimal, such as superscripts: word characters, but no letters.
_NUMBER = re.compile("[%s]+" % "".join(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isdecimal() and not c.isalpha()))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    words = _WORD.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return [part for w in words for part in _NUMBER.split(w) if part]


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the words, and the index of the word of each."""
    joined = "<" + "><".join(words) + ">"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # characters to the word's end
    found, owner = [], []
    h = np.zeros(len(points), np.uint64)
    rolling = points * _MIX
    for n in range(1, max(SIZES) + 1):
        step = np.roll(rolling, 1 - n)
        h = (h ^ (step + np.uint64(n))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        if n in SIZES:
            ok = left >= n
            found.append(h[ok])
            owner.append(word[ok])
    # A hash of all characters of the word, from their places counted from its end.
    plain = np.add.reduceat((points + (left.astype(np.uint64) << np.uint64(21))) * _MIX ^ (points << np.uint64(7)), np.cumsum(lengths) - lengths)
    found.append(plain * np.uint64(0x94D049BB133111EB))
    owner.append(np.arange(len(words)))
    return (np.concatenate(found) >> np.uint64(40)).astype(np.int64) % BUCKETS, np.concatenate(owner)


def document_features(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets of a text and the share of its features in each, or None without a letter."""
    words = words_of(text)
    if not words:
        return None
    bucket, times = np.unique(word_features(words)[0], return_counts=True)
    return bucket, (times / times.sum()).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages): embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    least: float  # predictions less likely than this are rejected

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _loss(p: np.ndarray, truth: np.ndarray, unsure: float) -> float:
    """Mean cross-entropy to targets that leave ``unsure`` to the other languages."""
    logs = np.log(p + 1e-12)
    of_truth = logs[np.arange(len(truth)), truth]
    return float(-((1 - unsure) * of_truth + unsure / (p.shape[1] - 1) * (logs.sum(1) - of_truth)).mean())


def fit(found: list[tuple[np.ndarray, np.ndarray]], langs: list[str], seed: int = 7) -> Model:
    """Train on texts' features (:func:`document_features`) and their languages."""
    languages = sorted(set(langs))
    place = {g: i for i, g in enumerate(languages)}
    rows = [(f, place[g]) for f, g in zip(found, langs, strict=True)]
    rng = np.random.default_rng(seed)
    k = len(languages)
    if not rows or k < 2:
        return Model(languages if rows else [], np.zeros((BUCKETS, k), np.float32), np.zeros(k), 1.0, 0.0)
    order = rng.permutation(len(rows))
    apart = order[: len(rows) // 10]
    use = order[len(rows) // 10 :]
    y = np.array([label for _, label in rows])

    def flat(own) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets and shares of some rows end to end, where each row begins, and the row of each."""
        sizes = np.array([len(rows[i][0][0]) for i in own])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.concatenate([rows[i][0][0] for i in own]), np.concatenate([rows[i][0][1] for i in own]), starts, np.repeat(np.arange(len(own)), sizes)

    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = np.zeros((DIM, k), np.float32)
    w[:] = rng.normal(0, 0.1, w.shape)
    bias = np.zeros(k, np.float32)
    counts = np.bincount(y[use], minlength=k)
    weight = counts.sum() / (k * np.maximum(counts, 1))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        use = rng.permutation(use)
        for start in range(0, len(use), BATCH):
            own = use[start : start + BATCH]
            t, (bucket, share, starts, row) = y[own], flat(own)
            hidden = np.add.reduceat(emb[bucket] * share[:, None], starts)
            p = _softmax(hidden @ w + bias)
            p[np.arange(len(t)), t] -= 1
            p *= (weight[t] / len(t))[:, None]
            grad = p @ w.T
            w -= rate * (hidden.T @ p + DECAY * w)
            bias -= rate * p.sum(0)
            push = (grad * (rate * SPARSE_RATE))[row] * share[:, None]
            for d in range(DIM):
                emb[:, d] -= np.bincount(bucket, weights=push[:, d], minlength=BUCKETS)
    table = emb @ w
    if not len(apart):
        apart = use
    bucket, share, starts, _ = flat(apart)
    logits = np.add.reduceat(table[bucket] * share[:, None], starts) + bias
    truth = y[apart]
    unsure = 1 / (len(truth) + 2)  # so that a sample without an error doesn't call for certainty
    heat = min(np.geomspace(0.02, 10, 80), key=lambda h: _loss(_softmax(logits / h), truth, unsure))
    p = _softmax(logits / heat)
    right = np.sort(p.max(1)[p.argmax(1) == truth])
    # At most one half: a text is never rejected that one language holds most of.
    least = min(float(right[int(LOST * len(right))]), 0.5) if len(right) else 0.0
    return Model(languages, table.astype(np.float32), bias, float(heat), least)


_SAMPLE = StructType([StructField("lang", StringType()), StructField("draw", LongType()), StructField("bucket", BinaryType()), StructField("share", BinaryType())])


def sample(docs: DataFrame, text: str, lang: str, key: str, per_language: int = PER_LANGUAGE) -> list:
    """Rows (lang, draw, bucket, share) of the first texts of each language by a hash of id and text, in that order.

    Languages are counted first; each row then stays with a probability (from its
    hash) that leaves about twice as many as are wanted, so only that many reach the last step.
    Texts without a letter teach nothing and have no row.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = known.groupBy(lang).count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return []
    most = min(per_language, max(LEAST_PER_LANGUAGE, MOST_ROWS // len(counts)))
    shares = docs.sparkSession.createDataFrame([(r[0], min(1.0, 2.0 * most / r["count"])) for r in counts], "__of string, __share double")
    few = known.join(F.broadcast(shares), F.col(lang) == F.col("__of"))
    few = few.withColumn("__draw", F.pmod(F.xxhash64(F.lit(17), key, text), F.lit(1 << 30))).filter(F.col("__draw") / float(1 << 30) < F.col("__share"))
    place = F.row_number().over(Window.partitionBy(lang).orderBy("__draw", key))
    few = few.withColumn("__place", place).filter(F.col("__place") <= most).select(F.col(lang).alias("lang"), F.col("__draw").alias("draw"), F.col(text).alias("text"))

    def start():
        def kernel(piece):
            made = [document_features(t) for t in common.texts(piece, "text")]
            return {"bucket": [None if f is None else f[0].astype(np.uint16).tobytes() for f in made], "share": [None if f is None else f[1].tobytes() for f in made]}

        return kernel

    rows = common.map_slices(few, _SAMPLE, "text", start).filter("bucket IS NOT NULL").collect()
    return sorted(rows, key=lambda r: (r["draw"], r["lang"], bytes(r["bucket"]), bytes(r["share"])))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    rows = sample(docs, text, lang, key, per_language)
    return fit([(np.frombuffer(r["bucket"], np.uint16).astype(np.int64), np.frombuffer(r["share"], np.float32)) for r in rows], [r["lang"] for r in rows])


class Scorer:
    """Scores texts; keeps the logits of words seen, up to a bound."""

    def __init__(self, model: Model, most_words: int = 1 << 16):
        self.model, self.most = model, most_words
        self._empty()

    def _empty(self):
        self.at: dict[str, int] = {}
        self.sums = np.zeros((1 << 12, max(1, len(self.model.languages)) + 1), np.float64)

    def _learn(self, words: set[str]) -> None:
        new = sorted(words.difference(self.at))
        if not new:
            return
        need = len(self.at) + len(new)
        if need > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros((need, self.sums.shape[1]))])
        for start in range(0, len(new), 4096):
            own = new[start : start + 4096]
            bucket, owner = word_features(own)
            rows = np.stack([np.bincount(owner, weights=c[bucket], minlength=len(own)) for c in self.model.table.T] + [np.bincount(owner, minlength=len(own))], 1)
            base = len(self.at)
            self.sums[base : base + len(own)] = rows
            self.at.update(zip(own, range(base, base + len(own)), strict=True))

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        m = self.model
        if not m.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if len(self.at) > self.most:
            self._empty()
        cut = [words_of(t) for t in texts]
        self._learn({w for words in cut for w in words})
        lang, score, rejected = [], [], []
        for words in cut:
            if not words:
                lang.append(UNKNOWN)
                score.append(0.0)
                rejected.append(True)
                continue
            total = self.sums[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(0)
            p = m.probabilities((total[:-1] / total[-1] + m.bias)[None, :])[0]
            best = int(p.argmax())
            lang.append(m.languages[best])
            score.append(float(p[best]))
            rejected.append(bool(p[best] < m.least))
        return lang, score, rejected


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with the language, its probability and whether it is rejected, under ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers
    schema = common.replaced(docs.schema, *(StructField(n, k()) for n, k in zip(names, (StringType, DoubleType, BooleanType), strict=True)))

    def start():
        scorer = Scorer(shared.value)
        return lambda piece: dict(zip(names, scorer(common.texts(piece, text)), strict=True))

    return common.map_slices(docs, schema, text, start)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, learnt from the rows that aren't held out."""
    own = docs.select("doc_id", "text", "lang")
    model = train(own.filter(~common.held_out(F.col("doc_id"))))
    return predict(own.select("doc_id", "text"), model).select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def known_language(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose language is rejected."""
    model = train(docs.filter(~common.held_out(F.col("doc_id"))))
    scored = predict(docs, model, names=("__lang", "__score", "__rejected"))
    return scored.filter("NOT __rejected").select(*docs.columns)
