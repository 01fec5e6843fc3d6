"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents whose label is 1; everything else is unlabelled
web text, whatever its label.  A linear model over shape features is fitted by minimising the
non-negative unbiased risk: with class prior p,

    p * R_pos(+) + max(0, R_unl(-) - p * R_pos(-))

where a batch whose second term is negative takes a step the other way.  The prior
itself is estimated (:func:`class_prior`): a plain classifier tells positives
from unlabelled text, and on a part kept apart the least ratio of the two tails' shares, with a
bound for chance, is the share of positives among the unlabelled (the mean over :data:`SPLITS` splits).

Features of whole texts, made on the executors: frequencies of pairs of character classes,
of hashed words and of hashed triples of characters, shares of repeated words and lines, word lengths.  The samples for training have a documented bound
(at most :data:`POSITIVES` and :data:`UNLABELLED` rows of features reach the driver, chosen by hash, however often an id stands); their labels come only
from rows that aren't held out.  Every text is scored.

Defined cases: a null text counts as empty and is scored as well; without any positive label every
score is the model's start, 0.5; repeated label rows count once, and an id with labels 0 and 1 is
positive; labels for unknown or null ids are ignored; equal texts get equal scores; input columns
named like a result are replaced.
"""

from __future__ import annotations

import operator
import unicodedata
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, StructField, StructType

from tesserae.llm import common, shingles

POSITIVES, UNLABELLED = 4000, 8000
CLASSES = 20
HASHED = 256
WIDTH = CLASSES * CLASSES + 2 * HASHED + 8
_WORDS = CLASSES * CLASSES
#: Splits into halves over which the estimate of the prior is averaged.
SPLITS = 4
#: What a hashed feature counts beside the others, as each alone says little.
HASHED_SHARE = 0.2
_FACTORS = shingles.odd_factors(3, 41)
CUT = 0.3
EPOCHS, BATCH, RATE, DECAY = 30, 256, 0.02, 1e-3


def _class_table() -> np.ndarray:
    """Class of each character of the basic plane: lower, upper, digit, space, line end, other letter, and marks by code."""
    out = np.empty(1 << 16, np.uint8)
    for i in range(1 << 16):
        kind = unicodedata.category(chr(i))
        if i == 10:
            out[i] = 4
        elif kind in ("Ll", "Lo", "Lm", "Mn", "Mc"):
            out[i] = 0
        elif kind in ("Lu", "Lt"):
            out[i] = 1
        elif kind[0] == "N":
            out[i] = 2
        elif kind[0] in "ZC":
            out[i] = 3
        else:
            out[i] = 5 + i % (CLASSES - 5)
    return out


_CLASS = _class_table()


def features(texts: list[str]) -> np.ndarray:
    """Shape (texts, WIDTH)."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _CLASS[np.minimum(points, 0xFFFF)].astype(np.int64)
    if len(kind) > 1:
        pair = kind[:-1] * CLASSES + kind[1:]
        own = np.repeat(np.arange(len(texts)), lengths)
        within = own[:-1] == own[1:]
        n = np.bincount(own[:-1][within] * (CLASSES * CLASSES) + pair[within], minlength=len(texts) * CLASSES * CLASSES).reshape(len(texts), -1)
        out[:, : CLASSES * CLASSES] = np.sqrt(n / np.maximum(1, lengths - 1)[:, None])
    if len(points) > 2:
        wide = points.astype(np.uint64)
        triple = ((wide[:-2] * _FACTORS[0] + wide[1:-1] * _FACTORS[1] + wide[2:] * _FACTORS[2]) >> np.uint64(40)).astype(np.int64) % HASHED
        own = np.repeat(np.arange(len(texts)), lengths)
        within = own[:-2] == own[2:]
        n = np.bincount(own[:-2][within] * HASHED + triple[within], minlength=len(texts) * HASHED).reshape(len(texts), -1)
        out[:, _WORDS + HASHED : -8] = n / np.maximum(1, lengths - 2)[:, None]
    for i, text in enumerate(texts):
        words = text.split()
        lines = text.split("\n")
        n = max(1, len(words))
        again = sum(map(operator.eq, words, words[1:])) / n
        if words:
            out[i, _WORDS : _WORDS + HASHED] = np.bincount((shingles.word_hashes(words) >> np.uint64(40)).astype(np.int64) % HASHED, minlength=HASHED) / n
        out[i, -8:] = (
            again,
            again**0.5,
            min(1.0, again * 5),
            len(set(words)) / n,
            1 - len(set(lines)) / len(lines),
            min(1.0, len(text) / n / 20),
            np.log1p(len(words)) / 10,
            min(1.0, max(map(len, words), default=0) / 50),
        )
    np.sqrt(out[:, _WORDS:-8], out=out[:, _WORDS:-8])
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(((x - self.mean) * self.scale) @ self.weight + self.bias)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class _Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def __call__(self, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)


def class_prior(pos: np.ndarray, unl: np.ndarray, rng: np.random.Generator, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from standardised features."""
    pos, unl = _with_one(rng.permutation(pos)), _with_one(rng.permutation(unl))
    p1, p2, u1, u2 = pos[::2], pos[1::2], unl[::2], unl[1::2]
    if not len(p2) or not len(u2):
        return 0.5
    w, step = np.zeros(pos.shape[1]), _Adam(pos.shape[1], 0.05)
    for _ in range(150):
        grad = -((1 - _sigmoid(p1 @ w))[:, None] * p1).mean(0) + (_sigmoid(u1 @ w)[:, None] * u1).mean(0)
        w -= step(grad + 1e-3 * w)
    sp, su = np.sort(p2 @ w), np.sort(u2 @ w)
    cuts = np.unique(np.concatenate([sp, su]))
    qp = 1 - np.searchsorted(sp, cuts) / len(sp)
    qu = 1 - np.searchsorted(su, cuts) / len(su)
    chance = np.sqrt(np.log(4 / delta) / 2 / len(su)) + np.sqrt(np.log(4 / delta) / 2 / len(sp))
    use = qp > 0.05
    ratio, bound = qu[use] / qp[use], 1.1 * chance / qp[use]
    return float(np.clip(ratio[(ratio + bound).argmin()], 0.01, 0.99))


def fit(pos: np.ndarray, unl: np.ndarray, seed: int = 5) -> Model:
    """Minimise the non-negative risk over feature rows."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl]).reshape(-1, WIDTH)
    if not len(pos) or not len(unl):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 0.5)
    mean, scale = both.mean(0, dtype=np.float64).astype(np.float32), (1 / np.maximum(both.std(0, dtype=np.float64), 0.02)).astype(np.float32)
    del both
    scale[_WORDS:-8] *= HASHED_SHARE
    pos, unl = (pos - mean) * scale, (unl - mean) * scale
    prior = float(np.mean([class_prior(pos, unl, rng) for _ in range(SPLITS)]))
    pos, unl = _with_one(pos), _with_one(unl)
    w, step = np.zeros(WIDTH + 1), _Adam(WIDTH + 1, RATE)
    mean_w, steps = np.zeros(WIDTH + 1), 0  # over the last third of the epochs: single steps swing
    for epoch in range(EPOCHS):
        order = rng.permutation(len(unl))
        for start in range(0, len(unl), BATCH):
            u, p = unl[order[start : start + BATCH]], pos[rng.integers(0, len(pos), BATCH)]
            fu, fp = u @ w, p @ w
            # Logistic loss: log(1 + exp(-f)) for a positive, log(1 + exp(f)) for a negative.
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            of_negative = (_sigmoid(fu)[:, None] * u).mean(0) - prior * (_sigmoid(fp)[:, None] * p).mean(0)
            of_positive = -prior * ((1 - _sigmoid(fp))[:, None] * p).mean(0)
            grad = of_positive + of_negative if negative >= 0 else -of_negative
            decay = DECAY * w
            decay[-1] = 0
            w -= step(grad + decay)
            if epoch >= EPOCHS * 2 // 3:
                steps += 1
                mean_w += (w - mean_w) / steps
    return Model(mean, scale, mean_w[:-1], float(mean_w[-1]), prior)


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    """Learn from the rows that aren't held out; both samples are taken in one scan, by hashes of id and text."""
    spark = docs.sparkSession
    own = docs.select("doc_id", text).filter(~common.held_out(F.col("doc_id")))
    sure = (
        labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id")))
        .select("doc_id").distinct().orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(POSITIVES)
    )
    ids = [r["doc_id"] for r in sure.collect()]  # POSITIVES at most
    known = F.broadcast(spark.createDataFrame([(i, True) for i in ids], StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("__sure", BooleanType())])))
    share = min(1.0, UNLABELLED / max(1, docs.count() * 0.8))  # as many as are wanted, more or less
    draw = F.pmod(F.xxhash64(F.lit(23), "doc_id", text), F.lit(1 << 30)) / float(1 << 30) < share
    picked = own.join(known, "doc_id", "left").withColumn("__sure", F.coalesce("__sure", F.lit(False))).withColumn("__draw", draw).filter("__sure OR __draw")
    roles = F.explode(F.array_compact(F.array(F.when(F.col("__sure"), F.lit(True)), F.when(F.col("__draw"), F.lit(False)))))
    schema = StructType([StructField("__sure", BooleanType()), StructField("__draw", BooleanType()), StructField("x", BinaryType())])
    made = common.map_slices(picked.select("__sure", "__draw", text), schema, text, lambda: lambda piece: {"x": [r.tobytes() for r in features(common.texts(piece, text))]})
    made = made.select(roles.alias("role"), "x").withColumn("place", F.row_number().over(Window.partitionBy("role").orderBy(F.xxhash64("x"), "x")))
    vectors = sorted((r["role"], bytes(r["x"])) for r in made.filter(F.col("place") <= F.when(F.col("role"), POSITIVES).otherwise(UNLABELLED)).select("role", "x").collect())
    rows = [np.frombuffer(x, np.float32) for _, x in vectors]  # in an order that doesn't hang on the partitions
    unlabelled = sum(not role for role, _ in vectors)
    return fit(np.array(rows[unlabelled:], np.float32).reshape(-1, WIDTH), np.array(rows[:unlabelled], np.float32).reshape(-1, WIDTH))


def score(docs: DataFrame, model: Model, text: str = "text", cut: float = CUT, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with the score and the prediction, under ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = common.replaced(docs.schema, StructField(names[0], DoubleType()), StructField(names[1], IntegerType()))

    def start():
        def kernel(piece):
            s = shared.value.scores(features(common.texts(piece, text)).astype(np.float64))
            return {names[0]: s, names[1]: (s >= cut).astype(np.int32)}

        return kernel

    return common.map_slices(docs, schema, text, start)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    own = docs.select("doc_id", "text")
    return score(own, train(own, labels)).select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that are predicted 0."""
    model = train(docs, labels)
    scored = score(docs, model, names=("__score", "__predicted"))
    return scored.filter("__predicted = 1").select(*docs.columns)
