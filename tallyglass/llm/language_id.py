"""Language identification: averaged hashed subword embeddings under a linear softmax.

A word (run of letters, lower-cased) stands for its character n-grams of 2 to 4 letters with
boundary marks, each hashed to a row of an embedding table. A text is the mean of the rows of
all its n-grams that training has met; a linear softmax over that mean gives the languages. Both
layers are trained by stochastic gradient descent in numpy, on whole texts: workers reduce each
sampled text to the counts of its n-grams, of which there are ``buckets`` at most.

Rejection is calibrated on a held-back part of the sample. A text's fit to a language is the mean
log frequency of its n-grams in that language's training texts. A logistic curve over fit and
length is trained to tell held-back texts and pieces (under their language) from texts that are of
no language known: the same with letters shuffled, and the same taken under the best of the other
languages, as if their own were unknown. The score is the softmax probability (temperature of
lowest log loss) times that curve's. The threshold loses ``rejected_share`` of right predictions
at most; ``Model.false_acceptance`` and ``right_lost`` tell what it does on the held-back part.

The sums over n-grams are linear, so prediction needs each distinct word's sums only once per
worker; whole texts are read.

Defined results: a null text or one without a letter is ``und`` with score 0 and is rejected;
a tie between languages goes to the first in alphabetical order; without a labelled row every
text is ``und``; with one language it is the only answer, and rejection is told by fit only; a
sample too small to hold rows back accepts every text that has a letter. Only the text is an
input of a prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm.common import opened, remember_only, sealed, small_batches, table

_WORDS = re.compile(r"[^\W\d_]+").findall
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled rows that are fitted, whole texts of each; a text comes
    to the driver as ``buckets`` counts at most. A small sample is gone through more often, until
    ``least_steps`` steps are made."""

    sample_rows: int = 2000
    buckets: int = 1 << 17
    dim: int = 16
    epochs: int = 4
    least_steps: int = 1200
    batch: int = 64
    #: N-grams of each text that one step draws.
    drawn: int = 256
    rate: float = 1.0
    held_back: float = 0.25
    rejected_share: float = 0.002
    remembered_words: int = 100_000
    seed: int = 7


def _ngram_rows(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the n-grams of words (a polynomial hash over code points), and each n-gram's word."""
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    rows, of = [], []
    h = chars
    for n in (2, 3, 4):
        if len(chars) < n:
            break
        h = h[: len(chars) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :] + np.uint64(n)
        x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        inside = word[: len(chars) - n + 1] == word[n - 1 :]
        rows.append(((x >> np.uint64(40)) % np.uint64(buckets))[inside].astype(np.int64))
        of.append(word[: len(chars) - n + 1][inside])
    return np.concatenate(rows), np.concatenate(of)


#: What a count vector is of: a whole text, a piece of it, either with its letters shuffled.
WHOLE, PIECE, SHUFFLED, SHUFFLED_PIECE = range(4)


def _counts(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of words, and how often each comes."""
    many = Counter(words)
    rows, of = _ngram_rows(list(many), buckets)
    own, inverse = np.unique(rows, return_inverse=True)
    return own.astype(np.int32), np.bincount(inverse, np.fromiter(many.values(), np.int64)[of]).astype(np.int32)


def vectors(text: str | None, held: bool, settings: Settings = Settings()) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, buckets, counts) of a text; of held-back ones also a piece, and both with letters shuffled."""
    words = _WORDS((text or "").lower())
    if not words:
        return []
    out = [(WHOLE, *_counts(words, settings.buckets))]
    if held:
        rng = np.random.default_rng([settings.seed, len(words), *words[0].encode()[:8]])
        n = int(min(len(words), rng.integers(3, 60)))
        at = int(rng.integers(0, len(words) - n + 1))
        mixed = "".join(rng.permutation(list("".join(words))))
        ends = np.cumsum([len(w) for w in words]).tolist()
        other = [mixed[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
        for kind, own in ((PIECE, words[at : at + n]), (SHUFFLED, other), (SHUFFLED_PIECE, other[at : at + n])):
            out.append((kind, *_counts(own, settings.buckets)))
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    log_share: np.ndarray
    met: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    #: Of the logistic curve over fit and length; none if nothing was held back.
    curve: np.ndarray | None = None
    remembered_words: int = 100_000
    #: On the held-back part: accepted share of texts of no known language, by kind, and rejected share of right predictions.
    false_acceptance: dict[str, float] = field(default_factory=dict)
    right_lost: float = 0.0

    def __post_init__(self) -> None:
        self._at: dict[str, int] = {}
        n = len(self.langs)
        self._sums = np.zeros((1024, 2 * n + 2))
        logits = self.table.astype(np.float64) @ self.weights.astype(np.float64)
        # by bucket: logits of the rows that training has met, and log shares
        self._own = np.concatenate([np.where(self.met[:, None], logits, 0), self.log_share, self.met[:, None].astype(float), np.ones((len(self.table), 1))], axis=1)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_at", "_sums", "_own")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def _learn(self, words: list[str]) -> None:
        """Remember the sums of words not met before."""
        rows, of = _ngram_rows(words, len(self.table))
        at = len(self._at)
        while at + len(words) > len(self._sums):
            self._sums = np.concatenate([self._sums, np.zeros_like(self._sums)])
        for k in range(self._own.shape[1]):
            self._sums[at : at + len(words), k] = np.bincount(of, self._own[rows, k], len(words))
        self._at.update(zip(words, range(at, at + len(words)), strict=True))

    def sums(self, text: str | None) -> np.ndarray | None:
        """Summed logits, log shares, n-grams met and n-grams of a text; None without a letter."""
        words = _WORDS(text.lower()) if text else []
        if not any(c.isalpha() for w in words for c in w):
            return None
        total = np.zeros(self._sums.shape[1])
        for lo in range(0, len(words), 50_000):
            part = words[lo : lo + 50_000]
            if len(self._at) + len(part) > self.remembered_words:
                self._at.clear()
            if new := [w for w in dict.fromkeys(part) if w not in self._at]:
                self._learn(new)
            total += self._sums[list(map(self._at.__getitem__, part))].sum(0)
        return total

    def logits_and_fit(self, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows of sums: logits, fit to each language, n-grams."""
        n = len(self.langs)
        met, size = np.maximum(total[:, 2 * n : 2 * n + 1], 1), total[:, 2 * n + 1 :]
        return total[:, :n] / met + self.bias, total[:, n : 2 * n] / size, size[:, 0]

    def known(self, fit: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Probability that texts of this fit and length are of the language."""
        if self.curve is None:
            return np.ones(len(fit))
        return 1 / (1 + np.exp(-np.clip(_features(fit, size) @ self.curve, -40, 40)))

    def predict(self, text: str | None) -> tuple[str, float]:
        total = self.sums(text)
        if total is None:
            return UNKNOWN, 0.0
        z, fits, size = self.logits_and_fit(total[None])
        p = _softmax(z / self.temperature)[0]
        k = int(p.argmax())
        return self.langs[k], float(p[k] * self.known(fits[:, k], size)[0])


def _features(fit: np.ndarray, size: np.ndarray) -> np.ndarray:
    n = np.log(np.minimum(size, 1000) + 1) / 7  # longer texts aren't surer
    return np.stack([np.ones(len(fit)), fit, n, fit * n], axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str], langs: list[str], settings: Settings = Settings()) -> Model:
    """Train on texts with their languages; calibrate on the held-back part."""
    if not langs:
        raise ValueError("a labelled row at least is needed")
    held = np.random.default_rng(settings.seed).random(len(texts)) < settings.held_back
    rows = [(x, bool(h), *v) for t, x, h in zip(texts, langs, held, strict=True) for v in vectors(t, bool(h), settings)]
    return fit_vectors(sorted(set(langs)), [r[0] for r in rows], np.array([r[1] for r in rows], bool), np.array([r[2] for r in rows]), [r[3] for r in rows], [r[4] for r in rows], settings)


def fit_vectors(names: list[str], langs: list[str], held: np.ndarray, kinds: np.ndarray, buckets: list[np.ndarray], counts: list[np.ndarray], settings: Settings = Settings()) -> Model:
    """Train on the count vectors of whole texts that aren't held back; calibrate on those that are."""
    label = np.array([names.index(x) for x in langs], np.int64)
    rng = np.random.default_rng(settings.seed)
    train = np.flatnonzero(~held)
    ends = {i: np.cumsum(counts[i]) for i in train.tolist()}
    emb = rng.normal(0, 0.1, (settings.buckets, settings.dim)).astype(np.float32)
    w = rng.normal(0, 0.1, (settings.dim, len(names))).astype(np.float32)
    b = np.zeros(len(names), np.float32)
    each = max(1, -(-len(train) // settings.batch))
    epochs = max(settings.epochs, -(-settings.least_steps // each)) if len(train) else 0
    steps, done = epochs * each, 0
    for _ in range(epochs):
        train = rng.permutation(train)
        for lo in range(0, len(train), settings.batch):
            at = train[lo : lo + settings.batch]
            # n-grams of the whole text, drawn anew each time by how often they come
            rows = np.stack([buckets[i][np.searchsorted(ends[i], rng.integers(0, ends[i][-1], settings.drawn), side="right")] for i in at])
            mean = emb[rows].mean(1)
            p = _softmax(mean @ w + b)
            p[np.arange(len(at)), label[at]] -= 1
            rate = np.float32(settings.rate * (1 - done / steps))
            down = (p @ w.T / settings.drawn).astype(np.float32)
            w -= rate * (mean.T @ p / len(at)).astype(np.float32)
            b -= rate * p.mean(0).astype(np.float32)
            # rows repeat within a batch: sum their gradients by sorting
            rows, step = rows.ravel(), np.repeat(down, settings.drawn, axis=0)
            by = np.argsort(rows, kind="stable")
            u, first = np.unique(rows[by], return_index=True)
            emb[u] -= rate * np.add.reduceat(step[by], first, axis=0)
            done += 1
    every = np.zeros((settings.buckets, len(names)))
    for i in train:
        every[buckets[i], label[i]] += np.minimum(counts[i], 50)  # one text's own words weigh little
    log_share = np.log((every + 0.5) / (every.sum(0) + 0.5 * settings.buckets))
    model = Model(names, emb, w, b, log_share.astype(np.float32), every.sum(1) > 0, remembered_words=settings.remembered_words)
    at = np.flatnonzero(held)
    if len(at):
        total = np.array([counts[i] @ model._own[buckets[i]] for i in at])
        _calibrate(model, total, label[at], kinds[at], settings)
    return model


def _calibrate(model: Model, total: np.ndarray, label: np.ndarray, kinds: np.ndarray, settings: Settings) -> None:
    z, fits, size = model.logits_and_fit(total)
    rows = np.arange(len(z))
    own = kinds <= PIECE
    whole = kinds == WHOLE
    loss = lambda t: -np.log(_softmax(z[whole] / t)[np.arange(whole.sum()), label[whole]] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.02, 4, 60), key=loss))
    p = _softmax(z / model.temperature)
    # of no language known: letters shuffled, and each text under the best of the other languages
    others = z.copy()
    others[rows, label] = -np.inf
    second = others.argmax(1) if len(model.langs) > 1 else np.zeros(len(z), int)
    left_out = own & (len(model.langs) > 1)
    said = np.where(kinds > PIECE, p.argmax(1), second)
    good = own & (p.argmax(1) == label)
    x = np.concatenate([_features(fits[rows, label][good], size[good]), _features(fits[rows, said][~own | left_out], size[~own | left_out])])
    y = np.concatenate([np.ones(good.sum()), np.zeros((~own | left_out).sum())])
    if not good.any():
        return
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    theta = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps of a logistic regression with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-5 * np.eye(x.shape[1])
        theta = theta - np.linalg.solve(hess, x.T @ (weight * (q - y)) + 1e-5 * theta)
    model.curve = theta
    right = np.sort((p[rows, label] * model.known(fits[rows, label], size))[good & whole])
    if not len(right):
        return
    renamed = _softmax(np.where(np.isinf(others), -1e9, others) / model.temperature)
    wrong = {"letters shuffled": (p[rows, said] * model.known(fits[rows, said], size))[kinds == SHUFFLED]}
    if left_out.any():
        wrong["language left out"] = (renamed[rows, second] * model.known(fits[rows, second], size))[left_out & whole]
    least = right[int(len(right) * settings.rejected_share)]
    most = max(float(np.quantile(v, 0.99)) if len(v) else 0.0 for v in wrong.values())
    model.threshold = float(least if most >= least else (least + most) / 2)
    model.right_lost = float((right < model.threshold).mean())
    model.false_acceptance = {k: float((v >= model.threshold).mean()) for k, v in wrong.items() if len(v)}


def in_training(doc_id: Column) -> Column:
    """The fold rule: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 != 1


def fitted(docs: DataFrame, settings: Settings = Settings(), keep: Column | None = None) -> Model | None:
    """A model of a bounded sample of labelled rows, picked by their hashes; None without any."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if keep is None else keep))
    rows = rows.select("text", "lang", F.xxhash64("doc_id", "text", "lang").alias("by"))
    # a hash filter first, so that partitions send few more hashes than the sample between them
    total = docs.where(F.col("lang").isNotNull()).count()
    share = min(1.0, 3.0 * settings.sample_rows / max(total, 1) + 1e-4)
    likely = F.pmod("by", F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    first = [r.by for r in rows.where(likely).select("by").distinct().orderBy("by").limit(settings.sample_rows).collect()]
    if not first:
        return None
    picked = rows.where(likely & (F.col("by") <= first[-1])).dropDuplicates(["by"]).repartition(16, "by")
    one_in = round(1 / settings.held_back)

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = [(by, lang, by // 7 % one_in == 0, *v) for by, lang, text in zip(df["by"], df["lang"], df["text"], strict=True) for v in vectors(text, by // 7 % one_in == 0, settings)]
            yield pd.DataFrame(out, columns=["by", "lang", "held", "kind", "buckets", "counts"])

    got = picked.mapInPandas(reduced, "by long, lang string, held boolean, kind int, buckets array<int>, counts array<int>").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("by", "ascending"), ("kind", "ascending")]).combine_chunks()
    lists = {}
    for c in ("buckets", "counts"):
        column = got.column(c).combine_chunks()
        at, flat = np.asarray(column.offsets), np.asarray(column.values)
        lists[c] = [flat[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]
    langs = got.column("lang").to_pylist()
    return fit_vectors(sorted(set(langs)), langs, np.asarray(got.column("held")), np.asarray(got.column("kind")), lists["buckets"], lists["counts"], settings)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and accepted (score at least the calibrated threshold)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def predict_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        remember_only("language_id")
        own = shared.value
        for texts in batches:
            yield pd.DataFrame([own.predict(t) for t in texts], columns=["lang_pred", "score"]).astype({"lang_pred": object, "score": float})

    own = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    out = sealed(docs).select("_in", predict_texts(F.col("_in").getField(text)).alias("_said"))
    said, score = F.col("_said.lang_pred"), F.col("_said.score")
    return opened(out, own, lang_pred=said, score=score, accepted=(said != UNKNOWN) & (score >= model.threshold))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fitted(docs, keep=in_training(F.col("doc_id")))
    if model is None:  # nothing to learn from: every language is unknown
        nothing = F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted")
        return docs.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), *nothing)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "accepted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is accepted, with the columns of documents."""
    model = fitted(docs, keep=in_training(F.col("doc_id")))
    if model is None:  # nothing to learn from: nothing can be accepted
        return docs.where(F.lit(False))
    rows = sealed(docs).select("_in", F.col("_in").getField("text").alias("text"))
    return predict(rows, model).where("accepted").select("_in.*")
