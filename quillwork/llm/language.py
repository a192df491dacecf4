"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection.

Subwords are the character n-grams of the words with their borders marked, hashed into a fixed number of buckets.
A document is the mean of its subwords' embeddings; a linear softmax turns it into probabilities. Embeddings and
weights are trained together by stochastic gradient descent in numpy on a bounded sample. A part of the sample is set
aside: it fits the temperature of the softmax and the score below which a prediction is marked as rejected.

For prediction the embeddings are multiplied with the weights once. A mean of embeddings times the weights is the
mean of these products, so a text costs one lookup per subword.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import register, table, with_results
from .samples import id_remainder, sample_by_label

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15
    dimensions: int = 16
    shortest: int = 2
    longest: int = 4
    epochs: int = 6
    rate: float = 2.0
    calibration: float = 0.2  # share of the sample set aside
    precision: float = 0.99  # wanted among accepted predictions
    seed: int = 5


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # (buckets, languages): embeddings times weights
    bias: np.ndarray
    temperature: float
    threshold: float
    settings: Settings


def letter_codes() -> np.ndarray:
    """Lower-case code point of every letter, 0 for everything else."""
    codes = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            codes[c] = ord(low) if len(low) == 1 else c
    return codes


def subwords(texts: Sequence[str], codes: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every subword of the texts, in order of the texts for each length."""
    joined = np.frombuffer(" ".join(texts).join("  ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.array([len(t) + 1 for t in texts])
    owner = np.concatenate([[0], np.repeat(np.arange(len(texts)), sizes)]).astype(np.int32)
    code = codes[joined]
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)  # runs of other characters are one border
    code, owner = code[keep].astype(np.uint64), owner[keep]
    inner = code != 0
    mixed = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    hashed, open_ = mixed.copy(), np.ones(len(code), dtype=bool)
    found, owners = [], []
    for n in range(2, settings.longest + 1):
        # the first and last character of a subword may be a border, those between may not
        hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + mixed[n - 1:]
        open_ = open_[:-1] if n == 2 else open_[:-1] & inner[n - 2:len(code) - 1]
        if n >= settings.shortest:
            # the last character tells the text: the border before a word belongs to the text before
            found.append(((hashed[open_] ^ (hashed[open_] >> np.uint64(31))) % np.uint64(settings.buckets)).astype(np.int32))
            owners.append(owner[n - 1:][open_])
    return np.concatenate(found), np.concatenate(owners)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(sample: pd.DataFrame, settings: Settings = Settings()) -> Model:
    """A model from the columns ``text`` and ``lang`` of a sample; without rows, one that knows no language."""
    languages = tuple(sorted(sample["lang"].unique())) if len(sample) else ()
    rng = np.random.default_rng(settings.seed)
    n_lang = len(languages)
    embed = rng.normal(0, 0.1, (settings.buckets, settings.dimensions)).astype(np.float32)
    weights = np.zeros((settings.dimensions, n_lang), dtype=np.float32)
    bias = np.zeros(n_lang, dtype=np.float32)
    if not n_lang:
        return Model((), np.zeros((settings.buckets, 0), np.float32), bias, 1.0, 1.0, settings)
    codes = letter_codes()
    bags = []
    for text in sample["text"]:
        bucket, n = np.unique(subwords([text], codes, settings)[0], return_counts=True)
        bags.append((bucket, (n / max(n.sum(), 1)).astype(np.float32)))
    target = np.searchsorted(np.array(languages), sample["lang"].to_numpy(dtype=str))
    order = rng.permutation(len(bags))
    aside = order[:int(len(order) * settings.calibration)]
    train = order[len(aside):]
    steps, step = max(1, settings.epochs * len(train)), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(train):
            rate, step = settings.rate * (1 - step / steps), step + 1
            bucket, share = bags[i]
            if not len(bucket):
                continue
            mean = share @ embed[bucket]
            error = _softmax(mean @ weights + bias)
            error[target[i]] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= 0.01 * rate * error
            embed[bucket] -= rate * np.outer(share, back)
    product = (embed @ weights).astype(np.float32)
    known = [i for i in (aside if len(aside) else train) if len(bags[i][0])]
    logits = np.array([bags[i][1] @ product[bags[i][0]] + bias for i in known]).reshape(len(known), n_lang)
    temperature, threshold = _calibrate(logits, target[known], settings.precision)
    return Model(languages, product, bias, temperature, threshold, settings)


def _calibrate(logits: np.ndarray, target: np.ndarray, precision: float) -> tuple[float, float]:
    """The temperature of least log loss, and the lowest score from which predictions are precise enough."""
    if not len(logits):
        return 1.0, 0.0
    rows = np.arange(len(target))
    choices = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(_softmax(logits / t)[rows, target], 1e-12)).mean() for t in choices]
    temperature = float(choices[int(np.argmin(loss))])
    chance = _softmax(logits / temperature)
    score, right = chance.max(axis=1), chance.argmax(axis=1) == target
    order = np.argsort(-score, kind="stable")
    precise = np.cumsum(right[order]) / (rows + 1) >= precision
    return temperature, float(score[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0


def predict(texts: Iterable[str | None], model: Model, group_chars: int = 200_000) -> Iterator[tuple]:
    """(language, score, rejected) of each text, worked on in groups of bounded size."""
    codes = letter_codes()
    n_lang = len(model.languages)

    def done(group: list[str]) -> Iterator[tuple]:
        sums, counts = np.zeros((len(group), n_lang)), np.zeros(len(group))
        for start in range(0, len(group), 4096):
            part = group[start:start + 4096]
            bucket, owner = subwords(part, codes, model.settings)
            n = np.bincount(owner, minlength=len(part))[:len(part)]
            counts[start:start + len(part)] = n
            for j in range(n_lang):
                sums[start:start + len(part), j] = np.bincount(owner, model.table[bucket, j], len(part))[:len(part)]
        chance = _softmax((sums / np.maximum(counts, 1)[:, None] + model.bias) / model.temperature) if n_lang else sums
        for text, n, row in zip(group, counts, chance):
            if not n_lang or not n or not any(map(str.isalpha, text)):
                yield UNKNOWN, 0.0, True
            else:
                best = int(row.argmax())
                yield model.languages[best], float(row[best]), bool(row[best] < model.threshold)

    group, chars = [], 0
    for text in texts:
        group.append(text or "")
        chars += len(group[-1])
        if chars >= group_chars:
            yield from done(group)
            group, chars = [], 0
    if group:
        yield from done(group)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` plus ``lang_pred``, ``score`` and ``rejected``, from the whole text alone.

    A text that is null or has no letter is ``und`` with score 0 and rejected. Repeated rows give repeated results,
    an empty table none.
    """
    return with_results(docs, text, "lang_pred string, score double, rejected boolean",
                        lambda texts: predict(texts, model), keep)


def train(docs: DataFrame, per_language: int = 1200, settings: Settings = Settings(), max_chars: int = 200_000) -> Model:
    """A model from about ``per_language`` different documents of each language (a bounded sample, chosen by hash).

    Texts above ``max_chars`` are not learned from, which bounds the sample in bytes; the 200 languages with most
    documents are. Ties between languages go to the first by name.
    """
    rows = docs.filter(F.length("text") <= max_chars).select("text", "lang")
    return fit(sample_by_label(rows, "lang", per_language), settings)


@register("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False)))
    model = train(docs.filter(id_remainder("doc_id", 3) != 1))
    return identify(docs, model, keep=("doc_id", "held_out"))
