"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts and full-width forms to Latin ones, digits and signs
used as letters to those letters (``1d1ot``, ``$tupid``), and everything that is not a letter to one border sign.
The lexicon holds whole words and word beginnings with weights (log odds between toxic and other documents), learned
from a bounded sample of labelled documents; terms may also be given. Exception phrases (given, or learned as
neighbouring words that mark a harmless use) take back the weight of the terms they cover. The sum of weights,
as such and in proportion to the length in words, goes through a logistic curve fitted on the same sample.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import register, table, with_results
from .samples import id_remainder, sample_by_label

BORDER = " "
#: Look-alikes of Latin letters in the Greek and Cyrillic scripts, and signs used in place of letters.
LOOK_ALIKES = {
    "a": "аαɑ@4", "b": "вβьƅ8", "c": "сϲς", "d": "ԁ", "e": "еεє3", "f": "ғ", "g": "ɡց9", "h": "һнη", "i": "іιıΐ!|1",
    "j": "јϳ", "k": "кκ", "l": "ⅼӏ", "m": "мμ", "n": "ոп", "o": "оοσө0", "p": "рρ", "q": "ԛ", "r": "гř", "s": "ѕʂ$5",
    "t": "тτ7", "u": "υսц", "v": "ѵν", "w": "ԝωш", "x": "хχ×", "y": "уγү", "z": "ʐζ2"}
#: Signs that count as letters only before a letter, since they are also punctuation.
SIGNS = "!|$@"
#: Harmless phrases with words that are insults elsewhere.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "rodeo clown", "circus clown", "pond scum")


@dataclass(frozen=True)
class Settings:
    shortest: int = 3  # letters of a word beginning
    longest: int = 12
    min_docs: int = 8  # toxic documents of the sample with the term
    min_odds: float = 3.5  # log odds of a term
    same: float = 0.9  # a longer term replaces a shorter one that it nearly always continues
    steps: int = 400


@dataclass(frozen=True)
class Lexicon:
    weights: Mapping[str, float] = field(default_factory=dict)  # folded terms with their borders
    exceptions: tuple[str, ...] = ()  # folded phrases
    curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)  # constant, total weight, weight by length


def fold_table() -> np.ndarray:
    """For every code point the folded one."""
    table_ = np.full(0x110000, ord(BORDER), dtype="<u4")
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            table_[c] = ord(low) if len(low) == 1 else c
    table_[0xFF21:0xFF3B] = np.arange(97, 123)  # full-width capitals
    table_[0xFF41:0xFF5B] = np.arange(97, 123)
    for plain, others in LOOK_ALIKES.items():
        for other in others:
            table_[ord(other)] = ord(plain)
            if len(other.upper()) == 1 and other.upper() != other:
                table_[ord(other.upper())] = ord(plain)
    # l and i are told apart by no reader of "1" or "|": one skeleton letter for both
    table_[table_ == ord("l")] = ord("i")
    return table_


class Folder:
    """Folds texts; the result has one character for each character of the text, and a border at both ends."""

    def __init__(self) -> None:
        self.table = fold_table()
        self.sign = np.isin(np.arange(0x110000), [ord(c) for c in SIGNS])
        self.digit = np.array([chr(c) in "0123456789" for c in range(128)])

    def fold(self, text: str) -> str:
        codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
        out = self.table[codes]
        low = np.minimum(codes, 127)
        if self.digit[low].any():  # numbers that touch no letter are not words
            letters = (out != ord(BORDER)) & ~self.digit[low] & ~self.sign[codes]
            number = self.digit[low] & (codes < 128)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], number.view(np.int8), [0]])))
            starts, ends = edges[::2], edges[1::2]
            alone = ~(letters[starts - 1] | letters[ends])
            for a, b in zip(starts[alone], ends[alone]):
                out[a:b] = ord(BORDER)
        signs = self.sign[codes]
        if signs.any():
            after = np.concatenate([(out[1:] != ord(BORDER)) & ~signs[1:], [False]])
            out[signs & ~after] = ord(BORDER)
        return out.tobytes().decode("utf-32-le", "surrogatepass")


def _terms(folded: str, settings: Settings, seen: set[str] | None = None) -> set[str]:
    """Words with both borders and word beginnings with the left border; only those in ``seen`` where given."""
    out: set[str] = set()
    for word in set(folded.split(BORDER)):
        if len(word) >= 3:
            out.add(f" {word} ")
        for n in range(settings.shortest, min(settings.longest, len(word)) + 1):
            out.add(BORDER + word[:n])
    return out if seen is None else out & seen


def _choose(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, settings: Settings) -> dict[str, float]:
    """The terms that mark toxic documents, each weighted; of nested ones the longest that is as frequent."""
    odds = {t: math.log((k + 0.5) / (n_toxic + 1)) - math.log((clean[t] + 0.5) / (n_clean + 1))
            for t, k in toxic.items() if k >= settings.min_docs}
    good = {t for t, x in odds.items() if x >= settings.min_odds and clean[t] <= 0.1 * toxic[t]}
    chosen: dict[str, float] = {}
    for term in sorted(good, key=lambda t: (len(t), t)):
        if any(term[:n] in good for n in range(settings.shortest + 1, len(term))):
            continue  # a shorter beginning stands for it
        longer = [t for t in good if t.startswith(term) and toxic[t] >= settings.same * toxic[term]]
        best = max(longer, key=lambda t: (len(t), t))
        chosen[best] = odds[best]
    return chosen


def _automaton(lexicon: Lexicon):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for phrase in lexicon.exceptions:
        machine.add_word(phrase, (len(phrase), 0.0, True))
    for term, weight in lexicon.weights.items():
        if term not in machine:
            machine.add_word(term, (len(term), weight, False))
    if len(machine):
        machine.make_automaton()
    return machine


def matched_weight(folded: str, machine) -> tuple[float, int]:
    """Sum of the weights of the matches that no exception covers, and their number."""
    if not len(machine):
        return 0.0, 0
    matches = [(end - n + 1, end, weight, harmless) for end, (n, weight, harmless) in machine.iter(folded)]
    spared = [(a, b) for a, b, _, harmless in matches if harmless]
    total, count = 0.0, 0
    for a, b, weight, harmless in matches:
        if not harmless and not any(x <= a and b <= y for x, y in spared):
            total, count = total + weight, count + 1
    return total, count


def _features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / np.maximum(words, 1))], axis=1)


def score(total: float, words: int, curve: Sequence[float]) -> float:
    z = curve[0] + curve[1] * math.log1p(total) + curve[2] * math.log1p(100 * total / max(words, 1))
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit(sample: pd.DataFrame, settings: Settings = Settings(), terms: Mapping[str, float] | None = None,
        exceptions: Sequence[str] = EXCEPTIONS) -> Lexicon:
    """A lexicon from ``text`` and ``toxic`` (1 or 0) of a sample; ``terms`` are added to what is learned."""
    folder = Folder()
    folded = [folder.fold(t or "") for t in sample["text"]] if len(sample) else []
    label = sample["toxic"].to_numpy(dtype=int) if len(sample) else np.zeros(0, int)
    toxic: Counter = Counter()
    clean: Counter = Counter()
    for text, y in zip(folded, label):
        if y == 1:
            toxic.update(_terms(text, settings))
    kept = {t for t, n in toxic.items() if n >= settings.min_docs}
    for text, y in zip(folded, label):
        if y != 1:
            clean.update(_terms(text, settings, kept))
    n_toxic, n_clean = int((label == 1).sum()), int((label != 1).sum())
    weights = _choose(toxic, clean, n_toxic, n_clean, settings) if n_toxic and n_clean else {}
    weights |= {folder.fold(t): w for t, w in (terms or {}).items()}
    spared = {folder.fold(p) for p in exceptions} | _harmless(folded, label, Lexicon(weights), settings)
    lexicon = Lexicon(weights, tuple(sorted(spared)))
    if not (n_toxic and n_clean):
        return Lexicon(weights, lexicon.exceptions, (-3.0, 1.0, 0.5))
    machine = _automaton(lexicon)
    total = np.array([matched_weight(t, machine)[0] for t in folded])
    words = np.array([len(t.split()) for t in folded])
    return Lexicon(weights, lexicon.exceptions, _logistic(_features(total, words), label, settings.steps))


def _harmless(folded: Sequence[str], label: np.ndarray, lexicon: Lexicon, settings: Settings) -> set[str]:
    """A term with one neighbouring word, met in clean documents often and in toxic ones hardly ever."""
    machine, seen = _automaton(Lexicon(lexicon.weights)), defaultdict(lambda: [0, 0])
    if not len(machine):
        return set()
    for text, y in zip(folded, label):
        phrases = set()
        for end, (n, _, _) in machine.iter(text):
            a = text.rfind(BORDER, 0, max(end - n + 1, 0) + 1)
            b = text.find(BORDER, max(end, a + 1))
            before, after = text.rfind(BORDER, 0, max(a, 0)), text.find(BORDER, b + 1)
            if 0 <= before < a - 1:
                phrases.add(text[before:b + 1])
            if after > b + 1 > 0:
                phrases.add(text[a:after + 1])
        for p in phrases:
            seen[p][int(y == 1)] += 1
    return {p for p, (clean, toxic) in seen.items() if clean >= settings.min_docs and toxic <= 0.05 * clean}


def _logistic(x: np.ndarray, y: np.ndarray, steps: int) -> tuple[float, float, float]:
    """Newton steps for a ridge-penalised logistic curve whose two slopes are not negative."""
    w = np.zeros(3)
    penalty = np.diag([1e-3, 1e-1, 1e-1])
    free = np.ones(3, dtype=bool)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) + penalty @ w
        curvature = (x * (p * (1 - p))[:, None]).T @ x + penalty
        move = np.zeros(3)
        move[free] = np.linalg.solve(curvature[np.ix_(free, free)], gradient[free])
        w = w - np.clip(move, -2, 2)
        negative = np.array([False, w[1] < 0, w[2] < 0])
        w[negative], free = 0.0, free & ~negative
        if np.abs(move).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def score_texts(texts: Iterable[str | None], lexicon: Lexicon) -> Iterator[tuple]:
    folder, machine = Folder(), _automaton(lexicon)
    for text in texts:
        folded = folder.fold(text or "")
        total, count = matched_weight(folded, machine)
        value = score(total, len(folded.split()), lexicon.curve)
        yield value, int(value >= 0.5), total, count


def toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` plus ``score``, ``predicted`` (1 from 0.5 on), ``weight`` and ``n_matches`` of each whole text.

    A null text counts as empty and gets the score of a text without matches. Repeated rows give repeated results,
    an empty table none.
    """
    return with_results(docs, text, "score double, predicted int, weight double, n_matches long",
                        lambda texts: score_texts(texts, lexicon), keep)


def train(docs: DataFrame, labels: DataFrame, per_label: int = 2500, settings: Settings = Settings(),
          max_chars: int = 200_000) -> Lexicon:
    """A lexicon from about ``per_label`` toxic and as many other documents (a bounded sample, chosen by hash).

    Ids whose crc32 as text is divisible by 5 are held out. Rows of ``labels`` with a null label are left out. The
    sample of ids is what is broadcast: ``per_label`` rows for each of the two labels, give or take chance. An id with
    several texts gives the least of them; texts above ``max_chars`` are not learned from, which bounds the bytes.
    """
    usable = labels.filter("toxic is not null").filter(id_remainder("doc_id", 5) != 0).select("doc_id", "toxic")
    chosen = sample_by_label(usable, "toxic", per_label)  # ids only; the texts of all labelled rows would be shuffled
    spark = docs.sparkSession
    wanted = spark.createDataFrame(chosen[["doc_id", "toxic"]].astype("int64").values.tolist(), "doc_id long, toxic int")
    texts = (docs.filter(F.length("text") <= max_chars).select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
             .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))  # one text an id, so as many as ids
    return fit(texts.toPandas().sort_values(["doc_id", "text"], kind="stable").reset_index(drop=True), settings)


@register("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = train(docs, table(spark, sf_dir, "labels"))
    held = docs.withColumn("held_out", F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False)))
    return toxicity(held, lexicon, keep=("doc_id", "held_out"))
