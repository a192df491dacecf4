"""Quality rules: counts of words, symbols, repeated lines and phrases, and compression bands.

A text is compressed with zstandard as a whole and in fixed chunks. Its ratio (bytes over compressed bytes) must lie
in the band of its length: repetitive text compresses far better than prose of that length, noise far worse. Short
texts have no lower limit, since the frame alone outweighs them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame, SparkSession

from .base import register, table, with_results


@dataclass(frozen=True)
class Band:
    """Texts of up to ``up_to`` bytes must have ``low <= ratio <= high``."""
    up_to: float
    low: float
    high: float


#: Limits by length. Prose of any language in the tables stays at least a fifth inside them.
BANDS = (Band(127, 0.0, 2.0), Band(511, 0.9, 2.4), Band(2047, 1.1, 2.8), Band(16_383, 1.2, 3.2),
         Band(float("inf"), 1.3, 4.0))

RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, ratio double, n_chunks long, n_bad_chunks long")
SYMBOLS = "#*$%&|<>"


def repeated_words(words: Sequence[bytes], window: int = 5) -> int:
    """Words inside windows that occur twice or more in the text, the first occurrence included."""
    grams = list(zip(*[words[i:] for i in range(window)]))
    if len(set(grams)) == len(grams):
        return 0
    often = {g for g, n in Counter(grams).items() if n > 1}
    total, upto = 0, 0
    for i, gram in enumerate(grams):
        if gram in often:
            total += i + window - max(i, upto)
            upto = i + window
    return total


def in_band(n_bytes: int, ratio: float, bands: Sequence[Band]) -> bool:
    band = next(b for b in bands if n_bytes <= b.up_to)
    return band.low <= ratio <= band.high


def rule_results(texts: Iterable[str | None], bands: Sequence[Band], chunk: int, bad_share: float,
                 level: int) -> Iterator[tuple]:
    compressor = zstandard.ZstdCompressor(level=level)

    def ratio(data: bytes) -> float:
        return len(data) / len(compressor.compress(data)) if data else 1.0

    for text in texts:
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()  # bytes split at exactly the blanks \x20 and \x09-\x0D
        n_words = len(words)
        word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
        seen: set[str] = set()
        dup_lines = 0
        if "\n" in text:
            for line in text.split("\n"):
                if line in seen:
                    dup_lines += bool(line.strip(" \t\x0b\x0c\r"))
                else:
                    seen.add(line)
        repeats = repeated_words(words)
        failed = n_words < 10 or 100 * repeats > 20 * n_words
        whole = ratio(data)
        parts = [data[i:i + chunk] for i in range(0, len(data), chunk)] if len(data) > chunk else []
        bad = sum(not in_band(len(p), ratio(p), bands) for p in parts)
        good = in_band(len(data), whole, bands) and bad <= bad_share * len(parts)
        yield (n_words, word_chars, sum(map(text.count, SYMBOLS)), dup_lines, repeats, failed,
               not failed and good, whole, len(parts), bad)


def quality_rules(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",),
                  bands: Sequence[Band] = BANDS, chunk: int = 4096, bad_share: float = 0.2, level: int = 3) -> DataFrame:
    """Columns ``keep`` plus the counts, ``base_failed``, ``kept``, ``ratio`` and the chunk counts of each text.

    A null text counts as empty: no words, base_failed, not kept. Documents are judged one by one and whole, so
    repeated rows give repeated results and an empty table none. ``bad_share`` is the share of chunks that may lie
    outside their band.
    """
    limits = tuple(bands)
    return with_results(docs, text, RESULT,
                        lambda texts: rule_results(texts, limits, chunk, bad_share, level), keep)


@register("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
