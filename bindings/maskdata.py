"""Run-length text of rectangles, as inputs for the mask operators."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEIGHT, WIDTH = 48, 64


def counts_text(runs: list[int]) -> str:
    """Runs in the compressed text form of the published mask format, as one table of digits.

    From the fourth number on the format holds the difference to the number two before. A number is written in two's
    complement, in as few groups of five bits as hold it with its sign, low group first; 32 marks that more follow and
    48 makes it printable.
    """
    run = np.asarray(runs, dtype=np.int64)
    value = run.copy()
    value[3:] -= run[1:-2]
    bound = 16 << 5 * np.arange(8)  # k + 1 groups hold -bound[k] .. bound[k] - 1
    groups = 1 + ((value[:, None] >= bound) | (value[:, None] < -bound)).sum(axis=1)
    at = np.arange(8)
    digits = ((value[:, None] >> 5 * at) & 31) + 32 * (at < groups[:, None] - 1) + 48
    return digits[at < groups[:, None]].astype(np.uint8).tobytes().decode("ascii")


def rectangle_texts(x: np.ndarray, y: np.ndarray, width: np.ndarray, height: np.ndarray) -> list[str]:
    """``counts_text`` of each rectangle, as one array of runs."""
    if not len(x):
        return []
    first, n = x * HEIGHT + y, 2 * width + 1
    ends = np.cumsum(n)
    row = np.repeat(np.arange(len(x)), n)
    at = np.arange(ends[-1]) - (ends - n)[row]
    run = np.where(at % 2 == 1, height[row], HEIGHT - height[row])
    run[ends - n] = first
    run[ends - 1] = HEIGHT * WIDTH - first - (width - 1) * HEIGHT - height
    value = run.copy()
    value[at >= 3] -= run[np.flatnonzero(at >= 3) - 2]
    bound = 16 << 5 * np.arange(8)
    groups = 1 + ((value[:, None] >= bound) | (value[:, None] < -bound)).sum(axis=1)
    places = np.arange(8)
    digits = ((value[:, None] >> 5 * places) & 31) + 32 * (places < groups[:, None] - 1) + 48
    text = digits[places < groups[:, None]].astype(np.uint8).tobytes().decode("ascii")
    stops = np.cumsum(np.add.reduceat(groups, ends - n)).tolist()
    return [text[a:b] for a, b in zip([0, *stops], stops)]


@F.pandas_udf(T.StringType())
def rectangle_counts(left: pd.Series, top: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    parts = (slice(i, i + 4096) for i in range(0, len(left), 4096))
    return pd.Series([t for p in parts for t in rectangle_texts(*(c.iloc[p].astype("int64").to_numpy() for c in (left, top, w, h)))], dtype=object)
