"""Small grey images drawn from the embedding vectors, as inputs for the image operators."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.operators.masks import png_bytes


@F.pandas_udf(T.BinaryType())
def _draw(vectors: pd.Series) -> pd.Series:
    import numpy as np

    def one(v) -> bytes:
        a = np.asarray(v, dtype="float64")
        spread = (a.max() - a.min()) or 1.0
        return png_bytes(((a - a.min()) / spread * 255).astype("uint8").reshape(-1, 8))

    return vectors.map(one)


def png_images(vectors: DataFrame) -> DataFrame:
    """(vec_id, content): each vector as an 8 pixel wide grey PNG."""
    return vectors.select("vec_id", _draw(F.col("embedding")).alias("content"))


