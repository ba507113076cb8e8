"""Vectors of chunks by a caller's model, in batches.

The model is loaded once in a worker, at its first batch, and gets lists of at least
``MIN_BATCH`` texts (but for a task's last one), never one text at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_BATCH = 50
BATCH = 256

Model = Callable[[Sequence[str]], np.ndarray]


def encoder(load: Callable[[], Model], batch: int = BATCH) -> Callable[[Column], Column]:
    """A column function from texts to vectors (``array<float>``); null is an empty text.

    ``load`` gives the model, a function from texts to a matrix with a row for each.
    """
    if batch < MIN_BATCH:
        raise ValueError(f"a batch has {MIN_BATCH} texts at least")

    def made():
        model = load()

        def predict(texts: np.ndarray) -> np.ndarray:
            return np.asarray(model([str(x) for x in texts.ravel()]), np.float32)

        return predict

    encode = predict_batch_udf(made, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    return lambda text: encode(F.coalesce(text, F.lit("")))


def embedded(chunks: DataFrame, load: Callable[[], Model], batch: int = BATCH) -> DataFrame:
    """``chunks`` (with a ``document``) and their ``embedding``; give it to ``index.build`` as
    ``lambda fresh: embedded(fresh, load)``, and only fresh chunks meet the model."""
    return chunks.withColumn("embedding", encoder(load, batch)(F.col("document")))


def letters() -> Model:
    """A stand-in for a model, without weights: how often each of a to z occurs."""
    signs = np.array([chr(c) for c in range(97, 123)])
    return lambda texts: np.array([[t.count(s) for s in signs] for t in texts], np.float32).reshape(len(texts), 26)
