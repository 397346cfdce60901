"""Pluggable text encoder (L3, I6): a user's callable turns texts into vectors inside the tasks.

The user gives a *loader*, a picklable function without arguments that returns the encoder (a callable from a list of texts to rows of
numbers).  It runs once per Python worker and name: loading a model is paid per worker, not per batch or task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.session import ship_package

Encoder = Callable[[Sequence[str]], np.ndarray]
_LOADED: dict[str, Encoder] = {}


def loaded(name: str, loader: Callable[[], Encoder]) -> Encoder:
    """The encoder of this worker."""
    if name not in _LOADED:
        _LOADED[name] = loader()
    return _LOADED[name]


def encode(df: DataFrame, text: str, name: str, loader: Callable[[], Encoder], width: int, out: str = "embedding", rows: int = 256) -> DataFrame:
    """``df`` with the column ``out`` (array<double> of ``width`` numbers): the encoder's vector of ``text``; null text is empty.

    The encoder sees at most ``rows`` texts at a time.  A result of another shape is an error, and so is a number that is
    not finite.
    """
    ship_package(df.sparkSession)
    kept = df.drop(out)
    at = kept.columns.index(text)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from claimlens.operators.encoder import loaded as of_worker
        encoder = of_worker(name, loader)
        for b in batches:
            for i in range(0, b.num_rows, rows):
                part = b.slice(i, rows)
                v = np.asarray(encoder([t or "" for t in part.column(at).to_pylist()]), float)
                if v.shape != (part.num_rows, width):
                    raise ValueError(f"encoder {name} gave shape {v.shape} for {part.num_rows} texts, not {(part.num_rows, width)}")
                if not np.isfinite(v).all():
                    raise ValueError(f"encoder {name} gave a number that is not finite")
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * width, pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, flat], names=[*part.schema.names, out])

    return kept.mapInArrow(fn, T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def hashing_encoder(width: int = 64) -> Callable[[], Encoder]:
    """Loader of an encoder without a model: signed hashes of a text's words, at unit length."""
    def load() -> Encoder:
        word = re.compile(r"\w+")

        def encoder(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), width))
            for i, t in enumerate(texts):
                for w in word.findall(t.lower()):
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    out[i, h % width] += 1.0 if h >> 63 else -1.0
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norm > 0, norm, 1)
        return encoder
    return load


def as_vector(df: DataFrame, column: str = "embedding") -> DataFrame:
    """The array column as a vector column for the feature stages."""
    from pyspark.ml.functions import array_to_vector
    return df.withColumn(column, array_to_vector(F.col(column)))
