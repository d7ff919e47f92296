"""Vectors as rows of bytes: which take part, which are copies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from alignspark.llm.common import rows_of


def all_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, key (16 bytes, equal just for equal vectors), vec (their numbers as little-endian bytes), dim, for every row.

    key, vec and dim are null where the vector is null, zero or holds null or non-finite components, or vec_id is null.
    """
    single = isinstance(embeddings.schema["embedding"].dataType.elementType, FloatType)
    kind = np.float32 if single else np.float64

    def run(batches):
        for part in batches:
            vecs: list[bytes | None] = []
            for row, known in zip(part.column("embedding"), part.column("vec_id").is_valid().to_pylist(), strict=True):
                vecs.append(None)
                if known and row.is_valid and len(row.values) and not row.values.null_count:
                    v = row.values.to_numpy(zero_copy_only=False).astype(kind)
                    if np.isfinite(v).all() and v.any():
                        vecs[-1] = (v + kind(0)).tobytes()  # -0 is 0
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), part.column("label"), pa.array([v and xxhash.xxh3_128_digest(v) for v in vecs], pa.binary()), pa.array(vecs, pa.binary()), pa.array([v and len(v) // np.dtype(kind).itemsize for v in vecs], pa.int32())],
                ["vec_id", "label", "key", "vec", "dim"],
            )

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    return rows_of(rows, run, "vec_id long, label long, key binary, vec binary, dim int")


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """The rows of all_vectors that take part."""
    return all_vectors(embeddings).where("key IS NOT NULL")


def matrix(column, dim: int) -> np.ndarray:
    """The vectors of a column of bytes (all of one dimension) as rows."""
    data = column.to_pylist()
    kind = np.float32 if data and len(data[0]) == 4 * dim else np.float64
    return np.frombuffer(b"".join(data), kind).reshape(-1, dim)


def unit(x: np.ndarray, kind: type = np.float32) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(kind)
