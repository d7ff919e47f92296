"""Functions for SQL text: scores as a vectorised function, features and lattices as table functions."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, pandas_udf, udtf

from alignspark.operators import kernels, lattice, scoring
from alignspark.operators.scoring import Parameters

#: Pairs whose rows a vectorised function holds at once.
SLICE = 256


def _arrays(columns: list[pa.Array], found: list[pa.RecordBatch], kind: pa.StructType) -> pa.Array:
    """Of each pair of a slice: its rows, from batches whose pair_id is the pair's place; null for pairs without a sequence."""
    if not found:
        return pa.nulls(len(columns[0]), pa.list_(kind))
    whole = pa.Table.from_batches(found)
    at, blank = whole.column("pair_id").to_numpy(), np.array([not a or not b for a, b in zip(*(c.to_pylist() for c in columns), strict=True)], bool)
    whole = whole.take(pa.array(np.argsort(at, kind="stable"))).combine_chunks()
    ends = np.r_[0, np.cumsum(np.bincount(at, minlength=len(blank)))].astype(np.int32)
    rows = pa.StructArray.from_arrays([whole.column(f.name).combine_chunks() for f in kind], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.r_[blank, False]), rows)


def register(spark: SparkSession, model: Parameters, name: str = "pair_proba", best: bool = False, prefix: str = "pair") -> None:
    """SQL functions name(s1, s2) -> array<double> (classes sorted), and, for LATERAL joins, prefix_features(s1, s2) and prefix_lattice(s1, s2).

    The table functions give rows as they are found: of features those that aren't zero, without a grid of all of them.
    They are called pair by pair, as a LATERAL join takes no vectorised one; prefix_feature_rows(s1, s2) and
    prefix_lattice_rows(s1, s2) work on many pairs at once and give a pair's rows as an array, for LATERAL VIEW inline(...).
    """

    def vectorised(run, schema: str):
        fields = [c.split() for c in schema.split(", ")][1:]
        kind = pa.struct([(name, {"int": pa.int32(), "double": pa.float64()}[t]) for name, t in fields])

        @arrow_udf(f"array<struct<{', '.join(f'{name}: {t}' for name, t in fields)}>>")
        def rows(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for first, second in batches:
                for begin in range(0, len(first), SLICE):
                    own = [first.slice(begin, SLICE), second.slice(begin, SLICE)]
                    part = pa.RecordBatch.from_arrays([pa.array(np.arange(len(own[0]))), *own], ["pair_id", "s1", "s2"])
                    yield _arrays(own, list(run(part)), kind)

        return rows

    @pandas_udf("array<double>")
    def proba(s1: pd.Series, s2: pd.Series) -> pd.Series:
        first, second = ([x if isinstance(x, str) else "" for x in s] for s in (s1, s2))
        z = kernels.class_log_weights(first, second, model.spec, model.machine, model.theta, best)
        p = np.exp(z - kernels.log_sum(z)[:, None])
        return pd.Series([row.tolist() if not np.isnan(row).any() else None for row in p], index=s1.index)

    @udtf(returnType="i: int, j: int, k: int, value: double")
    class PairFeatures:
        def eval(self, s1: str, s2: str):
            if s1 and s2:
                planes, blocks = kernels.features(kernels.Batch.of([s1], [s2]), model.spec)
                for i, j, k in zip(*(x.tolist() for x in np.nonzero(planes[0])), strict=True):
                    yield i, j, k, float(planes[0, i, j, k])
                for at, index in blocks:
                    for i, j in zip(*(x.tolist() for x in np.nonzero(index[0] >= 0)), strict=True):
                        yield i, j, at + int(index[0, i, j]), 1.0

    @udtf(returnType="i0: int, j0: int, s0: int, i1: int, j1: int, s1: int, e: int")
    class PairLattice:
        def eval(self, s1: str, s2: str):
            if s1 and s2 and model.machine.static:
                batch = kernels.Batch.of([s1], [s2])
                for t, (di, dj), _, i, j in kernels.lattice_edges(*kernels.lattice_nodes(batch, model.machine), model.machine):
                    a, b, _ = model.machine.transitions[t]
                    for x, y in zip(i.tolist(), j.tolist(), strict=True):
                        yield x, y, a, x + di, y + dj, b, t + model.machine.n_states
            elif s1 and s2:
                batch = kernels.Batch.of([s1], [s2])
                found, _ = kernels.own_lattice(batch, model.machine, kernels.Edges.of(model.machine, batch, kernels.dense(*kernels.features(batch, model.spec), model.spec.size)))
                yield from zip(*(c.tolist() for c in found[1:]), strict=True)

    spark.udf.register(name, proba)
    spark.udf.register(f"{prefix}_feature_rows", vectorised(lambda part: scoring.feature_batches(part, model.spec), scoring.FEATURES))
    spark.udf.register(f"{prefix}_lattice_rows", vectorised(lambda part: lattice.edge_batches(part, model.machine, model.spec), lattice.EDGES))
    spark.udtf.register(f"{prefix}_features", PairFeatures)
    spark.udtf.register(f"{prefix}_lattice", PairLattice)
