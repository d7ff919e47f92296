"""Scoring: one narrow Arrow stage from pairs to class weights, probabilities and predictions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignspark.operators import kernels
from alignspark.spec import FeatureSpec, StateMachine


@dataclass(frozen=True)
class Parameters:
    """A fitted model: features, machine, theta (states' rows, then transitions')."""

    spec: FeatureSpec
    machine: StateMachine
    theta: np.ndarray

    def __post_init__(self) -> None:
        want = (self.machine.n_states + self.machine.n_transitions, self.spec.size)
        if self.theta.shape != want:
            raise ValueError(f"theta is {self.theta.shape}, the features and the machine need {want}")

    def table(self, spark: SparkSession) -> DataFrame:
        """row, k, value."""
        rows = [(r, k, float(v)) for (r, k), v in np.ndenumerate(self.theta)]
        return spark.createDataFrame(rows, "row int, k int, value double")


def zeros(spec: FeatureSpec, machine: StateMachine) -> np.ndarray:
    return np.zeros((machine.n_states + machine.n_transitions, spec.size))


def _with_kernel(pairs: DataFrame, columns: list[str], model: Parameters, best: bool, extra: str, make) -> DataFrame:
    """pairs' columns with what make gives of the pairs' class weights, in slices of bounded size."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*columns).schema) + ", " + extra
    names = [*columns, *(c.strip().split(" ")[0] for c in extra.split(", "))]

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 2048):
                part = whole.slice(begin, 2048)
                first, second = ([s if s is not None else "" for s in part.column(c).to_pylist()] for c in ("s1", "s2"))
                z = kernels.class_log_weights(first, second, model.spec, model.machine, model.theta, best)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *make(z)], names)

    wanted = list(dict.fromkeys([*columns, "s1", "s2"]))
    return pairs.select(*wanted).mapInArrow(run, schema)


def _lists(values: np.ndarray, good: np.ndarray) -> pa.Array:
    return pa.array([row.tolist() if ok else None for row, ok in zip(values, good, strict=True)], pa.list_(pa.float64()))


def class_log_weights(pairs: DataFrame, model: Parameters, best: bool = False) -> DataFrame:
    """pair_id, weights: each class's log weight, classes sorted; null where a pair has no result."""
    return _with_kernel(pairs, ["pair_id"], model, best, "weights array<double>", lambda z: [_lists(z, ~np.isnan(z).any(1))])


def score(pairs: DataFrame, model: Parameters, best: bool = False, keep: list[str] | None = None) -> DataFrame:
    """pair_id (and keep) with probability (classes sorted) and prediction (its likeliest class, as a string).

    best: alignments' maximum instead of their sum; classes are normalised by their sum either way.
    """
    labels = np.array([str(c) for c in model.machine.classes], object)

    def make(z: np.ndarray) -> list[pa.Array]:
        good = ~np.isnan(z).any(1)
        total = kernels.log_sum(z)
        p = np.exp(z - total[:, None])
        good &= np.isfinite(total)
        top = np.where(good, np.nan_to_num(p, nan=-1).argmax(1), 0)
        return [_lists(p, good), pa.array([label if ok else None for label, ok in zip(labels[top].tolist(), good, strict=True)], pa.string())]

    return _with_kernel(pairs, ["pair_id", *(keep or [])], model, best, "probability array<double>, prediction string", make)


def balanced(pairs: DataFrame, parts: int) -> DataFrame:
    """pairs dealt so that every part has some of each cost: cost grows with the product of the lengths, not with rows."""
    kinds = dict(pairs.dtypes)
    long = lambda c: F.size(c) if kinds[c].startswith("array") else F.length(c)
    cost = F.floor(F.log2(F.greatest(long("s1") * long("s2"), F.lit(1))))
    return pairs.repartition(parts, cost, F.pmod(F.xxhash64("s1", "s2", *(c for c in ("pair_id",) if c in pairs.columns)), F.lit(4 * parts)))


FEATURES = "pair_id long, i int, j int, k int, value double"


def feature_batches(part: pa.RecordBatch, spec: FeatureSpec) -> Iterator[pa.RecordBatch]:
    """Features that aren't zero of a batch's pairs (pair_id, s1, s2); empty and null sequences have none."""
    ids, first, second = (part.column(c).to_pylist() for c in ("pair_id", "s1", "s2"))
    keep = [r for r in range(len(ids)) if first[r] and second[r]]
    for rows in kernels.sub_batches([first[r] for r in keep], [second[r] for r in keep], len(spec.planes) + 1):
        rows = [keep[r] for r in rows]
        batch = kernels.Batch.of([first[r] for r in rows], [second[r] for r in rows])
        planes, blocks = kernels.features(batch, spec)
        inside = (np.arange(planes.shape[1])[None, :, None] < batch.n1[:, None, None]) & (np.arange(planes.shape[2])[None, None, :] < batch.n2[:, None, None])
        p, i, j, k = np.nonzero(planes * inside[..., None])
        found = [(p, i, j, k, planes[p, i, j, k])]
        for at, index in blocks:
            p, i, j = np.nonzero((index >= 0) & inside)
            found.append((p, i, j, at + index[p, i, j], np.ones(len(p))))
        p, i, j, k, v = (np.concatenate(c) for c in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[rows][p], pa.int64()), *(pa.array(x, pa.int32()) for x in (i, j, k)), pa.array(v)], [c.split()[0] for c in FEATURES.split(", ")])


def feature_rows(pairs: DataFrame, spec: FeatureSpec) -> DataFrame:
    """pair_id, i, j, k, value of features that aren't zero, for any spec, a caller's functions too."""

    def run(batches):
        for part in batches:
            yield from feature_batches(part, spec)

    return pairs.select("pair_id", "s1", "s2").mapInArrow(run, FEATURES)


def sparse_cells(pairs: DataFrame, spec: FeatureSpec) -> DataFrame:
    """pair_id, i, j, indices, values: each cell's features that aren't zero, as a sparse vector (an empty one if all are)."""

    def run(batches):
        for part in batches:
            ids, first, second = (part.column(c).to_pylist() for c in ("pair_id", "s1", "s2"))
            keep = np.array([r for r in range(len(ids)) if first[r] and second[r]], np.int64)
            for own in kernels.sub_batches([first[r] for r in keep], [second[r] for r in keep], len(spec.planes) + len(spec.blocks) + 1):
                own = keep[own]
                batch = kernels.Batch.of([first[r] for r in own], [second[r] for r in own])
                planes, blocks = kernels.features(batch, spec)
                p, i, j = np.nonzero((np.arange(planes.shape[1])[None, :, None] < batch.n1[:, None, None]) & (np.arange(planes.shape[2])[None, None, :] < batch.n2[:, None, None]))
                # all planes, then a column for each block (its index, or none)
                values = np.concatenate([planes[p, i, j], *[(index[p, i, j] >= 0)[:, None].astype(float) for _, index in blocks]], 1)
                indices = np.concatenate([np.broadcast_to(np.arange(planes.shape[3]), (len(p), planes.shape[3])), *[(at + index[p, i, j])[:, None] for at, index in blocks]], 1)
                on = values != 0
                ends = pa.array(np.r_[0, np.cumsum(on.sum(1))].astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (indices[on].astype(np.int32), values[on])]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[own][p]), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *lists], ["pair_id", "i", "j", "indices", "values"])

    return pairs.select("pair_id", "s1", "s2").mapInArrow(run, "pair_id long, i int, j int, indices array<int>, values array<double>")


def node_edge_weights(pairs: DataFrame, model: Parameters, direction: str) -> tuple[DataFrame, DataFrame]:
    """Log weights of the lattice's nodes (pair_id, i, j, s, w) and edges (pair_id, i0, j0, s0, i1, j1, s1, e, w).

    direction: "forward" (all ways from the start to and with it) or "backward" (all ways from it to the end; a node's own
    potential left out, an edge's too, its destination's taken).  Ways that can't be walked have no row.
    """
    if direction not in ("forward", "backward"):
        raise ValueError(direction)
    machine, states = model.machine, model.machine.n_states
    node_schema, edge_schema = "pair_id long, i int, j int, s int, w double", "pair_id long, i0 int, j0 int, s0 int, i1 int, j1 int, s1 int, e int, w double"

    def columns_of(kind: int, first: list, second: list):
        """Of a sub-batch: nodes (pair, i, j, s, w) or edges (pair, i0, j0, s0, i1, j1, s1, e, w) as columns."""
        batch = kernels.Batch.of(first, second)
        planes, blocks = kernels.features(batch, model.spec)
        weights = kernels.potentials(planes, blocks, model.theta)
        cells = None if machine.static else kernels.Edges.of(machine, batch, kernels.dense(planes, blocks, model.spec.size))
        ahead = direction == "forward"
        held = kernels.forward(batch, machine, weights, cells) if ahead else kernels.backward(batch, machine, weights, np.zeros(states), cells)
        if machine.static:
            from_start, to_end = kernels.lattice_nodes(batch, machine)
            if kind == 0:
                p, i, j, s = np.nonzero(from_start & to_end)
                return p, i, j, s, held[p, i, j, s]
            parts = []
            for t, (di, dj), p, i, j in kernels.lattice_edges(from_start, to_end, machine):
                s0, s1, e = machine.transitions[t][0], machine.transitions[t][1], states + t
                w = held[p, i, j, s0] + weights[p, i + di, j + dj, e] if ahead else held[p, i + di, j + dj, s1] + weights[p, i + di, j + dj, s1]
                full = lambda v, n=len(p): np.full(n, v)
                parts.append((p, i, j, full(s0), i + di, j + dj, full(s1), full(e), w))
            return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else tuple(np.zeros(0) for _ in range(9))
        (p, i0, j0, s0, i1, j1, s1, e), on = kernels.own_lattice(batch, machine, cells)
        if kind == 0:
            at = np.nonzero(on)
            return *at, held[at]
        return p, i0, j0, s0, i1, j1, s1, e, held[p, i0, j0, s0] + weights[p, i1, j1, e] if ahead else held[p, i1, j1, s1] + weights[p, i1, j1, s1]

    def rows(kind: int, schema: str):
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches):
            for part in batches:
                ids, first, second = (part.column(c).to_pylist() for c in ("pair_id", "s1", "s2"))
                keep = np.array([r for r in range(len(ids)) if first[r] and second[r]], np.int64)
                for own in kernels.sub_batches([first[r] for r in keep], [second[r] for r in keep], model.theta.shape[0]):
                    own = keep[own]
                    columns = columns_of(kind, [first[r] for r in own], [second[r] for r in own])
                    pair = pa.array([ids[r] for r in own], pa.int64()).take(pa.array(columns[0].astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pair, *(pa.array(c.astype(np.int32)) for c in columns[1:-1]), pa.array(columns[-1].astype(float))], names)

        return pairs.select("pair_id", "s1", "s2").mapInArrow(run, schema)

    return rows(0, node_schema), rows(1, edge_schema)


def to_json(model: Parameters) -> str:
    """A model without a caller's functions as text."""
    spec, machine = model.spec, model.machine
    if spec.real or spec.sparse or not machine.static:
        raise ValueError("a caller's functions can't be saved")
    return json.dumps({
        "spec": {k: getattr(spec, k) for k in ("bias", "start", "end", "match", "numeric", "transition", "handle_invalid")},
        "machine": {"start_states": machine.start_states, "transitions": machine.transitions, "states_to_classes": machine.states_to_classes},
    })


def from_json(text: str, theta: np.ndarray) -> Parameters:
    d = json.loads(text)
    m = d["machine"]
    return Parameters(FeatureSpec(**d["spec"]), StateMachine(tuple(m["start_states"]), tuple((a, b, tuple(x)) for a, b, x in m["transitions"]), tuple((s, c) for s, c in m["states_to_classes"])), theta)
