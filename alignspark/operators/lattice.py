"""The alignment lattice as rows: edges that lie on some way from a start node to the pair's last cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignspark.operators.kernels import Batch, Edges, dense, features, lattice_edges, lattice_nodes, of_sizes, own_lattice, sub_batches
from alignspark.spec import FeatureSpec, OwnMachine, StateMachine

EDGES = "pair_id long, i0 int, j0 int, s0 int, i1 int, j1 int, s1 int, e int"


def edges(n1: int, n2: int, machine: StateMachine, cells: np.ndarray | None = None) -> list[tuple[int, ...]]:
    """(i0, j0, s0, i1, j1, s1, e), sorted; e is the row of the edge's parameters."""
    if not n1 or not n2:
        return []
    seen, todo = {(0, 0, s) for s in machine.start_states}, [(0, 0, s) for s in machine.start_states]
    into: dict[tuple, list[tuple]] = {}
    while todo:
        i, j, s = todo.pop()
        for t, (s0, s1, delta) in enumerate(machine.transitions):
            if s0 != s:
                continue
            di, dj = delta(i, j, cells) if callable(delta) else delta
            to = (i + di, j + dj, s1)
            if to[0] < n1 and to[1] < n2:
                into.setdefault(to, []).append((i, j, s, *to, t + machine.n_states))
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
    reach = [(n1 - 1, n2 - 1, s) for s in range(machine.n_states) if (n1 - 1, n2 - 1, s) in seen]
    kept, out = set(reach), []
    while reach:
        for edge in into.get(reach.pop(), ()):
            out.append(edge)
            if edge[:3] not in kept:
                kept.add(edge[:3])
                reach.append(edge[:3])
    return sorted(out)


def edge_batches(part: pa.RecordBatch, machine: StateMachine | OwnMachine, spec: FeatureSpec) -> Iterator[pa.RecordBatch]:
    """Edges of the lattices of a batch's pairs (pair_id, s1, s2); empty and null sequences have none."""
    names = [c.split()[0] for c in EDGES.split(", ")]
    ids, first, second = (part.column(c).to_pylist() for c in ("pair_id", "s1", "s2"))
    keep = np.array([r for r in range(len(ids)) if first[r] and second[r]], np.int64)
    for own in sub_batches([first[r] for r in keep], [second[r] for r in keep], machine.n_states + machine.n_transitions):
        own = keep[own]
        batch = Batch.of([first[r] for r in own], [second[r] for r in own])
        found = []
        if machine.static:
            one, back = of_sizes(batch)
            for t, (di, dj), p, i, j in lattice_edges(*lattice_nodes(one, machine), machine):
                s0, s1, _ = machine.transitions[t]
                found.append(np.stack([p, i, j, np.full(len(p), s0), i + di, j + dj, np.full(len(p), s1), np.full(len(p), machine.n_states + t)]))
            if found:
                found = [repeated(np.concatenate(found, 1), back)]
        else:
            columns, _ = own_lattice(batch, machine, Edges.of(machine, batch, dense(*features(batch, spec), spec.size)))
            found.append(np.stack(columns))
        if found:
            columns = np.concatenate(found, 1)
            pair = pa.array([ids[r] for r in own], pa.int64()).take(pa.array(columns[0]))
            yield pa.RecordBatch.from_arrays([pair, *(pa.array(c.astype(np.int32)) for c in columns[1:])], names)


def repeated(columns: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Edges (their first column: the number of a pair of lengths) for each pair whose lengths' number is in back."""
    columns = columns[:, np.argsort(columns[0], kind="stable")].astype(np.int32)
    begin, end = (np.searchsorted(columns[0], back, side) for side in ("left", "right"))
    counts = end - begin
    out = columns[:, np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
    out[0] = np.repeat(np.arange(len(back)), counts)
    return out


def lattice(pairs: DataFrame, machine: StateMachine | OwnMachine, spec: FeatureSpec | None = None) -> DataFrame:
    """Edges of every pair's lattice, for any machine; spec gives the features that callable moves look at."""
    spec = spec or FeatureSpec()

    def run(batches):
        for part in batches:
            yield from edge_batches(part, machine, spec)

    return pairs.select("pair_id", "s1", "s2").mapInArrow(run, EDGES)


def lattice_of_default(pairs: DataFrame, n_classes: int) -> DataFrame:
    """The default machine's lattice without Python: every move between two cells of the grid is in it."""
    n1, n2 = (F.when(F.length(c) > 0, F.length(c)).otherwise(0) for c in ("s1", "s2"))
    cells = pairs.select("pair_id", n1.alias("n1"), n2.alias("n2")).where("n1 > 0 AND n2 > 0")
    cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("n1") - 1)).alias("i0")).select("*", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)).alias("j0"))
    moves = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(di).alias("di"), F.lit(dj).alias("dj")) for m, (di, dj) in enumerate(((1, 1), (0, 1), (1, 0)))])
    out = cells.select("*", F.explode(moves).alias("d")).where("i0 + d.di < n1 AND j0 + d.dj < n2").select("*", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("s0"))
    e = F.col("s0") + n_classes + F.col("d.m") * n_classes
    return out.select("pair_id", F.col("i0").cast("int"), F.col("j0").cast("int"), F.col("s0").cast("int"), (F.col("i0") + F.col("d.di")).cast("int").alias("i1"), (F.col("j0") + F.col("d.dj")).cast("int").alias("j1"), F.col("s0").cast("int").alias("s1"), e.cast("int").alias("e"))
