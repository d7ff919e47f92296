"""Training batches encoded once, and their loss and gradient in memory that grows with a root of the lattices.

A batch holds what an evaluation needs of its pairs: codes of their elements (for a caller's own features, a code of each
cell and the non-zero features of each code as compressed rows), lengths, labels and how often each pair occurs.  Potentials
are looked up by code, so an evaluation multiplies features by parameters once for each code and not for each cell.

The lattice is walked by diagonals.  Going forward only every root-th group of diagonals is kept; going backward a segment
between two of them is walked again, and posteriors are added up by code as they come.  Two texts of 10,000 characters take
tens of megabytes this way.  States that can end in several classes carry an axis of classes backward, so one pass serves
all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from alignspark.operators.kernels import Batch, _class_of_states, dense, features, log_sum, sub_batches
from alignspark.spec import CHARACTERS, FeatureSpec, StateMachine

WIDTH = len(CHARACTERS) ** 2
#: Columns of an encoded batch, all numpy arrays as bytes; cells and the compressed rows are empty without own features.
ARRAYS = {
    "n1": np.int32, "n2": np.int32, "label": np.int32, "times": np.float64,
    "a": np.int32, "b": np.int32, "digit1": np.bool_, "digit2": np.bool_, "known1": np.int16, "known2": np.int16,
    "cells": np.int32, "indptr": np.int64, "indices": np.int32, "values": np.float64,
}
SCHEMA = ", ".join(f"{name} binary" for name in ARRAYS)


@dataclass
class Encoded:
    """One batch; a, b, digits and known are padded (pairs, longest); cells (pairs, I, J) or empty."""

    n1: np.ndarray
    n2: np.ndarray
    label: np.ndarray
    times: np.ndarray
    a: np.ndarray
    b: np.ndarray
    digit1: np.ndarray
    digit2: np.ndarray
    known1: np.ndarray
    known2: np.ndarray
    cells: np.ndarray
    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, batch: Batch, labels: np.ndarray, times: np.ndarray, spec: FeatureSpec) -> Encoded:
        own = spec.real or spec.sparse
        cells, rows = np.zeros((0,), np.int32), (np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0))
        if own:
            grid = dense(*features(batch, spec), spec.size)
            distinct, cells = np.unique(grid.reshape(-1, spec.size), axis=0, return_inverse=True)
            cells = cells.reshape(grid.shape[:3]).astype(np.int32)
            row, column = np.nonzero(distinct)
            rows = np.searchsorted(row, np.arange(len(distinct) + 1)), column.astype(np.int32), distinct[row, column]
        return cls(
            batch.n1.astype(np.int32), batch.n2.astype(np.int32), labels.astype(np.int32), times.astype(float), batch.a.astype(np.int32), batch.b.astype(np.int32),
            batch.digit1, batch.digit2, batch.known1.astype(np.int16), batch.known2.astype(np.int16), cells, *rows,
        )

    def to_row(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in ARRAYS.items()]

    @classmethod
    def from_row(cls, row: list[pa.Scalar]) -> Encoded:
        arrays = {name: np.frombuffer(cell.as_buffer(), kind) for (name, kind), cell in zip(ARRAYS.items(), row, strict=True)}
        n = len(arrays["n1"])
        for name in ("a", "b", "digit1", "digit2", "known1", "known2"):
            arrays[name] = arrays[name].reshape(n, -1)
        if len(arrays["cells"]):
            arrays["cells"] = arrays["cells"].reshape(n, arrays["a"].shape[1], -1)
        return cls(**arrays)


def encode(first: list, second: list, labels: list, times: list, spec: FeatureSpec, machine: StateMachine) -> Iterator[Encoded]:
    """Pairs in batches of similar shape; those without a result or whose label is no class are left out, but handle_invalid may raise."""
    for _, batch in encode_rows(first, second, labels, times, spec, machine):
        yield batch


def encode_rows(first: list, second: list, labels: list, times: list, spec: FeatureSpec, machine: StateMachine) -> Iterator[tuple[np.ndarray, Encoded]]:
    """The same, with the row numbers of each batch's pairs."""
    number = {label: c for c, label in enumerate(machine.classes)}
    width = machine.n_states * (1 if _class_of_states(machine) is not None else len(machine.classes))
    for rows in sub_batches(first, second, width, segments=True):
        batch = Batch.of([first[r] for r in rows], [second[r] for r in rows])
        own = np.array([number.get(labels[r], -1) for r in rows])
        good = batch.valid(spec) & (own >= 0)
        if not good.all():
            rows, own = rows[good], own[good]
            if not len(rows):
                continue
            batch = Batch.of([first[r] for r in rows], [second[r] for r in rows])
        yield rows, Encoded.of(batch, own, np.array([times[r] for r in rows], float), spec)


class Codes:
    """Codes of a batch's cells; each edge's weight by the code of its end (the end's own weight with it); sums by code."""

    def __init__(self, batch: Encoded, spec: FeatureSpec, machine: StateMachine, theta: np.ndarray) -> None:
        self.batch, self.spec, self.machine, self.theta = batch, spec, machine, theta
        self.at = next((at for name, at, _ in spec.blocks if name == "transition"), None)
        if len(batch.cells):
            count = len(batch.indptr) - 1
            self.owner = np.repeat(np.arange(count), np.diff(batch.indptr))
            table = np.zeros((len(theta), count))
            np.add.at(table.T, self.owner, theta.T[batch.indices] * batch.values[:, None])
            tables, self.at = [table], None
        else:  # bits for start, end, match, numeric
            bits = np.arange(16)
            value = {"bias": np.full(16, 1.0 if spec.bias is None else float(spec.bias)), "start": bits & 1, "end": bits >> 1 & 1, "match": bits >> 2 & 1, "numeric": bits >> 3 & 1}
            self.planes = np.stack([value[name] for name in spec.planes]).astype(float) if spec.planes else np.zeros((0, 16))
            tables = [theta[:, : len(spec.planes)] @ self.planes]
            if self.at is not None:  # the last code: a pair of characters that isn't known
                tables.append(np.c_[theta[:, self.at : self.at + WIDTH], np.zeros(len(theta))])
        ends = [s1 for _, s1, _ in machine.transitions]
        self.nodes = [t[: machine.n_states] for t in tables]
        self.edges = [t[machine.n_states :] + t[ends] for t in tables]
        self.sums = [np.zeros_like(t) for t in self.edges]
        self.starts = [np.zeros_like(t) for t in self.nodes]

    def add_edges(self, t: int, codes: list[np.ndarray], values: np.ndarray) -> None:
        """Adds what passes transition t's edges into cells of these codes: values (pairs, cells)."""
        self.add(self.sums, t, codes, values)

    def add_starts(self, s: int, codes: list[np.ndarray], values: np.ndarray) -> None:
        self.add(self.starts, s, codes, values)

    def of(self, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        """Codes of the cells (i[k], j[k]): (pairs, cells), and those of their characters."""
        b, planes = self.batch, self.spec.planes
        if len(b.cells):
            return [b.cells[:, i, j].astype(np.intp)]
        code = np.zeros((len(b.n1), len(i)), np.intp)
        if "start" in planes:
            code += (i == 0) | (j == 0)
        if "end" in planes:
            code += 2 * ((i == b.n1[:, None] - 1) | (j == b.n2[:, None] - 1))
        if "match" in planes:
            code += 4 * (b.a[:, i] == b.b[:, j])
        if "numeric" in planes:
            code += 8 * (b.digit1[:, i] & b.digit2[:, j])
        if self.at is None:
            return [code]
        one, two = b.known1[:, i].astype(np.intp), b.known2[:, j].astype(np.intp)
        return [code, np.where((one >= 0) & (two >= 0), two + len(CHARACTERS) * one, WIDTH)]

    @staticmethod
    def weights(tables: list[np.ndarray], codes: list[np.ndarray]) -> list[np.ndarray]:
        """For each row of the tables: (pairs, cells)."""
        if len(codes) == 1:
            return [row.take(codes[0]) for row in tables[0]]
        return [one.take(codes[0]) + two.take(codes[1]) for one, two in zip(*tables, strict=True)]

    @staticmethod
    def add(sums: list[np.ndarray], row: int, codes: list[np.ndarray], values: np.ndarray) -> None:
        values = values.ravel()
        for table, code in zip(sums, codes, strict=True):
            table[row] += np.bincount(code.ravel(), values, table.shape[1])

    def total(self) -> np.ndarray:
        """The gradient of all that was added; what passes a node has come by one of its edges, or begins there."""
        b, out = self.batch, np.zeros_like(self.theta)
        tables = [np.concatenate([start, edge]) for start, edge in zip(self.starts, self.sums, strict=True)]
        for table, edge in zip(tables, self.sums, strict=True):
            for t, (_, s1, _) in enumerate(self.machine.transitions):
                table[s1] += edge[t]
        if len(b.cells):
            np.add.at(out.T, b.indices, tables[0].T[self.owner] * b.values[:, None])
            return out
        out[:, : len(self.spec.planes)] = tables[0] @ self.planes.T
        if self.at is not None:
            out[:, self.at : self.at + WIDTH] = tables[1][:, :WIDTH]
        return out


class Slopes(Codes):
    """Codes whose sums are the pairs' own: of the gradient's products with a direction of the parameters."""

    def __init__(self, batch: Encoded, spec: FeatureSpec, machine: StateMachine, theta: np.ndarray, direction: np.ndarray) -> None:
        super().__init__(batch, spec, machine, theta)
        along = Codes(batch, spec, machine, direction)
        self.along, self.first, self.slopes = along.edges, along.nodes, np.zeros(len(batch.n1))

    def add_edges(self, t: int, codes: list[np.ndarray], values: np.ndarray) -> None:
        self.slopes += (values * sum(table[t].take(code) for table, code in zip(self.along, codes, strict=True))).sum(1)

    def add_starts(self, s: int, codes: list[np.ndarray], values: np.ndarray) -> None:
        self.slopes += (values * sum(table[s].take(code) for table, code in zip(self.first, codes, strict=True))).sum(1)


def _log_sum(parts: np.ndarray) -> np.ndarray:
    """Log of the sum over the first axis (whose array is used up); all -inf gives -inf."""
    most = parts.max(0)
    np.maximum(most, -1e300, out=most)
    parts -= most
    np.exp(parts, out=parts)
    total = parts.sum(0)
    np.log(total, out=total)
    total += most
    return total


class Walk:
    """A batch's lattice by diagonals, d = i + j; arrays of a diagonal are (states, pairs, cells), -inf where there is no node."""

    def __init__(self, batch: Encoded, codes: Codes, machine: StateMachine) -> None:
        self.batch, self.machine, self.codes = batch, machine, codes
        self.size1, self.size2, self.states = batch.a.shape[1], batch.b.shape[1], machine.n_states
        self.moves = machine.transitions
        self.deep = max((di + dj for _, _, (di, dj) in self.moves), default=1)
        self.into = [[t for t, m in enumerate(self.moves) if m[1] == s] for s in range(self.states)]
        self.out = [[t for t, m in enumerate(self.moves) if m[0] == s] for s in range(self.states)]
        self.diagonals = self.size1 + self.size2 - 1
        self.last = (batch.n1 + batch.n2 - 2).astype(np.int64)

    def span(self, d: int) -> tuple[int, int]:
        """The diagonal's first i, and one more than its last."""
        return max(0, d - self.size2 + 1), min(self.size1 - 1, d) + 1

    def edges(self, d: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Codes of the diagonal's cells, and the weights of the edges that end there."""
        row = np.arange(*self.span(d))
        codes = self.codes.of(row, d - row)
        return codes, Codes.weights(self.codes.edges, codes)

    def forward(self, d: int, codes: list[np.ndarray], edges: list[np.ndarray], before) -> np.ndarray:
        """The diagonal's log weights from those before it; before(k): diagonal d - k."""
        low, high = self.span(d)
        out = np.full((self.states, len(self.batch.n1), high - low), -np.inf)
        if d == 0:
            for s, own in enumerate(Codes.weights(self.codes.nodes, codes)):
                if s in self.machine.start_states:
                    out[s] = own
            return out
        for s1, moves in enumerate(self.into):
            if not moves:
                continue
            come = np.full((len(moves), *out.shape[1:]), -np.inf)
            for k, t in enumerate(moves):
                s0, _, (di, dj) = self.moves[t]
                begin, end = max(low, di), min(high, d - dj + 1)
                if d >= di + dj and begin < end:
                    low0 = self.span(d - di - dj)[0]
                    np.add(before(di + dj)[s0][:, begin - di - low0 : end - di - low0], edges[t][:, begin - low : end - low], out=come[k][:, begin - low : end - low])
            out[s1] = _log_sum(come)
        return out

    def finish(self) -> np.ndarray:
        """Going forward: log weights at the pairs' last cells (pairs, states); keeps diagonals to walk back from."""
        self.every = max(self.deep, math.isqrt(self.diagonals) + 1)
        self.kept: dict[int, list] = {}
        ring: list = [None] * self.deep  # the last diagonals, the newest first
        out = np.full((len(self.batch.n1), self.states), -np.inf)
        for d in range(self.diagonals):
            if d % self.every == 0:
                self.kept[d] = list(ring)
            here = self.forward(d, *self.edges(d), lambda k, r=ring: r[k - 1])
            ring = [here, *ring[:-1]]
            done = np.flatnonzero(self.last == d)
            out[done] = here[:, done, self.batch.n1[done] - 1 - self.span(d)[0]].T
        return out

    def backward(self, final: np.ndarray, z: np.ndarray, times: np.ndarray) -> None:
        """Going backward: adds posteriors times a factor to the codes' sums.

        final: (states, axis), 0 where a state counts for the axis's class, else -inf; z, times: (states, axis, pairs), the
        class's log weight and the factor.
        """
        n, axis = len(self.batch.n1), final.shape[1]
        behind: list = [None] * self.deep  # first i, codes, edges and beta of the diagonals after d, the nearest first
        for begin in sorted(self.kept, reverse=True):
            alphas, held = {begin - 1 - k: a for k, a in enumerate(self.kept.pop(begin)) if a is not None}, {}
            for d in range(begin, min(begin + self.every, self.diagonals)):
                held[d] = self.edges(d)
                alphas[d] = self.forward(d, *held[d], lambda k, d=d, a=alphas: a[d - k])
            for d in sorted(held, reverse=True):
                low, high = self.span(d)
                beta = np.full((self.states, axis, n, high - low), -np.inf)
                for s0, moves in enumerate(self.out):
                    if not moves:
                        continue
                    go = np.full((len(moves), axis, n, high - low), -np.inf)
                    for k, t in enumerate(moves):
                        _, s1, (di, dj) = self.moves[t]
                        if behind[di + dj - 1] is None:
                            continue
                        low2, codes, edges, after = behind[di + dj - 1]
                        first, end = max(low, low2 - di), min(high, low2 + after.shape[3] - di)
                        if first >= end:
                            continue
                        here, there = slice(first - low, end - low), slice(first + di - low2, end + di - low2)
                        np.add(after[s1][:, :, there], edges[t][:, there], out=go[k][:, :, here])
                        log = go[k][:, :, here] + alphas[d][s0][:, here]
                        log -= z[s1][:, :, None]
                        np.exp(log, out=log)
                        log *= times[s1][:, :, None]
                        self.codes.add_edges(t, [c[:, there] for c in codes], log[0] if axis == 1 else log.sum(0))
                    beta[s0] = _log_sum(go)
                done = np.flatnonzero(self.last == d)
                for s in range(self.states):
                    at = self.batch.n1[done] - 1 - low
                    beta[s][:, done, at] = np.logaddexp(beta[s][:, done, at], final[s][:, None])
                if d == 0:
                    for s in self.machine.start_states:
                        log = alphas[0][s] + beta[s] - z[s][:, :, None]
                        self.codes.add_starts(s, held[0][0], (np.exp(log) * times[s][:, :, None]).sum(0))
                behind = [(low, *held.pop(d), beta), *behind[:-1]]
                alphas.pop(d, None)


def _passed(batch: Encoded, codes: Codes, machine: StateMachine) -> np.ndarray:
    """log p(label) of each pair, as often as it occurs; codes get what passes their cells, times the gradient's factors."""
    states, own = machine.n_states, _class_of_states(machine)
    member = np.array([[any(x == s and y == c for x, y in machine.states_to_classes) for c in machine.classes] for s in range(states)])
    final = np.where(member, 0.0, -np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        walk = Walk(batch, codes, machine)
        ends = walk.finish()
        z = np.stack([log_sum(ends + f) for f in final.T], 1)
        share = np.exp(z - log_sum(z)[:, None])
        answer = np.eye(len(machine.classes))[batch.label]
        value = batch.times * np.log((share * answer).sum(1))
        factor = (answer - share) * batch.times[:, None]
        z = np.where(np.isfinite(z), z, 0.0)
        if own is not None:
            at = np.maximum(own, 0)
            walk.backward(final.max(1, keepdims=True), z.T[at][:, None], factor.T[at][:, None])
        else:
            every = lambda x: np.broadcast_to(x.T, (states, *x.T.shape))
            walk.backward(final, every(z), every(factor))
    return value


def loss_gradient(batch: Encoded, spec: FeatureSpec, machine: StateMachine, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum over the batch's pairs (as often as each occurs) of log p(label), and its gradient."""
    codes = Codes(batch, spec, machine, theta)
    value = _passed(batch, codes, machine)
    return float(value.sum()), codes.total()


def loss_slopes(batch: Encoded, spec: FeatureSpec, machine: StateMachine, theta: np.ndarray, direction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each of the batch's pairs: log p(label), and its derivative along a direction of the parameters."""
    codes = Slopes(batch, spec, machine, theta, direction)
    return _passed(batch, codes, machine), codes.slopes
