"""Batches of pairs as padded arrays: features, potentials, sum-product and max-sum over the lattice, gradients.

All pairs of a batch advance together, by whole diagonals; a pair's result is read at its own last cell, so padding never
leaks into it.  Scores hold the last few diagonals only, so their memory grows with the strings' lengths and not with the
product; training holds whole lattices.  Moves that a caller's function decides go cell by cell.  -inf marks what can't
be reached.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from alignspark.spec import CHARACTERS, FeatureSpec, Grid, OwnMachine, StateMachine

#: Doubles that a sub-batch's potentials may take: those of whole lattices, those of one diagonal.
BUDGET, DIAGONAL = 4_000_000, 500_000
_INDEX = {c: i for i, c in enumerate(CHARACTERS)}


class InvalidSequence(ValueError):
    """An empty sequence, or an element that the features don't know."""


@dataclass
class Batch:
    """Pairs of sequences of ids, padded with -1 (s1) and -2 (s2), with what the features need of each element."""

    first: list
    second: list
    a: np.ndarray
    b: np.ndarray
    n1: np.ndarray
    n2: np.ndarray
    digit1: np.ndarray
    digit2: np.ndarray
    known1: np.ndarray
    known2: np.ndarray
    items: list  # the elements by their ids

    @classmethod
    def of(cls, first: list, second: list) -> Batch:
        """Strings are sequences of characters, lists of elements."""
        if all(isinstance(s, str) for s in first) and all(isinstance(s, str) for s in second):
            sides = [[np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for s in side] for side in (first, second)]
            values = np.unique(np.concatenate([*sides[0], *sides[1], np.zeros(0, np.int64)]))
            items = [chr(v) for v in values.tolist()]
            codes = [[np.searchsorted(values, s) for s in side] for side in sides]
        else:
            ids: dict = {}
            codes = [[np.array([ids.setdefault(x, len(ids)) for x in s], np.int64) for s in side] for side in (first, second)]
            items = list(ids)
        digit = np.array([str(x).isdigit() for x in items] + [False])
        known = np.array([_INDEX.get(str(x).lower(), -1) for x in items] + [-1])
        n1, n2 = (np.array([len(s) for s in side], np.int64) for side in codes)
        arrays = []
        for side, n, pad in ((codes[0], n1, -1), (codes[1], n2, -2)):
            out = np.full((len(side), int(n.max(initial=0))), pad, np.int64)
            if len(side):
                out[np.arange(out.shape[1]) < n[:, None]] = np.concatenate(side)
            arrays.append(out)
        a, b = arrays
        at = [np.where(x >= 0, x, len(items)) for x in (a, b)]
        return cls(first, second, a, b, n1, n2, digit[at[0]], digit[at[1]], known[at[0]], known[at[1]], items)

    def __len__(self) -> int:
        return len(self.n1)

    def elements(self) -> tuple[np.ndarray, np.ndarray]:
        """The sequences' elements, padded: (pairs, I, 1) and (pairs, 1, J); characters as an array of strings, others as objects."""
        items = np.array([*self.items, ""]) if self.items and isinstance(self.items[0], str) else np.array([*self.items, None], object)
        return items[np.where(self.a >= 0, self.a, -1)][:, :, None], items[np.where(self.b >= 0, self.b, -1)][:, None, :]

    def valid(self, spec: FeatureSpec) -> np.ndarray:
        """Pairs that have a result; raises on others if the features say so."""
        good = (self.n1 > 0) & (self.n2 > 0)
        if spec.transition and spec.handle_invalid != "keep":
            good &= ~(((self.known1 < 0) & (self.a >= 0)).any(1) | ((self.known2 < 0) & (self.b >= 0)).any(1))
        if spec.handle_invalid == "error" and not good.all():
            i = int(np.argmin(good))
            raise InvalidSequence(f"empty sequence or unknown character in {self.first[i]!r}, {self.second[i]!r}")
        return good


def features(batch: Batch, spec: FeatureSpec) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """planes (pairs, I, J, number of planes) and one-hot blocks: first index and each cell's index or -1."""
    n, size1, size2 = len(batch), batch.a.shape[1], batch.b.shape[1]
    i, j = np.arange(size1)[None, :, None], np.arange(size2)[None, None, :]
    own: dict[str, object] = {
        "bias": lambda: np.float64(spec.bias),
        "start": lambda: (i == 0) | (j == 0),
        "end": lambda: (i == batch.n1[:, None, None] - 1) | (j == batch.n2[:, None, None] - 1),
        "match": lambda: batch.a[:, :, None] == batch.b[:, None, :],
        "numeric": lambda: batch.digit1[:, :, None] & batch.digit2[:, None, :],
    }
    planes = np.zeros((n, size1, size2, len(spec.planes)))
    for k, name in enumerate(spec.planes):
        if name in own:
            planes[..., k] = own[name]()
        elif isinstance(function := spec.real[int(name[4:])], Grid):
            planes[..., k] = function(*batch.elements())
        else:
            for p in range(n):
                x, y = np.array(list(batch.first[p]), object), np.array(list(batch.second[p]), object)
                if len(x) and len(y):
                    planes[p, : len(x), : len(y), k] = np.broadcast_to(function(x[:, None], y[None, :]), (len(x), len(y)))
    blocks = []
    for name, at, _ in spec.blocks:
        if name == "transition":
            index = np.where((batch.known1[:, :, None] >= 0) & (batch.known2[:, None, :] >= 0), batch.known2[:, None, :] + len(CHARACTERS) * batch.known1[:, :, None], -1)
        elif isinstance(function := spec.sparse[int(name[6:])][0], Grid):
            index = np.broadcast_to(function(i, j, *batch.elements()), (n, size1, size2)).astype(np.int64)
            index = np.where((i < batch.n1[:, None, None]) & (j < batch.n2[:, None, None]), index, -1)
        else:
            index = np.full((n, size1, size2), -1, np.int64)
            for p in range(n):
                x, y = list(batch.first[p]), list(batch.second[p])
                for u in range(len(x)):
                    for v in range(len(y)):
                        index[p, u, v] = function(u, v, x, y)
        blocks.append((at, index))
    return planes, blocks


def potentials(planes: np.ndarray, blocks: list[tuple[int, np.ndarray]], theta: np.ndarray) -> np.ndarray:
    """Features times parameters: (pairs, I, J, rows of theta)."""
    out = planes @ theta[:, : planes.shape[-1]].T
    for at, index in blocks:
        out += np.where(index[..., None] >= 0, theta.T[at + np.maximum(index, 0)], 0.0)
    return out


@dataclass
class Edges:
    """Edges of a batch's pairs as flat node numbers, in the order of their sources' diagonals; e: rows of parameters.

    For machines whose moves a caller decides.  Nodes are numbered pair by pair, cell by cell, state by state.
    """

    source: np.ndarray
    target: np.ndarray
    e: np.ndarray
    state: np.ndarray  # of the target
    levels: np.ndarray  # where each diagonal's edges begin, and the end

    @classmethod
    def of(cls, machine: StateMachine | OwnMachine, batch: Batch, cells: np.ndarray) -> Edges:
        """cells: features of all cells (pairs, I, J, number)."""
        size1, size2, states = batch.a.shape[1], batch.b.shape[1], machine.n_states
        found = own_edges(machine, batch, cells) if isinstance(machine, OwnMachine) else moves(machine, batch, cells)
        p, i0, j0, s0, i1, j1, s1, e = (np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True)) if found else np.zeros((8, 0), np.int64)
        if len(p) and ((i1 < i0) | (j1 < j0) | (i0 + j0 == i1 + j1)).any():
            raise ValueError("a move must advance in one sequence at least and go back in none")
        number = lambda i, j, s: ((p * size1 + i) * size2 + j) * states + s
        order = np.argsort((i0 + j0) * (len(batch) * size1 * size2 * states) + number(i1, j1, s1), kind="stable")
        levels = np.searchsorted((i0 + j0)[order], np.arange(size1 + size2))
        return cls(number(i0, j0, s0)[order], number(i1, j1, s1)[order], e[order], s1[order], levels)

    def weights(self, weights: np.ndarray, states: int) -> np.ndarray:
        """Of each edge: its potential and its end's."""
        cell = self.target // states
        flat = weights.reshape(-1, weights.shape[-1])
        return flat[cell, self.e] + flat[cell, self.state]


def moves(machine: StateMachine, batch: Batch, cells: np.ndarray) -> list[tuple]:
    """Columns (pair, i0, j0, s0, i1, j1, s1, e) of each transition's moves inside the pairs; functions see whole grids or one cell."""
    n, size1, size2 = len(batch), batch.a.shape[1], batch.b.shape[1]
    i, j = np.arange(size1)[None, :, None], np.arange(size2)[None, None, :]
    inside = (i < batch.n1[:, None, None]) & (j < batch.n2[:, None, None])
    out = []
    for t, (s0, s1, delta) in enumerate(machine.transitions):
        if isinstance(delta, Grid):
            di, dj = (np.broadcast_to(x, (n, size1, size2)) for x in delta(i, j, cells))
        elif callable(delta):
            di, dj = np.zeros((2, n, size1, size2), np.int64)
            for p, x, y in zip(*np.nonzero(inside), strict=True):
                di[p, x, y], dj[p, x, y] = delta(x, y, cells[p, : batch.n1[p], : batch.n2[p]])
        else:
            di, dj = (np.broadcast_to(x, (n, size1, size2)) for x in delta)
        p, x, y = np.nonzero(inside & (i + di < batch.n1[:, None, None]) & (j + dj < batch.n2[:, None, None]))
        full = lambda v, k=len(p): np.full(k, v)
        out.append((p, x, y, full(s0), x + di[p, x, y], y + dj[p, x, y], full(s1), full(machine.n_states + t)))
    return out


def own_edges(machine: OwnMachine, batch: Batch, cells: np.ndarray) -> list[tuple]:
    out = []
    for p in range(len(batch)):
        rows = np.asarray(machine.inner.build_lattice(cells[p, : batch.n1[p], : batch.n2[p]]), np.int64).reshape(-1, 7)
        out.append((np.full(len(rows), p), *rows.T))
    return out


def edges_of(machine: StateMachine | OwnMachine, batch: Batch, cells: np.ndarray | Edges | None) -> Edges:
    return cells if isinstance(cells, Edges) else Edges.of(machine, batch, cells)


def _combined(values: np.ndarray, target: np.ndarray, come: np.ndarray, best: bool) -> None:
    """values[target] with come added (in log space) or their maximum; targets may be named several times."""
    order = np.argsort(target, kind="stable")
    target, come = target[order], come[order]
    first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
    add = np.maximum if best else np.logaddexp
    values[target[first]] = add(values[target[first]], add.reduceat(come, first))


def _groups(machine: StateMachine) -> list[tuple[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Static moves by delta: from, to and transition of moves to different states, which one assignment can update."""
    groups: list[tuple[tuple[int, int], list]] = []
    for t, (s0, s1, delta) in enumerate(machine.transitions):
        own = next((g for d, g in groups if d == delta and all(s1 != x[1] for x in g)), None)
        if own is None:
            groups.append((delta, own := []))
        own.append((s0, s1, t))
    return [(d, tuple(np.array(c) for c in zip(*g, strict=True))) for d, g in groups]


def diagonal_weights(batch: Batch, spec: FeatureSpec, theta: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Potentials of the cells (i[k], j[k]): (pairs, cells, rows of theta), without a caller's own features."""
    own = {
        "bias": lambda: np.full((len(batch), len(i)), float(spec.bias)),
        "start": lambda: np.broadcast_to((i == 0) | (j == 0), (len(batch), len(i))),
        "end": lambda: (i == batch.n1[:, None] - 1) | (j == batch.n2[:, None] - 1),
        "match": lambda: batch.a[:, i] == batch.b[:, j],
        "numeric": lambda: batch.digit1[:, i] & batch.digit2[:, j],
    }
    values = np.empty((len(batch), len(i), len(spec.planes)))
    for k, name in enumerate(spec.planes):
        values[..., k] = own[name]()
    out = values @ theta[:, : values.shape[-1]].T
    for _, at, _ in spec.blocks:
        first, second = batch.known1[:, i], batch.known2[:, j]
        index = np.where((first >= 0) & (second >= 0), second + len(CHARACTERS) * first, -1)
        out += np.where(index[..., None] >= 0, theta.T[at + np.maximum(index, 0)], 0.0)
    return out


def last_weights(batch: Batch, spec: FeatureSpec, machine: StateMachine, theta: np.ndarray, best: bool = False) -> np.ndarray:
    """Log weights of all alignments (of the best one) at the pairs' last cells: (pairs, states), holding a few diagonals."""
    n, size1, size2, states = len(batch), batch.a.shape[1], batch.b.shape[1], machine.n_states
    add, groups = np.maximum if best else np.logaddexp, _groups(machine)
    deep = max((di + dj for (di, dj), _ in groups), default=1) + 1
    ring = [np.full((n, size1, states), -np.inf) for _ in range(deep)]
    out, last = np.full((n, states), -np.inf), batch.n1 + batch.n2 - 2
    for d in range(size1 + size2 - 1):
        low, high = max(0, d - size2 + 1), min(size1 - 1, d) + 1
        row = np.arange(low, high)
        weights = diagonal_weights(batch, spec, theta, row, d - row)
        here = ring[d % deep]
        here[:] = -np.inf
        if d == 0:
            for s in machine.start_states:
                here[:, 0, s] = weights[:, 0, s]
        for (di, dj), (s0, s1, t) in groups:
            begin, end = max(low, di), min(high, d - dj + 1)
            if d >= di + dj and begin < end:
                own = weights[:, begin - low : end - low]
                come = ring[(d - di - dj) % deep][:, begin - di : end - di][..., s0] + own[..., states + t] + own[..., s1]
                target = here[:, begin:end]
                target[..., s1] = add(target[..., s1], come)
        done = np.flatnonzero(last == d)
        out[done] = here[done, batch.n1[done] - 1]
    return out


def forward(batch: Batch, machine: StateMachine, weights: np.ndarray, cells: np.ndarray | None = None, best: bool = False) -> np.ndarray:
    """Log weights of all alignments (of the best one) up to each node: (pairs, I, J, states)."""
    n, size1, size2, _ = weights.shape
    states = machine.n_states
    add = np.maximum if best else np.logaddexp
    alpha = np.full((n, size1, size2, states), -np.inf)
    for s in machine.start_states:
        alpha[:, 0, 0, s] = weights[:, 0, 0, s]
    if machine.static:
        groups = _groups(machine)
        for d in range(size1 + size2 - 1):  # every move leads to a later diagonal, so a diagonal's cells advance together
            row = np.arange(max(0, d - size2 + 1), min(size1 - 1, d) + 1)
            for (di, dj), (s0, s1, t) in groups:
                i = row[(row >= di) & (d - row >= dj)]
                if len(i):
                    j = d - i
                    own, here = weights[:, i, j], alpha[:, i, j]
                    come = alpha[:, i - di, j - dj][..., s0] + own[..., states + t] + own[..., s1]
                    here[..., s1] = add(here[..., s1], come)
                    alpha[:, i, j] = here
        return alpha
    edges = edges_of(machine, batch, cells)
    step, flat = edges.weights(weights, states), alpha.reshape(-1)
    for begin, end in zip(edges.levels[:-1], edges.levels[1:], strict=True):
        if begin < end:
            _combined(flat, edges.target[begin:end], flat[edges.source[begin:end]] + step[begin:end], best)
    return alpha


def backward(batch: Batch, machine: StateMachine, weights: np.ndarray, final: np.ndarray, cells: np.ndarray | None = None) -> np.ndarray:
    """Log weights of all alignments from each node to the pair's last cell, the node's own weight left out.

    final: log weight of ending in each state (0, or -inf for states that don't count).
    """
    n, size1, size2, _ = weights.shape
    states = machine.n_states
    beta = np.full((n, size1, size2, states), -np.inf)
    beta[np.arange(n), batch.n1 - 1, batch.n2 - 1] = final
    if machine.static:
        turned = []  # moves from different states, so that one assignment can update them
        for (di, dj), (s0, s1, t) in _groups(machine):
            left = list(zip(s0.tolist(), s1.tolist(), t.tolist(), strict=True))
            while left:
                now = [x for k, x in enumerate(left) if all(x[0] != y[0] for y in left[:k])]
                left = [x for x in left if x not in now]
                turned.append((di, dj, *(np.array(c) for c in zip(*now, strict=True))))
        for d in range(size1 + size2 - 2, -1, -1):
            row = np.arange(max(0, d - size2 + 1), min(size1 - 1, d) + 1)
            for di, dj, s0, s1, t in turned:
                i = row[(row + di < size1) & (d - row + dj < size2)]
                if len(i):
                    j = d - i
                    own, here = weights[:, i + di, j + dj], beta[:, i, j]
                    go = beta[:, i + di, j + dj][..., s1] + own[..., states + t] + own[..., s1]
                    here[..., s0] = np.logaddexp(here[..., s0], go)
                    beta[:, i, j] = here
        return beta
    edges = edges_of(machine, batch, cells)
    step, flat = edges.weights(weights, states), beta.reshape(-1)
    for begin, end in zip(edges.levels[-2::-1], edges.levels[:0:-1], strict=True):
        if begin < end:
            _combined(flat, edges.source[begin:end], flat[edges.target[begin:end]] + step[begin:end], False)
    return beta


def log_sum(x: np.ndarray, axis: int = -1) -> np.ndarray:
    most = x.max(axis, keepdims=True)
    safe = np.where(np.isfinite(most), most, 0)
    with np.errstate(divide="ignore"):
        return (np.log(np.exp(x - safe).sum(axis, keepdims=True)) + safe).squeeze(axis)


def class_weights(alpha: np.ndarray, batch: Batch, machine: StateMachine) -> np.ndarray:
    """Log weight of each class at the pairs' last cells; a class's states are added."""
    return of_classes(alpha[np.arange(len(batch)), batch.n1 - 1, batch.n2 - 1], machine)


def of_classes(last: np.ndarray, machine: StateMachine) -> np.ndarray:
    """(pairs, classes) of weights at the last cells (pairs, states)."""
    return np.stack([log_sum(last[:, [s for s, c in machine.states_to_classes if c == label]]) for label in machine.classes], 1)


def _own_edges(machine: StateMachine | OwnMachine, batch: Batch, planes: np.ndarray, blocks, size: int) -> Edges | None:
    return None if machine.static else Edges.of(machine, batch, dense(planes, blocks, size))


def dense(planes: np.ndarray, blocks: list[tuple[int, np.ndarray]], size: int) -> np.ndarray:
    """The whole feature tensor (pairs, I, J, size): only for callers' moves and for output."""
    out = np.zeros((*planes.shape[:3], size))
    out[..., : planes.shape[-1]] = planes
    for at, index in blocks:
        p, i, j = np.nonzero(index >= 0)
        out[p, i, j, at + index[p, i, j]] = 1.0
    return out


def class_log_weights(first: list, second: list, spec: FeatureSpec, machine: StateMachine, theta: np.ndarray, best: bool = False) -> np.ndarray:
    """(pairs, classes): log weight of each class; NaN for pairs without a result."""
    out = np.full((len(first), len(machine.classes)), np.nan)
    rolling = machine.static and not spec.real and not spec.sparse
    for rows in sub_batches(first, second, theta.shape[0] + machine.n_states, rolling):
        batch = Batch.of([first[r] for r in rows], [second[r] for r in rows])
        good = batch.valid(spec)
        if not good.all():
            rows = rows[good]
            if not len(rows):
                continue
            batch = Batch.of([first[r] for r in rows], [second[r] for r in rows])
        if rolling:
            out[rows] = of_classes(last_weights(batch, spec, machine, theta, best), machine)
        else:
            planes, blocks = features(batch, spec)
            weights = potentials(planes, blocks, theta)
            out[rows] = class_weights(forward(batch, machine, weights, _own_edges(machine, batch, planes, blocks, spec.size), best), batch, machine)
    return out


def sub_batches(first: list, second: list, width: int, rolling: bool = False, segments: bool = False) -> Iterator[np.ndarray]:
    """Row numbers in batches of similar shape whose arrays (of lattices, of diagonals, or of a root of all diagonals) stay in their budget."""
    n1, n2 = (np.array([len(s) if s is not None else 0 for s in side], np.int64) for side in (first, second))
    order = np.lexsort((n2, n1))
    begin = 0
    while begin < len(order):
        end, most1, most2, least2 = begin, 0, 0, n2[order[begin]]
        while end < len(order):
            most1, most2, least2 = max(most1, n1[order[end]]), max(most2, n2[order[end]]), min(least2, n2[order[end]])
            rows = (end + 1 - begin) * width
            many = rows * most1 > DIAGONAL if rolling else rows * most1 * (math.isqrt(int(most1 + most2)) + 1) > BUDGET if segments else rows * most1 * most2 > BUDGET
            if end > begin and (many or (rolling or segments) and most2 > 2 * least2 + 16):
                break
            end += 1
        yield order[begin:end]
        begin = end


def _class_of_states(machine: StateMachine) -> list[int] | None:
    """The one class that each state can end in (-1: none), or None where a state can end in several, or it isn't known."""
    if isinstance(machine, OwnMachine):
        return None
    reach: list[set] = [{c for x, c in machine.states_to_classes if x == s} for s in range(machine.n_states)]
    for _ in range(machine.n_states):
        for s0, s1, _ in machine.transitions:
            reach[s0] |= reach[s1]
    if any(len(r) > 1 for r in reach):
        return None
    return [machine.classes.index(next(iter(r))) if r else -1 for r in reach]


def loss_gradient(first: list, second: list, labels: list, spec: FeatureSpec, machine: StateMachine, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum over the pairs of log p(label), and its gradient, over whole lattices: for moves that a caller's function decides.

    Pairs without a result count nothing.  Where every state belongs to one class, one pass backward serves all classes.
    """
    total, gradient = 0.0, np.zeros_like(theta)
    classes, states, own_class = machine.classes, machine.n_states, _class_of_states(machine)
    for rows in sub_batches(first, second, 3 * theta.shape[0]):
        batch = Batch.of([first[r] for r in rows], [second[r] for r in rows])
        good = batch.valid(spec)
        if not good.all():
            rows = rows[good]
            if not len(rows):
                continue
            batch = Batch.of([first[r] for r in rows], [second[r] for r in rows])
        planes, blocks = features(batch, spec)
        weights = potentials(planes, blocks, theta)
        cells = _own_edges(machine, batch, planes, blocks, spec.size)
        alpha = forward(batch, machine, weights, cells)
        z = class_weights(alpha, batch, machine)
        share = np.exp(z - log_sum(z)[:, None])
        answer = np.array([[label == labels[r] for label in classes] for r in rows], float)
        with np.errstate(divide="ignore"):
            total += float(np.log((share * answer).sum(1)).sum())
        final = lambda c: np.array([0.0 if any(x == s and (c is None or y == c) for x, y in machine.states_to_classes) else -np.inf for s in range(states)])
        if own_class is not None:
            at = np.maximum(own_class, 0)
            post = posteriors(batch, machine, weights, alpha, backward(batch, machine, weights, final(None), cells), z[:, at], cells, (answer - share)[:, at])
        else:
            post = np.zeros_like(weights)
            for c, label in enumerate(classes):
                every = np.repeat(z[:, c : c + 1], states, 1)
                post += posteriors(batch, machine, weights, alpha, backward(batch, machine, weights, final(label), cells), every, cells, np.repeat((answer - share)[:, c : c + 1], states, 1))
        gradient[:, : planes.shape[-1]] += np.einsum("nijr,nijk->rk", post, planes)
        for at, index in blocks:
            p, i, j = np.nonzero(index >= 0)
            np.add.at(gradient.T, at + index[p, i, j], post[p, i, j])
    return total, gradient


def posteriors(batch: Batch, machine: StateMachine, weights: np.ndarray, alpha: np.ndarray, beta: np.ndarray, z: np.ndarray, cells: np.ndarray | None = None, times: np.ndarray | None = None) -> np.ndarray:
    """Probability that an alignment of the class passes each node and each edge (by its destination cell): like weights.

    z: log weight of the class that each state belongs to (pairs, states); times: a factor for each of these.
    """
    states = machine.n_states
    z = np.where(np.isfinite(z), z, 0.0)
    times = np.ones_like(z) if times is None else times
    out = np.zeros_like(weights)
    out[..., :states] = np.exp(alpha + beta - z[:, None, None, :]) * times[:, None, None, :]
    if machine.static:
        size1, size2 = weights.shape[1:3]
        for t, (s0, s1, (di, dj)) in enumerate(machine.transitions):
            if di < size1 and dj < size2:
                own = weights[:, di:, dj:]
                log = alpha[:, : size1 - di, : size2 - dj, s0] + own[..., states + t] + own[..., s1] + beta[:, di:, dj:, s1]
                out[:, di:, dj:, states + t] = np.exp(log - z[:, None, None, s1]) * times[:, None, None, s1]
        return out
    edges = edges_of(machine, batch, cells)
    p = edges.target // (weights.shape[1] * weights.shape[2] * states)
    log = alpha.reshape(-1)[edges.source] + edges.weights(weights, states) + beta.reshape(-1)[edges.target] - z[p, edges.state]
    np.add.at(out.reshape(-1, out.shape[-1]), (edges.target // states, edges.e), np.exp(log) * times[p, edges.state])
    return out


def lattice_nodes(batch: Batch, machine: StateMachine | OwnMachine, edges: Edges | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Whether each node can be reached from a start, and whether the pair's last cell can be reached from it.

    Moves that don't look at the pair's elements are walked once for each pair of lengths.
    """
    if machine.static:
        one, back = of_sizes(batch)
        if len(one) < len(batch):
            return tuple(x[back] for x in lattice_nodes(one, machine))
    none = np.zeros((len(batch), batch.a.shape[1], batch.b.shape[1], machine.n_states + machine.n_transitions))
    return forward(batch, machine, none, edges, best=True) == 0, backward(batch, machine, none, np.zeros(machine.n_states), edges) > -np.inf


def of_sizes(batch: Batch) -> tuple[Batch, np.ndarray]:
    """One of the batch's pairs for each pair of lengths, in arrays as wide as the batch's, and the number of each pair's."""
    _, rows, back = np.unique(batch.n1 * (batch.b.shape[1] + 1) + batch.n2, return_index=True, return_inverse=True)
    sides = [[side[r] for r in rows] for side in (batch.first, batch.second)]
    arrays = (x[rows] for x in (batch.a, batch.b, batch.n1, batch.n2, batch.digit1, batch.digit2, batch.known1, batch.known2))
    return Batch(*sides, *arrays, batch.items), back


def own_lattice(batch: Batch, machine: StateMachine | OwnMachine, edges: Edges) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Columns (pair, i0, j0, s0, i1, j1, s1, e) of the edges on some way from a start to the last cell, and which nodes are on one."""
    from_start, to_end = lattice_nodes(batch, machine, edges)
    shape = from_start.shape
    on = from_start.reshape(-1)[edges.source] & to_end.reshape(-1)[edges.target]
    p, i0, j0, s0 = np.unravel_index(edges.source[on], shape)
    _, i1, j1, s1 = np.unravel_index(edges.target[on], shape)
    return (p, i0, j0, s0, i1, j1, s1, edges.e[on]), from_start & to_end


def lattice_edges(from_start: np.ndarray, to_end: np.ndarray, machine: StateMachine) -> Iterator[tuple[int, tuple[int, int], np.ndarray, np.ndarray, np.ndarray]]:
    """For each static transition: its number, its delta, and pair, i and j of the cells that its edges leave from."""
    size1, size2 = from_start.shape[1:3]
    for t, (s0, s1, (di, dj)) in enumerate(machine.transitions):
        if di < size1 and dj < size2:
            yield t, (di, dj), *np.nonzero(from_start[:, : size1 - di, : size2 - dj, s0] & to_end[:, di:, dj:, s1])
