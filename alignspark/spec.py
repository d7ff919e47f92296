"""What a model is made of: features of a cell, and the state machine that walks the alignment lattice."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

# The characters that transition features know, in the order of their indices.
CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789,./;'\\-=<>?:\"|_+!@#$%^&*() "

WIDTH = len(CHARACTERS) ** 2
INVALID = ("error", "skip", "keep")


@dataclass(frozen=True)
class Grid:
    """A caller's function over whole arrays, called once for a batch of pairs instead of cell by cell.

    As a real feature: (elements of s1, elements of s2) -> values; as a sparse one: (i, j, elements of s1, elements of s2) ->
    indices, negative where there is none; as a move: (i, j, features of the cells) -> (di, dj).  i is a column, j a row;
    elements of s1 come as (pairs, I, 1), of s2 as (pairs, 1, J), features as (pairs, I, J, number); results may be
    anything that broadcasts to (pairs, I, J).  Cells beyond a pair's lengths hold padding, and what they give is dropped.
    """

    function: Callable

    def __call__(self, *arrays):
        return self.function(*arrays)


@dataclass(frozen=True)
class FeatureSpec:
    """Features of a cell (i, j) of a pair, in this order: bias, start, end, match, numeric, custom real ones, transition,
    custom sparse ones.

    real: functions of (column of s1's elements, row of s2's elements) that give a grid.  sparse: (function of (i, j, s1,
    s2) that gives an index, number of indices).  Either may be a Grid, which takes a whole batch at once.  handle_invalid, for characters that transition features don't know:
    "error" raises, "skip" gives the pair no result, "keep" leaves the feature out of the cell; for empty sequences:
    "error" raises, the others give no result.
    """

    bias: float | None = 1.0
    start: bool = False
    end: bool = False
    match: bool = False
    numeric: bool = False
    transition: bool = False
    real: tuple[Callable, ...] = ()
    sparse: tuple[tuple[Callable, int], ...] = ()
    handle_invalid: str = "keep"

    def __post_init__(self) -> None:
        if self.handle_invalid not in INVALID:
            raise ValueError(f"handle_invalid must be one of {INVALID}")

    @property
    def planes(self) -> list[str]:
        """Names of the features that every cell has a value of."""
        flags = (("start", self.start), ("end", self.end), ("match", self.match), ("numeric", self.numeric))
        return ["bias"] * (self.bias is not None) + [n for n, on in flags if on] + [f"real{i}" for i in range(len(self.real))]

    @property
    def blocks(self) -> list[tuple[str, int, int]]:
        """One-hot blocks: name, first index, width."""
        out, at = [], len(self.planes)
        for name, width in [("transition", WIDTH)] * self.transition + [(f"sparse{i}", w) for i, (_, w) in enumerate(self.sparse)]:
            out.append((name, at, width))
            at += width
        return out

    @property
    def size(self) -> int:
        return len(self.planes) + sum(w for _, _, w in self.blocks)


def custom_features(real: Iterable[Callable] = (), sparse: Iterable[tuple[Callable, int]] = (), handle_invalid: str = "keep") -> FeatureSpec:
    """Only a caller's own features: real ones first, then a block for each sparse one."""
    return FeatureSpec(bias=None, real=tuple(real), sparse=tuple(sparse), handle_invalid=handle_invalid)


Delta = tuple[int, int] | Callable


@dataclass(frozen=True)
class StateMachine:
    """States, moves between them, and the class that each accepting state stands for.

    A move is (from, to, (di, dj)) or (from, to, function of (i, j, features of the pair's cells) that gives (di, dj)), or a
    Grid of that.
    Moves must advance: none may go back, or stay in its cell.  States that no class names don't accept.
    """

    start_states: tuple[int, ...]
    transitions: tuple[tuple[int, int, Delta], ...]
    states_to_classes: tuple[tuple[int, object], ...] = field(default=())

    def __post_init__(self) -> None:
        object.__setattr__(self, "start_states", tuple(self.start_states))
        object.__setattr__(self, "transitions", tuple((a, b, d if callable(d) else tuple(d)) for a, b, d in self.transitions))
        classes = self.states_to_classes
        object.__setattr__(self, "states_to_classes", tuple(sorted((classes.items() if isinstance(classes, dict) else classes), key=lambda x: x[0])))
        for _, _, delta in self.transitions:
            if not callable(delta) and (min(delta) < 0 or max(delta) == 0):
                raise ValueError(f"a move must advance in one sequence at least and go back in none: {delta}")

    @property
    def n_states(self) -> int:
        named = [*self.start_states, *(s for t in self.transitions for s in t[:2]), *(s for s, _ in self.states_to_classes)]
        return max(named, default=-1) + 1

    @property
    def n_transitions(self) -> int:
        return len(self.transitions)

    @property
    def classes(self) -> list:
        return sorted({c for _, c in self.states_to_classes})

    @property
    def static(self) -> bool:
        return not any(callable(d) for _, _, d in self.transitions)

    @classmethod
    def of(cls, machine: object) -> StateMachine | OwnMachine:
        """A caller's own object as a machine: with start_states, transitions and states_to_classes, or with its own lattices."""
        if isinstance(machine, (cls, OwnMachine)):
            return machine
        return cls(machine.start_states, machine.transitions, machine.states_to_classes) if hasattr(machine, "transitions") else OwnMachine(machine)

    @classmethod
    def default(cls, classes: Iterable) -> StateMachine:
        """One state a class, each with the moves match, insertion (advances s2) and deletion (advances s1)."""
        labels = sorted(set(classes))
        moves = [(s, s, d) for d in ((1, 1), (0, 1), (1, 0)) for s in range(len(labels))]
        return cls(tuple(range(len(labels))), tuple(moves), tuple(enumerate(labels)))


@dataclass(frozen=True)
class OwnMachine:
    """A caller's object that builds its lattices itself.

    It has n_states, n_transitions, states_to_classes, and build_lattice(features of the pair's cells), which gives edges
    (i0, j0, s0, i1, j1, s1, row of the edge's parameters); edges must advance.  Ways begin at the first cell in its
    start_states, or in any state if it has none.
    """

    inner: object

    static = False
    transitions: tuple = ()

    @property
    def n_states(self) -> int:
        return self.inner.n_states

    @property
    def n_transitions(self) -> int:
        return self.inner.n_transitions

    @property
    def states_to_classes(self) -> tuple:
        classes = self.inner.states_to_classes
        return tuple(sorted(classes.items() if isinstance(classes, dict) else classes, key=lambda x: x[0]))

    @property
    def classes(self) -> list:
        return sorted({c for _, c in self.states_to_classes})

    @property
    def start_states(self) -> tuple:
        return tuple(getattr(self.inner, "start_states", range(self.n_states)))
