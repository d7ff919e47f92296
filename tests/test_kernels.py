"""Kernels against numbers worked out by hand, brute force and each other."""

import itertools
import math

import numpy as np
import pytest

from alignspark.operators import encoded, kernels, lbfgs
from alignspark.operators.lattice import edges
from alignspark.operators.scoring import zeros
from alignspark.spec import CHARACTERS, FeatureSpec, Grid, StateMachine, custom_features


def tensor(x):
    """A batch of one pair whose cells have the given features."""
    x = np.asarray(x, float)
    spec = custom_features(real=[lambda a, b, k=k: x[:, :, k] for k in range(x.shape[2])])
    return spec, "a" * x.shape[0], "b" * x.shape[1]


def lattice_weights(x, theta, machine):
    spec, s1, s2 = tensor(x)
    batch = kernels.Batch.of([s1], [s2])
    planes, blocks = kernels.features(batch, spec)
    weights = kernels.potentials(planes, blocks, theta)
    cells = kernels.dense(planes, blocks, spec.size)
    return batch, weights, cells


# The inputs, machines and parameters of the tests from here to test_features, and the weights, edges and
# places of features that follow from them.
CONNECTED = [[[0, 1], [2, 1]], [[0, 1], [1, 0]]]


def test_forward_of_two_classes():
    machine = StateMachine.default("ab")
    theta = np.arange(-8, 8, dtype=float).reshape(8, 2)
    batch, weights, _ = lattice_weights(CONNECTED, theta, machine)
    alpha = kernels.forward(batch, machine, weights)[0]
    e = np.exp
    assert alpha[0, 0].tolist() == [-7, -5]
    assert alpha[0, 1].tolist() == [-29, -15]
    assert alpha[1, 0].tolist() == [-9, -3]
    assert np.allclose(alpha[1, 1], [math.log((e(-11) + e(-25) + e(-9)) * e(-8)), math.log((e(-1) + e(-9) + e(-7)) * e(-6))])


def test_forward_with_a_function_as_move():
    machine = StateMachine((0, 1), ((0, 0, (1, 1)), (0, 1, (0, 1)), (0, 0, (1, 0)), (0, 2, lambda i, j, x: (0, 2))), {0: "a", 1: "a", 2: "b"})
    theta = np.arange(-7, 7, dtype=float).reshape(7, 2)
    x = [[[0, 1], [1, 0], [2, 1]], [[0, 1], [1, 0], [1, 0]]]
    batch, weights, cells = lattice_weights(x, theta, machine)
    alpha = kernels.forward(batch, machine, weights, cells)[0]
    assert alpha[0, 0, 0] == -6
    assert alpha[1, 0, 0] == -8
    assert alpha[1, 1, 0] == -14
    assert alpha[1, 2, 1] == pytest.approx(-18)
    assert alpha[1, 2, 2] == pytest.approx(-6)


def test_backward():
    machine = StateMachine((0,), ((0, 0, (0, 1)), (0, 0, (1, 0))), {0: "a"})
    theta = np.arange(-3, 3, dtype=float).reshape(3, 2)
    batch, weights, _ = lattice_weights(CONNECTED, theta, machine)
    beta = kernels.backward(batch, machine, weights, np.zeros(1))[0, :, :, 0]
    assert np.allclose(beta, [[math.log(math.exp(-4) + math.exp(-12)), -2], [-4, 0]])


def test_both_ways_agree():
    machine = StateMachine.default("ab")
    theta = np.arange(-8, 8, dtype=float).reshape(8, 2)
    batch, weights, _ = lattice_weights(CONNECTED, theta, machine)
    alpha, beta = kernels.forward(batch, machine, weights), kernels.backward(batch, machine, weights, np.zeros(2))
    assert np.allclose(alpha[0, 1, 1], beta[0, 0, 0] + weights[0, 0, 0, :2])


def test_lattices():
    call = StateMachine((0, 1), ((0, 0, (1, 1)), (0, 1, (0, 1)), (0, 0, (1, 0)), (0, 3, lambda i, j, x: (0, 2))), {0: 0, 1: 1, 3: 3})
    assert edges(2, 3, call) == [(0, 0, 0, 1, 0, 0, 6), (0, 0, 0, 1, 1, 0, 4), (1, 0, 0, 1, 2, 3, 7), (1, 1, 0, 1, 2, 1, 5)]
    jump = StateMachine((0, 1), ((0, 0, (1, 1)), (0, 1, (0, 2)), (0, 0, (1, 0))), {0: 0, 1: 1})
    assert edges(2, 3, jump) == [(0, 0, 0, 1, 0, 0, 4), (1, 0, 0, 1, 2, 1, 3)]
    assert edges(0, 3, jump) == []
    assert len(edges(70, 2, StateMachine.default("a"))) == 69 * 2 + 70 + 69


def test_moves_must_advance():
    for delta in ((0, 0), (-1, 1)):
        with pytest.raises(ValueError):
            StateMachine((0,), ((0, 0, delta),), {0: "a"})


def test_features():
    batch = kernels.Batch.of(["kat1"], ["cat2"])
    planes, _ = kernels.features(batch, FeatureSpec(bias=2.0, start=True, match=True, numeric=True))
    want = np.zeros((4, 4, 4))
    want[..., 0] = 2
    want[:, 0, 1] = want[0, :, 1] = 1
    want[1, 1, 2] = want[2, 2, 2] = want[3, 3, 3] = 1
    assert (planes[0] == want).all()
    cells = kernels.dense(*kernels.features(kernels.Batch.of(["ba"], ["ca"]), FeatureSpec(transition=True)), 3970)[0]
    assert len(CHARACTERS) == 63
    assert [np.flatnonzero(cells[i, j]).tolist() for i in (0, 1) for j in (0, 1)] == [[0, 66], [0, 64], [0, 3], [0, 1]]


def test_tokens_and_own_features():
    spec = custom_features(real=[lambda a, b: a == b], sparse=[(lambda i, j, s1, s2: i * 2 + j, 6)])
    planes, blocks = kernels.features(kernels.Batch.of([["x", "yy"]], [["yy"]]), spec)
    assert planes[0, :2, :1, 0].tolist() == [[0.0], [1.0]]
    assert blocks[0][1][0].tolist() == [[0], [2]]
    assert spec.size == 7


def test_unknown_and_empty():
    pairs = (["a{", "", "ab"], ["a", "x", "ab"])
    machine = StateMachine.default("01")
    for how, good in (("keep", [True, False, True]), ("skip", [False, False, True])):
        spec = FeatureSpec(transition=True, handle_invalid=how)
        z = kernels.class_log_weights(*pairs, spec, machine, zeros(spec, machine))
        assert (~np.isnan(z).any(1)).tolist() == good
    spec = FeatureSpec(transition=True, handle_invalid="error")
    with pytest.raises(kernels.InvalidSequence):
        kernels.class_log_weights(*pairs, spec, machine, zeros(spec, machine))


def brute(s1, s2, spec, machine, theta, best=False):
    batch = kernels.Batch.of([s1], [s2])
    w = kernels.potentials(*kernels.features(batch, spec), theta)[0]
    found = {}

    def walk(i, j, s, total):
        if (i, j) == (len(s1) - 1, len(s2) - 1):
            found.setdefault(s, []).append(total)
        for t, (a, b, (di, dj)) in enumerate(machine.transitions):
            if a == s and i + di < len(s1) and j + dj < len(s2):
                walk(i + di, j + dj, b, total + w[i + di, j + dj, machine.n_states + t] + w[i + di, j + dj, b])

    for s in machine.start_states:
        walk(0, 0, s, w[0, 0, s])
    out = []
    for label in machine.classes:
        ends = [max(found[s]) if best else np.logaddexp.reduce(found[s]) for s, c in machine.states_to_classes if c == label and s in found]
        out.append(np.logaddexp.reduce(ends) if ends else -np.inf)
    return out


GENERAL = StateMachine((0, 2), ((0, 0, (1, 1)), (0, 1, (1, 0)), (1, 0, (1, 1)), (0, 0, (0, 1)), (2, 2, (1, 1)), (2, 3, (0, 2)), (3, 2, (1, 1)), (2, 2, (1, 0)), (2, 2, (0, 1))), {0: "x", 1: "x", 2: "y", 3: "y"})


@pytest.mark.parametrize("machine", [StateMachine.default("abc"), GENERAL])
@pytest.mark.parametrize("best", [False, True])
def test_weights_against_all_paths(machine, best):
    spec = FeatureSpec(start=True, end=True, match=True, numeric=True)
    theta = np.random.default_rng(1).normal(size=(machine.n_states + machine.n_transitions, spec.size))
    pairs = list(itertools.product(["a", "7b", "ab7", "b7a1"], ["b", "a7", "7ab", "1a7b"]))
    z = kernels.class_log_weights(*zip(*pairs, strict=True), spec, machine, theta, best)
    want = np.array([brute(a, b, spec, machine, theta, best) for a, b in pairs])
    assert np.allclose(z, want)


#: States 0 and 1 can end in both classes.
MIXED = StateMachine((0,), ((0, 0, (1, 1)), (0, 1, (1, 0)), (1, 0, (1, 1)), (0, 0, (0, 1)), (0, 0, (1, 0)), (0, 2, (1, 1)), (2, 2, (1, 0)), (2, 2, (0, 1)), (2, 2, (1, 1))), {0: "x", 1: "y", 2: "y"})
OWN = custom_features(real=[lambda a, b: a < b], sparse=[(lambda i, j, s1, s2: (i + j) % 5, 5)])
SPECS = [FeatureSpec(start=True, match=True, end=True, numeric=True), FeatureSpec(transition=True), OWN]


def by_segments(first, second, labels, spec, machine, theta, times=None):
    """Loss and gradient from encoded batches that went through bytes."""
    import pyarrow as pa

    value, gradient = 0.0, np.zeros_like(theta)
    for batch in encoded.encode(first, second, labels, times or [1.0] * len(first), spec, machine):
        batch = encoded.Encoded.from_row([pa.scalar(x, pa.binary()) for x in batch.to_row()])
        one, own = encoded.loss_gradient(batch, spec, machine, theta)
        value, gradient = value + one, gradient + own
    return value, gradient


@pytest.mark.parametrize("machine", [StateMachine.default("xyz"), GENERAL, MIXED])
@pytest.mark.parametrize("spec", SPECS)
def test_gradient_against_differences(machine, spec):
    rng = np.random.default_rng(2)
    theta = rng.normal(0, 0.3, (machine.n_states + machine.n_transitions, spec.size))
    first, second, labels = ["abc", "ab", "b7c", "abcd"], ["abd", "ab", "a7", "bcd"], ["x", "x", "y", "x"]
    value, gradient = by_segments(first, second, labels, spec, machine, theta)
    where = [(r, k) for r, k in zip(*np.nonzero(gradient), strict=True)]
    for r, k in [where[i] for i in rng.integers(0, len(where), 25)]:
        up, down = theta.copy(), theta.copy()
        up[r, k] += 1e-5
        down[r, k] -= 1e-5
        slope = (by_segments(first, second, labels, spec, machine, up)[0] - by_segments(first, second, labels, spec, machine, down)[0]) / 2e-5
        assert slope == pytest.approx(gradient[r, k], abs=1e-6)


@pytest.mark.parametrize("machine", [StateMachine.default("xyz"), GENERAL, MIXED])
@pytest.mark.parametrize("spec", SPECS)
def test_segments_give_what_whole_lattices_give(machine, spec):
    rng = np.random.default_rng(3)
    theta = rng.normal(0, 0.3, (machine.n_states + machine.n_transitions, spec.size))
    text = lambda n: "".join(rng.choice(list("ab7 {"), n))
    first, second = [text(n) for n in (40, 3, 17, 1, 0, 90)], [text(n) for n in (31, 5, 17, 1, 4, 7)]
    labels, times = ["x", "y", "x", "x", "x", "y"], [1.0, 2.0, 1.0, 3.0, 1.0, 1.0]
    every = [r for r, n in enumerate(times) for _ in range(int(n))]
    want = kernels.loss_gradient(*([x[r] for r in every] for x in (first, second, labels)), spec, machine, theta)
    got = by_segments(first, second, labels, spec, machine, theta, times)
    assert got[0] == pytest.approx(want[0]) and np.allclose(got[1], want[1])


def test_memory_of_a_gradient_grows_with_a_root():
    """Of two texts of 1,500 characters a whole lattice would hold 2.25 million nodes a state, with edges and posteriors."""
    import tracemalloc

    rng = np.random.default_rng(4)
    spec, machine = FeatureSpec(match=True), StateMachine.default("xy")
    theta = rng.normal(0, 0.1, (8, 2))
    texts = ["".join(rng.choice(list("abcdef"), 1500)) for _ in range(2)]
    batch = next(iter(encoded.encode([texts[0]], [texts[1]], ["x"], [1.0], spec, machine)))
    tracemalloc.start()
    encoded.loss_gradient(batch, spec, machine, theta)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 25e6 < 1500 * 1500 * 8 * 2


LOOKS = lambda i, j, x: (0, 2) if x[i, j, 1] else (1, 1)
CALLABLE = StateMachine((0, 1), ((0, 0, (1, 0)), (0, 1, LOOKS), (1, 0, (1, 1)), (0, 0, (0, 1)), (1, 1, (0, 1))), {0: "x", 1: "y"})
ARRAYS = StateMachine((0, 1), ((0, 0, (1, 0)), (0, 1, Grid(lambda i, j, x: (1 - x[..., 1].astype(int), 1 + x[..., 1].astype(int)))), (1, 0, (1, 1)), (0, 0, (0, 1)), (1, 1, (0, 1))), {0: "x", 1: "y"})


def test_callable_moves_against_differences_and_grids():
    rng = np.random.default_rng(5)
    spec = FeatureSpec(match=True, end=True)
    theta = rng.normal(0, 0.3, (7, spec.size))
    first, second, labels = ["abc", "ab", "b7cab", "abcd"], ["abd", "abb", "a7b", "bcd"], ["x", "x", "y", "x"]
    value, gradient = kernels.loss_gradient(first, second, labels, spec, CALLABLE, theta)
    other = kernels.loss_gradient(first, second, labels, spec, ARRAYS, theta)
    assert value == pytest.approx(other[0]) and np.allclose(gradient, other[1])
    for r, k in np.ndindex(theta.shape):
        up, down = theta.copy(), theta.copy()
        up[r, k] += 1e-5
        down[r, k] -= 1e-5
        slope = (kernels.loss_gradient(first, second, labels, spec, CALLABLE, up)[0] - kernels.loss_gradient(first, second, labels, spec, CALLABLE, down)[0]) / 2e-5
        assert slope == pytest.approx(gradient[r, k], abs=1e-6)
    best = kernels.class_log_weights(first, second, spec, CALLABLE, theta, True)
    assert np.allclose(best, kernels.class_log_weights(first, second, spec, ARRAYS, theta, True))
    for a, b in zip(first, second, strict=True):
        batch = kernels.Batch.of([a], [b])
        cells = kernels.dense(*kernels.features(batch, spec), spec.size)
        found, _ = kernels.own_lattice(batch, CALLABLE, kernels.Edges.of(CALLABLE, batch, cells))
        assert sorted(zip(*(c.tolist() for c in found[1:]), strict=True)) == edges(len(a), len(b), CALLABLE, cells[0])


def test_features_over_grids():
    own = custom_features(real=[lambda a, b: a < b], sparse=[(lambda i, j, a, b: (i * j) % 5 if a[i] != "c" else -1, 5)])
    grid = custom_features(real=[Grid(lambda a, b: a < b)], sparse=[(Grid(lambda i, j, a, b: np.where(a != "c", (i * j) % 5, -1)), 5)])
    for first, second in ((["abc", "a", "dcba"], ["b", "acc", "7"]), ([["x", "c"], ["c"]], [["y"], ["a", "zz", "c"]])):
        batch = kernels.Batch.of(first, second)
        one, two = (kernels.dense(*kernels.features(batch, s), 6) for s in (own, grid))
        for p in range(len(first)):
            assert (one[p, : len(first[p]), : len(second[p])] == two[p, : len(first[p]), : len(second[p])]).all()


def test_batches_and_padding_change_nothing(monkeypatch):
    spec, machine = FeatureSpec(match=True, end=True), StateMachine.default("01")
    theta = np.random.default_rng(5).normal(size=(8, 3))
    first, second = ["a" * n for n in (1, 70, 3, 61, 2)], ["ba" * n for n in (40, 1, 2, 33, 30)]
    together = kernels.class_log_weights(first, second, spec, machine, theta)
    monkeypatch.setattr(kernels, "BUDGET", 1)
    assert np.allclose(together, kernels.class_log_weights(first, second, spec, machine, theta))
    turned = theta[[0, 1, 2, 3, 6, 7, 4, 5]]
    assert np.allclose(together, kernels.class_log_weights(second, first, spec, machine, turned))


@pytest.mark.parametrize("best", [False, True])
@pytest.mark.parametrize("machine", [StateMachine.default("abc"), GENERAL])
def test_a_few_diagonals_give_what_whole_lattices_give(machine, best):
    spec = FeatureSpec(start=True, end=True, match=True, numeric=True, transition=True)
    theta = np.random.default_rng(8).normal(0, 0.2, (machine.n_states + machine.n_transitions, spec.size))
    batch = kernels.Batch.of(["a", "ab1", "x" * 40, "ba{7"], ["b9", "b", "xy" * 9, "7{"])
    whole = kernels.forward(batch, machine, kernels.potentials(*kernels.features(batch, spec), theta), best=best)
    assert np.allclose(kernels.last_weights(batch, spec, machine, theta, best), whole[np.arange(4), batch.n1 - 1, batch.n2 - 1])


def test_edges_of_many_pairs_at_once():
    for machine in (StateMachine.default("ab"), GENERAL):
        batch = kernels.Batch.of(["a", "abc", "abcde", "ab"], ["b", "ab", "abcd", "abcdefgh"])
        found = [[] for _ in range(4)]
        for t, (di, dj), p, i, j in kernels.lattice_edges(*kernels.lattice_nodes(batch, machine), machine):
            for n, x, y in zip(p.tolist(), i.tolist(), j.tolist(), strict=True):
                found[n].append((x, y, machine.transitions[t][0], x + di, y + dj, machine.transitions[t][1], machine.n_states + t))
        assert [sorted(f) for f in found] == [edges(len(a), len(b), machine) for a, b in zip(batch.first, batch.second, strict=True)]


def test_long_strings_against_a_plain_recurrence():
    rng = np.random.default_rng(6)
    spec, machine = FeatureSpec(match=True), StateMachine.default("01")
    theta = rng.normal(0, 0.3, (8, 2))
    first, second = ["".join(rng.choice(list("abc"), n)) for n in (130, 61, 1)], ["".join(rng.choice(list("abc"), n)) for n in (97, 60, 90)]
    got = kernels.class_log_weights(first, second, spec, machine, theta)
    for s1, s2, z in zip(first, second, got, strict=True):
        for c in (0, 1):
            node, mat, ins, dele = (lambda a, b, r=theta[c + 2 * m]: r[0] + r[1] * (a == b) for m in range(4))
            w = {}
            for i, a in enumerate(s1):
                for j, b in enumerate(s2):
                    come = [w[i - x, j - y] + f(a, b) for x, y, f in ((1, 1, mat), (0, 1, ins), (1, 0, dele)) if (i - x, j - y) in w]
                    w[i, j] = node(a, b) + (np.logaddexp.reduce(come) if come else 0.0)
            assert z[c] == pytest.approx(w[len(s1) - 1, len(s2) - 1])


def test_lbfgs():
    def rosenbrock(x):
        a, b = x
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    found = lbfgs.minimise(rosenbrock, np.array([-1.2, 1.0]))
    assert found.converged and np.allclose(found.x, 1, atol=1e-4)


def test_static_lattices_are_walked_once_for_each_pair_of_lengths(monkeypatch):
    import pyarrow as pa

    from alignspark.operators.lattice import edge_batches
    from alignspark.plans.queries import GENERAL

    walked, walk = [], kernels.forward
    monkeypatch.setattr(kernels, "forward", lambda batch, *rest, **more: (walked.append(len(batch)), walk(batch, *rest, **more))[1])
    first, second = ["abc", "ab", "xyz", None, "", "q", "ba"] * 50, ["abcd", "abc", "abdd", "a", "b", "q", "yyy"] * 50
    part = pa.RecordBatch.from_arrays([pa.array(range(350)), pa.array(first), pa.array(second)], ["pair_id", "s1", "s2"])
    got = sorted(tuple(r.values()) for b in edge_batches(part, GENERAL, FeatureSpec()) for r in b.to_pylist())
    assert got == sorted((k, *e) for k in range(350) for e in edges(len(first[k] or ""), len(second[k] or ""), GENERAL))
    assert sum(walked) == 3
    walked.clear()
    whole = kernels.Batch.of(["abc", "ab", "xyz"] * 20, ["abcd", "abc", "abdd"] * 20)
    on = kernels.lattice_nodes(whole, GENERAL)
    assert walked == [2]
    for k in range(60):
        alone = kernels.lattice_nodes(kernels.Batch.of(whole.first[k : k + 1], whole.second[k : k + 1]), GENERAL)
        assert all((x[k, : whole.n1[k], : whole.n2[k]] == y[0]).all() for x, y in zip(on, alone, strict=True))


def test_a_banded_lattice_is_built_once_for_each_size():
    from alignspark.plans.queries import Banded

    assert Banded().build_lattice(np.zeros((7, 6, 3))) is Banded().build_lattice(np.ones((7, 6, 3)))
