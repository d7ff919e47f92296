"""The same rows as the queries' in plain SQL: the recurrence as folds over lists."""

from __future__ import annotations

import numpy as np

from alignspark.functions.features import OTHER_DIGITS
from alignspark.spec import CHARACTERS

#: One character that is a digit to Python's isdigit.
DIGIT = rf"^[\p{{Nd}}{OTHER_DIGITS}]$"

PARTS = "SELECT a.p_partkey AS pair_id, a.p_name AS s1, b.p_name AS s2 FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"
CUSTOMERS = "SELECT a.c_custkey AS pair_id, a.c_name AS s1, b.c_name AS s2 FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1"
TYPOS = """
SELECT 2 * p_partkey AS pair_id, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, 'e', '3') WHEN 1 THEN p_name || right(p_name, 1)
  WHEN 2 THEN substr(p_name, 2) ELSE replace(p_name, 'i', 'ie') END AS s1, p_name AS s2, 'match' AS label FROM part
UNION ALL SELECT 2 * a.p_partkey + 1, a.p_name, b.p_name, 'non-match' FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 7 WHERE a.p_name <> b.p_name"""

ODD = """
SELECT p_partkey AS pair_id,
  CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN upper(p_name) WHEN 4 THEN left(p_name, 1) WHEN 5 THEN chr(178) || p_name WHEN 6 THEN chr(128578) || p_name ELSE repeat(p_name, 8) END AS s1,
  CASE p_partkey % 8 WHEN 0 THEN '' WHEN 5 THEN '2' || p_name WHEN 6 THEN p_name || chr(128578) WHEN 7 THEN left(p_name, 1) ELSE p_name END AS s2 FROM part"""

CELLS = """c AS (SELECT pair_id, i, j, length(s1) AS n1, length(s2) AS n2, substr(s1, i + 1, 1) AS c1, substr(s2, j + 1, 1) AS c2
  FROM (SELECT *, unnest(range(length(s1)))::INT AS i FROM p) q, LATERAL (SELECT unnest(range(length(q.s2)))::INT AS j))"""


def cells(source: str) -> str:
    return f"WITH p AS ({source}), {CELLS}"


PLANES = {
    "bias": "1.0::DOUBLE",
    "start": "(i = 0 OR j = 0)::INT::DOUBLE",
    "end": "(i = n1 - 1 OR j = n2 - 1)::INT::DOUBLE",
    "match": "(c1 = c2)::INT::DOUBLE",
    "numeric": f"(regexp_matches(c1, '{DIGIT}') AND regexp_matches(c2, '{DIGIT}'))::INT::DOUBLE",
}
_ALPHABET = CHARACTERS.replace("'", "''")
TRANSITION = f"(strpos('{_ALPHABET}', lower(c2)) - 1 + {len(CHARACTERS)} * (strpos('{_ALPHABET}', lower(c1)) - 1))"


def feature(name: str, source: str = PARTS) -> str:
    return f"{cells(source)} SELECT pair_id, i, j, {PLANES[name]} AS value FROM c"


def weight(row: np.ndarray, i: str, j: str, names: tuple[str, ...] = ("bias", "match", "numeric")) -> str:
    """theta's row times the features of cell (i, j), 1-based."""
    a, b = f"substr(s1, ({i})::BIGINT, 1)", f"substr(s2, ({j})::BIGINT, 1)"
    terms = {"bias": "1.0", "match": f"({a} = {b})::INT", "numeric": f"(regexp_matches({a}, '{DIGIT}') AND regexp_matches({b}, '{DIGIT}'))::INT"}
    used = [f"{float(v)!r} * {terms[n]}" for n, v in zip(names, row, strict=True) if v]
    return f"({' + '.join(used) or '0.0'})"


def transition(i: str, j: str) -> str:
    """The transition feature's index of cell (i, j), 1-based."""
    place = lambda s, k: f"(strpos('{_ALPHABET}', lower(substr({s}, ({k})::BIGINT, 1))) - 1)"
    return f"({place('s2', j)} + {len(CHARACTERS)} * {place('s1', i)})"


def by_transition(row: int, i: str, j: str) -> str:
    """The rule that gives queries their parameters of transition features: 0.3 of bias, and by the index and theta's row."""
    return f"(0.3 + ((({transition(i, j)} * {row + 1}) % 7) - 3) / 20.0)"


def rows_of(theta: np.ndarray, names: tuple[str, ...] = ("bias", "match", "numeric")):
    """Weights of cell (i, j) by theta's rows."""
    return lambda row, i, j: weight(theta[row], i, j, names)


def beta(n: int, c: int, at) -> str:
    """The lattice of class c from its end, for strings turned round: a list of rows of log weights."""
    node, mat, ins, dele = (c + m * n for m in range(4))
    step = lambda row, i, j: f"{at(row, i, j)} + {at(node, i, j)}"
    x, y, z = f"prev[j - 1] + {step(mat, 'i - 1', 'j - 1')}", f"acc[-1] + {step(ins, 'i', 'j - 1')}", f"prev[j] + {step(dele, 'i - 1', 'j')}"
    most = f"greatest({x}, {y}, {z})"
    total = f"{most} + ln(exp({x} - {most}) + exp({y} - {most}) + exp({z} - {most}))"
    row0 = f"list_reduce(range(2, length(s2) + 1), lambda acc, j: list_append(acc, acc[-1] + {step(ins, '1', 'j - 1')}), [0.0::DOUBLE])"
    row = f"list_reduce(range(2, length(s2) + 1), lambda acc, j: list_append(acc, {total}), [(prev[1] + {step(dele, 'i - 1', '1')})::DOUBLE])".replace("prev[", "m[-1][")
    return f"list_reduce(range(2, length(s1) + 1), lambda m, i: list_append(m, {row}), [{row0}])"


def grid(name: str, n: int, matrix, source: str, turned: bool = False) -> str:
    """CTEs that end in name(pair_id, s, i, j, w): the rows of matrix(c) for each class c; turned: of strings turned round."""
    parts = " UNION ALL ".join(f"SELECT pair_id, {c} AS s, {matrix(c)} AS m, length(s1) AS n1, length(s2) AS n2 FROM {source}" for c in range(n))
    i, j = ("n1 - 1 - i", "n2 - 1 - j") if turned else ("i", "j")
    return f"""{name}_a AS ({parts}),
{name}_r AS (SELECT pair_id, s, unnest(m) AS row, (generate_subscripts(m, 1) - 1)::INT AS i, n1, n2 FROM {name}_a),
{name}_c AS (SELECT pair_id, s, i, unnest(row) AS w, (generate_subscripts(row, 1) - 1)::INT AS j, n1, n2 FROM {name}_r),
{name} AS (SELECT pair_id, s, ({i})::INT AS i, ({j})::INT AS j, w FROM {name}_c)"""


def edge_posteriors(source: str, n: int, at) -> str:
    """pair_id, i0, j0, s0, i1, j1, s1, e, p of every edge: the probability that an alignment of its class passes it."""
    here = lambda r: at(r, "b.i + 1", "b.j + 1")
    parts = []
    for m, (di, dj) in enumerate(((1, 1), (0, 1), (1, 0))):
        for c in range(n):
            e = c + n + n * m
            p = rounded(f"exp(a.w + {here(e)} + {here(c)} + b.w - z.w)")
            parts.append(f"SELECT b.pair_id, a.i AS i0, a.j AS j0, {c} AS s0, b.i AS i1, b.j AS j1, {c} AS s1, {e} AS e, {p} AS p FROM b JOIN a ON a.pair_id = b.pair_id AND a.s = b.s AND a.i = b.i - {di} AND a.j = b.j - {dj} JOIN z ON z.pair_id = b.pair_id AND z.s = b.s JOIN p ON p.pair_id = b.pair_id WHERE b.s = {c}")
    return f"""WITH p AS ({source}), pr AS (SELECT pair_id, reverse(s1) AS s1, reverse(s2) AS s2 FROM p),
{grid("a", n, lambda c: _alpha(n, c, at), "p")}, {grid("b", n, lambda c: beta(n, c, at), "pr", True)},
z AS (SELECT a.pair_id, s, w FROM a JOIN p USING (pair_id) WHERE i = length(s1) - 1 AND j = length(s2) - 1)
{" UNION ALL ".join(parts)}"""


def gradient(source: str, n: int, at, features: list[tuple[str, str]], scale: str = "1") -> str:
    """row, k, value: the log-likelihood's gradient by the pairs' posteriors; source has labels '0', '1', ...; features: (k, value) of cell (i, j), 0-based."""
    states = f"""WITH p AS ({source}), pr AS (SELECT pair_id, reverse(s1) AS s1, reverse(s2) AS s2 FROM p),
{grid("a", n, lambda c: _alpha(n, c, at), "p")}, {grid("b", n, lambda c: beta(n, c, at), "pr", True)},
z AS (SELECT a.pair_id, s, w FROM a JOIN p USING (pair_id) WHERE i = length(s1) - 1 AND j = length(s2) - 1),
k AS (SELECT z.pair_id, s, w AS z, (label = s::VARCHAR)::INT - exp(w) / sum(exp(w)) OVER (PARTITION BY z.pair_id) AS times FROM z JOIN p USING (pair_id)),"""
    here = lambda r: at(r, "b.i + 1", "b.j + 1")
    parts = ["SELECT a.pair_id, a.s AS row, a.i, a.j, times * exp(a.w + b.w - z) AS post FROM a JOIN b USING (pair_id, s, i, j) JOIN k USING (pair_id, s)"]
    for m, (di, dj) in enumerate(((1, 1), (0, 1), (1, 0))):
        for c in range(n):
            e = c + n + n * m
            parts.append(f"SELECT b.pair_id, {e}, b.i, b.j, times * exp(a.w + {here(e)} + {here(c)} + b.w - z) FROM b JOIN a ON a.pair_id = b.pair_id AND a.s = b.s AND a.i = b.i - {di} AND a.j = b.j - {dj} JOIN k ON k.pair_id = b.pair_id AND k.s = b.s JOIN p ON p.pair_id = b.pair_id WHERE b.s = {c}")
    post = f"post AS ({' UNION ALL '.join(parts)})"
    values = " UNION ALL ".join(f"SELECT row, {k} AS k, post * {v} AS value FROM post JOIN p USING (pair_id)" for k, v in features)
    return f"{states} {post}, v AS ({values}) SELECT row::INT AS row, k::INT AS k, round(sum(value) * {scale}, 4) + 0.0 AS value FROM v GROUP BY row, k HAVING round(sum(value) * {scale}, 4) <> 0"


def alpha(theta: np.ndarray, n: int, c: int, best: bool = False, names: tuple[str, ...] = ("bias", "match", "numeric")) -> str:
    """The lattice of class c as a list of rows of log weights."""
    return _alpha(n, c, rows_of(theta, names), best)


def _alpha(n: int, c: int, at, best: bool = False) -> str:
    node, mat, ins, dele = (c + m * n for m in range(4))
    x, y, z = f"prev[j - 1] + {at(mat, 'i', 'j')}", f"acc[-1] + {at(ins, 'i', 'j')}", f"prev[j] + {at(dele, 'i', 'j')}"
    most = f"greatest({x}, {y}, {z})"
    step = most if best else f"{most} + ln(exp({x} - {most}) + exp({y} - {most}) + exp({z} - {most}))"
    row0 = f"list_reduce(range(2, length(s2) + 1), lambda acc, j: list_append(acc, acc[-1] + {at(ins, '1', 'j')} + {at(node, '1', 'j')}), [({at(node, '1', '1')})::DOUBLE])"
    row = f"list_reduce(range(2, length(s2) + 1), lambda acc, j: list_append(acc, {step} + {at(node, 'i', 'j')}), [(prev[1] + {at(dele, 'i', '1')} + {at(node, 'i', '1')})::DOUBLE])"
    row = row.replace("prev[", "m[-1][")
    return f"list_reduce(range(2, length(s1) + 1), lambda m, i: list_append(m, {row}), [{row0}])"


def class_weights(source: str, theta: np.ndarray | None, n: int, best: bool = False, more: str = "", at=None) -> str:
    zs = ", ".join(f"({_alpha(n, c, at or rows_of(theta), best)})[-1][-1] AS z{c}" for c in range(n))
    return f"WITH p AS ({source}), z AS (SELECT pair_id{more}, {zs} FROM p WHERE length(s1) > 0 AND length(s2) > 0)"


def share(n: int, c: int) -> str:
    return f"1 / ({' + '.join(f'exp(z{d} - z{c})' for d in range(n))})"


def rounded(x: str, places: int = 4) -> str:
    return f"round({x}, {places}) + 0.0"


def probabilities(source: str, theta: np.ndarray | None, n: int, best: bool = False, at=None) -> str:
    """Of pairs without a result too: their probabilities are null."""
    ps = ", ".join(f"{rounded(share(n, c))} AS p{c}" for c in range(n))
    return f"{class_weights(source, theta, n, best, at=at)} SELECT pair_id, {ps} FROM p LEFT JOIN z USING (pair_id)"


def moves(transitions: list[tuple]) -> str:
    """m(t, a, b, di, dj, need): a machine's moves; need: 1 or 0 where a move is made only from a cell that matches, or doesn't."""
    rows = ", ".join(f"({t}, {a}, {b}, {d[0]}, {d[1]}, {need})" for t, a, b, d, need in transitions)
    return f"m(t, a, b, di, dj, need) AS (VALUES {rows})"


def lattice(source: str, starts: tuple, states: int, transitions: list[tuple]) -> str:
    """Edges of the lattices of a machine with moves (t, from, to, (di, dj), need), by recursion from both ends."""
    may = lambda f: f"(need IS NULL OR need = (substr(s1, ({f}.i + 1)::BIGINT, 1) = substr(s2, ({f}.j + 1)::BIGINT, 1))::INT)"
    some = lambda xs: ", ".join(f"({x})" for x in xs)
    return f"""WITH RECURSIVE p AS ({source}), {moves(transitions)}, n AS (SELECT pair_id, s1, s2, length(s1) AS n1, length(s2) AS n2 FROM p WHERE length(s1) > 0 AND length(s2) > 0),
f(pair_id, i, j, s) AS (SELECT pair_id, 0, 0, s FROM n, (VALUES {some(starts)}) v(s) UNION SELECT f.pair_id, i + di, j + dj, b FROM f JOIN m ON a = s JOIN n ON n.pair_id = f.pair_id WHERE i + di < n1 AND j + dj < n2 AND {may('f')}),
g(pair_id, i, j, s) AS (SELECT pair_id, n1 - 1, n2 - 1, s FROM n, (VALUES {some(range(states))}) v(s) UNION SELECT q.pair_id, q.i, q.j, a FROM (SELECT g.pair_id, i - di AS i, j - dj AS j, a, need FROM g JOIN m ON b = s WHERE i >= di AND j >= dj) q JOIN n ON n.pair_id = q.pair_id WHERE {may('q')})
SELECT f.pair_id, f.i::INT AS i0, f.j::INT AS j0, f.s AS s0, g.i::INT AS i1, g.j::INT AS j1, g.s AS s1, t + {states} AS e FROM f JOIN m ON a = f.s JOIN n ON n.pair_id = f.pair_id JOIN g ON g.pair_id = f.pair_id AND g.i = f.i + di AND g.j = f.j + dj AND g.s = b WHERE {may('f')}"""


def values(rows: list[tuple], names: str) -> str:
    show = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) v({names})"
