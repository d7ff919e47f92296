"""The query catalogue: every operator on pairs from the tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignspark.functions import features as feats
from alignspark.functions import hof, sql
from alignspark.operators import lattice, relational, tiles, training
from alignspark.operators.ml import PairClassifier, PairClassifierModel
from alignspark.operators.scoring import Parameters, class_log_weights, feature_rows, node_edge_weights, score, sparse_cells, zeros
from alignspark.plans import oracle
from alignspark.sources import pairs
from alignspark.spec import CHARACTERS, FeatureSpec, Grid, StateMachine, custom_features
from alignspark.streaming.scoring import scored_to

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SPEC = FeatureSpec(match=True, numeric=True)
TWO = StateMachine.default(["0", "1"])

# Parameters fitted to pairs.WORDS with l2 of 10 (rows: states, matches, insertions, deletions of both
# classes; columns: bias, match, numeric).
THETA = np.array([
    [-0.0569188, 0.07413339, 0.0],
    [0.00187709, -0.06377866, 0.0],
    [-0.01908823, 0.00586189, 0.0],
    [0.01721114, -0.00636556, 0.0],
    [0.01578279, 0.0078614, 0.0],
    [-0.0139057, -0.00862948, 0.0],
    [-0.00623241, 0.02937325, 0.0],
    [0.00810951, -0.01774676, 0.0],
])

#: The same with a weight on digits, so that this feature shows in results.
NUMERIC = THETA + np.outer([0.02, -0.03, 0.05, 0.01, -0.02, 0.04, 0.03, -0.01], [0, 0, 1])
MODEL = Parameters(SPEC, TWO, NUMERIC)


def query(name: str, text: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return put


def _rounded(c, places: int = 4):
    return F.round(c, places) + F.lit(0.0)


def _probabilities(scored: DataFrame, n: int = 2) -> DataFrame:
    """Of all pairs; of those without a result they are null."""
    return scored.select("pair_id", *[_rounded(F.col("probability")[c]).alias(f"p{c}") for c in range(n)])


# Features


@query("tokens_long", f"{oracle.cells(oracle.PARTS)} SELECT pair_id, i, j, c1, c2 FROM c")
def tokens_long(spark, sf_dir):
    return feats.cells(pairs.parts(spark, sf_dir)).select("pair_id", "i", "j", "c1", "c2")


def _feature(name: str, source=pairs.parts, text: str = oracle.PARTS) -> None:
    digits = name == "numeric"
    column = {"bias": feats.bias, "start": feats.start, "end": feats.end, "match": feats.match, "numeric": lambda: feats.numeric(True)}[name]
    query(f"feature_{name}", oracle.feature(name, text))(lambda spark, sf_dir: feats.cells(source(spark, sf_dir), digits=digits).select("pair_id", "i", "j", column().alias("value")))


for _name in ("bias", "start", "end", "match"):
    _feature(_name)
_feature("numeric", pairs.customers, oracle.CUSTOMERS)


@query("feature_transition", f"{oracle.cells(oracle.PARTS)} SELECT pair_id, i, j, {oracle.TRANSITION} AS k FROM c")
def feature_transition(spark, sf_dir):
    return feats.cells(pairs.parts(spark, sf_dir)).select("pair_id", "i", "j", feats.transition().cast("long").alias("k"))


FULL = FeatureSpec(bias=2.0, start=True, end=True, match=True, numeric=True, transition=True)
_PLANES = ["2.0::DOUBLE", *(oracle.PLANES[n] for n in ("start", "end", "match", "numeric"))]
_LONG = f"""{oracle.cells(oracle.PARTS)}, f AS ({" UNION ALL ".join(f"SELECT pair_id, i, j, {k} AS k, {p} AS value FROM c" for k, p in enumerate(_PLANES))}
  UNION ALL SELECT pair_id, i, j, (5 + {oracle.TRANSITION})::INT, 1.0::DOUBLE FROM c)"""


@query("feature_grid_long", f"{_LONG} SELECT * FROM f WHERE value <> 0")
def feature_grid_long(spark, sf_dir):
    return feats.feature_long(pairs.parts(spark, sf_dir), FULL)


@query("feature_sparse_nnz", f"{_LONG}, g AS (SELECT pair_id, i, j, count(*) AS n FROM f WHERE value <> 0 GROUP BY pair_id, i, j) SELECT pair_id, sum(n)::BIGINT AS nnz, max(n) AS widest FROM g GROUP BY pair_id")
def feature_sparse_nnz(spark, sf_dir):
    """Non-zero features by cell, as sparse vectors; a pair's cells are one row's, so only pairs' sums are shuffled."""
    cells = sparse_cells(pairs.parts(spark, sf_dir), FULL).select("pair_id", F.size("indices").cast("long").alias("n"))
    return cells.groupBy("pair_id").agg(F.sum("n").alias("nnz"), F.max("n").alias("widest"))


@query("feature_token_match", f"""WITH p AS ({oracle.PARTS}), t AS (SELECT pair_id, string_split(s1, ' ') AS a, string_split(s2, ' ') AS b FROM p),
c AS (SELECT pair_id, i, j, a[i + 1] AS c1, b[j + 1] AS c2 FROM (SELECT *, unnest(range(len(a)))::INT AS i FROM t) q, LATERAL (SELECT unnest(range(len(q.b)))::INT AS j))
SELECT pair_id, i, j, (c1 = c2)::INT::DOUBLE AS value FROM c""")
def feature_token_match(spark, sf_dir):
    return feats.cells(pairs.tokens(spark, sf_dir), tokens=True).select("pair_id", "i", "j", feats.match().alias("value"))


@query("feature_custom_real", f"{oracle.cells(oracle.PARTS)} SELECT pair_id, i, j, 0 AS k, 1.0::DOUBLE AS value FROM c WHERE c1 < c2")
def feature_custom_real(spark, sf_dir):
    return feature_rows(pairs.parts(spark, sf_dir), custom_features(real=[lambda a, b: a < b]))


@query("feature_custom_sparse", f"{oracle.cells(oracle.PARTS)} SELECT pair_id, i, j, (i + j) % 5 AS k, 1.0::DOUBLE AS value FROM c")
def feature_custom_sparse(spark, sf_dir):
    return feature_rows(pairs.parts(spark, sf_dir), custom_features(sparse=[(lambda i, j, s1, s2: (i + j) % 5, 5)]))


@query("feature_custom_grid", f"{oracle.cells(oracle.PARTS)} SELECT pair_id, i, j, 0 AS k, 1.0::DOUBLE AS value FROM c WHERE c1 < c2 UNION ALL SELECT pair_id, i, j, 1 + (i + j) % 5 AS k, 1.0::DOUBLE AS value FROM c")
def feature_custom_grid(spark, sf_dir):
    """A caller's features over whole grids: characters that come earlier in the alphabet, and the diagonal modulo 5."""
    spec = custom_features(real=[Grid(lambda a, b: a < b)], sparse=[(Grid(lambda i, j, a, b: (i + j) % 5), 5)])
    return feature_rows(pairs.parts(spark, sf_dir), spec)


# Lattices


@query("lattice_default", f"""{oracle.cells(oracle.PARTS)}, d(m, di, dj) AS (VALUES (0, 1, 1), (1, 0, 1), (2, 1, 0)), s(s0) AS (VALUES (0), (1))
SELECT pair_id, i AS i0, j AS j0, s0, i + di AS i1, j + dj AS j1, s0 AS s1, s0 + 2 + 2 * m AS e FROM c, d, s WHERE i + di < n1 AND j + dj < n2""")
def lattice_default(spark, sf_dir):
    return lattice.lattice_of_default(pairs.parts(spark, sf_dir), 2)


# Two machines with moves over several elements.
JUMP = StateMachine((0, 1), ((0, 0, (1, 1)), (0, 1, (0, 2)), (0, 0, (1, 0))), {0: 0, 1: 1})
CALLS = StateMachine((0, 1), ((0, 0, (1, 1)), (0, 1, (0, 1)), (0, 0, (1, 0)), (0, 3, lambda i, j, x: (0, 2))), {0: 0, 1: 1, 3: 3})

#: Class "0" may skip one element of s1 or s2 at a time, class "1" two of s2; both move on by pairs.
GENERAL = StateMachine((0, 2), ((0, 0, (1, 1)), (0, 1, (1, 0)), (1, 0, (1, 1)), (0, 0, (0, 1)), (2, 2, (1, 1)), (2, 3, (0, 2)), (3, 2, (1, 1))), {0: "0", 1: "0", 2: "1", 3: "1"})
#: From a cell that matches, the second move skips two elements of s2, else one of each.
LOOKS = StateMachine((0, 1), ((0, 0, (1, 0)), (0, 1, lambda i, j, x: (0, 2) if x[i, j, 1] else (1, 1)), (1, 0, (1, 1)), (0, 0, (0, 1))), {0: "0", 1: "1"})


def _rows(machine: StateMachine) -> list[tuple]:
    return [(t, a, b, d, "NULL") for t, (a, b, d) in enumerate(machine.transitions)]


@query("lattice_jumps", oracle.lattice(oracle.PARTS, (0, 1), 2, _rows(JUMP)))
def lattice_jumps(spark, sf_dir):
    return lattice.lattice(pairs.parts(spark, sf_dir), JUMP)


@query("lattice_callable", oracle.lattice(oracle.PARTS, (0, 1), 2, [(0, 0, 0, (1, 0), "NULL"), (1, 0, 1, (0, 2), 1), (1, 0, 1, (1, 1), 0), (2, 1, 0, (1, 1), "NULL"), (3, 0, 0, (0, 1), "NULL")]))
def lattice_callable(spark, sf_dir):
    """A move that looks at its cell's features."""
    return lattice.lattice(pairs.parts(spark, sf_dir), LOOKS, SPEC)


#: The same, over whole grids.
LOOKS_GRID = StateMachine((0, 1), ((0, 0, (1, 0)), (0, 1, Grid(lambda i, j, x: (1 - x[..., 1].astype(int), 1 + x[..., 1].astype(int)))), (1, 0, (1, 1)), (0, 0, (0, 1))), {0: "0", 1: "1"})


@query("lattice_grid_callable", SQL["lattice_callable"])
def lattice_grid_callable(spark, sf_dir):
    """A move by a function that sees a batch's cells at once."""
    return lattice.lattice(pairs.parts(spark, sf_dir), LOOKS_GRID, SPEC)


@query("lattice_general", oracle.lattice(oracle.PARTS, (0, 2), 4, _rows(GENERAL)))
def lattice_general(spark, sf_dir):
    return lattice.lattice(pairs.parts(spark, sf_dir), GENERAL)


@query("lattice_frontier", oracle.lattice(oracle.PARTS, (0, 2), 4, _rows(GENERAL)))
def lattice_frontier(spark, sf_dir):
    """The same edges by joins of a frontier until nothing is new, once for each pair of lengths."""
    return relational.lattice(pairs.parts(spark, sf_dir), GENERAL, relational.shared(spark, "lattice"))


# Potentials and lattice weights

_SELECT = lambda rows: " UNION ALL ".join(f"SELECT {r} AS row, {k} AS k, {float(v)!r} AS v" for (r, k), v in np.ndenumerate(rows))


@query("potentials_dense", f"""{oracle.cells(oracle.PARTS)}, f AS (SELECT *, [1.0, {oracle.PLANES["match"]}, {oracle.PLANES["numeric"]}] AS x FROM c), t AS ({_SELECT(NUMERIC)})
SELECT pair_id, i, j, row, round(sum(v * x[k + 1]), 4) + 0.0 AS w FROM f, t GROUP BY pair_id, i, j, row""")
def potentials_dense(spark, sf_dir):
    values = feats.planes(SPEC, True)
    rows = [F.struct(F.lit(r).alias("row"), sum((F.lit(float(NUMERIC[r, k])) * values[k] for k in range(1, 3)), F.lit(float(NUMERIC[r, 0]))).alias("w")) for r in range(len(NUMERIC))]
    return feats.cells(pairs.parts(spark, sf_dir), digits=True).select("pair_id", "i", "j", F.explode(F.array(*rows)).alias("r")).select("pair_id", "i", "j", "r.row", _rounded(F.col("r.w")).alias("w"))


@query("potentials_sparse", f"""{oracle.cells(oracle.PARTS)} SELECT pair_id, i, j, round(0.5 + (({oracle.TRANSITION}) % 7) / 10.0, 4) + 0.0 AS w FROM c""")
def potentials_sparse(spark, sf_dir):
    """One row of parameters over bias and transitions (0.5, and the index modulo 7 tenths), as a join with theta's table."""
    theta = (np.arange(len(CHARACTERS) ** 2) % 7) / 10.0
    table = spark.createDataFrame([(k, float(v)) for k, v in enumerate(theta)], "k int, v double")
    cells = feats.cells(pairs.parts(spark, sf_dir)).select("pair_id", "i", "j", feats.transition().cast("int").alias("k"))
    return cells.join(F.broadcast(table), "k", "left").select("pair_id", "i", "j", _rounded(0.5 + F.coalesce("v", F.lit(0.0))).alias("w"))


_NODES = f"WITH p AS ({oracle.PARTS}), {oracle.grid('n', 2, lambda c: oracle.alpha(NUMERIC, 2, c), 'p')}"
#: Turned round, a pair's ways are walked from their end.
_BACK = f"WITH p AS ({oracle.PARTS}), pr AS (SELECT pair_id, reverse(s1) AS s1, reverse(s2) AS s2 FROM p), {oracle.grid('n', 2, lambda c: oracle.beta(2, c, oracle.rows_of(NUMERIC)), 'pr', True)}"


@query("forward_nodes", f"{_NODES} SELECT pair_id, i, j, s, {oracle.rounded('w')} AS w FROM n")
def forward_nodes(spark, sf_dir):
    return node_edge_weights(pairs.parts(spark, sf_dir), MODEL, "forward")[0].withColumn("w", _rounded("w"))


def _edge_sql(nodes: str, ahead: bool) -> str:
    """Rows of all edges between n's nodes: ahead, a node's weight and the edge's; back, that of the edge's end and its node's own."""
    parts = []
    for m, (di, dj) in enumerate(((1, 1), (0, 1), (1, 0))):
        for c in range(2):
            e = c + 2 + 2 * m
            begin, end = (("i", "j"), (f"i + {di}", f"j + {dj}")) if ahead else ((f"i - {di}", f"j - {dj}"), ("i", "j"))
            w = f"w + {oracle.weight(NUMERIC[e if ahead else c], f'{end[0]} + 1', f'{end[1]} + 1')}"
            inside = f"i + {di} < length(s1) AND j + {dj} < length(s2)" if ahead else f"i >= {di} AND j >= {dj}"
            parts.append(f"SELECT pair_id, {begin[0]} AS i0, {begin[1]} AS j0, {c} AS s0, {end[0]} AS i1, {end[1]} AS j1, {c} AS s1, {e} AS e, {oracle.rounded(w)} AS w FROM n JOIN p USING (pair_id) WHERE s = {c} AND {inside}")
    return f"{nodes} {' UNION ALL '.join(parts)}"


@query("edge_posteriors", oracle.edge_posteriors(oracle.PARTS, 2, oracle.rows_of(NUMERIC)))
def edge_posteriors(spark, sf_dir):
    """How likely an alignment of its class passes each edge."""
    rows = relational.posteriors(pairs.parts(spark, sf_dir), MODEL).where("i0 IS NOT NULL")
    return rows.select("pair_id", "i0", "j0", "s0", F.col("i").alias("i1"), F.col("j").alias("j1"), F.col("s").alias("s1"), F.col("row").alias("e"), _rounded("p").alias("p"))


@query("forward_edges", _edge_sql(_NODES, True))
def forward_edges(spark, sf_dir):
    return node_edge_weights(pairs.parts(spark, sf_dir), MODEL, "forward")[1].withColumn("w", _rounded("w"))


@query("backward_nodes", f"{_BACK} SELECT pair_id, i, j, s, {oracle.rounded('w')} AS w FROM n")
def backward_nodes(spark, sf_dir):
    return node_edge_weights(pairs.parts(spark, sf_dir), MODEL, "backward")[0].withColumn("w", _rounded("w"))


@query("backward_edges", _edge_sql(_BACK, False))
def backward_edges(spark, sf_dir):
    return node_edge_weights(pairs.parts(spark, sf_dir), MODEL, "backward")[1].withColumn("w", _rounded("w"))


@query("partition_both_ways", f"{oracle.class_weights(oracle.PARTS, NUMERIC, 2)} " + " UNION ALL ".join(f"SELECT pair_id, {c} AS s, {oracle.rounded(f'z{c}')} AS ahead, {oracle.rounded(f'z{c}')} AS back FROM z" for c in range(2)))
def partition_both_ways(spark, sf_dir):
    """For each class: the weight of all ways at the last cell, and at the first cell going back, with its node's own."""
    source = pairs.parts(spark, sf_dir)
    ahead, back = (node_edge_weights(source, MODEL, d)[0] for d in ("forward", "backward"))
    ends = source.select("pair_id", (F.length("s1") - 1).alias("i"), (F.length("s2") - 1).alias("j"))
    z = ahead.join(ends, ["pair_id", "i", "j"]).select("pair_id", "s", F.col("w").alias("z"))
    first = ahead.where("i = 0 AND j = 0").select("pair_id", "s", F.col("w").alias("own"))
    y = back.where("i = 0 AND j = 0").select("pair_id", "s", "w")
    both = z.join(first, ["pair_id", "s"]).join(y, ["pair_id", "s"])
    return both.select("pair_id", "s", _rounded("z").alias("ahead"), _rounded(F.col("own") + F.col("w")).alias("back"))


_DELANNOY = "list_reduce(range(2, length(s1) + 1), lambda m, i: list_reduce(range(2, length(s2) + 1), lambda acc, j: list_append(acc, m[j - 1] + acc[-1] + m[j]), [1::HUGEINT]), list_transform(range(1, length(s2) + 1), lambda k: 1::HUGEINT))"


@query("logz_zero_theta", f"WITH p AS (SELECT pair_id, s1, s2 FROM ({oracle.PARTS}) UNION ALL SELECT 1000000 + pair_id, s1, s2 FROM ({oracle.CUSTOMERS})) SELECT pair_id, round(ln(({_DELANNOY})[-1]::DOUBLE), 6) + 0.0 AS logz FROM p")
def logz_zero_theta(spark, sf_dir):
    """With parameters of zero a class's weight counts the alignments: Delannoy numbers."""
    source = pairs.parts(spark, sf_dir).unionByName(pairs.customers(spark, sf_dir).withColumn("pair_id", F.col("pair_id") + 1_000_000))
    return class_log_weights(source, Parameters(SPEC, TWO, zeros(SPEC, TWO))).select("pair_id", _rounded(F.col("weights")[0], 6).alias("logz"))


#: Each move but the first costs 1, a move over a match gives it back: the best alignment is an edit distance.
EDITS = Parameters(FeatureSpec(match=True), StateMachine.default(["0"]), np.array([[0.0, 0.0], [-1.0, 1.0], [-1.0, 0.0], [-1.0, 0.0]]))


@query("viterbi_levenshtein", f"SELECT pair_id, 0.0 - levenshtein(substr(s1, 2), substr(s2, 2))::DOUBLE AS w FROM (SELECT pair_id, s1, s2 FROM ({oracle.PARTS}) UNION ALL SELECT 1000000 + pair_id, s1, s2 FROM ({oracle.CUSTOMERS}))")
def viterbi_levenshtein(spark, sf_dir):
    source = pairs.parts(spark, sf_dir).unionByName(pairs.customers(spark, sf_dir).withColumn("pair_id", F.col("pair_id") + 1_000_000))
    return class_log_weights(source, EDITS, best=True).select("pair_id", (F.col("weights")[0] + F.lit(0.0)).alias("w"))


# Scores


@query("class_logz", f"{oracle.class_weights(oracle.PARTS, NUMERIC, 2)} SELECT pair_id, {oracle.rounded('z0')} AS z0, {oracle.rounded('z1')} AS z1 FROM z")
def class_logz(spark, sf_dir):
    return class_log_weights(pairs.parts(spark, sf_dir), MODEL).select("pair_id", _rounded(F.col("weights")[0]).alias("z0"), _rounded(F.col("weights")[1]).alias("z1"))


@query("predict_proba", oracle.probabilities(oracle.PARTS, NUMERIC, 2))
def predict_proba(spark, sf_dir):
    return _probabilities(score(pairs.parts(spark, sf_dir), MODEL))


@query("predict_proba_digits", oracle.probabilities(oracle.CUSTOMERS, NUMERIC, 2))
def predict_proba_digits(spark, sf_dir):
    return _probabilities(score(pairs.customers(spark, sf_dir), MODEL))


@query("predict", f"{oracle.class_weights(oracle.PARTS, NUMERIC, 2)} SELECT pair_id, CASE WHEN z0 >= z1 THEN '0' ELSE '1' END AS prediction FROM z")
def predict(spark, sf_dir):
    return score(pairs.parts(spark, sf_dir), MODEL).select("pair_id", "prediction")


@query("predict_proba_viterbi", oracle.probabilities(oracle.PARTS, NUMERIC, 2, best=True))
def predict_proba_viterbi(spark, sf_dir):
    return _probabilities(score(pairs.parts(spark, sf_dir), MODEL, best=True))


@query("predict_hof", oracle.probabilities(oracle.PARTS, NUMERIC, 2))
def predict_hof(spark, sf_dir):
    """The same without a Python worker."""
    return _probabilities(pairs.parts(spark, sf_dir).withColumn("probability", hof.probabilities(NUMERIC, SPEC, 2)))


THREE_THETA = np.random.default_rng(3).normal(0, 0.1, (12, 3)).round(3)


@query("predict_three_class", oracle.probabilities(oracle.PARTS, THREE_THETA, 3))
def predict_three_class(spark, sf_dir):
    return _probabilities(score(pairs.parts(spark, sf_dir), Parameters(SPEC, StateMachine.default("abc"), THREE_THETA)), 3)


def _diagonals(source: str, theta: np.ndarray, direction: np.ndarray | None = None) -> str:
    """Probabilities of whole texts: a recursion over diagonals that holds two of them; w is the diagonal's, v the one before.

    direction: instead, log p of the label (pair_id modulo 2) and its derivative along this direction of the parameters; h
    and g are the derivatives of w and v.
    """
    by_class = lambda rows, m: " CASE c WHEN 0 THEN {0} ELSE {1} END".format(*(oracle.weight(rows[c + 2 * m], "i + 1", "d - i + 1") for c in range(2)))
    first = lambda text: text.replace("(d - i + 1)", "(1)").replace("(i + 1)", "(1)")
    node, mat, ins, dele = (by_class(theta, m) for m in range(4))
    vary = np.zeros_like(theta) if direction is None else direction
    dnode, dmat, dins, ddele = (by_class(vary, m) for m in range(4))
    none = "'-infinity'::DOUBLE"
    ends = f"""z AS (SELECT pair_id, max(w) FILTER (c = 0) AS z0, max(w) FILTER (c = 1) AS z1, max(h) FILTER (c = 0) AS h0, max(h) FILTER (c = 1) AS h1 FROM f JOIN q USING (pair_id) WHERE i = n1 - 1 AND d = n1 + n2 - 2 GROUP BY pair_id)"""
    p0, p1 = oracle.share(2, 0), oracle.share(2, 1)
    if direction is None:
        out = f"SELECT pair_id, {oracle.rounded(p0)} AS p0, {oracle.rounded(p1)} AS p1 FROM z"
    else:
        mean = f"({p0} * h0 + {p1} * h1)"
        out = f"SELECT pair_id, {oracle.rounded(f'ln(CASE pair_id % 2 WHEN 0 THEN {p0} ELSE {p1} END)')} AS ll, {oracle.rounded(f'CASE pair_id % 2 WHEN 0 THEN h0 ELSE h1 END - {mean}', 3)} AS slope FROM z"
    return f"""WITH RECURSIVE p AS ({source}), q AS (SELECT pair_id, s1, s2, length(s1) AS n1, length(s2) AS n2 FROM p),
f(pair_id, c, i, d, v, w, g, h) USING KEY (pair_id, c, i) AS (
  SELECT pair_id, c, i, 0, {none}, CASE WHEN i = 0 THEN ({first(node)}) ELSE {none} END, 0.0::DOUBLE, CASE WHEN i = 0 THEN ({first(dnode)}) ELSE 0.0::DOUBLE END
  FROM (SELECT *, unnest(range(n1))::INT AS i FROM q) t, (VALUES (0), (1)) k(c)
  UNION
  SELECT pair_id, c, i, d, w, CASE WHEN d - i < 0 OR d - i >= n2 THEN {none} ELSE {node} + most + ln(total) END, h,
    CASE WHEN d - i < 0 OR d - i >= n2 THEN 0.0::DOUBLE ELSE {dnode} + (exp(x - most) * (dx + {dmat}) + exp(y - most) * (dy + {dins}) + exp(z - most) * (dz + {ddele})) / total END
  FROM (SELECT *, exp(x - most) + exp(y - most) + exp(z - most) AS total FROM (SELECT *, greatest(x, y, z, -1e300) AS most FROM (
    SELECT pair_id, c, i, d, w, h, s1, s2, n1, n2, coalesce(x, '-infinity') + {mat} AS x, y + {ins} AS y, coalesce(z, '-infinity') + {dele} AS z, coalesce(dx, 0.0) AS dx, dy, coalesce(dz, 0.0) AS dz FROM (
      SELECT f.pair_id, c, i, d + 1 AS d, w, h, s1, s2, n1, n2, lag(v) OVER up AS x, w AS y, lag(w) OVER up AS z, lag(g) OVER up AS dx, h AS dy, lag(h) OVER up AS dz FROM f JOIN q USING (pair_id) WHERE d < n1 + n2 - 2
      WINDOW up AS (PARTITION BY f.pair_id, c ORDER BY i)) t) t) t) t),
{ends}
{out}"""


_LONG_TEXTS = "SELECT a.item_id AS pair_id, a.text AS s1, b.text AS s2 FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1"


@query("predict_long_strings", _diagonals(_LONG_TEXTS, NUMERIC))
def predict_long_strings(spark, sf_dir):
    """Whole texts."""
    return _probabilities(score(pairs.long_texts(spark, sf_dir), MODEL))


@query("predict_tiled", SQL["predict_long_strings"])
def predict_tiled(spark, sf_dir):
    """Whole texts, each cut into tiles that several tasks work on wave by wave."""
    z = F.col("weights")
    total = F.exp(z[0] - F.greatest(z[0], z[1])) + F.exp(z[1] - F.greatest(z[0], z[1]))
    rows = tiles.class_log_weights(pairs.long_texts(spark, sf_dir), MODEL, 128)
    return rows.select("pair_id", *[_rounded(F.exp(z[c] - F.greatest(z[0], z[1])) / total).alias(f"p{c}") for c in range(2)])


GENERAL_THETA = np.random.default_rng(4).normal(0, 0.1, (GENERAL.n_states + GENERAL.n_transitions, 3)).round(3)
_GENERAL = lambda r, i, j: "CASE " + r + " " + " ".join(f"WHEN {n} THEN {oracle.weight(GENERAL_THETA[n], i, j)}" for n in range(len(GENERAL_THETA))) + " END"


_GENERAL_WALK = f"""WITH RECURSIVE p AS ({oracle.PARTS}), {oracle.moves(_rows(GENERAL))},
f(pair_id, i, j, s, w) AS (SELECT pair_id, 0, 0, s, exp({_GENERAL('s', '1', '1')}) FROM p, (VALUES (0), (2)) v(s)
  UNION ALL SELECT f.pair_id, i + di, j + dj, b, sum(w * exp({_GENERAL('t + 4', 'i + di + 1', 'j + dj + 1')} + {_GENERAL('b', 'i + di + 1', 'j + dj + 1')})) FROM f JOIN m ON a = s JOIN p ON p.pair_id = f.pair_id WHERE i + di < length(s1) AND j + dj < length(s2) GROUP BY f.pair_id, i + di, j + dj, b),"""


@query("predict_general_machine", f"""{_GENERAL_WALK}
z AS (SELECT f.pair_id, sum(w) FILTER (s < 2) AS w0, sum(w) FILTER (s >= 2) AS w1 FROM f JOIN p ON p.pair_id = f.pair_id WHERE i = length(s1) - 1 AND j = length(s2) - 1 GROUP BY f.pair_id),
y AS (SELECT pair_id, coalesce(w0, 0) AS w0, coalesce(w1, 0) AS w1 FROM z)
SELECT p.pair_id, round(w0 / (w0 + w1), 4) + 0.0 AS p0, round(w1 / (w0 + w1), 4) + 0.0 AS p1 FROM p LEFT JOIN y USING (pair_id)""")
def predict_general_machine(spark, sf_dir):
    return _probabilities(score(pairs.parts(spark, sf_dir), Parameters(SPEC, GENERAL, GENERAL_THETA)))


def _by_row(theta: np.ndarray, r: str, i: str, j: str) -> str:
    return "CASE " + r + " " + " ".join(f"WHEN {n} THEN {oracle.weight(row, i, j)}" for n, row in enumerate(theta)) + " END"


class Banded:
    """Lattices of the default moves that stay near the diagonal; no transitions to read, only built lattices."""

    n_states, n_transitions, states_to_classes, width = 2, 6, {0: "0", 1: "1"}, 2

    def build_lattice(self, x: np.ndarray) -> np.ndarray:
        return self.of_size(*x.shape[:2])

    @classmethod
    @lru_cache(256)
    def of_size(cls, n1: int, n2: int) -> np.ndarray:
        """The same for all pairs of these lengths."""
        i, j = np.meshgrid(np.arange(n1), np.arange(n2), indexing="ij")
        out = []
        for m, (di, dj) in enumerate(((1, 1), (0, 1), (1, 0))):
            good = (i + di < n1) & (j + dj < n2) & (np.abs(i - j) <= cls.width) & (np.abs(i + di - j - dj) <= cls.width)
            for s in range(2):
                u, v = i[good], j[good]
                out.append(np.stack([u, v, np.full_like(u, s), u + di, v + dj, np.full_like(u, s), np.full_like(u, 2 + 2 * m + s)], 1))
        return np.concatenate(out)


_BANDED = f"""WITH RECURSIVE p AS ({oracle.CUSTOMERS}), {oracle.moves([(2 * m + c, c, c, d, "NULL") for m, d in enumerate(((1, 1), (0, 1), (1, 0))) for c in range(2)])},
f(pair_id, i, j, s, w) AS (SELECT pair_id, 0, 0, s, exp(CASE s WHEN 0 THEN {oracle.weight(NUMERIC[0], '1', '1')} ELSE {oracle.weight(NUMERIC[1], '1', '1')} END) FROM p, (VALUES (0), (1)) v(s)
  UNION ALL SELECT f.pair_id, i + di, j + dj, b, sum(w * exp({_by_row(NUMERIC, 't + 2', 'i + di + 1', 'j + dj + 1')} + {_by_row(NUMERIC, 'b', 'i + di + 1', 'j + dj + 1')})) FROM f JOIN m ON a = s JOIN p ON p.pair_id = f.pair_id WHERE i + di < length(s1) AND j + dj < length(s2) AND abs(i + di - j - dj) <= 2 GROUP BY f.pair_id, i + di, j + dj, b),
z AS (SELECT f.pair_id, sum(w) FILTER (s = 0) AS w0, sum(w) FILTER (s = 1) AS w1 FROM f JOIN p ON p.pair_id = f.pair_id WHERE i = length(s1) - 1 AND j = length(s2) - 1 GROUP BY f.pair_id)
SELECT pair_id, round(w0 / (w0 + w1), 4) + 0.0 AS p0, round(w1 / (w0 + w1), 4) + 0.0 AS p1 FROM z"""


@query("predict_own_lattice", _BANDED)
def predict_own_lattice(spark, sf_dir):
    """An own machine object that only builds lattices."""
    return _probabilities(score(pairs.customers(spark, sf_dir), Parameters(SPEC, StateMachine.of(Banded()), NUMERIC)))


def _by_transition(spec: FeatureSpec, rows: int) -> np.ndarray:
    """Parameters of bias and transition features by oracle.by_transition's rule."""
    theta = np.empty((rows, spec.size))
    theta[:, 0] = 0.3
    theta[:, 1:] = ((np.arange(spec.size - 1) * (np.arange(rows)[:, None] + 1)) % 7 - 3) / 20.0
    return theta


TRANSITIONS = FeatureSpec(transition=True)
TRANSITION_MODEL = Parameters(TRANSITIONS, TWO, _by_transition(TRANSITIONS, 8))


@query("predict_transition", oracle.probabilities(oracle.PARTS, None, 2, at=oracle.by_transition))
def predict_transition(spark, sf_dir):
    """Probabilities by the pairs of characters that alignments meet."""
    return _probabilities(score(pairs.parts(spark, sf_dir), TRANSITION_MODEL))


@query("sql_udf_score", oracle.probabilities(oracle.PARTS, NUMERIC, 2))
def sql_udf_score(spark, sf_dir):
    sql.register(spark, MODEL, "pair_proba")
    return _probabilities(pairs.parts(spark, sf_dir).withColumn("probability", F.expr("pair_proba(s1, s2)")))


@query("predict_edge_cases", oracle.probabilities(oracle.ODD, NUMERIC, 2))
def predict_edge_cases(spark, sf_dir):
    """Empty, null, single, upper-case, long and odd sequences."""
    return _probabilities(score(pairs.edges(spark, sf_dir), MODEL))


@query("sql_pair_features", f"{_LONG} SELECT * FROM f WHERE value <> 0")
def sql_pair_features(spark, sf_dir):
    """Features in SQL text: a vectorised function's arrays as a lateral view."""
    sql.register(spark, Parameters(FULL, TWO, zeros(FULL, TWO)), "full_proba", prefix="full")
    pairs.parts(spark, sf_dir).createOrReplaceTempView("part_pairs")
    return spark.sql("SELECT pair_id, f.* FROM part_pairs LATERAL VIEW inline(full_feature_rows(s1, s2)) f AS i, j, k, value")


@query("sql_pair_lattice", SQL["lattice_default"])
def sql_pair_lattice(spark, sf_dir):
    sql.register(spark, MODEL, "pair_proba")
    pairs.parts(spark, sf_dir).createOrReplaceTempView("part_pairs")
    return spark.sql("SELECT pair_id, f.* FROM part_pairs LATERAL VIEW inline(pair_lattice_rows(s1, s2)) f AS i0, j0, s0, i1, j1, s1, e")


_NEAR = "SELECT a.s_suppkey * 1000000 + b.s_suppkey AS pair_id, a.s_name AS s1, b.s_name AS s2 FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND levenshtein(a.s_name, b.s_name) <= 1"


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("s"))
    return pairs.near(rows, 1).select((F.col("id") * 1_000_000 + F.col("id2")).alias("pair_id"), "s1", "s2")


@query("candidate_pairs", _NEAR)
def candidate_pairs(spark, sf_dir):
    """Names one edit apart, met by their rarest grams."""
    return _near(spark, sf_dir)


@query("score_candidates", oracle.probabilities(_NEAR, NUMERIC, 2))
def score_candidates(spark, sf_dir):
    return _probabilities(score(_near(spark, sf_dir), MODEL))


@query("stream_score", oracle.probabilities(oracle.PARTS, NUMERIC, 2))
def stream_score(spark, sf_dir):
    """A stream of files into a sink: one run, then more files and another run from the checkpoint of the first."""
    at, source = relational.shared(spark, "stream"), pairs.parts(spark, sf_dir)
    for turn in range(2):
        source.where(F.col("pair_id") % 2 == turn).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(source.schema).parquet(f"{at}/in")
        scored_to(stream, MODEL, f"{at}/out", f"{at}/checkpoint").start().awaitTermination()
    return _probabilities(spark.read.parquet(f"{at}/out"))


# Training

_TRUTH = f"{oracle.class_weights(oracle.TYPOS, NUMERIC, 2, more=', label')} "
TYPO_MODEL = Parameters(SPEC, StateMachine.default(["match", "non-match"]), NUMERIC)


@query("log_likelihood", _TRUTH + f"SELECT round(sum(ln(CASE label WHEN 'match' THEN {oracle.share(2, 0)} ELSE {oracle.share(2, 1)} END)), 3) + 0.0 AS ll FROM z")
def log_likelihood(spark, sf_dir):
    """As relational plan: the label's probability of each scored pair, summed in partial sums."""
    scored = score(pairs.typos(spark, sf_dir), TYPO_MODEL, keep=["label"])
    return scored.agg(_rounded(F.sum(F.log(F.when(F.col("label") == "match", F.col("probability")[0]).otherwise(F.col("probability")[1]))), 3).alias("ll"))


_FREE = float((NUMERIC.ravel()[1:] ** 2).sum())


@query("l2_objective", _TRUTH + f"SELECT round(sum(ln(CASE label WHEN 'match' THEN {oracle.share(2, 0)} ELSE {oracle.share(2, 1)} END)) - 10 * {_FREE!r}, 3) + 0.0 AS objective FROM z")
def l2_objective(spark, sf_dir):
    value, gradient = training.log_likelihood(pairs.typos(spark, sf_dir), TYPO_MODEL)
    value, _ = training.penalised(value, gradient, NUMERIC, 10.0)
    return spark.createDataFrame([(round(value, 3) + 0.0,)], "objective double")


_TYPOS01 = f"SELECT pair_id, s1, s2, CASE label WHEN 'match' THEN '0' ELSE '1' END AS label FROM ({oracle.TYPOS})"
_CELL = [("0", "1.0"), ("1", "(substr(s1, i + 1, 1) = substr(s2, j + 1, 1))::INT"), ("2", "(regexp_matches(substr(s1, i + 1, 1), '^[0-9]$') AND regexp_matches(substr(s2, j + 1, 1), '^[0-9]$'))::INT")]


def _gradient_rows(spark: SparkSession, sf_dir: str, spec: FeatureSpec, theta: np.ndarray) -> DataFrame:
    _, gradient = training.log_likelihood(pairs.typos(spark, sf_dir), Parameters(spec, TYPO_MODEL.machine, theta))
    return relational.rounded(relational.as_rows(spark, gradient))


@query("gradient_check", oracle.gradient(_TYPOS01, 2, oracle.rows_of(NUMERIC), _CELL))
def gradient_check(spark, sf_dir):
    """The gradient of the labelled names' likelihood; the SQL has it from posteriors of its own."""
    return _gradient_rows(spark, sf_dir, SPEC, NUMERIC)


@query("gradient_relational", SQL["gradient_check"])
def gradient_relational(spark, sf_dir):
    """The same from the posteriors of whole lattices, as one aggregate."""
    return relational.rounded(relational.gradient(pairs.typos(spark, sf_dir), TYPO_MODEL))


@query("gradient_sparse", oracle.gradient(_TYPOS01, 2, oracle.by_transition, [("0", "1.0"), (f"1 + {oracle.transition('i + 1', 'j + 1')}", "1.0")]))
def gradient_sparse(spark, sf_dir):
    """The same with transition features, whose parameters are a row for each pair of characters."""
    return _gradient_rows(spark, sf_dir, TRANSITIONS, TRANSITION_MODEL.theta)


#: A direction of the parameters, for derivatives along it.
DIRECTION = np.random.default_rng(5).normal(0, 1, NUMERIC.shape).round(2)
_LONG_LABELLED = f"SELECT pair_id, s1, s2, (pair_id % 2)::VARCHAR AS label FROM ({_LONG_TEXTS})"


@query("gradient_long_texts", _diagonals(_LONG_TEXTS, NUMERIC, DIRECTION))
def gradient_long_texts(spark, sf_dir):
    """Whole texts: log p(label) and its derivative along a direction, from gradients that hold a root of their diagonals."""
    source = pairs.long_texts(spark, sf_dir).withColumn("label", (F.col("pair_id") % 2).cast("string"))
    return training.pair_slopes(source, MODEL, DIRECTION).select("pair_id", _rounded("ll").alias("ll"), _rounded("slope", 3).alias("slope"))


#: A machine whose first states lead to both classes.
MIXED = StateMachine((0,), ((0, 0, (1, 1)), (0, 1, (1, 0)), (0, 2, (0, 1)), (1, 1, (1, 1)), (2, 2, (1, 1)), (1, 0, (0, 1)), (2, 2, (1, 0)), (2, 0, (0, 1)), (0, 0, (1, 0))), {0: "0", 1: "0", 2: "1"})
MIXED_THETA = np.random.default_rng(6).normal(0, 0.1, (MIXED.n_states + MIXED.n_transitions, 3)).round(3)
MIXED_DIRECTION = np.random.default_rng(7).normal(0, 1, MIXED_THETA.shape).round(2)


def _mixed_sql() -> str:
    """Weights of ways and their derivatives, move by move: w times x, (g + w v) times x."""
    to = ("i + di + 1", "j + dj + 1")
    x = f"exp({_by_row(MIXED_THETA, 't + 3', *to)} + {_by_row(MIXED_THETA, 'b', *to)})"
    v = f"({_by_row(MIXED_DIRECTION, 't + 3', *to)} + {_by_row(MIXED_DIRECTION, 'b', *to)})"
    first, slope = oracle.weight(MIXED_THETA[0], "1", "1"), oracle.weight(MIXED_DIRECTION[0], "1", "1")
    return f"""WITH RECURSIVE p AS ({oracle.PARTS}), {oracle.moves(_rows(MIXED))},
f(pair_id, i, j, s, w, g) AS (SELECT pair_id, 0, 0, 0, exp({first}), exp({first}) * {slope} FROM p
  UNION ALL SELECT pair_id, i, j, b, sum(w * x), sum((g + w * v) * x) FROM (
    SELECT f.pair_id, i + di AS i, j + dj AS j, b, w, g, {x} AS x, {v} AS v FROM f JOIN m ON a = s JOIN p ON p.pair_id = f.pair_id WHERE i + di < length(s1) AND j + dj < length(s2)) q GROUP BY pair_id, i, j, b),
z AS (SELECT f.pair_id, sum(w) AS w, sum(g) AS g, sum(w) FILTER ((s = 2)::INT = f.pair_id % 2) AS wl, sum(g) FILTER ((s = 2)::INT = f.pair_id % 2) AS gl FROM f JOIN p ON p.pair_id = f.pair_id WHERE i = length(s1) - 1 AND j = length(s2) - 1 GROUP BY f.pair_id)
SELECT pair_id, {oracle.rounded('ln(wl / w)')} AS ll, {oracle.rounded('gl / wl - g / w', 3)} AS slope FROM z"""


@query("gradient_mixed_classes", _mixed_sql())
def gradient_mixed_classes(spark, sf_dir):
    """States that lead to several classes: one pass backward with an axis of classes."""
    source = pairs.parts(spark, sf_dir).withColumn("label", (F.col("pair_id") % 2).cast("string"))
    return training.pair_slopes(source, Parameters(SPEC, MIXED, MIXED_THETA), MIXED_DIRECTION).select("pair_id", _rounded("ll").alias("ll"), _rounded("slope", 3).alias("slope"))


_GOOD = f"SELECT label, true AS good, count(*) AS pairs FROM ({oracle.TYPOS}) GROUP BY label"


def _equal(source: DataFrame) -> DataFrame:
    """pair_id (the least), s1, s2, label, times of source: equal pairs once, with how often they occur, dealt to tasks."""
    rows = source.groupBy("s1", "s2", "label").agg(F.min("pair_id").alias("pair_id"), F.count(F.lit(1)).alias("times"))
    return pairs.dealt(rows, rows.count())


def _scored(source: DataFrame, estimator: PairClassifier) -> DataFrame:
    """Equal pairs of source once, predicted by what was fitted to all of it; the scoring grows with different pairs only."""
    return estimator.fit(source).transform(_equal(source))


def _good(least: float):
    """Columns of groups of scored pairs: whether at least a share of them is predicted right, and their number."""
    right = (F.col("prediction") == F.col("label")).cast("double")
    share = F.sum(right * F.col("times")) / F.sum(F.when(right.isNotNull(), F.col("times")))
    return (share >= least).alias("good"), F.coalesce(F.sum("times"), F.lit(0).cast("long")).alias("pairs")


def _learned(source: DataFrame, estimator: PairClassifier, least: float) -> DataFrame:
    """Of each label: whether at least a share of its pairs is predicted right, and its pairs."""
    return _scored(source, estimator).groupBy("label").agg(*_good(least))


@query("train_golden", _GOOD)
def train_golden(spark, sf_dir):
    """Fitted with a penalty of 10."""
    return _learned(pairs.labelled(spark, sf_dir), PairClassifier(spec=SPEC, l2=10.0, iterations=15), 0.9)


@query("train_golden_best", _GOOD)
def train_golden_best(spark, sf_dir):
    """Fitted by all alignments, scored by the best: less exact (0.80 of the other names at a scale of 0.01, by all 0.99)."""
    return _learned(pairs.labelled(spark, sf_dir), PairClassifier(spec=SPEC, l2=10.0, iterations=15, viterbi=True), 0.75)


@query("train_golden_free", _GOOD)
def train_golden_free(spark, sf_dir):
    """Fitted without a penalty."""
    return _learned(pairs.labelled(spark, sf_dir), PairClassifier(spec=SPEC, iterations=15), 0.9)


_PHRASES = f"SELECT CASE WHEN split_part(s1, ' ', 1) = split_part(s2, ' ', 1) OR split_part(s1, ' ', 2) = split_part(s2, ' ', 2) THEN 'same' ELSE 'other' END AS label, true AS good, count(*) AS pairs FROM ({oracle.PARTS}) GROUP BY 1"


@query("train_phrases", _PHRASES)
def train_phrases(spark, sf_dir):
    """Sequences of words: which pairs have a word in its place."""
    source = pairs.tokens(spark, sf_dir)
    same = (F.get("s1", F.lit(0)) == F.get("s2", F.lit(0))) | (F.get("s1", F.lit(1)) == F.get("s2", F.lit(1)))
    source = source.withColumn("label", F.when(same, "same").otherwise("other"))
    return _learned(source, PairClassifier(spec=SPEC, l2=0.01, iterations=15), 0.9)


@query("pinned_golden", f"SELECT pair_id, a.p0 AS p_all, b.p0 AS p_best FROM ({oracle.probabilities(oracle.PARTS, THETA, 2)}) a JOIN ({oracle.probabilities(oracle.PARTS, THETA, 2, best=True)}) b USING (pair_id)")
def pinned_golden(spark, sf_dir):
    """The fixed parameters' probabilities, by all alignments and by the best one."""
    model, source = Parameters(SPEC, TWO, THETA), pairs.parts(spark, sf_dir)
    every, best = (score(source, model, b).select("pair_id", _rounded(F.col("probability")[0]).alias(name)) for b, name in ((False, "p_all"), (True, "p_best")))
    return every.join(best, "pair_id")


@query("train_typo_accuracy", "SELECT true AS good, count(*) AS pairs FROM (" + oracle.TYPOS + ")")
def train_typo_accuracy(spark, sf_dir):
    """Fit on the labelled part names and predict them: at least nineteen in twenty right."""
    return _scored(pairs.labelled(spark, sf_dir), PairClassifier(spec=SPEC, l2=0.01, iterations=30)).agg(*_good(0.95))


STEP = 1e-3


@query("custom_optimizer", oracle.gradient(_TYPOS01, 2, oracle.rows_of(np.zeros((8, 3))), _CELL, str(STEP)))
def custom_optimizer(spark, sf_dir):
    """A caller's optimiser, one step along the gradient: its parameters are the first gradient's rows times the step."""

    def step(objective, x, size):
        value, gradient = objective(x)
        return x - size * gradient, value

    model, _ = training.fit(pairs.typos(spark, sf_dir), SPEC, l2=1.0, optimizer=step, optimizer_kwargs={"size": STEP})
    return relational.rounded(relational.as_rows(spark, model.theta))


_PROGRESS = f"{_TRUTH} SELECT 0 AS evaluation, round(0 - count(*) * ln(2), 3) + 0.0 AS objective FROM z UNION ALL SELECT 1, ({SQL['l2_objective']})"


@query("training_progress", _PROGRESS)
def training_progress(spark, sf_dir):
    """The objective as an optimiser sees it: at the start (all alike), and at other parameters with their penalty."""

    def look(objective, x):
        objective(x)
        return NUMERIC.ravel(), objective(NUMERIC.ravel())[0]

    _, history = training.fit(pairs.typos(spark, sf_dir), SPEC, l2=10.0, optimizer=look, verbosity=1)
    return spark.createDataFrame([(i, round(v, 3) + 0.0) for i, v in enumerate(history)], "evaluation int, objective double")


@query("estimator_params", oracle.probabilities(oracle.PARTS, NUMERIC, 2, best=True).replace("SELECT pair_id, round", "SELECT pair_id, 2.5::DOUBLE AS l2, round"))
def estimator_params(spark, sf_dir):
    """An estimator whose parameters are set afterwards: its model scores by the best alignment; what wasn't set stays."""
    estimator = PairClassifier(spec=SPEC, l2=2.5, optimizer=lambda objective, x: (NUMERIC.ravel(), 0.0))
    estimator.set_params(viterbi=True)
    scored = estimator.fit(pairs.typos(spark, sf_dir)).transform(pairs.parts(spark, sf_dir))
    return _probabilities(scored).withColumn("l2", F.lit(float(estimator.get_params()["l2"])))


@query("model_round_trip", oracle.probabilities(oracle.PARTS, NUMERIC, 2))
def model_round_trip(spark, sf_dir):
    """Saved, loaded and applied as a pyspark.ml model."""
    at = relational.shared(spark, "model")
    PairClassifierModel(MODEL).write().overwrite().save(at)
    return _probabilities(PairClassifierModel.load(at).transform(pairs.parts(spark, sf_dir)))
