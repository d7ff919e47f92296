"""Approximate nearest neighbours: a neighbour graph by NN-descent in Spark joins, queries by greedy search on it.

Copies are one node.  Lists start with random nodes (those that a node meets in small random groups).  In an iteration all
neighbours of a node, forward ones and as many backward ones, meet at the node and are compared with each other: neighbours
of neighbours become neighbours.  Only pairs with a neighbour that is new since it last met take part, and only what is
nearer than the last of a list is sent to it.  Iterations end when few neighbours are new, whatever the size of the table.
Comparisons use directions rounded to eight bits a number, which is a quarter of what has to be shuffled otherwise.

A query starts at its own node.  Each hop expands the nearest few nodes of its beam that aren't expanded yet, for all
queries at once, in two joins with the graph's table; that is bucketed by node, so only what the queries ask is shuffled.
A query's code travels to the nodes it asks, and only what is nearer than the last of its beam comes back, as a number.
Beams are advanced in buckets of queries, whose arrays go through numpy together.  A search ends when its whole beam is
expanded.  The nodes found are measured again in double precision on the original
vectors, with all copies that can be among the nearest.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; vectors of another length
are never candidates; ties go to the smaller vec_id; a repeated vec_id is a row of its own, and a query's own vec_id is
left out with all its copies of the same vector; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alignspark.llm.common import CLEAN, delete, dropped, looked_up, rows_of, setting, shared_dir, stored, table
from alignspark.llm.vectors import matrix, unit, valid_vectors

#: Neighbours of a node, random groups that it starts in, share of new neighbours at which iterations end.
NEIGHBOURS, GROUPS, SETTLED = 32, 4, 0.005
#: Beam of a search, nodes expanded in a hop.
BEAM, EXPANDED = 192, 32
#: Queries whose beams advance together in one group (about).
TOGETHER = 256
GRAPH = "node long, dim int, code binary, ids array<long>, sims array<float>, fresh array<boolean>"
FOUND = "node long, ids array<long>, sims array<float>"


def rounded(vecs: np.ndarray) -> list[bytes]:
    """Directions with eight bits a number."""
    x = vecs.astype(np.float64)
    return [r.tobytes() for r in np.round(127 * (x / np.abs(x).max(1, keepdims=True))).astype(np.int8)]


def directions(codes, dim: int) -> np.ndarray:
    """Unit vectors of rounded ones."""
    x = np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(-1, dim).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _top(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """The k nearest distinct others of each owner, by owner, nearest first; of a repeated one the first given."""
    pair = np.lexsort((np.arange(len(owner)), other, owner))
    first = np.r_[True, (owner[pair[1:]] != owner[pair[:-1]]) | (other[pair[1:]] != other[pair[:-1]])] if len(pair) else np.zeros(0, bool)
    once = pair[first]
    once = once[np.lexsort((other[once], -sim[once], owner[once]))]
    starts = np.flatnonzero(np.r_[True, owner[once][1:] != owner[once][:-1]]) if len(once) else np.zeros(0, int)
    rank = np.arange(len(once)) - np.repeat(starts, np.diff(np.r_[starts, len(once)]))
    once = once[rank < k]
    return owner[once], other[once], sim[once], *(m[once] for m in more)


def _lists(owner: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[pa.ListArray]]:
    """The distinct owners, and for each of values (sorted by owner) their lists."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
    at = pa.array(np.r_[starts, len(owner)].astype(np.int32))
    return owner[starts], [pa.ListArray.from_arrays(at, pa.array(v)) for v in values]


def _found(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int) -> pa.RecordBatch:
    owner, other, sim = _top(owner, other, sim, k)
    node, lists = _lists(owner, other, sim.astype(np.float32))
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), *lists], ["node", "ids", "sims"])


def _whole(batches, column: str) -> Iterator[pa.Table]:
    """Tables of whole groups, of one dim each, from batches that are sorted by column."""

    def parts(t: pa.Table):
        dims = t["dim"].to_numpy()
        for d in np.unique(dims):
            yield (t if (dims == d).all() else t.filter(pa.array(dims == d))).combine_chunks()

    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([held, now]) if held is not None else now
        values = now[column].to_numpy()
        cut = int(np.searchsorted(values, values[-1])) if len(values) else 0
        if cut:
            yield from parts(now.slice(0, cut))
        held = now.slice(cut)
    if held is not None and len(held):
        yield from parts(held)


def _groups(at: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = np.r_[np.flatnonzero(np.r_[True, at[1:] != at[:-1]]), len(at)].tolist()
    return zip(starts[:-1], starts[1:], strict=True)


def _merge(graph: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """graph with what was found: the k nearest of both; only what comes from found is fresh."""
    nodes = graph.select("node", "dim", "code", "ids", "sims").withColumn("old", F.lit(True))
    every = nodes.unionByName(found.withColumn("old", F.lit(False)), allowMissingColumns=True)

    def run(batches):
        held = None
        for part in [*batches, None]:
            now = held if part is None else pa.Table.from_batches([part]) if held is None else pa.concat_tables([held, pa.Table.from_batches([part])])
            if now is None or not len(now):
                continue
            values = now["node"].to_numpy()
            cut = len(now) if part is None else int(np.searchsorted(values, values[-1]))
            held = now.slice(cut)
            if not cut:
                continue
            now = now.slice(0, cut).combine_chunks()
            own = now.filter(now["old"])  # one row a node, as ordered
            ids, sims = now["ids"].combine_chunks(), now["sims"].combine_chunks()
            sizes = ids.value_lengths().to_numpy(zero_copy_only=False)
            fresh = np.repeat(~now["old"].to_numpy(), sizes)
            order = np.argsort(fresh, kind="stable")  # what a list had comes first, and stays not fresh
            owner = np.repeat(now["node"].to_numpy(), sizes)
            owner, other, sim, fresh = _top(owner[order], ids.flatten().to_numpy()[order], sims.flatten().to_numpy()[order], k, fresh[order])
            nodes = own["node"].to_numpy()
            ends = np.searchsorted(owner, nodes, "right")
            at = pa.array(np.r_[0, ends].astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(v)) for v in (other, sim.astype(np.float32), fresh)]
            yield from pa.table([*(own[c].combine_chunks() for c in ("node", "dim", "code")), *lists], names=["node", "dim", "code", "ids", "sims", "fresh"]).to_batches()

    return rows_of(every.repartition("node").sortWithinPartitions("node", F.desc("old")), run, GRAPH)


def _random_lists(nodes: DataFrame, k: int, groups: int) -> DataFrame:
    """Each node's neighbours in `groups` random groups of about k / groups others of its dimension, dealt by hashes."""
    size = k // groups + 1
    sizes = nodes.groupBy("dim").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / size)).alias("blocks"))
    dealt = looked_up(nodes, sizes, "dim", F.col("node")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = dealt.select("node", "dim", "code", F.xxhash64("dim", "deal", F.pmod(F.xxhash64("node", "deal"), F.col("blocks"))).alias("group"))

    def run(batches):
        for part in _whole(batches, "group"):
            node, x, out = part["node"].to_numpy(), directions(part["code"], part["dim"][0].as_py()), []
            for a, b in _groups(part["group"].to_numpy()):
                for i in range(a, b, 1024):
                    rows = np.arange(i, min(b, i + 1024))
                    sims = x[rows] @ x[a:b].T
                    sims[np.arange(len(rows)), rows - a] = -2
                    one, two = np.nonzero(sims > -2)
                    out.append((node[rows][one], node[a:b][two], sims[one, two]))
            if out:
                yield _found(*(np.concatenate(c) for c in zip(*out, strict=True)), k)

    return rows_of(dealt.repartition("group").sortWithinPartitions("group"), run, FOUND)


def _both_ways(graph: DataFrame, k: int, turn: int) -> DataFrame:
    """node, other, fresh: forward neighbours, and k backward ones at most (fresh ones first, else by a hash of the turn)."""
    forward = graph.select("node", F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select("node", F.col("e.ids").alias("other"), F.col("e.fresh").alias("fresh"))
    spread = Window.partitionBy("node").orderBy(F.desc("fresh"), F.xxhash64("other", F.lit(turn)))
    backward = forward.select(F.col("other").alias("node"), F.col("node").alias("other"), "fresh").withColumn("r", F.row_number().over(spread)).where(F.col("r") <= k).drop("r")
    return forward.unionByName(backward)


def _descend(graph: DataFrame, k: int, turn: int) -> DataFrame:
    """One iteration: neighbours of each node meet there; what is nearer than the last of a full list is found."""
    last = F.when(F.size("ids") < k, F.lit(-2.0)).otherwise(F.element_at("sims", -1)).cast("float")
    side = graph.select(F.col("node").alias("other"), "dim", "code", last.alias("last"))
    meet = _both_ways(graph, k, turn).join(side, "other")

    def run(batches):
        for part in _whole(batches, "node"):
            at, other, fresh = part["node"].to_numpy(), part["other"].to_numpy(), part["fresh"].to_numpy(zero_copy_only=False).astype(bool)
            order = np.lexsort((~fresh, other, at))  # a neighbour both ways comes twice
            once = order[np.r_[True, (at[order][1:] != at[order][:-1]) | (other[order][1:] != other[order][:-1])]]
            at, other, fresh, last = at[once], other[once], fresh[once], part["last"].to_numpy()[once]
            x, out = directions(part["code"].take(pa.array(once)), part["dim"][0].as_py()), []
            for a, b in _groups(at):
                new = fresh[a:b]
                if b - a > 1 and new.any():
                    sims = x[a:b] @ x[a:b].T
                    np.fill_diagonal(sims, -3)
                    one, two = np.nonzero((sims > last[a:b, None]) & (new[:, None] | new[None, :]))
                    out.append((other[a:b][one], other[a:b][two], sims[one, two]))
            if out:
                yield _found(*(np.concatenate(c) for c in zip(*out, strict=True)), k)

    return rows_of(meet.repartition("node").sortWithinPartitions("node"), run, FOUND)


def build_graph(nodes: DataFrame, k: int = NEIGHBOURS, settled: float = SETTLED) -> DataFrame:
    """The neighbour graph of nodes (node, dim, code); iterations go on until few neighbours are new.

    They end, as lists only get nearer neighbours.
    """
    none = [F.array().cast(t).alias(n) for n, t in (("ids", "array<long>"), ("sims", "array<float>"), ("fresh", "array<boolean>"))]
    graph, turn = stored(_merge(nodes.select("node", "dim", "code", *none), _random_lists(nodes, k, GROUPS), k), "graph"), 0
    while True:
        better = stored(_merge(graph, _descend(graph, k, turn), k), "graph")
        changed = better.agg(F.sum(F.size(F.filter("fresh", lambda f: f))).alias("new"), F.sum(F.size("ids")).alias("all")).first()
        dropped(graph)
        graph, turn = better, turn + 1
        if (changed["new"] or 0) <= settled * (changed["all"] or 0):
            return graph


STATE = "query long, qcode binary, dim int, beam array<long>, sims array<float>, expanded array<boolean>, todo array<long>, worst float"


def _asked(batches) -> Iterator[pa.RecordBatch]:
    """query, node, sim of what is asked (query, qcode, dim, worst, node, code) and nearer than the query's worst."""
    for batch in batches:
        dims, worst = batch.column("dim").to_numpy(), batch.column("worst").to_numpy()
        sims = np.empty(batch.num_rows, np.float32)
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            rows = pa.array(at)
            sims[at] = np.einsum("ij,ij->i", directions(batch.column("qcode").take(rows), d), directions(batch.column("code").take(rows), d))
        good = np.flatnonzero(sims > worst)
        query, node = batch.column("query").to_numpy()[good], batch.column("node").to_numpy()[good]
        order = np.lexsort((node, query))  # a node is asked once for each neighbour of it in the beam
        order = order[np.r_[True, (query[order][1:] != query[order][:-1]) | (node[order][1:] != node[order][:-1])]] if len(order) else order
        yield pa.RecordBatch.from_arrays([pa.array(query[order]), pa.array(node[order]), pa.array(sims[good][order])], ["query", "node", "sim"])


def _advanced(beam: int, expanded: int):
    """For a bucket of queries: beams with what was found, and the next nodes to expand."""

    def run(key, state: pa.Table, found: pa.Table) -> pa.Table:
        if not len(state):
            return state.select([c.split()[0] for c in STATE.split(", ")])
        state = state.combine_chunks()
        order = np.argsort(state["query"].to_numpy(), kind="stable")
        state = state.take(pa.array(order)).combine_chunks()
        query = state["query"].to_numpy()
        flat = lambda name: state[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        sizes = state["beam"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        owner, ids, sims, done = np.repeat(np.arange(len(query)), sizes), flat("beam"), flat("sims"), flat("expanded").astype(bool)
        asked = state["todo"].combine_chunks()
        if len(asked.flatten()):  # what was to be expanded is
            at = np.repeat(np.arange(len(query)), asked.value_lengths().to_numpy(zero_copy_only=False))
            pairs = {*zip(at.tolist(), asked.flatten().to_pylist(), strict=True)}
            done |= np.fromiter(((o, i) in pairs for o, i in zip(owner.tolist(), ids.tolist(), strict=True)), bool, len(ids))
        new = np.searchsorted(query, found["query"].to_numpy())
        owner, ids, sims, done = np.r_[owner, new], np.r_[ids, found["node"].to_numpy()], np.r_[sims, found["sim"].to_numpy()], np.r_[done, np.zeros(len(new), bool)]
        owner, ids, sims, done = _top(owner, ids, sims, beam, done)  # of a repeated node the one that the beam has comes first
        rank = np.cumsum(~done) - np.r_[0, np.cumsum(~done)][np.searchsorted(owner, owner)]
        now = ~done & (rank <= expanded)
        ends = np.searchsorted(owner, np.arange(len(query)), "right")
        full = np.bincount(owner, minlength=len(query)) >= beam
        worst = np.where(full, sims[np.maximum(ends - 1, 0)], -2.0).astype(np.float32)
        at = pa.array(np.r_[0, ends].astype(np.int32))
        todo = pa.array(np.r_[0, np.searchsorted(owner[now], np.arange(len(query)), "right")].astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(v)) for v in (ids, sims.astype(np.float32), done)]
        return pa.table([state["query"], state["qcode"], state["dim"], *lists, pa.ListArray.from_arrays(todo, pa.array(ids[now])), pa.array(worst)], names=[c.split()[0] for c in STATE.split(", ")])

    return run


def search(queries: DataFrame, graph: DataFrame, k: int = NEIGHBOURS, beam: int = BEAM, expanded: int = EXPANDED, together: int = TOGETHER) -> DataFrame:
    """query, node, for the nodes of each query's final beam.  queries: query (a node), qcode, dim; edges go both ways.

    together: queries of a bucket (about).
    """
    spark = graph.sparkSession
    ways = _both_ways(graph, k, -1).groupBy("node").agg(F.collect_set("other").alias("near"))
    name = f"alignspark_graph_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with setting(spark, CLEAN, "true"):
        graph.select("node", "code").join(ways, "node", "left").write.bucketBy(buckets, "node").sortBy("node").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    edges = spark.table(name)
    own = F.array("query")
    state = queries.select("query", "qcode", "dim", own.alias("beam"), F.array(F.lit(1.0).cast("float")).alias("sims"), F.array(F.lit(False)).alias("expanded"), own.alias("todo"), F.lit(-2.0).cast("float").alias("worst"))
    state = stored(state, "search")
    groups = max(1, state.count() // together)
    bucket = lambda df: df.groupBy(F.pmod(F.xxhash64("query"), F.lit(groups)))
    while True:  # a hop expands nodes that no hop did, so it ends
        asks = state.select("query", "qcode", "dim", "worst", F.explode("todo").alias("node")).join(edges.select("node", "near").hint("merge"), "node")
        asks = asks.select("query", "qcode", "dim", "worst", F.explode("near").alias("node")).join(edges.select("node", "code").hint("merge"), "node")
        found = rows_of(asks.select("query", "qcode", "dim", "worst", "node", "code"), _asked, "query long, node long, sim float")
        after = stored(bucket(state).cogroup(bucket(found)).applyInArrow(_advanced(beam, expanded), STATE), "search")
        dropped(state)
        state = after
        if state.where(F.size("todo") > 0).isEmpty():
            break
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    delete(spark, f"{shared_dir(spark)}/{name}")
    return state.select("query", F.explode("beam").alias("node"))


def _coded(nodes: DataFrame) -> DataFrame:
    """node, dim, code of nodes (node, vec, dim)."""

    def run(batches):
        for part in batches:
            dims, codes = part.column("dim").to_numpy(), [b""] * part.num_rows
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                for i, code in zip(at.tolist(), rounded(matrix(part.column("vec").take(pa.array(at)), d)), strict=True):
                    codes[i] = code
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("dim"), pa.array(codes, pa.binary())], ["node", "dim", "code"])

    return rows_of(nodes.select("node", "dim", "vec"), run, "node long, dim int, code binary")


def nearest(embeddings: DataFrame, every: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by every."""
    rows = stored(valid_vectors(embeddings).withColumn("key", F.xxhash64("key")).drop("label"), "vectors")
    nodes = stored(rows.groupBy(F.col("key").alias("node")).agg(F.first("vec").alias("vec"), F.first("dim").alias("dim")), "nodes")
    coded = stored(_coded(nodes), "codes")
    graph = build_graph(coded)
    asked = stored(rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", F.col("key").alias("query")), "asked")
    one = asked.select("query").distinct()
    found = stored(search(one.join(coded.select(F.col("node").alias("query"), F.col("code").alias("qcode"), "dim"), "query"), graph), "found")
    dropped(coded, graph)
    one = one.join(nodes.select(F.col("node").alias("query"), F.col("vec").alias("qvec"), "dim"), "query")
    copies = rows.select("key", "vec_id").withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("r") <= k + 1)

    def run(batches):
        for part in batches:
            dim = part.column("dim").to_numpy()
            score = np.zeros(part.num_rows)
            for d in np.unique(dim).tolist():
                at = pa.array(np.flatnonzero(dim == d))
                a, b = (unit(matrix(part.column(c).take(at), d), np.float64) for c in ("qvec", "vec"))
                score[at.to_numpy()] = np.clip((a * b).sum(1), -1, 1)
            yield pa.RecordBatch.from_arrays([part.column("query"), part.column("node"), pa.array(score)], ["query", "node", "score"])

    both = found.join(one, "query").join(nodes.select("node", "vec"), "node").select("query", "node", "qvec", "vec", "dim")
    scored = rows_of(both, run, "query long, node long, score double")
    scored = scored.withColumn("r", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("r") <= k + 1).drop("r")
    wide = asked.withColumnRenamed("vec_id", "query_id").join(scored, "query").join(copies.select(F.col("key").alias("node"), "vec_id", "r"), "node")
    wide = wide.where(~((F.col("vec_id") == F.col("query_id")) & (F.col("node") == F.col("query"))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = wide.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), 50, 5)


QUERIES = {"op1_nearest": op1_nearest}
SQL: dict[str, str] = {}
