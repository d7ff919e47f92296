"""Near-duplicate embeddings by a flat pruned neighbour graph on overlapping cluster shards.

Copies (equal vectors of one label) are one node with a weight.  Nodes are dealt to overlapping shards: the centroids of a
division are nodes picked from a bounded sample, none too near to another; a node is at home with the nearest and stands
also in every shard whose border is so near that a linked node may be at home there: for a cosine c, at most sqrt(1 - c^2)
away, and in many dimensions, where a link's way across a border is a chance part of it, REACH standard deviations of
that.  Shards that are still too large are divided again as long as that saves work; one that centroids can't divide (one
dense cluster) is cut into blocks by a hash.

Each shard builds a graph: the nearest of every node (exact, as a shard is small), pruned robustly (a neighbour goes if a
nearer one lies clearly nearer to it), with some far neighbours, and all edges in both directions.  The adjacency lists of
a node's shards are united.  Every node then searches the shard it calls home (all blocks of a dense cluster): greedily
from the shard's medoids, and from where it comes within range it expands all that lies in range.  A search that misses
its own node is repeated from there.  What it finds is verified by the cosine in double precision and counts for both ends
of the link.

The links of a bounded sample of nodes are audited by brute force against all nodes.  If fewer than TARGET of them were
found, all is done again with the greatest reach, at which every link meets in a shard, and a wider search.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows with a null label, link with
nothing and are kept; vectors of another length or label never link; each row counts, repeated ones and those that share a
vec_id too; a null vec_id takes no part in links; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import logging
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignspark.llm.common import components, dropped, looked_up, rows_of, small_enough, stored, table
from alignspark.llm.vectors import all_vectors, matrix, unit

log = logging.getLogger(__name__)

#: Nodes of a shard, centroids of a division, candidates that pruning sees, degree, far neighbours, beam, the pruning's factor.
SHARD, FANOUT, CANDIDATES, DEGREE, FAR, BEAM, ALPHA = 2000, 64, 48, 16, 6, 24, 1.2
#: Centroids are at least this far from each other (cosine at most); most rows of a table of centroids that is broadcast.
APART, CENTROID_ROWS = 0.8, 2_000
#: Reach across borders in standard deviations (a link is lost where both its ends are further behind the border than that);
#: a division must leave at most this share of the pairs.
REACH, WORTH = 1.25, 0.7
#: Nodes that are audited, share of their links that must have been found.
AUDITED, TARGET = 256, 0.99


def _centroids(nodes: DataFrame, large: DataFrame) -> DataFrame:
    """shard, centroids (bytes of a matrix): for each shard in large (shard, n), FANOUT nodes at most that are far apart."""
    sample = nodes.join(small_enough(large, 100_000), "shard").where(F.pmod(F.xxhash64("node", "shard"), F.col("n")) < 8 * FANOUT)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        dim, n = group["dim"][0].as_py(), group["n"][0].as_py()
        x = unit(matrix(group["vec"], dim))
        wanted, chosen = min(FANOUT, max(2, -(-8 * n // SHARD))), [0]
        near = x @ x[0]
        while len(chosen) < wanted:
            i = int(np.argmin(near))
            if near[i] > APART:
                break
            chosen.append(i)
            near = np.maximum(near, x @ x[i])
        return pa.table({"shard": group["shard"].slice(0, 1), "centroids": pa.array([x[chosen].astype(np.float32).tobytes()], pa.binary())})

    return sample.groupBy("shard").applyInArrow(run, "shard string, centroids binary")


def near_shards(x: np.ndarray, centroids: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, centroid, home: for each row the centroids whose border with every other centroid is at most reach behind it."""
    sims = x @ centroids.T
    apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 1e-12))
    np.fill_diagonal(apart, np.inf)
    home = sims.argmax(1)
    good = np.empty(sims.shape, bool)
    for i in range(0, len(x), 256):
        good[i : i + 256] = ((sims[i : i + 256, None, :] - sims[i : i + 256, :, None]) / apart).max(2) <= reach
    good[np.arange(len(x)), home] = True
    row, shard = np.nonzero(good)
    return row, shard, home[row] == shard


def _divide(nodes: DataFrame, centroids: DataFrame, least: float, deviations: float) -> DataFrame:
    """nodes of divided shards in their new shards; home only in the nearest of the shard that was home."""
    joined = nodes.join(small_enough(centroids, CENTROID_ROWS), "shard").select("shard", "node", "vec", "dim", "home", "centroids")
    away = (1 - least * least) ** 0.5

    def run(batches):
        for part in batches:
            shard = np.array(part.column("shard").to_pylist(), object)
            for s in dict.fromkeys(shard.tolist()):
                rows = np.flatnonzero(shard == s)
                own = part.take(pa.array(rows))
                dim = own.column("dim")[0].as_py()
                reach = away * min(1.0, deviations / max(dim - 1, 1) ** 0.5)
                at, near, home = near_shards(unit(matrix(own.column("vec"), dim)), np.frombuffer(own.column("centroids")[0].as_py(), np.float32).reshape(-1, dim), reach)
                take = pa.array(at)
                home &= own.column("home").to_numpy(zero_copy_only=False).astype(bool)[at]
                yield pa.RecordBatch.from_arrays([pa.array([f"{s}/{c}" for c in near.tolist()], pa.string()), *(own.column(c).take(take) for c in ("node", "vec", "dim")), pa.array(home)], ["shard", "node", "vec", "dim", "home"])

    return rows_of(joined, run, "shard string, node long, vec binary, dim int, home boolean")


def deal(nodes: DataFrame, least: float, deviations: float = REACH) -> DataFrame:
    """shard, block, blocks, node, vec, dim, home: which shards hold a node, and whether it searches there (all blocks of it)."""
    now = stored(nodes.select(F.concat_ws("x", "label", "dim").alias("shard"), "node", "vec", "dim", F.lit(True).alias("home")), "shards")
    sizes = stored(now.groupBy("shard").agg(F.count(F.lit(1)).alias("n")), "sizes")
    flat, thick = [], []
    while True:  # each division leaves at most WORTH of the pairs
        large = sizes.where(F.col("n") > 2 * SHARD)
        flat.append(now.join(small_enough(large.select("shard")), "shard", "left_anti"))
        if large.isEmpty():
            break
        parts = stored(_divide(now, stored(_centroids(now, large), "centroids"), least, deviations), "shards")
        parted = stored(parts.groupBy("shard").agg(F.count(F.lit(1)).alias("n")), "sizes").withColumn("parent", F.regexp_replace("shard", "/[0-9]+$", ""))
        saved = parted.groupBy("parent").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
        verdict = stored(large.join(saved, large["shard"] == saved["parent"], "left").select("shard", "n", (F.coalesce("pairs", F.lit(float("inf"))) > WORTH * F.col("n").cast("double") * F.col("n")).alias("dense")), "verdict")
        dense, divided = verdict.where("dense").select("shard", "n"), verdict.where("NOT dense").select(F.col("shard").alias("parent"))
        thick.append(now.join(small_enough(dense), "shard"))
        sizes = stored(parted.join(small_enough(divided), "parent").select("shard", "n"), "sizes")
        now = parts.join(small_enough(sizes.select("shard")), "shard", "left_semi")
    keep = ["shard", "block", "blocks", "node", "vec", "dim", "home"]
    out = reduce(DataFrame.unionByName, flat).withColumn("block", F.lit(0).cast("long")).withColumn("blocks", F.lit(1).cast("long")).select(*keep)
    if thick:
        blocks = F.ceil(F.col("n") / SHARD)
        out = out.unionByName(reduce(DataFrame.unionByName, thick).withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("blocks", blocks).select(*keep))
    return out


def robust_prune(pairs: np.ndarray, sims: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Of each row's candidates (nearest first, -2 where none), those that no kept one is nearer to by the factor alpha.

    sims: cosines of candidates to their row's node; pairs: of candidates to each other.
    """
    rows, left, kept = np.arange(len(sims)), sims > -2, np.zeros(sims.shape, bool)
    for _ in range(degree):
        first = left.argmax(1)
        kept[rows, first] |= left[rows, first]
        left[rows, first] = False
        left &= alpha * (1 - pairs[rows, first]) > 1 - sims
        if not left.any():
            break
    return kept


def build(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency of a shard's unit vectors, as starts and neighbours: pruned nearest neighbours, far ones, both directions."""
    n = len(x)
    most = min(CANDIDATES, n - 1)
    far = np.random.default_rng(seed).integers(0, n, (n, FAR))
    one, two = [np.repeat(np.arange(n), FAR)], [far.ravel()]
    for i in range(0, n if most else 0, 256):
        sims = x[i : i + 256] @ x.T
        sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -2
        near = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1), 1)
        own = x[near]
        row, place = np.nonzero(robust_prune(own @ own.transpose(0, 2, 1), np.take_along_axis(sims, near, 1)))
        one.append(i + row)
        two.append(near[row, place])
    a, b = np.concatenate(one), np.concatenate(two)
    code = np.unique(np.r_[a * n + b, b * n + a])
    a, b = code // n, code % n
    a, b = a[a != b], b[a != b]
    return np.searchsorted(a, np.arange(n + 1)), b


def graph(index: DataFrame) -> DataFrame:
    """node, near (ids): adjacency lists of all shards, united."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        node = group["node"].to_numpy()
        starts, near = build(unit(matrix(group["vec"], group["dim"][0].as_py())))
        return pa.table({"node": group["node"], "near": pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(node[near], pa.int64()))})

    lists = index.groupBy("shard", "block").applyInArrow(run, "node long, near array<long>")
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def range_search(x: np.ndarray, starts: np.ndarray, near: np.ndarray, asks: np.ndarray, seeds: np.ndarray, least: float, slack: float = 0.05, most: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Ask and node of pairs with a cosine of at least least: greedy from each ask's seeds with a beam, then everything next to what is in range.

    starts, near: adjacency of x; asks: unit vectors; seeds: nodes for each ask.  All asks advance together; a cosine is only
    worked out for nodes that an ask's search comes to.
    """
    m, n = len(asks), len(x)
    sims, expanded = np.full((m, n), -2, np.float32), np.zeros((m, n), bool)

    def meet(ask: np.ndarray, node: np.ndarray) -> None:
        code = np.unique((ask * n + node)[sims[ask, node] == -2])
        for i in range(0, len(code), 65536):
            a, b = code[i : i + 65536] // n, code[i : i + 65536] % n
            sims[a, b] = np.einsum("ij,ij->i", asks[a], x[b])

    def expand(ask: np.ndarray, node: np.ndarray) -> None:
        sizes = starts[node + 1] - starts[node]
        at = np.repeat(starts[node] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        meet(np.repeat(ask, sizes), near[at])

    meet(np.repeat(np.arange(m), seeds.shape[1]), seeds.ravel())
    active, beam = np.arange(m), min(most, n)
    while len(active):
        top = np.argpartition(-sims[active], beam - 1, axis=1)[:, :beam]
        own = sims[active[:, None], top]
        todo = np.where(expanded[active[:, None], top], -2, own)
        ended = (todo == -2).all(1) | (own > -2).all(1) & (own.max(1) >= least) & (beam == most)
        active, top, todo = active[~ended], top[~ended], todo[~ended]
        best = np.argsort(-todo, axis=1)[:, :4]
        row, place = np.nonzero(np.take_along_axis(todo, best, 1) > -2)
        ask, node = active[row], top[row, best[row, place]]
        expanded[ask, node] = True
        expand(ask, node)
    expanded[:] = False
    while True:  # the range grows as long as its border does
        ask, node = np.nonzero((sims >= least - slack) & ~expanded)
        if not len(ask):
            break
        expanded[ask, node] = True
        for i in range(0, len(ask), 4096):
            expand(ask[i : i + 4096], node[i : i + 4096])
    return np.nonzero(sims >= least - 1e-5)


def medoids(x: np.ndarray, most: int = 8) -> list[int]:
    """The nodes nearest to the shard's mean and to the means of a few parts of it."""
    out = [int(np.argmax(x @ x.mean(0)))]
    far = x @ x[out[0]]
    while len(out) < min(most, len(x)):
        i = int(np.argmin(far))
        if i in out:
            break
        out.append(i)
        far = np.maximum(far, x @ x[i])
    return out


def roots(near: np.ndarray) -> np.ndarray:
    """The least node that each node of a symmetric matrix of links reaches."""
    root = np.full(len(near), -1)
    for i in range(len(near)):
        if root[i] < 0:
            root[i], border = i, np.array([i])
            while len(border):
                border = np.flatnonzero(near[border].any(0) & (root < 0))
                root[border] = i
    return root


LINKS = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("root", pa.int64())])


def links(index: DataFrame, near: DataFrame, least: float, weights: DataFrame, wide: int = 1) -> DataFrame:
    """Verified links, each for both ends whichever search found it, as rows of two kinds.

    Without other: node, n (weights it links with among the nodes that search the same shard), root (a node of its
    component).  With other: a link of nodes that search different shards, n and m being the weights of other and node; both
    may find it, so these rows may repeat.  Each pair of a shard's blocks is a group, so nodes at home there meet once.
    wide: how much wider than usual beams and ranges are.
    """
    held = index.join(near, "node").join(weights, "node").withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    held = held.select("shard", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "home", "node", "vec", "dim", "weight", "near")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        node, weight, block, dim = group["node"].to_numpy(), group["weight"].to_numpy(), group["block"].to_numpy(), group["dim"][0].as_py()
        home = group["home"].to_numpy(zero_copy_only=False).astype(bool)
        raw, lists = matrix(group["vec"], dim), group["near"].combine_chunks()
        x, exact = unit(raw), unit(raw, np.float64)
        linked = np.zeros((len(node), len(node)), bool)
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        for asking, asked in {(low, high), (high, low)}:
            asks, there = np.flatnonzero((block == asking) & home), np.flatnonzero(block == asked)
            if not len(asks) or not len(there):
                continue
            own, part = node[there], x[there]
            e = lists.take(pa.array(there))
            sizes = e.value_lengths().to_numpy(zero_copy_only=False)
            e = e.flatten().to_numpy()
            at = np.minimum(np.searchsorted(own, e), len(own) - 1)
            good = own[at] == e  # neighbours in other shards and blocks aren't here
            starts, adjacent = np.r_[0, np.cumsum(good)[np.cumsum(sizes) - 1] if len(e) else np.zeros(len(own), int)], at[good]
            seeds = np.array(medoids(part))
            for i in range(0, len(asks), 256):
                some = asks[i : i + 256]
                a, b = range_search(part, starts, adjacent, x[some], np.broadcast_to(seeds, (len(some), len(seeds))), least, 0.05 * wide, BEAM * wide)
                if asking == asked:  # what missed its own node is searched again from there
                    itself = np.searchsorted(own, node[some])
                    found = np.zeros(len(some), bool)
                    found[a[b == itself[a]]] = True
                    lost = np.flatnonzero(~found)
                    if len(lost):
                        more, others = range_search(part, starts, adjacent, x[some[lost]], itself[lost, None], least, 0.05 * wide, BEAM * wide)
                        a, b = np.r_[a, lost[more]], np.r_[b, others]
                for k in range(0, len(a), 65536):
                    one, two = some[a[k : k + 65536]], there[b[k : k + 65536]]
                    good = (np.einsum("ij,ij->i", exact[one], exact[two]) >= least) & (one != two)
                    linked[one[good], two[good]] = True
        linked |= linked.T
        between = np.triu(linked)
        between[np.ix_(home, home)] = False
        a, b = np.nonzero(between)
        linked[~home], linked[:, ~home] = False, False
        inside = np.flatnonzero(linked.any(1))
        root = node[roots(linked)[inside]]
        n = np.array([weight[linked[i]].sum() for i in inside.tolist()], np.int64)
        none = lambda k: pa.nulls(k, pa.int64())
        one = pa.table([pa.array(node[inside]), none(len(inside)), pa.array(n), none(len(inside)), pa.array(root)], schema=LINKS)
        return pa.concat_tables([one, pa.table([pa.array(node[a]), pa.array(node[b]), pa.array(weight[b]), pa.array(weight[a]), none(len(a))], schema=LINKS)])

    return held.groupBy("shard", "low", "high").applyInArrow(run, "node long, other long, n long, m long, root long")


def audit(nodes: DataFrame, found: DataFrame, least: float, sample: int = AUDITED) -> float:
    """Links found (node, n_links) over links there are, for about `sample` nodes by a hash: each against all nodes, in one narrow pass."""
    share = max(1, nodes.count() // sample)
    asks = nodes.where(F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(share)) == 0).orderBy("node").limit(4 * sample).select("node", "label", "dim", "vec", "weight").toArrow()
    sent = nodes.sparkSession.sparkContext.broadcast([(d, asks.filter(pc.equal(asks["dim"], d))) for d in pc.unique(asks["dim"]).to_pylist()])

    def run(batches):
        known = [(d, a["node"].to_numpy(), a["label"].to_numpy(), unit(matrix(a["vec"], d), np.float64)) for d, a in sent.value]
        for part in batches:
            dims = part.column("dim").to_numpy()
            for d, node, label, x in known:
                own = part.filter(pa.array(dims == d))
                if own.num_rows:
                    near = x @ unit(matrix(own.column("vec"), d), np.float64).T >= least
                    near &= (label[:, None] == own.column("label").to_numpy()) & (node[:, None] != own.column("node").to_numpy())
                    n = near @ own.column("weight").to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n)], ["node", "n"])

    there = rows_of(nodes.select("node", "label", "dim", "vec", "weight"), run, "node long, n long").agg(F.sum("n")).first()[0] or 0
    there += sum(w - 1 for w in asks["weight"].to_pylist())
    some = nodes.sparkSession.createDataFrame(pa.table({"node": asks["node"]}))
    got = found.join(F.broadcast(some), "node", "left_semi").agg(F.sum("n_links")).first()[0] or 0
    return got / there if there else 1.0


def dedup_embeddings(embeddings: DataFrame, least: float, target: float = TARGET) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row, and audited_recall: the share of the audited nodes' links that were found.

    Runs that find less than target of these are repeated with a wider search, three runs at most; the share says what holds.
    """
    rows = all_vectors(embeddings).withColumn("node", F.when(F.col("key").isNotNull() & F.col("label").isNotNull(), F.xxhash64("key", "label")))
    rows = stored(rows, "vectors")
    nodes = stored(rows.where("node IS NOT NULL").groupBy("node").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.first("dim").alias("dim"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least_id")), "nodes")
    for deviations, wide in ((REACH, 1), (float("inf"), 4), (float("inf"), 16)):
        index = stored(deal(nodes, least, deviations), "index")
        near = stored(graph(index), "graph")
        found = stored(links(index, near, least, nodes.select("node", "weight"), wide), "links")
        dropped(index, near)
        inside, between = found.where("other IS NULL"), found.where("other IS NOT NULL").select("node", "other", "n", "m").distinct()
        ends = inside.select("node", "n").unionByName(between.select("node", "n")).unionByName(between.select(F.col("other").alias("node"), F.col("m").alias("n")))
        counts = ends.groupBy("node").agg(F.sum("n").alias("n"))
        counted = stored(nodes.join(counts, "node", "left").select("node", "least_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "counted")
        share = audit(nodes, counted, least)
        if share >= target:
            break
        log.warning("%.4f of the audited nodes' links were found, less than %.4f", share, target)
    labels = components(found.select(F.col("node").alias("a"), F.coalesce("other", "root").alias("b")))
    named = stored(counted.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    ids = stored(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "ids")
    per_node = stored(looked_up(named, ids, "component", F.col("node")).select("node", "n_links", "component_id"), "per-node")
    out = looked_up(rows.select("node", "vec_id"), per_node, "node", F.col("vec_id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(float(share)).alias("audited_recall"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_embeddings(table(spark, sf_dir, "embeddings"), 0.93)


QUERIES = {"op7_embedding_dedup": op7_embedding_dedup}
SQL: dict[str, str] = {}
