"""Merkle manifest of a dataset: leaf digests, a tree for each source, one root, and a proof for every row.

Superblock reduction: nodes are dealt to buckets by index // fanout^k; one applyInPandas collapses a bucket by k levels to
its root and keeps the bucket's nodes in one row; bucket roots are reduced in the same way until one node is left.  Back
from the root, each bucket row is joined with the proof of its bucket and gives its nodes' proofs: the levels within the
bucket, then the bucket's upper ones.  A leaf's text is read once; leaves are shuffled as 32-byte digests; groups hold
fanout^k nodes at most, whatever a source's share of the rows.

H: lowercase hex sha256 of the inputs one after another, digests as hex text.  A leaf is H of doc_id, source, lang, n_chars
and text, each as UTF-8 bytes' count, ":" and the value, or "-" if null.  Leaves ascend by doc_id within their source, then
subroots by source in UTF-8 order.

Defined results: a null source comes first and is a source of its own; null doc_ids come first in their source and aren't
tampered with; rows that share a doc_id are ordered by their leaf; repeated rows are leaves of their own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alignspark.llm.common import BROADCAST_ROWS, dropped, in_slices, rows_of, stored, table

#: Nodes of a run, and levels that a bucket collapses: groups of 16^3 nodes.
FANOUT, LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PROOF = "array<struct<before:string,after:string>>"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode("ascii")).hexdigest()


def leaf(text: Column | None = None) -> Column:
    """The leaf's digest as 32 bytes; text: what stands in place of the column."""

    def part(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    columns = [F.col(n) if n != "text" or text is None else text for n in FIELDS]
    return F.unhex(F.sha2(F.concat(*map(part, columns)), 256))


def tampers() -> Column:
    """Rows whose text is lower-cased to test the proofs."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def levels_of(n: int) -> int:
    """Levels from n nodes to one."""
    out = 0
    while n > 1:
        n, out = -(-n // FANOUT), out + 1
    return out


def collapse(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the levels above them."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest(*nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
        out.append(nodes)
    return out


def siblings(tree: list[list[str]], i: int) -> list[tuple[str, str]]:
    """For each level: what stands before and after node i in its run."""
    out = []
    for level in tree[:-1]:
        begin = i // FANOUT * FANOUT
        out.append(("".join(level[begin:i]), "".join(level[i + 1 : begin + FANOUT])))
        i //= FANOUT
    return out


def fold(node: str, proof: list[tuple[str, str]]) -> str:
    """The root that a node and a proof lead to."""
    for before, after in proof:
        node = digest(before, node, after)
    return node


def indexed(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """rows with i, their place from 0 within their key by order, and n, the rows of the key.

    Rows are sorted across tasks by key and order, so a key of any size is shared by tasks; each task counts its own rows
    of a key, and what earlier tasks have of it is added.  rows must be a written table: its own place breaks ties.
    """
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    sorting = [F.col(key).asc_nulls_first(), *order, F.col("_tie")]
    rows = rows.repartitionByRange(*sorting).sortWithinPartitions(*sorting)
    schema = [f.name for f in rows.schema if f.name != "_tie"]

    def run(batches):
        from pyspark import TaskContext

        part, last, at = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for k in batch.column(key).to_pylist():
                at = at + 1 if k == last else 0
                last = k
                places.append(at)
            columns = [batch.column(n) for n in schema]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(places, pa.int64())], [*schema, "_part", "_at"])

    out = rows_of(rows, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_tie") + ", _part int, _at long")
    out = stored(out, "places")
    counts = out.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    # at most a row for each task, and one for each key: the window's groups have a row for each task that has the key
    before = Window.partitionBy(key).orderBy("_part")
    counts = counts.select(F.col(key).alias("_key"), "_part", (F.sum("_rows").over(before) - F.col("_rows")).alias("_before"), F.sum("_rows").over(Window.partitionBy(key)).alias("n"))
    counts = stored(counts, "counts")
    small = counts.count() <= BROADCAST_ROWS
    counts = F.broadcast(counts) if small else counts.hint("merge")
    both = out.join(counts, (out[key].eqNullSafe(counts["_key"])) & (out["_part"] == counts["_part"]))
    return both.select(*[out[c] for c in schema], (F.col("_at") + F.col("_before")).alias("i"), "n")


class Tree:
    """Trees of nodes (key string, i, n, node: 32 bytes, and held columns) by key: bucket rows for each round, and the keys' roots."""

    def __init__(self, nodes: DataFrame, kept: str = "", levels: int = LEVELS) -> None:
        """kept: DDL of the lowest nodes' further columns, which stay with them as arrays in the bucket rows.

        levels: those that a bucket collapses.
        """
        self.levels, self.size = levels, FANOUT**levels
        self.kept = [c.split()[0] for c in kept.split(", ")] if kept else []
        self.rounds: list[DataFrame] = []
        self.temporary: list[DataFrame] = []
        while True:
            names = self.kept if not self.rounds else []
            extra = "".join(f", {n} array<{dict(nodes.dtypes)[n]}>" for n in names)
            blocks = stored(self._blocks(nodes, names, f"key string, bucket long, n long, nodes binary, root string{extra}"), "blocks")
            self.rounds.append(blocks)
            if not blocks.where(F.col("n") > self.size).limit(1).count():
                break
            above = F.ceil(F.col("n") / self.size).cast("long")
            nodes = blocks.select("key", F.col("bucket").alias("i"), above.alias("n"), F.unhex("root").alias("node"))
        self.roots = self.rounds[-1].select("key", "root")

    def _blocks(self, nodes: DataFrame, names: list[str], schema: str) -> DataFrame:
        levels, size = self.levels, self.size

        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("i", kind="stable")
            first = group.iloc[0]
            packed = b"".join(group["node"])
            hexes = [packed[k : k + 32].hex() for k in range(0, len(packed), 32)]
            tree = collapse(hexes, min(levels, levels_of(int(first["n"]))))
            out = {"key": first["key"], "bucket": int(first["i"]) // size, "n": int(first["n"]), "nodes": packed, "root": tree[-1][0]}
            return pd.DataFrame({k: [v] for k, v in (out | {n: group[n].tolist() for n in names}).items()})

        return nodes.groupBy("key", F.floor(F.col("i") / size).cast("long")).applyInPandas(run, schema)

    def proofs(self, of_keys: DataFrame) -> DataFrame:
        """Bucket rows of the lowest round with upper (the proof from the bucket's root to the top).

        of_keys: key, upper: the proof from each key's root to the top.
        """
        upper = of_keys.select("key", F.lit(0).cast("long").alias("bucket"), "upper")
        for blocks in self.rounds[:0:-1]:
            joined = _with_upper(blocks, upper)
            upper = stored(rows_of(joined.select("key", "bucket", "n", "nodes", "upper"), _expanded(self.levels), f"key string, bucket long, upper {PROOF}"), "proofs")
            self.temporary.append(upper)
        return _with_upper(self.rounds[0], upper)

    def drop(self) -> None:
        dropped(*self.rounds, *self.temporary)


def _with_upper(blocks: DataFrame, upper: DataFrame) -> DataFrame:
    """Each bucket row with its proof (one row a bucket on both sides)."""
    upper = upper.select(F.col("key").alias("_key"), F.col("bucket").alias("_bucket"), "upper")
    return blocks.join(upper.hint("merge"), blocks["key"].eqNullSafe(upper["_key"]) & (blocks["bucket"] == upper["_bucket"])).drop("_key", "_bucket")


def _expanded(levels: int) -> Callable:
    """Of bucket rows with their upper proof: each node's index and whole proof."""

    def run(batches):
        for batch in batches:
            for key, bucket, n, packed, upper in zip(*(batch.column(c).to_pylist() for c in ("key", "bucket", "n", "nodes", "upper")), strict=True):
                hexes = [packed[k : k + 32].hex() for k in range(0, len(packed), 32)]
                tree = collapse(hexes, min(levels, levels_of(n)))
                begin = bucket * FANOUT**levels
                proofs = [[{"before": b, "after": a} for b, a in siblings(tree, i)] + upper for i in range(len(hexes))]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(hexes), pa.string()), pa.array(range(begin, begin + len(hexes)), pa.int64()), pa.array(proofs, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))], ["key", "bucket", "upper"])

    return run


def manifest(documents: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified for every row; levels: those that a bucket collapses."""
    leaves = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("key"), leaf().alias("node"),
        F.when(tampers(), leaf(F.translate("text", _UPPER, _LOWER))).alias("changed"),
    )
    held = stored(leaves, "leaves")
    tree = Tree(indexed(held, "key", F.col("doc_id").asc_nulls_first(), F.col("node")), "doc_id long, changed binary", levels)
    subroots = stored(tree.roots.select("key", F.unhex("root").alias("node"), F.lit("").alias("all")), "subroots")
    ranked = stored(indexed(subroots, "all", F.col("key").asc_nulls_first()), "ranked")
    top = Tree(ranked.select(F.col("all").alias("key"), "i", "n", "node", F.col("key").alias("source")), "source string", levels)
    root = top.roots.first()
    if root is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    nothing = documents.sparkSession.createDataFrame([("", [])], f"key string, upper {PROOF}")
    of_sources = rows_of(top.proofs(nothing), _of_sources(levels), f"key string, subroot string, upper {PROOF}")
    of_sources = stored(of_sources, "sources")
    blocks = tree.proofs(of_sources.select("key", "upper"))
    names = of_sources.select(F.col("key").alias("_key"), "subroot")
    names = F.broadcast(names) if names.count() <= BROADCAST_ROWS else names.hint("merge")
    blocks = blocks.join(names, blocks["key"].eqNullSafe(names["_key"])).withColumn("top", F.lit(root["root"]))
    return rows_of(blocks.select("key", "n", "nodes", "doc_id", "changed", "upper", "subroot", "top"), _verified(levels), "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _of_sources(levels: int) -> Callable:
    """Of the top tree's bucket rows: each source's subroot and its proof to the root."""

    def run(batches):
        for batch in batches:
            for sources, n, packed, upper in zip(*(batch.column(c).to_pylist() for c in ("source", "n", "nodes", "upper")), strict=True):
                hexes = [packed[k : k + 32].hex() for k in range(0, len(packed), 32)]
                tree = collapse(hexes, min(levels, levels_of(n)))
                proofs = [[{"before": b, "after": a} for b, a in siblings(tree, i)] + upper for i in range(len(hexes))]
                yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(hexes), pa.array(proofs, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))], ["key", "subroot", "upper"])

    return run


def _verified(levels: int) -> Callable:
    """Of the lowest bucket rows: each row's proof, and the root that its (tampered, else own) leaf leads to."""

    def run(batches):
        for batch in batches:
            for source, n, packed, ids, changed, upper, subroot, root in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "nodes", "doc_id", "changed", "upper", "subroot", "top")), strict=True):
                hexes = [packed[k : k + 32].hex() for k in range(0, len(packed), 32)]
                tree = collapse(hexes, min(levels, levels_of(n)))
                above = [(p["before"], p["after"]) for p in upper]
                tail, known = "".join(b + a for b, a in above), {}  # folds of what buckets lead to; all good leaves share one
                proofs, roots = [], []
                for i, (node, other) in enumerate(zip(hexes, changed, strict=True)):
                    below = siblings(tree, i)
                    proofs.append(digest(*(b + a for b, a in below), tail))
                    end = fold(node if other is None else bytes(other).hex(), below)
                    if end not in known:
                        known[end] = fold(end, above)
                    roots.append(known[end])
                full = lambda v, m=len(hexes): pa.array([v] * m, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), full(source), pa.array(hexes), full(subroot), full(root), pa.array(proofs), pa.array(roots), pa.array([r == root for r in roots])], ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents")).drop("source")


#: The same rows in plain SQL: trees level by level, then proofs folded level by level.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384::BIGINT) ELSE d // 2 END)), 4294967295::BIGINT)"""
_SQL_FIELD = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
_SQL_LEAF = lambda text: "sha256(" + " || ".join(_SQL_FIELD(text if c == "text" else c) for c in FIELDS) + ")"
_UP = lambda of: f"""SELECT level + 1, tree, i // 16, sha256(string_agg(h, '' ORDER BY i)), max(n)
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n_now FROM {of}) q WHERE n_now > 1 GROUP BY level, tree, i // 16"""  # noqa: E731
OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, * FROM documents),
v AS (SELECT r, doc_id, coalesce('s' || source, '') AS tree, {_SQL_LEAF('text')} AS leaf,
        CASE WHEN doc_id IS NOT NULL AND {_CRC} % 5 = 0 THEN {_SQL_LEAF(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS changed FROM d),
w AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i FROM v),
a(level, tree, i, h, n) AS (SELECT 0, tree, i, leaf, 0 FROM w UNION ALL {_UP('a')}),
s AS (SELECT tree, max_by(h, level) AS subroot, row_number() OVER (ORDER BY tree) - 1 AS k, max(level) AS height FROM a GROUP BY tree),
b(level, tree, i, h, n) AS (SELECT 0, '', k, subroot, 0 FROM s UNION ALL {_UP('b')}),
t AS (SELECT max_by(h, level) AS root, max(level) AS top FROM b),
g AS (SELECT level, tree, i // 16 AS run, list(h ORDER BY i) AS hs FROM a GROUP BY ALL),
u AS (SELECT level, i // 16 AS run, list(h ORDER BY i) AS hs FROM b GROUP BY ALL),
p(r, step, node, proof) AS (SELECT r, 0, coalesce(changed, leaf), '' FROM w
  UNION ALL SELECT p.r, step + 1,
    sha256(array_to_string(hs[1:pos], '') || node || array_to_string(hs[pos + 2:], '')),
    proof || array_to_string(hs[1:pos], '') || array_to_string(hs[pos + 2:], '')
  FROM (SELECT p.r, step, node, proof, CASE WHEN step < height THEN g.hs ELSE u.hs END AS hs,
      CASE WHEN step < height THEN (w.i // (16 ** step)::BIGINT) % 16 ELSE (k // (16 ** greatest(step - height, 0))::BIGINT) % 16 END AS pos
    FROM p JOIN w USING (r) JOIN s USING (tree) CROSS JOIN t
    LEFT JOIN g ON g.level = step AND g.tree = s.tree AND g.run = w.i // (16 ** (step + 1))::BIGINT AND step < height
    LEFT JOIN u ON u.level = step - height AND u.run = k // (16 ** greatest(step - height + 1, 0))::BIGINT AND step >= height
    WHERE step < height + top) p)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM p JOIN w USING (r) JOIN s USING (tree) CROSS JOIN t WHERE step = height + top
"""

QUERIES = {"op11_merkle": op11_merkle}
SQL = {"op11_merkle": OP11_SQL}
