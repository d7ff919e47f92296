"""Jaccard join of documents' word n-gram sets: size-aware and heavy-light, exact.

Copies (equal sets) become one class.  All classes order their shingles alike, the rare ones first (a bounded table of
frequent shingles, found by counting within tasks, only shapes that order; any order gives the same links).  Two sets with
overlap o share one of the first n - o + 1 shingles of each, and two of the first n - o + 2.  Small sets are joined by
enumerating the 2-subsets of their prefix; large sets by scanning the inverted lists of single prefix shingles, in which
small sets stand too if a large one can reach them.  The boundary is the size with the least total cost, from the
histogram of sizes and the mean length of a list.

A list is never paired with itself as a whole: each list has a leader (the set with the fewest rare shingles, the hub of
near copies), and first each set meets only the best of its lists' leaders; then sets of a list that are still in different
components meet, if sizes and positions allow a link, a long list in pairs of blocks that many tasks share.  Sets in one
component need not meet: links are wanted as components.  Keys that no other set has make no list: where the lists are too
many to be broadcast, a sieve of their keys (bits, so bounded; it lets some others pass) keeps most of the rest from being
shuffled to them.  Candidates whose parity maps differ in more cells than the sets of
a link can differ in shingles go; the others are verified exactly on whole sets.  Shingles and classes are 64-bit hashes.

Defined results: a null or blank text has an empty set and links with nothing; a text with fewer words than a shingle is
one shingle; repeated rows are copies; a null doc_id takes part and can't be a component's id; an empty table gives no
rows; other columns are ignored by join_documents and kept by the pipeline's stage.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from alignspark.llm.common import components, dropped, in_slices, least_count, kept, looked_up, rows_of, small_enough, stored, table

#: Most frequent shingles, and keys of lists with several sets, that are broadcast (eight bytes each; their number is counted first).
FREQUENT, LISTS = 300_000, 1_000_000
#: Words and shingles that a task holds at once.
WORDS, HELD = 100_000, 1_500_000
#: Bits of the sieve for each list key, the logarithms of a segment's and of the most bits in all (64 MB).
SIEVE_BITS, SEGMENT, SIEVE_MOST = 16, 16, 29
#: Sets of a list's block: longer lists are compared in pairs of blocks.
LIST_BLOCK = 1024
#: A shingle is frequent from so many sets on, and counts in a task from so many on.
OFTEN, OFTEN_IN_TASK = 8, 4
#: Longs of the parity map that joins compare.
WIDE = 4
_MULTIPLY, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Words(dict):
    """Hash of each word; words are kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    half = np.uint64(32)
    x = (x ^ (x >> half)) * _MIX
    x = (x ^ (x >> half)) * _MIX
    return x ^ (x >> half)


def shingles(text: str | None, words: Words, k: int) -> np.ndarray:
    """The sorted hashes of the text's distinct k-word shingles."""
    own = text.encode().lower().split() if text else []
    hashed = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
    m = len(hashed) - k + 1
    if m <= 0:
        return mix(np.array([xxhash.xxh3_64_intdigest(hashed.tobytes())], np.uint64)) if len(hashed) else hashed
    h = hashed[:m]
    for i in range(1, k):
        h = mix(h * _MULTIPLY + hashed[i : m + i])
    return np.unique(h)


def class_of(own: np.ndarray) -> int:
    """63-bit id of a set."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) >> 1


def parity(own: np.ndarray) -> bytes:
    """A bit for each of about twice as many cells as the set has shingles: whether an odd number falls into the cell."""
    cells = 64 << max(0, (len(own) // 32).bit_length())
    return np.packbits(np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


def folded(own: np.ndarray) -> np.ndarray:
    """The parity of WIDE * 64 cells as WIDE longs, to be compared within a join."""
    return np.packbits(np.bincount((own & np.uint64(64 * WIDE - 1)).astype(np.int64), minlength=64 * WIDE) & 1, bitorder="little").view(np.int64)


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the shingles that are in one of two sets only: cells of different parity (a wider map is folded)."""
    a, b = (np.frombuffer(v, np.uint64) for v in (x, y))
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def prefix_size(n: int, t: int) -> int:
    """Shingles of a set of n of which a linked set (100 * overlap >= t * union) has one at least."""
    return n - -(-t * n // 100) + 1


def frequent_shingles(documents: DataFrame, k: int) -> DataFrame:
    """h, n: shingles that are in OFTEN sets or more, by counts within tasks (those seen less often in a task may miss)."""

    def run(batches):
        words, seen, held, size = Words(), set(), [], 0

        def give():
            every = np.concatenate([*held, np.zeros(0, np.uint64)])
            held.clear()
            every.sort()
            far = OFTEN_IN_TASK - 1
            h = np.unique(every[far:][every[far:] == every[:-far]])
            n = np.searchsorted(every, h, "right") - np.searchsorted(every, h)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for part in in_slices(batches, "text"):
            for text in part.column("text").to_pylist():
                own = shingles(text, words, k)
                if len(own) and (c := class_of(own)) not in seen:
                    seen.add(c)
                    held.append(own)
                    size += len(own)
                if size > HELD:
                    yield give()
                    seen.clear()
                    size = 0
        yield give()

    counted = rows_of(documents.select("text"), run, "h long, n long")
    return counted.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


def classify(documents: DataFrame, k: int, t: int) -> DataFrame:
    """row, doc_id, class, n (size of the set), prefix (its first shingles in the common order, one more than a link needs), bits and fold (parity maps)."""
    spark = documents.sparkSession
    often = kept(frequent_shingles(documents, k))
    top = often.where(F.col("n") >= least_count(often, "n", FREQUENT)).toArrow()
    order = np.argsort(top["h"].to_numpy().view(np.uint64))
    sent = spark.sparkContext.broadcast((top["h"].to_numpy().view(np.uint64)[order], top["n"].to_numpy()[order]))
    dropped(often)

    def run(batches):
        words, row = Words(), (TaskContext.get().partitionId() << 40) - 1
        known, count = sent.value
        for part in in_slices(batches, "text"):
            rows = []
            for text in part.column("text").to_pylist():
                row += 1
                own = shingles(text, words, k)
                size = prefix_size(len(own), t) + 1
                if len(known) and len(own):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    first = own[np.lexsort((own, np.where(known[at] == own, count[at], 0)))[:size]]
                else:
                    first = own[:size]
                rows.append((row, class_of(own) if len(own) else None, len(own), first.view(np.int64), parity(own), folded(own)))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())), strict=True)]
            yield pa.RecordBatch.from_arrays([columns[0], part.column("doc_id"), *columns[1:]], ["row", "doc_id", "class", "n", "prefix", "bits", "fold"])

    return rows_of(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "row long, doc_id long, class long, n long, prefix array<long>, bits binary, fold array<long>")


def boundary(sizes: dict[int, int], list_length: float, t: int) -> int:
    """Sets smaller than this are joined by 2-subsets: the choice with the least rows written and list entries read."""
    pairs, scans = {}, {}
    for n, sets in sizes.items():
        p = prefix_size(n, t)
        pairs[n], scans[n] = sets * math.comb(min(p + 1, n), 2), sets * p * (1 + list_length)
    best, cost = 2, sum(scans.values())
    now, order = cost, sorted(sizes)
    for n in order:
        now += pairs[n] - scans[n]  # all up to n are small
        reach = sum(sizes[m] * prefix_size(m, t) for m in order if t * (n + 1) <= 100 * m and m <= n)  # their singles beside
        if n >= 2 and now + reach < cost:
            best, cost = n + 1, now + reach
    return best


def _places(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A key's segment of the sieve and its two bits there; segments: the logarithm of their number.

    Prefixes begin with the least hashes, so the highest bits of keys are mostly small; they are left out.
    """
    bit = np.uint64((1 << SEGMENT) - 1)
    return tuple(x.astype(np.int64) for x in (h & np.uint64((1 << segments) - 1), (h >> np.uint64(SEGMENT)) & bit, (h >> np.uint64(2 * SEGMENT)) & bit))


def sieve(keys: DataFrame, rows: int) -> np.ndarray:
    """Segments of bits, two of which are set for each of the keys (column key, about `rows` of them); made segment by segment in tasks."""
    segments = min(SIEVE_MOST, max(SEGMENT, (SIEVE_BITS * rows).bit_length())) - SEGMENT

    def run(group: pa.Table) -> pa.Table:
        segment, *bits = _places(group["key"].to_numpy().view(np.uint64), segments)
        own = np.zeros(1 << SEGMENT, np.uint8)
        own[bits[0]] = own[bits[1]] = 1
        return pa.table({"segment": pa.array(segment[:1]), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()])})

    found = keys.select("key").groupBy(F.col("key").bitwiseAND((1 << segments) - 1)).applyInArrow(run, "segment long, bits binary").toArrow()
    out = np.zeros((1 << segments, 1 << (SEGMENT - 3)), np.uint8)
    for segment, bits in zip(found["segment"].to_pylist(), found["bits"], strict=True):
        out[segment] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out


def passes(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the sieve lets the keys pass: all it was made of, and few others."""
    segment, *both = _places(h, len(bits).bit_length() - 1)
    a, b = (bits[segment, x >> 3] >> (x & 7).astype(np.uint8) & 1 for x in both)
    return (a & b).astype(bool)


def _keys(classes: DataFrame, least_large: int, t: int, bits: Broadcast | None = None) -> DataFrame:
    """key, class, n, rest (what the set can still share from there on, itself included), large, for every list a set is in (that the sieve lets pass)."""

    def give(out: list, keys: np.ndarray, rest: np.ndarray, *of_set: int) -> None:
        if bits is not None:
            good = passes(keys, bits.value)
            keys, rest = keys[good], rest[good]
        if len(keys):
            out.append((keys, rest, *of_set))

    def run(batches):
        for part in batches:
            out = []
            prefixes = part.column("prefix")
            for c, n, p in zip(part.column("class").to_pylist(), part.column("n").to_pylist(), prefixes, strict=True):
                own = p.values.to_numpy().view(np.uint64)
                if n < least_large and n >= 2:
                    a, b = np.triu_indices(len(own), 1)
                    low, high = np.minimum(own[a], own[b]), np.maximum(own[a], own[b])
                    give(out, mix(low * _MULTIPLY + high), n - b + 1, c, n, 2)
                if n >= least_large or 100 * n >= t * least_large or n < 2:
                    single = own[: prefix_size(n, t)]
                    give(out, single, n - np.arange(len(single)), c, n, int(n >= least_large))
            if out:
                sizes = [len(o[0]) for o in out]
                wide = lambda i: np.repeat(np.array([o[i] for o in out], np.int64), sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([o[0] for o in out]).view(np.int64)), pa.array(wide(2)), pa.array(wide(3)), pa.array(np.concatenate([o[1] for o in out]).astype(np.int64)), pa.array(wide(4))],
                    ["key", "class", "n", "rest", "kind"],
                )

    return rows_of(classes.select("class", "n", "prefix"), run, "key long, class long, n long, rest long, kind long")


def _may_link(a: str, b: str, t: int) -> str:
    """Whether sizes and positions allow the link at the pair's first common shingle."""
    need = f"({100 + t} - 1 + {t} * ({a}.n + {b}.n)) div {100 + t}"
    return f"{t} * greatest({a}.n, {b}.n) <= 100 * least({a}.n, {b}.n) AND least({a}.rest, {b}.rest) >= {need}"


def _may_be_near(a: str, b: str, t: int) -> str:
    """Whether the parity maps differ in no more cells than a link's sets may in shingles."""
    differ = " + ".join(f"bit_count({a}.p{i} ^ {b}.p{i})" for i in range(WIDE))
    return f"{differ} <= {a}.n + {b}.n - 2 * (({100 + t} - 1 + {t} * ({a}.n + {b}.n)) div {100 + t})"


def _near(pairs: DataFrame, maps: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b) that the sets' parity maps (class, n, bits) leave possible; drops no pair that links."""
    left, right = (maps.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("a", "b"))

    def run(batches):
        for part in batches:
            good = []
            for n, m, x, y in zip(*(part.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")), strict=True):
                both = (n + m - least_difference(x, y)) // 2
                good.append(100 * both >= t * (n + m - both))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows_of(pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b"), run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b) of classes that link, by their whole sets."""
    left, right = sets.select(F.col("class").alias("a"), F.col("own").alias("x")), sets.select(F.col("class").alias("b"), F.col("own").alias("y"))

    def run(batches):
        for part in batches:
            good = []
            for x, y in zip(part.column("x"), part.column("y"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= t * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows_of(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, "a long, b long")


def _sets(documents: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """class, own (whole set) of the classes in wanted (class, doc_id); only their documents' texts are moved.

    Rows that repeat a document may give its set once for each task, which changes no link.
    """
    one = wanted.select(F.col("doc_id").alias("_id"), "class")
    docs = documents.select(F.col("doc_id").cast("long").alias("_doc"), "text")
    texts = docs.join(small_enough(one), F.col("_doc").eqNullSafe(F.col("_id"))).select("class", "text")

    def run(batches):
        words, seen = Words(), set()
        for part in in_slices(batches, "text"):
            rows = []
            for c, text in zip(part.column("class").to_pylist(), part.column("text").to_pylist(), strict=True):
                if c not in seen and len(own := shingles(text, words, k)) and class_of(own) == c:
                    seen.add(c)
                    rows.append((c, own.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["class", "own"])

    return rows_of(texts, run, "class long, own array<long>")


def _labelled(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """entries with their class's component."""
    return entries.join(small_enough(labels.withColumnRenamed("id", "class")), "class", "left").withColumn("component", F.coalesce("component", "class"))


def _across(entries: DataFrame, labels: DataFrame, mixed: DataFrame, maps: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b) of classes of one list but of different components that sizes, positions and parity maps leave possible.

    mixed: key and the number of blocks of each list with several components.  A row goes to each pair of blocks its own is
    in, so a list's work is shared by as many tasks as it has pairs of blocks.  Both sides of the join are one shuffle.
    """
    rest = _labelled(entries.join(small_enough(mixed, LISTS), "key"), labels)
    rest = rest.join(maps, "class").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    rest = rest.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rest = rest.withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with")).drop("with", "blocks")
    met = F.expr(f"x.key = y.key AND x.low = y.low AND x.high = y.high AND x.class < y.class AND (x.block <> y.block OR x.low = x.high) AND x.component <> y.component AND {_may_link('x', 'y', t)} AND {_may_be_near('x', 'y', t)}")
    return rest.alias("x").join(rest.alias("y").hint("merge"), met).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()


def grouped(documents: DataFrame, k: int, t: int) -> DataFrame:
    """doc_id, n, class, component (a class), component_id (least doc_id reachable by links) of every row; class and component are null for empty sets."""
    spark = documents.sparkSession
    rows = stored(classify(documents, k, t), "rows")
    members = rows.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("row", "doc_id", "n")).alias("one"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    members = stored(members.select("class", F.col("one.row").alias("row"), F.col("one.doc_id").alias("doc_id"), F.col("one.n").alias("n"), "least_id", "copies"), "classes")
    ones = members.where("copies > 1").select("class", F.col("row").alias("one"))
    copies = stored(looked_up(rows.select("row", "class"), ones, "class", F.col("row")).where("row <> one").select("row"), "copies")
    classes = rows.where("class IS NOT NULL").select("row", "class", "n", "prefix", "bits", "fold").join(small_enough(copies), "row", "left_anti")
    sizes = {r["n"]: r["k"] for r in members.groupBy(F.least("n", F.lit(4096)).alias("n")).agg(F.count(F.lit(1)).alias("k")).collect()}
    lists = classes.select(F.explode("prefix").alias("h")).agg(F.count("h").alias("all"), F.approx_count_distinct("h").alias("distinct")).first()
    least_large = boundary(sizes, lists["all"] / max(1, lists["distinct"]), t)
    keys = _keys(classes, least_large, t)
    several = kept(keys.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.max("kind").alias("kind")).where("sets > 1 AND kind > 0").select("key"))
    if several._rows <= LISTS:
        entries = keys.join(F.broadcast(several), "key", "left_semi")
    else:
        bits = spark.sparkContext.broadcast(sieve(several, several._rows))
        entries = _keys(classes, least_large, t, bits).join(several.hint("merge"), "key", "left_semi")
    entries = stored(entries.select("key", "class", F.col("n").cast("int").alias("n"), F.col("rest").cast("int").alias("rest")), "entries")
    dropped(several)

    leaders = entries.groupBy("key").agg(F.max(F.struct((F.col("rest") - F.col("n")).alias("early"), F.col("class"), F.col("n"), F.col("rest"))).alias("s")).select("key", F.col("s.class").alias("leader"), F.col("s.n").alias("n_"), F.col("s.rest").alias("rest_"))
    leaders = kept(leaders)
    star = entries.join(small_enough(leaders), "key").withColumn("x", F.struct("n", "rest")).withColumn("y", F.struct(F.col("n_").alias("n"), F.col("rest_").alias("rest")))
    star = star.where(f"class <> leader AND {_may_link('x', 'y', t)}")
    stars = star.groupBy("class").agg(F.max(F.struct((F.col("rest_") - F.col("n_")).alias("early"), "leader")).alias("s"))
    stars = stored(stars.select(F.least("class", "s.leader").alias("a"), F.greatest("class", "s.leader").alias("b")).distinct(), "stars")
    dropped(leaders)

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = stored(_near(pairs, classes.select("class", "n", "bits"), t), "near")
        wanted = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
        wanted = kept(members.join(wanted, "class").select("class", "doc_id"))
        sets = kept(_sets(documents, wanted, k))
        out = stored(_verified(pairs, sets, t), "links")
        dropped(sets, wanted, pairs)
        return out

    links = linked(stars)
    labels = components(links)
    now = _labelled(entries, labels)
    mixed = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count(F.lit(1)) / LIST_BLOCK).alias("blocks")).where("lo <> hi").select("key", "blocks")
    mixed = stored(mixed, "mixed")
    if not mixed.isEmpty():
        maps = classes.select(F.col("class"), *[F.col("fold")[i].alias(f"p{i}") for i in range(WIDE)])
        more = stored(_across(entries, labels, mixed, maps, t).join(stars, ["a", "b"], "left_anti"), "across")
        if not more.isEmpty():
            found = linked(more)
            if not found.isEmpty():
                labels = components(links.unionByName(found))
    named = members.join(labels.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = kept(named.groupBy("component").agg(F.min("least_id").alias("component_id"), F.sum("copies").alias("documents")).where("documents > 1").drop("documents"))
    wide = stored(looked_up(named.select("class", "component"), least, "component", F.col("class")).select("class", "component", "component_id"), "wide")
    dropped(members, copies, stars, mixed, least, entries)
    out = looked_up(rows.select("row", "doc_id", "n", "class"), wide, "class", F.col("row"), "left")
    out = out.select("doc_id", "n", "class", F.coalesce("component", "class").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out._reads = (rows, wide)
    return out


def join_documents(documents: DataFrame, k: int, t: int) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) of every row."""
    return grouped(documents, k, t).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"), 3, 90)


def one_of_each(docs: DataFrame, k: int, t: int) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the least doc_id (a null one comes last), all its columns.

    Rows are decided one by one: a row that shares its doc_id with others, or has none, is known by doc_id and set.  Of
    rows with equal doc_id and equal set any one stays; rows with an empty set all stay.
    """
    key, own = "_alignspark_id", "_alignspark_class"
    groups = grouped(docs, k, t)
    found = stored(groups, "groups")
    dropped(*groups._reads)
    first = found.where("class IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")).alias("s"))
    first = stored(first.select(F.col("s.doc_id").alias(key), F.col("s.class").alias(own)), "first")
    alone = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("class").alias("class"))
    alone = stored(alone.join(first, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col("class") == F.col(own)), "left").select("doc_id", "n", (F.col("class").isNotNull() & F.col(own).isNull()).alias("gone")), "ids")
    dropped(found)
    gone = alone.where("n = 1 AND gone AND doc_id IS NOT NULL").select(F.col("doc_id").alias(key))
    unclear = alone.where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias(key))
    rest = docs.join(small_enough(gone), docs["doc_id"].cast("long") == F.col(key), "left_anti")
    if unclear.isEmpty():
        return rest
    side, same = small_enough(unclear), docs["doc_id"].cast("long").eqNullSafe(F.col(key))

    def run(batches):
        words = Words()
        for part in in_slices(batches, "text"):
            sets = [shingles(x, words, k) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())], [*part.schema.names, own])

    marked = rows_of(rest.join(side, same, "left_semi"), run, StructType([*docs.schema.fields, StructField(own, LongType())]))
    several = marked.where(F.col(own).isNotNull()).dropDuplicates(["doc_id", own])
    winners = first.select(F.col(key), F.col(own).alias("_alignspark_first"))
    several = several.join(small_enough(winners), several["doc_id"].cast("long").eqNullSafe(winners[key]) & (several[own] == winners["_alignspark_first"]), "left_semi")
    return rest.join(side, same, "left_anti").unionByName(several.drop(own)).unionByName(marked.where(F.col(own).isNull()).drop(own))


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates (five-word shingles, similarity 0.8 or more) one document stays.

    See one_of_each for which; repeated and null ids, and empty texts, lose nothing but copies.
    """
    return one_of_each(docs, 5, 80)


QUERIES = {"op4_ngram_join": op4_ngram_join}
SQL: dict[str, str] = {}
