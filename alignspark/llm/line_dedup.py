"""Line dedup over levelled sorted runs of line hashes.

A LineRuns store holds sorted runs (key hash, documents that have the line), each a table bucketed and sorted by key in the
shared folder, all with the same buckets.  A new batch of documents is reduced to its distinct keys and merge-anti-joined,
bucket by bucket, with the keys that single runs already settle as frequent; its remaining counts become a new run of
level 0.  When a level holds `fanout` runs they are compacted, two by two, into one run of the next level by full outer
merge joins that add counts.  At the end the same joins of what runs are left give the frequent keys exactly.  Only a
batch's own counts are shuffled: in joins of tables with equal buckets nothing is exchanged (a union of them would put
bucket behind bucket instead of together).  Keys are 128-bit hashes.

A store with a folder of its own keeps a list of its runs there, so that a later session opens it and adds further batches.

Defined results: a null or empty text is one empty line; keys of no code points are never dropped; each row is a document,
repeated rows too; a null doc_id is an id like others; an empty table gives no rows; other columns are ignored by
dedup_lines and kept by the pipeline's stage.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignspark.llm.common import SPACE, delete, dropped, exists, in_slices, kept, looked_up, read_text, rows_of, setting, shared_dir, stored, table, write_text

#: The production parameters of the query and of the pipeline's stage.
LEAST_DOCUMENTS = 10
#: Batches at least (the third begins a level anew, so levels are compacted at every size), and bytes of hashes in one (about).
BATCHES, BATCH_BYTES = 3, 64 << 30
#: Buckets of a run at least, and bytes of hashes of all documents for each (about); the session's shuffle partitions at most.
LEAST_BUCKETS, BUCKET_BYTES = 6, 8 << 20
#: Most frequent keys that are sent to all tasks as one set (about 6 MB); counted first.
SET_KEYS = 100_000
GONE = "_alignspark_gone"


def key_hash(line: str) -> bytes | None:
    """16 bytes for the line's key (ends stripped, A-Z lower-cased), None for an empty key."""
    key = line.strip(SPACE)
    return xxhash.xxh3_128_digest(key.encode("utf-8").lower()) if key else None


def line_keys(documents: DataFrame) -> DataFrame:
    """doc_id, h: each row's distinct line keys."""

    def run(parts):
        for part in in_slices(parts, "text"):
            owner, hashes = [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                if text:
                    own = {h for line in text.split("\n") if (h := key_hash(line))}
                    hashes.extend(own)
                    owner += [i] * len(own)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner, pa.int32())), pa.array(hashes, pa.binary())], ["doc_id", "h"])

    return rows_of(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, h binary")


class LineRuns:
    """The levelled runs.  frequent() may be asked after any batch; the store lives until close().

    at: a folder that driver and executors see, for a store that outlives the session; what it holds already is opened.
    buckets: of each run, the session's shuffle partitions unless given; fewer make fewer files.
    """

    def __init__(self, spark: SparkSession, least: int, fanout: int = 2, at: str | None = None, buckets: int | None = None) -> None:
        self.spark, self.least, self.fanout, self.at = spark, least, fanout, at
        partitions = spark.conf.get("spark.sql.shuffle.partitions")
        with setting(spark, "spark.sql.shuffle.partitions", str(buckets or partitions)):  # a batch's counts are dealt as the runs are
            self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self._between: list[str] = []  # written within a merge; they go with the next one
        if at and exists(spark, f"{at}/runs.json"):
            held = json.loads(read_text(spark, f"{at}/runs.json"))
            self.buckets, self.levels = held["buckets"], held["levels"]
            for run in self.runs:
                spark.sql(f"CREATE TABLE IF NOT EXISTS {run} (h BINARY, n BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{at}/{run}'")

    @property
    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        """One batch of keys (h: one row for each document that has the line), then compaction of the levels it fills."""
        with setting(self.spark, "spark.sql.shuffle.partitions", str(self.buckets)):
            counts = keys.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
            for run in self.runs:  # as outer joins: an anti-join would be pushed below the counts, before hot lines are combined
                settled = self.spark.table(run).where(F.col("n") >= self.least).select("h", F.lit(True).alias("settled"))
                counts = counts.join(settled.hint("merge"), "h", "left").where("settled IS NULL").select("h", "n")
            self.levels[0].append(self._written(counts))
        gone, level = [], 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level + 1].append(self._written(self._merged(old)))
            gone += old
            level += 1
        self._list()
        self._forget(gone)

    def frequent(self) -> DataFrame:
        """Keys that at least `least` documents of the batches so far have."""
        return self._merged(self.runs).where(F.col("n") >= self.least).select("h")

    def close(self) -> None:
        """Delete the store."""
        runs, self.levels = [*self.runs, *self._between], [[]]
        self._list()
        self._forget(runs)

    def _merged(self, runs: list[str]) -> DataFrame:
        """The runs' counts, added by key: a full outer merge join of equal buckets, two tables at a time.

        An outer join's result has no known partitioning, so what is joined once more is written in between.
        """
        self._forget(self._between)
        self._between, waiting = [], list(runs)
        while len(waiting) > 2:
            waiting.append(self._written(self._both(*waiting[:2])))
            self._between.append(waiting[-1])
            waiting = waiting[2:]
        return self._both(*waiting) if len(waiting) == 2 else self.spark.table(waiting[0])

    def _both(self, one: str, two: str) -> DataFrame:
        left, right = self.spark.table(one), self.spark.table(two).withColumnRenamed("n", "m")
        added = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
        return left.join(right.hint("merge"), "h", "full").select("h", added.alias("n"))

    def _written(self, counts: DataFrame) -> str:
        name = f"alignspark_run_{uuid.uuid4().hex}"
        counts.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self._folder}/{name}").saveAsTable(name)
        return name

    @property
    def _folder(self) -> str:
        return self.at or shared_dir(self.spark)

    def _list(self) -> None:
        """The store's runs as they are now; written before old runs go, so a stop in between loses none."""
        if self.at:
            write_text(self.spark, f"{self.at}/runs.json", json.dumps({"buckets": self.buckets, "levels": self.levels}))

    def _forget(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
            delete(self.spark, f"{self._folder}/{run}")


def frequent_keys(documents: DataFrame, least: int, fanout: int = 2) -> tuple[DataFrame, DataFrame]:
    """The written table of frequent keys (h), and what was held of line_keys (let go of it by dropped()).

    Documents are dealt to batches of about BATCH_BYTES of hashes, BATCHES at least.
    """
    keys = kept(line_keys(documents))
    spark, size = documents.sparkSession, keys._rows * 16
    batches = max(BATCHES, -(-size // BATCH_BYTES))
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)))
    runs = LineRuns(spark, least, fanout, buckets=buckets)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    for i in range(batches):
        runs.add(keys.where(batch == i).select("h"))
    frequent = stored(runs.frequent(), "frequent")
    runs.close()
    return frequent, keys


class Losses(NamedTuple):
    """documents, and where their frequent keys are: all in one broadcast set, or each row's own in the column GONE."""

    documents: DataFrame
    every: Broadcast | None

    def of(self, part: pa.RecordBatch) -> list:
        """For each row of a batch: the frequent keys that its text may have."""
        return [self.every.value] * part.num_rows if self.every else part.column(GONE).to_pylist()


def losses(documents: DataFrame, least: int) -> Losses:
    """Up to SET_KEYS frequent keys (counted) are sent to all tasks, and documents aren't shuffled; more are joined by document."""
    frequent, keys = frequent_keys(documents, least)
    if frequent.count() <= SET_KEYS:
        every = frozenset(map(bytes, frequent.toArrow()["h"].to_pylist()))
        dropped(keys, frequent)
        return Losses(documents, documents.sparkSession.sparkContext.broadcast(every))
    hit = looked_up(keys.select("doc_id", "h"), frequent, "h", F.col("doc_id"))
    gone = stored(hit.groupBy(F.col("doc_id").alias("_alignspark_id")).agg(F.collect_set("h").alias(GONE)), "gone")
    dropped(keys, frequent)
    both = documents.join(gone.hint("merge"), documents["doc_id"].cast("long").eqNullSafe(gone["_alignspark_id"]), "left")
    return Losses(both.drop("_alignspark_id"), None)


def kept_text(text: str | None, gone: Collection[bytes] | None) -> tuple[str, int, int]:
    """The text without its frequent lines, the lines it had and the lines it lost."""
    lines = (text or "").split("\n")
    if not gone:
        return text or "", len(lines), 0
    frequent = gone if isinstance(gone, frozenset) else set(gone)
    kept = [line for line in lines if key_hash(line) not in frequent]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, kept (the text that stays), n_lines, n_dropped for every row."""
    found = losses(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), least)
    sent = found._replace(documents=None)

    def run(batches):
        for part in in_slices(batches, "text"):
            rows = [kept_text(t, g) for t, g in zip(part.column("text").to_pylist(), sent.of(part), strict=True)]
            kept, had, lost = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(kept, pa.string()), pa.array(had, pa.int64()), pa.array(lost, pa.int64())], ["doc_id", "kept", "n_lines", "n_dropped"])

    return rows_of(found.documents, run, "doc_id long, kept string, n_lines long, n_dropped long")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, without the lines that LEAST_DOCUMENTS or more documents have; null texts stay null."""
    names, found = docs.columns, losses(docs, LEAST_DOCUMENTS)
    sent = found._replace(documents=None)

    def run(batches):
        for part in in_slices(batches, "text"):
            texts = [t if t is None else kept_text(t, g)[0] for t, g in zip(part.column("text").to_pylist(), sent.of(part), strict=True)]
            new = pa.array(texts, pa.string())
            columns = {n: part.column(n) for n in names} | {"text": new, "n_chars": pc.cast(pc.utf8_length(new), part.schema.field("n_chars").type)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows_of(found.documents, run, docs.schema)


#: The same rows in plain SQL.
_STRIP = r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT r, pos, line, translate({_STRIP}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
f AS (SELECT k FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
s AS (SELECT r, count(*) AS n_lines, count(f.k) AS n_dropped,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.k IS NULL), '') AS kept
      FROM k LEFT JOIN f USING (k) GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN s USING (r)
"""

QUERIES = {"op3_line_dedup": op3_line_dedup}
SQL = {"op3_line_dedup": OP3_SQL}
