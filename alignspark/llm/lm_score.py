"""Language-model scores: smoothed word counts of the corpus, and marginals over the subword segmentations of a lattice.

Every word's lattice holds all its segmentations into the pieces of an existing vocabulary; a forward recursion in log space
sums them.  The pieces' weights begin with the vocabulary's own scores (merge ranks are made probabilities by Zipf's law
over the rank) and are then fitted to the training documents by expectation-maximisation: forward and backward recursions
over every distinct training word give how often each piece is expected, over all segmentations and as often as the word
occurs; these counts, summed over tasks, are the next weights.  ROUNDS rounds are made: most of the gain is in the first.
Pieces begin words only with the blank mark, so a text's lattice is its words' lattices in a row; each
distinct word of the corpus is computed once.  Whether a text ends after a word is learned from the corpus: the share of
end tokens among the training tokens.

Word counts are gathered over all documents (their number grows with the corpus).  The HEAD_WORDS most frequent words at
most are broadcast; a document's other words meet the vocabulary table in a join.

Defined results: a null or empty text has one token, its end; a null doc_id is held out of training and not marked held
out; each row is a document, repeated rows too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignspark.llm.common import dropped, in_slices, least_count, rows_of, stored, table
from alignspark.llm.pieces import BLANK, Pieces, vocabulary

#: Characters from which a word advances in windows.
LONG = 512
#: Most words that are broadcast; distinct words that a task counts before it hands them on; shift of Zipf's law.
HEAD_WORDS, TASK_WORDS, ZIPF_SHIFT = 150_000, 200_000, 2.7
#: Rounds of expectation-maximisation, and what is added to each piece's expected count.
ROUNDS, SMOOTH = 1, 0.1


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis, keepdims=True)
    safe = np.where(np.isfinite(most), most, 0.0)
    with np.errstate(divide="ignore"):
        return (np.log(np.exp(x - safe).sum(axis, keepdims=True)) + safe).squeeze(axis)


class Lattice:
    """log10 marginal probabilities of words under a vocabulary."""

    def __init__(self, pieces: Pieces, logp: np.ndarray | None = None) -> None:
        """logp: log weights of the pieces; without them, those of the vocabulary's scores."""
        self.pieces = pieces
        if logp is not None:
            self.logp = logp
            return
        normal = np.zeros(len(pieces.pieces), bool)
        normal[list(pieces.by_piece.values())] = True
        if pieces.ranked:
            rank = np.empty(len(normal))
            rank[np.argsort(-np.where(normal, pieces.scores, -np.inf), kind="stable")] = np.arange(len(normal))
            weight = -np.log(rank + ZIPF_SHIFT)
        else:
            weight = np.where(normal, pieces.scores, pieces.scores.min() - 10)
        self.logp = weight - np.logaddexp.reduce(weight)

    def words(self, words: list[str]) -> list[float]:
        """log10 of the probability of each word (without its blank mark); equal lengths advance together."""
        out = np.zeros(len(words))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) >= LONG:
                out[i] = self.long(BLANK + w)
            else:
                by_length.setdefault(len(w) + 1, []).append(i)
        for length, rows in by_length.items():
            together = max(1, 400_000 // (length + 1))
            for k in range(0, len(rows), together):
                part = rows[k : k + together]
                codes = np.frombuffer("".join(BLANK + words[i] for i in part).encode("utf-32-le"), "<u4").reshape(-1, length)
                out[part] = self._forward(codes.astype(np.uint64))
        return (out / math.log(10)).tolist()

    def long(self, text: str, window: int = 256, windows: int = 256) -> float:
        """Log of the probability of one long text: windows advance together, then join in their order.

        What a window does is a matrix: from the alphas of the characters before it, as far as a piece reaches, to those
        at its end.
        """
        reach = self.pieces.longest
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
        state = np.full(reach, -np.inf)
        state[0] = 0.0
        before = codes[:0]
        for begin in range(0, len(codes), window * windows):
            own = codes[begin : begin + window * windows]
            ways = self._ways(before, own)
            before = np.r_[before, own][-reach:]
            whole = len(own) // window * window
            for matrix in self._matrices(ways[:whole].reshape(-1, window, reach)):
                state = log_sum(state[:, None] + matrix, 0)
            for row in ways[whole:]:
                state = np.r_[log_sum(state + row, 0), state[:-1]]
        return float(state[0])

    def _ways(self, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For each character of own and each length up to the longest: the log weight of the piece of this length that ends there."""
        pieces = self.pieces
        both = np.r_[before, own]
        hashes, powers = pieces.prefix_hashes(both[None, :])
        hashes, ends = hashes[0], np.arange(len(before) + 1, len(both) + 1)
        out = np.full((len(own), pieces.longest), -np.inf)
        for size in range(1, min(pieces.longest, len(both)) + 1):
            rows = np.flatnonzero(ends >= size)
            ids = pieces.find(hashes[ends[rows]] - hashes[ends[rows] - size] * powers[size])
            out[rows, size - 1] = np.where(ids >= 0, self.logp[ids], -np.inf)
            if size == 1:  # a character without a piece: its bytes
                for r in rows[ids < 0].tolist():
                    out[r, 0] = self.logp[pieces.byte_ids[list(chr(int(own[r])).encode())]].sum()
        return out

    @staticmethod
    def _matrices(ways: np.ndarray) -> np.ndarray:
        """ways: windows x characters x lengths.  Each window's matrix of log weights."""
        n, window, reach = ways.shape
        state = np.broadcast_to(np.where(np.eye(reach) > 0, 0.0, -np.inf), (n, reach, reach))
        for t in range(window):
            state = np.concatenate([log_sum(state + ways[:, t, None, :], 2)[:, :, None], state[:, :, :-1]], 2)
        return state

    def expected(self, words: list[str], times: list[int]) -> np.ndarray:
        """How often each piece is expected in words that occur times, over all their segmentations.

        Words longer than LONG count as parts of that length.
        """
        out = np.zeros(len(self.logp))
        by_length: dict[int, list[tuple[str, int]]] = {}
        for word, n in zip(words, times, strict=True):
            text = BLANK + word
            for i in range(0, len(text), LONG):
                by_length.setdefault(len(text[i : i + LONG]), []).append((text[i : i + LONG], n))
        for length, rows in by_length.items():
            together = max(1, 200_000 // length)
            for k in range(0, len(rows), together):
                part = rows[k : k + together]
                codes = np.frombuffer("".join(w for w, _ in part).encode("utf-32-le"), "<u4").reshape(-1, length)
                self._expect(codes.astype(np.uint64), np.array([n for _, n in part], float), out)
        return out

    def _expect(self, words: np.ndarray, times: np.ndarray, out: np.ndarray) -> None:
        """Adds what is expected in words of one length: forward, then backward over the same pieces."""
        n, length = words.shape
        pieces, logp = self.pieces, np.append(self.logp, -np.inf)
        hashes, powers = pieces.prefix_hashes(words)
        raw = lambda r, j: pieces.byte_ids[list(chr(int(words[r, j - 1])).encode())]  # a character without a piece
        alpha, beta, ways = np.full((n, length + 1), -np.inf), np.full((n, length + 1), -np.inf), []
        alpha[:, 0] = beta[:, length] = 0.0
        for j in range(1, length + 1):
            first = max(0, j - pieces.longest)
            ids = np.stack([pieces.find(hashes[:, j] - hashes[:, i] * powers[j - i]) for i in range(first, j)], 1)
            weight = logp[ids]
            for r in np.flatnonzero(ids[:, -1] < 0).tolist():
                weight[r, -1] = self.logp[raw(r, j)].sum()
            ways.append((first, ids, weight))
            alpha[:, j] = log_sum(alpha[:, first:j] + weight, 1)
        total = alpha[:, length]
        for j in range(length, 0, -1):
            first, ids, weight = ways[j - 1]
            go = weight + beta[:, j : j + 1]
            beta[:, first:j] = np.logaddexp(beta[:, first:j], go)
            share = np.exp(alpha[:, first:j] + go - total[:, None]) * times[:, None]
            known = ids >= 0
            out += np.bincount(ids[known], share[known], len(out))
            for r in np.flatnonzero(~known[:, -1]).tolist():
                np.add.at(out, raw(r, j), share[r, -1])

    def _forward(self, words: np.ndarray) -> np.ndarray:
        n, length = words.shape
        pieces = self.pieces
        hashes, powers = pieces.prefix_hashes(words)
        alpha = np.full((n, length + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, length + 1):
            first = max(0, j - pieces.longest)
            ways = np.full((n, j - first), -np.inf)
            for i in range(first, j):
                ids = pieces.find(hashes[:, j] - hashes[:, i] * powers[j - i])
                known = ids >= 0
                ways[known, i - first] = alpha[known, i] + self.logp[ids[known]]
                if j - i == 1 and not known.all():  # a character without a piece: its bytes
                    for r in np.flatnonzero(~known).tolist():
                        ways[r, i - first] = alpha[r, i] + self.logp[pieces.byte_ids[list(chr(int(words[r, i])).encode())]].sum()
            most = ways.max(1)
            alpha[:, j] = most + np.log(np.exp(ways - most[:, None]).sum(1))
        return alpha[:, length]


def trains(column: str = "doc_id") -> F.Column:
    """Whether a document is learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 7 != 2, F.lit(False))


def word_counts(documents: DataFrame) -> DataFrame:
    """word (bytes, A-Z lower-cased), c (times in training texts), n (times in all texts)."""

    def run(batches):
        own: tuple[Counter, Counter] = (Counter(), Counter())

        def give():
            words = list(own[0].keys() | own[1].keys())
            c = [own[1][w] for w in words]
            n = [own[0][w] + k for w, k in zip(words, c, strict=True)]
            for o in own:
                o.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], ["word", "c", "n"])

        for part in in_slices(batches, "text", 4 << 20):
            for text, train in zip(part.column("text").to_pylist(), part.column("train").to_pylist(), strict=True):
                if text:
                    own[train].update(text.encode().lower().split())
            if len(own[0]) + len(own[1]) > TASK_WORDS:
                yield give()
        yield give()

    counted = rows_of(documents.select("text", trains().alias("train")), run, "word binary, c long, n long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fitted(counts: DataFrame, pieces: Pieces, rounds: int = ROUNDS) -> Lattice:
    """The lattice whose weights are fitted to the training words of counts (word, c); the vocabulary's own where there are none.

    Of a round only a number for each piece comes to the driver.
    """
    spark, lattice = counts.sparkSession, Lattice(pieces)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(lattice)

        def run(batches, sent=sent):
            out = np.zeros(len(sent.value.logp))
            for batch in batches:
                for begin in range(0, batch.num_rows, 20_000):
                    part = batch.slice(begin, 20_000)
                    out += sent.value.expected([w.decode() for w in part.column("word").to_pylist()], part.column("c").to_pylist())
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], ["piece", "n"])

        found = rows_of(counts.where("c > 0").select("word", "c"), run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        if not len(found):
            break
        n = np.full(len(lattice.logp), SMOOTH)
        n[found["piece"].to_numpy()] += found["n"].to_numpy()
        lattice = Lattice(pieces, np.log(n / n.sum()))
        sent.unpersist()
    return lattice


def with_lattice(counts: DataFrame, sent) -> DataFrame:
    """counts with lp, each word's log10 marginal."""

    def run(batches):
        lattice = sent.value
        for batch in batches:
            lp = lattice.words([w.decode() for w in batch.column("word").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp, pa.float64())], ["word", "c", "n", "lp"])

    return rows_of(counts.select("word", "c", "n"), run, "word binary, c long, n long, lp double")


def head_words(words: DataFrame, most: int = HEAD_WORDS) -> tuple[int, dict[bytes, tuple[int, float]]]:
    """The least count above which at most `most` words lie, and those words' c and lp."""
    least = least_count(words, "n", most)
    rows = words.where(F.col("n") >= least).select("word", "c", "lp").toArrow()
    return least, dict(zip(rows["word"].to_pylist(), zip(rows["c"].to_pylist(), rows["lp"].to_pylist(), strict=True), strict=True))


def score_documents(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = documents.sparkSession
    counts = stored(word_counts(documents), "counts")
    lattice = spark.sparkContext.broadcast(fitted(counts, Pieces(path)))
    words = stored(with_lattice(counts, lattice), "words")
    dropped(counts)
    totals = words.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    ends = documents.where(trains()).count()
    train_tokens, distinct = (totals["n"] or 0) + ends, (totals["v"] or 0) + (ends > 0)
    log_all = math.log10(train_tokens + distinct + 1)
    p_end = (ends + 1) / (train_tokens + 2)
    log_on, log_end = math.log10(1 - p_end), math.log10(p_end)
    least, head = head_words(words)
    sent = spark.sparkContext.broadcast({w: (math.log10(c + 1) - log_all, lp + log_on, c > 0) for w, (c, lp) in head.items()})
    at_end = (math.log10(ends + 1) - log_all, log_end, int(ends > 0))

    def run(batches):
        row = (TaskContext.get().partitionId() << 40) - 1
        head = sent.value
        for part in in_slices(batches, "text", 4 << 20):
            found = []
            for text in part.column("text").to_pylist():
                row += 1
                tokens = (text or "").encode().lower().split()
                values = list(map(head.get, tokens))
                tail: Counter = Counter()
                if None in values:
                    tail.update(t for t, v in zip(tokens, values, strict=True) if v is None)
                    values = [v for v in values if v is not None]
                base, score, known = map(math.fsum, zip(*values, strict=True)) if values else (0.0, 0.0, 0)
                found.append((row, len(tokens) + 1, base + at_end[0], score + at_end[1], int(known) + at_end[2], list(tail), list(tail.values())))
            columns = list(zip(*found, strict=True))
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "held_out", "row", "n_tokens", "base", "score", "known", "tail", "times"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    schema = "doc_id long, held_out boolean, row long, n_tokens long, base double, score double, known long, tail array<binary>, times array<int>"
    parts = stored(rows_of(documents.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text"), run, schema), "parts")
    tail = parts.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.times").alias("k"))
    rare = words.where(F.col("n") < least)
    known = tail.join(rare, "word").select(
        "row", (F.col("k") * (F.log10(F.col("c") + 1) - log_all)).alias("base"), (F.col("k") * (F.col("lp") + log_on)).alias("score"), F.when(F.col("c") > 0, F.col("k")).otherwise(0).cast("long").alias("known")
    )
    both = parts.select("row", "doc_id", "held_out", "n_tokens", "base", "score", "known").unionByName(
        known.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("long").alias("n_tokens"), "base", "score", "known")
    )
    total = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return total.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), vocabulary())


QUERIES = {"op8_lm_score": op8_lm_score}
SQL: dict[str, str] = {}
