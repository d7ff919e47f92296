"""Toxicity by compression distance: zstandard dictionaries of ordinary and of toxic text, compared window by window.

A text is cut into windows of WINDOW words.  Each is compressed twice, with a dictionary trained on ordinary labelled text
and with that dictionary followed by segments trained on toxic text; what the second saves is the window's gain.  As both
share the ordinary part, a gain shows toxic segments and not how common the rest is.

Training (at the driver, on the bounded sample): in FOLDS folds, so that no text is judged by dictionaries that have seen
it.  First both sides are dictionaries of equal size trained by zstandard.  Windows of toxic texts whose gain is above
nearly all gains of ordinary texts are kept, in them the words whose removal loses the gain; such words, and beginnings
that inflected ones share, that recur in toxic texts, and far more often than in ordinary ones, become the toxic segments
of the next turn.  After TURNS turns the folds'
gains calibrate the thresholds: a logistic regression on how many windows pass them and by how much.

The sample takes SAMPLE_ROWS labelled texts of each label at most, by a hash of doc_id, and SAMPLE_BYTES of each label's
text.  Defined results: a null or empty text has no window and gets the score of that; without training texts of both
labels all scores are 0; a null doc_id is in no training set and not held out; a document with two different labels trains
as both; repeated rows get repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alignspark.llm.common import in_slices, rows_of, small_enough, table

#: Bounds of the sample: rows and bytes of text of each label.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 8 << 20
#: Words of a window; bytes of a first dictionary and of the toxic segments; folds and turns of the training.
WINDOW, DICTIONARY, SEGMENTS, FOLDS, TURNS = 6, 99_999, 3999, 4, 4
#: Share of ordinary windows that may gain more than a kept one; toxic texts that a segment recurs in at least, and share of them; standard deviations that its toxic texts are above what ordinary texts let expect.
RARE, RECURS, OFTEN, DEVIATIONS = 0.02, 3, 0.02, 3
#: Times that a segment's toxic texts are what ordinary texts let expect; bytes of a word's beginnings that are tried; share of a beginning's toxic texts from which on a longer form stands for it.
TIMES, BEGINNINGS, ALIKE = 3, (4, 5, 6, 7, 8), 0.9
#: Gains that a window must reach to be counted: in any case, and to be counted as a strong one.
SOME, STRONG = 2, 4
LEAST_SCORE = 0.7
#: zstandard's level, and the step at which it indexes short strings of a dictionary: segments begin at multiples of it.
LEVEL, STEP = 3, 3


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)]


class Compressor:
    """Lengths of windows compressed with a dictionary's content."""

    def __init__(self, content: bytes) -> None:
        content += b" " * 16  # the last bytes of a dictionary aren't indexed
        frame = {"format": zstandard.FORMAT_ZSTD1_MAGICLESS, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), source_size=64, **frame)
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=how)
        self.zstd = zstandard.ZstdCompressor(dict_data=held, compression_params=how)

    def lengths(self, windows: list[bytes], together: int = 20_000) -> np.ndarray:
        out = np.empty(len(windows), np.int32)
        for i in range(0, len(windows), together):
            done = self.zstd.multi_compress_to_buffer(windows[i : i + together])
            out[i : i + len(done)] = [len(done[k]) for k in range(len(done))]
        return out


class Pair(NamedTuple):
    ordinary: Compressor
    toxic: Compressor

    def gains(self, windows: list[bytes]) -> np.ndarray:
        return self.ordinary.lengths(windows) - self.toxic.lengths(windows)

    def carriers(self, windows: list[bytes]) -> list[bytes]:
        """The words of windows whose removal loses SOME of the window's gain."""
        cut, owner = [], []
        for window in windows:
            words = window.split()
            cut.append(window)
            owner.append(b"")
            for j, word in enumerate(words):
                cut.append(b" " + b" ".join(words[:j] + words[j + 1 :]) + b" ")
                owner.append(word)
        whole, out = 0, []
        for word, gain in zip(owner, self.gains(cut).tolist(), strict=True):
            if not word:
                whole = gain
            elif whole - gain >= SOME:
                out.append(word)
        return out


def aligned(content: bytes) -> bytes:
    """Filled up to a multiple of STEP bytes."""
    return content + b" " * (-len(content) % STEP)


def trained(texts: list[list[bytes]], size: int) -> bytes:
    """A dictionary that zstandard trains on texts (lists of words), or the texts themselves where they are too few for that."""
    samples = [w for words in texts for w in windows_of(words, 24)]
    try:
        return aligned(zstandard.train_dictionary(size, samples, k=32, d=8, level=LEVEL).as_bytes())
    except zstandard.ZstdError:
        return aligned(b"".join(samples)[-size:])


def measures(gains: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For texts whose windows begin at starts (the last entry: all windows): numbers that the calibration weighs."""
    out = np.zeros((len(starts) - 1, 5))
    out[:, 0] = 1.0
    rows = np.flatnonzero(starts[1:] > starts[:-1])
    if len(rows):
        at = starts[rows]
        some, strong = gains >= SOME, gains >= STRONG
        count = np.add.reduceat(some.astype(float), at)
        out[rows, 1] = np.log1p(count)
        out[rows, 2] = np.log1p(np.add.reduceat(strong.astype(float), at))
        out[rows, 3] = np.clip(np.maximum.reduceat(gains, at), 0, 16) / 8
        out[rows, 4] = np.add.reduceat(np.where(some, gains, 0).astype(float), at) / np.sqrt(starts[rows + 1] - at) / 4
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, turns: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's steps; the first weight (of the constant) isn't shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - shrink * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model(NamedTuple):
    """Contents of both dictionaries and the calibration's weights."""

    ordinary: bytes
    segments: bytes
    weights: np.ndarray

    def pair(self) -> Pair:
        return Pair(Compressor(self.ordinary), Compressor(self.ordinary + self.segments))


def _starts(windows: list[list[bytes]]) -> np.ndarray:
    return np.cumsum([0, *map(len, windows)])


def _forms(word: bytes) -> set[bytes]:
    """A word as a segment holds it, and its beginnings."""
    return {b" " + word + b" ", *(b" " + word[:k] for k in BEGINNINGS if k <= len(word))}


def _segments(carriers: list[list[list[bytes]]], folds: list[list[list[list[bytes]]]], leave_out: int | None = None) -> bytes:
    """The carriers (by fold and toxic text) and their beginnings that recur and are in far more toxic texts than ordinary ones let expect.

    folds: the words of the toxic and the ordinary texts by fold.  The most frequent ones come last, where a match costs
    least.
    """
    parts = [i for i in range(FOLDS) if i != leave_out]
    least = max(RECURS, OFTEN * sum(len(folds[0][i]) for i in parts))
    seen = Counter(f for i in parts for words in carriers[i] for f in set().union(*map(_forms, set(words))))
    seen = {f: n for f, n in seen.items() if n >= least}
    begins = {f[1:5].rstrip() for f in seen}

    def held(side: int) -> Counter:
        return Counter(f for i in parts for words in folds[side][i] for f in set().union(*(_forms(w) & seen.keys() for w in set(words) if w[:4] in begins)))

    toxic, ordinary = held(0), held(1)
    fair = sum(len(folds[0][i]) for i in parts) / max(1, sum(len(folds[1][i]) for i in parts))
    good = lambda f, chance: toxic[f] > max(chance + DEVIATIONS * (chance + 1) ** 0.5, TIMES * chance)
    chosen = {f: n for f, n in seen.items() if good(f, fair * ordinary[f])}
    # of forms that are nearly always one, the longest stays
    chosen = {f: n for f, n in chosen.items() if not any(len(g) > len(f) and g.startswith(f) and m >= ALIKE * n for g, m in chosen.items())}
    return b"".join(aligned(f) for _, f in sorted((n, f) for f, n in chosen.items()))[-SEGMENTS:]


def fit(toxic: list[str], ordinary: list[str]) -> Model | None:
    """A model of labelled texts; None unless there are texts of both labels."""
    if not toxic or not ordinary:
        return None
    folds = [[[words_of(t) for t in side[i::FOLDS]] for i in range(FOLDS)] for side in (toxic, ordinary)]
    cuts = [[[windows_of(w) for w in fold] for fold in side] for side in folds]
    rest = lambda side, i: [w for j, fold in enumerate(folds[side]) if j != i for w in fold] or [w for fold in folds[side] for w in fold]
    common = [trained(rest(1, i), DICTIONARY) for i in range(FOLDS)]
    own = [Compressor(c) for c in common]
    pairs = [Pair(own[i], Compressor(trained(rest(0, i), DICTIONARY))) for i in range(FOLDS)]
    for _ in range(TURNS):
        carriers = []
        for i, pair in enumerate(pairs):
            plain = pair.gains([w for windows in cuts[1][i] for w in windows])
            bar = max(SOME, float(np.quantile(plain, 1 - RARE)) if len(plain) else 0.0)
            kept = [[w for w, g in zip(windows, pair.gains(windows).tolist(), strict=True) if g >= bar] for windows in cuts[0][i]]
            carriers.append([pair.carriers(windows) for windows in kept])
        pairs = [Pair(own[i], Compressor(common[i] + _segments(carriers, folds, i))) for i in range(FOLDS)]
    x = np.concatenate([measures(np.concatenate([*[pair.gains(w) for w in cuts[side][i]], np.zeros(0, np.int32)]), _starts(cuts[side][i])) for i, pair in enumerate(pairs) for side in (0, 1)])
    y = np.concatenate([np.full(len(cuts[side][i]), 1.0 - side) for i in range(FOLDS) for side in (0, 1)])
    return Model(trained([w for fold in folds[1] for w in fold], DICTIONARY), _segments(carriers, folds), logistic(x, y))


def score_texts(texts: list[str | None], model: Model | None, pair: Pair | None) -> np.ndarray:
    """Each text's score, 0 to 1."""
    if model is None or pair is None:
        return np.zeros(len(texts))
    cut = [windows_of(words_of(t)) for t in texts]
    x = measures(pair.gains([w for windows in cut for w in windows]), _starts(cut))
    return 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))


def held_out(column: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on the labelled documents; the sample comes to the driver within its bounds."""
    spread = F.xxhash64(F.col("doc_id"), F.lit(7))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").distinct()
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if set(counts) != {0, 1}:
        return None
    # about as many rows as the sample takes, picked by their hash before texts are joined; a third more for those without text
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.3 * SAMPLE_ROWS / n))])
    known = known.where(F.pmod(spread, F.lit(1 << 40)) / float(1 << 40) < share[F.col("toxic")])
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL").join(small_enough(known), "doc_id")
    order = Window.partitionBy("toxic").orderBy("at", "text")
    rows = rows.select("toxic", "text", F.pmod(spread, F.lit(1 << 40)).alias("at")).withColumn("nth", F.row_number().over(order)).withColumn("bytes", F.sum(F.octet_length("text")).over(order))
    sample = rows.where((F.col("nth") <= SAMPLE_ROWS) & ((F.col("nth") == 1) | (F.col("bytes") <= SAMPLE_BYTES))).select("toxic", "nth", "text").toArrow().sort_by([("toxic", "ascending"), ("nth", "ascending")])
    texts: dict[int, list[str]] = {0: [], 1: []}
    for label, text in zip(sample["toxic"].to_pylist(), sample["text"].to_pylist(), strict=True):
        texts[label].append(text)
    return fit(texts[1], texts[0])


def judge(documents: DataFrame, model: Model | None, most_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, score, predicted of every row: one narrow pass with a broadcast model of bounded size."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        pair = sent.value.pair() if sent.value else None
        for part in in_slices(batches, "text", most_bytes):
            score = score_texts(part.column("text").to_pylist(), sent.value, pair)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= LEAST_SCORE).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows_of(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, predicted int")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out()), labels.where(~held_out()))
    return judge(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op12_toxicity": op12_toxicity}
SQL: dict[str, str] = {}
