"""Language identification by string kernels: Nystroem landmarks and one-versus-rest kernel ridge regression.

A text's features are the character n-grams (1 to 3, a blended spectrum) that occur in it, as presence bits of a hashed
space.  The kernel of two texts is the n-grams they share over the root of the product of the n-grams that each has.  Landmarks are
whole labelled texts; a batch of texts is scored by two matrix products (presence by landmarks, kernels by weights).

The fit takes a bounded sample of labelled rows, shared equally by all languages and picked by a hash of doc_id: FIT_ROWS of
them and FIT_CODES n-grams at most, but with four rows of each language (one, if those hold too many n-grams).  Defined results: a null text, or one without a letter, is `und` with score 0; without labelled rows all texts
are `und`; a null doc_id is in no training set and not held out; repeated rows get repeated results; other columns are
ignored by identify and kept by the pipeline's stage.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alignspark.llm.common import in_slices, rows_of, table

#: Bounds of the fit: labelled rows, n-grams of their sets, landmarks; bits of the hashed n-gram space; the ridge.
FIT_ROWS, FIT_CODES, LANDMARKS, BITS, RIDGE = 1600, 8_000_000, 192, 18, 1e-3
#: The stage rejects scores below this share of the least score of a labelled text that the fit hasn't seen.
MARGIN = 0.5
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


class Marks:
    """Presence of hashed 1-, 2- and 3-grams; one array that each text uses again."""

    def __init__(self, bits: int = BITS, chunk: int = 1 << 18) -> None:
        self.shift, self.chunk, self.marks = np.uint32(32 - bits), chunk, np.zeros(1 << bits, bool)

    def of(self, text: str) -> np.ndarray:
        """The marks of the whole text, read in chunks that overlap by two characters; valid until the next call."""
        marks, shift, low = self.marks, self.shift, text.lower()
        marks[:] = False
        for at in range(0, max(1, len(low)), self.chunk):
            c = np.frombuffer(low[at : at + self.chunk + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
            a = c * np.uint32(0x9E3779B1)
            b = (a[:-1] ^ c[1:]) * np.uint32(0x85EBCA6B)
            d = (b[:-1] ^ c[2:]) * np.uint32(0xC2B2AE35)
            for codes in (a, b, d):
                marks[codes >> shift] = True
        return marks

    def codes(self, text: str) -> np.ndarray:
        """The sorted codes of the n-grams that occur in the text."""
        return np.flatnonzero(self.of(text)).astype(np.int32)


class Model(NamedTuple):
    languages: list[str]
    codes: np.ndarray  # n-gram codes that occur in landmarks
    landmarks: np.ndarray  # codes x landmarks, presence
    sizes: np.ndarray  # n-grams of each landmark
    weights: np.ndarray  # landmarks x languages

    def scores(self, texts: list[str], marks: Marks) -> np.ndarray:
        """texts x languages: the ridge regressions' outputs."""
        presence, own = np.empty((len(texts), len(self.codes)), np.float32), np.empty(len(texts))
        for i, text in enumerate(texts):
            found = marks.of(text)
            presence[i], own[i] = found[self.codes], np.count_nonzero(found)
        return self.kernel(presence, own) @ self.weights

    def kernel(self, presence: np.ndarray, own: np.ndarray) -> np.ndarray:
        """n-grams shared with each landmark, over the root of the product of both texts' numbers of n-grams."""
        return (presence @ self.landmarks) / np.sqrt(np.maximum(own, 1)[:, None] * self.sizes)


def fit(samples: dict[str, list[np.ndarray]], landmarks: int = LANDMARKS) -> Model | None:
    """samples: each language's texts as sets of n-gram codes; the first ones of each language (one at least) are landmarks too."""
    languages = sorted(k for k, v in samples.items() if v)
    if not languages:
        return None
    each = max(1, landmarks // len(languages))
    chosen = [s for k in languages for s in samples[k][:each]]
    codes = np.unique(np.concatenate(chosen))
    index = np.full(1 << BITS, -1, np.int32)
    index[codes] = np.arange(len(codes))

    def presence(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(codes)), np.float32)
        for row, s in zip(out, sets, strict=True):
            at = index[s]
            row[at[at >= 0]] = 1
        return out

    sizes = lambda sets: np.array([len(s) for s in sets], float)
    marks = presence(chosen)
    model = Model(languages, codes, marks.T.copy(), sizes(chosen).astype(np.float32), np.zeros((len(chosen), len(languages)), np.float32))
    among, vectors = np.linalg.eigh(model.kernel(marks, sizes(chosen)).astype(np.float64))
    good = among > 1e-6 * among.max()
    root = vectors[:, good] / np.sqrt(among[good])  # landmark kernel to the power -1/2
    rows = [s for k in languages for s in samples[k]]
    answers = np.concatenate([np.tile(np.eye(len(languages))[i], (len(samples[k]), 1)) for i, k in enumerate(languages)])
    parts = [rows[i : i + 256] for i in range(0, len(rows), 256)]
    mapped = np.concatenate([model.kernel(presence(p), sizes(p)) for p in parts]) @ root
    balance = 1 / (answers @ answers.sum(0))[:, None]  # each language weighs the same
    left = mapped.T @ (mapped * balance) + RIDGE * np.eye(mapped.shape[1])
    weights = root @ np.linalg.solve(left, mapped.T @ (answers * balance))
    return model._replace(weights=weights.astype(np.float32))


def train(documents: DataFrame, fit_rows: int = FIT_ROWS, fit_codes: int = FIT_CODES) -> Model | None:
    """Fit on about fit_rows of documents' rows with text and lang (four of each language at least); their n-gram sets come to the driver.

    Of these rows, the first by a hash of doc_id are taken until their sets hold fit_codes n-grams (one row of each
    language always).
    """
    labelled = documents.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(4, fit_rows // len(counts))
    spread = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.3 * each / n))])
    picked = labelled.select("lang", "text", spread.alias("at")).where(F.col("at") < share[F.col("lang")])

    def run(batches):
        marks = Marks()
        for part in in_slices(batches, "text"):
            sets = [marks.codes(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("at"), pa.array(sets, pa.list_(pa.int32()))], ["lang", "at", "codes"])

    found = rows_of(picked, run, "lang string, at double, codes array<int>")
    order = Window.partitionBy("lang").orderBy("at")
    nth, held = F.row_number().over(order), F.sum(F.size("codes")).over(order)
    found = found.withColumn("nth", nth).withColumn("held", held).where((F.col("nth") <= each) & ((F.col("nth") == 1) | (F.col("held") <= fit_codes // len(counts))))
    rows = found.select("lang", "at", "codes").toArrow()
    samples: dict[str, list] = {k: [] for k in counts}
    codes = rows["codes"].combine_chunks()
    for i in np.argsort(rows["at"].to_numpy(), kind="stable").tolist():
        samples[rows["lang"][i].as_py()].append(codes[i].values.to_numpy())
    return fit(samples)


def predict(texts: list[str | None], model: Model | None, marks: Marks, together: int = 64) -> list[tuple[str, float]]:
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    rows = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model else []
    for k in range(0, len(rows), together):
        scores = model.scores([texts[i] for i in rows[k : k + together]], marks)
        for i, best, score in zip(rows[k : k + together], scores.argmax(1).tolist(), np.clip(scores.max(1), 0, 1).tolist(), strict=True):
            out[i] = (model.languages[best], score)
    return out


def held_out(column: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score: one narrow pass with a broadcast model of bounded size."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        marks = Marks()
        for part in in_slices(batches, "text"):
            found = predict(part.column("text").to_pylist(), sent.value, marks)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows_of(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def least_score(docs: DataFrame, model: Model) -> float:
    """The score below which a text is in no learned language: MARGIN of the least that a labelled, held-out text has."""
    labelled = docs.where(held_out() & F.col("lang").isNotNull())
    least = identify(labelled, model).where(F.col("lang_pred") != UNKNOWN).agg(F.min("score")).first()[0]
    return MARGIN * (least or 0.0)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejects null texts, texts without a letter and texts that score less than least_score.

    Without labelled rows there is no model, and every text with a letter stays.
    """
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    least = least_score(docs, model) if model else 0.0
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        marks = Marks()
        for part in in_slices(batches, "text"):
            texts = part.column("text").to_pylist()
            if sent.value is None:
                keep = [bool(t and LETTER.search(t)) for t in texts]
            else:
                keep = [found != UNKNOWN and score >= least for found, score in predict(texts, sent.value, marks)]
            yield part.filter(pa.array(keep, pa.bool_()))

    return rows_of(docs, run, docs.schema)


QUERIES = {"op5_language": op5_language}
SQL: dict[str, str] = {}
