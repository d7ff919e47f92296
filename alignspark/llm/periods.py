"""Periodic runs of words by a harmonic grid of longest-common-extension queries.

For each period p the places 0, p, 2p, ... of a document are a grid.  A run of period p and at least 3p words covers three
neighbouring grid places, whose words are equal; for such neighbours jp and (j+1)p the common extension forward and the one
backward give the whole stretch that keeps the period.  Extensions are range minima of the longest-common-prefix array
between two suffix ranks, forward in a suffix array of the words and backward in one of the reversed words.  A
stretch found with several periods (multiples of one another) counts with its smallest.

Documents of a slice share the arrays: words of different documents are different symbols, so no extension crosses a
border.  Suffix arrays are built by doubling, where only suffixes that aren't yet alone in their place are sorted again;
only documents in which some grid has three equal neighbours enter them.  All steps run over whole arrays.  A grid of all
periods has n ln n places for n words.

Defined results: a null or empty text has no words and no run; a null doc_id has nothing put in its place by planted();
repeated rows get repeated results; other columns are ignored.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignspark.llm.common import in_slices, rows_of, table

#: Words that a run has at least; times its period that it has at least (three or more: grids rest on it).
LEAST, TIMES = 24, 3


class Run(NamedTuple):
    start: int
    length: int
    period: int


class Extensions:
    """Longest common extensions of places of a symbol array: ranks of its suffixes and range minima of their prefixes."""

    def __init__(self, symbols: np.ndarray, longest: int) -> None:
        """longest: the most places between two that are asked for; equal symbols are never further apart."""
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        ordered = symbols[order]
        fresh = np.r_[True, ordered[1:] != ordered[:-1]] if n else np.zeros(0, bool)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        levels, size = [rank.astype(np.int32)], 1
        active = order[~(fresh & np.r_[fresh[1:], True])] if n else order
        while len(active):
            ahead = np.where(active + size < n, rank[np.minimum(active + size, n - 1)] + 1, 0)
            own = np.lexsort((ahead, rank[active]))
            active, ahead = active[own], ahead[own]
            group = rank[active]
            new_group = np.r_[True, group[1:] != group[:-1]]
            new = new_group | np.r_[True, ahead[1:] != ahead[:-1]]
            begin = np.maximum.accumulate(np.where(new_group, np.arange(len(active)), 0))
            first = np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))
            rank[active] = group + first - begin
            levels.append(rank.astype(np.int32))
            active, size = active[~(new & np.r_[new[1:], True])], 2 * size
        self.rank = rank
        self.minima = [self._prefixes(levels, n)]
        width = 1
        while 2 * width <= max(1, longest):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[: max(0, len(last) - width)], last[width:]))
            width *= 2

    def _prefixes(self, levels: list[np.ndarray], n: int) -> np.ndarray:
        """The common prefix of each suffix and the next one in order: climbs while ranks of 2^k symbols are equal, then down again."""
        at = np.empty(n, np.int64)
        at[self.rank] = np.arange(n)
        out, top = np.zeros(max(0, n - 1), np.int32), np.full(max(0, n - 1), -1)
        alive = np.arange(max(0, n - 1))
        for k, level in enumerate(levels):
            alive = alive[level[at[alive]] == level[at[alive + 1]]]
            if not len(alive):
                break
            top[alive] = k
        for k in range(int(top.max(initial=-1)), -1, -1):
            rows = np.flatnonzero(top >= k)
            one, two = at[rows] + out[rows], at[rows + 1] + out[rows]
            inside = np.maximum(one, two) < n
            rows = rows[inside]
            equal = rows[levels[k][one[inside]] == levels[k][two[inside]]]
            out[equal] += 1 << k
        return out

    def of(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Equal symbols from the places one and two on (different places)."""
        if not len(one):
            return np.zeros(0, np.int64)
        low, high = np.minimum(self.rank[one], self.rank[two]), np.maximum(self.rank[one], self.rank[two])
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(one), np.int64)
        for k in np.unique(level).tolist():
            rows = np.flatnonzero(level == k)
            out[rows] = np.minimum(self.minima[k][low[rows]], self.minima[k][high[rows] - (1 << k)])
        return out


def grid_pairs(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, place and period of the neighbours (place, place + period) of the grids that are part of three equal ones.

    starts and sizes: where each document's symbols begin and how many there are.
    """
    order = np.argsort(-sizes, kind="stable")
    documents, places, periods = [], [], []
    longest = int(sizes.max(initial=0))
    falling = -sizes[order]
    for p in range(1, longest // TIMES + 1):
        own = order[: np.searchsorted(falling, -max(LEAST, TIMES * p), side="right")]
        if not len(own):
            break
        count = (sizes[own] - 1) // p  # neighbours in each document
        ends = np.cumsum(count)
        owner = np.repeat(np.arange(len(own)), count)
        at = starts[own][owner] + (np.arange(ends[-1]) - (ends - count)[owner]) * p
        equal = symbols[at] == symbols[at + p]
        near = np.r_[equal[1:] & (owner[1:] == owner[:-1]), False]  # the next neighbours are equal too
        good = np.flatnonzero(equal & (near | np.r_[False, equal[:-1] & near[:-1]]))
        if len(good):
            documents.append(own[owner[good]])
            places.append(at[good])
            periods.append(np.full(len(good), p))
    if not documents:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return np.concatenate(documents), np.concatenate(places), np.concatenate(periods)


def runs_of(texts: list[list]) -> list[list[Run]]:
    """Each document's runs by start, then period; a document is a list of words."""
    out: list[list[Run]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    codes: list[int] = []
    for words in texts:  # a number for each document's own words: equal words of different documents get different ones
        known: dict = {}
        base = len(codes)
        codes += [known.setdefault(w, base + i) for i, w in enumerate(words)]
    symbols = np.array(codes, np.int64)
    starts = np.cumsum(sizes) - sizes
    document, place, period = grid_pairs(symbols, starts, sizes)
    if not len(document):
        return out
    # only these documents' symbols are indexed
    held = np.unique(document)
    mark = np.zeros(len(texts), bool)
    mark[held] = True
    symbols = symbols[np.repeat(mark, sizes)]
    shifted = np.zeros(len(texts), np.int64)
    shifted[held] = np.cumsum(sizes[held]) - sizes[held]
    place = place - starts[document] + shifted[document]
    n, longest = len(symbols), int(sizes[held].max())
    ahead = Extensions(symbols, longest).of(place, place + period)
    # backward from the place before: in the reversed array, place x is n - 1 - x
    back = np.zeros(len(place), np.int64)
    rows = np.flatnonzero(place > shifted[document])
    back[rows] = Extensions(symbols[::-1].copy(), longest).of(n - place[rows], n - place[rows] - period[rows])
    start, length = place - back - shifted[document], period + ahead + back
    good = np.flatnonzero(length >= np.maximum(LEAST, TIMES * period))
    found = np.unique(np.stack([document[good], start[good], length[good], period[good]], 1), axis=0)
    first = np.r_[True, (found[1:, :3] != found[:-1, :3]).any(1)] if len(found) else np.zeros(0, bool)
    for d, s, m, p in found[first].tolist():  # of a stretch with several periods, the smallest
        out[d].append(Run(s, m, p))
    for runs in out:
        runs.sort(key=lambda r: (r.start, r.period))
    return out


def greatest(runs: list[Run]) -> Run | None:
    """The run with the greatest length by period (exactly); then the smallest start and period."""
    best = None
    for run in runs:
        if best is None or run.length * best.period > best.length * run.period:
            best = run
    return best


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without those that a run repeats: of each run its first period stays, unless another run drops it."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    gone = np.cumsum(gone)
    return [w for w, g in zip(words, gone.tolist(), strict=False) if not g]


def planted(words: list, doc_id: int | None) -> list:
    """The words as the query reads them: in a tenth of the documents, by a hash of doc_id, the rest from some place on repeats."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * ((n - a) // p + 1))[: n - a]


SPACES = b" "


def find_runs(documents: DataFrame, change=None) -> DataFrame:
    """doc_id, runs (start, length, period), collapsed (the text without repeated words, joined by blanks) of every row."""

    def run(batches):
        for part in in_slices(batches, "text", 2 << 20):
            ids, words = _words(part, change)
            found = runs_of(words)
            rows = [[r._asdict() for r in runs] for runs in found]
            texts = [SPACES.join(collapsed(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(words, found, strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows, kind), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    return rows_of(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _words(part: pa.RecordBatch, change) -> tuple[pa.Array, list[list[bytes]]]:
    ids = part.column("doc_id")
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in part.column("text").to_pylist()]
    return ids, [change(w, d) for w, d in zip(words, ids.to_pylist(), strict=True)] if change else words


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs' digests of every document."""
    found = find_runs(table(spark, sf_dir, "documents"), planted)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    # the greatest by length / period, exactly: cross products fit into 38 digits
    better = lambda a, b: F.when(b.isNull(), a).when(a["length"].cast("decimal(19)") * b["period"].cast("decimal(19)") > b["length"].cast("decimal(19)") * a["period"].cast("decimal(19)"), a).otherwise(b)
    top = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: better(r, best))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * top.length) div top.period")
    return rows.select("doc_id", "n_runs", "top.start", "top.length", "top.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {"op13_periods": op13_periods}
SQL: dict[str, str] = {}
