"""SentencePiece encoding and decoding with a given model file: batched numpy Viterbi over equal-length words.

Words of one length advance together: prefix hashes give every substring's hash, which is probed in the sorted keys of
the pieces, and the best last piece of every prefix is kept as a backpointer.

A unigram model takes the best sum of scores.  A BPE model's ids are those of its merges: a split is the merges' result
just if every two neighbours of it are compatible (merging their characters alone gives back these two), and for each
prefix one last piece at most is compatible with the split before it.  So the same recursion takes, among the pieces that
end here, the one that is compatible with the last piece of the prefix before it.

Defined results: a null text gives null ids, an empty one none; characters without a piece are encoded as bytes; long
texts are encoded whole; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignspark.llm.common import in_slices, rows_of, table

BLANK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
NONE = np.int64(1) << 40
HIGH = np.uint64(44)
#: Blanks with what follows them, and line ends by themselves; no piece reaches across (checked for each model).
UNITS = re.compile(f"{BLANK}+[^{BLANK}\n]*|\n|[^{BLANK}\n]+")
#: Characters from which a unit advances in windows.
LONG = 1024
MARKS = ".,;:!?$%&*#)\"'"


def key(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class Pieces:
    """A model file's pieces as arrays; made once at the driver and broadcast (its size is the file's)."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.scores = np.array([model.get_score(i) for i in range(n)])
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.unknown = model.unk_id()
        self.byte_ids = np.full(256, self.unknown, np.int64)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(self.pieces[i][1:-1], 16)] = i
        normal = [i for i in range(n) if not special[i]]
        self.by_piece = {self.pieces[i]: i for i in normal}
        self.longest = max(map(len, self.by_piece))
        keys = np.array([key(self.pieces[i]) for i in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, np.int64)[order]
        if not (np.diff(self.keys) > 0).all():
            raise ValueError("two pieces have one hash")
        self.maybe = np.zeros(1 << 20, bool)  # what no key shares its high bits with needs no probe
        self.maybe[self.keys >> HIGH] = True
        if any("\n" in p or BLANK in p.lstrip(BLANK) for p in self.by_piece):
            raise ValueError("pieces reach across units")
        if model.decode(model.encode(" a  b\tＡ")) != " a  b\tＡ":
            raise ValueError("the model normalises texts")
        if model.id_to_piece(model.encode("a")[0])[:1] != BLANK:
            raise ValueError("the model puts no blank before a text")
        self.joined = {p[i : i + 2] for p in self.by_piece for i in range(len(p) - 1)}  # neighbours inside a piece
        self.ranked = bool((self.scores[normal] == np.round(self.scores[normal])).all())  # merge ranks, not log-probabilities
        self.bytes = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else b"" if special[i] else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        if self.ranked:
            self._merges()

    def _merges(self) -> None:
        """Of each piece: its rank (-1: one character) and the two parts that its last merge joins; all pairs that merge."""
        n = len(self.pieces)
        self.lengths = np.array([len(p) for p in self.pieces])
        self.rank = np.full(n, -1, np.int64)
        self.parts = np.zeros((n, 2), np.int64)
        self.reached = np.zeros(n, bool)
        pairs = {}
        by_piece, scores = self.by_piece, self.scores.tolist()
        for piece, i in by_piece.items():
            if len(piece) == 1:
                self.reached[i] = True
                continue
            self.rank[i] = -int(scores[i])
            for k in range(1, len(piece)):
                a, b = by_piece.get(piece[:k]), by_piece.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = self.rank[i]
            parts = list(piece)
            while len(parts) > 2:
                best = max(((scores[m], -k) for k in range(len(parts) - 1) if (m := by_piece.get(parts[k] + parts[k + 1])) is not None), default=None)
                if best is None:
                    break
                k = -best[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 2 and all(p in by_piece for p in parts):
                self.reached[i] = True
                self.parts[i] = by_piece[parts[0]], by_piece[parts[1]]
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.pair_maybe = np.zeros(1 << 20, bool)
        self.pair_maybe[self.pair_keys.astype(np.uint64) * BASE >> HIGH] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where none."""
        out = np.full(len(hashes), -1)
        rows = np.flatnonzero(self.maybe[hashes >> HIGH])
        some = hashes[rows]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        out[rows] = np.where(self.keys[at] == some, self.ids[at], -1)
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of pieces a and b together gives these two.

        Undoes the merges from the last on: if, at any time before, the parts at the border could have merged earlier than
        the merge just undone, they would have.  Of equal ranks the left merge comes first.
        """
        n = len(self.pieces)
        good = np.ones(len(a), bool)
        rows = np.arange(len(a))
        limit = np.full(len(a), NONE)
        while len(rows):
            code = a * n + b
            merged = np.full(len(code), NONE)
            likely = np.flatnonzero(self.pair_maybe[code.astype(np.uint64) * BASE >> HIGH])
            at = np.minimum(np.searchsorted(self.pair_keys, code[likely]), len(self.pair_keys) - 1)
            merged[likely] = np.where(self.pair_keys[at] == code[likely], self.pair_ranks[at], NONE)
            fails = merged < limit
            good[rows[fails]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~fails & ((ra >= 0) | (rb >= 0))
            rows, a, b, ra, rb = rows[on], a[on], b[on], ra[on], rb[on]
            left = ra > rb
            limit = np.where(left, ra, rb + 1)
            a, b = np.where(left, self.parts[a, 1], a), np.where(left, b, self.parts[b, 0])
        return good

    def prefix_hashes(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each prefix of each word (words x length + 1), and the powers of the base."""
        n, length = words.shape
        hashes = np.zeros((n, length + 1), np.uint64)
        powers = np.full(length + 1, BASE)
        powers[0] = 1
        for j in range(length):
            hashes[:, j + 1] = hashes[:, j] * BASE + words[:, j] + np.uint64(1)
        return hashes, np.cumprod(powers, dtype=np.uint64)

    def viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, at the end of its row, and their numbers; words is a matrix of code points.

        A character without a piece is given as -1 - code point.
        """
        n, length = words.shape
        hashes, powers = self.prefix_hashes(words)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        last = np.full((n, length + 1), -1, np.int64)
        back = np.zeros((n, length + 1), np.int64)
        lost = self.scores.min() - 10
        for j in range(1, length + 1):
            for i in range(max(0, j - self.longest), j):
                ids = self.find(hashes[:, j] - hashes[:, i] * powers[j - i])
                if j - i == 1:
                    score = best[:, i] + np.where(ids >= 0, self.scores[ids] if not self.ranked else 0, lost if not self.ranked else 0)
                    rows = np.flatnonzero(best[:, i] > -np.inf)
                else:
                    score = best[:, i] + (self.scores[ids] if not self.ranked else 0)
                    rows = np.flatnonzero((ids >= 0) & (best[:, i] > -np.inf))
                if self.ranked and len(rows):
                    own = ids[rows]
                    good = (own < 0) | self.reached[own]
                    if i:
                        before = last[rows, i]
                        both = good & (own >= 0) & (before >= 0)
                        good[both] = self.compatible(before[both], own[both])
                    rows = rows[good]
                rows = rows[score[rows] > best[rows, j]]
                best[rows, j], last[rows, j], back[rows, j] = score[rows], np.where(ids[rows] >= 0, ids[rows], -1 - words[rows, j - 1].astype(np.int64)), i
        ids, at, counts = np.zeros((n, length), np.int64), np.full(n, length), np.zeros(n, np.int64)
        rows = np.arange(n)
        for place in range(length - 1, -1, -1):  # all words step back together
            ids[rows, place] = last[rows, at[rows]]
            at[rows] = back[rows, at[rows]]
            counts[rows] += 1
            rows = rows[at[rows] > 0]
            if not len(rows):
                break
        return ids, counts


class Encoder:
    """Encodes texts unit by unit (blanks and what follows them); each unit is encoded once and kept."""

    def __init__(self, pieces: Pieces, most_kept: int = 300_000) -> None:
        self.pieces, self.most_kept = pieces, most_kept
        self.units: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.before: tuple[dict, dict] = ({}, {})  # what was kept before; what is used again is kept on

    @staticmethod
    def _unknown(wanted: set[str], now: dict[str, bytes], before: dict[str, bytes]) -> set[str]:
        """What of wanted is kept nowhere; what was kept before is kept on."""
        missing = wanted.difference(now)
        again = missing & before.keys()
        now.update((k, before[k]) for k in again)
        return missing - again

    def split(self, unit: str) -> list[str]:
        """A unit without its closing mark, and that mark, if no piece reaches across; else the unit."""
        if len(unit) > 1 and unit[-1] in MARKS and unit[-2:] not in self.pieces.joined:
            return [unit[:-1], unit[-1]]
        return [unit]

    def _bytes(self, words: np.ndarray) -> list[bytes]:
        ids, counts = self.pieces.viterbi(words)
        width = ids.shape[1]
        data, out = ids.astype("<u4").tobytes(), []
        lost = (ids < 0).any(1).tolist()
        for w, (k, odd) in enumerate(zip(counts.tolist(), lost, strict=True)):
            if odd:
                row = [x for i in ids[w, width - k :].tolist() for x in ([i] if i >= 0 else self.pieces.byte_ids[list(chr(-1 - i).encode())].tolist())]
                out.append(np.array(row, "<u4").tobytes())
            else:
                out.append(data[4 * (w * width + width - k) : 4 * (w + 1) * width])
        return out

    def _tokens(self, words: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each word of one length: its pieces' ids and the places in the text where they begin."""
        ids, counts = self.pieces.viterbi(words)
        out = []
        for row, k, start in zip(ids, counts.tolist(), starts.tolist(), strict=True):
            own = row[len(row) - k :]
            sizes = np.where(own >= 0, self.pieces.lengths[np.maximum(own, 0)], 1)
            out.append((own, start + np.cumsum(sizes) - sizes))
        return out

    def _windows(self, codes: np.ndarray, starts: np.ndarray, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for i in range(0, len(starts), max(1, 400_000 // window)):
            part = starts[i : i + max(1, 400_000 // window)]
            out += self._tokens(codes[part[:, None] + np.arange(window)], part)
        return out

    @staticmethod
    def _meet(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: int) -> tuple[int, int] | None:
        """Places in a (from least on) and b of the first piece that both have in the same place of the text."""
        lo = max(least, int(np.searchsorted(a[1], b[1][0])))
        _, x, y = np.intersect1d(a[1][lo:], b[1], assume_unique=True, return_indices=True)
        same = np.flatnonzero(a[0][lo:][x] == b[0][y])
        return (lo + int(x[same[0]]), int(y[same[0]])) if len(same) else None

    def long(self, text: str, window: int = 512, overlap: int = 128, shifts: int = 16) -> bytes:
        """Ids of a long unit of a BPE model, in windows that advance together.

        A split is the model's just if all neighbours in it are compatible.  So where two windows have a piece in common,
        the first's pieces up to it and the second's from it on are a split of both.  A window that has none in common
        with the one before is begun anew at the next few characters; if that doesn't help, windows grow.
        """
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
        while window < len(codes):
            starts = np.r_[np.arange(0, max(1, len(codes) - window - shifts), window - overlap), len(codes) - window]
            tokens = self._windows(codes, starts, window)
            others: dict[int, list] = {}
            now, at, out = tokens[0], 0, []
            for i in range(1, len(tokens)):
                met = self._meet(now, tokens[i], at)
                if not met and i == len(tokens) - 1:  # the text's last window gets shorter
                    others[i] = (self._tokens(codes[None, starts[i] + k :], starts[i : i + 1] + k)[0] for k in range(1, shifts))
                elif not met and i not in others:  # one shift often leads to others: those that follow are begun anew together
                    again = range(i, min(len(tokens) - 1, i + 512))
                    moved = (starts[again.start : again.stop, None] + np.arange(1, shifts)).ravel()
                    for n, found in enumerate(self._windows(codes, moved, window)):
                        others.setdefault(again[n // (shifts - 1)], []).append(found)
                after = tokens[i] if met else next((x for x in others[i] if self._meet(now, x, at)), None)
                if after is None:
                    break
                met = met or self._meet(now, after, at)
                out.append(now[0][at : met[0]])
                now, at = after, met[1]
            else:
                ids = np.concatenate([*out, now[0][at:]])
                if (ids < 0).any():
                    ids = np.concatenate([[i] if i >= 0 else self.pieces.byte_ids[list(chr(-1 - i).encode())] for i in ids.tolist()])
                return ids.astype("<u4").tobytes()
            window, overlap = 8 * window, 8 * overlap
        return self._bytes(codes[None, :])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.units) > self.most_kept:
            self.before, self.units = (self.units, self.before[1]), {}
        if len(self.parts) > self.most_kept:
            self.before, self.parts = (self.before[0], self.parts), {}
        split = [UNITS.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        new = {u: self.split(u) for u in self._unknown({u for s in split for u in s}, self.units, self.before[0])}
        by_length: dict[int, list[str]] = {}
        for p in self._unknown({p for s in new.values() for p in s}, self.parts, self.before[1]):
            if self.pieces.ranked and len(p) > LONG:
                self.parts[p] = self.long(p)
            else:
                by_length.setdefault(len(p), []).append(p)
        for length, words in by_length.items():
            together = max(1, 400_000 // (length + 1))
            for i in range(0, len(words), together):
                part = words[i : i + together]
                codes = np.frombuffer("".join(part).encode("utf-32-le"), "<u4").reshape(-1, length).astype(np.uint64)
                self.parts.update(zip(part, self._bytes(codes), strict=True))
        self.units.update((u, b"".join(map(self.parts.__getitem__, s))) for u, s in new.items())
        return [b"".join(map(self.units.__getitem__, s)) for s in split]

    def decode(self, ids: list[int]) -> str:
        """The text of these ids; the blank that encoding puts before it goes."""
        text = b"".join(map(self.pieces.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) of every row."""
    sent = documents.sparkSession.sparkContext.broadcast(_Sent(Pieces(path)))

    def run(batches):
        encoder = sent.value.encoder()
        for part in in_slices(batches, "text", 4 << 20):
            texts = part.column("text").to_pylist()
            encoded = [np.frombuffer(b, "<u4").astype(np.int32) if t is not None else None for t, b in zip(texts, encoder.encode([t or "" for t in texts]), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(encoded, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows_of(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of encode_documents()."""
    sent = encoded.sparkSession.sparkContext.broadcast(_Sent(Pieces(path)))

    def run(batches):
        encoder = sent.value.encoder()
        for part in batches:
            texts = [None if ids is None else encoder.decode(ids) for ids in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows_of(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


class _Sent:
    """Pieces as broadcast; keeps a worker's encoder between tasks."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self._encoder: Encoder | None = None

    def encoder(self) -> Encoder:
        if self._encoder is None:
            self._encoder = Encoder(self.pieces)
        return self._encoder


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every whole text and decodes it again: doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), n_byte_pieces, round_trip."""
    sent = spark.sparkContext.broadcast(_Sent(Pieces(vocabulary())))

    def run(batches):
        encoder = sent.value.encoder()
        fallback = np.zeros(len(encoder.pieces.pieces), bool)
        fallback[encoder.pieces.byte_ids] = True
        for part in in_slices(batches, "text", 4 << 20):
            texts = [t or "" for t in part.column("text").to_pylist()]
            encoded = encoder.encode(texts)
            arrays = [np.frombuffer(b, "<u4") for b in encoded]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(a) for a in arrays], pa.int64()), pa.array(map(zlib.crc32, encoded), pa.int64()), pa.array([int(fallback[a].sum()) for a in arrays], pa.int64()), pa.array([encoder.decode(a.tolist()) == t for a, t in zip(arrays, texts, strict=True)], pa.bool_())],
                ["doc_id", "n_pieces", "ids_crc32", "n_byte_pieces", "round_trip"],
            )

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows_of(docs, run, "doc_id long, n_pieces long, ids_crc32 long, n_byte_pieces long, round_trip boolean")


QUERIES = {"op10_pieces": op10_pieces}
SQL: dict[str, str] = {}
