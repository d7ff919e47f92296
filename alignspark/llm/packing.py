"""Best-fit packing of tokenised documents into sequences, certified by dual-feasible lower bounds.

Documents are tokenised once; those longer than a sequence are cut so that only their first piece may be short.  Full
pieces are sequences of their own.  The others are dealt to partitions of bounded size, each packed by best-fit
decreasing; dual-feasible functions bound from below the bins that a partition's sizes need.  A partition that uses more
bins than its bound gives up its emptiest bins; what such partitions give up is dealt anew and packed again.  Rounds end
when no partition has a gap, or when a round has closed none; a piece's `gap` says how far above its bound the partition
is that placed it (0: certified).

Defined results: a null or empty text is its end token alone; repeated rows are packed each for itself; a null doc_id
stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignspark.llm.common import in_slices, kept, rows_of, table

#: The pattern that the file's kind of tokeniser splits texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "item long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long, gap long, left boolean"


class Chunked(dict):
    """Ids of texts by a byte-level BPE file; each chunk between blanks and line ends is tokenised once and kept.

    The file's pattern never joins over a blank between two other characters, nor over a single line end, so a text's
    ids are its chunks' ids in order.  Chunks of old scripts (below U+0370, the same letters in every Unicode version) are
    merged by tiktoken with the file's own vocabulary as ranks, which is several times faster; that gives the file's ids
    because merges_are_ranks() proves, for the file at hand, that its merges come in the order of their ids.  Other chunks,
    texts with other white space, runs of it, special tokens or the mark itself, and all texts of a file without that
    proof, go to the tokeniser.
    """

    MARK = "\x01"

    def __init__(self, path: str, most_kept: int = 150_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        vocab = {t: i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}
        alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())  # its printable ones are their own bytes, the others follow
        printable = [c for c in alphabet if ord(c) < 256]
        byte_of = {c: ord(c) for c in printable}
        byte_of |= dict(zip([c for c in alphabet if ord(c) >= 256], [b for b in range(256) if chr(b) not in byte_of], strict=True))
        self.fast = None
        if merges_are_ranks(path, vocab, byte_of):
            ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.most_kept, self.before = most_kept, {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        body = chunk[1:] if chunk[:1] == " " else chunk
        if chunk != "\n" and body.split() != [body]:
            raise NotPlain
        if (ids := self.before.get(chunk)) is not None:  # kept before and used again: kept on
            self[chunk] = ids
            return ids
        if len(self) > self.most_kept:
            self.before = self.copy()
            self.clear()
        if self.fast and max(chunk) < "\u0370":
            ids = self[chunk] = array("I", self.fast.encode_ordinary(chunk)).tobytes()
        else:
            ids = self[chunk] = self.whole(chunk)
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        mark, out = self.MARK, []
        for t in texts:
            try:
                if mark in t or any(s in t for s in self.special):
                    raise NotPlain
                out.append(b"".join(map(self.__getitem__, t.replace(" ", mark + " ").replace("\n", f"{mark}\n{mark}").split(mark))))
            except NotPlain:
                out.append(self.whole(t))
        return out


def merges_are_ranks(path: str, vocab: dict[str, int], byte_of: dict[str, int]) -> bool:
    """Whether the file splits by the byte-level pattern alone and its merges, in their order, make just the vocabulary's tokens beyond the bytes, ids ascending."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = file.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    plain &= model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    return plain and None not in made and made == sorted(set(made)) and set(made) | {vocab.get(c) for c in byte_of} == set(vocab.values())


class NotPlain(Exception):
    """A chunk or text that the tokeniser must see as a whole."""


_chunked: dict[str, Chunked] = {}


def chunked(path: str) -> Chunked:
    """One for each Python worker."""
    if path not in _chunked:
        _chunked[path] = Chunked(path)
    return _chunked[path]


def pieces(documents: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """item (unique), doc_id, piece, start, length, ids_crc32: a document's ids and end_id, cut at capacity."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        item = (TaskContext.get().partitionId() << 32) - 1
        encoder = chunked(path)
        for part in in_slices(batches, "text", 4 << 20):
            rows = []
            encoded = encoder.encode([t or "" for t in part.column("text").to_pylist()])
            for doc, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    item += 1
                    rows.append((item, doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["item", "doc_id", "piece", "start", "length", "ids_crc32"])

    return rows_of(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECES)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The largest bound on the bins that sizes need, over three families of dual-feasible functions.

    Each function maps sizes to at most capacity such that what fits one bin still does; so the mapped total over the
    capacity bounds every packing.
    """
    if not len(sizes):
        return 0
    x = np.arange(capacity + 1)
    n = np.bincount(sizes, minlength=capacity + 1)
    best = -(-int(n @ x) // capacity)
    e = np.arange(1, capacity // 2 + 1)[:, None]
    cut = np.where(x > capacity - e, capacity, np.where(x < e, 0, x))  # small ones vanish, large ones fill a bin
    best = max(best, int((-(-(cut @ n) // capacity)).max()))
    for k in range(1, 21):  # rounding to multiples of capacity / k
        whole = (x * (k + 1)) % capacity == 0
        scaled = np.where(whole, x * k, (x * (k + 1)) // capacity * capacity)
        best = max(best, -(-int(n @ scaled) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: each size, the largest first, goes to the fullest bin that still takes it.

    Free room is at most capacity, so the bins of each room are a list and a bit mask finds the least room in one step.
    """
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if free > size:
            room[free - size].append(b)
            mask |= 1 << (free - size)
    return bins


def _packer(capacity: int, number: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """Packs one partition; unless last, the emptiest bins of a partition above its bound are left for the next round."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("item", "ascending")])
        sizes = group["length"].to_numpy()
        part = group["part"][0].as_py()
        bins = best_fit_decreasing(sizes, capacity)
        gap = len(bins) - lower_bound(sizes, capacity)
        fill = [int(sizes[b].sum()) for b in bins]
        give = set()
        if gap > 0 and not last:
            short = [b for b in sorted(range(len(bins)), key=fill.__getitem__) if fill[b] < capacity]
            give = set(short[: max(4 * gap, len(bins) // 50 + 1)])
        sequence, offset, left = (np.zeros(len(sizes), t) for t in (np.int64, np.int64, bool))
        for b, items in enumerate(bins):
            sequence[items] = (1 << 62) | (number << 56) | (part << 20) | b
            offset[items] = np.concatenate([[0], np.cumsum(sizes[items])[:-1]])
            left[items] = b in give
        added = {"sequence_id": sequence, "offset": offset, "gap": np.full(len(sizes), gap), "left": left}
        out = group.drop_columns(["part"])
        for name, values in added.items():
            out = out.append_column(name, pa.array(values))
        return out

    return pack


def pack(items: DataFrame, capacity: int = 1024, partition_items: int = 2048, rounds: int = 8) -> DataFrame:
    """items of pieces() with sequence_id, offset and gap.  Partitions hold about partition_items, whatever the input's size.

    A round packs what partitions above their bound gave up before.  When that has shrunk to nothing, or to no less than in
    the round before, or after `rounds` rounds, all that is left is placed; its gap stays in the result.
    """
    full = items.where(F.col("length") == capacity).withColumn("sequence_id", F.col("item")).withColumn("offset", F.lit(0).cast("long")).withColumn("gap", F.lit(0).cast("long"))
    done, todo, before = [full], items.where(F.col("length") < capacity), 0
    for number in range(rounds):
        n = todo.count()
        if not n:
            break
        parts = max(1, round(n / partition_items))
        last = number == rounds - 1 or parts == 1 or number > 1 and n >= before
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("item", F.lit(number)), F.lit(parts)))
        packed = kept(dealt.groupBy("part").applyInArrow(_packer(capacity, number, last), PLACED))
        done.append(packed.where("NOT left").drop("left"))
        todo, before = packed.where("left").drop("sequence_id", "offset", "gap", "left"), n
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def certificates(packed: DataFrame) -> DataFrame:
    """gap, sequences: how many sequences come from partitions that are gap bins above their lower bound."""
    return packed.groupBy("gap").agg(F.count_distinct("sequence_id").alias("sequences"))


def pack_documents(documents: DataFrame, path: str, capacity: int = 1024) -> DataFrame:
    """Every document's pieces with their sequence, offset and gap; tokenised once."""
    return pack(kept(pieces(documents, path, capacity)), capacity).drop("item")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: every document's pieces and their places; null texts are their end token alone."""
    return pack_documents(docs, vocabulary())


QUERIES = {"op9_packing": op9_packing}
SQL: dict[str, str] = {}
