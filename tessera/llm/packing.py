"""Best-fit packing of tokenised documents into sequences of bounded length.

1. Each partition tokenises its documents and cuts those longer than a sequence into pieces.
2. Each partition packs its pieces best-fit, longest first, CHUNK at a time. Bins with at most SLACK free tokens are done.
3. Underfull bins go on as items: a tree of FAN children a node merges them best-fit, round by round, up to one node. A node
   hands on the CARRY emptiest bins; the fuller ones are then final. That leaves as many merges possible at any size: of the bins that one best fit
   makes, any two overflow a sequence together (the later one was opened for what did not fit), so at most one is at most
   half full, and only such a small bin can ever join another. A node's other bins can only take in small bins from elsewhere, at most
   FAN in each round above it, and if any bin has room for one, one of the emptiest has; CARRY is far above FAN x rounds.
   Each round's moves are a small table; a piece's place is the sum of its moves.

Only lengths travel through the tree; token ids are never shuffled. Words are tokenised once per worker and
remembered, which gives the tokenizer's own result as no token of this vocabulary spans white space.

Defined cases: null text is empty and still gives its end token; equal rows give pieces of their own; an empty table
gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, sliced, table

CAPACITY, END = 4096, 1
SLACK, CHUNK, FAN, CARRY, REMEMBERED = 8, 200_000, 8, 2_000, 200_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: How byte-level BPE writes bytes: the printed ones as themselves, the others from code point 256 on.
_BYTES = {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class WordTokenizer(dict):
    """Ids (little-endian, 32-bit) of words by a tokenizer whose tokens never span white space; ids() has those of a text.

    A word's letters go straight to the tokenizer's BPE model, in the byte alphabet that its pre-tokenizer writes; ASCII
    signs before and after them are tokens of their own, and are learnt apart. Words with anything else in them, or
    that normalising could change in other ways than to lower case, go through the whole tokenizer. The memory has two
    generations of at most REMEMBERED words: a word that the older one has moves on when it is met again.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.whole, self.remembered, self.older = Tokenizer.from_file(path), remembered, {}
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.tokenize = self.whole.model.tokenize
        self.marks: dict[str, bytes] = {"": b""}

    def _alone(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _mark(self, signs: str) -> bytes:
        if signs not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {"": b""}
            self.marks[signs] = self._alone(signs)
        return self.marks[signs]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.remembered:
            self.older = dict(self)
            self.clear()
        if (ids := self.older.get(word)) is None:
            ids = self._learnt(word)
        self[word] = ids
        return ids

    def _learnt(self, word: str) -> bytes:
        before = after = ""
        core = word
        if not word.isalpha():
            tail = word.lstrip(_SIGNS)
            core = tail.rstrip(_SIGNS)
            before, after = word[: len(word) - len(tail)], tail[len(core) :]
            if not core.isalpha() or before.endswith("'"):  # 's and its like are tokens
                return self._alone(word)
        low = core.lower()
        if not core.isascii():
            if not low.isalpha() or "\u03a3" in core or not is_normalized("NFC", core):
                return self._alone(word)
            low = low.encode().decode("latin-1").translate(_BYTES)
        ids = array("I", [t.id for t in self.tokenize(low)]).tobytes()
        return self._mark(before) + ids + self._mark(after) if before or after else ids

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special) or any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split() takes those four for white space
            return self._alone(text)
        return b"".join(map(self.__getitem__, text.split()))


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first into the fullest bin with room, and the bins' fill."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has r free
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fits := rooms >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if room := room - n:
            with_room[room].append(b)
            rooms |= 1 << room
    return bins, offsets, np.array(fill, np.int64)


def _carried(fill: np.ndarray, capacity: int) -> np.ndarray:
    """Which bins go on to the next round."""
    out, under = np.zeros(len(fill), bool), np.flatnonzero(fill < capacity - SLACK)
    out[under[np.argsort(fill[under], kind="stable")[:CARRY]]] = True
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for each piece of each document; ids are little-endian 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, wide = WordTokenizer(tokenizer), np.array([END], "<u4").tobytes(), 4 * capacity
        for b in sliced(batches, "text"):
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = words.ids(text.as_py() or "") + end
                for at in range(0, len(ids), wide):
                    part = ids[at : at + wide]
                    out.append((doc, at // wide, at // 4, len(part) // 4, zlib.crc32(part), part))
            doc, piece, start, length, crc, part = zip(*out) if out else [()] * 6
            made = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*made, pa.array(part, pa.binary())] if with_ids else made, [*names, "ids"] if with_ids else names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECE + ", ids binary" * with_ids)


def _local(found: DataFrame, capacity: int) -> DataFrame:
    """found with bin, offset, fill, carried and node (the partition), packed best-fit CHUNK pieces at a time."""
    columns = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, made, held = TaskContext.get().partitionId(), 0, []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows = pa.Table.from_batches(held)
            bins, offsets, fill = best_fit(rows.column("length").to_numpy(), capacity)
            named = [(node << 36) + made + bins, offsets, fill[bins], _carried(fill, capacity)[bins], np.full(len(bins), node, np.int32)]
            made += len(fill)
            for name, x in zip(("bin", "offset", "fill", "carried", "node"), named):
                rows = rows.append_column(name, pa.array(x))
            yield from rows.to_batches(10_000)

        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= CHUNK:
                yield from packed()
                held = []
        if sum(map(len, held)):
            yield from packed()

    kinds = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in columns)
    return found.mapInArrow(run, f"{kinds}, bin long, offset long, fill long, carried boolean, node int")


def _merged(bins: DataFrame, capacity: int) -> DataFrame:
    """(bin, fill, node) of underfull bins, best-fit merged within each node: (bin, to, shift, fill, carried, node)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("fill", "descending"), ("bin", "ascending")])
        name = group.column("bin").to_numpy()
        into, shift, fill = best_fit(group.column("fill").to_numpy(), capacity)
        heads = np.empty(len(fill), np.int64)
        heads[into[::-1]] = name[::-1]
        made = {"bin": name, "to": heads[into], "shift": shift, "fill": fill[into], "carried": _carried(fill, capacity)[into], "node": np.full(len(name), group.column("node")[0].as_py(), np.int32)}
        return pa.table({k: pa.array(v) for k, v in made.items()})

    return bins.groupBy("node").applyInArrow(run, "bin long, to long, shift long, fill long, carried boolean, node int")


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found (rows with a length of at most capacity) with sequence_id and offset; found should be a table, as from cut()."""
    local = cut(_local(found, capacity), "packing-local")
    width = (local.agg(F.max("node")).first()[0] or 0) + 1
    carried = local.where("carried").select("bin", "fill", "node").distinct()
    moves: DataFrame | None = None
    while True:
        width = -(-width // FAN)
        step = cut(_merged(carried.withColumn("node", F.floor(F.col("node") / FAN).cast("int")), capacity), "packing-round")
        if moves is None:
            moves = step.select("bin", "to", "shift")
        else:
            then = step.select(F.col("bin").alias("to"), F.col("to").alias("to2"), F.col("shift").alias("shift2"))
            moves = moves.join(then, "to", "left").select("bin", F.coalesce("to2", "to").alias("to"), (F.col("shift") + F.coalesce("shift2", F.lit(0))).alias("shift"))
        if width == 1:
            break
        carried = step.where("carried").select(F.col("to").alias("bin"), "fill", "node").distinct()
    moved = local.join(moves, "bin", "left")
    return moved.select(*found.columns, F.coalesce("to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts): each sequence's token ids, and where its pieces begin. packed needs the pieces' ids.

    A group is one sequence, so it holds at most its capacity in tokens.
    """
    rows = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(rows.alias("r")).select("sequence_id", F.unhex(F.array_join("r.ids", "")).alias("ids"), F.col("r.offset").alias("starts"))


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for each piece of each document."""
    return pack(cut(pieces(docs, tokenizer, capacity, with_ids), "packing-pieces"), capacity)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), word_tokenizer())
