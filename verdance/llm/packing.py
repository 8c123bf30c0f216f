"""Packing documents into token windows by sum-of-squares.

Each task packs its own documents and holds one array ``level[h]``: how many
open windows are filled to ``h`` ids.  A document's full windows are cut off
first; its remainder goes to the level at which the sum of the squared counts
becomes least (a new window counts as level 0).  When a task ends, what is
still open is cut up: pieces move from the emptiest windows into the fullest
until windows are full, and the last ids are cut into windows of powers of two.
So a task pads nothing, and there is no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm import kernels as K
from verdance.llm import tables, token_ids

Piece = tuple[int, int, int]  # document's place in the task, start, length

#: Bytes of words that a worker keeps encoded, about, and of texts that it encodes together.  Workers outlive tasks,
#: and those of one executor share its memory with what earlier stages of a pipeline have left there.
CACHE, STEP = 64 << 20, 1 << 20


class Levels:
    """Open windows by fill level; least sum of squares picks the level."""

    def __init__(self, window: int):
        self.window = window
        self.level = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def place(self, piece: Piece) -> list[Piece] | None:
        """Puts a piece of fewer ids than a window; a window that is full comes back."""
        size, window = piece[2], self.window
        level = self.level
        # Change of the sum of squares for each level the piece can go to.
        change = 2 * level[size : window + 1] + 1
        change[-1] = 0
        change[1:] += 1 - 2 * level[1 : window - size + 1]
        change[1:][level[1 : window - size + 1] == 0] = np.iinfo(np.int64).max
        at = int(np.argmin(change))
        if at:
            level[at] -= 1
            own = self.open[at].pop()
        else:
            own = []
        own.append(piece)
        if at + size == window:
            return own
        level[at + size] += 1
        self.open[at + size].append(own)
        return None

    def flush(self) -> Iterator[list[Piece]]:
        """The open windows, cut so that all are full but some of powers of two."""
        left = [own for fill in range(self.window, 0, -1) for own in self.open[fill]]
        spare: list[Piece] = []
        while left:
            own = left.pop(0)
            room = self.window - sum(p[2] for p in own)
            while room and (spare or left):
                if not spare:
                    spare = left.pop()
                doc, start, length = spare.pop()
                take = min(room, length)
                own.append((doc, start, take))
                room -= take
                if take < length:
                    spare.append((doc, start + take, length - take))
            if room:
                yield from self._powers_of_two(own)
            else:
                yield own
        if spare:
            yield from self._powers_of_two(spare)

    def _powers_of_two(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        todo = list(reversed(pieces))
        left = sum(p[2] for p in pieces)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            own = []
            while room:
                doc, start, length = todo.pop()
                take = min(room, length)
                own.append((doc, start, take))
                room -= take
                if take < length:
                    todo.append((doc, start + take, length - take))
            yield own


def pack(
    docs: DataFrame,
    window: int = 2048,
    vocabulary: str | None = None,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are the tokeniser's and then ``end_id``, so a null or empty
    text has that one id.  Null ids and repeated rows are documents of their
    own.  ``sequence_id`` is the task's number times 2**40 plus a count, unique
    over the table; offsets in a sequence run from 0 without gaps.  An empty
    table gives no rows.  Memory: the open windows of a task hold positions and
    checksummed bytes of at most ``window`` ids each, and the worker ``CACHE``
    bytes of encoded words or those of one ``STEP``."""
    path = vocabulary or token_ids.default_vocabulary()
    kinds = dict(docs.dtypes)
    schema = (
        f"_id {kinds[id_col]}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long"
    )
    end = np.array([end_id], "<u4").tobytes()

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, levels = token_ids.encoder(path, CACHE), Levels(window)
        base, count = TaskContext.get().partitionId() << 40, 0
        # Of each document with an open piece: id, number of ids, start and bytes of its remainder.
        held: dict[int, tuple[object, int, int, bytes]] = {}
        out: list[list] = [[] for _ in range(7)]
        place = 0

        def emit(own: list[Piece], last: bool = False) -> None:
            nonlocal count
            offset = 0
            for doc, start, length in own:
                key, total, at, ids = held[doc]
                crc = zlib.crc32(memoryview(ids)[4 * (start - at) : 4 * (start - at + length)])
                for column, value in zip(out, (key, start, length, crc, total, base + count, offset)):
                    column.append(value)
                offset += length
                if not last:
                    del held[doc]
            count += 1

        def rows() -> pa.RecordBatch:
            arrays = [pa.array(out[0], kind)] + [pa.array(c, pa.int64()) for c in out[1:]]
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        kind = pa.int64()
        for batch in batches:
            kind = batch.column("_id").type
            for key, ids in token_ids.encoded_rows(encoder, batch, STEP):
                ids += end
                total = len(ids) // 4
                whole = total - total % window
                for start in range(0, whole, window):
                    held[place] = (key, total, start, ids[4 * start : 4 * (start + window)])
                    emit([(place, start, window)])
                if whole < total:
                    held[place] = (key, total, whole, ids[4 * whole :])
                    full = levels.place((place, whole, total - whole))
                    if full:
                        emit(full)
                    place += 1
                if len(out[0]) >= 8192:
                    yield rows()
        for own in levels.flush():
            emit(own, last=True)
        if out[0]:
            yield rows()

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tables.read(spark, sf_dir, "documents").select("doc_id", "text"))
