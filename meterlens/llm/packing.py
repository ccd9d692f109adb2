"""Best-fit-decreasing packing of tokenized documents into sequences of one length.

Documents longer than a window are cut into full windows first; what is left of them, and every shorter document, goes
into the tightest open window that still has room. A segment tree over the remaining capacities finds that window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from meterlens.llm.common import id_field, text_slices, worker_state
from meterlens.llm.encoding import WordEncoder, tokenizer_path, with_end

#: Room for the sequence number below the number of a partition.
PARTITION_SHIFT = 33


class CapacityTree:
    """Segment tree over remaining capacities 0..size; each leaf holds the open windows with that much room."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, step: int) -> None:
        node = room + self.leaves
        while node:
            self.open[node] += step
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (room, window) with the least room of `length` or more."""
        node = length + self.leaves
        if not self.open[node]:
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not self.open[node]:
                    node += 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length (1..size), longest first; ties keep their order."""
    tree, used = CapacityTree(size), 0
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = tree.take(length)
        if found is None:
            found, used = (size, used), used + 1
        room, w = found
        window[i], offset[i] = w, size - room
        if room > length:
            tree.put(room - length, w)
    return window, offset


def cut_windows(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, start and length of every piece: full windows, then what is left."""
    pieces = -(-counts // size)
    doc = np.repeat(np.arange(len(counts)), pieces)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
    return doc, start, np.minimum(size, counts[doc] - start)


def encoder_of(state, path: str) -> WordEncoder:
    kept = state.value
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def pack_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    sequence_length: int = 1024,
    end_id: int = 0,
    buffer_pieces: int = 100_000,
) -> DataFrame:
    """One row per piece of a document with its place in a packed sequence.

    Every partition packs its own pieces, so nothing is shuffled: full windows leave at once, the rest gathers (five
    numbers each) until `buffer_pieces` are there or the partition ends, and is packed then. A sequence never spans
    partitions; its number starts with that of the partition, so a task that runs again gives the same rows.

    Null and empty texts have the end id alone. Null and repeated ids are packed like any other row. Other columns
    are not read. No rows give no rows.
    """
    state = worker_state(docs)
    out = T.StructType(
        [
            id_field(docs, id_col, "doc_id"),
            *(
                T.StructField(name, T.LongType(), False)
                for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            ),
        ]
    )

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(state, tokenizer_path(tokenizer))
        first = TaskContext.get().partitionId() << PARTITION_SHIFT
        used = 0
        waiting: list[tuple[pa.Array, np.ndarray]] = []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def rows(keys: pa.Array, numbers: np.ndarray, sequence: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys, *map(pa.array, (*numbers, first + sequence, offset))], names)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal used
            if waiting:
                keys, numbers = pa.concat_arrays([k for k, _ in waiting]), np.concatenate([n for _, n in waiting], 1)
                window, offset = best_fit_decreasing(numbers[1], sequence_length)
                yield rows(keys, numbers, used + window, offset)
                used += int(window.max()) + 1
                waiting.clear()

        for batch in text_slices(batches, text_col):
            ids, counts = with_end(*encoder.encode(batch.column(text_col)), end_id)
            doc, start, length = cut_windows(counts, sequence_length)
            at = (np.cumsum(counts) - counts)[doc] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            numbers = np.stack([start, length, np.array(crc, np.int64), counts[doc]])
            keys = batch.column(id_col).take(pa.array(doc))
            full = length == sequence_length
            n = int(full.sum())
            if n:
                yield rows(keys.filter(pa.array(full)), numbers[:, full], used + np.arange(n), np.zeros(n, np.int64))
                used += n
            waiting.append((keys.filter(pa.array(~full)), numbers[:, ~full]))
            if sum(len(k) for k, _ in waiting) >= buffer_pieces:
                yield from flush()
        yield from flush()

    return docs.select(id_col, text_col).mapInArrow(pack, out)
