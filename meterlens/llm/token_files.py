"""Packed token ids as binary matrices with segment ends and position resets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from meterlens.llm.common import text_slices, worker_state
from meterlens.llm.encoding import tokenizer_path, with_end
from meterlens.llm.packing import PARTITION_SHIFT, best_fit_decreasing, cut_windows, encoder_of

BLOCK = (
    "block_id long, n_sequences int, sequence_length int, id_bytes int, n_ids long, ids binary, cu_seqlens binary, positions binary, "
    "segment_docs array<{id}>, segment_starts array<long>"
)


def packed_blocks(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    sequence_length: int = 2048,
    end_id: int = 50256,
    pad_id: int = 50256,
    rows_per_block: int = 16,
    buffer_ids: int = 2_000_000,
) -> DataFrame:
    """Blocks of up to `rows_per_block` packed sequences, lossless and ready to be mapped into memory.

    `ids` is a row-major little-endian matrix of unsigned numbers of `id_bytes` bytes (two where the vocabulary allows,
    else four), padded with `pad_id`. `cu_seqlens` holds the cumulative
    ends of all segments of the flattened matrix from 0 on (signed 32-bit), one padding segment a row where a row isn't
    full. `positions` holds the flat positions where position ids start at 0 again: the segment starts. Segment
    i belongs to `segment_docs[i]` and begins there at `segment_starts[i]`; padding has a null document and start -1.

    Documents end with `end_id`; longer ones are cut into full windows and a rest without losing an id. Each
    partition packs by best fit decreasing over a segment tree of capacities, in buffers of about `buffer_ids` ids, and
    shuffles nothing. Null and empty texts give the end id alone; no rows give no blocks; other columns are not read.
    """
    state = worker_state(docs)
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(state, tokenizer_path(tokenizer))
        top = max(encoder.tokenizer.get_vocab_size() - 1, end_id, pad_id)
        number = np.dtype("<u2" if top < 1 << 16 else "<u4")
        first = TaskContext.get().partitionId() << PARTITION_SHIFT
        made = 0
        keys: list[pa.Array] = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # start, length, ids
        held = 0

        def blocks() -> Iterator[pa.RecordBatch]:
            nonlocal made, held, keys, parts
            if not keys:
                return
            key = pa.concat_arrays(keys)
            start, length, ids = (np.concatenate(x) for x in zip(*parts))
            keys, parts, held = [], [], 0  # what was gathered goes before the matrices come
            window, offset = best_fit_decreasing(length, sequence_length)
            order = np.lexsort((offset, window))
            begin = np.cumsum(length) - length
            n_windows = int(window.max()) + 1
            for low in range(0, n_windows, rows_per_block):
                mine = order[np.searchsorted(window[order], low) : np.searchsorted(window[order], low + rows_per_block)]
                n = min(rows_per_block, n_windows - low)
                matrix = np.full(n * sequence_length, pad_id, number)
                flat = (window[mine] - low) * sequence_length + offset[mine]
                for f, b, w in zip(flat.tolist(), begin[mine].tolist(), length[mine].tolist()):
                    matrix[f : f + w] = ids[b : b + w]
                ends = flat + length[mine]
                fill = np.zeros(n, np.int64)
                np.maximum.at(fill, (window[mine] - low), ends - (window[mine] - low) * sequence_length)
                short = np.flatnonzero(fill < sequence_length)
                begins = np.concatenate([flat, short * sequence_length + fill[short]])
                where = np.argsort(begins, kind="stable")
                segments = pa.concat_arrays([key.take(pa.array(mine)), pa.nulls(len(short), key.type)])
                starts = np.concatenate([start[mine], np.full(len(short), -1)])[where]
                positions = begins[where]
                cu = np.append(positions, n * sequence_length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([first + made]),
                        pa.array([n], pa.int32()),
                        pa.array([sequence_length], pa.int32()),
                        pa.array([number.itemsize], pa.int32()),
                        pa.array([int(length[mine].sum())]),
                        pa.array([matrix.tobytes()], pa.binary()),
                        pa.array([cu.astype("<i4").tobytes()], pa.binary()),
                        pa.array([positions.astype("<i4").tobytes()], pa.binary()),
                        pa.ListArray.from_arrays(pa.array([0, len(where)], pa.int32()), segments.take(pa.array(where))),
                        pa.ListArray.from_arrays(pa.array([0, len(where)], pa.int32()), pa.array(starts)),
                    ],
                    [c.split()[0] for c in BLOCK.split(", ")],
                )
                made += 1

        for batch in text_slices(batches, text_col, 2 << 20):
            ids, counts = with_end(*encoder.encode(batch.column(text_col)), end_id)
            doc, start, length = cut_windows(counts, sequence_length)
            keys.append(batch.column(id_col).take(pa.array(doc)))
            parts.append((start, length, ids.astype(number)))
            held += len(ids)
            if held >= buffer_ids:
                yield from blocks()
        yield from blocks()

    return docs.select(id_col, text_col).mapInArrow(pack, BLOCK.format(id=kind))


def write_blocks(blocks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write blocks below `path` through Spark's own commit, so that tasks that ran twice leave one copy."""
    blocks.write.mode(mode).option("compression", "zstd").parquet(path)


def read_block(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id matrix, cumulative segment ends and position ids (same shape as the matrix) of one block."""
    ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}").reshape(row["n_sequences"], row["sequence_length"])
    cu = np.frombuffer(row["cu_seqlens"], "<i4")
    starts = np.frombuffer(row["positions"], "<i4")
    positions = np.arange(ids.size) - np.repeat(starts, np.diff(cu))
    return ids, cu, positions.reshape(ids.shape)
