"""Containment search for benchmark items inside documents: MinHash candidates by size class, verified exactly.

A signature of a whole long document says nothing about a short item in it: their Jaccard similarity is about the ratio
of their sizes. So the min-hashes are taken on the side of the items. Items are partitioned by size; an item keeps the
lowest hashes of its shingles, as many as its class needs so that a document that contains a share of `threshold` of
the item has at least one of them: more than (1 - threshold) of the largest size of the class. Every shingle of every
document is looked up among these, so candidates miss nothing; exact shingles then decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from meterlens.llm.common import id_field, text_slices, texts_of, worker_state

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all characters beyond ASCII."""
    return _WORD.findall(text.lower().encode("utf-8", "surrogatepass"))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, given the hashes of the words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        total = total * _MIX + words[k : len(words) - n + 1 + k]
    total ^= total >> np.uint64(29)
    return total * _MIX


class ItemIndex:
    """Shingles of a block of items and, by size class, their lowest hashes."""

    def __init__(self, items: list[tuple], shingle: int, threshold: float):
        from xxhash import xxh64_intdigest

        self.hash_word, self.threshold = xxh64_intdigest, threshold
        self.items: list[tuple[object, int, set[bytes]]] = []  # id, words a shingle, shingles
        owners: dict[int, dict[int, set[int]]] = {}  # words a shingle -> hash -> items
        for key, text in items:
            words = words_of(text or "")
            if not words:
                continue
            n = min(shingle, len(words))
            texts = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
            hashes = shingle_hashes(self.hashes(words), n).tolist()
            distinct = dict(zip(texts, hashes))
            size_class = 1 << (len(distinct) - 1).bit_length()  # sizes above half of it and up to it
            lowest = sorted(set(distinct.values()))[: int((1 - threshold) * size_class + 1e-9) + 1]
            for h in lowest:
                owners.setdefault(n, {}).setdefault(h, set()).add(len(self.items))
            self.items.append((key, n, set(distinct)))
        self.lookup = {n: (np.array(sorted(by), np.uint64), by) for n, by in owners.items()}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.array(list(map(self.hash_word, words)), np.uint64)

    def search(self, texts: list[str]) -> list[list[tuple[object, int, int]]]:
        """For each text (item, shingles of the item, shingles found) of all items that it contains."""
        split = [words_of(t) for t in texts]
        ends = np.cumsum([len(w) for w in split])
        flat = self.hashes([w for words in split for w in words])
        candidates: list[set[int]] = [set() for _ in texts]
        for n, (known, by) in self.lookup.items():
            found = shingle_hashes(flat, n)
            at = np.searchsorted(known, found)
            hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == found)
            for place, doc in zip(hit.tolist(), np.searchsorted(ends, hit, "right").tolist()):
                if place + n <= ends[doc]:
                    candidates[doc] |= by[int(found[place])]
        out = []
        for words, mine in zip(split, candidates):
            rows = []
            for n in {self.items[i][1] for i in mine}:
                shingles = {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}
                for i in sorted(i for i in mine if self.items[i][1] == n):
                    key, _, wanted = self.items[i]
                    shared = len(wanted & shingles)
                    if shared >= self.threshold * len(wanted) - 1e-9:
                        rows.append((key, len(wanted), shared))
            out.append(rows)
        return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, most_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, fetched partition by partition."""
    block, size = [], 0
    for row in items.select(id_col, text_col).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= most_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _searched(docs: DataFrame, text_col: str, block: list[tuple], shingle: int, threshold: float, schema, emit) -> DataFrame:
    state = worker_state(docs)
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = state.value
        if "index" not in kept:
            kept["index"] = ItemIndex(shared.value, shingle, threshold)
        for batch in text_slices(batches, text_col):
            yield from emit(batch, kept["index"].search(texts_of(batch, text_col)))

    return docs.mapInArrow(search, schema)


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles, containment) of all items held to `threshold` or more.

    Shingles are `shingle` words, as sets; an item with fewer words is one shingle of all of them; items without words
    (or null) are in no document. Documents stay in their partitions; the items go to the tasks in blocks of at most
    `block_bytes` and one item, each with its own pass. Rows with repeated or null ids give their own rows. Items that
    repeat are each found. No items or no documents give no rows.
    """
    doc_field, item_field = id_field(docs, id_col, "doc_id"), id_field(items, item_id_col, "item_id")
    schema = T.StructType(
        [
            doc_field,
            item_field,
            T.StructField("item_shingles", T.LongType(), False),
            T.StructField("shared_shingles", T.LongType(), False),
            T.StructField("containment", T.DoubleType(), False),
        ]
    )

    def emit(batch: pa.RecordBatch, found: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        rows = [(i, *row) for i, mine in enumerate(found) for row in mine]
        if rows:
            at, keys, sizes, shared = zip(*rows)
            names, kind = [f.name for f in schema], _arrow_type(item_field)
            share = np.array(shared) / np.array(sizes)
            columns = [batch.column(id_col).take(pa.array(at)), pa.array(keys, kind), *map(pa.array, (sizes, shared, share))]
            yield pa.RecordBatch.from_arrays(columns, names)

    whole = docs.select(id_col, text_col)
    out = None
    for block in item_blocks(items, item_id_col, item_text_col, block_bytes):
        part = _searched(whole, text_col, block, shingle, threshold, schema, emit)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _arrow_type(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def without_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """The rows of `docs`, all columns, that contain no item; found as by `contained_items`, and nothing shuffled."""

    def emit(batch: pa.RecordBatch, found: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array([not mine for mine in found], pa.bool_()))

    for block in item_blocks(items, item_id_col, item_text_col, block_bytes):
        docs = _searched(docs, text_col, block, shingle, threshold, docs.schema, emit)
    return docs
