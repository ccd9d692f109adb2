"""Periodic runs of words: maximal repetitions found through suffix trees of a document and of its reversal.

Every run has a root that is a Lyndon word for one of the two orders of the words, and it starts where the next smaller
(or next greater) suffix lies one period on. The leaves of a suffix tree give the order of the suffixes, so these
candidates follow from it; each is extended both ways by the longest common extension of two positions, a lowest common
ancestor that range minima over the Euler tour answer. Trees are built by Ukkonen's method.

Only what can hold a run goes into a tree: all words of a run of `least` words or more lie in windows of least / 2 words
that come twice in their stretch, so stretches without such windows are left out beforehand.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from meterlens.llm.common import WORD_GAP, id_field, text_slices

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ROUNDS = 3
RUN = T.StructType([T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")])


class SuffixTree:
    """Ukkonen's tree of numbers whose last is unique, kept as suffix ranks and the depths along the Euler tour."""

    def __init__(self, seq: list[int]):
        self.n = len(seq)
        starts, stops, edges, suffix = self._build(seq, max(seq) + 1)
        self._walk(starts, stops, edges, suffix, max(seq) + 1)

    @staticmethod
    def _build(seq: list[int], base: int):
        n = len(seq)
        starts, stops, links, suffix = [0], [0], [0], [-1]
        edges: dict[int, int] = {}
        node = edge = along = waiting = 0
        for at, symbol in enumerate(seq):
            split_node = 0
            waiting += 1
            while waiting:
                if not along:
                    edge = at
                key = node * base + seq[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(starts)
                    starts.append(at)
                    stops.append(n)
                    links.append(0)
                    suffix.append(at - waiting + 1)
                    if split_node:
                        links[split_node] = node
                        split_node = 0
                else:
                    begin = starts[child]
                    length = stops[child] - begin
                    if along >= length:
                        edge += length
                        along -= length
                        node = child
                        continue
                    if seq[begin + along] == symbol:
                        along += 1
                        if split_node:
                            links[split_node] = node
                        break
                    inner = len(starts)
                    middle = begin + along
                    edges[key] = inner
                    starts += (begin, at)
                    stops += (middle, n)
                    links += (0, 0)
                    suffix += (-1, at - waiting + 1)
                    starts[child] = middle
                    edges[inner * base + seq[middle]] = child
                    edges[inner * base + symbol] = inner + 1
                    if split_node:
                        links[split_node] = inner
                    split_node = inner
                waiting -= 1
                if node:
                    node = links[node]
                elif along:
                    along -= 1
                    edge = at - waiting + 1
        return starts, stops, edges, suffix

    def _walk(self, starts, stops, edges, suffix, base: int) -> None:
        """Depth first, children by their first symbol: depths of the tour, and where in it each suffix comes first."""
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        children = np.fromiter(edges.values(), np.int64, len(edges))
        order = np.argsort(keys, kind="stable")
        ordered = children[order].tolist()
        first = np.searchsorted(keys[order] // base, np.arange(len(starts) + 1)).tolist()
        upto = first[1:]
        width = (np.array(stops) - np.array(starts)).tolist()
        depth = [0] * len(starts)
        tour, place = [0], [0] * self.n
        path, node = [], 0
        while True:
            if first[node] < upto[node]:
                child = ordered[first[node]]
                first[node] += 1
                here = depth[node] + width[child]
                if suffix[child] >= 0:
                    place[suffix[child]] = len(tour)
                    tour += (here, depth[node])
                else:
                    depth[child] = here
                    path.append(node)
                    node = child
                    tour.append(here)
            elif path:
                node = path.pop()
                tour.append(depth[node])
            else:
                break
        self.tour, self.place = np.array(tour, np.int32), np.array(place, np.int64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of the suffixes a and b (different ones), for all pairs at once.

        The levels of the table of range minima are answered as they are made, so only one is held.
        """
        low, high = np.minimum(self.place[a], self.place[b]), np.maximum(self.place[a], self.place[b])
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(a), np.int64)
        minima = self.tour
        for k in range(int(level.max(initial=-1)) + 1):
            if k:
                half = 1 << (k - 1)
                minima = np.minimum(minima[:-half], minima[half:])
            mine = np.flatnonzero(level == k)
            out[mine] = np.minimum(minima[low[mine]], minima[high[mine] - (1 << k) + 1])
        return out


def _next_beyond(order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For every place the next place with a smaller, and with a greater, number (the length where there is none)."""
    n = len(order)
    smaller, greater = [n] * n, [n] * n
    down, up = [], []
    for at, value in enumerate(order):
        while down and order[down[-1]] > value:
            smaller[down.pop()] = at
        while up and order[up[-1]] < value:
            greater[up.pop()] = at
        down.append(at)
        up.append(at)
    return np.array(smaller), np.array(greater)


def runs_of(seq: list[int], least: int) -> np.ndarray:
    """(start, length, period) of the runs of max(least, 2 * period) numbers or more, by start and period.

    The last number is unique. A run's period is its smallest, and neither neighbour keeps it.
    """
    n = len(seq)
    forward = SuffixTree(seq)
    beyond = _next_beyond(forward.place.tolist())
    start = np.tile(np.arange(n), 2)
    period = np.concatenate(beyond) - start
    held = start + period < n
    start, period = start[held], period[held]
    after = forward.common(start, start + period)
    del forward
    backward = SuffixTree([*seq[-2::-1], seq[-1]])
    before = np.zeros(len(start), np.int64)
    inner = np.flatnonzero(start > 0)
    before[inner] = backward.common(n - 1 - start[inner], n - 1 - start[inner] - period[inner])
    length = before + period + after
    found = length >= np.maximum(least, 2 * period)
    return np.unique(np.stack([(start - before)[found], period[found], length[found]], 1), axis=0)[:, [0, 2, 1]]


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which keys come twice or more."""
    order = np.argsort(keys)
    equal = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][equal]] = True
    out[order[:-1][equal]] = True
    return out


def repeating_stretches(hashes: np.ndarray, counts: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(document, first word, word behind) of all stretches that can hold a run, for the words of several documents.

    Equal words have equal hashes; what unequal words with equal hashes add costs time only.
    """
    width = (least + 1) // 2
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    if len(hashes) < width:
        return []
    n_windows = len(hashes) - width + 1
    keys = np.zeros(n_windows, np.uint64)
    for k in range(width):
        keys = keys * _MIX + hashes[k : k + n_windows]
        keys ^= keys >> np.uint64(31)
    at = np.flatnonzero(doc[:n_windows] == doc[width - 1 :])
    part, cover = doc, np.zeros(0, bool)
    for _ in range(_ROUNDS):
        kept = at[_twice(keys[at] + part[at].astype(np.uint64) * _MIX)]
        edge = np.zeros(len(hashes) + 1, np.int32)
        np.add.at(edge, kept, 1)
        np.add.at(edge, kept + width, -1)
        cover = np.cumsum(edge[:-1]) > 0
        fresh_part = np.ones(len(hashes), bool)
        fresh_part[1:] = (cover[1:] != cover[:-1]) | (doc[1:] != doc[:-1])
        part = np.cumsum(fresh_part)
        if len(kept) == len(at) or not len(kept):
            break
        at = kept
    begins = np.flatnonzero(fresh_part)
    stops = np.append(begins[1:], len(hashes))
    held = cover[begins] & (stops - begins >= least)
    owner = doc[begins[held]]
    shift = (ends - counts)[owner]
    return list(zip(owner.tolist(), (begins[held] - shift).tolist(), (stops[held] - shift).tolist()))


def document_runs(words: list[bytes], stretches: list[tuple[int, int]], least: int) -> np.ndarray:
    """The runs of a document, whose stretches stand in one sequence with unique numbers between them."""
    known: dict[bytes, int] = {}
    seq, origin = [], []
    for k, (a, b) in enumerate(stretches):
        seq += [known.setdefault(w, len(known)) for w in words[a:b]]
        seq.append(-1 - k)
        origin.append(np.arange(a, b + 1))
    top = len(known)
    found = runs_of([s if s >= 0 else top - 1 - s for s in seq], least)
    found[:, 0] = np.concatenate(origin)[found[:, 0]]
    return found


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 12) -> DataFrame:
    """One row per row: doc_id, the runs of its text by start and period, and the text with each run's repeats dropped.

    Words are runs without ASCII white space, numbered from 0. A run is a stretch of max(least_words, 2 * period) words
    or more in which words one period apart are equal, that no smaller period has and no neighbouring word extends. A
    word is dropped from `collapsed` if a run holds it behind its first period; the words kept are joined by one space.

    Nothing is shuffled. Null and empty texts have no runs and an empty `collapsed`. Null and repeated ids keep their
    rows; other columns are not read. A task holds one slice of texts and the trees of one document, about 400 bytes for
    each word of its repeating stretches.
    """
    out = T.StructType(
        [
            id_field(docs, id_col, "doc_id"),
            T.StructField("runs", T.ArrayType(RUN, False), False),
            T.StructField("collapsed", T.StringType(), False),
        ]
    )

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", 2 << 20):
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
            words = [t.split() for t in texts]
            counts = np.fromiter(map(len, words), np.int64, len(words))
            hashes = np.fromiter(map(hash, chain.from_iterable(words)), np.int64, int(counts.sum())).view(np.uint64)
            stretches: dict[int, list[tuple[int, int]]] = {}
            for doc, a, b in repeating_stretches(hashes, counts, least_words):
                stretches.setdefault(doc, []).append((a, b))
            tables, sizes = [np.zeros((0, 3), np.int64)], np.zeros(len(words), np.int64)
            for doc in sorted(stretches):
                found = document_runs(words[doc], stretches[doc], least_words)
                if not len(found):
                    continue
                tables.append(found)
                sizes[doc] = len(found)
                edge = np.zeros(len(words[doc]) + 1, np.int64)
                np.add.at(edge, found[:, 0] + found[:, 2], 1)
                np.add.at(edge, found[:, 0] + found[:, 1], -1)
                words[doc] = [words[doc][i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            whole = np.concatenate(tables)
            rows = pa.StructArray.from_arrays([pa.array(whole[:, i]) for i in range(3)], RUN.names)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), rows)
            collapsed = pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, collapsed], out.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(find, out)


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, number of runs, the longest run (first by start, then period), and digests of all runs and of `collapsed`."""
    runs = F.col("runs")
    best = F.array_max(
        F.transform(runs, lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    )
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    digests = found.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(F.array_join(F.transform(runs, line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    period = -F.col("best.period")
    return digests.select(
        "doc_id",
        "n_runs",
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        period.alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def with_repeated_tails(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with a repeating tail in the text of every tenth by the CRC-32 of its decimal id.

    With h the checksum, g = h div 10 and n words, words from a = g % n on repeat the p = 1 + (n - a) div (3 + g % 8)
    words from a on. Texts without words, and rows without an id, stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string"))

    def let(value: Column, use) -> Column:
        return F.element_at(F.transform(F.array(value), use), 1)

    def repeated(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n

        def turned(p: Column) -> Column:
            place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
            return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i))), " ")

        return F.when(n > 0, let(1 + F.floor((n - a) / (3 + g % 8)), turned)).otherwise(F.col(text_col))

    words = F.array_remove(F.split(F.coalesce(text_col, F.lit("")), WORD_GAP), "")
    return docs.withColumn(text_col, F.when(h % 10 == 0, let(words, repeated)).otherwise(F.col(text_col)))
