"""Alignment of two tokenizers over the same texts, by lockstep merging of their token ends.

The ends of the tokens of both sides are two ascending lists of byte offsets; where they meet, a group ends and the two
tokens that end there are linked. All texts of a batch are merged at once: one NumPy vector holds a pointer into either
list for every text (and for every stretch of `lane_bytes` of a long one), each step moves the side that is behind, or
both where they meet, and texts at their end leave the vector.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.llm.common import cut, fresh, id_field, text_slices, worker_state
from meterlens.llm.encoding import WordEncoder, tokenizer_path

COMMA, BAR, SEMICOLON, NOTHING = range(4)


def byte_level_bytes(tokenizer) -> list[bytes]:
    """The bytes of every entry of a byte-level vocabulary, whose characters stand for one byte each."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    entries = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in entries]


def piece_bytes(model) -> list[bytes]:
    """The bytes of every piece of a sentencepiece vocabulary: U+2581 is a space, byte pieces are their byte."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [
        bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
    ]


def meeting_ends(a: np.ndarray, b: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in `a` and in `b`, both ascending, of the values they share; `edges` are the values where lanes end.

    A lane is merged independently of the others, since equal values lie in the same one.
    """
    at_a, at_b = np.searchsorted(a, edges, "right"), np.searchsorted(b, edges, "right")
    i, j = np.append(0, at_a[:-1]), np.append(0, at_b[:-1])
    live = (i < at_a) & (j < at_b)
    i, j, stop_i, stop_j = i[live], j[live], at_a[live], at_b[live]
    links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(i):
        x, y = a[i], b[j]
        behind_a, behind_b = x <= y, y <= x
        met = behind_a & behind_b
        links_a.append(i[met])
        links_b.append(j[met])
        i = i + behind_a
        j = j + behind_b
        live = (i < stop_i) & (j < stop_j)
        if not live.all():
            i, j, stop_i, stop_j = i[live], j[live], stop_i[live], stop_j[live]
    return np.sort(np.concatenate(links_a)), np.sort(np.concatenate(links_b))


def _flat(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all entries in a row, where each begins, and its size."""
    sizes = np.array([len(x) for x in entries], np.int64)
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(sizes) - sizes, sizes


def list_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that the lists of a slice have `limit` members at most, or the slice is a single row."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column(column)), 0), np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class Aligner:
    """Both tokenizers, loaded once a worker."""

    def __init__(self, first: str, second: str, lane_bytes: int):
        import sentencepiece

        self.encoder = WordEncoder(first, max_parts=200_000)
        self.encoder.tokenizer.encode_special_tokens = True
        self.model = sentencepiece.SentencePieceProcessor(model_file=second)
        self.table_a, self.table_b = _flat(byte_level_bytes(self.encoder.tokenizer)), _flat(piece_bytes(self.model))
        self.sizes_a, self.sizes_b = self.table_a[2], self.table_b[2]
        self.base = len(self.sizes_b)
        top = max(len(self.sizes_a), self.base)
        self.signs = [f"{i}{sign}" for i in range(top) for sign in (",", "|", ";", "")]
        self.lane_bytes = lane_bytes

    def _spelled(self, ids: np.ndarray, counts: np.ndarray, table: tuple, want: list[bytes]) -> np.ndarray:
        """Which texts are what their tokens spell."""
        flat, begin, sizes = table
        lengths = np.fromiter(map(len, want), np.int64, len(want))
        over = lambda x, n: np.diff(np.append(0, np.cumsum(x))[np.append(0, np.cumsum(n))])
        good = over(sizes[ids], counts) == lengths
        ids, counts = ids[np.repeat(good, counts)], counts[good]
        text = np.frombuffer(b"".join([w for w, g in zip(want, good.tolist()) if g]), np.uint8)
        size = sizes[ids]
        at = np.arange(len(text)) + np.repeat(begin[ids] - np.cumsum(size) + size, size)
        good[good] = over(flat[at] != text, lengths[good]) == 0
        return good

    def align(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Tokens of either side and groups of each text, the groups' spelling, and all links as a * base + b."""
        n = len(texts)
        held = np.flatnonzero(np.asarray(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)))
        texts = texts.take(pa.array(held))
        led = pc.binary_join_element_wise("", texts, " ")
        want = led.cast(pa.binary()).to_pylist()
        ids_a, counts_a = self.encoder.encode(led)
        found = self.model.encode(texts.to_pylist(), num_threads=1)
        counts_b = np.fromiter(map(len, found), np.int64, len(found))
        ids_b = np.fromiter(chain.from_iterable(found), np.int64, int(counts_b.sum()))
        good = self._spelled(ids_a, counts_a, self.table_a, want) & self._spelled(ids_b, counts_b, self.table_b, want)
        if not good.all():
            ids_a, ids_b = ids_a[np.repeat(good, counts_a)], ids_b[np.repeat(good, counts_b)]
            counts_a, counts_b, held = counts_a[good], counts_b[good], held[good]
            want = [w for w, g in zip(want, good.tolist()) if g]
        ids_a = ids_a.astype(np.int64)
        n_a, n_b, n_groups = (np.zeros(n, np.int64) for _ in range(3))
        spelled = [""] * n
        if not len(held):
            return n_a, n_b, n_groups, spelled, np.zeros(0, np.int64)
        # The texts stand behind each other, so either side's ends ascend over all of them.
        ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        size = np.fromiter(map(len, want), np.int64, len(want))
        lanes = -(-size // self.lane_bytes)
        step = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes) + 1
        edges = np.repeat(np.cumsum(size) - size, lanes) + np.minimum(step * self.lane_bytes, np.repeat(size, lanes))
        cut_a, cut_b = meeting_ends(ends_a, ends_b, edges)

        is_a, is_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        is_a[cut_a] = is_b[cut_b] = 1
        group_a, group_b = np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b
        place_a = np.arange(len(ids_a)) + np.append(0, cut_b + 1)[group_a]
        place_b = np.arange(len(ids_b)) + np.append(0, cut_a + 1)[group_b + 1]
        sign_b = np.where(is_b, SEMICOLON, COMMA)
        sign_b[np.cumsum(counts_b) - 1] = NOTHING
        signs = np.empty(len(ids_a) + len(ids_b), np.int64)
        signs[place_a] = 4 * ids_a + np.where(is_a, BAR, COMMA)
        signs[place_b] = 4 * ids_b + sign_b
        stops = np.cumsum(counts_a + counts_b)
        for doc, a, b in zip(held.tolist(), (stops - counts_a - counts_b).tolist(), stops.tolist()):
            spelled[doc] = "".join(map(self.signs.__getitem__, signs[a:b].tolist()))
        last = np.append(0, np.cumsum(is_a))[np.cumsum(counts_a)]
        n_a[held], n_b[held], n_groups[held] = counts_a, counts_b, np.diff(last, prepend=0)
        return n_a, n_b, n_groups, spelled, ids_a[cut_a] * self.base + ids_b[cut_b]


def vocabulary_sizes(first: str, second: str) -> tuple[int, int]:
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(first)).get_vocab_size()
    return a, SentencePieceProcessor(model_file=tokenizer_path(second)).get_piece_size()


def aligned_tokens(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    first: str = "byte_bpe_50k.json",
    second: str = "piece_bpe_32k.model",
    lane_bytes: int = 2048,
) -> DataFrame:
    """One row per row: doc_id, tokens of either side, number of groups, the groups, and the links.

    The first tokenizer (byte-level) encodes a space and the text, the second (sentencepiece, which adds that space) the
    text. `groups` spells the ids `a1,a2|b1;a3|b2,b3`; `links` are the pairs of tokens that end together, in order, as
    a * (size of the second vocabulary) + b (int where that is enough, else long). Null and empty texts, and those that their tokens don't spell, have no
    tokens. Null and repeated ids keep their rows; nothing is shuffled; other columns are not read.
    """
    state = worker_state(docs)
    sizes = vocabulary_sizes(first, second)
    small = sizes[0] * sizes[1] < 1 << 31
    out = T.StructType(
        [
            id_field(docs, id_col, "doc_id"),
            *(T.StructField(name, T.LongType(), False) for name in ("n_a", "n_b", "n_groups")),
            T.StructField("groups", T.StringType(), False),
            T.StructField("links", T.ArrayType(T.IntegerType() if small else T.LongType(), False), False),
        ]
    )
    number = np.int32 if small else np.int64

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = state.value
        if (first, second) not in kept:
            kept[first, second] = Aligner(tokenizer_path(first), tokenizer_path(second), lane_bytes)
        for batch in text_slices(batches, "text", 1 << 20):
            n_a, n_b, n_groups, spelled, links = kept[first, second].align(batch.column("text"))
            ends = pa.array(np.append(0, np.cumsum(n_groups)), pa.int32())
            columns = [*map(pa.array, (n_a, n_b, n_groups)), pa.array(spelled, pa.string())]
            lists = pa.ListArray.from_arrays(ends, pa.array(links.astype(number)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, lists], out.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(align, out)


def link_counts(links: DataFrame, base: int) -> DataFrame:
    """(code, n, best) of every different link of the arrays `links`: how often it occurs, and whether no link with the
    same second id occurs more often. Summed within the tasks first, so a common link is one row a task."""
    counts = cut(links.select(F.explode("links").alias("code")).groupBy("code").agg(F.count("*").alias("n")))
    second = F.col("code") % base
    most = counts.groupBy(second.alias("second")).agg(F.max("n").alias("most"))
    return counts.join(most, second == F.col("second")).select("code", "n", (F.col("n") == F.col("most")).alias("best"))


@dataclass(frozen=True)
class HotLinks:
    """The links that occur most often, at most as many as asked for, ascending by code."""

    codes: np.ndarray
    counts: np.ndarray
    best: np.ndarray
    least: int  # every link that occurs this often is here

    @classmethod
    def of(cls, counts: DataFrame, most: int) -> HotLinks:
        level = F.floor(F.log2("n")).cast("int").alias("level")
        sizes = {r["level"]: r["links"] for r in counts.groupBy(level).agg(F.count("*").alias("links")).collect()}
        low = held = 0
        for k in sorted(sizes, reverse=True):
            held += sizes[k]
            if held > most:
                low = k + 1
                break
        table = counts.where(F.col("n") >= 1 << low).toArrow().sort_by("code")
        codes, n, best = (table.column(c).to_numpy() for c in ("code", "n", "best"))
        return cls(codes.astype(np.int64), n.astype(np.int64), best.astype(np.int64), 1 << low)


def with_link_figures(aligned: DataFrame, *, base: int, hot_links: int = 300_000) -> DataFrame:
    """The rows of `aligned` (a stored table) without `links`, with n_links, n_best and count_sum.

    n_best are the links that are a best one for their second id, count_sum is the sum of the links' counts, both by
    counts over the whole table. The commonest links, `hot_links` at most and so of a bounded size, go to the tasks and
    are summed up where the rows are; only the rarer ones are joined with their counts.
    """
    counts = cut(link_counts(aligned, base))
    hot = HotLinks.of(counts, hot_links)
    shared = aligned.sparkSession.sparkContext.broadcast((hot.codes, hot.counts, hot.best))
    row = fresh(aligned, "row")
    others = [c for c in aligned.columns if c != "links"]
    kept = [T.StructField(c, aligned.schema[c].dataType) for c in others]
    figures = [T.StructField(c, T.LongType()) for c in ("n_links", "n_best", "count_sum")]
    out = T.StructType([*kept, *figures, T.StructField("rare", T.ArrayType(T.LongType()))])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_codes, known_counts, known_best = shared.value
        for batch in list_slices(batches, "links"):
            lists = batch.column("links")
            codes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.append(0, np.cumsum(np.asarray(pc.list_value_length(lists), np.int64)))
            at = np.minimum(np.searchsorted(known_codes, codes), max(len(known_codes) - 1, 0))
            known = known_codes[at] == codes if len(known_codes) else np.zeros(len(codes), bool)
            n = np.zeros(len(codes), np.int64)
            best = np.zeros(len(codes), np.int64)
            n[known], best[known] = known_counts[at[known]], known_best[at[known]]
            over = lambda x: np.diff(np.append(0, np.cumsum(x))[ends])
            rare = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(~known))[ends], pa.int32()), pa.array(codes[~known])
            )
            sums = [pa.array(x) for x in (np.diff(ends), over(best), over(n))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *sums, rare], out.names)

    # Rows are numbered before they are stored, so the numbers stay when a task runs again.
    numbered = cut(aligned.mapInArrow(add, out).withColumn(row, F.monotonically_increasing_id()))
    rarely = numbered.select(row, F.explode("rare").alias("code")).join(counts.where(F.col("n") < hot.least), "code")
    more = rarely.groupBy(row).agg(F.sum(F.col("best").cast("long")).alias("more_best"), F.sum("n").alias("more_sum"))
    added = numbered.join(more, row, "left")
    return added.select(
        *others,
        "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
    )


def alignment_figures(
    docs: DataFrame,
    *,
    hot_links: int = 300_000,
    first: str = "byte_bpe_50k.json",
    second: str = "piece_bpe_32k.model",
    **options,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and the digest of the groups ('' without tokens).

    Texts are encoded once; what is stored for the counts is four to eight bytes a link before compression.
    """
    found = aligned_tokens(docs, first=first, second=second, **options)
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = cut(found.select("doc_id", "n_a", "n_b", "n_groups", digest, "links"))
    figures = with_link_figures(aligned, base=vocabulary_sizes(first, second)[1], hot_links=hot_links)
    return figures.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
