"""Mixing sources to target weights, block by block, over output shards drawn down a hypergeometric splitting tree.

Every source is a stream of words cut into blocks, and has an exact quota: so many times all its blocks, then some of
them, the last one cut. A binary tree over the shards deals out these quotas: a node's blocks, counted by source, go to
its two halves as a multivariate hypergeometric draw, as if all blocks had been shuffled and dealt one by one. A shard's
counts, and how many blocks of each source lie in the shards before it, follow from the draws on its way down, so tasks
work them out by themselves. These numbers are disjoint stretches of each source's permuted blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.llm.common import cut

_WORD = r"[^\x20\x09-\x0D]+"
#: More blocks than NumPy draws from at once; blocks are made longer to stay below.
_MOST_BLOCKS = 500_000_000
_BUCKET_WORDS, _BUCKET_ROWS = 1 << 20, 1 << 16


def targets(sizes: Sequence[int], weights: Sequence[float], most_repeats: int = 3) -> np.ndarray:
    """Shares of all words by weight; none is above `most_repeats` times its size, what exceeds that is shared again."""
    caps = most_repeats * np.array(sizes, float)
    weight = np.array(weights, float)
    out, left = np.zeros(len(caps)), np.ones(len(caps), bool)
    total = float(sum(sizes))
    while left.any():
        out[left] = total * weight[left] / weight[left].sum()
        over = left & (out > caps)
        if not over.any():
            break
        out[over] = caps[over]
        total -= float(caps[over].sum())
        left &= ~over
    return out


def permuted(places: np.ndarray, n: int, key: Sequence[int]) -> np.ndarray:
    """Places 0..n-1 under a fixed permutation of these numbers: a Feistel network, walked until it is back in range."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    rounds = np.random.default_rng(list(key)).integers(0, 1 << 63, 4, np.uint64)
    out = places.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> half, out[walking] & mask
        for k in rounds:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        out[walking] = (left << half) | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Quota:
    """What the mix takes of a source: whole rounds over all blocks, then `some` whole blocks and `rest` words of one."""

    words: int
    rounds: int
    some: int
    rest: int

    @classmethod
    def of(cls, words: int, target: float, most_repeats: int, block: int) -> Quota:
        take = min(int(round(target)), most_repeats * words)
        rounds, left = divmod(take, words) if words else (0, 0)
        some = min(left // block, words // block)
        return cls(words, rounds, some, left - some * block)

    def blocks(self, block: int) -> int:
        return self.rounds * -(-self.words // block) + self.some + (self.rest > 0)

    def drawn(self, places: np.ndarray, block: int, key: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block, round and words to take of the quota's blocks with these numbers."""
        every, full = -(-self.words // block), self.words // block
        turn, place = np.divmod(places, max(every, 1))
        chosen, words = np.zeros(len(places), np.int64), np.full(len(places), block)
        for r in np.unique(turn).tolist():
            mine = turn == r
            if r < self.rounds:
                chosen[mine] = permuted(place[mine], every, [*key, r])
            else:  # whole blocks first; what is left comes from the next one, which may be the short last
                last = mine & (place == self.some)
                inner = mine & (place < full)
                chosen[inner] = permuted(place[inner], full, [*key, r])
                chosen[mine & (place >= full)] = full
                words[last] = self.rest
        return chosen, turn, words


class SplittingTree:
    """Counts by source of every shard, and of the shards before it."""

    def __init__(self, totals: np.ndarray, shards: int, seed: int):
        self.totals, self.shards, self.seed = totals, shards, seed
        self.all = int(totals.sum())
        self.path: list[tuple[int, int, np.ndarray, np.ndarray]] = [(0, shards, np.zeros_like(totals), totals)]

    def _room(self, low: int, high: int) -> int:
        return high * self.all // self.shards - low * self.all // self.shards

    def shard(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(blocks of each source before this shard, blocks in it). Nodes shared with the shard asked last are kept."""
        while not self.path[-1][0] <= number < self.path[-1][1]:
            self.path.pop()
        low, high, before, mine = self.path[-1]
        while high - low > 1:
            middle = (low + high) // 2
            rng = np.random.default_rng([self.seed, low, high])
            left = rng.multivariate_hypergeometric(mine, self._room(low, middle), method="marginals")
            if number < middle:
                high, mine = middle, left
            else:
                low, before, mine = middle, before + left, mine - left
            self.path.append((low, high, before, mine))
        return before, mine


@dataclass(frozen=True)
class Mix:
    """`documents`: one row a document with what is taken of it. `pieces`: the mix itself, shard by shard."""

    documents: DataFrame
    pieces: DataFrame


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    most_repeats: int = 3,
    block_words: int = 2048,
    blocks_per_shard: int = 4096,
    seed: int = 1,
    most_sources: int = 1_000_000,
) -> Mix:
    """A mix as long as all documents together, its sources near their targets.

    Sources, ordered by code point with null last, weigh `weights` in turn. Their targets are their shares of all words,
    none above `most_repeats` times its own, and are met to the word but for rounding. Documents are cut where blocks
    end. `pieces` has shard, place (in the shard, shuffled), doc_id, mark (hash of the text), copy, source, start,
    length (words) and round; a round takes no word of a source twice.

    Texts are read once. What moves after that is one narrow row a document, and one a piece. Places in a source's stream come
    from sums over buckets of about a million words by hash, so a source of any size is spread; rows with equal
    id, source and text travel as one row with a count. The driver holds one row a source, at most `most_sources`
    (ValueError beyond), and no number depends on how Spark deals out the rows.

    Null and empty texts have size 0 and nothing is taken of them; null sources are one source; null and repeated ids
    keep their rows. No rows, or no words at all, give no pieces.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    size = F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")
    read = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text).alias("mark")
    )
    rows = cut(read.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("copies")))
    per_source = cut(
        rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.count("*").alias("rows"))
    )
    if per_source.count() > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    sources = sorted(per_source.collect(), key=lambda r: (r["source"] is None, r["source"]))
    weight = [weights[i % len(weights)] for i in range(len(sources))]
    target = targets([r["words"] for r in sources], weight, most_repeats)
    block = max(block_words, int(target.sum()) // _MOST_BLOCKS + 1)
    quotas = [Quota.of(r["words"], t, most_repeats, block) for r, t in zip(sources, target)]
    known = spark.createDataFrame(
        [
            (r["source"], i, r["words"], float(t), 1 + max(r["words"] // _BUCKET_WORDS, r["rows"] // _BUCKET_ROWS))
            for i, (r, t) in enumerate(zip(sources, target))
        ],
        T.StructType(
            [
                T.StructField("known", rows.schema["source"].dataType),
                T.StructField("nth", T.IntegerType()),
                T.StructField("source_size", T.LongType()),
                T.StructField("target", T.DoubleType()),
                T.StructField("buckets", T.LongType()),
            ]
        ),
    )

    # Where each row stands in the stream of its source: sums within buckets, then over buckets.
    order = F.xxhash64(F.lit(seed), "doc_id", "mark", "size")
    named = rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("known"))).withColumn("hash", order)
    dealt = named.withColumn("bucket", F.pmod("hash", "buckets")).withColumn("span", F.col("size") * F.col("copies"))
    inside = Window.partitionBy("nth", "bucket").orderBy("hash", "doc_id", "mark", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    summed = cut(dealt.withColumn("inside", F.sum("span").over(inside) - F.col("span")).drop("known", "buckets", "hash"))
    earlier = Window.partitionBy("nth").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = summed.groupBy("nth", "bucket").agg(F.sum("span").alias("held"))
    begins = buckets.select("nth", "bucket", (F.sum("held").over(earlier) - F.col("held")).alias("begin"))
    starts = summed.join(begins, ["nth", "bucket"]).withColumn("at", F.col("begin") + F.col("inside"))
    single = _each_copy(starts).withColumn("at", F.col("at") + F.col("copy") * F.col("size"))
    placed = cut(single.select("doc_id", "source", "size", "mark", "nth", "source_size", "target", "at", "copy"))

    # The documents' pieces by block, and the drawn blocks; each shard draws for itself.
    busy = placed.where("size > 0")
    cuts = busy.withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")))
    offset = F.greatest(F.col("block") * block - F.col("at"), F.lit(0)).alias("start")
    ends = F.least((F.col("block") + 1) * block - F.col("at"), F.col("size")).alias("stop")
    held = cuts.select("doc_id", "source", "mark", "copy", "nth", "at", "block", offset, ends)
    drawn = _drawn_blocks(docs, quotas, block, blocks_per_shard, seed)
    reach = F.least("stop", F.col("block") * block + F.col("words") - F.col("at"))
    taken = (
        held.join(drawn, ["nth", "block"])
        .withColumn("length", reach - F.col("start"))
        .where("length > 0")
        .drop("stop", "words")
    )
    shuffled = F.xxhash64(F.lit(seed), "shard", "round", "nth", "at", "start")
    local = Window.partitionBy("shard").orderBy(shuffled, "nth", "at", "start", "round")
    pieces = cut(taken.withColumn("place", F.row_number().over(local).cast("long") - 1))
    sums = pieces.groupBy("nth", "at").agg(
        F.sum("length").alias("taken"), F.count("*").alias("n_pieces"), F.min(F.struct("shard", "place")).alias("first")
    )
    columns = ("doc_id", "source", "size", "source_size", "target", "taken", "n_pieces", "first.shard", "first.place")
    some = busy.join(sums, ["nth", "at"], "left").fillna(0, ["taken", "n_pieces"]).select(*columns)
    none = placed.where("size = 0").select(
        *columns[:5], *[F.lit(0).cast("long").alias(c) for c in ("taken", "n_pieces")],
        *[F.lit(None).cast("long").alias(c) for c in ("shard", "place")],
    )
    names = ("shard", "place", "doc_id", "mark", "copy", "source", "start", "length", "round")
    return Mix(some.unionByName(none), pieces.select(*names))


def _each_copy(rows: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """A row for each of its `copies`, numbered in `copy`; rows with very many copies are dealt out in chunks."""
    first = F.lit(0).cast("long")
    few = rows.where(F.col("copies") <= chunk).withColumn("copy", F.explode(F.sequence(first, F.col("copies") - 1)))
    chunks = rows.where(F.col("copies") > chunk).withColumn("low", F.explode(F.sequence(first, F.col("copies") - 1, F.lit(chunk))))
    high = F.least(F.col("low") + chunk, F.col("copies")) - 1
    many = chunks.repartition("low").withColumn("copy", F.explode(F.sequence("low", high))).drop("low")
    return few.unionByName(many)


def _drawn_blocks(docs: DataFrame, quotas: list[Quota], block: int, per_shard: int, seed: int) -> DataFrame:
    """(nth, block, round, words, shard) of every block that the mix takes, made shard by shard."""
    spark = docs.sparkSession
    totals = np.array([q.blocks(block) for q in quotas], np.int64)
    shards = -(-int(totals.sum()) // per_shard)
    shared = spark.sparkContext.broadcast(([(q.words, q.rounds, q.some, q.rest) for q in quotas], totals))
    out = "nth int, block long, round long, words long, shard long"

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, totals = shared.value
        quotas = [Quota(*q) for q in numbers]
        tree = SplittingTree(totals, shards, seed)
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                before, mine = tree.shard(shard)
                for nth in np.flatnonzero(mine).tolist():
                    places = before[nth] + np.arange(mine[nth])
                    columns = [pa.array(c) for c in quotas[nth].drawn(places, block, [seed, nth])]
                    n = len(places)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, nth, np.int32)), *columns, pa.array(np.full(n, shard))],
                        ["nth", "block", "round", "words", "shard"],
                    )

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.range(0, shards, 1, max(1, min(shards, tasks))).mapInArrow(draw, out)


def shard_texts(pieces: DataFrame, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, place, doc_id, start, text) of the pieces, words joined by one space, each shard ordered in one partition.

    Rows of the same id and text stand for each other.
    """
    words = F.array_remove(F.split(F.coalesce(text_col, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    whole = docs.select(F.col(id_col).alias("own_id"), F.xxhash64(F.col(text_col)).alias("own_mark"), words.alias("words"))
    whole = whole.dropDuplicates(["own_id", "own_mark"])
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark"))
    part = F.array_join(F.slice("words", F.col("start").cast("int") + 1, F.col("length").cast("int")), " ")
    texts = pieces.join(whole, same).select("shard", "place", "doc_id", "start", part.alias("text"))
    return texts.repartition("shard").sortWithinPartitions("shard", "place")
