"""SimHash fingerprints of texts and their groups, candidates found by chains of segments on a ring.

Two fingerprints that differ in at most `distance` of 64 bits, seen as `segments` segments on a ring, have a segment from
which on every chain of l segments differs in at most l * distance / segments bits. With five segments and two bits the
budgets of chains of 1 to 5 are 0, 0, 1, 1 and 2: two neighbouring segments agree (that is the join key), and longer
chains prune further before all bits are compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from meterlens.llm.common import cut, fresh, id_field, text_slices, texts_of
from meterlens.llm.graph import components

SEED = 42


def _shingle_hashes(text: str, words_per_shingle: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return [xxh64_intdigest(joined, SEED)] if words else []
    ends, at = [], -1
    for w in words:
        at += 1 + len(w)
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return list(map(xxh64_intdigest, [joined[a:b] for a, b in zip(starts, ends[words_per_shingle - 1 :])], repeat(SEED)))


def majority_bits(hashes: np.ndarray, counts: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """For each run of `counts` hashes the 64-bit number whose bits are set in over half of them (0 for no hash)."""
    out = np.zeros(len(counts), np.uint64)
    held = np.flatnonzero(counts)
    if not len(held):
        return out
    ends = np.cumsum(counts[held])
    sums = np.zeros((len(held), 64), np.int64)
    for low in range(0, int(ends[-1]), block):
        part = hashes[low : low + block]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = int(np.searchsorted(ends, low, "right"))
        last = int(np.searchsorted(ends, low + len(part) - 1, "right"))
        cuts = np.concatenate([[0], ends[first:last] - low])
        sums[first : last + 1] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    packed = np.packbits(2 * sums > counts[held][:, None], axis=1, bitorder="little")
    out[held] = packed.view("<u8")[:, 0]
    return out


def fingerprints(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, mark: Column | None = None
) -> DataFrame:
    """doc_id and SimHash (long, its bits those of an unsigned number) of every row, and the long `mark` if one is given.

    A-Z are lower-cased; words are runs without ASCII white space; shingles count as often as they occur; a text with
    fewer words is one shingle, one without words (or null) has fingerprint 0.
    """
    out = T.StructType([id_field(docs, id_col, "doc_id"), T.StructField("fp", T.LongType(), False)])
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if mark is not None:
        read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), mark.alias("mark"))
        out = out.add("mark", T.LongType(), False)

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            found = [np.array(_shingle_hashes(t, words_per_shingle), np.uint64) for t in texts_of(batch, "text")]
            bits = majority_bits(np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found)))
            columns = [batch.column("doc_id"), pa.array(bits.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, out.names)

    return read.mapInArrow(compute, out)


def _edges(segments: int) -> list[int]:
    return [64 * i // segments for i in range(segments + 1)]


def _segment(fp: Column, i: int, edges: list[int]) -> Column:
    width = edges[i + 1] - edges[i]
    return F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << width) - 1))


def _chains_hold(a: Column, b: Column, start: Column, distance: int, segments: int) -> Column:
    """Whether every chain from segment `start` on keeps its share of the budget; the last chain is the whole ring."""
    edges, differ = _edges(segments), a.bitwiseXOR(b)
    held = F.lit(False)
    for s in range(segments):
        total, ok = F.lit(0), F.lit(True)
        for step in range(segments):
            total = total + F.bit_count(_segment(differ, (s + step) % segments, edges))
            ok = ok & (total <= distance * (step + 1) // segments)
        held = held | ((start == s) & ok)
    return held


def near_links(prints: DataFrame, *, distance: int = 2, segments: int = 5, bucket: int = 64) -> DataFrame:
    """Links (a, b) between different fingerprints `fp` (distinct) that join all that differ in `distance` bits or fewer.

    Buckets are the fingerprints with the same leading agreeing segments of a chain. In buckets of up to `bucket`
    members, pairs that pass the chain budgets and then the full count become links: at most bucket / 2 pairs a row.
    For larger ones (distance 2 only) no pair is made: two numbers differ in at most two bits if and only if some number
    differs from each in at most one, so every member meets its 65 such numbers and is linked to the least member there.
    Both ways are exact, so together they lose no link; components are those of all pairs.
    """
    if distance != 2:
        raise ValueError("large buckets are solved for a distance of 2 bits")
    edges = _edges(segments)
    agreeing = -(-segments // distance) - 1  # chains so short that their budget is below one bit
    fp = F.col("fp")
    keyed = prints.select(
        "fp",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(s).alias("start"),
                        F.array(*[_segment(fp, (s + k) % segments, edges) for k in range(agreeing)]).alias("parts"),
                    )
                    for s in range(segments)
                ]
            )
        ).alias("key"),
    ).select("fp", "key.start", F.xxhash64("key.start", "key.parts").alias("key"))
    sizes = keyed.groupBy("start", "key").agg(F.count("*").alias("members")).where("members > 1")
    shared = cut(keyed.join(sizes, ["start", "key"]).select("fp", "start", "key", "members"))
    small = shared.where(F.col("members") <= bucket).groupBy("start", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = (
        small.select("start", "fps", F.posexplode("fps").alias("i", "a"))
        .select("start", "a", F.explode(F.expr("slice(fps, i + 2, size(fps))")).alias("b"))
        .where(_chains_hold(F.col("a"), F.col("b"), F.col("start"), distance, segments))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
        .select("a", "b")
    )
    flips = [F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]]
    ball = (
        shared.where(F.col("members") > bucket)
        .select("fp")
        .distinct()
        .select("fp", F.explode(F.transform(F.array(*flips), lambda x: x.bitwiseXOR(F.col("fp")))).alias("near"))
    )
    least = ball.groupBy("near").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = ball.join(least, "near").where("fp != a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def _named_groups(prints: DataFrame) -> DataFrame:
    """(fp, component_id) of every different fingerprint of (doc_id, fp); the work on groups is done once for each."""
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = cut(components(near_links(classes.select("fp")), "a", "b"))
    linked = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return linked.join(least, "root").select("fp", "component_id", "root")


def near_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3
) -> DataFrame:
    """doc_id, fp and component_id of every row; fingerprints with two or fewer differing bits are linked.

    component_id is the smallest doc_id that links reach, the row's own included; rows with the same fingerprint, all
    texts without words among them, are linked. Null ids keep their row and are never the smallest (a group of null ids
    alone has a null component). Texts are read once; from then on only ids and fingerprints move, and work on groups is
    done once per different fingerprint, so copies make no pairs.
    """
    prints = cut(fingerprints(docs, id_col=id_col, text_col=text_col, words_per_shingle=words_per_shingle))
    return prints.join(_named_groups(prints).drop("root"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """As `near_groups`, with the fingerprint as 16 lowercase hexadecimal digits."""
    fp = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_groups(docs, **options).select("doc_id", fp.alias("fingerprint"), "component_id")


def _content(docs: DataFrame) -> Column:
    """A hash of a whole row; columns that hold a map, which has no hash, count by their JSON."""

    def plain(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        return F.to_json(F.struct(column)) if "map<" in field.dataType.simpleString() else column

    return F.xxhash64(*map(plain, docs.schema.fields))


def one_per_group(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3
) -> DataFrame:
    """One row of `docs` for each group of `near_groups`, all columns: that with the smallest id.

    A row without an id stays only where its whole group has none. Among rows of the same id the smallest hash of the
    whole row decides, and equal rows stay once. Nothing but ids, fingerprints and that hash moves until the rows that
    stay are known; the texts are joined with those once. No rows give no rows.
    """
    prints = cut(
        fingerprints(docs, id_col=id_col, text_col=text_col, words_per_shingle=words_per_shingle, mark=_content(docs))
    )
    # Partial minima per fingerprint first, so a group of any size sends one row a task.
    first = prints.groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "mark")).alias("low"))
    least = first.join(_named_groups(prints), "fp").groupBy("root").agg(F.min("low").alias("low"))
    stay = least.select(F.col("low.doc_id").alias("stay_id"), F.col("low.mark").alias("stay_mark"))
    mark, nth = fresh(docs, "whole_row"), fresh(docs, "nth")
    marked = docs.withColumn(mark, _content(docs))
    same = marked[id_col].eqNullSafe(stay["stay_id"]) & (marked[mark] == stay["stay_mark"])
    equal = Window.partitionBy(id_col, mark).orderBy(mark)
    kept = marked.join(stay, same, "left_semi").withColumn(nth, F.row_number().over(equal))
    return kept.where(F.col(nth) == 1).drop(mark, nth)
