"""Quality rules: fixed rules on words and lines, and a log-likelihood ratio of hashed n-grams.

Word unigrams and bigrams fall into hash buckets. Two multinomials over the buckets, of trusted documents and of the raw
corpus, give each bucket a log-likelihood ratio; a document's score is the mean over its n-grams, so its length does not
count. A document is kept when its score reaches a threshold taken from labelled documents. DataFrame functions only.

Documents fall into two folds by a hash of their id, and each is scored by the trusted documents of the other fold. So no
document counts towards its own score, labelled ones are scored like all others, and the threshold holds for both.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from meterlens.llm.common import WORD_GAP, cut, fresh

# Fixed values of the base rules.
SYMBOLS = "[#*$%&|<>]"
WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 5, 10, 20

#: Slices that a round of the search for a quantile counts.
SLICES = 1024


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _buckets(hashes: Column, n_buckets: int) -> Column:
    """Buckets of all words and of all pairs of neighbouring words."""

    def pairs(h: Column) -> Column:
        later = F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0)))
        both = F.zip_with(F.slice(h, 1, F.size(later)), later, lambda a, b: F.xxhash64(a, b))
        return F.transform(F.concat(h, both), lambda x: F.pmod(x, F.lit(n_buckets)).cast("int"))

    return _let(hashes, pairs)


def _repeated_words(hashes: Column) -> Column:
    """Words in windows of five that occur twice or more in the text: the union of those windows, in words."""

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def union(found: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(found, a)["h"] == F.get(found, b)["h"], F.lit(False))
            twice = F.filter(found, lambda x, k: same(k, k - 1) | same(k, k + 1))
            places = F.sort_array(F.transform(twice, lambda x: x["i"]))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
            return F.aggregate(
                places,
                start,
                lambda s, i: F.struct(
                    (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")
                ),
                lambda s: s["n"],
            )

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_let(placed, union))

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    return _let(
        hashes, lambda h: F.when(F.size(h) < WINDOW, F.lit(0).cast("long")).otherwise(_let(windows(h), covered))
    )


def trusted_labels(labels: DataFrame, *, id_col: str = "doc_id", most: int | None = None) -> DataFrame:
    """(doc_id, good): all documents labelled of quality 1 and not toxic, and those with quality 0 or toxic.

    A document with contradicting qualities that is not toxic is in neither; null ids and labels are left out. With `most`
    about so many of each are taken, those with the lowest hashes.
    """
    one = labels.groupBy(F.col(id_col).alias("doc_id")).agg(
        F.min("quality").alias("low"), F.max("quality").alias("high"), F.max("toxic").alias("toxic")
    )
    good = F.when((F.col("low") == 1) & (F.col("toxic") == 0), F.lit(True)).when(
        (F.col("high") == 0) | (F.col("toxic") == 1), F.lit(False)
    )
    known = cut(one.select("doc_id", good.alias("good")).where("doc_id is not null and good is not null"))
    if most is None:
        return known
    sizes = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}
    rank, bar = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), F.lit(1 << 20)
    for good, n in sizes.items():
        bar = F.when(F.col("good") == good, int(min(1.0, most / n) * (1 << 20))).otherwise(bar)
    return known.where(rank < bar)


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("fold")), F.lit(2))


def bucket_number(rows: int) -> int:
    """Buckets for a corpus of so many documents: a quarter of their number as a power of two, from 2^13 to 2^18."""
    return 1 << min(18, max(13, (max(rows, 1) // 4).bit_length()))


def bucket_weights(
    docs: DataFrame, trusted: DataFrame, *, id_col: str, text_col: str, n_buckets: int, smoothing: float
) -> list[list[int]]:
    """For each fold the log-likelihood ratio of every bucket in thousandths, from counts over all documents.

    The raw multinomial is smoothed by `smoothing` counts a bucket, that of the trusted documents by as many counts spread
    like the raw one: a bucket that they never use is below zero, however rare it is, and one that they use like all
    others is zero. Whole numbers add up to the same score in any order. Where the other fold has no trusted documents,
    all count. The trusted ids are as many as there are labels, so they are not broadcast: ids and texts are shuffled once,
    and a task looks up its texts in a hash table of its ids.
    """
    target = trusted.where("good").select(F.col("doc_id").alias("target_id")).hint("shuffle_hash")
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    grams = text.join(target, F.col("id") == F.col("target_id"), "left").select(
        F.when(F.col("target_id").isNotNull(), _fold(F.col("id"))).alias("fold"),
        F.explode(_buckets(_hashes(_words(F.col("text"))), n_buckets)).alias("bucket"),
    )
    counts = grams.groupBy("bucket").agg(F.count("*"), F.count_if(F.col("fold") == 0), F.count_if(F.col("fold") == 1))
    raw, good = [0] * n_buckets, ([0] * n_buckets, [0] * n_buckets)
    for bucket, n, even, odd in counts.collect():
        raw[bucket], good[0][bucket], good[1][bucket] = n, even, odd
    both = list(map(int.__add__, *good))
    out = []
    for fold in (0, 1):
        other = good[1 - fold] if any(good[1 - fold]) else both
        prior = smoothing * n_buckets
        n_raw, n_good = sum(raw) + prior, sum(other) + prior
        # (g + prior * p) / n_good / p for the raw share p of the bucket
        out.append([round(1000 * math.log((g * n_raw / (r + smoothing) + prior) / n_good)) for r, g in zip(raw, other)])
    return out


def _figures(doc_id: Column, text: Column, weights: list[list[int]]) -> Column:
    """All figures of a text as one struct; words and hashes are made once."""
    # Catalyst folds the lists to constants.
    tables = [F.split(F.lit(",".join(map(str, w))), ",").cast("array<int>") for w in weights]
    plain = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(plain, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def total(grams: Column, table: Column) -> Column:
        return F.aggregate(grams, F.lit(0).cast("long"), lambda s, b: s + F.get(table, b))

    def of_hashes(words: Column, h: Column) -> Column:
        score = _let(_buckets(h, len(weights[0])), lambda g: F.when(_fold(doc_id) == 0, total(g, tables[0])).otherwise(total(g, tables[1])))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(plain, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeated_words(h).alias("n_repeat_words"),
            (score / F.greatest(2000 * F.size(h) - 1000, F.lit(1))).alias("score"),
        )

    return _let(_words(text), lambda w: _let(_hashes(w), lambda h: of_hashes(w, h)))


def _with_verdict(made: DataFrame, name: str, threshold: float) -> DataFrame:
    q = F.col(name)
    failed = (q["n_words"] < LEAST_WORDS) | (100 * q["n_repeat_words"] > MOST_REPEATED_PERCENT * q["n_words"])
    kept = ~failed & (q["score"] >= F.lit(threshold))
    return made.withColumn(name, F.struct(F.col(f"{name}.*"), failed.alias("base_failed"), kept.alias("kept")))


def lowest_with_share(values: DataFrame, share: float) -> float | None:
    """The lowest of a column of numbers that at least `share` of them don't exceed: percentile_disc, distributed.

    Every round counts the values in slices between two bounds, and the bounds close in on the slice that holds the wanted
    rank, until they are one value. The driver gets a row a slice.
    """
    name = values.columns[0]
    value, least, most = F.col(name), F.min(name), F.max(name)
    n, low, high = values.agg(F.count(name), least, most).first()
    if not n:
        return None
    rank = max(1, math.ceil(share * n) - 1)
    while rank / n < share:
        rank += 1
    while low < high:
        part = F.floor((value - F.lit(low)) / F.lit(high - low) * SLICES)
        inside = values.where(value.between(low, high)).groupBy(part.alias("part")).agg(F.count(name), least, most)
        for _, n_part, low, high in sorted(inside.collect()):  # noqa: B007
            if rank <= n_part:
                break
            rank -= n_part
    return low


def threshold_of(scores: DataFrame, keep: float) -> float:
    """The least score that is kept, from (good, n_words, score) of labelled documents.

    It loses at most a share of 1 - `keep` of the trusted documents. It lies halfway between the lowest score of those
    that stay and the next lower score of a document of quality 0 or a toxic one, so the way down from the first lets no
    labelled poor document in. Without trusted documents every score passes.
    """
    usual = cut(scores.where(F.col("n_words") >= LEAST_WORDS).select("good", "score"))
    low = lowest_with_share(usual.where("good").select("score"), 1 - keep)
    if low is None:
        return float("-inf")
    high = usual.where(~F.col("good") & (F.col("score") < low)).agg(F.max("score")).first()[0]
    return low if high is None else (low + high) / 2


class QualityModel:
    """Weights of the buckets for either fold and the least score of a document that is kept."""

    def __init__(self, weights: list[list[int]], threshold: float):
        self.weights, self.threshold = weights, threshold

    def judged(self, docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
        """`docs` with the struct `name`: the base figures, score, base_failed and kept. Nothing is shuffled."""
        made = docs.withColumn(name, _figures(F.col(id_col), F.col(text_col), self.weights))
        return _with_verdict(made, name, self.threshold)


def _counted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, n_buckets: int | None, smoothing: float):
    trusted = trusted_labels(labels)
    buckets = n_buckets or bucket_number(docs.count())
    weights = bucket_weights(docs, trusted, id_col=id_col, text_col=text_col, n_buckets=buckets, smoothing=smoothing)
    return trusted, weights


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_buckets: int | None = None,
    smoothing: float = 1.0,
    keep: float = 0.999,
) -> QualityModel:
    """Count n-grams of all documents and of the trusted ones, then take the threshold from labelled scores.

    The number of buckets follows that of the documents unless `n_buckets` is given.
    """
    trusted, weights = _counted(docs, labels, id_col, text_col, n_buckets, smoothing)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = text.join(trusted, F.col("id") == F.col("doc_id")).select("good", "id", "text")
    scores = cut(known.select("good", _figures(F.col("id"), F.col("text"), weights).alias("q")))
    return QualityModel(weights, threshold_of(scores.select("good", "q.n_words", "q.score"), keep))


def fit_and_judge(
    docs: DataFrame,
    labels: DataFrame,
    name: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    columns: list[str] | None = None,
    n_buckets: int | None = None,
    smoothing: float = 1.0,
    keep: float = 0.999,
) -> DataFrame:
    """`columns` of `docs` (all by default) with the struct `name` as of a model fitted on `docs`.

    The same verdicts as `fit` and `judged`, but every document is scored once: into a table in the shared folder, from
    which the threshold is taken too.
    """
    trusted, weights = _counted(docs, labels, id_col, text_col, n_buckets, smoothing)
    kept = [F.col(f"`{c}`") for c in (columns or docs.columns)]
    key = fresh(docs, "scored_id")
    made = docs.select(*kept, F.col(id_col).alias(key), _figures(F.col(id_col), F.col(text_col), weights).alias(name))
    made = cut(made)
    known = made.select(key, f"{name}.n_words", f"{name}.score").join(trusted, F.col(key) == F.col("doc_id"))
    return _with_verdict(made.drop(key), name, threshold_of(known.select("good", "n_words", "score"), keep))


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def quality_verdicts(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, base figures, base_failed, kept, score.

    Null and empty texts have zero words and fail. Null and repeated ids keep their rows. Other columns are not read.
    """
    judged = model.judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", "q")
    return judged.select("doc_id", *[f"q.{n}" for n in _NAMES])


def own_verdicts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """As `quality_verdicts` of a model fitted on the same documents, which are scored once."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return fit_and_judge(text, labels, "q", columns=["doc_id"], **options).select("doc_id", *[f"q.{n}" for n in _NAMES])
