"""Packing, token counts and blocks, SimHash, decontamination, quality and secrets against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from meterlens.llm import decontamination, packing, quality, secrets, simhash, token_counts, token_files
from meterlens.llm.encoding import WordEncoder, tokenizer_path
from meterlens.llm.graph import components

SCHEMA = "doc_id long, text string, fp long, sequence_id string, kept string, good int, whole int, q int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_texts():
    """Nulls, empty and blank texts, a very long one, repeats, odd spacing and characters."""
    rng = random.Random(5)
    words = ["the", "Ather", "söß", "中文", "x1", "on,", "end.\nNew", "<|endoftext|>", "don't", "#tag", "a=b"]
    many = " ".join(rng.choice(words) for _ in range(30_000))
    texts = [None, "", "  \n\t ", "one", "two words", many, many, "a  b   c \n d", "\x1f odd \x00 bytes", "x" * 5000]
    return texts + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7, "s", "k", 1, 2, 3) for i, t in enumerate(odd_texts())]
    rows += [rows[12], (None, "no id here at all", 7, None, None, None, None, None), (None, None, 0, "", "", 0, 0, 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_word_encoder_equals_the_library():
    encoder = WordEncoder(tokenizer_path("byte_bpe_50k.json"), max_parts=300)
    texts = [t for t in odd_texts() if t is not None] + ["①1 ½! a①!", "nb   z", "it's 'sabc", " lead", "trail "]
    for low in range(0, len(texts), 9):  # the small store is shrunk on the way
        ids, counts = encoder.encode(pa.array(texts[low : low + 9]))
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts[low : low + 9], add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_best_fit_takes_the_tightest_window():
    window, offset = packing.best_fit_decreasing(np.array([6, 5, 4, 3, 5]), 10)
    # 6 and 4 fill a window, both 5 another, 3 opens the last.
    assert (window.tolist(), offset.tolist()) == ([0, 1, 0, 2, 1], [0, 0, 6, 0, 5])


def test_best_fit_equals_a_plain_search():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 1025, 700)
    window, offset = packing.best_fit_decreasing(lengths, 1024)
    room: list[int] = []
    for length in sorted(lengths.tolist(), reverse=True):
        fits = [r for r in room if r >= length]
        if fits:
            room[room.index(min(fits))] -= length
        else:
            room.append(1024 - length)
    used = np.bincount(window, weights=lengths)
    assert sorted((1024 - used).astype(int).tolist()) == sorted(room)


def test_packing_keeps_every_id_once(spark, docs, empty):
    library = WordEncoder(tokenizer_path("byte_bpe_50k.json")).tokenizer
    want = collections.Counter()
    for doc, text in pairs(docs):
        want[doc, np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()] += 1
    rows = packing.pack_documents(docs, buffer_pieces=20).collect()
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for at in places.values():
        ends = 0
        for offset, length in sorted(at):
            assert offset == ends
            ends += length
        assert ends <= 1024
    of = collections.defaultdict(collections.Counter)
    for (doc, raw), n in want.items():
        size = len(raw) // 4
        for start in range(0, size, 1024):
            piece = raw[4 * start : 4 * start + 4096]
            of[doc][start, len(piece) // 4, zlib.crc32(piece), size] += n
    got = collections.defaultdict(collections.Counter)
    for r in rows:
        got[r.doc_id][r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    assert got == of
    assert packing.pack_documents(empty).count() == 0


def test_blocks_round_trip(spark, docs, empty):
    library = WordEncoder(tokenizer_path("byte_bpe_50k.json")).tokenizer
    pieces = collections.defaultdict(list)
    for row in token_files.packed_blocks(docs, sequence_length=512, rows_per_block=7, buffer_ids=40_000).collect():
        ids, cu, positions = token_files.read_block(row)
        assert ids.shape == (row.n_sequences, 512) and cu[-1] == ids.size
        for i, (doc, start) in enumerate(zip(row.segment_docs, row.segment_starts)):
            segment = ids.ravel()[cu[i] : cu[i + 1]]
            assert (positions.ravel()[cu[i] : cu[i + 1]] == np.arange(len(segment))).all()
            if start >= 0:
                pieces[doc].append((start, tuple(segment.tolist())))
            else:
                assert doc is None and set(segment.tolist()) == {50256}
    want = collections.defaultdict(list)
    for doc, text in pairs(docs):
        ids = [*library.encode(text, add_special_tokens=False).ids, 50256]
        want[doc] += [(s, tuple(ids[s : s + 512])) for s in range(0, len(ids), 512)]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    assert token_files.packed_blocks(empty).count() == 0


def test_written_blocks_can_be_read(spark, docs, tmp_path):
    blocks = token_files.packed_blocks(docs)
    token_files.write_blocks(blocks, str(tmp_path / "blocks"))
    assert spark.read.parquet(str(tmp_path / "blocks")).agg({"n_ids": "sum"}).first()[0] == blocks.agg({"n_ids": "sum"}).first()[0]


def test_token_counts(spark, docs, empty):
    counter = token_counts.ChunkedCounter(tokenizer_path("piece_bpe_32k.model"))
    got = token_counts.count_tokens(docs, chunk=300, overlap=16, limit=100).collect()
    want = [(d, len(t.encode()), len(counter.model.encode(t))) for d, t in pairs(docs)]
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_tokens) for r in got))) == sorted(map(str, want))
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts.count_tokens(empty).count() == 0


@pytest.mark.parametrize("alphabet", ["ab ", "a", "的是不了人", "é①ﬁ ▁x", "  ", "aaaa=== -\n"])
def test_chunks_are_spliced_exactly(alphabet):
    counter = token_counts.ChunkedCounter(tokenizer_path("piece_bpe_32k.model"), chunk=150, overlap=8)
    rng = random.Random(1)
    for size in (149, 150, 151, 700, 2500):
        text = "".join(rng.choice(alphabet) for _ in range(size))
        assert counter.count(text) == len(counter.model.encode(text))


def simhash_by_hand(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_by_hand(values):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    ordered = sorted(values)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def test_simhash_groups(spark, docs, empty):
    prints = {(d, t): simhash_by_hand(t) for d, t in pairs(docs)}
    classes = classes_by_hand(set(prints.values()))
    least = {}
    for (doc, _), fp in prints.items():
        if doc is not None:
            least[classes[fp]] = min(doc, least.get(classes[fp], doc))
    want = sorted((str(d), format(prints[d, t], "016x"), least.get(classes[prints[d, t]])) for d, t in pairs(docs))
    got = [(str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bucket", [2, 64, 10_000])
def test_large_and_small_buckets_give_the_same_classes(spark, bucket):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    chain = rng.getrandbits(64)
    for _ in range(40):  # each links to the next only
        chain ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        prints.add(chain)
    prints |= {rng.getrandbits(64) for _ in range(60)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    links = simhash.near_links(spark.createDataFrame([(signed(v),) for v in prints], "fp long"), bucket=bucket)
    roots = {r.node: r.root for r in components(links, "a", "b").collect()}
    got, want = collections.defaultdict(set), collections.defaultdict(set)
    for v, root in classes_by_hand(prints).items():
        want[root].add(v)
        got[roots.get(signed(v), signed(v))].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(101)} | {i: 1000 for i in range(1000, 1080)}


def test_one_document_of_each_group_stays(spark, docs, empty):
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    classes = classes_by_hand({simhash_by_hand(t) for _, t in pairs(docs)})
    groups = collections.defaultdict(list)
    for doc, text in pairs(docs):
        groups[classes[simhash_by_hand(text)]].append((doc is None, doc or 0, text))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(
        min(rows) for rows in groups.values()
    )
    assert simhash.one_per_group(empty).count() == 0


def test_one_per_group_with_tied_ids_maps_and_clashing_names(spark):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [
        (1, "a b c d", {"k": 1}, 1, 1), (1, "a b c d", {"k": 1}, 1, 1), (1, "a b c d", {"k": 2}, 1, 1),  # tied, one equal
        (2, long, None, 0, 0), (1, long, {}, 0, 0),  # the id of another group
        (None, "only null ids here", None, None, None), (None, "only null ids here", None, None, None),
        (None, "a b c d", None, 0, 0), (9, "", None, 0, 0), (8, None, None, 0, 0), (7, " \n", {}, 0, 0),
    ]
    names = "doc_id long, text string, fp map<string, int>, mark int, whole_row int"
    kept = simhash.one_per_group(spark.createDataFrame(rows, names)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(
        [(1, "a b c d"), (1, long), (None, "only null ids here"), (7, " \n")], key=str
    )


def shingle_set(text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode())
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def test_contained_items(spark, docs, empty):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(6, 60)))) for i in range(30)]
    items += [(30, "just three words"), (31, ""), (32, None), (33, items[0][1]), (None, items[1][1])]
    hidden = []
    for i, text in items[:33]:
        part = (text or "").split()
        for share in (1.0, 0.9, 0.5):
            filler = [rng.choice(words) for _ in range(rng.randrange(0, 400))]
            hidden.append(" ".join([*filler, *part[: int(len(part) * share + 0.5)], *filler]).upper().replace("W3", "w3,"))
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(hidden)] + [(None, hidden[0])], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for doc, text in pairs(corpus):
        for key, item in items:
            q = shingle_set(item or "")
            n = len(next(iter(q))) if q else 0
            w = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode())
            d = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            if q and len(q & d) >= 0.8 * len(q) - 1e-9:
                want.add((doc, key, len(q), len(q & d)))
    for block in (32 << 20, 200):  # one block of items, and many
        found = decontamination.contained_items(corpus, benchmark, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id, r.item_shingles, r.shared_shingles) for r in found} == want
        assert len(found) == len(want)
    assert {30} <= {key for _, key, *_ in want}
    clean = decontamination.without_items(corpus, benchmark)
    assert clean.columns == corpus.columns
    dirty = {d for d, *_ in want}
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in pairs(corpus)} - dirty
    assert decontamination.contained_items(empty, benchmark).count() == 0
    assert decontamination.contained_items(docs, benchmark.limit(0)).count() == 0
    assert decontamination.without_items(docs, benchmark.limit(0)).count() == docs.count()


def base_figures(text):
    words = WORD.findall(text)
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed)


def test_quality_figures_and_verdict(spark, docs, empty):
    labels = spark.createDataFrame(
        [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(10, 60)] + [(5, 1, 0), (5, 0, 0), (None, 1, 0), (7, None, None)],
        "doc_id long, quality int, toxic int",
    )
    model = quality.fit(docs, labels, n_buckets=64, keep=0.9)
    got = quality.quality_verdicts(docs, model).collect()
    want = collections.Counter((d, *base_figures(t)) for d, t in pairs(docs))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collections.Counter(tuple(r[n] for n in names) for r in got) == want
    assert all(r.kept == (not r.base_failed and r.score >= model.threshold) for r in got)
    assert quality.quality_verdicts(empty, model).count() == 0
    # nothing labelled: base rules alone decide
    free = quality.fit(docs, labels.limit(0), n_buckets=64)
    assert all(r.kept == (not r.base_failed) for r in quality.quality_verdicts(docs, free).collect())
    assert quality.fit(empty, labels, n_buckets=64).weights == [[0] * 64] * 2
    once = quality.own_verdicts(docs, labels, n_buckets=64, keep=0.9)
    assert sorted(map(str, once.collect())) == sorted(map(str, got))
    assert quality.own_verdicts(empty, labels).count() == 0 and quality.own_verdicts(docs, labels.limit(0)).count() == len(got)


def test_quality_weights_by_hand(spark):
    good, bad = "a b " * 30, "c d " * 30
    docs = spark.createDataFrame([(1, good), (2, bad), (3, bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, n_buckets=1000)
    scores = {r.doc_id: r.score for r in quality.quality_verdicts(docs, model).collect()}
    assert scores[1] > 0 > scores[2] == scores[3]
    # All 119 n-grams of the good text lie in the target, those of all three in the corpus.
    assert model.weights[0] == model.weights[1]  # one fold alone has trusted documents
    counts = collections.Counter(model.weights[0])
    assert max(counts) == pytest.approx(1000 * np.log((60 + 1000 * 61 / 1357) / 1119 / (61 / 1357)), abs=60)
    assert min(counts) == pytest.approx(1000 * np.log(1000 / 1119), abs=1)


def test_labelled_and_unlabelled_documents_are_rejected_alike(spark):
    """300 labels: trusted documents that are labelled pass as often as those that aren't."""
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "bdfgklmnprst"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(15, 60)))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.own_verdicts(docs, labels, keep=0.95).collect()}
    known, others = np.mean([kept[i] for i in range(300)]), np.mean([kept[i] for i in range(300, 3000)])
    assert known >= 0.95 and abs(known - others) < 0.03


def test_each_label_is_thinned_by_its_own_number(spark):
    rows = [(i, int(i % 10 > 0), 0) for i in range(20_000)]
    found = quality.trusted_labels(spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), most=3000)
    sizes = {r["good"]: r["count"] for r in found.groupBy("good").count().collect()}
    assert sizes[False] == 2000 and 2700 < sizes[True] < 3300


def test_all_labels_count_and_are_not_forced_to_every_task(spark, monkeypatch):
    """300 000 trusted documents, more than the 200 000 that were once sampled: all are in the labels and in the counts."""
    rows = spark.range(300_000)
    labels = rows.select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    trusted = quality.trusted_labels(labels)
    assert trusted.count() == 300_000
    docs = rows.select(F.col("id").alias("doc_id"), F.lit("one").alias("text"))
    weights = quality.bucket_weights(docs, trusted, id_col="doc_id", text_col="text", n_buckets=8, smoothing=1.0)
    folds = [-8 + 8 / np.exp(min(w) / 1000) for w in weights]  # trusted documents, from the weight of an unused bucket
    assert sum(folds) == pytest.approx(300_000, rel=0.01)
    plans, frame = [], type(docs)
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: plans.append(df._jdf.queryExecution().toString()) or collect(df))
    quality.bucket_weights(docs, trusted, id_col="doc_id", text_col="text", n_buckets=8, smoothing=1.0)
    assert plans and "broadcast" not in plans[0].split("== Analyzed")[0].lower()


@pytest.mark.parametrize("share", [0.0, 0.001, 0.1, 1 - 0.999, 0.5, 0.75, 1.0])
def test_quantile_in_slices_is_percentile_disc(spark, share):
    rng = random.Random(9)
    sets = [[1.5], [2.0, 2.0, 2.0], [1.0, 1.0 + 2**-52, 1e300, -1e-300], [rng.gauss(0, 1) for _ in range(1000)], [float(rng.randrange(5)) for _ in range(700)]]
    for some in sets:
        values = spark.createDataFrame([(x,) for x in some], "score double")
        want = values.agg(F.expr(f"percentile_disc({share!r}D) WITHIN GROUP (ORDER BY score)")).first()[0]
        assert quality.lowest_with_share(values, share) == want
    assert quality.lowest_with_share(spark.createDataFrame([], "score double"), share) is None


def test_buckets_follow_the_corpus():
    sizes = [quality.bucket_number(n) for n in (0, 1000, 50_000, 250_000, 10**9)]
    assert sizes == [1 << 13, 1 << 13, 1 << 14, 1 << 16, 1 << 18]


def test_quality_rejects_held_out_poor_and_toxic_documents(spark):
    rng = random.Random(8)
    some = lambda stem, n: [f"{stem}{rng.randrange(300)}" for _ in range(n)]
    rows, labels = [], []
    for i in range(900):
        share = 0 if i % 3 == 0 else rng.randrange(40, 100)  # of words that trusted documents have not
        words = some("fine", 100 - share) + some("poor" if i % 3 == 1 else "vile", share)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i < 450:
            labels.append((i, int(i % 3 != 1), int(i % 3 == 2)))
    model = quality.fit(
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )
    got = quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string"), model).where("doc_id >= 450")
    kept = collections.defaultdict(list)
    for r in got.collect():
        kept[r.doc_id % 3].append(r.kept)
    assert np.mean(kept[0]) > 0.98
    assert np.mean(kept[1]) < 0.02 and np.mean(kept[2]) < 0.02


def test_quality_labels_count_toxic_documents_as_poor(spark):
    rows = [(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 0, 1), (5, 1, 0), (5, 0, 0), (6, None, None)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.good for r in quality.trusted_labels(labels).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def spans_by_hand(text):
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ("assign", "access", "hex")
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found))


def leaky_rows(n):
    rng = random.Random(2)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    upper = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQ23456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("then", "er", "dis", "th", "on", "ly", "ü")) for _ in range(rng.randrange(2, 7)))
    odd = lambda: f"{word()}{rng.randrange(100)}.{word()}-{rng.randrange(2000)}"
    rows = []
    for i in range(n):
        words = [rng.choice((word, word, odd))() for _ in range(8)]
        if i % 2:
            secret = rng.choice([f"password={hexes(18)}", f'token = "{hexes(40)}"', f"AKIA{upper(16)}", hexes(32), "Secret: abc"])
            words.insert(rng.randrange(6), secret)
        rows.append((i, " ".join(words), 40))
    return rows


@pytest.fixture(scope="module")
def leaky(spark):
    rows = leaky_rows(400)
    rows += [(400, None, None), (401, "", 0), (402, "secret=token: abcdefgh ſecret=abcdefgh", 30), (None, f"API_KEY:{'0f' * 3}", 14), rows[1]]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long")


def test_secret_scan(spark, leaky, empty):
    net = secrets.fitted(leaky)
    got = secrets.scan(leaky, net).collect()
    want = collections.Counter((d, hashlib.sha256(spans_by_hand(t).encode()).hexdigest()) for d, t in pairs(leaky))
    assert collections.Counter((r.doc_id, r.base_sha256) for r in got) == want
    for r in got:
        base = ",".join(s for s in r.spans.split(",") if not s.startswith("cnn"))
        assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256
        assert r.n_assign + r.n_access + r.n_hex == len(base.split(",")) * bool(base)
    assert secrets.scan(empty, net).count() == 0
    assert secrets.fitted(empty) is None
    assert [r.spans for r in secrets.scan(leaky.where("doc_id = 401"), None).collect()] == [""]


def test_net_separates_held_out_findings(spark):
    many = spark.createDataFrame(leaky_rows(3000), "doc_id long, text string, n_chars long")
    findings = secrets.labelled_findings(many, "text", 10_000, 3000)
    net = secrets.train(findings[::2])
    rest = [f for f in findings[1::2] if f not in set(findings[::2])]
    scores = net.probability(net.logits(secrets.CharNet.codes([t for t, _ in rest]))) >= net.threshold
    truth = np.array([y for _, y in rest], bool)
    assert (scores == truth).mean() > 0.95
    assert scores[truth].mean() > 0.9


def test_candidates_by_hand():
    texts = ["x" * 50 + "1" + "y" * 300 + " a1b2c3d4e5f6", "12345678901234", "ab1", "é1234567890abcé", "a" * 200 + "9"]
    for t in texts:
        runs = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_.=-]{12,}", t)]
        want = [(a, b) for a, b in runs if re.search("[0-9]", t[a:b]) and re.search("[A-Za-z]", t[a:b])]
        assert secrets.candidates(t) == want


def test_secrets_that_no_pattern_knows_are_found(spark):
    """Key formats that no base pattern matches, frequent in the sample itself, half of them held out of it."""
    rng = random.Random(6)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda n, of=base62: "".join(rng.choice(of) for _ in range(n))
    formats = (
        lambda: f"ghp_{some(36)}",
        lambda: f"sk_live_{some(24)}",
        lambda: f"Bearer {some(20)}.{some(40)}.{some(30)}",
        lambda: some(24, base62[:52]),  # no digit
        lambda: some(10),
    )
    rows = []
    for i, (_, text, _) in enumerate(leaky_rows(1500)):
        made = formats[i % 5]()
        rows.append((i, f"{text} jane.doe{i}@example.org {made} v1.2.{i} 2024-05-{i % 28 + 1:02d} end", made.split()[-1]))
    net = secrets.fitted(spark.createDataFrame([(i, t) for i, t, _ in rows if i % 4 < 2], "doc_id long, text string"))
    held = [r for r in rows if r[0] % 4 > 1]
    found = collections.defaultdict(list)
    plain = []
    for (i, text, made), (base, every) in zip(held, secrets.all_spans([t for _, t, _ in held], net)):
        at = text.index(made)
        if not any(a < at + len(made) and at < b for a, _, b in base):
            found[i % 5].append(any(k == 3 and a <= at and b >= at + len(made) for a, k, b in every))
        low = text.index("jane.doe")
        plain.append(any(k == 3 and low <= a < at - 7 or a > at + len(made) for a, k, _ in every))
    # letters alone and ten characters are harder: they are candidates, and some are found
    assert all(np.mean(found[k]) > 0.8 for k in range(3)) and all(any(found[k]) for k in (3, 4))
    assert np.mean(plain) < 0.1


def test_threshold_keeps_the_recall_of_poorly_separated_findings():
    rng = np.random.default_rng(1)
    x, y = rng.integers(1, 96, (2000, 76)), (rng.random(2000) < 0.05).astype(np.float32)
    net = secrets.CharNet()
    net.calibrate(x, y, 0.95)
    kept = net.probability(net.logits(x)) >= net.threshold
    assert kept[y > 0].mean() >= 0.95 and net.threshold < 0.5


def test_open_candidates_hold_values_without_digits_or_letters():
    text = "kJhGfDsAqWeRtY 1234-5678-9012-3456-7890 aB3dE6gH plainwords getElementById 2024-05-01 report_v2.txt"
    got = [text[a:b] for a, b in secrets.open_candidates(text)]
    assert {"kJhGfDsAqWeRtY", "aB3dE6gH"} <= set(got)
    assert not {"plainwords", "getElementById", "2024-05-01"} & set(got)


def test_redaction(spark, leaky):
    out = {r.doc_id: r for r in secrets.redact(leaky, None, size_col="n_chars").where("doc_id is not null").collect()}
    assert secrets.redact(leaky, None).count() == leaky.count()
    before = dict(pairs(leaky))
    for doc, row in out.items():
        spans = spans_by_hand(before[doc])
        assert spans_by_hand(row.text or "") == ""
        assert (row.text or "") == before[doc] if not spans else "[SECRET]" in row.text and row.n_chars == len(row.text)
