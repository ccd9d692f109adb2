"""The pipeline stage by stage against plain Python, and as a whole."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from meterlens.llm import quality
from test_text_operators import base_figures, classes_by_hand, shingle_set, simhash_by_hand, spans_by_hand

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("ther", "on", "in", "ed", "est") for b in ("ly", "ing", "er", "ha", "ou", "an")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(rng.randrange(12, 30))) for i in range(5)]
    rows = [prose(rng.randrange(30, 300)) for _ in range(60)]
    rows += [rows[3], rows[3], rows[4] + " end"]  # copies
    rows += [prose(40) + " " + items[2][1] + " " + prose(40)]  # a leak
    rows += [prose(50) + ' token = "' + "0123456789abcdef" * 2 + '" ' + prose(20)]
    rows += [None, "", "too short", (prose(6) + " ") * 20]
    rows += ["ZZ!! QQ!! " + " ".join(rng.choice(("AA!!", "BB!!", "CC!!")) + str(i) for i in range(80)) for _ in range(6)]
    table = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)]
    table += [table[0], (None, prose(30), "en", None, 1)]
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(i, 0, 0) for i in range(len(rows) - 6, len(rows))]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(table, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_stages(spark, corpus):
    folder, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "decontamination", "secrets", "packing"]

    kept = stages["quality_rules"](spark, docs, folder)
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {(r.doc_id, r.n_words): r.score for r in quality.quality_verdicts(docs, model).collect()}
    good = [
        r for r in docs.collect()
        if not base_figures(r.text or "")[-1] and scores[r.doc_id, base_figures(r.text)[0]] >= model.threshold
    ]
    assert rows_of(kept) == Counter(map(tuple, good)) and kept.columns == docs.columns
    assert {r.doc_id for r in good} >= set(range(60)) and not {r.doc_id for r in good} & {67, 68, 69}

    one = stages["near_duplicates"](spark, kept, folder)
    prints = [(r.doc_id, simhash_by_hand(r.text)) for r in good]
    classes = classes_by_hand({fp for _, fp in prints})
    least = {}
    for doc, fp in prints:
        mine = (doc is None, doc or 0)
        least[classes[fp]] = min(mine, least.get(classes[fp], mine))
    want = {tuple(r) for r in good if (r.doc_id is None, r.doc_id or 0) == least[classes[simhash_by_hand(r.text)]]}
    assert rows_of(one) == Counter(want) and {60, 61} & {r.doc_id for r in one.collect()} == set()

    clean = stages["decontamination"](spark, one, folder)
    sets = [shingle_set(t) for _, t in items]
    held = lambda t: any(len(q & shingle_set(t)) >= 0.8 * len(q) for q in sets)
    assert rows_of(clean) == Counter(r for r in want if not held(r[1]))
    assert 63 not in {r.doc_id for r in clean.collect()}

    masked = stages["secrets"](spark, clean, folder)
    assert masked.columns == docs.columns and masked.count() == clean.count()
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in masked.collect():
        assert spans_by_hand(r.text) == ""
        if not spans_by_hand(before[r.doc_id]) and not re.search(r"\d", before[r.doc_id]):
            assert r.text == before[r.doc_id]
    assert "[SECRET]" in {r.doc_id: r.text for r in masked.collect()}[64]

    packed = stages["packing"](spark, masked, folder)
    ends = packed.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id for r in ends} == {r.doc_id for r in masked.collect()}
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in ends)


def test_run_is_the_stages_in_turn(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert rows_of(corpus_pipeline.run(spark, folder).select(*names)) == rows_of(docs.select(*names))


def test_empty_tables_pass_through(spark, corpus, tmp_path):
    folder, _ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
