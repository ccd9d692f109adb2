"""Periodic runs, token alignment and mixing against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from meterlens.llm import mixing, periodic_runs, token_alignment
from meterlens.llm.encoding import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Extra columns with names that the operators use themselves.
SCHEMA = "doc_id long, text string, source string, runs int, links string, size string, at int, bucket int, groups int"


def corpus_rows():
    rng = random.Random(12)
    words = ["the", "söß", "中文", "on,", "don't", "<|endoftext|>", "<s>", "<0x41>", "x1", "▁", "a b", "\x00\x1f", "🙂", "é"]
    texts = [None, "", " \n\t", "one", "x " * 40, "a b " * 9 + "a", " lead", "trail ", "two  spaces", "▁ only", "tab\tand\nline", "é" * 3000]
    texts += ["lorem ipsum dolor " * 700, " ".join(f"w{i % 37}" for i in range(4000))]
    for _ in range(60):
        base = [rng.choice(words[:9]) for _ in range(rng.randrange(1, 90))]
        if rng.random() < 0.5:
            at, p = rng.randrange(len(base)), rng.randrange(1, 9)
            base[at:at] = (base[at : at + p] * 30)[: rng.randrange(1, 80)]
        texts.append(" ".join(base))
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    rows = [(i, t, f"s{i % 5}" if i % 11 else None, 1, "l", "z", 2, 3, 4) for i, t in enumerate(texts)]
    return rows + [rows[9], rows[9], (None, "no id " * 20, "s1", *[None] * 6), (None, None, None, *[None] * 6)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def runs_by_hand(words, least=12):
    n, found = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i:
                found.add((i, j - i + q, q))
            i = j + 1
    long = {(s, l, q) for s, l, q in found if l >= max(least, 2 * q)}
    smaller = lambda s, l, q: any(words[s + k] != words[s + k + r] for k in range(l - r))
    kept = []
    for s, l, q in long:
        if all(any(words[s + k] != words[s + k + r] for k in range(l - r)) for r in range(1, q)):
            kept.append((s, l, q))
    return sorted(kept, key=lambda r: (r[0], r[2]))


def collapsed_by_hand(words, runs):
    gone = {i for s, l, q in runs for i in range(s + q, s + l)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("alphabet", [1, 2, 3, 6])
@pytest.mark.parametrize("least", [1, 4, 12])
def test_runs_of_random_words(alphabet, least):
    rng = random.Random(alphabet * 100 + least)
    for _ in range(40):
        seq = [rng.randrange(alphabet) for _ in range(rng.randrange(1, 60))]
        if rng.random() < 0.5:
            seq = (seq[: rng.randrange(1, 9)] * 12)[: rng.randrange(2, 70)] + seq[:5]
        got = [tuple(r) for r in periodic_runs.runs_of([*seq, alphabet], least).tolist()]
        assert got == runs_by_hand(seq, least)
        words = [str(x).encode() for x in seq]
        stretches = periodic_runs.repeating_stretches(np.array([hash(w) for w in words]).view(np.uint64), np.array([len(seq)]), least)
        pruned = periodic_runs.document_runs(words, [(a, b) for _, a, b in stretches], least).tolist() if stretches else []
        assert [tuple(r) for r in pruned] == runs_by_hand(seq, least)


def test_common_extensions_of_a_fibonacci_word():
    a, b = [0], [0, 1]
    while len(b) < 200:
        a, b = b, b + a
    seq = [*b, 2]
    tree = periodic_runs.SuffixTree(seq)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(seq)), np.arange(len(seq))))
    i, j = i[i != j], j[i != j]
    want = [next(k for k in range(len(seq)) if seq[x + k] != seq[y + k]) for x, y in zip(i[::97].tolist(), j[::97].tolist())]
    assert tree.common(i[::97], j[::97]).tolist() == want
    ranked = sorted(range(len(seq)), key=lambda x: seq[x:])
    assert np.argsort(tree.place).tolist() == ranked


def test_runs_of_documents(spark, docs, empty):
    got = collections.Counter()
    for r in periodic_runs.find_runs(docs).collect():
        got[r.doc_id, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed] += 1
    want = collections.Counter()
    for doc, text, *_ in corpus_rows():
        words = WORD.findall(text or "")
        runs = runs_by_hand(words) if len(words) < 3000 else known_long(words)
        want[doc, tuple(runs), collapsed_by_hand(words, runs)] += 1
    assert got == want
    assert sum(len(k[1]) for k in got) > 25
    assert periodic_runs.find_runs(empty).count() == 0


def known_long(words):
    q = next(q for q in range(1, 50) if words[q:] == words[:-q])
    return [(0, len(words), q)]


def test_run_digests_over_repeated_tails(spark, docs, empty):
    query = lambda d: periodic_runs.run_digests(periodic_runs.find_runs(periodic_runs.with_repeated_tails(d)))
    want = collections.Counter()
    planted = 0
    for doc, text, *_ in corpus_rows():
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = runs_by_hand(words) if n < 3000 or planted else known_long(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        lines = "".join(f"{s},{l},{q}\n" for s, l, q in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[doc, len(runs), *best, milli, digest(lines), digest(collapsed_by_hand(words, runs))] += 1
    got = collections.Counter(map(tuple, query(docs).collect()))
    assert planted > 5 and got == want
    assert query(empty).count() == 0


def alignment_by_hand(texts):
    """(ids a, ids b, groups, links) of each text, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    letters = token_alignment.byte_level_bytes(a)
    pieces = token_alignment.piece_bytes(b)
    out = []
    for text in texts:
        if not text:
            out.append(([], [], "", []))
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        whole = (" " + text).encode()
        if b"".join(letters[i] for i in ids_a) != whole or b"".join(pieces[i] for i in ids_b) != whole:
            out.append(([], [], "", []))
            continue
        ends = lambda ids, table: np.cumsum([len(table[i]) for i in ids]).tolist()
        ends_a, ends_b = ends(ids_a, letters), ends(ids_b, pieces)
        groups, links, low_a, low_b = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, ids_a[low_a:i])) + "|" + ",".join(map(str, ids_b[low_b:j])))
            links.append((ids_a[i - 1], ids_b[j - 1]))
            low_a, low_b = i, j
        out.append((ids_a, ids_b, ";".join(groups), links))
    return out


@pytest.mark.parametrize("hot", [1, 20, 300_000])
def test_alignment_figures(spark, docs, empty, hot):
    rows = corpus_rows()
    found = alignment_by_hand([t for _, t, *_ in rows])
    counts = collections.Counter(link for *_, links in found for link in links)
    most = collections.defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = collections.Counter()
    for (doc, *_), (ids_a, ids_b, groups, links) in zip(rows, found):
        digest = hashlib.sha256(groups.encode()).hexdigest() if ids_a else ""
        best = sum(counts[link] == most[link[1]] for link in links)
        total = sum(counts[link] for link in links)
        want[doc, len(ids_a), len(ids_b), len(links), len(links), best, total, digest] += 1
    got = token_alignment.alignment_figures(docs, hot_links=hot, lane_bytes=100)
    assert collections.Counter(map(tuple, got.collect())) == want
    assert sum(bool(ids) for ids, *_ in found) > 80 and sum(not ids for ids, *_ in found) > 4
    assert token_alignment.alignment_figures(empty, hot_links=hot).count() == 0


def test_groups_and_links_are_spelled(spark, docs):
    rows = corpus_rows()
    got = collections.Counter(
        (r.doc_id, r.groups, tuple(divmod(x, 32_000) for x in r.links)) for r in token_alignment.aligned_tokens(docs).collect()
    )
    found = alignment_by_hand([t for _, t, *_ in rows])
    assert got == collections.Counter((r[0], groups, tuple(links)) for r, (_, _, groups, links) in zip(rows, found))


@pytest.mark.parametrize("lane", [1, 7, 64, 10**6])
def test_lanes_give_the_same_links(lane):
    rng = np.random.default_rng(lane)
    a = np.unique(np.append(rng.integers(1, 5000, 1500), 5000))
    b = np.unique(np.append(rng.integers(1, 5000, 1200), 5000))
    edges = np.unique(np.append(np.arange(lane, 5000, lane), 5000))
    i, j = token_alignment.meeting_ends(a, b, edges)
    assert a[i].tolist() == b[j].tolist() == np.intersect1d(a, b).tolist()


def targets_by_hand(sizes, weights):
    total, out, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        share = sum(weights[i] for i in open_)
        now = {i: total * weights[i] / share for i in open_}
        over = {i for i in open_ if now[i] > 3 * sizes[i]}
        for i in over or open_:
            out[i] = 3 * sizes[i] if over else now[i]
        if not over:
            break
        total -= sum(3 * sizes[i] for i in over)
        open_ -= over
    return out


def test_targets():
    for sizes in ([10, 10, 10], [1000, 1, 5, 0, 70], [0, 0], [1], [5, 5000, 5000, 1, 1, 1, 9]):
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        got = mixing.targets(sizes, weights)
        assert got == pytest.approx(targets_by_hand(sizes, weights))
        assert got.sum() == pytest.approx(sum(sizes)) and (got <= 3 * np.array(sizes) + 1e-9).all()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 1000])
def test_permutations(n):
    places = [mixing.permuted(np.arange(n), n, [1, k]) for k in range(3)]
    assert all(sorted(p.tolist()) == list(range(n)) for p in places)
    assert n < 10 or (places[0] != places[1]).any()


def test_splitting_tree_deals_every_block_once():
    totals = np.array([100, 0, 7, 1000, 1])
    tree = mixing.SplittingTree(totals, 13, 4)
    before = np.zeros(5, np.int64)
    sizes = []
    for shard in range(13):
        first, mine = tree.shard(shard)
        assert first.tolist() == before.tolist()
        before = before + mine
        sizes.append(int(mine.sum()))
    assert before.tolist() == totals.tolist() and max(sizes) - min(sizes) <= 1
    other = mixing.SplittingTree(totals, 13, 4)
    assert [other.shard(k)[1].tolist() for k in (9, 2)] == [tree.shard(k)[1].tolist() for k in (9, 2)]
    draws = np.array([mixing.SplittingTree(np.array([300, 100]), 4, s).shard(0)[1][0] for s in range(300)])
    assert abs(draws.mean() - 75) < 1 and abs(draws.var() - 100 * 0.75 * 0.25 * 300 / 399) < 4


@pytest.mark.parametrize("block", [7, 2048])
def test_mix_meets_its_targets(spark, docs, empty, block):
    made = mixing.mix(docs, block_words=block, blocks_per_shard=40)
    rows = corpus_rows()
    size = lambda t: len(WORD.findall(t or ""))
    got = made.documents.collect()
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((d, size(t)) for d, t, *_ in rows)
    sizes = collections.Counter()
    for _, text, source, *_ in rows:
        sizes[source] += size(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, targets_by_hand([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    taken = collections.Counter()
    for r in got:
        assert r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in order)

    pieces = made.pieces.collect()
    assert sum(p.length for p in pieces) == sum(taken.values())
    places = collections.defaultdict(list)
    words = collections.Counter()
    for p in pieces:
        places[p.shard].append(p.place)
        words.update((p.doc_id, p.mark, p.copy, p.round, k) for k in range(p.start, p.start + p.length))
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    assert max(words.values()) == 1  # a round takes no word twice

    text_of = collections.defaultdict(set)
    for doc, text, *_ in rows:
        text_of[doc].add(tuple(WORD.findall(text or "")))
    for p in mixing.shard_texts(made.pieces, docs).collect():
        part = tuple(p.text.split(" "))
        assert any(w[p.start : p.start + len(part)] == part for w in text_of[p.doc_id])

    again = mixing.mix(docs.repartition(5), block_words=block, blocks_per_shard=40).documents
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    assert mixing.mix(empty).documents.count() == 0 and mixing.mix(empty).pieces.count() == 0
    blank = spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id int, text string, source string")
    assert sorted((r.doc_id, r.taken, r.target) for r in mixing.mix(blank).documents.collect()) == [(1, 0, 0.0), (2, 0, 0.0)]


def test_many_copies_are_numbered(spark):
    rows = spark.createDataFrame([(1, 3), (2, 11)], "k int, copies long")
    got = sorted((r.k, r.copy) for r in mixing._each_copy(rows, chunk=4).collect())
    assert got == [(1, i) for i in range(3)] + [(2, i) for i in range(11)]
