"""Preference formatting, fixity audit and URL verdicts on small tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from meterlens.llm import fixity, preferences, urls

TURNS = "conv_id long, turn long, role string, text string, turns string, n int, prompt string"


def talk(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "p") for r in rows], TURNS)


def formatted(spark, rows):
    pairs = preferences.reply_pairs(preferences.conversation_turns(talk(spark, rows)))
    return {r.pair_id: r for r in preferences.format_preferences(pairs).collect()}


def test_pairs_of_conversations(spark):
    long = "ü" * 200_000
    got = formatted(
        spark,
        [
            (1, 3, "assistant", "good"),
            (1, 0, "user", "hi"),
            (1, 1, "assistant", "first"),
            (1, 2, "user", "more"),
            (1, 2, "user", "more"),  # a repeated row
            (1, 4, "user", "bye"),
            (2, 0, "user", None),
            (2, 1, "assistant", long),
            (3, 0, "user", "nobody answers"),
            (4, 0, "assistant", "same"),
            (4, 1, None, "x"),
            (4, 2, "assistant", "same"),
            (None, 0, "assistant", "lost"),
            (5, None, "assistant", "lost"),
            (6, 0, "assistant", ""),
        ],
    )
    assert set(got) == {1, 2, 4, 6}
    one = got[1]
    assert one.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nfirst<|end|>\n<|user|>\nmore<|end|>\n"
    assert (one.chosen, one.rejected) == ("<|assistant|>\ngood<|end|>\n", "<|assistant|>\nfirst<|end|>\n")
    assert (one.common_turns, one.chosen_mask, one.rejected_mask) == (3, "0:14,1:12", "0:14,1:13")
    assert got[2].prompt == "<|user|>\n<|end|>\n" and len(got[2].chosen) == 14 + 200_000 + 8
    assert got[2].rejected == "<|assistant|>\n<|end|>\n"
    # nothing left to prefer: both replies are equal, so all is prompt
    assert (got[4].common_turns, got[4].chosen, got[4].rejected, got[4].chosen_mask) == (3, "", "", "")
    assert (got[6].common_turns, got[6].chosen) == (1, "")
    assert formatted(spark, []) == {}


def test_common_prefix_of_any_pair(spark):
    turn = preferences.TURN
    rows = [
        (1, [("user", "a"), ("assistant", "b"), ("user", "c")], [("user", "a"), ("assistant", "x")]),
        (2, [("user", "a")], [("user", "a"), ("assistant", "b")]),
        (3, None, [("assistant", None)]),
        (None, [], []),
        (5, [("user", None), ("assistant", "z")], [("user", None), ("user", "z")]),
    ]
    pairs = spark.createDataFrame(rows, f"pair_id long, chosen array<{turn}>, rejected array<{turn}>")
    got = {r.pair_id: r for r in preferences.format_preferences(pairs).collect()}
    assert {k: r.common_turns for k, r in got.items()} == {1: 1, 2: 1, 3: 0, None: 0, 5: 1}
    assert got[1].chosen_mask == "0:14,1:9,0:9,0:9"
    assert got[2].chosen == "" and got[2].rejected.startswith("<|assistant|>")
    assert got[3].rejected_mask == "0:14,1:8"
    for r in got.values():
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert sum(int(x.split(":")[1]) for x in mask.split(",") if x) == len(text)


def leaves(spark, rows):
    made = [(f, i, o, n, hashlib.sha256(body.encode()).hexdigest()) for f, i, o, n, body in rows]
    return spark.createDataFrame(made, "file_id long, record_id long, offset long, length long, hash string")


def test_audit_names_the_damaged_records(spark):
    size = fixity.RANGE // 3
    mine = [(f, i, i * size, size, f"{f}/{i}") for f in (1, 2, 3) for i in range(200)]
    theirs = [list(r) for r in mine if r[0] != 3]
    theirs[7][4] = "turned"
    theirs[150][4] = "turned"
    del theirs[210]
    theirs += [(2, 500, 200 * size, size, "new"), (9, 1, 0, 5, "unknown file")]
    got = {r.file_id: r for r in fixity.audit(leaves(spark, mine), leaves(spark, theirs)).collect()}
    assert set(got) == {1, 2, 3, 9}
    assert got[1].damaged == f"{7 * size}:changed,{150 * size}:changed"
    assert got[2].damaged == f"{10 * size}:missing,{200 * size}:extra"
    assert got[3].n_damaged == 200 and got[3].replica_root is None
    assert (got[9].root, got[9].n_records, got[9].damaged) == (None, 0, "0:extra")
    same = fixity.audit(leaves(spark, mine), leaves(spark, mine)).collect()
    assert all(r.root == r.replica_root and r.n_damaged == 0 for r in same)
    assert fixity.audit(leaves(spark, []), leaves(spark, [])).count() == 0


def test_roots_by_hand(spark):
    rows = [(1, 0, 0, 10, "a"), (1, 1, 10, fixity.RANGE, "b"), (1, 2, fixity.RANGE + 10, 5, "c")]
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    low = sha(f"0:{sha('a')},10:{sha('b')}")
    high = sha(f"{fixity.RANGE + 10}:{sha('c')}")
    row = fixity.audit(leaves(spark, rows), leaves(spark, rows)).first()
    assert row.root == sha(f"0:{low},1:{high}")


def test_audit_of_odd_pages(spark):
    rows = [(5, None, None), (5, None, None), (6, "u", ""), (7, "u", "x" * 300_000), (None, "u", "h"), (1499 + 7, "v", "<p>")]
    pages = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id long, url string, html string, offset int, hash string")
    got = {r.file_id: r for r in fixity.audit_pages(pages).collect()}
    assert got[0].n_records == 4 and got[1].n_records == 1
    assert got[0].n_damaged == 1 and got[0].damaged.endswith(":missing")  # 7 is lost; 5 has no mark to turn
    assert got[1].damaged == "0:missing" and got[1].replica_root is None
    assert fixity.audit_pages(pages.limit(0)).count() == 0


def verdicts(spark, pages, labels, **options):
    pages = spark.createDataFrame([(i, u, "<p>", "x", 0) for i, u in pages], "page_id long, url string, html string, host string, good int")
    labels = spark.createDataFrame(labels, "page_id long, good int")
    return urls.url_verdicts(pages, labels, **options).collect()


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://a.example.net/EN/x": ("a.example.net", "/EN/x", "net/", "block"),
        "http://badexample.net/en/": ("badexample.net", "/en/", "net/", "block"),
        "x://net/": ("net", "/", "net/", "block"),
        "x://net": ("net", "", None, "allow"),
        "https://m.example.com/de/1#x": ("m.example.com", "/de/1", "example.com/de/", "block"),
        "https://example.org/fr/": ("example.org", "/fr/", "org/fr/", "allow"),
        "https://example.org?u=http://x.net/": ("example.org", "", None, "allow"),
        "a\nb://h.İ/p\nq": ("h.İ", "/p\nq", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = verdicts(spark, list(enumerate(cases)) + [(None, "x://net/"), (3, "x://net/")], [])
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows}
    want = {(i, *v) for i, v in enumerate(cases.values())} | {(None, "net", "/", "net/", "block")}
    assert got == want and len(rows) == len(cases) + 2
    assert verdicts(spark, [], [(1, 1)]) == []


def test_templates_and_purity(spark):
    pages, labels = [], []
    for i in range(200):  # shop: good; old and deal: bad; their numbers vary
        part = ("shop", "old", "deal")[i % 3]
        pages.append((i, f"http://h.example/{part}/{i}/view"))
        labels.append((i, int(part == "shop")))
    pages += [(1000 + i, f"http://h.example/rare{i}") for i in range(5)]
    pages += [(2000, "http://h.example/a/b/c/d/e"), (2001, "http://other.example/x")]
    labels += [(0, 0), (0, 1), (None, 1)]
    got = {r.page_id: r for r in verdicts(spark, pages, labels)}
    assert got[0].template == "h.example/shop/*/view" and got[0].verdict == "allow"
    # old and deal can't be told apart by their labels and share a branch
    assert got[1].template == got[2].template == "h.example/{deal|old}/*/view"
    assert got[1].verdict == "block"
    assert got[1000].template == "h.example/*"
    assert got[2000].template == "h.example/*/*/*/**"
    # One host has labels, so nothing is known of how hosts differ: smoothing is at its most.
    good = 66  # 67 pages of the shop, one with a contradicting label
    overall = good / 200
    host = (good + 10 * overall) / 210
    assert abs(got[1].purity - (0 + 10 * host) / (133 + 10)) < 1e-8
    assert abs(got[2001].purity - overall) < 1e-8
    assert got[2001].verdict == "block"  # nothing known of it: the share of all labels decides


def test_levels_go_on_while_nodes_are_large(spark):
    pages = [(i, f"http://h.example/en/2024/05/{('ads', 'news')[i % 2]}/{i}") for i in range(60)]
    labels = [(i, i % 2) for i in range(60)]
    got = {r.page_id: r for r in verdicts(spark, pages, labels)}
    assert got[0].template == "h.example/en/2024/05/ads/*" and got[0].verdict == "block"
    assert got[1].template == "h.example/en/2024/05/news/*" and got[1].verdict == "allow"


def test_a_small_section_is_judged_by_its_own_labels(spark):
    """2 % of a host, all of its labels bad, in a node whose other sections are good; unlabelled sections are a wildcard."""
    sections = ["spam"] * 20 + [f"s{i % 97}" for i in range(980)]
    pages = [(i, f"http://big.example/{s}/{i}") for i, s in enumerate(sections)]
    labels = [(i, int(s != "spam")) for i, s in enumerate(sections) if i < 6 or i % 3 == 0]
    got = {r.page_id: r for r in verdicts(spark, pages, labels)}
    assert got[10].template == "big.example/spam/*" and got[10].verdict == "block"
    assert got[20].template == "big.example/*/*" and all(got[i].verdict == "allow" for i in range(20, 1000))


def test_a_host_with_six_bad_labels_is_blocked(spark):
    pages, labels = [], []
    for h in range(20):
        pages += [(100 * h + i, f"http://h{h}.example/p/{i}") for i in range(30)]
        labels += [(100 * h + i, int(i % 4 > 0)) for i in range(12)]  # three of four are good
    pages += [(9000 + i, f"http://bad.example/p/{i}") for i in range(30)]
    labels += [(9000 + i, 0) for i in range(6)]
    pages += [(9500 + i, f"http://new.example/p/{i}") for i in range(30)]
    got = {r.page_id: r for r in verdicts(spark, pages, labels)}
    assert all(got[9000 + i].verdict == "block" for i in range(30))
    assert all(got[100 * h + i].verdict == "allow" for h in range(20) for i in range(30))
    overall = 180 / 246
    assert all(got[9500 + i].verdict == "allow" and abs(got[9500 + i].purity - overall) < 1e-8 for i in range(30))


def test_smoothing_follows_the_spread_of_hosts(spark):
    fit = lambda rows: urls.fitted_smoothing(spark.createDataFrame(rows, "n long, good long"), 10.0)
    assert fit([(100, 75)] * 30) == (0.75, 10.0)
    apart = fit([(100, 100)] * 15 + [(100, 0)] * 15)
    assert apart == (0.5, 1.0)
    share, between = fit([(100, 90)] * 15 + [(100, 50)] * 15)
    assert share == 0.7 and 3 < between < 6
    assert fit([(0, 0)]) == (1.0, 10.0)


def test_spellings_do_not_clash(spark):
    """Literal stars and braces, very long urls, and branches of many segments."""
    stars = [(i, f"http://h.example/*/{i}") for i in range(40)] + [(100 + i, f"http://h.example/{i}x/y") for i in range(100)]
    braces = [(300 + i, "http://g.example/{a|b}/x") for i in range(40)] + [(400 + i, f"http://g.example/{'ab'[i % 2]}/x") for i in range(40)]
    long = [(600 + i, "http://l.example/" + "x" * 50_000 + f"/{i}/" + "y/" * 40) for i in range(9)]
    many = [(1000 + 10 * k + i, f"http://m.example/k{k:02d}/{i}") for k in range(20) for i in range(10)]
    labels = [(i, 0) for i in range(40)] + [(100 + i, 1) for i in range(100)] + [(300 + i, 0) for i in range(40)]
    labels += [(400 + i, 1) for i in range(40)]
    got = {r.page_id: r for r in verdicts(spark, stars + braces + long + many, labels)}
    assert got[0].template == "h.example/%2A/*" and got[0].verdict == "block"
    assert got[100].template == "h.example/*/y" and got[100].verdict == "allow"
    assert got[300].template == "g.example/%7Ba%7Cb%7D/x" and got[300].verdict == "block"
    assert got[400].template == "g.example/{a|b}/x" and got[400].verdict == "allow"
    assert got[600].template.startswith("l.example/" + "x" * 50_000 + "/*/y/y") and got[600].path.count("y/") == 40
    names = [f"k{k:02d}" for k in range(20)]
    assert got[1000].template == "m.example/{k00|20|" + hashlib.md5("|".join(names).encode()).hexdigest() + "}/{0|1|2|3|4|5|6|7|8|9}"


def test_a_hot_host_is_whole(spark):
    pages = spark.range(3000).select(
        F.col("id").alias("page_id"), F.concat(F.lit("http://one.example/p/"), F.col("id").cast("string")).alias("url")
    )
    labels = pages.select("page_id", F.lit(1).alias("good"))
    rows = urls.url_verdicts(pages, labels).groupBy("template", "verdict").count().collect()
    assert [(r["template"], r["verdict"], r["count"]) for r in rows] == [("one.example/p/*", "allow", 3000)]
