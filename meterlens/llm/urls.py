"""URL verdicts: fixed host and path rules, and per host a tree of path templates judged by labelled pages.

Native DataFrame functions only. Level by level, the segments of a host's paths become nodes: segments that hold a share
of their node, or whose labels differ from those of its rest, stay themselves, all others are one wildcard; of those that
stay, neighbours in purity that labels can't tell apart are merged. Templates whose smoothed share of good labels is low
are rejected; how strongly they are smoothed follows from how much the hosts' labels differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from meterlens.llm.common import cut

# The rules, verdict, host and start of the path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: A branch of more segments than this is named by a digest.
MOST_NAMED = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    name = lambda r: r[1] + r[2]
    fits = lambda r: ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
    longest = sorted(rules, key=lambda r: (-len(name(r)), name(r)))
    cases = [(fits(r), F.struct(F.lit(name(r)).alias("rule"), F.lit(r[0]).alias("verdict"))) for r in longest]
    return reduce(lambda made, c: made.when(*c), cases[1:], F.when(*cases[0]))


def _spelled(segment: Column) -> Column:
    """A segment as it stands in a template, where `*`, `{`, `|` and `}` mean branches."""
    for sign in "%*{|}":
        segment = F.replace(segment, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return segment


def _counts(rows: DataFrame, level: int) -> DataFrame:
    """Rows and labels of every segment of a level, with those of its whole node."""
    keys = ["host", "prefix"]
    counts = rows.groupBy(*keys, F.element_at("segments", level).alias("segment")).agg(
        F.count("*").alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")
    )
    whole = counts.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.sum("labelled").alias("all_labelled"), F.sum("good").alias("all_good")
    )
    return counts.join(whole, keys)


def _parts(counts: DataFrame, least_share: float, least_count: int, z: float) -> DataFrame:
    """(host, prefix, segment, part): the part of a template that a segment becomes, for those that aren't wildcards.

    At most 1 / least_share segments of a node stay by their share, the others by two labels or more each; the windows
    are over these. Members of a large branch stand in its name by a digest.
    """
    keys = ["host", "prefix"]
    purity = lambda good, n: good / F.greatest(n, F.lit(1))
    rest_n, rest_good = F.col("all_labelled") - F.col("labelled"), F.col("all_good") - F.col("good")
    share = purity(F.col("all_good"), F.col("all_labelled"))
    spread = F.sqrt(share * (1 - share) * (1 / F.greatest("labelled", F.lit(1)) + 1 / F.greatest(rest_n, F.lit(1))))
    gap = F.abs(purity(F.col("good"), F.col("labelled")) - purity(rest_good, rest_n))
    differs = (F.col("labelled") > 0) & (rest_n > 0) & (gap > z * spread)
    staying = counts.where(
        (F.col("n") >= least_count) & ((F.col("n") >= least_share * F.col("total")) | differs)
    ).withColumn("purity", purity(F.col("good"), F.col("labelled")))
    by_purity = Window.partitionBy(*keys).orderBy("purity", "segment")
    lag = lambda c: F.lag(c).over(by_purity)
    pooled = (F.col("good") + lag("good")) / F.greatest(F.col("labelled") + lag("labelled"), F.lit(1))
    step = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest("labelled", F.lit(1)) + 1 / F.greatest(lag("labelled"), F.lit(1))))
    # a branch without labels can't be told from its neighbour
    apart = F.coalesce(
        (F.col("labelled") > 0) & (lag("labelled") > 0) & (F.col("purity") - lag("purity") > z * step), F.lit(False)
    )
    branches = staying.withColumn("branch", F.sum(apart.cast("int")).over(by_purity))
    named = branches.groupBy(*keys, "branch").agg(F.sort_array(F.collect_list(_spelled(F.col("segment")))).alias("members"))
    joined = F.array_join("members", "|")
    few = F.concat(F.lit("{"), joined, F.lit("}"))
    many = F.concat(F.lit("{"), F.get("members", F.lit(0)), F.lit("|"), F.size("members").cast("string"), F.lit("|"), F.md5(joined), F.lit("}"))
    size = F.size("members")
    part = F.when(size == 1, joined).when(size <= MOST_NAMED, few).otherwise(many)
    return branches.join(named.withColumn("part", part), [*keys, "branch"]).select(*keys, "segment", "part")


def path_templates(
    pages: DataFrame, labels: DataFrame, *, least_share: float = 0.05, least_count: int = 8, z: float = 2.0
) -> DataFrame:
    """(page_id, url, host, path, good, template) of every row of (page_id, url); labels are (page_id, good 0 or 1).

    Levels go on until no node has `least_count` rows with a further segment; what is left of a path then is one `**`.
    Each level ends in a written table of the rows that have segments left. The rows of a hot host or node meet its
    staying segments in a join that Spark may split. Literal `%*{|}` are percent-encoded in templates.
    """
    known = labels.where("page_id is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    url = F.col("url")
    rows = cut(
        pages.select("page_id", "url")
        .join(known, "page_id", "left")
        .select("page_id", "url", "good", host_of(url).alias("host"), path_of(url).alias("path"))
        .withColumn("segments", F.array_remove(F.split("path", "/"), ""))
        .withColumn("prefix", F.lit(""))
    )
    columns = ["page_id", "url", "host", "path", "good"]
    ended, level = [], 1
    while True:
        ended.append(rows.where(F.size("segments") < level).select(*columns, F.concat("host", "prefix").alias("template")))
        left = rows.where(F.size("segments") >= level)
        counts = cut(_counts(left, level))
        most = counts.agg(F.max("total")).first()[0]
        if most is None or most < least_count:
            ended.append(left.select(*columns, F.concat("host", "prefix", F.lit("/**")).alias("template")))
            return reduce(DataFrame.unionByName, ended)
        parts = _parts(counts, least_share, least_count, z)
        joined = left.withColumn("segment", F.element_at("segments", level)).join(parts, ["host", "prefix", "segment"], "left")
        step = F.concat("prefix", F.lit("/"), F.coalesce("part", F.lit("*")))
        rows = cut(joined.withColumn("prefix", step).drop("segment", "part"))
        level += 1


def fitted_smoothing(hosts: DataFrame, most: float) -> tuple[float, float]:
    """Share of good labels, and how many labels of that share every host is taken to have had before its own.

    `hosts` has (n, good) per host. By moments of a beta-binomial: the more the hosts' shares spread beyond chance, the
    fewer; from 1 to `most`, which also stands where they spread no further than chance.
    """
    n, good = F.col("n"), F.col("good")
    r = hosts.where("n > 0").agg(
        F.sum(n).alias("n"), F.sum(good).alias("good"), F.sum(good * good / n).alias("squares"),
        F.count("*").alias("hosts"), F.sum(n * n).alias("sizes"),
    ).first()
    if not r["n"]:
        return 1.0, most
    share = r["good"] / r["n"]
    chance = share * (1 - share)
    room = r["n"] - r["sizes"] / r["n"]
    between = (r["squares"] - share * share * r["n"] - (r["hosts"] - 1) * chance) / room if room > 0 else 0.0
    return share, round(min(most, max(1.0, chance / between - 1)), 6) if between > 1e-9 else most


def url_verdicts(
    pages: DataFrame, labels: DataFrame, *, most_smoothing: float = 10.0, least_purity: float = 0.5, **tree
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of (page_id, url).

    The rule's verdict stands where one fits. Else the template decides: its share of good labels, smoothed towards that
    of its host, which is smoothed towards that of all labels (allow where nothing is labelled). The strength is that of
    `fitted_smoothing`; at its most, six bad labels of six reject a template where up to four labels of five are good.
    Null urls and those without `://` have an empty host and path and are judged together. Repeated and null ids keep
    their rows; labels that contradict each other count as not good; other columns are not read.
    """
    rows = cut(path_templates(pages, labels, **tree))
    templates = rows.groupBy("host", "template").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = templates.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    share, smoothing = fitted_smoothing(hosts, most_smoothing)
    hosts = hosts.withColumnsRenamed({"n": "host_n", "good": "host_good"})
    host = (F.col("host_good") + smoothing * F.lit(share)) / (F.col("host_n") + smoothing)
    purity = ((F.col("good") + smoothing * host) / (F.col("n") + smoothing)).alias("purity")
    judged = templates.join(hosts, "host").select("host", "template", purity)
    rule = rule_of(F.col("host"), F.col("path"))
    own = F.when(F.col("purity") < least_purity, F.lit("block")).otherwise(F.lit("allow"))
    return (
        rows.join(judged, ["host", "template"])
        .withColumn("fit", rule)
        .select(
            "page_id",
            "host",
            "path",
            F.col("fit.rule").alias("rule"),
            F.coalesce("fit.verdict", own).alias("verdict"),
            "template",
            F.round("purity", 9).alias("purity"),
        )
    )
