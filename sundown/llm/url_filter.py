"""URL verdicts from rules and a tree of path templates.

Per host, whole paths are split into segments; digits become a wildcard, and so do the values of a
place that have fewer than ``SUPPORT`` labelled urls each, which are pooled; a value with more
labels stays literal. Bottom-up, siblings whose labelled block rates don't differ by more than
chance are merged at every level, unless branches below them differ. A node's share of blocked
labels is smoothed towards its parent's and decides the urls that no rule names. Labels are the
urls that a rule decides, unless a table of labels is given. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundown.session import cut_lineage

RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
SUPPORT = 4  # labelled urls that keep a segment literal: as many as the prior weighs
PRIOR_ROWS = 4.0  # weight of the parent's share
SAME_Z = 2.0  # block rates within so many standard deviations are the same
BLOCK_SHARE = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: str) -> Column:
    """Between the first ``://`` and the next /, ? or #; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_rule(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Add ``rule`` and ``ruled`` (its verdict): of the rules that fit, the longest; of those, the longest host."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))

    def fits(host: str, path: str) -> Column:
        own = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        return own & F.col("path").startswith(path)

    def first(part: Sequence[str]) -> Column:
        cases = [F.when(fits(h, p), F.lit(x)) for (h, p, _), x in zip(ordered, part)]
        return F.coalesce(*cases) if cases else F.lit(None).cast("string")

    return df.withColumns({"rule": first([h + p for h, p, _ in ordered]), "ruled": first([v for _, _, v in ordered])})


def path_shape(path: Column) -> Column:
    """The whole path with digits as a wildcard and without empty segments."""
    return F.array_join(F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, r"[0-9]+", "*")), "/")


def templates(counted: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """From (host, shape, blocked, known): (host, shape, node, template), and each level's (host, parent, node, blocked, known).

    Level by level from the root; where a path ends is a value (the empty one) like a segment. Below
    a node with too few labels nothing can be literal, so its rows are done, however deep they are.
    """
    segments = F.when(F.col("shape") == "", F.array(F.lit(""))).otherwise(F.concat(F.split("shape", "/"), F.array(F.lit(""))))
    live = counted.select(
        "host", "shape", segments.alias("left"), F.lit("/").alias("node"), F.lit("/").alias("template"), "blocked", "known"
    )
    roots = cut_lineage(_summed(live.withColumn("parent", F.lit(None).cast("string"))))
    done, levels = [], [roots]
    while True:
        nodes = levels[-1].filter(F.col("known") >= SUPPORT).select("host", "node")
        # The rest of a path below a node of few labels is pooled; its end shows in no template.
        rest = live.join(nodes, ["host", "node"], "left_anti")
        done.append(
            rest.select("host", "shape", "node", F.concat("template", F.repeat(F.lit("**/"), F.size("left") - 1)).alias("template"))
        )
        value = F.get("left", F.lit(0))
        open_ = live.join(nodes, ["host", "node"], "left_semi").withColumn("value", value)
        literal = (
            open_.groupBy("host", "node", "value").agg(F.sum("known").alias("k"))
            .filter(F.col("k") >= SUPPORT).select("host", "node", "value", F.lit(True).alias("literal"))
        )
        name = F.when(F.col("literal"), F.col("value")).otherwise(F.lit("**"))
        shown = F.when(F.col("value") == "", F.lit("")).otherwise(F.concat(name, F.lit("/")))
        stepped = cut_lineage(
            open_.join(literal, ["host", "node", "value"], "left").select(
                "host", "shape", F.slice("left", F.lit(2), F.size("left")).alias("left"), F.col("node").alias("parent"),
                F.concat("node", name, F.lit("/")).alias("node"), F.concat("template", shown).alias("template"), "blocked", "known",
            )
        )
        if stepped.isEmpty():
            return reduce(DataFrame.union, done), levels
        levels.append(cut_lineage(_summed(stepped)))
        done.append(stepped.filter(F.size("left") == 0).select("host", "shape", "node", "template"))
        live = stepped.filter(F.size("left") > 0).drop("parent")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("host", "parent", "node").agg(F.sum("blocked").alias("blocked"), F.sum("known").alias("known"))


def _smooth(blocked: Column, known: Column, prior: Column) -> Column:
    return (blocked + PRIOR_ROWS * prior) / (known + PRIOR_ROWS)


def _offset(rate: Column) -> Column:
    """How many deviations a node's rate, smoothed towards ``rate``, lies above it."""
    noise = F.sqrt(rate * (1 - rate) / (F.col("known") + PRIOR_ROWS))
    return (_smooth(F.col("blocked"), F.col("known"), rate) - rate) / noise


def _merged(level: DataFrame, above: DataFrame, split: DataFrame | None, total: Column) -> DataFrame:
    """The nodes of a level with whether they are ``one`` with all siblings, and the counts (``p_``) of the siblings they merge with.

    ``split`` names the nodes with branches that differ: those merge with no sibling.
    """
    parents = above.select("host", F.col("node").alias("parent"), F.col("blocked").alias("a_blocked"), F.col("known").alias("a_known"))
    rows = level.join(parents, ["host", "parent"])
    rows = rows.withColumn("split", F.lit(False)) if split is None else (
        rows.join(split.withColumn("split", F.lit(True)), ["host", "node"], "left").withColumn("split", F.coalesce("split", F.lit(False)))
    )
    far = _offset(_smooth(F.col("a_blocked"), F.col("a_known"), total))
    side = F.when(F.col("split"), 2).when(far > SAME_Z, 1).when(far < -SAME_Z, -1).otherwise(0)
    sided = rows.withColumn("side", side)
    pools = (
        sided.filter("side < 2").groupBy("host", "parent", "side")
        .agg(F.sum("blocked").alias("p_blocked"), F.sum("known").alias("p_known"))
    )
    whole = sided.groupBy("host", "parent").agg((F.max(F.abs("side")) == 0).alias("one"))
    joined = sided.join(pools, ["host", "parent", "side"], "left").join(whole, ["host", "parent"])
    alike = (F.col("side") < 2) & (F.abs(_offset(_smooth(F.col("p_blocked"), F.col("p_known"), total))) <= SAME_Z)
    return joined.select(
        "host", "parent", "node", "one",
        F.when(alike, F.col("p_blocked")).otherwise(F.col("blocked")).alias("blocked"),
        F.when(alike, F.col("p_known")).otherwise(F.col("known")).alias("known"),
    )


def purity(levels: list[DataFrame]) -> DataFrame:
    """(host, node, share) of every node: the smoothed share of blocked labels.

    Bottom-up, nodes within ``SAME_Z`` deviations of their siblings become one branch, also those
    that are above or below the others alike; where all are one, the parent stands for them. The
    prior of a node is its parent's share, and that of a host the share of all labels.
    """
    every = levels[0].agg(F.sum("blocked").alias("blocked"), F.sum("known").alias("known")).first()  # one row
    total = F.lit(((every["blocked"] or 0) + 1) / ((every["known"] or 0) + 2))
    merged: list[DataFrame] = []
    split = None
    for level, above in zip(reversed(levels[1:]), reversed(levels[:-1])):
        merged.append(cut_lineage(_merged(level, above, split, total)))
        split = merged[-1].filter("NOT one").select("host", F.col("parent").alias("node")).distinct()
    shares = [cut_lineage(levels[0].select("host", "node", _smooth(F.col("blocked"), F.col("known"), total).alias("share")))]
    for level in reversed(merged):
        prior = shares[-1].select("host", F.col("node").alias("parent"), F.col("share").alias("prior"))
        own = _smooth(F.col("blocked"), F.col("known"), F.col("prior"))
        shares.append(
            cut_lineage(
                level.join(prior, ["host", "parent"]).select(
                    "host", "node", F.when(F.col("one"), F.col("prior")).otherwise(own).alias("share")
                )
            )
        )
    return reduce(DataFrame.union, shares)


def url_verdicts(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, *, page_id: str = "page_id", url: str = "url",
    labels: DataFrame | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, share of every row.

    ``labels`` (page_id, block 0/1) replaces the rules' verdicts as labels. A url that is null or
    has no ``://`` has empty host and path, fits no rule and gets its template's verdict. Null
    and repeated page_ids stay rows of their own; an empty table gives no rows; other columns are
    ignored.
    """
    parsed = pages.select(F.col(page_id).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    shaped = cut_lineage(with_rule(parsed, rules).withColumn("shape", path_shape(F.col("path"))))
    known = F.col("ruled")
    source = shaped
    if labels is not None:
        given = labels.groupBy("page_id").agg(F.max("block").alias("_block"))
        source = shaped.join(given, "page_id", "left")
        known = F.when(F.col("_block") == 1, "block").when(F.col("_block") == 0, "allow")
    counted = cut_lineage(
        source.groupBy("host", "shape").agg(F.count(F.when(known == "block", 1)).alias("blocked"), F.count(known).alias("known"))
    )
    placed, levels = templates(counted)
    shares = cut_lineage(placed.join(purity(levels), ["host", "node"]).select("host", "shape", "template", "share"))
    judged = F.when(F.col("share") > BLOCK_SHARE, F.lit("block")).otherwise(F.lit("allow"))
    return shaped.join(shares, ["host", "shape"]).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "template", "share"
    )
