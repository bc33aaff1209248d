"""URL filters: fixed rules and a path-template tree, in Spark's own functions.

The tree: urls are counted by host and path segments, runs of digits being one
wildcard ``<n>`` from the start. A node is a host and what its urls' paths begin
with, in the shape of a template. At a position of what follows, the urls that reach
it branch by their segment there:

- a branch stands if it has ``SUPPORT`` labels and its share of bad ones differs
  from that of all its siblings together by a two-proportion test, whose limit grows
  with the number of labelled branches;
- a node is parted at the first position where a branch stands. Standing branches are
  merged, from the smallest share of bad labels on: each joins the group before it
  unless the test tells it from the group's pooled counts. Shares are first told apart
  in steps of 1/``STEPS``, which bounds what is compared. All other branches, labelled
  or not, are the wildcard ``*``, as are the segments passed over;
- a url that ends before that position, or whose node is not parted, is done: its
  template ends in ``*`` for whatever follows.

So unlabelled branches never join labelled ones that stand, no number of branches or
segments is too large, and a round costs the urls of nodes that hold good and bad
labels only, however long their paths.
A template is rejected if the smoothed share of good labels among its labelled urls
is too low. Labels are 1 (good), 0 (bad) or null (none). A null url, or one without
"://", has an empty host and path and belongs to that host's tree. Repeated rows
count as often as they come; an empty table gives an empty result; equal shares are
one step, so ties need no rule; urls may be of any length. Extra columns are kept,
and those named like results are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, without

#: Standard deviations below which two shares count as alike.
ALIKE = 1.64
#: Labels below which a branch has no share of its own.
SUPPORT = 10
#: Steps in which shares of bad labels are told apart.
STEPS = 64
#: Segments that the name of a merged group lists.
NAMED = 12
#: Prior good and bad urls of a template, and the least share of good ones.
SMOOTH = (4.0, 1.0)
LEAST_GOOD = 0.5

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The part between the first :// and /, ?, # with A-Z lower-cased; then the
    part up to ? or #."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _CAPITALS, _CAPITALS.lower()), path


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule "host/path": it fits the host and all subdomains
    if the path starts with its own."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the longest is asked first
        own, _, start = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{start}"))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _segments(path: Column) -> Column:
    """All segments: runs of digits stand for themselves as <n>."""
    parts = F.split(F.regexp_replace(path, "[0-9]+", "<n>"), "/")
    return F.slice(parts, 2, F.size(parts))


def _far(bad: Column, n: Column, other_bad: Column, other_n: Column, limit: Column) -> Column:
    """Whether two shares differ by more than ``limit`` deviations; never null."""
    share, other = F.try_divide(bad, n), F.try_divide(other_bad, other_n)
    both = F.try_divide(bad + other_bad, n + other_n)
    chance = F.sqrt(both * (1 - both) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), other_n)))
    return F.coalesce(F.abs(share - other) > limit * chance, F.lit(False))


def _groups(standing: DataFrame, alike: float) -> DataFrame:
    """(host, template, step, grp): which steps of bad labels' shares are one group.
    A node has at most ``STEPS`` + 1 steps, whatever its branches."""
    steps = standing.groupBy("host", "template", "step").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    nodes = steps.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("step", "good", "bad"))).alias("steps"))

    def fold(acc, x):
        n, acc_n = x["good"] + x["bad"], acc["good"] + acc["bad"]
        new = _far(x["bad"], n, acc["bad"], acc_n, F.lit(alike))
        grp = F.when(new, acc["grp"] + 1).otherwise(acc["grp"])
        keep = lambda c: F.when(new, F.lit(0).cast("long")).otherwise(acc[c])
        return F.struct(
            (keep("good") + x["good"]).alias("good"), (keep("bad") + x["bad"]).alias("bad"), grp.alias("grp"),
            F.concat(acc["out"], F.array(F.struct(x["step"].alias("step"), grp.alias("grp")))).alias("out"),
        )

    nothing = F.lit(0).cast("long")
    start = F.struct(nothing.alias("good"), nothing.alias("bad"), F.lit(0).alias("grp"), F.array().cast("array<struct<step:int,grp:int>>").alias("out"))
    return nodes.select("host", "template", F.inline(F.aggregate("steps", start, fold)["out"]))


def _names(standing: DataFrame) -> DataFrame:
    """(host, template, grp, name): the first ``NAMED`` segments, and the number of
    the others. Groups of a node share no segment, so no two have one name."""
    group = ["host", "template", "grp"]
    sizes = standing.groupBy(*group).agg(F.count("*").alias("size"))
    first = standing.withColumn("at", F.row_number().over(Window.partitionBy(*group).orderBy("seg"))).filter(F.col("at") <= NAMED)
    lists = first.groupBy(*group).agg(F.array_join(F.sort_array(F.collect_list("seg")), "|").alias("list"))
    more = F.when(F.col("size") > NAMED, F.concat(F.lit("|+"), (F.col("size") - NAMED).cast("string"))).otherwise("")
    return lists.join(sizes, group).select(*group, F.concat("list", more).alias("name"))


def _standing(live: DataFrame, support: int, alike: float) -> DataFrame:
    """(host, template, pos, seg, good, bad, step): the branches that stand, at the
    first position of their node where any does."""
    node = ["host", "template"]
    sums = live.groupBy(*node).agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    mixed = sums.filter((F.col("g") > 0) & (F.col("b") > 0) & (F.col("g") + F.col("b") > support)).select(*node)
    known = live.filter(F.col("good") + F.col("bad") > 0).join(mixed, node, "left_semi")
    branches = known.select(*node, "good", "bad", F.posexplode("rest").alias("pos", "seg")).groupBy(*node, "pos", "seg").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    level = branches.groupBy(*node, "pos").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"), F.count("*").alias("width"))
    n, total = F.col("good") + F.col("bad"), F.col("all_good") + F.col("all_bad")
    limit = F.greatest(F.lit(alike), F.sqrt(2 * F.log("width")))
    # "*" itself is the wildcard's name
    own = (n >= support) & (F.col("seg") != "*") & _far(F.col("bad"), n, F.col("all_bad") - F.col("bad"), total - n, limit)
    step = F.round(F.try_divide("bad", n) * STEPS).cast("int")
    stand = materialise(branches.join(level, [*node, "pos"]).filter(own).select(*node, "pos", "seg", "good", "bad", step.alias("step")), "url-branches")
    first = stand.groupBy(*node).agg(F.min("pos").alias("pos"))
    return stand.join(first, [*node, "pos"])


def templates(paths: DataFrame, support: int = SUPPORT, alike: float = ALIKE) -> DataFrame:
    """``paths`` (host, path segments ``segs``, good, bad) with ``template``."""
    node, columns = ["host", "template"], [*paths.columns, "template"]
    live, settled = paths.withColumn("template", F.lit("")).withColumn("rest", F.col("segs")), []
    done = F.when(F.size("rest") > 0, F.concat("template", F.lit("/*"))).otherwise(F.col("template"))
    while True:
        standing = _standing(live, support, alike)
        if standing.isEmpty():
            settled.append(live.withColumn("template", done).select(*columns))
            return reduce(DataFrame.unionAll, settled)
        grouped = standing.join(_groups(standing, alike), [*node, "step"])
        named = grouped.join(_names(grouped), [*node, "grp"]).select(*node, F.col("seg").alias("next"), "name")
        at = live.join(standing.select(*node, "pos").distinct(), node, "left").withColumn("next", F.get("rest", F.col("pos")))
        template = F.concat("template", F.repeat(F.lit("/*"), F.col("pos")), F.lit("/"), F.coalesce("name", F.lit("*")))
        rest = F.slice("rest", F.col("pos") + 2, F.size("rest"))
        going = F.col("next").isNotNull()
        step = at.join(named, [*node, "next"], "left").select(
            *paths.columns, F.when(going, template).otherwise(done).alias("template"), F.when(going, rest).alias("rest"))
        step = materialise(step, "url-level")
        settled.append(step.filter(F.col("rest").isNull()).select(*columns))
        live = step.filter(F.col("rest").isNotNull())


def judge(
    urls: DataFrame, rules: dict[str, str], url_col: str = "url", label_col: str = "label",
    smooth: tuple[float, float] = SMOOTH, least_good: float = LEAST_GOOD, support: int = SUPPORT, alike: float = ALIKE,
) -> DataFrame:
    """``urls`` with host, path, rule, template, good_share and verdict: allow or
    block. ``rules`` maps "host/path" to a verdict, which wins over the tree's."""
    urls = without(urls, "host", "path", "rule", "template", "good_share", "verdict")
    segs = "__tw_segs"
    host, path = host_and_path(F.col(f"`{url_col}`"))
    own = urls.withColumns({"host": host, "path": path}).withColumn(segs, _segments(F.col("path")))
    label = F.col(f"`{label_col}`")
    paths = own.groupBy("host", F.col(segs).alias("segs")).agg(F.count_if(label == 1).alias("good"), F.count_if(label == 0).alias("bad"))
    tree = templates(materialise(paths, "url-paths"), support, alike)
    pure = tree.groupBy("host", "template").agg(((F.sum("good") + smooth[0]) / (F.sum("good") + F.sum("bad") + sum(smooth))).alias("good_share"))
    judged = tree.join(pure, ["host", "template"]).select("host", F.col("segs").alias(segs), "template", "good_share")
    fixed = F.lit(None).cast("string")
    for name, what in rules.items():
        fixed = F.when(F.col("rule") == name, F.lit(what)).otherwise(fixed)
    method = F.when(F.col("good_share") < least_good, "block").otherwise("allow")
    out = own.join(judged, ["host", segs]).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("verdict", F.coalesce(fixed, method))
    return out.select(*[F.col(f"`{c}`") for c in urls.columns], "host", "path", "rule", "template", "good_share", "verdict")
