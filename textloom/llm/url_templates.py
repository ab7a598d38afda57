"""URL filters: explicit rules, and a tree of path templates judged by labelled purity.

All of it is DataFrame expressions. The tree is built per host on the distinct generalised paths,
one branching per round: segments that all paths of a node share are passed over at once, so the
number of rounds is that of the branchings on the deepest path, not that of its segments.

1. a segment with a digit is variable from the start; a node with more than ``most_children``
   different children has variable children, of which only those with a ``literal_share`` of the
   node's pages keep their name;
2. branches below one node whose shares of rejected labels do not differ by a two-proportion test
   are merged, so that their subtrees are counted together;
3. a branch's purity is (rejected + strength x purity of its parent) / (labelled + strength). The
   parents of a host are its last name (`net`), then all hosts, whose own parent is ``prior``;
4. a template with labels of its own is rejected from a purity of ``reject_at`` on. One without has
   its parent's purity, which is no evidence of its own: it is rejected from ``inherit_at`` on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (action, host, path) of the contract's rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(
    host: Column, path: Column, rules: Sequence[tuple[str, str, str]]
) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its action; null where none fits.

    A rule fits its host and the subdomains of it where the path starts with the rule's path.
    """
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verb, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(
            path, F.lit(rule_path))
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        action = F.when(fits, F.lit(verb)).otherwise(action)
    return text, action


def generalised(path: Column) -> Column:
    """The segments of a path, those with a digit as `*`."""
    return F.transform(
        F.filter(F.split(path, "/"), lambda s: s != ""),
        lambda s: F.when(s.rlike("[0-9]"), F.lit("*")).otherwise(s),
    )


def _smoothed(strength: float, prior: Column) -> Column:
    return (F.col("rejected") + strength * prior) / (F.col("labelled") + strength)


def host_purity(paths: DataFrame, strength: float, prior: float) -> DataFrame:
    """host, evidence (its labelled pages) and purity, smoothed by the last name of the host and
    that by all hosts."""
    counts = [F.sum(c).alias(c) for c in ("rejected", "labelled")]
    hosts = paths.groupBy("host").agg(*counts).withColumn(
        "top", F.regexp_extract("host", r"[^.]*$", 0))
    whole = paths.agg(*counts).select(_smoothed(strength, F.lit(prior))).first()[0]
    tops = hosts.groupBy("top").agg(*counts).select(
        "top", _smoothed(strength, F.lit(prior if whole is None else whole)).alias("above"))
    return hosts.join(tops, "top").select(
        "host", F.col("labelled").alias("evidence"),
        _smoothed(strength, F.col("above")).alias("purity"))


def _shared(low: Column, high: Column) -> Column:
    """How many first values two arrays have in common."""
    differs = F.array_position(F.zip_with(low, high, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differs == 0, F.size(low)).otherwise((differs - 1).cast("int"))


def _one_round(live: DataFrame, most_children: int, literal_share: float, z: float,
               strength: float) -> DataFrame:
    """Every path of ``live`` one branching further down; ``done`` where it ends."""
    node = ["host", "template"]
    # The first and last of a node's paths share what all of them share.
    prefix = live.groupBy(*node).agg(F.min("rest").alias("low"), F.max("rest").alias("high")).select(
        *node, _shared(F.col("low"), F.col("high")).alias("shared"))
    stepped = live.join(prefix, node).withColumn(
        "template", F.concat("template", F.array_join(F.transform(
            F.slice("rest", F.lit(1), F.col("shared")), lambda s: F.concat(F.lit("/"), s)), ""))
    ).withColumn(
        "rest", F.slice("rest", F.col("shared") + 1, F.size("rest"))
    ).withColumn("segment", F.get("rest", F.lit(0)))
    children = stepped.groupBy(*node, "segment").agg(
        *[F.sum(c).alias(c) for c in ("pages", "rejected", "labelled")],
        F.min("purity").alias("above"))
    nodes = children.groupBy(*node).agg(
        F.count("*").alias("ways"), F.count("segment").alias("children"),
        F.sum(F.when(F.col("segment").isNotNull(), F.col("pages"))).alias("node_pages"))
    named = children.join(nodes, node).withColumn(
        "label", F.when(
            (F.col("children") > most_children)
            & (F.col("pages") < F.col("node_pages") * literal_share)
            & F.col("segment").isNotNull(), F.lit("*")
        ).otherwise(F.col("segment")))
    # What is left of a node's children is bounded: most_children, or 1 / literal_share.
    branches = named.groupBy(*node, "label").agg(
        F.sum("rejected").alias("rejected"), F.sum("labelled").alias("labelled"),
        F.min("above").alias("above"))
    rate = (F.col("rejected") + 1.0) / (F.col("labelled") + 2.0)
    siblings = Window.partitionBy(*node, F.col("labelled") > 0).orderBy(rate, "label")
    last_r, last_n = F.lag("rejected").over(siblings), F.lag("labelled").over(siblings)
    pooled = (last_r + F.col("rejected")) / (last_n + F.col("labelled"))
    gap = F.abs(F.col("rejected") / F.col("labelled") - last_r / last_n)
    error = F.sqrt(pooled * (1.0 - pooled) * (1.0 / last_n + 1.0 / F.col("labelled")))
    begins = (
        last_n.isNull() | (F.col("labelled") == 0) | F.col("label").isNull()
        | F.lag(F.col("label").isNull()).over(siblings) | (gap > z * error))
    merged = branches.withColumn("begins", begins.cast("int")).withColumn(
        "branch", F.sum("begins").over(siblings))
    together = Window.partitionBy(*node, F.col("labelled") > 0, "branch")
    merged = merged.select(
        *node, "label", "above",
        F.concat_ws("|", F.array_sort(F.collect_set("label").over(together))).alias("name"),
        F.sum("rejected").over(together).alias("rejected"),
        F.sum("labelled").over(together).alias("labelled"),
    ).withColumn("branch_purity", _smoothed(strength, F.col("above")))
    moves = named.alias("n").join(
        merged.alias("m"),
        (F.col("n.host") == F.col("m.host")) & (F.col("n.template") == F.col("m.template"))
        & F.col("n.label").eqNullSafe(F.col("m.label")),
    ).select("n.host", "n.template", "n.segment", "n.ways", "name", "branch_purity",
             F.col("m.labelled").alias("branch_evidence"))
    # A node whose paths all end there has one way, which is the node itself.
    whole = F.col("v.ways") == 1
    return stepped.alias("t").join(
        moves.alias("v"),
        (F.col("t.host") == F.col("v.host")) & (F.col("t.template") == F.col("v.template"))
        & F.col("t.segment").eqNullSafe(F.col("v.segment")),
    ).select(
        "t.host", "t.segments",
        F.slice("t.rest", F.lit(2), F.size("t.rest")).alias("rest"),
        "t.pages", "t.rejected", "t.labelled",
        F.when(F.col("t.segment").isNull(), F.col("t.template"))
        .otherwise(F.concat("t.template", F.lit("/"), "v.name")).alias("template"),
        F.when(whole, F.col("t.evidence")).otherwise(F.col("v.branch_evidence")).alias("evidence"),
        F.when(whole, F.col("t.purity")).otherwise(F.col("v.branch_purity")).alias("purity"),
        F.col("t.segment").isNull().alias("done"))


def template_tree(
    paths: DataFrame, most_children: int = 32, literal_share: float = 0.05,
    z: float = 2.58, strength: float = 10.0, prior: float = 0.1,
) -> DataFrame:
    """(host, segments) -> template, evidence (labelled pages of the template) and purity.

    ``paths`` has host, segments (array), pages, rejected and labelled per distinct pair.
    """
    paths = written(paths, "paths")
    live = paths.join(host_purity(paths, strength, prior), "host").select(
        "host", "segments", F.col("segments").alias("rest"), "pages", "rejected", "labelled",
        F.lit("").alias("template"), "evidence", "purity")
    columns = ["host", "segments", "template", "evidence", "purity"]
    ended = live.where("false").select(*columns)
    # A round is written once: its plan stays one round deep, and a lost executor repeats one round.
    while not live.isEmpty():
        moved = written(_one_round(live, most_children, literal_share, z, strength), "paths")
        ended = ended.unionByName(moved.where("done").select(*columns))
        live = moved.where("not done").drop("done")
    return ended


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
    reject_at: float = 0.5, inherit_at: float = 0.8, labels: DataFrame | None = None, **tree: float,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, evidence and purity of every page.

    A rule decides where one fits. Elsewhere the template does. Labels are the verdicts of the
    rules and, if given, ``labels`` (page_id without repeats, rejected boolean). Null ids and urls
    are judged like others, repeated ids give a row each; an empty table gives no rows.
    """
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("action", action).withColumn(
        "segments", generalised(F.col("path")))
    bad = F.col("action") == "block"
    if labels is not None:
        parsed = parsed.join(labels.select("page_id", F.col("rejected").alias("_label")),
                             "page_id", "left")
        bad = F.coalesce(F.col("_label"), bad)
    paths = parsed.groupBy("host", "segments").agg(
        F.count("*").alias("pages"),
        F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("rejected"),
        F.count(bad).alias("labelled"))
    judged = template_tree(paths, **tree)
    # One row per distinct generalised path meets the pages; a hot path can be split at run time.
    return parsed.join(judged, ["host", "segments"]).select(
        "page_id", "host", "path", "rule",
        F.coalesce("action", F.when(
            F.col("purity") >= F.when(F.col("evidence") > 0, reject_at).otherwise(inherit_at),
            F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template", "evidence", "purity")
