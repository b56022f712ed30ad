"""URL filtering: given rules first, then a path-template tree for each host.

A host's paths form a tree. Segments that vary (numbers, hexadecimal ids, rare values beside many siblings) become
wildcards. Labelled siblings are put in the order of their shares of bad labels, and neighbours whose shares do not differ by a two-proportion
z test are merged into one branch, named by its first segments. Siblings that are no wildcards are few, as each has its share of the parent's pages. Each template left has labelled pages or none; its smoothed purity is
(bad + strength * prior) / (labelled + strength), prior being the bad share of all labelled pages, and a
template with labels is rejected if that exceeds the threshold. The labels are the verdicts of the rules.

Everything is DataFrame expressions. Pages are first reduced to distinct shapes with counts (aggregated before
the shuffle), so a host with a third of all pages costs one row per shape and task.

Nulls and edge cases: a url that is null or has no ``://`` has empty host and path and is allowed unless a rule
fits; repeated pages are judged alike; branches with equal shares go by name; of a path of more than ``depth`` segments the rest is one more segment, ``**``;
long paths are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import io

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def shape_of(path: Column, depth: int) -> Column:
    """The path's first ``depth`` segments with numbers and ids generalised; what lies deeper is one more segment."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    parts = F.transform(
        parts,
        lambda s: F.when(s.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$"), F.lit("{id}")).otherwise(F.regexp_replace(s, r"\d+", "{n}")),
    )
    deep = F.when(F.size(parts) > depth, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.slice(parts, 1, depth), deep)


def _differs(bad: Column, n: Column, bad2: Column, n2: Column, z: float) -> Column:
    """Whether two shares of bad labels differ; squared, to stay clear of roots of zero."""
    pooled = (bad + bad2) / (n + n2)
    return F.pow(bad / n - bad2 / n2, 2) > z * z * pooled * (1 - pooled) * (1 / n + 1 / n2)


def templates(shapes: DataFrame, depth: int, many: int = 50, rare: float = 0.005, z: float = 2.58) -> DataFrame:
    """Adds ``template`` to (host, shape, total, bad, labelled) rows, working down one level at a time.

    Beside more than ``many`` siblings, a segment with less than the share ``rare`` of its parent's pages varies.
    The tree is read three times a level, so each level is written to the shared folder: the plan stays as long as one level.
    """
    tree = shapes.withColumn("template", F.col("host"))
    for level in range(depth + 1):
        segment = F.get(F.col("shape"), F.lit(level))
        tree = tree.withColumn("segment", F.coalesce(segment, F.lit("")))
        child = tree.groupBy("template", "segment").agg(
            F.sum("total").alias("total"), F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")
        )
        parent = child.groupBy("template").agg(F.count(F.lit(1)).alias("children"), F.sum("total").alias("all"))
        variable = (F.col("children") > many) & (F.col("total") < F.col("all") * rare)
        child = child.join(parent, "template").withColumn("variable", (F.col("segment") != "") & variable)
        # at most 1 / rare siblings, or ``many``, are no wildcards
        fixed = child.where((F.col("segment") != "") & ~F.col("variable") & (F.col("labelled") > 0))
        row = Window.partitionBy("template").orderBy(F.col("bad") / F.col("labelled"), "segment")
        apart = _differs(F.col("bad"), F.col("labelled"), F.lag("bad").over(row), F.lag("labelled").over(row), z)
        fixed = fixed.withColumn("branch", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("branch", F.sum("branch").over(row))
        branches = fixed.groupBy("template", "branch").agg(F.min("segment").alias("first"), F.max("segment").alias("last"))
        name = F.when(F.col("first") == F.col("last"), F.col("first")).otherwise(F.concat(F.lit("<"), "first", F.lit("|"), "last", F.lit(">")))
        merged = fixed.join(branches.select("template", "branch", name.alias("name")), ["template", "branch"]).select("template", "segment", "name")
        label = F.when(F.col("segment") == "", F.lit("")).when(F.col("variable"), F.lit("/*")).otherwise(F.concat(F.lit("/"), F.coalesce("name", "segment")))
        names = child.join(merged, ["template", "segment"], "left").select("template", "segment", label.alias("label"))
        tree = tree.join(names, ["template", "segment"]).withColumn("template", F.concat("template", "label")).drop("label", "segment")
        tree = io.written(tree, "templates")
    return tree


def judge(pages: DataFrame, rules=RULES, depth: int = 6, strength: float = 4.0, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("shape", shape_of(F.col("path"), depth))
    bad = (F.col("fit.verdict") == "block").cast("long")
    shapes = parsed.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad"), F.count("fit").alias("labelled")
    )
    shapes = io.written(shapes, "shapes")
    tree = templates(shapes, depth)
    sums = tree.groupBy("template").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    overall = shapes.agg((F.sum("bad") / F.greatest(F.sum("labelled"), F.lit(1))).alias("prior"))  # one row
    purity = (F.col("bad") + strength * F.coalesce("prior", F.lit(0.0))) / (F.col("labelled") + strength)
    sums = sums.join(F.broadcast(overall)).select("template", purity.alias("purity"), ((F.col("labelled") > 0) & (purity > threshold)).alias("rejected"))
    known = tree.select("host", "shape", "template").join(sums, "template")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return parsed.join(known, ["host", "shape"], "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity")
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(io.table(spark, sf_dir, "pages").select("page_id", "url"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the given rules alone say of each page, which SQL can state."""
    out = op7_url_filters(spark, sf_dir)
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


_FITS = " ".join(
    f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{host}{path}|{verdict}'" for host, path, verdict in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
)
OP7_SQL = rf"""
WITH h AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT *, CASE {_FITS} END AS fit FROM h)
SELECT page_id, host, path, string_split(fit, '|')[1] AS rule, string_split(fit, '|')[2] AS rule_verdict FROM f
"""
