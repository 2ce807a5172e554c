"""URL filter: domain rules, and for all other URLs a path-template tree per host.

Rules are ``domain/path`` strings. One fits its domain and all subdomains if the URL's path begins with
the rule's; of those that fit, the longest decides. URLs under a rule are the labelled ones that
the tree learns from.

Per host, paths become templates: a segment with a digit, or of over 40 characters, is the wildcard
``*``, and so are the children of a node that has more than ``max_children`` of them. Templates
that differ in their last literal segment only are branches of one node. Branches with ``least``
labelled URLs or more are compared with all labelled URLs of the node: those whose share of blocked
ones doesn't differ significantly (two-proportion z below ``max_z``) are merged. A template, merged
or not, is rejected if its purity, (blocked + strength / 2) / (labelled + strength), reaches
``reject``; one without labelled URLs has purity 1/2 and is allowed.

Pages are counted into (host, syntactic template) first, so hosts and templates of very many URLs are
summed by many tasks; the tree is built from those counts.

A null URL, or one without ``://``, has an empty host and path, fits no rule and counts as a host
of its own. Repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentariff.llm.text import ascii_lower

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"),
         ("allow", "org/fr/"))
MAX_RULES = 200
MAX_CHILDREN, MAX_SEGMENT = 20, 40
LEAST, MAX_Z = 5, 1.96
STRENGTH, REJECT = 5.0, 0.8


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, or null. Rules are a short literal list."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules: an expression isn't the place for them")
    chosen = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(
            path, F.lit(slash + rest))
        chosen = F.when(fits, F.struct(F.lit(verdict).alias("verdict"),
                                       F.lit(rule).alias("rule"))).otherwise(chosen)
    return chosen


def syntactic_template(path: Column) -> Column:
    return F.array_join(F.transform(F.split(path, "/", -1), lambda s: F.when(
        s.rlike("[0-9]") | (F.length(s) > MAX_SEGMENT), F.lit("*")).otherwise(s)), "/")


def template_counts(parsed: DataFrame) -> DataFrame:
    """(host, template, labelled, blocked) of every syntactic template of a host."""
    verdict = F.col("_rule.verdict")
    return parsed.groupBy("host", "template").agg(
        F.count(verdict).alias("labelled"),
        F.count_if(F.coalesce(verdict == "block", F.lit(False))).alias("blocked"))


def generalised(counts: DataFrame, max_children: int = MAX_CHILDREN) -> DataFrame:
    """Add ``general``: the template with a wildcard under every node of too many children."""
    segments = counts.select("host", "template", F.posexplode(F.split("template", "/", -1)).alias(
        "place", "segment"), F.split("template", "/", -1).alias("all"))
    nodes = segments.select("host", "template", "place", "segment", F.array_join(
        F.slice("all", F.lit(1), F.col("place")), "/").alias("parent"))
    wide = nodes.groupBy("host", "parent", "place").agg(
        F.count_distinct("segment").alias("children")).where(
        F.col("children") > max_children).select("host", "parent", "place", F.lit("*").alias("wide"))
    # A place is part of the key: the empty path before the first segment is no parent of ''.
    general = (nodes.join(wide, ["host", "parent", "place"], "left")
               .groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct(
                   "place", F.coalesce("wide", "segment").alias("s")))).alias("parts"))
               .select("host", "template", F.array_join(
                   F.transform("parts", lambda p: p["s"]), "/").alias("general")))
    return counts.join(general, ["host", "template"])


def branch_of(general: Column) -> Column:
    """The template with its last literal segment made a wildcard: the node it is a branch of."""
    return F.regexp_replace(general, "[^/*]+((/\\*|/)*)$", "*$1")


def judged_templates(counts: DataFrame, max_children: int = MAX_CHILDREN, least: int = LEAST,
                     max_z: float = MAX_Z, strength: float = STRENGTH,
                     reject: float = REJECT) -> DataFrame:
    """(host, template, general, purity, learned): learned is block or allow."""
    placed = generalised(counts, max_children)
    branches = placed.groupBy("host", "general").agg(
        F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    node = Window.partitionBy("host", "node")
    share = F.col("blocked") / F.col("labelled")
    pooled = F.col("all_blocked") / F.col("all_labelled")
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / F.col("all_labelled")))
    enough = F.col("labelled") >= least
    similar = F.when(enough, F.abs(share - pooled) <= max_z * error).otherwise(F.lit(False))
    compared = (branches.withColumn("node", branch_of(F.col("general")))
                .withColumn("all_labelled", F.sum(F.when(enough, F.col("labelled"))).over(node))
                .withColumn("all_blocked", F.sum(F.when(enough, F.col("blocked"))).over(node))
                .withColumn("merged", similar))
    merged = Window.partitionBy("host", "node", "merged")
    number = {c: F.when(F.col("merged"), F.sum(c).over(merged)).otherwise(F.col(c))
              for c in ("labelled", "blocked")}
    purity = (number["blocked"] + strength / 2) / (number["labelled"] + strength)
    judged = compared.withColumn("purity", purity).select(
        "host", "general", F.when(F.col("merged"), F.col("node")).otherwise(F.col("general"))
        .alias("shown"), "purity",
        F.when(F.col("purity") >= reject, "block").otherwise("allow").alias("learned"))
    return placed.select("host", "template", "general").join(judged, ["host", "general"]).select(
        "host", "template", F.col("shown").alias("general"), "purity", "learned")


def filter_urls(pages: DataFrame, rules=RULES, keep: tuple[str, ...] = ("page_id",),
                **options) -> DataFrame:
    """``keep`` columns with host, path, template, purity, rule and verdict of every row."""
    keep = tuple(c for c in keep if c not in ("host", "path"))
    parsed = (pages.select(*[F.col(f"`{c}`") for c in keep], url_host(F.col("url")).alias("host"),
                           url_path(F.col("url")).alias("path"))
              .withColumn("template", syntactic_template(F.col("path")))
              .withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)))
    judged = judged_templates(template_counts(parsed), **options)
    return parsed.join(judged, ["host", "template"], "left").select(
        *[F.col(f"`{c}`") for c in keep], "host", "path", F.col("general").alias("template"), "purity",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", "learned").alias("verdict"))
