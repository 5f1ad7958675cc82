"""URL filters: rules by host and path, and a tree of path templates with labelled purity. Built-in functions only."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.session import cut_lineage

# Segments that name a single page by their form alone: numbers, long hexadecimal names, very long names; an ending such as .html goes along.
VARIABLE = r"(?<=/)(?:[0-9]+|[0-9a-fA-F-]{8,}|[^/]{40,}?)(?:\.[A-Za-z0-9]{1,5})?(?=/|$)"
# Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null or without ``://``."""
    text = F.coalesce(url, F.lit(""))
    found = lambda i: F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return F.translate(found(1), ascii_uppercase, ascii_lowercase), found(2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path``, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def shape_of(path: Column) -> Column:
    """The path with variable segments as ``*`` and without a last slash."""
    return F.regexp_replace(F.regexp_replace(path, VARIABLE, "*"), "/+$", "")


def path_templates(urls: DataFrame, depth: int = 4, min_pages: int = 5, z: float = 2.6, prior: float = 20.0, least_purity: float = 0.5) -> DataFrame:
    """Templates and verdicts of all shapes.

    ``urls`` has host, shape, bad (1, 0, or null for no label) and n, the pages of the row. Top down, for each host: a segment stays
    literal if at least ``min_pages`` pages use it and its share of bad labels differs from that of its siblings by ``z``
    standard errors or more, however many siblings there are; all others are merged into one ``*`` branch. Segments beyond ``depth`` count as one ``**``. The purity of a template is its share of good labels, drawn by
    ``prior`` labels' weight towards that of its host, which is drawn alike towards that of all pages; a template below
    ``least_purity`` is blocked. Returns host, shape, template, n_labels, purity, verdict; each host and shape once.
    Without any label all is allowed. Counts are summed before anything is joined, so a host with a third of all pages is
    a few rows per segment.
    """
    shapes = cut_lineage(
        urls.groupBy("host", "shape").agg(
            F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("bad").isNotNull(), F.col("n"))), F.lit(0)).alias("lab"),
            F.coalesce(F.sum(F.col("bad") * F.col("n")), F.lit(0)).alias("bad"),
        ).withColumn("template", F.lit(""))
    )
    sums = [F.sum(c).alias(c) for c in ("n", "lab", "bad")]
    parts = F.split("shape", "/")
    for d in range(1, depth + 1):
        shapes = shapes.withColumn("more", F.size(parts) > d).withColumn("child", F.coalesce(F.get(parts, F.lit(d)), F.lit("")))
        nodes = shapes.filter("more").groupBy("host", "template", "child").agg(*sums)
        siblings = nodes.groupBy("host", "template").agg(F.sum("lab").alias("all_lab"), F.sum("bad").alias("all_bad"))
        rest = F.col("all_lab") - F.col("lab")
        share = F.col("all_bad") / F.col("all_lab")
        error = F.sqrt(share * (1 - share) * (1 / F.col("lab") + 1 / rest))
        gap = F.abs(F.col("bad") / F.col("lab") - (F.col("all_bad") - F.col("bad")) / rest)
        stays = (F.col("child") != "*") & (F.col("n") >= min_pages) & (F.col("lab") > 0) & (rest > 0) & (error > 0)
        literal = nodes.join(siblings, ["host", "template"]).filter(stays).filter(gap >= z * error).select("host", "template", "child", F.lit(True).alias("stays"))
        step = F.when(F.col("stays"), F.col("child")).otherwise("*")
        shapes = cut_lineage(
            shapes.join(literal, ["host", "template", "child"], "left")
            .select("host", "shape", "n", "lab", "bad", F.when(F.col("more"), F.concat("template", F.lit("/"), step)).otherwise(F.col("template")).alias("template"))
        )
    shapes = shapes.withColumn("template", F.when(F.size(parts) > depth + 1, F.concat("template", F.lit("/**"))).otherwise(F.col("template")))
    total = shapes.agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad")).first()
    overall = (total.bad or 0) / total.lab if total.lab else 0.0
    templates = shapes.groupBy("host", "template").agg(*sums)
    hosts = templates.groupBy("host").agg(((F.sum("bad") + prior * overall) / (F.sum("lab") + prior)).alias("host_share"))
    purity = 1 - (F.col("bad") + prior * F.col("host_share")) / (F.col("lab") + prior)
    judged = templates.join(hosts, "host").select("host", "template", F.col("lab").alias("n_labels"), purity.alias("purity"))
    judged = judged.withColumn("verdict", F.when(F.col("purity") < least_purity, "block").otherwise("allow"))
    return shapes.select("host", "shape", "template").join(judged, ["host", "template"])


def url_verdicts(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", label_key: str = "doc_id", bad: Column | None = None, rules=RULES, **settings) -> DataFrame:
    """Host, path, rule and verdict of every page; see ``path_templates`` for pages that no rule fits.

    A page's label is that of the document whose number is the last number of its path; ``labels`` has it in ``label_key``, and
    ``bad`` says which labels speak against a page (quality 0 or toxic 1 if not given; null is no label, several labels of one
    number: bad if one is). Null urls have empty host and path and are judged alike. Repeated pages count and stay;
    other columns are ignored; empty tables give no rows.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select("key", host.alias("host"), path.alias("path"))
    rows = rows.select("key", "host", "path", shape_of(F.col("path")).alias("shape"))
    wrong = bad if bad is not None else (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.select(F.col(label_key).cast("long").alias("number"), wrong.cast("int").alias("bad")).dropna().groupBy("number").agg(F.max("bad").alias("bad"))
    number = F.regexp_extract("path", r"([0-9]{1,18})[^0-9/]*/*$", 1).try_cast("long")
    # Pages are summed by number first: a page that is repeated very often meets its label as one row.
    counted = rows.groupBy("host", "shape", number.alias("number")).agg(F.count("*").alias("n"))
    labelled = counted.join(known, "number", "left").select("host", "shape", "bad", "n")
    judged = path_templates(labelled, **settings)
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return rows.join(judged, ["host", "shape"], "left").select(
        F.col("key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, "verdict", F.lit("allow")).alias("verdict"), "template", "n_labels", "purity"
    )

