"""URL filtering by explicit rules and, where none fits, by a path-template tree per host. DataFrame operations only.

Path segments that look variable (numbers, dates, long hex or mixed identifiers) become typed wildcards, and urls are
merged into templates with counts before anything else. Each host's templates form a tree, which is walked from the root:
under a node, branches that are rare, or whose labelled share of blocked urls does not differ from the node's by a
two-proportion test, merge into ``*``; the others stay. What is below a node of fewer than ``SUPPORT`` urls is one branch,
``**``, however deep; so the walk has as many steps as the deepest path that many urls share, and a step deals with the
templates that still go on. A template is rejected if the smoothed share of blocked among its labelled urls,
(blocked + 1) / (labelled + 2), reaches ``REJECT``. The labels are the verdicts of the rules.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged like any other
template. page_id is carried as it is, null and repeated ones too. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import ascii_lower, durable, join_facts

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A branch with fewer urls, or less than this share of its node's urls, is rare.
SUPPORT, SHARE = 5, 0.02
#: Two proportions differ beyond this z value.
Z = 1.96
REJECT = 0.7


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    tail = F.when(rest.isNotNull(), url.substr(F.length(rest) + 4, F.length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(tail, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def template(path: Column) -> Column:
    """Path segments with the variable ones as typed wildcards."""

    def typed(s: Column) -> Column:
        stem, ext = F.regexp_extract(s, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(s, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 2)
        kind = (
            F.when(stem.rlike(r"^[0-9]+$"), F.lit("{n}"))
            .when(stem.rlike(r"^[0-9]{4}[-_.][0-9]{1,2}([-_.][0-9]{1,2})?$"), F.lit("{date}"))
            .when(stem.rlike(r"^[0-9a-fA-F-]{8,}$") & stem.rlike("[0-9]"), F.lit("{hex}"))
            .when((F.length(stem) >= 12) & stem.rlike("[0-9]") & stem.rlike("[A-Za-z]"), F.lit("{id}"))
        )
        return F.coalesce(F.concat(kind, ext), s)

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), typed)


def template_tree(urls: DataFrame) -> DataFrame:
    """(host, tpl, n, merged, purity) of urls (host, tpl, verdict): the template each one merges into and its purity."""
    label = lambda v: F.sum((F.col("verdict") == v).cast("long"))
    now = urls.groupBy("host", "tpl").agg(F.count("*").alias("n"), F.coalesce(label("block"), F.lit(0)).alias("bad"), F.coalesce(label("allow"), F.lit(0)).alias("good"))
    now = durable(now.withColumn("merged", F.array().cast("array<string>")))
    every_row = left = now.count()
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("w")]
    done, level = [], 0
    while left:
        level += 1
        here = now.withColumn("seg", F.when(F.size("tpl") >= level, F.element_at("tpl", F.lit(level))).otherwise(F.lit("")))
        branch = durable(here.groupBy("host", "merged", "seg").agg(*sums))
        node = durable(branch.groupBy("host", "merged").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "bad", "good")], F.count("*").alias("branches")))
        n_branches = node.agg(F.sum("branches")).first()[0]
        both = join_facts(branch, node, ["host", "merged"], "branches", n_branches, F.xxhash64("seg"))
        seen, every = F.col("bad") + F.col("good"), F.col("all_bad") + F.col("all_good")
        pooled = (F.col("all_bad") + 1) / (every + 2)
        z = F.abs((F.col("bad") + 1) / (seen + 2) - pooled) / F.sqrt(pooled * (1 - pooled) * (1 / (seen + 2) + 1 / (every + 2)))
        rare = (F.col("n") < SUPPORT) | (F.col("n") < F.col("all_n") * SHARE)
        merges = (F.col("n") < F.col("all_n")) & (rare | ((seen > 0) & (z < Z)))
        named = F.when(F.col("seg") == "", F.lit("")).when(F.col("all_n") < SUPPORT, F.lit("**")).when(merges, F.lit("*")).otherwise(F.col("seg"))
        names = durable(both.select("host", "merged", "seg", named.alias("named"), (F.col("all_n") < SUPPORT).alias("small"), "w"))
        step = join_facts(here, names, ["host", "merged", "seg"], "w", left, F.xxhash64("tpl"))
        ends = (F.col("named") == "") | F.col("small")
        step = durable(step.select("host", "tpl", "n", "bad", "good", F.when(F.col("named") == "", F.col("merged")).otherwise(F.concat("merged", F.array("named"))).alias("merged"), ends.alias("ends")))
        done.append(step.where("ends").drop("ends"))
        now = step.where("not ends").drop("ends")
        left = now.count()
    settled = durable(reduce(DataFrame.unionAll, done, now))
    whole = durable(settled.groupBy("host", "merged").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("w")))
    purity = whole.select("host", "merged", ((F.col("bad") + 1) / (F.col("bad") + F.col("good") + 2)).alias("purity"), "w")
    return join_facts(settled.select("host", "tpl", "n", "merged"), purity, ["host", "merged"], "w", every_row, F.xxhash64("tpl"))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity), a row for each row of ``pages`` (page_id, url)."""
    host, path = host_and_path(F.coalesce(F.col("url").cast("string"), F.lit("")))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("fit", fit).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"), template(F.col("path")).alias("tpl"))
    tree = durable(template_tree(urls.select("host", "tpl", "verdict")))
    total = tree.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = join_facts(urls, tree, ["host", "tpl"], "n", total, F.xxhash64("page_id", "path"))
    own = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), F.round("purity", 6).alias("purity"))
