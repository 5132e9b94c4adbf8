"""URL filters (operator 6): rules, and a path-template tree for what no rule fits.

Tree. Path segments are typed first (digits, long hex, uuids become marks). Then, level
by level under each host, a node's segments are compared: a segment stays a branch of its
own if it has ``SUPPORT`` pages and its blocked share differs from that of its siblings at
``Z`` deviations (two-proportion test); all others are statistically alike and merge into the
wildcard branch ``*``. Paths are counted to their end; below a node of less than ``SUPPORT``
pages all branches are ``*``, so it is closed at once.

Labels are the verdicts of the rules. Most hosts have few of them, so the same typed path
(and each of its beginnings) is also counted over all hosts, smoothed by ``WEIGHT`` pages at the
share of all labelled pages; a branch or template borrows that share as ``WEIGHT`` pages of its
own. Borrowed shares decide for a host without labels, a host's own labels outweigh them.

A template's purity is its blocked share among its labelled pages, smoothed by the ``WEIGHT``
borrowed ones. Templates of at least ``REJECT`` are blocked, and so are the pages of their
host and template that no rule fits.

Everything is counted on (host, typed path) rows, pre-aggregated, so a host with a third of
all pages is a few rows by then; the join back to the pages is left to the adaptive skew join.

Defined results. Null url or one without ``://``: host and path empty, no rule, judged by
the template of the empty host. Equal rules cannot tie: the longer one wins, then the
lesser string. Repeated rows: one row each. Further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.plans.scratch import stored

SUPPORT, Z, WEIGHT, REJECT = 5, 3.0, 10.0, 0.8

# The rules of the query, (rule, verdict).
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: (len(x[0]), [-ord(c) for c in x[0]])):
        name, slash, tail = r.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def typed(path: Column) -> Column:
    """The path's segments, the variable ones as marks."""
    def mark(s: Column) -> Column:
        uuid = s.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
        long_hex = s.rlike(r"^[0-9a-fA-F]{8,}$") & s.rlike(r"[0-9]")
        return F.when(uuid, "{uuid}").when(long_hex & ~s.rlike("^[0-9]+$"), "{hex}").otherwise(F.regexp_replace(s, r"[0-9]+", "{n}"))

    return F.transform(F.split(path, "/"), mark)


def borrowed(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, share): the blocked share of the typed paths of equal ``keys`` over all hosts, smoothed."""
    all_share = counts.agg(F.coalesce(F.try_divide(F.sum("blocked"), F.sum("labelled")), F.lit(0.0)).alias("all_share"))
    summed = counts.groupBy(*keys).agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    smoothed = (F.col("blocked") + WEIGHT * F.col("all_share")) / (F.col("labelled") + WEIGHT)
    return summed.join(F.broadcast(all_share)).select(*keys, smoothed.alias("share"))


def tree(counts: DataFrame) -> DataFrame:
    """(host, typed, n, labelled, blocked, template, prior) for rows (host, typed, n, labelled,
    blocked) of different typed paths; prior is the whole path's share over all hosts."""
    now, d = counts.withColumn("template", F.lit("")).withColumn("open", F.lit(True)), 0
    while d < (now.where("open").agg(F.max(F.size("typed"))).first()[0] or 0):
        begin = F.slice("typed", 1, d + 1)
        now = now.withColumn("seg", F.when(F.col("open"), F.try_element_at("typed", F.lit(d + 1))))
        shares = borrowed(counts.where(F.size("typed") > d).withColumn("prefix", begin), ["prefix"])
        kids = now.where("seg is not null").withColumn("prefix", begin).groupBy("host", "template", "seg", "prefix").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")))
        # Prefixes that reach one node by different wildcards are one branch, borrowing their mean share.
        kids = kids.join(shares, "prefix").groupBy("host", "template", "seg").agg(
            *(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")), (F.sum(F.col("n") * F.col("share")) / F.sum("n")).alias("share"))
        kids = kids.withColumn("seen", F.col("labelled") + WEIGHT).withColumn("bad", F.col("blocked") + WEIGHT * F.col("share"))
        node = kids.groupBy("host", "template").agg(F.sum("n").alias("pages"), F.sum("seen").alias("all_seen"), F.sum("bad").alias("all_bad"))
        kids = kids.join(node, ["host", "template"])
        others, rest = F.col("all_seen") - F.col("seen"), F.col("all_bad") - F.col("bad")
        pool = F.try_divide(F.col("all_bad"), F.col("all_seen"))
        spread = F.sqrt(F.greatest(pool * (1 - pool), F.lit(0.0)) * (F.try_divide(F.lit(1.0), F.col("seen")) + F.try_divide(F.lit(1.0), others)))
        z = F.try_divide(F.abs(F.col("bad") / F.col("seen") - F.try_divide(rest, others)), spread)
        alone = others < WEIGHT / 2  # an only child has no siblings to merge with
        own = (F.col("n") >= SUPPORT) & (alone | F.coalesce(z >= Z, F.lit(False)))
        kids = kids.select("host", "template", "seg", F.when(own, F.col("seg")).otherwise("*").alias("branch"), (F.col("pages") < SUPPORT).alias("few"))
        joined = now.join(kids, ["host", "template", "seg"], "left")
        rest = F.when(F.col("few"), F.expr(f"repeat('/*', size(typed) - {d + 1})")).otherwise("")
        longer = F.concat("template", F.lit("/" if d else ""), "branch", rest)
        now = joined.withColumn("template", F.when(F.col("branch").isNotNull(), longer).otherwise(F.col("template"))).withColumn("open", F.coalesce(~F.col("few"), F.lit(False))).drop("seg", "branch", "few")
        now, d = stored(now, "tree"), d + 1
    return now.drop("open").join(borrowed(counts, ["typed"]).withColumnRenamed("share", "prior"), "typed")


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each row of ``pages``."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), typed(F.col("path")).alias("typed"))
    counts = rows.groupBy("host", "typed").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    counts = stored(counts, "paths")
    leaves = stored(tree(counts), "leaves")
    here = leaves.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), (F.sum(F.col("n") * F.col("prior")) / F.sum("n")).alias("prior"))
    purity = (F.col("blocked") + WEIGHT * F.col("prior")) / (F.col("labelled") + WEIGHT)
    known = leaves.select("host", "typed", "template").join(here.select("host", "template", purity.alias("purity")), ["host", "template"])
    out = rows.join(known, ["host", "typed"], "left")
    found = F.coalesce("ruled", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", found.alias("verdict"), "template", "purity")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
