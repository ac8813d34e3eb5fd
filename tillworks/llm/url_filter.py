"""URL filter: rules first, then a path-template tree per host.

Addresses without a fitting rule are judged by templates, learned from those with one:

1. Variable parts of a path segment (digits, long hexadecimal strings) become a wildcard.
2. Level by level, a segment becomes a wildcard where its node has at least ``FAN`` different
   children and the segment holds less than ``RARE`` of the node's pages.
3. Sibling templates whose share of blocked pages does not differ significantly from that of
   all labelled siblings together are merged and counted together.
4. A template is rejected if its smoothed share of blocked pages reaches ``REJECT``:
   ``(blocked + WEIGHT * prior) / (labelled + WEIGHT)``. The prior is the same template's share
   over all hosts, whose prior is the share over all pages.

Counts are made per host and template, not per page, and all pages are counted. A null address,
or one without ``://``, has empty host and path and is judged like any other. Repeated rows
get equal verdicts. An empty table gives an empty table; other columns are ignored.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.session import cut_lineage

# (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))
LEVELS = 6
FAN = 20
RARE = 0.05
SIGNIFICANT = 3.84  # chi-square, one degree of freedom, five percent
WEIGHT = 2.0
REJECT = 0.5
WILD = "*"


def parse(pages: DataFrame, id_col="page_id", url_col="url") -> DataFrame:
    """page_id, host (A-Z lower-cased) and path of every row."""
    rest = F.expr(f"if(instr(`{url_col}`, '://') > 0, substring(`{url_col}`, "
                  f"instr(`{url_col}`, '://') + 3), '')")
    host = F.regexp_extract(F.coalesce("rest", F.lit("")), r"^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.select(F.col(id_col).alias("page_id"), rest.alias("rest")).select(
        "page_id", F.translate(host, upper, lower).alias("host"),
        F.regexp_extract(F.coalesce("rest", F.lit("")), r"^[^/?#]*([^?#]*)", 1).alias("path"))


def with_rules(parsed: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule (null where none fits) and rule_verdict; the longest fitting rule wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col(
            "path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return parsed.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def shape(path):
    """The path with its variable parts as wildcards; levels beyond the last are one."""
    return F.regexp_replace(F.regexp_replace(path, r"\b[0-9a-f]{16,}\b|[0-9a-f]{8}(-[0-9a-f]{4}){3}"
                                             r"-[0-9a-f]{12}", WILD), r"[0-9]+", WILD)


def templates(labelled: DataFrame) -> DataFrame:
    """host, shape, template, n, blocked, known: one row per host and shape.

    ``labelled`` has host, shape and rule_verdict.
    """
    rows = labelled.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count_if(F.col("rule_verdict") == "block").alias("blocked"),
        F.count("rule_verdict").alias("known")).withColumn(
        "parts", F.split("shape", "/", LEVELS + 1)).withColumn("template", F.lit(""))
    rows = cut_lineage(rows)
    deepest = rows.agg(F.max(F.size("parts"))).first()[0] or 0
    for level in range(1, min(LEVELS + 1, deepest)):
        rows = rows.withColumn("part", F.get("parts", F.lit(level)))
        children = rows.where("part is not null").groupBy("host", "template", "part").agg(
            F.sum("n").alias("n"))
        # written, so that the join may split a node of many children
        nodes = cut_lineage(children.groupBy("host", "template").agg(
            F.sum("n").alias("total"), F.count("*").alias("fan")).where(F.col("fan") >= FAN))
        rare = cut_lineage(children.join(nodes, ["host", "template"])
                           .where(F.col("n") < RARE * F.col("total"))
                           .select("host", "template", "part", F.lit(True).alias("rare")))
        rows = cut_lineage(rows.join(rare, ["host", "template", "part"], "left").withColumn(
            "template", F.when(F.col("part").isNull(), F.col("template")).otherwise(F.concat(
                "template", F.lit("/"), F.when(F.col("rare"), WILD).otherwise(F.col("part"))))
        ).drop("rare", "part"))
    return rows.drop("parts")


def judge(found: DataFrame) -> DataFrame:
    """host, shape, template, score, verdict: smoothed purity of every template."""
    own = found.groupBy("host", "template").agg(
        F.sum("blocked").alias("blocked"), F.sum("known").alias("known")).withColumn(
        "parent", F.regexp_replace("template", "/[^/]*$", ""))
    # what many rows meet is written, so that the joins may split a host of many templates
    siblings = cut_lineage(own.groupBy("host", "parent").agg(
        F.sum("blocked").alias("all_blocked"), F.sum("known").alias("all_known")))
    share = F.try_divide("all_blocked", "all_known")
    differs = F.try_divide("blocked", "known") - share
    # a variance of zero leaves no difference either
    alike = (F.col("known") > 0) & (
        differs * differs * F.col("known") <= SIGNIFICANT * share * (1 - share) + 1e-12)
    branches = own.join(siblings, ["host", "parent"]).withColumn(
        "branch", F.when(alike, F.lit(None)).otherwise(F.col("template")))
    branches = cut_lineage(branches)
    merged = cut_lineage(branches.groupBy("host", "parent", "branch").agg(
        F.sum("blocked").alias("m_blocked"), F.sum("known").alias("m_known")).withColumnsRenamed(
        {"host": "m_host", "parent": "m_parent", "branch": "m_branch"}))
    everywhere = cut_lineage(found.groupBy(F.col("template").alias("e_template")).agg(
        F.sum("blocked").alias("e_blocked"), F.sum("known").alias("e_known")))
    overall = found.agg(((F.coalesce(F.sum("blocked"), F.lit(0)) + 1)
                         / (F.coalesce(F.sum("known"), F.lit(0)) + 2)).alias("p")).first()["p"]
    prior = (F.col("e_blocked") + WEIGHT * F.lit(overall)) / (F.col("e_known") + WEIGHT)
    score = (F.col("m_blocked") + WEIGHT * prior) / (F.col("m_known") + WEIGHT)
    scored = branches.join(
        merged, (F.col("host") == F.col("m_host")) & (F.col("parent") == F.col("m_parent"))
        & F.col("branch").eqNullSafe(F.col("m_branch"))).join(
        everywhere, F.col("template") == F.col("e_template")).select(
        "host", "template", score.alias("score"))
    return found.select("host", "shape", "template").join(scored, ["host", "template"]).withColumn(
        "verdict", F.when(F.col("score") >= REJECT, "block").otherwise("allow"))


def filter_urls(pages: DataFrame, rules=RULES, id_col="page_id", url_col="url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, score."""
    ruled = with_rules(parse(pages, id_col, url_col), rules).withColumn("shape", shape(
        F.col("path")))
    judged = cut_lineage(judge(templates(ruled)).withColumnsRenamed(
        {"host": "j_host", "shape": "j_shape", "verdict": "judged"}))
    return ruled.join(judged, (F.col("host") == F.col("j_host")) & (
        F.col("shape") == F.col("j_shape"))).select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", "judged").alias("verdict"), "template", "score")
