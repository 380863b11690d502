"""URL filter on a path-template tree (DataFrame functions only).

Per host the paths form a tree, built level by level from the root.  Variable
segments become wildcards: by their shape (numbers, hexadecimal ids, slugs with
digits; a file extension is kept), and ``*`` where a node has many different
words below it, few of which repeat.  Sibling branches with the same profile
(the shares of the next segment's shape and the label, in steps of 1 / STEPS)
are merged into one, named ``~`` and its smallest word; no branch is compared
with another.  Nodes are keyed by the generalised path above them, so merged
branches have their children in common.  The tree has ``LEVELS`` levels; the
rest of a longer path is one segment, generalised like any other.

A template is rejected if its smoothed labelled purity reaches ``PURITY``: the
share of block among its labelled urls, shrunk by SMOOTH pseudo-urls towards the
blocked share of all the host's urls, which is shrunk towards zero.  Urls
without a label say nothing for or against their template.

All statistics are counts over all urls, summed per host, node and template
with partial aggregation; hot keys are joined by broadcast, others by shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, written

# Fixed values: (host, path, verdict) rules; a rule fits its host and all subdomains.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
MANY = 20         # different words from which a node's segment may be variable
SPREAD = 0.5      # different words per url from which it is variable
STEPS = 4         # steps of the shares in a branch's profile
LEVELS = 8        # levels of the tree
SMOOTH = 10.0     # pseudo-urls of the smoothing
PURITY = 0.8      # smoothed labelled purity that rejects

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) by plain text rules; both empty for null or where ``://`` is missing."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tested first, as the outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def shape(segment: Column) -> Column:
    """Generalise a variable-looking segment; other segments stay as they are."""
    stem = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 1)
    ext = F.lower(F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 2))
    kind = (F.when(stem.rlike(r"^\d+$"), F.lit("{num}"))
            .when(stem.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$"), F.lit("{hex}"))
            .when(stem.rlike(r"\d"), F.lit("{mixed}")))
    return F.coalesce(F.concat(kind, ext), segment)


def segments(path: Column, levels: int = LEVELS) -> Column:
    """The generalised segments of a path, what follows the last level as one segment."""
    parts = F.split(F.regexp_replace(path, r"^/|/$", ""), "/")
    rest = F.concat_ws("/", F.slice(parts, levels, F.greatest(F.size(parts), F.lit(1))))
    parts = F.when(F.size(parts) > levels, F.concat(F.slice(parts, 1, levels - 1), F.array(rest))).otherwise(parts)
    return F.transform(parts, shape)


def _branches(rows: DataFrame, level: int) -> DataFrame:
    """(host, node, child, size, signature): one row per branch of the tree at this level.

    The signature is the branch's profile, the shares of its urls by shape of the
    next segment and label, in steps of 1 / STEPS.
    """
    below = F.get("segs", F.lit(level + 1))
    kind = F.when(below.isNull(), F.lit("end")).when(below.startswith("{"), F.regexp_extract(below, r"^(\{\w+\})", 1)).otherwise(F.lit("word"))
    labels = F.array(F.struct(F.lit("block").alias("label"), F.col("n_block").alias("n")), F.struct(F.lit("allow").alias("label"), F.col("n_allow").alias("n")),
                     F.struct(F.lit("none").alias("label"), (F.col("n") - F.col("n_block") - F.col("n_allow")).alias("n")))
    cells = rows.select("host", "node", F.get("segs", F.lit(level)).alias("child"), kind.alias("kind"), F.explode(labels).alias("c"))
    keys = ["host", "node", "child"]
    cells = cells.where("c.n > 0").groupBy(*keys, "kind", "c.label").agg(F.sum("c.n").alias("n"))
    branches = cells.groupBy(*keys).agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.struct("kind", "label", "n"))).alias("cells"))
    steps = F.filter(F.transform("cells", lambda c: F.struct(c["kind"], c["label"], F.floor(STEPS * c["n"] / F.col("size") + 0.5).alias("k"))),
                     lambda c: c["k"] > 0)
    return branches.select(*keys, "size", F.to_json(steps).alias("signature"))


def _generalised(rows: DataFrame, level: int) -> DataFrame:
    """``rows`` with the segment of this level, generalised, added to their node."""
    branches = written(_branches(rows, level), f"url-branches-{level}")
    word = ~F.col("child").startswith("{")
    # variable by count: many different words, few of which repeat
    nodes = branches.groupBy("host", "node").agg(F.count("*").alias("n_branches"), F.count(F.when(word, 1)).alias("words"),
                                                 F.sum(F.when(word, F.col("size")).otherwise(0)).alias("urls"))
    nodes = written(nodes.select("host", "node", "n_branches", ((F.col("words") >= MANY) & (F.col("words") >= SPREAD * F.col("urls"))).alias("variable")),
                    f"url-nodes-{level}")
    alike = written(branches.groupBy("host", "node", "signature").agg(F.count("*").alias("n_alike"), F.min("child").alias("first")), f"url-alike-{level}")
    found = join_counted(written(join_counted(branches, nodes, ["host", "node"], "n_branches"), f"url-variable-{level}"),
                         alike, ["host", "node", "signature"], "n_alike")
    general = F.when(F.col("variable") & word, F.lit("*")).when(F.col("n_alike") > 1, F.concat(F.lit("~"), "first")).otherwise(F.col("child"))
    leaves = rows.withColumn("child", F.get("segs", F.lit(level))).where("child IS NOT NULL")
    leaves = written(leaves, f"url-leaves-{level}")
    counts = leaves.groupBy("host", "node", "child").agg(F.count("*").alias("n_leaves"))
    keyed = written(found.select("host", "node", "child", general.alias("general")).join(counts, ["host", "node", "child"]), f"url-general-{level}")
    joined = join_counted(leaves, keyed, ["host", "node", "child"], "n_leaves")
    node = F.when(F.lit(level == 0), F.col("general")).otherwise(F.concat_ws("/", "node", "general"))
    return joined.select("host", "segs", "n", "n_block", "n_allow", node.alias("node"))


def template_tree(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(host, segs, n, n_block, n_allow, template): ``leaves`` with the template of their path.

    Level by level from the root: nodes are keyed by the generalised path above,
    so merged branches pool their children before these are judged.
    """
    rows = written(leaves.withColumn("node", F.lit("")), "url-level")
    done = rows.where(F.lit(False))
    for level in range(min(levels, rows.agg(F.max(F.size("segs"))).first()[0] or 0)):
        rows = written(_generalised(rows, level), f"url-level-{level}")
        done = done.unionByName(rows.where(F.size("segs") == level + 1))
        rows = rows.where(F.size("segs") > level + 1)
    return done.withColumnRenamed("node", "template")


def judge(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, purity: float = PURITY, label: Column | None = None) -> DataFrame:
    """``urls`` (page_id, url) with host, path, rule, template, purity and verdict.

    ``label`` (``block``, ``allow`` or null) is a label known of a url; without it
    the rules' verdicts are the labels.  A url that fits no rule gets its template's
    verdict.  Null urls and urls without ``://`` have empty host and path, no rule,
    and share one template; repeated rows are judged alike; an empty table gives an
    empty result; further columns are ignored.
    """
    host, path = split_url(F.col("url").cast("string"))
    base = urls.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"),
                       (F.lit(None) if label is None else label).cast("string").alias("label"))
    rule, by_rule = longest_rule(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", "label", rule.alias("rule"), by_rule.alias("by_rule"))
    base = written(base.withColumn("label", F.coalesce("label", "by_rule")), "url-base").withColumn("segs", segments(F.col("path")))
    count = lambda what: F.count(F.when(F.col("label") == what, 1)).alias(f"n_{what}")
    leaves = written(template_tree(base.groupBy("host", "segs").agg(F.count("*").alias("n"), count("block"), count("allow"))), "url-templates")
    sums = [F.sum(c).alias(c) for c in ("n", "n_block", "n_allow")]
    templates = written(leaves.groupBy("host", "template").agg(*sums, F.count("*").alias("n_leaves")), "url-template-counts")
    hosts = templates.groupBy("host").agg((F.sum("n_block") / (F.sum("n") + SMOOTH)).alias("prior"), F.count("*").alias("n_templates"))
    rated = join_counted(templates, written(hosts, "url-hosts"), ["host"], "n_templates")
    rated = rated.select("host", "template", "n_leaves", ((F.col("n_block") + SMOOTH * F.col("prior")) / (
        F.col("n_block") + F.col("n_allow") + SMOOTH)).alias("purity"))
    by_leaf = join_counted(leaves.select("host", "segs", "template", "n"), written(rated, "url-purity"), ["host", "template"], "n_leaves")
    judged = join_counted(base, written(by_leaf.drop("n_leaves"), "url-by-leaf"), ["host", "segs"], "n")
    by_method = F.when(F.col("purity") >= purity, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "template", "purity")
