"""URL filter: explicit rules, and a tree of path templates per host learnt from labelled pages. DataFrame operations only.

A path becomes a list of segments, in which numbers, long hexadecimal names and file stems of digits are
already wildcards. Pages are then counted by host and list, and the tree grows level by level over these counts:

* a parent with more than `max_children` children has variable segments there: its literal children become `*`;
* literal siblings become one branch, `~`, when over all pages the share that goes on below does not differ from the
  family's beyond chance, and their labels, where they have enough, do not either;
* the share of blocked labels of a branch is smoothed towards that of its parent, which is smoothed in turn, up to the host and its
  domain: a branch with few labels is judged like what it hangs on, a domain without labels stays undecided. A
  template is rejected when its smoothed share is high enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.tables import attach
from cloudloom.llm.words import lower_ascii
from cloudloom.session import cut_lineage

DEPTH, MAX_CHILDREN, MIN_LABELS, MIN_PAGES = 4, 50, 20, 20
PURITY, PRIOR, PRIOR_WEIGHT, Z = 0.8, 0.5, 4.0, 2.0


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict. Rules are (verdict, host + path), few enough to be literals."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_domain(host: Column) -> Column:
    """The last two names of a host."""
    last = F.regexp_extract(host, r"[^.]+\.[^.]+\z", 0)
    return F.when(last == "", host).otherwise(last)


def _segments(path: Column, depth: int) -> Column:
    """Segments with numbers as `#` and long hexadecimal names as `%`; what lies deeper than `depth` is one `**`."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    parts = F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth - 1), F.array(F.lit("**")))).otherwise(parts)
    return F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"\A[0-9a-fA-F]{16,}", "%"), r"[0-9]+", "#"))


def _smoothed(blocked: str, labels: str, towards: Column) -> Column:
    return (F.col(blocked) + PRIOR_WEIGHT * towards) / (F.col(labels) + PRIOR_WEIGHT)


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    max_children: int = MAX_CHILDREN,
    min_labels: int = MIN_LABELS,
    purity: float = PURITY,
    depth: int = DEPTH,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """One row per row of `pages`: `id_col`, host, path, rule, verdict, template, labelled, blocked_share.

    Pages that a rule fits take its verdict, and are the labels of the tree; the others are blocked when the smoothed share
    of blocked labels of their template (blocked_share) reaches `purity`. labelled: labels of the template itself. Null urls
    and urls without `://` have an empty host and path. Domains without any label are allowed. No rows give no
    rows; other columns are ignored; repeated rows each get their row.
    """
    host, path = url_host(F.col("_url")), url_path(F.col("_url"))
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    base = base.select("_id", host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    base = base.select("_id", "host", "path", rule.alias("rule"), verdict.alias("given"), _segments(F.col("path"), depth).alias("segments"))

    label = (F.col("given") == "block").cast("long")
    shapes = base.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("m"), F.coalesce(F.sum(label), F.lit(0)).alias("b"))
    shapes = cut_lineage(shapes.withColumn("template", F.lit("")))
    hosts = cut_lineage(shapes.groupBy("host").agg(F.sum("m").alias("hm"), F.sum("b").alias("hb")).withColumn("domain", url_domain(F.col("host"))))
    domains = hosts.groupBy("domain").agg(F.sum("hm").alias("dm"), F.sum("hb").alias("db"))
    hosts = attach(hosts, cut_lineage(domains), ["domain"])
    hosts = hosts.select("host", _smoothed("hb", "hm", _smoothed("db", "dm", F.lit(PRIOR))).alias("share"))
    shapes = attach(shapes, cut_lineage(hosts), ["host"])
    for level in range(depth):
        here = shapes.withColumn("child", F.get("segments", F.lit(level)))
        below = F.sum(F.when(F.size("segments") > level + 1, F.col("n")).otherwise(0))
        nodes = here.filter("child IS NOT NULL").groupBy("host", "template", "child")
        nodes = cut_lineage(nodes.agg(F.sum("n").alias("n"), below.alias("d"), F.sum("m").alias("m"), F.sum("b").alias("b"), F.min("share").alias("up")))
        family = nodes.groupBy("host", "template").agg(F.count(F.lit(1)).alias("k"), *[F.sum(c).alias(f"f{c}") for c in "ndmb"])
        nodes = attach(nodes, cut_lineage(family), ["host", "template"])

        def apart(part, whole, family_part, family_whole):
            share = F.col(family_part) / F.col(family_whole)
            return F.abs(F.col(part) / F.col(whole) - share) > Z * F.sqrt(share * (1 - share) / F.col(whole))

        literal = ~F.col("child").rlike("[#%*]")
        labels_apart = F.when((F.col("m") >= min_labels) & (F.col("m") < F.col("fm")), apart("b", "m", "fb", "fm")).otherwise(F.lit(False))
        alike = (F.col("k") > 1) & (F.col("n") >= min_pages) & ~apart("d", "n", "fd", "fn") & ~labels_apart
        name = F.when(literal & (F.col("k") > max_children), F.lit("*")).when(literal & alike, F.lit("~")).otherwise(F.col("child"))
        nodes = cut_lineage(nodes.select("host", "template", "child", name.alias("name"), "m", "b", "up"))
        merged = nodes.groupBy("host", "template", "name").agg(F.sum("m").alias("tm"), F.sum("b").alias("tb"), F.min("up").alias("up"))
        merged = merged.select("host", "template", "name", _smoothed("tb", "tm", F.col("up")).alias("below"))
        names = attach(nodes.select("host", "template", "child", "name"), cut_lineage(merged), ["host", "template", "name"])
        shapes = attach(here, cut_lineage(names), ["host", "template", "child"])
        grown = F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name"))
        shapes = cut_lineage(shapes.select("host", "segments", "n", "m", "b", grown.alias("template"), F.coalesce("below", "share").alias("share")))

    labelled = shapes.groupBy("host", "template").agg(F.sum("m").alias("labelled"))
    shapes = attach(shapes.select("host", "segments", "template", F.col("share").alias("blocked_share")), cut_lineage(labelled), ["host", "template"])
    out = attach(base, cut_lineage(shapes), ["host", "segments"])
    learnt = F.when(F.col("blocked_share") >= purity, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("given", learnt).alias("verdict"), "template", "labelled", "blocked_share"
    )
