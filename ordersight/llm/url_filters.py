"""URL filters: rule list, then a path-template tree with labelled purity (native).

Rules (``host/path``) decide first: a rule fits its host and all subdomains if
the url's path starts with the rule's path; the longest fitting rule wins.

Urls that no rule decides are judged by templates learned from the table:

1. Segments of a path that vary (numbers, long hex or digit-bearing strings) become
   ``*``; file extensions stay (``*.html``).  Urls are then counted per
   (host, generalised path), which shrinks the data to templates before any
   further step.
2. Top-down over the levels of each host's tree, a node with more than
   ``max_children`` different children has them generalised to ``*`` as well.
3. Sibling branches whose labelled rates do not differ (two-proportion z-test of
   a branch against its siblings) merge into ``~``; branches without labels stay
   apart, as they offer no evidence.
4. A template is rejected if its smoothed share of bad labels,
   ``(bad + strength * prior) / (labelled + strength)``, exceeds ``max_bad``.  The prior
   is the smoothed share of its nearest labelled ancestor, host included; only hosts
   without any label fall back on the given one.

The tree goes on as long as paths differ.  Segments that all paths of a node share are
taken in one step: they have its evidence and are no ancestors of their own.  So there is
one round per level at which paths branch, however long the paths are.

Labels are the rules' own decisions (block = bad, allow = good), plus an optional
table of labelled urls.

Scale: the url rows are touched twice, once to count and once to look up
their template, on a join key (host, generalised path) that AQE can split at a
hot host.  All tree steps run on the template counts with pre-aggregated group-bys;
the counts are checkpointed once a round, so the lineage stays short.

Defined cases: a null url, or one without ``://``, has empty host and path and
gets the method's verdict on that (empty) template; empty tables give no rows;
repeated rows each get their verdict; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.llm.common import col

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class TreeParams:
    """levels: path depth that is told apart, deeper segments join into one ``**``; None for all."""

    levels: int | None = None
    max_children: int = 20
    min_labelled: int = 5
    z: float = 1.96
    strength: float = 4.0
    prior: float = 0.2
    max_bad: float = 0.8


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path from there up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does.

    ``rules`` is a short list of (verdict, ``host/path``), tried from the longest.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest ends up outermost
        rule_host, slash, rule_path = text.partition("/")
        rule_path = slash + rule_path
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _segment(s: Column) -> Column:
    """Generalised form of one path segment."""
    extension = F.regexp_extract(s, r"(\.[A-Za-z]{1,5}[0-9]?)$", 1)
    stem = F.substring(s, F.lit(1), F.length(s) - F.length(extension))
    variable = stem.rlike(r"^[0-9]+$") | stem.rlike(r"^[0-9A-Fa-f-]{8,}$") | stem.rlike(r"[0-9].*[0-9].*[0-9]")
    return F.when(variable, F.concat(F.lit("*"), extension)).otherwise(s)


def shape(path: Column, levels: int | None) -> Column:
    """Path as an array of generalised segments; with ``levels`` of at most so many, the rest is ``**``."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    if levels is None:
        return F.transform(parts, _segment)
    head = F.transform(F.slice(parts, 1, levels), _segment)
    return F.when(F.size(parts) > levels, F.concat(head, F.array(F.lit("**")))).otherwise(head)


def _common(low: Column, high: Column) -> Column:
    """Number of leading elements that two arrays share; of their smallest and largest, that all of a group share."""
    differs = F.array_position(F.zip_with(low, high, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(low)).cast("int")


def _from(array: Column, start: Column) -> Column:
    """The elements from ``start`` (counted from 1) on."""
    return F.slice(array, start, F.greatest(F.size(array) - start + 1, F.lit(0)))


def template_tree(counts: DataFrame, p: TreeParams) -> DataFrame:
    """(host, shape, n, bad, good) -> (host, shape, template, prior, t_bad, t_good): wildcards and merges applied.

    ``rest`` is what a node has not told apart yet.  Each round first takes the segments that
    all shapes of a node share, then its children.
    """
    d = counts.withColumns(
        {"template": F.array().cast("array<string>"), "rest": F.col("shape"), "prior": F.lit(float(p.prior))}
    ).checkpoint()
    while not d.where(F.size("rest") > 0).isEmpty():
        total = d.groupBy(F.col("host").alias("t_host"), F.col("template").alias("t_template")).agg(
            _common(F.min("rest"), F.max("rest")).alias("skip"), F.sum("bad").alias("tb"), F.sum("good").alias("tg")
        )
        # the child of this node; shorter paths end here
        child = F.when(F.size("rest") > F.col("skip"), F.element_at("rest", F.col("skip") + 1))
        d = d.join(total, (d["host"] == total["t_host"]) & (d["template"] == total["t_template"])).select(
            *d.columns, "skip", "tb", "tg", child.alias("child")
        )
        node = d.groupBy("host", "template", "child").agg(
            F.sum("bad").alias("b"), F.sum("good").alias("g"), F.first("tb").alias("tb"), F.first("tg").alias("tg")
        )
        width = node.groupBy(F.col("host").alias("w_host"), F.col("template").alias("w_template")).agg(
            F.count("child").alias("children")
        )
        node = node.join(width, (node["host"] == width["w_host"]) & (node["template"] == width["w_template"]))
        labelled, rest = F.col("b") + F.col("g"), F.col("tb") + F.col("tg") - F.col("b") - F.col("g")
        rate = F.col("b") / labelled
        others = (F.col("tb") - F.col("b")) / rest
        pooled = (F.col("tb") + 1.0) / (F.col("tb") + F.col("tg") + 2.0)  # smoothed, so never 0 or 1
        spread = F.sqrt(pooled * (1 - pooled) * (1 / labelled + 1 / rest))
        alike = (labelled >= p.min_labelled) & (rest >= p.min_labelled) & F.when(
            (labelled > 0) & (rest > 0), F.abs(rate - others) < p.z * spread
        )
        name = (
            F.when(F.col("child").isNull(), F.lit(None).cast("string"))
            .when((F.col("children") > p.max_children) & (F.col("child") != "**"), F.lit("*"))
            .when(F.coalesce(alike, F.lit(False)), F.lit("~"))
            .otherwise(F.col("child"))
        )
        names = node.select(
            F.col("host").alias("n_host"), F.col("template").alias("n_template"), F.col("child").alias("n_child"), name.alias("name")
        )
        same = (
            (d["host"] == names["n_host"])
            & (d["template"] == names["n_template"])
            & d["child"].eqNullSafe(names["n_child"])
        )
        # this node is the nearest labelled ancestor of what goes on below it
        below = F.col("name").isNotNull() & (F.col("tb") + F.col("tg") > 0)
        share = (F.col("tb") + p.strength * F.col("prior")) / (F.col("tb") + F.col("tg") + p.strength)
        path = F.concat("template", F.slice("rest", F.lit(1), F.col("skip")))
        d = d.join(names, same).select(
            "host",
            "shape",
            "n",
            "bad",
            "good",
            F.when(F.col("name").isNull(), path).otherwise(F.concat(path, F.array("name"))).alias("template"),
            _from(F.col("rest"), F.col("skip") + 2).alias("rest"),
            F.when(below, share).otherwise(F.col("prior")).alias("prior"),
        ).checkpoint()  # each round reads the last one several times
    leaf = d.groupBy("host", "template").agg(F.max("prior").alias("prior"), F.sum("bad").alias("t_bad"), F.sum("good").alias("t_good"))
    return d.select("host", "shape", "template").join(leaf, ["host", "template"])


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    params: TreeParams = TreeParams(),
    labelled_urls: DataFrame | None = None,
) -> DataFrame:
    """Per input row: id, host, path, rule, verdict, template, purity.

    ``labelled_urls`` (url, bad 0/1) adds evidence to that of the rules.
    """
    def parsed(df: DataFrame, keep: list[Column]) -> DataFrame:
        host, path = host_and_path(F.col("url"))
        d = df.select(*keep, host.alias("host"), path.alias("path"))
        rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
        return d.withColumns({"rule": rule, "decided": verdict, "shape": shape(F.col("path"), params.levels)})

    urls = parsed(pages.select(col(id_col).alias("id"), col(url_col).alias("url")), [F.col("id")])
    evidence = urls.select(
        "host",
        "shape",
        F.lit(1).alias("n"),
        F.when(F.col("decided") == BLOCK, 1).otherwise(0).alias("bad"),
        F.when(F.col("decided") == ALLOW, 1).otherwise(0).alias("good"),
    )
    if labelled_urls is not None:
        extra = parsed(labelled_urls.select("url", "bad"), [F.col("bad")])
        evidence = evidence.unionByName(
            extra.select(
                "host",
                "shape",
                F.lit(0).alias("n"),
                F.when(F.col("bad") == 1, 1).otherwise(0).alias("bad"),
                F.when(F.col("bad") == 0, 1).otherwise(0).alias("good"),
            )
        )
    counts = evidence.groupBy("host", "shape").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    tree = template_tree(counts, params)
    purity = (F.col("t_bad") + params.strength * F.col("prior")) / (F.col("t_bad") + F.col("t_good") + params.strength)
    tree = tree.select(
        F.col("host").alias("t_host"),
        F.col("shape").alias("t_shape"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"),
        purity.alias("purity"),
    )
    same = (urls["host"] == tree["t_host"]) & (urls["shape"] == tree["t_shape"])
    method = F.when(F.col("purity") > params.max_bad, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return urls.join(tree, same).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("decided", method).alias("verdict"),
        "template",
        F.round("purity", 6).alias("purity"),
    )
