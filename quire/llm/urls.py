"""URL verdicts: explicit rules first, then a tree of path templates per host, all in Spark SQL.

Rules (verdict, host suffix, path start) fit a host and its subdomains; the longest wins. What
a rule decides is also the labelled data of the templates:

1. a path is all of its segments; one with a digit is ``*``, and so is one that is rare (under
   ``rare_share``) among ``many`` or more siblings and has no labelled page (``**`` where a
   sibling ``*`` has some). Rare branches with labelled pages are left to the test of 2;
2. level by level, sibling branches merge into ``~`` when they are statistically alike: what
   follows them is spread as below their parent (chi-square), and the share of blocked
   among their labelled pages is their parent's (two standard deviations). A branch
   without labelled pages is not shown to be alike and stays apart;
3. a template is rejected when its labelled purity, smoothed by ``weight`` pages of either
   verdict, reaches ``threshold``: at least three blocked pages and nearly no allowed one,
   and ``support`` of all its pages are labelled; any other template is let in.

Levels are worked on one per round, until no path has a deeper segment; a shape that is alone
below its parent has nothing to be compared with and leaves the rounds.

Pages are counted per host and path shape before anything is joined, so a host that holds a
third of all pages is a few rows of the tree; the join back to pages is a plain equi-join that
adaptive execution may split.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule
and is judged with its like; repeated pages are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import store

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))


@dataclass(frozen=True)
class Settings:
    rules: tuple[tuple[str, str], ...] = RULES
    many: int = 8
    rare_share: float = 0.05
    deviations: float = 3.0
    weight: float = 1.0
    threshold: float = 0.8
    support: float = 0.1


def parts(pages: DataFrame, setting: Settings) -> DataFrame:
    """page_id, host, path, rule, ruled (its verdict)."""
    def piece(group: str) -> Column:
        return F.coalesce(F.regexp_extract("url", group, 1), F.lit(""))

    out = pages.select(
        "page_id",
        F.translate(piece(r"(?s)^.*?://([^/?#]*)"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        piece(r"(?s)^.*?://[^/?#]*([^?#]*)").alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, text in sorted(setting.rules, key=lambda r: (len(r[1]), r[1])):
        host, start = text.split("/", 1)
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, own).otherwise(verdict)
    return out.withColumns({"rule": rule, "ruled": verdict})


def _shape() -> Column:
    """All segments of the path, with digits generalised."""
    segments = F.filter(F.split("path", "/", -1), lambda x: x != "")
    return F.transform(segments, lambda s: F.when(s.rlike("[0-9]"), "*").otherwise(s))


_TREE = ["host", "shape", "t", "n", "labelled", "blocked"]


def _level(path: str, d: int) -> Column:
    return F.coalesce(F.get(path, F.lit(d - 1)), F.lit(""))


def _from(path: str, d: int) -> Column:
    """The segments from level ``d`` on."""
    return F.slice(path, d, F.size(path))


def _by_level(tree: DataFrame, path: str, step) -> DataFrame:
    """``step(rows, d)`` level by level on the rows whose ``_on`` it left true, while one of them is as deep in ``path``."""
    done, going, d = [], tree, 1
    while not going.where(F.size(path) >= d).isEmpty():
        out = store.keep(step(going, d))
        done.append(out.where("NOT _on").select(*_TREE))
        going, d = out.where("_on").select(*_TREE), d + 1
    for rows in done:
        going = going.unionByName(rows)
    return going


def _wildcards(shapes: DataFrame, setting: Settings) -> DataFrame:
    """Add t, the template: the segments after rare ones among many siblings without labels became ``*``."""
    up = ["host", "t"]

    def step(going: DataFrame, d: int) -> DataFrame:
        rows = going.withColumn("_s", _level("shape", d))
        each = rows.groupBy(*up, "_s").agg(F.sum("n").alias("_n"), F.sum("labelled").alias("_l"), F.count("*").alias("_shapes"))
        whole = each.groupBy(*up).agg(F.sum("_n").alias("_all"), F.count("*").alias("_kinds"), F.sum("_shapes").alias("_below"),
                                      F.sum(F.when(F.col("_s") == "*", F.col("_l")).otherwise(0)).alias("_numbered"))
        rare = ((F.col("_kinds") >= setting.many) & (F.col("_n") < setting.rare_share * F.col("_all"))
                & ~F.col("_s").isin("", "*") & (F.col("_l") == 0))
        named = each.join(whole, up).select(*up, "_s", F.when(rare, F.when(F.col("_numbered") == 0, "*").otherwise("**")).otherwise(F.col("_s")).alias("_new"), "_below")
        alone = F.col("_below") == 1
        return rows.join(named, [*up, "_s"]).withColumns({
            "t": F.when(alone, F.concat("t", _from("shape", d))).when(F.col("_s") == "", F.col("t")).otherwise(F.array_append("t", F.col("_new"))),
            "_on": ~alone & (F.col("_s") != "")})

    return _by_level(shapes.withColumn("t", F.array().cast("array<string>")), "shape", step)


def _merged(tree: DataFrame, setting: Settings) -> DataFrame:
    """Replace segments of t by ``~`` in the branches that are alike below their parent, from the first level down."""
    up = ["host", "_up"]

    def step(going: DataFrame, d: int) -> DataFrame:
        rows = going.withColumns({"_up": F.slice("t", 1, d - 1), "_own": _level("t", d), "_rest": _from("t", d + 1)})
        cells = rows.groupBy(*up, "_own", "_rest").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
        branch = cells.groupBy(*up, "_own").agg(F.sum("n").alias("bn"), F.sum("labelled").alias("bl"), F.sum("blocked").alias("bb"),
                                                F.count("*").alias("kinds"))
        pooled = cells.groupBy(*up, "_rest").agg(F.sum("n").alias("cn"))
        parent = (pooled.groupBy(*up).agg(F.sum("cn").alias("pn"), (F.count("*") - 1).alias("df"))
                  .join(branch.groupBy(*up).agg(F.sum("bl").alias("pl"), F.sum("bb").alias("pb"), F.count("*").alias("branches"),
                                                F.sum("kinds").alias("_below")), up))
        chi = (cells.join(pooled, [*up, "_rest"]).join(parent.select(*up, "pn"), up)
               .groupBy(*up, "_own").agg(F.sum(F.col("n").cast("double") * F.col("n") * F.col("pn") / F.col("cn")).alias("_x")))
        share = F.try_divide("pb", "pl")
        alike = ((F.col("branches") > 1) & (F.col("bl") > 0)
                 & (F.col("_x") / F.col("bn") - F.col("bn") <= F.col("df") + setting.deviations * F.sqrt(2.0 * F.col("df")) + 1e-6)
                 & (F.abs(F.col("bb") - F.col("bl") * share) <= 2 * F.sqrt(F.col("bl") * share * (1 - share)) + 0.5))
        named = (branch.join(chi, [*up, "_own"]).join(parent, up)
                 .select(*up, "_own", F.when(alike, "~").otherwise(F.col("_own")).alias("_new"), "_below"))
        return rows.join(named, [*up, "_own"]).withColumns({
            "t": F.when(F.col("_new") == "", F.col("t")).otherwise(F.concat("_up", F.array("_new"), "_rest")),
            "_on": (F.col("_below") > 1) & (F.col("_new") != "")})

    return _by_level(tree, "t", step)


def judge(pages: DataFrame, setting: Settings = Settings()) -> DataFrame:
    """page_id, host, path, rule, verdict, template of every page."""
    own = parts(pages, setting).withColumn("shape", _shape())
    shapes = store.keep(own.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("ruled").alias("labelled"),
        F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked")))
    tree = store.keep(_merged(_wildcards(shapes, setting), setting))
    template = F.concat("host", F.array_join(F.transform("t", lambda x: F.concat(F.lit("/"), x)), ""))
    purity = (tree.groupBy("host", "t").agg(F.sum("n").alias("_n"), F.sum("labelled").alias("_l"), F.sum("blocked").alias("_b"))
              .select("host", "t", template.alias("template"),
                      (((F.col("_b") + setting.weight) / (F.col("_l") + 2 * setting.weight) >= setting.threshold)
                       & (F.col("_l") >= setting.support * F.col("_n"))).alias("_reject")))
    judged = tree.select("host", "shape", "t").join(purity, ["host", "t"]).select("host", "shape", "template", "_reject")
    return (own.join(judged, ["host", "shape"])
            .select("page_id", "host", "path", "rule",
                    F.coalesce("ruled", F.when(F.col("_reject"), "block").otherwise("allow")).alias("verdict"), "template"))
