"""URL filter by a path-template tree.

Every host has a tree of path templates, grown level by level from the root:

1. Of a node's child segments, those that hold at least MIN_ROWS rows and SHARE of the node's rows
   stay as they are; the others are generalised to the wildcard of their shape ({num}, {num}.html,
   {slug}, ...).  A node so has at most 1 / SHARE literal children and a fixed set of wildcards.
2. Children that are statistically like the node's pool are merged to ``{*}``: the shapes of the
   segments that follow, and the share of blocked rows among those with a label, differ from the
   pool's by no more than chance allows (at level ALPHA; L1 and Hoeffding bounds).
3. A template's purity is its share of blocked rows among those with a label, smoothed with SMOOTH
   rows of its parent's purity; the host's is smoothed with that of all urls.  A url whose
   template's purity is over a half is blocked.

Labels are the verdicts of given rules.  All steps are aggregations and joins of DataFrames: counts
are combined on the map side, rows of the (few) nodes that hold much of the table are dealt over
SALTS tasks when they meet their node, and what a node gathers is bounded as in 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save_table

#: Levels of a tree; what is deeper is one segment of the last level.
DEPTH = 6
MIN_ROWS, SHARE = 5, 0.02
ALPHA, SMOOTH = 0.01, 4.0
#: Nodes with this share of all rows are hot: their rows are dealt over SALTS tasks.
HOT, SALTS = 1 / 256, 32

#: File endings that stay in a wildcard (others are .{ext}).
ENDINGS = "html|htm|php|asp|aspx|jsp|xml|json|pdf|txt|jpg|jpeg|png|gif|css|js"
#: What follows a path's last segment.
_LAST = "{end}"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``rule`` (host and path of the longest rule that fits, ties to the longer host; null if
    none) and ``ruled`` (its verdict).  ``rules``: (verdict, host, path)."""
    rule = ruled = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, ruled = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return urls.withColumn("rule", rule).withColumn("ruled", ruled)


def shape(segment: Column) -> Column:
    """The wildcard of a segment: the kind of its stem, and its ending."""
    ending = F.regexp_extract(segment, r"\.([A-Za-z0-9]{1,5})$", 1)
    has = ending != ""
    stem = F.when(has, F.substring(segment, F.lit(1), F.length(segment) - F.length(ending) - 1)).otherwise(segment)
    kind = (F.when(stem == "", "{empty}")
            .when(stem.rlike(r"^[0-9]+$"), "{num}")
            .when(stem.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")
            .when(stem.rlike(r"^[0-9a-fA-F-]{8,}$"), "{hex}")
            .when(stem.rlike(r"^[A-Za-z]+$"), "{word}")
            .when(stem.rlike(r"^[A-Za-z0-9]+([-_][A-Za-z0-9]+)+$"), "{slug}")
            .otherwise("{mixed}"))
    known = F.when(F.lower(ending).rlike(f"^({ENDINGS})$"), F.concat(F.lit("."), F.lower(ending))).otherwise(F.lit(".{ext}"))
    return F.when(has, F.concat(kind, known)).otherwise(kind)


def _literal(segment: Column) -> Column:
    return F.concat(F.lit("="), segment)


def _segments(path: Column) -> Column:
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/", -1)
    rest = F.array_join(F.slice(parts, DEPTH, F.greatest(F.size(parts) - (DEPTH - 1), F.lit(1))), "/")
    return (F.when(path == "", F.array().cast("array<string>"))
            .when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH - 1), F.array(rest))).otherwise(parts))


def _smoothed(blocked: Column, labelled: Column, parent: Column) -> Column:
    return (blocked + SMOOTH * parent) / (labelled + SMOOTH)


def _meet(rows: DataFrame, nodes: DataFrame, keys: list[str], every: int) -> DataFrame:
    """``rows`` with what ``nodes`` (``n`` rows of each, a row a key) holds, rows of hot nodes dealt."""
    hot = nodes.where(F.col("n") >= max(1.0, every * HOT)).select(*(F.col(k).alias("h_" + k) for k in keys), F.lit(True).alias("hot"))

    def salted(df: DataFrame, salt: Column) -> DataFrame:
        # at most 1 / HOT nodes can be hot
        on = [F.col(k) == F.col("h_" + k) for k in keys]
        return df.join(F.broadcast(hot), on, "left").withColumn("salt", salt).drop("hot", *("h_" + k for k in keys))

    left = salted(rows, F.when(F.col("hot"), F.pmod(F.xxhash64("path"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    right = salted(nodes.drop("n"), F.explode(F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
                                             .otherwise(F.array(F.lit(0).cast("long")))))
    on = [*keys, "salt"]
    renamed = right.select(*(F.col(c).alias("m_" + c) if c in on else F.col(c) for c in right.columns))
    return left.join(renamed, [F.col(c) == F.col("m_" + c) for c in on], "left").drop("salt", *("m_" + c for c in on))


def _counts() -> list[Column]:
    return [F.count("*").alias("n"), F.count("blocked").alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked")]


def _sums(*names: str) -> list[Column]:
    return [F.sum(c).alias(c) for c in (names or ("n", "labelled", "blocked"))]


def _children(urls: DataFrame, every: int) -> tuple[DataFrame, DataFrame]:
    """For the urls with a segment ``seg``: each node's literal children, and for each node a map of
    its children's (literals' and wildcards') labels and purities."""
    node = ["host", "template"]
    counted = save_table(urls.where(F.col("seg").isNotNull()).groupBy(*node, "seg", "next", "purity").agg(*_counts()), "url-level")
    totals = counted.groupBy(*node).agg(F.sum("n").alias("n"))
    often = counted.groupBy(*node, "seg").agg(F.sum("n").alias("rows")).where(F.col("rows") >= MIN_ROWS).withColumn("path", F.col("seg"))
    whole = totals.withColumn("total", F.col("n"))
    literals = (_meet(often, whole, node, every).where(F.col("rows") >= SHARE * F.col("total"))
                .groupBy(*node).agg(F.collect_set("seg").alias("literals")))
    known = totals.join(literals.select(F.col("host").alias("l_host"), F.col("template").alias("l_template"), "literals"),
                        (F.col("host") == F.col("l_host")) & (F.col("template") == F.col("l_template")), "left")
    known = save_table(known.select(*node, "n", F.coalesce("literals", F.array().cast("array<string>")).alias("literals")), "url-nodes")

    # a node has at most 1 / SHARE literals and the wildcards, each with as many following shapes
    labelled = _meet(counted.withColumnRenamed("n", "rows").withColumn("path", F.col("seg")), known, node, every)
    child = F.when(F.array_contains("literals", F.col("seg")), _literal(F.col("seg"))).otherwise(shape(F.col("seg")))
    small = (labelled.withColumn("child", child).groupBy(*node, "child", "next", "purity")
             .agg(F.sum("rows").alias("n"), *_sums("labelled", "blocked")))
    of_node, of_child = Window.partitionBy(*node), Window.partitionBy(*node, "child")
    of_next = Window.partitionBy(*node, "next")
    small = (small.withColumn("n_node", F.sum("n").over(of_node)).withColumn("n_child", F.sum("n").over(of_child))
             .withColumn("n_next", F.sum("n").over(of_next)).withColumn("nexts", F.size(F.collect_set("next").over(of_node))))
    pooled = F.col("n_next") / F.col("n_node")
    each = small.groupBy(*node, "child").agg(
        *_sums(), F.first("purity").alias("purity"), F.first("nexts").alias("nexts"),
        F.sum(F.abs(F.col("n") / F.col("n_child") - pooled) - pooled).alias("apart"))
    each = (each.withColumn("pool_labelled", F.sum("labelled").over(of_node)).withColumn("pool_blocked", F.sum("blocked").over(of_node)))
    # the L1 distance to the pool: shapes that the child lacks count with their share of the pool
    like = ((F.col("apart") + 1 <= F.sqrt(2 * (F.col("nexts") * F.log(F.lit(2.0)) - F.log(F.lit(ALPHA))) / F.col("n")))
            & F.when(F.col("labelled") == 0, True).otherwise(
                F.abs(F.col("blocked") / F.col("labelled") - F.col("pool_blocked") / F.col("pool_labelled"))
                <= F.sqrt(F.log(F.lit(2.0 / ALPHA)) / (2 * F.col("labelled")))))
    each = each.withColumn("like", F.coalesce(like, F.lit(False)))
    alike = F.sum(F.col("like").cast("int")).over(of_node)
    each = each.withColumn("label", F.when(F.col("like") & (alike > 1), F.lit("{*}")).otherwise(F.col("child")))
    branch = Window.partitionBy(*node, "label")
    each = each.withColumn("purity", _smoothed(F.sum("blocked").over(branch), F.sum("labelled").over(branch), F.col("purity")))
    maps = each.groupBy(*node).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(
        F.struct("child", F.struct("label", "purity")))).alias("children"))
    return known, save_table(maps, "url-children")


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row.

    A null url, or one without ``://``, has an empty host and path.  A url that a rule fits gets the
    rule's verdict; any other ``block`` if its template's purity is over a half, else ``allow``
    (without any label, all are allowed).  An id may be null or repeat.  An empty table gives no rows.
    """
    url = F.col(url_column)
    rows = with_rules(urls.select(F.col(id_column).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")), rules)
    rows = rows.withColumn("blocked", F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("int")))
    rows = save_table(rows, "url-rows")
    every, labelled, blocked, deepest = rows.agg(*_counts(), F.max(F.size(_segments(F.col("path"))))).first()
    overall = (blocked + 0.5) / (labelled + 1)
    hosts = rows.groupBy("host").agg(*_counts())
    hosts = hosts.select("host", "n", _smoothed(F.col("blocked"), F.col("labelled"), F.lit(overall)).alias("purity"))
    rows = _meet(rows, hosts, ["host"], every).withColumn("template", F.lit(""))
    for level in range(deepest or 0):
        segments = _segments(F.col("path"))
        following = F.get(segments, F.lit(level + 1))
        rows = save_table(rows.withColumn("seg", F.get(segments, F.lit(level)))
                          .withColumn("next", F.when(following.isNull(), F.lit(_LAST)).otherwise(shape(following))), "url-rows")
        known, maps = _children(rows, every)
        met = _meet(rows, maps, ["host", "template"], every)
        found = F.coalesce(F.try_element_at("children", _literal(F.col("seg"))), F.try_element_at("children", shape(F.col("seg"))))
        here = F.col("seg").isNotNull()
        rows = (met.withColumn("found", F.when(here, found))
                .withColumn("template", F.when(here, F.concat("template", F.lit("/"), "found.label")).otherwise(F.col("template")))
                .withColumn("purity", F.when(here, F.col("found.purity")).otherwise(F.col("purity")))
                .drop("children", "found", "seg", "next"))
    verdict = F.coalesce("ruled", F.when(F.col("purity") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
