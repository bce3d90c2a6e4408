"""Findings of round 3: work is spread and done once, whatever a key's share of the rows."""
import re

import pytest
from pyspark.sql import functions as F

from docsift.operators.features import dedup_by_key
from docsift.operators.matching import (attach_patterns, find_matches, match_facts, prepare_patterns,
                                        resolve_overlaps, scored, with_scan)
from docsift.operators.reply import parse_replies, read_reply
from docsift.operators.scoring import apply_rubrics, industry_adjust, industry_required
from docsift.operators.validation import evaluate_rules
from docsift.sources.configs import config_tables

ORDERS = "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def first_plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture(scope="module")
def replies(spark):
    lines = ["Document Type: Bill\nConfidence: 0.7\n- Amount: $3.00 and £4\n2. Terms - net\nCPT: 99213",
             None, "", "Date/Fecha: 1/2\n- date/fecha: x\nConfidence: high"]
    return spark.createDataFrame([(i, "financial", t) for i, t in enumerate(lines)], "doc_id long, industry string, response string")


def test_reply_is_read_once_under_filters(replies):
    """A filter on parsed columns doesn't copy the parse."""
    d = apply_rubrics(parse_replies(replies)).filter("doc_type = 'invoice' AND size(features) > 0")
    assert plan_of(d).count("_read(") == 1
    row = d.first()
    assert [(f.type, f.value) for f in row.features] == [
        ("amount", "$3.00 and £4"), ("amount", "$3.00"), ("amount", "£4"), ("cpt_code", "99213"), ("section", "Terms"),
        ("document_type", "invoice")]
    got = {r.doc_id: r for r in parse_replies(replies).collect()}
    assert got[1].features is None and got[1].multilingual is None and got[1].doc_type is None
    assert got[2].features == [] and got[2].multilingual is False and got[2].reply_confidence is None
    assert got[3].multilingual is True and got[3].reply_confidence == 0.5


def test_reply_is_read_into_flat_columns(spark):
    """no tuple or list for each feature; only aggregates bring lists of their own."""
    text = "- CPT Code: 1\n- Total: $3 £4\nService: CPT 99213\nCPT: 99214\n1. A - x\n2. B\n-: no key\n- : blank key\n- no colon"
    _, _, multilingual, types, values, last = read_reply(text)
    assert multilingual is False and last == [["99213", "99214"], ["A", "B"]]
    assert types[-2:] == ["cpt_code", "section"] and values[-2:] == ["99213, 99214", "A"] and types.count("cpt_code") == 1
    assert ("", "blank key") in zip(types, values) and all(isinstance(x, str) for x in types + values)
    df = spark.createDataFrame([(0, text), (1, None), (2, "- Date: d"), (3, "")], "doc_id long, response string")
    got = {r.doc_id: r.features for r in parse_replies(df).collect()}
    assert [(f.type, f.value) for f in got[0]] == list(zip(types, values))
    assert [f.values for f in got[0]] == [[v] for v in values[:-2]] + last
    assert got[1] is None and [(f.type, f.values) for f in got[2]] == [("date", ["d"])] and got[3] == []


def test_config_joins_do_not_shuffle_documents(spark, replies):
    """No join by industry puts an industry's rows in one task."""
    cfg = config_tables(spark)
    d = industry_adjust(apply_rubrics(parse_replies(replies)), industry_required(cfg))
    joins = re.findall(r"\w+Join", first_plan(d))
    assert joins[0] == "BroadcastHashJoin"     # the documents' join; those under it are of config tables
    feats = spark.createDataFrame([("financial", "amount", "3")], "industry string, feature_type string, feature_value string")
    assert "SortMergeJoin" not in first_plan(evaluate_rules(feats, cfg["industry_rules"]))


def test_orders_are_spread(spark, tmp_path):
    """One file's rows are rendered and parsed by several tasks."""
    from docsift.sources import tables
    from docsift.sources.render import replies as rendered
    spark.range(100).selectExpr("id AS o_orderkey", "id % 3 AS o_custkey", "1.0D AS o_totalprice",
                                "DATE'2024-01-02' AS o_orderdate").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(3).selectExpr("id AS c_custkey", "'n' AS c_name").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = rendered(spark, str(tmp_path)).withColumn("p", F.spark_partition_id()).collect()
    assert len(rows) == 100 and len({r.p for r in rows}) > 1
    assert tables.spread(spark.range(10), 10 * tables.ROWS_PER_TASK * 8).rdd.getNumPartitions() >= 80


def test_blank_matches_are_not_made():
    """An expression that matches the empty string everywhere gives only what isn't blank."""
    assert [m[:3] for m in match_facts(r"\d*", "x" * 1000 + "12 \t 3")] == [("12", 1000, 1002), ("3", 1005, 1006)]
    assert list(match_facts(r"\s+|x", " x \n")) and [m[0] for m in match_facts(r"\s+|x", " x \n")] == ["x"]


def test_order_and_first_places_without_lambdas(spark):
    """overlaps and repeats are settled outside of interpreted lambdas, with the same order."""
    m = "array<struct<pattern_idx int, text string, start bigint, end bigint, confidence double>>"
    rows = [(1, [(2, "bb", 1, 3, .5), (1, "bb", 1, 3, .5), (0, "a", 0, 1, .1), (3, "abc", 0, 3, .1), (5, "c", 2, 3, .9)]), (2, []), (3, None)]
    d = spark.createDataFrame(rows, f"id long, m {m}")
    out = resolve_overlaps(d, F.col("m"), "kept")
    assert "array_sort" not in plan_of(out)
    got = {r.id: r.kept for r in out.collect()}
    assert [(x.pattern_idx, x.text) for x in got[1]] == [(0, "a"), (5, "c")] and got[2] == [] and not got[3]
    f = spark.createDataFrame([([("t", "v", 1), ("t", None, 2), ("t", "v", 3), (None, None, 4), ("t", None, 5)],), (None,)],
                              "a array<struct<type string, value string, n int>>")
    assert "array_sort" not in plan_of(f.select(dedup_by_key(F.col("a"))))
    got = [r.d for r in f.select(dedup_by_key(F.col("a")).alias("d")).collect()]
    assert [x.n for x in got[0]] == [3, 5, 4] and got[1] is None


def test_parts_are_spread(spark, tmp_path):
    """one file's parts are scored by several tasks."""
    from docsift.plans.fuzzy_queries import _part_texts
    from docsift.plans.store_queries import sql_scorers
    spark.range(100).selectExpr("id AS p_partkey", "concat('red ring ', id) AS p_name", "'T' AS p_type",
                                "3 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for d in (_part_texts(spark, str(tmp_path), "name"), sql_scorers(spark, str(tmp_path))):
        assert len({r.p for r in d.withColumn("p", F.spark_partition_id()).collect()}) > 1


def test_documents_stream_by_bytes(spark, tmp_path):
    """F8: small files share a micro-batch, so that the earlier results are not read for each of them."""
    from docsift.plans.stream_queries import _results_of_documents, _streamed
    rows = spark.range(40).selectExpr("id AS doc_id", "concat('mail a', id % 30, '@b.org') AS text", "'en' AS lang", "'s' AS source",
                                      "10L AS n_chars")
    rows.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    out = _streamed(spark, str(tmp_path))
    assert {r.batch_id for r in spark.read.parquet(f"{out}/doc_map").select("batch_id").distinct().collect()} == {0}
    assert _results_of_documents(spark, out).filter("pattern_count = 1").count() == 40


def test_patterns_are_matched_and_scored_outside_of_lambdas(spark):
    """repeated expressions, patterns of other types, null fields and named groups, with the
    numbers that the columns give."""
    pats = [("a", 0, "regex", r"\d+", "n", "t", 1.0), ("b", 1, "fuzzy", None, "w", "t", 1.0), ("c", 2, "learned", r"\d+", "n", "u", 1.0),
            ("d", 3, "regex", r"(?P<x>a)(?P<y>b)(?P<z>c)(?P<w>d)", "g", "t", 1.0), ("e", 4, "regex", r"\d+", "n", "t", 0.5),
            ("f", 5, "regex", r"[^ \d]+", "n", "u", None), ("g", 6, "context", "x", "n", "t", 1.0), ("h", 7, "regex", "", "n", "t", 1.0)]
    p = prepare_patterns(spark.createDataFrame(
        pats, "pattern_id string, pattern_idx int, type string, expression string, feature_type string, industry string, confidence_value double"))
    texts = ["12 abcd x 7", "é9.", "", None, "  77 ", "a_b"]
    docs = spark.createDataFrame([(i, ind, t) for i, t in enumerate(texts) for ind in ("t", "u", "v", None)], "doc_id long, industry string, text string")
    d = with_scan(attach_patterns(docs, p, "all"), "text", "patterns", ("regex", "learned"), 0.0, "raw")
    unscored = F.transform("raw", lambda r: r.withField("confidence", F.lit(None).cast("double")))
    rows = d.select("text", "patterns", scored(F.col("raw"), F.col("patterns"), 0.0).alias("got"),
                    scored(unscored, F.col("patterns"), 0.0).alias("want")).collect()
    for r in rows:
        assert r.got == r.want  # to the last bit
        assert [(m.pattern_id, m.text, m.start) for m in r.got] == [
            (x.pattern_id, f[0], f[1]) for x in r.patterns if x.type in ("regex", "learned") for f in (match_facts(x.expression, r.text) if r.text else [])]
    assert sum(len(r.got) for r in rows) > 20 and any(m.named_groups for r in rows for m in r.got)
    found = find_matches(attach_patterns(docs, p, "all"), fuzzy=False)
    assert not [w for w in ("zip_with", "filter(patterns", "transform(patterns") if w in plan_of(found)]
    assert [m[3] for r in found.filter("text = 'a_b' AND industry = 'u'").collect() for m in r.matches] == ["exact"]
