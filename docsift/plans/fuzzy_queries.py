"""Fuzzy-matching queries over names and addresses rendered from ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import address_parts, levenshtein_ratio, ngram_similarity, street_type_norm
from ..operators.matching import attach_patterns, find_matches, prepare_patterns
from ..sources.tables import spread, table
from .matching_queries import _flat
from .registry import r6, register

FUZZY_SCHEMA = ("pattern_id string, pattern_idx int, type string, expression string, feature_type string, "
                "industry string, examples array<string>, is_name boolean, is_address boolean, "
                "min_confidence double")

# example lists of the three fuzzy patterns (pattern data)
WORD_EXAMPLES = ["ring", "gear", "widget", "bolts", "anvil"]
NAME_EXAMPLES = ["Ring Small", "Dr. Gear Blue", "Mr. Bolt"]
ADDRESS_EXAMPLES = ["11 small Street", "3 red Avenue", "7 blue St", "12 old Road", "5 hot Ave",
                    "18 large St", "2 small Rd"]


def fuzzy_patterns(spark: SparkSession) -> DataFrame:
    rows = [("fuzzy.word", 0, "fuzzy", None, "part_word", "parts", WORD_EXAMPLES, False, False, None),
            ("fuzzy.name", 1, "fuzzy", None, "person_name", "parts", NAME_EXAMPLES, True, False, None),
            ("fuzzy.address", 2, "fuzzy", None, "address", "parts", ADDRESS_EXAMPLES, False, True, None)]
    return prepare_patterns(spark.createDataFrame(rows, FUZZY_SCHEMA))


ADDRESS_LINE = ("CAST(p_size % 20 AS STRING) || ' ' || split_part(p_name, ' ', 1) || ' ' || "
                "CASE p_partkey % 4 WHEN 0 THEN 'St' WHEN 1 THEN 'Street' WHEN 2 THEN 'Ave' ELSE 'Road' END")


def _part_texts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size")
    p = spread(p, p.count())
    if kind == "word":
        text = F.expr("p_name || ' ' || lower(p_type)")
    elif kind == "name":
        text = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'Dr. ' WHEN 1 THEN 'Mr. ' ELSE '' END"
                      " || initcap(split_part(p_name, ' ', 2)) || ' ' || initcap(split_part(p_name, ' ', 1))")
    else:
        text = F.expr(f"'Ship to:' || chr(10) || '  ' || {ADDRESS_LINE} || chr(10) || 'Ref ' || CAST(p_partkey AS STRING)")
    return p.select(F.col("p_partkey").alias("doc_id"), F.lit("parts").alias("industry"), text.alias("text"))


def _fuzzy_query(kind: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        pats = fuzzy_patterns(spark).filter(F.col("pattern_id") == f"fuzzy.{kind}")
        d = attach_patterns(_part_texts(spark, sf_dir, kind), pats)
        return _flat(find_matches(d, fuzzy=True), "matches")
    q.__doc__ = f"Fuzzy {kind} matching against pattern examples, scored on distinct pairs, overlap-resolved."
    return q


for _k in ("word", "name", "address"):
    register(f"{_k}_fuzzy_matches")(_fuzzy_query(_k))


_PAIRS_DUCK = f"""
WITH a AS (SELECT p_partkey, p_name, {ADDRESS_LINE} AS addr FROM part),
pr AS (SELECT a1.p_partkey AS k, a1.p_name AS n1, a2.p_name AS n2, a1.addr AS a1, a2.addr AS a2
       FROM a a1 JOIN a a2 ON a2.p_partkey = a1.p_partkey + 1)"""


@register("levenshtein_ratio", _PAIRS_DUCK + """
SELECT k::BIGINT AS p_partkey, n1, n2,
       round(1 - levenshtein(n1, n2)::DOUBLE / greatest(length(n1), length(n2)), 6) AS lev_ratio FROM pr""")
def levenshtein_ratio_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levenshtein ratio between consecutive part names (equi-join on key + 1)."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name")
    q = p.alias("a").join(p.alias("b"), F.col("b.p_partkey") == F.col("a.p_partkey") + 1)
    return q.select(F.col("a.p_partkey").cast("bigint").alias("p_partkey"), F.col("a.p_name").alias("n1"),
                    F.col("b.p_name").alias("n2"),
                    r6(levenshtein_ratio(F.col("a.p_name"), F.col("b.p_name"))).alias("lev_ratio"))


def _ngrams_sql(x: str) -> str:
    return (f"CASE WHEN length({x}) >= 3 THEN list_distinct(list_transform(generate_series(1, length({x}) - 2), "
            f"lambda i: substring({x}, i, 3))) ELSE [] END")


def _overlap_sql(a: str, b: str) -> str:
    return (f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / "
            f"greatest(len({a}), len({b})) ELSE 0.0 END")


_TYPES = "['st', 'street', 'ave', 'avenue', 'rd', 'road', 'ln', 'lane', 'dr', 'drive', 'blvd', 'boulevard']"
_TNORM = ("CASE {t} WHEN 'st' THEN 'street' WHEN 'str' THEN 'street' WHEN 'av' THEN 'avenue' WHEN 'ave' THEN 'avenue' "
          "WHEN 'rd' THEN 'road' WHEN 'ln' THEN 'lane' WHEN 'dr' THEN 'drive' WHEN 'blvd' THEN 'boulevard' ELSE {t} END")


def _addr_sql(col: str, p: str) -> str:
    """CTE columns for the loose address split of ``col`` with prefix ``p``."""
    parts = f"list_filter(string_split_regex(regexp_replace(lower({col}), '^\\s+|\\s+$', '', 'g'), '\\s+'), lambda x: x <> '')"
    return f"""{parts} AS {p}parts"""


@register("ngram_similarity", _PAIRS_DUCK + f""",
s0 AS (SELECT k, n1, n2, a1, a2,
    list_filter(string_split_regex(lower(a1), '\\s+'), lambda x: x <> '') AS pa,
    list_filter(string_split_regex(lower(a2), '\\s+'), lambda x: x <> '') AS pb FROM pr),
s1 AS (SELECT *, list_filter(pa, lambda x: regexp_matches(x, '^\\d+$'))[1] AS na,
                 list_filter(pb, lambda x: regexp_matches(x, '^\\d+$'))[1] AS nb FROM s0),
s2 AS (SELECT *, list_filter(pa, lambda x, i: i <> list_position(pa, na)) AS ra,
                 list_filter(pb, lambda x, i: i <> list_position(pb, nb)) AS rb FROM s1),
s3 AS (SELECT *, list_filter(ra, lambda x: list_contains({_TYPES}, x))[1] AS ta,
                 list_filter(rb, lambda x: list_contains({_TYPES}, x))[1] AS tb FROM s2),
s4 AS (SELECT *, array_to_string(list_filter(ra, lambda x, i: i <> coalesce(list_position(ra, ta), 0)), ' ') AS nma,
                 array_to_string(list_filter(rb, lambda x, i: i <> coalesce(list_position(rb, tb), 0)), ' ') AS nmb FROM s3),
s5 AS (SELECT *, (CASE WHEN na = nb THEN 1.0 ELSE 0.0 END) * 0.5
                 + ({_overlap_sql(_ngrams_sql('nma'), _ngrams_sql('nmb'))}) * 0.3
                 + (CASE WHEN ta IS NOT NULL AND tb IS NOT NULL AND {_TNORM.format(t='ta')} = {_TNORM.format(t='tb')}
                         THEN 1.0 ELSE 0.0 END) * 0.2 AS addr,
                 {_overlap_sql(_ngrams_sql('lower(n1)'), _ngrams_sql('lower(n2)'))} AS plain_names,
                 len(pa) >= 2 AND na IS NOT NULL AND len(pb) >= 2 AND nb IS NOT NULL AS both_addr FROM s4)
SELECT k::BIGINT AS p_partkey,
       round(CASE WHEN plain_names >= 0.7 THEN plain_names ELSE 0.0 END, 6) AS name_ngram,
       round(CASE WHEN both_addr THEN CASE WHEN addr >= 0.6 THEN addr ELSE 0.0 END ELSE 0.0 END, 6) AS address_ngram
FROM s5""")
def ngram_similarity_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram similarity of consecutive part names and of address lines (address-aware branch)."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size").withColumn("addr", F.expr(ADDRESS_LINE))
    q = p.alias("a").join(p.alias("b"), F.col("b.p_partkey") == F.col("a.p_partkey") + 1)
    return q.select(F.col("a.p_partkey").cast("bigint").alias("p_partkey"),
                    r6(ngram_similarity(F.col("a.p_name"), F.col("b.p_name"))).alias("name_ngram"),
                    r6(ngram_similarity(F.col("a.addr"), F.col("b.addr"))).alias("address_ngram"))


@register("address_parse", f"""
WITH a AS (SELECT p_partkey, {ADDRESS_LINE} AS addr FROM part),
s0 AS (SELECT p_partkey, addr, list_filter(string_split_regex(lower(addr), '\\s+'), lambda x: x <> '') AS pa FROM a),
s1 AS (SELECT *, list_filter(pa, lambda x: regexp_matches(x, '^\\d+$'))[1] AS num FROM s0),
s2 AS (SELECT *, list_filter(pa, lambda x, i: i <> list_position(pa, num)) AS rem FROM s1),
s3 AS (SELECT *, list_filter(rem, lambda x: list_contains({_TYPES}, x))[1] AS typ FROM s2),
s4 AS (SELECT *, array_to_string(list_filter(rem, lambda x: x IS DISTINCT FROM typ), ' ') AS nm FROM s3)
SELECT p_partkey::BIGINT AS p_partkey, num AS number, nm AS street_name, typ AS street_type,
       {_TNORM.format(t='typ')} AS street_type_norm
FROM s4 WHERE len(pa) >= 2 AND num IS NOT NULL AND typ IS NOT NULL AND nm <> ''""")
def address_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address lines -> (number, street name, street type, normalised type)."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size").withColumn("addr", F.expr(ADDRESS_LINE))
    a = p.withColumn("ap", address_parts(F.col("addr"))).filter(F.col("ap").isNotNull())
    return a.select(F.col("p_partkey").cast("bigint"), F.col("ap.number").alias("number"),
                    F.col("ap.name").alias("street_name"), F.col("ap.type").alias("street_type"),
                    street_type_norm(F.col("ap.type")).alias("street_type_norm"))
