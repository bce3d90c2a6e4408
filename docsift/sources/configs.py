"""Industry configuration as tables (S9-S11, J10, U6) and the pattern table.

The shipped configurations live in ``fixed_values``; JSON files in the same
layout are read with ``spark.read.json`` (S9).  Either way the result is a set
of small flat tables that jobs broadcast-join:

    industry_features   (industry, version, feature_id, scope, type, importance, description, format)
    industry_patterns   (industry, feature_id, pattern_idx, expression)
    industry_rules      (industry, feature_id, rule_type, rule_value)
    industry_required   (industry, feature_id)
    industry_conditional(industry, doc_type, feature_id)
    industry_thresholds (industry, minimum, high)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed_values import BASE_FEATURES, INDUSTRIES

SCHEMAS = {
    "industry_features": "industry string, version string, feature_id string, scope string, "
                         "type string, importance string, description string, format string",
    "industry_patterns": "industry string, feature_id string, pattern_idx int, expression string",
    "industry_rules": "industry string, feature_id string, rule_type string, rule_value string",
    "industry_required": "industry string, feature_id string",
    "industry_conditional": "industry string, doc_type string, feature_id string",
    "industry_thresholds": "industry string, minimum double, high double",
    "base_features": "feature_id string, type string, description string",
    "base_patterns": "feature_id string, pattern_idx int, expression string",
    "base_rules": "feature_id string, rule_type string, rule_value string",
}


def _feature_defs(industry: str, cfg: dict):
    """Shared ids resolved against base features (unknown ids dropped), then specific."""
    for fid in cfg["shared"]:
        if fid in BASE_FEATURES:
            yield fid, "shared", BASE_FEATURES[fid], None, None
    for fid, spec in cfg["specific"].items():
        yield fid, "specific", spec, spec.get("importance"), spec.get("format")


def config_rows(industries: dict | None = None) -> dict[str, list[tuple]]:
    industries = INDUSTRIES if industries is None else industries
    rows: dict[str, list[tuple]] = {k: [] for k in SCHEMAS}
    for fid, spec in BASE_FEATURES.items():
        rows["base_features"].append((fid, spec["type"], spec["description"]))
        rows["base_patterns"] += [(fid, i, expr) for i, expr in enumerate(spec["patterns"])]
        rows["base_rules"] += [(fid, rtype, rval) for rtype, rval in spec.get("rules", [])]
    for ind, cfg in industries.items():
        for fid, scope, spec, importance, fmt in _feature_defs(ind, cfg):
            rows["industry_features"].append((ind, cfg["version"], fid, scope, spec["type"],
                                              importance, spec["description"], fmt))
            for i, expr in enumerate(spec["patterns"]):
                rows["industry_patterns"].append((ind, fid, i, expr))
            for rtype, rval in spec.get("rules", []):
                rows["industry_rules"].append((ind, fid, rtype, rval))
        for fid in cfg["required"]:
            rows["industry_required"].append((ind, fid))
        for doc_type, fids in cfg.get("conditional", []):
            for fid in fids:
                rows["industry_conditional"].append((ind, doc_type, fid))
        rows["industry_thresholds"].append((ind, cfg["thresholds"]["minimum"], cfg["thresholds"]["high"]))
    return rows


def config_tables(spark: SparkSession, industries: dict | None = None) -> dict[str, DataFrame]:
    rows = config_rows(industries)
    return {name: spark.createDataFrame(rows[name], SCHEMAS[name]) for name in SCHEMAS}


def pattern_rows(industries: dict | None = None, only: list[str] | None = None) -> list[tuple]:
    """Regex pattern rows derived from the configuration, in store order."""
    industries = INDUSTRIES if industries is None else industries
    out, idx = [], 0
    for ind, cfg in industries.items():
        if only is not None and ind not in only:
            continue
        for fid, _scope, spec, _imp, _fmt in _feature_defs(ind, cfg):
            for i, expr in enumerate(spec["patterns"]):
                out.append((f"{ind}.{fid}.{i}", idx, "regex", expr, fid, ind))
                idx += 1
    return out


PATTERN_SCHEMA = "pattern_id string, pattern_idx int, type string, expression string, " \
                 "feature_type string, industry string"


def config_patterns(spark: SparkSession, only: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame(pattern_rows(only=only), PATTERN_SCHEMA)


# ---------------------------------------------------------------------------
# Scan industry JSON files
# ---------------------------------------------------------------------------
RULE = T.StructType([T.StructField("type", T.StringType()),
                     T.StructField("value", T.StringType())])
SPEC = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("importance", T.StringType()),
    T.StructField("patterns", T.ArrayType(T.StringType())),
    T.StructField("validation", T.StructType([T.StructField("format", T.StringType()),
                                              T.StructField("rules", T.ArrayType(RULE))])),
    T.StructField("description", T.StringType()),
])
INDUSTRY_JSON = T.StructType([
    T.StructField("industry_name", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("features", T.StructType([
        T.StructField("shared", T.ArrayType(T.StringType())),
        T.StructField("specific", T.MapType(T.StringType(), SPEC)),
        T.StructField("validation_rules", T.StructType([
            T.StructField("required_features", T.ArrayType(T.StringType())),
            T.StructField("conditional_rules", T.ArrayType(T.StructType([
                T.StructField("if", T.StringType()),
                T.StructField("then", T.ArrayType(T.StringType()))]))),
        ])),
        T.StructField("confidence_thresholds", T.StructType([
            T.StructField("minimum", T.DoubleType()), T.StructField("high", T.DoubleType())])),
    ])),
])


def read_industry_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per industry file; industry = file stem (as the listing does)."""
    df = (spark.read.schema(INDUSTRY_JSON).option("multiLine", True).json(path)
          .withColumn("_file", F.input_file_name()))
    return df.withColumn("industry", F.regexp_extract("_file", r"([^/]+)\.json$", 1)).drop("_file")


def flatten_industry_json(cfg: DataFrame, base: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Flatten scanned configs into the config tables.  Shared ids bring the patterns and rules
    of their base features; unknown ones are dropped and listed (J10)."""
    f = F.col("features")
    specific = cfg.select("industry", "version", F.explode(f["specific"]).alias("feature_id", "spec"))
    shared_ids = cfg.select("industry", "version", F.posexplode(f["shared"]).alias("pos", "feature_id"))
    shared = shared_ids.join(base["base_features"], "feature_id", "inner")
    dropped = shared_ids.join(base["base_features"], "feature_id", "left_anti")
    features = (shared.select("industry", "version", "feature_id", F.lit("shared").alias("scope"),
                              "type", F.lit(None).cast("string").alias("importance"),
                              "description", F.lit(None).cast("string").alias("format"))
                .unionByName(specific.select(
                    "industry", "version", "feature_id", F.lit("specific").alias("scope"),
                    F.col("spec.type").alias("type"), F.col("spec.importance").alias("importance"),
                    F.col("spec.description").alias("description"),
                    F.col("spec.validation.format").alias("format"))))
    rules = specific.select("industry", "feature_id",
                            F.explode("spec.validation.rules").alias("r")).select(
        "industry", "feature_id", F.col("r.type").alias("rule_type"), F.col("r.value").alias("rule_value"))
    patterns = specific.select("industry", "feature_id",
                               F.posexplode("spec.patterns").alias("pattern_idx", "expression"))
    named = shared_ids.select("industry", "feature_id").distinct()
    rules = named.join(base["base_rules"], "feature_id").select(rules.columns).unionByName(rules)
    patterns = named.join(base["base_patterns"], "feature_id").select(patterns.columns).unionByName(patterns)
    required = cfg.select("industry", F.explode(f["validation_rules"]["required_features"]).alias("feature_id"))
    cond = cfg.select("industry", F.explode(f["validation_rules"]["conditional_rules"]).alias("c"))
    conditional = cond.select(
        "industry",
        F.regexp_extract("c.if", r"document_type\s*==\s*'([^']+)'", 1).alias("doc_type"),
        F.explode("c.then").alias("feature_id"))
    thresholds = cfg.select("industry", f["confidence_thresholds"]["minimum"].alias("minimum"),
                            f["confidence_thresholds"]["high"].alias("high"))
    return {"industry_features": features, "industry_patterns": patterns,
            "industry_rules": rules, "industry_required": required,
            "industry_conditional": conditional, "industry_thresholds": thresholds,
            "dropped_shared": dropped.select("industry", "feature_id")}


def industry_listing(tables: dict[str, DataFrame]) -> DataFrame:
    """Name, shared ids, specific {id: description}, required, thresholds."""
    feats = tables["industry_features"]
    agg = feats.groupBy("industry").agg(
        F.array_sort(F.collect_set(F.when(F.col("scope") == "shared", F.col("feature_id")))).alias("shared"),
        F.map_from_entries(F.collect_list(F.when(F.col("scope") == "specific",
                                                 F.struct("feature_id", "description")))).alias("specific"))
    req = tables["industry_required"].groupBy("industry").agg(
        F.array_sort(F.collect_list("feature_id")).alias("required"))
    return (agg.join(req, "industry", "left")
               .join(tables["industry_thresholds"], "industry", "left"))


def upsert_latest(df: DataFrame, keys: list[str], order_cols: list[str] | None = None,
                  version_col: str | None = None) -> DataFrame:
    """Last version wins per key.

    ``max_by`` over an ordering struct (semantic version parts compared
    numerically, then ``order_cols``) is partially aggregated, so a key with
    very many versions is combined map-side instead of sorted in one task.
    Upsert = ``upsert_latest(old.unionByName(new), ...)``."""
    order = []
    if version_col is not None:
        parts = F.split(F.col(version_col), r"\.")
        order += [F.coalesce(F.try_element_at(parts, F.lit(i + 1)).cast("int"), F.lit(0)).alias(f"_v{i}")
                  for i in range(3)]
    order += [F.col(c) for c in (order_cols or [])]
    payload = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
              .agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_latest"),
                   F.count("*").alias("n_versions"))
              .select(*keys, "_latest.*", "n_versions"))


def newest_first(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """All versions of each key with ``seq``, 1 for the newest.  One key's versions are
    numbered together; to list only the newest, use ``upsert_latest``."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order_cols])
    return df.withColumn("seq", F.row_number().over(w).cast("bigint"))


def delete_with_cascade(parent: DataFrame, children: list[DataFrame], deleted: DataFrame,
                        key: str = "pattern_id") -> tuple[DataFrame, list[DataFrame]]:
    """delete = anti join on the key, cascaded to child tables."""
    return (parent.join(deleted, key, "left_anti"),
            [c.join(deleted, key, "left_anti") for c in children])


def config_violations(cfg: DataFrame) -> DataFrame:
    """one boolean per schema rule on scanned configs; rows that fail any."""
    f = F.col("features")
    semver = F.col("version").rlike(r"^\d+\.\d+\.\d+$")
    has_required = (F.col("industry_name").isNotNull() & F.col("version").isNotNull()
                    & F.col("description").isNotNull() & f.isNotNull())
    specs = F.map_values(f["specific"])
    importance_ok = F.forall(F.coalesce(specs, F.array()),
                             lambda s: s["importance"].isin("required", "recommended", "optional"))
    rule_types_ok = F.forall(F.coalesce(specs, F.array()), lambda s: F.forall(
        F.coalesce(s["validation"]["rules"], F.array()),
        lambda r: r["type"].isin("regex", "length", "range", "enum")))
    th = f["confidence_thresholds"]
    thresholds_ok = (th["minimum"].between(0, 1) & th["high"].between(0, 1))
    out = cfg.select("industry",
                     has_required.alias("has_required_keys"), semver.alias("semver_ok"),
                     importance_ok.alias("importance_ok"), rule_types_ok.alias("rule_types_ok"),
                     F.coalesce(thresholds_ok, F.lit(False)).alias("thresholds_ok"))
    ok = (F.col("has_required_keys") & F.col("semver_ok") & F.col("importance_ok")
          & F.col("rule_types_ok") & F.col("thresholds_ok"))
    return out.withColumn("ok", F.coalesce(ok, F.lit(False)))
