"""Driver contract: entry runs, every oracle has a query, configs scan from JSON."""
import json
import tempfile

import __spark_entry__ as entry
from docsift.sources.configs import (config_tables, config_violations, flatten_industry_json,
                                     industry_listing, read_industry_json, upsert_latest)
from docsift.sources.fixed_values import INDUSTRIES


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "confidence" in df.columns


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 40


def _write_json(cfgs):
    d = tempfile.mkdtemp(prefix="docsift-cfg-")
    for name, c in cfgs.items():
        doc = {"industry_name": name, "version": c["version"], "description": c["description"],
               "features": {"shared": c["shared"] + ["bogus"],
                            "specific": {k: {"type": v["type"], "importance": v["importance"],
                                             "patterns": v["patterns"],
                                             "validation": {"format": v["format"],
                                                            "rules": [{"type": t, "value": val} for t, val in v["rules"]]},
                                             "description": v["description"]}
                                         for k, v in c["specific"].items()},
                            "validation_rules": {"required_features": c["required"],
                                                 "conditional_rules": [{"if": f"document_type == '{dt}'", "then": ids}
                                                                       for dt, ids in c["conditional"]]},
                            "confidence_thresholds": c["thresholds"]}}
        with open(f"{d}/{name}.json", "w") as fh:
            json.dump(doc, fh)
    return d


def test_json_configs(spark):
    d = _write_json(INDUSTRIES)
    cfg = read_industry_json(spark, d)
    tables = flatten_industry_json(cfg, config_tables(spark))
    want = config_tables(spark)
    for name in ("industry_patterns", "industry_rules"):      # shared features bring theirs
        assert (sorted(tuple(r) for r in tables[name].collect())
                == sorted(tuple(r) for r in want[name].select(tables[name].columns).collect())), name
    assert {r.feature_id for r in tables["dropped_shared"].collect()} == {"bogus"}
    listing = {r.industry: r for r in industry_listing(tables).collect()}
    assert listing["financial"].required == ["amount", "date"]
    assert set(listing["healthcare"].specific) == {"patient_id", "medical_code", "provider_npi"}
    assert config_violations(cfg).filter("NOT ok").count() == 0
    cond = {(r.industry, r.doc_type, r.feature_id) for r in tables["industry_conditional"].collect()}
    assert ("financial", "invoice", "payment_terms") in cond


def test_upsert_last_version_wins(spark):
    old = spark.createDataFrame([("fin", "a", "1.0.0", "x"), ("fin", "b", "1.2.0", "y")],
                                "industry string, feature_id string, version string, v string")
    new = spark.createDataFrame([("fin", "a", "1.10.0", "z"), ("fin", "b", "1.1.9", "w")],
                                "industry string, feature_id string, version string, v string")
    got = {r.feature_id: r.v for r in upsert_latest(old.unionByName(new), ["industry", "feature_id"],
                                                    version_col="version").collect()}
    assert got == {"a": "z", "b": "y"}
