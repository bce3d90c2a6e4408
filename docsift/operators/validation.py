"""Feature-value validation rules (F13) and pattern-quality metrics."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

@F.pandas_udf(T.BooleanType())
def _regex_ok(value: pd.Series, expr: pd.Series) -> pd.Series:
    """Whether the value matches from its start, by the syntax rules are written in."""
    def ok(v, e):
        try:
            return None if v is None or e is None else re.match(e, v) is not None
        except re.error:
            return False
    return pd.Series([ok(v, e) for v, e in zip(value, expr)], dtype="object")


def evaluate_rules(feats: DataFrame, rules: DataFrame) -> DataFrame:
    """feats(industry, feature_type, feature_value, ...) x rules(industry, feature_id, rule_type, rule_value).

    ``regex``: the value matches; ``length``: its length is within min and max; ``range``: it is a
    number within min and max; ``enum``: it is one of a JSON array of strings.  A bound that isn't
    given doesn't limit; a null value gives null; other rule types pass.  The rules are a
    configuration table, which is broadcast: by key, a rule's values would meet in one task.
    """
    side = rules.withColumnRenamed("industry", "_rule_industry")
    j = feats.join(F.broadcast(side), (F.col("industry") == F.col("_rule_industry")) & (F.col("feature_type") == F.col("feature_id"))) \
             .drop("_rule_industry")
    value, kind = F.col("feature_value"), F.col("rule_type")
    low, high = (F.get_json_object("rule_value", f"$.{k}").try_cast("double") for k in ("min", "max"))

    def within(x: Column) -> Column:
        return x.isNotNull() & F.coalesce(x >= low, F.lit(True)) & F.coalesce(x <= high, F.lit(True))

    number = F.regexp_replace(value, r"[,$\s]", "").try_cast("double")
    options = F.from_json("rule_value", "array<string>")
    ok = (F.when(kind == "regex", _regex_ok(F.when(kind == "regex", value), F.when(kind == "regex", F.col("rule_value"))))
          .when(value.isNull(), F.lit(None).cast("boolean"))
          .when(kind == "length", within(F.length(value).cast("double")))
          .when(kind == "range", within(number))
          .when(kind == "enum", F.coalesce(F.array_contains(options, value), F.lit(False)))
          .otherwise(F.lit(True)))
    return j.withColumn("rule_ok", ok)


def confusion_metrics(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall, F1 and the pattern confidence 0.4p + 0.4r + 0.2f1.

    Zero denominators give 0.  Python rounds half-to-even (``bround``)."""
    tp, fp, fn = tp.cast("double"), fp.cast("double"), fn.cast("double")
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * (p * r) / (p + r)).otherwise(F.lit(0.0))
    return {"precision": F.bround(p, 3), "recall": F.bround(r, 3), "f1": F.bround(f1, 3),
            "pattern_confidence": F.bround(p * 0.4 + r * 0.4 + f1 * 0.2, 3)}
