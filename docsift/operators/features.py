"""Feature union and de-duplication (H44, U1, W1) inside each document row.

Model features and pattern features are concatenated (model first) and
de-duplicated by (type, value) the way a dict keyed by (type, value) would:
a key keeps the position of its first occurrence and the payload of its last.
Per-document feature lists are short, so this stays an in-row step; the dict itself runs in
Arrow batches, since array lambdas are interpreted element by element.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .matching import list_rows


def pattern_features(matches: Column) -> Column:
    return F.transform(matches, lambda m: F.struct(
        m["feature_type"].alias("type"), m["text"].alias("value"), F.lit("pattern").alias("source"),
        m["start"].alias("start"), m["end"].alias("end"), m["confidence"].alias("confidence")))


def model_features(features: Column) -> Column:
    return F.transform(features, lambda f: F.struct(
        f["type"].alias("type"), f["value"].alias("value"), F.lit("model").alias("source"),
        F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"),
        F.lit(None).cast("double").alias("confidence")))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _places(types: pa.Array, values: pa.Array) -> pa.Array:
    """The last place of each (type, value), in the order of their first places."""
    bounds, row = list_rows(types)
    codes = [a.flatten().dictionary_encode("encode").indices.to_numpy() for a in (types, values)]
    order = np.lexsort((*codes, row))  # stable: equal keys stay in their order
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = np.any([k[order][1:] != k[order][:-1] for k in (*codes, row)], axis=0)
    firsts, lasts = order[new[:-1]], order[new[1:]]
    kept = lasts[np.argsort(firsts)]
    ends = np.searchsorted(row[kept], np.arange(len(types) + 1)).tolist()
    places = pa.array(kept - bounds[row[kept]], pa.int32())
    nulls = types.is_null().to_pylist()
    return pa.ListArray.from_arrays(pa.array([None if n else e for n, e in zip([*nulls, False], ends)], pa.int32()), places)


_places_once = _places.asNondeterministic()


def dedup_by_key(arr: Column) -> Column:
    """One element for each (type, value), nulls counting as values; ``arr`` is read twice, so a
    column that holds it is cheaper than the expression that makes it."""
    return F.transform(_places_once(arr["type"], arr["value"]), lambda i: F.get(arr, i))


def dedup_features(df: DataFrame, model_col: str = "features",
                   pattern_col: str = "pattern_features", out_col: str = "merged_features") -> DataFrame:
    both = F.concat(model_features(F.coalesce(F.col(model_col), F.array())),
                    F.coalesce(F.col(pattern_col), F.array()))
    return df.withColumn("_both", both).withColumn(out_col, dedup_by_key(F.col("_both"))).drop("_both")
