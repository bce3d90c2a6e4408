"""Regex helpers: pattern lint and profile, and small column helpers.

Patterns are written in Python ``re`` syntax, and matched with it (see
``operators/matching.py``).  Each pattern is profiled once, on the pattern table:

* ``is_valid``      - compiles and passes the lint rules (F10)
* ``n_groups``      - number of capturing groups
* ``named_idx``     - group numbers of the named groups, ``named_names`` their names
"""

from __future__ import annotations

import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NON_BLANK = r"(?U)\S"

PROFILE_SCHEMA = T.StructType([
    T.StructField("is_valid", T.BooleanType()),
    T.StructField("lint_issues", T.ArrayType(T.StringType())),
    T.StructField("n_groups", T.IntegerType()),
    T.StructField("named_idx", T.ArrayType(T.IntegerType())),
    T.StructField("named_names", T.ArrayType(T.StringType())),
])

_ESCAPE = re.compile(r"\\.", re.S)
_CLASS = re.compile(r"\[([^\]]*)\]")


def lint_issues(expr: str, allow_inefficient: bool = False) -> list[str]:
    """What the store rejects in a pattern: brackets inside or outside of a character class
    that don't pair, parentheses that don't (those in a class count too), wasteful wildcards."""
    plain = _ESCAPE.sub("", expr)
    outside = _CLASS.sub("", plain)
    level = list(accumulate(1 if c == "(" else -1 for c in plain if c in "()"))
    wild = not allow_inefficient
    rules = {
        "bracket inside a character class": any("[" in body for body in _CLASS.findall(plain)),
        "brackets don't pair": "[" in outside or "]" in outside,
        "parentheses don't pair": bool(level) and (min(level) < 0 or level[-1] != 0),
        "wildcards in a row": wild and ".*.*" in expr,
        "over three wildcards": wild and expr.count("*") > 3,
        "wildcards at both ends": wild and expr.startswith(".*") and expr.endswith(".*"),
    }
    return [issue for issue, found in rules.items() if found]


def profile(expr: str | None, allow_inefficient: bool = False) -> dict:
    try:
        compiled = re.compile(expr)
    except (re.error, TypeError) as exc:
        issue = "missing expression" if expr is None else f"does not compile: {exc}"
        return dict(is_valid=False, lint_issues=[issue], n_groups=0, named_idx=[], named_names=[])
    issues = lint_issues(expr, bool(allow_inefficient))
    named = sorted(compiled.groupindex.items(), key=lambda kv: kv[1])
    return dict(is_valid=(not issues) or bool(allow_inefficient), lint_issues=issues, n_groups=compiled.groups,
                named_idx=[i for _, i in named], named_names=[n for n, _ in named])


@F.pandas_udf(PROFILE_SCHEMA)
def regex_profile(expr: pd.Series, allow_inefficient: pd.Series) -> pd.DataFrame:
    """Arrow UDF over the pattern table (tens to thousands of rows)."""
    rows = [profile(e, bool(a) if a is not None else False)
            for e, a in zip(expr, allow_inefficient)]
    return pd.DataFrame(rows, columns=[f.name for f in PROFILE_SCHEMA.fields])


@F.arrow_udf(T.ArrayType(T.LongType()))
def exclusive_prefix_sum(arr):
    """[x0, x1, ...] -> [0, x0, x0 + x1, ...] as BIGINT, in one pass over the batch."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(arr.flatten().to_numpy(zero_copy_only=False).astype(np.int64))])
    first = np.concatenate([[0], np.cumsum(sizes)])
    sums = total[:-1] - np.repeat(total[first[:-1]], sizes)
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(sums, pa.int64()))


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body`` (lambda bodies get no
    common-subexpression elimination, so repeated references would recompute)."""
    return F.transform(F.array(value), body)[0]
