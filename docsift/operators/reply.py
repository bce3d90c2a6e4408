"""Model-reply parsing (H29-H33), one row per reply.

``parse_replies`` adds to each row:

* ``doc_type``      - normalised type from the last "document type:" line
* ``reply_confidence`` - the last confidence line (unparsable -> 0.5), or null
* ``multilingual``  - a line with '/' and a bilingual key pair
* ``features``      - ARRAY<STRUCT<type, value, values, present>> in reply order:
  line features (original key, mapped key, currency amounts), then the CPT
  aggregate (which replaces single cpt_code features), then the section list.

No shuffle: the lines of a reply are read once, in Arrow batches (array lambdas over lines
are interpreted, and filters on a parsed column would repeat them); what is one value for
each reply (type, confidence) is native.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.fixed_values import (CPT_LINE_REGEX, CURRENCY_AMOUNT_REGEX, DOC_TYPE_BANK_STATEMENT,
                                    DOC_TYPE_INVOICE, DOC_TYPE_PREFIX_REGEX, DOC_TYPE_PRESCRIPTION,
                                    DOC_TYPE_SUFFIX_REGEX, DOC_TYPE_UNKNOWN, FEATURE_KEY_MAP,
                                    MULTILINGUAL_PAIRS, SECTION_LINE_REGEX)

FEATURE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("values", T.ArrayType(T.StringType())),
    T.StructField("present", T.BooleanType()),
])
FEATURES = T.ArrayType(FEATURE)

def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def feature(type_: Column, value: Column, values: Column | None = None) -> Column:
    return F.struct(type_.alias("type"), value.alias("value"),
                    (values if values is not None else F.array(value)).alias("values"),
                    F.lit(True).alias("present"))


def normalize_doc_type(c: Column) -> Column:
    """H33."""
    d = F.lower(strip_ws(c))
    rest = F.regexp_replace(d, DOC_TYPE_PREFIX_REGEX, "")
    rest = F.regexp_replace(rest, DOC_TYPE_SUFFIX_REGEX, "")
    rest = F.regexp_replace(strip_ws(rest), r"(?U)\s+", "_")
    return (F.when(d.isin(*DOC_TYPE_UNKNOWN), F.lit("unknown"))
            .when(d.isin(*DOC_TYPE_BANK_STATEMENT), F.lit("bank_statement"))
            .when(d.isin(*DOC_TYPE_INVOICE), F.lit("invoice"))
            .when(d.isin(*DOC_TYPE_PRESCRIPTION), F.lit("prescription"))
            .otherwise(rest))


#: White space as the other steps trim it; the class stands for ``\\s``, whose set in ``re`` is larger.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _rule(expr: str) -> re.Pattern:
    return re.compile(expr.replace(r"\s", f"[{_SPACE}]"))


_SECTION, _SECTION_TITLE = _rule(r"\d+\."), _rule(SECTION_LINE_REGEX)
_CPT, _AMOUNT = _rule(CPT_LINE_REGEX), _rule(CURRENCY_AMOUNT_REGEX)


@lru_cache(maxsize=4096)
def _feature_types(key: str) -> tuple[str, str | None, bool]:
    """Of a feature line's key: original key, mapped key (null if the same), whether amounts are read."""
    own, mapped = key.replace(" ", "_"), FEATURE_KEY_MAP.get(key)
    amounts = "amount" in own or mapped is not None and (mapped.startswith("item_") or "amount" in mapped)
    return own, mapped if mapped != own else None, amounts


def read_reply(text: str) -> tuple[str | None, str | None, bool, list[str], list[str], list[list[str]]]:
    """Text of the last type line and of the last confidence line, multilingual flag, features: their
    types, their values, and the value lists of the last ones (the others' lists hold their value
    alone).  Of a line, the first rule that fires wins."""
    doc_text = conf_text = None
    types, values, cpts, sections = [], [], [], []
    lower = text.lower()
    multilingual = "/" in text and any("/" in low and any(pair in low for pair in MULTILINGUAL_PAIRS) for low in lower.split("\n"))
    for line, low in zip(text.split("\n"), lower.split("\n")):
        s = line.strip(_SPACE)
        if not s:
            continue
        start = s[0]
        if "document type:" in low:
            doc_text = s.partition(":")[2].strip(_SPACE)
        elif "confidence" in low and ("confidence score:" in low or s.lower().startswith("confidence:")):
            conf_text = s.partition(":")[2].strip(_SPACE)
        elif start.isdigit() and _SECTION.match(s):
            sections.append(_SECTION_TITLE.match(s)[1].strip(_SPACE))
        elif "CPT" in s and (found := _CPT.search(s)):
            cpts.append(found[1])
        elif start == "-":
            key, colon, value = s[1:].partition(":")
            if not colon or not key:
                continue
            own, mapped, amounts = _feature_types(key.strip(_SPACE).lower())
            value = value.strip(_SPACE)
            types.append(own)
            values.append(value)
            if mapped is not None:
                types.append(mapped)
                values.append(value)
            if amounts and (found := _AMOUNT.findall(value)):
                types += ["amount"] * len(found)
                values += found
    last = []
    if cpts:
        if "cpt_code" in types:
            values = [v for t, v in zip(types, values) if t != "cpt_code"]
            types = [t for t in types if t != "cpt_code"]
        types.append("cpt_code")
        values.append(", ".join(cpts))
        last.append(cpts)
    if sections:
        types.append("section")
        values.append(sections[0])
        last.append(sections)
    return doc_text, conf_text, multilingual, types, values, last


@F.arrow_udf(T.StructType([T.StructField("doc_text", T.StringType()), T.StructField("conf_text", T.StringType()),
                           T.StructField("multilingual", T.BooleanType()), T.StructField("features", FEATURES)]))
def _read(response: pa.Array) -> pa.Array:
    # flat columns: a tuple and a list for each feature cost more than the parse
    doc_text, conf_text, multilingual, starts, sizes = [], [], [], [], []
    types, values, listed = [], [], []
    for t in response.to_pylist():
        doc, conf, flag, own, vals, last = read_reply(t) if t is not None else (None, None, None, [], [], [])
        doc_text.append(doc)
        conf_text.append(conf)
        multilingual.append(flag)
        starts.append(None if flag is None else len(types))
        types += own
        values += vals
        single = len(vals) - len(last)
        listed += vals[:single]
        sizes += [1] * single
        for several in last:
            listed += several
            sizes.append(len(several))
    starts.append(len(types))
    ends = pa.array([0, *accumulate(sizes)], pa.int32())
    struct = pa.StructArray.from_arrays(
        [pa.array(types, pa.string()), pa.array(values, pa.string()),
         pa.ListArray.from_arrays(ends, pa.array(listed, pa.string())),
         pa.array([True] * len(types), pa.bool_())], names=["type", "value", "values", "present"])
    return pa.StructArray.from_arrays(
        [pa.array(doc_text, pa.string()), pa.array(conf_text, pa.string()), pa.array(multilingual, pa.bool_()),
         pa.ListArray.from_arrays(pa.array(starts, pa.int32()), struct)], names=["doc_text", "conf_text", "multilingual", "features"])


#: Marked so that the optimizer doesn't copy the call into filters, where every reply would be read again.
_read_once = _read.asNondeterministic()


def parse_replies(df: DataFrame, response_col: str = "response") -> DataFrame:
    r = F.col("_reply")
    return (df.withColumn("_reply", _read_once(F.col(response_col)))
              .withColumn("doc_type", F.when(r["doc_text"].isNotNull(), normalize_doc_type(r["doc_text"])))
              .withColumn("reply_confidence", F.when(r["conf_text"].isNotNull(),
                                                     F.coalesce(r["conf_text"].try_cast("double"), F.lit(0.5))))
              .withColumn("multilingual", r["multilingual"])
              .withColumn("features", r["features"])
              .drop("_reply"))
