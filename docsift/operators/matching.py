"""Regex matching, scoring and overlap resolution over document rows.

Plan shape (map-only, no shuffle of document text):

    documents ──(broadcast hash joins on industry)── pattern arrays per industry
        └─ per row: matches of all patterns but blank ones (F3), with offsets and flags, as one
           flat array that names a pattern by its place   [Arrow batches, ``re``]
              └─ score (H2), drop low matches (F2)            [JVM]
              └─ sort by (start, -confidence, pattern order, ...) and fold (T1, A9)

Patterns are stored in Python syntax and matched with ``re.finditer``: Spark's regex
functions give neither offsets nor all groups of all matches, Java's syntax differs
(``{,n}``, ``&&`` in classes, line ends), and a pattern may match the empty string.  One
pass over a batch gives every match and the flags that scoring needs, so the cost grows
with the text and the number of matches.

The pattern side is one row per industry with that industry's patterns as an array.
Broadcasts are bounded: a larger pattern table is joined in several parts of at most
``BROADCAST_PATTERNS`` rows, one after the other.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.regex import regex_profile
from ..sources.fixed_values import MIN_MATCH_CONFIDENCE

#: Pattern rows of one broadcast at most.
BROADCAST_PATTERNS = 20000

RAW_MATCH = T.StructType([
    T.StructField("at", T.IntegerType()),        # place of the pattern in the row's array
    T.StructField("text", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("named", T.ArrayType(T.StringType())),
    T.StructField("n_named", T.IntegerType()),
    T.StructField("word", T.BooleanType()),      # letters, digits and _ only
    T.StructField("marks", T.BooleanType()),     # holds something else than word characters and space
    T.StructField("bounded", T.BooleanType()),   # no letter or digit right before or after it
    T.StructField("whole", T.BooleanType()),     # the whole text but for space around it
    T.StructField("confidence", T.DoubleType()), # null where ``score_regex_match`` is to give it
])

PATTERN_FIELDS = ["pattern_id", "pattern_idx", "type", "feature_type", "expression",
                  "n_groups", "named_idx", "named_names",
                  "confidence_value", "allow_inefficient", "min_confidence", "is_name",
                  "is_address", "examples", "expected_section", "semantic_concepts",
                  "context_weights"]


# --------------------------------------------------------------------------
# pattern table
# --------------------------------------------------------------------------
def prepare_patterns(patterns: DataFrame) -> DataFrame:
    """Profile (F10/F11) and keep usable patterns.  The table is small."""
    p = patterns
    for name, dtype, default in [
        ("confidence_value", "double", 1.0), ("allow_inefficient", "boolean", False),
        ("min_confidence", "double", None), ("is_name", "boolean", False),
        ("is_address", "boolean", False), ("expected_section", "string", None),
    ]:
        if name not in p.columns:
            p = p.withColumn(name, F.lit(default).cast(dtype))
    if "examples" not in p.columns:
        p = p.withColumn("examples", F.array().cast("array<string>"))
    if "semantic_concepts" not in p.columns:
        p = p.withColumn("semantic_concepts", F.lit(None).cast("array<string>"))
    if "context_weights" not in p.columns:
        p = p.withColumn("context_weights", F.lit(None).cast("map<string,double>"))
    p = p.withColumn("confidence_value", F.coalesce("confidence_value", F.lit(1.0)))
    p = p.withColumn("allow_inefficient", F.coalesce("allow_inefficient", F.lit(False)))
    prof = regex_profile(F.col("expression"), F.col("allow_inefficient"))
    p = p.withColumn("_prof", prof)
    regex_like = F.col("type").isin("regex", "learned", "context")
    p = (p.withColumn("n_groups", F.col("_prof.n_groups"))
          .withColumn("named_idx", F.col("_prof.named_idx"))
          .withColumn("named_names", F.col("_prof.named_names"))
          .withColumn("is_valid", F.when(regex_like, F.col("_prof.is_valid")).otherwise(F.lit(True)))
          .withColumn("lint_issues", F.col("_prof.lint_issues"))
          .drop("_prof"))
    return p


def _in_order() -> Column:
    """The rows' patterns as an array in store order."""
    return F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in PATTERN_FIELDS])), _by_index)


def _by_index(a: Column, b: Column) -> Column:
    return (F.when(a["pattern_idx"] < b["pattern_idx"], -1).when(a["pattern_idx"] > b["pattern_idx"], 1)
            .when(a["pattern_id"] < b["pattern_id"], -1).when(a["pattern_id"] > b["pattern_id"], 1).otherwise(0))


def patterns_by_industry(patterns: DataFrame) -> DataFrame:
    """One row per industry: array of usable patterns in store order."""
    return (patterns.filter(F.col("is_valid") & F.col("industry").isNotNull())
            .groupBy("industry").agg(_in_order().alias("patterns")))


def attach_patterns(docs: DataFrame, patterns: DataFrame, no_industry: str = "none",
                    broadcast_patterns: int = BROADCAST_PATTERNS) -> DataFrame:
    """J1 (+J2): give each document the pattern array of its industry.

    ``no_industry='all'`` gives documents without an industry every pattern (feature
    extraction); ``'none'`` gives them none (hybrid classification).  Only rows without
    an industry meet the array of all patterns.
    """
    parts = -(-patterns.count() // broadcast_patterns) or 1
    out, names = docs, []
    for i in range(parts):
        part = patterns if parts == 1 else patterns.filter(F.pmod(F.xxhash64("pattern_id"), F.lit(parts)) == i)
        side = patterns_by_industry(part)
        if no_industry == "all":
            every = part.filter("is_valid").agg(_in_order().alias("patterns"))
            side = side.unionByName(every.select(F.lit(None).cast("string").alias("industry"), "patterns"))
        names.append(f"_patterns_{i}")
        side = side.select(F.col("industry").alias("_industry"), F.col("patterns").alias(names[-1]))
        out = out.join(F.broadcast(side), out["industry"].eqNullSafe(side["_industry"]), "left").drop("_industry")
    none = F.array().cast(side.schema[names[-1]].dataType)
    arrays = [F.coalesce(F.col(n), none) for n in names]
    merged = arrays[0] if parts == 1 else F.array_sort(F.concat(*arrays), _by_index)
    return out.withColumn("patterns", merged).drop(*names)


# --------------------------------------------------------------------------
# raw matches (H1)
# --------------------------------------------------------------------------
_WORD, _MARK = re.compile(r"\w+\n?\Z"), re.compile(r"[^\w\s]")


@lru_cache(maxsize=4096)
def _compiled(expr: str) -> tuple[re.Pattern, tuple[int, ...]] | None:
    try:
        rx = re.compile(expr)
    except re.error:
        return None
    return rx, tuple(sorted(rx.groupindex.values()))


def _bounds(t: str) -> tuple[int, int]:
    """Where the text begins and ends but for space around it."""
    lead = len(t) - len(t.lstrip())
    return lead, lead + len(t.strip())


def _facts(rx: re.Pattern, named: tuple[int, ...], t: str, lead: int, tail: int) -> list[tuple]:
    out = []
    for m in rx.finditer(t):
        x = m.group()
        if not x or x.isspace():
            continue
        s, end = m.span()
        groups = [(m.group(i) or "").strip() for i in named] if named else ()
        word = x.isalnum() or _WORD.match(x) is not None
        out.append((x, s, end, groups, sum(map(bool, groups)) if groups else 0, word, not word and _MARK.search(x) is not None,
                    not (s > 0 and t[s - 1].isalnum() or end < len(t) and t[end].isalnum()), s == lead and end == tail))
    return out


def match_facts(expr: str | None, t: str):
    """The non-overlapping matches of an expression that aren't blank (F3), as the fields of RAW_MATCH
    after the place; none of one that is null or doesn't compile.  An expression may match the empty
    string at every place of a text, so blank ones are left out before anything is made of them."""
    found = _compiled(expr) if expr is not None else None
    return _facts(*found, t, *_bounds(t)) if found is not None else []


def match_score(confidence_value: float, n_groups: int, allow_inefficient: bool, facts: tuple) -> float:
    """H2 for one match, from the facts that the matcher finds.  ``score_regex_match`` gives the same
    number, but for the last bit of some powers of 0.9."""
    text, _, _, _, n_named, word, marks, bounded, whole = facts
    c = (confidence_value * 0.3 + min(1.0, len(text) / 10) * 0.15 + min(1.0, n_groups / 3) * 0.1
         + 0.9 ** n_named * 0.2 + (1.0 if bounded else 0.8) * 0.15 + (1.0 if word else 0.8) * 0.1)
    if word and bounded:
        c = min(1.0, c * 1.2)
    if whole:
        c = min(1.0, c * 1.1)
    if len(text) < 3 and not word:
        c *= 0.8
    if marks:
        c *= 0.9
    return c * 0.85 if allow_inefficient else c


def _row_keys(lists: pa.Array):
    """For each row's list (of strings or numbers) a key that equals that of an equal list."""
    values, starts = lists.values, lists.offsets.to_pylist()
    if values.null_count:
        return (None if v is None else tuple(v) for v in lists.to_pylist())
    first, buffers, n = values.offset, values.buffers(), len(values)
    data = buffers[-1].to_pybytes() if buffers[-1] else b""
    if len(buffers) == 2:
        width = values.type.bit_width // 8
        return (data[(first + a) * width:(first + b) * width] for a, b in pairwise(starts))
    kind = np.int64 if pa.types.is_large_string(values.type) else np.int32
    ends = np.frombuffer(buffers[1], kind)[first:first + n + 1] if n else np.zeros(1, kind)
    sizes, at = np.diff(ends).astype(np.int64).tobytes(), ends[starts].tolist()
    return ((sizes[a * 8:b * 8], data[c:d]) for (a, b), (c, d) in zip(pairwise(starts), pairwise(at)))


def _pattern_sets(wanted: tuple[str, ...], *fields: pa.Array):
    """For each row its patterns of the wanted types: those that differ in what a match is made of, each
    once and compiled, and (place, number of that one) in order; null for a null list.  The rows of an
    industry hold the same patterns, so they are read once a batch; industries share features, so all
    their patterns together repeat many."""
    known: dict[tuple, tuple[list, list]] = {}
    for i, (valid, *key) in enumerate(zip(fields[0].is_valid().to_pylist(), *map(_row_keys, fields))):
        if not valid:
            yield None
            continue
        if (key := tuple(key)) not in known:
            numbers: dict[tuple, int] = {}
            usable, places = [], []
            for at, (kind, expr, *own) in enumerate(zip(*(f[i].as_py() for f in fields))):
                found = _compiled(expr) if kind in wanted and expr is not None else None
                if found is None:
                    continue
                number = numbers.setdefault((expr, *own), len(usable))
                if number == len(usable):
                    usable.append((*found, own, {}))
                places.append((at, number))
            known[key] = usable, places
        yield known[key]


def _scan(wanted: tuple[str, ...], min_confidence: float, text: pa.Array, *fields: pa.Array) -> pa.Array:
    rows: list[tuple] = []
    ends: list[int | None] = []
    for t, patterns in zip(text.to_pylist(), _pattern_sets(wanted, *fields)):
        ends.append(None if patterns is None else len(rows))
        if t is None or not patterns:
            continue
        usable, places = patterns
        lead, tail = _bounds(t)
        found = []
        for rx, named, own, scores in usable:
            matches = []
            for facts in _facts(rx, named, t, lead, tail):
                key = (min(len(facts[0]), 10), *facts[4:])  # all that a score is made of
                if key not in scores:
                    scores[key] = None if facts[4] or None in own else match_score(*own, facts)
                c = scores[key]
                if c is None or not c < min_confidence:
                    matches.append((*facts, c))
            found.append(matches)
        for at, number in places:
            if found[number]:
                rows += [(at, *m) for m in found[number]]
    ends.append(len(rows))
    types = {"at": pa.int32(), "text": pa.string(), "start": pa.int64(), "end": pa.int64(), "named": pa.list_(pa.string()),
             "n_named": pa.int32(), "confidence": pa.float64()}
    names = [f.name for f in RAW_MATCH.fields]
    cols = zip(*rows) if rows else [()] * len(names)
    struct = pa.StructArray.from_arrays([pa.array(v, types.get(n, pa.bool_())) for n, v in zip(names, cols)], names=names)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)


def scan(wanted: tuple[str, ...], min_confidence: float):
    """Arrow function of a text and its patterns' types, expressions and what else a score needs: the
    matches (``match_facts``) of the patterns of the wanted types, in the order of the patterns.  A null
    text, a null expression and one that doesn't compile have none.  Matches without named groups are
    scored here (H2, F2), the others by ``score_regex_match``: its powers of 0.9 are Java's."""
    @F.arrow_udf(T.ArrayType(RAW_MATCH))
    def matches(text: pa.Array, types: pa.Array, exprs: pa.Array, confidence_value: pa.Array, n_groups: pa.Array,
                allow_inefficient: pa.Array) -> pa.Array:
        return _scan(wanted, min_confidence, text, types, exprs, confidence_value, n_groups, allow_inefficient)
    # so that the optimizer doesn't copy the call into filters, where it would run again
    return matches.asNondeterministic()


def with_scan(df: DataFrame, text_col: str, patterns_col: str, types: tuple[str, ...], min_confidence: float, out: str) -> DataFrame:
    """Adds ``out``: raw matches of the patterns of these types, in the order of the patterns."""
    p = F.col(patterns_col)
    return df.withColumn(out, scan(types, min_confidence)(F.col(text_col), p["type"], p["expression"], p["confidence_value"],
                                                          p["n_groups"], p["allow_inefficient"].cast("array<tinyint>")))


# --------------------------------------------------------------------------
# scoring (H2) and filters
# --------------------------------------------------------------------------
def score_regex_match(raw: Column, p: Column) -> Column:
    """Confidence of one regex match; returns the finished match struct."""
    n = F.length(raw["text"]).cast("double")
    word, bounded = raw["word"], raw["bounded"]
    base = (p["confidence_value"] * 0.3
            + F.least(F.lit(1.0), n / 10) * 0.15
            + F.least(F.lit(1.0), p["n_groups"].cast("double") / 3) * 0.1
            + F.pow(F.lit(0.9), raw["n_named"].cast("double")) * 0.2
            + F.when(bounded, F.lit(1.0)).otherwise(F.lit(0.8)) * 0.15
            + F.when(word, F.lit(1.0)).otherwise(F.lit(0.8)) * 0.1)
    c = F.when(word & bounded, F.least(F.lit(1.0), base * 1.2)).otherwise(base)
    c = F.when(raw["whole"], F.least(F.lit(1.0), c * 1.1)).otherwise(c)
    c = F.when((n < 3) & ~word, c * 0.8).otherwise(c)
    c = F.when(raw["marks"], c * 0.9).otherwise(c)
    c = F.coalesce(raw["confidence"], F.when(p["allow_inefficient"], c * 0.85).otherwise(c))
    none = F.create_map().cast("map<string,string>")
    named = F.when(raw["n_named"] > 0, F.map_from_entries(F.filter(
        F.arrays_zip(p["named_names"].alias("k"), raw["named"].alias("v")), lambda e: e["v"] != ""))).otherwise(none)
    return F.struct(
        p["pattern_id"].alias("pattern_id"), p["pattern_idx"].alias("pattern_idx"),
        p["feature_type"].alias("feature_type"), F.lit("exact").alias("match_type"),
        raw["text"].alias("text"), raw["start"].alias("start"), raw["end"].alias("end"),
        c.alias("confidence"), named.alias("named_groups"),
        F.lit(None).cast("string").alias("section"),
        F.lit(None).cast("string").alias("section_type"),
        F.lit(None).cast("int").alias("hierarchy_level"),
    )


def scored(raw: Column, patterns: Column, min_confidence: float) -> Column:
    """H2, F2 (threshold) for raw matches, of which ``scan`` gives no blank ones."""
    matches = F.transform(raw, lambda r: score_regex_match(r, F.get(patterns, r["at"])))
    return F.filter(matches, lambda m: m["confidence"] >= min_confidence)


def regex_matches(df: DataFrame, text_col: str = "text", patterns_col: str = "patterns",
                  min_confidence: float = MIN_MATCH_CONFIDENCE, out_col: str = "regex_matches") -> DataFrame:
    """H1+H2+H3+F2+F3 for regex/learned patterns in ``patterns_col``."""
    df = with_scan(df, text_col, patterns_col, ("regex", "learned"), min_confidence, "_scan")
    return df.withColumn(out_col, scored(F.col("_scan"), F.col(patterns_col), min_confidence)).drop("_scan")


# --------------------------------------------------------------------------
# overlap resolution
# --------------------------------------------------------------------------
def list_rows(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's list begins and ends in the values of all rows, from 0 on (a null list has
    none), and the row of each value."""
    sizes = pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), np.repeat(np.arange(len(arr)), sizes)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _kept(start: pa.Array, end: pa.Array, confidence: pa.Array, pattern_idx: pa.Array, text: pa.Array) -> pa.Array:
    """Places of the matches that the left-to-right fold keeps.  The fold's order: start, then
    confidence (high first), pattern order, length (long first), text."""
    bounds, row = list_rows(start)
    starts, scores, orders, texts = (a.flatten() for a in (start, confidence, pattern_idx, text))
    numbers = lambda a: a.to_numpy(zero_copy_only=False)
    order = np.lexsort((numbers(pc.rank(texts, tiebreaker="min")), -numbers(pc.utf8_length(texts)).astype(np.int64),
                        numbers(pc.fill_null(orders, 0)), numbers(orders.is_valid()), -numbers(scores), numbers(starts), row))
    starts, ends, scores = (numbers(a)[order].tolist() for a in (starts, end.flatten(), scores))
    out: list[int] = []
    firsts = [0]
    for a, b in pairwise(bounds.tolist()):
        last = -1
        for i in range(a, b):
            if last < 0 or starts[i] >= ends[last]:
                out.append(i)
                last = i
            elif scores[i] > scores[last]:
                out[-1] = last = i
        firsts.append(len(out))
    kept = order[out]
    return pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(kept - bounds[row[kept]], pa.int32()))


_kept_once = _kept.asNondeterministic()


def resolve_overlaps(df: DataFrame, matches: Column, out_col: str) -> DataFrame:
    """Greedy left-to-right resolution: keep a match that starts at or after the
    last kept end; otherwise let it replace the last kept one only when it is
    strictly more confident.  Adds ``out_col``; linear in the matches after the sort."""
    df = df.withColumn("_all", matches)
    df = df.withColumn("_kept", _kept_once(*(F.col("_all")[f] for f in ("start", "end", "confidence", "pattern_idx", "text"))))
    return df.withColumn(out_col, F.transform("_kept", lambda i: F.col("_all")[i])).drop("_all", "_kept")


def find_matches(df: DataFrame, text_col: str = "text", patterns_col: str = "patterns",
                 min_confidence: float = MIN_MATCH_CONFIDENCE, context_col: str | None = None,
                 fuzzy: bool = True) -> DataFrame:
    """H4: regex + learned (+ fuzzy, + context when a context column is given),
    threshold, then overlap resolution.  Adds ``matches``."""
    df = regex_matches(df, text_col, patterns_col, min_confidence)
    parts = [F.col("regex_matches")]
    drop = ["regex_matches"]
    if fuzzy:
        from .fuzzy import fuzzy_matches
        df = fuzzy_matches(df, text_col, patterns_col, out_col="fuzzy_matches")
        parts.append(F.filter("fuzzy_matches", lambda m: m["confidence"] >= min_confidence))
        drop.append("fuzzy_matches")
    if context_col is not None:
        from .context import context_matches
        df = context_matches(df, text_col, patterns_col, context_col, min_confidence,
                             out_col="context_matches")
        parts.append(F.col("context_matches"))
        drop.append("context_matches")
    allm = F.concat(*parts) if len(parts) > 1 else parts[0]
    return resolve_overlaps(df, allm, "matches").drop(*drop)


def pattern_confidence(df: DataFrame, matches_col: str = "matches") -> DataFrame:
    """A1: mean match confidence and match count per document (in-row, no shuffle)."""
    ms = F.col(matches_col)
    total = F.aggregate(ms, F.lit(0.0), lambda a, m: a + m["confidence"])
    return (df.withColumn("pattern_count", F.size(ms).cast("bigint"))
              .withColumn("pattern_confidence",
                          F.when(F.size(ms) > 0, total / F.size(ms))))
