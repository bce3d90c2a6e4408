"""Fuzzy matching (H13-H20, J4, J5, A2) against pattern examples.

Three modes, chosen by the pattern: ``is_name`` (chunks of the text),
``is_address`` (lines), otherwise words of the lower-cased text.

Plan shape:

    occurrences (doc_id, pattern_id, candidate, start, end)  <- explode per document, no text beside them
    distinct (pattern, candidate) JOIN examples              <- equi-joins on (pattern, key), J4
        native: Levenshtein ratio, n-gram similarity, an upper bound of the score; pairs whose
        bound is under the threshold go (J4); addresses meet by number and street type (J5)
        Arrow UDF: difflib ratio, phonetic score, for the pairs that are left
    best example per (pattern, candidate)  max_by(score, -example_idx)  (first example wins ties)
    occurrences JOIN best ON (pattern_id, candidate)         <- hash join, AQE handles skew
    group per document -> ARRAY of match structs

A candidate (token, chunk, line) repeated across documents is scored once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import exclusive_prefix_sum, let
from ..functions.similarity import (address_parts, levenshtein_ratio, ngram_set, ngram_similarity,
                                    phonetic_similarity, seq_ratio, sound_codes, street_type_norm,
                                    strip_ws, ws_split)
from ..sources.fixed_values import MIN_MATCH_CONFIDENCE, NAME_TITLES

#: A pattern with at most so many examples meets its candidates without further keys.
FEW_EXAMPLES = 64
CHUNK_SEPARATORS = ["\n", ".", ",", ";", ":", "-", " "]


# ---------------------------------------------------------------------------
# occurrences
# ---------------------------------------------------------------------------
def _with_offsets(df: DataFrame, parts: Column) -> DataFrame:
    """Adds ``o``: array of (cand, start) for parts that one separator character stands between."""
    df = df.withColumn("_parts", parts)
    df = df.withColumn("_starts", exclusive_prefix_sum(F.transform("_parts", lambda w: (F.length(w) + 1).cast("bigint"))))
    return df.withColumn("o", F.zip_with("_parts", "_starts", lambda c, s: F.struct(c.alias("cand"), s.alias("start")))) \
             .drop("_parts", "_starts")


def text_chunks(text: Column) -> Column:
    """Separator splits, word 1-3-grams, the whole text when <= 3 words."""
    splits = [F.transform(F.split(text, "\\Q" + sep + "\\E", -1), strip_ws) for sep in CHUNK_SEPARATORS]
    words = ws_split(text)
    grams = F.when(F.size(words) > 0, F.flatten(F.transform(
        F.sequence(F.lit(0), F.size(words) - 1),
        lambda i: F.filter(F.array(*[F.when(i + j <= F.size(words),
                                            F.array_join(F.slice(words, i + 1, j), " ")) for j in (1, 2, 3)]),
                           lambda x: x.isNotNull())))).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.size(words) <= 3, F.array(strip_ws(text))).otherwise(F.array().cast("array<string>"))
    allc = F.array_distinct(F.flatten(F.array(*splits, grams, whole)))
    return F.filter(F.transform(allc, strip_ws), lambda c: c != "")


def occurrences(df: DataFrame, text_col: str, patterns_col: str, row: str = "doc_id") -> DataFrame:
    """(``row``, mode, pattern fields, cand, start, end) for every fuzzy pattern of a document.

    A document's words, chunks and lines are made once for each mode, before its patterns
    are opened, and the text stays behind."""
    text = F.col(text_col)
    fuzzy = lambda p: (p["type"] == "fuzzy") & (F.size(p["examples"]) > 0)
    name = lambda p: F.coalesce(p["is_name"], F.lit(False))
    address = lambda p: ~name(p) & F.coalesce(p["is_address"], F.lit(False))
    slim = lambda p: F.struct(*[p[n].alias(n) for n in
                                ("pattern_id", "pattern_idx", "feature_type", "min_confidence", "examples")])

    def of(mode: str, kind) -> DataFrame:
        pats = F.transform(F.filter(F.col(patterns_col), lambda p: fuzzy(p) & kind(p)), slim)
        base = df.select(row, text.alias("_t"), pats.alias("_pats")).filter(F.size("_pats") > 0)
        if mode == "word":
            base = _with_offsets(base, ws_split(F.lower("_t")))
        elif mode == "address":
            base = _with_offsets(base, F.split("_t", "\n", -1)).withColumn(
                "o", F.transform("o", lambda x: F.struct(strip_ws(x["cand"]).alias("cand"), x["start"].alias("start"))))
        else:
            base = base.withColumn("o", let(F.lower("_t"), lambda low: F.transform(text_chunks(F.col("_t")), lambda c: F.struct(
                c.alias("cand"), (F.instr(low, F.lower(c)) - 1).cast("bigint").alias("start")))))
        return (base.select(row, "_pats", F.explode("o").alias("o"))
                .filter((F.col("o.start") >= 0) & ((F.lit(mode) != "address") | (F.col("o.cand") != "")))
                .select(row, F.explode("_pats").alias("p"), F.col("o.cand").alias("cand"), F.col("o.start").alias("start"))
                .select(row, F.lit(mode).alias("mode"), "p.*", "cand", "start",
                        (F.col("start") + F.length("cand")).alias("end")))

    return (of("word", lambda p: ~name(p) & ~address(p)).unionByName(of("name", name))
            .unionByName(of("address", address)))


# ---------------------------------------------------------------------------
# scores
# ---------------------------------------------------------------------------
def text_confidence(seq: Column, lev: Column, ngram: Column, text: Column, example: Column) -> Column:
    """H14 (inputs bound once)."""
    return let(F.struct(seq.alias("s"), lev.alias("l"), ngram.alias("g"), text.alias("t"), example.alias("e")),
               lambda v: _text_confidence(v["s"], v["l"], v["g"], v["t"], v["e"]))


def _text_confidence(seq: Column, lev: Column, ngram: Column, text: Column, example: Column) -> Column:
    t, e = F.lower(text), F.lower(example)
    s = seq * 0.4 + lev * 0.3 + ngram * 0.3
    present = (F.length(text) > 0) & (F.length(example) > 0)
    s = F.when(present & (t.startswith(e) | e.startswith(t)), F.least(F.lit(1.0), s * 1.3)).otherwise(s)
    s = F.when(present & (F.length(t) >= F.length(e)) & (F.substring(t, 1, F.length(e)) == e),
               F.least(F.lit(1.0), s * 1.2)).otherwise(s)
    s = F.when((seq > 0.8) | (lev > 0.8), F.least(F.lit(1.0), s * 1.2)).otherwise(s)
    return F.when(F.greatest(seq, lev, ngram) < 0.4, s * 0.7).otherwise(s)


def name_confidence(seq: Column, lev: Column, ngram: Column, phon: Column, text: Column, example: Column) -> Column:
    """H13 (inputs bound once)."""
    return let(F.struct(seq.alias("s"), lev.alias("l"), ngram.alias("g"), phon.alias("p"),
                        ws_split(text).alias("tp"), ws_split(example).alias("pp")),
               lambda v: _name_confidence(v["s"], v["l"], v["g"], v["p"], v["tp"], v["pp"]))


def _name_confidence(seq: Column, lev: Column, ngram: Column, phon: Column, tp: Column, pp: Column) -> Column:
    c = seq * 0.25 + lev * 0.15 + ngram * 0.15 + phon * 0.45
    both = (F.size(tp) > 0) & (F.size(pp) > 0)
    c = F.when(both & (F.try_element_at(tp, F.lit(-1)) == F.try_element_at(pp, F.lit(-1))), c * 1.4).otherwise(c)
    titled = F.exists(F.array(*[F.lit(t) for t in NAME_TITLES]),
                      lambda t: F.coalesce(F.try_element_at(tp, F.lit(1)), F.lit("")).contains(t))
    c = F.when(both & (F.size(tp) == 2) & titled, c * 1.3).otherwise(c)
    mx = F.greatest(seq, lev, ngram, phon)
    c = F.when(mx > 0.9, c * 1.2).otherwise(c)
    c = F.when(mx < 0.3, c * 0.8).otherwise(c)
    return F.least(F.lit(1.0), c)


def _examples(occ: DataFrame) -> DataFrame:
    """One row for each example of each pattern."""
    per = occ.groupBy(F.col("pattern_id").alias("e_pattern")).agg(
        F.first("examples").alias("examples"), F.first("min_confidence").alias("min_conf"))
    return per.select("e_pattern", "min_conf", F.posexplode("examples").alias("ex_idx", "example"))


def _seq_bound(a: Column, b: Column) -> Column:
    """No difflib ratio is larger: twice the shorter length over both lengths."""
    x, y = F.length(a), F.length(b)
    return F.when(x + y == 0, F.lit(1.0)).otherwise(2.0 * F.least(x, y) / (x + y))


def _least_ratio(seq_weight: float, lev_weight: float, wanted: Column) -> Column:
    """The least ratio of lengths r at which seq_weight * 2r / (1 + r) + lev_weight * r, the most that
    both ratios can give, reaches what is wanted."""
    b = 2 * seq_weight + lev_weight - wanted
    return F.when(wanted <= 0, F.lit(0.0)).otherwise((-b + F.sqrt(b * b + 4 * lev_weight * wanted)) / (2 * lev_weight))


def _tagged(tag: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(tag), k))


def _first_of(items: Column, share: Column) -> Column:
    """Two sorted sets that have ``share`` of each one's items in common have one of these in common."""
    n = F.size(items)
    return F.slice(items, 1, F.greatest(F.least(n - F.ceil(n * share - 1e-6).cast("int") + 1, n), F.lit(0)))


def _characters(s: Column) -> Column:
    """The characters of a text, repeated ones numbered, in a fixed order."""
    each = F.sort_array(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1))), asc=False)
    numbered = let(each, lambda c: F.transform(c, lambda x, i: F.concat(x, (i - F.array_position(c, x)).cast("string"))))
    return F.when(F.length(s) > 0, numbered).otherwise(F.array().cast("array<string>"))


def _prefixes(s: Column, lengths: Column) -> Column:
    return F.transform(lengths, lambda n: F.substring(s, F.lit(1), n))


def _blocking_keys(mode: str, raw: Column, ratio: Column, prefix_ratio: Column, longest: Column, lengths: Column | None) -> Column:
    """Keys of which two texts that can reach the threshold share one (J4); see ``candidate_pairs``.
    ``lengths``: those of the pattern's examples, for a candidate; null for an example."""
    s, none = F.lower(raw), F.array().cast("array<string>")
    n = F.length(s)
    near = F.when(n * ratio <= longest + 1e-6, _characters(s)).otherwise(none)
    keys = [_tagged("g:", _first_of(F.sort_array(ngram_set(s)), F.lit(0.7))), _tagged("c:", _first_of(near, ratio))]
    if mode == "name":
        last = F.try_element_at(ws_split(raw), F.lit(-1))
        number = address_parts(raw, loose=True)["number"]
        one = lambda tag, k: F.when(k.isNotNull(), F.array(F.concat(F.lit(tag), k))).otherwise(none)
        keys += [one("l:", last), one("n:", number), sound_codes(raw)]
    else:
        fit = lambda x: (x >= prefix_ratio * n - 1e-6) & (x >= 1) & (x <= n)
        whole = F.array(s)
        own = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), fit) if lengths is None else F.filter(lengths, fit)
        mine, others = ("q:", "p:") if lengths is None else ("p:", "q:")
        keys += [_tagged(mine, _prefixes(s, own)), _tagged(others, whole)]
    return F.array_distinct(F.concat(*keys))


def candidate_pairs(keys: DataFrame, examples: DataFrame, mode: str, min_confidence: float) -> DataFrame:
    """(candidate, example) pairs of a pattern that can reach its threshold, by equi-joins on
    (pattern, key).  A superset of the matches, without meeting every example:

    * an n-gram part above 0 means 0.7 of the larger set shared: one of the first trigrams of each
      in sorted order (prefix filter); in names also the same house number;
    * the boosts for a common beginning need one text to begin with the other; that for a last name
      needs the same last word;
    * a phonetic part of more than 0.3 needs a common Soundex or Metaphone code of a word;
    * what is left rests on the difflib and Levenshtein ratios.  Both are bounded by the lengths and
      by the characters in common, so the lengths are within a ratio, and so many characters are
      shared that one of each text's first ones in a fixed order is.

    Patterns of at most FEW_EXAMPLES examples, a threshold of 0 or less, and examples whose lower case has another length, meet everything; a null example matches nothing."""
    t = F.coalesce("min_conf", F.lit(min_confidence))
    if mode == "name":
        ratio, prefix_ratio = _least_ratio(0.25, 0.15, t / (1.3 * 1.2) - 0.45 * 0.3 - 1e-6), F.lit(1.0)
    else:
        ratio, prefix_ratio = (_least_ratio(0.4, 0.3, t / boost - 1e-6) for boost in (1.2, 1.3 * 1.2 * 1.2))
    e, c = F.col("example"), F.col("cand")
    patterns = examples.groupBy("e_pattern").agg(F.first("min_conf").alias("min_conf"),
                                                 F.sort_array(F.collect_set(F.length(F.lower(e)))).alias("lengths"),
                                                 (F.count("*") <= FEW_EXAMPLES).alias("few"))
    left = (keys.filter(F.col("mode") == mode).join(patterns, F.col("pattern_id") == F.col("e_pattern")).drop("e_pattern")
            .withColumn("key", F.explode(F.when(F.col("few"), F.array(F.lit("all"))).otherwise(F.concat(F.array(F.lit("all")), _blocking_keys(
                mode, c, ratio, prefix_ratio, F.coalesce(F.try_element_at("lengths", F.lit(-1)), F.lit(0)), F.col("lengths"))))))
            .drop("lengths", "few"))
    odd = F.col("few") | (t <= 0) | (F.length(F.lower(e)) != F.length(e)) | e.contains("Σ")
    sized = patterns.select(F.col("e_pattern").alias("s_pattern"), "few")
    right = (examples.filter(e.isNotNull()).join(sized, F.col("e_pattern").eqNullSafe(F.col("s_pattern"))).withColumn("e_key", F.explode(F.when(odd, F.array(F.lit("all"))).otherwise(
        _blocking_keys(mode, e, ratio, prefix_ratio, F.length(e), None)))).drop("min_conf", "s_pattern", "few"))
    met = left.join(right, (F.col("pattern_id") == F.col("e_pattern")) & (F.col("key") == F.col("e_key")))
    x, y = F.length(c), F.length(e)
    met = met.filter(~F.col("key").startswith("c:") | (F.least(x, y) >= ratio * F.greatest(x, y) - 1e-6))
    return met.select("mode", "pattern_id", "cand", "min_conf", "ex_idx", "example").distinct()


def _score_word_name(keys: DataFrame, examples: DataFrame, mode: str, min_confidence: float) -> DataFrame:
    """Scores rise with the difflib ratio and the phonetic score, so a pair whose score with
    their upper bounds misses the threshold can't be a match."""
    c, e = F.col("cand"), F.col("example")
    p = (candidate_pairs(keys, examples, mode, min_confidence)
         .withColumn("lev", F.coalesce(levenshtein_ratio(c, e), F.lit(0.0)))
         .withColumn("ngram", ngram_similarity(c, e)))

    def score(seq: Column, phon: Column) -> Column:
        if mode == "name":
            return name_confidence(seq, F.col("lev"), F.col("ngram"), phon, c, e)
        return text_confidence(seq, F.col("lev"), F.col("ngram"), c, e)

    p = p.filter(score(_seq_bound(c, e), F.lit(1.0)) >= F.coalesce("min_conf", F.lit(min_confidence)))
    p = p.withColumn("seq", seq_ratio(c, e))
    if mode == "name":
        p = p.withColumn("phon", phonetic_similarity(c, e))
    return p.withColumn("score", score(F.col("seq"), F.col("phon") if mode == "name" else F.lit(None))).select(
        "mode", "pattern_id", "cand", "min_conf", "ex_idx", "example", "score")


def _with_name_ratio(df: DataFrame) -> DataFrame:
    """difflib ratio of (ca_name, ea_name) per row via ``mapInPandas`` (inputs are plain columns)."""
    from difflib import SequenceMatcher
    from pyspark.sql import types as T
    schema = T.StructType(list(df.schema.fields) + [T.StructField("name_sim", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            pdf["name_sim"] = [SequenceMatcher(None, x.lower(), y.lower()).ratio()
                               for x, y in zip(pdf["ca_name"], pdf["ea_name"])]
            yield pdf
    return df.mapInPandas(run, schema)


def _score_address(keys: DataFrame, examples: DataFrame) -> DataFrame:
    """An equi-join on (pattern, number, normalised type); the name ratio only for its rows."""
    parsed = lambda df, col, pre: (df.withColumn("_a", address_parts(F.col(col))).filter(F.col("_a").isNotNull())
                                   .withColumn(f"{pre}_number", F.col("_a.number")).withColumn(f"{pre}_name", F.col("_a.name"))
                                   .withColumn(f"{pre}_type", street_type_norm(F.col("_a.type"))).drop("_a"))
    a = parsed(keys.filter(F.col("mode") == "address"), "cand", "ca")
    b = parsed(examples, "example", "ea")
    j = a.join(b, (F.col("pattern_id") == F.col("e_pattern")) & (F.col("ca_number") == F.col("ea_number"))
               & (F.col("ca_type") == F.col("ea_type")))
    j = _with_name_ratio(j.select("mode", "pattern_id", "cand", "min_conf", "ex_idx", "example", "ca_name", "ea_name"))
    return (j.filter(F.col("name_sim") >= 0.8)
             .withColumn("score", F.lit(1.0) * 0.4 + F.col("name_sim") * 0.4 + F.lit(1.0) * 0.2)
             .select("mode", "pattern_id", "cand", "min_conf", "ex_idx", "example", "score"))


def best_examples(occ: DataFrame, min_confidence: float = MIN_MATCH_CONFIDENCE) -> DataFrame:
    keys, examples = occ.select("mode", "pattern_id", "cand").distinct(), _examples(occ)
    scored = (_score_word_name(keys, examples, "word", min_confidence)
              .unionByName(_score_word_name(keys, examples, "name", min_confidence))
              .unionByName(_score_address(keys, examples)))
    best = scored.groupBy("mode", "pattern_id", "cand").agg(
        F.max_by(F.struct("score", "example"), F.struct(F.col("score"), (-F.col("ex_idx")).alias("n"))).alias("b"),
        F.first("min_conf").alias("min_conf"))
    thr = F.when(F.col("mode") == "address", F.lit(0.8)).otherwise(F.coalesce("min_conf", F.lit(min_confidence)))
    return best.filter(F.col("b.score") >= thr).select("mode", "pattern_id", "cand",
                                                        F.col("b.score").alias("score"),
                                                        F.col("b.example").alias("example"))


def fuzzy_match_rows(df: DataFrame, text_col: str = "text", patterns_col: str = "patterns",
                     row: str = "doc_id") -> DataFrame:
    occ = occurrences(df, text_col, patterns_col, row)
    if row != "doc_id":  # rows of the same text and patterns have the same occurrences
        occ = occ.distinct()
    best = best_examples(occ)
    j = occ.drop("examples", "min_confidence").join(best, ["mode", "pattern_id", "cand"])
    return j.select(row, F.struct(
        "pattern_id", "pattern_idx", "feature_type", F.lit("partial").alias("match_type"),
        F.col("cand").alias("text"), F.col("start").cast("bigint").alias("start"),
        F.col("end").cast("bigint").alias("end"), F.col("score").alias("confidence"),
        F.create_map().cast("map<string,string>").alias("named_groups"),
        F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("section_type"),
        F.lit(None).cast("int").alias("hierarchy_level")).alias("m"))


def fuzzy_matches(df: DataFrame, text_col: str = "text", patterns_col: str = "patterns",
                  out_col: str = "fuzzy_matches") -> DataFrame:
    """Adds ``out_col``: the document's fuzzy matches (array, any order).  They belong to a text and
    its patterns, so rows without an id, or with one that other texts share, get their own."""
    ids = F.transform(F.col(patterns_col), lambda p: p["pattern_id"])
    df = df.withColumn("_row", F.sha2(F.to_json(F.struct(F.col(text_col).alias("t"), ids.alias("p"))), 256))
    rows = fuzzy_match_rows(df, text_col, patterns_col, "_row")
    per_doc = rows.groupBy("_row").agg(F.collect_list("m").alias(out_col))
    out = df.join(per_doc, "_row", "left").drop("_row")
    return out.withColumn(out_col, F.coalesce(F.col(out_col), F.array().cast(per_doc.schema[out_col].dataType)))
