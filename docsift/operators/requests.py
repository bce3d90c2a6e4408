"""Request-level helpers: validation (F4), default ids (F5), JSON round trip (S16),
prompt reuse (H54), present-field sets (A10, A11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate_requests(requests: DataFrame, industries: DataFrame, content_col: str = "content",
                      industry_col: str = "industry") -> DataFrame:
    """content present and non-blank; industry (when given) known.  Adds ``error``.

    ``industries`` is the config listing (one row per industry); Spark broadcasts it if it is small."""
    known = industries.select(F.col("industry").alias("_known")).distinct()
    j = requests.join(F.broadcast(known), F.col(industry_col) == F.col("_known"), "left")
    err = (F.when(F.col(content_col).isNull() | ~F.col(content_col).rlike(r"(?U)\S"), F.lit("No content provided"))
           .when(F.col(industry_col).isNotNull() & F.col("_known").isNull(),
                 F.concat(F.lit("Invalid industry: "), F.col(industry_col))))
    return j.withColumn("error", err).drop("_known")


def default_document_id(doc_id: Column, content: Column) -> Column:
    """the given id, else a deterministic id from the content hash (uuid4 is not replayable)."""
    return F.coalesce(doc_id, F.substring(F.sha2(content, 256), 1, 32))


def to_json_column(*cols: str) -> Column:
    """Serialise a result/pattern row to JSON."""
    return F.to_json(F.struct(*cols))


def from_json_column(c: Column, schema) -> Column:
    return F.from_json(c, schema)


def dedup_prompts(prompts: DataFrame, prompt_col: str = "prompt") -> DataFrame:
    """One model call per distinct prompt (hash), joined back by the caller."""
    return (prompts.withColumn("prompt_hash", F.sha2(F.col(prompt_col), 256))
                   .dropDuplicates(["prompt_hash"]))


def present_types(features: Column) -> Column:
    """Distinct feature types of a document, in first-seen order."""
    return F.array_distinct(F.transform(features, lambda f: f["type"]))


def count_type(features: Column, t: str) -> Column:
    return F.size(F.filter(features, lambda f: f["type"] == t))
