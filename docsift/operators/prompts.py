"""Prompt columns and reuse of replies.

The model itself is the caller's: ``answer`` maps a table of distinct prompts to replies, as a
DataFrame function, so that any service that Spark can call fits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .documents import unexpired

TEMPLATE = ("State the document's type, a confidence score from 0 to 1 and its features, one a line "
            "as name: value.\n{features}Document:\n{text}")


def prompt_text(text: Column, feature_names: Column, template: str = TEMPLATE) -> Column:
    """``template`` with the document's text in place of ``{text}`` and, in place of
    ``{features}``, a line with the industry's feature names, or nothing where there are none.  A
    null text counts as empty.  Values are put in as they are, whatever they hold."""
    line = F.when(F.size(feature_names) > 0, F.concat(F.lit("Look for: "), F.array_join(feature_names, ", "), F.lit("\n")))
    values = {"features": F.coalesce(line, F.lit("")), "text": F.coalesce(text, F.lit(""))}
    parts, rest = [], template
    while (at := min((rest.find("{%s}" % n) % (len(rest) + 1), n) for n in values))[0] < len(rest):
        parts += [F.lit(rest[:at[0]]), values[at[1]]]
        rest = rest[at[0] + len(at[1]) + 2:]
    return F.concat(*parts, F.lit(rest))


def replies_for(prompts: DataFrame, memo: DataFrame, answer: Callable[[DataFrame], DataFrame], now: Column,
                ttl_seconds: int, prompt_col: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """A reply for every row of ``prompts``, and the rows to add to the memo.

    ``memo``: prompt_hash, reply, expires_at of earlier replies.  Of an unexpired prompt the reply
    that expires last is used; each other distinct prompt goes to ``answer`` once (prompt_hash and
    prompt in, prompt_hash and reply out).  Texts meet replies by hash, so only hashes are shuffled
    with the memo.  A null prompt has no reply.  The second table is read twice: write it to the
    memo before using both results, or a costly ``answer`` runs for each."""
    hashed = prompts.withColumn("prompt_hash", F.sha2(F.col(prompt_col), 256))
    known = (memo.filter(unexpired(F.col("expires_at"), now)).groupBy("prompt_hash")
             .agg(F.max_by("reply", F.coalesce("expires_at", F.lit("9999-12-31").cast("timestamp"))).alias("reply")))
    open_ = (hashed.filter(F.col("prompt_hash").isNotNull()).join(known.select("prompt_hash"), "prompt_hash", "left_anti")
             .groupBy("prompt_hash").agg(F.any_value(prompt_col).alias("prompt")))
    made = answer(open_).select("prompt_hash", "reply",
                                (now + F.make_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))
    replies = (known.withColumn("reused", F.lit(True))
               .unionByName(made.select("prompt_hash", "reply", F.lit(False).alias("reused"))))
    return hashed.join(replies, "prompt_hash", "left"), made
