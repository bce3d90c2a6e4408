"""Stand-in business inputs rendered from the star-schema test tables.

The generated prose holds no invoice, claim or date features, so business
text is rendered from ``orders`` / ``customer`` / ``part`` with SQL
expressions that Spark and DuckDB both accept (only the date formatting
differs and is filled in per dialect).  These functions only lay out input
rows in the schema the jobs expect; none of the jobs' work happens here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import spread, table


def _fmt(dialect: str, col: str, kind: str) -> str:
    spark_fmt = {"iso": "yyyy-MM-dd", "us": "MM/dd/yyyy", "long": "MMM d, yyyy"}
    duck_fmt = {"iso": "%Y-%m-%d", "us": "%m/%d/%Y", "long": "%b %-d, %Y"}
    if dialect == "spark":
        return f"date_format({col}, '{spark_fmt[kind]}')"
    return f"strftime({col}, '{duck_fmt[kind]}')"


def _money(col: str) -> str:
    return f"CAST(CAST({col} AS DECIMAL(18,2)) AS STRING)"


def _nl() -> str:
    return "chr(10)"


def invoice_text_sql(dialect: str) -> str:
    """Invoice text per order: number, customer, date (3 formats), total in
    one of three currencies, optional account line, payment terms."""
    k = "o_orderkey"
    date = (f"CASE {k} % 3 WHEN 0 THEN {_fmt(dialect, 'o_orderdate', 'iso')} "
            f"WHEN 1 THEN {_fmt(dialect, 'o_orderdate', 'us')} "
            f"ELSE {_fmt(dialect, 'o_orderdate', 'long')} END")
    cur = f"CASE {k} % 3 WHEN 0 THEN '$' WHEN 1 THEN '€' ELSE '£' END"
    terms = (f"CASE {k} % 4 WHEN 0 THEN 'Net 30' WHEN 1 THEN 'Net 60' "
             f"WHEN 2 THEN 'Due in 15 days' ELSE 'Due on receipt' END")
    acct = f"CASE WHEN o_custkey % 2 = 0 THEN 'Account Number: ACCT-' || CAST(o_custkey AS STRING) END"
    return (f"concat_ws({_nl()}, 'INVOICE', "
            f"'Invoice Number: INV-2024-' || CAST({k} AS STRING), "
            f"'Bill To: ' || c_name, "
            f"'Date: ' || {date}, "
            f"'Total Amount: ' || {cur} || {_money('o_totalprice')}, "
            f"{acct}, "
            f"'Payment Terms: ' || {terms})")


def invoice_select(dialect: str) -> list[str]:
    return ["o_orderkey AS doc_id", "'financial' AS industry", f"{invoice_text_sql(dialect)} AS text"]


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers, spread before the texts are made."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    return spread(o.join(c, o.o_custkey == c.c_custkey, "left"), o.count())


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (customer_orders(spark, sf_dir)
             .selectExpr(*invoice_select("spark")))


INVOICES_DUCK = ("SELECT " + ", ".join(invoice_select("duck"))
                 + " FROM orders LEFT JOIN customer ON o_custkey = c_custkey")


# ---------------------------------------------------------------------------
# model replies (line-oriented), one per order
# ---------------------------------------------------------------------------
def reply_text_sql(dialect: str) -> str:
    """A reply per order whose type, confidence line and feature lines vary
    with the keys so every parsing rule and scoring branch occurs."""
    k = "o_orderkey"
    bits = f"CAST(FLOOR({k} / 9) AS BIGINT)"
    has = lambda b: f"CAST(FLOOR({bits} / {2 ** b}) AS BIGINT) % 2 = 1"
    dtype = (f"CASE {k} % 9 WHEN 0 THEN 'Invoice' WHEN 1 THEN 'Bill' WHEN 2 THEN 'Medical Claim' "
             f"WHEN 3 THEN 'Property Appraisal Report' WHEN 4 THEN 'Legal Contract' "
             f"WHEN 5 THEN 'Prescription' WHEN 6 THEN 'Bank Statement' "
             f"WHEN 7 THEN 'medical_claim' ELSE 'The Unknown Document' END")
    conf = (f"CASE {k} % 5 WHEN 0 THEN 'Confidence: 0.85' WHEN 1 THEN 'Confidence Score: 0.9' "
            f"WHEN 2 THEN 'Confidence: high' WHEN 3 THEN NULL "
            f"ELSE 'Confidence: 0.' || CAST(10 + {k} % 90 AS STRING) END")
    date = _fmt(dialect, "o_orderdate", "iso")
    money = _money("o_totalprice")
    cur = f"CASE {k} % 4 WHEN 0 THEN '$' WHEN 1 THEN '€' WHEN 2 THEN '£' ELSE '¥' END"
    cpt = f"CAST(90000 + {k} % 9999 AS STRING)"
    lines = [
        "'Here is the analysis:'",
        f"'Document Type: ' || {dtype}",
        conf,
        "'Features:'",
        "'1. Document Information'",
        f"CASE WHEN {has(0)} THEN '- Invoice Number: INV-2024-' || CAST({k} AS STRING) END",
        f"CASE WHEN {has(1)} THEN '- Date: ' || {date} END",
        f"CASE WHEN {has(2)} THEN '- Amount: ' || {cur} || {money} END",
        f"CASE WHEN {has(3)} THEN '- Total Amount: ' || {cur} || {money} || ' (incl. tax $' || CAST({k} % 97 AS STRING) || '.00)' END",
        f"CASE WHEN {has(4)} THEN '- Payment Terms: Net ' || CAST(15 * (1 + {k} % 4) AS STRING) END",
        f"CASE WHEN {has(5)} THEN '- Patient ID: P-' || CAST(o_custkey AS STRING) END",
        f"CASE WHEN {has(6)} THEN 'Service: CPT ' || {cpt} || ' - office visit' END",
        f"CASE WHEN {has(6)} AND {k} % 2 = 0 THEN '- CPT Code: CPT: ' || CAST(91000 + {k} % 7 AS STRING) END",
        f"CASE WHEN {has(7)} THEN '- Diagnosis: ICD-10 E11.' || CAST({k} % 10 AS STRING) END",
        f"CASE WHEN {has(8)} THEN '- Provider: ' || c_name END",
        f"CASE WHEN {has(9)} THEN '- Report ID: RPT-' || CAST({k} AS STRING) END",
        f"CASE WHEN {has(9)} THEN '- Property Address: ' || CAST(1 + {k} % 900 AS STRING) || ' Main Street' END",
        f"CASE WHEN {has(10)} THEN '- Contract ID: CTR-' || CAST({k} AS STRING) END",
        f"CASE WHEN {has(10)} THEN '2. Definitions - terms used' END",
        f"CASE WHEN {has(11)} THEN '- Prescription: Amoxicillin ' || CAST(250 * (1 + {k} % 3) AS STRING) || 'mg' END",
        f"CASE WHEN {has(12)} THEN '- Date/Fecha: ' || {date} END",
        f"CASE WHEN {has(12)} AND {k} % 3 = 0 THEN '- Amount/Monto: ' || {cur} || {money} END",
        f"CASE WHEN {has(13)} THEN '- Account Number: ACCT-' || CAST(o_custkey AS STRING) END",
        f"CASE WHEN {has(13)} THEN '- Medical Code: ICD-10 J45.' || CAST({k} % 10 AS STRING) END",
        f"CASE WHEN {has(14)} THEN '- Due Date: ' || {date} END",
        f"CASE WHEN {has(14)} THEN '- Clause: Termination' END",
        "'Notes: none'",
    ]
    return f"concat_ws({_nl()}, " + ", ".join(lines) + ")"


def reply_industry_sql() -> str:
    return ("CASE o_orderkey % 3 WHEN 0 THEN 'financial' WHEN 1 THEN 'healthcare' "
            "ELSE NULL END")


def reply_select(dialect: str) -> list[str]:
    return ["o_orderkey AS doc_id", f"{reply_industry_sql()} AS industry",
            f"{reply_text_sql(dialect)} AS response"]


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (customer_orders(spark, sf_dir)
             .selectExpr(*reply_select("spark")))


REPLIES_DUCK = ("SELECT " + ", ".join(reply_select("duck"))
                + " FROM orders LEFT JOIN customer ON o_custkey = c_custkey")


def with_duck_ctes(sql: str, **ctes: str) -> str:
    """Prefix an oracle query with rendered-input CTEs."""
    head = ",\n".join(f"{name} AS ({body})" for name, body in ctes.items())
    return f"WITH {head}\n{sql}"


def doc_ids(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("bigint"))


# ---------------------------------------------------------------------------
# feature sightings for the learner, one per event
# ---------------------------------------------------------------------------
def sighting_select(dialect: str) -> list[str]:
    k = ("get_json_object(props, '$.k')" if dialect == "spark"
         else "json_extract_string(props, '$.k')")
    ftype = ("CASE event_type WHEN 'purchase' THEN 'amount' WHEN 'signup' THEN 'date' "
             "WHEN 'click' THEN 'ref_code' WHEN 'view' THEN 'page_ref' ELSE 'error_code' END")
    text = (f"CASE event_type WHEN 'purchase' THEN '$' || {_money('value')} "
            f"WHEN 'signup' THEN {_fmt(dialect, 'ts', 'iso')} "
            f"WHEN 'click' THEN 'REF-' || {k} "
            f"WHEN 'view' THEN 'PAGE ' || CAST(user_id AS STRING) "
            f"ELSE 'E' || {k} END")
    return [f"{ftype} AS feature_type", f"{text} AS text",
            "0.78 + 0.02 * CAST(event_id % 12 AS DOUBLE) AS confidence", "ts", "event_id AS seq"]


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    return ev.selectExpr(*sighting_select("spark"))


SIGHTINGS_DUCK = "SELECT " + ", ".join(sighting_select("duck")) + " FROM events"
