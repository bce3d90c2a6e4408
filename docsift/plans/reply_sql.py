"""DuckDB oracle CTEs for reply parsing and scoring (relational formulation)."""

from __future__ import annotations

from ..sources.configs import config_rows
from ..sources.fixed_values import (DOC_TYPE_BANK_STATEMENT, DOC_TYPE_INVOICE, DOC_TYPE_PRESCRIPTION,
                                    DOC_TYPE_UNKNOWN, FEATURE_KEY_MAP, FINANCIAL_SIGNALS,
                                    MEDICAL_SIGNALS)
from ..sources.render import REPLIES_DUCK
from .registry import sql_str, values_sql

STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _strip(x: str) -> str:
    return STRIP.format(x=x)


def _inlist(items: list[str]) -> str:
    return "(" + ", ".join(sql_str(i) for i in items) + ")"


def normalize_sql(x: str) -> str:
    d = f"lower({_strip(x)})"
    rest = f"regexp_replace(regexp_replace({d}, '^(a |an |the |medical )', ''), ' (document|doc|form)$', '')"
    rest = f"regexp_replace({_strip(rest)}, '\\s+', '_', 'g')"
    return (f"CASE WHEN {d} IN {_inlist(DOC_TYPE_UNKNOWN)} THEN 'unknown' "
            f"WHEN {d} IN {_inlist(DOC_TYPE_BANK_STATEMENT)} THEN 'bank_statement' "
            f"WHEN {d} IN {_inlist(DOC_TYPE_INVOICE)} THEN 'invoice' "
            f"WHEN {d} IN {_inlist(DOC_TYPE_PRESCRIPTION)} THEN 'prescription' ELSE {rest} END")


FEAT_RX = "'^-\\s*([^:]+):\\s*(.*)'"


def parse_ctes(replies_sql: str = REPLIES_DUCK) -> str:
    """CTEs: replies, lines, cl (classified lines), keymap, lf (line features),
    feats (doc_id, ord, type, value, vals), hdr (doc_id, doc_type, reply_confidence, multilingual)."""
    keymap = values_sql(sorted(FEATURE_KEY_MAP.items()), ["k", "mapped"])
    return f"""
replies AS ({replies_sql}),
lines AS (
  SELECT doc_id, industry, unnest(string_split(response, chr(10))) AS raw,
         generate_subscripts(string_split(response, chr(10)), 1) AS li
  FROM replies),
st AS (SELECT doc_id, industry, li, {_strip('raw')} AS s FROM lines),
cl AS (
  SELECT doc_id, industry, li, s, lower(s) AS low,
    CASE WHEN s = '' THEN NULL
         WHEN contains(lower(s), 'document type:') THEN 'doctype'
         WHEN contains(lower(s), 'confidence score:') OR starts_with(lower(s), 'confidence:') THEN 'conf'
         WHEN regexp_matches(s, '^\\d+\\.') THEN 'section'
         WHEN regexp_matches(s, 'CPT:?\\s*\\d{{5}}') THEN 'cpt'
         WHEN regexp_matches(s, {FEAT_RX}) THEN 'feature' END AS kind,
    {_strip("substr(s, instr(s, ':') + 1)")} AS after_colon,
    contains(s, '/') AND (contains(lower(s), 'date/fecha') OR contains(lower(s), 'amount/monto')
                          OR contains(lower(s), 'invoice/factura')) AS ml
  FROM st),
keymap AS ({keymap}),
fl AS (
  SELECT c.doc_id, c.li, k.mapped, lower({_strip(f"regexp_extract(c.s, {FEAT_RX}, 1)")}) AS raw_key,
         {_strip(f"regexp_extract(c.s, {FEAT_RX}, 2)")} AS fval
  FROM cl c LEFT JOIN keymap k ON k.k = lower({_strip(f"regexp_extract(c.s, {FEAT_RX}, 1)")})
  WHERE c.kind = 'feature'),
fl2 AS (SELECT *, replace(raw_key, ' ', '_') AS orig FROM fl),
lf AS (
  SELECT doc_id, li, 0 AS sub, orig AS type, fval AS value FROM fl2
  UNION ALL
  SELECT doc_id, li, 1 AS sub, mapped AS type, fval AS value FROM fl2
   WHERE mapped IS NOT NULL AND mapped <> orig
  UNION ALL
  SELECT doc_id, li, 1 + generate_subscripts(a, 1) AS sub, 'amount' AS type, unnest(a) AS value
  FROM (SELECT doc_id, li, regexp_extract_all(fval, '[€£$¥₿]\\s?\\d+[\\d,.]*') AS a FROM fl2
        WHERE (mapped IS NOT NULL AND (starts_with(mapped, 'item_') OR contains(mapped, 'amount')))
              OR contains(orig, 'amount'))),
cpt AS (SELECT doc_id, list(regexp_extract(s, 'CPT:?\\s*(\\d{{5}})', 1) ORDER BY li) AS codes
        FROM cl WHERE kind = 'cpt' GROUP BY doc_id),
sec AS (SELECT doc_id, list({_strip("regexp_extract(s, '^\\d+\\.\\s*(.*?)(?:\\s*-|$)', 1)")} ORDER BY li) AS secs
        FROM cl WHERE kind = 'section' GROUP BY doc_id),
feats AS (
  SELECT lf.doc_id, lf.li * 1000 + lf.sub AS ord, lf.type, lf.value, [lf.value] AS vals FROM lf
  WHERE NOT (lf.type = 'cpt_code' AND lf.doc_id IN (SELECT doc_id FROM cpt))
  UNION ALL
  SELECT doc_id, 1000000000 AS ord, 'cpt_code', array_to_string(codes, ', '), codes FROM cpt
  UNION ALL
  SELECT doc_id, 1000000001 AS ord, 'section', secs[1], secs FROM sec),
hdr AS (
  SELECT r.doc_id, r.industry,
    (SELECT {normalize_sql('c.after_colon')} FROM cl c WHERE c.doc_id = r.doc_id AND c.kind = 'doctype'
     ORDER BY c.li DESC LIMIT 1) AS doc_type,
    (SELECT coalesce(TRY_CAST(c.after_colon AS DOUBLE), 0.5::DOUBLE) FROM cl c
     WHERE c.doc_id = r.doc_id AND c.kind = 'conf' ORDER BY c.li DESC LIMIT 1) AS reply_confidence,
    coalesce((SELECT bool_or(c.ml) FROM cl c WHERE c.doc_id = r.doc_id), false) AS multilingual
  FROM replies r)"""


def _miss(items: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN list_contains(present, {sql_str(i)}) THEN 0 ELSE 1 END"
                            for i in items) + ")"


def rubric_ctes() -> str:
    """CTEs pres (doc_id, present, n_amount) and rub (hdr + present + confidence)."""
    inv = """CASE WHEN list_contains(present, 'amount') THEN
        CASE WHEN multilingual THEN least(1.0::DOUBLE, c4 + 0.15::DOUBLE) ELSE c4 END
      ELSE 0.5::DOUBLE - 0.2::DOUBLE END"""
    return f"""
pres AS (
  SELECT h.*, coalesce(p.present, []) AS present, coalesce(p.n_amount, 0) AS n_amount
  FROM hdr h LEFT JOIN (SELECT doc_id, list(DISTINCT type) AS present,
                               count(*) FILTER (WHERE type = 'amount') AS n_amount
                        FROM feats GROUP BY doc_id) p ON h.doc_id = p.doc_id),
inv1 AS (SELECT *, CASE WHEN n_amount > 1 THEN least(1.0::DOUBLE, 0.7::DOUBLE + 0.1::DOUBLE) ELSE 0.7::DOUBLE END AS c1 FROM pres),
inv2 AS (SELECT *, CASE WHEN list_contains(present, 'invoice_number') THEN least(1.0::DOUBLE, c1 + 0.15::DOUBLE) ELSE c1 END AS c2 FROM inv1),
inv3 AS (SELECT *, CASE WHEN list_contains(present, 'date') THEN least(1.0::DOUBLE, c2 + 0.1::DOUBLE) ELSE c2 END AS c3 FROM inv2),
inv4 AS (SELECT *, CASE WHEN len(present) = 2 AND list_contains(present, 'amount') AND list_contains(present, 'invoice_number')
                        THEN least(c3, 0.8::DOUBLE) ELSE c3 END AS c4 FROM inv3),
rub AS (
  SELECT doc_id, industry, doc_type, reply_confidence, multilingual, present, n_amount,
    coalesce(CASE doc_type
      WHEN 'invoice' THEN {inv}
      WHEN 'property_appraisal_report' THEN CASE WHEN {_miss(['report_id', 'date', 'property_address', 'amount'])} = 0
           THEN 0.9::DOUBLE ELSE 0.7::DOUBLE - 0.1::DOUBLE * {_miss(['report_id', 'date', 'property_address', 'amount'])} END
      WHEN 'legal_contract' THEN CASE WHEN {_miss(['contract_id', 'date'])} = 0
                                       AND (list_contains(present, 'section') OR list_contains(present, 'clause')) THEN 0.9::DOUBLE
           WHEN list_contains(present, 'section') OR list_contains(present, 'clause') THEN 0.5::DOUBLE + 0.1::DOUBLE
           ELSE 0.5::DOUBLE END
      WHEN 'claim' THEN CASE WHEN {_miss(['date', 'cpt_code', 'diagnosis', 'provider'])} = 0 THEN 0.9::DOUBLE
           ELSE 0.7::DOUBLE - 0.1::DOUBLE * {_miss(['date', 'cpt_code', 'diagnosis', 'provider'])} END
      WHEN 'prescription' THEN CASE
           WHEN len(list_filter(present, lambda t: contains(t, 'patient'))) > 0
                AND (list_contains(present, 'prescription') OR list_contains(present, 'rx')) THEN 0.8::DOUBLE
           WHEN len(list_filter(present, lambda t: contains(t, 'patient'))) > 0
                OR list_contains(present, 'prescription') OR list_contains(present, 'rx') THEN 0.6::DOUBLE
           ELSE reply_confidence END
      ELSE reply_confidence END, 0.5::DOUBLE) AS confidence
  FROM inv4)"""


def industry_ctes() -> str:
    """CTEs req (industry, required) and adj (industry chain for in-scope rows)."""
    rows = config_rows()["industry_required"]
    ordered = [(ind, fid, i) for i, (ind, fid) in enumerate(rows)]
    med = _inlist(MEDICAL_SIGNALS)
    fin = _inlist(FINANCIAL_SIGNALS)
    return f"""
reqrows AS ({values_sql(ordered, ['industry', 'feature_id', 'pos'])}),
req AS (SELECT industry, list(feature_id ORDER BY pos) AS required FROM reqrows GROUP BY industry),
sig AS (SELECT doc_id, bool_or(type IN {med}) AS medical, bool_or(type IN {fin}) AS financial
        FROM feats GROUP BY doc_id),
a0 AS (
  SELECT r.*, q.required,
         list_filter(q.required, lambda x: NOT list_contains(r.present, x)) AS missing,
         coalesce(s.medical, false) AS medical, coalesce(s.financial, false) AS financial
  FROM rub r JOIN req q ON r.industry = q.industry LEFT JOIN sig s ON r.doc_id = s.doc_id
  WHERE r.doc_type IS NULL OR r.doc_type <> 'unknown'),
a1 AS (SELECT *, CASE WHEN len(missing) > 0 THEN greatest(0.8::DOUBLE, confidence - 0.1::DOUBLE * least(2, len(missing))) ELSE confidence END AS k1 FROM a0),
a2 AS (SELECT *, CASE WHEN medical AND financial THEN greatest(0.7::DOUBLE, k1 - 0.2::DOUBLE) ELSE k1 END AS k2 FROM a1),
a3 AS (SELECT *, CASE WHEN len(missing) > len(required) // 2 THEN least(k2 * 0.8::DOUBLE, 0.7::DOUBLE) ELSE k2 END AS k3 FROM a2),
a4 AS (SELECT *, CASE WHEN industry = 'healthcare' AND NOT medical THEN least(k3 * 0.8::DOUBLE, 0.7::DOUBLE)
                      WHEN industry = 'financial' AND NOT financial THEN least(k3 * 0.8::DOUBLE, 0.7::DOUBLE)
                      ELSE k3 END AS k4 FROM a3),
a5 AS (SELECT *, CASE WHEN len(missing) = 0 THEN least(1.0::DOUBLE, k4 * 1.2::DOUBLE) ELSE k4 END AS k5 FROM a4),
adj AS (SELECT *, CASE WHEN len(present) = 2 AND list_contains(present, 'amount') AND list_contains(present, 'invoice_number')
                       THEN least(k5, 0.8::DOUBLE) ELSE k5 END AS final_confidence FROM a5)"""
