"""DuckDB SQL for the operators that SQL can express, by plain relational steps."""

_REACH = """
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, low) AS (
  SELECT a, b FROM both_ways UNION SELECT w.a, r.low FROM both_ways w JOIN reach r ON w.b = r.node),
component AS (SELECT node, min(low) AS low FROM reach GROUP BY node)"""

#: op5: all pairs of usable vectors.
EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
         coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, FALSE) AS usable
  FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE usable),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id > y.vec_id AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.95),""" + _REACH + """,
many AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT v.vec_id::BIGINT AS vec_id, coalesce(m.n, 0)::BIGINT AS n_links,
       least(v.vec_id, coalesce(c.low, v.vec_id))::BIGINT AS component_id,
       v.vec_id = least(v.vec_id, coalesce(c.low, v.vec_id)) AS kept
FROM v LEFT JOIN many m ON v.vec_id = m.a LEFT JOIN component c ON v.vec_id = c.node"""

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: op7: intersections by joining equal shingles of documents whose set sizes allow a link.
MINHASH_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS s FROM w, unnest(generate_series(1, len(ws) - 1)) t(i) WHERE len(ws) > 1
  UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
sized AS (SELECT sh.doc_id, s, n FROM sh JOIN n ON sh.doc_id = n.doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM sized x JOIN sized y
    ON x.s = y.s AND x.doc_id > y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),""" + _REACH + """
SELECT w.doc_id::BIGINT AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
       least(w.doc_id, coalesce(c.low, w.doc_id))::BIGINT AS component_id,
       w.doc_id = least(w.doc_id, coalesce(c.low, w.doc_id)) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN component c ON w.doc_id = c.node"""

#: op10: every window with the smallest document it starts in.
SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
windows AS (SELECT doc_id, i, list_slice(ws, i, i + 12) AS g FROM w, unnest(generate_series(1, len(ws) - 12)) t(i) WHERE len(ws) >= 13),
firsts AS (SELECT g, min(doc_id) AS low FROM windows GROUP BY g),
again AS (SELECT x.doc_id, x.i FROM windows x JOIN firsts f ON x.g = f.g WHERE f.low < x.doc_id),
gone AS (SELECT DISTINCT doc_id, j FROM again, unnest(generate_series(i, i + 12)) t(j)),
one AS (SELECT doc_id, j, ws[j] AS word FROM w, unnest(generate_series(1, len(ws))) t(j)),
sums AS (
  SELECT o.doc_id, count(*) AS n, count(g.j) AS r, string_agg(o.word, ' ' ORDER BY o.j) FILTER (WHERE g.j IS NULL) AS kept
  FROM one o LEFT JOIN gone g ON o.doc_id = g.doc_id AND o.j = g.j GROUP BY o.doc_id)
SELECT w.doc_id::BIGINT AS doc_id, coalesce(s.n, 0)::BIGINT AS n_words, coalesce(s.r, 0)::BIGINT AS n_removed,
       sha256(coalesce(s.kept, '')) AS kept_sha256
FROM w LEFT JOIN sums s ON w.doc_id = s.doc_id"""


def centroids(k: int, rounds: int, dim: int, scale: int, seed: str) -> str:
    """op13: every round as a step of its own; distances and sums in integers."""
    dot = "list_dot_product"
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
far{n} AS MATERIALIZED (
  SELECT v.rid, {dot}(v.x, v.x) + {dot}(c.x, c.x) - 2 * {dot}(v.x, c.x) AS d, c.i FROM kept v CROSS JOIN c{n} c),
near{n} AS MATERIALIZED (SELECT rid, (min((d::BIGINT, i))) AS best FROM far{n} GROUP BY rid),
at{n} AS MATERIALIZED (SELECT rid, best[1]::BIGINT AS distance, best[2]::INT AS i FROM near{n})""")
        if n < rounds:
            steps.append(f"""
sum{n} AS MATERIALIZED (
  SELECT a.i, p, sum(v.x[p]::BIGINT) AS s, count(*)::HUGEINT AS m FROM at{n} a JOIN kept v ON a.rid = v.rid, unnest(generate_series(1, {dim})) t(p)
  GROUP BY a.i, p),
moved{n} AS MATERIALIZED (SELECT i, list(((s - ((s % m) + m) % m) // m)::DOUBLE ORDER BY p) AS x FROM sum{n} GROUP BY i),
c{n + 1} AS MATERIALIZED (SELECT c.i, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN moved{n} m ON c.i = m.i)""")
    return f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, e, list_transform(e, lambda c: floor({scale} * c)) AS x FROM v
  WHERE len(e) = {dim} AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), e) - 1)::INT AS i, x FROM kept WHERE vec_id IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), e) <= {k}),{",".join(steps)},
inertias AS (SELECT i, sum(distance)::BIGINT AS s FROM at{rounds} GROUP BY i)
SELECT k.vec_id::BIGINT AS vec_id, a.i AS cluster, a.distance, n.s AS cluster_inertia, (SELECT sum(s) FROM inertias)::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c.x, lambda y: y::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM kept k JOIN at{rounds} a ON k.rid = a.rid JOIN c{rounds} c ON a.i = c.i JOIN inertias n ON a.i = n.i"""


def collocations(longest: int, least: int, percent: int, top: int) -> str:
    """op12: all phrases of all orders, counted outright."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cuts = " UNION ALL ".join(f"SELECT {k} AS k" for k in range(1, longest))
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
word AS (SELECT pid, lang, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
ahead AS (
  SELECT lang, list(word) OVER (PARTITION BY pid ORDER BY i ROWS BETWEEN CURRENT ROW AND {longest - 1} FOLLOWING) AS g FROM word),
phrases AS MATERIALIZED (
  SELECT lang, list_slice(g, 1, m) AS g, count(*)::BIGINT AS f FROM ahead, unnest(generate_series(1, {longest})) o(m) WHERE len(g) >= m
  GROUP BY 1, 2),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM phrases WHERE len(g) = 1 GROUP BY lang),
frequent AS MATERIALIZED (SELECT * FROM phrases WHERE f >= {least}),
inside AS (
  SELECT p.lang, list_slice(p.g, i, i + m - 1) AS g, max(p.f) AS most
  FROM frequent p, unnest(generate_series(2, {longest})) o(m), unnest(generate_series(1, len(p.g) - m + 1)) t(i) WHERE len(p.g) > m
  GROUP BY 1, 2),
cut AS MATERIALIZED (
  SELECT p.*, k, list_slice(g, 1, k) AS head, list_slice(g, k + 1, len(g)) AS tail FROM frequent p, ({cuts}) c WHERE k < len(g)),
scored AS (
  SELECT p.lang, p.g, p.f AS a, x.f AS l, y.f AS r, t.n, k,
         ((1000::HUGEINT * p.f * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut p JOIN frequent x ON x.lang = p.lang AND x.g = p.head JOIN frequent y ON y.lang = p.lang AND y.g = p.tail
  JOIN totals t ON t.lang = p.lang
  QUALIFY row_number() OVER (PARTITION BY p.lang, p.g ORDER BY score, k) = 1),
ranked AS (
  SELECT s.*, array_to_string(s.g, ' ') AS phrase FROM scored s LEFT JOIN inside i ON s.lang = i.lang AND s.g = i.g
  WHERE i.most IS NULL OR 100 * i.most < {percent} * s.a
  QUALIFY row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) <= {top})
SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase))::INT AS rank, phrase, a, l, r, n, score FROM ranked"""


def url_tree(rules: list[tuple[str, str, str]]) -> str:
    """op11: the tree level by level."""
    from . import url_tree as t

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def shape(x: str) -> str:
        ending = f"regexp_extract({x}, '\\.([A-Za-z0-9]{{1,5}})$', 1)"
        stem = f"CASE WHEN {ending} <> '' THEN substr({x}, 1, length({x}) - length({ending}) - 1) ELSE {x} END"
        kinds = "".join(f" WHEN regexp_matches({stem}, '{p}') THEN '{k}'" for p, k in (
            ("^$", "{empty}"), ("^[0-9]+$", "{num}"), ("^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{date}"), ("^[0-9a-fA-F-]{8,}$", "{hex}"),
            ("^[A-Za-z]+$", "{word}"), ("^[A-Za-z0-9]+([-_][A-Za-z0-9]+)+$", "{slug}")))
        return (f"(CASE{kinds} ELSE '{{mixed}}' END || CASE WHEN {ending} = '' THEN '' "
                f"WHEN regexp_matches(lower({ending}), '^({t.ENDINGS})$') THEN '.' || lower({ending}) ELSE '.{{ext}}' END)")

    ordered = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1])), reverse=True)

    def by_rule(what: int) -> str:
        return "CASE" + "".join(
            f" WHEN (host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) AND starts_with(path, {quoted(p)}) "
            f"THEN {quoted((v, h + p)[what])}" for v, h, p in ordered) + " END"

    levels = []
    for d in range(t.DEPTH):
        levels.append(f"""
o{d} AS MATERIALIZED (
  SELECT *, segs[{d + 1}] AS seg, {shape(f"segs[{d + 1}]")} AS kind,
         CASE WHEN len(segs) < {d + 2} THEN {quoted(t._LAST)} ELSE {shape(f"segs[{d + 2}]")} END AS next FROM l{d}),
often{d} AS (
  SELECT * FROM (SELECT host, template, seg, count(*) AS n, sum(count(*)) OVER (PARTITION BY host, template) AS total
                 FROM o{d} WHERE seg IS NOT NULL GROUP BY host, template, seg)
  WHERE n >= {t.MIN_ROWS} AND n >= {t.SHARE}::DOUBLE * total),
p{d} AS MATERIALIZED (
  SELECT o.*, CASE WHEN f.seg IS NOT NULL THEN '=' || o.seg ELSE o.kind END AS child
  FROM o{d} o LEFT JOIN often{d} f ON o.host = f.host AND o.template = f.template AND o.seg = f.seg),
small{d} AS (
  SELECT host, template, child, next, any_value(purity) AS purity, count(*) AS n, count(blocked) AS labelled, coalesce(sum(blocked), 0) AS blocked
  FROM p{d} WHERE seg IS NOT NULL GROUP BY host, template, child, next),
pool{d} AS (SELECT host, template, next, sum(n) AS n FROM small{d} GROUP BY ALL),
node{d} AS (
  SELECT host, template, sum(n) AS n, count(DISTINCT next) AS nexts, sum(labelled) AS labelled, sum(blocked) AS blocked FROM small{d} GROUP BY ALL),
child{d} AS (
  SELECT host, template, child, any_value(purity) AS purity, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked
  FROM small{d} GROUP BY host, template, child),
apart{d} AS (
  SELECT c.host, c.template, c.child, sum(abs(coalesce(s.n, 0)::DOUBLE / c.n - p.n::DOUBLE / m.n)) AS apart
  FROM child{d} c JOIN pool{d} p USING (host, template) JOIN node{d} m USING (host, template)
  LEFT JOIN small{d} s ON s.host = c.host AND s.template = c.template AND s.child = c.child AND s.next = p.next GROUP BY ALL),
like{d} AS (
  SELECT c.*, a.apart <= sqrt(2 * (m.nexts * ln(2.0::DOUBLE) - ln({t.ALPHA}::DOUBLE)) / c.n) AND (c.labelled = 0 OR
         abs(c.blocked::DOUBLE / c.labelled - m.blocked::DOUBLE / m.labelled) <= sqrt(ln({2 / t.ALPHA}::DOUBLE) / (2 * c.labelled))) AS alike
  FROM child{d} c JOIN node{d} m USING (host, template) JOIN apart{d} a USING (host, template, child)),
label{d} AS (
  SELECT *, CASE WHEN alike AND count(*) FILTER (WHERE alike) OVER (PARTITION BY host, template) > 1 THEN '{{*}}' ELSE child END AS label FROM like{d}),
found{d} AS (
  SELECT host, template, child, label,
         (sum(blocked) OVER b + {t.SMOOTH}::DOUBLE * purity) / (sum(labelled) OVER b + {t.SMOOTH}::DOUBLE) AS purity
  FROM label{d} WINDOW b AS (PARTITION BY host, template, label)),
l{d + 1} AS MATERIALIZED (
  SELECT p.page_id, p.host, p.path, p.rule, p.ruled, p.blocked, p.segs,
         CASE WHEN p.seg IS NULL THEN p.template ELSE p.template || '/' || f.label END AS template,
         CASE WHEN p.seg IS NULL THEN p.purity ELSE f.purity END AS purity
  FROM p{d} p LEFT JOIN found{d} f ON p.host = f.host AND p.template = f.template AND p.child = f.child)""")
    return f"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
s AS (SELECT *, {by_rule(1)} AS rule, {by_rule(0)} AS ruled, string_split(substr(path, 2), '/') AS parts FROM u),
b AS MATERIALIZED (
  SELECT page_id, host, path, rule, ruled, CASE WHEN ruled IS NOT NULL THEN (ruled = 'block')::INT END AS blocked,
         CASE WHEN path = '' THEN [] WHEN len(parts) > {t.DEPTH}
              THEN list_append(list_slice(parts, 1, {t.DEPTH - 1}), array_to_string(list_slice(parts, {t.DEPTH}, len(parts)), '/'))
              ELSE parts END AS segs FROM s),
everything AS (SELECT (coalesce(sum(blocked), 0) + 0.5::DOUBLE) / (count(blocked) + 1) AS purity FROM b),
hosts AS (
  SELECT host, (coalesce(sum(blocked), 0) + {t.SMOOTH}::DOUBLE * any_value(e.purity)) / (count(blocked) + {t.SMOOTH}::DOUBLE) AS purity
  FROM b, everything e GROUP BY host),
l0 AS MATERIALIZED (SELECT b.*, '' AS template, h.purity FROM b JOIN hosts h ON b.host = h.host),{",".join(levels)}
SELECT page_id::BIGINT AS page_id, host, path, rule, coalesce(ruled, CASE WHEN purity > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       template, round(purity, 9) AS purity FROM l{t.DEPTH}"""
