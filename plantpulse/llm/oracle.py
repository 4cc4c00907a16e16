"""SQL of the queries that SQL can express; FORMAT: the view names of the test tables."""

from __future__ import annotations

from plantpulse.llm import line_dedup, revisits, url_reputation

_IGNORED = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_EXACT_DEDUP = f"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(translate(coalesce(text, ''), {_IGNORED}, '')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""

_LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, len(ls) AS n, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM d),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l),
p AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before FROM h),
e AS (SELECT *, i = n - 1 OR xor(h, ((before << 7) & 4294967295) | (before >> 25)) % {line_dedup.MEAN_LINES} = 0 AS ends FROM p),
g AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
c AS (SELECT doc_id, chunk, min(i) AS start, count(*) AS size, string_agg(line, chr(10) ORDER BY i) AS text FROM g GROUP BY doc_id, chunk),
r AS (SELECT *, size >= {line_dedup.LEAST_LINES} AND row_number() OVER (PARTITION BY text, size ORDER BY doc_id NULLS LAST, start) > 1 AS gone FROM c)
SELECT doc_id, sum(size)::BIGINT AS n_lines, coalesce(sum(size) FILTER (gone), 0)::BIGINT AS removed_lines,
       sha256(coalesce(string_agg(text, chr(10) ORDER BY start) FILTER (NOT gone), '')) AS text_sha256
FROM r GROUP BY doc_id
"""

_JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 4 THEN array_to_string(words, ' ')
        ELSE array_to_string(words[i:i + 3], ' ') END AS shingle
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (shingle)
      WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b = t.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, min(r.b)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""

_WARC = f"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, 1700000000 + page_id * 60 AS shot,
         '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag,
         CAST(1600000000 + page_id * 60 AS VARCHAR) AS modified,
         regexp_extract(url, '(?s)^[^#]*?://([^#]*)', 1) AS bare FROM pages),
k AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '(?s)\\?(.*)$', 1), '&'),
                                  lambda x: x <> '' AND NOT starts_with(x, '{revisits.TRACKING_PREFIX}'))) AS params FROM p),
u AS (
  SELECT *, CASE WHEN contains(url, '://') THEN
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '(?s)^([^/?]*)', 1)), ':(80|443)$', ''), '^www\\.', '')
    || regexp_replace(regexp_extract(bare, '(?s)^[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS url_key FROM k),
v AS (
  SELECT page_id * 2 + 1 AS record_id, url_key, shot + 3600 * (1 + page_id % 72) AS captured_at,
         CASE WHEN page_id % 5 <= 2 THEN tag WHEN page_id % 5 = 4 THEN '"other"' END AS tag,
         CASE WHEN page_id % 5 <= 2 THEN 'W/' || tag WHEN page_id % 5 = 4 THEN '"other"' END AS etag,
         CASE WHEN page_id % 5 = 3 THEN modified END AS modified, page_id % 1000 AS age FROM u),
j AS (
  SELECT v.*, r.page_id AS found, r.tag AS r_tag, r.modified AS r_modified, r.html AS html
  FROM v ASOF LEFT JOIN u r ON v.url_key = r.url_key AND v.captured_at > r.shot),
s AS (
  SELECT *, CASE WHEN found IS NULL THEN 'orphan' WHEN tag IS NOT NULL AND tag = r_tag THEN 'resolved'
                 WHEN tag IS NULL AND modified = r_modified THEN 'resolved' ELSE 'validator_mismatch' END AS state FROM j)
SELECT record_id, url_key, captured_at, state,
       CASE WHEN state = 'resolved' THEN found * 2 END AS refers_to,
       CASE WHEN state = 'resolved' THEN
         'cache-control: max-age=' || age || chr(10) || 'content-length: ' || strlen(html) || chr(10)
         || 'content-type: text/html' || chr(10) || 'etag: ' || coalesce(etag, r_tag) || chr(10)
         || 'last-modified: ' || r_modified END AS headers,
       CASE WHEN state = 'resolved' THEN md5(html) END AS payload_digest
FROM s
"""


def _rule_case(value: str) -> str:
    whens = []
    for action, host, path in sorted(url_reputation.RULES, key=lambda r: -len(r[1] + r[2])):
        shown = f"'{host}{path}'" if value == "text" else f"'{action}'"
        whens.append(
            f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN {shown}"
        )
    return "CASE " + " ".join(whens) + " END"


def _level(name: str, source: str, policy: url_reputation.Policy) -> str:
    """Two steps: the strength of the level's prior, and the shrunk rates."""
    q = "parent_rate * (1 - parent_rate)"
    return f"""
{name}_m AS (SELECT sum(CAST(round(n * pow(bad / n - parent_rate, 2) / ({q}), 6) AS DECIMAL(30, 6)))::DOUBLE AS s,
             count(*) AS k, sum(n) AS n FROM {source} WHERE n > 0 AND parent_rate > 0 AND parent_rate < 1),
{name}_s AS (SELECT round(1 / least(greatest(coalesce(CASE WHEN n > k THEN (s - k) / (n - k) ELSE 0.0 END, 0.0),
             {policy.weakest}), {policy.strongest}) - 1, 6) AS strength FROM {name}_m),
{name} AS (SELECT c.*, n + strength AS weight,
           round((bad + strength * parent_rate) / (n + strength), 9) AS rate FROM {source} c, {name}_s)"""


def _url_reputation(policy: url_reputation.Policy = url_reputation.Policy()) -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    two = ", ".join(f"'{s}'" for s in url_reputation.TWO_LABEL_SUFFIXES)
    last = "array_to_string(string_split(host, '.')[-{}:], '.')"
    return f"""
WITH p AS (SELECT page_id, coalesce({lower.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 THEN 1 WHEN quality IS NOT NULL THEN 0 END) AS bad
      FROM labels GROUP BY doc_id),
hosts AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
            CASE WHEN {last.format(2)} IN ({two}) THEN {last.format(3)} ELSE {last.format(2)} END AS domain,
            CASE WHEN {last.format(2)} IN ({two}) THEN {last.format(2)} ELSE {last.format(1)} END AS suffix
          FROM p LEFT JOIN o USING (page_id) GROUP BY host),
t AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0.5) AS parent_rate FROM hosts),
s0 AS (SELECT suffix, n, bad, parent_rate FROM (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix), t),
{_level("s1", "s0", policy)},
d0 AS (SELECT domain, d.n, d.bad, s1.rate AS parent_rate
       FROM (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix, domain) d JOIN s1 USING (suffix)),
{_level("d1", "d0", policy)},
h0 AS (SELECT host, h.n, h.bad, d1.rate AS parent_rate FROM hosts h JOIN d1 USING (domain)),
{_level("h1", "h0", policy)},
r AS (SELECT host, n, rate,
        round(rate - {policy.z} * sqrt(rate * weight * ((1 - rate) * weight) / (pow(weight, 2) * (weight + 1))), 9) AS bound FROM h1)
SELECT page_id, host, path, {_rule_case("text")} AS rule,
       coalesce({_rule_case("action")}, CASE WHEN bound > {policy.limit} THEN 'block' ELSE 'allow' END) AS verdict,
       rate AS bad_rate, bound AS bad_bound, n AS n_labels
FROM p JOIN r USING (host)
"""

_HARD_NEGATIVES = """
WITH e AS (
  SELECT row_number() OVER () AS no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.no, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id IS DISTINCT FROM b.vec_id),
p AS (
  SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, id NULLS LAST) AS place
  FROM s WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       row_number() OVER (PARTITION BY p.no, p.place ORDER BY s.score DESC, s.id NULLS LAST)::INTEGER AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.no = s.no AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": _EXACT_DEDUP,
        "op4_line_dedup": _LINE_DEDUP,
        "op5_jaccard_join": _JACCARD,
        "op7_warc_revisits": _WARC,
        "op9_url_reputation": _url_reputation(),
        "op11_hard_negatives": _HARD_NEGATIVES,
    }
