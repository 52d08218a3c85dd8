"""The operators in DuckDB SQL, for those that SQL can express."""

from __future__ import annotations

from storyledger.llm import fim, licenses, mixing, shards
from storyledger.llm.queries import MIX_SEED, N_SHARDS, URL_RULES
from storyledger.llm.text import SPACED_WORD, WORD


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWER.format("coalesce({}, '')")}, {quoted(WORD)})"


def _inverse(share: str, knots: mixing.Knots) -> str:
    time = "NULL"
    for i, (t0, length, w0, w1, before, after) in enumerate(reversed(mixing.pieces(knots))):
        left = f"({share} - {before!r}::DOUBLE)"
        slope = (w1 - w0) / length
        under = f"greatest({w0 * w0!r}::DOUBLE + {2.0 * slope!r}::DOUBLE * {left}, 0.0::DOUBLE)"
        bottom = f"({w0!r}::DOUBLE + sqrt({under}))"
        root = f"(CASE WHEN {bottom} = 0 THEN NULL ELSE 2.0::DOUBLE * {left} / {bottom} END)"
        found = f"({t0!r}::DOUBLE + least(coalesce({root}, 0.0::DOUBLE), {length!r}::DOUBLE))"
        time = found if i == 0 else f"CASE WHEN {share} < {after!r}::DOUBLE THEN {found} ELSE {time} END"
    return time


def _positions(share: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {_inverse(share, k)}" for i, k in enumerate(mixing.SHAPES))
    return f"CASE rank % {len(mixing.SHAPES)} {cases} END"


MIX = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {quoted(SPACED_WORD)}))::BIGINT AS size,
         md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, '')) || coalesce(doc_id::VARCHAR, '') AS tie
  FROM documents),
sources AS (
  SELECT *, (rank % 3 + 1)::DOUBLE AS weight, (source_size * {mixing.MAX_PASSES})::DOUBLE AS cap FROM (
    SELECT source, sum(size)::BIGINT AS source_size,
           row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank
    FROM sized GROUP BY source)),
levels AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE
              - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM sources),
level AS (SELECT rest, open FROM levels WHERE weight * (rest / open) <= cap ORDER BY cap / weight, rank LIMIT 1),
targets AS (
  SELECT s.*, CASE WHEN l.rest IS NULL THEN cap ELSE least(weight * (l.rest / l.open), cap) END AS target
  FROM sources s LEFT JOIN level l ON true),
running AS (
  SELECT d.*, t.source_size, t.target, t.rank,
         sum(size) OVER (PARTITION BY t.rank ORDER BY tie) - size AS own
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
passes AS (
  SELECT doc_id, tie, p, least(size, greatest(floor(target + 0.5) - (p * source_size + own), 0))::BIGINT AS words,
         {_positions("((p * source_size + own)::DOUBLE / target)")} AS position
  FROM running, (SELECT unnest(range({mixing.MAX_PASSES})) AS p) WHERE target > 0),
taken AS (
  SELECT doc_id, sum(words)::BIGINT AS taken, count(*)::BIGINT AS copies, round(min(position), 6) AS first_position
  FROM passes WHERE words > 0 GROUP BY doc_id)
SELECT r.doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(copies, 0) AS copies, first_position
FROM running r LEFT JOIN taken t ON r.doc_id = t.doc_id
"""

_rules = ", ".join(f"({quoted(h)}, {quoted(p)}, {quoted(v)})" for h, p, v in URL_RULES)
URLS = f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_rules}),
split AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%' THEN {LOWER.format("regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*')")} ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
fitting AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost) * 100000 + length(rpath)) AS rule,
         arg_max(rverdict, length(rhost) * 100000 + length(rpath)) AS verdict
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id)
SELECT s.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split s LEFT JOIN fitting f ON s.page_id = f.page_id
"""

CONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
items AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM (SELECT item_id, w, least(len(w), 10) AS k FROM items WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k)),
hits AS (SELECT DISTINCT doc_id, item_id, p.k, i FROM places p JOIN windows v ON p.k = v.k AND p.win = v.win),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_signatures = ", ".join(
    f"({i}, {quoted(r.keyword)}, {quoted(r.pattern)}, {quoted(r.label)}, {r.priority}, {r.confidence!r}::DOUBLE, {str(r.base).lower()})"
    for i, r in enumerate(licenses.RULES)
)
LICENSES = f"""
WITH rules(rule, keyword, pattern, label, priority, confidence, base) AS (VALUES {_signatures}),
docs AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
anchors AS (
  SELECT doc_id, pos - 1 AS pos, keyword, array_to_string(w[pos:pos + {licenses.REACH - 1}], ' ') || ' ' AS ahead
  FROM (SELECT doc_id, w, pos, w[pos] AS keyword FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM docs))
  WHERE keyword IN (SELECT keyword FROM rules)),
hits AS (
  SELECT doc_id, pos, pos + len(string_split(m, ' ')) - 1 AS stop, r.*
  FROM (SELECT doc_id, pos, regexp_extract(ahead, pattern) AS m, rules.* FROM anchors JOIN rules USING (keyword)) r WHERE m <> ''),
labelled AS (
  SELECT *, NOT base AND EXISTS (
    SELECT 1 FROM hits e WHERE e.doc_id = h.doc_id AND NOT e.base AND e.pos <= h.pos AND e.stop >= h.stop AND e.priority <= h.priority
      AND (e.pos, -e.stop, e.priority, e.rule) < (h.pos, -h.stop, h.priority, h.rule)) AS suppressed
  FROM hits h),
found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(pos) FILTER (base) AS first_word, max(pos) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR NOT suppressed) AS labels,
         max(confidence) FILTER (base OR NOT suppressed) AS score
  FROM labelled GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM docs d LEFT JOIN found USING (doc_id)
"""


def _feistel(value: str, columns: str, source: str) -> str:
    """Rounds of the permutation as nested selects over ``source``; gives ``columns`` and ``p``."""
    sql = f"SELECT {columns}, a, b, n, ({value}) // b AS x, ({value}) % b AS y, a AS mx, b AS my FROM {source}"
    for m, c in shards.round_keys(7):
        mixed = f"((y * {m} + {c}) % {shards.PRIME})"
        sql = f"SELECT {columns}, a, b, n, y AS x, (x + {mixed} * {mixed} % {shards.PRIME}) % mx AS y, my AS mx, mx AS my FROM ({sql})"
    return f"SELECT {columns}, a, b, n, x * b + y AS p FROM ({sql})"


_kept = "doc_id, size, text_crc32"
# Checksums bit by bit: the polynomial is the fixed value of CRC-32.
_crc_step = "xor(c >> 1, (c & 1) * 3988292384)"
SHARDS = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: {_crc_step}) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
rows AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, coalesce(text, '') AS body, md5(coalesce(text, '')) AS digest FROM documents),
summed AS (
  SELECT doc_id, size, digest,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: ('0x' || h)::BIGINT)),
                     lambda c, byte: xor(c >> 8, t[(xor(c, byte) & 255) + 1])), 4294967295) AS text_crc32
  FROM rows, crc_table),
grid AS (SELECT n, a, (n + a - 1) // a AS b FROM (
  SELECT count(*)::BIGINT AS n, (floor(sqrt(greatest(count(*) - 1, 0))) + 1)::BIGINT AS a FROM documents)),
numbered AS (
  SELECT {_kept}, (row_number() OVER (ORDER BY doc_id NULLS FIRST, digest) - 1)::BIGINT AS number, a, b, n FROM summed, grid),
walk AS (
  {_feistel("number", _kept, "numbered")}
  UNION ALL
  {_feistel("p", _kept, "(SELECT * FROM walk WHERE p >= n)")})
SELECT {_kept}, 'rows' AS law, (p % {N_SHARDS})::INTEGER AS shard, (p // {N_SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM walk WHERE p < n
"""

WARC = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM sized)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to, true AS has_request
FROM firsts
"""

EXACT = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

# The output is read back by the places of its sentinels, which occur in no text that is transformed.
_p, _s, _m = (quoted(x) for x in (fim.PREFIX, fim.SUFFIX, fim.MIDDLE))


def _between(first: str, then: str | None) -> str:
    start = f"strpos(output, {first}) + {len(fim.PREFIX)}"
    return f"output[{start}:]" if then is None else f"output[{start}:strpos(output, {then}) - 1]"


FIM = f"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('{fim.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
numbers AS (
  SELECT doc_id, body, length(body)::BIGINT AS n, {", ".join(f"('0x' || h[{8 * i + 1}:{8 * i + 8}])::BIGINT AS h{i + 1}" for i in range(4))}
  FROM drawn),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(body, {_p}) OR contains(body, {_s}) OR contains(body, {_m}) OR h3 % 100 >= {fim.PLAIN_FROM} THEN 'plain'
              WHEN h4 % 100 < {fim.SUFFIX_FIRST_BELOW} THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
parts AS (SELECT *, left(body, a) AS prefix, substring(body, a + 1, b - a) AS middle, substring(body, b + 1) AS suffix FROM formed),
made AS (
  SELECT *, CASE form WHEN 'psm' THEN concat({_p}, prefix, {_s}, suffix, {_m}, middle)
                      WHEN 'spm' THEN concat({_s}, suffix, {_p}, prefix, {_m}, middle) ELSE body END AS output
  FROM parts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'psm' THEN concat({_between(_p, _s)}, {_between(_m, None)}, {_between(_s, _m)})
                        WHEN 'spm' THEN concat({_between(_p, _m)}, {_between(_m, None)}, {_between(_s, _p)}) ELSE output END) AS restored_sha256
FROM made
"""

ORACLE: dict[str, str] = {
    "op1_mix_sources": MIX,
    "op3_judge_urls": URLS,
    "op4_decontaminate": CONTAMINATION,
    "op6_scan_licenses": LICENSES,
    "op7_shard": SHARDS,
    "op9_warc": WARC,
    "op10_exact_dedup": EXACT,
    "op11_fill_in_middle": FIM,
}
