"""DuckDB SQL for the queries that SQL can express, written by brute force."""

from __future__ import annotations

from .mixing import SEED

_WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS rn FROM win)
  WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP3 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(0, len(string_split(text, chr(10))))) AS line
  FROM documents),
w AS (SELECT doc_id, line, s, {_WORDS.format('s')} AS ws, doc_id * 1000000 + line AS place FROM l),
f AS (SELECT ws, min(place) AS place FROM w WHERE len(ws) > 0 GROUP BY ws),
long AS (SELECT ws, place, len(ws) AS n FROM f WHERE len(ws) >= 8),
cut AS (
  SELECT place, n, i, md5(array_to_string(ws[1:i - 1] || [chr(10)] || ws[i + 1:], ' ')) AS swap,
         md5(array_to_string(ws[1:i - 1] || ws[i + 1:], ' ')) AS less
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM long)),
whole AS (SELECT place, md5(array_to_string(ws, ' ')) AS h FROM long),
near AS (
  SELECT place FROM (SELECT place, min(place) OVER (PARTITION BY swap) AS lead FROM cut) WHERE lead < place
  UNION SELECT cut.place FROM cut JOIN whole ON less = h WHERE whole.place < cut.place
  UNION SELECT whole.place FROM cut JOIN whole ON less = h WHERE cut.place < whole.place),
kept AS (SELECT place FROM f ANTI JOIN near USING (place))
SELECT w.doc_id, count_if(len(ws) > 0) AS n_lines, count_if(len(ws) > 0 AND kept.place IS NULL) AS n_removed,
       md5(coalesce(string_agg(s, chr(10) ORDER BY line) FILTER (len(ws) = 0 OR kept.place IS NOT NULL), '')) AS kept_md5
FROM w LEFT JOIN kept USING (place) GROUP BY w.doc_id
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM pr JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * m >= 85 * (x.n + y.n - m)),
reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT x, b FROM reach JOIN link ON y = a),
least_id AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x),
class AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(s)) AS class_id
  FROM (SELECT doc_id, list(s) AS s FROM sh GROUP BY doc_id))
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept,
       coalesce(class_id, d.doc_id) AS class_id
FROM documents d JOIN least_id USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN class USING (doc_id)
"""

OP4 = rf"""
WITH w AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text, {_WORDS.format('text')} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
cover AS (
  SELECT doc_id, count(*) AS n_repeat FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS p FROM twice)
  GROUP BY doc_id),
m AS (
  SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cover USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, count_if(base_failed) AS k FROM f GROUP BY host),
mo AS (
  SELECT sum(k) / sum(n) AS m, sum(n * (k / n) * (k / n)) / sum(n) - pow(sum(k) / sum(n), 2) AS v,
         sum(n) / count(*) AS n0 FROM h),
pr AS (
  SELECT m, greatest(2.0, least(1000.0, CASE WHEN v - m * (1 - m) / n0 > 0
         THEN m * (1 - m) / (v - m * (1 - m) / n0) - 1 ELSE 1000.0 END)) AS st FROM mo),
r AS (SELECT host, (k + (SELECT m * st FROM pr)) / (n + (SELECT st FROM pr)) AS host_rate FROM h)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_rate < 0.6 AND NOT (m > 0 AND m < 1 AND host_rate >= m + 3 * sqrt(m * (1 - m) / (st + 1))) AS kept,
       round(host_rate, 9) AS host_rate
FROM pr, f JOIN r ON f.host IS NOT DISTINCT FROM r.host
"""

# the checksum is folded over the bytes with a table made by its polynomial
_CRC_TABLE = """tab AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(n)))"""

OP6 = f"""
WITH RECURSIVE {_CRC_TABLE},
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
b AS (
  SELECT doc_id, CAST(n + 1 AS BIGINT) AS size,
         list_transform(range(0, n), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)) AS b FROM h),
c AS (
  SELECT doc_id, size,
         CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS BIGINT) AS text_crc32
  FROM b, tab),
p AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS bytes_before,
         CAST(sum(size) OVER () AS BIGINT) AS whole FROM c),
s AS (SELECT *, CAST(least(7, ((2 * bytes_before + size) * 8) // (2 * whole)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY bytes_before) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard, bytes_before
FROM s
"""

OP7 = """
WITH said AS (
  SELECT conv_id, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS content,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS rk
  FROM conversations),
people AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM said),
seen AS (
  SELECT conv_id, perspective, rk // 64 AS part, rk, speaker = perspective AS own,
         CASE WHEN speaker = perspective THEN '<|assistant|>' ELSE '<|user name=' || speaker || '|>' END || chr(10) AS head,
         content || '<|end|>' AS body
  FROM said JOIN people ON conv_id IS NOT DISTINCT FROM c),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, perspective, part ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM seen)
SELECT conv_id, perspective, part, CAST(count(*) AS INTEGER) AS n_turns, CAST(count_if(own) AS INTEGER) AS n_masked,
       string_agg(head || body || chr(10), '' ORDER BY rk) AS text,
       coalesce(string_agg(CASE WHEN own THEN CAST(CAST(pos + length(head) AS BIGINT) AS VARCHAR) || '+' || length(body) END, ',' ORDER BY rk), '') AS mask
FROM placed GROUP BY conv_id, perspective, part
"""

OP9 = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n) AS rate FROM n),
dist(source, rate, k, term, total) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL
  SELECT source, rate, k + 1, term * rate / (k + 1), total + term * rate / (k + 1) FROM dist
  WHERE k + 1 <= ceil(rate + 10 * sqrt(rate) + 24)),
u AS (
  SELECT doc_id, source, md5(text) AS text_md5,
         CAST(('0x' || md5('{SEED}:count:' || doc_id)[1:13]) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
c AS (
  SELECT doc_id, u.source, text_md5, CAST(count_if(total <= u) AS INTEGER) AS mix_copies
  FROM u JOIN dist ON u.source IS NOT DISTINCT FROM dist.source
  WHERE k < ceil(rate + 10 * sqrt(rate) + 24) GROUP BY ALL),
x AS (SELECT *, unnest(range(0, mix_copies)) AS copy FROM c)
SELECT doc_id, source, text_md5, CAST(copy AS INTEGER) AS mix_copy, mix_copies,
       md5('{SEED}:place:' || doc_id || ':' || copy) AS mix_place
FROM x
"""

OP12 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS lead FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((CAST('0x' || hex[5 * (i // 4) + 1:5 * (i // 4) + 5] AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31)]), '') AS payload_digest,
       CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM h
"""

# a weight is the cost in ten digits and the labels, so that the least string is the least weight
_W = lambda cost, label, weight: f"lpad(CAST(CAST({weight}[1:10] AS INTEGER) + {cost} AS VARCHAR), 10, '0') || '{label}' || {weight}[11:]"


def _arcs(state: str, to: str, keeps: str) -> str:
    """The least weight of a turn in a state: deleted, given the role that leads on, or kept."""
    return (
        f"least({_W(3, 'D', state)}, CASE WHEN fault IN ('', 't') THEN {_W('2 + extra', 'R', to)} END, "
        f"CASE WHEN fault IN ('', 't') AND ini = 'KEPT' THEN {_W('extra', 'K', keeps)} END)"
    )


OP13 = rf"""
WITH RECURSIVE {_CRC_TABLE},
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h
  FROM conversations),
bytes AS (
  SELECT *, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)) AS b FROM src),
hit AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 20 AS kind
  FROM bytes, tab),
dam AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit),
placed AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY conv_id) AS n,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS said
  FROM dam WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faults AS (
  SELECT *, role[1:1] AS ini, lead(role[1:1]) OVER (PARTITION BY conv_id ORDER BY rn) AS following,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN said > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault
  FROM placed),
f AS (SELECT *, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS extra FROM faults),
ids AS (SELECT DISTINCT conv_id FROM conversations),
-- cheapest ways from each state of the grammar (start, after s, after u, after a) on, from the last turn to the first
path(conv_id, i, z, s, u, a) AS (
  SELECT conv_id, n, '0000000000', '0000000004II', '0000000002I', '0000000000' FROM f WHERE rn = 1
  UNION ALL
  SELECT conv_id, i - 1, least(z, {_W(2, 'I', 'u2')}), least(s, {_W(2, 'I', 'u2')}), u2, least(a, {_W(2, 'I', 'u')})
  FROM (SELECT *, least(u, {_W(2, 'I', 'a')}) AS u2 FROM (
    SELECT path.conv_id, i,
           least({_arcs('z', 'u', 'u').replace('KEPT', 'u')}, CASE WHEN fault IN ('', 't') AND ini = 's' THEN {_W('extra', 'K', 's')} END) AS z,
           {_arcs('s', 'u', 'u').replace('KEPT', 'u')} AS s, {_arcs('u', 'a', 'a').replace('KEPT', 'a')} AS u,
           {_arcs('a', 'u', 'u').replace('KEPT', 'u')} AS a
    FROM path JOIN f ON path.conv_id IS NOT DISTINCT FROM f.conv_id AND i = rn))),
plan AS (SELECT conv_id, CAST(z[1:10] AS BIGINT) AS cost, z[11:] AS audit FROM path WHERE i = 0),
edit AS (
  SELECT conv_id, k, e, count_if(e <> 'I') OVER w AS rn, count_if(e <> 'D') OVER w AS o
  FROM (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS k, unnest(string_split(audit, '')) AS e FROM plan WHERE audit <> '')
  WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
made AS (
  SELECT e.conv_id, k, e, o, f.role, f.text,
         max(CASE WHEN e = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS headed
  FROM edit e LEFT JOIN f ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.rn = f.rn),
digest AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END
           || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS t
  FROM made WHERE e <> 'D' GROUP BY conv_id),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank,
         count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated,
         count_if(following IS NOT NULL AND ini || following NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM ids LEFT JOIN stats ON ids.conv_id IS NOT DISTINCT FROM stats.conv_id
LEFT JOIN plan ON ids.conv_id IS NOT DISTINCT FROM plan.conv_id
LEFT JOIN digest ON ids.conv_id IS NOT DISTINCT FROM digest.conv_id
"""

ORACLE_SQL = {
    "op1_substring_dedup": OP1,
    "op2_minhash_dedup": OP2,
    "op3_line_dedup": OP3,
    "op4_host_quality": OP4,
    "op6_byte_shards": OP6,
    "op7_perspectives": OP7,
    "op9_poisson_mix": OP9,
    "op12_warc_captures": OP12,
    "op13_conversation_repair": OP13,
}
