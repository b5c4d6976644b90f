"""SQL that DuckDB runs for the operators that SQL can express."""

from __future__ import annotations

from sparkloom.llm.bagminhash import SIMILARITY, WORDS
from sparkloom.llm.mixing import ALPHA, BLOCK, PERIOD
from sparkloom.llm.sharding import OVERHEAD, SLOTS

#: Near-duplicates by comparing every two texts that share a shingle: the classes that no search may miss.
NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
texts AS (SELECT min(doc_id) AS node, w FROM words GROUP BY w),
shingles AS (SELECT node, unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM texts),
bags AS (SELECT node, s, count(*) AS n FROM shingles GROUP BY 1, 2),
sizes AS (SELECT node, sum(n) AS size FROM bags GROUP BY 1),
met AS (SELECT a.node AS a, b.node AS b, sum(least(a.n, b.n)) AS shared FROM bags a JOIN bags b ON a.s = b.s AND a.node < b.node GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sizes x ON x.node = a JOIN sizes y ON y.node = b WHERE shared / (x.size + y.size - shared)::DOUBLE >= {SIMILARITY}),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT a AS node, a AS other FROM ways UNION SELECT r.node, w.b FROM reached r JOIN ways w ON w.a = r.other),
classes AS (SELECT node, min(other) AS class_id FROM reached GROUP BY 1)
SELECT d.doc_id, coalesce(c.class_id, t.node) AS class_id, t.node AS copy_of FROM words d JOIN texts t ON t.w = d.w LEFT JOIN classes c ON c.node = t.node
"""

#: Earliest deadline first, slot by slot over one period.
MIX = f"""
WITH RECURSIVE rows AS (SELECT doc_id, source, coalesce(source, '') AS s, coalesce(strlen(text), 0)::BIGINT AS bytes FROM documents),
drawn AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':7:' || bytes), 1, 15))::BIGINT AS draw FROM rows),
placed AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY s ORDER BY draw, doc_id NULLS FIRST, bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM drawn),
sizes AS (SELECT s, pow(greatest(1, sum(bytes)), {ALPHA}) AS weight FROM rows GROUP BY 1),
total AS (SELECT greatest({PERIOD}, 4 * count(*)) AS period, count(*) AS n, sum(weight) AS weight FROM sizes),
exact AS (SELECT s, z.weight / t.weight * (period - n) AS x, period FROM sizes z, total t),
whole AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, s) AS turn, period - sum(1 + floor(x)) OVER () AS spare FROM exact),
slots AS (SELECT s, (1 + floor(x) + CASE WHEN turn <= spare THEN 1 ELSE 0 END)::BIGINT AS w, period, row_number() OVER (ORDER BY s) AS i FROM whole),
lists AS (SELECT list(w ORDER BY i) AS w, any_value(period)::BIGINT AS d, count(*) AS n FROM slots),
step AS (
  SELECT 0::BIGINT AS t, list_transform(w, lambda x: 0::BIGINT) AS done, 0::BIGINT AS i, 0::BIGINT AS k FROM lists
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, j: CASE WHEN j = p.i THEN x + 1 ELSE x END), p.i, done[p.i]
  FROM (SELECT t, done, list_min(list_filter(list_transform(range(1, n + 1), lambda j: {{'due': ((done[j] + 1) * d + w[j] - 1) // w[j], 'i': j, 'release': done[j] * d // w[j]}}), lambda x: x.release <= t)) AS p FROM step, lists WHERE t < d)),
period AS (SELECT i, k AS turn, t - 1 AS slot FROM step WHERE t > 0),
blocks AS (SELECT doc_id, source, place, place // {BLOCK} AS block, w, i, period::BIGINT AS d FROM placed JOIN slots USING (s))
SELECT doc_id, source, block AS mix_block, block * d // w AS mix_release, ((block + 1) * d + w - 1) // w AS mix_deadline, block // w * d + slot AS mix_slot, place AS mix_place FROM blocks b JOIN period p ON p.i = b.i AND p.turn = b.block % w
"""

#: CRC-32 byte by byte, with its table from the polynomial; slots dealt from the largest on, one by one.
SHARDS = f"""
WITH RECURSIVE bits(v, c, k) AS (SELECT v, v, 0 FROM range(256) t(v) UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
hexed AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + {OVERHEAD} AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
rows AS (SELECT doc_id, size, xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM hexed, crc),
slotted AS (SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || text_crc32), 1, 15))::BIGINT % {SLOTS})::INTEGER AS virtual_slot FROM rows),
sums AS (SELECT v AS virtual_slot, coalesce(sum(size), 0)::BIGINT AS size FROM range({SLOTS}) t(v) LEFT JOIN slotted ON virtual_slot = v GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY size DESC, virtual_slot) AS n FROM sums),
dealt AS (
  SELECT 0::BIGINT AS n, list_transform(range(24), lambda x: 0::BIGINT) AS loads, -1::BIGINT AS virtual_slot, 0::BIGINT AS shard
  UNION ALL
  SELECT r.n, list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + r.size ELSE x END), r.virtual_slot, list_position(loads, list_min(loads)) - 1 FROM dealt d JOIN ranked r ON r.n = d.n + 1),
homes AS (SELECT virtual_slot, shard FROM dealt WHERE n > 0)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INTEGER AS grown_shard, virtual_slot, 1::INTEGER AS map_version
FROM slotted JOIN homes USING (virtual_slot)
"""

#: The trie by comparing whole sequences of turns, as text with lengths before each part.
TRIE = """
WITH RECURSIVE bits(v, c, k) AS (SELECT v, v, 0 FROM range(256) t(v) UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS j FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, max(j) AS n, conv_id - conv_id % 5 AS first, hex(encode(conv_id::VARCHAR)) AS hexed FROM turns GROUP BY 1),
heads AS (SELECT conv_id, n, first, xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(hexed) // 2), lambda i: ('0x' || substr(hexed, (2 * i + 1)::BIGINT, 2))::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h FROM convs, crc),
lent AS (SELECT c.conv_id, c.n, c.h, count(t.j) AS k FROM heads c LEFT JOIN turns t ON t.conv_id = c.first AND t.j <= c.h GROUP BY ALL),
rebuilt AS (
  SELECT c.conv_id, t.j AS d, t.role, t.text FROM heads c JOIN turns t ON t.conv_id = c.first AND t.j <= c.h
  UNION ALL SELECT c.conv_id, c.k + t.j - c.h, t.role, t.text FROM lent c JOIN turns t ON t.conv_id = c.conv_id AND t.j > c.h),
keyed AS (SELECT conv_id, d, strlen(text) AS bytes, sha256(length(role) || ':' || role || ':' || text) AS one FROM rebuilt),
path AS (
  SELECT conv_id, 0::BIGINT AS d, '' AS key, '' AS above, 0::BIGINT AS bytes FROM heads
  UNION ALL SELECT k.conv_id, k.d, sha256(p.key || k.one), p.key, k.bytes FROM path p JOIN keyed k ON k.conv_id = p.conv_id AND k.d = p.d + 1),
lengths AS (SELECT conv_id, k + greatest(0, n - h) AS len FROM lent),
nodes AS (SELECT d, key, any_value(above) AS above, any_value(bytes) AS bytes, count(*) AS n_convs, min(conv_id) AS conv_id, sha256(coalesce(string_agg(CASE WHEN d = len THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM path JOIN lengths USING (conv_id) GROUP BY 1, 2),
kids AS (SELECT above AS key, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
rolled AS (SELECT q.key, q.d, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.bytes)::BIGINT AS saved_tokens FROM nodes u LEFT JOIN kids k ON k.key = u.key AND k.d = u.d JOIN path q ON q.conv_id = u.conv_id AND q.d <= u.d GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, r.n_leaves, r.saved_tokens, n.ends_sha256
FROM nodes n JOIN rolled r ON r.key = n.key AND r.d = n.d LEFT JOIN kids k ON k.key = n.key AND k.d = n.d LEFT JOIN nodes p ON n.d > 0 AND p.key = n.above AND p.d = n.d - 1
"""

#: Every order walked filter by filter, over the numbers of documents with the same failures.
AUDIT = r"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
least AS (SELECT t, min(doc_id) AS least FROM texts GROUP BY 1),
marks AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY 1),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(words.t, '[^A-Z]', '', 'g')) > 10 * length(words.t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(words.t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN words.doc_id > least THEN 'E' ELSE '' END AS fails
  FROM words JOIN least ON least.t = words.t LEFT JOIN marks ON marks.doc_id = words.doc_id),
alike AS (SELECT part, good, toxic, fails, count(*) AS n FROM failing GROUP BY ALL),
orders AS (SELECT '' AS o UNION ALL SELECT o || f FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) u(f) WHERE NOT contains(o, f)),
steps AS (SELECT o AS filter_order, s::INTEGER AS step, o[s] AS f, o[1:s - 1] AS earlier FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
walked AS (SELECT part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) AS hit, earlier <> '' AND regexp_matches(fails, '[' || earlier || '@]') AS gone FROM alike, steps),
rows AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails = f), 0)::BIGINT AS unique_fails,
    coalesce(sum(n * good) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(n * toxic) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM walked GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM rows
"""

SQL = {"op11_prefix_trie": TRIE, "op12_filter_audit": AUDIT, "op2_bagminhash": NEAR_DUPLICATES, "op7_pfair_mix": MIX, "op8_virtual_slots": SHARDS}
