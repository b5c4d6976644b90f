"""Chunks of documents with headings, blank lines and sections: the turns of five conversations make a document, runs of turns its sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import chunking
from sparkloom.plans.common import longs, paragraphs_sql, read, sentences_sql, strip_sql, tokens_sql
from sparkloom.plans.text_queries import HTML_CTE, cleaned


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured documents: a section is a run of one to four turns of a conversation, every third turn stands under a heading."""
    c = read(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    under = F.when(turn % 3 == 2, F.concat(F.repeat(F.lit("#"), (turn % 6 + 1).cast("int")), F.lit(" Turn "), turn.cast("string"), F.lit("\n\n"))).otherwise("")
    block = F.concat(under, F.replace("text", F.lit("\n"), F.lit("\n\n")))
    rows = c.select(F.floor(conv / 5).cast("long").alias("doc"), conv.alias("conv"), turn.alias("turn"), F.floor(turn / (1 + conv % 4)).cast("long").alias("run"), block.alias("block"))
    joined = lambda column, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, column))), lambda x: x[column]), "\n\n")
    sections = rows.groupBy("doc", "conv", "run").agg(joined("block", ["turn"]).alias("content"))
    sections = sections.withColumns({"title": F.concat(F.lit("Part "), F.col("conv").cast("string"), F.lit("."), F.col("run").cast("string")), "level": (F.col("conv") % 6 + 1).cast("int")})
    docs = sections.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("conv", "run", "title", "level", "content"))).alias("all"))
    text = F.array_join(F.transform("all", lambda s: s["content"]), "\n\n")
    kept = F.transform("all", lambda s: F.struct(s["title"].alias("title"), s["level"].alias("level"), s["content"].alias("content")))
    name = F.concat(F.lit("talk"), F.col("doc").cast("string"))
    return docs.select(name.alias("doc_id"), F.concat(F.lit("talk:"), F.col("doc").cast("string")).alias("source_url"), F.concat(F.lit("Talk "), F.col("doc").cast("string")).alias("title"), F.lit("talks").alias("category"), text.alias("content"), kept.alias("sections"))


def chunk_structure(spark, sf_dir):
    """Sections as chunks: short ones wait for the next long one, long ones are cut in parts."""
    return longs(chunking.chunk(talks(spark, sf_dir), "structure_aware").drop("target_tokens", "overlap_tokens"))


def chunk_structure_pages(spark, sf_dir):
    return longs(chunking.chunk(cleaned(spark, sf_dir), "structure_aware").drop("target_tokens", "overlap_tokens"))


_KEPT = ("chunk_id", "doc_id", "section_title", "section_level", "token_count", "char_count", "content")


def chunk_fixed_sections(spark, sf_dir):
    return longs(chunking.chunk(talks(spark, sf_dir), "fixed").select(*_KEPT))


def chunk_overlap_sections(spark, sf_dir):
    return longs(chunking.chunk(talks(spark, sf_dir), "fixed_overlap").select(*_KEPT))


def chunk_stats_strategies(spark, sf_dir):
    """All three strategies over the same documents."""
    return longs(chunking.chunk_stats(chunking.chunk_all(talks(spark, sf_dir))))


QUERIES = {f.__name__: f for f in (chunk_structure, chunk_structure_pages, chunk_fixed_sections, chunk_overlap_sections, chunk_stats_strategies)}

_GAP = "chr(10) || chr(10)"
_TALKS = f"""
t_blocks AS (SELECT conv_id // 5 AS doc, conv_id AS conv, turn, turn // (1 + conv_id % 4) AS run, CASE WHEN turn % 3 = 2 THEN repeat('#', turn % 6 + 1) || ' Turn ' || turn || {_GAP} ELSE '' END || replace(text, chr(10), {_GAP}) AS block FROM conversations),
t_sections AS (SELECT doc, conv, run, string_agg(block, {_GAP} ORDER BY turn) AS content FROM t_blocks GROUP BY ALL),
sec AS (SELECT 'talk' || doc AS doc_id, 'talk:' || doc AS source_url, 'Talk ' || doc AS doc_title, row_number() OVER (PARTITION BY doc ORDER BY conv, run) AS n, 'Part ' || conv || '.' || run AS title, conv % 6 + 1 AS level, content FROM t_sections),
src AS (SELECT doc_id, any_value(doc_title) AS doc_title, string_agg(content, {_GAP} ORDER BY n) AS content FROM sec GROUP BY 1)
"""
_PAGE_SECTIONS = f"""{HTML_CTE},
sec AS (SELECT page_id::VARCHAR AS doc_id, url AS source_url, title AS doc_title, 1::BIGINT AS n, title, 1::BIGINT AS level, s.content FROM pages JOIN titles USING (page_id) JOIN sections s USING (page_id))"""

#: From table sec: sections joined up to the next one that is long enough, then cut where they are too long.
_STRUCTURE = f"""
s_sized AS (SELECT *, len({tokens_sql('content')}) >= 50 AS large FROM sec),
s_group AS (SELECT *, coalesce(sum(large::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g FROM s_sized),
s_joined AS (SELECT doc_id, any_value(source_url) AS source_url, any_value(doc_title) AS doc_title, g, arg_min(title, n) AS title, arg_min(level, n) AS level,
  CASE WHEN count(*) = 1 AND bool_or(large) THEN any_value(content) ELSE string_agg('### ' || title || chr(10) || content, {_GAP} ORDER BY n) END AS content FROM s_group GROUP BY doc_id, g),
s_headed AS (SELECT *, repeat('#', greatest(1, least(level, 4))) || ' ' || title AS head, len({tokens_sql('content')}) AS t FROM s_joined),
s_rooms AS (SELECT *, greatest(50, 550 - len({tokens_sql("head || ' (Part 1/1)'")})) AS room FROM s_headed),
s_paras AS (SELECT doc_id, g, room, generate_subscripts(ps, 1) AS pn, unnest(ps) AS p FROM (SELECT doc_id, g, room, {paragraphs_sql('content')} AS ps FROM s_rooms WHERE t > 550)),
s_cut AS (SELECT doc_id, g, room, pn, generate_subscripts(u, 1) AS un, unnest(u) AS unit FROM (SELECT doc_id, g, room, pn, CASE WHEN len({tokens_sql('p')}) > room THEN {sentences_sql('p')} ELSE [p] END AS u FROM s_paras)),
s_units AS (SELECT *, len({tokens_sql('unit')}) AS t, row_number() OVER (PARTITION BY doc_id, g ORDER BY pn, un) AS n FROM s_cut),
s_fold AS (
  SELECT doc_id, g, n, t::BIGINT AS size, 1::BIGINT AS k FROM s_units WHERE n = 1
  UNION ALL SELECT u.doc_id, u.g, u.n, CASE WHEN f.size + u.t > u.room AND f.size >= 50 THEN u.t ELSE f.size + u.t END, CASE WHEN f.size + u.t > u.room AND f.size >= 50 THEN f.k + 1 ELSE f.k END
  FROM s_fold f JOIN s_units u ON u.doc_id = f.doc_id AND u.g = f.g AND u.n = f.n + 1),
s_bodies AS (SELECT f.doc_id, f.g, f.k, string_agg(unit, {_GAP} ORDER BY f.n) AS body, max(max(f.k)) OVER (PARTITION BY f.doc_id, f.g) AS parts FROM s_fold f JOIN s_units u ON u.doc_id = f.doc_id AND u.g = f.g AND u.n = f.n GROUP BY 1, 2, 3),
s_texts AS (
  SELECT doc_id, source_url, doc_title, g, 1::BIGINT AS k, title, level, {strip_sql(f"head || {_GAP} || content")} AS content, false AS is_split, 1::BIGINT AS parts FROM s_rooms WHERE t <= 550
  UNION ALL SELECT r.doc_id, r.source_url, r.doc_title, r.g, b.k, r.title, r.level, {strip_sql(f"head || ' (Part ' || b.k || '/' || b.parts || ')' || {_GAP} || body")}, true, b.parts FROM s_rooms r JOIN s_bodies b ON b.doc_id = r.doc_id AND b.g = r.g),
structure AS (SELECT doc_id || '_struct_' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY g, k))::VARCHAR, 4, '0') AS chunk_id, 'structure_aware' AS strategy, doc_id, source_url, doc_title, title AS section_title, level AS section_level, content,
  len({tokens_sql('content')})::BIGINT AS token_count, length(content) AS char_count, is_split, k AS part, parts AS total_parts FROM s_texts)
"""


def _units(prefix: str, most: int) -> str:
    """From table src: paragraphs, long ones by sentence, each with the heading that it stands under."""
    walk = "OVER (PARTITION BY doc_id ORDER BY pn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
{prefix}_paras AS (SELECT doc_id, doc_title, generate_subscripts(ps, 1) AS pn, unnest(ps) AS p FROM (SELECT doc_id, doc_title, {paragraphs_sql('content')} AS ps FROM src)),
{prefix}_heads AS (SELECT *, regexp_full_match(p, '#{{1,6}}\\s+.+') AS head FROM {prefix}_paras),
{prefix}_under AS (SELECT *, coalesce(last_value(CASE WHEN head THEN {strip_sql("regexp_replace(p, '^#+', '')")} END IGNORE NULLS) {walk}, doc_title) AS section, coalesce(last_value(CASE WHEN head THEN length(regexp_extract(p, '^#+')) END IGNORE NULLS) {walk}, 1)::BIGINT AS level FROM {prefix}_heads),
{prefix}_cut AS (SELECT doc_id, section, level, pn, generate_subscripts(u, 1) AS un, unnest(u) AS unit FROM (SELECT *, CASE WHEN len({tokens_sql('p')}) > {most} THEN {sentences_sql('p')} ELSE [p] END AS u FROM {prefix}_under)),
{prefix}_sized AS (SELECT *, len({tokens_sql('unit')}) AS t FROM {prefix}_cut),
{prefix}_units AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pn, un) AS n FROM {prefix}_sized WHERE t > 0)"""


#: A chunk bears the section of the unit that closes it.
_FIXED = f"""{_units('f', 500)},
f_fold AS (
  SELECT doc_id, n, t::BIGINT AS cur, 1::BIGINT AS k FROM f_units WHERE n = 1
  UNION ALL SELECT u.doc_id, u.n, CASE WHEN f.cur + u.t > 500 AND f.cur >= 50 THEN u.t ELSE f.cur + u.t END, CASE WHEN f.cur + u.t > 500 AND f.cur >= 50 THEN f.k + 1 ELSE f.k END FROM f_fold f JOIN f_units u ON u.doc_id = f.doc_id AND u.n = f.n + 1),
f_runs AS (SELECT doc_id, k, max(n) AS last, max(cur) AS size, max(max(k)) OVER (PARTITION BY doc_id) AS ks FROM f_fold GROUP BY 1, 2),
f_tails AS (SELECT doc_id, k FROM f_runs WHERE k = ks AND k > 1 AND size < 50),
f_kept AS (SELECT r.doc_id, r.k, r.last, r.k < r.ks AS more FROM f_runs r LEFT JOIN f_tails t ON t.doc_id = r.doc_id AND t.k = r.k WHERE t.k IS NULL),
f_text AS (SELECT f.doc_id, coalesce(t.k - 1, f.k) AS k, string_agg(u.unit, {_GAP} ORDER BY f.n) AS content, sum(u.t)::BIGINT AS token_count FROM f_fold f JOIN f_units u ON u.doc_id = f.doc_id AND u.n = f.n LEFT JOIN f_tails t ON t.doc_id = f.doc_id AND t.k = f.k GROUP BY 1, 2),
fixed AS (SELECT x.doc_id || '_fixed_' || lpad(x.k::VARCHAR, 4, '0') AS chunk_id, x.doc_id, u.section AS section_title, u.level AS section_level, token_count, length(content) AS char_count, content
  FROM f_text x JOIN f_kept r ON r.doc_id = x.doc_id AND r.k = x.k JOIN f_units u ON u.doc_id = x.doc_id AND u.n = r.last + CASE WHEN more THEN 1 ELSE 0 END)"""
_OVERLAP_SECTIONS = f"""{_units('v', 100)},
v_docs AS (SELECT doc_id, list(unit ORDER BY n) AS u, list(t ORDER BY n) AS t, list(section ORDER BY n) AS s, list(level ORDER BY n) AS l, count(*) AS m FROM v_units GROUP BY 1),
v_sums AS (SELECT *, list_transform(range(m + 1), lambda i: coalesce(list_sum(t[1:i]), 0)::BIGINT) AS p FROM v_docs),
v_walk AS (
  SELECT doc_id, 1::BIGINT AS k, 0::BIGINT AS b, coalesce(list_min(list_filter(range(1, m), lambda e: p[e + 2] - p[1] > 500 AND p[e + 1] - p[1] >= 50)), m) AS e FROM v_sums
  UNION ALL SELECT doc_id, k, b, coalesce(list_min(list_filter(range(b + 1, m), lambda e: p[e + 2] - p[b + 1] > 500 AND p[e + 1] - p[b + 1] >= 50)), m)
  FROM (SELECT w.doc_id, w.k + 1 AS k, s.m, s.p, greatest(w.b + 1, coalesce(list_max(list_filter(range(w.b + 1, w.e), lambda x: s.p[w.e + 1] - s.p[x + 1] >= 100)), 0)) AS b FROM v_walk w JOIN v_sums s ON s.doc_id = w.doc_id WHERE w.e < s.m)),
overlap AS (SELECT w.doc_id || '_overlap_' || lpad(k::VARCHAR, 4, '0') AS chunk_id, w.doc_id, s.s[b + 1] AS section_title, s.l[b + 1] AS section_level, p[e + 1] - p[b + 1] AS token_count, array_to_string(u[b + 1:e], {_GAP}) AS content FROM v_walk w JOIN v_sums s ON s.doc_id = w.doc_id)"""


def _stats(strategy: str, chunks: str) -> str:
    share = lambda c: f"round(count(*) FILTER ({c}) * 100.0::DOUBLE / count(*), 2)"
    return f"""SELECT '{strategy}' AS strategy, count(*) AS total_chunks, sum(token_count)::BIGINT AS total_tokens, round(avg(token_count), 2) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens,
      round(avg(length(content)), 2) AS avg_chars, min(length(content)) AS min_chars, max(length(content)) AS max_chars, count(*) FILTER (token_count < 50) AS under_count, {share('token_count < 50')} AS under_pct,
      count(*) FILTER (token_count > 550) AS over_count, {share('token_count > 550')} AS over_pct, {share("content <> ''")} AS complete_pct FROM {chunks}"""


SQL = {
    "chunk_structure": f"WITH RECURSIVE {_TALKS}, {_STRUCTURE} SELECT * FROM structure",
    "chunk_structure_pages": f"WITH RECURSIVE {_PAGE_SECTIONS}, {_STRUCTURE} SELECT * FROM structure",
    "chunk_fixed_sections": f"WITH RECURSIVE {_TALKS}, {_FIXED} SELECT * FROM fixed",
    "chunk_overlap_sections": f"WITH RECURSIVE {_TALKS}, {_OVERLAP_SECTIONS} SELECT chunk_id, doc_id, section_title, section_level, token_count, length(content) AS char_count, content FROM overlap",
    "chunk_stats_strategies": f"WITH RECURSIVE {_TALKS}, {_STRUCTURE}, {_FIXED}, {_OVERLAP_SECTIONS} {_stats('fixed', 'fixed')} UNION ALL {_stats('fixed_overlap', 'overlap')} UNION ALL {_stats('structure_aware', 'structure')}",
}
