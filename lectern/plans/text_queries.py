"""Queries of the text and structure operators over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as TX
from lectern.functions.tokens import count_tokens, token_windows
from lectern.operators import chunking, structure
from lectern.plans.registry import query, spread, table

NOISE = "\n3 of 12 \n  \n4/9/25, 07:15 \nhttp://www.gutenberg.org/ebooks/2701 \n  kept  "


def documents(spark, sf):
    return spread(table(spark, sf, "documents"))


def _noisy(d):
    return d.withColumn("text", F.concat(F.lit("Firefox \n"), "text", F.lit(NOISE)))


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_DULL = (
    r"regexp_matches({0}, '(?i)^firefox\s*$') OR regexp_matches({0}, '^\d{{1,2}}/\d{{1,2}}/\d{{2,4}},\s*\d{{1,2}}:\d{{2}}\s*$')"
    r" OR regexp_matches({0}, '^\d+\s+of\s+\d+\s*$') OR regexp_matches({0}, '(?i)^(https?://)?(www\.)?[a-zA-Z0-9.-]*gutenberg\.org\S*\s*$')"
)


@query(
    "clean_lines",
    f"""SELECT doc_id, array_to_string(list_transform(list_filter(string_split('Firefox ' || chr(10) || text || '{NOISE}', chr(10)),
    lambda l: NOT ({_DULL.format(_TRIM.format('l'))})), lambda l: CASE WHEN {_TRIM.format('l')} = '' THEN '' ELSE l END), chr(10)) AS cleaned FROM documents""",
)
def clean_lines(spark, sf):
    return _noisy(documents(spark, sf)).select("doc_id", TX.clean_lines(F.col("text")).alias("cleaned"))


@query(
    "title_case",
    r"""WITH p AS (SELECT doc_id, 'my_' || source || '-draft.v2 ' || lang || 'É' || doc_id AS x FROM documents)
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(x, '(\p{L}+|\P{L}+)', 1), lambda w: upper(w[1:1]) || lower(w[2:])), '') AS title FROM p""",
)
def title_case(spark, sf):
    path = F.concat(F.lit("/data/in/my_"), "source", F.lit("-draft.v2 "), "lang", F.lit("É"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return documents(spark, sf).select("doc_id", TX.title_of_path(path).alias("title"))


@query("non_empty", rf"""SELECT doc_id FROM (SELECT doc_id, text AS t FROM documents UNION ALL SELECT -1 - doc_id, ' ' || chr(10) || chr(9) FROM documents UNION ALL SELECT -1 - doc_id, '' FROM documents) WHERE {_TRIM.format('t')} <> ''""")
def non_empty(spark, sf):
    from lectern.operators.store import split_empty

    d = documents(spark, sf).select("doc_id", "text")
    blank = d.select((-1 - F.col("doc_id")).alias("doc_id"), F.explode(F.array(F.lit(" \n\t"), F.lit(""))).alias("text"))
    return split_empty(d.unionByName(blank))[0].select("doc_id")


@query("clip_input", "SELECT doc_id, substr(text, 1, 8000) AS clipped FROM documents")
def clip_input(spark, sf):
    return documents(spark, sf).select("doc_id", TX.clip(F.col("text"), 8000).alias("clipped"))


@query("truncate_observation", f"SELECT doc_id, CASE WHEN length(text) <= 1200 THEN text ELSE substr(text, 1, 1200) || '{TX.CONTEXT_SUFFIX}' END AS observation FROM documents")
def truncate_observation(spark, sf):
    return documents(spark, sf).select("doc_id", TX.shorten(F.col("text"), 1200).alias("observation"))


@query("truncate_display", f"SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 400) || '{TX.DISPLAY_SUFFIX}' END AS shown FROM documents")
def truncate_display(spark, sf):
    return documents(spark, sf).select("doc_id", TX.shorten(F.col("text"), 400, TX.DISPLAY_SUFFIX).alias("shown"))


@query(
    "hit_predicate",
    """SELECT doc_id, CASE WHEN starts_with(source || '.pdf [semantic]', 'src1') AND (contains(lower(text), lower('THAT')) OR contains(lower(text), lower('queAR'))) THEN 1 ELSE 0 END AS hit FROM documents""",
)
def hit_predicate(spark, sf):
    hit = TX.is_hit(F.concat("source", F.lit(".pdf [semantic]")), F.col("text"), F.lit("src1"), F.array(F.lit("THAT"), F.lit("queAR")))
    return documents(spark, sf).select("doc_id", hit.cast("int").alias("hit"))


@query("content_hash", "SELECT doc_id, sha256(text) AS id, 'eval_semantic_' || sha256(text) AS eval_id FROM documents")
def content_hash(spark, sf):
    from lectern.operators.evaluate import eval_file_id

    return documents(spark, sf).select("doc_id", TX.content_hash(F.col("text")).alias("id"), eval_file_id(F.col("text"), "semantic").alias("eval_id"))


@query("word_count", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::BIGINT AS words FROM documents")
def word_count(spark, sf):
    return documents(spark, sf).select("doc_id", TX.word_count(F.col("text")).alias("words"))


@query(
    "strip_context",
    rf"""WITH c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'Context: A > B' || chr(10) || 'Content: ' || text ELSE 'Context: A' || chr(10) || 'Table Data:' || text END AS t FROM documents)
SELECT doc_id, CASE WHEN starts_with(t, 'Context: ') AND contains(t, chr(10) || 'Content:') THEN {_TRIM.format("substr(t, instr(t, chr(10) || 'Content:') + 9)")} ELSE t END AS content FROM c""",
)
def strip_context(spark, sf):
    k, t = F.col("doc_id") % 3, F.col("text")
    text = F.when(k == 0, t).when(k == 1, F.concat(F.lit("Context: A > B\nContent: "), t)).otherwise(F.concat(F.lit("Context: A\nTable Data:"), t))
    return documents(spark, sf).select("doc_id", TX.strip_context(text).alias("content"))


SENTENCES_SQL = rf"""
marked AS (SELECT {{key}}, regexp_replace(regexp_replace({_TRIM.format('{text}')}, '([.!?])(\s+)', '\1' || chr(1) || '\2', 'g'),
  '(\b(?:Mr|Mrs|Dr|St|Jr|Sr)\.|\s[A-Z]\.|^[A-Z]\.)' || chr(1), '\1', 'g') AS m FROM {{source}}),
sentence_lists AS (SELECT {{key}}, list_filter(list_transform(string_split(regexp_replace(m, chr(1) || '\s+', chr(2), 'g'), chr(2)), lambda s: {_TRIM.format('s')}), lambda s: s <> '') AS ss FROM marked),
sentence_rows AS (SELECT {{key}}, unnest(generate_series(0, len(ss) - 1)) AS idx, unnest(ss) AS sentence FROM sentence_lists)"""


@query("sentences", f"WITH {SENTENCES_SQL.format(key='doc_id', text='text', source='documents')} SELECT doc_id, idx, sentence FROM sentence_rows")
def sentences(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(TX.sentences(F.col("text"))).alias("idx", "sentence")).withColumn("idx", F.col("idx").cast("long"))


# --- structure: documents have none, so headings, a table and a list are put around their text ---

MARKDOWN_SQL = r"""md AS (SELECT doc_id, 'Lead in.' || chr(10) || chr(10) || '# Source ' || source || chr(10) || chr(10) || text || chr(10) || chr(10) || '### Facts' || chr(10) || '| k | v |' || chr(10) || '|---|---|' || chr(10) || '| lang | ' || lang
  || ' |' || chr(10) || chr(10) || '- id ' || doc_id || chr(10) || '- chars ' || n_chars || chr(10) || '## End' || chr(10) || 'Done. All of it.' || chr(10) || chr(10) || 'Really done.' || chr(10) || '#### Deeper' || chr(10) || 'Yes.' AS md FROM documents)"""
STRUCTURE_SQL = rf"""{MARKDOWN_SQL},
line_lists AS (SELECT doc_id, string_split(md, chr(10)) AS l FROM md),
raw_lines AS (SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS line, unnest(l) AS raw FROM line_lists),
bare_lines AS (SELECT *, {_TRIM.format('raw')} AS bare FROM raw_lines),
classed AS (SELECT *, CASE WHEN bare = '' THEN 'B' WHEN regexp_matches(bare, '^\|.*\|$') THEN 'T' WHEN regexp_matches(bare, '^(#{{1,6}})\s+(.*)$') THEN 'H'
  WHEN regexp_matches(raw, '^(\s*)[-\*\+]\s+(.*)$') THEN 'L' ELSE 'P' END AS cls FROM bare_lines),
leveled AS (SELECT *, CASE WHEN cls = 'H' THEN length(regexp_extract(bare, '^(#{{1,6}})\s+(.*)$', 1)) END AS level,
  CASE WHEN cls = 'H' THEN regexp_replace(bare, '^#+\s+', '') END AS heading FROM classed),
pathed AS (SELECT *, {", ".join(f"last_value(CASE WHEN level = {n} THEN struct_pack(line := line, h := heading) END IGNORE NULLS) OVER so_far AS h{n}" for n in range(1, 7))},
  CASE WHEN cls = 'H' OR lag(cls) OVER (PARTITION BY doc_id ORDER BY line) IS DISTINCT FROM cls THEN 1 ELSE 0 END AS fresh
  FROM leveled WINDOW so_far AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line) AS run, array_to_string(list_filter([
  {", ".join(f"CASE WHEN h{n}.line > greatest(-1, {', '.join(f'coalesce(h{m}.line, -1)' for m in range(1, n)) or '-1'}) THEN h{n}.h END" for n in range(1, 7))}], lambda x: x IS NOT NULL), ' > ') AS path FROM pathed),
block_rows AS (SELECT doc_id, run, CASE cls WHEN 'H' THEN 'HEADING' WHEN 'T' THEN 'TABLE' WHEN 'L' THEN 'LIST' ELSE 'PARAGRAPH' END AS node_type, max(level)::BIGINT AS level,
  CASE WHEN cls = 'H' THEN max(heading) WHEN cls = 'P' THEN string_agg(bare, ' ' ORDER BY line) ELSE string_agg(raw, chr(10) ORDER BY line) END AS text,
  min(line)::BIGINT AS line_number, CASE WHEN cls = 'T' THEN count(*)::BIGINT END AS row_count, arg_min(path, line) AS path FROM runs WHERE cls <> 'B' GROUP BY doc_id, run, cls),
blocks AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1)::BIGINT AS block FROM block_rows)"""


def markdown(spark, sf):
    facts = F.concat(F.lit("\n\n### Facts\n| k | v |\n|---|---|\n| lang | "), "lang", F.lit(" |\n\n- id "), F.col("doc_id").cast("string"), F.lit("\n- chars "), F.col("n_chars").cast("string"), F.lit("\n## End\nDone. All of it.\n\nReally done.\n#### Deeper\nYes."))
    return documents(spark, sf).select("doc_id", F.concat(F.lit("Lead in.\n\n# Source "), "source", F.lit("\n\n"), "text", facts).alias("text"))


def _blocks(spark, sf):
    found = structure.blocks(markdown(spark, sf), "doc_id")
    return found.withColumns({c: F.col(c).cast("long") for c in ("block", "level", "line_number", "row_count")})


@query("classify_lines", f"WITH {STRUCTURE_SQL} SELECT doc_id, line::BIGINT AS line, cls, level::BIGINT AS level, heading FROM leveled")
def classify_lines(spark, sf):
    found = structure.classify_lines(markdown(spark, sf), "doc_id")
    return found.select("doc_id", F.col("line").cast("long").alias("line"), "cls", F.col("level").cast("long").alias("level"), "heading")


@query("blocks", f"WITH {STRUCTURE_SQL} SELECT doc_id, block, node_type, level, line_number, row_count FROM blocks")
def blocks(spark, sf):
    return _blocks(spark, sf).select("doc_id", "block", "node_type", "level", "line_number", "row_count")


@query("block_text", f"WITH {STRUCTURE_SQL} SELECT doc_id, block, text FROM blocks")
def block_text(spark, sf):
    return _blocks(spark, sf).select("doc_id", "block", "text")


@query("breadcrumbs", f"WITH {STRUCTURE_SQL} SELECT doc_id, block, path FROM blocks")
def breadcrumbs(spark, sf):
    return _blocks(spark, sf).select("doc_id", "block", F.array_join("path", " > ").alias("path"))


@query("collect_sentences", f"WITH {STRUCTURE_SQL}, prose AS (SELECT doc_id, block, text FROM blocks WHERE node_type = 'PARAGRAPH'), {SENTENCES_SQL.format(key='doc_id, block', text='text', source='prose')} SELECT doc_id, block, idx, sentence FROM sentence_rows")
def collect_sentences(spark, sf):
    return chunking.sentences_of(_blocks(spark, sf), "doc_id").withColumn("idx", F.col("idx").cast("long"))


def _rendered(spark, sf, node_type):
    rows = _blocks(spark, sf).where(F.col("node_type") == node_type)
    return rows.select("doc_id", "block", chunking.render(F.col("path"), F.col("text"), node_type).alias("rendered"))


def _render_sql(node_type, label):
    return f"WITH {STRUCTURE_SQL} SELECT doc_id, block, CASE WHEN path <> '' THEN 'Context: ' || path || chr(10) || '{label}' || text ELSE text END AS rendered FROM blocks WHERE node_type = '{node_type}'"


@query("render_prose", _render_sql("PARAGRAPH", "Content: "))
def render_prose(spark, sf):
    return _rendered(spark, sf, "PARAGRAPH")


@query("render_list", _render_sql("LIST", "Content:\n"))
def render_list(spark, sf):
    return _rendered(spark, sf, "LIST")


@query("render_table", _render_sql("TABLE", "Table Data:\n"))
def render_table(spark, sf):
    return _rendered(spark, sf, "TABLE")


def windows_sql(max_tokens: int, overlap: int, source: str = "documents") -> str:
    step = max_tokens - overlap if 0 <= overlap < max_tokens else max_tokens
    return rf"""
token_lists AS (SELECT doc_id, text, regexp_extract_all(text, '(\s*\S+|\s+)', 1) AS t FROM {source}),
starts AS (SELECT doc_id, text, t, unnest(generate_series(0, CASE WHEN len(t) <= {max_tokens} THEN 0 ELSE CAST(ceil((len(t) - {max_tokens}) / {step}.0) AS BIGINT) END)) AS k FROM token_lists),
pieces AS (SELECT doc_id, k AS chunk_index, CASE WHEN len(t) <= {max_tokens} THEN text ELSE array_to_string(t[k * {step} + 1 : k * {step} + {max_tokens}], '') END AS text_data FROM starts)"""


@query("token_windows", f"WITH {windows_sql(50, 10)} SELECT doc_id, chunk_index, text_data FROM pieces")
def token_windows_query(spark, sf):
    found = documents(spark, sf).select("doc_id", F.posexplode(token_windows(F.col("text"), 50, 10)).alias("chunk_index", "text_data"))
    return found.withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query("baseline_chunks", f"WITH {windows_sql(400, 100)} SELECT doc_id, chunk_index, text_data FROM pieces")
def baseline_chunks(spark, sf):
    return chunking.baseline_chunks(documents(spark, sf), key="doc_id").withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query("token_count", r"SELECT doc_id, len(regexp_extract_all(text, '(\s*\S+|\s+)', 1))::BIGINT AS tokens FROM documents")
def token_count(spark, sf):
    return documents(spark, sf).select("doc_id", count_tokens(F.col("text")).alias("tokens"))


@query("chunk_ids", f"WITH {windows_sql(400, 100)} SELECT doc_id, chunk_index, 'chk_' || substr(sha256(doc_id || ':' || chunk_index), 1, 16) AS chunk_id FROM pieces")
def chunk_ids(spark, sf):
    return baseline_chunks(spark, sf).select("doc_id", "chunk_index", TX.chunk_id(F.col("doc_id").cast("string"), F.col("chunk_index")).alias("chunk_id"))


@query("chunk_index", f"WITH {STRUCTURE_SQL} SELECT doc_id, block, (row_number() OVER (PARTITION BY doc_id ORDER BY line_number) - 1)::BIGINT AS chunk_index FROM blocks WHERE node_type <> 'HEADING'")
def chunk_index(spark, sf):
    from pyspark.sql import Window as W

    rows = _blocks(spark, sf).where("node_type <> 'HEADING'")
    return rows.select("doc_id", "block", (F.row_number().over(W.partitionBy("doc_id").orderBy("line_number")) - 1).cast("long").alias("chunk_index"))


def merge_sql(rows: str, order: str, others: str) -> str:
    """CTEs that end in merged: ``rows`` (doc_id, order columns, node_type, text, content, others) with small prose folded into prose before it."""
    first = ", ".join(f"arg_min({c}, pos) AS {c}" for c in f"{order}, {others}".split(", "))
    return f"""placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS pos FROM {rows}),
folds AS (SELECT *, CASE WHEN node_type = 'PARAGRAPH' AND lag(node_type) OVER w = 'PARAGRAPH' AND len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) < 50 THEN 0 ELSE 1 END AS fresh
  FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS merge_run FROM folds),
merged AS (SELECT doc_id, {first}, string_agg(CASE WHEN fresh = 1 THEN text ELSE content END, ' ' ORDER BY pos) AS text, count(*)::BIGINT AS n_merged FROM numbered GROUP BY doc_id, merge_run)"""


RENDER_SQL = """CASE WHEN path = '' THEN {body} WHEN node_type = 'TABLE' THEN 'Context: ' || path || chr(10) || 'Table Data:' || chr(10) || {body}
  WHEN node_type = 'LIST' THEN 'Context: ' || path || chr(10) || 'Content:' || chr(10) || {body} ELSE 'Context: ' || path || chr(10) || 'Content: ' || {body} END"""


@query("merge_undersized", f"WITH {STRUCTURE_SQL}, rendered AS (SELECT doc_id, block, node_type, {RENDER_SQL.format(body='text')} AS text, text AS content FROM blocks WHERE node_type <> 'HEADING'), {merge_sql('rendered', 'block', 'node_type')} SELECT doc_id, block, node_type, text, n_merged FROM merged")
def merge_undersized(spark, sf):
    rows = _blocks(spark, sf).where("node_type <> 'HEADING'")
    kind, path, body = F.col("node_type"), F.col("path"), F.col("text")
    text = F.when(kind == "TABLE", chunking.render(path, body, "TABLE")).when(kind == "LIST", chunking.render(path, body, "LIST")).otherwise(chunking.render(path, body, "PARAGRAPH"))
    rows = rows.select("doc_id", "block", "node_type", text.alias("text"), F.lit(None).cast("array<double>").alias("embeddings"))
    return chunking.merge_undersized(rows, "doc_id", ["block"]).select("doc_id", "block", "node_type", "text", "n_merged")


def pipeline_sql(pooled: bool) -> str:
    """All steps of the chunk pipeline; ``vector_sum`` is the sum of a vector's elements, each times its place."""
    from lectern.plans.vector_queries import hash_sql

    token = r"regexp_extract_all({0}, '(\s*\S+|\s+)', 1)"
    words = r"len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda w: w <> ''))"
    sql = rf"""WITH RECURSIVE {STRUCTURE_SQL},
prose AS (SELECT doc_id, block, text FROM blocks WHERE node_type = 'PARAGRAPH'), {SENTENCES_SQL.format(key='doc_id, block', text='text', source='prose')},
{hash_sql('sentence_rows', 'doc_id, block, idx', 'sentence', 'sv')},
sized AS (SELECT doc_id, block, idx, sentence, {words} AS words, count(*) OVER (PARTITION BY doc_id, block) AS n FROM sentence_rows),
dense AS (SELECT s.doc_id, s.block, s.idx, s.n, d.b, coalesce(v.x, 0) AS x FROM sized s CROSS JOIN (SELECT unnest(range(64)) AS b) d LEFT JOIN sv_unit v ON v.doc_id = s.doc_id AND v.block = s.block AND v.idx = s.idx AND v.b = d.b WHERE s.n >= 6),
beside AS (SELECT doc_id, block, idx, n, sum(x) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS l, sum(x) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS r FROM dense WINDOW w AS (PARTITION BY doc_id, block, b ORDER BY idx)),
dots AS (SELECT doc_id, block, idx, round(1.0 - sum(l * r) / (CASE WHEN sum(l * l) = 0 THEN 1 ELSE sqrt(sum(l * l)) END * CASE WHEN sum(r * r) = 0 THEN 1 ELSE sqrt(sum(r * r)) END), 9) AS distance FROM beside WHERE idx >= 2 AND idx < n - 3 GROUP BY ALL),
bounds AS (SELECT doc_id, block, idx, distance > round(avg(distance) OVER g + 0.8 * stddev_pop(distance) OVER g, 9) AS far FROM dots WINDOW g AS (PARTITION BY doc_id, block)),
spoken AS (SELECT s.doc_id, s.block, s.idx, s.sentence, s.words, coalesce(b.far, false) AS is_boundary FROM sized s LEFT JOIN bounds b USING (doc_id, block, idx)),
fold AS (SELECT doc_id, block, idx, 0::BIGINT AS piece, 1::BIGINT AS n, words AS w, is_boundary AND words >= 50 AS cut FROM spoken WHERE idx = 0
  UNION ALL SELECT s.doc_id, s.block, s.idx, f.piece + CASE WHEN f.cut THEN 1 ELSE 0 END, CASE WHEN f.cut THEN 1 ELSE f.n + 1 END, CASE WHEN f.cut THEN s.words ELSE f.w + s.words END,
    s.is_boundary AND (CASE WHEN f.cut THEN 1 ELSE f.n + 1 END >= 2 OR CASE WHEN f.cut THEN s.words ELSE f.w + s.words END >= 50) FROM spoken s JOIN fold f ON s.doc_id = f.doc_id AND s.block = f.block AND s.idx = f.idx + 1),
flushed AS (SELECT doc_id, block, piece, string_agg(sentence, ' ' ORDER BY idx) AS body FROM fold JOIN sized USING (doc_id, block, idx) GROUP BY ALL),
pool_sums AS (SELECT doc_id, block, piece, b, sum(x) AS x FROM fold JOIN sv_unit USING (doc_id, block, idx) GROUP BY ALL),
pooled AS (SELECT doc_id, block, piece, sum((b + 1) * x) / sqrt(sum(x * x)) AS pool_sum FROM pool_sums GROUP BY ALL),
bodies AS (SELECT doc_id, block, piece, body FROM flushed UNION ALL SELECT doc_id, block, 0, text FROM blocks WHERE node_type IN ('LIST', 'TABLE')),
about AS (SELECT o.doc_id, o.block, piece, body, node_type, path, line_number, row_count, coalesce(pool_sum, 0) AS pool_sum, {token.format('body')} AS t FROM bodies o JOIN blocks USING (doc_id, block) LEFT JOIN pooled USING (doc_id, block, piece)),
cuts AS (SELECT *, unnest(generate_series(0, CASE WHEN len(t) <= 400 OR node_type = 'TABLE' THEN 0 ELSE CAST(ceil((len(t) - 400) / 300.0) AS BIGINT) END)) AS sub FROM about),
cut_bodies AS (SELECT * EXCLUDE (body, t), CASE WHEN len(t) <= 400 OR node_type = 'TABLE' THEN body ELSE array_to_string(t[sub * 300 + 1 : sub * 300 + 400], '') END AS body FROM cuts),
rendered AS (SELECT *, {RENDER_SQL.format(body='body')} AS text, CASE WHEN path = '' THEN body ELSE {_TRIM.format('body')} END AS content, CASE WHEN node_type <> 'TABLE' THEN len({token.format('body')}) END AS own_tokens FROM cut_bodies),
{merge_sql('rendered', 'block, piece, sub', 'node_type, path, line_number, row_count, pool_sum, own_tokens')},
chunk_rows AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY block, piece, sub) - 1)::BIGINT AS chunk_index, CASE WHEN n_merged > 1 THEN len({token.format('text')}) ELSE own_tokens END::BIGINT AS token_count FROM merged),
{hash_sql('chunk_rows', 'doc_id, chunk_index', 'text', 'cv')},
sums AS (SELECT doc_id, chunk_index, sum((b + 1) * x) AS text_sum FROM cv_unit GROUP BY ALL)
SELECT doc_id, 'chk_' || substr(sha256(doc_id || ':' || chunk_index), 1, 16) AS chunk_id, chunk_index, node_type, path, line_number, row_count, token_count, text AS text_data, round({{vector}}, 5) AS vector_sum FROM chunk_rows LEFT JOIN sums USING (doc_id, chunk_index)"""
    return sql.replace("{vector}", "CASE WHEN n_merged = 1 AND node_type = 'PARAGRAPH' THEN pool_sum ELSE coalesce(text_sum, 0) END" if pooled else "coalesce(text_sum, 0)")


def _pipeline(spark, sf, strategy):
    from lectern.config import Settings

    made = chunking.chunk_documents(markdown(spark, sf), Settings(chunk_embedding_strategy=strategy), key="doc_id")
    total = F.aggregate(F.transform("embeddings", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    longs = [F.col(c).cast("long").alias(c) for c in ("chunk_index", "line_number", "row_count", "token_count")]
    return made.select("doc_id", "chunk_id", "node_type", F.array_join("structural_path", " > ").alias("path"), *longs, "text_data", F.round(total, 5).alias("vector_sum"))


@query("chunk_pipeline", pipeline_sql(False))
def chunk_pipeline(spark, sf):
    return _pipeline(spark, sf, "hybrid")


@query("chunk_pipeline_vector_math", pipeline_sql(True))
def chunk_pipeline_vector_math(spark, sf):
    return _pipeline(spark, sf, "vector_math")
