"""Queries of the catalogue, evaluation and transcript operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import embedding as E
from lectern.functions import text as TX
from lectern.functions.tokens import token_windows
from lectern.operators import agent, evaluate, search, store
from lectern.plans.registry import query, scratch, spread, table
from lectern.plans.text_queries import windows_sql
from lectern.plans.vector_queries import hash_sql


def _incoming(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.concat_ws("-", "source", "lang", F.col("doc_id").cast("string")).alias("title"), "text", "doc_id", "source")


def files(spark, sf):
    """The catalogue after all documents were saved: one row for each different text."""
    rows = store.as_files(_incoming(spark, sf))
    return store.new_files(rows, rows.where(F.lit(False)))


FILES_SQL = """incoming AS (SELECT sha256(text) AS id, source || '-' || lang || '-' || doc_id AS title, text AS extracted_text, doc_id, source FROM documents),
files AS (SELECT id, min(title) AS title, min(extracted_text) AS extracted_text FROM incoming GROUP BY id)"""


def _hash_of(spark, sf, doc_id=7):
    return table(spark, sf, "documents").where(F.col("doc_id") == doc_id).select(F.sha2("text", 256)).first()[0]


@query("get_document", f"WITH {FILES_SQL} SELECT id, title, extracted_text FROM files WHERE id = (SELECT sha256(text) FROM documents WHERE doc_id = 7)")
def get_document(spark, sf):
    return store.get_document(files(spark, sf), _hash_of(spark, sf))


@query("list_documents", f"WITH {FILES_SQL} SELECT id, title FROM files")
def list_documents(spark, sf):
    return store.list_documents(files(spark, sf))


@query("resolve_title", f"WITH {FILES_SQL} SELECT id, title FROM files WHERE title ILIKE '%SRC7_en%' ORDER BY length(title), id LIMIT 1")
def resolve_title(spark, sf):
    return store.resolve(files(spark, sf), "SRC7_en")


@query("resolve_id", f"WITH {FILES_SQL} SELECT id, title FROM files WHERE id = (SELECT sha256(text) FROM documents WHERE doc_id = 7)")
def resolve_id(spark, sf):
    return store.resolve(files(spark, sf), _hash_of(spark, sf))


def _chunk_rows(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.concat(F.lit("chk_"), F.substring(F.sha2(F.col("vec_id").cast("string"), 256), 1, 16)).alias("id"), F.concat(F.lit("f"), F.col("label").cast("string")).alias("file_id"), F.col("vec_id").alias("chunk_index"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text_data"))


CHUNK_SQL = "chunks AS (SELECT 'chk_' || substr(sha256(vec_id::VARCHAR), 1, 16) AS id, 'f' || label AS file_id, vec_id AS chunk_index, 'text ' || vec_id AS text_data FROM embeddings)"


@query("read_chunk", f"WITH {CHUNK_SQL} SELECT id, file_id, chunk_index, text_data AS text FROM chunks WHERE id = 'chk_' || substr(sha256('17'), 1, 16)")
def read_chunk(spark, sf):
    import hashlib

    return store.read_chunk(_chunk_rows(spark, sf), "chk_" + hashlib.sha256(b"17").hexdigest()[:16])


EVAL_SQL = """eval_files AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'eval_semantic_' WHEN 1 THEN 'evalXsemantic_' ELSE '' END || sha256(text) AS id, doc_id FROM documents)"""


def _eval_files(spark, sf):
    k = F.col("doc_id") % 3
    mark = F.when(k == 0, "eval_semantic_").when(k == 1, "evalXsemantic_").otherwise("")
    return table(spark, sf, "documents").select(F.concat(mark, F.sha2("text", 256)).alias("id"), "doc_id")


@query("like_strategy", f"WITH {EVAL_SQL} SELECT doc_id, id FROM eval_files WHERE id LIKE 'eval_semantic_%'")
def like_strategy(spark, sf):
    return _eval_files(spark, sf).where(F.col("id").like("eval_semantic_%")).select("doc_id", "id")


@query("strategy_prefix", f"WITH {EVAL_SQL} SELECT doc_id, id FROM eval_files WHERE starts_with(id, 'eval_semantic_')")
def strategy_prefix(spark, sf):
    return store.of_strategy(_eval_files(spark, sf), "semantic").select("doc_id", "id")


@query("eval_join", f"WITH {EVAL_SQL}, {windows_sql(400, 100)} SELECT f.doc_id, f.id AS file_id, p.chunk_index, p.text_data FROM eval_files f JOIN pieces p ON f.doc_id = p.doc_id WHERE f.id LIKE 'eval_semantic_%'")
def eval_join(spark, sf):
    from lectern.operators.chunking import baseline_chunks

    kept = _eval_files(spark, sf).where(F.col("id").like("eval_semantic_%")).select("doc_id", F.col("id").alias("file_id"))
    made = baseline_chunks(spread(table(spark, sf, "documents").select("doc_id", "text")), key="doc_id")
    return kept.join(made, "doc_id").select("doc_id", "file_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text_data")


@query("json_dataset_titles", "SELECT DISTINCT 'Item ' || (item_id % 10) AS document_title FROM benchmark ORDER BY 1")
def json_dataset_titles(spark, sf):
    """From an evaluation set that is written as a JSON array, and read as users' sets are."""
    from lectern.sources.files import question_titles, read_questions

    entry = F.struct(F.col("text").alias("query"), F.concat(F.lit("Item "), (F.col("item_id") % 10).cast("string")).alias("document_title"), F.array("text").alias("expected_substrings"), F.lit("").alias("reference_answer"))
    path = scratch(spark, "questions")
    table(spark, sf, "benchmark").agg(F.to_json(F.collect_list(entry)).alias("value")).write.text(path)
    return question_titles(read_questions(spark, path))


@query("dedupe_incoming", f"WITH {FILES_SQL} SELECT id, min(title) AS title FROM incoming WHERE id NOT IN (SELECT id FROM incoming WHERE source = 'src3') GROUP BY id")
def dedupe_incoming(spark, sf):
    known = _incoming(spark, sf).where("source = 'src3'")
    return store.new_files(store.as_files(_incoming(spark, sf)), store.as_files(known)).select("id", "title")


@query("save_dedupe", f"WITH {FILES_SQL} SELECT doc_id, CASE WHEN id IN (SELECT id FROM incoming WHERE source = 'src3') THEN 'duplicate' ELSE 'new' END AS outcome FROM incoming")
def save_dedupe(spark, sf):
    known = store.as_files(_incoming(spark, sf).where("source = 'src3'")).select("id").distinct().withColumn("_there", F.lit(True))
    rows = _incoming(spark, sf).select("doc_id", TX.content_hash(F.col("text")).alias("id"))
    return rows.join(known, "id", "left").select("doc_id", F.when(F.col("_there"), "duplicate").otherwise("new").alias("outcome"))


@query("delete_in", f"WITH {FILES_SQL} SELECT id, title FROM files WHERE id NOT IN (SELECT id FROM incoming WHERE source = 'src3')")
def delete_in(spark, sf):
    gone = store.as_files(_incoming(spark, sf).where("source = 'src3'")).select("id")
    none = spark.createDataFrame([], "id string, file_id string")
    return store.delete_documents(files(spark, sf), none, gone)[0].select("id", "title")


@query("delete_document", f"WITH {CHUNK_SQL} SELECT id FROM chunks WHERE file_id <> 'f4'")
def delete_document(spark, sf):
    chunks = _chunk_rows(spark, sf)
    parents = chunks.select(F.col("file_id").alias("id")).distinct()
    return store.delete_documents(parents, chunks, spark.createDataFrame([("f4",)], "id string"))[1].select("id")


@query("cleanup_eval", f"WITH {EVAL_SQL} SELECT doc_id FROM eval_files WHERE NOT starts_with(id, 'eval_')")
def cleanup_eval(spark, sf):
    rows = _eval_files(spark, sf)
    return store.cleanup_eval(rows, rows.select(F.col("id").alias("file_id")))[0].select("doc_id")


@query("cleanup_count", f"WITH {EVAL_SQL} SELECT count(DISTINCT id) AS removed FROM eval_files WHERE starts_with(id, 'eval_')")
def cleanup_count(spark, sf):
    rows = _eval_files(spark, sf)
    return store.cleanup_eval(rows, rows.select(F.col("id").alias("file_id")))[2].agg(F.countDistinct("id").alias("removed"))


# --- citations and transcripts: conversations serve as transcripts ---

ANSWERS_SQL = f"""{CHUNK_SQL}, answers AS (SELECT conv_id * 1000 + turn AS answer_id, text || ' see chk_' || substr(sha256((conv_id * 2 + turn)::VARCHAR), 1, 16) || ' and chk_' || substr(sha256((turn + 100000)::VARCHAR), 1, 12) || '.' AS answer FROM conversations WHERE text IS NOT NULL),
cited AS (SELECT answer_id, unnest(list_sort(list_distinct(regexp_extract_all(answer, 'chk_[0-9a-f]{{6,}}')))) AS chunk_id FROM answers)"""


def _answers(spark, sf):
    c = table(spark, sf, "conversations").where("text IS NOT NULL")
    short = lambda e, n: F.substring(F.sha2(e.cast("string"), 256), 1, n)
    text = F.concat("text", F.lit(" see chk_"), short(F.col("conv_id") * 2 + F.col("turn"), 16), F.lit(" and chk_"), short(F.col("turn") + 100000, 12), F.lit("."))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), text.alias("answer"))


@query("citations", f"WITH {ANSWERS_SQL} SELECT answer_id, chunk_id FROM cited")
def citations(spark, sf):
    return _answers(spark, sf).select("answer_id", F.explode(TX.citations(F.col("answer"))).alias("chunk_id"))


@query("citation_anti", f"WITH {ANSWERS_SQL} SELECT DISTINCT chunk_id FROM cited WHERE chunk_id NOT IN (SELECT id FROM chunks)")
def citation_anti(spark, sf):
    return store.cited_but_missing(citations(spark, sf), _chunk_rows(spark, sf))


@query("validate_citations", f"""WITH {ANSWERS_SQL}, bad AS (SELECT answer_id, list(chunk_id ORDER BY chunk_id) AS unverified FROM cited WHERE chunk_id NOT IN (SELECT id FROM chunks) GROUP BY answer_id)
SELECT a.answer_id, list_reduce(list_prepend(a.answer, coalesce(b.unverified, [])), lambda t, x: replace(t, x, '{agent.REMOVED}')) AS cleaned, coalesce(array_to_string(b.unverified, ','), '') AS unverified FROM answers a LEFT JOIN bad b USING (answer_id)""")
def validate_citations(spark, sf):
    found = agent.validate_citations(_answers(spark, sf), _chunk_rows(spark, sf))
    return found.select("answer_id", "cleaned", F.array_join("unverified", ",").alias("unverified"))


STEPS_SQL = r"""steps AS (SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'Thought: x' || chr(10) || 'Action: search_document' || chr(10) || 'Action Input: {"query": "a", "b": {"c": 1}}' WHEN 1 THEN 'Final Answer: done ' || turn || chr(10) || 'ok '
  WHEN 2 THEN 'Action: list_documents' || chr(10) || 'Action Input: {}' WHEN 3 THEN coalesce(text, '') ELSE 'Action: read_chunk' || chr(10) || 'Action Input: {"chunk_id": "c"}' || chr(10) || 'Final Answer: both' END AS r,
  CASE WHEN turn % 3 = 0 THEN 'Error: none' ELSE '[]' END AS observation FROM conversations),
parsed AS (SELECT *, CASE WHEN regexp_matches(r, 'Action:\s*(\w+)') THEN regexp_extract(r, 'Action:\s*(\w+)', 1) END AS tool, CASE WHEN regexp_matches(r, '(?s)Action Input:\s*(\{.*?\})') THEN regexp_extract(r, '(?s)Action Input:\s*(\{.*?\})', 1) END AS tool_input,
  CASE WHEN contains(r, 'Final Answer:') THEN trim(regexp_extract(r, '(?s)Final Answer:\s*(.*)', 1)) END AS final_answer FROM steps),
gated AS (SELECT *, coalesce(max(CASE WHEN coalesce(tool IN ('search_all_documents', 'search_document', 'read_chunk'), false) AND tool_input IS NOT NULL AND NOT starts_with(observation, 'Error') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS got FROM parsed)"""


def _steps(spark, sf):
    c = table(spark, sf, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 5
    response = (
        F.when(k == 0, 'Thought: x\nAction: search_document\nAction Input: {"query": "a", "b": {"c": 1}}')
        .when(k == 1, F.concat(F.lit("Final Answer: done "), F.col("turn").cast("string"), F.lit("\nok ")))
        .when(k == 2, "Action: list_documents\nAction Input: {}").when(k == 3, F.coalesce("text", F.lit("")))
        .otherwise('Action: read_chunk\nAction Input: {"chunk_id": "c"}\nFinal Answer: both')
    )
    return c.select("conv_id", "turn", response.alias("llm_raw_response"), F.when(F.col("turn") % 3 == 0, "Error: none").otherwise("[]").alias("observation"))


@query("parse_agent_output", f"WITH {STEPS_SQL} SELECT conv_id, turn, tool, tool_input, final_answer FROM parsed")
def parse_agent_output(spark, sf):
    return agent.parse_transcript(_steps(spark, sf)).select("conv_id", "turn", "tool", "tool_input", "final_answer")


@query("retrieval_gate", f"""WITH {STEPS_SQL} SELECT conv_id, turn, got AS has_retrieved, CASE WHEN final_answer IS NOT NULL AND NOT (tool IS NOT NULL AND tool_input IS NOT NULL AND got = 0) THEN CASE WHEN got = 1 THEN 'final_answer' ELSE 'premature_final_answer' END
  WHEN tool IS NOT NULL AND tool_input IS NOT NULL THEN 'action' ELSE 'malformed' END AS step_type FROM gated""")
def retrieval_gate(spark, sf):
    typed = agent.type_steps(agent.parse_transcript(_steps(spark, sf)), "conv_id", "turn")
    return typed.select("conv_id", "turn", F.col("has_retrieved").cast("int").alias("has_retrieved"), "step_type")


@query("tool_json", f"""WITH {CHUNK_SQL} SELECT id, '{{"id":"' || id || '","file_id":"' || file_id || '","chunk_index":' || chunk_index || ',"text":"' || text_data || '"}}' AS json FROM chunks""")
def tool_json(spark, sf):
    c = _chunk_rows(spark, sf)
    return c.select("id", F.to_json(F.struct("id", "file_id", "chunk_index", F.col("text_data").alias("text"))).alias("json"))


# --- evaluation: benchmark items are the questions, and what a hit must hold ---

SIZES = {"baseline": (400, 100), "semantic": (120, 30)}


def _cut(docs):
    """Chunks (chunk_id, strategy, doc_id, text) of two strategies, as one table; texts are read once for both."""
    kinds = F.array(*[F.struct(F.lit(n).alias("strategy"), token_windows(F.col("text"), size, overlap).alias("pieces")) for n, (size, overlap) in SIZES.items()])
    each = docs.select("doc_id", F.explode_outer(kinds).alias("s")).select("doc_id", "s.strategy", F.posexplode_outer("s.pieces").alias("k", "text")).where("k IS NOT NULL")
    return each.select(F.concat_ws("_", "strategy", F.col("doc_id").cast("string"), F.col("k").cast("string")).alias("chunk_id"), "strategy", "doc_id", "text")


def _corpus(spark, sf):
    return _cut(spread(table(spark, sf, "documents").select("doc_id", "text")))


CORPUS_SQL = "".join(f"{n}_docs AS (SELECT * FROM documents), {windows_sql(a, b, f'{n}_docs').replace('token_lists', f'{n}_tokens').replace('starts', f'{n}_starts').replace('pieces', f'{n}_pieces')}," for n, (a, b) in SIZES.items())
CORPUS_SQL += " UNION ALL ".join(f"{'corpus AS (' if i == 0 else ''}SELECT '{n}_' || doc_id || '_' || chunk_index AS chunk_id, '{n}' AS strategy, doc_id, text_data AS text FROM {n}_pieces" for i, n in enumerate(SIZES)) + ")"


@query("union_strategies", f"WITH {CORPUS_SQL} SELECT chunk_id, strategy, doc_id FROM corpus")
def union_strategies(spark, sf):
    return _corpus(spark, sf).select("chunk_id", "strategy", "doc_id")


@query("corpus_stats", f"WITH {CORPUS_SQL}, old AS (SELECT 'baseline' AS strategy, count(DISTINCT doc_id) AS skipped FROM documents WHERE lang = 'de') SELECT strategy, count(DISTINCT doc_id) AS documents, count(*) AS chunks, coalesce(any_value(skipped), 0) AS skipped FROM corpus LEFT JOIN old USING (strategy) GROUP BY strategy")
def corpus_stats(spark, sf):
    old = table(spark, sf, "documents").where("lang = 'de'").select(F.lit("baseline").alias("strategy"), F.col("doc_id").alias("file_id"))
    return evaluate.corpus_stats(_corpus(spark, sf).withColumnRenamed("doc_id", "file_id"), old)


@query("ingest_metrics", rf"""WITH {windows_sql(400, 100)}, words AS (SELECT count(*) AS documents, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))::BIGINT AS words FROM documents), made AS (SELECT count(*) AS chunks FROM pieces)
SELECT documents, words, chunks, words // chunks AS words_per_chunk FROM words, made""")
def ingest_metrics(spark, sf):
    d = table(spark, sf, "documents")
    return evaluate.ingest_metrics(d, d.select(F.explode(token_windows(F.col("text"))).alias("c")), key="doc_id")


def _questions(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), "text", F.lit("").alias("document_title"), F.array("text").alias("expected_substrings"))


def _first_hits(spark, sf):
    asked = _questions(spark, sf)
    vectors = E.with_hash_embedding(asked, ["query_id"], "text", 64, "query_vector").select("query_id", "query_vector")
    corpus = E.with_hash_embedding(_corpus(spark, sf), ["chunk_id"], "text", 64)
    ranked = search.batch_top_k(corpus.select("chunk_id", "strategy", "doc_id", "embeddings"), vectors, 5, by=["strategy"])
    # Only the winners' documents are cut again for their texts: five a question and strategy at most.
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    winners = _cut(docs.join(ranked.select("doc_id").distinct(), "doc_id", "left_semi"))
    ranked = ranked.join(winners.select("chunk_id", F.lit("").alias("title"), "text"), "chunk_id")
    return evaluate.first_hits(ranked, asked, spark.createDataFrame([(s,) for s in SIZES], "strategy string"))


HITS_SQL = f"""WITH {CORPUS_SQL}, {hash_sql('corpus', 'chunk_id', name='cv')}, {hash_sql('benchmark', 'item_id', name='qv')},
scored AS (SELECT q.item_id, c.chunk_id, round(1.0 - sum(q.x * c.x), 9) AS distance FROM qv_unit q JOIN cv_unit c USING (b) GROUP BY ALL),
ranked AS (SELECT item_id, strategy, text, row_number() OVER (PARTITION BY item_id, strategy ORDER BY distance, chunk_id) AS rank FROM scored JOIN corpus USING (chunk_id)),
judged AS (SELECT item_id, strategy, min(CASE WHEN contains(lower(r.text), lower(b.text)) THEN rank END) AS rank FROM ranked r JOIN benchmark b USING (item_id) WHERE rank <= 5 GROUP BY ALL),
hits AS (SELECT b.item_id AS query_id, s.strategy, j.rank AS first_hit_rank FROM benchmark b, (SELECT DISTINCT strategy FROM corpus) s LEFT JOIN judged j ON j.item_id = b.item_id AND j.strategy = s.strategy)"""


@query("first_hit_rank", f"{HITS_SQL} SELECT query_id, strategy, first_hit_rank FROM hits")
def first_hit_rank(spark, sf):
    return _first_hits(spark, sf)


@query("hit_rate", f"{HITS_SQL} SELECT strategy, k, round(avg(CASE WHEN first_hit_rank <= k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hit_rate FROM hits, (SELECT unnest([1, 3, 5])::BIGINT AS k) GROUP BY strategy, k")
def hit_rate(spark, sf):
    return evaluate.hit_rates(_first_hits(spark, sf)).withColumn("hit_rate", F.round("hit_rate", 6))


@query("mrr", f"{HITS_SQL} SELECT strategy, round(avg(coalesce(1.0::DOUBLE / first_hit_rank, 0.0::DOUBLE)), 6) AS mrr FROM hits GROUP BY strategy")
def mrr(spark, sf):
    return evaluate.mrr(_first_hits(spark, sf)).withColumn("mrr", F.round("mrr", 6))


@query("misses", f"{HITS_SQL} SELECT query_id, strategy FROM hits WHERE first_hit_rank IS NULL")
def misses(spark, sf):
    return evaluate.misses(_first_hits(spark, sf)).select("query_id", "strategy")
