"""Queries of cleaning, chunking, retrieval and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import retrieve as V
from tablewright.operators import tables as R
from tablewright.operators import text as X
from tablewright.plans.registry import ORACLE_SQL, QUERIES, query
from tablewright.streaming import streams as T

C = F.col


def _clean_sql(html: str) -> str:
    out = f"coalesce({html}, '')"
    for name in X.BOILERPLATE:
        out = f"regexp_replace({out}, '(?is)<{name}[^>]*>.*?</{name}>', ' ', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return f"trim(regexp_replace({out}, '[ \\t\\n\\r]+', ' ', 'g'))"


_LETTERS = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), c, '')))::DOUBLE)"


@query("pages", sql=f"SELECT page_id, url, {_clean_sql('html')} AS text FROM pages")
def clean_pages(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", X.clean_html(C("html")).alias("text"))


@query("pages", sql=f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, regexp_matches(h, '^(?i)<h[1-6][ >]') AS heads, string_split(regexp_replace(h, '(?i)(<h[1-6][ >])', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM p),
s AS (SELECT page_id, unnest(range(0, len(parts))) AS k, parts[k + 1] AS part, heads FROM m)
SELECT page_id, (CASE WHEN heads THEN k - 1 ELSE k END)::INTEGER AS section, {_clean_sql("regexp_extract(part, '(?is)^<h[1-6][^>]*>(.*?)</h[1-6]>', 1)")} AS title,
 {_clean_sql("regexp_replace(part, '(?is)^<h[1-6][^>]*>.*?</h[1-6]>', ' ')")} AS body FROM s WHERE NOT (heads AND k = 0)""")
def page_sections(pages: DataFrame) -> DataFrame:
    return X.sections(pages, "page_id", "html")


@query("documents", sql="""
SELECT doc_id, i::INTEGER AS chunk_index, substring(t, (i * 80 + 1)::BIGINT, 100) AS chunk FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 unnest(range(0, greatest(1, ceil((length(t) - 20) / 80.0)::BIGINT))) r(i)""")
def fixed_chunks(documents: DataFrame) -> DataFrame:
    return X.fixed_chunks(documents, "doc_id", "text", 100, 20)


@query("documents", sql=r"""
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk_index, s[i] AS chunk FROM (
 SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents), unnest(range(1, len(s) + 1)) r(i)""")
def sentence_chunks(documents: DataFrame) -> DataFrame:
    return X.sentence_chunks(documents, "doc_id", "text")


@query("documents")
def recursive_chunks(documents: DataFrame) -> DataFrame:
    return X.recursive_chunks(documents, "doc_id", "text")


@query("documents")
def semantic_chunks(documents: DataFrame) -> DataFrame:
    return X.semantic_chunks(documents, "doc_id", "text")


@query("documents")
def table_chunks(documents: DataFrame) -> DataFrame:
    """Chunks that keep tables whole."""
    return X.table_chunks(documents, "doc_id", "text")


@query("documents", sql="""
SELECT doc_id, p::INTEGER AS parent_index, i::INTEGER AS chunk_index, substring(q, (i * 200 + 1)::BIGINT, 200) AS chunk FROM (
 SELECT doc_id, p, substring(t, (p * 800 + 1)::BIGINT, 800) AS q FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), unnest(range(0, greatest(1, ceil(length(t) / 800.0)::BIGINT))) a(p)),
 unnest(range(0, greatest(1, ceil(length(q) / 200.0)::BIGINT))) b(i)""")
def parent_chunks(documents: DataFrame) -> DataFrame:
    return X.parent_chunks(documents, "doc_id", "text")


@query("documents", sql=f"""
SELECT doc_id || '-' || i AS chunk_id, substring(t, (i * 80 + 1)::BIGINT, 100) AS text, source AS source_url, lang || ' > ' || source AS section_title, concat_ws('|', lang, source) AS topic_tags,
 concat_ws('|', source, source || '+') AS models_csv, source || '-series' AS model_group, lang AS series, 'current' AS version, array_to_string(list_transform({_LETTERS.replace("coalesce(text, '')", "substring(t, (i * 80 + 1)::BIGINT, 100)")}, lambda x: x::BIGINT), ',') AS embedding,
 i::INTEGER AS chunk_index, doc_id FROM (SELECT *, coalesce(text, '') AS t FROM documents), unnest(range(0, greatest(1, ceil((length(t) - 20) / 80.0)::BIGINT))) r(i)""")
def chunk_records(documents: DataFrame) -> DataFrame:
    """A record of eleven fields for every chunk of every document, and its document; lists as scalars, as a store of scalars wants them.

    The group's columns travel as they are, so records need no join back to the documents.
    """
    group = F.struct("source", "lang", C("doc_id").alias("id"))
    rows = X.fixed_chunks(documents.select(group.alias("g"), "text"), "g", "text").select("g.*", "chunk_index", "chunk")
    letters = F.transform(X.letter_vector(C("chunk")), lambda x: x.cast("long").cast("string"))
    return rows.select(
        F.concat_ws("-", "id", "chunk_index").alias("chunk_id"), C("chunk").alias("text"), C("source").alias("source_url"), F.concat("lang", F.lit(" > "), "source").alias("section_title"),
        F.array_join(F.array("lang", "source"), "|").alias("topic_tags"), F.array_join(F.array(C("source"), F.concat("source", F.lit("+"))), "|").alias("models_csv"),
        F.concat("source", F.lit("-series")).alias("model_group"), C("lang").alias("series"), F.lit("current").alias("version"), F.array_join(letters, ",").alias("embedding"),
        "chunk_index", C("id").alias("doc_id"),
    )


@query("documents", sql="""
SELECT doc_id || '-' || i AS chunk_id, doc_id, i::INTEGER AS chunk_index, substring(t, (i * 80 + 1)::BIGINT, 100) AS chunk, source AS source_url, lang AS series, concat_ws('|', lang, source) AS models_csv
FROM (SELECT *, coalesce(text, '') AS t FROM documents), unnest(range(0, greatest(1, ceil((length(t) - 20) / 80.0)::BIGINT))) r(i)""")
def all_chunk_records(documents: DataFrame) -> DataFrame:
    """Chunks of every document with their place and group."""
    group = F.struct("source", "lang", C("doc_id").alias("id"))
    rows = X.fixed_chunks(documents.select(group.alias("g"), "text"), "g", "text").select("g.*", "chunk_index", "chunk")
    return rows.select(
        F.concat_ws("-", "id", "chunk_index").alias("chunk_id"), C("id").alias("doc_id"), "chunk_index", "chunk", C("source").alias("source_url"), C("lang").alias("series"),
        F.array_join(F.array("lang", "source"), "|").alias("models_csv"),
    )


@query("benchmark", sql="""
SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS question FROM benchmark""")
def query_preprocess(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", V.normal_query(C("text")).alias("question"))


@query("embeddings", sql="""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0)
SELECT query_id, vec_id AS id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(v, embedding::DOUBLE[]), 6) DESC, vec_id) AS rank
FROM q, embeddings WHERE vec_id <> query_id QUALIFY rank <= 5""")
def dense_topk(embeddings: DataFrame) -> DataFrame:
    """Exact cosine top five of every fiftieth vector against all vectors."""
    vectors = embeddings.select(C("vec_id").alias("id"), C("embedding").alias("vector"))
    return V.dense_topk(vectors.where("id % 50 = 0").select(C("id").alias("query_id"), "vector"), vectors)


_BM25 = """
w AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda t: t <> '')) AS term FROM documents),
asked AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda t: t <> '')) AS term FROM benchmark),
tf AS (SELECT id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
len AS (SELECT id, count(*) AS dl FROM w GROUP BY id), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
c AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM len) AS total),
s AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * dl / (total / n)))), 6) AS score
 FROM tf JOIN len USING (id) JOIN df USING (term) JOIN asked USING (term), c GROUP BY ALL),
sparse AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5)"""


def _bm25(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return V.bm25_topk(benchmark.select(C("item_id").alias("query_id"), "text"), documents.select(C("doc_id").alias("id"), "text"))


@query("documents", "benchmark", sql=f"WITH {_BM25} SELECT * FROM sparse")
def bm25_topk(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return _bm25(documents, benchmark)


_SCALED = "CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END"


@query("documents", "benchmark", sql=f"""
WITH {_BM25.replace("rank <= 5", "rank <= 10")},
l AS (SELECT doc_id AS id, {_LETTERS} AS v FROM documents), ql AS (SELECT item_id AS query_id, {_LETTERS} AS q FROM benchmark),
dense AS (SELECT query_id, id, round(CASE WHEN list_sum(v) > 0 AND list_sum(q) > 0 THEN list_cosine_similarity(q, v) ELSE 0 END, 6) AS score FROM ql, l QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10),
a AS (SELECT query_id, id, {_SCALED} AS x FROM dense WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT query_id, id, {_SCALED} AS y FROM sparse WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, id, round(0.5::DOUBLE * coalesce(x, 0) + 0.5::DOUBLE * coalesce(y, 0), 6) AS score FROM a FULL JOIN b USING (query_id, id))
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 5""")
def hybrid_fusion(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The ten best of BM25 and the ten best of a dense list over the same documents, scaled and fused."""
    asked, docs = benchmark.select(C("item_id").alias("query_id"), "text"), documents.select(C("doc_id").alias("id"), "text")
    dense = V.dense_topk(asked.select("query_id", X.letter_vector(C("text")).alias("vector")), docs.select("id", X.letter_vector(C("text")).alias("vector")), 10, skip_self=False)
    return V.fused(dense, V.bm25_topk(asked, docs, 10))


@query("documents", "benchmark", sql=f"""WITH {_BM25}
SELECT query_id, string_agg('[' || id || '] ' || text, chr(10) ORDER BY rank) AS context FROM sparse JOIN documents ON id = doc_id GROUP BY query_id""")
def context_assembly(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The top documents of each query, whole; `chunk_context` retrieves chunks."""
    return V.context(_bm25(documents, benchmark), documents.select(C("doc_id").alias("id"), "text"))


@query("documents", "benchmark", sql=f"""WITH chunks AS (SELECT doc_id || '-' || chunk_index AS doc_id, chunk AS text FROM ({ORACLE_SQL["sentence_chunks"]})), {_BM25.replace("FROM documents", "FROM chunks")}
SELECT query_id, string_agg('[' || id || '] ' || text, chr(10) ORDER BY rank) AS context FROM sparse JOIN chunks ON id = doc_id GROUP BY query_id""")
def chunk_context(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The top chunks of each query, whole."""
    chunks = X.sentence_chunks(documents, "doc_id", "text").select(F.concat("doc_id", F.lit("-"), "chunk_index").alias("id"), C("chunk").alias("text"))
    return V.context(V.bm25_topk(benchmark.select(C("item_id").alias("query_id"), "text"), chunks), chunks)


@query("conversations", sql="""
SELECT conv_id, 'System: Answer from the context.' || chr(10) || 'History: ' || string_agg(role || ': ' || text, ' | ' ORDER BY turn) || chr(10) || 'Context: none' || chr(10) || 'Question: ' || max_by(text, turn) AS prompt
FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) GROUP BY conv_id""")
def prompts(conversations: DataFrame) -> DataFrame:
    """System text, the last turns, context and question."""
    last = R.last_n(conversations, 3, ["conv_id"], [F.desc("turn")])
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    rows = last.groupBy("conv_id").agg(F.array_join(turns, " | ").alias("h"), F.max_by("text", "turn").alias("q"))
    return rows.select("conv_id", V.prompt("Answer from the context.", C("h"), F.lit("none"), C("q")).alias("prompt"))


@query("conversations", sql="""
WITH w AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
s AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda t: t <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(before), '[^a-z]+'), lambda t: t <> '')) AS b FROM w),
r AS (SELECT *, CASE WHEN len(a) > 0 AND before IS NOT NULL THEN len(list_intersect(a, b)) / len(a)::DOUBLE ELSE 0 END AS share FROM s)
SELECT conv_id, turn, round(share, 6) AS share, CASE WHEN share < 0.1 THEN 'I am not sure.' ELSE text END AS answer FROM r""")
def guardrail(conversations: DataFrame) -> DataFrame:
    """A turn that shares too few words with the one before it gives way to a fallback."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    share, answer = V.grounded(C("text"), C("before"), 0.1, "I am not sure.")
    return conversations.withColumn("before", before).select("conv_id", "turn", F.round(share, 6).alias("share"), answer.alias("answer"))


_EXPAND = {"and": "also", "the": "this"}


@query("benchmark", sql="""
SELECT item_id, array_to_string(list_transform(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '),
 lambda w: CASE w WHEN 'and' THEN 'and also' WHEN 'the' THEN 'the this' ELSE w END), ' ') AS question FROM benchmark""")
def query_expansion(benchmark: DataFrame) -> DataFrame:
    """A normal query whose words are followed by their synonyms."""
    return benchmark.select("item_id", V.expanded(V.normal_query(C("text")), _EXPAND).alias("question"))


@query("conversations", sql=r"""
WITH w AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
l AS (SELECT *, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda t: t <> '') AS a, list_filter(regexp_split_to_array(lower(coalesce(before, '')), '[^a-z]+'), lambda t: t <> '') AS b FROM w),
t AS (SELECT *, list_has_any(a, ['it', 'its', 'that', 'this', 'they', 'them']) AS vague, coalesce(list_filter(b, lambda x: length(x) = list_max(list_transform(b, lambda y: length(y))))[1], '') AS topic FROM l)
SELECT conv_id, turn, CASE WHEN vague AND topic <> '' THEN text || ' (' || topic || ')' ELSE text END AS question, vague AND topic = '' AS ask_back FROM t""")
def query_clarify(conversations: DataFrame) -> DataFrame:
    """Pronouns of a turn resolved by the turn before it; without one, a question back."""
    from pyspark.sql import Window

    rows = conversations.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    question, ask = V.clarified(C("text"), C("before"))
    return rows.select("conv_id", "turn", question.alias("question"), ask.alias("ask_back"))


def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in windows of two hours that begin every hour, over a stream."""
    return T.run_available(T.window_counts(T.with_event_time(T.stream_table(spark, sf_dir, "events")), "2 hours", "1 hour"))


def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts over a stream, state complete."""
    return T.run_available(T.window_counts(T.with_event_time(T.stream_table(spark, sf_dir, "events"))))


def stream_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State by user over a stream."""
    return T.run_available(T.running_totals(T.stream_table(spark, sf_dir, "events"), "user_id", "value"))


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events above a limit, passed on as they come."""
    return T.run_available(T.stream_table(spark, sf_dir, "events").where("value > 95").select("event_id", "user_id", "value"), "append")


for _f, _sql in (
    (stream_event_counts, "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    (stream_sliding_counts, """SELECT date_trunc('hour', ts) - h * INTERVAL 1 HOUR AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (0), (1)) v(h) GROUP BY ALL"""),
    (stream_running_totals, "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id"),
    (stream_alerts, "SELECT event_id, user_id, value FROM events WHERE value > 95"),
):
    QUERIES[_f.__name__], ORACLE_SQL[_f.__name__] = _f, _sql
