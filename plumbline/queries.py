"""The registered queries of the retrieval engine over the driver's tables, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.config import EngineConfig
from plumbline.functions import text as tx
from plumbline.functions import vectors as vx
from plumbline.operators import analytics, diff, gates, lexical, retrieval, windows
from plumbline.operators.chunking import chunked
from plumbline.operators.pivots import VectorIndex
from plumbline.operators.postings import TextIndex
from plumbline.storage import scratch, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def path_of(c: Column) -> Column:
    return F.concat(F.lit("docs/"), F.pmod(c, F.lit(7)).cast("string"), F.lit("/"), c.cast("string"), F.lit(".md"))


PATH = "'docs/' || (doc_id % 7) || '/' || doc_id || '.md'"


def docs(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "documents")
    return x.select(F.col("doc_id").alias("id"), path_of(F.col("doc_id")).alias("path"), F.col("text").alias("content"), F.col("n_chars").alias("file_size"), "lang", "source")


def log(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    source = F.when(F.col("event_id") % 3 == 0, "cli").when(F.col("event_id") % 3 == 1, "mcp").otherwise("other")
    return e.select(F.col("event_id").alias("id"), F.unix_timestamp("ts").alias("ts"), source.alias("source"), F.col("event_type").alias("query"), (F.col("event_id") % 5000).alias("result_bytes"), (F.col("event_id") * 7 % 70000).alias("baseline_bytes"))


LOG = """WITH log AS (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
  CASE WHEN event_id % 3 = 0 THEN 'cli' WHEN event_id % 3 = 1 THEN 'mcp' ELSE 'other' END AS source, event_type AS query,
  event_id % 5000 AS result_bytes, event_id * 7 % 70000 AS baseline_bytes FROM events) """


#: Characters of a context.
BUDGET = 1500


# --- scans, filters, projections


@query(f"SELECT {PATH} AS path, sha256(text) AS content_hash FROM documents")
def scan_document_hashes(spark, d):
    return docs(spark, d).select("path", F.sha2("content", 256).alias("content_hash"))


@query(f"SELECT doc_id AS id, {PATH} AS path, n_chars AS file_size FROM documents WHERE {PATH} = 'docs/0/42.md'")
def point_lookup(spark, d):
    return docs(spark, d).where(F.col("path") == "docs/0/42.md").select("id", "path", "file_size")


@query("SELECT conv_id, turn, role FROM conversations WHERE turn BETWEEN 1 AND 3")
def filter_between(spark, d):
    return t(spark, d, "conversations").where(F.col("turn").between(1, 3)).select("conv_id", "turn", "role")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (3, 5, 8, 13, 21)")
def filter_in_list(spark, d):
    return t(spark, d, "embeddings").where(F.col("vec_id").isin(3, 5, 8, 13, 21)).select("vec_id", "label")


@query(f"WITH x AS (SELECT {PATH} AS path FROM documents) SELECT path FROM x WHERE path = 'docs/3' OR starts_with(path, 'docs/3/')")
def filter_path_prefix(spark, d):
    return docs(spark, d).where(tx.under(F.col("path"), "docs/3")).select("path")


@query(f"WITH x AS (SELECT CASE WHEN doc_id % 3 = 0 THEN {PATH} WHEN doc_id % 3 = 1 THEN {PATH} || '.txt' ELSE '/p/.md' END AS path FROM documents) SELECT path, regexp_matches(path, '(?:^|/)[^/]+\\.md$') AS is_markdown FROM x")
def filter_markdown_path(spark, d):
    i = F.col("id") % 3
    p = F.when(i == 0, F.col("path")).when(i == 1, F.concat("path", F.lit(".txt"))).otherwise("/p/.md")
    return docs(spark, d).select(p.alias("path")).withColumn("is_markdown", tx.is_markdown(F.col("path")))


@query("SELECT item_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) BETWEEN 5 AND 150 AS passes FROM benchmark")
def filter_prompt_length(spark, d):
    return t(spark, d, "benchmark").select("item_id", tx.prompt_passes(F.col("text")).alias("passes"))


@query("SELECT doc_id, text IS NOT NULL AND strlen(text) > 4000 AS too_large FROM documents")
def filter_size_guard(spark, d):
    return t(spark, d, "documents").select("doc_id", F.coalesce(F.octet_length("text") > 4000, F.lit(False)).alias("too_large"))


# --- joins


@query("SELECT l_orderkey, l_linenumber, o_custkey, c_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity > 49")
def join_three_tables(spark, d):
    lines = t(spark, d, "lineitem").where("l_quantity > 49")
    out = lines.join(t(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return out.select("l_orderkey", "l_linenumber", "o_custkey", "c_name")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def join_semi(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_anti(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id AS vec_id, coalesce(len(embedding), 0) AS dims FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def join_left_missing_vector(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    return t(spark, d, "documents").select(F.col("doc_id").alias("vec_id")).join(e, "vec_id", "left").select("vec_id", F.size(F.coalesce("embedding", F.array().cast("array<float>"))).alias("dims"))


@query("WITH c AS (SELECT * FROM conversations) SELECT a.conv_id, a.turn, count(*) AS near, max(b.turn) AS last FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 GROUP BY ALL")
def join_range_neighbours(spark, d):
    near = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-1, 1)
    c = t(spark, d, "conversations").where("turn IS NOT NULL").select("conv_id", "turn")
    return c.select("conv_id", "turn", F.count(F.lit(1)).over(near).alias("near"), F.max("turn").over(near).alias("last")).distinct()


_ROOTS = "('docs/1'), ('docs/5'), ('docs'), ('docs/5/7.md'), ('other')"


@query(f"WITH x AS (SELECT {PATH} AS path FROM documents), r(root) AS (VALUES {_ROOTS}), m AS (SELECT path, root, row_number() OVER (PARTITION BY path ORDER BY length(root) DESC) AS n FROM x JOIN r ON path = root OR starts_with(path, root || '/')) SELECT root, count(*) AS files FROM m WHERE n = 1 GROUP BY root")
def join_prefix_roots(spark, d):
    """Each file belongs to the longest root it lies in."""
    roots = spark.createDataFrame([("docs/1",), ("docs/5",), ("docs",), ("docs/5/7.md",), ("other",)], "root string")
    return gates.roots_of(docs(spark, d).select("path"), roots).groupBy("root").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT vec_id, label, lang, toxic FROM embeddings JOIN documents ON doc_id = vec_id JOIN labels USING (doc_id)")
def join_vectors_documents(spark, d):
    vectors = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return vectors.join(t(spark, d, "documents").select("doc_id", "lang"), "doc_id").join(t(spark, d, "labels").select("doc_id", "toxic"), "doc_id").withColumnRenamed("doc_id", "vec_id")


@query(f"SELECT {PATH} AS path, turn AS chunk_index, conv_id * 1000 + turn AS id, strlen(c.text) AS n_bytes, row_number() OVER (PARTITION BY doc_id ORDER BY turn, conv_id * 1000 + turn) AS reading FROM conversations c JOIN documents ON doc_id = conv_id")
def chunks_of_document(spark, d):
    """The chunks of every document in reading order."""
    c = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.octet_length("text").cast("long").alias("n_bytes"))
    order = Window.partitionBy("document_id").orderBy("chunk_index", "id")
    found = c.join(docs(spark, d).select(F.col("id").alias("document_id"), "path"), "document_id")
    return found.withColumn("reading", F.row_number().over(order)).select("path", "chunk_index", "id", "n_bytes", "reading")


# --- aggregates, windows, sets


@query("SELECT count(*) AS documents, coalesce(sum(n_chars), 0) AS total_bytes, (SELECT count(*) FROM conversations) AS chunks, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations)) AS empty_documents, strftime(max(TIMESTAMP '2024-01-01' + to_seconds(doc_id)), '%Y-%m-%dT%H:%M:%SZ') AS last_indexed_at, round((SELECT count(*) FROM conversations) / count(*), 1) AS chunks_per_document FROM documents")
def index_stats(spark, d):
    documents = docs(spark, d).withColumn("indexed_at", tx.iso_time(F.col("id") + 1704067200))
    return analytics.stats(documents, t(spark, d, "conversations").select(F.col("conv_id").alias("document_id")))


@query(LOG + "SELECT NULL::VARCHAR AS source, count(*) AS searches, coalesce(sum(result_bytes), 0) AS delivered_bytes, coalesce(sum(baseline_bytes), 0) AS baseline_bytes, min(ts) AS since FROM log UNION ALL SELECT source, count(*), sum(result_bytes), sum(baseline_bytes), min(ts) FROM log WHERE source IN ('cli', 'mcp') GROUP BY source")
def log_savings(spark, d):
    return analytics.savings(log(spark, d))


@query(LOG + ", s AS (SELECT sum(result_bytes) AS a, sum(baseline_bytes) AS b FROM log), k AS (SELECT CAST(round(a / 4.0) AS BIGINT) AS delivered_tokens, CAST(round(b / 4.0) AS BIGINT) AS baseline_tokens FROM s) SELECT *, greatest(baseline_tokens - delivered_tokens, 0) AS saved_tokens, round(baseline_tokens / delivered_tokens, 6) AS multiplier, round(delivered_tokens * 5 / 1e6, 6) AS delivered_dollars, round(baseline_tokens * 5 / 1e6, 6) AS baseline_dollars, round(greatest(baseline_tokens - delivered_tokens, 0) * 5 / 1e6, 6) AS saved_dollars FROM k")
def log_costs(spark, d):
    out = analytics.costs(analytics.savings(log(spark, d)).where("source IS NULL"))
    money = [c for c in out.columns if c.endswith("_dollars") or c == "multiplier"]
    return out.select("delivered_tokens", "baseline_tokens", "saved_tokens", *(F.round(c, 6).alias(c) for c in money))


@query(LOG + "SELECT id, ts, CASE WHEN source IN ('cli', 'mcp') THEN source ELSE 'cli' END AS source, query FROM log ORDER BY ts DESC, id DESC LIMIT 20")
def log_recent(spark, d):
    return analytics.recent(log(spark, d), 20).select("id", "ts", "source", "query")


@query(f"SELECT sum(strlen(text)) AS result_bytes, len(list(DISTINCT {PATH})) AS n_paths, sum(n_chars) AS baseline_bytes FROM documents")
def log_measure(spark, d):
    x = docs(spark, d)
    return analytics.measured(x.withColumnRenamed("path", "file_path"), x)


@query("SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rank FROM embeddings")
def window_row_number(spark, d):
    order = Window.partitionBy("label").orderBy(F.desc("vec_id"))
    return t(spark, d, "embeddings").select("vec_id", "label", F.row_number().over(order).alias("rank"))


@query("SELECT user_id AS query_id, event_id AS id, CASE WHEN greatest(max(value) OVER (PARTITION BY user_id), 0) > 0 THEN round(value / greatest(max(value) OVER (PARTITION BY user_id), 0), 9) ELSE 0 END AS score FROM events")
def window_normalise_scores(spark, d):
    hits = t(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.col("value").alias("score"))
    return retrieval.normalised(hits).withColumn("score", F.round("score", 9))


@query("SELECT c.conv_id * 1000 + c.turn AS target_id, (SELECT string_agg(n.text, chr(10) || chr(10) ORDER BY n.turn) FROM conversations n WHERE n.conv_id = c.conv_id AND n.turn BETWEEN c.turn - 1 AND c.turn + 1) AS context FROM conversations c")
def window_context(spark, d):
    c = t(spark, d, "conversations")
    chunks = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"))
    return windows.chunk_windows(chunks, chunks.select("id"), 1, 100_000_000)


@query(f"""WITH RECURSIVE c AS (SELECT conv_id AS d, conv_id * 1000 + turn AS id, turn AS i, text, length(text) AS n FROM conversations),
w AS (SELECT id, d, i AS low, i AS high, n AS used, n < {BUDGET} AS l, n < {BUDGET} AS r, 0 AS step FROM c
  UNION ALL SELECT id, d, low - (step % 2 = 0 AND fits)::INT, high + (step % 2 = 1 AND fits)::INT, CASE WHEN fits THEN used + 2 + n ELSE used END, CASE WHEN step % 2 = 0 THEN fits ELSE l END, CASE WHEN step % 2 = 1 THEN fits ELSE r END, step + 1
  FROM (SELECT w.*, c.n, coalesce((CASE WHEN step % 2 = 0 THEN l ELSE r END) AND used + 2 + c.n <= {BUDGET}, false) AS fits FROM w LEFT JOIN c ON c.d = w.d AND c.i = CASE WHEN step % 2 = 0 THEN low - 1 ELSE high + 1 END WHERE step < 6 AND (l OR r)) x),
last AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY step DESC) = 1)
SELECT last.id AS target_id, CASE WHEN low = high THEN substr(any_value(t.text), 1, {BUDGET}) ELSE string_agg(t.text, chr(10) || chr(10) ORDER BY t.i) END AS context
FROM last JOIN c t ON t.d = last.d AND t.i BETWEEN low AND high GROUP BY last.id, low, high""")
def window_budget(spark, d):
    """Contexts of up to three turns on either side that fit into a budget, which most reach."""
    c = t(spark, d, "conversations")
    chunks = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"))
    return windows.chunk_windows(chunks, chunks.select("id"), 3, BUDGET)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def sort_top_k(spark, d):
    return t(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "ts")


_STORED = f"stored AS (SELECT {PATH} AS path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 0)"
_INCOMING = f"incoming AS (SELECT {PATH} AS path, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = docs(spark, d).withColumn("content_hash", F.sha2("content", 256))
    stored = x.where("id % 10 <> 0").withColumn("content_hash", F.when(F.col("id") % 7 == 0, "old").otherwise(F.col("content_hash")))
    return x.where("id % 10 <> 1").select("path", "content_hash"), stored.select("path", "content_hash")


@query(f"WITH {_STORED}, {_INCOMING} SELECT i.path, CASE WHEN s.h IS NULL THEN 'added' WHEN s.h <> i.h THEN 'modified' ELSE 'unchanged' END AS status FROM incoming i LEFT JOIN stored s USING (path)")
def diff_changes(spark, d):
    return diff.changes(*_sides(spark, d)).select("path", "status")


@query(f"WITH {_STORED}, {_INCOMING} SELECT CASE WHEN s.h IS NULL THEN 'added' WHEN s.h <> i.h THEN 'modified' ELSE 'unchanged' END AS status, count(*) AS files FROM incoming i LEFT JOIN stored s USING (path) GROUP BY 1")
def diff_report(spark, d):
    return diff.report(diff.changes(*_sides(spark, d)))


@query(f"WITH {_STORED}, {_INCOMING} SELECT path FROM stored WHERE path NOT IN (SELECT path FROM incoming)")
def diff_vanished(spark, d):
    incoming, stored = _sides(spark, d)
    return diff.vanished(stored, incoming)


@query("SELECT x AS entry, x IN (SELECT lang FROM documents WHERE lang IS NOT NULL) AS present FROM (VALUES ('docs'), ('target'), ('en'), ('de')) v(x)")
def set_except(spark, d):
    """Which of some entries are there and which are missing."""
    entries = spark.createDataFrame([("docs",), ("target",), ("en",), ("de",)], "entry string")
    have = t(spark, d, "documents").select(F.col("lang").alias("entry"), F.lit(True).alias("present")).where("entry IS NOT NULL").distinct()
    return entries.join(have, "entry", "left").select("entry", F.coalesce("present", F.lit(False)).alias("present"))


@query("SELECT DISTINCT source FROM documents")
def set_distinct(spark, d):
    return t(spark, d, "documents").select("source").distinct()


# --- scalar functions


@query(r"SELECT item_id, array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array('-' || text || ' (x*y) ^a:b ---', '\s+'), lambda w: w <> ''), lambda w: regexp_replace(translate(w, '\"()*+^:{}~', ''), '^-+', '')), lambda w: w <> ''), ' ') AS clean FROM benchmark".replace('\\"', '"'))
def text_sanitize_query(spark, d):
    return t(spark, d, "benchmark").select("item_id", tx.sanitize_query(F.concat(F.lit("-"), "text", F.lit(" (x*y) ^a:b ---"))).alias("clean"))


@query(r"WITH x AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(source || ' ' || lang || ' the heed de zzz'), '\s+'), lambda w: strlen(w) >= 3) AS terms, text AS heading FROM documents) SELECT doc_id, len(terms) AS n_terms, round(0.05 * len(list_filter(terms, lambda w: contains(lower(heading), w))) / len(terms), 9) AS boost FROM x")
def text_heading_boost(spark, d):
    x = t(spark, d, "documents").select("doc_id", tx.query_terms(F.concat_ws(" ", "source", "lang", F.lit("the heed de zzz"))).alias("terms"), "text")
    return x.select("doc_id", F.size("terms").alias("n_terms"), F.round(tx.heading_boost(F.col("text"), F.col("terms"), 0.05), 9).alias("boost"))


@query(r"SELECT doc_id, nullif(trim(regexp_extract('intro' || chr(10) || '  # ' || text, '(?m)^[^\S\n]*# [^\S\n]*(\S[^\n]*)$', 1)), '') AS title FROM documents")
def text_title(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.title(F.concat(F.lit("intro\n  # "), "text")).alias("title"))


@query(f"SELECT doc_id, regexp_replace(replace('.\\' || replace({PATH}, '/', '\\'), '\\', '/'), '^\\./', '') AS path FROM documents")
def text_normalise_path(spark, d):
    return docs(spark, d).select(F.col("id").alias("doc_id"), tx.normalise_path(F.concat(F.lit(".\\"), F.translate("path", "/", "\\"))).alias("path"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS iso, CASE WHEN event_id * 997 < 1000 THEN CAST(event_id * 997 AS VARCHAR) WHEN event_id * 997 < 1000000 THEN printf('%.1fK', event_id * 997 / 1000.0) ELSE printf('%.1fM', event_id * 997 / 1000000.0) END AS human, CAST(round(event_id / 4.0) AS BIGINT) AS tokens FROM events")
def text_numbers(spark, d):
    i = F.col("event_id")
    return t(spark, d, "events").select("event_id", tx.iso_time(F.unix_timestamp("ts")).alias("iso"), tx.human_count(i * 997).alias("human"), tx.bytes_to_tokens(i).alias("tokens"))


@query("SELECT doc_id, array_to_string(str_split(text, chr(10))[:3], chr(10)) AS head, strlen(text) AS n_bytes, length(text) AS n_chars FROM documents")
def text_first_lines(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.first_lines(F.col("text"), 3).alias("head"), F.octet_length("text").cast("long").alias("n_bytes"), F.char_length("text").cast("long").alias("n_chars"))


@query("SELECT vec_id, repeat('█', CAST(least(round(vec_id / 400.0 * 40), 40) AS INT)) || repeat('░', 40 - CAST(least(round(vec_id / 400.0 * 40), 40) AS INT)) AS bar FROM embeddings")
def text_score_bar(spark, d):
    return t(spark, d, "embeddings").select("vec_id", tx.score_bar(F.col("vec_id") / 400.0).alias("bar"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def json_field(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


_PAYLOAD = "json_object('tool_input', json_object('file_path', source || '/' || doc_id || '.md'), 'cwd', CASE WHEN doc_id % 3 > 0 THEN '/' || lang END, 'prompt', text)"


@query(f"WITH p AS (SELECT doc_id, {_PAYLOAD} AS payload FROM documents) SELECT doc_id, json_extract_string(payload, '$.tool_input.file_path') AS file_path, json_extract_string(payload, '$.cwd') AS cwd, strlen(json_extract_string(payload, '$.prompt')) AS prompt_bytes, json_extract_string(payload, '$.none') AS none FROM p")
def payload_parse(spark, d):
    """What hooks read from their payloads, of a payload for each document."""
    x = t(spark, d, "documents")
    payload = F.to_json(F.struct(F.struct(F.concat_ws("/", "source", F.concat("doc_id", F.lit(".md"))).alias("file_path")).alias("tool_input"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("/"), "lang")).alias("cwd"), F.col("text").alias("prompt")))
    read = F.from_json(payload, "tool_input struct<file_path:string>, cwd string, prompt string, none string")
    return x.select("doc_id", read.alias("p")).select("doc_id", F.col("p.tool_input.file_path").alias("file_path"), "p.cwd", F.octet_length("p.prompt").cast("long").alias("prompt_bytes"), "p.none")


_HEAD = "list_transform(embedding[:16], lambda x: CAST(x AS DOUBLE))"


@query(f"WITH x AS (SELECT vec_id, {_HEAD} AS v FROM embeddings) SELECT vec_id, round(list_dot_product(v, v), 6) AS before, round(v[1] / sqrt(list_dot_product(v, v)), 5) AS first FROM x")
def vector_truncate(spark, d):
    e = t(spark, d, "embeddings")
    head = F.slice("embedding", 1, 16)
    return e.select("vec_id", F.round(vx.dot(head, head), 6).alias("before"), F.round(vx.truncated(F.col("embedding"), 16)[0].cast("double"), 5).alias("first"))


@query("SELECT vec_id, 4 * len(embedding) AS n_bytes, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) + 0.0 AS total FROM embeddings WHERE embedding IS NOT NULL")
def vector_bytes(spark, d):
    """Every vector written as bytes and read back."""
    x = t(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", vx.to_bytes("embedding").alias("raw"))
    total = F.aggregate("v", F.lit(0.0), lambda s, y: s + y.cast("double"))
    return x.select("vec_id", F.octet_length("raw").cast("long").alias("n_bytes"), vx.from_bytes("raw").alias("v")).select("vec_id", "n_bytes", (F.round(total, 6) + 0.0).alias("total"))


@query(f"WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), f AS (SELECT label, min(vec_id) AS vec_id FROM x GROUP BY label) SELECT a.vec_id, b.vec_id AS first_id, round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) + 0.0 AS distance FROM x a JOIN f USING (label) JOIN x b ON b.vec_id = f.vec_id")
def vector_distance(spark, d):
    """The distance of every vector from the first of its label."""
    e = t(spark, d, "embeddings").select("vec_id", "label", "embedding")
    first = e.groupBy("label").agg(F.min(F.struct(F.col("vec_id").alias("first_id"), F.col("embedding").alias("other"))).alias("first")).select("label", "first.*")
    return e.join(F.broadcast(first), "label").select("vec_id", "first_id", (F.round(vx.cosine_distance(F.col("embedding"), F.col("other")), 6) + 0.0).alias("distance"))


# --- retrieval


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return e, e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")


_KNN = """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT q.id AS query_id, v.id, 1 - list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) AS distance FROM v, v q WHERE q.id % 100 = 0),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS vec_rank FROM p QUALIFY vec_rank <= 15)"""


@query(_KNN + " SELECT query_id, id, round(distance, 6) + 0.0 AS distance, vec_rank FROM knn")
def knn_batch(spark, d):
    return retrieval.knn(*_vectors(spark, d), 15).withColumn("distance", F.round("distance", 6) + 0.0)


def _pivot_index(spark: SparkSession, d: str) -> VectorIndex:
    return VectorIndex.read(spark, _once(spark, d, "pivots", lambda path: VectorIndex.build(_vectors(spark, d)[0], path)))


@query(_KNN + " SELECT query_id, id, round(distance, 6) + 0.0 AS distance, vec_rank FROM knn")
def knn_indexed(spark, d):
    """The same neighbours from the stored partitions around pivots."""
    return _pivot_index(spark, d).search(_vectors(spark, d)[1], 15)[0].withColumn("distance", F.round("distance", 6) + 0.0)


@query()
def knn_work(spark, d):
    """How many of the partitions and vectors that search looks at."""
    return _pivot_index(spark, d).search(_vectors(spark, d)[1], 15)[1]


# Queries: terms that all have to match, numbered as the vectors that are asked for; of the second kind, more syntax.
AND_QUERIES = ["the and", "heed thing", "de la", "und die", "thation", "los ciones", "the the"]
SYNTAX_QUERIES = ["heed OR thing", "the NOT and", "of_the", "heed AND thing OR und", "broken?", "AND the"]


def _asked(spark: SparkSession, texts: list[str], step: int = 1) -> DataFrame:
    return spark.createDataFrame([(i * step, x) for i, x in enumerate(texts)], "query_id long, query string")


_STORED: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, d: str, name: str, write: Callable[[str], object]) -> str:
    """The folder of an index over the tables in ``d``; made by the first query of the session that searches it."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STORED:
        path = scratch(spark, name)
        write(path)
        _STORED[key] = path
    return _STORED[key]


def text_index(spark: SparkSession, d: str) -> TextIndex:
    """The words of all documents."""
    return TextIndex.read(spark, _once(spark, d, "words", lambda path: TextIndex.build(docs(spark, d).select("id", "content"), path)))


def chunk_index(spark: SparkSession, d: str, part: str = "id IS NOT NULL") -> tuple[DataFrame, TextIndex]:
    """All documents (or a part) as chunks with heading and vector, and the index of their words."""

    def write(path: str) -> None:
        # Documents without a vector are found by words alone; the heading is the title anywhere in the text, if it has one.
        # Texts stay where they are: vectors are joined to headings alone, and to words only where an id has several.
        vectors = _vectors(spark, d)[0]
        texts = docs(spark, d).where(part).select("id", "content", F.coalesce(tx.title(F.col("content")), F.lit("")).alias("heading_context"))
        texts.select("id", "heading_context").join(vectors, "id", "left").write.parquet(f"{path}/chunks")
        several = vectors.where("id IS NOT NULL").groupBy("id").count().where("count > 1")
        if not several.isEmpty():
            times = F.sequence(F.lit(1), F.coalesce("count", F.lit(1)))
            texts = stored(texts.join(several, "id", "left").withColumn("_copy", F.explode(times)).drop("count", "_copy"), "texts")
        TextIndex.build(texts, f"{path}/words")

    path = _once(spark, d, f"chunks {part}".replace(" ", "-").replace("%", "mod").replace("=", "is"), write)
    return spark.read.parquet(f"{path}/chunks"), TextIndex.read(spark, f"{path}/words")


_TERMS = ", ".join(f"({100 * i}, {n}, {term!r})" for i, q in enumerate(AND_QUERIES) for n, term in enumerate(q.split()))
_BM25 = rf"""tok AS (SELECT doc_id AS id, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}]+') AS terms FROM documents),
q(query_id, phrase, term) AS (VALUES {_TERMS}),
n AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avg_len FROM tok),
tf AS (SELECT query_id, phrase, id, len(terms) AS l, len(list_filter(terms, lambda x: x = term)) AS tf FROM tok, q WHERE list_contains(terms, term)),
df AS (SELECT query_id, phrase, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT tf.query_id, id, sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len))) AS score, count(*) AS hits FROM tf JOIN df USING (query_id, phrase), n GROUP BY tf.query_id, id),
bm25 AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS bm25_rank FROM s WHERE hits = (SELECT count(*) FROM q WHERE q.query_id = s.query_id) QUALIFY bm25_rank <= 15)"""


@query("WITH " + _BM25 + " SELECT query_id, id, round(score, 6) AS score, bm25_rank FROM bm25")
def bm25_and(spark, d):
    return lexical.bm25(text_index(spark, d), _asked(spark, AND_QUERIES, 100), 15).withColumn("score", F.round("score", 6))


_SYNTAX = r"""WITH tok AS (SELECT doc_id AS id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM documents),
n AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM tok),
p(phrase, terms) AS (VALUES ('heed', ['heed']), ('thing', ['thing']), ('the', ['the']), ('and', ['and']), ('und', ['und']), ('of_the', ['of', 'the'])),
tf AS (SELECT phrase, id, len(w) AS l, CASE WHEN len(terms) = 1 THEN len(list_filter(w, lambda x: x = terms[1])) ELSE len(list_filter(range(1, len(w)), lambda i: w[i] = terms[1] AND w[i + 1] = terms[2])) END AS tf FROM tok, p WHERE list_has_all(w, terms)),
found AS (SELECT *, count(*) OVER (PARTITION BY phrase) AS df FROM tf WHERE tf > 0),
s AS (SELECT phrase, id, greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len)) AS s FROM found, n),
has AS (SELECT id, max(s) FILTER (phrase = 'heed') AS heed, max(s) FILTER (phrase = 'thing') AS thing, max(s) FILTER (phrase = 'the') AS the, max(s) FILTER (phrase = 'and') AS "and", max(s) FILTER (phrase = 'und') AS und, max(s) FILTER (phrase = 'of_the') AS of_the FROM s GROUP BY id),
hit AS (SELECT 0 AS query_id, id, coalesce(heed, 0) + coalesce(thing, 0) AS score FROM has WHERE heed > 0 OR thing > 0
  UNION ALL SELECT 1, id, the FROM has WHERE the > 0 AND "and" IS NULL UNION ALL SELECT 2, id, of_the FROM has WHERE of_the > 0
  UNION ALL SELECT 3, id, CASE WHEN heed > 0 AND thing > 0 THEN heed + thing ELSE 0 END + coalesce(und, 0) FROM has WHERE (heed > 0 AND thing > 0) OR und > 0)
SELECT CAST(query_id AS BIGINT) AS query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS bm25_rank FROM hit"""


@query(_SYNTAX)
def bm25_syntax(spark, d):
    """What OR, NOT and phrases find, with scores and ranks; broken queries match nothing."""
    return lexical.bm25(text_index(spark, d), _asked(spark, SYNTAX_QUERIES), 1 << 30).withColumn("score", F.round("score", 6))


@query()
def bm25_work(spark, d):
    """How many postings the terms of each query have, and how many a search for its best 15 scores."""
    return lexical.work(text_index(spark, d), _asked(spark, AND_QUERIES, 100), 15)


@query(_KNN + ", " + _BM25 + " SELECT query_id, id, round(coalesce(1.0 / (60 + vec_rank), 0) + coalesce(1.0 / (60 + bm25_rank), 0), 9) AS score, coalesce(vec_rank, 1073741824 + bm25_rank) AS cand_pos FROM knn FULL JOIN bm25 USING (query_id, id)")
def rrf_fusion(spark, d):
    words = lexical.bm25(text_index(spark, d), _asked(spark, AND_QUERIES, 100), 15)
    return retrieval.fuse(retrieval.knn(*_vectors(spark, d), 15), words).withColumn("score", F.round("score", 9))


@query(_KNN + ", " + _BM25 + " SELECT query_id, id, bm25_rank FROM bm25 ANTI JOIN knn USING (query_id, id)")
def bm25_only_ids(spark, d):
    """Candidates that words alone have found."""
    words = lexical.bm25(text_index(spark, d), _asked(spark, AND_QUERIES, 100), 15)
    return words.join(retrieval.knn(*_vectors(spark, d), 15), ["query_id", "id"], "left_anti").select("query_id", "id", "bm25_rank")


def _hybrid(spark: SparkSession, d: str, part: str = "id IS NOT NULL") -> DataFrame:
    asked = _asked(spark, AND_QUERIES, 100).join(_vectors(spark, d)[0].withColumnRenamed("id", "query_id"), "query_id", "left")
    chunks, index = chunk_index(spark, d, part)
    return retrieval.hybrid(chunks, index, asked, 5, EngineConfig())


_BOOST = ", ".join(f"({100 * i}, {[w for w in q.split() if len(w.encode()) >= 3]!r})" for i, q in enumerate(AND_QUERIES))
_ASKED = f"""WITH RECURSIVE q(query_id, phrase, term) AS (VALUES {_TERMS}), b(query_id, words) AS (VALUES {_BOOST}),
qv AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IN (SELECT query_id FROM q))"""


def _hybrid_sql(part: str) -> str:
    """The raw hits of a hybrid search of the documents in ``part``: ``query_id, id, score, mmr_pos``."""
    return rf"""{_ASKED},
chunk AS (SELECT doc_id AS id, text, coalesce(nullif(trim(regexp_extract(text, '(?m)^[^\S\n]*# [^\S\n]*(\S[^\n]*)$', 1)), ''), '') AS heading, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE {part}),
near AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY 1 - list_dot_product(qv.e, chunk.e) / (sqrt(list_dot_product(qv.e, qv.e)) * sqrt(list_dot_product(chunk.e, chunk.e))), id) AS vec_rank FROM qv, chunk WHERE chunk.e IS NOT NULL QUALIFY vec_rank <= 15),
tok AS (SELECT id, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}]+') || regexp_extract_all(strip_accents(lower(heading)), '[\p{{L}}\p{{N}}]+') AS terms FROM chunk),
n AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avg_len FROM tok),
tf AS (SELECT query_id, phrase, id, len(terms) AS l, len(list_filter(terms, lambda x: x = term)) AS tf FROM tok, q WHERE list_contains(terms, term)),
df AS (SELECT query_id, phrase, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT tf.query_id, id, sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len))) AS score, count(*) AS hits FROM tf JOIN df USING (query_id, phrase), n GROUP BY tf.query_id, id),
bm25 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS bm25_rank FROM s WHERE hits = (SELECT count(*) FROM q WHERE q.query_id = s.query_id) QUALIFY bm25_rank <= 15),
fused AS (SELECT query_id, id, coalesce(1.0 / (60 + vec_rank), 0) + coalesce(1.0 / (60 + bm25_rank), 0) AS score, coalesce(vec_rank, 1073741824 + bm25_rank) AS pos FROM near FULL JOIN bm25 USING (query_id, id)),
cand AS (SELECT query_id, id, e, pos, score + coalesce(0.05 * len(list_filter(words, lambda w: contains(lower(heading), w))) / nullif(len(words), 0), 0) AS score FROM fused JOIN chunk USING (id) JOIN b USING (query_id)),
pick AS (SELECT query_id, 0 AS step, []::BIGINT[] AS chosen FROM (SELECT DISTINCT query_id FROM cand)
  UNION ALL SELECT query_id, step + 1, list_append(chosen, (SELECT arg_max(c.id, struct_pack(v := 0.7 * c.score - 0.3 * greatest(coalesce((SELECT max(list_dot_product(c.e, s.e)) FROM cand s WHERE s.query_id = pick.query_id AND list_contains(pick.chosen, s.id)), 0), 0), p := c.pos)) FROM cand c WHERE c.query_id = pick.query_id AND NOT list_contains(pick.chosen, c.id)))
  FROM pick WHERE step < 5),
hits AS (SELECT query_id, id, score, CAST(list_position(chosen, id) AS INTEGER) AS mmr_pos FROM cand JOIN (SELECT query_id, chosen FROM pick WHERE step = 5) USING (query_id) WHERE list_contains(chosen, id))
SELECT * FROM hits"""


@query(f"SELECT query_id, id, round(CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END, 9) AS score, mmr_pos FROM ({_hybrid_sql('true')}) h WINDOW w AS (PARTITION BY query_id)")
def hybrid_search(spark, d):
    return retrieval.normalised(_hybrid(spark, d)).withColumn("score", F.round("score", 9))


@query(f"""WITH h AS (SELECT *, 'even' AS source_db FROM ({_hybrid_sql('doc_id % 2 = 0')}) UNION ALL SELECT *, 'odd' FROM ({_hybrid_sql('doc_id % 2 = 1')})),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_db, mmr_pos) AS INTEGER) AS rank FROM h QUALIFY rank <= 5)
SELECT query_id, id, round(CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE score END, 9) AS score, source_db, rank FROM r WINDOW w AS (PARTITION BY query_id)""")
def banks_merged(spark, d):
    merged = retrieval.merged({"even": _hybrid(spark, d, "id % 2 = 0"), "odd": _hybrid(spark, d, "id % 2 = 1")}, 5)
    return merged.withColumn("score", F.round("score", 9))


_MMR = """, cand AS (SELECT query_id, knn.id, 1 - distance AS score, vec_rank AS pos, v.e FROM knn JOIN v ON v.id = knn.id),
pick AS (SELECT query_id, 0 AS step, []::BIGINT[] AS chosen FROM (SELECT DISTINCT query_id FROM cand)
  UNION ALL SELECT query_id, step + 1, list_append(chosen, (SELECT arg_max(c.id, struct_pack(v := 0.7 * c.score - 0.3 * greatest(coalesce((SELECT max(list_dot_product(c.e, s.e)) FROM cand s WHERE s.query_id = pick.query_id AND list_contains(pick.chosen, s.id)), 0), 0), p := c.pos)) FROM cand c WHERE c.query_id = pick.query_id AND NOT list_contains(pick.chosen, c.id)))
  FROM pick WHERE step < 10)"""


@query(_KNN.replace("WITH v", "WITH RECURSIVE v").replace("<= 15", "<= 30") + _MMR + " SELECT query_id, id, round(score, 6) AS score, CAST(list_position(chosen, id) AS INTEGER) AS mmr_pos FROM cand JOIN (SELECT query_id, chosen FROM pick WHERE step = 10) USING (query_id) WHERE list_contains(chosen, id)")
def mmr_rerank(spark, d):
    near = retrieval.knn(*_vectors(spark, d), 30)
    cands = near.join(_vectors(spark, d)[0], "id").select("query_id", "id", (1 - F.col("distance")).alias("score"), F.col("vec_rank").alias("cand_pos"), "embedding")
    return retrieval.rerank(cands, 10, 0.7).withColumn("score", F.round("score", 6))


@query()
def chunk_documents(spark, d):
    return chunked(docs(spark, d).select(F.col("id").alias("document_id"), "content"), ["document_id"], 1800, 200)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
