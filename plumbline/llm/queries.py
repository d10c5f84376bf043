"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ann, bpe, chat, exact_dedup, fim, html_extract, jaccard, langid, minhash, packing, token_store, trie, url_filter
from plumbline.llm.common import scratch, table

IDS_FILE = public_tokenizers.path("byte_bpe_50k.json")
BPE_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
URL_RULES = [
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
]


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_texts(table(spark, sf_dir, "documents"), BPE_FILE), BPE_FILE)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), IDS_FILE)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one more (-7), whose turns hold control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, i, role, "\\### Assistant: </turn> ok") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(more)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs), ["doc_id"])
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    token_store.write_store(table(spark, sf_dir, "documents"), path, IDS_FILE)
    return token_store.checksums(token_store.read_store(spark, path))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    whole = fim.restored(F.col("output"), F.col("form"))
    digests = (F.sha2(c, 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (whole, "restored_sha256")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar_documents(table(spark, sf_dir, "documents"), width=5, percent=80)
    return found.select("doc_id", "n_shingles", "component_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_html_extract, op2_byte_bpe, op3_url_filter, op4_near_dedup, op5_exact_dedup, op6_packing, op7_chat_format, op8_language_id, op9_token_store, op10_ann,
        op11_fill_in_middle, op12_jaccard_join, op13_prefix_trie,
    )
    return {f.__name__: f for f in found}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(width: int, percent: int) -> str:
    """Shingle sets, their links and what these reach: ``sets`` (doc_id, s) and ``least`` (doc_id, component_id)."""
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' ')) END) AS s FROM words),
held AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)"""


_DRAWS = ", ".join(f"CAST('0x' || substr(s, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
# CRC-32 of the decimal id: eight steps by the reversed polynomial for each byte, as SQL has no such function.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(str_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda v, i: xor(v // 2, 3988292384 * (v % 2)))), 4294967295)"

ORACLE_SQL = {
    "op3_url_filter": r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (
  SELECT page_id, host, path, max(struct_pack(n := length(h || p), rule := h || p, v := v)) AS best
  FROM split LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY ALL)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM fit
""",
    "op4_near_dedup": _components(3, 85) + " SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)",
    "op5_exact_dedup": f"""
WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
""",
    "op11_fill_in_middle": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, length(x) AS n, {_DRAWS} FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(x, 1, a) AS pre, substr(x, a + 1, b - a) AS mid, substr(x, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256
FROM p
""",
    "op12_jaccard_join": _components(5, 80) + " SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN least USING (doc_id)",
    "op13_prefix_trie": f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY place) AS own, {_CRC} % 4 AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, coalesce(b.own[:c.h], []) || c.own[c.h + 1:] AS turns FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, len(turns) AS size, d AS depth, turns[:d] AS path, turns[d].text AS last FROM r, unnest(range(0, len(turns) + 1)) u(d)),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) = depth AS leaf,
        CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(last), '[^\x20\x09-\x0D]+')) END AS words,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM p GROUP BY depth, path),
below AS (SELECT top.depth, top.path, sum((n.n_convs - 1) * n.words) AS saved_tokens, count(*) FILTER (n.leaf) AS n_leaves, count(*) FILTER (n.depth = top.depth + 1) AS n_children
  FROM n JOIN n top ON top.depth <= n.depth AND n.path[:top.depth] = top.path GROUP BY ALL)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN below USING (depth, path) LEFT JOIN n up ON up.depth = n.depth - 1 AND up.path = n.path[:n.depth - 1]
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
