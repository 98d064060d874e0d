"""The operators' queries over the tables, and their SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, counts, decontam, htmltree, langid, near, orcout, packing, periodic, telephony, toxicity, warc, whiten
from .common import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltree.main_text(_table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Pieces of all documents in windows of 4,096 ids."""
    return packing.digest_pieces(packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer), 2))


def op3_orc_tokens(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """All documents' ids written to ORC files and read back."""
    path = Workspace(spark, "orc").path("ids")
    orcout.write_orc(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(tokenizer), 0)
    return orcout.digest_ids(orcout.read_orc(spark, path))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page asked for again and resolved to the latest earlier capture of
    its canonical URL."""
    found = warc.resolve_revisits(warc.captures_of_pages(_table(spark, sf_dir, "pages")))
    head = lambda k: F.col("headers")[k].alias("h_" + k.replace("-", "_"))
    return found.select("record_id", "canonical", "captured", "response_id", "status", head("etag"), head("date"), head("content-type"), head("content-length"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, formatted, stored and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    kinds = dict(rows.dtypes)
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    more = more.select(*(F.col(c).cast(kinds[c]) for c in rows.columns))
    stored = Workspace(spark, "chat").save(chat.format_turns(rows.unionByName(more)), "turns")
    return chat.digests(chat.read_turns(stored))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.training_text(docs))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and links of every document."""
    return near.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' bytes stored as mu-law, A-law or ADPCM clips, read back,
    described, and decoded to resampled PCM."""
    clips = telephony.store_clips(_table(spark, sf_dir, "documents"))
    return telephony.describe(Workspace(spark, "media").save(clips, "clips"))


def _made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h the checksum of a tenth of the ids, every word from
    the a-th on is the one some whole number of periods before it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    rows = docs.select("doc_id", "text", (h.cast("decimal(20,0)") / 10).cast("long").alias("g"), F.when(h % 10 == 0, split).alias("words"))
    rows = rows.withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    made = F.expr("concat(slice(words, 1, int(a)), slice(flatten(array_repeat(slice(words, int(a) + 1, int(p)), int((n - a) div p) + 1)), 1, int(n - a)))")
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, after a tenth of the documents
    were made periodic."""
    return periodic.digest_runs(periodic.find_runs(_made_periodic(_table(spark, sf_dir, "documents"))))


def op12_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Tokens of every document."""
    return counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every embedding."""
    found = whiten.whiten(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_html_tree, op2_packing, op3_orc_tokens, op4_warc_revisits, op5_chat_format, op6_language_id, op7_ngram_jaccard, op8_toxicity, op9_decontamination, op10_telephony, op11_periodic_runs, op12_token_counts, op13_embedding_whitening]
    return {f.__name__: f for f in found}


_CANONICAL = r"""
  regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^(www|m)[.]', ''), ':(80|443)$', '')
  || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/$', '')
  || CASE WHEN q <> '' THEN '?' || q ELSE '' END
"""

_SQL = {
    # the pages' articles hold headings, paragraphs, bold text, line breaks and named references only
    "op1_html_tree": r"""
WITH parts AS (
  SELECT page_id, url, string_split_regex(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</?(?:p|h1)>') AS part FROM pages
), lines AS (
  SELECT page_id, url, list_transform(part, lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS line FROM parts
), texts AS (
  SELECT page_id, url, coalesce(array_to_string(list_filter(line, lambda x: x <> ''), chr(10) || chr(10)), '') AS text FROM lines
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts""",
    "op4_warc_revisits": rf"""
WITH bared AS (
  SELECT page_id, html, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages
), asked AS (
  SELECT *, regexp_replace(regexp_replace(regexp_extract(bare, '[?](.*)$', 1), '(^|&)(utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*', '', 'g'), '^&', '') AS q FROM bared
), p AS (
  SELECT page_id, '"' || coalesce(md5(html), 'none') || '"' AS tag, coalesce(length(html), 0) AS n, {_CANONICAL} AS canonical FROM asked
), m AS (
  SELECT v.page_id, v.canonical, v.tag, r.page_id AS rid, r.tag AS rtag, r.n
  FROM p v ASOF LEFT JOIN p r ON v.canonical = r.canonical AND v.page_id + 1 >= r.page_id
)
SELECT 'v' || page_id AS record_id, canonical, page_id * 10 + 15 AS captured, 'r' || rid AS response_id,
  CASE WHEN rid IS NULL THEN 'no-response' WHEN tag = rtag THEN 'resolved' ELSE 'validator-mismatch' END AS status,
  CASE WHEN tag = rtag THEN tag END AS h_etag,
  CASE WHEN tag = rtag THEN (page_id * 10 + 15)::VARCHAR END AS h_date,
  CASE WHEN tag = rtag THEN 'text/html' END AS h_content_type,
  CASE WHEN tag = rtag THEN n::VARCHAR END AS h_content_length
FROM m""",
    "op5_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), r AS (
  SELECT *, '### ' || role || ': ' || text || ' </turn>' || chr(10) AS plain,
    replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), ': ', ':\/ ') AS r1,
    replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>') AS t1
  FROM c
), f AS (
  SELECT *, CASE WHEN len(string_split(plain, '###')) = 2 AND len(string_split(plain, '</turn>')) = 2
      AND NOT contains(plain, '\') AND string_split(role || ': ', ': ')[1] = role
    THEN plain ELSE '### ' || r1 || ': ' || t1 || ' </turn>' || chr(10) END AS formatted
  FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(length(formatted))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id""",
    "op7_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(w[i:i + 4])))
    WHEN len(w) > 0 THEN [hash(w)] WHEN text <> '' THEN [hash('raw' || text)] ELSE [] END AS s
  FROM w
), c AS (
  SELECT s, min(doc_id) AS head, count(*) AS copies FROM s WHERE len(s) > 0 GROUP BY s
), u AS (
  SELECT head, copies, len(s) AS n, unnest(s) AS g FROM c
), pair AS (
  SELECT a.head AS a, b.head AS b, any_value(b.copies) AS copies
  FROM u a JOIN u b ON a.g = b.g AND a.head <> b.head
  GROUP BY a.head, b.head HAVING 5 * count(*) >= 4 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT head AS a, head AS b FROM c UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a
), root AS (
  SELECT a, min(b) AS class_id FROM reach GROUP BY a
), links AS (
  SELECT a, sum(copies) AS n FROM pair GROUP BY a
)
SELECT s.doc_id, coalesce(root.class_id, s.doc_id) AS class_id, (coalesce(c.copies - 1, 0) + coalesce(links.n, 0))::BIGINT AS n_links
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN root ON root.a = c.head LEFT JOIN links ON links.a = c.head""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
