"""Registered queries of the text operators, and the SQL of those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession, functions as F
import public_tokenizers

from floodframe.llm import classifier, collocations, decontaminate, licences, lm, neardup, neighbours, packing, passages, rules, token_files, turns, urls
from floodframe.llm.common import prepare, scratch_path, table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Hosts of the pages query's list name one of these trades.
LISTED_HOSTS = "casino|pills"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("item_ids", "spans")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    trusted = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("is_trusted"))
    return rules.quality_rules(table(spark, sf_dir, "documents"), trusted)


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE))
    return token_files.token_index(spark, path)


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    pages = table(spark, sf_dir, "pages")
    host = urls.host_of(F.col("url"))
    listed = pages.where(host.rlike(LISTED_HOSTS)).select(urls.canonical(host, urls.path_of(F.col("url"))).alias("url"))
    return urls.filter_urls(pages, listed)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    scored = lm.score(docs, lm.fit(docs.where(lm.remainder(F.col("doc_id")) != 2)))
    held_out = F.coalesce(lm.remainder(F.col("doc_id")) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    scored = classifier.score(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return collocations.top_phrases(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return turns.prefix_trie(turns.rebuilt(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_quality_rules, op3_repeated_passages, op4_near_duplicates, op5_pack, op6_token_files, op7_licences, op8_url_filter, op9_lm_score, op10_quality_classifier,
                                      op11_nearest_vectors, op12_collocations, op13_prefix_trie)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = {
    "op1_decontaminate": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM windows),
        grams AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
        hits AS (SELECT doc_id, grams.n, i, item_id FROM grams JOIN windows ON grams.n = windows.n AND grams.s = windows.s),
        spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
        items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS item_ids FROM hits GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(len(item_ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(item_ids, ','), '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_licences": licences.oracle(),
    "op8_url_filter": f"""
        WITH p AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
        c AS (SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') AS url FROM p),
        listed AS (SELECT DISTINCT url FROM c WHERE regexp_matches(host, '{LISTED_HOSTS}')),
        r AS (SELECT *, CASE
            WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
               WHEN url IN (SELECT url FROM listed) THEN 'block' ELSE 'allow' END AS verdict
        FROM r""",
    "op12_collocations": collocations.ORACLE,
    "op13_prefix_trie": turns.ORACLE,
}
