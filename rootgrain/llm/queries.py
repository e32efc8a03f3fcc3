"""The registered query of each operator, with its production parameters."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, lexical, licenses, linededup, ngramjoin, packing, prefixtrie, quality, suffixdedup, tokencount, toxicity, urlfilter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents")).where("size(licence_sentences) > 0 OR n_unknown_sentences > 0")
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join("licence_sentences", ",").alias("licence_sentences"), "n_unknown_sentences")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048)
    return packed.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padding")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.fit(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    response = F.col("response")
    again = F.col("record_type") == "revisit"  # holds no payload: its record tells length and digest
    digest = F.when(again, F.substring_index(response["declared_digest"], ":", -1)).otherwise(response["payload_digest"])
    return read.select("page_id", F.when(again, response["http_length"]).otherwise(response["payload_bytes"]).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", "target_uri", F.col("request")["record_id"].alias("request_id"), F.size("metadata").alias("n_metadata"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = linededup.line_dedup(table(spark, sf_dir, "documents"))
    return deduped.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", F.sha2("text", 256).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), span=400, passage_words=51)
    repeated_words = F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["length"])
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), repeated_words.alias("n_repeated_words"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Host, path and verdict of the rules of op11 (fixed values).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    c = F.col("c")
    starts = conversations.select(F.col("conv_id").cast("long").alias("c")).where(c.isNotNull()).distinct()
    return prefixtrie.prefix_trie(conversations, starts.select("c", (c - c % 20).alias("base"), (F.crc32(c.cast("string")) % 4).alias("h")))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_packing": op2_packing,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_token_counts": op7_token_counts,
    "op8_line_dedup": op8_line_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_url_filters": op11_url_filters,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_lexical_search": op13_lexical_search,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op1_license_scan": licenses.oracle_sql(),
    "op4_quality_rules": quality.oracle_sql(),
    "op8_line_dedup": linededup.oracle_sql(),
    "op11_url_filters": f"""
        WITH rest AS (SELECT row_number() OVER () AS row, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        split AS (SELECT row, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        rules(rule_host, rule_path, verdict) AS (VALUES {", ".join(map(str, URL_RULES))})
        SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(verdict, 'allow') AS verdict
        FROM split LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(rule_host || rule_path) DESC) = 1""",
    "op12_prefix_trie": """
        WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        starts AS (SELECT c, c - c % 20 AS base, count(*) AS size,
                xor(list_reduce(list_transform(range(length(c::VARCHAR) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295::BIGINT ELSE ascii(substr(c::VARCHAR, i, 1))::BIGINT END),
                    lambda crc, b: list_reduce(list_transform(range(9), lambda i: CASE WHEN i = 0 THEN xor(crc, b) ELSE 0 END), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 4 AS h
            FROM own GROUP BY c),
        taken AS (SELECT s.c, s.base, s.h, least(s.h, coalesce(b.size, 0)) AS n FROM starts s LEFT JOIN starts b ON b.c = s.base),
        turns AS (SELECT t.c, o.pos AS d, o.role, o.text FROM taken t JOIN own o ON o.c = t.base AND o.pos <= t.n
            UNION ALL SELECT t.c, t.n + o.pos - t.h, o.role, o.text FROM taken t JOIN own o ON o.c = t.c AND o.pos > t.h),
        named AS (SELECT c, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, string_agg(sha256(length(role) || ':' || role || text), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS node FROM turns
            UNION ALL SELECT c, 0, 0, '' FROM starts),
        lengths AS (SELECT c, max(d) AS size FROM named GROUP BY c),
        nodes AS (SELECT node, any_value(d) AS d, min(c) AS m, count(*) AS n, any_value(words) AS words, count(*) FILTER (d = size) AS ends,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = size), '')) AS ends_sha256
            FROM named JOIN lengths USING (c) GROUP BY node),
        parents AS (SELECT x.node, p.node AS parent, q.m AS parent_m FROM nodes x JOIN named p ON p.c = x.m AND p.d = x.d - 1 JOIN nodes q ON q.node = p.node),
        children AS (SELECT parent AS node, count(*) AS n_children FROM parents GROUP BY parent),
        leaf AS (SELECT x.*, coalesce(n_children, 0) AS n_children FROM nodes x LEFT JOIN children USING (node)),
        subtrees AS (SELECT a.node, sum((x.n_children = 0)::INT) AS n_leaves, sum((x.n - 1) * x.words) AS saved_tokens FROM leaf x JOIN named a ON a.c = x.m AND a.d <= x.d GROUP BY a.node)
        SELECT m AS conv_id, d AS depth, parent_m AS parent_conv_id, n AS n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
        FROM leaf JOIN subtrees USING (node) LEFT JOIN parents USING (node)""",
    "op13_lexical_search": lexical.oracle_sql(),
}
