"""The thin queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bsi_topk, collocations, media_wav, mixing, pii_sanitise, prefix_trie, quality_fm, sharding, simhash, sp_viterbi, token_orc, toxicity, url_filter
from .shared import crc32_sql
from .url_filter import Rule

RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)
#: The list of op1: urls whose host has one of these labels, taken among all urls of the corpus.
LISTED_HOSTS = r"(^|\.)(ads-|adult-|casino-|cheap-|free-|spam-)[a-z]+\."
TARGETS = {
    "source": mixing.Target(temper=0.5),
    "lang": mixing.Target({"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}),
    "topic": mixing.Target({"prose": 0.8, "tabular": 0.1, "contact": 0.05, "licence": 0.05}),
}
BUDGET, ITERATIONS = 0.5, 10
SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = url_filter.parsed_urls(pages).where(F.col("host").rlike(LISTED_HOSTS)).select(F.concat("host", "path").alias("key"))
    return url_filter.filter_urls(pages, RULES, listed)


def op2_bsi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bsi_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), TARGETS, BUDGET, ITERATIONS)


def op4_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.store_tokens(table(spark, sf_dir, "documents"))


def op8_media_wav(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media_wav.fingerprint_media(media_wav.store_media(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(":", F.size("time"), F.md5(F.concat(F.array_join("time", ","), F.lit(";"), F.array_join("hash", ","))))
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "time", "hash")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_viterbi.encode(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_sanitise.detect(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, first=2000)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.by_bytes(table(spark, sf_dir, "documents"), SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_url_filter, op2_bsi_topk, op3_mixing, op4_quality_fm, op5_toxicity, op6_simhash, op7_token_orc, op8_media_wav, op9_sentencepiece, op10_pii, op11_collocations, op12_prefix_trie, op13_sharding, pipeline)
    return {f.__name__: f for f in made}


def _op1_sql() -> str:
    url = "coalesce(url, '')"
    rules = sorted(RULES, key=lambda r: -len(r.name))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in rules]
    name = " ".join(f"WHEN {f} THEN '{r.name}'" for f, r in zip(fits, rules, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, rules, strict=True))
    return f"""WITH p AS (SELECT page_id, translate(regexp_extract({url}, '{url_filter.URL}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract({url}, '{url_filter.URL}', 2) AS path FROM pages), l AS (SELECT *, regexp_matches(host, '{LISTED_HOSTS}') AS listed FROM p)
        SELECT page_id, host, path, CASE {name} END AS rule, CASE {verdict} WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM l"""


_OP2_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": _op1_sql(), "op2_bsi_topk": _OP2_SQL, "op3_mixing": mixing.oracle("documents", TARGETS, BUDGET, ITERATIONS),
        "op11_collocations": collocations.ORACLE, "op12_prefix_trie": prefix_trie.oracle(crc32_sql("SELECT conv_id, h FROM x")), "op13_sharding": sharding.oracle(SHARDS, crc32_sql("SELECT key, h FROM o")),
    }
