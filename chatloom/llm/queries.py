"""The operators' queries over the driver tables, with SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import chunk_dedup, decontaminate, mixing, ngram_join, ogg, pii, quality, sharding, token_files, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


@query(
    "op2_url_filter",
    """
    WITH p AS (
      SELECT page_id,
             translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
      FROM pages),
    r AS (SELECT *, split_part(rule, '/', 1) AS rh, substr(rule, strpos(rule, '/')) AS rp
          FROM (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'),
                       ('net/es/', 'block'), ('net/fr/', 'block')) v(rule, verdict))
    SELECT page_id, host, path,
           (SELECT max_by(rule, length(rule)) FROM r
            WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
           coalesce((SELECT max_by(verdict, length(rule)) FROM r
            WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict
    FROM p
    """,
)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


#: The mixture's tree: a domain for each source, and whole-number weights by level.
DOMAIN_SQL = "CASE WHEN source = 'src0' THEN 'web' WHEN source IN ('src1','src2','src3','src4','src5','src6','src7','src8','src9') THEN 'reference' ELSE 'forum' END"
MIX_WEIGHTS = {"domain": {"web": 2, "reference": 5, "forum": 3}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}
MIX_SEED, MIX_EPOCHS, MIX_SHARE = 17, 2, 1.0


def _share_sql(prefix: str, children: str, parent: str, key: str) -> str:
    """CTEs that share each parent's budget among ``children`` (parent, key, w0, cap, budget)."""
    part = f"PARTITION BY {parent}" if parent else ""
    order = f"{part} ORDER BY CASE WHEN w > 0 THEN cap::DOUBLE / w END NULLS LAST, {key}"
    return f"""
    {prefix}1 AS (SELECT *, CASE WHEN cap > 0 THEN w0 ELSE 0 END AS w FROM ({children})),
    {prefix}2 AS (SELECT *, coalesce(sum(CASE WHEN w > 0 THEN cap END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
                         sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {prefix}1),
    {prefix}3 AS (SELECT *, w > 0 AND cap * rest <= w * (budget - spent) AS filled FROM {prefix}2),
    {prefix}4 AS (SELECT *, budget - coalesce(sum(CASE WHEN filled THEN cap END) OVER ({part}), 0) AS remaining,
                         CASE WHEN filled THEN 0 ELSE w END AS o FROM {prefix}3),
    {prefix}5 AS (SELECT *, sum(o) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(o) OVER ({part}) AS whole FROM {prefix}4),
    {prefix} AS (SELECT *, CASE WHEN filled THEN cap WHEN w > 0 AND whole > 0 THEN (remaining * upto) // whole - (remaining * (upto - o)) // whole ELSE 0 END AS got FROM {prefix}5)"""


def _weights_sql(level: str) -> str:
    cases = " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in MIX_WEIGHTS.get(level, {}).items())
    return f"CASE {cases} ELSE 1 END" if cases else "1"


def mix_sql() -> str:
    """The mixture under MIX_WEIGHTS in SQL."""
    return f"""
    WITH d AS (
      SELECT doc_id, {DOMAIN_SQL} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::HUGEINT AS n_tokens
      FROM documents),
    leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, CASE WHEN {" AND ".join(f"{_weights_sql(x)} > 0" for x in mixing.LEVELS)} THEN sum(n_tokens) * {MIX_EPOCHS} ELSE 0 END AS cap FROM d WHERE n_tokens > 0 GROUP BY domain, lang, source),
    {_share_sql("dom", f"SELECT domain, sum(cap) AS cap, {_weights_sql('domain')} AS w0, (SELECT least(sum(cap), (SELECT sum(n_tokens) FROM d)) FROM leaf) AS budget FROM leaf GROUP BY domain", "", "domain")},
    {_share_sql("lan", f"SELECT leaf.domain, lang, sum(leaf.cap) AS cap, {_weights_sql('lang')} AS w0, any_value(got) AS budget FROM leaf JOIN dom ON leaf.domain = dom.domain GROUP BY leaf.domain, lang", "domain", "lang")},
    {_share_sql("src", f"SELECT leaf.domain, leaf.lang, source, leaf.cap AS cap, {_weights_sql('source')} AS w0, got AS budget FROM leaf JOIN lan ON leaf.domain = lan.domain AND leaf.lang = lan.lang", "domain, lang", "source")},
    plan AS (SELECT leaf.domain, leaf.lang, leaf.source, got // tokens AS epochs, got % tokens AS prefix
             FROM leaf JOIN src ON leaf.domain = src.domain AND leaf.lang = src.lang AND leaf.source = src.source),
    e AS (SELECT doc_id, d.domain, d.lang, d.source, n_tokens, epochs, prefix, unnest(range(0, epochs::BIGINT + 1)) AS epoch
          FROM d JOIN plan ON d.domain = plan.domain AND d.lang = plan.lang AND d.source = plan.source WHERE n_tokens > 0),
    o AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch
                 ORDER BY md5('{MIX_SEED}:' || epoch || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
    SELECT doc_id, domain, lang, source, epoch::INT AS epoch, n_tokens::BIGINT AS n_tokens,
           (CASE WHEN epoch < epochs THEN n_tokens ELSE least(n_tokens, prefix - before) END)::BIGINT AS take_tokens
    FROM o WHERE epoch < epochs OR before < prefix
    """


@query("op4_mixing", mix_sql())
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_SHARE, MIX_WEIGHTS, F.expr(DOMAIN_SQL), MIX_SEED, MIX_EPOCHS)


@query("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


@query("op10_ngram_join")
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


#: The tokenizer's file: a parameter, looked up where the queries run.
TOKENIZER = "byte_bpe_50k.json"


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files, freq = token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end=2)
    return token_files.read_tokens(files, freq)


@query("op1_ogg")
def op1_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.round_trip(table(spark, sf_dir, "documents"))


@query("op3_chunk_dedup")
def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id", "source", "lang"])
