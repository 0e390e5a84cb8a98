"""The dealt operators as queries over whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_gam, shared, sql, toxicity
from .decontam import matches
from .embedding_dedup import embedding_near_dedup
from .html_main import extract_main_text
from .line_dedup import dedup_lines
from .merge_dropout import decode, encode
from .ngram_join import ngram_jaccard_join
from .pii_feistel import pseudonymise
from .sale_enrichment import enriched_sales
from .suffix_dedup import remove_repeats
from .tandem_runs import periodic_runs
from .training import crc_fold
from .url_templates import judged_urls, url_parts


#: the pseudonyms' key in the registered query; a caller has one of its own
PII_KEY = "prismfold"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(shared.table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = shared.table(spark, sf_dir, "documents").select("doc_id", "text"), crc_fold(F.col("doc_id"), 3)
    machine = toxicity.train(docs, shared.table(spark, sf_dir, "labels"), fold != 1)
    out = toxicity.score(docs, machine, out="score")
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(shared.table(spark, sf_dir, "pages"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(encode(shared.table(spark, sf_dir, "documents").select("doc_id", "text")))
    same = F.coalesce("text", F.lit("")).eqNullSafe(F.col("decoded"))
    return out.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.xxhash64("tokens").alias("tokens_hash"), same.alias("lossless"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(shared.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(shared.table(spark, sf_dir, "documents")).drop("kept")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(shared.table(spark, sf_dir, "embeddings"))


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(shared.table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", "n_pii", F.array_join("pii_kinds", ",").alias("kinds"), "text")


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = shared.table(spark, sf_dir, "documents").select("doc_id", "text"), crc_fold(F.col("doc_id"), 5)
    model = quality_gam.train(docs, shared.table(spark, sf_dir, "labels"), fold != 0)
    out = quality_gam.score(docs, model, out="score")
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))


def op11_sale_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched_sales(shared.table(spark, sf_dir, "sales"), shared.table(spark, sf_dir, "client_changes"))


#: the policy of query 12
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's labels are those of the document whose number ends its path: good is of quality and not toxic."""
    pages, labels = shared.table(spark, sf_dir, "pages").select("page_id", "url"), shared.table(spark, sf_dir, "labels")
    number = F.regexp_extract(url_parts(F.col("url"))[1], r"([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    numbered = pages.select("page_id", F.when(number != "", number).cast("long").alias("doc_id"))
    known = labels.groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))
    return judged_urls(pages, URL_RULES, numbered.join(known, "doc_id").select("page_id", "good"))


def _looped(docs: DataFrame) -> DataFrame:
    """The documents of query 13: in a tenth of them, by crc32 of the id, the words from some place on go round in a loop."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    picked = F.when(h % 10 == 0, words)
    loop = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda k: F.element_at("w", F.when(k < F.col("a"), k).otherwise(F.col("a") + (k - F.col("a")) % F.col("p")).cast("int") + 1))
    out = docs.select("doc_id", "text", picked.alias("w"), g.alias("g"))
    out = out.withColumn("a", F.col("g") % F.size("w")).withColumn("p", 1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8)))
    return out.select("doc_id", F.when(F.size("w") > 0, F.array_join(loop, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_looped(shared.table(spark, sf_dir, "documents")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    found = found.withColumn("top", top)
    start, period = -F.col("top.start"), -F.col("top.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), F.col("top.length").alias("length"), period.alias("period"), F.floor(1000 * F.col("top.length") / period).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_toxicity, op3_html_main_text, op4_sentencepiece, op5_line_dedup, op6_suffix_array_dedup, op7_embedding_near_dedup, op8_pii_pseudonyms, op9_quality_gam, op10_benchmark_decontamination, op11_sale_enrichment, op12_url_filter, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    """The others have none: trained models (2, 9), a style tree (3), keyed draws (4, 8), MinHash candidates (5), block-max search (10), a template tree (12)."""
    return {"op1_ngram_jaccard_join": sql.OP1, "op6_suffix_array_dedup": sql.OP6, "op7_embedding_near_dedup": sql.OP7, "op11_sale_enrichment": sql.OP11, "op13_periodic_runs": sql.OP13}
