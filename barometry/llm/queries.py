"""The queries of this subpackage: each applies one operator to its whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import counts, decontam, licenses, neardup, oracle, packing, phrases, pii, quality, repeats, secrets, tokens, trie, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: documents are filed by source, language and hundreds; of each ten one is a licence file of its hundred, one of its language and one of its source."""
    folders = [F.expr("cast(doc_id div 100 as string)"), F.col("lang"), F.col("source")]
    number, ten = F.col("doc_id").cast("string"), F.col("doc_id") % 10
    licence = F.concat(F.lit("LICENSE-"), number)
    at = lambda k, name: F.concat_ws("/", *reversed(folders[k:]), name)
    path = F.when(ten == 0, at(0, licence)).when(ten == 1, at(1, licence)).when(ten == 2, at(2, licence)).otherwise(at(0, F.concat(number, F.lit(".txt"))))
    return licenses.scan(table(spark, sf_dir, "documents"), path)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = F.concat_ws("/", "source", "lang")
    return secrets.summary(secrets.classified(table(spark, sf_dir, "documents"), owner_col="source", repo_col=repo, max_owners=2))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(spark, table(spark, sf_dir, "documents"), tokens.default_tokenizer())


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"), key="key of the corpus")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.summary(decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_table(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.default_tokenizer(), capacity=4096)


def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents"), length=400)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), counts.default_model(), limit=4096)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, most=2000)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scan, op2_secret_scan, op3_minhash_near_dedup, op4_token_output, op5_pii_surrogates, op6_benchmark_decontamination, op7_warc_revisits, op8_quality_rules, op9_best_fit_packing, op10_repeated_strings, op11_token_counts, op12_phrase_collocations, op13_conversation_trie)}
ORACLE_SQL: dict[str, str] = dict(oracle.SQL)
