"""A training corpus from documents, in stages; each one's rows are written and read again."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barometry.llm import decontam, neardup, packing, quality, scratch, secrets, tokens

#: Window for decontamination, shingle size and similarity for near duplicates, tokens of a sequence, owners of a secret that looks live.
WINDOW, SHINGLE, PERCENT, CAPACITY, OWNERS = 10, 5, 80, 4096, 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior rejects go; a null text is empty and goes, ids don't matter."""
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, and one row of those that repeat it; null and empty texts stay."""
    return neardup.deduplicated(docs, SHINGLE, PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, each by its own text; null texts stay."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), WINDOW)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that look live are masked in the text; all documents stay, null texts as they are."""
    masked = secrets.redacted(docs, owner_col="source", repo_col=F.concat_ws("/", "source", "lang"), max_owners=OWNERS)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into sequences; a null text is its end id alone."""
    return packing.pack(docs, tokens.default_tokenizer(), CAPACITY)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("benchmark_decontamination", benchmark_decontamination), ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: Tokenizing and packing are not SQL; tests hold the pipeline against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order. A stage's own tables go when its rows are written, and these when the next stage's are."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch.place(spark, name)
        with scratch.scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            scratch.remove(spark, last)
        last = path
    return docs
