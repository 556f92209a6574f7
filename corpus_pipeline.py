"""Five stages over `documents`: each gets the rows its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smsward.llm import bpe, decontaminate, minhash, pii, toxicity
from smsward.llm.common import table, written
from smsward.scratch import discard, mark


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows under their language's threshold; labels whose crc32(doc_id) mod 4 is 2 aren't learnt from."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    return scored.filter(~toxicity.rejected(scored, model)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with each span of personal data replaced by its kind; n_chars follows the text."""
    found = pii.find_spans(docs)
    text = F.col("redacted")
    return found.withColumns({"text": text, "n_chars": F.when(text.eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(text).cast("long"))}).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids (little-endian uint32) of each row."""
    import public_tokenizers

    coded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "lang", "source"))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the sketches; tests/llm compares run() with each stage done plainly.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        discard(spark, since, keep=1)  # what the stage and its predecessor wrote
    return docs
