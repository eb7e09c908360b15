"""A corpus pipeline of five stages over `documents`; every stage works on all that the one before it kept.

1. language ID: documents without a letter, or of no clear language, go; a missing `lang` is filled in;
2. near duplicates: one document of each class of similar ones stays;
3. benchmark decontamination: contaminated documents go;
4. personal data: entities are replaced by surrogates;
5. SentencePiece: texts become ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgrid.llm import decontamination, language_id, ngram_jaccard, pii, sentencepiece
from sensorgrid.llm.shared import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRIED = ("lang", "source", "n_chars")
#: Mean probability below which no language is clear.
MIN_SCORE = 0.4

#: No SQL states the learnt and keyed stages; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language_id.predict(docs, *language_id.train(docs), keep=CARRIED)
    clear = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return clear.select("doc_id", "text", F.coalesce("kept.lang", "lang_pred").alias("lang"), "kept.source", "kept.n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.keep_one(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=CARRIED)
    return found.where(~F.col("contaminated")).select("doc_id", "text", "kept.*")


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    replaced = pii.replace(docs, pii.configured_key(spark, pii.TEST_KEY), keep=("lang", "source"))
    return replaced.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(docs)


STAGES = [
    ("language ID", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", replace_personal_data),
    ("SentencePiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
