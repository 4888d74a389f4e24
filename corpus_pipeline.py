"""The corpus pipeline: five stages, each written as Parquet and read again before the next.

1. ``toxicity``: documents that the toxicity model rejects go;
2. ``simhash``: one document of each group of near duplicates (five-word shingles, a similarity of 0.8 or more) stays;
3. ``pseudonyms``: personal data is replaced by format-preserving pseudonyms;
4. ``mixing``: documents are taken as often as the mix of sources says (some twice, some not at all);
5. ``sentencepiece``: what is left is encoded to piece ids and decoded again.

All stages but the last return the columns of documents, and extra columns if there are any.  Every stage takes null, empty and
very long texts, nulls in other columns, ties, repeated rows and empty tables; what it returns for them is stated with its
operator: ``loomql.llm`` op3, op1, op5, op7 and op4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomql.llm import op1_simhash, op3_toxicity, op4_sentencepiece, op5_pseudonyms, op7_mixing
from loomql.plans.scratch import stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.5 stay, whatever their columns hold; null and empty texts score as empty ones and stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return op3_toxicity.without_toxic(docs, op3_toxicity.train(docs, labels))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row of least doc_id stays, null ids last; texts without words are one component."""
    return op1_simhash.representatives(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; a null text stays null; ``n_chars`` changes by as much as the text's length does."""
    done = op5_pseudonyms.pseudonymise(docs)
    grown = F.col("row.n_chars") + F.coalesce(F.length("text") - F.length("row.text"), F.lit(0))
    of = {"text": F.col("text"), "n_chars": grown.cast("long")}
    return done.select(*[of.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come as often as the mix takes them; rows without words count nothing and fall with their key."""
    return op7_mixing.mixed_rows(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of ids and digests for every row that is left; null and empty texts have no ids."""
    return op4_sentencepiece.encode_documents(docs)


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("pseudonyms", pseudonyms), ("mixing", mixing), ("sentencepiece", sentencepiece)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last goes through a table in the scratch folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
