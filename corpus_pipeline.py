"""A corpus pipeline of five of the numbered operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents.  All stages but the last
return the columns of ``docs`` in their order; n_chars follows the text where a
stage changes it.

1. quality_filter   documents that the quality classifier rejects go
2. near_dedup       of each group of near-duplicates one document stays
3. decontaminate    passages of the benchmark are cut out; emptied documents go
4. redact_secrets   secret values are replaced by [SECRET]
5. pack             documents are tokenized and packed to sequences

In all stages columns other than doc_id and text may hold nulls and have any names,
those of an operator's results included: they travel in a struct and come out as
they went in.  Very long texts are worked on whole.  An empty table gives an empty
table.  Each stage states what nulls, empty texts, ties and repeated rows give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _retexted(found: DataFrame, columns: list[str], changed) -> DataFrame:
    """The carried columns with the cleaned text, and its length where it changed."""
    length = F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col("carried.n_chars")) if "n_chars" in columns else None
    made = {"text": F.col("clean_text"), "n_chars": length}
    return found.select(*(made[c].alias(c) if c in made else F.col(f"carried.`{c}`") for c in columns))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.3 or more.

    Null and empty texts have the score of such texts among the labels.  Rows that
    repeat an id are judged each for itself, equal texts alike.
    """
    from ledgerframe.llm.quality import score_quality

    scored = score_quality(docs, _table(spark, sf_dir, "labels"), carry=docs.columns)
    return scored.filter("predicted = 1").select("carried.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8; of a group the least doc_id stays.

    Null and empty texts, and rows with a null id, are near nothing and stay.  Rows
    that repeat an id are one document: all stay or all go.
    """
    from ledgerframe.llm.minhash_dedup import near_duplicates

    gone = near_duplicates(docs, words=5, percent=80).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of the benchmark; a text of nothing else goes.

    Null and empty texts hold no passage and stay.  Rows that repeat an id are judged
    each for itself.
    """
    from ledgerframe.llm.decontamination import decontaminate

    found = decontaminate(docs, _table(spark, sf_dir, "benchmark"), carry=[c for c in docs.columns if c != "text"])
    return _retexted(found.filter("NOT contaminated OR trim(clean_text) != ''"), docs.columns, F.col("contaminated"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose secret values read [SECRET]; every document stays.

    Null and empty texts hold no secret.  Rows that repeat an id are judged each for
    itself.
    """
    from ledgerframe.llm.secret_scan import scan_secrets

    found = scan_secrets(docs, carry=[c for c in docs.columns if c != "text"])
    return _retexted(found, docs.columns, F.col("spans") != "")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed; a null or empty text is one piece of the end id.

    Rows that repeat an id are packed each for itself.
    """
    from ledgerframe.llm.packing import pack

    return pack(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate_benchmark),
    ("redact_secrets", redact_secrets),
    ("pack", pack_sequences),
]

#: SQL cannot express the classifier, the random field or the packing; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerframe.llm._tables import materialize

    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
