"""The corpus pipeline: five of the llm operators over documents, each stage written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, mixing, neardup, tokens, toxicity
from lodestone.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5. The machine learns from the labelled rows of the documents at hand.

    Every row is rated by its own text, so repeated ids and rows do no harm. Null and empty texts score like the least toxic text
    learned from and stay. Where one label or none was learned from all rows score alike; an empty table stays empty.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates (five words, similarity 0.8).

    Rows are judged by id and text: of rows with one id and other texts only those go whose own text is a copy of a smaller id's.
    Rows equal in both are one document and stay together. Rows without an id, words or text are linked with nothing and stay.
    """
    found = neardup.near_duplicates(docs, percent=80)
    gone = cut(found.where("not kept").select("doc_id", "row_key").distinct(), "neardup-gone")
    return without(docs, gone)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Rows are judged by id and text; null and empty texts stay."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = cut(found.where("n_hit > 0").select("doc_id", "row_key").distinct(), "contaminated")
    return without(docs, gone)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs that are not among gone (doc_id, row_key: hash of the text)."""
    marked = docs.select(*COLUMNS, F.xxhash64("text").alias("row_key"))
    return marked.join(gone, marked["doc_id"].eqNullSafe(gone["doc_id"]) & (marked["row_key"] == gone["row_key"]), "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix of the sources takes: a row for each stretch of a document's scheduled blocks.

    Rows without words are never taken. Of rows equal in id, source and text one stands for all, as often as they are taken.
    """
    return mixing.apply_mix(docs.select(*COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token table of all rows, as read back: doc_id, start, n_tokens, ids_crc32. Rows of one id follow the hash of their text."""
    return tokens.token_table(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_output", tokenize),
]

#: The machine, the tokenizer and the join of stages are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
