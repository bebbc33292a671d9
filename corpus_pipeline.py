"""A corpus pipeline: toxic documents go, one of each group of near copies stays, repeated passages go, personal data is
replaced, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows it gets; all but the last return the columns of documents.
No stage but packing adds or removes rows for other reasons, and clean texts stay as they are.  Before each one, executors
give back the heap that the one before needed.

Defined results: a null text stays null but counts as empty; an empty text is packed as its end alone; equal texts are one
document after the second stage, of ties the least doc_id stays (null ids last); rows that repeat an id with different
texts are documents of their own; texts of any length are worked on whole; empty tables give empty results; extra columns
of documents stay what they are, whatever their names, those of the operators included.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm import near_copies, packing, phrase_automata, pii, toxicity
from trellis.llm.common import checkpoint_dir, heaps_released, removed_folder, table

def _plain(docs: DataFrame) -> DataFrame:
    """doc_id and text, and the other columns under names that clash with no operator's own."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"own {i}") for i, c in enumerate(docs.columns)))


def _named(out: DataFrame, like: DataFrame, text=None) -> DataFrame:
    """The columns as they came; with a text, with that and its number of characters."""
    new = {} if text is None else {"text": text, "n_chars": F.length(text).cast(like.schema["n_chars"].dataType) if "n_chars" in like.columns else None}
    return out.select(*((new[c] if c in new else F.col(c if c in ("doc_id", "text") else f"`own {i}`")).alias(c) for i, c in enumerate(like.columns)))


def not_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score below the threshold."""
    heaps_released(spark)
    scored = toxicity.toxicity(_plain(docs), table(spark, sf_dir, "labels"), "score")
    return _named(scored.where(F.col("score") < toxicity.THRESHOLD), docs)


def one_of_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    heaps_released(spark)
    return near_copies.one_of_each(docs)


def without_repeated_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lose words become the words that stay, joined by spaces; a text may become empty."""
    heaps_released(spark)
    out = phrase_automata.without_repeats(_plain(docs))
    return _named(out, docs, F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text")))


def without_personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    heaps_released(spark)
    return _named(pii.redacted(_plain(docs)), docs, F.col("text"))


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    heaps_released(spark)
    return packing.packed(docs)


STAGES = [("toxicity", not_toxic), ("simhash_near_dedup", one_of_near_copies), ("substring_dedup", without_repeated_passages), ("pii", without_personal_data), ("best_fit_packing", packed)]

#: SQL expresses neither the learned stages nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder, read again, and deleted when the next are written."""
    docs, place = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            removed_folder(spark, f"{place}/{k - 1}")
    return docs
