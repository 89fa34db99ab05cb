"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before it kept, stored as Parquet in the shared
folder.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.llm import decontaminate, langid, packing, simhash, toxicity
from signflow.llm.common import materialise, remove, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold.

    Null and empty texts score as a text without words does; null ids teach
    nothing and are judged like others; repeated rows are judged one by one;
    texts of any length are read whole; an empty table stays empty.
    """
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.clean_rows(docs, model)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; letterless and undecided texts go."""
    return langid.known_rows(docs, langid.train(docs.select("doc_id", "text", "lang")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts, the document with the smallest id; documents without words stay.

    Groups are searched by SimHash in the vantage-point tree, the pairs beyond
    its radius by MinHash, and all are verified on their whole shingle sets.
    """
    return simhash.one_per_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and wordless texts stay; null ids and repeated rows are rows of their
    own; texts of any length are searched whole; without items, or documents,
    nothing changes.
    """
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, packed into sequences.

    A null text counts as empty and has the closing token alone; null ids and
    repeated rows are packed like others; long texts are cut into pieces; an
    empty table gives no pieces.
    """
    out = packing.pack_documents(docs, public_tokenizers.path(packing.TOKENIZER))
    return out.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("langid", keep_known_languages),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: Trained models, similarity groups and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; what a stage stored is removed once the next one's documents are written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        for path in [*made[:-1], *([last] if last else [])]:
            remove(spark, path)
        last = made[-1]
    return STAGES[-1][1](spark, docs, sf_dir)
