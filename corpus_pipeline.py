"""A corpus pipeline over ``documents``: language, repeated lines, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last return the columns of the
documents; the last returns packed pieces. ``run`` writes each stage's rows as Parquet in the shared folder and reads
them again for the next one, so the loss of executors costs no more than the stage that runs.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomdoc.llm import decontaminate, jaccard, langid, linededup, packing
from fathomdoc.llm.common import scan_table, written

TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker of the last stage keeps, some 150 bytes each: executors are full of the stages before.
REMEMBERED = 250_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, trained on their own labels, does not reject; without labels, all."""
    model = langid.train(docs, F.lit(True))
    if not model.languages:
        return docs
    return langid.identify(docs, model).filter("NOT rejected").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line repeats; documents that were only such lines go."""
    return linededup.without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 on shingles of five words."""
    return jaccard.one_of_each(docs, width=5, percent=80)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, scan_table(spark, sf_dir, "benchmark"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary lengths, each a sequence of its own."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), remembered=REMEMBERED)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_documents),
]

#: The stages learn models and read a tokenizer, which SQL cannot express; tests compare them with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
