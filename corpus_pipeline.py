"""The corpus pipeline: language ID, near-duplicates, repeated passages, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of `documents`, whatever these are.

Defined cases: null, empty and letterless texts go in the first stage; rows with a
null id are documents like any other; of repeated rows, and of other ties of near
copies, one stays; an empty table passes all stages; whole texts are read whatever
their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.llm import decontam, langid, near_dup, packing, suffix_dedup
from traitloom.llm.common import discard, last_written, read
from traitloom.llm.queries import tokenizer_path

#: Bytes of a string whose repeats are removed whatever its words.
PASSAGE_BYTES = 200
#: Words of a string whose repeats are removed even where it has fewer bytes: any passage of over 50 words holds one.
PASSAGE_WORDS = 51


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in none of the learned languages with any certainty, go."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8) stays."""
    return near_dup.one_of_each(docs, words=5, least=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that stand more than once are cut out; documents of which nothing is left go."""
    done = suffix_dedup.remove_repeats(docs, size=PASSAGE_BYTES, words=PASSAGE_WORDS, whole_characters=True)
    _, spans, kept = done.columns[-3:]
    cut, rest = F.size(spans) > 0, F.col(kept).cast("string")
    out = done.where(~cut | (F.octet_length(F.trim(rest)) > 0)).withColumn("text", F.when(cut, rest).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window of ten words go."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, one row per piece."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: No stage before packing's tokenizer and the trained network can be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; a stage's tables are deleted when the next one's is written."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        done = last_written(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir))
        if k:
            discard(spark, [docs.written_to])
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
