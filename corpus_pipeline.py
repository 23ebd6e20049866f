"""A training corpus from documents: five stages, each on all that the one before it kept.

1. quality classifier: documents that it rejects go;
2. n-gram Jaccard join: of each group of near copies the document with the smallest id stays;
3. substring dedup: passages of 50 words and more that a document with a smaller id has go, and with
   them documents of which nothing is left;
4. benchmark decontamination: documents that contain a test item go;
5. SentencePiece encoding: each document's ids.

The first four return the columns of documents. Rows without an id go in the first stage. Rows that
share an id are one document: a decision about one of them holds for all. Null texts are empty and
pass as the classifier judges them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import decontaminate, partenum, pieces, quality, substrings
from lamina.llm.common import stored, table
from lamina.llm.queries import tokenizer_file

#: What the classifier gives clean documents is close to 1; only what it holds for bad goes.
LEAST_QUALITY = 0.5
PASSAGE_WORDS = 50


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of LEAST_QUALITY at least. The model learns from the training part
    of the labels."""
    docs = docs.where("doc_id is not null")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels").where(quality.training_part()))
    scores = quality.score_quality(docs, model).where(F.col("score") < LEAST_QUALITY).select("doc_id").distinct()
    return docs.join(scores, "doc_id", "left_anti").select(docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with five-word shingles 0.8 alike the one with the smallest id."""
    found = partenum.similar_documents(docs, n=5, percent=80)
    copies = found.where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller id has; texts that lose all their words go."""
    # each row carries its other columns: a join back on the id would mix rows that share one
    rest = [c for c in docs.columns if c != "text"]
    found = substrings.remove_repeats(docs.withColumn("__null", F.col("text").isNull()), PASSAGE_WORDS, carry=[*rest, "__null"])
    cut, text = F.col("n_removed") > 0, F.when(~F.col("row.__null"), F.col("cleaned").cast("string"))
    out = found.where(~cut | (F.col("n_removed") < F.col("n_words"))).select("row.*", text.alias("text"), cut.alias("__cut"))
    return out.withColumn("n_chars", F.when(F.col("__cut"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item: none has 0.8 of an item's five-word shingles."""
    found = decontaminate.contained_items(docs, table(spark, sf_dir, "benchmark"), n=5, threshold=0.8)
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids_le, the ids as little-endian unsigned 32-bit integers."""
    return pieces.encode_pieces(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality", keep_good),
    ("near-duplicates", keep_one_of_similar),
    ("substring-dedup", drop_repeats),
    ("decontamination", drop_contaminated),
    ("piece-encoding", encode),
]

#: No SQL has the classifier's scores or the encoder's ids; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
