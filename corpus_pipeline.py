"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on
all rows its predecessor kept and returns a DataFrame, which ``run`` (and the
check tool) writes as Parquet and reads again for the next. All but the last
return the columns of ``documents``.

1. language: the languages of the corpus; texts of none of them go, and ``lang``
   becomes the identified language.
2. near_duplicates: one document of each class of texts with 5-gram Jaccard >= 0.8.
3. repeats: passages of 50 words or more that also stand in a document of a smaller
   id are cut out; a document of which nothing is left goes; ``n_chars`` follows.
4. mix: documents in the order of a Pfair interleaving of the sources by target
   weight. No document goes: the order of the written rows is the result.
5. packing: token ids in sequences of at most 2048, group by group of that order.

A null or empty text is language-less and goes in stage 1 unless other evidence
names its language. Repeated rows are copies, of which stage 2 keeps one; extra
columns of the documents pass through stages 1 to 4. An empty table gives an
empty result with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallscope.llm.jaccard_join import jaccard_join, keep_one
from recallscope.llm.language_id import language_id
from recallscope.llm.pfair_mix import pfair_mix, tempered_targets
from recallscope.llm.substring_dedup import substring_dedup
from recallscope.llm.vector_packing import vector_pack
from recallscope.session import fresh_path


PACK_ROWS = 2048  # documents, in mixed order, packed together


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows that agree in every column have the same evidence, so their hash names the decision
    keyed = docs.withColumn("__key", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    found = language_id(keyed.select("__key", "text", "lang", "source"), declared=F.col("lang"), host=F.col("source"))
    kept = found.where("kept").groupBy("__key").agg(F.max("predicted").alias("__predicted"))
    return keyed.join(kept, "__key").withColumn("lang", F.col("__predicted")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, jaccard_join(docs)).select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_dedup(docs, texts=True).where("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    return cut.withColumns({
        "text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars").cast("long")),
    }).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = pfair_mix(docs, tempered_targets(docs))
    return mixed.orderBy("slot", "block_offset", "doc_id").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # stage 4's order is that of the written files and of the rows in each
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
    place = part.cast("long") * 65536 + F.floor(F.col("_metadata.row_index") / PACK_ROWS)
    pieces = vector_pack(docs, public_tokenizers.path("word_bpe_49k.json"), group=place)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("mix", mix),
    ("packing", packing),
]

#: MinHash, the schedule and token ids are beyond SQL; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; what stands between them is written
    to the shared folder, so each starts from files that survive lost executors."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        path = fresh_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
