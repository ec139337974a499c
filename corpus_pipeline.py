"""A corpus pipeline of five of the operators, each on all its predecessor kept.

A stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``. ``n_chars`` follows the text. Stages are named after what they do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewise.llm._common import materialize
from tapewise.llm.decontaminate import contamination
from tapewise.llm.line_dedup import dedup_lines
from tapewise.llm.ngram_join import jaccard_groups
from tapewise.llm.packing import pack
from tapewise.llm.toxicity import score, toxicity_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents scored toxic go. Fitted on the labelled ones.

    Equal texts have equal scores, so repeated rows stay or go together; null
    and empty texts have the score of no words. Without toxic labels all stay;
    an empty table stays empty."""
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select(*COLUMNS), model).where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: repeated long lines go from all but one document; every
    document stays, its text without them.

    A null text stays null. Rows of one id are one document and lose the same
    lines. An empty table stays empty."""
    out = dedup_lines(docs.select(*COLUMNS)).withColumn("text", F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8, five words and 0.8: the least id of each group stays.

    Documents without words are no copies of each other and all stay. A row goes
    by its id and text hashes, so null and repeated ids of different groups are
    told apart; null ids come last. Of a group's rows of one id, that of the
    least text hash stays."""
    text = F.coalesce("text", F.lit(""))
    key = {"_null": F.col("doc_id").isNull(), "_id": F.col("doc_id"), "_h": F.xxhash64(text), "_g": F.xxhash64(F.lit(1), text)}
    groups = jaccard_groups(docs.select(F.struct(*(v.alias(k) for k, v in key.items())).alias("row"), "text"), "row")
    stays = materialize(groups.where((F.col("n_shingles") == 0) | F.col("row").eqNullSafe(F.col("component_id"))).select("row.*").distinct(), "stays")
    rows = docs.select(*COLUMNS).withColumns({"_hash": key["_h"], "_hash2": key["_g"]})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")) & (F.col("_hash2") == F.col("_g"))
    kept = rows.join(stays, same, "left_semi")
    one = Window.partitionBy("doc_id", "_hash", "_hash2", "_copy").orderBy(*COLUMNS[1:])
    copies = F.when(F.btrim(text, F.lit(" \t\n\x0b\f\r")) == "", F.monotonically_increasing_id()).otherwise(F.lit(-1))
    return kept.withColumn("_copy", copies).withColumn("_nth", F.row_number().over(one)).where("_nth = 1").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: contaminated documents go.

    Null and empty texts have no words and stay. Repeated rows stay or go
    together. Without items all stay; an empty table stays empty."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs.select(*COLUMNS), items).where(~F.col("contaminated")).select(*COLUMNS)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token sequences of at most 1024 ids; a row for each piece.

    A null or empty text is its end id alone. Repeated rows are packed once
    each, null ids are kept. An empty table gives no rows."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_tokens),
]

#: Compression, sketches and tokens are beyond SQL; tests/llm has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
