"""Tables and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import spread

#: The languages of the corpus.
LANGUAGES = ("ru", "en", "de", "fr", "es", "uk", "zh", "ja", "hi", "th")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_items(spark: SparkSession, sf_dir: str, kinds: Iterable[str] = ("chunk", "paragraph"), ends: bool = False) -> DataFrame:
    """``item_kind, item_id, p_i, text``: one row for each chunk, entry of ``paragraphs`` and title.

    With ``ends``, ``ends_paragraph`` too: ``is_paragraph_end`` of chunks, true of all others. Chunks and titles have ``p_i`` -1. Null texts and null paragraph arrays give rows with null text or no row.
    """
    parts = []
    for kind in kinds:
        if kind == "chunk":
            part = table(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("item_id"), F.lit(-1).alias("p_i"), "text", F.col("is_paragraph_end").alias("ends_paragraph"))
        elif kind == "paragraph":
            part = table(spark, sf_dir, "chapters").select(F.col("chapter_id").alias("item_id"), F.posexplode("paragraphs").alias("p_i", "text"))
        elif kind == "title":
            part = table(spark, sf_dir, "chapters").select(F.col("chapter_id").alias("item_id"), F.lit(-1).alias("p_i"), F.col("title").alias("text"))
        else:
            raise ValueError(f"unknown kind of item: {kind}")
        if kind != "chunk":
            part = part.withColumn("ends_paragraph", F.lit(True))
        more = ["ends_paragraph"] if ends else []
        parts.append(spread(part.select("item_id", "p_i", "text", *more)).select(F.lit(kind).alias("item_kind"), "item_id", "p_i", "text", *more))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def bounded_rows(df: DataFrame, bound: int, what: str) -> list:
    """The rows of a table that is small by its meaning; raises when it holds more than ``bound`` rows."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what}: more than {bound} rows")
    return rows


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that lost executors do not lose it.

    The folder is that of ``spark.checkpoint.dir``, which a cluster must name. Where it is unset a session on this
    machine alone, as in tests, gets a folder below its warehouse; another session raises.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
