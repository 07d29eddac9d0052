"""The pN_ queries: every operator of this subpackage over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import language, leakage, normalform, packing, repetition, sentences, splitting, truncation
from lectern.llm.common import bounded_rows, table, text_items
from lectern.session import spread


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "checks").select("check_id", "transcript", "reasons"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that repeat themselves."""
    return repetition.repetition(_checks(spark, sf_dir)).filter("not retained").select("check_id").distinct()


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of repeated content of every check."""
    found = repetition.repetition(_checks(spark, sf_dir))
    return found.select("check_id", F.round("transcript_share", 6).alias("transcript_share"), F.round("reasons_share", 6).alias("reasons_share"), "retained").distinct()


def _limits(spark: SparkSession, sf_dir: str) -> dict[str, tuple[int, int]]:
    rows = bounded_rows(table(spark, sf_dir, "split_limits").filter("max_chars is not null"), 1000, "split_limits")
    return {r["item_kind"]: (r["max_chars"], r["overlap_chars"] or 0) for r in rows}


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every item of a kind that has a limit."""
    return splitting.split_items(text_items(spark, sf_dir, ends=True), _limits(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that had to be cut: those with a second piece."""
    return p2_pieces(spark, sf_dir).filter("piece_i = 1").select("item_kind", "item_id", "p_i")


def p2_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the pieces of all items: they cover every character, in order, within both limits."""
    limits = _limits(spark, sf_dir)
    most, shared = F.lit(0), F.lit(0)
    for kind, (chars, overlap) in limits.items():
        most, shared = F.when(F.col("item_kind") == kind, chars).otherwise(most), F.when(F.col("item_kind") == kind, overlap).otherwise(shared)
    pieces = p2_pieces(spark, sf_dir)
    spans = F.array_sort(F.collect_list(F.struct("piece_i", "start", "end")))
    by_item = pieces.groupBy("item_kind", "item_id", "p_i").agg(spans.alias("s"), F.max(F.length("piece")).alias("longest"))
    steps = F.zip_with(F.slice("s", 2, 1 << 20), F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))), lambda b, a: (b["start"] > a["start"]) & (b["end"] > a["end"]) & (b["start"] <= a["end"]) & (a["end"] - b["start"] <= shared))
    ends = F.element_at("s", -1)["end"]
    rows = by_item.select("item_kind", ends.alias("covered"), (F.size("s") > 1).alias("divided"), (F.col("longest") <= most).alias("within"), (F.forall(steps, lambda x: x) & (F.element_at("s", 1)["start"] == 0)).alias("ordered"))
    return rows.groupBy("item_kind").agg(F.count(F.lit(1)).alias("items"), F.sum("covered").cast("long").alias("covered"), F.count_if("divided").alias("divided"), F.bool_and("within").alias("within"), F.bool_and("ordered").alias("in_order"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items with different characters that look the same."""
    return normalform.same_looking_pairs(text_items(spark, sf_dir, ("chunk", "paragraph", "title")))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of look of every item, and its spelling."""
    return normalform.look_classes(text_items(spark, sf_dir, ("chunk", "paragraph", "title")))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical text of every item whose stored text differs from it."""
    found = normalform.canonical_text(text_items(spark, sf_dir, ("chunk", "paragraph", "title")))
    return found.filter("canonical <> text").select("item_kind", "item_id", "p_i", "canonical")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every sentence but the first begins."""
    return sentences.sentence_boundaries(text_items(spark, sf_dir))


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every item."""
    return sentences.sentence_units(text_items(spark, sf_dir))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit(language.labelled_sample(table(spark, sf_dir, "documents")))
    judged = language.segment_languages(spread(table(spark, sf_dir, "chunks").select("chunk_id", "book_id", "lang", "text")), model)
    return language.with_book_label(judged, table(spark, sf_dir, "books"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of chunks other than that of their label."""
    return language.mislabelled(_judged(spark, sf_dir))


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every segment of every chunk."""
    return _judged(spark, sf_dir).select("chunk_id", "seg_i", "seg_start", "seg_end", "lang", F.round("confidence", 4).alias("confidence"), "label")


def p5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every chunk."""
    found = language.chunk_languages(table(spark, sf_dir, "chunks"), _judged(spark, sf_dir))
    return found.withColumn("confidence", F.round("confidence", 4))


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, int]]:
    rows = bounded_rows(table(spark, sf_dir, "pack_sizes").filter("capacity is not null"), 1000, "pack_sizes")
    capacities = {r["pack_name"]: r["capacity"] for r in rows}
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents")), capacities), capacities


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were divided: those with a second piece."""
    return _packed(spark, sf_dir)[0].filter("n_pieces > 1").select("pack_name", "doc_id").distinct()


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document goes."""
    return _packed(spark, sf_dir)[0]


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(*_packed(spark, sf_dir))


def p6_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers: every token is in one, none is overfull, and they are numbered from 0."""
    packed, capacities = _packed(spark, sf_dir)
    capacity = F.lit(None).cast("long")
    for name, n in capacities.items():
        capacity = F.when(F.col("pack_name") == name, n).otherwise(capacity)
    loads = packed.filter("container_id is not null").groupBy("pack_name", "container_id").agg(F.sum("tokens").alias("load"))
    full = loads.groupBy("pack_name").agg(F.count_if(F.col("load") > capacity).cast("int").alias("overfull"), (F.count(F.lit(1)) == F.max("container_id") + 1).alias("numbered"))
    totals = packed.groupBy("pack_name").agg(F.count_if(F.col("piece_i") == F.col("n_pieces") - 1).alias("documents"), F.sum("tokens").cast("long").alias("tokens"), F.count_if((F.col("piece_i") == 1)).alias("divided"))
    return totals.join(full, "pack_name")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items that stand in them."""
    return p7_cover(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of an item stands in each document that holds it."""
    return leakage.leaked_items(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_items"))


def _truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were cut."""
    return _truncated(spark, sf_dir).filter("cut").select("doc_id").distinct()


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.truncation_by_source(_truncated(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_shares, p2_found, p2_pieces, p2_check, p3_found, p3_classes, p3_forms, p4_found, p4_sentences, p5_found, p5_segments, p5_chunks, p6_found, p6_containers, p6_check, p6_fill, p7_found, p7_cover, p8_found, p8_sources)
}
