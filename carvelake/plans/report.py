"""Reports: blob summaries, compacted hits, opcode context, console-style tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carvelake.functions.scalars import truncated
from carvelake.operators.slices import in_ranges

OPS_SHOWN, PADDING, LITERALS_KEPT = 2000, 5, 32


def blob_summary(hits: DataFrame) -> DataFrame:
    """Input hits, classified, unclassified high and low of each stream."""
    v = F.col("verdict")
    return hits.groupBy("blob_id").agg(F.count("*").alias("input_hits"), F.count_if(v == "Unsafe").alias("classified"), F.count_if(v == "Review").alias("unclassified_high"), F.count_if(v == "Low").alias("unclassified_low"), F.lit(0).alias("removed"))


def type_histogram(hits: DataFrame) -> DataFrame:
    """How many literals of each type a hit has."""
    rows = hits.select("blob_id", "call_seq", F.explode("args.type").alias("type")).groupBy("blob_id", "call_seq", "type").count()
    return rows.groupBy("blob_id", "call_seq").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "count")))).alias("types"))


def compacted(hits: DataFrame, most: int = 256, others: int = LITERALS_KEPT) -> DataFrame:
    """Hits whose literals are cut to ``most`` characters; flagged, nested and non-text ones stay, and the first few others."""
    a = F.col("args")
    essential = lambda x: x["flagged"] | (F.size(x["nested"]) > 0) | (x["type"] != "T1")
    limit = F.when(F.col("verdict") == "Low", F.lit(0)).otherwise(F.lit(others))
    kept = F.filter(a, lambda x, k: essential(x) | (F.size(F.filter(F.slice(a, F.lit(1), k + 1), lambda y: ~essential(y))) <= limit))
    shown = F.transform(kept, lambda x: x.withField("text", truncated(x["text"], most)))
    return hits.withColumn("args", shown).withColumn("omitted", F.size(a) - F.size(kept))


def opcode_context(hits: DataFrame, ops: DataFrame, padding: int = PADDING, most: int = OPS_SHOWN) -> DataFrame:
    """Opcodes of each hit's slice, with ``padding`` before it, at most ``most``, and whether it was cut."""
    h = hits.select("blob_id", "call_seq", F.greatest(F.col("slice_start") - padding, F.lit(0)).alias("lo"), F.col("slice_end").alias("hi"))
    h = h.withColumn("shown_hi", F.least(F.col("hi"), F.col("lo") + most - 1))
    joined = in_ranges(ops.select("blob_id", "idx", "pos", "opname", "arg_str"), h, "blob_id", "idx", "lo", "shown_hi")
    op = F.struct("idx", "pos", "opname", "arg_str")
    return joined.groupBy("blob_id", "call_seq", "lo", "hi").agg(F.array_sort(F.collect_list(op)).alias("ops")).withColumn("truncated", F.col("hi") - F.col("lo") + 1 > most)


def text_report(hits: DataFrame, context: DataFrame) -> DataFrame:
    """A block of text for each hit, with its opcodes."""
    lines = F.transform("ops", lambda o: F.format_string("%6d %8d %-18s %s", o["idx"], o["pos"], o["opname"], F.coalesce(o["arg_str"], F.lit(""))))
    return hits.join(context, ["blob_id", "call_seq"]).select("blob_id", "call_seq", F.concat_ws("\n", F.concat(F.lit("[HIT] "), "canonical", F.lit(" "), "verdict"), F.array_join(lines, "\n")).alias("report"))
