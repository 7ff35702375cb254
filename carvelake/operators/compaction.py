"""Smaller reports: leaves of hits cut and left out by rules, memo reads grouped where that is smaller, and counters of what went.

All steps work on rows: no hit's leaves or memo reads are gathered. Counters are observed metrics (`Observation`) of the same pass that writes the rows.

Defined cases: null values are neither cut nor nested; hits without leaves or reads have no rows; a limit of 0 or less changes nothing; equal order numbers are taken in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from carvelake.functions.scalars import sha256

HIT = ["blob_id", "call_seq"]
# Limits of a compact report.
MOST_LITERAL, NESTED_MOST, SAMPLE_KEPT, GROUP_LEAST, SAMPLE_READS = 256, 1 << 20, 32, 64, 8


def looks_nested(value: Column) -> Column:
    """Whether a text, taken as latin-1 bytes, begins as a pickle or a zlib stream does; such values stay whole."""
    latin = value.rlike(r"^[\x00-\xff]*$") & (F.length(value) <= NESTED_MOST)
    begins = value.rlike(r"(?s)^(?:\x80[\x00-\x05]|\x78[\x9c\x01\xda])") | value.rlike(r"(?s)^[c(].*\.[ \t\n\r\x0b\x0c]*$")
    return F.coalesce(latin & (begins | (value.isin("c.", "(."))), F.lit(False))


def marked_leaves(leaves: DataFrame, others: int = SAMPLE_KEPT) -> DataFrame:
    """Leaves (blob_id, call_seq, leaf, kind, type, flagged, nested, value, low) with kept: all flagged, nested and non-text ones, and of the rest of a hit the first ``others``, none for a low rank."""
    essential = F.coalesce(F.col("flagged"), F.lit(False)) | F.coalesce(F.col("nested"), F.lit(False)) | ~F.coalesce(F.col("type"), F.lit("")).isin("", "T1")
    rows = leaves.withColumn("_essential", essential)
    # the sample is found before and after the shuffle by a limit, so that a hit of any size stays spread
    place = F.row_number().over(Window.partitionBy(*HIT).orderBy("leaf"))
    sample = rows.where("not _essential and not coalesce(low, false)").select(*HIT, "leaf").withColumn("_nth", place).where(F.col("_nth") <= others).select(*HIT, "leaf", F.lit(True).alias("_sampled"))
    marked = rows.join(sample, [*HIT, "leaf"], "left")
    return marked.withColumn("kept", F.col("_essential") | F.coalesce("_sampled", F.lit(False))).drop("_essential", "_sampled")


def compact_leaves(leaves: DataFrame, most: int = MOST_LITERAL, others: int = SAMPLE_KEPT, observation: Observation | None = None) -> DataFrame:
    """The kept leaves, values beyond ``most`` characters cut, with value_len and value_sha256 of the whole value where it was.

    observation: gets meta_values_truncated, meta_entries_omitted, nested_kept and chars_dropped.
    """
    if most <= 0:
        return leaves.withColumns({"value_len": F.lit(None).cast("int"), "value_sha256": F.lit(None).cast("string")})
    rows = marked_leaves(leaves, others).withColumn("_nested", looks_nested(F.col("value")))
    cut = F.col("kept") & ~F.col("_nested") & (F.length("value") > most)
    rows = rows.withColumn("_cut", F.coalesce(cut, F.lit(False)))
    if observation is not None:
        size = F.coalesce(F.length("value"), F.lit(0))
        dropped = F.when(~F.col("kept"), size).when(F.col("_cut"), size - most).otherwise(0)
        rows = rows.observe(observation, F.count_if("_cut").alias("meta_values_truncated"), F.count_if(~F.col("kept")).alias("meta_entries_omitted"), F.count_if(F.col("kept") & F.col("_nested")).alias("nested_kept"), F.sum(dropped).alias("chars_dropped"))
    shown = F.when(F.col("_cut"), F.substring("value", 1, most)).otherwise(F.col("value"))
    kept = rows.where("kept").withColumns({"value_len": F.when(F.col("_cut"), F.length("value")), "value_sha256": F.when(F.col("_cut"), sha256(F.col("value")))})
    return kept.withColumn("value", shown).select(*leaves.columns, "value_len", "value_sha256")


def omission_summary(leaves: DataFrame, others: int = SAMPLE_KEPT) -> DataFrame:
    """blob_id, call_seq, total, kept, omitted, and how many leaves of each kind and type were left out, of hits that lose any."""
    rows = marked_leaves(leaves, others)
    totals = rows.groupBy(*HIT).agg(F.count("*").alias("total"), F.count_if("kept").alias("kept")).where("kept < total")

    def by(column: str, name: str) -> DataFrame:
        counts = rows.where("not kept").where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(*HIT, column).agg(F.count("*").alias("n"))
        return counts.groupBy(*HIT).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))

    found = totals.join(by("kind", "omitted_by_kind"), HIT, "left").join(by("type", "omitted_by_type"), HIT, "left")
    return found.select(*HIT, "total", "kept", (F.col("total") - F.col("kept")).alias("omitted"), "omitted_by_kind", "omitted_by_type")


def grouped_reads(reads: DataFrame, least: int = GROUP_LEAST, sample: int = SAMPLE_READS, observation: Observation | None = None) -> DataFrame:
    """Memo reads (blob_id, call_seq, nth, get_idx, defined_at, kind, callable) as rows with refs, get_idx_sample and grouped.

    A hit of at least ``least`` reads is grouped by origin where that gives fewer rows; each group has the number of its reads and the first few of them. Other hits keep a row a
    read. observation: gets memo_origins_grouped, the number of rows that went.
    """
    origin = ["defined_at", "kind", "callable"]
    groups = reads.groupBy(*HIT, *origin).agg(F.count("*").alias("refs"), F.min("nth").alias("nth"))
    choice = groups.groupBy(*HIT).agg(F.sum("refs").alias("_n"), F.count("*").alias("_groups")).select(*HIT, ((F.col("_n") >= least) & (F.col("_groups") < F.col("_n"))).alias("grouped"))
    rows = reads.join(choice, HIT)
    single = rows.where("not grouped").select(*HIT, "nth", *origin, F.lit(1).cast("long").alias("refs"), F.array("get_idx").alias("get_idx_sample"), "grouped")
    first = rows.where("grouped").withColumn("_r", F.row_number().over(Window.partitionBy(*HIT, *origin).orderBy("nth"))).where(F.col("_r") <= sample)
    some = first.groupBy(*HIT, *origin).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "get_idx"))), lambda x: x["get_idx"]).alias("get_idx_sample"))
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*HIT, *origin]]
    large = groups.join(choice.where("grouped"), HIT).alias("g").join(some.alias("s"), same).select(*[f"g.{c}" for c in [*HIT, "nth", *origin, "refs"]], "get_idx_sample", "grouped")
    out = single.unionByName(large)
    return out if observation is None else out.observe(observation, F.sum(F.col("refs") - 1).alias("memo_origins_grouped"))
