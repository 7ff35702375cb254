"""Opcodes of slices: an interval join by bins, and what a report takes from a slice.

Points and ranges of one stream meet in bins of ``BIN`` numbers: a point lies in one bin, a range is sent to each bin that it touches, and both sides are joined by stream and
bin. So a hot stream is dealt over as many tasks as it has bins, and no pair is made that doesn't share a bin.

Defined cases: ranges whose end lies before their start meet nothing; null bounds and null points meet nothing; points and ranges that repeat meet as often; a null stream
meets none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 256
# Opcodes that a report's arguments are taken from.
UNICODE_OPS = ("BINUNICODE", "SHORT_BINUNICODE", "BINUNICODE8", "UNICODE", "STRING")
CALLABLE_OPS = ("GLOBAL", "STACK_GLOBAL")
ARITIES = {"EMPTY_TUPLE": 0, "TUPLE1": 1, "TUPLE2": 2, "TUPLE3": 3}


def in_ranges(points: DataFrame, ranges: DataFrame, key: str, at: str, lo: str, hi: str, width: int = BIN) -> DataFrame:
    """Each range with each point of its key at lo .. hi: the columns of ``ranges`` and those of ``points`` but the key."""
    bin_of = lambda c: F.floor(F.col(c) / width).cast("long")
    left = ranges.where(F.col(lo) <= F.col(hi)).withColumn("_bin", F.explode(F.sequence(bin_of(lo), bin_of(hi))))
    right = points.withColumn("_bin", bin_of(at))
    return left.join(right, [key, "_bin"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("_bin")


def slice_arguments(hits: DataFrame, ops: DataFrame) -> DataFrame:
    """blob_id, call_seq, at, value: the argument strings that a report shows of each hit, ordered by ``at``.

    hits: blob_id, call_seq, slice_start, slice_end, text. ops: blob_id, idx, opname, arg_str. Of the strings behind the last callable of the slice, as many of the last ones count as the last small
    tuple has items; without one, those between the last mark and the first tuple. The hit's own text, where it has one, comes first (at -1) and stands there only. Every string is a row, so a tuple
    of any length is no one task's work.
    """
    wanted = ops.where(F.col("opname").isin(*UNICODE_OPS, *CALLABLE_OPS, *ARITIES, "TUPLE", "MARK")).select("blob_id", "idx", "opname", "arg_str")
    hit = ["blob_id", "call_seq"]
    inside = in_ranges(wanted, hits.select(*hit, "slice_start", "slice_end"), "blob_id", "idx", "slice_start", "slice_end")
    op, idx = F.col("opname"), F.col("idx")
    arity = F.coalesce(*[F.when(op == name, F.lit(n)) for name, n in ARITIES.items()])
    facts = inside.groupBy(*hit).agg(
        F.coalesce(F.max(F.when(op.isin(*CALLABLE_OPS), idx)), F.lit(-1)).alias("callable_at"),
        F.max_by(arity, F.when(arity.isNotNull(), idx)).alias("arity"), F.min(F.when(op == "TUPLE", idx)).alias("tuple_at"),
    )
    known = inside.join(facts, hit)
    marks = known.where((op == "MARK") & F.col("arity").isNull() & (idx > F.col("callable_at")) & (idx < F.col("tuple_at"))).groupBy(*hit).agg(F.max("idx").alias("mark_at"))
    strings = known.where(op.isin(*UNICODE_OPS))
    between = strings.join(marks, hit).where(idx.between(F.col("mark_at") + 1, F.col("tuple_at") - 1)).select(*hit, idx.alias("at"), F.col("arg_str").alias("value"))
    # at most three strings of a hit, cut to them before and after the shuffle
    nth = F.row_number().over(Window.partitionBy(*hit).orderBy(idx.desc()))
    last = strings.where(F.col("arity").isNotNull() & (idx > F.col("callable_at"))).withColumn("_nth", nth).where(f"_nth <= {max(ARITIES.values())}").where("_nth <= arity")
    few = last.select(*hit, idx.alias("at"), F.col("arg_str").alias("value"))
    own = hits.where(F.coalesce(F.col("text"), F.lit("")) != "").select(*hit, F.lit(-1).alias("at"), F.col("text").alias("value"))
    rest = between.unionByName(few).join(own.select(*hit, F.col("value").alias("own")), hit, "left").where("own is null or value is null or value <> own")
    return rest.drop("own").unionByName(own)
