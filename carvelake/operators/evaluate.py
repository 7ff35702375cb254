"""Evaluation operators over ledgers and measurement records: predicates, joins, aggregates and windows."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of container and compression hops, severity scale, tiers.
CONTAINER_HOPS, STREAM_HOPS = ("zip", "tar", "npz"), ("gz", "gzip", "zlib", "bz2", "xz", "lzma", "lz4", "npy", "zstd")
SEVERITIES = ("LIKELY_SAFE", "POSSIBLY_UNSAFE", "SUSPICIOUS", "LIKELY_UNSAFE", "LIKELY_OVERTLY_MALICIOUS", "OVERTLY_MALICIOUS")
BENIGN_TIERS, MALICIOUS_TIERS, EXCLUDED_TIERS = ("2-A", "2-B"), ("3-D",), ("3-E", "1-C")


def used_in(column: Column, question: int) -> Column:
    return F.array_contains(F.split(F.coalesce(column, F.lit("")), ";"), str(question))


def tier_of(sample_id: Column) -> Column:
    """Second and third part of a dashed id; empty with fewer than three parts."""
    parts = F.split(sample_id, "-")
    return F.when(F.size(parts) >= 3, F.concat_ws("-", parts[1], parts[2])).otherwise(F.lit(""))


def in_corpus(status: Column, tier: Column, scope: Column) -> Column:
    return (F.coalesce(status, F.lit("ok")) == "ok") & ~tier.isin(*EXCLUDED_TIERS) & (F.when(scope.isNull() | (scope == ""), "in").otherwise(scope) == "in")


def side_of(tier: Column) -> Column:
    return F.when(tier.isin(*BENIGN_TIERS), "benign").when(tier.isin(*MALICIOUS_TIERS), "malicious").otherwise("other")


def role_of(tier: Column, label: Column) -> Column:
    return F.when(tier == "1-C", "probe").when(tier.isin(*BENIGN_TIERS) & label.isin("F", "na"), "benign").when(tier == "3-D", "malicious").otherwise(label)


def effective_label(label: Column, tier: Column) -> Column:
    return F.when(label.isin("T", "F"), label).when(tier == "1-C", F.lit("F")).otherwise(label)


def hops(chain: Column) -> Column:
    """Kinds of the hops of a chain ``a>b>c``; unknown ones are dropped."""
    kind = lambda h: F.when(h.isin(*CONTAINER_HOPS), "Container").when(h.isin(*STREAM_HOPS), "Streaming")
    return F.filter(F.transform(F.split(F.coalesce(chain, F.lit("")), ">"), kind), lambda x: x.isNotNull())


def depth(chain: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(chain, F.lit("")), ">"), lambda x: x != ""))


def label_of(kinds: Column, via: Column, opaque: Column) -> Column:
    """A file's label from how many hop sequences its streams have, one of them, and whether a stream ends opaque (null: none does)."""
    plain = F.when(opaque, "Opaque").otherwise("Serialization")
    return F.when(kinds > 1, "Mixed").when(via == "", plain).otherwise(F.concat(via, F.when(opaque, "→opaque").otherwise("")))


def chain_label(streams: DataFrame, file: str, chain: str, terminal: str) -> DataFrame:
    """One label for each file from its streams' hop sequences and terminal classes."""
    rows = streams.select(file, F.array_join(hops(F.col(chain)), "→").alias("_via"), F.col(terminal).alias("_end"))
    per = rows.groupBy(file).agg(F.countDistinct("_via").alias("_kinds"), F.min("_via").alias("_via"), F.max(F.col("_end") == "Opaque").alias("_opaque"))
    return per.select(file, label_of(F.col("_kinds"), F.col("_via"), F.col("_opaque")).alias("chain_label"))


def severity_at_least(severity: Column, status: Column, least: str) -> Column:
    at = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)
    return F.when(status == "ok", (at >= SEVERITIES.index(least) + 1).cast("int"))


def unreached(status: Column, references: Column, seen: Column) -> Column:
    """A tool that ran on a file with references but saw none: no judgement."""
    return F.coalesce((status == "ok") & (references > 0) & (seen == 0), F.lit(False))


def refusal(status: Column, refused: Column) -> Column:
    return F.when(~F.coalesce(status, F.lit("error")).isin("error", "child_failed"), F.coalesce(refused, F.lit(False)).cast("int"))


def terminal_class(source_kind: Column) -> Column:
    return F.when(source_kind.startswith("pgs"), "Opaque").otherwise("Serialization")


def overlay(old: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``old`` with ``columns`` replaced where a fresh row of the key has a status that starts with ok."""
    new = fresh.select(key, F.col("status").alias("_status"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    ok = F.coalesce(F.col("_status").startswith("ok"), F.lit(False))
    return old.join(new, key, "left").select(*[F.when(ok, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def with_priority(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """One row for each key; rows of ``second`` override those of ``first``."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    row = F.max_by(F.struct(*[F.col(c) for c in first.columns]), F.struct("_p")).alias("_row")
    return both.groupBy(key).agg(row).select("_row.*")


def longest_prefix(names: DataFrame, name: str, entries: DataFrame, entry: str, sep: str = ".") -> DataFrame:
    """Each name with the entry that equals it, else the longest that is a prefix of it at a separator. Names explode into
    their prefixes, so it is an equi-join."""
    parts = F.split(F.col(name), f"\\{sep}")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), sep))
    rows = names.select(name, F.explode(prefixes).alias(entry)).join(entries.select(entry).distinct(), entry)
    best = rows.groupBy(name).agg(F.max_by(entry, F.length(entry)).alias(entry))
    return names.join(best, name, "left")


def confusion(records: DataFrame, truth: str, tools: list[str], by: list[str] | None = None) -> DataFrame:
    """Per tool: tri-state verdicts against the truth. A malicious file without a verdict counts as missed, a benign one as excluded."""
    long = records.select(*(by or []), F.col(truth).alias("_truth"), F.explode(F.map_from_arrays(F.array(*[F.lit(t) for t in tools]), F.array(*[F.col(t).cast("int") for t in tools]))).alias("tool", "v"))
    bad, v = F.col("_truth") == 1, F.col("v")
    return long.groupBy(*(by or []), "tool").agg(
        F.count_if(bad & (v == 1)).alias("tp"), F.count_if(bad & (v.isNull() | (v == 0))).alias("fn"), F.count_if(~bad & (v == 1)).alias("fp"), F.count_if(~bad & (v == 0)).alias("tn"),
        F.count_if(bad & v.isNull()).alias("inc_m"), F.count_if(~bad & v.isNull()).alias("inc_b"),
    )


def ratio(a: Column, b: Column, places: int = 3) -> Column:
    return F.round(a / F.nullif(b, F.lit(0)), places)


def metrics(table: DataFrame, places: int = 4) -> DataFrame:
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    share = lambda a, b, name: ratio(a, b, places).alias(name)
    return table.select(
        "*", share(tp, tp + fn, "recall"), share(fn, tp + fn, "fnr"), share(fp, fp + tn, "fpr"), share(tp, tp + fp, "precision"), share(2 * tp, 2 * tp + fp + fn, "f1"), share(tp + tn, tp + tn + fp + fn, "accuracy"),
        (tp + fp).alias("judged_t"), (tn + fn - F.col("inc_m")).alias("judged_f"), (F.col("inc_m") + F.col("inc_b")).alias("inconclusive"),
    )


def rarest_item(rows: DataFrame, owner: str, item: str) -> DataFrame:
    """Each owner with its least frequent item, ties to the smaller name."""
    pairs = rows.select(owner, item).distinct()
    freq = pairs.groupBy(item).agg(F.count("*").alias("freq"))
    return pairs.join(freq, item).groupBy(owner).agg(F.min_by(F.struct(item, "freq"), F.struct("freq", item)).alias("x")).select(owner, f"x.{item}", "x.freq")


def head_tail(rows: DataFrame, by: str, order: list[str], most: int, each: int) -> DataFrame:
    """Groups of more than ``most`` rows keep their first and last ``each``."""
    w = Window.partitionBy(by)
    ranked = rows.withColumn("_n", F.count("*").over(w)).withColumn("_up", F.row_number().over(w.orderBy(*order)))
    return ranked.where((F.col("_n") <= most) | (F.col("_up") <= each) | (F.col("_up") > F.col("_n") - each)).drop("_n", "_up")


def essential_first(rows: DataFrame, by: str, order: list[str], essential: Column, others: int) -> DataFrame:
    """Essential rows, and the first ``others`` of the rest."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = rows.withColumn("_e", essential).withColumn("_k", F.sum((~F.col("_e")).cast("int")).over(w))
    return kept.where(F.col("_e") | (F.col("_k") <= others)).drop("_e", "_k")


def grouped_origins(rows: DataFrame, by: str, keys: list[str], value: str, order: list[str], sample: int = 8) -> DataFrame:
    """References grouped by their origin: how many, and the first few in order."""
    w = Window.partitionBy(by, *keys).orderBy(*order)
    ranked = rows.withColumn("_r", F.row_number().over(w))
    listed = F.array_sort(F.collect_list(F.when(F.col("_r") <= sample, F.struct("_r", value))))
    return ranked.groupBy(by, *keys).agg(F.count("*").alias("refs"), F.transform(listed, lambda x: x[value]).alias("sample"))


def _claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (group, seq, start, end): those whose range is free when they come."""
    key, starts, ends = None, [], []
    for batch in batches:
        keep = []
        for group, start, end in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
            if group != key:
                key, starts, ends = group, [], []
            at = bisect.bisect_right(starts, end)  # kept ranges don't meet, so only the last that begins by the end can
            free = not at or ends[at - 1] < start
            if free:
                starts.insert(at, start)
                ends.insert(at, end)
            keep.append(free)
        yield batch.filter(pa.array(keep, pa.bool_()))


def non_overlapping(rows: DataFrame, by: str, start: str, end: str, seq: str) -> DataFrame:
    """In order of ``seq``, rows whose closed range meets no range kept before: a scan over each group's sorted rows.

    Equal ``seq`` go by start and end; no range ends before it begins.
    """
    ranges = rows.select(by, *[F.col(c).cast("long").alias(c) for c in (seq, start, end)])
    return ranges.repartition(by).sortWithinPartitions(by, seq, start, end).mapInArrow(_claims, ranges.schema)


def reachability(files: DataFrame, klass: str, need: str, found: str, measured: str) -> DataFrame:
    """Files, streams and reach of each class and in total, each with its own denominators."""
    cover = F.least(F.lit(1.0), F.col(found) / F.nullif(F.col(need), F.lit(0)))
    with_streams = files.where(F.col(need) > 0).withColumn("_cover", cover)
    return with_streams.rollup(klass).agg(
        F.count("*").alias("files"), F.sum(need).alias("streams"), F.count_if(F.col(measured)).alias("measured"),
        ratio(F.count_if(F.col(measured) & (F.col(found) >= F.col(need))), F.count_if(F.col(measured)), 4).alias("file_ratio"),
        ratio(F.sum(F.when(F.col(measured), F.col("_cover") * F.col(need))), F.sum(F.when(F.col(measured), F.col(need))), 4).alias("stream_ratio"),
    )
