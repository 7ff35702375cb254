"""Sharding along a Hilbert curve, with DataFrame functions only.

Rows are quantised in several metadata dimensions, placed on the Hilbert curve through that grid and cut into runs of
equal row counts (law ``rows``), so that a shard covers a compact region in all dimensions and readers can skip files
by the least and greatest values of any of them (`shard_ranges`). A dimension's cells are cut at percentiles of its values over all rows; texts are
taken by their leading bytes, so cells follow their order. The exact global position of each row comes without a global sort: rows are counted by curve cell
and hash bucket (a partial aggregate), the counts are summed up in curve order, and a window numbers the rows inside
each bucket. A cell has as many buckets as keep each near ``BUCKET`` rows, and rows are dealt to them by their own number, so no cell, however hot, and no set of equal rows is one task's work;
its buckets are summed in runs of ``RUN``; the only single-task step is a running sum over the cells, of which
there are 2**(bits * dimensions) at most, and tables of that length are the only ones broadcast.

Defined cases: null texts, languages and sources are values of their own (the size of a null text is 8, its CRC that of
nothing); equal rows get neighbouring positions or buckets in any order among themselves; a null doc_id is placed like any other; an
empty table gives an empty table; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table, text_bytes

SHARDS, BITS = 24, 4
#: Rows numbered by one window, and buckets summed by one.
BUCKET, RUN = 256, 4096


def hilbert_index(dims: list[Column], bits: int) -> tuple[list[tuple[str, Column]], Column]:
    """Curve position of a grid cell (Skilling's transform), as steps of column assignments and a final expression.

    dims: one integer column for each dimension, below 2**bits.
    """
    n = len(dims)
    names = [f"_h{k}" for k in range(n)]
    steps: list[tuple[str, Column]] = [(c, d.cast("int")) for c, d in zip(names, dims)]
    col = F.col
    for level in range(bits - 1, 0, -1):  # inverse undo
        p = (1 << level) - 1
        for k in range(n):
            bit = col(names[k]).bitwiseAND(F.lit(1 << level)) != 0
            swap = col(names[0]).bitwiseXOR(col(names[k])).bitwiseAND(F.lit(p))
            if k == 0:
                steps.append((names[0], F.when(bit, col(names[0]).bitwiseXOR(F.lit(p))).otherwise(col(names[0]))))
            else:
                steps.append(("_t", F.when(bit, F.lit(p)).otherwise(swap)))
                steps.append((names[k], F.when(bit, col(names[k])).otherwise(col(names[k]).bitwiseXOR(col("_t")))))
                steps.append((names[0], col(names[0]).bitwiseXOR(col("_t"))))
    for k in range(1, n):  # Gray encode
        steps.append((names[k], col(names[k]).bitwiseXOR(col(names[k - 1]))))
    twist = F.lit(0)
    for level in range(bits - 1, 0, -1):
        twist = twist.bitwiseXOR(F.when(col(names[n - 1]).bitwiseAND(F.lit(1 << level)) != 0, F.lit((1 << level) - 1)).otherwise(F.lit(0)))
    steps.append(("_t", twist))
    for c in names:
        steps.append((c, col(c).bitwiseXOR(col("_t"))))
    index = reduce(lambda a, b: F.shiftleft(a, 1).bitwiseOR(b), [F.shiftright(col(names[k]), level).bitwiseAND(F.lit(1)) for level in range(bits - 1, -1, -1) for k in range(n)], F.lit(0))
    return steps, index


def with_curve(rows: DataFrame, dims: list[Column], bits: int = BITS, name: str = "cell") -> DataFrame:
    steps, index = hilbert_index(dims, bits)
    for c, value in steps:
        rows = rows.withColumn(c, value)
    return rows.withColumn(name, index).drop(*{c for c, _ in steps})


def leading(text: Column) -> Column:
    """A text's first 7 bytes as a number, which orders as the text does; -1 for null."""
    data = F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 7)), 14, "0")
    return F.coalesce(F.conv(data, 16, 10).cast("long"), F.lit(-1))


def cells_of(rows: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """For each of the numeric columns, which of 2**bits cells a value lies in: the splitters at or below it, which are percentiles over all ``rows``."""
    parts = 1 << bits
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    found = rows.agg(*[F.percentile_approx(d, shares, 10_000).alias(f"s{k}") for k, d in enumerate(dims)]).first()
    return [reduce(lambda a, b: a + b, [(F.col(d) > s).cast("int") for s in found[k] or []], F.lit(0)) for k, d in enumerate(dims)]


def curve_table(spark: SparkSession, dims: int, bits: int) -> DataFrame:
    """_grid (the cells of all dimensions, ``bits`` each) and cell, the place on the curve: 2**(bits * dims) rows."""
    grid = spark.range(1 << bits * dims).withColumnRenamed("id", "_grid")
    own = [F.shiftright("_grid", bits * (dims - 1 - k)).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") for k in range(dims)]
    return saved(with_curve(grid, own, bits).coalesce(1), "hilbert-curve")


def shard_rows(rows: DataFrame, dims: list[str], order: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``rows`` with shard and slot: runs along the curve whose row counts differ by one at most.

    dims: numeric columns. order: columns that order the rows of one bucket.
    """
    # a few slim columns: files of a good size rather than one for each split of the texts
    slim = saved(rows.withColumn("_row", F.monotonically_increasing_id()).hint("rebalance"), "hilbert-rows")
    total = slim.count()
    grid = reduce(lambda a, b: F.shiftleft(a, bits).bitwiseOR(b), cells_of(slim, dims, bits))
    placed = slim.withColumn("_grid", grid.cast("long")).join(F.broadcast(curve_table(slim.sparkSession, len(dims), bits)), "_grid").drop("_grid")
    through = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up_to = lambda w: F.sum("n").over(w) - F.col("n")
    # at most 2**(bits * dimensions) rows, so the single task of the first sum and the broadcast are bounded
    cells = saved(placed.groupBy("cell").agg(F.count("*").alias("n")), "hilbert-cells")
    cells = cells.select("cell", up_to(through().orderBy("cell")).alias("base"), F.ceil(F.col("n") / BUCKET).alias("buckets"))
    placed = placed.join(F.broadcast(cells), "cell").withColumn("bucket", F.pmod(F.xxhash64("_row"), F.col("buckets"))).drop("buckets")
    counts = placed.groupBy("cell", "base", "bucket").agg(F.count("*").alias("n")).withColumn("run", F.expr(f"bucket div {RUN}"))
    counts = saved(counts, "hilbert-buckets")
    runs = counts.groupBy("cell", "run").agg(F.sum("n").alias("n")).withColumn("skip", up_to(through("cell").orderBy("run"))).drop("n")
    inner = up_to(through("cell", "run").orderBy("bucket"))
    counts = counts.withColumn("own", inner).join(runs, ["cell", "run"]).select("cell", "bucket", (F.col("base") + F.col("skip") + F.col("own")).alias("first"))
    counts = saved(counts, "hilbert-counts")
    w = Window.partitionBy("cell", "bucket").orderBy(*order, "_row")
    ranked = placed.withColumn("nth", F.row_number().over(w)).join(counts, ["cell", "bucket"])
    # shard s holds the positions from ceil(s * total / shards) up to the next such number
    shard = F.expr(f"((first + nth - 1) * {shards}) div {max(total, 1)}")
    ranked = ranked.withColumn("shard", shard.cast("int"))
    start = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return ranked.withColumn("slot", F.col("first") + F.col("nth") - 1 - start).drop("cell", "bucket", "base", "first", "nth", "_row")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, lang, source, shard, slot; the curve runs through size, language and source."""
    data = text_bytes()
    rows = docs.select(
        F.col("doc_id").cast("long"), "lang", "source", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        leading(F.col("lang")).alias("_lang"), leading(F.col("source")).alias("_source"),
    )
    return shard_rows(rows, ["size", "_lang", "_source"], ["doc_id", "text_crc32", "size"], shards).drop("_lang", "_source")


def shard_ranges(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each shard: its number of rows, and the least and greatest value of each of the columns, by which readers skip it."""
    ends = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("least", F.min), ("greatest", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), *ends)


def write_shards(sharded: DataFrame, path: str, shards: int = SHARDS) -> None:
    """A folder for each shard with one file, rows by slot, so that Parquet's own statistics tell what to skip."""
    sharded.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot").write.partitionBy("shard").parquet(path)


def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
