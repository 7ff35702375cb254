"""Fill-in-the-middle: documents are cut at two unit boundaries into prefix, middle and suffix, and written in another order.

A unit is a word with the white space before it, or white space at the end. Units are relations: the matches of a text
are exploded with their ordinals, a window sums up their lengths in order, and the cut requests of a document (two
ordinals, drawn from its id) are joined with the units by ordinal; offsets are aggregated for each document, and substrings
make the parts. Only documents that are cut go through the shuffle, once each, with all its later steps dealt by the
same key: rows that are equal in id and text are counted on the way and told apart again at the end, so no number of
copies makes a large group. Documents left plain never leave their scan.

Defined cases: a null text is an empty one; empty texts and texts that hold a marker are plain; a null doc_id draws as the
text ``seed:`` does; repeated rows repeat; an ordinal of 0 cuts before the first unit, so parts may be empty; an empty table
gives an empty table; other columns are not read. A document's units are one task's work, and its text has to fit in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SPACE = r"\x20\x09-\x0D"
UNIT = rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
MARKERS = ("<P>", "<S>", "<M>")
SEED, CUT_PERCENT, SPM_PERCENT = 42, 50, 80
#: Copies written out by one array.
COPIES = 4096


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2**32, which follow from the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def unit_ends(texts: DataFrame, key: str) -> DataFrame:
    """key, ordinal (from 1) and end (code points up to and with the unit) of each unit; ``key`` tells the rows of ``texts`` apart."""
    units = texts.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))).alias("_at", "_unit"))
    units = units.select(key, (F.col("_at") + 1).alias("ordinal"), F.char_length("_unit").alias("_length"))
    through = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return units.select(key, "ordinal", F.sum("_length").over(through).alias("end"))


def with_offsets(requests: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """The rows of ``requests`` (key, first, second and others) with prefix_chars and middle_chars: the cuts lie after the first and the second unit.

    Units are sorted by key and ordinal after their window, so that the join merges what lies there and the aggregate
    takes its rows as they come. They are never broadcast: Spark's estimate of an explode is far too low.
    """
    units = units.withColumnRenamed(key, "_key")
    met = requests.join(units.hint("merge"), (F.col(key) == F.col("_key")) & F.col("ordinal").isin(F.col("first"), F.col("second")), "left")
    end = lambda which: F.coalesce(F.max(F.when(F.col("ordinal") == F.col(which), F.col("end"))), F.lit(0))
    kept = [c for c in requests.columns if c != key]
    found = met.groupBy(key).agg(*[F.first(c).alias(c) for c in kept], end("first").alias("prefix_chars"), end("second").alias("_end"))
    return found.select(key, *kept, "prefix_chars", (F.col("_end") - F.col("prefix_chars")).alias("middle_chars"))


def arranged(form: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    p, s, m = MARKERS
    return F.when(form == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle)).otherwise(F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle))


def restored(output: Column, form: Column) -> Column:
    """The text from which `fill_in_middle` made ``output``."""
    parts = F.split(output, "|".join(MARKERS))
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output, a row for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = F.contains("text", F.lit(MARKERS[0])) | F.contains("text", F.lit(MARKERS[1])) | F.contains("text", F.lit(MARKERS[2]))
    plain = (F.col("text") == "") | marked | (h3 % 100 >= cut_percent)
    n = F.regexp_count("text", F.lit(UNIT)).cast("long").alias("n")
    left = rows.where(plain).select("doc_id", n, F.lit("plain").alias("form"), F.lit(None).cast("long").alias("prefix_chars"), F.lit(None).cast("long").alias("middle_chars"), F.col("text").alias("output"))

    row = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text"))
    cut = rows.where(~plain).withColumn("print", F.unhex(F.substring(F.sha2(row, 256), 1, 32)))
    cut = cut.groupBy("print").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    drawn = [h % (F.col("n") + 1) for h in (h1, h2)]
    requests = cut.select("*", n).select("*", F.least(*drawn).alias("first"), F.greatest(*drawn).alias("second"), F.when(h4 % 100 < spm_percent, "spm").otherwise("psm").alias("form"))
    cut = with_offsets(requests, unit_ends(cut, "print"), "print")
    prefix, end = F.col("prefix_chars").cast("int"), (F.col("prefix_chars") + F.col("middle_chars")).cast("int")
    parts = [F.substring(F.col("text"), F.lit(1), prefix), F.substring(F.col("text"), prefix + 1, F.col("middle_chars").cast("int")), F.substring(F.col("text"), end + 1, F.char_length("text"))]
    made = cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", arranged(F.col("form"), *parts).alias("output"), "copies")
    return left.unionByName(repeated(made, "copies"))


def repeated(rows: DataFrame, copies: str) -> DataFrame:
    """Each row as often as its number of copies says, by arrays of bounded length."""
    kept = [c for c in rows.columns if c != copies]
    runs = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({copies} - 1) div {COPIES}"))).alias("_run"))
    length = F.least(F.lit(COPIES).cast("long"), F.col(copies) - F.col("_run") * COPIES)
    return runs.select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), length)).alias("_copy")).drop("_copy")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


_H = ", ".join(f"('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, {_H} FROM documents),
e AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
f AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM f
"""
