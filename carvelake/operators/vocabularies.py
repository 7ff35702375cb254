"""Vocabularies as versioned tables, and joins as of a row's own version.

A row says what a name means in one vocabulary from version ``valid_from`` up to, not including, ``valid_to`` (null: until further notice). Changes close rows and open others
(`amended`), so a scan of any earlier version can be judged again as it was. Rows of one vocabulary and name never overlap.

Defined cases: a null name or version meets nothing; a change that says what already holds changes nothing; a change at a version before the last one of its name is an error; an empty
table of changes leaves the table as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carvelake.functions import fixed_values as V
from carvelake.scratch import saved

from .vocabulary import MODULE_ALIASES, alias_names

#: Sides of a join up to this many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000
VALUES = ["qualification", "rank", "require", "min_rules", "category", "subcategory"]
SCHEMA = "vocabulary string, name string, qualification string, rank int, require array<string>, min_rules int, category string, subcategory string, valid_from long, valid_to long"
# Tiers of tags that list the rules that fired: tag, rules required, least number of rules, qualification, category, subcategory.
RULE_TIERS = [
    ("has_python_code", ["PY_CALL_SYNTAX_RE", "PY_CODE_STRING_RE", "PY_INNER_STRING_RE"], 4, "standalone", "Code Execution", "Embedded Python Source"),
    ("has_python_code", ["PY_CALL_SYNTAX_RE", "PY_CODE_STRING_RE", "PY_INNER_STRING_RE"], 3, "combination_required", "Code Execution", "Embedded Python Source"),
]
#: Vocabularies: callable, denylist, literal, literal_prefix (names that tags begin with), literal_tier (name and rank are the key), name, and alias (category holds the public module).


def own_vocabularies(spark: SparkSession, version: int = 0) -> DataFrame:
    """The library's own vocabularies, valid from a version on; some thousand rows at most."""
    rows = [("callable", n, q, 0, None, None, c, s) for q, table in (("standalone", V.CALLABLE_STANDALONE), ("combination_required", V.CALLABLE_COMBINATION)) for n, _, c, s in table]
    rows += [("denylist", n, "gateway", 0, None, None, None, None) for n in sorted(set(V.DENYLIST))]
    rows += [("denylist", n, "bytes_gateway", 0, None, None, None, None) for n in sorted({*V.BYTES_DENYLIST} - {*V.DENYLIST})]
    rows += [("denylist", n, "indicator", 0, None, None, None, None) for n in sorted({n for n, benign, *_ in V.CALLABLE_STANDALONE + V.CALLABLE_COMBINATION if not benign} - {*V.DENYLIST, *V.BYTES_DENYLIST})]
    rows += [("literal", n, "standalone", 0, None, None, c, s) for n, _, c, s in V.LITERAL_STANDALONE]
    rows += [("literal", n, "combination_required", 0, None, None, c, s) for n, _, c, s in V.LITERAL_COMBINATION if not n.startswith("entropy>")]
    rows += [("literal", n, "disqualified", 0, None, None, None, None) for n in V.LITERAL_DISQUALIFIED]
    rows += [("literal_prefix", "entropy>", "combination_required", 0, None, None, None, None)]
    rows += [("literal_tier", f"{n}#{k}", q, k, need, least, c, s) for k, (n, need, least, q, c, s) in enumerate(RULE_TIERS)]
    rows += [("name", n, "dangerous", 0, None, None, None, None) for n in V.DANGEROUS_NAMES]
    rows += [("alias", f"{m}.{n}", "public", 0, None, None, MODULE_ALIASES[m], None) for m, names in alias_names().items() for n in sorted(names)]
    return spark.createDataFrame([(*r, version, None) for r in rows], SCHEMA)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """Changes from JSON lines: vocabulary, name, optionally drop (true: the name goes), and the values that it has from then on."""
    values = SCHEMA.rpartition(", valid_from")[0]
    return spark.read.schema(f"{values}, drop boolean").json(path)


def amended(table: DataFrame, changes: DataFrame, version: int) -> DataFrame:
    """The table with ``changes`` (as of `read_changes`) valid from ``version`` on. Saved, so that a chain of versions has no growing plan."""
    key = ["vocabulary", "name"]
    if table.where(F.greatest("valid_from", F.coalesce("valid_to", F.lit(-1))) > version).join(changes, key, "left_semi").limit(1).count():
        raise ValueError(f"a name has changed after version {version}")
    new = changes.select(*key, F.struct(*VALUES).alias("_new"), F.coalesce("drop", F.lit(False)).alias("_drop")).dropDuplicates(key)
    both = table.withColumn("_old", F.struct(*VALUES)).join(new, key, "left")
    ends = F.col("valid_to").isNull() & F.col("_new").isNotNull() & (F.col("_drop") | ~F.col("_old").eqNullSafe(F.col("_new")))
    closed = both.withColumn("valid_to", F.when(ends, F.lit(version).cast("long")).otherwise(F.col("valid_to"))).select(*table.columns)
    holds = table.where("valid_to is null").select(*key, F.struct(*VALUES).alias("_old"))
    fresh = new.where("not _drop").join(holds, key, "left").where("_old is null or not _old <=> _new")
    opened = fresh.select(*key, "_new.*", F.lit(version).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    return saved(closed.where("valid_to is null or valid_from < valid_to").unionByName(opened), "vocabularies")


def as_of(table: DataFrame, version: int) -> DataFrame:
    return table.where((F.col("valid_from") <= version) & (F.coalesce("valid_to", F.lit(2**63 - 1)) > version))


def sized(side: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A side of a join, broadcast only if it has been counted to be small."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def as_of_join(rows: DataFrame, table: DataFrame, vocabulary: str, key: str, version: str, into: str) -> DataFrame:
    """``rows`` with a struct ``into`` of what the vocabulary says of column ``key`` at each row's own ``version``; null where it says nothing."""
    own = table.where(F.col("vocabulary") == vocabulary).select(F.col("name").alias("_name"), F.struct(*VALUES).alias(into), F.col("valid_from").alias("_from"), F.coalesce("valid_to", F.lit(2**63 - 1)).alias("_to"))
    met = (F.col(key) == F.col("_name")) & (F.col("_from") <= F.col(version)) & (F.col(version) < F.col("_to"))
    return rows.join(sized(own), met, "left").drop("_name", "_from", "_to")


def prefix_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the rows of ``table`` (name, ...) whose names their ``key`` begins with: an equality join on the beginnings of the lengths that names have."""
    lengths = sorted(r.n for r in table.select(F.char_length("name").alias("n")).distinct().collect())
    cut = rows.withColumn("_length", F.explode(F.array(*map(F.lit, lengths or [0])))).where(F.col("_length") <= F.char_length(key))
    return cut.withColumn("_name", F.substring(F.col(key), F.lit(1), F.col("_length"))).join(sized(table), F.col("_name") == F.col("name")).drop("_length", "_name", "name")
