"""Evidence of literals: a lattice of tiers and tags, matched as relations.

A tag that lists the rules that fired is matched with tiers: the best one whose required rules all fired, with enough rules in all, over the text literals of a hit. Other tags are
matched with the vocabulary by their base name, or by what they begin with. What a tier decides for a base, the plain vocabulary doesn't decide again.

Defined cases: hits without arguments or tags have no evidence; a tag that repeats counts once; tags that no vocabulary has say nothing; null tags are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carvelake.functions.scalars import base_tag, rule_ids
from carvelake.scratch import saved

from .vocabularies import prefix_join, sized

HIT = ["blob_id", "call_seq"]
EVIDENCE = ["tag", "qualification", "category", "subcategory", "rules_fired"]


def meanings(tags: DataFrame, table: DataFrame) -> DataFrame:
    """What each distinct tag (column tag) means: its base, the order in which meanings of a base win, whether only text literals reach it, and its evidence (some rows at times)."""
    tiers = table.where("vocabulary = 'literal_tier'").select(F.substring_index("name", "#", 1).alias("name"), "rank", "require", "min_rules", "qualification", "category", "subcategory", F.substring_index("name", "#", 1).alias("base"))
    rows = prefix_join(tags, tiers, "tag").withColumn("rules_fired", F.array_sort(F.array_distinct(rule_ids(F.col("tag")))))
    reached = (F.size(F.array_except(F.coalesce("require", F.array().cast("array<string>")), F.col("rules_fired"))) == 0) & (F.size("rules_fired") >= F.coalesce("min_rules", F.lit(0)))
    said = F.struct(*EVIDENCE[1:]).alias("said")
    tiered = rows.where(reached).select("tag", "base", F.coalesce(F.col("rank").cast("long"), F.lit(-(2**32))).alias("rank"), F.lit(True).alias("text_only"), F.array(said).alias("said"))
    plain = tags.select("tag", base_tag(F.col("tag")).alias("base")).withColumn("rules_fired", F.array().cast("array<string>"))
    known = table.where("vocabulary = 'literal'").select(F.col("name").alias("base"), "qualification", "category", "subcategory")
    exact = plain.join(sized(known), "base").select("tag", "base", said)
    begun = prefix_join(plain.join(sized(known.select("base")), "base", "left_anti"), table.where("vocabulary = 'literal_prefix'").select("name", "qualification", "category", "subcategory"), "base").select("tag", "base", said)
    plain = exact.unionByName(begun).groupBy("tag", "base").agg(F.collect_list("said").alias("said"))
    return tiered.unionByName(plain.select("tag", "base", F.lit(2**32).alias("rank"), F.lit(False).alias("text_only"), "said"))


def literal_evidence(hits: DataFrame, table: DataFrame) -> DataFrame:
    """blob_id, call_seq and EVIDENCE of hits (blob_id, call_seq, args with type and tags, reasons) under a vocabulary table of one version (`vocabularies.as_of`).

    Tags are looked up once for each distinct one; hits carry the numbers of meanings only, tags that say nothing don't travel, and one hash aggregate takes the best of each hit and base.
    """
    own = F.struct(F.lit(0).alias("leaf"), F.lit(False).alias("text"), F.col("reasons").alias("tags"))
    given = F.transform(F.coalesce("args", F.array().cast(hits.schema["args"].dataType)), lambda a, k: F.struct(k.alias("leaf"), F.coalesce(a["type"] == "T1", F.lit(False)).alias("text"), a["tags"].alias("tags")))
    rows = hits.select(*HIT, F.explode(F.concat(F.array(own), given)).alias("_of")).select(*HIT, "_of.leaf", "_of.text", F.posexplode("_of.tags").alias("nth", "tag")).where("tag is not null")
    found = saved(meanings(rows.select("tag").distinct(), table).withColumn("id", F.monotonically_increasing_id()), "meanings")
    # leaves and tags of a leaf are numbered by ints, so their numbers are digits below the rank
    place = lambda high, leaf, nth: high * F.lit(2**62).cast("decimal(19,0)") + F.shiftleft(leaf.cast("long"), 31).cast("decimal(19,0)") + nth.cast("decimal(10,0)")
    met = rows.join(sized(found.select("tag", "base", "rank", "text_only", "id")), "tag").where("text or not text_only")
    best = met.groupBy(*HIT, F.col("base").alias("tag")).agg(F.min_by("id", place(F.col("rank").cast("decimal(11,0)"), F.col("leaf"), F.col("nth"))).alias("id"))
    return best.join(sized(found.select("id", F.explode("said").alias("_said"))), "id").select(*HIT, "tag", "_said.*")
