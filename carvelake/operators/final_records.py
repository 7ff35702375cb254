"""Final evaluation records: a ledger joined with traces, measurements and attributions, and the tables made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import SEVERITIES, confusion, depth, effective_label, hops, label_of, metrics, rarest_item, refusal, side_of, unreached, used_in, with_priority


def traced(ledger: DataFrame, traces: DataFrame, question: int) -> DataFrame:
    """Traces of the ledger's files that are used for the question, with the ledger's columns."""
    return traces.join(ledger.where(used_in(F.col("used_in_RQ"), question)), "sample_id")


def last_streams(measured: DataFrame) -> DataFrame:
    """sample_id, sha, final_cls, found of the measured streams; of equal digests in a file the last one counts."""
    rows = measured.select("sample_id", F.posexplode("streams").alias("at", "s")).select("sample_id", "at", "s.*")
    return rows.groupBy("sample_id", "sha").agg(F.max_by(F.struct("final_cls", "found"), "at").alias("s")).select("sample_id", "sha", "s.final_cls", "s.found")


def stream_records(corpus: DataFrame, measured: DataFrame) -> DataFrame:
    """One row for each reference stream (sample_id, at, sha, chain), with its hops, depth, terminal class and whether it was found."""
    rows = corpus.select("sample_id", F.posexplode("oracle").alias("at", "o")).select("sample_id", "at", "o.sha", "o.chain")
    joined = rows.join(last_streams(measured), ["sample_id", "sha"], "left")
    return joined.select("sample_id", "at", "sha", "chain", hops(F.col("chain")).alias("via"), depth(F.col("chain")).alias("depth"), "final_cls", F.coalesce("found", F.lit(False)).alias("found"))


def members_hit(wanted: Column, hits: Column) -> Column:
    """How many of the wanted digests a tool has hit, repeated ones counted each."""
    return F.size(F.filter(wanted, lambda x: F.array_contains(F.coalesce(hits, F.array().cast("array<string>")), x)))


def opaque_digests(measured: DataFrame) -> DataFrame:
    """sample_id, n_found and the digests of each file whose last measured stream is opaque, as a list. Sorted by digest and place, the last of each is the one before another digest."""
    places = F.sort_array(F.transform("streams", lambda s, at: F.struct(s["sha"].alias("sha"), at.alias("at"), s["final_cls"].alias("end"))))
    last = lambda x, i: (F.lower(x["end"]) == "opaque") & ~x["sha"].eqNullSafe(F.get("_places", i + 1)["sha"])
    rows = measured.select("sample_id", F.coalesce("n_found", F.lit(0)).alias("n_found"), places.alias("_places"))
    return rows.select("sample_id", "n_found", F.transform(F.filter("_places", last), lambda x: x["sha"]).alias("opaque"))


def reach_records(ledger: DataFrame, traces: DataFrame, measured: DataFrame, question: int = 1) -> DataFrame:
    """One row for each traced file: its chain label, and what the engine and two other tools reached.

    Traces and measurements have one row a file, which holds its streams as a list, so a label is made within the row: all joins are on sample_id, and each table is shuffled by it once at most.
    Labels are those of `chain_label` over `stream_records`. Files that were not measured keep null figures; files without reference streams are labelled 'No stream' and covered.
    """
    corpus = traced(ledger, traces, question)
    corpus = corpus.withColumn("oracle", F.coalesce("oracle", F.array().cast(corpus.schema["oracle"].dataType)))
    found = opaque_digests(measured).withColumn("_measured", F.lit(True))
    chains = F.array_distinct(F.transform("oracle", lambda o: o["chain"]))
    rows = corpus.join(found, "sample_id", "left").withColumns({
        "_wanted": F.transform("oracle", lambda o: o["sha"]), "_vias": F.array_distinct(F.transform(chains, lambda x: F.array_join(hops(x), "→"))),
    })
    need, wanted = F.size("oracle"), F.col("_wanted")
    label = label_of(F.size("_vias"), F.get("_vias", F.lit(0)), F.arrays_overlap(wanted, "opaque"))
    cover = F.when((need == 0) | (F.col("n_found") >= need), 1.0).otherwise(F.round(F.col("n_found") / need, 4))
    return rows.select(
        "sample_id", "label", need.alias("n_oracle"), F.when(need > 0, label).otherwise("No stream").alias("chain_label"), F.coalesce("_measured", F.lit(False)).alias("measured"), "n_found",
        (F.col("n_found") >= 1).alias("reached"), F.when(F.col("_measured"), cover).alias("stream_cover"), members_hit(wanted, F.col("ps_hit")).alias("ps_reached"), members_hit(wanted, F.col("ms_hit")).alias("ms_reached"),
    )


def attributed_records(results: DataFrame, ledger: DataFrame, items: DataFrame) -> DataFrame:
    """Results with the ledger's columns (empty where it has no row), all denylisted items of a file, and the rarest, to which the file is attributed.

    items: sample_id, item. Item frequencies are counted over the files of ``results``.
    """
    own = items.join(results.select("sample_id"), "sample_id", "left_semi")
    tags = own.groupBy("sample_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    entry = rarest_item(own, "sample_id", "item").select("sample_id", F.col("item").alias("entry"))
    of = ledger.select("sample_id", F.col("origin").alias("_origin"), F.col("label").alias("_label"), F.col("format").alias("_format"))
    text = lambda *c: F.coalesce(*c, F.lit(""))
    rows = results.join(of, "sample_id", "left").join(tags, "sample_id", "left").join(entry, "sample_id", "left")
    return rows.select(
        "sample_id", "tier", side_of(F.col("tier")).alias("side"), text("_origin").alias("origin"), text("_label", "label").alias("label"), text("format", "_format").alias("format"), "entry",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("n_unsafe", F.lit(0)).alias("n_unsafe"), F.coalesce("n_review", F.lit(0)).alias("n_review"),
    )


#: Tools of the detection table in its order, main ones and other cut-offs, as columns of `detection_records`.
DETECTORS = ["engine", "ps", "ms", "fk_loose", "wo", "engine_confirmed", "fk_strict", "wo_refused"]
LOOSE, STRICT = "SUSPICIOUS", "LIKELY_OVERTLY_MALICIOUS"


def detection_records(results: DataFrame, stream_verdicts: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """One row for each compared file: its effective label and what each tool said: 1, 0, or null for no judgement.

    results: sample_id, tier, label, group, origin, format, size, warned, confirmed, references, and tools, a struct of ps and ms (status, verdict, seen), fk (status, idx) and wo (status, verdict, refused).
    stream_verdicts: sample_id, loose, strict, n_streams, status of another tool over the carved streams; rows of ``more`` override them.
    """
    said = stream_verdicts if more is None else with_priority(stream_verdicts, more, "sample_id")
    said = said.select("sample_id", *[F.col(c).cast("int").alias(f"fk_stream_{c}") for c in ("loose", "strict")], F.col("status").alias("_status"), F.col("n_streams").alias("_n"), F.lit(True).alias("_there"))
    seen = lambda tool: F.when(~unreached(F.col(f"tools.{tool}.status"), F.col("references"), F.col(f"tools.{tool}.seen")), F.col(f"tools.{tool}.verdict").cast("int"))
    at_least = lambda least: F.when(F.col("tools.fk.status") == "ok", (F.coalesce("tools.fk.idx", F.lit(-1)) >= SEVERITIES.index(least)).cast("int"))
    return results.join(said, "sample_id", "left").select(
        "sample_id", "tier", effective_label(F.col("label"), F.col("tier")).alias("label"), F.coalesce("group", F.lit("main")).alias("group"), "origin", "format", "size",
        F.col("warned").cast("int").alias("engine"), seen("ps").alias("ps"), seen("ms").alias("ms"), at_least(LOOSE).alias("fk_loose"), F.col("tools.wo.verdict").cast("int").alias("wo"),
        F.col("confirmed").cast("int").alias("engine_confirmed"), at_least(STRICT).alias("fk_strict"), refusal(F.col("tools.wo.status"), F.col("tools.wo.refused")).alias("wo_refused"),
        "fk_stream_loose", "fk_stream_strict", F.coalesce("_status", F.lit("no_data")).alias("fk_stream_status"), F.coalesce("_n", F.lit(0)).alias("n_streams"), F.coalesce("_there", F.lit(False)).alias("has_streams"),
    )


def detection_table(records: DataFrame, tools: list[str] = DETECTORS) -> DataFrame:
    """block (each group, and Combined), tool, its confusion and metrics to three places, and the block's files and true labels; files without a true label are inspected, not graded."""
    blocks = records.withColumn("block", F.explode(F.array("group", F.lit("Combined"))))
    graded = blocks.where(F.col("label").isin("T", "F")).withColumn("_truth", (F.col("label") == "T").cast("int"))
    sizes = blocks.groupBy("block").agg(F.count("*").alias("inspected"), F.count_if(F.col("label") == "T").alias("truth_t"), F.count_if(F.col("label") == "F").alias("truth_f"))
    return metrics(confusion(graded, "_truth", tools, ["block"]), 3).join(sizes, "block")


def item_table(records: DataFrame) -> DataFrame:
    """One row for each denylisted item and a subtotal of each kind: files of both sides, and how many of them are at Review or above, and Unsafe.

    kind: 'shared' for items that a benign file uses, else 'malicious only'. The subtotal's entry is null.
    """
    used = records.where(F.col("entry").isNotNull())
    warned, unsafe, benign, malicious = (F.col("n_unsafe") + F.col("n_review") >= 1), F.col("n_unsafe") >= 1, F.col("side") == "benign", F.col("side") != "benign"
    rows = used.groupBy("entry").agg(
        F.count_if(benign).alias("benign"), F.count_if(malicious).alias("malicious"), F.count_if(benign & warned).alias("fp_review"), F.count_if(benign & unsafe).alias("fp_unsafe"),
        F.count_if(malicious & warned).alias("tp_review"), F.count_if(malicious & unsafe).alias("tp_unsafe"),
    )
    kind = F.when(F.col("benign") > 0, "shared").otherwise("malicious only")
    figures = ["benign", "malicious", "fp_review", "fp_unsafe", "tp_review", "tp_unsafe"]
    sets = rows.withColumn("kind", kind).rollup("kind", "entry").agg(*[F.sum(f).alias(f) for f in figures], F.grouping_id().alias("level"))
    return sets.where("level < 3").select("kind", "entry", *figures)


def origin_counts(records: DataFrame) -> DataFrame:
    """How many benign files of each origin an item has, the most first."""
    rows = records.where(F.col("entry").isNotNull() & (F.col("side") == "benign"))
    return rows.groupBy("entry", "origin").agg(F.count("*").alias("files")).orderBy("entry", F.desc("files"), "origin")


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV, for reading, and as Parquet. Arrays are joined by commas in the CSV."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        plain = table.select(*[F.array_join(f.name, ", ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in table.schema.fields])
        plain.coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}.csv", header=True)
