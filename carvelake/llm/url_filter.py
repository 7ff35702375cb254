"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for what no rule fits.

A URL's host and path are cut out by SQL functions. The longest rule that fits judges it; URLs that a rule judges are the labelled ones, from which the trees
learn: length, depth of host and path, share of digits, entropy, parameters, and statistics of the host's last label (how many URLs it has, and
the share of blocked ones among those labelled). These statistics are counts over all rows by ``BUCKETS`` hashed labels,
so that their table, the only one broadcast, has a fixed bound. The trees are fitted by Spark's own boosting on distinct labelled feature rows,
weighted by how often they occur, both classes alike in all (a list of rules says nothing of how common bad URLs are); beyond ``TRAIN_ROWS`` of them, those with the least hashes. All rows are scored in the JVM.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is judged by its features like any other; rules of
equal length: the one with the longer host, then the greater in order of host, path and verdict; labelled rows of one class only:
the rest gets that verdict; no labelled row: allow, and no score; repeated rows repeat and weigh each; a null page_id stays null; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carvelake.functions.scalars import entropy

from .common import saved, table

Rule = tuple[str, str, str]
#: verdict, host, path
RULES: list[Rule] = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Lists up to this length are constants of the plan; longer ones are joined.
MOST_CONSTANTS = 64
TRAIN_ROWS, TRAIN_TASKS, BUCKETS, USUAL = 200_000, 8, 4096, 20
TREES, DEPTH, STEP = 20, 4, 0.2
LEXICAL = ["length", "host_depth", "path_depth", "digits", "entropy", "parameters"]
#: Of splits that part the labelled rows alike the first is taken: the share of blocked ones says more of suffixes without labelled rows than their size.
FEATURES = ["suffix_blocked", *LEXICAL, "suffix_urls"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(rows: DataFrame) -> DataFrame:
    """``rows`` (url, ...) with host, path and _query, the part after the path."""
    at = F.locate("://", F.coalesce("url", F.lit("")))
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.char_length("url"))).otherwise("")
    rows = rows.withColumn("_rest", rest)
    rows = rows.withColumn("host", F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), UPPER, LOWER)).withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
    return rows.withColumn("_query", F.regexp_extract("_rest", r"^[^?#]*\?([^#]*)", 1)).drop("_rest")


def _in_order(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[1], r[2], r[0]), reverse=True)


def with_rule(rows: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """``rows`` (host, path, ...) with rule (host and path of the longest that fits, else null) and rule_verdict."""
    if isinstance(rules, list) and len(rules) <= MOST_CONSTANTS:
        fits = lambda host, path: ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        chosen = [F.when(fits(host, path), F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("rule_verdict"))) for verdict, host, path in _in_order(rules)]
        found = F.coalesce(*chosen) if chosen else F.lit(None).cast("struct<rule:string,rule_verdict:string>")
        return rows.withColumn("_rule", found).select(*rows.columns, "_rule.rule", "_rule.rule_verdict")
    if isinstance(rules, list):
        rules = rows.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    return rows.join(_by_join(rows, rules), ["host", "path"], "left")


def _by_join(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule and rule_verdict of each distinct pair that a rule fits: an equality join of the pairs' host suffixes and path beginnings with the rules."""
    shape = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.char_length("path")).alias("lengths")).first()
    if not shape.lengths:
        return rows.select("host", "path", F.lit("").alias("rule"), F.lit("").alias("rule_verdict")).limit(0)
    pairs = rows.select("host", "path").distinct().withColumn("_labels", F.split("host", r"\."))
    number = F.explode(F.sequence(F.lit(1), F.least(F.size("_labels"), F.lit(shape.labels)))).alias("_last")
    pairs = pairs.select("host", "path", "_labels", number).withColumn("_host", F.array_join(F.slice("_labels", -F.col("_last"), F.col("_last")), "."))
    pairs = pairs.select("host", "path", "_host", F.explode(F.array(*map(F.lit, sorted(shape.lengths)))).alias("_length")).where(F.col("_length") <= F.char_length("path"))
    pairs = pairs.withColumn("_path", F.substring(F.col("path"), F.lit(1), F.col("_length")))
    rules = rules.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "verdict")
    rank = F.struct(F.char_length(F.concat("_host", "_path")), F.char_length("_host"), "_host", "_path", "verdict").alias("r")
    found = pairs.join(rules, ["_host", "_path"]).groupBy("host", "path").agg(F.max(rank).alias("r"))
    return found.select("host", "path", F.concat("r._host", "r._path").alias("rule"), F.col("r.verdict").alias("rule_verdict"))


def lexical(url: Column) -> dict[str, Column]:
    """Features of rows (url, host, path, _query)."""
    url = F.coalesce(url, F.lit(""))
    size = F.char_length(url)
    return {
        "length": F.log1p(size),
        "host_depth": F.regexp_count("host", F.lit(r"\.")),
        "path_depth": F.regexp_count("path", F.lit("/+[^/]")),
        "digits": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(size, F.lit(1)),
        "entropy": F.round(entropy(url), 9),
        "parameters": F.regexp_count("_query", F.lit("[^&]+")),
    }


def url_rows(pages: DataFrame, rules: list[Rule] | DataFrame = RULES) -> DataFrame:
    """Saved: page_id, host, path, rule, rule_verdict, label (1: blocked by a rule, 0: allowed, else null), _bucket and the lexical features."""
    rows = with_rule(with_host_and_path(pages.select(F.col("page_id").cast("long").alias("page_id"), "url")), rules)
    own = [v.cast("double").alias(k) for k, v in lexical(F.col("url")).items()]
    label = F.when(F.col("rule_verdict") == "block", 1.0).when(F.col("rule_verdict") == "allow", 0.0)
    bucket = F.pmod(F.xxhash64(F.substring_index("host", ".", -1)), F.lit(BUCKETS)).cast("int")
    return saved(rows.select("page_id", "host", "path", "rule", "rule_verdict", label.alias("label"), bucket.alias("_bucket"), *own), "url-rows")


def with_suffixes(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """``rows`` with the statistics of their suffixes: counts over ``rows``, shares over ``labelled``; at most ``BUCKETS`` rows are broadcast."""
    urls = rows.groupBy("_bucket").agg(F.log1p(F.count("*")).alias("suffix_urls"))
    blocked = labelled.groupBy("_bucket").agg(((F.sum("label") + F.lit(USUAL / 2)) / (F.count("label") + USUAL)).alias("suffix_blocked"))
    stats = saved(urls.join(blocked, "_bucket", "left").fillna(0.5, ["suffix_blocked"]), "url-suffixes")
    return rows.join(F.broadcast(stats), "_bucket")


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(rows)


def fit(labelled: DataFrame, most: int = TRAIN_ROWS) -> GBTClassificationModel | float | None:
    """Trees from rows (label, features); a score for all rows where there is only one class, None without rows."""
    distinct = saved(labelled.groupBy("label", *FEATURES).agg(F.count("*").cast("double").alias("_weight")).hint("rebalance"), "url-train")
    kinds = {r.label: r for r in distinct.groupBy("label").agg(F.count("*").alias("n"), F.sum("_weight").alias("weight")).collect()}
    if len(kinds) < 2:
        return next(iter(kinds), None)
    share = int(min(1.0, most / sum(r.n for r in kinds.values())) * (1 << 30))
    sample = distinct.where(F.pmod(F.xxhash64(*FEATURES), F.lit(1 << 30)) < share).repartition(TRAIN_TASKS)
    sample = sample.withColumn("_weight", F.col("_weight") / F.when(F.col("label") == 1, kinds[1.0].weight).otherwise(kinds[0.0].weight) * (1 << 20))
    trees = GBTClassifier(featuresCol="_x", labelCol="label", weightCol="_weight", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1)
    return trees.fit(_assembled(sample).select("_x", "label", "_weight"))


def scored(rows: DataFrame, model: GBTClassificationModel | float | None) -> DataFrame:
    """``rows`` with score, the chance that the URL is to be blocked."""
    if not isinstance(model, GBTClassificationModel):
        return rows.withColumn("score", F.lit(model).cast("double"))
    found = model.transform(_assembled(rows)).withColumn("score", vector_to_array("probability")[1])
    return found.select(*rows.columns, "score")


def judge_urls(pages: DataFrame, rules: list[Rule] | DataFrame = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of each row of ``pages`` (page_id, url)."""
    rows = url_rows(pages, rules)
    labelled = rows.where("label is not null")
    rows = with_suffixes(rows, labelled)
    found = scored(rows, fit(rows.where("label is not null")))
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
