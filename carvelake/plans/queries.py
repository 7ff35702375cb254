"""The engine's queries over the driver's tables, and SQL with the same rows."""

from __future__ import annotations

import gzip
import io
import pickle
import tarfile
import uuid
import zipfile

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carvelake.functions import fixed_values as FV
from carvelake.functions import pattern_index as PI
from carvelake.functions import scalars as S
from carvelake.functions import signals as G
from carvelake.functions.patterns import finds
from carvelake.heap import steady_heap
from carvelake.operators import carve as C
from carvelake.operators import compaction as CO
from carvelake.operators import evaluate as E
from carvelake.operators import evidence as EV
from carvelake.operators import final_records as R
from carvelake.operators import integrity as IN
from carvelake.operators import machine as M
from carvelake.operators import remeasure as RM
from carvelake.operators import slices as SL
from carvelake.operators import verdict as V
from carvelake.operators import vocabularies as VC
from carvelake.operators.behaviour import with_behaviours
from carvelake.operators.slices import in_ranges
from carvelake.plans import report
from carvelake.plans.rule_texts import RULE_TEXTS
from carvelake.scratch import scratch_root
from carvelake.sources import detect as D
from carvelake.sources import members

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


c = F.col

# --- literals and signals ---


@query("""
SELECT doc_id, round(entropy(b), 4) AS entropy FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents) GROUP BY doc_id
""")
def literal_entropy(spark, d):
    """Of all bytes under a doc_id, however many rows have it; none without bytes. Counts are added up by id and byte, so no id's rows meet in one task."""
    counts = t(spark, d, "documents").select("doc_id", F.inline(S.byte_counts(c("text")))).groupBy("doc_id", "byte").agg(F.sum("n").alias("n"))
    ids = counts.groupBy("doc_id").agg(F.collect_list("n").alias("counts"), F.sum("n").alias("total"))
    return ids.select("doc_id", F.round(S.entropy_of_counts(c("counts"), c("total")), 4).alias("entropy"))


@query("""
SELECT sha256(text) AS sha, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1
""")
def sha256_dedup(spark, d):
    return t(spark, d, "documents").groupBy(S.sha256(c("text")).alias("sha")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("""
SELECT doc_id, length(s) AS sample_chars, sha256(s) AS sample_sha FROM (
  SELECT doc_id, CASE WHEN length(text) <= 16384 THEN text ELSE
    list_aggregate(list_transform(range(32), lambda k: substring(text, k * (length(text) // 32) + 1, 512)), 'string_agg', '') END AS s FROM documents)
""")
def stratified_sample(spark, d):
    s = S.stratified_sample(c("text"))
    return t(spark, d, "documents").select("doc_id", F.length(s).alias("sample_chars"), S.sha256(s).alias("sample_sha"))


@query("""
SELECT doc_id, round(length(regexp_replace(text, '[\\x00-\\x7f]', '', 'g')) / greatest(length(text), 1), 6) AS non_ascii,
  round(length(regexp_replace(text, '[^\\x20-\\x7e\\t\\n\\r]', '', 'g')) / greatest(strlen(text), 1), 6) AS printable FROM documents
""")
def byte_ratios(spark, d):
    return t(spark, d, "documents").select("doc_id", F.round(S.non_ascii_ratio(c("text")), 6).alias("non_ascii"), F.round(S.printable_ratio(c("text")), 6).alias("printable"))


@query("""
SELECT page_id, CASE WHEN regexp_matches(url, '(?i)(?:https?|ftp|ftps|sftp|file|ssh|telnet|ldap|smb|nfs)://\\S') THEN 'has_url'
  WHEN regexp_matches(url, '(^|[\\s"''`,;({[])/[a-zA-Z0-9_.~@%-]|[A-Za-z]:[/\\\\]\\S') THEN 'has_path' ELSE 'none' END AS tag FROM pages
""")
def url_or_path(spark, d):
    u = c("url")
    return t(spark, d, "pages").select("page_id", F.when(finds(u, G.URL), "has_url").when(finds(u, G.PATH), "has_path").otherwise("none").alias("tag"))


@query("""
SELECT event_id, CASE WHEN regexp_matches(props, '\\{\\s*["''][A-Za-z_][\\w.-]{0,63}["'']\\s*:') THEN 'has_serialized_config' ELSE '' END AS tags FROM events
""")
def structural_tags(spark, d):
    from carvelake.functions import fixed_values as X

    rows = [F.when(finds(c("props"), r[4]), F.lit(r[0])) for r in X.STRUCTURAL_SIGNALS]
    return t(spark, d, "events").select("event_id", F.array_join(F.array(*rows), " ").alias("tags"))


@query()
def literal_tags(spark, d):
    """Whole signal cascade over every text; patterns with look-around have no RE2 form, so tests hold it against plain Python."""
    texts = t(spark, d, "documents").select(F.lit("documents").alias("origin"), c("doc_id").alias("id"), "text").unionByName(
        t(spark, d, "conversations").select(F.lit("conversations").alias("origin"), (c("conv_id") * 1000 + c("turn")).alias("id"), "text")
    )
    return G.with_signals(texts).select("origin", "id", "tags", G.suspicious(c("tags")).alias("suspicious"))


@query()
def shell_and_python_scores(spark, d):
    return G.with_signals(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "shell_score", "python_score")


def _requirements() -> str:
    own = PI.index("signals")
    lit = lambda g: "'" + g.decode().replace("'", "''") + "'"
    rows = [f"('{name}', {k}, {len(v)}, {lit(g)})" for name in own.names for k, v in enumerate(own.variants[name]) for g in sorted(v)]
    return ", ".join(rows)


@query(f"""
WITH needs(pattern, variant, n, gram) AS (VALUES {_requirements()}),
held AS (SELECT doc_id, gram FROM (SELECT doc_id, lower(text) AS low FROM documents) JOIN (SELECT DISTINCT gram FROM needs) ON contains(low, gram)),
met AS (SELECT doc_id, pattern FROM held JOIN needs USING (gram) GROUP BY doc_id, pattern, variant, n HAVING count(*) = n)
SELECT pattern, count(DISTINCT doc_id) AS docs FROM met GROUP BY pattern
""")
def pattern_candidates(spark, d):
    """The required-substring index over all texts: how many of them each pattern has to be run on."""
    names = F.array(*[F.lit(n) for n in PI.index("signals").names])
    found = t(spark, d, "documents").select(F.explode(PI.candidates(c("text"), "signals")).alias("k"))
    return found.groupBy(F.get(names, c("k")).alias("pattern")).agg(F.count("*").alias("docs"))


@query(f"""
SELECT gram, count(*) AS texts FROM (SELECT lower(text) AS low FROM conversations) JOIN (SELECT DISTINCT gram FROM (VALUES {_requirements()}) v(pattern, variant, n, gram)) ON contains(low, gram) GROUP BY gram
""")
def required_grams(spark, d):
    """The index as a relation: in how many turns of conversations each gram that some pattern requires occurs."""
    rows = t(spark, d, "conversations").select(c("conv_id").alias("key"), "text")
    return PI.postings(rows, "key", "text", "signals").groupBy("gram").agg(F.count("*").alias("texts"))


# --- scalars, detection ---


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 1000 < 1024 AND round(o_totalprice) < 1024 THEN CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) || ' B' ELSE format('{:.1f}', round(o_totalprice) / 1024.0) || ' KB' END AS shown,
  replace(replace(replace(o_orderpriority || '/x!y', '/', '__'), '!', '__'), chr(92), '__') AS safe,
  string_split(o_orderpriority, '-')[1] AS head, lower(hex(encode(o_orderstatus || 'abcdefghijklmnopqrstuvwxyz')))[1:32] AS hex_head,
  CAST((o_orderkey % 65536) AS BIGINT) AS le16 FROM orders WHERE round(o_totalprice) < 1024 * 1024 AND round(o_totalprice, 3) * 1000 % 1024 >= 0
""")
def scalar_functions(spark, d):
    o = t(spark, d, "orders").where(F.round("o_totalprice") < 1024 * 1024)
    key = F.unhex(F.lpad(F.hex(c("o_orderkey") % 65536), 4, "0"))
    swapped = F.concat(F.substring(key, 2, 1), F.substring(key, 1, 1))
    return o.select(
        "o_orderkey", F.regexp_replace(S.human_size(F.round("o_totalprice").cast("long")), ",", "").alias("shown"), S.safe_name(F.concat("o_orderpriority", F.lit("/x!y"))).alias("safe"),
        F.split("o_orderpriority", "-")[0].alias("head"), S.hex_head(F.concat("o_orderstatus", F.lit("abcdefghijklmnopqrstuvwxyz")).cast("binary")).alias("hex_head"), S.little_endian(swapped, 0, 2).alias("le16"),
    )


_KINDS = [("504B0304", "zip"), ("1F8B0800", "gzip"), ("425A6839", "bzip2"), ("FD377A585A00", "lzma"), ("04224D18", "lz4"), ("789C0000", "zlib"), ("80049500", "pickle"), ("00000000", "unknown")]


@query("SELECT o_orderkey, ['zip', 'gzip', 'bzip2', 'lzma', 'lz4', 'zlib', 'pickle', 'unknown'][o_orderkey % 8 + 1] AS kind FROM orders")
def magic_detection(spark, d):
    heads = F.array(*[F.lit(h) for h, _ in _KINDS])
    content = F.unhex(F.concat(F.element_at(heads, (c("o_orderkey") % 8 + 1).cast("int")), F.lit("00112233445566778899")))
    return t(spark, d, "orders").select("o_orderkey", D.file_kind(content).alias("kind"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 140 WHEN 1 THEN -50 WHEN 2 THEN 20 ELSE -30 END AS score, p_partkey % 7 = 0 AS unsafe FROM part
""")
def member_scores(spark, d):
    k = c("p_partkey")
    name = F.when(k % 4 == 0, "archive/data.pkl").when(k % 4 == 1, F.concat(F.lit("archive/data/"), k.cast("string"))).when(k % 4 == 2, "weights.bin").otherwise("archive/version")
    path = F.when(k % 7 == 0, F.concat(F.lit("../"), name)).otherwise(name)
    return t(spark, d, "part").select("p_partkey", D.member_score(name).alias("score"), D.unsafe_member(path).alias("unsafe"))


# --- joins ---


@query("""
WITH n AS (SELECT DISTINCT p_type FROM part), v(w) AS (VALUES ('STEEL'), ('TIN'), ('COPPER'), ('ECONOMY'), ('PLATED'))
SELECT p_type, CASE WHEN p_type IN (SELECT w FROM v) THEN p_type WHEN string_split(p_type, ' ')[-1] IN (SELECT w FROM v) THEN string_split(p_type, ' ')[-1]
  ELSE (SELECT min(w) FROM v WHERE contains(n.p_type, w)) END AS matched FROM n
""")
def vocabulary_match(spark, d):
    words = ["STEEL", "TIN", "COPPER", "ECONOMY", "PLATED"]
    v, last = c("p_type"), F.substring_index("p_type", " ", -1)
    inside = F.coalesce(*[F.when(v.contains(w), F.lit(w)) for w in sorted(words)])
    return t(spark, d, "part").select("p_type").distinct().select("p_type", F.when(v.isin(words), v).when(last.isin(words), last).otherwise(inside).alias("matched"))


@query("""
WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages),
p AS (SELECT DISTINCT list_reverse(string_split(host, '.')) AS r FROM h), e AS (SELECT DISTINCT array_to_string(r[1:2], '.') AS entry FROM p)
SELECT page_id, array_to_string(list_reverse(string_split(host, '.')), '.') AS name, array_to_string(list_reverse(string_split(host, '.'))[1:2], '.') AS entry FROM h
""")
def longest_prefix_join(spark, d):
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    names = t(spark, d, "pages").select("page_id", F.array_join(F.reverse(F.split(host, r"\.")), ".").alias("name"))
    entries = names.select(F.substring_index("name", ".", 2).alias("entry"))
    best = E.longest_prefix(names.select("name").distinct(), "name", entries, "entry")
    return names.join(best, "name").select("page_id", "name", "entry")


@query("""
WITH f AS (SELECT user_id AS k, max(value) AS v, CASE WHEN max(event_id) % 2 = 0 THEN 'ok' ELSE 'error:X' END AS status FROM events GROUP BY user_id)
SELECT c_custkey, CASE WHEN f.status LIKE 'ok%' THEN f.v ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN f ON f.k = c_custkey
""")
def upsert_overlay(spark, d):
    fresh = t(spark, d, "events").groupBy(c("user_id").alias("c_custkey")).agg(F.max("value").alias("c_acctbal"), F.when(F.max("event_id") % 2 == 0, "ok").otherwise("error:X").alias("status"))
    return E.overlay(t(spark, d, "customer").select("c_custkey", "c_acctbal"), fresh, "c_custkey", ["c_acctbal"])


@query("""
SELECT c_custkey AS k, c_nationkey AS n, 'customer' AS origin FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT s_suppkey, s_nationkey, 'supplier' FROM supplier
""")
def priority_union(spark, d):
    a = t(spark, d, "customer").select(c("c_custkey").alias("k"), c("c_nationkey").alias("n"), F.lit("customer").alias("origin"))
    b = t(spark, d, "supplier").select(c("s_suppkey").alias("k"), c("s_nationkey").alias("n"), F.lit("supplier").alias("origin"))
    return E.with_priority(a, b, "k")


@query("""
SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN length(d.text) <> d.n_chars THEN 'size' ELSE 'ok' END AS state, sha256(d.text) AS sha
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def integrity_report(spark, d):
    docs, labels = t(spark, d, "documents"), t(spark, d, "labels").select(c("doc_id").alias("k"), "quality")
    state = F.when(c("k").isNull(), "missing").when(F.length("text") != c("n_chars"), "size").otherwise("ok")
    return docs.join(labels, docs.doc_id == labels.k, "left").select("doc_id", "quality", state.alias("state"), S.sha256(c("text")).alias("sha"))


@query("SELECT o_custkey, count(*) AS orders FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY o_custkey")
def semi_and_anti_joins(spark, d):
    hit = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey"))
    kept = t(spark, d, "orders").join(hit, "o_orderkey", "left_semi").join(t(spark, d, "supplier").select(c("s_suppkey").alias("o_custkey")), "o_custkey", "left_anti")
    return kept.groupBy("o_custkey").agg(F.count("*").alias("orders"))


@query("""
SELECT 'union' AS op, n FROM (SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'except', n FROM (SELECT n_nationkey AS n FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
UNION ALL SELECT 'intersect', n FROM (SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
""")
def set_operations(spark, d):
    a = t(spark, d, "customer").select(c("c_nationkey").alias("n"))
    s = t(spark, d, "supplier")
    b, rich = s.select(c("s_nationkey").alias("n")), s.where("s_acctbal > 5000").select(c("s_nationkey").alias("n"))
    op = lambda name, df: df.select(F.lit(name).alias("op"), "n")
    return op("union", a.union(b).distinct()).unionByName(op("except", t(spark, d, "nation").select(c("n_nationkey").alias("n")).subtract(rich))).unionByName(op("intersect", a.intersect(rich)))


# --- predicates and projections ---


@query("""
WITH s AS (SELECT o_orderkey, '2-' || (1 + o_custkey % 3) || '-' || chr(CAST(65 + o_orderkey % 5 AS INTEGER)) || '-' || o_orderkey AS sid, ['T', 'F', 'na'][o_custkey % 3 + 1] AS label FROM orders),
u AS (SELECT *, string_split(sid, '-')[2] || '-' || string_split(sid, '-')[3] AS tier FROM s)
SELECT sid, tier, CASE WHEN tier IN ('2-A', '2-B') THEN 'benign' WHEN tier = '3-D' THEN 'malicious' ELSE 'other' END AS side,
  CASE WHEN tier = '1-C' THEN 'probe' WHEN tier IN ('2-A', '2-B') AND label IN ('F', 'na') THEN 'benign' WHEN tier = '3-D' THEN 'malicious' ELSE label END AS role,
  CASE WHEN label IN ('T', 'F') THEN label WHEN tier = '1-C' THEN 'F' ELSE label END AS eff, tier NOT IN ('3-E', '1-C') AS in_corpus FROM u
""")
def ledger_projections(spark, d):
    o = t(spark, d, "orders").select(
        F.concat(F.lit("2-"), (c("o_custkey") % 3 + 1).cast("string"), F.lit("-"), F.char(c("o_orderkey") % 5 + 65), F.lit("-"), c("o_orderkey").cast("string")).alias("sid"),
        F.element_at(F.array(F.lit("T"), F.lit("F"), F.lit("na")), (c("o_custkey") % 3 + 1).cast("int")).alias("label"),
    ).withColumn("tier", E.tier_of(c("sid")))
    return o.select("sid", "tier", E.side_of(c("tier")).alias("side"), E.role_of(c("tier"), c("label")).alias("role"), E.effective_label(c("label"), c("tier")).alias("eff"), E.in_corpus(F.lit(None).cast("string"), c("tier"), F.lit("")).alias("in_corpus"))


@query("""
WITH s AS (SELECT l_orderkey, CASE WHEN l_linenumber % 3 = 0 THEN 'zip>gz' WHEN l_suppkey % 4 = 0 THEN 'tar' ELSE '' END AS chain, l_returnflag = 'R' AS opaque FROM lineitem),
v AS (SELECT *, CASE chain WHEN 'zip>gz' THEN 'Container→Streaming' WHEN 'tar' THEN 'Container' ELSE '' END AS via FROM s),
g AS (SELECT l_orderkey, count(DISTINCT via) AS k, min(via) AS via, bool_or(opaque) AS opaque FROM v GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN k > 1 THEN 'Mixed' WHEN via = '' THEN CASE WHEN opaque THEN 'Opaque' ELSE 'Serialization' END ELSE via || CASE WHEN opaque THEN '→opaque' ELSE '' END END AS chain_label FROM g
""")
def chain_labels(spark, d):
    chain = F.when(c("l_linenumber") % 3 == 0, "zip>gz").when(c("l_suppkey") % 4 == 0, "tar").otherwise("")
    rows = t(spark, d, "lineitem").select("l_orderkey", chain.alias("chain"), F.when(c("l_returnflag") == "R", "Opaque").otherwise("Serialization").alias("kind"))
    return E.chain_label(rows, "l_orderkey", "chain", "kind")


@query("""
SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(user_id % 6 + 1 >= 4 AS INTEGER) END AS at_least_suspicious,
  (user_id % 5 <> 0) AND value > 50 AND event_type = 'error' AS unreached, CASE WHEN event_type IN ('error') THEN NULL ELSE CAST(value > 50 AS INTEGER) END AS refused FROM events
""")
def tool_judgements(spark, d):
    sev = F.element_at(F.array(*[F.lit(s) for s in E.SEVERITIES]), (c("user_id") % 6 + 1).cast("int"))
    status = F.when(c("user_id") % 5 == 0, "failed").otherwise("ok")
    return t(spark, d, "events").select(
        "event_id", E.severity_at_least(sev, status, "LIKELY_UNSAFE").alias("at_least_suspicious"),
        E.unreached(status, (c("value") > 50).cast("int"), F.when(c("event_type") == "error", 0).otherwise(1)).alias("unreached"),
        E.refusal(F.when(c("event_type") == "error", "error").otherwise("ok"), c("value") > 50).alias("refused"),
    )


# --- aggregates and windows ---

_TOOLS = """
WITH r AS (SELECT d.doc_id, d.lang, 1 - l.quality AS bad, CASE WHEN d.lang = 'de' THEN NULL ELSE CAST(contains(d.text, '!!') AS INTEGER) END AS shout,
  CAST(contains(d.text, '###') AS INTEGER) AS hash, CASE WHEN d.n_chars < 200 THEN NULL ELSE CAST(d.n_chars > 2000 AS INTEGER) END AS large
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
u AS (SELECT lang, bad, 'shout' AS tool, shout AS v FROM r UNION ALL SELECT lang, bad, 'hash', hash FROM r UNION ALL SELECT lang, bad, 'large', large FROM r),
m AS (SELECT %s tool, count(*) FILTER (bad = 1 AND v = 1) AS tp, count(*) FILTER (bad = 1 AND coalesce(v, 0) = 0) AS fn, count(*) FILTER (bad = 0 AND v = 1) AS fp, count(*) FILTER (bad = 0 AND v = 0) AS tn,
  count(*) FILTER (bad = 1 AND v IS NULL) AS inc_m, count(*) FILTER (bad = 0 AND v IS NULL) AS inc_b FROM u GROUP BY %s)
"""


def _tools(spark, d):
    docs, labels = t(spark, d, "documents"), t(spark, d, "labels").select(c("doc_id").alias("k"), (1 - c("quality")).alias("bad"))
    r = docs.join(labels, docs.doc_id == labels.k)
    return r.select(
        "doc_id", "lang", "bad", F.when(c("lang") != "de", c("text").contains("!!").cast("int")).alias("shout"), c("text").contains("###").cast("int").alias("hash"), F.when(c("n_chars") >= 200, (c("n_chars") > 2000).cast("int")).alias("large")
    )


@query(_TOOLS % ("", "tool") + """
SELECT *, round(tp / nullif(tp + fn, 0), 4) AS recall, round(fn / nullif(tp + fn, 0), 4) AS fnr, round(fp / nullif(fp + tn, 0), 4) AS fpr, round(tp / nullif(tp + fp, 0), 4) AS precision,
  round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1, round((tp + tn) / nullif(tp + tn + fp + fn, 0), 4) AS accuracy, tp + fp AS judged_t, tn + fn - inc_m AS judged_f, inc_m + inc_b AS inconclusive FROM m
""")
def confusion_metrics(spark, d):
    return E.metrics(E.confusion(_tools(spark, d), "bad", ["shout", "hash", "large"]))


@query(_TOOLS % ("coalesce(lang, 'all') AS grp,", "GROUPING SETS ((lang, tool), (tool))") + "SELECT * FROM m")
def confusion_by_group(spark, d):
    by_lang = E.confusion(_tools(spark, d), "bad", ["shout", "hash", "large"], ["lang"])
    sums = [F.sum(x).alias(x) for x in ("tp", "fn", "fp", "tn", "inc_m", "inc_b")]
    return by_lang.groupingSets([[c("lang"), c("tool")], [c("tool")]], "lang", "tool").agg(*sums).select(F.coalesce("lang", F.lit("all")).alias("grp"), "tool", "tp", "fn", "fp", "tn", "inc_m", "inc_b")


@query("""
WITH f AS (SELECT o_orderpriority AS k, count(l_orderkey) AS need, count(l_orderkey) FILTER (l_returnflag <> 'R') AS found, o_orderkey % 10 <> 0 AS measured
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority)
SELECT coalesce(k, 'Total') AS klass, count(*) AS files, CAST(sum(need) AS BIGINT) AS streams, count(*) FILTER (measured) AS measured,
  round(count(*) FILTER (measured AND found >= need) / nullif(count(*) FILTER (measured), 0), 4) AS file_ratio,
  round(sum(found) FILTER (measured) / nullif(sum(need) FILTER (measured), 0), 4) AS stream_ratio FROM f WHERE need > 0 GROUP BY ROLLUP (k)
""")
def reachability(spark, d):
    o, l = t(spark, d, "orders"), t(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    per = l.groupBy("l_orderkey").agg(F.count("*").alias("need"), F.count_if(c("l_returnflag") != "R").alias("found"))
    files = o.join(per, o.o_orderkey == per.l_orderkey, "left").select(c("o_orderpriority").alias("klass"), F.coalesce("need", F.lit(0)).alias("need"), F.coalesce("found", F.lit(0)).alias("found"), (c("o_orderkey") % 10 != 0).alias("measured"))
    return E.reachability(files, "klass", "need", "found", "measured").withColumn("klass", F.coalesce("klass", F.lit("Total")))


@query("""
WITH p AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey), f AS (SELECT p_brand, count(*) AS freq FROM p GROUP BY p_brand)
SELECT l_orderkey, p_brand, freq FROM (SELECT l_orderkey, p_brand, freq, row_number() OVER (PARTITION BY l_orderkey ORDER BY freq, p_brand) AS r FROM p JOIN f USING (p_brand)) WHERE r = 1
""")
def rarest_item(spark, d):
    part = t(spark, d, "part").select(c("p_partkey").alias("l_partkey"), "p_brand")
    return E.rarest_item(t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey"), "l_orderkey", "p_brand")


@query("""
SELECT event_type, count(*) AS n, count(*) FILTER (value > 90) AS high, round(count(*) FILTER (value > 90) / nullif(count(*), 0), 4) AS share, max_by(user_id, n_u) AS top_user FROM (
  SELECT *, count(*) OVER (PARTITION BY event_type, user_id) * 1000000 - user_id AS n_u FROM events) GROUP BY event_type
""")
def item_statistics(spark, d):
    e = t(spark, d, "events").withColumn("n_u", F.count("*").over(Window.partitionBy("event_type", "user_id")) * 1000000 - c("user_id"))
    high = F.count_if(c("value") > 90)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), high.alias("high"), E.ratio(high, F.count("*"), 4).alias("share"), F.max_by("user_id", "n_u").alias("top_user"))


@query("""
SELECT event_id, lag(event_type, 2) OVER w AS before, lag(event_type, 1) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def last_two_strings(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, d, "events").select("event_id", F.lag("event_type", 2).over(w).alias("before"), F.lag("event_type", 1).over(w).alias("last"))


@query("""
SELECT user_id, event_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE n <= 6 OR r <= 3 OR r > n - 3
""")
def head_and_tail(spark, d):
    return E.head_tail(t(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], 6, 3).select("user_id", "event_id")


@query("""
SELECT user_id, event_id FROM (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM events) WHERE event_type = 'error' OR k <= 4
""")
def essential_first(spark, d):
    rows = t(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return E.essential_first(rows, "user_id", ["ts", "event_id"], c("event_type") == "error", 4).select("user_id", "event_id")


@query("""
SELECT user_id, event_type, count(*) AS refs, array_to_string(list(event_id ORDER BY ts, event_id)[1:8], ' ') AS sample FROM events GROUP BY user_id, event_type
""")
def grouped_origins(spark, d):
    return E.grouped_origins(t(spark, d, "events"), "user_id", ["event_type"], "event_id", ["ts", "event_id"]).withColumn("sample", F.array_join(c("sample").cast("array<string>"), " "))


@query("""
WITH RECURSIVE e AS (
  SELECT user_id, event_id AS seq, event_id % 997 AS s, event_id % 997 + CAST(trunc(value) AS BIGINT) % 40 AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events
), f AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(seq BIGINT, s BIGINT, e BIGINT)[]) AS kept FROM e
  UNION ALL
  SELECT f.user_id, e.n, CASE WHEN len(list_filter(kept, lambda k: e.e >= k.s AND k.e >= e.s)) = 0 THEN list_append(kept, {'seq': e.seq, 's': e.s, 'e': e.e}) ELSE kept END
  FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1
), g AS (SELECT user_id, unnest(arg_max(kept, n)) AS k FROM f GROUP BY user_id)
SELECT user_id, k.seq AS seq, k.s AS start, k.e AS "end" FROM g
""")
def overlap_suppression(spark, d):
    """Ranges claimed in order; a greedy fold."""
    rows = t(spark, d, "events").select("user_id", c("event_id").alias("seq"), (c("event_id") % 997).alias("start"), (c("event_id") % 997 + c("value").cast("long") % 40).alias("end"))
    return E.non_overlapping(rows, "user_id", "start", "end", "seq")


@query("""
SELECT * FROM (SELECT l_orderkey, l_linenumber, l_shipmode_key AS slice_end, placeholder FROM (
  SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS l_shipmode_key, l_returnflag = 'N' AS placeholder,
    bool_or(l_returnflag <> 'N') OVER (PARTITION BY l_orderkey, l_suppkey % 3) AS has_real,
    row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3, l_returnflag = 'N' ORDER BY l_linenumber) AS r FROM lineitem)
  WHERE NOT placeholder OR (NOT has_real AND r = 1))
""")
def placeholder_shadowing(spark, d):
    end, holder = c("l_suppkey") % 3, c("l_returnflag") == "N"
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", end.alias("slice_end"), holder.alias("placeholder"))
    same = Window.partitionBy("l_orderkey", "slice_end")
    ranked = rows.withColumn("real", F.bool_or(~c("placeholder")).over(same)).withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey", "slice_end", "placeholder").orderBy("l_linenumber")))
    return ranked.where(~c("placeholder") | (~c("real") & (c("r") == 1))).drop("real", "r")


@query("""
SELECT h.event_id AS hit, o.event_id AS op FROM events h JOIN events o ON o.user_id = h.user_id AND o.event_id BETWEEN h.event_id - 500 AND h.event_id WHERE h.event_type = 'error'
""")
def context_window(spark, d):
    """The operators' interval join by bins: earlier events of the same user close to each error."""
    e = t(spark, d, "events").select("user_id", "event_id", "event_type")
    hits = e.where("event_type = 'error'").select("user_id", c("event_id").alias("hit"), (c("event_id") - 500).alias("lo"))
    return in_ranges(e.select("user_id", c("event_id").alias("op")), hits, "user_id", "op", "lo", "hit").select("hit", "op")


@query("""
SELECT user_id, count(*) AS n_hits, count(*) FILTER (event_type = 'error') AS n_unsafe, count(*) FILTER (event_type = 'signup') AS n_review, count(*) FILTER (event_type = 'error') + count(*) FILTER (event_type = 'signup') >= 1 AS warn,
  array_to_string(list_sort(list(DISTINCT event_type)), ' ') AS callables FROM events GROUP BY user_id
""")
def file_measurement(spark, d):
    unsafe, review = F.count_if(c("event_type") == "error"), F.count_if(c("event_type") == "signup")
    return t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n_hits"), unsafe.alias("n_unsafe"), review.alias("n_review"), (unsafe + review >= 1).alias("warn"), F.array_join(F.array_sort(F.collect_set("event_type")), " ").alias("callables"))


# --- final records and their tables ---


def _detections(spark, d) -> DataFrame:
    """A compared file for each order, what the tools said of it, and verdicts over its streams for some, with corrections for fewer."""
    o, k = t(spark, d, "orders"), c("o_orderkey")
    status = lambda n: F.when(k % n == 0, "error").otherwise("ok")
    tools = F.struct(
        F.struct(status(11).alias("status"), (k % 3 == 0).alias("verdict"), (k % 4).alias("seen")).alias("ps"), F.struct(F.lit("ok").alias("status"), (k % 2 == 0).alias("verdict"), F.when(k % 6 > 0, k % 6 - 1).alias("seen")).alias("ms"),
        F.struct(status(13).alias("status"), (k % 6).alias("idx")).alias("fk"), F.struct(F.when(k % 17 == 0, "child_failed").otherwise("ok").alias("status"), F.when(k % 9 > 0, k % 5 == 0).alias("verdict"), (k % 7 == 0).alias("refused")).alias("wo"),
    )
    results = o.select(
        k.cast("string").alias("sample_id"), F.when(k % 8 == 0, "1-C").otherwise("2-A").alias("tier"), F.when(k % 5 == 0, "T").when(k % 5 == 1, "F").otherwise("").alias("label"), F.when(k % 3 == 0, "Real-world").when(k % 3 == 1, "Variants").alias("group"),
        c("o_orderstatus").alias("origin"), F.lit("pkl").alias("format"), F.lit(1).alias("size"), (k % 4 == 0).alias("warned"), (k % 8 == 0).alias("confirmed"), (k % 2).alias("references"), tools.alias("tools"),
    )
    of = lambda n, add: o.where(k % n == 0).select(k.cast("string").alias("sample_id"), ((k + add) % 3 == 0).alias("loose"), ((k + add) % 6 == 0).alias("strict"), (k % 10).alias("n_streams"), F.lit("ok").alias("status"))
    return R.detection_records(results, of(2, 0), of(10, 1))


_DETECTIONS_SQL = """
WITH k AS (SELECT o_orderkey AS k FROM orders), r AS (
  SELECT k::VARCHAR AS sample_id, CASE WHEN k % 5 = 0 THEN 'T' WHEN k % 5 = 1 OR k % 8 = 0 THEN 'F' ELSE '' END AS label, CASE k % 3 WHEN 0 THEN 'Real-world' WHEN 1 THEN 'Variants' ELSE 'main' END AS grp,
    (k % 4 = 0)::INT AS engine, CASE WHEN NOT (k % 11 > 0 AND k % 2 > 0 AND k % 4 = 0) THEN (k % 3 = 0)::INT END AS ps, CASE WHEN NOT (k % 2 > 0 AND k % 6 = 1) THEN (k % 2 = 0)::INT END AS ms,
    CASE WHEN k % 13 > 0 THEN (k % 6 >= 2)::INT END AS fk_loose, CASE WHEN k % 9 > 0 THEN (k % 5 = 0)::INT END AS wo, (k % 8 = 0)::INT AS engine_confirmed, CASE WHEN k % 13 > 0 THEN (k % 6 >= 4)::INT END AS fk_strict,
    CASE WHEN k % 17 > 0 THEN (k % 7 = 0)::INT END AS wo_refused, CASE WHEN k % 10 = 0 THEN ((k + 1) % 3 = 0)::INT WHEN k % 2 = 0 THEN (k % 3 = 0)::INT END AS fk_stream_loose,
    CASE WHEN k % 10 = 0 THEN ((k + 1) % 6 = 0)::INT WHEN k % 2 = 0 THEN (k % 6 = 0)::INT END AS fk_stream_strict, CASE WHEN k % 2 = 0 THEN 'ok' ELSE 'no_data' END AS fk_stream_status, CASE WHEN k % 2 = 0 THEN k % 10 ELSE 0 END AS n_streams FROM k)
"""


@query(_DETECTIONS_SQL + "SELECT sample_id, label, grp, engine, ps, ms, fk_loose, wo, engine_confirmed, fk_strict, wo_refused, fk_stream_loose, fk_stream_strict, fk_stream_status, n_streams FROM r")
def detection_records(spark, d):
    """What each tool said of each compared file: 1, 0 or nothing."""
    return _detections(spark, d).withColumnRenamed("group", "grp").drop("tier", "origin", "format", "size", "has_streams")


@query(_DETECTIONS_SQL + """
, b AS (SELECT grp AS block, * FROM r UNION ALL SELECT 'Combined', * FROM r), v AS (SELECT block, label, unnest(['engine', 'ps', 'ms', 'fk_loose', 'wo', 'engine_confirmed', 'fk_strict', 'wo_refused']) AS tool, unnest([engine, ps, ms, fk_loose, wo, engine_confirmed, fk_strict, wo_refused]) AS v FROM b WHERE label <> ''),
m AS (SELECT block, tool, count(*) FILTER (label = 'T' AND v = 1) AS tp, count(*) FILTER (label = 'T' AND v IS DISTINCT FROM 1) AS fn, count(*) FILTER (label = 'F' AND v = 1) AS fp, count(*) FILTER (label = 'F' AND v = 0) AS tn,
  count(*) FILTER (label = 'T' AND v IS NULL) AS inc_m, count(*) FILTER (label = 'F' AND v IS NULL) AS inc_b FROM v GROUP BY ALL)
SELECT m.*, round(tp / (tp + fn), 3) AS recall, round(fp / (fp + tn), 3) AS fpr, round(2 * tp / (2 * tp + fp + fn), 3) AS f1, tp + fp AS judged_t, tn + fn - inc_m AS judged_f, inc_m + inc_b AS inconclusive, inspected, truth_t, truth_f
FROM m JOIN (SELECT block, count(*) AS inspected, count(*) FILTER (label = 'T') AS truth_t, count(*) FILTER (label = 'F') AS truth_f FROM b GROUP BY block) USING (block)
""")
def detection_table(spark, d):
    """The tools' confusion and metrics over each group of compared files and over all."""
    return R.detection_table(_detections(spark, d)).drop("fnr", "precision", "accuracy")



#: The driver's tables as a ledger, traces and measurements: orders are files, their lines are streams.
_RECORDS_SQL = """
WITH ledger AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, o_orderstatus AS label FROM orders WHERE o_orderkey % 4 <> 3
), lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS sample_id, l_orderkey, l_linenumber, CAST(l_partkey % 5 AS VARCHAR) AS sha, l_suppkey,
    CASE l_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'zip' WHEN 2 THEN 'zip>gz' WHEN 3 THEN CASE l_linenumber % 2 WHEN 0 THEN 'gz' ELSE 'tar' END ELSE 'x>gz' END AS chain FROM lineitem
), traces AS (
  SELECT sample_id, l_orderkey, list({'sha': sha, 'chain': chain} ORDER BY l_linenumber) FILTER (WHERE l_orderkey % 7 <> 0) AS oracle, list(DISTINCT CAST(l_suppkey % 5 AS VARCHAR)) AS ps_hit FROM lines GROUP BY ALL
), measured AS (
  SELECT sample_id, count(*) // 2 + 1 AS n_found, list({'sha': sha, 'final_cls': CASE WHEN l_linenumber % 3 = 0 THEN 'Opaque' ELSE 'Serialization' END, 'found': l_linenumber % 2 = 0} ORDER BY l_linenumber) AS streams
  FROM lines WHERE l_orderkey % 3 <> 0 GROUP BY sample_id
)"""


def _ledger_tables(spark, d):
    """Traces and measurements are made of one list of each order's lines, so that the lines are shuffled once; the key's largest value keeps the filter of the measured above that list."""
    text = lambda x: x.cast("string")
    o, li = t(spark, d, "orders"), t(spark, d, "lineitem")
    used = F.when(c("o_orderkey") % 4 == 3, "2").otherwise("1;2")
    ledger = o.select(text(c("o_orderkey")).alias("sample_id"), c("o_orderstatus").alias("label"), used.alias("used_in_RQ"))
    line = F.struct("l_linenumber", (c("l_partkey") % 5).alias("part"), (c("l_suppkey") % 5).alias("supplier"))
    orders = li.select(text(c("l_orderkey")).alias("sample_id"), "l_orderkey", line.alias("line")).groupBy("sample_id").agg(F.max("l_orderkey").alias("key"), F.collect_list("line").alias("lines"))
    k, ordered = c("key") % 5, F.sort_array("lines")
    chain = lambda at: F.when(k == 0, "").when(k == 1, "zip").when(k == 2, "zip>gz").when(k == 3, F.when(at % 2 == 0, "gz").otherwise("tar")).otherwise("x>gz")
    oracle = F.transform(ordered, lambda x: F.struct(text(x["part"]).alias("sha"), chain(x["l_linenumber"]).alias("chain")))
    hit = F.array_distinct(F.transform("lines", lambda x: text(x["supplier"])))
    traces = orders.select("sample_id", F.when(c("key") % 7 != 0, oracle).alias("oracle"), hit.alias("ps_hit"), F.lit(None).cast("array<string>").alias("ms_hit"))
    kind = lambda at: F.when(at % 3 == 0, "Opaque").otherwise("Serialization")
    stream = lambda x: F.struct(text(x["part"]).alias("sha"), kind(x["l_linenumber"]).alias("final_cls"), (x["l_linenumber"] % 2 == 0).alias("found"))
    measured = orders.where(c("key") % 3 != 0).select("sample_id", F.expr("size(lines) div 2 + 1").alias("n_found"), F.transform(ordered, stream).alias("streams"))
    return ledger, traces, measured


@query(
    _RECORDS_SQL
    + """, streams AS (
  SELECT t.sample_id, u.s.sha AS sha, u.s.chain AS chain FROM traces t JOIN ledger USING (sample_id), (SELECT unnest(t.oracle) AS s) u
), last AS (
  SELECT sample_id, m.s.sha AS sha, arg_max(m.s.final_cls, m.at) AS final_cls FROM (SELECT sample_id, unnest(streams) AS s, generate_subscripts(streams, 1) AS at FROM measured) m GROUP BY 1, 2
), vias AS (
  SELECT s.sample_id, CASE chain WHEN 'zip' THEN 'Container' WHEN 'tar' THEN 'Container' WHEN 'zip>gz' THEN 'Container→Streaming' WHEN 'gz' THEN 'Streaming' WHEN 'x>gz' THEN 'Streaming' ELSE '' END AS via, l.final_cls
  FROM streams s LEFT JOIN last l ON l.sample_id = s.sample_id AND l.sha = s.sha
), labels AS (
  SELECT sample_id, CASE WHEN count(DISTINCT via) > 1 THEN 'Mixed' WHEN min(via) = '' THEN CASE WHEN bool_or(coalesce(final_cls, '') = 'Opaque') THEN 'Opaque' ELSE 'Serialization' END
    ELSE min(via) || CASE WHEN bool_or(coalesce(final_cls, '') = 'Opaque') THEN '→opaque' ELSE '' END END AS chain_label FROM vias GROUP BY sample_id
)
SELECT sample_id, label, len(coalesce(oracle, [])) AS n_oracle, coalesce(chain_label, 'No stream') AS chain_label, n_found IS NOT NULL AS measured, n_found, n_found >= 1 AS reached,
  CASE WHEN n_found IS NULL THEN NULL WHEN oracle IS NULL OR n_found >= len(oracle) THEN 1.0::DOUBLE ELSE round(n_found::DOUBLE / len(oracle), 4) END AS stream_cover,
  len(list_filter(coalesce(oracle, []), lambda o: list_contains(ps_hit, o.sha))) AS ps_reached, 0 AS ms_reached
FROM traces JOIN ledger USING (sample_id) LEFT JOIN measured USING (sample_id) LEFT JOIN labels USING (sample_id)
"""
)
def reach_records(spark, d):
    return R.reach_records(*_ledger_tables(spark, d))


_ATTRIBUTED = """
WITH results AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, CASE o_orderkey % 3 WHEN 0 THEN '2-A' WHEN 1 THEN '3-D' ELSE '9-Z' END AS tier, o_orderkey % 4 // 3 AS n_unsafe, o_orderkey % 5 // 4 AS n_review, 'R' AS label, NULL AS format, o_custkey FROM orders
), items AS (
  SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS sample_id, 'm.' || CASE WHEN l_orderkey % 3 = 0 THEN l_partkey % 11 ELSE l_partkey % 17 END AS item FROM lineitem WHERE l_partkey % 3 = 0
), freq AS (SELECT item, count(*) AS f FROM items GROUP BY item
), best AS (
  SELECT sample_id, arg_min(item, (f, item)) AS entry, list_sort(list(item)) AS items FROM items JOIN freq USING (item) GROUP BY sample_id
), records AS (
  SELECT r.sample_id, tier, CASE tier WHEN '2-A' THEN 'benign' WHEN '3-D' THEN 'malicious' ELSE 'other' END AS side, coalesce(c_mktsegment, '') AS origin,
    CASE WHEN c_custkey IS NULL THEN r.label ELSE 'L' END AS label, CASE WHEN c_custkey IS NULL THEN '' ELSE 'zip' END AS format, entry, coalesce(items, []) AS items, n_unsafe, n_review
  FROM results r LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0 LEFT JOIN best b ON b.sample_id = r.sample_id
)"""


def _attributed(spark, d):
    o, li, cu = t(spark, d, "orders"), t(spark, d, "lineitem"), t(spark, d, "customer")
    k = c("o_orderkey")
    tier = F.when(k % 3 == 0, "2-A").when(k % 3 == 1, "3-D").otherwise("9-Z")
    results = o.select(k.cast("string").alias("sample_id"), tier.alias("tier"), F.expr("o_orderkey % 4 div 3").alias("n_unsafe"), F.expr("o_orderkey % 5 div 4").alias("n_review"), F.lit("R").alias("label"), F.lit(None).cast("string").alias("format"))
    ledger = o.join(cu.where(c("c_custkey") % 2 == 0), c("o_custkey") == c("c_custkey")).select(k.cast("string").alias("sample_id"), c("c_mktsegment").alias("origin"), F.lit("L").alias("label"), F.lit("zip").alias("format"))
    number = F.when(c("l_orderkey") % 3 == 0, c("l_partkey") % 11).otherwise(c("l_partkey") % 17)
    items = li.where(c("l_partkey") % 3 == 0).select(c("l_orderkey").cast("string").alias("sample_id"), F.concat(F.lit("m."), number.cast("string")).alias("item"))
    return R.attributed_records(results, ledger, items)


@query(_ATTRIBUTED + "SELECT sample_id, tier, side, origin, label, format, entry, array_to_string(items, ' ') AS items, n_unsafe, n_review FROM records")
def attributed_records(spark, d):
    return _attributed(spark, d).withColumn("items", F.array_join("items", " "))


@query(
    _ATTRIBUTED
    + """, rows AS (
  SELECT entry, count(*) FILTER (side = 'benign') AS benign, count(*) FILTER (side <> 'benign') AS malicious, count(*) FILTER (side = 'benign' AND n_unsafe + n_review >= 1) AS fp_review, count(*) FILTER (side = 'benign' AND n_unsafe >= 1) AS fp_unsafe,
    count(*) FILTER (side <> 'benign' AND n_unsafe + n_review >= 1) AS tp_review, count(*) FILTER (side <> 'benign' AND n_unsafe >= 1) AS tp_unsafe FROM records WHERE entry IS NOT NULL GROUP BY entry
), kinds AS (SELECT CASE WHEN benign > 0 THEN 'shared' ELSE 'malicious only' END AS kind, * FROM rows)
SELECT kind, entry, CAST(sum(benign) AS BIGINT) AS benign, CAST(sum(malicious) AS BIGINT) AS malicious, CAST(sum(fp_review) AS BIGINT) AS fp_review, CAST(sum(fp_unsafe) AS BIGINT) AS fp_unsafe,
  CAST(sum(tp_review) AS BIGINT) AS tp_review, CAST(sum(tp_unsafe) AS BIGINT) AS tp_unsafe FROM kinds GROUP BY GROUPING SETS ((kind, entry), (kind))
"""
)
def item_table(spark, d):
    return R.item_table(_attributed(spark, d))


@query(_ATTRIBUTED + "SELECT entry, origin, count(*) AS files FROM records WHERE entry IS NOT NULL AND side = 'benign' GROUP BY entry, origin")
def item_origins(spark, d):
    return R.origin_counts(_attributed(spark, d))


# --- carving, machine, verdicts ---


def _pack(batches):
    """Serialises texts as pickles and wraps them; nothing is ever loaded."""
    steady_heap()
    for batch in batches:
        out = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data, kind = pickle.dumps(text, protocol=2 + key % 4), key % 5
            if kind == 1:
                data = gzip.compress(data, mtime=0)
            elif kind == 2:
                box = io.BytesIO()
                with zipfile.ZipFile(box, "w") as z:
                    z.writestr("archive/data.pkl", data)
                data = box.getvalue()
            elif kind == 3:
                box = io.BytesIO()
                with tarfile.open(fileobj=box, mode="w") as tar:
                    info = tarfile.TarInfo("data.pkl")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
                data = box.getvalue()
            elif kind == 4:
                data = b"\x00junk\x00" + data
            out.append(data)
        yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in batch.column(0).to_pylist()]), pa.array(out, pa.binary())], ["artifact_id", "content"])


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def roundtrip_carve(spark, d):
    artifacts = t(spark, d, "documents").select("doc_id", "text").mapInArrow(_pack, "artifact_id string, content binary")
    ops = M.pickle_ops(C.carve(artifacts)).where(c("opname").isin("BINUNICODE", "SHORT_BINUNICODE"))
    return ops.select(F.split("blob_id", ":")[0].cast("long").alias("doc_id"), S.sha256(c("arg_str")).alias("sha"))


def _text_op(value) -> F.Column:
    data = value.cast("binary")
    return F.concat(F.unhex(F.lit("8C")), F.unhex(F.lpad(F.hex(F.length(data)), 2, "0")), data)


def _event_streams(events: DataFrame) -> DataFrame:
    """Opcode bytes by event type, assembled by expressions."""
    b = lambda h: F.unhex(F.lit(h))
    g = lambda m, n: F.lit(f"c{m}\n{n}\n").cast("binary")
    k = c("event_type")
    arg = _text_op(F.concat(F.lit("value "), c("event_id").cast("string")))
    body = (
        F.when(k == "error", F.concat(g("os", "system"), arg)).when(k == "click", F.concat(g("collections", "OrderedDict"), arg))
        .when(k == "view", F.concat(g("collections", "OrderedDict"), _text_op(F.concat(F.lit("/home/u/"), c("event_id").cast("string")))))
        .when(k == "signup", F.concat(g("sys", "exit"), b("4B00"))).otherwise(F.concat(g("__builtin__", "eval"), arg))
    )
    return events.select(c("event_id").cast("string").alias("blob_id"), F.concat(b("8002"), body, b("85522E")).alias("content"))


@query("""
SELECT event_id, CASE event_type WHEN 'error' THEN 'Unsafe' WHEN 'purchase' THEN 'Unsafe' WHEN 'signup' THEN 'Review' WHEN 'view' THEN 'Low' END AS verdict FROM events WHERE event_type <> 'click'
""")
def synthetic_verdicts(spark, d):
    found = V.scan_blobs(_event_streams(t(spark, d, "events")))
    return found.select(c("blob_id").cast("long").alias("event_id"), "verdict")


@query("""
SELECT event_id, CASE event_type WHEN 'error' THEN 'os.system' WHEN 'purchase' THEN '__builtin__.eval' WHEN 'signup' THEN 'sys.exit' ELSE 'collections.OrderedDict' END AS qualname,
  CASE event_type WHEN 'signup' THEN 0 ELSE 1 END AS n_literals, event_type IN ('error', 'purchase', 'signup') AS denied FROM events
""")
def call_sites(spark, d):
    calls = M.scan_calls(_event_streams(t(spark, d, "events")))
    return calls.select(c("blob_id").cast("long").alias("event_id"), "qualname", F.size("literals").alias("n_literals"), "denied")


def _supplier_archives(spark, d) -> str:
    """A folder with a file for each supplier: a zip archive with one to three members, or a compressed or plain stream."""
    folder = f"{scratch_root(spark)}/archives-{uuid.uuid4().hex}"

    def run(batches):
        for batch in batches:
            store, inner = pafs.FileSystem.from_uri(folder)
            store.create_dir(inner)
            for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stream = pickle.dumps([name, key], 2)
                box = io.BytesIO()
                if key % 4:
                    with zipfile.ZipFile(box, "w") as z:
                        for j in range(key % 4):
                            z.writestr(f"m{j}/part.{'pkl' if j else 'txt'}", stream + b"0" * j, zipfile.ZIP_DEFLATED if key % 3 == 0 else zipfile.ZIP_STORED)
                else:
                    box.write(gzip.compress(stream) if key % 8 else stream)
                with store.open_output_stream(f"{inner}/{key}.bin") as f:
                    f.write(box.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    t(spark, d, "supplier").select("s_suppkey", "s_name").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return folder


@query("""
WITH s AS (SELECT s_suppkey AS k, 15 + length(s_name) + CASE WHEN s_suppkey < 256 THEN 2 WHEN s_suppkey < 65536 THEN 3 ELSE 5 END AS n FROM supplier),
m AS (SELECT k, n, unnest(range(k % 4)) AS j FROM s WHERE k % 4 > 0)
SELECT k AS archive, 'zip' AS layout, 'm' || j || CASE WHEN j = 0 THEN '/part.txt' ELSE '/part.pkl' END AS member, CASE WHEN k % 3 = 0 THEN 'deflated' ELSE 'stored' END AS method,
  CASE WHEN k % 3 > 0 THEN j * (30 + 11 + n) + j * (j - 1) // 2 END AS offset, n + j AS size, CASE WHEN j = 0 THEN 0 ELSE 40 END AS score, 'pickle' AS kind FROM m
UNION ALL SELECT k, CASE WHEN k % 8 > 0 THEN 'gzip' ELSE 'pickle' END, NULL, CASE WHEN k % 8 > 0 THEN 'gzip' END, NULL, NULL, 0, 'pickle' FROM s WHERE k % 4 = 0
""")
def archive_members(spark, d):
    """Archives made from suppliers, listed by the member source: stored members tell where they lie."""
    found = members.read_members(spark, _supplier_archives(spark, d))
    own = F.regexp_extract("path", r"/(\d+)\.bin$", 1).cast("long").alias("archive")
    return found.select(own, "layout", "member", "method", F.when(c("method") == "stored", c("offset")).alias("offset"), "size", "score", "kind")


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'Unsafe' ELSE 'Low' END AS verdict FROM events WHERE event_type IN ('error', 'view')
""")
def nested_payloads(spark, d):
    """A stream inside a bytes literal of a harmless class; its inner call alone makes it unsafe. Views carry a path only."""
    b = lambda h: F.unhex(F.lit(h))
    inner = F.concat(b("8004"), F.lit("cos\nsystem\n").cast("binary"), _text_op(c("event_id").cast("string")), b("85522E"))
    blob = F.concat(b("43"), F.unhex(F.lpad(F.hex(F.length(inner)), 2, "0")), inner)
    arg = F.when(c("event_type") == "error", blob).otherwise(_text_op(F.concat(F.lit("/data/u/"), c("event_id").cast("string"))))
    e = t(spark, d, "events").where(c("event_type").isin("error", "view"))
    streams = e.select(c("event_id").cast("string").alias("blob_id"), F.concat(b("8003"), F.lit("cmodels\nLayer\n").cast("binary"), arg, b("85522E")).alias("content"))
    return V.scan_blobs(streams).select(c("blob_id").cast("long").alias("event_id"), "verdict")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


_RULE_CASES = [(text, sorted([rule, *others])) for rule, (text, others, _) in RULE_TEXTS.items()] + [(silent, None) for *_, silent in RULE_TEXTS.values()]


@query(f"""
SELECT event_id, rule FROM events JOIN (VALUES {_values([(k, r) for k, (_, rules) in enumerate(_RULE_CASES) for r in rules or ()])}) v(k, rule) ON event_id % {len(_RULE_CASES)} = k
""")
def behaviour_rules(spark, d):
    """Every rule over a text that fires it, and over one that doesn't: there, the rule itself is looked for only."""
    texts = F.array(*[F.lit(text) for text, _ in _RULE_CASES])
    own = F.array(*[F.lit(rule) for rule in RULE_TEXTS])
    k, n = c("event_id") % len(_RULE_CASES), len(RULE_TEXTS)
    e = t(spark, d, "events").select("event_id", k.alias("k"), F.get(texts, k.cast("int")).alias("text"))
    fired = with_behaviours(e, "text").select("event_id", "k", F.explode("fired.rule").alias("rule"))
    return fired.where((c("k") < n) | (c("rule") == F.get(own, (c("k") - n).cast("int")))).select("event_id", "rule")


def _argument_streams(spark, d):
    """A call for each event: one string, two, a marked tuple of three, an empty one, or strings before the callable too."""
    b = lambda h: F.unhex(F.lit(h))
    own = _text_op(F.concat(F.lit("id"), c("event_id").cast("string")))
    word = lambda s: _text_op(F.lit(s))
    name = F.lit("cos\nsystem\n").cast("binary")
    body = (
        F.when(c("event_id") % 5 == 0, F.concat(name, own, b("85")))
        .when(c("event_id") % 5 == 1, F.concat(name, own, word("two"), b("86")))
        .when(c("event_id") % 5 == 2, F.concat(name, b("28"), word("a"), own, word("b"), b("74")))
        .when(c("event_id") % 5 == 3, F.concat(name, b("29")))
        .otherwise(F.concat(word("before"), b("30"), name, word("x"), word("y"), own, b("87")))
    )
    return t(spark, d, "events").select(c("event_id").cast("string").alias("blob_id"), F.concat(b("8002"), body, b("522E")).alias("content"))


@query("""
SELECT event_id, unnest(CASE event_id % 5 WHEN 0 THEN [s] WHEN 1 THEN [s, 'two'] WHEN 2 THEN ['a', s, 'b'] WHEN 3 THEN [] ELSE ['x', 'y', s] END) AS value,
  unnest(CASE event_id % 5 WHEN 0 THEN [0] WHEN 1 THEN [0, 1] WHEN 2 THEN [0, 1, 2] WHEN 3 THEN [] ELSE [0, 1, 2] END) AS nth FROM (SELECT event_id, 'id' || event_id AS s FROM events)
""")
def slice_arguments(spark, d):
    """Argument strings of each hit, taken from the opcodes of its slice."""
    streams = _argument_streams(spark, d)
    found = V.scan_blobs(streams).select("blob_id", "call_seq", "slice_start", "slice_end", "text")
    rows = SL.slice_arguments(found, M.pickle_ops(streams))
    nth = F.row_number().over(Window.partitionBy("blob_id", "call_seq").orderBy("at")) - 1
    return rows.select(c("blob_id").cast("long").alias("event_id"), "value", nth.alias("nth"))


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 2 THEN 7 WHEN 3 THEN 3 ELSE 6 END AS ops, 'REDUCE' AS last_op FROM events
""")
def opcode_context(spark, d):
    """How many opcodes the report of each hit shows, without padding, and the last of them."""
    streams = _argument_streams(spark, d)
    found = V.scan_blobs(streams).select("blob_id", "call_seq", "slice_start", "slice_end")
    shown = report.opcode_context(found, M.pickle_ops(streams), padding=0)
    return shown.select(c("blob_id").cast("long").alias("event_id"), F.size("ops").alias("ops"), F.element_at("ops", -1)["opname"].alias("last_op"))


@query("""
SELECT event_id, v.version, CASE WHEN event_type = 'click' THEN CASE WHEN v.version < 5 THEN 'Unsafe' END WHEN event_type = 'view' THEN CASE WHEN v.version >= 5 THEN 'Unsafe' END
  WHEN event_type = 'error' THEN CASE WHEN v.version BETWEEN 5 AND 8 THEN 'Review' END END AS verdict FROM events, (VALUES (0), (5), (9)) v(version) WHERE event_type IN ('click', 'view', 'error')
  AND CASE event_type WHEN 'click' THEN v.version < 5 WHEN 'view' THEN v.version >= 5 ELSE v.version = 5 END
""")
def vocabulary_versions(spark, d):
    """The same calls judged as of three versions of the vocabularies: one callable leaves the lists, one joins them for good, and one for a while and without a meaning of its own."""
    first = VC.own_vocabularies(spark)
    change = lambda rows: spark.createDataFrame(rows, "vocabulary string, name string, qualification string, rank int, require array<string>, min_rules int, category string, subcategory string, drop boolean")
    said = ("Code Execution", "Layer Loading")
    second = VC.amended(first, change([
        ("denylist", "os.system", None, None, None, None, None, None, True), ("callable", "os.system", None, None, None, None, None, None, True),
        ("callable", "models.Layer", "standalone", 0, None, None, *said, False), ("denylist", "models.Layer", "indicator", 0, None, None, None, None, False),
        ("denylist", "models.Other", "indicator", 0, None, None, None, None, False),
    ]), 5)
    table = VC.amended(second, change([("denylist", "models.Other", None, None, None, None, None, None, True)]), 9)
    b = lambda h: F.unhex(F.lit(h))
    g = lambda m, n: F.lit(f"c{m}\n{n}\n").cast("binary")
    name = F.when(c("event_type") == "click", g("os", "system")).when(c("event_type") == "view", g("models", "Layer")).otherwise(g("models", "Other"))
    e = t(spark, d, "events").where(c("event_type").isin("click", "view", "error"))
    streams = e.select("event_id", F.explode(F.array(*[F.lit(v).cast("long") for v in (0, 5, 9)])).alias("version"), F.concat(b("8002"), name, _text_op(F.concat(F.lit("value "), c("event_id").cast("string"))), b("85522E")).alias("content"))
    streams = streams.withColumn("blob_id", F.concat_ws(":", "event_id", "version"))
    found = V.scan_as_of(streams, table)
    part = F.split("blob_id", ":")
    return found.select(part[0].cast("long").alias("event_id"), part[1].cast("long").alias("version"), "verdict")


@query("""
WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_linenumber AS n, l_suppkey % 5 AS s FROM lineitem)
SELECT k, 'has_python_code' AS tag, CASE WHEN n >= 4 THEN 'standalone' ELSE 'combination_required' END AS qualification, 'Code Execution' AS category, 'Embedded Python Source' AS subcategory,
  CASE WHEN n >= 4 THEN 'PY_ASSIGN_RE,' ELSE '' END || 'PY_CALL_SYNTAX_RE,PY_CODE_STRING_RE,PY_INNER_STRING_RE' AS rules FROM e WHERE n >= 3
UNION SELECT k, 'has_python_code', 'combination_required', NULL, NULL, '' FROM e WHERE n < 3
UNION SELECT k, tag, qualification, category, subcategory, '' FROM e JOIN (VALUES (1, 'entropy>=5.0', 'combination_required', NULL, NULL), (2, 'has_path_traversal', 'standalone', 'File System Access', 'Path Traversal'),
  (3, 'literal_truncated', 'disqualified', NULL, NULL), (4, 'has_url', 'combination_required', 'Network Connection', 'Embedded URL Literal')) v(s, tag, qualification, category, subcategory) USING (s)
""")
def literal_evidence(spark, d):
    """Both tiers of embedded Python, and plain tags by name and by what they begin with."""
    ids = F.array(*[F.lit(x) for x in ("PY_CALL_SYNTAX_RE", "PY_CODE_STRING_RE", "PY_INNER_STRING_RE", "PY_ASSIGN_RE")])
    fired = F.slice(ids, F.lit(1), F.least(c("l_linenumber"), F.lit(4)).cast("int"))
    code = F.concat(F.lit("has_python_code("), F.array_join(fired, ","), F.lit(")"))
    plain = F.get(F.array(*map(F.lit, ["nothing_known", "entropy>=5.0 (5.31)", "has_path_traversal", "literal_truncated(20000)", "has_url"])), (c("l_suppkey") % 5).cast("int"))
    arg = lambda kind, *tags: F.struct(F.lit(kind).alias("type"), F.array(*tags).alias("tags"))
    fewer = F.concat(F.lit("has_python_code("), F.array_join(F.slice(fired, 1, 2), ","), F.lit(")"))
    k = c("l_orderkey") * 10 + c("l_linenumber")
    hits = t(spark, d, "lineitem").select(k.alias("k"), k.cast("string").alias("blob_id"), F.lit(0).alias("call_seq"), F.array(plain).alias("reasons"), F.array(arg("T1", fewer), arg("T2", F.lit("has_url2")), arg("T1", code, plain)).alias("args"))
    found = EV.literal_evidence(hits, VC.as_of(VC.own_vocabularies(spark), 0))
    return found.select(c("blob_id").cast("long").alias("k"), "tag", "qualification", "category", "subcategory", F.array_join("rules_fired", ",").alias("rules"))


@query("""
SELECT s_suppkey AS sample, 's' || s_suppkey || '.txt' AS name, CASE s_suppkey % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'size' WHEN 2 THEN 'digest' ELSE 'ok' END AS state FROM supplier
UNION ALL SELECT NULL, 'x' || s_suppkey || '.txt', 'extra' FROM supplier WHERE s_suppkey % 6 = 3
""")
def ledger_check(spark, d):
    """A ledger of suppliers against files that were written from the same rows, some of them missing, longer, changed or unknown to the ledger."""
    k = c("s_suppkey")
    said = F.concat_ws("|", "s_name", "s_nationkey")
    ledger = t(spark, d, "supplier").select(k.alias("sample_id"), F.concat(F.lit("s"), k, F.lit(".txt")).alias("path"), F.sha2(said, 256).alias("sha256"), F.octet_length(said).cast("long").alias("size_bytes"))
    rows = t(spark, d, "supplier").withColumn("data", F.when(k % 6 == 1, F.concat(said, F.lit("!"))).when(k % 6 == 2, F.translate(said, "S|", "Z!")).otherwise(said))
    files = rows.where(k % 6 != 0).select(F.concat(F.lit("s"), k, F.lit(".txt")).alias("name"), "data").union(rows.where(k % 6 == 3).select(F.concat(F.lit("x"), k, F.lit(".txt")), "data"))
    folder = _written(spark, files)
    return IN.verified(ledger, IN.listing(spark, folder)).select(c("sample_id").alias("sample"), "name", "state")


def _written(spark, files: DataFrame, folder: str | None = None) -> str:
    """A folder, new or given, with a file of each row (name, data)."""
    folder = folder or f"{scratch_root(spark)}/files-{uuid.uuid4().hex}"

    def run(batches):
        for batch in batches:
            store, inner = pafs.FileSystem.from_uri(folder)
            store.create_dir(inner)
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_output_stream(f"{inner}/{name}") as f:
                    f.write(data.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return folder


@query("""
SELECT name, CASE WHEN k % 5 = 0 OR name LIKE 'new%' THEN 2 ELSE 1 END AS run, length(s) AS bytes, sha256(s) AS sha FROM (
  SELECT s_suppkey AS k, 's' || s_suppkey || '.txt' AS name, s_name || CASE WHEN s_suppkey % 5 = 0 THEN '?' ELSE '' END AS s FROM supplier WHERE s_suppkey % 7 > 0
  UNION ALL SELECT s_suppkey, 'new' || s_suppkey || '.txt', s_name FROM supplier WHERE s_suppkey % 10 = 1)
""")
def remeasured_files(spark, d):
    """Files of suppliers measured twice; between the runs some change, some go and some come. The run tells when a file was measured last."""
    k = c("s_suppkey")
    rows = t(spark, d, "supplier").select(k, "s_name", F.concat(F.lit("s"), k, F.lit(".txt")).alias("name"))
    folder, store = _written(spark, rows.select("name", c("s_name").alias("data"))), f"{scratch_root(spark)}/measured-{uuid.uuid4().hex}"
    measure = lambda files: files.join(IN.digests(files.select("path")), "path").select("path", c("length").alias("bytes"), c("digest").alias("sha"))
    RM.remeasure(spark, folder, store, measure, 16)
    later = rows.where(k % 5 == 0).select("name", F.concat("s_name", F.lit("?")).alias("data")).union(rows.where(k % 10 == 1).select(F.concat(F.lit("new"), k, F.lit(".txt")), "s_name"))
    _written(spark, later, folder)
    _removed(rows.where(k % 7 == 0).select("name"), folder)
    return RM.remeasure(spark, folder, store, measure, 16).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "run", "bytes", "sha")


def _removed(names: DataFrame, folder: str) -> None:
    def run(batches):
        for batch in batches:
            store, inner = pafs.FileSystem.from_uri(folder)
            for name in batch.column(0).to_pylist():
                store.delete_file(f"{inner}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    names.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _leaves_of_suppliers(spark, d) -> DataFrame:
    """A hit for each supplier's number modulo 500, with its line items as leaves."""
    leaf = (c("l_orderkey") * 8 + c("l_linenumber")).cast("long")
    value = F.when(c("l_linenumber") == 7, F.concat(F.lit("cos\nsystem\n"), F.repeat(F.lit("x"), F.lit(300)), F.lit("."))).otherwise(F.repeat(c("l_returnflag"), (c("l_quantity") * 10).cast("int")))
    rows = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(x).alias(x) for x in ("l_suppkey", "l_returnflag", "l_quantity")])
    return rows.select(
        (c("l_suppkey") % 500).cast("string").alias("blob_id"), F.lit(0).alias("call_seq"), leaf.alias("leaf"), c("l_returnflag").alias("kind"), F.when(c("l_returnflag") == "R", "T2").otherwise("T1").alias("type"),
        (c("l_quantity") > 49).alias("flagged"), F.lit(False).alias("nested"), value.alias("value"), (c("l_suppkey") % 2 == 0).alias("low"),
    )


_LEAVES_SQL = """
WITH l AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS k, min(l_returnflag) AS f, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
v AS (SELECT k % 500 AS hit, l_orderkey * 8 + l_linenumber AS leaf, f AS kind, f = 'R' OR q > 49 AS essential, k % 2 = 0 AS low, l_linenumber = 7 AS nested,
  CASE WHEN l_linenumber = 7 THEN 'cos' || chr(10) || 'system' || chr(10) || repeat('x', 300) || '.' ELSE repeat(f, (q * 10)::INTEGER) END AS value FROM l),
m AS (SELECT *, essential OR NOT low AND row_number() OVER (PARTITION BY hit, essential, low ORDER BY leaf) <= 32 AS kept FROM v)
"""


@query(_LEAVES_SQL + """
SELECT hit, leaf, CASE WHEN length(value) > 256 AND NOT nested THEN value[1:256] ELSE value END AS value, CASE WHEN length(value) > 256 AND NOT nested THEN length(value) END AS value_len,
  CASE WHEN length(value) > 256 AND NOT nested THEN sha256(value) END AS value_sha256 FROM m WHERE kept
""")
def compacted_leaves(spark, d):
    """Leaves that a compact report keeps, cut to its limit."""
    found = CO.compact_leaves(_leaves_of_suppliers(spark, d))
    return found.select(c("blob_id").cast("long").alias("hit"), "leaf", "value", "value_len", "value_sha256")


@query(_LEAVES_SQL + """
SELECT hit, count(*) AS total, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS omitted, count(*) FILTER (NOT kept AND kind = 'A') AS a, count(*) FILTER (NOT kept AND kind = 'N') AS n,
  count(*) FILTER (NOT kept) AS t1 FROM m GROUP BY hit HAVING count(*) FILTER (NOT kept) > 0
""")
def omissions(spark, d):
    """What a compact report leaves out, by kind and type."""
    found = CO.omission_summary(_leaves_of_suppliers(spark, d))
    of = lambda m, k: F.coalesce(F.try_element_at(c(m), F.lit(k)), F.lit(0))
    return found.select(c("blob_id").cast("long").alias("hit"), "total", "kept", "omitted", of("omitted_by_kind", "A").alias("a"), of("omitted_by_kind", "N").alias("n"), of("omitted_by_type", "T1").alias("t1"))


@query("""
WITH r AS (SELECT user_id % 40 AS hit, event_id AS nth, event_type AS kind, event_id % 3 AS d FROM events WHERE user_id % 40 < 30 OR event_id % 50 = 0),
g AS (SELECT hit, d, kind, count(*) AS refs, min(nth) AS nth, list(nth ORDER BY nth)[1:8] AS s FROM r GROUP BY ALL),
c AS (SELECT hit, sum(refs) >= 64 AND count(*) < sum(refs) AS grouped FROM g GROUP BY hit)
SELECT hit, nth, d, kind, refs, array_to_string(s, ' ') AS sample, TRUE AS grouped FROM g JOIN c USING (hit) WHERE grouped
UNION ALL SELECT hit, nth, d, kind, 1, nth::VARCHAR, FALSE FROM r JOIN c USING (hit) WHERE NOT grouped
""")
def grouped_memo_reads(spark, d):
    """Memo reads of a hit grouped by origin where there are many and grouping is smaller."""
    e = t(spark, d, "events").where("user_id % 40 < 30 or event_id % 50 = 0")
    reads = e.select((c("user_id") % 40).cast("string").alias("blob_id"), F.lit(0).alias("call_seq"), c("event_id").alias("nth"), c("event_id").alias("get_idx"), (c("event_id") % 3).alias("defined_at"), c("event_type").alias("kind"), F.lit(None).cast("string").alias("callable"))
    found = CO.grouped_reads(reads)
    return found.select(c("blob_id").cast("long").alias("hit"), "nth", c("defined_at").alias("d"), "kind", "refs", F.array_join(F.transform("get_idx_sample", lambda x: x.cast("string")), " ").alias("sample"), "grouped")


@query(f"""
WITH n AS (SELECT unnest({sorted(FV.DANGEROUS_NAMES)!r}) AS name), o AS (SELECT list(name ORDER BY name) AS names FROM n),
v AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN w WHEN 1 THEN p_type || '.' || w WHEN 2 THEN lower(p_type) || '_' || w || '_' || p_size WHEN 3 THEN w || '.' || p_type ELSE p_type END AS value
  FROM (SELECT *, names[1 + p_partkey % len(names)] AS w FROM part, o))
SELECT p_partkey, CASE WHEN value IN (SELECT name FROM n) THEN value WHEN string_split(value, '.')[-1] IN (SELECT name FROM n) THEN string_split(value, '.')[-1] ELSE (SELECT min(name) FROM n WHERE contains(value, name)) END AS matched FROM v
""")
def dangerous_names(spark, d):
    """The dangerous name that each of many values holds: itself, its last component, or the first that it contains."""
    names = F.array(*[F.lit(n) for n in sorted(FV.DANGEROUS_NAMES)])
    k, w = c("p_partkey"), F.get(names, (c("p_partkey") % len(FV.DANGEROUS_NAMES)).cast("int"))
    value = F.when(k % 5 == 0, w).when(k % 5 == 1, F.concat_ws(".", "p_type", w)).when(k % 5 == 2, F.concat_ws("_", F.lower("p_type"), w, "p_size")).when(k % 5 == 3, F.concat_ws(".", w, "p_type")).otherwise(c("p_type"))
    return t(spark, d, "part").select("p_partkey", V.dangerous_name(value).alias("matched"))


@query("""
SELECT event_id, h.q AS qualname, h.s AS slice_start FROM (
  SELECT event_id, unnest(CASE WHEN event_id % 2 = 0 THEN [{'q': 'os.system', 's': 5}, {'q': 'os.popen', 's': 9}] ELSE [{'q': 'os.popen', 's': 2}] END) AS h FROM events)
""")
def shared_arguments(spark, d):
    """Two calls that share a memoised argument are two hits, for a memo read begins a slice; a call that holds another one in its argument is none besides it."""
    b = lambda h: F.unhex(F.lit(h))
    g = lambda m, n: F.lit(f"c{m}\n{n}\n").cast("binary")
    arg = _text_op(c("event_id").cast("string"))
    shared = F.concat(b("8002"), arg, b("85710030"), g("os", "system"), b("68005230"), g("os", "popen"), b("6800522E"))
    inside = F.concat(b("8002"), g("os", "system"), g("os", "popen"), arg, b("85528552"), b("2E"))
    streams = t(spark, d, "events").select(c("event_id").cast("string").alias("blob_id"), F.when(c("event_id") % 2 == 0, shared).otherwise(inside).alias("content"))
    return V.scan_blobs(streams).select(c("blob_id").cast("long").alias("event_id"), "qualname", "slice_start")


@query("""
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 5001 AS n_literals, 'Unsafe' AS verdict FROM nation
""")
def payload_behind_many_leaves(spark, d):
    """A nested pickle behind 5000 harmless literals of one call."""
    b = lambda h: F.unhex(F.lit(h))
    inner = F.concat(b("8004"), F.lit("cos\nsystem\n").cast("binary"), _text_op(c("n_name")), b("85522E"))
    leaves = F.unhex(F.repeat(F.lit("8C0161"), 5000))
    content = F.concat(b("8003"), F.lit("cmodels\nLayer\n").cast("binary"), b("28"), leaves, b("43"), F.unhex(F.lpad(F.hex(F.length(inner)), 2, "0")), inner, b("74522E"))
    found = V.scan_blobs(t(spark, d, "nation").select(c("n_nationkey").cast("string").alias("blob_id"), content.alias("content")))
    return found.select(c("blob_id").cast("long").alias("n_nationkey"), F.size("args").alias("n_literals"), "verdict")


#: callable, head of its bytes argument, rule
_BYTES_CASES = [("zlib.decompress", "789C", "ZlibObfuscatedExec"), ("pickle.loads", "8004", "NestedPickleExecution"), ("numpy.load", "6E70", "BytesIOLoadChain"), ("marshal.loads", "E300", "MarshalObfuscation")]


@query(f"""
SELECT event_id, qualname, rule FROM events JOIN (VALUES {_values([(k, q, r) for k, (q, _, r) in enumerate(_BYTES_CASES)])}) v(k, qualname, rule) ON event_id % {len(_BYTES_CASES)} = k
""")
def rules_on_bytes(spark, d):
    """Standalone rules that need a bytes literal's placeholder, through the whole cascade."""
    b = lambda h: F.unhex(F.lit(h))
    k = (c("event_id") % len(_BYTES_CASES)).cast("int")
    names = F.array(*[F.lit("c" + q.replace(".", "\n") + "\n") for q, *_ in _BYTES_CASES])
    heads = F.array(*[F.lit(h) for _, h, _ in _BYTES_CASES])
    body = F.concat(F.unhex(F.get(heads, k)), F.lit("some plain text ").cast("binary"), c("event_id").cast("string").cast("binary"))
    content = F.concat(b("8003"), F.get(names, k).cast("binary"), b("43"), F.unhex(F.lpad(F.hex(F.length(body)), 2, "0")), body, b("85522E"))
    found = V.scan_blobs(t(spark, d, "events").select(c("event_id").cast("string").alias("blob_id"), content.alias("content")))
    rule = F.explode(F.transform(F.filter("fired", lambda r: r["tier"] == "standalone"), lambda r: r["rule"]))
    return found.select(c("blob_id").cast("long").alias("event_id"), "qualname", rule.alias("rule"))


@query("""
SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'builtins.eval' ELSE '__builtin__.eval' END AS canonical FROM events
""")
def canonical_names(spark, d):
    proto = F.when(c("user_id") % 2 == 0, 2).otherwise(4)
    return t(spark, d, "events").select("event_id", V.canonical_name(F.lit("__builtin__"), F.lit("eval"), proto).alias("canonical"))


@query()
def verdict_counts(spark, d):
    """Flagship: every text as the argument of a harmless call, judged; counts by table and verdict."""
    texts = t(spark, d, "documents").select(F.lit("documents").alias("origin"), "text").unionByName(t(spark, d, "conversations").select(F.lit("conversations").alias("origin"), "text"))
    # copies are counted first, so each distinct text is scored once, and the texts are dealt over all tasks
    counted = texts.groupBy("origin", S.sha256(F.coalesce("text", F.lit(""))).alias("blob_id")).agg(F.count("*").alias("copies"), F.first(F.coalesce("text", F.lit(""))).alias("text"))
    b = lambda h: F.unhex(F.lit(h))
    size = F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(F.octet_length("text"), 8 * k).bitwiseAND(F.lit(255))), 2, "0")) for k in range(4)])
    content = F.concat(b("8003"), F.lit("cmodels\nLayer\n").cast("binary"), b("58"), size, c("text").cast("binary"), b("85522E"))
    streams = counted.groupBy("blob_id").agg(F.first("text").alias("text")).select("blob_id", content.alias("content"))
    rank = F.when(c("verdict") == "Unsafe", 0).when(c("verdict") == "Review", 1).otherwise(2)
    worst = V.scan_blobs(streams).groupBy("blob_id").agg(F.min_by("verdict", rank).alias("verdict"))
    judged = counted.select("origin", "blob_id", "copies").join(worst, "blob_id", "left")
    return judged.groupBy("origin", F.coalesce("verdict", F.lit("none")).alias("verdict")).agg(F.sum("copies").alias("n"))
