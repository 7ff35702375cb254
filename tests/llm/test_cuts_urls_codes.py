"""Fill-in-the-middle, URL filters, vector codes, and the pipeline's stages on any extra column."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from carvelake.llm import common, fim, url_filter, vector_codes

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LONG = "".join(f"w{k} \t" for k in range(50_000))
TEXTS = [None, "", " ", "a", " a b\n", "Ünï 漢字 🎉🎉\x85 x", LONG, "has <P> in it", "<S", "<<S ><M", "x" * 100_000, "\x0b\x0c words \x1c here\u3000and there "]


def plain_fim(doc_id, text, percent, spm):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("percent", [50, 100])
def test_fim_against_plain_cuts(spark, percent):
    rows = [(k, TEXTS[k % len(TEXTS)], 1, 2) for k in range(60)] + [(7, "a b c", 1, 2)] * 5 + [(None, t, 1, 2) for t in TEXTS]
    rows += [(3, "one id", 1, 2), (3, "two texts", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, print int")
    got = fim.fill_in_middle(docs, cut_percent=percent).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted([plain_fim(d, t, percent, 80) for d, t, *_ in rows], key=key)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t, *_ in rows)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_fim_copies_are_told_apart_in_bounded_arrays(spark, monkeypatch):
    monkeypatch.setattr(fim, "COPIES", 3)
    docs = spark.createDataFrame([(1, "alpha beta gamma delta")] * 10 + [(2, "alpha beta gamma delta")] * 3, "doc_id long, text string")
    got = fim.fill_in_middle(docs, cut_percent=100).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: 10, 2: 3}


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_vector_codes"])
def test_query_equals_its_sql(spark, sf, name):
    from carvelake.llm import registry

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(registry.SQL[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = [tuple(r) for r in registry.QUERIES[name](spark, sf).select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Plain Python integers; all vectors of one length."""
    rows = [(i, label, [int(np.floor(4096 * float(x))) for x in v]) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(rows[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v, p) for _, _, v in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            near = [best(v, p)[1] for _, _, v in rows]
            books[p] = [[sum(c) // len(c) for c in zip(*own)] if (own := [cut(v, p) for (_, _, v), n in zip(rows, near) if n == k]) else e for k, e in enumerate(books[p])]
    out = []
    for i, label, v in rows:
        found = [best(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    sums = {x: sum(e for _, _, e, y in out if y == x) for x in {label for *_, label in out}}
    print_ = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return [(i, code, e, sums[label], print_) for i, code, e, label in out]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, code string, _label int")


def test_vector_codes_against_plain_integers(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k * 37 % 200), int(k % 3) if k % 7 else None, rng.normal(size=16).tolist(), "c", 1) for k in range(200)]
    rows += rows[:9] + [(500, 1, None, "c", 1), (501, 1, [float("nan")] * 16, "c", 1), (502, None, [None] * 16, "c", 1), (503, 2, [float("-inf")] * 16, "c", 1), (None, 2, [0.5] * 16, "c", 1), (3, 9, [-0.25] * 16, "c", 1)]
    got = vector_codes.compress_vectors(vectors(spark, rows).repartition(5)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_codes([r[:3] for r in rows]), key=str)


def test_vector_codes_edges(spark):
    few = [(k, None, [0.1 * k] * 8, "c", 1) for k in range(3)]
    got = vector_codes.compress_vectors(vectors(spark, few)).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == [(k, f"0{k}" * 8, 0, 0) for k in range(3)]
    odd = [(k, 1, [float(k), 1.0, 2.0], "c", 1) for k in range(20)] + [(k, 1, [], "c", 1) for k in range(2)] + [(99, 1, [1e300, -1e300, 0.0], "c", 1)]
    got = vector_codes.compress_vectors(vectors(spark, odd)).collect()
    assert len(got) == 23 and all(len(r.code) == 16 for r in got) and len({r.codebooks_sha256 for r in got}) == 2
    assert vector_codes.compress_vectors(vectors(spark, [])).count() == 0
    with pytest.raises(Exception, match="lengths"):
        vector_codes.compress_vectors(vectors(spark, [(k, 1, [0.0] * k, "c", 1) for k in range(70)])).count()


def plain_rule(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(a + b), len(a), a, b, v) for v, a, b in rules if (host == a or host.endswith("." + a)) and path.startswith(b)]
    best = max(fit, default=None)
    return host, path, best and best[2] + best[3], best and best[4]


URLS = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/EN/x", "https://www.example.com/en/1?a=b&c=d#e", "http://example.com", "http://example.com?x://y.net/es/", "ftp://u:p@a.b.net:80/fr/", "http://com/", "http://xcom/", "http://a..com//", "x" * 20_000, "http://ÄÖ.net/es/ü", "http://net/es", "a://b://c.com/", "http://İ.com/\nx"]


@pytest.mark.parametrize("rules", [url_filter.RULES, [("block", "b.c", "/aa/"), ("allow", "a.b.c", "/a"), ("block", "com", "/"), ("allow", "com", "/"), ("allow", "net", "")], []], ids=["five", "ties", "none"])
def test_url_rules_against_plain_code(spark, monkeypatch, rules):
    urls = URLS + ["http://a.b.c/aa/", "http://z.a.b.c/aa/x", "http://q.com/"]
    rows = url_filter.with_host_and_path(spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string"))
    want = sorted((k, *plain_rule(u, rules)) for k, u in enumerate(urls))
    columns = ["page_id", "host", "path", "rule", "rule_verdict"]
    assert sorted(map(tuple, url_filter.with_rule(rows, rules).select(*columns).collect())) == want
    monkeypatch.setattr(url_filter, "MOST_CONSTANTS", -1)
    assert sorted(map(tuple, url_filter.with_rule(rows, rules).select(*columns).collect())) == want


def test_url_trees_on_held_out_urls(spark):
    """Trees fitted on URLs with a known answer judge others right."""
    rng = np.random.default_rng(2)
    good = [f"https://site{k}.example.org/{'/'.join(rng.choice(['news', 'about', 'team', 'blog'], 2))}/" for k in range(300)]
    bad = [f"http://{rng.integers(10**9)}.x{k}.example.org/{rng.integers(10**12)}?id={rng.integers(10**9)}&r={rng.integers(10**9)}&k={k}" for k in range(300)]
    urls = [(k, u, float(k >= 300)) for k, u in enumerate(good + bad)]
    pages = spark.createDataFrame([(k, u) for k, u, _ in urls], "page_id long, url string")
    truth = spark.createDataFrame([(k, y) for k, _, y in urls], "page_id long, truth double")
    rows = url_filter.url_rows(pages, []).drop("label").join(truth.withColumnRenamed("truth", "label"), "page_id")
    rows = url_filter.with_suffixes(rows, rows.where("page_id % 3 > 0"))
    found = url_filter.scored(rows, url_filter.fit(rows.where("page_id % 3 > 0"))).where("page_id % 3 = 0").collect()
    right = sum((r.score >= 0.5) == (r.label == 1) for r in found)
    assert len(found) == 200 and right >= 190


def test_url_filter_without_labelled_urls(spark):
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS + [None])], "page_id long, url string, host string")
    got = url_filter.judge_urls(pages, []).collect()
    assert len(got) == len(URLS) + 1 and {(r.verdict, r.score, r.rule) for r in got} == {("allow", None, None)}
    got = url_filter.judge_urls(pages, [("block", "net", "/")]).collect()
    assert {r.verdict for r in got} == {"block"}
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_url_query(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    got = url_filter.op12_url_filter(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = plain_rule(pages[r.page_id], url_filter.RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


EXTRA = [
    "named_struct('inner', map('k', doc_id), 'odd-name', 1, 'a b', 'x', 'c,d', array(named_struct('e', 2))) as nested", "map('k', 1) as `m-p`", "array(map(1, 2)) as `a b`",
    "timestamp'2020-01-01' as t", "cast(1.5 as decimal(9, 2)) as `dotted.name`", "binary('x') as b", "cast(null as struct<x:int>) as none",
]


@pytest.mark.parametrize("text", ["text", "Text"])
def test_stages_take_any_extra_column(spark, sf, text):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    docs = docs.union(docs.where("doc_id < 5")).selectExpr("doc_id", f"text as `{text}`", "lang", "source", "n_chars", *EXTRA)
    rows = common.saved(docs, "test-extra")
    for name, stage in p.STAGES[:-1]:
        kept = common.saved(stage(spark, rows, sf), f"test-extra-{name}")
        assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString()
        assert 0 < kept.count() <= rows.count()
        rows = kept
    assert p.STAGES[-1][1](spark, rows, sf).count() >= rows.count()


def test_rows_that_differ_in_a_map_alone_are_chosen_alike(spark, sf):
    import corpus_pipeline as p

    made = "the same text here " * 20
    rows = [(1, made, {"a": k}) for k in range(6)]
    found = {str(dict(p.STAGES)["simhash_near_dedup"](spark, spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, m map<string,int>"), sf).collect()) for k in (0, 2, 5)}
    assert len(found) == 1
