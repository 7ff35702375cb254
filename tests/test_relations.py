"""Versioned vocabularies, evidence of literals, ledgers against files."""

import hashlib
import platform
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from carvelake.operators import evaluate, evidence, final_records, integrity, verdict, vocabularies
from carvelake.plans import queries
from carvelake.scratch import saved
from test_engine import EXAMPLES, RESOLVED, args, call, text_op

CHANGE = "vocabulary string, name string, qualification string, rank int, require array<string>, min_rules int, category string, subcategory string, drop boolean"


def change(name, drop=False, category=None, vocabulary="callable", qualification="standalone"):
    return (vocabulary, name, qualification, 0, None, None, category, None, drop)


def test_versions_against_plain_history(spark):
    """Random changes over ten versions: as of any version, the table says what a plain replay says."""
    rng = random.Random(7)
    table = spark.createDataFrame([], vocabularies.SCHEMA)
    now, history = {}, {}
    for version in range(10):
        changes = [change(n, rng.random() < 0.3, rng.choice("XYZ")) for n in rng.sample("abcdefgh", rng.randint(0, 5))]
        table = vocabularies.amended(table, spark.createDataFrame(changes, CHANGE), version)
        for _, name, *_, category, _, drop in changes:
            if drop:
                now.pop(name, None)
            else:
                now[name] = category
        history[version] = dict(now)
    for version, said in history.items():
        assert {r.name: r.category for r in vocabularies.as_of(table, version).collect()} == said
    rows = [(k, n, v) for k, (n, v) in enumerate((n, v) for n in [*"abcdefghz", None] for v in [*range(10), None])]
    asked = spark.createDataFrame(rows, "id int, n string, version long")
    for most in (0, 1000):
        vocabularies.BROADCAST_ROWS = most
        got = {r.id: r.said and r.said.category for r in vocabularies.as_of_join(asked, table, "callable", "n", "version", "said").collect()}
        assert got == {k: history[v].get(n) if v is not None else None for k, n, v in rows}
    vocabularies.BROADCAST_ROWS = 100_000
    with pytest.raises(ValueError, match="after version"):
        vocabularies.amended(table, spark.createDataFrame([change(n) for n in "abcdefgh"], CHANGE), 1)


def test_own_vocabularies_judge_as_the_constants_do(spark):
    streams = {k: d for k, (d, _) in EXAMPLES.items() if d[:1] == b"\x80"} | {"exit": call("sys", "exit", args(text_op("x"))), "resolved": RESOLVED}
    rows = spark.createDataFrame([(k, bytearray(d), 3) for k, d in streams.items()], "blob_id string, content binary, version long")
    own = saved(vocabularies.own_vocabularies(spark), "own")
    key = lambda r: (r.blob_id, r.call_seq, r.canonical, r.verdict, r.track, str(r.acts), r.demotion)
    plain = sorted(map(key, verdict.scan_blobs(rows.drop("version")).collect()), key=str)
    assert sorted(map(key, verdict.scan_as_of(rows, own).collect()), key=str) == plain and plain


def test_changes_from_a_file(spark, tmp_path):
    (tmp_path / "changes.json").write_text('{"vocabulary": "denylist", "name": "models.Layer", "qualification": "indicator", "rank": 0}\n{"vocabulary": "denylist", "name": "os.system", "drop": true}\n')
    table = vocabularies.amended(vocabularies.own_vocabularies(spark), vocabularies.read_changes(spark, str(tmp_path / "changes.json")), 4)
    names = lambda v: {r.name for r in vocabularies.as_of(table, v).where("vocabulary = 'denylist'").collect()}
    assert names(4) ^ names(3) == {"models.Layer", "os.system"} and "models.Layer" in names(9)


def test_evidence_against_plain_code(spark):
    rng = random.Random(3)
    rules = [*vocabularies.RULE_TIERS[0][1], "PY_ASSIGN_RE", "PY_LAMBDA_RE"]
    plain_tags = ["has_url", "has_path_traversal", "entropy>=5.0 (5.20)", "entropy>9 (x)", "literal_truncated(9)", "unknown", "has_python_code", "pickle_magic"]
    hits = []
    for k in range(80):
        tag = lambda: f"has_python_code({','.join(rng.sample(rules, rng.randint(1, 5)))})" if rng.random() < 0.6 else rng.choice(plain_tags)
        own = [(rng.choice(["T1", "T1", "T2"]), [tag() for _ in range(rng.randint(0, 3))]) for _ in range(rng.randint(0, 3))]
        hits.append((f"b{k}", k % 2, [rng.choice(plain_tags) for _ in range(rng.randint(0, 2))] or None, own))
    table = saved(vocabularies.own_vocabularies(spark), "own")
    said = {r.name: (r.qualification, r.category, r.subcategory) for r in table.where("vocabulary = 'literal'").collect()}

    def plain(reasons, own):
        best = None
        for kind, tags in own:
            for t in tags:
                fired = set(t[len("has_python_code(") : -1].split(",")) if t.startswith("has_python_code(") else set()
                if kind == "T1" and fired:
                    rank = next((n for n, (_, need, least, *_) in enumerate(vocabularies.RULE_TIERS) if set(need) <= fired and len(fired) >= least), None)
                    if rank is not None and (best is None or rank < best[0]):
                        best = (rank, sorted(fired))
        out = [("has_python_code", *vocabularies.RULE_TIERS[best[0]][3:], tuple(best[1]))] if best else []
        bases = {t.split("(")[0].strip() for t in [*(reasons or []), *(t for _, tags in own for t in tags)]} - {o[0] for o in out}
        for b in bases:
            if b in said:
                out.append((b, *said[b], ()))
            elif b.startswith("entropy>"):
                out.append((b, "combination_required", None, None, ()))
        return out

    want = sorted([(b, c, *e) for b, c, reasons, own in hits for e in plain(reasons, own)], key=str)
    rows = spark.createDataFrame(hits, "blob_id string, call_seq int, reasons array<string>, args array<struct<type:string,tags:array<string>>>")
    got = [(r.blob_id, r.call_seq, r.tag, r.qualification, r.category, r.subcategory, tuple(r.rules_fired)) for r in evidence.literal_evidence(rows, table).collect()]
    assert sorted(got, key=str) == want


def test_evidence_is_one_hash_aggregate_over_meanings(spark):
    """Of two rows of a hit the best tier counts once; an argument without tags takes none from the others; only meanings are shuffled, once."""
    code = lambda n: f"has_python_code({','.join([*vocabularies.RULE_TIERS[0][1], 'PY_ASSIGN_RE'][:n])})"
    hits = [("a", 0, None, [("T1", None), ("T1", ["has_url", None, code(3)])]), ("a", 0, ["has_url", None], [("T2", [code(4)]), ("T1", [code(4), "has_path_traversal"])]), ("b", 0, ["unknown"], None), (None, 1, [code(4)], [])]
    rows = spark.createDataFrame(hits, "blob_id string, call_seq int, reasons array<string>, args array<struct<type:string,tags:array<string>>>")
    found = evidence.literal_evidence(rows, saved(vocabularies.own_vocabularies(spark), "own"))
    got = {(r.blob_id, r.call_seq, r.tag, r.qualification, len(r.rules_fired)) for r in found.collect()}
    assert got == {("a", 0, "has_python_code", "standalone", 4), ("a", 0, "has_url", "combination_required", 0), ("a", 0, "has_path_traversal", "standalone", 0), (None, 1, "has_python_code", "combination_required", 0)}
    plan = found._jdf.queryExecution().executedPlan().toString().rpartition("== Initial Plan ==")[2]
    assert plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan and "SortMergeJoin" not in plan


def test_labels_within_rows_are_those_of_joined_streams(spark):
    """Random files with repeated, missing and null digests, chains and classes: the label of each row is what a join of all streams says."""
    rng = random.Random(5)
    some = lambda make, most=6: [make() for _ in range(rng.randint(0, most))]
    digest = lambda: rng.choice(["a", "b", "c", None])
    names = [f"f{k}" for k in range(400)]
    own = {n: rng.sample(["", "zip", "tar", "npz>gz", "x>gz", "odd", None], rng.choice([1, 1, 3])) for n in names}
    traces = [(n, rng.choice([None, *[some(lambda n=n: rng.choice([None, *[(digest(), rng.choice(own[n]))] * 9]))] * 9]), rng.choice([None, ["a", None], ["b", "c"]]), None) for n in names]
    measured = [(n, rng.choice([None, 0, 1, 2, 9]), rng.choice([None, *[some(lambda: rng.choice([None, *[(digest(), rng.choice(["Opaque", "opaque", "OPAQUE", "Serialization", None]), True)] * 9]))] * 9])) for n in names if rng.random() < 0.8]
    ledger = spark.createDataFrame([(n, "T", rng.choice(["1;2", "1", "2", None])) for n in names], "sample_id string, label string, used_in_RQ string")
    traces = spark.createDataFrame(traces, "sample_id string, oracle array<struct<sha: string, chain: string>>, ps_hit array<string>, ms_hit array<string>")
    measured = spark.createDataFrame(measured, "sample_id string, n_found int, streams array<struct<sha: string, final_cls: string, found: boolean>>")
    streams = final_records.stream_records(final_records.traced(ledger, traces, 1), measured).withColumn("final_cls", F.initcap("final_cls"))
    said = {r.sample_id: r.chain_label for r in evaluate.chain_label(streams, "sample_id", "chain", "final_cls").collect()}
    got = final_records.reach_records(ledger, traces, measured).collect()
    assert {r.sample_id: r.chain_label for r in got} == {r.sample_id: said.get(r.sample_id, "No stream") for r in got}
    assert {"Mixed", "No stream", "Opaque", "Serialization", "Streaming→opaque", "Container→Streaming", "Container"} <= {r.chain_label for r in got} and len({r.sample_id for r in got}) == len(got)


def test_reach_records_shuffles_each_table_once(spark, sf):
    """Orders and lines go by their file's name once each; the lines' second use reads the same exchange."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        plan = queries.QUERIES["reach_records"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    lines = plan.split("\n")
    assert sum("Exchange hashpartitioning" in x and "ReusedExchange" not in x for x in lines) == 2
    assert sum("ReusedExchange" in x for x in lines) == 1


def test_ledger_in_two_phases(spark, tmp_path):
    (tmp_path / "in" / "sub dir").mkdir(parents=True)
    files = {"a.bin": b"a" * 10, "sub dir/b.bin": b"b" * 20, "c.bin": b"c", "extra.bin": b"e", "empty": b""}
    for n, d in files.items():
        (tmp_path / "in" / n).write_bytes(d)
    sha = lambda d: hashlib.sha256(d).hexdigest()
    ledger = [(1, "a.bin", sha(b"a" * 10).upper(), 10), (2, "sub dir/b.bin", sha(b"x"), 20), (3, "c.bin", sha(b"c"), 2), (4, "gone.bin", None, None), (5, "a.bin", None, None), (6, "empty", sha(b""), 0)]
    rows = spark.createDataFrame(ledger, "sample_id long, path string, sha256 string, size_bytes long")
    listed = integrity.listing(spark, str(tmp_path / "in"))
    want = {(1, "a.bin", "ok"), (2, "sub dir/b.bin", "digest"), (3, "c.bin", "size"), (4, "gone.bin", "missing"), (5, "a.bin", "ok"), (6, "empty", "ok"), (None, "extra.bin", "extra")}
    assert {tuple(r) for r in integrity.verified(rows, listed).collect()} == want
    quick = {tuple(r) for r in integrity.verified(rows, listed, quick=True).collect()}
    assert quick == {(k, n, "ok" if s == "digest" else s) for k, n, s in want}
    plan = integrity.compared(rows, listed)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_a_second_run_measures_changed_files_only(spark, tmp_path):
    from carvelake.operators import remeasure

    root, store = tmp_path / "in", str(tmp_path / "store")
    root.mkdir()
    for k in range(30):
        (root / f"f{k}").write_bytes(bytes([k]) * (k + 1))
    asked = []

    def measure(files):
        asked.append({r.path.rsplit("/", 1)[1] for r in files.collect()})
        return files.select("path", F.col("length").alias("bytes"))

    def state():
        return {r.path.rsplit("/", 1)[1]: (r.run, r.bytes) for r in remeasure.remeasure(spark, str(root), store, measure, 8).collect()}

    assert state() == {f"f{k}": (1, k + 1) for k in range(30)} and asked[-1] == {f"f{k}" for k in range(30)}
    n = len(asked)
    assert state() == {f"f{k}": (1, k + 1) for k in range(30)} and len(asked) == n  # nothing changed, nothing measured or written
    (root / "f3").write_bytes(b"other")
    (root / "f4").write_bytes(bytes([4]) * 5)  # the same contents at another time
    (root / "f5").unlink()
    (root / "g").write_bytes(b"new")
    want = {f"f{k}": (1, k + 1) for k in range(30) if k not in (3, 5)} | {"f3": (2, 5), "g": (2, 3)}
    assert state() == want and asked[-1] == {"f3", "g"}
    assert state() == want and len(asked) == n + 1
    for k in range(30):
        (root / f"f{k}").unlink(missing_ok=True)
    assert set(state()) == {"g"}
    whole = {r.path: r.bytes for r in remeasure.remeasure(spark, str(root), str(tmp_path / "other"), measure, 8).collect()}
    assert list(whole.values()) == [3]


def test_scans_are_measured(spark, tmp_path):
    from carvelake.operators import remeasure

    (tmp_path / "in").mkdir()
    for name in ("command", "path", "plain", "gzip"):
        (tmp_path / "in" / name).write_bytes(EXAMPLES[name][0])
    found = {r.path.rsplit("/", 1)[1]: (r.verdict, r.run) for r in remeasure.remeasure(spark, str(tmp_path / "in"), str(tmp_path / "store")).collect()}
    assert found == {n: (EXAMPLES[n][1], 1) for n in ("command", "path", "plain", "gzip")}


def test_compaction_against_plain_code(spark):
    from pyspark.sql import Observation

    from carvelake.operators import compaction

    rng = random.Random(5)
    texts = ["short", "y" * 40, None, "\x80\x04" + "z" * 60, "cos\nsystem\n(tR. \n", "\x78\x9c" + "q" * 50, "é" * 33, "漢" * 40]
    leaves = [(f"b{h}", 0, k, rng.choice(["text", "bytes"]), rng.choice(["T1", "T1", "T1", "T2", None]), rng.random() < 0.1, rng.random() < 0.1, rng.choice(texts), h % 3 == 0) for h in range(12) for k in range(rng.randint(0, 20))]
    rows = spark.createDataFrame(leaves, "blob_id string, call_seq int, leaf int, kind string, type string, flagged boolean, nested boolean, value string, low boolean")

    def nested(v):
        try:
            raw = (v or "").encode("latin-1")
        except UnicodeEncodeError:
            return False
        return (raw[:1] == b"\x80" and len(raw) > 1 and raw[1] <= 5) or raw[:2] in (b"\x78\x9c", b"\x78\x01", b"\x78\xda") or (raw[:1] in (b"c", b"(") and raw.rstrip()[-1:] == b".")

    want, counts, sampled, left = [], dict.fromkeys(("meta_values_truncated", "meta_entries_omitted", "nested_kept", "chars_dropped"), 0), {}, {}
    for b, c, k, kind, t, flag, nest, v, low in leaves:
        essential = flag or nest or t not in (None, "", "T1")
        if not essential:
            sampled[b] = sampled.get(b, 0) + 1
        if not essential and (low or sampled[b] > 3):
            counts["meta_entries_omitted"] += 1
            counts["chars_dropped"] += len(v or "")
            left.setdefault(b, []).append((kind, t))
        elif nested(v):
            counts["nested_kept"] += 1
            want.append((b, k, v, None))
        elif v is not None and len(v) > 32:
            counts["meta_values_truncated"] += 1
            counts["chars_dropped"] += len(v) - 32
            want.append((b, k, v[:32], len(v)))
        else:
            want.append((b, k, v, None))
    seen = Observation("leaves")
    got = [(r.blob_id, r.leaf, r.value, r.value_len) for r in compaction.compact_leaves(rows, 32, 3, seen).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and seen.get == counts
    for r in compaction.omission_summary(rows, 3).collect():
        own = left.pop(r.blob_id)
        assert (r.omitted, r.total - r.kept) == (len(own), len(own)) and r.omitted_by_kind == {k: [x for x, _ in own].count(k) for k in {x for x, _ in own}}
        assert (r.omitted_by_type or {}) == {t: [x for _, x in own].count(t) for t in {x for _, x in own} if t}
    assert not left
    assert compaction.compact_leaves(rows, 0).count() == len(leaves)


def test_grouped_reads_against_plain_code(spark):
    from pyspark.sql import Observation

    from carvelake.operators import compaction

    rng = random.Random(8)
    reads = [(f"b{h}", 0, k, 100 + k, rng.randint(0, 3 if h else 10**6), rng.choice(["x", None]), None) for h in range(5) for k in range([90, 64, 63, 200, 1][h])]
    want = []
    for b in {r[0] for r in reads}:
        own = [r for r in reads if r[0] == b]
        groups = {}
        for r in own:
            groups.setdefault(r[4:7], []).append(r)
        if len(own) >= 64 and len(groups) < len(own):
            want += [(b, g[0][2], *key, len(g), [r[3] for r in g[:8]], True) for key, g in groups.items()]
        else:
            want += [(b, r[2], *r[4:7], 1, [r[3]], False) for r in own]
    seen = Observation("reads")
    rows = spark.createDataFrame(reads, "blob_id string, call_seq int, nth int, get_idx int, defined_at int, kind string, callable string")
    got = [(r.blob_id, r.nth, r.defined_at, r.kind, r.callable, r.refs, r.get_idx_sample, r.grouped) for r in compaction.grouped_reads(rows, observation=seen).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and seen.get == {"memo_origins_grouped": len(reads) - len(want)}


def test_a_content_is_judged_once_over_restarts(spark, tmp_path):
    """Three runs of the same stream: copies of what was seen pass no more, also under other names, and a large file doesn't end it."""
    from carvelake.streaming.watch import watch

    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        watch(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ck"), most_bytes=100_000).awaitTermination(240)
        return sorted((r.path.rsplit("/", 1)[1], r.verdict) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (folder / "a.pkl").write_bytes(EXAMPLES["command"][0])
    (folder / "b.pkl").write_bytes(EXAMPLES["plain"][0])
    (folder / "b2.pkl").write_bytes(EXAMPLES["plain"][0])
    first = [("a.pkl", "Unsafe"), ("b.pkl", "No issue")]
    assert run() == first
    (folder / "copy of a.pkl").write_bytes(EXAMPLES["command"][0])
    (folder / "large.bin").write_bytes(b"\x01" * 200_000 + EXAMPLES["command"][0])
    assert run() == sorted([*first, ("large.bin", "Unsafe")])
    (folder / "c.pkl").write_bytes(EXAMPLES["plain"][0])
    assert run() == sorted([*first, ("large.bin", "Unsafe")])


def test_a_carving_worker_gives_memory_back():
    """Blocks freed between small ones that stay: as after many files of all sizes. In a process of its own, after large blocks were freed, which makes glibc keep later ones."""
    code = r"""
import re
import pyarrow as pa
from carvelake.operators import carve, machine

class Rows:
    select = lambda self, *columns: self
    mapInArrow = lambda self, run, schema: run

batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([b"x"])], ["artifact_id", "content"])
for run in (carve.carve(Rows()), machine.pickle_ops(Rows())):
    list(run(iter([batch])))
for k in range(8):
    bytearray(4 << k << 20 if k < 3 else 16 << 20)
held = lambda: sum(map(int, re.findall(r"Pss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) // 1024
before, blocks, small = held(), [], []
for _ in range(100):
    blocks.append(b"x" * (1 << 20))
    small += [bytes(600) for _ in range(50)]
blocks.clear()
print(held() - before)
"""
    if not (sys.platform == "linux" and platform.libc_ver()[0] == "glibc"):
        pytest.skip("another C library")
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[1])
    assert int(found.stdout) < 25
