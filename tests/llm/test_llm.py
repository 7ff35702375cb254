import base64
import glob
import hashlib
import os
import sys
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from carvelake.llm import bpe, chat, html_text, knn, media, packing, quality, registry, sharding, similar, simhash, suffix_dedup, webp  # noqa: E402
from carvelake.llm.common import saved  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, print long, cell int, bucket long, n long, length long, crc long, x array<double>, shard int, at long, _id long, row int"
REST = (0.5, 1, 2, 3, 4, 5, 6, [1.0], 7, 8, 9, 10)
LINE = "the quick brown fox jumps over the lazy dog and runs away from all the noise of the town"
LONG = " ".join(f"word{k * 7919 % 1009}" for k in range(60_000))
TEXTS = [None, "", "a", "Ünï çödé 漢字 🎉 <|endoftext|>", LONG, "x" * 5000, LINE * 5, LINE * 5 + " end", "  two  spaces\n\n\tand tabs ", "IN!! CAPS!! ###", "\x00\x1c\x85 odd"]


def documents(spark, empty=False):
    rows = [(k, t, "en", "s", len(t or ""), *REST) for k, t in enumerate(TEXTS)]
    rows += [(6, LINE * 5, "en", "s", 1, *REST), (None, "no id", None, None, None, *REST), (None, None, None, None, None, *REST)]
    return spark.createDataFrame([] if empty else rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return saved(documents(spark), "test-docs")


@pytest.fixture(scope="module")
def none(spark):
    return saved(documents(spark, True), "test-none")


def texts_of(df):
    return [r.text for r in df.select("text").collect()]


def test_suffix_dedup_against_brute_force(docs, none):
    rows = docs.select("doc_id", "text").collect()
    want = sorted(suffix_dedup.brute_force([r.text for r in rows]))
    got = suffix_dedup.remove_repeats(docs).collect()
    assert sorted((r._n_bytes, r._n_removed, r._n_spans, r._kept_sha256) for r in got) == want
    assert sorted(str(r._in1) for r in got) == sorted(str(r.text) for r in rows)
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.cut_repeats(docs).columns == docs.columns


def test_suffix_dedup_on_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], suffix_dedup.brute_force([r.text for r in rows])))
    got = suffix_dedup.op2_suffix_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_suffix_dedup_over_many_buckets(spark, sf, monkeypatch):
    """Equal suffixes lie in several buckets, which are compared at their edges."""
    monkeypatch.setattr(suffix_dedup, "PER_BUCKET", 700)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    got = {r._in0: (r._n_bytes, r._n_removed, r._n_spans, r._kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == dict(zip([r.doc_id for r in rows], suffix_dedup.brute_force([r.text for r in rows])))


def test_multikey_sort():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 3, 500) for _ in range(4)]
    order = suffix_dedup.multikey_quicksort(keys, 8)
    assert [tuple(k[i] for k in keys) for i in order] == sorted(zip(*keys))


def test_bpe_equals_tiktoken(docs, none):
    coder = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode_documents(docs)
    assert sorted(r.ids for r in encoded.collect()) == sorted(theirs.encode_ordinary(t or "") for t in texts_of(docs))
    assert sorted(bytes(r.data) for r in bpe.decode_documents(encoded).collect()) == sorted((t or "").encode() for t in texts_of(docs))
    assert coder.vocabulary.one_by_one(b"hello") == theirs.encode_ordinary("hello")
    assert bpe.encode_documents(none).count() == 0


def test_bpe_numbers_distinct_chunks_only(monkeypatch):
    """Texts of all white space the pattern knows, empty ones and repeats in one batch, with a cache that turns over; Python sees each chunk once."""
    monkeypatch.setattr(bpe, "CACHE", 50)
    coder = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    every = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    assert pc.match_substring_regex(pa.array(every), bpe.SPACE).to_pylist() == [bool(regex.match(r"\s", x)) for x in every]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    parts = [*"ab  \n\t.,'1é漢\u0301\x1c\x85\u3000\0", "'s", " the", " Word.\nNext", "<|endoftext|>", "  ", " it's"]
    rng = np.random.default_rng(5)
    for _ in range(60):
        texts = [None if n == 0 else "".join(parts[k] for k in rng.integers(0, len(parts), n - 1)) for n in rng.integers(0, 40, rng.integers(1, 30))]
        want = [theirs.encode_ordinary(t or "") for t in texts]
        ids, edges = coder.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == want
        run = bpe._encoded("byte_bpe_50k.tiktoken", False)(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])]))
        rows = [r for b in run for r in b.to_pylist()]
        assert [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows] == [(len(w), hashlib.sha256(" ".join(map(str, w)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for w, t in zip(want, texts)]
    seen = []
    coder.find = lambda c, find=coder.find: (seen.append(len(c)), find(c))[1]
    coder.encode(pa.array(["of words that many texts repeat"] * 10_000))
    assert sum(seen) < 100


def test_packing(docs, none):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = saved(packing.pack_documents(docs), "test-packed")
    rows = pieces.collect()
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.MAX_TOKENS
    want = sorted(zlib.crc32(np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for t in texts_of(docs) if t != LONG)
    assert sorted(r.ids_crc32 for r in rows if r.doc_id != 4) == want
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 4)
    assert all(n == packing.MAX_TOKENS for _, _, n in long[1:]) and [s for _, s, _ in long] == [0, *np.cumsum([n for _, _, n in long])[:-1].tolist()]
    assert packing.sequences(docs, pieces).count() == len(by_sequence)
    assert packing.pack_documents(none).count() == 0


def test_token_ids_equal_the_library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts = [*"ab  \n\t.,'1é漢\u0301\x1c\x85\u3000", "'s", "<|endoftext|>", " <|", "word ", "  \n", " " * packing.LONG_SPACE]
    rng = np.random.default_rng(3)
    for n in rng.integers(0, 30, 1500):
        text = "".join(parts[k] for k in rng.integers(0, len(parts) - (n % 50 != 0), n))
        assert packing.token_ids(text).tolist() == own.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "x" * 1_000_000, "\u3000" * 1_000_000 + "a"], ids=["spaces", "line feeds", "letters", "wide spaces"])
def test_token_ids_of_a_million_like_characters(text):
    token = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).vocabulary.token
    began = time.time()
    ids = packing.token_ids(text)
    assert time.time() - began < 10 and b"".join(map(token.__getitem__, ids.tolist())) == text.encode()


def test_packing_is_close_to_the_least_number_of_sequences(spark, monkeypatch):
    """Against plain best fit of all pieces in one list, longest first, and the bound that no packing beats."""
    lengths = np.random.default_rng(5).integers(1, 1500, 3000).tolist()
    pieces = saved(spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long"), "test-pieces")
    monkeypatch.setattr(packing, "PER_TASK", 500)
    rows = packing.pack(pieces).collect()
    fill: dict[int, int] = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert sorted(r.doc_id for r in rows) == list(range(3000)) and max(fill.values()) <= 2048
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = min((b for b in bins if b >= n), default=None)
        if fit is not None:
            bins.remove(fit)
        bins.append((2048 if fit is None else fit) - n)
    assert -(-sum(lengths) // 2048) <= len(fill) <= 1.03 * len(bins) + 1


def test_best_fit_closes_the_fullest():
    p = packing.BestFit(10, 2)
    assert [p.put(n) for n in (6, 7, 3, 4, 9)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]
    # two bins open with 4 and 3 free; the third bin closes the one with 3, so the next item of 3 goes to the one with 4
    p = packing.BestFit(10, 2)
    assert [p.put(n)[0] for n in (6, 7, 8, 3)] == [0, 1, 2, 0]


def test_top_k_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = sorted(tuple(r) for r in knn.op5_exact_top_k(spark, sf).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(con.sql(registry.SQL["op5_exact_top_k"]).fetchall())


def test_top_k_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (100, [1e9, -1e9]), (7, [float("inf"), 0.0]), (8, []), (1, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in knn.top_k(v, v.where("vec_id % 100 = 0"), k=3, shard=2, leaf=1).collect()}
    assert [got[0, k][0] for k in (1, 2, 3)] == [1, 1, 2]
    assert (100, 3) in got and got[100, 3][0] in (0, 1)
    assert knn.top_k(v.limit(0), v.limit(0)).count() == 0


def test_quality(spark, sf, docs, none):
    sf = sf.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in quality.op6_quality_classifier(spark, sf).collect()}
    held = [(rows[r.doc_id].predicted, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in rows.items())
    got = quality.score_documents(docs, labels.limit(0)).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.5}
    assert quality.score_documents(none, labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_chat_folds_events(spark):
    rows = [(1, 0, "start", "user", None, None), (1, 1, "delta", "user", "Hel", None), (1, 2, "delta", "user", "lo", None), (1, 3, "message", "assistant", "no", None),
            (1, 4, "regenerate", "assistant", None, None), (1, 5, "delta", "assistant", "yes", None), (1, 6, "edit", None, "Hi", 0), (1, 7, "edit", None, "?", 9), (None, None, None, None, None, None)]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, seq long, kind string, role string, text string, target int")).collect()}
    assert chat.parse(got[1].formatted) == [("user", "Hi"), ("assistant", "yes")]
    assert got[None].formatted == ""
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, seq long, kind string, role string, text string, target int")).count() == 0


def test_chat_template_is_reversible():
    hard = ["", "\\", "###", "####", "</turn>", "\\### Assistant: </turn> ok", " </turn>\n### user: ", "a: b\n\\\\###", "\\</turn>"]
    turns = [(r, t) for r in ("user", "assistant", "a: b\n", "\\###") for t in hard]
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_chat_long_turns():
    for text in ("x" * 10_000_000, "\\" * 2_000_000, "</turn> " * 500_000, "a: " * 1_000_000):
        began = time.time()
        assert chat.parse(chat.render([("user", text), ("assistant", text)])[0]) == [("user", text), ("assistant", text)]
        assert time.time() - began < 10
    for broken in ("### user: hi", "### user hi </turn>\n", "hi", "### a: b </turn>\n#"):
        with pytest.raises(ValueError):
            chat.parse(broken)


def test_chat_random_logs_against_plain_replay(spark):
    rng = np.random.default_rng(4)
    kinds, words = ["message", "start", "delta", "edit", "regenerate", "other"], ["", "a", "###", "\\", "</turn>\n", "b: "]
    rows = [(int(c), k, kinds[rng.integers(6)], ["user", "assistant"][rng.integers(2)], words[rng.integers(6)], int(rng.integers(-1, 4)), 0.5) for c in range(30) for k in range(rng.integers(1, 25))]
    want = {}
    for conv, _, kind, role, text, target, _ in rows:
        said = want.setdefault(conv, [])
        if kind in ("message", "start", "regenerate") or (kind == "delta" and not said):
            if kind == "regenerate" and said and said[-1][0] == role:
                del said[-1]
            said.append([role, ""])
        if kind in ("message", "delta"):
            said[-1][1] += text
        if kind == "edit" and 0 <= target < len(said):
            said[target][1] = text
    shuffled = [rows[k] for k in rng.permutation(len(rows))]
    events = spark.createDataFrame(shuffled, "conv_id long, seq long, kind string, role string, text string, target int, formatted double")
    got = {r.conv_id: [list(t) for t in chat.parse(r.formatted)] for r in chat.format_conversations(events).collect()}
    assert got == want


def test_chat_repeated_turns_and_clashing_names(spark):
    long = "so " * 4000
    rows = [(1, 0, "user", "q", "x"), (1, 1, "assistant", long, "x"), (1, 1, "assistant", long, "y"), (1, 1, "assistant", None, "z"), (1, None, None, "first", "z"), (None, 0, "assistant", "alone", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_conversations(chat.turn_events(table, 100)).collect()}
    assert got == {1: [("", "first"), ("user", "q"), ("assistant", ""), ("assistant", long), ("assistant", long)], None: [("assistant", "alone")]} or got[1][1][0] == "user"
    assert [t for r, t in got[1] if r == "assistant"] == ["", long, long]


@pytest.mark.parametrize("name", ["op1_html_extraction", "op7_chat_formatting"])
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, sf).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_simhash_against_brute_force(docs, none, spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in simhash.op8_simhash_near_dedup(spark, sf).collect()) == sorted(simhash.brute_force(rows))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert {r.component_id for r in got if r["print"] == 0} == {0}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id is None for r in kept.collect()).count(True) <= 1
    assert simhash.near_duplicates(none).count() == 0


def test_unrelated_texts_without_an_id_or_under_one_id_stay(spark):
    texts = [" ".join(f"{name}{k * k}" for k in range(80)) for name in ("ash", "birch", "cedar", "oak")]
    rows = [(None, t) for t in texts[:3]] + [(None, texts[0]), (5, texts[3]), (5, texts[2] + " end"), (5, "short other text")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.text for r in kept.collect() if r.doc_id is None) == texts[:2]
    assert sorted(r.text for r in kept.collect() if r.doc_id == 5) == sorted([texts[3], texts[2] + " end", "short other text"])


def test_near_dedup_stage_reaches_similarity(spark, sf, docs, none):
    import corpus_pipeline as p

    stage = dict(p.STAGES)["simhash_near_dedup"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    words = [f"w{k * k}" for k in range(400)]
    # four words replaced: 20 of 396 shingles
    rows += [(1000 + k, " ".join(f"new{j}" if j % 50 == 5 and j // 50 < 4 * k else w for j, w in enumerate(words))) for k in range(2)]
    rows += [(2000, " ".join(words[:200])), (2001, None), (2002, ""), (2003, " \n"), (None, "two words"), (None, "other words")]
    whole = similar_by_force(rows)
    assert whole[1001] == 1000 and whole[2000] == 2000 and whole[2002] == 2001
    got = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert {r.doc_id for r in got if r.doc_id is not None} == {d for d, c in whole.items() if d == c} and sum(r.doc_id is None for r in got) == 2
    assert stage(spark, none, sf).count() == 0 and stage(spark, docs, sf).columns == docs.columns


def test_near_dedup_stage_links_by_fingerprints(spark, sf):
    """Texts within 3 bits whose five-word sets are not similar: SimHash counts repeats, the sets don't."""
    import corpus_pipeline as p

    rows = [(k, "one two three " * 400 + " ".join(f"{name}{j * j}" for j in range(12))) for k, name in enumerate(("ash", "birch"))] + [(7, "an unrelated text of a few words")]
    assert len(set(similar_by_force(rows).values())) == 3
    assert [c for _, _, c in simhash.brute_force(rows)] == [0, 0, 7]
    got = dict(p.STAGES)["simhash_near_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(r.doc_id for r in got.collect()) == [0, 7]


def similar_by_force(rows):
    sets = []
    for _, text in rows:
        parts = (text or "").lower().split()
        sets.append({tuple(parts[k : k + 5]) for k in range(max(len(parts) - 4, 1))} if parts else set())
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    groups_ = joined(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if near(sets[i], sets[j])])
    return {rows[k][0]: min(rows[x][0] for x in g) for g in groups_ for k in g if rows[k][0] is not None}


def test_near_dedup_of_a_chain_in_small_cells(spark, monkeypatch):
    """Neighbours are similar, the ends are not: links are found in cells, and hubs with many partners are verified in parts."""
    monkeypatch.setattr(similar, "CELL", 4)
    monkeypatch.setattr(similar, "AT_ONCE", 3)
    words = [f"w{k * 7919 % 100_003}" for k in range(700)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 200])) for k in range(60)] + [(100 + k, " ".join(f"x{k}y{j}" for j in range(50))) for k in range(20)]
    found = similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups_of: dict[int, set[int]] = {}
    for r in found:
        groups_of.setdefault(r.root, set()).add(r.doc_id)
    assert sorted(map(sorted, groups_of.values())) == [list(range(60)), *([100 + k] for k in range(20))]


def test_every_five_positions_contain_a_block():
    from itertools import combinations

    assert all(any(set(b) <= set(five) for b in simhash.BLOCKS) for five in combinations(range(8), 5))


def test_long_lists_are_split_into_cells(spark):
    base = 0x0123456789ABCDEF
    values = [base ^ (k << 40) for k in range(200)]
    prints = spark.createDataFrame([(v,) for v in values], "print long")
    whole = {frozenset(x) for x in groups(values, 3)}
    for cell in (8, 512):
        pairs = [(r.u, r.v) for r in simhash.links(prints, cell=cell).collect()]
        assert {frozenset(x) for x in joined(values, pairs)} == whole


def groups(values, apart):
    return joined(values, [(a, b) for a in values for b in values if (a ^ b).bit_count() <= apart])


def joined(values, pairs):
    root = {v: v for v in values}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[top(a)] = top(b)
    out = {}
    for v in values:
        out.setdefault(top(v), []).append(v)
    return out.values()


def test_components(spark):
    from carvelake.llm.components import components

    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 200: 100}


@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (3,), (0, 1), (1, 2, 0), (3, 0)])
def test_webp_tools(transforms):
    rng = np.random.default_rng(3)
    for h, w in ((1, 1), (7, 5), (20, 33)):
        image = rng.choice(rng.integers(0, 1 << 32, 12, dtype=np.uint64).astype(np.uint32), (h, w))
        for cache in (0, 4):
            for tile in (0, 2):
                assert (webp.decode(webp.encode(image, transforms, cache, True, tile)) == image).all()


def test_webp_refuses_damage():
    data = webp.encode_grey(np.arange(192, dtype=np.uint8).reshape(1, 192))
    for cut in (0, 10, 25, len(data) // 2):
        with pytest.raises(webp.WebPError):
            webp.decode(data[:cut])


def test_media_against_a_plain_decoder(docs):
    """Stored files read by a second decoder; sizes, digests and features by plain Python."""
    sys.path.insert(0, os.path.dirname(__file__))
    import plain_webp

    rows = docs.where("doc_id is null or doc_id <> 4").select("doc_id", "text")
    media_of = media.store_documents(rows)
    want = []
    for r in media_of.collect():
        found, at = [], 0
        while at < len(r.media):
            size = int.from_bytes(r.media[at + 4 : at + 8], "little") + 8
            found += [p for row in plain_webp.decode(bytes(r.media[at : at + size])) for p in row]
            at += size
        payload = bytes(p & 255 for p in found)
        assert all(p == 0xFF000000 | (p & 255) * 0x010101 for p in found) and len(payload) % 192 == 0 and not payload[r.n_bytes :].strip(b" ")
        n, mean = len(payload), sum(payload) // len(payload)
        spread = (n * sum(b * b for b in payload) - sum(payload) ** 2) // n**2
        bins = [sum(1 for b in payload if b >> 4 == k) for k in range(16)]
        text = f"192x{n // 192};mean={1000 * sum(payload) // n};var={spread};hist={','.join(map(str, bins))}"
        assert mean == 1000 * sum(payload) // n // 1000
        want.append((payload[: r.n_bytes], n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(r.media), hashlib.sha256(r.media).hexdigest(), text))
    assert sorted(w[0] for w in want) == sorted((r.text or "").encode() for r in rows.collect())
    got = [tuple(r)[2:] for r in media.read_media(media_of).collect()]
    assert sorted(got) == sorted(w[1:] for w in want)


def test_media_tools_are_used():
    """Back-references and palettes shorten the files that they suit."""
    prose = np.frombuffer((LINE * 40).encode()[: 192 * 18], np.uint8).reshape(-1, 192)
    two = np.frombuffer(b"ab" * 960, np.uint8).reshape(-1, 192)
    digits = np.random.default_rng(1).integers(48, 58, (40, 192)).astype(np.uint8)
    for image, most in ((prose, 800), (two, 120), (digits, 40 * 192 * 0.5)):
        data = webp.encode_grey(image)
        assert len(data) < most and (media.samples(webp.decode(data)) == image).all()


def test_media_copies_of_all_lengths_and_distances():
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 50):
        image = rng.integers(0, 256, (n, 192)).astype(np.uint8)
        for _ in range(20):
            flat = image.ravel()
            a, m = rng.integers(0, flat.size), rng.integers(1, 200)
            b = rng.integers(0, flat.size)
            part = flat[a : a + m].copy()[: flat.size - b]
            flat[b : b + len(part)] = part
        assert (media.samples(webp.decode(webp.encode_grey(image))) == image).all()
    long = np.tile(rng.integers(0, 256, 7000).astype(np.uint8), 200)[: 192 * 7000].reshape(-1, 192)
    assert (media.samples(webp.decode(webp.encode_grey(long))) == long).all()


def test_media_round_trip(docs, none):
    stored = media.store_documents(docs)
    payloads = sorted(media.payload_of(t)[0] for t in texts_of(docs))
    assert sorted(media.samples(media.pixels(bytes(r.media))).tobytes() for r in stored.collect()) == payloads
    got = media.read_media(stored).collect()
    assert all(r.payload_bytes % 192 == 0 and r.payload_bytes >= max(r.n_bytes, 192) for r in got)
    assert media.store_documents(none).count() == 0


def test_hilbert_walk(spark):
    rows = [(x, y, z) for x in range(8) for y in range(8) for z in range(8)]
    df = sharding.with_curve(spark.createDataFrame(rows, "x int, y int, z int"), [F.col("x"), F.col("y"), F.col("z")], 3)
    walk = [(r.x, r.y, r.z) for r in df.orderBy("cell").collect()]
    assert sorted(r.cell for r in df.collect()) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(walk, walk[1:]))


def test_sharding(spark, sf, docs, none):
    for df, n in ((sharding.shard_documents(docs), docs.count()), (sharding.op10_hilbert_sharding(spark, sf), None)):
        rows = df.collect()
        sizes = {}
        for r in rows:
            sizes.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in sizes.values()) and set(sizes) <= set(range(24))
        counts = [len(sizes.get(k, [])) for k in range(24)]
        assert max(counts) - min(counts) <= 1 and (n is None or sum(counts) == n)
    assert sharding.shard_documents(none).count() == 0
    plan = sharding.op10_hilbert_sharding(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sharding_values_and_ties(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.size, r.text_crc32) for r in sharding.op10_hilbert_sharding(spark, sf).collect()}
    assert got == {r.doc_id: (len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows}
    same = spark.createDataFrame([(1, "a", "en", "s", 9, 9)] * 1000 + [(None, None, None, None, 9, 9)] * 30, "doc_id long, text string, lang string, source string, slot int, cell int")
    found = sharding.shard_documents(same, 7).collect()
    assert sorted((r.shard, r.slot) for r in found) == [(s, k) for s in range(7) for k in range((s + 1) * 1030 // 7 + ((s + 1) * 1030 % 7 > 0) - (s * 1030 // 7 + (s * 1030 % 7 > 0)))]


def test_sharding_follows_the_curve(spark, sf):
    """Against plain Python: cells from the splitters, positions by sorting along the curve."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = sharding.shard_documents(docs).withColumn("_l", sharding.leading(F.col("lang"))).withColumn("_s", sharding.leading(F.col("source")))
    dims = ["size", "_l", "_s"]
    found = saved(found, "test-shards")
    rows = sharding.with_curve(found, sharding.cells_of(found, dims, sharding.BITS), sharding.BITS).collect()
    assert [r.cell for r in sorted(rows, key=lambda r: (r.shard, r.slot))] == sorted(r.cell for r in rows)
    orders = [(a.lang, b.lang, a._l, b._l) for a, b in zip(rows, rows[1:])]
    assert all((x < y) <= (m <= n) for x, y, m, n in orders)


def test_sharding_lets_readers_skip(spark, sf, tmp_path):
    found = saved(sharding.shard_documents(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")), "test-skip")
    ranges = sharding.shard_ranges(found, ["lang", "source", "size"]).collect()
    assert sum(r.n_rows for r in ranges) == found.count()
    read = lambda keep: sum(r.n_rows for r in ranges if keep(r)) / found.count()
    for value, n in ((r.lang, r["count"]) for r in found.groupBy("lang").count().collect()):
        assert read(lambda r: r.least_lang <= value <= r.greatest_lang) < 0.5 + n / found.count()
    assert read(lambda r: r.greatest_size > 20_000) < 0.75
    sharding.write_shards(found, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == found.count() and len(glob.glob(str(tmp_path / "shards/*/*.parquet"))) == 24


PAGE = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div>
<div id="main-content"><h2>Title &lt;x&gt;</h2><p>First   para
with <a href="#">a link</a> &amp; more text.<p>Second para is here.</p><ul><li>one<li>two</ul><div class="ad-slot">Buy</div><p>Short.</p><form><label>Name</label></form></div>
<aside>Side</aside><script>var t = "</p>";</script><section id="comments"><p>Nice post!</p></section><footer>(c)</footer></body></html>"""


def test_html(spark):
    want = "Title <x>\nFirst para with a link & more text.\nSecond para is here.\none\ntwo\nShort."
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(PAGE.replace('<div id="main-content">', "<article>").replace("</form></div>", "</form></article>")) == want
    odd = ["", None, "plain text only", "<p>unclosed", "<article></article>", "<script>never ends", "a < b & c", "<p>x" * 2000]
    rows = spark.createDataFrame([(k, None, h, 1) for k, h in enumerate(odd)] + [(None, "u", "<p>y</p>", 2)], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in html_text.extract(rows).collect()}
    assert got[0] == got[1] == got[4] == got[5] == "" and got[2] == "plain text only" and got[3] == "unclosed" and got[6] == "a < b & c" and got[7].count("\n") == 1999
    assert html_text.runs([0, 0, 5, 0, 7, 0, 0, 0, 0, 3]) == [(2, 5, True), (9, 10, True)]


def brute_runs(lengths, window):
    """Plain sums of each window; a line is in a run unless ``window`` zeros in a row, or an end, part it from others."""
    sums = [sum(lengths[k : k + window]) for k in range(len(lengths))]
    least = html_text.SURGE * sum(s * s for s in sums) / max(sum(sums), 1)
    found, k = [], 0
    while k < len(lengths):
        if lengths[k]:
            b = k + 1
            while any(lengths[b : b + window]):
                b += 1
            found.append((k, b, any(s >= least for s in sums[k:b])))
            k = b
        else:
            k += 1
    return found


def test_html_windows_against_plain_sums():
    rng = np.random.default_rng(2)
    for n in range(60):
        lengths = (rng.integers(0, 2, n) * rng.integers(0, 2, n) * rng.integers(1, 400, n)).tolist()
        for window in (2, 3, 5):
            assert html_text.runs(lengths, window) == brute_runs(lengths, window), (lengths, window)


def test_html_windows_decide():
    """Without an article element and without any mark: what the windows bridge stays, and runs without a surge go."""
    story = "".join(f"<p>Paragraph {k} of the story, which is long enough to be one.</p>" for k in range(3))
    link = "<p><a href=/x>See this other page</a></p>"
    page = lambda between: f"<body><div><p>Home</p><p>Contact</p></div><div><p><a href=/>All</a></p></div>{link * 3}<div>{story}{between}{story}</div>{link * 3}<div><p>Terms</p></div></body>"
    told = "\n".join(f"Paragraph {k} of the story, which is long enough to be one." for k in range(3))
    assert html_text.main_text(page(link)) == f"{told}\nSee this other page\n{told}"
    assert html_text.main_text(page(link * 3)) == f"{told}\n{told}"
    assert "Home" not in html_text.main_text(page("")) and "Terms" not in html_text.main_text(page(""))


HARD = {
    "unclosed tags": ("<p>a</p>" + "<a " * 100_000, "a"),
    "open quotes": ("<p>a</p>" + '<a "' * 100_000, "a"),
    "quotes around all ends": ('<p>a</p>' + '<a ">")' * 50_000, None),
    "mismatched ends": ("<span>" * 100_000 + "</b>" * 100_000 + "a", "a"),
    "deep blocks with text": ("<div>x" * 30_000, None),
    "deep marked elements": ('<span class="ad">' * 30_000 + "<div>b</div>" * 30_000, None),
    "titles without end": ("<title>" * 50_000 + "<p>a</p>", "a"),
    "blocks in deep inline elements": ("<i>" * 50_000 + "<p>a" * 50_000, None),
    "less-than signs": ("< " * 200_000, None),
    "ten megabytes of text": ("<p>" + "word " * 2_000_000, None),
}


@pytest.mark.parametrize("case", HARD)
def test_html_hard_pages_take_linear_time(case):
    html, want = HARD[case]
    began = time.time()
    got = html_text.main_text(html)
    assert time.time() - began < 10 and (want is None or got == want)


STORY = "".join(f"<p>Paragraph {k} of the story, which is long enough to be one.</p>" for k in range(6))
TOLD = "\n".join(f"Paragraph {k} of the story, which is long enough to be one." for k in range(6))


@pytest.mark.parametrize("around", ['<div class="layout has-sidebar">', '<div id="page" class="share-enabled">', "<form action=/x>", '<div class="sidebar-layout">', '<div class="newsletter">'])
def test_html_marked_ancestors(around):
    tag = around[1:].split()[0].rstrip(">")
    rest = '<div class="cookie-notice">We use cookies</div><div id="comments"><article class="comment">So nice a post!</article></div>'
    assert html_text.main_text(f"<body>{around}<article>{STORY}</article></{tag}>{rest}</body>") == TOLD
    if "newsletter" not in around:
        assert html_text.main_text(f"<body>{around}<div>{STORY}</div></{tag}>{rest}</body>") == TOLD
    assert html_text.main_text(f'<article><h2 class="legal">A law</h2>{STORY}<p class="notice">Note this.</p></article>') == f"A law\n{TOLD}\nNote this."
    assert html_text.main_text(f'<article>{STORY}</article><div class="related"><article>Other story</article></div>') == TOLD


def test_html_keeps_all_of_the_container():
    links = "".join(f'<li><a href="/{k}">Related story {k}</a></li>' for k in range(4))
    advert = '<div class="ad"><p>Buy</p><p>this</p><p>now</p></div>'
    for between in (f"<ul>{links}</ul>", advert):
        assert html_text.main_text(f"<body><div><a href=/>Home</a></div><div id=story>{STORY}{between}<p>The end.</p></div></body>") == f"{TOLD}\nThe end."
    assert html_text.main_text(f'<body><div id=story>{STORY}</div><div><ul>{links}</ul><article><p>A teaser.</p></article></div></body>') == TOLD


def test_html_inline_parts_go():
    got = html_text.main_text
    assert got('<p>One <span class="ad">Buy</span> two.</p>') == "One two."
    assert got("<article><p>Read<button>Share <b>it</b></button> on.</p><p>More <label>x<a href=/>y</a></label></p></article>") == "Read on.\nMore"
    assert got('<p>One <span class="ad">Buy <i>now</p><p>Two.</p>') == "One\nTwo."
    assert got('<div>One <span class="ad">Buy <div>now</div> here</span> two.</div>') == "One\ntwo."
    assert got('<p>A <span class="ad">b<span class="promo">c</span>d</span> e <a class="share" href="/">f</a>g</p>') == "A e g"


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = saved(p.quality_classifier(spark, docs, sf), "test-p1")
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns and np.mean([(d in kept) == bool(q) for d, q in labels.items()]) > 0.9
    one = saved(p.simhash_near_dedup(spark, good, sf), "test-p2")
    classes = {d: c for d, _, c in simhash.brute_force([(r.doc_id, r.text) for r in good.collect()])}
    assert {r.doc_id for r in one.collect()} == {d for d, c in classes.items() if d == c} and one.columns == docs.columns
    cut = saved(p.suffix_dedup(spark, one, sf), "test-p3")
    rows = sorted((r.doc_id, r.text) for r in one.collect())
    removed = [b[1] for b in suffix_dedup.brute_force([t for _, t in rows])]
    assert [len(t.encode()) <= len(o.encode()) - n for (_, t), (_, o), n in zip(sorted((r.doc_id, r.text) for r in cut.collect()), rows, removed)] == [True] * len(rows)
    packed = p.best_fit_packing(spark, cut, sf)
    assert {r.doc_id for r in packed.collect()} == {d for d, _ in rows}


def test_quality_against_plain_formulas(spark, sf):
    """Scores by the textbook densities of the two classes, from the same features."""
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    x = {r.doc_id: np.array(quality.features(r.text)) for r in docs}
    known = [d for d in labels if zlib.crc32(str(d).encode()) % 3 != 1 and d in x and labels[d] in (0, 1)]
    classes = [np.array([x[d] for d in known if labels[d] == c]) for c in (0, 1)]
    pooled = sum(len(c) * c.var(axis=0) for c in classes) / len(known)
    covs = [(1 - quality.SHRINK) * np.cov(c.T, bias=True) + np.diag(quality.SHRINK * pooled + quality.LEAST_STD**2) for c in classes]

    def density(v, c):
        off = v - classes[c].mean(axis=0)
        return np.log(len(classes[c])) - 0.5 * (off @ np.linalg.solve(covs[c], off) + np.linalg.slogdet(covs[c])[1])

    got = {r.doc_id: r for r in quality.op6_quality_classifier(spark, sf).collect()}
    assert set(got) == set(x)
    for d, r in got.items():
        assert r.score == pytest.approx(1 / (1 + np.exp(np.clip(density(x[d], 0) - density(x[d], 1), -500, 500))), abs=1e-6)
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5)


def test_quality_without_labels_or_with_contradicting_ones(spark):
    docs = spark.createDataFrame([(k, f"some text number {k} of a few", 0.1) for k in range(8)] + [(None, None, 0.2)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_documents(docs, none).collect()} == {0.5}
    assert quality.keep_good(docs, none).count() == 9
    both = spark.createDataFrame([(k, c) for k in range(8) for c in (0, 1)], "doc_id long, quality int")
    assert {round(r.score, 9) for r in quality.score_documents(docs, both).collect()} == {0.5}


def test_pipeline_on_odd_rows(spark, sf, docs, none):
    """Nulls, empty and long texts, ties, repeated rows and clashing names go through all stages; an empty table stays empty."""
    import corpus_pipeline as p

    rows = docs
    for name, stage in p.STAGES[:-1]:
        rows = saved(stage(spark, rows, sf), f"test-{name}")
        assert rows.columns == docs.columns
    pieces = p.STAGES[-1][1](spark, rows, sf).collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, len(packing.token_ids(r.text)) + 1) for r in rows.collect())
    total: dict[tuple, int] = {}
    for r in pieces:
        total[r.doc_id is None, r.doc_id or 0] = total.get((r.doc_id is None, r.doc_id or 0), 0) + r.length
    expected: dict[tuple, int] = {}
    for a, b, n in want:
        expected[a, b] = expected.get((a, b), 0) + n
    assert total == expected
    for _, stage in p.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_top_k_over_many_regions_and_clashing_names(spark):
    """Regions, shards of equal vectors and queries that are not among the vectors, against plain products."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 5))
    data = [(k, (centres[k % 6] + 0.1 * rng.normal(size=5)).tolist(), 0, 0) for k in range(400)] + [(1000 + k, [1.0] * 5, 0, 0) for k in range(150)]
    v = spark.createDataFrame(data, "vec_id long, embedding array<double>, shard int, region int")
    asked = [(5000 + k, rng.normal(size=5).tolist()) for k in range(20)] + [(1001, [1.0] * 5)]
    q = spark.createDataFrame(asked, "vec_id long, embedding array<double>")
    got: dict[int, list] = {}
    for r in knn.top_k(v, q, k=7, shard=32, leaf=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    grid = {i: np.floor(1024 * np.array(e)).astype(int) for i, e, *_ in data}
    for i, e in asked:
        own = np.floor(1024 * np.array(e)).astype(int)
        best = sorted((-int(own @ w), j) for j, w in grid.items() if j != i)[:7]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
