"""From call sites to verdicts, as relational steps.

call sites -> literals -> signals of distinct literals -> hits (an ordered pass within each stream) -> canonical names,
types, roles, indicators, behaviour rules -> Unsafe / Review / Low. Signals are computed once for each distinct literal,
joined back by digest. Vocabularies are constants of the plan. The only grouped Python step picks hits within one
stream, over sorted partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from carvelake.functions import fixed_values as V
from carvelake.functions.scalars import base_tag, rule_ids
from carvelake.functions.signals import ENTROPY, bytes_tags, suspicious, with_signals
from carvelake.scratch import saved

from .behaviour import with_behaviours
from .carve import NOT_SCANNED
from .machine import opcodes, protocol_of, scan_calls
from .vocabularies import as_of_join
from .vocabulary import CODE_POSITIONS, NAME_POSITIONS, alias_names, canonical, gateways, use_aliases

# Parameters of type recovery.
TAU, N_MIN, PRINTABLE_CEIL, SIGMA, N_WEAK, PRINTABLE_WEAK = 0.90, 3, 0.75, 8, 24, 0.80
_BANDS = ((8, range(0x3B, 0x44)), (4, range(0x37, 0x48)), (2, range(0x37, 0x48)))
_MAGIC = (b"We love Marisa.", b"\x78\x9c", b"\x78\x01", b"\x78\xda", b"\x1f\x8b", b"PK\x03\x04", b"\x89PNG")
TIER_RULES = ["PY_CALL_SYNTAX_RE", "PY_CODE_STRING_RE", "PY_INNER_STRING_RE"]
PATH_TAGS = ["has_path", "has_windows_path"]
BORDERLINE = 5.5
PREVIEW = 200
_PRINTABLE = bytes([*range(0x20, 0x7F), 9, 10, 13])
ACT = "array<struct<category:string,subcategory:string,evidence:string>>"


def recover_type(data: bytes, tagged: bool = False) -> str:
    """T1 text, T2 numeric buffer, T3 structured, T4 opaque."""
    if not data:
        return "T1"
    if tagged or data.startswith(_MAGIC) or (data[0] == 0x80 and len(data) > 1 and data[1] <= 5) or (data[:1] in (b"c", b"(") and data.rstrip()[-1:] == b"."):
        return "T3"
    printable = (len(data) - len(data.translate(None, _PRINTABLE))) / len(data)
    if printable < PRINTABLE_CEIL:
        raw = np.frombuffer(data, np.uint8)
        for width, band in _BANDS:
            col = raw[width - 1 :: width] & 0x7F
            if len(col) >= N_MIN and ((col >= band[0]) & (col <= band[-1])).mean() >= TAU:
                return "T2"
        for width in (8, 4):
            cols = [raw[j::width] for j in range(width // 2, width)]
            n = sum(map(len, cols))
            if n >= N_MIN and sum(int(((c == 0) | (c == 0xFF)).sum()) for c in cols) / n >= TAU:
                return "T2"
        for width in (8, 4, 2):
            col = raw[width - 1 :: width] & 0x7F
            if len(col) >= N_WEAK and np.count_nonzero(np.bincount(col, minlength=128)) <= SIGMA:
                return "T2"
    return "T1" if printable >= PRINTABLE_WEAK else "T4"


def nested_callables(data: bytes) -> tuple[int, list[str]]:
    """Protocol and callables that a pickle inside a literal refers to."""
    recent, out = [], []
    for _, _, op, arg in opcodes(data):
        if op in ("SHORT_BINUNICODE", "BINUNICODE", "UNICODE") and isinstance(arg, str):
            recent = [*recent, arg][-2:]
        elif op == "GLOBAL" and isinstance(arg, str) and len(parts := arg.split()) >= 2:
            out.append(f"{parts[0]}.{parts[1]}")
        elif op == "STACK_GLOBAL" and len(recent) == 2:
            out.append(".".join(recent))
            recent = []
    return protocol_of(data), out


def _types(data: pd.Series, tagged: pd.Series) -> pd.Series:
    return pd.Series([recover_type(d or b"", bool(t)) for d, t in zip(data, tagged)], dtype=object)


def _nested(data: pd.Series) -> pd.Series:
    return pd.Series([",".join(nested_callables(d)[1]) if d is not None and len(d) else "" for d in data], dtype=object)


def canonical_name(module: Column, name: Column, protocol: Column) -> Column:
    """Canonical dotted names, by the driver's table of aliases."""
    aliases = alias_names()

    def names(module: pd.Series, name: pd.Series, protocol: pd.Series) -> pd.Series:
        use_aliases(aliases)
        return pd.Series([canonical(m or "", n or "", p)[0] for m, n, p in zip(module, name, protocol)], dtype=object)

    return F.pandas_udf(names, StringType())(module, name, protocol)


def literal_table(calls: DataFrame) -> DataFrame:
    """One row for each leaf literal of each call, with its bytes and digest."""
    rows = calls.select("blob_id", "call_seq", F.posexplode("literals").alias("leaf", "l")).select("blob_id", "call_seq", "leaf", "l.*")
    data = F.coalesce(F.col("bin"), F.encode("text", "UTF-8"))
    return rows.withColumn("sha", F.concat("kind", F.lit(":"), F.sha2(data, 256)))


def literal_signals(literals: DataFrame, threshold: float = ENTROPY) -> DataFrame:
    """Tags, entropy, type and nested callables of each distinct literal. threshold: entropy from which a text is tagged as dense."""
    distinct = literals.groupBy("sha").agg(F.first("kind").alias("kind"), F.first("text").alias("text"), F.first("bin").alias("bin"))
    latin = F.when(F.col("text").rlike(r"^[\x00-\xff]*$"), F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    # types come before tags: a Python function above the tags would have Spark write all patterns into its arguments
    text = _typed(distinct.where("kind = 'text'").select("sha", "text", latin.alias("data")), F.lit(False)).select("sha", "text", "type", "nested")
    text = with_signals(text, "text", threshold).select("sha", F.lit(None).cast("string").alias("shown"), "tags", "entropy", "type", "nested")
    tags = bytes_tags(F.col("bin"))
    shown = F.concat(F.lit("[BINBYTES:"), F.lower(F.hex(F.substring("bin", 1, 16))), F.lit(" len="), F.octet_length("bin").cast("string"), F.lit(" fmt="), F.array_join(tags, ","), F.lit("]"))
    data = distinct.where("kind = 'bytes'").select("sha", shown.alias("shown"), tags.alias("tags"), F.lit(0.0).alias("entropy"), F.col("bin").alias("data"))
    data = _typed(data, F.exists("tags", lambda t: t.isin("zlib_magic", "pickle_magic", "pickle_magic_p0"))).drop("data")
    return text.unionByName(data).withColumn("flagged", suspicious(F.col("tags")))


def _typed(rows: DataFrame, magic: Column) -> DataFrame:
    """``rows`` with type and nested (the callables of a pickle) of their data."""
    rows = rows.withColumn("type", F.pandas_udf(_types, StringType())("data", magic))
    pickled = (F.col("type") == "T3") & (F.hex(F.substring("data", 1, 1)).isin("80", "63", "28"))
    return rows.withColumn("nested", F.filter(F.split(F.pandas_udf(_nested, StringType())(F.when(pickled, F.col("data"))), ","), lambda x: x != ""))


_HITS = pa.schema([("blob_id", pa.string()), ("call_seq", pa.int32()), ("track", pa.string()), ("forced", pa.bool_()), ("placeholder", pa.bool_()), ("leaf", pa.int32())])
_HITS_DDL = "blob_id string, call_seq int, track string, forced boolean, placeholder boolean, leaf int"
_SEEN = ["blob_id", "call_seq", "invoke_op", "qualname", "denied", "is_resolver", "slice_start", "slice_end", "any_text", "flagged_text", "any_bytes", "flagged_bytes"]


class Chooser:
    """Picks the hits of a stream from its calls in order: each claims its range of opcodes unless it is a placeholder or a resolver.

    Calls come by rising ends, so a range is free if it begins behind the last claimed end, and rows of one end come together: nothing else of a stream is held.
    """

    def __init__(self) -> None:
        self.claimed, self.end = -1, -1
        self.held: list[tuple] = []

    def flush(self) -> list[tuple]:
        """The rows of the last end: a placeholder stands only where nothing else does, and once."""
        real = [r for r in self.held if not r[4]]
        out, self.held = real or self.held[:1], []
        return out

    def call(self, blob, seq, op, qualname, denied, resolver, a, b, any_text, flagged_text, any_bytes, flagged_bytes) -> list[tuple]:
        done = self.flush() if b != self.end else []
        self.end = b
        if op.startswith("EXT"):
            if a > self.claimed:
                self.claimed = b
                self.held.append((blob, seq, "unresolvable", False, False, None))
            return done
        text = any_text if denied else flagged_text
        if (denied or text is not None) and a > self.claimed:
            if text is not None and not resolver:
                self.claimed = b
            self.held.append((blob, seq, "forced_callable" if denied else "content", denied, text is None, text))
        forced = qualname in _BYTES_DENYLIST
        data = any_bytes if forced else flagged_bytes
        if data is not None and a > self.claimed:
            self.claimed = b
            self.held.append((blob, seq, "bytes", forced, False, data))
        return done


_BYTES_DENYLIST = frozenset(V.BYTES_DENYLIST)


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams come one after another, their calls in order (`_SEEN`)."""
    blob, chooser = None, Chooser()
    for batch in chain(batches, [None]):
        out = chooser.flush() if batch is None else []
        for row in zip(*(c.to_pylist() for c in batch.columns)) if batch is not None else ():
            if row[0] != blob:
                out += chooser.flush()
                blob, chooser = row[0], Chooser()
            out += chooser.call(*row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _HITS)], schema=_HITS)


def _lookup(key: Column, rows: list[tuple], fields: tuple[str, str]) -> Column:
    """Category and subcategory of a constant vocabulary, or null."""
    table = F.create_map(*[x for n, _, c, s in rows for x in (F.lit(n), F.struct(F.lit(c).alias(fields[0]), F.lit(s).alias(fields[1])))])
    return F.try_element_at(table, key)


def gateway_label(name: Column) -> Column:
    out = F.struct(F.lit("Code Execution").alias("category"), F.lit("Known Dangerous Callable").alias("subcategory"))
    for pattern, category, subcategory in reversed(V.GATEWAY_NAMING):
        out = F.when(name.rlike(pattern), F.struct(F.lit(category).alias("category"), F.lit(subcategory).alias("subcategory"))).otherwise(out)
    return out


def dangerous_name(value: Column) -> Column:
    """The dangerous name a literal holds: itself, its last component, or the first that it contains."""
    names = [n for n in V.DANGEROUS_NAMES]
    last = F.substring_index(value, ".", -1)
    inside = F.coalesce(*[F.when(value.contains(n), F.lit(n)) for n in sorted(names)])
    return F.when(value.isin(names), value).when(last.isin(names), last).otherwise(inside)


def _act(label: Column, evidence: str) -> Column:
    return F.struct(label["category"].alias("category"), label["subcategory"].alias("subcategory"), F.lit(evidence).alias("evidence"))


def _present(acts: list[Column]) -> Column:
    return F.filter(F.array(*acts), lambda a: a.isNotNull()).cast(ACT)


def hits(calls: DataFrame, threshold: float = ENTROPY) -> DataFrame:
    """Hits with the call's columns and its leaves (with tags, types and nested callables).

    Leaves stay rows until the hits are chosen: of each call only the places of its first text and bytes leaves, flagged or not, go through the choice, and only leaves of hits are gathered.
    """
    at = ["blob_id", "call_seq"]
    literals = literal_table(calls)
    known = literals.select(*at, "leaf", "arg_pos", "kind", "opcode_idx", "origin_idx", "sha").join(literal_signals(literals, threshold), "sha")
    known = saved(known, "known-leaves")
    text, flagged = F.col("kind") == "text", F.col("flagged")
    # a text is chosen by its opcode, then by its place; both in one number, so that the aggregate is a hash one
    place = F.shiftleft(F.col("opcode_idx").cast("long"), 32) + F.col("leaf")
    first = lambda which, value, name: F.min(F.when(which, value)).alias(name)
    facts = known.groupBy(*at).agg(first(text, place, "t"), first(text & flagged, place, "ft"), first(F.col("kind") == "bytes", F.col("leaf"), "any_bytes"), first((F.col("kind") == "bytes") & flagged, F.col("leaf"), "flagged_bytes"))
    low = lambda c: F.col(c).bitwiseAND(F.lit(2**32 - 1)).cast("int")
    facts = facts.select(*at, low("t").alias("any_text"), low("ft").alias("flagged_text"), "any_bytes", "flagged_bytes")
    seen = calls.drop("literals").join(facts, at, "left").select(*_SEEN)
    picked = saved(seen.repartition("blob_id").sortWithinPartitions(*at).mapInArrow(_hits, _HITS_DDL), "picked")
    mine = picked.select(*at).distinct()
    leaf = F.struct("leaf", "arg_pos", "kind", "opcode_idx", "origin_idx", "text", "shown", "tags", "entropy", "type", "nested", "flagged")
    leaves = known.join(mine, at).join(literals.select(*at, "leaf", "text"), [*at, "leaf"]).groupBy(*at).agg(F.array_sort(F.collect_list(leaf)).alias("leaves"))
    found = picked.withColumnRenamed("leaf", "_leaf").join(calls.drop("literals"), at).join(leaves, at, "left")
    own = F.get(F.filter("leaves", lambda x: x["leaf"] == F.col("_leaf")), F.lit(0))
    reasons = F.when(F.col("track") == "unresolvable", F.array(F.lit("unresolvable_extension"))).when(F.col("placeholder"), F.array(F.lit("no_argument_literal"))).otherwise(F.col("_own.tags"))
    primary = F.coalesce("_own.opcode_idx", F.when(F.col("placeholder"), F.col("callable_idx")).otherwise(F.col("slice_end")))
    shown = F.when(F.col("track") == "bytes", "").otherwise(F.coalesce("_own.text", F.lit("")))
    found = found.withColumn("_own", own).withColumns({"primary": primary, "reasons": reasons, "text": shown, "entropy": F.coalesce("_own.entropy", F.lit(0.0))})
    return found.drop("_own", "_leaf")


def with_denied(calls: DataFrame, table: DataFrame) -> DataFrame:
    """``calls`` with a column version, denied by the table of vocabularies as of that version rather than by the library's own list."""
    names = calls.withColumn("_canonical", canonical_name(F.coalesce("module", F.lit("")), F.col("name"), F.lit(0)))
    found = as_of_join(as_of_join(names, table, "denylist", "_canonical", "version", "_one"), table, "denylist", "qualname", "version", "_two")
    listed = F.coalesce(F.col("_one.qualification").isin("gateway", "indicator"), F.lit(False)) | F.coalesce(F.col("_two.qualification").isin("gateway", "indicator"), F.lit(False))
    return found.withColumn("denied", listed).drop("_canonical", "_one", "_two")


def judged(found: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Verdict columns of the hits: canonical, verdict, rank, acts, grounds, demotion.

    With a table of vocabularies, callables mean what it says as of the hits' own version; without one, what the library's own lists say.
    """
    h = found.withColumn("canonical", canonical_name(F.coalesce("module", F.lit("")), F.col("name"), F.col("protocol")))
    # a constant table of some thirty rows
    places = [(name, CODE_POSITIONS.get(name, []), NAME_POSITIONS.get(name, [])) for name in sorted(CODE_POSITIONS.keys() | NAME_POSITIONS.keys())]
    h = h.join(F.broadcast(found.sparkSession.createDataFrame(places, "canonical string, code_at array<int>, names_at array<int>")), "canonical", "left")
    code, names = (F.coalesce(c, F.array().cast("array<int>")) for c in ("code_at", "names_at"))

    def with_role(x: Column) -> Column:
        named = F.array_contains(F.col("name_role_idx"), x["opcode_idx"]) | F.array_contains(F.col("name_role_idx"), x["origin_idx"])
        role = F.when(named, "R2").when(F.array_contains(code, x["arg_pos"]), "R3").when(F.array_contains(names, x["arg_pos"]), "R2").otherwise("R1")
        return F.struct(x["kind"].alias("kind"), x["text"].alias("text"), x["shown"].alias("shown"), x["tags"].alias("tags"), x["type"].alias("type"), x["nested"].alias("nested"), x["flagged"].alias("flagged"), role.alias("role"))

    none = "array<struct<kind:string,text:string,shown:string,tags:array<string>,type:string,nested:array<string>,flagged:boolean,role:string>>"
    h = h.withColumn("args", F.coalesce(F.transform("leaves", with_role), F.array().cast(none)))
    h = saved(h.drop("leaves", "code_at", "names_at"), "hits")  # the expressions below read args often, and would each build it anew
    h = h.withColumn("all_tags", F.array_distinct(F.concat("reasons", F.flatten(F.transform("args", lambda a: a["tags"])))))
    h = h.withColumn("tags", F.array_distinct(F.transform("all_tags", base_tag)))
    said = F.filter("args", lambda a: a["type"] != "T2")
    h = h.withColumn("rule_text", F.concat_ws(" ", "canonical", F.array_join(F.transform(said, lambda a: F.coalesce(a["text"], a["shown"], F.lit(""))), " "), F.concat(F.lit("[TAGS: "), F.array_join("all_tags", " "), F.lit("]"))))
    h = with_behaviours(h, "rule_text")
    fields = ("category", "subcategory")
    if table is None:
        gate = F.col("canonical").isin(*sorted(gateways())) | F.col("qualname").isin(*sorted(gateways()))
        standalone, combination = _lookup(F.col("canonical"), V.CALLABLE_STANDALONE, fields), _lookup(F.col("canonical"), V.CALLABLE_COMBINATION, fields)
    else:
        h = as_of_join(h, table, "callable", "canonical", "version", "_said")
        h = as_of_join(as_of_join(h, table, "denylist", "canonical", "version", "_one"), table, "denylist", "qualname", "version", "_two")
        gate = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"{c}.qualification").isin("gateway", "bytes_gateway"), F.lit(False)) for c in ("_one", "_two")])
        said = F.struct(F.col("_said.category").alias("category"), F.col("_said.subcategory").alias("subcategory"))
        standalone, combination = (F.when(F.col("_said.qualification") == q, said) for q in ("standalone", "combination_required"))
    h = h.withColumn("q_call", F.coalesce(standalone, F.when(combination.isNull() & gate, gateway_label(F.col("canonical"))))).withColumn("c_call", F.when(standalone.isNull(), combination))
    ids = F.flatten(F.transform(F.filter("all_tags", lambda t: t.startswith("has_python_code(")), rule_ids))
    first_ids = F.transform(F.filter("args", lambda a: (a["type"] == "T1") & F.exists(a["tags"], lambda t: t.startswith("has_python_code("))), lambda a: F.flatten(F.transform(F.filter(a["tags"], lambda t: t.startswith("has_python_code(")), rule_ids)))
    tier = F.exists(first_ids, lambda r: (F.size(F.array_intersect(r, F.array(*[F.lit(x) for x in TIER_RULES]))) == 3) & (F.size(r) >= 4))
    h = h.withColumn("py_tier", tier).withColumn("py_ids", ids)
    q_lit = [F.when(F.array_contains("tags", tag), _act(F.struct(F.lit(c).alias("category"), F.lit(s).alias("subcategory")), f"literal: {tag}")) for tag, _, c, s in V.LITERAL_STANDALONE]
    q_lit += [F.when(F.col("py_tier"), _act(F.struct(F.lit("Code Execution").alias("category"), F.lit("Embedded Python Source").alias("subcategory")), "literal: has_python_code"))]
    h = h.withColumn("q_lit", _present(q_lit))
    h = h.withColumn("q_name", F.filter(F.transform(F.filter("args", lambda a: (a["role"] == "R2") & a["text"].isNotNull()), lambda a: dangerous_name(F.trim(a["text"]))), lambda n: n.isNotNull()))
    impossible = F.exists("args", lambda a: ((a["role"] == "R2") & a["type"].isin("T2", "T3", "T4")) | ((a["role"] == "R3") & (a["type"] == "T2")))
    nested = F.flatten(F.transform("args", lambda a: a["nested"]))
    label = lambda c, s: F.struct(F.lit(c).alias("category"), F.lit(s).alias("subcategory"))
    c_label = F.struct(F.coalesce(F.col("c_call.category"), F.lit("Code Execution")).alias("category"), F.coalesce(F.col("c_call.subcategory"), F.lit("Name Indirection Gadget")).alias("subcategory"))
    acts = F.concat(
        _present([F.when(F.col("q_call").isNotNull(), _act(F.col("q_call"), "callable"))]),
        F.col("q_lit"),
        _present([
            F.when(F.col("c_call").isNotNull() & (F.size("q_name") > 0), _act(c_label, "callable with a dangerous name")),
            F.when(F.col("c_call.subcategory").isNotNull() & (F.size("q_lit") > 0), _act(c_label, "callable with a qualified literal")),
            F.when(impossible, _act(label("Code Execution", "Type-Role Violation"), "a literal that is no text in a name or code position")),
            F.when(F.size(nested) > 0, _act(label("Code Execution", "Nested Pickle Execution"), "a nested pickle refers to callables")),
        ]),
        F.transform(F.filter("fired", lambda r: r["tier"] == "standalone"), lambda r: F.struct(r["category"].alias("category"), r["subcategory"].alias("subcategory"), r["rule"].alias("evidence"))),
    )
    h = h.withColumn("acts", acts)
    labels = F.transform(F.filter("fired", lambda r: r["tier"] == "labeling"), lambda r: F.struct(r["category"].alias("category"), r["subcategory"].alias("subcategory"), r["rule"].alias("evidence")))
    h = h.withColumn("acts", F.when(F.size("acts") > 0, F.concat("acts", labels)).otherwise(F.col("acts")))
    once = F.filter("acts", lambda a, k: ~F.exists(F.slice(F.col("acts"), F.lit(1), k), lambda b: (b["category"] == a["category"]) & (b["subcategory"] == a["subcategory"])))
    h = h.withColumn("acts", once)
    flagged = F.filter("args", lambda a: a["flagged"])
    informative = F.filter("tags", lambda t: ~t.isin(*V.LITERAL_DISQUALIFIED))
    path = lambda t: t.isin(*PATH_TAGS)
    dense = lambda t: t.startswith("entropy>")
    demotion = F.when(
        ~gate,
        F.when((F.size(flagged) > 0) & F.forall(flagged, lambda a: a["type"] == "T2"), "D-1")
        .when((F.size("tags") > 0) & F.forall("tags", lambda t: t.isin(*V.LITERAL_DISQUALIFIED)), "D-4")
        .when((F.size(informative) > 0) & F.forall(informative, path), "D-2")
        .when((F.size(informative) > 0) & F.forall(informative, lambda t: path(t) | dense(t)) & F.exists(informative, dense) & (F.col("entropy") < BORDERLINE), "D-3"),
    )
    h = h.withColumn("demotion", F.when(F.size("acts") == 0, demotion))
    verdict = F.when(F.size("acts") > 0, "Unsafe").when(F.col("demotion").isNotNull(), "Low").otherwise("Review")
    return h.withColumn("verdict", verdict).select("blob_id", "call_seq", "qualname", "canonical", "via", "track", "forced", "placeholder", "reasons", "text", "entropy", "args", "acts", "fired", "demotion", "verdict", "slice_start", "slice_end")


def report_arguments(found: DataFrame, most: int | None = PREVIEW) -> DataFrame:
    """What a report shows of each hit's arguments, in order: position among them, kind, role, type, tags, and the text or the placeholder of the bytes, cut to ``most`` characters (None: whole)."""
    rows = found.select("blob_id", "call_seq", "canonical", "verdict", F.posexplode("args").alias("at", "a"))
    shown = F.coalesce(F.col("a.text"), F.col("a.shown"), F.lit(""))
    preview = shown if most is None else F.when(F.length(shown) > most, F.concat(F.substring(shown, 1, most), F.lit("..."))).otherwise(shown)
    return rows.select("blob_id", "call_seq", "canonical", "verdict", "at", "a.kind", "a.role", "a.type", "a.tags", preview.alias("value"))


def scan_blobs(blobs: DataFrame, calls_of=None, threshold: float = ENTROPY, use_denylist: bool = True) -> DataFrame:
    """Judged hits of the streams (blob_id, content). Without the denylist, only literals make hits.

    The calls are saved once, so that the machine runs over each stream once, however often later steps read them.
    """
    calls = saved((calls_of or scan_calls)(blobs), "calls")
    return judged(hits(calls if use_denylist else calls.withColumn("denied", F.lit(False)), threshold))


def scan_as_of(blobs: DataFrame, table: DataFrame, threshold: float = ENTROPY) -> DataFrame:
    """Judged hits of streams (blob_id, content, version), each under the vocabularies of its own version."""
    calls = saved(scan_calls(blobs), "calls").join(blobs.select("blob_id", "version"), "blob_id")
    return judged(hits(saved(with_denied(calls, table), "denied-calls"), threshold), table)


def artifact_verdicts(artifacts: DataFrame, blobs: DataFrame, found: DataFrame, unsafe_names: DataFrame) -> DataFrame:
    """The verdict of each artifact: Unsafe, Review, Not scanned (a part of it was given up), Low, or No issue, with its counts."""
    per = found.join(blobs.select("blob_id", "artifact_id"), "blob_id").groupBy("artifact_id").agg(
        F.count("*").alias("n_hits"), F.count_if(F.col("verdict") == "Unsafe").alias("n_unsafe"), F.count_if(F.col("verdict") == "Review").alias("n_review"), F.count_if(F.col("verdict") == "Low").alias("n_low"),
        F.array_sort(F.collect_set("canonical")).alias("callables"),
    )
    given_up = F.col("source_kind") == NOT_SCANNED
    counts = blobs.groupBy("artifact_id").agg(F.count_if(~given_up).alias("n_streams"), F.count_if(given_up).alias("n_not_scanned"))
    out = artifacts.select("artifact_id").join(counts, "artifact_id", "left").join(per, "artifact_id", "left").join(unsafe_names.select("artifact_id", "unsafe_names"), "artifact_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    final = F.when(F.col("n_unsafe") > 0, "Unsafe").when((F.col("n_review") > 0) | (F.size("unsafe_names") > 0), "Review").when(F.col("n_not_scanned") > 0, "Not scanned").when(F.col("n_low") > 0, "Low").otherwise("No issue")
    return out.select("artifact_id", n("n_streams"), n("n_not_scanned"), n("n_hits"), n("n_unsafe"), n("n_review"), n("n_low"), F.coalesce("callables", F.array().cast("array<string>")).alias("callables"), final.alias("verdict"))
