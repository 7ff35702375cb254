"""Literal signals as Catalyst columns: tags, scores and whether a literal is suspicious."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as V
from .pattern_index import NATIVE_LIB, PATH, URL, candidates, may_match
from .patterns import finds
from .scalars import SAMPLE, entropy, non_ascii_ratio, stratified_sample

ENTROPY = 5.0
#: Tags that describe a literal and never make it suspicious by themselves.
ANNOTATIONS = ("entropy>=", "entropy_binary_data", "high_entropy", "literal_truncated")
PYTHON_TOKENS = {"PY_CALL_SYNTAX_RE", "PY_STMT_STRUCTURE_RE", "PY_CODE_STRING_RE"}


#: The reference's scan length, for those who want its results; by default the whole text is scanned.
REFERENCE_LIMIT = SAMPLE


def scanned(text: Column, limit: int | None = None) -> Column:
    """What the patterns see: the text, or its first ``limit`` characters."""
    return text if limit is None else F.substr(text, F.lit(1), F.lit(limit))


def _measured(text: Column, limit: int | None) -> Column:
    """What entropy is taken of: the text, or a sample of ``limit`` characters."""
    return text if limit is None else stratified_sample(text, limit)


def _stripped(text: Column) -> Column:
    edge = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1))).rlike(r"(?U)\s")
    return F.when(edge, F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


def _finds(text: Column, name: str, pattern: str, may: Column | None) -> Column:
    """`finds`, for candidates only: ``may`` holds the patterns that the text can match, by `pattern_index`."""
    return may_match(may, "signals", name, finds(text, pattern))


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _fired(text: Column, patterns: list, allowed: dict[str, str], may: Column | None = None) -> Column:
    """Names of the patterns that fire, in their order."""
    hits = []
    for name, _, _, allow, p in patterns:
        hit = _finds(text, name, p, may)
        if allow:
            hit = hit & ~finds(text, allowed[allow])
        hits.append(F.when(hit, F.lit(name)))
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def _score(fired: Column, rows: list) -> Column:
    return _sum([F.when(F.array_contains(fired, name), F.lit(score)).otherwise(F.lit(0)) for name, score, *_ in rows])


def _has(fired: Column, names: list[str]) -> Column:
    return F.arrays_overlap(fired, F.array(*[F.lit(n) for n in names]))


def shell_rules(stripped: Column, may: Column | None = None) -> Column:
    """Names of the shell patterns that fire over a text without white space around it."""
    return _fired(stripped, V.SHELL_PATTERNS, {r[0]: r[4] for r in V.SHELL_ALLOWLIST}, may)


def _shell_like(stripped: Column, fired: Column, score: Column, may: Column | None) -> Column:
    needed = [name for name, _, strong, *_ in V.SHELL_PATTERNS if strong or name == "SHELL_CMD_RE"]
    short = _any([_finds(stripped, r[0], r[4], may) for r in V.SHELL_SHORTCUTS])
    return short | ((F.length(stripped) >= V.SHELL_DETECTION["min_len"]) & _has(fired, needed) & (score >= V.SHELL_DETECTION["score_threshold"]))


def python_rules(text: Column, may: Column | None = None) -> Column:
    """Names of the scored Python rules that fire, in their order."""
    return _fired(text, V.PYTHON_PATTERNS, {}, may)


def _python_evidence(text: Column, fired: Column, score: Column, may: Column | None) -> Column:
    """Evidence that a text is Python code, or null: the first shortcut, else the scored rules if they reach the threshold."""
    first = F.coalesce(*[F.when(_finds(text, r[0], r[4], may), F.array(F.lit(r[0]))) for r in V.PYTHON_SHORTCUTS])
    needed = [name for name, _, strong, *_ in V.PYTHON_PATTERNS if strong or name in PYTHON_TOKENS]
    enough = (F.length(text) >= V.PYTHON_DETECTION["min_len"]) & _has(fired, needed) & (score >= V.PYTHON_DETECTION["score_threshold"])
    return F.coalesce(first, F.when(enough, fired))


def _entropy_tag(text: Column, sample: Column, e: Column, threshold: float) -> Column:
    share = non_ascii_ratio(sample)
    binary = (share > V.CONTENT_SIGNALS["binary_non_ascii_threshold"]) & (F.length(text) >= V.CONTENT_SIGNALS["binary_min_len"])
    shown = F.format_string("%.2f", e)
    dense = F.concat(F.lit("entropy_binary_data ("), shown, F.lit(", non_ascii="), F.format_string("%.0f", share * 100), F.lit("%)"))
    return F.when(e >= threshold, F.when(binary, dense).otherwise(F.concat(F.lit(f"entropy>={threshold:.1f} ("), shown, F.lit(")"))))


def with_signals(rows: DataFrame, text: str = "text", threshold: float = ENTROPY, limit: int | None = None, indexed: bool = True) -> DataFrame:
    """``rows`` with tags (of the text, in the order in which they are observable), entropy, shell_rules, shell_score, python_rules and python_score.

    Each value is a column of a step of its own, so that later ones read it instead of making it again. With the index (`pattern_index`),
    a pattern runs over those texts only that hold the strings it requires. With a ``limit`` (REFERENCE_LIMIT), longer texts are cut and say so.
    """
    t, scan, strip, e, shell, python = (F.col(c) for c in (f"`{text}`", "_scan", "_strip", "entropy", "shell_rules", "python_rules"))
    may = F.col("_may") if indexed else None
    step = rows.select("*", scanned(t, limit).alias("_scan"), entropy(_measured(t, limit)).alias("entropy"), candidates(t, "signals").alias("_may") if indexed else F.lit(0).alias("_may"))
    step = step.select("*", _stripped(scan).alias("_strip"))
    step = step.select("*", shell_rules(strip, may).alias("shell_rules"), python_rules(scan, may).alias("python_rules"))
    blank = F.when(strip.rlike(r"(?U)\s"), 1).otherwise(0)
    step = step.select("*", (_score(shell, V.SHELL_PATTERNS) + blank).alias("shell_score"), _score(python, V.PYTHON_PATTERNS).alias("python_score"))
    step = step.select("*", _python_evidence(scan, python, F.col("python_score"), may).alias("_evidence"))
    tags = [F.when(_finds(scan, r[0], r[4], may), F.lit(r[0])) for r in V.STRUCTURAL_SIGNALS]
    tags += [
        _entropy_tag(t, _measured(t, limit), e, threshold),
        F.when(_shell_like(strip, shell, F.col("shell_score"), may), F.lit("has_shell_pattern")),
        F.when(_finds(scan, "NATIVE_LIB", NATIVE_LIB, may), F.lit("native_lib_path")),
        F.when(_finds(scan, "URL", URL, may), F.lit("has_url")).when(_finds(scan, "PATH", PATH, may), F.lit("has_path")),
        F.when(F.col("_evidence").isNotNull(), F.concat(F.lit("has_python_code("), F.array_join("_evidence", ","), F.lit(")"))),
    ]
    step = step.select("*", F.filter(F.array(*tags), lambda x: x.isNotNull()).alias("tags"))
    if limit is not None:
        cut = F.concat(F.lit("literal_truncated("), F.length(t).cast("string"), F.lit(")"))
        step = step.withColumn("tags", F.when((F.length(t) > limit) & (F.size("tags") > 0), F.concat("tags", F.array(cut))).otherwise(F.col("tags")))
    return step.select(*[F.col(f"`{c}`") for c in rows.columns], *SIGNALS)


SIGNALS = ["tags", "entropy", "shell_rules", "shell_score", "python_rules", "python_score"]


def suspicious(tags: Column) -> Column:
    """Whether any tag is more than an annotation."""
    return F.exists(tags, lambda t: ~reduce(lambda a, b: a | b, [t.startswith(p) for p in ANNOTATIONS]))


def bytes_tags(data: Column) -> Column:
    """Tags of a bytes literal; none below the least size."""
    head = F.hex(F.substring(data, 1, 2))
    sample = F.when(F.length(data) <= SAMPLE, data).otherwise(_bytes_sample(data))
    e = entropy(sample)
    high = e > V.BYTES_DETECTION["entropy_threshold"]
    tags = [
        F.when(head.isin("789C", "78DA", "7801", "785E"), F.lit("zlib_magic")),
        F.when(head.isin("8002", "8003", "8004", "8005") & (F.length(data) > 2), F.lit("pickle_magic")),
        F.when((F.substring(head, 1, 2) == "63") & F.hex(F.substring(data, 1, 32)).rlike("^(..)*?0A"), F.lit("pickle_magic_p0")),
        F.when(high, F.concat(F.lit("high_entropy("), F.format_string("%.2f", e), F.lit(")"))),
        F.when(high & (F.length(data) > SAMPLE), F.concat(F.lit("literal_truncated("), F.length(data).cast("string"), F.lit(")"))),
    ]
    found = F.filter(F.array(*tags), lambda x: x.isNotNull())
    return F.when(F.length(data) >= V.BYTES_DETECTION["min_size"], found).otherwise(F.array().cast("array<string>"))


def _bytes_sample(data: Column, limit: int = SAMPLE, chunks: int = 32) -> Column:
    each = limit // chunks
    step = (F.length(data) / F.lit(chunks)).cast("int")
    return F.concat(*[F.substr(data, (step * k + 1).cast("int"), F.lit(each)) for k in range(chunks)])
