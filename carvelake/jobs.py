"""The scan as a job: ``python -m carvelake.jobs PATH... OUT``, or `scan` from a notebook."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from carvelake.functions.signals import ENTROPY
from carvelake.operators import carve, verdict
from carvelake.plans import report
from carvelake.scratch import saved
from carvelake.session import session, ship
from carvelake.sources import detect, records


def present(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """The paths, sorted, that are there, and those that aren't."""
    found: dict[bool, list[str]] = {True: [], False: []}
    for path in sorted(set(paths)):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        matches = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        found[bool(matches)].append(path)
    return found[True], found[False]


def scan(spark: SparkSession, path: str | list[str], out: str, threshold: float = ENTROPY, use_denylist: bool = True, recursive: bool = False, most_bytes: int = 512 << 20, most_literal: int | None = verdict.PREVIEW) -> None:
    """Carves and judges all files of a folder and writes, below ``out``: streams (without contents), hits, arguments, labelled
    (JSON), summary (a row for each stream), findings (of archives) and verdicts (a row for each file).

    Files beyond ``most_bytes`` are carved where they lie, by windows and members. Of several paths, those that are missing are told in the table skipped; it is an error if all are.
    """
    path, missing = present(spark, [path] if isinstance(path, str) else path)
    if not path:
        raise FileNotFoundError(", ".join(missing))
    spark.createDataFrame([(p, "missing") for p in missing], "path string, reason string").write.mode("overwrite").parquet(f"{out}/skipped")
    files = detect.read_artifacts(spark, path, recursive, most_bytes)
    large = detect.large_artifacts(spark, path, recursive, most_bytes)
    blobs = saved(carve.carve(files).unionByName(carve.carve_large(large)), "scan-blobs")
    found = saved(verdict.scan_blobs(blobs, threshold=threshold, use_denylist=use_denylist), "scan-hits")
    findings = saved(carve.container_findings(files).unionByName(carve.large_findings(large)), "scan-findings")
    every = files.select("artifact_id", "path", "length", "kind").unionByName(large.withColumn("kind", F.lit("large")))
    verdicts = verdict.artifact_verdicts(every, blobs, found, findings).join(every, "artifact_id")
    for name, table in {
        "streams": blobs.drop("content"), "hits": found, "arguments": verdict.report_arguments(found, most_literal), "summary": report.blob_summary(found), "findings": findings, "verdicts": verdicts,
    }.items():
        table.write.mode("overwrite").parquet(f"{out}/{name}")
    records.write_labelled(found, f"{out}/labelled")


def main() -> None:
    p = argparse.ArgumentParser(description="Scan a folder of artifacts for pickle streams and judge what they call.")
    p.add_argument("path", nargs="+")
    p.add_argument("out")
    p.add_argument("--entropy", type=float, default=ENTROPY, help="entropy from which a text counts as dense")
    p.add_argument("--no-denylist", action="store_true", help="judge by literals only")
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--most-bytes", type=int, default=512 << 20, help="larger files are carved by windows and members")
    p.add_argument("--max-literal", type=int, default=verdict.PREVIEW, help="characters of a literal that the table of arguments shows; 0: all")
    a = p.parse_args()
    scan(ship(session("scan")), a.path, a.out, a.entropy, not a.no_denylist, a.recursive, a.most_bytes, a.max_literal or None)


if __name__ == "__main__":
    main()
