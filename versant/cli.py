"""Command line: aligns the recordings of JSON-lines transcripts with a corpus and writes a file for each.

    python -m versant.cli SEGMENTS CORPUS OUTPUT --format json --strategy hybrid

SEGMENTS are lines as ``sources.corpus.segments`` reads them, with group_id; CORPUS is a JSON object of group
number -> texts.  Recordings that fail are listed and make the exit code 1; the others are written.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import alignment, report
from .sources import corpus


def parser() -> argparse.ArgumentParser:
    found = argparse.ArgumentParser(prog="versant", description=__doc__.splitlines()[0])
    found.add_argument("segments")
    found.add_argument("corpus")
    found.add_argument("output")
    found.add_argument("--silences", help="JSON lines of recording, start_ms, end_ms")
    found.add_argument("--format", choices=("json", "csv", "text"), default="json")
    found.add_argument("--strategy", choices=("auto", "greedy", "dp", "hybrid", "words"), default="auto")
    found.add_argument("--edition")
    found.add_argument("--label", default="Unit", help="what a unit is called in text output")
    return found


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("versant").getOrCreate()
    segments = corpus.segments(spark, given.segments)
    units = corpus.corpus(spark, given.corpus, given.edition)
    groups = segments.filter("group_id is not null").groupBy("recording").agg(F.min("group_id").alias("wanted"))
    wanted = groups.join(F.broadcast(units), F.col("wanted") == F.col("group_id")).select("recording", "group_id", "id", "unit_no", "text")
    quiet = corpus.silences(spark, given.silences).selectExpr("recording", "start_ms / 1000 AS silence_start", "end_ms / 1000 AS silence_end") if given.silences else None
    aligned = alignment.align(segments, wanted, given.strategy, quiet, isolate=True)
    if given.format == "json":
        lines = report.full_document(aligned, wanted)
    else:
        line = report.csv_line("unit_no", "start_s", "end_s", "text") if given.format == "csv" else report.text_line("unit_no", "start_s", "end_s", given.label)
        lines = aligned.filter("error is null").repartition("recording").sortWithinPartitions("recording", "unit_no").select("recording", line.alias("value"))
    report.write_batch(lines, given.output, "recording")
    failed = aligned.filter("error is not null").select("recording", "error")
    n = 0
    for row in failed.toLocalIterator():
        n += 1
        print(f"recording {row.recording}: {row.error}", file=sys.stderr)
    return 1 if n else 0


if __name__ == "__main__":
    sys.exit(main())
