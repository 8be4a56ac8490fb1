"""Batch entries: python -m docfacts text IN OUT | guides IN OUT | validate NODES DOCS OUT.

text: a folder or file of texts; packages, flags and metrics as JSON. guides: Parquet cell grids; the six-column CSV and a run
report. validate: committed evidence nodes (Parquet) against (doc_id, flat); flags, or with --fix-offsets the corrected nodes.
The exit status is 0 if nothing failed, 1 if a document failed, 2 if there was none.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from docfacts.config import EngineConfig
from docfacts.functions.shipping import ship
from docfacts.operators import guide, readers, rules
from docfacts.plans import pipeline
from docfacts.sources import files


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docfacts", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("text", "guides"):
        sub = commands.add_parser(name)
        sub.add_argument("source")
        sub.add_argument("out")
    commands.choices["guides"].add_argument("--missing", default=None)
    commands.choices["guides"].add_argument("--no-model", action="store_true")
    check = commands.add_parser("validate")
    for x in ("nodes", "docs", "out"):
        check.add_argument(x)
    check.add_argument("--fix-offsets", action="store_true")
    args, config = parser.parse_args(argv), EngineConfig.from_env()
    spark = spark or SparkSession.builder.appName("docfacts").getOrCreate()
    ship(spark)
    if args.command == "text":
        texts = files.read_texts(spark, args.source)
        done = pipeline.extract(texts.select("doc_id", "raw"))
        flags, metrics = done.validate()
        for name, df in (("packages", done.packages), ("flags", flags), ("metrics", metrics), ("rejected", texts.where("reject_reason IS NOT NULL").drop("raw"))):
            df.write.mode("overwrite").json(f"{args.out}/{name}")
        n, bad = texts.count(), texts.where("reject_reason IS NOT NULL").count() + metrics.where("NOT passed").count()
    elif args.command == "guides":
        raw = readers.read_grids(spark.read.parquet(args.source), code_anywhere=True)
        done = pipeline.read_guides(raw, use_model=config.use_model and not args.no_model, missing=args.missing or config.missing)
        ordered = done.rows.orderBy("doc_id", "page", "segment", "row_seq")
        files.write_csv(guide.csv_table(ordered, args.missing or config.missing), f"{args.out}/csv")
        files.run_report(done.summaries, done.flags).write.mode("overwrite").json(f"{args.out}/report")
        n, bad = done.summaries.count(), done.flags.where("severity = 'error'").count()
    else:
        nodes, docs = spark.read.parquet(args.nodes), spark.read.parquet(args.docs)
        found = rules.revalidate(nodes, docs, args.fix_offsets)
        found.write.mode("overwrite").parquet(args.out)
        n, bad = docs.count(), 0 if args.fix_offsets else found.where("severity = 'error'").count()
    return 2 if not n else int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
