"""Command line: python -m quern.cli {info,tree,verify,compact,dedup-stats} PATH."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .sources.archive import Archive


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quern")
    parser.add_argument("verb", choices=("info", "tree", "verify", "compact", "dedup-stats"))
    parser.add_argument("path")
    parser.add_argument("--prefix", default="")
    parser.add_argument("--keep-versions", type=int, default=1)
    parser.add_argument("--dry-run", action="store_true")
    asked = parser.parse_args(args)
    spark = SparkSession.builder.appName("quern").getOrCreate()
    with Archive(spark, asked.path, "a" if asked.verb == "compact" and not asked.dry_run else "r") as archive:
        if asked.verb == "compact":
            print(archive.compact(asked.keep_versions, asked.dry_run))
        elif asked.verb == "verify":
            bad = [r["content_hash"] for r in archive.verify().collect()]
            print(f"{len(bad)} corrupted chunks", *bad, sep="\n")
            return int(bool(bad))
        else:
            rows = {"info": archive.info, "dedup-stats": archive.dedup_stats, "tree": lambda: archive.tree(asked.prefix).orderBy("path")}[asked.verb]()
            for row in rows.toLocalIterator():
                print(row.asDict())
    return 0


if __name__ == "__main__":
    sys.exit(main())
