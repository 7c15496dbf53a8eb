"""python -m sparkweave prepare | run | experiments | summarize"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from sparkweave.plans import executor, prepare, results, single
from sparkweave.sources import files


def session() -> SparkSession:
    spark = SparkSession.builder.appName("sparkweave").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def options(words: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="python -m sparkweave", description="Communities of graphs: prepare data, run one job or a matrix of them, and put the results in tables.")
    parts = parser.add_subparsers(dest="what", required=True)
    part = parts.add_parser("prepare", help="write graphs, references and samples, and a manifest")
    part.add_argument("--config", required=True)
    part.add_argument("--only", action="append", help="this dataset only; may come again")
    part = parts.add_parser("experiments", help="run the matrix of jobs of a configuration")
    part.add_argument("--config", required=True)
    part.add_argument("--protocol", action="append", help="this protocol only; may come again")
    part.add_argument("--resume", action="store_true")
    part.add_argument("--dry-run", action="store_true")
    part.add_argument("--max-jobs", type=int)
    part = parts.add_parser("summarize", help="write the tables over finished runs")
    part.add_argument("--results", default="results")
    part.add_argument("--manifest", default="data/processed/manifest.json")
    part.add_argument("--skip-stability-ami", action="store_true", help="only ARI for stability and robustness")
    for p in parts.choices.values():
        p.add_argument("--base", default=os.getcwd(), help="the folder that relative paths start from")
    parts.add_parser("run", help="run one job; see run --help", add_help=False)
    return parser.parse_args(words)


def main(words: list[str]) -> int:
    """0, or 1 if a job failed, or 2 with a message for what can't be done."""
    try:
        if words[:1] == ["run"]:
            o = single.parse(words[1:])
            print(single.usage() if o["help"] else single.run(session(), o))
            return 0
        o = options(words)
        if o.what == "prepare":
            print(prepare.prepare(session(), json.loads(files.read_text(files.resolved(o.config, o.base))), o.base, o.only))
        elif o.what == "experiments":
            found = executor.execute(session(), files.resolved(o.config, o.base), o.base, o.protocol, o.resume, o.dry_run, o.max_jobs)
            print(f"{len(found)} jobs")
            return int(any(r["status"] == "failed" for r in found))
        else:
            print(results.summarize(session(), files.resolved(o.results, o.base), files.resolved(o.manifest, o.base), o.base, not o.skip_stability_ami))
        return 0
    except Exception as e:  # noqa: BLE001  the message is for the caller, whatever went wrong
        print(f"sparkweave: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
