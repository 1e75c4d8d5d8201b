"""``python -m strata.cli -c job.json -j 4``: runs a configured job. Exit status 0, 1 (bad arguments, or the job failed) or 2 (no configuration that can be read)."""

from __future__ import annotations

import argparse
import resource
import sys
import time

from strata import __version__
from strata.config import load, run


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strata", description="Runs a job over hierarchical data.", exit_on_error=False)
    parser.add_argument("-c", "--config", help="the job, a JSON file")
    parser.add_argument("-j", "--parallel", type=int, help="most tasks at once; beats max_concurrency of the job")
    parser.add_argument("--path", action="append", default=[], help="folder to look for Python modules in; the first hit counts")
    parser.add_argument("--version", action="store_true")
    try:
        given = parser.parse_args(args)
    except (argparse.ArgumentError, SystemExit) as e:
        if isinstance(e, SystemExit) and not e.code:
            return 0
        print(e, file=sys.stderr)
        return 1
    if given.version:
        print(__version__)
        return 0
    if not given.config:
        print("No configuration file given", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    began = time.time()
    try:
        config = load(given.config)
    except (OSError, ValueError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 2
    try:
        threads = given.parallel or config.get("max_concurrency", int, None) or "*"
        spark = SparkSession.builder.master(f"local[{threads}]").appName("strata").getOrCreate()
        print(run(spark, config.values, given.path).hierarchy())
    except Exception as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    use = resource.getrusage(resource.RUSAGE_SELF)
    print(f"driver CPU {use.ru_utime + use.ru_stime:.1f} s, wall {time.time() - began:.1f} s, max RSS {use.ru_maxrss / 1024:.0f} MB")
    return 0


if __name__ == "__main__":
    sys.exit(main())
