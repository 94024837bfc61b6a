"""Command line: ``python -m tidemark demo | verify | nemesis`` (--help tells the options)."""

from __future__ import annotations

import argparse
import sys
import tempfile

from tidemark import nemesis, verify
from tidemark.model import StreamConfig
from tidemark.operators import lateness, merge, windows
from tidemark.sinks import StdoutSink
from tidemark.sources.generator import GeneratorConfig, generate


def demo(args: argparse.Namespace) -> bool:
    """Windows of a generated stream, printed; with late records when --late is given."""
    spark = nemesis.session()
    config = StreamConfig(args.size, slide=args.slide, lateness=args.lateness, interval=100, disorder=500)
    stream = generate(spark, GeneratorConfig(records=args.records, late_fraction=args.late)).withColumnRenamed("event_time_ms", "e")
    sink = StdoutSink()
    sink.emit(windows.sum_count(lateness.accepted(stream, config), config).orderBy("window_start_ms", "key"), 0)
    sink.flush()
    return True


def check(args: argparse.Namespace) -> bool:
    """The engine against the oracle: the matrix of shapes, cross-N, and K sources with and without an idle one."""
    spark, seeds = nemesis.session(), range(1, args.seeds + 1)
    late = StreamConfig(1000, lateness=2000, interval=100, disorder=500)
    heavy = GeneratorConfig(records=args.records, keys=10, late_fraction=0.1)
    groups = dict(verify.matrix(spark, seeds, args.records))
    groups["cross-N"] = verify.run_cross_n(spark, seeds, late, heavy)
    for k in (1, 2, 3):
        groups[f"K={k}"] = verify.run_multi_source(spark, seeds, k, late, heavy)
    groups["K=3, idle"] = verify.run_multi_source(spark, seeds, 3, late, heavy, (merge.IdleSpan(2, 200, 300, 30),))
    for name, found in groups.items():
        print(f"{name}: {sum(f.passed for f in found)}/{len(found)} pass, dropped {sum(f.engine_dropped for f in found)} = {sum(f.oracle_dropped for f in found)}, late accepted {sum(f.late for f in found)}, refired {sum(f.refired for f in found)}")
    return all(f.passed for found in groups.values() for f in found)


def kill(args: argparse.Namespace) -> bool:
    """Kill the driver of a stream in the middle of batches, between them, and with a torn sink."""
    spark, good = nemesis.session(), True
    for i in range(args.rounds):
        for name, inside, tear in (("inside a batch", True, False), ("between batches", False, False), ("torn", True, True)):
            report = nemesis.kill_and_recover(spark, tempfile.mkdtemp(prefix="tidemark-"), records=args.records, seed=i + 1, inside=inside, tear=tear)
            good &= report.passed
            print(f"{name}: {report}")
    return good


def main() -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    commands = parser.add_subparsers(required=True)
    for run, name, options in (
        (demo, "demo", {"records": 10_000, "size": 1000, "slide": 0, "lateness": 0, "late": 0.0}),
        (check, "verify", {"seeds": 100, "records": 10_000}),
        (kill, "nemesis", {"rounds": 1, "records": 4000}),
    ):
        own = commands.add_parser(name, help=run.__doc__)
        for option, value in options.items():
            own.add_argument(f"--{option}", type=type(value), default=value)
        own.set_defaults(run=run)
    args = parser.parse_args()
    return 0 if args.run(args) else 1


if __name__ == "__main__":
    sys.exit(main())
