"""Discover a net from a log file: ``python -m tracewright log.xml --masses --out net.dot``."""

from __future__ import annotations

import argparse
import time
from pathlib import Path

from pyspark.sql import SparkSession

from .api import MinerParameters, ObjectFlowMiner
from .sources.ocel import read_log


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tracewright", description=__doc__)
    parser.add_argument("log", help="a log by suffix: .xml, .xmlocel, .sqlite, .db, .ocel")
    parser.add_argument("--out", help="file for the DOT text; standard output if absent")
    for name, text in (("remove", "object types to leave out"), ("initial", "types that are initial inputs"), ("final", "types that are final outputs"), ("inner", "types that are neither"), ("count", "types whose objects are counted"), ("mass", "types whose masses are shown"), ("explicit", "activities whose mass attribute is shown"), ("implicit-count", "activities with counts in less counts out"), ("implicit-mass", "activities with mass in less mass out")):
        parser.add_argument(f"--{name}", nargs="*", default=[], metavar="NAME", help=text)
    parser.add_argument("--masses", action="store_true", help="settle unknown roles by mass balance")
    parser.add_argument("--alpha", type=float, default=0.0, help="least share of a variant among its activity's events")
    parser.add_argument("--beta", type=float, default=0.0, help="least share of a neighbouring activity")
    parser.add_argument("--general", action="store_true", help="keep only variants that no other one covers")
    parser.add_argument("--weighted", action="store_true", help="arc weights instead of variable arcs")
    parser.add_argument("--details", action="store_true", help="show what places and transitions stand for")
    parser.add_argument("--direction", choices=("LR", "TB"), default="TB")
    return parser


def main(argv: list[str] | None = None) -> str:
    args = _arguments().parse_args(argv)
    p = MinerParameters(
        remove_object_types=args.remove, hint_initial_input=args.initial, hint_final_output=args.final, hint_inner=args.inner,
        calculate_masses=args.masses, filter_configurations=args.alpha, filter_arcs=args.beta, keep_general=args.general, show_helper_text=args.details,
        annotate_objects_count=args.count, annotate_objects_mass=args.mass, annotate_explicit=args.explicit, annotate_implicit_count=args.implicit_count,
        annotate_implicit_mass=args.implicit_mass, direction=args.direction,
    )
    spark, began, miner = SparkSession.builder.getOrCreate(), time.perf_counter(), ObjectFlowMiner()
    draw = miner.annotated_weighted_arcs if args.weighted else miner.annotated_variable_arcs
    text = draw(read_log(spark, args.log), p).dot_str
    if args.out:
        Path(args.out).write_text(text, encoding="utf-8")
        print(f"{args.out}: {time.perf_counter() - began:.1f} s")
    else:
        print(text)
    return text


if __name__ == "__main__":
    main()
