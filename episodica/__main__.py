"""``spark-submit``-able entry: build all tables from a folder of extracts, and write the reports of a built folder."""

from __future__ import annotations

import argparse
import logging

from episodica.operators.features import feature_summary
from episodica.operators.target import target_summary
from episodica.plans.build import build_from_csv
from episodica.plans.report import write_reports
from episodica.session import build_session, sized_for


def main() -> None:
    parser = argparse.ArgumentParser(prog="episodica", description=__doc__)
    parser.add_argument("raw_dir", help="folder with the six CSV extracts")
    parser.add_argument("out_dir", help="folder for the Parquet tables")
    parser.add_argument("--sep", help="field separator of the extracts; found from a sample of each if not given")
    parser.add_argument("--reports", help="folder for CSV reports of the built tables")
    parser.add_argument("--input-gb", type=float, default=0.0, help="size of the extracts, to plan the shuffles")
    parser.add_argument("--cores", type=int, default=0, help="cores of the cluster, to plan the shuffles")
    args = parser.parse_args()
    conf = sized_for(int(args.input_gb * 1e9), args.cores) if args.input_gb or args.cores else {}
    logging.basicConfig(level=logging.INFO)
    spark = build_session(**conf)
    built = build_from_csv(spark, args.raw_dir, args.out_dir, sep=args.sep)
    target_summary(built.target).show()
    feature_summary(built.features).show()
    if args.reports:
        write_reports(spark, args.out_dir, args.reports)


if __name__ == "__main__":
    main()
