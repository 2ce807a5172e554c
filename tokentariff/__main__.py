"""Run the whole study: ``spark-submit ... -m tokentariff SESSIONS [--out FOLDER]``.

Prints the reports, or writes each of them as parquet under the folder.
"""

import argparse

from pyspark.sql import SparkSession

from .defaults import AGENTS, ALPHAS, SWEEP, THRESHOLDS
from .plans import run_study
from .sources import load_sessions


def main(args=None) -> None:
    parser = argparse.ArgumentParser(prog="tokentariff")
    parser.add_argument("sessions", help="parquet sessions table")
    parser.add_argument("--out", help="folder for the reports")
    parser.add_argument("--id-column", default="session_id")
    parser.add_argument("--agents", nargs="+", default=AGENTS)
    parser.add_argument("--alphas", nargs="+", type=float, default=ALPHAS)
    parser.add_argument("--thresholds", nargs="+", type=int, default=THRESHOLDS)
    parser.add_argument("--sweep", nargs="+", type=int, default=SWEEP)
    chosen = parser.parse_args(args)

    spark = SparkSession.builder.appName("tokentariff").getOrCreate()
    sessions = load_sessions(spark, chosen.sessions, chosen.agents, chosen.id_column)
    study = run_study(sessions, chosen.thresholds, chosen.sweep, chosen.alphas)
    for name, report in study._asdict().items():
        if chosen.out:
            report.write.mode("overwrite").parquet(f"{chosen.out}/{name}")
        else:
            print(name)
            report.show(max(report.count(), 1), truncate=False)
    study.totals.unpersist()


if __name__ == "__main__":
    main()
