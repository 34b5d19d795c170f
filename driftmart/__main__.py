"""python -m driftmart SOURCE TARGET [--csv]

SOURCE holds stations.csv, measurements.csv and events.csv. Writes the marts
under TARGET and prints the reports, the reconciliation and the scores of the model.
"""

import argparse

from driftmart.operators.quality import ObservedLoad, load_check, saved_profile
from driftmart.plans import pipeline
from driftmart.session import build_session
from driftmart.sources.files import load_tables
from driftmart.spec import STATION


def main() -> None:
    parser = argparse.ArgumentParser(prog="driftmart")
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--csv", action="store_true", help="also export the marts as CSV")
    args = parser.parse_args()

    spark = build_session()
    tables = load_tables(spark, args.source)
    # Readings and events are checked while the marts are built from them.
    load = ObservedLoad()
    watched = {name: load.watch(name, tables[name]) for name in ("measurements", "events")}
    saved = pipeline.build(watched, args.target, csv=args.csv)
    load_check({"stations": tables["stations"]}).unionByName(load.check(spark)).show(100)
    folder = args.target.rstrip("/")
    profiled = {name: (f"{folder}/{name}", STATION.period) for name in (pipeline.MONITORING, pipeline.ML_READY)}
    saved_profile(spark, profiled).show()
    for name, report in pipeline.reports(saved[pipeline.MONITORING]).items():
        print(name)
        report.show()
    print("reconciliation")
    pipeline.verify(spark, saved[pipeline.MONITORING], tables).show()
    pipeline.mismatches(spark, saved[pipeline.MONITORING], tables)["mismatches_by_column"].show(100)
    for name, result in pipeline.model(saved[pipeline.ML_READY], target=args.target).items():
        print(name)
        result.show()


if __name__ == "__main__":
    main()
