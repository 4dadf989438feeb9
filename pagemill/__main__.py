"""python -m pagemill FOLDER [--훑기 | --skim] [--output DIR] [--no-mask], or python -m pagemill --자가진단 | --selfcheck"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pagemill", description=__doc__)
    p.add_argument("folder", nargs="?")
    p.add_argument("--훑기", "--skim", dest="skim", action="store_true")
    p.add_argument("--자가진단", "--selfcheck", dest="selfcheck", action="store_true")
    p.add_argument("--output")
    p.add_argument("--no-mask", dest="mask", action="store_false")
    given = p.parse_args(args)
    if not given.folder and not given.selfcheck:
        p.error("a folder is needed")
    spark = SparkSession.builder.appName("pagemill").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if given.selfcheck:
        from pagemill.plans.selfcheck import checks

        found = checks(spark)
        for name, passed in found:
            if not passed:
                print(f"실패: {name}")
        bad = sum(not passed for _, passed in found)
        print(f"통과 {len(found) - bad} · 실패 {bad}")
        return int(bad > 0)
    from pagemill.plans.convert import WARNING, convert, scan

    if given.skim:
        for r in scan(spark, given.folder).orderBy("kind").collect():
            print(f"{r['kind']:8} {r['n_files']:8} {r['n_bytes']:14}")
        return 0
    for state, n in sorted(convert(spark, given.folder, given.output, given.mask).items()):
        print(f"{state}: {n}")
    print(WARNING)
    return 0


if __name__ == "__main__":
    sys.exit(main())
