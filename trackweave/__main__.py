"""python -m trackweave NAME SF_DIR OUT: runs a query and writes its result as Parquet; without arguments lists the names."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.queries import QUERIES
from .sources.writers import write_table


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("name", nargs="?", choices=sorted(QUERIES))
    p.add_argument("sf_dir", nargs="?")
    p.add_argument("out", nargs="?")
    a = p.parse_args()
    if not (a.name and a.sf_dir and a.out):
        print(*sorted(QUERIES), sep="\n")
        return
    spark = SparkSession.builder.appName(f"trackweave {a.name}").getOrCreate()
    write_table(QUERIES[a.name](spark, a.sf_dir), a.out)


if __name__ == "__main__":
    main()
