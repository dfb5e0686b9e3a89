"""What both jobs share: their settings, the log, the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def settings(text: str, defaults: dict) -> dict:
    """A job's settings from JSON; what it leaves out has its default, and a name that the job does not know raises."""
    given = json.loads(text)
    if unknown := sorted(given.keys() - defaults.keys()):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | given


def main(doc: str, paths: dict[str, str], defaults: dict, run: Callable[..., dict]) -> None:
    """The command line: --config FILE and the named paths, any of which may be remote."""
    p = argparse.ArgumentParser(description=doc)
    p.add_argument("--config", help="JSON file with the settings; without it all have their defaults")
    for name, says in paths.items():
        p.add_argument(f"--{name}", required=True, help=says)
    a = vars(p.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        text = spark.read.text(a["config"], wholetext=True).first()[0] if a["config"] else "{}"
        run(spark, settings(text, defaults), *(a[name] for name in paths))
    finally:
        spark.stop()
