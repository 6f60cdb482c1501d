"""What the jobs share: their command line and log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

log = logging.getLogger("tessera.jobs")


def say(event: str, **facts: Any) -> None:
    """A line of the job's log, as JSON."""
    log.info(json.dumps({"event": event, **facts}, default=str))


def main(run: Callable[..., dict[str, Any]], module: str, about: str) -> None:
    """Reads the config, lets options of the command line replace its values, and runs the job in a session of its own."""
    default = Path(module).with_suffix(".json")
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", default=str(default), help="a JSON file (default: %(default)s)")
    held = json.loads(default.read_text())
    for name, value in held.items():
        parser.add_argument(f"--{name.replace('_', '-')}", type=type(value) if value is not None else str, default=None)
    given = vars(parser.parse_args())
    config = held | json.loads(Path(given.pop("config")).read_text())
    config |= {k: v for k, v in given.items() if v is not None}
    if empty := [k for k, v in config.items() if v == ""]:
        parser.error(f"no value for {', '.join(empty)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName(Path(module).stem).getOrCreate()
    try:
        say("done", **run(spark, **config))
    finally:
        spark.stop()
