"""Command line: ``python -m loomql [--config=FILE] [--advisor] [--parse] SCRIPT``."""

from __future__ import annotations

import argparse

from loomql.advisor import Advisor, Statistics
from loomql.config import Config
from loomql.lang.parser import parse
from loomql.plans.run import run


def main(argv: list[str] | None = None) -> int:
    arguments = argparse.ArgumentParser(prog="loomql", description="Run a transformation script.")
    arguments.add_argument("--config", help="properties file")
    arguments.add_argument("--advisor", action="store_true", help="choose the mode of each transformation from past run times")
    arguments.add_argument("--parse", action="store_true", help="only parse the script and show its tree")
    arguments.add_argument("script", help="the script's text, or @FILE")
    given = arguments.parse_args(argv)
    text = open(given.script[1:]).read() if given.script.startswith("@") else given.script
    if given.parse:
        for t in parse(text):
            print(t)
        return 0
    config = Config.read(given.config) if given.config else Config()
    spark = config.session()
    if given.advisor:
        done = Advisor(spark, Statistics(config.statistics_file or None), config.advisor_randomness).evaluate(text)
    else:
        done = run(spark, text)
    for d in done:
        print(f"{d.mode}: {d.milliseconds:.0f} ms" + ("" if d.stored else ", nothing changed"))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
