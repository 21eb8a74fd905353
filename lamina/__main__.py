"""A prompt: reads one statement a line, shows its rows and milliseconds; ``exit`` ends it."""

from __future__ import annotations

import sys
import time

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from lamina.config import Config
from lamina.engine import Engine
from lamina.errors import LaminaError


def step(engine: Engine, line: str) -> None:
    """Runs one statement, and shows its rows or what is wrong with it."""
    began = time.perf_counter()
    try:
        engine.sql(line).show(1000, truncate=False)
    except (LaminaError, PySparkException) as e:
        print(f"{type(e).__name__}: {e}")
    print(f"{1000 * (time.perf_counter() - began):.0f} ms")


def main() -> None:
    config = Config.load()
    engine = Engine(SparkSession.builder.getOrCreate(), sys.argv[1] if len(sys.argv) > 1 else config.root, config)
    while (line := input("lamina> ").strip()) != "exit":
        if line:
            step(engine, line)


if __name__ == "__main__":
    main()
