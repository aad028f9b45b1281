"""Settings of a job: a small TOML file, any line of which the command line may replace."""

from __future__ import annotations

import argparse
import dataclasses
import logging
import tomllib


def read[T](kind: type[T], argv: list[str], about: str) -> T:
    """A settings dataclass from --config and from options named like its fields."""
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", help="a TOML file with these settings")
    for field in dataclasses.fields(kind):
        parser.add_argument(f"--{field.name.replace('_', '-')}", dest=field.name, type=int if field.type == "int" else str)
    args = vars(parser.parse_args(argv))
    config = args.pop("config")
    given = {}
    if config:
        with open(config, "rb") as f:
            given = tomllib.load(f)
    given |= {k: v for k, v in args.items() if v is not None}
    if unknown := given.keys() - {f.name for f in dataclasses.fields(kind)}:
        parser.error(f"unknown settings: {', '.join(sorted(unknown))}")
    missing = [f.name for f in dataclasses.fields(kind) if f.name not in given and f.default is dataclasses.MISSING]
    if missing:
        parser.error(f"missing settings: {', '.join(missing)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return kind(**given)
