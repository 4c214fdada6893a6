"""Command line for spark-submit: ``ingest``, ``query``, ``conflicts``, ``export``, ``stats``.

Settings come from the command line, else from CHRONOLOOM_* variables, else from a JSON file, else from defaults.
"""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import dataclass, fields

from .engine import Engine
from .operators.linking import LinkOptions
from .plans.ontology import Ontology
from .session import session


@dataclass
class Settings:
    root: str = ""
    ontology: str = ""
    mode: str = "stream"
    guard_check: str = "false"
    hot_key_cap: str = ""

    @classmethod
    def load(cls, given: dict, environment: dict | None = None, file: str | None = None) -> Settings:
        environment = os.environ if environment is None else environment
        stored = {}
        if file:
            with open(file) as f:
                stored = json.load(f)
        out = cls()
        for f in fields(cls):
            value = given.get(f.name) or environment.get(f"CHRONOLOOM_{f.name.upper()}") or stored.get(f.name)
            if value is not None:
                setattr(out, f.name, str(value))
        return out

    def options(self) -> LinkOptions:
        return LinkOptions(self.mode, self.guard_check.lower() == "true", int(self.hot_key_cap) if self.hot_key_cap else None)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="chronoloom", description=__doc__)
    parser.add_argument("command", choices=["ingest", "query", "conflicts", "export", "stats"])
    parser.add_argument("path", nargs="?", help="input of ingest, output of export: Parquet of nested records")
    parser.add_argument("--ask", nargs="*", default=[], help="attr=value, all of which must hold")
    parser.add_argument("--start", type=int, default=0)
    parser.add_argument("--end", type=int, default=0)
    parser.add_argument("--attribute", default="")
    parser.add_argument("--settings", help="JSON file")
    for f in fields(Settings):
        parser.add_argument(f"--{f.name.replace('_', '-')}")
    args = vars(parser.parse_args(argv))
    settings = Settings.load(args, file=args["settings"])
    ontology = None
    if settings.ontology:
        with open(settings.ontology) as f:
            ontology = Ontology.from_json(f.read())
    if not settings.root:
        parser.error("--root: a folder that the driver and all executors share")
    engine = Engine(session(), settings.root, ontology, settings.options())
    if args["command"] == "ingest":
        made = engine.ingest(engine.spark.read.parquet(args["path"]))
        print(json.dumps({"inserted": made.inserted, "version": made.version}))
    elif args["command"] == "query":
        outcome = engine.query([tuple(a.split("=", 1)) for a in args["ask"]], args["start"], args["end"], render=True)
        kind = outcome.kind()
        (outcome.conflict if kind == "conflict" else outcome.matches).show(truncate=False)
        print(kind)
    elif args["command"] == "conflicts":
        for row in engine.conflicts(args["start"], args["end"], args["attribute"]).toLocalIterator():  # all of them, a partition at a time
            print(json.dumps(row.asDict(recursive=True)))
    elif args["command"] == "export":
        engine.export(args["start"], args["end"]).write.parquet(args["path"])
    else:
        engine.stats().show()


if __name__ == "__main__":
    main()
