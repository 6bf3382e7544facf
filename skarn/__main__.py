"""python -m skarn pull|push|diff|lock|types FOLDER ...: schemas of tables on the command line.

pull FILE writes the schema of a Parquet folder as JSON, diff compares two such files or folders, push checks that a new schema
may replace the old one, lock writes a schema together with a digest, types prints it as an interface.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import sys

from pyspark.sql.types import StructType

from .operators import schema


def load(path: str) -> StructType:
    """From a JSON file, or from the files of a Parquet folder."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            return StructType.fromJson(json.load(f).get("schema"))
    from pyspark.sql import SparkSession

    return SparkSession.builder.getOrCreate().read.parquet(path).schema


def save(path: str, kind: StructType, **more) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"schema": json.loads(kind.json()), **more}, f, indent=1, sort_keys=True)


def main(given: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="skarn")
    parser.add_argument("command", choices=["pull", "push", "diff", "lock", "types"])
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--mode", default="backward", choices=["backward", "forward", "full", "none"])
    args = parser.parse_args(given)
    first = load(args.paths[0])
    if args.command == "types":
        print(schema.to_interface(os.path.basename(args.paths[0]).split(".")[0].title(), first))
    elif args.command == "pull":
        save(args.paths[1], first)
    elif args.command == "lock":
        save(args.paths[1], first, sha256=hashlib.sha256(schema.to_json_schema(first).encode()).hexdigest())
    elif args.command == "diff":
        found = schema.difference(first, load(args.paths[1]))
        print(json.dumps(found))
        return 1 if any(found.values()) else 0
    else:  # push: the new schema takes the old one's place if it may
        wrong = schema.compatible(load(args.paths[1]), first, args.mode) if os.path.exists(args.paths[1]) else []
        if wrong:
            print("\n".join(wrong))
            return 1
        save(args.paths[1], first)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
