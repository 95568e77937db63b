"""The tools from the command line, over a folder of transcripts: python -m mnemospark FOLDER TOOL [name=value ...]."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from mnemospark.api import Memory, report

TOOLS = ("init", "report", "search", "recent", "error_lookup", "decisions", "code_history", "status", "profile")


def main(args: list[str]) -> int:
    if len(args) < 2 or args[1] not in TOOLS:
        print(f"usage: python -m mnemospark FOLDER {{{','.join(TOOLS)}}} [name=value ...]", file=sys.stderr)
        return 2
    given = dict(a.split("=", 1) for a in args[2:])
    values = {k: int(v) if v.isdigit() else v for k, v in given.items()}
    memory = Memory.from_transcripts(SparkSession.builder.appName("mnemospark").getOrCreate(), args[0])
    print(report(memory.init(**values)) if args[1] == "report" else json.dumps(getattr(memory, args[1])(**values), default=str, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
