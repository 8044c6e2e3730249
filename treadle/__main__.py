"""python -m treadle query TEXT DIR [--json] [--limit N] [--rescan] [--half-life DAYS] | forget DIR | clear

Exit code 0 with matches, 1 without, 2 on wrong use. Snapshots are kept in $XDG_STATE_HOME/treadle.
"""

from __future__ import annotations

import argparse
import math
import os
import sys

from treadle.constants import HALF_LIFE_SECS, TOP_K


def state_folder() -> str:
    return os.path.join(os.environ.get("XDG_STATE_HOME") or os.path.expanduser("~/.local/state"), "treadle")


def identity(path: str) -> tuple[int, int, int] | None:
    """Device, inode and time of birth in nanoseconds (0 where the system has none) of what a path leads to."""
    try:
        found = os.stat(path)
    except OSError:
        return None
    return found.st_dev, found.st_ino, int(getattr(found, "st_birthtime_ns", 0))


def parser() -> argparse.ArgumentParser:
    def limit(text: str) -> int:
        n = int(text)
        if not 1 <= n <= TOP_K:
            raise argparse.ArgumentTypeError(f"1 to {TOP_K}")
        return n

    def days(text: str) -> float:
        n = float(text)
        if not (math.isfinite(n) and n >= 0):
            raise argparse.ArgumentTypeError("days, 0 or more")
        return n

    out = argparse.ArgumentParser(prog="treadle")
    commands = out.add_subparsers(dest="command", required=True)
    query = commands.add_parser("query")
    query.add_argument("text")
    query.add_argument("dir")
    query.add_argument("--json", action="store_true")
    query.add_argument("--limit", type=limit, default=TOP_K)
    query.add_argument("--rescan", action="store_true")
    query.add_argument("--half-life", type=days, default=HALF_LIFE_SECS / 86400)
    commands.add_parser("forget").add_argument("dir")
    commands.add_parser("clear")
    return out


def run(argv: list[str], spark=None) -> int:
    from treadle.api import Engine
    from treadle.operators import snapshot
    from treadle.session import session, ship
    from treadle.sources.tree import listing

    asked = parser().parse_args(argv)
    spark = spark or session(os.environ.get("TREADLE_MASTER", "local[*]"))
    ship(spark)
    folder = state_folder()
    if asked.command == "clear":
        snapshot.clear_all(spark, folder)
        return 0
    root = os.path.realpath(asked.dir)
    if not os.path.isdir(root):
        print(f"not a directory: {asked.dir}", file=sys.stderr)
        return 2
    engine = Engine(spark, root, folder, getattr(asked, "half_life", HALF_LIFE_SECS / 86400) * 86400, identity(root) or (0, 0, 0))
    found = engine.open(identity)
    if asked.command == "forget":
        engine.forget()
        if found:
            engine.save()
        return 0
    if not found or asked.rescan:
        engine.reconcile(*listing(spark, root))
        engine.save()
    if asked.json:
        print(engine.reply(asked.text, asked.limit))
        return 0 if not engine.query(asked.text, 1).isEmpty() else 1
    hits = engine.lines(asked.text, asked.limit)
    print("\n".join(hits))
    return 0 if hits else 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
