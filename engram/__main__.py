"""Statements from the terminal, one a line, or a server.

    python -m engram create  --db PATH | --dir PATH [--addr HOST:PORT]   a new store, or directory of stores
    python -m engram open    --db PATH | --dir PATH                      a prompt over one that exists
    python -m engram serve   --db PATH | --dir PATH [--addr HOST:PORT]   a server over one that exists
    python -m engram connect --addr HOST:PORT [--user NAME]              a prompt over a server

Passwords come from ENGRAM_PASSWORD (of the user) and ENGRAM_STORE_PASSWORD (of a sealed store), the user's name from
--user or ENGRAM_USER.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from . import log
from .config import Config, from_toml
from .schema import EngineError
from .server import Client, Server
from .session import Engine, Session

HELP = "SELECT, INSERT, UPDATE, DELETE, SEARCH, RELATED, SHOW, USE, CREATE, DROP, ATTACH, DETACH, BEGIN, COMMIT, ROLLBACK, CHECKPOINT, exit"


def cell(text: str | None, most: int) -> str:
    flat = (text or "").replace("\n", "⏎")
    return flat if len(flat) <= most else flat[: most - 1] + "…"


def table(columns: list[str], rows: list[list[str]]) -> str:
    wide = [max(len(r[i]) for r in [columns, *rows]) for i in range(len(columns))]
    line = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
    show = lambda r: "|" + "|".join(f" {x:<{w}} " for x, w in zip(r, wide, strict=True)) + "|"
    return "\n".join([line, show(columns), line, *map(show, rows), line])


def of_session(session: Session, c: Config) -> Callable[[str], str]:
    """A function from a statement to what the terminal shows."""

    def run(text: str) -> str:
        found = session.sql(text)
        if found.rows is None:
            return found.message
        rows = found.rendered().limit(c.max_rows).collect()  # a screen of them
        return table(list(found.rows.columns), [[cell(x, c.cell_max) for x in r] for r in rows])

    return run


def of_client(client: Client, c: Config) -> Callable[[str], str]:
    def run(text: str) -> str:
        found = client.sql(text)
        if not found["columns"]:
            return found["message"]
        return table(found["columns"], [[cell(x, c.cell_max) for x in r] for r in found["rows"][: c.max_rows]])

    return run


def prompt(run: Callable[[str], str], c: Config, ask: Callable[[str], str] = input, say: Callable[[str], None] = print) -> None:
    """Statements until exit, quit or the end of the input."""
    while True:
        try:
            text = ask(c.prompt).strip()
        except EOFError:
            return
        if text in ("exit", "quit"):
            return
        if text in ("help", ""):
            say(HELP)
            continue
        try:
            say(run(text))
        except EngineError as error:
            say(f"error: {error}")


def arguments(given: list[str]) -> argparse.Namespace:
    args = argparse.ArgumentParser(prog="engram", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("command", choices=("create", "open", "serve", "connect"))
    where = args.add_mutually_exclusive_group()
    where.add_argument("--db", help="the path of a store")
    where.add_argument("--dir", help="the path of a directory of stores")
    args.add_argument("--addr", help="host:port of the server")
    args.add_argument("--user", default=os.environ.get("ENGRAM_USER", "admin"))
    args.add_argument("--config", type=Path)
    found = args.parse_args(given)
    if (found.command == "connect") == bool(found.db or found.dir):
        args.error("connect takes --addr, all else --db or --dir")
    if found.command == "connect" and not found.addr:
        args.error("connect takes --addr")
    return found


def main(given: list[str], ask: Callable[[str], str] = input, say: Callable[[str], None] = print) -> int:
    args = arguments(given)
    config = from_toml(args.config.read_text()) if args.config else Config()
    password = os.environ.get("ENGRAM_PASSWORD")
    try:
        if args.command == "connect":
            host, _, port = args.addr.rpartition(":")
            client = Client((host, int(port)), args.user, password or "")
            prompt(of_client(client, config), config, ask, say)
            client.close()
            return 0
        spark = SparkSession.builder.appName("engram").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        log.start(config)
        engine = Engine(spark, args.db or args.dir, config, password, os.environ.get("ENGRAM_STORE_PASSWORD"), directory=bool(args.dir), create=args.command == "create")
        if args.command == "serve" or args.command == "create" and args.addr:
            with Server(engine, args.addr) as server:
                server.serve_forever()
        elif args.command == "create":
            say(f"created {args.db or args.dir}")
        else:
            with engine.session(args.user) as session:  # a prompt that ends rolls back
                prompt(of_session(session, config), config, ask, say)
    except EngineError as error:
        say(f"error: {error}")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
