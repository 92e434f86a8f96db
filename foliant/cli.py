"""Command line: python -m foliant.cli ROOT COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from foliant.api import Library
from foliant.plans import render
from foliant.session import get_session


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="foliant")
    p.add_argument("root")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    add = sub.add_parser("add")
    add.add_argument("folder")
    add.add_argument("--policy", default="reject")
    add.add_argument("--collection")
    lst = sub.add_parser("list")
    lst.add_argument("--collection")
    find = sub.add_parser("search")
    find.add_argument("query")
    find.add_argument("--top-k", type=int, default=10)
    find.add_argument("--mode", default="keyword")
    find.add_argument("--section")
    find.add_argument("--collection")
    sub.add_parser("remove").add_argument("book_id")
    sub.add_parser("structure").add_argument("book_id")
    for name in ("export", "backup"):
        sub.add_parser(name).add_argument("folder")
    restore = sub.add_parser("restore")
    restore.add_argument("folder")
    restore.add_argument("--force", action="store_true")
    sub.add_parser("reindex")
    a = p.parse_args(args)
    lib = Library(get_session(), a.root)
    out = lambda rows, text: print(json.dumps(rows, default=str) if a.json else text)
    if a.command == "add":
        rows = [r.asDict() for r in lib.add(a.folder, a.policy, a.collection).collect()]
        out(rows, "\n".join(f"{r['status']}: {r['path']}" for r in rows))
        return int(any(r["status"] not in ("added", "replaced", "skipped") for r in rows))
    if a.command == "list":
        rows = [r.asDict() for r in lib.list(a.collection).collect()]
        out(rows, render.book_table(rows))
    elif a.command == "search":
        got = lib.search(a.query, top_k=a.top_k, mode=a.mode, section=a.section, collection=a.collection)
        out(got.results, render.results(got.results) or got.empty_reason.message)
    elif a.command == "structure":
        rows = [r.asDict() for r in lib.structure(a.book_id).collect()]
        out(rows, render.outline(rows))
    elif a.command == "remove":
        return int(not lib.remove(a.book_id))
    elif a.command == "export":
        return int(not lib.export(a.folder))
    elif a.command == "reindex":
        rows = [r.asDict() for r in lib.reindex().collect()]
        out(rows, "\n".join(f"{r['status']}: {r['book_id']}" for r in rows))
        return int(any(r["status"] != "success" for r in rows))
    else:
        done = lib.backup(a.folder) if a.command == "backup" else lib.restore(a.folder, a.force)
        out(done, json.dumps(done))
    return 0


if __name__ == "__main__":
    sys.exit(main())
