"""Command line: contexts and graph analysis of a store."""

from __future__ import annotations

import argparse
import json

from . import session
from .api import Engine


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("skein")
    p.add_argument("--store", required=True, help="folder of the store")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("context").add_subparsers(dest="what", required=True)
    for name, args in {"create": ["name"], "delete": ["name"], "rename": ["name", "new"], "list": [], "add-source": ["name", "path"], "remove-source": ["name", "path"]}.items():
        s = c.add_parser(name)
        for a in args:
            s.add_argument(a)
    a = sub.add_parser("analyze")
    a.add_argument("context")
    a.add_argument("algorithm", choices=["pagerank", "components", "label_propagation"])
    o = p.parse_args(argv)
    e = Engine(session.build(), o.store)
    if o.command == "analyze":
        n = e.analyze(o.context, o.algorithm).commits[-1][1].counts()
        print(json.dumps({"nodes_updated": n.get("NodesAdded", 0)}))
    elif o.what == "create":
        print(e.context_create(o.name))
    elif o.what == "delete":
        e.context_delete(o.name)
    elif o.what == "rename":
        e.context_rename(o.name, o.new)
    elif o.what == "list":
        print(json.dumps(e.context_list_info()))
    else:
        source = [{"kind": "file", "path": o.path}]
        (e.context_add_sources if o.what == "add-source" else e.context_remove_sources)(o.name, source)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
