"""python -m claimweave.cli ROOT COMMAND: warm, retrieve, explain, feedback, callers, validate, stats, serve."""

from __future__ import annotations

import argparse
import json

from claimweave import rpc
from claimweave.plans.service import Service
from claimweave.session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="claimweave")
    p.add_argument("root")
    p.add_argument("--store")
    p.add_argument("--ignore", nargs="*", default=[])
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("warm")
    r = sub.add_parser("retrieve")
    r.add_argument("query")
    r.add_argument("--limit", type=int, default=5)
    sub.add_parser("explain").add_argument("claim_id")
    f = sub.add_parser("feedback")
    f.add_argument("claim_id")
    f.add_argument("kind", choices=["usage", "verified", "falsified", "hunch"])
    sub.add_parser("callers").add_argument("node_id")
    sub.add_parser("validate")
    sub.add_parser("status")
    s = sub.add_parser("stats")
    s.add_argument("log")
    s.add_argument("--since")
    sub.add_parser("serve")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    s = Service(local_session(), a.root, a.store, a.ignore)
    if a.command == "serve":
        return rpc.serve(s)
    out = {
        "warm": lambda: s.warm(),
        "retrieve": lambda: s.retrieve(a.query, a.limit),
        "explain": lambda: s.explain(a.claim_id),
        "feedback": lambda: s.feedback(a.claim_id, a.kind),
        "callers": lambda: s.reverse("callers", a.node_id),
        "validate": lambda: s.validate(),
        "status": lambda: s.status(),
        "stats": lambda: s.stats(a.log, a.since),
    }[a.command]()
    print(out if isinstance(out, str) else json.dumps(out, default=str, indent=1))
    return None


if __name__ == "__main__":
    main()
