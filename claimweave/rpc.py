"""A JSON-RPC loop over lines of standard input, and its tools."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO, Any

from claimweave.plans.service import Service


def tools(s: Service) -> dict[str, Callable[..., Any]]:
    return {
        "context": lambda question, max_chars=3000: s.context(question, max_chars),
        "fragment": lambda entry, relations, hop_limit=2: s.fragment(entry, relations, hop_limit),
        "retrieve": lambda query, limit=5: s.retrieve(query, limit),
        "explain": lambda claim_id: s.explain(claim_id),
        "callers": lambda node_id: s.reverse("callers", node_id),
        "readers": lambda node_id: s.reverse("readers", node_id),
        "writers": lambda node_id: s.reverse("writers", node_id),
        "subtypes": lambda node_id: s.reverse("subtypes", node_id),
        "warm": lambda: s.warm(),
        "status": lambda: s.status(),
    }


def answer(s: Service, line: str) -> dict | None:
    """The reply to a request, or None to a notification."""
    try:
        request = json.loads(line)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
    if not isinstance(request, dict) or "method" not in request:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "invalid request"}}
    if "id" not in request:
        return None
    reply: dict = {"jsonrpc": "2.0", "id": request["id"]}
    known, method, params = tools(s), request["method"], request.get("params") or {}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n} for n in known]}}
    if method == "tools/call":
        method, params = params.get("name"), params.get("arguments") or {}
    if method not in known:
        return reply | {"error": {"code": -32601, "message": f"unknown method: {method}"}}
    try:
        return reply | {"result": known[method](**params)}
    except (TypeError, ValueError) as e:
        return reply | {"error": {"code": -32602, "message": str(e)}}


def serve(s: Service, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    for line in source:
        if line.strip() and (out := answer(s, line)) is not None:
            print(json.dumps(out, default=str), file=sink, flush=True)
