"""The verbs over newline-delimited JSON-RPC 2.0 on standard input and output."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable
from typing import Any, TextIO

from tessera import __version__
from tessera.cli import VERBS, call
from tessera.plans.engine import Engine
from tessera.session import local_session

PARSE_ERROR, NO_METHOD, BAD_PARAMS = -32700, -32601, -32602
#: Tools by name; command-line-only verbs are left out.
TOOLS = {("locate_symbol_range" if v == "locate" else "find_usages" if v == "usages" else v): v for v in VERBS if v != "eval"}
KINDS = {str: "string", int: "integer", list: "array", True: "boolean"}


def describe() -> list[dict]:
    out = []
    for name, verb in TOOLS.items():
        positional, options = VERBS[verb]
        fields = {"repo_root": {"type": "string"}} | {p.rstrip("*"): {"type": "array" if p.endswith("*") else "string"} for p in positional} | {o: {"type": KINDS[k]} for o, k in options.items()}
        out.append({"name": name, "inputSchema": {"type": "object", "properties": fields, "required": ["repo_root", *(p for p in positional if not p.endswith("*"))]}})
    return out


class Server:
    """One engine a tree, kept between calls."""

    def __init__(self, spark=None) -> None:  # noqa: ANN001
        self.spark, self.engines = spark, {}

    def tool(self, name: str, arguments: dict) -> dict:
        arguments = dict(arguments)
        root = arguments.pop("repo_root")
        self.spark = self.spark or local_session()
        engine = self.engines.setdefault(root, None) or Engine(self.spark, root)
        self.engines[root] = engine
        return call(engine, TOOLS[name], arguments)

    def answer(self, line: str) -> dict | None:
        """The reply to one line; None for notifications and blank lines."""
        if not line.strip():
            return None
        try:
            request = json.loads(line)
        except ValueError:
            return self.failed(None, PARSE_ERROR, "not JSON")
        number, method, params = request.get("id"), request.get("method"), request.get("params") or {}
        if number is None:
            return None
        if method == "initialize":
            return self.done(number, {"serverInfo": {"name": "tessera", "version": __version__}, "capabilities": {"tools": {}}, "protocolVersion": params.get("protocolVersion", "2024-11-05")})
        if method == "ping":
            return self.done(number, {})
        if method == "tools/list":
            return self.done(number, {"tools": describe()})
        if method != "tools/call":
            return self.failed(number, NO_METHOD, f"unknown method {method}")
        if params.get("name") not in TOOLS:
            return self.failed(number, BAD_PARAMS, "no such tool" if params.get("name") else "a tool name is missing")
        try:
            result, wrong = self.tool(params["name"], params.get("arguments") or {}), False
        except Exception as e:  # noqa: BLE001 - a tool's failure is its result
            result, wrong = {"error": f"{type(e).__name__}: {e}"}, True
        return self.done(number, {"content": [{"type": "text", "text": json.dumps(result, ensure_ascii=False)}], "isError": wrong})

    @staticmethod
    def done(number: Any, result: dict) -> dict:
        return {"jsonrpc": "2.0", "id": number, "result": result}

    @staticmethod
    def failed(number: Any, code: int, message: str) -> dict:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": message}}

    def serve(self, lines: Iterable[str], out: TextIO) -> None:
        for line in lines:
            if (reply := self.answer(line)) is not None:
                out.write(json.dumps(reply, ensure_ascii=False) + "\n")
                out.flush()


if __name__ == "__main__":
    Server().serve(sys.stdin, sys.stdout)
