"""The checks as tools over standard input and output: JSON-RPC, one message a line.

Tools: check_folder(folder, out, lookups, lang) and render_report(out); both run the command line in this process.
"""

from __future__ import annotations

import contextlib
import io
import json
import sys
from collections.abc import Callable, Iterable

from . import __main__ as command

TOOLS = {
    "check_folder": ("Check a folder of manuscripts and write tables of findings.", {"folder": "string", "out": "string", "lookups": "string", "lang": "string"}, ["folder", "out"]),
    "render_report": ("Write Markdown and HTML reports of the results under a folder.", {"out": "string"}, ["out"]),
}
UNKNOWN, UNREADABLE = -32601, -32700


def _arguments(tool: str, given: dict) -> list[str]:
    if tool == "render_report":
        return ["render", given["out"]]
    options = [x for k in ("out", "lookups", "lang") if given.get(k) for x in (f"--{k}", str(given[k]))]
    return ["check", given["folder"], *options]


def _call(params: dict) -> dict:
    """Run a tool; an unreadable file or any failure is an error the caller can read."""
    said = io.StringIO()
    try:
        with contextlib.redirect_stdout(said):
            code = command.main(_arguments(params["name"], params.get("arguments") or {}))
        return {"content": [{"type": "text", "text": said.getvalue() or f"done, status {code}"}], "isError": code == 3}
    except Exception as e:  # noqa: BLE001  the caller is told
        return {"content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}], "isError": True}


def _listed(_: dict) -> dict:
    kinds = lambda fields: {k: {"type": v} for k, v in fields.items()}
    return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": kinds(f), "required": r}} for n, (d, f, r) in TOOLS.items()]}


METHODS: dict[str, Callable[[dict], dict]] = {
    "initialize": lambda p: {"protocolVersion": p.get("protocolVersion", "2025-06-18"), "capabilities": {"tools": {}}, "serverInfo": {"name": "veriloom", "version": "0.1"}},
    "ping": lambda _: {},
    "tools/list": _listed,
    "tools/call": _call,
}


def answer(message: dict) -> dict | None:
    """The reply to a message; none to a notification."""
    if "id" not in message:
        return None
    head = {"jsonrpc": "2.0", "id": message["id"]}
    method = METHODS.get(message.get("method"))
    if method is None:
        return {**head, "error": {"code": UNKNOWN, "message": f"no method {message.get('method')}"}}
    return {**head, "result": method(message.get("params") or {})}


def serve(lines: Iterable[str] = sys.stdin, say: Callable[[str], object] = print) -> None:
    for line in filter(str.strip, lines):
        try:
            reply = answer(json.loads(line))
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": UNREADABLE, "message": "no JSON"}}
        if reply is not None:
            say(json.dumps(reply, ensure_ascii=False))


if __name__ == "__main__":
    serve()
