"""Command line: python -m tessera.cli VERB ROOT ... prints the response as JSON."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from tessera.plans.engine import Engine
from tessera.session import local_session

#: verb: positional arguments, options (name, type or True for a switch).
VERBS: dict[str, tuple[list[str], dict]] = {
    "index": ([], {}),
    "refresh": (["changed*"], {}),
    "overview": ([], {}),
    "search": (["query"], {"kind": str, "limit": int}),
    "retrieve": (["query"], {"budget_tokens": int, "scope": str}),
    "pack": (["query"], {"budget_tokens": int, "scope": str}),
    "explain": (["subject"], {"depth": str}),
    "remember": (["title", "summary"], {"evidence_refs": list}),
    "timeline": ([], {"since": str, "scope": list}),
    "capture": (["source"], {"input_format": str, "commit": True}),
    "locate": (["symbol"], {"file": str}),
    "usages": (["symbol"], {"scope": str}),
    "eval": ([], {"fixtures": str, "top_k": int}),
}
METHODS = {"locate": "locate_symbol_range", "usages": "find_usages", "eval": "evaluate"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb, (positional, options) in VERBS.items():
        p = verbs.add_parser(verb)
        p.add_argument("root")
        for name in positional:
            p.add_argument(name.rstrip("*"), **({"nargs": "*"} if name.endswith("*") else {}))
        for name, kind in options.items():
            flag = "--" + name.replace("_", "-")
            extra = {"action": "store_true"} if kind is True else {"nargs": "*"} if kind is list else {"type": kind}
            p.add_argument(flag, dest=name, **extra)
    return top


def call(engine: Engine, verb: str, arguments: dict) -> dict:
    """Run a verb with the arguments that are given."""
    given = {k: v for k, v in arguments.items() if v is not None and v != []}
    if verb == "capture":
        given.setdefault("input_format", "json")
    if verb == "eval":
        path = given.pop("fixtures", None)
        given["fixtures"] = json.loads(Path(path).read_text(encoding="utf-8")) if path else []
    return getattr(engine, METHODS.get(verb, verb))(**given)


def main(argv: list[str] | None = None, spark=None) -> int:  # noqa: ANN001
    args = vars(parser().parse_args(argv))
    verb, root = args.pop("verb"), args.pop("root")
    json.dump(call(Engine(spark or local_session(), root), verb, args), sys.stdout, indent=2, ensure_ascii=False)
    print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
