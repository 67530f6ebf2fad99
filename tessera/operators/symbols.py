"""Symbols of source files. One Arrow-batched pass per file finds its symbols and the references among them.

Extractors by language are functions (path, text) -> list of symbols or None; ``register`` adds or replaces one. Python comes from the
syntax tree, scripts and anything else from patterns; grammars that are not installed fall back to these.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import paths


@dataclass
class Symbol:
    name: str
    kind: str
    signature: str
    start: int
    end: int


Extractor = Callable[[str, str], "list[Symbol] | None"]
EXTRACTORS: dict[str, Extractor] = {}
DECLARED = re.compile(r"^\s*(?:export\s+)?(?:async\s+)?(?:function|class|const|let|var)\s+([A-Za-z_]\w*)", re.M | re.A)
HEADING = re.compile(r"^(#+\s+.+|[A-Z][A-Za-z0-9 _-]{2,}:)\s*$", re.M)


def register(language: str, extractor: Extractor) -> None:
    EXTRACTORS[language] = extractor


def python_symbols(path: str, text: str) -> list[Symbol]:
    """Functions and classes at any depth, in order of line and name; text that doesn't parse has its headings."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # the last two: nested too deeply
        return headings(path, text)
    found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            found.append(Symbol(node.name, "class", f"class {node.name}", node.lineno, node.end_lineno or node.lineno))
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
            found.append(Symbol(node.name, "function", f"{word} {node.name}({', '.join(a.arg for a in node.args.args)})", node.lineno, node.end_lineno or node.lineno))
    return sorted(found, key=lambda s: (s.start, s.name))


def matched(pattern: re.Pattern, kind: str, text: str, clean: Callable[[str], str], signed: bool) -> list[Symbol]:
    """A symbol a match: it spans a chunk's lines from where the match begins."""
    lines = text.splitlines()
    out = []
    for m in pattern.finditer(text):
        start, name = text.count("\n", 0, m.start()) + 1, clean(m[1])
        out.append(Symbol(name, kind, lines[start - 1].strip()[:160] if signed else name, start, min(len(lines), start + config.CHUNK_LINES - 1)))
    return out


def script_symbols(path: str, text: str) -> list[Symbol]:
    return matched(DECLARED, "symbol", text, str, True)


def headings(path: str, text: str) -> list[Symbol]:
    return matched(HEADING, "section", text, lambda s: s.strip().lstrip("#").strip(), False)


register("python", python_symbols)
register("javascript", script_symbols)
register("typescript", script_symbols)


# Grammar tables: what a node of a syntax tree stands for, if a grammar is installed. Fixed node names of the public grammars.
@dataclass(frozen=True)
class Grammar:
    module: str
    function: str = "language"
    plain: tuple[tuple[str, str], ...] = ()  # node type -> kind, by its name field
    owners: tuple[tuple[str, str], ...] = ()  # node type -> kind; functions inside are methods named Owner.name
    methods: tuple[str, ...] = ()
    resets: tuple[str, ...] = ()  # node types whose inner functions belong to no owner
    values: tuple[str, ...] = ()  # declarators whose value is a function


GRAMMARS = {
    "python": Grammar("tree_sitter_python", owners=(("class_definition", "class"),), methods=("function_definition",), resets=("function_definition",)),
    "javascript": Grammar("tree_sitter_javascript", plain=(("function_declaration", "function"), ("generator_function_declaration", "function")), owners=(("class_declaration", "class"),), methods=("method_definition",), values=("variable_declarator",)),
    "typescript": Grammar("tree_sitter_typescript", "language_typescript", (("function_declaration", "function"), ("interface_declaration", "interface"), ("type_alias_declaration", "type"), ("enum_declaration", "enum")), (("class_declaration", "class"), ("abstract_class_declaration", "class")), ("method_definition",), values=("variable_declarator",)),
    "go": Grammar("tree_sitter_go", plain=(("function_declaration", "function"), ("type_spec", "type")), methods=("method_declaration",)),
    "rust": Grammar("tree_sitter_rust", plain=(("function_item", "function"), ("struct_item", "struct"), ("enum_item", "enum"), ("trait_item", "trait")), owners=(("impl_item", ""),), methods=("function_item",)),
    "java": Grammar("tree_sitter_java", plain=(), owners=(("class_declaration", "class"), ("interface_declaration", "interface"), ("enum_declaration", "enum"), ("record_declaration", "record")), methods=("method_declaration", "constructor_declaration")),
    "ruby": Grammar("tree_sitter_ruby", owners=(("class", "class"), ("module", "module")), methods=("method", "singleton_method")),
    "php": Grammar("tree_sitter_php", "language_php", (("function_definition", "function"),), (("class_declaration", "class"), ("interface_declaration", "interface"), ("trait_declaration", "trait")), ("method_declaration",)),
}


def tree_symbols(root, grammar: Grammar, text: bytes) -> list[Symbol]:  # noqa: ANN001
    """Walk a syntax tree by a grammar's table."""
    said = lambda n: text[n.start_byte : n.end_byte].decode("utf-8", "replace")
    plain, owners = dict(grammar.plain), dict(grammar.owners)
    out: list[Symbol] = []

    def add(node, name: str, kind: str) -> None:  # noqa: ANN001
        first = said(node).split("\n", 1)[0].strip()[:160]
        out.append(Symbol(name, kind, first, node.start_point[0] + 1, node.end_point[0] + 1))

    def walk(node, owner: str) -> None:  # noqa: ANN001
        inside, kind = owner, node.type
        name = node.child_by_field_name("name")
        if kind in owners:
            named = name or node.child_by_field_name("type")
            inside = said(named) if named else owner
            if owners[kind] and named:
                add(node, inside, owners[kind])
        elif kind in grammar.methods and name:
            receiver = node.child_by_field_name("receiver")
            holder = re.sub(r"^.*?[\s*(](\w+)\)?$", r"\1", said(receiver)) if receiver else owner
            add(node, f"{holder}.{said(name)}" if holder else said(name), "method" if holder else "function")
            inside = "" if kind in grammar.resets else owner
        elif kind in plain and name:
            add(node, said(name), plain[kind])
        elif kind in grammar.values and name:
            value = node.child_by_field_name("value")
            if value is not None and value.type in ("arrow_function", "function_expression", "function", "generator_function"):
                add(node, said(name), "function")
        for child in node.children:
            walk(child, inside)

    walk(root, "")
    return out


def grammar_symbols(language: str, path: str, text: str) -> list[Symbol] | None:
    """Symbols by an installed grammar; None without one."""
    grammar = GRAMMARS.get(language)
    if grammar is None:
        return None
    try:
        import importlib

        from tree_sitter import Language, Parser

        parser = Parser(Language(getattr(importlib.import_module(grammar.module), grammar.function)()))
    except ImportError:
        return None
    raw = text.encode()
    return tree_symbols(parser.parse(raw).root_node, grammar, raw)


def symbols_in(path: str, language: str, text: str) -> list[dict]:
    """Rows of the symbols of one file, each symbol_id once."""
    found = grammar_symbols(language, path, text)
    if found is None:
        found = EXTRACTORS.get(language, headings)(path, text) or []
    lines, out = text.splitlines(), {}
    for s in found:
        key, body = f"symbol:{path}:{s.name}:{s.start}", "\n".join(lines[s.start - 1 : s.end])
        out.setdefault(key, {
            "symbol_id": key, "path": path, "name": s.name, "kind": s.kind, "signature": s.signature, "line_start": s.start, "line_end": s.end,
            "summary": f"{s.kind} {s.name} in {path} at lines {s.start}-{s.end}", "text": body,
        })
    return list(out.values())


def references_in(symbols: list[dict]) -> list[dict]:
    """Edges from a symbol to others of its file that its text names; one alternation a file, the first symbol of a name counts."""
    first: dict[str, str] = {}
    for s in symbols:
        first.setdefault(s["name"], s["symbol_id"])
    if not first:
        return []
    any_name = re.compile(rf"\b({'|'.join(map(re.escape, first))})\b")
    return [{"source_ref": s["symbol_id"], "target_ref": first[n]} for s in symbols for n in sorted(set(any_name.findall(s["text"]))) if n != s["name"]]


SYMBOL = "struct<symbol_id:string,path:string,name:string,kind:string,signature:string,line_start:int,line_end:int,summary:string,text:string>"
EDGE = "struct<source_ref:string,target_ref:string>"


def scan_symbols(contents: DataFrame, policy: config.Policy | None = None) -> DataFrame:
    """path, symbols, edges of each file of (path, text)."""
    off = [k for k, v in (policy or config.Policy()).parser_overrides.items() if not v]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = pa.struct([*[(n, pa.string()) for n in ("symbol_id", "path", "name", "kind", "signature")], ("line_start", pa.int32()), ("line_end", pa.int32()), ("summary", pa.string()), ("text", pa.string())])
        edge = pa.struct([("source_ref", pa.string()), ("target_ref", pa.string())])
        for b in batches:
            rows = [[] if language in off else symbols_in(path, language, text or "") for path, language, text in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.record_batch([b.column(0), pa.array(rows, pa.list_(symbol)), pa.array([references_in(r) for r in rows], pa.list_(edge))], names=["path", "symbols", "edges"])

    return contents.select("path", paths.language_of("path").alias("language"), "text").mapInArrow(scan, f"path string, symbols array<{SYMBOL}>, edges array<{EDGE}>")


def symbols_of(scanned: DataFrame) -> DataFrame:
    """symbols rows, with the text as well."""
    from tessera.functions.text import token_estimate

    s = scanned.select(F.inline("symbols"))
    return s.select("symbol_id", "path", "name", "kind", "signature", "line_start", "line_end", "summary", F.sha2("text", 256).alias("hash"), token_estimate("text").alias("token_estimate"), "text")


def references_of(scanned: DataFrame) -> DataFrame:
    """Edges among the symbols of a file, with its path."""
    return scanned.select("path", F.inline("edges")).select("path", "source_ref", "target_ref", F.lit("references").alias("relation_type"), F.lit(0.6).alias("weight"))
