"""Columns derived from a path: language, role, subsystem."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.columns import col


def lookup(key: Column, values: dict, default) -> Column:  # noqa: ANN001
    """A literal map's value for a key."""
    if not values:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items())), key), F.lit(default))


def name_of(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def suffix_of(path: Column | str) -> Column:
    """The last dot and what follows, lower case; empty for names without one and for dotfiles."""
    return F.lower(F.regexp_extract(name_of(path), r"^.+(\.[^.]+)$", 1))


def language_of(path: Column | str) -> Column:
    return lookup(suffix_of(path), config.LANGUAGES, "text")


def character_class(inner: str) -> str:
    """A shell pattern's [...] without its brackets; ranges that run backwards hold nothing."""
    negated, inner = inner.startswith("!"), inner.removeprefix("!")
    quoted = lambda c: c if c.isalnum() or not c.isascii() else "\\" + c
    items, i = [], 0
    while i < len(inner):
        if inner[i + 1 : i + 2] == "-" and i + 2 < len(inner):
            items += [f"{quoted(inner[i])}-{quoted(inner[i + 2])}"] if inner[i] <= inner[i + 2] else []
            i += 3
        else:
            items.append(quoted(inner[i]))
            i += 1
    if not negated and items[:1] == ["\\!"]:  # it came first when a range before it fell away, and Python reads it as a negation then
        negated, items = True, items[1:]
    if not items:
        return "." if negated else "(?!)"
    return f"[{'^' * negated}{''.join(items)}]"


def glob_to_regex(pattern: str) -> str:
    """A shell pattern as a whole-string regular expression; * also crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c in "*?":
            out += ".*" if c == "*" else "."
            continue
        close = pattern.find("]", i + 1 + pattern.startswith("!", i)) if c == "[" else -1
        if close > 0:
            out += character_class(pattern[i:close])
            i = close + 1
        else:
            out += c if c.isalnum() or c in "_/" else "\\" + c
    return f"(?s)^{out}$"


def matches_glob(path: Column | str, pattern: str) -> Column:
    return col(path).rlike(glob_to_regex(pattern))


def role_of(path: Column | str, overrides: dict[str, str] | None = None) -> Column:
    """The first rule that fits, in a fixed order. Folder names count in lower case; the last four rules are case-sensitive."""
    p = col(path)
    name, parts = name_of(p), F.split(F.lower(p), "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    among = lambda *names: F.arrays_overlap(dirs, F.array(*map(F.lit, names)))
    rules = [(matches_glob(p, g), role) for g, role in (overrides or {}).items()]
    rules += [(name == n, role) for n, role in config.ROLE_HINTS.items()]
    rules += [
        (name.isin(config.ENTRYPOINTS), "entrypoint"),
        ((F.get(parts, F.lit(0)) == "routes") | F.lower(p).startswith("pages/api/") | (F.lower(p) == "pages/api") | name.isin(config.ROUTE_FILES), "route"),
        (among("models") | (name == "models.py"), "model"),
        (among("controllers") | (name == "views.py"), "controller"),
        (among("views", "templates") & ~name.endswith(".py"), "view"),
        (among("middleware", "middlewares"), "middleware"),
        (p.contains("/test") | p.startswith("tests/") | name.endswith("_test.py"), "test"),
        (p.startswith("docs/") | name.endswith(".md"), "documentation"),
        (p.contains("config") | name.isin(config.CONFIG_FILES), "config"),
        (p.startswith("scripts/"), "script"),
    ]
    out = F.when(*[rules[0][0], F.lit(rules[0][1])])
    for test, role in rules[1:]:
        out = out.when(test, F.lit(role))
    return out.otherwise(F.lit("source"))


def subsystem_of(path: Column | str) -> Column:
    p = col(path)
    top = F.when(p.contains("/"), F.substring_index(p, "/", 1)).otherwise(F.lit("root"))
    low = F.lower(top)
    return F.when(low.isin("src", "app", "lib"), "application").when(low.isin("tests", "test"), "tests").when(low.isin("docs", "doc"), "documentation").when(low.isin("scripts", "bin"), "scripts").otherwise(top)
