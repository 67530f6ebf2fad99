"""Operators against rows worked out by hand, Python's own functions, SQLite's full-text scores and random cases."""

import fnmatch
import hashlib
import io
import json
import re
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import config, rpc
from tessera.cli import main
from tessera.functions import paths, text
from tessera.functions.numbers import rounded
from tessera.functions.porter import stem, tokens
from tessera.operators import budget, features, graph, memory, merge, ranking, symbols, vector


def column(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first()["y"]


@pytest.mark.parametrize(("said", "n"), [("", 0), ("abc", 1), ("123456789", 2), ("ä" * 8, 2)])
def test_token_estimate(spark, said, n):
    assert column(spark, said, text.token_estimate) == n


def test_lines_are_pythons(spark):
    cases = ["", "a", "a\n", "a\r\nb\rc", "\n\n", "a\x0bb\x0cc\x1cd e", "x\x85y\n\n"]
    rows = spark.createDataFrame([(c,) for c in cases], "x string").select("x", text.lines("x").alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == {c: c.splitlines() for c in cases}


@pytest.mark.parametrize(("n", "spans"), [(0, []), (40, ["1-40"]), (41, ["1-40", "33-41"]), (100, ["1-40", "33-72", "65-100"])])
def test_window_chunks(spark, n, spans):
    rows = features.window_chunks(spark.createDataFrame([("p.txt", "\n".join(f"l{i}" for i in range(n)))], "path string, text string")).collect()
    assert sorted(r["chunk_id"] for r in rows) == sorted(f"p.txt:{s}" for s in spans)
    blank = spark.createDataFrame([("p.txt", " \n" * 50)], "path string, text string")
    assert features.window_chunks(blank).count() == 0


def test_roles_and_subsystems(spark):
    wanted = {
        "routes/web.php": "route", "app/Models/U.php": "model", "x/views.py": "controller", "src/main.py": "entrypoint", "tests/a.py": "test", "README.md": "documentation", "ui/templates/a.html": "view",
        "ui/templates/a.py": "source", "a/middleware/b.js": "middleware", "pages/api/x.ts": "route", "docs/x.txt": "documentation", "my/config.yml": "config", "scripts/a.sh": "script", "Dockerfile": "runtime-config", "a_test.py": "test", "Docs/x.txt": "source",
    }
    rows = spark.createDataFrame([(p,) for p in wanted], "p string").select("p", paths.role_of("p").alias("r")).collect()
    assert {r["p"]: r["r"] for r in rows} == wanted
    parts = {"src/a.py": "application", "Docs/x.md": "documentation", "a.py": "root", "Web/b.ts": "Web", "bin/x": "scripts", "test/a": "tests"}
    rows = spark.createDataFrame([(p,) for p in parts], "p string").select("p", paths.subsystem_of("p").alias("r"), paths.language_of("p").alias("l")).collect()
    assert {r["p"]: r["r"] for r in rows} == parts
    assert {r["p"]: r["l"] for r in rows}["Docs/x.md"] == "markdown"


@settings(max_examples=200, deadline=None)
@given(st.text("ab/.*?[]!-x", max_size=8), st.text("ab/.x-", max_size=8))
def test_globs_are_pythons(pattern, path):
    assert bool(re.search(paths.glob_to_regex(pattern), path)) == fnmatch.fnmatchcase(path, pattern)


def test_overlap_and_exact(spark):
    q = text.query_terms("auth auth login")
    assert column(spark, "auth login page", lambda c: text.overlap(text.terms(c), q)) == pytest.approx(2 / 3)
    assert column(spark, "", lambda c: text.overlap(text.terms(c), q)) == 0
    rows = spark.createDataFrame([("src/login.py", "a login page", "source", "python")], "path string, summary string, role string, language string")
    assert rows.select(ranking.file_score(text.query_terms("login")).alias("s")).first()["s"] == pytest.approx(2 + 1)


def test_imports(spark):
    body = "from ..models.user import U\nfrom . import x\nimport os.path\n  from .u import v\n"
    rows = spark.createDataFrame([("a/b.py", body), ("a/c.ts", "import x from \"./u\"\nexport * from './v'\nconst a = require('http://x'); require(\"w\")"), ("d.php", "use App\\Models\\User;\n")], "path string, text string")
    found = {(r["source_ref"], r["target_ref"]) for r in features.imports_of(rows).collect()}
    assert found == {("file:a/b.py", f"import:{t}") for t in ("../models/user", ".", "os/path", "./u")} | {("file:a/c.ts", f"import:{t}") for t in ("./u", "./v", "w")} | {("file:d.php", "import:App/Models/User")}


def test_import_resolution(spark):
    files = spark.createDataFrame([("src/u.ts",), ("src/v/index.tsx",), ("app/Models/User.php",), ("deep/x/util.py",), ("util.py",)], "path string")
    edges = [("file:src/a.ts", "import:./u"), ("file:src/a.ts", "import:./v"), ("file:z/d.php", "import:App/Models/User"), ("file:deep/x/y.py", "import:../../util"), ("file:q.py", "import:none/such")]
    rows = graph.resolve_imports(spark.createDataFrame([(*e, "imports", 1.0) for e in edges + edges[:1]], "source_ref string, target_ref string, relation_type string, weight double"), files).collect()
    got = sorted((r["source_ref"], r["target_ref"]) for r in rows)
    assert got == sorted([("file:src/a.ts", "file:src/u.ts"), ("file:src/a.ts", "file:src/u.ts"), ("file:src/a.ts", "file:src/v/index.tsx"), ("file:z/d.php", "file:app/Models/User.php"), ("file:deep/x/y.py", "file:util.py"), ("file:q.py", "import:none/such")])


def test_byte_ranges(spark):
    for body in ("", "a", "äb\nc\n", "x\n\nyy\nz", "\n"):
        for a, b in ((1, 1), (2, 3), (0, 9), (3, 2), (5, 6)):
            lines = body.splitlines(keepends=True)
            first = max(1, a)
            last = max(first, min(len(lines), b))
            x = sum(len(s.encode()) for s in lines[: first - 1])
            wanted = (x, x + sum(len(s.encode()) for s in lines[first - 1 : last])) if lines else (0, 0)
            got = column(spark, body, lambda c, a=a, b=b: features.byte_range(F.col(c), F.lit(a), F.lit(b)))
            assert (got["byte_start"], got["byte_end"]) == wanted, (body, a, b)


def test_symbols():
    rows = symbols.symbols_in("a.py", "python", "@deco\ndef f(a, b=1):\n    def g(): pass\nclass C:\n    async def m(self): return f\n")
    assert [(r["name"], r["kind"], r["signature"], r["line_start"]) for r in rows] == [("f", "function", "def f(a, b)", 2), ("g", "function", "def g()", 3), ("C", "class", "class C", 4), ("m", "function", "async def m(self)", 5)]
    assert {(e["source_ref"].split(":")[2], e["target_ref"].split(":")[2]) for e in symbols.references_in(rows)} == {("f", "g"), ("C", "m"), ("C", "f"), ("m", "f")}
    assert [r["name"] for r in symbols.symbols_in("bad.py", "python", "def (\n# Head\n\nPart one:\n")] == ["Head", "Part one:"]
    blank = symbols.symbols_in("a.js", "javascript", "\nconst x = 1\n")[0]
    assert (blank["line_start"], blank["signature"]) == (1, "")


class Node:
    """A syntax tree node as the grammars' bindings give it."""

    def __init__(self, type, start, end, children=(), **fields):
        self.type, self.start_byte, self.end_byte, self.children, self.fields = type, start, end, list(children), fields
        self.start_point, self.end_point = (0, start), (0, end)

    def child_by_field_name(self, name):
        return self.fields.get(name)


def test_grammar_tables():
    src = b"class A { run() {} } const go = () => 1"
    name = lambda s: Node("identifier", src.index(s), src.index(s) + len(s))
    method = Node("method_definition", 10, 18, name=name(b"run"))
    tree = Node("program", 0, len(src), [Node("export_statement", 0, 20, [Node("class_declaration", 0, 20, [method], name=name(b"A"))]), Node("variable_declarator", 27, len(src), name=name(b"go"), value=Node("arrow_function", 32, len(src)))])
    assert [(s.name, s.kind) for s in symbols.tree_symbols(tree, symbols.GRAMMARS["javascript"], src)] == [("A", "class"), ("A.run", "method"), ("go", "function")]
    assert set(symbols.GRAMMARS) == {"python", "javascript", "typescript", "go", "rust", "java", "ruby", "php"}


def test_porter_and_bm25_against_sqlite(spark):
    words = "authentication generalizations naïve login_user running flies happily relational conditional caresses ponies hopping falling agreed plastered motoring sky controlling rate".split()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    docs = [" ".join(words[i % 7 :: 1 + i % 4] * (1 + i % 3)) for i in range(20)]
    con.executemany("INSERT INTO t(rowid, x) VALUES(?, ?)", list(enumerate(docs)))
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, row)")
    assert {r[0] for r in con.execute("SELECT term FROM v")} == {t for d in docs for t in tokens(d)}
    asked = ["login", "running", "sky"]
    wanted = {r[0]: -r[1] for r in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (" OR ".join(asked),))}
    d = spark.createDataFrame([(str(i), tokens(x)) for i, x in enumerate(docs)], "ref string, tokens array<string>")
    got = {int(r["ref"]): r["bm25"] for r in ranking.bm25(d, [stem(a) for a in asked]).collect()}
    assert all(got[i] == pytest.approx(s, abs=1e-9) for i, s in wanted.items()) and all(got[i] == 0 for i in got if i not in wanted)
    stats = d.agg(F.count("ref").alias("n"), F.avg(F.size("tokens")).alias("mean")).first()
    again = {int(r["ref"]): r["bm25"] for r in ranking.bm25_from_postings(ranking.postings(d), [stem(a) for a in asked], stats["n"], stats["mean"]).collect()}
    assert again == {i: pytest.approx(s) for i, s in wanted.items()}


def test_recency_and_proximity(spark):
    ages = {"2024-01-31T00:00:00+00:00": 1.10, "2024-01-22T00:00:00": 1.03, "2023-12-23": 1.0, "never": 1.0, None: 1.0}
    rows = spark.createDataFrame([(a,) for a in ages], "a string").select("a", ranking.recency(F.col("a"), F.lit("2024-02-01").cast("timestamp")).alias("f")).collect()
    assert {r["a"]: r["f"] for r in rows} == ages
    edges = spark.createDataFrame([("a", "b", "x", 1.0), ("a", "a", "x", 1.0), ("a", "c", "x", 1.0)], "source_ref string, target_ref string, relation_type string, weight double")
    refs = spark.createDataFrame([("a",), ("b",)], "ref string")
    got = {r["ref"]: r["s"] for r in refs.join(graph.proximity(edges, refs), "ref", "left").select("ref", graph.boosted(F.lit(2.0), F.col("bonus")).alias("s")).collect()}
    assert got == {"a": pytest.approx(2.1), "b": pytest.approx(2.1)}
    assert {r["neighbor"] for r in graph.neighbors(edges, refs).collect()} == {"a", "b", "c"}


@pytest.mark.parametrize(("query", "name", "score"), [("search", "Repo.search", 0.7), ("Repo.search", "Repo.search", 1.0), ("Other.search", "Repo.search", 0.6), ("search", "search", 1.0), ("X.search", "search", 0.5)])
def test_locate_score(spark, query, name, score):
    row = spark.createDataFrame([(name, "a.py", "def search(self)")], "n string, p string, s string")
    assert row.select(ranking.locate_score(query, query.split(".")[-1], F.col("n"), F.col("p"), F.col("s")).alias("x")).first()["x"] == pytest.approx(score)


def test_evidence_and_recall(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    m = spark.createDataFrame([(1, []), (2, ["gone.py"]), (3, ["b.py", "symbol:s", "a.py"])], "memory_id long, evidence_refs array<string>")
    h = spark.createDataFrame([("file:a.py", "A"), ("file:b.py", "B"), ("symbol:s", "S")], "ref string, hash string")
    assert {r["memory_id"]: r["current_hash"] for r in memory.evidence_hashes(m, h).collect()} == {1: sha(""), 2: sha("missing"), 3: sha("B|S|A")}
    rows = lambda fresh, stale: spark.createDataFrame([(i, "login", "x", i > fresh) for i in range(1, fresh + stale + 1)], "memory_id long, title string, summary string, stale boolean")
    pick = lambda fresh, stale: [(r["memory_id"], r["stale"]) for r in memory.recall(rows(fresh, stale), text.query_terms("login")).collect()]
    assert pick(5, 2) == [(5, False), (4, False), (3, False)] and pick(0, 2) == [(2, True)]


def fold(costs, budget_):
    used, kept = 0, []
    for i, c in enumerate(costs):
        if used + c <= budget_:
            used, kept = used + c, [*kept, i]
    return kept


def test_budgets(spark):
    cases = [([500, 900, 400, 50], 1000), ([], 5), ([0, 0, 6, 5], 5), ([3, 1, 4, 1, 5, 9, 2, 6], 11)]
    for costs, most in cases:
        rows = spark.createDataFrame([(i, c) for i, c in enumerate(costs)], "rank int, cost int")
        assert sorted(r["rank"] for r in budget.greedy_skip(rows, most).where("kept").collect()) == fold(costs, most)
    rows = spark.createDataFrame([(0, 300), (1, 900), (2, 100)], "rank int, cost int")
    assert [r["rank"] for r in budget.prefix_that_fits(rows, 1000, ["rank"], used=100).collect()] == [0]
    nested = spark.createDataFrame([(0, 10, [50, 500, 10]), (1, 10, []), (2, 990, [1]), (3, 1, [])], "rank int, cost int, chunks array<int>")
    got = budget.nested_break(nested, 200, 100).first()
    assert got["used"] == 100 + 10 + 50 + 10 and [(k["rank"], k["n"]) for k in got["kept"]] == [(0, 1), (1, 0)]


def test_merges_and_vectors(spark):
    old = spark.createDataFrame([("a", "1", "old"), ("b", "1", "old")], "path string, hash string, at string")
    new = spark.createDataFrame([("b", "1", "new"), ("c", "1", "new"), ("a", "2", "new")], "path string, hash string, at string")
    assert sorted(tuple(r) for r in merge.upsert(old, new, "path", "hash").collect()) == [("a", "2", "new"), ("b", "1", "old"), ("c", "1", "new")]
    e = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.6, 0.8]), ("z", [-1.0, 0.0])], "ref string, vector array<float>")
    assert {r["ref"]: r["semantic"] for r in vector.cosine_scores(e, [1.0, 0.0]).collect()} == {"x": 1.0, "y": pytest.approx(0.6)}
    times = spark.createDataFrame([(i, i) for i in range(103)], "k int, t int")
    assert min(r["t"] for r in merge.evict(times, config.CACHE_ROWS, "t", "k").collect()) == 3


def test_shells(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text("def hello():\n    pass\n")
    assert main(["index", str(tmp_path)], spark) == 0
    assert json.loads(capsys.readouterr().out)["indexed_files"] == 1
    out = io.StringIO()
    ask = lambda **x: json.dumps({"jsonrpc": "2.0", "id": 1} | x)
    lines = ["{", ask(method="nope"), ask(method="tools/call", params={}), ask(method="tools/list"), ask(method="tools/call", params={"name": "search", "arguments": {"repo_root": str(tmp_path), "query": "hello"}}), ask(method="tools/call", params={"name": "search", "arguments": {"repo_root": "/no/such", "query": "x"}}), json.dumps({"method": "note"})]
    rpc.Server(spark).serve(lines, out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r.get("error", {}).get("code") for r in replies[:3]] == [-32700, -32601, -32602]
    assert len(replies[3]["result"]["tools"]) == 12
    assert json.loads(replies[4]["result"]["content"][0]["text"])["results"] and replies[5]["result"]["isError"]


def test_streaming(spark, tmp_path):
    from tessera.plans.engine import Engine
    from tessera.streaming.refresh import refresh_from, rolling_counts

    root, changes = tmp_path / "tree", tmp_path / "changes"
    root.mkdir()
    changes.mkdir()
    (root / "a.py").write_text("x = 1\n")
    engine = Engine(spark, str(root))
    engine.index()
    (root / "b.py").write_text("def late():\n    pass\n")
    (changes / "1.json").write_text(json.dumps({"path": "b.py"}))
    stream = spark.readStream.schema("path string").json(str(changes))
    refresh_from(stream, engine, str(tmp_path / "ck"), once=True).awaitTermination()
    assert engine.store.read("files").count() == 2
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 2.0)], "t string, event_type string, value double").select(F.col("t").cast("timestamp").alias("ts"), "event_type", "value")
    assert [r["n"] for r in rolling_counts(events).collect()] == [2]


def test_rounding_is_pythons(spark):
    import random

    rng = random.Random(2)
    values = [2.675, 0.0005, 0.0015, 0.5, 1.0005, 2.5, 0.1235, 1e6 + 0.0005, -1.0015, 0.0, 0.062500, 0.3125, 0.4375] + [round(rng.uniform(0, 50), 4) for _ in range(3000)] + [rng.randrange(10**6) / 2000 for _ in range(2000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", rounded(F.col("v")).alias("r")).collect()
    assert [r["r"] for r in got] == [round(r["v"], 3) for r in got]


def test_deeply_nested_source_has_its_headings(spark):
    files = [("a.py", "-" * 100_000 + "1\n"), ("b.py", "(" * 5000 + ")" * 5000 + "\n# Heading\n"), ("c.py", "def f():\n    pass\n")]
    rows = symbols.symbols_of(symbols.scan_symbols(spark.createDataFrame(files, "path string, text string"))).collect()
    assert [(r["path"], r["name"]) for r in sorted(rows, key=lambda r: r["path"])] == [("b.py", "Heading"), ("c.py", "f")]


def test_leading_lines_from_the_head(spark):
    """The head of a text gives the same summary as all its lines, and a text that goes on is cut into lines only as far as that."""
    import random

    from pyspark.sql import functions as F

    from tessera.functions import text
    from tessera.operators import features

    rng = random.Random(5)
    pieces = [" ", "\n", "\r\n", "\r", "\t", "\x0b", "\x1c", "\x85", "\u2028", "\u00a0", "\x1f", "a", "b c", "word", "é", "😀", "x" * 50, " " * 90, "\n" * 90]
    texts = ["", " ", "\n", "a" * 1000, " " * 399 + "b" * 300, "a\n" * 500, "a" * 399 + "\r\n" + "b" * 9, "a" * 179 + " " * 300 + "b", "a\n" * 5 + " " * 500 + "tail\nb", "\n" * 1000 + "late"]
    texts += ["".join(rng.choices(pieces, k=rng.choice([3, 30, 300]))) for _ in range(300)]
    said = F.filter(F.transform(text.lines("t"), text.strip), lambda x: x != "")
    whole = F.substring(F.array_join(F.slice(said, 1, 6), " "), 1, 180)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", whole.alias("whole"), features.leading("t").alias("head")).collect()
    assert [r["head"] for r in rows] == [r["whole"] for r in rows]


def test_postings_of_some_terms(spark):
    from pyspark.sql import functions as F

    from tessera.operators import ranking

    d = spark.createDataFrame([("a", "k", ["x", "y", "x"]), ("b", "k", ["z"]), ("c", "m", []), ("d", "m", ["y", "z", "zz"])], "ref string, of string, tokens array<string>")
    rows = lambda df: sorted(map(tuple, df.select("term", "ref", "of", "length", "tf").collect()))
    assert rows(ranking.postings_of(["x", "z", "none", "x"], d, "of")) == rows(ranking.postings(d, "of").where(F.col("term").isin("x", "z"))) != []
    assert rows(ranking.postings_of([], d, "of")) == []


def test_stems_are_counted_in_slices(spark):
    """No more than a slice of texts is held as tokens, whatever the batch; counts and scores are those of whole token lists."""
    import pandas as pd
    from pyspark.sql import functions as F

    from tessera import session
    from tessera.functions import porter
    from tessera.operators import ranking

    texts = ["running runs ran", None, "", "Licenses license ÉTÉ été", "x" * 3_000_000, *["the trashed trash"] * 1200]
    parts = list(porter.slices(pd.Series(texts)))
    assert [t for p in parts for t in p] == texts and all(len(p) <= porter.SLICE_ROWS for p in parts)
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= porter.SLICE_CHARS for p in parts)
    assert [len(p) for p in porter.slices(pd.Series([], dtype=object))] == [0]
    session.reach_package(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= session.ARROW_ROWS
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = porter.tokens("license trash trashed run")
    whole = ranking.bm25(d.select("id", porter.stemmed("text").alias("tokens")), asked).select("id", F.size("tokens"), "bm25")
    own = sorted(set(asked))
    few = ranking.bm25_counted(d.select("id", porter.counted("text", own).alias("c")).select("id", "c.*"), asked, own).select("id", "length", "bm25")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.collect()))
