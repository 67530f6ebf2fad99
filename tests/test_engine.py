"""The scenarios of the engine over a small tree."""

import json
import os
import shutil
import time

import pytest

from tessera import store
from tessera.operators import symbols
from tessera.plans.engine import Engine

README = "# Demo\nA small demo project about accounts.\n"
APP = "def login_user(name: str) -> bool:\n    return bool(name)\n"
AUTH = "Authentication overview.\nLogin happens in src/app.py.\n"


@pytest.fixture
def tree(tmp_path):
    for path, body in {"README.md": README, "src/app.py": APP, "docs/auth.md": AUTH}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(body)
    return tmp_path


@pytest.fixture
def engine(spark, tree):
    e = Engine(spark, str(tree))
    e.index()
    return e


def test_index_and_overview(spark, tree):
    e = Engine(spark, str(tree))
    out = e.index()
    assert out["indexed_files"] == 3 and out["skipped_files"] == 0
    over = e.overview()
    assert "contains 3 indexed files" in over["summary"] and over["key_files"] == ["README.md"] and over["subsystems"]
    assert json.loads((e.store.state / "version.json").read_text())["app"] == "tessera"


def test_search_retrieve_pack_explain(engine):
    hits = engine.search("login auth")["results"]
    assert hits and {h["kind"] for h in hits} & {"function", "file", "section"}
    assert hits == sorted(hits, key=lambda h: (-h["score"], h["kind"], h["path"], h["name"]))
    assert engine.search("login auth")["results"] == hits
    assert engine.search("!!")["results"] == []
    context = engine.retrieve("where is login handled?", budget_tokens=400)
    assert context["code_chunks"] and context["evidence_refs"] and context["symbol_summaries"]
    assert context["token_estimate"] <= 400
    pack = engine.pack("login", budget_tokens=120)
    assert pack["used_tokens"] <= 120 and pack["sections"][0]["kind"] == "overview"
    assert sum(pack["stats"]["section_counts"].values()) == len(pack["sections"])
    said = engine.explain("login")
    assert said["evidence_refs"] and "login" in said["explanation"]
    assert "No indexed files matched" in engine.explain("zzzqqq")["explanation"]


def test_memories_go_stale(engine, tree):
    assert engine.remember("auth path", "Login logic is in src/app.py", ["src/app.py"])["memory_id"] == 1
    assert engine.remember("other", "nothing", [])["memory_id"] == 2
    found = engine.retrieve("auth path", budget_tokens=400)["memories"]
    assert [m["title"] for m in found] == ["auth path"] and found[0]["stale"] is False
    (tree / "src/app.py").write_text("def login_user(name: str) -> bool:\n    return bool(name and name.strip())\n")
    assert engine.refresh(["src/app.py"])["updated_files"] == 1
    assert engine.retrieve("auth path", budget_tokens=500)["memories"][0]["stale"] is True
    kinds = [e["kind"] for e in engine.timeline()["events"]]
    assert kinds.count("file_changed") == 3 and kinds.count("memory_added") == 2 and kinds.count("memory_stale") == 1
    assert engine.timeline(scope=["memory"])["event_count"] == 2
    assert engine.timeline(since="9999")["event_count"] == 0


def test_usages_locate_and_refresh(engine, tree):
    (tree / "src/models.py").write_text("class UserAccount:\n    name: str\n\nclass OrphanedType:\n    pass\n")
    (tree / "src/service.py").write_text("from models import UserAccount\n\ndef get_user() -> UserAccount:\n    return UserAccount()\n")
    assert engine.refresh()["updated_files"] == 5
    used = engine.find_usages("UserAccount")["results"][0]
    assert not used["is_unused"] and used["usage_count"] == 1 and used["references"][0]["path"] == "src/service.py"
    unused = engine.find_usages("OrphanedType")["results"][0]
    assert unused["is_unused"] and unused["usage_count"] == 0
    nothing = engine.find_usages("NonExistentSymbol")
    assert nothing["results"] == [] and "error" in nothing
    at = engine.locate_symbol_range("UserAccount")["matches"][0]
    assert (at["file"], at["line_start"], at["line_end"], at["byte_start"], at["byte_end"], at["score"]) == ("src/models.py", 1, 2, 0, 33, 1.0)
    assert engine.locate_symbol_range("UserAccount", file="docs/*")["match_count"] == 0
    # a refresh of one file leaves the same index as a full one
    full = {t: sorted(map(str, engine.store.read(t).drop("updated_at").collect())) for t in ("files", "symbols", "chunks", "relations", "subsystems")}
    engine.refresh(["src/service.py"])
    assert full == {t: sorted(map(str, engine.store.read(t).drop("updated_at").collect())) for t in full}
    os.remove(tree / "src/models.py")
    assert engine.refresh(["src/models.py"])["deleted_files"] == 1
    assert engine.find_usages("UserAccount")["results"] == []


def test_unchanged_files_keep_their_time(engine):
    before = {r["path"]: r["updated_at"] for r in engine.store.read("files").collect()}
    time.sleep(0.01)
    engine.index()
    assert before == {r["path"]: r["updated_at"] for r in engine.store.read("files").collect()}


def test_capture(engine, tree):
    source = tree / "notes.json"
    source.write_text(json.dumps([{"title": "A", "summary": "one"}, {"summary": "x"}, {"title": "B"}, 7, {"title": "A", "summary": "two"}]))
    dry = engine.capture(str(source), "json")
    assert dry["dry_run"] and [w["title"] for w in dry["written"]] == ["A", "A"] and {s["reason"] for s in dry["skipped"]} == {"missing_title", "missing_summary"}
    done = engine.capture(str(source), "json", commit=True)
    assert [w["memory_id"] for w in done["written"]] == [1] and "duplicate_title" in {s["reason"] for s in done["skipped"]}
    with pytest.raises(ValueError):
        engine.capture(str(source), "yaml")


def test_capture_sessions(engine, tree):
    events = [
        {"sessionId": "s1", "timestamp": "2024-01-02T00:00:00Z", "type": "user", "message": {"content": "Fix the login\nplease"}},
        {"sessionId": "s1", "timestamp": "2024-01-02T00:01:00Z", "type": "assistant", "message": {"content": [{"type": "text", "text": "Done."}, {"type": "tool_use", "input": {"file_path": "./src/app.py", "command": "cat ./docs/auth.md"}}]}},
        {"sessionId": "s2", "type": "assistant", "message": {"content": []}},
    ]
    source = tree / "log.jsonl"
    source.write_text("\n".join([json.dumps(events[0]), "not json", json.dumps(events[1]), "", json.dumps(events[2])]))
    out = engine.capture(str(source), "claude-jsonl")
    assert [w["title"] for w in out["written"]] == ["Session 2024-01-02: Fix the login"]
    assert out["written"][0]["evidence_refs"] == ["file:docs/auth.md", "file:src/app.py"]
    assert "Assistant: Done." in out["written"][0]["summary"] and out["skipped"][0]["reason"] == "invalid_jsonl_line"
    assert out["skipped"][0]["context"] == {"error": "Expecting value: line 1 column 1 (char 0)"}


def test_policy_and_evaluation(spark, tree):
    engine = Engine(spark, str(tree))
    (tree / ".tessera/config.json").write_text(json.dumps({"role_overrides": {"docs/*": "model"}, "extra_excludes": ["src"], "include_overrides": ["src/app.py"], "ranking_v2": False, "retrieval_defaults": {"limit": 1}}))
    (tree / "src/skip.py").write_text("x = 1\n")
    assert engine.index()["indexed_files"] == 3
    assert {r["path"]: r["role"] for r in engine.store.read("files").collect()}["docs/auth.md"] == "model"
    assert len(engine.search("login")["results"]) == 1
    out = engine.evaluate([{"query": "login", "expected_refs": ["src/app.py", "gone.py"]}, {"query": "zzzqqq"}])
    assert out["queries_run"] == 2 and out["results"][0]["precision"] in (0.0, 0.5) and not out["results"][1]["pass"]


def test_encoder(spark, tree):
    e = Engine(spark, str(tree), encoder=lambda texts: [[1.0, 0.0] if "login" in t.lower() else [0.0, 1.0] for t in texts])
    e.index()
    plain = Engine(spark, str(tree))
    score = lambda x: {r["ref"]: r["score"] for r in x.search_df("login").collect()}
    with_, without = score(e), score(plain)
    assert with_["symbol:src/app.py:login_user:1"] > without["symbol:src/app.py:login_user:1"]
    assert e.store.read("embeddings").count() == e.store.read("files").count() + e.store.read("symbols").count() + e.store.read("subsystems").count()


def test_refresh_parses_and_rewrites_only_what_changed(engine, tree, monkeypatch):
    for i in range(40):
        (tree / f"src/m{i}.py").write_text(f"def helper_{i}():\n    return {i}\n")
    assert engine.refresh()["updated_files"] == 43
    parsed, real = [], symbols.scan_symbols

    def counted(contents, policy=None):  # noqa: ANN001, ANN202
        parsed.extend(r["path"] for r in contents.select("path").collect())
        return real(contents, policy)

    monkeypatch.setattr(symbols, "scan_symbols", counted)
    before = engine.store.manifest["tables"]
    (tree / "src/m7.py").write_text("def helper_7():\n    return 'other'\n\ndef newcomer():\n    return helper_7()\n")
    assert engine.refresh()["updated_files"] == 43 and parsed == ["src/m7.py"]
    after = engine.store.manifest["tables"]
    for name in ("contents", "files", "symbols", "chunks", "postings"):
        assert sum(after[name][b] != before[name].get(b) for b in after[name]) == 1
    assert engine.search("newcomer")["results"][0]["name"] == "newcomer"
    parsed.clear()
    assert engine.refresh(["src/m7.py"])["updated_files"] == 1 and parsed == [] and engine.store.manifest["tables"] == after
    full = {t: sorted(map(str, engine.store.read(t).drop("updated_at").collect())) for t in ("files", "symbols", "chunks", "relations", "subsystems", "postings", "lengths")}
    shutil.rmtree(engine.store.state)
    again = Engine(engine.spark, str(tree))
    again.index()
    assert full == {t: sorted(map(str, again.store.read(t).drop("updated_at").collect())) for t in full}


def test_old_folders_stay_for_readers(engine, tree):
    plan = engine.store.read("files")
    (tree / "src/app.py").write_text("def other():\n    pass\n")
    engine.refresh()
    assert plan.count() == 3  # a plan made before the refresh still reads


def test_one_writer_at_a_time(spark, engine, monkeypatch):
    monkeypatch.setattr(store, "BUSY_SECONDS", 0.2)
    other = Engine(spark, str(engine.store.root))
    with engine.store.writing(), pytest.raises(TimeoutError):
        other.remember("a", "b")
    assert other.remember("a", "b")["memory_id"] == 1


def test_recall_appends(engine):
    engine.remember("auth path", "Login logic is in src/app.py", ["src/app.py"])
    written = engine.store.manifest["tables"]["memories"]
    first = engine.timeline()["events"]
    engine.clock = lambda: "2999-01-01T00:00:00+00:00"
    engine.pack("auth path", budget_tokens=300)
    assert engine.store.manifest["tables"]["memories"] == written and first
    assert [r["last_validated_at"] for r in engine._memories().collect()] == ["2999-01-01T00:00:00+00:00"]


def test_missing_root(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Engine(spark, str(tmp_path / "none"))


def moved_rows(spark, seen):
    sc = spark.sparkContext
    listed = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    new = [x for x in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(listed) if x.stageId() not in seen]
    seen.update(x.stageId() for x in new)
    return sum(x.shuffleWriteRecords() for x in new)


def test_usages_move_no_pairs(spark, monkeypatch):
    """300 symbols of a name and 300 files that say it: 90,000 pairs, of which none goes through a shuffle; homes, relations and imports are left out exactly."""
    from pyspark.sql import functions as F

    from tessera.plans import engine as plans

    monkeypatch.setattr(plans, "BLOCK", 7, raising=False)
    monkeypatch.setattr(plans, "BROADCAST_IDS", 100, raising=False)
    n, at = 300, spark.range(300).select("id", F.concat(F.lit("d/f"), F.col("id").cast("string")).alias("path"))
    symbol = F.concat(F.lit("symbol:"), "path", F.lit(":trash:1"))
    own = at.select(symbol.alias("symbol_id"), "path", F.lit("trash").alias("name"))
    # the first chunk of an even file doesn't say the name; at line 9 two chunks do
    said = lambda line, what: at.select(F.concat("path", F.lit(f":{line}-{what}")).alias("chunk_id"), "path", F.lit(line).alias("line_start"), F.when((F.col("id") % 2 == 0) & (F.lit(line) == 1), "no trashes").otherwise(f"a\n trash {what}").alias("text"))
    chunks = said(1, 1).unionByName(said(9, 2)).unionByName(said(9, 3))
    i = F.col("id")
    edge = lambda df, s, t, kind: df.select(s.alias("source_ref"), t.alias("target_ref"), F.lit(kind).alias("relation_type"), F.lit(1.0).alias("weight"))
    ref = lambda k, head, tail: F.concat(F.lit(head + "d/f"), k.cast("string"), F.lit(tail))
    relations = edge(at, ref((i + 1) % n, "symbol:", ":x:1"), symbol, "references").unionByName(edge(at, ref((i + 1) % n, "symbol:", ":y:2"), symbol, "references")).unionByName(edge(at, ref((i + 2) % n, "file:", ""), ref(i, "file:", ""), "imports")).unionByName(edge(at, ref((i + 1) % n, "file:", ""), ref(i, "file:", ""), "imports"))
    postings = chunks.select(F.lit("trash").alias("term"), F.concat(F.lit("chunk:"), "chunk_id").alias("ref"), F.lit("chunk").alias("of"))
    e = Engine(spark, store.Tables(spark, "t", {"symbols": own, "chunks": chunks, "relations": relations, "postings": postings}))
    want = {}
    for s in range(n):
        for p in (k for k in range(n) if k != s):
            one = (2, None, 9, "trash 2", "fts") if p % 2 == 0 else (2, None, 1, "trash 1", "fts")
            one = (1, "imports", None, None, "relation") if p == (s + 2) % n and p % 2 else one
            want[f"symbol:d/f{s}:trash:1", f"d/f{p}"] = [(0, "references", None, None, "relation")] * 2 if p == (s + 1) % n else [one]
    seen: set[int] = set()
    moved_rows(spark, seen)
    got: dict = {}
    for r in e.usages_df("trash").select("symbol_id", "path", "ord", "relation_type", "line", "context", "source").toLocalIterator():
        got.setdefault((r[0], r[1]), []).append(tuple(r[2:]))
    assert got == want
    assert moved_rows(spark, seen) < 20_000
    assert {r["path"] for r in e.usages_df("trash", "d/f12").collect()} == {f"d/f{k}" for k in (12, *range(120, 130))}
    assert e.usages_df("none").collect() == []


def test_explain_reads_subsystems_twice(engine, monkeypatch):
    """Once for the overview with the leading one, and once for the hits."""
    want, read, names = engine.explain("login"), engine.store.read, []
    engine.store.clear_cache()
    monkeypatch.setattr(engine.store, "read", lambda name, *rest: (names.append(name), read(name, *rest))[1])
    got = engine.explain("login")
    assert {k: v for k, v in got.items() if k != "elapsed_ms"} == {k: v for k, v in want.items() if k != "elapsed_ms"}
    assert names.count("subsystems") == 2


def test_search_takes_sizes_and_counts_of_both_kinds_at_once(engine, monkeypatch):
    read, names = engine.store.read, []
    monkeypatch.setattr(engine.store, "read", lambda name, *rest: (names.append(name), read(name, *rest))[1])
    found = {r["ref"]: r["bm25"] for r in engine._bm25(["login", "login"]).collect()}
    assert names.count("lengths") == names.count("postings") == 1
    assert any(r.startswith("file:") for r in found) and any(r.startswith("symbol:") for r in found)
    assert engine._bm25([]).collect() == [] and engine._bm25(["zzzqqq"]).collect() == []
