"""The verbs over one tree's index. Each is a composition of the operators; rows reach the driver only as a response."""

from __future__ import annotations

import functools
import hashlib
import json
import time
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import __version__, config
from tessera.functions import paths, text
from tessera.functions.numbers import rounded
from tessera.functions.porter import stemmed, tokens
from tessera.operators import budget, features, graph, memory, merge, ranking, symbols, vector
from tessera.operators.features import first_rows
from tessera.session import reach_package
from tessera.sources import capture as notes
from tessera.sources import tree
from tessera.store import Store, Tables, bucket_of

#: Symbol ids of a block that a mention meets at once, and of one broadcast.
BLOCK = 1000
BROADCAST_IDS = 200_000
#: Subsystems of an overview.
OVERVIEW_SUBSYSTEMS = 8
HIT = ["ref", "path", "name", "kind", "role", "language", "score", "summary"]


def now() -> str:
    return datetime.now(UTC).isoformat()


def plain(rows: list) -> list[dict]:
    return [r.asDict(recursive=True) for r in rows]


class Engine:
    """One tree. ``encoder`` (texts -> unit vectors) turns semantic scores on; without it they are 0."""

    def __init__(self, spark: SparkSession, root: str | Tables, encoder: vector.Encoder | None = None, model: str = "default", clock=now) -> None:  # noqa: ANN001
        reach_package(spark)
        store = root if isinstance(root, Tables) else Store(spark, root)
        self.spark, self.store, self.encoder, self.model, self.clock = spark, store, encoder, model, clock

    @property
    def policy(self) -> config.Policy:
        return config.Policy.load(self.store.state / "config.json")

    # Building

    def index(self) -> dict[str, Any]:
        began = time.perf_counter()
        with self.store.writing():
            names = list(tree.listed(self.store.root, self.policy))
            fresh = tree.read_files(self.spark, self.store.root, names)
            self._take_in(fresh, merge.missing(self.store.read("files"), fresh, "path"))
            indexed = self.store.read("files").count()
            self.store.set_meta(last_indexed_at=self.clock(), schema_version=config.SCHEMA_VERSION, repo_root=str(self.store.root))
            self.store.clear_cache()
            self.store.write_version("tessera", __version__)
        return {"repo_root": str(self.store.root), "indexed_files": indexed, "skipped_files": len(names) - indexed, "state_dir": str(self.store.state), "db_path": str(self.store.state / "manifest.json"), "elapsed_ms": ms(began)}

    def refresh(self, changed: list[str] | None = None) -> dict[str, Any]:
        """Take in the given files, or all. The result is that of a full index of the tree as the index knows it then.

        Given files are held against the admission rules only. Only files of another hash are parsed, and only their buckets of the tables are rewritten;
        edges are resolved anew from all files' stored imports, so a refresh never loses any.
        """
        began = time.perf_counter()
        with self.store.writing():
            known = self.store.read("files").select("path")
            if changed is None:
                fresh = tree.scan(self.spark, self.store.root, self.policy)
                gone = merge.missing(known, fresh, "path")
            else:
                names = [p.removeprefix("./") for p in dict.fromkeys(changed)]
                fresh = tree.read_files(self.spark, self.store.root, names)
                asked = self.spark.createDataFrame([(n,) for n in names], "path string")
                gone = merge.missing(asked, fresh, "path").join(known, "path", "left_semi")
            updated, deleted = self._take_in(fresh, gone)
            self.store.set_meta(last_refreshed_at=self.clock())
            self.store.clear_cache()
        return {"repo_root": str(self.store.root), "updated_files": updated, "deleted_files": deleted, "state_dir": str(self.store.state), "elapsed_ms": ms(began)}

    def _take_in(self, fresh: DataFrame, gone: DataFrame) -> tuple[int, int]:
        """Put the files of ``fresh`` (path, text) into the index and take those of ``gone`` out. How many were looked at, and how many left.

        Files whose hash is stored already keep their rows and are not parsed.
        """
        store, seen = self.store, fresh.withColumn("hash", F.sha2("text", 256))
        with store.staged("fresh", seen) as seen, store.staged("gone", gone) as gone:
            known = store.read("files").select("path", "hash")
            changed = seen.join(known, ["path", "hash"], "left_anti").select("path", "text")
            out = changed.select("path").unionByName(gone.select("path")).distinct()
            touched = sorted(r["b"] for r in out.select(bucket_of("path").alias("b")).distinct().collect())
            updated, deleted = seen.count(), gone.count()
            if touched:
                with store.staged("scanned", symbols.scan_symbols(changed, self.policy)) as scanned:
                    own = symbols.symbols_of(scanned)
                    new = {
                        "contents": changed, "files": features.file_features(changed, self.policy, self.clock()), "symbols": own, "chunks": features.chunks_of(changed, own),
                        "imports": features.imports_of(changed).withColumn("path", F.substring("source_ref", 6, 1 << 30)),
                        "mentions": symbols.references_of(scanned),
                    }
                    with store.staged("words", words_of(new["files"], own, new["chunks"])) as said:
                        new["postings"] = ranking.postings(said, "of", "path")
                        new["lengths"] = said.select("ref", "of", F.size("tokens").alias("length"), "path")
                        kept = {n: store.read(n, touched).join(out, "path", "left_anti") for n in new}
                        store.replace_buckets(touched, {"postings": "term"}, **{n: kept[n].unionByName(rows.select(kept[n].columns)) for n, rows in new.items()})
        if touched or "relations" not in store.manifest["tables"]:
            files = store.read("files")
            edges = graph.resolve_imports(store.read("imports").drop("path"), files).unionByName(store.read("mentions").drop("path"))
            store.write(relations=edges, subsystems=features.subsystems_of(files, store.read("symbols")))
        self._embed()
        return updated, deleted

    def _bm25(self, words: list[str]) -> DataFrame:
        """ref, bm25 of the files and of the symbols that hold a word, from their postings. Sizes and document counts are taken of both kinds at once."""
        kinds = ["file", "symbol"]
        of = F.col("of").isin(kinds)
        sizes = {r["of"]: r for r in self.store.read("lengths").where(of).groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).collect()}
        hits = self.store.postings(sorted(set(words))).where(of)
        counts: dict[str, dict[str, int]] = {k: {} for k in kinds}
        for r in hits.groupBy("of", "term").agg(F.count(F.lit(1)).alias("n")).collect():
            counts[r["of"]][r["term"]] = r["n"]
        size = lambda k: (sizes[k]["n"], sizes[k]["mean"] or 0.0) if k in sizes else (0, 0.0)
        return functools.reduce(DataFrame.unionByName, [ranking.bm25_from_postings(hits.where(F.col("of") == k), words, *size(k), counts[k]) for k in kinds])

    # Vectors

    def _embed(self) -> None:
        if self.encoder is None:
            return
        f, s, u, m = (*(self.store.read(t) for t in ("files", "symbols", "subsystems")), self._memories())
        named = lambda df, ref, *said: df.select(ref.alias("ref"), F.concat_ws(" ", *said).alias("text"))
        wanted = named(f, F.concat(F.lit("file:"), "path"), "path", "summary").unionByName(named(s, F.col("symbol_id"), "name", "kind", "summary")).unionByName(named(u, F.concat(F.lit("subsystem:"), "name"), "name", "summary")).unionByName(named(m, F.concat(F.lit("memory:"), F.col("memory_id").cast("string")), "title", "summary"))
        stored = self.store.read("embeddings")
        todo = vector.delta(wanted, stored, self.model)
        encode, model, at = self.encoder, self.model, self.clock()

        def run(batches):  # noqa: ANN001, ANN202
            import pyarrow as pa

            for b in batches:
                vectors = encode(b.column(1).to_pylist())
                yield pa.record_batch([b.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array([model] * b.num_rows), b.column(2), pa.array([at] * b.num_rows)], names=["ref", "vector", "model", "content_hash", "created_at"])

        fresh = todo.select("ref", "text", "content_hash").mapInArrow(run, "ref string, vector array<float>, model string, content_hash string, created_at string")
        kept = vector.pruned(stored, wanted).join(todo.select("ref"), "ref", "left_anti")
        self.store.write(embeddings=kept.unionByName(fresh))

    def _semantic(self, query: str, memories: bool = False) -> DataFrame:
        empty = self.spark.createDataFrame([], "ref string, semantic double")
        if self.encoder is None:
            return empty
        own = self.store.read("embeddings").where((F.col("model") == self.model) & (F.col("ref").startswith("memory:") if memories else F.lit(True)))
        return vector.cosine_scores(own, self.encoder([query])[0]).select("ref", "semantic")

    # Reading

    def overview(self) -> dict[str, Any]:
        return self._overview()[0]

    def _leading_subsystems(self, low: str | None) -> tuple[list[str], list[str]]:
        """Summaries of the first subsystems, and of the first that has ``low`` in its name or summary, from one job over the same rows."""
        subs, order = self.store.read("subsystems"), [F.desc("file_count"), F.col("name")]
        rows = subs.orderBy(*order).limit(OVERVIEW_SUBSYSTEMS).withColumn("what", F.lit(0))
        if low is not None:
            match = subs.where(F.lower("name").contains(low) | F.lower("summary").contains(low))
            rows = rows.unionByName(match.orderBy(*order).limit(1).withColumn("what", F.lit(1)))
        rows = rows.orderBy("what", *order).collect()
        return [r["summary"] for r in rows if r["what"] == 0], [r["summary"] for r in rows if r["what"] == 1]

    def _overview(self, low: str | None = None) -> tuple[dict[str, Any], list[str]]:
        """The overview, and the summary of the first subsystem that has ``low``, if any."""
        files = self.store.read("files")
        count = lambda by: {r[by]: r["n"] for r in features.overview_counts(files, by).collect()}
        languages, roles = count("language"), count("role")
        keys = [r["path"] for r in files.where(F.col("path").isin(config.ROOT_FILES)).orderBy("path").select("path").collect()]
        dirs = files.groupBy(features.top_dir("path").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(5).collect()
        listed = lambda pairs, none="": ", ".join(f"{k} ({n})" for k, n in pairs) or none
        summary = (
            f"Repository {self.store.root.name} contains {sum(roles.values())} indexed files. Top languages: {listed(list(languages.items())[:3], 'no detected languages')}. "
            f"Top roles: {listed(list(roles.items())[:3], 'no roles detected')}. Primary directories: {listed([(r['d'], r['n']) for r in dirs])}. Key root files: {', '.join(keys) or 'none'}."
        )
        subs, lead = self._leading_subsystems(low)
        return {"repo_root": str(self.store.root), "summary": summary, "languages": languages, "roles": roles, "key_files": keys, "subsystems": subs}, lead

    def search_df(self, query: str, kind: str | None = None) -> DataFrame:
        """All hits with their scores, unordered."""
        asked, second = text.query_terms(query), self.policy.ranking_v2
        at = F.lit(self.clock()).cast("timestamp")
        words = tokens(" ".join(text.query_words(query)))
        full = ranking.normalized(self._bm25(words).where("bm25 > 0"), "bm25")
        semantic = self._semantic(query)

        def extra(df: DataFrame):  # noqa: ANN202
            return df.join(full, "ref", "left").join(semantic, "ref", "left").withColumn("more", F.coalesce("bm25", F.lit(0.0)) + config.SEMANTIC_WEIGHT * F.coalesce("semantic", F.lit(0.0)))

        files, own, subs = self.store.read("files"), self.store.read("symbols"), self.store.read("subsystems")
        f = extra(files.withColumn("ref", F.concat(F.lit("file:"), "path")))
        score = (ranking.file_score(asked) + F.col("more")) * ranking.role_boost(F.col("role"))
        score = score * ranking.recency(F.col("updated_at"), at) if second else score
        f = f.select("ref", "path", paths.name_of("path").alias("name"), F.lit("file").alias("kind"), "role", "language", ranking.soft_kind(score, F.col("role"), F.col("language"), kind).alias("score"), "summary").where("score > 0")
        s = extra(own.withColumn("ref", F.col("symbol_id"))).withColumn("base", ranking.symbol_score(asked) + F.col("more")).where("base > 0")
        s = s.join(files.select("path", F.col("role").alias("r"), "updated_at"), "path", "left").withColumn("role", F.coalesce("r", F.lit("source")))
        score = (F.col("base") + config.SYMBOL_BASE) * ranking.role_boost(F.col("role"))
        score = score * ranking.kind_boost(F.col("kind")) * ranking.recency(F.col("updated_at"), at) if second else score
        s = s.select("ref", "path", "name", "kind", "role", F.lit("symbol").alias("language"), score.alias("score"), "summary")
        u = subs.withColumn("ref", F.concat(F.lit("subsystem:"), "name")).join(semantic, "ref", "left")
        base = text.overlap(text.terms(F.concat_ws(" ", "name", "summary")), asked) + config.SEMANTIC_WEIGHT * F.coalesce("semantic", F.lit(0.0))
        one = F.lit("subsystem")
        u = u.withColumn("base", base).where("base > 0").select("ref", F.col("name").alias("path"), "name", one.alias("kind"), one.alias("role"), one.alias("language"), (F.col("base") + config.SUBSYSTEM_BASE).alias("score"), "summary")
        hits = f.unionByName(s).unionByName(u).withColumn("score", rounded(F.col("score")))
        if not second:
            return hits
        bonus = graph.proximity(self.store.read("relations"), hits.select("ref"))
        boosted = F.when(F.coalesce("bonus", F.lit(0.0)) != 0, rounded(graph.boosted(F.col("score"), F.col("bonus")))).otherwise(F.col("score"))
        return hits.join(bonus, "ref", "left").withColumn("score", boosted).drop("bonus")

    def search(self, query: str, kind: str | None = None, limit: int | None = None) -> dict[str, Any]:
        began = time.perf_counter()
        if not text.query_terms(query):
            return {"results": [], "elapsed_ms": 0}
        limit = self.policy.limit(limit)
        key = digest("search", query, kind, limit, self.policy.ranking_v2)
        if (known := self.store.cached(key)) is not None:
            return known
        rows = graph.best_of(self.search_df(query, kind)).orderBy(F.desc("score"), "kind", "path", "name").limit(limit).select(HIT).collect()
        out = {"results": plain(rows), "elapsed_ms": ms(began)}
        self.store.cache(key, query, out)
        return out

    def related_df(self, hits: list[dict]) -> DataFrame:
        """Hits and the neighbours of the first four, one row a ref, with rank."""
        rows = self.spark.createDataFrame([tuple(h[c] for c in HIT) for h in hits], "ref string, path string, name string, kind string, role string, language string, score double, summary string")
        lead = self.spark.createDataFrame([(h["ref"],) for h in hits[:4]], "ref string")
        near = graph.neighbors(self.store.read("relations"), lead).select(F.col("neighbor").alias("ref"), "relation_type", "weight")
        said = F.lit("related")
        tail = F.array_join(F.slice(F.split("ref", ":", 3), 3, 1), "")
        path = F.when(tail != "", tail).otherwise(F.substring_index("ref", ":", -1))
        near = near.select("ref", path.alias("path"), F.substring_index("ref", ":", -1).alias("name"), said.alias("kind"), said.alias("role"), said.alias("language"), F.col("weight").alias("score"), F.concat(F.lit("Related via "), "relation_type").alias("summary"))
        return first_rows(rows.unionByName(near), ["ref"], [F.desc("score"), "kind"], 1)

    def materialized_df(self, related: DataFrame) -> DataFrame:
        """ref, score, what, summary, payload and chunks (array, in order) of each result that the index knows."""
        files, own, subs, chunks = (self.store.read(t) for t in ("files", "symbols", "subsystems", "chunks"))
        piece = F.struct("chunk_id", "path", "line_start", "line_end", "text", "summary", "token_estimate")
        none = F.lit(None).cast("struct<symbol_id:string,path:string,name:string,kind:string,signature:string,summary:string>")
        r = related.select("ref", "path", "score")
        by_symbol = chunks.where("symbol_id IS NOT NULL").groupBy("symbol_id").agg(F.array_sort(F.collect_list(F.struct("line_start", piece.alias("c")))).alias("k"))
        wanted = lambda df, col: df.select(F.col(col).alias("key"), "score", F.col("ref").alias("hit"))
        s = wanted(r.where(F.col("ref").startswith("symbol:")), "ref").join(own, F.col("key") == own["symbol_id"]).select("hit", "score", F.lit("symbol").alias("what"), "summary", F.struct("symbol_id", "path", "name", "kind", "signature", "summary").alias("payload"), "symbol_id").join(by_symbol, "symbol_id", "left").select("hit", "score", "what", "summary", "payload", F.coalesce(F.col("k.c"), F.array()).alias("chunks"))
        two = first_rows(chunks, ["path"], ["token_estimate", "line_start"], 2)
        by_path = two.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("token_estimate", "line_start", piece.alias("c")))).alias("k"))
        path = F.when(F.col("ref").startswith("file:"), F.substring("ref", 6, 1 << 30)).otherwise(F.col("path"))
        f = wanted(r.where(~F.col("ref").startswith("symbol:") & ~F.col("ref").startswith("subsystem:")).withColumn("p", path), "p").join(files.select(F.col("path").alias("key"), "summary"), "key").join(by_path.withColumnRenamed("path", "key"), "key", "left")
        f = f.select("hit", "score", F.lit("file").alias("what"), F.concat("key", F.lit(": "), "summary").alias("summary"), none.alias("payload"), F.coalesce(F.col("k.c"), F.array()).alias("chunks"))
        u = wanted(r.where(F.col("ref").startswith("subsystem:")).withColumn("n", F.substring("ref", 11, 1 << 30)), "n").join(subs.withColumnRenamed("name", "key"), "key")
        least = u.select("hit", F.explode("representative_paths").alias("path")).join(two, "path")
        least = first_rows(least, ["hit"], ["token_estimate", "path", "line_start"], 2).groupBy("hit").agg(F.array_sort(F.collect_list(F.struct("token_estimate", "path", "line_start", piece.alias("c")))).alias("k"))
        u = u.join(least, "hit", "left").select("hit", "score", F.lit("subsystem").alias("what"), "summary", none.alias("payload"), F.coalesce(F.col("k.c"), F.array()).alias("chunks"))
        return s.unionByName(f).unionByName(u).withColumnRenamed("hit", "ref")

    def memories_df(self, query: str) -> DataFrame:
        m = self._with_staleness()
        semantic = self._semantic(query, memories=True).select(F.substring("ref", 8, 30).cast("long").alias("memory_id"), "semantic") if self.encoder else None
        return memory.recall(m, text.query_terms(query), semantic)

    def _memories(self) -> DataFrame:
        """The memories, each validated last when it was recalled last."""
        last = self.store.read("validations").groupBy("memory_id").agg(F.max("validated_at").alias("v"))
        m = self.store.read("memories")
        return m.join(last, "memory_id", "left").withColumn("last_validated_at", F.greatest("last_validated_at", "v")).select(m.columns)

    def _with_staleness(self) -> DataFrame:
        return memory.with_staleness(self._memories(), memory.evidence_table(*(self.store.read(t) for t in ("files", "symbols", "chunks"))))

    def _recalled(self, query: str) -> list[dict]:
        """Memories for a query. Fresh ones count as validated now: a few rows are appended, the memories stay as they are."""
        rows = plain(self.memories_df(query).select("memory_id", "title", "summary", "evidence_refs", "created_at", "stale", "last_validated_at").collect())
        at, fresh = self.clock(), [r["memory_id"] for r in rows if not r["stale"]]
        if fresh and isinstance(self.store, Store):
            self.store.append("validations", self.spark.createDataFrame([(i, at) for i in fresh], "memory_id long, validated_at string"))
        return [r | ({"last_validated_at": at} if not r["stale"] else {}) for r in rows]

    def retrieve(self, query: str, budget_tokens: int | None = None, scope: str | None = None) -> dict[str, Any]:
        began = time.perf_counter()
        most = self.policy.budget(budget_tokens)
        key = digest("retrieve", query, most, scope, self.policy.ranking_v2)
        if (known := self.store.cached(key)) is not None:
            return known
        over = self.overview()
        used = estimate(over["summary"])
        subs = []
        for s in over["subsystems"][:3]:
            if used + estimate(s) > most:
                break
            subs.append(s)
            used += estimate(s)
        hits = self.search(query, kind=scope, limit=10)["results"]
        said, chunks = [], []
        if hits:
            from pyspark.sql import Window

            found = self.materialized_df(self.related_df(hits)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ref"))).cache()
            sized = found.select("rank", text.token_estimate("summary").alias("cost"), F.col("chunks.token_estimate").alias("chunks"))
            fit = budget.nested_break(sized, most, used).first()
            used, kept = fit["used"], {k["rank"]: k["n"] for k in fit["kept"]}
            for r in found.where(F.col("rank").isin(list(kept))).orderBy("rank").collect() if kept else []:
                said.append(r["payload"].asDict() if r["what"] == "symbol" else r["summary"])
                chunks += plain(r["chunks"][: kept[r["rank"]]])
            found.unpersist()
        memories = []
        for m in self._recalled(query):
            if used + estimate(m["summary"]) > most:
                break
            memories.append(m)
            used += estimate(m["summary"])
        out = {
            "repo_summary": over["summary"], "subsystem_summaries": subs, "symbol_summaries": said, "code_chunks": chunks, "memories": memories,
            "evidence_refs": [{k: c[k] for k in ("path", "chunk_id", "line_start", "line_end")} for c in chunks], "token_estimate": used, "elapsed_ms": ms(began),
        }
        self.store.cache(key, query, out)
        return out

    def pack(self, query: str, budget_tokens: int | None = None, scope: str | None = None) -> dict[str, Any]:
        began = time.perf_counter()
        most, over = self.policy.budget(budget_tokens), self.overview()
        hits = self.search(query, kind=scope, limit=config.PACK_HITS)["results"]
        sections = [("overview", 1000.0, [], over["summary"]), *(("subsystem_summary", 900.0 - i, [], s) for i, s in enumerate(over["subsystems"][: config.PACK_SUBSYSTEMS]))]
        own, chunks = self.store.read("symbols"), self.store.read("chunks")
        ids = [h["ref"] for h in hits if h["ref"].startswith("symbol:")]
        files = [h["path"] for h in hits if h["ref"].startswith("file:")]
        signed = {r["symbol_id"]: r for r in own.where(F.col("symbol_id").isin(ids)).select("symbol_id", "signature", "summary").collect()} if ids else {}
        by_symbol, by_path = {}, {}
        for r in chunks.where(F.col("symbol_id").isin(ids)).orderBy("line_start").collect() if ids else []:
            by_symbol.setdefault(r["symbol_id"], []).append(r)
        for r in first_rows(chunks.where(F.col("path").isin(files)), ["path"], ["token_estimate", "line_start"], 2).orderBy("token_estimate", "line_start").collect() if files else []:
            by_path.setdefault(r["path"], []).append(r)
        refs: set[str] = set(ids)
        for h in hits:
            if s := signed.get(h["ref"]):
                sections.append(("symbol", h["score"], [h["ref"]], f"{s['signature']}\n{s['summary']}" if s["signature"] else s["summary"]))
            found = by_symbol.get(h["ref"], []) if h["ref"].startswith("symbol:") else by_path.get(h["path"], []) if h["ref"].startswith("file:") else []
            for c in found:
                sections.append(("chunk", round(h["score"] * (0.9 if h["ref"].startswith("symbol:") else 1), 3), [f"chunk:{c['chunk_id']}"], c["text"]))
                refs |= {f"file:{c['path']}"} | ({c["symbol_id"]} if c["symbol_id"] else set())
        for m in self._recalled(query):
            sections.append(("memory", 0.5 if m["stale"] else 7.0, list(m["evidence_refs"]) or [f"memory:{m['memory_id']}"], f"{m['title']}: {m['summary']}"))
            refs |= {r for r in m["evidence_refs"] if r.startswith("symbol:")}
        if refs:
            within = graph.endpoints(self.store.read("relations"), self.spark.createDataFrame([(r,) for r in sorted(refs)], "ref string"))
            for e in within.orderBy(F.desc("weight"), "source_ref", "target_ref").limit(config.PACK_EDGES).collect():
                sections.append(("edge", round(0.3 * e["weight"], 3), [e["source_ref"], e["target_ref"]], f"{e['source_ref']} -[{e['relation_type']}]-> {e['target_ref']}"))
        rows = self.spark.createDataFrame([(i, k, float(s), r, b) for i, (k, s, r, b) in enumerate(sections)], "ord long, kind string, score double, evidence_refs array<string>, body string")
        packed = self.packed_df(rows, most).orderBy("rank").collect()
        kept = [{"kind": r["kind"], "score": r["score"], "evidence_refs": r["evidence_refs"], "tokens": r["tokens"], "body": r["body"]} for r in packed if r["kept"]]
        counts: dict[str, int] = {}
        for k in kept:
            counts[k["kind"]] = counts.get(k["kind"], 0) + 1
        dropped = [{"kind": r["kind"], "score": r["score"], "tokens": r["tokens"], "reason": "budget_exhausted"} for r in packed if not r["kept"]]
        return {"query": query, "repo_root": str(self.store.root), "budget_tokens": most, "used_tokens": sum(k["tokens"] for k in kept), "sections": kept, "stats": {"dropped": dropped, "elapsed_ms": ms(began), "ranking_v2": self.policy.ranking_v2, "section_counts": counts}}

    @staticmethod
    def packed_df(sections: DataFrame, most: int) -> DataFrame:
        """Sections (ord, kind, score, evidence_refs, body) in their order, each body once a kind, with tokens and whether they fit."""
        from pyspark.sql import Window

        order = [F.desc("score"), "kind", F.substring("body", 1, 40), "ord"]
        once = first_rows(sections, ["kind", "body"], order, 1)
        ranked = once.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("tokens", text.token_estimate("body"))
        return budget.greedy_skip(ranked, most, "rank", "tokens")

    def explain(self, subject: str, depth: str | None = None) -> dict[str, Any]:
        began = time.perf_counter()
        (over, lead), hits = self._overview(subject.lower()), self.search(subject, limit=6)["results"]
        lead = lead or over["subsystems"]
        if hits:
            said = f"{subject!r} is most closely connected to {', '.join(h['ref'] for h in hits[:4])}. Top subsystem context: {lead[0] if lead else 'No subsystem summary available.'}"
        else:
            said = f"No indexed files matched {subject!r}. Refresh or index the repository before asking again."
        return {"subject": subject, "repo_summary": over["summary"], "relevant_paths": [h["path"] for h in hits if h["kind"] != "subsystem"], "explanation": said, "evidence_refs": [h["ref"] for h in hits], "elapsed_ms": ms(began)}

    # Memories

    def remember(self, title: str, summary: str, evidence_refs: list[str] | None = None) -> dict[str, Any]:
        return self._remember_all([(title, summary, list(evidence_refs or []))])[0]

    def _remember_all(self, notes_: list[tuple[str, str, list[str]]]) -> list[dict[str, Any]]:
        """Memories of (title, summary, evidence refs), written in one step."""
        with self.store.writing():
            first, at = (self.store.read("memories").agg(F.max("memory_id")).first()[0] or 0) + 1, self.clock()
            rows = [(first + i, title, summary, refs, at, at) for i, (title, summary, refs) in enumerate(notes_)]
            new = self.spark.createDataFrame(rows, "memory_id long, title string, summary string, evidence_refs array<string>, created_at string, last_validated_at string")
            hashed = new.join(memory.evidence_hashes(new, memory.evidence_table(*(self.store.read(t) for t in ("files", "symbols", "chunks")))), "memory_id").withColumnRenamed("current_hash", "evidence_hash")
            self.store.append("memories", hashed)
            self._embed()
            self.store.clear_cache()
        return [{"memory_id": r[0], "title": r[1], "created_at": at, "last_validated_at": at} for r in rows]

    def capture(self, source: str, input_format: str, commit: bool = False) -> dict[str, Any]:
        said = notes.source_text(source) if input_format in ("json", "claude-jsonl") else ""
        skipped: list[dict] = []
        if input_format == "json":
            records = notes.json_records(self.spark, said)
        elif input_format == "claude-jsonl":
            from pathlib import Path

            records, bad = notes.sessions(notes.log_lines(self.spark, said), "stdin" if source == "-" else Path(source).stem)
            skipped = [{"reason": r["reason"], "context": {"error": parse_error(r["context"])}} for r in bad.orderBy("ord").collect()]
        else:
            raise ValueError(f"unknown input format {input_format!r}")
        judged = notes.validated(records, self.store.read("memories").select("title") if commit else None).orderBy("ord").collect()
        written = []
        for r in judged:
            if r["reason"]:
                skipped.append({"reason": r["reason"], "context": {"title": r["title"]}})
                continue
            entry = {"title": r["title"], "summary": r["summary"], "evidence_refs": list(r["evidence_refs"] or []), "memory_id": None}
            written.append(entry)
        if commit and written:
            for entry, kept in zip(written, self._remember_all([(e["title"], e["summary"], e["evidence_refs"]) for e in written]), strict=True):
                entry["memory_id"] = kept["memory_id"]
        return {"repo_root": str(self.store.root), "input_format": input_format, "source": source, "dry_run": not commit, "written": written, "skipped": skipped, "stats": {"candidates": len(judged), "written_count": len(written), "skipped_count": len(skipped)}}

    # Symbols and time

    def locate_df(self, symbol: str, file: str | None = None) -> DataFrame:
        bare = symbol.removeprefix("symbol:")
        leaf = bare.split(".")[-1]
        s, f, c = self.store.read("symbols"), self.store.read("files"), self.store.read("contents")
        found = s.where((F.col("name") == bare) | (F.col("name") == leaf) | F.col("name").ilike(f"%.{leaf}"))
        found = found.where(paths.matches_glob("path", file)) if file else found
        joined = found.join(f.select("path", "language"), "path", "left").join(c, "path", "left").withColumn("r", features.byte_range(F.col("text"), F.col("line_start"), F.col("line_end")))
        exact = ranking.locate_score(bare, leaf, F.col("name"), F.col("path"), F.col("signature"))
        return joined.select("symbol_id", F.col("path").alias("file"), "kind", F.coalesce("language", F.lit("text")).alias("lang"), "line_start", "line_end", "r.byte_start", "r.byte_end", "signature", "name", exact.alias("score"))

    def locate_symbol_range(self, symbol: str, file: str | None = None) -> dict[str, Any]:
        began = time.perf_counter()
        rows = plain(self.locate_df(symbol, file).orderBy(F.desc("score"), "file", "line_start").collect())
        return {"symbol": symbol, "file_glob": file, "matches": rows, "match_count": len(rows), "elapsed_ms": ms(began)}

    def timeline(self, since: str | None = None, scope: list[str] | None = None) -> dict[str, Any]:
        began = time.perf_counter()
        named = {"last_index": self.store.meta("last_indexed_at"), "last_refresh": self.store.meta("last_refreshed_at") or self.store.meta("last_indexed_at")}
        start = named[since] if since in named else since
        asked = set(scope) if scope else {"code", "memory", "stale"}
        events = plain(memory.timeline(self.store.read("files"), self._with_staleness(), start or None, asked).collect())
        return {"repo_root": str(self.store.root), "since": start or None, "scope": sorted(asked), "events": events, "event_count": len(events), "elapsed_ms": ms(began)}

    def usages_df(self, symbol: str, scope: str | None = None) -> DataFrame:
        """symbol_id, ord, path, relation_type, line, context, source: uses of the symbols of a name or id outside their own files, one a path."""
        s, r, c = self.store.read("symbols"), self.store.read("relations"), self.store.read("chunks")
        own = s.where(F.col("symbol_id" if symbol.startswith("symbol:") else "name") == symbol).select("symbol_id", F.col("path").alias("home"), "name")
        src = F.when(F.col("source_ref").startswith("symbol:"), F.get(F.split("source_ref", ":"), F.lit(1))).otherwise(F.regexp_replace("source_ref", "^file:", ""))
        null = F.lit(None)
        shape = lambda df, n, kind, line, context, source: df.select("symbol_id", "path", F.lit(n).alias("ord"), kind.cast("string").alias("relation_type"), line.cast("int").alias("line"), context.cast("string").alias("context"), F.lit(source).alias("source"))
        away = lambda df: df.where((F.col("path") != F.col("home")) & (F.col("path").startswith(scope) if scope else F.lit(True)))
        # Relations to the symbol keep all their rows; later kinds add only paths that aren't there yet.
        direct = shape(away(own.join(r, F.col("symbol_id") == F.col("target_ref")).withColumn("path", src)), 0, F.col("relation_type"), null, null, "relation")
        counts = {x["name"]: x["n"] for x in own.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
        names = sorted(counts)
        if not names:
            return direct
        holds = lambda n: F.col("text").contains(n) & text.whole_word("text", n)
        first = c.groupBy("path").agg(*[F.max(F.struct(-F.col("line_start"), holds(n).alias("said"))).alias(f"n{i}") for i, n in enumerate(names)])
        imports = away(own.join(r.where("relation_type = 'imports'"), F.concat(F.lit("file:"), "home") == F.col("target_ref")).withColumn("path", src)).join(first, "path")
        said = ranking.either([(F.col("name") == n) & F.col(f"n{i}.said") for i, n in enumerate(names)])
        imported = shape(imports.where(said).dropDuplicates(["symbol_id", "path"]).join(direct.select("symbol_id", "path"), ["symbol_id", "path"], "left_anti"), 1, F.lit("imports"), null, null, "relation")
        # Chunks that hold a word of a name, from the postings; the regular expression decides, and goes first, so that few texts are moved.
        words = sorted({w for n in names for w in tokens(n)})
        held = self.store.postings(words).where("of = 'chunk'").select(F.substring("ref", 7, 1 << 30).alias("chunk_id")).distinct()
        texts = [c.where(holds(n)).select(F.lit(n).alias("name"), "chunk_id", "path", F.col("line_start").alias("line"), F.substring(text.strip(_lines_with("text", n)), 1, 160).alias("context")) for n in names]
        texts = functools.reduce(DataFrame.unionByName, texts)
        texts = (texts.where(F.col("path").startswith(scope)) if scope else texts).join(held, "chunk_id", "left_semi")
        mentions = first_rows(texts, ["name", "path"], ["line", "chunk_id"], 1)
        near = direct.unionByName(imported)
        full = shape(mentioned(mentions, own, near.select("symbol_id", "path"), counts), 2, null, F.col("line"), F.col("context"), "fts")
        return near.unionByName(full)

    def find_usages(self, symbol: str, scope: str | None = None) -> dict[str, Any]:
        began = time.perf_counter()
        own = self.store.read("symbols").where(F.col("symbol_id" if symbol.startswith("symbol:") else "name") == symbol).orderBy("path", "line_start").collect()
        if not own:
            return {"results": [], "error": f"No symbol found matching {symbol!r}", "elapsed_ms": ms(began)}
        uses: dict[str, list[dict]] = {}
        for r in self.usages_df(symbol, scope).orderBy("ord", "path").collect():
            fields = ("path", "relation_type", "source") if r["ord"] < 2 else ("path", "line", "context", "source")
            uses.setdefault(r["symbol_id"], []).append({k: r[k] for k in fields})
        results = [{"symbol_id": s["symbol_id"], "symbol_name": s["name"], "kind": s["kind"], "definition": {"path": s["path"], "line": s["line_start"]}, "references": (u := uses.get(s["symbol_id"], [])), "usage_count": len(u), "is_unused": not u} for s in own]
        return {"results": results, "elapsed_ms": ms(began)}

    # Evaluation

    def evaluate(self, fixtures: list[dict], top_k: int = 5) -> dict[str, Any]:
        """Share of each fixture's expected refs that are part of a ref among the first ``top_k`` hits."""
        results = []
        for f in fixtures:
            began = time.perf_counter()
            hits = self.search(f["query"])["results"]
            refs, wanted = [h["ref"] for h in hits[:top_k]], f.get("expected_refs", [])
            found = [w for w in wanted if any(w in r for r in refs)]
            share = round(len(found) / len(wanted), 3) if wanted else float(bool(hits))
            results.append({"query": f["query"], "hits": len(hits), "top_ref": hits[0]["ref"] if hits else None, "top_score": round(hits[0]["score"], 4) if hits else 0.0, "elapsed_ms": ms(began), "precision": share, "found_refs": found, "missing_refs": [w for w in wanted if w not in found], "pass": len(found) == len(wanted) if wanted else bool(hits)})
        passed, n = sum(r["pass"] for r in results), len(results)
        mean = round(sum(r["precision"] for r in results) / n, 3) if n else 0.0
        return {"queries_run": n, "passed": passed, "failed": n - passed, "recall": round(passed / n, 3) if n else 0.0, "avg_precision": mean, "total_elapsed_ms": sum(r["elapsed_ms"] for r in results), "results": results}


def words_of(files: DataFrame, own: DataFrame, chunks: DataFrame) -> DataFrame:
    """ref, of, path, tokens: the stemmed words of files, symbols and chunks."""
    parts = [
        files.select(F.concat(F.lit("file:"), "path").alias("ref"), F.lit("file").alias("of"), "path", F.concat_ws(" ", "summary", "role", "language").alias("t")),
        own.select(F.col("symbol_id").alias("ref"), F.lit("symbol").alias("of"), "path", F.concat_ws(" ", "name", "kind", "summary").alias("t")),
        chunks.select(F.concat(F.lit("chunk:"), "chunk_id").alias("ref"), F.lit("chunk").alias("of"), "path", F.col("text").alias("t")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("ref", "of", "path", stemmed("t").alias("tokens"))


def mentioned(mentions: DataFrame, own: DataFrame, near: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Each mention (name, path, line, context) with each symbol of its name that has no home and no nearer use at that path.

    This is a row a pair, and pairs grow with the square of the input. So they are made last and are never moved: symbols meet the mentions as broadcast
    blocks of ids, and what is left out of a block is known by path before they meet.
    """
    n = max(1, -(-max(counts.values()) // BLOCK))
    block = F.pmod(F.xxhash64("symbol_id"), F.lit(n)).alias("block")
    ids = own.select("name", "symbol_id", block).groupBy("name", "block").agg(F.collect_set("symbol_id").alias("ids"))
    out = own.select("symbol_id", F.col("home").alias("path")).unionByName(near).select("path", "symbol_id", block)
    out = out.groupBy("path", "block").agg(F.collect_set("symbol_id").alias("ids")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("block", "ids"))).alias("out"))
    spread = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = mentions.join(out, "path", "left").repartition(spread, "path", "name")  # by number, so that few small rows still go to all cores
    parts = -(-sum(counts.values()) // BROADCAST_IDS)
    left = F.element_at("out", F.col("block"))
    left = F.explode(F.when(left.isNull(), F.col("ids")).otherwise(F.array_except("ids", left)))
    pairs = [rows.join(F.broadcast(ids.where(F.col("block") % parts == k)), "name").select(left.alias("symbol_id"), "path", "line", "context") for k in range(parts)]
    return functools.reduce(DataFrame.unionByName, pairs)


def parse_error(line: str) -> str:
    """Why a line is no JSON, as Python's reader says it."""
    try:
        json.loads(line)
    except ValueError as e:
        return str(e)
    return line


def _lines_with(column: str, name: str):  # noqa: ANN202
    return F.get(F.filter(F.split(column, "\n"), lambda x: text.whole_word(x, name)), F.lit(0))


def estimate(said: str) -> int:
    return max(1, len(said) // 4) if said else 0


def ms(began: float) -> int:
    return round((time.perf_counter() - began) * 1000)


def digest(*parts: Any) -> str:
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()
