"""Further driver queries: admission, globs, capture, postings, neighbours, top chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths, text
from tessera.operators import budget, features, graph, ranking, vector
from tessera.operators.features import first_rows
from tessera.plans.catalogue import ASKED, BM25_SQL, LINES, SQL_COSTS, SQL_CRAFTED, SQL_EDGES, SQL_FILES, costs, crafted, files, query, read, rounded, sources, supply_edges
from tessera.sources import capture

ADMITTED = ["a{}.py", "b{}.min.js", "c{}.bin", "d{}.md", "LICENSE{}", "Dockerfile"]


@query("admission", """WITH n AS (SELECT doc_id, replace((['a{}.py', 'b{}.min.js', 'c{}.bin', 'd{}.md', 'LICENSE{}', 'Dockerfile'])[doc_id % 6 + 1], '{}', CAST(doc_id AS VARCHAR)) AS path, text FROM documents)
    SELECT doc_id, path, sha256(replace(text, ' a', chr(10) || 'a')) AS hash FROM n
    WHERE doc_id % 7 <> 0 AND octet_length(encode(text)) + 2 * (length(text) - length(replace(text, ' a', ' '))) <= 524288 AND NOT contains(path, '.min.') AND (path LIKE '%.py' OR path LIKE '%.md' OR path = 'Dockerfile')""")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with \\r\\n line ends; every seventh has bytes that are not UTF-8."""
    d = read(spark, sf_dir, "documents")
    name = F.replace(F.get(F.array(*map(F.lit, ADMITTED)), (F.col("doc_id") % 6).cast("int")), F.lit("{}"), F.col("doc_id").cast("string"))
    body = F.encode(F.replace("text", F.lit(" a"), F.lit("\r\na")), "UTF-8")
    body = F.when(F.col("doc_id") % 7 == 0, F.concat(body, F.lit(b"\xff\xfe"))).otherwise(body)
    path = F.concat(F.col("doc_id").cast("string"), F.lit("/"), name)
    listed = d.select(path.alias("path"), F.octet_length(body).alias("size"), body.alias("content"))
    out = features.admitted(listed)
    return out.select(F.substring_index("path", "/", 1).cast("long").alias("doc_id"), paths.name_of("path").alias("path"), F.sha2("text", 256).alias("hash"))


@query("glob_filter", f"WITH {SQL_CRAFTED} SELECT doc_id, path FROM p WHERE regexp_full_match(path, '(?s).*/[vU].*\\.p.p') OR regexp_full_match(path, '(?s).eb/.*')")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crafted(spark, sf_dir).where(paths.matches_glob("path", "*/[vU]*.p?p") | paths.matches_glob("path", "?eb/*"))


@query("path_extraction", """SELECT doc_id, unnest(['src/f' || doc_id || '.py', '/var/log/x.log', '../q/z' || (doc_id % 3) || '.txt']) AS path FROM documents""")
def path_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    said = F.concat(F.lit("cat ./src/f"), n, F.lit(".py \"/var/log/x.log\" http://a/b.c x/y.z ../q/z"), (F.col("doc_id") % 3).cast("string"), F.lit(".txt /no/ending ./src/f"), n, F.lit(".py"))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(capture.paths_in(said))).alias("path"))


@query("capture_validation", """WITH r AS (SELECT conv_id * 1000 + turn AS ord, CASE WHEN turn % 5 = 4 THEN '' ELSE trim(left(text, 9)) END AS title, CASE WHEN turn % 7 = 3 THEN '' ELSE trim(text) END AS summary FROM conversations),
    w AS (SELECT *, CASE WHEN title = '' THEN 'missing_title' WHEN summary = '' THEN 'missing_summary' END AS reason FROM r),
    f AS (SELECT title, min(ord) AS first FROM w WHERE reason IS NULL GROUP BY title)
    SELECT ord, w.title, CASE WHEN reason IS NOT NULL THEN reason WHEN w.title IN (SELECT trim(left(text, 9)) FROM benchmark) OR ord > first THEN 'duplicate_title' END AS reason, CAST(length(left(summary, 1000)) AS INTEGER) AS chars FROM w LEFT JOIN f ON w.title = f.title""")
def capture_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    records = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.when(F.col("turn") % 5 == 4, "").otherwise(F.substring("text", 1, 9)).alias("title"), F.when(F.col("turn") % 7 == 3, "").otherwise(F.col("text")).alias("summary"), F.array().cast("array<string>").alias("evidence_refs"))
    known = read(spark, sf_dir, "benchmark").select(F.trim(F.substring("text", 1, 9)).alias("title"))
    return capture.validated(records, known).select("ord", "title", "reason", F.length("summary").alias("chars"))


@query("session_records", r"""WITH s AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS u, arg_min(text, turn) FILTER (role = 'assistant') AS a, min(turn) AS e, max(turn) AS l, count(*) FILTER (role = 'assistant') AS k FROM conversations GROUP BY conv_id),
    t AS (SELECT conv_id, trim(coalesce(u, '')) AS u, trim(coalesce(a, '')) AS a, strftime(DATE '2024-01-01' + CAST(e AS INTEGER), '%Y-%m-%d') AS early, strftime(DATE '2024-01-01' + CAST(l AS INTEGER), '%Y-%m-%d') AS late, k FROM s)
    SELECT 'Session ' || left(early, 10) || ': ' || CASE WHEN u = '' THEN 'Session c' || conv_id ELSE left(string_split(u, chr(10))[1], 80) END AS title,
           'Session id: c' || conv_id || chr(10) || 'Time range: ' || early || ' → ' || late || chr(10) || 'Touched: ' || CASE WHEN k > 0 THEN 'src/f' || conv_id || '.py' ELSE 'no files touched' END
           || CASE WHEN u = '' THEN '' ELSE chr(10) || 'User: ' || left(u, 240) END || CASE WHEN a = '' THEN '' ELSE chr(10) || 'Assistant: ' || left(a, 240) END AS summary,
           CASE WHEN k > 0 THEN 'file:src/f' || conv_id || '.py' ELSE '' END AS evidence
    FROM t WHERE u <> '' OR k > 0""")
def session_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as lines of a session log."""
    c = read(spark, sf_dir, "conversations")
    at = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("turn").cast("int")), "yyyy-MM-dd")
    part = F.struct(F.lit("text").alias("type"), F.col("text"))
    used = F.struct(F.lit("tool_use").alias("type"), F.struct(F.concat(F.lit("./src/f"), F.col("conv_id").cast("string"), F.lit(".py")).alias("file_path")).alias("input"))
    user = F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("sessionId"), at.alias("timestamp"), F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
    said = F.concat(F.lit("["), F.to_json(part), F.lit(","), F.to_json(used), F.lit("]"))
    ours = F.concat(F.lit('{"sessionId":"c'), F.col("conv_id").cast("string"), F.lit('","timestamp":"'), at, F.lit('","type":"assistant","message":{"content":'), said, F.lit("}}"))
    lines = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.when(F.col("role") == "assistant", ours).otherwise(user).alias("line"))
    records, _ = capture.sessions(lines, "log")
    return records.select("title", "summary", F.array_join("evidence_refs", ",").alias("evidence"))


@query("related_topk", f"""WITH {SQL_EDGES}, n AS (SELECT target_ref AS ref, weight FROM edges WHERE source_ref IN ('s:1', 's:2') UNION ALL SELECT source_ref, weight FROM edges WHERE target_ref IN ('p:3', 'p:4'))
    SELECT ref, max(weight) AS score FROM n GROUP BY ref ORDER BY score DESC, ref LIMIT 25""")
def related_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = spark.createDataFrame([("s:1",), ("s:2",), ("p:3",), ("p:4",)], "ref string")
    near = graph.neighbors(supply_edges(spark, sf_dir), lead).select(F.col("neighbor").alias("ref"), F.col("weight").alias("score"), F.lit("related").alias("kind"))
    return graph.best_of(near).orderBy(F.desc("score"), "ref").limit(25).select("ref", "score")


@query("file_chunks_top2", f"""WITH {SQL_FILES}, l AS (SELECT path, {LINES} AS ls FROM f),
    w AS (SELECT path, s + 1 AS a, least(len(ls), s + 40) AS b, trim(array_to_string(ls[s + 1 : s + 40], chr(10)), ' ' || chr(10) || chr(9) || chr(13)) AS body
          FROM (SELECT *, unnest(range(0, len(ls), 32)) AS s FROM l) WHERE s = 0 OR s + 8 < len(ls)),
    k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY length(body) // 4, a) AS r FROM w WHERE body <> '')
    SELECT path || ':' || a || '-' || b AS chunk_id FROM k WHERE r <= 2""")
def file_chunks_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = features.window_chunks(files(spark, sf_dir).select("path", "text"))
    return first_rows(chunks.select("chunk_id", "path", "token_estimate", "line_start"), ["path"], ["token_estimate", "line_start"], 2).select("chunk_id")


@query("bm25_from_postings", f"WITH {BM25_SQL} SELECT doc_id, round(bm25, 6) AS score FROM raw")
def bm25_from_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), text.words("text").alias("tokens"))
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("mean")).first()
    found = ranking.bm25_from_postings(ranking.postings(d), text.query_words(ASKED), stats["n"], stats["mean"])
    return found.select(F.col("ref").alias("doc_id"), rounded("bm25").alias("score"))


@query("embedding_prune", "SELECT CAST(vec_id AS VARCHAR) AS ref FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def embedding_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("ref"))
    alive = read(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("ref"))
    return vector.pruned(stored, alive)


@query("section_counts", f"""WITH RECURSIVE {SQL_COSTS}, walk AS (SELECT CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, false AS kept
    UNION ALL SELECT c.rank, CASE WHEN used + c.cost <= 60000 THEN used + c.cost ELSE used END, used + c.cost <= 60000 FROM walk JOIN c ON c.rank = walk.rank + 1)
    SELECT (['symbol', 'chunk', 'memory', 'edge'])[doc_id % 4 + 1] AS kind, count(*) FILTER (kept) AS n, count(*) FILTER (NOT kept) AS dropped FROM walk JOIN c USING (rank) GROUP BY 1""")
def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ("symbol", "chunk", "memory", "edge"))), (F.col("doc_id") % 4).cast("int"))
    kept = budget.greedy_skip(costs(spark, sf_dir), 60000)
    return kept.groupBy(kind.alias("kind")).agg(F.count_if("kept").alias("n"), F.count_if(~F.col("kept")).alias("dropped"))


@query("symbol_chunks", r"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS n FROM documents)
    SELECT 'symbol:lib/s' || n || '.md:Part ' || n || ':1:1-5' AS chunk_id, 'symbol' AS chunk_type, CAST(length('# Part ' || n || '\ntext\n\nNotes on it:\nmore') // 4 AS INTEGER) AS token_estimate FROM d
    UNION ALL SELECT 'symbol:lib/s' || n || '.md:Notes on it::4:4-5', 'symbol', 4 FROM d""".replace("\\n", "_"))
def symbol_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import symbols

    contents = sources(spark, sf_dir, "md")
    own = symbols.symbols_of(symbols.scan_symbols(contents))
    return features.chunks_of(contents, own).select("chunk_id", "chunk_type", "token_estimate")


@query("overview_sentence", f"""WITH {SQL_FILES}, g AS (SELECT language, count(*) AS n FROM f GROUP BY language), r AS (SELECT role, count(*) AS n FROM f GROUP BY role)
    SELECT 'Repository corpus contains ' || (SELECT count(*) FROM f) || ' indexed files. Top languages: ' || (SELECT string_agg(language || ' (' || n || ')', ', ' ORDER BY n DESC, language) FROM (SELECT * FROM g ORDER BY n DESC, language LIMIT 3))
        || '. Top roles: ' || (SELECT string_agg(role || ' (' || n || ')', ', ' ORDER BY n DESC, role) FROM (SELECT * FROM r ORDER BY n DESC, role LIMIT 3)) || '.' AS summary""")
def overview_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("all", F.lit("x"))
    n = f.groupBy("all").agg(F.count(F.lit(1)).alias("n"))
    said = n.join(features.named_counts(f, "all", "language", 3).withColumnRenamed("text", "l"), "all").join(features.named_counts(f, "all", "role", 3).withColumnRenamed("text", "r"), "all")
    return said.select(F.concat(F.lit("Repository corpus contains "), F.col("n").cast("string"), F.lit(" indexed files. Top languages: "), "l", F.lit(". Top roles: "), "r", F.lit(".")).alias("summary"))


@query("usages_by_import", f"""WITH {SQL_FILES}, u AS (SELECT path, doc_id FROM f WHERE regexp_matches(text, '\\btrash\\b'))
    SELECT path, CASE WHEN doc_id % 2 = 0 THEN 'relation' ELSE 'fts' END AS source FROM u WHERE NOT starts_with(path, 'src1/')""")
def usages_by_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of a word: importing files first, then others that mention it; one row a path, none from the defining folder."""
    f = files(spark, sf_dir).where(~F.col("path").startswith("src1/"))
    said = f.where(text.whole_word("text", "trash")).select("path", "doc_id")
    imported = said.where("doc_id % 2 = 0").select("path", F.lit("relation").alias("source"), F.lit(1).alias("ord"))
    mentioned = said.select("path", F.lit("fts").alias("source"), F.lit(2).alias("ord"))
    return first_rows(imported.unionByName(mentioned), ["path"], ["ord"], 1).select("path", "source")


@query("query_cache_keys", "SELECT sha256('search:' || event_type || '|' || coalesce(CAST(user_id AS VARCHAR), '')) AS query_key, count(*) AS n FROM events GROUP BY 1")
def query_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.sha2(F.concat(F.lit("search:"), "event_type", F.lit("|"), F.coalesce(F.col("user_id").cast("string"), F.lit(""))), 256).alias("query_key")).agg(F.count(F.lit(1)).alias("n"))


@query("recency_factors", "SELECT event_id, CASE WHEN (epoch(TIMESTAMP '2024-02-01') - epoch(ts)) / 86400e0 < 7e0 THEN 1.10e0 WHEN (epoch(TIMESTAMP '2024-02-01') - epoch(ts)) / 86400e0 < 30e0 THEN 1.03e0 ELSE 1e0 END AS factor FROM events")
def recency_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", ranking.recency(F.col("ts").cast("string"), F.lit("2024-02-01").cast("timestamp")).alias("factor"))
