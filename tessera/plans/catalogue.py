"""The driver queries over the test tables and the SQL that each is held against.

``documents`` stands in for files: path = source/lang/doc<id>.txt, role from the label, hash of the text, a time from the id.
Each query runs over its whole tables. A limit appears only where the operator is a top-k.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import session
from tessera.functions import paths, text
from tessera.operators import budget, features, graph, memory, merge, ranking, symbols, vector
from tessera.operators.features import first_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = "2024-02-01 00:00:00"
ASKED = "license version trash the erth"
TEMPLATES = ["routes/web{}.php", "app/Models/U{}.php", "x/views.py", "src/main.py", "tests/a{}.py", "pages/api/h{}.ts", "web/Controllers/C{}.php", "ui/templates/t{}.html", "lib/middleware/m{}.js", "docs/d{}.md", "etc/config{}.yml", "scripts/s{}.sh", "README.md", "Web/b{}.ts", "a{}.py", "app/views/v{}.blade.php"]

SQL_FILES = """f AS (SELECT d.doc_id, source || '/' || lang || '/doc' || d.doc_id || '.txt' AS path, lang AS language,
        CASE l.quality WHEN 1 THEN 'source' WHEN 0 THEN 'documentation' ELSE 'test' END AS role, sha256(text) AS hash, text,
        TIMESTAMP '2024-01-01' + to_days(CAST(d.doc_id % 30 AS INTEGER)) AS updated_at
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
SQL_CRAFTED = "p AS (SELECT doc_id, replace((['" + "','".join(TEMPLATES) + "'])[doc_id % 16 + 1], '{}', CAST(doc_id AS VARCHAR)) AS path FROM documents)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    session.reach_package(spark)
    return session.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    role = F.when(F.col("quality") == 1, "source").when(F.col("quality") == 0, "documentation").otherwise("test")
    at = F.timestamp_add("DAY", (F.col("doc_id") % 30).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.join(labels, "doc_id", "left").select("doc_id", path.alias("path"), F.col("lang").alias("language"), role.alias("role"), F.sha2("text", 256).alias("hash"), "text", at.alias("updated_at"))


def crafted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of all kinds, one a document."""
    chosen = F.get(F.array(*map(F.lit, TEMPLATES)), (F.col("doc_id") % 16).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", F.replace(chosen, F.lit("{}"), F.col("doc_id").cast("string")).alias("path"))


def terms_sql(words: list[str]) -> str:
    return "(VALUES " + ",".join(f"({i},'{w}')" for i, w in enumerate(words)) + ") AS q(i, t)"


def rounded(c: Column | str) -> Column:
    return F.round(c, 6)


BM25_SQL = f"""tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z0-9]*') AS w FROM documents),
    st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS mean FROM tok),
    tf AS (SELECT doc_id, len(w) AS dl, t, len(list_filter(w, lambda x: x = t)) AS tf FROM tok, {terms_sql(text.query_words(ASKED))}),
    df AS (SELECT t, CAST(count(*) AS DOUBLE) AS df FROM tf WHERE tf > 0 GROUP BY t),
    raw AS (SELECT doc_id, sum(CASE WHEN (n - df + 0.5e0) / (df + 0.5e0) > 1e0 THEN ln((n - df + 0.5e0) / (df + 0.5e0)) ELSE 1e-6 END
            * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / mean))) AS bm25 FROM tf JOIN df USING (t), st WHERE tf > 0 GROUP BY doc_id)"""


@query("bm25_topk", f"WITH {BM25_SQL} SELECT doc_id, round(bm25, 6) AS score FROM raw ORDER BY bm25 DESC, doc_id LIMIT 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", text.words("text").alias("tokens"))
    return ranking.bm25(d, text.query_words(ASKED)).orderBy(F.desc("bm25"), "doc_id").limit(20).select("doc_id", rounded("bm25").alias("score"))


@query("bm25_stemmed")
def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.porter import counted, tokens

    asked = tokens(ASKED)
    own = sorted(set(asked))
    d = read(spark, sf_dir, "documents").select("doc_id", counted("text", own).alias("c")).select("doc_id", "c.length", "c.tf")
    return ranking.bm25_counted(d, asked, own).where(F.exists("tf", lambda n: n > 0)).select("doc_id", rounded("bm25").alias("score"))


LINES = "CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[1:-2] WHEN text = '' THEN [] ELSE string_split(text, chr(10)) END"
SNIPPET = f"substr(array_to_string(list_filter(list_transform({LINES}, lambda x: trim(x)), lambda x: x <> '')[1:6], ' '), 1, 180)"


@query("file_features", f"""WITH {SQL_FILES}, s AS (SELECT *, {SNIPPET} AS snip FROM f)
    SELECT path, language, role, hash, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes,
           CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS INTEGER) AS token_estimate,
           role || ' file: ' || CASE WHEN snip = '' THEN 'Minimal textual content.' ELSE snip END AS summary FROM s""")
def file_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return f.select("path", "language", "role", "hash", F.octet_length("text").cast("long").alias("size_bytes"), text.token_estimate("text").alias("token_estimate"), F.concat("role", F.lit(" file: "), features.snippet("text")).alias("summary"))


def sql_dir(name: str) -> str:
    return f"list_contains(string_split(lower(path), '/')[1:-2], '{name}')"


@query("role_case", f"""WITH {SQL_CRAFTED}, n AS (SELECT *, string_split(path, '/')[-1] AS name FROM p)
    SELECT path, CASE WHEN name = 'README.md' THEN 'documentation' WHEN name IN ('main.py') THEN 'entrypoint'
        WHEN starts_with(lower(path), 'routes/') OR starts_with(lower(path), 'pages/api/') THEN 'route'
        WHEN {sql_dir('models')} THEN 'model' WHEN {sql_dir('controllers')} OR name = 'views.py' THEN 'controller'
        WHEN ({sql_dir('views')} OR {sql_dir('templates')}) AND NOT name LIKE '%.py' THEN 'view' WHEN {sql_dir('middleware')} THEN 'middleware'
        WHEN contains(path, '/test') OR starts_with(path, 'tests/') THEN 'test' WHEN starts_with(path, 'docs/') OR name LIKE '%.md' THEN 'documentation'
        WHEN contains(path, 'config') THEN 'config' WHEN starts_with(path, 'scripts/') THEN 'script' ELSE 'source' END AS role,
        coalesce(map {{'php': 'php', 'py': 'python', 'ts': 'typescript', 'html': 'html', 'js': 'javascript', 'md': 'markdown', 'yml': 'yaml', 'sh': 'shell'}}[string_split(name, '.')[-1]], 'text') AS language,
        count(*) AS n FROM n GROUP BY ALL""")
def role_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crafted(spark, sf_dir).groupBy("path", paths.role_of("path").alias("role"), paths.language_of("path").alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query("subsystem_map", f"""WITH {SQL_CRAFTED}, t AS (SELECT CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE 'root' END AS top FROM p)
    SELECT CASE WHEN lower(top) IN ('src', 'app', 'lib') THEN 'application' WHEN lower(top) IN ('test', 'tests') THEN 'tests' WHEN lower(top) IN ('doc', 'docs') THEN 'documentation'
           WHEN lower(top) IN ('scripts', 'bin') THEN 'scripts' ELSE top END AS name, count(*) AS n FROM t GROUP BY 1""")
def subsystem_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crafted(spark, sf_dir).groupBy(paths.subsystem_of("path").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("window_chunks", f"""WITH {SQL_FILES}, l AS (SELECT path, {LINES} AS ls FROM f),
    w AS (SELECT path, s + 1 AS line_start, least(len(ls), s + 40) AS line_end, trim(array_to_string(ls[s + 1 : s + 40], chr(10)), ' ' || chr(10) || chr(9) || chr(13)) AS body
          FROM (SELECT *, unnest(range(0, len(ls), 32)) AS s FROM l) WHERE s = 0 OR s + 8 < len(ls))
    SELECT path || ':' || line_start || '-' || line_end AS chunk_id, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end,
           CAST(greatest(1, length(body) // 4) AS INTEGER) AS token_estimate, sha256(body) AS hash FROM w WHERE body <> ''""")
def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.window_chunks(files(spark, sf_dir).select("path", "text")).select("chunk_id", "line_start", "line_end", "token_estimate", "hash")


@query("token_bag", """SELECT t AS term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM
    (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_/-]+')) AS t FROM documents) GROUP BY t""")
def token_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    # counted by document first, so that the distinct count needs no second shuffle of all terms
    each = read(spark, sf_dir, "documents").select("doc_id", F.explode(text.terms("text")).alias("term"))
    return each.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("k")).groupBy("term").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("docs"))


def sql_overlap(column: str, asked: str) -> str:
    q = text.query_terms(asked)
    parts = " + ".join(f"least({n}, len(list_filter({column}, lambda x: x = '{t}')))" for t, n in q.items())
    return f"CAST({parts} AS DOUBLE) / {float(sum(q.values()))}e0"


@query("overlap_score", f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z_][a-z0-9_/-]+') AS w FROM documents), s AS (SELECT doc_id, {sql_overlap('w', ASKED + ' trash')} AS s FROM w)
    SELECT doc_id, round(s, 6) AS score FROM s WHERE s > 0""")
def overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", text.overlap(text.terms("text"), text.query_terms(ASKED + " trash")).alias("s"))
    return d.where("s > 0").select("doc_id", rounded("s").alias("score"))


EXACT_ASKED = "src1 en license source"


def sql_exact(asked: str) -> str:
    return " + ".join(
        f"{n}e0 * (CAST(contains(lower(path), '{t}') AS INT) + CAST(contains(lower(summary), '{t}') AS INT) + CAST(contains(lower(role), '{t}') AS INT) + CAST(contains(lower(language), '{t}') AS INT)"
        f" + 1.5e0 * CAST(list_contains(string_split(lower(path), '/'), '{t}') AS INT))"
        for t, n in text.query_terms(asked).items()
    )


SQL_SUMMARY = f"g AS (SELECT *, {SNIPPET} AS summary FROM f)"
SQL_SCORED = f"""e AS (SELECT *, {sql_exact(EXACT_ASKED)} + {sql_overlap("regexp_extract_all(lower(path || ' ' || summary || ' ' || role || ' ' || language), '[a-z_][a-z0-9_/-]+')", EXACT_ASKED)} AS exact FROM g)"""


def summarized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).withColumn("summary", features.leading("text"))


@query("file_exact_score", f"WITH {SQL_FILES}, {SQL_SUMMARY}, {SQL_SCORED} SELECT path, round(exact, 6) AS score FROM e WHERE exact > 0")
def file_exact_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summarized(spark, sf_dir).select("path", ranking.file_score(text.query_terms(EXACT_ASKED)).alias("s"))
    return s.where("s > 0").select("path", rounded("s").alias("score"))


def searched(spark: SparkSession, sf_dir: str, second: bool) -> DataFrame:
    d = summarized(spark, sf_dir).withColumn("tokens", text.words("text"))
    d = ranking.normalized(ranking.bm25(d, text.query_words(ASKED)), "bm25")
    score = (ranking.file_score(text.query_terms(EXACT_ASKED)) + F.col("bm25")) * ranking.role_boost(F.col("role"))
    if second:
        score = score * ranking.recency(F.col("updated_at").cast("string"), F.lit(NOW).cast("timestamp"))
    score = ranking.soft_kind(score, F.col("role"), F.col("language"), "source")
    top = d.select("path", "role", score.alias("s")).where("s > 0").withColumn("score", F.round("s", 3)).orderBy(F.desc("score"), "path").limit(20)
    return top.select("path", "role", "score")


def sql_search(second: bool) -> str:
    age = "(epoch(TIMESTAMP '2024-02-01') - epoch(updated_at)) / 86400e0"
    recency = f" * CASE WHEN {age} < 7e0 THEN 1.10e0 WHEN {age} < 30e0 THEN 1.03e0 ELSE 1e0 END" if second else ""
    return f"""WITH {SQL_FILES}, {SQL_SUMMARY}, {SQL_SCORED}, {BM25_SQL}, top AS (SELECT max(bm25) AS m FROM raw),
        s AS (SELECT path, role, (exact + coalesce(bm25, 0e0) / m) * CASE role WHEN 'source' THEN 1.3e0 WHEN 'test' THEN 1.1e0 ELSE 0.7e0 END{recency}
              * CASE WHEN role <> 'source' AND language <> 'source' THEN 0.5e0 ELSE 1e0 END AS s FROM e LEFT JOIN raw USING (doc_id), top)
        SELECT path, role, round(s, 3) AS score FROM s WHERE s > 0 ORDER BY score DESC, path LIMIT 20"""


QUERIES["search_v1"], SQL["search_v1"] = lambda spark, sf_dir: searched(spark, sf_dir, False), sql_search(False)
QUERIES["search_v2"], SQL["search_v2"] = lambda spark, sf_dir: searched(spark, sf_dir, True), sql_search(True)


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("source_ref"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("target_ref"), F.lit("supplies").alias("relation_type"), (F.col("l_linenumber") / 8.0).alias("weight"))


SQL_EDGES = "edges AS (SELECT 's:' || l_suppkey AS source_ref, 'p:' || l_partkey AS target_ref, 'supplies' AS relation_type, l_linenumber / 8e0 AS weight FROM lineitem)"


@query("graph_proximity", f"""WITH {SQL_EDGES}, refs AS (SELECT 's:' || s_suppkey AS ref FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'p:' || p_partkey FROM part WHERE p_size > 25),
    e AS (SELECT * FROM edges WHERE source_ref IN (SELECT ref FROM refs) AND target_ref IN (SELECT ref FROM refs) AND source_ref <> target_ref),
    b AS (SELECT ref, 0.05e0 * sum(weight) AS bonus FROM (SELECT source_ref AS ref, weight FROM e UNION ALL SELECT target_ref, weight FROM e) GROUP BY ref)
    SELECT ref, round(2e0 * (1e0 + least(coalesce(bonus, 0e0), 0.5e0)), 6) AS score FROM refs LEFT JOIN b USING (ref)""")
def graph_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("ref"))
    refs = s.unionByName(read(spark, sf_dir, "part").where("p_size > 25").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("ref")))
    b = graph.proximity(supply_edges(spark, sf_dir), refs)
    return refs.join(b, "ref", "left").select("ref", rounded(graph.boosted(F.lit(2.0), F.col("bonus"))).alias("score"))


@query("neighbor_expand", f"""WITH {SQL_EDGES}, refs AS (SELECT unnest(['s:1', 's:2', 'p:3', 'p:4']) AS ref),
    n AS (SELECT ref, target_ref AS neighbor, weight FROM refs JOIN edges ON ref = source_ref UNION ALL SELECT ref, source_ref, weight FROM refs JOIN edges ON ref = target_ref AND source_ref <> target_ref)
    SELECT neighbor, max(weight) AS score FROM n GROUP BY neighbor""")
def neighbor_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = spark.createDataFrame([("s:1",), ("s:2",), ("p:3",), ("p:4",)], "ref string")
    return graph.neighbors(supply_edges(spark, sf_dir), refs).groupBy("neighbor").agg(F.max("weight").alias("score"))


@query("import_resolution", f"""WITH {SQL_FILES}, i AS (SELECT path, source, CASE doc_id % 4 WHEN 0 THEN lang || '/doc' || (doc_id * 7 % 1000) || '.txt' WHEN 1 THEN source || '/' || lang || '/doc' || (doc_id * 7 % 1000) || '.txt'
          WHEN 2 THEN source || '/en/doc' || (doc_id * 7 % 1000) || '.txt' ELSE 'a/b/doc' || (doc_id * 7 % 1000) || '.txt' END AS want FROM f JOIN (SELECT doc_id AS k, source, lang FROM documents) ON doc_id = k),
    own AS (SELECT suffix, arg_min(path, (length(path), path)) AS owner FROM (SELECT path, array_to_string(parts[k : ], '/') AS suffix FROM (SELECT path, string_split(path, '/') AS parts, unnest([1, 2, 3]) AS k FROM f)) GROUP BY suffix),
    c AS (SELECT path, k, array_to_string(parts[k : ], '/') AS suffix FROM (SELECT path, string_split(want, '/') AS parts, unnest([1, 2, 3]) AS k FROM i) WHERE k <= len(parts)),
    r AS (SELECT c.path, arg_min(owner, k) AS owner FROM c JOIN own USING (suffix) GROUP BY c.path)
    SELECT f.path, coalesce('file:' || owner, 'unresolved') AS target FROM f LEFT JOIN r ON f.path = r.path""")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    m = F.concat(F.lit("doc"), (F.col("doc_id") * 7 % 1000).cast("string"), F.lit(".txt"))
    want = F.when(F.col("doc_id") % 4 == 0, F.concat("language", F.lit("/"), m)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("./"), m)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("../en/./"), m)).otherwise(F.concat(F.lit("a/b/"), m))
    edges = f.select(F.concat(F.lit("file:"), "path").alias("source_ref"), F.concat(F.lit("import:"), want).alias("target_ref"), F.lit("imports").alias("relation_type"), F.lit(1.0).alias("weight"))
    done = graph.resolve_imports(edges, f.select("path"))
    return done.select(F.substring("source_ref", 6, 1 << 30).alias("path"), F.when(F.col("target_ref").startswith("file:"), F.col("target_ref")).otherwise("unresolved").alias("target"))


@query("overview_counts", f"WITH {SQL_FILES} SELECT 'language' AS what, language AS value, count(*) AS n FROM f GROUP BY language UNION ALL SELECT 'role', role, count(*) FROM f GROUP BY role")
def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    one = lambda c: features.overview_counts(f, c).select(F.lit(c).alias("what"), F.col(c).alias("value"), "n")
    return one("language").unionByName(one("role"))


@query("top_dirs", f"WITH {SQL_CRAFTED} SELECT CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '.' END AS dir, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, dir LIMIT 5")
def top_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crafted(spark, sf_dir).groupBy(features.top_dir("path").alias("dir")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dir").limit(5)


@query("subsystem_rollup", f"""WITH {SQL_FILES}, s AS (SELECT *, string_split(path, '/')[1] AS name FROM f),
    c AS (SELECT name, count(*) AS file_count FROM s GROUP BY name),
    lc AS (SELECT name, string_agg(language || ' (' || n || ')', ', ' ORDER BY n DESC, language) AS languages FROM (SELECT name, language, count(*) AS n, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, language) AS r FROM s GROUP BY name, language) WHERE r <= 2 GROUP BY name),
    rc AS (SELECT name, string_agg(role || ' (' || n || ')', ', ' ORDER BY n DESC, role) AS roles FROM (SELECT name, role, count(*) AS n, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, role) AS r FROM s GROUP BY name, role) WHERE r <= 2 GROUP BY name),
    fp AS (SELECT name, string_agg(path, '|' ORDER BY path) AS paths FROM (SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY path) AS r FROM s) WHERE r <= 4 GROUP BY name)
    SELECT name, file_count, name || ' subsystem has ' || file_count || ' files and 0 symbols. Top languages: ' || languages || '. Top roles: ' || roles || '. Representative file: ' || string_split(paths, '|')[1] AS summary, paths AS representative_paths
    FROM c JOIN lc USING (name) JOIN rc USING (name) JOIN fp USING (name)""")
def subsystem_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("summary", F.col("path"))
    out = features.subsystems_of(f, f.select("path").limit(0))
    return out.select("name", "file_count", "summary", F.array_join("representative_paths", "|").alias("representative_paths"))


@query("symbol_left_join_role", "SELECT p_partkey, p_name, coalesce(s_name, 'source') AS role FROM part LEFT JOIN (SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0) ON p_partkey = s_suppkey")
def symbol_left_join_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("p_partkey"), "s_name")
    return read(spark, sf_dir, "part").select("p_partkey", "p_name").join(s, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("s_name", F.lit("source")).alias("role"))


@query("locate_score", """WITH l AS (SELECT split_part(min(p_name), ' ', 2) AS leaf FROM part), n AS (SELECT p_partkey, replace(p_name, ' ', '.') AS name, lower(p_type || ' ' || p_brand || ' ' || replace(p_name, ' ', '.')) AS said FROM part)
    SELECT p_partkey, name, CASE WHEN name = 'large.' || leaf THEN 1e0 WHEN name LIKE '%.' || leaf THEN round(0.6e0 + 0.4e0 * CAST(contains(said, 'large') AS INT), 3) ELSE 0.5e0 END AS score
    FROM n, l WHERE name = 'large.' || leaf OR name = leaf OR name ILIKE '%.' || leaf""")
def locate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    leaf = (part.agg(F.min("p_name")).first()[0].split(" ") + [""])[1]
    n = part.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(".")).alias("name"), "p_type", "p_brand")
    found = n.where((F.col("name") == f"large.{leaf}") | (F.col("name") == leaf) | F.col("name").ilike(f"%.{leaf}"))
    return found.select("p_partkey", "name", ranking.locate_score(f"large.{leaf}", leaf, F.col("name"), F.col("p_type"), F.col("p_brand")).alias("score")).orderBy(F.desc("score"), "p_partkey")


@query("usage_scan", r"""SELECT doc_id, left(trim(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\b(trash|worthless)\b'))[1]), 160) AS context
    FROM documents WHERE regexp_matches(text, '\b(trash|worthless)\b') AND source <> 'src1'""")
def usage_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = r"\b(trash|worthless)\b"
    hit = read(spark, sf_dir, "documents").where(F.col("text").rlike(pattern) & (F.col("source") != "src1"))
    first = F.get(F.filter(F.split("text", "\n"), lambda x: x.rlike(pattern)), F.lit(0))
    return hit.select("doc_id", F.substring(F.trim(first), 1, 160).alias("context"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory a conversation: its first user text, with evidence in three documents, of which one may be missing."""
    c = read(spark, sf_dir, "conversations").where("role = 'user'")
    m = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("summary"), F.count(F.lit(1)).alias("n"))
    refs = F.array(*[F.concat(F.lit("file:doc"), (F.col("conv_id") * k).cast("string")) for k in (1, 3, 11)])
    return m.select(F.col("conv_id").alias("memory_id"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"), "summary", refs.alias("evidence_refs"))


SQL_MEMORIES = """m AS (SELECT conv_id AS memory_id, 'Conversation ' || conv_id AS title, arg_min(text, turn) AS summary FROM conversations WHERE role = 'user' GROUP BY conv_id),
    h AS (SELECT memory_id, sha256(string_agg(coalesce(sha256(text), 'missing'), '|' ORDER BY pos)) AS hash FROM
          (SELECT memory_id, pos, memory_id * k AS d FROM m, (VALUES (1, 1), (2, 3), (3, 11)) AS v(pos, k)) LEFT JOIN documents ON d = doc_id GROUP BY memory_id)"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("file:doc"), F.col("doc_id").cast("string")).alias("ref"), F.sha2("text", 256).alias("hash"))


@query("evidence_hash", f"WITH {SQL_MEMORIES} SELECT memory_id, hash AS current_hash FROM h")
def evidence_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.evidence_hashes(memories(spark, sf_dir), hashes(spark, sf_dir))


def with_old_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third memory was written when its evidence was something else."""
    m = memories(spark, sf_dir)
    now = memory.evidence_hashes(m, hashes(spark, sf_dir))
    return m.join(now, "memory_id").withColumn("evidence_hash", F.when(F.col("memory_id") % 3 == 0, F.lit("old")).otherwise(F.col("current_hash"))).drop("current_hash")


@query("stale_memories", f"WITH {SQL_MEMORIES} SELECT memory_id, title, memory_id % 3 = 0 AS stale FROM m JOIN h USING (memory_id)")
def stale_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.with_staleness(with_old_hash(spark, sf_dir), hashes(spark, sf_dir)).select("memory_id", "title", "stale")


@query("memory_recall", f"""WITH {SQL_MEMORIES}, s AS (SELECT memory_id, memory_id % 3 = 0 AS stale, {sql_overlap("regexp_extract_all(lower(title || ' ' || summary), '[a-z_][a-z0-9_/-]+')", "conversation the of and")} AS s FROM m)
    SELECT memory_id, stale, round(s, 6) AS score FROM s WHERE s > 0 AND NOT stale ORDER BY s DESC, memory_id DESC LIMIT 3""")
def memory_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memory.with_staleness(with_old_hash(spark, sf_dir), hashes(spark, sf_dir))
    return memory.recall(m, text.query_terms("conversation the of and")).select("memory_id", "stale", rounded("score").alias("score"))


@query("capture_sessions", """SELECT conv_id, count(*) AS turns, arg_min(text, turn) FILTER (role = 'user') AS first_user, arg_min(text, turn) FILTER (role = 'assistant') AS first_assistant, min(turn) AS earliest, max(turn) AS latest,
    string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0""")
def capture_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    said = lambda r: F.min_by("text", F.when(F.col("role") == r, F.col("turn")))
    g = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), said("user").alias("first_user"), said("assistant").alias("first_assistant"), F.min("turn").alias("earliest"), F.max("turn").alias("latest"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count_if(F.col("role") == "user").alias("u"))
    return g.where("u > 0").drop("u")


@query("capture_dedupe", """WITH t AS (SELECT conv_id, turn, trim(left(text, 12)) AS title, role FROM conversations),
    k AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY conv_id, turn) AS r FROM t WHERE title <> '')
    SELECT conv_id, turn, title FROM k WHERE r = 1 AND title NOT IN (SELECT trim(left(text, 12)) FROM benchmark)""")
def capture_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.trim(F.substring("text", 1, 12))
    known = read(spark, sf_dir, "benchmark").select(title.alias("title")).distinct()
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", title.alias("title")).where("title <> ''")
    least = c.groupBy("title").agg(F.min(F.struct("conv_id", "turn")).alias("k"))  # the first of a title, without gathering a title's rows
    return least.join(known, "title", "left_anti").select("k.conv_id", "k.turn", "title")


@query("timeline_since", """SELECT kind, ref, "at", delta_summary FROM (
    SELECT 'file_changed' AS kind, 'file:' || event_id AS ref, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "at", event_type || ' u' || user_id || ' file changed' AS delta_summary FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-10'
    UNION ALL SELECT 'memory_added', 'memory:' || event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'Memory added: t' || event_id FROM events WHERE event_type NOT IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-10'
    UNION ALL SELECT 'memory_stale', 'memory:' || event_id, CASE WHEN event_id % 10 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END, 'Memory drifted from evidence: t' || event_id FROM events WHERE event_type NOT IN ('click', 'view') AND event_id % 5 = 0 AND (event_id % 10 = 0 OR ts >= TIMESTAMP '2024-01-10'))""")
def timeline_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    code = F.col("event_type").isin("click", "view")
    f = e.where(code).select(F.col("event_id").cast("string").alias("path"), F.col("event_type").alias("role"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("language"), F.col("at").alias("updated_at"))
    m = e.where(~code).select(F.col("event_id").alias("memory_id"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("title"), F.col("at").alias("created_at"), (F.col("event_id") % 5 == 0).alias("stale"), F.when(F.col("event_id") % 10 != 0, F.col("at")).alias("last_validated_at"))
    return memory.timeline(f, m, since="2024-01-10T00:00:00")


COSINE_SQL = """WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) AS s FROM embeddings, q)
    SELECT vec_id, round(s / (SELECT max(s) FROM s), 6) AS score FROM s WHERE s > 0 ORDER BY s DESC, vec_id LIMIT 20"""


@query("cosine_topk", COSINE_SQL)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    asked = e.orderBy("vec_id").first()["embedding"]
    return vector.cosine_scores(e, asked, "embedding").orderBy(F.desc("semantic"), "vec_id").limit(20).select("vec_id", rounded("semantic").alias("score"))


@query("embedding_delta", "SELECT CAST(doc_id AS VARCHAR) AS ref FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def embedding_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    now = d.select(F.col("doc_id").cast("string").alias("ref"), "text")
    stored = d.select(F.col("doc_id").cast("string").alias("ref"), F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.sha2("text", 256)).alias("content_hash"), F.when(F.col("doc_id") % 5 == 0, F.lit("other")).otherwise(F.lit("m")).alias("model"))
    return vector.delta(now, stored, "m").select("ref")


@query("cache_evict", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.evict(read(spark, sf_dir, "events").select("event_id", "ts"), 100, "ts", "event_id")


def two_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders")
    cols = lambda tag, h: (F.col("o_orderkey").alias("path"), h.alias("hash"), F.lit(tag).alias("updated_at"))
    old = o.where("o_orderkey % 4 <> 1").select(*cols("old", F.col("o_orderstatus")))
    new = o.where("o_orderkey % 4 <> 2").select(*cols("new", F.when(F.col("o_orderkey") % 3 == 0, F.lit("changed")).otherwise(F.col("o_orderstatus"))))
    return old, new


@query("upsert_merge", """SELECT o_orderkey AS path, CASE WHEN o_orderkey % 4 = 2 THEN o_orderstatus WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderstatus END AS hash,
    CASE WHEN o_orderkey % 4 = 2 THEN 'old' WHEN o_orderkey % 4 = 1 OR o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS updated_at FROM orders""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert(*two_versions(spark, sf_dir), "path", "hash")


@query("delete_missing", "SELECT o_orderkey AS path, o_orderstatus AS hash FROM orders WHERE o_orderkey % 4 NOT IN (1, 2)")
def delete_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = two_versions(spark, sf_dir)
    return merge.delete_missing(old, new, "path").select("path", "hash")


@query("missing_paths", "SELECT o_orderkey AS path FROM orders WHERE o_orderkey % 4 = 2")
def missing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.missing(*two_versions(spark, sf_dir), "path")


HITS = 200


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first HITS hits of a full-text query (the top-k of a search is what a budget is fitted to), with their rank and cost."""
    d = read(spark, sf_dir, "documents").select("doc_id", text.words("text").alias("tokens"), text.token_estimate("text").alias("cost"))
    hits = ranking.bm25(d, text.query_words(ASKED)).where("bm25 > 0").select("doc_id", rounded("bm25").alias("score"), "cost")
    return hits.orderBy(F.desc("score"), "doc_id").limit(HITS).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))).drop("score")


SQL_COSTS = f"""{BM25_SQL}, c AS MATERIALIZED (SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS BIGINT) AS cost, row_number() OVER (ORDER BY round(bm25, 6) DESC, doc_id) AS rank
    FROM raw JOIN documents USING (doc_id) ORDER BY rank LIMIT {HITS})"""


@query("retrieve_prefix_budget", f"WITH {SQL_COSTS} SELECT doc_id, rank, CAST(cost AS INTEGER) AS cost FROM (SELECT *, sum(cost) OVER (ORDER BY rank) AS s FROM c) WHERE s <= 60000")
def retrieve_prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.prefix_that_fits(costs(spark, sf_dir), 60000, ["rank"]).select("doc_id", "rank", "cost")


@query("pack_greedy_skip", f"""WITH RECURSIVE {SQL_COSTS}, walk AS (SELECT CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, false AS kept
    UNION ALL SELECT c.rank, CASE WHEN used + c.cost <= 60000 THEN used + c.cost ELSE used END, used + c.cost <= 60000 FROM walk JOIN c ON c.rank = walk.rank + 1)
    SELECT doc_id, c.rank, kept FROM walk JOIN c USING (rank)""")
def pack_greedy_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.greedy_skip(costs(spark, sf_dir), 60000).select("doc_id", "rank", "kept")


@query("retrieve_nested_break", f"""WITH RECURSIVE {SQL_COSTS}, walk AS (SELECT CAST(0 AS BIGINT) AS rank, CAST(100 AS BIGINT) AS used, false AS done, '' AS kept
    UNION ALL SELECT c.rank, CASE WHEN done OR used + c.cost // 10 > 60000 THEN used WHEN used + c.cost // 10 + c.cost > 60000 THEN used + c.cost // 10
                     WHEN used + c.cost // 10 + c.cost + c.cost // 2 > 60000 THEN used + c.cost // 10 + c.cost ELSE used + c.cost // 10 + c.cost + c.cost // 2 END,
           done OR used + c.cost // 10 > 60000 OR used + c.cost // 10 + c.cost + c.cost // 2 = 60000,
           CASE WHEN done OR used + c.cost // 10 > 60000 THEN kept ELSE kept || c.rank || ':' || CASE WHEN used + c.cost // 10 + c.cost > 60000 THEN 0 WHEN used + c.cost // 10 + c.cost + c.cost // 2 > 60000 THEN 1 ELSE 2 END || ',' END
           FROM walk JOIN c ON c.rank = walk.rank + 1)
    SELECT used, kept FROM walk ORDER BY rank DESC LIMIT 1""")
def retrieve_nested_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = costs(spark, sf_dir)
    out = budget.nested_break(c.select("rank", F.floor(F.col("cost") / 10).cast("long").alias("cost"), F.array("cost", F.floor(F.col("cost") / 2).cast("int")).alias("chunks")), 60000, 100)
    return out.select("used", F.array_join(F.transform("kept", lambda k: F.concat(k["rank"].cast("string"), F.lit(":"), k["n"].cast("string"), F.lit(","))), "").alias("kept"))


@query("eval_precision", """WITH x AS (SELECT b.item_id, b.item_id % 4 + 1 AS wanted, count(d.doc_id) AS found FROM benchmark b LEFT JOIN (SELECT DISTINCT item_id, doc_id FROM
      (SELECT item_id, text AS t FROM benchmark) JOIN documents ON contains(text, t)) d ON b.item_id = d.item_id GROUP BY ALL)
    SELECT item_id, found, round(least(found, wanted) / CAST(wanted AS DOUBLE), 3) AS precision, found >= wanted AS pass FROM x""")
def eval_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    # The items are few and bounded by a check; containment has no key, so their texts ride with each row in blocks.
    items = b.select("item_id", "text").orderBy("item_id").collect()
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = None
    for i in range(0, len(items), 200):
        block = F.array(*[F.when(F.col("text").contains(r["text"]), F.lit(r["item_id"])) for r in items[i : i + 200]])
        part = d.select("doc_id", F.explode(F.array_compact(block)).alias("item_id")).groupBy("item_id").agg(F.count(F.lit(1)).alias("found"))
        found = part if found is None else found.unionByName(part)
    x = b.join(found, "item_id", "left").withColumn("wanted", F.col("item_id") % 4 + 1).withColumn("found", F.coalesce("found", F.lit(0)).cast("long"))
    return x.select("item_id", "found", F.round(F.least("found", "wanted") / F.col("wanted").cast("double"), 3).alias("precision"), (F.col("found") >= F.col("wanted")).alias("pass"))


@query("byte_ranges", f"""WITH l AS (SELECT doc_id, text, {LINES} AS ls FROM documents),
    r AS (SELECT doc_id, text, ls, 3 AS a, greatest(3, least(len(ls), 6)) AS b FROM l),
    o AS (SELECT doc_id, octet_length(encode(text)) AS n, octet_length(encode(array_to_string(ls[1:2], chr(10)))) + 1 AS x, octet_length(encode(array_to_string(ls[1:b], chr(10)))) + 1 AS y FROM r)
    SELECT doc_id, CAST(least(n, x) AS INTEGER) AS byte_start, CAST(least(n, y) AS INTEGER) AS byte_end FROM o""")
def byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", features.byte_range(F.col("text"), F.lit(3), F.lit(6)).alias("r"))
    return d.select("doc_id", F.col("r.byte_start").cast("int").alias("byte_start"), F.col("r.byte_end").cast("int").alias("byte_end"))


@query("first_chunks", f"""WITH {SQL_FILES}, k AS (SELECT path, language, length(text) // 4 AS cost, row_number() OVER (PARTITION BY language, role ORDER BY length(text) // 4, path) AS r FROM f) SELECT path, language, cost FROM k WHERE r <= 2""")
def first_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("path", "language", "role", F.floor(F.length("text") / 4).alias("cost"))
    # cut by a hash first, so that no group is gathered in one place
    cut = first_rows(f.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(16))), ["language", "role", "part"], ["cost", "path"], 2)
    return first_rows(cut, ["language", "role"], ["cost", "path"], 2).select("path", "language", "cost")


@query("imports_found", r"""SELECT path, t AS target FROM (SELECT 'src' || (doc_id % 7) || '/m' || doc_id || '.py' AS path, unnest(list_distinct(['a/b' || (doc_id % 5), './u' || (doc_id % 3), '../x', 'os'])) AS t FROM documents)""")
def imports_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = read(spark, sf_dir, "documents"), F.col("doc_id")
    path = F.concat(F.lit("src"), (n % 7).cast("string"), F.lit("/m"), n.cast("string"), F.lit(".py"))
    body = F.concat(F.lit("from a.b"), (n % 5).cast("string"), F.lit(" import c\nfrom .u"), (n % 3).cast("string"), F.lit(" import v\n  import os\nfrom ..x import y\nimport os, sys\n"))
    found = features.imports_of(d.select(path.alias("path"), body.alias("text")))
    return found.select(F.substring("source_ref", 6, 1 << 30).alias("path"), F.substring("target_ref", 8, 1 << 30).alias("target"))


def sources(spark: SparkSession, sf_dir: str, ending: str) -> DataFrame:
    """A small program a document, with names from its id."""
    d, n = read(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    body = {
        "py": F.concat(F.lit("class A"), n, F.lit(":\n    def run(self, x):\n        return f"), n, F.lit("(x)\n\nasync def f"), n, F.lit("(a, b=1):\n    return A"), n, F.lit("\n")),
        "js": F.concat(F.lit("export async function go"), n, F.lit("() { return K"), n, F.lit("; }\nconst K"), n, F.lit(" = 1;\n")),
        "md": F.concat(F.lit("# Part "), n, F.lit("\ntext\n\nNotes on it:\nmore\n")),
    }[ending]
    return d.select(F.concat(F.lit("lib/s"), n, F.lit("." + ending)).alias("path"), body.alias("text"))


def symbol_query(ending: str) -> Query:
    return lambda spark, sf_dir: symbols.symbols_of(symbols.scan_symbols(sources(spark, sf_dir, ending))).select("symbol_id", "kind", "name", "signature", "line_start", "line_end", "hash")


QUERIES["py_symbols"] = symbol_query("py")
SQL["py_symbols"] = r"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS n FROM documents), s AS (
    SELECT n, 'class' AS kind, 'A' || n AS name, 'class A' || n AS signature, 1 AS a, 3 AS b, 'class A' || n || ':' || chr(10) || '    def run(self, x):' || chr(10) || '        return f' || n || '(x)' AS t FROM d
    UNION ALL SELECT n, 'function', 'run', 'def run(self, x)', 2, 3, '    def run(self, x):' || chr(10) || '        return f' || n || '(x)' FROM d
    UNION ALL SELECT n, 'function', 'f' || n, 'async def f' || n || '(a, b)', 5, 6, 'async def f' || n || '(a, b=1):' || chr(10) || '    return A' || n FROM d)
    SELECT 'symbol:lib/s' || n || '.py:' || name || ':' || a AS symbol_id, kind, name, signature, CAST(a AS INTEGER) AS line_start, CAST(b AS INTEGER) AS line_end, sha256(t) AS hash FROM s"""
QUERIES["js_symbols"], QUERIES["sections"] = symbol_query("js"), symbol_query("md")
SQL["js_symbols"] = r"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS n FROM documents), t AS (SELECT n, 'export async function go' || n || '() { return K' || n || '; }' AS x, 'const K' || n || ' = 1;' AS y FROM d)
    SELECT 'symbol:lib/s' || n || '.js:go' || n || ':1' AS symbol_id, 'symbol' AS kind, 'go' || n AS name, x AS signature, 1 AS line_start, 2 AS line_end, sha256(x || chr(10) || y) AS hash FROM t
    UNION ALL SELECT 'symbol:lib/s' || n || '.js:K' || n || ':2', 'symbol', 'K' || n, y, 2, 2, sha256(y) FROM t"""
SQL["sections"] = r"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS n FROM documents)
    SELECT 'symbol:lib/s' || n || '.md:Part ' || n || ':1' AS symbol_id, 'section' AS kind, 'Part ' || n AS name, 'Part ' || n AS signature, 1 AS line_start, 5 AS line_end, sha256('# Part ' || n || chr(10) || 'text' || chr(10) || chr(10) || 'Notes on it:' || chr(10) || 'more') AS hash FROM d
    UNION ALL SELECT 'symbol:lib/s' || n || '.md:Notes on it::4', 'section', 'Notes on it:', 'Notes on it:', 4, 5, sha256('Notes on it:' || chr(10) || 'more') FROM d"""


@query("references_found", """SELECT 'symbol:lib/s' || doc_id || '.py:A' || doc_id || ':1' AS source_ref, 'symbol:lib/s' || doc_id || '.py:run:2' AS target_ref, 0.6e0 AS weight FROM documents
    UNION ALL SELECT 'symbol:lib/s' || doc_id || '.py:A' || doc_id || ':1', 'symbol:lib/s' || doc_id || '.py:f' || doc_id || ':5', 0.6e0 FROM documents
    UNION ALL SELECT 'symbol:lib/s' || doc_id || '.py:run:2', 'symbol:lib/s' || doc_id || '.py:f' || doc_id || ':5', 0.6e0 FROM documents
    UNION ALL SELECT 'symbol:lib/s' || doc_id || '.py:f' || doc_id || ':5', 'symbol:lib/s' || doc_id || '.py:A' || doc_id || ':1', 0.6e0 FROM documents""")
def references_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.references_of(symbols.scan_symbols(sources(spark, sf_dir, "py"))).select("source_ref", "target_ref", "weight")
