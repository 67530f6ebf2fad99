"""From file contents to rows: admission, features, windows of lines, imports, byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import paths, text
from tessera.functions.columns import col


#: Characters of a summary, and of the head of a text that it is mostly found in.
SUMMARY = 180
HEAD = 400


def leading(body: Column | str) -> Column:
    """The first six non-blank lines in one, 180 characters at most.

    The head of the text says it where the head has enough of them: a line that the head cuts only lacks its end. Otherwise the whole text is cut into lines.
    """
    t = col(body)
    joined = lambda x: F.array_join(F.slice(F.filter(F.transform(text.lines(x), text.strip), lambda y: y != ""), 1, 6), " ")
    decided = lambda h: F.when((F.length(t) <= HEAD) | (F.length(h) >= SUMMARY), h).otherwise(joined(t))
    return F.substring(F.get(F.transform(F.array(joined(F.substring(t, 1, HEAD))), decided), F.lit(0)), 1, SUMMARY)  # binds the head, which is used twice


def snippet(body: Column | str) -> Column:
    """The leading lines, or that there are none."""
    short = leading(body)
    return F.when(short != "", short).otherwise(F.lit("Minimal textual content."))


def file_features(contents: DataFrame, policy: config.Policy | None = None, now: str | None = None) -> DataFrame:
    """files rows of contents (path, text)."""
    role, language = paths.role_of("path", (policy or config.Policy()).role_overrides), paths.language_of("path")
    base = contents.select("path", "text", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size_bytes"), language.alias("language"), role.alias("role"))
    summary = F.concat(F.col("role"), F.lit(" file in "), F.col("language"), F.lit(" for subsystem "), paths.subsystem_of("path"), F.lit(": "), F.col("path"), F.lit(". Key content: "), snippet("text"))
    return base.select("path", "hash", "size_bytes", "language", "role", summary.alias("summary"), F.lit(now).cast("string").alias("updated_at"))


def admitted(listed: DataFrame) -> DataFrame:
    """Of (path, size, content) the files that are text: size, name, suffix and UTF-8 decide. Returns (path, text)."""
    name = paths.name_of("path")
    known = paths.suffix_of("path").isin(list(config.LANGUAGES)) | name.isin(list(config.ROLE_HINTS))
    fits = listed.where((F.col("size") <= config.MAX_FILE_BYTES) & ~name.contains(".min.") & known)
    valid = fits.where(F.is_valid_utf8(F.col("content").cast("string")))
    return valid.select("path", text.universal_newlines(F.decode("content", "UTF-8")).alias("text"))


def window_chunks(contents: DataFrame) -> DataFrame:
    """Windows of 40 lines, 32 apart, of (path, text); the last is the first that reaches the end. Blank windows are left out."""
    n = F.size("lines")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(config.CHUNK_STEP)), lambda s: (n > 0) & ((s == 0) | (s + config.CHUNK_OVERLAP < n)))
    cut = contents.select("path", text.lines("text").alias("lines")).select("path", "lines", n.alias("n"), F.explode(starts).alias("s"))
    body = text.strip(F.array_join(F.slice("lines", F.col("s") + 1, config.CHUNK_LINES), "\n"))
    rows = cut.select("path", (F.col("s") + 1).alias("line_start"), F.least("n", F.col("s") + config.CHUNK_LINES).alias("line_end"), body.alias("text")).where("text <> ''")
    return rows.select(
        F.concat_ws("", "path", F.lit(":"), "line_start", F.lit("-"), "line_end").alias("chunk_id"),
        "path",
        F.lit(None).cast("string").alias("symbol_id"),
        "line_start",
        "line_end",
        "text",
        F.substring(text.strip(F.get(text.lines("text"), F.lit(0))), 1, 160).alias("summary"),
        text.token_estimate("text").alias("token_estimate"),
        F.sha2("text", 256).alias("hash"),
        F.lit("window").alias("chunk_type"),
    )


def chunks_of(contents: DataFrame, symbols: DataFrame) -> DataFrame:
    """A chunk a symbol where a file has symbols, else windows. ``symbols`` has a column text."""
    windows = window_chunks(contents.join(symbols.select("path").distinct(), "path", "left_anti"))
    own = symbols.select(
        F.concat_ws("", "symbol_id", F.lit(":"), "line_start", F.lit("-"), "line_end").alias("chunk_id"),
        "path", "symbol_id", "line_start", "line_end", "text", "summary", "token_estimate", F.sha2("text", 256).alias("hash"), F.lit("symbol").alias("chunk_type"),
    ).dropDuplicates(["chunk_id"])
    return windows.unionByName(own)


def byte_range(body: Column, line_start: Column, line_end: Column) -> Column:
    """struct(byte_start, byte_end) of a range of lines; line ends count, lines are held within the text. ``body`` has only \\n line ends."""
    last = F.when(body.endswith("\n"), 1).otherwise(0)
    parts = F.split(body, "\n", -1)
    n = F.size(parts) - last
    first = F.greatest(line_start, F.lit(1))
    end = F.greatest(first, F.least(n, line_end))
    upto = lambda k: F.least(F.octet_length(body), F.octet_length(F.array_join(F.slice(parts, 1, F.greatest(k, F.lit(0))), "\n")) + F.when(k > 0, 1).otherwise(0))
    empty = F.struct(F.lit(0).alias("byte_start"), F.lit(0).alias("byte_end"))
    return F.when(body == "", empty).otherwise(F.struct(upto(first - 1).alias("byte_start"), upto(end).alias("byte_end")))


def dotted(module: Column) -> Column:
    """A module path with slashes; leading dots become ./ or ../ as many as levels."""
    level = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    prefix = F.when(level == 1, F.lit("./")).otherwise(F.repeat(F.lit("../"), level - 1))
    return F.when(level == 0, rest).when(rest == "", F.regexp_replace(prefix, "/$", "")).otherwise(F.concat(prefix, rest))


def imports_of(contents: DataFrame) -> DataFrame:
    """Unresolved import edges of (path, text), each once a file."""
    ext = F.regexp_extract(F.lower("path"), r"\.([^.]*)$", 1)
    js1 = F.regexp_extract_all("text", F.lit(r"""(?:import|export)[^"']*["']([^"']+)["']|(?:require|import)\s*\(\s*["']([^"']+)["']\s*\)"""), F.lit(1))
    js2 = F.regexp_extract_all("text", F.lit(r"""(?:import|export)[^"']*["']([^"']+)["']|(?:require|import)\s*\(\s*["']([^"']+)["']\s*\)"""), F.lit(2))
    script = F.filter(F.concat(js1, js2), lambda x: (x != "") & ~x.startswith("http"))
    used = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^\s*use\s+([\w\\]+)\s*;"), F.lit(1)), lambda x: F.replace(x, F.lit("\\"), F.lit("/")))
    other = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:from|import)\s+([A-Za-z0-9_./]+)"), F.lit(1)), dotted)
    found = F.when(ext.isin("js", "jsx", "ts", "tsx"), script).when(ext == "php", used).otherwise(other)
    each = contents.select("path", F.explode(F.array_distinct(found)).alias("target"))
    return each.select(F.concat(F.lit("file:"), "path").alias("source_ref"), F.concat(F.lit("import:"), "target").alias("target_ref"), F.lit("imports").alias("relation_type"), F.lit(1.0).alias("weight"))


def overview_counts(files: DataFrame, by: str) -> DataFrame:
    """Files a value, most first, then by name."""
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by)


def top_dir(path: Column | str) -> Column:
    p = col(path)
    return F.when(p.contains("/"), F.substring_index(p, "/", 1)).otherwise(F.lit("."))


def named_counts(rows: DataFrame, group: str, value: str, most: int) -> DataFrame:
    """group, text: the ``most`` commonest values of each group as "value (count)", ties by name."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    ordered = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v")))), 1, most)
    return counts.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["v"], F.lit(" ("), (-x["m"]).cast("string"), F.lit(")"))), ", ").alias("text"))


def subsystems_of(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Subsystem rows. The representative file and the four paths are the first by path.

    The counts combine on the map side; the paths come from a bounded aggregate, so no subsystem's files are gathered.
    """
    f = files.withColumn("name", paths.subsystem_of("path"))
    # the k-th least path by k passes of min would read the files k times; ranks within hash parts bound what meets in one place
    small = f.select("name", "path", "summary").withColumn("part", F.pmod(F.xxhash64("path"), F.lit(32)))
    first = first_rows(first_rows(small, ["name", "part"], ["path"], 4), ["name"], ["path"], 4)
    lead = first.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("path", "summary"))).alias("lead"))
    count = f.groupBy("name").agg(F.count(F.lit(1)).alias("file_count"))
    own = symbols.groupBy(paths.subsystem_of("path").alias("name")).agg(F.count(F.lit(1)).alias("symbol_count"))
    joined = count.join(lead, "name").join(named_counts(f, "name", "language", 2).withColumnRenamed("text", "languages"), "name").join(named_counts(f, "name", "role", 2).withColumnRenamed("text", "roles"), "name").join(own, "name", "left").na.fill(0, ["symbol_count"])
    summary = F.concat(F.col("name"), F.lit(" subsystem has "), F.col("file_count").cast("string"), F.lit(" files and "), F.col("symbol_count").cast("string"), F.lit(" symbols. Top languages: "), F.col("languages"), F.lit(". Top roles: "), F.col("roles"), F.lit(". Representative file: "), F.col("lead")[0]["summary"])
    return joined.select("name", summary.alias("summary"), F.col("lead.path").alias("representative_paths"), "file_count", F.col("symbol_count").cast("long").alias("symbol_count"))


def first_rows(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group."""
    from pyspark.sql import Window

    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")
