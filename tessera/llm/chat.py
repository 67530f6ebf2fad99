"""Chat formatting with a grammar round trip.

Template:  conversation := "<s>" turn*
           turn := "[OUT:" level ":" role "]" body "</s>"            (assistant)
                 | "[INST:" level ":" role "]" body "[/INST]"        (any other role)

Level 0 bodies are the text itself; level 1 bodies are escaped: each backslash is doubled, and each control string is broken by a
backslash after its first character, so no control string of a text ever stands raw in the output. Roles are URL-encoded. A conversation is rendered with
every turn that holds a control string at level 1 and read again by a deterministic parser: what stands before an end mark is a turn, whose head tells kind,
level and role; the turns found, written out anew, must give the whole string. If they differ from the source, all turns are escaped and the whole is
rendered and read again; a rendering that still differs stops the job.

Only built-in column functions run. Defined results: null text, role and turn are empty, empty, and first in order; turns of equal
number are ordered by role and text; repeated rows stay repeated turns; a null conv_id is a conversation; an empty table has none;
other columns are ignored, also those named like columns made here. A conversation is one row of the result, so it is put together in one place
whatever its length; very long texts are scanned once an end mark, without recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

#: Strings that the template gives a meaning.
CONTROL = r"(<|\[)(/?)(s>|INST|OUT)"
#: What ends a turn.
END = r"\[/INST\]|</s>"
#: Texts that hold the template's own control strings.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2$3")


def unescape(body: Column) -> Column:
    return F.regexp_replace(body, r"(?s)\\(.)", "$1")


def written(kind: Column, level: Column, role: Column, body: Column) -> Column:
    """A turn: its head, body and end mark."""
    ours = kind == "OUT"
    return F.concat(F.lit("["), kind, F.lit(":"), level, F.lit(":"), role, F.lit("]"), body, F.when(ours, F.lit("</s>")).otherwise(F.lit("[/INST]")))


def render(turns: Column, all_raised: bool = False) -> Column:
    """The formatted conversation of an array of (role, text); ``all_raised`` escapes texts without control strings too."""

    def one(t: Column) -> Column:
        raised = F.lit(True) if all_raised else t["text"].rlike(CONTROL)
        body = F.when(raised, escape(t["text"])).otherwise(t["text"])
        kind = F.when(t["role"] == "assistant", F.lit("OUT")).otherwise(F.lit("INST"))
        return written(kind, F.when(raised, F.lit("1")).otherwise(F.lit("0")), F.url_encode(t["role"]), body)

    return F.concat(F.lit("<s>"), F.array_join(F.transform(turns, one), ""))


def parse(formatted: Column) -> Column:
    """The (role, text, loss) of each turn; null unless the grammar covers the whole string."""
    pieces = F.split(F.substring(formatted, 4, 1 << 30), END, -1)

    def cut(piece: Column) -> Column:
        head = F.substring_index(piece, "]", 1)
        named = F.split(F.substring(head, 2, 1 << 30), ":")
        return F.struct(F.get(named, F.lit(0)).alias("kind"), F.get(named, F.lit(1)).alias("level"), F.get(named, F.lit(2)).alias("role"), F.substring(piece, F.length(head) + 2, F.length(piece)).alias("body"))

    def read(z: Column) -> Column:
        text = F.when(z["level"] == "1", unescape(z["body"])).otherwise(z["body"])
        return F.struct(F.url_decode(z["role"]).alias("role"), text.alias("text"), (z["kind"] == "OUT").alias("loss"))

    # What follows the last end mark is no turn and must be empty; writing the pieces out again shows that each is a turn of the grammar.
    found = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), cut)
    known = F.forall(found, lambda z: z["kind"].isin("OUT", "INST") & z["level"].isin("0", "1"))
    whole = F.concat(F.lit("<s>"), F.array_join(F.transform(found, lambda z: written(z["kind"], z["level"], z["role"], z["body"])), "")) == formatted
    return F.when(known & whole, F.transform(found, read))


def gather(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order."""
    c = conversations
    turn = F.struct(c["turn"].cast("long").alias("turn"), F.coalesce(c["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(c["text"].cast("string"), F.lit("")).alias("text"))
    ordered = c.groupBy(c["conv_id"].cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def same(recovered: Column, turns: Column) -> Column:
    pairs = F.transform(recovered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return F.coalesce(pairs == turns, F.lit(False))


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, and the turns that the parser finds in it, which are those of the source."""
    first = gather(conversations).withColumn("formatted", render(F.col("turns")))
    tried = first.withColumn("recovered", parse(F.col("formatted"))).withColumn("fits", same(F.col("recovered"), F.col("turns")))
    again = tried.withColumn("formatted", F.when(F.col("fits"), F.col("formatted")).otherwise(render(F.col("turns"), all_raised=True)))
    again = again.withColumn("recovered", F.when(F.col("fits"), F.col("recovered")).otherwise(parse(F.col("formatted"))))
    sound = F.when(F.col("fits") | same(F.col("recovered"), F.col("turns")), F.col("recovered"))
    return again.select("conv_id", "formatted", F.coalesce(sound, F.raise_error(F.lit("a conversation can't be read back"))).alias("turns"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id and formatted, each checked by reading it back."""
    return formatted_turns(conversations).select("conv_id", "formatted")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted and the turns that the parser finds in it."""
    return formatted.withColumn("turns", parse(F.col("formatted")))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = ", ".join(f"({conv_id}L, {turn}L, '{role}', '{text}')" for conv_id, turn, role, text in PROBE)
    r = formatted_turns(c.unionByName(spark.sql(f"SELECT * FROM VALUES {rows} AS probe(conv_id, turn, role, text)")))
    said = r.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("all"),
        F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return said.select("conv_id", "n_turns", F.sha2("all", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP8_SQL = r"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    k AS (SELECT *, regexp_matches(text, '(<|\[)/?(s>|INST|OUT)') AS has FROM c),
    b AS (SELECT *, length(text) + CASE WHEN has THEN length(text) - length(replace(text, '\', ''))
                 + len(regexp_extract_all(text, '(<|\[)/?(s>|INST|OUT)')) ELSE 0 END
                 + length(role) + CASE WHEN role = 'assistant' THEN 12 ELSE 16 END AS chars FROM k)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
    FROM b GROUP BY conv_id"""
