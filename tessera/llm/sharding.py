"""Sharding by a hierarchical weighted hash tree.

A row's key descends three levels - region, rack, shard. At each level every child of the current
node draws ``-ln(u) / weight`` from a hash of (key, child's name) and the smallest draw wins, so a
child is taken with probability weight / sum of weights. A child's draw depends on nothing but the key,
its own name and its own weight. Therefore, when weights below one child change, rows move only
into or out of that child's subtree; a shard added as a new region of its own takes rows only into itself.

Law: ``key`` - doc_id and the tree decide. Under this law equal texts are no group: each row goes where its doc_id says, and a copy under another id may be in
another shard. Draws come from MD5, so that any engine can make them. Only built-in column functions run.

Defined results: a null ``doc_id`` is a key of its own (all such rows share a shard); a null text has size 8
and CRC 0; repeated rows go to the same shard, each with a slot of its own; an empty table gives no
rows; columns of any other name are ignored, also if they clash with the names made here (those kept keep their values). Very long texts are read for
their size and CRC only and never moved.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table, text_of

#: Buckets into which a shard's rows are cut so that slots are numbered in parallel: as many as HEX_DIGITS tell. Bounds the offset table.
HEX_DIGITS = 2


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def regular_tree(shards: int, regions: int = 3, racks: int = 4) -> list[Leaf]:
    """``shards`` equal leaves, dealt over regions and racks as evenly as they divide."""
    per_region = -(-shards // regions)
    per_rack = -(-per_region // racks)
    return [Leaf(f"g{s // per_region}", f"g{s // per_region}/k{s % per_region // per_rack}", s) for s in range(shards)]


def grown_tree(tree: list[Leaf]) -> list[Leaf]:
    """One more shard of weight 1, as a region of its own: it takes rows only into itself."""
    n = max(x.shard for x in tree) + 1
    return [*tree, Leaf(f"new{n}", f"new{n}/k0", n)]


def hashed(key: Column, name: Column, digits: int) -> Column:
    """The first hexadecimal digits of the MD5 of key and name, as a number; a null key has a text of its own."""
    said = F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("null")), name)
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, digits), 16, 10).cast("long")


def draw(key: Column, child: Column, weight: Column) -> Column:
    """Exponential draw of rate ``weight``, from 52 bits of a hash of the key and the child's name."""
    return -F.log((hashed(key, child, 13).cast("double") + F.lit(0.5)) / F.lit(float(2**52))) / weight


def levels(tree: list[Leaf]) -> list[list[list[tuple[str, float, int]]]]:
    """Of each level, the children of each node: name, weight, and the node's number on the next level (a leaf's: its shard)."""
    leaves = sorted((x for x in tree if x.weight > 0), key=lambda x: x.shard)
    regions = sorted({x.region for x in leaves})
    racks = [sorted({x.rack for x in leaves if x.region == r}) for r in regions]
    number = {k: i for i, k in enumerate((r, k) for r, ks in zip(regions, racks, strict=True) for k in ks)}
    total = lambda own: float(sum(x.weight for x in own))
    first = [(r, total(x for x in leaves if x.region == r), i) for i, r in enumerate(regions)]
    second = [[(k, total(x for x in leaves if (x.region, x.rack) == (r, k)), number[r, k]) for k in ks] for r, ks in zip(regions, racks, strict=True)]
    third = [[(f"s{x.shard}", float(x.weight), x.shard) for x in leaves if (x.region, x.rack) == node] for node in number]
    return [[first], second, third]


def descend(key: Column, tree: list[Leaf]) -> Column:
    """The shard number of ``key``: at each level the child of the least draw."""
    node = F.lit(0)
    for nodes in levels(tree):
        child = lambda c: F.struct(F.lit(c[0]).alias("name"), F.lit(c[1]).alias("weight"), F.lit(c[2]).alias("node"))
        children = F.get(F.array(*[F.array(*map(child, own)) for own in nodes]), node)
        node = F.array_min(F.transform(children, lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("draw"), c["node"].alias("node"))))["node"]
    return node.cast("int")


def assign(docs: DataFrame, tree: list[Leaf], key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, the columns in ``keep``, size, text_crc32, shard and grown_shard. No shuffle."""
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    k = docs[key]
    return docs.select(
        k.alias(key),
        *[docs[c] for c in keep],
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(k, tree).alias("shard"),
        descend(k, grown_tree(tree)).alias("grown_shard"),
    )


def with_slots(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number each shard's rows from 0 without gaps.

    Rows are numbered within (shard, hash bucket) groups, and each group starts at the number of rows in the
    shard's earlier buckets. The offset table has at most 256 rows a shard, whatever the input, so it is broadcast.
    The order within a bucket is by key and then size and CRC, so only rows equal in all of them may swap slots.
    """
    rows = rows.withColumn("_b", hashed(rows[key], rows["text_crc32"].cast("string"), HEX_DIGITS))
    counts = rows.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("shard", "_b", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_b")) - F.col("_n")).alias("_o"))
    number = F.row_number().over(Window.partitionBy("shard", "_b").orderBy(key, "size", "text_crc32"))
    return rows.withColumn("_r", number).join(F.broadcast(offsets), ["shard", "_b"]).withColumn("slot", (F.col("_o") + F.col("_r") - 1).cast("long")).drop("_b", "_r", "_o")


def shard_documents(docs: DataFrame, shards: int = 24, keep: tuple[str, ...] = ()) -> DataFrame:
    """Assignment of every document with its slot: the operator's result."""
    return with_slots(materialize(assign(docs, regular_tree(shards), keep=keep), "shards"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, files_per_shard: int = 64) -> None:
    """Write documents to one folder a shard. A shard's rows are split over up to ``files_per_shard`` tasks."""
    shard = descend(docs["doc_id"], regular_tree(shards))
    salt = F.pmod(F.xxhash64(docs["doc_id"], text_of(docs)), F.lit(files_per_shard))
    docs.withColumn("shard", shard).repartition(F.col("shard"), salt).write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def sql_shard(tree: list[Leaf]) -> str:
    """The tree's walk as SQL."""
    first, second, third = levels(tree)

    def least(own: list[tuple[str, float, int]], then: Callable[[int], str]) -> str:
        if len(own) == 1:
            return then(own[0][2])
        draws = ", ".join(f"-ln((CAST('0x' || substr(md5(k || '|{name}'), 1, 13) AS BIGINT) + 0.5e0) / {2**52}e0) / {weight}e0" for name, weight, _ in own)
        return f"CASE list_position([{draws}], list_min([{draws}])) " + " ".join(f"WHEN {i} THEN {then(node)}" for i, (_, _, node) in enumerate(own, 1)) + " END"

    return f"CAST({least(first[0], lambda r: least(second[r], lambda k: least(third[k], str)))} AS INTEGER)"


#: Polynomial, start and end value of CRC-32 (fixed values).
OP7_SQL = f"""
    WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END)) AS t),
    d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, encode(coalesce(text, '')) AS b FROM documents),
    c AS (SELECT doc_id, k, CAST(octet_length(b) + 8 AS BIGINT) AS size,
                 xor(list_reduce([{0xFFFFFFFF}::BIGINT] || list_transform(regexp_extract_all(hex(b), '..'), lambda v: CAST('0x' || v AS BIGINT)), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), {0xFFFFFFFF}) AS text_crc32
          FROM d, t),
    s AS (SELECT *, 'key' AS law, {sql_shard(regular_tree(24))} AS shard, {sql_shard(grown_tree(regular_tree(24)))} AS grown_shard,
                 substr(md5(k || '|' || text_crc32), 1, {HEX_DIGITS}) AS bucket FROM c)
    SELECT doc_id, size, text_crc32, law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM s"""
