"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

    z = b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),   score = 1 / (1 + exp(-z))

The pairwise term needs only sums over a document's features, so scoring is linear in its words. Features:

* hashed words - BUCKETS buckets, x = log(1 + count) / sqrt(sum of squares) over the document's words;
* statistics - shares of upper case, digits, spaces, line ends and marks among the bytes, word lengths, share of distinct words and of
  words said before, words a line, the commonest mark's share, log sizes; standardised with the training rows' mean and spread.

Neither doc_id nor lang, source or labels is an input of a score. The model is fitted on at most SAMPLE labelled rows (those of the least hash of doc_id, so
the choice is fixed), given to the driver as feature arrays of at most BUCKETS + statistics numbers a row. Scoring covers every row and whole texts.

Defined results: null and empty texts have the features of an empty text and are scored; repeated rows and ties get equal scores; rows without doc_id are scored
too and count as not held out; of an id with several texts the one of the least hash is the training row, and of several labels the least; with no labelled rows, or of
one class only, the score is the share of label 1 (0.5 without rows); an empty table gives no rows; columns of other names are carried along, and the score takes a
name that none of them has. Very long texts are worked through whole, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.common import table, text_of
from tessera.llm.textnum import IS_WORD, U, buffers, copies, slices, words

BUCKETS = 1 << 12
RANK = 4
SAMPLE = 8000
THRESHOLD = 0.7
STATISTICS = 26


@dataclass
class Model:
    bias: float
    weight: np.ndarray  # of the buckets, then of the statistics
    factor: np.ndarray  # (buckets + statistics, rank)
    mean: np.ndarray
    spread: np.ndarray


def statistics(data: np.ndarray, at: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, word_at: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Structure statistics, a row each. ``distinct``: the number of different words of each row."""
    rows = len(at) - 1
    kinds = np.zeros(256, np.uint8)
    kinds[65:91], kinds[97:123], kinds[48:58], kinds[128:], kinds[10], kinds[32] = 1, 2, 3, 4, 5, 6
    for i, mark in enumerate(b".,!|*&$%#=<{", 7):
        kinds[mark] = i
    row = np.repeat(np.arange(rows), np.diff(at))
    count = np.bincount(row * 20 + kinds[data], minlength=rows * 20).reshape(rows, 20).astype(float)
    n, w = np.maximum(np.diff(at), 1), np.maximum(np.diff(word_at), 1)
    word_row = np.repeat(np.arange(rows), np.diff(word_at))
    total = np.bincount(word_row, lengths, rows)
    square = np.bincount(word_row, lengths.astype(float) ** 2, rows)
    mean = total / w
    lines = count[:, 5] + 1
    said_last = np.zeros(len(hashes), bool)
    said_last[1:] = (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])
    marks = count[:, 7:19]
    columns = [
        *(count[:, i] / n for i in (1, 3, 4, 5, 6)),
        *(count[:, i] / n for i in range(7, 19)),
        np.log1p(n), np.log1p(np.diff(word_at)), mean / 10, np.sqrt(np.maximum(square / w - mean**2, 0)) / 10,
        distinct / w, np.log1p(w / lines), np.bincount(word_row, said_last, rows) / w,
        marks.sum(1) / w, np.sqrt(count[:, 1] / np.maximum(count[:, 1] + count[:, 2], 1)),
    ]
    return np.stack(columns, 1)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each feature that is present: row, bucket and value; and the statistics of each row."""
    data, at = buffers(column)
    hashes, lengths, word_at = words(data, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(word_at))
    key_row, key, count = copies(hashes, row)
    distinct = np.bincount(key_row, minlength=len(at) - 1)
    bucket = (key >> U(40)).astype(np.int64) % BUCKETS
    order = np.argsort(key_row * BUCKETS + bucket, kind="stable")
    code, count = (key_row * BUCKETS + bucket)[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    value = np.log1p(np.add.reduceat(count, first)) if len(first) else np.zeros(0)
    row, bucket = code[first] // BUCKETS, code[first] % BUCKETS
    norm = np.sqrt(np.bincount(row, value**2, len(at) - 1))
    return row, bucket, value / np.maximum(norm[row], 1e-9), statistics(data, at, hashes, lengths, word_at, distinct)


def forward(m: Model, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """z of each row, and the sums over v x that its gradient needs."""
    rows, sums = len(stats), []
    z = m.bias + np.bincount(row, m.weight[bucket] * value, rows) + stats @ m.weight[BUCKETS:]
    for f in range(m.factor.shape[1]):
        vx = m.factor[bucket, f] * value
        s = np.bincount(row, vx, rows) + stats @ m.factor[BUCKETS:, f]
        z += 0.5 * (s**2 - np.bincount(row, vx**2, rows) - stats**2 @ m.factor[BUCKETS:, f] ** 2)
        sums.append(s)
    return z, np.stack(sums, 1)


def standard(m: Model, stats: np.ndarray) -> np.ndarray:
    return np.clip((stats - m.mean) / m.spread, -4, 4)


def fit(parts: list[tuple], label: np.ndarray, rounds: int = 60, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Adam on the logistic loss over mini-batches of the sample, fixed seed. parts: (buckets, values, statistics) a row."""
    rng = np.random.default_rng(7)
    stats = np.stack([s for _, _, s in parts]) if parts else np.zeros((0, STATISTICS))
    size = BUCKETS + STATISTICS
    share = float(label.mean()) if len(label) else 0.5
    m = Model(float(np.log((share + 1e-3) / (1 - share + 1e-3))), np.zeros(size), np.zeros((size, RANK)), np.zeros(STATISTICS), np.ones(STATISTICS))
    if len(label) == 0 or share in (0.0, 1.0):
        return m
    m.mean, m.spread = stats.mean(0), stats.std(0) + 1e-3
    m.factor = rng.normal(0, 0.01, (size, RANK))
    x = standard(m, stats)
    weights = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))  # classes count alike
    weights = np.sqrt(weights)
    theta = [np.array([m.bias]), m.weight, m.factor]
    moment, spread = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(label))
        for a in range(0, len(order), 256):
            pick = order[a : a + 256]
            row = np.repeat(np.arange(len(pick)), [len(parts[i][0]) for i in pick])
            bucket = np.concatenate([parts[i][0] for i in pick])
            value = np.concatenate([parts[i][1] for i in pick])
            m.bias = float(theta[0][0])
            z, s = forward(m, row, bucket, value, x[pick])
            g = weights[pick] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[pick]) / len(pick)
            gw = np.concatenate([np.bincount(bucket, g[row] * value, BUCKETS), g @ x[pick]])
            gv = np.empty_like(m.factor)
            for f in range(RANK):
                gv[:BUCKETS, f] = np.bincount(bucket, g[row] * value * (s[row, f] - m.factor[bucket, f] * value), BUCKETS)
                gv[BUCKETS:, f] = (g * s[:, f]) @ x[pick] - m.factor[BUCKETS:, f] * (g @ x[pick] ** 2)
            step += 1
            for i, grad in enumerate((np.array([g.sum()]), gw + decay * m.weight, gv + decay * m.factor)):
                moment[i] = 0.9 * moment[i] + 0.1 * grad
                spread[i] = 0.99 * spread[i] + 0.01 * grad**2
                theta[i] -= rate * (moment[i] / (1 - 0.9**step)) / (np.sqrt(spread[i] / (1 - 0.99**step)) + 1e-6)
        rate *= 0.95
    m.bias = float(theta[0][0])
    return m


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1):
            row, bucket, value, stats = features(batch.column(1))
            cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(stats)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(pa.array(cut), pa.array(value)), pa.array(list(stats), pa.list_(pa.float64()))]
            yield pa.record_batch([batch.column(0), *lists], names=["label", "bucket", "value", "stats"])


def sample_of(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Text and label of the training rows: not held out, at most ``most``."""
    wanted = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label"))
    wanted = wanted.where(F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2)
    wanted = wanted.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    d = docs.select(docs["doc_id"].cast("long").alias("id"), text_of(docs).alias("text"))
    own = d.join(F.broadcast(wanted), "id")
    return own.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    found = sample_of(docs, labels, most)
    rows = found.select(F.struct("id", "label").alias("label"), "text").mapInArrow(_features_of, "label struct<id long, label int>, bucket array<int>, value array<double>, stats array<double>").toArrow().combine_chunks()
    given = pc.struct_field(rows.column("label"), [0]).to_numpy(), pc.struct_field(rows.column("label"), [1]).to_numpy()
    lists = {c: rows.column(c).combine_chunks() for c in ("bucket", "value", "stats")} if rows.num_rows else {}
    flat = {c: (x.flatten().to_numpy(), x.offsets.to_numpy() - x.offsets[0].as_py()) for c, x in lists.items()}
    # In order of id, so that the fit doesn't depend on how rows arrive.
    order = np.argsort(given[0], kind="stable")
    parts = [tuple(x[at[i] : at[i + 1]] for x, at in flat.values()) for i in order]
    return fit(parts, given[1][order].astype(float))


def score(docs: DataFrame, model: Model, name: str = "_score", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all without it) of ``docs``, which must have a column text, with a column ``name``."""
    kept = docs.columns if keep is None else keep

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.schema.get_field_index("text")):
                row, bucket, value, stats = features(batch.column("text"))
                z, _ = forward(model, row, bucket, value, standard(model, stats))
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield batch.select(kept).append_column(name, pa.array(p))

    return docs.mapInArrow(scored, StructType([*(docs.schema[c] for c in kept), StructField(name, DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, all columns as they are."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    return score(docs, train(docs, labels), name).where(F.col(name) >= threshold).drop(name)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels)
    out = score(docs.select("doc_id", text_of(docs).alias("text")), model, keep=["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
