"""The pipeline against its stages applied by brute force, and its guard."""

from __future__ import annotations

import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import data

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good and bad labelled documents, near copies, benchmark passages and toxic words."""
    rng = random.Random(8)
    bench = [(i, data.prose(rng, 15)) for i in range(3)]
    docs, labels = [], []
    for i in range(500):
        good, toxic, text = i % 4 > 0, i % 9 == 0, data.prose(rng, rng.randint(40, 90))
        if i % 10 == 3 and i > 10:
            words = docs[i - 10][1].split(" ")
            text = " ".join([*words[:-1], "changed"])
        elif not good:
            text = text.upper().replace(" ", "!! ")
        elif i % 25 == 6:
            text = f"{text} {bench[i % 3][1]} end"
        docs.append((i, f"{text} moron scum trash" if toxic and i % 10 != 3 else text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(good), int(toxic)))
    path = tmp_path_factory.mktemp("tables")
    data.frame(spark, docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, labels, bench


def test_stages_take_effect(spark, folder):
    path, rows, labels, bench = folder
    quality = {i: q for i, q, _ in labels}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept: dict[str, list[int]] = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, path), name)
        assert docs.columns == columns
        kept[name] = sorted(r["doc_id"] for r in docs.collect())
        assert len(set(kept[name])) == len(kept[name])
    text = {r[0]: r[1] for r in rows}
    assert sum(quality[i] != 1 for i in kept["quality"]) <= 5
    assert sum(i not in set(kept["quality"]) for i in quality if quality[i] == 1 and "changed" not in text[i]) <= 5
    groups = data.classes([(i, text[i]) for i in kept["quality"]])
    assert kept["near_dedup"] == sorted(set(groups.values()))
    windows = [w for _, b in bench for w in [" ".join(data.words(b)[k : k + 10]) for k in range(len(data.words(b)) - 9)]]
    clean = [i for i in kept["near_dedup"] if not any(f" {w} " in f" {' '.join(data.words(text[i]))} " for w in windows)]
    assert kept["decontaminate"] == clean and len(clean) < len(kept["near_dedup"])
    toxic = [i for i in kept["decontaminate"] if "moron" in text[i]]
    assert sum(i in set(kept["mixing"]) for i in toxic) < len(toxic) / 2
    assert sum(i not in set(kept["mixing"]) for i in clean if i not in toxic) <= 3
    last = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert sorted(r["doc_id"] for r in last) == kept["mixing"]
    whole = corpus_pipeline.run(spark, path)
    assert sorted(map(str, whole.collect())) == sorted(map(str, last))


def test_stages_on_empty_documents(spark, folder):
    path = folder[0]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, data.frame(spark, []), path).count() == 0


def test_stages_on_hard_cases(spark, folder):
    docs = data.frame(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, folder[0]), name)
        assert out.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().count() <= docs.count()


def test_near_dedup_keeps_a_row_of_each_class(spark, folder):
    """Unique texts without id stay, as does each text of an id that has several unrelated ones; copies go, whatever the order of the rows."""
    rng = random.Random(21)
    a, b, c, d, e = (data.prose(rng, 40 + i) for i in range(5))
    rows = [(None, a), (None, b), (None, b + " end"), (1, c), (1, d), (2, d), (None, d), (3, e), (3, e)]
    rows = [(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)]
    kept = [[tuple(r) for r in corpus_pipeline.near_dedup(spark, data.frame(spark, some).coalesce(1), folder[0]).collect()] for some in (rows, rows[::-1])]
    assert sorted(map(str, kept[0])) == sorted(map(str, kept[1]))
    got = [(r[0], r[1]) for r in kept[0]]
    assert sorted(map(str, (x for x in got if x[1] not in (b, b + " end")))) == sorted(map(str, [(None, a), (1, c), (1, d), (3, e)]))
    assert len(got) == 5 and set(kept[0]) <= set(rows)


def test_entry_works_without_the_corpus_operators(tmp_path):
    """The rest imports and lists its queries when the folders are gone."""
    for name in ("__spark_entry__.py", "bench.py"):
        (tmp_path / name).write_text((ROOT / name).read_text())
    for f in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in f.parts:
            to = tmp_path / f.relative_to(ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(f.read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, corpus, right = said.stdout.split()
    assert int(n) > 30 and corpus == "False" and right == "True"
