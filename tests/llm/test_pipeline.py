"""The pipeline against a brute-force version, and life without this package."""

from __future__ import annotations

import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from windrose.llm import toxicity as tox
from windrose.llm.queries import ORACLE_SQL, QUERIES, tokenizer

from .conftest import SCHEMA
from .test_decontamination import by_hand as contaminated_by_hand
from .test_models import held
from .test_near_copies import kept_by_hand

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture
def corpus(spark, tmp_path):
    random.seed(11)
    vocabulary = [f"w{k}" for k in range(400)]
    line = lambda: " ".join(random.choices(vocabulary, k=8))
    shared = "\n".join(line() for _ in range(4))
    items = [(k, " ".join(random.choices(vocabulary, k=20))) for k in range(4)]
    rows, labels = [], []
    for i in range(160):
        text, toxic = "\n".join(line() for _ in range(random.randint(1, 8))), i % 5 == 0
        if toxic:
            text += "\n" + " ".join(random.choices(["dolt", "oaf"], k=3)) + "."
        elif i % 7 == 0:
            text = shared + "\n" + text
        elif i % 11 == 0:
            text = rows[i // 2][1] or ""
        elif i % 13 == 0:
            text += "\n" + items[i % 4][1]
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(toxic)))
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, df in (("documents", docs), ("labels", spark.createDataFrame(labels, "doc_id long, toxic int")), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        df.coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path), rows, dict(labels), items


def test_run_matches_brute_force(spark, corpus):
    sf, rows, labels, items = corpus
    model = tox.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    score = model.scorer()
    left = [(i, t) for i, t, *_ in rows if score(t or "")[0] < 0.3]
    assert {i for i, y in labels.items() if y and not held(i, 4)}.isdisjoint(i for i, _ in left)
    seen, shorter = set(), []
    for i, t in sorted(left):
        lines, gone = (t or "").split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            gone |= {k, k + 1, k + 2} if w in seen else set()
            seen.add(w)
        shorter.append((i, t if t is None or not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    stays = kept_by_hand(shorter)
    apart = [(i, t) for i, t in shorter if i in stays]
    bad = {r[0] for r in contaminated_by_hand(apart, items) if r[5]}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    want = {i: sp.encode(t or "", add_bos=True, add_eos=True) for i, t in apart if i not in bad}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and bad and len(apart) < len(shorter) < len(rows)


def test_stages_keep_columns_and_take_odd_tables(spark, corpus, odd, empty):
    sf = corpus[0]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (odd, empty):
            assert stage(spark, df, sf).columns == df.columns, name
            stage(spark, df, sf).write.format("noop").mode("overwrite").save()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]


def test_a_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_the_rest_works_without_this_package(tmp_path):
    for name in ("windrose", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    code = f"""
from pyspark.sql import SparkSession
import __spark_entry__ as e
q = e.queries()
assert q and not any(k.startswith("op") or k == "pipeline" for k in q) and e.oracle_sql()
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "kept")!r}).getOrCreate()
print("rows", *(q[k](spark, "/root/testdata/sf0.001").count() for k in ("q01_station_annual_cf", "q24_quadrants", "q09_point_in_polygon")))
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    rows = [int(n) for n in done.stdout.partition("rows ")[2].split()]
    assert len(rows) == 3 and all(rows), done.stderr[-1500:]


def test_ids_are_whole(spark, corpus):
    r = corpus_pipeline.encode(spark, spark.read.parquet(f"{corpus[0]}/documents.parquet"), corpus[0]).first()
    assert np.array(r.ids, "<u4").tobytes() and r.n_tokens == len(r.ids)


def test_workers_get_the_package(corpus, tmp_path):
    """From a folder where nothing of this repository can be imported."""
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
print("rows", __spark_entry__.queries()["op9_language_id"](spark, {corpus[0]!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 162" in done.stdout, done.stderr[-1500:]
