"""Pipeline stages against brute force, and the SQL of the queries."""

import hashlib
import os

import duckdb
import pytest
from tests.llm.test_dedup import _components
from tests.llm.test_text_models import _alnum

import corpus_pipeline
from corpusloom.llm import common, near_dedup, quality, registry


@pytest.fixture(scope="session")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(common.stage(f(spark, out[-1], sf), "test"))
    return [{r["doc_id"]: r for r in d.collect()} for d in out], out


def test_order_and_columns(stages):
    rows, frames = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    assert all(f.columns == frames[0].columns for f in frames[1:-1])
    for a, b in zip(rows, rows[1:], strict=False):
        assert set(b) <= set(a) and len(b) > 0.5 * len(a)


def test_quality_stage_keeps_what_the_classifier_accepts(spark, sf, stages):
    scores = {r["doc_id"]: r["score"] for r in quality.op6_quality(spark, sf).collect()}
    assert set(stages[0][1]) == {i for i, s in scores.items() if s >= quality.THRESHOLD}


def test_exact_stage(stages):
    before, after = stages[0][1], stages[0][2]
    first = {}
    for i in sorted(before):
        first.setdefault(" ".join(before[i]["text"].split()), i)
    assert set(after) == set(first.values())


def test_near_stage(stages):
    before, after = stages[0][2], stages[0][3]
    c = _components([(i, r["text"]) for i, r in before.items()], 5, 80)
    assert set(after) == {i for i in before if c[i][1] == i}


def test_decontamination_stage(spark, sf, stages):
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = _alnum(r["text"])
        m = min(13, len(w))
        windows |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1) if m}
    lengths = {len(w) for w in windows}
    keep = set()
    for i, r in stages[0][3].items():
        w, hit = _alnum(r["text"]), set()
        for m in lengths:
            for q in range(len(w) - m + 1):
                if tuple(w[q : q + m]) in windows:
                    hit |= set(range(q, q + m))
        if not (hit and 20 * len(hit) >= len(w)):
            keep.add(i)
    assert set(stages[0][4]) == keep


def test_tokens_stage(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(stages[0][5]) == set(stages[0][4])
    for r in stages[0][5].values():
        assert r["token_ids"] == t.encode(r["text"], add_special_tokens=False).ids
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(r["token_ids"], skip_special_tokens=False).encode()).hexdigest()


def _rows(frame):
    return sorted(repr([r[c] for c in sorted(frame.columns)]) for r in frame.collect())


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    got = registry.QUERIES[name](spark, sf)
    rel = con.sql(registry.ORACLE_SQL[name])
    cols = rel.columns
    want = sorted(repr([r[cols.index(c)] for c in sorted(cols)]) for r in rel.fetchall())
    assert sorted(cols) == sorted(got.columns) and _rows(got) == want


def test_stage_folder_is_the_cluster_s(spark):
    assert common.stage_path(spark, "x").startswith(common.shared_dir(spark))
    assert near_dedup.ROWS * near_dedup.BANDS >= 128
