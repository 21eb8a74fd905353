"""The corpus pipeline: each stage on what its predecessor kept, and the whole against the stages."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from conftest import DATA
from llm_helpers import documents, edge_rows, prose

from lamina.llm import langid, secrets
from lamina.llm.common import read


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """sf0.001's documents and some with secrets, which it lacks."""
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    told = ["password = hunter2hunter2", "key AKIA" + "Z9" * 10, "hex " + "0a1b" * 8, "see Zx9Qw3Lk8Vb2Nm5Rt7Yp1"]
    rows = [(10_000 + i, f"{prose(i, 40)} {told[i % 4]} {prose(99 + i, 40)}", "en", "src0", 0) for i in range(12)]
    rows += [(20_000, "Привет мир это русский текст о погоде", None, "src1", 0), (20_001, "2026 - 11 - 25", None, "src1", 0)]
    read(spark, f"{DATA}/sf0.001", "documents").union(documents(spark, rows)).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The table that each stage gives, by name."""
    path = tmp_path_factory.mktemp("stages")
    docs = read(spark, sf_dir, "documents")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"file://{path}/{name}")
        docs = out[name] = spark.read.parquet(f"file://{path}/{name}")
    return out


def test_all_but_the_last_return_documents(stages):
    names = list(stages)
    assert names == ["documents", "language", "near_duplicates", "secrets", "mix", "pack"]
    for name in names[1:-1]:
        assert stages[name].dtypes == stages["documents"].dtypes


def test_language_keeps_known_languages(stages):
    said = langid.languages(stages["documents"]).collect()
    kept = {r.doc_id for r in stages["language"].collect()}
    assert kept == {r.doc_id for r in said if r.lang_pred != "und" and r.score >= langid.LEAST_SCORE}
    gone = [r for r in stages["documents"].collect() if r.doc_id not in kept]
    assert {r.doc_id for r in gone} >= {20_000, 20_001} and all(r.doc_id >= 20_000 or len(r.text) < 40 for r in gone)


def shingles(text: str) -> frozenset:
    words = text.lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def test_one_of_each_group_stays(stages):
    given = {r.doc_id: shingles(r.text) for r in stages["language"].collect()}
    kept = {r.doc_id for r in stages["near_duplicates"].collect()}
    ids = sorted(given)
    near = {i: [j for j in ids if j != i and len(given[i] & given[j]) >= 0.65 * len(given[i] | given[j])] for i in ids}
    for i in ids:
        assert i in kept or near[i]  # what goes has a near copy
        if i in kept:
            assert not any(j in kept and len(given[i] & given[j]) >= 0.85 * len(given[i] | given[j]) for j in near[i])


def test_secrets_are_gone_and_other_texts_as_they_were(stages):
    before = {r.doc_id: r for r in stages["near_duplicates"].collect()}
    after = {r.doc_id: r for r in stages["secrets"].collect()}
    assert before.keys() == after.keys()
    changed = 0
    for i, r in after.items():
        assert not secrets.scan(r.text)[1]
        if secrets.scan(before[i].text)[1]:
            changed += 1
            assert r.n_chars == len(r.text) and r.text != before[i].text
        else:
            assert r == before[i]
    assert changed == 12


def test_mix_repeats_documents_up_to_twice(stages):
    given = {r.doc_id: r for r in stages["secrets"].collect()}
    times = Counter(r.doc_id for r in stages["mix"].collect())
    assert set(times) <= set(given) and max(times.values()) <= 2
    assert all(r == given[r.doc_id] for r in stages["mix"].collect())
    words = {i: len(r.text.encode().split()) for i, r in given.items()}
    by_source, mixed = Counter(), Counter()
    for i, r in given.items():
        by_source[r.source] += words[i]
        mixed[r.source] += words[i] * times[i]
    longest = max(words.values())
    assert abs(sum(mixed.values()) - 1.5 * sum(by_source.values())) <= longest * len(by_source)


def test_pack_holds_every_token(stages):
    want, got = Counter(), Counter()
    for r in stages["mix"].collect():
        want[r.doc_id] += len(r.text.encode().split()) + 1
    for r in stages["pack"].collect():
        got[r.doc_id] += r.length
    assert got == want


def test_run_is_the_stages_in_turn(spark, stages, sf_dir):
    """Batches depend on reruns only in which of two equal rows comes first."""
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(corpus_pipeline.run(spark, sf_dir)) == order(stages["pack"])


def test_stages_take_odd_rows(spark, tmp_path):
    train = [(100 + i, prose(i, 50), "en", "a", 0) for i in range(8)]
    documents(spark, edge_rows() + train).write.parquet(f"file://{tmp_path}/documents.parquet")
    for rows in (edge_rows(), []):
        docs = documents(spark, rows, clash=True)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, f"file://{tmp_path}")
            if name != "pack":
                assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert bool(docs.count()) == bool(rows)
