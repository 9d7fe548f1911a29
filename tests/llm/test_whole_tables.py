"""The queries over the whole smallest tables, and the pipeline stage by stage, against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from check_oracles import compare, database
from sensorlab.llm import lines, secret_scan
from sensorlab.llm.queries import ORACLES, QUERIES
from tests.llm.test_documents import (
    brute_components,
    check_packing,
    library_ids,
    plain_counts,
    plain_spans,
    words,
)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    return [(r["doc_id"], r["text"], r["source"]) for r in rows]


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    queries = driver.queries()
    names = {name.split("_")[0]: name for name in queries if name.startswith("op")}
    return lambda op: queries[names[op]](spark, sf_dir).collect()


def test_all_are_registered():
    queries = driver.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in queries) == 1
    assert "pipeline" in queries and set(driver.oracle_sql()) <= set(queries)


def test_sql_gives_the_same_rows(spark, sf_dir):
    connection = database(sf_dir)
    assert ORACLES
    for name, sql in ORACLES.items():
        same, note = compare(spark, connection, QUERIES[name], sql, sf_dir)
        assert same, f"{name}: {note}"


def test_mixing(run, documents):
    found = {r["doc_id"]: r for r in run("op1")}
    assert len(found) == len(documents)
    check_mix(documents, {i: (r["taken"], r["target"], r["source_size"]) for i, r in found.items()})


def check_mix(documents, found):
    sizes = Counter()
    for _, text, source in documents:
        sizes[source] += len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = [(3.0, 1.0, 2.0)[i % 3] for i in range(len(order))]
    total = 1.5 * sum(sizes.values())
    # one level for all: a source gives its weight times the level, and at most twice its size
    low, high = 0.0, 4.0 * sum(sizes.values()) + 1
    for _ in range(200):
        level = (low + high) / 2
        given = sum(min(level * w, 2 * sizes[s]) for s, w in zip(order, weights))
        low, high = (level, high) if given < total else (low, level)
    targets = {s: min(high * w, 2.0 * sizes[s]) for s, w in zip(order, weights)}
    taken = Counter()
    for i, text, source in documents:
        own, target, size = found[i]
        taken[source] += own
        assert own <= 2 * len(words(text))
        assert target is None or np.isclose(target, targets[source]) and size == sizes[source]
    for source in order:
        assert targets[source] <= 2 * sizes[source] + 1e-9
        assert abs(taken[source] - targets[source]) <= 1


def test_packing(run, documents):
    count = check_packing(run("op2"), [(i, t) for i, t, _ in documents], 4096)
    ids = sum(map(len, library_ids("word_bpe_49k.json", [(i, t) for i, t, _ in documents], 1)))
    assert count <= 1.02 * ids / 4096 + 1


def test_line_rules(run, documents):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = {r["doc_id"]: r for r in run("op3")}
    for i, text, _ in documents:
        row = found[i]
        assert tuple(row[n] for n in names) == plain_counts(text)
        assert row["base_failed"] == (
            row["n_words"] < 20 or 100 * row["n_repeat_words"] > 30 * row["n_words"]
        )


@pytest.mark.parametrize("op, divisor, rest", [("op4", 3, 1), ("op5", 5, 0)])
def test_classifiers(run, documents, op, divisor, rest):
    found = {r["doc_id"]: r for r in run(op)}
    assert set(found) == {i for i, _, _ in documents}
    for i, row in found.items():
        assert row["held_out"] == (zlib.crc32(str(i).encode()) % divisor == rest)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.5)


def test_components(run, documents):
    found = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in run("op7")]
    assert sorted(found) == sorted(brute_components([(i, t) for i, t, _ in documents]))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in run("op7"))


def test_token_files(run, documents):
    ids = library_ids("byte_bpe_50k.json", [(i, t) for i, t, _ in documents], 0)
    starts = np.cumsum([0, *map(len, ids)])
    wanted = [
        (i, int(s), len(x), zlib.crc32(x.tobytes())) for (i, _, _), s, x in zip(documents, starts, ids)
    ]
    assert sorted(map(tuple, run("op9"))) == wanted


def test_secrets(run, documents):
    found = {r["doc_id"]: r for r in run("op10")}
    for i, text, _ in documents:
        spans = plain_spans(text)
        kinds = Counter(k for _, _, k in spans)
        assert [found[i][f"n_{k}"] for k in secret_scan.BASE] == [kinds[k] for k in secret_scan.BASE]
        text_ = secret_scan.digest(spans)
        assert found[i]["base_sha256"] == hashlib.sha256(text_.encode()).hexdigest()
        assert set(text_.split(",")) <= set(found[i]["spans"].split(","))


def test_pipeline_equals_brute_force(spark, sf_dir, documents, tmp_path):
    """Every stage on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = {i: (text, source) for i, text, source in documents}
    for name, stage in corpus_pipeline.STAGES:
        before = [(i, text, source) for i, (text, source) in held.items()]
        path = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        if name == "best_fit_packing":
            check_packing(rows, [(i, t) for i, t, _ in before], 4096)
            break
        found = {r["doc_id"]: (r["text"], r["source"]) for r in rows}
        assert len(found) == len(rows)
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "quality_rules":
            judged = lines.clean_texts([t or "" for _, t, _ in before])
            wanted = {i: (j[-1], s) for (i, _, s), j in zip(before, judged) if j[-2]}
        elif name == "near_dedup":
            roots = brute_components([(i, t) for i, t, _ in before], 80)
            wanted = {i: held[i] for i, _, root in roots if i == root}
        elif name == "secret_scans":
            mark = corpus_pipeline.SECRET_MARK
            wanted = {
                i: (secret_scan.redact(t, secret_scan.find_spans(t.encode()), mark), s)
                for i, t, s in before
            }
            assert not any(plain_spans(t) for t, _ in wanted.values())
        else:
            taken = {i: (len(words(found.get(i, ("",))[0])), None, None) for i in held}
            check_mix(before, taken)
            wanted = found
        assert found == wanted
        held = found
