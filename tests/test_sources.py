"""Readers, writers, the index on disk, streaming, and what the package is made of."""

import hashlib
import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hybridsearch.operators import corpus, dictionary, index
from hybridsearch.plans import retrieve as plans
from hybridsearch.sources import files
from hybridsearch.streaming.recommend import recommend_stream

REPO = Path(__file__).parents[1]
TEXT = "Cement of this kind is ground from clinker and gypsum. It is tested for strength after seven days."


def test_read_chunks_in_both_shapes(spark, tmp_path):
    rows = [{"standard_id": "IS 1", "title": "t", "content": "c", "text": "x", "page_number": 3}, {"standard_number": "IS 2", "text": "y", "source": "s", "title": None}, {}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"chunks": rows, "n": 3}))
    for name in ("a", "b"):
        out = files.read_chunks(spark, str(tmp_path / f"{name}.json")).orderBy("seq").collect()
        assert [(r.standard_id, r.title, r.text, r.page_number, r.source) for r in out] == [("IS 1", "t", "c", 3, "unknown"), ("IS 2", "", "y", None, "s"), ("", "", "", None, "unknown")]


def test_read_queries_and_results(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": "P", "query": "a", "expected_standards": ["x"]}, {"query": "b"}, {}]))
    out = files.read_queries(spark, str(tmp_path / "q.json")).orderBy("seq").collect()
    assert [(r.query_id, r.query, r.expected_standards) for r in out] == [("P", "a", ["x"]), ("Q-001", "b", []), ("Q-002", "", [])]
    results = spark.createDataFrame([(1, "b", "q", ["x"], [], 0.5), (0, "a", "q", [], ["y", "z"], None)], "seq int, id string, query string, expected_standards array<string>, retrieved_standards array<string>, latency_seconds double")
    files.write_results(results, str(tmp_path / "r"))
    assert [(r.id, r.retrieved_standards) for r in files.read_results(spark, str(tmp_path / "r")).orderBy("id").collect()] == [("a", ["y", "z"]), ("b", [])]


def test_dictionary(spark):
    sections = spark.createDataFrame(
        [(0, "cement_types", '{"OPC": "first", "n": 3, "yes": true, "l": ["x"], "o": {"a": 1}, "b": "B2", "B": "B1", "br": "[a] {b}"}'), (1, "common_abbreviations", '{"Full_Form": ["FF", "opc", 5, null], "bad": "text"}'), (2, "spelling_variants", '{"right": ["Wrng"]}'), (3, "_meta", '{"a": "b"}'), (4, "other", '{"a": "b"}')],
        "seq int, section string, body string",
    )
    got = {(r.kind, r.key): r.value for r in dictionary.read_dictionary(sections).collect()}
    assert got[("expansion", "opc")] == "Full Form" and got[("expansion", "ff")] == "Full Form" and got[("spelling", "wrng")] == "right"
    assert set(got) == {("expansion", k) for k in ("opc", "ff", "b", "br")} | {("spelling", "wrng")} and got[("expansion", "b")] == "B1" and got[("expansion", "br")] == "[a] {b}"
    assert ("expansion", "l") not in got and ("expansion", "a") not in got and ("expansion", "bad") not in got


def _raw(spark):
    rows = [(i, f"IS {i}: 2000", f"Title {i}", TEXT + f" Word{i} stands here and nowhere else.", i, "", "s") for i in range(8)]
    return spark.createDataFrame(rows, "seq bigint, standard_id string, title string, text string, page_number int, category string, source string")


def test_index_on_disk_and_stream(spark, tmp_path):
    parents, children = corpus.prepare_corpus(_raw(spark))
    files.write_chunks(parents, children, str(tmp_path / "chunks"))
    parents, children = files.load_chunks(spark, str(tmp_path / "chunks"))
    files.save_index(plans.build_index(parents, children), str(tmp_path / "index"))
    store = files.load_index(spark, str(tmp_path / "index"))
    queries = spark.createDataFrame([("a", "cement word3"), ("b", "hello!"), ("c", "cement word5 stands")], "query_id string, query string")
    encode = lambda batch: index.encode_text(batch.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("text"))).withColumnRenamed("chunk_id", "query_id")
    want = {r.query_id: (r.retrieved_standards, r.message) for r in plans.batch_retrieve(queries, store, encode(queries)).collect()}
    assert want["a"][0][0] == "IS 3: 2000" and want["c"][0][0] == "IS 5: 2000" and want["b"][0] == [] and want["b"][1]
    queries.repartition(2).write.json(str(tmp_path / "in"))
    recommend_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks"), store, encode).awaitTermination()
    got = {r.query_id: (r.retrieved_standards, r.message) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want
    answers = plans.recommend(queries, store, encode(queries), rerank=True).collect()
    assert {r.query_id for r in answers} == {"a", "b", "c"} and all(r.rationale for r in answers if r.query_id != "b")


def test_parents_are_indexed_without_children(spark):
    parents = corpus.dedup_keep_longest(corpus.normalize_records(_raw(spark)))
    none = corpus.create_child_chunks(parents.limit(0))
    assert corpus.select_index_chunks(parents, none).count() == 8


def test_nothing_else_imports_the_training_data_operators():
    own = [p for p in (REPO / "hybridsearch").rglob("*.py") if "llm" not in p.relative_to(REPO).parts]
    assert not [p for p in own if "llm" in p.read_text()]


def _environment() -> dict[str, str]:
    """This process's environment; where Python's packages come by ``PYTHONPATH`` a child needs it too, but not this repository."""
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != REPO.resolve()]
    return os.environ | {"PYTHONPATH": os.pathsep.join(paths)}


@pytest.mark.parametrize("gone", [["hybridsearch/llm", "tests/llm"], ["hybridsearch/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_point_works_without_them(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=lambda d, names: [n for n in names if n.startswith(".") or str((Path(d) / n).relative_to(REPO)) in gone])
    assert not (copy / "hybridsearch" / "llm").exists() and (copy / "hybridsearch" / "plans").exists()
    code = "import __spark_entry__ as e, bench\nassert 'retrieve' in e.queries() and 'pipeline' not in e.queries() and set(e.oracle_sql()) == set(e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, env=_environment())
    pytest_of_copy = [sys.executable, "-B", "-m", "pytest", "-q", "-p", "no:cacheprovider"]
    for more in (["tests", "--collect-only"], ["tests/test_functions.py", "-k", "normalize or dictionary or evaluation"]):
        run = subprocess.run([*pytest_of_copy, *more], cwd=copy, env=_environment(), capture_output=True, text=True)
        assert run.returncode == 0, run.stdout


def test_entry_point_does_not_hide_other_missing_modules(tmp_path):
    for name in ("hybridsearch", "__spark_entry__.py"):
        (shutil.copytree if (REPO / name).is_dir() else shutil.copy)(REPO / name, tmp_path / name)
    (tmp_path / "hybridsearch" / "llm").mkdir(exist_ok=True)
    (tmp_path / "hybridsearch" / "llm" / "queries.py").write_text("import no_such_module\n")
    run = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path, env=_environment(), capture_output=True, text=True)
    assert run.returncode and "no_such_module" in run.stderr


def test_json_files_of_chunks_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    from hybridsearch.plans import queries

    monkeypatch.setattr(queries, "FILE_BYTES", 200_000, raising=False)
    rows = [(i, f"text {i} " * 10, "en", "s") for i in range(3000)] + [(7, "hot " * 200, "en", "s")] * 2000 + [(8, None, "en", "s"), (9, "long " * 100_000, "en", "s")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    paths, read = [], queries.files.read_chunks
    monkeypatch.setattr(queries.files, "read_chunks", lambda spark, path: paths.append(path) or read(spark, path))
    out = queries.read_chunks(spark, str(tmp_path)).collect()
    assert sorted(r.text_md5 for r in out) == sorted(hashlib.md5((t or "").encode()).hexdigest() for _, t, _, _ in rows)
    sizes = [len(r.value) for r in spark.read.text(paths[0], wholetext=True).collect()]
    assert len(sizes) > 16 and sorted(sizes)[-2] < 300_000  # but for the file of the one long text


def test_stored_index_follows_its_tables(spark, tmp_path):
    """After ``documents`` is overwritten, no result comes from the index of the rows that it had."""
    from hybridsearch.plans import queries

    for name in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    store = queries.search_index(spark, str(tmp_path))
    n, same = store.chunks.count(), len(queries._STORES)
    assert n > 0 and queries.search_index(spark, str(tmp_path)).chunks.count() == n and len(queries._STORES) == same
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert queries.search_index(spark, str(tmp_path)).chunks.count() == 0
