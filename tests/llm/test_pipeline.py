"""The pipeline on documents with planted junk, copies, a shared passage and a benchmark item."""

import random

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline

rng = random.Random(9)
VOCAB = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(900)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def test_stages(spark, tmp_path):
    item, passage = prose(30, 1), prose(70, 2)
    docs = {i: prose(120 + i, 100 + i) for i in range(120)}
    junk = {1000 + i: " ".join(w + "$$$" for w in prose(100, 900 + i).split()) for i in range(60)}
    copies = {2000 + i: docs[i] for i in range(5)} | {2100: docs[7].replace(" ", "  "), 2101: docs[8] + "\n"}
    leaks = {3000 + i: prose(80, 700 + i) + " " + item + " " + prose(60, 800 + i) for i in range(3)}
    shared = {4000 + i: prose(90, 500 + i) + " " + passage + " " + prose(50, 600 + i) for i in range(4)}
    rows = [(i, t, "en", "s", len(t)) for part in (docs, junk, copies, leaks, shared) for i, t in part.items()] + [(5000, None, None, None, None), (None, prose(100, 77), "en", None, 9)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in list(docs)[:100]] + [(i, 0, 0) for i in list(junk)[:50]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    table, texts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "substring dedup", "decontamination", "byte-pair encoding"]
    columns = table.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        table = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < 4:
            assert table.columns == columns
            texts.append({r.doc_id: r.text for r in table.collect()})
    good, single, cut, clean = texts
    assert not set(junk) & set(good) and set(docs) | set(leaks) | set(shared) <= set(good)
    assert not set(copies) & set(single) and set(docs) | set(shared) <= set(single)
    assert set(cut) == set(single) and all(cut[i] == docs[i] for i in docs)
    assert cut[4000] == shared[4000] and all(0 < len(cut[i].split()) < len(shared[i].split()) - 15 for i in (4001, 4002, 4003))
    assert not set(leaks) & set(clean) and set(docs) | set(shared) <= set(clean)
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.n_tokens for r in table.collect()} == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in clean.items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == table.count()


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Clashing names, repeated ids with other texts, repeated rows, nulls, a very long text, and empty tables."""
    a, b, long = prose(90, 1), prose(90, 2), prose(30_000, 3)
    rows = [(1, a), (5, a), (5, b), (7, b), (8, long), (9, None), (9, None), (10, ""), (None, a), (None, None), (11, prose(80, 4)), (11, prose(80, 4))]
    names = "doc_id bigint, text string, n_chars int, score string, fp int, digest string, kept_id int, gone_places string, own_row int, label int, item_id int, x string"
    table = spark.createDataFrame([(i, t, len(t or ""), "s", 1, "d", 2, "g", 3, 4, 5, "x") for i, t in rows], names)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs, empty in ((table, False), (table.limit(0), True)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(str(tmp_path / f"odd{empty}{k}"))
            assert k == 4 or out.columns == docs.columns
            docs = spark.read.parquet(str(tmp_path / f"odd{empty}{k}"))
            if k == 1 and not empty:
                kept = sorted((r.doc_id, r.text) for r in docs.where("doc_id is not null").collect())
                # a, b, the long text, the empty texts as one group, and 11 once
                assert kept == sorted([(1, a), (5, b), (8, long), (9, None), (11, prose(80, 4))], key=lambda r: r[0])
        assert docs.count() == (0 if empty else 7)
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    n = {r.doc_id: r.n_tokens for r in spark.read.parquet(str(tmp_path / "oddFalse4")).where("doc_id is not null").collect()}
    assert n == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in ((1, a), (5, b), (8, long), (9, ""), (11, prose(80, 4)))}
