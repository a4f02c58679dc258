"""Token operators against the tokenizers library."""

import hashlib
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hybridsearch.llm import bpe, common, token_counts, token_files

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "\n", "a", "Hello, world. It's 1,234 things!!\nNext line", "  two  blanks ", "tab\there\r\nend", "é́ ñandú Straße ÉÇOLE", "日本語 テスト", "🙂👍🏽 ok",
    "<|endoftext|>", "a <|endoftext|> b<|startoftext|>", "<|ENDOFTEXT|>", "x" * 3000, "ab" * 900 + " -" + "-" * 400, "Dİ, sonra Dİ. İ", "क़, क़. a", "é, È. ñ÷, ×. ß.", "word's, don't'. a'... b!?", "a b c　d\x1ce\x85f", "...,,,... word., ,x", "don't we'll 'tis I'LL", "K K İ ΑΣ Σ",
    "word, word. word,word\nword, word.", "<", "null\x00byte",
]
words = st.text(alphabet=st.sampled_from(list("abthe'sléñ ,.\n\t09!日 ")), max_size=60)


def rows(spark):
    return spark.createDataFrame([(i if i else None, t, i, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, n_tokens bigint, tokens string")


def test_a_cache_of_one_call_is_not_written_again(spark, monkeypatch):
    written = []
    monkeypatch.setattr(token_counts, "materialize", lambda df, label: written.append(label) or common.materialize(df, label))
    tok, docs = Tokenizer.from_file(WORD), rows(spark)
    got = token_counts.token_counts(docs.unionByName(docs), WORD).collect()
    want = [len(tok.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    assert sorted(r.n_tokens for r in got) == sorted(want * 2) and not written
    path = common.new_path(spark, "counts-test")
    for _ in range(2):
        assert sorted(r.n_tokens for r in token_counts.token_counts(docs, WORD, cache_path=path).collect()) == sorted(want)
    assert written == ["counts", "counts"]


def test_encoder_equals_library():
    coder, tok = bpe.load(BYTE), Tokenizer.from_file(BYTE)
    texts = [t or "" for t in TEXTS]
    got = list(coder.encode_batch(texts))
    assert got == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert ["".join(coder.decode(i)) for i in got] == [tok.decode(i, skip_special_tokens=False) for i in got] == texts


def wide(*texts):
    return pa.array(texts, type=pa.large_string())


@settings(max_examples=400, deadline=None)
@given(words)
def test_encoders_on_random_text(text):
    tok, word = _library(BYTE), _library(WORD)
    want = tok.encode(text, add_special_tokens=False).ids
    assert next(bpe.load(BYTE).encode_batch([text])) == want
    assert token_files.library_encoder(BYTE).ids(wide(text))[1].tolist() == want
    assert token_counts._counter(WORD).sizes(wide(text)).tolist() == [len(word.encode(text, add_special_tokens=False).ids)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab'st  \n\n9!<|é日", "<|endoftext|>", "<|end", "'ll", "aaaaaaaa", "        "]), max_size=50).map("".join), st.integers(1, 9))
def test_a_text_in_portions_has_the_same_ids(text, portion):
    coder = bpe.load(BYTE)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(bpe, "OPEN", 4)
        got = [i for ids in coder.stream(text[lo : lo + portion] for lo in range(0, len(text), portion)) for i in ids.tolist()]
    assert got == _library(BYTE).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", ["word ", "x", " ", "\n", "日", "<", "9", "a,b.", "two  blanks\t", "<|endoftext|>"])
def test_what_is_held_does_not_grow_with_the_text(unit):
    coder = bpe.load(BYTE)
    state, most, n = bpe.TextStream(coder), 0, 200_000 // len(unit)
    text = unit * (3000 // len(unit))
    tracemalloc.start()
    for k in range(n // (3000 // len(unit))):
        for ids in state.push(text):
            assert len(ids) <= 1 << 18
        most = max(most, state.held())
        if k == 2:
            early = tracemalloc.get_traced_memory()[0]
    late = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    list(state.push("", last=True))
    assert most <= bpe.OPEN + bpe.WINDOW + coder.merges.lookahead + coder.merges.longest + 64 and late - early < 1 << 20


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=12), st.text(alphabet="abc", min_size=1, max_size=60), st.integers(1, 7))
def test_lookahead_settles_tokens(picks, text, portion):
    """Random merge lists: what the transducer emits early is what merging everything gives."""
    tokens, rules = [b"a", b"b", b"c"], []
    for i, j in picks:
        left, right = tokens[i % len(tokens)], tokens[j % len(tokens)]
        if left + right not in tokens:
            rules.append((left, right))
            tokens.append(left + right)
    merges = bpe.Merges.of(rules)
    run = bpe.Transducer(merges, window=1)
    data = text.encode()
    got = [t for lo in range(0, len(data), portion) for t in run.push(data[lo : lo + portion])] + list(run.close())
    plain = [bytes([x]) for x in data]
    for rule in rules:  # lowest rank first, leftmost first
        i = 0
        while i < len(plain) - 1:
            if (plain[i], plain[i + 1]) == rule:
                plain[i : i + 2] = [plain[i] + plain[i + 1]]
            else:
                i += 1
    assert [merges.bytes_of[t] for t in got] == plain


_known = {}


def _library(path):
    if path not in _known:
        _known[path] = Tokenizer.from_file(path)
    return _known[path]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdefgh-= ", min_size=200, max_size=900), st.integers(1, 70))
def test_transducer_does_not_depend_on_portions(text, portion):
    merges, data = bpe.load(BYTE).merges, text.replace(" ", "").encode()
    run = bpe.Transducer(merges, window=8)
    out = [t for lo in range(0, len(data), portion) for t in run.push(data[lo : lo + portion])]
    assert out + list(run.close()) == merges.merge(data)


def test_lookahead_of_a_small_list():
    # x+y then (xy)+z: what follows y within two bytes can matter to the byte before x
    assert bpe.sufficient_lookahead([(b"x", b"y")]) == 1
    assert bpe.sufficient_lookahead([(b"b", b"c"), (b"a", b"b")]) == 2


def test_decoder_replaces_bad_bytes_as_the_library_does():
    tok, coder = _library(BYTE), bpe.load(BYTE)
    ids = tok.encode("é日🙂", add_special_tokens=False).ids
    for cut in (ids[1:], ids[:-1], ids[::-1]):
        assert "".join(coder.decode(cut, step=1)) == tok.decode(cut, skip_special_tokens=False)


def test_round_trip_rows(spark):
    out = bpe.round_trip(rows(spark), BYTE).collect()
    want = sorted((len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for t in TEXTS for i in [_library(BYTE).encode(t or "", add_special_tokens=False).ids])
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == want
    tokens = bpe.encode(rows(spark), BYTE)
    assert sorted(r.text for r in bpe.decode(tokens, BYTE).collect()) == sorted(t or "" for t in TEXTS)
    assert bpe.round_trip(rows(spark).limit(0), BYTE).count() == 0


def test_token_files(spark):
    docs = rows(spark).unionByName(rows(spark).where("doc_id = 5"))
    out = token_files.token_file_digests(docs, BYTE).collect()
    assert len(out) == len(TEXTS) + 1
    out.sort(key=lambda r: r.start)
    assert [r.doc_id for r in out][0] is None and [r.doc_id for r in out][1:] == sorted(r.doc_id for r in out if r.doc_id is not None)
    at = 0
    for r in out:
        ids = _library(BYTE).encode(TEXTS[r.doc_id or 0] or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.token_file_digests(docs.limit(0), BYTE).count() == 0


def test_token_counts_use_and_extend_the_cache(spark, tmp_path):
    docs, cache = rows(spark), str(tmp_path / "cache")
    for part in (docs.where("doc_id < 6"), docs, docs):
        out = token_counts.token_counts(part, WORD, limit=5, cache_path=cache).collect()
    assert len(out) == len(TEXTS)
    by_id = {r.doc_id: r for r in out}
    for i, t in enumerate(TEXTS):
        n = len(_library(WORD).encode(t or "", add_special_tokens=False).ids)
        r = by_id[i or None]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), n, n > 5)
    kept = spark.read.parquet(cache)
    assert kept.count() == kept.select("content_digest").distinct().count()
    assert token_counts.token_counts(docs.limit(0), WORD).count() == 0


def test_counts_of_a_sentencepiece_model(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["a b", "a  b", "a\nb", "a \tb ", "", None, *TEXTS]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()} == {i: len(model.encode(t or "")) for i, t in enumerate(texts)}


def test_long_texts(spark):
    """A hundred thousand characters and more: words, one word, one run of blanks, and characters without any blank."""
    texts = ["Words of a long text, " * 10_000, "x" * 100_000, " " * 100_000 + "a", "日本語テスト、" * 12_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = [_library(BYTE).encode(t, add_special_tokens=False).ids for t in texts]
    got = {r.doc_id: r for r in bpe.round_trip(docs, BYTE).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids[i]), hashlib.sha256(",".join(map(str, ids[i])).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert [r.n_tokens for r in sorted(token_files.token_file_digests(docs, BYTE).collect())] == [len(i) + 1 for i in ids]
    want = [len(_library(WORD).encode(t, add_special_tokens=False).ids) for t in texts]
    assert [r.n_tokens for r in sorted(token_counts.token_counts(docs, WORD).collect())] == want
