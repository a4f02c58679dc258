"""Conversation tries and spelling variants against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
import regex

from hybridsearch.llm import prefix_trie, spelling

DATA = Path("/root/testdata/sf0.001")
CONVERSATION = "conv_id bigint, turn bigint, role string, text string"


def _plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, role, digest), (role, text)))
    own = {c: [t for _, t in sorted(x, key=lambda y: y[0])] for c, x in own.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        turns = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                kids[turns[: d - 1]].add(turns[:d])
        ends[turns].append(c)
    out = {}
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        parent = min(members[node[:-1]]) if node else None
        out[min(members[node]), len(node)] = (parent, len(members[node]), len(kids[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
    return out


def _found_trie(df):
    rows = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    out = {tuple(r)[:2]: tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


def _conversations(seed, n, most, words):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for turn in range(rng.choice([0, 1, 2, 3, most])):
            rows.append((c * rng.choice([1, 1, 2]), turn, rng.choice(["user", "assistant"]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("shard", [1 << 14, 3, 1])
def test_trie_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "PACK", 2)
    rows = _conversations(1, 120, 7, ["a", "b", "ü", ""])
    rows += [(500 + i, t, "user", f"same {t}") for i in range(40) for t in range(4)]  # one conversation many times
    rows += [(7, None, None, None), (7, None, "", "x"), (7, 0, "user", None), (7, 0, "user", None), (None, 1, "user", "no id"), (9, 3, "a", "b"), (9, 3, "b", "a"), (-3, 1, "user", "below"), (2**63 - 1, 0, "user", "last")]
    df = spark.createDataFrame(rows, CONVERSATION).repartition(3)
    assert _found_trie(prefix_trie.trie(df)) == _plain_trie(rows)


@pytest.mark.parametrize("shard", [1 << 14, 2])
def test_long_conversations_are_cut_into_segments(spark, monkeypatch, shard):
    monkeypatch.setattr(prefix_trie, "LENGTH", 4)
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    rng = random.Random(2)
    shared = [rng.choice("ab") for _ in range(40)]
    rows = []
    for c in range(30):
        n = rng.choice([3, 8, 9, 12, 25, 40])
        turns = shared[:n] if c % 3 else shared[: n // 2] + [rng.choice("abc") for _ in range(n - n // 2)]
        rows += [(c * 5, t, "user", x) for t, x in enumerate(turns)]
    rows += _conversations(3, 20, 30, ["a", "b"])
    df = spark.createDataFrame(rows, CONVERSATION)
    assert _found_trie(prefix_trie.trie(df)) == _plain_trie(rows)


def test_trie_of_odd_tables(spark):
    assert prefix_trie.trie(spark.createDataFrame([], CONVERSATION)).collect() == []
    rows = [(5, 0, "user", "long " * 200_000), (6, 0, "user", "long " * 200_000), (11, 0, "user", "x")]
    clashing = spark.createDataFrame([(*r, 1, 2) for r in rows], CONVERSATION + ", k1 int, n_convs int")
    assert _found_trie(prefix_trie.trie(clashing)) == _plain_trie(rows)


def test_trie_of_given_conversations(spark):
    df = spark.read.parquet(str(DATA / "conversations.parquet"))
    assert _found_trie(prefix_trie.trie(df)) == _plain_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def _plain_variants(rows, least=5):
    n = Counter()
    for doc_id, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    by = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            by[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            near[w] |= by[w[:i], w[i + 1 :]] - {w}
            if (short := w[:i] + w[i + 1 :]) in n:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def _found_variants(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


def test_variants_equal_brute_force(spark):
    rng = random.Random(4)
    bases = ["hellooo", "hallooo", "bananas", "banana" * 3, "éclairs", "÷×ÿÿÿÿ", "aaaaaa", "aaaaaaa", "aaaaaaab", "x" * 70, "y" * 90]
    words = []
    for i in range(2500):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            at = rng.randrange(len(w))
            kind = rng.randrange(3)
            w[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice("abxyÉé")]
        words += ["".join(w)] * (5 + rng.choice([0, 1, 30, 200]))
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::400])) for i in range(400)]
    rows += [(None, "Bananas, bananas"), (3, None), (3, ""), (rows[0][0], rows[0][1]), (-9, "BANANAS-ÉCLAIRS éCLAIRS×bananas Straße ")]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id bigint, text string, word string, n int").repartition(5)
    want = _plain_variants(rows)
    assert len(want) > 200 and any(v[0] for v in want.values()) and any(v[0] and v[1] != v[0] for v in want.values())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # words that share beginnings lie in several partitions
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert _found_variants(spelling.variants(df)) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_variants_of_odd_tables(spark):
    schema = "doc_id bigint, text string"
    assert spelling.variants(spark.createDataFrame([], schema)).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "short words only")], schema)).collect() == []
    long = "z" * 300_000
    rows = [(i, f"{long} {long}q") for i in range(6)] + [(9, f"{long} " * 25)]
    assert _found_variants(spelling.variants(spark.createDataFrame(rows, schema))) == {long: (None, long, 31, 1, None), long + "q": (long, long, 6, 1, 31)}


def test_variants_of_given_documents(spark):
    df = spark.read.parquet(str(DATA / "documents.parquet"))
    assert _found_variants(spelling.variants(df)) == _plain_variants([tuple(r) for r in df.select("doc_id", "text").collect()])
