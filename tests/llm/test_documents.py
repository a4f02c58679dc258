"""Document operators against brute force, on tables with nulls, empty and long texts, ties, repeats and clashing names."""

import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hybridsearch.llm import common, decontaminate, graph, license_scan, outliers, paragraphs, quality, sharding, simhash, stretches

rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + ("." if r.random() < 0.1 else "") for _ in range(n))


ODD = [None, "", " \n ", "one", "word " * 300, "A" * 5000, "é ñ x\n日本"]


@pytest.fixture(scope="module")
def table(spark):
    texts = [*ODD, *[prose(rng.randint(5, 300), k) for k in range(120)]]
    base = prose(120, 999)
    texts += [base, base, base.replace(VOCAB[0], VOCAB[1]), base + " extra", base.replace(" ", "  ")]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), 1, "x") for i, t in enumerate(texts)]
    rows += [(None, prose(40, 5), None, None, None, None, None), (None, None, None, None, None, None, None), rows[20], rows[20]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int, component_id int, shard string").cache()
    return df, rows


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# sharding


def test_lookup_table_equals_the_plain_fill(spark):
    shards, slots = 5, 101
    digest = lambda t: int(__import__("hashlib").md5(t.encode()).hexdigest()[:8], 16)
    order = [[(digest(f"shard-{i}#offset") % slots + j * (digest(f"shard-{i}#step") % (slots - 1) + 1)) % slots for j in range(slots)] for i in range(shards)]
    owner = {}
    while len(owner) < slots:
        for i in range(shards):
            if len(owner) < slots:
                owner[next(s for s in order[i] if s not in owner)] = i
    assert {r.slot: r.shard for r in sharding.lookup_table(spark, shards, slots).collect()} == owner
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, 5, 100)


def test_place_keeps_all_rows(spark, table):
    df, rows = table
    out = sharding.place(df, 4, 53).collect()
    assert len(out) == len(rows) and all(0 <= r.shard < 4 for r in out)
    assert len({r.shard for r in out if r.doc_id == 20}) == 1
    assert sharding.place(df.limit(0), 4, 53).count() == 0


def test_a_shard_that_goes_moves_few_records_of_the_others(spark):
    names = [f"shard-{i}" for i in range(8)]
    before = {r.slot: names[r.shard] for r in sharding.lookup_table(spark, names, 503).collect()}
    rest = [n for n in names if n != "shard-3"]
    after = {r.slot: rest[r.shard] for r in sharding.lookup_table(spark, rest, 503).collect()}
    held = [s for s, n in before.items() if n != "shard-3"]
    assert sum(before[s] != after[s] for s in held) < 0.1 * len(held)
    sizes = Counter(before.values())
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_write_shards_keeps_all_rows_and_divides_a_hot_key(spark, table, tmp_path):
    df, rows = table
    hot = df.unionByName(spark.createDataFrame([(7, f"text {i}", "en", "s", 1, 1, "x") for i in range(400)], df.schema)).withColumn("slot", F.lit("mine"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as the parts are here
    sharding.write_shards(hot, str(tmp_path / "out"), 4, 53, files=4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) + 400
    shard = sharding.place(hot, 4, 53).where("doc_id = 7").first().shard
    files = list((tmp_path / "out" / f"shard={shard}").glob("*.parquet"))
    assert len(files) > 1 and {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} <= {f"shard={i}" for i in range(4)}


# quality


def test_quality_learns_and_keeps_held_out_labels_out(spark, table):
    import zlib

    df, rows = table
    good = [(1000 + i, prose(150, i), 1) for i in range(150)]
    bad = [(2000 + i, " ".join(w + "$$$" for w in prose(150, i).split()), 0) for i in range(150)]
    docs = spark.createDataFrame([(a, b) for a, b, _ in good + bad], "doc_id bigint, text string")
    labels = spark.createDataFrame([(a, q) for a, _, q in good + bad], "doc_id bigint, quality int")
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert all(out[a].predicted == q and 0 <= out[a].score <= 1 for a, _, q in good + bad)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    flipped = spark.createDataFrame([(a, q if zlib.crc32(str(a).encode()) % 5 else 1 - q) for a, _, q in good + bad], "doc_id bigint, quality int")
    assert {r.doc_id: r.score for r in quality.classify(docs, flipped).collect()} == {i: r.score for i, r in out.items()}
    odd = quality.classify(df, labels).collect()
    assert len(odd) == len(rows) and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {a for a, _, q in good + bad if out[a].predicted} and kept.columns == docs.columns
    assert quality.classify(docs.limit(0), labels).count() == 0
    clash = df.withColumn("x", F.lit(1)).withColumn("held_out", F.lit("a")).withColumn("quality", F.lit(7))
    assert quality.classify(clash, labels).count() == len(rows) and quality.keep(clash, labels).columns == clash.columns


def plain_discriminant(good, bad, folds, x):
    """Scores of ``x`` by a regularised quadratic discriminant whose weights are chosen by held-out likelihood; all by dense algebra."""

    def densities(sets, pooling, ridge, x):
        covs = [np.cov(s.T, bias=True) for s in sets]
        n = [len(s) for s in sets]
        pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
        out = []
        for s, c, k in zip(sets, covs, n, strict=True):
            c = (1 - ridge) * ((1 - pooling) * c + pooling * pooled) + ridge * np.diag(np.maximum(np.diag(pooled), 1e-6))
            z = x - s.mean(axis=0)
            out.append(np.log(k / sum(n)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z))
        return out

    def held(pooling, ridge):
        total = 0.0
        for h in range(quality.FOLDS):
            rest = [bad[folds[0] != h], good[folds[1] != h]]
            for k, own in enumerate((bad[folds[0] == h], good[folds[1] == h])):
                total += densities(rest, pooling, ridge, own)[k].sum() if len(own) else 0
        return total

    best = max(((p, r) for p in quality.POOLINGS for r in quality.RIDGES), key=lambda w: held(*w))
    low, high = densities([bad, good], *best, x)
    return best, 1 / (1 + np.exp(np.clip(low - high, -500, 500)))


def test_discriminant_equals_dense_algebra(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(quality.N_STATS, quality.N_STATS)) / 3 + np.eye(quality.N_STATS)
    good = 1000.0 + r.normal(size=(160, quality.N_STATS)) @ base
    bad = 1000.3 + r.normal(size=(90, quality.N_STATS)) @ (base * 1.4)
    other = 1000.1 + r.normal(size=(50, quality.N_STATS)) @ base
    rows = [(i, False, x.tolist()) for i, x in enumerate([*good, *bad])] + [(1000 + i, True, x.tolist()) for i, x in enumerate(other)]
    stats = spark.createDataFrame(rows, "doc_id bigint, held_out boolean, x array<double>")
    labels = spark.createDataFrame([(i, int(i < 160)) for i in range(250)] + [(3, 0), (1001, 0), (9999, 1), (5, None)], "doc_id bigint, quality int")
    fold = {r.doc_id: r.f for r in stats.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS)).alias("f")).collect()}
    folds = [np.array([fold[160 + i] for i in range(90)]), np.array([fold[i] for i in range(160)])]
    best, want = plain_discriminant(good, bad, folds, np.concatenate([good, bad, other]))
    model = quality.fit(stats, labels)
    assert (model.pooling, model.ridge) == best
    got = {x.doc_id: x.score for x in quality.scores(stats, model).collect()}
    assert np.allclose([got[i] for i, _, _ in rows], want, atol=1e-6)


# near duplicates


def plain_fingerprint(text):
    w = words_of(lower(text))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_groups(rows):
    """(fingerprint, least doc_id of the group) by row."""
    fp = [plain_fingerprint(r[1]) for r in rows]
    root = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2])
    least = {c: min((rows[i][0] for i in range(len(rows)) if root[i] == c and rows[i][0] is not None), default=None) for c in set(root)}
    return [(fp[i], least[root[i]], root[i]) for i in range(len(rows))]


def plain_representatives(rows):
    """(doc_id, fingerprint) of the rows that stay."""
    found, best = plain_groups(rows), {}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    for r, (fp, _, root) in zip(rows, found, strict=True):
        if r[0] is not None:
            best[root] = min(best.get(root, (r[0], signed(fp))), (r[0], signed(fp)))
    return Counter((d, fp % 2**64) for d, fp in best.values()) + Counter((None, plain_fingerprint(r[1])) for r in rows if r[0] is None)


def test_near_duplicates(spark, table, monkeypatch):
    df, rows = table
    monkeypatch.setattr(simhash, "SHARD", 16)  # several shards
    monkeypatch.setattr(simhash, "LEAF", 4)
    want = Counter((r[0], f"{fp:016x}", least) for r, (fp, least, _) in zip(rows, plain_groups(rows), strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()) == want
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, plain_fingerprint(r.text)) for r in kept.collect()) == plain_representatives(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.representatives(df.limit(0)).count() == 0


def test_no_unique_text_is_lost_where_ids_repeat(spark):
    a, b, c = prose(80, 1), prose(80, 2), prose(80, 3)
    for rows in ([(1, a), (5, a), (5, b), (7, b)], [(5, a), (5, b)], [(5, a), (5, a), (5, b + " x"), (5, b), (6, c), (None, a), (None, a)]):
        kept = simhash.representatives(spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id int, text string, kept_id string"))
        got = Counter((r.doc_id, plain_fingerprint(r.text)) for r in kept.collect())
        assert got == plain_representatives(rows) and {plain_fingerprint(t) for _, t in rows if t in (a, c)} <= {f for _, f in got}


@pytest.mark.parametrize("ball", [False, True])
def test_large_shards_are_divided_without_loss(spark, monkeypatch, ball):
    """Fingerprints spread over all bits, or in a ball that no boundary thins, in shards of a few dozen."""
    monkeypatch.setattr(simhash, "SHARD", 10**6)
    monkeypatch.setattr(simhash, "MOST", 40)
    monkeypatch.setattr(simhash, "LEAF", 10)
    r = np.random.default_rng(5)
    if ball:
        points = [sum(1 << int(b) for b in r.choice(64, 3, replace=False)) for _ in range(250)]
    else:
        points = [int(x) for x in r.integers(0, 2**64, 300, dtype=np.uint64)]
        points += [p ^ (1 << int(r.integers(64))) ^ (1 << int(r.integers(64))) for p in points[:150]]
    points = sorted(set(points))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(p),) for p in points], "fp bigint")
    sizes = simhash._divided(df.withColumn("shard", F.lit(0).cast("bigint")), 2).groupBy("shard", "i", "j").count().collect()
    assert max(x["count"] for x in sizes) <= 80 and len(sizes) > 5
    got = {(x.a % 2**64, x.b % 2**64) for x in simhash.links(df).collect()}
    at = {p: i for i, p in enumerate(points)}
    whole = components(len(points), [(i, j) for i in range(len(points)) for j in range(i) if (points[i] ^ points[j]).bit_count() <= 2])
    assert components(len(points), [(at[a], at[b]) for a, b in got]) == whole


def test_tree_brings_all_close_pairs_together():
    r = np.random.default_rng(3)
    points = r.integers(0, 2**64, 3000, dtype=np.uint64)
    points = np.unique(np.concatenate([points, points[:500] ^ (np.uint64(1) << r.integers(0, 64, 500, dtype=np.uint64)), points[:300] ^ np.uint64(5)]))
    tree = simhash.Tree(points[:1000], 60, 2)
    assert tree.n_shards > 16
    shards = [set(own.tolist()) for _, own in tree.shards(points)]
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 2):
            assert any(i in s and int(j) in s for s in shards)


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (None, 5)]
    rng.shuffle(path)
    out = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert out == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# substring dedup


def plain_paragraphs(rows):
    """(doc_id, first word, words) of lines, or of blocks between blank lines."""
    out = []
    for doc, text in (r[:2] for r in rows):
        lines = [lower(x).encode().split() for x in (text or "").split("\n")]
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        if not all(lines):
            blocks = [[]]
            for x in lines:
                blocks[-1].extend(x) if x else blocks.append([])
            lines = blocks
        at = 0
        for x in lines:
            if doc is not None and x:
                out.append((doc, at, tuple(x)))
            at += len(x)
    return out


def plain_repeats(rows):
    found = plain_paragraphs(rows)
    sets = [{x[2][i : i + 5] for i in range(max(1, len(x[2]) - 4))} for x in found]
    links = [(i, j) for i in range(len(found)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = components(len(found), links)
    classes = {}
    for i, c in enumerate(root):
        classes.setdefault(c, []).append(found[i][:2])
    return Counter((*m, *min(v), m != min(v)) for v in classes.values() if len({d for d, _ in v}) > 1 for m in v)


def changed(text, k):
    w = text.split()
    w[k] = f"other{k}"
    return " ".join(w)


def test_short_paragraphs_count(spark):
    """Paragraphs of 3 and of 24 words in many documents, between unlike lines; a caller may leave them out."""
    short, notice = "all rights reserved", prose(24, 5050)
    rows = [(i, f"{prose(40, 1000 + i)}\n{short if i % 2 else notice}\n{prose(40, 2000 + i)}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = paragraphs.repeats(df).collect()
    assert Counter((r.n_words, r.class_size, r.removed) for r in got) == {(3, 30, True): 29, (3, 30, False): 1, (24, 30, True): 29, (24, 30, False): 1}
    assert {r.n_words for r in paragraphs.repeats(df, min_words=10).collect()} == {24}


def test_repeats(spark, table):
    """Whole paragraphs and near copies of them, as lines and as blocks of wrapped lines."""
    df, rows = table
    passage, block = prose(70, 4242), prose(80, 4343)
    wrapped = "\n".join(" ".join(block.split()[i : i + 9]) for i in range(0, 80, 9))
    extra = [(500 + i, prose(60, 600 + i) + "\n" + (passage if i < 3 else changed(passage, 10 * i)) + "\n" + prose(60, 700 + i), "en", "s", 1, 1, "x") for i in range(6)]
    extra += [(520 + i, prose(30, 800 + i) + "\n\n" + (wrapped if i else block) + "\n \n" + prose(9, 900 + i), "en", "s", 1, 1, "x") for i in range(3)]
    rows = rows + extra
    df = spark.createDataFrame(rows, df.schema)
    want = plain_repeats(rows)
    got = Counter((r.doc_id, r.start_word, r.class_doc_id, r.class_start, r.removed) for r in paragraphs.repeats(df).collect())
    assert got == want and {r[0] for r in extra} <= {k[0] for k in got}
    clash = df.withColumn("gone_places", F.lit("mine")).withColumn("own_row", F.lit(1)).withColumn("digest", F.lit(2))
    out = paragraphs.removed(clash)
    cut = {r.doc_id: r.text for r in out.where("doc_id >= 500").collect()}
    assert cut[500] == extra[0][1] and all(len(cut[500 + i].split()) == 120 for i in range(1, 6)) and len(cut[521].split()) == 39
    assert out.columns == clash.columns and out.count() == len(rows) and paragraphs.repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("similar", [True, False])
def test_large_buckets_are_divided_without_loss(spark, monkeypatch, similar):
    monkeypatch.setattr(paragraphs, "BLOCK", 3)
    text = prose(60, 77).split()
    # paragraphs that differ in one word, and chains of them away from the first
    rows = [(i, " ".join([*text[:59], f"last{i}"])) for i in range(12)]
    if not similar:
        for i in range(12, 30):
            text[(5 * i) % 59] = f"step{i}"
            rows.append((i, " ".join(text)))
    out = paragraphs.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.start_word, r.class_doc_id, r.class_start, r.removed) for r in out) == plain_repeats(rows)


def test_recall_of_the_bands():
    """Of a thousand pairs of paragraphs at a similarity of 0.8 to 0.85, how many share a band."""
    import pyarrow as pa

    n, met, pairs = paragraphs.tune_bands(), 0, 0
    for k in range(1200):
        a = prose(90 + k % 40, 20_000 + k).split()
        b = a.copy()
        for at in (20, 50)[: 1 + (k % 2)]:
            b[at] = f"x{k}"
        grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b)]
        if 0.8 <= len(grams[0] & grams[1]) / len(grams[0] | grams[1]) <= 0.85:
            bands = paragraphs.Paragraphs(pa.array([" ".join(a), " ".join(b)])).bands(n)
            met, pairs = met + bool((bands[0] == bands[1]).any()), pairs + 1
    assert pairs > 300 and met >= 0.98 * pairs


def plain_stretches(rows, least):
    """(doc_id, word) of every word in a run of ``least`` words that an earlier document has."""
    first, want = {}, set()
    for doc, text in sorted((r[0], r[1]) for r in rows):
        w = lower(text).split()
        for i in range(len(w) - least + 1):
            if first.setdefault(tuple(w[i : i + least]), doc) != doc:
                want |= {(doc, k) for k in range(i, i + least)}
    return want


@pytest.mark.parametrize("large", [2, 2000])
def test_whole_passages_are_repeated(spark, monkeypatch, large):
    monkeypatch.setattr(stretches, "LARGE", large)
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    rows = []
    for k in range(60):
        passage = prose(51 + k % 40, 9000 + k)
        shapes = [passage, wrap(passage, 5), wrap(passage, 7) if k % 2 else passage.upper()]
        rows += [(3 * k + i, prose(30 + k, 5000 + 9 * k + i) + "\n" * (k % 2) + " " + p + " " + prose(40, 7000 + 9 * k + i)) for i, p in enumerate(shapes)]
    # a stretch that two documents share beyond what the first one has of it, and repeats within one text
    a, b, c = prose(60, 1), prose(60, 2), prose(30, 3)
    rows += [(900, a + " " + c), (901, c + " " + a + " " + b), (902, prose(9, 4) + " " + a + " " + b), (903, b + " " + b), (904, "same " * 200), (905, "same " * 120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain_stretches(rows, stretches.LEAST)
    assert {(3 * k + i, w) for k in range(60) for i in (1, 2) for w in range(30 + k, 81 + k + k % 40)} <= want
    found = stretches.stretches(df).collect()
    assert {(r.doc_id, k) for r in found for k in range(r.start_word, r.start_word + r.n_words)} == want
    text = {d: lower(t).split() for d, t in rows}
    for r in found:
        assert r.class_doc_id < r.doc_id and text[r.doc_id][r.start_word :][: r.n_words] == text[r.class_doc_id][r.class_start :][: r.n_words]
    listed = {(r.doc_id, k) for r in paragraphs.repeated(df).where("removed").collect() for k in range(r.start_word, r.start_word + r.n_words)}
    assert want <= listed
    cut = {r.doc_id: r.text for r in paragraphs.removed(df).collect()}
    assert all(lower(cut[d]).split() == [x for k, x in enumerate(lower(t).split()) if (d, k) not in listed] for d, t in rows)


@pytest.mark.parametrize("large", [2, 2000])
def test_a_text_of_one_pair_of_words_is_few_stretches(spark, monkeypatch, large):
    monkeypatch.setattr(stretches, "LARGE", large)
    lengths = {1: 201, 2: 150, 3: 300, 4: 700, 5: 201}
    rows = [(d, prose(10, d) + " " + " ".join(["in the", "the in"][d % 2].split()[k % 2] for k in range(n)) + " " + prose(10, 50 + d)) for d, n in lengths.items()]
    found = stretches.stretches(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    text = {d: lower(t).split() for d, t in rows}
    for r in found:
        assert r.class_doc_id < r.doc_id and text[r.doc_id][r.start_word :][: r.n_words] == text[r.class_doc_id][r.class_start :][: r.n_words]
    assert {(r.doc_id, k) for r in found for k in range(r.start_word, r.start_word + r.n_words)} == plain_stretches(rows, stretches.LEAST)
    # one by one, windows of either word may be out of step once the first document's have been passed
    assert len(found) <= 2 * sum(1 + n // (lengths[1] - stretches.LEAST) for d, n in lengths.items() if d > 1)
    if large > 2:
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        wanted = stretches._anchors(docs).distinct().groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"), F.array().cast("array<bigint>").alias("large"))
        assert stretches._matches(stretches._windows(docs, wanted)).count() < 30  # before: a row for every other window


def test_small_tables_are_few_files(spark, monkeypatch):
    """Each file costs its executor two children; what 24 tasks list of small texts goes to a file a core at most."""
    paths, docs = {}, spark.createDataFrame([(i, prose(80, i % 20)) for i in range(48)], "doc_id bigint, text string").repartition(24)
    monkeypatch.setattr(common, "new_path", lambda s, label, f=common.new_path: paths.update({label: (path := f(s, label))}) or path)
    found = paragraphs.repeats(docs).where("removed").count()
    files = Path(paths["paragraphs"].removeprefix("file://")).glob("part-*")
    assert found == 28 and len(list(files)) <= 4


def test_bands_reach_the_recall():
    n = paragraphs.tune_bands(0.8, 0.98, 2)
    assert 1 - (1 - 0.8**2) ** n >= 0.98 > 1 - (1 - 0.8**2) ** (n - 1)


# decontamination


def test_leaks(spark, table):
    df, rows = table
    items = [(i, prose(30 + i, 3000 + i)) for i in range(40)] + [(90, None), (91, ""), (92, "two words"), (93, prose(30, 3000))]
    planted = []
    for k in range(20):
        w = items[k][1].split()
        if k % 4 == 1:
            w[3] = "changed"
        if k % 4 == 2:
            w[::4] = ["gone"] * len(w[::4])
        planted.append((700 + k, prose(80, k) + " " + " ".join(w).upper() + " " + prose(90, k + 1), *rows[20][2:]))
    docs = spark.createDataFrame(rows + planted, df.schema)
    tok = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", lower(t).encode())
    shingle = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = Counter()
    for i, t in items:
        if tok(t):
            n = min(5, len(tok(t)))
            own = shingle(tok(t), n)
            for r in rows + planted:
                if len(own & shingle(tok(r[1]), n)) >= 0.8 * len(own):
                    want[(r[0], i)] += 1
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect())
    assert got == want and len({d for d, _ in got if d and d >= 700}) == 15
    kept = decontaminate.clean(docs, bench)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows + planted) - Counter({d: Counter(r[0] for r in rows + planted)[d] for d, _ in want})
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_leaks_with_one_word_changed_anywhere(spark):
    items = {n: [f"w{n}x{i}" for i in range(n)] for n in range(5, 31)}
    docs, want = [], set()
    for n, w in items.items():
        for k in range(n):
            doc = 100 * n + k
            docs.append((doc, prose(40, doc) + " " + " ".join([*w[:k], "changed", *w[k + 1 :]]) + " " + prose(40, doc + 7)))
            if sum(not i <= k < i + 5 for i in range(n - 4)) >= 0.8 * (n - 4):
                want.add((doc, n))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id bigint, text string")
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert (2017, 20) in want and {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, bench).collect()} == want
    assert {r.doc_id for r in decontaminate.clean(table, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def plain_leaks(items, docs, similarity=0.8):
    """(doc_id, item_id) -> share of the item's distinct shingles that the whole text has; texts here are shorter than a passage's half."""
    tok = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", lower(t).encode())
    shingle = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = {}
    for i, t in items:
        if w := tok(t):
            own = shingle(w, n := min(5, len(w)))
            for d, x in docs:
                if (s := len(own & shingle(tok(x), n)) / len(own)) >= similarity:
                    out[d, i] = s
    return out


def test_items_of_common_words_have_keys(spark, monkeypatch):
    """A benchmark whose words are all in many items: found as by brute force, and without a look at other passages."""
    few = ["".join(x) for x in zip("abcdefghijklmnopqrst", "bcdefghijklmnopqrsta", strict=True)]
    r = random.Random(12)
    items = [(i, " ".join(r.choice(few) for _ in range(r.randint(20, 40)))) for i in range(150)] + [(900, "ab bc"), (901, "ab bc")]
    docs = [(i, " ".join(r.choice(few) for _ in range(30))) for i in range(60)]
    docs += [(100 + i, " ".join(r.choice(few) for _ in range(25)) + " " + (t if i % 3 else changed(t, 7)) + " cd de") for i, (_, t) in enumerate(items[:40])]
    tables = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    looked = []
    wand = decontaminate.Index.wand
    monkeypatch.setattr(decontaminate.Index, "wand", lambda self, terms, block: looked.append(block) or wand(self, terms, block))
    index = next(decontaminate._indexes(tables[1], 0.8))
    assert sum(index.rest >= index.threshold) > 140
    import pyarrow as pa

    found = index.search(pa.array([t for _, t in docs]))
    want = plain_leaks(items, docs)
    assert {(docs[d][0], index.ids[i]) for (d, i), x in found.items() if x[1] >= 0.8} == set(want)
    assert len(looked) < 1000 < len(docs) * decontaminate.BLOCKS
    assert {(x.doc_id, x.item_id): x.overlap for x in decontaminate.leaks(*tables).collect()} == pytest.approx(want)


def test_portions_change_nothing(spark, table, monkeypatch):
    df, rows = table
    items = [(i, prose(12 + i, 3000 + i)) for i in range(40)] + [(99, None)]
    docs = [(i, prose(30, i) + " " + t + " " + prose(20, i + 1)) for i, t in items[:30]]
    tables = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(decontaminate.leaks(*tables).collect())
    monkeypatch.setattr(decontaminate, "PORTION_BYTES", 900)
    assert len(list(decontaminate._portions(tables[1]))) > 4
    parts = sorted(decontaminate.leaks(*tables).collect())
    assert [x[:2] for x in parts] == [x[:2] for x in whole] and {(x.doc_id, x.item_id) for x in whole} == set(plain_leaks(items, docs))
    assert np.allclose([list(x[2:4]) for x in parts], [list(x[2:4]) for x in whole])
    # the score, from the whole benchmark's statistics
    toks = {i: re.findall("[a-z0-9]+", t) for i, t in items if t}
    mean, n = sum(map(len, toks.values())) / len(toks), len(toks)
    df_of = Counter(w for t in toks.values() for w in set(t))
    text = {d: set(re.findall("[a-z0-9]+", t)) for d, t in docs}
    for x in whole:
        own = Counter(toks[x.item_id])
        score = sum(np.log1p((n - df_of[w] + 0.5) / (df_of[w] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks[x.item_id]) / mean)) for w, tf in own.items() if w in text[x.doc_id])
        assert abs(x.score - score) < 1e-9
    assert Counter(r.doc_id for r in decontaminate.clean(*tables).collect()) == Counter(d for d, _ in docs if d not in {x.doc_id for x in whole})


# licences


def plain_base(text):
    """All places of the base phrases."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    found = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_license_scan_equals_sql_and_finds_cut_and_reflowed_texts(spark, table):
    df, rows = table
    lines = [
        "Released under the MIT License. Under the mit LICENSE", "Licensed under the Apache License, Version 2.0", "CC-BY-NC cc by nc", "the GNU General Public License v3", "mit license", "under the mit",
        "license " * 50, "(under the mit license)", "word license under the MIT LICEN\u017fE under the mit license\u212a", "cc by nc " * 300, "...", "lİcense under the mit license",
    ]
    # each whole text as published, in lines of five words after other text, in stars and small letters, its first 70 %, and with a word put in
    shapes, want_labels = [], []
    for t in license_scan.TEMPLATES[6:]:
        w = t.text.split()
        reflowed = "\n".join(" * " + " ".join(w[i : i + 5]) for i in range(0, len(w), 5))
        for x in (t.text, prose(40, len(w)) + "\n" + reflowed, t.text.lower(), " ".join(w[: int(len(w) * 0.7)]), " ".join([*w[: len(w) * 3 // 4], "Example", *w[len(w) * 3 // 4 :]])):
            shapes.append(x)
            want_labels.append(t.label)
    mixed = [" ".join(rng.sample(license_scan.TEMPLATES[6].words, 60)) for _ in range(5)]
    rows = rows + [(900 + i, t, "en", "s", 1, 1, "x") for i, t in enumerate(lines)] + [(2000 + i, t, "en", "s", 1, 1, "x") for i, t in enumerate(shapes)] + [(3000 + i, t, "en", "s", 1, 1, "x") for i, t in enumerate(mixed)]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(r[0], r[1]) for r in rows])
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = Counter(con.sql(f"select {', '.join(names)} from ({license_scan.SCAN_SQL})").fetchall())
    out = license_scan.scan(spark.createDataFrame(rows, df.schema)).collect()
    assert Counter(tuple(r[n] for n in names) for r in out) == want
    assert Counter((r.doc_id, *(r[n] for n in names[1:6])) for r in out) == Counter((r[0], *plain_base(r[1])) for r in rows)
    by_id = {r.doc_id: r for r in out}
    assert not [(i, label) for i, label in enumerate(want_labels) if label not in by_id[2000 + i].labels.split(",")]
    assert all(by_id[2000 + i].score == 1 for i in range(0, len(shapes), 5)) and all(by_id[2000 + i].score > 0.5 for i in range(3, len(shapes), 5))
    assert all(not by_id[3000 + i].labels for i in range(5))
    assert license_scan.scan(df.limit(0)).count() == 0


# rules


def plain_statistics(text):
    w = words_of(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + d for i, g in enumerate(grams) if n[g] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_rules(spark, table):
    df, rows = table
    dirty = [(800 + i, " ".join(w + "#$%" for w in prose(120, i).split()), "en", "s1", 1, 1, "x") for i in range(5)]
    dirty += [(850, "a b\na b\n\nc\na b c a b c", "en", "s1", 1, 1, "x")]
    out = outliers.rules(spark.createDataFrame(rows + dirty, df.schema)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in out) == Counter((r[0], *plain_statistics(r[1])) for r in rows + dirty)
    by_id = {r.doc_id: r for r in out}
    assert not any(by_id[800 + i].kept for i in range(5)) and not any(r.kept and r.base_failed for r in out)
    assert sum(r.kept for r in out) > 60
    assert outliers.rules(df.limit(0)).count() == 0


def plain_mcd(groups):
    """The estimate of each group's rows by the stated steps, with whole sorts and dense algebra; ``groups`` key -> (n, 5) array."""
    o = outliers
    floored = lambda c: c + o.FLOOR * np.eye(5)
    log_det = lambda c: np.linalg.slogdet(c)[1]

    def lowest_bin(bins, share):
        values, counts = np.unique(bins, return_counts=True)
        return values[np.flatnonzero(np.cumsum(counts) >= share * counts.sum())[0]]

    def step(x, m, c):
        z = x - m
        bins = np.floor(np.log(np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z) + 1e-6) * o.NARROW)
        near = x[bins <= lowest_bin(bins, o.SUPPORT)]
        return near.mean(axis=0), floored(o.CONSISTENCY * np.cov(near.T, bias=True))

    out = {}
    for key, (x, dealt) in groups.items():
        m = np.array([(lowest_bin(np.floor(x[:, i] * o.FINE), 0.5) + 0.5) / o.FINE for i in range(5)])
        s = np.array([1.4826 * (lowest_bin(np.floor(abs(x[:, i] - m[i]) * o.FINE), 0.5) + 0.5) / o.FINE for i in range(5)])
        starts = [(m, floored(np.diag(s * s)))]
        scale = np.maximum(s, o.FLOOR**0.5)
        u = (x - m) / scale
        u = u / np.linalg.norm(u, axis=1)[:, None]
        starts.append((m, floored(5 * (u.T @ u / len(u)) * np.outer(scale, scale))))
        starts += [(x[dealt == k].mean(axis=0), floored(np.cov(x[dealt == k].T, bias=True))) for k in np.unique(dealt)]
        for _ in range(o.FIRST_STEPS):
            starts = [step(x, *e) for e in starts]
        now = min(starts, key=lambda e: log_det(e[1]))
        for _ in range(o.GUARD_STEPS):
            new = step(x, *now)
            if log_det(new[1]) >= log_det(now[1]) - o.SETTLED:
                break
            now = new
        out[key] = (len(x), *now)
    return out


def test_minimum_covariance_determinant_equals_plain_algebra(spark):
    """Distances and verdicts of two languages' sources, one of them small, a third of one source far off."""
    r = np.random.default_rng(8)
    words = lambda n, long: " ".join("abcdefghijklmnopqrstuvwxyz"[(a := int(r.integers(5))) : a + int(r.integers(2, long))] for _ in range(n))
    rows = []
    for lang, source, n, long in (("a", "s", 150, 7), ("a", "t", 90, 9), ("b", "s", 110, 6), ("b", None, 12, 8)):
        rows += [(len(rows) + i, words(int(r.lognormal(5, 0.5)) + 60, long) + ("# $" * int(r.integers(0, 4))), lang, source) for i in range(n)]
    rows += [(len(rows) + i, "\n".join([words(6, 5) + " ###$$$"] * 1 + [words(200, 20) + "#" * 300]), "a", "s") for i in range(50)]
    rows += [(9000, "short", "a", "s"), (9001, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    stats = outliers.materialize(outliers.text_statistics(docs), "statistics").withColumns(dict(zip(outliers._XS, outliers._features(), strict=True)))
    stats = stats.withColumn("dealt", F.pmod(F.xxhash64(*outliers._XS), F.lit(outliers.DEALT))).where("not base_failed").collect()
    groups = {}
    for k in stats:
        for key in ((k.lang, k.source), (k.lang,), ()):
            groups.setdefault(key, []).append(k)
    found = plain_mcd({key: (np.array([[k[x] for x in outliers._XS] for k in g]), np.array([k.dealt for k in g])) for key, g in groups.items()})

    def mixed(key, parent):
        n, m, c = found[key]
        w = n / (n + outliers.PRIOR)
        return w * m + (1 - w) * parent[0], w * c + (1 - w) * parent[1] + w * (1 - w) * np.outer(m - parent[0], m - parent[0])

    want = {}
    for k in stats:
        m, c = mixed((k.lang, k.source), mixed((k.lang,), found[()][1:]))
        z = np.array([k[x] for x in outliers._XS]) - m
        want[k.doc_id] = z @ np.linalg.inv(c) @ z
    got = {k.doc_id: k for k in outliers.rules(docs).collect()}
    assert len(got) == len(rows) and got[9000].distance is None and not got[9000].kept
    assert np.allclose([got[i].distance for i in want], list(want.values()), rtol=1e-6)
    assert all(got[i].kept == (d <= outliers.CUTOFF) for i, d in want.items())
    assert not any(got[i].kept for i in range(362, 412)) and sum(got[i].kept for i in range(362)) > 340


def test_chi_square():
    # tabulated values
    assert abs(outliers.chi_square_quantile(0.05, 5) - 11.0705) < 1e-4 and abs(outliers.chi_square_quantile(0.01, 7) - 18.4753) < 1e-4
    assert abs(outliers.chi_square_above(outliers.CUTOFF, 5) / 1e-12 - 1) < 1e-3


def test_kin_of_licences_get_no_label_of_theirs(spark):
    """The two-clause text lacks what makes the three-clause one, the zero-clause text what makes ISC."""
    from hybridsearch.llm import license_texts as L

    two = L.BSD_3[: L.BSD_3.index("3. Neither")] + L.BSD_3[L.BSD_3.index("THIS SOFTWARE IS") :]
    zero = L.ISC.replace(L.ISC[L.ISC.index("provided") if "provided" in L.ISC else 0 : L.ISC.index("THE SOFTWARE IS")], "")
    df = spark.createDataFrame([(1, L.BSD_3), (2, two), (3, L.ISC), (4, zero)], "doc_id bigint, text string")
    assert {r.doc_id: r.labels for r in license_scan.scan(df).collect()} == {1: "bsd-3", 2: "", 3: "isc", 4: ""}
