"""Clustering, tokenizer alignment and min-max near-duplicates against brute force, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, compare
from hypothesis import given, settings
from hypothesis import strategies as st

from matchframe.llm import minmax_dedup, queries, simhash_dedup, simplex_clusters, token_align

DOCS = "doc_id long, text string, key string, component string, n long, h long, sig string"


def documents(spark, texts):
    """Documents with columns of clashing names."""
    return spark.createDataFrame([(k, t, "x", "y", 1, 2, "z") for k, t in texts], DOCS)


# Clusters


@pytest.mark.parametrize("name", ["op11_simplex_clusters", "op13_minmax_groups"])
def test_same_as_sql(spark, name):
    compare(spark, queries.QUERIES, queries.ORACLE_SQL, [name])


def brute_clusters(rows, k=8, rounds=10):
    """rows: [(id, list)] -> [(id, cluster, distance)], centroids."""
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in good if i is not None)
    centroids = [v for _, v in seeds[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in good:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in good), key=str), centroids


def test_clusters_of_odd_vectors(spark):
    """Wrong sizes, nulls, infinities, repeated rows and ids, a null id, equal vectors (ties), negative components."""
    draw = random.Random(3)
    vector = lambda: [draw.uniform(-2, 2) for _ in range(64)]
    same = vector()
    rows = [(k, vector()) for k in range(40)] + [(k, same) for k in range(40, 70)] + [(41, vector()), (42, same), (None, vector())]
    rows += [(90, None), (91, []), (92, vector()[:63]), (93, vector() + [1.0]), (94, [None] + same[1:]), (95, [math.nan] + same[1:]), (96, [math.inf] + same[1:]), (97, [-math.inf] + same[1:])]
    frame = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<double>, x string, cluster int")
    got = simplex_clusters.clusters(frame).collect()
    want, centroids = brute_clusters(rows)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    sums = collections.Counter()
    for _, c, d in want:
        sums[c] += d
    assert {r.cluster: r.cluster_inertia for r in got} == dict(sums) and {r.inertia for r in got} == {sum(sums.values())}
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest() for r in got)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert simplex_clusters.clusters(spark.createDataFrame([], schema)).count() == 0
    three = spark.createDataFrame([(k, [float(k)] * 64) for k in range(3)], schema)
    assert [(r.cluster_inertia, r.distance) for r in simplex_clusters.clusters(three).collect()] == [(0, 0)] * 3
    nameless = spark.createDataFrame([(None, [1.0] * 64)], schema)
    assert simplex_clusters.clusters(nameless).count() == 0


def test_too_large_components_are_an_error(spark):
    frame = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        simplex_clusters.clusters(frame)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 8), st.booleans())
def test_bounds_hold_and_filter(seed, pivots, flat):
    """Bounds of apexes enclose the distances, and the nearest centroid is that of plain comparison; also where all vectors are in a plane of few dimensions."""
    draw = np.random.default_rng(seed)
    scale = int(draw.choice([3, 1000, 1 << 20]))
    vectors, centroids, base = (draw.integers(-scale, scale, (n, 16)) for n in (50, 6, pivots))
    if flat:
        for x in (vectors, centroids, base):
            x[:, 2:] = 0
    simplex = simplex_clusters.Simplex(base)
    assert len(simplex.pivots) <= (3 if flat else pivots)
    exact = simplex_clusters.squares(vectors, centroids)
    x, y = (simplex.apexes(simplex_clusters.squares(v, simplex.pivots).astype(float)) for v in (vectors, centroids))
    mirrored = y * np.append(np.ones(y.shape[1] - 1), -1)
    room = 1e-6 * (1 + exact.max())
    assert (((x[:, None] - y[None]) ** 2).sum(axis=2) <= exact + room).all() and (((x[:, None] - mirrored[None]) ** 2).sum(axis=2) >= exact - room).all()
    number, distance, _ = simplex_clusters.nearest(vectors, x, centroids, simplex)
    assert (distance == exact.min(axis=1)).all() and (number == exact.argmin(axis=1)).all()


def test_bounds_rule_centroids_out():
    draw = np.random.default_rng(1)
    centroids = draw.integers(-1000, 1000, (8, 64))
    vectors = centroids[draw.integers(0, 8, 500)] + draw.integers(-50, 50, (500, 64))
    for pivots, most in ((centroids, 1.0), (vectors[:6], 5.0)):
        simplex = simplex_clusters.Simplex(pivots)
        apexes = simplex.apexes(simplex_clusters.squares(vectors, simplex.pivots).astype(float))
        assert simplex_clusters.nearest(vectors, apexes, centroids, simplex)[2] <= most * 500  # of 8 * 500 pairs


# Tokenizer alignment


@pytest.fixture(scope="module")
def tools():
    return token_align.aligner(token_align.tokenizer_path("byte_bpe_50k.json"), token_align.tokenizer_path("piece_bpe_32k.model"))


def brute_alignment(text, tools):
    """Whole texts through both tokenizers: (n_a, n_b, n_groups, n_links, hash), {pair: links}."""
    none = (0, 0, 0, 0, ""), {}
    if not text:
        return none
    a, b = tools.a.encode(" " + text, add_special_tokens=False).ids, tools.b.encode(text)
    raw_a = [tools.a.decode([k]).encode() if "�" not in tools.a.decode([k]) else tools.bytes_a[k].as_py() for k in a]
    pieces = [tools.b.id_to_piece(k) for k in b]
    raw_b = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]
    whole = (" " + text).encode()
    if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
        return none
    ends_a, ends_b = (np.cumsum(list(map(len, x))).tolist() for x in (raw_a, raw_b))
    groups, links, i, j = [], collections.Counter(), 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append((a[i:x], b[j:y]))
        links.update((p, q) for p in a[i:x] for q in b[j:y])
        i, j = x, y
    written = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
    return (len(a), len(b), len(groups), links.total(), hashlib.sha256(written.encode()).hexdigest()), links


def brute_rows(texts, tools):
    each = [brute_alignment(t, tools) for t in texts]
    count = collections.Counter(p for _, links in each for p in links)
    most = collections.Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [(*facts[:4], sum(k for p, k in links.items() if count[p] == most[p[0]]), sum(k * count[p] for p, k in links.items()), facts[4]) for facts, links in each]


ODD = [None, "", " ", "  ", "\n", " a  b ", "<|endoftext|> and <s>", "tab\tand\n\n  space", "çé ñ 😀 中文没有空格", "▁ is not given back", "same text", "same text", "a" * 3000, "it's 12,000.50 %"]


def test_alignment_against_whole_texts(spark, tools):
    small = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    texts = [(r.doc_id, r.text) for r in small] + [(10_000 + k, t) for k, t in enumerate(ODD)]
    docs = documents(spark, texts).repartition(5)  # several blocks
    got = {r[0]: tuple(r[1:]) for r in token_align.alignment(docs, *map(token_align.tokenizer_path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))).collect()}
    want = {k: w for (k, _), w in zip(texts, brute_rows([t for _, t in texts], tools))}
    assert got == want


def test_alignment_query_is_the_operator(spark, tools):
    small = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(small, brute_rows([r.text for r in small], tools))}
    assert {r[0]: tuple(r[1:]) for r in queries.op12_pair_bitmaps(spark, SF).collect()} == want


def test_alignment_of_repeated_and_null_ids(spark):
    docs = documents(spark, [(1, "one two"), (1, "one two"), (None, "one")])
    paths = list(map(token_align.tokenizer_path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))
    rows = token_align.alignment(docs, *paths).collect()
    assert sorted((r.doc_id, r.n_a, r.count_sum) for r in rows if r.doc_id) == [(1, 2, 5), (1, 2, 5)] and [r.count_sum for r in rows if r.doc_id is None] == [3]
    assert token_align.alignment(documents(spark, []), *paths).count() == 0
    scores = {(r.documents, r.links) for r in token_align.pair_scores(token_align.entries(docs, *paths)).collect()}
    assert scores == {(3, 3), (2, 2)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=12), st.text(" \n\t  aAbé中.0'\x1c▁<|s>", max_size=20)), min_size=1, max_size=6))
def test_pieces_are_aligned_like_whole_texts(texts):
    tools = token_align.aligner(token_align.tokenizer_path("byte_bpe_50k.json"), token_align.tokenizer_path("piece_bpe_32k.model"))
    numbers, hashes, (row, pair, n) = token_align.align(pa.array(texts, pa.string()), tools)
    base = len(tools.size_b)
    for k, text in enumerate(texts):
        facts, links = brute_alignment(text, tools)
        assert (*[int(x[k]) for x in numbers], hashes[k]) == facts
        assert {(int(p) // base, int(p) % base): int(c) for p, c in zip(pair[row == k], n[row == k])} == dict(links)


def test_groups_with_very_many_links(monkeypatch, tools):
    texts = pa.array(["aaaa bbbb aaaa", "xyzw"])
    plain = token_align.align(texts, tools)
    monkeypatch.setattr(token_align, "_LISTED", 0)
    assert all((x == y).all() for x, y in zip(plain[2], token_align.align(texts, tools)[2]))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, token_align.BLOCK_DOCS - 1), st.integers(1, 5000), min_size=1, max_size=50), st.booleans())
def test_containers_give_their_contents(held, dense):
    if dense:
        held |= {k: 1 for k in range(0, token_align.BLOCK_DOCS, 3)}
    places = np.array(sorted(held))
    links = np.array([held[k] for k in places.tolist()])
    back = token_align.contents(token_align.container(places, links))
    assert (back[0] == places).all() and (back[1] == links).all()


def test_blocks_are_closed_when_full(spark, monkeypatch, tools):
    monkeypatch.setattr(token_align, "BLOCK_ENTRIES", 5)
    docs = [f"word{k} and more" for k in range(30)]
    # what a task does, without Spark: batches of ten texts
    made = token_align.entries(documents(spark, list(enumerate(docs))).coalesce(1), *map(token_align.tokenizer_path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))
    assert made.where("place is not null").count() == 30


# Min-max hashing


def shingles(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
    return {" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} or ({" ".join(w)} if w else set())


def brute_groups(texts):
    """[(id, text)] -> {id: (smallest id reachable)}; rows of one id are one node."""
    sets = [(k, shingles(t)) for k, t in texts]
    low = {k: k for k, _ in sets}

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(a), root(b)
                low[max(p, q)] = min(p, q)
    return {k: root(k) for k, _ in sets}


def near_copies(seed, bases, copies, size=120):
    """Texts with some of their words changed, around the similarity that links; each a chain of changes."""
    draw = random.Random(seed)
    out = []
    for b in range(bases):
        words = [f"w{draw.randrange(5000)}" for _ in range(size)]
        for _ in range(copies):
            words = list(words)
            for at in draw.sample(range(len(words)), draw.randrange(0, 5)):
                words[at] = f"w{draw.randrange(5000)}"
            out.append(" ".join(words))
    draw.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("crowd", [minmax_dedup.CROWD, 2])
def test_near_copies_against_all_pairs(spark, crowd):
    """Chains of near copies around the threshold, exact copies, short texts; also with every bucket split."""
    texts = near_copies(5, 12, 12) + [(500, "One two"), (501, "one  TWO"), (502, "one two three four five"), (503, "one two three four five six"), (504, ""), (505, None), (506, " \n")]
    got = {r.doc_id: r for r in minmax_dedup.near_duplicates(documents(spark, texts), crowd=crowd).collect()}
    want = brute_groups(texts)
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(r.kept == (k == want[k]) for k, r in got.items())
    assert {k: r.n_shingles for k, r in got.items()} == {k: len(shingles(t)) for k, t in texts}


def test_shared_passage_is_no_link(spark):
    """Texts of one passage and words of their own, from a tenth to nine tenths: many components meet in the same buckets."""
    draw = random.Random(2)
    passage = [f"p{k}" for k in range(100)]
    texts = [(k, " ".join(passage + [f"u{draw.randrange(10**6)}" for _ in range(10 + 5 * (k % 25))])) for k in range(150)]
    for crowd in (minmax_dedup.CROWD, 5):
        got = {r.doc_id: r.component_id for r in minmax_dedup.near_duplicates(documents(spark, texts), crowd=crowd).collect()}
        assert got == brute_groups(texts)


def test_min_max_odd_rows(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "other words that stand here"), (3, "other words that stand here"), (None, "a b c d e"), (None, None), (4, None), (5, "word " * 30_000), (6, "word " * 20_000), (7, "x" * 100_000)]
    out = minmax_dedup.near_duplicates(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    assert sorted(((r.component_id, r.kept) for r in out if r.doc_id is None), key=str) == [(1, True), (None, True)]  # rows without an id are never dropped
    assert minmax_dedup.near_duplicates(documents(spark, [])).count() == 0


def test_signatures_estimate_similarity():
    """Equal values of minima and maxima are unbiased, and half as many permutations suffice: the deviation is no more than that of independent values."""
    draw = np.random.default_rng(4)
    off = []
    for _ in range(60):
        both, x, y = (draw.integers(0, 1 << 63, n).astype(np.uint64) for n in (400, 50, 50))
        a, b = minmax_dedup.signatures([np.concatenate([both, x]), np.concatenate([both, y])])
        off.append((a == b).mean() - 400 / 500)
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 1.2 * (0.8 * 0.2 / 256) ** 0.5


def test_signature_of_slices():
    draw = np.random.default_rng(5)
    sets = [np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64)) for n in (3, 0, 40_000, 1, 70_000, 5, 0)]
    whole = minmax_dedup.signatures(sets)
    assert all((whole[k] == minmax_dedup.signatures([s])[0]).all() for k, s in enumerate(sets)) and not whole[1].any()


def test_stages_take_columns_of_any_name(spark):
    """The near-duplicate stage of the pipeline on documents whose columns have its own names."""
    rows = [(k, f"some words of the text number {k} and more of them", "x", "y") for k in (1, 2)] + [(3, "some words of the text number 2 and more of them", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone_id string, _gone_th string")
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


def hot_sets(seed, count=60):
    """Sets that share one passage: most unlike one another, some near copies, of sizes whose parity maps differ."""
    draw = np.random.default_rng(seed)
    passage = np.sort(draw.integers(0, 1 << 63, 400).astype(np.uint64))
    sets = [np.union1d(passage, draw.integers(0, 1 << 63, int(k)).astype(np.uint64)) for k in draw.integers(80, 170, count)]
    return sets + [np.union1d(s[: -len(s) // 15], draw.integers(0, 1 << 63, 8).astype(np.uint64)) for s in sets[::4]]


def test_pairs_of_a_hot_shingle_are_ruled_out_where_they_meet():
    """All sets share one shingle. What leaves the task are the similar pairs and few others, not all pairs."""
    sets = sorted(hot_sets(3), key=len)
    maps = [simhash_dedup.parity_map(s) for s in sets]
    held, n = simhash_dedup.ParityMaps(maps), len(sets)
    i, j = (np.array(x) for x in zip(*((a, b) for a in range(n) for b in range(n))))
    assert held.differences(i, j).tolist() == [simhash_dedup.least_difference(maps[a], maps[b]) for a, b in zip(i, j)] and len(set(map(len, maps))) > 1
    alike = {(a, b) for a in range(n) for b in range(a + 1, n) if 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))}
    columns = [pa.array([7] * n), pa.array(map(len, sets), pa.int64()), pa.array(range(n)), pa.array(range(n)), pa.array(maps, pa.binary())]
    batches = [pa.RecordBatch.from_arrays([c.slice(k, 10) for c in columns], ["h", "n", "key", "label", "bits"]) for k in range(0, n, 10)]
    pairs = lambda nearest: {p for b in simhash_dedup._apart(nearest)(iter(batches)) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert len(alike) >= 15 and alike <= pairs(False) and len(pairs(False)) < n < n * (n - 1) // 20
    assert pairs(True) <= pairs(False) and {k for p in pairs(True) for k in p} == {k for p in pairs(False) for k in p}


def test_groups_of_long_texts_stay_small_in_a_task():
    """Maps of long texts have 8 KB: tables are bounded by bytes, and pairs are compared a few MB at a time."""
    draw = np.random.default_rng(5)
    bits = [draw.bytes(8192) for _ in range(600)]
    h = np.sort(draw.integers(0, 300, 5000))
    h[2000:3500] = h[2000]  # one group that is larger than a table and comes in many batches
    columns = [pa.array(h), pa.array(range(5000)), pa.array([bits[k % 600] for k in range(5000)], pa.binary())]
    for step in (1, 7, 400):
        batches = [pa.RecordBatch.from_arrays([c.slice(k, step) for c in columns], ["h", "key", "bits"]) for k in range(0, 5000, step)]
        tables = list(simhash_dedup.whole_tables(iter(batches)))
        assert pa.concat_tables(tables).column("key").to_pylist() == list(range(5000))
        for table, after in zip(tables, tables[1:]):
            assert table.column(0)[-1].as_py() != after.column(0)[0].as_py()
        assert all(t.nbytes <= 13 << 20 for t in tables if h[2000] not in t.column(0).to_pylist()) and len(tables) >= 3
    maps = [b[: 8192 >> k % 3] for k, b in enumerate(bits)]
    i, j = draw.integers(0, 600, (2, 30_000))
    held = simhash_dedup.ParityMaps(maps)
    tracemalloc.start()
    found = held.differences(i, j)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
    assert found[:300].tolist() == [simhash_dedup.least_difference(maps[a], maps[b]) for a, b in zip(i[:300], j[:300])]


def test_grid_finds_near_copies_of_the_training_set(spark):
    """The pipeline's near-duplicate stage goes through the grid of fingerprints, of sets of 5-word shingles."""
    draw = random.Random(8)
    texts = []
    for _ in range(30):
        words = [f"w{draw.randrange(3000)}" for _ in range(400)]
        texts += [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(words[:-2] + ["quite", "other"])]
    prints = simhash_dedup.prefixes(documents(spark, list(enumerate(texts))))
    fps = {r.key: r.fp for r in prints.select("key", "fp").collect()}
    assert {r.doc_id: r.fp for r in prints.collect()} == {k: int(simhash_dedup.set_prints(simhash_dedup.shingle_sets(pa.array([t])))[0]) for k, t in enumerate(texts)}
    pairs = {(r.u, r.v) for r in simhash_dedup.grid_pairs(prints.select("key", "fp")).collect()}
    near = {(a, b) for a in fps for b in fps if a < b and ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 2}
    assert len(near) >= 30

    def groups(links):
        label = {k: k for k in fps}
        for _ in fps:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert groups(pairs) == groups(near)
    assert {r.doc_id for r in simhash_dedup.keep_one(documents(spark, list(enumerate(texts)))).collect()} == set(range(0, 90, 3))


def test_sets_of_one_bucket_are_ruled_out_where_they_meet():
    """Sets of some similarity 0.7 have signatures that agree enough; their bitmaps rule them out inside the task, and no link is lost."""
    draw = np.random.default_rng(6)
    passage = draw.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.union1d(passage, draw.integers(0, 1 << 63, int(k)).astype(np.uint64)) for k in draw.integers(60, 110, 60)]
    sets = sorted(sets + [np.union1d(s[:-25], draw.integers(0, 1 << 63, 9).astype(np.uint64)) for s in sets[::4]], key=len)
    n, values = len(sets), minmax_dedup.signatures(sets)
    alike = {(a, b) for a in range(n) for b in range(a + 1, n) if 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))}
    agree = sum((values[a] == values[b]).sum() >= minmax_dedup.LEAST_EQUAL for a in range(n) for b in range(a + 1, n))
    sig = (minmax_dedup._mix(values) >> np.uint64(56)).astype(np.uint8)
    columns = [pa.array([7] * n), pa.array(map(len, sets), pa.int64()), pa.array(range(n)), pa.array(range(n)), pa.array([r.tobytes() for r in sig], pa.binary()), pa.array(map(simhash_dedup.parity_map, sets), pa.binary())]
    batches = [pa.RecordBatch.from_arrays([c.slice(k, 10) for c in columns], ["h", "n", "key", "label", "sig", "bits"]) for k in range(0, n, 10)]
    pairs = lambda nearest: {p for b in minmax_dedup._across(nearest)(iter(batches)) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert len(alike) >= 15 and alike <= pairs(False) and len(pairs(False)) < 2 * n and agree > 10 * n
    assert pairs(True) <= pairs(False) and {k for p in pairs(True) for k in p} == {k for p in pairs(False) for k in p}
