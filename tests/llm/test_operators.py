"""Corpus operators against brute force on small inputs, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import SF, compare
from hypothesis import given, settings
from hypothesis import strategies as st

from matchframe.llm import common, decontam, html_extract, lm_lattice, packing, pii_info, quality_nbsvm, quality_rules, queries, sharding, simhash_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, th string, fp string, row string, score double"


def documents(spark, texts):
    """Documents with columns of clashing names."""
    rows = [(k, t, "en", "s", len(t or ""), "x", "y", "z", 0.5) for k, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, white space only, one very long text, repeated rows, a null id."""
    return documents(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "word " * 30_000 + "x" * 5000), (5, "same text here"), (5, "same text here"), (None, "no id at all, mail a@b.cc"), (7, "+1 (499) 555-6503"), (8, "çé ñ 😀 a@b.co")])


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# SimHash


def fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """fps: [(id, fp)] -> id -> smallest id reachable over links of two bits or fewer."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                parent[root(i)] = root(j)
    low = {}
    for i, (k, _) in enumerate(fps):
        low[root(i)] = min(low.get(root(i), k), k)
    return {k: low[root(i)] for i, (k, _) in enumerate(fps)}


def test_simhash_against_all_pairs(spark, small):
    texts = {r.doc_id: r.text for r in small.select("doc_id", "text").collect()}
    fps = [(k, fingerprint(t)) for k, t in texts.items()]
    want = brute_components(fps)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.op4_simhash_groups(spark, SF).collect()}
    assert got == {k: (f, want[k]) for k, f in fps}


@pytest.mark.parametrize("limit", [2000, 3])
def test_simhash_links_of_dense_groups(spark, limit):
    """Chains and balls of fingerprints, also with every crowded cell refined."""
    draw = random.Random(7)
    centres = [draw.getrandbits(64) for _ in range(6)]
    fps = [(c ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64))) for c in centres for _ in range(60)]
    for c in centres[:2]:
        for k in range(0, 40, 2):
            c ^= 3 << k
            fps.append(c)
    fps = sorted(set(fps) | {draw.getrandbits(64) for _ in range(200)})
    rows = [(f - (1 << 64) * (f >> 63), k) for k, f in enumerate(fps)]
    links = simhash_dedup.links(spark.createDataFrame(rows, "fp long, rep long"), cell_limit=limit)
    found = {r.u: r.component for r in simhash_dedup.components(links).collect()}
    assert {k: found.get(k, k) for k in range(len(fps))} == brute_components([(k, f) for k, f in enumerate(fps)])


def test_near_copies_of_the_training_set(spark):
    """Planted copies at 5-word Jaccard 0.8 to 0.97 go, those below stay, against all pairs."""
    rng = random.Random(5)
    texts, shared = [], "these nine words stand at the head of all texts".split()
    for k in range(40):
        base = shared + [f"w{rng.randrange(400)}" for _ in range(300)]
        texts.append(base)
        for changes in (1, 3, 5, 6, 7, 9, 14)[: k % 8]:
            copy = list(base)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts.append(copy)
    texts += [list(texts[0]), ["few", "words"], ["few", "words"], []]
    docs = documents(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} or {tuple(t)} for t in texts]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    levels = []
    for a in range(len(sets)):
        for b in range(a):
            alike = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            levels.append(alike)
            if alike >= 0.8 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert any(0.8 <= x < 0.85 for x in levels) and any(0.9 < x < 0.98 for x in levels) and any(0.6 < x < 0.8 for x in levels)
    assert {r.doc_id for r in simhash_dedup.keep_one(docs).collect()} == {root(k) for k in range(len(sets))}


def test_simhash_odd_rows(spark, odd):
    got = simhash_dedup.near_duplicates(odd).collect()
    assert len(got) == 9 and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert simhash_dedup.keep_one(odd).columns == odd.columns
    assert sorted(str(r.doc_id) for r in simhash_dedup.keep_one(odd).collect()) == ["1", "4", "5", "5", "7", "8", "None"]
    assert simhash_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_rows_of_one_id(spark):
    """A text under an id whose other text is a copy stays; for the fingerprints rows of one id are one node."""
    a, b = "one two three four five six seven eight", "quite another text that has nothing to do with it"
    docs = documents(spark, [(3, a), (5, a), (5, b), (9, b), (None, a)])
    assert sorted((r.doc_id or 0, r.text) for r in simhash_dedup.keep_one(docs).collect()) == [(0, a), (3, a), (5, b)]
    assert {r.component_id for r in simhash_dedup.near_duplicates(docs).collect()} == {3}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB \t\x0b\x1cé\u00a0"), max_size=40) | st.none(), min_size=1, max_size=6), st.integers(1, 5))
def test_shingle_sets(texts, width):
    got = [len(s) for s in simhash_dedup.shingle_sets(pa.array(texts, pa.string()), width)]
    low = [words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()) for w in low]
    assert got == [len(s) for s in sets]
    hashes = simhash_dedup.shingle_sets(pa.array(texts, pa.string()), width)
    for a, x in zip(sets, hashes):
        for b, y in zip(sets, hashes):
            assert len(a & b) == len(np.intersect1d(x, y))
            assert simhash_dedup.least_difference(simhash_dedup.parity_map(x), simhash_dedup.parity_map(y)) <= len(a ^ b)


def test_parity_maps_of_different_sizes():
    draw = np.random.default_rng(1)
    for n in (200, 300, 600, 3000):
        x = np.unique(draw.integers(0, 1 << 63, n, np.uint64))
        for m in (n // 5, n // 9, n):
            y = np.union1d(x[m:], draw.integers(0, 1 << 63, n // 3, np.uint64))
            bound, true = simhash_dedup.least_difference(simhash_dedup.parity_map(x), simhash_dedup.parity_map(y)), len(np.setxor1d(x, y))
            assert true / 5 < bound <= true


# Packing


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        room = min((b for b in bins if b[0] >= n), default=None, key=lambda b: b[0])
        if room is None:
            bins.append([capacity - n])
        else:
            room[0] -= n
    return sorted(b[0] for b in bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=120))
def test_plan_is_that_of_best_fit_decreasing(lengths):
    plan = packing.best_fit_decreasing(collections.Counter(lengths), 32)
    used, seen = collections.defaultdict(list), collections.Counter()
    for i, (n, rank, first, fit, offset) in enumerate(plan):
        end = plan[i + 1][1] if i + 1 < len(plan) and plan[i + 1][0] == n else collections.Counter(lengths)[n]
        assert rank == seen[n]
        for k in range(end - rank):
            used[first + k // fit].append((offset + k % fit * n, n))
        seen[n] = end
    assert seen == collections.Counter(lengths)
    for spans in used.values():
        spans.sort()
        assert [s for s, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
    assert sorted(32 - sum(n for _, n in s) for s in used.values()) == plain_best_fit(lengths, 32)


def test_packing_covers_every_id(spark, small, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for docs in (small.select("doc_id", "text"), odd):
        rows = packing.pack(packing.token_pieces(docs, path)).collect()
        want = collections.Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            for k in range(0, len(ids), 2048):
                want[r.doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())] += 1
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        by = collections.defaultdict(list)
        for r in rows:
            by[r.sequence_id].append((r.offset, r.length))
        for spans in by.values():
            spans.sort()
            assert all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0 and sum(spans[-1]) <= 2048
        assert sorted(2048 - sum(s[-1]) for s in by.values()) == plain_best_fit([n for s in by.values() for _, n in s], 2048)
    assert packing.pack(packing.token_pieces(odd.limit(0), path)).count() == 0


@pytest.mark.parametrize("text", ["don't. It's, we'll... ok?! İstanbul ΣΑΣ. ΣΑΣ, a.b,c. 3.14, 12. é, ½. ²,", "　a b\x85c", "\x1cfoo\x1dbar", "<|endoftext|> hi.", "’s ‘t don’t.", "ﬁ, ß. ẞ.", "Éa, ÑAÑ! it's's a'll?' x^y z̸, e\u0301a.", "a<|startoftext|>b", ""])
def test_words_are_encoded_like_whole_texts(text):
    import public_tokenizers

    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(2):  # the second time from the store
        ids, ends = encoder.encode(pa.array([text, None, text]))
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [want, [], want]


# Sharding


def test_shards_are_even_and_gapless(spark, odd):
    docs = spark.createDataFrame([(k, "x" * (k % 977)) for k in range(20_000)], "doc_id long, text string")
    rows = sharding.shard(docs).collect()
    sizes, places = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        assert (r.size, r.text_crc32) == (16 + r.doc_id % 977, zlib.crc32(b"x" * (r.doc_id % 977)))
        sizes[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert len(sizes) == 40 and max(sizes.values()) < 1.01 * min(sizes.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard(odd).count() == 9 and sharding.shard(odd.limit(0)).count() == 0
    assert {r.doc_id: r.size for r in sharding.shard(odd).collect()}[1] == 16


def test_growth_moves_slots_only_to_the_new_shard():
    old = sharding.balanced_map([(s, 100 + s % 13, 1) for s in range(4096)], 10, 4096)
    new = sharding.grown_map(old, 10)
    moved = [b for a, b in zip(old, new) if a[2] != b[2]]
    share = sum(r[3] for r in old) / 11
    assert moved and {r[2] for r in moved} == {10} and {r[0] for r in new} == {2}
    assert sum(r[3] for r in moved) == pytest.approx(share, rel=0.03)


def test_edits_move_no_more_than_needed():
    old = sharding.balanced_map([(s, 1000 + s % 13, 1) for s in range(4096)], 10, 4096)
    sizes = [(s, n) for _, s, _, n, _ in old]
    assert sharding.edited_map(old, [(s, n, 1) for s, n in sizes], 10) == old
    first = {r[1] for r in old if r[2] == 0}
    new = sharding.edited_map(old, [(s, 2 * n if s in first else n, 1) for s, n in sizes], 10)
    totals = collections.Counter()
    for _, _, shard, size, _ in new:
        totals[shard] += size
    assert {r[0] for r in new} == {2} and max(totals.values()) < 1.011 * min(totals.values())
    moved = [b for a, b in zip(old, new) if a[2] != b[2]]
    assert {r[1] for r in moved} <= first and sum(r[3] for r in moved) < 0.9 * 2 * sum(n for s, n in sizes if s in first)
    fewer = sharding.edited_map(old, [(s, n, 1) for s, n in sizes], 9)
    assert all(r[2] < 9 for r in fewer) and all(a[2] == b[2] for a, b in zip(old, fewer) if a[2] < 9)
    assert sharding.edited_map([(1, 0, 0, 0, 0), (1, 1, 1, 0, 0)], [(0, 5, 1)], 2)[0][2] == 0
    assert sharding.edited_map([(1, 0, 0, 0, 0)], [], 3) == [(1, 0, 0, 0, 0)]


def test_map_is_stored_and_edited_on_the_next_run(spark, tmp_path):
    path = str(tmp_path / "map")
    docs = spark.createDataFrame([(k, "x" * (k % 977)) for k in range(20_000)], "doc_id long, text string")
    run = lambda d: {r.doc_id: r for r in sharding.shard(d, 8, 256, map_path=path).collect()}
    first, again = run(docs), run(docs)
    assert {r.map_version for r in first.values()} == {1} and first == again
    more = run(docs.union(docs.where("doc_id < 9000").selectExpr("doc_id + 100000", "text || 'y'")))
    assert {r.map_version for r in more.values()} == {2}
    sizes = collections.Counter()
    for r in more.values():
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) < 1.02 * min(sizes.values())
    assert sum(first[k].shard == more[k].shard for k in first) > 0.9 * len(first)
    assert sharding.grow(spark, path, 8) == 3 and sharding.slot_map(spark, path).count() == 256
    assert sharding.slot_map(spark, path, 1).select("version").distinct().collect()[0][0] == 1
    with pytest.raises(ValueError):
        sharding.shard(docs, 8, 128, map_path=path)
    assert sharding.slot_map(spark, str(tmp_path / "none")).count() == 0


def test_shard_query_against_brute_force(spark, tmp_path):
    docs = [(1, None), (2, ""), (3, "é"), (4, "same"), (5, "same"), (None, "x")]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 AS virtual_slot").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op8_virtual_slots(spark, str(tmp_path)).collect()
    data = lambda t: (t or "").encode()
    want = sorted((k is None, k or 0, len(data(t)) + 16, zlib.crc32(data(t))) for k, t in docs)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == want
    assert len({(r.shard, r.slot) for r in rows}) == len(docs) and {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    assert all(0 <= r.shard < 40 and r.next_shard in (r.shard, 40) for r in rows)


# Quality rules


def test_rules_same_as_sql(spark):
    compare(spark, queries.QUERIES, queries.ORACLE_SQL, ["op9_rule_ledger"])


def brute_rules(text):
    text = text or ""
    w = words(text)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab#\n \t|é😀"), max_size=60), min_size=1, max_size=12))
def test_measurements_against_brute_force(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.measured(docs).collect()}
    assert got == {k: brute_rules(t) for k, t in enumerate(texts)}


def test_ledger_odd_rows_and_ablations(spark, odd):
    entries = quality_rules.apply_policy(quality_rules.ledger(odd), 2)
    got = {r.doc_id: r for r in entries.collect()}
    assert got[4].n_repeat_words == 30_000 and not got[4].kept and got[1].n_words == 0 and entries.count() == 9
    table = {r.rule: (r.failed, r.failed_alone) for r in quality_rules.ablations(entries, 2).collect()}
    masks = [r.failures for r in entries.collect()]
    for k, rule in enumerate(quality_rules.RULES):
        failed = sum(m >> k & 1 for m in masks)
        assert table.get(rule, (0, 0)) == (failed, sum(m == 1 << k for m in masks))
    assert quality_rules.ledger(odd.limit(0)).count() == 0


# Personal data

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid(kind, v):
    digits = re.sub("[^0-9]", "", v)
    return kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in v.split("."))) or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 8 <= len(digits) <= 15)


def spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in KINDS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


HARD = [
    "a@b.co_x@y.com c@d e@f..g h%+@i.j.k", "1.2.3.4.5.6.7.8 256.1.1.1 00255.1.1.01 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111114 4  111", "x4111111111111111y 12 4111111111111111-", "+1 (499) 555-6503, +12345678 +1 +123456789012345678 ++1-2-3-4-5-6-7-8",
    "😀 é a@b.cc 😀 1.1.1.1", "-".join(["1"] * 40), "a.b@" * 300, "@" * 50 + "x@y.z", "1" * 400 + ".1.1.1",
]


def check_spans(rows, texts):
    for r in rows:
        base = spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), texts[r.doc_id]
        assert r.spans.split(",")[: len(base)] == base or not base
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in base) for k in KINDS]


def test_spans_against_brute_force(spark, small, odd):
    texts = dict(enumerate(HARD))
    check_spans(pii_info.find(documents(spark, list(texts.items()))).collect(), texts)
    texts = {r.doc_id: r.text for r in small.collect()}
    check_spans(queries.op5_disclosure_spans(spark, SF).collect(), texts)
    assert pii_info.find(odd).count() == 9 and pii_info.find(odd.limit(0)).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from("a1.+@ -(4é%_"), max_size=50), min_size=1, max_size=20))
def test_spans_of_random_texts(spark, texts):
    check_spans(pii_info.find(documents(spark, list(enumerate(texts)))).collect(), dict(enumerate(texts)))


def test_disclosing_terms(spark):
    """A name that stands only with one address discloses it; words that stand everywhere do not."""
    told = [(k, f"note {k} from the desk of Marlowe at m.lowe@corp.example and the rest") for k in range(4)]
    other = [(10 + k, f"note {k} from the desk about something{k} and the rest") for k in range(40)]
    docs = documents(spark, told + other)
    got = {r.doc_id: r.spans.split(",") for r in pii_info.find(docs).where("n_term > 0").collect()}
    assert set(got) == {0, 1, 2, 3}
    terms = {told[k][1][int(s.split(":")[1]) : int(s.split(":")[2])] for k, v in got.items() for s in v if s.startswith("term:")}
    assert terms == {"Marlowe"}
    clean = {r.doc_id: r.text for r in pii_info.sanitise(docs).collect()}
    assert clean[2] == "note 2 from the desk of [TERM] at [EMAIL] and the rest" and clean[12] == other[2][1]
    assert pii_info.sanitise(docs).columns == docs.columns


def test_names_of_one_text(spark):
    """A name beside an address is a term in its only text; words that open a sentence, that others write small, or that are merely rare are not."""
    texts = {
        1: "please ask Marlowe at m.lowe@corp.example about it. Zuvrek came too",
        2: "ended here. Quandrel wrote to x.y@other.example, the vorplix of all\nBrindlo was there",
        3: "ask for the Harbour at h.h@third.example when there", 4: "from Odalys, +1 (499) 555-6503, to all", 5: "Tessaly: t.t@fourth.example",
        6: "see 10.0.0.7 \u201cGwendolen said so", 7: "by ÉLODIE or Élodie-Marguerite at e.m@fifth.example",
    }
    texts |= {100 + k: f"note {k} says please ask for the harbour at all, and others came from there when it ended {'x' * k}" for k in range(60)}
    docs = documents(spark, list(texts.items()))
    got = {r.doc_id: [texts[r.doc_id][int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in r.spans.split(",")) if k == "term"] for r in pii_info.find(docs).where("n_term > 0").collect()}
    assert got == {1: ["marlowe"], 4: ["odalys"], 7: ["élodie", "élodie", "marguerite"]}
    clean = {r.doc_id: r.text for r in pii_info.sanitise(docs).collect()}
    assert clean[1] == "please ask [TERM] at [EMAIL] about it. Zuvrek came too" and clean[2] == texts[2].replace("x.y@other.example", "[EMAIL]")
    assert clean[110] == texts[110]


def test_planted_names_are_terms(spark, small):
    """Names planted beside addresses in half of the given documents: all found, the other documents left as they are."""
    rng = random.Random(8)
    rows, planted = [], {}
    for r in small.select("doc_id", "text").dropDuplicates(["doc_id"]).collect():
        w = (r.text or "").split(" ")
        if r.doc_id % 2:
            name = "".join(rng.choice(("Bal", "Cor", "Dim", "Fel"))) + "".join(rng.choice(("ando", "ewyn", "ikko", "urro", "ozar")) for _ in range(4))
            at = rng.randrange(len(w) + 1)
            w[at:at] = ["written", "by", name, f"(n{r.doc_id}@place{r.doc_id}.example)"]
            planted[r.doc_id] = name.lower()
        rows.append((r.doc_id, " ".join(w)))
    texts = dict(rows)
    found = {}
    for r in pii_info.find(documents(spark, rows)).where("n_term > 0").collect():
        found[r.doc_id] = {texts[r.doc_id][int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in r.spans.split(",")) if k == "term"}
    hit = sum(name in found.get(k, ()) for k, name in planted.items())
    assert hit >= 0.95 * len(planted) and len(planted) > 50
    assert sum(map(len, found.values())) <= 1.3 * hit  # rare words that stand capitalised beside an address are told too


def test_disclosing_terms_against_brute_force(spark, small):
    """Mutual information from plain counts over rows, repeated rows and null ids included."""
    rng = random.Random(2)
    names = [f"{a}{b}son" for a in ("ander", "brun", "carl", "dor", "evan") for b in ("na", "ti")]
    rows = []
    for k in range(150):
        who = rng.randrange(10)
        middle = f"{names[who]} writes from box{who % 4}@host{who % 3}.example now and {names[who]} again" if k % 3 else f"{rng.choice(names[:4])} says little today"
        rows.append((k if k % 20 else None, f"some {k} words before that go on for long enough to be out of reach of what follows below, {middle} and ever on"))
    rows += rows[:9]
    rows = [(k, t, "te", "di", 1, "dt", "th", "sp", 0.1) for k, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, terms string, did string, n_chars int, dth string, _th string, _spans string, score double")
    terms, values, both, texts = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set)
    found = []
    for r in rows:
        t, mine = r[1], set()
        for m in re.finditer(KINDS["email"], t):
            near = [x[0] for x in re.finditer(r"[a-z]+", t) if len(x[0]) > 2 and (m.start() - 60 < x.start() and x.end() <= m.start() or m.end() <= x.start() and x.end() < m.end() + 60)]
            for e in (m[0], "of " + m[0].split("@")[1]):
                mine |= {(w, e) for w in near}
                values[e] += 1
        for w in set(re.findall(r"[a-z]+", t)):
            terms[w] += 1
        for pair in mine:
            both[pair] += 1
            texts[pair].add(t)
        found.append(mine)
    total = len(rows)
    share = {(w, e): math.log2(total * n / (terms[w] * values[e])) / math.log2(total / values[e]) for (w, e), n in both.items() if len(texts[w, e]) > 1}
    want = collections.Counter()
    for r, mine in zip(rows, found):
        told = {w for w, e in mine if share.get((w, e), 0) >= 0.8}
        want[r[0], ",".join(f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[a-z]+", r[1]) if m[0] in told)] += 1
    got = collections.Counter((r.doc_id, ",".join(x for x in r.spans.split(",") if x.startswith("term:"))) for r in pii_info.find(docs).collect())
    assert got == want and sum(n for (_, s), n in want.items() if s) > 20
    clean = pii_info.sanitise(docs)
    assert clean.columns == docs.columns and {tuple(r[2:]) for r in clean.collect()} == {r[2:] for r in rows}


def test_many_matches_in_one_text(spark):
    text = "é😀 " + " ".join(f"ab{k}@c.de" for k in range(20_000))
    docs = documents(spark, [(1, text)])
    start = time.time()
    row = pii_info.find(docs).first()
    assert row.n_email == 20_000 and row.spans.split(",")[-1] == f"email:{len(text) - 12}:{len(text)}"
    assert pii_info.sanitise(docs).first().text == "é😀 " + " ".join(["[EMAIL]"] * 20_000)
    assert time.time() - start < 60


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12)), max_size=12), min_size=1, max_size=8))
def test_overlapping_spans_are_one_stretch(spark, lists):
    text = "abcdefghijé😀klmnopqrstuvwxyzABCDEFGHIJKLMNOPQRS"
    rows = [(k, sorted((a, a + n, f"<{a}>") for a, n in spans)) for k, spans in enumerate(lists)]
    df = spark.createDataFrame(rows, "k int, spans array<struct<start:int,end:int,tag:string>>")
    from pyspark.sql import functions as F

    for block in (256, 2):
        pii_info.BLOCK, before = block, pii_info.BLOCK
        got = {r.k: r.t for r in df.select("k", pii_info.rewritten(F.lit(text), F.col("spans")).alias("t")).collect()}
        pii_info.BLOCK = before
        for k, spans in rows:
            out, at, tags = [], 0, {}
            for a, b, tag in spans:
                if a < at:
                    at = max(at, b)
                else:
                    out.append(text[at:a] + tag)
                    at = b
            assert got[k] == "".join(out) + text[at:]


# Decontamination


def test_reparameterised_questions(spark):
    item = "If Alice walks 12 km every day and then rests for 3 hours how many km has she walked after 5 days of this routine"
    texts = {
        1: f"intro words here {item} closing words", 2: item.replace("Alice", "Robert").replace("12", "40").replace(" 3 ", " 9 ").replace(" 5 ", " 8 "), 3: "nothing to do with it, just seven plain words and more",
        4: item.replace("walks", "swims").replace("rests", "sleeps").replace("routine", "week").replace("walked", "gone").replace("every", "each"), 5: None, 6: "", 7: item.upper(), 8: f"So {item.lower()}", 9: item.replace("Alice", "Robert van Winter".replace("van ", "")).replace("12", "31"),
    }
    bench = spark.createDataFrame([(0, item), (1, None), (2, "too short"), (3, item.replace("12", "13"))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(documents(spark, list(texts.items())), bench).collect()}
    # copies in capitals or without any are found by their tokens; another number near the start leaves 17 of 21 windows
    assert set(got) == {(d, i) for d in (1, 2, 7, 8, 9) for i in (0, 3)}
    assert got[7, 0].verbatim and got[8, 0].verbatim and not got[8, 3].verbatim and not got[9, 0].verbatim
    assert got[1, 0].verbatim and not got[2, 0].verbatim and not got[1, 3].verbatim and got[2, 0].coverage == 1
    kept = decontam.drop_contaminated(documents(spark, list(texts.items())), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert decontam.contaminated(documents(spark, []), bench).count() == 0 and decontam.contaminated(kept, bench.limit(0)).count() == 0


def test_items_without_template_windows(spark):
    items = ["What is 12 + 45 * 3 - 7 / 2", "prime number theorem", "Alice Brown 7 8 Bob Green 9 Carol White 10", "Paris", "too short"]
    texts = [f"first words, {items[0]} and more", f"THE {items[1].upper()}, again", f"so {items[2]} it goes", "Paris", "they went to Paris on foot", "What is 12 + 45 * 3 - 8 / 2", "theorem prime number", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, list(enumerate(texts)))
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3), (5, 0)}
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()) == [4, 6, 7, 8]


def test_short_items_with_other_numbers(spark):
    items = ["Compute 12 times 7", "add 12 and 45", "solve 3 + 4 * 5", "12 + 45 = 57", "pay 5 dollars", "Alice has 12 red apples and gives 5 of them to her brother on each of the 3 school days", "7 1 9 4 4 2 sorted 8 8 3 1 5 gives 6"]
    texts = [
        "Compute 99 times 8", "Please ADD 77 and 91 now", "so solve 8 + 9 * 2 then", "3 + 4 = 7", "they pay 9 dollars", items[5].upper().replace("12", "30").replace(" 5 ", " 8 "),
        "1 2 3 4 5 6 sorted 9 9 3 2 6 gives 8", "compute 99 divided by 8", "add twelve and 45", "solve 8 - 9 / 2", "solve 8 9 2", "add 5, and then 7", None, "", "12 + 45 = 57", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15",
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(documents(spark, list(enumerate(texts))), bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2), (5, 5), (6, 6), (14, 3)}
    assert got[0, 0].slots == 2 and got[0, 0].coverage == 1 and not got[0, 0].verbatim and got[14, 3].verbatim


def test_long_text_around_an_item(spark):
    filler = "some words without any end " * 40_000
    bench = spark.createDataFrame([(0, "add 12 and 45"), (1, "What is the sum of 14 and the product of 3 and 9")], "item_id long, text string")
    docs = documents(spark, [(1, f"{filler}add 7 and 8 {filler}"), (2, filler), (3, f"{filler}what is the sum of 1 and the product of 2 and 5")])
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == {(1, 0), (3, 1)}


def test_verbatim_passages_are_found(spark, small):
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = {(r.doc_id, i) for r in small.collect() for i, t in bench if t in (r.text or "")}
    assert {(r.doc_id, r.item_id) for r in queries.op7_template_leaks(spark, SF).collect()} == want and want


# Language model


def brute_log(word, table):
    text = lm_lattice.MARK + word
    alpha = [0.0] + [-math.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(j):
            log = table.get(text[i:j], -math.inf)
            if j == i + 1:
                log = float(np.logaddexp(log, len(text[i].encode()) * lm_lattice.BYTE_LOG))
            if log > -math.inf:
                alpha[j] = float(np.logaddexp(alpha[j], alpha[i] + log))
    return alpha[-1]


def test_lattice_sums_all_segmentations():
    pieces = ["▁a", "▁", "a", "b", "ab", "▁ab", "aba", "é"]
    logs = np.log(np.array([0.2, 0.1, 0.1, 0.1, 0.2, 0.1, 0.1, 0.1]))
    words_ = ["ab", "aba", "abab", "é", "xaé", "a", "b" * 600, "ab" * 300]
    got = lm_lattice.Lattice(pieces, logs).log_probabilities(words_)
    table = dict(zip(pieces, logs))
    assert got == pytest.approx([brute_log(w, table) for w in words_])


def test_expected_counts_add_up_to_pieces_used():
    pieces = ["▁a", "▁", "a", "b", "ab"]
    lattice = lm_lattice.Lattice(pieces, np.log(np.full(5, 0.2)))
    total = np.zeros(5)
    lattice.expected(["ab"], np.array([3.0]), total)
    back = dict(zip([pieces[i] for i in lattice.order], total))
    # three paths: ▁a b (0.04), ▁ ab (0.04), ▁ a b (0.008); those over bytes weigh less than the tolerance
    assert back["▁a"] == pytest.approx(3 * 0.04 / 0.088, rel=1e-4) and back["a"] == pytest.approx(3 * 0.008 / 0.088, rel=1e-4)


def test_long_words_are_counted_in_windows(monkeypatch):
    """A long word gives the counts that one pass over it gives, up to what a window cannot see."""
    pieces = ["▁", "a", "b", "ab", "ba", "aab", "ccc", "c"]
    lattice = lm_lattice.Lattice(pieces, np.log(np.array([0.2, 0.1, 0.1, 0.2, 0.1, 0.1, 0.1, 0.1])))
    draw = random.Random(4)
    long = ["".join(draw.choice("abc") for _ in range(n)) for n in (401, 1000, 1234)]
    windows, whole = np.zeros(8), np.zeros(8)
    lattice.expected(long, np.array([1.0, 2.0, 3.0]), windows)
    monkeypatch.setattr(lm_lattice, "WHOLE", 10**6)
    lattice.expected(long, np.array([1.0, 2.0, 3.0]), whole)
    assert windows == pytest.approx(whole, rel=1e-6) and whole.min() > 0


def test_whole_scores_against_brute_force(spark):
    """score and lattice_score from the fitted pieces: discounted words beside all segmentations."""
    draw = random.Random(8)
    texts = [" ".join(draw.choice(["understanding", "stand", "under", "x" * 450, "Été", f"q{draw.randrange(30)}"]) for _ in range(12)) for _ in range(60)]
    docs = documents(spark, list(enumerate(texts)))
    low = {k: [*words(re.sub("[A-Z]", lambda m: m[0].lower(), t)), None] for k, t in enumerate(texts)}
    counts = collections.Counter(w for k, ws in low.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    of = collections.Counter(counts.values())
    d = min(0.95, max(0.1, of[1] / (of[1] + 2 * of[2]))) if of[1] else 0.5
    vocabulary = lm_lattice.read_vocabulary(lm_lattice.vocabulary_path())
    assert max(map(len, vocabulary)) > 12
    frame = spark.createDataFrame([(bytearray((w or " ").encode()), c) for w, c in counts.items()], "word binary, c long")
    table = dict(zip(vocabulary, lm_lattice.fit_pieces(frame, vocabulary)))
    spelled = {w: brute_log(w, table) for ws in low.values() for w in ws if w}
    spelled[None] = brute_log(" ", table)
    stop = (counts[None] + 1) / (n + 2)
    for share in (lm_lattice.HEAD_SHARE, 1e-2):
        for r in lm_lattice.score(docs, lm_lattice.vocabulary_path(), head_share=share).collect():
            ws = low[r.doc_id]
            assert r.score == pytest.approx(sum(math.log10(max(counts[w] - d, 0) / n + d * v / n * math.exp(spelled[w])) for w in ws))
            assert r.lattice_score == pytest.approx(sum(math.log10(stop) if w is None else math.log10(1 - stop) + spelled[w] / math.log(10) for w in ws))


def test_base_scores_against_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in small.collect()}
    tokens = {k: [*words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for k, t in texts.items()}
    counts = collections.Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for share in (lm_lattice.HEAD_SHARE, 1e-3):  # the second sends most words through the join
        for r in lm_lattice.score(small, lm_lattice.vocabulary_path(), head_share=share).collect():
            ws = tokens[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(counts[w] > 0 for w in ws), n, zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) and -math.inf < r.score < 0


def test_language_model_odd_rows(spark, odd):
    got = lm_lattice.score(odd, lm_lattice.vocabulary_path()).collect()
    assert len(got) == 9 and all(-math.inf < r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert lm_lattice.score(odd.limit(0), lm_lattice.vocabulary_path()).count() == 0


# Classifiers


def brute_segments(scores):
    """Maximal segments by their definition: no sub-segment scores as much, and none that holds it does the same."""
    n = len(scores)
    sums = np.concatenate([[0.0], np.cumsum(scores)])

    def proper(i, j):
        return all(sums[i] < sums[k] for k in range(i + 1, j + 1)) and all(sums[j] > sums[k] for k in range(i, j))

    good = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if proper(i, j)]
    return [(i, j) for i, j in good if not any((a, b) != (i, j) and a <= i and j <= b for a, b in good)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 3, 5, -4, 7]), max_size=25))
def test_maximal_segments(values):
    listed = [(k, float(v)) for k, v in enumerate(values) if v]
    dense = [v - 1.0 for v in values[: listed[-1][0] + 1]] if listed else []
    if listed:
        dense[: listed[0][0]] = [v for v in dense[: listed[0][0]]]
    got = [(i, j) for _, i, j in toxicity.maximal_segments(listed, 1.0)]
    assert got == brute_segments(dense)


def test_toxic_documents_of_a_made_corpus(spark):
    draw = random.Random(3)
    plain = [f"w{k}q".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(400)]

    def text(bad):
        ws = draw.choices(plain, k=120)
        for _ in range(4 * bad):
            ws.insert(draw.randrange(len(ws)), draw.choice(["vilescum", "vilerot", "nasty"]))
        return " ".join(ws)

    rows = [(k, k % 5 == 0) for k in range(400)]
    docs = documents(spark, [(k, text(bad)) for k, bad in rows])
    labels = spark.createDataFrame([(k, int(bad)) for k, bad in rows if k % 2], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert sum(got[k] == bad for k, bad in rows) >= 396
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()} == {k for k, p in got.items() if not p}


def test_classifiers_odd_rows(spark, odd):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in (1, 2, 3, 4, 5, 7, 8)] + [(1, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    for labelled in (labels, labels.limit(0)):
        got = toxicity.score(odd, toxicity.fit(odd, labelled)).collect()
        assert len(got) == 9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        got = quality_nbsvm.score(odd, quality_nbsvm.fit(odd, labelled)).collect()
        assert len(got) == 9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert toxicity.score(odd.limit(0), None).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_nbsvm.score(docs, quality_nbsvm.fit(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in scored) >= 0.93 * len(scored)


def test_dual_coordinate_descent_separates():
    draw = np.random.default_rng(0)
    rows = [np.unique(np.concatenate([draw.integers(10, 500, 20), [k % 2]])) for k in range(200)]
    y = np.array([1.0 if k % 2 else -1.0 for k in range(200)])
    weights, bias = quality_nbsvm.train(rows, y)
    assert all(np.sign(quality_nbsvm.decision(x, weights, bias)) == t for x, t in zip(rows, y))


def test_descent_reaches_the_least_objective():
    """The fit's objective against that of a plain solver, projected gradient on the whole dual."""
    draw = np.random.default_rng(5)
    rows = [np.unique(np.concatenate([draw.integers(0, 40, 12), [40 + (k + (k % 7 == 0)) % 2]])) for k in range(60)]
    y = np.array([1.0 if k % 2 else -1.0 for k in range(60)])
    weights, bias = quality_nbsvm.train(rows, y, epochs=2000)
    x = np.zeros((60, weights.shape[1]))
    for k, r in enumerate(rows):
        x[k, r] = weights[1][r]
        x[k] /= max(np.linalg.norm(x[k]), 1e-9)
    objective = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()
    signed, alpha = np.column_stack([x, np.ones(60)]) * y[:, None], np.zeros(60)
    step = 1 / np.linalg.eigvalsh(signed @ signed.T).max()
    for _ in range(20_000):
        alpha = np.clip(alpha + step * (1 - signed @ (signed.T @ alpha)), 0, 1)
    best = signed.T @ alpha
    assert abs(objective(weights[0], bias) - objective(best[:-1], best[-1])) < 1e-2 * objective(best[:-1], best[-1])


def test_ratios_against_plain_counts(spark):
    """Every n-gram has a ratio of its own, from counts of the sample's rows outside the fold of the curve."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_nbsvm.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    ones, zeros, n = collections.Counter(), collections.Counter(), 0
    for r in labels.collect():
        text = texts.get(r.doc_id)
        if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 5 and zlib.crc32((text or "").encode()) % 5:
            (ones if r.quality == 1 else zeros).update(quality_nbsvm.indicators(text, quality_nbsvm.Shapes()))
            n += 1
    every = ones.keys() | zeros.keys()
    a, b = (sum(c.values()) + len(every) for c in (ones, zeros))
    want = {g: math.log((ones[g] + 1) / a) - math.log((zeros[g] + 1) / b) for g in every if ones[g] + zeros[g] >= quality_nbsvm.LEAST_DOCS}
    got = {g: model["weights"][1][k] for g, k in model["number"].items()}
    assert n > 50 and len(got) > 200
    assert got.keys() <= want.keys() and all(abs(got.get(g, 0) - want[g]) < 1e-9 for g in want)


# Web pages

PAGES = [
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1><p>One, two   three.<p>Four<br>five <b>six</b>.</article><footer>foot</footer></body>", "Title & more\nOne, two three.\nFour five six."),
    ("<div class='sidebar'><p>Long side text, with commas, many, many, commas, here.</p></div><div id=content><p>Main text here, with some words in it, and more.</p><p>Second, and also long enough to be read.</p></div><div class=comments><p>A comment, rude, long, and silly, as ever.</p></div>", "Main text here, with some words in it, and more.\nSecond, and also long enough to be read."),
    ("<article><p>Text<script>var a='<p>no</p>'</script> goes on</p><form><input><label>Mail</label></form><aside>see also</aside><ul><li>item one<li>item two</ul><section class=comments><p>hi</p></section><p>End&#33;</p></article>", "Text goes on\nitem one\nitem two\nEnd!"),
    ("<article><p>Ti.</p></article><div class=ad>Buy, buy, buy, and buy again, all of it, now, now, please.</div>", "Ti."), (None, ""), ("", ""), ("plain words only", "plain words only"), ("<nav>menu</nav>", ""),
    ("<body><form action=x><input type=hidden><nav>menu</nav><article><h1>Head</h1><p>One, two, three, and more.</p></article><form><label>Find</label></form></form><p>Rights.</p></body>", "Head\nOne, two, three, and more."),
    ("<form><div class=main><p>One, two, three, and more.</p><div class=cookie-notice><p>We use them.</p></div></div></form>", "One, two, three, and more."),
    ("<article><p>First, here.</p><section id=related-work><h2>Related work</h2><p>Others did it, before.</p></section><div class=notice-board><p>The board, at the door.</p></div><p>Last.</p></article>", "First, here.\nRelated work\nOthers did it, before.\nThe board, at the door.\nLast."),
    ("<article><p>First, here.</p><div class=related-topics><a href=x>One</a> <a href=y>Two</a></div><div class=comments-list><p>Rude, very.</p></div><div class=reader-comments>No.</div><div class=ad-leaderboard>Buy</div><div class=notice-box>Down.</div></article>", "First, here."),
    ("<div id=content class='layout has-sidebar'><p>One, two, three.</p></div><div class=left-sidebar><p>Side, side, side, side.</p></div>", "One, two, three."),
    ("<div class='sidebar-right page'><p>All of it, in here.</p><div class=share-box><p>Share it</p></div></div>", "All of it, in here."),
    ("<main><article><p>First, long, with commas, and more.</p></article><article><p>Second.</p></article><article class='comment'><p>No, no.</p></article></main>", "First, long, with commas, and more.\nSecond."),
    ("<body><div><h2>Head</h2><div><p>A, b, c, d, e, f, g.</p><p>H, i, j, k.</p></div><div><p>Short.</p></div><div><a href=x>link one</a> <a href=y>link two</a></div></div></body>", "Head\nA, b, c, d, e, f, g.\nH, i, j, k.\nShort."),
    ("<article><p>See <math><mi>x</mi></math>, press <button>Run</button> and <object>a film</object>.</p></article>", "See x, press Run and a film."),
    ("<article><div><div><p>Deep, deep, deep.</p></div></div><p>Other, text.</p></article>", "Deep, deep, deep.\nOther, text."),
    ("<div class='entry with-share no-comments'><p>Text, text.</p></div><section class=user-comments><p>Rude, rude, rude, rude.</p></section>", "Text, text."),
]


@pytest.mark.parametrize(("html", "want"), PAGES)
def test_main_text(html, want):
    assert html_extract.main_text(html) == want


TAGS = st.sampled_from(["div", "section", "article", "main", "p", "h2", "a", "li", "td"])
TREES = st.recursive(st.text("ab, ", min_size=1, max_size=150), lambda inner: st.tuples(TAGS, st.lists(inner, max_size=4)), max_leaves=14)


@settings(max_examples=200, deadline=None)
@given(st.lists(TREES, min_size=1, max_size=5))
def test_scores_of_random_trees(trees):
    """Scores by their definition, from each container down."""
    root = html_extract.Node("root", None)

    def build(node, parts):
        for part in parts:
            if isinstance(part, str):
                node.children.append(part)
            else:
                child = html_extract.Node(part[0], node)
                node.children.append(child)
                build(child, part[1])

    build(root, trees)
    blocks = html_extract._blocks(root)
    if not blocks:
        return
    best, score, _ = html_extract._scored(blocks)

    def up(node):
        return [] if node is None else [node, *up(node.parent)]

    def by_definition(container):
        points = size = links = 0
        for owner, text, linked in blocks:
            line = up(owner)
            if container not in line:
                continue
            size, links = size + len(text), links + linked
            gives = 0 if owner.tag == "h2" else 1 + text.count(",") + min(len(text) // 100, 3)
            first = 1 if owner.tag in ("p", "h2", "li", "td") and owner.parent else 0
            line = line[first:]
            if container not in line:
                continue
            at = line.index(container)
            article = next((k for k, n in enumerate(line) if n.tag in ("article", "main")), None)
            if article == at:
                points += 1.1 * gives
            else:
                far = at if article is None or at < article else at - article
                points += gives * (1 if far == 0 else 1 / 2 if far == 1 else 1 / (3 * far))
        return points * (1 - links / max(size, 1))

    assert score == {n: pytest.approx(by_definition(n)) for n in score}
    assert score[best] == max(score.values())


def test_pages(spark):
    pages = spark.createDataFrame([(k, f"u{k}", h, "t", 3) for k, (h, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0], "t", 3)], "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract(pages).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == sorted([(k, t, len(t)) for k, (_, t) in enumerate(PAGES)] + [(0, PAGES[0][1], len(PAGES[0][1]))])
    deep = "<div>" * 20_000 + "<p>deep, deep down</p>" + "</div>" * 20_000
    assert html_extract.main_text(deep) == "deep, deep down"
    for row in queries.op10_main_text(spark, SF).collect():
        assert row.n_chars == len(row.text)


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, common.materialise(stage(spark, kept, SF), f"test-{name}")
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count()
    left = {r.doc_id for r in kept.collect()}
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.collect()} == left
    groups = collections.defaultdict(set)
    for r in queries.op4_simhash_groups(spark, SF).collect():
        groups[r.component_id].add(r.doc_id)
    assert all(len(g & left) <= 1 for g in groups.values())
    assert not any(spans(r.text) for r in kept.collect())
