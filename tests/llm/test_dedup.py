"""Exact and near duplicates against brute force; edge cases of each."""

import hashlib
import random

import numpy as np
import pytest

from docframe.llm import near_copies
from docframe.llm.components import components
from docframe.llm.embed_dedup import Forest, embedding_groups
from docframe.llm.exact_dedup import build_index, drop_exact_copies, exact_dedup, split_directory
from docframe.llm.simhash import BLOCKS, block_masks, fingerprint, fingerprint_links, simhash_groups, unary_codes

ODD = "doc_id long, text string, lang string, h long, component string, bucket int, keep_id string"


def odd(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 1, "x", 2, "y") for i, t in rows], ODD)


def union_find(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_components_match_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 640)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union_find(700, links)
    assert found == {x: want[x] for ab in links if ab[0] != ab[1] for x in ab}
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_directory_splits_only_overfull_buckets():
    slots = split_directory({0: 5, 1: 5, 2: 1, 3: 1, 7: 1}, 3, 6)
    assert slots == [0, 1, 2, 2, 3, 3, 3, 3]
    assert split_directory({}, 0, 10) == [0]


def test_exact_dedup(spark):
    rng = random.Random(2)
    texts = [rng.choice(["", "a", "b", "a\x00", "é", "é", "x" * 100_000]) for _ in range(200)] + [f"t{i}" for i in range(100)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1000, None), (None, "only null id"), (None, "a")]
    found = exact_dedup(odd(spark, rows), capacity=8).collect()
    assert len(found) == len(rows) and max(r["bucket"] for r in found) > 3
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for r in found:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = [i for i in own if i is not None]
        assert r["group_size"] == len(own) and r["keep_id"] == (max(ids) if ids else None) and r["kept"] == (r["doc_id"] == r["keep_id"])
    kept = drop_exact_copies(odd(spark, rows))
    assert kept.columns == odd(spark, []).columns and sorted(kept.toPandas()["text"].fillna("")) == sorted(groups)
    assert exact_dedup(odd(spark, [])).count() == 0


def test_every_near_pair_shares_a_cell():
    rng = np.random.default_rng(3)
    masks = [m % (1 << 64) for m in block_masks()]
    assert len(masks) == 20 and BLOCKS == 6
    a = rng.integers(0, 1 << 64, 2000, np.uint64, endpoint=False)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in a], np.uint64)
    x, y = unary_codes(a), unary_codes(a ^ flips)
    assert (np.bitwise_count(x ^ y) <= np.bitwise_count(flips)).all()
    assert all(any((int(p) ^ int(q)) & m == 0 for m in masks) for p, q in zip(x, y, strict=True))


def test_fingerprint_definition():
    import xxhash

    def plain(text):
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        if not words:
            return 0
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    for t in ("", "  \n", "One", "one TWO", "a b c d a b c", "É é\x1cx\x85y z w", "w " * 70_000):
        assert fingerprint(t) == plain(t)
    assert fingerprint(None) == 0


@pytest.mark.parametrize("block", [3, 512])
def test_links_span_all_components(spark, block):
    rng = random.Random(4)
    fps = {0}
    while len(fps) < 400:
        base = rng.getrandbits(64) if rng.random() < 0.2 or not fps else rng.choice(sorted(fps))
        for _ in range(rng.randrange(4)):
            base ^= 1 << rng.randrange(64)
        fps.add(base)
    fps = sorted(fps)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    links = [(r["a"], r["b"]) for r in fingerprint_links(spark.createDataFrame(rows, "rep long, fp long"), block).collect()]
    near = [(i, k) for i in range(len(fps)) for k in range(i) if (fps[i] ^ fps[k]).bit_count() <= 3]
    assert union_find(len(fps), links) == union_find(len(fps), near)


def test_simhash_groups(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.choices(words, k=400)) for _ in range(10)]
    rows = []
    for i, t in enumerate(base * 6):
        own = t.split()
        if i >= 10:
            own[rng.randrange(400)] = "changed"
        rows.append((i, " ".join(own)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "short"), (None, "short"), (104, "SHORT")]
    found = {r["doc_id"]: r for r in simhash_groups(odd(spark, rows)).collect()}
    ids = [i for i, _ in rows if i is not None]
    fp = {i: fingerprint(t) for i, t in rows if i is not None}
    near = [(a, b) for a in range(len(ids)) for b in range(a) if (fp[ids[a]] ^ fp[ids[b]]).bit_count() <= 3]
    want = union_find(len(ids), near)
    assert {i: found[i]["component_id"] for i in ids} == {i: ids[want[k]] for k, i in enumerate(ids)}
    assert found[101]["fingerprint"] == "0" * 16 and found[None]["component_id"] == 103
    assert simhash_groups(odd(spark, [])).count() == 0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 16))
    some = [b + rng.standard_normal(16) * s for b in base for s in (0, 0.05, 0.1, 0.2, 0.3)] + [base[0] * 2, base[1].copy()]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(some)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] * 8), (904, [float("inf")] * 16), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<double>, leaf string, rep int")
    for block in (7, 1024):
        found = {r["vec_id"]: r for r in embedding_groups(df, leaf=32, block=block, sample=100).collect()}
        x = np.stack(some)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= 0.95
        np.fill_diagonal(near, False)
        mine = np.array([found[i]["n_links"] for i in range(len(some))])
        assert (mine <= near.sum(1)).all() and mine.sum() >= 0.95 * near.sum()
        assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in range(900, 906))
        assert found[0]["component_id"] == found[1]["component_id"] == 0 and not found[1]["kept"]
        assert len(found) == len(rows)
    assert embedding_groups(df.limit(0)).count() == 0


def test_short_vectors_null_ids_and_repeated_ids_link(spark):
    base = [float(x) for x in np.random.default_rng(9).standard_normal(8)]
    other = [-x for x in base]
    rows = [(1, base), (None, base), (None, [2 * x for x in base]), (2, other), (2, other), (2, [x + 1e-6 for x in other]), (3, [1.0, 2.0]), (4, [1.0, 2.0]), (None, [0.0, 1.0, 0.0])]
    found = embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found), key=str)
    want = [(1, 2, 1, True), (None, 2, 1, False), (None, 2, 1, False), *[(2, 2, 2, True)] * 3, (3, 1, 3, True), (4, 1, 3, False), (None, 0, None, True)]
    assert got == sorted(want, key=str)


def test_links_near_the_limit_are_told_in_double(spark):
    rng = np.random.default_rng(10)
    rows, step = [], [1e-9, -1e-9, 1e-13, 3e-6, -3e-6]
    for i, d in enumerate(step * 4):
        a, b = rng.standard_normal(32), rng.standard_normal(32)
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.95 + d
        rows += [(2 * i, [float(x) for x in a]), (2 * i + 1, [float(x) for x in c * a + np.sqrt(1 - c * c) * b])]
    found = {r["vec_id"]: r["n_links"] for r in embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(found[2 * i] == found[2 * i + 1] == (d > 0) for i, d in enumerate(step * 4) if abs(d) > 1e-12)


def test_recall_at_default_settings(spark):
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.standard_normal((5000, 64)))
    centre = unit(rng.standard_normal((1, 64)))
    base[:1500] = unit(np.sqrt(0.7) * centre + np.sqrt(0.3) * base[:1500])
    other = rng.standard_normal((5000, 64))
    other = unit(other - (other * base).sum(1, keepdims=True) * base)
    c = rng.uniform(0.951, 0.99, (5000, 1))
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * other])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame(__import__("pandas").DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}))
    found = {r["vec_id"]: r["n_links"] for r in embedding_groups(df, leaf=256).collect()}
    mine = np.array([found[i] for i in range(len(x))])
    assert (mine <= near.sum(1)).all() and mine.sum() >= 0.99 * near.sum()


def test_one_leaf_counts_every_pair_once(spark):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(8)
    rows = [(i, [float(x) for x in centre + rng.standard_normal(8) * 0.02]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = embedding_groups(df, leaf=16, block=20, spill=0.5).collect()
    assert {r["component_id"] for r in found} == {0} and all(r["n_links"] <= 149 for r in found)
    assert sum(r["n_links"] for r in found) >= 0.9 * 150 * 149


def test_deep_forest_keeps_links_of_a_dense_cluster():
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    noise = lambda n: unit(rng.standard_normal((n, 64)))
    centre = noise(1)
    dense = lambda n: unit(np.sqrt(0.8) * centre + np.sqrt(0.2) * noise(n))
    a = dense(500)
    step = noise(500)
    step = unit(step - (step * a).sum(1, keepdims=True) * a)
    x = np.concatenate([a, 0.955 * a + np.sqrt(1 - 0.955**2) * step])
    # 12 levels, as of a million vectors: the sample fits about 9 of them
    forest = Forest(np.concatenate([noise(15_000), dense(5_000)]), 12)
    met = np.zeros(500, bool)
    for t in range(forest.trees):
        held = [set() for _ in x]
        for r, n in zip(*(v.tolist() for v in forest.leaves(x, t)), strict=True):
            held[r].add(n)
        met |= [bool(held[i] & held[500 + i]) for i in range(500)]
    assert met.mean() >= 0.99


def test_index_compares_bytes_where_hashes_collide(spark):
    from pyspark.sql import functions as F

    texts = ["a", "b", "a", "c", "d", "a", "b", "e"]
    rows = spark.createDataFrame([(i, 7 if t in "abc" else 100 + i, t.encode(), t, 1) for i, t in enumerate(texts)], "doc_id long, h long, sha binary, text string, rows long")
    entries = rows.groupBy("h", "sha").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("rows"))
    index, _ = build_index(rows, entries, capacity=1, max_depth=4)
    found = {r["sha"].decode(): (r["keep_id"], r["group_size"], r["chain"]) for r in index.collect()}
    assert found == {"a": (5, 3, 1), "b": (6, 2, 2), "c": (3, 1, 3), "d": (4, 1, 1), "e": (7, 1, 1)}


def test_index_splits_and_moves_few_texts(spark, monkeypatch):
    import docframe.llm.exact_dedup as own

    rows = odd(spark, [(i, f"text {i % 900}") for i in range(1000)])
    found = exact_dedup(rows).collect()
    assert len({r["bucket"] for r in found}) > 1
    monkeypatch.setattr(own, "BROADCAST_HASHES", 0)
    assert sorted(exact_dedup(rows).collect()) == sorted(found)


def test_survivor_of_repeated_id_and_text_is_fixed(spark):
    rows = [(1, "x", lang) for lang in ("fr", "en", "de")]
    kept = [drop_exact_copies(spark.createDataFrame(r, "doc_id long, text string, lang string")).collect() for r in (rows, rows[::-1])]
    assert kept[0] == kept[1] and len(kept[0]) == 1


def test_near_copies_by_five_words(spark):
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in ("ar", "el", "in", "os", "u") for c in "klmnt"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows, base = [], [text(rng.choice([60, 300, 900])) for _ in range(60)]
    for i, t in enumerate(base):
        rows.append((i, t))
        for k in range(4):
            own = t.split()
            for _ in range(max(1, len(own) * k // 100)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((1000 + 10 * i + k, " ".join(own)))
    rows += [(5000, None), (5001, " "), (5002, "Two words"), (5003, "two  WORDS"), (5004, "two other"), (None, base[0]), (7, text(90)), (7, base[3] + " more"), (5005, "long " * 200_000)]
    df = odd(spark, rows)
    texts = list(dict.fromkeys(t or "" for _, t in rows))
    sets = [set(near_copies.shingles(near_copies.words_of(t)).tolist()) for t in texts]
    alike = lambda x, y: not (x | y) or len(x & y) >= 0.8 * len(x | y)
    true = [(i, k) for i in range(len(texts)) for k in range(i) if alike(sets[i], sets[k])]
    group = union_find(len(texts), true)
    number = {t: i for i, t in enumerate(texts)}
    hashes = {r["h"]: r["t"] for r in df.selectExpr("coalesce(text, '') AS t", "xxhash64(coalesce(text, '')) AS h").collect()}
    kept = [(r["doc_id"], hashes[r["text_hash"]]) for r in near_copies.near_copy_keepers(df).collect()]
    held = [group[number[t]] for _, t in kept]
    # every group keeps a row, and nearly all keep just one, that of the smallest id
    assert set(held) == set(group) and len(held) <= 1.04 * len(set(group))
    least = {}
    for i, t in rows:
        g = group[number[t or ""]]
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    assert sum((i is None, i or 0) == least[group[number[t]]] for i, t in kept) >= 0.97 * len(kept)
    assert near_copies.near_copy_keepers(odd(spark, [])).count() == 0


@pytest.mark.parametrize("block", [3, 512])
def test_candidates_lose_no_near_fingerprint_of_a_cell(spark, block):
    rng = np.random.default_rng(13)
    base = rng.integers(0, 256, (30, 32), np.uint8)
    fps = [b ^ np.packbits(rng.random(256) < 0.02) for b in base for _ in range(6)]
    rows = [(int(i) * 7 % 1009, f.tobytes()) for i, f in enumerate(fps)]
    pairs = [(r["a"], r["b"]) for r in near_copies.candidate_pairs(spark.createDataFrame(rows, "node long, fp binary"), len(rows), block).collect()]
    number = {n: i for i, (n, _) in enumerate(rows)}
    assert union_find(len(rows), [(number[a], number[b]) for a, b in pairs]) == [i - i % 6 for i in range(len(rows))]
    assert all(a < b for a, b in pairs)


@pytest.mark.parametrize(("block", "part_bytes"), [(3, 1 << 24), (512, 1 << 24), (512, 1 << 13)])
def test_all_candidates_are_verified(spark, monkeypatch, block, part_bytes):
    monkeypatch.setattr(near_copies, "PART_BYTES", part_bytes)
    rng = random.Random(15)
    words = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in ("ar", "el", "in", "os", "u") for c in "klmnt"]

    def shuffled(own):
        """The same words and nearly the same pairs of words, but other runs of five words."""
        cuts = sorted(rng.sample(range(1, len(own)), 11))
        runs = [own[i:k] for i, k in zip([0, *cuts], [*cuts, len(own)], strict=True)]
        rng.shuffle(runs)
        return sum(runs, [])

    texts = []
    for _ in range(40):
        one = rng.choices(words, k=200)
        at = rng.randrange(180)
        other = [*one[:at], *rng.choices(words, k=12), *one[at + 12 :]]
        # these two are alike; each has copies that are nearer by fingerprint, but not alike
        texts += [" ".join(t) for x in (one, other) for t in (x, *(shuffled(x) for _ in range(5)))]
    split = [near_copies.words_of(t) for t in texts]
    fp = np.frombuffer(b"".join(map(near_copies.fingerprint, split)), "<u8").reshape(-1, near_copies.WORDS)
    apart = np.bitwise_count(fp[:, None] ^ fp).sum(2, dtype=int)
    count = near_copies.popcounts(fp)
    meet = np.any([(count[:, None, own] == count[:, own]).all(2) for own in near_copies.grids(len(texts))], axis=0)
    near = [(i, k) for i, k in np.argwhere(meet & (apart <= int(near_copies.FAR * 256))).tolist() if i < k]
    sets = [set(near_copies.shingles(w).tolist()) for w in split]
    true = [(i, k) for i, k in near if len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k])]
    assert len(true) >= 30 and len(near) > 10 * len(true)
    kept = [r["doc_id"] for r in near_copies.near_copy_keepers(odd(spark, list(enumerate(texts))), block=block).collect()]
    assert sorted(kept) == sorted(set(union_find(len(texts), true)))


def test_popcounts_bound_the_distance_of_fingerprints():
    rng = np.random.default_rng(14)
    a = rng.integers(0, 1 << 64, (500, near_copies.WORDS), np.uint64, endpoint=False)
    b = a ^ (rng.integers(0, 1 << 64, a.shape, np.uint64, endpoint=False) & rng.integers(0, 1 << 64, a.shape, np.uint64, endpoint=False))
    x, y = (near_copies.popcounts(v).astype(int) for v in (a, b))
    assert (np.abs(x - y).sum(1) == np.bitwise_count(unary_codes(a) ^ unary_codes(b)).sum(1)).all()
    assert (np.abs(x - y).sum(1) <= np.bitwise_count(a ^ b).sum(1)).all()
    sizes = [len(near_copies.grids(n)[0]) for n in (10, 10**6, 10**9)]
    assert sizes == sorted(sizes) and [len(near_copies.grids(n)) for n in (10, 10**6, 10**9)] == sorted(len(near_copies.grids(n)) for n in (10, 10**6, 10**9))
