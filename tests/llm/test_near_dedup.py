"""The near-duplicate stage against brute-force Jaccard of 5-word shingles."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from seriesmill.llm import simhash
from seriesmill.llm.common import bin_of


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    """doc_id -> the least doc_id that links of a Jaccard of 0.8 or more reach."""
    sets = {d: plain_shingles(t) for d, t in texts.items()}
    least = {d: d for d in sets}

    def find(d):
        while least[d] != d:
            d = least[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if find(a) != find(b) and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
            p, q = sorted((find(a), find(b)))
            least[q] = p
    return {d: find(d) for d in sets}


def variants():
    """Hundreds of texts with one word changed each, a second family that shares half of the first, chains of edits, and copies."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(160)]
    other = base[:80] + [word() for _ in range(80)]
    texts = []
    for family, size in ((base, 420), (other, 300)):
        for _ in range(size):
            own = list(family)
            own[rnd.randrange(160)] = word()
            texts.append(" ".join(own))
    chain = [word() for _ in range(120)]
    for _ in range(12):  # neighbours are alike, ends are not
        texts.append(" ".join(chain))
        chain[rnd.randrange(120)] = word()
        chain[rnd.randrange(120)] = word()
    texts += [texts[0], texts[0].upper(), "", " \n", "few words", "few words", "Few  Words"]
    return dict(enumerate(texts))


def test_stage_as_by_brute_force_jaccard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = plain_groups({r.doc_id: r.text for r in docs.collect()})
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == sorted(set(want.values()))
    assert len(set(want.values())) < len(want)


def test_buckets_that_are_cut(spark):
    texts = variants()
    want = plain_groups(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    assert {r.doc_id: r.component_id for r in simhash.similar(df).collect()} == want


def test_links_of_a_block_as_by_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(100) > cut], rng.integers(0, 1 << 60, 5).astype(np.uint64)])) for cut in rng.uniform(0, 0.3, 120)]

    def groups(links):
        root = {i: {i} for i in range(len(sets))}
        for a, b in links:
            root[a] |= root[b]
            for i in root[b]:
                root[i] = root[a]
        return {frozenset(g) for g in root.values()}

    pairs = [(i, j) for i, j in combinations(range(len(sets)), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    links = simhash._like(list(range(len(sets))), sets)
    assert groups(links) == groups(pairs) and len(links) < len(sets)
    known = [0 if i in min(groups(pairs), key=lambda g: -len(g)) else i + 1 for i in range(len(sets))]
    rest = simhash._like(list(range(len(sets))), sets, known)
    same = [(i, j) for i, j in combinations(range(len(sets)), 2) if known[i] == known[j]]
    assert groups(rest + same) == groups(pairs)


@pytest.mark.parametrize("size", [1, 7, 5000])
def test_blocks_of_buckets_read_in_batches_of_any_size(size, monkeypatch):
    monkeypatch.setattr(simhash, "MEMBERS", 4)
    rows = sorted((k, n, 100 * k + n, k == 9) for k, m in ((1, 1), (2, 2), (3, 4), (4, 5), (5, 1), (6, 13), (9, 1)) for n in range(m))
    columns = list(zip(*((k, node, n, s, k % 2 == 0) for k, n, node, s in rows)))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + size], t) for c, t in zip(columns, kinds)], names=["key", "node", "n", "split", "early"]) for i in range(0, len(rows), size)]
    got = {}
    for b in simhash._memberships(iter(batches)):
        for key, grp, node, _, whole, early in zip(*(c.to_pylist() for c in b.columns)):
            assert early == (key % 2 == 0)
            got.setdefault((key, grp, whole), []).append(node)
    sizes = sorted((key, whole, len(nodes)) for (key, _, whole), nodes in got.items())
    assert sizes == [(2, True, 2), (3, True, 4), (4, False, 1), (4, False, 4), (6, False, 1), (6, False, 4), (6, False, 4), (6, False, 4), (9, False, 1)]


def test_covering_keys_meet_within_the_radius():
    rng = np.random.default_rng(2)
    least = rng.integers(0, 1 << 62, (1, simhash.GROUPS * simhash._TABLES)).astype(np.uint64)
    one = simhash.covering_keys(least)[0]
    for i, j in combinations(range(simhash._TABLES), 2):
        other = least.copy()
        other[0, [i, j]] += np.uint64(1)
        other[0, simhash._TABLES :] += np.uint64(1)  # the other groups differ everywhere
        assert len(set(one.tolist()) & set(simhash.covering_keys(other)[0].tolist())) == 1


def test_columns_with_clashing_names_and_ties(spark):
    names = ["row", "id", "no_id", "tie", "node", "label", "_own", "_hash", "_id", "stay", "key", "a.b"]
    text = "one two three four five six seven"
    rows = [(1, text, *(f"{n}{k}" for n in names)) for k in (2, 1, 1)] + [(1, "another text with some words in it", *names), (None, text, *names), (None, None, *names), (None, "", *names)]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    df = spark.createDataFrame(rows, schema)
    first, second = (sorted(map(str, simhash.deduplicate(d).collect())) for d in (df, df.repartition(5)))
    assert first == second and len(first) == 3
    got = simhash.deduplicate(df)
    assert got.columns == df.columns
    kept = [tuple(r) for r in got.collect()]
    assert all(k in rows for k in kept) and sorted((r[0] or 0) for r in kept) == [0, 1, 1]
    assert simhash.deduplicate(df.limit(0)).count() == 0


def test_members_of_a_cut_bucket_move_once(spark):
    size = 3000
    wide = spark.createDataFrame([(k, i, 100 + i % 40) for k in (1, 2) for i in range(size)], "key long, node long, n int")
    some = spark.createDataFrame([(i, 0) for i in range(0, size, 2)], "node long, label long")
    rows = simhash._crossing(wide, some, []).collect()
    assert len(rows) == 2 * size and len({r.grp for r in rows}) == 2
    assert all(r.label == (r.node if r.node % 2 else 0) for r in rows)


@pytest.mark.parametrize("salts", [1, 3])
def test_every_pair_of_different_labels_in_a_cut_bucket_meets(spark, salts, monkeypatch):
    monkeypatch.setattr(simhash, "WIDE_MEMBERS", 7)
    monkeypatch.setattr(simhash, "WIDE_SHINGLES", 500)
    wide = spark.createDataFrame([(k, i, 90 + i % 10) for k in (1, 2) for i in range(k * 30)], "key long, node long, n int")
    hot = [(r.bin, salts) for r in wide.select(bin_of(["key"]).alias("bin")).distinct().collect()] if salts > 1 else []
    labels = {i: 0 for i in range(0, 60, 3)}
    groups = {}
    for r in simhash._crossing(wide, spark.createDataFrame(list(labels.items()), "node long, label long"), hot).collect():
        groups.setdefault(r.grp, []).append(r.node)
    met = {p for nodes in groups.values() for p in combinations(sorted(nodes), 2)}
    assert all(len(set(nodes)) == len(nodes) <= 14 for nodes in groups.values())
    assert {p for p in combinations(range(60), 2) if labels.get(p[0], p[0]) != labels.get(p[1], p[1])} <= met


@pytest.mark.parametrize("members", [8, 40])
def test_tiles_as_one_block(members, monkeypatch):
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 1 << 60, 120).astype(np.uint64) for _ in range(3)]
    sets = [np.unique(np.concatenate([base[i % 3][rng.random(120) > cut], rng.integers(0, 1 << 60, int(1 + 60 * cut)).astype(np.uint64)])) for i, cut in enumerate(rng.uniform(0, 0.3, 150))]
    sets += [base[0], base[0][:97], base[0][:60], rng.integers(0, 1 << 60, 90).astype(np.uint64), sets[3]]
    nodes = list(range(len(sets)))

    def groups(links):
        root = {i: {i} for i in nodes}
        for a, b in links:
            root[a] |= root[b]
            for i in root[b]:
                root[i] = root[a]
        return {frozenset(g) for g in root.values()}

    known = [i if i % 5 else 0 for i in nodes]
    same = [(i, j) for i, j in combinations(nodes, 2) if known[i] == known[j]]
    want, want_known = groups(simhash._like(nodes, sets)), groups(simhash._like(nodes, sets, known) + same)
    pairs = [(i, j) for i, j in combinations(nodes, 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    assert want == groups(pairs) and {i for p in pairs for i in p} <= set(simhash._able(sets).tolist()) and len(simhash._able(sets)) < len(sets)
    monkeypatch.setattr(simhash, "MEMBERS", members)
    assert groups(simhash._like(nodes, sets)) == want and groups(simhash._like(nodes, sets, known) + same) == want_known
