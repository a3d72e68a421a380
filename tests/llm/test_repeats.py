"""Removal of repeated strings against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from seriesmill.llm import suffix_dedup as sd
from seriesmill.llm.queries import QUERIES


def brute(texts):
    """n_bytes, n_removed, n_spans, kept_sha256 of each text."""
    data = [(t or "").encode() for t in texts]
    where = defaultdict(int)
    for d in data:
        for i in range(len(d) - sd.SPAN + 1):
            where[d[i : i + sd.SPAN]] += 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - sd.SPAN + 1):
            if where[d[i : i + sd.SPAN]] > 1:
                gone[i] += 1
                gone[i + sd.SPAN if i + sd.SPAN <= len(d) else len(d)] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


def random_texts(seed):
    rnd = random.Random(seed)
    prose = lambda n: "".join(rnd.choice("abcdefgh éü\n") for _ in range(n))
    shared = [prose(k) for k in (190, 199, 200, 201, 260, 420, 900)]
    texts = []
    for k in range(60):
        parts = [prose(rnd.randint(0, 300))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            if rnd.random() < 0.5:  # part of it, or with a change
                a = rnd.randint(0, len(s))
                s = s[a:] if rnd.random() < 0.5 else s[:a] + "#" + s[a + 1 :]
            parts += [s, prose(rnd.randint(0, 300))]
        texts.append("".join(parts))
    return [*texts, texts[0], texts[0], None, "", "x", "word " * 300, "ab" * 400, "a" * 700, prose(150) * 3, "é" * 100, "é" * 99, shared[3] + "tail", shared[3]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    texts = random_texts(seed)
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, place string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in sd.repeat_summary(df).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_hot_texts_anchors_and_passages(spark):
    """A third of the rows is one text, a third has one passage amid differing words, all of it hot."""
    rnd = random.Random(11)
    prose = lambda n: "".join(rnd.choice("abcdefgh éü\n") for _ in range(n))
    passage, inner = prose(260), prose(90)
    texts = [prose(700)] * 120 + [prose(rnd.randint(50, 300)) + passage + prose(rnd.randint(50, 300)) for _ in range(120)] + [prose(230) + inner + prose(230) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r[0]: tuple(r)[1:] for r in sd.repeat_summary(df).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = dict(zip((r.doc_id for r in rows), brute([r.text for r in rows])))
    assert {r[0]: tuple(r)[1:] for r in QUERIES["op6_repeats"](spark, sf_dir).collect()} == want


def test_blocks_of_a_long_text(spark, monkeypatch):
    # Anchors of each block still give each start one anchor, at an offset that its SPAN bytes decide.
    rnd = random.Random(9)
    data = bytes(rnd.randrange(97, 101) for _ in range(3000))

    def owned():
        return {p - o: o for block in sd.anchors(data) for p, _, low, high in zip(*(x.tolist() for x in block)) for o in range(low, high + 1)}

    whole = owned()
    monkeypatch.setattr(sd, "BLOCK", 333)
    assert owned() == whole and set(whole) == set(range(len(data) - sd.SPAN + 1))


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_runs_read_in_batches_of_any_size(size):
    rnd = random.Random(size)
    rows = sorted((rnd.randint(0, 40), rnd.randint(0, 3), 7, 8, k, rnd.choice([2, 2, 2, 3])) for k in range(300))
    columns = list(zip(*rows))
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in columns], names=sd._NAMES) for i in range(0, 300, size)]
    got = Counter((p, r) for b in sd._judge(iter(batches)) for p, r in zip(b.column(2).to_pylist(), b.column(3).to_pylist()))
    runs, keys = defaultdict(list), defaultdict(set)
    for key, name, _, _, place, rank in rows:
        runs[key, name].append((place, rank))
        keys[key].add(name)
    twice = {k: len(v) > 1 or v[0][1] == 3 for k, v in runs.items()}
    assert {p for p, r in got if r == 0} == {p for k, v in runs.items() if twice[k] for p, _ in v}
    assert all(n == 1 for n in got.values())
    want = Counter((k, 1 if twice[k] else 2) for k in runs if len(keys[k[0]]) > 1)
    key_of = {p: k for k, v in runs.items() for p, _ in v}
    assert Counter((key_of[p], r) for p, r in got if r) == want


def test_edges(spark):
    df = spark.createDataFrame([(1, "z" * 500, 5)], "doc_id long, text string, text1 int")
    r = sd.remove_repeats(df).first()
    assert r.text == "" and [tuple(s) for s in r.spans] == [(0, 500)]
    assert sd.repeat_summary(df.limit(0)).count() == 0
