"""The text operators against brute force on the smallest tables, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from seriesmill.llm import quality, sentencepiece_bpe, sharding, simhash, syncmers
from seriesmill.llm.queries import QUERIES, piece_model


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


ODD = [(1, None), (2, ""), (3, "a"), (4, "x y"), (5, "word " * 30000), (5, "word " * 30000), (6, "Zz\tzz\x0b zz  é😀"), (None, "lost and found again here"), (7, "x y"), (8, "\n\n \n")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "tag", 1.5) for i, t in ODD], "doc_id long, text string, fp string, key double")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    nodes = sorted(set(fps.values()))
    group = {f: {f} for f in nodes}
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 2 and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    least = {f: min(d for d, g in fps.items() if g in group[f]) for f in nodes}
    return {d: least[f] for d, f in fps.items()}


def test_simhash(spark, sf_dir, docs):
    fps = {d: plain_fingerprint(t) for d, t in docs.items()}
    comp = plain_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"](spark, sf_dir).collect()}
    assert got == {d: (f"{f:016x}", comp[d]) for d, f in fps.items()}


def test_covering_masks_miss_no_pair():
    masks = simhash.bit_masks()
    flips = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i in range(64) for j in range(i))]
    assert all(any(not f & m for m in masks) for f in flips)


@pytest.mark.parametrize("size", [50, 900])
def test_links_of_a_bucket(size):
    import numpy as np

    rnd = random.Random(size)
    members = list({sum(1 << rnd.randrange(24) for _ in range(3)) for _ in range(size)})
    a, b = simhash._forest(np.array(members, np.uint64))
    assert len(a) < len(members) and all((x ^ y).bit_count() < 64 for x, y in zip(a.tolist(), b.tolist()))
    want = plain_components({x: x for x in members})
    root = {x: x for x in members}
    for _ in members:
        for x, y in zip(a.tolist(), b.tolist()):
            root[x] = root[y] = min(root[x], root[y])
    assert len(set(root.values())) == len(set(want.values()))


def test_simhash_edges(spark, odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].fp == by[2].fp == by[8].fp == 0 and by[8].component_id == 1
    assert by[7].component_id == 4 and by[None].component_id is None
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.deduplicate(odd).collect()
    assert sorted((r.doc_id or 0) for r in kept) == sorted({r.component_id or 0 for r in rows})
    assert kept[0].fp == "tag" and kept[0].key == 1.5


# Quality


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark, sf_dir, docs):
    rows = QUERIES["op8_quality"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(docs[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rnd = np.random.default_rng(1)
    for _ in range(40):
        model = quality.Model(rnd.normal(size=(6, 2)), rnd.normal(size=(2, 2)))
        on = rnd.integers(0, 6, size=(7, 2))
        score = lambda s: sum(model.emit[f].sum(axis=0)[k] for f, k in zip(on, s)) + sum(model.move[a, b] for a, b in zip(s, s[1:]))  # noqa: E731,B023
        assert abs(score(quality.viterbi(model, on)) - max(map(score, itertools.product((0, 1), repeat=7)))) < 1e-9


def test_quality_on_held_out_documents(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = quality.trained_model(docs, labels)
    from pyspark.sql import functions as F

    used = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(quality.TRAIN_DOCS).select("doc_id")
    rows = quality.assess(docs, model).join(labels, "doc_id").join(used, "doc_id", "left_anti").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept"), F.count("*").alias("n")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.99 and kept[0] < 0.05


def test_lines_of_spliced_documents(spark):
    """Viterbi changes state where good and bad lines of documents that the fit has not seen take turns."""
    import numpy as np

    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = quality.trained_model(docs, labels)
    from pyspark.sql import functions as F

    ranked = labels.groupBy("doc_id").agg(F.max("quality").alias("q")).orderBy(F.xxhash64("doc_id"), "doc_id")
    rest = ranked.limit(2000).join(ranked.limit(quality.TRAIN_DOCS).select("doc_id"), "doc_id", "left_anti").join(docs, "doc_id").collect()
    pieces = [(quality.line_features(r.text or "")[0][:40], int(r.q)) for r in rest if not quality.failed(quality.base_counts(r.text or ""))]
    mixed = [(on, y) for on, y in quality.spliced([p for p in pieces if len(p[0]) > 3]) if len(set(y.tolist())) == 2]
    right = np.concatenate([quality.viterbi(model, on) == y for on, y in mixed])
    assert len(mixed) > 100 and right.mean() > 0.9


def test_tied_ids_give_one_model(spark):
    rows = [(k, f"{w} " * 60 + "\n" + " ".join(f"{w}{j}" for j in range(80 + k))) for k in range(20) for w in ("some", "#### |")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    first, second = (quality.trained_model(d, labels) for d in (docs, docs.orderBy(F_desc()).repartition(7)))
    assert (first.emit == second.emit).all() and (first.move == second.move).all()


def F_desc():
    from pyspark.sql import functions as F

    return F.desc("text")


def test_quality_edges(spark, odd, empty):
    model = quality.fit([])
    assert model is quality.PRIOR
    rows = quality.assess(odd, model).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows)
    assert quality.assess(empty, model).count() == 0
    assert quality.keep_good(odd, model).columns == odd.columns


# SentencePiece


def test_sentencepiece(spark, sf_dir, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for r in QUERIES["op3_sentencepiece"](spark, sf_dir).collect():
        ids = lib.encode(docs[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_sentencepiece_on_odd_texts():
    agenda = sentencepiece_bpe.Agenda(piece_model())
    rnd = random.Random(1)
    alphabet = [*" ▁▁  ab\n\t\x00é😀中ﬁ<s>/0<0x41>thexyz� ", "the", " the", "  ", "thetheand" * 3]
    for _ in range(40):
        texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(50)]
        for text, (said, decoded) in zip(texts, agenda.encode(texts)):
            ids = agenda.library.encode(text, add_eos=True)
            assert said == " ".join(map(str, ids))
            assert decoded == agenda.decode(ids) == agenda.library.decode(ids)
        agenda.check(texts)
    long = "thequickbrown" * 3000
    assert agenda.merged([long])[0] == agenda.merged_long(long)
    assert agenda.encode([long])[0][0] == " ".join(map(str, agenda.library.encode(long, add_eos=True)))
    for _ in range(500):
        ids = [rnd.choice([*(3 + x for x in b"a\n\xc3\xa9\xf0\x9f"), 1, 2, 0, 300, 259, 29871]) for _ in range(8)]
        assert agenda.decode(ids) == agenda.library.decode(ids)


def test_sentencepiece_forgets(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "CHUNKS", 3)
    agenda = sentencepiece_bpe.Agenda(piece_model())
    for k in range(30):
        text = f"some {k} words {k % 7} again"
        assert agenda.encode([text, text])[1][0] == " ".join(map(str, agenda.library.encode(text, add_eos=True)))
        assert len(agenda.known) <= 12
        agenda.check([text])


def test_sentencepiece_edges(spark, odd, empty):
    rows = sentencepiece_bpe.encode_texts(odd, piece_model(), keep_ids=True, check_all=True).collect()
    assert len(rows) == len(ODD)
    assert all(r.ids == [2] and r.decoded == "" for r in rows if r.doc_id in (1, 2))
    assert {r.decoded for r in rows} == {t or "" for _, t in ODD}
    assert sentencepiece_bpe.encode_texts(empty, piece_model()).count() == 0


# Sharding


def test_schedule_equals_a_heap_step_for_each_group():
    import heapq

    rnd = random.Random(3)
    for _ in range(50):
        sizes = sorted({rnd.randint(1, 60): rnd.randint(1, 90) for _ in range(8)}.items(), reverse=True)
        heap, want = [(0, s) for s in range(5)], []
        for size, n in sizes:
            given = [0] * 5
            for _ in range(n):
                load, s = heap[0]
                heapq.heapreplace(heap, (load + size, s))
                given[s] += 1
            want.append((size, given))
        assert list(sharding.schedule(sizes, 5)) == want


def test_schedule_of_many_equal_groups_beside_a_giant():
    import time

    began = time.time()
    (_, first), (_, given) = sharding.schedule([(10**13, 1), (2_000, 10**9)], 16)
    assert time.time() - began < 1 and sum(given) == 10**9 and given[first.index(1)] == 0
    assert max(given) - min(g for s, g in enumerate(given) if not first[s]) <= 1


def check_shards(rows, texts):
    shards, home, load = defaultdict(list), {}, Counter()
    for r in rows:
        shards[r.shard].append(r.slot)
        load[r.shard] += r.size
    for text, found in texts.items():
        home[text] = set(found)
    assert all(len(x) == 1 for x in home.values())
    assert all(sorted(x) == list(range(len(x))) for x in shards.values())
    return load


def test_sharding(spark, sf_dir, docs):
    rows = QUERIES["op2_sharding"](spark, sf_dir).collect()
    texts = defaultdict(list)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        texts[docs[r.doc_id]].append(r.shard)
    load = check_shards(rows, texts)
    assert len(rows) == len(docs) and set(load) <= set(range(16))
    groups = sorted((len(v) * (len(t.encode()) + 1) for t, v in texts.items()), reverse=True)
    heap = [0] * 16
    for g in groups:
        heap[heap.index(min(heap))] += g
    assert sorted(load.values()) == sorted(heap)


def test_sharding_edges(spark, odd, empty):
    rows = sharding.assign(odd).collect()
    assert len(rows) == len(ODD)
    texts = defaultdict(list)
    for r in rows:
        texts[(r.text_crc32, r.size)].append(r.shard)
    check_shards(rows, texts)
    assert sharding.assign(empty).count() == 0


# Syncmers


def test_syncmers_depend_on_content_only():
    rnd = random.Random(5)
    body = bytes(rnd.randrange(97, 123) for _ in range(3000))
    places, hashes = syncmers.anchors(body)
    more, hashes2 = syncmers.anchors(b"some other start " + body)
    here, there = dict(zip(places.tolist(), hashes.tolist())), dict(zip((more - 17).tolist(), hashes2.tolist()))
    assert here == {p: h for p, h in there.items() if p >= 0}
    assert 0.09 < len(places) / len(body) < 0.15
    old, syncmers.BLOCK = syncmers.BLOCK, 100
    try:
        assert [x.tolist() for x in syncmers.anchors(body)] == [places.tolist(), hashes.tolist()]
    finally:
        syncmers.BLOCK = old


def plain_closed(data):
    import numpy as np

    word = [int.from_bytes(data[i : i + 8], "little") for i in range(len(data) - 7)]
    h = syncmers._mixed(np.array(word, np.uint64)).tolist()
    return [i for i in range(len(data) - 23) if min(h[i : i + 17]) in (h[i], h[i + 16])]


def test_syncmers_by_definition():
    rnd = random.Random(6)
    data = bytes(rnd.choice(b"abcd ") for _ in range(400))
    assert syncmers.anchors(data)[0].tolist() == plain_closed(data)


def spark_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def check_neighbours(rows, table):
    order = sorted(table, key=lambda x: (x[0] is None, -(x[0] or 0), spark_hash(x[1] or ""), x[1] or ""))
    want = Counter()
    for k, (d, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        other = t[: len(t) - m] + nxt[:m]
        fp = [syncmers.fingerprint(x.encode()) for x in (t, other, nxt)]
        want[d, len(t), hashlib.sha256(other.encode()).hexdigest(), syncmers.shown(fp[0]), syncmers.shown(fp[1]), syncmers.likeness(fp[0], fp[1]), syncmers.likeness(fp[0], fp[2])] += 1
    assert Counter(map(tuple, rows)) == want


def test_syncmer_query(spark, sf_dir, docs):
    rows = QUERIES["op10_syncmers"](spark, sf_dir).collect()
    check_neighbours(rows, list(docs.items()))
    assert sum(r.near_edited for r in rows) / len(rows) > 0.4 > 0.1 > sum(r.near_next for r in rows) / len(rows)


@pytest.mark.parametrize("per_part", [1, 3, 1000])
def test_syncmers_edges(spark, odd, empty, per_part):
    check_neighbours(syncmers.fingerprint_with_neighbours(odd, per_part).collect(), ODD)
    assert syncmers.fingerprint_with_neighbours(empty).count() == 0
    nulls = odd.where("doc_id is null")
    check_neighbours(syncmers.fingerprint_with_neighbours(nulls).collect(), [ODD[7]])


@pytest.mark.parametrize("per_part", [1, 4, 1000])
def test_syncmers_of_hot_ids_and_rows(spark, per_part):
    text = lambda k: " ".join(f"w{k * j % 101}" for j in range(3, 40))
    table = [(k, text(k)) for k in range(30)] + [(7, text(k)) for k in range(40)] + [(None, text(k)) for k in range(20)] + [(9, text(5))] * 25 + [(None, None), (None, "")]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    check_neighbours(syncmers.fingerprint_with_neighbours(df, per_part).collect(), table)


def plain_likeness(a, b):
    """Of whole k-mers, by the textbook's quadratic table over (k-mer, which of its places)."""
    def names(data):
        seen, out = Counter(), []
        for p in plain_closed(data):
            gram = data[p : p + syncmers.K]
            out.append((gram, seen[gram]))
            seen[gram] += 1
        return out or [(data, 0)]

    x, y = names(a), names(b)
    row = [0] * (len(y) + 1)
    for u in x:
        last = 0
        for j, v in enumerate(y):
            last, row[j + 1] = row[j + 1], last + 1 if u == v else max(row[j], row[j + 1])
    return row[-1] / (len(x) + len(y) - row[-1])


@pytest.mark.parametrize("size", [10, 30, 100, 1000, 6000])
def test_likeness_as_by_brute_force(size):
    rnd = random.Random(size)
    prose = lambda n: bytes(rnd.choice(b"abcde fgh") for _ in range(n))
    whole = prose(size)
    half = size // 2
    for other in (whole, whole[half:] + whole[:half], whole[: size - size // 3] + prose(size // 3), prose(7) + whole, (whole[:40] * size)[:size], prose(size)):
        got = syncmers.likeness(syncmers.fingerprint(whole), syncmers.fingerprint(other))
        assert abs(got - plain_likeness(whole, other)) < 1e-3


def test_likeness_of_very_long_texts():
    rng = random.Random(8)
    whole = rng.randbytes(1_000_000)
    parts = {1.0: whole, 0.5: whole[:666_667] + rng.randbytes(333_333), 0.0: rng.randbytes(1_000_000)}
    for want, other in parts.items():
        assert abs(syncmers.likeness(syncmers.fingerprint(whole), syncmers.fingerprint(other)) - want) < 2e-3
