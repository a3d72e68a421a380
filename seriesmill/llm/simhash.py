"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits: bit i is set if more than half of the hashed 3-word
shingles of a text have it set. Two fingerprints are linked if at most 2 bits
differ. Bit i belongs to a non-zero vector m(i) of {0,1}^3, and table v (each of
the 7 non-zero vectors) keeps the bits whose m(i) has an odd inner product with v.
Two differing bits span at most a plane, so some v is orthogonal to both, and the
pair shares its key in that table: no pair within the radius is missed
(Pagh, "CoveringLSH", 2016).

`deduplicate`, the pipeline's stage, has a measure of its own, the Jaccard of 5-word
shingles, and the same masks over min-hashes in place of bits (see `similar`).

Defined results: a null or empty text, of any row, has fingerprint zero (no shingles),
linked like any other; equal fingerprints (sets) are one node, so copies are never
expanded into pairs; a null doc_id takes part but names a component only if the
component has no other; repeated rows give repeated rows; ties have no say, as a
component does not depend on an order; a very long text is hashed in parts of
bounded memory, its words are held once; an empty table gives no rows; other columns
of the input are ignored by `near_duplicates` and kept by `deduplicate`, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm.common import columns_of, connected_components, cut, cut_table, hot_bins, join_salted, salts_of, whole_row

RADIUS = 2
SEED = 42
#: Up to this many members, a bucket is compared in one block; beyond it, by probing.
BLOCK = 192
#: `deduplicate`: words in a shingle, the least Jaccard of a link, and groups of as many min-hashes as there are tables.
WORDS, LIKE, GROUPS = 5, 0.8, 6
#: Members of a bucket that are compared in one block: at most so many, with so many shingles together.
MEMBERS, SHINGLES = 256, 4_000_000
#: Members of a cut bucket that go to one task for the rest of its comparisons, in tiles of MEMBERS: at most so many, with so many shingles.
WIDE_MEMBERS, WIDE_SHINGLES = 4096, 1_000_000
_TABLES = 2 ** (RADIUS + 1) - 1
_FLIP, _MULT = np.random.default_rng(SEED).integers(0, 1 << 64, (2, GROUPS * _TABLES), np.uint64) | np.array([[0], [1]], np.uint64)


def bit_masks() -> list[int]:
    """The masks of the 2**(RADIUS + 1) - 1 tables."""
    top = 2 ** (RADIUS + 1)
    vector = [i % (top - 1) + 1 for i in range(64)]
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2) for v in range(1, top)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None) -> int:
    """Of one text, as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z only and splits at ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [b" ".join(words)]
    n = max(1, len(words) - 2)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, 4096):
        part = hashes[start : start + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, texts, becomes their fingerprints; a few texts at a time are Python objects."""
    for batch in batches:
        fps = np.empty(len(batch), np.int64)
        for start in range(0, len(batch), 256):
            texts = batch.column(batch.num_columns - 1).slice(start, 256).to_pylist()
            fps[start : start + len(texts)] = [fingerprint(t) for t in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text_hash, fp."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def _forest(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members (distinct) of one bucket -> links that connect what is within the radius, at most one for each member."""
    m = len(members)
    root = np.arange(m)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def unite(left: np.ndarray, right: np.ndarray) -> None:
        while True:  # only as many steps in Python as there are unions
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up
        for i, j in zip(*(x[root[left] != root[right]].tolist() for x in (left, right))):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)

    if m <= BLOCK:
        left, right = np.nonzero(np.triu(np.bitwise_count(members[:, None] ^ members[None, :]) <= RADIUS, 1))
        unite(left, right)
    else:
        members = np.sort(members)
        varying = int(np.bitwise_or.reduce(members ^ members[0]))
        bits = [1 << i for i in range(64) if varying >> i & 1]
        for flip in [*bits, *(a | b for k, a in enumerate(bits) for b in bits[:k])]:
            other = members ^ np.uint64(flip)
            at = np.minimum(np.searchsorted(members, other), m - 1)
            hit = np.nonzero((members[at] == other) & (members < other))[0]
            unite(hit, at[hit])
    roots = np.fromiter((find(i) for i in range(m)), np.int64, m)
    moved = np.nonzero(roots != np.arange(m))[0]
    return members[moved], members[roots[moved]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (table, key): the links of each bucket."""
    rest: tuple[np.ndarray, ...] = tuple(np.zeros(0, t) for t in ("i4", "i8", "u8"))

    def links(tab: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(tab):
            return
        starts = np.concatenate([[0], np.nonzero((tab[1:] != tab[:-1]) | (key[1:] != key[:-1]))[0] + 1, [len(tab)]])
        left, right = [], []
        for k in np.nonzero(np.diff(starts) > 1)[0]:
            a, b = _forest(fp[starts[k] : starts[k + 1]])
            left.append(a)
            right.append(b)
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view("i8")) for x in (left, right)], names=["a", "b"])

    for batch in batches:
        now = tuple(np.concatenate([old, batch.column(i).to_numpy(zero_copy_only=False).astype(old.dtype)]) for i, old in enumerate(rest))
        if not len(now[0]):
            continue
        last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
        end = int(np.argmax(last))  # the last bucket may go on in the next batch
        yield from links(*(x[:end] for x in now))
        rest = tuple(x[end:] for x in now)
    yield from links(*rest)


def fingerprint_classes(fps: DataFrame) -> DataFrame:
    """fps (doc_id, fp) -> (fp, label, component_id), one row for each distinct fingerprint.

    Copies meet in a partial aggregate before any shuffle. Buckets hold distinct
    fingerprints only: 8 bytes each, compared in a block or by probing all flips of
    1 or 2 of the bits that vary in the bucket, so no list of pairs is ever made.
    """
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    keys = F.explode(F.array(*(F.struct(F.lit(t).alias("tab"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("key")) for t, mask in enumerate(bit_masks())))).alias("k")
    buckets = distinct.select("fp", keys).select("k.tab", "k.key", "fp").repartition("tab", "key").sortWithinPartitions("tab", "key")
    labels = connected_components(buckets.mapInArrow(_links, "a long, b long").distinct())
    return named_classes(distinct, "fp", labels)


def named_classes(distinct: DataFrame, node: str, labels: DataFrame) -> DataFrame:
    """distinct (node, least), labels (node, label) -> node, label, component_id: the least id of all nodes of a label."""
    labels = labels.select(F.col("node").alias("_node"), "label")
    marked = cut(distinct.join(labels, F.col(node) == F.col("_node"), "left").select(node, "least", F.coalesce("label", node).alias("label")))
    named = marked.groupBy("label").agg(F.min("least").alias("component_id"))
    return join_salted(marked, named, ["label"]).select(node, "label", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text_hash, fp, label, component_id: one row for each row of docs."""
    fps = cut(fingerprints(docs))
    return join_salted(fps, fingerprint_classes(fps), ["fp"]).select("doc_id", "text_hash", "fp", "label", "component_id")


def shingles(text: str | bytes | None) -> np.ndarray:
    """Distinct hashes (ascending) of the WORDS-word shingles of one text; a shorter text is one shingle, one without words has none. As bytes it is lower-case already."""
    words = text.split() if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = map(b" ".join, zip(*(words[k:] for k in range(WORDS)))) if len(words) >= WORDS else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, own, repeat(SEED)), np.uint64))


def least_hashes(own: np.ndarray) -> np.ndarray:
    """The min-hashes of a set."""
    least = np.full(len(_MULT), np.iinfo(np.uint64).max)
    for start in range(0, len(own), 1024):
        x = (own[None, start : start + 1024] ^ _FLIP[:, None]) * _MULT[:, None]
        x = (x ^ (x >> np.uint64(29))) * _MULT[::-1, None]
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=1))
    return least


def covering_keys(least: np.ndarray) -> np.ndarray:
    """(rows, min-hashes) -> (rows, keys): in each group of _TABLES min-hashes, a key for each table, of the coordinates that its mask keeps."""
    masks, out = bit_masks(), np.zeros((len(least), GROUPS * _TABLES), np.uint64)
    coordinates = least.reshape(len(least), GROUPS, _TABLES)
    for t, mask in enumerate(masks):
        for g in range(GROUPS):
            key = np.full(len(least), g * _TABLES + t + 1, np.uint64)
            for i in range(_TABLES):
                if mask >> i & 1:
                    key = (key ^ coordinates[:, g, i]) * _MULT[0]
                    key ^= key >> np.uint64(31)
            out[:, g * _TABLES + t] = key
    return out.view("i8")


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_ROW, text) -> _ROW, node (of the set of shingles), n (its size), keys."""
    names = [*_ROW, "node", "n", "keys"]
    for batch in batches:
        for start in range(0, len(batch), 256):
            part = batch.slice(start, 256)
            sets = [shingles(t) for t in part.column(4).to_pylist()]
            node = pa.array([signed(xxhash.xxh64_intdigest(s.tobytes())) for s in sets], pa.int64())
            keys = covering_keys(np.array([least_hashes(s) for s in sets], np.uint64))
            has = np.array([len(s) > 0 for s in sets])
            offsets = np.concatenate([[0], np.cumsum(has) * keys.shape[1]]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[has].ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[:4], node, pa.array([len(s) for s in sets], pa.int32()), listed], names=names)


def _memberships(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, n, split, early) sorted by key -> key, grp, node, n, whole, early.

    A bucket with two nodes or more is cut in blocks of bounded size, in the order of
    the rows; equal blocks of several tables have the same grp. whole: the block is
    all of its bucket. One block at a time is held.
    """
    held: list[tuple[int, int]] = []
    now, room, cut_before, split_now, early_now = None, 0, False, False, False

    def block(more: bool) -> Iterator[pa.RecordBatch]:
        """more: the bucket goes on."""
        whole = not (more or cut_before or split_now)
        if len(held) > 1 or (held and not whole):
            nodes = np.array([x for x, _ in held], np.int64)
            grp = signed(xxhash.xxh64_intdigest(np.sort(nodes).tobytes()))
            columns = [np.full(len(held), now, np.int64), np.full(len(held), grp, np.int64), nodes, np.array([n for _, n in held], np.int32), np.full(len(held), whole), np.full(len(held), early_now)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "grp", "node", "n", "whole", "early"])

    for batch in batches:
        key, node, n, split, early = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        alone = np.ones(len(key), bool)  # a bucket of one node, not split, has nothing to say
        if len(key) > 2:
            alone[1:-1] = (key[1:-1] != key[:-2]) & (key[1:-1] != key[2:])
        alone[[0, -1]] = False
        for k, x, size, s, e in zip(*(c[~(alone & ~split)].tolist() for c in (key, node, n, split, early))):
            if k != now:
                yield from block(False)
                held, now, room, cut_before, split_now, early_now = [], k, 0, False, s, e
            elif len(held) >= MEMBERS or room + size > SHINGLES:
                yield from block(True)
                held, room, cut_before = [], 0, True
            held.append((x, size))
            room += size
    yield from block(False)


def alike(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Which pairs of sets have a Jaccard of LIKE or more: common shingles are counted by products of 0-1 matrices of `width` shingles."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner, flat = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner, flat = owner[order], flat[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
    count = np.diff(np.append(np.nonzero(first)[0], len(flat)))
    several = np.repeat(count > 1, count)  # a shingle of one set adds nothing
    owner, column = owner[several], np.cumsum(first[several]) - 1
    common = np.zeros((len(sets), len(sets)))
    ends = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + width + 1, width))
    for k, (start, end) in enumerate(zip(ends, ends[1:])):
        part = np.zeros((len(sets), width), np.float32)
        part[owner[start:end], column[start:end] - k * width] = 1
        common += part @ part.T
    return common * (1 + LIKE) >= LIKE * (sizes[:, None] + sizes[None, :]) - 1e-6


def _like(nodes: list[int], sets: list[np.ndarray], known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect the members of one block that are alike, at most one for each member; those of one known label are connected already."""
    if len(sets) > MEMBERS:
        return _like_tiled(nodes, sets, nodes if known is None else known)
    near, label = alike(sets), np.array(nodes if known is None else known, np.int64)
    near |= label[:, None] == label[None, :]
    seen, links = np.zeros(len(sets), bool), []
    for i in range(len(sets)):
        if seen[i]:
            continue
        seen[i], open_ = True, [i]
        while open_:
            u = open_.pop()
            for v in np.nonzero(near[u] & ~seen)[0].tolist():
                seen[v] = True
                open_.append(v)
                if label[u] != label[v]:
                    links.append((nodes[u], nodes[v]))
    return links


def _able(sets: list[np.ndarray]) -> np.ndarray:
    """The places of the sets that may be alike to another one here: only shingles of several sets can be common, and no set is smaller than the least."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.bincount(np.repeat(np.arange(len(sets)), sizes)[count[which] > 1], minlength=len(sets))
    return np.nonzero(shared >= LIKE * (sizes + np.maximum(sizes.min(), shared) - shared) - 1e-6)[0]


def _like_tiled(nodes: list[int], sets: list[np.ndarray], known: list[int]) -> list[tuple[int, int]]:
    """`_like` for many members: every two tiles of MEMBERS / 2, but for those of one label, which links so far add to."""
    label, half, links = np.array(known, np.int64), MEMBERS // 2, []
    able = _able(sets)
    able = able[np.argsort(label[able], kind="stable")]
    tiles = [able[k : k + half] for k in range(0, len(able), half)]
    for a, b in combinations(tiles, 2) if len(tiles) > 1 else ((t, t[:0]) for t in tiles):
        both = np.concatenate([a, b])
        if (label[both] == label[both[0]]).all():
            continue
        place = {nodes[i]: i for i in both}
        for u, v in _like([nodes[i] for i in both], [sets[i] for i in both], label[both].tolist()):
            links.append((u, v))
            label[label == label[place[v]]] = label[place[u]]
    return links


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, node, label, packed text) sorted by grp: the links of each group. One group, of bounded size, at a time is held."""
    now, nodes, sets, known = None, [], [], []
    opener = zstandard.ZstdDecompressor()

    def close() -> Iterator[pa.RecordBatch]:
        if len(nodes) > 1 and (found := _like(nodes, sets, known)):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for grp, node, label, text in zip(*(c.to_pylist() if k < 3 else c for k, c in enumerate(batch.columns))):
            if grp != now:
                yield from close()
                now, nodes, sets, known = grp, [], [], []
            nodes.append(node)
            known.append(label)
            sets.append(shingles(opener.decompress(text.as_buffer())))
    yield from close()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, texts, lower-cased and compressed: they move between executors."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for start in range(0, len(batch), 1024):
            part = batch.slice(start, 1024)
            packed = pa.array([packer.compress(bytes(x.as_buffer()).lower()) if x.is_valid else packer.compress(b"") for x in part.column(part.num_columns - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], packed], names=part.schema.names)


def _links_of(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """groups (grp, node, label), texts (node, packed) -> links (a, b)."""
    rows = groups.join(texts, "node").select("grp", "node", "label", "packed").repartition("grp").sortWithinPartitions("grp")
    return rows.mapInArrow(_verified, "a long, b long")


def _crossing(wide: DataFrame, labels: DataFrame, hot: list[tuple[int, int]]) -> DataFrame:
    """Of buckets that were cut: what is left to compare -> grp, node, label.

    The members of a bucket are dealt anew, in order of their labels, into blocks for one
    task each, so one row for each member as long as they fit in one. Blocks with
    different labels are compared within, and pairs of them where their labels differ
    and their sizes let them be alike. hot: the bins of keys that are spread.
    """
    salts = salts_of(["key"], hot)
    marked = wide.join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"), F.pmod("node", salts).alias("salt"))
    order = Window.partitionBy("key", "salt").orderBy("label", "n", "node")
    place, room = F.row_number().over(order) - 1, F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    grp = F.xxhash64("key", "salt", F.floor(place / WIDE_MEMBERS), F.floor(room / WIDE_SHINGLES))
    marked = cut(marked.select("key", grp.alias("grp"), "node", "n", "label"))
    blocks = marked.groupBy("key", "grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("first"), F.max("label").alias("last"))
    inner = blocks.where("first <> last").select(F.col("grp").alias("both"), "grp")
    left, right = (blocks.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("grp", "low", "high", "first", "last"))) for s in "ab")
    apart = ~((F.col("first_a") == F.col("last_a")) & (F.col("first_b") == F.col("last_b")) & (F.col("first_a") == F.col("first_b")))
    near = (F.col("high_a") >= F.col("low_b") * LIKE - 1e-9) & (F.col("high_b") >= F.col("low_a") * LIKE - 1e-9)
    pairs = left.join(right, "key").where((F.col("grp_a") < F.col("grp_b")) & apart & near).select(F.xxhash64("grp_a", "grp_b").alias("both"), F.explode(F.array("grp_a", "grp_b")).alias("grp")).unionByName(inner)
    return pairs.join(marked.select("grp", "node", "label"), "grp").select(F.col("both").alias("grp"), "node", "label")


#: What names a row: its doc_id, with null told apart, its text and its other columns, both as hashes.
_ROW = ["id", "no_id", "text_hash", "tie"]


def _keyed(docs: DataFrame) -> list[Column]:
    """The columns of _ROW."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    tie = F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0).cast("long")
    doc_id = F.col("doc_id").cast("long")
    return [F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("no_id"), F.xxhash64("text").alias("text_hash"), tie.alias("tie")]


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs -> rows (_ROW, doc_id, node, ...), classes (node, label, component_id)."""
    keyed = docs.select(*_keyed(docs), "text")
    marked = cut_table(keyed.mapInArrow(_nodes, "id long, no_id boolean, text_hash long, tie long, node long, n int, keys array<long>"))
    marked = marked.withColumn("doc_id", F.when(~F.col("no_id"), F.col("id")))
    distinct = cut_table(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct(*_ROW)).alias("chosen"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys")))
    # Of buckets that are cut only those of the first group of tables are compared at once: they mostly settle the rest.
    buckets = distinct.select(F.posexplode("keys").alias("table", "key"), "node", "n").select("key", "node", "n", (F.col("table") < _TABLES).alias("early"))
    hot = hot_bins(buckets, ["key"])
    salts = salts_of(["key"], hot)
    dealt = buckets.select("key", "node", "n", (salts > 1).alias("split"), "early", F.pmod("node", salts).alias("salt")).repartition("key", "salt").sortWithinPartitions("key", "salt", "n", "node")
    blocks = cut_table(dealt.select("key", "node", "n", "split", "early").mapInArrow(_memberships, "key long, grp long, node long, n int, whole boolean, early boolean"))
    # The text of each node that shares a bucket: that of one row.
    needed = blocks.select("node").distinct().join(distinct.select("node", "chosen"), "node").select("chosen.*", F.col("node").alias("wanted"))
    texts = keyed.select(*_ROW, F.col("text").cast("binary").alias("packed")).mapInArrow(_pack, "id long, no_id boolean, text_hash long, tie long, packed binary")
    texts = join_salted(texts, needed, _ROW, hot=hot_bins(marked, _ROW)).dropDuplicates(_ROW)
    texts = cut_table(texts.select(F.col("wanted").alias("node"), "packed"))
    links = cut(_links_of(blocks.where("whole OR early").select("grp", "node", F.col("node").alias("label")).distinct(), texts).distinct())
    labels = connected_components(links)
    wide = blocks.where("NOT whole").select("key", "node", "n")
    if not wide.isEmpty():
        more = _links_of(_crossing(wide, labels, hot), texts)
        labels = connected_components(links.unionByName(more).distinct())
    return marked.select(*_ROW, "doc_id", "node"), named_classes(distinct, "node", labels)


def similar(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text_hash, node, label, component_id: groups linked by a Jaccard of LIKE or more of WORDS-word shingles.

    A fingerprint of 64 majority bits can't tell a Jaccard of 0.8: such pairs differ in
    9.7 bits on average and the covering for all of them has 2**19 tables (README). So a
    coordinate is a min-hash instead of a bit, and the same masks give _TABLES tables
    over each of GROUPS groups of _TABLES min-hashes: a pair that differs in RADIUS or
    fewer of a group's coordinates shares a bucket for sure. At 0.8 exactly no group is
    so close, nor lucky beyond it, with probability 4e-6. Candidates are then checked on
    the whole sets: in blocks of a bucket first, and all members of a bucket that was cut
    as far as they are not of one component yet.
    """
    rows, classes = _classes(docs)
    return join_salted(rows, classes, ["node"]).select("doc_id", "text_hash", "node", "label", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group of `similar` stays, the one with the smallest doc_id; all columns of docs are kept.

    Of several texts with that doc_id the one with the smallest node stays, of rows that
    differ in other columns only the one whose columns have the smallest hash, of
    repeated rows one.
    """
    rows, classes = _classes(docs)
    own = join_salted(rows, classes, ["node"]).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = own.groupBy("label").agg(F.min(F.struct("node", *_ROW)).alias("stay")).select(*(F.col(f"stay.{c}") for c in _ROW))
    whole = docs.select(*_keyed(docs), whole_row(docs).alias("row"))
    return join_salted(whole, cut(stay), _ROW, hot=hot_bins(rows, _ROW)).dropDuplicates(_ROW).select(*columns_of(docs))
