"""Removal of every byte that a repeated SPAN-byte string covers.

A difference-cover suffix sort orders a sample of positions such that any two suffixes
have a common offset at which both are sampled, names the sampled strings, recurses on
the names, places the remaining suffixes by their nearest sampled position, and
compares neighbours. Only strings of SPAN bytes matter here, and equal ones, so the
sample is chosen by content (a string synchronising set, the difference cover of
Kempa and Kociumaka, 2019) and names stand for equality instead of order:

1. sample: in each SPAN-byte string the K bytes with the least hash are its anchor,
   the leftmost of equals. Equal strings have it at the same offset, so each start
   belongs to one anchor, each anchor to a run of starts, one anchor in ~93 bytes.
2. names: the bytes that an anchor's starts span get a name (64 bits of xxh3, under
   its K bytes' 64). A name met twice covers all its starts; copies in one task meet
   before the shuffle. An anchor whose K bytes are alone needs nothing more. The rows
   of a hot key are dealt by key and name, and then count as if its names were several.
3. recursion: of the rest, starts are split into cells of CELL offsets. The bytes that
   every string of a cell shares are the key: alone, the cell is done; else the bytes
   they span are named as before.
4. remaining suffixes: the cells left are taken start by start, the strings of SPAN
   bytes compared among their neighbours.

Each step sorts rows by key and name and reads runs with constant memory. A text is
known by its hash, so equal texts need no special care and equal rows get equal
results. Whole texts are read; documents never join. README tells why plain triples
over all bytes are not sorted, with figures.

Strings are equal if a 64-bit hash of their shared bytes and a second one of all their
bytes are: two of n different strings are taken for one with a probability of about
n * n / 2**129, and texts by 96 bits. Bytes are not compared.

Defined results: a null text counts as empty; a text of fewer than SPAN bytes loses
nothing; repeated rows are repeated texts and lose all they can; ties have no say, as
every occurrence of a string goes; a very long text is scanned in blocks that overlap by
a string, its bytes are held once; an empty table gives no rows; columns of the input
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import cut_table, hot_bins, join_salted, salts_of

SPAN, K, CELL = 200, 16, 16
#: Starts of a text that are scanned at a time, and names that a task combines before it lets them go.
BLOCK, COMBINED = 1 << 20, 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_W = SPAN - K + 1  # anchors lie 0 to _W - 1 bytes after their starts


def _digest(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX


def anchors(data: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (place, 64-bit hash of the K bytes, least and greatest offset of its starts)."""
    for begin in range(0, len(data) - SPAN + 1, BLOCK):
        raw = np.frombuffer(data, np.uint8, offset=begin, count=min(BLOCK + SPAN - 1, len(data) - begin)).astype(np.uint64)
        for width in (1, 2, 4):
            raw = raw[:-width] | (raw[width:] << np.uint64(8 * width))
        gram = _mixed(_mixed(raw[:-8]) ^ raw[8:])
        starts = len(gram) - _W + 1
        # The least in each window of _W, the leftmost of equals: places below the hash's upper bits.
        key = (gram & ~np.uint64((1 << 22) - 1)) | np.arange(len(gram), dtype=np.uint64)
        least, width = key, 1
        while 2 * width <= _W:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:starts], least[_W - width : _W - width + starts])
        at = (least & np.uint64((1 << 22) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(at[1:] != at[:-1])[0] + 1])
        last = np.concatenate([first[1:], [starts]]) - 1
        place = at[first]
        yield place + begin, gram[place], place - last, place - first


def _pack(place: int, low: int, high: int) -> int:
    return place << 16 | low << 8 | high


def _unpack(where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return where >> 16, where >> 8 & 255, where & 255


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(np.asarray(x)) for x in columns], names=names)


ROW = "key long, name long, text1 long, text2 long, place long, rank int"
_NAMES = ["key", "name", "text1", "text2", "place", "rank"]
#: Added to a rank: the row's key may be split among tasks.
_SPLIT = 8
# rank: 0 covered, 1 a partner for others only, 2 to be decided, 3 to be decided, of a name met twice already.
JUDGED = "text1 long, text2 long, place long, rank int"


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with their names. Of a name that a task meets twice, the second row or the first says so, and all later ones are settled."""
    seen: dict[tuple[int, int], int] = {}  # place among the rows not sent yet, SENT, or TWICE
    sent, twice = -1, -2
    for whole in batches:
        for start in range(0, len(whole), 512):
            batch = whole.slice(start, 512)
            out: list[list] = []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = text.as_buffer().to_pybytes()
                for places, grams, lows, highs in anchors(data):
                    for place, gram, low, high in zip(places.tolist(), grams.view("i8").tolist(), lows.tolist(), highs.tolist()):
                        name = _digest(data[place - high : place - low + SPAN]) ^ (low << 8 | high)
                        name = name - (1 << 64) if name >> 63 else name
                        row = [gram, name, a, b, _pack(place, low, high), 2]
                        old = seen.get((gram, name))
                        if old is None:
                            seen[gram, name] = len(out)
                        elif old == sent:
                            row[5] = 3
                            seen[gram, name] = twice
                        else:
                            if old >= 0:
                                out[old][5] = 3
                                seen[gram, name] = twice
                            row[0], row[5] = name ^ a ^ row[4], 0  # any key will do, so that these rows spread
                        out.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int32() if k == 5 else pa.int64()) for k in range(6)], names=_NAMES)
            if len(seen) > COMBINED:
                seen.clear()
            for key in [(r[0], r[1]) for r in out if r[5] == 2]:
                if seen.get(key, twice) >= 0:
                    seen[key] = sent


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and name -> text1, text2, place, rank: those covered (0), and those to split further: undecided (2) and, one for each name met twice, partners (1).

    A name is met twice if it has two rows or one that says so; a key with one name
    needs no split, unless it is a hot one, of which other tasks may have more. Between batches the rows of one name are kept, at most two.
    """
    rest = tuple(np.zeros(0, "i8") for _ in _NAMES)
    before = None  # the key of the last name that is done

    def told(rows: tuple[np.ndarray, ...], which: np.ndarray, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(which):
            yield _batch(_NAMES[2:], *(c[which] for c in rows[2:5]), rank.astype("i4"))

    def judge(rows: tuple[np.ndarray, ...], more: int) -> Iterator[pa.RecordBatch]:
        """more: 1 if the last name may go on, which is then left to the next batch."""
        nonlocal rest, before
        key, name, n = rows[0], rows[1], len(rows[0])
        first = np.concatenate([[0], np.nonzero((key[1:] != key[:-1]) | (name[1:] != name[:-1]))[0] + 1])
        size = np.diff(np.append(first, n))
        twice = (size > 1) | (np.maximum.reduceat(rows[5] & 3, first) == 3)
        done = len(first) - more
        end = first[done] if more else n
        covered = np.nonzero(np.repeat(twice, size)[:end])[0]
        yield from told(rows, covered, np.zeros(len(covered)))
        k = key[first]
        same = np.concatenate([[before is not None and k[0] == before], k[1:] == k[:-1], [False]])
        split = np.nonzero((same[:-1] | same[1:] | (rows[5][first] >= _SPLIT))[:done])[0]
        yield from told(rows, first[split], np.where(twice[split], 1, 2))
        if done:
            before = k[done - 1]
        rest = tuple(c[end:] for c in rows)
        if len(rest[0]) > 2:  # met twice already: all but one can go
            yield from told(rest, np.arange(1, len(rest[0])), np.zeros(len(rest[0]) - 1))
            rest = (*(c[:1] for c in rest[:5]), rest[5][:1] | 3)

    for batch in batches:
        now = tuple(batch.column(i).to_numpy(zero_copy_only=False).astype("i8") for i in range(len(_NAMES)))
        settled = now[5] & 3 == 0
        yield from told(now, np.nonzero(settled)[0], np.zeros(settled.sum()))
        now = tuple(np.concatenate([old, c[~settled]]) for old, c in zip(rest, now))
        if len(now[0]):
            yield from judge(now, 1)
    if len(rest[0]):
        yield from judge(rest, 0)


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, texts, compressed: they move between executors."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = pa.array([packer.compress(x.as_buffer()) if x.is_valid and len(x.as_buffer()) else b"" for x in batch.column(batch.num_columns - 1)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=batch.schema.names)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text1, text2, text, places, ranks) -> an anchor's own bytes. Of equal texts that follow each other the first will do."""
    last, opener = None, zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for a, b, text, places, ranks in zip(*(c.to_pylist() if i != 2 else c for i, c in enumerate(batch.columns))):
            if (a, b) == last:
                continue
            last = a, b
            data = opener.decompress(text.as_buffer())
            for where, rank in zip(places, ranks):
                place, low, high = where >> 16, where >> 8 & 255, where & 255
                out.append((a, b, where, rank, data[place - high : place - low + SPAN]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["text1", "text2", "place", "rank", "own"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of each anchor: keyed by the bytes that all strings of the cell share, named by those that they span."""
    seen: dict[tuple[int, int], int] = {}
    for batch in batches:
        out = []
        for a, b, where, rank, own in zip(*(c.to_pylist() for c in batch.columns)):
            place, low, high = where >> 16, where >> 8 & 255, where & 255
            for cell in range(low // CELL, high // CELL + 1):
                lo, hi = max(low, cell * CELL), min(high, cell * CELL + CELL - 1)
                # own begins at place - high. All strings of the whole cell lie around the same bytes.
                shared = own[high - cell * CELL : high - (cell * CELL + CELL - 1) + SPAN]
                span = own[high - hi : high - lo + SPAN]
                out.append((_digest(shared) ^ cell, _digest(span) ^ (lo << 8 | hi), a, b, _pack(place, lo, hi), 3 if rank == 1 else 2))
        yield from _signed(_combined(out, seen))


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text1, text2, whole place, own, places, ranks) -> the single starts of the cells, keyed and named by their SPAN bytes."""
    seen: dict[tuple[int, int], int] = {}
    for batch in batches:
        out = []
        for a, b, whole, own, places, ranks in zip(*(c.to_pylist() for c in batch.columns)):
            high = whole & 255
            for where, rank in zip(places, ranks):
                place, lo, hi = where >> 16, where >> 8 & 255, where & 255
                for offset in range(lo, hi + 1):
                    string = own[high - offset : high - offset + SPAN]
                    out.append((_digest(string), xxhash.xxh3_64_intdigest(string, 1), a, b, _pack(place, offset, offset), 3 if rank == 1 else 2))
        yield from _signed(_combined(out, seen))


def _combined(rows: list[tuple], seen: dict[tuple[int, int], int]) -> Iterator[tuple]:
    """Of a name that the task meets again the second row says so, and all later ones are settled and spread by any key."""
    if len(seen) > COMBINED:
        seen.clear()
    for key, name, a, b, where, rank in rows:
        n = seen.get((key, name), 0)
        if n < 2:
            seen[key, name] = n + 1
            yield key, name, a, b, where, 3 if n else rank
        else:
            yield (name ^ a ^ where) & (1 << 64) - 1, name, a, b, where, 0


def _signed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    if out := list(rows):
        two = [np.array([r[k] for r in out], "u8").view("i8") for k in (0, 1)]
        yield _batch(_NAMES, *two, *(np.array([r[k] for r in out], "i8") for k in (2, 3, 4)), np.array([r[5] for r in out], "i4"))


def _judged(rows: DataFrame, probe: DataFrame | None = None) -> DataFrame:
    """Rows that only say they are settled have spread keys of their own; those of a hot key spread by name.

    probe: rows of a sample, that tell which keys are hot; results don't depend on it.
    """
    salts = salts_of(["key"], hot_bins(probe, ["key"]) if probe is not None else [])
    dealt = rows.withColumn("salts", salts).withColumn("salt", F.pmod("name", "salts"))
    dealt = dealt.withColumn("rank", F.when((F.col("salts") > 1) & (F.col("rank") > 0), F.col("rank") + _SPLIT).otherwise(F.col("rank")))
    return dealt.repartition("key", "salt").sortWithinPartitions("key", "name").select(*_NAMES).mapInArrow(_judge, JUDGED)


def text_key(text: Column) -> list[Column]:
    """A text's 96 bits, as columns text1 and text2."""
    return [F.xxhash64(text).alias("text1"), F.crc32(text).alias("text2")]


def packed(texts: DataFrame) -> DataFrame:
    return texts.mapInArrow(_pack_texts, texts.schema)


#: The share of the texts (anchors) that tells which keys are hot.
_PROBE = 0.05


def covered_starts(texts: DataFrame, hot: list[tuple[int, int]]) -> DataFrame:
    """texts (text1, text2, text binary) -> text1, text2, place: packed runs of starts whose SPAN bytes are found elsewhere. hot: the hot bins of text1, text2."""
    long = texts.where(F.octet_length("text") >= SPAN).select("text1", "text2", "text")
    place = ["text1", "text2", "place"]
    names = cut_table(_judged(long.mapInArrow(_sample, ROW), long.sample(_PROBE, seed=1).mapInArrow(_sample, ROW)))
    found = names.where("rank = 0").select(*place)
    # A text with several rows has each anchor several times; its bytes are wanted once.
    wanted = names.where("rank > 0").groupBy(*place).agg(F.max("rank").alias("rank")).groupBy("text1", "text2").agg(F.collect_list("place").alias("places"), F.collect_list("rank").alias("ranks"))
    own = join_salted(packed(long), wanted, ["text1", "text2"], hot=hot).select("text1", "text2", "text", "places", "ranks").mapInArrow(_regions, "text1 long, text2 long, place long, rank int, own binary")
    own = cut_table(own.dropDuplicates(place))
    cells = cut_table(_judged(own.mapInArrow(_cells, ROW), own.sample(_PROBE, seed=1).mapInArrow(_cells, ROW)))
    found = found.unionByName(cells.where("rank = 0").select(*place))
    anchor = F.shiftright("place", 16)
    left = cells.where("rank > 0").groupBy("text1", "text2", anchor.alias("at")).agg(F.collect_list("place").alias("places"), F.collect_list("rank").alias("ranks"))
    whole = own.select("text1", "text2", anchor.alias("at"), F.col("place").alias("whole"), "own")
    # Where a block of starts ends, two runs of starts may have one anchor: each takes the cells of its own.
    inside = F.filter(F.arrays_zip("places", "ranks"), lambda x: (F.shiftright(x["places"], 8).bitwiseAND(F.lit(255)) >= F.shiftright("whole", 8).bitwiseAND(F.lit(255))) & (x["places"].bitwiseAND(F.lit(255)) <= F.col("whole").bitwiseAND(F.lit(255))))
    each = whole.join(left, ["text1", "text2", "at"]).select("text1", "text2", "whole", "own", inside.alias("in")).select("text1", "text2", "whole", "own", F.col("in.places"), F.col("in.ranks"))
    singles = cut_table(_judged(each.mapInArrow(_starts, ROW)).where("rank = 0"))
    return found.unionByName(singles.select(*place))


def removed_runs(size: int, places: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings at the packed starts cover."""
    at, low, high = _unpack(np.asarray(places, np.int64))
    runs = np.unique(np.stack([at - high, at - low + SPAN], axis=1), axis=0)
    if not len(runs):
        return []
    end = np.maximum.accumulate(runs[:, 1])
    new = np.concatenate([[True], runs[1:, 0] > end[:-1]])
    firsts = np.nonzero(new)[0]
    return list(zip(runs[firsts, 0].tolist(), end[np.concatenate([firsts[1:] - 1, [len(runs) - 1]])].tolist()))


def _with_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the text packed, text1, text2 and places (null: none)."""
    keyed = docs.select("doc_id", *text_key(F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    hot = hot_bins(keyed.select("text1", "text2"), ["text1", "text2"])
    found = covered_starts(keyed.select("text1", "text2", "text"), hot)
    places = found.groupBy("text1", "text2").agg(F.collect_set("place").alias("places"))
    return join_salted(packed(keyed), places, ["text1", "text2"], "left", hot)


def _mapped(docs: DataFrame, schema: str, make: Callable[[bytes, list[tuple[int, int]]], tuple], kinds: list[pa.DataType]) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for text, places in zip(batch.column(1), batch.column(2)):
                data = opener.decompress(text.as_buffer()) if len(text.as_buffer()) else b""
                rows.append(make(data, removed_runs(len(data), places.values.to_numpy()) if places.is_valid else []))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=names)

    return _with_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "text", "places").mapInArrow(run, schema)


def _kept(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, end in runs:
        out.append(data[at:start])
        at = end
    return b"".join([*out, data[at:]])


def repeat_summary(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def make(data: bytes, runs: list[tuple[int, int]]) -> tuple:
        return len(data), sum(e - s for s, e in runs), len(runs), hashlib.sha256(_kept(data, runs)).hexdigest()

    return _mapped(docs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", make, [pa.int64(), pa.int64(), pa.int64(), pa.string()])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text: what is left, with a cut character's rest replaced by U+FFFD; spans: array of (start, end) in bytes."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def make(data: bytes, runs: list[tuple[int, int]]) -> tuple:
        return _kept(data, runs).decode("utf-8", "replace"), [{"start": s, "end": e} for s, e in runs]

    return _mapped(docs, "doc_id long, text string, spans array<struct<start:bigint,end:bigint>>", make, [pa.string(), kind])
