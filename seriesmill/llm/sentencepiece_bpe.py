"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A symbol sequence is reduced with an agenda of adjacent pairs whose concatenation is
a piece, best score first, leftmost first among equals: the agendas of many short
chunks are arrays that are worked off together, that of a long chunk is a heap whose
stale entries are skipped. Characters without a piece fall back to their bytes.

Where no piece holds a word mark after another character, no merge crosses such a
place, so a text is encoded chunk by chunk (marks, then other characters) and the
result of a short chunk is remembered. In each Arrow batch the ids of every chunk that
the agenda has encoded there, and of the longest text as a whole, and what they decode
to, are checked against the sentencepiece library (check_all: every text); a difference
raises.

Defined results: a null text counts as empty and yields the end id alone; of pairs of
equal score the leftmost merges first; very long texts are encoded whole, very long
chunks by the agenda in O(n log n) and not remembered; repeated rows give repeated rows;
an empty table gives no rows; columns of the input other than doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Chunks of at most so many characters are remembered: the last CHUNKS to 2 * CHUNKS that a worker met.
CHUNK_CHARS, CHUNKS = 40, 300_000
NEVER = 1 << 40
codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Agenda:
    """Encodes texts by merging and remembers the ids of short chunks, as text; odd: those that don't decode to themselves, and to what."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.unchecked: list[tuple[str, list[int], str]] = []
        n = lib.get_piece_size()
        special = [i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)]
        self.byte_id = {int(lib.id_to_piece(i)[3:-1], 16): i for i in range(n) if lib.is_byte(i)}
        skip = {*special, *self.byte_id.values()}
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.id_of = {self.pieces[i]: i for i in range(n) if i not in skip}
        self.score = {p: -lib.get_score(i) for p, i in self.id_of.items()}
        self.of_byte = {i: b for b, i in self.byte_id.items()}
        self.silent = set(special)
        self.end = lib.eos_id()
        self.shown = [" ⁇ " if i == lib.unk_id() else "" if i in self.silent else p if i not in self.of_byte else chr(self.of_byte[i]) if self.of_byte[i] < 128 else None for i, p in enumerate(self.pieces)]
        self.said = [f" {i}" for i in range(n)]
        if len(self.byte_id) != 256:
            raise ValueError("a vocabulary with byte fallback is needed")
        whole = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id_of)
        self.split = (lambda s: [s]) if whole else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+", re.S).findall
        # Pairs of pieces that join to a piece, by key: their place in the order of scores, and the piece.
        order = {x: k for k, x in enumerate(sorted(set(self.score.values())))}
        pairs = sorted((self.id_of[p[:k]] << 32 | self.id_of[p[k:]], order[self.score[p]], i) for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of)
        self.pair_key, self.pair_rank, self.pair_id = (np.array(c, np.int64) for c in zip(*pairs, (1 << 62, NEVER, -1)))
        self.char_id = np.full(0x110000, -1, np.int64)
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i

    def merged(self, chunks: list[str]) -> list[list[int]]:
        """The agendas of many chunks at once: in each round every chunk merges its best pair, the leftmost of equals."""
        if not chunks:
            return []
        chars = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(chunks)), np.fromiter(map(len, chunks), np.int64, len(chunks)))
        symbol = self.char_id[chars]

        def look(left: np.ndarray, right: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = left << 32 | right
            at = np.searchsorted(self.pair_key, key)
            ok = same & (left >= 0) & (right >= 0) & (self.pair_key[at] == key)
            return np.where(ok, self.pair_rank[at], NEVER), np.where(ok, self.pair_id[at], -1)

        rank, joined = look(symbol, np.append(symbol[1:], -1), np.append(owner[1:] == owner[:-1], False))
        while True:
            first = np.concatenate([[0], np.nonzero(owner[1:] != owner[:-1])[0] + 1])
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(owner)))
            at = np.nonzero((rank == np.repeat(best, sizes)) & (rank < NEVER))[0]
            if not len(at):
                break
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]
            symbol[at] = joined[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one symbol goes before each later one
            symbol, chars, owner, rank, joined = symbol[keep], chars[keep], owner[keep], rank[keep], joined[keep]
            mark = np.zeros(len(symbol), bool)
            mark[at] = mark[at[at > 0] - 1] = True
            touched = np.nonzero(mark)[0]
            nxt = np.minimum(touched + 1, len(symbol) - 1)
            rank[touched], joined[touched] = look(symbol[touched], symbol[nxt], (owner[touched] == owner[nxt]) & (nxt > touched))
        ends = np.append(np.nonzero(owner[1:] != owner[:-1])[0] + 1, len(owner)).tolist()
        ids, codes = symbol.tolist(), chars.tolist()
        out, begin = [], 0
        unknown = set(owner[symbol < 0].tolist())
        for k, end in enumerate(ends):
            own = ids[begin:end]
            if k in unknown:
                own = [x for i, c in zip(own, codes[begin:end]) for x in ([i] if i >= 0 else [self.byte_id[b] for b in chr(c).encode("utf-8", "surrogatepass")])]
            out.append(own)
            begin = end
        return out

    def merged_long(self, chunk: str) -> list[int]:
        """The agenda of one long chunk, as a heap."""
        score = self.score
        symbols: list[str | None] = list(chunk)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, int]] = []

        def propose(i: int, j: int) -> None:
            pair = symbols[i] + symbols[j]
            if pair in score:
                heapq.heappush(agenda, (score[pair], i, j, len(pair)))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if symbols[i] is None or symbols[j] is None or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = None
            nxt = after[i] = after[j]
            if nxt < n:
                before[nxt] = i
                propose(i, nxt)
            if before[i] >= 0:
                propose(before[i], i)
        return [x for s in symbols if s is not None for x in ([self.id_of[s]] if s in self.id_of else [self.byte_id[b] for b in s.encode("utf-8", "surrogatepass")])]

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """Of each text all ids with the end id, in decimal and joined by spaces, and what they decode to."""
        split = [self.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > CHUNKS:
            self.known, self.older = {}, self.known
            self.odd = {c: x for c, x in self.odd.items() if c in self.older}
        known, older = self.known, self.older
        new = []
        for c in set(chain.from_iterable(split)).difference(known):
            if (got := older.get(c)) is not None:
                known[c] = got
            else:
                new.append(c)
        short = [c for c in new if len(c) <= CHUNK_CHARS]
        long = {c: self.merged_long(c) for c in new if len(c) > CHUNK_CHARS}
        said = self.said
        for c, ids in chain(zip(short, self.merged(short)), long.items()):
            known[c] = "".join([said[i] for i in ids])
            if (back := self._shown(ids)) != c:
                self.odd[c] = back
            self.unchecked.append((c, ids, back))
        out = []
        for chunks in split:
            back = "".join(chunks) if not self.odd else "".join([self.odd.get(c, c) for c in chunks])
            out.append(("".join(map(known.__getitem__, chunks))[1:] + f" {self.end}" if chunks else str(self.end), (back[1:] if back.startswith(MARK) else back).replace(MARK, " ")))
        for c in long:
            del known[c]
            self.odd.pop(c, None)
        return out

    def check(self, texts: list[str]) -> None:
        """The chunks encoded since the last call, and these texts, against the library."""
        # No merge crosses the end of a chunk, so that the chunks can be checked as one text.
        chunks = [x for x in self.unchecked if x[0][0] == MARK != x[0][-1]]
        alone = [x for x in self.unchecked if x[0][0] == MARK == x[0][-1]]  # marks alone, of which the next chunk would take some
        self.unchecked.clear()
        for c, ids, _ in alone:
            if self.library.encode("a" + c.replace(MARK, " "), num_threads=1) != self.library.encode("a", num_threads=1) + list(ids):
                raise ValueError(f"the agenda and the sentencepiece library differ on a run of {len(c)} word marks")
        ids = [*chain.from_iterable([ids for _, ids, _ in chunks])]
        if self.library.encode("".join([c for c, _, _ in chunks])[1:].replace(MARK, " "), num_threads=1) != ids:
            raise ValueError(f"the agenda and the sentencepiece library differ on some of {len(chunks)} chunks")
        back = "".join([x for _, _, x in chunks])
        if ids and self.library.decode(ids) != (back[1:] if back.startswith(MARK) else back).replace(MARK, " "):
            raise ValueError(f"the agenda and the sentencepiece library decode some of {len(chunks)} chunks differently")
        for text, (said, decoded) in zip(texts, self.encode(texts)):
            ids = self.library.encode(text, add_eos=True)
            if " ".join(map(str, ids)) != said or self.library.decode(ids) != decoded:
                raise ValueError(f"the agenda and the sentencepiece library differ on a text of {len(text)} characters: {text[:80]!r}")
        self.unchecked.clear()

    def _shown(self, ids: list[int]) -> str:
        """Pieces and characters that ids stand for, with marks; runs of byte pieces become characters."""
        try:
            return "".join([self.shown[i] for i in ids])
        except TypeError:  # a byte that is no character of its own
            pass
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.of_byte:
                run.append(self.of_byte[i])
                continue
            if run:
                out.append(run.decode("utf-8", "each_byte"))
                run.clear()
            out.append(self.shown[i])
        if run:
            out.append(run.decode("utf-8", "each_byte"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The first mark of the text goes, the others become spaces."""
        text = self._shown(ids)
        return (text[1:] if text.startswith(MARK) else text).replace(MARK, " ")


@cache
def agenda_of(model_file: str) -> Agenda:
    """One in each worker process: what it remembers serves all the tasks that the worker gets."""
    return Agenda(model_file)


def encode_texts(docs: DataFrame, model_file: str, keep_ids: bool = False, check_all: bool = False) -> DataFrame:
    """docs (doc_id, text) -> RESULT (and ids array<int>, decoded string with keep_ids), one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = agenda_of(model_file)
        gc.freeze()
        gc.set_threshold(200_000, 100, 1000)  # what is remembered holds no cycles
        for whole in batches:
            for start in range(0, len(whole), 256):
                batch = whole.slice(start, 256)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                rows = agenda.encode(texts)
                agenda.check(texts if check_all else [max(texts, key=len)])
                columns = [
                    batch.column(0), pa.array([said.count(" ") + 1 for said, _ in rows], pa.int64()),
                    *(pa.array([hashlib.sha256(r[k].encode("utf-8", "surrogatepass")).hexdigest() for r in rows], pa.string()) for k in (0, 1)),
                ]
                if keep_ids:
                    columns += [pa.array([[int(i) for i in said.split()] for said, _ in rows], pa.list_(pa.int32())), pa.array([decoded for _, decoded in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT + (", ids array<int>, decoded string" if keep_ids else ""))
