"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

Viterbi decoding gives the best labelling of a document's lines; the share of its
words that lie in content lines decides whether the document stays. Weights are
fitted on a bounded sample of labelled documents (TRAIN_DOCS rows of `labels`, those
with the smallest hash of doc_id, whole texts of at most TRAIN_BYTES) that the base rules
let pass; without labelled documents of both kinds the fixed weights of PRIOR are used.
Labels are those of documents, so that states would never change within one; therefore
the lines of good and bad documents are also spliced into sequences that do change, with
the label of the document that a line is from.

Defined results: a null or empty text has no words and fails the base rules; of equal
best labellings the one with more content at its end stands; rows are judged one by
one, so repeated rows get equal verdicts; of labels of one doc_id the greatest counts,
of its texts the one with the smallest hash; very long texts are judged whole, a line at
a time; an empty table gives no rows; columns of the input other than doc_id and text
are ignored by `assess` and kept by `keep_good`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents are fetched to the driver for the fit.
TRAIN_DOCS = 600
#: Longer texts (in bytes) are not fetched; 60 MB together.
TRAIN_BYTES = 100_000
#: At least this share of the words in content lines keeps a document.
CONTENT_SHARE = 0.5
MIN_WORDS, MAX_REPEATED = 50, 50  # words; per cent of words in repeated 3-word windows
SYMBOLS = b"#*$%&|<>"
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"

_SPACE, _UPPER, _DIGIT, _SYMBOL, _SHOUT, _POINT = range(6)
_CLASSES = np.zeros((6, 256), np.uint8)
for _k, _chars in enumerate((b"\x20\x09\x0a\x0b\x0c\x0d", bytes(range(65, 91)), bytes(range(48, 58)), SYMBOLS, b"!?", b".,;:")):
    _CLASSES[_k, list(_chars)] = 1

#: Upper ends of the bins of each measure of a line.
BINS = {
    "symbols": (0.001, 0.02, 0.05, 0.15), "upper": (0.05, 0.15, 0.4), "shouts": (0.001, 0.02, 0.06), "digits": (0.01, 0.1, 0.3),
    "points": (0.001, 0.01, 0.05, 0.15), "words": (1.5, 4.5, 12.5, 40.5), "word_len": (3.0, 5.0, 8.0, 12.0), "repeated": (0.5,),
}
N_FEATURES = sum(len(x) + 1 for x in BINS.values()) + 1


@dataclass(frozen=True)
class Model:
    """emit (feature, state), move (from, to); state 1 is content."""

    emit: np.ndarray
    move: np.ndarray


def _prior() -> Model:
    """Symbols, shouting and repeated lines speak for boilerplate."""
    emit, at = np.zeros((N_FEATURES, 2)), 0
    for name, ends in BINS.items():
        for k in range(len(ends) + 1):
            emit[at + k, 0] = {"symbols": 1.2, "shouts": 0.8, "upper": 0.8, "repeated": 1.0, "digits": 0.5}.get(name, 0.0) * k
        at += len(ends) + 1
    emit[-1, 1] = 2.0
    return Model(emit, np.array([[0.5, -0.5], [-0.5, 0.5]]))


PRIOR = _prior()


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Of the lines with a word: the features that are on (line, measure), and their number of words."""
    data = text.encode("utf-8", "surrogatepass")
    lines = data.split(b"\n")
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.cumsum(size + 1) - size - 1
    raw = np.frombuffer(data + b"\n", np.uint8)
    counts = np.stack([np.add.reduceat(_CLASSES[k][raw], starts, dtype=np.int64) for k in range(6)])
    space = _CLASSES[_SPACE][raw]
    first = space == 0
    first[1:] &= space[:-1] == 1
    words = np.add.reduceat(first, starts, dtype=np.int64)
    has = np.nonzero(words)[0]
    if not len(has):
        return np.zeros((0, len(BINS) + 1), np.int64), np.zeros(0, np.int64)
    seen: set[bytes] = set()
    again = np.array([lines[i] in seen or bool(seen.add(lines[i])) for i in has.tolist()], float)
    solid = np.maximum(1, size[has] - counts[_SPACE][has] + 1)
    share = lambda k: counts[k][has] / solid
    measures = {"symbols": share(_SYMBOL), "upper": share(_UPPER), "shouts": share(_SHOUT), "digits": share(_DIGIT), "points": share(_POINT), "words": words[has], "word_len": solid / words[has], "repeated": again}
    out, at = np.zeros((len(has), len(BINS) + 1), np.int64), 0
    for j, (name, ends) in enumerate(BINS.items()):
        out[:, j] = at + np.searchsorted(ends, measures[name], side="right")
        at += len(ends) + 1
    out[:, -1] = N_FEATURES - 1
    return out, words[has]


def viterbi(model: Model, on: np.ndarray) -> np.ndarray:
    """The best sequence of states; of equally good ones, the one with more content at its end."""
    if not len(on):
        return np.zeros(0, np.int64)
    (a, b), (c, d) = model.move.tolist()
    boiler, content, back = 0.0, 0.0, []
    for k, (x, y) in enumerate(model.emit[on].sum(axis=1).tolist()):
        if k:
            to0, to1 = (boiler + a < content + c), (boiler + b <= content + d)
            boiler, content = (content + c if to0 else boiler + a), (content + d if to1 else boiler + b)
            back.append((to0, to1))
        boiler, content = boiler + x, content + y
    state, states = int(content >= boiler), []
    states.append(state)
    for choice in reversed(back):
        state = int(choice[state])
        states.append(state)
    return np.array(states[::-1])


def spliced(pieces: list[tuple[np.ndarray, int]], seed: int = 42) -> list[tuple[np.ndarray, np.ndarray]]:
    """pieces (features of lines, label) -> each piece, and for each two of different labels one sequence in which runs of their lines take turns."""
    out = [(on, np.full(len(on), label)) for on, label in pieces]
    rng = np.random.default_rng(seed)
    kinds = [[on for on, label in pieces if label == k] for k in (0, 1)]
    for k in range(max(map(len, kinds)) if all(kinds) else 0):
        parts = [(y, kinds[y][k % len(kinds[y])]) for y in (0, 1)]
        on, labels = [], []
        starts = [0, 0]
        turn = int(rng.integers(2))
        while any(starts[y] < len(x) for y, x in parts):
            y, x = parts[turn]
            run = x[starts[y] : starts[y] + int(rng.integers(2, 9))]
            on.append(run)
            labels.append(np.full(len(run), y))
            starts[y] += len(run)
            turn = 1 - turn
        out.append((np.concatenate(on), np.concatenate(labels)))
    return out


def fit(examples: list[tuple[str, int]], steps: int = 120, rate: float = 0.3, l2: float = 1e-3, piece: int = 48) -> Model:
    """Greatest conditional likelihood by gradient ascent (Adam), drawn to PRIOR, which holds for what the sample lacks; a line's label is its document's.

    Documents are cut into pieces of `piece` lines for the forward and backward
    passes; every line counts.
    """
    pieces = []
    for text, label in examples:
        on, _ = line_features(text or "")
        pieces += [(on[start : start + piece], int(bool(label))) for start in range(0, len(on), piece)]
    if len({label for _, label in pieces}) < 2:
        return PRIOR
    seqs, labels = zip(*spliced(pieces))
    n, width = len(seqs), max(map(len, seqs))
    on = np.zeros((n, width, seqs[0].shape[1]), np.int64)
    mask = np.zeros((n, width), bool)
    for i, s in enumerate(seqs):
        on[i, : len(s)], mask[i, : len(s)] = s, True
    y = np.zeros((n, width), np.int64)
    for i, x in enumerate(labels):
        y[i, : len(x)] = x
    share = np.array([(y[mask] == k).mean() for k in (0, 1)])
    weight = np.array([(0.5 / share)[x].mean() for x in labels])  # both kinds count alike
    emit, move = PRIOR.emit.copy(), PRIOR.move.copy()
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in (emit, move)]
    truth = np.stack([y == 0, y == 1], axis=2)
    steps_in = mask[:, 1:]
    moved = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & steps_in).sum(axis=1) @ weight for b in (0, 1)] for a in (0, 1)])
    for step in range(1, steps + 1):
        e = emit[on].sum(axis=2) * mask[:, :, None]
        fwd, bwd = np.zeros((n, width, 2)), np.zeros((n, width, 2))
        fwd[:, 0] = e[:, 0]
        for t in range(1, width):
            nxt = np.logaddexp(fwd[:, t - 1, 0, None] + move[0], fwd[:, t - 1, 1, None] + move[1]) + e[:, t]
            fwd[:, t] = np.where(mask[:, t, None], nxt, fwd[:, t - 1])
        for t in range(width - 2, -1, -1):
            to = bwd[:, t + 1] + e[:, t + 1]
            prv = np.logaddexp(to[:, 0, None] + move[:, 0], to[:, 1, None] + move[:, 1])
            bwd[:, t] = np.where(mask[:, t + 1, None], prv, bwd[:, t + 1])
        total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p = np.exp(fwd + bwd - total[:, None, None]) * mask[:, :, None]
        gap = (truth * mask[:, :, None] - p) * weight[:, None, None]
        g_emit = np.zeros_like(emit)
        for j in range(on.shape[2]):
            for k in (0, 1):
                g_emit[:, k] += np.bincount(on[:, :, j][mask], gap[:, :, k][mask], N_FEATURES)
        pair = fwd[:, :-1, :, None] + move + (e + bwd)[:, 1:, None, :] - total[:, None, None, None]
        expected = (np.exp(np.minimum(pair, 0)) * steps_in[:, :, None, None] * weight[:, None, None, None]).sum(axis=(0, 1))
        g_move = moved - expected
        lines = mask.sum()
        for param, prior, grad, (m, v) in zip((emit, move), (PRIOR.emit, PRIOR.move), (g_emit, g_move), moment):
            grad = grad / lines - l2 * (param - prior)
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            param += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(emit, move)


def trained_model(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fitted on at most `train_docs` labelled documents; the sample depends on their ids only."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("_q")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    # Of at most train_docs ids; the smallest hash picks one of several texts.
    own = docs.where(F.octet_length("text") <= TRAIN_BYTES).select("doc_id", F.struct(F.xxhash64("text").alias("hash"), "text").alias("text"))
    rows = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text.hash").alias("hash"), F.min("text").alias("text"), F.max("_q").alias("_q"))
    rows = rows.select("doc_id", F.col("text.text").alias("text"), "_q").orderBy("doc_id").collect()
    # The base rules see to short and repetitive texts, whose lines may be good prose: they would teach the wrong thing.
    return fit([(r.text or "", int(r["_q"])) for r in rows if not failed(base_counts(r.text or ""))])


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    spaces = len(data) - len(data.translate(None, b"\x20\x09\x0a\x0b\x0c\x0d"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > 2:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, n)
        kinds = np.uint64(len(number))
        if len(number) < 1 << 21:
            key = (ids[:-2] * kinds + ids[1:-1]) * kinds + ids[2:]
        else:  # too many words for one integer: number the pairs first
            pair = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1].astype(np.uint64)
            key = pair[:-1] * kinds + ids[2:]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(n - 2, bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeated = int(covered.sum())
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated


def failed(counts: tuple[int, int, int, int, int]) -> bool:
    """By the base rules."""
    return counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEATED * counts[0]


def judge(model: Model, text: str | None, share: float = CONTENT_SHARE) -> tuple:
    n, chars, symbols, dup, repeated = base_counts(text or "")
    fails = failed((n, chars, symbols, dup, repeated))
    on, words = line_features(text or "")
    content = float((viterbi(model, on) * words).sum() / words.sum()) if len(words) else 0.0
    return n, chars, symbols, dup, repeated, fails, content, not fails and content >= share


def assess(docs: DataFrame, model: Model, share: float = CONTENT_SHARE) -> DataFrame:
    """docs (doc_id, text) -> RESULT, one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(model, x, share) for start in range(0, len(batch), 256) for x in batch.column(1).slice(start, 256).to_pylist()]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=[x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def keep_good(docs: DataFrame, model: Model, share: float = CONTENT_SHARE) -> DataFrame:
    """The documents that pass, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 256):
                batch = whole.slice(start, 256)
                kept = [judge(model, x, share)[-1] for x in batch.column(at).to_pylist()]
                if any(kept):
                    yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
