"""Personal data: base rules against Python's re, edge cases, the fits."""

import hashlib
import re

import pytest
from pyspark.sql import functions
from seriesmill.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), list(RULES).index(kind), m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


TEXTS = [
    None, "", "plain words", "a@b.co_d@e.fr x@y a@b@c.de", "x@-.-. é😀 me@mail.example.com.", "1.2.3.4.5.6.7.8 300.1.1.1 0000255.1.1.001 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 123456789012345678901 4111111111111111-", "+1 (743) 555-3824 +49 30 123456 +1-2 +12345678901234567 +1 2 3 4 5 6 7 8 9 0)",
    "😀 +1 (743) 555-3824 or 172.16.254.1, a.b@c.d-e.fr; 5500 0000 0000 0004", "aaaa" * 3000 + "@", "1" * 9000, "a@b.c" * 700,
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" (555) 234-5678 123-45-6789 me (at) mail.example.com',
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_chars int, kind string")


def test_base_rules_as_in_python(spark, frame):
    got = {r.doc_id: [f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.pii_spans if s.base] for r in pii.annotate(frame, [0.0] * 20).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_added_spans_keep_base_and_do_not_overlap(spark, frame):
    rows = pii.annotate(frame).collect()
    for r in rows:
        added = [(s.start, s.end) for s in r.pii_spans if not s.base]
        base = [(s.start, s.end) for s in r.pii_spans if s.base]
        assert all(e <= b or f <= s for s, e in added for b, f in base)
        assert all(a[1] <= b[0] for a, b in zip(added, added[1:]))


def test_documents(spark, sf_dir):
    from seriesmill.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op1_pii"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w.startswith(k + ":") for w in want) for k in RULES)
        assert set(want) <= set(r.spans.split(","))


def test_em_learns_which_labeler_errs():
    # The second labeler contradicts the first and third, which agree.
    patterns = [(0, (1, 0, 1), 80.0), (0, (0, 1, 0), 80.0), (0, (1, 1, 1), 20.0), (0, (0, 0, 0), 20.0)]
    right, _, chance = pii.reliabilities(patterns)
    assert right[0] > 0.9 and right[2] > 0.9 and right[1] < 0.6
    assert chance[0] > 0.9 and chance[1] < 0.1


def test_redaction(spark, frame):
    rows = {r.doc_id: r for r in pii.redact(frame).collect()}
    assert rows[0].text is None and rows[1].text == "" and rows[2].text == "plain words"
    assert rows[8].text.startswith("😀 [PHONE] or [IP], [EMAIL]; [CARD]")
    assert rows[8].n_chars == len(rows[8].text) and rows[8].kind == "x"
    assert set(rows[0].asDict()) == {"doc_id", "text", "n_chars", "kind"}


def test_empty_table(spark, frame):
    assert pii.annotate(frame.limit(0)).count() == 0 and pii.redact(frame.limit(0)).count() == 0


def plain_spans(text, weights):
    """What stands of the candidates by the definition, pair by pair."""
    def score(kind, votes, features):
        return sum(weights[i] for i in pii._on(kind, int(votes[0] == 1), features))

    found = [(c.start, c.kind, c.end, c.base, score(c.kind, c.votes, c.features)) for c in text]
    base = [x[:4] for x in found if x[3]]
    out = []
    for x in sorted(x[:4] for x in found if not x[3] and x[4] > 0):
        if not any(b[0] < x[2] and x[0] < b[2] for b in base) and not any(o[0] < x[2] and x[0] < o[2] for o in out):
            out.append(x)
    return sorted(base + out)


def crowded(seed):
    import random

    rnd = random.Random(seed)
    parts = ["123-45-6789", "(555) 234-5678", "555-234-5678", "1.2.3.4", "a@b.co", "me (at) mail.example.com", "24be64439e3e49cf46b2d7c90f3602a3", "+1 555 234 5678 11", "4111 1111 1111 1111", " ", ", ", "x", "é😀 "]
    return "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 700)))


def test_spans_as_by_definition(spark):
    texts = [*TEXTS, *map(crowded, range(30))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for weights in ([1.0] * 20, [0.5 - 0.1 * k for k in range(20)]):
        rows = df.select(pii.candidates().alias("found")).select("found", pii.spans(functions.col("found"), weights).alias("spans")).collect()
        for r in rows:
            assert [tuple(s) for s in r.spans] == [tuple(x) for x in plain_spans(r.found, weights)]


def plain_redacted(text, found):
    out, pos = [], 0
    for s in found:
        if s.start >= pos:
            out += [text[pos : s.start], f"[{pii.KINDS[s.kind].upper()}]"]
        pos = max(pos, s.end)
    return "".join([*out, text[pos:]])


def test_redaction_as_by_slices(spark):
    texts = [*TEXTS, *map(crowded, range(20)), "é" * 4095 + "1.2.3.4" + "😀" * 9000 + " a@b.co" + "\n" * 4100, "1.2.3.4 " + "z" * 4088, "x" * 4096 + "1.2.3.4"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = [1.0] * 20
    found = {r.doc_id: r.pii_spans for r in pii.annotate(df, weights).collect()}
    for r in pii.redact(df, weights).collect():
        text = texts[r.doc_id]
        assert r.text == (plain_redacted(text, found[r.doc_id]) if text is not None else None)


def test_dense_texts_take_linear_time(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, "10.20.30.40 123-45-6789 " * n)], "doc_id long, text string")
        began = time.time()
        row = pii.redact(df, [1.0] * 20).first()
        assert row.text == "[IP] [SSN] " * n
        return time.time() - began

    seconds(1000)
    small, large = seconds(8_000), seconds(32_000)
    assert large < 8 * small + 2


def test_clashing_columns(spark):
    names = ["_spans", "row", "found", "clean", "pii_spans", "base", "a.b"]
    df = spark.createDataFrame([(1, "at 1.2.3.4", 7, *names), (2, None, None, *names)], "doc_id long, text string, n_chars int, " + ", ".join(f"`{n}` string" for n in names))
    out = pii.redact(df)
    assert out.dtypes == df.dtypes
    assert sorted(tuple(r) for r in out.collect()) == [(1, "at [IP]", 7, *names), (2, None, None, *names)]
    assert {c for c in pii.annotate(df, keep_text=False).columns} == set(df.columns) - {"text"}
