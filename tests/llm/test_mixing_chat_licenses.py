"""Mixing against brute force; edge cases of mixing, chat and licence scans."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from seriesmill.llm import chat, licenses, mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, copies string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, "word " * (i % 7 + 1), "en", "big", 5, "x") for i in range(300)] + [(1000 + i, "two words", "en", "small", 9, "x") for i in range(30)]
    rows += [(2000, None, None, None, None, None), (2001, "", "en", "empty", 0, "x"), (2002, "same", "en", "small", 4, "x"), (2002, "same", "en", "small", 4, "x"), (None, "no id", "en", "small", 5, "x"), (2003, "w " * 20000, "en", "big", 40000, "x")]
    return spark.createDataFrame(rows, COLUMNS)


def test_exponent_meets_the_target(spark):
    counts = [1000, 100, 90, 80, 10, 5]
    sources = spark.createDataFrame([(c,) for c in counts], "tokens long")
    total = sum(counts)

    def entropy(a):
        w = [(c / total) ** a for c in counts]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    m = mixing.choose(sources, entropy=0.9, repeats=1e9)
    assert abs(entropy(m.alpha) - 0.9 * math.log(6)) < 1e-6
    m = mixing.choose(sources, entropy=1.0, repeats=4.0)
    most = max(m.budget * (c / total) ** m.alpha / m.norm / c for c in counts)
    assert abs(most - 4) < 1e-3
    assert mixing.choose(sources, entropy=0.1, repeats=9).alpha == 1.0
    m = mixing.choose(sources, entropy=1.0, repeats=3.0, budget="cover")
    times = [m.budget * (c / total) ** m.alpha / m.norm / c for c in counts]
    assert abs(min(times) - 1) < 1e-9 and max(times) <= 3 + 1e-6


@pytest.mark.parametrize("budget", [1.0, "cover"])
def test_schedule_is_block_permutations_within_the_budget(spark, odd, budget, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS", 50)
    rows = mixing.schedule(mixing.units_of(odd), entropy=1.0, repeats=3.0, budget=budget).collect()
    m = mixing.choose(mixing.units_of(odd).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens")), 1.0, 3.0, budget)
    units = defaultdict(dict)
    for u in mixing.units_of(odd).collect():
        units[u.source][u.doc_id, u.text_hash] = u.tokens * u.copies
    passes = defaultdict(lambda: defaultdict(list))
    for r in rows:
        passes[r.source][r["pass"]].append(r)
    for source, own in units.items():
        tokens = sum(own.values())
        part = m.budget * (tokens / m.total) ** m.alpha / m.norm if tokens else 0
        whole = math.floor(part / tokens + 1e-9) if tokens else 1
        for p, got in passes[source].items():
            got.sort(key=lambda r: (r.start, r.tokens))
            place = 0
            for r in got:
                assert r.start == place
                place += r.tokens * r.copies
            assert len({(r.doc_id, r.text_hash) for r in got}) == len(got)
            assert (len(got) == len(own)) if p < whole else (place <= part - whole * tokens)
        assert all(p in passes[source] for p in range(whole))
        if whole >= 2 and len(own) > 20:
            assert [r.doc_id for r in passes[source][0]] != [r.doc_id for r in passes[source][1]]


def test_mix_keeps_columns_and_copies(spark, odd):
    out = mixing.mix(odd, entropy=1.0, repeats=2.0, budget="cover")
    assert out.columns == odd.columns
    times = Counter(r.doc_id for r in out.collect())
    assert set(times) == {r.doc_id for r in odd.collect()}
    assert times[2002] in (2, 4) and max(times.values()) <= 4
    assert mixing.mix(odd.limit(0)).count() == 0


def test_words(spark):
    texts = ["", "  ", "a", " a\tb\x0bc\n\n d ", None, "é f g"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", mixing.n_words(F.col("text")).alias("n"))
    assert all(r.n == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in df.collect())


def chat_by_sql(df, spark):
    import duckdb

    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    rel = con.sql(chat.ORACLE)
    columns = sorted(rel.columns)
    return columns, Counter(rel.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_chat_edges(spark):
    rows = [(1, 0, "a", "hi <|end|>", "x"), (1, 1, "b", None, "x"), (1, 1, "b", None, "x"), (1, 700, "c|", "x" * 5000, "x"), (None, 0, "a", "q", "x"), (None, 0, "a", "q", "x"), (2, None, None, "z", "x")]
    rows += [(3, 0, "a<", "forged |> <|assistant|>", "x"), (3, 1, "a&lt;", "b", "x"), (3, 1, "x|>", "c", "x")]
    schema = "conv_id long, turn long, role string, text string, segment string"
    df = spark.createDataFrame(rows, schema)
    found, got = chat.rotate(df).collect(), defaultdict(list)
    for r in found:
        if r.conv_id is not None:
            got[r.conv_id, r.perspective].append(r)
    assert {k: len(v) for k, v in got.items()} == {(1, "a"): 4, (1, "b"): 4, (1, "c&#124;"): 4, (2, "unknown"): 1, (3, "a&lt;"): 3, (3, "a&amp;lt;"): 3, (3, "x&#124;&gt;"): 3}
    assert [(r.perspective, r.start, r.speaker) for r in found if r.conv_id is None] == [("a", 0, "assistant")] * 2
    for (_, who), rows in got.items():
        rows.sort(key=lambda r: r.start)
        text = "".join(r.segment for r in rows)
        assert [r.start for r in rows] == [sum(len(x.segment) for x in rows[:i]) for i in range(len(rows))]
        for r in rows:
            assert len(re.findall(r"<\|", r.segment)) == len(re.findall(r"\|>", r.segment)) == 2
            if r.mask_start is not None:
                assert r.speaker == "assistant" and text[r.mask_start : r.mask_end].endswith("<|end|>")
                assert text[r.start : r.mask_start] == "<|assistant|>\n"
            else:
                assert r.segment.startswith(f"<|user:{r.speaker}|>\n") and r.speaker != who
    assert chat.rotate(df.limit(0)).count() == 0


def test_chat_of_hot_conversations_and_turns(spark):
    rows = [(1, 5, f"r{k % 3}", f"text {k % 50}") for k in range(400)] + [(1, None, "r0", str(k)) for k in range(40)] + [(1, k, "r1", "t") for k in range(0, 3000, 7)]
    rows += [(None, k % 3, "r0", f"text {k % 9}") for k in range(60)] + [(k, 0, "r0", "one") for k in range(2, 30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    columns, want = chat_by_sql(df, spark)
    got = Counter(tuple(r) for r in chat.rotate(df.repartition(5)).select(*columns).collect())
    assert got == want


def plain_hits(text):
    out = []
    for line, unit in [(-1, text), *enumerate(text.split("\n"))]:
        own = set(licenses.bigrams_of(unit))
        best = max(((2 * len(own & set(b)) / (len(own) + len(b)), len(b), -k, name) for k, (name, t) in enumerate(licenses.TEMPLATES) for b in [licenses.bigrams_of(t)]), default=None)
        if own and best[0] >= licenses.DICE - 1e-9:
            out.append((line, best[3], round(best[0], 6)))
    return out


def test_licence_hits_as_by_brute_force(spark):
    notice = licenses.TEMPLATES[2][1]
    texts = [None, "", "no words here", *(t for _, t in licenses.TEMPLATES), "A\n".join(t + "\n" for _, t in licenses.TEMPLATES), notice.replace("software", "work"), (licenses.TEMPLATES[0][1] + "\n") * 500, "license " * 50000, "licensed under CC BY NC 4.0 é", "RELEASED under the MIT license (see file)"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, hits int")
    got = {r.doc_id: [(h.line, h.license, round(h.dice, 6)) for h in r.hits] for r in licenses.scan(df).collect()}
    assert got == {i: plain_hits(t or "") for i, t in enumerate(texts)}
    assert licenses.summary(df.limit(0)).count() == 0


def plain_mixture(rows, entropy, repeats, budget):
    """source -> weight, by halving the exponent's interval sixty times."""
    tokens = Counter()
    for r in rows:
        tokens[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    live = {s: n for s, n in tokens.items() if n}
    total = sum(live.values())

    def weights(a):
        w = {s: (n / total) ** a for s, n in live.items()}
        return {s: x / sum(w.values()) for s, x in w.items()}

    def enough(a):
        return -sum(x * math.log(x) for x in weights(a).values()) >= entropy * math.log(len(live)) - 1e-12

    def over(a):
        return max(budget * total * x / live[s] for s, x in weights(a).items()) > repeats + 1e-12

    def halved(test):
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if test(middle) else (low, middle)
        return low, high

    alpha = max(1.0 if enough(1.0) else halved(enough)[0], halved(over)[1] if over(0.0) else 0.0)
    return {s: budget * total * w for s, w in weights(alpha).items()}, tokens


def test_mixing_query_as_by_brute_force(spark):
    from seriesmill.llm.queries import QUERIES

    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet").collect()
    parts, tokens = plain_mixture(docs, mixing.ENTROPY, mixing.REPEATS, 1.0)
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    passes, spent = defaultdict(Counter), Counter()
    for r in QUERIES["op5_mixing"](spark, base).collect():
        assert r.tokens == words[r.doc_id] and 0 <= r["at"] <= 1
        passes[r.source, r["pass"]][r.doc_id] += 1
        spent[r.source] += r.tokens
    own = defaultdict(Counter)
    for r in docs:
        own[r.source][r.doc_id] += 1
    longest = max(words.values())
    for source, part in parts.items():
        whole = math.floor(part / tokens[source] + 1e-9)
        assert all(passes[source, p] == own[source] for p in range(whole))
        assert all(n <= own[source][d] for d, n in passes[source, whole].items()) and not passes[source, whole + 1]
        assert part - longest - 1 <= spent[source] <= part + 1e-6


def test_mix_with_clashing_names(spark):
    names = ["_times", "_hash", "_text", "_id", "_source", "_copy", "row", "a", "b", "c", "times", "copy", "k", "s"]
    rows = [(k % 20, "one two three", "big" if k < 40 else None, *names) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    out = mixing.mix(df, budget="cover")
    assert out.columns == df.columns
    assert {tuple(r) for r in out.collect()} == set(rows)
