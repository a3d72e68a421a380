"""Personal data by weak supervision, with DataFrame functions only.

Candidates are the matches of wide patterns. Three labelers vote yes, no or nothing
on each: a strict pattern, a gazetteer and its context. Expectation-maximisation over
the vote patterns estimates how reliable each labeler is and how likely each
candidate is right; with these soft labels a logistic span classifier is trained on
features of the span, and its verdict adds spans. Votes and features have a few
values each, so one aggregate of at most PATTERNS rows holds all that both fits need;
it is all that reaches the driver.

The base rules (email, ip, card, phone) always stand; added spans never overlap them
or each other. Offsets count code points, ends are exclusive.

Places come from running sums in log2(n) rounds, and a text is cut in blocks of BLOCK
code points before spans are taken out of it: the time for a text is linear in its
length and n log n in its matches.

Defined results: a null text counts as an empty one and has no spans (`redact` leaves
it null); of added spans that overlap the one that starts first stands, of equal starts
the kind listed first, then the shorter; an added span that overlaps a base span goes;
very long texts are annotated whole, in one row; rows are annotated one by one, so
repeated rows get equal spans; an empty table gives no rows; all columns of the input
are kept by `redact`, whatever their names, and a column named like the result of
`annotate` is replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import columns_of, cut_table, whole_row

#: The order of kinds in a result; the first four are the base rules'.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn")
#: kinds x votes x feature values: no more rows than this can reach the driver.
PATTERNS = len(KINDS) * 3**3 * 4 * 4 * 3

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# Run-wise forms of the base patterns: the same leftmost matches in linear time. \G allows a match that starts where the last one ended.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:\x20?[0-9]|-[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Candidates beyond the base rules.
EMAIL_SPELT = rf"(?<!{_LOCAL}){_LOCAL}++\x20?[\[(]at[\])]\x20?{_HOST}++(?:\x20?(?:\.|[\[(]dot[\])])\x20?{_HOST}++)++"
SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
PHONE_LOCAL = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

# Gazetteers and cue words.
TLDS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "it", "uk", "eu", "us", "ca", "ch", "at", "nl")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "62", "64", "65", "81", "82", "86", "90", "91")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "60", "62", "64", "65")
SECRET_SIZES = (32, 40, 64)
CUES = {
    "email": r"mail|contact|write to|reach", "ip": r"\bip\b|server|host|address|client", "card": r"card|visa|master|credit|payment|carte|karte|tarjeta",
    "phone": r"phone|call|tel|mobile|fax|cell", "secret": r"token|secret|password|passwd|api.?key|access", "ssn": r"ssn|social security|taxpayer",
}
AGAINST = r"version|checksum|sha-?\d|md5|commit|isbn|invoice|order n|page|serial"
_WINDOW = 40  # code points of context on the left
CHUNK, BLOCK = 64, 4096

CANDIDATE = "array<struct<kind:int,start:int,end:int,base:boolean,votes:array<int>,features:array<int>>>"


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once and not for each use."""
    return F.transform(F.array(x), f)[0]


def _scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The running op over an array of integers, in log2(size) rounds that each combine places 1, 2, 4, ... apart.

    A fold that appends to an array copies all of it at each step.
    """
    def combined(acc: Column, gap: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i >= gap, op(x, F.get(acc, i - gap))).otherwise(x))

    def run(v: Column) -> Column:
        rounds = F.coalesce(F.ceil(F.log2(F.size(v))).cast("int"), F.lit(0))
        gaps = F.transform(F.sequence(F.lit(0), F.greatest(rounds - 1, F.lit(0))), lambda k: F.pow(F.lit(2.0), k).cast("int"))
        return F.when(F.size(v) < 2, v).otherwise(F.aggregate(gaps, v, combined))

    return _bound(values, run)


_MATCH = "struct<kind:int,start:int,end:int,match:string,left:string>"


def _matches(text: str, pattern: str, kind: str) -> Column:
    """Array of (kind, start, end, match, left); text is an SQL expression. As SQL text, since building it call by call takes seconds."""
    pieces = f"arrays_zip(split({text}, r'{pattern}', -1), regexp_extract_all({text}, r'{pattern}', 0))"
    pieces = f"transform({pieces}, x -> named_struct('p', x['0'], 'm', x['1'], 'n', coalesce(length(x['1']), 0)))"
    gaps = "transform(sequence(0, greatest(cast(ceil(log2(size(pieces))) as int) - 1, 0)), k -> cast(pow(2, k) as int))"
    ends = f"aggregate({gaps}, transform(pieces, x -> length(x.p) + x.n), (acc, gap) -> transform(acc, (x, i) -> if(i >= gap, x + get(acc, i - gap), x)))"
    span = f"named_struct('kind', {KINDS.index(kind)}, 'start', end - x.n, 'end', end, 'match', x.m, 'left', right(x.p, {_WINDOW}))"
    placed = f"filter(zip_with(pieces, {ends}, (x, end) -> {span}), x -> x.match IS NOT NULL)"
    return F.expr(f"if({text} rlike r'{pattern}', transform(array({pieces}), pieces -> {placed})[0], cast(array() as array<{_MATCH}>))")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(F.lit(True) if no is None else no, 0).otherwise(-1)


def _judged(x: Column, kind: str, valid: Column, strict: Column, known: Column, base: bool) -> Column:
    """A candidate with its votes (strict pattern, gazetteer, context) and features (size, what stands before, mix of characters)."""
    left = F.lower(x["left"])
    context = F.when(left.rlike(CUES[kind]), 1).when(left.rlike(AGAINST), 0).otherwise(-1)
    size = F.length(x["match"])
    before = F.when(left == "", 0).when(F.right(left, F.lit(1)).rlike(r"\s"), 1).when(F.right(left, F.lit(1)).rlike(r"[\"'(:=<]"), 2).otherwise(3)
    mix = F.when(x["match"].rlike("[A-Za-z]"), F.when(x["match"].rlike("[0-9]"), 2).otherwise(1)).otherwise(0)
    features = F.array(F.when(size < 12, 0).when(size < 20, 1).when(size < 36, 2).otherwise(3), before, mix)
    return F.struct(x["kind"], x["start"], x["end"], (valid if base else F.lit(False)).alias("base"), F.array(_vote(strict), _vote(known, F.lit(True)), context).alias("votes"), features.alias("features"))


def candidates(name: str = "text") -> Column:
    """Array CANDIDATE of the texts in the column `name`: base matches, valid or not, and the wider ones, in no set order."""
    said = f"coalesce(`{name}`, '')"
    text = F.expr(said)
    digit, none = text.rlike("[0-9]"), F.array().cast(CANDIDATE)

    def of(gate: Column, pattern: str, kind: str, judge) -> Column:
        return F.when(gate, F.transform(_matches(said, pattern, kind), judge)).otherwise(none)

    def email(x: Column) -> Column:
        last = F.lower(F.element_at(F.split(x["match"], r"\."), -1))
        return _judged(x, "email", F.lit(True), last.rlike("^[a-z]{2,12}$"), last.isin(*TLDS), True)

    def spelt(x: Column) -> Column:
        last = F.lower(F.regexp_extract(x["match"], "([A-Za-z0-9-]+)$", 1))
        return _judged(x, "email", F.lit(False), last.rlike("^[a-z]{2,12}$"), last.isin(*TLDS), False)

    def ip(x: Column) -> Column:
        parts = F.transform(F.split(x["match"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        valid = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
        return _judged(x, "ip", valid, valid, ~parts[0].isin("0", "127", "255"), True)

    def card(x: Column) -> Column:
        digits = _digits(x["match"])
        valid = F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
        return _judged(x, "card", valid, valid, F.substring(digits, 1, 2).isin(*ISSUERS) | F.substring(digits, 1, 1).isin(*ISSUERS), True)

    def phone(x: Column) -> Column:
        digits = _digits(x["match"])
        valid = F.length(digits).between(10, 15)
        return _judged(x, "phone", valid, valid, F.substring(digits, 1, 1).isin(*CALLING_CODES) | F.substring(digits, 1, 2).isin(*CALLING_CODES), True)

    def local(x: Column) -> Column:
        digits = _digits(x["match"])
        return _judged(x, "phone", F.lit(False), digits.rlike("^[2-9][0-9]{2}[2-9]"), x["match"].rlike(r"^\([0-9]{3}\)|-[0-9]{3}-"), False)

    def secret(x: Column) -> Column:
        mixed = x["match"].rlike("[0-9]") & x["match"].rlike("[A-Fa-f]")
        return _judged(x, "secret", F.lit(False), mixed, F.length(x["match"]).isin(*SECRET_SIZES), False)

    def ssn(x: Column) -> Column:
        return _judged(x, "ssn", F.lit(False), ~x["match"].rlike("^(000|666|9)") & ~x["match"].rlike("-00-|-0000$"), x["match"].rlike("^[0-8]"), False)

    wide_card = F.filter(_matches(said, CARD, "card"), lambda x: F.length(_digits(x["match"])).between(13, 19))
    return F.concat(
        of(F.contains(text, F.lit("@")), EMAIL, "email", email),
        of(F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]")), EMAIL_SPELT, "email", spelt),
        of(digit, IP, "ip", ip),
        F.when(digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), F.transform(wide_card, card)).otherwise(none),
        of(digit & F.contains(text, F.lit("+")), PHONE, "phone", phone),
        of(digit, PHONE_LOCAL, "phone", local),
        of(digit, SECRET, "secret", secret),
        of(digit & F.contains(text, F.lit("-")), SSN, "ssn", ssn),
    )


def reliabilities(patterns: list[tuple[int, tuple[int, ...], float]], rounds: int = 40) -> tuple[list[float], list[float], list[float]]:
    """EM. patterns: (kind, votes, count) -> a labeler's reliabilities, a kind's share of right ones, a pattern's chance to be right.

    A labeler that votes is right with its reliability, independently of the others;
    it starts at 0.8, and a prior of 8 right and 2 wrong votes holds it where votes are few.
    """
    n = max((len(v) for _, v, _ in patterns), default=3)
    right, share, chance = [0.8] * n, [0.5] * len(KINDS), [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (kind, votes, _) in enumerate(patterns):
            odds = math.log(share[kind] / (1 - share[kind]))
            for j, v in enumerate(votes):
                if v >= 0:
                    odds += (1 if v else -1) * math.log(right[j] / (1 - right[j]))
            chance[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for j in range(n):
            agree = sum(c * (p if v[j] else 1 - p) for (_, v, c), p in zip(patterns, chance) if v[j] >= 0)
            total = sum(c for _, v, c in patterns if v[j] >= 0)
            right[j] = min(0.99, max(0.51, (agree + 8) / (total + 10)))
        for k in range(len(KINDS)):
            total = sum(c for kind, _, c in patterns if kind == k)
            share[k] = min(0.99, max(0.01, (sum(c * p for (kind, _, c), p in zip(patterns, chance) if kind == k) + 1) / (total + 2)))
    return right, share, chance


def _on(kind: int, strict: int, features: tuple[int, ...]) -> tuple[int, ...]:
    """The features of a span that are 1: bias, kind, strict pattern, and each feature's value."""
    size, before, mix = features
    return 0, 1 + kind, 1 + len(KINDS) + strict, 3 + len(KINDS) + size, 7 + len(KINDS) + before, 11 + len(KINDS) + mix


def train(docs: DataFrame) -> list[float]:
    """docs (text) -> weights of the span classifier."""
    return train_on(docs.select(candidates().alias("found")))


def train_on(table: DataFrame, steps: int = 300) -> list[float]:
    """table (found: candidates) -> weights of the span classifier."""
    found = table.select(F.explode("found").alias("c")).select("c.kind", "c.votes", "c.features").groupBy("kind", "votes", "features").agg(F.count("*").alias("n"))
    rows = sorted((r.kind, tuple(r.votes), tuple(r.features), float(r.n)) for r in found.collect())  # at most PATTERNS
    by_votes: dict[tuple[int, tuple[int, ...]], float] = {}
    for kind, votes, _, n in rows:
        by_votes[kind, votes] = by_votes.get((kind, votes), 0.0) + n
    _, _, chance = reliabilities([(k, v, n) for (k, v), n in by_votes.items()])
    soft = dict(zip(by_votes, chance))
    weights = [0.0] * (14 + len(KINDS))
    examples = [(_on(k, int(v[0] == 1), f), soft[k, v], math.log1p(n)) for k, v, f, n in rows]
    total = sum(n for _, _, n in examples) or 1.0
    for _ in range(steps):
        grad = [-0.001 * w for w in weights]
        for on, p, n in examples:
            gap = n / total * (p - 1 / (1 + math.exp(-sum(weights[i] for i in on))))
            for i in on:
                grad[i] += gap
        weights = [w + 2.0 * g for w, g in zip(weights, grad)]
    return weights


SPAN = "struct<start:int,rank:int,kind:int,end:int,base:boolean>"


def _none(kind: str) -> Column:
    """An empty list of `kind` that a fold adds to: full chunks and the one that is open."""
    return F.struct(F.array().cast(f"array<array<{kind}>>").alias("full"), F.array().cast(f"array<{kind}>").alias("open"))


def _added(out: Column, x: Column) -> Column:
    more = F.struct(out["full"].alias("full"), F.array_append(out["open"], x).alias("open"))
    return F.when(F.size(out["open"]) < CHUNK, more).otherwise(F.struct(F.array_append(out["full"], out["open"]).alias("full"), F.array(x).alias("open")))


def _listed(out: Column) -> Column:
    return F.flatten(F.array_append(out["full"], out["open"]))


def spans(found: Column, weights: list[float]) -> Column:
    """Candidates -> array of (start, kind, end, base), sorted: the base spans, and the added ones that the classifier takes."""
    w = F.array(*(F.lit(x) for x in weights))
    n = len(KINDS)

    def score(x: Column) -> Column:
        strict = F.when(x["votes"][0] == 1, 1).otherwise(0)
        f = x["features"]
        return w[0] + F.get(w, x["kind"] + 1) + F.get(w, strict + (1 + n)) + F.get(w, f[0] + (3 + n)) + F.get(w, f[1] + (7 + n)) + F.get(w, f[2] + (11 + n))

    def plain(x: Column) -> Column:
        return F.struct(x["start"], x["kind"], x["end"], x["base"])

    def ranked(x: Column) -> Column:
        return F.struct(x["start"], F.when(x["base"], 0).otherwise(1).alias("rank"), x["kind"], x["end"], x["base"])

    def free(items: Column) -> Column:
        """The added spans that overlap no base span: they begin after all that stand before them and end before the next."""
        ended = _scan(F.transform(items, lambda x: F.when(x["base"], x["end"]).otherwise(-1)), F.greatest)
        begun = F.reverse(_scan(F.reverse(F.transform(items, lambda x: F.when(x["base"], x["start"]).otherwise(2**31 - 1))), F.least))
        both = F.zip_with(ended, begun, lambda a, b: F.struct(a.alias("after"), b.alias("before")))
        told = F.zip_with(items, both, lambda x, y: F.struct(x.alias("x"), (~x["base"] & (x["start"] >= y["after"]) & (x["end"] <= y["before"])).alias("stands")))
        return F.transform(F.filter(told, lambda t: t["stands"]), lambda t: t["x"])

    def apart(items: Column) -> Column:
        """Without those that begin inside one that stands; the fold is needed only from the first overlap on."""
        ends = _scan(F.transform(items, lambda x: x["end"]), F.greatest)
        meets = F.zip_with(items, F.concat(F.array(F.lit(-1)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0)))), lambda x, end: x["start"] < end)

        def step(acc: Column, x: Column) -> Column:
            stands = x["start"] >= acc["end"]
            return F.struct(F.when(stands, x["end"]).otherwise(acc["end"]).alias("end"), F.when(stands, _added(acc["out"], x)).otherwise(acc["out"]).alias("out"))

        folded = F.aggregate(items, F.struct(F.lit(-1).alias("end"), _none(SPAN).alias("out")), step, lambda acc: _listed(acc["out"]))
        return F.when(F.exists(meets, lambda m: F.coalesce(m, F.lit(False))), folded).otherwise(items)

    def parted(found: Column) -> Column:
        items = F.array_sort(F.transform(F.filter(found, lambda x: x["base"] | (score(x) > 0)), ranked)).cast(f"array<{SPAN}>")

        def settled(items: Column) -> Column:
            base, more = F.filter(items, lambda x: x["base"]), F.filter(items, lambda x: ~x["base"])
            stands = F.when(F.size(base) == 0, more).otherwise(free(items))
            out = F.when(F.size(more) == 0, base).otherwise(F.concat(base, _bound(stands, apart)))
            return F.array_sort(F.transform(out, plain))

        return _bound(items, settled)

    return _bound(found, parted)


def said(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def annotate(docs: DataFrame, weights: list[float] | None = None, to: str = "pii_spans", keep_text: bool = True) -> DataFrame:
    """docs with the column `to`: array<struct<start,kind,end,base>>.

    Without the text the candidates are looked for once, and kept in a table for the fit
    and its verdicts; with it a second time, as the texts would have to be kept too.
    """
    if not keep_text:
        table = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("text", to)), candidates().alias(to))
        if weights is None:
            table = cut_table(table)
            weights = train_on(table.select(F.col(f"`{to}`").alias("found")))
        return table.withColumn(to, spans(F.col(f"`{to}`"), weights))
    return docs.withColumn(to, spans(candidates(), train(docs) if weights is None else weights))


def redacted(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap the first one's mark stands for both."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS), F.lit(""))

    def gaps(found: Column) -> Column:
        """What lies before each span that begins outside all before it, and the rest."""
        ends = _scan(F.transform(found, lambda x: x["end"]), F.greatest)
        own = F.zip_with(found, F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1)), lambda x, pos: F.struct(pos.alias("begin"), x["start"].alias("end"), x["kind"].alias("kind")))
        last = F.struct(F.element_at(ends, -1).alias("begin"), F.length(text).alias("end"), F.lit(len(KINDS)).alias("kind"))
        return F.concat(F.filter(own, lambda g: g["end"] >= g["begin"]), F.array(last))

    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))

    def piece(blocks: Column, g: Column) -> Column:
        first, end = F.floor(g["begin"] / BLOCK).cast("int"), F.floor((g["end"] - 1) / BLOCK).cast("int")
        inner = F.substring(F.get(blocks, first), g["begin"] % BLOCK + 1, g["end"] - g["begin"])
        outer = F.concat(F.substring(F.get(blocks, first), g["begin"] % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, F.greatest(end - first - 1, F.lit(0))), ""), F.substring(F.get(blocks, end), F.lit(1), g["end"] - end * BLOCK))
        kept = F.when(g["end"] <= g["begin"], F.lit("")).when(first == end, inner).otherwise(outer)
        return F.concat(kept, F.get(names, g["kind"]))

    both = F.struct(blocks.alias("blocks"), _bound(found, gaps).alias("gaps"))
    clean = _bound(both, lambda x: F.array_join(F.transform(x["gaps"], lambda g: piece(x["blocks"], g)), ""))
    return F.when(F.size(found) > 0, clean).otherwise(text)


def redact(docs: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """docs with each span replaced by its kind in brackets; n_chars is kept in step where docs have it."""
    weights = train(docs) if weights is None else weights
    marked = docs.select(whole_row(docs).alias("row"), F.col("text"), spans(candidates(), weights).alias("found"))
    clean = marked.select("row", redacted(F.col("text"), F.col("found")).alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("clean").cast(docs.schema["n_chars"].dataType)
    return clean.select(*(new[c].alias(c) if c in new else old for c, old in zip(docs.columns, columns_of(docs))))
