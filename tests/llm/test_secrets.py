"""Secrets in upper case and of more than 64 characters are candidates and are redacted."""

from seriesmill.llm import pii


def test_upper_case_and_long_secrets(spark):
    token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [f'token = "{t}" here' for t in (token, token.upper(), token * 2, "f00d" * 40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [x.kind for x in r.c] for r in df.select("doc_id", pii.candidates().alias("c")).collect()}
    assert all(pii.KINDS.index("secret") in got[i] for i in range(4)), got
