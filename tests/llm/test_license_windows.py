"""Notices that are wrapped over lines or stand within a line."""

import textwrap

from seriesmill.llm import licenses


def test_wrapped_and_embedded_notices(spark):
    filler = " ".join(f"word{i}" for i in range(300))
    wrapped = [(name, f"{filler}\n" + "\n".join(textwrap.wrap(t, 40)) + f"\n{filler}") for name, t in licenses.TEMPLATES if len(t) > 100]
    inside = [(name, f"{filler} {t} {filler}\n{filler}") for name, t in licenses.TEMPLATES]
    cases = wrapped + inside + [(None, f"{filler} permission is granted by the license {filler}")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.n_hits, r.license, r.dice) for r in licenses.summary(df).collect()}
    for i, (name, text) in enumerate(cases):
        assert got[i][1] == name, (got[i], text[1500:2500])
    assert all(got[i][0] == 1 and got[i][2] == 1.0 for i in range(len(wrapped), len(cases) - 1))
