"""Randomised agreement with plain definitions (seeded; one DataFrame per check)."""

import random

from pyspark.sql import functions as F

from quire.functions.text import PY_WHITESPACE, py_strip
from quire.operators.keywords import keyword_features

ALPHABET = list("abcdeéèüßAÉÜ -_,.\n\t") + ["\xa0", " ", "　", "\x1c"]


def rand_text(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def test_keyword_counts_match_definition(spark):
    rng = random.Random(11)
    vocab = ["ab", "b", "éa", "ss", "ß", "a b", "abc", "É", "-", "ü"]
    dictionary = {"One": rng.sample(vocab, 4), "Two": rng.sample(vocab, 5) + ["ab"]}
    texts = [rand_text(rng, rng.randint(0, 60)) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {i: {c: sum(1 for k in kws if k.lower() in (t or "").lower()) for c, kws in dictionary.items()}
            for i, t in enumerate(texts)}
    for method in ("filter", "sum", "scan"):
        got = keyword_features(df, "text", dictionary, {"One": 1, "Two": 2}, method=method).collect()
        for r in got:
            assert {"One": r.one_keyword_count, "Two": r.two_keyword_count} == want[r.id], (method, texts[r.id])
            tot = max(1, sum(want[r.id].values()))
            assert abs(r.one_keyword_ratio - want[r.id]["One"] / tot) < 1e-12
            assert r.two_keyword_binary == int(want[r.id]["Two"] >= 2)


def test_strip_matches_python(spark):
    rng = random.Random(5)
    ws = list(PY_WHITESPACE)
    texts = ["".join(rng.choice(ws) for _ in range(rng.randint(0, 3))) + rand_text(rng, rng.randint(0, 12))
             + "".join(rng.choice(ws) for _ in range(rng.randint(0, 3))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(py_strip(F.col("t"))).collect()]
    assert got == [t.strip() for t in texts]
