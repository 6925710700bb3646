import pytest
"""Keyword features: cases carried over from the original unit tests."""

from pyspark.sql import functions as F

from quire import constants as C
from quire.operators.keywords import (keyword_features, keyword_join, keyword_table, one_hot,
                                      price_tier_expr, rule_class)
from quire.schemas import feature_columns, region_column


def one(spark, text, dictionary=C.CLASS_KEYWORDS, method="filter"):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return keyword_features(df, "text", dictionary, C.CLASS_THRESHOLDS, method=method).first().asDict()


def tier(spark, text):
    df = spark.createDataFrame([(text,)], "s string")
    return df.select(price_tier_expr(F.col("s")).alias("t")).first()["t"]


def test_counts_substring_and_overlap(spark):
    r = one(spark, "This destination offers great hiking and trekking opportunities")
    assert r["adventure_keyword_count"] == 3  # hiking, trekking, trek
    assert one(spark, "HIKING and DIVING available")["adventure_keyword_count"] >= 2


def test_counts_zero(spark):
    assert one(spark, "")["adventure_keyword_count"] == 0
    assert one(spark, "A quiet village with no activities")["adventure_keyword_count"] == 0
    assert one(spark, None)["adventure_keyword_count"] == 0
    r = one(spark, "ski resort")
    assert isinstance(r["adventure_keyword_count"], int) and r["adventure_keyword_count"] == 0


def test_both_methods_agree(spark):
    text = "hiking museums spa budget luxury kids zoo temple trekking affordable"
    a, b = one(spark, text, method="filter"), one(spark, text, method="sum")
    assert a == b


def test_price_tier(spark):
    assert tier(spark, "") == 2
    assert tier(spark, None) == 2
    assert tier(spark, "affordable budget hostels cheap backpacker guesthouse dorm") == 1
    assert tier(spark, "luxury exclusive five-star private villa butler service upscale") == 3
    assert tier(spark, "various accommodation options from budget to luxury") == 2
    assert tier(spark, "beautiful beaches and mountains with great views") == 2


def test_feature_names_and_ratios(spark):
    r = one(spark, "hiking adventure mountains")
    for c in C.CLASS_KEYWORDS:
        k = c.lower()
        assert {f"{k}_keyword_count", f"{k}_keyword_binary", f"{k}_keyword_ratio"} <= set(r)
    r = one(spark, "hiking trekking climbing diving mountaineering skiing")
    assert r["adventure_keyword_count"] >= 4 and r["adventure_keyword_binary"] == 1
    r = one(spark, "hiking museums spa budget luxury")
    assert abs(sum(r[f"{c.lower()}_keyword_ratio"] for c in C.CLASS_KEYWORDS) - 1.0) < 1e-9
    r = one(spark, "")
    assert sum(r[f"{c.lower()}_keyword_ratio"] for c in C.CLASS_KEYWORDS) == 0


def test_threshold_edge(spark):
    r = one(spark, "hiking diving")
    assert r["adventure_keyword_count"] == 2 and r["adventure_keyword_binary"] == 0
    assert one(spark, "affordable accommodation")["budget_keyword_binary"] == 1


def test_thresholds_table():
    assert [C.CLASS_THRESHOLDS[c] for c in ["Adventure", "Relaxation", "Culture"]] == [3, 3, 3]
    assert [C.CLASS_THRESHOLDS[c] for c in ["Budget", "Luxury", "Family"]] == [1, 1, 1]
    assert len(C.CLASS_THRESHOLDS) == 6


def test_one_hot(spark):
    df = spark.createDataFrame([("Southeast Asia",), ("Unknown Region",), (None,)], "region string")
    rows = one_hot(df, "region").collect()
    names = [region_column(r) for r in C.REGIONS]
    assert len(names) == 18 and all(" " not in n for n in names)
    assert rows[0]["region_southeast_asia"] == 1 and sum(rows[0][n] for n in names) == 1
    assert sum(rows[1][n] for n in names) == 0 and sum(rows[2][n] for n in names) == 0


def test_feature_column_order():
    cols = feature_columns()
    assert len(cols) == 37 and cols[0] == "adventure_keyword_count" and cols[1] == "adventure_keyword_binary"
    assert cols[12] == "adventure_keyword_ratio" and cols[18] == "price_tier" and cols[19] == "region_southeast_asia"


def test_golden_first_row_invariants(spark):
    """counts 6,1,6,0,0,1 give binaries 1,0,1,0,0,1 and ratios count/14."""
    counts = {"Adventure": 6, "Relaxation": 1, "Culture": 6, "Budget": 0, "Luxury": 0, "Family": 1}
    text = " ".join(kw for c, n in counts.items() for kw in C.CLASS_KEYWORDS[c][:0]) or ""
    # build text with exactly these hits from non-overlapping entries
    pick = {"Adventure": ["safari", "glacier", "alpine", "bungee", "rafting", "kayaking"],
            "Relaxation": ["meditation"],
            "Culture": ["museum", "ruins", "castle", "festival", "pottery", "temple"],
            "Family": ["zoo"]}
    text = " | ".join(w for ws in pick.values() for w in ws)
    r = one(spark, text)
    assert [r[f"{c.lower()}_keyword_count"] for c in counts] == list(counts.values())
    assert [r[f"{c.lower()}_keyword_binary"] for c in counts] == [1, 0, 1, 0, 0, 1]
    assert abs(r["adventure_keyword_ratio"] - 6 / 14) < 1e-12


def test_keyword_join_equals_columns(spark):
    rows = [(1, "Hiking and trekking near the temple"), (2, "nothing here"), (3, "spa, yoga and a zoo")]
    df = spark.createDataFrame(rows, "id int, text string")
    j = {(r["id"], r["cls"]): r["hits"] for r in
         keyword_join(df, "id", "text", keyword_table(spark), classes=list(C.CLASS_KEYWORDS)).collect()}
    f = keyword_features(df, "text").collect()
    for r in f:
        for c in C.CLASS_KEYWORDS:
            assert j[(r["id"], c)] == r[f"{c.lower()}_keyword_count"]


def test_keyword_join_counts(spark):
    df = spark.createDataFrame([(1, "hiking trekking museum spa")], "id int, text string")
    j = keyword_join(df, "id", "text", keyword_table(spark), classes=list(C.CLASS_KEYWORDS))
    got = {r["cls"]: r["hits"] for r in j.collect()}
    assert got["Adventure"] == 3 and got["Culture"] == 1 and got["Relaxation"] == 1


def test_rule_class(spark):
    df = spark.createDataFrame([(1, "hiking diving museum"), (2, "nothing"), (3, "spa museum")], "id int, text string")
    r = {x["id"]: x["rule_class"] for x in rule_class(keyword_features(df, "text")).collect()}
    assert r == {1: "Adventure", 2: None, 3: "Relaxation"}  # tie → first class in order


def test_scan_equals_one_scan_per_keyword(spark):
    rows = [(1, "Hiking and TREKKING near the temple; spa & yoga; kids zoo"), (2, ""), (3, None),
            (4, "ÉCOLE — Straße; five-star luxury hostel budget cheap eats"), (5, "trek trek trek")]
    df = spark.createDataFrame(rows, "id int, text string")
    a = {r.id: r.asDict() for r in keyword_features(df, "text", method="scan").collect()}
    b = {r.id: r.asDict() for r in keyword_features(df, "text", method="filter").collect()}
    assert a == b
    dup = {"X": ["ab", "ab", "b"], "Y": ["b"]}
    r = keyword_features(spark.createDataFrame([(1, "AB")], "id int, text string"), "text", dup,
                         {"X": 1, "Y": 1}, method="scan").first()
    assert r["x_keyword_count"] == 3 and r["y_keyword_count"] == 1


def test_large_dictionary_equals_brute_force(spark, monkeypatch):
    """100,000 entries in a table that takes several passes."""
    import random
    from quire.operators import keywords as KW
    rng = random.Random(1)
    letters = "abcdefgh é-"
    entries = sorted({"".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(130_000)})[:100_000]
    table = [(["A", "B", "C"][i % 3], w) for i, w in enumerate(entries)] + [("A", ""), ("B", entries[5].upper())]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 200))) for _ in range(25)] + [None, "", "\x00a b", "ABC é"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {}
    for i, text in enumerate(texts):
        low = (text or "").lower()
        parts = {low[a:a + n] for n in range(0, 10) for a in range(len(low) + 1)}
        for c in "ABC":
            want[i, c] = sum(w.lower() in parts for k, w in table if k == c)
    monkeypatch.setattr(KW, "PASS_KEYWORDS", 60_000)
    got = keyword_join(df, "id", "text", spark.createDataFrame(table, "cls string, kw string"), classes=["A", "B", "C"])
    assert {(r.id, r.cls): r.hits for r in got.collect()} == want


def test_words_stand_apart(spark):
    rows = [(1, "space spa-like SPA"), (2, "a spaß"), (3, "the spa"), (4, "spa_1 the  spa day"), (5, "the spa day."), (6, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    d = {"X": ["spa"], "Y": ["spa day", "the spa"]}
    f = {r.id: (r.x_keyword_count, r.y_keyword_count) for r in
         keyword_features(df, "text", d, {}, method="scan", whole_words=True).collect()}
    assert f == {1: (1, 0), 2: (0, 0), 3: (1, 1), 4: (1, 1), 5: (1, 2), 6: (0, 0)}
    with pytest.raises(ValueError):
        keyword_features(df, "text", d, {}, whole_words=True)
