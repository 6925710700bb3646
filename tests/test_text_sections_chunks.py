from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import text as TX
from quire.functions.sections import extract_section
from quire.operators.chunks import chunk_articles
from quire.operators.validate import check_limit, validate_entities, validate_messages
from quire.sources.tables import cache_key

import pytest


def col1(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_sections(spark):
    cases = {
        "==Understand==\nHello world\n==Do==\n* hiking\n===Sub===\nmore\n==Sleep==\nhostel": "* hiking",
        "== do == a=b c==d tail": "a=b c",
        "===Do===x": "x",
        "no head": "",
        "==DO==": "",
        "==Redo==\nq\n==Do==\nr": "r",
    }
    got = col1(spark, list(cases), lambda c: extract_section(c, "Do"))
    assert got == list(cases.values())


def test_py_strip_unicode(spark):
    vals = ["　 a b \xa0\n", "\t\x1c x \x1f", "   ", None]
    assert col1(spark, vals, TX.py_strip) == [v.strip() if v is not None else None for v in vals]


def test_head_code_points(spark):
    assert col1(spark, ["😀abc", "ab"], lambda c: TX.head(c, 2)) == ["😀a", "ab"]


def test_ellipsis(spark):
    vals = ["x" * 100, "y" * 101, None]
    assert col1(spark, vals, lambda c: TX.ellipsis(c, 100)) == ["x" * 100, "y" * 100 + "...", None]


def test_number_formats_round_the_decimal_form(spark):
    from decimal import ROUND_HALF_UP, Decimal
    vals = [0.5005, 0.0005, 0.125, 2.675, 1234567.125, 0.375, 12.0]

    def fixed(v, n):
        return str(Decimal(repr(v)).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP))
    assert col1(spark, vals, lambda c: TX.format_fixed(c, 3), "double") == [fixed(v, 3) for v in vals]
    assert col1(spark, vals, lambda c: TX.format_signed(c, 3), "double") == ["+" + fixed(v, 3) for v in vals]
    assert col1(spark, vals, TX.format_percent, "double") == [fixed(v * 100, 0) + "%" for v in vals]


def test_session_suffix(spark):
    df = spark.createDataFrame([("hi", "abc"), ("yo", None)], "m string, s string")
    r = df.select(TX.session_suffix(F.col("m"), F.col("s")).alias("u")).collect()
    assert [x.u for x in r] == ["hi [session:abc]", "yo"]
    back = df.select(TX.parse_session_suffix(TX.session_suffix(F.col("m"), F.col("s"))).alias("p")).collect()
    assert [x.p for x in back] == ["abc", None]


def test_cache_key(spark):
    import hashlib
    name = "Sa Pa"
    got = spark.createDataFrame([(name,)], "n string").select(cache_key("n").alias("k")).first()["k"]
    assert got == f"v1_{hashlib.md5(name.lower().encode()).hexdigest()}.json"


def test_message_validation(spark):
    rows = [("a", ""), ("b", "   "), ("c", None), ("d", "x" * 1001), ("e", "I want to go hiking in the mountains"),
            ("f", "  padded  " + "z" * 990)]
    df = spark.createDataFrame(rows, "id string, message string")
    ok, bad = validate_messages(df)
    assert {r.id for r in bad.collect()} == {"a", "b", "c", "d"}
    acc = {r.id: r.message for r in ok.collect()}
    assert acc["e"] == "I want to go hiking in the mountains" and acc["f"].startswith("padded")


def test_history_limit():
    assert check_limit(None) == 10
    assert check_limit(1) == 1 and check_limit(100) == 100
    for bad in (0, 101, -1):
        with pytest.raises(ValueError):
            check_limit(bad)


def test_entity_validation(spark):
    df = spark.createDataFrame([("  Sa Pa ", "Southeast Asia"), ("  ", "Oceania"), ("X", "Atlantis")],
                               "destination_name string, region string")
    ok, bad = validate_entities(df)
    assert [r.destination_name for r in ok.collect()] == ["Sa Pa"]
    assert sorted(r.reasons[0] for r in bad.collect()) == ["destination cannot be empty", "unknown region"]


def test_chunking_cases(spark):
    u, d, s = "u" * 60, "d" * 49, "s" * 60
    rows = [("A", u, d, s, "full text"), ("B", "short", "", "tiny", "F" * 2000), ("C", "", "", "", ""),
            ("D", None, None, None, None)]
    df = spark.createDataFrame(rows, "destination string, understand string, do string, sleep string, full_text string")
    ch = {(r.destination, r.chunk_index): r for r in chunk_articles(df).collect() if r.part == 0}
    assert sorted(k for k in ch if k[0] == "A") == [("A", 0), ("A", 2)]
    assert ch[("A", 0)].chunk_text == f"A - Understand: {u}" and ch[("A", 2)].chunk_text == f"A - Sleep: {s}"
    assert ch[("B", 0)].chunk_text == "B: " + "F" * 1500 and ch[("B", 0)].section == "full"
    assert not any(k[0] in ("C", "D") for k in ch)
    assert ch[("A", 0)].source_document == "wikivoyage:A"


def test_chunk_text_cut(spark):
    df = spark.createDataFrame([("Z", "w" * 3000, "", "", "")],
                               "destination string, understand string, do string, sleep string, full_text string")
    rows = chunk_articles(df).orderBy("part").collect()
    assert rows[0].chunk_text == "Z - Understand: " + "w" * C.CHUNK_TEXT_CHARS
    assert [(r.chunk_index, r.part) for r in rows] == [(0, 0), (0, 1)]
    long = " ".join(f"word{i}" for i in range(20_000))      # nothing of a long section is lost
    df = spark.createDataFrame([("Z", "", long, "", "")], df.schema)
    parts = [r.chunk_text[len("Z - Do: "):] for r in chunk_articles(df).orderBy("part").collect()]
    assert "".join(parts) == long


def test_sections_with_subsections(spark):
    cases = {
        "==Understand==\nHello\n==Do==\n* hiking\n===Sub===\nmore\n==Sleep==\nhostel": "* hiking\n===Sub===\nmore",
        "===Do===\nx\n====Deep====\ny\n===Other===\nz": "x\n====Deep====\ny",
        "==Do==\nonly": "only",
        "no head": "",
        "==Redo==\nq\n==Do==\nr\n===a===\ns": "r\n===a===\ns",
    }
    got = col1(spark, list(cases), lambda c: extract_section(c, "Do", include_subsections=True))
    assert got == list(cases.values())
