import math
import random

import numpy as np
import pytest
from conftest import SF_CHECK

from quire.llm import langid, pseudonyms, toxicity
from quire.llm.pseudonyms import Feistel, find_values, luhn_digit, pseudonymise_text


def test_naive_bayes_equals_a_plain_one():
    """Against counting and scoring n-gram by n-gram, with the same buckets."""
    rng = random.Random(2)
    train = [("".join(rng.choices("abcde ", k=40)), "x") for _ in range(30)] + [("".join(rng.choices("defgé ", k=40)), "y") for _ in range(30)]

    def grams(text):
        out = []
        for order in langid.ORDERS:
            for i in range(len(text) - order + 1):
                h = 0
                for c in text[i:i + order]:
                    h = (h * 0x01000193 + ord(c) + order) % 2 ** 32
                h ^= h >> 15
                h = h * 0x2C1B3C6D % 2 ** 32
                h ^= h >> 13
                out.append(h % langid.BUCKETS)
        return out
    counts = {lang: np.ones(langid.BUCKETS) for lang in "xy"}
    for text, lang in train:
        np.add.at(counts[lang], grams(text), 1)
    logp = np.log(np.stack([counts["x"] / counts["x"].sum(), counts["y"] / counts["y"].sum()], 1)).astype(np.float32)
    texts = ["abc de", "gfed é", "ad", "d" * 3000]
    pred, score = langid.score_texts(texts, ["x", "y"], logp)
    for t, p, s in zip(texts, pred, score):
        total = logp[grams(t)].sum(0, dtype=np.float64)
        assert p == "xy"[int(total.argmax())]
        assert s == pytest.approx(1 / (1 + math.exp(-abs(total[0] - total[1]))), rel=1e-5)


def test_long_texts_are_scored_in_chunks(monkeypatch):
    rng = np.random.default_rng(0)
    logp = np.log(rng.random((langid.BUCKETS, 2))).astype(np.float32)
    text = "".join(random.Random(1).choices("abcdefg ", k=5000))
    whole = [b for b, _ in langid.hashed_grams([(0, text, len(text))])]
    parts = [[], [], []]
    for chunk in langid.text_chunks([text], max_chars=700, overlap=2):
        for k, (b, _) in enumerate(langid.hashed_grams(chunk)):
            parts[k] += b.tolist()
    assert [w.tolist() for w in whole] == parts
    assert langid.score_texts([text], ["a", "b"], logp)[0][0] in "ab"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(out) > 150 and (out["lang"] == out["lang_pred"]).mean() > 0.97


def test_language_edge_rows(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    out = langid.identify(docs).collect()
    assert len(out) == len(edge_rows)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2, 3, 4, 7))
    assert all(0 <= r.score <= 1 for r in out)
    assert langid.identify(make_docs([])).count() == 0
    kept = langid.identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 5, 6, 9, None, -3}
    assert langid.identified(make_docs([])).count() == 0


def test_folded_weights_equal_the_kernel_expansion():
    words = ["idiot", "idxiot", "stupid", "table", "theorem", "a", ""]
    marks = ["idiot", "stupid", "table"]

    def features(word):
        s, out = [0, *toxicity.codes(word), 0], {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, len(s)):
                    if k - i < toxicity.SPAN:
                        u = (s[i], s[j], s[k])
                        out.setdefault(u, []).append(toxicity.DECAY ** (k - i + 1))
        norm = math.sqrt(sum(w * w for ws in out.values() for w in ws))
        return {u: sum(ws) / norm for u, ws in out.items()} if out else {}
    kernel = [[sum(v * features(m).get(u, 0) for u, v in features(w).items()) for m in marks] for w in words]
    table, whitening = toxicity.landmark_table(marks)
    assert np.allclose(toxicity.kernel_with(table, words), kernel, atol=1e-5)
    alpha = np.array([1.0, -2.0, 0.5])
    model = toxicity.Model(table @ alpha, 0.25)
    assert np.allclose(model.word_scores(words), np.array(kernel) @ alpha + 0.25, atol=1e-5)
    gram = table.T @ table
    assert np.allclose(whitening.T @ gram @ whitening, np.eye(whitening.shape[1]), atol=1e-4)


def toxic_corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("aeiou", k=1) + rng.choices("bcdfglmnprstv", k=1) + rng.choices("aeiou", k=1)
                     + rng.choices("bdlnrst", k=rng.randint(0, 2))) for _ in range(500)]
    insults = ["blorgface", "skumhead", "dimwitto"]
    out = []
    for k in range(n):
        text = [rng.choice(words) for _ in range(60)]
        toxic = k % 4 == 0
        if toxic:
            for w in rng.sample(insults, 2):
                text.insert(rng.randrange(60), w)
        out.append((" ".join(text[:30]) + ". " + " ".join(text[30:]), int(toxic)))
    return out, words


def test_toxicity_learns_insults_and_tolerates_gaps():
    rows, words = toxic_corpus(1, 600)
    train, test = rows[:400], rows[400:]
    model = toxicity.fit_texts([t for t, y in train if y], [t for t, y in train if not y])
    scorer = toxicity._Scorer(model)
    p = scorer.texts([t for t, _ in test])
    y = np.array([y for _, y in test])
    assert ((p >= 0.5) == y).mean() > 0.97
    plain = " ".join(words[:20])
    clean = scorer.texts([plain, "", None])
    assert (clean < 0.5).all()
    gapped = scorer.texts([f"{plain} bl-org.face sk_um-head", f"{plain} b l o r g f a c e s k u m h e a d", f"{plain} blorgxface skumhhead"])
    assert (gapped > clean[0]).all() and (gapped[:2] >= 0.5).all()


def test_toxicity_edge_rows(spark, make_docs, edge_rows):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (9, 0, 1), (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(make_docs(edge_rows), labels).collect()
    assert len(out) == len(edge_rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    none = labels.filter("false")
    assert {r.predicted for r in toxicity.score_documents(make_docs(edge_rows), none).collect()} == {0}
    assert toxicity.score_documents(make_docs([]), labels).count() == 0


TEXT = ("call +1 (988) 555-2485 or 4396177793418310, mail a.b@mail7.example.com from 29.217.126.147 on 2024-02-29 or "
        "31/12/1999; SSN 078-05-1120, IBAN GB82 WEST 1234 5698 7654 32")


def test_pseudonyms_are_valid_linked_and_invertible():
    f, g = Feistel(b"key"), Feistel(b"key", inverse=True)
    new, kinds = pseudonymise_text(TEXT, f)
    assert sorted(kinds) == sorted(["phone", "card", "email", "ip", "date", "date", "ssn", "iban"])
    assert pseudonymise_text(new, g)[0] == TEXT
    again = {k: v for _, _, k, v in find_values(new, f)}
    assert set(again) == set(kinds)                     # pseudonyms validate like their originals
    card = next(v for _, _, k, v in find_values(TEXT, f) if k == "card")
    assert len(card) == 16 and luhn_digit(card[:-1]) == card[-1] and card in pseudonymise_text("x 4396177793418310 y", f)[0]
    assert pseudonymise_text(TEXT, Feistel(b"other"))[0] != new


@pytest.mark.parametrize("text", ["Version 2.0. of 1.2.3.4.5", "1234567890123456", "token=0641917ea4e9feb", "999.1.1.1", "@ a@ @b.c",
                                  "2023-02-30", "GB00 WEST 1234 5698 7654 32", "", "no numbers", "000-12-3456"])
def test_what_does_not_validate_stays(text):
    assert pseudonymise_text(text, Feistel(b"k")) == (text, [])


@pytest.mark.parametrize("text, kinds", [
    ("192.168.0.1,10.0.0.1", "ip ip"), ("4111111111111111,4242424242424242", "card card"), ("123-45-6789,1987-05-06", "ssn date"),
    ("1987-05-06,1990-01-02", "date date"), ("2024-03-05T12:00:00Z 10.0.0.1", "date ip"), ("2024-03-05T12:00:00.123+01:00", "date"),
    ("17,4111111111111111,1,234,567.89,10.0.0.1,443", "card ip"), ("192.168.0.1-192.168.0.50", "ip ip"),
    ("2020-01-01-2020-12-31", "date date"), ("01.02.2020-05.06.2020", "date date"), ("2024-03-05-12:30:00", "date"),
    ("4111111111111111USD", "card"), ("10.0.0.1is up", "ip"), ("卡号4111111111111111，电话555-234-5678号", "card phone"),
    ("555-234-5678,555-234-5679x12", "phone phone"), ("+49 30 1234567,GB82WEST12345698765432,7", "phone iban"),
    ("a@b.org,4111111111111111,1987-05-06", "email card date")])
def test_values_that_touch_others(text, kinds):
    new, found = pseudonymise_text(text, Feistel(b"k"))
    assert found == kinds.split() and new != text
    assert pseudonymise_text(new, Feistel(b"k", inverse=True)) == (text, found)


@pytest.mark.parametrize("text", ["1.2.3.4.5", "0.4111111111111111", "4111111111111111.25", "1,234,567.89", "1.234.567,89", "3,14",
                                  "123-45-6789-1", "4111-1111-1111-1111-2222", "ab4111111111111111", "10.10.2020.5"])
def test_pieces_of_longer_numbers_stay(text):
    assert pseudonymise_text(text, Feistel(b"k")) == (text, [])


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(n):
    f, g = Feistel(b"k"), Feistel(b"k", inverse=True)
    image = [f.permute(x, n, "t") for x in range(n)]
    assert sorted(image) == list(range(n)) and [g.permute(y, n, "t") for y in image] == list(range(n))


def test_pseudonymise_passes_other_columns(make_docs, edge_rows):
    docs = make_docs(edge_rows + [(50, TEXT, "en", "a")])
    out = pseudonyms.pseudonymise(docs, b"k", report="found")
    assert out.columns == [*docs.columns, "found"]
    rows = out.collect()
    assert len(rows) == len(edge_rows) + 1
    assert sum(r.text is None for r in rows) == 2
    assert all(r.text == t for r, (_, t, *_) in zip(rows, edge_rows))
    with pytest.raises(ValueError):
        pseudonyms.pseudonymise(docs, b"k", report="kinds")
    assert pseudonyms.pseudonymise(make_docs([]), b"k").count() == 0


LONG_LOCAL = "very.long_" * 30 + "name"


@pytest.mark.parametrize("text, kinds", [
    ("1/2/2020", ["date"]), ("3/14/1999", ["date"]), ("12/31/1999", ["date"]), ("1987-5-6", ["date"]), ("1987-05-06", ["date"]),
    ("05.06.1987", ["date"]), ("born 5. März 1987 in", ["date"]), ("le 5 mars 1987.", ["date"]), ("el 5 de marzo de 1987", ["date"]),
    ("March 5, 1987", ["date"]), ("on the 21st October 2014", ["date"]), ("17 OKTOBER 1991", ["date"]), ("may 3 1960", ["date"]),
    ("0171 1234567", ["phone"]), ("030/12345678", ["phone"]), ("+49 171 1234567", ["phone"]),
    ("gb82 west 1234 5698 7654 32", ["iban"]), ("de89370400440532013000", ["iban"]), ("DE89 3704 0044 0532 0130 00", ["iban"]),
    ("2001:db8::ff00:42:8329", ["ip"]), ("2001:0DB8:0000:0000:0000:FF00:0042:8329", ["ip"]), ("at 10.0.0.1", ["ip"]),
    ("Jane.Doe@Example.COM", ["email"]), (f"{LONG_LOCAL}@x.org", ["email"]), ("x@a.b.c.d.e.f.g.h.i.example.com", ["email"])])
def test_width_and_case_are_kept_and_the_inverse_is_exact(text, kinds):
    new, found = pseudonymise_text(text, Feistel(b"k"))
    assert found == kinds and new != text
    assert pseudonymise_text(new, Feistel(b"k", inverse=True)) == (text, found)
    if kinds[0] != "date" or not any(c.isalpha() for c in text):        # months have names of their own lengths
        shape = lambda t: ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else c for c in t]
        hexed = kinds == ["ip"]
        assert [c if not hexed else "x" if c in "dlu" else c for c in shape(new)] == [c if not hexed else "x" if c in "dlu" else c for c in shape(text)] \
            or "." in text and hexed


def test_no_letter_of_a_long_name_stays_in_clear():
    new = pseudonymise_text(f"{LONG_LOCAL}@x.org", Feistel(b"k"))[0]
    letters = [(a, b) for a, b in zip(new, LONG_LOCAL) if b.isalpha()]
    assert sum(a == b for a, b in letters) < 0.2 * len(letters)


@pytest.mark.parametrize("text", ["12:30:45", "ratio 3:2", "std::vector", "ab::cd", "0123", "May 40, 1987", "32. März 1987", "de12 abcd", "A: 5"])
def test_look_alikes_stay(text):
    assert pseudonymise_text(text, Feistel(b"k")) == (text, [])


def test_rare_languages_are_learned(spark, make_docs, monkeypatch):
    monkeypatch.setattr(langid, "MAX_TRAIN_DOCS", 20)
    rows = [(i, "the cat and the dog went to the house " * 3, "en") for i in range(2000)]
    rows += [(5000 + i, "ghxq wvzk pqrx jxkz wqvx " * 3, "xx") for i in range(3)]
    languages, _ = langid.fit(make_docs(rows), max_docs=20)
    assert languages == ["en", "xx"]
    out = {r.doc_id: r.lang_pred for r in langid.predict(make_docs(rows), langid.fit(make_docs(rows), max_docs=20)).collect()}
    assert all(out[5000 + i] == "xx" for i in range(3)) and out[0] == "en"


def test_split_posteriors_stay(make_docs):
    rows = [(i, "aaa bbb", "en" if i % 2 else "fr") for i in range(20)] + [(100, "ab", None), (101, "12", None)]
    assert {r.doc_id for r in langid.identified(make_docs(rows)).collect()} == {*range(20), 100}
