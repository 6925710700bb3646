import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quire.llm import bpe_automaton, chat_format, packing
from quire.llm.pretoken import WordEncoder, by_chars
from quire.llm.queries import TOKENIZER

TRICKY = st.text(st.sampled_from(list("ab 's't're'll I'd\n\t\r.,!?12é中　\u0085🐈'vem<|>")), max_size=40)


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def encoder():
    (labels, allowed, target, column), specials = bpe_automaton.compile_file(TOKENIZER)
    ordinary = {i: t for i, t in labels.items() if i not in set(specials.values())}
    return WordEncoder(bpe_automaton.Automaton(ordinary, allowed, target, column).encode_words, specials)


def encode(encoder, texts):
    out = []
    for a, b in by_chars(texts):
        numbers, counts = encoder.words(texts[a:b])
        ends = np.cumsum(counts)
        out += [encoder.ids_of(numbers[e - c:e]).tolist() for e, c in zip(ends, counts)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(TRICKY | st.text(max_size=30), min_size=1, max_size=5))
def test_ids_equal_the_tokenizers_library(reference, encoder, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert encode(encoder, texts) == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_special_tokens_and_long_words(reference, encoder):
    texts = ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|>\n x", "z" * 3000, "", "   ", "\n\n a"]
    assert encode(encoder, texts) == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def greedy(word, ranks):
    tokens = [bytes([b]) for b in word]
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in ranks]
        if not pairs:
            return tokens
        _, i = min(pairs)
        tokens[i:i + 2] = [tokens[i] + tokens[i + 1]]


def test_automaton_equals_merging_by_rank():
    """Random merge lists, self-merges among them, against merging pair by pair."""
    rng = random.Random(4)
    for _ in range(30):
        vocab = [b"a", b"b", b"c"]
        merges = []
        for _ in range(15):
            pair = rng.choice(vocab), rng.choice(vocab)
            if pair[0] + pair[1] not in vocab and len(pair[0] + pair[1]) < 9:
                merges.append(pair)
                vocab.append(pair[0] + pair[1])
        ids = {t: i for i, t in enumerate(vocab)}
        automaton = bpe_automaton.Automaton(*bpe_automaton.compile_tables(ids, merges))
        ranks = {p: k for k, p in enumerate(merges)}
        for _ in range(40):
            word = bytes(rng.choices(b"abc", k=rng.randint(1, 12)))
            assert [vocab[i] for i in automaton.encode_word(word)] == greedy(word, ranks)


def test_round_trip_of_documents(make_docs, edge_rows, reference):
    docs = make_docs(edge_rows)
    out = bpe_automaton.round_trip_digests(docs, TOKENIZER).collect()
    want = []
    for i, t, *_ in edge_rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert [tuple(r) for r in out] == want
    encoded = bpe_automaton.encode_documents(docs, TOKENIZER)
    assert [r.text for r in bpe_automaton.decode_documents(encoded, TOKENIZER).collect()] == [t or "" for _, t, *_ in edge_rows]
    assert bpe_automaton.round_trip_digests(make_docs([]), TOKENIZER).count() == 0


def test_packing_is_whole_and_tight(make_docs, edge_rows, random_rows, reference):
    rows = [(i, t) for i, t, *_ in edge_rows if i not in (7, None)] + [(i + 5000, t) for i, t in random_rows]
    out = packing.pack_documents(make_docs(rows), TOKENIZER).toPandas()
    ids = {i: np.array(reference.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in rows}
    for i, own in out.sort_values("start").groupby("doc_id"):
        assert (own["start"].values == np.r_[0, own["length"].cumsum().values[:-1]]).all()
        assert own["length"].sum() == len(ids[i]) and own["doc_tokens"].eq(len(ids[i])).all()
    for r in out.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32
    assert out["doc_id"].nunique() == len(rows)
    totals = out.groupby("sequence_id")["length"].sum()
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert (own["offset"].values == np.r_[0, own["length"].cumsum().values[:-1]]).all()
    assert totals.max() <= packing.SEQUENCE
    padding = sum(packing.SEQUENCE - t for t in totals if t & (t - 1))
    assert padding <= 0.03 * totals.sum()


def test_packing_edge_rows(make_docs, edge_rows):
    out = packing.pack_documents(make_docs(edge_rows), TOKENIZER).toPandas()
    assert out["doc_id"].isna().sum() == 2 and (out["doc_id"] == 7).sum() == 2
    assert packing.pack_documents(make_docs([]), TOKENIZER).count() == 0


def test_descending_rests_go_to_the_cheapest_sequence_with_room():
    lengths = np.array([600, 500, 400, 300, 100, 100])
    parts = [[{"length": 1 << k} for k in range(9, -1, -1) if n >> k & 1] for n in lengths.tolist()]
    placed = packing.assign(lengths, parts)
    assert [(i, s) for i, k, s, _ in placed if k < 0][:4] == [(0, 0), (1, 1), (2, 1), (3, 0)]
    assert packing.assign(np.array([], int), []) == []


def chat(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, window string, pos string")


def test_windows_cover_every_turn_once(spark):
    rng = random.Random(3)
    rows = []
    for c in range(30):
        if c % 3:
            rows.append((c, 0, "system", "be brief <|im_end|> \\ <\\|"))
        for k in range(1, rng.randint(2, 60)):
            rows.append((c, k, "user" if k % 2 else "assistant", "w" * rng.randint(0, 900) + f"<|im_start|>{c}.{k}\\<|x"))
    windows = chat_format.format_windows(chat(spark, rows))
    got = {r.conv_id: r for r in chat_format.digests(windows).collect()}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        assert got[c].n_turns == len(own) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    each = windows.collect()
    assert all(w.formatted.startswith("<|im_start|>system\n") for w in each if w.conv_id % 3)
    assert sum(w.repeated > 1 for w in each) > 5            # some windows repeat history
    most = chat_format.BUDGET + chat_format.HISTORY + 240 + 20
    assert all(len(w.formatted) / 4 <= most + 30 for w in each)


def test_chat_edge_rows(spark):
    rows = [(1, 0, "system", None), (2, None, None, None), (2, None, "user", ""), (2, 5, "assistant", "a\nb"), (None, 1, "user", "x"),
            (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (4, 0, "user", "q" * 50_000), (4, 1, "assistant", "ok"),
            (5, 0, "ro\nle<|", "t")]
    windows = chat_format.format_windows(chat(spark, rows))
    got = {r.conv_id: r for r in chat_format.digests(windows).collect()}
    assert {c: got[c].n_turns for c in got} == {1: 1, 2: 3, None: 1, 3: 2, 4: 2, 5: 1}
    assert got[3].loss_chars == 8 and got[4].loss_chars == 2 and got[1].loss_chars == 0
    assert got[5].turns_sha256 == hashlib.sha256(b"ro\nle<|\nt\n").hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\nuser\n\nassistant\na\nb\n").hexdigest()
    assert chat_format.digests(chat_format.format_windows(chat(spark, []))).count() == 0


def window_turns(windows):
    """Per window its turns as ``(role, text, tokens)``."""
    rows = windows.withColumn("t", chat_format.read_turns(chat_format.F.col("formatted"))).orderBy("conv_id", "window").collect()
    return [(w, [(t.role, t.text, -(-len(t.text.encode()) // 4) + 4) for t in w.t]) for w in rows]


def test_windows_stay_within_the_budget(spark):
    rng = random.Random(8)
    size = lambda n: "w" * (4 * n - 16)
    rows = [(1, k, "user", size(n)) for k, n in enumerate([600, 600, 600])] + [(2, k, "user", size(n)) for k, n in enumerate([100, 3000, 50])]
    for c in range(3, 43):
        if c % 2:
            rows.append((c, 0, "system", size(rng.choice([10, 300, 900, 1100]))))
        rows += [(c, k, "user" if k % 2 else "assistant", size(rng.choice([5, 40, 200, 700, 1024, 1500]))) for k in range(1, rng.randint(2, 60))]
    seen = {}
    for w, turns in window_turns(chat_format.format_windows(chat(spark, rows))):
        assert len(turns) == w.turns
        own = turns[w.repeated:]
        led = turns[0][0] == "system"
        assert sum(n for *_, n in turns) <= chat_format.BUDGET or len(turns) <= 1 + led
        assert sum(n for *_, n in turns[led:w.repeated]) <= chat_format.HISTORY
        seen.setdefault(w.conv_id, []).extend(t[:2] for t in own)
    assert seen == {c: [r[2:] for r in rows if r[0] == c] for c in {r[0] for r in rows}}


def test_no_window_frame_is_summed_anew_for_each_row(spark, monkeypatch):
    frames = []
    between = chat_format.Window.unboundedFollowing
    plain = type(chat_format.Window.partitionBy("a")).rowsBetween
    monkeypatch.setattr(type(chat_format.Window.partitionBy("a")), "rowsBetween", lambda w, a, b: frames.append((a, b)) or plain(w, a, b))
    chat_format.format_windows(chat(spark, [(1, 1, "user", "x")]))
    assert frames and all(b != between for _, b in frames)
