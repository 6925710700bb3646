import random
import re

import pytest

from quire.llm import chosen_path
from quire.llm.components import connected_components


def brute(rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else {t or ""}
    links = {i: set() for i in sets}
    ids = list(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            n = len(sets[a] & sets[b])
            if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    label = {}
    for i in sorted(ids):
        if i not in label:
            todo = [i]
            while todo:
                v = todo.pop()
                if v not in label:
                    label[v] = i
                    todo += links[v]
    return {i: (label[i], len(links[i])) for i in ids}


def corpus(seed, groups, copies):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijkl", k=5)) for _ in range(800)]
    boiler = [rng.choice(words) for _ in range(60)]
    rows, n = [], 0
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(30, 150))] + (boiler if g % 3 == 0 else [])
        for _ in range(copies if g < 3 else rng.randint(1, 3)):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((n, " ".join(own)))
            n += 1
    return rows


@pytest.mark.parametrize("leaf", [512, 6])
def test_links_and_classes_equal_brute_force(make_docs, monkeypatch, leaf):
    """With small buckets the tree grows to its depth and dense rests are cut into blocks."""
    monkeypatch.setattr(chosen_path, "LEAF", leaf)
    rows = corpus(3, 60, 30)
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.near_duplicates(make_docs(rows)).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    assert sum(got[i][0] == want[i][0] for i in want) >= 0.99 * len(want)
    lost = sum(abs(got[i][1] - want[i][1]) for i in want)
    assert lost <= 0.001 * sum(n for _, n in want.values())
    assert all(got[i][1] <= want[i][1] for i in want)       # no link twice, none that is not one


def test_copies_are_one_set_and_edge_rows_have_results(make_docs, edge_rows):
    rows = [(i, "five words make one shingle here") for i in range(300)] + [(400, "quite another text of some six words")]
    out = {r.doc_id: r for r in chosen_path.near_duplicates(make_docs(rows)).collect()}
    assert all(out[i].n_links == 299 and out[i].class_id == 0 for i in range(300)) and out[400].n_links == 0
    out = chosen_path.near_duplicates(make_docs(edge_rows)).collect()
    assert len(out) == len(edge_rows)
    assert {r.n_links for r in out if r.doc_id in (1, 5)} == {1}     # case does not matter
    assert chosen_path.near_duplicates(make_docs([])).count() == 0


def test_one_of_each_keeps_columns_and_the_largest_id(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    out = chosen_path.one_of_each(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert 5 in ids and 1 not in ids and ids.count(7) == 1 and 6 in ids and 9 in ids
    assert chosen_path.one_of_each(make_docs([])).count() == 0


def test_runs_follow_from_the_target():
    assert chosen_path.survival(1.0, 0.8, 5) == 1.0
    assert chosen_path.survival(0.8, 0.8, 1) == pytest.approx(0.75 * 0.8 + 0.25 * 0.96)
    assert chosen_path.runs_for(0.8, 0.9999, 3) > chosen_path.runs_for(0.8, 0.9, 3)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(5, k) for k in range(1000, 1200)]
    got = {r.v: r.label for r in connected_components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert {got[v] for v in range(100, 141)} == {100} and {got[k] for k in range(1000, 1200)} == {5}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
