"""Collocations, periodic runs and benchmark windows against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dockline.llm import collocations, decontaminate, periodic
from dockline.llm.common import SPACE, Tokens
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, phrase string, runs string, hits string, words string, h string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, la, "p", "r", "h", "w", None) for i, t, la in docs], SCHEMA).repartition(4)


def _phrase_docs(count=60):
    pick = random.Random(5)
    pool = ["der", "Große", "HUND", "bellt", "nie", "é", "x\x85y", "no", "tail"]
    docs = []
    for i in range(count):
        words = [pick.choice(pool) for _ in range(pick.randint(0, 60))]
        text = "".join(w + pick.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!? "]) for w in words)
        docs.append((i, text, pick.choice(["de", "en", None, "und", ""])))
    return docs + [(900, None, "de"), (901, "", "de"), (902, " .. \n", "fr"), (903, "der Große " * 5000, "big"), (None, "nie " * 40, "en")]


@pytest.mark.parametrize("floor, longest, cover", [(10, 3, 50), (3, 3, 90), (4, 2, 50), (5, 4, 30)])
def test_collocations_match_the_plain_version(spark, floor, longest, cover):
    docs = _phrase_docs()
    out = collocations.collocations(frame(spark, docs), floor=floor, longest=longest, cover_percent=cover, top=12)
    assert sorted(tuple(r) for r in out.collect()) == brute.phrases([d[1:] for d in docs], floor, longest, cover, 12)


def test_collocations_do_not_depend_on_slices_ranges_or_a_full_filter(spark, monkeypatch):
    docs = _phrase_docs(30)
    want = brute.phrases([d[1:] for d in docs], 3, 3, 50, 2000)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 300)
    monkeypatch.setattr(collocations, "SUFFIXES_A_TASK", 40)  # phrases go on from range to range
    got = collocations.collocations(frame(spark, docs), floor=3)
    assert sorted(tuple(r) for r in got.collect()) == want
    monkeypatch.setattr(collocations, "_passes", lambda bits, hashes: np.ones(len(hashes), bool))
    assert sorted(tuple(r) for r in collocations.collocations(frame(spark, docs), floor=3).collect()) == want


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(1, None, None), (2, "...", "en")])).collect() == []


def test_quicksort_counts_equal_partitions():
    rng = np.random.default_rng(2)
    keys = [rng.integers(0, 4, 500), rng.integers(0, 30, 500), rng.integers(0, 30, 500)]
    keys[2][keys[1] == 0] = 0
    weights = rng.integers(1, 4, 500)
    want = {}
    for *row, weight in zip(*keys, weights, strict=True):
        for depth in range(3):
            if row[depth] == 0:
                break
            want[tuple(row[: depth + 1])] = want.get(tuple(row[: depth + 1]), 0) + weight
    got = {tuple(keys[k][p] for k in range(d + 1)): n for d, p, n in collocations.quicksorted(keys, weights, 6)}
    assert got == {k: n for k, n in want.items() if n >= 6}


def _runs(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    tokens = Tokens(data, offsets, SPACE)
    return [tuple(r) for r in periodic.runs_of(tokens.ids, tokens.first).tolist()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("ab", min_size=1, max_size=4), st.integers(1, 9)), max_size=5), max_size=4))
def test_runs_match_the_definition(parts):
    texts = [" ".join(" ".join(c) for word, n in one for c in [word * n]) for one in parts]
    want = [(k, *r) for k, t in enumerate(texts) for r in brute.runs(t.split())]
    assert _runs(texts) == want


def test_runs_of_all_lags_and_of_self_similar_texts():
    pick = random.Random(4)
    fibonacci = ["a", "a b"]
    while len(fibonacci) < 12:
        fibonacci.append(f"{fibonacci[-1]} {fibonacci[-2]}")
    texts = [" ".join([fibonacci[9]] * 5), fibonacci[11], "a b " * 30 + "a"]
    for q in [*range(1, 30), 56, 57, 58, 90]:
        period = [f"w{pick.randrange(q + 2)}" for _ in range(q)]
        size = max(6, 4 * q) + pick.randint(-1, q)
        texts.append(" ".join(["x"] * pick.randint(0, 3) + (period * 6)[:size] + ["y"]))
    got = _runs(texts)
    assert got == [(k, *r) for k, t in enumerate(texts) for r in brute.runs(t.split())]
    assert {r[3] for r in got} > {1, 5, 6, 18, 19, 57, 58}


def test_long_texts_take_little_more_than_linear_time():
    import time

    texts = ["same " * 400_000, "a b c d e " * 80_000]
    start = time.time()
    assert _runs(texts) == [(0, 0, 400_000, 1), (1, 0, 400_000, 5)]
    assert time.time() - start < 60


def test_periodic_runs_of_documents(spark):
    docs = [(1, None, "x"), (2, "", "x"), (3, "no run here", "x"), (4, "go\tgo go\ngo go go", "x"), (4, "go\tgo go\ngo go go", "x"),
            (5, "p a b c a b c a b c a b c q q q q q q q", "x"), (None, "z " * 7, "x"), (6, "é " * 5, "x")]
    out = periodic.periodic_runs(frame(spark, docs))
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.runs_sha256, r.collapsed_text)
                  for r in out.collect()), key=str)
    want = []
    for name, text, _ in docs:
        ws = brute.words(text)
        runs = brute.runs(ws)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((name, len(ws), runs, best, hashlib.sha256(lines.encode()).hexdigest(), brute.collapsed(ws, runs)))
    assert got == sorted(want, key=str)
    assert periodic.periodic_runs(frame(spark, [])).collect() == []


def _benchmark():
    pick = random.Random(8)
    pool = ["alpha", "Beta", "Γάμμα", "delta9", "8", "e"]
    items = [(str(i), " ".join(pick.choice(pool) for _ in range(n))) for i, n in enumerate([0, 1, 3, 9, 10, 11, 25, 40])]
    items += [(None, "lost NAME here"), ("3", "Beta-beta"), ("9", None), ("10", "e!"), ("10", "e!")]
    docs = ["", None, "...", "e", "E-e", "LOST name HERE lost", "xalpha", items[7][1].replace(" ", ", "), items[6][1][:40]]
    docs += [" ".join(pick.choice(pool) for _ in range(60)) + "\n" + items[pick.randrange(4, 8)][1].upper() for _ in range(12)]
    return items, docs


@pytest.mark.parametrize("bound", [1 << 20, 60])
def test_contamination_matches_the_plain_version(spark, bound):
    items, docs = _benchmark()
    bench = spark.createDataFrame([(i, t, "n") for i, t in items], "item_id string, text string, n_words string")
    out = decontaminate.contamination(frame(spark, [(k, t, "en") for k, t in enumerate(docs)]), bench, automaton_words=bound)
    rows = sorted(out.collect())
    assert [(r.n_words, r.n_hit, r["items"]) for r in rows] == brute.contaminated(docs, items)
    for r in rows:  # the stretches lie on the original text
        words = [w for s in r.spans for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", docs[r.doc_id][s.start : s.end])]
        assert len(words) == r.n_hit


def test_contamination_without_rows_items_or_words(spark):
    items, docs = _benchmark()
    bench = spark.createDataFrame(items, "item_id string, text string")
    some = frame(spark, [(1, docs[-1], "en"), (1, docs[-1], "en"), (None, None, "en")])
    assert decontaminate.contamination(frame(spark, []), bench).collect() == []
    none = decontaminate.contamination(some, bench.filter("item_id = '9'")).collect()
    assert sorted((r.doc_id or 0, r.n_hit, len(r["items"])) for r in none) == [(0, 0, 0), (1, 0, 0), (1, 0, 0)]
    got = sorted((r.doc_id or 0, r.n_words > 0, r.n_hit > 0) for r in decontaminate.contamination(some, bench).collect())
    assert got == [(0, False, False), (1, True, True), (1, True, True)]


def test_one_long_text_is_scanned_once(spark):
    text = "filler words " * 300_000 + "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([("q", "One two three four five six seven eight nine ten")], "item_id string, text string")
    row = decontaminate.contamination(frame(spark, [(1, text, "en")]), bench).first()
    assert (row.n_words, row.n_hit, row["items"]) == (600_010, 10, ["q"])
    assert text[row.spans[0].start : row.spans[0].end].startswith("one two") and row.spans[0].end == len(text)
