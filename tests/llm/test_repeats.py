"""Line runs, repeated passages and near-duplicates against plain versions."""

import random

import pyarrow as pa
import pytest

from dockline.llm import lines, minhash, superkmer
from tests.llm import brute

SCHEMA = "doc_id long, text string, line string, key string, _th string, _row string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", None, "y", "z") for i, t in docs], SCHEMA).repartition(4)


@pytest.mark.parametrize("min_lines", [1, 2, 3])
def test_lines_match_the_plain_version(spark, min_lines):
    pick = random.Random(min_lines)
    pool = ["alpha beta", "gamma", "delta epsilon", "", "  ", "zeta", "Zeta"]
    docs = [(i, "\n".join(pick.choice(pool) for _ in range(pick.randint(0, 9)))) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (None, "alpha beta\ngamma\nzeta"),
             (103, "\n".join(f"only {i}" for i in range(40))), (104, "\n".join(f"only {i}" for i in range(40)))]
    out = lines.without_repeats(frame(spark, docs), min_lines=min_lines)
    got = {r.doc_id: (r.text or "", r._n_lines, r._n_removed) for r in out.collect()}
    assert got == brute.line_dedup(docs, min_lines)
    assert out.columns[:6] == ["doc_id", "text", "line", "key", "_th", "_row"]
    assert {(r.line, r.key, r._th, r._row) for r in out.collect()} == {("x", None, "y", "z")}
    assert max(r._longest_run for r in out.collect()) >= 32


@pytest.mark.parametrize(("min_lines", "min_words"), [(2, 2), (3, 3), (4, 2), (2, 20)])
def test_long_single_lines_count_by_their_words(spark, min_lines, min_words):
    pick = random.Random(min_words)
    pool = ["one", "two words", "now three words", " ".join(f"p{i}" for i in range(19)), " ".join(f"q{i}" for i in range(20)),
            "\t" + "\x0b ".join(f"r{i}" for i in range(25)) + " ", "x" * 200_000, "\x85 \u3000 wide"]
    docs = [(i, "\n".join(pick.choice(pool) for _ in range(pick.randint(0, 5)))) for i in range(25)]
    docs += [(90, pool[4]), (91, pool[4]), (92, f"new\n{pool[5]}\nend"), (93, " ".join(f"v{i % 7}" for i in range(300_000)))]
    docs += [(94, docs[-1][1]), (95, None)]
    out = lines.without_repeats(frame(spark, docs), min_lines=min_lines, min_words=min_words).collect()
    got = {r.doc_id: (r.text or "", r._n_lines, r._n_removed) for r in out}
    assert got == brute.line_dedup(docs, min_lines, min_words)
    assert got[94] == ("", 1, 1) and got[91][2] == 1


def test_lines_repeated_rows_are_one_document_and_an_empty_table_is_empty(spark):
    docs = [(1, "a b\nc d\ne f"), (1, "a b\nc d\ne f"), (2, "a b\nc d\nnew")]
    got = sorted((r.doc_id, r.text) for r in lines.without_repeats(frame(spark, docs)).collect())
    assert got == [(1, docs[0][1]), (1, docs[0][1]), (2, "new")]
    assert lines.without_repeats(frame(spark, [])).collect() == []


def _passages():
    pick = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [" ".join(pick.choices(vocabulary, k=30)) for _ in range(4)]
    docs = []
    for i in range(40):
        parts = [" ".join(pick.choices(vocabulary, k=pick.randint(0, 25))) for _ in range(2)]
        docs.append((i, f"{parts[0]}\t{pick.choice(shared)}\n{parts[1]} {pick.choice(shared)}"))
    docs += [(50, docs[3][1]), (51, None), (52, ""), (None, docs[5][1]), (53, "a b c d e " * 12), (54, "z " * 50),
             (55, " ".join(vocabulary)), (56, "é " + " ".join(vocabulary)), (57, "w1 w2")]
    return docs


@pytest.mark.parametrize("hot", [20_000, 2])
def test_passages_match_the_plain_version(spark, monkeypatch, hot):
    monkeypatch.setattr(superkmer, "HOT_STRINGS", hot)
    docs = _passages()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in superkmer.without_repeats(frame(spark, docs)).collect()}
    assert got == brute.passages(docs)
    assert sum(v[1] for v in got.values()) > 500


def test_windows_of_many_texts_are_hashed_together(monkeypatch):
    texts = [" ".join(f"w{(i * 7 + k) % 90}" for k in range(n)) for i, n in enumerate([0, 3, 4, 5, 30, 4, 0, 61] * 20)]
    calls = []
    hashed = superkmer.windows
    monkeypatch.setattr(superkmer, "windows", lambda *a: calls.append(1) or hashed(*a))
    one, two, rows, offs = superkmer.text_windows(pa.array(texts, pa.large_string()), 4)
    assert len(calls) == 2  # not two for each text
    plain = [(row, at, tuple(words[at : at + 4])) for row, words in enumerate(t.split() for t in texts) for at in range(len(words) - 3)]
    assert [(r, o) for r, o, _ in plain] == list(zip(rows.tolist(), offs.tolist(), strict=True))
    names = dict(zip((w for _, _, w in plain), zip(one.tolist(), two.tolist(), strict=True), strict=True))
    assert len(set(names.values())) == len(names)
    assert [names[w] for _, _, w in plain] == list(zip(one.tolist(), two.tolist(), strict=True))


def test_a_task_ships_the_words_of_a_string_once(spark):
    text = " ".join(f"w{i % 90}" for i in range(200))
    docs = superkmer.keyed(frame(spark, [(i, text) for i in (3, 1, 2, 1, None)]).coalesce(1))
    strings = superkmer._strings(docs, 20, 5, b"\xff" * 4096).toPandas()
    words = strings.packed.dropna()
    earliest = strings[strings.packed.notna()].groupby("packed")[["_id", "_th", "start"]].apply(lambda g: min(map(tuple, g.to_numpy().tolist())))
    assert len(words) < len(strings) and strings.packed.isna().sum() > 0
    assert not strings[strings.packed.notna()][["_id", "_th", "start"]].duplicated().any()
    assert len(earliest) == words.nunique() and all(place[0] < 0 for place in earliest)


@pytest.mark.parametrize("hot", [20_000, 3])
@pytest.mark.parametrize(("known", "rows"), [(100_000, 10_000), (0, 10_000), (5, 7)])
def test_passages_in_copies_over_many_batches(spark, monkeypatch, hot, known, rows):
    monkeypatch.setattr(superkmer, "HOT_STRINGS", hot)
    monkeypatch.setattr(superkmer, "KNOWN_STRINGS", known)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        docs = _passages()
        docs += [(i, docs[i % 7][1]) for i in range(60, 90)] + docs[:5] + [(100 + i, docs[4][1]) for i in range(3)] * 2
        out = superkmer.without_repeats(frame(spark, docs)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = brute.passages(list(dict.fromkeys(docs)))
    assert sorted((r.doc_id for r in out), key=str) == sorted((i for i, _ in docs), key=str)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out} == plain


def test_passages_of_repeated_rows_and_of_an_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = sorted((r.doc_id, r.n_removed) for r in superkmer.without_repeats(frame(spark, [(1, text), (1, text), (2, text)])).collect())
    assert got == [(1, 0), (1, 0), (2, 30)]
    assert superkmer.without_repeats(frame(spark, [])).collect() == []


def _near():
    pick = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs, name = [], 0
    for _ in range(8):
        base = pick.choices(vocabulary, k=pick.randint(40, 120))
        for _ in range(12):
            copy = list(base)
            for _ in range(pick.randint(0, 6)):
                copy[pick.randrange(len(copy))] = pick.choice(vocabulary)
            docs.append((name, " ".join(copy).upper() if name % 2 else " ".join(copy)))
            name += 3
    docs += [(1, docs[0][1]), (4, None), (7, ""), (10, " \n"), (13, "one"), (16, "ONE"), (19, "one two"), (22, "\x85 one")]
    pick.shuffle(docs)
    return docs


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_match_the_plain_version(spark, size):
    docs = _near()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, docs), size=size).collect()}
    assert got == brute.near(docs, size)
    assert len({c for _, c in got.values()}) < len(docs) - 20


def test_near_duplicates_with_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = [(5, text), (5, text), (None, text), (9, "a b c"), (None, "q r s t"), (None, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, docs), size=2).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (None, 5, False), (9, 9, True), (None, None, True), (None, None, True)], key=str)
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(50))
    near, other = text + " more", "a clean row under the id of a linked one"
    docs = [(5, text), (5, text), (None, text), (None, near), (7, near), (7, other), (5, other + " x"), (None, "q r s t u v"),
            (None, "q r s t u v"), (None, None), (None, None), (3, "")]
    got = sorted(((r.doc_id, r.text, r.line) for r in minhash.one_of_each(frame(spark, docs), size=2).collect()), key=str)
    want = [(5, text), (7, other), (5, other + " x"), (None, "q r s t u v"), (None, None), (None, None), (3, "")]
    linked = brute.near([(1, other), (2, other + " x")], 2)
    assert linked[2][1] == 1  # so the smaller id of these two stays
    want.remove((7, other))
    assert got == sorted(((i, t, "x") for i, t in want), key=str)
    assert minhash.one_of_each(frame(spark, [])).collect() == []


def test_estimate_is_close_to_the_similarity(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = []
    for share in (0.5, 0.8, 0.95):
        for _ in range(20):
            both = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
            cut = int(1000 * (1 - share) / (1 + share) + 0.5)
            one, two = both.copy(), both.copy()
            two[:cut] = rng.integers(0, 1 << 63, cut).astype(np.uint64)
            rows.append((share, *(minhash.packed_fields(minhash.minima(np.unique(x))).tolist() for x in (one, two))))
    df = spark.createDataFrame(rows, "share double, fa array<long>, fb array<long>")
    for r in df.withColumn("e", minhash.estimate("fa", "fb")).collect():
        assert abs(r.e - r.share) < 0.2
