"""Byte-level BPE and quality rules: row-local operators against plain versions."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import types as T

from dockline.llm import bpe, quality
from tests.llm import brute

SCHEMA = "doc_id long, text string, ids string, _id string, n_tokens string"
LETTERS = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  　'stvemld abcXYZ019.,;é́ß中😀#$"
RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(5)
    some = ["".join(pick.choice(LETTERS) for _ in range(pick.randint(0, 70))) for _ in range(250)]
    return [*some, None, "", " ", "a" * 30_000, " " * 3000, "ab cd ef gh ij " * 500, "x y", "x y"]


@pytest.fixture(scope="module")
def rows(texts):
    return [(k if k != 3 else None, t, "clash", "clash", "clash") for k, t in enumerate(texts)] + [(7, texts[7], None, None, None)]


def test_perfect_hash_is_minimal_and_complete():
    keys = [f"k{i}".encode() for i in range(3000)] + [b""]
    table = bpe.PerfectHash(keys)
    assert sorted(table.find(k) for k in keys) == list(range(len(keys)))
    assert all(keys[table.order[table.find(k)]] == k for k in keys)
    assert all(0 <= table.find(f"no{i}".encode()) < len(keys) for i in range(2000))


def test_bpe_matches_the_library(spark, rows):
    ranks = bpe.read_ranks(RANKS)
    other = tiktoken.Encoding("other", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    coded = bpe.encode_documents(docs, RANKS, P.PATTERN)
    got = coded.collect()
    assert len(got) == len(rows)
    want = sorted((str(r[0]), hashlib.sha256(np.array(other.encode_ordinary(r[1] or ""), "<u4").tobytes()).hexdigest(),
                   hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)
    back = {str(r.doc_id): r.text for r in bpe.decode_documents(coded, RANKS, P.PATTERN).collect()}
    assert back == {str(r[0]): r[1] or "" for r in rows}


def test_bpe_takes_little_text_at_a_time(spark):
    docs = spark.createDataFrame([(i, f"{i} " + "some words " * 20_000) for i in range(40)], "doc_id long, text string").coalesce(1)
    coded = bpe.encode_documents(docs, RANKS, P.PATTERN)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == bpe.BATCH_BYTES <= 4 << 20
    got = {r.doc_id: r.decoded_sha256 for r in coded.collect()}
    assert got == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}


def test_bpe_of_an_empty_table(spark):
    assert bpe.encode_documents(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN).collect() == []


def test_memo_keeps_one_old_generation():
    calls = []
    memo = bpe.Memo(lambda k: calls.append(k) or k, entries=2)
    assert [memo[k] for k in (1, 2, 3, 1, 2)] == [1, 2, 3, 1, 2]
    assert calls == [1, 2, 3]


def test_quality_matches_the_plain_version(spark, rows):
    docs = spark.createDataFrame(rows + [(900, "one two three four five six. " * 9, None, None, None),
                                         (901, " ".join(f"word{i}" for i in range(60)), None, None, None)], SCHEMA)
    got = sorted(tuple(r) for r in quality.judged(docs.na.fill(-1, ["doc_id"])).collect())
    want = sorted((-1 if r.doc_id is None else r.doc_id, *brute.quality(r.text)) for r in docs.collect())
    assert got == want
    assert any(r[-1] for r in got) and any(r[-2] for r in got)
    kept = quality.passing(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == sorted(r.text for r in docs.collect() if brute.quality(r.text)[-1])


def test_quality_order_does_not_change_the_verdict(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    rules = quality.base_rules() + quality.further_rules()
    verdicts = [sorted((str(r.doc_id), r.rejected_by is None) for r in quality.cascade(docs, order).collect())
                for order in (rules, rules[::-1])]
    assert verdicts[0] == verdicts[1]
    measured = quality.measure(docs, rules, sample=100)
    assert set(measured) == {r.name for r in rules}
    assert all(cost >= 0 and 0 <= share <= 1 for cost, share in measured.values())


def test_cascade_runs_the_most_rejecting_rule_per_second_first():
    rules = quality.base_rules()
    measured = {rules[0].name: (1.0, 0.2), rules[1].name: (0.1, 0.1)}
    assert [r.name for r in quality.order_rules(rules, measured)] == [rules[1].name, rules[0].name]


def test_quality_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.judged(empty).collect() == []
    assert quality.passing(empty).collect() == []
    assert isinstance(quality.judged(empty).schema["n_words"].dataType, T.LongType)
