"""Archives and id files: round trips, torn inputs, plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from dockline.llm import idcoder, warc
from dockline.llm.common import shared_path

TOKENIZER = P.path("word_bpe_49k.json")
PAGES = "page_id long, url string, html string, payload string, record_id string"
DOCS = "doc_id long, text string, part string, image string, _id string"


def test_both_arc_versions_are_parsed_by_declared_lengths():
    payload = b"a\n\nhttp://x 1.1.1.1 20200101000000 text/html 5\nabcde\r\n\r\nWARC/1.0\r\n"
    for version in (1, 2):
        data = warc.arc_opening(version) + b"".join(
            warc.arc_record(url, n, payload, "20110203040506", version) for n, url in enumerate(["http://a b/c", None, "http://z"]))
        got = list(warc.parse_arc(data))
        assert [r["url"] for r in got] == ["http://a b/c", "-", "http://z"]
        assert all(r["body"].partition(b"\r\n\r\n")[2] == payload and r["version"] == version for r in got)
        with pytest.raises(ValueError):
            list(warc.parse_arc(data[:-20]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://x 1.1.1.1 20200101000000 text/html 1\na\n"))


def test_dates_and_identifiers():
    assert warc.warc_date("20110203040506") == "2011-02-03T04:05:06Z"
    assert warc.warc_date("2011") == "2011-01-01T00:00:00Z"
    assert warc.warc_date("99999999999999") == "1970-01-01T00:00:00Z"
    assert warc.record_id("u", "1", "d", "x") == warc.record_id("u", "1", "d", "x") != warc.record_id("u", "2", "d", "x")


def test_archives_round_trip(spark):
    big = "é<p>\r\n\r\nWARC/1.0\r\n" * 200
    pages = [(1, "http://a", big), (5, "http://b", big), (3, None, big), (2, "http://c d", "small"), (4, "http://e", "small"),
             (6, "http://f", None), (7, "http://g", ""), (None, "http://h", big), (9, "http://i", "x" * 999), (10, "http://j", "x" * 999),
             (11, "http://k", "y" * 1000), (12, "http://l\nm", "y" * 1000), (13, "http://n", "q" * 400_000), (2, "http://c d", "small")]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], PAGES).repartition(3)
    got = sorted((tuple(r) for r in warc.converted(df, shared_path(spark, "t")).collect()), key=str)
    want = []
    for page, _, html in pages:
        data = (html or "").encode()
        same = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        revisit = len(data) >= 1000 and page is not None and page < max(same)
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert got == sorted(want, key=str)


def test_archives_of_an_empty_table_and_a_torn_file(spark):
    assert warc.converted(spark.createDataFrame([], PAGES), shared_path(spark, "t")).collect() == []
    record = warc.warc_record({"head": "HTTP/1.0 200 OK", "payload": "abc", "record_id": "<i>", "date": "d", "url": "u",
                               "payload_digest": "0", "refers_id": None, "refers_date": None}).encode()
    assert len(list(warc.parse_warc(record + b"\r\n\r\n" + record))) == 2
    with pytest.raises(ValueError):
        list(warc.parse_warc(record[:-1]))


@pytest.mark.parametrize("kind", ["none", "one", "random", "cycle", "wide", "top", "skewed"])
def test_images_round_trip(kind):
    rng = np.random.default_rng(4)
    ids = {"none": np.zeros(0, int), "one": np.array([5]), "random": rng.integers(0, 50_000, 9001), "cycle": np.arange(9000) % 7,
           "wide": rng.integers(0, 1 << 20, 300), "top": np.full(5000, 65_535), "skewed": rng.zipf(1.3, 20_000) % 49_000}[kind]
    image = idcoder.write_image([1, None], [len(ids), 0], ids.astype(np.int64))
    names, lengths, back = idcoder.read_image(image)
    assert names == [1, None] and lengths == [len(ids), 0] and (back == ids).all()
    if kind == "cycle":
        assert len(image) < len(ids) / 4
    if kind == "skewed":
        broken = bytearray(image)
        broken[-len(image) // 2] ^= 64
        with pytest.raises(ValueError):
            idcoder.read_image(bytes(broken))


def test_blocks_are_decoded_alone():
    ids = np.random.default_rng(2).zipf(1.4, (3, 500)) % 3000
    streams = idcoder.encode_blocks(ids, 3)
    for k in range(3):
        assert (idcoder.decode_blocks([streams[k]], 500, 3)[0] == ids[k]).all()


def test_id_files_match_the_library(spark, monkeypatch):
    monkeypatch.setattr(idcoder, "IMAGE_IDS", 300)
    pick = random.Random(8)
    letters = " \t\n\r\x0b\x0c\x1c\x85\xa0　abcXYZ'stdé́İßΣσς09.,;<|endoftext|>中😀"
    docs = [(k, "".join(pick.choice(letters) for _ in range(pick.randint(0, 90)))) for k in range(120)]
    docs += [(500, None), (501, ""), (502, " "), (None, "null id"), (503, "x" * 5000), (504, "say <|endoftext|> it's"), (504, "other"), (7, docs[7][1])]
    df = spark.createDataFrame([(*d, "a", "b", "c") for d in docs], DOCS).repartition(5)
    got = idcoder.round_trip(df, shared_path(spark, "t"), TOKENIZER, 1).orderBy("start").collect()
    library = Tokenizer.from_file(TOKENIZER)
    coded = {}
    for name, text in docs:
        coded.setdefault(name, []).append(np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes())
    assert len(got) == len(docs)
    assert [r.doc_id for r in got] == sorted((d for d, _ in docs), key=lambda d: -1 if d is None else d)
    at = 0
    for r in got:
        assert bytes(r.ids) in coded[r.doc_id] and r.start == at and r.n_tokens == len(r.ids) // 4
        assert r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens


def test_id_files_of_an_empty_table(spark):
    assert idcoder.round_trip(spark.createDataFrame([], DOCS), shared_path(spark, "t"), TOKENIZER, 1).collect() == []
