"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's windows.

A word is a maximal run of letters a-z, digits and non-ASCII bytes after lower-casing
A-Z. A window is `size` consecutive words of a benchmark item, or all words of a shorter
item. The windows are the patterns of one automaton, so a text is scanned once, whatever the
number of windows. A word enters the automaton as its number in digits of a fixed count,
each digit place with letters of its own: few branches at each state, and no match
begins inside a word. Word places lead back to character offsets of the original text.

Size: the automaton is built in each worker process from the broadcast windows. They are
counted first. Up to `AUTOMATON_WORDS` words and item names in all windows it is one
automaton. A larger benchmark is dealt by window hash to as many automata as keep each
under that bound; they scan the texts one after the other, and the hits of a text are
combined. No window is left out.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockline.llm.common import LOWEST, batch_texts, settled, stored

WINDOW_WORDS = 10
AUTOMATON_WORDS = 1 << 20
DIGITS = 64
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # in a text as it stands
# upper-case letters become lower case, other ASCII characters but digits and letters a space
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def windows_of(items: DataFrame, size: int = WINDOW_WORDS, text: str = "text", id_column: str = "item_id") -> DataFrame:
    """(words, items): each distinct window of the benchmark with the ids of its items, as text.

    An item with fewer words than a window is one window, one without words none. A null id
    is not listed, its windows count all the same.
    """
    batch_texts(items.sparkSession)
    own = items.select(items[id_column].cast("string").alias("item"), items[text].cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, spans = [], []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(value)
                for i in range(max(len(words) - size, 0) + 1 if words else 0):
                    names.append(name)
                    spans.append(b" ".join(words[i : i + size]).decode())
                if len(spans) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(spans, pa.string()), pa.array(names, pa.string())], names=["words", "item"])
                    names, spans = [], []
            yield pa.RecordBatch.from_arrays([pa.array(spans, pa.string()), pa.array(names, pa.string())], names=["words", "item"])

    pairs = own.mapInArrow(work, "words string, item string").distinct()
    # at most the items that hold one and the same window; a null item adds no name
    return pairs.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


class _Scanner:
    """The automaton of a list of (window, items), and the scan of one text's words."""

    def __init__(self, windows: list[tuple[str, list[str]]]):
        known = sorted({w for words, _ in windows for w in words.encode().split(b" ")})
        self.width = 1
        while DIGITS**self.width < len(known):
            self.width += 1
        self.letters = {w: self._digits(k) for k, w in enumerate(known)}
        self.unknown = "\0" * self.width
        self.windows = windows
        self.found = ahocorasick.Automaton()
        for k, (words, _) in enumerate(windows):
            parts = words.encode().split(b" ")
            self.found.add_word("".join([self.letters[w] for w in parts]), (len(parts), k))
        self.found.make_automaton()

    def _digits(self, number: int) -> str:
        out = []
        for place in range(self.width):
            out.append(chr(1 + place * DIGITS + number % DIGITS))
            number //= DIGITS
        return "".join(out)

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], list[str]]:
        """(stretches [a, b) of hit words, names of the items whose windows occur)."""
        if not self.windows:
            return [], []
        letters, unknown = self.letters.get, self.unknown
        hits: list[list[int]] = []
        seen = set()
        for end, (length, window) in self.found.iter("".join([letters(w, unknown) for w in words])):
            seen.add(window)
            b = (end + 1) // self.width
            a = b - length
            while hits and hits[-1][1] >= a:  # ends ascend
                a = min(a, hits.pop()[0])
            hits.append([a, b])
        return hits, sorted({name for k in seen for name in self.windows[k][1]})


@lru_cache(maxsize=1)
def _scanner(key: str, held) -> _Scanner:
    """The automaton of this worker process, built at its first batch."""
    return _Scanner(held.value)


def _placed(text: str | None, hits: list[list[int]]) -> tuple[int, list[dict[str, int]]]:
    """Number of hit words, and the merged stretches as character offsets of the text."""
    merged: list[list[int]] = []
    for a, b in sorted(hits):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    at = [m.span() for m in WORD.finditer(text)] if merged else []
    return sum(b - a for a, b in merged), [{"start": at[a][0], "end": at[b - 1][1]} for a, b in merged]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RESULT = "doc_id long, n_words long, n_hit long, spans array<struct<start: bigint, end: bigint>>, items array<string>"


def _scanned(docs: DataFrame, windows: list[tuple[str, list[str]]]) -> DataFrame:
    """Result of one automaton for each row of (doc_id, text)."""
    held, key = docs.sparkSession.sparkContext.broadcast(windows), uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, hit, spans, items = [], [], [], []
            for value in batch.column(1):
                text = value.as_py()
                words = words_of(text)
                hits, names = _scanner(key, held).scan(words)
                count, places = _placed(text, hits)
                total.append(len(words))
                hit.append(count)
                spans.append(places)
                items.append(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, SPANS),
                 pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "spans", "items"])

    return docs.mapInArrow(work, RESULT)


def _hits(docs: DataFrame, windows: list[tuple[str, list[str]]]) -> DataFrame:
    """(_id, _th, hits, items) of one automaton for the documents (_id, _th, text) that it hits."""
    held, key = docs.sparkSession.sparkContext.broadcast(windows), uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hits, items = [], [], []
            for row, value in enumerate(batch.column(2)):
                spans, names = _scanner(key, held).scan(words_of(value.as_py()))
                if spans:
                    rows.append(row)
                    hits.append(spans)
                    items.append(names)
            keys = [batch.column(k).take(pa.array(rows, pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(hits, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))],
                names=["_id", "_th", "hits", "items"])

    return docs.mapInArrow(work, "_id long, _th long, hits array<array<long>>, items array<string>")


def _combined(docs: DataFrame) -> DataFrame:
    """Result for rows (doc_id, text, hits, items) of several automata; hits and items may be null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, hit, spans, items = [], [], [], []
            for text, hits, names in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                count, places = _placed(text, hits or [])
                total.append(len(words_of(text)))
                hit.append(count)
                spans.append(places)
                items.append(sorted(set(names or [])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, SPANS),
                 pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "spans", "items"])

    return docs.mapInArrow(work, RESULT)


def contamination(docs: DataFrame, items: DataFrame, *, size: int = WINDOW_WORDS, text: str = "text",
                  id_column: str = "doc_id", item_text: str = "text", item_id: str = "item_id",
                  automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit, spans, items.

    `n_hit` counts the words inside any occurrence of a benchmark window, `spans` are the
    merged stretches of such words as character offsets [start, end) of the original text,
    `items` the ids (as text, sorted) of the benchmark items with an occurring window.

    Null and empty texts have no words and no hits. Rows equal in id are judged one by one
    and a null id is kept; items with repeated ids are one item with the windows of all
    its rows, an item with a null id marks words but is not listed. Without documents
    there are no rows, without benchmark windows no hits. Other columns are not read. A
    text is held whole by its task; time grows with its words and its hits.
    """
    batch_texts(docs.sparkSession)
    own = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    windows = settled(windows_of(items, size, item_text, item_id))
    cells = windows.agg(F.sum(F.size(F.split("words", " ")) + F.size("items"))).first()[0] or 0
    if cells <= automaton_words:
        return _scanned(own, [tuple(r) for r in windows.collect()])  # bounded by the count above
    # a document is known by its id and the hash of its text
    own = own.withColumn("_id", F.coalesce("doc_id", F.lit(LOWEST))).withColumn("_th", F.xxhash64(F.coalesce("text", F.lit(""))))
    parts = math.ceil(2 * cells / automaton_words)
    dealt = windows.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(parts)))
    found = None
    for part in range(parts):
        rows = dealt.filter(F.col("part") == part).select("words", "items").collect()  # about half the bound
        scan = _hits(own.select("_id", "_th", "text"), [tuple(r) for r in rows]).dropDuplicates(["_id", "_th"])
        scan = stored(scan, "benchmark-hits")
        found = scan if found is None else found.unionByName(scan)
    found = found.groupBy("_id", "_th").agg(  # a row for each automaton that hits the document
        F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
    return _combined(own.join(found, ["_id", "_th"], "left").select("doc_id", "text", "hits", "items"))
