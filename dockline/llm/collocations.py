"""Phrase collocations from counted word suffixes.

Texts are cut into pieces at punctuation and pieces into words. Every word starts a
suffix of up to `longest` words of its piece. Equal suffixes of a slice of text are
combined where they are read. Suffixes are then routed by their leading words: a range
partitioning on (lang, first word, second word, ...), so a frequent leading word spreads over
as many tasks as its suffixes need. Each task sorts its suffix pointers by multikey
three-way quicksort down to `longest` words. The weight of an equal partition is the
count of its phrase; partitions lighter than the floor are abandoned. A phrase that
starts or ends a task's range may go on in the next one, so those (two a depth and task)
are passed on whatever their count and added up.

Two fixed-size bitmaps, of words and of word pairs that reach the floor, shorten suffixes
before they are shipped: no phrase with a rare word or pair in it can reach the floor.
They are filled from 64-bit hashes and may let rare ones through, which costs work only;
counts come from the words themselves. Sums and scores are whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dockline.llm.common import FOLD, Tokens, batch_texts, hash_spans, mix64, shuffle_width, slices, stored

FLOOR = 10
LONGEST = 3
COVER_PERCENT = 50
TOP = 2000
FILTER_BITS = 27
SUFFIXES_A_TASK = 1_000_000
SHORT = 128
SLICE_BYTES = 4 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[ord(c) for c in " \t.,;:!?\n\v\f\r"]] = True
BREAK = SEPARATOR.copy()
BREAK[[0x20, 0x09]] = False


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    for batch in batches:
        langs = batch.column(0)
        for lang in langs.unique().to_pylist():
            yield lang, batch.column(1).filter(pc.equal(langs, pa.scalar(lang)))


class _Pieces:
    """Words of a slice with their hashes and the number of words left in the piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: str):
        data = FOLD[data]
        words = Tokens(data, offsets, SEPARATOR)
        self.ids, self.names = words.ids, words.names
        count = len(self.ids)
        piece = np.searchsorted(np.flatnonzero(BREAK[data]), words.starts)
        piece += np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))  # a text ends a piece
        ends = np.append(np.flatnonzero(piece[1:] != piece[:-1]) + 1, count)
        self.left = ends[np.searchsorted(ends, np.arange(count), side="right")] - np.arange(count)
        _, bounds, held = self.names.buffers()
        at = np.frombuffer(bounds, np.int64)[: len(self.names) + 1] if len(self.names) else np.zeros(1, np.int64)
        held = np.frombuffer(held, np.uint8) if held is not None and len(self.names) else np.zeros(0, np.uint8)
        salt = hash_spans(np.frombuffer(lang.encode() or b"\0", np.uint8), np.array([0]), np.array([len(lang.encode() or b"\0")]))[0]
        self.words = mix64(hash_spans(held, at[:-1], at[1:]) + salt)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the pairs of neighbouring words of a piece."""
        at = np.flatnonzero(self.left > 1)
        first, second = self.words[self.ids[at]], self.words[self.ids[at + 1]]
        return at, mix64(first * np.uint64(0x9E3779B97F4A7C15) + mix64(second))


def _combined(hashes: np.ndarray) -> pa.RecordBatch:
    found, count = np.unique(hashes, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count, pa.int64())], names=["h", "n"])


def _filter(counts: DataFrame, floor: int, bits: int = FILTER_BITS) -> bytes:
    """Bitmap of 2^bits places, set for the hashes whose counts reach the floor."""
    often = counts.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= floor)
    place = F.col("h").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    pages = (
        often.groupBy(F.bitmap_bucket_number(place).alias("page"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("set"))
        .collect()  # 2^bits / 32768 pages of 4 KB at most
    )
    out = np.zeros(1 << (bits - 3), np.uint8)
    for page, held in pages:
        out[(page - 1) * 4096 : page * 4096] = np.frombuffer(held, np.uint8)
    return out.tobytes()


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _word_hashes(docs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_lang(batches):
            for _, _, data, offsets in slices(texts, SLICE_BYTES):
                found = _Pieces(data, offsets, lang)
                count = np.bincount(found.ids, minlength=len(found.words))
                yield pa.RecordBatch.from_arrays([pa.array(found.words.view(np.int64)), pa.array(count, pa.int64())], names=["h", "n"])

    return docs.mapInArrow(work, "h long, n long")


def _pair_hashes(docs: DataFrame, words: bytes) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for lang, texts in _by_lang(batches):
            for _, _, data, offsets in slices(texts, SLICE_BYTES):
                found = _Pieces(data, offsets, lang)
                often = _passes(bits, found.words)
                at, pairs = found.pairs()
                yield _combined(pairs[often[found.ids[at]] & often[found.ids[at + 1]]])

    return docs.mapInArrow(work, "h long, n long")


def _suffixes(docs: DataFrame, longest: int, words: bytes, pairs: bytes) -> DataFrame:
    """(lang, w0, w1, ..., n): suffixes cut before their first rare word or pair, combined by slice.

    A suffix without a frequent word has no words; it is kept for the number of all words.
    """
    context = docs.sparkSession.sparkContext
    shared_words, shared_pairs = context.broadcast(words), context.broadcast(pairs)
    columns = [f"w{k}" for k in range(longest)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_bits, pair_bits = (np.frombuffer(x.value, np.uint8) for x in (shared_words, shared_pairs))
        for lang, texts in _by_lang(batches):
            for _, _, data, offsets in slices(texts, SLICE_BYTES):
                found = _Pieces(data, offsets, lang)
                count = len(found.ids)
                often = _passes(word_bits, found.words)[found.ids]
                at, hashes = found.pairs()
                joined = np.zeros(count + longest, bool)
                joined[at] = often[at] & often[at + 1] & _passes(pair_bits, hashes)
                ids = np.full(count + longest, -1, np.int64)
                ids[:count] = found.ids
                goes, size = often.copy(), len(found.names) + 1
                keys = np.where(goes, found.ids + 1, 0)
                for depth in range(1, longest):  # exact numbers of ever longer suffixes
                    goes &= joined[depth - 1 : depth - 1 + count]
                    keys = keys * size + np.where(goes, ids[depth : depth + count] + 1, 0)
                    if depth + 1 < longest:
                        keys = np.unique(keys, return_inverse=True)[1]
                _, first, weight = np.unique(keys, return_index=True, return_counts=True)
                out, goes = [], often[first]
                for depth in range(longest):
                    if depth:
                        goes = goes & joined[first + depth - 1]
                    take = pa.array(np.where(goes, ids[first + depth], 0), mask=~goes)
                    out.append(found.names.take(take).cast(pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(first), pa.string()), *out, pa.array(weight, pa.int64())], names=["lang", *columns, "n"])

    fields = ", ".join(f"{c} string" for c in columns)
    return docs.mapInArrow(work, f"lang string, {fields}, n long")


def quicksorted(keys: list[np.ndarray], weights: np.ndarray, floor: int) -> Iterator[tuple[int, int, int]]:
    """(depth, pointer, weight) of each phrase that reaches the floor, by multikey three-way quicksort.

    `keys` are the word numbers by depth, 0 where a suffix has ended. Short partitions
    are counted outright.
    """
    parts = [(np.arange(len(weights)), 0)]
    while parts:
        pointers, depth = parts.pop()
        held = weights.take(pointers)
        if int(np.add.reduce(held)) < floor:
            continue  # nothing in here can reach the floor
        if len(pointers) <= SHORT:
            yield from _short([k.take(pointers).tolist() for k in keys[depth:]], pointers, held.tolist(), depth, floor)
            continue
        key = keys[depth].take(pointers)
        pivot = sorted((int(key[0]), int(key[len(key) // 2]), int(key[-1])))[1]
        low, high = key < pivot, key > pivot
        equal = ~(low | high)
        if pivot > 0:
            weight = int(np.add.reduce(held[equal]))
            if weight >= floor:
                same = pointers[equal]
                yield depth, int(same[0]), weight
                if depth + 1 < len(keys):
                    parts.append((same, depth + 1))
        for side in (low, high):
            rest = pointers[side]
            if len(rest):
                parts.append((rest, depth))


def _short(keys: list[list[int]], pointers: np.ndarray, weights: list[int], depth: int, floor: int) -> Iterator[tuple[int, int, int]]:
    counts: dict[int, int] = {}
    for word, weight in zip(keys[0], weights, strict=True):
        counts[word] = counts.get(word, 0) + weight
    for word, weight in counts.items():
        if word and weight >= floor:
            same = [at for at, other in enumerate(keys[0]) if other == word]
            yield depth, int(pointers[same[0]]), weight
            if len(keys) > 1:
                yield from _short([[k[at] for at in same] for k in keys[1:]], pointers[same], [weights[at] for at in same], depth + 1, floor)


def _edges(keys: list[np.ndarray]) -> list[tuple[int, int, np.ndarray]]:
    """For each depth the pointers of the phrases that start or end the range, which may go on elsewhere."""
    out = []
    for pick in (np.min, np.max):
        same = np.arange(len(keys[0]))
        for depth in range(len(keys) - 1):
            key = keys[depth][same]
            same = same[key == pick(key)]
            if keys[depth][same[0]] > 0:
                out.append((depth, int(same[0]), same))
    return out


def _counted(ranged: DataFrame, longest: int, floor: int) -> DataFrame:
    """(lang, phrase, n) of the phrases of each range; those at its ends whatever their count."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        names = [table.column(k).combine_chunks().dictionary_encode() for k in range(longest + 1)]
        keys = []
        for column in names:  # numbers in byte order, so that they compare as the words do
            order = pc.array_sort_indices(column.dictionary.cast(pa.binary())).to_numpy()
            rank = np.empty(len(order) + 1, np.int64)
            rank[order], rank[-1] = np.arange(1, len(order) + 1), 0
            keys.append(rank[pc.fill_null(column.indices, len(order)).to_numpy(zero_copy_only=False)])
        weights = table.column(longest + 1).to_numpy()
        edges = _edges(keys)
        ends = {tuple(int(keys[k][end]) for k in range(depth + 1)) for depth, end, _ in edges}
        found = {(depth, int(same[0])): int(weights[same].sum()) for depth, _, same in edges}
        for depth, pointer, weight in quicksorted(keys, weights, floor):
            if tuple(int(keys[k][pointer]) for k in range(depth + 1)) not in ends:
                found[depth, pointer] = weight
        rows = [(d, p, w) for (d, p), w in found.items() if d > 0]  # depth 0 is the lang alone
        pointers = pa.array([p for _, p, _ in rows], pa.int64())
        words = [column.take(pointers).to_pylist() for column in names]
        phrases = [" ".join(words[k][i] for k in range(1, d + 1)) for i, (d, _, _) in enumerate(rows)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(words[0], pa.string()), pa.array(phrases, pa.string()), pa.array([w for _, _, w in rows], pa.int64())],
            names=["lang", "phrase", "n"])

    return ranged.mapInArrow(work, "lang string, phrase string, n long")


def phrase_counts(docs: DataFrame, *, floor: int = FLOOR, longest: int = LONGEST,
                  text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all phrases of 1 to `longest` words that occur `floor` times, and (lang, n) of all words.

    Both are stored. Null langs count as `und`, null texts as empty.
    """
    batch_texts(docs.sparkSession)
    own = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].cast("string").alias("text"))
    words = _filter(_word_hashes(own), floor)
    pairs = _filter(_pair_hashes(own, words), floor)
    suffixes = stored(_suffixes(own, longest, words, pairs), "suffixes", "snappy")
    columns = ["lang", *[f"w{k}" for k in range(longest)]]
    width = max(shuffle_width(docs.sparkSession), math.ceil(suffixes.count() / SUFFIXES_A_TASK))
    counted = _counted(suffixes.repartitionByRange(width, *columns), longest, floor)
    counts = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= floor)
    totals = suffixes.groupBy("lang").agg(F.sum("n").alias("n"))
    return stored(counts, "phrase-counts"), stored(totals, "lang-words")


def _with_count(rows: DataFrame, counts: DataFrame, phrase: str, name: str) -> DataFrame:
    """`rows` with the count of the phrase in column `phrase`.

    A phrase may stand in a third of the rows. Those in more than a hundredth are at most
    a hundred, and are joined by broadcast; the rest is joined by shuffle.
    """
    table = counts.select("lang", F.col("phrase").alias(phrase), F.col("n").alias(name))
    keys = rows.groupBy("lang", phrase).agg(F.count("*").alias("_rows"))
    heavy = keys.filter(F.col("_rows") * 100 > rows.count()).drop("_rows")
    heavy = stored(table.join(F.broadcast(heavy), ["lang", phrase]), "heavy-phrases")
    light = rows.join(F.broadcast(heavy), ["lang", phrase], "left_anti").join(table, ["lang", phrase])
    return light.unionByName(rows.join(F.broadcast(heavy), ["lang", phrase]))


def collocations(docs: DataFrame, *, floor: int = FLOOR, longest: int = LONGEST, cover_percent: int = COVER_PERCENT,
                 top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best-scoring phrases of each lang.

    Texts are split at . , ; : ! ? and line ends into pieces, pieces at blanks and tabs into
    words; A-Z are lower-cased. A candidate has 2 to `longest` words and occurs a >= `floor`
    times. Cut after k words, its parts occur l and r times and it scores floor(10^6 a a /
    (l r)); its lowest-scoring cut counts (ties: smallest k). A candidate inside a longer one
    that occurs `cover_percent` of a times or more is dropped. n are all words of the lang.
    Ranks go by score and a, both descending, then by the phrase's bytes; repeated rows
    count repeatedly. Null langs are `und`; null and empty texts and empty tables give
    nothing; other columns are not read. A text of any length is one slice of a task.
    """
    counts, totals = phrase_counts(docs, floor=floor, longest=longest, text=text, lang=lang)
    words = F.split("phrase", " ", -1)
    candidates = counts.withColumn("words", words).filter(F.size("words") > 1).withColumnRenamed("n", "a")
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("words", 1, F.col("k")), " ").alias("left"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("right"))
    cuts = stored(cuts, "phrase-cuts")
    counted = _with_count(_with_count(cuts, counts, "left", "l"), counts, "right", "r")
    exact = "(1000000BD * cast(a AS decimal(19,0)) * cast(a AS decimal(19,0))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"
    scored = counted.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("words") - 1),
        lambda d: F.transform(F.sequence(F.lit(1), F.size("words") - d + 1), lambda i: F.array_join(F.slice("words", i, d), " "))))
    covers = candidates.filter(F.size("words") > 2).select("lang", "a", F.explode(inside).alias("phrase")).groupBy("lang", "phrase").agg(
        F.max("a").alias("longer"))
    kept = scored.join(covers, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < cover_percent * F.col("a")))
    order = W.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
