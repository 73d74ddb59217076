"""Repeated passages by super-k-mer partitioning.

A window is `size` consecutive words. Its minimiser is the smallest hash among
its runs of `run` words; consecutive windows of one minimiser form a super-k-mer
and travel as one packed string (words joined by a space) to the minimiser's
bucket. There the windows of all strings are sorted, and the first occurrence of
each window in document order owns it. A word is removed if a window over it is
owned elsewhere.

Equal windows have equal minimisers, so a minimiser that occurs once in the corpus
cannot hold a repeat. Minimisers are counted first, and a bitmap of fixed size of
those seen twice keeps the other strings from being shipped. The bitmap only saves
work: a set bit of another minimiser lets a string through in vain.

A string is moved once. All windows of a copy of an earlier string are owned elsewhere,
so only the first copy a task meets carries its words to the bucket; later ones are
passed on as spans, dealt evenly. A passage shared by a third of all rows is a few
strings a task in its bucket. A bucket with more than `HOT_STRINGS` different strings
is not sorted in its task; its windows are passed on one by one and grouped by their
own hash, which spreads them over all tasks. Windows are compared by 128-bit hashes of
their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockline.llm.common import Words, batch_texts, keyed, mix64, slices, stored, windows

WINDOW_WORDS = 20
RUN_WORDS = 5
FILTER_BITS = 26
HOT_STRINGS = 20_000
KNOWN_STRINGS = 100_000
_second = np.uint64(0x5851F42D4C957F2D)


def super_kmers(words: np.ndarray, size: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of each super-k-mer of one text."""
    low = windows(words, run)
    span, width = size - run + 1, 1
    if len(words) < size:
        return low[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    while width < span:  # minima over 2, 4, ... up to `span` runs
        step = min(width, span - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    starts = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    return low[starts], starts, np.diff(np.append(starts, len(low)))


def text_windows(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, row, first word) of every window of the texts, in their order.

    A slice is hashed as one run of words; windows over the end of a text are left out.
    """
    found = []
    for begin, _, data, offsets in slices(column):
        words = Words(data, offsets)
        counts = np.maximum(np.diff(words.first) - size + 1, 0)
        offs = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(words.first[:-1], counts) + offs
        one, two = windows(words.hashes, size), windows(mix64(words.hashes ^ _second), size)
        found.append((one[at], two[at], begin + np.repeat(np.arange(len(counts)), counts), offs))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _minimisers(docs: DataFrame, size: int, run: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in slices(batch.column(0)):
                words = Words(data, offsets)
                found = []
                for row in range(stop - start):
                    hashes = words.of(row)
                    runs = windows(hashes, run)
                    # by place, not by super-k-mer: a periodic text repeats windows inside one
                    found.append(runs[np.isin(runs, super_kmers(hashes, size, run)[0])])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["mini"])

    return docs.select("text").mapInArrow(work, "mini long")


def repeated_filter(docs: DataFrame, size: int, run: int, bits: int = FILTER_BITS) -> bytes:
    """Bitmap of 2^bits positions, set for the minimisers that occur at least twice."""
    twice = _minimisers(docs, size, run).groupBy("mini").agg(F.count("*").alias("n")).filter("n > 1")
    place = F.col("mini").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    pages = (
        twice.groupBy(F.bitmap_bucket_number(place).alias("page"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("set"))
        .collect()  # 2^bits / 32768 pages of 4 KB at most
    )
    out = np.zeros(1 << (bits - 3), np.uint8)
    for page, held in pages:
        out[(page - 1) * 4096 : page * 4096] = np.frombuffer(held, np.uint8)
    return out.tobytes()


def _strings(docs: DataFrame, size: int, run: int, allowed: bytes) -> DataFrame:
    """(mini, packed, _id, _th, start, n_windows) of the super-k-mers that may repeat.

    A string that its task has met at an earlier place has no packed words, and its mini only deals it to a task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(allowed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        mask = np.uint64(len(bits) * 8 - 1)
        known: dict[bytes, tuple[int, int, int]] = {}  # earliest place of each string so far
        for batch in batches:
            ids, hashes = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for begin, stop, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets)
                minis, packed, places, number = [], [], [], []
                for row in range(stop - begin):
                    mini, starts, counts = super_kmers(words.of(row), size, run)
                    place = mini & mask
                    wanted = np.flatnonzero(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                    if not len(wanted):
                        continue
                    pieces = data[offsets[row] : offsets[row + 1]].tobytes().split()
                    of_id, of_text = ids[begin + row], hashes[begin + row]
                    for key, at, n in zip(mini[wanted].tolist(), starts[wanted].tolist(), counts[wanted].tolist(), strict=True):
                        string = b" ".join(pieces[at : at + n + size - 1])
                        digest = hashlib.blake2b(string, digest_size=16).digest()
                        own, first = (of_id, of_text, at), known.get(digest)
                        if own == first:  # the same document again
                            continue
                        if first is None or own < first:
                            known[digest] = own
                        else:
                            string, key = None, hash(own) & (1 << 64) - 1
                        minis.append(key)
                        packed.append(string)
                        places.append(own)
                        number.append(n)
                    if len(known) > KNOWN_STRINGS:
                        known.clear()
                if places:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.array(minis, np.uint64).view(np.int64)),
                            pa.array(packed, pa.binary()),
                            *(pa.array(column, pa.int64()) for column in zip(*places, strict=True)),
                            pa.array(number, pa.int64()),
                        ],
                        names=["mini", "packed", "_id", "_th", "start", "n_windows"],
                    )

    return docs.mapInArrow(work, "mini long, packed binary, _id long, _th long, start long, n_windows long")


def _sorted_buckets(strings: DataFrame, size: int) -> DataFrame:
    """(_id, _th, a, b) of the windows [a, b) owned elsewhere, or single windows of hot buckets.

    Takes strings by mini, equal ones together and the earliest first. A hot bucket's
    row is one window [a, a + 1) of a string's earliest copy and has its hashes w1 and w2.
    """
    names = ["_id", "_th", "a", "b", "w1", "w2"]
    places = ["_id", "_th", "start"]

    def expand(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        column = table.column("packed").combine_chunks().cast(pa.large_binary())
        column = pa.Array.from_buffers(pa.large_string(), len(column), column.buffers(), offset=column.offset)
        return text_windows(column, size)

    def spans(table: pa.Table, rows: np.ndarray, a: np.ndarray, b: np.ndarray, *hashes: np.ndarray) -> pa.RecordBatch:
        who = [pa.array(table.column(n).to_numpy()[rows]) for n in names[:2]]
        marks = [pa.array(h.view(np.int64)) for h in hashes] or [pa.nulls(len(rows), pa.int64())] * 2
        return pa.RecordBatch.from_arrays([*who, pa.array(a, pa.int64()), pa.array(b, pa.int64()), *marks], names=names)

    def whole(table: pa.Table) -> pa.RecordBatch:
        a = table.column("start").to_numpy()
        return spans(table, np.arange(len(a)), a, a + table.column("n_windows").to_numpy())

    def loose(table: pa.Table) -> pa.RecordBatch:
        one, two, rows, offs = expand(table)
        a = table.column("start").to_numpy()[rows] + offs
        return spans(table, rows, a, a + 1, one, two)

    def lost(table: pa.Table) -> pa.RecordBatch:
        one, two, rows, offs = expand(table)
        rank = np.empty(table.num_rows, np.int64)
        rank[np.lexsort([table.column(n).to_numpy() for n in reversed(places)])] = np.arange(table.num_rows)
        # the super-k-mers of a text do not share windows, so string order is window order
        order = np.lexsort((rank[rows] << 32 | offs, two, one))
        one, two = one[order], two[order]
        again = np.zeros(len(one), bool)
        again[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        gone = np.sort(order[again])  # windows are numbered by string and offset, so runs of them are spans
        rows, offs = rows[gone], offs[gone]
        cuts = np.flatnonzero((np.diff(gone) != 1) | (np.diff(rows) != 0)) + 1
        begins, ends = np.append(0, cuts)[: len(gone)], np.append(cuts, len(gone))[: len(gone)] - 1
        start = table.column("start").to_numpy()[rows[begins]]
        return spans(table, rows[begins], start + offs[begins], start + offs[ends] + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, hot, last, first = None, None, None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            copies = table.filter(pc.is_null(table.column("packed")))
            if copies.num_rows:
                yield whole(copies)
                table = table.filter(pc.is_valid(table.column("packed")))
            if not table.num_rows:
                continue
            strings = table.column("packed").combine_chunks()
            fresh = np.ones(len(strings), bool)
            fresh[1:] = pc.not_equal(strings.slice(1), strings.slice(0, len(strings) - 1)).to_numpy(zero_copy_only=False)
            fresh[0] = strings[0].as_py() != last
            own = np.stack([table.column(n).to_numpy() for n in places])
            firsts = own[:, np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))]
            if not fresh[0]:  # a string that the batch before began
                firsts[:, : int(np.argmax(fresh)) or len(fresh)] = first[:, None]
            last, first = strings[-1].as_py(), firsts[:, -1]
            later = ~fresh & (own != firsts).any(axis=0)  # else the same document again
            if later.any():
                yield whole(table.filter(pa.array(later)))
            table = table.filter(pa.array(fresh))
            if not table.num_rows:
                continue
            minis = table.column("mini").to_numpy()
            if hot is not None:
                same = int(np.searchsorted(minis, hot, side="right"))
                if same:
                    yield loose(table.slice(0, same))
                table = table.slice(same)
                if not table.num_rows:
                    continue
                hot = None
            table = table if pending is None else pa.concat_tables([pending, table])
            minis = table.column("mini").to_numpy()
            cut = int(np.searchsorted(minis, minis[-1], side="left"))
            if cut:
                yield lost(table.slice(0, cut))
            pending = table.slice(cut)
            if pending.num_rows > HOT_STRINGS:
                hot = minis[-1]
                yield loose(pending)
                pending = None
        if pending is not None and pending.num_rows:
            yield lost(pending)

    return strings.mapInArrow(work, "_id long, _th long, a long, b long, w1 long, w2 long")


def repeated_windows(docs: DataFrame, *, size: int = WINDOW_WORDS, run: int = RUN_WORDS) -> DataFrame:
    """(_id, _th, spans) of a `keyed` frame: the windows [a, b) whose words also start earlier."""
    allowed = repeated_filter(docs, size, run)
    strings = _strings(docs, size, run, allowed)
    ordered = strings.repartition("mini").sortWithinPartitions("mini", "packed", "_id", "_th", "start")
    found = stored(_sorted_buckets(ordered, size), "superkmer-spans")
    loose = found.filter("w1 IS NOT NULL")
    owners = loose.groupBy("w1", "w2").agg(F.min(F.struct("_id", "_th", "a")).alias("o")).select("o.*")
    spans = found.filter("w1 IS NULL").select("_id", "_th", "a", "b").unionByName(
        loose.select("_id", "_th", "a", "b").join(owners, ["_id", "_th", "a"], "left_anti")
    )
    return spans.groupBy("_id", "_th").agg(
        F.collect_list(F.struct("a", "b")).alias("spans")  # at most the windows of one text
    )


def without_repeats(docs: DataFrame, *, size: int = WINDOW_WORDS, run: int = RUN_WORDS,
                    text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    Windows are judged on the input: "earlier" means a smaller doc_id (null first;
    equal ids by the text's hash), or an earlier start in the same text. Rows equal
    in id and text are one document and get equal results. Null and empty texts
    and texts shorter than a window lose nothing. Other columns are not read.
    """
    batch_texts(docs.sparkSession)
    own = keyed(docs, text, id_column)
    joined = own.join(repeated_windows(own, size=size, run=run), ["_id", "_th"], "left").select("doc_id", "text", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for value, spans in zip(batch.column(1), batch.column(2), strict=True):
                pieces = (value.as_py() or "").encode().split()
                total.append(len(pieces))
                if spans.is_valid:
                    steps = np.zeros(len(pieces) + 1, np.int64)
                    edges = spans.values
                    np.add.at(steps, edges.field("a").to_numpy(), 1)
                    np.add.at(steps, edges.field("b").to_numpy() + size - 1, -1)
                    keep = np.cumsum(steps[:-1]) == 0
                    pieces = [p for p, k in zip(pieces, keep.tolist(), strict=True) if k]
                gone.append(total[-1] - len(pieces))
                kept.append(b" ".join(pieces).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(work, "doc_id long, n_words long, n_removed long, kept_text string")
