"""Document fingerprints from improbable byte windows.

Every run of 64 bytes has an entropy, in thousandths of the largest possible. A
first pass counts the entropies of all windows of all documents; the rarer an
entropy, the lower its rank. A window is selected if it is the leftmost one of
lowest rank in at least 16 of the 64-window spans that hold it. Selected windows
are hashed into a chain of Bloom filters of 2048 bits, 160 windows each. A text
that is too short or too regular for that takes its lowest windows at any popularity.

Two fingerprints are compared by the bits their filters share, less what chance
gives, over the most they could share. Each filter of the shorter chain takes its
best partner; the mean is the likeness.

A document meets its successor in a task that holds a range of ids; the first
document of each range is sent to the range before it too, so texts are shuffled
once and no ordered window spans the table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockline.llm.common import batch_texts, hash_spans, keyed, mix64, shuffle_width, slices

WINDOW = 64
SHORT_WINDOW = 16
LEVELS = 1001
PLAIN_LEVEL = 100  # windows of less entropy are taken last
POPULAR = 16
FEW = 4  # a text with fewer popular windows takes the lowest window of every span
SPARSE = 256  # below this size it takes its short windows too, since an edit reaches most long ones
LEAST = 32  # such a text enters its windows under further hashes up to this many, so that chance makes no likeness
FILTER_BITS = 2048
FILTER_WINDOWS = 160
HASHES, HASH_BITS = 5, 11
PIECE = 1 << 15

_counts = np.arange(WINDOW + 1, dtype=np.float64)
_weights = np.round(_counts * np.log2(np.maximum(_counts, 1)) * 65536).astype(np.int64)
_steps = np.diff(_weights)
_most = int(_weights[WINDOW])


class Padded:
    """Texts of a slice laid out with 64 foreign values between them, and their window entropies."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lengths = np.diff(offsets)
        self.lengths = lengths
        self.starts = offsets[:-1] + WINDOW * np.arange(len(lengths))
        self.cells = np.full(int(offsets[-1]) + WINDOW * (len(lengths) + 1), 256, np.uint16)
        for at, low, size in zip(self.starts, offsets, lengths, strict=False):
            self.cells[at : at + size] = data[low : low + size]

    def levels(self) -> np.ndarray:
        """Entropy of the window at each cell, -1 where no whole window of one text starts."""
        cells, size = self.cells, len(self.cells)
        later, earlier = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for low in range(0, size, PIECE):
            for step in range(1, WINDOW):
                high = min(low + PIECE, size - step)
                if high > low:
                    same = cells[low:high] == cells[low + step : high + step]
                    later[low:high] += same
                    earlier[low + step : high + step] += same
        text = cells < 256
        # sum of c * log2(c) over a window: each byte adds its step on entering and takes it on leaving
        entered = np.zeros(size + 1, np.int64)
        np.cumsum(np.where(text, _steps[np.minimum(earlier, WINDOW - 1)], 0), out=entered[1:])
        left = np.zeros(size + 1, np.int64)
        np.cumsum(np.where(text, _steps[np.minimum(later, WINDOW - 1)], 0), out=left[1:])
        out = np.full(size, -1, np.int64)
        full = self.lengths >= WINDOW
        counts = self.lengths[full] - WINDOW + 1
        if len(counts):
            begins = self.starts[full]
            places = np.repeat(begins - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            base = np.repeat(entered[begins] - left[begins], counts)
            sums = entered[places + WINDOW] - left[places] - base
            out[places] = (_most - sums) * (LEVELS - 1) // _most
        return out


def level_ranks(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy level by its count over all windows of all documents, rarest first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0), 1 << 20):
                levels = Padded(data, offsets).levels()
                total += np.bincount(levels[levels >= 0], minlength=LEVELS)
        yield pa.RecordBatch.from_pydict({"level": np.arange(LEVELS), "n": total})

    found = docs.select("text").mapInArrow(work, "level long, n long").groupBy("level").agg(F.sum("n").alias("n"))
    counts = np.zeros(LEVELS, np.int64)
    for level, n in found.collect():  # one row for each level
        counts[level] = n
    plain = np.arange(LEVELS) < PLAIN_LEVEL
    order = np.lexsort((np.arange(LEVELS), counts, plain))
    ranks = np.empty(LEVELS, np.int64)
    ranks[order] = np.arange(LEVELS)
    return ranks


def selected(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of the selected windows of a slice, in order.

    A text of 1 to 63 bytes has too few for a choice: all its windows of 16 bytes are
    taken, or the whole of a shorter one. A longer text with fewer than FEW popular
    windows takes the lowest window of each span, whatever its popularity, and also its
    windows of 16 bytes if it is under SPARSE bytes; so no text of a byte or more is left out.
    """
    laid = Padded(data, offsets)
    levels = laid.levels()
    size = len(levels)
    bits = max(1, int(size).bit_length())
    valid = levels >= 0
    keys = np.where(valid, ranks[np.maximum(levels, 0)] << bits, np.int64(1) << 62) | np.arange(size)
    low, width = keys, 1
    while width < WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = low[valid[: len(low)]]
    held = np.bincount(low & ((1 << bits) - 1), minlength=size)
    cells = np.flatnonzero((held >= POPULAR) & valid)
    owner = np.searchsorted(laid.starts, cells, side="right") - 1
    few = (laid.lengths >= WINDOW) & (np.bincount(owner, minlength=len(laid.lengths)) < FEW)
    cells, owner = cells[~few[owner]], owner[~few[owner]]
    at = cells - WINDOW * owner
    hashes = hash_spans(data, at, at + WINDOW)
    short = np.flatnonzero((laid.lengths > 0) & (laid.lengths < WINDOW))
    if len(short):
        spans = np.minimum(laid.lengths[short], SHORT_WINDOW)
        counts = laid.lengths[short] - spans + 1
        begins = np.concatenate([o + np.arange(c) for o, c in zip(offsets[short], counts, strict=True)])
        hashes = np.concatenate([hashes, hash_spans(data, begins, begins + np.repeat(spans, counts))])
        owner = np.concatenate([owner, np.repeat(short, counts)])
    found, rows = [hashes], [owner]
    for row in np.flatnonzero(few):
        start, length = laid.starts[row], laid.lengths[row]
        begins = offsets[row] + np.flatnonzero(held[start : start + length - WINDOW + 1])
        own = [_filled(hash_spans(data, begins, begins + WINDOW))]
        if length < SPARSE:
            begins = offsets[row] + np.arange(length - SHORT_WINDOW + 1)
            own.append(_filled(hash_spans(data, begins, begins + SHORT_WINDOW)))
        found += own
        rows.append(np.full(sum(map(len, own)), row))
    hashes, owner = np.concatenate(found), np.concatenate(rows)
    if len(short) or few.any():
        order = np.argsort(owner, kind="stable")
        owner, hashes = owner[order], hashes[order]
    return owner, hashes


def _filled(hashes: np.ndarray) -> np.ndarray:
    """Distinct hashes in order, then the same ones mixed anew while there are fewer than LEAST."""
    _, first = np.unique(hashes, return_index=True)
    out = [hashes[np.sort(first)]]
    while len(out) * len(out[0]) < LEAST:
        out.append(mix64(out[-1] + np.uint64(len(out))))
    return np.concatenate(out)


def chains(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> list[np.ndarray]:
    """The Bloom filters of each text, as rows of 256 bytes; no rows for an empty text."""
    owner, hashes = selected(data, offsets, ranks)
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    shifts = (np.arange(HASHES) * HASH_BITS).astype(np.uint64)
    bits = ((hashes[:, None] >> shifts) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    out = []
    for row in range(len(offsets) - 1):
        mine = bits[bounds[row] : bounds[row + 1]]
        number = -(-len(mine) // FILTER_WINDOWS)
        held = np.zeros((number, FILTER_BITS), np.uint8)
        held[np.repeat(np.arange(len(mine)) // FILTER_WINDOWS, HASHES), mine.ravel()] = 1
        out.append(np.packbits(held, axis=1))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for two empty fingerprints, 0 for one."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 1.0 if not len(b) else 0.0
    own_b = np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    total = 0.0
    for one in a:
        own = int(np.bitwise_count(one).sum(dtype=np.int64))
        shared = np.bitwise_count(b & one).sum(axis=1, dtype=np.int64)
        chance = own * own_b / FILTER_BITS
        most = np.minimum(own, own_b)
        total += float(np.clip((shared - chance) / (most - chance), 0.0, 1.0).max())
    return min(1.0, total / len(a))


def text_of(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def _with_successors(own: DataFrame) -> DataFrame:
    """`own` dealt by ranges of (_id, _th): columns text, doc_id, part, tail; sorted in each part.

    The last row of a part (tail = 1) is a copy of the first document of the next one.
    """
    spark = own.sparkSession
    width = shuffle_width(spark)
    cuts = sorted({int(x) for x in own.approxQuantile("_id", [k / width for k in range(1, width)], 0.002)}) if width > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("_id"))) if cuts else F.lit(0)
    placed = own.withColumn("part", part.cast("int"))
    firsts = placed.groupBy("part").agg(F.min(F.struct("_id", "_th")).alias("f")).orderBy("part").collect()  # one row for each part
    if not firsts:
        return placed.withColumn("tail", F.lit(0))
    before = [firsts[-1][0], *[row[0] for row in firsts[:-1]]]
    edges = spark.createDataFrame([(b, row.f._id, row.f._th) for b, row in zip(before, firsts, strict=True)],
                                  "part int, _id long, _th long")
    copies = own.join(F.broadcast(edges), ["_id", "_th"]).select("doc_id", "text", "_id", "_th", "part")
    both = placed.withColumn("tail", F.lit(0)).unionByName(copies.withColumn("tail", F.lit(1)))
    return both.repartition(width, "part").sortWithinPartitions("part", "tail", "_id", "_th")


def fingerprints(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text replaces the last quarter of the code points (rounded down) by
    the first as many of the next document in ascending doc_id, the first document
    following the last. A null id sorts first; equal ids are ordered by the text's
    hash; of repeated rows each follows the other. A null text is empty; its
    fingerprint is the empty string. Other columns are not read.
    """
    batch_texts(docs.sparkSession)
    own = keyed(docs, text, id_column)
    ranks = level_ranks(own)  # 1001 numbers
    dealt = _with_successors(own).select("doc_id", "text", "part", "tail")

    def prints(texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for _, _, data, offsets in slices(pa.array(texts, pa.large_string()), 1 << 20):
            out += chains(data, offsets, ranks)
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, waiting for its successor: (doc_id, text, part)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                some = batch.slice(low, 1000).to_pydict()
                rows = list(zip(some["doc_id"], [t or "" for t in some["text"]], some["part"], some["tail"], strict=True))
                if held is not None:
                    rows.insert(0, held)
                held = rows[-1]
                pairs = [(k, k + 1) for k in range(len(rows) - 1) if not rows[k][3] and rows[k][2] == rows[k + 1][2]]
                if not pairs:
                    continue
                plain = prints([r[1] for r in rows])
                edited = []
                for k, n in pairs:
                    value = rows[k][1]
                    cut = len(value) // 4
                    edited.append(value[: len(value) - cut] + rows[n][1][:cut])
                changed = prints(edited)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rows[k][0] for k, _ in pairs], pa.int64()),
                        pa.array([len(rows[k][1]) for k, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                        pa.array([text_of(plain[k]) for k, _ in pairs], pa.string()),
                        pa.array([text_of(c) for c in changed], pa.string()),
                        pa.array([likeness(plain[k], c) for (k, _), c in zip(pairs, changed, strict=True)], pa.float64()),
                        pa.array([likeness(plain[k], plain[n]) for k, n in pairs], pa.float64()),
                    ],
                    names=names,
                )

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    return dealt.mapInArrow(work, schema)
