"""Token ids in files of an adaptive context-mixing range coder.

A file image holds the ids of consecutive documents, cut into blocks of
`BLOCK_IDS` that start from a fresh model, end with their own stream and carry a
CRC-32 of their ids, so a block can be checked and decoded by itself.

Model of a block. Two tables remember the id that last followed the previous two
ids (order 2, hashed) and the previous one (order 1, hashed), each with a
confidence. The candidate is the order-2 id, or the order-1 id where order 2 knows
none. Three adaptive probabilities that the candidate is right, for the order-2
confidence, for the order-1 confidence and agreement, and for the block at large
(order 0), are mixed in the logistic domain with weights learned as it goes; the
mixed probability drives one binary coding step. A wrong candidate is followed by
the id itself, digit by digit (base 16), under order-0 counts of the digits with
their prefix as context. All arithmetic is in integers.

The blocks of an image advance in step, one numpy lane each, which is what keeps
the work per id small. The image is one binary cell of a Parquet table; its bytes
are the file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockline.llm.common import batch_texts, keyed, shuffle_width

MAGIC = b"IDCM\x01"
BLOCK_IDS = 4096
IMAGE_IDS = 1 << 22
LANES = 1024
PIECES = 250_000
JOINED = 64

ORDER2_BITS, ORDER1_BITS = 11, 10
DIGIT_CONTEXTS = 512
GAIN, MOST = 24, 4000
RATE = 5
MOST_WEIGHT = 1 << 17
# three coding steps of 12 bits each fit between two settlements
TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 44)
_unit = np.uint64(16)

_p = (np.arange(4096) + 0.5) / 4096
STRETCH = np.round(np.log(_p / (1 - _p)) * 256).astype(np.int32)
SQUASH = np.clip(np.round(4096 / (1 + np.exp(-np.arange(-2048, 2048) / 256))), 1, 4095).astype(np.int32)
SURER = np.array([1, 1, 1, 2, 1, 2, 3, 3], np.int32)  # confidence after a wrong and after a right guess
ADDED = (GAIN * (np.arange(17)[None, :] > np.arange(16)[:, None])).astype(np.uint16)


class Model:
    """State of n blocks. Tables of all blocks lie in flat arrays, addressed by lane."""

    def __init__(self, n: int, digits: int):
        lane = np.arange(n)
        self.last = np.zeros(n, np.int64)
        self.before = np.zeros(n, np.int64)
        self.base2, self.base1, self.base0 = lane << ORDER2_BITS, lane << ORDER1_BITS, lane * 13
        self.seen2 = np.zeros(n << ORDER2_BITS, np.int32)  # id << 2 | confidence
        self.seen1 = np.zeros(n << ORDER1_BITS, np.int32)
        self.rates = np.full(n * 13, 1 << 14, np.int32)  # 16-bit probabilities: 4 by order 2, 8 by order 1, 1 at large
        self.weights = [np.full(n, 22000, np.int32) for _ in range(3)]  # 65536 is 1
        self.digits = digits
        # running counts of the 16 digits, from 0 to the total, for each lane and context
        self.contexts = [min(16**d, DIGIT_CONTEXTS) for d in range(digits)]
        self.counts = [np.tile(np.arange(17, dtype=np.uint16), (n * c, 1)) for c in self.contexts]

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Candidate id of each lane and its probability in 4096ths."""
        mixed = self.last * 0x9E3779B1
        self.at2 = self.base2 + (mixed + self.before * 0x85EBCA6B >> 8 & (1 << ORDER2_BITS) - 1)
        self.at1 = self.base1 + (mixed >> 8 & (1 << ORDER1_BITS) - 1)
        held2, held1 = self.seen2.take(self.at2), self.seen1.take(self.at1)
        self.guess2, self.guess1, self.sure2, self.sure1 = held2 >> 2, held1 >> 2, held2 & 3, held1 & 3
        candidate = np.where(self.sure2 > 0, self.guess2, self.guess1)
        self.slots = (self.base0 + self.sure2, self.base0 + (self.sure1 * 2 + (candidate == self.guess1) + 4), self.base0 + 12)
        self.rate = [self.rates.take(slot) for slot in self.slots]
        self.inputs = [STRETCH.take(rate >> 4) for rate in self.rate]
        dot = sum(w * x for w, x in zip(self.weights, self.inputs, strict=True)) >> 16
        self.odds = SQUASH.take(np.minimum(np.maximum(dot, -2048), 2047) + 2048)
        return candidate, self.odds

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        error = (hit << 12) - self.odds
        goal = hit * 65535
        for weight, value, slot, rate in zip(self.weights, self.inputs, self.slots, self.rate, strict=True):
            weight += value * error >> 10
            np.minimum(np.maximum(weight, -MOST_WEIGHT, out=weight), MOST_WEIGHT, out=weight)
            self.rates[slot] = rate + (goal - rate >> RATE)
        for guess, sure, table, at in ((self.guess2, self.sure2, self.seen2, self.at2), (self.guess1, self.sure1, self.seen1, self.at1)):
            same = guess == ids
            table[at] = np.where(same | (sure > 1), guess, ids) << 2 | SURER.take(sure + 4 * same)
        self.before, self.last = self.last, ids.astype(np.int64)

    def row(self, digit: int, lanes: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table, running counts) under the digits before this one."""
        number = self.contexts[digit]
        context = prefix if 16**digit <= DIGIT_CONTEXTS else prefix * 0x9E3779B1 >> 7 & DIGIT_CONTEXTS - 1
        at = lanes * number + context
        return at, self.counts[digit].take(at, axis=0)

    def count(self, digit: int, at: np.ndarray, upto: np.ndarray, value: np.ndarray) -> None:
        upto += ADDED.take(value, axis=0)
        full = np.flatnonzero(upto[:, 16] > MOST)
        if len(full):
            own = np.diff(upto[full].astype(np.int64), axis=1)
            upto[full, 1:] = np.cumsum(own - (own >> 1), axis=1)
        self.counts[digit][at] = upto


def encode_blocks(ids: np.ndarray, digits: int) -> list[bytes]:
    """Streams of the rows of `ids` (n, steps)."""
    n, steps = ids.shape
    model = Model(n, digits)
    low, span = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    out, size = np.zeros((n, steps + 64), np.uint16), np.zeros(n, np.int64)

    def settle(lanes: np.ndarray | None) -> None:
        nonlocal out
        while True:
            own, width = (low, span) if lanes is None else (low.take(lanes), span.take(lanes))
            fixed = (own ^ (own + width)) < TOP
            move = np.flatnonzero(fixed | (width < BOTTOM))
            if not len(move):
                return
            tight = move[~fixed[move]]
            some = move if lanes is None else lanes[move]
            if len(tight):
                span[tight if lanes is None else lanes[tight]] = (~own[tight] + np.uint64(1)) & (BOTTOM - np.uint64(1))
            lanes = some
            if size[lanes].max() >= out.shape[1]:
                out = np.concatenate([out, np.zeros_like(out)], axis=1)
            out[lanes, size[lanes]] = low[lanes] >> np.uint64(48)
            size[lanes] += 1
            low[lanes] <<= _unit
            span[lanes] <<= _unit

    columns = np.ascontiguousarray(ids.T)
    for step in range(steps):
        now = columns[step]
        settle(None)
        candidate, odds = model.predict()
        hit = now == candidate
        part = (span >> np.uint64(12)) * odds.astype(np.uint64)
        low += np.where(hit, np.uint64(0), part)
        span = np.where(hit, part, span - part)
        miss = np.flatnonzero(~hit)
        if len(miss):
            value = now[miss].astype(np.int64)
            place = np.arange(len(miss)) * 17
            for digit in range(digits):
                shift = 4 * (digits - 1 - digit)
                own = value >> shift & 15
                at, upto = model.row(digit, miss, value >> shift + 4)
                flat = upto.ravel()
                below = flat.take(place + own).astype(np.uint64)
                many = flat.take(place + (own + 1)).astype(np.uint64) - below
                share = span.take(miss) // upto[:, 16]
                low[miss] += share * below
                span[miss] = share * many
                model.count(digit, at, upto, own)
                if digit % 2 and digit < digits - 1:
                    settle(miss)
        model.learn(now, hit)
    settle(None)
    return [
        out[lane, : size[lane]].astype(">u2").tobytes() + int(low[lane]).to_bytes(8, "big") for lane in range(n)
    ]


def decode_blocks(streams: list[bytes], steps: int, digits: int) -> np.ndarray:
    """The ids (n, steps) of the streams; rows of shorter blocks are padded."""
    n = len(streams)
    model = Model(n, digits)
    longest = max(len(s) for s in streams) // 2 + 8
    units = np.zeros((n, longest), np.uint16)
    for lane, stream in enumerate(streams):
        got = np.frombuffer(stream, ">u2")
        units[lane, : len(got)] = got
    low, span = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    code = np.zeros(n, np.uint64)
    for k in range(4):
        code = code << _unit | units[:, k]
    at_unit = np.full(n, 4, np.int64)
    ids = np.zeros((steps, n), np.int32)

    def settle(lanes: np.ndarray | None) -> None:
        while True:
            own, width = (low, span) if lanes is None else (low.take(lanes), span.take(lanes))
            fixed = (own ^ (own + width)) < TOP
            move = np.flatnonzero(fixed | (width < BOTTOM))
            if not len(move):
                return
            tight = move[~fixed[move]]
            some = move if lanes is None else lanes[move]
            if len(tight):
                span[tight if lanes is None else lanes[tight]] = (~own[tight] + np.uint64(1)) & (BOTTOM - np.uint64(1))
            lanes = some
            code[lanes] = code[lanes] << _unit | units[lanes, np.minimum(at_unit[lanes], longest - 1)]
            at_unit[lanes] += 1
            low[lanes] <<= _unit
            span[lanes] <<= _unit

    for step in range(steps):
        settle(None)
        candidate, odds = model.predict()
        part = (span >> np.uint64(12)) * odds.astype(np.uint64)
        hit = code - low < part
        low += np.where(hit, np.uint64(0), part)
        span = np.where(hit, part, span - part)
        now = candidate.astype(np.int32)
        miss = np.flatnonzero(~hit)
        if len(miss):
            value = np.zeros(len(miss), np.int64)
            place = np.arange(len(miss)) * 17
            for digit in range(digits):
                at, upto = model.row(digit, miss, value)
                flat = upto.ravel()
                total = upto[:, 16]
                share = span.take(miss) // total
                target = np.minimum((code.take(miss) - low.take(miss)) // share, total - np.uint64(1)).astype(np.uint16)
                own = np.count_nonzero(upto[:, 1:16] <= target[:, None], axis=1)
                below = flat.take(place + own).astype(np.uint64)
                many = flat.take(place + (own + 1)).astype(np.uint64) - below
                low[miss] += share * below
                span[miss] = share * many
                model.count(digit, at, upto, own)
                if digit % 2 and digit < digits - 1:
                    settle(miss)
                value = value << 4 | own
            now[miss] = value
        ids[step] = now
        model.learn(now, hit)
    return ids.T


def write_image(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One file: header, documents, block table, streams."""
    digits = max(1, -(-int(ids.max()).bit_length() // 4)) if len(ids) else 1
    blocks = -(-len(ids) // BLOCK_IDS)
    padded = np.zeros((blocks, BLOCK_IDS), np.int32)
    padded.reshape(-1)[: len(ids)] = ids
    streams: list[bytes] = []
    for lane in range(0, blocks, LANES):
        some = padded[lane : lane + LANES]
        used = min(BLOCK_IDS, len(ids) - lane * BLOCK_IDS)  # shorter for a lone last block
        streams += encode_blocks(some[:, :used], digits)
    sums = [zlib.crc32(ids[k * BLOCK_IDS : (k + 1) * BLOCK_IDS].astype("<u4").tobytes()) for k in range(blocks)]
    head = MAGIC + struct.pack("<IIQIQ", digits, BLOCK_IDS, len(ids), blocks, len(doc_ids))
    documents = np.array([d if d is not None else 0 for d in doc_ids], "<i8").tobytes()
    documents += np.array([d is None for d in doc_ids], "u1").tobytes() + np.array(lengths, "<u8").tobytes()
    table = np.array([len(s) for s in streams], "<u4").tobytes() + np.array(sums, "<u4").tobytes()
    return head + documents + table + b"".join(streams)


def read_image(image: bytes) -> tuple[list[int | None], list[int], np.ndarray]:
    """(doc_ids, lengths, ids) of a file; ValueError if a checksum does not match."""
    if not image.startswith(MAGIC):
        raise ValueError("not a file of this format")
    at = len(MAGIC)
    digits, block, count, blocks, documents = struct.unpack_from("<IIQIQ", image, at)
    at += struct.calcsize("<IIQIQ")

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(image, kind, n, at)
        at += got.nbytes
        return got

    names, none, lengths = take("<i8", documents), take("u1", documents), take("<u8", documents)
    sizes, sums = take("<u4", blocks), take("<u4", blocks)
    bounds = at + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    streams = [image[bounds[k] : bounds[k + 1]] for k in range(blocks)]
    ids = np.zeros(blocks * block, np.int32)
    for lane in range(0, blocks, LANES):
        used = min(block, count - lane * block)
        got = decode_blocks(streams[lane : lane + LANES], used, digits)
        ids.reshape(blocks, block)[lane : lane + LANES, :used] = got
    ids = ids[:count]
    for k in range(blocks):
        if zlib.crc32(ids[k * block : (k + 1) * block].astype("<u4").tobytes()) != sums[k]:
            raise ValueError(f"checksum of block {k} does not match")
    doc_ids = [None if gone else int(d) for d, gone in zip(names, none, strict=True)]
    return doc_ids, [int(x) for x in lengths], ids


class Pieces:
    """Ids of texts by a tokenizer file; pieces between white space are encoded once and remembered.

    For tokenizers whose splitting removes white space, so that it separates pieces in any text.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """Little-endian 32-bit ids of each text and the end id."""
        split = [text.encode().split() for text in texts]
        if len(self.known) > PIECES:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        new = []
        for pieces in split:
            for piece in set(pieces):
                if piece not in known:
                    if piece in old:
                        known[piece] = old[piece]
                    else:
                        known[piece] = b""
                        new.append(piece)
        for low in range(0, len(new), JOINED):
            # one call for many pieces, told apart by the places of their tokens
            some = new[low : low + JOINED]
            words = [piece.decode() for piece in some]
            coded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
            starts = np.array([start for start, _ in coded.offsets], np.int64)
            cuts = np.searchsorted(starts, np.cumsum([len(word) + 1 for word in words])).tolist()
            ids, at = np.array(coded.ids, "<u4"), 0
            for piece, cut in zip(some, cuts, strict=True):
                known[piece] = ids[at:cut].tobytes()
                at = cut
        end = struct.pack("<I", end_id)
        return [b"".join([known[p] for p in pieces]) + end for pieces in split]


_pieces: dict[str, Pieces] = {}


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, *, text: str = "text", id_column: str = "doc_id") -> None:
    """Write the ids of all documents, in ascending doc_id order, as images in `folder`.

    Texts are dealt to ranges of ids by one shuffle and coded where they arrive.
    Columns: part (number of the range), before (ids of the part in earlier images),
    n_ids, image.
    """
    spark = docs.sparkSession
    batch_texts(spark)
    own = keyed(docs, text, id_column)
    width = shuffle_width(spark)
    cuts = sorted({int(x) for x in own.approxQuantile("_id", [k / width for k in range(1, width)], 0.002)}) if width > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("_id"))) if cuts else F.lit(0)
    dealt = own.withColumn("part", part.cast("int")).repartition(width, "part").sortWithinPartitions("part", "_id", "_th")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _pieces:
            _pieces[tokenizer] = Pieces(tokenizer)
        coder = _pieces[tokenizer]
        held: list[bytes] = []
        names: list[int | None] = []
        current, before, size = None, 0, 0

        def image() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            made = write_image(names, [len(h) // 4 for h in held], ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([made], pa.binary())],
                names=["part", "before", "n_ids", "image"])

        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                some = batch.slice(low, 500).to_pydict()
                coded = coder.encode([t or "" for t in some["text"]], end_id)
                for name, place, ids in zip(some["doc_id"], some["part"], coded, strict=True):
                    if held and (place != current or size >= IMAGE_IDS):
                        yield image()
                        before += size
                        held, names, size = [], [], 0
                    if place != current:
                        current, before = place, 0
                    held.append(ids)
                    names.append(name)
                    size += len(ids) // 4
        if held:
            yield image()

    files = dealt.select("doc_id", "text", "part").mapInArrow(work, "part int, before long, n_ids long, image binary")
    files.write.option("compression", "none").parquet(folder)


def read_ids(spark, folder: str, *, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of all documents in the images of `folder`."""
    files = spark.read.parquet(folder)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row for each range
    begins, total = {}, 0
    for row in sorted(totals):
        begins[row.part] = total
        total += row.n

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, image in zip(*(batch.column(k) for k in range(3)), strict=True):
                names, lengths, ids = read_image(image.as_py())
                start = begins[part.as_py()] + before.as_py()
                starts, sums, cells, at = [], [], [], 0
                for size in lengths:
                    data = ids[at : at + size].astype("<u4").tobytes()
                    starts.append(start + at)
                    sums.append(zlib.crc32(data))
                    if keep_ids:
                        cells.append(data)
                    at += size
                columns = [pa.array(x, pa.int64()) for x in (names, starts, lengths, sums)]
                yield pa.RecordBatch.from_arrays(
                    columns + ([pa.array(cells, pa.binary())] if keep_ids else []), names=columns_out)

    columns_out = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    return files.select("part", "before", "image").mapInArrow(work, schema)


def round_trip(docs: DataFrame, folder: str, tokenizer: str, end_id: int, *, text: str = "text",
               id_column: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """Write `docs` and read the files back.

    A null or empty text is the end id alone. A null doc_id comes first; equal ids
    are in the order of the text's hash; repeated rows stand one after the other; an
    empty table gives no rows. Other columns are not read.
    """
    write_ids(docs, folder, tokenizer, end_id, text=text, id_column=id_column)
    return read_ids(docs.sparkSession, folder, keep_ids=keep_ids)
