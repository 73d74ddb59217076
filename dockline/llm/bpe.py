"""Byte-level BPE: encode whole texts to ids, decode ids to bytes.

Two tiers. A minimal perfect hash over the vocabulary (hash and displace: one
displacement per bucket, as many slots as tokens) resolves a pre-token that is a
token by itself; the slot's token is compared with the pre-token, so a stranger
never passes. Any other pre-token is merged by a heap of (rank, position) over a
doubly linked list of its bytes, O(n log n) also for a pre-token of megabytes.

The table is built once on the driver (the vocabulary bounds its size) and
broadcast. Work is row-local: no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from dockline.llm.common import batch_texts

MEMO_ENTRIES = 250_000
# nothing is shared within a batch; its texts, ids and their copies on the way to the JVM are held at once
BATCH_BYTES = 2 << 20
MASK = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 token, space, rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def _slot(key: int, displacement: int, size: int) -> int:
    x = (key + displacement * 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 31)) * 0xD6E8FEB86659FD93) & MASK
    return (x ^ (x >> 32)) % size


class PerfectHash:
    """Minimal perfect hash of byte strings: `find` gives a slot in range(len(keys))."""

    def __init__(self, keys: list[bytes]):
        self.size = len(keys)
        self.buckets = max(1, self.size // 2)
        hashed = [xxhash.xxh3_64_intdigest(key) for key in keys]
        if len(set(hashed)) != self.size:
            raise ValueError("two tokens share their 64-bit hash")
        groups: dict[int, list[int]] = {}
        for index, key in enumerate(hashed):
            groups.setdefault(key % self.buckets, []).append(index)
        self.displacement = [0] * self.buckets
        self.order = [-1] * self.size  # the key held by each slot
        singles = []
        for bucket, members in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(members) == 1:
                singles.append((bucket, members[0]))
                continue
            step = 0
            while True:
                slots = {_slot(hashed[i], step, self.size) for i in members}
                if len(slots) == len(members) and all(self.order[s] < 0 for s in slots):
                    break
                step += 1
            self.displacement[bucket] = step
            for i in members:
                self.order[_slot(hashed[i], step, self.size)] = i
        free = (s for s in range(self.size) if self.order[s] < 0)
        for bucket, i in singles:  # a bucket of one names its slot directly
            slot = next(free)
            self.displacement[bucket] = -slot - 1
            self.order[slot] = i

    def find(self, key: bytes) -> int:
        hashed = xxhash.xxh3_64_intdigest(key)
        step = self.displacement[hashed % self.buckets]
        return -step - 1 if step < 0 else _slot(hashed, step, self.size)


class Memo(dict):
    """Results by key in two generations: a full one becomes the old one, which is asked before computing."""

    def __init__(self, compute, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.entries, self.old = compute, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pairs = {tuple(token): rank for token, rank in ranks.items() if len(token) == 2}
        self.tokens = {rank: token for token, rank in ranks.items()}
        keys = list(ranks)
        self.table = PerfectHash(keys)
        self.held = [keys[i] for i in self.table.order]
        self.pattern = pattern
        self.ready()

    def ready(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.pieces = Memo(self._piece)
        self.chunks = Memo(self._chunk)

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k not in ("find", "pieces", "chunks")}

    def __setstate__(self, state):
        vars(self).update(state)
        self.ready()

    def _piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        token = self.held[self.table.find(data)] if self.held else None
        if token == data:
            return pack("<I", self.ranks[token])
        ids = self.merge(data)
        return pack(f"<{len(ids)}I", *ids)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token: merge the adjacent pair of lowest rank, the leftmost first."""
        size, get = len(data), self.ranks.get
        width = size.bit_length()
        high, low = 2 * width, (1 << width) - 1  # a heap entry holds rank, start and stop in one integer
        end = list(range(1, size + 1))  # a part starts at i and the next one at end[i]; 0 if merged away
        before = list(range(-1, size - 1))
        heap = [
            rank << high | i << width | i + 2
            for i, rank in enumerate(map(self.pairs.get, zip(data, data[1:])))
            if rank is not None
        ]
        heapify(heap)
        while heap:
            key = heappop(heap)
            stop, i = key & low, key >> width & low
            j = end[i]
            if not j or j >= stop or end[j] != stop:
                continue  # a part of this pair has been merged meanwhile
            end[i], end[j] = stop, 0
            if stop < size:
                before[stop] = i
                far = end[stop]
                rank = get(data[i:far])
                if rank is not None:
                    heappush(heap, rank << high | i << width | far)
            p = before[i]
            if p >= 0:
                rank = get(data[p:stop])
                if rank is not None:
                    heappush(heap, rank << high | p << width | stop)
        ids, i = [], 0
        while i < size:
            j = end[i]
            ids.append(get(data[i:j]))
            i = j
        return ids

    def _chunk(self, chunk: str) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[p] for p in self.find(chunk)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A space between two characters that are no white space always starts a
        pre-token, so what lies between such spaces can be looked up as a whole.
        """
        chunks = self.chunks
        return b"".join([chunks[c] for c in _inner_space.split(text)])

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


# \s of `re` is wider than any definition of white space the pattern may use
_inner_space = re.compile(r"(?<=\S)(?= \S)")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text",
                     id_column: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (binary, little-endian uint32), ids_sha256, decoded_sha256.

    A null or empty text has no ids. A null or repeated doc_id is carried through;
    repeated rows give repeated results; an empty table gives an empty result.
    Other columns of `docs` are not read. With `keep_ids=False` the ids are left out.
    """
    spark = docs.sparkSession
    batch_texts(spark, BATCH_BYTES)
    shared = spark.sparkContext.broadcast(Codec(read_ranks(ranks_path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker that served other stages keeps what they freed
        pa.default_memory_pool().release_unused()
        codec = shared.value
        for batch in batches:
            ids, counts, digests, back = [], [], [], []
            for value in batch.column(1):
                coded = codec.encode(value.as_py() or "")
                counts.append(len(coded) // 4)
                digests.append(hashlib.sha256(coded).hexdigest())
                back.append(hashlib.sha256(codec.decode(coded)).hexdigest())
                if keep_ids:
                    ids.append(coded)
            columns = [batch.column(0), pa.array(counts, pa.int64())]
            columns += [pa.array(ids, pa.binary())] if keep_ids else []
            columns += [pa.array(digests, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", *(["ids"] if keep_ids else []), "ids_sha256", "decoded_sha256"]
    kinds = {"doc_id": "long", "n_tokens": "long", "ids": "binary"}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    return docs.selectExpr(f"CAST(`{id_column}` AS BIGINT) AS doc_id", f"CAST(`{text}` AS STRING) AS text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that are no UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(Codec(read_ranks(ranks_path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            texts = [codec.decode(v.as_py() or b"").decode("utf-8", "replace") for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
