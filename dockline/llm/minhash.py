"""Near-duplicate documents by b-bit MinHash.

1. Each text becomes its set of hashed word shingles; texts with equal sets form
   one class, so copies cost one row from here on.
2. 128 minima are taken per set. Bands of 4 give 32 bucket keys; only the low 2
   bits of each minimum are kept, packed in 32 bytes. Two sets of similarity 0.8
   share no bucket with probability (1 - 0.8^4)^32 < 1e-7.
3. Within buckets of two or more classes, links are found in rounds. In a star
   round every class is paired with one randomly chosen centre per bucket and only
   its most similar centre, by estimate, is verified. Classes that are linked
   already need no further pair. What then still lies in two components of one
   bucket meets the bucket's members in bounded blocks, which compare whole sets (by
   32 bits of each hash) and give only the links of a spanning forest: no link
   between components is lost, and copies are never expanded into all pairs.
4. A pair of a star round is verified if its estimate is at least `threshold - MARGIN`. The
   estimate counts equal 2-bit fields and corrects for chance agreement:
   (share - 1/4) / (3/4). MARGIN is five standard errors.
5. Links are confirmed on the full sets, and components give the classes.

Buckets are only rows of (key, class), never collected. The sets of a pair are
rebuilt from the two texts where the pair is confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockline.llm.common import (
    LOWEST,
    Words,
    batch_texts,
    components,
    keyed,
    mix64,
    settled,
    slices,
    stored,
    windows,
)

PERMUTATIONS = 128
BAND_ROWS = 4
BANDS = PERMUTATIONS // BAND_ROWS
FIELD_BITS = 2
MARGIN = 0.2
STAR_ROUNDS = 2
BLOCK_STRAYS, BLOCK_MEMBERS = 256, 1024

_seeds = mix64(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_factors = ((_seeds[:PERMUTATIONS] >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)[:, None]
_shifts = (_seeds[PERMUTATIONS:] >> np.uint64(32)).astype(np.uint32)[:, None]
_band_factors = mix64(np.arange(1, BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle; no words, no shingle."""
    if not len(words):
        return words
    return np.unique(windows(words, min(size, len(words))))


def minima(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    best = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, low.shape[1], 4096):
        block = low[:, at : at + 4096] * _factors + _shifts
        np.minimum(best, (block ^ (block >> np.uint32(15))).min(axis=1), out=best)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    rows = best.astype(np.uint64).reshape(BANDS, BAND_ROWS)
    return mix64((rows * _band_factors).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def packed_fields(best: np.ndarray) -> np.ndarray:
    """The low bits of the (mixed) minima, 32 two-bit fields to a 64-bit integer."""
    fields = mix64(best.astype(np.uint64)).astype(np.uint8) & 3
    fields = fields.reshape(-1, 4)
    return (fields[:, 0] | fields[:, 1] << 2 | fields[:, 2] << 4 | fields[:, 3] << 6).view(np.int64)


def _set_key(shingles: np.ndarray) -> bytes:
    """128 bits that name a shingle set."""
    one = mix64(shingles + np.uint64(len(shingles))).sum(dtype=np.uint64)
    two = mix64(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(one).to_bytes(8, "big") + int(two).to_bytes(8, "big")


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, _id, _th, set_key, n_shingles, fields, bands) of each row of a `keyed` frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets, fold=True)
                keys, counts, packed, bands = [], [], [], []
                for row in range(stop - start):
                    shingles = shingle_set(words.of(row), size)
                    counts.append(len(shingles))
                    if not len(shingles):
                        keys.append(None)
                        packed.append(None)
                        bands.append(None)
                        continue
                    best = minima(shingles)
                    keys.append(_set_key(shingles))
                    packed.append(packed_fields(best))
                    bands.append(band_keys(best).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(start, stop - start) for c in (0, 2, 3)),
                        pa.array(keys, pa.binary()),
                        pa.array(counts, pa.int64()),
                        pa.array(packed, pa.list_(pa.int64())),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "_id", "_th", "set_key", "n_shingles", "fields", "bands"],
                )

    schema = "doc_id long, _id long, _th long, set_key binary, n_shingles long, fields array<long>, bands array<long>"
    return docs.mapInArrow(run, schema)


def estimate(a: str, b: str) -> Column:
    """Collision-corrected similarity of two packed signatures."""
    same = F.lit(0)
    for k in range(PERMUTATIONS * FIELD_BITS // 64):
        differ = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        either = differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(0x5555555555555555))
        same = same + (F.lit(64 // FIELD_BITS) - F.bit_count(either))
    chance = 1 / 2**FIELD_BITS
    return (same / F.lit(float(PERMUTATIONS)) - F.lit(chance)) / F.lit(1 - chance)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet `100 * intersection >= percent * union`."""
    left = texts.select(F.col("set_key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("set_key").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        for start, stop, data, offsets in slices(column):
            words = Words(data, offsets, fold=True)
            for row in range(stop - start):
                yield shingle_set(words.of(row), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(sets(batch.column(2)), sets(batch.column(3)), strict=True):
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * shared >= percent * (len(one) + len(two) - shared))
            kept = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield kept

    return both.mapInArrow(run, "a binary, b binary")


def _merge_roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`nodes` (set_key, ..., root) after joining the components that `links` (a, b) connect."""
    roots = nodes.select("set_key", "root")
    lifted = (
        links.join(roots.select(F.col("set_key").alias("a"), F.col("root").alias("ra")), "a")
        .join(roots.select(F.col("set_key").alias("b"), F.col("root").alias("rb")), "b")
        .filter("ra <> rb")
        .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    )
    merged = components(settled(lifted))
    return (
        nodes.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
        .withColumn("root", F.coalesce("top", "root"))
        .drop("top")
    )


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, text: str = "text",
                    id_column: str = "doc_id") -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links, itself included;
    kept says whether it is the row's own. A text without words has no shingles
    and is linked with nothing. Rows that repeat a doc_id are separate rows; a
    row with a null id takes part in links, its component_id is null only if no
    linked row has an id, and it is kept in just that case. Other columns are not read.
    An empty table gives no row; a text of any length is one row of fixed-size signatures.
    """
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.when(~F.col("first.nameless"), F.col("first._id")))
    return linked(docs, size, percent, text, id_column).select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def one_of_each(docs: DataFrame, *, size: int = 5, percent: int = 80, text: str = "text",
                id_column: str = "doc_id") -> DataFrame:
    """The rows of `docs` with one row of each group of near-duplicates, all columns.

    It is the row of the smallest id; rows with an id come before rows with none, equal
    ids are ordered by the text's hash, and of rows equal in id and text the one whose
    JSON is the smallest stays. Rows without words are in no group and all stay.
    """
    key = ["_id", "_th"]
    rows = linked(docs, size, percent, text, id_column).filter("set_key IS NOT NULL")
    states = settled(
        rows.groupBy(*key).agg(F.count("*").alias("n"), F.first("first").alias("first"))
        .withColumn("first", F.struct(*key) == F.struct("first._id", "first._th")).filter("NOT first OR n > 1")
    )
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(LOWEST)).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_th"),
    )
    single = packed.join(states.select(*key), key, "left_anti").select("_row")
    again = packed.join(states.filter("first").select(*key), key, "left_semi")
    again = again.groupBy(*key).agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row")
    return single.unionAll(again).select("_row.*")


def linked(docs: DataFrame, size: int, percent: int, text: str, id_column: str) -> DataFrame:
    """Per row of `docs`: doc_id, _id, _th, n_shingles, set_key and `first`, the key
    (nameless, _id, _th) of its component's first row: those with an id before those with none.
    """
    spark = docs.sparkSession
    batch_texts(spark)
    own = keyed(docs, text, id_column)
    signed = stored(signatures(own, size), "minhash-signatures")
    full = signed.filter("set_key IS NOT NULL")
    # one row, the carrier, stands for all rows of equal sets
    classes = stored(
        full.groupBy("set_key").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "_id", "_th")).alias("first"),
            F.min_by(F.struct("_id", "_th", F.col("n_shingles").alias("n"), "fields", "bands"), F.struct("_id", "_th")).alias("c"),
        ).select("set_key", "first", "c.*"),
        "minhash-classes",
    )
    entries = classes.select("set_key", F.explode("bands").alias("key")).repartition("key")
    shared = entries.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    members = stored(entries.join(shared.hint("shuffle_hash"), "key").select("key", "set_key"), "minhash-buckets")

    busy = members.select("set_key").distinct()
    about = classes.join(busy, "set_key").select("set_key", "_id", "_th", "n", "fields")
    nodes = stored(about.withColumn("root", F.col("set_key")), "minhash-nodes")
    carriers = nodes.select("set_key", "_id", "_th")
    texts = stored(
        own.select("_id", "_th", "text").join(carriers, ["_id", "_th"]).select("set_key", "text").dropDuplicates(["set_key"]),
        "minhash-texts",
    )
    nodes = nodes.drop("_id", "_th")

    for turn in range(STAR_ROUNDS):
        placed = members.join(nodes, "set_key")
        centre = placed.groupBy("key").agg(
            F.min_by(F.struct("set_key", "n", "fields", "root"), F.xxhash64("set_key", F.lit(turn))).alias("c"),
            F.min("root").alias("least"),
            F.max("root").alias("most"),
        ).filter("least <> most")
        pairs = placed.join(centre.select("key", "c"), "key").filter(F.col("root") != F.col("c.root"))
        best = (
            _comparable(pairs.select(F.col("set_key").alias("a"), F.col("n").alias("na"), F.col("fields").alias("fa"),
                                     F.col("c.set_key").alias("b"), F.col("c.n").alias("nb"), F.col("c.fields").alias("fb")), percent)
            .groupBy("a")
            .agg(F.max_by("b", F.struct("likeness", "b")).alias("b"))
        )
        best = settled(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        links = settled(confirmed(best, texts, size, percent))
        nodes = settled(_merge_roots(nodes, links))

    nodes = _merge_roots(nodes, settled(remaining_links(members, settled(nodes), texts, size, percent)))

    # classes outside any shared bucket are their own component
    rooted = settled(classes.join(nodes.select("set_key", "root"), "set_key", "left").select(
        "set_key", "first", F.coalesce("root", "set_key").alias("root")))
    tops = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = rooted.drop("first").join(tops, "root").select("set_key", "first")
    # a set with thousands of copies is one class row here and a hot key only on the left side
    return signed.select("doc_id", "_id", "_th", "n_shingles", "set_key").join(named, "set_key", "left")


def remaining_links(members: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join all components of a bucket that any pair in it joins.

    Only buckets of several components count, and of buckets with the same members
    one. There the classes outside the largest component (strays) meet all members
    in blocks of at most BLOCK_STRAYS by BLOCK_MEMBERS sets. A block compares whole
    sets and gives the links of a spanning forest, fewer than it has sets, so neither
    a task nor the output grows with the square of a bucket.
    """
    placed = members.join(nodes.select("set_key", "root"), "set_key")
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("size"), F.sum(F.xxhash64("set_key").cast("decimal(20,0)")).alias("sum"))
    about = sizes.groupBy("key").agg(
        F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("parts"),
        F.sum("size").alias("members"), (F.sum("size") - F.max("size")).alias("strays"), F.sum("sum").alias("sum"))
    open_keys = about.filter("parts > 1").groupBy("members", "sum").agg(F.min(F.struct("key", "main", "strays")).alias("k"))
    rows = placed.join(open_keys.select("k.*", "members"), "key")
    rows = rows.select("key", "set_key", "root", (F.col("root") != F.col("main")).alias("stray"),
                       F.ceil(F.col("strays") / BLOCK_STRAYS).alias("ns"), F.ceil(F.col("members") / BLOCK_MEMBERS).alias("nm"))
    place = F.xxhash64("set_key")
    each = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    left = rows.filter("stray").select("key", "set_key", "root", F.lit(True).alias("asks"),
                                       F.pmod(place, F.col("ns")).alias("s"), F.explode(each(F.col("nm"))).alias("m"))
    right = rows.select("key", "set_key", "root", F.lit(False).alias("asks"),
                        F.explode(each(F.col("ns"))).alias("s"), F.pmod(place, F.col("nm")).alias("m"))
    # a class is once in a block: as a stray it is also compared with the other strays
    blocks = settled(left.unionByName(right).groupBy("key", "s", "m", "set_key").agg(F.first("root").alias("root"), F.max("asks").alias("asks")))
    sets = _sets(texts.join(blocks.select("set_key").distinct(), "set_key", "left_semi"), size)
    full = blocks.join(sets, "set_key").select("key", "s", "m", "set_key", "root", "asks", "shingles")

    def block(table: pa.Table) -> pa.Table:
        names = table.column("set_key").to_pylist()
        column = table.column("shingles").combine_chunks()
        ends = np.asarray(column.offsets, np.int64) - column.offsets[0].as_py()
        values, ids = np.unique(column.flatten().to_numpy(), return_inverse=True)
        counts = np.diff(ends)
        group = table.column("root").combine_chunks().dictionary_encode().indices.to_numpy().copy()
        held = np.zeros(len(values), bool)
        found = []
        for k in np.flatnonzero(table.column("asks").to_numpy()):
            mine = ids[ends[k] : ends[k + 1]]
            held[mine] = True
            shared = np.add.reduceat(held[ids], ends[:-1])
            held[mine] = False
            for other in np.flatnonzero(100 * shared >= percent * (counts + counts[k] - shared)):
                if group[other] != group[k]:
                    group[group == group[other]] = group[k]
                    found.append((names[k], names[other]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([x for _, x in found], pa.binary())})

    found = settled(full.groupBy("key", "s", "m").applyInArrow(block, "a binary, b binary").distinct())
    return confirmed(found, texts, size, percent)


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(set_key, shingles) of (set_key, text); half of each hash, which is what blocks compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets, fold=True)
                sets = [(shingle_set(words.of(row), size) >> np.uint64(32)).astype(np.uint32).view(np.int32) for row in range(stop - start)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array(sets, pa.list_(pa.int32()))], names=["set_key", "shingles"])

    return texts.select("set_key", "text").mapInArrow(run, "set_key binary, shingles array<int>")


def _comparable(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose estimate comes near it."""
    fits = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return pairs.filter(fits).withColumn("likeness", estimate("fa", "fb")).filter(
        F.col("likeness") >= percent / 100 - MARGIN
    )
