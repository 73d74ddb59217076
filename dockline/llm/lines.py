"""Line dedup by a suffix array over line-ID sequences.

A document is the sequence of its lines that hold a word. The suffix array over
all these sequences is built by distributed prefix doubling: the rank of a line
orders the suffixes by their first line; from ranks by the first h lines, the
pairs (rank at i, rank at i + h) order them by 2h lines. A suffix whose rank is
its own alone is final and takes no further part, so after the first step only
repeated lines are carried, and a round shuffles what is still undecided.

Suffixes of equal rank by h lines are one interval of the array whose longest
common prefix is h or more. In an interval with several members, every member
but the first in document order starts a repeated run of h lines; a maximal run
of length L is the union of the windows of 2^k <= L lines inside it, since each of
them starts earlier too. So the intervals of each doubling step give the lines
that lie in later copies, exactly, and the deepest one gives the run's length to a
factor of two. Runs of fewer than `min_lines` lines are left alone, but for single
lines of `min_words` words or more: a paragraph that is one line counts by its
words, from the intervals of the first step.

The order within a round comes from one range partitioning of the distinct
pairs, summed by partition; no group and no window spans the table, and a line
that a third of all documents share is one distinct key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from dockline.llm.common import batch_texts, keyed, shuffle_width, stored

MIN_LINES = 2
MIN_WORDS = 20
DOCUMENT = ["_id", "_th"]


def line_rows(own: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _th, line, a, b, long): number and 128-bit hash of each line with a word, and
    whether it has `min_words` words; rows are distinct."""
    words, space = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
    # anchored and possessive, so a line is read once however long its words are
    many = f"^{space}*+(?:{words}++{space}++){{{min_words - 1}}}{words}"
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(words))
    rows = own.select(*DOCUMENT, F.posexplode(F.transform(lines, lambda x: F.struct(
        F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit("second")).alias("b"), x.rlike(many).alias("long")))).alias("line", "h"))
    return rows.select(*DOCUMENT, "line", "h.a", "h.b", "h.long")


def ranked(keys: DataFrame) -> tuple[DataFrame, int]:
    """Distinct keys (a, b, n, first) with `rank`, and their number.

    The rank is 1 + the rows of smaller keys in the order (a, b): the running count
    in the key's range partition plus what the partitions before it hold.
    """
    spark = keys.sparkSession

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            counts = batch.column(2).to_numpy()
            upto = start + np.cumsum(counts)
            own = [batch.column(0), batch.column(1), batch.column(3), pa.array(np.full(len(counts), part, np.int32)), pa.array(upto - counts), pa.array(upto)]
            yield pa.RecordBatch.from_arrays(own, names=["a", "b", "first", "part", "before", "upto"])
            start = int(upto[-1]) if len(upto) else start

    ordered = keys.repartitionByRange(shuffle_width(spark), "a", "b").sortWithinPartitions("a", "b").select("a", "b", "n", "first")
    kind = keys.schema["first"].dataType.simpleString()
    placed = stored(ordered.mapInArrow(work, f"a long, b long, first {kind}, part int, before long, upto long"), "lines-ranks")
    held = placed.groupBy("part").agg(F.max("upto").alias("n"), F.count("*").alias("keys")).collect()  # one row a partition
    offsets, total = [], 0
    for row in sorted(held):
        offsets.append((row.part, total))
        total += row.n
    if not offsets:
        return placed.select("a", "b", "first", F.col("before").alias("rank")), 0
    shifts = F.broadcast(spark.createDataFrame(offsets, "part int, shift long"))
    named = placed.join(shifts, "part").select("a", "b", "first", (F.col("before") + F.col("shift") + 1).alias("rank"))
    return named, sum(row["keys"] for row in held)


def _intervals(rows: DataFrame) -> DataFrame:
    """(a, b, n, first) of the keys (a, b) that occur at several places (document, line)."""
    place = F.struct(*DOCUMENT, "line")
    return (
        rows.groupBy("a", "b")
        .agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
        .filter("first < last")
        .select("a", "b", "n", "first")
    )


def repeated_runs(own: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _th, line, span): lines at which a run of `span` >= min_lines lines, or a line of
    `min_words` words or more (span 1), starts that also starts earlier.

    `span` is the largest power-of-two step, or `min_lines`, that still has an earlier copy.
    """
    rows = stored(line_rows(own, min_words).repartition(*DOCUMENT).dropDuplicates([*DOCUMENT, "line"]), "lines-hashed")
    found, step = own.sparkSession.createDataFrame([], "_id long, _th long, line int, span int"), 1
    while True:
        names, number = ranked(_intervals(rows))
        if not number:
            break
        # positions whose interval has several members; the others are final
        later = F.struct(*DOCUMENT, "line") != F.col("first")
        carried = [*DOCUMENT, "line", "rank", later.alias("later"), *(["long"] if step == 1 else [])]
        live = stored(rows.join(names, ["a", "b"]).select(*carried), "lines-live")
        if step >= min_lines:
            found = found.unionAll(live.filter("later").select(*DOCUMENT, "line", F.lit(step).alias("span")))
        elif step == 1:
            found = found.unionAll(live.filter("later AND long").select(*DOCUMENT, "line", F.lit(1).alias("span")))
        if step < min_lines < 2 * step:
            # two overlapping windows of this step make one of min_lines
            joined = stored(_paired(live, min_lines - step), "lines-exact")
            exact = joined.join(_intervals(joined), ["a", "b"]).filter(later)
            found = found.unionAll(exact.select(*DOCUMENT, "line", F.lit(min_lines).alias("span")))
        rows = stored(_paired(live, step), "lines-paired")
        step *= 2
    return found.groupBy(*DOCUMENT, "line").agg(F.max("span").alias("span"))


def _paired(live: DataFrame, step: int) -> DataFrame:
    """(document, line, a = rank at line, b = rank at line + step) where both are live.

    A run that ends with its document, or whose rest occurs once only, is no longer repeated.
    """
    other = live.select(*DOCUMENT, (F.col("line") - step).alias("line"), F.col("rank").alias("b"))
    return live.select(*DOCUMENT, "line", F.col("rank").alias("a")).join(other, [*DOCUMENT, "line"])


def without_repeats(docs: DataFrame, *, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS,
                    text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row of `docs`: all its columns, the text without later copies of repeated runs, and
    n_lines, n_removed (lines with a word), longest_run (of the found steps), as `_n_lines` etc.

    Earlier means a smaller doc_id (null first; equal ids by the text's hash) or an
    earlier line. Rows equal in id and text are one document and get equal results.
    A run is `min_lines` or more lines, or one line of `min_words` or more words (runs of
    neither kind stay). Lines without a word stay. A null text stays null; an empty table
    gives an empty one; columns of the names used inside are not touched, since only id and
    text are read to find the runs. A text of any length is one row of hashes a line.
    """
    spark = docs.sparkSession
    batch_texts(spark)
    own = keyed(docs, text, id_column)
    runs = repeated_runs(own, min_lines, min_words).groupBy(*DOCUMENT).agg(F.collect_list(F.struct("line", "span")).alias("_spans"))
    names = [c for c in docs.columns if c != text]
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(text).cast("string").alias("_text"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_th"),
    )
    joined = packed.join(runs, DOCUMENT, "left").select("_row", "_text", "_spans")
    schema = joined.drop("_spans").withColumn("_n_lines", F.lit(0).cast("long")).withColumn(
        "_n_removed", F.lit(0).cast("long")).withColumn("_longest_run", F.lit(0).cast("long")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone, longest = [], [], [], []
            for value, spans in zip(batch.column(1), batch.column(2), strict=True):
                whole = value.as_py()
                lines = (whole or "").split("\n")
                worded = [k for k, line in enumerate(lines) if line.strip(" \t\n\r\x0b\x0c")]
                counts.append(len(worded))
                if spans.is_valid:
                    steps = np.zeros(len(worded) + 1, np.int64)
                    at, span = spans.values.field("line").to_numpy(), spans.values.field("span").to_numpy()
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + span, -1)
                    drop = {k for k, depth in zip(worded, np.cumsum(steps[:-1]).tolist(), strict=True) if depth}
                    whole = "\n".join([line for k, line in enumerate(lines) if k not in drop])
                    gone.append(len(drop))
                    longest.append(int(span.max()))
                else:
                    gone.append(0)
                    longest.append(0)
                texts.append(whole)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in (counts, gone, longest))],
                names=["_row", "_text", "_n_lines", "_n_removed", "_longest_run"])

    out = joined.mapInArrow(work, schema)
    return out.select(
        *[F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns],
        "_n_lines", "_n_removed", "_longest_run",
    )
