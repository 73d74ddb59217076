"""Periodic runs of words: the same phrase again and again.

A run is a stretch of words with smallest period q that is at least `max(least,
copies * q)` words long and that no neighbouring word extends. It is found by
seeds and extension. On the diagonal of lag q a run is a match of its length less
q words, so runs of every lag in a class share at least `overlap` matching words,
and the word grams of that length are indexed. In a run, an `overlap`-gram covers
a whole period, so it occurs next exactly q words later: the pairs of consecutive
occurrences hold a seed for every run, and no others are formed, however often a
gram occurs. The class of the next, longer lags is indexed by the grams of its own
guaranteed overlap; only places whose shorter gram repeats stay in the index.

A seed is extended along its diagonal once: a table keeps for each lag how far
its diagonal is covered, and seeds before that place are passed over.

The work is local to a text. Word numbers and gram numbers are exact, not hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dockline.llm.common import SPACE, Tokens, batch_texts, mix64, renamed, slices

LEAST_WORDS = 6
COPIES = 4
_factors = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _overlap(lag: int, least: int, copies: int) -> int:
    """Matching words that a run of period `lag` has at least on its diagonal."""
    return max(least, copies * lag) - lag


def _first_grams(ids: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """Exact numbers of the `size`-grams that repeat within a text, by place; -1 elsewhere."""
    out = np.full(len(ids), -1, np.int64)
    count = len(ids) - size + 1
    if count <= 0:
        return out
    mixed = row[:count].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(size):  # hashes only sort out places that cannot repeat
        mixed += mix64(ids[j : j + count].astype(np.uint64) * _factors[j % 64] + np.uint64(j))
    inside = row[:count] == row[size - 1 :]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    keep = np.zeros(count, bool)
    keep[order[1:][same]] = True
    keep[order[:-1][same]] = True
    places = np.flatnonzero(keep & inside)
    names = row[places]
    for j in range(size):
        names = renamed(names, ids[places + j])
        places, names = places[names >= 0], names[names >= 0]
    out[places] = names
    return out


def _longer(names: np.ndarray, shift: int) -> np.ndarray:
    """Numbers of the grams made of the grams at a place and `shift` words after it."""
    out = np.full(len(names), -1, np.int64)
    places = np.flatnonzero(names[: max(len(names) - shift, 0)] >= 0)
    places = places[names[places + shift] >= 0]
    out[places] = renamed(names[places], names[places + shift])
    return out


def _seeds(names: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of consecutive occurrences of a gram, `low` to `high` words apart, by lag and place."""
    places = np.flatnonzero(names >= 0)
    places = places[np.argsort(names[places], kind="stable")]
    lag = places[1:] - places[:-1]
    near = (names[places[1:]] == names[places[:-1]]) & (lag >= low) & (lag <= high)
    at, lag = places[:-1][near], lag[near]
    order = np.lexsort((at, lag))
    return at[order], lag[order]


def _extended(ids: np.ndarray, start: int, lag: int, stop: int) -> int:
    """End of the match of `ids` with itself `lag` words later, from `start`, before `stop`."""
    at, step = start, 64
    while at + lag < stop:
        to = min(at + step, stop - lag)
        differs = np.flatnonzero(ids[at:to] != ids[at + lag : to + lag])
        if len(differs):
            return at + int(differs[0])
        at, step = to, step * 2
    return at


def runs_of(ids: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS, copies: int = COPIES) -> np.ndarray:
    """(text, start, length, period) of every run, by text, start and period.

    `ids` are the word numbers of consecutive texts, `first` the place of each text's
    first word and the total. At least three copies are needed for the seeds to be complete.
    """
    if copies < 3 or least < copies:
        raise ValueError("a run has at least three copies, and a word for each")
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = []
    covered: dict[int, int] = {}
    low, size = 1, _overlap(1, least, copies)
    names = _first_grams(ids, row, size)
    while True:
        places, lags = _seeds(names, low, size)
        inner = np.zeros(len(places), bool)
        inner[1:] = (lags[1:] == lags[:-1]) & (places[1:] == places[:-1] + 1)
        for place, lag in zip(places[~inner].tolist(), lags[~inner].tolist(), strict=True):
            if place < covered.get(lag, 0):
                continue
            stop = int(first[row[place] + 1])
            end = _extended(ids, place, lag, stop)
            covered[lag] = end
            length = end - place + lag
            if length >= max(least, copies * lag):
                found.append((int(row[place]), place - int(first[row[place]]), length, lag))
        # the class of longer lags: its grams are put together from the present ones
        low = size + 1
        if not (names >= 0).any() or copies * low > int(np.diff(first).max(initial=0)):
            break
        wanted = _overlap(low, least, copies)
        while 2 * size < wanted:
            names, size = _longer(names, size), 2 * size
        names, size = _longer(names, wanted - size), wanted
    out = np.array(found, np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _strongest(runs: list[list[int]]) -> list[int] | None:
    """The run with the greatest length / period; ties: smallest start, then period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[2] * best[3] > best[2] * run[3]:
            best = run
    return best


def periodic_runs(docs: DataFrame, *, least: int = LEAST_WORDS, copies: int = COPIES,
                  text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row of `docs`: doc_id, n_words, runs, strongest, runs_sha256, collapsed_text.

    `runs` is a list of (start, length, period) by start, then period, in words counted
    from 0; `strongest` is the one with the greatest length / period (ties: smallest
    start, then period), null without a run. `runs_sha256` is taken of the lines
    "start,length,period". `collapsed_text` joins by one space the words that no run
    covers after its first period.

    Null and empty texts have no words: no runs and an empty collapsed text. Rows equal
    in id are judged one by one, a null id is kept, an empty table gives no rows, and
    other columns are not read. A text is held whole by the task that reads it; time
    grows with its words times the logarithm of its longest period.
    """
    batch_texts(docs.sparkSession)
    own = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop, data, offsets in slices(batch.column(1)):
                words = Tokens(data, offsets, SPACE)
                found = runs_of(words.ids, words.first, least, copies)
                bounds = np.searchsorted(found[:, 0], np.arange(stop - begin + 1))
                best, digests, kept = [], [], []
                for k in range(stop - begin):
                    runs = found[bounds[k] : bounds[k + 1]].tolist()
                    pieces = data[offsets[k] : offsets[k + 1]].tobytes().split()
                    top = _strongest(runs)
                    best.append(top and {"start": top[1], "length": top[2], "period": top[3]})
                    digests.append(hashlib.sha256("".join(f"{s},{n},{p}\n" for _, s, n, p in runs).encode()).hexdigest())
                    if runs:
                        steps = np.zeros(len(pieces) + 1, np.int64)
                        for _, start, length, period in runs:
                            steps[start + period] += 1
                            steps[start + length] -= 1
                        keep = (np.cumsum(steps[:-1]) == 0).tolist()
                        pieces = [p for p, k in zip(pieces, keep, strict=True) if k]
                    kept.append(b" ".join(pieces).decode())
                lists = pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()),
                    pa.StructArray.from_arrays([pa.array(found[:, i]) for i in (1, 2, 3)], fields=list(one)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, stop - begin), pa.array(np.diff(words.first), pa.int64()), lists,
                     pa.array(best, one), pa.array(digests, pa.string()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "runs", "strongest", "runs_sha256", "collapsed_text"])

    run = "struct<start: bigint, length: bigint, period: bigint>"
    return own.mapInArrow(
        work, f"doc_id long, n_words long, runs array<{run}>, strongest {run}, runs_sha256 string, collapsed_text string")
