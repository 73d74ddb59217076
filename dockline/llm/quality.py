"""Quality rules as a short-circuit cascade.

Every rule is a bound on one feature of a text. The cost and the rejection share
of each rule are measured on a bounded sample of documents; rules then run in
the order of rejections per second, each only on the documents that passed those
before it. The verdict is the conjunction of all rules, so the measured order
changes the work and never the result.

All work is row-local on slices of texts; nothing is shuffled.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockline.llm.common import SPACE, Words, batch_texts, slices, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW_WORDS = 5
SAMPLE_DOCUMENTS = 2_000
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Slice:
    """The texts of one slice, with what the features share computed once."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self._words = None

    @property
    def words(self) -> Words:
        if self._words is None:
            self._words = Words(self.data, self.offsets)
        return self._words

    def text(self, row: int) -> np.ndarray:
        return self.data[self.offsets[row] : self.offsets[row + 1]]


def n_words(part: Slice, row: int) -> int:
    return int(part.words.first[row + 1] - part.words.first[row])


def word_chars(part: Slice, row: int) -> int:
    """Code points in words: bytes that neither are white space nor continue a character."""
    text = part.text(row)
    return int(np.count_nonzero(~SPACE[text] & ((text & 0xC0) != 0x80)))


def n_symbols(part: Slice, row: int) -> int:
    return int(np.count_nonzero(SYMBOLS[part.text(row)]))


def n_dup_lines(part: Slice, row: int) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [line for line in part.text(row).tobytes().split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def n_repeat_words(part: Slice, row: int) -> int:
    """Words in five-word windows that the text holds twice or more, first included."""
    words = part.words.of(row)
    hashes = windows(words, WINDOW_WORDS)
    if len(hashes) < 2:
        return 0
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(hashes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + WINDOW_WORDS, -1)
    return int(np.count_nonzero(np.cumsum(steps[:-1])))


FEATURES: dict[str, Callable[[Slice, int], int]] = {
    f.__name__: f for f in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)
}


def _lines(part: Slice, row: int) -> int:
    return int(np.count_nonzero(part.text(row) == 10)) + 1


class Rule(NamedTuple):
    """A document passes if `test(get)` holds; `get(name)` gives a feature of it."""

    name: str
    test: Callable[[Callable[[str], int]], bool]


def base_rules(min_words: int = 10, repeat_percent: int = 20) -> list[Rule]:
    return [
        Rule("enough_words", lambda get: get("n_words") >= min_words),
        Rule("few_repeats", lambda get: 100 * get("n_repeat_words") <= repeat_percent * get("n_words")),
    ]


def further_rules(symbol_percent: int = 10, line_percent: int = 30, shortest: int = 3, longest: int = 12) -> list[Rule]:
    """Symbols per word, share of repeated lines, mean word length in code points."""
    return [
        Rule("few_symbols", lambda get: 100 * get("n_symbols") <= symbol_percent * get("n_words")),
        Rule("few_dup_lines", lambda get: 100 * get("n_dup_lines") <= line_percent * get("n_lines")),
        Rule("word_length", lambda get: shortest * get("n_words") <= get("word_chars") <= longest * get("n_words")),
    ]


def _getter(part: Slice, row: int, known: dict[str, int]) -> Callable[[str], int]:
    def get(name: str) -> int:
        if name not in known:
            known[name] = _lines(part, row) if name == "n_lines" else FEATURES[name](part, row)
        return known[name]

    return get


def measure(docs: DataFrame, rules: list[Rule], text: str = "text", sample: int = SAMPLE_DOCUMENTS) -> dict[str, tuple[float, float]]:
    """Seconds per document and rejection share of each rule, on about `sample` documents."""
    batch_texts(docs.sparkSession)
    rows = docs.count()
    picked = docs.select(text).sample(min(1.0, sample / max(rows, 1)), seed=11)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected, seen = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                for row in range(len(offsets) - 1):
                    seen += 1
                    for k, rule in enumerate(rules):
                        # each rule pays for its own features, as if it were the first
                        alone = Slice(data[offsets[row] : offsets[row + 1]], offsets[row : row + 2] - offsets[row])
                        start = time.perf_counter()
                        rejected[k] += not rule.test(_getter(alone, 0, {}))
                        spent[k] += time.perf_counter() - start
        yield pa.RecordBatch.from_pydict(
            {"rule": list(range(len(rules))), "spent": spent, "rejected": rejected, "seen": [seen] * len(rules)}
        )

    found = picked.mapInArrow(run, "rule long, spent double, rejected long, seen long")
    totals = found.groupBy("rule").sum("spent", "rejected", "seen").collect()  # one row for each rule
    out = {rule.name: (1.0, 0.0) for rule in rules}
    for number, spent, rejected, seen in totals:
        if seen:
            out[rules[number].name] = (spent / seen, rejected / seen)
    return out


def order_rules(rules: list[Rule], measured: dict[str, tuple[float, float]]) -> list[Rule]:
    """By rejections per second, highest first; ties keep their order."""
    return sorted(rules, key=lambda r: -measured[r.name][1] / max(measured[r.name][0], 1e-9))


def cascade(docs: DataFrame, rules: list[Rule], *, text: str = "text", id_column: str = "doc_id",
            report: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, the features named in `report`, and rejected_by (null if every rule passed).

    `rules` run in the order given; a document leaves at the first rule it fails.
    Null and empty texts have no words. Null or repeated ids are carried
    through; other columns are not read.
    """
    batch_texts(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in slices(batch.column(1)):
                part = Slice(data, offsets)
                known: list[dict[str, int]] = [{} for _ in range(stop - start)]
                failed: list[str | None] = [None] * (stop - start)
                left = list(range(stop - start))
                for rule in rules:
                    passed = []
                    for row in left:
                        if rule.test(_getter(part, row, known[row])):
                            passed.append(row)
                        else:
                            failed[row] = rule.name
                    left = passed
                columns = [batch.column(0).slice(start, stop - start)]
                for name in report:
                    columns.append(pa.array([_getter(part, r, known[r])(name) for r in range(stop - start)], pa.int64()))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(failed, pa.string())], names=names)

    names = ["doc_id", *report, "rejected_by"]
    schema = ", ".join(f"{n} {'string' if n == 'rejected_by' else 'long'}" for n in names)
    return docs.selectExpr(f"CAST(`{id_column}` AS BIGINT) AS doc_id", f"CAST(`{text}` AS STRING) AS text").mapInArrow(run, schema)


def judged(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Base features, base_failed and kept of every document under the production rules."""
    rules = base_rules() + further_rules()
    ordered = order_rules(rules, measure(docs, rules, text))
    seen = cascade(docs, ordered, text=text, id_column=id_column, report=BASE_COLUMNS)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return seen.select("doc_id", *BASE_COLUMNS, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


def passing(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of `docs` that pass every rule, all columns kept, no shuffle."""
    rules = base_rules() + further_rules()
    ordered = order_rules(rules, measure(docs, rules, text))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for start, stop, data, offsets in slices(batch.column(at)):
                part = Slice(data, offsets)
                for row in range(stop - start):
                    get = _getter(part, row, {})
                    keep[start + row] = all(rule.test(get) for rule in ordered)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
