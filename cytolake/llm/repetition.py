"""Quality rules on repetition, from suffix arrays.

The words of many texts form one sequence in which words of different texts never equal; its suffix array comes from
prefix doubling (ranks of 1, 2, 4, ... words; only suffixes that still tie are ranked again), and the ranks kept on the way
give the longest common prefix of suffix-array neighbours by binary lifting. Where neighbours agree on ``n`` words lies a
maximal repeated substring; the spans of those of at least ``min_repeat`` words are united. A text fails when its united
spans cover more than ``max_covered`` percent of its words, or its longest repeat has more than ``max_longest`` words.

Rows are independent: nothing is shuffled, and a task holds the words of one group of texts (or of one very long text).
A null or empty text has no words: all counts 0, base_failed true. Repeated rows give repeated results.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import encode

#: Words that are ranked together; a text of more is ranked alone.
GROUP_WORDS = 1 << 19
SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"


class _Numbers(dict):
    """Numbers words in the order of their first sight."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def suffix_lcp(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, longest common prefix with the one before). Only suffixes whose first word recurs in their
    text are listed; words: numbers of words; doc: number of the text of each, ascending."""
    n = len(words)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none
    ends = np.searchsorted(doc, doc, side="right")  # the end of each position's text
    _, first, count = np.unique(words * np.int64(doc[-1] + 1) + doc, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count)[first] + 1  # one more than the number of smaller suffixes
    live = np.flatnonzero(count[first] > 1)
    levels, h = [rank], 1
    while len(live):
        after = live + h
        second = np.where(after < ends[live], rank[np.minimum(after, n - 1)], 0)
        key = np.argsort(rank[live] * np.int64(n + 1) + second)
        live = live[key]
        a, b = rank[live], second[key]
        new_run = np.r_[True, (a[1:] != a[:-1])]
        differs = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        # a run of equal ranks gets the run's rank plus the number of smaller suffixes in it: ranks stay comparable
        start = np.maximum.accumulate(np.where(new_run, np.arange(len(live)), 0))
        place = np.maximum.accumulate(np.where(differs, np.arange(len(live)), 0)) - start
        rank = rank.copy()
        rank[live] = a + place
        levels.append(rank)
        tied = ~(differs & np.r_[differs[1:], True])
        live, h = np.sort(live[tied]), 2 * h
    order = np.flatnonzero(count[first] > 1)
    order = order[np.argsort(rank[order], kind="stable")]
    i, j = order[:-1].copy(), order[1:].copy()
    lcp, on = np.zeros(len(i), np.int64), np.arange(len(i))
    for level in range(len(levels) - 1, -1, -1):
        at = levels[level]
        p, q = i[on] + lcp[on], j[on] + lcp[on]
        inside = (p < ends[i[on]]) & (q < ends[j[on]])
        same = inside & (at[np.minimum(p, n - 1)] == at[np.minimum(q, n - 1)])
        lcp[on[same]] += 1 << level
    lcp = np.minimum(lcp, np.minimum(ends[i] - i, ends[j] - j))
    return order, np.r_[0, lcp] if len(order) else none


def covered(order: np.ndarray, lcp: np.ndarray, n: int, least: int) -> np.ndarray:
    """Whether each of n words lies in a substring of at least ``least`` words that occurs twice or more."""
    if not len(order):
        return np.zeros(n, bool)
    reach = np.maximum(lcp, np.r_[lcp[1:], 0])
    hit = reach >= least
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, order[hit], 1)
    np.add.at(delta, order[hit] + reach[hit], -1)
    return np.cumsum(delta)[:n] > 0


def _counts(data: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), len(b"".join(words).decode("utf-8", "replace")), sum(data.count(bytes([c])) for c in SYMBOLS), len(lines) - len(set(lines))


def measure(texts: list, window: int = 5, min_repeat: int = 8) -> list[tuple]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat) of each text."""
    out, group, size = [], [], 0
    data = [encode(t) for t in texts]
    for i, d in enumerate(data):
        words = d.split()
        group.append((_counts(d, words), words))
        size += len(words)
        if size >= GROUP_WORDS or i == len(data) - 1:
            out += _repeats(group, window, min_repeat)
            group, size = [], 0
    return out


def _repeats(group: list[tuple], window: int, least: int) -> list[tuple]:
    sizes = np.array([len(w) for _, w in group])
    n = int(sizes.sum())
    ids = np.fromiter(map(_Numbers().__getitem__, itertools.chain.from_iterable(w for _, w in group)), np.int64, n)
    doc = np.repeat(np.arange(len(group)), sizes)
    order, lcp = suffix_lcp(ids, doc)
    in_window, in_repeat = covered(order, lcp, n, window), covered(order, lcp, n, least)
    longest = np.zeros(len(group), np.int64)
    np.maximum.at(longest, doc[order], lcp)
    per = lambda mask: np.bincount(doc[mask], minlength=len(group))
    return [(*c, int(a), int(b), int(m)) for (c, _), a, b, m in zip(group, per(in_window), per(in_repeat), longest, strict=True)]


def repetition_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 5, min_repeat: int = 8, max_covered: int = 15, max_longest: int = 60
) -> DataFrame:
    """Measures of every whole text, ``base_failed`` (under 10 words, or over 20 % of them in repeated windows) and
    ``kept`` (not failed, and within the limits on repeated spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                cols = list(zip(*measure(part.column(1).to_pylist(), window, min_repeat), strict=True))
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in cols)], names)

    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = two.mapInArrow(run, SCHEMA)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fine = (100 * F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)
