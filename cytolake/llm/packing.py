"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each document becomes its tokens and an end id. Its length alone fixes its cuts: whole windows first, then the rest in
pieces of at most ``piece`` tokens. Whole windows need no packing. The other pieces are dealt by hash to shards of about
``shard_windows`` windows. Within a shard every piece starts as a partial partition with one filled slot; the two partial
partitions of the largest imbalance are merged again and again, large slots onto small ones, until one near-equal
partition is left. If its largest window exceeds the capacity, the window count rises and the shard starts over.

Token ids exist only in the pass that makes them: what is shuffled is a row of numbers for each piece, and a shard's
size is bounded by its definition. The cost of a retry is a fresh differencing of one shard's piece lengths.

A null text is an empty one (only the end id). Repeated rows are packed as separate documents; a null id stays null.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import FORGET, Tables, lean
from .words import encode, runs

#: Distinct words whose ids one Python worker remembers.
CACHE_WORDS = 1_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"
_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CACHE: dict[str, WordTokenizer] = {}
FORGET.append(_CACHE.clear)
#: Latin letters up to U+023F whose lower case is one letter, in UTF-8, and signs after them.
_LETTERS = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf])+"
_PARTS = re.compile(rb"(" + _LETTERS + rb")([!-/:-@\[-`{-~]+)?\Z").match


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of texts, word by word. Exact for tokenizers whose normaliser and pre-tokeniser never look across white
    space, as this vocabulary's (it drops white space); each distinct word is tokenised once while remembered."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        #: the same model for lower-case Latin letters, which need no normaliser and are one pre-token each
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def words(self, text) -> list[bytes]:
        """The words of a text; A-Z in lower case, as the normaliser has it, but where special tokens may be written."""
        data = encode(text)
        return (data if b"<|" in data else data.lower()).split()

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = words
        # letters and the signs after them are separate pre-tokens, so their ids come from their parts
        known, parted, letters, alone = self.known, [], set(), set()
        for w in new:
            if not (m := _PARTS(w)):
                alone.add(w)
            elif m[2]:
                parted.append((w, m[1], m[2]))
                letters.add(m[1])
                alone.add(m[2])
            else:
                letters.add(w)
        letters = [w for w in letters if w not in known]
        alone = [w for w in alone if w not in known]
        for i in range(0, len(letters), 100_000):
            parts = [letters[k : k + 1000] for k in range(i, min(i + 100_000, len(letters)), 1000)]
            found = self.plain.encode_batch_fast([b" ".join(p).decode().lower() for p in parts], add_special_tokens=False)
            for part, e in zip(parts, found, strict=True):
                ids = np.array(e.ids, np.uint32)
                data, at = ids.tobytes(), (4 * np.r_[0, np.flatnonzero(self.ends[ids]) + 1]).tolist()
                known.update((w, data[a:b]) for w, a, b in zip(part, at, at[1:], strict=False))
                if len(at) != len(part) + 1:
                    raise AssertionError("a word of letters ends with its last token only")
        for i in range(0, len(alone), 10_000):
            part = alone[i : i + 10_000]
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            known.update((w, array("I", e.ids).tobytes()) for w, e in zip(part, found, strict=True))
        known.update((w, known[a] + known[b]) for w, a, b in parted)

    def ids(self, words: list[bytes]) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(map(self.known.__getitem__, words))


def tokenizer(path: str) -> WordTokenizer:
    if path not in _CACHE:
        _CACHE[path] = WordTokenizer(path)
    return _CACHE[path]


def cuts(total: int, window: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    whole = total // window * window
    out = [(s, window) for s in range(0, whole, window)]
    return out + [(s, min(piece, total - s)) for s in range(whole, total, piece)]


def _pieces(path: str, window: int, piece: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end, turn = tokenizer(path), int(end_id).to_bytes(4, "little"), itertools.count()
        for batch in batches:
            whole, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for lo, hi in runs(whole, 1 << 21):
                out: list[tuple] = []
                texts = [tok.words(t) for t in whole[lo:hi]]
                tok.learn(set().union(*texts))
                for doc_id, words in zip(ids[lo:hi], texts, strict=True):
                    data = tok.ids(words) + end
                    total = len(data) // 4
                    for start, length in cuts(total, window, piece):
                        deal = xxhash.xxh3_64_intdigest(f"{doc_id}:{start}:{next(turn)}".encode()) >> 1
                        out.append((doc_id, start, length, zlib.crc32(memoryview(data)[4 * start : 4 * (start + length)]), total, deal))
                cols = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"])

    return run


def difference(lengths: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: item numbers of k near-equal groups. A partial partition holds only its filled slots, largest
    first; slots beyond those are empty."""
    order = itertools.count()
    heap = [(-n, next(order), [(n, (i,))]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)

    def spread(slots: list) -> int:
        return slots[0][0] - (slots[-1][0] if len(slots) == k else 0)

    def flat(tree) -> Iterator[int]:
        stack = [tree]
        while stack:
            for x in stack.pop():
                if isinstance(x, tuple):
                    stack.append(x)
                else:
                    yield x

    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = max(0, len(a) + len(b) - k)
        # the smallest ``over`` of b meet the smallest of a in opposite order; the others go to a's empty slots
        keep_a, meet_a = a[: len(a) - over], a[len(a) - over :]
        keep_b, meet_b = b[: len(b) - over], b[len(b) - over :]
        if len(keep_a) + len(keep_b) + over > k:
            raise AssertionError("more slots than windows")
        met = [(x + y, (p, q)) for (x, p), (y, q) in zip(meet_a, reversed(meet_b), strict=True)]
        slots = sorted([*keep_a, *keep_b, *met], key=lambda s: -s[0])
        heapq.heappush(heap, (-spread(slots), next(order), slots))
    groups = [sorted(flat(t)) for _, t in heap[0][2]] if heap else []
    return groups + [[] for _ in range(k - len(groups))]


def pack_shard(lengths: list[int], window: int) -> list[list[int]]:
    """Groups of item numbers, none longer in sum than a window; the count starts at the least possible."""
    if not lengths:
        return []
    k = max(1, -(-sum(lengths) // window))
    while True:
        groups = difference(lengths, k)
        if max(sum(lengths[i] for i in g) for g in groups) <= window:
            return [g for g in groups if g]
        k += max(1, k // 200)


def _place(window: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["deal", "doc_id", "start"], kind="stable").reset_index(drop=True)
        whole = np.flatnonzero(pdf["length"].to_numpy() == window)
        rest = np.flatnonzero(pdf["length"].to_numpy() != window)
        groups = [[int(i)] for i in whole] + [[int(rest[i]) for i in g] for g in pack_shard(pdf["length"].to_numpy()[rest].tolist(), window)]
        order = np.array([i for g in groups for i in g], np.int64)
        out = pdf.iloc[order].drop(columns=["deal", "shard"])
        lengths = pdf["length"].to_numpy()
        out["sequence_id"] = np.array([(int(key[0]) << 32) + j for j, g in enumerate(groups) for _ in g], np.int64)
        out["offset"] = np.array([o for g in groups for o in np.cumsum([0, *lengths[g][:-1]])], np.int64)
        return out

    return run


def pack(docs: DataFrame, window: int = 4096, end_id: int = 2, tokenizer_path: str | None = None, piece: int = 2048, shard_windows: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark, path = docs.sparkSession, tokenizer_path or vocabulary()
    tables = Tables(spark)
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = tables.cut(two.mapInArrow(lean("packing", _pieces(path, window, piece, end_id)), PIECES), "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    shards = max(1, round(total / (window * shard_windows)))
    dealt = pieces.withColumn("shard", F.pmod("deal", F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_place(window), _PLACED)
