"""Runs: stretches of a text that repeat themselves with a period of some words.

A run of period q is a stretch of at least 2 q words in which words q apart are
equal, and which no neighbouring word extends. If its length is L, the words at its
start and those q later agree for exactly L - q words: a maximal pair, equal to the right
for L - q words and with different words to the left. The other way round, a
maximal pair at a distance of no more than its length is a run as it stands; nothing
has to be extended.

The pairs come from the tree of LCP intervals of the suffix array of the words, bottom
up. Each interval holds the places of its suffixes, in a list for each word to the
left and in order. Where two intervals meet, the smaller one's places look for their
neighbours in the larger one. That neighbours are enough: of the occurrences of
the shared words, those of a run's smallest period follow each other, as one
between them would give a smaller period. Multiples of a period span the same stretch,
of which the smallest distance is kept.

Texts go in groups, so that numpy sorts the suffixes of many at once; a word that ends
each text is unlike all others and keeps them apart.

Defined results: a null text has no words and no runs, and collapses to the empty text; rows
that repeat are each answered; columns other than the id and the text do not come
out. A task needs some 100 bytes for each word of the longest text.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEAST_WORDS = 12
GROUP_BYTES = 1 << 20
CHUNK = 1024


class Suffixes:
    """The ranks of all suffixes after 1, 2, 4 … words, of texts given as lists of words."""

    def __init__(self, texts: list[list[bytes]]):
        first: list[int] = []
        for words in texts:
            base = len(first)
            first += map({}.setdefault, words, range(base, base + len(words)))
            first.append(len(first))
        # A word's rank is the number of words in front of its first occurrence's group.
        first = np.array(first, np.int64)
        counts = np.bincount(first, minlength=len(first))
        rank = (np.cumsum(counts) - counts)[first]
        self.levels = [rank]
        self.open = [np.flatnonzero(counts[first] > 1)]  # the places whose words occur again
        while len(self.open[-1]):
            self._double()

    def _double(self) -> None:
        rank, places, width = self.levels[-1], self.open[-1], 1 << len(self.levels) - 1
        head, tail = rank[places], rank[places + width]
        order = np.lexsort((tail, head))
        places, head, tail = places[order], head[order], tail[order]
        at = np.arange(len(places))
        new_head = np.diff(head, prepend=-1) != 0
        new_pair = new_head | (np.diff(tail, prepend=-1) != 0)
        group = np.maximum.accumulate(np.where(new_head, at, 0))
        pair = np.maximum.accumulate(np.where(new_pair, at, 0))
        finer = rank.copy()
        finer[places] = head + pair - group
        alone = new_pair & np.append(new_pair[1:], True)
        self.levels.append(finer)
        self.open.append(places[~alone])

    def repeated(self, least: int) -> Iterator[tuple[list[int], list[int]]]:
        """Groups of places that share their first ``least`` words, in suffix order, with
        the number of words that each shares with the one before (the first: 0).

        Only groups in which two places are no farther apart than some two share words.
        """
        level = least.bit_length() - 1
        if level >= len(self.open) or not len(self.open[level]):
            return
        places = self.open[level]
        places = places[np.argsort(self.levels[-1][places])]
        shared = np.zeros(len(places), np.int64)
        left, right = places[:-1].copy(), places[1:].copy()
        for k in range(len(self.levels) - 1, -1, -1):
            same = (self.levels[k][left] == self.levels[k][right]) * (1 << k)
            left, right = left + same, right + same
        shared[1:] = left - places[:-1]
        first = np.flatnonzero(shared < least)
        number = np.cumsum(shared < least) - 1
        longest = np.maximum.reduceat(np.where(shared < least, 0, shared), first)
        order = np.lexsort((places, number))
        near = np.diff(places[order], prepend=0)
        near[first] = np.iinfo(np.int64).max
        kept = np.minimum.reduceat(near, first) <= longest
        ends = np.append(first[1:], len(places))
        for a, b in zip(first[kept].tolist(), ends[kept].tolist()):
            yield places[a:b].tolist(), [0, *shared[a + 1 : b].tolist()]


class Interval:
    """The places of an LCP interval: in order, and in lists by the word to the left."""

    __slots__ = ("chunks", "heads", "lists", "size")

    def __init__(self, place: int, left: int):
        self.chunks, self.heads, self.lists, self.size = [[place]], [place], {left: [place]}, 1

    def neighbours(self, place: int) -> Iterator[int]:
        """The last place before and the first one after a place that is not in here."""
        k = max(bisect_left(self.heads, place) - 1, 0)
        chunk = self.chunks[k]
        i = bisect_left(chunk, place)
        if i:
            yield chunk[i - 1]
        if i < len(chunk):
            yield chunk[i]
        elif k + 1 < len(self.heads):
            yield self.heads[k + 1]

    def take(self, other: Interval) -> None:
        for left, places in other.lists.items():
            if left in self.lists:
                self.lists[left] += places
            else:
                self.lists[left] = places
            for place in places:
                self._insert(place)
        self.size += other.size

    def _insert(self, place: int) -> None:
        k = max(bisect_left(self.heads, place) - 1, 0)
        chunk = self.chunks[k]
        insort(chunk, place)
        self.heads[k] = chunk[0]
        if len(chunk) > CHUNK:
            half = CHUNK // 2
            self.chunks.insert(k + 1, chunk[half:])
            self.heads.insert(k + 1, chunk[half])
            del chunk[half:]


def _meet(a: Interval, b: Interval, shared: int, left_of, least: int, found: dict) -> Interval:
    """Two intervals as one, and the maximal pairs between them that are runs."""
    if a.size < b.size:
        a, b = b, a
    if len(a.lists) > 1 or len(b.lists) > 1 or a.lists.keys() != b.lists.keys():
        for left, places in b.lists.items():
            if len(a.lists) == 1 and left in a.lists:
                continue
            for place in places:
                for other in a.neighbours(place):
                    distance = abs(place - other)
                    if distance <= shared and distance + shared >= least and left_of[other - 1] != left:
                        run = (min(place, other), distance + shared)
                        found[run] = min(found.get(run, distance), distance)
    a.take(b)
    return a


def runs(texts: list[list[bytes]], least: int = LEAST_WORDS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, by start and period."""
    suffixes = Suffixes(texts)
    word = suffixes.levels[0]
    found: dict[tuple[int, int], int] = {}
    for places, shared in suffixes.repeated(-(-least // 2)):
        stack: list[tuple[int, Interval]] = []
        left_words = word[np.array(places) - 1].tolist()
        for place, common, left in zip(places, shared, left_words):
            while len(stack) > 1 and stack[-1][0] >= common:
                depth, last = stack.pop()
                above, before = stack.pop()
                stack.append((above, _meet(before, last, depth, word, least, found)))
            stack.append((common, Interval(place, left)))
        while len(stack) > 1:
            depth, last = stack.pop()
            above, before = stack.pop()
            stack.append((above, _meet(before, last, depth, word, least, found)))
    begins = np.cumsum([0] + [len(words) + 1 for words in texts])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if found:
        owners = np.searchsorted(begins, [start for start, _ in found], "right") - 1
        for owner, ((start, length), period) in zip(owners.tolist(), found.items()):
            out[owner].append((start - int(begins[owner]), length, period))
    return [sorted(rows, key=lambda r: (r[0], r[2])) for rows in out]


def collapsed(words: list[bytes], of: list[tuple[int, int, int]]) -> bytes:
    """The words, one blank between, with only the first period of every run."""
    if not of:
        return b" ".join(words)
    kept = bytearray(b"\1") * len(words)
    for start, length, period in of:
        kept[start + period : start + length] = bytes(length - period)
    return b" ".join(compress(words, kept))


def _grouped(values: Iterable[bytes | None]) -> Iterator[list[list[bytes]]]:
    group, size = [], 0
    for value in values:
        value = value or b""
        if group and size + len(value) > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(value.split())  # at blanks and the characters 9 to 13, as bytes are split
        size += len(value) + 1
    if group:
        yield group


def find_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """<doc_id>, n_words, runs (start, length and period of each, by start and period) and
    the text collapsed to the first period of its runs."""
    run_type = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[doc_id].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(run_type)),
            T.StructField("collapsed", T.StringType()),
        ]
    )

    def run(batches):
        import pyarrow as pa

        arrow_runs = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
        for batch in batches:
            done = 0
            for group in _grouped(value.as_buffer() and value.as_buffer().to_pybytes() for value in batch.column(1)):
                found = runs(group, least)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(group)),
                        pa.array(map(len, group), pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r)) for r in rows] for rows in found], arrow_runs),
                        pa.array(list(map(collapsed, group, found)), pa.binary()).cast(pa.string()),
                    ],
                    schema.names,
                )
                done += len(group)

    found = docs.select(docs[doc_id].alias("id"), docs[text].alias("text")).mapInArrow(run, schema)
    return found.withColumnRenamed("id", doc_id)
