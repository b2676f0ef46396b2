"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the test items make one automaton; documents are
streamed through it word by word, keeping the length of the longest match that
ends at each word. Nothing is shuffled: only the automaton travels.

Words are lower-cased (A-Z) runs of ASCII letters, digits and bytes of other
characters. A window is ``width`` consecutive words of an item, or the whole
item if it has fewer.

Defined results: a null text has no words and stays null; items without words
have no windows; items with a null id count as hits but are not listed;
repeated rows are scanned one by one; an empty benchmark hits nothing; other
columns of the documents, whatever their names, are carried along unread.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import fields, lean
from .words import LOWER_ALPHANUMERIC, hashed_texts, text_bytes, word_hashes

# Items are cut into blocks of about this many words, an automaton each (about
# 300 bytes a word), and so many blocks are held by a task at once. A larger
# benchmark takes more passes over the rows, within the same stage.
BLOCK_WORDS = 100_000
BLOCKS_AT_ONCE = 4


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, width: int):
        self.width = width
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.vocabulary: dict[int, int] = {}
        self.sequences: list[tuple[object, list[int]]] = []

    def add(self, item, hashes: np.ndarray) -> None:
        words = [self.vocabulary.setdefault(h, len(self.vocabulary)) for h in hashes.tolist()]
        self.sequences.append((item, words))
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.length) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The state for the strings of target that end after state and word."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        new = self._state(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, self.next[state][word])
        return new

    def finish(self) -> Automaton:
        """Note at each state which windows end there, and of which items."""
        self.items: dict[int, set] = {}  # by the state of a full window
        self.short: dict[int, dict[int, set]] = {}  # by state and length, items of fewer words
        for item, words in self.sequences:
            state = 0
            for at, word in enumerate(words, 1):
                state = self.next[state][word]
                if at >= self.width:
                    self.items.setdefault(self.window_state(state), set()).add(item)
            if 0 < len(words) < self.width:
                while self.length[self.link[state]] >= len(words):
                    state = self.link[state]
                self.short.setdefault(state, {}).setdefault(len(words), set()).add(item)
        shortest = [n for lengths in self.short.values() for n in lengths]
        self.least = min(shortest + [self.width] * bool(self.items), default=0)
        # The nearest state on the way to the root, itself included, where an item of fewer words ends.
        self.nearest = [-1] * len(self.link) if self.short else None
        if self.short:
            for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                self.nearest[state] = state if state in self.short else self.nearest[self.link[state]]
        known = np.fromiter(self.vocabulary, np.uint64, len(self.vocabulary))
        order = np.argsort(known)
        self.known, self.ids = known[order], np.fromiter(self.vocabulary.values(), np.int64, len(known))[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.known & np.uint64(len(self.seen) - 1)).astype(np.int64)] = True
        del self.sequences, self.vocabulary
        return self

    def window_state(self, state: int) -> int:
        """The state of the last ``width`` words of a match of at least that length."""
        while self.length[self.link[state]] >= self.width:
            state = self.link[state]
        return state

    def runs(self, hashes: np.ndarray):
        """The runs of item words long enough to hold a window: first place and word ids."""
        if not self.least or len(hashes) < self.least:
            return
        maybe = np.flatnonzero(self.seen[(hashes & np.uint64(len(self.seen) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
        right = self.known[place] == hashes[maybe]
        at, ids = maybe[right], self.ids[place[right]]
        if len(at) < self.least:
            return
        breaks = np.flatnonzero(np.diff(at) != 1) + 1
        begins, ends = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(at)]])
        for k in np.flatnonzero(ends - begins >= self.least):
            yield int(at[begins[k]]), ids[begins[k] : ends[k]].tolist()

    def match(self, hashes: np.ndarray, spans: list, found: set) -> None:
        """Add the word spans (first, end) of all windows and the items they belong to."""
        moves, link, length, width = self.next, self.link, self.length, self.width
        for first, ids in self.runs(hashes):
            state = matched = 0
            for at, word in enumerate(ids, first + 1):
                target = moves[state].get(word)
                while target is None and state:
                    state = link[state]
                    matched = length[state]
                    target = moves[state].get(word)
                if target is None:
                    continue
                state, matched = target, matched + 1
                if matched >= width:
                    found |= self.items[self.window_state(state)]
                    spans.append((at - width, at))
                if self.nearest:
                    end = self.nearest[state]
                    while end > 0:
                        for n, items in self.short[end].items():
                            if n <= matched:
                                found |= items
                                spans.append((at - n, at))
                        end = self.nearest[link[end]]


def united(spans: list) -> list[tuple[int, int]]:
    """Spans merged where they overlap, in order."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first < out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((first, end))
    return out


def automata(items: DataFrame, item_id: str, text: str, width: int, block_words: int):
    """One automaton for each block of items; the driver holds one block at a time."""
    block, words = Automaton(width), 0
    for row in items.select(F.col(item_id).alias("item"), F.col(text).alias("words")).toLocalIterator():
        hashes = word_hashes((row.words or "").encode(), LOWER_ALPHANUMERIC)[0]
        if words and words + len(hashes) > block_words:
            yield block.finish()
            block, words = Automaton(width), 0
        if len(hashes):
            block.add(row.item, hashes)
            words += len(hashes)
    yield block.finish()


def _passes(docs, items, item_id, item_text, text, width, block_words, blocks_at_once, final, final_schema):
    """Stream the rows through all automata; ``final`` turns the last pass's findings into rows."""
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(a) for a in automata(items, item_id, item_text, width, block_words)]
    groups = [blocks[i : i + blocks_at_once] for i in range(0, len(blocks), blocks_at_once)]
    carry = "_carried"
    while carry in docs.columns:
        carry += "_"

    def scan(group, first, last):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                names = batch.schema.names
                texts = text_bytes(batch.column(names.index(text)))
                before = None if first else batch.column(names.index(carry)).to_pylist()
                found_rows = []
                for k, (hashes, begin, size) in enumerate(hashed_texts(texts, LOWER_ALPHANUMERIC)):
                    spans, found = ([], set()) if first else pickle.loads(before[k])
                    for block in group:
                        block.value.match(hashes, spans, found)
                    spans = united(spans)
                    found_rows.append(
                        (len(hashes), spans, found, begin, size) if last else pickle.dumps((spans, found))
                    )
                keep = [i for i, n in enumerate(names) if n != carry]
                rest = pa.RecordBatch.from_arrays([batch.column(i) for i in keep], [names[i] for i in keep])
                if last:
                    out = final(rest, texts, found_rows)
                    if out.num_rows:
                        yield out
                else:
                    yield pa.RecordBatch.from_arrays(
                        [*rest.columns, pa.array(found_rows, pa.binary())], [*rest.schema.names, carry]
                    )

        return run

    for n, group in enumerate(groups):
        last = n == len(groups) - 1
        schema = final_schema if last else fields(docs, (carry, "binary")) if n == 0 else docs.schema
        docs = docs.mapInArrow(lean(scan(group, n == 0, last)), schema)
    return docs


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    block_words: int = BLOCK_WORDS,
    blocks_at_once: int = BLOCKS_AT_ONCE,
) -> DataFrame:
    """For every document its words, hit words, spans (word numbers, end excluded) and items.

    Returns <doc_id>, n_words, n_hit, spans, items.
    """
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("words"))
    item_type = items.schema[item_id].dataType
    schema = T.StructType(
        [
            T.StructField(doc_id, docs.schema[doc_id].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("spans", T._parse_datatype_string("array<struct<first:bigint,end:bigint>>")),
            T.StructField("items", T.ArrayType(item_type)),
        ]
    )

    def rows(rest, texts, found):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        spans = [[{"first": a, "end": b} for a, b in spans] for _, spans, *_ in found]
        span_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        listed = [sorted(x for x in ids if x is not None) for _, _, ids, *_ in found]
        return pa.RecordBatch.from_arrays(
            [
                rest.column(0),
                pa.array([n for n, *_ in found], pa.int64()),
                pa.array([sum(b - a for a, b in spans) for _, spans, *_ in found], pa.int64()),
                pa.array(spans, span_type),
                pa.array(listed, pa.list_(to_arrow_type(item_type))),
            ],
            schema.names,
        )

    return _passes(source, items, item_id, item_text, "words", width, block_words, blocks_at_once, rows, schema)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    min_span: int = 0,
    max_coverage: float = 0.5,
    block_words: int = BLOCK_WORDS,
    blocks_at_once: int = BLOCKS_AT_ONCE,
) -> DataFrame:
    """Documents without their test passages, all columns kept.

    Spans of at least ``min_span`` words are cut out of the text, from their
    first to their last byte. A document of which more than ``max_coverage`` of
    the words are hit is dropped whole; so is one that has nothing left.
    """

    def rows(rest, texts, found):
        import pyarrow as pa

        at = rest.schema.names.index(text)
        keep, cleaned = [], []
        for row, (n_words, spans, _, begin, size) in zip(texts, found):
            hit = sum(b - a for a, b in spans)
            cut = [(a, b) for a, b in spans if b - a >= min_span]
            keep.append(not hit or (hit <= max_coverage * n_words and hit < n_words))
            if not cut or row is None:
                cleaned.append(row)
                continue
            parts, done = [], 0
            for a, b in cut:
                parts.append(row[done : begin[a]])
                done = begin[b - 1] + size[b - 1]
            cleaned.append(b"".join([*parts, row[done:]]))
        columns = list(rest.columns)
        columns[at] = pa.array(cleaned, pa.binary()).cast(rest.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, rest.schema.names).filter(pa.array(keep, pa.bool_()))

    return _passes(docs, items, item_id, item_text, text, width, block_words, blocks_at_once, rows, docs.schema)
