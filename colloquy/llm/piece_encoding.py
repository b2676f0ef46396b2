"""SentencePiece encoding and decoding as a max-plus scan over a lattice of pieces.

A text is a lattice: its edges are the vocabulary's pieces, and a cut into
pieces is a path. Path weights are added, and the best path wins (max-plus).
With a unigram model an edge weighs its score and the state of a path is its
place. With a BPE model the state is also the last piece, and a step weighs
nothing if BPE itself would keep the two pieces apart, minus infinity
otherwise: a cut is BPE's own exactly if all its neighbours are so. Both give the
ids that SentencePiece gives for the same model file.

A piece never holds a blank behind another character, so words are separate
sub-lattices and a worker keeps those that it has met. A giant text is split
into chunks in different tasks. Each gives the matrix of weights from the states
in which a path may enter it to those in which it may leave, a piece hanging
over either end included; matrices are combined associatively, in groups of
bounded size; then each chunk is traced back alone between its two states.

Defined results: a null text has null ids, an empty text none; repeated rows are
encoded each; an empty table gives no rows, and columns that are not kept do not come out; a literal U+2581 decodes to a blank; ids outside the vocabulary and
null ids decode to nothing, and a null list to a null text; broken bytes decode to
U+FFFD.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from array import array
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .pieces import SPACE, VOCABULARY, Pieces, shared_pieces, trie_of
from .store import batches_of, lean, written

CHUNK = 16_384  # characters
# Matrices combined in one task; a text of two gigabytes, Spark's limit, has
# about 131,000 chunks and so 256 groups.
GROUP = 512
# What an encoder, which serves one task, keeps at hand.
KEPT_BYTES = 48 << 20  # of words and their ids
KEPT_PAIRS = 100_000
# Longer words go through the lattice.
SHORT = 64
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
START = None  # the state before the first piece

State = tuple[int, object]  # characters past the boundary, last piece


def normalised(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


class Encoder:
    """Cuts words and chunks of normalised text into pieces."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.trie = trie_of(pieces)
        self.score_of = {piece: pieces.scores[number] for piece, number in pieces.ids.items()}
        self.longest = pieces.longest
        self.unigram = pieces.is_unigram
        self.text_of = {number: piece for piece, number in pieces.ids.items()}
        self.characters = set("".join(pieces.ids))
        # Unknown characters lie below all pieces, as in SentencePiece.
        self.unknown_score = min((pieces.scores[i] for i in pieces.ids.values()), default=0.0) - 10.0
        if any(SPACE in p[1:].lstrip(SPACE) for p in pieces.ids):
            raise ValueError("pieces that go on over a blank are not supported")
        self.words: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.pairs: dict[tuple, bool] = {}
        self.held = 0  # bytes of the words, about
        self.table = None

    # An edge is (end, piece); an unknown character is the piece -1 - its code point.

    def edges(self, text: str, at: int) -> list[tuple[int, int]]:
        found, node, end = [], self.trie, at
        for char in text[at : at + self.longest]:
            next_ = node.get(char)
            if next_ is None:
                break
            node, number = next_
            end += 1
            if number is not None:
                found.append((end, number))
        if not found or found[0][0] != at + 1:
            found.insert(0, (at + 1, -1 - ord(text[at])))
        return found

    def weight(self, piece: int) -> float:
        if not self.unigram:
            return 0.0
        return self.pieces.scores[piece] if piece >= 0 else self.unknown_score

    def spelled(self, piece) -> str:
        return self.text_of[piece] if piece >= 0 else chr(-1 - piece)

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the neighbours whose union scores best are joined first, from the left."""
        score_of, none = self.score_of.get, -math.inf
        parts = list(text)
        unions = [score_of(a + b, none) for a, b in zip(parts, parts[1:])]
        while unions:
            best = max(unions)
            if best == none:
                break
            k = unions.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del unions[k]
            if k < len(unions):
                unions[k] = score_of(parts[k] + parts[k + 1], none)
            if k:
                unions[k - 1] = score_of(parts[k - 1] + parts[k], none)
        return parts

    def apart(self, before, piece) -> bool:
        """Whether BPE keeps the two pieces as they are, side by side."""
        if self.unigram:
            return True
        key = (before, piece)
        known = self.pairs.get(key)
        if known is None:
            right = self.spelled(piece)
            left = "" if before is START else self.spelled(before)
            known = self.merged(left + right) == ([left, right] if left else [right])
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def forward(self, text: str, at: int, last, stop: int) -> dict[int, dict]:
        """Best weights by place and state of the paths from one state; pieces begin before stop."""
        places: dict[int, dict] = {at: {last: (0.0, None)}}
        for i in range(at, stop):
            here = places.get(i)
            if not here:
                continue
            for end, piece in self.edges(text, i):
                weight, state = self.weight(piece), 0 if self.unigram else piece
                for before, (sum_, _) in here.items():
                    if self.apart(before, piece):
                        there = places.setdefault(end, {})
                        old = there.get(state)
                        if old is None or sum_ + weight > old[0]:
                            there[state] = (sum_ + weight, (i, before, piece))
        return places

    @staticmethod
    def trace(places, end: int, state) -> list[int]:
        out = []
        step = places[end][state][1]
        while step:
            out.append(step[2])
            step = places[step[0]][step[1]][1]
        return out[::-1]

    def cut(self, word: str) -> list[int]:
        """The pieces of one word, or of a part of it between characters that no piece has.

        The one path of finite weight through a BPE lattice is what merging gives; for a short
        word, merging is the fastest way to it.
        """
        if self.unigram:
            return self._best_path(word)
        if len(word) > SHORT:
            return self._only_path(word)
        ids = self.pieces.ids
        return [ids[part] if part in ids else -1 - ord(part) for part in self.merged(word)]

    def _best_path(self, word: str) -> list[int]:
        n = len(word)
        best, back = [0.0] + [-math.inf] * n, [(0, 0)] * (n + 1)
        for i in range(n):
            if best[i] > -math.inf:
                for end, piece in self.edges(word, i):
                    total = best[i] + self.weight(piece)
                    if total > best[end]:
                        best[end], back[end] = total, (i, piece)
        out, at = [], n
        while at:
            at, piece = back[at]
            out.append(piece)
        return out[::-1]

    def _only_path(self, word: str) -> list[int]:
        """The one path of finite weight, longest pieces tried first.

        A prefix of a word has one such path at most, so a place is tried once.
        """
        n, apart, edges = len(word), self.apart, self.edges
        if not n:
            return []
        seen, path, left = set(), [START], [edges(word, 0)]
        while True:
            last, open_ = path[-1], left[-1]
            while open_:
                end, piece = open_.pop()
                if end not in seen and apart(last, piece):
                    seen.add(end)
                    path.append(piece)
                    if end == n:
                        return path[1:]
                    left.append(edges(word, end))
                    break
            else:
                path.pop()
                left.pop()

    def _keep(self, known: dict[str, bytes], word: str, ids: bytes) -> bytes:
        self.held += 200 + 2 * len(word) + len(ids)
        if self.held > KEPT_BYTES:
            self.words.clear()
            self.plain.clear()
            self.held = 0
        known[word] = ids
        return ids

    def word(self, word: str) -> bytes:
        """The ids of a word as 32-bit numbers."""
        known = self.words.get(word)
        return self._keep(self.words, word, self.new_word(word)) if known is None else known

    def new_word(self, word: str) -> bytes:
        pieces: list[int] = []
        start = 0
        if not self.characters.issuperset(word):
            for at, char in enumerate(word):
                if char not in self.characters:
                    pieces += self.cut(word[start:at])
                    pieces.append(-1 - ord(char))
                    start = at + 1
        pieces += self.cut(word[start:])
        return self.numbers(pieces)

    def numbers(self, pieces: Iterable[int]) -> bytes:
        out = array("i")
        for piece in pieces:
            if piece >= 0:
                out.append(piece)
            elif self.pieces.bytes:
                out.extend([self.pieces.bytes[b] for b in chr(-1 - piece).encode()])
            else:
                out.append(self.pieces.unknown)
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, word by word."""
        if not text or SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            return b"".join(map(self.word, _WORDS.findall(normalised(text))))
        # Single blanks part the words; each is kept without the blank before it.
        words, known = text.split(" "), self.plain
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            own = {word: known.get(word) or self.new_word(SPACE + word) for word in set(words)}
            for word, ids in own.items():
                if word not in known:
                    self._keep(known, word, ids)
            return b"".join(map(own.__getitem__, words))

    def encode_all(self, texts: Sequence[str | None]) -> list[bytes | None]:
        """The ids of whole texts; what is new in them all is cut at once."""
        split = [t.split(" ") if self._is_plain(t) else None for t in texts]
        known = self.plain
        own = {w: known.get(w) for words in split if words for w in words}
        new = [w for w, ids in own.items() if ids is None]
        for word, ids in zip(new, self.new_words([SPACE + w for w in new])):
            own[word] = self._keep(known, word, ids)
        return [
            None if text is None else b"".join(map(own.__getitem__, words)) if words else self.encode(text)
            for text, words in zip(texts, split)
        ]

    @staticmethod
    def _is_plain(text: str | None) -> bool:
        """Whether single blanks part the text's words."""
        return bool(text) and not (SPACE in text or "  " in text or text[0] == " " or text[-1] == " ")

    def new_words(self, words: list[str]) -> list[bytes]:
        """The ids of many words: BPE merges a pair of each word a step, all words together."""
        out: list = [None] * len(words)
        if self.unigram:
            return [self.new_word(w) for w in words]
        keys, unions, scores, letter = self._pairs_table()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), sizes)
        ids = letter[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        odd = sizes > SHORT
        odd[owner[ids < 0]] = True
        for k in np.flatnonzero(odd | (sizes == 0)).tolist():
            out[k] = self.new_word(words[k])
        ids, owner = ids[~odd[owner]], owner[~odd[owner]]
        while len(ids):
            # The union of each id with the one after it in its word, if there is one.
            pair = ids[:-1] * self.pieces.size + ids[1:]
            at = np.searchsorted(keys, pair)
            at[at == len(keys)] = 0
            found = (keys[at] == pair) & (owner[:-1] == owner[1:])
            score = np.append(np.where(found, scores[at], -np.inf), -np.inf)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            sizes = np.diff(first, append=len(owner))
            best = np.maximum.reduceat(score, first)
            done = best == -np.inf
            if done.any():
                flat = ids.astype(np.int32).tobytes()
                for k, a, n in zip(owner[first[done]].tolist(), first[done].tolist(), sizes[done].tolist()):
                    out[k] = flat[4 * a : 4 * (a + n)]
            top = np.flatnonzero((score == np.repeat(best, sizes)) & (score > -np.inf))
            top = top[np.diff(owner[top], prepend=-1) != 0]  # the first of each word
            ids[top] = unions[at[top]]
            stay = np.repeat(~done, sizes)
            stay[top + 1] = False
            ids, owner = ids[stay], owner[stay]
        return out

    def _pairs_table(self):
        """Sorted keys of the pairs of pieces whose union is a piece, these unions and their scores; single letters."""
        if self.table is None:
            ids, size = self.pieces.ids, self.pieces.size
            rows = sorted(
                (ids[piece[:i]] * size + ids[piece[i:]], number)
                for piece, number in ids.items()
                for i in range(1, len(piece))
                if piece[:i] in ids and piece[i:] in ids
            )
            keys, unions = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.full(1, -1), np.zeros(1, np.int64))
            # Letters that are in no larger piece but beside others that are no pieces go the other way.
            odd = {c for piece in ids for c in piece if c not in ids}
            odd |= {c for piece in ids if odd.intersection(piece) for c in piece}
            letter = np.full(0x110000, -1, np.int64)  # by code point
            for c, number in ids.items():
                if len(c) == 1 and c not in odd:
                    letter[ord(c)] = number
            self.table = keys, unions, np.array(self.pieces.scores)[unions], letter
        return self.table

    # Chunks: ``before`` and ``after`` are the neighbours' characters that pieces may reach.

    def entries(self, before: str, chunk: str, after: str) -> list[State]:
        """The states in which a path may come into a chunk."""
        text, b = before + chunk + after, len(before)
        found = set()
        for at in range(max(0, b - self.longest), b):
            for end, piece in self.edges(text, at):
                if end >= b:
                    found.add((end - b, 0 if self.unigram else piece))
        return sorted(found)

    def fragments(self, chunk: str, after: str):
        """Where the first word begins in the chunk and where its last word does, if any."""
        starts = [m.start() for m in re.finditer(f"(?<=[^{SPACE}]){SPACE}", chunk)]
        return (starts[0], starts[-1]) if starts else None

    def _exits(self, places, stop) -> dict[State, float]:
        return {
            (end - stop, state): total
            for end, states in places.items()
            if end >= stop
            for state, (total, _) in states.items()
        }

    def _middle(self, text: str) -> float:
        if not self.unigram:
            return 0.0
        ids = (p for w in _WORDS.findall(text) for p in self.cut(w))
        return sum(map(self.weight, ids))

    def matrix(self, before: str, chunk: str, after: str, first: bool) -> dict[State, dict[State, float]]:
        """Weights from each state of entry to each of exit."""
        entries = [(0, START)] if first else self.entries(before, chunk, after)
        stop, text = len(chunk), chunk + after
        bounds = self.fragments(chunk, after)
        out: dict[State, dict[State, float]] = {}
        if bounds is None:
            for at, state in entries:
                exits = self._exits(self.forward(text, at, state, stop), stop)
                if exits:
                    out[at, state] = exits
            return out
        head, tail = bounds
        middle = self._middle(chunk[head:tail])
        exits = self._exits(self.forward(text, tail, START, stop), stop)
        for at, state in entries:
            if at > head:
                continue
            ends = self.forward(text[:head], at, state, head).get(head)
            if ends:
                total = max(t for t, _ in ends.values()) + middle
                out[at, state] = {k: total + v for k, v in exits.items()}
        return out

    def trace_chunk(self, chunk: str, after: str, enter: State, leave: State) -> bytes:
        """The ids of the pieces that begin in the chunk, between its two states."""
        stop, text = len(chunk), chunk + after
        bounds = self.fragments(chunk, after)
        at, state = enter
        end = (stop + leave[0], leave[1])
        if bounds is None:
            if at >= stop:
                return b""
            return self.numbers(self.trace(self.forward(text, at, state, stop), *end))
        head, tail = bounds
        places = self.forward(text[:head], at, state, head)
        best = max(places[head], key=lambda k: places[head][k][0])
        parts = [self.numbers(self.trace(places, head, best))]
        parts += [self.word(w) for w in _WORDS.findall(chunk[head:tail])]
        parts.append(self.numbers(self.trace(self.forward(text, tail, START, stop), *end)))
        return b"".join(parts)


def combined(a: dict, b: dict) -> dict:
    """The max-plus product of two matrices."""
    out: dict = {}
    for enter, exits in a.items():
        row: dict = {}
        for state, total in exits.items():
            for leave, more in b.get(state, {}).items():
                if leave not in row or total + more > row[leave]:
                    row[leave] = total + more
        if row:
            out[enter] = row
    return out


def best_states(matrices: Sequence[dict], enter: State, leave: State | None) -> list[State]:
    """The states of the best path at all boundaries, the two ends included."""
    totals, backs = {enter: 0.0}, []
    for matrix in matrices:
        new: dict = {}
        for state, total in totals.items():
            for after, more in matrix.get(state, {}).items():
                if after not in new or total + more > new[after][0]:
                    new[after] = (total + more, state)
        backs.append({k: s for k, (_, s) in new.items()})
        totals = {k: t for k, (t, _) in new.items()}
    state = leave if leave is not None else max(totals, key=totals.get)
    out = [state]
    for back in reversed(backs):
        state = back[state]
        out.append(state)
    return out[::-1]


def _ids_array(parts: list[bytes | None]):
    import pyarrow as pa

    sizes = np.array([len(p) // 4 if p is not None else 0 for p in parts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(p for p in parts if p), np.int32))
    mask = pa.array([p is None for p in parts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)


def in_groups(frame: DataFrame, keys: list[str], order: str, run, schema: str) -> DataFrame:
    """Rows that ``run`` makes of ((key values), {column: values}), group after group.

    A task streams its sorted rows and holds one group, which is of bounded size. The
    number of partitions is given, as the work is heavier than its few bytes.
    """
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, kinds = frame.columns, to_arrow_schema(T._parse_datatype_string(schema))

    def groups(batches):
        held, columns = None, {}
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                row = dict(zip(names, values))
                key = tuple(row[k] for k in keys)
                if key != held:
                    if held is not None:
                        yield held, columns
                    held, columns = key, {n: [] for n in names}
                for name, value in row.items():
                    columns[name].append(value)
        if held is not None:
            yield held, columns

    def made(batches):
        import pyarrow as pa

        for rows in batches_of(run(groups(batches)), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kinds)], schema=kinds)

    return frame.repartition(parts, *keys).sortWithinPartitions(*keys, order).mapInArrow(made, schema)


def encode(
    docs: DataFrame,
    *,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    ids: str = "ids",
    chunk: int = CHUNK,
    group: int = GROUP,
    vocabulary: str = VOCABULARY,
    round_trip: str | None = None,
) -> DataFrame:
    """The kept columns and the ids of the text's pieces; with ``round_trip`` also a column of that
    name: whether the ids decode to the text again (so do those of a null text)."""
    pieces, shared = shared_pieces(docs.sparkSession.sparkContext, vocabulary)
    if chunk < pieces.longest:
        raise ValueError(f"a chunk needs {pieces.longest} characters at least")
    # Inside, the kept columns have names of their own, so theirs may be any.
    outside = [*keep, ids, *([round_trip] if round_trip else [])]
    keep = [f"kept{k}" for k in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(k) for c, k in zip(outside, keep)), F.col(text).alias("_text"))
    kept = [rows.schema[c] for c in keep]
    long = F.length("_text") >= chunk
    checked = [T.StructField("_same", T.BooleanType())] if round_trip else []
    final = T.StructType([*kept, T.StructField("_ids", T.ArrayType(T.IntegerType())), *checked])

    def encode_short(batches):
        import pyarrow as pa

        encoder, spelled = Encoder(shared.value), spellings(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(n_kept).to_pylist()
                found = encoder.encode_all(texts)
                columns = [*part.columns[:n_kept], _ids_array(found)]
                if checked:
                    same = [t is None or spelled_out(spelled, array("i", x)) == t for t, x in zip(texts, found)]
                    columns.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, final.names)

    n_kept = len(keep)
    short = rows.where(~F.coalesce(long, F.lit(False))).mapInArrow(lean(encode_short), final)

    piece_fields = "_row string, _place int, _parts int, _before string, _chunk string, _after string"
    split_schema = T.StructType([*T._parse_datatype_string(piece_fields).fields, *kept])

    def split(batches):
        import pyarrow as pa

        reach = shared.value.longest
        for batch in batches:
            for k, value in enumerate(batch.column(len(keep))):
                whole, row = normalised(value.as_py()), uuid.uuid4().hex
                parts = -(-len(whole) // chunk)
                for start in range(0, parts, 64):
                    at = [chunk * p for p in range(start, min(parts, start + 64))]
                    columns = [
                        pa.array([row] * len(at)),
                        pa.array([a // chunk for a in at], pa.int32()),
                        pa.array([parts] * len(at), pa.int32()),
                        pa.array([whole[max(0, a - reach) : a] for a in at]),
                        pa.array([whole[a : a + chunk] for a in at]),
                        pa.array([whole[a + chunk : a + chunk + reach] for a in at]),
                    ]
                    same = [c.take(pa.array([k] * len(at))) for c in batch.columns[: len(keep)]]
                    yield pa.RecordBatch.from_arrays([*columns, *same], split_schema.names)

    # The text's hash goes with its chunks, for the check at the end.
    split_rows = rows.where(long)
    if round_trip:
        keep.append("_hash")
        kept.append(T.StructField("_hash", T.LongType()))
        split_rows = split_rows.select(*keep[:-1], F.xxhash64("_text").alias("_hash"), "_text")
    split_schema = T.StructType([*T._parse_datatype_string(piece_fields).fields, *kept])
    chunks = written(split_rows.mapInArrow(lean(split), split_schema), "chunks")

    def matrices(batches):
        import pyarrow as pa

        encoder = Encoder(shared.value)
        for batch in batches:
            place, before, middle, after = (batch.column(k).to_pylist() for k in (1, 3, 4, 5))
            made = [pickle.dumps(encoder.matrix(b, m, a, p == 0)) for p, b, m, a in zip(place, before, middle, after)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(made, pa.binary())], ["_row", "_place", "matrix"]
            )

    of_chunks = chunks.select("_row", "_place", "_parts", "_before", "_chunk", "_after").mapInArrow(
        lean(matrices), "_row string, _place int, matrix binary"
    )
    of_chunks = written(of_chunks.withColumn("_group", (F.col("_place") / group).cast("int")), "matrices")

    def combine(groups):
        for (row, group), found in groups:
            total = None
            for value in found["matrix"]:
                matrix = pickle.loads(value)
                total = matrix if total is None else combined(total, matrix)
            yield row, group, pickle.dumps(total)

    def between(groups):
        """The two states of each group of a text."""
        for (row,), found in groups:
            states = best_states([pickle.loads(m) for m in found["matrix"]], (0, START), None)
            for group, *pair in zip(found["_group"], states, states[1:]):
                yield row, group, pickle.dumps(tuple(pair))

    def within(groups):
        """The two states of each chunk of a group."""
        for (row, _), found in groups:
            enter, leave = pickle.loads(found["ends"][0])
            states = best_states([pickle.loads(m) for m in found["matrix"]], enter, leave)
            for place, *pair in zip(found["_place"], states, states[1:]):
                yield row, place, pickle.dumps(tuple(pair))

    of_groups = in_groups(of_chunks, ["_row", "_group"], "_place", combine, "_row string, _group int, matrix binary")
    ends = in_groups(of_groups, ["_row"], "_group", between, "_row string, _group int, ends binary")
    states = in_groups(
        of_chunks.join(ends, ["_row", "_group"]), ["_row", "_group"], "_place", within, "_row string, _place int, ends binary"
    )
    # Written, so that no task runs two Python functions at a time, each with a worker of its own.
    # Joined alike at every size, as what it costs at a small one is carried on to a large one.
    states = written(states, "chunk-states").hint("merge")
    parts_schema = T.StructType(
        [
            T.StructField("_row", T.StringType()),
            T.StructField("_place", T.IntegerType()),
            T.StructField("_ids", T.ArrayType(T.IntegerType())),
            *kept,
        ]
    )

    def trace(batches):
        import pyarrow as pa

        encoder = Encoder(shared.value)
        for batch in batches:
            middle, after, ends = (batch.column(k).to_pylist() for k in (2, 3, 4))
            found = [encoder.trace_chunk(m, a, *pickle.loads(e)) for m, a, e in zip(middle, after, ends)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], _ids_array(found), *batch.columns[5:]], parts_schema.names
            )

    parts = (
        chunks.join(states, ["_row", "_place"])
        .select("_row", "_place", "_chunk", "_after", "ends", *keep)
        .mapInArrow(lean(trace), parts_schema)
    )
    ordered = F.array_sort(F.collect_list(F.struct("_place", "_ids")))
    whole = parts.groupBy("_row").agg(
        *(F.first(c).alias(c) for c in keep), F.flatten(F.transform(ordered, lambda p: p["_ids"])).alias(ids)
    )
    whole = whole.withColumnRenamed(ids, "_ids") if ids != "_ids" else whole
    if round_trip:
        spelled_again = decode(whole.withColumn("_copy", F.col("_ids")), ids="_copy", text="_decoded", vocabulary=vocabulary)
        whole = spelled_again.withColumn("_same", F.xxhash64("_decoded") == F.col("_hash")).drop("_decoded", "_hash")
    return short.unionByName(whole.select(*final.names)).toDF(*outside)


def spellings(pieces: Pieces) -> list[bytes]:
    """What each id stands for, in bytes."""
    spelled = [b""] * pieces.size
    for piece, number in pieces.ids.items():
        spelled[number] = piece.encode()
    for byte, number in pieces.bytes.items():
        spelled[number] = bytes([byte])
    return spelled


def spelled_out(spelled: list[bytes], ids: Iterable[int]) -> str:
    """The text of ids that are all in the vocabulary."""
    line = b"".join([spelled[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
    return line[1:] if line.startswith(" ") else line


def decode(frame: DataFrame, *, ids: str = "ids", text: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """The frame with the text of its ids in place of these."""
    pieces, _ = shared_pieces(frame.sparkSession.sparkContext, vocabulary)
    spelled = spellings(pieces)
    rest = [c for c in frame.columns if c != ids]
    rows = frame.select(*rest, ids)
    schema = T.StructType([*(rows.schema[c] for c in rest), T.StructField(text, T.StringType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(len(rest))
            numbers = lists.values.to_numpy(zero_copy_only=False)
            if numbers.dtype.kind == "f":
                numbers = np.nan_to_num(numbers, nan=-1).astype(np.int64)
            numbers = np.where((numbers < 0) | (numbers >= len(spelled)), 0, numbers)
            starts, valid = lists.offsets.to_numpy(), lists.is_valid().to_pylist()
            out = []
            for k, ok in enumerate(valid):
                out.append(spelled_out(spelled, numbers[starts[k] : starts[k + 1]].tolist()) if ok else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(out, pa.string())], schema.names)

    return rows.mapInArrow(lean(run), schema)
