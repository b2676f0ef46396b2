"""Language identification with segmentation-marginalised unigrams.

For each language every piece of a fixed public vocabulary has a probability. A
word's probability is the sum over all ways to cut it into pieces, which a
forward pass adds up; a text is the product of its words. The probabilities are
fitted by expectation maximisation over the same segmentations.

Words are runs of letters and their marks, lower-cased, with a blank in front, however long: in scripts
without blanks a word may be a sentence.
Characters outside the vocabulary have one fixed small probability.

Defined results: null texts and texts without a letter get ``und`` with score 0;
rows with a null language or text are not learned from; repeated rows are each
predicted, and each counted when learned from; ties go to the language that
sorts first; with nothing learned every text is ``und``; columns other than the
text are never inputs of a prediction.
"""

from __future__ import annotations

import itertools
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import SPACE, VOCABULARY, shared_pieces, trie_of
from .store import fields, lean, written

UNDETERMINED = "und"
UNKNOWN_CHARACTER = 1e-8
# Words whose scores a Python worker keeps at hand.
KEPT_WORDS = 200_000
# Words that are cut and scored together.
AT_ONCE = 8_000
# A longer text is read in parts that end at white space.
PART = 1 << 20
# A text is not in a language if so small a share of its learned stretches is as improbable.
RARE = 0.001
# Longer words, with the blank in front, could underflow: their sums are kept as logarithms.
PLAIN = 33
# What a text may be less probable than that, per character, as the stretches are learned from.
MARGIN = 0.1
# Rates are counted in steps of 1 / BINS.
BINS = 50
# Words of the longest stretches.
LONGEST = 4096
WORD = r"\p{L}[\p{L}\p{M}]*"
NO_CHARACTER = 0x110000
# ASCII lower-cased, with a blank for all but letters.
ASCII_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))


@dataclass
class LanguageModel:
    languages: list[str]
    probabilities: np.ndarray  # piece x language; the last row is for unknown characters
    prior: np.ndarray


class FlatTrie:
    """A trie as arrays, in which many walks take a step at once. Nodes are numbers, the root is 0."""

    def __init__(self, trie: dict):
        keys, numbers, left = [], [-1], [(trie, 0)]
        while left:
            below, node = left.pop()
            for char, (further, number) in below.items():
                keys.append(node << 21 | ord(char))
                numbers.append(-1 if number is None else number)
                left.append((further, len(keys)))
        self.piece = np.array(numbers, np.int64)
        # (node, character) -> node by open addressing, a quarter full at most.
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.nodes = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        key, node = np.array(keys, np.int64), np.arange(1, len(keys) + 1)
        slot = self._slots(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] == -1)
            self.keys[slot[free]], self.nodes[slot[free]] = key[free], node[free]
            # Of several that take one slot the last stays there.
            lost = np.flatnonzero(self.keys[slot] != key)
            key, node, slot = key[lost], node[lost], slot[lost] + 1 & self.mask

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def after(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes after one more character each, 0 where the trie has none."""
        key = node << 21 | char
        slot = self._slots(key)
        there = self.keys[slot]
        out = np.where(there == key, self.nodes[slot], 0)
        left = np.flatnonzero((there != key) & (there != -1))
        slot = slot[left]
        while len(left):
            slot = slot + 1 & self.mask
            there = self.keys[slot]
            hit = there == key[left]
            out[left[hit]] = self.nodes[slot[hit]]
            more = ~hit & (there != -1)
            left, slot = left[more], slot[more]
        return out


_FLAT: list = []


def flat_of(trie: dict) -> FlatTrie:
    """The trie as arrays. A worker holds the last one, as it does the trie."""
    if not _FLAT or _FLAT[0] is not trie:
        _FLAT[:] = [trie, FlatTrie(trie)]
    return _FLAT[1]


class Lattice:
    """All ways to cut words into pieces, for many words at once."""

    def __init__(self, trie: dict, unknown: int):
        self.trie, self.unknown = trie, unknown
        self.flat = flat_of(trie)

    def pieces_at(self, text: str, at: int):
        """(end, piece) of all pieces that begin at a place."""
        node, single = self.trie, False
        for j in range(at, len(text)):
            step = node.get(text[j])
            if step is None:
                break
            node, number = step
            if number is not None:
                single |= j == at
                yield j + 1, number
        if not single:
            yield at + 1, self.unknown

    def steps(self, words: list[str]):
        """All pieces found in the words, in groups (begin, end, words, pieces) by begin; within one no two are of one word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        longest = int(lengths.max(initial=0))
        chars = np.full((len(words), longest), NO_CHARACTER, np.int64)
        chars[np.arange(longest) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        chars = np.ascontiguousarray(chars.T)
        for begin in range(longest):
            at = np.flatnonzero(lengths > begin)
            node, alone = np.zeros(len(at), np.int64), at
            for end in range(begin + 1, longest + 1):
                node = self.flat.after(node, chars[end - 1, at])
                found = np.flatnonzero(node)
                at, node = at[found], node[found]
                piece = self.flat.piece[node]
                whole = np.flatnonzero(piece >= 0)
                if end == begin + 1:
                    alone = np.setdiff1d(alone, at[whole], assume_unique=True)
                    if len(alone):
                        yield begin, end, alone, np.full(len(alone), self.unknown)
                if len(whole):
                    yield begin, end, at[whole], piece[whole]
                if not len(at):
                    break

    def forward(self, words: list[str], probabilities: np.ndarray):
        """Forward sums [place, word, language], the words' lengths, and the steps."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sums = np.zeros((int(lengths.max(initial=0)) + 1, len(words), probabilities.shape[1]))
        sums[0] = 1.0
        groups = []
        for group in self.steps(words):
            begin, end, word, piece = group
            sums[end][word] += sums[begin].take(word, axis=0) * probabilities.take(piece, axis=0)
            groups.append(group)
        return sums, lengths, groups

    def log_probabilities(self, words: list[str], probabilities: np.ndarray) -> np.ndarray:
        """log P(word | language) by word and language."""
        out = np.zeros((len(words), probabilities.shape[1]))
        plain = [k for k, word in enumerate(words) if len(word) <= PLAIN]
        sums, lengths, _ = self.forward([words[k] for k in plain], probabilities)
        out[plain] = np.log(sums[lengths, np.arange(len(plain))])
        if len(plain) < len(words):
            logs = np.log(probabilities)
            for k, word in enumerate(words):
                if len(word) > PLAIN:
                    for _, last in self._logs_forward(word, logs):
                        out[k] = last
        return out

    def _logs_forward(self, word: str, logs: np.ndarray):
        """(place, log of the forward sum) along a word of any length; holds as many sums as a piece is long."""
        sums = {0: np.zeros(logs.shape[1])}
        for i in range(len(word)):
            here = sums.pop(i)
            yield i, here
            for end, piece in self.pieces_at(word, i):
                more = here + logs[piece]
                sums[end] = np.logaddexp(sums[end], more) if end in sums else more
        yield len(word), sums[len(word)]

    def expected(self, words: list[str], counts: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language; counts by word and language."""
        plain = [k for k, word in enumerate(words) if len(word) <= PLAIN]
        out = self._expected_plain([words[k] for k in plain], counts[plain], probabilities)
        if len(plain) < len(words):
            logs = np.log(probabilities)
            for k, word in enumerate(words):
                if len(word) > PLAIN:
                    self._add_expected(word, counts[k], logs, out)
        return out

    def _add_expected(self, word: str, counts: np.ndarray, logs: np.ndarray, out: np.ndarray) -> None:
        before = [here for _, here in self._logs_forward(word, logs)]
        total, after = before[-1], {len(word): np.zeros(logs.shape[1])}
        for i in range(len(word) - 1, -1, -1):
            rest = None
            for end, piece in self.pieces_at(word, i):
                more = logs[piece] + after[end]
                out[piece] += counts * np.exp(before[i] + more - total)
                rest = more if rest is None else np.logaddexp(rest, more)
            after[i] = rest

    def _expected_plain(self, words: list[str], counts: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
        # Only the languages in which a word is counted: one column for each word and language.
        which, language = np.nonzero(counts)
        words, n, of_one = [words[k] for k in which], probabilities.shape[1], probabilities.ravel()
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sums = np.zeros((int(lengths.max(initial=0)) + 1, len(words)))
        sums[0] = 1.0
        groups = []
        for begin, end, word, piece in self.steps(words):
            place = piece * n + language[word]
            weight = of_one[place]
            sums[end][word] += sums[begin][word] * weight
            groups.append((begin, end, word, place, weight))
        rest = np.zeros_like(sums)
        rest[lengths, np.arange(len(words))] = 1.0
        share = counts[which, language] / sums[lengths, np.arange(len(words))]
        places, uses = [np.zeros(0, np.int64)], [np.zeros(0)]
        for begin, end, word, place, weight in reversed(groups):
            flow = weight * rest[end][word]
            rest[begin][word] += flow
            places.append(place)
            uses.append(flow * sums[begin][word] * share[word])
        found = np.bincount(np.concatenate(places), np.concatenate(uses), probabilities.size)
        return found.reshape(probabilities.shape).astype(float)  # counts of nothing are whole numbers


_KINDS: list = []


def _kinds() -> np.ndarray:
    """By character: 1 of letters, 2 of marks, else 0."""
    import regex

    if not _KINDS:
        kinds = np.zeros(NO_CHARACTER, np.uint8)
        for first, last in ((0, 0xD800), (0xE000, NO_CHARACTER)):
            chars = "".join(map(chr, range(first, last)))
            for number, kind in enumerate((r"\p{L}+", r"\p{M}+"), 1):
                for run in regex.finditer(kind, chars):
                    kinds[first + run.start() : first + run.end()] = number
        _KINDS.append(kinds)
    return _KINDS[0]


def _words_of(part: str) -> list[str]:
    """All matches of WORD in the lower-cased part."""
    import regex

    if part.isascii():
        return part.encode().translate(ASCII_WORDS).decode().split()
    part = part.lower()
    chars = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _kinds()[chars]
    if kinds.max() > 1:  # marks belong to a word only after a letter
        return regex.findall(WORD, part)
    return np.where(kinds, chars, np.uint32(32)).astype("<u4").tobytes().decode("utf-32-le").split()


def text_words(text: str):
    """The words of a text, part by part."""
    import regex

    at = 0
    while at < len(text):
        end = at + PART
        if end < len(text):
            gap = regex.compile(r"[^\p{L}\p{M}]").search(text, end)
            end = gap.start() if gap else len(text)
        yield _words_of(text[at:end])
        at = end


class _Numbers(dict):
    """Words numbered as they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Scorer:
    """Scores texts in a task, keeping the scores of words it has met."""

    def __init__(self, model: LanguageModel, trie: dict):
        self.model = model
        self.lattice = Lattice(trie, len(model.probabilities) - 1)
        self.place = _Numbers()
        self.scores = np.zeros((0, len(model.languages)))

    def places(self, words: list[str]) -> np.ndarray:
        """The rows of ``scores`` that hold the words' scores."""
        if len(self.place) > KEPT_WORDS:
            self.place, self.scores = _Numbers(), self.scores[:0]
        known = len(self.place)
        found = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        if len(self.place) > known:
            new = [SPACE + w for w in itertools.islice(reversed(self.place), len(self.place) - known)][::-1]
            parts = [self.lattice.log_probabilities(new[i : i + AT_ONCE], self.model.probabilities) for i in range(0, len(new), AT_ONCE)]
            self.scores = np.concatenate([self.scores, *parts])
        return found

    def rates_together(self, parts):
        """(languages, words, rates): log probabilities per character of the stretches of 1, 2, 4 .. words of
        (language, words) parts, many parts at once, with the language of each."""
        held, n = [], 0
        for part in itertools.chain(parts, [None]):
            if part is not None:
                held.append(part)
                n += len(part[1])
            if held and (part is None or n > 50_000):
                yield from self._rates_of(held)
                held, n = [], 0

    def _rates_of(self, parts: list):
        words = [w for _, part in parts for w in part]
        places = self.places(words)
        languages = np.fromiter((language for language, _ in parts), np.int64, len(parts))
        lengths = np.fromiter((len(part) for _, part in parts), np.int64, len(parts))
        # A zero at the end, for stretches that end with the last word.
        logs = np.append(self.scores[places, np.repeat(languages, lengths)], 0.0)
        sizes = np.cumsum([0, *(len(w) + 1 for w in words)])
        begins, n = np.cumsum(lengths) - lengths, 1
        while n <= min(int(lengths.max()), LONGEST):
            many = lengths // n
            at = np.repeat(begins - n * (np.cumsum(many) - many), many) + n * np.arange(many.sum())
            sums = np.add.reduceat(logs, np.stack([at, at + n], 1).ravel())[::2]
            yield np.repeat(languages, many), n, sums / (sizes[at + n] - sizes[at])
            n *= 2

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float, int, float]]:
        """Language, its probability, number of words, and log probability per character in it."""
        totals = np.zeros((len(texts), len(self.model.languages)))
        n_words, n_chars = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        held, owners, n = [], [], 0

        def settle():
            nonlocal held, owners, n
            words = [w for part in held for w in part]
            places = self.places(words)
            rows = self.scores[places]
            sizes = [len(part) for part in held]
            sums = np.add.reduceat(rows, np.cumsum([0, *sizes[:-1]]), axis=0)
            np.add.at(totals, np.array(owners), sums)
            held, owners, n = [], [], 0

        for k, text in enumerate(texts):
            for words in text_words(text or ""):
                if words:
                    n_words[k] += len(words)
                    n_chars[k] += len(words) + sum(map(len, words))
                    held.append(words)
                    owners.append(k)
                    n += len(words)
                    if n > 50_000:
                        settle()
        if held:
            settle()
        out = []
        for k in range(len(texts)):
            if not n_words[k] or not self.model.languages:
                out.append((UNDETERMINED, 0.0, 0, 0.0))
                continue
            logs = totals[k] + self.model.prior
            best = int(np.argmax(logs))
            out.append((self.model.languages[best], float(1 / np.exp(logs - logs[best]).sum()), int(n_words[k]), float(totals[k, best] / n_chars[k])))
        return out


def learned(labelled: DataFrame, doc_id: str, text: str, lang: str, docs_each: int | None) -> tuple[DataFrame, dict[str, int]]:
    """The texts (lang, words) that are learned from, and the number of texts of each language."""
    rows = labelled.select(F.col(doc_id).alias("id"), F.col(text).alias("words"), F.col(lang).alias("lang"))
    rows = rows.where("words is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes or docs_each is None:
        return rows.select("lang", "words"), sizes
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, docs_each / n))) for k, n in sizes.items()))
    place = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(place < share).select("lang", "words"), sizes


def fit(
    labelled: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    docs_each: int | None = None,
    rounds: int = 2,
    vocabulary: str = VOCABULARY,
) -> LanguageModel:
    """Fit on all texts with a language; with ``docs_each`` on about so many of each, chosen by the hash of their ids.

    The driver holds the languages and their piece probabilities, never texts.
    """
    context = labelled.sparkSession.sparkContext
    pieces, shared = shared_pieces(context, vocabulary)
    sample, sizes = learned(labelled, doc_id, text, lang, docs_each)
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((pieces.size + 1, 0)), np.zeros(0))

    def count_words(batches):
        import pyarrow as pa

        for batch in batches:
            counts: dict[str, Counter] = {}
            for name, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in text_words(words.as_py()):
                    counts.setdefault(name, Counter()).update(part)
            for name, counted in counts.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(counted), pa.string()),
                        pa.array(list(counted), pa.string()),
                        pa.array(list(counted.values()), pa.int64()),
                    ],
                    ["lang", "word", "n"],
                )

    counted = (
        sample.mapInArrow(lean(count_words), "lang string, word string, n bigint")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )
    counted = written(counted, "words")
    probabilities = np.full((pieces.size + 1, len(languages)), 1.0 / pieces.size)
    probabilities[-1] = UNKNOWN_CHARACTER

    def expectations(current):
        number = {name: k for k, name in enumerate(languages)}

        def run(batches):
            import pyarrow as pa

            lattice = Lattice(trie_of(shared.value), shared.value.size)
            for batch in batches:
                names, words, counts = (c.to_pylist() for c in batch.columns)
                for at in range(0, len(words), AT_ONCE):
                    part = slice(at, at + AT_ONCE)
                    use = np.zeros((len(words[part]), len(languages)))
                    use[np.arange(len(use)), [number[x] for x in names[part]]] = counts[part]
                    found = lattice.expected([SPACE + w for w in words[part]], use, current.value)
                    piece, language = np.nonzero(found[:-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(piece), pa.array(language), pa.array(found[piece, language])],
                        ["piece", "language", "expected"],
                    )

        return run

    for _ in range(rounds):
        current = context.broadcast(probabilities)
        sums = (
            counted.mapInArrow(lean(expectations(current)), "piece bigint, language bigint, expected double")
            .groupBy("piece", "language")
            .agg(F.sum("expected").alias("expected"))
        )
        new = np.full_like(probabilities, 0.05)
        # At most the size of the vocabulary times the number of languages.
        for row in sums.collect():
            new[row.piece, row.language] += row.expected
        new[-1] = 0
        probabilities = new / new.sum(axis=0)
        probabilities[-1] = UNKNOWN_CHARACTER
        current.destroy()
    counts = np.array([sizes[x] for x in languages], float)
    return LanguageModel(languages, probabilities, np.log(counts / counts.sum()))


def floors(
    labelled: DataFrame,
    model: LanguageModel,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    docs_each: int | None = None,
    vocabulary: str = VOCABULARY,
) -> dict[str, list[float]]:
    """The log probability per character below which a text is not in the language.

    For stretches of 1, 2, 4 .. words of the learned texts, the quantile ``RARE`` of
    their rates less ``MARGIN``; ``docs_each`` as for :func:`fit`. The driver holds counts of rounded rates.
    """
    sample, _ = learned(labelled, doc_id, text, lang, docs_each)
    number = {name: k for k, name in enumerate(model.languages)}
    context = labelled.sparkSession.sparkContext
    _, shared = shared_pieces(context, vocabulary)
    learned_model = context.broadcast((model.probabilities, model.prior))

    def run(batches):
        import pyarrow as pa

        probabilities, prior = learned_model.value
        scorer = Scorer(LanguageModel(list(number), probabilities, prior), trie_of(shared.value))
        counts: dict = {}
        names = list(number)
        parts = (
            (number[name], words)
            for batch in batches
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1))
            for words in text_words(text.as_py())
            if words
        )
        for languages, n, rates in scorer.rates_together(parts):
            found = np.floor(rates * BINS).astype(np.int64)
            least, width = int(found.min()), int(found.max() - found.min()) + 1
            for both, count in zip(*(x.tolist() for x in np.unique(languages * width + found - least, return_counts=True))):
                key = names[both // width], n, both % width + least
                counts[key] = counts.get(key, 0) + count
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[c] for k in keys], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int64()))), pa.array(counts.values(), pa.int64())],
            ["lang", "n", "rate", "count"],
        )

    found = sample.mapInArrow(lean(run), "lang string, n bigint, rate bigint, count bigint").groupBy("lang", "n", "rate").agg(F.sum("count").alias("count"))
    rates: dict = {}
    for row in found.collect():
        rates.setdefault((row.lang, row.n), []).append((row.rate, row["count"]))
    learned_model.destroy()
    out: dict[str, list[float]] = {}
    for (name, _), counted in sorted(rates.items()):
        rate, count = np.array(sorted(counted)).T
        low = float(rate[np.searchsorted(np.cumsum(count), RARE * count.sum(), side="right")] / BINS - MARGIN)
        # What is too rare for a short text is not less rare for a long one.
        known = out.setdefault(name, [])
        known.append(max([low, *known[-1:]]))
    return out


def is_familiar(language: str, words: int, rate: float, floors: dict[str, list[float]]) -> bool:
    """Whether a text is no less like its language than stretches of about its length are."""
    known = floors.get(language)
    return bool(known) and words > 0 and rate >= known[min(words.bit_length(), len(known)) - 1]


def predict(
    docs: DataFrame,
    model: LanguageModel,
    *,
    text: str = "text",
    lang_pred: str = "lang_pred",
    score: str = "score",
    vocabulary: str = VOCABULARY,
    floors: dict[str, list[float]] | None = None,
    familiar: str = "familiar",
) -> DataFrame:
    """The rows with two more columns: the language, and its probability (0 to 1).

    With ``floors`` (see there) a third tells whether the text is like the language at all.
    """
    context = docs.sparkSession.sparkContext
    _, shared = shared_pieces(context, vocabulary)
    learned_model = context.broadcast((model.languages, model.probabilities, model.prior))
    added = [familiar] if floors is not None else []

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(LanguageModel(*learned_model.value), trie_of(shared.value))
        for batch in batches:
            at = batch.schema.names.index(text)
            found = []
            for start in range(0, batch.num_rows, 256):
                found += scorer.predict_all(batch.column(at).slice(start, 256).to_pylist())
            likeness = [pa.array([is_familiar(x, n, rate, floors) for x, _, n, rate in found], pa.bool_())] if added else []
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([x for x, *_ in found], pa.string()),
                    pa.array([x for _, x, *_ in found], pa.float64()),
                    *likeness,
                ],
                [*batch.schema.names, lang_pred, score, *added],
            )

    return docs.mapInArrow(lean(run), fields(docs, (lang_pred, "string"), (score, "double"), *((c, "boolean") for c in added)))
