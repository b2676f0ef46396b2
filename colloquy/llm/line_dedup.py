"""Line dedup by a segment-partition edit join.

Two lines are near if ``edits`` edits or fewer (insert, delete or replace a
character) turn one into the other. A line is cut into edits + 1 segments, and
by the pigeonhole principle a near line holds one of them unchanged. Segments
are indexed by number, text and length of their line; a line probes the lengths
up to its own at the few places where the segment can lie (those that leave the
edits on both sides possible). Candidates are verified with a banded bit-parallel
edit distance, many pairs at once.

A line is dropped if an earlier line equals it, or if it is near to the first
occurrence of another line that comes earlier (by document id, text hash and line
number). Lines of white space alone stay, and are never compared. Lines shorter
than ``min_chars`` are compared for equality only: in them two edits are no small
difference.

Defined results: a null text stays null, with no lines; rows with one id and one
text are the same document and keep the same lines; of several texts with one id,
the one with the smaller hash comes first; null ids come first of all; an empty
table gives an empty result; other columns, whatever their names, are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bounded_broadcast, fields, lean, unused, written
from .words import mix

MIN_CHARS = 30
EDITS = 2
# Lanes of the edit distance computed together.
LANES = 4096
SHAPE_GROUPS = 16
# Lines whose segments are hashed together, some dozens of bytes for each character.
LINES = 500
# Segment keys shared by several lines are broadcast up to so many (8 bytes each).
SHARED_KEYS = 1_000_000


def segment(length: np.ndarray, number: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (from 0) and size of a segment: equal shares, the last ones longer by one."""
    share, longer = length // (edits + 1), length % (edits + 1)
    plain = edits + 1 - longer  # so many segments have no more than the share
    return share * number + np.maximum(0, number - plain), share + (number >= plain)


def probe_offsets(number: int, shorter: int, edits: int) -> range:
    """Shifts of the places where the segment can lie in a line longer by ``shorter``."""
    left, right = number, edits - number
    return range(max(-left, shorter - right), min(left, shorter + right) + 1)


class Substrings:
    """Hashes of any substrings of a batch of strings, from one prefix sum of powers."""

    base = 0x9E3779B97F4A7C15
    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, strings):
        """``strings`` is an Arrow column without nulls."""
        import pyarrow as pa

        column = strings.cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if len(column) else b""
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        # Characters before each byte, and so before each string.
        begins = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        places = begins[offsets - offsets[0]]
        self.start, self.length = places[:-1], np.diff(places)
        self._grow(len(points) + 1)
        self.sums = np.zeros(len(points) + 1, np.uint64)
        self.mixed = mix(points.astype(np.uint64) + np.uint64(1))
        np.cumsum(self.mixed * self.powers[: len(points)], out=self.sums[1:])

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls.powers) < n:
            inverse = pow(cls.base, -1, 1 << 64)
            for name, factor in (("powers", cls.base), ("inverses", inverse)):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))

    def shapes(self) -> np.ndarray:
        """For each string 16 counts modulo 16, of the characters in 16 groups, as one number."""
        places = np.repeat(np.arange(len(self.length)), self.length) * SHAPE_GROUPS
        groups = (self.mixed >> np.uint64(60)).astype(np.int64)
        counts = np.bincount(places + groups, minlength=len(self.length) * SHAPE_GROUPS) & 15
        shifts = np.arange(0, 64, 4, dtype=np.uint64)
        return (counts.reshape(-1, SHAPE_GROUPS).astype(np.uint64) << shifts).sum(axis=1, dtype=np.uint64).view(np.int64)

    def hashes(self, which: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        first = self.start[which] + begin
        return (self.sums[first + size] - self.sums[first]) * self.inverses[first]


def shapes_fit(a: str, b: str, edits: int) -> Column:
    """Whether two shapes may be of near lines: an edit moves two counts by one at most."""
    parts = []
    for k in range(SHAPE_GROUPS):
        x, y = (f"(shiftrightunsigned({c}, {4 * k}) & 15L)" for c in (a, b))
        parts.append(f"least(({x} - {y}) & 15L, ({y} - {x}) & 15L)")
    return F.expr(f"{' + '.join(parts)} <= {2 * edits}")


def keys_of(of: Substrings, edits: int):
    """(line numbers, keys, indexed) of all segments and probes of a batch of lines.

    The key hashes segment number, text and length of the indexed line. A probe at
    a segment's own place is the indexed row itself.
    """
    for shorter in range(edits + 1):
        indexed = of.length - shorter
        for number in range(edits + 1):
            start, size = segment(indexed, number, edits)
            for shift in probe_offsets(number, shorter, edits):
                begin = start + shift
                fits = np.flatnonzero((begin >= 0) & (begin + size <= of.length) & (size > 0))
                text = of.hashes(fits, begin[fits], size[fits])
                label = (indexed[fits] * (edits + 1) + number).astype(np.uint64)
                yield fits, mix(text + mix(label + np.uint64(1))).view(np.int64), shorter == 0 and shift == 0


def _keyed(lines: DataFrame, edits: int, min_chars: int, *, shaped: bool = False) -> DataFrame:
    """(hash, key, indexed) of lines of at least ``min_chars`` characters, and with ``shaped`` their shape."""
    names = ["hash", "key", "indexed"] + ["shape"] * shaped

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, LINES):
                part = batch.slice(start, LINES)
                hashes, of = part.column(0), Substrings(part.column(1))
                shapes = of.shapes() if shaped else None
                for at, keys, indexed in keys_of(of, edits):
                    more = [pa.array(shapes[at])] if shaped else []
                    columns = [hashes.take(pa.array(at)), pa.array(keys), pa.array(np.full(len(at), indexed)), *more]
                    yield pa.RecordBatch.from_arrays(columns, names)

    long = lines.where(F.length("line") >= min_chars).select("hash", "line")
    return long.mapInArrow(lean(run), "hash bigint, key bigint, indexed boolean" + ", shape bigint" * shaped)


def near(left: list[str], right: list[str], edits: int) -> np.ndarray:
    """Whether each pair of strings is within the edits: banded bit-vectors, a lane a pair.

    Bit i of the vectors is the row j - edits + i of column j; they hold where a
    column rises and falls from row to row. The distance is followed along the
    lowest diagonal of the band and then up its last column. What a pair has in
    common at both ends is cut off first.
    """
    pairs = [_differing(a, b) for a, b in zip(left, right)]
    out = np.zeros(len(left), bool)
    order = sorted(range(len(pairs)), key=lambda k: max(map(len, pairs[k])))
    for at in range(0, len(order), LANES):
        lanes = order[at : at + LANES]
        out[lanes] = _near_lanes([pairs[k] for k in lanes], edits)
    return out


def _differing(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """The two strings' characters without their common beginning and end."""
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    n = min(len(x), len(y))
    unequal = np.flatnonzero(x[:n] != y[:n])
    head = int(unequal[0]) if len(unequal) else n
    x, y, n = x[head:], y[head:], n - head
    unequal = np.flatnonzero(x[len(x) - n :] != y[len(y) - n :])
    tail = n - 1 - int(unequal[-1]) if len(unequal) else n
    return x[: len(x) - tail], y[: len(y) - tail]


def _near_lanes(pairs: list[tuple[np.ndarray, np.ndarray]], edits: int) -> np.ndarray:
    n = np.array([len(a) for a, _ in pairs])
    m = np.array([len(b) for _, b in pairs])
    band = 2 * edits + 1
    out = (m == 0) & (n <= edits)
    # Lanes still open: none that has ended or is too far off.
    open_ = np.flatnonzero((m > 0) & (np.abs(n - m) <= edits))
    top = int(m[open_].max(initial=0))
    # Column j (from 1) of the right string meets rows j - edits .. j + edits of the left one.
    rows = np.zeros((len(open_), top + 2 * band), np.uint32)
    columns = np.zeros((len(open_), top + 1), np.uint32)
    for k, lane in enumerate(open_):
        a, b = pairs[lane]
        rows[k, edits : edits + len(a)] = a + np.uint32(1)
        columns[k, : len(b)] = b + np.uint32(1)
    one, full, top_bit = np.uint64(1), np.uint64((1 << band) - 1), np.uint64(1 << (band - 1))
    # Rises (up) and falls (down) of the column before, from row j - edits + i - 1 to row j - edits + i.
    # Column 0 rises in every row from 1 on; rows above the string never match and stay level.
    up = np.full(len(open_), np.uint64(sum(1 << i for i in range(band) if i >= edits)))
    down = np.zeros(len(open_), np.uint64)
    value = np.full(len(open_), edits, np.int64)  # at the band's lowest row
    for j in range(1, top + 1):
        match = np.zeros(len(open_), np.uint64)
        for i in range(band):
            match |= (rows[:, j - 1 + i] == columns[:, j - 1]).astype(np.uint64) << np.uint64(i)
        # Where a diagonal step costs nothing.
        zero = ((((match & up) + up) ^ up) | match | down) & full
        right_up, right_down = (down | ~(zero | up)) & full, zero & up
        value += np.where(zero & top_bit, 0, 1)
        # The band moves down by a row; the one that comes in is a rise.
        up = (right_down | ~((zero >> one) | right_up) | top_bit) & full
        down = (zero >> one) & right_up & ~top_bit
        done = np.flatnonzero(m[open_] == j)
        if len(done):
            total, above = value[done], j + edits - n[open_[done]]  # rows to walk up to the last one
            for s in range(2 * edits):
                bit = np.uint64(1 << (2 * edits - 1 - s))
                total = total - np.where((above > s) & ((up[done] & bit) != 0), 1, 0)
                total = total + np.where((above > s) & ((down[done] & bit) != 0), 1, 0)
            out[open_[done]] = (above >= 0) & (above <= 2 * edits) & (total <= edits)
        if len(done) or j % 16 == 0:
            # No cell of a band is below its lowest row's value by more than its width.
            stay = (m[open_] > j) & (value <= 3 * edits)
            if not stay.all():
                open_, rows, columns = open_[stay], rows[stay], columns[stay]
                up, down, value = up[stay], down[stay], value[stay]
                if not len(open_):
                    break
    return out


def _lines(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    """A row for every line with a visible character: the columns, number, line."""
    return (
        docs.where(F.col(text).isNotNull())
        .select(*columns, F.posexplode(F.split(F.col(text), "\n", -1)).alias("number", "line"))
        .where("line rlike '\\\\S'")
    )


def near_pairs(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(a, b): hashes of lines that share a segment where near lines may.

    Keys of one line only, by far the most, are found by an aggregate of fixed
    size, which also makes copies of a line one before the shuffle. Only the rows
    of the remaining keys are joined, and pairs whose shapes differ by more than the edits
    can explain are no candidates.
    """
    keyed = _keyed(lines, edits, min_chars)
    shared = keyed.groupBy("key").agg(F.min("hash").alias("least"), F.max("hash").alias("most"))
    shared = written(shared.where("least <> most").select("key"), "shared-segments")
    rows = _keyed(lines, edits, min_chars, shaped=True)
    rows = rows.join(bounded_broadcast(shared, limit=SHARED_KEYS), "key", "left_semi")
    rows = rows.groupBy("key", "hash").agg(F.max("indexed").alias("indexed"), F.max("shape").alias("shape"))
    rows = written(rows, "segments")
    index = rows.where("indexed").select("key", F.col("hash").alias("a"), F.col("shape").alias("sa"))
    probes = rows.select("key", F.col("hash").alias("b"), F.col("shape").alias("sb"))
    pairs = index.join(probes, "key").where("a <> b").where(shapes_fit("sa", "sb", edits))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_lines(docs: DataFrame, first: DataFrame, place: list[str], lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """The places of first occurrences that are near to an earlier one.

    ``first`` has (hash, place...) of the first occurrence of every line and
    ``docs`` the rows (id, version, text) to fetch the candidates' lines from.
    """
    pairs = written(near_pairs(lines, edits, min_chars), "line-pairs")
    ends = pairs.select(F.col("a").alias("hash")).unionByName(pairs.select(F.col("b").alias("hash"))).distinct()
    wanted = written(first.join(ends, "hash", "left_semi"), "wanted-lines")
    # Rows are picked by a hash of id and version before they are cut into lines.
    of = wanted.select("document").distinct()
    some = docs.join(bounded_broadcast(of), "document", "left_semi")
    texts = _lines(some, "text", F.col("id"), F.col("version"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"w.{c}")) for c in place]
    texts = texts.alias("t").join(wanted.alias("w"), same[0] & same[1] & same[2])
    texts = texts.select("w.hash", F.struct(*(f"w.{c}" for c in place)).alias("place"), "line")
    # Rows that repeat bring a line along twice.
    texts = written(texts.dropDuplicates(["hash", "place"]), "line-texts")
    a = texts.select(F.col("hash").alias("a"), F.col("place").alias("p"), F.col("line").alias("left"))
    b = texts.select(F.col("hash").alias("b"), F.col("place").alias("q"), F.col("line").alias("right"))
    both = pairs.join(a, "a").join(b, "b").select(F.greatest("p", "q").alias("later"), "left", "right")

    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, LANES):
                part = batch.slice(at, LANES)
                left, right = part.column(1).to_pylist(), part.column(2).to_pylist()
                yield part.select([0]).filter(pa.array(near(left, right, edits), pa.bool_()))

    return both.mapInArrow(lean(verify), both.select("later").schema).select("later.*").distinct()


def dedup_lines(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    edits: int = EDITS,
    min_chars: int = MIN_CHARS,
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """The documents with repeated lines taken out of the text.

    ``counts`` names two more columns: the lines (with a visible character) of a
    text, and those dropped.
    """
    slim = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    slim = slim.withColumn("document", F.xxhash64("id", "version"))
    lines = _lines(slim, "text", F.col("id"), F.col("version"))
    place = ["id", "version", "number"]
    # Equality is that of two independent 64-bit hashes.
    hashes = [F.xxhash64("line").alias("hash"), F.xxhash64(F.lit(7), "line").alias("other")]
    first = lines.select(*hashes, F.struct(*place).alias("place")).groupBy("hash", "other").agg(F.min("place").alias("place"))
    first = first.select("hash", "place.*").withColumn("document", F.xxhash64("id", "version"))
    first = written(first, "first-lines")
    near_ = near_lines(slim, first, place, lines.select(hashes[0], "line"), edits, min_chars)
    near_ = written(near_.select(*(F.col(c).alias(f"_{c}") for c in place)), "near-lines")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place]
    stay = first.join(near_, same[0] & same[1] & same[2], "left_anti")
    stay = stay.groupBy("id", "version").agg(F.collect_list("number").alias("numbers"))
    stay = stay.select(F.col("id").alias("_id"), F.col("version").alias("_version"), F.col("numbers").alias("_numbers"))
    names = list(docs.columns)
    kept_lines = unused(names, "_numbers")
    packed = docs.select(F.struct(*names).alias("_row"), F.col(doc_id).alias("_key"), F.xxhash64(text).alias("_hash"))
    joined = packed.join(
        stay, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_version")), "left"
    ).select("_row.*", F.col("_numbers").alias(kept_lines))
    at, added = names.index(text), list(counts or ())

    def rebuild(batches):
        import pyarrow as pa

        for batch in batches:
            texts, totals, dropped = [], [], []
            for value, numbers in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                body = value.as_py()
                if body is None:
                    texts.append(None), totals.append(0), dropped.append(0)
                    continue
                keep, out, n, gone = set(numbers.as_py() or ()), [], 0, 0
                for k, line in enumerate(body.split("\n")):
                    visible = bool(line.strip(" \t\n\x0b\f\r"))
                    n += visible
                    if visible and k not in keep:
                        gone += 1
                    else:
                        out.append(line)
                texts.append("\n".join(out)), totals.append(n), dropped.append(gone)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            more = [pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())] if added else []
            yield pa.RecordBatch.from_arrays([*columns, *more], [*batch.schema.names[:-1], *added])

    return joined.mapInArrow(lean(rebuild), fields(docs, *((c, "bigint") for c in added)))
