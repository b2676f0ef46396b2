"""Hard negatives by exact integer inner products, scored the Four-Russians way.

Vectors of whole numbers are packed by bit planes in two's complement: for each plane
and each group of eight dimensions one byte, the planes' bits of these dimensions. For
every anchor and group, a table holds the sum of the anchor's components over each of the
256 subsets of the group's dimensions. A plane's byte then indexes the table, the
sums over the groups are the plane's part of the inner product, and the planes are added
with a shift each, the highest (the sign) subtracted. The scores are exact.

All anchors meet all rows, in blocks. Blocks of packed rows and blocks of anchors are
dealt to a grid: each cell takes one block of anchors and one slice of the rows, holds the
anchors' best rows so far, and reads the slice a block at a time. So a task holds one block
of anchors and one of rows, a cell gives a bounded number of rows for each anchor, and
what moves is the packed rows once for each ANCHORS_A_BLOCK anchors. A first pass finds each anchor's
positives; a second finds, for each of these, the best negatives with a score in its band.

Defined results: rows with a null id, a null label, a null vector or a component that is null, not
finite or so large that scores could leave 64 bits (beyond 2^62 / SCALE; then an error is raised) take
no part, the first three silently; of vectors of different lengths the shorter is filled with
zeros. "Other" rows are those of another id; rows that repeat an id are rows of their
own, as candidates and as anchors. An anchor without a positive, or a positive without a
row in its band, gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
BAND = (50, 95)  # a negative's score, in hundredths of the positive's
ANCHORS_A_BLOCK = 2048
ROWS_A_BLOCK = 8192
# Slices of the rows: at least so many cells work on a block of anchors, and a slice
# holds about ROWS_A_SLICE rows where there are more.
SLICES = 16
ROWS_A_SLICE = 1_000_000
# Anchors and rows that are scored at a time, so that a table stays in the cache.
ANCHOR_TILE = 256
ROW_TILE = 1024


def pack(vectors: np.ndarray) -> np.ndarray:
    """Bit-plane bytes (planes, rows, groups) of whole numbers (rows, 8 x groups)."""
    extent = int(max(vectors.max(initial=0), -1 - vectors.min(initial=0)))
    planes = extent.bit_length() + 1
    bits = (vectors[None] >> np.arange(planes, dtype=np.int64)[:, None, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray, kind=np.int64) -> np.ndarray:
    """(groups, 256, anchors): sums of each anchor's components over subsets of eight dimensions."""
    groups = anchors.shape[1] // 8
    tables = np.zeros((groups, 256, len(anchors)), kind)
    parts = anchors.T.reshape(groups, 8, 1, len(anchors)).astype(kind)
    for d in range(8):  # a subset with dimension d is one without it and the component
        tables[:, 1 << d : 2 << d] = tables[:, : 1 << d] + parts[:, d]
    return tables


def scores(tables: np.ndarray, planes: np.ndarray, kind=np.int64) -> np.ndarray:
    """Inner products (rows, anchors) of packed rows with the tables' anchors."""
    total = None
    for k in range(len(planes) - 1, -1, -1):
        part = tables[0].take(planes[k, :, 0], axis=0)
        for g in range(1, len(tables)):
            part += tables[g].take(planes[k, :, g], axis=0)
        if total is None:
            total = -part.astype(kind)  # the sign's plane
        else:
            total <<= 1
            total += part
    return total


def _kinds(anchors: np.ndarray, planes: int) -> tuple[type, type]:
    """The narrowest integers that hold a plane's sums and the scores."""
    most = int(np.abs(anchors).max(initial=0)) * anchors.shape[1]
    if most << planes > 2**62:
        raise ValueError("inner products of these vectors leave 64 bits")
    return (
        np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64,
        np.int32 if most << planes < 2**31 else np.int64,
    )


class Best:
    """The first ``k`` rows of each list, by score (high first) and id, with scores from
    ``least`` (which rises as a list fills) to ``most``."""

    def __init__(self, k: int, least: np.ndarray, most: np.ndarray):
        self.k, self.least, self.most = k, least, most
        self.lists, self.scores, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.new: list[tuple] = []

    def add(self, lists: np.ndarray, found: np.ndarray, ids: np.ndarray) -> None:
        if len(lists):
            self.new.append((lists, found.astype(np.int64), ids))

    def settle(self) -> None:
        if not self.new:
            return
        lists, found, ids = (np.concatenate(x) for x in zip((self.lists, self.scores, self.ids), *self.new))
        self.new = []
        order = np.lexsort((ids, -found, lists))
        lists, found, ids = lists[order], found[order], ids[order]
        first = np.flatnonzero(np.diff(lists, prepend=-1))
        rank = np.arange(len(lists)) - np.repeat(first, np.diff(first, append=len(lists)))
        kept = rank < self.k
        self.lists, self.scores, self.ids = lists[kept], found[kept], ids[kept]
        full = rank == self.k - 1
        self.least[lists[full]] = found[full]


_BLOCK = "n int, width int, ids binary, labels binary, data binary"


def _block(rows: list, packed: bool):
    """One row of a block from Arrow batches of (id, label, vector)."""
    import pyarrow as pa

    ids, labels = (np.concatenate([np.asarray(x.column(i).to_numpy(zero_copy_only=False), np.int64) for x in rows]) for i in (0, 1))
    lengths = [np.diff(np.asarray(x.column(2).offsets)) for x in rows]
    width = max(8, -(-max(int(n.max(initial=0)) for n in lengths) // 8) * 8)
    whole = np.zeros((len(ids), width), np.int64)
    whole[np.arange(width) < np.concatenate(lengths)[:, None]] = np.concatenate(
        [x.column(2).flatten().to_numpy(zero_copy_only=False) for x in rows]
    )
    data = pack(whole) if packed else whole
    return [
        pa.array([len(ids)], pa.int32()),
        pa.array([width], pa.int32()),
        *(pa.array([x.tobytes()], pa.binary()) for x in (ids, labels, data)),
    ]


_FIELDS = ["n", "width", "ids", "labels", "data"]


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows of (id, label, vector) in blocks of at most ``size``, as bit planes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                yield pa.RecordBatch.from_arrays(_block([batch.slice(at, size)], True), _FIELDS)

    return rows.mapInArrow(run, _BLOCK)


def _heads(rows: DataFrame, blocks: int) -> DataFrame:
    """The anchors dealt evenly to so many blocks, as numbers."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        own = [batch for batch in batches if batch.num_rows]
        if own:
            number = pa.array([TaskContext.get().partitionId()], pa.int64())
            yield pa.RecordBatch.from_arrays([number, *_block(own, False)], ["block", *_FIELDS])

    return rows.repartition(blocks).mapInArrow(run, "block long, " + _BLOCK)


_FOUND = "block long, place long, rank int, id long, score long"


def _grid(anchors: DataFrame, rows: DataFrame, blocks: int, slices: int) -> DataFrame:
    """Each block of anchors ahead of the packed rows of each slice, cell by cell."""
    packed = rows.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.pmod(F.xxhash64("ids"), F.lit(slices)).alias("slice"),
        F.lit(1).alias("kind"),
        "n", "width", "ids", "labels", "data",
        F.lit(None).cast("binary").alias("positives"),
    )
    heads = anchors.select(
        "block",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"),
        F.lit(0).alias("kind"),
        "n", "width", "ids", "labels", "data", "positives",
    )
    return heads.unionByName(packed).repartition("block", "slice").sortWithinPartitions("block", "slice", "kind")


_LEAST = np.iinfo(np.int64).min  # also the place of a positive that an anchor lacks


def _array(value, kind, *shape):
    return np.frombuffer(value, kind).reshape(*shape)


class _Tile:
    """Some anchors, their tables, and the best rows so far for each of their lists."""

    def __init__(self, ids, labels, anchors, best: Best):
        self.ids, self.labels, self.anchors, self.best = ids, labels, anchors, best
        self.key, self.tables = None, None

    def subset_sums(self, width: int, kind) -> np.ndarray:
        if self.key != (width, kind):
            own = self.anchors[:, :width]
            own = np.pad(own, ((0, 0), (0, width - own.shape[1])))
            self.key, self.tables = (width, kind), subset_sums(own, kind)
        return self.tables


class _Cell:
    """A block of anchors, in tiles, that sees the rows of a slice block by block."""

    def __init__(self, head: dict, k: int, per_anchor: int, band: tuple[int, int] | None):
        self.key, self.per_anchor, self.band = (head["block"], head["slice"]), per_anchor, band
        n, width = head["n"], head["width"]
        ids, labels = _array(head["ids"], np.int64, n), _array(head["labels"], np.int64, n)
        self.anchors = _array(head["data"], np.int64, n, width)
        least, most = np.full(n * per_anchor, _LEAST), np.full(n * per_anchor, np.iinfo(np.int64).max)
        if band:
            positive = _array(head["positives"], np.int64, n * per_anchor)
            some = positive != _LEAST
            most[~some] = _LEAST
            least[~some] = 0
            least[some], most[some] = -(-positive[some] * band[0] // 100), positive[some] * band[1] // 100
        self.tiles = []
        for a in range(0, n, ANCHOR_TILE):
            own, lists = slice(a, a + ANCHOR_TILE), slice(a * per_anchor, (a + ANCHOR_TILE) * per_anchor)
            self.tiles.append(_Tile(ids[own], labels[own], self.anchors[own], Best(k, least[lists], most[lists])))

    def add(self, block: dict) -> None:
        n, width = block["n"], block["width"]
        ids, labels = _array(block["ids"], np.int64, n), _array(block["labels"], np.int64, n)
        planes = _array(block["data"], np.uint8, -1, n, width // 8)
        sums, kind = _kinds(self.anchors, len(planes))
        for tile in self.tiles:
            tables = tile.subset_sums(width, sums)
            for r in range(0, n, ROW_TILE):
                rows = slice(r, r + ROW_TILE)
                found = scores(tables, planes[:, rows], kind)
                alike = labels[rows, None] == tile.labels
                fits = ~alike if self.band else alike & (ids[rows, None] != tile.ids)
                for j in range(self.per_anchor):
                    lists = slice(j, None, self.per_anchor)
                    x, y = np.nonzero(fits & (found >= tile.best.least[lists]) & (found <= tile.best.most[lists]))
                    tile.best.add(y * self.per_anchor + j, found[x, y], ids[rows][x])
                tile.best.settle()

    def rows(self) -> Iterator:
        import pyarrow as pa

        for t, tile in enumerate(self.tiles):
            lists, found, ids = tile.best.lists, tile.best.scores, tile.best.ids
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(lists), self.key[0]), pa.int64()),
                    pa.array(lists // self.per_anchor + t * ANCHOR_TILE, pa.int64()),
                    pa.array(lists % self.per_anchor, pa.int32()),
                    pa.array(ids, pa.int64()),
                    pa.array(found, pa.int64()),
                ],
                ["block", "place", "rank", "id", "score"],
            )


def _search(grid: DataFrame, k: int, per_anchor: int = 1, band: tuple[int, int] | None = None) -> DataFrame:
    def run(batches) -> Iterator:
        cell = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}
                if row["kind"] == 0:
                    if cell:
                        yield from cell.rows()
                    cell = _Cell(row, k, per_anchor, band)
                elif cell and cell.key == (row["block"], row["slice"]):  # else a block without an anchor
                    cell.add(row)
        if cell:
            yield from cell.rows()

    return grid.mapInArrow(run, _FOUND)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)


def mine(
    rows: DataFrame,
    anchors,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    band: tuple[int, int] = BAND,
    anchors_a_block: int = ANCHORS_A_BLOCK,
    rows_a_slice: int = ROWS_A_SLICE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on the rows that picks the anchors. A score is the inner
    product of vectors whose components x are floor(scale * x). An anchor's positives
    are its best other rows of its label; its negatives for one of these are the best rows of
    other labels whose score is within ``band`` hundredths of the positive's.
    """
    whole = F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("long"))
    fit = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    part = rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(fit)
    named = part.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("vector"), anchors.alias("anchor"))
    counts = named.agg(F.count("*").alias("rows"), F.count_if("anchor").alias("anchors")).first()
    blocks = max(1, -(-counts.anchors // anchors_a_block))
    slices = max(SLICES, -(-counts.rows // rows_a_slice))
    packed = written(_packed(named.select("id", "label", "vector"), ROWS_A_BLOCK), "packed-rows")
    heads = written(_heads(named.where("anchor").select("id", "label", "vector"), blocks), "anchors")
    empty = F.lit(None).cast("binary").alias("positives")
    near = _first(_search(_grid(heads.select("*", empty), packed, blocks, slices), positives), ["block", "place"], positives)
    near = written(near.select("block", "place", (F.col("at") - 1).cast("int").alias("rank"), "id", "score"), "positives")
    listed = near.groupBy("block").agg(F.collect_list(F.struct("place", "rank", "score")).alias("found"))
    with_positives = _with_positives(heads.join(listed, "block", "left"), positives)
    hard = _search(_grid(with_positives, packed, blocks, slices), negatives, positives, band)
    hard = _first(hard, ["block", "place", "rank"], negatives)
    names = _anchor_ids(heads)
    return (
        hard.select("block", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("at").alias("to_rank"))
        .join(near.select("block", "place", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["block", "place", "rank"])
        .join(names, ["block", "place"])
        .select(
            "anchor_id",
            "positive_id",
            F.col("to_rank").cast("int").alias("rank"),
            "negative_id",
            "positive_score",
            "negative_score",
        )
    )


def _with_positives(heads: DataFrame, k: int) -> DataFrame:
    """The blocks of anchors with their positives' scores, in the order of the lists."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names = batch.schema.names
            lists = []
            for n, found in zip(batch.column(names.index("n")).to_pylist(), batch.column(names.index("found")).to_pylist()):
                own = np.full((n, k), _LEAST, np.int64)
                for x in found or ():
                    own[x["place"], x["rank"]] = x["score"]
                lists.append(own.tobytes())
            columns = [c for name, c in zip(names, batch.columns) if name != "found"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lists, pa.binary())], [*(x for x in names if x != "found"), "positives"])

    block = heads.select("block", "n", "width", "ids", "labels", "data", "found")
    return block.mapInArrow(run, "block long, " + _BLOCK + ", positives binary")


def _anchor_ids(heads: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), block)), pa.array(np.arange(len(own))), pa.array(own)], ["block", "place", "anchor_id"]
                )

    return heads.select("block", "ids").mapInArrow(run, "block long, place long, anchor_id long")
