"""Near duplicates by an LSH forest over MinHash signatures, confirmed exactly.

A document is the set of its distinct runs of ``words`` consecutive words; with
fewer words the whole sequence is its only member. Documents of equal sets are
one class; the forest works on classes. Each of ``trees`` trees has its own
sequence of ``depth`` MinHashes, and Spark sorts all classes by it. In a sorted
order the classes with the longest common prefix stand next to each other, so a
class is compared with its ``reach`` neighbours on both sides if they share
``floor`` hashes or more: in sparse regions these share little, in dense ones
the neighbours share long prefixes, which is the adaptive depth. Classes with more
like them than the neighbours looked at are searched once more, exactly. Every
candidate is confirmed on the full sets (as 64-bit hashes).

Words are lower-cased (A-Z) runs of anything but ASCII white space.

Chance of losing a link of similarity s between two classes without closer
neighbours: (1 - s**floor) ** trees, 3e-8 at 0.8 by default.

Defined results: documents with null or wordless text have an empty set and are
linked with nothing; rows of equal texts are one class, whatever their ids; rows
with a null id take part, have a null component if no id is in it, and are kept
only there; rows that repeat id and text are the same document and are all kept
or all not; of several texts with one id one is kept at most; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .components import components
from .store import bounded_broadcast, lean, written
from .words import LOWER_SPLIT_AT_SPACE, hashed_texts, keys, mix, text_bytes, windows

_SEED = 17
# Classes of a crowd that are compared with as many others in one row.
BLOCK = 256


def shingle_set(hashes: np.ndarray, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(windows(hashes, min(words, len(hashes))) if len(hashes) else hashes)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The MinHash of each factor: the least (x ^ q) * p mod 2**32 over the shingles."""
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    p, q = factors[:, :1], factors[:, 1:]
    for at in range(0, len(low), 1024):
        np.minimum(least, (np.bitwise_xor(low[at : at + 1024], q) * p).min(axis=1), out=least)
    return least


def _factors(n: int, seed: int) -> np.ndarray:
    return keys(n, seed).view(np.uint32).reshape(-1, 2) | np.uint32(1)


def document_classes(docs: DataFrame, doc_id: str, text: str, words: int, trees: int, depth: int) -> DataFrame:
    """(id, version, cls, n, signature, bits) of every row; cls is a digest of the set, null if it is empty."""
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("version", T.LongType()),
            T.StructField("cls", T.BinaryType()),
            T.StructField("n", T.LongType()),
            T.StructField("signature", T.BinaryType()),
            T.StructField("bits", T.LongType()),
        ]
    )
    n = trees * depth
    factors = _factors(n + 64, _SEED)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for hashes, *_ in hashed_texts(text_bytes(batch.column(2)), LOWER_SPLIT_AT_SPACE):
                shingles = shingle_set(hashes, words)
                if not len(shingles):
                    out.append((None, 0, None, None))
                    continue
                least = signature(shingles, factors)
                bits = np.packbits((least[n:] & 1).astype(np.uint8)).view(np.int64)[0]
                # Big-endian, so that Spark's order of binaries is the order of the hashes.
                out.append(
                    (hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), len(shingles), least[:n].astype(">u4").tobytes(), int(bits))
                )
            columns = list(zip(*out)) if out else [[], [], [], []]
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(c, k) for c, k in zip(columns, kinds))], schema.names
            )

    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("version"), F.col(text).alias("words"))
    return rows.mapInArrow(lean(run), schema)


def _neighbours(depth: int, floor: int, reach: int, percent: int, least_bits: int):
    """Finds candidate pairs among sorted (tree, prefix, cls, n, bits) rows."""

    def pairs(tree, prefix, cls, n, bits):
        """Row numbers (earlier, later) of the candidates, and whether they are ``reach`` apart."""
        for step in range(1, reach + 1):
            if len(tree) <= step:
                return
            a, b = slice(None, -step), slice(step, None)
            same = np.logical_and.accumulate(prefix[a] == prefix[b], axis=1).sum(axis=1)
            small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
            alike = 64 - np.bitwise_count((bits[a] ^ bits[b]).view(np.uint64))
            ok = (tree[a] == tree[b]) & (same >= floor) & (100 * small >= percent * large) & (alike >= least_bits)
            at = np.flatnonzero(ok & (cls[a] != cls[b]))
            if len(at):
                yield at, at + step, step == reach

    return pairs


def fixed(column, width: int) -> bytes:
    """The bytes of an Arrow column of binaries that all have this width."""
    start = column.offset * width
    return column.buffers()[2].to_pybytes()[start : start + len(column) * width] if len(column) else b""


_EDGE = "a binary, b binary, far boolean, border boolean, tree int, prefix binary, n bigint, bits bigint, part int, place int"


def candidates(classes: DataFrame, trees: int, depth: int, floor: int, reach: int, percent: int) -> DataFrame:
    """Distinct (a, b, votes, far), a < b: pairs of classes that are neighbours in so many trees.

    ``far`` says that they are ``reach`` places apart in one, so that more classes
    like them may stand beyond.
    """
    width = 4 * depth
    orders = classes.select(
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.lit(trees - 1)),
                lambda t: F.substring(F.col("signature"), t * width + F.lit(1), F.lit(width)),
            )
        ).alias("tree", "prefix"),
        "cls",
        "n",
        "bits",
    )
    # Sorted by all three, so a region of any size is dealt over many tasks.
    ordered = orders.repartitionByRange("tree", "prefix", "cls").sortWithinPartitions("tree", "prefix", "cls")
    # Two sets of similarity 0.8 agree in a bit with chance 0.9; 6 standard deviations below.
    s = percent / 100
    agree = (1 + s) / 2
    least_bits = max(0, int(64 * agree - 6 * (64 * agree * (1 - agree)) ** 0.5))
    pairs = _neighbours(depth, floor, reach, percent, least_bits)

    def columns(batch):
        tree, prefix, cls, n, bits = batch.columns
        return (
            tree.to_numpy(),
            np.frombuffer(fixed(prefix, width), ">u4").reshape(-1, depth),
            np.frombuffer(fixed(cls, 16), "S16"),
            n.to_numpy(),
            bits.to_numpy(),
        )

    def found(batch):
        """(earlier class, later class, whether as far apart as reach) of the candidates among sorted rows."""
        import pyarrow as pa

        a, b, d = [], [], []
        cls = batch.column(2)
        for left, right, far in pairs(*columns(batch)):
            a.append(cls.take(pa.array(left)))
            b.append(cls.take(pa.array(right)))
            d.append(pa.array(np.full(len(left), far)))
        return pa.chunked_array(a, pa.binary()), pa.chunked_array(b, pa.binary()), pa.chunked_array(d, pa.bool_())

    schema = to_arrow_schema(T._parse_datatype_string(_EDGE))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, head, tail, seen = TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            new = pa.table(batch)
            head = new if head is None else head
            if len(head) < reach:
                head = pa.concat_tables([head, new])
            head = head.slice(0, reach)
            seen += len(new)
            rows = new if tail is None else pa.concat_tables([tail, new])
            rows = rows.combine_chunks()
            tail = rows.slice(max(0, len(rows) - reach))
            whole = rows.to_batches()[0] if len(rows) else None
            if whole is None:
                continue
            a, b, d = found(whole)
            if len(a):
                none = [pa.nulls(len(a), f.type) for f in list(schema)[4:]]
                edges = pa.table([a, b, d, pa.array(np.zeros(len(a), bool)), *none], schema=schema)
                yield from edges.to_batches()
        if not seen:
            return
        ends = [(i, r) for i, r in enumerate(head.to_pylist())]
        ends += [(i, r) for i, r in enumerate(tail.to_pylist(), seen - len(tail)) if i >= len(head)]
        yield pa.RecordBatch.from_pylist(
            [r | {"a": r["cls"], "border": True, "part": part, "place": i} for i, r in ends], schema
        )

    made = written(ordered.mapInArrow(lean(run), _EDGE), "forest")

    def stitch(batches):
        """Compares the rows at the ends of neighbouring partitions, 2 * reach of each."""
        import pyarrow as pa

        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        rows = pa.Table.from_batches(kept).sort_by([("part", "ascending"), ("place", "ascending")])
        rows = rows.select(["tree", "prefix", "a", "n", "bits"]).combine_chunks().to_batches()[0]
        yield from pa.table(list(found(rows)), names=["a", "b", "far"]).to_batches()

    # At most 2 * reach narrow rows a partition: one task takes them all.
    borders = made.where("border").select("a", "tree", "prefix", "n", "bits", "part", "place").coalesce(1)
    stitched = borders.mapInArrow(stitch, "a binary, b binary, far boolean")
    edges = made.where("not border").select("a", "b", "far").unionByName(stitched)
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "far")
    return edges.groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes"), F.max("far").alias("far"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with whether 100 * intersection >= percent * union, on full sets."""
    a = sets.select(F.col("cls").alias("a"), F.col("members").alias("left"))
    b = sets.select(F.col("cls").alias("b"), F.col("members").alias("right"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            verdicts = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_py(), np.uint64), np.frombuffer(right.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                verdicts.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(verdicts, pa.bool_())], ["a", "b", "linked"])

    both = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "left", "right")
    return both.mapInArrow(lean(run), "a binary, b binary, linked boolean")


def links(docs, classes, doc_id, text, words, trees, depth, floor, reach, percent) -> DataFrame:
    """(a, b): confirmed links between classes, enough to give all components
    that the candidates give.

    Confirming ships whole sets, so it goes in rounds: the pair with most votes of
    each class first, then all those that still join two different components, then
    what an exact search finds for crowded classes.
    """
    pairs = written(candidates(classes, trees, depth, floor, reach, percent), "candidates")
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = written(classes.join(ends, "cls", "left_semi").select("cls", "id", F.xxhash64("id").alias("key")), "wanted")
    kept = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("words"), F.xxhash64(doc_id).alias("key"))
    kept = kept.join(bounded_broadcast(wanted.select("key").distinct()), "key", "left_semi")

    def set_rows(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for hashes, *_ in hashed_texts(text_bytes(batch.column(0)), LOWER_SPLIT_AT_SPACE):
                members = shingle_set(hashes, words).tobytes()
                out.append((hashlib.blake2b(members, digest_size=16).digest(), members))
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in out], pa.binary()), pa.array([m for _, m in out], pa.binary())], ["cls", "members"]
            )

    sets = kept.select("words").mapInArrow(lean(set_rows), "cls binary, members binary")
    # Rows that share an id or a key may bring other sets along, or one set twice.
    sets = sets.join(ends, "cls", "left_semi").dropDuplicates(["cls"])
    sets = written(sets, "sets")
    # A class has at most 2 * reach pairs in each tree, so these windows are small.
    of_ends = pairs.select(F.col("a").alias("v"), "a", "b", "votes").unionByName(
        pairs.select(F.col("b").alias("v"), "a", "b", "votes")
    )
    best = (
        of_ends.withColumn("rank", F.expr("row_number() over (partition by v order by votes desc, a, b)"))
        .where("rank = 1")
        .select("a", "b")
        .distinct()
    )
    checked = written(_confirmed(best, sets, percent), "confirmed")
    good = checked.where("linked").select("a", "b")
    labels = components(good, "a", "b")
    la = labels.select(F.col("vertex").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("vertex").alias("b"), F.col("label").alias("lb"))
    rest = (
        pairs.join(la, "a", "left")
        .join(lb, "b", "left")
        .where("coalesce(la, a) <> coalesce(lb, b)")
        .join(checked, ["a", "b"], "left_anti")
    )
    more = written(_confirmed(rest, sets, percent), "confirmed")
    good = written(good.unionByName(more.where("linked").select("a", "b")), "links")
    return good.unionByName(_rest_of_crowds(pairs, sets, components(good, "a", "b"), percent))


def _rest_of_crowds(pairs: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All further links (a, b) of crowded classes that join two components.

    A class is crowded if it has a candidate ``reach`` places away: the sorted orders
    may then have hidden links of it behind others. For these the search is exact.
    A crowd is what candidates connect. All its classes outside its largest component
    are compared with all of it, in blocks of ``BLOCK`` classes: a row for each pair of
    blocks, in which a task counts common members and gives back links alone.
    """
    ends = pairs.where("far").select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    crowds = components(pairs, "a", "b").select(F.col("vertex").alias("cls"), F.col("label").alias("crowd"))
    known = labels.select(F.col("vertex").alias("cls"), "label")
    rows = ends.join(crowds, "cls").join(known, "cls", "left").select("cls", "crowd", F.coalesce("label", "cls").alias("label"))
    rows = written(rows, "crowded")
    sizes = rows.groupBy("crowd", "label").agg(F.count(F.lit(1)).alias("k"))
    top = sizes.groupBy("crowd").agg(
        F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("classes"), F.count(F.lit(1)).alias("labels")
    )
    # A crowd of one component has nothing to find.
    top = top.where("labels > 1").select("crowd", F.col("top.label").alias("top"), F.ceil(F.col("classes") / BLOCK).alias("blocks"))
    placed = rows.join(top, "crowd").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    rest = (F.col("label") != F.col("top")).alias("rest")
    placed = placed.join(sets, "cls").select("crowd", "block", "blocks", rest, F.struct("cls", "label", "members").alias("x"))
    # A block holds about BLOCK classes, and so the lists are of bounded size.
    all_ = placed.groupBy("crowd", "block").agg(F.collect_list("x").alias("right"))
    rest = placed.where("rest").groupBy("crowd", "block", "blocks").agg(F.collect_list("x").alias("left"))
    rest = rest.select("crowd", "left", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            for left, right in zip(*(c.to_pylist() for c in batch.columns)):
                found = _links_between(left, right, percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"]
                )

    found = rest.join(all_, ["crowd", "block"]).select("left", "right").mapInArrow(lean(compare), "a binary, b binary")
    return written(found.distinct(), "links-of-crowds")


def _links_between(left: list[dict], right: list[dict], percent: int) -> list[tuple[bytes, bytes]]:
    """The linked pairs of different components, by counting common members through an index."""
    sets = [np.frombuffer(x["members"], np.uint64) for x in right]
    sizes = np.array([len(x) for x in sets])
    members, where = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(members, kind="stable")
    members, where = members[order], where[order]
    out = []
    for x in left:
        mine = np.frombuffer(x["members"], np.uint64)
        begin, end = np.searchsorted(members, mine), np.searchsorted(members, mine, "right")
        runs = [where[a:b] for a, b in zip(begin.tolist(), end.tolist()) if b > a]
        if not runs:
            continue
        both = np.bincount(np.concatenate(runs), minlength=len(sets))
        for k in np.flatnonzero(100 * both >= percent * (sizes + len(mine) - both)).tolist():
            if right[k]["label"] != x["label"]:
                out.append((min(x["cls"], right[k]["cls"]), max(x["cls"], right[k]["cls"])))
    return out


def near_duplicates(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 2,
    percent: int = 80,
    trees: int = 24,
    depth: int = 8,
    floor: int = 3,
    reach: int = 2,
) -> DataFrame:
    """<doc_id>, version, n_shingles, component_id and kept for every row of docs.

    ``version`` is xxhash64 of the text: with the id it names a document.
    """
    rows = written(document_classes(docs, doc_id, text, words, trees, depth), "classes")
    # The row of the least id stands for its class; null ids come last. An aggregate
    # finds it, so that copies meet before the shuffle and no task gets them all.
    row = F.struct(F.col("id").isNull().alias("unnamed"), "id", "version").alias("row")
    least = rows.where("cls is not null").groupBy("cls").agg(F.min(F.struct(row, "n", "signature", "bits")).alias("least"))
    chosen = least.select("cls", "least.row", "least.row.id", "least.n", "least.signature", "least.bits")
    classes = written(chosen, "forest-rows")
    joined = links(docs, classes, doc_id, text, words, trees, depth, floor, reach, percent)
    # Only classes with links have labels; the least row of each component speaks for it.
    named = components(joined, "a", "b").join(classes.select(F.col("cls").alias("vertex"), "row"), "vertex")
    component = named.groupBy("label").agg(F.min("row").alias("component"))
    linked = named.join(component, "label").select(F.col("vertex").alias("cls"), "component")
    of_class = classes.select("cls", "row").join(linked, "cls", "left")
    of_class = of_class.select("cls", F.coalesce("component", "row").alias("component"))
    alone = F.col("cls").isNull()
    kept = F.col("id").eqNullSafe(F.col("component.id")) & (F.col("version") == F.col("component.version"))
    return (
        rows.select("id", "version", "cls", "n")
        .join(of_class, "cls", "left")
        .select(
            F.col("id").alias(doc_id),
            "version",
            F.col("n").alias("n_shingles"),
            F.when(alone, F.col("id")).otherwise(F.col("component.id")).alias("component_id"),
            (alone | kept).alias("kept"),
        )
    )
