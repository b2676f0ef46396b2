"""Token counts by a separator scan over flat, unindexed token files.

A file is nothing but ids of fixed width, with an end-of-document id after each
document. Tasks read blocks of it and find the separators with one vectorised
comparison. A block knows neither how many documents came before it nor how long
the one is that it begins in; both follow from what the blocks before it found, by
a prefix scan: the number of separators is summed, the place of the last one
is carried as a maximum. The scan runs in two levels, so that no window holds more
than ``group`` blocks of a file or one row for each such group.

Defined results: an empty file has no documents; two separators in a row have an
empty document between them; ids after the last separator are a document that is not
``ended``; bytes at the end that are no whole id are left out; a file listed twice
is scanned once.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_folder
from .store import written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that parts text before byte-pair merges in this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_DOCUMENT = 50256  # free in the vocabulary
ID_TYPE = "<u2"
BLOCK_BYTES = 8 << 20
GROUP = 1024
# A longer text is encoded in parts that begin at a single blank before a letter,
# where the pattern always parts words.
PART = 1 << 20


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _parts(text: str) -> Iterator[str]:
    import regex

    begin = 0
    while len(text) - begin > PART:
        cut = regex.compile(r"(?<=\p{L}) (?=\p{L})").search(text, begin + PART)
        if not cut:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def write_tokens(
    docs: DataFrame,
    folder: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    separator: int = END_OF_DOCUMENT,
    id_type: str = ID_TYPE,
) -> DataFrame:
    """Encode the documents into flat files in the shared folder, one for each task.

    Returns (file, place, <doc_id>, n_ids) in the order of the files. The names of
    files come from these rows alone: what a lost attempt has left is never read.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("words"))
    schema = T.StructType(
        [
            T.StructField("file", T.StringType()),
            T.StructField("place", T.LongType()),
            T.StructField(doc_id, docs.schema[doc_id].dataType),
            T.StructField("n_ids", T.LongType()),
        ]
    )
    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        import pyarrow as pa
        import tiktoken

        encoding = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        end = np.array([separator], id_type).tobytes()
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        name, place, out = f"{uuid.uuid4().hex}.ids", 0, None
        for batch in batches:
            if out is None:
                out = system.open_output_stream(f"{root}/{name}")
            counts = []
            for value in batch.column(1):
                n = 0
                for part in _parts(value.as_py() or ""):
                    ids = encoding.encode_to_numpy(part) if part else ()
                    n += len(ids)
                    if len(ids):
                        out.write(ids.astype(id_type).tobytes())
                out.write(end)
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{folder}/{name}"] * len(counts), pa.string()),
                    pa.array(range(place, place + len(counts)), pa.int64()),
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                ],
                schema.names,
            )
            place += len(counts)
        if out is not None:
            out.close()

    return written(rows.mapInArrow(run, schema), "token-files")


def files_in(spark: SparkSession, folder: str) -> DataFrame:
    """(file, n_bytes) of the files of a folder, listed by Spark; no content is read."""
    return spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), F.col("length").alias("n_bytes"))


_FOUND = "file string, block bigint, start bigint, ids bigint, places array<int>"


def scan(
    files: DataFrame,
    *,
    separator: int = END_OF_DOCUMENT,
    id_type: str = ID_TYPE,
    block_bytes: int = BLOCK_BYTES,
    group: int = GROUP,
) -> DataFrame:
    """(file, place, start, n_tokens, ended) of every document in files of (file, n_bytes)."""
    width = np.dtype(id_type).itemsize
    size = max(1, block_bytes // width)
    ids = F.floor(F.col("n_bytes") / width)
    blocks = (
        files.dropDuplicates(["file"])
        .where(ids > 0)
        .select("file", ids.alias("total"), F.explode(F.sequence(F.lit(0), F.floor((ids - 1) / size))).alias("block"))
        .select("file", "block", (F.col("block") * size).alias("start"), F.least(F.lit(size), F.col("total") - F.col("block") * size).alias("ids"))
        .repartition("file", "block")
    )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, block, start, count in zip(*(c.to_pylist() for c in batch.columns)):
                system, path = _open(name)
                with system.open_input_file(path) as source:
                    data = source.read_at(count * width, start * width)
                found = np.flatnonzero(np.frombuffer(data, id_type) == separator).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([block], pa.int64()), pa.array([start], pa.int64()), pa.array([count], pa.int64()),
                     pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))],
                    ["file", "block", "start", "ids", "places"],
                )

    found = written(blocks.mapInArrow(run, _FOUND), "separators")
    # What a block tells those after it: how many separators, and where its last one is.
    last = F.when(F.size("places") > 0, F.col("start") + F.element_at("places", -1))
    told = found.select(
        "file", "block", F.floor(F.col("block") / group).alias("group"), F.size("places").cast("long").alias("n"), last.alias("last")
    )
    groups = told.groupBy("file", "group").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    before = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(
        "file", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.max("last").over(before).alias("last_before")
    )
    within = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        told.join(groups, ["file", "group"])
        .select(
            "file",
            "block",
            (F.col("n_before") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("first"),
            F.coalesce(F.max("last").over(within), F.col("last_before"), F.lit(-1)).alias("previous"),
        )
    )
    # A document starts one past the separator before it: in its block, or carried.
    ends = F.transform("places", lambda p: F.col("start") + p)
    begins = F.concat(F.array(F.col("previous") + 1), F.transform(ends, lambda p: p + 1))
    docs = (
        found.join(carried, ["file", "block"])
        .where(F.size("places") > 0)
        .select("file", "first", F.posexplode(F.arrays_zip(F.slice(begins, F.lit(1), F.size("places")).alias("b"), ends.alias("e"))).alias("k", "x"))
        .select(
            "file",
            (F.col("first") + F.col("k")).alias("place"),
            F.col("x.b").alias("start"),
            (F.col("x.e") - F.col("x.b")).alias("n_tokens"),
            F.lit(True).alias("ended"),
        )
    )
    rest = (
        found.select("file", (F.col("start") + F.col("ids")).alias("end"), F.size("places").cast("long").alias("n"), last.alias("last"))
        .groupBy("file")
        .agg(F.max("end").alias("end"), F.sum("n").alias("n"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
        .where(F.col("end") > F.col("last") + 1)
        .select(
            "file",
            F.col("n").alias("place"),
            (F.col("last") + 1).alias("start"),
            (F.col("end") - F.col("last") - 1).alias("n_tokens"),
            F.lit(False).alias("ended"),
        )
    )
    return docs.unionByName(rest)


def counted(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """<doc_id>, place in its file, start and n_tokens of every document, by way of flat files."""
    folder = new_folder(docs.sparkSession, "tokens")
    made = write_tokens(docs, folder, doc_id=doc_id, text=text)
    width = np.dtype(ID_TYPE).itemsize
    files = made.groupBy("file").agg((F.sum(F.col("n_ids") + 1) * width).alias("n_bytes"))
    found = scan(files, block_bytes=block_bytes)
    return made.select("file", "place", doc_id).join(found, ["file", "place"]).select(doc_id, "place", "start", "n_tokens")
