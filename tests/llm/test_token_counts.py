from __future__ import annotations

import numpy as np
import pytest

from colloquy.llm import separators
from colloquy.session import new_folder


@pytest.fixture
def flat(spark, tmp_path):
    def build(*contents, tail=b""):
        rows = []
        for k, ids in enumerate(contents):
            path = tmp_path / f"{k}.ids"
            path.write_bytes(np.array(ids, "<u2").tobytes() + tail)
            rows.append((str(path), path.stat().st_size))
        return spark.createDataFrame(rows, "file string, n_bytes long")

    return build


def brute(ids, separator):
    out, start = [], 0
    for at, x in enumerate(ids):
        if x == separator:
            out.append((start, at - start, True))
            start = at + 1
    return out + ([(start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.mark.parametrize(("block_bytes", "group"), [(2, 1), (6, 2), (14, 3), (1 << 20, 1024)])
def test_equals_one_pass(flat, block_bytes, group):
    r = np.random.default_rng(1)
    contents = [r.integers(0, 5, n).tolist() for n in (1, 40, 97)] + [[0], [0, 0, 0], [1, 2, 3], []]
    files = flat(*contents)
    files = files.unionByName(files.limit(1))
    found = separators.scan(files, separator=0, block_bytes=block_bytes, group=group).collect()
    names = [row.file for row in files.collect()][: len(contents)]
    for name, ids in zip(names, contents):
        rows = sorted((x.place, x.start, x.n_tokens, x.ended) for x in found if x.file == name)
        assert rows == [(k, *x) for k, x in enumerate(brute(ids, 0))]


def test_half_an_id_at_the_end(flat):
    found = separators.scan(flat([7, 0, 8], tail=b"x"), separator=0).collect()
    assert sorted((x.start, x.n_tokens, x.ended) for x in found) == [(0, 1, True), (2, 1, False)]


def test_documents_round(spark, documents):
    rows = [(1, "hello world"), (2, None), (3, ""), (3, ""), (None, "x " * 50), (5, "word " * 400_000)]
    docs = documents(rows).repartition(2)
    folder = new_folder(spark, "tokens")
    made = separators.write_tokens(docs, folder)
    listed = separators.files_in(spark, folder)
    assert listed.count() == made.select("file").distinct().count()
    found = separators.counted(docs, block_bytes=1 << 12)
    expected = sorted((str(r.doc_id), r.n_ids) for r in made.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in found.collect()) == expected
    assert dict(expected)["2"] == 0 and dict(expected)["5"] >= 400_000


def test_no_documents(documents):
    assert separators.counted(documents([])).count() == 0


def test_parts_do_not_change_ids():
    import base64

    import tiktoken

    with open(separators.VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("flat", pat_str=separators.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "Some words, and  more\n\nof them é " * 60_000
    parts = list(separators._parts(text))
    assert len(parts) > 1 and "".join(parts) == text
    assert [i for p in parts for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)
