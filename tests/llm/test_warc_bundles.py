from __future__ import annotations

import base64
import hashlib
import io
import random
from pathlib import Path

import pytest
import zstandard
from pyarrow import fs

from colloquy.llm.warc_bundles import Bundle, fetch, page_of, parsed, read, record_id, seek_table, write

SCHEMA = "page_id long, url string, html string, key string, last string, n int, page string, payload string, frame int"


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*row, "k", "l", 1, "p", "x", 2) for row in rows], SCHEMA)


def some_pages(r, n):
    texts = ["", None, "<p>one</p>", "<p>zwei é</p>\r\n\r\nWARC/1.1\r\n", "x" * 5000]
    rows = [(i, f"http://h{i % 3}.example/{i}", r.choice(texts) if r.random() < 0.5 else f"<p>{r.random()}</p>" * r.randrange(40)) for i in range(n)]
    rows += [(None, None, "<p>one</p>"), (None, "u v\r\nw", "alone"), rows[3], rows[4], (2**62, "http://é", "<p>one</p>"), (-7, "", "y\0z")]
    r.shuffle(rows)
    return rows


def brute(rows, min_bytes=0):
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        ids = [j for j, _, other in rows if (other or "").encode() == payload and j is not None]
        last = max(ids, default=None)
        again = last is not None and i != last and len(payload) >= min_bytes
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((i, len(payload), sha, "revisit" if again else "response", last if again else None))
    return sorted(map(str, out))


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("options", [{}, {"frame_bytes": 700, "bundle_bytes": 3000}, {"min_bytes": 11}, {"broadcast_rows": 2}])
def test_what_is_written_is_read(pages, tmp_path, options):
    rows = some_pages(random.Random(1), 80)
    index = write(pages(rows), f"file://{tmp_path}/w", **options)
    found = read(index).collect()
    got = sorted(str(tuple(x[c] for c in COLUMNS)) for x in found)
    assert got == brute(rows, options.get("min_bytes", 0))
    payloads = sorted(str((x.page_id, bytes(x.payload))) for x in found if x.record_type == "response")
    kept = [x for x in found if x.record_type == "response"]
    texts = {(i, (html or "").encode()) for i, _, html in rows}
    assert len(payloads) == len(kept) and all((x.page_id, bytes(x.payload)) in texts for x in kept)
    assert all(x.payload is None for x in found if x.record_type == "revisit")
    assert "payload" not in read(index, payload=False).columns


def test_bundles_are_plain_zstandard_and_warc(pages, tmp_path):
    rows = [(i, f"http://example/{i}", f"<p>{i}</p>" * 30) for i in range(50)]
    index = write(pages(rows), f"file://{tmp_path}/w", frame_bytes=1000).collect()
    seen = set()
    for file in {x.file for x in index}:
        raw = Path(file.removeprefix("file://")).read_bytes()
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        with fs.LocalFileSystem().open_input_file(file.removeprefix("file://")) as source:
            table = seek_table(source)
        begin = 0
        for frame in sorted((x for x in index if x.file == file), key=lambda x: x.frame):
            start, packed, size = table[frame.frame]
            own = zstandard.ZstdDecompressor().decompress(raw[start : start + packed])
            assert own == plain[begin : begin + size] and frame.packed == packed
            begin += size
            assert size <= 1000 or len(frame.records) == 1
            for r in frame.records:
                headers, http, payload = parsed(own[r.start : r.start + r.length])
                assert headers["WARC-Record-ID"] == record_id(r.page)
                assert headers["WARC-Target-URI"] == f"http://example/{r.page}"
                assert http["Content-Length"] == str(len(payload))
                seen.add((int(r.page), payload.decode()))
        assert begin == len(plain)
    assert seen == {(i, html) for i, _, html in rows}


def test_fetch_reads_only_the_frames_it_needs(spark, pages, tmp_path):
    rows = [(i, "u", str(i) * 50) for i in range(60)]
    index = write(pages(rows), f"file://{tmp_path}/w", frame_bytes=1500)
    wanted = spark.createDataFrame([(3,), (41,), (41,), (77,), (None,)], "page_id long")
    needed = {(x.file, x.frame) for x in index.collect() if {r.page for r in x.records} & {"3", "41"}}
    for x in index.select("file").distinct().collect():  # damage the others
        path = Path(x.file.removeprefix("file://"))
        raw = bytearray(path.read_bytes())
        with fs.LocalFileSystem().open_input_file(str(path)) as source:
            table = seek_table(source)
        for k, (start, packed, _) in enumerate(table):
            if (x.file, k) not in needed:
                raw[start : start + packed] = bytes(packed)
        path.write_bytes(raw)
    found = sorted((x.page_id, bytes(x.payload)) for x in fetch(index, wanted).collect())
    assert found == [(3, b"3" * 50), (41, b"41" * 50)]
    with pytest.raises(Exception, match="(?i)zstd|frame|damaged"):
        read(index).collect()


def test_ids_come_back():
    for page in (None, "", "7", "a b>%/é\n"):
        assert page_of(record_id(page)) == page


def test_no_pages(pages, tmp_path):
    index = write(pages([]), f"file://{tmp_path}/w")
    assert index.collect() == [] and read(index).collect() == []


def test_a_bundle_of_no_records_is_a_seek_table():
    stream = io.BytesIO()
    stream.close = lambda: None
    Bundle(stream, 10).close()
    assert len(stream.getvalue()) == 17
