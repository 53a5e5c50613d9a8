"""WARC files read record by record against the same files read whole."""

import gzip

import numpy as np
import pytest

from waymark.llm import warc_revisit as w


def some(seed, n=120):
    """Records with bodies of many kinds: empty, long, with line ends at either end, with other records' names in them."""
    rng = np.random.default_rng(seed)
    ends = [b"", b"\r\n", b"\r\n\r\n", b"\n", b"WARC/1.0", b"\r\n\r\nWARC", b"\xff\xfe\x00"]
    pick = lambda: ends[int(rng.integers(len(ends)))]
    return [w.record_bytes(f"urn:{seed}:{i}", "revisit" if i % 4 == 3 else "response", f"http://a.com/{i}", i, {"ETag": str(i)}, b"" if i % 4 == 3 else pick() + rng.bytes(int(rng.integers(0, 900))).replace(b"WARC", b"") + pick()) for i in range(n)]


def rows(df):
    return sorted(map(str, df.select(*w.NAMES).collect()))


def whole(spark, path):
    return rows(w.read_records(spark.read.format("binaryFile").load(path).select("content")))


@pytest.mark.parametrize("size", ["128m", "700b"])
def test_files_by_record_equal_whole_files(spark, tmp_path, size):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "plain.warc").write_bytes(b"".join(some(1)))
    (folder / "with [odd] name.warc").write_bytes(b"".join(some(2)) + w.record_bytes("urn:in", "response", "u", 1, {}, b"".join(some(3, 4))))
    (folder / "by member.warc.gz").write_bytes(b"".join(map(gzip.compress, some(4))))
    (folder / "one.warc.gz").write_bytes(gzip.compress(b"".join(some(5))))
    (folder / "cut.warc").write_bytes(b"".join(some(6))[:-40])
    (folder / "junk first.warc").write_bytes(b"nothing\r\n\r\n" + b"".join(some(7, 5)))
    (folder / "empty.warc").write_bytes(b"")
    (folder / "info.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n" + some(8, 1)[0])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = rows(w.read_warc(spark, str(folder)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = whole(spark, str(folder))
    assert len(want) > 600 and got == want


def test_a_broken_gzip_file(spark, tmp_path):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(map(gzip.compress, some(9, 20)))[:-30])
    with pytest.raises(Exception, match="(?i)end of input|gzip|corrupt|FAILED_READ_FILE"):
        w.read_warc(spark, str(path)).collect()
    got = {r["record_id"] for r in w.read_warc(spark, str(path), skip_broken=True).collect()}
    assert got <= {f"urn:9:{i}" for i in range(20)}


def test_no_records(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"")
    assert w.read_warc(spark, str(tmp_path)).count() == 0
