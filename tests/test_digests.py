"""Digests of files too large for a row."""

import hashlib

from aeroframe.sources import cases


def test_large_files_are_hashed_in_blocks(spark, tmp_path):
    (tmp_path / "a b.bin").write_bytes(b"hello")
    (tmp_path / "c.bin").write_bytes(bytes(range(99)))
    with open(tmp_path / "huge.bin", "wb") as f:
        f.truncate((2 << 30) + 5)       # a sparse file beyond what one value can hold
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path.rsplit("/", 1)[1].replace("%20", " "): (r.sha256, r["size"]) for r in cases.file_digests(files).collect()}
    digest = hashlib.sha256()
    for _ in range(2 << 7):
        digest.update(bytes(8 << 20))
    digest.update(bytes(5))
    assert got == {"a b.bin": (hashlib.sha256(b"hello").hexdigest(), 5), "c.bin": (hashlib.sha256(bytes(range(99))).hexdigest(), 99), "huge.bin": (digest.hexdigest(), (2 << 30) + 5)}
    expected = spark.createDataFrame([("huge.bin", "u"), ("none.bin", "u")], "relpath string, url string")
    status = {r.relpath: (r.status, r["size"]) for r in cases.file_manifest(expected, files, str(tmp_path)).collect()}
    assert status == {"huge.bin": ("present", (2 << 30) + 5), "none.bin": ("missing", None)}
    # the same digests whichever way a file is read
    few = {r.path: r.sha256 for r in cases.file_digests(files.filter("length < 100"), whole_bytes=0).collect()}
    assert {p.rsplit("/", 1)[1].replace("%20", " "): h for p, h in few.items()} == {n: got[n][0] for n in ("a b.bin", "c.bin")}
