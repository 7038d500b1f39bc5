import hashlib
import os
import tarfile
import zlib

import pytest

from zonalis.llm import media

TEXTS = [None, "", "x", "é" * 96, "a" * 192, "b" * 193, "line\n" * 5000, "x", "\x00\x01", "日本 " * 40_000]


def test_round_trip_through_the_archive(spark, tmp_path):
    rows = [(i, t, 5, "m") for i, t in enumerate(TEXTS)] + [(None, "q", 1, "m"), (2, "x", 1, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, media string").repartition(3)
    path = f"file://{tmp_path}/a"
    got = sorted((tuple(r) for r in media.media_columns(df, path).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        p = raw + b" " * ((-len(raw) % 192) or (192 if not raw else 0))
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert [g[:5] for g in got] == sorted(want, key=str)
    assert len({g[3:] for g in got if g[1] == 1 and g[0] in (2, 7)}) == 1
    files = [f for f in os.listdir(tmp_path / "a") if f.endswith(".tar")]
    assert sum(len(tarfile.open(tmp_path / "a" / f).getmembers()) for f in files) == len(rows)
    # small ranges read each member once; a shard outside every manifest is not read
    (tmp_path / "a" / "shard-left-over.tar").write_bytes(b"junk")
    small = media.read_archive(spark, path, split_bytes=700)
    assert small.count() == len(rows)
    assert media.media_columns(df.limit(0), f"file://{tmp_path}/b").count() == 0


def test_members_are_read_again_on_their_own(tmp_path):
    w = media.ArchiveWriter({"path": f"file://{tmp_path}"}, False)
    import pyarrow as pa

    png = [media.to_png(media.pad(t.encode())) for t in ("one", "two", "three")]
    w.commit([w.write(iter([pa.record_batch([pa.array([1, 2, 3]), pa.array([3, 3, 5]), pa.array(png)], ["id", "n", "m"])]))])
    r = media.ArchiveReader({"path": f"file://{tmp_path}"})
    (part,) = r.partitions()

    class Flaky:
        def __init__(self, fs):
            self.fs, self.opened = fs, 0

        def open_input_file(self, p):
            self.opened += 1
            if p.endswith(".tar") and self.opened in (2, 3):
                raise OSError("lost")
            return self.fs.open_input_file(p)

    flaky = Flaky(media._fs(f"file://{tmp_path}")[0])
    real, media._fs = media._fs, lambda p: (flaky, str(tmp_path))
    try:
        got = [x for b in r.read(part) for x in b.column(2).to_pylist()]
    finally:
        media._fs = real
    assert got == png
    with pytest.raises(ValueError):
        media.from_png(png[0][:40] + b"?" + png[0][41:])
