import gzip
import hashlib
import io
import random

import pytest

from tessera.llm import warc


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    contents = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\n\nhttp://x 1 2 3 4\n", b"", b"\n\n\n", bytes(range(256)) * 5]
    records = [(f"http://h/{k} with space", "1.2.3.4", "20240229123456", "text/html", c) for k, c in enumerate(contents)]
    out = list(warc.parse_arc(warc.write_arc(records, version)))
    assert [(r.url, r.ip, r.date, r.content_type, r.content) for r in out] == records and {r.version for r in out} == {version}
    text = "\r\n\r\n".join([*(warc.warc_record(k, r, None) for k, r in enumerate(out)), ""]).encode()
    parsed = list(warc.parse_warc(io.BytesIO(text)))
    assert [b for _, b in parsed] == contents and parsed[0][0]["WARC-Date"] == "2024-02-29T12:34:56Z"
    assert len({f["WARC-Record-ID"] for f, _ in parsed}) == len(contents)


def test_a_short_record_is_an_error():
    block = warc.write_arc([("http://h/", "0.0.0.0", "20240101000000", "text/html", b"x" * 50)], 1)
    with pytest.raises(ValueError):
        list(warc.parse_arc(block[:-30]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(block.replace(b"1 0 tessera", b"7 0 tessera")))


def test_pages(spark, tmp_path):
    rng = random.Random(2)
    big, bigger = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 80, "z" * 3000
    pages = [(i, f"http://h/{i}", f"<p>{rng.random()}</p>") for i in range(30)]
    pages += [(100 + i, "http://copies/", big) for i in range(40)] + [(200, None, None), (201, "u", ""), (202, "two words", ""), (203, "a", bigger), (5, "b", bigger), (300, "c", "x" * 999), (301, "c", "x" * 999), (None, "n", big), (139, "again", big)]
    df = spark.createDataFrame([(*p, "d", "k") for p in pages], "page_id long, url string, html string, digest string, refers_to string").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_pages(spark, df, path)
    rows = warc.read_archives(spark, path).collect()
    top = {}
    for i, _, h in pages:
        if len((h or "").encode()) >= 1000:
            top[h] = max(top.get(h, -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        body = (h or "").encode()
        revisit = h in top and (i is None or i < top[h])
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top[h] if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr) == sorted(want, key=repr)
    held = {r.page_id: r for r in rows}
    assert bytes(held[139].payload).decode() == big and held[100].payload is None
    files = list((tmp_path / "w").glob("volume=*/part-*"))
    assert files and gzip.open(files[0]).read(8) == b"WARC/1.1"


def test_no_pages(spark, tmp_path):
    warc.write_pages(spark, spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_legacy_files(spark, tmp_path):
    """ARC files of both versions, plain and compressed, to WARC files and back."""
    contents = {}
    for k, (version, name) in enumerate([(1, "a.arc"), (2, "b.arc.gz"), (1, "deep/c.arc")]):
        held = [f"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody {k}\r\n\r\nWARC/1.1".encode(), b"\xff\xfe raw \x00", b"", "é".encode() * 500]
        records = [(f"http://h/{k}/{j}", "1.2.3.4", "19991231235959", "text/html", c) for j, c in enumerate(held)]
        block = warc.write_arc(records, version)
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(gzip.compress(block) if name.endswith("gz") else block)
        contents |= {r[0]: r[4] for r in records}
    (tmp_path / "other.txt").write_text("no archive")
    rows = warc.read_arc(spark, f"file://{tmp_path}").collect()
    assert {r.url: bytes(r.content) for r in rows} == contents and {r.version for r in rows} == {1, 2} and len(rows) == 12
    warc.convert_arc(spark, f"file://{tmp_path}", f"file://{tmp_path}/warc")
    out = {r.url: r for r in warc.read_archives(spark, f"file://{tmp_path}/warc").collect()}
    assert {u: bytes(r.payload) for u, r in out.items()} == {u: warc.split_http(c)[1] for u, c in contents.items()}
    assert {r.date for r in out.values()} == {"1999-12-31T23:59:59Z"} and len({r.record_id for r in out.values()}) == 12
    (tmp_path / "short.arc").write_bytes(warc.write_arc([("http://h/", "0.0.0.0", "20240101000000", "text/html", b"x" * 50)], 1)[:-30])
    with pytest.raises(Exception, match="ends after"):
        warc.read_arc(spark, f"file://{tmp_path}").collect()


def test_volumes_by_bytes(spark, tmp_path, monkeypatch):
    """Long pages go to volumes of their own, so that no reader holds many of them."""
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    df = spark.createDataFrame([(i, f"u{i}", f"{i}" * (9000 if i % 5 == 0 else 10)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write_pages(spark, df, f"file://{tmp_path}/v")
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "v").glob("volume=*/part-*")]
    assert len(sizes) > 3 and max(sizes) < 60_000
    assert warc.read_archives(spark, f"file://{tmp_path}/v").count() == 40
