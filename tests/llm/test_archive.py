"""The WARC writer and reader: round trip, revisits, rolling, determinism, commit."""

from __future__ import annotations

import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strataline.llm.queries import op13_warc_archive
from strataline.llm.warc import read_manifest, read_warc, write_warc
from strataline.settings import work_folder

BIG, NEAR, SMALL = "<p>ä漢😀</p>\r\n\r\n" * 60, "x" * 1000, "y" * 999


def pages(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"page_id {kind}, url string, html string, key string, digest string, segment string, payload string")


def row(i, url, html):
    return (i, url, html, "clash", "clash", "clash", "clash")


ROWS = [
    row(1, "http://a.example/1", BIG),
    row(2, "http://a.example/2", BIG),
    row(7, None, BIG),
    row(7, None, BIG),  # a repeated row
    row(3, "http://a.example/a b\r\nX-Bad: 1", SMALL),
    row(4, "http://a.example/4", SMALL),
    row(5, "http://a.example/5", NEAR),
    row(None, "http://a.example/n", NEAR),
    row(None, "", None),
    row(6, "http://a.example/6", ""),
    row(8, "http://ä.example/8", "漢" * 400_000),
    row(9, "http://a.example/9", "\r\n\r\nWARC/1.1\r\n\r\n"),
]


def brute(rows):
    """(id, url, bytes, digest, type, refers_to) sorted; the largest id stores a shared payload, of equal ids one."""
    best, stored, out = {}, set(), []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for r in order:
        best[r[2] or ""] = r[0]
    for r in reversed(order):
        data = (r[2] or "").encode()
        own = len(data) < 1000 or ((r[2] or "") not in stored and r[0] == best[r[2] or ""])
        stored.add(r[2] or "")
        out.append((str(r[0]), len(data), hashlib.sha1(data).hexdigest(), "response" if own else "revisit", None if own else str(best[r[2] or ""])))
    return sorted(out, key=str)


def written(found):
    return sorted([(str(r.key), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found], key=str)


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_archive_round_trip(spark, kind):
    rows = [r if kind != "string" or r[0] is None else (str(r[0]), *r[1:]) for r in ROWS]
    folder = work_folder(spark, "archive")
    write_warc(pages(spark, rows, kind).repartition(5), folder, segment_bytes=2000, roll_bytes=300)
    found = read_warc(spark, folder).collect()
    assert written(found) == brute(rows)
    texts = {(r.key, r.payload_digest): r.payload for r in found if r.record_type == "response"}
    for r in rows:
        stored = [t for (k, d), t in texts.items() if d == hashlib.sha1((r[2] or "").encode()).hexdigest()]
        assert stored and set(stored) == {r[2] or ""}
    ids = [r.record_id for r in found]
    assert len(set(ids)) == len(ids)
    assert {r.refers_to_id for r in found if r.refers_to_id} <= set(ids)
    assert {r.url for r in found if r.key == "3"} == {"http://a.example/a%20b%0D%0AX-Bad:%201"}


def contents(folder: str) -> dict[str, str]:
    root = Path("/" + folder.split(":", 1)[-1].lstrip("/"))
    assert not [p for p in root.iterdir() if p.name.startswith(".part")]
    return {p.name: hashlib.sha1(p.read_bytes()).hexdigest() for p in root.glob("*.warc.gz")}


def test_files_do_not_depend_on_the_partitioning(spark):
    rows = [*ROWS, *[row(100 + i, f"http://b.example/{i}", f"{i} " * (300 + 37 * i % 900)) for i in range(60)]]
    files = []
    for parts in (1, 7):
        folder = work_folder(spark, "archive")
        manifest = write_warc(pages(spark, rows).repartition(parts), folder, segment_bytes=20_000, roll_bytes=2000).collect()
        files.append(contents(folder))
        assert {m.file: m.file_sha1 for m in manifest} == files[-1]
        assert all(m.records >= 1 for m in manifest) and len({m.segment for m in manifest}) > 3
        assert sum(m.records for m in manifest) == len(rows)
    assert files[0] == files[1] and len(files[0]) > 8


def test_records_are_gzip_members_of_standard_form(spark):
    folder = work_folder(spark, "archive")
    write_warc(pages(spark, ROWS[:4]), folder)
    root = Path("/" + folder.split(":", 1)[-1].lstrip("/"))
    (file,) = root.glob("*.warc.gz")
    whole = gzip.decompress(file.read_bytes()).decode()
    assert whole.count("WARC/1.1\r\nWARC-Type: ") == 5 and whole.endswith("\r\n\r\n")
    assert whole.count("WARC-Type: revisit") == 3 and whole.count("WARC-Type: warcinfo") == 1


def test_a_damaged_or_uncommitted_archive_is_not_read(spark):
    folder = work_folder(spark, "archive")
    write_warc(pages(spark, ROWS[:3]), folder)
    root = Path("/" + folder.split(":", 1)[-1].lstrip("/"))
    (file,) = root.glob("*.warc.gz")
    data = bytearray(file.read_bytes())
    with pytest.raises(Exception, match="manifest"):
        write_warc(pages(spark, ROWS[:3]), folder)
    file.write_bytes(data[:-40])
    with pytest.raises(Exception, match="not as the manifest has it"):
        read_warc(spark, folder).collect()
    with pytest.raises(Exception, match="(?i)path"):
        read_manifest(spark, work_folder(spark, "archive")).collect()


def test_archive_of_no_rows(spark):
    folder = work_folder(spark, "archive")
    assert write_warc(pages(spark, []), folder).collect() == []
    assert read_warc(spark, folder).collect() == []


def test_hot_payloads_and_query(spark, tmp_path):
    rows = [row(i, f"http://c.example/{i}", BIG if i % 3 == 0 else f"{i}" * 700) for i in range(3000)]
    pages(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    found = op13_warc_archive(spark, str(tmp_path))
    assert [c for c in found.columns] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert found.where(F.col("record_type") == "revisit").select("refers_to").distinct().collect() == [(2997,)]
    assert found.where("record_type = 'revisit'").count() == 999 and found.count() == 3000
