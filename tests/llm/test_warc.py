import base64
import hashlib
import random

import pytest

from ledgerframe.llm.warc import EMPTY_MEMBER, END, _gzip, archive_pages, read_archives, record, salvage, write_archives

DATE = "2024-01-01T00:00:00Z"
RECORDS = [record(i, f"http://x/{i}", f"<p>{i} WARC/1.1\r\n é</p>".encode() * (i + 1), None, DATE) for i in range(6)]
PLAIN = b"".join(r + END for r in RECORDS)
PACKED = b"".join(_gzip(r + END) + EMPTY_MEMBER for r in RECORDS)


def ids(found):
    return [int(h["x-page-id"]) for _, h, _ in found.records if h.get("x-page-id", "").isdigit()]


@pytest.mark.parametrize("data", [PLAIN, PACKED])
def test_whole_archives(data):
    found = salvage(data)
    assert ids(found) == [*range(6)] and found.gaps == []


def test_flipped_byte_costs_one_record():
    at = len(RECORDS[0]) + len(END) + len(RECORDS[1]) - 3
    data = bytearray(PLAIN)
    data[at] ^= 1
    found = salvage(bytes(data))
    assert 1 not in ids(found) and {0, 2, 3, 4, 5} <= {*ids(found)}
    begin, end, why = found.gaps[0]
    assert begin == len(RECORDS[0]) + len(END) and why == "block digest differs" and end <= begin + len(RECORDS[1]) + len(END)


def test_damage_never_hides_the_rest():
    r = random.Random(1)
    for data in (PLAIN, PACKED):
        for _ in range(60):
            broken = bytearray(data)
            a = r.randrange(len(broken))
            b = min(len(broken), a + r.randint(1, 200))
            how = r.randrange(3)
            broken[a:b] = b"" if how == 0 else r.randbytes(b - a) if how == 1 else r.randbytes(50)
            found = salvage(bytes(broken))
            # A header's own text has no digest: a changed page id costs a record without a gap.
            assert len({*ids(found)} & {*range(6)}) >= 3
            assert len(found.records) + len(found.gaps) >= 4
            assert all(0 <= x <= y <= len(broken) for x, y, _ in found.gaps)


def test_truncated_and_foreign_bytes():
    found = salvage(PLAIN[:-40])
    assert ids(found) == [0, 1, 2, 3, 4] and found.gaps[0][2] == "no end mark"
    found = salvage(b"junk" + PLAIN)
    assert ids(found) == [*range(6)] and found.gaps == [(0, 4, "no version line")]
    assert salvage(b"").records == [] and salvage(b"\x00" * 100).gaps == [(0, 100, "no version line")]


def pages(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "http://a b/\n4", ""), (5, "u", "x" * 200_000), (6, "u", "é日本\r\n\r\nWARC/1.1\r\n"), (7, "u", "same"), (7, "u", "same"), (None, "u", "same"), (None, "u", "alone"), (0, "u", "last"), (9, "u", "last")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


@pytest.mark.parametrize("gzip", [False, True])
def test_round_trip(spark, tmp_path, gzip):
    rows, df = pages(spark)
    path = f"file://{tmp_path}/warc"
    got = archive_pages(df, path, records_per_file=2, gzip_members=gzip).collect()
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "")]
        first = min((j for j in same if j is not None), default=None)
        revisit = first is not None and i != first
        out.append((-1 if i is None else i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(out, key=lambda x: x)
    payloads = {r.page_id: bytes(r.payload) for r in read_archives(spark, path).filter("record_type = 'response' AND page_id IS NOT NULL").collect()}
    assert payloads[6] == rows[5][2].encode() and payloads[5] == b"x" * 200_000 and payloads[3] == b""


def test_gaps_are_rows(spark, tmp_path):
    data = bytearray(PLAIN)
    data[len(RECORDS[0]) + len(END) + 20] ^= 255
    (tmp_path / "a.warc").write_bytes(bytes(data))
    rows = read_archives(spark, f"file://{tmp_path}").collect()
    assert sum(r.gap_reason is None for r in rows) >= 5
    assert all(r.gap_end >= r.begin and r.archive.endswith("a.warc") for r in rows if r.gap_reason)


def test_no_pages(spark, tmp_path):
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert read_archives(spark, f"file://{tmp_path}/w").collect() == []


def test_large_pages_come_in_archives_of_bounded_size(spark, tmp_path):
    """Files are cut by bytes as well as by records; no page is lost."""
    sizes = [10] * 60 + [300_000] * 12 + [900_000] * 3 + [3_000_000]
    rows = [(i, f"http://h/{i}", f"{i}-".ljust(n, "x")) for i, n in enumerate(sizes)]
    path = f"file://{tmp_path}/w"
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, file_bytes=1 << 20)
    files = sorted(f.stat().st_size for f in (tmp_path / "w").glob("part-*"))
    assert files[-1] < 3_010_000 and all(n <= 1 << 20 for n in files[:-1]) and len(files) < 20
    got = read_archives(spark, path).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in got) == [(i, h) for i, _, h in rows]
