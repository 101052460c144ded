import gzip
import hashlib
import io
import random

from pyspark.sql import functions as F

from shelfmark.llm import warc
from shelfmark.llm.warc import Salvage, build_record, gzip_member, page_records, read_warc, write_warc

DATE = "2025-01-01T00:00:00Z"
BIG = "<p>" + "x" * 1500


def pages(spark):
    rows = [
        (1, "http://a/1", BIG), (2, "http://a/2 b\r\nInjected: 1", BIG), (3, None, BIG), (4, "u", "small"),
        (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", "WARC/1.1\r\nÀ\r\n\r\n\x1f\u008b"),
        (9, "u", "y" * (17 << 20)), (None, "u", "no key"), (10, "u", "é" * 500), (11, "u", "é" * 500), (12, "u", "é" * 499),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, refers_to string")


def expected(rows):
    newest = {}
    for r in rows:
        body = (r["html"] or "").encode()
        if len(body) >= 1000:
            newest[body] = max(newest.get(body, -1), r["page_id"])
    out = []
    for r in rows:
        body = (r["html"] or "").encode()
        target = newest.get(body, r["page_id"])
        again = target != r["page_id"]
        out.append((r["page_id"], len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response",
                    target if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    given = pages(spark).repartition(3)
    write_warc(given, f"{tmp_path}/w", records_per_file=2)
    read = read_warc(spark, f"{tmp_path}/w")
    assert read.filter(F.col("problem").isNotNull()).count() == 0
    assert sorted(map(tuple, page_records(read).collect()), key=str) == expected(pages(spark).collect())
    bodies = {r["record_id"]: r["payload"] for r in read.collect()}
    assert bytes(bodies["<urn:x-page:8>"]) == "WARC/1.1\r\nÀ\r\n\r\n\x1f\u008b".encode()
    assert bodies["<urn:x-page:1>"] is None
    for path in (tmp_path / "w").glob("part-*"):  # plain gzip readers agree
        assert gzip.GzipFile(fileobj=io.BytesIO(path.read_bytes())).read().startswith(b"WARC/1.1\r\n")


def test_one_page_id_with_several_payloads(spark, tmp_path):
    other = "<b>" + "z" * 1500
    rows = [(1, BIG), (1, other), (1, "q" * 1200), (1, "small"), (2, BIG), (3, other), (3, other)]
    given = spark.createDataFrame([(k, "u", h) for k, h in rows], "page_id long, url string, html string")
    write_warc(given, f"{tmp_path}/w")
    read = read_warc(spark, f"{tmp_path}/w")
    assert sorted(map(tuple, page_records(read).collect()), key=str) == expected(given.collect())
    assert {bytes(r["payload"]) for r in read.collect() if r["payload"]} == {h.encode() for _, h in rows}


def test_empty_table_and_empty_file(spark, tmp_path):
    write_warc(pages(spark).limit(0), f"{tmp_path}/none")
    (tmp_path / "none" / "empty.warc").write_bytes(b"")
    assert read_warc(spark, f"{tmp_path}/none").count() == 0


def records(n):
    return [build_record(i, f"http://x/{i}", f"payload {i} ".encode() * 40, None, DATE) for i in range(n)]


def salvaged(data):
    reader = Salvage(data)
    return [r[1]["warc-record-id"] for r in reader.records()], reader.gaps


def names(*numbers):
    return [f"<urn:x-page:{i}>" for i in numbers]


def test_salvage_of_gzip_members():
    members = [gzip_member(r) for r in records(5)]
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 0xFF
    data = members[0] + bytes(broken) + members[2] + members[3][:-30] + members[4]
    found, gaps = salvaged(data)
    assert found == names(0, 2, 4)
    a, b = len(members[0]), len(members[0]) + len(broken)
    assert gaps[0][:2] == (a, b)
    assert gaps[1][:2] == (b + len(members[2]), len(data) - len(members[4]))
    assert salvaged(data[:-5])[1][-1][1] == len(data) - 5  # a cut end is a gap


def test_salvage_of_plain_records():
    plain = records(5)
    wrong = plain[1].replace(b"payload 1 payload", b"payload 1 pAyload", 1)
    short = plain[3][:-60]
    data = b"junk" + plain[0] + wrong + plain[2] + short + plain[4]
    found, gaps = salvaged(data)
    assert found == names(0, 2, 4)
    assert gaps[0][:2] == (0, 4)
    assert [g[2] for g in gaps][1] == "block digest differs"
    assert len(gaps) == 3


def test_salvage_inside_a_member(monkeypatch):
    plain = records(40)
    wrong = plain[7].replace(b"payload 7 payload", b"payload 7 pAyload", 1)
    sound = gzip_member(b"".join([*plain[:7], wrong, b"junk", *plain[8:]]))
    for piece in (1 << 20, 700):
        monkeypatch.setattr(warc, "PIECE", piece)
        monkeypatch.setattr(warc, "HELD", piece)
        found, gaps = salvaged(sound + gzip_member(plain[0]))
        assert found == names(*range(7), *range(8, 40), 0)
        assert len(gaps) == 1 and gaps[0][:2] == (0, len(sound)) and "block digest differs" in gaps[0][2]
        whole = gzip_member(b"".join(plain))
        found, gaps = salvaged(whole[:-8] + b"\0" * 8 + gzip_member(plain[0]))  # wrong checksum
        assert found == names(*range(40), 0) and [g[:2] for g in gaps] == [(0, len(whole))]
        found, gaps = salvaged(whole[: len(whole) * 3 // 4])  # cut end
        assert 20 < len(found) < 40 and found == names(*range(len(found)))
        assert [g[:2] for g in gaps] == [(0, len(whole) * 3 // 4)]


def test_records_longer_than_a_piece(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 1000)
    long = [build_record(i, "u", random.Random(i).randbytes(30_000), None, DATE) for i in range(3)]
    found, gaps = salvaged(gzip_member(b"".join(long)))
    assert found == names(0, 1, 2) and not gaps


def test_mixed_and_foreign_archives():
    foreign = b"WARC/1.0\nnot a header\r\n\r\n" + b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    reader = Salvage(gzip_member(records(1)[0]) + foreign + records(2)[1])
    found = list(reader.records())
    assert [r[1].get("warc-type") for r in found] == ["response", "metadata", "response"]
    assert len(reader.gaps) == 1


def test_gaps_are_logged_as_rows(spark, tmp_path):
    plain = records(3)
    (tmp_path / "a.warc").write_bytes(plain[0] + b"\x00garbage" + plain[1] + plain[2][:-9])
    rows = read_warc(spark, str(tmp_path)).orderBy("offset").collect()
    assert [r["problem"] is None for r in rows] == [True, False, True, False]
    assert rows[1]["gap_end"] - rows[1]["offset"] == len(b"garbage")


def test_wrong_payload_digest_is_quarantined(spark, tmp_path):
    body = records(1)[0]
    line = next(part for part in body.split(b"\r\n") if part.startswith(b"WARC-Payload-Digest"))
    (tmp_path / "b.warc").write_bytes(body.replace(line, b"WARC-Payload-Digest: sha1:" + b"A" * 32))
    assert [r["problem"] for r in read_warc(spark, str(tmp_path)).collect()] == ["payload digest differs"]
    row = read_warc(spark, str(tmp_path)).first()
    assert (row["offset"], row["gap_end"]) == (0, (tmp_path / "b.warc").stat().st_size)
