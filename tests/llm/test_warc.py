import base64
import gzip
import hashlib
import os
import re
from pathlib import Path

import duckdb
import pytest

from glyphflow.llm import warc
from glyphflow.sources.store import PENDING, Pending

SMALL = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, row long, shard int, payload string"


def pages(spark, n=80):
    body = lambda i: f"<p>{'ünï' * (i % 13)} {i % 7}</p>" * (i % 5)
    rows = [(i, f"https://h{i % 3}.org/{i} é", body(i)) for i in range(n)] + [(900, None, None), (901, "", ""), (902, "a\r\nWARC-Type: x", "long " * 60_000), (903, "http://x/", "a\r\n\r\nb")]
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(5), rows


def expected(rows, min_bytes=0):
    first = {}
    for page, _, html in sorted(rows, key=lambda r: r[0]):
        first.setdefault((html or "").encode(), page)
    out = {}
    for page, _, html in rows:
        data = (html or "").encode()
        of = first[data] if first[data] != page and len(data) >= min_bytes else None
        out[page] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if of is None else "revisit", of)
    return out


def found(df):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()}


def files(folder):
    return {p.name: p.read_bytes() for p in Path(folder).glob("*.warc.gz")}


@pytest.mark.parametrize("min_bytes", [0, 30])
def test_round_trip(spark, tmp_path, min_bytes):
    df, rows = pages(spark)
    folder = f"{tmp_path}/a"
    manifest = warc.write_warc(df, folder, min_bytes=min_bytes, shard_bytes=20_000, file_bytes=1500).collect()
    got = warc.read_warc(spark, folder)
    assert found(got) == expected(rows, min_bytes)
    payload = {page: (html or "").encode() for page, _, html in rows}
    assert all(r.payload is None if r.record_type == "revisit" else bytes(r.payload) == payload[r.page_id] for r in got.collect())
    urls = {r.page_id: r.url for r in got.collect()}
    assert urls[900] is None and urls[901] == "" and urls[902] == "a%0D%0AWARC-Type:%20x" and urls[1] == "https://h1.org/1%20é"
    written = files(folder)
    assert {m.file: (m.n_bytes, m.sha256) for m in manifest} == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in written.items()}
    assert len({m.shard for m in manifest}) > 3 and len(manifest) > len({m.shard for m in manifest})
    assert not (tmp_path / "a" / PENDING).exists()


def test_other_programs_can_read_it(spark, tmp_path):
    """An independent reading of the standard: unpacked whole, cut by Content-Length."""
    df, rows = pages(spark)
    warc.write_warc(df, f"{tmp_path}/a", shard_bytes=30_000, file_bytes=4000).collect()
    order, ids, refers = [], {}, {}
    for name, data in sorted(files(f"{tmp_path}/a").items()):
        plain, at, seen = gzip.decompress(data), 0, 0
        while at < len(plain):
            head_end = plain.index(b"\r\n\r\n", at)
            head = dict(x.split(": ", 1) for x in plain[at:head_end].decode().split("\r\n")[1:])
            assert plain[at : at + 10] == b"WARC/1.1\r\n"
            n = int(head["Content-Length"])
            block = plain[head_end + 4 : head_end + 4 + n]
            at = head_end + 8 + n
            assert plain[at - 4 : at] == b"\r\n\r\n"
            if not seen:
                assert head["WARC-Type"] == "warcinfo" and head["WARC-Filename"] == name
            else:
                assert head["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
                assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", head["WARC-Record-ID"])
                page = int(head["X-Page-ID"])
                order.append(page)
                ids[head["WARC-Record-ID"]] = page
                if "WARC-Refers-To" in head:
                    refers[page] = head["WARC-Refers-To"]
                http, _, payload = block.partition(b"\r\n\r\n")
                assert http.startswith(b"HTTP/1.1 200 OK\r\n")
                if head["WARC-Type"] == "response":
                    assert f"Content-Length: {len(payload)}".encode() in http
            seen += 1
    assert order == sorted(r[0] for r in rows) and len(ids) == len(rows)
    assert {p: ids[i] for p, i in refers.items()} == {p: v[3] for p, v in expected(rows).items() if v[3] is not None}


def test_the_same_bytes_from_other_partitions(spark, tmp_path):
    df, _ = pages(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for i, (k, n) in enumerate([(1, 3), (7, 11)]):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            warc.write_warc(df.repartition(k), f"{tmp_path}/{i}", shard_bytes=20_000, file_bytes=3000).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert files(f"{tmp_path}/0") == files(f"{tmp_path}/1") and len(files(f"{tmp_path}/0")) > 8


def test_what_a_dead_attempt_left_is_not_read(spark, tmp_path):
    df, rows = pages(spark, 20)
    folder = f"{tmp_path}/a"
    left = Pending(folder, "part-00000-00000.warc.gz")  # died before the commit
    left.write(b"half a record")
    left.stream.close()
    died = Pending(folder, "part-00077-00000.warc.gz")  # died after it, the job was never finished
    died.write(b"not in any manifest")
    died.commit()
    warc.write_warc(df, folder).collect()
    assert found(warc.read_warc(spark, folder)) == expected(rows)
    with pytest.raises(Exception, match="exists"):
        warc.write_warc(df, folder)


def test_damage_is_an_error(spark, tmp_path):
    df, _ = pages(spark, 20)
    folder = f"{tmp_path}/a"
    manifest = warc.write_warc(df, folder, shard_bytes=5_000).collect()
    path = Path(folder, manifest[0].file)
    whole = path.read_bytes()
    path.write_bytes(whole[:-40])
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(spark, folder).collect()
    fields = {"warc-block-digest": "sha1:X", "warc-record-id": "i"}
    with pytest.raises(ValueError, match="block digest"):
        warc.page_of(fields, b"", True)


def test_rows_without_an_id_and_repeated_ones(spark, tmp_path):
    rows = [(None, "u", "same"), (None, "v", "same"), (3, "w", "same"), (3, "w", "same"), (3, "x", "other"), (None, "u", "lone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(df, f"{tmp_path}/a").collect()
    got = sorted(((r.page_id, r.url, r.record_type, r.refers_to) for r in warc.read_warc(spark, f"{tmp_path}/a").collect()), key=str)
    assert got == sorted([(3, "w", "response", None), (3, "w", "revisit", 3), (3, "x", "response", None), (None, "u", "revisit", 3), (None, "v", "revisit", 3), (None, "u", "response", None)], key=str)


def test_empty(spark, tmp_path):
    df, _ = pages(spark, 3)
    assert warc.write_warc(df.where("false"), f"{tmp_path}/a").count() == 0
    assert warc.read_warc(spark, f"{tmp_path}/a").count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_query(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    expected = {r[0]: r[1:] for r in con.sql(warc.ORACLE).fetchall()}
    assert found(warc.op11_warc(spark, SMALL)) == expected and len(expected) == 50
