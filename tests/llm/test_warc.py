import gzip
import hashlib
import io

from sparlode.llm.queries import op7_warc
from sparlode.llm.warc import archives, build, deduplicate, deduplicate_pages, digest, header_list, members, parse, payload_of, read_index, response, revisit, spelled, write_pages


def records_of(path):
    out = []
    for p, _ in archives(path):
        with open(p, "rb") as f:
            out += [(p, at, n, *parse(c)) for at, n, c in members(f)]
    return out


def http(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + payload


def test_pages_to_archives(spark, tmp_path):
    pages = [(i, f"http://h/{i}", f"<p>{i % 7} é</p>" * (1 + i % 7)) for i in range(60)] + [(None, "http://null", "x" * 3_000_000), (60, None, None), (61, "http://empty", ""), (60, None, None)]
    df = spark.createDataFrame([(*p, "f") for p in pages], "page_id long, url string, html string, archive string").repartition(4)
    out = deduplicate_pages(spark, df, str(tmp_path / "new")).collect()
    assert len(out) == len(pages)
    found = records_of(str(tmp_path / "new"))
    assert len(found) == len(pages) and len({r[3]["warc-record-id"] for r in found}) == len(pages)
    by_id = {r[3]["warc-record-id"]: r for r in found}
    seen = {}
    for r in out:
        path, at, n, h, block = by_id[r["record_id"]]
        assert (r["offset"], r["length"], r["kind"], r["payload_digest"]) == (at, n, h["warc-type"], h["warc-payload-digest"])
        with open(path, "rb") as f:  # each record can be read alone
            f.seek(at)
            assert parse(gzip.decompress(f.read(n))) == (h, block)
        assert h["warc-block-digest"] == digest(block)
        if r["kind"] == "response":
            payload = payload_of(h, block)
            assert digest(payload) == r["payload_digest"] and len(payload) == r["payload_length"] and r["payload_digest"] not in seen
            seen[r["payload_digest"]] = r
    assert set(seen) == {digest((h or "").encode()) for _, _, h in pages}
    for r in out:
        if r["kind"] == "revisit":
            o = seen[r["payload_digest"]]
            assert (r["refers_to"], r["refers_to_uri"], r["refers_to_date"]) == (o["record_id"], o["uri"], o["date"])
            assert (o["date"] or "~") <= (r["date"] or "~")


def test_revisits_of_other_archives(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    one, sha1 = b"one" * 50, "sha1:"
    told = digest(one, sha1 + "A" * 32)
    assert told == "sha1:" + __import__("base64").b32encode(hashlib.sha1(one).digest()).decode()
    (src / "a.warc.gz").write_bytes(
        gzip.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Length: 4\r\n\r\ninfo\r\n\r\n")
        + revisit("<urn:r1>", "http://r1", "2020-01-02", told, ("<urn:gone>", "http://old", None), http(b""))
        + revisit("<urn:r2>", "http://r2", "2020-01-02", "sha1:UNKNOWN", ("<urn:gone>", "http://old", "2019-01-01"), http(b""))
    )
    (src / "b.warc.gz").write_bytes(response("<urn:1>", "http://later", "2020-02-01", told, http(one)) + response("<urn:2>", "http://first", "2020-01-01", told, http(one)) + response("<urn:3>", "http://two", "2020-01-01", digest(b"2"), http(b"2")) + b"\x1f\x8bcut off")
    plain = gzip.decompress(build([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:4>"), ("Content-Type", "text/plain")], b"plain\r\n\r\ntext"))
    (src / "c.warc").write_bytes(plain * 2)
    index = {r["record_id"]: r for r in read_index(spark, str(src)).collect()}
    assert set(index) - {None} == {"<urn:i>", "<urn:r1>", "<urn:r2>", "<urn:1>", "<urn:2>", "<urn:3>", "<urn:4>"} and index["<urn:i>"]["kind"] == "warcinfo"
    out = deduplicate(spark, str(src), str(tmp_path / "new")).collect()
    by = {(r["uri"], r["kind"]): r for r in out}
    first = by["http://first", "response"]
    assert by["http://later", "revisit"]["refers_to"] == first["record_id"] == by["http://r1", "revisit"]["refers_to"]
    assert by["http://r1", "revisit"]["refers_to_uri"] == "http://first"
    assert (by["http://r2", "revisit"]["refers_to"], by["http://r2", "revisit"]["refers_to_date"]) == ("<urn:gone>", "2019-01-01")
    assert [r["kind"] for r in out if r["archive"] == by[None, "resource"]["archive"]].count("resource") == 1
    assert index[None]["kind"] == "damaged" and [r["length"] for r in out if r["kind"] == "damaged"] == [9]
    kinds = sorted(r[3]["warc-type"] for r in records_of(str(tmp_path / "new")))
    assert kinds == ["resource", "response", "response", "revisit", "revisit", "revisit", "revisit", "warcinfo"]
    assert [payload_of(*r[3:]) for r in records_of(str(tmp_path / "new")) if r[3].get("warc-target-uri") == "http://first"] == [one]


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert deduplicate_pages(spark, none, str(tmp_path / "n")).collect() == [] and archives(str(tmp_path / "n")) == []
    assert list(members(io.BytesIO(b""))) == [] and list(members(io.BytesIO(b"junk"))) == [(0, 4, None)]


def test_archives_are_cut_by_size(spark, tmp_path):
    df = spark.createDataFrame([(i, "http://u", hashlib.sha512(str(i).encode()).hexdigest() * 20) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    write_pages(spark, df, str(tmp_path / "w"), archive_bytes=2000)
    assert len(archives(str(tmp_path / "w"))) > 3 and len(records_of(str(tmp_path / "w"))) == 40


def test_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    out = op7_warc(spark, sf).collect()
    assert sorted((r["uri"], r["payload_digest"]) for r in out) == sorted((p["url"], digest(p["html"].encode())) for p in pages)


def test_archives_of_one_name_and_a_damaged_record(spark, tmp_path):
    src = tmp_path / "src"
    made = {}
    for d in ("one", "two"):
        (src / d).mkdir(parents=True)
        records = [response(f"<urn:{d}{i}>", f"http://{d}/{i}", "2020-01-01", digest(x), http(x)) for i in range(5) if (x := f"{d} {i}".encode() * 200)]
        broken = bytearray(records[2])
        broken[40:60] = b"?" * 20
        made[d] = records[:2] + [bytes(broken)] + records[3:] + [records[4][: len(records[4]) // 2]]
        (src / d / "data.warc.gz").write_bytes(b"".join(made[d]))
    plain = b"".join(gzip.decompress(r) for r in made["one"][:2])
    (src / "plain.warc").write_bytes(plain[: len(plain) // 2 - 9] + plain[len(plain) // 2 :])
    out = deduplicate(spark, str(src), str(tmp_path / "new")).collect()
    assert len({r["archive"] for r in out}) == len(archives(str(tmp_path / "new"))) == 3
    kept = [r for r in out if r["kind"] != "damaged"]
    assert {r["uri"] for r in kept} == {f"http://{d}/{i}" for d in ("one", "two") for i in (0, 1, 3, 4)}
    lost = [r["length"] for r in out if r["kind"] == "damaged"]
    assert sorted(len(made[d][k]) for d in made for k in (2, 5)) == sorted(lost)[:4] and len(lost) == 5
    found = records_of(str(tmp_path / "new"))
    assert len(found) == len(kept)
    assert {r[3]["warc-target-uri"]: payload_of(*r[3:]) for r in found if r[3]["warc-type"] == "response"} == {f"http://{d}/{i}": f"{d} {i}".encode() * 200 for d in ("one", "two") for i in (0, 1, 3, 4)}


def test_digests_of_several_kinds_and_headers_that_stay(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    x = b"the same payload"
    sha1, hexed = digest(x, "sha1:" + "A" * 32), digest(x, "SHA-1:" + "a" * 40)
    assert spelled(sha1) == spelled(hexed) == "sha1:" + hashlib.sha1(x).hexdigest() and spelled("odd") == "odd" and spelled(None) is None and spelled("sha1:!") == "sha1:!"
    more = [("WARC-IP-Address", "10.0.0.1"), ("WARC-Concurrent-To", "<urn:a>"), ("WARC-Concurrent-To", "<urn:b>")]
    (src / "a.warc.gz").write_bytes(
        response("<urn:1>", "http://1", "2020-01-01", digest(x), http(x), more=more)
        + response("<urn:2>", "http://2", "2020-01-02", sha1, http(x), more=more)
        + revisit("<urn:3>", "http://3", "2020-01-03", hexed, ("<urn:gone>", None, None), http(b""))
        + build([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:4>"), ("WARC-Concurrent-To", "<urn:2>"), ("Content-Type", "application/http")], b"GET /")
    )
    out = {r["record_id"]: r for r in deduplicate(spark, str(src), str(tmp_path / "new")).collect()}
    assert {i: (r["kind"], r["refers_to"]) for i, r in out.items()} == {"<urn:1>": ("response", None), "<urn:2>": ("revisit", "<urn:1>"), "<urn:3>": ("revisit", "<urn:1>"), "<urn:4>": ("request", None)}
    for _, _, _, h, _ in records_of(str(tmp_path / "new")):
        if h["warc-record-id"] in ("<urn:1>", "<urn:2>"):
            assert h["warc-ip-address"] == "10.0.0.1"
    with open(archives(str(tmp_path / "new"))[0][0], "rb") as f:
        assert [v for _, _, c in members(f) for k, v in header_list(c) if k == "WARC-Concurrent-To"] == ["<urn:a>", "<urn:b>"] * 2 + ["<urn:2>"]
