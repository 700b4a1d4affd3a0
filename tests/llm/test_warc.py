import gzip
import hashlib

from winsyn.llm.warc import _gzip, _record, op2_warc, read_archives, salvage


def test_round_trip(spark, tmp_path):
    big, other = "b" * 1200, "é" * 600
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, "u", other), (8, "u", big + "x"), (9, "u", "WARC/1.1\r\nx\r\n\r\n" * 100), (9, "u", "z" * 2000), (9, "u", "z" * 2000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in op2_warc(spark, str(tmp_path)).collect())
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = max(j for j, _, x in rows if (x or "").encode() == b)
        again = len(b) >= 1000 and i < first
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert [tuple(map(str, g)) for g in got] == [tuple(map(str, w)) for w in sorted(want, key=lambda w: tuple(w[:4]))]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert op2_warc(spark, str(tmp_path)).count() == 0


def test_salvage(spark, tmp_path):
    body = [b"first " * 50, b"second" * 50, b"third WARC/1.1\r\n" * 9, b"fourth" * 50]
    plain = [_record("response", i, "http://x", b, len(b), hashlib.sha1(b).hexdigest(), None) for i, b in enumerate(body)]
    zipped = [_gzip(p) for p in plain]
    whole = b"".join(zipped)
    assert [k for k, *_ in salvage(whole)] == ["record"] * 4
    assert b"".join(gzip.decompress(z) for z in zipped) == b"".join(plain)
    # a byte of the second member flipped; junk before the fourth, which is cut short
    hurt = bytearray(zipped[1])
    hurt[len(hurt) // 2] ^= 0xFF
    data = zipped[0] + bytes(hurt) + plain[2] + b"junk \x1f\x8b\x08 junk" + zipped[3][:-3]
    found = list(salvage(data))
    assert [f[0] for f in found] == ["record", "gap", "record", "gap"]
    assert [f[4] for f in found if f[0] == "record"] == [body[0], body[2]]
    assert [f[1] for f in found] == [0, *[f[2] for f in found[:-1]]] and found[-1][2] == len(data)
    # a wrong length in a plain record
    data = plain[0] + plain[1].replace(b"Content-Length: 300", b"Content-Length: 999") + plain[3]
    assert [f[0] for f in salvage(data)] == ["record", "gap", "record"]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.warc.gz").write_bytes(zipped[0] + bytes(hurt) + zipped[3])
    assert sorted((r.kind, r.at) for r in read_archives(spark, str(tmp_path / "w")).collect()) == [("gap", len(zipped[0])), ("record", 0), ("record", len(zipped[0]) + len(hurt))]
