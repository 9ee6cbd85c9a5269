import json

import pytest

from plenaria.operators import quality
from plenaria.sources import acquire as A

DATA = bytes(range(256)) * 40


def server(mode="range", fail=()):
    calls, fails = [], list(fail)

    def opener(url, first, last):
        calls.append((first, last))
        if fails and fails[0] == (first, last):
            fails.pop(0)
            return 206, {"content-range": f"bytes {first}-{last}/{len(DATA)}"}, DATA[first:last]
        if mode == "plain" or first is None:
            return 200, {"content-length": str(len(DATA)), "content-type": "x/y"}, DATA
        if mode == "unknown":
            return 206, {"content-range": f"bytes {first}-{last}/*"}, DATA[:1]
        return 206, {"content-range": f"bytes {first}-{last}/{len(DATA)}", "content-type": "x/y"}, DATA[first : last + 1]

    return opener, calls


@pytest.mark.parametrize("mode", ["range", "plain", "unknown"])
def test_download(tmp_path, mode):
    opener, _ = server(mode)
    entry = A.download("http://x/a?token=1&b=2#f", tmp_path / "d" / "a.bin", opener, tmp_path / "m.jsonl", lambda s: None, piece=1000)
    assert (tmp_path / "d" / "a.bin").read_bytes() == DATA and entry["bytes"] == len(DATA) and entry["source_url"] == "http://x/a?b=2"
    assert [json.loads(x)["sha256"] for x in open(tmp_path / "m.jsonl")] == [entry["sha256"]] and not list(tmp_path.glob("d/*.tmp"))


def test_a_piece_is_asked_for_again(tmp_path):
    opener, calls = server(fail=[(2000, 2999)])
    A.download("u", tmp_path / "a", opener, tmp_path / "m", lambda s: None, piece=1000)
    assert calls.count((2000, 2999)) == 2 and calls.count((1000, 1999)) == 1 and (tmp_path / "a").read_bytes() == DATA
    opener, _ = server(fail=[(0, 0)] * 9 + [(0, 999)] * 99)
    with pytest.raises(OSError):
        A.download("u", tmp_path / "b", lambda *a: (500, {}, b""), tmp_path / "m", lambda s: None)
    assert not (tmp_path / "b").exists() and not (tmp_path / "b.tmp").exists()
    assert A.content_range("bytes 0-9/10") == (0, 9, 10) and A.content_range("bytes 0-0/*") is None and A.content_range(None) is None


def test_searches():
    for n in (1, 2, 3, 7, 8, 100):
        assert A.last_member(lambda k, n=n: k <= n) == n
    with pytest.raises(ValueError):
        A.last_member(lambda k: True)
    years = [2013, 2013, 2018, 2018, 2020]
    assert A.first_member(lambda k: years[k - 1], 2018, 5) == 3 and A.first_member(lambda k: years[k - 1], 2030, 5) == 6


def test_fetch_missing(spark):
    wanted = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("c", "bad")], "path string, url string")

    def get(url, path):
        if url == "bad":
            raise OSError("gone")
        return {"sha256": url}

    got = A.fetch_missing(wanted, spark.createDataFrame([("a",)], "path string"), get).collect()
    assert sorted(map(tuple, got)) == [("b", True, "u2"), ("c", False, "gone")]


def test_sources_of(spark):
    members = spark.createDataFrame([("xml/U1.xml", b"x"), ("xml/other.xml", b"... ID77 ...")], "member string, content binary")
    records = spark.createDataFrame([("a", "U1:5"), ("b", "ID77"), ("c", "none"), ("d", None)], "key string, source_identifier string")
    assert {r.key: r.member for r in A.sources_of(records, members).collect()} == {"a": "xml/U1.xml", "b": "xml/other.xml"}


def test_statement_coverage(spark):
    days = spark.createDataFrame([(10, 1, f"2024-01-{d}") for d in range(16, 20)] + [(10, 2, "2024-02-01")], "term int, proceeding int, day string")
    documents = {"2024-01-16": '{"statements": [{"num": 1}, {"num": 2, "unspoken": true}, {"num": "x"}, {"num": "3"}, 7, {}]}', "2024-01-17": '{"statements": {"a": 1}}', "2024-01-18": "no json", "2024-01-19": '{"other": []}'}
    metadata = spark.createDataFrame([(10, 1, d, t) for d, t in documents.items()], "term int, proceeding int, day string, document string")
    bodies = spark.createDataFrame([(10, 1, "2024-01-16", 1)], "term int, proceeding int, day string, num int")
    report, missing = quality.statement_coverage(days, metadata, bodies, spark.createDataFrame([(9,), (10,)], "term int"))
    (r,) = report.collect()
    assert (r.proceedings, r.target_dates, r.expected_spoken_bodies, r.statement_body_files, r.statement_metadata_files) == (2, 5, 4, 1, 4)
    assert sorted(((m.day or "")[8:], m.num or 0, m.reason) for m in missing.collect()) == [
        ("", 0, "proceedings index missing"), ("01", 0, "statement metadata missing"), ("16", 0, "invalid statement number"), ("16", 0, "invalid statement number"), ("16", 0, "statement metadata is not an object"),
        ("16", 3, "spoken statement body missing"), ("17", 0, "statement list is not an array"), ("18", 0, "invalid statement metadata"), ("19", 0, "invalid statement metadata"),
    ]
    assert [tuple(x) for x in quality.progress(days, bodies).collect()] == [(10, 1, 5)]


def test_one_address(spark):
    df = spark.createDataFrame([("a", "u"), ("a", "u"), ("b", "v")], "name string, url string")
    assert quality.one_address(df).count() == 2
    with pytest.raises(Exception, match="two addresses for a"):
        quality.one_address(df.unionByName(spark.createDataFrame([("a", "w")], df.schema))).collect()
