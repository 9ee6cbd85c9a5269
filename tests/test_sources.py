import hashlib
import io
import json
import sys
import zipfile

import pytest
from pyspark import cloudpickle

from plenaria.plans import outputs
from plenaria.sources import files, paged

CSV = """doc_id,wahlperiode,sitzung_nr,sitzung_datum,sitzung_jahr,rede_id,rede_text,redner_id,redner_titel,redner_vorname,redner_nachname,redner_fraktion,redner_rolle_kurz,redner_rolle_lang
1,19,1,2019-10-24,2019,ID1900100100,"Guten Tag, liebe
Kollegen",11,Dr.,Erika,Example,NA,,NA
2,19,1,2019-10-24,2019,ID2,,12,,Max,Muster,SPD,,
3,17,1,2010-10-24,2010,ID3,alt,12,,Max,Muster,SPD,,
"""


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"speech_id": "a", "word_count": 2, "extra": 1}\n\n{"speech_id": "b", "speech_text": "Grüße"}\n')
    got = files.with_defaults(files.read_jsonl(spark, str(path))).orderBy("speech_id").collect()
    assert [(r.speech_id, r.word_count, r.raw_text, r.source_identifier, r.party) for r in got] == [("a", 2, "", "a", ""), ("b", 0, "Grüße", "b", "")]
    path.write_text('{"speech_id": "a"}\n[1]\n')
    with pytest.raises(Exception, match="not a JSON object"):
        files.read_jsonl(spark, str(path)).select("speech_id").collect()
    assert sum(r._corrupt_record is not None for r in files.read_jsonl(spark, str(path), strict=False).collect()) == 1
    df = files.mock_corpus(spark)
    outputs.write_jsonl(df, str(tmp_path / "m.jsonl"))
    assert sorted(files.read_jsonl(spark, str(tmp_path / "m.jsonl")).collect()) == sorted(df.collect())


def test_validity(spark):
    df = files.mock_corpus(spark)
    assert df.count() == 36 == df.where(files.valid_speech()).count() and df.where("word_count <> 59").count() == 0
    assert df.withColumn("date", df.date[1:4] if False else df.country).where(files.valid_speech()).count() == 0


def test_positions_are_dense(spark, tmp_path):
    path = tmp_path / "lines"
    path.write_text("".join(f"line {k}\n\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = files.numbered(spark, str(path)).orderBy("position").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.position for r in got] == list(range(1, 5001)) and {int(r.value.split()[1]) for r in got} == set(range(5000))


def test_german_table_in_an_archive(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(archive(x_dot_csv=CSV, y_dot_txt="no"))
    (tmp_path / ".gitkeep").write_text("")
    (tmp_path / "b.tmp").write_text("")
    found = files.raw_files(spark, str(tmp_path))
    assert found.count() == 1
    members = files.zip_members(found, r"\.csv$")
    (r,) = files.german_table(files.csv_rows(members), "10.1/x").collect()
    assert (r.speech_id, r.speaker_name, r.party, r.date, r.word_count, r.session_id) == ("ID1900100100", "Dr. Erika Example", "", "2019-10-24", 4, "bundestag-19-1")
    digest = files.file_digests(found).first()
    assert digest.sha256 == hashlib.sha256((tmp_path / "a.zip").read_bytes()).hexdigest() and digest.md5 == hashlib.md5((tmp_path / "a.zip").read_bytes()).hexdigest()
    known = spark.createDataFrame([("a", digest.md5), ("b", digest.sha256), ("c", "0" * 64)], "name string, digest string")
    from pyspark.sql import functions as F

    rows = found.select(F.explode(F.array(*map(F.lit, "abc"))).alias("name"), "content")
    assert {r.name: r.ok for r in files.verified(rows, known).collect()} == {"a": True, "b": True, "c": False}


def test_json_documents_and_days(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"number": 0, "dates": ["2024-01-01"]}, {"number": 3, "dates": ["2024-01-16", "2099-01-01", "x"]}], indent=1))
    df = files.json_documents(spark, str(tmp_path / "p.json"), "number int, dates array<string>")
    assert [(r.number, str(r.day)) for r in files.sitting_days(df, "2024-12-31").collect()] == [(3, "2024-01-16")]


def test_settings_and_fingerprints():
    assert files.load_settings("# c\nA = 1\nexport B='x=y'\nbroken\n") == {"A": "1", "B": "x=y"}
    a = files.request_fingerprint({"b": 1, "a": 2}, "é")
    assert a == files.request_fingerprint({"a": 2, "b": 1}, "é") == hashlib.sha256('{"configuration":{"a":2,"b":1},"text":"é"}'.encode()).hexdigest()


def pages(url):
    if "broken" in url:
        return b"{}"
    if "next" in url:
        return json.dumps({"value": [{"Id": 3}]}).encode()
    if "loop" in url:
        return json.dumps({"value": [], "@odata.nextLink": url}).encode()
    if "skip" in url:
        return json.dumps({"value": [{"Id": 2}]}).encode()
    if "top" in url:
        return json.dumps({"value": [{"Id": 0}, {"Id": 1}]}).encode()
    return json.dumps({"value": [{"Id": 1}], "@odata.nextLink": "http://x/next"}).encode()


def test_paged_sources(spark):
    assert [e["Id"] for e in paged.odata_pages("http://x/a", pages)] == [1, 3]
    assert [e["Id"] for e in paged.odata_pages("http://x/a?%24top=2", pages)] == [0, 1, 2]
    for bad in ("http://x/loop", "http://x/broken"):
        with pytest.raises(ValueError):
            list(paged.odata_pages(bad, pages))
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(paged.ODataSource.named("meetings", pages))
    got = spark.read.format("meetings").option("urls", "http://x/a\nhttp://x/a?%24top=2").load().collect()
    assert sorted(json.loads(r.value)["Id"] for r in got) == [0, 1, 1, 2, 3]
    lists = {0: [f"http://h/{k}.xml" for k in range(10)], 10: ["http://h/9.xml"]}
    find = lambda data: lists[int(data)]
    assert len(list(paged.offset_links("http://h/l", lambda u: u.rpartition("=")[2].encode(), find))) == 10
    lists[10] = ["http://other/9.xml"]
    with pytest.raises(ValueError):
        list(paged.offset_links("http://h/l", lambda u: u.rpartition("=")[2].encode(), find))


def test_retries():
    calls, waits = [], []

    class Error(OSError):
        def __init__(self, code):
            self.code = code

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise Error(503)
        return b"ok"

    assert paged.retrying(flaky, waits.append)("u") == b"ok" and waits == [1.0, 2.0]

    def gone(url):
        raise Error(404)

    with pytest.raises(Error):
        paged.retrying(gone, waits.append)("u")
