"""Files as tables: JSON lines, CSV and XML inside of ZIP archives, raw file inventories, and an invented corpus."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plenaria import schema
from plenaria.functions.countries import COUNTRIES
from plenaria.functions.text import word_count
from plenaria.runtime import cut

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str | list[str], ddl: str = schema.SPEECH_DDL, strict: bool = True) -> DataFrame:
    """JSON lines with a fixed schema. Blank lines are skipped and unknown keys dropped; a line that is no JSON object is an
    error when it is read (with its text), or a row with _corrupt_record if not strict. Missing strings of speeches are ''."""
    raw = spark.read.schema(f"{ddl}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    if strict:
        bad = F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring(CORRUPT, 1, 200))).cast("boolean")
        # a filter: no projection can drop it
        raw = raw.where(F.when(F.col(CORRUPT).isNotNull(), bad).otherwise(True)).drop(CORRUPT)
    return raw


def with_defaults(speeches: DataFrame) -> DataFrame:
    """Speeches with '' for null strings, 0 for a null word count, and raw_text and source_identifier from text and id."""
    filled = speeches.withColumns({c: F.coalesce(c, F.lit("")) for c, t in speeches.dtypes if t == "string"}).withColumn("word_count", F.coalesce("word_count", F.lit(0)))
    own = {"source_identifier": "speech_id", "raw_text": "speech_text"}
    return filled.withColumns({c: F.when(F.col(c) == "", F.col(d)).otherwise(F.col(c)) for c, d in own.items()})


def valid_speech() -> Column:
    """What a speech must be: all required fields, an ISO date, and a word count that is 0 or right."""
    from plenaria.functions.text import iso_date

    full = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit("")) != "" for c in schema.REQUIRED])
    count = F.coalesce("word_count", F.lit(0))
    return full & iso_date(F.col("date")).isNotNull() & ((count == 0) | (count == word_count(F.col("speech_text"))))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """position (from 1, blank lines not counted) and value of the lines of a file, or of a folder's files in order of their names.

    The lines are written down with the file and offset of their split, so that counting and numbering see the same splits;
    positions are dense by the sizes of the splits before.
    """
    place = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s")]
    lines = cut(spark.read.text(path).select("value", *place).where("trim(value) <> ''").withColumn("_i", F.monotonically_increasing_id()))
    sizes = lines.groupBy("_f", "_s").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_least"))
    # one row a split, whatever the lines
    before = F.sum("_n").over(Window.orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_f", "_s", "_least", F.coalesce(before, F.lit(0)).alias("_before"))
    return lines.join(starts, ["_f", "_s"]).select((F.col("_before") + F.col("_i") - F.col("_least") + 1).alias("position"), "value")


def raw_files(spark: SparkSession, path: str, pattern: str = "*", with_content: bool = True) -> DataFrame:
    """path, bytes, modified (and content) of all files below a folder, without place holders and unfinished ones."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    kept = found.where(~F.col("path").rlike(r"(^|/)\.gitkeep$|\.tmp$"))
    columns = ["path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")]
    return kept.select(*columns, "content") if with_content else kept.select(*columns)


def file_digests(files: DataFrame) -> DataFrame:
    """files with sha256 and md5 of their content, without the content."""
    return files.withColumns({"sha256": F.sha2("content", 256), "md5": F.md5("content")}).drop("content")


def verified(files: DataFrame, known: DataFrame) -> DataFrame:
    """name, ok of files (name, content) against known SHA-256 or MD5 digests (name, digest)."""
    own = F.when(F.length("digest") == 64, F.col("_sha")).otherwise(F.col("_md5"))
    digests = files.select("name", F.sha2("content", 256).alias("_sha"), F.md5("content").alias("_md5"))
    return digests.join(known, "name").select("name", (own == F.lower("digest")).alias("ok"))


def zip_members(archives: DataFrame, pattern: str = "") -> DataFrame:
    """path, member, content of the members of ZIP archives (path, content) whose name has the pattern (a regular expression).

    A member is handed on as soon as it is read, so a task holds one archive and one member.
    """

    def run(batches):
        import re

        for batch in batches:
            for row in batch.to_pylist():
                with zipfile.ZipFile(io.BytesIO(row["content"])) as archive:
                    for info in archive.infolist():
                        if not info.is_dir() and re.search(pattern, info.filename, re.I):
                            yield pa.RecordBatch.from_pylist([{"path": row["path"], "member": info.filename, "content": archive.read(info)}], schema=pa.schema([("path", pa.string()), ("member", pa.string()), ("content", pa.binary())]))

    return archives.select("path", "content").mapInArrow(run, "path string, member string, content binary")


# Columns of the published speech table that are read.
SPEECH_CSV = (
    "wahlperiode", "sitzung_nr", "sitzung_datum", "sitzung_jahr", "rede_id", "rede_text", "redner_id", "redner_titel", "redner_vorname", "redner_nachname",
    "redner_namenszusatz", "redner_ortszusatz", "redner_fraktion", "redner_rolle_kurz", "redner_rolle_lang",
)


def csv_rows(members: DataFrame, columns: tuple[str, ...] = SPEECH_CSV, rows: int = 2000) -> DataFrame:
    """The named columns of CSV files with a header (content), as strings; 'NA' and '' are null, missing columns too."""
    shape = pa.schema([(c, pa.string()) for c in columns])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                waiting = []
                csv.field_size_limit(1 << 30)
                for record in csv.DictReader(io.TextIOWrapper(io.BytesIO(row["content"]), "utf-8", newline="")):
                    waiting.append({c: None if record.get(c) in (None, "", "NA") else record[c] for c in columns})
                    if len(waiting) == rows:
                        yield pa.RecordBatch.from_pylist(waiting, schema=shape)
                        waiting = []
                if waiting:
                    yield pa.RecordBatch.from_pylist(waiting, schema=shape)

    return members.select("content").mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))


def german_table(rows: DataFrame, doi: str, years: tuple[int, int] = (2018, 2026)) -> DataFrame:
    """Speeches of the published German speech table. Rows without text or id, or of other years, are left out; a number that
    is none is an error."""
    n = lambda c: F.col(c).cast("int")
    kept = rows.where(n("sitzung_jahr").between(*years) & (F.trim("rede_text") != "") & F.col("rede_id").isNotNull())
    name = F.concat_ws(" ", "redner_titel", "redner_vorname", "redner_nachname", "redner_namenszusatz", "redner_ortszusatz")
    made = {
        "country": F.lit("Germany"), "parliament": F.lit("Bundestag"), "chamber": F.lit("Bundestag"), "date": F.date_format(F.to_date("sitzung_datum", "yyyy-MM-dd"), "yyyy-MM-dd"),
        "session_id": F.format_string("bundestag-%d-%d", n("wahlperiode"), n("sitzung_nr")), "speech_id": F.col("rede_id"), "speaker_id": F.col("redner_id"),
        "speaker_name": F.when(name == "", "Unknown speaker").otherwise(name), "speech_text": F.trim("rede_text"), "raw_text": F.trim("rede_text"),
        "source_url": F.concat(F.lit(f"https://doi.org/{doi}#"), "rede_id"), "party": F.col("redner_fraktion"), "speaker_role": F.coalesce("redner_rolle_lang", "redner_rolle_kurz"),
        "legislative_term": n("wahlperiode").cast("string"), "source_type": F.lit("cpp_bt_cc0_speech_csv"), "source_identifier": F.col("rede_id"), "text_language": F.lit("de"),
        "word_count": word_count(F.col("rede_text")),
    }
    return kept.select(*[F.coalesce(made[c], F.lit("")).alias(c) if c in made and c != "word_count" else made[c].alias(c) if c in made else F.lit("").alias(c) for c in schema.SPEECH_COLUMNS])


def json_documents(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Whole JSON documents (arrays are opened) with a fixed schema."""
    return spark.read.schema(ddl).option("multiLine", "true").json(path)


def sitting_days(proceedings: DataFrame, cutoff: str, years: tuple[int, int] = (2018, 2026)) -> DataFrame:
    """number, day of real proceedings (number, dates) up to the cutoff day."""
    days = proceedings.where("number > 0").select("number", F.explode("dates").alias("text")).withColumn("day", F.try_to_date("text", "yyyy-MM-dd"))
    return days.where(F.year("day").between(*years) & (F.col("day") <= F.lit(cutoff).cast("date"))).select("number", "day")


def mock_corpus(spark: SparkSession) -> DataFrame:
    """An invented corpus of 6 countries, 2 years and 3 months of 59 words each."""
    text = " ".join(["This is an invented parliamentary speech that only tests the whole run."] * 5)
    text = " ".join(text.split()[:59])
    each = lambda name, values: F.explode(F.array(*map(F.lit, values))).alias(name)
    grid = spark.range(1).select(each("country", COUNTRIES)).select("country", each("y", (2019, 2024))).select("country", "y", each("m", (2, 6, 10)))
    identity = F.format_string("mock-%s-%d-%02d", F.lower("country"), F.col("y"), F.col("m"))
    house = F.create_map(*[F.lit(x) for pair in schema.PARLIAMENT.items() for x in pair])[F.col("country")]
    language = F.create_map(*[F.lit(x) for pair in schema.LANGUAGE.items() for x in pair])[F.col("country")]
    made = {
        "parliament": house, "chamber": house, "date": F.format_string("%d-%02d-15", F.col("y"), F.col("m")), "session_id": F.concat(F.lit("session-"), identity), "speech_id": identity,
        "speaker_id": F.lit("mock-speaker"), "speaker_name": F.lit("Mock speaker"), "speech_text": F.lit(text), "raw_text": F.lit(text), "source_url": F.lit("https://example.invalid/mock"),
        "party": F.lit("Mock party"), "speaker_role": F.lit("member"), "legislative_term": F.lit("mock"), "source_type": F.lit("mock"), "source_identifier": identity, "text_language": language,
    }
    return grid.select(*[F.col(c) if c == "country" else made[c].alias(c) if c in made else word_count(F.lit(text)).alias(c) if c == "word_count" else F.lit("").alias(c) for c in schema.SPEECH_COLUMNS])


def load_settings(text: str) -> dict[str, str]:
    """Key and value lines; blank ones, comments and an `export` before the key are skipped, quotes around a value dropped."""
    out = {}
    for line in map(str.strip, text.splitlines()):
        key, mark, value = line.removeprefix("export ").partition("=")
        if mark and not line.startswith("#"):
            value = value.strip()
            out[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def json_string(text: Column) -> Column:
    """A string as JSON has it: quotes, backslashes and control characters escaped, all else as it is."""
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = plain
    for c in range(32):
        escaped = F.replace(escaped, F.lit(chr(c)), F.lit(short.get(c, f"\\u{c:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), escaped).otherwise(plain), F.lit('"'))


def fingerprints(configuration: dict, text: Column) -> Column:
    """request_fingerprint of a column of texts; null for null."""
    head = json.dumps(configuration, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return F.sha2(F.concat(F.lit(f'{{"configuration":{head},"text":'), json_string(text), F.lit("}")), 256)


def request_fingerprint(configuration: dict, text: str) -> str:
    """SHA-256 of the compact sorted JSON of a request."""
    import hashlib

    return hashlib.sha256(json.dumps({"configuration": configuration, "text": text}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
