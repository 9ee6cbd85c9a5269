"""Queries of the sources, sinks, builders and coverage operators, with their SQL: what the tables hold is written in the form of
a source, read back by its operator, and held against the tables."""

from __future__ import annotations

import csv
import hashlib
import io
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenaria import schema
from plenaria.functions.countries import CODES, COUNTRIES, country_name
from plenaria.functions.deliveries import first_delivery
from plenaria.functions.text import any_date
from plenaria.operators import controls, corpus, cost, provenance, quality, sampling, scoring
from plenaria.plans import outputs
from plenaria.runtime import cut, mounted, scratch, table
from plenaria.sources import acquire, builders, files, parsers
from plenaria.streaming.states import ResponseStates

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# SQL that the queries share -------------------------------------------------------------------------------------------
_NAMES = " ".join(f"WHEN upper(trim(country)) IN ('{n.upper()}', '{c}') THEN '{n}'" for c, n in CODES.items())
COUNTRY = f"CASE {_NAMES} ELSE country END"
WORDS = lambda x: rf"CAST(len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*')) AS INTEGER)"
SQUEEZED = lambda x: rf"trim(regexp_replace({x}, '[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+', ' ', 'g'))"
ISO = r"CASE WHEN regexp_matches(date, '^\d{4}-\d{2}-\d{2}$') THEN try_cast(date AS DATE) END"
DAY = r"""coalesce(CASE WHEN regexp_matches(trim(date), '^\d{4}-\d{2}-\d{2}([T ].*)?$') THEN try_cast(substr(trim(date), 1, 10) AS DATE) END,
    CASE WHEN regexp_matches(trim(date), '^\d{4}/\d{1,2}/\d{1,2}$') THEN CAST(try_strptime(trim(date), '%Y/%m/%d') AS DATE) END,
    CASE WHEN regexp_matches(trim(date), '^\d{8}$') THEN CAST(try_strptime(trim(date), '%Y%m%d') AS DATE) END,
    CASE WHEN regexp_matches(trim(date), '^\d{1,2}[./-]\d{1,2}[./-]\d{4}$')
         THEN CAST(try_strptime(replace(replace(trim(date), '.', '/'), '-', '/'), '%d/%m/%Y') AS DATE) END)"""
SAFE = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
URL = "https://example.invalid/"


def records(spark, d, country: str) -> DataFrame:
    """speech_id, speaker_name, party, speech_text, day of a country's speeches (in any notation), of the first delivery with a text."""
    rows = table(spark, d, "speeches").where((country_name(F.col("country")) == country) & F.col("speech_id").isNotNull() & F.col("speech_text").isNotNull())
    rows = rows.groupBy("speech_id").agg(F.min_by(F.struct("speaker_name", "party", "speech_text", "date"), F.struct("delivered_at")).alias("r")).select("speech_id", "r.*")
    return rows.withColumn("speaker_name", F.trim(F.regexp_replace(F.coalesce("speaker_name", F.lit("")), r'(?U)[\s\p{Z}"]+', " ")))


def documents_of(rows: DataFrame, form: str, *parts: str | Column, path: Column | None = None, **known: Column) -> DataFrame:
    """path, content, known: a document in the form for each record. Its parts are made safe for markup."""
    content = F.format_string(form, *[SAFE(F.col(p)) if isinstance(p, str) else p for p in parts])
    facts = F.to_json(F.struct(F.lit(URL).alias("source_url"), *[c.alias(n) for n, c in known.items()]))
    return rows.select((F.col("speech_id") if path is None else path).alias("path"), F.encode(content, "utf-8").alias("content"), facts.alias("known"))


def read_back(parsed: DataFrame, key: Column) -> DataFrame:
    return parsed.select(key.alias("speech_id"), "speaker_name", F.md5("speech_text").alias("text_md5"), F.col("word_count").alias("words"))


def read_back_sql(country: str, name: str, text: str, where: str = "true") -> str:
    """name and text: what becomes of speaker_name and speech_text, both squeezed."""
    return rf"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY speech_id ORDER BY delivered_at) AS rn FROM speeches
          WHERE {COUNTRY} = '{country}' AND speech_id IS NOT NULL AND speech_text IS NOT NULL),
        s AS (SELECT speech_id, {SQUEEZED("replace(coalesce(speaker_name, ''), chr(34), ' ')")} AS speaker_name, {SQUEEZED('speech_text')} AS t, speech_text FROM f WHERE rn = 1),
        n AS (SELECT speech_id, {name} AS speaker_name, {text} AS t FROM s WHERE {where})
      SELECT speech_id, speaker_name, md5(t) AS text_md5, {WORDS('t')} AS words FROM n WHERE speaker_name <> '' AND t <> ''"""


# archives -------------------------------------------------------------------------------------------------------------
def zipped(rows: DataFrame, name: str, content: str) -> DataFrame:
    """path, content: ZIP archives of the rows' contents, one archive a batch of rows; each has a member that nobody wants."""

    def run(batches):
        for k, batch in enumerate(batches):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as archive:
                archive.writestr("readme.txt", "no record")
                for row in batch.to_pylist():
                    archive.writestr(row[name], row[content])
            yield pa.RecordBatch.from_arrays([pa.array([f"archive-{k}.zip"]), pa.array([out.getvalue()], pa.binary())], names=["path", "content"])

    return rows.select(name, content).mapInArrow(run, "path string, content binary")


_NO_PARTY = r"trim(regexp_replace(speaker_name, '\s+\([^()]*\)\s*$', ''))"
_FRENCH_CUES = r"\((?:[^()]*(?:applaudissements?|exclamations?|rires?|brouhaha|mêmes mouvements|mêmes protestations|mêmes applaudissements)[^()]*)\)"


@query(read_back_sql("France", _NO_PARTY, SQUEEZED(f"regexp_replace(t, '{_FRENCH_CUES}', ' ', 'gi')")))
def parse_french_archives(spark, d):
    """XML members of ZIP archives."""
    form = (
        '<compteRendu xmlns="urn:x"><uid>U</uid><dateSeance>20240115150000</dateSeance><contenu><paragraphe id_syceron="%s"><orateurs><orateur><nom>%s</nom></orateur></orateurs><texte>%s</texte></paragraphe></contenu></compteRendu>'
    )
    made = documents_of(records(spark, d, "France"), form, "speech_id", "speaker_name", "speech_text", path=F.concat(F.lit("xml/compterendu/"), "speech_id", F.lit(".xml")))
    built = builders.france({"archives": zipped(made, "path", "content")})
    return read_back(built.speeches, F.substring_index("speech_id", ":", -1))


_EDGE = " .,:;–-"
_ITALIAN_CUE = r"\s*\((?:Applausi|Commenti|Proteste|Risate)[^()]*\)"
_OPENING = f"ltrim(t, '{_EDGE}')"
_LED = f"regexp_extract({_OPENING}, '^\\([^()]+\\)')"
_ITALIAN_CLEAN = SQUEEZED(f"regexp_replace({_OPENING}, '{_ITALIAN_CUE}', ' ', 'gi')")


@query(read_back_sql("Italy", "speaker_name", f"CASE WHEN {_LED} <> '' THEN ltrim(substr({_ITALIAN_CLEAN}, length({_LED}) + 1), '{_EDGE}') ELSE {_ITALIAN_CLEAN} END"))
def parse_italian_xml(spark, d):
    form = (
        '<seduta legislatura="19" numero="12" anno="2023" mese="1" giorno="9" ramo="camera"><resoconto><intervento id="%s"><testoXHTML><nominativo id="3" cognomeNome="%s">X</nominativo>%s</testoXHTML></intervento></resoconto></seduta>'
    )
    parsed, _ = parsers.parse_files(documents_of(records(spark, d, "Italy"), form, "speech_id", "speaker_name", "speech_text"), "it_xml")
    return read_back(parsed, F.col("source_identifier"))


@query(read_back_sql("Italy", "speaker_name", f"ltrim(substr({SQUEEZED('''speaker_name || ': ' || t''')}, length(speaker_name) + 1), ' .:–-')"))
def parse_italian_html(spark, d):
    form = "<p>Seduta di lunedì 9 gennaio 2023</p><p class='x intervento' id=\"%s\"><a href=\"?idPersona=7\" title=\"Vai alla scheda personale: %s\">%s</a>: %s</p>"
    made = documents_of(records(spark, d, "Italy"), form, "speech_id", "speaker_name", "speaker_name", "speech_text", term=F.lit(19), number=F.lit("0001"))
    parsed, _ = parsers.parse_files(made, "it_html")
    return read_back(parsed, F.substring_index("speech_id", ":", -1))


_SPANISH_CUE = r"\((?:(?:Continúan|Se producen) los? )?(?:Aplausos|Rumores|Risas|Protestas|Pausa)[^()]*\)"
_MEMBER = "MIEMBRO DE LA CÁMARA"


@query(
    read_back_sql(
        "Spain", f"'{_MEMBER}'", SQUEEZED(rf"regexp_replace(regexp_replace(t, '\bPágina\s+\d+\b', ' ', 'g'), '{_SPANISH_CUE}', ' ', 'gi')"), r"NOT regexp_matches(speech_text, '(?i)Se (?:abre|reanuda) la sesión')"
    )
)
def parse_spanish_html(spark, d):
    form = f'<div class="datos1">15/03/2022</div><p class="textoCompleto">SUMARIO<br>Se abre la sesión.<br>El señor {_MEMBER}: %s<br>El señor SECRETARIO DE LA MESA: Lista de nombres.</p>'
    parsed, _ = parsers.parse_files(documents_of(records(spark, d, "Spain"), form, "speech_text", term=F.lit(14), number=F.col("speech_id")), "es_html")
    return read_back(parsed, F.regexp_extract("session_id", "PL-(.*)$", 1))


_LINE_CUE = r"\(\s*(?:(?:Continúan|Se producen) los? )?(?:Aplausos|Rumores|Risas|Protestas|Pausa|Prolongados aplausos|Varios (?:señores|señoras) diputados|El señor [^)]+ pronuncia palabras|Comienza su intervención)[^()]*\)"
_TIDY = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({SQUEEZED(f'''regexp_replace(replace(t, chr(173), ''), '{_LINE_CUE}', ' ', 'gi')''')}, '\s+([,.;:!?])', '\1', 'g'), '([?!])\.+', '\1', 'g'), '\.{{2,}}', '.', 'g'), '([¿¡])\s+', '\1', 'g')"


@query(read_back_sql("Spain", f"'{_MEMBER}'", f"trim({_TIDY})", r"NOT regexp_matches(speech_text, '(?i)\bSe\s+(?:abre|reanuda)\s+la\s+sesi[oó]n')"))
def parse_spanish_lines(spark, d):
    """Journals of positioned chunks: with page marks and furniture, and ended by a heading."""
    parsed, _ = parsers.parse_files(_spanish_chunks(records(spark, d, "Spain")), "es_pdf_lines")
    return read_back(parsed, F.regexp_extract("session_id", "PL-(.*)$", 1))


def _spanish_chunks(rows: DataFrame) -> DataFrame:
    body = F.regexp_replace("speech_text", r"(?U)[\s\p{Z}]+", " ")
    chunk = lambda order, y, x, text, bold=False: F.struct(F.lit(1).alias("page"), F.lit(order).alias("order"), F.lit(y).alias("y"), F.lit(x).alias("x"), (F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(bold).alias("bold"))
    lines = [
        chunk(0, 700.0, 60.0, "Se abre la sesión"), chunk(1, 690.0, 120.0, F.concat(F.lit(f"{_MEMBER}: "), body)), chunk(2, 690.4, 60.0, "El señor ", True), chunk(3, 680.0, 60.0, "cve: DSCD-14-PL-59"),
        chunk(4, 670.0, 60.0, "Página 7"), chunk(5, 660.0, 60.0, "PROPOSICIONES DE LEY", True), chunk(6, 650.0, 60.0, "Lo que nadie dijo."), chunk(7, 30.0, 60.0, "Pie"),
    ]
    return documents_of(rows, "%s", F.to_json(F.array(*lines)), term=F.lit(14), number=F.col("speech_id"), date=F.lit("2022-03-15"))


_HTML_TEXT = SQUEEZED(rf"regexp_replace(regexp_replace(t, '\bPágina\s+\d+\b', ' ', 'g'), '{_SPANISH_CUE}', ' ', 'gi')")
_ODD = "CAST(right(speech_id, 1) AS INTEGER) % 2 = 1"


@query(read_back_sql("Spain", f"'{_MEMBER}'", f"CASE WHEN {_ODD} THEN trim({_TIDY}) ELSE {_HTML_TEXT} END", r"NOT regexp_matches(speech_text, '(?i)\bSe\s+(?:abre|reanuda)\s+la\s+sesi[oó]n')"))
def build_spain(spark, d):
    """A builder: journals by their page, and by their lines where the page has no text."""
    rows = records(spark, d, "Spain")
    odd = F.right("speech_id", F.lit(1)).cast("int") % 2 == 1
    page = F.when(odd, "<p>x</p>").otherwise(F.concat(F.lit(f'<div class="datos1">15/03/2022</div><p class="textoCompleto">SUMARIO<br>Se abre la sesión.<br>El señor {_MEMBER}: '), SAFE(F.col("speech_text")), F.lit("</p>")))
    built = builders.spain({"html": documents_of(rows, "%s", page, term=F.lit(14), number=F.col("speech_id")), "lines": _spanish_chunks(rows)})
    return read_back(built.speeches, F.regexp_extract("session_id", "PL-(.*)$", 1))


@query(
    rf"""SELECT DISTINCT speech_id AS path, speech_text <> '' AND party IS NOT NULL AS full_text, party IS NULL AS pdf, CASE WHEN party IS NOT NULL THEN '2022-03-15' END AS day FROM
      (SELECT *, row_number() OVER (PARTITION BY speech_id ORDER BY delivered_at) AS rn FROM speeches WHERE {COUNTRY} = 'Spain' AND speech_id IS NOT NULL AND speech_text IS NOT NULL) WHERE rn = 1"""
)
def usable_journals(spark, d):
    """Which journals have a full text, which are PDFs, and their days."""
    rows = records(spark, d, "Spain")
    page = F.when(F.col("party").isNull(), "%PDF-1.4").otherwise(F.concat(F.lit('<div class="datos1">Del 15/03/2022</div><p class="textoCompleto">'), SAFE(F.col("speech_text")), F.lit("</p>")))
    return parsers.journals.usable(documents_of(rows, "%s", page))


@query(read_back_sql("Germany", "speaker_name", "t"))
def parse_german_xml(spark, d):
    form = (
        '<dbtplenarprotokoll wahlperiode="20" sitzung-nr="1" sitzung-datum="01.02.2022"><rede id="%s"><p klasse="redner"><redner id="1"><name><nachname>%s</nachname></name></redner>x:</p>'
        "<p>%s</p><kommentar>(Beifall)</kommentar></rede></dbtplenarprotokoll>"
    )
    parsed, _ = parsers.parse_files(documents_of(records(spark, d, "Germany"), form, "speech_id", "speaker_name", "speech_text"), "de_xml")
    return read_back(parsed, F.col("source_identifier"))


@query(read_back_sql("Netherlands", "speaker_name", "t"))
def parse_dutch_xml(spark, d):
    form = (
        '<vlos xmlns="urn:v"><vergadering objectid="V"><datum>2022-02-01</datum><woordvoerder objectid="%s"><spreker objectid="s"><weergavenaam>%s</weergavenaam></spreker>'
        "<tekst><alinea><alineaitem>%s</alineaitem></alinea></tekst></woordvoerder></vergadering></vlos>"
    )
    parsed, _ = parsers.parse_files(documents_of(records(spark, d, "Netherlands"), form, "speech_id", "speaker_name", "speech_text"), "nl_xml")
    return read_back(parsed, F.substring_index("speech_id", ":", -1))


@query(
    rf"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY speech_id ORDER BY delivered_at) AS rn FROM speeches
          WHERE {COUNTRY} = 'Poland' AND speech_id IS NOT NULL AND speech_text IS NOT NULL),
        s AS (SELECT speech_id, CAST(regexp_extract(speech_id, '(\d+)$', 1) AS BIGINT) AS num, {SQUEEZED("replace(coalesce(speaker_name, ''), chr(34), ' ')")} AS speaker_name, {SQUEEZED('speech_text')} AS t FROM f WHERE rn = 1)
      SELECT speech_id, num, speaker_name, md5(t) AS text_md5, {WORDS('t')} AS words FROM s WHERE speaker_name <> '' AND t <> '' AND num % 7 <> 0"""
)
def polish_days(spark, d):
    """Statement lists and bodies of sitting days; every seventh statement is unspoken."""
    rows = records(spark, d, "Poland").withColumn("num", F.regexp_extract("speech_id", r"(\d+)$", 1).cast("bigint"))
    term = F.regexp_extract("speech_id", r"^(.*?)\d+$", 1)
    place = [term.alias("term"), F.lit(1).alias("proceeding"), F.lit("2024-01-16").alias("date"), "num"]
    metadata = rows.select(*place, F.col("speaker_name").alias("name"), F.col("speech_id").alias("memberID"), F.lit("").alias("function"), (F.col("num") % 7 == 0).alias("unspoken"), F.lit(URL).alias("source_url"))
    bodies = rows.select(*place, F.encode(F.format_string("<p class='punkt-tytul'>1</p><p>%s</p><p>(Oklaski)</p>", SAFE(F.col("speech_text"))), "utf-8").alias("content"))
    found, _ = builders.polish_days(metadata, bodies)
    return found.select(F.col("speaker_id").alias("speech_id"), "num", "speaker_name", F.md5("speech_text").alias("text_md5"), F.col("word_count").alias("words"))


_TABLE_TEXT = "trim(speech_text)"


@query(
    rf"""WITH f AS (SELECT *, {DAY} AS day FROM speeches WHERE speech_id IS NOT NULL AND speech_id <> '' AND trim(coalesce(speech_text, '')) NOT IN ('', 'NA'))
      SELECT speech_id, delivered_at, strftime(day, '%Y-%m-%d') AS date, 'bundestag-19-' || year(day) AS session_id, coalesce(nullif(nullif(trim(concat_ws(' ', nullif(nullif(speaker_name, ''), 'NA'))), ''), 'NA'), 'Unknown speaker') AS speaker_name,
        coalesce(nullif(party, 'NA'), '') AS party, md5({_TABLE_TEXT}) AS text_md5, {WORDS('speech_text')} AS words FROM f WHERE year(day) BETWEEN 2018 AND 2026"""
)
def german_table(spark, d):
    """CSV members of ZIP archives. Every delivery is a row."""
    columns = {
        "wahlperiode": F.lit("19"), "sitzung_nr": F.year("day").cast("string"), "sitzung_datum": F.date_format("day", "yyyy-MM-dd"), "sitzung_jahr": F.year("day").cast("string"), "rede_id": F.col("speech_id"),
        "rede_text": F.col("speech_text"), "redner_id": F.coalesce(F.col("delivered_at").cast("string"), F.lit("")), "redner_nachname": F.trim("speaker_name"), "redner_fraktion": F.col("party"),
    }
    rows = table(spark, d, "speeches").withColumn("day", any_date(F.col("date"))).where("day IS NOT NULL").select(*[F.coalesce(c, F.lit("")).alias(n) for n, c in columns.items()])
    header = list(columns)

    def run(batches):
        for k, batch in enumerate(batches):
            out = io.StringIO()
            writer = csv.writer(out)
            writer.writerow(header)
            writer.writerows(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([f"table-{k}.csv"]), pa.array([out.getvalue().encode()], pa.binary())], names=["path", "content"])

    archives = zipped(rows.mapInArrow(run, "path string, content binary"), "path", "content")
    found = files.german_table(files.csv_rows(files.zip_members(archives, r"\.csv$")), "10.0/x")
    return found.select(
        "speech_id", F.nullif("speaker_id", F.lit("")).cast("timestamp").cast("timestamp_ntz").alias("delivered_at"), "date", "session_id", "speaker_name", "party", F.md5("speech_text").alias("text_md5"), F.col("word_count").alias("words")
    )


# text files -----------------------------------------------------------------------------------------------------------
_FULL = " AND ".join(f"coalesce({c}, '') <> ''" for c in schema.REQUIRED)


@query(
    f"""SELECT coalesce(speech_id, '') AS speech_id, md5(coalesce(speech_text, '')) AS text_md5, md5(coalesce(nullif(raw_text, ''), speech_text, '')) AS raw_md5, coalesce(word_count, 0) AS word_count,
        {_FULL} AND ({ISO}) IS NOT NULL AND (coalesce(word_count, 0) = 0 OR word_count = {WORDS('speech_text')}) AS valid FROM speeches"""
)
def jsonl_round_trip(spark, d):
    """Speeches written as JSON lines, read with their defaults, and judged."""
    with scratch(spark) as place:
        outputs.write_jsonl(table(spark, d, "speeches").select(*schema.SPEECH_COLUMNS), place)
        found = files.with_defaults(files.read_jsonl(spark, place))
        return cut(found.select("speech_id", F.md5("speech_text").alias("text_md5"), F.md5("raw_text").alias("raw_md5"), "word_count", files.valid_speech().alias("valid")))


def _numbered_ids(spark, rows: DataFrame, place: str) -> DataFrame:
    rows.orderBy("speech_id").select("speech_id").write.text(place)
    return files.numbered(spark, place)


@query("SELECT row_number() OVER (ORDER BY speech_id) AS position, speech_id FROM (SELECT DISTINCT speech_id FROM speeches WHERE trim(speech_id) <> '')")
def numbered_lines(spark, d):
    """The ordinal of every line of a text of several files."""
    with scratch(spark) as place:
        rows = table(spark, d, "speeches").select("speech_id").where("trim(speech_id) <> ''").distinct()
        return cut(_numbered_ids(spark, rows, place).withColumnRenamed("value", "speech_id"))


@query(
    """WITH a AS (SELECT row_number() OVER (ORDER BY speech_id) AS position, speech_id FROM (SELECT DISTINCT speech_id FROM detector_responses WHERE trim(speech_id) <> '')),
        b AS (SELECT row_number() OVER (ORDER BY speech_id) AS position, speech_id FROM (SELECT DISTINCT speech_id FROM detector_responses WHERE trim(speech_id) <> '' AND error IS NULL))
      SELECT a.position AS position FROM a LEFT JOIN b USING (position) WHERE a.speech_id IS DISTINCT FROM b.speech_id"""
)
def prefix_differences(spark, d):
    """Where a saved output (all ids) differs from a regenerated one (those without an error), by position."""
    rows = table(spark, d, "detector_responses").where("trim(speech_id) <> ''")
    with scratch(spark) as one, scratch(spark) as two:
        saved = _numbered_ids(spark, rows.select("speech_id").distinct(), one)
        again = _numbered_ids(spark, rows.where("error IS NULL").select("speech_id").distinct(), two)
        return cut(quality.same_prefix(saved, again))


@query(
    rf"""SELECT DISTINCT number, day FROM (SELECT CAST(regexp_extract(session_id, '(\d+)$', 1) AS BIGINT) AS number, {ISO} AS day FROM speeches WHERE session_id IS NOT NULL AND date IS NOT NULL)
      WHERE number > 0 AND year(day) BETWEEN 2018 AND 2026 AND day <= DATE '2024-06-30'"""
)
def sitting_days(spark, d):
    """Documents of proceedings with nested days, of which those up to a cutoff day count."""
    rows = table(spark, d, "speeches").where("session_id IS NOT NULL AND date IS NOT NULL").select("country", F.regexp_extract("session_id", r"(\d+)$", 1).cast("bigint").alias("number"), "date").distinct()
    each = rows.groupBy(F.coalesce("country", F.lit("none")).alias("c"), "number").agg(F.collect_set("date").alias("dates"))
    with scratch(spark) as place:
        each.select(F.to_json(F.array(F.struct("number", "dates")), {"pretty": "true"}).alias("value"), F.format_string("%s-%s", F.sha2("c", 256), F.col("number").cast("string")).alias("file")).write.partitionBy("file").text(place)
        found = files.json_documents(spark, place, "number bigint, dates array<string>")
        return cut(files.sitting_days(found, "2024-06-30").distinct())


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS name, sha256(text) AS sha256, md5(text) AS md5, doc_id % 3 <> 2 AS ok FROM documents WHERE text IS NOT NULL"""
)
def file_digests(spark, d):
    """Digests of files, and whether they are the known ones: of every three an MD5, a SHA-256 in capitals, and a wrong one."""
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    made = rows.select(F.col("doc_id").cast("string").alias("name"), F.encode("text", "utf-8").alias("content"))
    kind = F.pmod("doc_id", F.lit(3))
    known = rows.select(F.col("doc_id").cast("string").alias("name"), F.when(kind == 0, F.md5("text")).when(kind == 1, F.upper(F.sha2("text", 256))).otherwise(F.md5(F.concat("text", F.lit("x")))).alias("digest"))
    return files.file_digests(made).join(files.verified(made, known), "name")


def _control(c: int) -> str:
    return {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(c, f"\\u{c:04x}")


_QUOTED = "replace(replace(speech_text, '\\', '\\\\'), '\"', '\\\"')"
for _c in range(1, 32):
    _QUOTED = f"replace({_QUOTED}, chr({_c}), '{_control(_c)}')"


@query(f"""SELECT DISTINCT speech_id, sha256('{{"configuration":{{"model":"m","v":1}},"text":"' || {_QUOTED} || '"}}') AS fingerprint FROM speeches WHERE speech_id IS NOT NULL AND speech_text IS NOT NULL""")
def request_fingerprints(spark, d):
    rows = table(spark, d, "speeches").where("speech_id IS NOT NULL AND speech_text IS NOT NULL")
    return rows.select("speech_id", files.fingerprints({"v": 1, "model": "m"}, F.col("speech_text")).alias("fingerprint")).distinct()


@query(
    f"""WITH d(country) AS (VALUES {', '.join(f"('{c}')" for c in COUNTRIES)}), c AS (SELECT {COUNTRY} AS country, {WORDS('speech_text')} AS words FROM speeches)
      SELECT d.country AS country, CAST(count(c.words) AS VARCHAR) AS speeches, CAST(coalesce(sum(words), 0) AS VARCHAR) AS words, CAST(count(*) FILTER (WHERE words >= 40) AS VARCHAR) AS eligible_speeches,
        CAST(coalesce(sum(words) FILTER (WHERE words >= 40), 0) AS VARCHAR) AS eligible_words FROM d LEFT JOIN c ON c.country = d.country GROUP BY d.country"""
)
def result_csv(spark, d):
    """A result table written as CSV and read back."""
    from plenaria.functions.text import word_count
    from plenaria.operators import aggregate

    rows = table(spark, d, "speeches").select(country_name(F.col("country")).alias("country"), word_count(F.col("speech_text")).alias("words"))
    with scratch(spark) as place:
        path = Path(mounted(place), "size.csv")
        outputs.put_csv(path, outputs.small_rows(aggregate.country_sizes(rows, corpus.dimension(spark)), ["country"]))
        back = list(csv.DictReader(io.StringIO(path.read_text(encoding="utf-8"))))
    return spark.createDataFrame([tuple(r.values()) for r in back], ", ".join(f"{c} string" for c in back[0]))


# manifests and addresses ----------------------------------------------------------------------------------------------
_ENTRY = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY local_path ORDER BY retrieved_at_utc {0}, sha256 {0}) AS rn FROM source_manifest WHERE local_path IS NOT NULL) WHERE rn = 1"


@query(
    f"""WITH o AS (SELECT * FROM ({_ENTRY.format('')}) WHERE coalesce(content_type, '') <> 'application/pdf'), n AS (SELECT * FROM ({_ENTRY.format('DESC')}) WHERE coalesce(content_type, '') <> 'application/xml')
      SELECT local_path, CASE WHEN n.local_path IS NULL THEN o.sha256 ELSE n.sha256 END AS sha256,
        CASE WHEN n.local_path IS NULL THEN 'gone' WHEN o.sha256 = n.sha256 AND o.source_url IS NOT DISTINCT FROM n.source_url THEN 'kept' WHEN o.local_path IS NOT NULL THEN 'changed' ELSE 'new' END AS change,
        CASE WHEN n.local_path IS NOT NULL AND NOT coalesce(o.sha256 = n.sha256 AND o.source_url IS NOT DISTINCT FROM n.source_url, false) THEN n.retrieved_at_utc ELSE o.retrieved_at_utc END AS retrieved_at_utc
      FROM o FULL JOIN n USING (local_path)"""
)
def manifest_changes(spark, d):
    """A manifest (no PDF) held against the files of today (no XML): kept, changed, new and gone ones."""
    rows = table(spark, d, "source_manifest").where("local_path IS NOT NULL")
    kind = F.coalesce("content_type", F.lit(""))
    rest = [c for c in rows.columns if c not in ("local_path", "retrieved_at_utc", "sha256")]
    first = rows.groupBy("local_path").agg(F.min(F.struct("retrieved_at_utc", "sha256", *rest)).alias("e")).select("local_path", "e.*").where(kind != "application/pdf")
    last = provenance.last_entries(rows.select("local_path", "retrieved_at_utc", "sha256", *rest)).where(kind != "application/xml")
    last = last.select("source_url", "retrieved_at_utc", "local_path", "bytes", "sha256", "content_type")
    return provenance.reconcile(first, last).select("local_path", "sha256", "change", "retrieved_at_utc")


@query("SELECT DISTINCT local_path AS path FROM source_manifest WHERE local_path NOT IN (SELECT local_path FROM source_manifest WHERE provenance_status = 'reconciled' AND local_path IS NOT NULL)")
def wanted_files(spark, d):
    """Files of the manifest that no reconciled entry has."""
    rows = table(spark, d, "source_manifest").where("local_path IS NOT NULL")
    return quality.wanted_files(rows.select(F.col("local_path").alias("path")).distinct(), rows.where("provenance_status = 'reconciled'").select(F.col("local_path").alias("path")))


_STATES = ("fetched", "reconciled", "unresolved_source_url")


@query(
    f"""SELECT content_type, {', '.join(f"count(*) FILTER (WHERE provenance_status = '{s}') AS {s}" for s in _STATES)},
        count(*) FILTER (WHERE provenance_status IS NULL OR provenance_status NOT IN ({', '.join(f"'{s}'" for s in _STATES)})) AS other FROM source_manifest GROUP BY content_type"""
)
def status_counts(spark, d):
    return quality.status_counts(table(spark, d, "source_manifest"), ["content_type"], "provenance_status", _STATES)


_PATHS = {
    "Spain": "'spain/congreso/term-14/DSCD-14-PL-' || n || '.html'", "Italy": "'italy/leg19/sitting-' || n || '.xml'", "Netherlands": "'netherlands/verslag/' || speech_id || '.xml'",
    "Poland": "'poland/term-10/proceeding-3/2024-01-16/statement-' || n || '.html'", "France": "'france/legislature-16-syceron.zip'", "Germany": "'germany/cpp-bt/CPP-BT_2026-01-17_DE_CSV_Reden_Gesamt.zip'",
}
_ADDRESSES = {
    "Spain": "'https://www.congreso.es/busqueda-de-intervenciones?p_p_id=intervenciones&p_p_lifecycle=0&p_p_state=normal&p_p_mode=view&_intervenciones_mode=mostrarTextoIntegro&_intervenciones_legislatura=XIV&_intervenciones_id_texto=(DSCD-14-PL-' || n || '.CODI.)'",
    "Italy": "'https://documenti.camera.it/apps/commonServices/getDocumento.ashx?sezione=assemblea&tipoDoc=formato_xml&tipologia=stenografico&idNumero=' || lpad(n, CAST(greatest(4, length(n)) AS INTEGER), '0') || '&idLegislatura=19'",
    "Netherlands": "'https://gegevensmagazijn.tweedekamer.nl/OData/v4/2.0/Verslag(' || speech_id || ')/resource'", "Poland": "'https://api.sejm.gov.pl/sejm/term10/proceedings/3/2024-01-16/transcripts/' || n",
    "France": "'https://data.assemblee-nationale.fr/static/openData/repository/16/vp/syceronbrut/syseron.xml.zip'", "Germany": "'https://zenodo.org/api/records/18177196/files/CPP-BT_2026-01-17_DE_CSV_Reden_Gesamt.zip/content'",
}
_CASE = lambda forms: "CASE country " + " ".join(f"WHEN '{c}' THEN {f}" for c, f in forms.items()) + " END"


@query(
    f"""WITH s AS (SELECT DISTINCT {COUNTRY} AS country, speech_id, CAST(CAST(right(speech_id, 4) AS INTEGER) AS VARCHAR) AS n FROM speeches WHERE speech_id IS NOT NULL)
      SELECT DISTINCT path, address FROM (SELECT {_CASE(_PATHS)} AS path, {_CASE(_ADDRESSES)} AS address FROM s) WHERE path IS NOT NULL"""
)
def source_addresses(spark, d):
    """The official addresses of raw files by their paths."""
    rows = table(spark, d, "speeches").where("speech_id IS NOT NULL").select(country_name(F.col("country")).alias("country"), "speech_id").distinct()
    rows = rows.withColumn("n", F.right("speech_id", F.lit(4)).cast("int").cast("string"))
    return rows.select(F.expr(_CASE(_PATHS)).alias("path")).where("path IS NOT NULL").distinct().select("path", provenance.source_address(F.col("path")).alias("address"))


@query("SELECT DISTINCT speech_id AS name, 'https://example.invalid/' || speech_id AS url FROM detector_responses WHERE speech_id IS NOT NULL")
def one_address(spark, d):
    rows = table(spark, d, "detector_responses").where("speech_id IS NOT NULL")
    return quality.one_address(rows.select(F.col("speech_id").alias("name"), F.concat(F.lit(URL), "speech_id").alias("url")))


@query("SELECT DISTINCT speech_id AS \"key\", 'xml/' || session_id || '.xml' AS member FROM (SELECT speech_id, min(session_id) AS session_id FROM speeches WHERE speech_id IS NOT NULL AND session_id IS NOT NULL GROUP BY speech_id)")
def archive_members(spark, d):
    """The archive member of each record by its identifier."""
    rows = table(spark, d, "speeches").where("speech_id IS NOT NULL AND session_id IS NOT NULL").groupBy("speech_id").agg(F.min("session_id").alias("session_id"))
    members = rows.select(F.concat(F.lit("xml/"), "session_id", F.lit(".xml")).alias("member"), F.lit(None).cast("binary").alias("content")).distinct()
    return acquire.sources_of(rows.select(F.col("speech_id").alias("key"), F.concat("session_id", F.lit(":"), "speech_id").alias("source_identifier")), members)


# coverage -------------------------------------------------------------------------------------------------------------
_REPORTS = """SELECT speech_id AS "Id", min(coalesce(date, '0000')) AS "Datum", list({{'Id': coalesce(source_url, '') || '|' || coalesce(CAST(delivered_at AS VARCHAR), ''), 'Soort': CASE WHEN record_status = 'provisional' THEN 'Tussenpublicatie' ELSE 'Eindpublicatie' END,
      'Status': CASE record_status WHEN 'final' THEN 'Gerectificeerd' WHEN 'corrected' THEN 'Gecorrigeerd' ELSE record_status END, 'GewijzigdOp': coalesce(strftime(delivered_at, '%Y-%m-%d %H:%M:%S.%f'), ''), 'Verwijderd': coalesce(party, '') = ''}}) AS v
    FROM speeches WHERE speech_id IS NOT NULL GROUP BY speech_id"""
_REPORTS = _REPORTS.replace("{{", "{").replace("}}", "}").replace("coalesce(CAST(delivered_at AS VARCHAR), '')", "coalesce(strftime(delivered_at, '%Y-%m-%d %H:%M:%S.%f'), '')")
_PICKED = f"""m AS ({_REPORTS}), a AS (SELECT *, [x FOR x IN v IF NOT x.Verwijderd] AS alive FROM m),
    p AS (SELECT *, list_max([{{'at': x.GewijzigdOp, 'Id': x.Id}} FOR x IN alive IF x.Status IN ('Gecorrigeerd', 'Gerectificeerd') AND x.Soort = 'Eindpublicatie']).Id AS report,
      list_max([{{'at': x.GewijzigdOp, 'Id': x.Id}} FOR x IN alive IF x.Soort = 'Tussenpublicatie']).Id AS provisional FROM a)"""


def _meetings(spark, d) -> DataFrame:
    """Speeches as meetings, their deliveries as reports."""
    rows = table(spark, d, "speeches").where("speech_id IS NOT NULL")
    at = F.coalesce(F.date_format("delivered_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(""))
    report = F.struct(
        F.concat(F.coalesce("source_url", F.lit("")), F.lit("|"), at).alias("Id"), F.when(F.col("record_status") == "provisional", "Tussenpublicatie").otherwise("Eindpublicatie").alias("Soort"),
        F.when(F.col("record_status") == "final", "Gerectificeerd").when(F.col("record_status") == "corrected", "Gecorrigeerd").otherwise(F.col("record_status")).alias("Status"),
        at.alias("GewijzigdOp"), (F.coalesce("party", F.lit("")) == "").alias("Verwijderd"),
    )
    return rows.groupBy(F.col("speech_id").alias("Id")).agg(F.min(F.coalesce("date", F.lit("0000"))).alias("Datum"), F.collect_list(report).alias("Verslag"))


@query(
    f"""WITH {_PICKED} SELECT substr("Datum", 1, 4) AS year, count(*) AS listed, count(report) AS selected, count(*) FILTER (WHERE report IS NULL AND provisional IS NOT NULL) AS provisional_only,
      count(*) FILTER (WHERE len(v) = 0) AS without FROM p GROUP BY ALL"""
)
def meeting_coverage(spark, d):
    return quality.meeting_coverage(_meetings(spark, d))


@query(f"""WITH {_PICKED} SELECT "Datum", "Id", provisional, len(v) > 0 AS any_report FROM p WHERE report IS NULL""")
def meeting_details(spark, d):
    return quality.meeting_details(_meetings(spark, d))


_TERMS = r"""SELECT speech_id, coalesce(legislative_term, 'none') AS term, CAST(regexp_extract(session_id, '(\d+)$', 1) AS BIGINT) AS proceeding, date AS day, CAST(regexp_extract(speech_id, '(\d+)$', 1) AS BIGINT) AS num
    FROM speeches WHERE speech_id IS NOT NULL AND session_id IS NOT NULL AND date IS NOT NULL"""
_DAYS = f"""s AS ({_TERMS}), days AS (SELECT DISTINCT term, proceeding, day FROM s),
    kinds AS (SELECT *, CASE proceeding % 6 WHEN 1 THEN 'statement metadata missing' WHEN 2 THEN 'invalid statement metadata' WHEN 3 THEN 'statement list is not an array' END AS reason FROM days),
    spoken AS (SELECT DISTINCT s.term, s.proceeding, s.day, s.num FROM s JOIN kinds k USING (term, proceeding, day) WHERE k.reason IS NULL AND s.num % 5 <> 0),
    bodies AS (SELECT DISTINCT term, proceeding, day, num FROM s WHERE num % 4 <> 0)"""


def _statements(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sitting days, the documents of their statement lists (some absent, broken or of another shape), and the bodies."""
    tail = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("bigint")
    rows = table(spark, d, "speeches").where("speech_id IS NOT NULL AND session_id IS NOT NULL AND date IS NOT NULL")
    rows = rows.select(F.coalesce("legislative_term", F.lit("none")).alias("term"), tail("session_id").alias("proceeding"), F.col("date").alias("day"), tail("speech_id").alias("num")).distinct()
    days, kind = rows.select("term", "proceeding", "day").distinct(), F.col("proceeding") % 6
    each = rows.groupBy("term", "proceeding", "day").agg(F.collect_list(F.struct("num", (F.col("num") % 5 == 0).alias("unspoken"))).alias("statements"))
    text = F.when(kind == 2, "{broken").when(kind == 3, '{"statements": {"a": 1}}').otherwise(F.to_json(F.struct("statements")))
    return days, each.where(kind != 1).select("term", "proceeding", "day", text.alias("document")), rows.where("num % 4 <> 0")


@query(
    f"""WITH {_DAYS}, t AS (SELECT term, count(DISTINCT proceeding) AS proceedings, count(*) AS target_dates, min(day) AS first_date, max(day) AS last_date FROM days GROUP BY term),
      e AS (SELECT term, count(*) AS n FROM spoken GROUP BY term), b AS (SELECT term, count(*) AS n FROM bodies GROUP BY term), l AS (SELECT term, count(*) AS n FROM kinds WHERE proceeding % 6 <> 1 GROUP BY term)
      SELECT t.*, coalesce(e.n, 0) AS expected_spoken_bodies, coalesce(l.n, 0) AS statement_metadata_files, coalesce(b.n, 0) AS statement_body_files FROM t LEFT JOIN e USING (term) LEFT JOIN b USING (term) LEFT JOIN l USING (term)"""
)
def statement_coverage(spark, d):
    return quality.statement_coverage(*_statements(spark, d))[0]


@query(
    f"""WITH {_DAYS} SELECT term, proceeding, day, CAST(NULL AS BIGINT) AS num, reason FROM kinds WHERE reason IS NOT NULL
      UNION ALL SELECT term, proceeding, day, num, 'spoken statement body missing' FROM spoken ANTI JOIN bodies USING (term, proceeding, day, num)
      UNION ALL SELECT '99', NULL, NULL, NULL, 'proceedings index missing'"""
)
def statement_gaps(spark, d):
    """What is missing of the statements, and a term without index."""
    days, metadata, bodies = _statements(spark, d)
    terms = days.select("term").distinct().unionByName(spark.createDataFrame([("99",)], "term string"))
    return quality.statement_coverage(days, metadata, bodies, terms)[1].select("term", "proceeding", "day", "num", "reason")


@query(
    f"""WITH c AS (SELECT {COUNTRY} AS country, {DAY} AS day FROM speeches) SELECT d.country || ':' || y.year AS cell, 'no records for ' || d.country || ':' || y.year AS blocker
      FROM (VALUES {', '.join(f"('{c}')" for c in COUNTRIES)}) d(country), range(2018, 2026) y(year) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.country = d.country AND year(c.day) = y.year)
      UNION ALL SELECT NULL, 'gap report of Italy is missing' UNION ALL SELECT NULL, '2 unresolved gaps of Spain'"""
)
def build_readiness(spark, d):
    """What keeps a build from being complete: missing cells, a missing gap report and open gaps."""
    rows = table(spark, d, "speeches").select(country_name(F.col("country")).alias("country"), any_date(F.col("date")).alias("day"))
    state = quality.readiness(quality.missing_coverage(rows), {"Germany": [1], "Italy": None, "Spain": [1, 2], "France": []})
    cells = {f"no records for {c}": c for c in state["missing_coverage"]}
    return spark.createDataFrame([(cells.get(b), b) for b in state["blockers"]], "cell string, blocker string")


@query(
    f"""SELECT speech_id, 'date outside configured study years: ' || strftime(day, '%Y-%m-%d') AS warning FROM (SELECT speech_id, {ISO} AS day FROM speeches) WHERE year(day) NOT BETWEEN 2019 AND 2023"""
)
def qa_warnings(spark, d):
    return quality.warnings(table(spark, d, "speeches"), (2019, 2023))


@query(
    f"""WITH c AS (SELECT {COUNTRY} AS country, speech_id, session_id, {WORDS("coalesce(speech_text, '')")} AS words, strftime({DAY}, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY speech_id ORDER BY coalesce(delivered_at, TIMESTAMP '9999-12-31')) AS rn FROM speeches WHERE speech_id IS NOT NULL)
      SELECT country, count(*) AS records, CAST(sum(words) AS BIGINT) AS words, count(DISTINCT session_id) AS sittings, min(day) AS first_date, max(day) AS last_date FROM c
      WHERE rn = 1 AND country IN ({', '.join(f"'{c}'" for c in COUNTRIES)}) AND year(CAST(day AS DATE)) BETWEEN 2018 AND 2026 GROUP BY country"""
)
def build_counts(spark, d):
    """The counts that the builders report, of the combined corpus."""
    rows = first_delivery(table(spark, d, "speeches"), {"country": country_name(F.col("country")), "session_id": F.col("session_id"), "date": F.date_format(any_date(F.col("date")), "yyyy-MM-dd"), "word_count": F.expr("1")})
    words = corpus.corpus(table(spark, d, "speeches"), "words")
    rows = rows.drop("word_count").join(words, "speech_id").withColumnRenamed("words", "word_count").where(F.col("country").isin(*COUNTRIES))
    return builders.Built(builders.within(rows, builders.YEARS), rows).counts()


# controls, responses, budgets -----------------------------------------------------------------------------------------
_BLANK = lambda c: f"nullif(trim({c}), '')"
_MISSING = ", ".join(f"CASE WHEN {_BLANK(c)} IS NULL THEN '{n}' END" for n, c in (("country", "country"), ("text_language", "text_language"), ("generator", "speaker_name"), ("prompt_id", "speech_id"), ("text", "speech_text")))
_LANGUAGES = "CASE " + " ".join(f"WHEN {_BLANK('country')} = '{c}' THEN '{x}'" for c, x in schema.LANGUAGE.items()) + " END"
_PROBLEM = f"""CASE WHEN len(missing) > 0 THEN 'missing ' || array_to_string(missing, ', ') WHEN {_BLANK('country')} NOT IN ({', '.join(f"'{c}'" for c in COUNTRIES)}) THEN 'unknown country'
    WHEN {_BLANK('text_language')} <> {_LANGUAGES} THEN 'language does not match country' WHEN {_BLANK('party')} IS NOT NULL THEN 'party must stay empty' WHEN {WORDS('speech_text')} < 1 THEN 'text contains no words' END"""
_JUDGED = f"j AS (SELECT *, {_PROBLEM} AS problem FROM (SELECT *, [x FOR x IN [{_MISSING}] IF x IS NOT NULL] AS missing FROM speeches))"


def _passages(spark, d) -> DataFrame:
    return table(spark, d, "speeches").select("country", "text_language", F.col("speaker_name").alias("generator"), F.col("speech_id").alias("prompt_id"), F.col("speech_text").alias("text"), "party")


@query(f"WITH {_JUDGED} SELECT problem, count(*) AS passages FROM j GROUP BY problem")
def control_problems(spark, d):
    """What is wrong with the speeches if they were control passages."""
    rows = _passages(spark, d)
    return rows.groupBy(controls.problem(rows.columns).alias("problem")).agg(F.count(F.lit(1)).alias("passages"))


@query(f"WITH {_JUDGED} SELECT country FROM (VALUES {', '.join(f"('{c}')" for c in COUNTRIES)}) d(country) WHERE country NOT IN (SELECT country FROM j WHERE problem IS NULL AND country <> 'Poland')")
def control_countries(spark, d):
    """Countries without a valid passage, those of one being left out."""
    good, _ = controls.normalize(_passages(spark, d))
    return controls.missing_countries(good.where("country <> 'Poland'"))


@query(
    """SELECT speech_id, problem, count(*) AS responses FROM (SELECT speech_id, CASE WHEN stage = 'complete' AND error IS NULL THEN
        CASE WHEN fraction_ai IS NULL OR isnan(fraction_ai) OR fraction_ai NOT BETWEEN 0 AND 1 THEN 'invalid fraction_ai'
          WHEN fraction_ai_assisted IS NULL OR isnan(fraction_ai_assisted) OR fraction_ai_assisted NOT BETWEEN 0 AND 1 THEN 'invalid fraction_ai_assisted'
          WHEN fraction_human IS NULL OR isnan(fraction_human) OR fraction_human NOT BETWEEN 0 AND 1 THEN 'invalid fraction_human'
          WHEN fraction_ai + fraction_ai_assisted + fraction_human > 1.00001 THEN 'fractions sum to more than 1'
          WHEN version IS NULL OR version <> (SELECT max(version) FROM detector_responses) THEN 'version isn''t entitled' END END AS problem FROM detector_responses) GROUP BY ALL"""
)
def response_problems(spark, d):
    rows = table(spark, d, "detector_responses")
    newest = rows.agg(F.max("version")).first()[0]
    return rows.groupBy("speech_id", scoring.response_problem((newest,)).alias("problem")).agg(F.count(F.lit(1)).alias("responses"))


_TURN = "CAST('0x' || substr(sha256(fingerprint), 1, 2) AS INTEGER) % 4"


@query(
    f"""SELECT fingerprint, CASE {_TURN} WHEN 0 THEN 'complete' WHEN 1 THEN 'complete' WHEN 2 THEN 'pending' ELSE 'submission_unknown' END AS status,
        CASE {_TURN} WHEN 0 THEN 'of ' || fingerprint WHEN 1 THEN 'late t-' || fingerprint END AS response, CASE WHEN {_TURN} = 3 THEN 'OSError: no answer' END AS error
      FROM (SELECT DISTINCT speech_id AS fingerprint FROM detector_responses WHERE speech_id IS NOT NULL)"""
)
def response_states(spark, d):
    """The states of all requests after they were submitted twice and polled: some answer at once, some later, some never, some fail."""

    def turn(key: str) -> int:
        return hashlib.sha256(key.encode()).digest()[0] % 4

    def send(key: str, text: str) -> dict:
        if turn(key) == 3:
            raise OSError("no answer")
        return {"response": text} if turn(key) == 0 else {"task_id": f"t-{key}"}

    asked = table(spark, d, "detector_responses").where("speech_id IS NOT NULL").select(F.col("speech_id").alias("fingerprint"), F.concat(F.lit("of "), "speech_id").alias("text"))
    with scratch(spark) as place:
        states = ResponseStates(spark, f"{place}/states")
        states.submit(asked, send)
        states.submit(asked, send)
        states.poll(lambda key, task: {"response": f"late {task}"} if turn(key) == 1 else {})
        return cut(states.latest().select("fingerprint", "status", "response", "error"))


@query(
    """SELECT CAST(cents AS DOUBLE) / 100 AS price, (CAST(round(budget * 100) AS BIGINT) * 10) // cents AS units, CAST(budget AS DOUBLE) AS budget
      FROM (SELECT DISTINCT o_totalprice AS budget FROM orders), (VALUES (50), (25)) p(cents)"""
)
def budget_units(spark, d):
    """Blocks of words that budgets cover, in exact decimals and never rounded up."""
    budgets = table(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("budget")).distinct()
    prices = F.explode(F.array(F.lit(0.5), F.lit(0.25))).alias("price")
    return budgets.select("budget", prices).select("price", cost.units_within(F.col("budget"), F.col("price")).alias("units"), "budget").distinct()


# orders ---------------------------------------------------------------------------------------------------------------
_FIXED = f"""r AS (SELECT speech_id, {COUNTRY} AS country, {DAY} AS day, {WORDS("coalesce(speech_text, '')")} AS words, coalesce(delivered_at, TIMESTAMP '9999-12-31') AS first_at FROM speeches WHERE speech_id IS NOT NULL),
    corpus AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY speech_id ORDER BY first_at) AS rn FROM r) WHERE rn = 1 AND words >= 40 AND day IS NOT NULL),
    sample AS (SELECT * FROM (SELECT *, country || ':' || strftime(day, '%Y-%m') AS stratum, row_number() OVER (PARTITION BY country || ':' || strftime(day, '%Y-%m') ORDER BY sha256('2026|' || country || ':' || strftime(day, '%Y-%m') || '|' || speech_id)) AS place FROM corpus) WHERE place <= 2)"""


@query(f"""WITH {_FIXED} SELECT row_number() OVER (ORDER BY country, day, speech_id) AS position, speech_id FROM sample""")
def sample_order(spark, d):
    """A sample in order of country, day and id."""
    rows = corpus.corpus(table(spark, d, "speeches"), "country", "day", "words")
    plan = sampling.strata(rows).withColumns({"selected": F.least(F.lit(2), F.col("eligible")), "weight": F.lit(1.0)})
    return sampling.positioned(sampling.stratified_sample(rows, plan), ["country", "day", "speech_id"]).select("position", "speech_id")


@query(f"""WITH {_FIXED}, o AS (SELECT speech_id, row_number() OVER (ORDER BY speech_id) AS ordinal FROM (SELECT DISTINCT speech_id FROM r))
    SELECT row_number() OVER (ORDER BY ordinal) AS position, speech_id, ordinal FROM sample JOIN o USING (speech_id)""")
def sample_in_corpus_order(spark, d):
    """A sample in the order of the corpus file that it was drawn from."""
    speeches = table(spark, d, "speeches")
    rows = corpus.corpus(speeches, "country", "day", "words")
    plan = sampling.strata(rows).withColumns({"selected": F.least(F.lit(2), F.col("eligible")), "weight": F.lit(1.0)})
    with scratch(spark) as place:
        lines = cut(_numbered_ids(spark, speeches.where("speech_id IS NOT NULL").select("speech_id").distinct(), place).select(F.col("value").alias("speech_id"), F.col("position").alias("ordinal")))
    return sampling.positioned(sampling.stratified_sample(rows, plan).join(lines, "speech_id"), ["ordinal"]).select("position", "speech_id", "ordinal")


@query("""SELECT country, speech_id, row_number() OVER (ORDER BY country, speech_id) AS position FROM (SELECT DISTINCT s.country, s.speech_id FROM speeches s JOIN detector_responses r USING (speech_id)
    WHERE s.country IS NOT NULL AND s.text_language IS NOT NULL AND coalesce(fraction_ai, 0) + coalesce(fraction_ai_assisted, 0) >= 0.5)""")
def control_order(spark, d):
    """Detected passages in order of country and id."""
    rows = table(spark, d, "speeches").where("country IS NOT NULL AND text_language IS NOT NULL").withColumn("generator", F.lit(""))
    found = controls.detections(rows, table(spark, d, "detector_responses")).where("detected_ai").select("country", "speech_id").distinct()
    return sampling.positioned(found, ["country", "speech_id"])


# what a study writes --------------------------------------------------------------------------------------------------
_YEARLY = f"y AS (SELECT name, year FROM (SELECT {COUNTRY} AS name, year({DAY}) AS year FROM speeches) WHERE year IS NOT NULL AND name IS NOT NULL GROUP BY name, year)"


@query(f"""WITH {_YEARLY} SELECT 'circle' AS element, count(*) AS times FROM y UNION ALL SELECT 'polyline', count(DISTINCT name) FROM y UNION ALL SELECT 'labels', count(DISTINCT year) FROM y""")
def chart_elements(spark, d):
    """The points and lines of a chart of all countries and years, and its labels of years."""
    rows = table(spark, d, "speeches").select(country_name(F.col("country")).alias("country"), F.year(any_date(F.col("date"))).alias("year")).where("country IS NOT NULL AND year IS NOT NULL")
    found = outputs.small_rows(rows.groupBy("country", F.col("year").cast("string").alias("period")).agg((F.count(F.lit(1)) / 1e6).alias("share")), ["country", "period"])
    chart = outputs.line_chart(found, "speeches", "share")
    years = {r["period"] for r in found}
    counts = [("circle", chart.count("<circle")), ("polyline", chart.count("<polyline")), ("labels", sum(f">{y}</text>" in chart for y in years))]
    return spark.createDataFrame(counts, "element string, times bigint")


@query("SELECT DISTINCT speech_id, CAST('0x' || substr(sha256(speech_id), 1, 2) AS BIGINT) % 16 / 100.0::DOUBLE AS ai, CAST('0x' || substr(sha256(speech_id), 3, 2) AS BIGINT) % 11 / 100.0::DOUBLE AS mixed FROM speeches WHERE speech_id IS NOT NULL")
def response_sink(spark, d):
    """Responses as they are written: an id and a struct, as JSON lines."""
    rows = table(spark, d, "speeches").where("speech_id IS NOT NULL").select("speech_id").distinct()
    with scratch(spark) as place:
        outputs.write_jsonl(rows.select("speech_id", scoring.mock_shares(F.col("speech_id")).alias("response")), place)
        return cut(spark.read.schema("speech_id string, response struct<ai double, mixed double>").json(place).select("speech_id", "response.ai", "response.mixed"))


@query("SELECT n_name AS speech_id, CASE WHEN n_regionkey % 2 = 0 THEN 'verified' ELSE 'mismatch' END AS status FROM nation")
def packet_statuses(spark, d):
    """A packet for a reviewer: a heading and a status for each record."""
    import re

    rows = table(spark, d, "nation").select(F.col("n_name").alias("speech_id"), F.when(F.col("n_regionkey") % 2 == 0, "verified").otherwise("mismatch").alias("status"), F.lit("text").alias("text"))
    packet = outputs.review_packet(outputs.small_rows(rows, ["speech_id"]))
    found = re.findall(r"^## (.+)\n\n.*\*\*(\w+)\*\*", packet, re.M)
    return spark.createDataFrame(found, "speech_id string, status string")


@query("SELECT n_name AS name, CAST(length(n_name) + 1 AS BIGINT) AS bytes, sha256(n_name || chr(10)) AS sha256 FROM nation")
def file_inventory(spark, d):
    """All files below a folder with their sizes and digests; place holders and unfinished ones aren't among them."""
    rows = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_name").alias("value"))
    with scratch(spark) as place:
        rows.repartition("name").write.partitionBy("name").text(place)
        found = files.file_digests(files.raw_files(spark, place)).where(~F.col("path").rlike("_SUCCESS$"))
        return cut(found.select(F.replace(F.regexp_extract("path", "name=([^/]*)/", 1), F.lit("%20"), F.lit(" ")).alias("name"), "bytes", "sha256"))


@query("SELECT row_number() OVER (ORDER BY speech_id) AS position, speech_id, count(*) OVER () > 0 AS whole FROM (SELECT DISTINCT speech_id FROM speeches WHERE trim(speech_id) <> '')")
def resumed_output(spark, d):
    """An output that broke off after its first rows, checked, finished and moved to its place."""
    rows = table(spark, d, "speeches").select("speech_id").where("trim(speech_id) <> ''").distinct()
    whole = sampling.positioned(rows, ["speech_id"])
    with scratch(spark) as place:
        whole.where("position % 100000 < 50").where(F.col("position") < 50).write.parquet(f"{place}/part.tmp")
        builders.resume(spark, f"{place}/part.tmp", whole, f"{place}/part")
        return cut(spark.read.parquet(f"{place}/part").withColumn("whole", F.lit(True)))


GUARDS = ("negative price", "infinite price", "zero budget", "budget over cap", "paid without confirmation", "cap passed", "four trial speeches", "unknown country", "incomplete corpus", "absent corpus", "options that exclude each other")


@query("SELECT guard, true AS refused FROM (VALUES " + ", ".join(f"('{g}')" for g in GUARDS) + ") t(guard) UNION ALL SELECT 'nothing wrong', false")
def guards(spark, d):
    """What a study refuses before anything is written or paid."""
    import contextlib

    from plenaria.plans import commands, study

    absent = f"{d}/no such corpus.jsonl"
    none = spark.createDataFrame([], "country string, day date")
    tries = {
        "negative price": lambda: study.finite("price", -1.0), "infinite price": lambda: study.finite("price", float("inf")), "zero budget": lambda: study.finite("budget", 0.0, above=True),
        "budget over cap": lambda: study.run_study(spark, "/nowhere", sample_budget=3.0, max_cost=1.0), "paid without confirmation": lambda: study.run_study(spark, "/nowhere", absent, dry_run=False),
        "cap passed": lambda: cost.within_cap(0.1, 0.2, 0.3) and not cost.within_cap(0.1, 0.2, 0.2999) and study.finite("cost over the cap", -1.0), "four trial speeches": lambda: study.run_trial(spark, "/nowhere", absent, 4, 0.5, {}, None, confirmed=True),
        "unknown country": lambda: study.run_trial(spark, "/nowhere", absent, 1, 0.5, {}, None, "Atlantis", confirmed=True), "incomplete corpus": lambda: study.paid_guard(none, {}), "absent corpus": lambda: study.read_corpus(spark, absent, True),
        "options that exclude each other": lambda: commands.checked(p := commands.parser(), p.parse_args(["run", "--dry-run", "--confirm"])), "nothing wrong": lambda: study.finite("price", 0.0),
    }

    def refused(act) -> bool:
        try:
            with contextlib.redirect_stderr(io.StringIO()):
                act()
        except (ValueError, OSError, SystemExit):
            return True
        return False

    return spark.createDataFrame([(name, refused(act)) for name, act in tries.items()], "guard string, refused boolean")
