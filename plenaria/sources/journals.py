"""Sitting records that are split into turns by relational steps: Spanish journals (pages and positioned lines), Italian pages.

A file is only taken to pieces in Python: into the nodes of a page, or the lines of a journal. All rules are then Spark
expressions over the pieces: turns are what stands between two labels, windows number them, and the first heading after a
label is a minimum. `found` and `gaps` are what a file gave and why another gave nothing.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plenaria import schema
from plenaria.functions.text import word_count

# Patterns of the sources. (?U) gives blanks and word ends their Unicode meaning, (?d) lines end with \n only.
ITALIAN_DAY = r"(?iU)\bdi\s+\w+\s+(\d{1,2})\s+([a-zà]+)\s+(\d{4})\b"
ITALIAN_PERSON = r"(?iU)scheda personale:\s*(.+)$"
PARTY_AT_END = r"(?U)\s*\(([^()]*)\)\s*$"
SPANISH_TURN = r"(?mdU)^[ \t]*(?:La señora|El señor)\s+([A-ZÁÉÍÓÚÜÑÀÈÌÒÙÇ][^:\n]{1,105}):\s*"
SPANISH_OPENING = r"(?iU)Se (?:abre|reanuda) la sesión\b"
SPANISH_CUE = r"(?iU)\((?:(?:Continúan|Se producen) los? )?(?:Aplausos|Rumores|Risas|Protestas|Pausa)[^()]*\)"
PAGE_IN_TEXT = r"(?U)\bPágina\s+\d+\b"
ROLL_CALL = r"(?U)\bSECRETARI[OA]\s+DE\s+LA\s+MESA"
LINE_PREFIX = r"(?iU)^\s*(La\s*señora|El\s*señor)\b"
LINE_OPENING = r"(?iU)\bSe\s+(?:abre|reanuda)\s+la\s+sesi[oó]n\b"
LINE_PAGE = r"(?iU)^\s*(?:Página|Pag\.)\s*\d*\s*$"
LINE_FURNITURE = r"(?iU)DIARIO DE SESIONES|PLENO Y DIPUTACIÓN PERMANENTE|^NÚM\.|^PÁG\.|^CVE:"
LINE_CUE = (
    r"^\s*(?:(?:Continúan|Se producen) los? )?(?:Aplausos|Rumores|Risas|Protestas|Pausa|Prolongados aplausos|Varios (?:señores|señoras) diputados|"
    r"El señor [^)]+ pronuncia palabras|Comienza su intervención)"
)
NUMERIC_DAY = r"\b(\d{2}/\d{2}/\d{4})\b"
SPANISH_DAY = r"(?iU)\b(\d{1,2})\s+de\s+(enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre)\s+de\s+(\d{4})\b"
# Months, and a second name of one.
ITALIAN_MONTHS = ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre")
SPANISH_MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
SECOND_NAMES = {"setiembre": "septiembre"}
# Lines of the body lie between these heights, labels from this place on; a label has that many more lines at
# most, and a heading that share of capitals.
LOWEST, HIGHEST, LABEL_X, LABEL_LINES, CAPITALS = 55.0, 735.0, 50.0, 8, 0.82

SPLIT, LABEL_END = "\u0001", "\u0002"
squeezed = lambda c: F.trim(F.regexp_replace(c, r"(?U)[\s\p{Z}]+", " "))


def day_of(text: Column, pattern: str, months: tuple[str, ...]) -> Column:
    """ISO day of the first date in words; null without one, an error for an unknown month."""
    part = lambda k: F.regexp_extract(text, pattern, k)
    name = F.lower(part(2))
    for second, first in SECOND_NAMES.items():
        name = F.when(name == second, first).otherwise(name)
    month = F.array_position(F.array(*map(F.lit, months)), name)
    return F.when(text.rlike(pattern), F.date_format(F.try_to_date(F.format_string("%s-%02d-%02d", part(3), month, part(1).cast("int")), "yyyy-MM-dd"), "yyyy-MM-dd"))


def numeric_day(text: Column) -> Column:
    found = F.regexp_extract(text, NUMERIC_DAY, 1)
    return F.when(found != "", F.date_format(F.try_to_date(found, "dd/MM/yyyy"), "yyyy-MM-dd"))


def speeches(rows: DataFrame, country: str, made: dict[str, Column]) -> DataFrame:
    """The speech columns of rows: those made, the country's own, '' for the others."""
    house = F.lit(schema.PARLIAMENT[country])
    fixed = {"country": F.lit(country), "parliament": house, "chamber": house, "text_language": F.lit(schema.LANGUAGE[country]), "word_count": word_count(made["speech_text"])}
    every = {"source_identifier": made["speech_id"]} | fixed | made
    return rows.select(*[F.coalesce(every[c], F.lit("" if c != "word_count" else 0)).alias(c) if c in every else F.lit("").alias(c) for c in schema.SPEECH_COLUMNS])


def opened(files: DataFrame, take, ddl: str) -> DataFrame:
    """files (path, content, known) with the pieces that take(content) gives: path, known and the columns of ddl. A file that
    can't be taken to pieces has none."""
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    pieces = take(row["content"])
                except (ValueError, KeyError, TypeError):
                    continue
                if pieces:
                    columns = [pa.array([row[c]] * len(pieces), pa.string()) for c in ("path", "known")]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array([p[n] for p in pieces]) for n in names)], names=["path", "known", *names])

    return files.select("path", "content", "known").mapInArrow(run, f"path string, known string, {ddl}")


def known(name: str, of: str = "known") -> Column:
    return F.get_json_object(of, f"$.{name}")


# pages --------------------------------------------------------------------------------------------------------------
class Nodes(HTMLParser):
    """The nodes of a page in order: (+tag, -tag or '', text or '', attributes)."""

    def __init__(self, data: bytes) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[str, str, dict[str, str]]] = []
        self.feed((data or b"").decode("utf-8", "replace"))
        self.close()

    def handle_starttag(self, tag, attrs):
        self.nodes.append((f"+{tag}", "", {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.nodes.append((f"-{tag}", "", {}))

    def handle_data(self, data):
        self.nodes.append(("", data, {}))


def _paragraphs(data: bytes) -> list[dict]:
    """Paragraphs with their text, class, id, and the text, title and address of their first link."""
    out: list[dict] = []
    inside = link = False
    for tag, text, attrs in Nodes(data).nodes:
        if tag == "+p":
            out.append({"place": len(out), "text": "", "kind": attrs.get("class", ""), "id": attrs.get("id", ""), "label": None, "title": "", "href": ""})
            inside, link = True, False
        elif tag == "-p":
            inside = False
        elif inside and tag == "+a" and out[-1]["label"] is None:
            out[-1] |= {"label": "", "title": attrs.get("title", ""), "href": attrs.get("href", "")}
            link = True
        elif tag in ("-a", "+a"):
            link = False
        elif inside and (not tag or tag == "+br"):
            out[-1]["text"] += text or " "
            if link:
                out[-1]["label"] += text
    return [p | {"label": p["label"] or ""} for p in out]


def italian_pages(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interventions of Italian sitting pages. known: term, number, source_url. The first link of an intervention names its
    speaker, and is left out of the speech."""
    rows = opened(files, _paragraphs, "place bigint, text string, kind string, id string, label string, title string, href string")
    rows = rows.withColumns({"text": squeezed(F.col("text")), "label": squeezed(F.col("label")), "day": day_of(F.col("text"), ITALIAN_DAY, ITALIAN_MONTHS)})
    days = rows.where("day IS NOT NULL").groupBy("path").agg(F.min_by("day", "place").alias("_day"))
    who = F.coalesce(F.nullif(F.trim(F.regexp_extract("title", ITALIAN_PERSON, 1)), F.lit("")), F.col("label"))
    led = (F.col("label") != "") & F.startswith(F.lower("text"), F.lower("label"))
    clean = F.when(led, F.ltrim(F.expr("substring(text, char_length(label) + 1)"), F.lit(" .:–-\t"))).otherwise(F.col("text"))
    said = rows.where(F.array_contains(F.split("kind", r"\s+"), "intervento")).withColumns({"who": who, "clean": clean}).where("text <> '' AND who <> '' AND clean <> ''")
    number = F.row_number().over(Window.partitionBy("path").orderBy("place"))
    said = said.withColumn("id", F.when(F.col("id") != "", F.col("id")).otherwise(F.concat(F.lit("intervento-"), number))).join(days, "path")
    session = F.concat(F.lit("camera-leg"), known("term"), F.lit("-sed"), known("number"))
    person = F.regexp_extract("href", r"[?&]idPersona=([^&#]*)", 1)
    found = speeches(
        said,
        "Italy",
        {
            "date": F.col("_day"), "session_id": session, "speech_id": F.concat(session, F.lit(":"), "id"), "speaker_id": person, "speaker_name": F.col("who"),
            "party": F.regexp_extract("label", PARTY_AT_END, 1), "speaker_role": F.when(F.startswith(F.lower("label"), F.lit("presidente")), schema.CHAIR_TOKEN).otherwise("floor_speaker"),
            "legislative_term": known("term"), "speech_text": F.col("clean"), "raw_text": F.col("text"), "source_url": known("source_url"),
            "source_type": F.lit("official_camera_stenographic_html"), "cleaning_notes": F.when(F.col("clean") != F.col("text"), "speaker label removed").otherwise(""),
        },
    )
    gaps = files.select("path").join(days, "path", "left_anti").select("path", F.lit("the page has no date of its sitting").alias("failure"))
    return found, gaps


def _journal(data: bytes) -> list[dict]:
    """What stands in the date field of a Spanish journal page, and its full text (null without one)."""
    dated, text, reading, in_date = [], [], False, False
    for tag, piece, attrs in Nodes(data).nodes:
        names = attrs.get("class", "").split()
        if tag == "+p" and "textoCompleto" in names:
            reading = True
        elif tag == "+div" and "datos1" in names:
            in_date = True
        elif tag == "-div":
            reading, in_date = reading and in_date, False
        if in_date and not tag:
            dated.append(piece)
        if reading and (not tag or tag in ("+br", "+p", "-p")):
            text.append(piece or "\n")
    return [{"dated": " ".join(dated), "text": "".join(text)}]


def journal_pages(files: DataFrame) -> DataFrame:
    """Spanish journal pages with day, openings (the pieces of the text, each but the first with an opening before it) and
    full_text: whether the page has a text and a date field."""
    rows = opened(files, _journal, "dated string, text string")
    pieces = F.split(F.regexp_replace("text", SPANISH_OPENING, f"{SPLIT}$0"), SPLIT)
    return rows.withColumns({"day": numeric_day(F.col("dated")), "pieces": pieces, "full_text": (F.col("text") != "") & (F.trim("dated") != "")})


def journal_name() -> Column:
    return F.concat(F.lit("DSCD-"), F.coalesce(known("term"), F.lit("?")), F.lit("-PL-"), F.coalesce(known("number"), F.lit("?")))


def spanish_pages(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of Spanish journal pages. known: term, number, source_url.

    The debate begins at the second opening (the synopsis repeats the first), or at the only one. A turn is what stands between
    two labels. Roll calls and turns without words keep their number, but give no row.
    """
    pages = journal_pages(files)
    name = journal_name()
    times, before = F.size("pieces") - 1, F.element_at("pieces", 1)
    synopsis = before.contains("SUMARIO") | (before.contains("ORDEN DEL DÍA") & (times > 1))
    debate = F.array_join(F.slice("pieces", F.when(times > 1, 3).otherwise(2), F.size("pieces")), "")
    marked = F.split(F.regexp_replace(debate, SPANISH_TURN, f"{SPLIT}$1{LABEL_END}"), SPLIT)
    pages = pages.withColumn("turns", marked).withColumn(
        "failure",
        F.when(F.col("day").isNull() | (F.col("text") == ""), F.concat(name, F.lit(" has no full text or date")))
        .when((times < 1) | ~synopsis, F.concat(F.lit("no debate after the synopsis in "), name))
        .when(F.size("turns") < 2, F.concat(F.lit("no speaker labels in "), name)),
    )
    turns = pages.where("failure IS NULL").select("path", "known", "day", F.posexplode("turns").alias("number", "turn")).where("number > 0")
    turns = turns.withColumns({"label": squeezed(F.substring_index("turn", LABEL_END, 1)), "raw": squeezed(F.element_at(F.split("turn", LABEL_END), 2))})
    clean = squeezed(F.regexp_replace(F.regexp_replace("raw", PAGE_IN_TEXT, " "), SPANISH_CUE, " "))
    turns = turns.withColumn("clean", clean).where((F.col("clean") != "") & ~F.col("label").rlike(ROLL_CALL))
    role = F.when(F.col("label").contains("PRESIDENT"), schema.CHAIR_TOKEN).when(F.col("label").contains("MINISTR"), "minister").otherwise("")
    found = _spanish(turns, role, F.lit("official_congreso_diario_html"), F.lit("synopsis, page marks and audience cues removed"))
    return found, pages.where("failure IS NOT NULL").select("path", "failure")


def _spanish(turns: DataFrame, role: Column, kind: Column, notes: Column) -> DataFrame:
    """Speeches of numbered turns: known, day, number, label, raw, clean."""
    session = F.concat(F.lit("congreso-"), known("term"), F.lit("-PL-"), known("number"))
    made = {
        "date": F.col("day"), "session_id": session, "speech_id": F.concat(session, F.format_string(":turn-%04d", F.col("number"))), "speaker_name": F.col("label"), "speaker_role": role,
        "legislative_term": known("term"), "speech_text": F.col("clean"), "raw_text": F.col("raw"), "source_url": known("source_url"), "source_type": kind, "cleaning_notes": notes,
    }
    return speeches(turns, "Spain", made)


def usable(files: DataFrame) -> DataFrame:
    """What a journal file is good for: path, full_text (a page with text and date field), pdf (its content is a PDF), day."""
    pdf = F.hex(F.substring("content", 1, 4)) == "25504446"
    return journal_pages(files).join(files.select("path", F.coalesce(pdf, F.lit(False)).alias("pdf")), "path").select("path", "full_text", "pdf", "day")


# lines --------------------------------------------------------------------------------------------------------------
def _lines(data: bytes) -> list[dict]:
    """The lines of a journal given as JSON: [{page, y, x, text, bold}], or chunks with `order`."""
    from plenaria.sources.parsers import lines_of_chunks

    lines = json.loads(data)
    if lines and "order" in lines[0]:
        lines = lines_of_chunks(lines)
    return [{"place": k, "x": float(x["x"]), "y": float(x["y"]), "text": x["text"], "bold": bool(x["bold"])} for k, x in enumerate(lines)]


@F.pandas_udf(StringType())
def without_cues(text: pd.Series) -> pd.Series:
    """Text without bracketed audience cues, brackets inside of brackets included; an unclosed bracket stays."""
    cue = re.compile(LINE_CUE, re.I)

    def strip(t: str | None) -> str | None:
        if t is None or "(" not in t:
            return t
        depth = begin = done = 0
        out = []
        for m in re.finditer(r"[()]", t):
            if m.group() == "(":
                begin = begin if depth else m.start()
                depth += 1
            elif depth:
                depth -= 1
                if not depth and cue.match(t[begin + 1 : m.start()]):
                    out += [t[done:begin], " "]
                    done = m.end()
        return "".join([*out, t[done:]])

    return text.map(strip)


def tidy(text: Column) -> Column:
    """A body without soft hyphens and audience cues, with its blanks and marks put right."""
    out = squeezed(without_cues(F.replace(text, F.lit("­"), F.lit(""))))
    for pattern, into in ((r"(?U)\s+([,.;:!?])", "$1"), (r"([?!])\.+", "$1"), (r"\.{2,}", "."), (r"(?U)([¿¡])\s+", "$1")):
        out = F.regexp_replace(out, pattern, into)
    return F.trim(out)


def furniture() -> Column:
    """Whether a line is a page mark or what stands on every page."""
    return F.col("text").rlike(LINE_PAGE) | F.col("text").rlike(LINE_FURNITURE)


def heading() -> Column:
    """Whether a line is an agenda heading: bold, in the body, nearly all capitals."""
    letters = F.regexp_replace("text", r"[^\p{L}]", "")
    capitals = F.char_length(F.regexp_replace(letters, r"[^\p{Lu}]", ""))
    return F.col("bold") & (F.col("y") > LOWEST) & (F.col("y") < HIGHEST) & ~furniture() & (letters != "") & (capitals >= F.char_length(letters) * CAPITALS)


def spanish_lines(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of Spanish journals from their positioned lines. known: term, number, source_url, maybe date.

    A label is a bold line that begins with a form of address; it ends at its colon, a few lines below at most. A turn ends at
    the next label or at the first heading. A journal without opening, labels or date, with a label that doesn't end or with
    an empty turn is a gap as a whole.
    """
    name = journal_name()
    lines = opened(files.withColumn("known", F.to_json(F.map_concat(F.from_json(F.coalesce("known", F.lit("{}")), "map<string,string>"), F.create_map(F.lit("sha256"), F.sha2("content", 256))))), _lines, "place bigint, x double, y double, text string, bold boolean")
    of = Window.partitionBy("path")
    openings = F.array_sort(F.collect_list(F.when(F.col("text").rlike(LINE_OPENING), F.col("place"))).over(of))
    day = F.coalesce(numeric_day(F.col("text")), day_of(F.col("text"), SPANISH_DAY, SPANISH_MONTHS))
    lines = lines.withColumns({"begin": F.coalesce(F.get(openings, F.lit(1)), F.get(openings, F.lit(0))), "day": F.coalesce(known("date"), F.min_by(day, F.when(day.isNotNull(), F.col("place"))).over(of))})
    label = F.coalesce((F.col("place") >= F.col("begin")) & F.col("bold") & (F.col("x") >= LABEL_X) & F.col("text").rlike(LINE_PREFIX), F.lit(False))
    lines = lines.withColumn("turn", F.count_if(label).over(of.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    whole = lines.groupBy("path", "known").agg(F.max("turn").alias("turns"), F.max("begin").alias("begin"), F.max("day").alias("day"))
    # the parts of a turn: its label up to the colon, and the body up to the first heading
    part = Window.partitionBy("path", "turn")
    lines = lines.where("turn > 0").withColumn("text", F.when(F.col("place") == F.min("place").over(part), F.regexp_replace("text", LINE_PREFIX, "")).otherwise(F.col("text")))
    lines = lines.withColumn("first", F.min("place").over(part))
    near = F.col("text").contains(":") & (F.col("place") <= F.col("first") + LABEL_LINES)
    lines = lines.withColumn("colon", F.min(F.when(near, F.col("place"))).over(part))
    lines = lines.withColumn("stop", F.min(F.when(heading() & (F.col("place") > F.col("colon")), F.col("place"))).over(part))
    body = (F.col("place") > F.col("colon")) & (F.col("stop").isNull() | (F.col("place") < F.col("stop"))) & F.col("y").between(LOWEST, HIGHEST) & (F.trim("text") != "") & ~furniture()
    joined = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("place", "text")))), lambda s: s["text"]), " ")
    turns = lines.groupBy("path", "known", "day", F.col("turn").alias("number")).agg(joined(F.col("place") <= F.col("colon")).alias("head"), joined(body).alias("body"), F.max("colon").alias("colon"))
    turns = turns.withColumn("label", squeezed(F.substring_index("head", ":", 1))).withColumn("rest", F.trim(F.expr("substring(head, instr(head, ':') + 1)")))
    turns = turns.withColumn("raw", F.concat_ws(" ", F.nullif("rest", F.lit("")), F.nullif("body", F.lit(""))))
    turns = turns.withColumn("clean", tidy(F.col("raw"))).withColumn("wrong", F.when(F.col("colon").isNull(), "a speaker label has no end in ").when((F.col("label") == "") | (F.col("clean") == ""), "an empty turn in "))
    bad = turns.where("wrong IS NOT NULL").groupBy("path").agg(F.min_by("wrong", "number").alias("wrong"))
    judged = files.select("path", "known").join(whole.drop("known"), "path", "left").join(bad, "path", "left")
    failure = F.concat(F.when(F.col("begin").isNull(), "no opening in ").when(F.col("turns") < 1, "no speaker labels in ").when(F.col("day").isNull(), "no date in ").otherwise(F.col("wrong")), name)
    judged = judged.withColumn("failure", failure)
    kept = turns.join(judged.where("failure IS NULL").select("path"), "path", "left_semi")
    upper = F.upper("label")
    role = F.when(upper.contains("MINISTR"), "minister").when(upper.rlike(r"(?U)^(?:VICE)?PRESIDENT[EA]\b"), schema.CHAIR_TOKEN).otherwise("")
    notes = F.concat(F.lit("furniture, agenda and audience cues removed; SHA-256 of the lines "), known("sha256"))
    return _spanish(kept, role, F.lit("official_congreso_diario_pdf"), notes), judged.where("failure IS NOT NULL").select("path", "failure")
