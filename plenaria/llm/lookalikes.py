"""Problem 4: one consistent form for texts that look the same but differ in their characters.

The form: canonical composition (NFC), without invisible characters, every kind of blank as a space, full-width forms and
Latin ligatures as plain letters, hyphens that look like the common one as that one, and Greek or Cyrillic letters that
look like a Latin letter as that letter. Nothing that a reader sees changes: accents, case, punctuation, superscripts and
line ends stay. The work is done on whole Arrow batches as numpy arrays of code points: a table gather gives the length
and place of each character's expansion, a stable sort by combining class orders the marks, and vectorised rounds compose
the first, second, ... mark of all letters at once.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenaria.functions.deliveries import first_delivery
from plenaria.llm.codepoints import pieces, to_points, to_strings
from plenaria.runtime import cut, table

# Letters of other scripts and the Latin letters that they look like.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮӀԌԚԜаеѕіјорсухүӏԁһԛԝ"
CYRILLIC_AS = "ABESIJKMHOPCTYXYIGQWaesijopcyxyldhqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρϲϳϹͿ"
GREEK_AS = "ABEZHIKMNOPTYXovpcjCJ"
ARMENIAN, ARMENIAN_AS = "ՍՏՕՀհոսցօ", "USOZhnugo"
CHEROKEE, CHEROKEE_AS = "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEHJKLMPRSTVWZ"
# Characters without a look of their own.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]
# Blanks that look like a space, and hyphens that look like the common one.
BLANKS = [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
HYPHENS = [0x2010, 0x2011]
# Digraph letters that look like their two letters.
DIGRAPHS = {0x01C4: "DŽ", 0x01C5: "Dž", 0x01C6: "dž", 0x0132: "IJ", 0x0133: "ij", 0x01C7: "LJ", 0x01C8: "Lj", 0x01C9: "lj", 0x01CA: "NJ", 0x01CB: "Nj", 0x01CC: "nj"}
# Signs in full width.
WIDE_SIGNS = dict(zip("￠￡￢￤￥￦", "¢£¬¦¥₩", strict=True))
# Letters that are plain ones in another block: Roman numerals, and mathematical ones without serifs or of one width.
PLAIN = [*range(0x2160, 0x2180), *range(0x1D5A0, 0x1D5D4), *range(0x1D670, 0x1D6A4), *range(0x1D7E2, 0x1D7EC), *range(0x1D7F6, 0x1D800)]
SPACE = 0x0110000


def singles() -> dict[int, str]:
    """What each character that stands for others stands for."""
    pairs = [*zip(CYRILLIC, CYRILLIC_AS, strict=True), *zip(GREEK, GREEK_AS, strict=True), *zip(ARMENIAN, ARMENIAN_AS, strict=True), *zip(CHEROKEE, CHEROKEE_AS, strict=True), *WIDE_SIGNS.items()]
    out = {ord(a): b for a, b in pairs}
    out |= DIGRAPHS | dict.fromkeys(INVISIBLE, "") | dict.fromkeys(BLANKS, " ") | dict.fromkeys(HYPHENS, "-")
    out |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    whole = {c: unicodedata.normalize("NFKC", chr(c)) for c in [*range(0xFB00, 0xFB07), *PLAIN]}
    return out | {c: x for c, x in whole.items() if x.isascii()}


@functools.cache
def tables() -> dict[str, np.ndarray]:
    """Lookup tables over all code points: expansion place and length, combining class, and the sorted composition pairs."""
    single = singles()
    start, length, data = np.arange(SPACE, dtype=np.int32), np.ones(SPACE, np.uint8), []
    classes, pairs = np.zeros(SPACE, np.uint8), {}
    for c in range(0xA0, SPACE):
        if 0xAC00 <= c < 0xD7A4 or 0xD800 <= c < 0xE000:
            continue  # Hangul syllables are composed already; surrogates are no characters
        ch = chr(c)
        classes[c] = unicodedata.combining(ch)
        if c in single or unicodedata.decomposition(ch)[:1] not in ("", "<"):
            full = "".join(single.get(ord(x), x) for x in unicodedata.normalize("NFD", ch))
            if full != ch:
                start[c], length[c] = SPACE + len(data), len(full)
                data += map(ord, full)
        part = unicodedata.decomposition(ch).split()
        if len(part) == 2 and part[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
            pairs[int(part[0], 16) << 21 | int(part[1], 16)] = c
    keys = np.array(sorted(pairs), dtype=np.int64)
    values = np.array([pairs[k] for k in keys.tolist()], dtype=np.uint32)
    # the gather reads identity below SPACE and the expansions above it
    source = np.concatenate([np.arange(SPACE, dtype=np.uint32), np.array(data, dtype=np.uint32)])
    return {"start": start, "length": length, "source": source, "classes": classes, "keys": keys, "values": values}


def _compose(points: np.ndarray, rows: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """points in canonical order and composed; rows is the row of each point. Returns both without the absorbed marks."""
    classes = t["classes"][points]
    if not classes.any() and not ((points >= 0x900) & (points < 0x3100)).any():
        return points, rows
    # a run is a starter with the marks after it; a row's start begins a run too
    begins = (classes == 0) | (np.diff(rows, prepend=-1) != 0)
    run = np.cumsum(begins)
    unsorted = np.flatnonzero((np.diff(run) == 0) & (classes[1:] < classes[:-1]) & (classes[1:] > 0))
    if len(unsorted):
        order = np.argsort(run * 256 + classes, kind="stable")
        points, classes, rows = points[order], classes[order], rows[order]
    points, keep = points.copy(), np.ones(len(points), bool)
    heads = np.flatnonzero(begins)
    sizes = np.diff(np.append(heads, len(points)))
    last = np.zeros(len(heads), np.int16)
    live = np.flatnonzero((sizes > 1) & (classes[heads] == 0))
    turn = 1
    while len(live):
        head, mark = heads[live], heads[live] + turn
        key = points[head].astype(np.int64) << 21 | points[mark]
        at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        free = last[live] < classes[mark]
        fits = (t["keys"][at] == key) & free
        points[head[fits]] = t["values"][at[fits]]
        keep[mark[fits]] = False
        last[live[~fits]] = classes[mark[~fits]]
        turn += 1
        live = live[sizes[live] > turn]
    # starters that compose with the starter before them (Indic vowel signs and the like), left to right
    points, rows, classes = points[keep], rows[keep], classes[keep]
    while True:
        if len(points) < 2:
            return points, rows
        key = points[:-1].astype(np.int64) << 21 | points[1:]
        at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        fits = (t["keys"][at] == key) & (rows[1:] == rows[:-1]) & (classes[1:] == 0) & (classes[:-1] == 0)
        fits[1:] &= ~fits[:-1]
        if not fits.any():
            return points, rows
        first = np.flatnonzero(fits)
        points[first] = t["values"][at[first]]
        keep = np.ones(len(points), bool)
        keep[first + 1] = False
        points, rows, classes = points[keep], rows[keep], classes[keep]


def canonical_points(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of rows of code points."""
    t = tables()
    if not len(points) or points.max() < 0xA0:
        return points, offsets
    length = t["length"][points].astype(np.int64)
    ends = np.cumsum(length)
    start = t["start"][points].astype(np.int64)
    if ends[-1] == len(points) and (length == 1).all():
        out = t["source"][start]
    else:
        out = t["source"][np.repeat(start - (ends - length), length) + np.arange(ends[-1])]
    edge = np.concatenate([[0], ends])[offsets]
    if not len(out):
        return out, edge
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(edge))
    out, rows = _compose(out, rows, t)
    return out, np.searchsorted(rows, np.arange(len(offsets)))


def canonical_array(column: pa.Array) -> pa.Array:
    """The consistent form of an Arrow string column; null stays null."""
    points, offsets = to_points(column)
    valid = np.asarray(column.is_valid())
    return to_strings(*canonical_points(points, offsets), valid)


def canonical_text(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the consistent form of a string column as column `out`, added last (or in place, if `out` exists).

    Null stays null and empty stays empty; a text of invisible characters only becomes empty. Texts of any length are
    done whole. Repeated rows, extra columns and empty tables come through as they are. Rows aren't moved between tasks.
    """
    spot = df.columns.index(column)
    replaced = out in df.columns
    schema = df.schema if replaced else df.withColumn(out, F.lit(None).cast("string")).schema
    names = schema.names

    def convert(batches):
        for batch in batches:
            for part in pieces(batch, spot):
                cols = list(part.columns)
                text = canonical_array(part.column(spot))
                if replaced:
                    cols[names.index(out)] = text
                else:
                    cols.append(text)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(convert, schema)


def look_classes(speeches: DataFrame, key: str = "speech_id", text: str = "speech_text", at: str = "delivered_at") -> DataFrame:
    """One row per key: key, look (128 bits of the consistent form of its first delivery's text) and chars (of the text itself).

    Texts with equal look are equal to a reader; those of them with different chars differ in characters. Rows without key
    or text are left out. Only the two digests are shuffled, never the texts.
    """
    flat = speeches.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.col(text).alias("_text"))
    formed = canonical_text(flat, "_text", "_form").select(
        F.col("_key").alias(key), F.col("_at").alias(at), F.unhex(F.md5("_form")).alias("look"), F.unhex(F.md5("_text")).alias("chars")
    )
    first = first_delivery(formed, {"look": F.col("look"), "chars": F.col("chars")}, key, at)
    return first.where(F.col("look").isNotNull())


def same_look_pairs(classes: DataFrame, key: str = "speech_id") -> DataFrame:
    """Pairs of keys that look the same and differ in characters: {key}_a < {key}_b.

    Rows that are equal in characters are never paired with each other: the pairing is between the distinct character
    strings of a look, each then opened to its keys.
    """
    strings = classes.select("look", "chars").distinct()
    mixed = strings.groupBy("look").agg(F.count(F.lit(1)).alias("_kinds")).where("_kinds > 1").select("look")
    # all that follows is about the few looks with several strings
    classes = cut(classes.join(mixed, "look", "left_semi"))
    kinds = classes.select("look", "chars").distinct()
    one, two = kinds.select("look", F.col("chars").alias("_ca")), kinds.select("look", F.col("chars").alias("_cb"))
    a = classes.select("look", F.col(key).alias(f"{key}_a"), F.col("chars").alias("_ca"))
    b = classes.select("look", F.col(key).alias(f"{key}_b"), F.col("chars").alias("_cb"))
    unlike = one.join(two, "look").where("_ca != _cb")
    return unlike.join(a, ["look", "_ca"]).join(b, ["look", "_cb"]).where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")


def p4_found(spark, sf_dir):
    return same_look_pairs(cut(look_classes(table(spark, sf_dir, "speeches"))))


def p4_forms(spark, sf_dir):
    """The consistent form of every speech's text, as digest and length."""
    speeches = table(spark, sf_dir, "speeches").select("speech_id", "delivered_at", "speech_text")
    return canonical_text(speeches, "speech_text", "form").select(
        "speech_id", "delivered_at", F.md5("form").alias("form_md5"), F.char_length("form").cast("bigint").alias("form_chars")
    )


def p4_classes(spark, sf_dir):
    """Each speech with its look, and how many speeches and different character strings have that look."""
    classes = cut(look_classes(table(spark, sf_dir, "speeches")))
    kinds = classes.groupBy("look", "chars").agg(F.count(F.lit(1)).alias("_n")).groupBy("look").agg(F.sum("_n").alias("speeches"), F.count(F.lit(1)).alias("kinds"))
    return classes.join(kinds, "look").select("speech_id", F.lower(F.hex("look")).alias("look"), "speeches", "kinds")


def _sql() -> dict[str, str]:
    found = singles()
    one = {chr(c): x for c, x in found.items() if len(x) == 1}
    quoted = lambda x: x.replace("'", "''")
    form = f"translate(nfc_normalize(speech_text), '{quoted(''.join(one))}', '{quoted(''.join(one.values()))}')"
    form = f"regexp_replace({form}, '[{''.join(map(chr, INVISIBLE))}]', '', 'g')"
    for c, x in found.items():
        if len(x) > 1:
            form = f"replace({form}, '{chr(c)}', '{x}')"
    form = f"nfc_normalize({form})"
    forms = f"""
      WITH formed AS (SELECT speech_id, delivered_at, speech_text, {form} AS form FROM speeches WHERE speech_id IS NOT NULL)"""
    found = f"""{forms},
      first AS (SELECT speech_id, min({{'at': coalesce(delivered_at, TIMESTAMP '9999-12-31'), 'form': form, 'text': speech_text}}) AS f FROM formed GROUP BY speech_id)
      SELECT a.speech_id AS speech_id_a, b.speech_id AS speech_id_b FROM first a JOIN first b
        ON a.f.form = b.f.form AND a.f.text <> b.f.text AND a.speech_id < b.speech_id"""
    rows = f"{forms} SELECT speech_id, delivered_at, md5(form) AS form_md5, CAST(length(form) AS BIGINT) AS form_chars FROM formed"
    looks = f"""{forms},
      first AS (SELECT speech_id, min({{'at': coalesce(delivered_at, TIMESTAMP '9999-12-31'), 'form': form, 'text': speech_text}}) AS f FROM formed GROUP BY speech_id)
      SELECT speech_id, md5(f.form) AS look, count(*) OVER (PARTITION BY f.form) AS speeches, k.kinds AS kinds FROM first
      JOIN (SELECT f.form AS form, count(DISTINCT f.text) AS kinds FROM first GROUP BY f.form) k ON k.form = f.form"""
    return {"p4_found": found, "p4_forms": rows, "p4_classes": looks}


SQL = _sql()
