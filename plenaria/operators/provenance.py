"""Source files: their types, addresses and manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Content types by suffix.
CONTENT_TYPES = {".zip": "application/zip", ".json": "application/json", ".html": "text/html", ".xml": "text/xml", ".pdf": "application/pdf"}
OTHER_TYPE = "application/octet-stream"
# Raw paths and the official addresses of their files; %s takes the groups in the given order, as a Roman numeral
# or in four digits where it says so.
ADDRESSES = (
    (r"^spain/.*term-(\d+)/DSCD-(\d+)-PL-(\d+)\.html$", "https://www.congreso.es/busqueda-de-intervenciones?p_p_id=intervenciones&p_p_lifecycle=0&p_p_state=normal&p_p_mode=view&_intervenciones_mode=mostrarTextoIntegro&_intervenciones_legislatura=%s&_intervenciones_id_texto=(DSCD-%s-PL-%s.CODI.)", ("roman 2", 2, 3)),
    (r"^spain/.*pdf-fallback/DSCD-(\d+)-PL-(\d+)\.PDF$", "https://www.congreso.es/public_oficiales/L%s/CONG/DS/PL/DSCD-%s-PL-%s.PDF", (1, 1, 2)),
    (r"^italy/leg(\d+)/sitting-(\d+)\.xml$", "https://documenti.camera.it/apps/commonServices/getDocumento.ashx?sezione=assemblea&tipoDoc=formato_xml&tipologia=stenografico&idNumero=%s&idLegislatura=%s", ("four 2", 1)),
    (r"^italy/leg(\d+)/sitting-(\d+)\.html$", "https://www.camera.it/leg%s/410?idSeduta=%s&tipo=stenografico", (1, 2)),
    (r"^netherlands/verslag/([^/]+)\.xml$", "https://gegevensmagazijn.tweedekamer.nl/OData/v4/2.0/Verslag(%s)/resource", (1,)),
    (r"^poland/term-(\d+)/proceedings\.json$", "https://api.sejm.gov.pl/sejm/term%s/proceedings", (1,)),
    (r"^poland/term-(\d+)/proceeding-(\d+)/(\d{4}-\d{2}-\d{2})/statements\.json$", "https://api.sejm.gov.pl/sejm/term%s/proceedings/%s/%s/transcripts", (1, 2, 3)),
    (r"^poland/term-(\d+)/proceeding-(\d+)/(\d{4}-\d{2}-\d{2})/statement-(\d+)\.html$", "https://api.sejm.gov.pl/sejm/term%s/proceedings/%s/%s/transcripts/%s", (1, 2, 3, 4)),
    (r"^france/.*legislature-(\d+)-syceron\.zip$", "https://data.assemblee-nationale.fr/static/openData/repository/%s/vp/syceronbrut/syseron.xml.zip", (1,)),
)
# Names of German archives and their records.
ARCHIVES = {
    "CPP-BT_2026-09-19_DE_CSV_Reden_Gesamt.zip": "22844952", "CPP-BT_2026-01-17_DE_CSV_Reden_Gesamt.zip": "18177196", "CPP-BT_2026-09-19_DE_CSV_Plenarprotokolle_Metadaten.zip": "22844952",
}
ARCHIVE_FOLDER, ARCHIVE_ADDRESS = "germany/cpp-bt/", "https://zenodo.org/api/records/%s/files/%s/content"
# Query keys that carry credentials.
SENSITIVE = ("apikey", "api_key", "access_token", "token", "key", "authorization", "secret")
ROMAN = {"12": "XII", "13": "XIII", "14": "XIV", "15": "XV"}


def content_type(path: Column) -> Column:
    """The type by the path's suffix in any letter case."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    out = F.when(suffix == ".zip", CONTENT_TYPES[".zip"])
    for k, v in CONTENT_TYPES.items():
        out = out.when(suffix == k, v)
    return out.otherwise(OTHER_TYPE)


def source_address(relative: Column) -> Column:
    """The official address of a raw file by its path, null if none is known."""
    def group(pattern: str, g: int | str) -> Column:
        if isinstance(g, int):
            return F.regexp_extract(relative, pattern, g)
        how, number = g.split()
        part = F.regexp_extract(relative, pattern, int(number))
        return F.lpad(part, 4, "0") if how == "four" else F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])[part]

    out = F.lit(None).cast("string")
    for pattern, form, groups in reversed(ADDRESSES):
        made = F.format_string(form, *[group(pattern, g) for g in groups])
        out = F.when(relative.rlike(pattern), made).otherwise(out)
    name = F.regexp_extract(relative, r"([^/]*)$", 1)
    record = F.create_map(*[F.lit(x) for pair in ARCHIVES.items() for x in pair])[name]
    return F.when(F.startswith(relative, F.lit(ARCHIVE_FOLDER)) & record.isNotNull(), F.format_string(ARCHIVE_ADDRESS, record, name)).otherwise(out)


def without_credentials(url: Column) -> Column:
    """The address without fragment and sensitive query parts."""
    base = F.regexp_replace(url, "#.*$", "")
    at = F.instr(base, "?")
    query = F.substring(base, at + 1, 1_000_000)
    parts = F.filter(F.split(query, "&"), lambda p: ~F.lower(F.substring_index(p, "=", 1)).isin(*SENSITIVE) & (p != ""))
    head = F.substring(base, F.lit(1), at - 1)
    return F.when(at == 0, base).when(F.size(parts) == 0, head).otherwise(F.concat(head, F.lit("?"), F.array_join(parts, "&")))


def query_part(url: Column, key: str) -> Column:
    return F.parse_url(url, F.lit("QUERY"), F.lit(key))


def last_entries(manifest: DataFrame, order: str = "retrieved_at_utc") -> DataFrame:
    """The last entry of every local_path. Entries without path are left out; combined on the map side."""
    rest = [c for c in manifest.columns if c not in ("local_path", order)]
    last = manifest.where("local_path IS NOT NULL").groupBy("local_path").agg(F.max(F.struct(order, *rest)).alias("e"))
    return last.select(*[F.col("local_path") if c == "local_path" else F.col(f"e.{c}").alias(c) for c in manifest.columns])


def reconcile(existing: DataFrame, current: DataFrame) -> DataFrame:
    """The manifest after a look at the files that are there.

    existing: manifest rows, one per path. current: source_url, retrieved_at_utc (the file's time), local_path, bytes, sha256,
    content_type. An unchanged file (same hash and address) keeps its time; a new or changed one gets the file's, and its basis
    says so. Rows of files that are gone stay. change: kept, new, changed or gone.
    """
    old = existing.select("local_path", *[F.col(c).alias(f"old_{c}") for c in existing.columns if c != "local_path"])
    new = current.select("local_path", *[F.col(c).alias(f"new_{c}") for c in current.columns if c != "local_path"], F.lit(True).alias("_there"))
    both = old.join(new, "local_path", "full_outer")
    there, known = F.coalesce("_there", F.lit(False)), F.col("old_sha256").isNotNull()
    same = there & known & F.col("old_retrieved_at_utc").isNotNull() & (F.col("old_sha256") == F.col("new_sha256")) & F.col("old_source_url").eqNullSafe(F.col("new_source_url"))
    change = F.when(~there, "gone").when(same, "kept").when(known, "changed").otherwise("new")
    pick = lambda c: F.when(there, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c)
    time = F.when(there & ~same, F.col("new_retrieved_at_utc")).otherwise(F.col("old_retrieved_at_utc")).alias("retrieved_at_utc")
    basis = F.when(there & ~same, "file_mtime").when(there, F.lit(None).cast("string")).otherwise(F.col("old_retrieved_at_utc_basis")).alias("retrieved_at_utc_basis")
    status = F.when(there & F.col("new_source_url").isNull(), "unresolved_source_url").when(~there, F.col("old_provenance_status")).alias("provenance_status")
    return both.select("local_path", pick("source_url"), time, pick("bytes"), pick("sha256"), pick("content_type"), basis, status, change.alias("change"))
