"""Synthetic passages that a detector must find, kept apart from real speeches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenaria import schema
from plenaria.functions.countries import COUNTRIES
from plenaria.functions.text import blank_to_null, ratio, word_count

SOURCE_TYPE, ID_PREFIX = "synthetic_llm", "positive-control-"
REQUIRED = ("country", "text_language", "generator", "prompt_id", "text")
FORBIDDEN = ("source_url", "speaker_id", "party", "source_identifier")


def brief(country: str) -> dict:
    """What a passage for a country must be like."""
    if country not in COUNTRIES:
        raise ValueError(f"unknown country {country!r}; expected one of {', '.join(COUNTRIES)}")
    language, parliament = schema.LANGUAGE[country], schema.PARLIAMENT[country]
    return {
        "country": country,
        "text_language": language,
        "parliament": parliament,
        "task": f"Three invented plenary speeches for the {parliament} in {language.upper()}: a government statement, a reply of the opposition, a committee report.",
        "requirements": [
            "150 to 400 words each, all by a language model of today",
            "the tone of the house, addressed to the chair",
            "invented names, dates and papers",
            "no stage directions and no speaker labels",
            "model, version, prompt id and UTC date on record",
        ],
        "separation_rule": f"Kept as rows of source_type '{SOURCE_TYPE}' with ids that begin with '{ID_PREFIX}', never in a corpus file.",
    }


def problem(columns: list[str]) -> Column:
    """What is wrong with a raw passage, null if nothing is."""
    get = lambda c: blank_to_null(F.col(c)) if c in columns else F.lit(None).cast("string")
    text = F.coalesce(get("text"), get("speech_text"))
    missing = F.filter(F.array(*[F.when((text if c == "text" else get(c)).isNull(), F.lit(c)) for c in REQUIRED]), lambda x: x.isNotNull())
    language = F.create_map(*[F.lit(x) for pair in schema.LANGUAGE.items() for x in pair])[get("country")]
    out = F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    out = out.when(~get("country").isin(*COUNTRIES), "unknown country").when(get("text_language") != language, "language does not match country")
    for c in FORBIDDEN:
        out = out.when(get(c).isNotNull(), f"{c} must stay empty")
    return out.when(word_count(text) < 1, "text contains no words")


def normalize(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid passages in the speech schema with generator and prompt_id, and the others with their problem."""
    judged = passages.withColumn("problem", problem(passages.columns))
    text = F.coalesce(*[blank_to_null(F.col(c)) for c in ("text", "speech_text") if c in passages.columns])
    language = F.create_map(*[F.lit(x) for pair in schema.LANGUAGE.items() for x in pair])
    house = F.create_map(*[F.lit(x) for pair in schema.PARLIAMENT.items() for x in pair])
    date = F.coalesce("date", F.date_format(F.current_date(), "yyyy-MM-dd")) if "date" in passages.columns else F.date_format(F.current_date(), "yyyy-MM-dd")
    made = {
        "parliament": house[F.col("country")], "chamber": house[F.col("country")], "date": date, "session_id": F.lit("positive-control-session"),
        "speech_id": F.concat(F.lit(ID_PREFIX), language[F.col("country")], F.lit("-"), F.col("prompt_id")), "speaker_name": F.lit("Synthetic LLM passage"),
        "speaker_role": F.lit("synthetic control"), "speech_text": text, "raw_text": text, "word_count": word_count(text), "source_type": F.lit(SOURCE_TYPE),
        "record_status": F.lit("synthetic"), "cleaning_notes": F.lit("Synthetic positive control; not parliamentary data."),
    }
    kept = ("country", "text_language")
    columns = [made[c].alias(c) if c in made else F.col(c) if c in kept else F.lit("").alias(c) for c in schema.SPEECH_COLUMNS]
    good = judged.where("problem IS NULL").select(*columns, "generator", "prompt_id", F.lit(True).alias("synthetic_control"))
    return good, judged.where("problem IS NOT NULL")


def missing_countries(controls: DataFrame) -> DataFrame:
    every = controls.sparkSession.createDataFrame([(c,) for c in COUNTRIES], "country string")
    return every.join(controls.select("country").distinct(), "country", "left_anti")


def detections(controls: DataFrame, responses: DataFrame) -> DataFrame:
    """Per passage: the raw fractions of its response (not its windows) and whether they reach one half together."""
    joined = controls.join(responses.select("speech_id", F.coalesce("fraction_ai", F.lit(0.0)).alias("ai_fraction"), F.coalesce("fraction_ai_assisted", F.lit(0.0)).alias("mixed_fraction")), "speech_id")
    return joined.select("country", "text_language", "speech_id", "generator", F.col("word_count").alias("words"), "ai_fraction", "mixed_fraction", (F.col("ai_fraction") + F.col("mixed_fraction") >= 0.5).alias("detected_ai"))


def detection_summary(found: DataFrame) -> DataFrame:
    """Per country and language: passages, detected, detection_rate, mean_ai_fraction."""
    sums = found.groupBy("country", "text_language").agg(
        F.count(F.lit(1)).alias("passages"), F.count_if("detected_ai").alias("detected"), F.sum(F.round("ai_fraction", 9).cast("decimal(18,9)")).cast("double").alias("_s")
    )
    return sums.withColumns({"detection_rate": ratio(F.col("detected"), F.col("passages")), "mean_ai_fraction": ratio(F.col("_s"), F.col("passages"))}).drop("_s")
