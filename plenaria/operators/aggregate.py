"""Word- and speech-weighted shares by country and period, with baselines, sensitivity and breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenaria import schema
from plenaria.functions.text import blank_to_null, exact, is_chair, is_minister, known_id, length_label, period, pseudonym, ratio

KINDS = ("month", "quarter", "year")


def _weight(rows: DataFrame) -> Column:
    """The sampling weight, 1 if there is none; it must be finite and positive."""
    if "sampling_weight" not in rows.columns:
        return F.lit(1.0)
    w = F.coalesce("sampling_weight", F.lit(1.0))
    return F.when((w > 0) & (w < float("inf")), w).otherwise(F.raise_error(F.lit("invalid sampling weight")))


def _weighted(rows: DataFrame) -> DataFrame:
    """rows with _w, _words and the weighted parts of all sums, as decimals: their sums are the same in any order."""
    w = _weight(rows)
    ww = F.col("words") * w
    return rows.withColumns({"_w": exact(w), "_ww": exact(ww), "_wa": exact(ww * F.col("ai")), "_wm": exact(ww * F.col("mixed")), "_sa": exact(w * F.col("ai")), "_sm": exact(w * F.col("mixed"))})


def _sums() -> list[Column]:
    total = lambda c: F.sum(c).cast("double")
    return [
        total("_w").alias("speeches"), F.count(F.lit(1)).alias("sampled_speeches"), total("_ww").alias("words"), total("_wa").alias("ai_words_estimate"),
        total("_wm").alias("mixed_words_estimate"), total("_sa").alias("_sa"), total("_sm").alias("_sm"),
    ]


def _shares() -> dict[str, Column]:
    return {
        "ai_word_share": ratio(F.col("ai_words_estimate"), F.col("words")),
        "mixed_word_share": ratio(F.col("mixed_words_estimate"), F.col("words")),
        "ai_plus_mixed_word_share": ratio(F.col("ai_words_estimate") + F.col("mixed_words_estimate"), F.col("words")),
        "ai_speech_weighted_share": ratio(F.col("_sa"), F.col("speeches")),
        "mixed_speech_weighted_share": ratio(F.col("_sm"), F.col("speeches")),
    }


def by_period(scored: DataFrame, kind: str = "month") -> DataFrame:
    """country, period, sums and shares. scored: country, day, words, ai, mixed, maybe sampling_weight; rows without day drop out."""
    rows = _weighted(scored.where(F.col("day").isNotNull())).withColumn("period", period(F.col("day"), kind))
    return rows.groupBy("country", "period").agg(*_sums()).withColumns(_shares()).drop("_sa", "_sm")


def by_periods(scored: DataFrame) -> DataFrame:
    """The same at all granularities in one pass by grouping sets: granularity comes first."""
    rows = _weighted(scored.where(F.col("day").isNotNull())).withColumns({k: period(F.col("day"), k) for k in KINDS})
    sets = [[F.col("country"), F.col(k)] for k in KINDS]
    wide = rows.groupingSets(sets, "country", *KINDS).agg(*_sums(), F.grouping("month").alias("_m"), F.grouping("quarter").alias("_q"))
    granularity = F.when(F.col("_m") == 0, "month").when(F.col("_q") == 0, "quarter").otherwise("year")
    named = wide.withColumns({"granularity": granularity, "period": F.coalesce(*KINDS)}).withColumns(_shares())
    return named.drop("_sa", "_sm", "_m", "_q", *KINDS)


def baseline(annual: DataFrame) -> DataFrame:
    return annual.where(F.col("period").cast("int").between(2018, 2021))


def group_label(year: Column) -> Column:
    return F.when(year <= 2021, "pre-LLM control").when(year == 2022, "transition").otherwise("post-ChatGPT")


def pre_post(annual: DataFrame) -> DataFrame:
    """The annual rows pooled before, at and after the transition year; groups without words are left out."""
    sums = ["speeches", "words", "ai_words_estimate", "mixed_words_estimate"]
    rows = annual.withColumn("period_group", group_label(F.col("period").cast("int")))
    pooled = rows.groupBy("country", "period_group").agg(*[F.sum(exact(F.col(c))).cast("double").alias(c) for c in sums]).where("words <> 0")
    both = F.col("ai_words_estimate") + F.col("mixed_words_estimate")
    return pooled.withColumns({"ai_word_share": ratio(F.col("ai_words_estimate"), F.col("words")), "ai_plus_mixed_word_share": ratio(both, F.col("words"))})


def sensitivity(scored: DataFrame) -> DataFrame:
    """Annual shares for each least length and excluded role, beside the country's own pooled early share.

    One scan: every row is opened to the cells of the grid that it belongs to. The early share is always that of the full
    corpus from 40 words. scored also has speaker_role and speaker_name.
    """
    roles = {"none": F.lit(False), "ministers": is_minister(F.col("speaker_role")), "chairs": is_chair(F.col("speaker_role"), F.col("speaker_name"))}
    cells = [F.when((F.col("words") >= n) & ~out, F.struct(F.lit(n).alias("min_words"), F.lit(r).alias("excluded_role"))) for n in (40, 100, 250) for r, out in roles.items()]
    rows = _weighted(scored.where(F.col("day").isNotNull())).withColumn("period", period(F.col("day"), "year"))
    rows = rows.withColumn("_cell", F.explode(F.array_compact(F.array(*cells)))).withColumns({"min_words": F.col("_cell.min_words"), "excluded_role": F.col("_cell.excluded_role")})
    grid = rows.groupBy("min_words", "excluded_role", "country", "period").agg(*_sums()).withColumns(_shares()).drop("_sa", "_sm")
    early = pre_post(grid.where("min_words = 40 AND excluded_role = 'none'")).where(F.col("period_group") == "pre-LLM control")
    early = early.select("country", F.col("ai_word_share").alias("historical_baseline_ai_share"))
    adjusted = F.when(F.col("historical_baseline_ai_share").isNotNull(), F.greatest(F.lit(0.0), F.col("ai_word_share") - F.col("historical_baseline_ai_share")))
    return grid.join(early, "country", "left").withColumn("baseline_adjusted_ai_share_sensitivity", adjusted)


def breakdowns(scored: DataFrame, min_speaker_speeches: int = 10) -> DataFrame:
    """Shares by party, term and length band a year, and by pseudonymous speaker over all time: dimension, country, period, group.

    Speakers of fewer than min_speaker_speeches speeches aren't shown, and in a weighted sample no speakers at all. scored
    also has party, legislative_term and speaker_id.
    """
    year = period(F.col("day"), "year")
    row = lambda name, p, g: F.struct(F.lit(name).alias("dimension"), p.alias("period"), g.alias("group"))
    kinds = [
        row("party", year, F.coalesce(blank_to_null(F.col("party")), F.lit(schema.UNKNOWN))),
        row("legislative_term", year, F.coalesce(F.nullif("legislative_term", F.lit("")), F.lit(schema.UNKNOWN))),
        row("length_band", year, length_label(F.col("words"))),
    ]
    if "sampling_weight" not in scored.columns:
        speaker = known_id(F.col("speaker_id"))
        kinds.append(F.when(speaker.isNotNull(), row("speaker", F.lit("all"), pseudonym(F.col("country"), speaker))))
    rows = _weighted(scored.where(F.col("day").isNotNull())).withColumn("_k", F.explode(F.array_compact(F.array(*kinds))))
    grouped = rows.groupBy("_k.dimension", "country", "_k.period", "_k.group").agg(*_sums()).withColumns(_shares())
    shown = (F.col("dimension") != "speaker") | (F.col("speeches") >= min_speaker_speeches)
    return grouped.where(shown).drop("_sa", "_sm", "sampled_speeches", "ai_words_estimate", "mixed_words_estimate", "mixed_speech_weighted_share")


def country_sizes(rows: DataFrame, dimension: DataFrame, min_words: int = 40) -> DataFrame:
    """Speeches and words of every country of the dimension, in all and of at least min_words; zeros for absent countries."""
    long_ = F.col("words") >= min_words
    sums = rows.groupBy("country").agg(
        F.count(F.lit(1)).alias("speeches"), F.sum("words").alias("words"), F.count_if(long_).alias("eligible_speeches"), F.sum(F.when(long_, F.col("words"))).alias("eligible_words")
    )
    names = ["speeches", "words", "eligible_speeches", "eligible_words"]
    return F.broadcast(dimension).join(sums, "country", "left").select("country", *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in names])
