"""The queries of the core and their SQL, for __spark_entry__."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria import catalogue_sources, catalogue_transport, schema
from plenaria.functions import text as T
from plenaria.functions.countries import CODES, COUNTRIES, country_name
from plenaria.operators import aggregate, controls, corpus, cost, provenance, quality, review, sampling, scoring
from plenaria.runtime import cut, table
from plenaria.sources import files, parsers
from plenaria.streaming import queries as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _corpus(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return corpus.corpus(table(spark, d, "speeches"), *columns)


def _scored(spark: SparkSession, d: str, *more: str) -> DataFrame:
    rows = _corpus(spark, d, "country", "day", "words", *more).where("words >= 40 AND day IS NOT NULL")
    return scoring.score(rows, scoring.latest_responses(table(spark, d, "detector_responses")))


def _mocked(spark: SparkSession, d: str, *more: str) -> DataFrame:
    rows = _corpus(spark, d, "country", "day", "words", *more).where("words >= 40 AND day IS NOT NULL")
    return scoring.score(rows, scoring.mock_shares(F.col("speech_id")))


# SQL that the queries share -------------------------------------------------------------------------------------------
_NAMES = " ".join(f"WHEN upper(trim(country)) IN ('{n.upper()}', '{c}') THEN '{n}'" for c, n in CODES.items())
_COUNTRY = f"CASE {_NAMES} ELSE country END"
_WORDS = r"len(regexp_extract_all(speech_text, '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*'))"
_DAY = r"""coalesce(CASE WHEN regexp_matches(trim(date), '^\d{4}-\d{2}-\d{2}([T ].*)?$') THEN try_cast(substr(trim(date), 1, 10) AS DATE) END,
    CASE WHEN regexp_matches(trim(date), '^\d{4}/\d{1,2}/\d{1,2}$') THEN CAST(try_strptime(trim(date), '%Y/%m/%d') AS DATE) END,
    CASE WHEN regexp_matches(trim(date), '^\d{8}$') THEN CAST(try_strptime(trim(date), '%Y%m%d') AS DATE) END,
    CASE WHEN regexp_matches(trim(date), '^\d{1,2}[./-]\d{1,2}[./-]\d{4}$')
         THEN CAST(try_strptime(replace(replace(trim(date), '.', '/'), '-', '/'), '%d/%m/%Y') AS DATE) END)"""
_CORPUS = f"""
  raw AS (SELECT speech_id, coalesce(delivered_at, TIMESTAMP '9999-12-31') AS first_at, {_COUNTRY} AS country, {_DAY} AS day, CAST(coalesce({_WORDS}, 0) AS INTEGER) AS words,
            speaker_id, speaker_name, speaker_role, party, legislative_term, sha256(speech_text) AS digest FROM speeches WHERE speech_id IS NOT NULL),
  corpus AS (SELECT * EXCLUDE (rn, first_at) FROM (SELECT *, row_number() OVER (PARTITION BY speech_id ORDER BY first_at) AS rn FROM raw) WHERE rn = 1)"""
_QUOTED = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
_LABEL = r"trim(regexp_replace(lower(coalesce(w.label, '')), '[^a-z0-9]+', '-', 'g'), '-')"
_RESPONSES = f"""
  usable AS (SELECT *, coalesce(windows, []) AS ws FROM detector_responses
             WHERE stage = 'complete' AND error IS NULL AND speech_id IS NOT NULL AND fraction_ai IS NOT NULL AND fraction_ai_assisted IS NOT NULL),
  sums AS (SELECT speech_id, scored_at, fraction_ai, fraction_ai_assisted,
             coalesce(list_sum([coalesce(w.word_count, 0) FOR w IN ws]), 0) AS n,
             coalesce(list_sum([coalesce(w.word_count, 0) FOR w IN ws IF {_LABEL} IN ({_QUOTED(schema.AI_LABELS)})]), 0) AS a,
             coalesce(list_sum([coalesce(w.word_count, 0) FOR w IN ws IF {_LABEL} IN ({_QUOTED(schema.MIXED_LABELS)})]), 0) AS m,
             len([1 FOR w IN ws IF {_LABEL} NOT IN ({_QUOTED(schema.AI_LABELS + schema.MIXED_LABELS + schema.HUMAN_LABELS)})]) AS u FROM usable),
  rated AS (SELECT speech_id, scored_at, CASE WHEN n > 0 AND u = 0 THEN CAST(a AS DOUBLE) / n ELSE fraction_ai END AS ai,
              CASE WHEN n > 0 AND u = 0 THEN CAST(m AS DOUBLE) / n ELSE fraction_ai_assisted END AS mixed FROM sums),
  responses AS (SELECT speech_id, r.ai AS ai, r.mixed AS mixed FROM (SELECT speech_id, max({{'at': scored_at, 'ai': ai, 'mixed': mixed}}) AS r FROM rated GROUP BY speech_id))"""
_SCORED = f"""{_CORPUS}, {_RESPONSES},
  scored AS (SELECT c.*, r.ai, r.mixed FROM corpus c JOIN responses r USING (speech_id) WHERE c.words >= 40 AND c.day IS NOT NULL)"""
_EX = lambda x: f"CAST(sum(CAST(round({x}, 9) AS DECIMAL(18,9))) AS DOUBLE)"
_SUMS = f"""CAST(count(*) AS DOUBLE) AS speeches, count(*) AS sampled_speeches, CAST(sum(words) AS DOUBLE) AS words,
    {_EX('words * ai')} AS ai_words_estimate, {_EX('words * mixed')} AS mixed_words_estimate, {_EX('ai')} AS sa, {_EX('mixed')} AS sm"""
_SHARES = """coalesce(ai_words_estimate / words, 0) AS ai_word_share, coalesce(mixed_words_estimate / words, 0) AS mixed_word_share,
    coalesce((ai_words_estimate + mixed_words_estimate) / words, 0) AS ai_plus_mixed_word_share, coalesce(sa / speeches, 0) AS ai_speech_weighted_share,
    coalesce(sm / speeches, 0) AS mixed_speech_weighted_share"""
_PERIOD = {"year": "strftime(day, '%Y')", "quarter": "strftime(day, '%Y') || '-Q' || quarter(day)", "month": "strftime(day, '%Y-%m')"}


def _by(kind: str) -> str:
    return f"""WITH {_SCORED}, g AS (SELECT country, {_PERIOD[kind]} AS period, {_SUMS} FROM scored GROUP BY ALL)
      SELECT * EXCLUDE (sa, sm), {_SHARES} FROM g"""


_ANNUAL = f"""{_SCORED}, g AS (SELECT country, {_PERIOD['year']} AS period, {_SUMS} FROM scored GROUP BY ALL),
  annual AS (SELECT * EXCLUDE (sa, sm), {_SHARES} FROM g)"""
_POOL = f"""period_group, {_EX('speeches')} AS speeches, {_EX('words')} AS words, {_EX('ai_words_estimate')} AS ai_words_estimate, {_EX('mixed_words_estimate')} AS mixed_words_estimate"""
_GROUP = "CASE WHEN CAST(period AS INTEGER) <= 2021 THEN 'pre-LLM control' WHEN CAST(period AS INTEGER) = 2022 THEN 'transition' ELSE 'post-ChatGPT' END AS period_group"
_FOLD = lambda x: f"replace(lower({x}), 'ß', 'ss')"
_ROLE = f"""trim(replace({_FOLD("coalesce(speaker_role, '')")}, '’', ''''))"""
_NAME = f"""trim(replace({_FOLD("coalesce(speaker_name, '')")}, '’', ''''))"""
_ANYOF = lambda f, x, ms: "(" + " OR ".join(f"{f}({x}, '{m.replace(chr(39), chr(39) * 2)}')" for m in ms) + ")"
_MINISTER = _ANYOF("contains", _ROLE, schema.MINISTER_MARKERS)
_CHAIR = f"""CASE WHEN {_ROLE} = '{schema.CHAIR_TOKEN}' THEN true WHEN contains({_ROLE}, '{schema.HEAD_OF_STATE_GOVERNMENT}') THEN false
  WHEN {_ANYOF('contains', _ROLE, schema.CHAIR_ROLE_MARKERS)} THEN true
  ELSE {_ANYOF('starts_with', _NAME, schema.CHAIR_NAME_PREFIXES)} OR {_ANYOF('contains', _NAME, schema.CHAIR_NAME_MARKERS)} END"""
_KNOWN_ID = f"CASE WHEN trim(speaker_id) <> '' AND lower(trim(speaker_id)) NOT IN ({_QUOTED(schema.MISSING_IDS)}) THEN trim(speaker_id) END"
_UNITS = "CAST(ceil(words / 100.0) AS BIGINT)"


def _cost(where: str) -> str:
    return f"""WITH {_CORPUS} SELECT coalesce(country, 'TOTAL') AS country, count(*) AS speeches, CAST(coalesce(sum(words), 0) AS BIGINT) AS words,
        CAST(coalesce(sum({_UNITS}), 0) AS BIGINT) AS estimated_api_units, CAST(coalesce(sum({_UNITS}), 0) AS DOUBLE) * 100 * 0.5 / 1000 AS estimated_cost
      FROM corpus WHERE words >= 40 AND {where} GROUP BY ROLLUP (country)"""


# sizes and costs ------------------------------------------------------------------------------------------------------
@query(
    f"""WITH {_CORPUS}, d(country) AS (VALUES {', '.join(f"('{c}')" for c in COUNTRIES)})
    SELECT d.country AS country, count(c.speech_id) AS speeches, CAST(coalesce(sum(words), 0) AS BIGINT) AS words,
      count(*) FILTER (WHERE words >= 40) AS eligible_speeches, CAST(coalesce(sum(words) FILTER (WHERE words >= 40), 0) AS BIGINT) AS eligible_words
    FROM d LEFT JOIN corpus c ON c.country = d.country GROUP BY d.country"""
)
def corpus_size(spark, d):
    return aggregate.country_sizes(_corpus(spark, d, "country", "words"), corpus.dimension(spark))


@query(_cost("true"))
def cost_by_country(spark, d):
    return cost.estimate_cost(corpus.filtered(_corpus(spark, d, "country", "words")))


@query(_cost("country = 'Germany' AND year(day) IN (2019, 2024)"))
def cost_filtered(spark, d):
    return cost.estimate_cost(corpus.filtered(_corpus(spark, d, "country", "day", "words"), "Germany", [2019, 2024]))


@query(_cost("year(day) <= 2021"))
def cost_historical(spark, d):
    return cost.estimate_cost(corpus.filtered(_corpus(spark, d, "country", "day", "words"), period="historical"))


@query(_cost("year(day) >= 2023"))
def cost_post(spark, d):
    return cost.estimate_cost(corpus.filtered(_corpus(spark, d, "country", "day", "words"), period="post"))


# shares ---------------------------------------------------------------------------------------------------------------
@query(_by("month"))
def agg_month(spark, d):
    return aggregate.by_period(_scored(spark, d), "month")


@query(_by("quarter"))
def agg_quarter(spark, d):
    return aggregate.by_period(_scored(spark, d), "quarter")


@query(_by("year"))
def agg_year(spark, d):
    return aggregate.by_period(_scored(spark, d), "year")


@query(
    f"""WITH {_SCORED}, g AS ({' UNION ALL '.join(f"SELECT country, '{k}' AS granularity, {p} AS period, {_SUMS} FROM scored GROUP BY ALL" for k, p in _PERIOD.items())})
    SELECT * EXCLUDE (sa, sm), {_SHARES} FROM g"""
)
def agg_grouping_sets(spark, d):
    return aggregate.by_periods(_scored(spark, d))


@query(
    f"""WITH {_CORPUS}, scored AS (SELECT *, (CAST('0x' || substr(sha256(speech_id), 1, 2) AS BIGINT) % 16) / 100.0::DOUBLE AS ai,
        (CAST('0x' || substr(sha256(speech_id), 3, 2) AS BIGINT) % 11) / 100.0::DOUBLE AS mixed FROM corpus WHERE words >= 40 AND day IS NOT NULL),
      g AS (SELECT country, {_PERIOD['year']} AS period, {_SUMS} FROM scored GROUP BY ALL) SELECT * EXCLUDE (sa, sm), {_SHARES} FROM g"""
)
def agg_mock_year(spark, d):
    return aggregate.by_period(_mocked(spark, d), "year")


@query(f"WITH {_RESPONSES} SELECT * FROM responses")
def window_shares(spark, d):
    return scoring.latest_responses(table(spark, d, "detector_responses"))


@query(f"WITH {_ANNUAL} SELECT * FROM annual WHERE CAST(period AS INTEGER) BETWEEN 2018 AND 2021")
def historical_baseline(spark, d):
    return aggregate.baseline(aggregate.by_period(_scored(spark, d), "year"))


@query(
    f"""WITH {_ANNUAL}, p AS (SELECT country, {_POOL} FROM (SELECT *, {_GROUP} FROM annual) GROUP BY ALL)
    SELECT *, ai_words_estimate / words AS ai_word_share, (ai_words_estimate + mixed_words_estimate) / words AS ai_plus_mixed_word_share FROM p WHERE words <> 0"""
)
def pre_post(spark, d):
    return aggregate.pre_post(aggregate.by_period(_scored(spark, d), "year"))


@query(
    f"""WITH {_ANNUAL}, cells(min_words) AS (VALUES (40), (100), (250)), roles(excluded_role) AS (VALUES ('none'), ('ministers'), ('chairs')),
      open AS (SELECT s.*, min_words, excluded_role FROM scored s, cells, roles
        WHERE s.words >= min_words AND NOT CASE excluded_role WHEN 'ministers' THEN {_MINISTER} WHEN 'chairs' THEN {_CHAIR} ELSE false END),
      cell AS (SELECT min_words, excluded_role, country, {_PERIOD['year']} AS period, {_SUMS} FROM open GROUP BY ALL),
      pool AS (SELECT country, {_POOL} FROM (SELECT *, {_GROUP} FROM annual) GROUP BY ALL),
      early AS (SELECT country, ai_words_estimate / words AS base FROM pool WHERE words <> 0 AND period_group = 'pre-LLM control')
    SELECT * EXCLUDE (sa, sm, base), {_SHARES}, base AS historical_baseline_ai_share,
      greatest(0.0, coalesce(ai_words_estimate / words, 0) - base) AS baseline_adjusted_ai_share_sensitivity
    FROM cell LEFT JOIN early USING (country)"""
)
def sensitivity(spark, d):
    return aggregate.sensitivity(_scored(spark, d, "speaker_role", "speaker_name"))


@query(
    f"""WITH {_SCORED}, open AS (
        SELECT *, 'party' AS dimension, {_PERIOD['year']} AS period, coalesce(nullif(trim(party), ''), '{schema.UNKNOWN}') AS "group" FROM scored UNION ALL
        SELECT *, 'legislative_term', {_PERIOD['year']}, coalesce(nullif(legislative_term, ''), '{schema.UNKNOWN}') FROM scored UNION ALL
        SELECT *, 'length_band', {_PERIOD['year']}, CASE WHEN words < 100 THEN '40–99' WHEN words < 250 THEN '100–249' ELSE '250+' END FROM scored UNION ALL
        SELECT *, 'speaker', 'all', substr(sha256(country || '|' || {_KNOWN_ID}), 1, 16) FROM scored WHERE {_KNOWN_ID} IS NOT NULL),
      g AS (SELECT dimension, country, period, "group", {_SUMS} FROM open GROUP BY ALL)
    SELECT dimension, country, period, "group", speeches, words, ai_words_estimate / words AS ai_word_share, mixed_words_estimate / words AS mixed_word_share,
      (ai_words_estimate + mixed_words_estimate) / words AS ai_plus_mixed_word_share, sa / speeches AS ai_speech_weighted_share
    FROM g WHERE dimension <> 'speaker' OR speeches >= 10"""
)
def breakdowns(spark, d):
    return aggregate.breakdowns(_scored(spark, d, "party", "legislative_term", "speaker_id"))


# scalars --------------------------------------------------------------------------------------------------------------
@query(f"""SELECT DISTINCT speaker_role, speaker_name, {_MINISTER} AS minister, {_CHAIR} AS chair FROM speeches""")
def role_flags(spark, d):
    rows = table(spark, d, "speeches").select("speaker_role", "speaker_name").distinct()
    return rows.withColumns({"minister": T.is_minister(F.col("speaker_role")), "chair": T.is_chair(F.col("speaker_role"), F.col("speaker_name"))})


@query(
    f"""WITH {_CORPUS} SELECT speech_id, words, CASE WHEN words < 100 THEN 'short' WHEN words < 250 THEN 'medium' ELSE 'long' END AS band,
      CASE WHEN words < 100 THEN '40–99' WHEN words < 250 THEN '100–249' ELSE '250+' END AS label, {_UNITS} AS units,
      {_PERIOD['month']} AS month, {_PERIOD['quarter']} AS quarter, {_PERIOD['year']} AS year FROM corpus"""
)
def speech_labels(spark, d):
    rows = _corpus(spark, d, "day", "words")
    w, day = F.col("words"), F.col("day")
    periods = {k: T.period(day, k) for k in aggregate.KINDS}
    return rows.select("speech_id", "words", T.length_band(w).alias("band"), T.length_label(w).alias("label"), T.units(w).alias("units"), *[c.alias(k) for k, c in periods.items()])


@query(
    f"""SELECT label, k AS "key", CASE WHEN k IN ({_QUOTED(schema.AI_LABELS)}) THEN 'ai' WHEN k IN ({_QUOTED(schema.MIXED_LABELS)}) THEN 'mixed'
        WHEN k IN ({_QUOTED(schema.HUMAN_LABELS)}) THEN 'human' ELSE 'unknown' END AS class, count(*) AS windows
      FROM (SELECT w.label AS label, {_LABEL} AS k FROM (SELECT unnest(windows) AS w FROM detector_responses)) GROUP BY ALL"""
)
def label_classes(spark, d):
    rows = table(spark, d, "detector_responses").select(F.explode("windows").alias("w")).groupBy("w.label").agg(F.count(F.lit(1)).alias("windows"))
    return rows.select("label", T.window_label(F.col("label")).alias("key"), T.label_class(F.col("label")).alias("class"), "windows")


@query(f"""WITH {_CORPUS} SELECT country, substr(sha256(country || '|' || {_KNOWN_ID}), 1, 16) AS pseudonym, count(*) AS speeches FROM corpus WHERE {_KNOWN_ID} IS NOT NULL GROUP BY ALL""")
def speaker_pseudonyms(spark, d):
    rows = _corpus(spark, d, "country", "speaker_id").withColumn("id", T.known_id(F.col("speaker_id"))).where("id IS NOT NULL")
    return rows.groupBy("country", T.pseudonym(F.col("country"), F.col("id")).alias("pseudonym")).agg(F.count(F.lit(1)).alias("speeches"))


_NORMAL = lambda x: rf"regexp_replace(trim(regexp_replace({_FOLD(x)}, '[\s\p{{Z}}]+', ' ', 'g')), '\s+([.,;:!?)\]»”])', '\1', 'g')"
_LOOSE = lambda x: f"regexp_replace({_NORMAL(x)}, '[^0-9a-zà-öø-ÿ]+', '', 'g')"


@query(f"""SELECT speech_id, delivered_at, md5({_NORMAL('speech_text')}) AS normal, md5({_LOOSE('speech_text')}) AS loose FROM speeches""")
def text_forms(spark, d):
    t = F.col("speech_text")
    return table(spark, d, "speeches").select("speech_id", "delivered_at", F.md5(T.normalized(t)).alias("normal"), F.md5(T.loose(t)).alias("loose"))


# quality --------------------------------------------------------------------------------------------------------------
_ISO = r"CASE WHEN regexp_matches(date, '^\d{4}-\d{2}-\d{2}$') THEN try_cast(date AS DATE) END"
_JUDGED = rf"""judged AS (SELECT *, {_ISO} AS day, CAST(coalesce({_WORDS}, 0) AS INTEGER) AS counted,
    coalesce(word_count = coalesce({_WORDS}, 0), false) AS consistent, coalesce(country IN ({_QUOTED(COUNTRIES)}), false) AS known,
    coalesce(speech_id, '') <> '' AND coalesce(source_url, '') <> '' AND coalesce(source_identifier, '') <> '' AS sourced,
    trim(coalesce(speech_text, '')) = '' AS blank, sha256(trim(regexp_replace({_FOLD("coalesce(speech_text, '')")}, '[\s\p{{Z}}]+', ' ', 'g'))) AS digest FROM speeches)"""


@query(
    f"""WITH {_JUDGED}, a AS (SELECT count(*) AS records, CAST(coalesce(sum(counted) FILTER (WHERE consistent), 0) AS BIGINT) AS words, count(*) FILTER (WHERE blank) AS empty_speeches,
        count(*) FILTER (WHERE consistent AND counted > 10000) AS implausible_lengths, count(*) FILTER (WHERE NOT consistent) AS wrong_counts,
        count(*) FILTER (WHERE NOT known) AS wrong_countries, count(*) FILTER (WHERE day IS NULL) AS wrong_dates, count(*) FILTER (WHERE NOT sourced) AS unsourced,
        count(*) FILTER (WHERE year(day) NOT BETWEEN 2018 AND 2026) AS outside_years,
        count(*) FILTER (WHERE sourced) - count(DISTINCT speech_id) FILTER (WHERE sourced) AS duplicate_speech_id_count,
        count(*) FILTER (WHERE consistent) - count(DISTINCT digest) FILTER (WHERE consistent) AS duplicate_text_count FROM judged)
      SELECT *, wrong_counts + wrong_countries + wrong_dates + unsourced + empty_speeches + duplicate_speech_id_count = 0 AS valid FROM a"""
)
def qa_summary(spark, d):
    return quality.audit(table(spark, d, "speeches"))


@query(
    f"""WITH {_JUDGED} SELECT speech_id, defect FROM (
      SELECT speech_id, unnest([CASE WHEN NOT known THEN 'unexpected country' END, CASE WHEN NOT sourced THEN 'missing ID or provenance' END,
        CASE WHEN day IS NULL THEN 'invalid date' END, CASE WHEN blank THEN 'empty text' END, CASE WHEN NOT consistent THEN 'inconsistent word count' END]) AS defect
      FROM judged) WHERE defect IS NOT NULL"""
)
def qa_defects(spark, d):
    return quality.defects(table(spark, d, "speeches"))


@query(f"WITH {_JUDGED} SELECT digest, count(*) AS rows FROM judged WHERE consistent GROUP BY digest HAVING count(*) > 1")
def qa_repeated_texts(spark, d):
    return quality.repeated_texts(table(spark, d, "speeches"))


@query(
    f"""WITH {_JUDGED} SELECT speech_id, times FROM (SELECT speech_id, count(*) AS times, max(delivered_at) AS last_at FROM judged WHERE sourced GROUP BY speech_id HAVING count(*) > 1)
      ORDER BY last_at, speech_id LIMIT 20"""
)
def qa_duplicate_ids(spark, d):
    return quality.duplicate_ids(table(spark, d, "speeches"))


@query(f"WITH {_CORPUS} SELECT country, CAST(year(day) AS INTEGER) AS year, count(*) AS records FROM corpus WHERE day IS NOT NULL GROUP BY ALL")
def qa_country_years(spark, d):
    return quality.country_years(_corpus(spark, d, "country", "day"))


@query(
    f"""WITH {_CORPUS} SELECT d.country AS country, CAST(y.year AS INTEGER) AS year FROM (VALUES {', '.join(f"('{c}')" for c in COUNTRIES)}) d(country), range(2010, 2031) y(year)
      WHERE NOT EXISTS (SELECT 1 FROM corpus c WHERE c.country = d.country AND year(c.day) = y.year)"""
)
def coverage_missing(spark, d):
    return quality.missing_coverage(_corpus(spark, d, "country", "day"), years=(2010, 2030))


_NUMBER = "CAST(nullif(regexp_extract(speech_id, '-([0-9]+)$', 1), '') AS BIGINT)"


@query(
    f"""WITH n AS (SELECT DISTINCT substr(speech_id, 1, 4) AS code, {_NUMBER} AS number FROM detector_responses WHERE {_NUMBER} IS NOT NULL),
      s AS (SELECT *, lead(number) OVER (PARTITION BY code ORDER BY number) AS nxt FROM n)
      SELECT code, number + 1 AS first_missing, nxt - 1 AS last_missing FROM s WHERE nxt > number + 1"""
)
def number_gaps(spark, d):
    return quality.number_gaps(_numbers(spark, d), ["code"], "number")


def _numbers(spark, d):
    number = F.nullif(F.regexp_extract("speech_id", "-([0-9]+)$", 1), F.lit("")).cast("bigint")
    return table(spark, d, "detector_responses").select(F.substring("speech_id", 1, 4).alias("code"), number.alias("number"))


@query(
    f"""SELECT code, count(DISTINCT number) AS present, min(number) AS least, max(number) AS greatest, max(number) - min(number) + 1 AS expected,
        max(number) - min(number) + 1 - count(DISTINCT number) AS missing
      FROM (SELECT substr(speech_id, 1, 4) AS code, {_NUMBER} AS number FROM detector_responses) WHERE number IS NOT NULL GROUP BY code"""
)
def number_coverage(spark, d):
    return quality.number_coverage(_numbers(spark, d), ["code"], "number")


# samples --------------------------------------------------------------------------------------------------------------
_STRATUM = f"country || ':' || {_PERIOD['month']}"
_STRATA = f"""strata AS (SELECT {_STRATUM} AS stratum, count(*) AS eligible, CAST(max({_UNITS}) AS BIGINT) AS max_units, CAST(sum({_UNITS}) AS BIGINT) AS total_units
  FROM corpus WHERE words >= 40 AND day IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_CORPUS}, {_STRATA} SELECT * FROM strata")
def strata_stats(spark, d):
    return sampling.strata(_corpus(spark, d, "country", "day", "words"))


@query(
    f"""WITH RECURSIVE {_CORPUS}, {_STRATA}, room AS (SELECT CAST(sum(max_units) AS BIGINT) AS least, (CAST(sum(max_units) AS BIGINT) + CAST(sum(total_units) AS BIGINT)) // 2 AS available, CAST(sum(total_units) AS BIGINT) AS whole FROM strata),
      steps AS (SELECT row_number() OVER (ORDER BY k::DOUBLE / eligible, stratum) AS i, stratum, max_units FROM strata, generate_series(1, eligible - 1) t(k)),
      walk AS (SELECT CAST(0 AS BIGINT) AS i, least AS reserved, CAST(NULL AS VARCHAR) AS stratum, false AS fits FROM room
        UNION ALL SELECT s.i, CASE WHEN w.reserved + s.max_units <= available THEN w.reserved + s.max_units ELSE w.reserved END, s.stratum, w.reserved + s.max_units <= available FROM walk w JOIN steps s ON s.i = w.i + 1, room),
      more AS (SELECT stratum, count(*) AS n FROM walk WHERE fits GROUP BY stratum)
      SELECT s.*, CASE WHEN whole <= available THEN eligible ELSE 1 + coalesce(n, 0) END AS selected FROM strata s LEFT JOIN more USING (stratum), room"""
)
def budget_plan(spark, d):
    """The plan of a budget that lies halfway between the least possible one and that for everything."""
    rows = cut(_corpus(spark, d, "country", "day", "words"))
    least, whole = sampling.strata(rows).agg(F.sum("max_units"), F.sum("total_units")).first()
    plan = sampling.budget_plan(rows, budget=round((least + whole) // 2 * 0.05, 2), price=0.5)
    return plan.drop("inclusion_probability", "weight")


def _fixed_plan(spark, d, rows):
    plan = sampling.strata(rows).withColumn("selected", F.least(F.lit(3), F.col("eligible")))
    return plan.withColumn("weight", 1 / (F.col("selected") / F.col("eligible")))


_FIXED = f"""WITH {_CORPUS}, ranked AS (SELECT *, {_STRATUM} AS stratum, count(*) OVER (PARTITION BY {_STRATUM}) AS eligible,
    row_number() OVER (PARTITION BY {_STRATUM} ORDER BY sha256('2026|' || {_STRATUM} || '|' || speech_id)) AS place FROM corpus WHERE words >= 40 AND day IS NOT NULL),
  sample AS (SELECT *, 1 / (least(3, eligible) / eligible::DOUBLE) AS sampling_weight FROM ranked WHERE place <= 3)"""


@query(f"{_FIXED} SELECT speech_id, stratum, sampling_weight FROM sample")
def stratified_sample(spark, d):
    rows = _corpus(spark, d, "country", "day", "words")
    return sampling.stratified_sample(rows, _fixed_plan(spark, d, rows)).select("speech_id", "stratum", "sampling_weight")


@query(
    f"""{_FIXED}, scored AS (SELECT *, (CAST('0x' || substr(sha256(speech_id), 1, 2) AS BIGINT) % 16) / 100.0::DOUBLE AS ai,
        (CAST('0x' || substr(sha256(speech_id), 3, 2) AS BIGINT) % 11) / 100.0::DOUBLE AS mixed, sampling_weight AS w FROM sample),
      g AS (SELECT country, {_PERIOD['year']} AS period, {_EX('w')} AS speeches, count(*) AS sampled_speeches, {_EX('words * w')} AS words, {_EX('words * w * ai')} AS ai_words_estimate,
        {_EX('words * w * mixed')} AS mixed_words_estimate, {_EX('w * ai')} AS sa, {_EX('w * mixed')} AS sm FROM scored GROUP BY ALL)
      SELECT * EXCLUDE (sa, sm), {_SHARES} FROM g"""
)
def weighted_estimates(spark, d):
    rows = _corpus(spark, d, "country", "day", "words")
    sample = sampling.stratified_sample(rows, _fixed_plan(spark, d, rows))
    return aggregate.by_period(scoring.score(sample, scoring.mock_shares(F.col("speech_id"))), "year")


@query(
    f"""WITH {_CORPUS}, own AS (SELECT speech_id, day, year(day) AS year, sha256('2026|' || speech_id) AS rank_key FROM corpus WHERE country = 'France' AND day IS NOT NULL),
      y AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY rank_key, speech_id) AS place, 50 // (SELECT count(DISTINCT year) FROM own) AS quota FROM own),
      rest AS (SELECT * FROM y WHERE place > quota ORDER BY rank_key, speech_id LIMIT (50 - (SELECT count(*) FROM y WHERE place <= quota)))
      SELECT speech_id, day, CAST(year AS INTEGER) AS year, rank_key FROM (SELECT * FROM y WHERE place <= quota UNION ALL SELECT * FROM rest)"""
)
def review_sample(spark, d):
    return sampling.review_sample(_corpus(spark, d, "country", "day"), "France", 50).select("speech_id", "day", "year", "rank_key")


@query(
    f"""WITH {_CORPUS}, e AS (SELECT speech_id, country, words, digest, sha256('2026|' || country || '|' || strftime(day, '%Y-%m-%d') || '|' || speech_id) AS rank_key
        FROM corpus WHERE words BETWEEN 40 AND 100 AND day >= DATE '2023-01-01'),
      f AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY rank_key) AS rn FROM e)
      SELECT speech_id, country, words, rank_key FROM f WHERE rn = 1 ORDER BY rank_key LIMIT 10"""
)
def trial_selection(spark, d):
    rows = _corpus(spark, d, "country", "day", "words", "digest")
    return sampling.trial_selection(rows, 10).select("speech_id", "country", "words", "rank_key")


@query(
    f"""WITH {_CORPUS}, m AS (SELECT country, CAST(year(day) AS INTEGER) AS year, coalesce(nullif(party, ''), '{schema.UNKNOWN}') AS party,
        CASE WHEN words < 100 THEN 'short' WHEN words < 250 THEN 'medium' ELSE 'long' END AS band, coalesce({_KNOWN_ID}, speech_id) AS speaker,
        sha256('2026|' || speech_id) AS rank_key, speech_id, day FROM corpus WHERE year(day) BETWEEN 2018 AND 2021 AND words >= 40 AND country <> '' AND speech_id <> '')
      SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY country, year, party, band, speaker ORDER BY rank_key) AS rn FROM m) WHERE rn = 1"""
)
def control_candidates(spark, d):
    return sampling.control_candidates(_corpus(spark, d, "country", "day", "words", "party", "speaker_id"))


@query()
def historical_controls(spark, d):
    return sampling.historical_controls(_corpus(spark, d, "country", "day", "words", "party", "speaker_id"), 100)


# sources --------------------------------------------------------------------------------------------------------------
_STATUS = rf"""CASE WHEN n = '' THEN 'mismatch' WHEN contains(h, n) THEN 'verified' WHEN b <> '' AND contains(lh, b) THEN 'normalized'
  WHEN contains(h, substr(n, 1, 160)) OR contains(h, CASE WHEN length(n) > 160 THEN right(n, 160) ELSE n END) THEN 'partial'
  WHEN len(segs) > 0 AND len([1 FOR s IN segs IF contains(h, s)]) >= len(segs) * 0.9 AND (len(segs) > 1 OR length(segs[1]) >= 80) THEN 'partial' ELSE 'mismatch' END"""


@query(
    rf"""WITH p AS (SELECT speech_id, delivered_at, {_NORMAL("coalesce(speech_text, '')")} AS n, {_NORMAL("coalesce(raw_text, '')")} AS h, {_LOOSE("coalesce(speech_text, '')")} AS b, {_LOOSE("coalesce(raw_text, '')")} AS lh
        FROM speeches),
      q AS (SELECT *, [trim(x) FOR x IN string_split_regex(n, '[.!?;:]\s+') IF length(trim(x)) >= 25] AS segs FROM p)
      SELECT speech_id, delivered_at, {_STATUS} AS status FROM q"""
)
def containment(spark, d):
    rows = table(spark, d, "speeches")
    return rows.select("speech_id", "delivered_at", review.containment(F.col("speech_text"), F.col("raw_text")).alias("status"))


@query(
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY local_path ORDER BY retrieved_at_utc DESC, sha256 DESC) AS rn FROM source_manifest WHERE local_path IS NOT NULL)
      SELECT local_path, source_url, retrieved_at_utc, bytes, sha256 FROM l WHERE rn = 1"""
)
def manifest_last_wins(spark, d):
    rows = table(spark, d, "source_manifest").select("local_path", "retrieved_at_utc", "sha256", "source_url", "bytes")
    return provenance.last_entries(rows).select("local_path", "source_url", "retrieved_at_utc", "bytes", "sha256")


_OLD = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY local_path ORDER BY retrieved_at_utc, sha256) AS rn FROM source_manifest) WHERE rn = 1"
_NEW = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY local_path ORDER BY retrieved_at_utc DESC, sha256 DESC) AS rn FROM source_manifest) WHERE rn = 1"


@query(
    f"""WITH o AS ({_OLD}), n AS ({_NEW}) SELECT local_path, n.source_url AS source_url,
        CASE WHEN o.sha256 = n.sha256 AND o.source_url IS NOT DISTINCT FROM n.source_url THEN o.retrieved_at_utc ELSE n.retrieved_at_utc END AS retrieved_at_utc, n.sha256 AS sha256,
        CASE WHEN o.sha256 = n.sha256 AND o.source_url IS NOT DISTINCT FROM n.source_url THEN 'kept' ELSE 'changed' END AS change,
        CASE WHEN n.source_url IS NULL THEN 'unresolved_source_url' END AS provenance_status FROM o JOIN n USING (local_path)"""
)
def manifest_reconcile(spark, d):
    rows = table(spark, d, "source_manifest")
    rest = [c for c in rows.columns if c not in ("local_path", "retrieved_at_utc", "sha256")]
    first = rows.groupBy("local_path").agg(F.min(F.struct("retrieved_at_utc", "sha256", *rest)).alias("e")).select("local_path", "e.*")
    last = provenance.last_entries(rows.select("local_path", "retrieved_at_utc", "sha256", *rest)).select("source_url", "retrieved_at_utc", "local_path", "bytes", "sha256", "content_type")
    return provenance.reconcile(first, last).select("local_path", "source_url", "retrieved_at_utc", "sha256", "change", "provenance_status")


@query(
    r"""SELECT local_path, CASE regexp_extract(lower(local_path), '(\.[^./]+)$', 1) WHEN '.zip' THEN 'application/zip' WHEN '.json' THEN 'application/json' WHEN '.html' THEN 'text/html'
        WHEN '.xml' THEN 'text/xml' WHEN '.pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS type, source_url AS safe_url, count(*) AS entries FROM source_manifest GROUP BY ALL"""
)
def content_types(spark, d):
    rows = table(spark, d, "source_manifest").withColumn("u", F.concat(F.col("source_url"), F.lit("?token=1&Key=2#part")))
    return rows.groupBy("local_path", provenance.content_type(F.col("local_path")).alias("type"), provenance.without_credentials(F.col("u")).alias("safe_url")).agg(F.count(F.lit(1)).alias("entries"))


@query(
    """SELECT country, text_language, count(*) AS passages, count(*) FILTER (WHERE a + m >= 0.5) AS detected, count(*) FILTER (WHERE a + m >= 0.5) / count(*)::DOUBLE AS detection_rate,
        CAST(sum(CAST(round(a, 9) AS DECIMAL(18,9))) AS DOUBLE) / count(*) AS mean_ai_fraction
      FROM (SELECT s.country AS country, s.text_language AS text_language, coalesce(r.fraction_ai, 0) AS a, coalesce(r.fraction_ai_assisted, 0) AS m FROM speeches s JOIN detector_responses r USING (speech_id)
            WHERE s.country IS NOT NULL AND s.text_language IS NOT NULL) GROUP BY ALL"""
)
def control_detection(spark, d):
    rows = table(spark, d, "speeches").where("country IS NOT NULL AND text_language IS NOT NULL").withColumn("generator", F.lit(""))
    return controls.detection_summary(controls.detections(rows, table(spark, d, "detector_responses")))


@query(f"""SELECT name AS country, count(*) AS records FROM (SELECT {_COUNTRY} AS name FROM speeches) WHERE name IN ({_QUOTED(COUNTRIES)}) GROUP BY name""")
def union_countries(spark, d):
    rows = cut(table(spark, d, "speeches").select(country_name(F.col("country")).alias("country")))  # six tables, of one scan
    parts = {c: rows.where(F.col("country") == c) for c in COUNTRIES}
    return corpus.union_countries(parts).groupBy("country").agg(F.count(F.lit(1)).alias("records"))


@query("SELECT DISTINCT speech_id FROM detector_responses WHERE speech_id NOT IN (SELECT speech_id FROM speeches WHERE speech_id IS NOT NULL)")
def set_difference(spark, d):
    wanted, there = table(spark, d, "detector_responses").select(F.col("speech_id").alias("path")).distinct(), table(spark, d, "speeches").select(F.col("speech_id").alias("path"))
    return quality.wanted_files(wanted, there).withColumnRenamed("path", "speech_id")


@query("SELECT DISTINCT speech_id FROM speeches WHERE speech_id IN (SELECT speech_id FROM detector_responses WHERE stage = 'complete')")
def scored_semi(spark, d):
    done = table(spark, d, "detector_responses").where("stage = 'complete'").select("speech_id")
    return table(spark, d, "speeches").select("speech_id").distinct().join(done, "speech_id", "left_semi")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS events, CAST(sum(CAST(round(value, 6) AS DECIMAL(18,6))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def event_props(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return rows.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("events"), F.sum(F.round("value", 6).cast("decimal(18,6)")).cast("double").alias("total"))


@query(
    """SELECT r_name AS region, strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18,4))) AS DOUBLE) AS revenue, count(*) AS items
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""
)
def star_revenue_month(spark, d):
    t = {n: table(spark, d, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    rows = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    revenue = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).cast("decimal(18,4)")
    return rows.groupBy(F.col("r_name").alias("region"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum(revenue).cast("double").alias("revenue"), F.count(F.lit(1)).alias("items"))


_SAFE = catalogue_sources.SAFE


@query(r"""SELECT DISTINCT speech_id, md5('' || speech_text || ' ' || coalesce(speaker_name, '')) AS text_md5 FROM speeches WHERE speech_id IS NOT NULL AND speech_text <> ''""")
def html_visible_text(spark, d):
    rows = table(spark, d, "speeches").where("speech_id IS NOT NULL AND speech_text <> ''").select("speech_id", "speech_text", "speaker_name").distinct()
    page = F.concat(F.lit("<html><style>p {}</style><script>if (a < b) c()</script><p>"), _SAFE(F.col("speech_text")), F.lit("</p><b>"), _SAFE(F.col("speaker_name")), F.lit("</b></html>"))
    return parsers.with_visible_text(rows.withColumn("page", F.encode(page, "utf-8")), "page").select("speech_id", F.md5("text").alias("text_md5")).distinct()


@query(
    """SELECT source_url, regexp_extract(source_url, '/([^/]*)$', 1) AS person, source_url || '?a=1&idPersona=' || regexp_extract(source_url, '/([^/]*)$', 1) AS safe, count(*) AS entries
      FROM source_manifest WHERE source_url IS NOT NULL GROUP BY ALL"""
)
def url_params(spark, d):
    name = F.regexp_extract("source_url", "/([^/]*)$", 1)
    rows = table(spark, d, "source_manifest").where("source_url IS NOT NULL").withColumn("url", F.concat("source_url", F.lit("?a=1&idPersona="), name, F.lit("&token=secret#x")))
    return rows.groupBy("source_url", provenance.query_part(F.col("url"), "idPersona").alias("person"), provenance.without_credentials(F.col("url")).alias("safe")).agg(F.count(F.lit(1)).alias("entries"))


@query("""SELECT country, count(*) AS speeches, CAST(sum(n) AS BIGINT) AS words FROM (SELECT unnest(['France', 'Germany', 'Netherlands', 'Italy', 'Spain', 'Poland']) AS country, unnest([59, 59, 59, 59, 59, 59]) AS n), range(6) GROUP BY country""")
def mock_corpus(spark, d):
    return files.mock_corpus(spark).groupBy("country").agg(F.count(F.lit(1)).alias("speeches"), F.sum("word_count").alias("words"))


@query(
    r"""WITH i AS (SELECT DISTINCT ref_id AS item, lower(role_name) AS needle FROM role_ref), s AS (SELECT DISTINCT speech_id, lower(speaker_role) AS role FROM speeches WHERE speech_id IS NOT NULL AND speaker_role IS NOT NULL),
        n AS (SELECT speech_id, regexp_replace(trim(regexp_replace(replace(role, 'ß', 'ss'), '[\s\p{Z}]+', ' ', 'g')), '\s+([.,;:!?)\]»”])', '\1', 'g') AS hay FROM s)
      SELECT DISTINCT item, speech_id AS "key" FROM i JOIN n ON contains(hay, needle)"""
)
def item_occurrences(spark, d):
    items = table(spark, d, "role_ref").select(F.col("ref_id").alias("item"), F.col("role_name").alias("text")).distinct()
    texts = table(spark, d, "speeches").where("speech_id IS NOT NULL AND speaker_role IS NOT NULL").select(F.col("speech_id").alias("key"), F.col("speaker_role").alias("text")).distinct()
    return review.occurrences(items, texts).distinct()


QUERIES |= streams.QUERIES | catalogue_sources.QUERIES | catalogue_transport.QUERIES
SQL |= streams.SQL | catalogue_sources.SQL | catalogue_transport.SQL
