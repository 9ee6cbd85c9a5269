"""Problem 3: freely typed values mapped to the closest entry of a reference list, the others reported.

A value is written in a few plain views (as typed, without office remarks, parts beside a slash, a bracket's contents, its
letters run together), each a set of tokens. Views and entries meet in a set-similarity join: tokens are ordered by their
global rarity, only the rare prefix that a threshold allows is joined, candidates must pass the length and positional
filters, the Jaccard similarity is then computed exactly and the best entry kept.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenaria.functions.deliveries import first_delivery
from plenaria.llm.folding import MISSING, fold, grams, words
from plenaria.runtime import cut, table

#: Least Jaccard similarity of a view and an entry.
THRESHOLD = 0.4
#: Against rounding of the filters, which must never be stricter than the exact test after them.
SLACK = 1e-9
# Words for a parliamentary group, and remarks beside an office.
GROUP_WORDS = frozenset({"groupe", "group", "fraktion", "klub", "kp", "gruppo", "grupo", "fractie", "parlementaire", "parlamentario", "parlamentare", "poselski"})
REMARKS = re.compile(r"\b(?:a\.\s?i\.|i\.\s?[vV]\.|[gG]\.\s?[pP]\.|(?:19|20)\d\d)(?!\w)")
ASIDE = re.compile(r"\(([^()]*)\)")


def _tokens(found: list[str]) -> frozenset[str]:
    """Letter pairs of longer words; a word of up to three letters is one token."""
    out: set[str] = set()
    for w in found:
        out |= grams(w) if len(w) > 3 else {f"={w}"}
    return frozenset(out)


def readings(text: str, names: list[list[str]]) -> list[list[str]]:
    """The ways to read a text's words. names: the words of each entry's name.

    A cut-off word (with a dot) stands for an entry's word that it may be the begin of. Each entry gives readings of its own,
    as only its own words bring a value closer to it: where it has several words for one beginning, the cut-off words take
    them in turn, beginning with each of them once. A text that no entry completes is read as it stands.
    """
    found = [m.groups() for m in re.finditer(r"([^\W_]+)(\.?)", fold(text))]
    plain = [w for w, _ in found]
    short = {w for w, dot in found if dot and len(w) > 1}
    out: set[tuple[str, ...]] = set()
    for words_ in names if short else []:
        full = {w: [e for e in words_ if e.startswith(w) and len(e) > max(3, len(w))] for w in short}
        for turn in range(max(map(len, full.values()))):
            met: dict[str, int] = {}
            reading = []
            for w, dot in found:
                if dot and full.get(w):
                    reading.append(full[w][(met.setdefault(w, 0) + turn) % len(full[w])])
                    met[w] += 1
                else:
                    reading.append(w)
            out.add(tuple(reading))
    return sorted(map(list, out)) or [plain]


def views(value: str, names: list[list[str]]) -> list[list[str]]:
    """The different token sets of a typed value. names: the words of its country's entries, for cut-off words."""
    bare = REMARKS.sub(" ", value)
    outer = ASIDE.sub(" ", bare)
    parts = [bare, outer, *ASIDE.findall(bare), *re.split(r"/| - ", outer)]
    found = set()
    for p in {*parts, value}:
        for ws in readings(p, names):
            rest = [w for w in ws if w not in GROUP_WORDS]
            found |= {_tokens(ws), _tokens(rest)}
            run = "".join(rest)
            if len(run) <= 4:
                found.add(_tokens([run]))
    return sorted(sorted(s) for s in found if s)


def similarity_join(left: DataFrame, right: DataFrame, threshold: float, group: list[str]) -> DataFrame:
    """Pairs (left_id, right_id, score) of sets of the same group with Jaccard similarity of at least threshold.

    left and right have the group columns, `id` and `tokens`, an array of distinct strings. Only tokens in a set's prefix
    of length n - ceil(threshold * n) + 1, in the order of global rarity, are shuffled for the join; the sets themselves
    go along with the surviving candidates. Empty sets match nothing.
    """
    sides = left.select(F.lit(0).alias("side"), *group, "id", "tokens").unionByName(right.select(F.lit(1).alias("side"), *group, "id", "tokens"))
    flat = sides.select("side", *group, "id", F.explode("tokens").alias("token"))
    rarity = flat.groupBy(*group, "token").agg(F.count(F.lit(1)).alias("times"))
    ordered = flat.join(rarity, [*group, "token"]).groupBy("side", *group, "id").agg(F.array_sort(F.collect_list(F.struct("times", "token"))).alias("o"))
    ordered = cut(ordered.select("side", *group, "id", F.col("o.token").alias("ordered"), F.size("o").alias("n")))
    prefix = ordered.withColumn("reach", (F.col("n") - F.ceil(F.col("n") * threshold - SLACK) + 1).cast("int"))
    prefix = prefix.select("side", *group, "id", "n", F.posexplode(F.slice("ordered", F.lit(1), F.col("reach"))).alias("place", "token"))

    def side(k: int, name: str) -> DataFrame:
        return prefix.where(F.col("side") == k).select(*group, "token", F.col("id").alias(f"{name}_id"), F.col("n").alias(f"{name}_n"), F.col("place").alias(f"{name}_at"))

    a, b = side(0, "left"), side(1, "right")
    met = a.join(b, [*group, "token"])
    met = met.where((F.col("left_n") >= F.col("right_n") * threshold - SLACK) & (F.col("right_n") >= F.col("left_n") * threshold - SLACK))
    need = F.ceil((F.col("left_n") + F.col("right_n")) * (threshold / (1 + threshold)) - SLACK)
    # what can still be common from the first shared prefix token on
    first = met.groupBy(*group, "left_id", "right_id", "left_n", "right_n").agg(F.min(F.struct("left_at", "right_at")).alias("p"))
    room = F.least(F.col("left_n") - F.col("p.left_at"), F.col("right_n") - F.col("p.right_at"))
    candidates = first.where(room >= need).select(*group, "left_id", "right_id")
    sets = lambda k, name: ordered.where(F.col("side") == k).select(*group, F.col("id").alias(f"{name}_id"), F.col("ordered").alias(f"_{name}"))
    both = candidates.join(sets(0, "left"), [*group, "left_id"]).join(sets(1, "right"), [*group, "right_id"])
    common = F.size(F.array_intersect("_left", "_right"))
    score = common / (F.size("_left") + F.size("_right") - common)
    return both.withColumn("score", score).where(F.col("score") >= threshold).select(*group, "left_id", "right_id", "score")


def match_values(values: DataFrame, entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per distinct (country, field, value): the ref_id of its best entry (0 if none is similar enough) and the score.

    values: country, field, value. entries: country, field, ref_id, name (an entry may have several names). Missing values
    (null, empty, sentinels) are left out. A null country matches no entry. Ties go to the lower ref_id. Values are made
    distinct on the map side first, so repeated rows cost nothing; extra columns are ignored.
    """
    missing = F.col("value").isNull() | F.lower(F.trim(F.col("value"))).isin(*MISSING)
    distinct = values.where(~missing).select("country", "field", "value").distinct()
    distinct = cut(distinct.withColumn("id", F.sha2(F.concat_ws("\u0001", F.coalesce("country", F.lit("\u0002")), "field", "value"), 256)))
    # entries of a reference list: the words of a country's and field's names travel with its values
    known = entries.where(F.col("name").isNotNull()).select("country", "field", "ref_id", "name").distinct()

    @F.pandas_udf("array<array<string>>")
    def entry_words(names: pd.Series) -> pd.Series:
        return names.map(lambda x: [words(name) for name in sorted(x)])

    @F.pandas_udf("array<array<string>>")
    def value_views(value: pd.Series, of: pd.Series) -> pd.Series:
        return pd.Series([views(v, [list(x) for x in w]) for v, w in zip(value, of, strict=True)])

    @F.pandas_udf("array<string>")
    def name_tokens(names: pd.Series) -> pd.Series:
        return names.map(lambda x: sorted(_tokens(words(x))))

    lists = known.groupBy("country", "field").agg(F.collect_set("name").alias("names")).select("country", "field", entry_words("names").alias("of"))
    viewed = distinct.join(lists, ["country", "field"]).select("country", "field", "id", F.posexplode(value_views("value", "of")).alias("view", "tokens"))
    left = viewed.select("country", "field", F.concat_ws(":", "id", "view").alias("id"), "tokens")
    right = known.select("country", "field", F.concat_ws(":", "ref_id", F.sha2("name", 256)).alias("id"), name_tokens("name").alias("tokens"))
    pairs = similarity_join(left, right, threshold, ["country", "field"])
    best = pairs.select(
        F.substring_index("left_id", ":", 1).alias("id"), F.struct(-F.col("score"), F.substring_index("right_id", ":", 1).cast("int").alias("ref_id")).alias("s")
    )
    best = best.groupBy("id").agg(F.min("s").alias("s")).select("id", F.col("s.ref_id").alias("ref_id"), (-F.col("s.col1")).alias("score"))
    return distinct.join(best, "id", "left").select("country", "field", "value", F.coalesce("ref_id", F.lit(0)).alias("ref_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def reference_entries(party_ref: DataFrame, role_ref: DataFrame) -> DataFrame:
    """Both lists as country, field, ref_id, name."""
    party = party_ref.select("country", F.lit("party").alias("field"), "ref_id", F.explode(F.array("party_code", "party_name")).alias("name"))
    return party.unionByName(role_ref.select("country", F.lit("speaker_role").alias("field"), "ref_id", F.col("role_name").alias("name")))


def speech_values(speeches: DataFrame) -> DataFrame:
    """country, field, value of the first delivery of each speech."""
    first = first_delivery(speeches, {c: F.col(c) for c in ("country", "party", "speaker_role")})
    fields: list[Column] = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("party", "speaker_role")]
    return first.select("country", F.inline(F.array(*fields)))


def p3_matches(spark, sf_dir):
    entries = reference_entries(table(spark, sf_dir, "party_ref"), table(spark, sf_dir, "role_ref"))
    return match_values(speech_values(table(spark, sf_dir, "speeches")), entries)


def p3_found(spark, sf_dir):
    entries = reference_entries(table(spark, sf_dir, "party_ref"), table(spark, sf_dir, "role_ref"))
    values = speech_values(table(spark, sf_dir, "speeches"))
    listed = entries.select("country", "field", F.col("name").alias("value"))
    return match_values(values, entries).join(listed, ["country", "field", "value"], "left_anti").select("country", "field", "value", "ref_id")
