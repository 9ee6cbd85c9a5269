"""Problem 2: spellings of one person or body linked, by merging and rematching.

Spellings of a country meet if they share an initial and a word of the name up to slips, and are compared once. Every distinct
spelling starts as a profile of its own; two profiles are rated by what the comparison said of their spellings. Matched ones
are merged; the merged profile has the spellings, initials and ids of all its members, and may now match what none of its
members did, or be the only one left that an initial can stand for. This goes on until a round merges nothing; a round rates
the profiles that the last one changed, all other ratings stay. Clear matches (same parts, or slips) are merged first; a
spelling that leaves parts out is tied to a profile only if no other fits it, or if the speaker ids it was delivered with speak
for one.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenaria.functions.countries import country_name
from plenaria.functions.deliveries import first_delivery
from plenaria.llm.components import components
from plenaria.llm.folding import MISSING, fold, osa
from plenaria.runtime import cut, release, small, table

# Titles and forms of address (folded), particles of names.
TITLES = (
    "dr prof mr ir drs mag ing m mme mlle me monsieur madame maitre herr frau abg sr sra srta dª don dona senor senora on sen dott dottssa avv pan pani posel poslanka pos heer mevrouw mevr dhr"
)
PARTICLES = "de del della dello degli di da dal dalla du des d la le el los las van von vom zu zur zum z ten ter ter den der het 't v dos das y"
# Short forms of given names (folded), by country.
NICKNAMES = {
    "Germany": "susi=susanne alex=alexander elli=elisabeth theo=theodor grete=margarete willi=wilhelm fritz=friedrich max=maximilian hannes=johannes hans=johannes kathe=katharina uli=ulrike gunter=gunther",
    "France": "ginette=genevieve babette=elisabeth chris=christophe domi=dominique vero=veronique fred=frederic alex=alexandre jo=josephine steph=stephane max=maximilien ben=benoit",
    "Italy": "betta=elisabetta nora=eleonora mimmo=domenico beppe=giuseppe cesca=francesca rita=margherita nico=niccolo fede=federica toto=salvatore lele=raffaele sandro=alessandro lory=loredana",
    "Spain": "lola=dolores chus=jesus charo=rosario concha=concepcion vero=veronica merche=mercedes guille=guillermo paco=francisco nacho=ignacio pepe=jose",
    "Poland": "gosia=malgorzata ola=aleksandra aga=agnieszka zbyszek=zbigniew kasia=katarzyna krzysiek=krzysztof staszek=stanislaw wlodek=wlodzimierz jozek=jozef ela=elzbieta",
    "Netherlands": "toos=antonia mien=wilhelmina daan=daniel greet=margaretha bets=elisabeth koos=jacobus hans=johannes theo=theodorus henk=hendrik kees=cornelis",
}
# Words that begin a body's name (folded) and abbreviations of whole kinds.
BODIES = (
    "ausschuss rechnungshof landesverband kommission bundesverband verband commission cour union comite federation conseil commissione corte unione comitato tribunal comision "
    "consejo federacion rekenkamer commissie provinciale bond raad izba komisja zwiazek rada"
)
KINDS = "rh=rechnungshof lv=landesverband rk=rekenkamer"


class Lexicon:
    """The words that names are read by; every list may be replaced. All words are folded, pairs are `short=whole`."""

    def __init__(self, titles: str = TITLES, particles: str = PARTICLES, nicknames: dict[str, str] | None = None, bodies: str = BODIES, kinds: str = KINDS) -> None:
        pairs = lambda text: dict(x.split("=") for x in text.split())
        nicknames = NICKNAMES if nicknames is None else nicknames
        self.titles, self.particles, self.bodies, self.kinds = frozenset(titles.split()), frozenset(particles.split()), bodies.split(), pairs(kinds)
        self.short = {country: pairs(text) for country, text in nicknames.items()}
        self.key = hash((titles, particles, tuple(sorted(nicknames.items())), bodies, kinds))

    def __hash__(self) -> int:
        return self.key

    def __eq__(self, other) -> bool:
        return isinstance(other, Lexicon) and self.__dict__ == other.__dict__


LEXICON = Lexicon()
#: Rows of a key that one task joins with the others.
PART = 512
#: Words up to this length meet by what is left after two deletions, longer ones (and, as these differ by two letters at most, those a little shorter) by their keys.
LONG = 24
CAMEL = re.compile(r"^((?:van|von|der|den|ten|ter|della|del|des|de|di|du|da|las|los|la|zu)+)(?=[A-ZÀ-Ž])")
GLUED = re.compile(r"(?:van|von|der|den|ten|ter|della|del|des|de|di|du|da|las|los|la|zu)+")


@dataclass(frozen=True)
class Name:
    """given: the first given name or initial ('' for bodies), short: as typed if that is a short form of it; rest: all other
    name words, the last one a surname; body: the kind words, cut-off ones with their dot, or `=` and an abbreviation."""

    given: str
    short: str
    rest: tuple[str, ...]
    body: tuple[str, ...]

    def full(self) -> int:
        return sum(len(x) > 1 for x in (self.given, *self.rest))

    def packed(self) -> str:
        return "\t".join((self.given, self.short, *("".join(f"{w} " for w in x) for x in (self.rest, self.body))))


@functools.lru_cache(200_000)
def unpacked(text: str) -> Name:
    given, short, rest, body = text.split("\t")
    return Name(given, short, tuple(rest.split(" ")[:-1]), tuple(body.split(" ")[:-1]))


def _plain(word: str, country: str) -> str:
    w = fold(word.strip(".'’-,"))
    if country == "Germany":
        w = w.replace("ae", "a").replace("oe", "o").replace("ue", "u")
    return re.sub(r"[^\w]", "", w)


@functools.lru_cache(200_000)
def parse(name: str, country: str, lexicon: Lexicon = LEXICON) -> Name:
    text = re.sub(r"\s*\([^()]*\)\s*$", "", name.strip()).strip()
    left, comma, right = text.partition(",")
    words = [x for x in re.split(r"\s+", text.replace(",", " , ")) if x]
    flat = [x for x in words if x != ","]
    # bodies: a kind word (maybe cut off or slipped) or an abbreviation in mixed or plain capitals before the place
    order = [*right.split(), *left.split()] if comma else flat
    if order and (kind := _kind(order, country, lexicon)):
        place = [_plain(p, country) for w in order[kind:] for p in w.split("-")]
        kinds = tuple(_plain(w, country) + ("." if w.endswith(".") else "") for w in order[:kind])
        if kind == 1 and not kinds[0].endswith(".") and len(kinds[0]) < 5 and kinds[0] not in lexicon.bodies:
            kinds = (f"={kinds[0]}",)
        return Name("", "", tuple(x for x in place if x), kinds)

    def parts(tokens: list[str], surname: bool) -> list[str]:
        out = []
        for t in tokens:
            for piece in CAMEL.sub(r"\1 ", t).split():
                w = _plain(piece, country)
                low = piece[0].islower()
                if "ª" in piece or low and GLUED.fullmatch(w):
                    continue
                if not w or w in lexicon.titles and not surname and len(w) > 1:
                    continue
                if w in lexicon.particles and (len(w) > 1 or low) or low and len(w) == 1:
                    continue
                out += [x for x in (_plain(p, country) for p in piece.split("-")) if x]
        return out

    def untitled(tokens: list[str]) -> list[str]:
        k = 0
        while k < len(tokens) - 1 and (w := _plain(tokens[k], country)) and ("ª" in tokens[k] or w in lexicon.titles and (len(w) > 1 or k == 0 and country == "France" and len(tokens) > 2 - bool(comma)) or k + 1 < len(tokens) and w == "de" and _plain(tokens[k + 1], country) == "heer" or w == "d" and k > 0 and _plain(tokens[k - 1], country) in ("sr", "sra")):
            k += 1
        return tokens[k:]

    if comma:
        surname, given = parts(untitled(left.split()), True), parts(untitled(right.split()), False)
    else:
        tokens = untitled(flat)
        caps = 0
        while caps < len(tokens) and tokens[caps].isupper() and len(tokens[caps].strip(".")) > 1:
            caps += 1
        if 0 < caps < len(tokens):
            surname, given = parts(tokens[:caps], True), parts(tokens[caps:], False)
        else:
            every = parts(tokens, False)
            given, surname = every[:1], every[1:]
    if not given:
        given, surname = ([surname[0]], surname[1:]) if len(surname) > 1 else ([""], surname)
    first = lexicon.short.get(country, {}).get(given[0], given[0])
    return Name(first, given[0] if first != given[0] else "", (*given[1:], *surname), ())


def _kind(words: list[str], country: str, lexicon: Lexicon) -> int:
    """How many words at the begin name a body's kind, 0 for a person."""
    w = _plain(words[0], country)
    first = words[0]
    if len(words) < 2:
        return 0
    known = any(osa(w, b, 1) <= 1 for b in lexicon.bodies) if len(w) > 4 else w in lexicon.bodies
    cut_off = first.endswith(".") and len(w) >= 3 and w not in lexicon.titles and any(b.startswith(w) for b in lexicon.bodies)
    initials = 2 <= len(first) <= 4 and first.isalpha() and first[0].isupper() and first[-1].isupper() and w not in lexicon.particles and w not in lexicon.titles and not words[1].isupper() and "-" in words[-1] + words[1]
    initials = initials or 2 <= len(first) <= 4 and first.isalpha() and first[0].isupper() and first[-1].isupper() and any(c.islower() for c in first) and len(words) == 2
    initials = initials or len(words) == 2 and first.isalpha() and first.isupper() and len(first) == 2 and w not in lexicon.particles
    if known or cut_off:
        return max(1, len(words) - 1)
    return 1 if initials else 0


@functools.lru_cache(500_000)
def _word(a: str, b: str) -> int:
    """Slips between two words, 9 if they are too many for one word."""
    if a == b:
        return 0
    n = min(len(a), len(b))
    most = 0 if n < 3 else 1 if n < 4 else 2
    begin = end = 0
    while begin < n and a[begin] == b[begin]:
        begin += 1
    while end < n - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    d = osa(a[begin : len(a) - end], b[begin : len(b) - end], most)
    if d > most and n > 3:
        short, long_ = sorted((a, b), key=len)
        return 1 if long_.endswith(short) and GLUED.fullmatch(long_[: -len(short)]) else 9
    return d if d <= most else 9


def _given(a: Name, b: Name, country: str, lexicon: Lexicon) -> int:
    """Slips between two given names; a short form that neither was typed as must fit the other's typing closely."""
    typed_a, typed_b = a.short or a.given, b.short or b.given
    best = 0 if a.given == b.given else _word(a.given, b.given)
    if not (a.short and b.short):
        best = min(best, _word(typed_a, typed_b))
    for typed, other in ((typed_a, b), (typed_b, a)):
        for form in _forms(other.given, country, lexicon)[1:]:
            if len(form) > 3 and osa(typed, form, 1) <= 1:
                best = min(best, 1)
    return best


@functools.cache
def _forms(given: str, country: str, lexicon: Lexicon) -> tuple[str, ...]:
    """A given name and its short forms."""
    return (given, *(k for k, v in lexicon.short.get(country, {}).items() if v == given))


def _bag(small: tuple[str, ...], large: tuple[str, ...]) -> tuple[int, int, int] | None:
    """Cost, initials used and full words shared if every word of small stands for one of large, in order; else None."""
    cost = used = shared = at = 0
    for w in small:
        best = None
        for k in range(at, len(large)):
            v = large[k]
            c = 0 if w == v else (0 if w[0] == v[0] else 9) if len(w) == 1 or len(v) == 1 else _word(w, v)
            if c < 9 and (best is None or c < best[0]):
                best = (c, k)
        if best is None:
            return None
        cost += best[0]
        v = large[best[1]]
        used += (len(w) == 1) != (len(v) == 1)
        shared += len(w) > 1 and len(v) > 1
        at = best[1] + 1
    return cost, used, shared


def compare(a: Name, b: Name, country: str, lexicon: Lexicon = LEXICON) -> tuple[int, int] | None:
    """(level, slips): 3 the same parts, 2 the same parts but for slips, 1 parts left out or initials; None: not the same."""
    if bool(a.body) != bool(b.body):
        return None
    if a.body:
        place = _bag(*sorted((a.rest, b.rest), key=len))
        if not a.rest or not b.rest or place is None or len(a.rest) != len(b.rest) or place[1] or not _same_kind(a.body, b.body, lexicon):
            return None
        return (2 if place[0] else 3, place[0])
    small, large = sorted((a, b), key=lambda x: len(x.rest))
    if not small.rest:
        return None
    if len(small.given) == 1 or len(large.given) == 1:
        firsts = [{x[:1] for x in _forms(n.given, country, lexicon)} for n in (small, large)]
        if not firsts[0] & firsts[1]:
            return None
        # the initial of a short form stands behind that of the name itself
        given, used = int(small.given[:1] != large.given[:1]), int(len(small.given) != len(large.given))
    elif small.given and large.given:
        given, used = _given(small, large, country, lexicon), 0
        if given == 9:
            return None
    else:
        given, used = 0, 1
    bag = _bag(small.rest, large.rest)
    if bag is None or not bag[2]:
        return None
    cost, used, part = given + bag[0], used + bag[1], len(small.rest) < len(large.rest)
    if cost > 2:
        return None
    if used or part:
        return (1, cost)
    return (2 if cost else 3, cost)


def _same_kind(a: tuple[str, ...], b: tuple[str, ...], lexicon: Lexicon) -> bool:
    def whole(x: tuple[str, ...]) -> bool:
        return not x[0].startswith("=") and not x[0].endswith(".")

    if not whole(a) and not whole(b):
        return a == b
    if whole(a) and whole(b):
        return _bag(a, b) is not None if len(a) == len(b) else False
    short, long_ = (a, b) if not whole(a) else (b, a)
    if short[0].endswith("."):
        return long_[0].startswith(short[0][:-1])
    letters = short[0][1:]
    if letters in lexicon.kinds:
        return _word(lexicon.kinds[letters], long_[0]) < 9
    return letters in ("".join(w[0] for w in long_), "".join(w[0] for w in long_ if w not in lexicon.particles))


def _skeleton(word: str) -> str:
    """The consonants of a word, doubled ones once."""
    out = ""
    for c in word:
        if c not in "aeiouy" and out[-1:] != c:
            out += c
    return out


def word_keys(w: str) -> set[str]:
    """Of two words that differ by slips, one of these must be the same: the begin, the end, and begin, end and letters of the
    consonants. A slip or two leave one of them as it is."""
    k = _skeleton(w)
    return {f"f{w[:4]}", f"l{w[-4:]}", f"s{''.join(sorted(k))[:6]}", f"m{k[:4]}", f"n{k[-4:]}"}


def place_keys(p: Name) -> set[str]:
    """The same for the places of two bodies: the begin and the end."""
    whole = "".join(p.rest)
    return {f"b{whole[:4]}", f"e{whole[-4:]}"}


def leads(p: Name, country: str, lexicon: Lexicon = LEXICON) -> list[tuple[str, str, bool]]:
    """(lead, word, anchor): under what a name meets others. The words of persons lie under the initials that the given name
    may have, a long whole surname also without one, places of bodies under the number of their words. Of two names that match,
    the last word of the shorter one stands for one of the other's, so that one of two words that meet must be an anchor."""
    if p.body:
        return [(f"b{len(p.rest)}", p.rest[-1], True)] if p.rest else []
    words = [w for w in p.rest if len(w) > 1]
    anchors = {words[-1]} if words and len(words) == len(p.rest) else set(words)
    out = {(f"i{x[:1]}", w, w in anchors) for x in _forms(p.given, country, lexicon) for w in words}
    if p.rest and len(p.rest[-1]) > 6:
        out.add(("w", p.rest[-1], True))
    return sorted(out)


def rests(w: str) -> list[str]:
    """What words that are the same up to slips (see `_word`) share one of at least: the word, what is left of it after
    deletions, and what particles at its begin are glued to."""
    out = {w} | {w[k:] for k in range(2, len(w) - 3) if GLUED.fullmatch(w[:k])}
    if len(w) > LONG - 2:
        out |= {f"={x}" for x in word_keys(w)}
    if 2 < len(w) <= LONG:
        once = {w[:k] + w[k + 1 :] for k in range(len(w))}
        out |= once
        if len(w) > 3:
            out |= {x[:k] + x[k + 1 :] for x in once for k in range(len(x))}
    return sorted(out)


def same_word(lead: str, a: str, b: str) -> bool:
    return _word(a, b) < 9 and (lead[0] == "b" or not word_keys(a).isdisjoint(word_keys(b)))


def spellings(speeches: DataFrame, key: str = "speech_id") -> DataFrame:
    """country, name and the valid speaker ids with their counts, of all distinct spellings. The country is that of a
    speech's first delivery; null and empty names are left out. Counted on the map side before any shuffle of names."""
    home = first_delivery(speeches, {"home": country_name(F.col("country"))}, key)
    used = speeches.where(F.col("speaker_name").isNotNull() & (F.trim("speaker_name") != "")).select(key, "speaker_name", "speaker_id").distinct()
    valid = F.when(~F.lower(F.trim("speaker_id")).isin(*MISSING), F.trim("speaker_id"))
    counted = used.join(home, key).groupBy("home", F.col("speaker_name").alias("name"), valid.alias("sid")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.collect_list(F.when(F.col("sid").isNotNull(), F.struct("sid", "n")))
    return counted.where("home IS NOT NULL").groupBy(F.col("home").alias("country"), "name").agg(listed.alias("ids"))


def _joined(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a and b joined by key; a key of many rows of b is met in salted parts, so that no task has all of its pairs."""
    hot = cut(b.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART).select(key, F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    if hot.isEmpty():
        return a.join(b, key)
    hot = small(hot, 32)
    part = F.pmod(F.xxhash64(*b.columns, F.lit(1)), F.coalesce("parts", F.lit(1))).cast("int")
    b = b.join(hot, key, "left").withColumn("part", part).drop("parts")
    a = a.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return a.join(b, [key, "part"]).drop("part")


def _named(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*(F.col(old).alias(new) for old, new in names.items()))


def linked(forms: DataFrame, lexicon: Lexicon = LEXICON) -> tuple[DataFrame, int]:
    """a, b (a < b), level, slips: all pairs of different forms (fid, country, form) of which `compare` says that they may be
    the same, and how many pairs it was asked for. Distinct words are matched first, then only the names that have them meet."""

    @F.pandas_udf("array<struct<lead:string,word:string,anchor:boolean>>")
    def led(form: pd.Series, country: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("lead", "word", "anchor"), x, strict=True)) for x in leads(unpacked(f), c, lexicon)] for f, c in zip(form, country, strict=True)], dtype=object)

    @F.pandas_udf("array<string>")
    def left(word: pd.Series) -> pd.Series:
        return pd.Series([rests(w) for w in word], dtype=object)

    @F.pandas_udf("boolean")
    def same(lead: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([same_word(x, y, z) for x, y, z in zip(lead, a, b, strict=True)], dtype=bool)

    @F.pandas_udf("level int, slips int")
    def compared(a: pd.Series, b: pd.Series, country: pd.Series) -> pd.DataFrame:
        def one(x: Name, y: Name, c: str) -> tuple[int, int]:
            return (0, 9) if x.body and y.body and place_keys(x).isdisjoint(place_keys(y)) else compare(x, y, c, lexicon) or (0, 9)

        return pd.DataFrame([one(unpacked(x), unpacked(y), c) for x, y, c in zip(a, b, country, strict=True)], columns=["level", "slips"])

    rows = forms.select("fid", "country", F.explode(led("form", "country")).alias("x")).select("fid", "country", "x.*")
    rows = cut(rows.withColumn("g", F.xxhash64("country", "lead", "word")))
    groups = rows.where("lead <> 'w'").select("g", "country", "lead", "word").distinct()
    some = cut(groups.select("g", "lead", "word", F.explode(left("word")).alias("rest"), "country").select(F.xxhash64("country", "lead", "rest").alias("key"), "g", "lead", "word"))
    near = _joined(_named(some, key="key", g="g", lead="lead", word="word"), _named(some, key="key", g="h", word="other"), "key").where("g < h")
    near = near.select("g", "h", "lead", "word", "other").distinct()
    near = cut(near.where(same("lead", "word", "other")).select("g", "h"))
    near = near.unionByName(rows.select("g", F.col("g").alias("h")).distinct())
    a, b = _named(rows, fid="x", g="g", anchor="anchor_x"), _named(rows, fid="y", g="h", anchor="anchor_y")
    met = _joined(a.join(near, "g").select("x", "anchor_x", "h", (F.col("g") == F.col("h")).alias("one")), b, "h").where("(anchor_x OR anchor_y) AND (x < y OR NOT one AND x <> y)")
    met = cut(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    both = met.join(_named(forms, fid="a", form="form_a", country="country"), "a").join(_named(forms, fid="b", form="form_b"), "b")
    found = cut(both.select("a", "b", compared("form_a", "form_b", "country").alias("r")).select("a", "b", "r.*").where("level > 0"))
    asked = met.count()
    release(rows, some, met)
    return found, asked


#: A profile's votes: its speaker ids with the sums of their counts.
TALLY = (
    "map_from_arrays(array_distinct(filter(ids.sid, s -> s IS NOT NULL)), "
    "transform(array_distinct(filter(ids.sid, s -> s IS NOT NULL)), s -> aggregate(filter(ids, i -> i.sid = s), 0L, (t, i) -> t + i.n)))"
)


class Resolution:
    """The entities behind a table of spellings (country, name, ids: array of (sid, n)).

    entities: country, pid, names, ids — one row per entity; a spelling that matches nothing is an entity of its own. Spellings
    of different countries never match. Repeated rows of a spelling count once. Without rows there are no entities.
    rounds: how many rounds merged something. compared: how many pairs of names were compared.
    """

    def __init__(self, names: DataFrame, lexicon: Lexicon = LEXICON) -> None:
        @F.pandas_udf("form string, whole int, words int, itself boolean")
        def parsed(name: pd.Series, country: pd.Series) -> pd.DataFrame:
            each = [(parse(n, c, lexicon), c) for n, c in zip(name, country, strict=True)]
            return pd.DataFrame([(p.packed(), p.full(), len(p.rest), compare(p, p, c, lexicon) is not None) for p, c in each], columns=["form", "whole", "words", "itself"])

        once = names.where("country IS NOT NULL AND name IS NOT NULL").groupBy("country", "name").agg(F.flatten(F.collect_list("ids")).alias("ids"))
        self.entities = cut(once.select(F.xxhash64("country", "name").alias("pid"), "country", F.array("name").alias("names"), "ids"))
        read = self.entities.select("pid", "country", parsed(F.col("names")[0], "country").alias("p"))
        read = cut(read.select("pid", "country", "p.*", F.xxhash64("country", "p.form").alias("fid")))
        found, self.compared = linked(read.select("fid", "country", "form").distinct(), lexicon)
        # the pairs of spellings: those of one form, and those of two forms that may be the same
        alike = read.where("itself").select("fid").distinct().select(F.col("fid").alias("a"), F.col("fid").alias("b"), F.lit(3).alias("level"), F.lit(0).alias("slips"))
        links = found.unionByName(alike).join(_named(read, fid="a", pid="x"), "a")
        links = _joined(links, _named(read, fid="b", pid="y"), "b").where("a <> b OR x < y")
        #: x, y, level, slips: spellings that may be the same
        self.links = cut(links.select("x", "y", "level", "slips"))
        #: s, pid, rank: the profile of each spelling and how full the spelling is
        self.members = cut(read.select(F.col("pid").alias("s"), "pid", F.struct("whole", "words").alias("rank")))
        release(read, found)
        self.rated = cut(self._rate())
        self.rounds = 0
        while (edges := self._edges()) is not None:
            self._merge(edges)
            self.rounds += 1

    def _rate(self, fresh: DataFrame | None = None) -> DataFrame:
        """The pairs a < b of profiles (one of them fresh, if given) that match, with level (1 to 3), slips, share of common speaker
        ids, and which of the two is the poorer one (0 or 1)."""
        members = self.members if fresh is None else self.members.join(fresh.withColumn("fresh", F.lit(True)), "pid", "left")
        members = members.withColumn("top", F.col("rank") == F.max("rank").over(Window.partitionBy("pid")))
        members = members.withColumn("fresh", F.lit(True) if fresh is None else F.coalesce("fresh", F.lit(False)))
        pairs = self.links.join(_named(members, s="x", pid="p", top="top_x", fresh="fresh_x"), "x").join(_named(members, s="y", pid="q", top="top_y", fresh="fresh_y"), "y")
        pairs = pairs.where("p <> q AND (fresh_x OR fresh_y)").groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
        # the fullest spellings of both must go together
        pairs = pairs.agg(F.max(F.struct("level", (-F.col("slips")).alias("kept"))).alias("best"), F.max(F.expr("top_x AND top_y")).alias("top")).where("top")
        tops = self.members.groupBy("pid").agg(F.max("rank").alias("rank"))
        sides = self.entities.join(tops, "pid").select("pid", F.expr(TALLY).alias("ids"), "rank", F.size("names").alias("n"))
        sides = sides.withColumn("votes", F.expr("aggregate(map_values(ids), 0L, (t, n) -> t + n)"))
        side = lambda k: sides.select(F.col("pid").alias(k), F.col("ids").alias(f"ids_{k}"), F.col("votes").alias(f"votes_{k}"), F.struct("rank", "n", "votes").alias(f"size_{k}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").selectExpr("a", "b", "best.level AS level", "-best.kept AS slips", "size_a", "size_b", "least(votes_a, votes_b) AS votes", "ids_a", "ids_b")
        both = both.withColumn("common", F.expr("aggregate(map_keys(ids_a), 0L, (t, s) -> t + if(map_contains_key(ids_b, s), least(ids_a[s], ids_b[s]), 0L))"))
        # ids of their own speak against slips: two of them need a common id if both sides have any;
        # without ids, so many slips need all parts and a rival-free match
        level = F.expr("CASE WHEN level < 3 AND slips > 0 AND common = 0 AND votes >= if(slips = 1, 3, 1) THEN 0 WHEN slips = 2 AND common = 0 THEN if(level = 2, 1, 0) ELSE level END")
        return both.select("a", "b", level.alias("level"), "slips", F.expr("if(votes > 0, common / votes, 0D)").alias("overlap"), F.expr("int(size_b < size_a)").alias("poorer")).where("level > 0")

    def _edges(self) -> DataFrame | None:
        clear = self.rated.where("level > 1")
        if not clear.isEmpty():
            return clear.select("a", "b")
        # what is left are spellings with parts left out: each is tied to one profile or to none
        poor = self.rated.select(F.expr("if(poorer = 0, a, b)").alias("x"), F.expr("if(poorer = 0, b, a)").alias("y"), "slips", "overlap")
        rank = Window.partitionBy("x").orderBy(F.desc("overlap"), "slips", "y")
        every = Window.partitionBy("x")
        ranked = poor.withColumns({"place": F.row_number().over(rank), "n": F.count(F.lit(1)).over(every), "next": F.lead("overlap").over(rank), "next_slips": F.lead("slips").over(rank)})
        sure = ranked.where("place = 1 AND (n = 1 OR overlap > next OR slips < next_slips)")
        return None if sure.isEmpty() else cut(sure.select(F.col("x").alias("a"), F.col("y").alias("b")))

    def _merge(self, edges: DataFrame) -> None:
        """Merge along the edges; only the merged profiles are rated again."""
        nodes = cut(components(edges).withColumnRenamed("node", "pid"))
        of = small(nodes, 48)
        touched = small(nodes.select("pid"), 32)
        entities, members, rated = self.entities, self.members, self.rated
        moved = entities.join(of, "pid").groupBy(F.col("component").alias("pid"))
        moved = moved.agg(F.min("country").alias("country"), F.flatten(F.collect_list("names")).alias("names"), F.flatten(F.collect_list("ids")).alias("ids"))
        self.entities = cut(entities.join(touched, "pid", "left_anti").unionByName(moved))
        self.members = cut(members.join(of, "pid", "left").select("s", F.coalesce("component", "pid").alias("pid"), "rank"))
        kept = rated
        for end in ("a", "b"):
            kept = kept.join(touched.withColumnRenamed("pid", end), end, "left_anti")
        again = self._rate(cut(nodes.select(F.col("component").alias("pid")).distinct()))
        self.rated = cut(kept.select(again.columns).unionByName(again))
        release(entities, members, rated, nodes)

    def pairs(self) -> DataFrame:
        """country, name_a, name_b: all pairs of different spellings of one entity, name_a < name_b by code point."""
        rows = self.entities.where(F.size("names") > 1)
        a = rows.select("country", "names", F.explode("names").alias("name_a"))
        return a.select("country", "name_a", F.explode("names").alias("name_b")).where("name_a < name_b")


def p2_found(spark, sf_dir):
    return Resolution(spellings(table(spark, sf_dir, "speeches"))).pairs()


def p2_entities(spark, sf_dir):
    """Every spelling with the least spelling of its entity."""
    found = Resolution(spellings(table(spark, sf_dir, "speeches"))).entities
    return found.select("country", F.array_min("names").alias("entity"), F.explode("names").alias("name"))
