"""Problem 1: raw transcripts into clean, ordered speaker turns.

A record's text is cut into blocks at its times (or lines). Its clock is repaired by isotonic regression within segments. A
segment begins where the clock was reset: where two fits leave fewer blocks off than one. Within a segment the blocks keep
their stored order, each with the fitted time, but for those whose own time is off the fit: they were stored out of order
and go where the fitted clock passes their time. Labels are read in all their styles and resolved to the record's speakers,
sound notes, recording times and hesitations are removed, and neighbouring blocks of one speaker are merged into turns.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenaria.functions.countries import country_name
from plenaria.functions.deliveries import first_rows
from plenaria.llm.codepoints import pieces
from plenaria.llm.folding import fold, osa
from plenaria.runtime import table

# Words.
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: Seconds that a time may lie off the isotonic fit and still count as jitter.
JITTER = 0.5
#: A reset must spare more than this many blocks from being moved.
RESET_COST = 2.5

# Times that only mark the recording, at the begin of a block and inside of one.
BLOCK_TIME = re.compile(
    r"^[ \t]*(?:(?P<srt>\d+:\d\d:\d\d[.,]\d{1,3})[ \t]*-->[^\n]*|(?P<pipe>\d+:\d\d:\d\d(?:[.,]\d+)?)[ \t]*\|[ \t]*|\[(?P<bracket>(?:\d+:)?\d{1,2}:\d\d(?:[.,]\d+)?)\][ \t]*"
    r"|\((?P<paren>(?:\d+:)?\d{1,3}:\d\d)\)[ \t]*|<t=(?P<seconds>\d+(?:\.\d+)?)>[ \t]*|(?P<plain>\d{1,2}:\d\d:\d\d(?:[.,]\d+)?)(?=\s|$)[ \t]*)"
)
INNER_TIME = re.compile(r"[\[<](?:(?<=\[)(?:\d+:)?\d{1,2}:\d\d(?:[.,]\d+)?\]|(?<=<)t=\d+(?:\.\d+)?>)")
SRT_NUMBER = re.compile(r"^\d+$")
# Hesitation sounds by country (letters may be drawn out), and those of all.
HESITATIONS = {
    "Germany": r"ä+h+m*|ö+h+m*|h+m+",
    "Netherlands": r"e+h+m*|u+h+m*|h+m+",
    "France": r"e+u+h+|h+e+u+|h+u+m+|h+m{2,}",
    "Italy": r"e+h+m*|u+h+m+|m{2,}|h+m{2,}",
    "Spain": r"e+h+m*|e+m+|m{2,}|h+m{2,}",
    "Poland": r"e{2,}m*|y{2,}|y+h+m+|h+m{2,}",
}
ALL_HESITATIONS = r"ä+h+m*|ö+h+m*|e{2,}h*m*|e+hm+|u+hm+|hm+|h+m{2,}|y{2,}|m{3,}"
# Words (folded) that begin sound notes, of which a first word may say how.
SOUNDS = (
    "applaus", "aplaus", "applaudissement", "beifall", "oklaski", "geroffel", "lachen", "gelach", "hilariteit", "heiterkeit", "rires", "rire", "sourires", "risas",
    "si ride", "ilarita", "smiech", "wesolosc", "unruhe", "rumoer", "rumores", "rumori", "brouhaha", "brusio", "murmures", "murmullos", "mormorii", "poruszenie",
    "gwar", "glocke", "voorzittershamer", "suono", "dzwonek", "cloche", "campanilla", "campanella", "telefon", "suena", "sonnerie", "zuruf", "roepen", "exclamations",
    "commenti", "glosy", "glos z", "widerspruch", "protest", "proteste", "protestas", "protestations", "micro", "geluid", "interruzione", "interruption", "interrupcion",
    "zaklocenia", "pausa", "pause", "pauza", "stille", "silence", "silencio", "silenzio", "cisza", "musik", "muziek", "musique", "musica", "muzyka",
)
BRACKETED = re.compile(r"[(\[<*](?:(?<=\()(?P<round>[^()\n]+)\)|(?<=\[)([^\[\]\n]+)\]|(?<=<)([^<>\n]+)>|(?<=\*)([^*\n]+)\*)")
#: A note's words: maybe one that says how, then the sound, maybe with an ending of a letter or two.
SOUND = re.compile(rf"(?:\w+ )?(?:{'|'.join(SOUNDS)})\w{{0,2}}\b")
# Words of a presiding officer's label, titles, and particles of names (all folded).
OFFICES = frozenset(
    "prasident prasidentin vizeprasident vizeprasidentin voorzitter ondervoorzitter president presidente presidenta vicepresident vicepresidente vicepresidenta marszalek wicemarszalek przewodniczacy przewodniczaca".split()
)
TITLES = frozenset(
    "dr prof mr ir drs mag m mme mlle mm me monsieur madame herr frau abg sr sra srta d dna don dona senor senora on sen dott dottssa avv ing pan pani posel poslanka pos heer mevrouw mevr dhr".split()
)
PARTICLES = frozenset("de del della dello degli di da dal dalla du des d la le el los las van von vom zu zur zum z ten ter ter den der het 't v und y i e".split())
DASHES = ("-", "–", "—")
LINKS = frozenset("de del della di da du des la le el los las van von vom zu zur zum z ten ter den der het".split())
PARTY = re.compile(r"\s*\(([^()\d]{2,})\)\s*$")


def seconds(mark: str) -> float:
    total = 0.0
    for part in mark.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


@dataclass
class Block:
    """Text between two marks; lines: the label line and what follows."""

    time: float | None
    lines: list[str] = field(default_factory=list)


def blocks(raw: str) -> list[Block]:
    """The blocks of a record in stored order. Lines without a time go with the timed block before them; in a record
    without any times every line is a block (a label line goes with the line after it)."""
    lines = [x.strip() for x in re.split(r"\r\n|[\r\n\x0b\x0c\x85\u2028\u2029]", raw)]
    lines = [x for k, x in enumerate(lines) if not (SRT_NUMBER.match(x) and k + 1 < len(lines) and "-->" in lines[k + 1])]
    marks = [BLOCK_TIME.match(x) for x in lines]
    timed = any(marks)
    out: list[Block] = []
    for line, mark in zip(lines, marks, strict=True):
        if mark:
            found = next(v for v in mark.groups() if v is not None)
            out.append(Block(seconds(found)))
            line = line[mark.end() :].strip()
        if not line:
            continue
        if timed and out:
            out[-1].lines.append(line)
        elif not timed and out and len(out[-1].lines) == 1 and own_line(out[-1].lines[0]):
            out[-1].lines.append(line)
        else:
            out.append(Block(None, [line]))
    return [b for b in out if b.lines]


def isotonic(values: list[float]) -> list[float]:
    """Non-decreasing fit with the least sum of absolute errors; where several are equal, the lowest."""
    heap: list[float] = []
    tops = []
    for v in values:
        heapq.heappush(heap, -v)
        if -heap[0] > v:
            heapq.heapreplace(heap, -v)
        tops.append(-heap[0])
    for k in range(len(tops) - 2, -1, -1):
        tops[k] = min(tops[k], tops[k + 1])
    return tops


def _kept(values: list[float]) -> list[int]:
    """Of each prefix, how many values lie on the non-decreasing fit that leaves the fewest off (0/1 loss)."""
    tails: list[float] = []
    out = []
    for v in values:
        if not tails or v >= tails[-1]:
            tails.append(v)
        else:
            tails[bisect.bisect_right(tails, v)] = v
        out.append(len(tails))
    return out


def segments(times: list[float]) -> list[int]:
    """Where the segments of a clock begin. A segment is cut in two at the fall after which two fits leave the fewest blocks
    off, if that spares more than RESET_COST blocks from being moved; so on with both parts, each in n log n."""
    out, open_ = [], [(0, len(times))]
    while open_:
        begin, end = open_.pop()
        part = times[begin:end]
        before = _kept(part)
        if len(part) - before[-1] > RESET_COST:
            after = _kept([-t for t in reversed(part)])[::-1]
            falls = [k for k in range(1, len(part)) if part[k] < part[k - 1]]
            kept = [before[k - 1] + after[k] for k in falls]
            most = max(kept)
            if most - before[-1] > RESET_COST:
                best = [k for k, n in zip(falls, kept, strict=True) if n == most]
                reset = begin + max(best, key=lambda k: (part[k - 1] - part[k], -abs(2 * k - len(part))))
                open_ += [(reset, end), (begin, reset)]
                continue
        out.append(begin)
    return out


def repaired(times: list[float]) -> list[tuple[int, float]]:
    """The places of the times in spoken order, each with its repaired time on one running clock.

    Within a segment, times close to the isotonic fit take the fitted one and stay in stored order; the others are merged in
    where the fit passes them. A later segment goes on from the end of the one before it.
    """
    out: list[tuple[int, float]] = []
    begins = segments(times)
    base = 0.0
    for begin, end in zip(begins, [*begins[1:], len(times)], strict=True):
        part = times[begin:end]
        on, off = [], []
        for k, (own, fit) in enumerate(zip(part, isotonic(part), strict=True), begin):
            if abs(own - fit) <= JITTER:
                on.append((fit, k))
            else:
                off.append((own, k))
        out += [(k, base + t) for t, k in heapq.merge(on, sorted(off))]
        base = out[-1][1]
    return out


def ordered(found: list[Block]) -> list[Block]:
    """Blocks in spoken order with their repaired times; a block without time stays behind the one before it."""
    timed = [k for k, b in enumerate(found) if b.time is not None]
    if len(timed) < 2:
        return found
    ends = [*timed[1:], len(found)]
    out = found[: timed[0]]
    for place, time in repaired([found[k].time for k in timed]):
        first, *rest = found[timed[place] : ends[place]]
        out += [Block(time, first.lines), *rest]
    return out


@dataclass
class Label:
    """A speaker label: name tokens (folded, without titles and particles), the given name or initial, party, office."""

    text: str
    given: str | None
    names: list[str]
    party: str | None
    office: bool
    titled: bool = False

    def richness(self) -> tuple[int, int]:
        return (self.given is not None and len(self.given) > 1) + bool(self.names), len(self.names)


@functools.lru_cache(100_000)
def _office(word: str) -> bool:
    return word in OFFICES or (len(word) > 6 and any(osa(word, o, 1) < 2 for o in OFFICES if len(o) > 6))


# Words of a label, sentence marks that end no label, an initial at the end.
NAME_WORD = regex.compile(r"[\p{L}\p{M}’'.-]+")
DIGIT = re.compile(r"\d")
SENTENCE_END = re.compile(r"[.!?…;:]\s*$")
INITIAL_END = re.compile(r"\b[^\W\d_]\.$")
#: A label whose style marks it as one may have that many words in small letters; more are a sentence.
SLIPS = 4


@functools.lru_cache(20_000)
def read_label(text: str, country: str | None, sure: bool) -> Label | None:
    """The label in a piece of text, or None if it is none. sure: its style marks it as a label whatever its words."""
    body = text.strip(" \t>[]").rstrip(":–—- \t")
    party = PARTY.search(body)
    if party:
        body = body[: party.start()]
    body = body.strip().rstrip(":").strip()
    if not body or body.count(",") > 1 or DIGIT.search(body) or SENTENCE_END.search(body) and not INITIAL_END.search(body):
        return None
    tokens = NAME_WORD.findall(body)
    if not tokens:
        return None
    names, office, initials, plain, titled = [], False, [], True, False
    comma = body.find(",")
    spot = 0
    surname: list[str] = []
    for t in tokens:
        spot = body.find(t, spot)
        dotted, w = t.endswith("."), fold(t.strip(".'’-")).replace(".", "")
        at_front = comma >= 0 and spot < comma
        spot += len(t)
        if not w:
            continue
        if _office(w):
            office = True
        elif w in LINKS or (w in PARTICLES and not t[0].isupper()):
            continue
        elif w in TITLES and (len(w) > 1 or country == "France" and w == "m" or country == "Spain" and w == "d" and names == [] and len(tokens) > 2 and fold(tokens[0]).startswith("sr")):
            titled = True
            continue
        elif office and not t[0].isupper():
            plain = False
        elif dotted and len(w) <= 2 or len(w) == 1 and t[0].isupper():
            initials.append(w[0])
        else:
            if not t.lstrip("'’").replace("l'", "")[:1].isupper():
                plain = False
            names.append(w)
            if at_front:
                surname.append(w)
    if not plain and (office or not sure or sum(not t[:1].isupper() for t in tokens) > SLIPS):
        return None
    if not names and not office:
        return None
    if office and not names:
        return Label(text, None, [], None, True)
    given = initials[0] if initials else None
    if comma >= 0 and surname:
        rest = [n for n in names if n not in surname]
        given = rest[0] if rest else given
        names = surname
    elif len(names) > 1 and not initials:
        given, names = names[0], names[1:]
    return Label(text, given, names, party.group(1).strip() if party else None, office, titled)


# The styles of labels, all before what is said.
OWN_LINE = re.compile(r"[^:.!?;\d(–*\[<-][^:.!?;\d]*(?:[^\W\d_]\.[^:!?;\d]*)?\(([^()\d]{2,})\)")
ARROWED = re.compile(r">>\s*([^:\n]+):")
IN_BRACKETS = re.compile(r"\[([^\[\]\d]+)\]")
PARTY_THEN_MARK = re.compile(r"((?:[^:.!?\n(]|\b[^\W\d_]{1,5}\.)+\(([^()\d]{2,})\))\s*(?:[–—-]\s|:)")
PARTY_ONLY = re.compile(r"([^:!?()\d\n]+\(([^()\d]{2,})\))\s")
DASHED = re.compile(r"([^:–—\n]+?)\s+[–—]\s")
COLON = re.compile(r"([^:\n]+):(?=\s|$)")
SMALL_THEN_NAME = regex.compile(r"(?:\p{Ll}+ )+\p{Lu}")


def is_party(inner: str) -> bool:
    """Whether what stands in a bracket after a name may be a party: words that begin with a capital, and no sound note."""
    return all(w[:1].isupper() or w in LINKS for w in inner.split()) and not is_sound(inner)


def own_line(line: str) -> bool:
    """Whether a line is nothing but `Name (PARTY)`."""
    m = OWN_LINE.fullmatch(line) if line.endswith(")") else None
    return bool(m) and is_party(m.group(1))


@functools.lru_cache(100_000)
def is_sound(inner: str) -> bool:
    return bool(SOUND.match(fold(inner).strip()))


def split_label(lines: list[str], country: str | None, known: frozenset[str] = frozenset()) -> tuple[Label | None, str]:
    """The label of a block and the rest of its text. known: names that the record's other labels have (folded); with one of
    them, a slip in the case of a label's letters doesn't matter."""
    first = lines[0]
    rest = "\n".join(lines[1:])
    join = lambda a: f"{a}\n{rest}" if rest else a
    if own_line(first) and (label := read_label(first, country, True)):
        return label, rest
    if first[:1] == ">" and (m := ARROWED.match(first)) and (label := read_label(m.group(1), country, True)):
        return label, join(first[m.end() :])
    if first[:1] == "[" and (m := IN_BRACKETS.match(first)) and not is_sound(m.group(1)):
        label = read_label(m.group(1), country, False)
        if label and (label.office or label.given or label.names and rest + first[m.end() :]):
            return label, join(first[m.end() :])
    if "(" in first:
        if (m := PARTY_THEN_MARK.match(first)) and is_party(m.group(2)) and (label := read_label(m.group(1), country, True)):
            return label, join(first[m.end() :])
        if (m := PARTY_ONLY.match(first)) and is_party(m.group(2)) and (label := read_label(m.group(1), country, False)):
            return label, join(first[m.end() :])
    if m := DASHED.match(first):
        label = read_label(m.group(1), country, False)
        if label and label.office:
            return label, join(first[m.end() :])
    if m := COLON.match(first):
        label = read_label(m.group(1), country, False)
        # one capitalised word before a colon is a label only in capitals or as an office
        if not label and known:
            label = read_label(m.group(1), country, True)
            if label and not any(_same_word(x, y) for x in label.names for y in known if len(y) > 4):
                label = None
        if label and (label.office or label.given or label.party or label.titled or m.group(1).isupper() or len(label.names) > 1 or SMALL_THEN_NAME.match(m.group(1))):
            return label, join(first[m.end() :])
    return None, join(first)


@functools.lru_cache(200_000)
def _same_word(a: str, b: str) -> bool:
    if a == b:
        return True
    n = min(len(a), len(b))
    most = 0 if n < 4 else 1 if n < 8 else 2
    plain = lambda w: w.replace("ae", "a").replace("oe", "o").replace("ue", "u")
    return osa(a, b, most) <= most or osa(plain(a), plain(b), most) <= most


def _same_name(a: Label, b: Label) -> bool:
    if not a.names or not b.names or not any(_same_word(x, y) for x in a.names for y in b.names):
        return False
    if a.given and b.given:
        if len(a.given) == 1 or len(b.given) == 1:
            return a.given[0] == b.given[0]
        return _same_word(a.given, b.given)
    return True


class Speakers:
    """The speakers of one record, resolved from all of its labels."""

    def __init__(self, labels: list[Label]) -> None:
        self.groups: list[list[Label]] = []
        self.of: dict[str, list[int]] = {}
        distinct = list({x.text: x for x in labels}.values())
        # full names first, of them the spelling that most labels have
        often = Counter((x.given, *x.names) for x in labels)
        for label in sorted((x for x in distinct if x.names), key=lambda x: (x.richness(), often[x.given, *x.names]), reverse=True):
            fits = [k for k, g in enumerate(self.groups) if any(_same_name(label, x) for x in g) and all(_same_name(label, x) for x in g[:1])]
            if len(fits) > 1:
                off = {k: min(osa(a, b, 9) for x in self.groups[k] for a in label.names for b in x.names) for k in fits}
                fits = [k for k in fits if off[k] == min(off.values())]
            if label.party and len(fits) > 1:
                fits = [k for k in fits if any(x.party == label.party for x in self.groups[k])] or fits
            if label.office and len(fits) > 1:
                fits = [k for k in fits if any(x.office for x in self.groups[k])] or fits
            if not fits:
                fits = [len(self.groups)]
                self.groups.append([])
            if len(fits) == 1:
                self.groups[fits[0]].append(label)
            self.of[label.text] = fits
        presiding = [k for k, g in enumerate(self.groups) if any(x.office for x in g)]
        bare = [x for x in distinct if not x.names]
        if bare and not presiding:
            presiding = [len(self.groups)]
            self.groups.append(bare)
        for label in bare:
            self.of[label.text] = presiding

    def resolve(self, label: Label, recent: list[int]) -> int:
        """The speaker of a label; where several fit, the one who spoke last, else the first."""
        fits = self.of[label.text]
        return next((k for k in recent if k in fits), fits[0])


#: Stands where a note was, until the dashes around it are gone.
NOTE = "\ufdd1"


def _note(m: re.Match) -> str:
    inner = next(x for x in m.groups() if x is not None)
    # brackets of speech are round: the others hold notes, unless they hold figures
    gone = is_sound(inner) or m.group("round") is None and not DIGIT.search(inner)
    return NOTE if gone else m.group(0)


def without_notes(text: str) -> str:
    """text without sound notes and the dashes that set them off."""
    first, *others = BRACKETED.sub(_note, text).split(NOTE)
    out = [first]
    for part in others:
        before, after = out[-1].rstrip(" \t"), part.lstrip(" \t")
        if before[-1:] in DASHES:
            out[-1] = before[:-1]
        out.append(after[1:] if after[:1] in DASHES and not after[1:2].strip() else part)
    return " ".join(out)


_FILLERS: dict[str | None, regex.Pattern] = {}


def fillers(country: str | None) -> regex.Pattern:
    """Hesitations of a country with the pause mark after them."""
    if country not in _FILLERS:
        sounds = HESITATIONS.get(country, ALL_HESITATIONS)
        _FILLERS[country] = regex.compile(rf"(?<![\p{{L}}\p{{N}}'’-])(?:{sounds})(?![\p{{L}}\p{{N}}'’]|-[\p{{L}}])(?:\s*(?:\.\.\.|…|,|[–—-](?=\s|$)))?", regex.IGNORECASE)
    return _FILLERS[country]


# A blank before a mark, and what a turn doesn't begin with.
BEFORE_MARK = re.compile(r" ([,.!?…])")
LEADING = " ,.…–—-"
#: Stands between the texts of a batch while they are cleaned together.
BORDER = "\n\ufdd0\n"


def clean_all(texts: list[str], country: str | None) -> list[str]:
    """What was said, of each text: without recording times, sound notes and hesitations, with tidy blanks, marks and capital.

    All texts go through each pattern at once; a pattern doesn't match across a border between two.
    """
    together = BORDER.join(x.replace("\ufdd0", " ").replace(NOTE, " ") for x in texts)
    together = without_notes(INNER_TIME.sub(" ", together))
    together = " ".join(fillers(country).sub(" ", together).split())
    together = BEFORE_MARK.sub(r"\1", together)
    out = (x.lstrip(LEADING).rstrip(" ") for x in together.split("\ufdd0"))
    return [x[:1].upper() + x[1:] for x in out]


def labelled(raw: str | None, country: str | None) -> list[tuple[Label | None, str, float | None]]:
    """Label, uncleaned text and repaired time of a record's blocks in spoken order."""
    found = ordered(blocks(raw)) if raw else []
    parts = [split_label(b.lines, country) for b in found]
    if known := frozenset(n for x, _ in parts if x for n in x.names):
        parts = [x if x[0] else split_label(b.lines, country, known) for x, b in zip(parts, found, strict=True)]
    return [(*x, b.time) for x, b in zip(parts, found, strict=True)]


def merged(parts: list[tuple[Label | None, str, int, float | None]], country: str | None, first_speaker: str | None) -> list[tuple]:
    """The turns of a record's blocks (label, what was said, its number of words, time) in spoken order."""
    start = read_label(first_speaker, country, True) if first_speaker else None
    speakers = Speakers([x for x, *_ in parts if x] + ([start] if start and any(not x and n for x, _, n, _ in parts[:1]) else []))
    out: list[list] = []
    numbers: dict[int, int] = {}
    recent: list[int] = []
    for label, said, n, time in parts:
        # a label names the speaker of what follows even if its own block is left without words
        if label:
            who = speakers.resolve(label, recent)
        elif recent:
            who = recent[0]
        else:
            who = speakers.resolve(start, []) if start and start.text in speakers.of else -1
        recent = [who, *(k for k in recent if k != who)]
        if not n:
            continue
        number = numbers.setdefault(who, len(numbers) + 1)
        if out and out[-1][1] == number:
            out[-1][3].append(said)
            out[-1][4] += n
        else:
            names = [x.text for x in speakers.groups[who]] if who >= 0 else [None]
            out.append([len(out) + 1, number, names[0], [said], n, time])
    return [(no, number, who, " ".join(said), n, time) for no, number, who, said, n, time in out]


def turns_of(records: list[tuple[str | None, str | None, str | None]]) -> list[list[tuple]]:
    """turn_no, speaker_no, speaker, text, n_words and begin of the turns of each record (raw, country, first speaker).

    Null, empty and speechless records have no turns. Text before any label belongs to the record's first speaker, if that
    is known, or to an unnamed one. begin is the repaired time in seconds, null in records without times.
    """
    parts = [labelled(raw, country) for raw, country, _ in records]
    said = [[""] * len(p) for p in parts]
    for country in {c for _, c, _ in records}:
        at = [(i, k) for i, (_, c, _) in enumerate(records) if c == country for k in range(len(parts[i]))]
        for (i, k), x in zip(at, clean_all([parts[i][k][1] for i, k in at], country) if at else [], strict=True):
            said[i][k] = x
    return [
        merged([(label, x, len(WORD.findall(x)), time) for (label, _, time), x in zip(p, texts, strict=True)], country, first)
        for (_, country, first), p, texts in zip(records, parts, said, strict=True)
    ]


def turns(raw: str | None, country: str | None = None, first_speaker: str | None = None) -> list[tuple]:
    """The turns of one record."""
    return turns_of([(raw, country, first_speaker)])[0]


TURNS = "speech_id string, turn_no int, speaker_no int, speaker string, text string, n_words int, begin double"
#: Characters of raw text that are cleaned together.
SLICE = 200_000


def speaker_turns(transcripts: DataFrame, raw: str = "raw_text") -> DataFrame:
    """One row per turn of each distinct speech_id (its first delivery): TURNS.

    Rows without speech_id are left out; records whose raw text is null, empty or without speech give no rows. A record is
    read whole whatever its length. Extra columns don't matter.
    """
    first = first_rows(transcripts, {"country": country_name(F.col("country")), "speaker_name": F.col("speaker_name"), "raw": F.col(raw)})
    names = [x.split()[0] for x in TURNS.split(", ")]

    def convert(batches):
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.float64()]
        for batch in batches:
            for part in pieces(batch, batch.schema.get_field_index("raw"), SLICE):
                rows = part.to_pydict()
                found = turns_of(list(zip(rows["raw"], rows["country"], rows["speaker_name"], strict=True)))
                flat = [(i, *t) for i, turns_ in zip(rows["speech_id"], found, strict=True) for t in turns_]
                if flat:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), kinds, strict=True)], names=names)

    return first.mapInArrow(convert, TURNS)


def p1_turns(spark, sf_dir):
    return speaker_turns(table(spark, sf_dir, "transcripts"))


def p1_found(spark, sf_dir):
    return p1_turns(spark, sf_dir).select("speech_id", "turn_no", "speaker_no", "n_words")


def p1_speech_turns(spark, sf_dir):
    return speaker_turns(table(spark, sf_dir, "speeches"))
