"""Speech transcripts into ordered turns of clean words.

A text is parsed by the cue form it is written in: bracketed ranges of seconds, subtitle cues with arrows, clock times
before the text, after the label in brackets, or on a line of their own, or labelled lines without times. Labels are
normalised in three steps. Numbered speakers and roles have a canonical form. Names are resolved against the full names of
the same transcript. What is still only a part of a name is looked up in the roster of the other transcripts of its file:
labels and roster meet on a phonetic key of a name's part, and an assignment of least cost decides. Then lexical noise
(hesitation sounds, sound notes, tags) is stripped; brackets of more than two words without a word of a sound note are spoken, utterances without words are dropped and runs of one speaker joined.

Cases: null, blank and other texts, and rows without an id, give no rows. An utterance without a label continues the speaker before it; before any
label it belongs to a speaker of its own. Ties of times keep the written order. Rows repeated under one id count once.
Texts of any length are read whole, line by line. Extra columns are ignored; a null file has no roster.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.skew import left_join
from fathomline.storage import spread, stage

# Hesitation sounds, other words that only fill, roles and titles, in English, Spanish, French and German.
HESITATIONS = "uh uhm um umm er erm ah ahm eh ehm em hm hmm mm mmm mhm oh euh heu hum bah ben äh ähm öh öhm tja".split()
FILLER_PHRASES = ("you know", "i mean", "o sea", "also äh", "you know what i mean")
ROLES = """host guest caller agent moderator interviewer interviewee client customer narrator presenter operator anchor reporter
anfitrión anfitriona invitado invitada moderador moderadora entrevistador entrevistadora agente cliente llamante narrador presentador
animateur animatrice invité invitée modérateur modératrice intervieweur client appelant agent hôte présentateur narrateur
gastgeber gastgeberin gast leiter leiterin moderatorin anrufer anruferin kunde kundin sprecher sprecherin interviewerin""".split()
TITLES = "dr prof mr mrs ms miss sr sra srta dra herr frau hr fr m mme mlle".split()

#: What it costs to give a label a name that another has: more than names can differ.
TAKEN = 2.0

_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\u00ad\u200b-\u200f\u2060\ufeff]")
_HESITATION = "|".join(sorted(HESITATIONS, key=len, reverse=True))
# Words of sound notes, by their beginnings. Longer brackets without one hold spoken words.
NOTES = """laugh chuckl applau music inaudibl unintelligibl crosstalk nois cough paus silenc sigh ring beep static overlap whisper door phone background clap cheer
risa ríe ríen aplaus músic inaudib ruido tos silenc suspir rire rit rient applaud musiq inaudib bruit toux soupir lach beifall musik unverständl geräusch hust stille seufz lärm""".split()
_NOTE = re.compile(rf"(?i)\[[^\]]*\]|\(\([^()]*\)\)|\(\s*(?:[^()\s]+\s*){{0,2}}\)|\([^()]*\b(?:{'|'.join(NOTES)})[^()]*\)|\{{[^}}]*\}}|<[^>]*>|\*[^*]+\*|[♪♫]")
# Sounds that are no words of another language, and sound notes: they show that a text is speech.
_SOUND = re.compile(r"(?i)\b(?:uh|uhm|hmm?|mmm|mhm|euh|heu|äh|ähm|öhm)\b|\b(?:i mean|you know),|[♪♫]|\[[a-z_ ]+(?: [\d:]+)?\]|(?-i:\(\(?[a-z]+(?: rings)?\)?\))|\{[a-z ]+\}|<noise>|\*[a-z]+\*")
_FILLER = re.compile(rf"(?i)(?<![\w'])(?:{'|'.join(FILLER_PHRASES)}|{_HESITATION}|este(?=,))(?![\w'])[,.…]*")
_GERMAN = re.compile(r"(?i)\b(?:der|die|das|den|und|nicht|ein|einen|mit|von|zu)\b")
_GERMAN_FILLER = re.compile(rf"(?i)(?<![\w'])(?:also äh|{'|'.join(x for x in sorted(HESITATIONS, key=len, reverse=True) if x not in ('um', 'er', 'em', 'oh'))})(?![\w'])[,.…]*")
_CLOCK = r"(?:\d{1,2}:)?\d{1,2}:\d\d"
_RANGE = re.compile(r"\[\s*(\d+(?:\.\d+)?)\s*-\s*\d+(?:\.\d+)?\s*s?\s*\]\s*(.*)")
_ARROW = re.compile(r"((?:\d+:)?\d+:\d\d[.,]\d{1,3})\s*-->")
_DASH = re.compile(rf"\[?({_CLOCK})\]?\s+[-–]\s+(.*)")
_FRONT = re.compile(r"\[?(\d{1,2}:\d\d:\d\d)\]?(?:\s+(.*))?$")
_AFTER = re.compile(rf"(.{{1,60}}?)\s*\(({_CLOCK})\)\s*:\s*(.*)")
_ALONE = re.compile(r"(.{1,60}?)\s+(\d{1,2}:\d\d:\d\d)$")
_VOICE = re.compile(r"<v(?:\.[\w.]+)?\s+([^>]+)>\s*(.*)", re.S)
_LABEL = re.compile(r"(?:>>\s*)?([^\s:<>\[\]♪][^:<>\[\]♪]{0,60}?)\s*(?::|\s[-–])(?:\s+(.*)|$)")
_HEADER = re.compile(r"WEBVTT|(?i:kind:|language:)|TRANSCRIPT\b|(?i:transcript|transcripción|transcription|transkript)$|-+ *(?i:recording)")
_NUMBERED = re.compile(r"(?:speaker|spkr?|s|sprecher|locuteur|orador|hablante)[\s_#-]*0*(\d+)$")
_SUFFIX = re.compile(r"\s*\([^()]*\)\s*$")
_QUICK = re.compile(r"\d:\d\d|\d\s*s\]|:(?:\s|$)|\s[-–]\s")
_WORD = re.compile(r"\w")


@dataclass
class Utterance:
    time: float
    label: str | None
    text: str


@dataclass
class Name:
    """A label's normal form. kind: number, role, full, or part (of a name)."""

    kind: str
    key: str
    first: str = ""
    last: str = ""
    start: str = ""


def seconds(clock: str) -> float:
    out = 0.0
    for part in clock.replace(",", ".").split(":"):
        out = out * 60 + float(part)
    return out


def normal(label: str) -> Name | None:
    """The normal form of a label, or null if it can't be one."""
    raw = " ".join(label.split()).lstrip("> ").strip()
    while (short := _SUFFIX.sub("", raw)) != raw:
        raw = short
    low = raw.casefold().strip(" .,")
    if not low or len(low) > 48:
        return None
    if m := _NUMBERED.match(low):
        return Name("number", f"#{int(m[1])}")
    if low in ROLES:
        return Name("role", low)
    if "," in low:
        last, _, first = low.partition(",")
        low = f"{first.strip()} {last.strip()}"
    parts = low.replace(".", ". ").split()
    titled = False
    while parts and parts[0].rstrip(".") in TITLES and len(parts) > 1 and (parts[0].endswith(".") or len(parts[0]) > 1):
        if len(parts[0].rstrip(".")) == 1:
            break
        titled, parts = True, parts[1:]
    words = [p.rstrip(".") for p in parts]
    if not 1 <= len(words) <= 3 or not all(w.replace("-", "").replace("'", "").replace("’", "").isalpha() for w in words):
        return None
    if len(words) == 1:
        bare = raw.replace(".", "")
        if len(bare) == 2 and bare.isupper():
            return Name("part", f"={low}", start=words[0])
        return Name("part", words[0], last=words[0]) if titled else Name("part", words[0], first=words[0], last=words[0])
    if len(words[0]) == 1:
        return Name("part", f"{words[0]}. {words[-1]}", start=words[0], last=words[-1])
    if titled and len(words) == 1:
        return Name("part", words[0], last=words[0])
    return Name("full", " ".join(words), first=words[0], last=words[-1])


def fits(part: Name, full: Name) -> bool:
    """May this part of a name stand for that full name?"""
    if part.key.startswith("="):
        return full.first[:1] + full.last[:1] == part.start
    if part.start:
        return full.last == part.last and full.first.startswith(part.start)
    return part.last == full.last or bool(part.first) and part.first == full.first


@lru_cache(65_536)
def phonetic(word: str) -> str:
    """A sound key: the first letter and the consonants after it, with like sounds joined and repeats dropped."""
    alike = str.maketrans("cqgzvwdbyáéíóúäöüàèêëïîôûùñç", "kkksfftpiaeiouaouaeeeiiouunk")
    w = word.translate(alike)
    out = w[:1]
    for c in w[1:]:
        if c not in "aeiouhy" and c != out[-1]:
            out += c
    return out


def edits(a: str, b: str) -> int:
    """The edit distance of two words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def distance(part: Name, full: Name) -> float:
    """0 if part fits full as written; the share of letters that differ if it sounds like it; else infinite.

    A sound key of one letter (Leo, Lea) doesn't tell names apart and joins nothing.
    """
    if fits(part, full):
        return 0.0
    if part.key.startswith("=") or part.start and not full.first.startswith(part.start):
        return math.inf
    words = [(part.last, full.last)] + ([(part.first, full.first)] if part.first and not part.start else [])
    return min((edits(a, b) / max(len(a), len(b)) for a, b in words if len(phonetic(a)) > 1 and phonetic(a) == phonetic(b)), default=math.inf)


def assign(cost: np.ndarray) -> list[int]:
    """Each row's column in the assignment of least cost (Hungarian method). There are at least as many columns as rows."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of, way = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while row_of[j]:
            used[j] = True
            reduced = cost[row_of[j] - 1] - u[row_of[j]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j
            after = int(np.argmin(np.where(used, np.inf, least)))
            step = least[after]
            u[row_of[used]] += step
            v[used] -= step
            least[~used] -= step
            j = after
        while j:
            row_of[j] = row_of[way[j]]
            j = int(way[j])
    out = [0] * n
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def _split_label(text: str, strict: bool) -> tuple[str | None, str]:
    """The label in front of an utterance, if there is one, and the rest."""
    if m := _VOICE.match(text):
        return m[1], m[2]
    m = _LABEL.match(text)
    if m and (n := normal(m[1])) and (not strict or n.kind != "part" or n.start or len(m[1].split()) > 1):
        return m[1], m[2] or ""
    return None, text.removeprefix(">>").lstrip()


def parse(text: str | None) -> list[Utterance]:
    """The utterances of a transcript as written, or nothing if the text is none."""
    if not text or not _QUICK.search(text):
        return []
    lines = [" ".join(x.split()) for x in _CONTROL.sub("", text.replace("\r", "\n")).split("\n")]
    for form in (_ranges, _arrows, _clocks, _after, _alone):
        if out := form(lines):
            return out
    return _labelled(lines)


def _gather(lines: list[str], cue) -> list[Utterance]:
    """Utterances of lines that start a cue, with the lines after them. cue gives (time, text) or null."""
    out: list[Utterance] = []
    for line in lines:
        if found := cue(line):
            label, rest = _split_label(found[1], False)
            out.append(Utterance(found[0], label, rest))
        elif line and out:
            out[-1].text += " " + line
    return out


def _ranges(lines: list[str]) -> list[Utterance]:
    if not any(x.startswith("[") and _RANGE.match(x) for x in lines):
        return []
    return _gather(lines, lambda x: (float(m[1]), m[2]) if (m := _RANGE.match(x)) else None)


def _arrows(lines: list[str]) -> list[Utterance]:
    if not any("-->" in x for x in lines):
        return []
    out: list[Utterance] = []
    fresh, last = False, ""
    for k, line in enumerate(lines):
        if m := _ARROW.match(line):
            out.append(Utterance(seconds(m[1]), None, ""))
            fresh = True
        elif line and out:
            after = next((x for x in lines[k + 1 :] if x), "")
            if line.isdigit() and "-->" in after and not last:
                continue
            if fresh:
                out[-1].label, out[-1].text = _split_label(line, False)
                fresh = False
            elif (m := _VOICE.match(line)) is not None:
                out.append(Utterance(out[-1].time, m[1], m[2]))
            else:
                out[-1].text += " " + line
        last = line
    return out


def _clocks(lines: list[str]) -> list[Utterance]:
    dashed = any(_DASH.match(x) for x in lines)
    if not dashed and not any(x[:1].isdigit() and (m := _FRONT.match(x)) and m[2] for x in lines):
        return []
    if dashed:
        return _gather(lines, lambda x: (seconds(m[1]), m[2]) if (m := _DASH.match(x)) else None)
    return _gather(lines, lambda x: (seconds(m[1]), m[2] or "") if (m := _FRONT.match(x)) else None)


def _after(lines: list[str]) -> list[Utterance]:
    found = [m if ")" in x and (m := _AFTER.match(x)) and normal(m[1]) else None for x in lines]
    if not any(found):
        return []
    out: list[Utterance] = []
    for line, m in zip(lines, found, strict=True):
        if m:
            out.append(Utterance(seconds(m[2]), m[1], m[3]))
        elif (bare := re.match(rf"\(({_CLOCK})\)\s*:?\s*(.*)", line)) is not None:
            out.append(Utterance(seconds(bare[1]), None, bare[2]))
        elif line and out:
            out[-1].text += " " + line
    return out


def _alone(lines: list[str]) -> list[Utterance]:
    out: list[Utterance] = []
    for line in lines:
        if (m := _ALONE.match(line)) and normal(m[1]):
            out.append(Utterance(seconds(m[2]), m[1], ""))
        elif re.fullmatch(r"\d{1,2}:\d\d:\d\d", line):
            out.append(Utterance(seconds(line), None, ""))
        elif line and out:
            out[-1].text = f"{out[-1].text} {line}".strip()
    return out


def _labelled(lines: list[str]) -> list[Utterance]:
    """Labelled lines without times, told from glossaries, lists and titles by what the labels and the texts are like.

    The first line that is no header has a label; some label is a number, a role or a name (of two words, with a title or
    an initial) before something said; and there are sounds of speech, a header, several sure labels or a label that
    comes again. Glossaries have other single words as labels, each once.
    """
    some = [x for x in lines if x]
    while some and _HEADER.match(some[0]):
        some = some[1:]
    headed = len(some) < sum(map(bool, lines))
    if not some or not (m := _LABEL.match(some[0])) or not (n := normal(m[1])) or n.kind == "full" and len(n.key.split()) > 2:
        return []
    split = [_split_label(x, False) if ":" in x or " - " in x or " – " in x else (None, x) for x in some]
    names = [normal(a) if a and (len(t.split()) >= 5 or t and not clean(t)) else None for a, t in split]
    strict = [n for n, (a, _) in zip(names, split, strict=True) if n and (n.kind in ("number", "role") or n.start or n.kind == "full" and len(n.key.split()) == 2 or n.kind == "part" and not n.first)]
    sounds = len(_SOUND.findall("\n".join(t for _, t in split)))
    if not strict and sounds < 2:
        return []
    sure = sum(n.kind in ("number", "role") for n in strict)
    again = len(strict) - len({n.key for n in strict})
    single = sum(n is not None for n in names) - len(strict)
    if not (headed or sounds or single <= len(strict) and (sure >= 2 or again and len(strict) >= 0.5 * len(some))):
        return []
    fulls = [n for n in strict if n.kind == "full"]
    out: list[Utterance] = []
    for x, n, (label, t) in zip(some, names, split, strict=True):
        if label is not None and (n or (n := normal(label)) and (n.kind != "full" or any(f.key == n.key for f in fulls))):
            out.append(Utterance(0.0, label, t))
        else:
            out.append(Utterance(0.0, None, x))
    return out


def clean(text: str) -> str:
    """The spoken words only."""
    bare = _NOTE.sub(" ", text)
    bare = (_GERMAN_FILLER if len(_GERMAN.findall(bare)) >= 2 else _FILLER).sub(" ", bare)
    bare = re.sub(r"\s+([,.;:?!…])", r"\1", " ".join(bare.split()))
    return bare.strip(" ,") if _WORD.search(bare) else ""


@dataclass
class Speakers:
    """Canonical speakers of one transcript."""

    names: dict[str, Name] = field(default_factory=dict)
    canon: dict[str, str] = field(default_factory=dict)


def unresolved(labels: list[str]) -> list[Name]:
    """Parts of names that no full name of the same transcript explains."""
    names = [n for x in labels if (n := normal(x))]
    fulls = [n for n in names if n.kind == "full"]
    return [n for n in names if n.kind == "part" and not any(fits(n, f) for f in fulls)]


def resolve(labels: list[str], roster: list[str]) -> dict[str, str]:
    """Each label's speaker. roster: full names of the file's other transcripts."""
    names = {x: normal(x) or Name("role", x.casefold()) for x in labels}
    fulls = {n.key: n for n in names.values() if n.kind == "full"}
    parts = {n.key: n for n in names.values() if n.kind == "part"}
    known = {n.key: n for r in roster if (n := normal(r)) and n.kind == "full"}
    out: dict[str, str] = {}
    open_parts: list[tuple[str, dict[str, float]]] = []
    for key, n in parts.items():
        found = {f: 0.0 for f, full in fulls.items() if fits(n, full)} or {f: 0.0 for f, full in known.items() if fits(n, full)}
        for some in (fulls, known):  # as written before like-sounding
            found = found or {f: d for f, full in some.items() if (d := distance(n, full)) < math.inf}
        if len(found) == 1:
            out[key] = next(iter(found))
        elif found:
            open_parts.append((key, found))
    if open_parts:
        out |= _chosen(open_parts, set(out.values()))
    left = [n for key, n in parts.items() if key not in out]
    for n in sorted(left, key=lambda n: (not n.start, n.key)):  # parts among themselves: one surname, one speaker
        like = next((out[m.key] for m in left if m.key in out and m.last and m.last == n.last), None)
        out[n.key] = like or n.key
    return {x: out.get(n.key, n.key) if n.kind == "part" else n.key for x, n in names.items()}


def _chosen(open_parts: list[tuple[str, dict[str, float]]], taken: set[str]) -> dict[str, str]:
    """Each ambiguous label's name: the assignment of least cost, a name that no other label has taken before one that has.

    Each label has a column of its own besides the names': the name of its least cost, shared with other labels.
    """
    pool = sorted({f for _, found in open_parts for f in found})
    place = {f: j for j, f in enumerate(pool)}
    n, m = len(open_parts), len(pool)
    never = 8.0 * (n + 1)
    cost = np.full((n, m + n), never)
    for i, (_, found) in enumerate(open_parts):
        tie = 1e-3 * (n - i) / (n * n * m)  # equal costs: the first label has the first name
        for f, d in found.items():
            cost[i, place[f]] = d + TAKEN * (f in taken) + tie * place[f]
        cost[i, m + i] = min(d + TAKEN + tie * place[f] for f, d in found.items()) + tie * m
    least = lambda found: min(found, key=lambda f: (found[f], f))
    return {key: pool[j] if j < m else least(found) for j, (key, found) in zip(assign(cost), open_parts, strict=True)}


def turns(utterances: list[Utterance], roster: list[str]) -> list[tuple[int, int, str | None, float, str]]:
    """(turn_no, speaker_no, speaker, start, text) of a transcript."""
    speakers = resolve(sorted({u.label for u in utterances if u.label}), roster)
    last: str | None = None
    out: list[tuple[str | None, float, list[str]]] = []
    for u in sorted(utterances, key=lambda u: u.time):
        last = speakers[u.label] if u.label else last
        if words := clean(u.text):
            if out and out[-1][0] == last:
                out[-1][2].append(words)
            else:
                out.append((last, u.time, [words]))
    numbers: dict[str | None, int] = {}
    return [(k, numbers.setdefault(who, len(numbers)), who, at, " ".join(texts)) for k, (who, at, texts) in enumerate(out)]


_PARSED = "id string, file string, utterances array<struct<time:double,label:string,text:string>>"


def parsed(rows: DataFrame) -> DataFrame:
    """(id, file, utterances) of the transcripts among rows (id, file, text)."""
    kind = pa.list_(pa.struct([("time", pa.float64()), ("label", pa.string()), ("text", pa.string())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, [vars(u) for u in us]) for k, t in enumerate(batch.column("text").to_pylist()) if (us := parse(t))]
            if found:
                at = pa.array([k for k, _ in found])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("file").take(at), pa.array([u for _, u in found], kind)], ["id", "file", "utterances"])

    return spread(rows.select("id", "file", "text").where(F.col("id").isNotNull() & F.col("text").isNotNull())).mapInArrow(read, _PARSED).dropDuplicates(["id"])


def rosters(found: DataFrame) -> DataFrame:
    """(id, roster): for transcripts with unexplained parts of names, the full names of the file's others that sound alike."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, f, labels in zip(*(batch.column(c).to_pylist() for c in ("id", "file", "labels")), strict=True):
                own = [x for x in labels or [] if x]
                for n in unresolved(own):
                    out += [(i, f, False, None, phonetic(w)) for w in {n.first, n.last, n.start} - {""}]
                for n in filter(None, map(normal, own)):
                    if n.kind == "full":
                        out += [(None, f, True, n.key, phonetic(w)) for w in {n.first, n.last, n.first[:1] + n.last[:1]}]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string()), strict=True)], ["id", "file", "is_full", "name", "sound"])

    labels = found.where(F.col("file").isNotNull()).select("id", "file", F.array_distinct(F.col("utterances.label")).alias("labels"))
    sounds = stage(labels.mapInArrow(keys, "id string, file string, is_full boolean, name string, sound string"), "labels")
    asked = sounds.where(~F.col("is_full")).select("id", "file", "sound").distinct()
    known = sounds.where("is_full").select("file", "sound", "name").distinct()
    # one row a sound of a file, so that a file with very many transcripts doesn't multiply rows, and is joined apart
    alike = known.groupBy("file", "sound").agg(F.collect_list("name").alias("names"))
    met = left_join(asked, alike, ["file", "sound"]).where(F.col("names").isNotNull())
    return met.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("roster"))


def speaker_turns(rows: DataFrame) -> DataFrame:
    """(id, turn_no, speaker_no, speaker, start, text) of every transcript. rows: (id, file, text)."""
    found = stage(parsed(rows), "transcripts")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string())
        for batch in batches:
            out: list[tuple] = []
            for i, us, roster in zip(*(batch.column(c).to_pylist() for c in ("id", "utterances", "roster")), strict=True):
                out += [(i, *t) for t in turns([Utterance(**u) for u in us], roster or [])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "turn_no", "speaker_no", "speaker", "start", "text"])

    both = found.join(rosters(found), "id", "left").select("id", "utterances", "roster")
    return both.mapInArrow(fold, "id string, turn_no int, speaker_no int, speaker string, start double, text string")
