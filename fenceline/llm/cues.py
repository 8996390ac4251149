"""Subtitle text: cues, their dialogue lines, and text read in a wrong encoding."""

from __future__ import annotations

import codecs
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

#: A line with a start and an end time, in any of the usual notations, with --> or -> between.
TIME_LINE = re.compile(r"^[ \t]*(?:\d+:)?\d+:\d+(?:[.,:]\d+)?[ \t]*-{1,2}>[ \t]*(?:\d+:)?\d+:\d+(?:[.,:]\d+)?[^\n]*$", re.M)

_MARKUP = re.compile(r"<[^<>\n]*>|\{\\[^{}\n]*\}")
_SOUND = re.compile(r"\[[^\[\]\n]*\]|\([^()\n]*\)|\*[^*\n]*\*(?:[ \t]*\*)*|[♪♫#]+[^♪♫#\n]*[♪♫#]+|[♪♫#]+")
_SOUND_SIGNS = re.compile(r"[\[\](*♪♫#]")
_OPEN_SOUND = re.compile(r"^[\s-]*[\[(][ \t]*(?P<sound>[^\[\]()]*)$", re.S)
_ADDRESS = re.compile(r"www\.|https?:|[a-z0-9-]{2,63}\.[a-z]{2,24}(?![a-z.])")
_WORD = re.compile(r"[^\W_]+")
_LETTER = re.compile(r"[^\W\d_]")

#: A line in a colour of its own: often an advert or credits, which the learning of notices starts from.
_COLOURED = re.compile(r"<font\b[^<>\n]*color", re.I)

#: What the text was written in, and what it was read as.
MISREADINGS = (("utf-8", "cp1252"), ("utf-8", "cp1250"), ("utf-8", "cp1251"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "cp1251"))

_ALPHABETS = "äöüßåéèêëàâçîïôûùœæáíóúñãõìòąćęłńśźż" + "".join(map(chr, range(0x430, 0x450))) + "ё"

#: Characters that text in the languages handled has when it was read rightly.
USUAL = frozenset(map(chr, range(128))) | frozenset(_ALPHABETS + _ALPHABETS.upper() + "¿¡«»„“”‚‘’–—…♪♫€﻿   ")
_UNUSUAL = re.compile("[^" + "".join(map(re.escape, sorted(USUAL))) + "]")


def cues_of(text: str) -> list[list[str]]:
    """The lines of each cue, markup and bare numbers removed. Text without any time line has a cue for each line."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "<" in text or "{" in text:
        text = _MARKUP.sub("", text)
    parts = TIME_LINE.split(text)
    parts = parts[1:] if len(parts) > 1 else [x for x in text.split("\n") if not x.lstrip("\ufeff").startswith("WEBVTT")]
    return [[x for x in (line.strip() for line in part.split("\n")) if x and not x.isdigit()] for part in parts]


def spoken(lines: list[str]) -> list[str]:
    """The lines of a cue without sound descriptions and addresses; other notices are told apart later, by their words."""
    text = "\n".join(lines)
    if _SOUND_SIGNS.search(text):
        text = _SOUND.sub(" ", text)
        if opened := _OPEN_SOUND.match(text):  # not closed: a description alone, or one run together with what is said
            words = opened["sound"].split()
            said = next((i for i, w in enumerate(words) if i and w[:1].isupper() and not words[i - 1][:1].isupper()), None)
            if said is None and len(words) > 6:
                said = 0
            text = "" if said is None else " ".join(words[said:])
        lines = [x for x in text.split("\n") if _LETTER.search(x)]
    if "." in text and _ADDRESS.search(text):
        lines = [x for x in lines if not _ADDRESS.search(x)]
    return lines


def words_of(line: str) -> list[str]:
    """Lower-case words, digits inside them kept; numbers are no words."""
    return [w for w in _WORD.findall(line.lower()) if not w.isdigit()]


@dataclass
class Notices:
    """Tells credits and adverts from dialogue by their words: a line is one if the weights of its words sum to more than least."""

    weights: dict[str, float] = field(default_factory=dict)
    least: float = math.inf

    def holds(self, words: list[str]) -> bool:
        get = self.weights.get
        return self.least < math.inf and sum(get(w, 0.0) for w in set(words)) > self.least


def notice_lines(text: str) -> Iterator[tuple[str, bool]]:
    """The lines that could be notices, without markup and sounds, and whether they have an address or a colour."""
    for part in TIME_LINE.split(text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text)[1:]:
        for line in part.split("\n"):
            if not line or line.isdigit():
                continue
            bare = _MARKUP.sub("", line) if "<" in line or "{" in line else line
            sure = "<" in line and _COLOURED.search(line) or ("." in bare or ":" in bare) and _ADDRESS.search(bare)
            yield (_SOUND.sub(" ", bare) if _SOUND_SIGNS.search(bare) else bare).strip(), bool(sure)


def learn_notices(texts: Iterable[str], rounds: int = 4, floor: float = 0.3) -> Notices:
    """Learn the words of notices, in whatever language, from texts.

    To begin with, lines with an address or in a colour of their own are taken for notices and all others for dialogue. Each
    round weighs every word by how much more often it is in a notice than in another line, and adds the lines that these
    weights make more likely to be notices than not, given how many there are. Coloured dialogue among the first does no
    harm as long as most dialogue isn't coloured, as its words then weigh nothing. Without any such line nothing is a notice.
    floor: lines with a word that are supposed on both sides beside those seen, so that rare words weigh little.
    """
    lines: list[tuple[frozenset[str], bool]] = []
    for text in texts:
        for line, sure in notice_lines(text):
            if words := frozenset(words_of(line)):
                lines.append((words, sure))
    marked = [sure for _, sure in lines]
    found = Notices()
    for _ in range(rounds):
        many = sum(marked)
        if not 0 < many < len(lines):
            break
        notices, others = Counter(), Counter()
        for (words, _), mark in zip(lines, marked):
            (notices if mark else others).update(words)
        ratio = many / (len(lines) - many)
        found = Notices({w: math.log((notices[w] + floor) / (others[w] * ratio + floor)) for w in notices | others}, -math.log(ratio))
        marked = [sure or found.holds(words) for words, sure in lines]
    return found


def _lost_bytes(error: UnicodeError) -> tuple[bytes, int]:
    """The bytes of characters that a reading's table lacks: bytes undefined there come through as control characters."""
    assert isinstance(error, UnicodeEncodeError)
    return error.object[error.start : error.end].replace("\ufffd", "\xff").encode("latin-1"), error.end


codecs.register_error("fenceline-lost-bytes", _lost_bytes)


def _readings(text: str, misreadings: Iterable[tuple[str, str]]) -> set[str]:
    """What the text would be if it had been misread so."""
    lost = "\ufffd" in text  # bytes that the wrong reading had no character for
    read: dict[str, bytes | None] = {}
    found = set()
    for written, reading in misreadings:
        try:
            if reading not in read:
                read[reading] = None
                read[reading] = text.encode(reading, "fenceline-lost-bytes")
            if (data := read[reading]) is not None:
                found.add(data.decode(written, "replace" if lost else "strict"))
        except ValueError:
            pass
    return found


def looks_misread(text: str) -> bool:
    return not text.isascii() and _UNUSUAL.search(text) is not None


def repaired(line: str, likelihood: Callable[[str], float]) -> str:
    """The likeliest of the line and its readings in other encodings, applied up to twice."""
    return all_repaired([line], lambda lines: [likelihood(x) for x in lines])[line]


def all_repaired(lines: Iterable[str], likelihoods: Callable[[list[str]], list[float]]) -> dict[str, str]:
    """Each line repaired; the likelihoods of many readings are asked for at once."""
    best = {line: line for line in lines}
    known: dict[str, float] = {}

    def likeliest(readings: dict[str, set[str]]) -> dict[str, tuple[float, str]]:
        new = list({x for some in readings.values() for x in some if x not in known})
        known.update(zip(new, likelihoods(new)))
        return {line: max(((known[x], x) for x in some), default=(-1e300, "")) for line, some in readings.items()}

    left = [line for line in best if not line.isascii()]
    value = {line: v for line, (v, _) in likeliest({line: {line} for line in left}).items()}
    for _ in range(2):
        readings = {line: _readings(best[line], MISREADINGS) - {best[line]} for line in left}
        found = likeliest(readings)
        # a double misreading may get no better before its second step
        stuck = [line for line in left if found[line][0] <= value[line]]
        found |= likeliest({line: {y for x in readings[line] for y in _readings(x, MISREADINGS[:3])} for line in stuck})
        left = [line for line in left if found[line][0] > value[line]]
        for line in left:
            value[line], best[line] = found[line]
    return best
