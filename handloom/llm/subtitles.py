"""What is spoken in a subtitle file."""

from __future__ import annotations

import re

_DIGIT = r"[\dOoIl]"
_CLOCK = rf"{_DIGIT}{{1,2}}[:;.]{_DIGIT}{{2}}[:;.]{_DIGIT}{{2}}[.,:;]{_DIGIT}{{3}}"
#: A line with start and end time: either separator, arrows cut short or escaped, digits misread as letters.
TIMES = re.compile(rf"^[^\S\n]*﻿?({_CLOCK})\s*-+(?:>|&gt;)\s*({_CLOCK})[^\n]*$", re.M)
NUMBER = re.compile(rf"﻿?{_DIGIT}+")
#: Mark-up and what closes it. An unclosed opening is matched too, up to the line's end, so that a long text full of
#: them is read once and not once per opening.
MARKUP = [(re.compile(r"\{[^}\n]*\}?"), "}"), (re.compile(r"<[^>\n]*>?"), ">"), (re.compile(r"&lt;.*?(?:&gt;|$)", re.M), "&gt;")]
SPEAKER = re.compile(r"^\W*[^\W\d_a-z][^\W\d_a-z]+(?: [^\W\d_a-z]+)?\s?:\s+")
SOUND = re.compile(r"^[-\s]*[\[(*♪#]")
#: Suffixes of public domain names, and those reserved for examples.
SUFFIXES = "com org net info biz tv io eu example invalid test"
#: Adverts and credits: an address, or a user's handle (letters and digits in one word) as the last word.
ADDRESS = re.compile(rf"https?://|\bwww\.\w|\w\.(?:{SUFFIXES.replace(' ', '|')})\b", re.I)
HANDLE = re.compile(r"(?=\w*\d)(?=\w*[^\W\d_])\w{3,}")
_JOINED = re.compile(r"\.\w|://")
WORD = re.compile(r"[^\W\d_]{3,}")


def cues(text: str) -> list[str]:
    """Texts of the cues, a cue written again with the same times left out. Cue numbers are not trusted."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ")
    found, out, seen = list(TIMES.finditer(text)), [], set()
    for k, m in enumerate(found):
        last = k + 1 == len(found)
        lines = [x for x in (line.strip() for line in text[m.end() : len(text) if last else found[k + 1].start()].split("\n")) if x]
        if lines and not last and NUMBER.fullmatch(lines[-1]):
            lines.pop()
        if m.groups() not in seen:
            seen.add(m.groups())
            out.append(" ".join(lines))
    return out


def plain(cue: str) -> str:
    """``cue`` with its mark-up replaced by blanks; what is opened and never closed stays."""
    for pattern, end in MARKUP:
        cue = pattern.sub(lambda m, end=end: " " if m[0].endswith(end) else m[0], cue)
    return cue


def is_advert(cue: str) -> bool:
    """By its last word or an address; what every cue goes through is a plain test."""
    last = cue[-64:].rsplit(None, 1)[-1]
    if not last.isalpha() and HANDLE.fullmatch(last):
        return True
    return bool(_JOINED.search(cue)) and bool(ADDRESS.search(cue))


def spoken(cue: str) -> str | None:
    """The dialogue of a cue without mark-up and speaker; None for sound descriptions, adverts and empty cues."""
    cue = plain(cue).strip()
    if not cue or SOUND.match(cue) or is_advert(cue):
        return None
    parts = cue.split()
    if len(parts) > 1 and parts[0] == parts[-1] and not any(c.isascii() and c.isalnum() for c in parts[0]):
        return None  # a note sign in a wrong encoding on either side
    return SPEAKER.sub("", cue)


def words(dialogue: str) -> list[str]:
    """The distinct words of three letters and more, in order of the alphabet."""
    return sorted(set(WORD.findall(dialogue.lower())))


def spoken_words(text: str) -> list[list[str]]:
    return [words(s) for s in map(spoken, cues(text)) if s is not None]
