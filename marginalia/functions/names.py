"""People's names and titles as plain normalised strings (pure Python, used inside Arrow batches)."""

from __future__ import annotations

import re
import unicodedata

from marginalia.operators.packed import PARTICLES

_MARKS = re.compile(r"[̀-ͯ]")
_OTHER = re.compile(r"[^a-z0-9]+")
_SPECIAL = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i", "&": " and "})
_PARTICLES = frozenset(PARTICLES)
_COLLAB = re.compile(r"\b(?:collaborations?|colaboration|coll|collab|team|consortium)\b\.?")


def plain(text: str | None) -> str:
    """Lower case, without accents, words of ASCII letters and digits separated by single blanks."""
    t = unicodedata.normalize("NFKD", (text or "").lower().translate(_SPECIAL))
    return _OTHER.sub(" ", _MARKS.sub("", t)).strip()


def tokens(name: str | None) -> list[str]:
    """Words of a name without initials, particles and words that mark collaborations."""
    t = _COLLAB.sub(" ", plain(name))
    return [w for w in t.split() if len(w) > 2 and w not in _PARTICLES and w != "the"]
