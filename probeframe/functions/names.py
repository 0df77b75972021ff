"""Names in question texts: which a text has, what became of them in a variant, and the repair.

Small readers of one text or two, on Arrow batches; texts that repeat are read
once (:mod:`memo`).  ``text.proper_nouns`` and the audits are their Columns.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa

from probeframe.functions.memo import Memo

#: Letters of names and words, and capitals among them.
LETTER, CAPITAL = "A-Za-zÀ-ÖØ-öø-ÿ", "A-ZÀ-ÖØ-Þ"
WORD = f"[{LETTER}][{LETTER}'’-]*"
#: Capitalised words that aren't names.
COMMON = (
    "A An After All And At Before By During Each Every For From He Her His How If In It Later On One She The Then They This To What When Where While With"
).split()
NUMBER_WORDS = "One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve Thirteen Fourteen Fifteen Sixteen Seventeen Eighteen Nineteen Twenty".split()
PIECE = re.compile(rf"((?:^|[.!?]\s+)(?=[{CAPITAL}]))?({WORD})", re.ASCII)
WORDS, STARTS = re.compile(WORD), re.compile(f"[{CAPITAL}]")
NO_NAMES = {*COMMON, *NUMBER_WORDS}

FAILURES = pa.list_(pa.struct([("check", pa.string()), ("details", pa.string())]))
AUDITED = pa.struct([("failed", pa.bool_()), ("changed", pa.bool_()), ("mended", pa.string()), ("still", pa.bool_())])


@lru_cache(10_000)
def alone(word: str) -> re.Pattern:
    return re.compile(f"(?<![{LETTER}]){re.escape(word)}(?![{LETTER}])")


def count(text: str, word: str) -> int:
    """How often ``word`` stands in ``text`` as a whole word."""
    return len(alone(word).findall(text)) if word in text else 0


def nouns(text: str) -> list[str]:
    """The names of a text by the rules of ``text.proper_nouns``."""
    pieces = [(m[2], m.start(2) > m.start()) for m in PIECE.finditer(text)]
    seen: list[str] = []
    for i, (raw, opens) in enumerate(pieces):
        word = raw.strip("'’")
        if len(word) < 3 or not STARTS.match(word) or word in NO_NAMES or word in seen:
            continue
        if not (opens or (i == 0 and STARTS.match(text))) or any(count(later, word) for later, _ in pieces[i + 1 :]):
            seen.append(word)
    return seen


def left_suffix(name: str, word: str) -> str | None:
    """The suffix of ``name`` that a broken replacement left on ``word``, as in ``text.suffix_artifact``."""
    n = len(name)
    if n < 4 or len(word) <= n or word.startswith(name):
        return None
    for k in range(-(-n // 2), 1, -1):
        if word.endswith(name[-k:]) and len(word) - k >= 3 and STARTS.match(word):
            return name[-k:]
    return None


def failures(question: str | None, variant: str | None) -> list[tuple[str, str]]:
    """``check, details`` of each name of ``question`` that a replacement broke, left over or made uneven in ``variant``."""
    if question is None or variant is None:
        return []
    names, new, found = nouns(question), nouns(variant), []
    words = list(dict.fromkeys(WORDS.findall(variant)))
    for name in names:
        had, has = count(question, name), count(variant, name)
        broken = [(w, s) for w in words if (s := left_suffix(name, w)) is not None]
        if has >= had and not broken:
            continue
        found += [("SUBSTRING_ARTIFACT", f"{w} ends in {s} of {name}") for w, s in broken]
        if has:
            found.append(("LEFTOVER_NAME", f"{name} x {has}"))
        candidate = next((v for v in new if v not in names and left_suffix(name, v) is None), None)
        if candidate is not None and has + count(variant, candidate) != had:
            found.append(("CONSISTENCY", f"{name} / {candidate}"))
    return found


def mended(question: str | None, variant: str | None) -> str | None:
    """``variant`` with one replacement for each name of ``question``, where artifacts or leftovers show that one was tried."""
    if question is None or variant is None:
        return None
    names, text = nouns(question), variant
    for name in names:
        broken = [w for w in dict.fromkeys(WORDS.findall(text)) if left_suffix(name, w) is not None]
        new = broken[0][: -len(left_suffix(name, broken[0]))] if broken else next((v for v in nouns(text) if v not in names), None)
        if new is None:
            continue
        had, has = count(question, name), count(text, name)
        for w in broken:
            text = alone(w).sub(lambda _: new, text)
        if 0 < has < had:
            text = alone(name).sub(lambda _: new, text)
    return text


def audited(question: str | None, variant: str | None) -> dict:
    """Whether a name of ``question`` fails in ``variant``, whether :func:`mended` changes it and to what, and whether a name fails still."""
    if question is None or variant is None:
        return {"failed": False, "changed": variant is not None, "mended": None, "still": False}
    if not failures(question, variant):  # then nothing is broken or left over that would be replaced
        return {"failed": False, "changed": False, "mended": None, "still": False}
    text = mended(question, variant)
    return {"failed": True, "changed": text != variant, "mended": text if text != variant else None, "still": bool(failures(question, text))}


NOUNS = Memo(lambda texts: pa.array([None if t is None else nouns(t) for t in texts], pa.list_(pa.string())))
FAILED = Memo(lambda pairs: pa.array([failures(*p) for p in pairs], FAILURES))
MENDED = Memo(lambda pairs: pa.array([mended(*p) for p in pairs], pa.string()))
AUDITS = Memo(lambda pairs: pa.array([audited(*p) for p in pairs], AUDITED))
