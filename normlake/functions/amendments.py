"""Editorial notes of a consolidated text: what an instrument did to a unit of it, when, and which clauses it holds for."""

from __future__ import annotations

import re
from datetime import date
from typing import NamedTuple

from .segmentation import NOTE, blank_notes, split_clauses

# What a note says was done, and to which unit.
ACTIONS = {"Ek": "ADDED", "Değişik": "CHANGED", "Mülga": "REPEALED", "İptal": "ANNULLED", "Yeniden düzenleme": "REENACTED"}
UNITS = {"cümle": "SENTENCE", "fıkra": "FIKRA", "bent": "BENT", "madde": "ARTICLE", "ibare": "PHRASE", "ifade": "PHRASE", "başlık": "HEADING", "paragraf": "FIKRA"}
_HEAD = re.compile(rf"\(?\s*({'|'.join(ACTIONS)})\s*([a-zçğıöşü ]{{0,30}}?)\s*:\s*(?:R\.?\s?G\.?\s*[-:.]?\s*)?([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}})\s*[-–]?\s*(.*)", re.S)

#: A paragraph or item mark, perhaps with other notes around it, is all that may stand before a note that leads its clause.
_MARK_ONLY = re.compile(r"\s*(?:\([0-9]{1,2}\)|[a-zçğıöşü]{1,2}\))?\s*", re.ASCII)
_NOTE = re.compile(NOTE.pattern, re.ASCII)


class Note(NamedTuple):
    start: int
    end: int
    action: str
    unit: str
    dated: date
    instrument: str
    on_own_line: bool


def notes_in(text: str | None) -> list[Note]:
    """Every dated note; one bracket may hold several, parted by semicolons. A date that does not exist is no note."""
    text, out = text or "", []
    masked = blank_notes(text)
    for bracket in NOTE.finditer(text):
        line = text.rfind("\n", 0, bracket.start()) + 1, (text.find("\n", bracket.end()) + 1 or len(text) + 1) - 1
        alone = not masked[slice(*line)].strip()
        for part in bracket.group().rstrip(")").split(";"):
            said = _HEAD.match(part.strip())
            if not said:
                continue
            action, of, day, month, year, instrument = said.groups()
            try:
                dated = date(int(year), int(month), int(day))
            except ValueError:
                continue
            unit = next((name for word, name in UNITS.items() if word in of), "UNSPECIFIED")
            out.append(Note(bracket.start(), bracket.end(), ACTIONS[action], unit, dated, instrument.strip(" .)"), alone))
    return out


class Held(NamedTuple):
    ref: str
    note_seq: int
    action: str
    unit: str
    dated: date
    instrument: str
    level: str


def clause_notes(text: str | None, label: str | None = "") -> list[Held]:
    """Every note with every clause it holds for.

    A note is placed in the clause it stands in, or in the next one behind it, and spreads by level: to the clause alone
    (OWN), to an item, to the items of a list whose lead-in holds it, to a paragraph, to the article.
    """
    notes = notes_in(text)
    clauses = split_clauses(text, label) if notes else []
    if not clauses:
        return []
    leads = {(c.lead_start, c.lead_end) for c in clauses if c.lead_start is not None}
    ordered = sorted(clauses, key=lambda c: (c.start, c.ref))
    first, out = ordered[0].start, []
    for seq, note in enumerate(notes):
        at = next((c for c in ordered if c.start <= note.start < c.end), None)
        inside = at is not None
        if not inside:
            at = next((c for c in ordered if c.start >= note.end), None)
        lead = min((a for a, b in leads if a <= note.start < b), default=None)
        if note.on_own_line and note.start < first:
            spread, reached = "ARTICLE", clauses
        elif at is None:
            continue
        elif not inside and lead is not None:
            spread, reached = "LIST", [c for c in clauses if c.lead_start == lead]
        else:
            leading = not inside or _MARK_ONLY.fullmatch(_NOTE.sub(" ", text[at.start : note.start]))
            if note.unit in ("SENTENCE", "PHRASE", "HEADING") or not leading or (at.sentence or 1) != 1:
                spread, reached = "OWN", [at]
            elif at.item is not None and note.unit != "FIKRA":
                spread, reached = "ITEM", [c for c in clauses if c.paragraph == at.paragraph and c.item == at.item]
            else:
                spread, reached = "PARAGRAPH", [c for c in clauses if c.paragraph == at.paragraph]
        for c in reached:
            own = spread in ("OWN", "ITEM", "PARAGRAPH") and c.ref == at.ref
            out.append(Held(c.ref, seq, note.action, note.unit, note.dated, note.instrument, "OWN" if own else spread))
    return out
