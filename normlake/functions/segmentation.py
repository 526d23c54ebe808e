"""An article cut where drafting cuts it: numbered paragraphs, lettered items, sentences, each an exact span of its text.

Sentences are found by walking over the signs that matter (stops, brackets, quotation marks): a stop inside a quotation or a
bracket, behind an abbreviation or a figure, or before anything but a new sentence's beginning ends nothing. Paragraphs come
from the kinds of the lines: a line opens a paragraph, an item of its list, goes on with what is open, or closes the list.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

# Letters, editorial notes, line marks and abbreviations of the drafting style.
LOWER, UPPER = "a-zçğıöşüâîû", "A-ZÇĞİÖŞÜÂÎÛ"
NOTE = re.compile(r"\(\s*(?:Ek|Değişik|Mülga|İptal|Yeniden düzenleme|Mükerrer)(?: ibare)?[^()]*(?:\([^()]*\)[^()]*)*\)")
ABBREVIATIONS = ("md", "No", "no", "vb", "vs", "bkz", "Dr", "Prof", "sayılı", "Sk", "Cad", "Tic", "Ltd", "Şti", "A.Ş", "T.C", "Art", "art", "Nos")
CLOSERS = {"“": "”", '"': '"', "‘": "’"}
CLOSING_LENGTH = 120
_SIGNS = re.compile(r"[“”\"‘’().!?]")
_BEGINNING = re.compile(rf"\s+(?:[{UPPER}“\"‘(]|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}})")
_STOP = re.compile(rf"[.!?](?={_BEGINNING.pattern})")
_SHORT = re.compile(rf"(?:\b(?:{'|'.join(re.escape(a) for a in ABBREVIATIONS)})|\b[{UPPER}]|[0-9])$")
#: Signs before a stop that decide whether something short stands there: the longest abbreviation and a line's end.
SHORT_LENGTH = max(map(len, ABBREVIATIONS)) + 1
_MARK = re.compile(r"\((?P<PARAGRAPH_NUMBER>[0-9]{1,2})\)|(?P<ITEM>[a-zçğıöşü]{1,2})\)\s|(?P<SUB_ITEM>[0-9]{1,2})\)\s|[-–—]\s*\S(?P<DASH>)")
_MARK_ONLY, MARK_LENGTH = re.compile(r"\(?[0-9]{1,2}\)|[a-zçğıöşü]{1,2}\)"), 4
_LOWER_FIRST = re.compile(f"[{LOWER}]")


class Span(NamedTuple):
    start: int
    end: int


def blank_notes(text: str) -> str:
    """Editorial notes replaced by blanks, so that places stay."""
    return NOTE.sub(lambda m: " " * len(m.group()), text) if "(" in text else text


def _trimmed(text: str, start: int, end: int) -> Span:
    if start < end and not text[start].isspace() and not text[end - 1].isspace():
        return Span(start, end)
    body = text[start:end]
    return Span(start + len(body) - len(body.lstrip()), start + len(body.rstrip()))


def sentence_spans(text: str) -> list[Span]:
    """The sentences of a text, without the blanks between them; what holds nothing but notes is none."""
    masked, cuts, since = blank_notes(text), [], 0
    depth, closer = 0, None
    # signs matter only before a stop that something new begins behind
    stops = {m.end() for m in _STOP.finditer(masked)}
    if not stops:
        return [_trimmed(text, 0, len(text))] if masked and not masked.isspace() else []
    for sign in _SIGNS.finditer(masked, 0, max(stops)):
        at, c = sign.start(), sign.group()
        if closer:
            closer = None if c == closer else closer
        elif c in CLOSERS and (c != '"' or '"' in masked[at + 1 :]):
            closer = CLOSERS[c]
        elif c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        elif c in ".!?" and not depth and at + 1 in stops and not _SHORT.search(masked, max(since, at - SHORT_LENGTH), at):
            cuts.append(at + 1)
            since = at + 1
    spans = [_trimmed(text, a, b) for a, b in zip([0, *cuts], [*cuts, len(text)])]
    return [s for s in spans if s.start < s.end and not masked[s.start : s.end].isspace()]


def line_kind(line: str) -> tuple[str, str]:
    """What a line is (PARAGRAPH_NUMBER, ITEM, SUB_ITEM, DASH, CLOSING, TEXT, or NOTE for nothing to read), and its mark."""
    bare = blank_notes(line).strip()
    if not bare or (len(bare) <= MARK_LENGTH and _MARK_ONLY.fullmatch(bare)):
        return "NOTE", ""
    mark = _MARK.match(bare)
    if mark:
        return mark.lastgroup, mark.group(mark.lastgroup)
    short = len(bare) <= CLOSING_LENGTH and ":" not in bare and _LOWER_FIRST.match(bare)
    return ("CLOSING" if short else "TEXT"), ""


@dataclass
class Item:
    mark: str
    span: Span

    def grow(self, line: Span) -> None:
        self.span = Span(self.span.start, line.end)


@dataclass
class Paragraph:
    number: int
    lead: Span
    items: list[Item] = field(default_factory=list)
    closing: Span | None = None

    def go_on(self, line: Span) -> None:
        """The line belongs to the last item, or to the lead-in where no list is open."""
        if self.items:
            self.items[-1].grow(line)
        else:
            self.lead = Span(self.lead.start, line.end)

    def open_item(self, mark: str, line: Span) -> None:
        if self.closing:  # what looked like the list's end was the end of the item before
            self.items[-1].grow(self.closing)
            self.closing = None
        self.items.append(Item(mark, line))

    def close(self, line: Span) -> None:
        self.closing = Span(self.closing.start if self.closing else line.start, line.end)


def paragraphs(text: str) -> list[Paragraph]:
    """The paragraphs of an article, by the kinds of its lines. Without numbers each line of text is a paragraph."""
    at, lines = 0, []
    for body in text.split("\n"):
        kind, mark = line_kind(body)
        if kind != "NOTE":
            lines.append((kind, mark, _trimmed(text, at, at + len(body))))
        at += len(body) + 1
    numbered, out, before = any(k == "PARAGRAPH_NUMBER" for k, *_ in lines), [], None
    for kind, mark, line in lines:
        if not out or kind == "PARAGRAPH_NUMBER" or (kind == "TEXT" and not numbered):
            out.append(Paragraph(int(mark) if kind == "PARAGRAPH_NUMBER" else len(out) + 1, line))
            before = kind if kind == "PARAGRAPH_NUMBER" else "TEXT"
            continue
        if kind == "ITEM":
            out[-1].open_item(mark, line)
        elif kind == "CLOSING" and out[-1].items and before not in ("SUB_ITEM", "DASH"):
            out[-1].close(line)
        else:
            out[-1].go_on(line)
        before = kind
    return out


class Clause(NamedTuple):
    ref: str
    paragraph: int
    item: str | None
    sentence: int | None
    start: int
    end: int
    text: str
    lead_start: int | None
    lead_end: int | None
    closing_start: int | None
    closing_end: int | None


def _inside(text: str, span: Span) -> list[Span]:
    found = sentence_spans(text[span.start : span.end])
    return found if not span.start else [Span(span.start + a, span.start + b) for a, b in found]


def split_clauses(text: str | None, label: str | None = "") -> list[Clause]:
    """The clauses of an article in order. An item carries the last sentence of its paragraph's lead-in and the first of the line that closes the list.

    References name label, paragraph, item and, where there are several, the sentence; one that occurs again gets a counter.
    """
    out, seen, text, label = [], {}, text or "", label or ""

    def emit(paragraph: Paragraph, item: str | None, sentence: int | None, span: Span, lead: Span | None = None, closing: Span | None = None) -> None:
        ref = f"{label}/f.{paragraph.number}" + (f"/b.{item}" if item else "") + (f"/c.{sentence}" if sentence else "")
        seen[ref] = seen.get(ref, 0) + 1
        out.append(Clause(ref if seen[ref] == 1 else f"{ref}({seen[ref]})", paragraph.number, item, sentence, *span, text[span.start : span.end], *(lead or (None, None)), *(closing or (None, None))))

    for paragraph in paragraphs(text):
        lead = _inside(text, paragraph.lead)
        if not paragraph.items:
            for n, span in enumerate(lead, 1):
                emit(paragraph, None, n if len(lead) > 1 else None, span)
            continue
        for n, span in enumerate(lead[:-1], 1):
            emit(paragraph, None, n, span)
        chapeau = lead[-1] if lead else paragraph.lead
        closing = _inside(text, paragraph.closing) if paragraph.closing else []
        for item in paragraph.items:
            own = _inside(text, item.span)
            for n, span in enumerate(own, 1):
                emit(paragraph, item.mark, n if len(own) > 1 else None, span, chapeau, closing[0] if closing else None)
        for n, span in enumerate(closing[1:], len(lead) + 1):
            emit(paragraph, None, n, span)
    return out


# Words that make a clause a statement of its own; an item without any is read with its lead-in and closing.
PREDICATE = re.compile(r"\b(?:must|shall|may|should|cannot|can|is|are|was|were|has|have|does|do|will|applies|means)\b|(?:[dt][ıiuü]r(?:ler|lar)?|m[ae]z(?:lar|ler)?|[ae]r(?:lar|ler)?|[ıiuü]r(?:lar|ler)?|[ıiuü]l[ıiuü]r)[.;]?$", re.IGNORECASE)
_LEAD_MARKS = re.compile(rf"(?:\s*(?:\([0-9]{{1,2}}\)|[{LOWER}]{{1,2}}\)|[0-9]{{1,2}}\)|{NOTE.pattern}))+\s*")


class Unit(NamedTuple):
    ref: str
    kind: str
    segments: list[Span]
    text: str


def reading_units(text: str | None, label: str | None = "") -> list[Unit]:
    """What is read as one statement: a clause without its mark and notes, or an item with the lead-in and closing that carry it."""
    text, out = text or "", []

    def bare(start: int, end: int) -> Span:
        mark = _LEAD_MARKS.match(text, start, end)
        span = _trimmed(text, mark.end() if mark else start, end)
        if text.endswith(")", *span):
            for note in NOTE.finditer(text, *span):
                if not text[note.end() : span.end].strip():
                    span = _trimmed(text, span.start, note.start())
        return span

    for clause in split_clauses(text, label):
        own = bare(clause.start, clause.end)
        if own.start >= own.end:
            continue
        segments = [own]
        if clause.lead_start is not None and not PREDICATE.search(text[own.start : own.end]):
            segments = [bare(clause.lead_start, clause.lead_end), own]
            if clause.closing_start is not None:
                segments.append(Span(clause.closing_start, clause.closing_end))
        out.append(Unit(clause.ref, "ITEM" if len(segments) > 1 else "SENTENCE", segments, " ".join(text[a:b] for a, b in segments)))
    return out
