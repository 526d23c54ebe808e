"""Duties as a text states them: every marker of duty, and for each who must do what, when, under what conditions.

A marker is found word by word. English ones are phrases before the act ("must not", "is required to"); Turkish ones close
the sentence, as words of their own ("zorundadır") or as the ending of the verb ("bildirilir", "veremez"). A binding marker
must be accounted for; a soft one may state a duty and is left out where its sentence says that it does not. Sentences that
hand the matter to a by-law or an authority state no duty.

A text in which a binding marker cannot be read with certainty is INSUFFICIENT_EVIDENCE as a whole: nothing is guessed.
"""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

from .numerals import read_quantities
from .segmentation import blank_notes
from .vocabulary import LETTER

# English markers, longest first; what each says; softer ones.
EN_MARKERS = {"must not": "MUST_NOT", "shall not": "MUST_NOT", "should not": "SHOULD_NOT", "may not": "MAY_NOT", "must": "MUST", "shall": "MUST", "should": "SHOULD", "may": "MAY",
              "is required to": "MUST", "are required to": "MUST", "is prohibited from": "MUST_NOT", "are prohibited from": "MUST_NOT"}
EN_SOFT = {"need to": "MUST", "needs to": "MUST", "has to": "MUST", "have to": "MUST", "is obliged to": "MUST", "are obliged to": "MUST"}
WILL_SUBJECTS = ("firm", "firms", "lender", "lenders")
# Turkish markers that are words of their own, verbs of a duty in the aorist, and what takes the force out of them.
TR_MUST = ("zorundadır", "zorundadir", "zorundadırlar", "zorundadirlar", "zorunludur", "yükümlüdür", "yukumludur", "yükümlüdürler", "yukumludurler", "mecburdur", "mecburidir", "gerekir", "gereklidir",
           "şarttır", "şarttir")
TR_SOFT_MUST = ("gerekmektedir", "mükelleftir", "mükelleftirler", "mükellefdir", "esastır", "esastir")
TR_BEFORE_OLUP = ("zorunlu", "zorunda", "yükümlü", "mecbur")
TR_MUST_NOT = ("yasaktır", "yasaktir")
TR_AORISTS = ("alır", "verir", "yapar", "sağlar", "saklar", "tutar", "uygular", "izler", "doğrular", "ister", "sunar", "öder", "iletir", "gönderir", "gösterir", "tamamlar")
NO_DUTY_BEFORE_AORIST, NO_DUTY_BEFORE_PASSIVE, NO_BAN_BEFORE = ("ifade", "kabul", "izin"), ("kabul", "ifade"), ("teşkil", "arz", "halel")
NO_BANS = ("kaldırmaz", "etkilemez", "gerektirmez", "gerekmez", "değişmez", "uygulanmaz")
PERMISSION_CONDITIONS = ("şartıyla", "kaydıyla", "koşuluyla", "halinde", "hâlinde", "hallerinde", "hâllerinde", "takdirde", "durumunda")
PLAIN_CONDITIONS = PERMISSION_CONDITIONS[3:]
LIMIT_BEFORE = ("durumunda", "durumlarında", "halinde", "hâlinde", "hallerinde", "hâllerinde", "takdirde")
ONLY = ("yalnızca", "yalnız", "sadece", "ancak")
PROVISION_NAMES = ("hüküm", "hükm", "madde", "fıkra", "bent", "bend", "kanun", "yönetmeli", "tebliğ", "kararname", "bölüm")
# How a delegating sentence ends, and the instruments and authorities it names.
DELEGATION_ENDS = ("belirlenir", "belirlenebilir", "düzenlenir", "tespit edilir", "gösterilir", "çıkarılır", "tayin edilir", "saptanır", "tespit olunur", "belirlemeye yetkilidir", "yetkilidir", "yetkili olup",
                   "yetkili kılınmıştır", "yetkiye sahiptir")
AUTHORISED = ("yetkilidir", "yetkili olup", "yetkili kılınmıştır", "yetkiye sahiptir")
INSTRUMENTS, INSTRUMENT_CASES = ("yönetmelik", "tebliğ", "genelge", "karar", "esaslar", "usul", "usûl"), ("le", "la", "te", "ta", "de", "da", "lerle", "lerde", "larla", "larda")
AUTHORITIES, BY_AUTHORITY = ("Cumhurbaşkan", "Bakanl", "Kurul", "Başkanl", "Kurum", "Müdürlü", "Bakanlar Kurulu", "Merkez Bankas", "Hazine"), (
    "Cumhurbaşkanı", "Bakanlık", "Bakan", "Kurul", "Başkanlık", "Kurum", "Bakanlar Kurulu", "Merkez Bankası", "Hazine")
# Qualifiers. English ones open the clause they govern, Turkish ones close it.
EN_CONDITION, EN_EXCEPTION = r"\b(?:if|where|when|provided\s+that|subject\s+to)\b", r"\b(?:unless|except(?:\s+where)?|other\s+than|save\s+where|without|does\s+not\s+apply|do\s+not\s+apply)\b"
TR_CONDITION = "halinde hâlinde hallerinde hâllerinde takdirde durumunda durumlarında kaydıyla şartıyla koşuluyla sürece".split()
TR_EXCEPTION = "hariç hariçtir dışında dışındadır istisna istisnadır istisnasıdır saklıdır uygulanmaz".split()
AUTHOR, LEAST_POWER = r"(?i)\b(?:we|i|our|this publication|this policy statement)\b", r"(?i)\s*(?:[0-9]|be\b|have\b|result\b|cause\b)"
SUBJECT_MAX, COMMA_MAX = 160, 80

_WORD = re.compile(f"[{LETTER}]+")
_EN_SENTENCE, _TR_SENTENCE = re.compile(r"(?<=[.;!?])\s+(?=[A-Z])"), re.compile(r"(?<=[.;!?])\s+(?=[A-ZÇĞİÖŞÜ(])")
_TR_STOP = re.compile(r"[.;!?]\s+(?=[A-ZÇĞİÖŞÜ(])")
_LABEL = re.compile(r"^\s*[0-9]+[A-Z]?(?:\.[0-9]+[A-Z]*)+\s+(?:[RG]\s+)?")
_COORDINATED = re.compile(r"\b(?:and|or)\s*$", re.I)
_EN_PHRASES = re.compile(r"(?i)(?=[mnshiaw])(?:\b(?:" + "|".join(p.replace(" ", r"\s+") for p in sorted({**EN_MARKERS, **EN_SOFT}, key=len, reverse=True)) + r")\b|(?=w)(?:(?<=" + r"\s)|(?<=".join(WILL_SUBJECTS) + r"\s))will(?:\s+not)?\b)")
#: How a word must end that can be a Turkish marker, and the markers that end otherwise; other words are not looked at.
_MARKER_ENDS, _MARKER_WORDS = frozenset(("ır", "ir", "ur", "ür", "az", "ez")), frozenset((*TR_BEFORE_OLUP, *PERMISSION_CONDITIONS, *TR_AORISTS))
_LONGER_ENDS = frozenset(("lar", "ler", "der"))
_WORD_END = re.compile(f"[{''.join(sorted({e[-1] for e in (*_MARKER_ENDS, *_LONGER_ENDS, *_MARKER_WORDS)}))}](?![{LETTER}])")
_LAST_LETTERS = _LONGER_ENDS.union(w[-3:] for w in _MARKER_WORDS)
_BINDING_WORDS = frozenset(TR_MUST + TR_MUST_NOT)
_DELEGATING = re.compile(f"(?<![{LETTER}])(?:{'|'.join(DELEGATION_ENDS)})\\s*$")
_BY_INSTRUMENT = re.compile(f"(?:{'|'.join(INSTRUMENTS)})(?:{'|'.join(INSTRUMENT_CASES)})(?![{LETTER}])")
_NAMED_AUTHORITY = re.compile(f"(?:{'|'.join(AUTHORITIES)})[{LETTER}]*(?:ca|ce|ça|çe)(?![{LETTER}])|(?:{'|'.join(BY_AUTHORITY)}) tarafından")
_CLOSES, _STOP, _CLAUSE_START = re.compile(r"\s*(?:[.;]|$)"), re.compile("[.;]"), re.compile(r"[,;:(]\s*")
_QUALIFIERS = tuple(re.compile(f"(?=[{first}]){p}", re.I) for first, p in (("iwps", EN_CONDITION), ("ueoswd", EN_EXCEPTION)))


class Marker(NamedTuple):
    start: int
    end: int
    word: str
    mode: str
    binding: bool
    turkish: bool
    alone: bool  # a word of its own, which the act stops before


class Duty(NamedTuple):
    subject: str
    modality: str
    action: str
    start: int
    end: int
    conditions: list[str]
    exceptions: list[str]


@cache
def _ending(endings: str, least: int) -> re.Pattern:
    return re.compile(f"(?<=[{LETTER}]{{{least}}})(?:{endings})$")


def _ends(word: str, endings: str, least: int) -> bool:
    """Whether a word of at least ``least`` letters before it has one of the endings (a pattern)."""
    return _ending(endings, least).search(word) is not None


def _turkish_marker(words: list[re.Match], n: int, text: str) -> tuple[str, bool, bool] | None:
    """(mode, binding, alone) of a word, given whether it closes its sentence."""
    word = words[n].group()
    before = words[n - 1].group() if n else ""
    if word in TR_MUST:
        return "MUST", True, True
    if word in TR_MUST_NOT:
        return "MUST_NOT", True, True
    if _ends(word, "mal[ıi]d[ıi]r|melidir", 2):
        return "MUST", True, False
    if _ends(word, "[aı]maz(?:lar|ler)?|[ei]mez(?:lar|ler)?", 3):
        return "MUST_NOT", True, False
    closes = _CLOSES.match(text, words[n].end()) is not None
    if closes and _ends(word, "[ıiuü]l[ıiuü]r|n[ıiuü]r", 3) and not re.search("b[ıiuü]l[ıiuü]r$|bn[ıiuü]r$", word):
        return "MUST", True, False
    if closes and word != "uygulanmaz" and _ends(word, "[ıiuü]lm[ae]z|nm[ae]z", 3):
        return "MUST_NOT", True, False
    after = words[n + 1].group() if n + 1 < len(words) else ""
    if word in TR_SOFT_MUST or (word in TR_BEFORE_OLUP and after == "olup"):
        return "MUST", False, True
    if word in PERMISSION_CONDITIONS:
        stop = _STOP.search(text, words[n].end())
        rest = text[words[n].end() : stop.start() if stop else len(text)]
        return ("MUST", False, True) if len(rest) <= 600 and re.search(f"(?<![{LETTER}])(?:mümkündür|serbesttir|[{LETTER}]{{2,}}[ae]bilir(?:ler)?)\\s*$", rest) else None
    if not closes:
        return None
    bare = re.sub("(?:lar|ler)$", "", word)
    if before not in NO_DUTY_BEFORE_AORIST and (word in TR_AORISTS or bare in TR_AORISTS or bare.endswith("eder") or _ends(bare, "[dt][ıiuü]r[ıiuü]r", 2) or (bare != word and _ends(bare, "[ıiuü]l[ıiuü]r|n[ıiuü]r", 3))):
        return "MUST", False, False
    if bare in ("edilir", "olunur") and bare == word and before not in NO_DUTY_BEFORE_PASSIVE:
        return "MUST", False, False
    if word in ("edilmez", "olunmaz") or (word == "uygulanmaz" and before in LIMIT_BEFORE):
        return "MUST_NOT", False, False
    if bare not in NO_BANS and before not in NO_BAN_BEFORE and _ends(bare, "m[ae]z", 2):
        return "MUST_NOT", False, False
    return None


def delegations(text: str) -> list[tuple[int, int]]:
    """Sentences that leave the matter to a by-law or an authority and state no duty of their own."""
    out, since = [], 0
    for until in [*(m.start() for m in _TR_SENTENCE.finditer(text)), len(text)]:
        sentence = text[since:until]
        tail = sentence.rstrip(" .;")
        if tail.rstrip().endswith(DELEGATION_ENDS) and _DELEGATING.search(tail) and not any(w in _BINDING_WORDS for w in _WORD.findall(sentence)):
            if _BY_INSTRUMENT.search(sentence) or _NAMED_AUTHORITY.search(sentence) or any(a in tail for a in AUTHORISED):
                out.append((since, until))
        since = until
    return out


def _holds(marker: Marker, text: str, found: list[Marker]) -> bool:
    """Whether a soft marker states a duty in its own sentence."""
    start = max((m.end() for m in _TR_STOP.finditer(text, 0, marker.start)), default=0)
    if marker.word == "uygulanmaz":
        words = [w.group() for w in _WORD.finditer(text, start, marker.start)]
        return not any(w.lower().startswith(PROVISION_NAMES) for w in words)
    if marker.word in PERMISSION_CONDITIONS:
        stop = _STOP.search(text, marker.end)
        if any(m.binding and marker.end <= m.start < (stop.start() if stop else len(text)) for m in found):
            return False
        if marker.word in PLAIN_CONDITIONS:
            clause = max((m.end() for m in _CLAUSE_START.finditer(text, start, marker.start)), default=start)
            return any(w.group() in ONLY for w in _WORD.finditer(text, clause, marker.start))
    return True


def markers(text: str | None) -> list[Marker]:
    """Every marker of duty in a text, in order, net of delegating sentences and of soft ones that state none."""
    text = text or ""
    found = []
    for m in _EN_PHRASES.finditer(text):
        word = re.sub(r"\s+", " ", m.group()).lower()
        mode = EN_MARKERS.get(word) or EN_SOFT.get(word) or ("MUST_NOT" if word.endswith("not") else "MUST")
        found.append(Marker(m.start(), m.end(), word, mode, word in EN_MARKERS, False, True))
    ends = [m.end() for m in _WORD_END.finditer(text)]
    words = list(_WORD.finditer(text)) if any(text[max(e - 2, 0) : e] in _MARKER_ENDS or text[max(e - 3, 0) : e] in _LAST_LETTERS for e in ends) else []
    for n, w in enumerate(words):
        word = w.group()
        if word[-2:] not in _MARKER_ENDS and word[-3:] not in _LONGER_ENDS and word not in _MARKER_WORDS:
            continue
        read = _turkish_marker(words, n, text) if not any(m.start <= w.start() < m.end for m in found) else None
        if read:
            found.append(Marker(w.start(), w.end(), w.group(), read[0], read[1], True, read[2]))
    found.sort()
    left = delegations(text) if any(m.turkish for m in found) else []
    found = [m for m in found if not any(a <= m.start < b for a, b in left)]
    return [m for m in found if m.binding or not m.turkish or _holds(m, text, found)]


def is_turkish(text: str, found: list[Marker]) -> bool:
    return any(m.turkish for m in found) or len(re.findall("[çğıöşüÇĞİÖŞÜ]", text)) >= 3


def qualifiers(text: str, turkish: bool) -> tuple[list[str], list[str]]:
    """(conditions, exceptions): English ones from their word to the end, Turkish ones from the clause's start to their word."""
    if not turkish:
        return tuple([text[m.start() :] for m in p.finditer(text)] for p in _QUALIFIERS)
    out = []
    for closing in (TR_CONDITION, TR_EXCEPTION):
        spans = []
        for word in _WORD.finditer(text):
            if word.group() in closing:
                start = max((m.end() for m in re.finditer(r"[,;:(]\s*|[.!?]\s+(?=[A-ZÇĞİÖŞÜ(])", text[: word.start()])), default=0)
                span = text[start : word.end()].strip()
                if len(span.split()) >= 2:
                    spans.append(span)
        out.append(spans)
    return tuple(out)


def _english(text: str, found: list[Marker]) -> list[Duty] | None:
    conditions, exceptions = qualifiers(text, False)
    breaks, out = [(m.start(), m.end()) for m in _EN_SENTENCE.finditer(text)], []
    for n, marker in enumerate(found):
        start = max((b for a, b in breaks if b <= marker.start), default=0)
        before = _LABEL.sub("", text[start : marker.start]).strip()
        if n and start < found[n - 1].end:  # a further act of the same actor, only where the text joins them
            if not _COORDINATED.search(before):
                return None
            subject = out[-1].subject
        else:
            subject = before.rsplit(",", 1)[-1].strip() if re.match(r"(?i)(?:if|where|when)\b", before) else before
        if not subject or len(subject) > SUBJECT_MAX or re.search("[.;:?!]", subject) or re.search(AUTHOR, subject):
            return None
        if marker.mode in ("MAY", "MAY_NOT") and re.match(LEAST_POWER, text[marker.end :]):
            return None
        end = min((a for a, _ in breaks if a >= marker.end), default=len(text))
        if n + 1 < len(found) and found[n + 1].start < end:
            joint = re.search(r"(?i)\s+(?:and|or)\s*$", text[marker.end : found[n + 1].start])
            if not joint:
                return None
            end = marker.end + joint.start()
        action = text[marker.end : end].strip()
        if not action:
            return None
        out.append(Duty(subject, marker.mode, action, start, end, conditions, exceptions))
    return out


def _turkish(text: str, found: list[Marker]) -> list[Duty] | None:
    soft_ends = {m.end for m in found if not m.binding}
    conditions, exceptions = ([q for q in qs if text.find(q) + len(q) not in soft_ends] for qs in qualifiers(text, True))
    out = []
    for marker in found:
        start = max((m.end() for m in _TR_STOP.finditer(text, 0, marker.start)), default=0)
        head = re.sub(r"^\([0-9]+\)\s*|^[a-zçğıöşü]\)\s*", "", text[start : marker.end])
        comma = head.find(",")
        subject = head[:comma].strip() if 0 < comma <= COMMA_MAX else head.split(" ")[0].strip()
        rest = head[len(subject) :].lstrip(", ").strip()
        alone = [m for m in found if start <= m.start < marker.end and (m.binding or not marker.binding)]
        action = rest[: -len(marker.word)].rstrip() if marker.alone else rest
        if not subject or subject not in text[: marker.start] or len(alone) > 1 or not rest.endswith(marker.word) or not action:
            if marker.binding:
                return None
            continue
        out.append(Duty(subject, marker.mode, action, start, marker.end, conditions, exceptions))
    return out or None


def read_duties(text: str | None) -> tuple[str, list[Duty]]:
    """EXTRACTED with every duty, NO_EXPLICIT_OBLIGATION, or INSUFFICIENT_EVIDENCE."""
    text = text or ""
    found = markers(text)
    if not found:
        return "NO_EXPLICIT_OBLIGATION", []
    duties = _turkish(text, [m for m in found if m.turkish]) if is_turkish(text, found) else _english(text, found)
    return ("EXTRACTED", duties) if duties else ("INSUFFICIENT_EVIDENCE", [])


class Element(NamedTuple):
    id: str
    kind: str
    text: str
    critical: bool


def elements(text: str, duty: Duty) -> list[Element]:
    """The parts of a duty a statement may state or miss: every deadline, amount, condition and exception, numbered."""
    sentence = text[duty.start : duty.end]
    parts = [("subject", "SUBJECT", duty.subject, False), ("modal", "MODAL", duty.modality, False), ("act", "ACT", duty.action, True)]
    numbers = {"DEADLINE": [], "THRESHOLD": []}
    for q in read_quantities(sentence):
        numbers["DEADLINE" if q.unit_class == "duration" else "THRESHOLD"].append(sentence[q.phrase_start : q.phrase_end])
    out = [Element(*p) for p in parts]
    for kind, spans, critical in (*((k, v, True) for k, v in numbers.items()), ("CONDITION", duty.conditions, False), ("EXCEPTION", duty.exceptions, False)):
        out += [Element(f"{kind.lower()}_{n}", kind, span, critical) for n, span in enumerate(spans, 1)]
    return out


def missing_qualifiers(text: str | None, carried: list[str] | None) -> list[str]:
    """Qualifiers of a text that none of the carried spans holds."""
    text = text or ""
    found = markers(text)
    conditions, exceptions = qualifiers(text, is_turkish(text, found))
    return [q for q in (*conditions, *exceptions) if not any(q in c for c in carried or () if c)]


def uncovered(text: str | None, actions: list[str] | None) -> list[tuple[int, int]]:
    """Sentences with a marker in which no given action stands: (start, end)."""
    text = blank_notes(text or "")
    found = markers(text)
    stops = [m.end() for m in _TR_STOP.finditer(text)]
    spans = list(zip([0, *stops], [*stops, len(text)]))
    places = [text.find(a) for a in actions or () if a]
    return [(a, b) for a, b in spans if any(a <= m.start < b for m in found) and not any(a <= p < b for p in places if p >= 0)]
