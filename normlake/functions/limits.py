"""Limits of a property: what is measured, the number and its unit, which way it binds, and whether it limits or only describes.

A number stands before its unit ("150 mg/L"), behind a percent sign ("%25"), or behind the name pH. The words around give the
comparator; the property is named close before the number, by the vocabulary or by "... miktarı". A number that says which products are
meant ("800 mg/L den fazla olan ürünler") is a CONDITION, any other a LIMIT.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from .numerals import fused, lower_tr
from .vocabulary import LETTER, TR_NUMBERS

# Units, properties with the unit they are measured in, and words that name no property of their own.
UNITS = {"mg/l": "mg/L", "g/l": "g/L", "mg/kg": "mg/kg", "ml": "ml", "mm": "mm", "metre": "m", "litre": "L"}
PROPERTIES = (("kafein", "caffeine_mg_per_l", "mg/L"), ("taurin", "taurine_mg_per_l", "mg/L"), ("inositol", "inositol_mg_per_l", "mg/L"), ("glukoronolakton", "glucuronolactone_mg_per_l", "mg/L"),
              ("etil alkol", "ethanol_g_per_l", "g/L"), ("meyve oranı", "fruit_percent", "%"), ("karbondioksit", "co2_percent", "%"), ("malt", "malt_percent", "%"), ("alkol", "abv_percent", "%"),
              ("mesafe", "distance_m", "m"), ("punto", "font_x_height_mm", "mm"), ("x-yüksekliğ", "font_x_height_mm", "mm"))
NO_PROPERTY = ("alkol", "bileşen", "madde", "ürün", "gıda", "toplam", "net")
MEASURED_BY = "miktarı|oranı|değeri|derecesi|içeriği"
#: How far around a number its words are looked for.
NEAR, BEFORE, BEHIND, CLOSE_BEHIND = 28, 70, 40, 30
_FIGURE = r"[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]+)?|[0-9]+(?:[.,][0-9]+)?"
_BY_SIGN = re.compile(rf"(?:%|(?<![{LETTER}])yüzde)\s*(?P<value>{_FIGURE})")
_BY_UNIT = re.compile(rf"(?<![0-9.,])(?P<value>{_FIGURE})\s*(?P<unit>{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![{LETTER}])")
_PH = re.compile(rf"(?<![{LETTER}])ph(?:\s+değeri)?\s*(?P<sign>[>≥<≤=]?)\s*(?P<value>{_FIGURE})(?:\s*[-–]\s*[>≥<≤]?\s*(?P<high>{_FIGURE}))?")
_NAMED = re.compile(rf"([{LETTER}]{{3,}})\s+(?:{MEASURED_BY})")
_FROM, _OF, _OBJECT = r"\s*[’']?\s*(?:den|dan|ten|tan)\s+", r"\s*[’']?\s*(?:nin|nın|nun|nün|in|ın|un|ün)\s+", r"\s*(?:[’']?\s*(?:i|ı|u|ü|yi|yı|yu|yü)\s+)?"
#: Words behind and before a number, in the order in which they are tried.
_COMPARATORS = (
    ("le", _FROM + r"fazla\s+(?:ola(?:maz|mayacak)|kullanıla(?:maz)|içere(?:mez))", rf"en (?:fazla|çok)(?:\s+[{LETTER}]+){{0,2}}\s*$"),
    ("le", _OBJECT + r"(?:aşamaz|geçemez|geçmez|aşmaz)", None), ("le", _OF + r"(?:üzerine|üstüne)\s+çık", None),
    ("ge", _FROM + r"az\s+ola(?:maz)", rf"en az(?:\s+[{LETTER}]+){{0,2}}\s*$"), ("ge", _OF + r"altın(?:a|da)\s+(?:düş|ol|in)", None),
    ("gt", _FROM + "fazla", None), ("ge", r"\s*ve\s+daha\s+fazla", None), ("lt", _FROM + "(?:az|düşük)", None))


class Limit(NamedTuple):
    text: str
    start: int
    end: int
    attribute: str | None
    value: float
    unit: str
    comparator: str
    role: str


def fold_letters(text: str) -> str:
    """Lower case in Turkish, circumflexes off; places stay."""
    return "".join(lower_tr(c).translate(str.maketrans("âîû", "aiu"))[:1] or c for c in text)


def _value(figure: str) -> float:
    if "," in figure:
        return float(figure.replace(".", "").replace(",", "."))
    return float(figure.replace(".", "") if re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{3})+", figure) else figure)


def _spelled(folded: str):
    """Numbers in words before "metre", where a distance is spoken of: (start, end, value)."""
    if not re.search(rf"(?<![{LETTER}])(?:mesafe|yakın|uzak)", folded):
        return
    for run in re.finditer(rf"(?:(?<![{LETTER}])[{LETTER}]+\s+)+metre", folded):
        words = list(re.finditer(f"[{LETTER}]+", run.group()))[:-1]
        tail = []
        while words and fused(words[-1].group()):
            tail.insert(0, words.pop())
        if not tail:
            continue
        total = current = 0
        for name in (n for w in tail for n in fused(w.group())):
            number = TR_NUMBERS[name]
            if number == 100:
                current = (current or 1) * 100
            elif number >= 1000:
                total, current = total + (current or 1) * number, 0
            else:
                current += number
        yield run.start() + tail[0].start(), run.end(), float(total + current)


def _compared(folded: str, start: int, end: int) -> str:
    before, after = folded[max(0, start - 60) : start], folded[end : end + BEHIND]
    for sign, behind, ahead in _COMPARATORS:
        if re.match(behind, after) or (ahead and re.search(ahead, before)):
            return sign
    # the items of a dash list share the words that close it
    listed = re.search(rf"[-–]\s*[{LETTER}]+\s*$", before)
    return "le" if listed and re.search(r"(?:den|dan)\s+fazla\s+olamaz", folded[end:]) else "eq"


def _property(folded: str, start: int, end: int, unit: str) -> str | None:
    before = folded[max(0, start - BEFORE) : start]
    near, window = before[-NEAR:], before + " " + folded[end : end + CLOSE_BEHIND]
    named = [m for m in _NAMED.finditer(before) if m.group(1) not in NO_PROPERTY]
    far = None
    for word, name, measured in PROPERTIES:
        if measured != unit or (word not in near and (far or word not in window)):
            continue
        if named and word not in near and before.rfind(word) < named[-1].start():
            continue  # a property named nearer to the number is the number's
        if word in near:
            return name
        far = name
    return far or (f"property:{named[-1].group(1)[:6]}" if named else None)


def read_limits(text: str | None) -> list[Limit]:
    """Every limit and condition on a property, by place; pH behind the others. A null text has none."""
    text = text or ""
    folded, found, out = fold_letters(text), [], []
    found += [(m.start(), m.end(), _value(m["value"]), "%") for m in _BY_SIGN.finditer(folded)]
    found += [(m.start(), m.end(), _value(m["value"]), UNITS[m["unit"]]) for m in _BY_UNIT.finditer(folded)]
    found += [(a, b, v, "m") for a, b, v in _spelled(folded)]
    for start, end, value, unit in sorted(found):
        sign = _compared(folded, start, end)
        describes = sign in ("gt", "lt") or (unit == "%" and re.match(r"\s*ve\s+daha\s+fazla", folded[end:]))
        out.append(Limit(text[start:end], start, end, _property(folded, start, end, unit), value, unit, sign, "CONDITION" if describes else "LIMIT"))
    for m in _PH.finditer(folded):
        span, behind = (text[m.start() : m.end()], m.start(), m.end(), "ph"), folded[m.end() : m.end() + CLOSE_BEHIND]
        if m["high"]:
            out += [Limit(*span, _value(m["value"]), "pH", "ge", "LIMIT"), Limit(*span, _value(m["high"]), "pH", "le", "LIMIT")]
        elif m["sign"] in ("≤", "<") or re.match(_OBJECT + "(?:geçemez|aşamaz|geçmez|aşmaz)", behind):
            out.append(Limit(*span, _value(m["value"]), "pH", "le", "LIMIT"))
        elif m["sign"] in ("≥", ">") or re.search(r"en az\s*$", folded[: m.start()]) or re.match(_OF + "altın", behind):
            out.append(Limit(*span, _value(m["value"]), "pH", "ge", "LIMIT"))
    return out
