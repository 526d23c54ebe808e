"""Limits of sentences written for the rules."""

import pytest

from normlake.functions.limits import fold_letters, read_limits


@pytest.mark.parametrize("text,want", [
    ("Kafein miktarı en fazla 150 mg/L olabilir.", [("caffeine_mg_per_l", 150, "mg/L", "le", "LIMIT")]), ("Etil alkol miktarı 3,0 g/L den fazla olamaz.", [("ethanol_g_per_l", 3, "g/L", "le", "LIMIT")]),
    ("Meyve oranı en az %25 olmalıdır.", [("fruit_percent", 25, "%", "ge", "LIMIT")]), ("Taurin miktarı 800 mg/L den fazla olan ürünler etiketlenir.", [("taurine_mg_per_l", 800, "mg/L", "gt", "CONDITION")]),
    ("Kinin miktarı 85 mg/L’yi geçemez.", [("property:kinin", 85, "mg/L", "le", "LIMIT")]), ("Okullara yüz metre mesafeden yakın satış yapılamaz.", [("distance_m", 100, "m", "eq", "LIMIT")]),
    ("Hacmen % 1,2 ve daha fazla alkol içeren içecekler.", [("abv_percent", 1.2, "%", "ge", "CONDITION")]), ("pH değeri 4,8’i geçemez.", [("ph", 4.8, "pH", "le", "LIMIT")]),
    ("pH değeri 3,8 - 4,8 olur.", [("ph", 3.8, "pH", "ge", "LIMIT"), ("ph", 4.8, "pH", "le", "LIMIT")]),
    ("Bileşiminde; -İnositol 100 mg/L -Taurin 800 mg/L den fazla olamaz.", [("inositol_mg_per_l", 100, "mg/L", "le", "LIMIT"), ("taurine_mg_per_l", 800, "mg/L", "le", "LIMIT")]),
    ("Uzunluk 2.800 mm den azdır.", [(None, 2800, "mm", "lt", "CONDITION")]), ("YÜZDE 10 karbondioksit bulunur.", [("co2_percent", 10, "%", "eq", "LIMIT")]),
    ("etil alkol miktarı en çok 3,0 g/L, laktik asit miktarı en çok 0,6 g/L olur", [("ethanol_g_per_l", 3, "g/L", "le", "LIMIT"), ("property:asit", 0.6, "g/L", "le", "LIMIT")]),
    ("Yüz yüze görüşülür.", []), ("5 mlk", []), (None, []), ("", [])])
def test_limits(text, want):
    found = read_limits(text)
    assert [(f.attribute, f.value, f.unit, f.comparator, f.role) for f in found] == want
    assert all(text[f.start : f.end] == f.text for f in found)


def test_folding_keeps_places():
    text = "İSPİRTO ve IŞIK, Âlâ"
    assert fold_letters(text) == "ispirto ve ışık, ala" and len(fold_letters(text)) == len(text)
