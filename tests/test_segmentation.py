"""Sentences, clauses and reading units of articles written for the rules."""

import random

from normlake.functions.segmentation import blank_notes, paragraphs, reading_units, sentence_spans, split_clauses


def sentences(text):
    return [text[a:b] for a, b in sentence_spans(text)]


def test_stops_that_end_nothing():
    assert sentences("See No. 5 of Art. 7 (cf. the Act. It holds). The label reads “Keep cold. Do not mix.” in print. Pay 1.500 TL. Yes! Done? No; Go on.") == [
        "See No. 5 of Art. 7 (cf. the Act. It holds).", "The label reads “Keep cold. Do not mix.” in print.", "Pay 1.500 TL.", "Yes!", "Done?", "No; Go on."]
    assert sentences("5. Madde uygulanır. 1/1/2020 tarihinden önce verilir. küçük harf. T.C. Merkez Bankası A.Ş. Genel Kurulu toplanır.") == [
        "5. Madde uygulanır.", "1/1/2020 tarihinden önce verilir. küçük harf.", "T.C. Merkez Bankası A.Ş. Genel Kurulu toplanır."]
    assert sentences('One " alone. Two.') == ['One " alone.', "Two."] and sentences("") == [] and sentences(" \n ") == []


def test_notes_are_no_wording():
    text = "(2) (Değişik:RG-18/9/2013-28769) Örnek içecek satılamaz. (Ek cümle:11/6/2026-7584/2 md.) Örnek içecek sunulamaz."
    assert len(sentence_spans(text)) == 2 and len(blank_notes(text)) == len(text) and "Değişik" not in blank_notes(text)


LIST = "(1) Piyasaya sürenler;\na) kayıt olmakla,\nb) bilgi vermekle. Bilgi günceldir.\nyükümlüdürler. Süre bir aydır.\n(2) Tek cümle."


def test_items_carry_lead_in_and_closing():
    clauses = split_clauses(LIST, "md. 1")
    assert [c.ref for c in clauses] == ["md. 1/f.1/b.a", "md. 1/f.1/b.b/c.1", "md. 1/f.1/b.b/c.2", "md. 1/f.1/c.2", "md. 1/f.2"]
    item = clauses[0]
    assert (LIST[item.lead_start : item.lead_end], LIST[item.closing_start : item.closing_end]) == ("(1) Piyasaya sürenler;", "yükümlüdürler.")
    units = {u.ref: u for u in reading_units(LIST, "md. 1")}
    assert (units["md. 1/f.1/b.a"].kind, units["md. 1/f.1/b.a"].text) == ("ITEM", "Piyasaya sürenler; kayıt olmakla, yükümlüdürler.")
    assert (units["md. 1/f.2"].kind, units["md. 1/f.2"].text) == ("SENTENCE", "Tek cümle.") and units["md. 1/f.1/b.b/c.2"].text == "Bilgi günceldir."


def test_dash_list_stays_inside_its_item():
    text = "(1) Şartlar:\nc) Bileşiminde;\n-İnositol 100 mg/L\n-Taurin 800 mg/L\nden fazla olamaz.\nç) Alkol ilave edilmez."
    assert [(c.item, c.text) for c in split_clauses(text)] == [("c", "c) Bileşiminde;\n-İnositol 100 mg/L\n-Taurin 800 mg/L\nden fazla olamaz."), ("ç", "ç) Alkol ilave edilmez.")]


def test_what_looked_like_the_end_of_the_list():
    text = "(1) Şartlar:\na) ilk madde\ndevam eder.\nb) son madde\nuygulanır."
    assert [(c.item, c.text, text[c.closing_start : c.closing_end]) for c in split_clauses(text)] == [("a", "a) ilk madde\ndevam eder.", "uygulanır."), ("b", "b) son madde", "uygulanır.")]


def test_repealed_items_and_repeated_refs():
    text = "(1) Belgeler:\na) Satış belgesi.\nc) (Mülga: RG-3/12/2013-28840)\na) Sunum belgesi.\n(1) Tekrar."
    assert [c.ref for c in split_clauses(text, "x")] == ["x/f.1/b.a", "x/f.1/b.a(2)", "x/f.1"]
    assert split_clauses(None) == [] and split_clauses("", "x") == [] and reading_units(None) == []


def test_unnumbered_paragraphs():
    text = "Birinci fıkra. İkinci cümle.\n\nİkinci fıkra."
    assert [(c.ref, c.text) for c in split_clauses(text, "k")] == [("k/f.1/c.1", "Birinci fıkra."), ("k/f.1/c.2", "İkinci cümle."), ("k/f.2", "İkinci fıkra.")]


def test_random_articles_are_rebuilt_from_their_spans():
    r = random.Random(3)
    pieces = ["(1) Lead; ", "(2) Two. Three!", "a) item, ", "b) Item. More.", "closing words.", "- dash", "1) sub", "Text “quoted. Part” (in. Brackets).", "", "(Ek: 1/1/2020)", "No. 5 applies. Yes."]
    for _ in range(300):
        text = "\n".join(r.choice(pieces) for _ in range(r.randint(0, 12)))
        clauses, ends = split_clauses(text, "z"), 0
        assert len({c.ref for c in clauses}) == len(clauses)
        for c in sorted(clauses, key=lambda c: c.start):
            assert text[c.start : c.end] == c.text and c.start >= ends and c.text.strip() == c.text
            ends = c.end
        for p in paragraphs(text):
            assert p.lead.start < p.lead.end
        assert all(u.text == " ".join(text[a:b] for a, b in u.segments) for u in reading_units(text, "z"))
