"""Duties of sentences written for the rules."""

import pytest

from normlake.functions.duties import delegations, elements, markers, missing_qualifiers, read_duties, uncovered


def said(text):
    status, duties = read_duties(text)
    return status, [(d.subject, d.modality, d.action) for d in duties]


@pytest.mark.parametrize("text,duties", [
    ("A firm must report the transfer within 5 days.", [("A firm", "MUST", "report the transfer within 5 days.")]),
    ("A firm must keep records and must not disclose them. A lender should act.", [("A firm", "MUST", "keep records"), ("A firm", "MUST_NOT", "disclose them."), ("A lender", "SHOULD", "act.")]),
    ("Where a customer asks, the firm is required to answer.", [("the firm", "MUST", "answer.")]), ("2.1.3 R A firm shall act.", [("A firm", "MUST", "act.")]), ("The firm will notify the authority.", [("The firm", "MUST", "notify the authority.")]),
    ("Lenders are prohibited from lending twice.", [("Lenders", "MUST_NOT", "lending twice.")]), ("Yükümlüler şüpheli işlemleri Başkanlığa bildirmek zorundadır.", [("Yükümlüler", "MUST", "şüpheli işlemleri Başkanlığa bildirmek")]),
    ("Finansal kuruluşlar, bilgileri hiç kimseye açıklayamazlar.", [("Finansal kuruluşlar", "MUST_NOT", "bilgileri hiç kimseye açıklayamazlar")]), ("Bankalar belgeleri saklar.", [("Bankalar", "MUST", "belgeleri saklar")]),
    ("(2) Kayıtlar, Başkanlığa bildirilir.", [("Kayıtlar", "MUST", "Başkanlığa bildirilir")])])
def test_duties(text, duties):
    assert said(text) == ("EXTRACTED", duties)


@pytest.mark.parametrize("text,status", [
    ("Nothing is said here.", "NO_EXPLICIT_OBLIGATION"), (None, "NO_EXPLICIT_OBLIGATION"), ("", "NO_EXPLICIT_OBLIGATION"), ("We must act.", "INSUFFICIENT_EVIDENCE"), ("A loss may be large.", "INSUFFICIENT_EVIDENCE"),
    ("A firm must act, but it may refuse.", "INSUFFICIENT_EVIDENCE"), ("must act.", "INSUFFICIENT_EVIDENCE"), ("Usul ve esaslar yönetmelikle belirlenir.", "NO_EXPLICIT_OBLIGATION"),
    ("Bakanlık belirlemeye yetkilidir.", "NO_EXPLICIT_OBLIGATION"), ("Bu madde hükümleri bankalara uygulanmaz.", "NO_EXPLICIT_OBLIGATION"), ("Terim, bir ayı ifade eder.", "NO_EXPLICIT_OBLIGATION"),
    ("Hüküm hakları ortadan kaldırmaz.", "NO_EXPLICIT_OBLIGATION")])
def test_no_duty(text, status):
    assert read_duties(text) == (status, [])


def test_markers_net_of_delegation():
    text = "Yükümlüler kimlik tespit etmek zorundadır. Usul ve esaslar Bakanlıkça tespit edilir."
    assert len(delegations(text)) == 1 and [m.word for m in markers(text)] == ["zorundadır"]
    assert [(m.word, m.binding) for m in markers("Müşteri yalnızca onay halinde işlem yapabilir.")] == [("halinde", False)]
    assert markers("Müşteri onay halinde işlem yapabilir.") == [] and [m.word for m in markers("Onay alınması şartıyla mümkündür.")] == ["şartıyla"]
    assert [m.word for m in markers("Üçüncü tarafa güven ilkesi, riskli olması durumunda uygulanmaz.")] == ["uygulanmaz"]


def test_all_qualifiers_and_numbers():
    text = "If asked, a firm must keep the file for at least 5 years and 6 months above EUR 100 or 2%, unless exempt, except where closed."
    status, (duty,) = read_duties(text)
    assert duty.subject == "a firm" and [c.split(" ")[0] for c in duty.conditions] == ["If", "where"] and [e.split(" ")[0] for e in duty.exceptions] == ["unless", "except"]
    assert [(e.id, e.text) for e in elements(text, duty) if e.kind in ("DEADLINE", "THRESHOLD")] == [("deadline_1", "for at least 5 years"), ("deadline_2", "6 months"), ("threshold_1", "above EUR 100"), ("threshold_2", "2%")]
    assert [q.split(" ")[0] for q in missing_qualifiers(text, [duty.conditions[0]])] == [] and [q.split(" ")[0] for q in missing_qualifiers(text, [duty.exceptions[1]])] == ["If", "unless"]
    turkish = "Yükümlüler, şüphe duyulması hâlinde, gerçek kişiler hariç, bildirmek zorundadır."
    assert missing_qualifiers(turkish, ["gerçek kişiler hariç"]) == ["şüphe duyulması hâlinde"] and missing_qualifiers(None, None) == []


def test_uncovered_sentences():
    text = "A firm must report. A bank must keep files. Nothing here. An insurer should act."
    assert [text[a:b].strip() for a, b in uncovered(text, ["report."])] == ["A bank must keep files.", "An insurer should act."] and uncovered(None, None) == []
