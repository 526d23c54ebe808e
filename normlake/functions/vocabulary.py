"""The words that readers of Turkish and English regulations look for."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

#: Letters of a Turkish or English word.
LETTER = "A-Za-zÇĞİÖŞÜçğıöşüâîû"
LOWER = "a-zçğıöşü"

# Number words.
TR_NUMBERS = {"sıfır": 0, "bir": 1, "iki": 2, "üç": 3, "dört": 4, "beş": 5, "altı": 6, "yedi": 7, "sekiz": 8, "dokuz": 9, "on": 10, "yirmi": 20, "otuz": 30, "kırk": 40, "elli": 50,
              "altmış": 60, "yetmiş": 70, "seksen": 80, "doksan": 90, "yüz": 100, "bin": 1000, "milyon": 10**6, "milyar": 10**9}
EN_NUMBERS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13,
              "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60,
              "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9}

# Words that take something out of a rule.
EXCLUSIONS = ("uygulanmaz", "hariç", f"istisna[{LOWER}]*", "saklıdır", "kapsam dışı", "kapsamaz", f"muaf[{LOWER}]*", "does not apply", "unless", "except", "exception", "exceptions",
              "other than", "exempt", "exemption", "exemptions", "exempted", "exempts")

# Units and currencies of the five-class change rule, and the number words it knows.
CHANGE_UNITS = (r"iş\s*gün", "gün", "ay", "yıl", "hafta", "saat", "business days?", "working days?", "days?", "months?", "years?", "weeks?", "hours?")
CHANGE_CURRENCIES_AFTER = ("TL", "₺", "Türk Lirası", "EUR", "USD", "GBP", "£", "€", r"\$")
CHANGE_NUMBERS = ("bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz", "on", "onbeş", "yirmi", "otuz", "kırk", "elli", "altmış", "yetmiş", "seksen", "doksan", "yüz",
                  "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen",
                  "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")

# The party a clause is about, and who must act; the first group of words that occurs names the kind.
COUNTERPARTIES = (
    ("FOREIGN_ASSOCIATION_BRANCH", r"yabancı (?:dernek|vakıf)"),
    ("ASSOCIATION", r"\bdernek"),
    ("FOUNDATION", r"\bvak[ıi]f"),
    ("UNION", r"\bsendika|\bkonfederasyon"),
    ("POLITICAL_PARTY", r"siyas[iî] parti"),
    ("UNINCORPORATED", r"tüzel kişiliği olmayan|\bapartman|site veya iş han"),
    ("PUBLIC_BODY", r"\bkamu kurum"),
    ("NON_RESIDENT", r"yurt dışında yerleşik|\bnon-resident"),
    ("CORRESPONDENT", r"\bmuhabir|\bcorrespondent bank"),
    ("INDIVIDUAL", r"\bgerçek kişi|\bgerçek (?:ve|veya|ya da) tüzel kişi|\bretail client|\bconsumers?\b|\bindividuals?\b"),
    ("LEGAL_ENTITY", r"ticaret siciline kayıtlı|\btüzel kişi(?!liği olmayan)|\bşirketler|\bşirketin|\bcompan(?:y|ies)\b|\bcorporate client"),
)
OBLIGED = (
    ("FOREIGN_HQ_OBLIGED", r"merkezi yurt dışında"),
    ("BANK", r"\bbankalar\b|\bbanka\b|\bbanks?\b"),
    ("PAYMENT_INSTITUTION", r"ödeme kuruluş|payment institution"),
    ("EMONEY_INSTITUTION", r"elektronik para kuruluş|e-?money institution"),
    ("INSURANCE", r"sigorta şirket|sigorta ve emeklilik|\binsurers?\b"),
    ("BROKER", r"aracı kurum|portföy yönetim|\binvestment firms?\b"),
    ("EXCHANGE_OFFICE", r"yetkili müessese|döviz büro"),
    ("DNFBP_GENERIC", r"finansal olmayan belirli iş ve meslek|designated non-financial business|\bdnfbps?\b"),
    ("FINANCIAL_GENERIC", r"finansal kuruluş|financial institution"),
    ("GENERIC", r"\byükümlü|\bfirms?\b"),
)
#: A foreign association's branch is not read as the association or foundation its words name.
SUPPRESSED = {"FOREIGN_ASSOCIATION_BRANCH": ("ASSOCIATION", "FOUNDATION")}


#: A group, a class, an escape, a letter that may be absent, or a plain letter or blank of a pattern.
_PART = re.compile(r"\((?:[^()]|\([^()]*\))*\)[?*+]?|\[[^]]*\][?*+]?|\\.[?*+]?|.[?*]|.", re.DOTALL)


def needed(pattern: str) -> list[str] | None:
    """Words of which one stands in every text the pattern is found in; None if the pattern does not say so."""
    runs, longest = [""], [""]
    for part in _PART.findall(pattern):
        if part == "|":
            runs, longest = [*runs, ""], [*longest, ""]
        elif len(part) == 1 and (part.isalpha() or part in " -"):
            runs[-1] += part
            longest[-1] = max(longest[-1], runs[-1], key=len)
        else:
            runs[-1] = ""
    return longest if all(len(word) > 1 for word in longest) else None


def named_by(folded: Column, pattern: str) -> Column:
    """Does a pattern occur in a folded text: its words are looked for first, which is cheaper."""
    words = needed(pattern)
    found = folded.rlike(f"(?U){pattern}")
    return found if words is None else reduce(Column.__or__, (F.contains(folded, F.lit(w)) for w in words)) & found


def kinds_named(text: Column, table) -> Column:
    """Kinds of ``table`` whose words occur in a text, in the table's order, without those another kind suppresses."""
    def suppressed(found: Column) -> Column:
        for kind, gone in SUPPRESSED.items():
            if kind in dict(table):
                found = F.when(F.array_contains(found, kind), F.array_except(found, F.array(*map(F.lit, gone)))).otherwise(found)
        return found

    named = lambda folded: F.array_compact(F.array(*[F.when(named_by(folded, pattern), F.lit(kind)) for kind, pattern in table]))
    return tx.once(tx.once(tx.fold(F.coalesce(text, F.lit(""))), named), suppressed)
