"""Does a clause concern a company: the parties its words name against what the company's profile says it is and whom it serves.

Kinds are read from wording on both sides by column expressions: who must act from the subject, whom the clause is about from
subject and opening, the company's kind from its description and its customers from their own field. A clause is ruled out only where
every reading of it is; what a profile does not state stays undetermined. Clauses and profiles are read once each and meet in the
pairs that are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocabulary as vc

# How a profile says what the company is.
COMPANY_KINDS = (
    ("BANK", r"\bbanka\b|\bbankası\b|\bbankacılık|\bmevduat|katılım bank|\bbank\b|\bbanking\b"),
    ("EXCHANGE_OFFICE", r"yetkili müessese|döviz büro|döviz alım satım|kambiyo|\bsarraf|bureau de change|currency exchange"),
    ("BROKER", r"aracı kurum|portföy yönetim|menkul değer|sermaye piyasası|yatırım kuruluş|investment firm|\bbroker"),
    ("PAYMENT_INSTITUTION", r"ödeme kuruluş|ödeme hizmet|ödeme aracı|sanal pos|para transfer|payment (?:institution|service)|\bpsp\b|money remittance"),
    ("EMONEY_INSTITUTION", r"elektronik para|\be-para|\be-?money"),
    ("INSURANCE", r"\bsigorta|reasürans|emeklilik şirket|\binsur"),
    ("LEASING", r"finansal kiralama|financial leasing|\bleasing\b"),
    ("CRYPTO", r"\bkripto|\bcrypto|dijital varlık|sanal varlık|virtual asset|bitcoin|ethereum"),
    ("PRECIOUS_METALS", r"\bkuyum|mücevher|kıymetli maden|külçe|ziynet|\bsarraf|gümüş|pırlanta|\belmas|precious metal|jewel"),
    ("REAL_ESTATE", r"\bemlak|gayrimenkul|taşınmaz alım|konut satış|real estate"),
    ("LAWYER", r"\bavukat|hukuk bürosu|law firm"),
    ("ACCOUNTANT", r"\bsmmm\b|\bymm\b|serbest muhasebeci|mali müşavir|accounting firm|\baccountan"),
    ("ECOMMERCE", r"elektronik ticaret aracı|pazar ?yeri|marketplace"),
)
FINANCIAL = ("BANK", "EXCHANGE_OFFICE", "BROKER", "PAYMENT_INSTITUTION", "EMONEY_INSTITUTION", "INSURANCE", "LEASING", "CRYPTO")
NON_FINANCIAL = ("PRECIOUS_METALS", "REAL_ESTATE", "LAWYER", "ACCOUNTANT", "ECOMMERCE")
DNFBP = ("PRECIOUS_METALS", "REAL_ESTATE", "LAWYER", "ACCOUNTANT")
# Customer families as a profile states them, which of them a counterparty is, and what silence leaves open.
CUSTOMER_FAMILIES = (
    ("ANY", r"\btüm müşteri|\bher tür müşteri|\bbütün müşteri|\ball customers|\ball clients"),
    ("INDIVIDUAL", r"\bbireysel|\bgerçek kişi|\btüketici|\bindividual|\bretail|\bconsumer|\bborrowers?\b|\bşahıs"),
    ("BUSINESS", r"\bkobi|\bşirket|\bişletme|\büye işyer|\bkurumsal|\bticari|\btacir|\besnaf|\bcompan(?:y|ies)|\bmerchant|\bsmes?\b|\bbusiness|\bcorporate"),
    ("LEGAL_ENTITY_GENERIC", r"\btüzel kişi|\blegal entit"),
    ("ASSOCIATION", r"\bdernek|\bassociation"), ("FOUNDATION", r"\bvak[ıi]f|\bfoundation"), ("UNION", r"\bsendika|\bkonfederasyon|\btrade union"),
    ("POLITICAL_PARTY", r"siyas[iî] parti|political part"), ("PUBLIC_BODY", r"\bkamu|\bpublic bod|\bpublic sector"), ("NON_RESIDENT", r"yurt dışı|\byabancı|\bnon-resident"),
    ("CORRESPONDENT", r"\bmuhabir|\bfinansal kuruluş|\bbanka|\bfinancial institution"), ("UNINCORPORATED", r"tüzel kişiliği olmayan|\bapartman|\bsite yönetim"),
)
SATISFIES = {"INDIVIDUAL": ("INDIVIDUAL",), "LEGAL_ENTITY": ("BUSINESS", "LEGAL_ENTITY_GENERIC", "ASSOCIATION", "FOUNDATION", "PUBLIC_BODY"), "ASSOCIATION": ("ASSOCIATION",),
             "FOUNDATION": ("FOUNDATION",), "UNION": ("UNION",), "POLITICAL_PARTY": ("POLITICAL_PARTY",), "PUBLIC_BODY": ("PUBLIC_BODY",), "UNINCORPORATED": ("UNINCORPORATED",),
             "FOREIGN_ASSOCIATION_BRANCH": ("ASSOCIATION", "FOUNDATION"), "NON_RESIDENT": ("NON_RESIDENT",), "CORRESPONDENT": ("CORRESPONDENT",)}
MAYBE_GENERIC_LEGAL = ("ASSOCIATION", "FOUNDATION", "UNION", "POLITICAL_PARTY", "PUBLIC_BODY", "FOREIGN_ASSOCIATION_BRANCH", "UNINCORPORATED")
NEVER_RULED_OUT = ("NON_RESIDENT", "CORRESPONDENT")
FOREIGN_HQ = r"(?U)merkezi yurt dışında|headquartered outside|yabancı merkezli"
# The opening of a clause, and addressees that bind everyone when they open it bare and a duty follows.
LEADING_NOTE = r"^\s*(?:\([0-9]+\)\s*)?(?:\((?:Ek|Değişik|Mülga|Yeniden düzenleme)[^()]*\)\s*)*"
HEAD = r"(?s)^(.{0,220}?)(?:[;:]|kimlik tespitinde|kimlik tespiti|\bmust\b|\bshall\b|zorundadır|yükümlüdür|$)"
EVERYONE = ("gerçek (?:ve|veya|ya da) tüzel kişiler", "tüzel kişiler", "herkes", "hiç ?bir kimse", "hiç kimse", "her kim", "(?:any|every|no) person", "all persons", "anyone", "everyone", "no-?one", "no one")
SOME = ("gerçek kişiler", "tüzel kişiliği olmayan (?:kuruluşlar|teşekküller|kurumlar)", "kamu kurum(?:ları)? ve kuruluşları|kamu kurumları|kamu kuruluşları|kamu idareleri")
JOINT = r"(?:\s*,\s*(?:(?:ve|ile|veya|ya da|and|or)\s+)?|\s+(?:ve|ile|veya|ya da|and|or)\s+)"
NOT_SUBJECT = ("adına tarafından hakkında için ile ilgili arasında nezdinde lehine aleyhine bakımından yönünden açısından dışında dahil dâhil gibi kadar karşı yerine namına hesabına aracılığıyla "
               "vasıtasıyla üzerinde ve veya ya yahut and or").split(" ")
DUTY_WORD = r"(?U)zorunda|mecbur|zorunludur|yasaktır|yükümlü(?:dür|dürler)?(?!\w)|\b(?:must|shall|may|cannot)\b|\b(?:is|are) (?:required|obliged)\b|\w+(?<!ıl|il|ul|ül)(?:y?amaz|y?emez)(?:lar|ler)?(?!\w)"


def universal_addressees(text: Column) -> Column:
    """The list of addressees that opens a clause and binds everyone; empty where there is none."""
    item = "|".join((*EVERYONE, *SOME))
    body = F.regexp_replace(F.coalesce(text, F.lit("")), LEADING_NOTE, "")
    folded = tx.fold(body)
    listed = F.regexp_extract(folded, rf"(?U)^((?:{item})(?!\w)(?:{JOINT}(?:{item})(?!\w))*)", 1)
    rest = F.substring(folded, F.length(listed) + 1, 2**30)
    bare = ~rest.rlike(rf"(?U)^\s+(?:{'|'.join(NOT_SUBJECT)})(?!\w)")
    duty = F.regexp_extract(rest, r"(?s)^(.*?)(?:[.](?=\s|$)|$)", 1).rlike(DUTY_WORD)
    binds = listed.rlike(rf"(?U)(?:^|\W)(?:{'|'.join(EVERYONE)})(?!\w)") & (F.length(folded) == F.length(body))
    return F.when((F.length(listed) > 0) & binds & bare & duty, F.substring(body, F.lit(1), F.length(listed))).otherwise("")


def required_parties(clauses: DataFrame, text: str = "text", subject: str = "subject") -> DataFrame:
    """``clauses`` with obliged (kinds the subject names), counterparties (kinds that subject and opening name) and universal."""
    universal = universal_addressees(F.col(text))
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), LEADING_NOTE, "")
    opened = lambda body: F.when(body.rlike(HEAD), F.regexp_extract(body, HEAD, 1)).otherwise(F.substring(body, 1, 220))
    head = F.trim(tx.once(body, opened))
    named = F.coalesce(F.col(subject), F.lit(""))
    everyone = F.col("_universal") != ""
    read = clauses.withColumns({"_universal": universal, "_head": head})
    left = F.when(everyone, F.replace(F.col("_head"), F.col("_universal"), F.lit(""))).otherwise(F.col("_head"))
    who = F.when(everyone, F.regexp_replace(named, rf"(?iU)(?:{'|'.join((*EVERYONE, *SOME))})(?!\w)", "")).otherwise(named)
    abroad = "FOREIGN_HQ_OBLIGED"
    opening = vc.kinds_named(left, [(kind, pattern) for kind, pattern in vc.OBLIGED if kind == abroad])
    obliged = tx.once(vc.kinds_named(who, vc.OBLIGED), lambda kinds: F.when((F.size(kinds) == 0) & F.array_contains(opening, abroad), F.array(F.lit(abroad))).otherwise(F.array_remove(kinds, "GENERIC")))
    return read.withColumns({"obliged": obliged, "counterparties": vc.kinds_named(F.concat_ws(" ", who, left), vc.COUNTERPARTIES), "universal": everyone}).drop("_universal", "_head")


def company_profiles(profiles: DataFrame, said: str = "description", customers: str = "customers") -> DataFrame:
    """``profiles`` with kinds (what the company is), families (whom it serves), foreign_hq and customers_stated."""
    return profiles.withColumns({
        "kinds": vc.kinds_named(F.col(said), COMPANY_KINDS), "families": vc.kinds_named(F.col(customers), CUSTOMER_FAMILIES),
        "foreign_hq": tx.fold(F.coalesce(F.col(said), F.lit(""))).rlike(FOREIGN_HQ), "customers_stated": F.trim(F.coalesce(F.col(customers), F.lit(""))) != ""})


def _listed(values) -> Column:
    return F.array(*map(F.lit, values))


def _obliged_verdict(kind: Column) -> Column:
    kinds = F.col("kinds")
    wide = lambda members, others: F.when(F.arrays_overlap(kinds, _listed(members)), "MATCH").when((F.size(kinds) > 0) & (F.size(F.array_except(kinds, _listed(others))) == 0), "MISMATCH").otherwise("UNDETERMINED")
    return (
        F.when(kind == "FOREIGN_HQ_OBLIGED", F.when(F.col("foreign_hq"), "MATCH").when(F.col("jurisdictions_stated"), "MISMATCH").otherwise("UNDETERMINED"))
        .when(kind == "FINANCIAL_GENERIC", wide(FINANCIAL, NON_FINANCIAL)).when(kind == "DNFBP_GENERIC", wide(DNFBP, FINANCIAL + ("ECOMMERCE",)))
        .when(F.array_contains(kinds, kind), "MATCH").when(F.size(kinds) > 0, "MISMATCH").otherwise("UNDETERMINED"))


def _counterparty_verdict(kind: Column) -> Column:
    families = F.col("families")
    satisfied = F.lit(False)
    for name, members in SATISFIES.items():
        satisfied = satisfied | ((kind == name) & F.arrays_overlap(families, _listed(members)))
    return (
        F.when(F.array_contains(families, "ANY") | satisfied, "MATCH").when(kind.isin(*NEVER_RULED_OUT) | ~F.col("customers_stated"), "UNDETERMINED")
        .when(kind.isin(*MAYBE_GENERIC_LEGAL) & F.array_contains(families, "LEGAL_ENTITY_GENERIC"), "UNDETERMINED")
        .when(F.size(F.array_remove(families, "CORRESPONDENT")) > 0, "MISMATCH").otherwise("UNDETERMINED"))


def entity_gate(pairs: DataFrame) -> DataFrame:
    """``pairs`` of a clause (obliged, counterparties) and a profile (kinds, families, ...) with gate: MATCH, MISMATCH, UNDETERMINED or NOT_RESTRICTED.

    The kinds a subject names are alternatives, foreign headquarters a condition on top; counterparties rule a clause out only
    together.
    """
    named = F.array_remove("obliged", "FOREIGN_HQ_OBLIGED")
    verdicts = lambda values, rule: F.transform(values, lambda k: rule(k))
    judged = pairs.withColumns({
        "_o": verdicts(named, _obliged_verdict), "_c": verdicts(F.col("counterparties"), _counterparty_verdict),
        "_q": F.when(F.array_contains("obliged", "FOREIGN_HQ_OBLIGED"), _obliged_verdict(F.lit("FOREIGN_HQ_OBLIGED")))})
    none = lambda name: (F.size(name) > 0) & (F.size(F.array_remove(name, "MISMATCH")) == 0)
    has = lambda name: F.array_contains(name, "MATCH")
    fits = F.coalesce(F.col("_q") == "MATCH", F.lit(True)) & ((F.size("_o") == 0) | has("_o"))
    addressed = F.when(F.size("obliged") == 0, F.lit(None)).when(F.coalesce(F.col("_q") == "MISMATCH", F.lit(False)) | none("_o"), "MISMATCH").when(fits, "MATCH").otherwise("UNDETERMINED")
    judged = judged.withColumn("_a", addressed)
    some = has("_o") | has("_c") | F.coalesce(F.col("_q") == "MATCH", F.lit(False))
    whole = (F.col("_a").isNull() | (F.col("_a") == "MATCH")) & ((F.size("_c") == 0) | has("_c"))
    gate = (
        F.when((F.size("obliged") == 0) & (F.size("counterparties") == 0), "NOT_RESTRICTED").when(F.coalesce(F.col("_a") == "MISMATCH", F.lit(False)) | none("_c"), "MISMATCH")
        .when(some & whole, "MATCH").otherwise("UNDETERMINED"))
    return judged.withColumn("gate", gate).drop("_o", "_c", "_q", "_a")
