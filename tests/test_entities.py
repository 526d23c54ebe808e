"""The entity gate on clauses and profiles written for the rules."""

import pytest
from pyspark.sql import functions as F

from normlake.operators import entities as en

CLAUSES = {
    "generic": ("A firm must act.", "A firm"), "bank": ("A bank must act.", "A bank"), "either": ("Ödeme kuruluşları ile elektronik para kuruluşları bildirmek zorundadır.", "Ödeme kuruluşları ile elektronik para kuruluşları"),
    "finance": ("Finansal kuruluşlar bildirir.", "Finansal kuruluşlar"), "association": ("(1) Dernek kimlik tespitinde belge alınır.", "Dernek"), "unincorporated": ("Tüzel kişiliği olmayan teşekküllerde kimlik tespiti yapılır.", ""),
    "foreign": ("Merkezi yurt dışında bulunan bankaların şubeleri bildirir.", "bankaların şubeleri"), "branch": ("Yabancı dernek şubelerinde kimlik tespiti yapılır.", ""),
    "everyone": ("Kamu kurum ve kuruluşları, gerçek ve tüzel kişiler ile tüzel kişiliği olmayan kuruluşlar bilgi vermek zorundadır.", "Kamu kurum ve kuruluşları"),
    "not_everyone": ("Gerçek ve tüzel kişiler adına yapılan işlemlerde bildirim zorunludur.", "Gerçek ve tüzel kişiler"), "non_resident": ("Where a non-resident asks; the firm must act.", "the firm"), "empty": (None, None)}
PROFILES = {"bank": ("A licensed bank", "retail consumers and SMEs", True), "psp": ("Ödeme kuruluşu", "dernek ve vakıflar", False), "jeweller": ("jeweller", "all customers", True), "silent": (None, None, False),
            "generic": ("software", "legal entities", False), "abroad": ("bank headquartered outside Türkiye", "", True)}
WANT = {("generic", "bank"): "NOT_RESTRICTED", ("bank", "bank"): "MATCH", ("bank", "psp"): "MISMATCH", ("bank", "silent"): "UNDETERMINED", ("bank", "generic"): "UNDETERMINED", ("either", "psp"): "MATCH", ("either", "bank"): "MISMATCH",
        ("finance", "psp"): "MATCH", ("finance", "jeweller"): "MISMATCH", ("association", "bank"): "MISMATCH", ("association", "psp"): "MATCH", ("association", "generic"): "UNDETERMINED", ("association", "silent"): "UNDETERMINED",
        ("association", "jeweller"): "MATCH", ("unincorporated", "bank"): "MISMATCH", ("foreign", "bank"): "MISMATCH", ("foreign", "abroad"): "MATCH", ("foreign", "silent"): "UNDETERMINED", ("branch", "psp"): "MATCH", ("branch", "bank"): "MISMATCH",
        ("everyone", "bank"): "NOT_RESTRICTED", ("everyone", "silent"): "NOT_RESTRICTED", ("not_everyone", "bank"): "MATCH", ("non_resident", "bank"): "UNDETERMINED", ("empty", "silent"): "NOT_RESTRICTED"}


@pytest.fixture(scope="module")
def gates(spark):
    clauses = en.required_parties(spark.createDataFrame([(k, *v) for k, v in CLAUSES.items()], "c string, text string, subject string"))
    profiles = en.company_profiles(spark.createDataFrame([(k, *v) for k, v in PROFILES.items()], "p string, description string, customers string, jurisdictions_stated boolean"))
    asked = spark.createDataFrame(list(WANT), "c string, p string")
    return {(r.c, r.p): r for r in en.entity_gate(asked.join(clauses, "c").join(profiles, "p")).collect()}


@pytest.mark.parametrize("pair", list(WANT))
def test_gate(gates, pair):
    assert gates[pair].gate == WANT[pair], gates[pair]


def test_universal_list(spark):
    df = spark.createDataFrame([(v[0],) for v in CLAUSES.values()], "t string").select(en.universal_addressees(F.col("t")).alias("u"))
    assert [r.u for r in df.collect() if r.u] == ["Kamu kurum ve kuruluşları, gerçek ve tüzel kişiler ile tüzel kişiliği olmayan kuruluşlar"]
