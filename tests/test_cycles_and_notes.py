"""Cycles of a graph against plain Python, and amendment notes of a small article."""

import random
from datetime import date

from normlake.functions.amendments import notes_in
from normlake.operators.amendments import changes_since, clause_notes, latest_notes
from normlake.operators.cycles import cycles


def brute(edges):
    to = {}
    for a, b in edges:
        if a is not None and b is not None:
            to.setdefault(a, set()).add(b)

    def reach(n):
        seen, todo = set(), list(to.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += to.get(x, ())
        return seen

    far = {n: reach(n) for n in to}
    out = []
    for n in far:
        own = {m for m in far[n] if n in far.get(m, ())}
        if own:
            out.append((n, min(own), len(own)))
    return sorted(out)


def test_cycles(spark):
    r = random.Random(2)
    graphs = [[(r.randint(0, 30), r.randint(0, 30)) for _ in range(n)] for n in (15, 35)] + [[(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8), (None, 1), (1, None), (1, 2)]]
    for edges in graphs:
        df = spark.createDataFrame(edges, "p bigint, q bigint")
        assert sorted(map(tuple, cycles(df, "p", "q").collect())) == brute(edges)
    assert cycles(spark.createDataFrame([], "p bigint, q bigint"), "p", "q").collect() == [] and cycles(spark.createDataFrame([(1, 2), (2, 3)], "p bigint, q bigint"), "p", "q").collect() == []


def test_notes():
    found = notes_in("(Mülga: 11/1/2001-4619/5 md.; Yeniden düzenleme: 24/5/2013-6487/2 md.) Reklamı yapılamaz.")
    assert [(n.action, n.dated, n.instrument, n.on_own_line) for n in found] == [("REPEALED", date(2001, 1, 11), "4619/5 md", False), ("REENACTED", date(2013, 5, 24), "6487/2 md", False)]
    assert [(n.action, n.unit, n.instrument) for n in notes_in("(2) (Değişik:RG-18/9/2013-28769) Meskûn mahaller")] == [("CHANGED", "UNSPECIFIED", "28769")]
    assert notes_in("(Ek cümle:11/6/2026-7584/2 md.) X")[0].unit == "SENTENCE" and notes_in("Bir (örnek) parantez. (Ek: 45/13/2020-1)") == [] == notes_in(None)


def test_levels(spark):
    text = ("(Yeniden düzenleme: 24/5/2013-6487/2 md.)\n(1) Birinci cümle. (Ek cümle:11/6/2026-7584/2 md.) İkinci cümle zorunludur.\n(2) (Değişik:RG-20/9/2023-32315) Satıcılar;\na) belge almak,\n"
            "b) (Ek:1/1/2020-1/1 md.) kayıt olmak,\nzorundadır.\n(3) Sade. (Değişik ibare:2/2/2022-2/2 md.) Son.")
    df = spark.createDataFrame([(1, text, "k"), (2, "", "leer"), (3, None, "null"), (4, "(1) Notsuz.", "x")], "version_id int, text string, label string")
    notes = clause_notes(df)
    got = {(n.ref.split("/", 1)[1], n.action, n.level) for n in notes.collect()}
    refs = ["f.1/c.1", "f.1/c.2", "f.2/b.a", "f.2/b.b", "f.3/c.1", "f.3/c.2"]
    assert got == {(r, "REENACTED", "ARTICLE") for r in refs} | {("f.1/c.2", "ADDED", "OWN"), ("f.2/b.a", "CHANGED", "LIST"), ("f.2/b.b", "CHANGED", "LIST"), ("f.2/b.b", "ADDED", "OWN"), ("f.3/c.2", "CHANGED", "OWN")}
    last = {r.ref.split("/", 1)[1]: (r.notes, r.own, r.action, r.level, r.dated.year) for r in latest_notes(notes).collect()}
    assert last["f.2/b.b"] == (3, 1, "CHANGED", "LIST", 2023) and last["f.1/c.1"] == (1, 0, "REENACTED", "ARTICLE", 2013)
    duties = spark.createDataFrame([(1, "k/f.1/c.2")], "version_id int, ref string")
    assert {(r.ref.split("/", 1)[1], r.kind, r.impact) for r in changes_since(notes, duties, "2022-01-01").collect()} == {
        ("f.1/c.2", "ADDED", "NEW_DUTY"), ("f.2/b.a", "MODIFIED", "NO_DUTY_AFFECTED"), ("f.2/b.b", "MODIFIED", "NO_DUTY_AFFECTED"), ("f.3/c.2", "MODIFIED", "NO_DUTY_AFFECTED")}
