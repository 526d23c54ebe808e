import random

from conftest_llm import ODD, frame
from normlake.llm.decontaminate import Automaton, clean, contamination, item_blocks, scan_texts, without, words


def brute(text_words, items, window):
    hit, found = set(), set()
    for name, item in items:
        n = min(window, len(item))
        runs = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if item else set()
        for i in range(len(text_words) - n + 1):
            if tuple(text_words[i : i + n]) in runs:
                hit.update(range(i, i + n))
                found.add(name)
    return hit, found


def test_automaton_against_brute_force():
    r = random.Random(5)
    for _ in range(300):
        items = [(str(k), [r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 9))]) for k in range(r.randint(0, 5))]
        text, window = [r.choice([b"a", b"b", b"c", b"d"]) for _ in range(r.randint(0, 40))], r.randint(1, 5)
        spans, found, _ = Automaton(items, window).scan(text)
        assert ({p for a, b in spans for p in range(a, b)}, found) == brute(text, items, window), (items, text, window)


def test_odd_rows_and_items(spark, odd):
    bench = spark.createDataFrame([(9, "two THREE, four"), (9, "two three four"), (None, "words"), (8, None), (7, ""), (6, "...")], "item_id bigint, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in contamination(odd, bench).collect()), key=str)
    expected = []
    for doc_id, text, *_ in ODD:
        w = words(text)
        hit, found = brute(w, [("9", words("two three four")), (None, [b"words"])], 10)
        expected.append((doc_id, len(w), len(hit), sorted(f for f in found if f), bool(hit)))
    assert got == sorted(expected, key=str)


def test_blocks_of_items_change_nothing(spark, odd):
    bench = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2}") for i in range(12)], "item_id bigint, text string")
    whole = sorted(map(str, scan_texts(odd, bench).collect()))
    assert sorted(map(str, scan_texts(odd, bench, item_words=7).collect())) == whole
    assert [len(b) for b in item_blocks([("a", [b"x"] * 4), ("b", [b"x"] * 4), ("c", [b"x"])], 5)] == [1, 2]


def test_empty_tables(spark, odd, nothing):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert all(not r.contaminated for r in contamination(odd, bench).collect())
    assert contamination(nothing, bench).collect() == []


def test_clean(spark):
    bench = spark.createDataFrame([(1, "b c")], "item_id bigint, text string")
    docs = frame(spark, [(1, "a b, c! d", "en", "s"), (2, "x y", "en", "s"), (3, None, "en", "s")])
    assert sorted(r.doc_id for r in clean(docs, bench).collect()) == [2, 3]
    loose = {r.doc_id: r.text for r in clean(docs, bench, max_coverage=0.5).collect()}
    assert loose == {1: "a d", 2: "x y", 3: None} and clean(docs, bench).columns == docs.columns
    assert without("é b c é", [(1, 3)]) == "é é"
