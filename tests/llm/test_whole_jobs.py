"""Corpus operators on the cases that lie outside the given tables."""

from __future__ import annotations

import random

from strataloom.llm import decontaminate, quality_rules


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


# --- quality rules -----------------------------------------------------------------------------------


def test_rare_languages_are_judged_by_their_own(spark):
    rng = random.Random(5)

    def text(letters, vocabulary, n):
        words = ["".join(random.Random(f"{letters}{k}").choices(letters, k=2 + k % 7)) for k in range(vocabulary)]
        return " ".join(rng.choices(words, k=n))

    greek, georgian = "αβγδεζηθικλμνξοπρστυφχψω", "აბგდევზთიკლმნოპჟრსტუფქღ"
    rows = [(k, text("abcdefghijklmnopqrstuvwxyz", 500, 20_000), "en") for k in range(70)]
    rows += [(100 + k, text(greek, 200, 200), "el") for k in range(6)] + [(200 + k, text(georgian, 200, 200), "ka") for k in range(2)]
    rows += [(300, text(greek, 200, 200), "en"), (301, "#$%& <|>* " * 60 + text("#$%&|<>", 200, 200), "en"), (302, "ა ბ", "ka"), (303, text(georgian, 200, 200), None)]
    docs = _docs(spark, rows)
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert all(got[k].kept for k in range(70))
    assert all(got[100 + k].kept for k in range(6))  # 0.09 % of all words
    assert all(got[200 + k].kept and got[200 + k].char_js == 0 for k in range(2))  # too few words for a reference
    assert got[300].kept and not got[301].kept and not got[302].kept and not got[303].kept
    assert {r.doc_id for r in quality_rules.accepted(docs).collect()} == {k for k, r in got.items() if r.kept}


# --- decontamination ---------------------------------------------------------------------------------


def test_short_items_keep_their_tolerance(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    items = {n: [word() for _ in range(n)] for n in range(1, 15)} | {n: [word() for _ in range(n)] for n in (15, 17, 20)}
    changes = {n: [tuple(sorted(rng.sample(range(n), k))) for k in range(n // 5 + 2) for _ in range(6) if k <= n] for n in range(1, 15)}
    changes |= {15: [(5, 10)], 17: [(5, 11)], 20: [(5, 10, 15)]}
    rows, want = [], set()
    for n, places in changes.items():
        for at in places:
            said = [word() if k in at else w for k, w in enumerate(items[n])]
            rows.append((len(rows), " ".join([word() for _ in range(rng.randrange(3))] + said + [word() for _ in range(rng.randrange(3))]), "en"))
            if len(at) <= n // 5:
                want.add((rows[-1][0], n, n - len(at)))
    tests = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_matched) for r in decontaminate.contaminated(_docs(spark, rows), tests).collect()}
    assert got == want
    assert {r.doc_id for r in decontaminate.clean(_docs(spark, rows), tests).collect()} == {r[0] for r in rows} - {d for d, _, _ in want}
