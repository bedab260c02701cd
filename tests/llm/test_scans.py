import random
import re
import unicodedata

import pytest

import corpus_pipeline
from driftloom.llm import decontaminate, license_scan, registry

DOCS = "doc_id long, text string, item_id int, labels string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "clash", "clash") for i, t in rows], DOCS).repartition(2)


LICENSES = [
    (1, "Licensed under CC BY-NC 4.0. cc by!"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "ALL RIGHTS RESERVED all rights reserved"), (4, None), (5, ""),
    (6, "all rights were reserved; cc, by"), (7, "Released under the MIT License."), (8, "all rights all rights reserved"), (9, "words " * 30_000 + "cc by"), (None, "cc by"), (1, "Licensed under CC BY-NC 4.0. cc by!"),
    (10, "éall rights reservedé"), (11, "cc by cc_by"), (12, "the Apache License"),
]


def brute(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    hits = [(s, label) for p, label in license_scan.BASE.items() for s in range(len(words)) if words[s : s + len(p.split())] == p.encode().split()]
    starts = [s for s, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_phrases_equal_brute_force(spark):
    got = license_scan.scan_licenses(table(spark, LICENSES)).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got))) == sorted(repr((i, *brute(t))) for i, t in LICENSES)
    by = {r.doc_id: r for r in got}
    assert by[1].labels == "cc-by,cc-by-nc-4.0" and by[2].labels == "gpl,gpl-3.0" and by[7].labels == "mit" and by[4].labels == ""
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert license_scan.scan_licenses(table(spark, [])).count() == 0


@pytest.mark.parametrize(
    "text,labels",
    [
        ("// SPDX-License-Identifier: MIT", "mit"), ("# SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("This program is made available under the terms of the Eclipse Public License - v 2.0", "epl-2.0"),
        ("Distributed under the Boost Software License, Version 1.0.", "boost-1.0"), ("Released under the ISC License", "isc"), ("we discussed the mit license in class", ""), ("a zlib license and an isc license differ", ""),
        ("Licensed under the Apache License, Version 2.0 (the License);", "apache-2.0"), ("licensed under the GNU Lesser General Public License version 3", "gpl,lgpl,lgpl-3.0"), ("The GNU Affero General Public License version 3", "agpl-3.0,gpl"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of X nor the names of its contributors may be used to endorse or promote products", "bsd,bsd-3-clause"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ],
)
def test_licence_notices(text, labels):
    index = license_scan.RareWordIndex({w: 1.0 + len(w) / 10 for w in license_scan.licence_vocabulary()})
    places, found, score = index.scan(license_scan.words_of(text.encode()))
    assert ",".join(sorted({x for _, x in places} | found)) == labels and 0 <= score <= 1


def test_notices_equal_plain_search(spark):
    """Every alignment that the index finds, and no other, by looking at all places of all templates."""
    rows = [*LICENSES, *((100 + k, f"x {t[1]} y") for k, t in enumerate(license_scan.TEMPLATES[::7]))]
    n, df = license_scan.document_frequencies(table(spark, rows))
    index = license_scan.RareWordIndex({w: __import__("math").log((n + 1) / (k + 1)) for w, k in df.items()})
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(table(spark, rows)).collect() if r.doc_id != 1}
    for i, text in rows:
        words, want = license_scan.words_of((text or "").encode()), set()
        for (label, template, must, base), weights in zip(index.entries, index.weights):
            for s in range(-len(template), len(words)):
                agree = [0 <= s + i < len(words) and words[s + i] == w for i, w in enumerate(template)]
                if all(agree[i] for i in must) and (base or sum(x for x, ok in zip(weights, agree) if ok) / sum(weights) >= 0.5):
                    want.add(label)
        assert i == 1 or got[i] == ",".join(sorted(want))


ITEM = "A farmer sells 12 boxes of ripe apples to Mary at the market for 3 dollars each and then buys 4 more boxes later."
OTHER = ITEM.replace("12", "57").replace("Mary", "Joan").replace("3 dollars", "9 euros").replace(" 4 ", " 8 ")
BENCH = [(1, ITEM), (2, "short one"), (3, "seven words are just enough to match"), (4, None), (None, ITEM), (5, "If a train leaves 5 minutes after 5 o clock then 5 more trains follow it every 5 minutes until night falls on the town.")]
LEAKS = [
    (10, "Intro text here.\n" + ITEM + "\nmore"), (11, "prefix words " + OTHER + " suffix"), (12, ITEM.upper()), (13, "nothing of the kind is said in this document at all, whatever it is"), (14, None), (15, ""),
    (16, " ".join(ITEM.split()[:9])), (17, "they say seven words are just enough to match here"), (10, "Intro text here.\n" + ITEM + "\nmore"), (None, ITEM), (18, "filler " * 20_000 + ITEM),
    (19, "If a train leaves 7 minutes after 7 o clock then 7 more trains follow it every 7 minutes until night falls on the town."),
    (20, "If a train leaves 1 minutes after 2 o clock then 3 more trains follow it every 4 minutes until night falls on the town."), (21, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18"),
]


@pytest.mark.parametrize("bound", [1 << 21, 1])
def test_leaks(spark, bound):
    bench = spark.createDataFrame([(i, t, "c") for i, t in BENCH], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, LEAKS), bench, filter_bound=bound).collect()}
    assert got == {(10, 1), (11, 1), (12, 1), (17, 3), (18, 1), (19, 5)}


def leaks(spark, bench, docs):
    items = spark.createDataFrame(bench, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.covered for r in decontaminate.contaminated(table(spark, docs), items).collect()}


def test_leaks_behind_other_words(spark):
    bench = [(1, "Farmers sell 12 boxes of ripe apples daily"), (2, "Every winter Mary counts 7 birds near the frozen lake at dawn"), (3, "Old ships rest there. Nobody visits them in March")]
    docs = [(1, "we read that " + bench[0][1] + " as before"), (2, "we read that " + bench[1][1].replace("7", "9").replace("Mary", "Joan") + " as before"), (3, "so, Old ships rest there.\nNobody visits them\nin March"), (4, bench[0][1].replace("apples", "pears"))]
    assert leaks(spark, bench, docs) == {(1, 1): 8, (2, 2): 12, (3, 3): 9}


def test_leaks_in_other_case(spark):
    item = "El niño pequeño cayó del árbol más viejo y Ángela corrió hasta la señora del café de aquí en español"
    bench = [(1, item), (2, "Die große Straße führt über die schöne Brücke für Fußgänger nach Süden")]
    docs = [(1, "Antes: " + item.upper()), (2, bench[1][1].upper()), (3, unicodedata.normalize("NFD", item)), (4, item.replace("Ángela", "Óscar")), (5, item.upper()[:30])]
    assert leaks(spark, bench, docs) == {(1, 1): 20, (2, 2): 12, (3, 1): 20, (4, 1): 20}


def test_leaks_of_values_and_short_items(spark):
    bench = [(1, "1 + 2 = 3, 4 + 5 = 9, 6 + 7 = 13, 8 + 9 = 17, 10 + 11 = 21"), (2, "Who wrote Faust?"), (3, "一個農夫在市場上賣了十二箱蘋果給瑪麗"), (4, "??"), (5, "is Paris nice Anna Otto Karl Emil Hugo Paul Fritz Max")]
    docs = [(1, "we add " + bench[0][1] + " here"), (2, "they ask who wrote faust, again"), (3, "昨天,一個農夫在市場上賣了十二箱蘋果給瑪麗。後來"), (4, "who wrote it? Faust"), (5, "1 2 3 4 5 9 6 7"), (6, "so " + bench[4][1] + " then"), (7, "一個農夫在田裡")]
    assert leaks(spark, bench, docs) == {(1, 1): 15, (2, 2): 3, (3, 3): 18, (6, 5): 11}


def test_leaks_of_questions_that_are_nearly_all_numbers(spark):
    """The same question with other numbers is found in nine of ten at least; other questions and rows of numbers aren't."""
    rng = random.Random(8)
    forms = ["Compute {} + {} + {} + {} and then {} + {} + {} + {} equals {}", "What is {} * {} + {} - {} / {} * {} + {} - {} = ?", "Solve for {} {} {} {} {} {} {} or give {} {} {}", "Sort {} {} {} {} then {} {} {} {} {}"]
    fill = lambda form: re.sub(r"\{\}", lambda _: str(rng.randint(2, 9999)), form)
    bench = [(k, fill(forms[k % 4])) for k in range(40)]
    docs = [(100 + k, f"some text stands here, {fill(forms[k % 4])} and goes on") for k in range(40)]
    clean = [(500, " ".join(str(rng.randint(1, 99)) for _ in range(300))), (501, "What is 3 to you? Compute it and then rest."), (502, "Sort the 5 boxes by 7 then by 9 and 4 and 11 and 12")]
    got = leaks(spark, bench, docs + clean)
    # items of one form are one question: a document with it holds them all where its values can stand for theirs
    found = {d for d, i in got if d < 500 and i % 4 == d % 4}
    assert len(found) >= 36 and not [d for d, _ in got if d >= 500] and not [1 for d, i in got if d % 4 != i % 4]


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(table(spark, LEAKS), none).count() == 0
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontaminate.contaminated(table(spark, []), bench).count() == 0


def test_registered_queries():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_pipeline_stages_take_effect(spark, tmp_path):
    rows, labels = [], []
    for i in range(60):
        text = " ".join(f"word{(i * 37 + k * 11) % 9973}" for k in range(60)) + ".\nThe same closing line in every text here."
        rows.append((i, text, "en", "s", len(text)))
    for i in range(60, 100):
        text = " ".join(f"junk{k}%%%" for k in range(i, i + 40))
        rows.append((i, text, "en", "s", len(text)))
    near = rows[20][1].split("\n")[0] + " extra"
    rows += [(200, near, "en", "s", len(near)), (201, "Some words first. " + ITEM, "en", "s", 10)]
    labels = [(i, int(i < 60)) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    good = set(range(60)) | {200, 201}
    assert set(kept[0]) == good
    assert set(kept[1]) == good and all("closing" not in kept[1][i] for i in range(1, 60)) and "closing" in kept[1][0]
    assert set(kept[2]) == good - {200}
    assert set(kept[3]) == good - {200, 201}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == good - {200, 201} and all(r.n_tokens > 0 for r in out)


def test_pipeline_holds_edges(spark, tmp_path):
    docs = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, score string, p string, tag string"
    rows = [(None, None), (1, None), (2, ""), (3, "one"), (3, "one"), (None, "a line of text\nmore"), (4, "a line of text\nother"), (5, "word " * 100_000), (6, "\n\n"), (7, None)]
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, part in (("some", rows), ("none", [])):
        df = spark.createDataFrame([(i, t, None, None, None, "clash", "clash", "clash", "clash") for i, t in part], docs)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, str(tmp_path))
            assert df.columns == [c.split()[0] for c in docs.split(", ")]
            got = df.collect()
            assert all(r.n_lines == r.score == r.p == r.tag == "clash" for r in got)
        out = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).collect()
        assert len(out) == len(got) == len(part)
