"""Posting index, palette, JSON flattening, stream decoding and the snapshot source."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from driftloom.functions import variants
from driftloom.operators import concepts, palette, postings
from driftloom.operators.views import fuzzy_score
from driftloom.sources import snapshots
from driftloom.streaming import decoders


def scan(files, word):
    out = []
    for path, text in files.items():
        for n, line in enumerate((text or "").split("\n"), 1):
            out += [(path, n, k) for k, w in enumerate(re.findall(postings.WORD, line), 1) if w == word]
    return sorted(out)


def test_index_build_update_delete_compact(spark, tmp_path):
    rng = random.Random(1)
    line = lambda: " ".join(rng.choice(["foo", "bar", "Foo", "foo.bar", "x1", "()", "$y"]) for _ in range(6))
    files = {f"p{k}": "\n".join(line() for _ in range(4)) for k in range(20)} | {"empty": "", "null": None}
    frame = lambda d: spark.createDataFrame([*d.items()], "path string, text string")
    index = postings.Index(spark, buckets=4, where=f"file://{tmp_path}/i").update(frame(files))
    changed = {"p1": "foo new", "p2": None, "fresh": "foo foo\nbar foo"}
    index.update(frame(changed)).delete(spark.createDataFrame([("p3",), ("p4",), ("none",)], "path string"))
    now = {p: t for p, t in (files | changed).items() if p not in ("p3", "p4")}
    asked = spark.createDataFrame([("foo",), ("bar",), ("foo",), (None,), ("absent",), ("$y",)], "word string")
    for _ in range(2):
        got = sorted((r.word, r.path, p.line, p.nth) for r in index.lookup(asked).collect() for p in r.places)
        assert got == sorted((w, *x) for w in ("foo", "bar", "$y") for x in scan(now, w))
        phrases = spark.createDataFrame([("a", ["foo", "foo"]), ("b", ["foo", "bar", "x1"]), ("c", ["new"])], "phrase string, words array<string>")
        want = []
        for name, words in (("a", ["foo", "foo"]), ("b", ["foo", "bar", "x1"]), ("c", ["new"])):
            for p, n, k in scan(now, words[0]):
                if all((p, n, k + j) in scan(now, w) for j, w in enumerate(words)):
                    want.append((name, p, n, k))
        assert sorted((r.phrase, r.path, r.line, r.nth) for r in index.phrases(phrases).collect()) == sorted(want)
        index.compact()
    first = postings.first_lines(index.lookup(asked), 2).collect()
    assert {r.word: r.total for r in first} == {w: len(scan(now, w)) for w in ("foo", "bar", "$y")} and all(len(r.locations) <= 2 for r in first)
    index.drop()


def test_lookup_doesnt_shuffle_the_index(spark, tmp_path):
    index = postings.Index(spark, buckets=4, where=f"file://{tmp_path}/i").update(spark.createDataFrame([("p", "a b c")], "path string, text string"))
    found = spark.table(index.name).hint("merge").join(spark.createDataFrame([("a",)], "word string"), "word")
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan_side = plan[: plan.index("FileScan")].splitlines()
    indent = len(plan.splitlines()[len(scan_side) - 1]) - len(plan.splitlines()[len(scan_side) - 1].lstrip(" :+-"))
    above = [x for x in scan_side[:-1] if len(x) - len(x.lstrip(" :+-")) < indent]
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and not any("Exchange" in x for x in above)
    index.drop()


def test_best_titles_against_scoring_all(spark):
    rng = random.Random(2)
    titles = [(k, " ".join(rng.choice(["open", "Old", "file:", "src/foo.py", "go", "x", "é"]) for _ in range(rng.randint(1, 5)))) for k in range(300)] + [(900, None), (901, "")]
    queries = ["of", "o f", "sf", "gopen", "é", "zz", ":s", "/f", "", "  ", None]
    got = palette.best_titles(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame(titles, "id int, title string"), 20).collect()
    want = []
    for q in queries:
        chars = (q or "").replace(" ", "")
        scored = sorted((-s, t, k) for k, t in titles if chars and t is not None and (s := plain(chars, t)) is not None)
        want += [(q, k, n, round(-s, 6)) for n, (s, _, k) in enumerate(scored[:20], 1)]
    assert sorted((r.query, r.id, r.place, round(r.score, 6)) for r in got) == sorted(want) and want


def plain(query, text):
    q, t, at, prev, score = query.lower(), text.lower(), 0, -2, 0
    for c in q:
        i = t.find(c, at)
        if i < 0:
            return None
        score += 1 + (2 if i == prev + 1 else 0) + (3 if i == 0 or re.match("[^a-z0-9]", t[i - 1]) else 0)
        prev, at = i, i + 1
    return score - len(t) / 100


def test_palette_score_agrees_with_the_small_helper():
    assert plain("of", "open file") == fuzzy_score("of", "open file")


@pytest.mark.parametrize("text,want", [
    ('{"a":{"b":1,"c":[true,{"d":null}]},"e":"x"}', {"a.b": "1", "a.c.0": "true", "a.c.1.d": "null", "e": '"x"'}),
    ('{"a":', {}), ("", {}), (None, {}), ("5", {}), ("{}", {}), ('{"a":{},"b":[]}', {}), ('{"a.b":{"é":2.5}}', {"a.b.é": "2.5"}),
])
def test_flattened_json(spark, text, want):
    got = variants.flattened(spark.createDataFrame([(1, text)], "id int, j string"), ["id"], "j")
    assert {r.key: r.value for r in got.collect()} == want


def test_plural_forms(spark):
    keys = ["item_one", "item_other", "n_ordinal_two", "done", "one", "x_ones"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select(variants.plural_base(F.col("k")).alias("b")).collect()
    assert [r.b for r in got] == ["item", "item", "n", "done", "one", "x_ones"]


def pieces(text, size):
    data = text.encode()
    return [data[k : k + size] for k in range(0, len(data), size)]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_streams_cut_anywhere(spark, size):
    decoders.register(spark)
    lines = ["é 1\r", "", "twö", "last"]
    events = "event: delta\ndata: a\ndata: é\n\n: comment\ndata: alone\n\nevent: none\n\ndata: unfinished"
    for kind, text, want in (("lines", "\n".join(lines), [(1, "", "é 1"), (2, "", ""), (3, "", "twö"), (4, "", "last")]), ("sse", events, [(1, "delta", "a\né"), (2, "message", "alone")])):
        rows = [(s, k, b) for s in ("x", "y") for k, b in enumerate(pieces(text, size))]
        random.Random(3).shuffle(rows)
        spark.createDataFrame(rows, "s string, k int, b binary").createOrReplaceTempView("cut")
        got = spark.sql(f"SELECT * FROM stream_records(TABLE(cut) PARTITION BY (s) ORDER BY (k), '{kind}')").collect()
        assert sorted((r.stream, r.n, r.event, r.data) for r in got) == sorted((s, *w) for s in ("x", "y") for w in want)


def test_snapshot_source_opens_matching_batches_alone(spark, tmp_path):
    rows = [(f"r{k % 3}", f"dir{k % 5}/f{k:03}", None if k == 7 else f"text {k}") for k in range(150)] + [(None, "p", "x"), ("r1", None, "x")]
    where = snapshots.written(spark.createDataFrame(rows, "revision string, path string, text string"), f"{tmp_path}/s", rows=10)
    want = {r for r in rows if None not in r[:2]}
    df = snapshots.read(spark, where)
    assert {tuple(r) for r in df.collect()} == want
    few = df.filter("revision = 'r1' AND path LIKE 'dir2/%'")
    assert {tuple(r) for r in few.collect()} == {r for r in want if r[0] == "r1" and r[1].startswith("dir2/")}
    lines = [json.loads(x) for p in (tmp_path / "s").glob("manifest-*") for x in p.read_text().splitlines()]
    reader = snapshots.Reader(where)
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    list(reader.pushFilters([EqualTo(("revision",), "r1"), StringStartsWith(("path",), "dir2/")]))
    opened = {p.name for p in reader.partitions()}
    hold = {x["name"] for x in lines if x["revision"] == "r1" and x["first"][:5] <= "dir2/" <= x["last"][:5]}
    assert opened == hold and len(opened) < len(lines) / 3
    assert few.rdd.getNumPartitions() == len(opened)
    assert df.filter("revision = 'none'").count() == 0


def test_patterns_merge_groups_that_differ_in_literals(spark):
    rows = [("c", "g1", 'log("a")\x00user', 'log "a" → user', "x", "userName", 3, True, 2), ("c", "g2", 'log("b")\x00user', 'log "b" → user', None, "", 4, True, 1), ("c", "g3", "n 12 users", "n 12", "users", "", 7, True, 3), ("c", "g4", "user", "user", "", "", 9, False, 0), ("d", "g5", "user", "user", "", "", 1, True, 0)]
    groups = spark.createDataFrame(rows, "change_set_id string, group_id string, key string, label string, old string, new string, count long, mechanical boolean, place int")
    got = concepts.patterns(groups, spark.createDataFrame([("c", "user"), ("c", "user"), ("c", "none")], "change_set_id string, stem string")).collect()
    assert sorted((r.pattern, r.label, r.group_ids, r.units, r.place) for r in got) == [("log(<str>)\x00user", "log <str> → user", ["g2", "g1"], 7, 1), ("n <num> users", "n <num>", ["g3"], 7, 2)]
