import pytest
from pyspark.sql import functions as F

from driftloom.plans.engine import analyze
from driftloom.sources import captured
from driftloom.sources.directories import changes_between, tree
from driftloom.streaming import review_state

OLD = {
    "store.py": "def get_item(key: int):\n    return DATA[key]\n",
    "use.py": "from store import get_item\n\n\ndef run(key):\n    item = get_item(key)\n    return cfg.get('rate') * item\n",
    "more.py": "from store import get_item\n\nVALUE = get_item(3)\n",
    "late.py": "from store import get_item\nprint(get_item(9))\n",
    "block_a.py": "def long_one(a, b):\n    total = a + b\n    for x in range(10):\n        total += x * a\n    return total\n\n\nkeep = 1\n",
    "block_b.py": "other = 2\n",
    "same.txt": "one\ntwo\n",
    "gone.md": "text\n",
}
NEW = OLD | {
    "store.py": "def fetch_item(key: str):\n    return DATA[key]\n",
    "use.py": 'from store import fetch_item\n\n\ndef run(key):\n    item = fetch_item(key)\n    return settings.rate * item\n',
    "more.py": "from store import fetch_item\n\nVALUE = fetch_item(3)\n",
    "block_a.py": "keep = 1\n",
    "block_b.py": "other = 2\n\n\ndef long_one(a, b):\n    total = a + b\n    for x in range(10):\n        total += x * a\n    return total\n",
    "same.txt": "one\nthree\n",
    "renamed.md": "text\n",
}
del NEW["gone.md"]


@pytest.fixture(scope="module")
def report(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("change")
    for side, files in (("before", OLD), ("after", NEW)):
        (root / side).mkdir()
        for name, text in files.items():
            (root / side / name).write_text(text)
        (root / side / "image.bin").write_bytes(b"\0\1")
    changes = changes_between(tree(spark, f"{root}/before"), tree(spark, f"{root}/after"), "c1")
    twice = changes.unionByName(changes.withColumn("change_set_id", F.lit("c2")))
    assert {(r.path, r.status) for r in changes.collect()} == {(p, "M") for p in OLD if p in NEW} | {("renamed.md", "R")}
    return analyze(twice, min_count=2)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.filter("change_set_id = 'c1'").select(*columns).collect())


def test_groups(report):
    got = {r.label: r for r in report.groups.filter("change_set_id = 'c1'").collect()}
    rename = got["get_item → fetch_item"]
    assert rename.mechanical and rename["count"] == 5 and rename.files == ["more.py", "store.py", "use.py"] and rename.place == 1
    assert {d.detail: d.n for d in rename.details} == {"call": 2, "import": 2, "definition": 1}
    assert got["int → str"].mechanical is False and got["cfg.get('rate') → settings.rate"].kind == "replace"


def test_change_sets_are_apart(report):
    a, b = ([tuple(r)[1:] for r in report.groups.filter(F.col("change_set_id") == c).drop("first").orderBy("place").collect()] for c in ("c1", "c2"))
    assert a == b and len(a) >= 4
    stats = {r.change_set_id: tuple(r)[1:] for r in report.stats.collect()}
    assert stats["c1"] == stats["c2"]


def test_units_hunks_and_files(report):
    units = report.units.filter("change_set_id = 'c1'")
    assert units.filter("explained AND verified AND path = 'more.py'").count() == 3
    lines = report.hunk_lines.filter("change_set_id = 'c1' AND path = 'use.py'").orderBy("hunk_id", "no").collect()
    assert {x.type for x in lines} == {" ", "-", "+"} and all((x.unit is None) == (x.type == " ") for x in lines)
    files = {r.path: r for r in report.files.filter("change_set_id = 'c1'").collect()}
    assert files["renamed.md"].pure_rename and files["same.txt"].additions == 1 and not files["same.txt"].analyzed
    assert files["use.py"].units == 3 and files["use.py"].residual_units == 1 and files["use.py"].category == "source"


def test_moves_and_warnings(report):
    move = report.moves.filter("change_set_id = 'c1'").collect()
    assert [(m.from_path, m.to_path, m.ratio, m.certain) for m in move] == [("block_a.py", "block_b.py", 1.0, True)]
    kinds = rows(report.warnings, "kind", "total", "message")
    assert kinds == [("missed-rename", 2, "get_item was renamed to fetch_item and is no longer defined, but 2 references remain")]


def test_empty_change_set(spark):
    none = spark.createDataFrame([], "change_set_id string, path string, old_path string, status string, old_text string, new_text string")
    got = analyze(none)
    assert got.groups.count() == got.stats.count() == got.warnings.count() == 0


def test_captured_parsers(spark):
    assert captured.name_status(b"M\0a\0R100\0o\0n\0C75\0x\0y\0T\0t\0") == [("M", None, "a"), ("R", "o", "n"), ("A", None, "y"), ("M", None, "t")]
    assert captured.cat_file_batch(b"1 blob 3\nabc\n2:x missing\n3 blob 0\n\n", ["p", "q", "r"]) == {"p": b"abc", "r": b""}
    assert captured.numstat(b"1\t2\ta\0-\t-\tb\x003\t0\t\0old\0new\0") == [(1, 2, None, "a"), (0, 0, None, "b"), (3, 0, "old", "new")]
    sha = "a" * 40
    assert captured.blame_porcelain(f"{sha} 1 1 2\nauthor x\nfilename f.py\n\tone\n{sha} 2 2\n\ttwo\n".encode()) == [(sha, 1, 1, "f.py"), (sha, 2, 2, "f.py")]
    log = spark.createDataFrame([("r", "\x1eabc\x1fme\x1ftitle\n\x1edef\x1fyou\x1fother")], "repo string, raw string")
    assert [tuple(r) for r in captured.log_records(log, "raw", ["sha", "author", "subject"]).collect()] == [("r", 0, "abc", "me", "title\n"), ("r", 1, "def", "you", "other")]
    raw = spark.createDataFrame([("r", bytearray(b"M\0a\0"))], "repo string, raw binary")
    assert [tuple(r) for r in captured.parsed(raw, "raw", lambda b: captured.name_status(bytes(b)), "status string, old string, path string").collect()] == [("r", "M", None, "a")]


EVENTS = [
    ("pr:1", "record", "aaaa", [("f1", "a.py"), ("f2", "b.py")], [], [], 1), ("pr:1", "mark", None, [], ["f1"], [], 2), ("pr:1", "record", "bbbb", [("f2", "b.py"), ("f3", "c.py")], [], [], 3), ("pr:1", "record", "bbbb", [("f2", "b.py"), ("f3", "c.py")], [], [], 4),
    ("worktree:x", "record", None, [("g", "p")], [], [], 5), ("worktree:x", "record", None, [("g", "p")], [], [], 6), ("worktree:x", "record", None, [("h", "p")], [], [], 7),
]
WANT = [("pr:1", 1, None, [], [], []), ("pr:1", 3, "aaaa", ["f3"], ["f1"], []), ("pr:1", 4, "aaaa", ["f3"], ["f1"], []), ("worktree:x", 5, None, [], [], []), ("worktree:x", 6, None, [], [], []), ("worktree:x", 7, "worktree", ["h"], [], [])]
KIND = "identity string, kind string, head string, prints array<struct<fingerprint:string,path:string>>, add array<string>, remove array<string>, seq long"


def test_review_state_in_batch_and_stream(spark, tmp_path):
    events = spark.createDataFrame(EVENTS, KIND)
    plain = lambda rs: sorted((r.identity, r.seq, r.prev_head, list(r.new), list(r.changed), list(r.marks)) for r in rs)
    assert plain(review_state.replay(events).collect()) == WANT
    for part in (events.filter("seq <= 2 OR seq = 5"), events.filter("seq > 2 AND seq <> 5")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = review_state.deltas(stream).writeStream.format("memory").queryName("deltas").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert plain(spark.table("deltas").collect()) == WANT
