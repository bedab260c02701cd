import pytest
from pyspark.sql import functions as F

from driftloom.operators import context, diff, history, links, moves, risk, views, warnings
from driftloom.functions import text as fn
from driftloom.plans.engine import analyze
from driftloom.sources import captured, directories, export
from driftloom.streaming import review_state, scoring

KIND = "change_set_id string, path string, old_path string, status string, old_text string, new_text string"
BODY = "def helper(a, b):\n    total = a + b\n    for x in range(10):\n        total += x * a\n    return total\n"


def change(spark, files):
    return spark.createDataFrame([("c", p, None, "M", o, n) for p, (o, n) in files.items()], KIND)


def moved(spark, files):
    return moves.moves(diff.units(diff.file_diffs(change(spark, files))))


def test_equal_blocks_move_within_their_file_first(spark):
    rest = "".join(f"k{i} = {i}\n" for i in range(12))
    files = {f"m{i}.py": (BODY + "\n\n" + rest, rest + "\n\n" + BODY) for i in range(6)}
    got = moved(spark, files).collect()
    assert len(got) == 6 and all(m.from_path == m.to_path and not m.certain for m in got)


def test_only_whole_definitions_move_for_certain(spark):
    plain = "".join(f"value_{i} = compute(first, {i}, third)\n" for i in range(6))
    assert [m.certain for m in moved(spark, {"x.py": (plain + "\nz = 1\n", "z = 1\n"), "y.py": ("q = 1\n", "q = 1\n\n" + plain)}).collect()] == [False]
    assert [m.certain for m in moved(spark, {"x.py": (BODY + "\nz = 1\n", "z = 1\n"), "y.py": ("q = 1\n", "q = 1\n\n" + BODY)}).collect()] == [True]


@pytest.mark.parametrize("importer,old,new,linked", [("use.py", "from pkg.old_home import helper", "from pkg.new_home import helper", True), ("use.py", "from other.old_home import helper", "from other.new_home import helper", False), ("pkg/use.py", "from .old_home import helper", "from .new_home import helper", True), ("pkg/sub/use.py", "from ..old_home import helper", "from ..new_home import helper", True), ("lib/use.py", "from .old_home import helper", "from .new_home import helper", False)])
def test_imports_follow_a_move_by_module_path(spark, importer, old, new, linked):
    files = {"pkg/old_home.py": (BODY + "\n\nk = 1\n", "k = 1\n"), "pkg/new_home.py": ("z = 1\n", "z = 1\n\n\n" + BODY), importer: (old + "\n", new + "\n")}
    got = analyze(change(spark, files)).signatures.filter(F.col("path") == importer).collect()
    assert [r.kind == "move" for r in got] == [linked]


def test_module_targets(spark):
    rows = [("a.b", "x/y.py", "a/b"), (".b", "x/y.py", "x/b"), ("..b.c", "x/y/z.py", "x/b/c"), ("./m", "s/t.ts", "s/m"), ("../m/n.ts", "s/t/u.ts", "s/m/n"), ("react", "s/t.ts", "react"), (".", "p/q.py", "p")]
    df = spark.createDataFrame(rows, "m string, i string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", links.module_target(F.col("m"), F.col("i"))).collect())
    stems = spark.createDataFrame([("a/b.py", "a/b"), ("a/__init__.py", "a"), ("s/index.ts", "s"), ("x.d.ts", "x")], "p string, want string")
    assert all(r.got == r.want for r in stems.withColumn("got", links.module_stem(F.col("p"))).collect())


def test_builtins_are_never_missed(spark):
    old, new = "def {}(x):\n    return x\n\n\na = {}(1)\nb = {}(2)\n", "def fresh(x):\n    return x\n\n\na = fresh(1)\nb = fresh(2)\n"
    for name, n in (("print", 0), ("load", 1)):
        got = analyze(change(spark, {"a.py": (old.format(name, name, name), new)}), spark.createDataFrame([("c", "b.py", f"{name}(3)\n")], "change_set_id string, path string, text string"))
        assert got.warnings.filter("kind = 'missed-rename'").count() == n


def test_near_misses_of_like_length_alone(spark):
    rows = {f"m{i}.py": ("x = alpha_beta(1)\n", "x = alpha_gamma(1)\n") for i in range(3)} | {"n.py": ("x = alpha_beta(1)\n", "x = alpha_gammas(1)\n"), "o.py": ("x = q(1)\n", "x = r(1)\n")}
    got = analyze(change(spark, rows))
    assert {r.score > 0.9 for r in got.near.collect()} == {True} and got.near.count() == 1
    warned = got.warnings.filter("kind = 'near-miss'").collect()
    assert [(w.total, [x.path for x in w.locations]) for w in warned] == [(1, ["n.py"])]


def test_folders_with_other_bytes(spark, tmp_path):
    for side, files in (("a", {"x.py": b"x = '\xe9'\n", "p.png": b"\x89PNG\0\xff", "t.txt": b"one\n"}), ("b", {"x.py": b"x = '\xe8'\n", "t.txt": b"one\n"})):
        (tmp_path / side).mkdir()
        for name, raw in files.items():
            (tmp_path / side / name).write_bytes(raw)
    got = directories.changes_between(directories.tree(spark, f"{tmp_path}/a"), directories.tree(spark, f"{tmp_path}/b"), "c").collect()
    assert {(r.path, r.status, r.old_text) for r in got} == {("x.py", "M", "x = '\ufffd'\n"), ("t.txt", "M", "one\n")}


def test_review_state_of_several_frames():
    import pandas as pd

    class State:
        exists, value = False, None

        def update(self, value):
            self.value = value

    event = lambda seq, head, prints: {"identity": "i", "kind": "record", "head": head, "prints": [{"fingerprint": p, "path": "p"} for p in prints], "add": [], "remove": [], "seq": seq}
    events = [event(1, "a", ["f"]), event(2, "b", ["f", "g"]), event(3, "c", ["g"])]
    whole = pd.concat(review_state.step(("i",), [pd.DataFrame(events)], State()))
    parts = pd.concat(review_state.step(("i",), [pd.DataFrame(events[2:]), pd.DataFrame(events[:2])], State()))
    assert whole.to_dict("records") == parts.to_dict("records") and whole["prev_head"].tolist() == [None, "a", "b"]


def test_captured_tables(spark):
    status = spark.createDataFrame([("c", "b", "h", "M", None, "m.py"), ("c", "b", "h", "R", "o.py", "n.py"), ("c", "b", "h", "A", None, "a.py"), ("c", "b", "h", "D", None, "d.py"), ("c", "b", "h", "M", None, "bin")], "change_set_id string, base string, head string, status string, old_path string, path string")
    blobs = spark.createDataFrame([("b", "m.py", b"1"), ("h", "m.py", b"2"), ("b", "o.py", b"3"), ("h", "n.py", b"3"), ("h", "a.py", b"4"), ("b", "d.py", b"5"), ("b", "bin", b"\0"), ("h", "bin", b"x")], "sha string, path string, content binary")
    got = {(r.path, r.old_path, r.status, r.old_text, r.new_text) for r in captured.load_changes(status, blobs).collect()}
    assert got == {("m.py", None, "M", "1", "2"), ("n.py", "o.py", "R", "3", "3"), ("a.py", None, "A", "", "4"), ("d.py", None, "D", "5", "")}
    texts = spark.createDataFrame([("a.py", "x = load(1)"), ("b.py", "reload(1)"), ("c.ts", "load()")], "path string, text string")
    assert {r.path for r in captured.grep_files(texts, "load").collect()} == {"a.py", "c.ts"} and captured.grep_files(texts, "load", ["*.py"]).count() == 1
    refs = spark.createDataFrame([("main", "", "1"), ("main", "origin", "2"), ("dev", "upstream", "3"), ("dev", "origin", "4"), ("x", "fork", "5")], "name string, remote string, sha string")
    wanted = spark.createDataFrame([("main",), ("dev",), ("x",)], "ref string")
    assert {r.ref: r.sha for r in captured.resolved_ref(wanted, refs, ["origin", "upstream"]).collect()} == {"main": "1", "dev": "4", "x": None}
    log = spark.createDataFrame([("r", "\x1eabc\x1fme\x1f2024-01-01\x1ftitle\x1f 2 files changed, 3 insertions(+)\n")], "repo string, raw string")
    assert [(r.sha, r.files, r.insertions, r.deletions) for r in captured.commit_rows(log, "raw").collect()] == [("abc", 2, 3, 0)]
    branches = spark.createDataFrame([("r", "b", "2024-01-02"), ("r", "origin/HEAD", "2024-01-03"), ("r", "a", "2024-01-01")], "repo string, name string, date string")
    assert [r.name for r in captured.branch_list(branches, ["repo"]).collect()] == ["b", "a"]
    tree = spark.createDataFrame([("s", "p"), ("t", "q")], "sha string, path string")
    assert [r.path for r in captured.paths_at(tree, "s").collect()] == ["p"]
    paths = spark.createDataFrame([("a/b.py",), ("/etc/x",), ("a/../b",), ("..",), ("C:/x",)], "p string")
    assert [r[0] for r in paths.select(captured.safe_path(F.col("p"))).collect()] == [True, False, False, False, False]


def test_conversation_page():
    page = '{"data": {"repository": {"pullRequest": {"comments": {"nodes": [{"id": "c1", "author": {"login": "me"}, "body": "hi", "createdAt": "t"}], "pageInfo": {"endCursor": "x"}}, "reviewThreads": {"nodes": [{"id": "t1", "path": "a.py", "line": 3, "isResolved": true, "comments": {"nodes": [{"id": "k", "body": "b", "createdAt": "u"}]}}]}}}}}'
    got = captured.conversation(page)
    assert got["next"] == "x" and got["comments"][0]["author"] == "me" and got["threads"][0]["resolved"] and got["threads"][0]["comments"][0]["id"] == "k"
    assert captured.conversation('{"data": {}}') == {"comments": [], "threads": [], "next": None}


def test_review_views(spark):
    rows = [(1, "a", 0.2, False), (2, "a", None, True), (3, "b", 0.9, True), (4, "c", None, False)]
    df = spark.createDataFrame(rows, "n int, path string, risk double, flag boolean")
    assert [r.n for r in views.risk_order(df, "path", "risk", "n").collect()] == [3, 1, 2, 4]
    assert [r.n for r in views.flagged_first(df, "flag", "risk", "n").collect()] == [3, 2]
    assert [r.n for r in risk.by_role(df, "path", ["b", "a"], "risk", "n").collect()] == [3, 1, 2, 4]
    assert [r.path for r in views.collateral_first(df.withColumn("k", F.col("n") % 3), "k", "path", "n").select("path").distinct().collect()] is not None
    assert views.glob_regex("*.md") == r"(^|/)[^/]*\.md(/|$)" and views.glob_regex("docs/**") == "^docs/.*$"
    units = spark.createDataFrame([("u1", "docs/a.md", ["docs"], True, False, False, "f1", "x", ["l"]), ("u2", "src/a.py", ["rename"], False, True, False, "f2", "Needle(", ["m"]), ("u3", "src/b.py", ["rename"], False, False, True, "f3", "y", ["needle"])], "unit_id string, path string, kinds array<string>, explained boolean, near boolean, pure_rename boolean, fingerprint string, text string, labels array<string>")
    ids = lambda **k: {r.unit_id for r in views.review_filter(units, **k).collect()}
    assert ids(hide_docs=True) == {"u2", "u3"} and ids(hide_renames=True) == {"u1", "u2"} and ids(near_only=True) == {"u1", "u2"}
    assert ids(globs=["*.md"]) == {"u2", "u3"} and ids(globs=["src/**"]) == {"u1"} and ids(search="needle") == {"u2", "u3"} and ids(search="needle(", regex=True) == {"u1", "u2", "u3"}
    assert ids(search="needle(") == {"u2"} and ids(search="^src", regex=True) == {"u2", "u3"} and ids(new_only=units.filter("unit_id = 'u3'")) == {"u3"} and ids(explained_by=units.filter("unit_id = 'u3'")) == {"u1", "u2"}
    warned = spark.createDataFrame([(1, []), (2, [("a",)]), (3, [("b",), ("a",)])], "id int, locations array<struct<path:string>>")
    assert {r.id for r in views.shown_warnings(warned, spark.createDataFrame([("a",)], "path string")).collect()} == {1, 3}
    hunks = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", False, False)], "path string, residual boolean, marked boolean")
    assert [r.path for r in views.unreviewed_files(hunks).collect()] == ["b"]
    threads = spark.createDataFrame([("p", "new", 3, "t2", 2), ("p", "new", 3, "t1", 1)], "path string, side string, line int, id string, at int")
    assert [r.threads for r in views.threads_by_line(threads, "at").collect()] == [["t1", "t2"]]
    files = spark.createDataFrame([("a", 2, 0.1, 5), ("b", 1, 0.1, 5), ("c", 2, 0.9, 1)], "path string, l int, share double, lines int")
    assert [r.path for r in views.by_layer(files, F.col("l"), F.col("share"), F.col("lines")).collect()] == ["b", "c", "a"]


def test_small_functions(spark):
    df = spark.createDataFrame([("  name?: string;",), ("export interface A {",), ("title={x}",), ("run();",)], "t string")
    assert [r[0] for r in df.select(fn.line_role(F.col("t"))).collect()] == ["field", "type", "prop", "other"]
    one = spark.createDataFrame([("a/b.py", 3)], "p string, n int")
    assert one.select(fn.editor_path("edit://{path}:{line}", F.col("p"), F.col("n"))).first()[0] == "edit://a/b.py:3"
    assert fn.module_stems("x/index.ts") == ["x/index", "x"] and fn.last_segment("a/b.d.ts") == "b" and fn.normal_path("a/./b/../c") == "a/c"
    from driftloom.functions.align import line_diff

    assert line_diff(["a", "b", "c"], ["a", "x", "c", "d"]) == [("=", 0, 1, 0, 1), ("~", 1, 2, 1, 2), ("=", 2, 3, 2, 3), ("+", 3, 3, 3, 4)]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in export.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")} and export.upsert(None, new, ["k"]).count() == 2
    commits = spark.createDataFrame([("f", 0, "new.py"), ("f", 1, None), ("f", 2, "old.py"), ("f", 3, None)], "file string, ord int, name string")
    assert [r.name for r in history.trail(commits, ["file"]).orderBy("ord").collect()] == ["new.py", "new.py", "old.py", "old.py"]
    shas = spark.createDataFrame([("a",), ("b",)], "sha string")
    assert history.in_range(shas, shas.filter("sha = 'b'")).count() == 1
    lines = spark.createDataFrame([("c", "p", 5), ("c", "p", 50)], "change_set_id string, path string, line int")
    defs = spark.createDataFrame([("c", "p", 1, 60), ("c", "p", 4, 9)], "change_set_id string, path string, first int, last int")
    assert {(r.line, r["first"], r["last"]) for r in context.function_of(lines, defs).collect()} == {(5, 4, 9), (50, 1, 60)}


def test_scores_are_asked_once(spark, tmp_path):
    asked = []

    def evaluate(df):
        asked.append(sorted(r.fingerprint for r in df.collect()))
        return df.select("fingerprint").withColumn("p", F.lit(0.5))

    run = scoring.score_batches(evaluate, f"{tmp_path}/cache", "v1")
    batch = spark.createDataFrame([("f1",), ("f2",), ("f1",)], "fingerprint string")
    run(batch, 0)
    run(batch.unionByName(spark.createDataFrame([("f3",)], "fingerprint string")), 1)
    assert asked == [["f1", "f2"], ["f3"]] and spark.read.parquet(f"{tmp_path}/cache").count() == 3


def test_places_of_a_warning_are_bounded(spark):
    from driftloom.operators import joins

    rows = spark.createDataFrame([("k", i) for i in range(500)] + [("l", 7)], "key string, at int")
    got = {r.key: (r.total, [x["at"] for x in r.locations]) for r in joins.first_places(rows, ["key"], ["at"], 3).collect()}
    assert got == {"k": (500, [0, 1, 2]), "l": (1, [7])}
    assert warnings.LOCATIONS == 50


def test_near_misses_of_all_groups(spark):
    groups = [f"shared_start_of_{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(210)]
    rows = {f"m{k}_{i}.py": (f"x = base_name({k})\n", f"x = {new}({k})\n") for k, new in enumerate(groups) for i in range(2)} | {"n.py": ("x = base_name(999)\n", "x = shared_start_of_zz(999)\n")}
    got = analyze(change(spark, rows))
    near = got.near.collect()
    assert len(near) == 210 and len({r.unit_id for r in near}) == 1 and len({r.group_id for r in near}) == 210
    assert got.warnings.filter("kind = 'near-miss'").count() == 210
