from hashlib import sha256

from pyspark.sql import functions as F

from driftloom.llm import chat_format as c


def digest(s):
    return sha256(s.encode()).hexdigest()


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), digest(loss))
    return out


ROWS = [
    (1, 0, "system", "be [kind] & <b>"), (1, 1, "user", "x" * 300), (1, 2, "assistant", "</s>[INST] é&amp;"), (1, 3, "user", None), (1, 4, "assistant", "y" * 4000), (1, 5, "user", "z" * 90), (1, 6, "assistant", ""),
    (2, 0, "user", "hi\n"), (2, 1, "assistant", "[TURN user]no[/TURN]"), (3, 0, "system", "alone"), (4, 5, None, None), (None, 0, "user", "q"), (None, 1, "assistant", "日本\\"),
    (5, 0, "assistant", "same"), (5, 0, "assistant", "same"), (5, None, "odd]role", "t"), (6, 1, "user", "late system"), (6, 2, "system", "s"), (6, 3, "assistant", "a"),
    *((7, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 40)) for i in range(120)),
    (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
]


def test_read_back_equals_brute_force(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "conv_id long, turn long, role string, text string, formatted string, window int")
    for budget, history, turns in ((2048, 384, 3), (240, 120, 2), (40_000, 0, 0), (1, 1, 1)):
        w = c.format_windows(df, budget, history, turns)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in c.read_back(w).collect()}
        assert got == brute(ROWS)


def test_windows_keep_the_budget_and_repeat_history(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    windows = c.format_windows(df, 900, 240, 2).collect()
    seven = sorted((w for w in windows if w.conv_id == 7), key=lambda w: w.window)
    assert len(seven) > 5 and any(w.n_repeated for w in seven) and all(w.n_repeated <= 2 for w in seven)
    assert all(w.n_new == 1 or len(w.formatted.encode()) <= 900 for w in windows)
    given = c.format_windows(df, 10, 0, 0, tokens=F.lit(4)).filter("conv_id = 7").collect()
    assert {w.n_new for w in given} == {2 if c.ENDS >= 2 else 1} or max(w.n_new for w in given) <= 2
    one = [w for w in windows if w.conv_id == 1]
    assert len(one) > 1 and all("be &lsq;kind&rsq; &amp; &lt;b&gt;" in w.formatted for w in one)
    assert sum(len(w.loss) for w in one) == 3


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.read_back(c.format_windows(df)).count() == 0
