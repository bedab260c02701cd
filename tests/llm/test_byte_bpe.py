import random
from hashlib import sha256

import public_tokenizers as P
import pytest
import tiktoken

from driftloom.llm import byte_bpe as b

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.load_ranks(PATH), special_tokens={})


def ids_of(raw):
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


def test_every_code_point_class(oracle):
    bpe = b.ByteBpe(PATH, P.PATTERN)
    for start in range(0, 0x110000, 0x1000):
        text = "".join(chr(c) + " a"[c % 2] for c in range(start, start + 0x1000) if not 0xD800 <= c < 0xE000)
        assert ids_of(bpe.encode(text, 257, 16)) == oracle.encode_ordinary(text), hex(start)


@pytest.mark.parametrize("chunk,overlap", [(7, 3), (20, 8), (64, 2), (5, 1)])
def test_chunks_stitch_anywhere(oracle, chunk, overlap):
    bpe, rnd = b.ByteBpe(PATH, P.PATTERN), random.Random(chunk)
    for _ in range(150):
        text = "".join(rnd.choice(["a", "bc", " ", "  ", "\n", "\n\n ", "1", "23", "'s", "'", "é", "!?", "　", "x" * 30, " " * 25, "日本", "\t"]) for _ in range(rnd.randrange(80)))
        raw = bpe.encode(text, chunk, overlap)
        assert ids_of(raw) == oracle.encode_ordinary(text)
        assert bpe.decode(raw) == text.encode()


def test_documents(spark, oracle):
    texts = {1: "Hello there", 2: "", 3: None, 4: "the end " * 100_000, 5: "x" * 300_000 + "  y", None: "no id", 6: " \n" * 200_000}
    rows = [(k, v, "c", 1, "clash") for k, v in texts.items()] + [(1, "Hello there", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int, raw string")
    got = b.decode(b.encode(docs, PATH, P.PATTERN, 1000, 50, spread_chars=250_000), PATH, P.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        assert ids_of(r.ids) == oracle.encode_ordinary(text)
        assert bytes(r.raw) == text.encode()
    one = next(r for r in b.digest(b.decode(b.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN)).collect() if r.doc_id == 2)
    assert (one.n_tokens, one.ids_sha256, one.decoded_sha256) == (0, sha256(b"").hexdigest(), sha256(b"").hexdigest())


def test_empty_table(spark):
    assert b.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0


def test_one_worker_encodes_and_decodes(spark):
    docs = spark.createDataFrame([(1, "Hello there"), (2, None), (None, "né 日本"), (4, "the end " * 2000)], "doc_id long, text string")
    both = b.encode(docs, PATH, P.PATTERN, 1000, 50, spread_chars=5000, back=True)
    apart = b.decode(b.encode(docs, PATH, P.PATTERN, 1000, 50, spread_chars=5000), PATH, P.PATTERN)
    assert both.columns == apart.columns and sorted(both.collect(), key=repr) == sorted(apart.collect(), key=repr)
    plan = b.digest(b.encode(docs, PATH, P.PATTERN, back=True))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # short texts; chunks of long ones
