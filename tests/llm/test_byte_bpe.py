import base64
import hashlib
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")

from waxworks.llm import byte_bpe as bb  # noqa: E402

PATH, PATTERN = tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bb.Codec(bb.read_ranks(PATH))


def texts():
    rnd = random.Random(2)
    some = lambda: chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x2000), rnd.randrange(0x4E00, 0x9000), 0x1F600 + rnd.randrange(80), 97, 10, 32]))
    out = ["".join(some() for _ in range(rnd.randrange(60))) for _ in range(400)]
    return out + ["", "a" * 3000, " " * 2000, "ab" * 900, "<|endoftext|>", "it's  we'll\n\n x", "\0\x7f", "of the and the of " * 50]


def test_same_as_the_library(library, codec, monkeypatch):
    given = texts()
    for kept in (bb.KEPT, 50):
        monkeypatch.setattr(bb, "KEPT", kept)
        encoder = bb.Encoder(codec, PATTERN)
        for i in range(0, len(given), 37):
            part = given[i : i + 37]
            got = encoder.encode(part)
            assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in part]
            assert [codec.decode(x).decode() for x in got] == part


def test_perfect_hash(codec):
    whole = codec.whole
    assert sorted(whole.slots.tolist()) == list(range(len(codec.tokens)))
    assert whole.find(codec.tokens).tolist() == list(range(len(codec.tokens)))
    assert (whole.find([b"not a token, surely", b"\xff\xff\xff\xff\xfe"]) == -1).all()


def test_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "x"), (1, None), (1, "twice"), (1, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(
        (k or 0, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for k, t in rows for ids in [library.encode_ordinary(t or "")]
    )
    assert sorted((r[0] or 0, *r[1:]) for r in bb.round_trip(df, PATH, PATTERN).collect()) == want
    clash = df.limit(40).withColumnRenamed("doc_id", "ids")
    back = bb.decode(bb.encode(clash, PATH, PATTERN), PATH)
    assert back.columns == ["text", "decoded"] and all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back.collect())
    assert bb.encode(df.filter("false"), PATH, PATTERN).collect() == []
