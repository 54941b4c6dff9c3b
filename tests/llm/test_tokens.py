import base64
import random

import pytest
import tiktoken

from siltstone.llm import packing, tokenizing

DATA = tokenizing.rank_file()
REFERENCE = tiktoken.Encoding("own", pat_str=tokenizing.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}, special_tokens={})


def test_same_ids_as_the_public_encoder():
    enc, rnd = tokenizing.BacktrackEncoder(DATA), random.Random(2)
    for k in range(1500):
        text = "".join(rnd.choice("aabcdeéüşİ 日本\n\t 🙂0123<|endoftext|>") for _ in range(rnd.randint(0, 120)))
        text = text.replace(" ", "") if k % 2 else text
        assert enc.encode(text) == REFERENCE.encode_ordinary(text)
    for text in ("a" * 50_000, "ab" * 30_000, " " * 10_000, "‍" * 3000):
        assert enc.encode(text) == REFERENCE.encode_ordinary(text)


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_columns(spark, vocabulary):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, " "), (1, "hello world")], "doc_id bigint, text string").withColumnRenamed("x", "ids")
    got = sorted((r.doc_id, r.ids) for r in tokenizing.token_ids(df, vocabulary=vocabulary).collect())
    assert [g[0] for g in got] == [1, 1, 2, 3, 4] and got[2][1] == [] and got[3][1] == [] and len(got[4][1]) == 1
    assert tokenizing.token_ids(df.limit(0)).count() == 0
    ids = tokenizing.token_ids(df.withColumn("ids", df.doc_id), vocabulary=vocabulary)
    assert ids.columns == ["doc_id", "ids"] and ids.schema["ids"].dataType.simpleString() == "array<int>"


def test_containers(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([rnd.randint(1, 300), rnd.randint(1, 2048), 5000])) for i in range(900)] + [(9001, 0), (9002, None), (9003, 2048), (9004, 2049)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").withColumn("share", __import__("pyspark").sql.functions.lit(1))
    for share in (100, 40_000):
        got = packing.pack(df, share_items=share).collect()
        use, parts = {}, {}
        for r in got:
            use[r.container_id] = use.get(r.container_id, 0) + r.n_tokens
            parts.setdefault(r.doc_id, []).append((r.part_no, r.first, r.n_tokens))
        assert max(use.values()) <= 2048 and set(parts) == {i for i, n in rows if n}
        assert all(sum(p[2] for p in parts[i]) == n and len(parts[i]) == -(-n // 2048) for i, n in rows if n)
        if share == 40_000:
            assert len(use) <= 1.02 * sum(use.values()) / 2048 + 2
    assert packing.pack(df.limit(0)).count() == 0


def test_harmonic_classes():
    bins = packing.harmonic_fill([1025] * 4 + [700] * 6 + [500] * 8, 2048)
    assert sorted(i for b in bins for i in b) == list(range(18)) and len(bins) <= 7
