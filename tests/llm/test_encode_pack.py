import base64
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from sparloom.llm import encode as E, packing as P

PATH = f"{E.TOKENIZER_DIR}/{E.VOCABULARY}"


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=E.load_ranks(PATH), special_tokens={})


def test_ids(spark, reference):
    texts = ["Hello world", "", None, "  \n\t x", "<|endoftext|>", "naïve 漢字 🙂🙃", "a" * 5000, " " * 5000 + "x", "def f(x):\n    return x\r\n", "Hello world"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in E.encode_documents(df).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert E.encode_documents(df.limit(0)).count() == 0


def test_round_trip_and_reference(reference):
    own = E.Encoder(PATH)
    bytes_of = {v: k for k, v in E.load_ranks(PATH).items()}
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice("ab\n\t  'sé漢🙂…​12,.!don't<|") for _ in range(rng.randint(0, 50)))
        ids = own.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert b"".join(bytes_of[i] for i in ids).decode() == text


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_segment_tree_merges_like_the_plain_rule(word):
    ranks = E.load_ranks(PATH)
    parts = [word[i:i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], E.NO_RANK), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    assert E.merge_word(word, ranks) == [ranks[p] for p in parts]
    assert base64.b64encode(word)


def test_hilbert_neighbours_are_one_step_apart():
    side = 8
    points = sorted(((P.hilbert_key([x, y, z], 3), (x, y, z)) for x in range(side) for y in range(side) for z in range(side)))
    assert [k for k, _ in points] == list(range(side ** 3))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for (_, p), (_, q) in zip(points, points[1:]))


def test_containers(spark):
    texts = [None, "", "one two", "x y z " * 3000] + [f"word{i % 7} " * (5 + i % 300) for i in range(600)] + ["same text"] * 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = P.measured(df).cache()
    sizes = {r["doc_id"]: r["size"] for r in items.collect()}
    rows = P.pack(items, rows_per_partition=200).collect()
    used, parts = defaultdict(int), defaultdict(list)
    for r in rows:
        used[r["container_id"]] += r["n_tokens"]
        parts[r["doc_id"]].append((r["part"], r["start_token"], r["n_tokens"]))
    assert max(used.values()) <= P.CAPACITY
    assert set(parts) == set(sizes)
    for doc, found in parts.items():
        found.sort()
        assert sum(n for *_, n in found) == sizes[doc]
        assert [s for _, s, _ in found] == [i * P.CAPACITY for i in range(len(found))]
        assert len(found) == max(1, -(-sizes[doc] // P.CAPACITY))
    assert sum(used.values()) / (len(used) * P.CAPACITY) > 0.9
    assert P.fill_report(P.pack(items.limit(0))).first()["n_containers"] == 0
