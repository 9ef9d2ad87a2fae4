import hashlib
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from sparloom.llm import cross_split as X

SCHEMA = "item_no long, side string, split string, source string, task_key string, hash_key string, statement string"
WORDS = [f"w{i}" for i in range(400)]


def statement(rng, n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def pairs(spark, rows, stage):
    return sorted(tuple(r) for r in X.overlaps(spark.createDataFrame(rows, SCHEMA), stage).collect())


def test_keys_layout_and_edits(spark, stage):
    rng = random.Random(2)
    base = statement(rng)
    words = base.split()
    edited = words[:]
    for i in range(0, 60, 7):
        edited[i] = "new"
    shuffled = words[:]
    rng.shuffle(shuffled)
    rows = [
        (1, "train", "train", "a", "t1", "h1", base), (2, "train", "train", "a", None, None, None), (3, "train", "train", "a", "t1", None, "[removed]"),
        (10, "eval", "val", "b", "x", "h1", "other text"), (11, "eval", "test", None, "t1", None, None), (12, "eval", None, "b", None, None, "**" + base.upper().replace(" ", "\n\n") + "**"),
        (13, "eval", "test", "b", None, None, " ".join(edited)), (14, "eval", "test", "b", None, None, " ".join(shuffled)), (15, "eval", "test", "b", None, None, "[removed]"),
        (16, "eval", "test", "b", None, None, " ".join(words[:30])), (13, "eval", "test", "b", None, None, " ".join(edited)),
    ]
    assert pairs(spark, rows, stage) == [(1, 10), (1, 11), (1, 12), (1, 13), (3, 11)]
    counted = {(r["split"], r["source"]): r["n_pairs"] for r in X.counts(X.overlaps(spark.createDataFrame(rows[:-1], SCHEMA), stage), spark.createDataFrame(rows[:-1], SCHEMA)).collect()}
    assert counted == {("val", "b"): 1, ("test", None): 2, (None, "b"): 1, ("test", "b"): 1}
    assert pairs(spark, [r for r in rows if r[1] == "train"], stage) == []
    df = spark.createDataFrame([("",), ("None",), (" ",), (None,), ("a",)], "c string")
    assert [r[0] for r in df.select(X.id_key(F.col("c"))).collect()] == [None, None, None, None, "a"]


def test_against_brute_force_with_hot_chunks(spark, stage):
    rng = random.Random(5)
    shared = " ".join(WORDS[:25])  # every statement starts alike
    rows = []
    for i in range(120):
        text = shared + " " + statement(rng, 40)
        rows.append((i, "train", "train", "s", None, None, text))
        words = text.split()
        for k in range(rng.choice([0, 3, 9, 16, 40])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((1000 + i, "eval", "test", "s", None, None, " ".join(words)))
    expected = sorted(
        (a[0], b[0]) for a in rows if a[1] == "train" for b in rows if b[1] == "eval" and X.same_statement(X.words_of(a[6]), X.words_of(b[6]))
    )
    assert 60 < len(expected) < 200
    assert pairs(spark, rows, stage) == expected


def brute_force(rows):
    words = {r[0]: X.words_of(r[6]) for r in rows}
    return sorted((a[0], b[0]) for a in rows if a[1] == "train" for b in rows if b[1] == "eval" and X.same_statement(words[a[0]], words[b[0]]))


def test_hot_group_of_edited_copies(spark, stage, monkeypatch):
    rng = random.Random(8)
    base = statement(rng, 115).split()
    rows = []
    for i in range(100):
        words = base[:]
        for at in rng.sample(range(115), rng.randrange(10, 24)):  # no long run of words stays whole
            words[at] = f"edit{rng.randrange(10**6)}"
        rows.append((i, "train" if i < 60 else "eval", "s", "s", None, None, " ".join(words)))
    expected = brute_force(rows)
    assert 500 < len(expected) < 2400
    assert pairs(spark, rows, stage) == expected
    monkeypatch.setattr(X, "BLOCK", 16)  # several blocks of either side
    monkeypatch.setattr(X, "COMMON", 20)
    assert pairs(spark, rows, stage) == expected


def test_every_fourth_word_edited_and_lengths(spark, stage):
    rng = random.Random(9)
    rows = []
    for i in range(40):
        n = rng.choice([8, 9, 11, 20, 50])
        words = [rng.choice(WORDS[:30]) for _ in range(n)]
        rows.append((i, "train", "s", "s", None, None, " ".join(words)))
        for at in range(0, n, 4):
            words[at] = "new"
        words += ["more"] * rng.randrange(3)
        rows.append((100 + i, "eval", "s", "s", None, None, " ".join(words)))
    expected = brute_force(rows)
    assert len(expected) > 10
    assert pairs(spark, rows, stage) == expected


@pytest.mark.parametrize("k", [8, 9, 20])
def test_variants_of_one_short_statement_all_meet(spark, stage, k):
    rows = [(i + (0 if i < k else 1000), "train" if i < k else "eval", "s", "s", None, None, f"print the sum of all even numbers below v{i}") for i in range(2 * k)]
    assert len(pairs(spark, rows, stage)) == k * k


def test_recall_on_random_clusters(spark, stage):
    """Clusters of 8 to 60 words, many of them alike in their words, against brute force."""
    rng = random.Random(17)
    rows = []
    for c in range(60):
        base = [rng.choice(WORDS[:120]) for _ in range(rng.randrange(8, 61))]
        for i in range(8):
            words = base[:]
            for _ in range(rng.randrange(0, max(1, len(words) // 5) + 1)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((c * 8 + i + (0 if i < 4 else 10_000), "train" if i < 4 else "eval", "s", "s", None, None, " ".join(words)))
    expected, got = set(brute_force(rows)), set(pairs(spark, rows, stage))
    assert got <= expected and len(expected) > 700
    assert len(got) / len(expected) > 0.99


@pytest.mark.parametrize("n", [200, 800])
def test_a_common_preamble_makes_few_candidates(spark, stage, n):
    rng = random.Random(n)
    preamble = " ".join(WORDS[:30])
    rows = [(i, "train" if i % 2 else "eval", preamble + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(40)), 70) for i in range(n)]
    classes = spark.createDataFrame([(s, hashlib.md5(w.encode()).hexdigest(), k, w) for _, s, w, k in rows], "side string, cls string, n_words int, words string")
    chunked = stage(classes.mapInPandas(X._chunked, X.CHUNK_SCHEMA), "chunks")
    assert X.candidates(chunked, stage).count() <= 2 * n


def test_short_statements_and_scripts_without_blanks(spark, stage):
    chinese = "给定一个整数数组请计算其中所有偶数的和并输出结果"
    rows = [
        (1, "train", "s", "s", None, None, "Reverse a list."), (2, "train", "s", "s", None, None, chinese), (3, "train", "s", "s", None, None, "[statement removed]"), (4, "train", "s", "s", None, None, "..."),
        (11, "eval", "s", "s", None, None, "reverse **a** list"), (12, "eval", "s", "s", None, None, chinese.replace("偶", "奇")), (13, "eval", "s", "s", None, None, "Statement removed"),
        (14, "eval", "s", "s", None, None, "..."), (15, "eval", "s", "s", None, None, "Sort a list."), (16, "eval", "s", "s", None, None, chinese[::-1]),
    ]
    assert pairs(spark, rows, stage) == [(1, 11), (2, 12)]


def test_repeated_rows_make_their_own_pairs(spark, stage):
    text = statement(random.Random(1))
    rows = [(i, "train", "train", "s", "hot", "h", text) for i in range(40)] + [(100 + i, "eval", "test", "s", "hot", "h", text) for i in range(30)]
    assert len(pairs(spark, rows, stage)) == 1200


@pytest.mark.parametrize("block", [7, 1 << 19])
def test_statements_of_few_templates_in_lanes(spark, stage, monkeypatch, block):
    """Hot chunks are compared in lanes, not joined, and no pair is lost; short and long statements beside them."""
    rng = random.Random(21)
    templates = [[rng.choice(WORDS) for _ in range(10)] for _ in range(12)]
    rows = []
    for i in range(90):
        words = [w for t in rng.sample(templates, 1 if i % 9 == 0 else 8) for w in t]
        if i % 10 == 5:
            words = [w for _ in range(3) for t in templates for w in t][: rng.randrange(180, 340)]
        for at in rng.sample(range(len(words)), len(words) // 6):
            words[at] = f"slot{rng.randrange(50)}"
        rows.append((i, "train", "s", "s", None, None, " ".join(words)))
        for k in rng.sample(range(len(words)), rng.randrange(0, len(words) // 4)):
            words[k] = "edited"
        rows.append((1000 + i, "eval", "s", "s", None, None, " ".join(words)))
    expected = brute_force(rows)
    assert len(expected) > 60
    assert pairs(spark, rows, stage) == expected
    met = []
    hot_candidates = X.hot_candidates

    def noted(rows):
        out = hot_candidates(rows)
        met.append((X.meetings(rows, "keys"), X.meetings(rows, "hot_keys"), out is not None))
        return out

    for name, value in (("HOT_PAIRS", 30), ("LANE", block), ("LEAST_BLOCK", 16), ("LANES_PER_MEETING", 1e9), ("hot_candidates", noted)):
        monkeypatch.setattr(X, name, value)
    assert pairs(spark, rows, stage) == expected
    assert met[0][2] and met[0][1] > met[0][0]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_at_least(n):
    rng = np.random.default_rng(n)
    bits = rng.integers(0, 2, (n, 128)).astype(np.uint8)
    lanes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    for least in range(1, n + 2):
        got = np.unpackbits(X.at_least(lanes, least).view(np.uint8), bitorder="little")
        assert (got == (bits.sum(axis=0) >= least)).all()


def test_lcs():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(1, 12))] for _ in "12")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert X.lcs_length(a, b) == table[-1][-1]
