"""Near duplicates against all pairs of sets."""

import random

import numpy as np
import pytest

from folium.llm import minhash


def shingles(text: str | None) -> set:
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def components(sets: list[set], least: int = 85) -> list[int]:
    at = list(range(len(sets)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= least * len(a | sets[j]):
                x, y = find(i), find(j)
                at[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocab = [f"W{i}" for i in range(2000)]
    base, out = rng.choices(vocab, k=100), []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        out.append(" ".join(words[: rng.randrange(20, 100)] if i % 5 == 0 else words))
    return [*out, " ".join(rng.choices(vocab, k=50)), out[0].lower(), "", " \t\n", "one two", "ONE\vtwo", "one two three four five six seven eight", out[3] + "\r\n"]


@pytest.mark.parametrize("most, posting", [(1024, 256), (16, 256), (16, 8), (16, 0)])
def test_brute_force(spark, texts, most, posting):
    sets = [shingles(t) for t in texts]
    want = [(len(s), c, i == c) for i, (s, c) in enumerate(zip(sets, components(sets)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, most=most, posting=posting).collect()}
    assert got == dict(enumerate(want))


@pytest.mark.parametrize("posting", [256, 4, 0])
def test_small_clusters_of_a_large_group(spark, posting):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(2000)]
    base, texts = rng.choices(vocab, k=200), []
    for size in (60, 2, 2, 2, 2, 3, 3):  # all meet in tables; 14 classes are outside the largest cluster
        words = list(base)
        for k in rng.sample(range(5, 195, 10), 5 if size < 60 else 0):  # each takes five shingles of 196
            words[k] = rng.choice(vocab)
        texts += [" ".join([*words[:-1], f"end{len(texts)}x{c}"]) for c in range(size)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, most=16, posting=posting).collect()}
    want = components([shingles(t) for t in texts])
    assert len(set(want)) == 7 and got == dict(enumerate(want))


@pytest.mark.parametrize("least", [80, 85])
def test_prefixes_of_similar_sets_meet(least):
    rng = random.Random(least)
    seen = np.array([rng.randrange(5) for _ in range(1 << minhash.BITS)])
    for _ in range(300):
        n = rng.randrange(1, 60)
        one = np.unique(np.array([rng.randrange(1 << 64) for _ in range(n)], np.uint64))
        two = np.unique(np.append(one[: rng.randrange(n // 2, n + 1)], np.array([rng.randrange(1 << 64) for _ in range(rng.randrange(8))], np.uint64)))
        both = len(np.intersect1d(one, two))
        if len(two) and 100 * both >= least * (len(one) + len(two) - both):
            assert np.intersect1d(minhash.prefix_of(one, least, seen), minhash.prefix_of(two, least, seen)).size


def test_chain_of_a_large_group(spark):
    """Each text is near its neighbours alone, so no component is main; all are one in the end."""
    rng = random.Random(12)
    words = [f"w{i}" for i in rng.sample(range(5000), 700)]
    texts = [" ".join(words[4 * i : 4 * i + 160]) for i in range(120)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = components([shingles(t) for t in texts])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, most=16).collect()}
    assert set(want) == {0} and got == dict(enumerate(want))


def test_one_of_each(spark):
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2
    rows = [(2, long, "x"), (1, long + "end", "y"), (1, long + "end", "y"), (None, long, "z"), (5, None, "u"), (6, "", "v"), (7, "other words stand here now", "w"), (None, "no key but this text alone", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _folium_x string")
    got = sorted(((r.doc_id, r._folium_x) for r in minhash.one_of_each(df, least=80).collect()), key=str)
    assert got == sorted([(1, "y"), (5, "u"), (6, "v"), (7, "w"), (None, "k")], key=str)


def test_tables_miss_few_pairs():
    p = 0.85**4
    side = (1 - p) ** 18
    assert 1 - (1 - side) ** 2 < 1e-5
