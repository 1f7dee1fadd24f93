"""Decontamination: exact verification, recall against all windows, clean documents left alone."""

import random

import pytest

from folium.llm import decontamination as dc


def nearest(item, text):
    """Smallest edit distance of item to a run of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_best_match():
    rng = random.Random(2)
    for _ in range(200):
        item, text = rng.choices("abc", k=rng.randrange(1, 70)), rng.choices("abc", k=rng.randrange(0, 90))
        assert dc.best_match(item, text)[0] == nearest(item, text)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(800)]
    items = [rng.choices(vocab, k=rng.randrange(15, 60)) for _ in range(30)]
    docs = [rng.choices(vocab, k=rng.randrange(0, 200)) for _ in range(40)]
    for n, item in enumerate(items):
        for rate in (0, 0.1, 0.19):
            y = list(item)
            for _ in range(int(rate * len(item))):
                p = rng.randrange(len(y))
                y[p : p + rng.randrange(2)] = rng.choices(vocab, k=rng.randrange(2))
            docs.append(rng.choices(vocab, k=n * 3) + y + rng.choices(vocab, k=n))
        docs.append(item[: int(0.6 * len(item))])
    texts = [" ".join(d) if k % 2 else ", ".join(d).upper() for k, d in enumerate(docs)]
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "?!")]
    bench = [*((k, " ".join(i)) for k, i in enumerate(items)), (100, None), (101, ""), (3, " ".join(items[3]))]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), docs, items


def test_recall_and_precision(tables):
    docs, bench, words, items = tables
    got = {(r.doc_id, r.item_id, r.edits) for r in dc.contaminated(docs, bench, block=8).collect()}
    want = set()
    for d, text in enumerate(words):
        for k, item in enumerate(items):
            e = nearest(item, text)
            if e <= int(0.2 * len(item) + 1e-9):
                want.add((d, k, e))
    assert len(want) >= 90 and got <= want
    assert len(got) >= 0.97 * len(want)
    assert {x for x in want if x[2] <= 2} <= got


def test_places_and_repeated_items(tables):
    docs, bench, words, items = tables
    rows = dc.contaminated(docs, bench).where("item_id = 3 and edits = 0").collect()
    assert len(rows) == 2 * len({r.doc_id for r in rows})  # the item stands twice in the benchmark
    for r in rows:
        assert words[r.doc_id][r.first_word : r.first_word + r.words] == items[3] and r.similarity == 1.0


def test_clean(tables):
    docs, bench, *_ = tables
    dirty = {r.doc_id for r in dc.contaminated(docs, bench).collect()}
    left = {r.doc_id for r in dc.clean(docs, bench).collect()}
    assert left == {r.doc_id for r in docs.collect()} - dirty and {900, 901, 902} <= left


def recall(n, rate, trials, seed=0):
    """The share of items of n words that are found where ``rate`` of their words are edited at random. As a script, this file prints it by length and rate."""
    rng = random.Random(f"{n} {rate} {seed}")
    vocab = [f"v{i}" for i in range(3000)]
    items, texts = [rng.choices(vocab, k=n) for _ in range(trials)], []
    for item in items:
        edited = set(rng.sample(range(n), int(n * rate + 1e-9)))
        y = [w for k, a in enumerate(item) for w in (rng.choice(([], [rng.choice(vocab)], [a, rng.choice(vocab)])) if k in edited else [a])]
        texts.append(rng.choices(vocab, k=40) + y + rng.choices(vocab, k=40))
    walks = dc.Walks([(k, [w.encode() for w in i]) for k, i in enumerate(items)], 0.8, 24, 3)
    got = {(d, i): edits for d, i, edits, *_ in walks.find([" ".join(t) for t in texts])}
    assert all(edits == dc.best_match(items[k], texts[d])[0] for (d, k), edits in got.items())
    return len({k for d, k in got if d == k}) / trials


@pytest.mark.parametrize("n", [1, 3, 5, 8, 10, 15, 30, 58, 120, 250, 400])
def test_recall_by_length(n):
    assert recall(n, 0.2, 100) >= 0.97


def test_blocks_hold_a_number_of_pieces(spark):
    df = spark.createDataFrame([(k, "w " * n) for k, n in enumerate((10, 70, 10, 400, 5))], "item_id long, text string").coalesce(1)
    assert [[k for k, _ in b] for b in dc._blocks(df, 4, 30)] == [[0, 1], [2], [3], [4]]


if __name__ == "__main__":
    for rate in (0.1, 0.15, 0.2):
        print(rate, {n: recall(n, rate, 200) for n in (5, 10, 15, 20, 30, 31, 45, 58, 61, 120, 150, 250, 400)})
