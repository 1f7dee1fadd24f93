"""License scans against plain loops over words."""

import math
import random
import re
from collections import Counter

import pytest

from folium.llm import licenses as lic


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    words = words_of(text)
    return len(words), sorted((i, label) for label, p in lic.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        n, places = base(texts[r.doc_id])
        labels = ",".join(sorted({label for _, label in places}))
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), labels)
        assert (r.first_word, r.last_word) == ((min(at), max(at)) if at else (None, None))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        assert set(filter(None, labels.split(","))) <= set(r.labels.split(","))
        assert r.labels.split(",") == sorted(set(r.labels.split(",")))


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = lic.op1_rare_token_index(spark, sf).collect()
    check(rows, texts)
    assert any(r.n_base for r in rows)


def test_templates(spark, tmp_path):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    texts = {
        1: f"Hello. {mit}, and so on", 2: mit.replace("without restriction", "with restrictions"), 3: "MIT License mit license\nMIT-LICENSE; gnu general public license version 3",
        4: "é mit licensé", 5: None, 6: "", 7: "mit  \x00 license", 8: "Licensed under the Apache License, Version 2.0 (the License)", 9: "restriction without software free permission " * 500,
    }
    spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, k string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in lic.op1_rare_token_index(spark, str(tmp_path)).collect()}
    check(list(rows.values()), texts)
    labels = {k: r.labels for k, r in rows.items()}
    assert labels == {1: "mit-grant", 2: "", 3: "gpl,gpl-3.0,mit", 4: "", 5: "", 6: "", 7: "mit", 8: "apache,apache-2.0", 9: ""}
    assert rows[1].score == 1.0 and rows[3].score == 6 / 9 and rows[7].score == 0.5


def slow_scan(texts, templates, anchors=6, agree=2, slack=3):
    """Every template at every place of every text, with the anchors that document frequencies give."""
    words = {k: words_of(t) for k, t in texts.items()}
    rarity = lambda w: -math.log((len(texts) + 1) / (sum(w in ws for ws in words.values()) + 1))
    out = {k: [] for k in texts}
    for t in templates:
        mine, keys = words_of(t.text), [words_of(x) for x in t.keys]
        rare = sorted(dict.fromkeys(mine), key=lambda w: (rarity(w), mine.index(w)))[:anchors]
        wide = max(slack, len(mine) // 12)
        start = [" ".join(mine).split(" ".join(x))[0].count(" ") for x in keys]
        for k, ws in words.items():
            good = []
            for at in range(-len(mine), len(ws)):
                hit = {w for p, w in enumerate(mine) if w in rare and 0 <= at + p < len(ws) and ws[at + p] == w}
                stand = lambda x, p: any(ws[i : i + len(x)] == x for i in range(max(0, at + p - wide), max(0, at + p + wide + 1)))  # noqa: B023, E731
                if len(hit) >= min(agree, len(rare)) and all(stand(x, p) for x, p in zip(keys, start)):
                    near = Counter(ws[max(0, at - wide) : max(0, at + len(mine) + wide)])
                    good.append((-sum(min(n, near[w]) for w, n in Counter(mine).items()) / len(mine), at))
            taken = []
            for share, at in sorted(good):
                if all(abs(at - x) >= len(mine) for x in taken):
                    taken.append(at)
                    out[k].append((t.label, max(0, at), len(mine), round(-share, 9)))
    return {k: sorted(set(v)) for k, v in out.items()}


def mangled(rng, text):
    words = text.split()
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(words))
        words[at : at + rng.randrange(2)] = rng.choices(["author", "license", "MIT", "the", "x"], k=rng.randrange(3))
    return " ".join(words)


def test_brute_force(spark):
    rng = random.Random(4)
    parts = [t.text for t in lic.TEMPLATES] + [k for t in lic.TEMPLATES for k in t.keys]
    texts = {}
    for k in range(150):
        some = [mangled(rng, rng.choice(parts)) if rng.random() < 0.6 else " ".join(rng.choices("the software license of granted public version copy 2 0 and in".split(), k=20)) for _ in range(rng.randrange(4))]
        texts[k] = "\n".join(some)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: sorted((s.label, s.word, s.words, round(s.share, 9)) for s in r.spans) for r in lic.scan_licenses(df).collect()}
    want = slow_scan(texts, lic.TEMPLATES)
    assert got == want
    assert len({s[0] for v in want.values() for s in v}) > 12


def test_whole_licences_that_base_phrases_miss(spark):
    """Each template's own text is found, also between other words; most have no base phrase in them."""
    texts = {k: f"int main() {{}} /* {t.text} */ return 0;" for k, t in enumerate(lic.TEMPLATES)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in lic.scan_licenses(df).collect()}
    for k, t in enumerate(lic.TEMPLATES):
        assert (t.label, 2, len(words_of(t.text)), 1.0) in [(s.label, s.word, s.words, s.share) for s in rows[k].spans], t.label
    missed = {t.label for k, t in enumerate(lic.TEMPLATES) if not rows[k].places}
    assert missed >= {"isc", "bsd-2-clause", "bsd-3-clause", "mpl-2.0", "epl-2.0", "cddl-1.0", "bsl-1.0", "zlib", "unlicense", "mit-text", "cc-by-4.0"}


def test_templates_hold_their_phrases():
    for t in lic.TEMPLATES:
        assert t.keys and all(" ".join(words_of(k)) in " ".join(words_of(t.text)) for k in t.keys), t.label
        assert len(t.keys) > 1 or len(words_of(t.text)) < 40, t.label


def test_a_key_of_any_name(spark):
    for name in ("places", "spans", "words", "n_words", "k"):
        df = spark.createDataFrame([(1, "mit license")], f"{name} long, text string")
        if name in ("places", "spans", "n_words"):
            with pytest.raises(ValueError):
                lic.scan_licenses(df, key=name)
        else:
            assert lic.scan_licenses(df, key=name).first()[name] == 1
