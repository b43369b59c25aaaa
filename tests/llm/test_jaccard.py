import math
import random
from collections import Counter

import numpy as np
import pytest

from graphweft.llm import jaccard as jc
from graphweft.llm import simhash as sh

from .helpers import DATA, ODD, documents, needs_data


def plain_shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_groups(rows, similarity=0.8):
    """The smallest id reached, comparing all couples."""
    sets, roots = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= round(10 * similarity) * len(sets[i] | sets[j]):
                roots[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def copies(seed, n, low=30, high=120):
    """Texts, and copies of copies with a few words changed: similarities on both sides of 0.8."""
    rng = random.Random(seed)
    texts = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(30)) for _ in range(rng.randint(low, high))] for _ in range(4)]
    for _ in range(n):
        words = list(rng.choice(texts))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice("xyz") + str(rng.randrange(99))
        texts.append(words)
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


@pytest.mark.parametrize(("seed", "short", "least"), [(1, 16, 4), (2, 2, 2), (3, 2, 10_000)])
def test_against_all_couples(spark, monkeypatch, seed, short, least):
    """Lists short and long, shingles frequent and none."""
    monkeypatch.setattr(jc, "SHORT", short)
    monkeypatch.setattr(jc, "BLOCK", 8 if short == 2 else 1024)
    monkeypatch.setattr(jc, "MIN_DF", least)
    rows = copies(seed, 150) + [(1000 + i, f"one two three four five {i}") for i in range(20)]
    got = sorted(((r.doc_id, r.component_id) for r in jc.near_duplicates(documents(spark, rows)).collect()), key=str)
    assert got == plain_groups(rows)
    assert 20 < len({c for _, c in got}) < len(rows)


def test_sketches_bound_the_difference():
    rng = random.Random(4)
    for _ in range(300):
        x = {rng.getrandbits(64) for _ in range(rng.randint(1, 400))}
        y = set(rng.sample(sorted(x), rng.randint(0, len(x)))) | {rng.getrandbits(64) for _ in range(rng.randint(1, 200))}
        bits = jc.differing(*(jc.sketch(np.array(sorted(z), dtype=np.uint64)) for z in (x, y)))
        assert bits <= len(x ^ y)


def test_odd_rows(spark):
    got = sorted(((r.doc_id, r.component_id) for r in jc.near_duplicates(documents(spark, ODD)).collect()), key=str)
    assert got == plain_groups(ODD)
    assert jc.near_duplicates(documents(spark, [])).count() == 0


def test_pipeline_stage_drops_copies_beyond_two_bits(spark):
    import corpus_pipeline

    rng = random.Random(8)
    words = [f"w{rng.randrange(500)}" for _ in range(120)]
    changed = list(words)
    for at in (20, 60):
        changed[at] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, "quite another text"), (4, None), (5, "")]
    assert bin(sh.simhash(rows[0][1].encode()) ^ sh.simhash(rows[1][1].encode())).count("1") > 2
    out = corpus_pipeline.without_near_duplicates(spark, documents(spark, rows), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]
    assert out.columns == documents(spark, rows).columns


def changed_at(seed, places, n=120):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(500)}" for _ in range(n)]
    return " ".join(words), " ".join("other" if i in places else w for i, w in enumerate(words))


def reach(x, y):
    """(differing bits, shared positional bytes) of the fingerprints of two texts' sets."""
    x, y = (jc.set_print(jc.shingles(t.encode())) for t in (x, y))
    return bin(x ^ y).count("1"), sum(x >> 8 * i & 255 == y >> 8 * i & 255 for i in range(8))


def test_pipeline_stage_links_through_the_fingerprint_index(spark, monkeypatch):
    """Without prefix lists: near copies within the index's reach are linked all the same, others are not."""
    import corpus_pipeline

    listed = jc._listed
    monkeypatch.setattr(jc, "_listed", lambda sets: listed(sets).where("false"))
    pairs = [changed_at(seed, (20, 60)) for seed in range(40)]
    inside = [seed for seed, (x, y) in enumerate(pairs) if reach(x, y)[0] <= 12 and reach(x, y)[1] >= 2]
    assert any(reach(*pairs[seed])[0] > 2 for seed in inside) and len(inside) > 20
    rows = [(10 * seed + k, t) for seed, pair in enumerate(pairs) for k, t in enumerate(pair)]
    out = corpus_pipeline.without_near_duplicates(spark, documents(spark, rows), "")
    assert {r.doc_id for r in out.collect()} == {i for i, _ in rows} - {10 * seed + 1 for seed in inside}


def test_what_fingerprints_miss_is_linked_too(spark):
    pairs = [changed_at(seed, (20, 60)) for seed in range(200)]
    missed = [p for p in pairs if reach(*p)[0] > 12 or reach(*p)[1] < 2]
    assert missed
    rows = [(2 * i + k, t) for i, p in enumerate(missed) for k, t in enumerate(p)]
    got = sorted(((r.doc_id, r.component_id) for r in jc.near_duplicates(documents(spark, rows)).collect()), key=str)
    assert got == plain_groups(rows) and len({c for _, c in got}) == len(missed)


@needs_data
def test_pipeline_against_a_plain_version_with_shingles(spark):
    """All five stages; the third compares the sets of all couples of texts."""
    import corpus_pipeline
    from graphweft.llm import language_id as lid

    from .test_texts import plain_contamination, plain_targets

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scorer = lid.Scorer(lid.fit(docs))
    rows = [r for r in docs.collect() if scorer(r.text)[1] * len(scorer.model.langs) >= 1.02 and scorer(r.text)[0] != "und"]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    seen = Counter(k for r in rows for k in {key(x) for x in r.text.split("\n")})
    texts = [(r.doc_id, "\n".join(x for x in r.text.split("\n") if seen[key(x)] < 10 or not key(x))) for r in rows]
    first = dict(plain_groups(texts))
    texts = [x for x in texts if first[x[0]] == x[0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = {x[0] for x in plain_contamination(texts, items) if x[5]}
    texts, source, sizes = {i: t for i, t in texts if i not in bad}, {r.doc_id: r.source for r in rows}, Counter()
    for i, t in texts.items():
        sizes[source[i]] += len(t.split())
    target = plain_targets(dict(sizes))
    got = corpus_pipeline.run(spark, DATA).collect()
    copies = Counter(r.doc_id for r in got)
    assert set(copies) <= set(texts) and all(r.text == texts[r.doc_id] for r in got)
    for i in texts:
        rate = target[source[i]] / sizes[source[i]] if sizes[source[i]] else 0
        assert math.floor(rate) <= copies[i] <= math.ceil(rate + 1e-9)
