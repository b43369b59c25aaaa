import random

import numpy as np
import xxhash

from graphweft.llm import simhash as sh
from graphweft.llm.common import spanning_forest

from .helpers import ODD, documents


def plain_print(text):
    """Bit by bit, from the definition."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, w = [], ""
    for c in low + " ":
        if c in " \t\n\v\f\r":
            words, w = words + [w] if w else words, ""
        else:
            w += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, ids, bits=2):
    roots = list(range(len(prints)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                roots[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(prints))]


def test_fingerprints_follow_the_definition():
    for text in ("", "one", "one two", "A b C", "a b c d", "the the the the", "Été été x y z", "a  b\tc\x0bd " * 50, "Long words " * 5000):
        assert sh.simhash(text.encode()) == plain_print(text)


def test_jvm_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    h = spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0]
    assert h == sh.signed(xxhash.xxh64_intdigest(b"one two three", 42))


def test_odd_rows(spark):
    got = sh.near_duplicates(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    prints = [plain_print(t) for _, t in ODD]
    expected = {(i, f"{p:016x}", c) for (i, _), p, c in zip(ODD, prints, plain_components(prints, [i for i, _ in ODD]), strict=True)}
    assert {tuple(r) for r in got} == expected
    assert sh.near_duplicates(documents(spark, [])).count() == 0


def test_near_copies_chains_and_hot_lists(spark):
    """Clusters around a few centres, so dense that most posting lists exceed the cap."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(4)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.choice((0, 1, 1, 2, 2, 3)))) for c in centres for _ in range(150)}
    walk = rng.getrandbits(64)
    for b in range(0, 40, 2):
        walk ^= 3 << b
        prints.add(walk)
    prints |= {rng.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    fps = spark.createDataFrame([(sh.signed(p),) for p in prints], "fp long")
    roots = plain_components(prints, list(range(len(prints))))
    expected = {frozenset(prints[i] for i in range(len(prints)) if roots[i] == r) for r in set(roots)}
    for cap in (1024, 16):
        links = sh.fingerprint_links(fps, cap).collect()
        assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 2 or cap for r in links)
        forest = dict((b, a) for a, b in spanning_forest((r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in links))
        groups = {}
        for p in prints:
            groups.setdefault(forest.get(p, p), set()).add(p)
        assert {frozenset(g) for g in groups.values()} == expected


def test_list_links_probe_equals_tally():
    rng = random.Random(5)
    base = rng.getrandbits(48) << 16
    fps = np.array(sorted({base | rng.getrandbits(10) for _ in range(300)}), dtype=np.uint64)
    groups = lambda f: {x: a for a, x in f}
    assert groups(sh.list_links(fps, cap=1000)) == groups(sh.list_links(fps, cap=10))


def test_set_prints_follow_the_definition():
    rng = random.Random(6)
    for n in (1, 2, 99, 70_000):
        h = [rng.getrandbits(64) for _ in range(n)]
        assert sh.set_print(np.array(sorted(h), dtype=np.uint64)) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > n)


def test_near_fingerprints_against_all_couples(spark):
    """Groups of up to a hundred; lists that go over batches; few pairs of each member, and all."""
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for size in (2, 5, 100):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 8))) for _ in range(size)}
    prints = sorted(sh.signed(p) for p in prints)
    octets = np.array(prints).view(np.uint8).reshape(-1, 8)
    bits = [[bin((x ^ y) & (2**64 - 1)).count("1") for y in prints] for x in prints]
    shared = (octets[:, None, :] == octets[None, :, :]).sum(axis=2)
    couples = [(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints))]
    expected = {(prints[i], prints[j]) for i, j in couples if bits[i][j] <= 12 and shared[i, j] >= 2}
    assert {(prints[i], prints[j]) for i, j in couples if bits[i][j] <= 6} < expected
    fps = spark.createDataFrame([(p,) for p in prints], "fp long")
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for near in (2, 1000):
            got = [tuple(r) for r in sh.near_fingerprints(fps, near=near).collect()]
            assert len(got) == len(set(got))
            if near == 1000:
                assert set(got) == expected
            assert set(got) <= expected
            joined = dict((b, a) for a, b in spanning_forest(got))
            assert joined == dict((b, a) for a, b in spanning_forest(expected))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def test_one_row_of_each_group_stays(spark):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (2, "A B c  d e"), (4, "quite another text"), (4, "quite another text"), (5, None), (6, ""), (None, "a lone one")]
    out = sh.drop_near_duplicates(documents(spark, rows))
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 4, 5]
    assert out.columns == documents(spark, rows).columns
