import random

import xxhash

from sparkveil.llm import simhash

DOCS = "doc_id long, text string, source string, fp string, key string"


def reference_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(set(fps))
    for a in distinct:
        for b in distinct:
            if a < b and (a ^ b).bit_count() <= 2:
                parent[root(b)] = root(a)
    best = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            best[root(f)] = min(i, best.get(root(f), i))
    return [best.get(root(f)) for f in fps]


def test_matches_brute_force_with_nulls_ties_and_copies(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeÉ") for _ in range(4))
    base = " ".join(word() for _ in range(80))
    rows = [(None, base), (5, None), (6, ""), (7, "  \t\n"), (8, "one"), (9, "ONE"), (9, "ONE"), (10, "one two")]
    for i in range(20, 140):
        words = base.split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            words[rng.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    rows.append((150, " ".join(word() for _ in range(30000))))
    df = spark.createDataFrame([(i, t, "s", "x", "y") for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    fps = [reference_fp(t) for _, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, components(rows, fps), strict=True)), key=str)
    assert got == want


def test_large_postings_link_like_pairs(spark, monkeypatch):
    rng = random.Random(5)
    fps = {rng.getrandbits(64)}
    while len(fps) < 200:
        f = rng.choice(sorted(fps))
        fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    nodes = spark.createDataFrame(signed, "fp long")

    def found(limit):
        monkeypatch.setattr(simhash, "PAIR_LIMIT", limit)
        roots = simhash.connected_components(simhash.links(nodes)).collect()
        groups = {}
        for r in roots:
            groups.setdefault(r.root, set()).add(r.node)
        return sorted(map(sorted, groups.values()))

    assert found(0) == found(10**9) == found(8)
    assert len(found(8)) >= 1


def test_empty_table_and_keep_one(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).collect() == []
    df = spark.createDataFrame([(2, "a b c d", "s", "", ""), (1, "a b c d", "t", "", ""), (3, "x y z w", "s", "", ""), (3, "x y z w", "s", "", ""), (None, "q", "s", "", "")], DOCS)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.source) for r in kept.where("doc_id is not null").collect()) == [(1, "t"), (3, "s")]
    assert kept.where("doc_id is null").count() == 1


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark):
    rows = [(1, "a b c d e"), (3, "a b c d e"), (3, "quite other words in this text"), (None, "a b c d e"), (None, "words of a nameless one"), (None, "words of a nameless one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(df).collect()), key=str)
    assert got == sorted([(1, "a b c d e"), (3, "quite other words in this text"), (None, "words of a nameless one")], key=str)
