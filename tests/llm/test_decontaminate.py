import hashlib
import random
import re

from sparkveil.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, width=10):
    out = []
    for i, text in docs:
        words = WORD.findall(lower(text))
        hit, who = set(), set()
        for item, t in items:
            w = WORD.findall(lower(t))
            for k in range(max(1, len(w) - width + 1) if w else 0):
                win = w[k : k + width]
                for s in range(len(words) - len(win) + 1):
                    if words[s : s + len(win)] == win:
                        hit.update(range(s, s + len(win)))
                        if item is not None:
                            who.add(str(item))
        digest = hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(who), digest, bool(hit)))
    return sorted(out, key=str)


def tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, 0, "k", []) for i, t in docs], "doc_id long, text string, n_words int, key string, spans array<int>")
    return d, spark.createDataFrame(items, "item_id long, text string")


def test_matches_brute_force(spark):
    rng = random.Random(1)
    vocab = ["ab", "c", "the", "Été", "x1", "überlang", "zz"]
    say = lambda n: rng.choice([" ", ", ", "\n", "  "]).join(rng.choice(vocab) for _ in range(n))
    items = [(k, say(rng.choice([1, 2, 4, 9, 10, 14, 30]))) for k in range(12)] + [(12, None), (13, ""), (None, "only here now"), (3, say(12)), (14, "?!")]
    docs = [(k, say(rng.randrange(60)) + " " + (rng.choice(items)[1] or "").upper() + " " + say(20)) for k in range(60)]
    docs += [(100, None), (101, ""), (102, say(3000)), (103, "say only, HERE-now!"), (103, "say only, HERE-now!"), (None, items[4][1])]
    d, b = tables(spark, docs, items)
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute(docs, items)
    assert sorted((tuple(r) for r in dc.contamination(d, b).select(*cols).collect()), key=str) == want
    in_blocks = dc.contamination(d, b, block_bytes=2000).select(*cols)
    assert sorted((tuple(r) for r in in_blocks.collect()), key=str) == want


def test_long_items_only_and_long_text(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("etaoinsh") for _ in range(rng.randrange(2, 9)))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(30)]
    text = " ".join([word() for _ in range(40000)] + items[7][1].split()[5:25] + [word() for _ in range(500)])
    docs = [(1, text), (2, "nothing here"), (3, " ".join(items[3][1].split()[:9]))]
    d, b = tables(spark, docs, items)
    got = {r.doc_id: (r.n_hit, r["items"], r.spans) for r in dc.contamination(d, b).collect()}
    assert got == {1: (20, ["7"], [40000, 40020]), 2: (0, [], []), 3: (0, [], [])}


def test_empty_tables_and_drop(spark):
    d, b = tables(spark, [(1, "a b c"), (1, "q"), (None, None)], [(1, "A B")])
    kept = dc.drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "None"]
    assert dc.contamination(d.limit(0), b).collect() == []
    assert {r.contaminated for r in dc.contamination(d, b.limit(0)).collect()} == {False}
