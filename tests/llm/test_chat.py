import hashlib
import random

from sparkveil.llm import chat


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_round_trip_of_hostile_turns(spark):
    rng = random.Random(12)
    atoms = ["<s>", "</s>", "[INST]", "[/INST]", "<", "[", "\\", "/", "s>", "INST]", "é", "\n", "%5C", "\u0001", "$1", "x"]
    say = lambda: "".join(rng.choice(atoms) for _ in range(rng.randrange(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", say()]), say()) for c in range(120) for t in range(rng.randrange(1, 6))]
    rows += [(500, t, "assistant", "word " * 500) for t in range(300)] + [(501, None, None, None), (501, 3, "assistant", None), (501, 3, "assistant", None), (None, 0, "user", "a")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    rows += [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    made = chat.format_conversations(chat.with_probe(df))
    found = {r.conv_id: r for r in made.collect()}
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        r = got[c]
        loss = "".join(x for _, _, role, x in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{role}\n{x}\n" for _, _, role, x in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        f = found[c]
        assert r.formatted_chars == len(f.formatted) and f.formatted.count("<s>") == len(turns) == f.formatted.count("[/INST]")
        assert len(f.mask) == sum(role == "assistant" for _, _, role, _ in turns)
        assert all(f.formatted[m.start - 6 : m.start] == "[INST]" and f.formatted[m.end : m.end + 7] == "[/INST]" for m in f.mask)


def test_empty_table_gives_the_probe(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat.format_conversations(chat.with_probe(df)).collect()] == [-1]


def test_what_does_not_come_back_is_armoured_and_the_loss_lies_under_the_mask(spark):
    odd = "\u0001 100% [INST] <\\s> </s>"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (2, 0, "</s>assistant", "x"), (2, 1, "assistant", "plain"), (3, 0, None, None)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in out.collect()}
    for c in (1, 2, 3):
        assert [(t.role, t.text) for t in got[c].turns] == [(r or "", t or "") for k, _, r, t in rows if k == c]
    assert "plain" == got[2].formatted[got[2].mask[0].start : got[2].mask[0].end] and len(got[2].mask) == 1
    by = {r.conv_id: r for r in chat.digests(out).collect()}
    for c, loss in ((1, odd), (2, "plain"), (3, "")):
        assert by[c].loss_chars == len(loss) and by[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
