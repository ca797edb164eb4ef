"""Quotation links against a brute-force linker over words, with quotes that are wrapped anew, nested and edited."""

import random
import re
import textwrap

from mensura.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, position int"
WORDS = [a + b for a in "ba be bi bo bu da de di do du".split() for b in "kan len mir nos tup ral sev wit".split()]


def words(text):
    return re.findall(r"[a-z0-9]+", text.lower())


def hashes(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(conversation):
    """turn -> the turn it replies to, for (turn, text) rows, by looking at every earlier message."""
    own, out = {}, {}
    for turn, text in conversation:
        _, runs, _ = quotes.parse(text)
        mine = set()
        for run in runs:
            mine |= hashes(run)
            for part in run.split("\n") + re.split(r"\n\s*\n", run):
                if len(words(part)) < 5:
                    mine |= hashes(part)
        own.setdefault(turn, set()).update(mine)
    for turn, text in conversation:
        linked = []
        for i, (level, passage) in enumerate(quotes.parse(text)[2]):
            votes, all_ = {}, hashes(passage)
            for h in all_:
                holders = [t for t in own if t < turn and h in own[t]]
                if holders:
                    votes[max(holders)] = votes.get(max(holders), 0) + 1
            if votes:
                n, src = max((n, t) for t, n in votes.items())
                if n >= 0.5 * len(all_):
                    linked.append((level, i, src))
        if linked:
            out[turn] = min(linked)[2]
    return out


def quoted(text, width, extra=">"):
    return "\n".join(f"{extra} {line}" for line in textwrap.wrap(text, width))


def conversation(rng):
    rows = []
    for turn in range(rng.randint(2, 9)):
        own = " ".join(rng.choices(WORDS, k=rng.choice([2, 4, 12, 40])))
        if rng.random() < 0.3:
            own = own.capitalize() + ".\n\n" + " ".join(rng.choices(WORDS, k=8)) + "!"
        parts = []
        for _ in range(rng.choice([0, 1, 1, 2])):
            if rows:
                whole = words(quotes.parse(rng.choice(rows)[1])[0])
                a = rng.randint(0, max(0, len(whole) - 6)) if rng.random() < 0.5 else 0
                kept = whole[a:a + rng.randint(3, 60)]
                if kept and rng.random() < 0.4:
                    kept[rng.randrange(len(kept))] = "edited"
                parts.append(quoted(" ".join(kept), rng.choice([18, 30, 72]), rng.choice([">", ">>", "> >"])))
        rows.append((turn * rng.choice([1, 1, 5000]), "\n".join([*parts, own])))
    return rows


def test_links_equal_brute_force(spark):
    rng = random.Random(4)
    many = {c: conversation(rng) for c in range(60)}
    df = spark.createDataFrame([(c, t, "a", x, 0) for c, rows in many.items() for t, x in rows], SCHEMA)
    got = {}
    for r in quotes.conversations(df).where("reply_to is not null").collect():
        got.setdefault(r.conv_id, {})[r.turn] = r.reply_to
    want = {c: w for c, rows in many.items() if (w := brute(rows))}
    assert got == want and sum(map(len, want.values())) > 60


def test_wrapped_nested_and_edited_quotes(spark):
    first = "One long paragraph that a mail client will wrap anew when someone replies to it, as they usually do."
    second = "I think the second half of this is wrong, but the first half is right and well put."
    rows = [(1, 0, first), (1, 1, quoted(first, 20) + "\n" + second), (1, 2, quoted(first, 33, ">>") + "\n" + quoted(second, 25) + "\nAgreed."),
            (1, 3, quoted(second.replace("wrong", "not so good"), 40) + "\nHm."), (1, 4, "> words that nobody in this conversation has ever written\nWho said that?"),
            (2, 0, "ok"), (2, 1, "> OK!\nfine"), (None, 5, quoted(first, 20)), (3, None, quoted(first, 20) + "\nx"), (4, 0, None), (4, 1, "")]
    df = spark.createDataFrame([(c, t, "a", x, 0) for c, t, x in rows], SCHEMA)
    got = {(r.conv_id, r.turn): (r.reply_to, r.n_linked, r.text) for r in quotes.conversations(df).collect()}
    assert got == {(1, 0): (None, 0, first), (1, 1): (0, 1, second), (1, 2): (1, 2, "Agreed."), (1, 3): (1, 1, "Hm."), (1, 4): (None, 0, "Who said that?"),
                   (2, 0): (None, 0, "ok"), (2, 1): (0, 1, "fine"), (None, 5): (None, 0, ""), (3, None): (None, 0, "x"), (4, 0): (None, 0, ""), (4, 1): (None, 0, "")}


def test_very_long_texts_and_ties(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, 0, long), (1, 1, long), (1, 9000, quoted(long, 80)), (1, 9001, quoted("w5 w6 w7 w8 w9 w10 w11", 9) + "\nshort")]
    df = spark.createDataFrame([(c, t, "a", x, 0) for c, t, x in rows], SCHEMA)
    got = {r.turn: (r.reply_to, r.text) for r in quotes.conversations(df).collect()}
    assert got[9000] == (1, "") and got[9001] == (1, "short") and got[0][1] == long
