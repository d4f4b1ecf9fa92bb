"""Quotation links against a plain version, parts of messages, other conversations and circles."""

import random
import re

import pytest

from colforge.llm import quotes

COLUMNS = "conv_id long, turn long, role string, text string"


def plain_parse(text):
    """Own lines as stretches of paragraphs, and passages (depth, lines)."""
    flat = lambda s: " ".join(re.split(r"[\x00-\x20]+", s)).strip(" ").lower()
    rows = []
    for line in re.split(r"\r\n|\r|\n", text):
        found = re.match(r"[ \t]*>[> \t]*", line)
        rows.append((found.group().count(">") if found else 0, flat(line[found.end() :] if found else line)))
    passages, last = [], 0
    for d, s in rows:
        if d and d == last:
            passages[-1][1].append(s)
        elif d:
            passages.append((d, [s]))
        last = d
    passages = [(d, [s for s in lines if s]) for d, lines in passages]
    own = [s for d, s in rows if not d and s]
    stretch, paragraph = [[]], [[]]
    for d, s in rows:
        if d:
            stretch.append([])
        elif s:
            stretch[-1].append(s)
            paragraph[-1].append(s)
        else:
            paragraph.append([])
    units = {" ".join(x) for x in (own, *stretch, *paragraph, *([s] for s in own))}
    return own, units, [(d, p) for d, p in passages if p]


def plain_links(rows, any_conversation):
    held = {(c, t): plain_parse(x) for c, t, x in rows}

    def says(m, lines):
        own, units, _ = held[m]
        return " ".join(lines) in units or any(own[k : k + len(lines)] == lines for k in range(len(own)))

    answer = {}
    for (c, t), (_, _, passages) in held.items():
        best = []
        for d, lines in passages:
            sayers = sorted(m for m in held if says(m, lines))
            mine = [m for m in sayers if m[0] == c][:1]
            near = [m for m in mine if m[1] < t]
            far = [m for m in sayers if m[0] != c and (any_conversation or m[0] < c)]
            if not any_conversation:
                far = [m for m in far[:1] if m == next(x for x in sayers if x[0] != c)]
            if near or far:
                best.append((-d, *(near or far)[0]))
        if best:
            answer[c, t] = max(best)[1:]
    for m in list(answer):
        seen = [m]
        while seen[-1] in answer and answer[seen[-1]] not in seen:
            seen.append(answer[seen[-1]])
        if answer.get(seen[-1]) == m:
            del answer[min(seen)]
    return answer


def linked(spark, rows, **options):
    df = spark.createDataFrame([(c, t, "r", x) for c, t, x in rows], COLUMNS).repartition(3)
    return {(r.conv_id, r.turn): r for r in quotes.conversations(df, **options).collect()}


@pytest.mark.parametrize("any_conversation", [False, True])
def test_links_equal_a_plain_version(spark, any_conversation):
    rng = random.Random(5)
    words = ["one", "Two  two", "three", "FOUR", "five\tfive", "six"]
    circles = 0
    rows = []
    for c in range(60):
        for t in range(5):
            lines = []
            for _ in range(rng.randint(0, 6)):
                lines.append(rng.choice(["", "", "", "> ", "> ", ">> ", " > > "]) + rng.choice([*words, *words, "", f"own {c}", f"own {rng.randint(0, 59)}"]))
            rows.append((c, t, rng.choice(["\n", "\n", "\r\n"]).join(lines)))
    got = {m: (r.to_conv, r.to_turn) for m, r in linked(spark, rows, any_conversation=any_conversation).items() if r.to_turn is not None}
    want = plain_links(rows, any_conversation)
    assert got == want and len(want) > 50
    circles = sum(a > m for m, a in want.items())
    assert (circles > 0) == any_conversation


def test_parts_of_messages_are_found(spark):
    rows = [
        (1, 0, "zero\none\ntwo\nthree"), (1, 1, "> one\n> two\nyes"),
        (2, 0, "question"), (2, 1, "first\nsecond\n> question\nthird\nfourth"), (2, 2, "> first\n> second\n>> question\n> third\n> fourth\nreply"),
        (2, 3, "> second\n> third\nacross the quote"), (2, 4, "> THIRD   fourth\nother breaks"),
        (3, 0, "a\nb\nc"), (3, 1, "> a\n> c\nnot in a row"), (3, 2, "> b\n> c\n> d\ntoo long"), (3, 3, "> c\nend"),
    ]
    got = {m: (r.to_conv, r.to_turn) for m, r in linked(spark, rows).items() if r.to_turn is not None}
    assert got == {(1, 1): (1, 0), (2, 1): (2, 0), (2, 2): (2, 1), (2, 3): (2, 1), (2, 4): (2, 1), (3, 3): (3, 0)}


def test_other_conversations_and_circles(spark):
    rows = [
        (0, 0, "> from one\nin zero"), (1, 0, "from one"),
        (2, 1, "> said later\nx"), (2, 2, "said later"), (3, 0, "said later"),
        (4, 0, "> b side\na side"), (5, 0, "> a side\nb side"), (6, 0, "> a side\n> b side\n\nboth"), (7, 0, "> a side\ntail"),
        (8, 0, "> q\np"), (9, 0, "> r\nq"), (10, 0, "> p\nr"),
    ]
    out = linked(spark, rows, any_conversation=True)
    got = {m: (r.to_conv, r.to_turn) for m, r in out.items() if r.to_turn is not None}
    assert got == {(0, 0): (1, 0), (2, 1): (3, 0), (5, 0): (4, 0), (7, 0): (4, 0), (9, 0): (10, 0), (10, 0): (8, 0)}
    assert (out[9, 0].root_conv, out[9, 0].depth) == (8, 2) and out[8, 0].depth == 0
    smaller = {m: (r.to_conv, r.to_turn) for m, r in linked(spark, rows).items() if r.to_turn is not None}
    assert smaller == {(5, 0): (4, 0), (7, 0): (4, 0), (10, 0): (8, 0)}


def test_a_phrase_that_everybody_quotes_and_a_long_message(spark):
    long = "\n".join(f"line {k % 50}" for k in range(4000))
    rows = [(0, 0, "hello\nthere"), (0, 1, long)] + [(0, k, "> hello\n> there\nme too") for k in range(2, 1500)]
    rows += [(0, 1500, "> " + long.replace("\n", "\n> ")), (0, 1501, "> line 48\n> line 49\n> line 0\nok"), (0, 1501, "> line 48\n> line 49\n> line 0\nok")]
    out = linked(spark, rows)
    assert all(out[0, k].to_turn == 0 for k in range(2, 1500))
    assert out[0, 1500].to_turn == 1 and out[0, 1501].to_turn == 1
    assert linked(spark, []) == {} and linked(spark, [(1, 0, None), (1, 1, "")])[1, 1].to_turn is None
