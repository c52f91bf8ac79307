import random

from wattline.llm import preference

TURNS = "conv_id long, turn long, role string, text string"


def write(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def brute(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    out = [n, write(chosen[:n])]
    spans = []
    for side in (chosen, rejected):
        text, marks = "", []
        for role, said in side[n:]:
            text += f"<|im_start|>{role}\n"
            a = len(text)
            text += said + "<|im_end|>\n"
            if role == "assistant":
                marks.append((a, len(text)))
        out.append(text)
        spans.append(marks)
    return out + spans


def test_pairs_match_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(80):
        start = [(("user", "assistant")[k % 2], f"turn {k} é") for k in range(rnd.randrange(4))]
        sides = [start + [(rnd.choice(["user", "assistant"]), rnd.choice(["", "yes", "no " * 5])) for _ in range(rnd.randrange(4))] for _ in range(2)]
        rows.append((i, *sides))
    kind = "array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame([*rows, (90, None, [("user", "a")])], f"id int, chosen {kind}, rejected {kind}").selectExpr("*", "1 as prompt", "2 as n_prompt_turns")
    got = {r["id"]: r for r in preference.format_pairs(pairs, "id").collect()}
    for i, chosen, rejected in [*rows, (90, [], [("user", "a")])]:
        r = got[i]
        spans = [[tuple(s) for s in r[c]] for c in ("chosen_spans", "rejected_spans")]
        assert [r["n_prompt_turns"], r["prompt"], r["chosen"], r["rejected"], *spans] == brute(chosen, rejected)


def test_conversations_with_edges(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, None), (None, 0, "user", "x"), (2, 0, "user", "")]
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in preference.conversations_of(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == {1: [("user", "a"), ("assistant", "b")], 2: [("", ""), ("user", "")]}


def test_neighbours_and_swapped_replies(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c}/{t}") for c in range(0, 70, 2) for t in range(1 + c % 5)]
    turns = spark.createDataFrame(rows, TURNS)
    conversations = preference.conversations_of(turns)
    got = {r["conv_id"]: r for r in preference.swapped_replies(conversations).collect()}
    ids = list(range(0, 70, 2))
    assert sorted(got) == ids
    for at, i in enumerate(ids):
        other = at ^ 1 if at ^ 1 < len(ids) else at - 1
        assert got[i]["partner_id"] == ids[other]
        own = [(("user", "assistant")[t % 2], f"{i}/{t}") for t in range(1 + i % 5)]
        replies = [f"{ids[other]}/{t}" for t in range(1 + ids[other] % 5) if t % 2]
        last = max((k for k, x in enumerate(own) if x[0] == "assistant"), default=None)
        want = list(own)
        given = ("assistant", replies[-1] if replies else "")
        want = own + [given] if last is None else own[:last] + [given] + own[last + 1 :]
        assert [tuple(t) for t in got[i]["chosen"]] == own and [tuple(t) for t in got[i]["rejected"]] == want


def test_empty_table_and_single_conversation(spark):
    empty = spark.createDataFrame([], TURNS)
    conversations = preference.conversations_of(empty)
    assert preference.format_pairs(preference.swapped_replies(conversations), "conv_id").collect() == []
    one = preference.conversations_of(spark.createDataFrame([(1, 0, "user", "a")], TURNS))
    assert preference.swapped_replies(one).collect() == []
