"""Budgeted conversations against a plain reading of the rule, with a conversation of a third of all messages."""

import random

from notewell.operators import compaction

MESSAGES = "conv_id bigint, turn bigint, role string, text string"


def cut(text, limit):
    return text if len(text) <= limit else text[:limit].rstrip(" ") + compaction.CUT_MARK


def plain(rows, budget, first, user):
    rows = sorted(((t, r or "", x or "") for _, t, r, x in rows), key=lambda m: (m[0] is not None, m))
    n, size = len(rows), compaction.HEADING
    if sum(len(x) + size for _, _, x in rows) <= budget:
        return {k: ("whole", x) for k, (_, _, x) in enumerate(rows)}
    room = budget - compaction.RESERVE
    keep = {k: ("first", cut(rows[k][2], first)) for k in range(min(2, n))}
    left = int(room * compaction.TAIL_SHARE)
    for k in range(n - 1, 1, -1):
        if len(rows[k][2]) > left:
            if k == n - 1:
                keep[k] = ("tail", cut(rows[k][2], max(compaction.LEAST_TAIL, left)))
            break
        keep[k] = ("tail", rows[k][2])
        left -= len(rows[k][2])
    middle_room = room - sum(len(x) for _, x in keep.values())
    middle = [k for k in range(n) if rows[k][1] == "user" and k not in keep]
    if middle and middle_room > user + compaction.PER_CUT:
        for k in middle[:: max(1, -(-len(middle) * (user + compaction.PER_CUT) // middle_room))]:
            keep[k] = ("middle", cut(rows[k][2], user))
    while sum(len(x) + size for _, x in keep.values()) > room:
        victims = sorted(k for k in keep if 1 < k < n - 1)
        if not victims:
            break
        del keep[victims[len(victims) // 2]]
    out, reach = {}, 0
    for k in sorted(keep):
        part, text = keep[k]
        reach += size
        out[k] = (part, text[: max(0, budget - reach)])
        reach += len(text)
    return out


def test_conversations_of_every_size(spark, monkeypatch):
    monkeypatch.setattr(compaction, "SLICE", 7)
    rng = random.Random(19)
    convs = {}
    for conv in [*range(24), None]:
        turns = 260 if conv == 0 else rng.choice([1, 2, 3, 9, 40])
        longest = rng.choice([5, 60, 300, 3000])
        convs[conv] = [(conv, t if rng.random() < 0.98 else None, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "w " * rng.randint(0, longest // 2)])) for t in range(turns)]
    convs[3] = convs[3] + convs[3]  # repeated rows
    rows = [r for c in convs.values() for r in c]
    rng.shuffle(rows)
    for budget, first, user in ((1500, 200, 60), (2500, 900, 100)):
        got = {}
        for r in compaction.compacted(spark.createDataFrame(rows, MESSAGES), budget, first, user).collect():
            got.setdefault(r.conv_id, {})[r.place] = (r.part, r.text)
            assert r.n == len(convs[r.conv_id])
        assert got == {c: plain(m, budget, first, user) for c, m in convs.items()}
        assert all(sum(len(x) for _, x in kept.values()) <= budget for kept in got.values())


def test_an_empty_table(spark):
    assert compaction.compacted(spark.createDataFrame([], MESSAGES), 1000).count() == 0
