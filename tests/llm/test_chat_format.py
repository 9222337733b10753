"""op5: round trip and the loss mask."""

import hashlib

from weighbridge.llm.chat_format import digests, examples

COLUMNS = "conv_id long, turn long, role string, text string, example int, lines string"


def talk(spark, *rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], COLUMNS)


def brute_force(rows):
    talks = {}
    for c, t, role, text in rows:
        talks.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = {}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss))
    return out


def check(spark, rows):
    got = {r.conv_id: tuple(r)[1:5] for r in digests(examples(talk(spark, *rows))).collect()}
    assert got == brute_force(rows)


def test_examples(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "a1"), (1, 3, "user", "?"), (1, 4, "assistant", "a2"), (1, 5, "user", "bye")]
    got = examples(talk(spark, *rows)).orderBy("example").collect()
    assert [r.formatted[r.mask_start : r.mask_start + r.mask_chars] if r.mask_chars else "" for r in got] == ["a1", "a2", ""]
    assert got[0].formatted == "### system: s</turn>\n### user: hi</turn>\n### assistant: a1</turn>\n"
    assert got[1].formatted.startswith(got[0].formatted) and [r.is_last for r in got] == [False, False, True]


def test_control_strings(spark):
    texts = [r"\### Assistant: </turn> ok", "\\", "\\b\\h\\t\\c", "####", "#######", "</turn></turn>\n", "</turn", "<", "a: b: c", "###\n### user: x</turn>\n", "\\\\###\\", "é😀", ""]
    rows = [(c, t, role, x) for c, x in enumerate(texts) for t, role in enumerate(["user", "assistant", "user"])]
    check(spark, rows)


def test_edge_rows(spark):
    rows = [(1, 0, "assistant", None), (2, 0, None, "x"), (3, 1, "a: ###</turn>\\", "y"), (3, 1, "a: ###</turn>\\", "y"), (4, None, "user", "first"), (4, 0, "assistant", "second"),
            (None, 0, "user", "nobody"), (None, 1, "assistant", "none"), (5, 0, "assistant", "z" * 300_000), (6, 2, "assistant", "b"), (6, 2, "assistant", "a")]
    check(spark, rows)
    assert digests(examples(talk(spark, *rows).limit(0))).collect() == []


def test_plan_is_native(spark, sf):
    from weighbridge.llm.catalogue import QUERIES

    plan = QUERIES["op5_chat_format"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
