"""op9: units against plain Dice coefficients."""

import re
import textwrap

from weighbridge.llm.licences import TEMPLATES, licence_units, scan


def pairs(text):
    words = re.findall(r"[a-z0-9]+", text.lower())
    return set(zip(words, words[1:]))


def brute_force(rows, dice=0.8):
    best = {}
    for i, text in rows:
        if i is None or text is None:
            continue
        units = {text, *text.split("\n"), *re.sub(r"([.!?:])[ \t\n\x0b\f\r]+", "\\1\n", text).split("\n")}
        for licence, texts in TEMPLATES.items():
            for unit in units:
                a = pairs(unit)
                score = max((2 * len(a & pairs(t)) / (len(a) + len(pairs(t))) for t in texts if a), default=0)
                if score >= dice:
                    best.setdefault((i, licence), {})[unit] = score
    return {k: (max(v.values()), len(v)) for k, v in best.items()}


MIT = TEMPLATES["MIT"][2]
ROWS = [(1, "Text before.\nReleased under the MIT License.\nText after"), (2, MIT), (3, "intro. " + MIT.replace("free of charge", "gratis") + " end"), (4, "released UNDER the mit licence"),
        (5, "Licensed under CC BY-NC 4.0. And more words follow here. All rights reserved!"), (6, None), (7, ""), (8, "license"), (9, "the " * 50_000), (None, MIT),
        (10, "All rights reserved. All rights reserved."), (10, "Licensed under CC BY 4.0."), (11, "This work is licensed under the GNU General Public License, version 3.\n" * 30), (1, "Text before.\nReleased under the MIT License.\nText after")]


def test_against_plain_dice(documents):
    got = {(r.doc_id, r.licence): (r.dice, r.n_units) for r in scan(documents(*ROWS)).collect()}
    want = {}
    for key, value in brute_force(ROWS).items():
        want[key] = value
    assert got == want and (1, "MIT") in got and (3, "MIT") in got


def test_lower_threshold(documents):
    got = {(r.doc_id, r.licence): (r.dice, r.n_units) for r in scan(documents(*ROWS), dice=0.5).collect()}
    assert got == brute_force(ROWS, 0.5)


def test_empty_and_native(documents):
    assert scan(documents().limit(0)).collect() == []
    plan = licence_units(documents(*ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_passages(text, licence, dice=0.8):
    """The best coefficient of any run of words with as many words as a template, or up to half as many more."""
    words = re.findall(r"[a-z0-9]+", text.lower())
    best = 0
    for t in TEMPLATES[licence]:
        own, w = pairs(t), len(re.findall(r"[a-z0-9]+", t.lower()))
        for n in range(w, int((w - 1) * (2 - dice) / dice + 1e-9) + 2):
            for s in range(len(words) - n + 1):
                a = set(zip(words[s : s + n], words[s + 1 : s + n]))
                best = max(best, 2 * len(a & own) / (len(a) + len(own)))
    return best


def test_notices_across_line_feeds(documents):
    other = [f"word{i % 97} of the other text{i % 89}" + "." * (i % 7 == 0) for i in range(60)]

    def inside(notice, mark=""):
        lines = textwrap.wrap(notice, 78 - len(mark), initial_indent=mark, subsequent_indent=mark)
        return "\n".join([*textwrap.wrap(" ".join(other), 78), "", *lines, "", *textwrap.wrap(" ".join(other), 78)])

    apache, gpl = TEMPLATES["Apache-2.0"], TEMPLATES["GPL-3.0"][1]
    rows = [(1, inside(MIT)), (2, inside(apache[2], " * ")), (3, inside(gpl, "# ")), (4, " ".join(other) + " " + apache[1] + " " + " ".join(other)),
            (5, inside(apache[1] + " " + apache[2], "// ")), (6, inside(MIT.replace("free of charge", "gratis").replace("sublicense", "license again and lend"))),
            (7, inside(MIT) + "\n" + inside(MIT) + "\n" + inside(MIT.replace("sublicense", "lend"))), (8, inside(" ".join(MIT.split()[:30]))),
            (9, "\n".join(other) + "\n" + "\n".join(textwrap.wrap(gpl.replace("version 3", "version three"), 40))), (10, " ".join(other))]
    assert not brute_force(rows)
    got = {(r.doc_id, r.licence): (r.dice, r.n_units) for r in scan(documents(*rows)).collect()}
    want = {(i, n): plain_passages(text, n) for i, text in rows for n in TEMPLATES}
    assert {k: v[0] for k, v in got.items()} == {k: v for k, v in want.items() if v >= 0.8}
    assert {(1, "MIT"), (2, "Apache-2.0"), (3, "GPL-3.0"), (4, "Apache-2.0"), (5, "Apache-2.0"), (6, "MIT"), (7, "MIT"), (9, "GPL-3.0")} == set(got)
    assert got[1, "MIT"] == (1, 1) and got[5, "Apache-2.0"][1] == 3 and got[7, "MIT"] == (1, 2)
