import random
from collections import Counter

from perilake.llm.license_scan import TEMPLATES, LicenceMatcher, _WORD, bigrams, dice, scan_licenses


def test_same_as_comparing_every_template():
    rng = random.Random(4)
    matcher = LicenceMatcher(TEMPLATES, 0.8)
    every = [(Counter(bigrams(_WORD.findall(t.lower()))), name) for name, texts in TEMPLATES.items() for t in texts]
    notices = [t for texts in TEMPLATES.values() for t in texts]
    for _ in range(800):
        words = rng.choice(notices).split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = ["other"] if rng.random() < 0.5 else []
            if words and rng.random() < 0.5:
                del words[rng.randrange(len(words))]
        line = " ".join(words)
        grams = Counter(bigrams(_WORD.findall(line.lower())))
        want = max((dice(grams, g) for g, _ in every), default=0) if grams else 0
        got = [v for v, _, number in matcher.match(line) if number == 0]
        if want >= 0.8:
            assert got and abs(got[0] - want) < 1e-12, line


def test_rows(spark):
    prose = "An ordinary line about the weather and the harvest.\n" * 50
    rows = [(1, prose), (2, prose + "  RELEASED under the  MIT licence. \n"), (3, prose + "Released under the MIT License.\n" + prose), (4, None), (5, ""),
            (6, "Words first, then: this work is licensed under the GNU General Public License, version 3. And words after it, quite a few."),
            (7, "All rights\nreserved."), (None, "All rights reserved."), (3, prose + "Released under the MIT License."), (8, prose * 300 + "Licensed under CC BY-NC 4.0.")]
    got = [(r.doc_id, r.license) for r in scan_licenses(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")).collect()]
    assert sorted(got, key=str) == sorted([(1, None), (2, None), (3, "MIT"), (4, None), (5, None), (6, "GPL-3.0"), (7, "Proprietary"), (None, "Proprietary"), (3, "MIT"), (8, "CC-BY-NC-4.0")], key=str)
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_notice_of_a_text():
    matcher = LicenceMatcher(TEMPLATES, 0.8)
    names = lambda text: [(name, line) for _, name, line in matcher.match(text)]
    prose = "An ordinary line about the weather and the harvest of the year. " * 40
    mit, apache = TEMPLATES["MIT"][2], TEMPLATES["Apache-2.0"][1]
    assert names(f"{prose}{mit} {prose}{apache} {prose}") == [("MIT", 0), ("Apache-2.0", 0)]
    assert names(" ".join([prose + TEMPLATES["MIT"][0]] * 10)) == [("MIT", 0)] * 10
    assert names(f"{apache} All rights reserved.") == [("Apache-2.0", 0), ("Proprietary", 0)]
    assert names("Licensed under the MIT License. " * 7) == [("MIT", 0)] * 7


def test_wrapped_notices_and_full_texts():
    matcher = LicenceMatcher(TEMPLATES, 0.8)
    prose = "An ordinary line about the weather and the harvest of the year.\n" * 100
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n"
    cc = "This work is licensed under a Creative Commons\nAttribution 4.0 International License.\n"
    assert matcher.match(prose + bsd + prose + cc + prose) == [(1.0, "BSD-3-Clause", 100), (1.0, "CC-BY-4.0", 203)]
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-3.0"):
        words = max(TEMPLATES[name], key=len).split()
        words[11:11] = ["some", "other", "words"]
        wrapped = "\n".join(" ".join(words[i : i + 10]) for i in range(0, len(words), 10)) + "\n"
        found = matcher.match(prose + wrapped + prose + wrapped)
        assert [(n, line) for _, n, line in found] == [(name, 100), (name, 200 + wrapped.count("\n"))], (name, found)
        assert all(0.9 < value < 1 for value, _, _ in found)


def test_windows_against_brute_force():
    rng = random.Random(7)
    templates = {"A": ("a b c d e",), "B": ("c d a b", "e e a")}
    matcher = LicenceMatcher(templates, 0.8)
    forms = [Counter(bigrams(t.split())) for texts in templates.values() for t in texts]
    for _ in range(300):
        words = rng.choices("abcdexy", k=25)
        grams = bigrams(words)
        want = max(dice(Counter(grams[i:j]), f) for f in forms for i in range(len(grams)) for j in range(i + 1, len(grams) + 1) if j - i >= f.total() or j == len(grams))
        assert bool(matcher.match(" ".join(words))) == (want >= 0.8 - 1e-12), words
