import re

import pytest

from loomwright.llm import licenses
from tests.llm.helpers import DOCS, HARD, documents, lower, with_clashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall(lower(text))
    places = [
        (i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(w))
        if w[i:i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({x for _, x in places}))
    return len(w), len(places), min(starts, default=None), max(starts, default=None), labels


TEXTS = [
    "All rights reserved. all-rights/reserved; ALL RIGHTS RESERVE", "CC BY cc by-sa", "ccby all rights\nreserved é",
    "This work is licensed under the GNU General Public License, version 3.", "all all rights reserved",
    "Copyright (c) 2020 Some Body. All rights reserved", "Copyright all rights reserved",
]


def test_base_places(spark):
    docs = [*HARD, *enumerate(TEXTS, 100)]
    got = licenses.labelled(licenses.scan(with_clashes(documents(spark, docs)))).collect()
    digest = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr)
    assert digest == sorted(((d, *brute(t)) for d, t in docs), key=repr)
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in got)
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0


TEMPLATE = ("Permission is <<beginOptional>>hereby<<beginOptional>> and now<<endOptional>><<endOptional>> granted to "
            "<<var;name=who;original=you;max=3>> free of charge")


@pytest.mark.parametrize("text, accepted", [
    ("permission is granted to you free of charge", True),
    ("Permission IS hereby granted, to: free of charge", True),
    ("permission is hereby and now granted to a b c free of charge", True),
    ("permission is and now granted to you free of charge", False),  # the inner region alone
    ("permission is granted to a b c d free of charge", False),
    ("permission was granted to you free of charge", False),
    ("permission is granted to you free of", False),
    ("permission is granted to free free of charge", True),
])
def test_mandatory_words_must_match(text, accepted):
    machine = licenses.compile_template(TEMPLATE)
    end = machine.longest(licenses.words_of(text), 0)
    assert (end == len(licenses.words_of(text))) if accepted else end is None


def expand(template):
    """A regular expression over words joined by spaces, an independent reading of the mark-up."""
    out, at = "", 0
    for m in re.finditer(r"<<(\w+)([^>]*)>>", template):
        out += "".join(re.escape(w) + " " for w in WORD.findall(lower(template[at:m.start()])))
        at = m.end()
        if m[1] == "var":
            out += r"(?:\S+ ){0," + re.search(r"max=(\d+)", m[2])[1] + "}"
        else:
            out += "(?:" if m[1] == "beginOptional" else ")?"
    return out + "".join(re.escape(w) + " " for w in WORD.findall(lower(template[at:])))


def test_automata_agree_with_regular_expressions():
    import random

    draw = random.Random(5)
    for label, template in {**licenses.TEMPLATES, "own": TEMPLATE}.items():
        machine, pattern = licenses.compile_template(template), re.compile(expand(template))
        vocabulary = sorted({w.decode() for w in licenses.words_of(re.sub("<<[^>]*>>", " ", template))} | {"x"})
        whole = [w.decode() for w in licenses.words_of(re.sub("<<[^>]*>>", " ", template))]
        for _ in range(400):
            w = list(whole) if draw.random() < 0.7 else draw.choices(vocabulary, k=8)
            for _ in range(draw.randint(0, 3)):
                i = draw.randrange(len(w) + 1)
                w[i:i + draw.randint(0, 2)] = draw.choices(vocabulary, k=draw.randint(0, 2))
            for start in range(len(w)):
                joined = "".join(x + " " for x in w[start:])
                ends = [e for e in range(1, len(w) - start + 1)
                        if pattern.fullmatch("".join(x + " " for x in w[start:start + e]))]
                expected = start + max(ends) if ends else None
                assert machine.longest([x.encode() for x in w], start) == expected, (label, joined)


@pytest.mark.parametrize("bad", ["<<beginOptional>>a<<endOptional>>", "a <<beginOptional>>b", "a<<endOptional>>",
                                 "<<var;name=x;original=;max=3>> a"])
def test_refused_templates(bad):
    with pytest.raises(ValueError):
        licenses.compile_template(bad)


def test_labels_and_score(spark):
    docs = documents(spark, [(1, "Licensed under the Apache License, Version 2.0."), (2, "MIT"), (3, "x y Released under the MIT License."),
                             (4, "This work is licensed under the GNU General Public License, version 3.")])
    got = {r.doc_id: (r.labels, r.score) for r in licenses.labelled(licenses.scan(docs)).collect()}
    assert got == {1: ("apache", 1.0), 2: ("", 0.0), 3: ("mit", 5 / 7), 4: ("gpl", 1.0)}


def test_variables_by_match():
    words = lambda text: licenses.words_of(text)
    cases = [
        ('Copyright <<var;name=o;original=;match=".+">> All rights reserved', "copyright a b c all rights reserved", 7, "copyright all rights reserved"),
        ('Copyright <<var;name=o;match=".*">> All rights', "copyright all rights", 3, "copyright all"),
        ('the <<var;name=v;match=".{0,4}">> end', "the one two end", 4, "the a b c end"),
    ]
    for template, good, end, bad in cases:
        machine = licenses.compile_template(template)
        assert machine.longest(words(good), 0) == end and machine.longest(words(bad), 0) is None
    with pytest.raises(ValueError, match="match"):
        licenses.compile_template('the <<var;name=v;match="[A-Z]+">> end')
    with pytest.raises(ValueError, match="match"):
        licenses.compile_template("the <<var;name=v>> end")
