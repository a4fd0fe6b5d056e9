import random
import time
from collections import Counter

import pytest

from sessionloom.llm import licences as L

from .samples import AWKWARD, docs, prose

MIT = next(t for n, t in L.TEMPLATES if n == "MIT" and len(t) > 200)
ROWS = [
    *AWKWARD,
    (20, "Licensed under CC BY-NC 4.0.\n" + prose(200, 1)),
    (21, prose(50, 2) + "\nRELEASED!! UNDER!! THE!! MIT!! LICENSE!!\n" + prose(50, 3)),
    (22, prose(30, 4) + MIT.replace("Software", "Program", 1).replace("free of charge", "free  of\ncharge") + prose(30, 5)),
    (23, "Licensed under the Apache License, Version 2.0. " * 3),
    (24, "licensed under something else entirely"),
    (25, "This work is licensed under the GNU General Public License, version 3. " + prose(20) + " Released under the MIT License."),
]


def best_dice(text, templates, least):
    """By every stretch of words and every template."""
    w = L.words(text)
    grams = list(zip(w, w[1:], strict=False))
    top = (0.0, None)
    for name, t in templates:
        tw = L.words(t)
        tg = Counter(zip(tw, tw[1:], strict=False))
        size = sum(tg.values())
        for i in range(len(grams)):
            seen, shared = Counter(), 0
            for j in range(i, min(len(grams), i + 3 * size)):
                seen[grams[j]] += 1
                shared += seen[grams[j]] <= tg[grams[j]]
                d = 2 * shared / (j - i + 1 + size)
                if d >= least and d > top[0] + 1e-12:
                    top = (d, name)
    return top


def test_against_every_stretch(spark):
    got = {r.doc_id: r for r in L.scan(docs(spark, ROWS)).collect() if r.doc_id and r.doc_id >= 20}
    for i, text in ROWS:
        if i and i >= 20:
            dice, name = best_dice(text, L.TEMPLATES, L.LEAST)
            assert abs(got[i].dice - dice) < 1e-9, i
            assert (got[i].licence is None) == (name is None)
    assert got[20].licence == "CC-BY-NC-4.0" and got[21].licence == "MIT" and got[22].licence == "MIT" and got[24].licence is None
    assert len(got[23].matches) == 3 and {m.licence for m in got[25].matches} == {"GPL-3.0", "MIT"}


def test_awkward_and_empty(spark):
    d = docs(spark, AWKWARD)
    got = L.scan(d).collect()
    assert len(got) == len(AWKWARD) and {(r.licence, r.dice) for r in got} == {(None, 0.0)}
    assert L.scan(d.where("false")).count() == 0


def every_match(text, templates, least):
    """By all stretches of the text: for each start the best, then the longest;
    of overlapping ones the highest Dice, the longer, the first name, the first."""
    w, found = L.words(text), []
    for name, t in templates:
        tw = L.words(t)
        own = Counter(zip(tw, tw[1:], strict=False))
        for i in range(len(w) - 1):
            best = None
            for j in range(i + 1, len(w)):
                here = Counter(zip(w[i:j], w[i + 1 : j + 1], strict=False))
                dice = 2 * sum((here & own).values()) / (j - i + len(tw) - 1)
                if (w[i], w[i + 1]) in own and (w[j - 1], w[j]) in own and dice >= least and (best is None or dice >= best[0]):
                    best = (dice, j - i)
            if best:
                found.append((*best, name, i))
    kept = []
    for dice, n, name, i in sorted(found, key=lambda m: (-m[0], -m[1], m[2], m[3])):
        if all(i + n < a or i > a + b for _, _, a, b in kept):
            kept.append((name, dice, i, n))
    return sorted((name, round(dice, 9), i, i + n + 1) for name, dice, i, n in kept)


SMALL = [("a", "one two three four five six"), ("b", "one two three four nine ten"), ("c", "alpha beta"), ("d", "two two two two")]


@pytest.mark.parametrize("seed", range(30))
def test_all_matches_by_brute_force(seed):
    r = random.Random(seed)
    text = " ".join(r.choice("one two three four five six nine ten alpha beta x".split()) if r.random() < 0.3 else r.choice([t for _, t in SMALL]) for _ in range(7))
    got = L.Templates(SMALL, 0.6).find(text)
    assert sorted((n, round(d, 9), s, e) for n, d, s, e in got) == every_match(text, SMALL, 0.6)


def test_names_and_versions_are_told_apart():
    table = L.Templates(L.TEMPLATES)
    for name, text in L.TEMPLATES:
        found = table.find("before it all " + text.upper() + " after it all")
        assert [(n, round(d, 9)) for n, d, _, _ in found] == [(name, 1.0)], name
    gpl2 = next(t for n, t in L.TEMPLATES if n == "GPL-2.0" and len(t) > 200)
    assert table.find(gpl2.replace("any later version", "any newer version"))[0][0] == "GPL-2.0"


def test_words_by_hash():
    table = L.Templates(L.TEMPLATES)
    texts = [None, "", "MIT", *(t for _, t in ROWS if t), "“Licensed” under_the MIT—licence ½ ₂ ñlicense İstanbul license\u0301", "\ud800 license"]
    for t, ids in zip(texts, table.ids_of(texts), strict=True):
        assert ids.tolist() == [table.vocabulary.get(w, -1) for w in L.words(t)]
    assert table.all_of(texts) == [table.find(t) for t in texts]


def test_a_text_of_notices_alone():
    """Work follows the text's length, not its square: every notice is found."""
    bsd = max((t for n, t in L.TEMPLATES if n == "BSD-3-Clause"), key=len)
    n = len(L.words(bsd))
    began = time.perf_counter()
    found = L.Templates(L.TEMPLATES).find((bsd + "\n") * 150)
    assert found == [("BSD-3-Clause", 1.0, k * n, (k + 1) * n) for k in range(150)]
    assert time.perf_counter() - began < 20
