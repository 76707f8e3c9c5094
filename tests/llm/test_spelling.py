"""Spelling variants against all pairs of words."""

import random
import zlib
from collections import Counter

import pytest
from conftest import az

from tabulon.llm import spelling as sp


def brute_words(rows, letters=5, least=3):
    counts = Counter()
    for doc, text in rows:
        run = ""
        for c in az(text) + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c
            elif run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
                run = ""
    return {w: n for w, n in counts.items() if len(w) >= letters and n >= least}


def one_edit(a, b):
    """By trying all edits of the longer one."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def near_by_holes(words):
    """Words that are equal but for a hole in the place of one letter, or beside one letter too many."""
    holes, near = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), set()).add(w)
            if w[:i] + w[i + 1 :] in near:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    return {w: sorted(v) for w, v in near.items()}


def brute(rows, letters=5, least=3):
    words = brute_words(rows, letters, least)
    near = {w: [v for v in words if one_edit(w, v)] for w in words} if len(words) < 500 else near_by_holes(words)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def found(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def variants(rng, word, n):
    """The word with random edits, some at doubled letters."""
    out = [word]
    for _ in range(n):
        w = rng.choice(out)
        i = rng.randrange(len(w))
        out.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abéx") + w[i:], w[:i] + rng.choice("abéx") + w[i + 1 :], w[:i] + w[i] + w[i:]]))
    return out


def test_variants_against_all_pairs(spark):
    rng = random.Random(3)
    words = []
    for base in ["aaaaaa", "banana", "letter", "Ünïcödé", "bookkeeper", "abcabc", "x" * 62, "ab" * 33, "z" * 200]:
        for w in variants(rng, base, 18):
            words += [w] * rng.choice([1, 3, 3, 4, 6, 9, 20, 60])
    rng.shuffle(words)
    docs = [(i, rng.choice([" ", ", ", "7", "_"]).join(words[i::40])) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute(docs)
    assert len(want) > 60 and any(r[1] != r[2] for r in want if r[1])
    assert found(sp.spelling_variants(df)) == want


def test_awkward_texts(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert found(sp.spelling_variants(awkward)) == brute(rows)
    assert found(sp.spelling_variants(awkward, least_letters=4, least_count=2)) == brute(rows, 4, 2)
    assert sp.spelling_variants(nothing).count() == 0


def test_very_long_words(spark):
    """Runs of 4,000 letters, of which each loses one: rotations as texts would take 32 MB a word."""
    rng = random.Random(8)
    long = "".join(rng.choices("abcdef", k=4_000))
    other = long[:2_000] + "z" + long[2_001:]
    docs = [(i, t) for i, t in enumerate([long] * 8 + [other] * 3 + [long[1:]] * 3)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(sp.spelling_variants(rows)) == brute(docs)


@pytest.mark.parametrize("alphabet,size", [("ab", 7), ("aé", 5)])
def test_all_words_of_a_small_alphabet(spark, alphabet, size):
    """Ranges as full as they get: every word up to a length."""
    words, level = [], [""]
    for _ in range(size):
        level = [w + c for w in level for c in alphabet]
        words += level
    docs = [(7, " ".join(words)), (8, " ".join(words[::3])), (9, " ".join(words[::2]))]
    got = found(sp.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), least_letters=1, least_count=1))
    assert got == brute(docs, 1, 1)


def test_both_plain_versions_agree():
    rng = random.Random(6)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 5))): 1 for _ in range(200)}
    assert near_by_holes(words) == {w: sorted(v for v in words if one_edit(w, v)) for w in words}


def test_one_edit():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choices("ab", k=rng.randint(0, 6)))
        b = "".join(rng.choices("ab", k=rng.randint(0, 6)))
        assert sp.is_one_edit(a, b) == (a != b and one_edit(a, b)), (a, b)
