"""Spelling variants against brute force over all pairs, and on odd rows."""

import collections
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.llm import variants

SCHEMA = "doc_id long, text string"


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def counted(rows, p):
    total = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            total[variants.typed(run, h, p.drop) if p.drop else run] += 1
    return {w: n for w, n in total.items() if len(w) >= p.length and n >= p.count}


def brute(rows, p):
    words = counted(rows, p)
    around = {w: [v for v in words if near(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in around.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= p.ratio * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(around[w]), words.get(form.get(w))))
    return out


def found(spark, rows, p):
    got = variants.variants(spark.createDataFrame(rows, SCHEMA), p).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len({r.word for r in got})
    return {tuple(r) for r in got}


def made(seed, stems=40):
    """Words that vary from a few stems, the first of each chain ever more frequent."""
    r = random.Random(seed)
    stem = ["".join(r.choices("abcé", k=r.randint(6, 9))) for _ in range(stems)]
    rows = []
    for k in range(1500):
        w = r.choice(stem[: 1 + k % stems])
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            at = r.randrange(len(w))
            w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abcé") + w[at:], w[:at] + r.choice("abcé") + w[at + 1 :]])
        rows.append((k % 300, f"{w.capitalize()}, {w}-{w[:4]} {r.choice(stem)}"))
    return rows


@pytest.mark.parametrize("drop", [None, 7])
def test_all_pairs_are_found(spark, drop):
    rows, p = made(drop or 1), variants.Params(count=2, ratio=2, drop=drop)
    assert found(spark, rows, p) == brute(rows, p)


def test_large_tries_are_dealt_again(spark, monkeypatch):
    """A third of the words share a prefix; tries of more than a few words are split down to one place."""
    r = random.Random(5)
    words = {("prefix" if k % 3 else "") + "".join(r.choices("ab", k=r.randint(6, 8))) for k in range(400)}
    frame = spark.createDataFrame([(w, 5 + k) for k, w in enumerate(sorted(words))], "word string, n long")
    want = {(a, b) for a, b in itertools.permutations(words, 2) if near(a, b)}
    for most in (2, 5, 40, 10_000):
        got = variants.near_pairs(frame, most).collect()
        assert len(got) == len(want) and {(x.word, x.near) for x in got} == want


def test_forms_are_followed_to_their_end(spark):
    chain = [(f"word{k}", f"word{k + 1}") for k in range(23)] + [("other", "word9")]
    got = {r.word: r.root for r in variants.followed(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "word23" for w, _ in chain}


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abß", min_size=0, max_size=5), max_size=25))
def test_active_nodes(words):
    words = sorted(words)
    got = [(words[a], words[b]) for a, b in variants.Trie(words).near()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in itertools.permutations(words, 2) if near(a, b)}


def test_odd_rows(spark):
    """Nulls have no words, repeats count again, É stays and × is a letter; long texts, clashing columns, no rows."""
    p = variants.Params()
    rows = [(1, None), (2, ""), (None, "lettre×lettrE " * 6), (3, "ÉCOLES écoles " * 5), (3, "ÉCOLES écoles " * 5), (4, "a" * 90_000), (5, "letters " * 60_000), (6, "lettres lettres lettres lettres lettres")]
    assert found(spark, rows, p) == brute(rows, p)
    frame = spark.createDataFrame(rows, SCHEMA)
    clash = frame.select("*", *[F.lit(1).alias(c) for c in ("word", "n", "form", "root", "length", "key", "near")])
    assert {tuple(r) for r in variants.variants(clash, p).collect()} == brute(rows, p)
    assert variants.variants(frame.limit(0)).count() == 0
