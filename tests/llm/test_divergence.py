"""Divergence of sources against whole numbers of unbounded size, and on odd rows."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import divergence

SCHEMA = "doc_id long, lang string, source string, text string"


def brute(rows, p=divergence.Params()):
    """The contract over every group and kept term, in Python's integers."""
    counts, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for _, lang, source, text in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {x for x, _ in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= p.docs)
        own = sorted(s for x, s in groups if x == lang)
        total = collections.Counter()
        for s in own:
            total.update({t: n for t, n in counts[lang, s].items() if t in set(kept)})

        def shares(c):
            N = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (N + 2 * len(kept)) for t in kept}

        every, q = {s: shares(counts[lang, s]) for s in own}, shares(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(sum(f(every[s][t], every[o][t]) for t in kept), o) for o in own if o != s]
            marks = [(f(every[s][t], q[t]), t) for t in kept if counts[lang, s][t] and every[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", marks, p.top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ranked)}
    return out


def audited(spark, rows, p=divergence.Params()):
    found = divergence.audit(spark.createDataFrame(rows, SCHEMA), p).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


def made(n, sources, seed):
    """Documents whose sources have words of their own and in common, one source and one word being frequent."""
    r = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}é" for k in range(90)]
    for k in range(n):
        source = "big" if r.random() < 0.34 else f"s{r.randrange(sources)}"
        at = r.randrange(60)
        text = " ".join(r.choice(["the", *words[at : at + 12]]) for _ in range(r.randrange(40)))
        yield k, r.choice(["en", "de"]), source, text.title() if k % 3 else text


@pytest.mark.parametrize("rare", [1, 2, 4, 50])
def test_parts_add_up(spark, rare):
    """Whatever counts as rare, all pairs and terms are those of brute force."""
    rows = list(made(400, 9, rare))
    assert audited(spark, rows, divergence.Params(docs=5, rare=rare)) == brute(rows, divergence.Params(docs=5))


def test_many_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 4)
    monkeypatch.setattr(divergence, "CHUNK", 7)
    rows = list(made(500, 17, 3))
    assert audited(spark, rows, divergence.Params(docs=4, rare=3)) == brute(rows, divergence.Params(docs=4))


def test_odd_rows(spark):
    """Nulls are empty strings, groups without terms have pairs, repeats count, a language without kept terms has pairs of 0; clashes and no rows."""
    rows = [(1, None, None, "a b"), (2, "x", "s", None), (3, "x", "t", ""), (4, "x", None, "éß Abc"), (4, "x", None, "éß Abc"), (None, "y", "s", "one"), (5, "x", "u", "abc " * 40_000)]
    for docs in (1, 2, 9):
        p = divergence.Params(docs=docs)
        assert audited(spark, rows, p) == brute(rows, p)
    frame = spark.createDataFrame(rows, SCHEMA)
    clash = frame.select("*", F.lit(1).alias("term"), F.lit("v").alias("value"), F.lit(2).alias("rank"), F.lit(3).alias("part"), F.lit(4).alias("n"), F.lit(5).alias("total"))
    assert {tuple(r) for r in divergence.audit(clash, divergence.Params(docs=1)).collect()} == brute(rows, divergence.Params(docs=1))
    assert divergence.audit(frame.limit(0)).count() == 0


def test_large_counts_are_exact():
    n = np.array([0, 1, 3 * 10**15, 8 * 10**15 - 7], np.int64)
    total = np.int64(8 * 10**15 + 3)
    assert divergence.share(n, total).tolist() == [1 + 10**9 * (int(x) + 2) // int(total) for x in n]


def test_share_in_sql(spark):
    rows = spark.createDataFrame([(3, 17), (0, 5), (8 * 10**15 - 7, 8 * 10**15 + 3)], "n long, total long")
    for r in rows.withColumn("p", F.expr(divergence.share_sql("n", "total"))).collect():
        assert r.p == 1 + 10**9 * (r.n + 2) // r.total
