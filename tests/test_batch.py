"""Tables of queries against one query at a time, and related papers of all papers against one seed at a time."""

import math
import random

import pytest

from folioscan.config import Config
from folioscan.operators import batch as bt
from folioscan.operators import index as ix
from folioscan.operators import search as se

KINDS = "id string, title string, abstract string, authors array<string>, categories array<string>, published string, updated string"
QUERIES = [
    "alpha beta", "alpha -beta", "-beta alpha alpha", "ti:alpha", 'ti:"alpha beta"', 'title:"beta alpha', '"alpha beta"', "cat:cs.lg gamma", "cat:cs.CL", "cat:cs.CL cat:cs.lg", "-cat:cs.CL", "", None,
    "-alpha", "nothing here", "al-pha", "AU:name1 beta", "all:gamma-delta", "abs:alpha ti:beta", 'x:alpha "', "ti: alpha", "ti:", "-", "- alpha", '-"alpha beta" gamma', "Älpha", "alpha zzz", 'alpha"beta gamma"', "  alpha　beta ",
    "alpha\nbeta\tgamma", 'cat:"cs.LG" delta', "a b c", "name1 name2", "delta", "ti:\"alpha\"", "abstract:\"alpha beta\" -ti:gamma",
]


@pytest.fixture(scope="module")
def many(spark):
    r, words = random.Random(3), "alpha beta gamma delta epsilon".split()
    common = [f"word{k:02}" for k in range(60)]
    rows = []
    for k in range(260):
        text = [r.choice(words) for _ in range(r.randrange(6))] + [r.choice(common) for _ in range(r.randrange(8))] + [f"own{k % 40}"] * (k % 4)
        cats = ["cs.LG"] if k % 3 else ["cs.CL", "cs.AI"]
        rows.append((f"2{k % 9}01.{k:05}", " ".join(text[:4]), " ".join(text), [f"Name{k % 5}"], cats, f"20{k % 9 + 10}-0{k % 9 + 1}-11", ""))
    return ix.build(spark.createDataFrame(rows, KINDS), Config(docs_per_chunk=32, docs_per_zone=64, block=8))


def test_queries_are_parsed_alike(spark):
    r = random.Random(1)
    bits = ["alpha", "b", "ti:", "cat:", "au:", "-", '"', " ", " ", "é", "1999", "12", "c++", "Fine-Tuning", "zz:", "　", "\t", ":", "CS.ai"]
    texts = [t or "" for t in QUERIES] + ["".join(r.choices(bits, k=r.randrange(9))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", bt.parsed(bt.F.col("text")).alias("q")).collect()
    for row in rows:
        want = se.parse_query(texts[row.n])
        assert [(t.term, t.fields, t.negated) for t in row.q.terms] == [(t.term, t.fields, t.negated) for t in want.terms], texts[row.n]
        assert row.q.categories == want.categories, texts[row.n]
        bound = [p for p in want.phrases if any(t.phrase == p and t.fields == ix.TITLE for t in want.terms)]
        assert set(row.q.phrases) == set(bound), texts[row.n]


@pytest.mark.parametrize("filters", [se.Filters(), se.Filters(sort="oldest"), se.Filters(sort="newest", since="2012-01-01", until="2016-12-31"), se.Filters(categories=["CS.AI"])])
def test_a_log_gives_what_each_query_gives(spark, many, filters):
    some = QUERIES if filters == se.Filters() else QUERIES[5:12:2]
    asked = spark.createDataFrame(list(enumerate(some)), "query_id int, text string")
    got, totals = {}, {r.query_id: tuple(r)[1:] for r in bt.log_totals(many, asked, filters, 5).collect()}
    for row in bt.search_log(many, asked, filters, 5).collect():
        got.setdefault(row.query_id, []).append(tuple(row)[1:])
    for k, text in enumerate(some):
        want = [tuple(r) for r in se.search(many, text or "", filters, limit=5).collect()]
        assert sorted(got.get(k, [])) == sorted(want), text
        if se.parse_query(text or "").positive:
            assert totals[k][1] and (k % 6 or totals[k] == tuple(se.totals(many, text, filters, limit=5).first())), text
        else:
            assert k not in totals


def test_a_log_beyond_the_candidates(spark, many, monkeypatch):
    for module in (bt, se):
        monkeypatch.setattr(module, "CANDIDATES", 7)
    texts = ["alpha", "alpha beta", "gamma -delta"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    got, totals = bt.search_log(many, asked, limit=9).collect(), bt.log_totals(many, asked, limit=9).collect()
    for k, text in enumerate(texts):
        best = se.best(many, se.parse_query(text), many.manifest.first().doc_count, 7)
        assert {r.doc_id for r in got if r.query_id == k} == {r.doc_id for r in best.collect()}
        assert [r.total_known for r in totals if r.query_id == k] == [False]


def test_hits_that_cannot_compete_are_not_made(spark, many, monkeypatch):
    texts = ["alpha", "beta", "alpha beta", "ti:gamma", "own3"]
    log = bt.read_log(spark.createDataFrame(list(enumerate(texts)), "query_id int, text string"))

    def found():
        rows = bt.candidates(many, *bt.asked_terms(many, log, many.manifest.first().doc_count)).collect()
        return {k: sorted((-r.score, r.doc_id, r.mask) for r in rows if r.query_id == k) for k in range(len(texts))}

    every = found()
    for name, value in (("CANDIDATES", 7), ("GROUP", 2), ("SPAN", 1)):
        monkeypatch.setattr(bt, name, value)
    few = found()
    assert all(few[k][:7] == every[k][:7] and min(8, len(every[k])) <= len(few[k]) for k in every)
    assert sum(map(len, few.values())) < sum(map(len, every.values())) / 2


def test_one_scan_of_the_blocks(spark, many):
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "query_id int, text string")
    found = bt.search_log(many, asked)
    assert found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len([x for x in final.splitlines() if "FileScan parquet" in x and "packed#" in x]) == 1


def test_notices_are_those_of_each_query(spark, many):
    class Windowed:
        class manifest:
            @staticmethod
            def first():
                return {"abstract_cutoff": "2014-03-01", "oldest": "2010-01-01"}

    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, text string")
    got = {r.query_id: r.month for r in bt.notices(asked, "2014-03-01", "2010-01-01").collect()}
    assert got == {k: se.notice(Windowed, q or "") for k, q in enumerate(QUERIES)} and set(got.values()) == {None, "2014-03"}
    for cutoff, oldest in (("", "2010-01-01"), ("2010-01-01", "2010-01-01")):
        assert {r.month for r in bt.notices(asked, cutoff, oldest).collect()} == {None}


def test_empty_logs(spark, many):
    none = spark.createDataFrame([], "query_id int, text string")
    assert bt.search_log(many, none).count() == 0 and bt.log_totals(many, none).count() == 0


def brute(index, most, limit=6):
    """Related papers by the rules of one seed, over all postings in memory."""
    n = index.manifest.first().doc_count
    df = {r.term: r.df for r in index.terms.collect()}
    posts = {}
    for p in sorted(index.postings.collect(), key=lambda p: p.doc_id):
        posts.setdefault(p.term, []).append((p.doc_id, p.weight / 255 * 24))
    out = set()
    for d in index.docs.collect():
        places = {}
        for at, t in enumerate(se.tx.term_list(f"{d.title} {d.abstract}")):
            places.setdefault(t, []).append(at)
        known = [(-round((1 + math.log(len(p))) * max(0.05, math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))), 9), p[0], t) for t, p in places.items() if len(t) >= 4 and max(5, int(n * 0.0001 + 0.5)) <= df.get(t, 0) <= n * bt.RELATED_MOST]
        terms, score, first = sorted(known)[:20], {}, {}
        for rank, (_, _, t) in enumerate(terms):
            for doc, _ in posts[t]:
                if doc != d.doc_id and doc not in first and len(first) < most:
                    first[doc] = rank
        for w, _, t in terms:
            for doc, weight in posts[t]:
                if doc in first:
                    score[doc] = score.get(doc, 0) - w * weight
        best = sorted((-round(s, 9), first[doc], doc) for doc, s in score.items())[:limit]
        out |= {(d.doc_id, k + 1, doc, -s) for k, (s, _, doc) in enumerate(best)}
    return out


@pytest.mark.parametrize("most, share, first", [(4000, 0.03, 6), (4000, 0.3, 2), (9, 0.3, 1), (30, 0.3, 3), (2, 0.2, 20)])
def test_related_papers_of_all(many, monkeypatch, most, share, first):
    """Few admitted, frequent terms and several parts of a term included."""
    monkeypatch.setattr(bt, "RELATED_MOST", share)
    monkeypatch.setattr(bt, "SPLIT", 10)
    got = sorted((r.seed, r.rank, r.doc_id, r.score) for r in bt.related_all(many, most=most, first=first).collect())
    want = sorted(brute(many, most))
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-6)
    if share > 0.1:
        assert len(got) > 500


def test_one_seed_is_as_in_all(many, monkeypatch):
    for module in (bt, se):
        monkeypatch.setattr(module, "RELATED_MOST", 0.2)
    every = bt.related_all(many).collect()
    for seed in (0, 17, 255):
        d = many.docs.filter(f"doc_id = {seed}").first()
        one = {tuple(r) for r in se.related(many, f"{d.title} {d.abstract}", seed).collect()}
        assert {tuple(r)[1:] for r in every if r.seed == seed} == one


def test_related_papers_in_waves(many, monkeypatch, tmp_path):
    """The same result from seeds in many waves, of which only the found papers' table stays."""
    monkeypatch.setattr(bt, "RELATED_MOST", 0.3)
    want = sorted(map(tuple, bt.related_all(many, most=30, first=3).collect()))
    seen, write = [], bt.stored
    monkeypatch.setattr(bt, "stored", lambda df, name, *parts: seen.append((name, write(df, name, *parts))) or seen[-1][1])
    monkeypatch.setattr(bt, "PAIRS", 0)
    monkeypatch.setattr(bt, "PAIRS_LEAST", 5_000)
    assert sorted(map(tuple, bt.related_all(many, most=30, first=3).collect())) == want
    made = [df for name, df in seen if name in ("pairs", "alive")]
    assert len(made) >= 6 and not any(df.inputFiles() and exists(df.inputFiles()[0]) for df in made)


@pytest.mark.parametrize("most", [4000, 30])
def test_pairs_of_papers_stay_in_their_tasks(many, monkeypatch, most):
    """Over several spans of documents: no table has more than a span's best papers of a seed."""
    monkeypatch.setattr(bt, "RELATED_MOST", 0.3)
    monkeypatch.setattr(bt, "SPLIT", 64)
    seen, write = [], bt.stored
    monkeypatch.setattr(bt, "discard", lambda df: None)
    monkeypatch.setattr(bt, "stored", lambda df, name, *parts: seen.append(write(df, name, *parts)) or seen[-1])
    got = sorted((r.seed, r.rank, r.doc_id, r.score) for r in bt.related_all(many, most=most).collect())
    want = sorted(brute(many, most))
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-6)
    assert max(df.count() for df in seen) <= 260 * 5 * 6


def exists(file):
    from pathlib import Path
    from urllib.parse import unquote, urlparse

    return Path(unquote(urlparse(file).path)).exists()


def test_stored_tables_leave_no_shuffle_files(spark, tmp_path):
    from folioscan import storage

    seen, before = [], spark.conf.get(storage.CLEANUP)
    with storage.shuffles_removed(spark):
        seen.append(spark.conf.get(storage.CLEANUP))
    assert seen == ["true"] and spark.conf.get(storage.CLEANUP) == before
