"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd rows."""

import collections
import dataclasses
import hashlib
import math
import time
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.llm import ann, bpe, chat, decontam, graph, html, langid, neardup, queries, secrets, toxicity, warc

from ..conftest import SMALL

MEDIUM = "/root/testdata/sf0.01"
LONG = "one two three four five six seven eight nine ten eleven twelve "


def read(name, sf=SMALL):
    return pd.read_parquet(f"{sf}/{name}.parquet")


def frame(df, key):
    return df.toPandas().set_index(key)


ODD = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (None, "a b c d e f g"), (4, "x" * 70_000 + " y"), (5, "A b C d e f g"), (6, " \n\t "), (7, "٣ 日本語 🙂 é")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long and repeated texts, with extra columns of names that operators use."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.select("*", F.lit("en").alias("lang"), F.lit(9.5).alias("score"), F.lit("z").alias("ids"), F.lit(0).alias("n"), F.lit("s").alias("spans"), F.lit("k").alias("key"), F.lit(1).alias("rep"))


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, SMALL), con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert collections.Counter(map(tuple, got.select(*want.columns).collect())) == collections.Counter(want.fetchall())


# Toxicity


def test_toxicity_held_out(spark):
    got = queries.op1_toxicity(spark, "/root/testdata/sf0.1").toPandas().merge(read("labels", "/root/testdata/sf0.1"), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95 and held.score.between(0, 1).all()
    assert held.score[held.toxic == 1].median() > 0.9 > 0.2 > held.score[held.toxic == 0].quantile(0.9)


def test_toxicity_odd_rows(spark, odd, nothing):
    labelled = odd.withColumn("label", F.when(F.col("doc_id") == 1, 1).when(F.col("doc_id") == 5, 0))
    model = toxicity.fit(labelled)
    got = toxicity.score(odd, model).toPandas()
    assert len(got) == len(ODD) and got.score.between(0, 1).all() and got.score[got.doc_id == 1].nunique() == 1
    blank = toxicity.fit(nothing.withColumn("label", F.lit(1)))
    assert set(toxicity.score(odd, blank).toPandas().score) == {0.5}
    assert toxicity.score(nothing, model).count() == 0


def test_ftrl_by_the_book():
    """Against FTRL-proximal written coordinate by coordinate."""
    rng, p = np.random.default_rng(4), toxicity.Ftrl(bits=6, l1=0.4, epochs=2)
    rows = [(np.unique(rng.integers(0, 64, 9)), int(rng.integers(0, 2))) for _ in range(80)]
    z, n, bias = collections.defaultdict(float), collections.defaultdict(float), [0.0, 0.0]
    weight = lambda i: 0.0 if abs(z[i]) <= p.l1 else -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + n[i] ** 0.5) / p.alpha + p.l2)
    offset = lambda: -bias[0] / ((p.beta + bias[1] ** 0.5) / p.alpha)
    for _ in range(p.epochs):
        for index, y in rows:
            w, b = {i: weight(i) for i in index}, offset()
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - y
            for i in index:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / p.alpha
                z[i], n[i] = z[i] + g - sigma * w[i], n[i] + g * g
            bias = [bias[0] + g - ((bias[1] + g * g) ** 0.5 - bias[1] ** 0.5) / p.alpha * b, bias[1] + g * g]
    got, b = toxicity.train(rows, p)
    assert np.allclose(got, [weight(i) for i in range(64)]) and abs(b - offset()) < 1e-9


def test_toxicity_features_are_bounded(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(50)), k % 2) for k in range(40)], "doc_id long, text string, label int")
    assert toxicity.fit(docs, p=toxicity.Ftrl(features=10)).bias == 0.0 != toxicity.fit(docs.limit(39)).bias


# BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_ranks(public_tokenizers.path(queries.VOCABULARY))


@pytest.fixture(scope="module")
def own(vocabulary):
    return bpe.Codec(vocabulary, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tik(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=300), st.text(alphabet="ab", min_size=40, max_size=400), st.text(alphabet="aé中-", max_size=300), st.text(alphabet="=_ \n", max_size=200)))
def test_bpe_is_tiktoken(own, tik, text):
    ids = own.encode(text)
    assert ids.tolist() == tik.encode_ordinary(text)
    assert own.decode(ids.tolist()) == text.encode()


def test_bpe_tree_on_long_pieces(own, tik):
    for text in ("a" * 20_001, "ab" * 9_000, "=" * 30_000, "Àé" * 5_000, "xyz" * 2_345 + "a" * 5_011):
        assert own.encode(text).tolist() == tik.encode_ordinary(text)


def test_bpe_tree_joins_are_merges(own, vocabulary):
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = bytes(rng.choice([97, 98, 32, 195, 169], rng.integers(2, 120)).tolist())
        k = int(rng.integers(0, len(x) + 1))
        assert own.join(bpe.merge(x[:k], vocabulary), bpe.merge(x[k:], vocabulary)) == bpe.merge_long(x, vocabulary) == bpe.merge(x, vocabulary)


def test_bpe_odd_rows(spark, odd, nothing, tik):
    path, pattern = public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN
    got = bpe.decode(bpe.encode(odd, path, pattern), path, pattern).select("text", "ids", "decoded", "n").collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r.ids == tik.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r.n == 0
    assert bpe.encode(nothing, path, pattern).count() == 0


def test_bpe_query(spark, tik):
    got = frame(queries.op2_byte_bpe(spark, SMALL), "doc_id")
    for d, t in zip(*[read("documents")[c] for c in ("doc_id", "text")]):
        ids = tik.encode_ordinary(t or "")
        assert tuple(got.loc[d]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


# Chat

PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST] ", " [/INST]", "<", "/s>", "\\", "[", "INST]", "<<SYS>>", "<</SYS>>", "<|>", "|>", "a", "\n", "é"]), max_size=8).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), PIECES), PIECES), max_size=4))
def test_chat_round_trip(turns):
    made = [chat.render_turn(*t) for t in turns]
    assert [p[:2] for p in chat.parse("".join(m[0] for m in made))] == turns
    for (role, text), (out, a, b) in zip(turns, made):
        assert chat.unescape(out[a:b]) == text


def test_chat_escapes_only_conflicts():
    assert chat.render_turn("assistant", "a [INST] b")[0] == "<s>a [INST] b</s>"
    assert "\\" in chat.render_turn("assistant", "[INST] b")[0]


def test_chat_query_and_odd_rows(spark):
    got = frame(queries.op3_chat(spark, SMALL), "conv_id")
    rows = pd.concat([read("conversations"), pd.DataFrame(queries.FIXED_TURNS, columns=["conv_id", "turn", "role", "text"])])
    for k, g in rows.sort_values(["conv_id", "turn"]).groupby("conv_id"):
        loss = "".join(g.text[g.role == "assistant"].fillna(""))
        want = (len(g), hashlib.sha256("".join(f"{r}\n{t or ''}\n" for r, t in zip(g.role, g.text)).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got.loc[k])[:4] == want
    assert len(got) == rows.conv_id.nunique()
    odd = spark.createDataFrame([(1, 1, "assistant", None), (1, None, None, "x"), (None, 0, "user", ""), (1, 1, "assistant", None), (2, 0, "assistant", "é" * 100_000)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.render(odd.withColumn("n", F.lit(3)).withColumn("formatted", F.lit("y")))).toPandas().sort_values("n_turns")
    assert back.n_turns.tolist() == [1, 1, 3] and back.loss_chars.sum() == 100_000
    assert back.turns_sha256.iloc[2] == hashlib.sha256(b"\nx\nassistant\n\nassistant\n\n").hexdigest()
    assert chat.read_back(chat.render(odd.limit(0))).count() == 0


# Nearest neighbours


def exact(x, ids, q, k):
    s = (x * x[q]).sum(axis=1)
    s[q] = -np.inf
    return ids[np.lexsort((ids, -s))[:k]], s


def test_nearest_recall_and_scores(spark):
    rows = read("embeddings", MEDIUM)
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    got = queries.op4_nearest(spark, MEDIUM).toPandas()
    found = []
    for q in np.flatnonzero(ids % 20 == 0):
        g = got[got.query_id == ids[q]].sort_values("rank")
        want, s = exact(x, ids, q, 20)
        assert g["rank"].tolist() == list(range(1, 21)) and ids[q] not in set(g.vec_id)
        assert np.allclose(g.score, s[np.searchsorted(ids, g.vec_id)], atol=1e-12)
        found.append(len(set(want) & set(g.vec_id)) / 20)
    assert np.mean(found) >= 0.9 and set(got.query_id) == set(ids[ids % 20 == 0])


def test_nearest_with_several_blocks(spark):
    rng = np.random.default_rng(0)
    x = np.repeat(rng.standard_normal((60, 8)), 10, axis=0) * rng.uniform(0.5, 2, (600, 1)).round(1)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    p = ann.Params(k=5, sample=200, block=40, lists=4)
    got = ann.nearest(rows, lambda key: key % 7 == 0, p=p).toPandas()
    hit = 0
    for q in range(0, 600, 7):
        hit += len(set(exact(x, np.arange(600), q, 5)[0]) & set(got[got.query_id == q].vec_id))
    assert hit / (5 * len(range(0, 600, 7))) >= 0.9 and (got.groupby("query_id").size() == 5).all()


def test_nearest_rows_come_from_probed_lists(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16))
    rows = ann.usable(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"))
    index, table = ann.build(rows, ann.Params(k=10, lists=12))
    index = dataclasses.replace(index, probes=2)
    got = ann.search(table, index, rows.filter("id % 7 = 0")).toPandas()
    where = table.select("id", "list").toPandas().set_index("id")["list"]
    for q, g in got.groupby("query_id"):
        near = np.argsort(ann.squared(ann.augment(x[q][None], None), index.centroids))[0]
        depth = max(2, 1 + int((np.cumsum(index.sizes[near]) < 11).sum()))
        assert set(where[g.vec_id]) <= set(near[:depth])
        held = where.index[where.isin(near[:depth]) & (where.index != q)]
        want = held[np.argsort(-(x[held] * x[q]).sum(axis=1))[:10]]
        assert len(g) == 10 and len(set(want) & set(g.vec_id)) >= 8
    assert got.query_id.nunique() == 86


def test_nearest_recall_beyond_the_sample(spark):
    """Parameters as in the query, on well over the 8,192 vectors of a sample."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 32))[rng.integers(0, 400, 20_000)] + 0.5 * rng.standard_normal((20_000, 32))
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(20_000), "embedding": x.tolist()}))
    got = ann.nearest(rows, lambda key: key % 100 == 0).toPandas()
    hit = sum(len(set(exact(x, np.arange(20_000), q, 20)[0]) & set(got[got.query_id == q].vec_id)) for q in range(0, 20_000, 100))
    assert hit / (20 * 200) >= 0.93 and (got.groupby("query_id").size() == 20).all()


def test_scan_is_the_full_comparison():
    """Bounds that abandon nothing wrongly: with a wide test the scan finds each query's best."""
    rng = np.random.default_rng(6)
    x, q = rng.standard_normal((500, 40)), rng.standard_normal((30, 40))
    p = ann.Params(k=7, epsilon=50.0, columns=8)
    ix = ann.Index(p, float(np.sqrt((x * x).sum(axis=1).max())), x[:6], np.linalg.qr(rng.standard_normal((41, 41)))[0], 6, np.full(6, 80))
    vectors = pd.DataFrame({"id": np.arange(500), "v": list(x), "list": np.arange(500) % 6})
    asked = pd.DataFrame({"id": np.arange(1000, 1030), "v": list(q), "bound": np.inf, "lists": [[0, 2, 3]] * 30})
    got = ann.scanned(ix, vectors, asked)
    for k in range(30):
        held = np.flatnonzero(np.isin(np.arange(500) % 6, [0, 2, 3]))
        want = held[np.argsort(-(x[held] * q[k]).sum(axis=1))[:7]]
        assert got[got.query_id == 1000 + k].vec_id.tolist() == want.tolist()


def test_cells_cover_lists():
    ix = ann.Index(ann.Params(block=100), 1.0, *[np.zeros((1, 1))] * 2, 1, np.array([250, 30, 60, 20, 0, 100, 101, 5]))
    first, many = ix.cells()
    own = [set(range(f, f + m)) for f, m in zip(first, many)]
    assert many.tolist() == [3, 1, 1, 1, 1, 1, 2, 1]
    held = collections.Counter()
    for k, cells in enumerate(own):
        held.update({c: ix.sizes[k] / len(cells) for c in cells})
    assert max(held.values()) <= 110 and all(not (own[0] & o or own[6] & o) for k, o in enumerate(own) if k not in (0, 6))


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, []), (10, [0.5, 0.5]), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(0)).withColumn("list", F.lit(0))
    got = ann.nearest(df).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(1, 2), (1, 10), (2, 1), (2, 10), (10, 1), (10, 2)]
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.filter("vec_id = 10")).count() == 0


# HTML


@pytest.mark.parametrize(
    "markup, text",
    [
        (None, ""),
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>a<p>b", "a\n\nb"),
        ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
        ("<ul><li>x<li>y<ul><li>z</ul><li>w</ul>", "- x\n- y\n  - z\n- w"),
        ("<ol start=3><li>q<li>r</ol>", "3. q\n4. r"),
        ("<table><tr><td>a<td>bbbb<tr><td>ccc<td>d</table>", "a   | bbbb\nccc | d"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("x<script>var a='</p>'</script><style>p{}</style><!-- n -->y<div hidden>no</div><i style='display:none'>no</i>", "xy"),
        ("<div style='visibility: hidden'>no<p>no</p></div>&lt;ok&gt;&nbsp;&amp;", "<ok>\xa0&"),
        ("<b>A</b>B <i>C</i>", "AB C"),
        ("<blockquote>q<p>r</blockquote>s", "> q\n>\n> r\n\ns"),
        ("<a href='x>y' data-hidden=1>in</a> < 3", "in < 3"),
        ("</div></p>x<span", "x<span"),
    ],
)
def test_html_rendering(markup, text):
    assert html.render(markup) == text


@pytest.mark.parametrize(
    "markup, text",
    [
        ("<head><title>t</title><p>Hello", "Hello"),
        ("<html><head><meta charset=utf-8><style>p{}</style>\n<title>t</title>\nHello <b>you</b>", "Hello you"),
        ("<head><noscript><img src=x>no</noscript><template><p>no</template><script>no</script> \n</head><p>yes", "yes"),
        ("<head><title>t</title></body>x", "x"),
        ("a <math><mi>x</mi><mo>=</mo><mspace/><mn>1</mn></math> b", "a x=1 b"),
        ("<math><semantics><mi>x</mi><annotation encoding='application/x-tex'>\\x</annotation></semantics><mphantom><mi>no</mi></mphantom></math>", "x"),
        ("<svg><title/><desc>no</desc><defs><text>no</text></defs><g>no<path d='M0'/><text>one</text><text x=1>t<tspan>wo</tspan></text></g></svg>!", "one two !"),
        ("<svg><text display='none'>no</text><foreignObject><p>a<p>b</foreignObject></svg>", "a\n\nb"),
        ("<svg><path><p>out", "out"),
        ("a<dialog>no</dialog><dialog open>yes</dialog><dialog class='open'>no</dialog>b", "a\nyes\nb"),
        ("<pre><code>if x:\n    <span class=k>return</span>  y\n\nz</code></pre>end", "if x:\n    return  y\n\nz\n\nend"),
        ("<pre><b>a  b</b><br><br>  c</pre>", "a  b\n\n  c"),
        ("<table><tr><td colspan=2>ab<td>c<tr><td>x<td>y<td>z</table>", "ab    | c\nx | y | z"),
        ("<table><tr><td rowspan=2>tall<td>c<tr><td>x<td>y<tr><td colspan=3>wide heading</table>", "tall | c\n     | x | y\nwide heading"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a | b\n  | c\n  | d"),
        ("<table><tr><td>a<td colspan=3>over all the rest<tr><td>b<td>1<td>2<td>3</table>", "a | over all the rest\nb | 1 | 2 | 3"),
    ],
)
def test_html_shows_what_browsers_show(markup, text):
    assert html.render(markup) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<head>", "</head>", "<svg>", "</svg>", "<text>", "</text>", "<foreignObject>", "<math>", "<mi>", "</mi>", "</math>", "<semantics>", "<path/>", "<title/>", "<pre>", "</pre>", "<p>", "<table>", "<td>", "<br>", "x", " ", "\n"]), max_size=30).map("".join))
def test_html_foreign_never_fails(markup):
    assert isinstance(html.render(markup), str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<div hidden>", "</div>", "<pre>", "</pre>", "<", ">", "x", " ", "<br>", "<script>", "</script>", "<!--", "-->"]), max_size=30).map("".join))
def test_html_never_fails(markup):
    assert isinstance(html.render(markup), str)


def test_html_deep_and_long():
    assert html.render("<div>" * 20_000 + "x") == "x"
    assert html.render("<ul><li>" * 300 + "x").strip().endswith("x")
    deep = html.render("<table><tr><td>a<td>b" * 60)
    assert deep.count("a") == deep.count("b") == 60


@pytest.mark.parametrize("markup", ["<a " * 350_000, "<div>" * 200_000, '<a ">' * 200_000, "<a ='\">" * 150_000, "<ul><li>x" * 100_000, "<table><tr><td>x" * 60_000, "<p>" + "<b>x</b> " * 100_000, "<p><button>" + "<div>" * 200_000, "<svg><g>" * 120_000 + "<text>x", "<pre>" + "<b>x\n</b>" * 100_000, "<td colspan=1000>x" * 50_000])
def test_html_time_grows_with_the_markup(markup):
    began = time.process_time()
    html.render(markup)
    assert time.process_time() - began < 10


def test_html_query(spark):
    got = frame(queries.op5_html_text(spark, SMALL), "page_id")
    for i, h in zip(*[read("pages")[c] for c in ("page_id", "html")]):
        plain = re.sub(r"<script.*?</script>|<style.*?</style>|<title.*?</title>|<!--.*?-->", " ", h, flags=re.S)
        from html import unescape

        want = unescape(re.sub(r"<[^>]*>", " ", plain)).split()
        assert [w for w in got.loc[i].text.split() if w != "-"] == [w for w in want if w != "-"]


# Decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contaminated(docs, bench):
    """(words, hit words, items) of each text, by every window of every item."""
    windows = collections.defaultdict(set)
    for i, t in bench:
        w = WORD.findall((t or "").translate(ASCII))
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n and i is not None else []:
            windows[tuple(w[k : k + n])].add(str(i))
    for t in docs:
        w, hit, items = WORD.findall((t or "").translate(ASCII)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    items |= got
                    hit |= set(range(k, k + n))
        yield len(w), len(hit), sorted(items)


def test_decontamination_query(spark):
    docs = read("documents", MEDIUM)
    got = frame(queries.op6_decontamination(spark, MEDIUM), "doc_id")
    for d, (n, hit, items) in zip(docs.doc_id, contaminated(docs.text, read("benchmark", MEDIUM).values.tolist())):
        assert tuple(got.loc[d])[:5] == (n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0)
    assert got.contaminated.any()


def test_decontamination_odd_rows(spark):
    bench = [(1, LONG), (2, "Five SIX"), (3, None), (4, "..."), (None, "one"), (5, LONG.replace("six", "é")), (2, "Five SIX"), (6, "six six six six six six six six six six six")]
    texts = [LONG, LONG.upper(), None, "", "x five six y five six", "é " + LONG * 3, "six " * 25, LONG.replace("six", "É"), "five-six", "a" * 50_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, LONG), (0, "five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", F.lit(1)).withColumn("term", F.lit("t"))
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("w", F.lit(2))
    got = decontam.matches(docs, b, extra=("at",)).withColumn("h", decontam.hit_words(F.col("hits"))).collect()
    seen = collections.Counter((r.doc_id, r.n_words, r.h, tuple(sorted({p["item"] for p in r.phrases}))) for r in got)
    want = collections.Counter((d, n, h, tuple(i)) for (d, _), (n, h, i) in zip(rows, contaminated([t for _, t in rows], bench)))
    assert seen == want
    assert decontam.matches(docs, b.limit(0)).filter("size(hits) > 0").count() == 0
    assert decontam.matches(docs.limit(0), b).count() == 0


def test_near_matches(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    w = item.split()
    texts = {1: item, 2: " ".join([*w[:6], "uh", *w[6:]]), 3: " ".join(w[:5] + w[6:]), 4: " ".join([*w[:6], "uh", "er", "um", *w[6:]]), 5: " ".join(reversed(w)), 6: " ".join([*w[:4], w[5], w[4], *w[6:]]), 7: "beta"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    near = lambda slop: {r.doc_id for r in decontam.matches(docs, bench, slop=slop).filter("size(near) > 0").collect()}
    assert near(0) == {1} and near(1) == {1, 2, 6} and near(3) == {1, 2, 4, 6}
    assert {r.doc_id for r in decontam.matches(docs, bench).filter("size(hits) > 0").collect()} == {1}


def test_many_hits_in_one_text(spark):
    docs = spark.createDataFrame([(1, LONG * 20_000), (2, "x " * 20_000 + LONG)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    began = time.time()
    got = {r.doc_id: r.h for r in decontam.matches(docs, bench).select("doc_id", decontam.hit_words(F.col("hits")).alias("h")).collect()}
    assert got == {1: 240_000, 2: 12} and time.time() - began < 60


def test_ranges_are_joined(spark):
    rng = np.random.default_rng(8)
    rows = [(k, [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 60, k % 9), rng.integers(1, 9, k % 9))]) for k in range(100)]
    df = spark.createDataFrame(rows, "k int, r array<struct<a:int,b:int>>")
    for r in df.select("r", decontam.covered(F.col("r")).alias("c")).collect():
        held = {x for a, b in r.r for x in range(a, b)}
        assert {x for a, b in r.c for x in range(a, b)} == held and all(x.b < y.a for x, y in zip(r.c, r.c[1:]))


# Secrets

BASE = {"assign": (re.compile(secrets.RULES[0].pattern, re.A), 2, 12), "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18), "hex": (re.compile("[0-9a-f]+"), 0, 16)}


def secret_spans(text):
    found = []
    for order, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        found += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def test_secrets_query(spark):
    docs = read("documents", MEDIUM)
    got = frame(queries.op7_secrets(spark, MEDIUM), "doc_id")
    for d, t in zip(docs.doc_id, docs.text):
        spans = secret_spans(t)
        counts = [sum(s.startswith(k) for s in spans) for k in BASE]
        assert tuple(got.loc[d])[:4] == (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest())
        assert set(spans) <= set(got.loc[d].spans.split(","))


def test_secrets_odd_rows(spark):
    key = "AKIA" + "Q1" * 9
    texts = [None, "", f"é🙂 PassWord = 'abcdefghijkl' {key}", "token=password:longsecretlong12", "api_key: " + "a1" * 20, "APIKEY=0123456789abcdef", "secret=short token=alsoshort", "0123456789abcdef" * 3 + "g", "x" * 60_000 + " passwd=abcdefghijklmn", f"{key}{key}", "gh" + "p_" + "A" * 36, "ſecret=abcdefghijklmn"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[2]), (1, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("s")).withColumn("kinds", F.lit(1))
    got = secrets.scan(docs).select("doc_id", "x", secrets.written(F.filter("spans", lambda s: s["kind"].isin(*BASE))).alias("w"), secrets.redacted(F.col("x"), F.col("spans")).alias("r")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.w == ",".join(secret_spans(r.x)), r.x[:80]
        assert ("[REDACTED]" in r.r) == (r.r != r.x) and not secret_spans(r.r.replace("[REDACTED]", "\n"))
    assert "github" in secrets.scan(docs).filter("doc_id = 10").select(secrets.written(F.col("spans"))).first()[0]
    assert secrets.scan(docs.limit(0)).count() == 0


def test_many_secrets_in_one_text(spark):
    text = "\ufeffé🙂 " + "token: abcdefghijklm \ufeff " * 100_000
    began = time.time()
    found = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = found.select(F.size("spans").alias("n"), F.element_at("spans", -1).alias("last"), secrets.redacted(F.col("x"), F.col("spans")).alias("r")).first()
    assert got.n == 100_000 and got.last["end"] == len(text) - 3 and got.r == "\ufeffé🙂 " + "[REDACTED] \ufeff " * 100_000
    assert time.time() - began < 60


def test_overlapping_spans_are_one_stretch(spark):
    spans = "array<struct<start:int,rank:int,kind:string,end:int>>"
    rows = spark.createDataFrame([("0123456789", [(1, 0, "a", 4), (2, 1, "b", 3), (3, 2, "c", 6), (8, 0, "a", 10)]), ("0123", []), ("0123", [(0, 0, "a", 4)])], f"x string, s {spans}")
    assert [r[0] for r in rows.select(secrets.redacted(F.col("x"), F.col("s"), "*")).collect()] == ["0*67*", "0123", "*"]


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("abcd") == frozenset([frozenset(["abc", "bcd"])])
    assert q("(abc|xyz)+[0-9]*") == frozenset([frozenset(["abc"]), frozenset(["xyz"])])
    assert q("a?b") == q("[0-9a-f]{16,}") == q("x*abc?") == secrets.ANY
    assert frozenset(["aki", "kia"]) in q("AKIA[A-Z0-9]+")


@settings(max_examples=200, deadline=None)
@given(st.from_regex(re.compile(secrets.RULES[0].pattern, re.A), fullmatch=True))
def test_trigram_query_is_necessary(text):
    assert any(all(t in text.lower() for t in clause) for clause in secrets.trigram_query(secrets.RULES[0].pattern))


# Near duplicates


def linked(rows, key=lambda x: x):
    """(size, component) by comparing all pairs that share a shingle."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    where, root = collections.defaultdict(list), {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for d, s in sets.items():
        shared = collections.Counter(e for x in s for e in where[x])
        for e, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
        for x in s:
            where[x].append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_near_duplicates_query(spark):
    got = queries.op8_near_duplicates(spark, MEDIUM).toPandas()
    want = linked(read("documents", MEDIUM)[["doc_id", "text"]].values.tolist())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want
    assert (got.kept == (got.doc_id == got.component_id)).all()


def test_near_duplicates_chains_and_groups(spark):
    """Families of edited copies, some below the similarity, joined by chains; in blocks of a few rows."""
    rng = np.random.default_rng(5)
    rows, words = [], [f"w{k}" for k in range(400)]
    for family in range(4):
        base = rng.choice(words, 120).tolist()
        for _ in range(60):
            copy = list(base)
            for at in rng.choice(120, rng.integers(0, 6), replace=False):
                copy[at] = f"e{rng.integers(1_000_000)}"
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    rows.append((2, rows[0][1].upper()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df, p=neardup.Params(block=8, grid=3)).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == linked(rows)


def test_near_duplicates_odd_rows(spark, odd, nothing):
    got = neardup.near_duplicates(odd).toPandas()
    seen = [(None if pd.isna(r.doc_id) else r.doc_id, r.n_shingles, None if pd.isna(r.component_id) else r.component_id, r.kept) for r in got.itertuples()]
    want = [(1, 3, 1, True), (1, 3, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 3, None, True), (4, 1, 4, True), (5, 3, 1, False), (6, 0, 6, True), (7, 1, 7, True)]
    assert collections.Counter(seen) == collections.Counter(want)
    assert neardup.near_duplicates(nothing).count() == 0


def test_repeated_ids_link_by_one_of_their_texts(spark):
    """An id's links are those of its text with the smallest digest; another text of it joins nothing."""
    words = lambda c: " ".join(f"{c}{k}" for k in range(60))
    rows = [(1, words("a")), (1, words("b")), (5, words("a") + " x"), (6, words("b") + " x"), (1, None), (1, words("a")), (7, words("c")), (7, words("c"))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    hashed = {c: neardup.digested(neardup.shingles(words(c), 5, neardup.Words())) for c in "ab"}
    first, other = (5, 6) if hashed["a"] < hashed["b"] else (6, 5)
    assert dict(zip(got.doc_id, got.component_id)) == {1: 1, first: 1, other: other, 7: 7} and len(got) == len(rows)


def test_recall_above_the_similarity(spark):
    """Pairs between 0.75 and 0.8, where signatures differ most, are found too."""
    rng = np.random.default_rng(9)
    rows, near = [], 0
    for pair in range(400):
        base = [f"p{pair}w{k}" for k in range(300)]
        copy = list(base)
        for at in rng.choice(300, 8, replace=False):
            copy[at] = f"e{rng.integers(1 << 40)}"
        rows += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(copy))]
    want = linked(rows)
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for _, t in rows]
    near = [p for p in range(400) if 0.75 <= len(sets[2 * p] & sets[2 * p + 1]) / len(sets[2 * p] | sets[2 * p + 1]) < 0.8]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id").component_id
    assert len(near) > 100 and sum(got[2 * p + 1] == 2 * p for p in near) >= 0.98 * len(near)
    assert all(got[d] in (d, root) for d, (_, root) in want.items())


def test_signature_guarantee():
    """Any two signatures under the distance share a key."""
    p, rng = neardup.Params(), np.random.default_rng(2)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, p.symbols, np.uint16)
        b = a.copy()
        b[rng.choice(p.symbols, p.chunks * (p.errors + 1) - 1, replace=False)] ^= 1
        ka, kb = neardup.keys(a[None], p)[0][0], neardup.keys(b[None], p)[0][0]
        assert set(ka) & set(kb)


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(400, 440)] + [(None, 1), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e if x is not None}
    for _ in range(500):
        moved = False
        for a, b in edges:
            if a is not None and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                moved = True
        if not moved:
            break
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] and None not in e for e in edges)}


# Language


def test_language_held_out(spark):
    got = queries.op9_language(spark, MEDIUM).toPandas().merge(read("documents", MEDIUM), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.98 and got.score.between(0, 1).all()


def test_language_odd_rows(spark, odd, nothing):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    filters = langid.fit(docs)
    got = [(r.text, r.lang_pred) for r in langid.detect(odd, filters).collect()]
    assert len(got) == len(ODD)
    for text, lang in got:
        assert (lang == "und") == (not text or not any(map(str.isalpha, text)))
    assert langid.detect(nothing, filters).count() == 0
    assert {r.lang_pred for r in langid.detect(odd, langid.fit(nothing)).collect()} == {"und"}


def sliced(spark, rows, p):
    """Filters from (language, text) rows, and each language's n-grams."""
    langs = sorted({x for x, _ in rows})
    held = collections.Counter((x, int(g)) for x, t in rows for g in np.unique(langid.ngrams(t, p)).view(np.int64))
    total = collections.Counter(x for x, _ in rows)
    counted = spark.createDataFrame([(langs.index(x), g, n, total[x]) for (x, g), n in held.items()], "code int, gram long, n long, texts long")
    return langid.build(langid.slot_words(counted, p).toPandas(), langs, p), held, total


def test_bit_slices_are_sets(spark):
    rows = [(f"l{k:02}", f"{chr(97 + k % 26)}{chr(97 + k // 26)}zz") for k in range(70)]
    p = langid.Params(share=1e-9)
    filters, _, _ = sliced(spark, rows, p)
    assert len(filters.planes) == 2
    for k, (_, t) in enumerate(rows):
        grams = langid.ngrams(t, p)
        assert filters.hits(grams)[k] == len(grams)  # no false negatives


def test_filters_against_plain_sets(spark):
    """The languages that sets of n-grams choose, without bits, hashes of slots, or false positives."""
    docs = read("documents", MEDIUM).dropna()
    rows, p = list(zip(docs.lang, docs.text))[:300], langid.Params()
    filters, held, total = sliced(spark, rows, p)
    best = collections.defaultdict(float)
    for (x, g), n in held.items():
        best[g] = max(best[g], n / (total[x] + 1))
    kept = {x: {g for (y, g), n in held.items() if y == x and n / (total[x] + 1) >= p.share * best[g]} for x in total}
    same = 0
    for t in docs.text[300:500]:
        grams = langid.ngrams(t, p)
        if grams is not None and len(grams):
            shares = {x: sum(int(g) in kept[x] for g in grams.view(np.int64)) / len(grams) for x in total}
            same += langid.decide(t, filters)[0] == max(sorted(shares), key=shares.get)
        else:
            same += 1
    assert same >= 198


def test_a_language_of_few_texts_can_be_predicted(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").filter("lang = 'en'").limit(50).select("doc_id", "text", "lang")
    few = spark.createDataFrame([(-1, "bonjour tout le monde, comment allez vous aujourd'hui", "fr"), (-2, "le monde est beau et la vie est belle", "fr")], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "bonjour le monde"), (2, "the weather is nice and the water is warm")], "doc_id long, text string")
    for training in (docs.unionByName(few), docs.unionByName(few.limit(1))):
        got = {r.doc_id: r.lang_pred for r in langid.detect(asked, langid.fit(training)).collect()}
        assert got == {1: "fr", 2: "en"}


# WARC


def archived(rows):
    big = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            big[b] = max(i, big.get(b, i))
    for i, _, h in rows:
        b = (h or "").encode()
        to = big.get(b, i)
        yield i, len(b), hashlib.sha1(b).hexdigest(), "response" if to == i else "revisit", None if to == i else to


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    rows = [(k, "http://a b/\n", c * n) for k, (c, n) in enumerate([("x", 999), ("x", 999), ("é", 500), ("é", 500), ("é", 500), ("", 0), ("z\r\n\r\nWARC/1.1\r\n", 90_000)])] + [(7, None, None), (-3, "u", "é" * 500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("s")).withColumn("bytes", F.lit(1))
    monkeypatch.setattr(warc, "FILE_BYTES", 1)  # an archive for each record
    table = warc.chunks(warc.records(df), 1000)
    assert table.filter("length(data) > 1000").count() == 0
    big = [(r.chunk, r.seen, r.digest, r.last) for r in table.filter("page_id = 6").orderBy("chunk").collect()]
    body = rows[6][2].encode()
    assert big[0][1:3] == (1000, hashlib.sha1(body[:1000]).hexdigest()) and big[-1] == (-(-len(body) // 1000) - 1, len(body), hashlib.sha1(body).hexdigest(), True)
    manifest = warc.write(table, f"file://{tmp_path}")
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    back = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_index(manifest, 700).collect()]
    assert sorted(back, key=str) == sorted(archived(rows), key=str)
    chunked = warc.read_chunks(manifest, 700).filter("record_id like '<urn:page:6:%'").orderBy("chunk").collect()
    assert b"".join(r.data for r in chunked).decode() == rows[6][2] and all(len(r.data) <= 700 for r in chunked) and len(chunked) > 1000
    assert [r.last for r in chunked].index(True) == len(chunked) - 1 and chunked[-1].sha1 == big[-1][2]


def test_warc_groups_beyond_the_broadcast(spark, monkeypatch):
    from folioscan.llm import joins

    rows = [(k, f"u{k}", chr(97 + k % 7) * (1000 + k % 7)) for k in range(40)] + [(50, "v", "q" * 5000)]
    monkeypatch.setattr(joins, "HOT", 0)
    got = warc.read_index(warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(archived(rows), key=str)


def test_warc_reads_plain_files(tmp_path):
    body = warc.head("urn:page:5", "http://x/", hashlib.sha1(b"hi").hexdigest(), 2, None) + b"hi\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(body * 2)
    got = list(warc.read(f"file://{tmp_path}/a.warc", 64))
    assert [r["data"] for r in got] == [b"hi", b"hi"] and got[0]["sha1"] == hashlib.sha1(b"hi").hexdigest()
    (tmp_path / "b.warc").write_bytes(body[:-5])
    with pytest.raises(ValueError):
        list(warc.read(f"file://{tmp_path}/b.warc", 64))


def test_warc_has_a_record_for_every_row(spark):
    big = "é" * 600
    rows = [(1, "u", "a"), (1, "u", "b"), (None, "u", "c"), (1, "u", "a"), (2, "u", big), (2, "v", big), (2, "v", big), (None, None, big), (None, "w", "k" * 2000), (None, "w", "k" * 2000)]
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_index(warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect())
    assert got == collections.Counter({(1, 1, "response", None): 3, (None, 1, "response", None): 1, (2, 1200, "response", None): 1, (2, 1200, "revisit", 2): 2, (None, 1200, "revisit", 2): 1, (None, 2000, "response", None): 1, (None, 2000, "revisit", None): 1})
    assert warc.read_index(warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0))).count() == 0


def test_joins_are_exact(spark):
    from folioscan.llm import joins

    rows = spark.range(1000).select(F.when(F.col("id") % 10 != 0, F.col("id") % 300).alias("k"), F.col("id").alias("at"))
    table = spark.createDataFrame([(k, k * 7, 4) for k in range(0, 400, 3)] + [(None, -1, 1)], "k long, w long, count long")
    want = collections.Counter((r.k, r.at, (-1 if r.k is None else r.k * 7) if r.k is None or r.k % 3 == 0 else None) for r in rows.collect())
    plain, met = joins.lookup(rows, ["k"], table.drop("count"))
    assert collections.Counter(map(tuple, plain.withColumn("w", F.lit(None).cast("long")).unionByName(met).select("k", "at", "w").collect())) == want
    held = collections.Counter((k, at) for (k, at, w), _ in want.items() if w is not None)
    assert collections.Counter(map(tuple, joins.only(rows, ["k"], table).collect())) == held
    assert joins.without(rows, ["k"], table).count() == 1000 - sum(held.values())
    known = table.filter("k is not null")
    for hot in (0, 20, 10_000):
        joins.HOT = hot
        got = joins.by_class(rows, "k", known, "at").collect()
        assert collections.Counter((r.k, r.at, r.w) for r in got) == collections.Counter((k, at, w if k is not None else None) for k, at, w in want.elements())
    joins.HOT = 50_000


@settings(max_examples=800, deadline=None)
@given(st.text(st.characters(max_codepoint=127), max_size=60))
def test_parts_of_ascii_texts(text):
    """The faster module finds the same parts."""
    import regex

    c = bpe.Codec({bytes([k]): k for k in range(256)}, public_tokenizers.PATTERN)
    assert c.plain is not c.findall
    assert c.plain(text) == regex.findall(public_tokenizers.PATTERN, text)
    assert bpe.of_ascii(r"\p{Lu}+|\p{N}") is None and bpe.of_ascii(r"\P{L}") is None
    assert bpe.of_ascii(r"\\p[\p{L}\]]\p{N}") == r"\\p[A-Za-z\]][0-9]"


def test_languages_are_learned_from_every_row(spark):
    """Each text has a word of its own, and the filters hold them all, however many texts a language has."""
    word = lambda k: "".join(chr(0x4E00 + k // 90**j % 90) for j in range(2)) + "z"
    rows = spark.createDataFrame([(k, word(k), "xx") for k in range(4000)], "doc_id long, text string, lang string")
    filters = langid.fit(rows)
    missed = [k for k in range(4000) if (g := langid.ngrams(word(k), filters.p)) is None or filters.hits(g)[0] < len(g)]
    assert missed == []
