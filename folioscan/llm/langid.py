"""Language identification by language-bitmask n-gram filters.

Training counts the distinct character n-grams of all texts per language and keeps, for each
language, those whose rate there is at least ``share`` of their highest rate in any language. A rate of n
texts among t is ``n / (t + 1)``, so that a language of few texts counts for less. The
kept n-grams, all of them, enter Bloom filters that are stored bit-sliced: slot ``s`` holds one bit per language,
so that the AND of an n-gram's slots is the set of all languages that contain it. A text's n-grams
give a count of hits per language; a count is corrected for the filter's false positives,
``(hits / n - f) / (1 - f)``, and the language with the largest corrected share is the answer.
``floors`` gives the share below which a text is taken to be in no learned language: for each language,
a low quantile of the training texts that were recognised, less some slack.

Defined results: a null text, or one without a letter, is ``und`` with score 0; texts without
learned n-grams go to the first language of equal shares by name; rows without a language do not
train; with no language learned every text is ``und``. Up to 63 languages share a slot's word;
more use several planes. The slots of a filter are fixed, so what reaches the driver is bounded by
``2 ** slots`` words for each plane, however many n-grams there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, released, slices, stored, trim

UND = "und"
#: Languages of one plane: the bits of a signed 64-bit word but its sign.
PLANE = 63
#: Whether a code point is a letter; the last entry stands for those beyond the two first planes.
LETTER = np.array([chr(c).isalpha() for c in range(0x20000)] + [True])


@dataclass(frozen=True)
class Params:
    sizes: tuple[int, ...] = (1, 3)
    slots: int = 20
    probes: int = 2
    share: float = 0.25
    clean: float = 0.001
    slack: float = 0.8


@dataclass(frozen=True)
class Filters:
    p: Params
    langs: list[str]
    planes: list[np.ndarray] = field(default_factory=list)
    false: np.ndarray | None = None

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """For each language, how many of the n-grams its filter contains."""
        at = places(grams, self.p)
        out = np.zeros(len(self.langs), np.int64)
        for k, plane in enumerate(self.planes):
            mask = plane[at[0]]
            for more in at[1:]:
                mask = mask & plane[more]
            for j in range(PLANE * k, min(PLANE * (k + 1), len(self.langs))):
                out[j] = np.count_nonzero(mask & plane.dtype.type(1 << j - PLANE * k))
        return out


def places(grams: np.ndarray, p: Params) -> list[np.ndarray]:
    """The slots of each n-gram: disjoint bit ranges of its mixed 64-bit code."""
    low = np.uint64((1 << p.slots) - 1)
    return [((grams >> np.uint64(p.slots * k)) & low).astype(np.uint32) for k in range(p.probes)]


def ngrams(text: str | None, p: Params) -> np.ndarray | None:
    """Mixed codes of a text's character n-grams within words, lower-cased; None without a letter.

    Whatever isn't a letter bounds words, and runs of it count as one bound; n-grams may begin or end
    with a bound.
    """
    if not text or not any(map(str.isalpha, text)):
        return None
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = LETTER[np.minimum(chars, len(LETTER) - 1)]
    chars = np.where(letter, chars, np.uint32(32))
    keep = np.ones(len(chars), bool)
    keep[1:] = letter[1:] | letter[:-1]
    chars = np.concatenate([[32], chars[keep], [32]]).astype(np.uint64)
    out = []
    for n in p.sizes:
        if len(chars) >= n:
            code = chars[: len(chars) - n + 1] + np.uint64(n << 56)
            inner = np.ones(len(code), bool)
            for k in range(1, n):
                part = chars[k : len(chars) - n + 1 + k]
                code = code * np.uint64(0x9E3779B97F4A7C15) + part
                if k < n - 1:
                    inner &= part != 32
            out.append(code[inner])
    return mix64(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def build(words: pd.DataFrame, langs: list[str], p: Params = Params()) -> Filters:
    """Filters from rows (plane, slot, word): the bits of the plane's languages in a slot."""
    if not langs:
        return Filters(p, [])
    planes = [np.zeros(1 << p.slots, np.uint8 if len(langs) <= 8 else np.uint64) for _ in range(-(-len(langs) // PLANE))]
    for plane in range(len(planes)):
        got = words[words.plane == plane]
        planes[plane][got.slot.to_numpy(np.int64)] = got.word.to_numpy(np.int64).astype(planes[plane].dtype)
    # A filter answers wrongly when all probes of a foreign n-gram are set: its fill to the power of the probes.
    false = np.array([np.count_nonzero(planes[j // PLANE] & planes[0].dtype.type(1 << j % PLANE)) / (1 << p.slots) for j in range(len(langs))]) ** p.probes
    return Filters(p, langs, planes, false)


def decide(text: str | None, filters: Filters) -> tuple[str, float]:
    grams = ngrams(text, filters.p)
    if grams is None or not filters.langs:
        return UND, 0.0
    if not len(grams):
        return filters.langs[0], 0.0
    share = np.clip((filters.hits(grams) / len(grams) - filters.false) / (1 - filters.false), 0, 1)
    k = int(np.argmax(share))
    return filters.langs[k], float(share[k])


def trained(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, x): the rows that train, all that have a language and a text."""
    return docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("x"))


def slot_words(counted: DataFrame, p: Params) -> DataFrame:
    """(plane, slot, word) of counts (code, gram, n, texts): for each language's code how many of its texts hold an n-gram."""
    rated = counted.withColumn("rate", F.col("n") / (F.col("texts") + 1))
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("code", "rate")).alias("each"))  # a row for each language at most
    kept = best.select("gram", F.explode(F.filter("each", lambda e: e["rate"] >= p.share * F.col("best"))).alias("e")).select("gram", F.col("e.code").alias("code"))
    masks = kept.groupBy("gram", F.floor(F.col("code") / PLANE).cast("int").alias("plane")).agg(F.bit_or(F.expr(f"shiftleft(1L, code % {PLANE})")).alias("word"))
    slot = F.explode(F.array(*[F.shiftrightunsigned("gram", p.slots * k).bitwiseAND((1 << p.slots) - 1) for k in range(p.probes)]))
    return masks.select("plane", "word", slot.alias("slot")).groupBy("plane", "slot").agg(F.bit_or("word").alias("word")).select("plane", "slot", "word")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", p: Params = Params()) -> Filters:
    """Learn filters from every row of each language.

    Counting and filling the slots are distributed aggregates; the driver gets the filled slots.
    """
    rows = trained(docs, text, lang)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in parts:
            at = 0
            for part in slices(batch.column("x")):
                for x, t in zip(batch.column("lang")[at : at + len(part)].to_pylist(), part.to_pylist()):
                    grams = ngrams(t, p)
                    if grams is not None:
                        got.setdefault(x, []).append(np.unique(grams))
                        size += len(got[x][-1])
                at += len(part)
                if size > 1 << 20:  # partial counts, so that a task holds a bounded number
                    yield from told(got)
                    got, size = {}, 0
        yield from told(got)

    def told(got: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for x, each in got.items():
            gram, n = np.unique(np.concatenate(each), return_counts=True)
            # The last row tells how many texts were read.
            gram, n, text = np.append(gram.view(np.int64), 0), np.append(n, len(each)), np.append(np.zeros(len(n), bool), True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x] * len(n), pa.string()), "text": pa.array(text), "gram": pa.array(gram), "n": pa.array(n)})

    counted = stored(rows.select("lang", "x").mapInArrow(count, "lang string, text boolean, gram long, n long").groupBy("lang", "text", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counted.filter("text").select("lang", F.col("n").alias("texts")).orderBy("lang").collect()  # a row for each language
    langs = [r["lang"] for r in totals]
    if not langs:
        return Filters(p, [])
    known = docs.sparkSession.createDataFrame([(r["lang"], k, r["texts"]) for k, r in enumerate(totals)], "lang string, code int, texts long")
    words = slot_words(counted.filter("not text").join(F.broadcast(known), "lang"), p).toPandas()
    return build(words, langs, p)


def detect(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def decided(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = sent.value
        with released():
            for batch in parts:
                for part in slices(batch):
                    lang, score = zip(*[decide(x, f) for x in part.to_pylist()]) if len(part) else ((), ())
                    yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])
                trim()

    # Not to be evaluated again by a filter on its result.
    found = docs.withColumn("_lang", decided.asNondeterministic()(F.col(text)))
    return found.withColumn("lang_pred", F.col("_lang.lang_pred")).withColumn("score", F.col("_lang.score")).drop("_lang")


def floors(docs: DataFrame, filters: Filters, text: str = "text", lang: str = "lang") -> dict[str, float]:
    """The least score of a text in each language, learned from the texts that trained and were recognised."""
    p = filters.p
    rows = trained(docs, text, lang)
    right = detect(rows, filters, "x").filter(F.col("lang_pred") == F.col("lang"))
    return {r[0]: p.slack * r[1] for r in right.groupBy("lang").agg(F.percentile("score", F.lit(p.clean))).collect()}


def known(least: dict[str, float]) -> Column:
    """Whether a detected row is in a learned language: its score isn't 0, nor below its language's floor."""
    floor = F.create_map(*[F.lit(v) for x in least.items() for v in x])[F.col("lang_pred")] if least else F.lit(0.0)
    return (F.col("lang_pred") != UND) & (F.col("score") > 0) & (F.col("score") >= F.coalesce(floor, F.lit(0.0)))
