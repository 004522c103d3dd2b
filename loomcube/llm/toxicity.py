"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features are lexicon densities, closeness of lexicon words to the second person, capitals, punctuation and
obfuscation rates of the whole text. The lexicon joins a fixed list with words and word beginnings that a part of
the labelled rows shows to be toxic; the trees are fitted on another part and calibrated on a third.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcube.llm import textvec as tv
from loomcube.llm.common import map_arrow, materialise, text_blocks

U = np.uint64
#: Labelled rows that anything is fitted on, chosen by hash of doc_id; entries of the learnt lexicon.
SAMPLE_ROWS, LEXICON_ROWS = 20_000, 3_000
#: Insults, and words of the second person, in English, French, German and Spanish.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers trash garbage scum clown pathetic worthless disgusting "
    "imbecile fool foolish jerk creep freak ugly filthy vermin coward liar "
    "idiote crétin imbécile connard salaud ordure minable débile "
    "trottel dummkopf abschaum versager widerlich blöd arschloch "
    "idiota imbécil estúpido basura asqueroso inútil payaso"
).split()
SECOND_PERSON = (
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer "
    "tú ti usted ustedes vosotros"
).split()
#: Bytes of a word's beginning that the learnt lexicon may hold.
STEMS = range(4, 12)
NEAR = 5
FEATURES = [
    "fixed_density", "word_density", "word_weight", "word_best", "stem_density", "stem_weight", "stem_best",
    "near_second_person", "second_person_density", "capital_letters", "capital_words", "exclamations", "questions",
    "other_punctuation", "digits", "obfuscated", "obfuscated_hits", "words", "hits",
]
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457@$!", b"oieastasi", strict=True):
    _LEET[_a] = _b
_MARK = np.zeros(256, bool)
_MARK[list(b"*@$!.-_#")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_HASHES = {name: np.array(sorted(tv.bytes_hash(w.encode()) for w in ws), U) for name, ws in (("fixed", INSULTS), ("second", SECOND_PERSON))}


def member(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of ``x`` is among ``sorted_values``, and where."""
    if not len(sorted_values):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x, at


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 5 == 0


class Words:
    """Runs of letters and digits in lower case of a block of texts."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray) -> None:
        self.buf = buf
        self.starts, self.ends, self.bounds = tv.runs(tv.LETTER[buf], offsets)
        self.sums = tv.prefix(tv.lower(buf))
        self.hashes = tv.range_hash(self.sums, self.starts, self.ends)

    def stems(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length: the words longer than it, and the hashes of their beginnings."""
        size = self.ends - self.starts
        for n in STEMS:
            at = np.flatnonzero(size > n)
            yield at, tv.range_hash(self.sums, self.starts[at], self.starts[at] + n)


def term_counts(sample: DataFrame) -> DataFrame:
    """``kind, term, toxic, clean``: documents of the sample that hold a word (kind 0) or a beginning (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy()
            for first, end, buf, offsets in text_blocks(batch.column(0)):
                w = Words(buf, offsets)
                text = np.repeat(np.arange(first, end), np.diff(w.bounds))
                for kind, parts in ((0, [(np.arange(len(w.hashes)), w.hashes)]), (1, list(w.stems()))):
                    terms = np.concatenate([h for _, h in parts])
                    owner = np.concatenate([text[at] for at, _ in parts])
                    order = np.lexsort((owner, terms))
                    terms, owner = terms[order], owner[order]
                    new = np.ones(len(terms), bool)
                    new[1:] = (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])
                    terms, toxic = terms[new], label[owner[new]]
                    values, at = np.unique(terms, return_inverse=True)
                    bad = np.bincount(at, weights=toxic, minlength=len(values)).astype(np.int64)
                    both = np.bincount(at, minlength=len(values))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), kind, np.int32)), pa.array(values.view(np.int64)), pa.array(bad), pa.array(both - bad)], ["kind", "term", "toxic", "clean"])

    rows = map_arrow(sample.select("text", "toxic"), run, "kind int, term long, toxic long, clean long")
    return rows.groupBy("kind", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(sample: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The terms most telling of toxic documents: sorted hashes and log odds of words and of beginnings."""
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (good + 1.0))
    best = term_counts(sample).filter("toxic >= 3").withColumn("odds", odds).filter("odds > 1.5")
    best = best.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "kind", "term").limit(LEXICON_ROWS).collect()
    out = {}
    for kind, name in ((0, "word"), (1, "stem")):
        rows = sorted((r["term"] % (1 << 64), r["odds"]) for r in best if r["kind"] == kind)
        out[name] = (np.array([t for t, _ in rows], U), np.array([o for _, o in rows], np.float64))
    return out


def features(buf: np.ndarray, offsets: np.ndarray, lexicon: dict) -> np.ndarray:
    """One row of :data:`FEATURES` per text."""
    n = len(offsets) - 1
    w = Words(buf, offsets)
    count = np.diff(w.bounds)
    words, size = np.maximum(count, 1), np.maximum(np.diff(offsets), 1)
    text = np.repeat(np.arange(n), count)

    def total(flags: np.ndarray) -> np.ndarray:
        return tv.per_text(flags, w.bounds)

    def top(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        np.maximum.at(out, text, values)
        return out

    fixed, _ = member(_HASHES["fixed"], w.hashes)
    second, _ = member(_HASHES["second"], w.hashes)
    known, at = member(lexicon["word"][0], w.hashes)
    word_weight = np.where(known, lexicon["word"][1][at] if len(lexicon["word"][1]) else 0.0, 0.0)
    stem_weight = np.zeros(len(w.hashes))
    for which, hashes in w.stems():
        hit, at = member(lexicon["stem"][0], hashes)
        which, at = which[hit], at[hit]
        stem_weight[which] = np.maximum(stem_weight[which], lexicon["stem"][1][at])
    hit = fixed | known | (stem_weight > 0)
    strong = fixed | (word_weight > 2.5) | (stem_weight > 2.5)
    spots = np.flatnonzero(second)
    near = np.zeros(len(w.hashes), bool)
    if len(spots) and strong.any():
        bad = np.flatnonzero(strong)
        right = np.searchsorted(spots, bad)
        for side in (np.minimum(right, len(spots) - 1), np.maximum(right - 1, 0)):
            near[bad] |= (np.abs(spots[side] - bad) <= NEAR) & (text[spots[side]] == text[bad])
    # capitals, punctuation and digits by byte
    sums = {name: tv.per_text(table[buf].astype(np.int64), offsets) for name, table in (("upper", _UPPER), ("ascii", _ASCII), ("punct", _PUNCT), ("digit", _DIGIT))}
    bang, ask = (tv.per_text((buf == c).astype(np.int64), offsets) for c in b"!?")
    upper = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_UPPER[buf], out=upper[1:])
    capital_word = (upper[w.ends] - upper[w.starts] == w.ends - w.starts) & (w.ends - w.starts > 1)
    # obfuscation: a mark between letters, or a digit within a word, read as the letter it stands for
    starts, ends, bounds = tv.words(buf, offsets)
    mark = (_MARK | _DIGIT)[buf]
    inner = np.zeros(len(buf) + 1, np.int64)
    spot = np.zeros(len(buf), bool)
    if len(buf) > 2:
        spot[1:-1] = mark[1:-1] & _ASCII[buf[:-2]] & _ASCII[buf[2:]]
    np.cumsum(spot, out=inner[1:])
    veiled = np.flatnonzero(inner[ends] - inner[starts] > 0)
    veiled_hits = np.zeros(len(starts), bool)
    if len(veiled):  # all words at once, in a buffer without the bytes that the form leaves out
        raw = _LEET[tv.lower(buf)]
        spelt = _ASCII[raw] | (raw >= 128)
        for keep in (spelt, ~_MARK[raw] & spelt):
            place = np.zeros(len(buf) + 1, np.int64)
            np.cumsum(keep, out=place[1:])
            one, two = place[starts[veiled]], place[ends[veiled]]
            h = tv.range_hash(tv.prefix(raw[keep]), one, two)
            veiled_hits[veiled] |= (two > one) & (member(_HASHES["fixed"], h)[0] | member(lexicon["word"][0], h)[0])
    obfuscated = np.zeros(len(starts), np.int64)
    obfuscated[veiled] = 1
    letters = np.maximum(sums["ascii"], 1)
    out = [
        total(fixed) / words, total(known) / words, total(word_weight) / words, top(word_weight),
        total(stem_weight > 0) / words, total(stem_weight) / words, top(stem_weight),
        total(near) / words, total(second) / words, sums["upper"] / letters, total(capital_word) / words,
        bang / words, ask / words, (sums["punct"] - bang - ask) / size, sums["digit"] / size,
        tv.per_text(obfuscated, bounds) / words, tv.per_text(veiled_hits.astype(np.int64), bounds) / words,
        np.log1p(count), np.log1p(total(hit & strong)),
    ]
    return np.column_stack(out)


class Trees:
    """Boosted trees of fixed depth for the logistic loss, grown on quantile bins."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.12, bins: int = 48, l2: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        if not len(y):
            return self
        prior = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(prior / (1 - prior)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1)
            for level in range(self.depth):
                first, size = 2**level - 1, 2**level
                local = node - first
                best = [(0.0, -1, 0)] * size
                for j, c in enumerate(cuts):
                    wide = len(c) + 1
                    if wide < 2:
                        continue
                    cell = local * wide + binned[:, j]
                    gs = np.bincount(cell, g, size * wide).reshape(size, wide).cumsum(1)
                    hs = np.bincount(cell, h, size * wide).reshape(size, wide).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gl, hl = gs[:, :-1], hs[:, :-1]
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hl < 1) | (ht - hl < 1)] = 0
                    k = gain.argmax(1)
                    for s in range(size):
                        if gain[s, k[s]] > best[s][0] + 1e-9:
                            best[s] = (float(gain[s, k[s]]), j, int(k[s]))
                going = np.zeros(len(y), np.int64)
                for s, (_, j, k) in enumerate(best):
                    if j >= 0:
                        feature[first + s], cut[first + s] = j, cuts[j][k]
                        here = local == s
                        going[here] = binned[here, j] > k
                node = 2 * node + 1 + going
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.l2)
            self.trees.append((feature, cut, value))
            score = score + value[leaf]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = feature[node]
                node = 2 * node + 1 + ((j >= 0) & (x[rows, j] > cut[node]))
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares increasing fit of ``y`` on ``score`` (pool adjacent violators)."""
    if not len(y):
        return np.array([0.0]), np.array([0.0])
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, score sum
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def calibrate(score: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Probabilities; a hundredth of the plain logistic value keeps the order within level parts of the fit."""
    raw = np.interp(score, *knots)
    return np.clip(0.99 * raw + 0.01 / (1 + np.exp(-score)), 0.0, 1.0)


def sample_labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most :data:`SAMPLE_ROWS` learning rows ``doc_id, text, toxic, fold``: one a doc_id, of several texts the least.

    A doc_id with several labels counts as toxic if one says so.
    """
    known = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)).cast("int").alias("fold")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("doc_id", "text", "toxic", fold)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict, Trees, tuple[np.ndarray, np.ndarray]]:
    """Lexicon, trees and calibration, from the bounded sample of learning rows."""
    sample = materialise(sample_labelled(docs, labels), "toxicity-sample")
    lexicon = learn_lexicon(sample.filter("fold < 2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(buf, offsets, lexicon) for _, _, buf, offsets in text_blocks(batch.column(0))]
            x = np.concatenate(x) if x else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64())), batch.column(3)], ["toxic", "fold", "x", "doc_id"])

    rows = map_arrow(sample.filter("fold >= 2").select("text", "toxic", "fold", "doc_id"), run, "toxic int, fold int, x array<double>, doc_id long")
    table = rows.toPandas().sort_values("doc_id", kind="stable")
    x = np.array(table["x"].tolist()).reshape(len(table), len(FEATURES))
    y, fold = table["toxic"].to_numpy(float), table["fold"].to_numpy()
    trees = Trees().fit(x[fold == 2], y[fold == 2])
    return lexicon, trees, isotonic(trees.score(x[fold == 3]), y[fold == 3])


def score_documents(docs: DataFrame, model: tuple) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, scored where it is read.

    Null and empty texts have zero features and get the score of these. Repeated rows get equal scores. Inputs of
    a score are the text alone; other columns are ignored.
    """
    lexicon, trees, knots = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [calibrate(trees.score(features(buf, offsets, lexicon)), knots) for _, _, buf, offsets in text_blocks(batch.column(2))]
            s = np.concatenate(s) if s else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs, fit(docs, labels))
