"""Problem 10: the language of documents, and of each stretch of a mixed one.

Multinomial naive Bayes over hashed character n-grams. The model is fitted on a bounded
sample of labelled rows, whose labels may be wrong; scoring covers whole texts, batch by
batch in numpy, against the model's matrix of log-probabilities.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped_lower

UNKNOWN = "und"
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)

# What has no language, each kind looked for only in texts that hold its sign. The order matters: markup and fields
# first, so that what stands inside them goes with them. Look-behinds let a word be tried once, at its beginning.
_MARKUP = re.compile(r"<[A-Za-z/!?][^<>]*>|&#?\w{1,32};|\[[^\[\]\n]*\]")
_ADDRESS = re.compile(r"https?://[^\s<>\"']+", re.IGNORECASE)
_SETTING = re.compile(r"(?<![A-Za-z0-9_.\-])[A-Za-z0-9_.\-]+=(?:\"[^\"\n]*\"|'[^'\n]*'|[^\s,;\"'<>]*)")
_FILE = re.compile(r"(?<![A-Za-z0-9_()\-])[A-Za-z0-9_()\-]+\.(?:png|jpe?g|webp|bmp|tiff?|txt|json|csv)\b:?", re.IGNORECASE)
_SUFFIX = re.compile(r"\.(?:png|jpe?g|webp|bmp|tiff?|txt|json|csv)\b", re.IGNORECASE)
_TAG_LINE = re.compile(r"^[ \t]*tags?:.*$", re.IGNORECASE | re.MULTILINE)
_TAG = re.compile(r"(?<![A-Za-z0-9()])[A-Za-z0-9()]*(?:_+[A-Za-z0-9()]+)+_*")
_SENTENCE = re.compile(r"[^.!?。！？…\n]+")
_NOT_LETTER = re.compile(r"[\W\d_]+")


def plain_text(text: str) -> str:
    """The text with blanks for markup, bracketed fields, addresses, key=value, file names, tag lists and tags, however long they are."""
    if "<" in text or "&" in text or "[" in text:
        text = _MARKUP.sub(" ", text)
    if "://" in text:
        text = _ADDRESS.sub(" ", text)
    if "=" in text:
        text = _SETTING.sub(" ", text)
    if "." in text and _SUFFIX.search(text):
        text = _FILE.sub(" ", text)
    if ":" in text:
        text = _TAG_LINE.sub(" ", text)
    return _TAG.sub(" ", text) if "_" in text else text


def sentences(text: str) -> list[str]:
    """The sentences of a text that hold a letter, lower-cased, other characters as single blanks."""
    out = []
    for m in _SENTENCE.findall(plain_text(text)):
        s = _NOT_LETTER.sub(" ", m).strip().lower()
        if s:
            out.append(s)
    return out


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every character n-gram of every text; each text is set in blanks."""
    cps = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    owner = np.append(owner, max(len(texts) - 1, 0))[: len(cps)]
    ends = np.cumsum([len(t) + 1 for t in texts])  # the blank after each text
    number, found = [], []
    h = np.zeros(len(cps), dtype=np.uint64)
    for k in range(max(ORDERS)):
        h = h[: len(cps) - k] * np.uint64(0x9E3779B97F4A7C15) + cps[k:] + np.uint64(k + 1)
        if k + 1 in ORDERS:
            start = np.arange(len(h))
            own = owner[: len(h)]
            ok = start + k <= ends[own] if k else cps[: len(h)] != 32
            z = h[ok]
            z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append((z >> np.uint64(48)).astype(np.int32))
            number.append(own[ok])
    return np.concatenate(found), np.concatenate(number)


def _sums(weights: np.ndarray, bucket: np.ndarray, number: np.ndarray, n: int, block: int = 1 << 14) -> np.ndarray:
    """The weights' rows summed by text; blocks are small enough to stay in a processor's cache."""
    out = np.zeros((n, weights.shape[1]))
    for lo in range(0, len(bucket), block):
        b, k = bucket[lo : lo + block], number[lo : lo + block]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])  # runs of one text
        np.add.at(out, k[first], np.add.reduceat(weights[b], first, axis=0))
    return out


def log_odds(counts: np.ndarray, back: float = 0.05) -> np.ndarray:
    """ln of each language's n-gram probability over the common one, mixed with ``back`` of the common."""
    common = counts.sum(1, keepdims=True) + 0.1
    common /= common.sum()
    own = counts / np.maximum(counts.sum(0, keepdims=True), 1e-9)
    return np.log((1 - back) * own / common + back).astype(np.float32)


def fit(texts: list[str], labels: list[str], languages: list[str], rounds: int = 3, piece: int = 8192) -> tuple[np.ndarray, list[str]]:
    """(BUCKETS x languages matrix of log-odds, languages).

    The first round believes the labels; later ones give each sentence to the language it
    then fits best, which takes the wrongly labelled and mixed documents out of the counts. A label
    whose own sentences mostly fit others better names no language and is left out. Sentences are counted in pieces.
    """
    sents, first = [], []
    for t, label in zip(texts, labels):
        s = sentences(t)
        sents += s
        first += [languages.index(label)] * len(s)
    parts, of = [sents[lo : lo + piece] for lo in range(0, len(sents), piece)], np.array(first, dtype=np.int64)
    given, kept = of, np.arange(len(languages))
    counts = np.zeros((BUCKETS, max(len(languages), 1)))
    for r in range(rounds if sents else 0):
        counts = np.zeros((BUCKETS, len(languages)))
        for k, part in enumerate(parts):
            bucket, number = ngram_buckets(part)
            own = of[k * piece : k * piece + len(part)]
            np.add.at(counts, (bucket, own[number]), 1.0)
        if r < rounds - 1:
            weights = log_odds(counts).astype(np.float64)
            weights[:, np.setdiff1d(np.arange(len(languages)), kept)] = -50.0
            of = np.concatenate([_sums(weights, *ngram_buckets(part), len(part)).argmax(1) for part in parts])
            same = np.bincount(given, of == given, len(languages)) * 2 >= np.bincount(given, minlength=len(languages))
            kept = np.flatnonzero(same) if same.any() else kept
    return log_odds(counts[:, kept] if len(languages) else counts), [languages[k] for k in kept] or [UNKNOWN]


def stretches(score: np.ndarray, switch: float = 6.0) -> list[tuple[int, int, int]]:
    """(language, first, after last) of the most probable stretches of at least two sentences, by dynamic programming."""
    n, k = score.shape
    if n < 4:
        return [(int(score.sum(0).argmax()), 0, n)]
    low = -1e18
    one, more = score[0].copy(), np.full(k, low)  # stretch has one sentence; two or more
    back_one, back_more = [], []
    for i in range(1, n):
        best = int(more.argmax())
        grow = np.maximum(one, more)
        back_more.append(more > one)
        back_one.append(best)
        start = np.where(np.arange(k) == best, low, more[best] - switch)
        one, more = start + score[i], grow + score[i]
    lang, single, at, out = int(more.argmax()), False, n - 1, []
    end = n
    while at > 0:
        if single:
            out.append((lang, at, end))
            end, lang, single = at, back_one[at - 1], False
        else:
            single = not back_more[at - 1][lang]
        at -= 1
    out.append((lang, 0, end))
    return out[::-1]


def identify(df: DataFrame, id_col: str, text_col: str, weights: np.ndarray, languages: list[str]) -> DataFrame:
    """(id, segment_no, segments, lang, confidence, sentences): a row per stretch of one language of each whole text.

    Segments are numbered from 1. Null and blank texts, and texts of nothing but markup, tags,
    numbers and file names, have none. Confidence is the naive Bayes posterior with the
    evidence divided by the square root of the number of n-grams, as n-grams that
    overlap do not bear witness independently. A tie goes to the language listed first. A segment that the
    common model of all languages explains better than any of them is ``und``.
    """
    model = df.sparkSession.sparkContext.broadcast(weights)  # BUCKETS x languages, of fixed size

    def run(batches):
        w = model.value.astype(np.float64)
        for p in batches:
            for lo in range(0, len(p), 256):
                part = p.iloc[lo : lo + 256]
                yield _identify(part["id"].tolist(), part["text"].tolist(), w, languages)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    return rows.mapInPandas(run, "id long, segment_no int, segments int, lang string, confidence double, sentences int")


def _identify(ids, texts, w, languages) -> pd.DataFrame:
    split = [sentences(t) for t in texts]
    flat = [s for d in split for s in d]
    out = []
    if flat:
        bucket, number = ngram_buckets(flat)
        score = _sums(w, bucket, number, len(flat))
        grams = np.bincount(number, minlength=len(flat))
        best = score.argmax(1)
        at = 0
        for i, d in zip(ids, split):
            n = len(d)
            if not n:
                continue
            b = best[at : at + n]
            parts = [(int(b[0]), 0, n)] if (b == b[0]).all() else stretches(score[at : at + n] / len(ORDERS))
            for k, (lang, lo, hi) in enumerate(parts, 1):
                z = score[at + lo : at + hi].sum(0) / np.sqrt(max(grams[at + lo : at + hi].sum(), 1))
                conf = 1 / np.exp(np.minimum(z - z[lang], 50)).sum()
                out.append((i, k, len(parts), languages[lang] if z[lang] > 0 else UNKNOWN, float(conf), hi - lo))
            at += n
    return pd.DataFrame(out, columns=["id", "segment_no", "segments", "lang", "confidence", "sentences"])


def given_code(c) -> F.Column:
    """A given label, stripped, lower-cased and cut before the first - or _."""
    return F.regexp_replace(stripped_lower(c), r"[-_].*$", "")


def labels_in_use(df: DataFrame, label_col: str, share: float = 0.005) -> list[str]:
    """The two-letter codes that at least ``share`` of all rows are labelled with, at most 1 / ``share`` of them."""
    rows = df.select(given_code(F.col(label_col)).alias("label"))
    n = rows.count()
    often = rows.filter(F.col("label").rlike("^[a-z]{2}$")).groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= share * n)
    return sorted(r.label for r in often.collect())


def labelled_sample(df: DataFrame, id_col: str, text_col: str, label_col: str, languages: list[str], per_language: int = 400, longest: int = 20_000) -> tuple[list[str], list[str]]:
    """At most ``per_language`` texts of each given label, chosen by a hash of the id, of those with at most ``longest`` characters.

    The bound keeps the sample below languages * per_language * longest characters whatever the table's size.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), given_code(F.col(label_col)).alias("label"))
    rows = rows.filter(F.col("label").isin(*languages) & (F.length("text") <= longest))
    w = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    kept = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_language).orderBy("label", "rn").collect()
    return [r.text for r in kept], [r.label for r in kept]


def document_languages(df: DataFrame, id_col: str, text_col: str, label_col: str, languages: list[str] | None = None, **bounds) -> DataFrame:
    """:func:`identify` with a model fitted on this table's own labelled sample, for ``languages`` or else the labels in use."""
    languages = labels_in_use(df, label_col) if languages is None else languages
    return identify(df, id_col, text_col, *fit(*labelled_sample(df, id_col, text_col, label_col, languages, **bounds), languages))
