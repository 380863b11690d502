"""Language identification of whole, possibly mixed texts.

Model: per language, hashed counts of character 1- to 3-grams of lower-cased
words (with word ends), and the share of its letters in each script.  It is fit
on about ``MAX_TRAIN`` labelled rows per language (a documented bound, drawn by
a hash of the id); the counts are summed by Spark and hold at most
``2**BITS`` numbers per language.

Prediction: a word's script, from fixed code point ranges, narrows the
candidate languages to those that use it; a word's score per candidate is the
log-likelihood of its n-grams; a Viterbi pass over the words with a penalty for
each change of language labels the spans.  The language with the most letters
is the prediction, its share of the letters the score.

The Viterbi pass is skipped where its result is known.  A path of m spans pays
m - 1 penalties; against the best constant path its first span gains at most P,
the most that the words up to some word favour a language, its last at most S,
the most that the words from some word on do, and each one between at most M, the
most that any run of words does.  If P + S and M are at most one penalty,
no path is better.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import revived

MAX_TRAIN = 4000     # labelled rows per language to fit on (about; drawn by hash)
MAX_LANGS = 1000     # more label values than this are refused
BITS = 16            # log2 of the n-gram buckets
SMOOTH = 0.5         # added to every bucket
SWITCH = 12.0        # penalty for a change of language, in nats
FOREIGN = 40.0       # deducted where the script is not one of the language's
USES = 0.001         # share of a language's letters that makes a script one of its own
UNKNOWN = "und"
_PIECE = 1 << 19     # code points handled at once

# Script ranges (first, last code point, script).
SCRIPTS = (
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"), (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3040, 0x30FF, "kana"),
    (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"), (0x20000, 0x2FFFF, "han"),
)
SCRIPT_NAMES = ["other", *dict.fromkeys(s for _, _, s in SCRIPTS)]

_tables: list[np.ndarray] = []


def _lookup() -> list[np.ndarray]:
    """Per code point: lower-case letter (0 for other signs) and script; made once per worker."""
    if not _tables:
        lower = np.zeros(0x110000, np.uint32)
        script = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                lower[c] = ord(low) if len(low) == 1 else c
        for first, last, name in SCRIPTS:
            script[first:last + 1] = SCRIPT_NAMES.index(name)
        _tables.extend([lower, script])
    return _tables


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of bounded length, cut behind white space where there is some."""
    at = 0
    while len(text) - at > _PIECE:
        cut = max(text.rfind(" ", at, at + _PIECE), text.rfind("\n", at, at + _PIECE)) + 1
        cut = cut if cut > at else at + _PIECE
        yield text[at:cut]
        at = cut
    yield text[at:]


def ngrams(piece: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of 1- to 3-grams by position, which positions count, word starts, letters per word, script per word)."""
    lower, script = _lookup()
    raw = np.frombuffer(piece.encode("utf-32-le", "replace"), dtype="<u4")
    c = np.zeros(raw.size + 3, np.uint32)          # two signs before the text, one behind
    c[2:-1] = lower[raw]
    x, y, z = c[:-2].copy(), c[1:-1], c[2:]
    x[y == 0] = 0                                  # n-grams do not reach over the word's start
    letter = z != 0
    counts = letter | (y != 0)                     # the sign behind a word closes its last n-grams
    one = z * np.uint32(2654435761)
    two = (one ^ (y * np.uint32(2246822519))) + np.uint32(1)
    three = (two ^ (x * np.uint32(3266489917))) + np.uint32(2)
    buckets = np.stack([(h ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(32 - BITS) for h in (one, two, three)])
    starts = np.flatnonzero(letter & (y == 0))
    n_letters = np.add.reduceat(letter, starts, dtype=np.int64) if starts.size else np.zeros(0, np.int64)
    return buckets, counts, starts, n_letters, script[raw[starts]]


def _train_rows(batches, langs: list[str]):
    n, width = len(langs), 1 << BITS
    index = {v: i for i, v in enumerate(langs)}
    grams = np.zeros((n, width), np.int64)
    scripts = np.zeros((n, len(SCRIPT_NAMES)), np.int64)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            at = index[lang]
            for piece in _pieces(text):
                buckets, counts, starts, n_letters, script = ngrams(piece)
                grams[at] += np.bincount(buckets[:, counts].ravel(), minlength=width)
                scripts[at] += np.bincount(script, weights=n_letters, minlength=len(SCRIPT_NAMES)).astype(np.int64)
    both = np.concatenate([grams, scripts], axis=1)
    i, j = np.nonzero(both)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(both[i, j], pa.int64())], ["l", "f", "n"])


class Model:
    """Languages, n-gram log-probabilities (buckets x languages) and the deduction per script and language."""

    def __init__(self, langs: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        p = grams + SMOOTH
        self.logp = np.ascontiguousarray(np.log(p / p.sum(axis=1, keepdims=True)).T.astype(np.float32))
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        uses = (share >= USES).T
        uses[~uses.any(axis=1)] = True              # a script no language uses rules none out
        self.foreign = np.where(uses, 0.0, -FOREIGN)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on ``labelled`` (doc_id, text, lang); rows without text or label are left out."""
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                           F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(sizes)
    grams, scripts = np.zeros((len(langs), 1 << BITS)), np.zeros((len(langs), len(SCRIPT_NAMES)))
    if langs:
        draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
        share = F.create_map(*[F.lit(v) for k in langs for v in (k, int(1_000_000 * min(1.0, max_train / sizes[k])))])
        some = rows.where(draw < F.element_at(share, F.col("lang"))).select("text", "lang")
        counts = (some.mapInArrow(lambda it: _train_rows(it, langs), "l int, f int, n long")
                  .groupBy("l", "f").agg(F.sum("n").alias("n")).toPandas())
        l, f, n = (counts[k].to_numpy() for k in "lfn")
        word = f < grams.shape[1]
        grams[l[word], f[word]] = n[word]
        scripts[l[~word], f[~word] - grams.shape[1]] = n[~word]
    return Model(langs, grams, scripts)


def word_scores(text: str, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score per word and language, letters per word, offset of each word)."""
    scores, letters, offsets, at = [], [], [], 0
    for piece in _pieces(text):
        buckets, counts, starts, n_letters, script = ngrams(piece)
        if starts.size:
            by_position = model.logp[buckets[0]]
            by_position += model.logp[buckets[1]]
            by_position += model.logp[buckets[2]]
            by_position[~counts] = 0
            scores.append(np.add.reduceat(by_position, starts, axis=0).astype(np.float64) + model.foreign[script])
            letters.append(n_letters)
            offsets.append(starts + at)
        at += len(piece)
    if not scores:
        return np.zeros((0, len(model.langs))), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(scores), np.concatenate(letters), np.concatenate(offsets)


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> list[tuple[int, int]]:
    """Best labelling as (first word, language) of each span; ties go to the earlier language, staying before changing."""
    best = int(scores.sum(axis=0).argmax())
    gain = np.cumsum(scores - scores[:, [best]], axis=0)
    floor = np.minimum.accumulate(np.vstack([np.zeros(gain.shape[1]), gain[:-1]]), axis=0)
    if (gain - floor).max() <= switch and gain.max() + (gain[-1] - floor[-1]).max() <= switch:
        return [(0, best)]
    value = scores[0].tolist()
    span = [(l, 0, None) for l in range(len(value))]
    for t, row in enumerate(scores[1:].tolist(), start=1):
        top = max(value)
        change = top - switch
        if min(value) < change:
            lead = span[value.index(top)]
            for l, v in enumerate(value):
                if v < change:
                    value[l], span[l] = change, (l, t, lead)
        value = [a + b for a, b in zip(value, row, strict=True)]
    at, out = span[value.index(max(value))], []
    while at is not None:
        out.append((at[1], at[0]))
        at = at[2]
    return out[::-1]


def label_text(text: str | None, model: Model, switch: float = SWITCH) -> tuple[str, float, list]:
    """(language, score, [(start, end, language)]); null texts and texts without letters are unknown, with no spans.

    A model without languages gives texts with letters one span of unknown language.
    """
    if not text:
        return UNKNOWN, 0.0, []
    scores, letters, offsets = word_scores(text, model)
    if not letters.size:
        return UNKNOWN, 0.0, []
    if not model.langs:
        return UNKNOWN, 0.0, [(0, len(text), UNKNOWN)]
    spans = viterbi(scores, switch)
    ends = [s for s, _ in spans[1:]] + [letters.size]
    share = np.zeros(len(model.langs))
    for (start, lang), end in zip(spans, ends, strict=True):
        share[lang] += letters[start:end].sum()
    lang = int(share.argmax())
    starts = [0] + [int(offsets[s]) for s, _ in spans[1:]]
    cuts = starts[1:] + [len(text)]
    return model.langs[lang], float(share[lang] / letters.sum()), [
        (a, b, model.langs[l]) for a, b, (_, l) in zip(starts, cuts, spans, strict=True)]


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """``docs`` plus lang_pred, score and lang_spans (start, end, lang in code points).

    Null texts and texts without letters are ``und`` with score 0; a model
    without languages gives ``und`` for all; repeated rows get equal results;
    columns of ``docs`` with those names are replaced; all others are kept.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vars(model))  # at most MAX_LANGS x 2**BITS numbers
    keep = docs.drop("lang_pred", "score", "lang_spans")
    names = keep.columns

    def run(batches):
        model = revived(Model, shipped.value)
        for batch in batches:
            found = [label_text(t, model, switch) for t in batch.column(names.index("text")).to_pylist()]
            spans = [[{"start": a, "end": b, "lang": l} for a, b, l in f[2]] for f in found]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                 pa.array(spans, kind)], [*names, "lang_pred", "score", "lang_spans"])

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])
    schema = T.StructType([*keep.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("lang_spans", T.ArrayType(span))])
    return keep.mapInArrow(run, schema)


def predict_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    model = fit(rows.where(~held_out(F.col("doc_id"))))
    found = identify(rows.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without null texts and texts without letters; a missing lang becomes the predicted one.

    The model is fit on the rows with text and label that are not held out; texts
    with letters stay also where there are none to learn from, with lang as it
    was.  A lang that is given stays as given; lang is no input of a prediction.
    """
    labelled = docs.where(~held_out(F.col("doc_id").cast("long")))
    names = docs.columns
    clash = {c: f"_given_{c}" for c in names if c in ("lang_pred", "score", "lang_spans")}   # the caller's own columns
    rows = docs.withColumn("text", F.col("text").cast("string")).withColumnsRenamed(clash)
    found = identify(rows, fit(labelled)).where(F.size("lang_spans") > 0)
    known = F.coalesce(F.col("lang").cast("string"), F.when(F.col("lang_pred") != "und", F.col("lang_pred")))
    return found.withColumn("lang", known).select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in names])
