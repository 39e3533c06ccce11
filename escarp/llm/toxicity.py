"""Operator 7: toxicity by a classifier chain.

Categories are predicted one after the other by logistic regressions over the words of a text: whole words and their
beginnings (3 to 6 letters), lower-cased, each counted once, hashed.  The model of a category also gets the log odds
of all categories before it.  In training these are *out-of-fold*: a document's earlier probabilities come from models
that haven't seen its fold, so that later models learn to trust them no more than they deserve; in use they come from
models of all folds.

Words that say nothing (too rare, or as common among rows with a category as among others) are left out, by counts
over the training rows that Spark aggregates.  The training rows are a sample by hash whose size is a parameter; the
kept words of these rows are what the driver gets.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, UNIT, Rolling, mix, text_buffer, units
from .codepoints import letters
from .store import dropped, written

#: Labelled rows that are trained on at most (about), words kept, and folds.
SAMPLE, WORDS, FOLDS = 10_000, 8_000, 5
BEGINNINGS = (3, 4, 5, 6)
#: The least chi-square of a kept word: a word of three rows that all have a rare category falls short.
TELLING = 27.0
MASK = U64((1 << 62) - 1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of words and of their beginnings, text of each), repeated as they occur."""
    x, at = letters(data, offsets)
    edge = np.zeros(len(x) + 1, dtype=bool)
    edge[at] = True
    letter = x > 0
    start = np.flatnonzero(letter & (np.append(True, ~letter[:-1]) | edge[:-1])) if len(x) else np.zeros(0, np.int64)
    end = np.flatnonzero(letter & (np.append(~letter[1:], True) | edge[1:])) + 1 if len(x) else start
    text = np.searchsorted(at, start, side="right") - 1
    roll = Rolling(np.arange(len(x)), mix(x.astype(U64) + U64(1)))
    parts, owners = [roll.slices(start, end)], [text]
    for n in BEGINNINGS:
        long = end - start > n
        parts.append(mix(roll.slices(start[long], start[long] + n) + U64(n)))
        owners.append(text[long])
    return np.concatenate(parts) & MASK, np.concatenate(owners)


def ranges(data: np.ndarray) -> list[tuple[int, int]]:
    """A long text's ranges of about UNIT bytes that begin with no letter, so that no word is cut."""
    cuts, at = [0], UNIT
    while at < len(data):
        window = data[at : at + UNIT]
        lead = np.flatnonzero((window & 0xC0) != 0x80)
        gap = lead[letters(window[lead[0] :], np.array([0, len(window) - lead[0]]))[0] == 0]
        gap = gap[gap < len(window) - 3]
        if gap.size:
            at += int(gap[0])
            cuts.append(at)
        at += UNIT
    return list(zip(cuts, [*cuts[1:], len(data)], strict=True))


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text of each), each once in a text, ordered by hash."""
    if len(offsets) == 2 and len(data) > 4 * UNIT:
        h = np.unique(np.concatenate([np.unique(word_hashes(data[a:b], np.array([0, b - a]))[0]) for a, b in ranges(data)]))
        return h, np.zeros(len(h), np.int64)
    h, owner = word_hashes(data, offsets)
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    first = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])) if len(h) else np.zeros(0, dtype=bool)
    return h[first], owner[first]


def present(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in `kept`) of the kept words that occur, each once."""
    long = len(offsets) == 2 and len(data) > 4 * UNIT
    h, owner = distinct_words(data, offsets) if long else word_hashes(data, offsets)
    place = np.minimum(np.searchsorted(kept, h), len(kept) - 1)
    hit = kept[place] == h if len(kept) else np.zeros(len(h), dtype=bool)
    both = np.unique(owner[hit] * len(kept) + place[hit])
    return both // max(1, len(kept)), both % max(1, len(kept))


class Linear:
    """A logistic regression over present words and earlier log odds."""

    def __init__(self, words: np.ndarray, earlier: np.ndarray, bias: float):
        self.words, self.earlier, self.bias = words, earlier, bias

    def odds(self, rows: np.ndarray, columns: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        return self.bias + np.bincount(rows, self.words[columns], minlength=n) + before @ self.earlier


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each run of so many values."""
    out, some = np.zeros(len(counts)), counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def fit(rows: np.ndarray, columns: np.ndarray, n: int, width: int, before: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 100) -> Linear:
    """Ridge-regularised logistic regression by accelerated gradient steps; deterministic.  Rows must ascend."""
    k = before.shape[1]
    w, prior = np.zeros(width + k), np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
    bias, v, m = float(np.log(prior / (1 - prior))), np.zeros(width + k), 0.0
    squares = np.bincount(rows, minlength=n).mean() + (before**2).sum(axis=1).mean() if n else 1.0
    # Occurrences by row and by column, each laid out once: a step is two passes over them.
    columns, by_column = columns.astype(np.intp), rows[np.argsort(columns, kind="stable")].astype(np.intp)
    in_row, in_column = np.bincount(rows, minlength=n), np.bincount(columns, minlength=width)
    # The curvature along a column is at most a quarter of the times it occurs; scaled so, rare words move too.
    often = np.concatenate([in_column, (before**2).sum(axis=0)]) if n else np.ones(width + k)
    rate = 1.0 / (0.25 * often * max(1.0, min(squares, 20.0)) + ridge)
    for step in range(steps):
        look, ahead = w + 0.8 * v, bias + 0.8 * m
        z = ahead + sums(look[columns], in_row) + before @ look[width:]
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        slope = np.concatenate([sums(g[by_column], in_column), before.T @ g]) + ridge * look
        v = 0.8 * v - rate * slope
        m = 0.8 * m - g.sum() / max(1.0, 0.25 * n * min(squares, 20.0))
        w, bias = w + v, bias + m
    return Linear(w[:width], w[width:], float(bias))


class Chain:
    """Linear models of categories in order, each with the log odds of those before."""

    def __init__(self, categories: list[str], kept: np.ndarray):
        self.categories, self.kept, self.models = categories, kept, []
        self.thresholds: dict[str, float] = {}

    def train(self, rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> None:
        n, width = labels.shape[0], len(self.kept)
        before = np.zeros((n, 0))
        for i, name in enumerate(self.categories):
            y = labels[:, i]
            known = np.isfinite(y)
            out = np.zeros(n)
            for f in range(FOLDS):
                inside, outside = known & (fold != f), fold == f
                out[outside] = self.fitted(rows, columns, inside, before, y, width).odds(rows, columns, n, before)[outside]
            self.models.append(self.fitted(rows, columns, known, before, y, width))
            # A text without any telling word is never put in a category.
            silent = sigmoid(self.models[-1].bias)
            self.thresholds[name] = max(best_threshold(sigmoid(out[known]), y[known]), float(np.sqrt(silent)))
            before = np.column_stack([before, np.clip(out, -10, 10)])

    @staticmethod
    def fitted(rows, columns, use, before, y, width) -> Linear:
        renamed = np.cumsum(use) - 1
        keep = use[rows]
        return fit(renamed[rows[keep]], columns[keep], int(use.sum()), width, before[use], y[use])

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A column for each category."""
        n = len(offsets) - 1
        rows, columns = present(data, offsets, self.kept)
        before, out = np.zeros((n, 0)), []
        for model in self.models:
            z = model.odds(rows, columns, n, before)
            out.append(sigmoid(z))
            before = np.column_stack([before, np.clip(z, -10, 10)])
        return np.column_stack(out) if out else np.zeros((n, 0))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap between probabilities at which F1 is best, on out-of-fold predictions."""
    if not (y > 0).any():
        return 1.0
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    right = np.cumsum(y)
    f1 = 2 * right / (np.arange(1, len(p) + 1) + y.sum())
    last = np.append(p[1:] != p[:-1], True)
    f1 = np.where(last, f1, -1)
    best = f1 >= f1.max() - 1e-3
    below = np.append(p[1:], 0.0)
    i = int(np.argmax(np.where(best, np.log(p + 1e-6) - np.log(below + 1e-6), -1)))
    return float(np.sqrt((p[i] + 1e-6) * (below[i] + 1e-6)))


def train(labelled: DataFrame, categories: list[str], sample: int = SAMPLE, words: int = WORDS) -> Chain:
    """A chain from rows (id, text, a 0/1 column for each category, null where unknown).  Rows are drawn by a hash of
    id and text if there are more than `sample`; equal rows count once, null texts are empty."""
    rows = labelled.where(F.col("id").isNotNull())
    n = rows.count()
    share = min(1.0, sample / max(1, n))
    picked = rows.where(F.pmod(F.xxhash64("id", "text", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
    # Written: the few rows of the sample are read twice.
    drawn = written(picked.dropDuplicates(), "sample")
    picked = drawn.select(F.col("id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).cast("double").alias(c) for c in categories])

    def count(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b in units(data, offsets):
                h, owner = distinct_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                word, back = np.unique(h, return_inverse=True)
                columns = [np.bincount(back, minlength=len(word))]
                for c in categories:
                    y = np.nan_to_num(batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False))
                    columns.append(np.bincount(back, y[owner], minlength=len(word)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64))] + [pa.array(x.astype(np.int64)) for x in columns], ["word", "n", *(f"c{i}" for i in range(len(categories)))])

    total, *with_ = picked.agg(F.count("*"), *[F.sum(c) for c in categories]).first()
    kinds = ", ".join(f"c{i} bigint" for i in range(len(categories)))
    counts = picked.mapInArrow(count, f"word bigint, n bigint, {kinds}").groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(categories))]).where("n >= 3")
    counts = written(counts, "words")
    # The chi-square of word and category, the largest over categories.
    chi = []
    for i, positive in enumerate(with_):
        expected = F.col("n") * F.lit(float(positive or 0) / max(1, total))
        spread = expected * F.lit(1 - float(positive or 0) / max(1, total)) * (1 - F.col("n") / F.lit(float(max(1, total))))
        chi.append(F.when(spread > 0, (F.col(f"c{i}") - expected) * (F.col(f"c{i}") - expected) / spread).otherwise(0.0))
    each = [r["word"] for c in chi for r in counts.where(c >= TELLING).orderBy(c.desc(), "word").limit(words // len(chi)).select("word").collect()]
    chain = Chain(categories, np.unique(np.array(each, dtype=np.int64)).view(np.uint64))
    shared = labelled.sparkSession.sparkContext.broadcast(chain.kept)

    def keep(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b in units(data, offsets):
                rows_, columns = present(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shared.value)
                per = np.concatenate(([0], np.cumsum(np.bincount(rows_, minlength=b - a)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(per), pa.array(columns.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), lists, *(batch.column(c).slice(a, b - a) for c in categories)], ["id", "words", *categories])

    kinds = ", ".join(f"`{c}` double" for c in categories)
    table = picked.mapInArrow(keep, f"id string, words array<int>, {kinds}").toArrow().sort_by("id")  # bounded by the sample
    words_ = table.column("words").combine_chunks()
    lengths = np.diff(np.asarray(words_.offsets)) if len(table) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(table), dtype=np.int32), lengths)
    labels = np.column_stack([table.column(c).to_numpy() for c in categories]).astype(float)
    fold = np.array([zlib.crc32(x.encode()) % FOLDS for x in table.column("id").to_pylist()], dtype=np.int64)
    chain.train(owner, np.asarray(words_.flatten()), labels, fold)
    dropped(drawn, counts)
    return chain


def scored(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category>..., is_<category>...) of every whole text; null and empty texts have no words."""
    shared, names = df.sparkSession.sparkContext.broadcast(chain), chain.categories

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b in units(data, offsets):
                p = shared.value.probabilities(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                over = [pa.array(p[:, i] >= shared.value.thresholds[c]) for i, c in enumerate(names)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), *(pa.array(p[:, i]) for i in range(len(names))), *over], ["id", *(f"p_{c}" for c in names), *(f"is_{c}" for c in names)])

    kind = df.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"p_{c} double" for c in names), *(f"is_{c} boolean" for c in names)])
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def without(df: DataFrame, chain: Chain, category: str = "toxic", text_col: str = "text") -> DataFrame:
    """The rows that the chain doesn't put in the category, with all their columns; one pass, without a join."""
    shared = df.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        c = shared.value
        i = c.categories.index(category)
        for batch in batches:
            data, offsets = text_buffer(batch.column(batch.schema.get_field_index(text_col)))
            for a, b in units(data, offsets):
                p = c.probabilities(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[:, i]
                yield batch.slice(a, b - a).filter(pa.array(p < c.thresholds[category]))

    return df.mapInArrow(run, df.schema)


def trained_on_labels(documents: DataFrame, labels: DataFrame) -> Chain:
    """The chain of the documents and labels tables: low quality first, then toxicity, which may lean on it."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((1 - F.min("quality")).alias("low_quality"), F.max("toxic").alias("toxic"))
    # The sample is drawn from the labels, so that only its texts are shuffled; `train` draws again if ids repeat.
    n = known.count()
    share = int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < share)
    rows = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # some SAMPLE rows of three numbers
    return train(rows.select(F.col("doc_id").alias("id"), "text", "low_quality", "toxic"), ["low_quality", "toxic"], sample=2 * SAMPLE)
