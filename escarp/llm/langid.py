"""Operator 3: language identification with interpolated Kneser-Ney character models.

Texts are lower-cased letters with one space for whatever is between words.  For each language an order-4 model is
trained from counts of 4-grams: the highest order has discounted counts, lower orders discounted numbers of distinct
left contexts, all interpolated down to the uniform distribution.  What is stored are, for each order, one array of
64-bit hashes in ascending order of all n-grams that any language has seen, beside it the n-grams' log probabilities
in every language; and the same for contexts, with the log weight of the lower order.  An n-gram that no language has
seen takes its context's weight and is asked one order lower.  So scoring is a handful of binary searches for whole
arrays of n-grams, for all languages at once.

The language of the lowest cross-entropy per character is chosen (of equal ones the first name in the alphabet).  Its
score is the calibrated probability that the choice is right: a logistic regression, on texts that the models haven't
seen, on the margin to the second language, on how much less likely the text is than that language's texts of such a
length usually are, and on the length.  Texts of a language that isn't known are learned from by leaving out each
text's own language in turn, so that the choice among the others is wrong.  A text is rejected if it has no letter or
if its score is below a limit.  All but a set share of the texts that are identified rightly score more than some
value; the limit is half that value's log odds, or the value itself if it is below one half.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import U64, UNIT, mix, text_buffer, units
from .codepoints import letters

ORDER = 4
SPACE = 1
#: Training documents of each language that are counted, and further ones for calibration; both are samples by hash.
SAMPLE, CALIBRATION = 2000, 1000

#: Of calibration texts that are identified rightly, the share that may be rejected at most.
FALSE_REJECTIONS = 0.001
#: Languages that are learned at most, the commonest first; bounds the model.
LANGUAGES = 1000
#: Nats per character beyond which a margin says no more, and which stands for that of the only language.
MARGIN = 1.0


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, offsets, letters by text): each text begins with ORDER - 1 spaces and ends with one."""
    x, at = letters(data, offsets)
    x = np.where(x > 0xFFFF, 0xE000 + x % 0x1000, x).astype(np.uint64)
    n = len(offsets) - 1
    start = np.zeros(len(x) + 1, dtype=bool)
    start[at] = True
    letter = x > 0
    count = np.concatenate(([0], np.cumsum(letter)))
    # Of a run of others, the one before a letter stays, unless the text begins there.
    keep = letter.copy()
    keep[:-1] |= letter[1:] & ~letter[:-1] & ~start[1:-1]
    before = np.concatenate(([0], np.cumsum(keep)))[at]
    body = np.where(letter[keep], x[keep], U64(SPACE))
    lengths = np.diff(before)
    new = np.concatenate(([0], np.cumsum(lengths + ORDER)))
    out = np.full(int(new[-1]), U64(SPACE))
    place = np.repeat(new[:-1] + ORDER - 1 - before[:-1], lengths) + np.arange(len(body))
    out[place] = body
    # A text that begins with others after its last border has one space too many at most; that is harmless.
    return out, new, np.diff(count[at]) if n else np.zeros(0, np.int64)


def grams(s: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-grams of the highest order, number by text)."""
    packed = s[ORDER - 1 :].copy()
    for i in range(1, ORDER):
        packed |= s[ORDER - 1 - i : len(s) - i] << U64(16 * i)
    inside = np.ones(len(packed), dtype=bool)
    for i in range(ORDER - 1):
        border = offsets[1:-1] - (ORDER - 1) + i
        inside[border] = False
    return packed[inside], np.diff(offsets) - (ORDER - 1)


def pieces(data: np.ndarray) -> list[tuple[int, int]]:
    """A long text's ranges of about UNIT bytes.  None ends between another character and a letter, so that the
    symbols of the ranges, one after the other, are those of the text."""
    cuts, at = [0], UNIT
    while at < len(data):
        near = data[at : at + 8]
        at += int(np.argmax((near & 0xC0) != 0x80))
        points, _ = letters(data[at - 8 : at + 8], np.array([0, min(16, len(data) - at + 8)]))
        lead = np.cumsum((data[at - 8 : at + 8] & 0xC0) != 0x80)
        before, after = points[lead[7] - 1], points[min(lead[7], len(points) - 1)]
        if after and not before:
            following = np.flatnonzero((data[at + 1 : at + 8] & 0xC0) != 0x80)
            at += 1 + int(following[0]) if following.size else len(data) - at
        if at < len(data):
            cuts.append(at)
        at += UNIT
    return list(zip(cuts, [*cuts[1:], len(data)], strict=True))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the intercept first) of a ridge-regularised logistic regression on scaled columns: Newton steps, halved
    until the penalised likelihood rises, so that separable data end at finite weights."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3 * ridge
    loss = lambda w: float((weight * (np.logaddexp(0, x @ w) - y * (x @ w))).sum() + 0.5 * (penalty * w * w).sum())
    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (weight * (y - p)) - penalty * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), slope)
        gain, size = float(slope @ step), 1.0
        while size > 1e-9 and (new := loss(w + size * step)) > now - 1e-4 * size * gain:
            size /= 2
        if size <= 1e-9 or gain < 1e-9:
            break
        w, now = w + size * step, new
    return w


class Calibration:
    """The probability that a choice is right, from (margin, excess, length) of texts."""

    #: Without calibration texts: surer by the margin, and no longer sure of a text some nats off.
    SLOPES = np.array([4.0, -4.0, 0.0])

    def __init__(self):
        self.centre, self.scale, self.weights, self.least = np.zeros(3), np.ones(3), np.append(0.0, self.SLOPES), 0.5

    def fit(self, x: np.ndarray, right: np.ndarray, known: np.ndarray) -> None:
        """`known` tells texts whose language was among the models from those for which it was left out; both sides
        weigh the same.  A slope of the wrong sign (less sure by the margin, surer by the excess) is refused."""
        if not right.any() or right.all():
            return
        self.centre, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = (x - self.centre) / self.scale
        weight = np.where(right, 1.0, right.sum() / max(1, (~right).sum()))
        use = [0, 1, 2]
        while True:
            w = logistic(z[:, use], right.astype(float), weight)
            bad = [k for k, v in zip(use, w[1:], strict=True) if k < 2 and v * (1, -1)[k] < 0]
            if not bad:
                break
            use = [k for k in use if k not in bad]
        self.weights = np.zeros(4)
        self.weights[[0, *(k + 1 for k in use)]] = w
        kept = self.probability(x[known & right])
        if len(kept):
            low = float(np.sort(kept)[int(FALSE_REJECTIONS * len(kept))])
            odds = np.sqrt(low / max(1 - low, 1e-12))  # half the log odds
            self.least = min(low, float(odds / (1 + odds))) if low > 0.5 else low

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -500, 500)))


class Level:
    """n-grams of one order: ascending hashes, log probabilities, and log weights of contexts."""

    def __init__(self, grams_: np.ndarray, logs: np.ndarray, contexts: np.ndarray, weights: np.ndarray):
        self.hashes, self.logs = self.sort(grams_, logs)
        self.contexts, self.weights = self.sort(contexts, weights)

    @staticmethod
    def sort(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys)
        order = np.argsort(h)
        return h[order], values[order].astype(np.float32)

    @staticmethod
    def find(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        h = mix(keys)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return np.where(hashes[at] == h, at, -1)


class Model:
    """Kneser-Ney models of some languages over one set of n-grams."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """counts: for each language its packed highest-order n-grams and how often each occurs."""
        self.languages = sorted(counts)
        every = np.unique(np.concatenate([counts[k][0] for k in self.languages]))
        vocabulary = len(np.unique(every & U64(0xFFFF))) + 1
        orders = range(ORDER, 0, -1)
        keep = {n: np.unique(every & U64((1 << 16 * n) - 1)) for n in orders}
        numbers = {}
        for k in self.languages:
            g, c = counts[k]
            for n in orders:
                numbers[k, n] = (g, c.astype(float))
                shorter = g & U64((1 << 16 * (n - 1)) - 1) if n > 1 else g[:0]
                g, c = np.unique(shorter, return_counts=True)  # distinct left contexts
        self.uniform = -np.log(vocabulary)
        self.levels: dict[int, Level] = {}
        lower = {k: None for k in self.languages}
        for n in range(1, ORDER + 1):
            keys = keep[n]
            contexts = np.unique(keys >> U64(16))
            logs, weights = np.zeros((len(keys), len(self.languages))), np.zeros((len(contexts), len(self.languages)))
            for i, k in enumerate(self.languages):
                g, c = numbers[k, n]
                ones, twos = (c == 1).sum(), (c == 2).sum()
                discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
                total, kinds = np.zeros(len(contexts)), np.zeros(len(contexts))
                at = np.searchsorted(contexts, g >> U64(16))
                np.add.at(total, at, c)
                np.add.at(kinds, at, 1)
                weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
                own = np.zeros(len(keys))
                own[np.searchsorted(keys, g)] = np.maximum(c - discount, 0)
                where = np.searchsorted(contexts, keys >> U64(16))
                below = 1 / vocabulary if n == 1 else np.exp(lower[k][np.searchsorted(keep[n - 1], keys & U64((1 << 16 * (n - 1)) - 1))])
                p = own / np.maximum(total[where], 1) + weight[where] * below
                logs[:, i], weights[:, i] = np.log(p), np.log(weight)
                lower[k] = logs[:, i].copy()
            self.levels[n] = Level(keys, logs, contexts, weights)
        self.calibration, self.typical = Calibration(), {}

    def log_probabilities(self, packed: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Of each n-gram's last symbol after the others, in every language."""
        if n == 0:
            return np.full((len(packed), len(self.languages)), self.uniform, dtype=np.float32)
        level, keys = self.levels[n], packed & U64((1 << 16 * n) - 1) if n < 4 else packed
        at = Level.find(level.hashes, keys)
        out = level.logs[at]
        new = np.flatnonzero(at < 0)
        if new.size:
            below = self.log_probabilities(keys[new], n - 1)
            context = Level.find(level.contexts, keys[new] >> U64(16))
            out[new] = below + np.where((context >= 0)[:, None], level.weights[context], 0)
        return out

    def cross_entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy per character in every language, characters, letters) of texts."""
        if len(offsets) == 2 and len(data) > 4 * UNIT:
            return self.long_cross_entropy(data)
        s, at, n_letters = symbols(data, offsets)
        if len(at) < 2:
            return np.zeros((0, len(self.languages))), np.zeros(0, np.int64), n_letters
        packed, n = grams(s, at)
        logs = self.log_probabilities(packed)
        sums = np.add.reduceat(logs, np.cumsum(n) - n, axis=0, dtype=np.float64)
        return -sums / n[:, None], n, n_letters

    def long_cross_entropy(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of one long text, piece by piece; the last symbols of a piece are the context of the next."""
        context = np.full(ORDER - 1, U64(SPACE))
        total, n, n_letters, ranges = np.zeros(len(self.languages)), 0, 0, pieces(data)
        for a, b in ranges:
            s, _, count = symbols(data[a:b], np.array([0, b - a]))
            body = s[ORDER - 1 :] if b == len(data) else s[ORDER - 1 : -1]
            s = np.concatenate((context, body))
            if len(body):
                total += self.log_probabilities(grams(s, np.array([0, len(s)]))[0]).sum(axis=0, dtype=np.float64)
            context, n, n_letters = s[len(s) - ORDER + 1 :], n + len(body), n_letters + int(count[0])
        return -total[None, :] / n, np.array([n]), np.array([n_letters])

    def features(self, entropies: np.ndarray, n: np.ndarray, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(chosen language, (margin, excess, log of the length)) of texts; `without` is a language left out of each."""
        e = entropies.copy()
        if without is not None:
            e[np.arange(len(e)), without] = np.inf
        best = e.argmin(axis=1)
        low = np.sort(e, axis=1)
        second = low[:, 1] if e.shape[1] > 1 else np.full(len(e), np.inf)
        with np.errstate(invalid="ignore"):
            margin = np.where(np.isfinite(second), second - low[:, 0], MARGIN)
        usual = self.typical or {0: (0.0, 0.0, 1.0)}
        middle, spread, ground = (np.array([usual.get(i, tuple(np.mean(list(usual.values()), axis=0)))[k] for i in range(len(self.languages))])[best] for k in range(3))
        excess = low[:, 0] - middle if self.typical else np.zeros(len(e))
        # Nats per character beyond what the length explains; texts likelier than usual (repetitive ones) are no worse.
        excess = np.maximum(0.0, excess - 2 * np.sqrt(spread / n + ground))
        return best, np.column_stack([np.minimum(margin, MARGIN), excess, np.log(n)])

    def calibrate(self, entropies: np.ndarray, n: np.ndarray, truth: np.ndarray) -> None:
        """Fits how a language's entropies lie by length, and the score, on texts that weren't counted."""
        if not len(n):
            return
        best = entropies.argmin(axis=1)
        for i in range(len(self.languages)):
            own = (truth == i) & (best == i)
            if own.sum() >= 10:
                e = entropies[own, i]
                middle = float(np.median(e))
                # variance = spread / length + ground, by the median of squares (half the texts don't matter)
                d2 = (e - middle) ** 2
                a = np.column_stack([1 / n[own], np.ones(own.sum())])
                spread, ground = np.maximum(np.linalg.lstsq(a, np.minimum(d2, 20 * np.median(d2) + 1e-9), rcond=None)[0], [0.2, 1e-4])
                self.typical[i] = (middle, float(spread), float(ground))
        best, x = self.features(entropies, n)
        right, known = best == truth, np.ones(len(n), dtype=bool)
        if len(self.languages) > 1:
            x = np.vstack([x, self.features(entropies, n, without=truth)[1]])
            right, known = np.append(right, np.zeros(len(n), dtype=bool)), np.append(known, np.zeros(len(n), dtype=bool))
        self.calibration.fit(x, right, known)

    def predict(self, data: np.ndarray, offsets: np.ndarray, least: float | None = None):
        """(language or und, score, rejected) of texts."""
        e, n, n_letters = self.cross_entropies(data, offsets)
        if not len(n):
            return [], np.zeros(0), np.zeros(0, dtype=bool)
        best, x = self.features(e, n)
        none = n_letters == 0
        score = np.where(none, 0.0, self.calibration.probability(x))
        names = np.array(self.languages, dtype=object)[best]
        names[none] = "und"
        return names.tolist(), score, none | (score < (self.calibration.least if least is None else least))


def train(labelled: DataFrame, sample: int = SAMPLE, calibration: int = CALIBRATION) -> Model:
    """A model from rows (id, text, lang).  Of each of the LANGUAGES commonest languages, rows are drawn by a hash of
    id and text: some `sample` of them are counted whole, and some `calibration` others calibrate, equal ones once.
    Rows whose text is null or whose language is null are not used.  Raises ValueError if no language has any text."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not sizes:
        raise ValueError("no labelled text to learn from")
    total = 1 << 30
    shares = rows.sparkSession.createDataFrame([(k, min(total, int(total * sample / n)), min(total, int(total * (sample + calibration) / n))) for k, n in sizes.items()], "lang string, counted bigint, drawn bigint")
    drawn = rows.join(F.broadcast(shares), "lang").withColumn("h", F.pmod(F.xxhash64("id", "text", F.lit(3)), F.lit(total)))
    # With few documents a fifth calibrates.
    role = F.when((F.col("counted") >= total) & (F.pmod(F.xxhash64("id", "text", F.lit(4)), F.lit(5)) == 0) | (F.col("h") >= F.col("counted")), F.lit(1)).otherwise(F.lit(0))
    picked = drawn.where(F.col("h") < F.col("drawn")).select("lang", role.alias("role"), "text")

    def count(batches):
        for batch in batches:
            langs, roles = np.array(batch.column("lang").to_pylist(), dtype=object), batch.column("role").to_numpy()
            for lang in set(langs.tolist()):
                part = batch.column("text").take(pa.array(np.flatnonzero((langs == lang) & (roles == 0))))
                data, offsets = text_buffer(part)
                for a, b in units(data, offsets):
                    s, at, _ = symbols(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    g, n = np.unique(grams(s, at)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counted = picked.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict = {}
    table = counted.toArrow()  # bounded by the sample
    langs, g, n = np.array(table.column("lang").to_pylist(), dtype=object), table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
    for lang in sorted(set(langs.tolist())):
        at = np.flatnonzero(langs == lang)
        order = at[np.argsort(g[at])]
        counts[lang] = (g[order], n[order])
    if not counts:
        raise ValueError("no labelled text to learn from")
    model = Model(counts)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b in units(data, offsets):
                e, n, n_letters = shared.value.cross_entropies(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                langs = batch.column("lang").slice(a, b - a)
                yield pa.RecordBatch.from_arrays([langs, pa.array(e.tolist(), pa.list_(pa.float64())), pa.array(n), pa.array(n_letters)], ["lang", "e", "n", "letters"])

    measured = picked.where("role = 1").mapInArrow(measure, "lang string, e array<double>, n bigint, letters bigint").where("letters > 0").distinct().toPandas()
    measured = measured[measured["lang"].isin(model.languages)].sort_values(["lang", "n"])
    if len(measured):
        model.calibrate(np.array(measured["e"].tolist()), measured["n"].to_numpy(), measured["lang"].map(model.languages.index).to_numpy())
    return model


def identified(df: DataFrame, model: Model, least: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every whole text; `und` with score 0 if it is null or has no letter.
    `least` replaces the calibrated limit of rejection."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b in units(data, offsets):
                names, score, rejected = shared.value.predict(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], least)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def accepted(df: DataFrame, model: Model, least: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows whose language is identified, with all their columns; one pass, without a join."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(batch.schema.get_field_index(text_col)))
            for a, b in units(data, offsets):
                _, _, rejected = shared.value.predict(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], least)
                yield batch.slice(a, b - a).filter(pa.array(~rejected))

    return df.mapInArrow(run, df.schema)


def held_out(id_col: str = "doc_id"):
    """Whether a document is held out from training: crc32 of its id as text, mod 4, is 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def trained_on_documents(documents: DataFrame) -> Model:
    """The model of a documents table, from rows that aren't held out."""
    rows = documents.where(F.coalesce(~held_out(), F.lit(False)))
    return train(rows.select(F.col("doc_id").alias("id"), "text", "lang"))
