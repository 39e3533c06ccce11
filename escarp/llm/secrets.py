"""Operator 2: secrets in texts, with DataFrame functions alone.

Three patterns give the base spans.  The method adds spans: every maximal run of at least `shortest` characters of
the alphabet, and every part of such a run between separators that is as long, is scored by two first-order character
Markov models, one of random strings and one of ordinary identifiers; its score is the log-likelihood ratio per
character.  The models are trained from labelled samples, whose counts are aggregated by Spark; only the two transition
tables (some 4,500 numbers) reach the driver.  Three fifths of the samples teach the models, a fifth sets the
threshold, and a fifth is left for measuring.

Positions: a text is split at a pattern's matches, and the lengths of gaps and matches add up to places, in code
points, by blocks of BLOCK matches, so that the cost grows with the matches.  Texts that hold no match at all are told
by a plain search first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns, by kind in the order of the listing.  For `access` and `hex` the least length is in
# the pattern: runs are maximal either way, and a shorter run holds no longer match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BASE = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
KINDS = [*BASE, "markov"]
ASSIGN_LEAST = 8

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SHORTEST, BLOCK = 16, 256

# Parts of ordinary identifiers, paths and slugs.
PARTS = """account action after all amount async back base before book border buffer byte cache case channel chart child click
client close color column commit connect content control create current date delete depth device domain down edit
empty enable entry example export field final first float footer form frame function gallery graph handle hash height
high history host import index init insert install join language large layer length level line load local login main
manager mark member memory merge middle mode module name native next notice null object option order output page
panel parse path pattern player policy pool position press print product property public queue rate read region
render report reset result return role rule sample schema script search select service session shadow short show
signal size skip source start state status store stream style summary switch system task template text time title
tool track transfer trigger unique unit upload value vector video weight width word zone""".split()


def samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(text, secret): the built-in labelled sample, n random strings and n identifiers, the same in every run."""
    rows = spark.range(n).withColumn("h", F.sha2(F.col("id").cast("string"), 512))
    bits = F.unhex("h")
    text = F.base64(bits)
    random = (
        F.when(F.col("id") % 4 == 0, F.substring("h", 1, 40))
        .when(F.col("id") % 4 == 1, F.substring(F.regexp_replace(text, r"[\r\n=]", ""), 1, 40))
        .when(F.col("id") % 4 == 2, F.upper(F.substring(F.regexp_replace(text, r"[\r\n=+/]", ""), 1, 24)))
        .otherwise(F.translate(F.substring(F.regexp_replace(text, r"[\r\n=]", ""), 1, 32), "+/", "-_"))
    )
    words = F.array(*[F.lit(w) for w in PARTS])
    pick = lambda i: F.element_at(words, (F.pmod(F.hash("id", F.lit(i)), F.lit(len(PARTS))) + 1).cast("int"))
    four = [pick(i) for i in range(4)]
    number = F.when(F.pmod(F.hash("id", F.lit(8)), F.lit(2)) == 0, F.pmod(F.hash("id", F.lit(9)), F.lit(300)).cast("string"))
    plain = (
        F.when(F.col("id") % 6 == 0, F.concat_ws("_", *four, number))
        .when(F.col("id") % 6 == 1, F.concat_ws("", four[0], *[F.initcap(x) for x in four[1:]], number))
        .when(F.col("id") % 6 == 2, F.concat_ws("-", *four, number))
        .when(F.col("id") % 6 == 3, F.concat_ws("/", *four, F.concat(F.lit("v"), number)))
        .when(F.col("id") % 6 == 4, F.concat_ws("", *four, number))
        .otherwise(F.upper(F.concat_ws("_", *four, number)))
    )
    return rows.select(random.alias("text"), F.lit(True).alias("secret")).union(rows.select(plain.alias("text"), F.lit(False).alias("secret")))


def index_of(character: Column) -> Column:
    """1 + the place in the alphabet; 0 for other characters."""
    places = [0] * 128
    for i, c in enumerate(ALPHABET):
        places[ord(c)] = i + 1
    table = F.split(F.lit(",".join(map(str, places))), ",").cast("array<int>")
    code = F.ascii(character)
    return F.when(code < 128, F.element_at(table, (code + 1).cast("int"))).otherwise(F.lit(0))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


class MarkovModel:
    """Log-likelihood ratios of character pairs, and the least score per character that counts as a secret."""

    def __init__(self, ratios: list[float], threshold: float):
        self.ratios, self.threshold = ratios, threshold

    def score(self, token: Column) -> Column:
        """The log-likelihood ratio per character: above 0, the token is likelier among random strings."""
        width = len(ALPHABET) + 1
        table = F.split(F.lit(",".join(f"{x:.9g}" for x in self.ratios)), ",").cast("array<double>")
        begin = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))
        step = lambda s, c: F.struct(index_of(c).alias("before"), (s["sum"] + F.element_at(table, (s["before"] * width + index_of(c) + 1).cast("int"))).alias("sum"))
        return F.aggregate(characters(token), begin, step, lambda s: s["sum"]) / F.greatest(F.length(token), F.lit(1))


def part() -> Column:
    """Which fifth of the samples a row is in, by its text: 0 to 2 teach, 3 sets the threshold, 4 measures."""
    return F.pmod(F.xxhash64("text"), F.lit(5))


def train(labelled: DataFrame, false_rate: float = 0.001, miss_rate: float = 0.01) -> MarkovModel:
    """Two Markov chains with add-half smoothing from rows (text, secret).  Of the rows that set the threshold it lets
    through at most `false_rate` of the ordinary ones and, where that leaves room, misses `miss_rate` of the secrets.
    Null and empty texts teach nothing."""
    rows = labelled.where(F.length("text") > 0)
    codes = F.transform(characters(F.col("text")), index_of)
    pairs = rows.where(part() < 3).select("secret", F.explode(F.arrays_zip(F.concat(F.array(F.lit(0)), codes).alias("a"), F.concat(codes, F.array(F.lit(None).cast("int"))).alias("b"))).alias("p"))
    counts = pairs.where("p.b is not null").groupBy("secret", "p.a", "p.b").agg(F.count("*").alias("n")).collect()  # the alphabet's square at most
    width = len(ALPHABET) + 1
    tables = {True: [0.5] * width * width, False: [0.5] * width * width}
    for r in counts:
        tables[r["secret"]][r["a"] * width + r["b"]] += r["n"]
    logs = {}
    for kind, t in tables.items():
        sums = [sum(t[a * width : (a + 1) * width]) for a in range(width)]
        logs[kind] = [math.log(x / sums[i // width]) for i, x in enumerate(t)]
    model = MarkovModel([a - b for a, b in zip(logs[True], logs[False], strict=True)], 0.0)
    score, third = model.score(F.col("text")), rows.where(part() == 3)
    quantile = lambda which, q: F.percentile(F.when(which, score), q)
    limits = third.select(quantile(~F.col("secret"), 1 - false_rate), quantile(F.col("secret"), miss_rate)).first()
    model.threshold = max(0.0, *(x or 0.0 for x in limits))
    return model


def measured(labelled: DataFrame, model: MarkovModel) -> tuple[float, float]:
    """(share of the secrets that are found, share of the ordinary rows that are called secrets) of rows that neither
    taught nor set the threshold."""
    left = labelled.where((F.length("text") > 0) & (part() == 4))
    over = F.avg((model.score(F.col("text")) > model.threshold).cast("double"))
    rates = {r["secret"]: r["rate"] for r in left.groupBy("secret").agg(over.alias("rate")).collect()}
    return rates.get(True, 0.0), rates.get(False, 0.0)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


NO_SPANS = "array<struct<start:int,place:int,end:int,kind:string,hit:string>>"


def cut(text: Column, pattern: str) -> Column:
    """(gap, hit) of a pattern's leftmost non-overlapping matches, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda f: F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(f)), f, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))))


def hits(text: Column, pattern: str, kind: str, keep) -> Column:
    """Spans (start, place of the kind, end, kind, match) of a pattern's matches that `keep`."""
    none = F.array().cast(NO_SPANS)
    size = lambda p: F.length(p["gap"]) + F.length(p["hit"])

    def step(s: Column, p: Column) -> Column:
        start = s["at"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("place"), end.alias("end"), F.lit(kind).alias("kind"), p["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.when(keep(p["hit"]), F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    def spans(pieces: Column) -> Column:
        first = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int"))
        blocks = F.transform(first, lambda i: F.slice(pieces, i * BLOCK + 1, BLOCK))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda s, x: F.struct(F.aggregate(x, s["at"], lambda n, p: n + size(p)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        inside = lambda x, at: F.aggregate(x, F.struct(at.alias("at"), none.alias("out")), step, lambda s: s["out"])
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, F.aggregate(bs, begin, add, lambda s: s["out"]), inside)))

    found = let(cut(text, pattern), lambda p: F.when(F.size(p) > 0, spans(p)).otherwise(none))
    return F.when(text.rlike(pattern), found).otherwise(none)


def blanked(text: Column, pattern: str, keep) -> Column:
    """The text with blanks in place of a pattern's matches that `keep`; places don't change."""
    piece = lambda p: F.concat(p["gap"], F.when(keep(p["hit"]), F.repeat(F.lit(" "), F.length(p["hit"]))).otherwise(p["hit"]))
    rest = F.element_at(F.split(text, pattern, -1), -1)
    return F.when(text.rlike(pattern), F.concat(F.array_join(F.transform(cut(text, pattern), piece), ""), rest)).otherwise(text)


def scanned(df: DataFrame, model: MarkovModel, shortest: int = SHORTEST, text_col: str = "text") -> DataFrame:
    """Adds `base_spans` and `all_spans`, arrays of (start, place, end, kind, hit) by start and kind.

    A null text is empty and has no span.  Runs are sought in what base spans leave, parts of runs in what the runs
    that are spans leave; so added spans overlap no other."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    enough = {"assign": lambda h: F.length(F.regexp_extract(h, ASSIGN, 1)) >= ASSIGN_LEAST, "access": lambda h: F.lit(True), "hex": lambda h: F.lit(True)}
    out = df.withColumn("base_spans", F.array_sort(F.concat(*[hits(text, p, k, enough[k]) for k, p in BASE.items()])))
    left = text
    for k, p in BASE.items():
        out = out.withColumn("_left", blanked(left, p, enough[k]))
        left = F.col("_left")
    likely = lambda h: model.score(h) > model.threshold
    run, inner = f"[A-Za-z0-9+/_=-]{{{shortest},}}", f"[A-Za-z0-9]{{{shortest},}}"
    out = out.withColumn("_whole", hits(left, run, "markov", likely))
    out = out.withColumn("_left", F.when(F.size("_whole") > 0, blanked(left, run, likely)).otherwise(left))
    out = out.withColumn("_parts", hits(left, inner, "markov", likely))
    every = F.when(F.size("_whole") + F.size("_parts") == 0, F.col("base_spans")).otherwise(F.array_sort(F.concat("base_spans", "_whole", "_parts")))
    return out.withColumn("all_spans", every).drop("_whole", "_parts", "_left")


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets(df: DataFrame, model: MarkovModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_markov) of every row; repeated rows repeat."""
    found = scanned(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), model, text_col="_text")
    count = lambda k: F.size(F.filter("all_spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(F.col("_id").alias(id_col), *(count(k) for k in BASE), F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("all_spans").alias("spans"), count("markov"))


def redacted(df: DataFrame, model: MarkovModel, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span, overlapping ones together, replaced by `mark`."""
    columns = df.columns
    named = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)])
    at = f"_{columns.index(text_col)}"
    found = scanned(named, model, text_col=at)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(F.col(at), s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        out = F.when(x["start"] >= s["at"], F.concat(s["out"], gap, F.lit(mark))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(F.col(at), s["at"] + 1, F.length(at)))
    text = F.when(F.size("all_spans") == 0, F.col(at)).otherwise(F.aggregate("all_spans", begin, step, rest))
    return found.withColumn(at, text).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(columns)])
