"""Operator 6: near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set is that of its distinct w-word shingles (64-bit hashes).  Its sketch has k coordinates, filled in
rounds: in round i < k every element goes to a random bin, in round k + j all go to bin j, a bin keeps the least value
of the first round that reaches it, and rounds end once all bins are full.  So a sketch costs about one pass over the
set (more only for sets with fewer elements than bins), every coordinate is filled, and the number of equal
coordinates of two sketches concentrates around their Jaccard similarity.

Documents with equal sets are one class from the start.  Classes that agree on all coordinates of a band share a
bucket, and links are confirmed on full sets.  What is wanted are connected components, so a bucket isn't compared
pair by pair:

1. All members are compared with one pivot, which settles a bucket if everything links, as in groups of near copies.
   Members of one component need no comparison any more, in this and the next steps.
2. Buckets of at most SMALL members that aren't settled are finished pair by pair, across components.
3. Members of larger ones are compared with the pivots of finer buckets, of 2 and 4 bands together.
4. In buckets that are still not settled, members outside the commonest component are compared with all members, in
   blocks: a task gets two blocks of full sets, and all its intersections are one product of 0/1 matrices.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import RANDOMS, U64, UNIT, Rolling, mix, ragged, text_buffer, units
from .bpe import LOWER
from ..operators.components import components, joined
from .store import cleaned, dropped, written

#: A band's rows and the number of bands.  A link at similarity s is missed with probability (1 - s**ROWS)**BANDS at
#: most: 4e-7 at 0.8, 1e-9 at 0.85.
ROWS, BANDS = 4, 28
SMALL = 64


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; the whole sequence if it has fewer words."""
    data = LOWER[data]
    space = np.empty(len(data) + 1, dtype=bool)
    space[:-1] = (data == 0x20) | ((data >= 9) & (data <= 13))
    space[-1] = True
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(~space[:-1] & (np.append(True, space[:-2]) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~space[:-1] & (space[1:] | edge[1:])) + 1 if len(data) else starts
    h = word_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    factors = mix(np.arange(1, words + 1, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)
    padded = np.append(h, np.zeros(words, dtype=U64))
    total = np.zeros(len(h), dtype=U64)
    for i in range(words):
        total += padded[i : i + len(h)] * factors[i]
    total = mix(total)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(total[a : b - words + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            out.append(mix((h[a:b] * factors[: b - a]).sum(dtype=U64, keepdims=True) + U64(b - a)))
        else:
            out.append(h[:0])
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, by some words at a time where the text is long; very long words by a digest."""
    if len(data) <= 4 * UNIT:
        return Rolling(data, RANDOMS).slices(starts, ends)
    out, first = np.empty(len(starts), dtype=U64), 0
    while first < len(starts):
        if ends[first] - starts[first] > 4 * UNIT:
            digest = hashlib.blake2b(data[starts[first] : ends[first]].tobytes(), digest_size=8).digest()
            out[first] = int.from_bytes(digest, "little") | 1
            first += 1
            continue
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + 4 * UNIT, side="right")))
        a = int(starts[first])
        out[first:last] = Rolling(data[a : ends[last - 1]], RANDOMS).slices(starts[first:last] - a, ends[first:last] - a)
        first = last
    return out


def sketches(sets: list[np.ndarray], k: int) -> np.ndarray:
    """The k coordinates of each set (not empty), by fast similarity sketching."""
    out = np.full(len(sets) * k, ~U64(0), dtype=U64)
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=U64)
    starts, todo = np.cumsum(lengths) - lengths, np.arange(len(sets))
    for i in range(2 * k):
        if not todo.size:
            break
        x = flat[ragged(starts[todo], lengths[todo])] if i else flat
        x = mix(x ^ U64((i + 1) * 0x9FB21C651E98DF25 % (1 << 64)))
        owner = np.repeat(todo, lengths[todo])
        place = (((x >> U64(32)) * U64(k)) >> U64(32)).astype(np.int64) if i < k else i - k
        np.minimum.at(out, owner * k + place, (U64(i) << U64(32)) | (x & U64(0xFFFFFFFF)))
        todo = todo[(out.reshape(-1, k)[todo] == ~U64(0)).any(axis=1)]
    return out.reshape(-1, k)


def band_keys(sketch: np.ndarray, rows: int, bands: int) -> np.ndarray:
    factors = mix(np.arange(11, rows + 11, dtype=U64)) | U64(1)
    return mix((sketch.reshape(-1, bands, rows) * factors).sum(axis=2, dtype=U64) + mix(np.arange(bands, dtype=U64) + U64(77)))


def by_units(batches, words: int):
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for a, b in units(data, offsets):
            yield batch, a, b, shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)


def sketched(df: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, n, node, bands) of rows with (doc_id, text): set size, a 128-bit digest of the set, band keys."""

    def run(batches):
        for batch, a, b, sets in by_units(batches, words):
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = band_keys(sketches([sets[i] for i in full], rows * bands), rows, bands)
            per = np.zeros(b - a, np.int64)
            per[full] = bands
            nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), lists], ["doc_id", "n", "node", "bands"])

    return df.mapInArrow(run, "doc_id bigint, n bigint, node binary, bands array<bigint>")


def full_sets(df: DataFrame, words: int) -> DataFrame:
    """(id, s) of rows with (doc_id, text): the full sets."""

    def run(batches):
        for batch, a, b, sets in by_units(batches, words):
            per = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(per), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], ["id", "s"])

    return df.mapInArrow(run, "id bigint, s array<bigint>")


@cleaned
def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS, small: int = SMALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of documents.

    Links: 100 * intersection >= percent * union.  Texts without words, and null texts, have an empty set and link
    with nothing; rows that share an id are one document; rows whose id is null link with nothing and have no
    component."""
    texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = written(sketched(texts, words, rows, bands), "sketches")
    usable = sketch.where("n > 0 and doc_id is not null")
    # One document stands for all with its set.
    classes = written(usable.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    copies = usable.join(classes.where("copies > 1"), "node").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = usable.join(classes.select("node", F.col("rep").alias("doc_id")), ["node", "doc_id"], "left_semi").dropDuplicates(["doc_id", "node"])
    rows_ = reps.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("id"), "n")
    # Written first, so that the planner may split the buckets that very many documents share.
    shared = written(rows_.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").select("bucket"), "shared")
    members = written(rows_.join(shared, "bucket", "left_semi"), "members")
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    sets = written(full_sets(texts.join(wanted, "doc_id", "left_semi"), words).distinct(), "sets")
    bands_of = reps.select(F.col("doc_id").alias("id"), "bands")
    links = linked(members, bands_of, sets, percent, small)
    labels = components(links.union(copies))
    dropped(classes, shared, members, sets)
    out = sketch.join(labels, sketch.doc_id == labels.id, "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds `common` and `either`, the sizes of the intersection and union of the sets of a and b."""
    sides = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    return sides.withColumn("common", common).withColumn("either", F.size("sa") + F.size("sb") - F.col("common")).drop("sa", "sb")


def near_size(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def linked(members: DataFrame, bands: DataFrame, sets: DataFrame, percent: int, small: int) -> DataFrame:
    """Links (a, b) that connect, in every bucket, all members that similar documents connect.

    `members` has (bucket, id, n), `bands` the band keys of every id in them, `sets` the full sets."""
    links = stars(members, sets, percent)
    open_, now = unsettled(members, links)
    few = open_.where(F.col("members") <= small)
    some = now.join(few.select("bucket"), "bucket", "left_semi")
    other = some.select("bucket", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
    pairs = some.withColumnRenamed("id", "a").join(other, "bucket").where((F.col("a") < F.col("b")) & (F.col("c") != F.col("cb")) & near_size(F.col("n"), F.col("nb"), percent)).select("a", "b").distinct()
    links = links.union(written(confirmed(similar(pairs, sets), percent), "links"))
    many = written(open_.where(F.col("members") > small).select("bucket"), "many")
    if many.isEmpty():
        return links
    # Finer buckets, of several bands together, have pivots that are more alike.
    left = written(members.join(many, "bucket", "left_semi"), "many")
    ids = left.select("id", "n").distinct()
    finer = [F.explode(several(k)).alias("bucket") for k in (2, 4)]
    of = written(ids.join(bands, "id"), "finer")
    parts = [of.select(x, "id", "n") for x in finer]
    rows_ = parts[0]
    for x in parts[1:]:
        rows_ = rows_.union(x)
    links = links.union(stars(rows_, sets, percent))
    open_, now = unsettled(left, links)
    if open_.isEmpty():
        return links
    return links.union(outsiders(now.join(open_.select("bucket"), "bucket", "left_semi"), sets, percent))


def several(k: int) -> Column:
    """The keys of every k bands together."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size("bands") / k).cast("int") - 1), lambda i: F.xxhash64(F.lit(k), i, F.slice("bands", i * k + 1, k)))


def stars(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links of every bucket's least member with the others."""
    pivots = written(members.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("p"), F.count("*").alias("members")).where("members > 1").select("bucket", F.col("p.id").alias("a"), F.col("p.n").alias("na")), "pivots")
    against = members.join(pivots, "bucket").where("id <> a").where(near_size(F.col("n"), F.col("na"), percent))
    return written(confirmed(similar(against.select("a", F.col("id").alias("b")).distinct(), sets), percent), "links")


def unsettled(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(buckets with members of several components, all members with their component c)."""
    labels = components(links).withColumnRenamed("id", "key")
    now = written(members.join(labels, F.col("id") == F.col("key"), "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("c")), "labelled")
    kinds = now.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("members"))
    return written(kinds.where("low <> high").select("bucket", "members"), "open"), now


def outsiders(now: DataFrame, sets: DataFrame, percent: int, rows: int = 64, columns: int = 256) -> DataFrame:
    """Links between members of a bucket outside its commonest component and all its members, by blocks of full sets."""
    kinds = now.groupBy("bucket", "c").agg(F.count("*").alias("k"))
    home = written(kinds.groupBy("bucket").agg(F.max(F.struct("k", "c")).alias("h")).select("bucket", F.col("h.c").alias("home")), "home")
    placed = now.join(home, "bucket").select("home", "id", (F.col("c") != F.col("home")).cast("int").alias("out"))
    every = written(placed.groupBy("home", "id").agg(F.max("out").alias("out")), "every")
    sizes = written(every.groupBy("home").agg(F.ceil(F.sum("out") / rows).cast("int").alias("down"), F.ceil(F.count("*") / columns).cast("int").alias("across")), "sizes")
    grid = every.join(sizes, "home")
    place = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = grid.where("out = 1").select("home", "id", F.lit(0).alias("side"), place(1, "down").alias("i"), up_to("across").alias("j"))
    right = grid.where("down > 0").select("home", "id", F.lit(1).alias("side"), up_to("down").alias("i"), place(2, "across").alias("j"))
    met = left.union(right).join(sets, "id").select("home", "i", "j", "side", "id", "s")

    def meet(table: pa.Table) -> pa.Table:
        side, ids, full = table.column("side").to_numpy(), table.column("id").to_numpy(), table.column("s").combine_chunks()
        ends = np.asarray(full.offsets)
        values, lengths = np.asarray(full.flatten()), np.diff(ends)
        word, times = np.unique(values, return_counts=True)
        at = np.searchsorted(word, values)
        shared = times[at] > 1
        column = np.cumsum(times > 1)[at[shared]] - 1
        row = np.repeat(np.arange(len(ids)), lengths)[shared]
        common = np.zeros((int((side == 0).sum()), int((side == 1).sum())), dtype=np.float64)
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        step = 8192
        for first in range(0, int(column.max(initial=-1)) + 1, step):
            a, b = np.searchsorted(column, (first, first + step))
            dense = np.zeros((len(ids), step), dtype=np.float32)
            dense[row[a:b], column[a:b] - first] = 1
            common += dense[side == 0] @ dense[side == 1].T
        either = lengths[side == 0][:, None] + lengths[side == 1][None, :] - common
        x, y = np.nonzero(100 * common >= percent * either)
        p, q = ids[side == 0][x], ids[side == 1][y]
        p, q = joined(p[p != q], q[p != q])
        return pa.table({"a": p[p != q], "b": q[p != q]})

    return written(met.groupBy("home", "i", "j").applyInArrow(meet, "a bigint, b bigint"), "links")


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.where(100 * F.col("common") >= percent * F.col("either")).select("a", "b")


def deduplicated(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents but for near duplicates: of each group the one of the least id stays, once.

    Rows whose id is null all stay.  The result is not written; it reads tables of ids that stay in the shared folder."""
    found = written(near_duplicates(df, words, percent, id_col=id_col, text_col=text_col).where("kept or component_id is null").select("doc_id"), "kept")
    again = written(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    key = found.select(F.col("doc_id").alias("_kept")).distinct()
    once = df.join(key, df[id_col].cast("bigint").eqNullSafe(F.col("_kept")), "left_semi")
    if again.isEmpty():
        return once
    repeated = again.select(F.col("doc_id").alias("_again"))
    same = df[id_col].cast("bigint") == F.col("_again")
    return once.join(repeated, same, "left_anti").unionByName(once.join(repeated, same, "left_semi").dropDuplicates([id_col]))
