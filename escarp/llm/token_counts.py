"""Operator 8: exact token counts at every prefix of a text, by dynamic programming.

Inside a word, the encoding of a prefix ends in one token t, and the rest is the encoding of the prefix before t; t is
the only token ending there that is compatible (see bpe.py) with the last token of that shorter prefix.  So one pass
over the tokens that end at each byte fills a table of last tokens and counts, for all words of a batch side by side.
Counts of a whole text are sums of its words' last entries, and questions about truncation and budgets are answered
from the table, without encoding anything again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import UNIT, ragged, text_buffer, units
from .bpe import LONG_WORD, Coder

_counters: dict[str, PrefixCounter] = {}


class PrefixCounter(Coder):
    """A Coder whose remembered words have, for each byte, the number of tokens of the prefix that ends there."""

    def __init__(self, vocabulary):
        if vocabulary.suffix:
            raise ValueError("prefixes of a word are no words where the last byte carries a word-end mark")
        super().__init__(vocabulary)
        self.lengths = np.array(vocabulary.sizes, dtype=np.int64)

    def encode_words(self, data, start, end):
        symbols, offsets = self.symbols(data, start, end)
        return self.table(symbols, offsets), np.diff(offsets)

    def table(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of the prefix that ends at each byte of each word."""
        lengths = np.diff(offsets)
        last = np.empty(len(symbols), np.int64)
        for i in np.flatnonzero(lengths > LONG_WORD):
            last[offsets[i] : offsets[i + 1]] = self.last_tokens(symbols[offsets[i] : offsets[i + 1]])
        short = np.flatnonzero(lengths <= LONG_WORD)
        places = ragged(offsets[short], lengths[short])
        last[places] = self.last_in_words(symbols[places], np.concatenate(([0], np.cumsum(lengths[short]))))
        # A prefix has one token more than its rest: numbers of steps to the word's begin, by doubling.
        begin = np.repeat(offsets[:-1], lengths)
        rest = np.arange(len(symbols)) - self.lengths[last]
        count, rest = np.ones(len(symbols), np.int32), np.where(rest < begin, -1, rest)
        while (go := np.flatnonzero(rest >= 0)).size:
            count[go], rest[go] = count[go] + count[rest[go]], rest[rest[go]]
        return count

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each text."""
        _, offsets, start, end, special = self.prepared(data, offsets)
        plain = (special < 0) & (end - start <= LONG_WORD)
        entry = self.look_up(data, start, end, plain)
        n = np.where(plain, self.pool[np.where(plain, self.entry_at[entry] + self.entry_n[entry] - 1, 0)], 1).astype(np.int64)
        for i in np.flatnonzero((special < 0) & ~plain):
            n[i] = self.table(*self.symbols(data, start[i : i + 1], end[i : i + 1]))[-1]
        sums = np.append(0, np.cumsum(n))[np.searchsorted(start, offsets)]
        return np.diff(sums)

    def counts_of_column(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, tokens) of every text of an Arrow string column."""
        data, offsets = text_buffer(column)
        found = [self.counts_of_long(data[offsets[a] : offsets[b]]) if offsets[b] - offsets[a] > 4 * UNIT and b == a + 1 else self.counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in units(data, offsets)]
        return np.diff(offsets), np.concatenate(found) if found else np.zeros(0, np.int64)

    def counts_of_long(self, data: np.ndarray) -> np.ndarray:
        """The number of tokens of one long text: the sum over parts that end with a word."""
        return np.array([sum(int(self.counts(data[a:b], np.array([0, b - a]))[0]) for a, b in self.word_cuts(data))])

    def prefix_counts(self, text: str) -> np.ndarray:
        """For each byte of a text's UTF-8, the tokens of the prefix that ends there (right where a character ends).

        A prefix may split into words otherwise than the whole text: white space at its end is one word, and a cut
        contraction or special string is plain text.  Those few places are filled from tables of their own."""
        data = np.frombuffer(text.encode(), np.uint8)
        if not len(data):
            return np.zeros(0, np.int64)
        _, _, start, end, special = self.prepared(data, np.array([0, len(data)]))
        plain = special < 0
        before = np.zeros(len(start), np.int64)
        out = np.zeros(len(data), np.int64)
        symbols, offsets = self.symbols(data, start[plain], end[plain])
        inside = np.ones(len(data), np.int64)
        inside[ragged(start[plain], np.diff(offsets))] = self.table(symbols, offsets)
        before[1:] = np.cumsum(inside[end - 1])[:-1]
        out = np.repeat(before, end - start) + inside
        for i in np.flatnonzero(special >= 0):
            first = max([0, i - 2, *(np.flatnonzero(special[:i] >= 0) + 1)])
            for stop in range(start[i] + 1, end[i]):
                part = data[start[first] : stop]
                out[stop - 1] = before[first] + self.counts(part, np.array([0, len(part)]))[0]
        cls = self.classes(data)
        for i in np.flatnonzero(plain & (end - start == 3) & (data[start] == 0x27) & (cls[np.minimum(start + 1, len(data) - 1)] == 1)):
            out[start[i] + 1] = out[start[i]] + self.table(*self.symbols(data, start[i : i + 1] + 1, start[i : i + 1] + 2))[-1]
        space = np.append(cls == 3, False)
        runs = np.flatnonzero(np.diff(np.append(False, space).astype(np.int8)))
        for a, b in zip(runs[::2], runs[1::2], strict=True):
            first = np.searchsorted(start, a, side="right") - 1
            out[a:b] = before[first] + self.table(*self.symbols(data, np.array([a]), np.array([b])))
        return out

    def truncation(self, text: str, budget: int) -> tuple[int, int]:
        """(length in bytes, tokens) of the longest prefix of whole characters with at most `budget` tokens."""
        data = np.frombuffer(text.encode(), np.uint8)
        whole = np.append((data[1:] & 0xC0) != 0x80, True) if len(data) else np.zeros(0, bool)
        counts = self.prefix_counts(text)
        fits = np.flatnonzero(whole & (counts <= budget))
        return (int(fits[-1]) + 1, int(counts[fits[-1]])) if fits.size else (0, 0)


def counter(vocabulary) -> PrefixCounter:
    v = vocabulary.value
    if v.key not in _counters:
        _counters.clear()
        _counters[v.key] = PrefixCounter(v)
    return _counters[v.key]


def token_counts(df: DataFrame, vocabulary, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text; a null text is empty and has 0 of each."""

    def run(batches):
        for batch in batches:
            n_bytes, n_tokens = counter(vocabulary).counts_of_column(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit, pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def truncate(df: DataFrame, vocabulary, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_tokens): each text's longest prefix within the budget of tokens, and its exact count."""

    def run(batches):
        for batch in batches:
            c, texts, n = counter(vocabulary), [], []
            for text in batch.column("text").to_pylist():
                size, tokens = c.truncation(text or "", budget)
                texts.append((text or "").encode()[:size].decode())
                n.append(tokens)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array(n, pa.int64())], ["id", "text", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, text string, n_tokens bigint")
    return out.withColumnRenamed("id", id_col)
