"""Byte-pair encoding by speculation and verification.

A batch of texts is cut into words by array operations, words are looked up in a table of words met before, and for
the rest a greedy longest match over all of them at once *proposes* tokens.  A proposal is the true encoding exactly
if no merge can cross any border between two adjacent tokens, which is *verified* for every adjacent pair at once.
Only words with a pair that fails are merged exactly, again all of them side by side.

Why the pair test is enough: merges run in rank order and a merge always ranks after those that made its parts.  While
no merge has crossed a border, both sides develop as each would alone, so at any time the border has a token u of the
left token's right spine and a token v of the right token's left spine.  The first crossing merge (u, v) happens if
it ranks before the merge that consumes u and not after the one that consumes v (of equal merges the left one runs
first).  If no such pair of spine nodes exists the border survives.

A word of more than LONG_WORD bytes is cut into tiles.  Which token ends the encoding of each prefix of a tile is found
for all tiles side by side; tiles overlap, and where a tile agrees with the one before over the length of the longest
token, it goes on as the whole word would, since the last token of a prefix depends on nothing further back.  A tile
that doesn't agree is done again with the state of the one before.

Words are identified by a 64-bit hash; nothing else about the result is probabilistic.
"""

from __future__ import annotations

import json
import unicodedata
import uuid

import numpy as np
import regex

from .arrays import RANDOMS, U64, UNIT, HashTable, Rolling, mix, ragged, text_buffer, units

OTHER, LETTER, NUMBER, SPACE, SPECIAL = range(5)
NEVER = np.int64(1) << 40
#: Longer words are encoded by tiles of so many bytes, so many bytes of tiles at once, and not remembered.
LONG_WORD, TILE, TILES = 512, 1024, 1 << 17
#: Words and token pairs remembered by a worker before it starts over; bounds its memory, never changes a result.
WORDS_KEPT, PAIRS_KEPT = 400_000, 1_000_000


# Ranges of letters and numbers that only Unicode 17 has; the word splitter of suffix vocabularies doesn't know them.
YOUNG = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF3), (0x16FF4, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
]


def code_point_classes(old: bool) -> np.ndarray:
    """Letter, number, white space or other; with `old`, letters of Unicode 17 alone are other."""
    out = np.zeros(0x110000, dtype=np.uint8)
    everything = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            out[m.start() : m.end()] = kind
    if old:
        for first, last in YOUNG:
            out[first : last + 1] = OTHER
    return out


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, inverted."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Arrays of a byte-level BPE file of the tokenizers library; picklable, so that one copy can be broadcast.

    Two layouts are understood: words that keep a leading space (no suffix), and words with an end-of-word suffix
    over lower-cased text with white space dropped.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.key = uuid.uuid4().hex
        assert model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        ids, of_char = model["vocab"], byte_symbols()
        n = self.size = max([*ids.values(), *self.special.values()]) + 1
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.rank = np.full(n, -1, np.int64)
        self.first = np.full(512, -1, np.int32)  # token of one symbol; 256 + byte is a byte that ends a word
        self.bytes = [b""] * n
        symbols: list[tuple[int, ...]] = [()] * n
        for token, i in ids.items():
            ends = bool(self.suffix) and token.endswith(self.suffix)
            raw = [of_char[c] for c in (token[: -len(self.suffix)] if ends else token)]
            self.bytes[i] = bytes(raw)
            symbols[i] = tuple(raw[:-1]) + ((raw[-1] + 256 * ends,) if raw else ())
            if len(raw) == 1:
                self.first[symbols[i][0]] = i
        for raw, i in self.special.items():
            self.bytes[i] = raw
        pairs = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            whole = ids[a + b]
            assert self.rank[whole] < 0, "a token must have one merge"
            self.left[whole], self.right[whole], self.rank[whole] = ids[a], ids[b], rank
            pairs.append((ids[a], ids[b], whole))
        self.merges = np.array(pairs, dtype=np.int64)
        assert (self.first[: 512 if self.suffix else 256] >= 0).all(), "every byte must have a token"
        # A token is reachable if the merge of its two parts is the only one that crosses the border between them.
        made, ok = self.merges[:, 2], np.ones(n, dtype=bool)
        ok[made] = Coder(self, bare=True).compatible(self.merges[:, 0], self.merges[:, 1], top=True)
        for a, b, whole in pairs:
            ok[whole] &= ok[a] & ok[b]  # parts come before wholes
        usable = [i for i in range(n) if symbols[i] and ok[i] and (len(symbols[i]) == 1 or self.rank[i] >= 0)]
        flat = np.array([s for i in usable for s in symbols[i]], dtype=np.int64)
        lengths = np.array([len(symbols[i]) for i in usable], dtype=np.int64)
        self.sizes, self.longest = [len(x) for x in symbols], int(lengths.max(initial=1))
        start = np.cumsum(lengths) - lengths
        rolling = Rolling(flat, RANDOMS)
        at, known = np.repeat(start, lengths), np.repeat(np.array(usable, np.int64), lengths)
        end = np.arange(len(flat)) + 1
        whole = end == np.repeat(start + lengths, lengths)
        keys = rolling.slices(at, end)
        order = np.lexsort((~whole, keys))
        keys, whole, known = keys[order], whole[order], known[order]
        new = np.append(True, keys[1:] != keys[:-1])
        #: Every prefix of a usable token: its id if it is one, else -2.
        self.prefix_keys, self.prefix_values = keys[new], np.where(whole, known, -2)[new]
        self.classes = code_point_classes(old=bool(self.suffix))


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(((a.astype(U64) + U64(1)) << U64(32)) | (b.astype(U64) + U64(1))) | U64(1)


class Coder:
    """One worker's tables over a Vocabulary."""

    def __init__(self, vocabulary: Vocabulary, bare: bool = False):
        self.v = v = vocabulary
        self.ranks = HashTable(18)
        self.ranks.put(pair_key(v.merges[:, 0], v.merges[:, 1]), np.arange(len(v.merges)))
        self.merged = v.merges[:, 2]
        if bare:
            return
        self.prefixes = HashTable(18)
        self.prefixes.put(v.prefix_keys, v.prefix_values)
        self.pairs = HashTable(18)
        self.ascii = v.classes[:128]
        self._forget()

    def _forget(self) -> None:
        self.words = HashTable(18)
        self.entry_at, self.entry_n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.entries, self.pool, self.pooled = 0, np.zeros(1 << 18, np.int32), 0

    # --- verification

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.ranks.get(pair_key(a, b)).astype(np.int64)
        r[r < 0] = NEVER
        return r

    def compatible(self, a: np.ndarray, b: np.ndarray, top: bool = False) -> np.ndarray:
        """Whether no merge crosses the border between tokens a and b; with `top`, none but that of a and b."""
        v, ok = self.v, np.ones(len(a), dtype=bool)
        rows, u, above_u = np.arange(len(a)), a.astype(np.int64), np.full(len(a), NEVER)
        while rows.size:
            inner, w, above_w = np.arange(len(rows)), b[rows].astype(np.int64), np.full(len(rows), NEVER)
            while inner.size:
                r = self.pair_ranks(u[inner], w)
                crosses = (r < above_u[inner]) & (r <= above_w)
                if top:
                    crosses &= ~((u[inner] == a[rows[inner]]) & (w == b[rows[inner]]))
                ok[rows[inner[crosses]]] = False
                go = ~crosses & (v.left[w] >= 0)
                inner, above_w, w = inner[go], v.rank[w[go]], v.left[w[go]].astype(np.int64)
            go = ok[rows] & (v.right[u] >= 0)
            rows, above_u, u = rows[go], v.rank[u[go]], v.right[u[go]].astype(np.int64)
        return ok

    def known_compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`compatible`, remembered by pair."""
        keys = pair_key(a, b)
        found = self.pairs.get(keys)
        new = np.flatnonzero(found < 0)
        if new.size:
            distinct, where, back = np.unique(keys[new], return_index=True, return_inverse=True)
            ok = self.compatible(a[new[where]], b[new[where]])
            if self.pairs.size > PAIRS_KEPT:
                self.pairs = HashTable(18)
            self.pairs.put(distinct, ok.astype(np.int32))
            found[new] = ok[back]
        return found.astype(bool)

    # --- words

    def classes(self, data: np.ndarray) -> np.ndarray:
        """The class of every byte's character."""
        low = data < 128
        out = self.ascii[np.where(low, data, 0)]
        if low.all():
            return out
        lead = np.flatnonzero(data >= 0xC0)
        padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
        b0, b1, b2, b3 = (padded[lead + i] for i in range(4))
        n = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        cp = np.where(n == 2, (b0 & 31) << 6 | b1 & 63, np.where(n == 3, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63))
        kind = self.v.classes[np.minimum(cp, 0x10FFFF)]
        out[lead] = kind
        for i in (1, 2, 3):
            more = n > i
            at = lead[more] + i
            inside = at < len(data)
            out[at[inside]] = kind[more][inside]
        return out

    def specials(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, id) of the special strings in the texts, leftmost first and without overlap."""
        found = []
        raw = data.tobytes()
        pattern = regex.compile(b"|".join(regex.escape(s) for s in self.v.special)) if self.v.special else None
        stop = 0
        while pattern and (m := pattern.search(raw, stop)):
            inside = np.searchsorted(offsets, m.start(), side="right") == np.searchsorted(offsets, m.end(), side="left")
            if inside:
                found.append((m.start(), m.end(), self.v.special[m.group()]))
            stop = m.end() if inside else m.start() + 1
        return found

    def split(self, data: np.ndarray, borders: np.ndarray, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, special id or -1) of every word of the texts that begin at `borders`."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        cls = self.classes(data)
        edge = np.zeros(n + 4, dtype=bool)
        edge[borders[borders < n]] = True
        for at, stop, _ in found:
            cls[at:stop] = SPECIAL
            edge[at] = edge[stop] = True
        start = np.zeros(n + 4, dtype=bool)
        start[0] = True
        start[1:n] = cls[1:] != cls[:-1]
        start |= edge
        start[n:] = False
        if self.v.suffix:
            start[:n] |= (cls == NUMBER) & ((data & 0xC0) != 0x80)
        else:
            e = np.flatnonzero(start[1:n] & ~edge[1:n] & (cls[1:] != SPACE) & (cls[:-1] == SPACE)) + 1
            p = e - 1
            for _ in range(3):
                p = np.where((data[p] & 0xC0) == 0x80, p - 1, p)
            start[p] = True
            start[e[data[p] == 0x20]] = False
        padded = np.append(data, np.zeros(4, np.uint8))
        q = np.flatnonzero((data == 0x27) & start[:n])
        q = q[~edge[q + 1] & (q + 1 < n)]
        one = q[np.isin(padded[q + 1], np.frombuffer(b"stmd", np.uint8))]
        two = q[~edge[q + 2]]
        c, d = padded[two + 1], padded[two + 2]
        two = two[((c == ord("r")) | (c == ord("v"))) & (d == ord("e")) | (c == ord("l")) & (d == ord("l"))]
        start[one + 1] = False
        start[two + 1] = False
        start[one + 2] = True
        start[two + 3] = True
        at = np.flatnonzero(start[:n])
        end = np.append(at[1:], n)
        kind = np.full(len(at), -1, np.int64)
        for where, _, i in found:
            kind[np.searchsorted(at, where)] = i
        if self.v.suffix:
            keep = (cls[at] != SPACE) | (kind >= 0)
            at, end, kind = at[keep], end[keep], kind[keep]
        return at, end, kind

    def symbols(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of some words, one after the other, and the words' offsets."""
        lengths = end - start
        out = data[ragged(start, lengths)].astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        if self.v.suffix:
            out[offsets[1:] - 1] += 256
        return out, offsets

    # --- proposals and exact merges

    def matches(self, rolling: Rolling, at: np.ndarray, stop: np.ndarray, all_lengths: bool = False):
        """The longest token from each position, as (id, length); with `all_lengths`, (row, id, length) of every one."""
        best, size = np.full(len(at), -1, np.int64), np.zeros(len(at), np.int64)
        rows, n, found = np.arange(len(at)), 1, []
        while rows.size:
            rows = rows[at[rows] + n <= stop[rows]]
            value = self.prefixes.get(rolling.slices(at[rows], at[rows] + n))
            hit = value >= 0
            if all_lengths:
                found.append((rows[hit], value[hit].astype(np.int64), np.full(int(hit.sum()), n, np.int64)))
            best[rows[hit]], size[rows[hit]] = value[hit], n
            rows, n = rows[value != -1], n + 1
        if all_lengths:
            return tuple(np.concatenate([f[i] for f in found]) for i in range(3)) if found else (at[:0],) * 3
        return best, size

    def propose(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest-match tokens of all words: (word, token), in order of the words and places."""
        rolling, rows, at = Rolling(symbols, RANDOMS), np.arange(len(offsets) - 1), offsets[:-1].copy()
        words, tokens, places = [], [], []
        while rows.size:
            token, size = self.matches(rolling, at[rows], offsets[rows + 1])
            words.append(rows)
            tokens.append(token)
            places.append(at[rows])
            at[rows] += size
            rows = rows[at[rows] < offsets[rows + 1]]
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(np.concatenate(places), kind="stable")
        return np.concatenate(words)[order], np.concatenate(tokens)[order]

    def merge(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words side by side: (word, token)."""
        word, token = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), self.v.first[symbols].astype(np.int64)
        done_w, done_t = [], []
        while word.size:
            rank = np.full(len(word), NEVER)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.pair_ranks(token[inside], token[inside + 1])
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            over = np.repeat(least == NEVER, np.diff(np.append(first, len(word))))
            done_w.append(word[over])
            done_t.append(token[over])
            # The leftmost pair of the least rank of each word that has one.
            hits = np.flatnonzero((rank == np.repeat(least, np.diff(np.append(first, len(word))))) & ~over)
            hits = hits[np.append(True, word[hits[1:]] != word[hits[:-1]])] if hits.size else hits
            token[hits] = self.merged[rank[hits]]
            keep = ~over
            keep[hits + 1] = False
            word, token = word[keep], token[keep]
        word, token = np.concatenate(done_w or [word]), np.concatenate(done_t or [token])
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def last_in_words(self, symbols: np.ndarray, offsets: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
        """For every prefix of every word the last token of its encoding: of the tokens that end there the only one
        that is compatible with the last token of the rest.  `given` holds last tokens that are known already, else -1."""
        lengths = np.diff(offsets)
        at = np.arange(len(symbols))
        row, token, size = self.matches(Rolling(symbols, RANDOMS), at, np.repeat(offsets[1:], lengths), all_lengths=True)
        begin = np.repeat(offsets[:-1], lengths)
        ends_at = row + size - 1
        last = np.full(len(symbols), -1, np.int64)
        if given is not None:
            last[: len(given)] = given
            free = ends_at >= len(given)
            row, token, ends_at = row[free], token[free], ends_at[free]
        step = ends_at - begin[row]
        order = np.argsort(step, kind="stable")
        row, token, ends_at, step = row[order], token[order], ends_at[order], step[order]
        borders = np.searchsorted(step, np.arange(int(lengths.max(initial=0)) + 1))
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            r, t, e = row[a:b], token[a:b], ends_at[a:b]
            inner = r > begin[r]
            ok = ~inner
            ok[inner] = self.known_compatible(last[r[inner] - 1], t[inner])
            last[e[ok]] = t[ok]
        return last

    def last_tokens(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one long word, by overlapping tiles."""
        n, longest = len(symbols), self.v.longest
        overlap = max(256, 2 * longest)
        last = np.empty(n, np.int64)
        known = 0  # places whose last tokens are final
        for first in range(0, n, TILES):
            starts = np.arange(first, min(n, first + TILES), TILE)
            ends = np.minimum(n, starts + TILE + overlap)
            offsets = np.concatenate(([0], np.cumsum(ends - starts)))
            found = self.last_in_words(symbols[ragged(starts, ends - starts)], offsets)
            for a, b, own in zip(starts.tolist(), ends.tolist(), offsets.tolist(), strict=False):
                tile, far = found[own : own + b - a], known - a
                if a and (far < longest or (last[known - longest : known] != tile[far - longest : far]).any()):
                    back = min(longest, known)
                    tile = self.last_in_words(symbols[known - back : b], np.array([0, b - known + back]), given=last[known - back : known])
                    far, a = back, known - back
                last[known:b] = tile[far:]
                known = b
        return last

    def long_word(self, symbols: np.ndarray) -> np.ndarray:
        """The tokens of one long word, followed from its end."""
        last, size, out = self.last_tokens(symbols).tolist(), self.v.sizes, []
        end = len(last)
        while end:
            token = last[end - 1]
            out.append(token)
            end -= size[token]
        return np.array(out[::-1], dtype=np.int64)

    def encode_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, their number by word) of words of at most LONG_WORD bytes."""
        symbols, offsets = self.symbols(data, start, end)
        word, token = self.propose(symbols, offsets)
        border = np.flatnonzero(word[1:] == word[:-1])
        bad = np.zeros(len(start), dtype=bool)
        bad[word[border[~self.known_compatible(token[border], token[border + 1])]]] = True
        if bad.any():
            which = np.flatnonzero(bad)
            lengths = np.diff(offsets)[which]
            w, t = self.merge(symbols[ragged(offsets[which], lengths)], np.concatenate(([0], np.cumsum(lengths))))
            good = ~bad[word]
            word, token = np.concatenate((word[good], which[w])), np.concatenate((token[good], t))
            order = np.argsort(word, kind="stable")
            word, token = word[order], token[order]
        return token, np.bincount(word, minlength=len(start))

    def remember(self, keys: np.ndarray, token: np.ndarray, counts: np.ndarray) -> None:
        n, m = self.entries + len(keys), self.pooled + len(token)
        if n > len(self.entry_at):
            self.entry_at, self.entry_n = (np.resize(x, 2 * n) for x in (self.entry_at, self.entry_n))
        if m > len(self.pool):
            self.pool = np.resize(self.pool, 2 * m)
        self.entry_at[self.entries : n] = self.pooled + np.cumsum(counts) - counts
        self.entry_n[self.entries : n] = counts
        self.pool[self.pooled : m] = token
        self.words.put(keys, np.arange(self.entries, n))
        self.entries, self.pooled = n, m

    def prepared(self, data: np.ndarray, offsets: np.ndarray):
        """(bytes, offsets, words' start, end, special id) of texts, after the vocabulary's own normalisation."""
        found = self.specials(data, offsets)
        if self.v.suffix:
            data, offsets, found = normalised(data, offsets, found)
        return data, offsets, *self.split(data, offsets[:-1], found)

    def look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """The entry of every plain word; those not met before are encoded."""
        if self.entries > WORDS_KEPT:
            self._forget()
        if not plain.all() and len(data) > 4 * UNIT:  # long words aren't hashed
            keys = np.zeros(len(start), U64)
            lengths = (end - start)[plain]
            where = np.cumsum(lengths) - lengths
            keys[plain] = Rolling(data[ragged(start[plain], lengths)], RANDOMS).slices(where, where + lengths)
        else:
            keys = Rolling(data, RANDOMS).slices(start, end)
        entry = np.full(len(start), -1, np.int32)
        entry[plain] = self.words.get(keys[plain])
        new = np.flatnonzero((entry < 0) & plain)
        if new.size:
            distinct, where = np.unique(keys[new], return_index=True)
            self.remember(distinct, *self.encode_words(data, start[new[where]], end[new[where]]))
            entry[new] = self.words.get(keys[new])
        return entry

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids by text) of some texts in one buffer."""
        data, offsets, start, end, special = self.prepared(data, offsets)
        plain = (special < 0) & (end - start <= LONG_WORD)
        long = np.flatnonzero((special < 0) & ~plain)
        entry = self.look_up(data, start, end, plain)
        lengths = np.ones(len(start), np.int64)
        lengths[plain] = self.entry_n[entry[plain]]
        extra = [self.long_word(self.symbols(data, start[i : i + 1], end[i : i + 1])[0]) for i in long]
        lengths[long] = [len(x) for x in extra]
        place = np.cumsum(lengths) - lengths
        ids = np.empty(int(lengths.sum()), np.int32)
        ids[ragged(place[plain], lengths[plain])] = self.pool[ragged(self.entry_at[entry[plain]], lengths[plain])]
        ids[place[special >= 0]] = special[special >= 0]
        for i, x in zip(long, extra, strict=True):
            ids[place[i] : place[i] + len(x)] = x
        ends = np.append(0, np.cumsum(lengths))[np.searchsorted(start, offsets)]
        return ids, np.diff(ends)

    def word_cuts(self, data: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of about UNIT bytes of one long text that end where a word surely ends: before white space that
        follows a printable byte, or before punctuation or a number (which never join what is before them) of more
        than one byte that follows a letter."""
        cuts, at = [0], UNIT
        while len(data) - at > UNIT:
            window = data[at - 1 : at + UNIT]
            ends = (window[1:] == 0x20) & (window[:-1] > 0x20) & (window[:-1] < 0x7F)
            for x in [] if ends.any() else np.flatnonzero(window[1:-3] >= 0xE0).tolist():
                text = window[max(0, x - 3) : x + 5].tobytes().decode("utf-8", "ignore")
                here = window[x + 1 : x + 5].tobytes().decode("utf-8", "ignore")[:1]
                before = text[: text.rfind(here)][-1:] if here else ""
                if here and before and unicodedata.category(here)[0] in "PN" and self.v.classes[ord(before)] == LETTER and self.v.classes[ord(here)] in (OTHER, NUMBER):
                    ends[x] = True
                    break
            found = np.flatnonzero(ends)
            if found.size:
                at += int(found[0])
                cuts.append(at)
            at += UNIT
        return list(zip(cuts, [*cuts[1:], len(data)], strict=True))

    def encode_long(self, data: np.ndarray) -> np.ndarray:
        """The ids of one long text, part by part."""
        return np.concatenate([self.encode(data[a:b], np.array([0, b - a]))[0] for a, b in self.word_cuts(data)])

    def encode_column(self, column):
        """(first row, ids, number of ids by text) of an Arrow string column, some rows at a time."""
        data, offsets = text_buffer(column)
        for first, last in units(data, offsets):
            part = data[offsets[first] : offsets[last]]
            if len(part) > 4 * UNIT and last == first + 1:
                ids = self.encode_long(part)
                yield first, ids, np.array([len(ids)])
            else:
                yield first, *self.encode(part, offsets[first : last + 1] - offsets[first])


# Lower case of letters that Unicode gained after version 15.1, by range of code points.
NEWER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEWER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: A capital sigma is lowered without regard to its place.
NEWER_LOWER |= {0x3A3: 0x3C3}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def normalised(data: np.ndarray, offsets: np.ndarray, found: list[tuple[int, int, int]]):
    """Texts composed (NFC) and lower-cased character by character, special strings apart."""
    if not (data >= 128).any():
        out = LOWER[data]
        for at, stop, _ in found:
            out[at:stop] = data[at:stop]
        return out, offsets, found
    cuts = np.unique(np.concatenate((offsets, [x for f in found for x in f[:2]]))).astype(np.int64)
    fixed, raw, pieces = {f[0] for f in found}, data.tobytes(), []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        piece = raw[a:b]
        if a not in fixed:
            if piece.isascii():
                piece = piece.lower()
            else:
                text = piece.decode("utf-8", "replace")
                if not unicodedata.is_normalized("NFC", text):
                    text = unicodedata.normalize("NFC", text)
                piece = text.translate(NEWER_LOWER).lower().encode()
        pieces.append(piece)
    new = np.concatenate(([0], np.cumsum([len(x) for x in pieces]))).astype(np.int64)
    moved = lambda x: new[np.searchsorted(cuts, x)]
    found = [(int(moved(a)), int(moved(b)), i) for a, b, i in found]
    return np.frombuffer(b"".join(pieces), np.uint8), moved(offsets), found
