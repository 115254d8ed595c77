"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces come from a public model file. It was made by merges and holds their ranks instead of
log probabilities, so log scores follow from the ranks by the Zipf-Mandelbrot law,
``log p = -log(rank + SHIFT) - log Z``. A text starts with an added marker and its spaces become
markers (U+2581); a character without a piece becomes the byte pieces of its UTF-8 form. A marker
character of the text itself is written as bytes too, so decoding gives back every text exactly.

No piece has a marker after another character (checked when the model is read), so the best
path of a text is that of its words, each with the markers before it, one after another; words
are looked up in a bounded cache and only new ones are searched.

Defined results: a null text has null ids and decodes to null; an empty text is one marker and
decodes to an empty text; null ids decode to null; repeated rows and ties of ids change nothing;
among equally good paths the one whose last pieces start first wins. Further columns are kept.
"""

from __future__ import annotations

import ctypes
import math
import re
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
SHIFT = 2.7
UNKNOWN_PENALTY = 10.0
LITERAL, BLANK = MARKER.encode(), ord(" ")
# Words kept between batches and the longest of them; words of more bytes than LONG_WORD are
# searched one by one; bytes encoded together.
CACHE_WORDS, CACHE_BYTES, LONG_WORD, TOGETHER = 150_000, 48, 256, 500_000
FACTOR = 0x9E3779B97F4A7C15  # of the hash of a word's bytes
SOLVED = 1 << 14  # words that are solved together
DECODED = 1 << 14  # ids that are decoded together: few, so that memory is not parted by large arrays that come and go
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
WORD = re.compile(" +[^ ]*|[^ ]+")
# Bytes of a character by its first byte.
WIDTH = [1] * 192 + [2] * 32 + [3] * 16 + [4] * 16


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """Pieces of a model file: text, score and kind. The file is a protocol buffer."""
    import struct

    def fields(buf: bytes):
        at = 0

        def varint() -> int:
            nonlocal at
            value = shift = 0
            while True:
                b = buf[at]
                at += 1
                value |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return value

        while at < len(buf):
            tag = varint()
            if tag & 7 == 0:
                yield tag >> 3, varint()
            else:
                size = {1: 8, 5: 4}.get(tag & 7) or varint()
                yield tag >> 3, buf[at : at + size]
                at += size

    pieces = []
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
    return pieces


def log_scores(pieces: list[tuple[str, float, int]]) -> list[float]:
    """Log probability of each normal piece by its rank; others have none."""
    weights = [1 / (SHIFT - score) if kind == NORMAL else 0.0 for _, score, kind in pieces]
    total = math.log(sum(weights))
    return [math.log(w) - total if w else -math.inf for w in weights]


class DoubleArray:
    """A trie in two arrays: the child of ``node`` by byte ``b`` is ``base[node] + b``, if
    ``check`` names ``node`` as its parent. ``value`` holds the piece that ends at a node."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        tree: dict = {}
        for key, value in keys:
            node = tree
            for b in key:
                node = node.setdefault(b, {})
            node[None] = value
        size = 1 << 12
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        # Nodes with many children are placed first, from a place that only moves on; those with
        # one child fill the gaps.
        free, place, count, waiting = 1, 1, 0, [(0, 0, 0, tree)]
        while waiting:
            _, _, at, node = heappop(waiting)
            self.value[at] = node.pop(None, -1)
            labels = sorted(node)
            if not labels:
                continue
            if len(labels) > 1:
                base, tries = place, 0
                while any(self.check[base + b] >= 0 for b in labels):
                    base, tries = base + 1, tries + 1
                    self.grow(base + 256)
                place += tries // 8
            else:
                while self.check[free] >= 0 or free <= labels[0]:
                    free += 1
                    self.grow(free + 256)
                base = free - labels[0]
            self.base[at] = base
            for b in labels:
                self.check[base + b] = at
                count += 1
                heappush(waiting, (-len(node[b]), count, base + b, node[b]))
            self.grow(place + 512)
        # A node without children must not accept the root's slots as its own.
        self.check[0] = -1

    def grow(self, need: int) -> None:
        if need >= len(self.check):
            more = max(len(self.check), need + 1 - len(self.check))
            self.base += [0] * more
            self.check += [-1] * more
            self.value += [-1] * more


    def packed(self) -> tuple[bytes, ...]:
        return tuple(np.array(x, np.int32).tobytes() for x in (self.base, self.check, self.value))

    @classmethod
    def unpacked(cls, arrays: tuple[bytes, ...]) -> DoubleArray:
        trie = cls([])
        trie.base, trie.check, trie.value = (np.frombuffer(x, np.int32).tolist() for x in arrays)
        return trie


class Codec:
    """Encoder and decoder of a model; ``trie`` is its double array if it is there already."""

    def __init__(self, model: bytes, trie: DoubleArray | None = None):
        pieces = read_model(model)
        scores = log_scores(pieces)
        for text, _, kind in pieces:
            if kind == NORMAL and MARKER in text.lstrip(MARKER):
                raise ValueError(f"the piece {text!r} crosses words")
        self.trie = trie or DoubleArray([(t.encode(), i) for i, (t, _, k) in enumerate(pieces) if k == NORMAL])
        self.scores = scores
        self.unknown = min(s for s in scores if s > -math.inf) - UNKNOWN_PENALTY
        self.byte_ids = [0] * 256
        made: list[bytes] = []
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(text[3:5], 16)] = i
            made.append(bytes([int(text[3:5], 16)]) if kind == BYTE else text.replace(MARKER, " ").encode() if kind == NORMAL else b"")
        self.piece_bytes = np.frombuffer(b"".join(made), np.uint8)
        self.piece_size = np.array([len(b) for b in made], np.int32)
        self.piece_start = (np.cumsum(self.piece_size) - self.piece_size).astype(np.int32)
        self.is_byte = np.array([k == BYTE for _, _, k in pieces])
        self.arrays = tuple(np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value))
        self.score_array = np.array(scores)
        self.byte_array = np.array(self.byte_ids, np.int32)
        self.width = np.array(WIDTH)
        self.literal = np.array([self.byte_ids[b] for b in LITERAL], np.int32).tobytes()
        self.powers = np.zeros(0, np.uint64)
        self.cache: dict[bytes, bytes] = {}
        self.again: set[bytes] = set()  # words found in the cache since it was last cleared out

    def best_path(self, word: bytes) -> list[int]:
        """Ids of the best segmentation of a word in UTF-8."""
        base, check, value, scores, n = self.trie.base, self.trie.check, self.trie.value, self.scores, len(word)
        best, back, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0], at = 0.0, 0
        while at < n:
            so_far, node, end, whole = best[at], 0, at, False
            width = WIDTH[word[at]]
            while end < n:
                child = base[node] + word[end]
                if check[child] != node:
                    break
                node, end = child, end + 1
                found = value[node]
                if found >= 0:
                    score = so_far + scores[found]
                    if score > best[end]:
                        best[end], back[end], piece[end] = score, at, found
                    whole = whole or end - at == width
            if not whole:
                end = at + width
                if so_far + self.unknown > best[end]:
                    best[end], back[end], piece[end] = so_far + self.unknown, at, -1
            at += width
        out: list[int] = []
        while n:
            start = back[n]
            out += [piece[n]] if piece[n] >= 0 else [self.byte_ids[b] for b in reversed(word[start:n])]
            n = start
        return out[::-1]

    def solve(self, words: list[str]) -> list[bytes]:
        """``best_path`` of many words at once, as packed ids.

        The longest words come first, and the places of all words lie row by row: first the starts of
        all, then their places after one byte, and so on. A row's best paths are known once the rows
        before it are done, so the trie is walked from all words of a row together.
        """
        text = "".join(words).replace(" ", MARKER).encode()
        buf = np.frombuffer(text, np.uint8)
        chars = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
        stop = chars[np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
        size = np.diff(stop, prepend=0)
        out = [b""] * len(words)
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            out[i] = np.array(self.best_path(text[stop[i] - size[i] : stop[i]]), np.int32).tobytes()
        order = np.argsort(-size, kind="stable")
        order = order[size[order] <= LONG_WORD]
        if not len(order):
            return out
        size, start = size[order], (stop - size)[order]
        # A row holds the words of at least so many bytes, so those that go on come first in it.
        longest = int(size[0])
        many = len(size) - np.searchsorted(size[::-1], np.arange(longest + 1))
        row = np.cumsum(many) - many
        many, places = many.tolist(), int(many.sum())
        own = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        byte = np.zeros(places, np.uint8)
        byte[row[at] + own] = buf[start[own] + at]
        width = self.width[byte]
        base, check, value = self.arrays
        best, back, last = np.full(places, -np.inf), np.zeros(places, np.int16), np.zeros(places, np.int32)
        best[: len(size)] = 0.0

        def reach(to: np.ndarray, score: np.ndarray, piece: np.ndarray | int, source: int) -> None:
            # Sources come in order, so among equals the earliest start wins.
            top = np.flatnonzero(score > best[to])
            to = to[top]
            best[to], back[to], last[to] = score[top], source, piece if isinstance(piece, int) else piece[top]

        rows = row.tolist()
        for source in range(longest):
            lo, on = rows[source], many[source + 1]
            word = np.flatnonzero(best[lo : lo + on] > -np.inf)  # characters start there
            if not len(word):
                continue
            first, so_far, lone = word, best[lo + word], np.ones(on, bool)
            score, node, depth = so_far, np.zeros(len(word), np.int32), 0
            while source + depth < longest:
                inside = int(np.searchsorted(word, many[source + depth + 1]))
                child = base[node[:inside]] + byte[rows[source + depth] + word[:inside]]
                known = np.flatnonzero(check[child] == node[:inside])
                if not len(known):
                    break
                word, node, score, depth = word[known], child[known], score[known], depth + 1
                piece = value[node]
                ends = np.flatnonzero(piece >= 0)
                if len(ends):
                    of, piece = word[ends], piece[ends]
                    reach(rows[source + depth] + of, score[ends] + self.score_array[piece], piece, source)
                    if depth <= 4:
                        lone[of[width[lo + of] == depth]] = False
            alone = np.flatnonzero(lone[first])
            if len(alone):
                word = first[alone]
                reach(row[source + width[lo + word]] + word, so_far[alone] + self.unknown, -1, source)

        # The paths backwards, put down word by word.
        bounds = np.cumsum(size + 1) - size - 1
        used, ids, length = np.zeros(places, bool), np.zeros(places, np.int32), np.zeros(places, np.int16)
        word, here = np.arange(len(size)), size
        while len(word):
            place, to = row[here] + word, bounds[word] + here
            before = back[place]
            used[to], ids[to], length[to] = True, last[place], here - before
            on = np.flatnonzero(before > 0)
            word, here = word[on], before[on].astype(np.int64)
        path = np.flatnonzero(used)
        ids, word = ids[path], np.searchsorted(bounds, path, "right") - 1
        # An unknown character becomes as many byte pieces as it has bytes.
        count = np.where(ids < 0, length[path], 1)
        ends = np.cumsum(count)
        wide = np.repeat(ids, count)
        lost = np.flatnonzero(wide < 0)
        of = np.repeat(np.arange(len(path)), count)[lost]
        wide[lost] = self.byte_array[buf[start[word[of]] + path[of] - bounds[word[of]] - (ends[of] - lost)]]
        cuts = [0, *(np.cumsum(np.bincount(word, count, minlength=len(size))).astype(np.int64) * 4).tolist()]
        packed = wide.astype(np.int32).tobytes()
        for i, begin, end in zip(order.tolist(), cuts, cuts[1:]):
            out[i] = packed[begin:end]
        return out

    def look_up(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of distinct words. Those that are not in the cache are solved together."""
        if len(self.cache) > CACHE_WORDS:
            # Words that were met again stay, if they leave room for as many new ones.
            again = self.again if len(self.again) <= CACHE_WORDS // 2 else ()
            self.cache, self.again = {w: self.cache[w] for w in again}, set()
        found = list(map(self.cache.get, words))
        self.again.update([w for w, ids in zip(words, found) if ids is not None])
        new = [i for i, ids in enumerate(found) if ids is None]
        for at in range(0, len(new), SOLVED):
            some = new[at : at + SOLVED]
            for i, ids in zip(some, self.solve([words[i].decode() for i in some])):
                found[i] = ids
        self.cache.update([(words[i], found[i]) for i in new if len(words[i]) <= CACHE_BYTES])
        return found

    def encode_all(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and their bounds; ``ends`` are the bounds of the texts in the bytes ``data``.

        A word is its blanks and what follows; a marker of the text itself is one too. Equal words have one hash, and
        only one of each is looked up; words that share a hash but not their bytes have all words looked up instead.
        """
        first = ends[:-1] + np.arange(len(ends) - 1)  # of each text, with a blank before it
        buf = np.full(len(data) + len(first), BLANK, np.uint8)
        given = np.ones(len(buf), bool)
        given[first] = False
        buf[given] = data
        blank = buf == BLANK
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[first] = True
        whole = buf.tobytes()
        literal = np.zeros(0, np.int64)
        if LITERAL in whole:
            literal = np.flatnonzero((buf[:-2] == LITERAL[0]) & (buf[1:-1] == LITERAL[1]) & (buf[2:] == LITERAL[2]))
            begins[literal] = True
            begins[literal[literal + len(LITERAL) < len(buf)] + len(LITERAL)] = True
        start = np.flatnonzero(begins)
        size = np.diff(start, append=len(buf))
        place = np.arange(len(buf), dtype=np.int32) - np.repeat(start.astype(np.int32), size)
        if len(self.powers) < size.max(initial=0):
            self.powers = np.cumprod(np.full(int(size.max()), FACTOR, np.uint64))
        hashes = np.add.reduceat(buf * self.powers[place], start) if len(start) else np.zeros(0, np.uint64)
        _, one, same = np.unique(hashes, return_index=True, return_inverse=True)
        other = start[one][same]
        if (size[one][same] != size).any() or (buf[np.repeat(other, size) + place] != buf).any():
            one = same = np.arange(len(start))
        words = [whole[a:b] for a, b in zip(start[one].tolist(), (start + size)[one].tolist())]
        known = self.look_up([w for w in words if w != LITERAL]) if len(literal) else self.look_up(words)
        if len(literal):
            rest = iter(known)
            known = [self.literal if w == LITERAL else next(rest) for w in words]
        packed = np.frombuffer(b"".join(known), np.int32)
        count = np.fromiter(map(len, known), np.int64, len(known)) // 4
        own = count[same]
        upto = np.concatenate([[0], np.cumsum(own)])
        ids = packed[np.repeat((np.cumsum(count) - count)[same] - upto[:-1], own) + np.arange(upto[-1])]
        return ids, np.append(upto[np.searchsorted(start, first)], upto[-1])

    def encode(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_all(data, np.array([0, len(data)]))[0]

    def decode_all(self, flat: np.ndarray, ends: np.ndarray) -> list[str]:
        """The text of each list of ids; ``ends`` are the bounds of the lists in ``flat``.

        The bytes of all pieces lie in one array, and those of the ids are gathered from it at once.
        """
        size = self.piece_size[flat]
        upto = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat((self.piece_start[flat] - upto[:-1]).astype(np.int32), size) + np.arange(upto[-1], dtype=np.int32)
        data, cuts, out = self.piece_bytes[place].tobytes(), upto[ends].tolist(), []
        for a, b in zip(cuts, cuts[1:]):
            out.append(data[a + (data[a : a + 1] == b" ") : b].decode("utf-8", "replace") if b > a else "")
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


_codecs: dict[str, Codec] = {}


def release() -> None:
    """Give back what is free: a worker that has run other stages holds their memory, though nothing is in it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def codec(shared, key: str) -> Codec:
    """The codec of a model, unpacked once per worker process."""
    if key not in _codecs:
        model, arrays = shared.value
        _codecs[key] = Codec(model, DoubleArray.unpacked(arrays))
    return _codecs[key]


def _model(df: DataFrame, path: str):
    """The model and its trie for all tasks: of the size of a vocabulary file."""
    with open(path, "rb") as f:
        model = f.read()
    if path not in _codecs:
        _codecs[path] = Codec(model)
    return df.sparkSession.sparkContext.broadcast((model, _codecs[path].trie.packed()))


def encode(df: DataFrame, text: str = "text", out: str = "ids", model: str = MODEL) -> DataFrame:
    """``df`` with the piece ids of ``text`` as a further column ``out`` (replaced if present)."""
    data = _model(df, model)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        release()
        own = codec(data, model)
        filled = texts.fill_null("").cast(pa.large_string())
        offsets, whole = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1], filled.buffers()[2]
        whole = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
        flat, sizes, a = [], [], 0
        while a < len(filled):
            b = min(len(filled), max(a + 1, int(np.searchsorted(offsets, offsets[a] + TOGETHER, "right")) - 1))
            ids, bounds = own.encode_all(whole[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            flat.append(ids)
            sizes.append(np.diff(bounds))
            a = b
        ids, count = np.concatenate([np.empty(0, np.int32), *flat]), np.concatenate([np.empty(0, np.int64), *sizes])
        if texts.null_count:
            full = texts.is_valid().to_numpy(zero_copy_only=False)
            ids, count = ids[np.repeat(full, count)], count * full
        ends = np.concatenate([[0], np.cumsum(count)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=texts.is_null())

    return df.withColumn(out, run(F.col(text)))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``df`` with the text of the piece ids in ``ids`` as a further column ``out``."""
    data = _model(df, model)

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        own = codec(data, model)
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        rows, a = [], 0
        while a < len(column):
            # Some lists at a time, so that the gathered bytes stay few.
            b = min(len(column), max(a + 1, int(np.searchsorted(ends, ends[a] + DECODED, "right")) - 1))
            rows += own.decode_all(flat[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
            a = b
        return pa.array([None if null else t for null, t in zip(column.is_null().to_pylist(), rows)], pa.string())

    return df.withColumn(out, run(F.col(ids)))


def byte_pieces(df: DataFrame, ids: str = "ids", out: str = "n_byte_pieces", model: str = MODEL) -> DataFrame:
    """``df`` with the number of byte pieces among ``ids``: they are one run of a model's ids."""
    with open(model, "rb") as f:
        numbers = [i for i, (_, _, kind) in enumerate(read_model(f.read())) if kind == BYTE]
    first, last = numbers[0], numbers[-1]
    return df.withColumn(out, F.size(F.filter(ids, lambda i: i.between(first, last))).cast("long"))
