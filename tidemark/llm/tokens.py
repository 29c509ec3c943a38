"""Byte-level BPE encoding of whole columns with a word store in front of the tokenizers library.

A byte-level BPE text is cut into words by a fixed pattern before any merge, and where
a word begins follows from the kinds of the characters around it. The cut is made over
a column's bytes at once; each distinct word is encoded once per Python worker by the
tokenizers library, and a text's ids are the ids of its words, gathered from one array.
The kind of a character is asked of the library's own cut, once for each character met.
Texts with an added token of the vocabulary (which the library finds before any cut) go
to the library whole, as do all texts of a vocabulary that is cut in another way.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Appended to every document.
END_ID = 2
#: Distinct words kept per Python worker; the store starts anew beyond it.
CACHE_WORDS = 600_000
#: Longer words are encoded but not kept.
CACHE_BYTES = 64
#: Bytes of text that one step encodes, and that one vectorised step cuts to words.
BYTES_PER_STEP = 4_000_000
BYTES_PER_CUT = 1_000_000
#: Words that the library encodes in one call.
WORDS_PER_CALL = 200

#: Kinds of characters; white space from SPACE on, a single blank last.
UNKNOWN, LETTER, NUMBER, OTHER, SPACE, BLANK = range(6)
_WORKERS: dict[str, "Encoder"] = {}


class WordStore:
    """Ids of words, one word's after another in one array. Word 0 is the end id, word 1 has no ids."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, "<u4")
        self.ends = np.zeros(1 << 14, np.int64)
        self.n = 0
        self.add(np.array([END_ID], "<u4"), np.array([1, 0]))

    def add(self, ids: np.ndarray, counts: np.ndarray) -> range:
        """Appends words of so many ids each and returns their numbers."""
        first, used = self.n, int(self.ends[self.n - 1]) if self.n else 0
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(counts) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[used : used + len(ids)] = ids
        self.ends[first : first + len(counts)] = used + np.cumsum(counts)
        self.n += len(counts)
        return range(first, self.n)

    def gather(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and where each word's end."""
        begins = np.where(words > 0, self.ends[words - 1], 0)
        counts = self.ends[words] - begins
        ends = np.cumsum(counts)
        places = np.repeat(begins - ends + counts, counts)
        places += np.arange(len(places))
        return self.flat[places], ends


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        by = self.tokenizer.pre_tokenizer
        self.cuts = self.tokenizer.normalizer is None and isinstance(by, ByteLevel) and by.use_regex and not by.add_prefix_space
        self.space_first = np.zeros(1 + max(self.tokenizer.get_vocab().values(), default=0), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.space_first[i] = token.startswith("Ġ")  # the byte-level alphabet's space
        self.kinds = np.zeros(0x110000, np.uint8)
        if self.cuts:
            self._ask(range(128))
        self.ascii = self.kinds[:256].tobytes()
        self.words = WordStore()

    def _ask(self, points) -> None:
        """Learns kinds of characters from what the library leaves in one piece with a letter, a number or a mark."""
        piece = lambda text: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 1
        for p in points:
            c = chr(p)
            self.kinds[p] = LETTER if piece("a" + c) else NUMBER if piece("1" + c) else OTHER if piece("!" + c) else BLANK if c == " " else SPACE

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _characters(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """The kind of each character and the place of its first byte; no places if each is one byte."""
        kinds = np.frombuffer(data.tobytes().translate(self.ascii), np.uint8)
        if not len(data) or data.max() < 0x80:
            return kinds, None
        places = np.flatnonzero((data & 0xC0) != 0x80)
        kinds, lead = kinds[places], data[places]
        wide = np.flatnonzero(lead >= 0xC0)
        b = lead[wide].astype(np.uint32)
        at = places[wide]
        follow = lambda k: data[np.minimum(at + k, len(data) - 1)].astype(np.uint32) & 0x3F
        points = (b & 0x1F) << 6 | follow(1)
        if (b >= 0xE0).any():
            points = np.where(b >= 0xE0, (b & 0x0F) << 12 | follow(1) << 6 | follow(2), points)
            points = np.where(b >= 0xF0, (b & 0x07) << 18 | follow(1) << 12 | follow(2) << 6 | follow(3), points)
        got = self.kinds[points]
        if not got.all():
            self._ask(np.unique(points[got == UNKNOWN]).tolist())
            got = self.kinds[points]
        kinds[wide] = got
        return kinds, places

    def _begins(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Places of the bytes at which words begin, as the library's pattern cuts each text:
        's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
        """
        kinds, places = self._characters(data)
        n = len(kinds)
        if not n:
            return np.zeros(0, np.int64)
        filled = bounds[:-1][np.diff(bounds) > 0]
        firsts = filled if places is None else np.searchsorted(places, filled)
        stops = np.append(firsts[1:], n)
        space = kinds >= SPACE
        begins = np.ones(n, bool)
        # a run goes on with its own kind, and after a blank
        np.logical_and(kinds[1:] != kinds[:-1], kinds[:-1] != BLANK, out=begins[1:])
        # white space: at the first of a run, and at the last before something else
        before_other = np.zeros(n, bool)
        before_other[:-1] = ~space[1:]
        before_other[stops - 1] = False
        after_other = np.ones(n, bool)
        after_other[1:] = ~space[:-1]
        begins = np.where(space, after_other | before_other, begins)
        begins[firsts] = True
        quotes = np.flatnonzero((data if places is None else data[places]) == 0x27)
        quotes = quotes[begins[quotes]]
        if len(quotes):
            stop = stops[np.searchsorted(firsts, quotes, "right") - 1]
            byte = lambda k: np.where(quotes + k < stop, data[at if places is None else places[at]] if len(at := np.minimum(quotes + k, n - 1)) else 0, 0)
            one, two = byte(1), byte(2)
            short = np.isin(one, list(b"stmd"))
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            begins[quotes[short | long] + 1] = False
            after = np.concatenate([quotes[short] + 2, quotes[long] + 3])
            begins[after[after < n]] = True
        found = np.flatnonzero(begins)
        return found if places is None else places[found]

    def _learn(self, new: list[bytes]) -> None:
        """Adds words to the store."""
        store, words = self.words, [w.decode() for w in new]
        plain = [i for i, w in enumerate(words) if w[0] == " " and w[1:].isalpha()]
        kept = set(plain)
        others = [i for i in range(len(words)) if i not in kept]
        ids = self._whole([words[i] for i in others])
        numbers = store.add(np.array([x for w in ids for x in w], "<u4"), np.array([len(w) for w in ids], np.int64))
        store.at.update(zip((new[i] for i in others), numbers, strict=True))
        # Many words in one call: each starts at an id that starts with a space.
        groups = self._whole(["".join(words[i] for i in plain[k : k + WORDS_PER_CALL]) for k in range(0, len(plain), WORDS_PER_CALL)])
        ids = np.array([x for g in groups for x in g], "<u4")
        starts = np.flatnonzero(self.space_first[ids])
        numbers = store.add(ids, np.diff(starts, append=len(ids)))
        store.at.update(zip((new[i] for i in plain), numbers, strict=True))

    def encode_column(self, texts: pa.Array, end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text's after another, and where each text's end; with the end id after each, if asked for.

        Null and empty texts have no ids of their own.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        texts.validate(full=True)
        if self.words.n > CACHE_WORDS:
            self.words = WordStore()
        whole = self._uncut(texts)
        apart = self._whole([texts[i].as_py() for i in whole])
        if whole:
            mask = np.zeros(len(texts), bool)
            mask[whole] = True
            texts = pc.if_else(pa.array(mask), "", texts)
        ids, ends = self._cut(texts, end)
        if whole:
            lengths = np.array([len(x) for x in apart])
            ids = np.insert(ids, np.repeat(ends[whole] - end, lengths), np.array([x for a in apart for x in a], "<u4"))
            more = np.zeros(len(ends), np.int64)
            more[whole] = lengths
            ends = ends + np.cumsum(more)
        return ids, ends

    def _uncut(self, texts: pa.Array) -> list[int]:
        """Which texts go to the library whole."""
        if not self.cuts:
            return list(range(len(texts)))
        bounds, data = _parts(texts)
        data, found = data.tobytes(), set()
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                i = int(np.searchsorted(bounds, at, "right")) - 1
                inside = at + len(token) <= bounds[i + 1]
                if inside:
                    found.add(i)
                at = data.find(token, int(bounds[i + 1]) if inside else at + 1)
        return sorted(found)

    def _cut(self, texts: pa.Array, end: bool) -> tuple[np.ndarray, np.ndarray]:
        store = self.words
        bounds, data = _parts(texts)
        begins = np.concatenate([bounds[i] + self._begins(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]) for i, j in byte_steps(bounds, BYTES_PER_CUT)] or [bounds[:0]])
        words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = list(map(store.at.get, distinct))
        new = [i for i, k in enumerate(numbers) if k is None]
        self._learn([w for i in new if len(w := distinct[i]) <= CACHE_BYTES])
        kept = store.n
        self._learn(long := [w for i in new if len(w := distinct[i]) > CACHE_BYTES])
        for i in new:
            numbers[i] = store.at[distinct[i]]
        numbers = np.array(numbers, np.int64)[words.indices.to_numpy()]
        stops = np.searchsorted(begins, bounds[1:])
        if end:
            numbers = np.insert(numbers, stops, 0)
            stops = stops + np.arange(1, len(stops) + 1)
        ids, ends = store.gather(numbers)
        store.n = kept
        for w in long:
            del store.at[w]
        return ids, np.append(0, ends)[stops]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One bytes object per text; null and empty texts have no ids."""
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        ends = [0, *ends.tolist()]
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]


def byte_steps(bounds: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes each, a longer text alone."""
    i = 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
        yield i, j
        i = j


def column_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """Values of the first column and texts of the second, about BYTES_PER_STEP of text at a time: fewer distinct words in all than in small batches."""
    held, size = [], 0

    def joined() -> tuple[list, pa.Array]:
        table = pa.Table.from_batches(held).combine_chunks()
        return table.column(0).to_pylist(), pa.concat_arrays(table.column(1).chunks)

    for batch in batches:
        bounds, _ = _parts(batch.column(1))
        for i, j in byte_steps(bounds, BYTES_PER_STEP):
            more = int(bounds[j] - bounds[i])
            if held and size + more > BYTES_PER_STEP:
                yield joined()
                held, size = [], 0
            held.append(batch.slice(i, j - i))
            size += more
    if held:
        yield joined()


def _parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the texts in their bytes, from 0 on, and these bytes."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if offsets and len(texts) else np.zeros(1, np.int32)
    found = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
    return bounds.astype(np.int64) - bounds[0], found


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(vocabulary: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if vocabulary not in _WORKERS:
        _WORKERS[vocabulary] = Encoder(vocabulary)
    return _WORKERS[vocabulary]
