"""Tokenizers as workers use them: one per process, with the encodings of frequent words kept."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

from .common import worker_state

#: Words that one process keeps in each of two generations, and the longest that it keeps.
KEPT_WORDS, KEPT_CHARS = 600_000, 64
#: The same for words with their ids, which take more memory than counts do.
KEPT_PIECES = 150_000
#: Characters of the texts whose words are looked up together: each look-up hashes all kept words anew.
BATCH_CHARS = 4_000_000
#: Fixed value: how the vocabulary writes a space.
SPACE_TOKEN = "Ġ"
#: Only in texts of these characters is every word surely encoded by itself.
PLAIN = re.compile(r"[\n\x20-\x7e¡-ɏ]*")


@functools.lru_cache(maxsize=4)
def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _special(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [x["content"] for x in json.load(f).get("added_tokens", [])]


class WordTable:
    """Token ids of words, kept in Arrow and numpy arrays: a new and an old generation, so that frequent ones stay.

    The new one comes first; words that are found in the old one, and new ones, are added to it. When
    it is full it becomes the old one.
    """

    def __init__(self, encode, dtype: str, most: int = KEPT_WORDS):
        import pyarrow as pa

        self.encode, self.dtype, self.most = encode, dtype, most
        self.words, self.flat, self.size, self.n_new = pa.array([], pa.large_string()), np.empty(0, dtype), np.empty(0, np.int64), 0

    def find(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size): where in ``ids`` those of each of the different words are."""
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(at < 0)
        encoded = self.encode(words.take(pa.array(missing)).to_pylist())
        width = np.dtype(self.dtype).itemsize
        more = np.fromiter(map(len, encoded), np.int64, len(encoded)) // width
        ids = np.concatenate((self.flat, np.frombuffer(b"".join(encoded), self.dtype)))
        sizes = np.concatenate((self.size, more))
        starts = np.cumsum(sizes) - sizes
        n, where = len(self.size), at.copy()
        where[missing] = n + np.arange(len(missing))
        start, size = starts[where], sizes[where]
        short = pc.less_equal(pc.binary_length(words), 4 * KEPT_CHARS).to_numpy(zero_copy_only=False)
        self._add(words, np.flatnonzero(((at < 0) | (at >= self.n_new)) & short), ids, start, size)
        return ids, start, size

    def _add(self, words, own: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        import pyarrow as pa

        if not len(own):
            return
        new, old = slice(0, self.n_new), slice(self.n_new, None)
        at = int(self.size[new].sum())
        flat_new, flat_old, size_new, size_old = self.flat[:at], self.flat[at:], self.size[new], self.size[old]
        words_new, words_old = self.words.slice(0, self.n_new), self.words.slice(self.n_new)
        if self.n_new + len(own) > self.most:
            flat_old, size_old, words_old = flat_new, size_new, words_new
            flat_new, size_new, words_new = flat_new[:0], size_new[:0], words_new.slice(0, 0)
        n = size[own]
        ends = np.cumsum(n)
        added = ids[np.repeat(start[own] - (ends - n), n) + np.arange(int(n.sum()))]
        self.words = pa.concat_arrays([words_new, words.take(pa.array(own)), words_old])
        self.flat, self.size = np.concatenate((flat_new, added, flat_old)), np.concatenate((size_new, n, size_old))
        self.n_new = len(size_new) + len(own)


class PieceEncoder:
    """Token ids of whole texts by a byte-level tokenizer file, as little-endian bytes.

    Such a tokenizer cuts a text by a pattern and encodes each piece by itself. A piece never goes
    on across a single space or line feed between other characters: a space starts the next piece,
    and a line feed is one by itself. So a word has the same ids wherever it stands, with the space
    before it or at the start of a line. Each new word is encoded by the library, and frequent ones
    are kept. Texts with other white space, with characters whose classes may differ between
    pattern libraries, or with one of the special strings are given to the library whole.
    """

    def __init__(self, path: str, dtype: str = "<u2"):
        self.tokenizer, self.dtype = load(path), dtype
        special = _special(path)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.table = WordTable(self._words, dtype, KEPT_PIECES)
        self.feed = self._ids(["\n"])[0]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts[[i for t, i in vocabulary.items() if t.startswith(SPACE_TOKEN)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words: with a line feed before where they have one, else with a space."""
        first = [w for w in words if w[:1] == "\n"]
        out = dict(zip(first, (self.feed + ids for ids in self._ids([w[1:] for w in first]))))
        out[""] = b""
        later = [w for w in words if w and w[0] != "\n"]
        out.update(zip(later, self._later(later)))
        return [out[w] for w in words]

    def _later(self, words: list[str]) -> list[bytes]:
        """The ids of words with a space before: encoded many together, cut where a token has it.

        Where the tokens of some words cannot be told apart, these are encoded one by one.
        """
        out, width = [], np.dtype(self.dtype).itemsize
        parts = [words[at : at + 256] for at in range(0, len(words), 256)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" " + " ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.asarray(e.ids, self.dtype)
            at = (np.flatnonzero(self.starts[ids]) * width).tolist()
            if len(at) != len(part) or at[0]:
                out += self._ids([" " + w for w in part])
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, by about BATCH_CHARS characters at a time."""
        out: list[bytes] = []
        part, size = [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= BATCH_CHARS:
                out += self._encode_part(part)
                part, size = [], 0
        return out + self._encode_part(part) if part else out

    def _encode_part(self, texts: list[str]) -> list[bytes]:
        """Different words are looked up once for all texts; their ids are then gathered in order."""
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = [k for k, t in enumerate(texts) if PLAIN.fullmatch(t) and not (self.special and self.special.search(t))]
        # a word has its line feed with it, and each text one before it that is taken off again
        lists = pc.split_pattern(pc.replace_substring(pa.array(["\n" + texts[k] for k in plain], pa.large_string()), "\n", " \n"), " ")
        coded = lists.values.dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        bounds = lists.offsets.to_numpy()
        odd = np.zeros(len(words) + 1, bool)
        for w in ("", "\n"):  # white space next to white space; every text begins with one empty piece
            odd[pc.index(words, w).as_py()] = True  # -1, the last place, where there is none
        odd[-1] = False
        inner = odd[at]
        inner[bounds[:-1]] = False
        hard = np.add.reduceat(np.append(inner, False), bounds[:-1]) > 0 if len(plain) else np.zeros(0, bool)
        flat, start, size = self.table.find(words)
        del lists, coded
        width, n = np.dtype(self.dtype).itemsize, size[at]
        ends = np.cumsum(n)
        raw = flat[np.repeat(start[at] - (ends - n), n) + np.arange(int(n.sum()))].tobytes()
        ends = np.append(0, ends)[bounds] * width
        out: list[bytes] = [b""] * len(texts)
        whole = set(range(len(texts))) - set(plain)
        for k, bad, a, b in zip(plain, hard.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            if bad:
                whole.add(k)
            else:
                out[k] = raw[a + len(self.feed) : b]
        whole = sorted(whole)
        for k, own in zip(whole, self._ids([texts[k] for k in whole])):
            out[k] = own
        pa.default_memory_pool().release_unused()
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


class WordCounter:
    """Token counts of whole texts by a tokenizer that drops white space.

    Its pattern never matches across white space and its normaliser changes nothing across it, so
    the count of a text is the sum over its words. Texts above ``chunk`` characters are encoded in
    overlapping chunks (``resync_ids``).
    """

    def __init__(self, path: str, chunk: int, overlap: int):
        self.tokenizer, self.chunk, self.overlap = load(path), chunk, overlap
        self.table = WordTable(self._zeros, "<u1")

    def _zeros(self, words: list[str]) -> list[bytes]:
        """A zero for each token of a word: the table counts them."""
        return [bytes(len(e.ids)) for at in range(0, len(words), 20_000) for e in self.tokenizer.encode_batch_fast(words[at : at + 20_000], add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text; short ones are split into words together."""
        import pyarrow as pa
        import pyarrow.compute as pc

        short = [k for k, t in enumerate(texts) if len(t) <= self.chunk]
        lists = pc.ascii_split_whitespace(pa.array([texts[k] for k in short], pa.large_string()))
        coded = lists.values.dictionary_encode()
        _, _, size = self.table.find(coded.dictionary)
        ends = np.append(0, np.cumsum(size[coded.indices.to_numpy()]))
        n = np.diff(ends[lists.offsets.to_numpy()]) if short else np.empty(0, np.int64)
        out = dict(zip(short, n.tolist()))
        return [out[k] if k in out else len(resync_ids(self.tokenizer, t, self.chunk, self.overlap)[0]) for k, t in enumerate(texts)]


def piece_encoder(path: str, dtype: str) -> PieceEncoder:
    """The worker's encoder: one for all its tasks, as functions that are sent to it carry no state."""
    return worker_state(("pieces", path, dtype), lambda: PieceEncoder(path, dtype))


def word_counter(path: str, chunk: int, overlap: int) -> WordCounter:
    """The worker's counter: one for all its tasks."""
    return worker_state(("words", path, chunk, overlap), lambda: WordCounter(path, chunk, overlap))


WHITE = frozenset(" \t\n\v\f\r")


def _encoded(tokenizer, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
    e = tokenizer.encode(text[start:end], add_special_tokens=False)
    return [(i, a + start, b + start) for i, (a, b) in zip(e.ids, e.offsets)]


def _seam(left: list, right: list, text: str, lo: int, hi: int) -> int | None:
    """A place in [lo, hi) where both encodings can be spliced, or None.

    Proven stable: white space stands there, which the tokenizer drops and never matches across,
    and from there to the last white space of the overlap both encodings have the same tokens, at
    least one.
    """
    last = next((i for i in range(hi - 1, lo - 1, -1) if text[i] in WHITE), None)
    if last is None:
        return None
    first = next(i for i in range(lo, hi) if text[i] in WHITE)
    part = lambda tokens: [t for t in tokens if first <= t[1] and t[2] <= last]
    both = part(left)
    return first if both and both == part(right) else None


def resync_ids(tokenizer, text: str, chunk: int, overlap: int) -> tuple[list[int], int]:
    """(token ids of the text, times that an overlap was widened), encoding chunk by chunk.

    The text is cut anywhere, each chunk reaching ``overlap`` characters into the next one. Two
    neighbours are joined at a seam that both agree on; where there is none, the overlap is doubled
    and both sides are encoded anew, at worst up to the whole text. An empty text has no ids.
    """
    if overlap >= chunk:
        raise ValueError("overlap must be below chunk")
    n, widened = len(text), 0
    if n <= chunk:
        return tokenizer.encode(text, add_special_tokens=False).ids, 0
    out: list[int] = []
    start, end = 0, chunk
    left = _encoded(tokenizer, text, start, end)
    while end < n:
        lap = overlap
        while True:
            begin, stop = max(start, end - lap), min(n, max(end - lap, start) + chunk + lap)
            right = _encoded(tokenizer, text, begin, stop)
            at = _seam(left, right, text, begin + (begin > start), end - (end < n))
            if at is not None or begin == start:
                break
            lap, widened = lap * 2, widened + 1
        if at is None:  # no white space that both share: the right chunk starts where the left one does
            left, end = right, stop
            if end < n:
                chunk = chunk * 2
            continue
        out += [i for i, a, _ in left if a < at]
        left = [t for t in right if t[1] >= at]
        start, end = at, stop
    return out + [i for i, _, _ in left], widened
