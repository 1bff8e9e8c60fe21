"""Token ids of whole texts, in Arrow batches: the library's own ids, without encoding a word twice.

The tokenizer file splits at white space before anything else, so the ids of a text are those of
its white-space-separated chunks, one after another. Each batch is split and reduced to distinct
chunks by Arrow, and those of letters, with ASCII marks after them or not, to distinct words in lower
case; words are looked up in a bounded cache, and only unseen ones are encoded, many at once.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Pre-token pattern of the word-end vocabulary; a fixed value.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Chunks of these characters are their own NFC form and lower-case the same way everywhere.
PLAIN = regex.compile(r"[\x21-\x7e¡-ɏ]+")
#: Of these, chunks that Arrow lowers as Python does, and that are one pre-token, or two with the marks in the end.
WORD = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+[!-/:-@\[-`{-~]*$"
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
CACHE = 200_000  # chunks other than words that a worker remembers, and half its pre-tokens, unless the caller says less
SLICE = 1 << 22  # bytes of text taken at a time, unless the caller says less
WIDE, AT_ONCE = 16, 8192  # bytes of a word that is merged beside others (the model takes longer ones), and such words at once


class WordTokenizer:
    """Ids by the library, for a vocabulary of words' ends (lower case, white space dropped)."""

    def __init__(self, path: str, cache: int | None = None) -> None:
        self.full = Tokenizer.from_file(path)
        self.cache = CACHE if cache is None else cache
        self.model = self.full.model
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.byte_names = _byte_names()
        self.merges = Merges(json.loads(self.full.to_str())["model"], self.byte_names)

    def words(self, words: pa.Array) -> list[bytes]:
        """The ids of each of the words (distinct, in lower case, a pre-token each), four bytes each."""
        names = words.to_numpy(zero_copy_only=False).tolist()
        out = list(map(self.parts.get, names))
        new = [i for i, x in enumerate(out) if x is None]
        sizes = pc.binary_length(words).to_numpy()
        for i in new:
            if sizes[i] > WIDE:
                out[i] = self._part(names[i])
        new = [i for i in new if out[i] is None]
        for k in range(0, len(new), AT_ONCE):
            some = new[k : k + AT_ONCE]
            ids, size = self.merges.encode([names[i] for i in some], sizes[some])
            data, ends = ids.tobytes(), np.cumsum(4 * size).tolist()
            for i, lo, hi in zip(some, [0, *ends], ends, strict=False):
                out[i] = data[lo:hi]
        if len(self.parts) + len(new) > 2 * self.cache:
            self.parts.clear()
        self.parts.update((names[i], out[i]) for i in new[: 2 * self.cache])
        return out

    def chunks(self, words: list[str]) -> list[bytes]:
        """The ids of each of the chunks (which hold no ASCII white space), four bytes each."""
        get = self.known.get
        out = [get(w) for w in words]
        new = [i for i, x in enumerate(out) if x is None]
        if len(self.known) + len(new) > self.cache:
            self.known.clear()
        room = self.cache - len(self.known)
        rare = []
        for i in new:
            ids = self._chunk(words[i])
            if ids is None:
                rare.append(i)
            else:
                out[i] = ids
        if rare:
            for i, e in zip(rare, self.full.encode_batch([words[i] for i in rare], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, dtype="<u4").tobytes()
        self.known.update((words[i], out[i]) for i in new[:room])
        return out

    def _chunk(self, word: str) -> bytes | None:
        """The ids, or None for a chunk that only the library's whole pipeline is trusted with."""
        if not word.isascii() and not PLAIN.fullmatch(word):
            return None
        low = word.lower()
        if not low:  # between white space at an end
            return b""
        if low.isalpha():
            return self._part(low)
        if low[-1] in ".," and low[:-1].isalpha():
            return self._part(low[:-1]) + self._part(low[-1])
        if "<|" in low or not PLAIN.fullmatch(word):
            return None
        return b"".join(map(self._part, PIECES.findall(low)))

    def _part(self, piece: str) -> bytes:
        found = self.parts.get(piece)
        if found is None:
            name = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.byte_names)
            found = array("I", [t.id for t in self.model.tokenize(name)]).tobytes()
            if len(self.parts) >= 2 * self.cache:
                self.parts.clear()
            self.parts[piece] = found
        return found


class Merges:
    """Byte-pair merges of many words at once: each step merges the pair of least rank, the first of its like, in every word that has one."""

    def __init__(self, model: dict, byte_names: dict[int, str]) -> None:
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.none = max(ids.values()) + 1  # the place of no id, after a word's last
        keys = np.array([self._key(ids[a], ids[b]) for a, b in pairs], dtype=np.uint64)
        self.rank = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.rank]
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        # each byte's id, each last byte's, and none; and the ranks of their pairs
        self.start = np.array([ids[byte_names[b] + e] for e in ("", end) for b in range(256)] + [self.none], dtype=np.int32)
        self.start_rank = self.ranks(np.repeat(self.start, len(self.start)), np.tile(self.start, len(self.start)))

    def _key(self, left, right):
        return left * (self.none + 1) + right

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the number of merges where it is none."""
        key = self._key(left.astype(np.uint64), right.astype(np.uint64))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], np.int32(len(self.made)))

    def encode(self, words: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each word's), of words of these sizes in bytes: 1 to ``WIDE``."""
        n = len(words)
        held = np.frombuffer("".join(words).encode(), np.uint8)
        start = np.full((n, WIDE + 1), len(self.start) - 1, dtype=np.int32)  # a place more, so that a pair is left in the end
        start[np.arange(WIDE + 1) < size[:, None]] = held
        start[np.arange(n), size - 1] += 256
        now = self.start[start]
        rank = self.start_rank[start[:, :-1] * len(self.start) + start[:, 1:]]
        out, word = np.full_like(now, self.none), np.arange(n)
        while len(now):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(now)), at]
            some = best < len(self.made)
            out[word[~some], : now.shape[1]] = now[~some]
            now, rank, word, at, best = now[some], rank[some], word[some], at[some], best[some]
            now[np.arange(len(now)), at] = self.made[best]
            now, rank = _without(now, at + 1), _without(rank, at)
            for k in (at - 1, at):  # the pairs that the new id is in
                there = np.flatnonzero((k >= 0) & (k < rank.shape[1]))
                k = k[there]
                rank[there, k] = self.ranks(now[there, k], now[there, k + 1])
        kept = out != self.none
        return out[kept].astype("<u4"), kept.sum(axis=1)


def _without(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``rows`` without each one's column ``at``."""
    keep = np.ones(rows.shape, dtype=bool)
    keep[np.arange(len(rows)), at] = False
    return rows[keep].reshape(len(rows), rows.shape[1] - 1)


def _byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LOADED: dict[tuple[str, int | None], WordTokenizer] = {}


def load(path: str, cache: int | None = None) -> WordTokenizer:
    """One tokenizer a worker and size of its cache."""
    if (path, cache) not in _LOADED:
        _LOADED[path, cache] = WordTokenizer(path, cache)
    return _LOADED[path, cache]


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """(start, count) of consecutive texts of about ``size`` bytes together, one at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = 0
    total = np.cumsum(sizes)
    while start < len(sizes):
        base = int(total[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + size, side="right")))
        yield start, end - start
        start = end


def encode(texts: pa.Array, tokenizer: WordTokenizer, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, end of each text's): null counts as empty; ``end_id`` closes each text."""
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ends = split.offsets.to_numpy()
    words = split.values.slice(int(ends[0]), int(ends[-1] - ends[0])).dictionary_encode()
    ends = (ends - ends[0]).astype(np.int64)
    flat, size, place = _distinct(words.dictionary, tokenizer)
    at = place[words.indices.to_numpy()]
    if end_id is not None:
        flat, size = np.append(flat, np.uint32(end_id)), np.append(size, 1)
        at, ends = np.insert(at, ends[1:], len(size) - 1), ends + np.arange(len(ends))
    ids, size = _gather(flat, size, at)
    upto = np.concatenate([[0], np.cumsum(size)])
    return ids, upto[ends[1:]]


def _gather(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of the entries ``at``, their sizes), of entries of these sizes that follow one another in ``flat``."""
    if not len(at):
        return flat[:0], at
    starts, size = (np.cumsum(size) - size)[at], size[at]
    upto = np.cumsum(size)
    return flat[np.repeat(starts - upto + size, size) + np.arange(upto[-1])], size


def _flat(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4


def _distinct(chunks: pa.Array, tokenizer: WordTokenizer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of distinct chunks, sizes, place of each chunk among them): words first, then the others."""
    plain = pc.match_substring_regex(chunks, WORD)
    low = pc.utf8_lower(chunks.filter(plain))
    bare = pc.ascii_rtrim(low, MARKS)
    stems = bare.dictionary_encode()
    marked = pc.not_equal(pc.binary_length(low), pc.binary_length(bare))
    tails = pc.replace_substring_regex(low.filter(marked), r"^[^!-/:-@\[-`{-~]+", "").dictionary_encode()
    flat, size = _flat([*tokenizer.words(stems.dictionary), b"", *map(tokenizer._part, tails.dictionary.to_pylist())])
    n, marked = len(stems.dictionary), marked.to_numpy(zero_copy_only=False)
    pairs = np.full((len(low), 2), n, dtype=np.int64)  # a word's entry, and that of what follows it
    pairs[:, 0] = stems.indices.to_numpy()
    pairs[marked, 1] = n + 1 + tails.indices.to_numpy()
    flat, size = _gather(flat, size, pairs.ravel())
    rest, rest_size = _flat(tokenizer.chunks(chunks.filter(pc.invert(plain)).to_numpy(zero_copy_only=False).tolist()))
    plain = plain.to_numpy(zero_copy_only=False)
    place = np.empty(len(chunks), dtype=np.int64)
    place[plain], place[~plain] = np.arange(len(low)), len(low) + np.arange(len(rest_size))
    return np.concatenate([flat, rest]), np.concatenate([size.reshape(-1, 2).sum(axis=1), rest_size]), place
