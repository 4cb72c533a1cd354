"""Word-shingle sets of whole texts as sorted 64-bit hashes, computed in numpy.

A batch of texts is one byte buffer. A word of at most ``SHORT`` bytes is hashed by a sum of its
bytes, each times a random 64-bit number of its place (a multilinear hash: two different words
collide with probability 2^-56 at most, whatever they are made of), a longer one by BLAKE2b;
each run of ``k`` words by a mixed sum of its words' hashes. No Python loop runs over words,
but for long ones. Sets of one shingle, where a single collision would make a link, are told
apart by 128 bits of their words (:func:`set_key`).
"""

from __future__ import annotations

import hashlib

import numpy as np

from .common import CHUNK_BYTES, chunks

U = np.uint64
_POSITION = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)
EMPTY = np.zeros(0, dtype=np.int64)
#: Bytes of a word that the multilinear hash takes, and its fixed random numbers.
SHORT = 64
_PLACE = np.random.default_rng(20250101).integers(0, 1 << 64, SHORT + 1, dtype=np.uint64) | U(1)
#: Bytes that are turned into numpy arrays at once.
LIMIT = CHUNK_BYTES // 2


def alphabet(separators: bytes) -> bytes:
    """Byte map for ``translate``: a blank for a separator, else the byte, A-Z lower-cased."""
    out = bytearray(bytes(range(256)).lower())
    for b in separators:
        out[b] = 0x20
    return bytes(out)


#: Words are runs of anything but blank, tab, LF, VT, FF and CR, which is what ``bytes.split`` cuts at.
WHITE = alphabet(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words are runs of letters, digits and non-ASCII characters; ASCII punctuation and controls separate.
ALNUM = alphabet(bytes(b for b in range(128) if not chr(b).isalnum()))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _word_hashes(data: bytes, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a buffer."""
    data = data.translate(table)
    b = np.frombuffer(data, dtype=np.uint8)
    inside = b != 0x20
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
    h = np.add.reduceat(b[inside] * _PLACE[np.minimum(place, SHORT)], first)
    h = mix(h + size.astype(np.uint64) * _POSITION[0])
    for i in np.flatnonzero(size > SHORT).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h, starts


def _pieces(text: bytes, table: bytes, limit: int) -> list[bytes]:
    """A very long text in parts that end where a word ends."""
    out, at = [], 0
    while len(text) - at > limit:
        end = at + limit
        while end < len(text) and table[text[end]] != 0x20:
            end += 1
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def words_of(text: bytes, table: bytes = WHITE) -> list[bytes]:
    """The words of a text, lower-cased."""
    return text.translate(table).split()


def word_arrays(texts: list[bytes], table: bytes = WHITE, limit: int = LIMIT) -> list[np.ndarray]:
    """The words of each text as hashes, in order."""
    out: list[np.ndarray] = []
    for lo, hi in chunks([len(t) + 1 for t in texts], limit):
        part = texts[lo:hi]
        if len(part) == 1 and len(part[0]) > limit:
            out.append(np.concatenate([_word_hashes(p, table)[0] for p in _pieces(part[0], table, limit)]))
            continue
        h, starts = _word_hashes(b"\n".join(part), table)
        ends = np.cumsum([len(t) + 1 for t in part])
        out.extend(np.split(h, np.searchsorted(starts, ends[:-1])))
    return out


def shingle_array(words: np.ndarray, k: int = 5, whole: bool = True) -> np.ndarray:
    """Hash of each run of ``k`` words, in order; with fewer words the whole sequence as one if ``whole``."""
    n = len(words)
    if not n or (n < k and not whole):
        return EMPTY
    w = min(n, k)
    m = n - w + 1
    total = np.full(m, w * 0x2545F4914F6CDD1D & (1 << 64) - 1, dtype=np.uint64)
    for j in range(w):
        total += mix(words[j : j + m] + _POSITION[j % 8]) * _POSITION[(j + 3) % 8] if j >= 8 else words[j : j + m] * _POSITION[j]
    return mix(total).view(np.int64)


def shingle_sets(texts: list[bytes], table: bytes = WHITE, k: int = 5, whole: bool = True) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted as signed 64-bit numbers."""
    return [np.unique(shingle_array(w, k, whole)) for w in word_arrays(texts, table)]


def set_key(s: np.ndarray, text: bytes, table: bytes = WHITE) -> bytes:
    """128 bits that equal sets share; a single shingle's are taken from its words, as one hash alone stands for it."""
    if len(s) == 1:
        words = words_of(text, table)
        # A longer text of one shingle repeats one word.
        return hashlib.blake2b(b" ".join(words) if len(set(words)) > 1 or len(words) < 5 else words[0] + b" *", digest_size=16).digest()
    return hashlib.blake2b(s, digest_size=16).digest()
