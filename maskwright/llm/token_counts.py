"""Token counts: a prefix dynamic programme that knows the exact count at every prefix of a text.

For a word of symbols s1..sn under rank-ordered pair merges, the encoding of a prefix is the
encoding of a shorter prefix plus one last token, and a last token ``t`` is right exactly if
it encodes to itself and the pair (last token before it, t) encodes to itself. So one pass
over the prefixes, trying the vocabulary's tokens that end there, finds each prefix's last
token and with it the count:

    count[i] = count[i - len(t)] + 1

This vocabulary marks the last symbol of a word, so each prefix has two states: ``open`` (more
letters follow, used by the recursion) and ``closed`` (the text ends here, what a prefix
counts). Words are solved once per worker; a text's counts are its words' changes strung
together, one small number per character, and a running sum of them is the count at any prefix.

The stored form (``prefix_deltas``) answers truncation and budget questions without encoding
again: :func:`count_at`, :func:`longest_within`.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_batches, remember, texts_of, tokenizer_path
from .tokens import Memo, simple_parts

#: Units that a worker remembers.
MEMO = 1_000_000
#: Word prefixes whose state a worker remembers.
STATES = 600_000
#: Pairs of tokens whose encoding a worker remembers.
PAIRS = 1_000_000
#: Longest unit whose prefixes are counted from its begin where the programme does not apply; longer ones are cut first.
BRUTE = 2048


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


class PrefixCounter:
    """Counts at every prefix for a word-level merge vocabulary with a word-end suffix."""

    def __init__(self, name: str = "word_bpe_49k.json", memo: int = MEMO):
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.rank = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.letters = _byte_letters()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern)
        self.units, self.words, self.pairs, self.states, self.limit = Memo(memo), Memo(memo), {}, {}, STATES
        #: Lengths of tokens that end a word so far (open) or for good (closed), by their last three symbols.
        self.ends: tuple[dict, dict] = ({}, {})
        self.tokens = {t for t in model["vocab"] if t not in self.specials and self._self(t)}
        self._index_ends()

    def _index_ends(self) -> None:
        for t in self.tokens:
            bare = t.removesuffix(self.suffix)
            if bare and len(bare) >= 3:
                self.ends[bare != t].setdefault(bare[-3:], set()).add(len(bare))
        for kind in self.ends:
            for key, lengths in kind.items():
                kind[key] = (*sorted(lengths, reverse=True), 2, 1)

    def _merge(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            best = min((self.rank.get(p, 1 << 40), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best[0] == 1 << 40:
                break
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        bare = token.removesuffix(self.suffix)
        if not bare:
            return list(token)
        return [*bare[:-1], bare[-1] + token[len(bare) :]]

    def _self(self, token: str) -> bool:
        return self._merge(self._symbols(token)) == [token]

    def _fits(self, left: str, right: str) -> bool:
        key = (left, right)
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self._merge([*left, *self._symbols(right)]) == [left, right]
        return got

    def word(self, symbols: str) -> list[tuple[str, int, int]]:
        """State of every prefix of a word: its last open token, its open count and its closed count.

        A state depends on the prefix alone, so words that begin alike share theirs.
        """
        known, tokens, fits, suffix = self.states, self.tokens, self._fits, self.suffix
        open_ends, closed_ends = self.ends
        if len(known) >= self.limit:
            known.clear()
        states: list[tuple[str, int, int]] = [("", 0, 0)]
        for i in range(1, len(symbols) + 1):
            got = known.get(symbols[:i])
            if got is None:
                last, opened, closed, tail = "", 0, 0, symbols[max(0, i - 3) : i]
                for n in open_ends.get(tail, _SHORT):
                    j = i - n
                    t = symbols[j:i]
                    if j >= 0 and t in tokens and (not j or fits(states[j][0], t)):
                        last, opened = t, states[j][1] + 1
                        break
                for n in closed_ends.get(tail, _SHORT):
                    j = i - n
                    t = symbols[j:i] + suffix
                    if j >= 0 and t in tokens and (not j or fits(states[j][0], t)):
                        closed = states[j][1] + 1
                        break
                got = (last, opened, closed)
                if i <= 64:
                    known[symbols[:i]] = got
            states.append(got)
        return states

    def pieces(self, unit: str) -> list[int] | None:
        """Counts at each prefix of a unit by the programme; None where its normal form is not letter by letter."""
        if not unit.isascii() and not _LATIN.fullmatch(unit):
            if unicodedata.normalize("NFC", unit) != unit or any(unicodedata.combining(c) or len(c.lower()) != 1 for c in unit):
                return None
            if any(unicodedata.normalize("NFC", unit[i : i + 2]) != unit[i : i + 2] or 0x1100 <= ord(c) < 0x1200 for i, c in enumerate(unit) if ord(c) > 0x2FF):
                return None
        if "<|" in unit and any(s in unit for s in self.specials):
            return None
        low, out, base = unit.lower() if unit.isascii() else "".join(c.lower() for c in unit), [], 0
        for m in self.split.finditer(low):
            part = m[0]
            if len(part) > 1 and part[0] == "'" and part[1].isalpha():  # cut short, it is a quote and letters
                for k in range(1, len(part) + 1):
                    whole = k == 1 or part[:k] in ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
                    out.append(base + (self.word(part[:k])[k][2] if whole else 1 + self.word(part[1:k])[k - 1][2]))
            elif part.isascii() and part.isprintable():
                out += [base + x[2] for x in self.word(part)[1:]]  # printable ASCII stands for itself
            else:
                coded = [c.encode() for c in part]
                states = self.word("".join([self.letters[b] for b in b"".join(coded)]))
                out += [base + states[i][2] for i in accumulate(map(len, coded))]
            base = out[-1]
        return out if len(out) == len(unit) else None

    def boundaries(self, unit: str) -> list[int]:
        """Places of a unit, both ends included, between which every prefix is encoded alone.

        Behind a special string, and where the normal form goes from one class of the splitter to another; never inside a
        special string, before a character that may join the one before it, or behind a quote.
        """
        inside, behind = set(), set()
        for s in self.specials:
            at = unit.find(s)
            while at >= 0:
                inside.update(range(at + 1, at + len(s)))
                behind.add(at + len(s))
                at = unit.find(s, at + 1)
        out, start = [0], 0
        for i in range(1, len(unit)):
            c = unit[i]
            if unicodedata.category(c)[0] == "M" or 0x1100 <= ord(c) < 0x1200:
                continue
            left = unicodedata.normalize("NFC", unit[start:i])[-1].lower()[-1]
            start = i
            right = unicodedata.normalize("NFC", c).lower()[0]
            kinds = [unicodedata.category(x)[0] for x in (left, right)]
            apart = kinds[0] == "N" or kinds[1] == "N" or (kinds[0] == "L") != (kinds[1] == "L")
            if i not in inside and (i in behind - inside or apart and left != "'"):
                out.append(i)
        return [*out, len(unit)]

    def brute(self, unit: str) -> list[int]:
        """Counts by the library, prefix by prefix; a unit of more than BRUTE characters in parts that are encoded alone."""
        places = self.boundaries(unit) if len(unit) > BRUTE else [0, len(unit)]
        out, base = [], 0
        for a, b in zip(places, places[1:], strict=False):
            for i in range(a, b, 256):
                out += [base + len(e.ids) for e in self.library.encode_batch([unit[a : j + 1] for j in range(i, min(i + 256, b))], add_special_tokens=False)]
            base = out[-1]
        if out[-1] != len(self.library.encode(unit, add_special_tokens=False).ids):
            raise ValueError("the parts of a unit do not add up to its count")
        return out

    def _deltas(self, unit: str) -> bytes:
        """Changes of the count, one 16-bit number per character of the unit."""
        counts = self.pieces(unit)
        if counts is None or not unit.isascii() and not _LATIN.fullmatch(unit) and counts[-1] != len(self.library.encode(unit, add_special_tokens=False).ids):
            counts = self.brute(unit)
        return array("h", map(sub, counts, [0, *counts])).tobytes() if len(counts) < 32_000 else _wide(counts)

    def _plain(self, word: str) -> bytes:
        """The same for a lower-case word of plain letters, one piece to the splitter."""
        if word != word.lower():
            return self._deltas(word)
        if word.isascii():
            counts = [x[2] for x in self.word(word)]
        else:
            coded = [c.encode() for c in word]
            states = self.word("".join([self.letters[b] for b in b"".join(coded)]))
            counts = [0, *(states[i][2] for i in accumulate(map(len, coded)))]
        return array("h", map(sub, counts[1:], counts)).tobytes() if len(counts) < 32_000 else _wide(counts[1:])

    def learn(self, units: set[str]) -> None:
        new = self.units.learn(units)
        parts = {u: simple_parts(u) or (u, "") for u in new}
        deltas, words = self._deltas, self.words
        for p in words.learn({p for x in parts.values() for p in x if p}):
            words.now[p] = self._plain(p) if p.isalpha() and _LATIN.fullmatch(p) else deltas(p)
        known, now = words.now, self.units.now
        for u, (word, marks) in parts.items():
            now[u] = known[word] + known[marks] if marks else known[word]

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Changes of the count at every character of each text."""
        # All white space is alike to the vocabulary, and each of its characters changes nothing.
        split = [(t.translate(_TO_BLANK) if _OTHER.search(t) else t).split(" ") for t in texts]
        self.learn(set().union(*split) - {""})
        self.units.now[""] = b""
        get = self.units.now.__getitem__
        return [np.frombuffer(b"\0\0".join(map(get, units)), dtype="<i2") for units in split]

    def text(self, text: str) -> np.ndarray:
        return self.texts([text])[0]


#: Characters whose normal form and lower case are one character each, whatever stands beside them.
_LATIN = re.compile("[\x21-\x7e\xa1-\xa9\xab-\xac\xae-\xff\u0100-\u012f\u0131-\u017f]*")
#: White space but the blank.
_OTHER = re.compile("[\t\n\r\x0b\x0c]")
_TO_BLANK = dict.fromkeys(map(ord, "\t\n\r\x0b\x0c"), " ")


def _wide(counts: list[int]) -> bytes:
    """Changes of a very long unit; each must fit 16 bits, what does not fit is carried to the next characters."""
    out, now = [], 0
    for c in counts:
        step = max(-32_000, min(32_000, c - now))
        now += step
        out.append(step)
    if now != counts[-1]:
        raise ValueError("a unit's count changes too fast to be stored")
    return np.array(out, dtype="<i2").tobytes()


def stored(deltas: np.ndarray) -> bytes:
    """A prefix table: one flag byte (1: 8-bit, 2: 16-bit changes), then the deflated changes."""
    small = not len(deltas) or (deltas.min() >= -128 and deltas.max() <= 127)
    return (b"\1" if small else b"\2") + zlib.compress((deltas.astype(np.int8) if small else deltas).tobytes(), 1)


def prefix_counts(blob: bytes) -> np.ndarray:
    """Token count of every prefix, the empty one included: entry i is the count of text[:i]."""
    kind = np.int8 if blob[:1] == b"\1" else np.dtype("<i2")
    return np.concatenate([[0], np.cumsum(np.frombuffer(zlib.decompress(blob[1:]), dtype=kind), dtype=np.int64)])


def count_at(blob: bytes, chars: int) -> int:
    """Tokens of the first ``chars`` characters."""
    counts = prefix_counts(blob)
    return int(counts[min(max(chars, 0), len(counts) - 1)])


def longest_within(blob: bytes, budget: int) -> int:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    return int(np.flatnonzero(prefix_counts(blob) <= budget)[-1])


#: Tried where no longer token ends so.
_SHORT = (2, 1)
#: Owner of what workers remember.
OWNER = "token_counts"


def counter(name: str) -> PrefixCounter:
    """This worker's counter for a file."""
    return remember(OWNER, name, lambda: PrefixCounter(name))


def prefix_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """``doc_id, n_bytes, n_chars, n_tokens, prefix_deltas`` for every row; n_tokens is the table's last prefix.

    Null text counts as empty: 0 tokens and an empty table. Null ids stay null, repeated rows each
    give a row, other columns are ignored, an empty table gives no rows. Texts are taken whole,
    without begin, end or other added tokens; special strings in a text are found as the
    library finds them. A unit (text between white space) that Unicode normalisation
    changes letter by letter is counted by the library itself, at every prefix; beyond ``BRUTE`` characters in parts that are
    encoded alone.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch.column(1))
            for lo, hi in chunks([len(t) for t in texts], 8 << 20):
                deltas = count.texts(texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[lo:hi],
                        pa.array([len(t.encode()) for t in texts[lo:hi]], type=pa.int64()),
                        pa.array([len(t) for t in texts[lo:hi]], type=pa.int64()),
                        pa.array([int(d.sum(dtype=np.int64)) for d in deltas], type=pa.int64()),
                        pa.array([stored(d) for d in deltas], type=pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_chars", "n_tokens", "prefix_deltas"],
                )

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), kernel, "doc_id long, n_bytes long, n_chars long, n_tokens long, prefix_deltas binary", OWNER)
