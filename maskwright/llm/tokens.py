"""Token ids of whole texts, unit by unit.

A unit is a run of characters other than white space. The vocabulary's normaliser turns
white space into blanks, its splitter drops it, and no rule looks across it, so a text's
ids are its units' ids one after the other; a plain unit's are those of its lower-case word and
of the marks after it. The library itself encodes what a worker has not seen or has
forgotten: what it remembers is bounded.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from .common import remember, tokenizer_path

#: Units that a worker remembers.
MEMO = 1_600_000
#: str.split takes these for white space, the vocabulary does not.
_ODD = re.compile("[\x1c-\x1f]")
_PLAIN = re.compile("[ \t\n\r\x0b\x0c]+")
#: Ends of sentences, closing quotes and brackets allowed after them.
_END = re.compile("[.!?…。！？]['\"”’»)\\]]*$")


def units_of(text: str) -> list[str]:
    """The units of a text, in order."""
    if _ODD.search(text):
        return [x for x in _PLAIN.split(text) if x]
    return text.split()


#: A word of plain Latin letters and a run of marks after it: the splitter parts them, and each letter has one lower-case form.
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([-.,!?;:%$&*#|()\\[\\]\"/]*)")


#: Texts whose lower case is letter by letter.
_LATIN = re.compile("[\0-\xff]*")


class Memo:
    """What a worker remembers, in two generations: what is not asked for while one fills up is forgotten."""

    def __init__(self, limit: int):
        self.half, self.now, self.old = limit // 2, {}, {}

    def learn(self, keys: set[str]) -> list[str]:
        """Make the keys' values ready in ``now``; the keys that have none yet are returned."""
        if len(self.now) > self.half:
            self.now, self.old = {}, self.now
        now, old, new = self.now, self.old, []
        for k in keys:
            if k not in now:
                v = old.get(k)
                if v is None:
                    new.append(k)
                else:
                    now[k] = v
        return new


def simple_parts(unit: str) -> tuple[str, str] | None:
    """The lower-case word and the marks of a plain unit."""
    m = _SIMPLE.fullmatch(unit)
    return (m[1].lower(), m[2]) if m else None


class Encoder:
    """Encodes texts with a ``tokenizers`` file; nothing is added, truncated or padded."""

    def __init__(self, name: str = "word_bpe_49k.json", memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path(name))
        self.library.no_truncation()
        self.library.no_padding()
        self.units, self.words = Memo(memo), Memo(memo)
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        suffix = json.loads(self.library.to_str())["model"]["end_of_word_suffix"]
        #: Whether a token ends a word, and whether it ends a sentence.
        self.last, self.stop = (np.zeros(self.library.get_vocab_size(), dtype=bool) for _ in range(2))
        for token, i in vocabulary.items():
            self.last[i] = token.endswith(suffix)
            self.stop[i] = self.last[i] and bool(_END.search(token.removesuffix(suffix)))

    def _encode_words(self, words: set[str]) -> None:
        """Plain words and marks, many in one text: each ends with its only word-ending token."""
        new, now = self.words.learn(words), self.words.now
        for lo in range(0, len(new), 2000):
            part = new[lo : lo + 2000]
            ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(part):
                raise RuntimeError("a plain word is not one piece to this vocabulary")
            data = ids.tobytes()
            now.update(zip(part, map(data.__getitem__, map(slice, [0, *ends], ends)), strict=True))

    def learn(self, units: set[str]) -> None:
        new, now = self.units.learn(units), self.units.now
        plain, odd = {}, []
        for u in new:
            parts = simple_parts(u)
            if parts:
                plain[u] = parts
            else:
                odd.append(u)
        needed = {p for x in plain.values() for p in x}
        needed.discard("")
        self._encode_words(needed)
        words = self.words.now
        for u, (word, marks) in plain.items():
            now[u] = words[word] + words[marks] if marks else words[word]
        for lo in range(0, len(odd), 20_000):
            part = odd[lo : lo + 20_000]
            for u, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                now[u] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids (uint32) of each text, and the id counts before which a sentence has ended."""
        known = self.units.now.get
        # Lower case first, where that is what the vocabulary does, letter by letter: fewer distinct units.
        split = [units_of(t.lower() if "<|" not in t and (t.isascii() or _LATIN.fullmatch(t)) else t) for t in texts]
        found = [list(map(known, units)) for units in split]
        self.learn({u for units, got in zip(split, found, strict=True) if None in got for u, x in zip(units, got, strict=True) if x is None})
        out, known = [], self.units.now.get
        for units, got in zip(split, found, strict=True):
            for at in [i for i, x in enumerate(got) if x is None] if None in got else ():
                got[at] = known(units[at])
            ids = np.frombuffer(b"".join(got), dtype="<u4")
            out.append((ids, np.flatnonzero(self.stop[ids]) + 1))
        return out


#: Owner of what workers remember.
OWNER = "tokens"


def encoder(name: str, memo: int = MEMO) -> Encoder:
    """This worker's encoder for a file."""
    return remember(OWNER, (name, memo), lambda: Encoder(name, memo))
