"""Streaming: a decoder of placeholders over text deltas, and a progress throttle.

The decoder keeps one short buffer for each conversation. It emits the longest prefix whose
decoding can no longer change and holds back what may still become a placeholder, a link
target, an HTML tag or a code span; inside code fences placeholders stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_MARK = re.compile(r"\[[A-Z0-9_]+_[0-9]+\]")
#: What stays canonical: fences, inline code, tags, link targets.
_PROTECTED = re.compile(r"```.*?```|`[^`\n]+`|<[^<>\n]*>|\]\([^()\s]*\)", re.S)
#: An unfinished opening that may still change what stands before the end.
_OPEN = re.compile(r"\[[A-Z0-9_]{0,80}$|(?:\[[A-Z0-9_]{0,80})?\](?:\([^()\s]{0,400})?$|<[^<>\n]{0,400}$|`[^`\n]*$")


def decode_text(text: str, mapping: dict[str, str]) -> str:
    """Placeholders to values outside protected regions, one pass."""
    out, at = [], 0
    plain = lambda s: _MARK.sub(lambda m: mapping.get(m[0], m[0]), s)
    for m in _PROTECTED.finditer(text):
        keep = m[0]
        lead = 1 if keep.startswith("](") else 0
        # A bracket that closes a placeholder in front of a link target belongs to the placeholder.
        out += [plain(text[at : m.start() + lead]), keep[lead:]]
        at = m.end()
    return "".join([*out, plain(text[at:])])


class StreamDecoder:
    """Feeds deltas, returns what is final."""

    def __init__(self, mapping: dict[str, str], held: str = ""):
        self.mapping, self.held = mapping, held

    def feed(self, delta: str, done: bool = False) -> str:
        text = self.held + delta
        stop = len(text) if done else self._stable(text)
        self.held = text[stop:]
        return decode_text(text[:stop], self.mapping)

    @staticmethod
    def _stable(text: str) -> int:
        """Length of the prefix that later text cannot change."""
        at = 0
        for m in _PROTECTED.finditer(text):
            at = m.end()
        fence = text.find("```", at)
        m = _OPEN.search(text, at)
        stop = min(fence if fence >= 0 else len(text), m.start() if m else len(text))
        # Back-ticks at the very end may be the first of a fence.
        while stop > at and text[stop - 1] == "`":
            stop -= 1
        return stop


def decode_stream(deltas: DataFrame, mapping: dict[str, str], timeout: str | None = None) -> DataFrame:
    """``conv_id, seq, text`` from a stream of ``conv_id, seq, delta, done``; state is one buffer for each conversation."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else ""
        decoder, rows = StreamDecoder(mapping, held), []
        pdf = pd.concat(list(frames)).sort_values("seq")
        for seq, delta, done in zip(pdf["seq"], pdf["delta"], pdf["done"], strict=True):
            text = decoder.feed(delta or "", bool(done))
            if text:
                rows.append((key[0], seq, text))
        if bool(pdf["done"].any()) and not decoder.held:
            if state.exists:
                state.remove()
        else:
            state.update((decoder.held,))
        yield pd.DataFrame(rows, columns=["conv_id", "seq", "text"])

    return deltas.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, seq long, text string", "held string", "append", GroupStateTimeout.NoTimeout)


def throttle(progress: DataFrame, key: str, time_col: str = "ts", interval: str = "250 milliseconds", watermark: str = "10 seconds") -> DataFrame:
    """The latest state of each key, phase and interval: a phase change always passes, repeats within an interval do not."""
    bucket = F.window(time_col, interval)
    return progress.withWatermark(time_col, watermark).groupBy(bucket.alias("w"), key, "phase").agg(F.max("done").alias("done")).select(F.col("w.start").alias("at"), key, "phase", "done")
