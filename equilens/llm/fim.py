"""Fill-in-the-middle transformation by an event scan.

One Aho-Corasick automaton per task finds the ASCII characters that change a
character's class (white space against the rest) and the sentinels. Between
two such events there is nothing to look at: a gap's units follow from its
length. So the events with their running unit counts are a sparse table by
which the place of any unit is looked up (binary search, then arithmetic in the
gap).

A document is cut at two units drawn from the hash of its key, and written as
prefix, suffix, middle (psm) or suffix, prefix, middle (spm) with sentinels
before each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: The sentinels before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: ASCII white space, 09-0D and 20.
SPACES = "\t\n\x0b\x0c\r "


def automaton():
    """Matches of white space have number 0, those of the sentinels 1 to 3."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in SPACES:
        found.add_word(c, 0)
    for k, s in enumerate(SENTINELS, 1):
        found.add_word(s, k)
    found.make_automaton()
    return found


class Events(NamedTuple):
    """Events of one text in code points: where each begins and ends, and its number."""

    begin: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    length: int


def scan(text: str, found) -> Events:
    """All events of ``text``, from left to right (no two overlap)."""
    flat = np.fromiter(chain.from_iterable(found.iter(text)), np.int64).reshape(-1, 2)
    end, kind = flat[:, 0] + 1, flat[:, 1]
    return Events(end - np.where(kind > 0, len(SENTINELS[0]), 1), end, kind, len(text))


class Ranks:
    """Places of units, looked up from events.

    ``char``: a unit is a code point. ``word``: a unit is a run of characters
    other than white space with the white space behind it (white space in
    front of all belongs to the first unit; a text of white space is one unit).
    """

    def __init__(self, events: Events, unit: str):
        if unit == "word":  # a sentinel is part of its word
            space = events.kind == 0
            events = Events(events.begin[space], events.end[space], events.kind[space], events.length)
        self.events, self.unit = events, unit
        before = np.concatenate([[0], events.end])  # a gap begins behind each event, and at the start
        gap = np.concatenate([events.begin, [events.length]]) - before
        if unit == "char":
            per_gap, per_event = gap, events.end - events.begin
        elif unit == "word":  # a run is a unit however long it is
            per_gap, per_event = (gap > 0).astype(np.int64), np.zeros(len(events.end), np.int64)
        else:
            raise ValueError(f"no such unit: {unit}")
        #: Gaps' first places, and units before them.
        self.at = before
        self.units = np.concatenate([[0], np.cumsum(per_gap[:-1] + per_event)])
        self.n = int(self.units[-1] + per_gap[-1])
        if unit == "word":
            self.n = max(self.n, int(events.length > 0))

    def place(self, rank: int) -> int:
        """Code points before the unit of that number (from 0); the text's length for ``rank`` n."""
        if rank <= 0:
            return 0
        if rank >= self.n:
            return self.events.length
        gap = int(np.searchsorted(self.units, rank, "right")) - 1
        # of words, the last gap with that count is where the unit's run begins; of characters, the rest is counted off
        return int(self.at[gap]) + (rank - int(self.units[gap]) if self.unit == "char" else 0)

    def inside_word(self, place: int) -> bool:
        """Whether a cut there has no white space on either side and isn't at an end of the text."""
        i = int(np.searchsorted(self.events.begin, place))
        touches = (i < len(self.events.begin) and self.events.begin[i] == place) or (i > 0 and self.events.end[i - 1] == place)
        return 0 < place < self.events.length and not touches


class Cut(NamedTuple):
    n: int
    form: str
    prefix: int | None
    middle: int | None
    inside: int | None
    output: str


def transform(text: str, digest: str, found, unit: str = "char", plain: int = 10, spm: int = 20) -> Cut:
    """One text's form and output. ``digest``: at least 32 hex digits that draw the cuts and the form."""
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    events = scan(text, found)
    ranks = Ranks(events, unit)
    if not text or h3 % 100 >= 100 - plain or (events.kind > 0).any():
        return Cut(ranks.n, "plain", None, None, None, text)
    a, b = sorted((h1 % (ranks.n + 1), h2 % (ranks.n + 1)))
    x, y = ranks.place(a), ranks.place(b)
    prefix, middle, suffix = text[:x], text[x:y], text[y:]
    inside = ranks.inside_word(x) + ranks.inside_word(y)
    if h4 % 100 < spm:
        return Cut(ranks.n, "spm", x, y - x, inside, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Cut(ranks.n, "psm", x, y - x, inside, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


def rebuild(output: str, form: str, found) -> str:
    """The text of an output: its three parts are what is between the sentinels (no part has one, as such texts stay plain)."""
    if form == "plain":
        return output
    events = scan(output, found)
    marks = np.flatnonzero(events.kind > 0)
    first, second, third = (int(events.end[i]) for i in marks)
    parts = output[first : int(events.begin[marks[1]])], output[second : int(events.begin[marks[2]])], output[third:]
    prefix, suffix = (parts[1], parts[0]) if form == "spm" else (parts[0], parts[1])
    return prefix + parts[2] + suffix


def _fields(df: DataFrame, kept: list[str], made: str) -> str:
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), made])


def _by_bytes(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about 16 MB of text each."""
    _, at = tx.text_buffers(batch.column(column))
    for a, b in tx.slices(at, 1 << 24):
        yield batch.slice(a, b - a)


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, unit: str = "char", plain: int = 10, spm: int = 20
) -> DataFrame:
    """``docs`` without its text, with n, form, prefix_chars, middle_chars, cuts_in_words and output.

    n: units of the text (``unit``: char or word, see Ranks). The cuts and the
    form are drawn from the sha256 of ``seed``, a colon and the key as text, so
    reruns agree; ``plain`` of 100 documents stay as they are, as do empty
    texts and those with a sentinel; ``spm`` of 100 others are spm, the rest psm.
    prefix_chars and middle_chars are code points; they and cuts_in_words (how
    many of the two cuts fall between two characters that aren't white space)
    are null for plain ones. Null texts are empty; a null key is an empty
    string. Texts of any length are scanned whole. Rows are independent: a
    repeated row gives the same output again; equal texts under different keys
    are cut at different places. Columns of ``docs`` named like a result column
    are replaced. An empty table gives an empty one.
    """
    made = ["n", "form", "prefix_chars", "middle_chars", "cuts_in_words", "output"]
    kept = [c for c in tx.others(docs, made) if c != text]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for whole in batches:
            for batch in _by_bytes(whole, len(kept) + 1):
                digests, texts = batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist()
                cuts = [transform(t or "", d, found, unit, plain, spm) for d, t in zip(digests, texts)]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*cuts), types)] if cuts else [pa.array([], kind) for kind in types]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[*kept, *made])

    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], drawn.alias("__digest"), F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, _fields(docs, kept, "n bigint, form string, prefix_chars bigint, middle_chars bigint, cuts_in_words bigint, output string"))


def restore(made: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``made`` with restored: the text of each output, exactly. A null output gives an empty text; a column named restored is replaced."""
    kept = tx.others(made, ["restored"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for whole in batches:
            for batch in _by_bytes(whole, len(kept)):
                texts = [rebuild(o or "", f, found) for o, f in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, "restored"])

    rows = made.select(*[F.col(f"`{c}`") for c in kept], F.col(output).alias("__output"), F.col(form).alias("__form"))
    return rows.mapInArrow(run, _fields(made, kept, "restored string"))
