"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is
parsed against it: from each phrase's start the automaton follows the text as
far as the text's characters occur together in the language's sample (the
longest match), then the next phrase starts. A longest match against a sample of
N bytes is log(N) / entropy bytes long, so that phrases times log2(N), per byte
of text, estimate the cross entropy whatever the sample's size. The language
that needs the fewest phrases, so normalised, wins.

The automaton is used as one flat table of transitions: where a state has no
transition by a byte, the entry holds the transition from the root, marked with
the sign bit as the start of a phrase. Texts are parsed in many lanes at once,
a lane for each segment of a text. A segment's parse starts afresh; then the
parse of the segment before it is continued across the border until both are
in the same state, and the phrases are counted as in one parse of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx

#: Bytes that a lane parses; a longer text is parsed in segments, joined at their borders.
SEGMENT = 1024
UNDETERMINED = "und"

#: Bytes that count in a parse. Letters of ASCII are lower-cased, bytes beyond ASCII stay, all else is a space.
FOLD = np.full(256, 32, np.uint8)
FOLD[65:91] = np.arange(97, 123)
FOLD[97:123] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def suffix_automaton(sample: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts the substrings of ``sample``; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, depth, last = [-1], [0], 0
    for c in sample:
        new = len(moves)
        moves.append({})
        depth.append(depth[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if depth[q] == depth[p] + 1:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                depth.append(depth[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return moves


class Parser:
    """The automata of some languages as one table. A state's number is its row's first entry."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        folded = {k: FOLD[np.frombuffer(samples[k], np.uint8)] for k in self.languages}
        seen = np.unique(np.concatenate([np.array([32], np.uint8), *folded.values()]))
        self.symbol = np.zeros(256, np.int32)  # symbol 0: bytes that no sample has
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.symbol = self.symbol[FOLD]
        width = len(seen) + 1
        code = np.zeros(256, np.int32)
        code[seen] = np.arange(1, len(seen) + 1)
        tables, self.start, first = [], [], 0
        for k in self.languages:
            moves = suffix_automaton(code[folded[k]].astype(np.uint8).tobytes())
            dead = len(moves)  # before the first phrase and behind a byte unknown to the sample: whatever comes starts a phrase
            table = np.full((dead + 1, width), first + dead * width, np.int32)
            for c, to in moves[0].items():
                table[:, c] = first + to * width
            table |= np.int32(-(1 << 31))
            state = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
            by = np.fromiter((c for m in moves for c in m), np.int64)
            table[state, by] = first + np.fromiter((t for m in moves for t in m.values()), np.int64) * width
            tables.append(table.reshape(-1))
            self.start.append(first + dead * width)
            first += table.size
        self.table = np.concatenate(tables)
        # bits of a phrase: the logarithm of the sample's size
        self.bits = np.log2([max(2, len(samples[k])) for k in self.languages])

    def _follow(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Phrases that start in each lane, by language; ``state`` (languages x lanes) moves on to the lanes' ends. Lanes are sorted by falling size."""
        count = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
        for step, n in enumerate(active):
            got = self.table[state[:, :n] + symbols[begin[:n] + step]]
            count[:, :n] -= got >> 31  # the sign bit, as -1
            state[:, :n] = got & 0x7FFFFFFF
        return count

    def phrases(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Phrases of the rows within ``at``, by row and language."""
        symbols = self.symbol[data[at[0] : at[-1]]]
        at = at - at[0]
        length = np.diff(at)
        parts = -(-length // SEGMENT)
        row = np.repeat(np.arange(len(length)), parts)
        first = np.repeat(np.cumsum(parts) - parts, parts)
        part = np.arange(len(row)) - first
        begin = at[row] + part * SEGMENT
        size = np.minimum(SEGMENT, at[row + 1] - begin)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        row, begin, size, part = row[order], begin[order], size[order], part[order]
        before = place[np.maximum(order - 1, 0)]  # the lane of the segment before
        after = np.full(len(order), -1)
        after[before[part > 0]] = np.flatnonzero(part > 0)
        fresh = np.array(self.start, np.int32)[:, None]
        state = np.repeat(fresh, len(row), 1)
        count = self._follow(symbols, begin, size, state)
        alone = state.copy()
        extra = np.zeros(count.shape, np.int32)  # phrases of the continued parse less those of the fresh one
        todo = np.flatnonzero(part > 0)
        while len(todo):
            extra[:, todo] = 0
            one, two = state[:, before[todo]], np.repeat(fresh, len(todo), 1)
            lane, step, changed = todo, 0, []
            while len(lane):
                symbol = symbols[begin[lane] + step]
                one, two = self.table[one + symbol], self.table[two + symbol]
                extra[:, lane] += (two >> 31) - (one >> 31)
                one, two = one & 0x7FFFFFFF, two & 0x7FFFFFFF
                step += 1
                go = (one != two).any(0) & (size[lane] > step)
                end = np.where((one != two).any(0), one, alone[:, lane])
                moved = ~go & (state[:, lane] != end).any(0)  # the next border has another start than it was followed from
                state[:, lane[moved]] = end[:, moved]
                changed.append(lane[moved])
                lane, one, two = lane[go], one[:, go], two[:, go]
            follow = after[np.concatenate(changed)]
            todo = follow[follow >= 0]
        count += extra
        out = np.zeros((len(length), len(self.languages)))
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(row, weights=count[k], minlength=len(length))
        return out


_parsers: dict[tuple, Parser] = {}


def parser_of(samples: dict[str, bytes]) -> Parser:
    """The parser of ``samples``, built once in a process: the samples are far smaller than its table."""
    key = tuple(sorted(samples.items()))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(samples)
    return _parsers[key]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", max_docs: int = 128, max_chars: int = 256, max_total: int = 1 << 18) -> dict[str, bytes]:
    """A sample of text for each language: of ``max_docs`` texts each, chosen by hash, a piece of at most ``max_chars`` characters from the middle; equal pieces count once.

    These bounds are what this classifier is fitted on; predictions read whole
    texts. Every language is learned: where ``max_docs`` pieces of each would come to more than
    ``max_total`` characters, each language has fewer pieces (one at least), as
    the automata of all languages are in memory together. Null languages and null texts are left out.
    """
    pieces = (
        labelled.where(F.col(lang).isNotNull() & (F.trim(text) != ""))
        .select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.substring(F.col(text), F.greatest(F.lit(1), (F.length(text) - max_chars) / 2).cast("int"), F.lit(max_chars)).alias("piece"))
    )
    distinct = pieces.groupBy("lang", "piece").agg(F.min("h").alias("h"))
    chosen = distinct.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))).where(F.col("k") <= max_docs)
    got = chosen.orderBy("lang", "k").collect()  # max_docs pieces a language
    languages = {r["lang"] for r in got}
    most = max(1, min(max_docs, max_total // (max_chars * max(1, len(languages)))))
    samples: dict[str, list[str]] = {}
    for r in got:
        if r["k"] <= most:
            samples.setdefault(r["lang"], []).append(r["piece"])
    return {k: " ".join(v).encode() for k, v in samples.items()}


def identify(docs: DataFrame, samples: dict[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` without its text, with lang_pred, score and phrases (per language, in the languages' order).

    phrases are counts; the language with the least phrases times log2 of its
    sample's bytes wins. score: 1 less the winner's share of the runner-up's,
    between 0 (a tie) and 1; 1 where only one language was learned. Ties go to the first
    language by name. A text that is null or has no letter is ``und`` with
    score 0, as is every text when no language was learned. A text of any length
    is parsed whole. Rows are independent: repeated rows get equal results. Columns of ``docs`` named like a result column are replaced.
    """
    made = ["lang_pred", "score", "phrases"]
    kept = [c for c in tx.others(docs, made) if c != text]
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "lang_pred string, score double, phrases array<bigint>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(samples) if samples else None
        names = np.array([*(parser.languages if parser else ()), UNDETERMINED], object)
        for batch in batches:
            data, at = tx.text_buffers(batch.column(len(kept)))
            n = len(at) - 1
            if not n:
                continue
            counts = np.concatenate([parser.phrases(data, at[a : b + 1]) for a, b in tx.slices(at, 8 << 20)]) if parser else np.zeros((n, 0))
            letter = np.asarray(batch.column(len(kept) + 1).to_numpy(zero_copy_only=False), bool)
            entropy = counts * parser.bits if parser else counts
            if counts.shape[1] > 1:
                two = np.partition(entropy, 1, 1)[:, :2]
                score = 1 - two[:, 0] / np.maximum(two[:, 1], 1)
            else:
                score = np.ones(n)
            known = letter & (counts.shape[1] > 0)
            best = np.where(known, entropy.argmin(1) if counts.shape[1] else 0, len(names) - 1)
            phrases = tx.list_array(pa.array(counts.reshape(-1).astype(np.int64)), np.full(n, counts.shape[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(names[best], pa.string()), pa.array(np.where(known, score, 0.0)), phrases], names=[*kept, *made])

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("__text"), letters.alias("__letters")).mapInArrow(run, fields)
