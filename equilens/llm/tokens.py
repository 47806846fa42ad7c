"""Token counts: batch encoding in Arrow functions that return lengths only.

Rows are dealt into encoder calls by bytes. Long texts are split where the
encoder can't join what stands on both sides: for a SentencePiece BPE model
with byte fallback and no normalisation, at a single space between two other
characters, provided that no piece of the vocabulary holds a space mark behind
another character (this is read from the model; where it doesn't hold, texts
are encoded whole). The space goes: the encoder puts one before every call's
text. A space mark (U+2581) in a text is a space to such a model, and is
treated as one. A part that is still longer than a call is split before
characters that no piece of several characters has: there the space that the
encoder puts in front stays a token of its own, which is taken off again. As
parts are independent, equal parts are encoded once per batch, and their
lengths are kept in a bounded memo.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import others

#: Bytes of text in one encoder call.
CALL_BYTES = 1 << 18
#: Lengths that a task remembers before it starts anew, and characters of a part up to which its length is remembered: some 60 MB at most.
MEMO_ENTRIES, MEMO_CHARS = 300_000, 32
MARK = "▁"


def _sentencepiece(path: str) -> Callable[[list[str]], list[int]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    probe = " ① é  x "
    apart = (
        not any(MARK in p.lstrip(MARK) for p in pieces)
        and any(model.is_byte(i) for i in range(len(pieces)))
        and model.decode(model.encode(probe)) == probe
        and model.encode("x", out_type=str)[0].startswith(MARK)
    )
    encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    joined = {c for p in pieces if len(p) > 1 for c in p} | {MARK, " "}
    return _by_parts(encode, joined) if apart else lambda texts: _by_bytes(texts, encode)


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def _by_bytes(texts: list[str], encode: Callable) -> list[int]:
    out, call, size = [], [], 0
    for t in texts:
        n = n_bytes(t)
        if call and size + n > CALL_BYTES:
            out += encode(call)
            call, size = [], 0
        call.append(t)
        size += n
    return out + (encode(call) if call else [])


def split_safely(text: str) -> list[str]:
    """Parts of ``text`` between single spaces; runs of spaces, and spaces at the ends, stay within a part."""
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, held = [], None
    for part in parts:  # an empty part stands between two spaces, or at an end
        if held is None:
            held = part
        elif part and held and not held.endswith(" "):
            out.append(held)
            held = part
        else:
            held += " " + part
    return [*out, held]


def split_long(part: str, joined: set[str], most: int) -> list[str]:
    """Pieces of about ``most`` characters; each but the first begins with a character that isn't in ``joined``. A part without such a character stays whole."""
    out, begin = [], 0
    while len(part) - begin > most:
        cut = begin + most
        while cut < len(part) and part[cut] in joined:
            cut += 1
        if cut == len(part):
            break
        out.append(part[begin:cut])
        begin = cut
    return [*out, part[begin:]]


def _by_parts(encode: Callable, joined: set[str]) -> Callable[[list[str]], list[int]]:
    memo: dict[str, int] = {"": 0}

    def length_of_long(part: str) -> int:
        some = split_long(part, joined, CALL_BYTES)
        return sum(_by_bytes(some, encode)) - (len(some) - 1)

    def count(texts: list[str]) -> list[int]:
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
            memo[""] = 0
        parts = [split_safely(t.replace(MARK, " ")) for t in texts]
        fresh = {p for some in parts for p in some if p not in memo}
        long = {p for p in fresh if len(p) > CALL_BYTES}
        rare = [p for p in fresh if MEMO_CHARS < len(p) <= CALL_BYTES]
        short = [p for p in fresh if len(p) <= MEMO_CHARS]
        lengths = dict(zip(long, map(length_of_long, long)))
        lengths.update(zip(rare, _by_bytes(rare, encode)))  # these and the long ones aren't remembered
        memo.update(zip(short, _by_bytes(short, encode)))
        get = memo.__getitem__
        return [sum(lengths[p] if p in lengths else get(p) for p in some) for some in parts] if lengths else [sum(map(get, some)) for some in parts]

    return count


def _tokenizers(path: str) -> Callable[[list[str]], list[int]]:
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    model.encode_special_tokens = False
    return lambda texts: _by_bytes(texts, lambda call: [len(e.ids) for e in model.encode_batch(call, add_special_tokens=False)])


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` without its text, with n_bytes, n_tokens and over_limit (n_tokens above ``limit``).

    ``model_path``: a ``.model`` (SentencePiece) or ``.json`` (tokenizers) file
    that every executor has. Null and empty texts have no bytes and no tokens.
    A text of any length is counted whole; without any safe boundary it is one call.
    Rows are independent: repeated rows and ties need no rule. Columns of
    ``docs`` named like a result column are replaced by it.
    """
    made = ["n_bytes", "n_tokens", "over_limit"]
    kept = [c for c in others(docs, made) if c != text]
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "n_bytes bigint", "n_tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _sentencepiece(model_path) if model_path.endswith(".model") else _tokenizers(model_path)
        for batch in batches:
            column = batch.column(len(kept))
            sizes, lengths, at = [], [], 0
            while at < len(column):
                # a slice by bytes: the texts of a slice are Python strings at the same time
                end, size = at, 0
                while end < len(column) and (end == at or size < 4 * CALL_BYTES):
                    size += len(column[end].as_buffer() or b"") if column[end].is_valid else 0
                    end += 1
                texts = [t or "" for t in column.slice(at, end - at).to_pylist()]
                sizes += map(n_bytes, texts)
                lengths += count(texts)
                at = end
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sizes, pa.int64()), pa.array(lengths, pa.int64())], names=[*kept, "n_bytes", "n_tokens"])

    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").alias("__text")).mapInArrow(run, fields)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
