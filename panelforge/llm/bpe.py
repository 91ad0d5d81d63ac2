"""Byte-level BPE over Arrow batches with the tokenizers library.

The tokenizer is built on each worker from a rank file (base64 token and rank on
each line) and a split pattern: ranks give the vocabulary, and each token's
last merge is found by merging its bytes with the lower ranks. Bytes are written
as printable characters (one character for each of the 256 bytes); decoding reverses
that table and joins bytes before reading UTF-8, so that a character split over
tokens comes back whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import column, text_slices, tidy

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"


def byte_chars() -> list[str]:
    """The character of each byte: printable Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts a token is merged from: its bytes, merged by all lower ranks."""
    parts = [token[i:i + 1] for i in range(len(token))]
    top = ranks[token]
    while len(parts) > 2:
        found = [(ranks.get(parts[i] + parts[i + 1], top), i) for i in range(len(parts) - 1)]
        rank, i = min(found)
        if rank >= top:
            return None
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def resolve(path: str | None) -> str:
    """A rank file by its place, or by its name among the public vocabularies."""
    if path and "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path or DEFAULT_RANKS)


@lru_cache(maxsize=2)
def coder(path: str | None, pattern: str | None) -> tuple:
    """(tokenizers.Tokenizer, bytes of each id) for a rank file; built once in each worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    ranks = read_ranks(resolve(path))
    chars = byte_chars()
    written = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = [(written[m[0]], written[m[1]]) for token in sorted(ranks, key=ranks.get) if len(token) > 1 and (m := last_merge(token, ranks))]
    out = Tokenizer(models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    back = {c: b for b, c in enumerate(chars)}
    table: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for text, rank in out.get_vocab().items():
        table[rank] = bytes(back[c] for c in text)
    return out, table


def decode_bytes(ids, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


def bpe_encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None, offsets: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) of each text; with ``offsets`` also starts and ends in characters.

    A null text is empty and has no ids. Tokens that split a character each
    span that whole character. Rows keep their number; repeated rows and null ids
    stay. Other columns are ignored.
    """
    form = "doc_id bigint, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, _, _ in text_slices(b, "text"):
                tok, _ = coder(ranks, pattern)
                texts = column(rows, "text").fill_null("").to_pylist()
                got = (tok.encode_batch if offsets else tok.encode_batch_fast)(texts, add_special_tokens=False)
                cols = [column(rows, "doc_id"), pa.array([g.ids for g in got], pa.list_(pa.int32()))]
                if offsets:
                    cols += [pa.array([[o[k] for o in g.offsets] for g in got], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "starts", "ends"][:len(cols)])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), form)


def bpe_decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, raw (bytes) and text of each id list; bytes that are not UTF-8 become U+FFFD in text.

    A null list gives empty bytes; an unknown id is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, table = coder(ranks, pattern)
            raw = [decode_bytes(x or (), table) for x in column(b, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw])], ["doc_id", "raw", "text"])

    return encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(tidy(run), "doc_id bigint, raw binary, text string")


def bpe_digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode each text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ids_sha256 is over little-endian unsigned 32-bit ids, decoded_sha256 over the
    decoded bytes. A null text is empty. Rows keep their number.
    """
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, _, _ in text_slices(b, "text"):
                tok, table = coder(ranks, pattern)
                got = tok.encode_batch_fast(column(rows, "text").fill_null("").to_pylist(), add_special_tokens=False)
                ids = [g.ids for g in got]
                yield pa.RecordBatch.from_arrays(
                    [column(rows, "doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(np.array(x, "<u4").tobytes()) for x in ids]), pa.array([sha(decode_bytes(x, table)) for x in ids])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(tidy(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
