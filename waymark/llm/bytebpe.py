"""Byte-level BPE encoding and decoding of whole texts with tiktoken and a local rank file.

A long text is cut where the split pattern is certain to begin a new match, so that the pieces' ids
joined are the ids of the whole: at a space or line feed that follows a character other than white
space. No match of the pattern goes from other characters on to white space, and no alternative looks
back, so what stands before the cut can't change what comes after. Long runs of white space, on which
the pattern's look-ahead would backtrack, are matched here by the same rule.

Cases: a null text counts as empty; an empty text has no ids and decodes to no bytes; rows are
independent, so repeated rows give repeated results; an empty table gives an empty one; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.common import documents, map_texts, python_batches, record, schemas

#: Characters of a piece of a long text, about.
PIECE = 1 << 16
#: A run of white space from this length on is matched here.
LONG_RUN = 1 << 10

_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85])[ \n]")
_RUN = re.compile(r"[ \n\t\r]{%d,}" % LONG_RUN)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class ByteBpe:
    """Encodes and decodes with the ranks of ``path``; ``pattern`` splits text before merging."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or default_ranks(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.decimals = [b"%d" % i for i in range(self.encoding.n_vocab)]

    def pieces(self, text: str):
        """(piece, whole): pieces that begin at certain match boundaries; ``whole`` ones are a single match."""
        begin = 0
        for run in _RUN.finditer(text):
            # Of a run before other characters, the pattern's match leaves the last one to what follows.
            end = run.end() if run.end() == len(text) else run.end() - 1
            start = run.start()
            if start and text[start - 1].isspace() or start and text[start - 1] in "\x1c\x1d\x1e\x1f" or end < len(text) and text[end + 1 : end + 2].isspace():
                continue  # other kinds of white space stand beside it: left to the pattern
            yield from ((p, False) for p in self._cuts(text[begin:start]))
            yield text[start:end], True
            begin = end
        yield from ((p, False) for p in self._cuts(text[begin:]))

    def _cuts(self, text: str):
        begin = 0
        while len(text) - begin > PIECE and (m := _CUT.search(text, begin + PIECE)):
            yield text[begin : m.start()]
            begin = m.start()
        if begin < len(text):
            yield text[begin:]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= PIECE and len(text) < LONG_RUN:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for piece, whole in self.pieces(text):
            ids += self.encoding._core_bpe.encode_single_piece(piece.encode()) if whole else self.encoding.encode_ordinary(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The raw bytes; they need not be valid UTF-8 when the ids aren't those of a whole text."""
        return self.encoding.decode_bytes(ids)

    def id_digest(self, ids: list[int]) -> str:
        d = self.decimals
        return hashlib.sha256(b",".join([d[i] for i in ids])).hexdigest()


@lru_cache(maxsize=2)
def coder(path: str | None = None) -> ByteBpe:
    return ByteBpe(path)


def encode_documents(df: DataFrame, text: str = "text", id_col: str = "doc_id", ranks: str | None = None, finish=None, fields: str | None = None) -> DataFrame:
    """``id_col`` and the encoding of each text.

    By default the columns are ids array<int> and decoded binary. ``finish(coder, ids, decoded)``, a
    function from a module, may give a tuple of other columns instead; ``fields`` is their DDL.
    """

    def make():
        own = coder(ranks)

        def one(t):
            ids = own.encode(t)
            decoded = own.decode(ids)
            return finish(own, ids, decoded) if finish else (ids, decoded)

        return one

    return map_texts(df, id_col, text, fields or "ids array<int>, decoded binary", make)


def decode_ids(df: DataFrame, ids: str = "ids", id_col: str = "doc_id", ranks: str | None = None) -> DataFrame:
    """``id_col`` and decoded binary, from an array of ids (null: no ids)."""
    python_batches(df.sparkSession)
    kind, arrow = schemas(f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, decoded binary")

    def run(batches):
        own = coder(ranks)
        for batch in batches:
            yield record(arrow, [batch.column(0), [own.decode(x or []) for x in batch.column(1).to_pylist()]])

    return df.select(id_col, ids).mapInArrow(run, kind)


def digests(own: ByteBpe, ids: list[int], decoded: bytes) -> tuple:
    return len(ids), own.id_digest(ids), hashlib.sha256(decoded).hexdigest()


DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), finish=digests, fields=DIGESTS)


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
