"""Token ids of whole texts by a public byte-level BPE vocabulary.

A long text is encoded as a tree: its halves are encoded by themselves and joined by re-encoding a window around the cut. The joined ids equal those of the
whole, for this reason: the pre-tokeniser scans left to right without memory, and a word that ends two or more characters before the end of what it
sees has been decided by those characters alone. So the left half's last such word end is also a word end of the whole; the window starts there. Where the window
and the right half first have a word end in common, again two characters before the window's end, both go on alike. If there is none the window grows, at most to the end
of the right half. Joining is associative, so any tree over the pieces gives the same ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's published pre-tokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = 1 << 12


@dataclass
class Part:
    """text[start:end) scanned by itself: its ids, its word ends, and how many ids lie before each of them."""

    start: int
    end: int
    ids: np.ndarray
    ends: np.ndarray
    counts: np.ndarray


class Encoder:
    def __init__(self, vocabulary: bytes, pattern: str = PATTERN, piece: int = PIECE) -> None:
        import regex
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        self.bpe = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)
        self.word = regex.compile(pattern)
        self.piece = piece

    def encode(self, text: str | None) -> list[int]:
        """Null and empty texts have no ids; strings of special tokens are ordinary text."""
        if not text:
            return []
        if len(text) <= self.piece:
            return self.bpe.encode_ordinary(text)
        return self.tree(text, 0, len(text)).ids.tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the bytes of halves, joined up the tree; a cut may lie within a character, so characters are made at the top."""

        def part(a: int, z: int) -> bytes:
            if z - a <= self.piece:
                return self.bpe.decode_bytes(ids[a:z])
            middle = (a + z) // 2
            return part(a, middle) + part(middle, z)

        return part(0, len(ids)).decode()

    def leaf(self, text: str, start: int, end: int) -> Part:
        part = text[start:end]
        ids = np.array(self.bpe.encode_ordinary(part), np.int64)
        ends = np.array([m.end() for m in self.word.finditer(part)], np.int64)
        points = np.frombuffer(part.encode("utf-32-le"), np.uint32)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.cumsum(width)[ends - 1] if len(ends) else ends
        counts = np.searchsorted(np.cumsum(self.width[ids]), at, side="left") + 1 if len(ends) else ends
        return Part(start, end, ids, ends + start, counts)

    def tree(self, text: str, start: int, end: int) -> Part:
        if end - start <= self.piece:
            return self.leaf(text, start, end)
        middle = (start + end) // 2
        return self.join(text, self.tree(text, start, middle), self.tree(text, middle, end))

    def join(self, text: str, left: Part, right: Part) -> Part:
        k = int(np.searchsorted(left.ends, left.end - 2, side="right")) - 1
        cut, before = (int(left.ends[k]), int(left.counts[k])) if k >= 0 else (left.start, 0)
        reach = 64
        while True:
            stop = min(right.end, right.start + reach)
            window = self.leaf(text, cut, stop)
            if stop == right.end:
                keep, at = len(window.ends), None
                break
            common = np.intersect1d(window.ends[window.ends <= stop - 2], right.ends, assume_unique=True)
            if len(common):
                at = int(np.searchsorted(right.ends, common[0]))
                keep = int(np.searchsorted(window.ends, common[0])) + 1
                break
            reach *= 4
        w_ids = window.ids[: window.counts[keep - 1]] if keep else window.ids
        ids, ends, counts = [left.ids[:before], w_ids], [left.ends[: k + 1], window.ends[:keep]], [left.counts[: k + 1], window.counts[:keep] + before]
        if at is not None:
            skip = int(right.counts[at])
            ids.append(right.ids[skip:])
            ends.append(right.ends[at + 1 :])
            counts.append(right.counts[at + 1 :] - skip + before + len(w_ids))
        return Part(left.start, right.end, np.concatenate(ids), np.concatenate(ends), np.concatenate(counts))


def vocabulary(tokenizers: str = TOKENIZERS, name: str = VOCABULARY) -> bytes:
    return (Path(tokenizers) / name).read_bytes()


def shared(spark, tokenizers: str):
    """The vocabulary file (0.8 MB, a fixed size) for all workers, so they need no copy of it."""
    return spark.sparkContext.broadcast(vocabulary(tokenizers))


def encode_corpus(documents: DataFrame, tokenizers: str = TOKENIZERS, piece: int = PIECE) -> DataFrame:
    """``doc_id, ids``: every document's token ids, an empty list for null and empty texts; row by row, without a shuffle."""
    file = shared(documents.sparkSession, tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(file.value, piece=piece)
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, len(batch), 256):  # ids take more room than text: small batches leave
                ids = [encoder.encode(t) for t in texts.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 256), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], tokenizers: str = TOKENIZERS) -> DataFrame:
    """``keep``, ``text_key`` (a 256-bit hash of the text) and ``tokens`` of every document with a text that is not empty."""
    file = shared(documents.sparkSession, tokenizers)
    rows = documents.filter(F.length("text") > 0).select(*keep, F.sha2("text", 256).alias("text_key"), "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema) + ", tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(file.value)
        for batch in batches:
            n = [len(encoder.encode(t)) for t in batch.column("text").to_pylist()]
            yield batch.drop_columns(["text"]).append_column("tokens", pa.array(n, pa.int64()))

    return rows.mapInArrow(run, schema)
