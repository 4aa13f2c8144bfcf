"""Exact byte-level BPE token counts at every prefix, by dynamic programming.

Within a piece of the pre-tokenizer, the last token of a prefix's encoding is the one token that ends there and that
stays next to the last token of the prefix before it when the two are encoded together; the count at a prefix is the
count at that earlier prefix plus one. (An encoding is the only sequence of tokens whose neighbours all are stable so.)
Counts at piece ends add up over a text. prefix_counts() stores the count at every prefix of a text; truncation and
budget questions are looked up there, in the JVM.

Null counts as the empty text: no bytes, no tokens. Texts are never cut, very long ones take one row at a time and four
bytes a character where all counts are stored. Repeated rows and ties give repeated results; an empty table gives an
empty result; other columns aren't read, so their names may be any.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches, whole

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: A worker keeps the counts of so many distinct pieces.
CACHE = 1_000_000
#: After every rank.
FAR = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabulary files: a printable Latin-1 byte stands for itself,
    the others follow in order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounts:
    """Token counts of one vocabulary file (tokenizers' JSON, byte-level BPE)."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        letters = byte_letters()

        def raw(piece: str) -> bytes:
            return bytes(letters[c] for c in piece)

        pairs = [m if isinstance(m, list) else m.split(" ") for m in described["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = {a + b: (a, b) for a, b in sorted(self.ranks, key=self.ranks.__getitem__, reverse=True)}
        # a token that its own merges don't reach is never an output
        self.tokens = {t for t in map(raw, described["model"]["vocab"]) if len(t) == 1 or t in self.made}
        self.longest = max(map(len, self.tokens))
        self.special = [t["content"] for t in described.get("added_tokens", [])]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.find = regex.compile(pattern).findall
        self.pieces: dict[str, int] = {}
        self.most = cache
        self.spines: tuple[dict, dict] = ({}, {})

    def spine(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """(symbol, rank of the merge that absorbs it) from a token's outermost byte up to the token itself."""
        known = self.spines[right].get(token)
        if known is None:
            known, symbol = [(token, FAR)], token
            while len(symbol) > 1:
                parts = self.made[symbol]
                known.append((parts[right], self.ranks[parts]))
                symbol = parts[right]
            known.reverse()
            self.spines[right][token] = known
        return known

    def stays(self, left: bytes, right: bytes) -> bool:
        """Whether the boundary of two tokens survives the merges of their bytes.

        Merges happen by rank. The symbols at the boundary climb the right edge of one token and the left edge of
        the other; they join across it if their own rank comes before both next climbs. At equal ranks the leftmost
        pair goes first.
        """
        mine, other = self.spine(left, True), self.spine(right, False)
        i = j = 0
        while True:
            (a, up), (b, over) = mine[i], other[j]
            rank = self.ranks.get((a, b), FAR)
            if rank < up and rank <= over and rank < FAR:
                return False
            if up == over == FAR:
                return True
            if up <= over:
                i += 1
            else:
                j += 1

    def prefixes(self, raw: bytes) -> list[int]:
        """Counts at each byte prefix of one piece, from the empty one on."""
        counts, last, tokens = [0], [b""], self.tokens
        for end in range(1, len(raw) + 1):
            for start in range(max(0, end - self.longest), end):
                token = raw[start:end]
                if token in tokens and (start == 0 or self.stays(last[start], token)):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
        return counts

    def of_piece(self, piece: str) -> int:
        count = self.pieces.get(piece)
        if count is None:
            if len(self.pieces) >= self.most:
                self.pieces.clear()
            count = self.pieces[piece] = self.prefixes(piece.encode())[-1]
        return count

    def marks(self, text: str) -> tuple[list[str], list[int]]:
        """The pieces (special tokens are pieces of one token) and the counts at their ends."""
        pieces: list[str] = []
        counts: list[int] = []
        at = 0
        for match in self.cut.finditer(text) if self.cut else ():
            plain = self.find(text[at : match.start()])
            pieces += [*plain, match.group()]
            counts += [*map(self.of_piece, plain), 1]
            at = match.end()
        plain = self.find(text[at:])
        return pieces + plain, list(accumulate(counts + list(map(self.of_piece, plain))))

    def count(self, text: str) -> int:
        if self.cut and self.cut.search(text):
            counts = self.marks(text)[1]
            return counts[-1] if counts else 0
        known = self.pieces
        found = self.find(text)
        got = list(map(known.get, found))
        if None in got:
            got = [self.of_piece(piece) if n is None else n for piece, n in zip(found, got, strict=True)]
        return sum(got)

    def every_prefix(self, text: str) -> list[int]:
        """Counts of the first 0, 1, 2, ... characters, each as if the text ended there.

        A piece is decided by what stands up to one character behind it, so a text that ends at n has the pieces of
        the whole one up to n - 2, and what follows these is cut again: mostly the head of one piece, whose counts
        the dynamic programming has already. A special token counts from its last character on; its head is cut together
        with the piece before it.
        """
        counts, base, at = [0], 0, 0
        special = [m.span() for m in self.cut.finditer(text)] if self.cut else []
        for first, end in [*special, (len(text), len(text))]:
            bounds, sums = [at], [base]
            for piece in self.find(text[at:first]):
                bounds.append(bounds[-1] + len(piece))
                sums.append(sums[-1] + self.of_piece(piece))
            heads: dict[int, list[int]] = {}
            mark = 0
            for n in range(at + 1, max(first, end - 1) + 1):
                if n == first:
                    counts.append(sums[-1])
                    continue
                while mark + 1 < len(bounds) and bounds[mark + 1] <= min(n - 2, first - 1):
                    mark += 1
                start = bounds[mark]
                tail = text[start:n]
                pieces = self.find(tail)
                if len(pieces) == 1 and len(tail) > 32 and mark + 1 < len(bounds) and n <= bounds[mark + 1]:
                    if start not in heads:
                        whole_piece = text[start : bounds[mark + 1]]
                        of_bytes = self.prefixes(whole_piece.encode())
                        heads = {start: [of_bytes[k] for k in accumulate((len(c.encode()) for c in whole_piece), initial=0)]}
                    counts.append(sums[mark] + heads[start][n - start])
                else:
                    counts.append(sums[mark] + sum(map(self.of_piece, pieces)))
            base, at = sums[-1], end
            if end > first:
                base += 1
                counts.append(base)
        return counts


@lru_cache(maxsize=4)
def counter(name: str) -> PrefixCounts:
    """One object per Python worker; it keeps its pieces between tasks."""
    import public_tokenizers

    return PrefixCounts(public_tokenizers.path(name), public_tokenizers.PATTERN)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text", prefix_ends: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens; with prefix_ends also the ends of the pieces in characters and the counts there."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint" + ", piece_ends array<bigint>, prefix_tokens array<bigint>" * prefix_ends

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            sizes = pa.compute.cast(pa.compute.binary_length(batch.column(1)), pa.int64())
            texts = (x.as_py() for x in batch.column(1))
            if not prefix_ends:
                yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(np.fromiter(map(own.count, texts), np.int64, len(batch)))], ["doc_id", "n_bytes", "n_tokens"])
                continue
            marks = [own.marks(x) for x in texts]
            ends = [list(accumulate(map(len, pieces))) for pieces, _ in marks]
            totals = [counts[-1] if counts else 0 for _, counts in marks]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(totals, pa.int64()), pa.array(ends, kind), pa.array([c for _, c in marks], kind)], ["doc_id", "n_bytes", "n_tokens", "piece_ends", "prefix_tokens"])

    return kept.mapInArrow(counted, schema)


def prefix_counts(docs: DataFrame, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, counts: the token count of each prefix, by its length in characters from 0 on. Store it once;
    tokens_of(), fits() and truncated() answer from it without encoding anything."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            for at in range(len(batch)):
                part = batch.slice(at, 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([own.every_prefix(part.column(1)[0].as_py())], pa.list_(pa.int32()))], ["doc_id", "text", "counts"])

    return kept.mapInArrow(counted, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, text string, counts array<int>")


def tokens_of(counts: Column, n_chars: Column | int) -> Column:
    """Tokens of the first so many characters."""
    n = n_chars if isinstance(n_chars, Column) else F.lit(n_chars)
    return F.element_at(counts, F.least(n + 1, F.size(counts)).cast("int"))


def fits(counts: Column, budget: int) -> Column:
    """Whether the whole text is within the budget."""
    return F.element_at(counts, -1) <= budget


def longest_within(counts: Column, budget: int) -> Column:
    """Characters of the longest prefix within the budget. A longer prefix can have fewer tokens than a shorter one."""
    return F.coalesce(F.array_max(F.transform(counts, lambda c, i: F.when(c <= budget, i))), F.lit(0))


def truncated(counted: DataFrame, budget: int) -> DataFrame:
    """doc_id, text: the longest prefix within the budget, from the counts of prefix_counts()."""
    return counted.select("doc_id", F.left("text", longest_within(F.col("counts"), budget)).alias("text"))


def op3_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_counts(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > LIMIT)
