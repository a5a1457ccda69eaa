"""Token counts by rank-synchronous array merging.

A batch of pre-tokens is held as one flat symbol array with start offsets (a ragged array). In
each round every sequence looks up the ranks of its neighbouring pairs, takes its own lowest, and
all sequences apply theirs at once. Sequences without a mergeable pair leave the batch. What
survives is the encoding; its length is the token count.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subloom.llm.words import as_text

# Pieces of this alphabet are composed already and need no Unicode tables; others go through the
# library one by one.
PLAIN = regex.compile(r"[\x21-\x7e¡-ɏ]+")
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
# The split pattern of the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Longer pieces go through the library, whose queue is faster than rounds over one sequence.
LONG = 80
# Encoded pieces a worker remembers; it starts afresh beyond that.
MEMORY = 600_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte value in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in printable else spare))
        spare += b not in printable
    return out


class WordBpe:
    """Encodes white-space separated pieces as the library does for this vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if pattern != PATTERN:
            raise ValueError("another split pattern than this encoder's")
        # pieces hold no white space, so a line break stands between them
        self.words = regex.compile(rf"\n|{PATTERN}")
        self.specials = tuple(t["content"] for t in spec["added_tokens"])
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], len(self.keys))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of all words, one after another, and how many each word keeps."""
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(size)
        sym[ends - 1] = self.last[raw[ends - 1]]
        seq = np.repeat(np.arange(len(words)), size)
        none, done = len(self.keys), []
        # The rank of each symbol with its right neighbour; a merge changes two of them.
        rank = np.full(len(sym), none)
        inside = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inside] = self._ranks(sym[inside], sym[inside + 1])
        while len(sym):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            length = np.diff(np.r_[first, len(seq)])
            low = np.minimum.reduceat(rank, first)
            live = np.repeat(low < none, length)
            done.append((seq[~live], sym[~live]))
            hit = live & (rank == np.repeat(low, length))
            at = np.flatnonzero(hit)
            if len(at):  # of equal neighbours that overlap, every second one counts
                run = np.r_[True, np.diff(at) != 1]
                place = np.arange(len(at)) - np.maximum.accumulate(
                    np.where(run, np.arange(len(at)), 0)
                )
                at = at[place % 2 == 0]
            sym[at] = self.made[rank[at]]
            live[at + 1] = False
            at = np.cumsum(live)[at] - 1  # where the merged symbols stand from now on
            sym, seq, rank = sym[live], seq[live], rank[live]
            new = np.zeros(len(seq) + 1, bool)
            new[at] = new[at - 1] = True  # -1 is the place behind the last
            changed = np.flatnonzero(new[:-1])
            right = np.minimum(changed + 1, len(seq) - 1)
            inside = (right > changed) & (seq[right] == seq[changed])
            rank[changed] = none
            changed, right = changed[inside], right[inside]
            rank[changed] = self._ranks(sym[changed], sym[right])
        seqs = np.concatenate([s for s, _ in done]) if done else np.zeros(0, np.int64)
        syms = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(seqs, kind="stable")
        return syms[order], np.bincount(seqs, minlength=len(words))

    def _simple(self, piece: str) -> bool:
        """Short, without special strings and in no need of Unicode tables."""
        if len(piece) > LONG or "<" in piece and any(s in piece for s in self.specials):
            return False
        if piece.isascii():
            return piece.isprintable()
        return bool(PLAIN.fullmatch(piece))

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Per piece its ids as little-endian unsigned 32-bit numbers."""
        out = [b""] * len(pieces)
        simple = list(map(self._simple, pieces))
        mine = np.flatnonzero(simple)
        for i in np.flatnonzero(np.logical_not(simple)):
            ids = self.library.encode(pieces[i], add_special_tokens=False).ids
            out[i] = np.array(ids, "<u4").tobytes()
        parts = self.words.findall("\n".join(compress(pieces, simple)).lower())
        breaks = np.fromiter((p == "\n" for p in parts), bool, len(parts))
        owners = mine[np.cumsum(breaks)[~breaks]] if len(mine) else mine
        # Pieces share words ("the", "The", "the,"): each is merged once.
        number: dict[str, int] = {}
        use = np.array([number.setdefault(p, len(number)) for p in parts if p != "\n"], np.int64)
        if number:
            ids, counts = self.merge([w.encode() for w in number])
            first, size = np.cumsum(counts) - counts, counts[use]
            before = np.cumsum(size) - size
            raw = ids[np.repeat(first[use] - before, size) + np.arange(size.sum())].astype("<u4").tobytes()
            total = np.bincount(owners, size, len(pieces)).astype(np.int64) * 4
            stop = np.cumsum(total)
            some = np.flatnonzero(total)
            for i, a, b in zip(some.tolist(), (stop - total)[some].tolist(), stop[some].tolist()):
                out[i] = raw[a:b]
        return out


class Encoder:
    """Ids of whole texts; pieces already seen by this worker are not encoded again."""

    def __init__(self, path: str):
        self.bpe = WordBpe(path)
        self.known: dict[str, bytes] = {}

    def texts(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; none for null. Texts are
        taken in groups, so that new pieces are merged many at a time."""
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size > 2_000_000:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.known) > MEMORY:
            self.known.clear()
        split = [None if SEPARATORS.search(t) else t.split() for t in texts]
        known = self.known
        fresh = list(set().union(*(ps for ps in split if ps)).difference(known))
        known.update(zip(fresh, self.bpe.encode(fresh)))
        for text, pieces in zip(texts, split):
            if pieces is None:  # separators that only one of the two splits at
                ids = self.bpe.library.encode(text, add_special_tokens=False).ids
                yield np.array(ids, "<u4").tobytes()
            else:
                yield b"".join(map(known.__getitem__, pieces))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker and vocabulary file."""
    return Encoder(path)


def token_counts(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Rows (id, n_bytes, n_tokens), one per row of ``docs``: UTF-8 bytes and tokens of the
    whole text under the vocabulary file at ``path`` (on every executor).

    No special tokens are added; their strings inside a text count as the library counts them.
    Null and empty texts have 0 of both. Repeated rows are counted each; a null id stays null;
    other columns are not read. An empty table gives no rows.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in batches:
            sizes = [len(t.encode()) if t else 0 for t in batch["text"]]
            tokens = [len(ids) // 4 for ids in enc.texts(batch["text"])]
            yield pd.DataFrame({"id": batch["id"], "n_bytes": sizes, "n_tokens": tokens})

    kind = docs.schema[id_column].dataType
    rows = docs.select(as_text(F.col(id_column)).alias("id"), F.col(text_column).alias("text"))
    counted = rows.mapInPandas(count, "id string, n_bytes long, n_tokens long")
    return counted.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_column)
