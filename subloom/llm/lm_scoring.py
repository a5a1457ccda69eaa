"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of bigrams, unigrams and the uniform distribution are mixed with
weights that depend on how often the context was seen. The weights come from expectation-
maximisation over counts that are held out document by document: each training token is predicted
from the counts of all other training documents.

Documents are kept as blocks of token numbers. A block sends each of its different n-grams once,
with its count; the tasks that own the n-grams add up and send the totals back, so a frequent
n-gram is as many rows as there are blocks and no table of n-grams is ever in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subloom.llm.arrays import hash_words, mixed, pack, pack_sorted, unpack, unpack_sorted
from subloom.llm.words import as_text
from subloom.session import write_through

# Bytes of text in a block; n-grams that one task adds up.
BLOCK_BYTES, TASK_NGRAMS = 8_000_000, 1_500_000
END, START = np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x5A5A5A5A5A5A5A5A)
# Bits of a bigram's hash beside its task's number; a pair of bigrams of one task is taken for one
# with probability 2^-42.
BITS = np.uint64(42)
# Context-frequency buckets are powers of two; probabilities are binned in quarter octaves for EM.
BUCKETS, STEPS, LOWEST = 48, 4, 160
EM_ROUNDS, FLOOR = 50, 1e-6


def held_out(key: Column) -> Column:
    """Rows that nothing is learnt from; a null key is not one of them."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def token_blocks(rows: DataFrame) -> DataFrame:
    """Rows (block, ids, held, sizes, vocabulary, tokens) of (id, held, text): for each block the
    hash of each different word, and every document's tokens as numbers of words, with the end
    token after its last word."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, count = TaskContext.get().partitionId(), 0
        docs: list = []
        size = 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                words = (row.text or "").encode().lower().split()
                docs.append((row.id, row.held, words))
                size += len(row.text or "") + 8
                if size > BLOCK_BYTES:
                    yield packed(docs, part << 32 | count)
                    docs, size, count = [], 0, count + 1
        if docs:
            yield packed(docs, part << 32 | count)

    def packed(docs: list, block: int) -> pd.DataFrame:
        number: dict[bytes, int] = {}
        tokens = []
        for _, _, words in docs:
            tokens += [number.setdefault(w, len(number) + 1) for w in words]
            tokens.append(0)
        hashes = np.concatenate([[END], hash_words(list(number))])
        return pd.DataFrame(
            {
                "block": [block],
                "ids": [[d[0] for d in docs]],
                "held": [pack(np.array([d[1] for d in docs]), "u1")],
                "sizes": [pack(np.array([len(d[2]) + 1 for d in docs]), "<u4")],
                "vocabulary": [hashes.tobytes()],
                "tokens": [pack(np.array(tokens), "<u4")],
            }
        )

    schema = "block long, ids array<string>, held binary, sizes binary, vocabulary binary, tokens binary"
    return rows.mapInPandas(cut, schema)


class Block:
    """A block's documents, tokens and different n-grams, in the order in which totals come."""

    def __init__(self, row, tasks: int):
        self.ids = row.ids
        self.held = unpack(row.held, "u1").astype(bool)
        self.sizes = unpack(row.sizes, "<u4").astype(np.int64)
        self.token = unpack(row.tokens, "<u4").astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        vocabulary = np.frombuffer(row.vocabulary, np.uint64)
        first = np.cumsum(self.sizes) - self.sizes
        before = np.roll(self.token, 1)
        before[first] = len(vocabulary)  # the start, as a context only
        self.before = before
        hashes = np.r_[vocabulary, [START]]
        pair = mixed(hashes[before] * np.uint64(0x9E3779B97F4A7C15) + hashes[self.token])
        self.words, self.word = self._dealt(vocabulary, np.arange(len(vocabulary)), tasks, None)
        self.word = self.word[self.token]
        self.pairs, self.pair = self._dealt(pair, slice(None), tasks, BITS)

    @staticmethod
    def _dealt(hashes, of, tasks, bits):
        """Different hashes as (task, key), in order, and the place of each given one."""
        task = hashes % np.uint64(tasks)
        key = hashes if bits is None else (hashes // np.uint64(tasks)) & ((np.uint64(1) << bits) - np.uint64(1))
        if bits is None:
            order = np.lexsort((key, task))
            place = np.empty(len(hashes), np.int64)
            place[order] = np.arange(len(hashes))
            return (task[order], key[order]), place
        joint, place = np.unique(task << bits | key, return_inverse=True)
        return (joint >> bits, joint & ((np.uint64(1) << bits) - np.uint64(1))), place

    def train_counts(self) -> tuple[np.ndarray, np.ndarray]:
        use = ~self.held[self.doc]
        return (
            np.bincount(self.word[use], minlength=len(self.words[0])),
            np.bincount(self.pair[use], minlength=len(self.pairs[0])),
        )

    def own(self, place: np.ndarray) -> np.ndarray:
        """For each token how often its document has the n-gram at that place."""
        _, at, n = np.unique(self.doc * (place.max() + 1) + place, return_inverse=True, return_counts=True)
        return n[at]


def _totals(blocks: DataFrame, tasks: int) -> DataFrame:
    """Rows (block, kind, task, totals, types, tokens): the counts over all training documents of
    the block's n-grams; types and tokens are of the whole task, on one of its rows."""

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                block = Block(row, tasks)
                out = []
                grams = zip("wp", (block.words, block.pairs), block.train_counts())
                for kind, (task, key), count in grams:
                    ends = np.searchsorted(task, np.arange(tasks + 1, dtype=np.uint64))
                    for t, (a, b) in enumerate(zip(ends, ends[1:])):
                        if b > a:
                            out.append((kind, t, row.block, pack_sorted(key[a:b]), pack(count[a:b], "<u4")))
                yield pd.DataFrame(out, columns=["kind", "task", "block", "keys", "counts"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_sorted(k) for k in rows["keys"]]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unpack(c, "<u4") for c in rows["counts"]])
        total = np.bincount(place, counts, len(every)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        return pd.DataFrame(
            {
                "block": rows["block"],
                "kind": rows["kind"],
                "task": rows["task"],
                "totals": [pack(total[place[e - len(k) : e]], "<u8") for e, k in zip(ends, keys)],
                "types": [int((total > 0).sum())] + [0] * (len(rows) - 1),
                "tokens": [int(total.sum())] + [0] * (len(rows) - 1),
            }
        )

    entries = blocks.mapInPandas(sent, "kind string, task int, block long, keys binary, counts binary")
    return entries.groupBy("kind", "task").applyInPandas(
        added, "block long, kind string, task int, totals binary, types long, tokens long"
    )


def _with_counts(row, totals: pd.DataFrame, tasks: int):
    """A block and, for each token, the counts of its word, its pair and its context."""
    block = Block(row, tasks)
    totals = totals.sort_values(["kind", "task"])
    word, pair = (
        np.concatenate([unpack(t, "<u8").astype(np.int64) for t in totals["totals"][totals["kind"] == k]])
        for k in "wp"
    )
    return block, word[block.word], pair[block.pair]


def _context(block: Block, count: np.ndarray, starts: int) -> np.ndarray:
    """Counts of the tokens before: the word's count, or the number of training documents."""
    out = np.roll(count, 1)
    out[np.cumsum(block.sizes) - block.sizes] = starts
    return out


def _buckets(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def _mix_weights(bins: pd.DataFrame, unknown: float) -> np.ndarray:
    """Weights (bucket, model) that make the held-out tokens likeliest; bins hold how many tokens
    have which bucket and probabilities."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    value = lambda x: np.where(x > LOWEST, 0.0, 2.0 ** (-x / STEPS))
    for b in range(BUCKETS):
        mine = bins[bins["bucket"] == b]
        w = np.array([0.3, 0.4, 0.3] if b else [0.0, 0.6, 0.4])
        if len(mine):
            p = np.stack([value(mine["pair"]), value(mine["word"]), np.full(len(mine), unknown)], 1)
            n = mine["n"].to_numpy(float)
            for _ in range(EM_ROUNDS):
                share = w * p
                w = (n / share.sum(axis=1)) @ share / n.sum()
        w = np.maximum(w, FLOOR) * ([1, 1, 1] if b else [0, 1, 1])
        weights[b] = w / w.sum()
    return weights


def score_documents(
    docs: DataFrame,
    held: Column | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score), one per row of
    ``docs``; the model is learnt from the rows that are not ``held``.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, and one end. The base score
    is the add-one unigram's log10 probability, the score the mixture's. Null and empty texts are
    the end alone. Repeated rows count each; a null id is trained on and stays null; other columns
    are not read. Without training documents every word is unknown. An empty table gives no rows.
    """
    key = F.col(id_column)
    rows = docs.select(
        as_text(key).alias("id"), (held_out(key) if held is None else held).alias("held"), F.col(text_column).alias("text")
    )
    blocks = write_through(token_blocks(rows), "blocks")
    size = blocks.agg(F.sum(F.length("tokens"))).first()[0] or 0
    tasks = max(1, math.ceil(size / 2 / TASK_NGRAMS))
    totals = write_through(_totals(blocks, tasks), "totals")
    summed = {
        r["kind"]: r
        for r in totals.groupBy("kind").agg(F.sum("types").alias("v"), F.sum("tokens").alias("n")).collect()
    }
    n, v = (int(summed["w"][c]) if summed else 0 for c in "nv")
    starts = rows.filter(~F.col("held")).count()
    unknown = 1 / (v + 1)
    together = blocks.groupBy("block").cogroup(totals.drop("types", "tokens").groupBy("block"))

    def binned(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        block, word, pair = _with_counts(next(mine.itertuples(index=False)), theirs, tasks)
        own_word, own_pair = block.own(block.word), block.own(block.pair)
        context = _context(block, word, starts)
        own_context = _context(block, own_word, 1)
        use = ~block.held[block.doc]
        rest = np.maximum(context - own_context, 0)[use]
        left = np.maximum(pair - own_pair, 0)[use]
        other = np.maximum(n - block.sizes[block.doc], 1)[use]
        one = np.maximum(word - own_word, 0)[use] / other
        two = left / np.maximum(rest, 1)
        with np.errstate(divide="ignore"):
            places = [np.minimum(np.round(-np.log2(p) * STEPS), LOWEST + 1) for p in (two, one)]
        joint = (_buckets(rest) * 1000 + places[0].astype(np.int64)) * 1000 + places[1].astype(np.int64)
        joint, count = np.unique(joint, return_counts=True)
        return pd.DataFrame(
            {"bucket": joint // 10**6, "pair": joint // 1000 % 1000, "word": joint % 1000, "n": count}
        )

    spread = together.applyInPandas(binned, "bucket long, pair long, word long, n long")
    # As many rows as there are buckets and bins at most, whatever the corpus.
    bins = spread.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).toPandas()
    weights = _mix_weights(bins, unknown)

    def scored(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        block, word, pair = _with_counts(next(mine.itertuples(index=False)), theirs, tasks)
        context = _context(block, word, starts)
        w = weights[_buckets(context)]
        mix = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(n, 1) + w[:, 2] * unknown
        first = np.cumsum(block.sizes) - block.sizes
        return pd.DataFrame(
            {
                "id": pd.Series(list(block.ids), dtype=object),
                "held_out": block.held,
                "n_tokens": block.sizes,
                "n_known": np.add.reduceat((word > 0).astype(np.int64), first),
                "train_tokens": n,
                "base_score": np.add.reduceat(np.log10((word + 1) / (n + v + 1)), first),
                "score": np.add.reduceat(np.log10(mix), first),
            }
        )

    schema = (
        "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double"
    )
    out = together.applyInPandas(scored, schema)
    return out.withColumn("id", F.col("id").cast(docs.schema[id_column].dataType)).withColumnRenamed("id", id_column)
