"""Secrets in documents, found by a trigram inverted index.

Every rule is a regular expression. From its parts that any match must spell out, ``trigram_query``
derives a Boolean query: at least one of several sets of trigrams must be present. ``build_index``
stores, for blocks of documents, which documents hold each trigram. ``candidates`` reads only the
postings of the rules' trigrams, intersects them block by block and names the documents that may
match; ``find_secrets`` verifies those with the rules themselves. Rules without a mandatory trigram
(long hexadecimal runs) scan every text. An index is built once and serves any later rules.

Trigrams are taken over bytes folded to 64 classes (either case alike), so a query may let a
document through in vain, but never misses one. Texts are not shuffled: postings and the ids of
candidates are, and the texts of candidates if they are too many to broadcast their ids.
"""

from __future__ import annotations

import json
import re
import re._parser as regex_parts
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subloom.llm.words import as_text
from subloom.operators.skew import checked_broadcast
from subloom.session import materialize, write_through


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters; shorter matches are dropped after they
    have been passed over."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# Kinds in the order in which spans at one place are listed.
RULES = (
    Rule(
        "assign",
        "(" + either_case("password|passwd|secret|token|api_?key") + ")"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
    ),
    Rule("access", "AKIA[A-Z0-9]+", least=18),
    Rule("hex", "[0-9a-f]+", least=16),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("gitlab", "glpat-[A-Za-z0-9_-]+", least=26),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("google", "AIza[A-Za-z0-9_-]+", least=39),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]+", least=24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("url", r"://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@"),
)

# A block ends at so many bytes of text or documents; local numbers fit in 13 bits.
BLOCK_BYTES = 4_000_000
BLOCK_DOCS = 8_192
# Alternatives of one query; beyond that it is weakened, never wrong.
ALTERNATIVES = 64
# The row of a block that lists its documents stands at this code.
LISTED = -1


def _folding() -> np.ndarray:
    """Class of each byte value: white space and controls, letters, digits, punctuation; rare
    punctuation shares one class, and so does everything beyond ASCII."""
    fold = np.zeros(256, np.uint32)
    rare = "\\^`{|}~"
    shown = [chr(c) for c in range(33, 127) if not chr(c).isupper() and chr(c) not in rare]
    for i, c in enumerate(shown):
        fold[ord(c)] = fold[ord(c.upper())] = i + 1
    fold[[ord(c) for c in rare]] = len(shown) + 1
    fold[128:] = len(shown) + 2
    return fold


FOLD = _folding()
ANY = frozenset([frozenset()])


def trigrams(data: bytes) -> np.ndarray:
    """The folded trigram at each place, in 18 bits."""
    c = FOLD[np.frombuffer(data, np.uint8)]
    return c[:-2] << np.uint32(12) | c[1:-1] << np.uint32(6) | c[2:]


def trigram_query(pattern: str) -> frozenset[frozenset[int]]:
    """Sets of trigram codes, one of which every matching text holds whole; an empty set among
    them means that there is no mandatory trigram."""
    strings, query = _sequence(regex_parts.parse(pattern))
    return query if strings is None else _spelt(strings)


def _least(query: set[frozenset[int]]) -> frozenset[frozenset[int]]:
    """Without alternatives that ask for more than another one does."""
    return frozenset(q for q in query if not any(p < q for p in query))


def _both(a, b):
    made = _least({p | q for p in a for q in b})
    return made if len(made) <= ALTERNATIVES else min(a, b, key=len)


def _spelt(strings: set[bytes]) -> frozenset[frozenset[int]]:
    return _least({frozenset(trigrams(s).tolist()) for s in strings})


def _sequence(items) -> tuple[set[bytes] | None, frozenset]:
    """The strings that a sequence of parts can be, if they are few, else None and its query."""
    now, query, whole = {b""}, ANY, True
    for item in items:
        strings, inner = _part(*item)
        if strings is not None and len(now) * len(strings) <= ALTERNATIVES:
            now = {a + b for a in now for b in strings}
            continue
        whole = False
        query = _both(_both(query, _spelt(now)), inner)
        now = {b""} if strings is None else strings
    return (now, ANY) if whole else (None, _both(query, _spelt(now)))


def _part(op, arg) -> tuple[set[bytes] | None, frozenset]:
    if op is regex_parts.LITERAL:
        return {chr(arg).encode("utf-8", "surrogatepass").lower()}, ANY
    if op is regex_parts.IN:
        chars = {chr(a).encode().lower() for kind, a in arg if kind is regex_parts.LITERAL}
        return (chars, ANY) if all(k is regex_parts.LITERAL for k, _ in arg) else (None, ANY)
    if op is regex_parts.SUBPATTERN:
        return _sequence(arg[-1])
    if op is regex_parts.BRANCH:
        ways = [_sequence(branch) for branch in arg[1]]
        if all(strings is not None for strings, _ in ways):
            return set().union(*(strings for strings, _ in ways)), ANY
        queries = [q if s is None else _spelt(s) for s, q in ways]
        return None, _least(set().union(*queries))
    if op in (regex_parts.MAX_REPEAT, regex_parts.MIN_REPEAT):
        fewest, most, inner = arg
        strings, query = _sequence(inner)
        if fewest == 0:
            return ({b"", *strings}, ANY) if most == 1 and strings is not None else (None, ANY)
        if fewest == most == 1:
            return strings, query
        return None, query if strings is None else _spelt(strings)
    if op is regex_parts.AT:
        return {b""}, ANY
    return None, ANY


def _pack(local: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Ascending local numbers of each posting as gaps: one byte below 128, else two."""
    gaps = np.diff(local, prepend=0)
    gaps[starts] = local[starts]
    wide = gaps >= 128
    at = np.cumsum(1 + wide) - 1 - wide
    out = np.empty(len(gaps) + int(wide.sum()), np.uint8)
    out[at] = np.where(wide, 128 | gaps & 127, gaps)
    out[at[wide] + 1] = gaps[wide] >> 7
    data, cut = out.tobytes(), [*at[starts].tolist(), len(out)]
    return [data[a:b] for a, b in zip(cut, cut[1:])]


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    wide = raw >= 128  # first bytes only: a second one is at most 63
    gaps = np.where(wide, (raw & 127) | np.append(raw[1:], 0) << 7, raw)
    return np.cumsum(gaps[np.append(True, ~wide[:-1])])


def _postings(texts: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Trigram codes of a block in order, and the local numbers of the texts that hold each."""
    size = np.array([len(t) for t in texts], np.int64)
    codes = trigrams(b"".join(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.uint32), size)[: len(codes)]
    inside = np.repeat(np.cumsum(size), size)[: len(codes)] - np.arange(len(codes)) >= 3
    key = np.sort(codes[inside] << np.uint32(13) | owner[inside])
    key = key[np.diff(key, prepend=np.uint32(2**32 - 1)) != 0]
    if len(key) == 0:
        return [], []
    code = key >> np.uint32(13)
    starts = np.flatnonzero(np.diff(code, prepend=np.uint32(2**32 - 1)) != 0)
    return code[starts].tolist(), _pack((key & np.uint32(8191)).astype(np.int64), starts)


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A stored table (block, code, docs): postings of every trigram of every whole text, by
    blocks, and per block one row that lists its documents' ids. Nothing is shuffled. Null texts
    hold no trigram; an empty table gives an empty index."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def block() -> pd.DataFrame:
            codes, docs = _postings(texts)
            listed = zlib.compress(json.dumps(ids).encode(), 1)
            return pd.DataFrame(
                {"block": number, "code": [LISTED, *codes], "docs": [listed, *docs]}
            )

        for batch in batches:
            for key, text in zip(batch["id"], batch["text"]):
                data = (text or "").encode()
                if ids and (size + len(data) > BLOCK_BYTES or len(ids) == BLOCK_DOCS):
                    yield block()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(key)
                texts.append(data)
                size += len(data)
        if ids:
            yield block()

    rows = docs.select(as_text(F.col(id_column)).alias("id"), F.col(text_column).alias("text"))
    return write_through(rows.mapInPandas(blocks, "block long, code int, docs binary"), "trigrams")


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows (id as text, rules as a bit mask) of the documents whose trigrams satisfy the query of
    at least one rule; rules that have no mandatory trigram are not looked up."""
    queries = [trigram_query(rule.pattern) for rule in rules]
    wanted = {i: [sorted(q) for q in query] for i, query in enumerate(queries) if query != ANY}
    codes = sorted({c for query in wanted.values() for q in query for c in q})

    def look_up(rows: pd.DataFrame) -> pd.DataFrame:
        held = dict(zip(rows["code"].tolist(), rows["docs"]))
        ids = json.loads(zlib.decompress(held.pop(LISTED)))
        postings = {code: _unpack(data) for code, data in held.items()}
        mask = np.zeros(len(ids), np.int64)
        for i, query in wanted.items():
            for q in query:
                if all(code in postings for code in q):
                    lists = sorted((postings[code] for code in q), key=len)
                    both = reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), lists)
                    mask[both] |= 1 << i
        found = np.flatnonzero(mask)
        names = pd.Series([ids[i] for i in found], dtype=object)
        return pd.DataFrame({"id": names, "rules": mask[found]})

    rows = index.filter(F.col("code").isin([LISTED, *codes]))
    found = rows.groupBy("block").applyInPandas(look_up, "id string, rules long")
    return found.groupBy("id").agg(F.bit_or("rules").alias("rules"))


SPANS = "array<struct<start:int,rank:int,stop:int>>"


def _matches(text: str, rule: Rule, rank: int, compiled: re.Pattern) -> list[tuple[int, int, int]]:
    return [
        (m.start(), rank, m.end())
        for m in compiled.finditer(text)
        if m.end(rule.group) - m.start(rule.group) >= rule.least
    ]


def _quick(rule: Rule) -> str:
    """One class repeated: its runs are the matches, so the length may be asked for at once."""
    simple = re.fullmatch(r"(\[[^\]\\]+\])\+", rule.pattern)
    return f"{simple[1]}{{{rule.least},}}" if simple else rule.pattern


def find_secrets(
    docs: DataFrame,
    index: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Rows (id, spans), one per row of ``docs``: ``spans`` lists (start, kind, stop) in code
    points, by start and then by the order of ``rules`` (63 at most). Matches of one kind are the
    leftmost ones that do not overlap; spans of different kinds may.

    ``index`` is one that ``build_index`` made of these documents. Null and empty texts have no
    spans. Repeated rows are listed each, with the same spans; rows that share an id are told
    apart by their texts; a null id stays null. Other columns are not read. An empty table gives
    no rows.
    """
    if index is None:
        index = build_index(docs, id_column, text_column)
    rows = docs.select(
        as_text(F.col(id_column)).alias("id"),
        F.xxhash64(text_column).alias("mark"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    scanned = [i for i, rule in enumerate(rules) if frozenset() in trigram_query(rule.pattern)]
    every = sum(1 << i for i in scanned)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [re.compile(_quick(rule), re.ASCII) for rule in rules]
        for batch in batches:
            spans = [
                [
                    dict(zip(("start", "rank", "stop"), m))
                    for i, rule in enumerate(rules)
                    if mask >> i & 1
                    for m in _matches(text, rule, i, compiled[i])
                ]
                for text, mask in zip(batch["text"], batch["rules"])
            ]
            yield batch[["id", "mark"]].assign(spans=pd.Series(spans, batch.index, dtype=object))

    shape = f"id string, mark long, spans {SPANS}"
    likely = materialize(candidates(index, rules)).withColumnRenamed("id", "its_id")
    on = F.col("id").eqNullSafe(F.col("its_id"))
    verified = (
        rows.join(checked_broadcast(likely), on)
        .select("id", "mark", "text", "rules")
        .mapInPandas(verify, shape)
        .filter(F.size("spans") > 0)
        .groupBy(F.col("id").alias("its_id"), F.col("mark").alias("its_mark"))
        .agg(F.any_value("spans").alias("found"))
    )
    whole = rows.withColumn("rules", F.lit(every)).mapInPandas(verify, shape)
    found = checked_broadcast(materialize(verified))
    on &= F.col("mark") == F.col("its_mark")
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    spans = F.array_sort(F.concat("spans", F.coalesce("found", F.array().cast(SPANS))))
    named = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.get(kinds, s["rank"]).alias("kind"), s["stop"].alias("stop")
        ),
    )
    kind = docs.schema[id_column].dataType
    return whole.join(found, on, "left").select(
        F.col("id").cast(kind).alias(id_column), named.alias("spans")
    )


def spans_text(spans) -> F.Column:
    """``kind:start:stop``, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ","
    )
