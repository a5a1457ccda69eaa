"""Near-duplicate lines by an exact set-similarity join.

A line's tokens are its word shingles, ordered by hash with the most frequent ones last: those of
cells that are used often in a table of counters over the first tokens of all lines. Two lines with
Jaccard similarity of at least ``threshold`` share a token among the first
``floor((1 - threshold) * n) + 1`` of each, their lengths differ by no more than the threshold, the
shared token stands where enough tokens remain, and sketches of 128 bits differ in no more bits than
the sets may in tokens. Only pairs that pass all of this are verified. Equal lines count as their
first. The few lines of most tokens all meet; where many share one, each meets the first of them, and
only a line that matches nothing so far meets the others before it.

All of it is DataFrame operations.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subloom.llm.words import BREAKS, SHINGLE, let
from subloom.operators.skew import checked_broadcast
from subloom.session import materialize, write_through

# Counters of tokens; a cell is frequent from 16 times their mean on, and from twice this number.
CELLS, FEW = 1 << 16, 512
# Up to so many tokens or names are broadcast: one long each, some 64 MB.
BROADCAST_LONGS = 2_000_000
# Lines of a shared token that meet one another at once; of more, the first one is met first.
SHORT = 100
LINE = ["doc", "row", "line"]


def _lines(docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Rows (doc, row, line, name, text) of lines with words: ``row`` tells rows of one id apart by
    their text, ``name`` is a hash of the line as it stands, which costs no words. Texts that are not
    among ``rows``, if given, are not split."""
    text = F.coalesce("text", F.lit(""))
    # The hash is made before the lines are listed, once for a document.
    docs = docs.select("doc", F.xxhash64(text).alias("row"), text.alias("text"))
    if rows is not None:
        docs = docs.join(checked_broadcast(rows, BROADCAST_LONGS), "row", "left_semi")
    lines = docs.select("doc", "row", F.posexplode_outer(F.split("text", "\n")).alias("line", "text"))
    return lines.filter(F.btrim("text", F.lit(" " + BREAKS)) != "").withColumn("name", F.xxhash64("text"))


def _word_keys(text: Column) -> Column:
    """The words of a line as ``word_list`` gives them, but URL-encoded: equal keys are equal words.
    Encoded text is ASCII, where lower case concerns A-Z alone and costs a fraction of ``translate``."""
    plain = F.url_encode(text)
    for space in "\t\x0b\x0c\r":
        plain = F.replace(plain, F.lit(f"%{ord(space):02X}"), F.lit("+"))
    return F.array_remove(F.split(F.lower(plain), r"\+"), "")


def _tokens(words: Column) -> Column:
    """Different hashes of the five-word runs of a line with words; of all its words together if
    they are fewer. A run is named by the hashes of its words, each made once."""

    def runs(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - SHINGLE)
        each = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))
        return F.when(F.size(h) >= SHINGLE, each).otherwise(F.array(F.xxhash64(h)))

    return F.array_distinct(let(F.transform(words, lambda w: F.xxhash64(w)), runs))


def _cell(token: Column) -> Column:
    return F.pmod(token, F.lit(CELLS)).cast("int")


def _with_tokens(lines: DataFrame) -> DataFrame:
    """Lines with their tokens in the order of their hashes, in place of the text."""
    tokens = F.sort_array(_tokens(_word_keys(F.col("text"))))
    return lines.select(*LINE, "name", tokens.alias("tokens"))


def _only(lines: DataFrame, names: DataFrame) -> DataFrame:
    return lines.join(checked_broadcast(names, BROADCAST_LONGS), "name", "left_semi")


def _counts(sets: DataFrame, column: str) -> dict[int, int]:
    """How often the tokens of each cell are used: a table of fixed size."""
    # For a plain explode Spark would filter the arrays first, and make them once more for that.
    cells = sets.select(F.explode_outer(column).alias("token")).groupBy(_cell(F.col("token")).alias("cell"))
    return {r["cell"]: r["n"] for r in cells.agg(F.count(F.lit(1)).alias("n")).collect()}


def _octaves(counts: dict[int, int], level: float) -> Callable[[Column], Column] | None:
    """How often a token's cell is used, in octaves above the level, from a constant of fixed size;
    None if no cell is frequent."""
    each = [min(31, max(0, math.floor(math.log2(counts.get(c, 1) / level)))) for c in range(CELLS)]
    table = F.split(F.lit(",".join(map(str, each))), ",").cast("array<int>")
    return (lambda token: F.coalesce(F.get(table, _cell(token)), F.lit(0))) if any(each) else None


def _sketch(tokens: Column) -> Column:
    """64 bits, each the parity of the number of tokens that fall on it."""

    def flipped(bits: Column, token: Column) -> Column:
        place = token.bitwiseAND(F.lit(63)).cast("int")
        return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))

    return F.aggregate(tokens, F.lit(0).cast("long"), flipped)


def _prefixed(sets: DataFrame, percent: int, octave: Callable[[Column], Column] | None = None) -> DataFrame:
    """Lines with the number of their tokens, their sketch and the first tokens in place of all."""
    tokens = F.col("tokens")
    if octave:
        ranked = F.sort_array(F.transform(tokens, lambda t: F.struct(octave(t).alias("o"), t.alias("t"))))
        tokens = F.transform(ranked, lambda x: x["t"])
    size = F.expr(f"size(tokens) - (size(tokens) * {percent} + 99) div 100 + 1").cast("int")
    # Tokens are sorted: the left half of a sketch is that of the negative ones, and each token is
    # taken up once. Steps of their own keep compiled what stands beside a sketch's lambda.
    zero = F.lit(0).cast("long")
    below = F.array_position(F.sort_array(F.array_append("tokens", zero)), zero) - 1
    halves = {
        "left": F.slice("tokens", F.lit(1), F.col("below")),
        "right": F.slice("tokens", F.col("below") + 1, F.size("tokens")),
    }
    return (
        sets.withColumns({"prefix": F.slice(tokens, F.lit(1), size), "below": below.cast("int")})
        .select(*LINE, "name", *[half.alias(side) for side, half in halves.items()], "prefix")
        .select(
            *LINE,
            "name",
            (F.size("left") + F.size("right")).alias("n"),
            _sketch(F.col("left")).alias("left"),
            _sketch(F.col("right")).alias("right"),
            "prefix",
        )
    )


def _sets(lines: DataFrame, percent: int) -> DataFrame:
    """Stored prefixes of all lines. Only those lines are made again, with frequent tokens last, that
    have one in their prefix; the order of all others' first tokens is the same."""
    by_hash = write_through(_prefixed(_with_tokens(lines), percent), "lines")
    counts = _counts(by_hash, "prefix")
    level = max(FEW, 8 * sum(counts.values()) / CELLS)
    octave = _octaves(counts, level)
    # Copies of a line are one line: what only they make frequent is not.
    counts = counts if octave is None else _by_line(by_hash, octave)
    octave = _octaves(counts, level)
    if octave is None:
        return by_hash
    # What else is frequent in these lines would come first in their next prefixes.
    some = _only(lines, _names(by_hash, octave)).dropDuplicates(["name"])
    more = _counts(_with_tokens(some), "tokens")
    octave = _octaves({c: max(counts.get(c, 1), more.get(c, 1)) for c in range(CELLS)}, level)
    again = _prefixed(_with_tokens(_only(lines, _names(by_hash, octave))), percent, octave)
    return by_hash.filter(~_frequent(octave)).unionByName(write_through(again, "lines"))


def _by_line(sets: DataFrame, octave: Callable[[Column], Column]) -> dict[int, int]:
    """How often different lines use the frequent cells in their prefixes."""
    often = F.filter("prefix", lambda token: octave(token) > 0)
    used = sets.filter(_frequent(octave)).select("name", often.alias("often")).distinct()
    return _counts(used, "often")


def _frequent(octave: Callable[[Column], Column]) -> Column:
    return F.exists("prefix", lambda token: octave(token) > 0)


def _names(by_hash: DataFrame, octave: Callable[[Column], Column]) -> DataFrame:
    return materialize(by_hash.filter(_frequent(octave)).select("name").distinct())


def _shared(prefixes: DataFrame) -> DataFrame:
    """Those that different sets have in their prefixes, once for each set."""
    both = prefixes.groupBy("token").agg(F.min("name").alias("lo"), F.max("name").alias("hi"))
    tokens = materialize(both.filter("lo <> hi").select("token"))
    met = prefixes.join(checked_broadcast(tokens, BROADCAST_LONGS), "token", "left_semi")
    return met.groupBy("token", "name").agg(*[F.min(c).alias(c) for c in ("n", "pos", "left", "right")])


def _matches(one: Column, other: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(one, other))
    return both * 100 >= (F.size(one) + F.size(other) - both) * percent


def _may_match(a: str, b: str, percent: int) -> Column:
    """Length filter and positional filter of a shared token at places ``pos`` (from 0); and each bit
    in which the sketches differ stands for a token that is in one set alone."""
    na, nb, pa, pb = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (a, b))
    most = F.least(na - pa, nb - pb)
    bits = sum(F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in ("left", "right"))
    return (
        (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)
        & (most * (100 + percent) >= (na + nb) * percent)
        & (bits * (100 + percent) <= (na + nb) * (100 - percent))
    )


def repeated_lines(
    docs: DataFrame,
    threshold: float = 0.75,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Rows (doc, row, line): lines that match an earlier line, in order of (id, hash of the row's
    text, line number). Lines match when the Jaccard similarity of their sets of five-word
    shingles (all words together if there are fewer) is at least ``threshold``. Lines without
    words match nothing."""
    rows = docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text"))
    percent = round(threshold * 100)
    # Only prefixes are stored; the tokens of a line that is to be verified are made again.
    sets = _sets(_lines(rows), percent)
    # Equal lines: all but the first match it.
    line = F.struct(*LINE)
    firsts = materialize(sets.groupBy("name").agg(F.min(line).alias("first"), F.count(F.lit(1)).alias("k")))
    copies = (
        sets.select(line.alias("e"), "name")
        .join(firsts.filter("k > 1"), "name")
        .filter(~F.col("e").eqNullSafe(F.col("first")))
        .select("e.*")
    )
    prefixes = sets.select("name", "n", "left", "right", F.posexplode("prefix").alias("pos", "token"))
    entries = _shared(prefixes).join(firsts.drop("k"), "name")
    lists = write_through(entries.select("token", F.struct("first", "name", "n", "pos", "left", "right").alias("e")), "lists")
    later = _later(lists, rows, firsts, percent).withColumnRenamed("a", "name")
    return copies.unionByName(firsts.join(later, "name", "left_semi").select("first.*"))


def _later(lists: DataFrame, docs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """The names ``a`` of lines that match the first line of another name before them."""
    sizes = lists.groupBy("token").agg(F.count(F.lit(1)).alias("k"))
    long = materialize(sizes.filter(F.col("k") > SHORT).select("token"))
    if long.isEmpty():
        return _verified(_pairs(lists, percent).distinct(), docs, firsts, percent)
    long = checked_broadcast(long, BROADCAST_LONGS)
    short, lists = lists.join(long, "token", "left_anti"), lists.join(long, "token", "left_semi")
    # Each token knows the first line that has it, other lines are behind that.
    heads = lists.groupBy("token").agg(F.min("e").alias("head"))
    behind = write_through(lists.join(heads, "token").filter("e.name <> head.name"), "behind")
    to_head = behind.filter(_may_match("e", "head", percent)).select(
        F.col("e.name").alias("a"), F.col("head.name").alias("b")
    )
    pairs = _pairs(short, percent).unionByName(to_head).distinct()
    matched = materialize(_verified(pairs, docs, firsts, percent))
    waiting = behind.select("token", F.col("e").alias("later"), F.col("e.name").alias("a"))
    open_ = waiting.join(matched, "a", "left_anti").drop("a")
    rest = (
        behind.select("token", "e")
        .join(open_, "token")
        .filter(_may_match("later", "e", percent))
        .filter("e.first < later.first")
        .select(F.col("later.name").alias("a"), F.col("e.name").alias("b"))
    )
    return matched.unionByName(_verified(rest.distinct(), docs, firsts, percent))


def _pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a later and an earlier line of one list that may match."""
    both = lists.alias("x").join(lists.alias("y"), F.col("x.token") == F.col("y.token"))
    met = both.filter(_may_match("x.e", "y.e", percent)).filter("x.e.first < y.e.first")
    return met.select(F.col("y.e.name").alias("a"), F.col("x.e.name").alias("b"))


def _verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """The names ``a`` of different pairs (a, b) whose token sets are similar enough. The tokens are made again,
    from the texts that have a first line of these names."""
    pairs = materialize(pairs)
    names = materialize(pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct())
    rows = materialize(_only(firsts, names).select("first.row").distinct())
    made = _with_tokens(_only(_lines(docs, rows), names)).select("name", "tokens")
    once = materialize(made.dropDuplicates(["name"]))
    mine = once.select(F.col("name").alias("a"), F.col("tokens").alias("mine"))
    theirs = once.select(F.col("name").alias("b"), F.col("tokens").alias("theirs"))
    both = pairs.join(mine, "a").join(theirs, "b")
    return both.filter(_matches(F.col("mine"), F.col("theirs"), percent)).select("a").distinct()


def line_dedup(
    docs: DataFrame,
    threshold: float = 0.75,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``docs`` with the repeated lines (see ``repeated_lines``) taken out of each text, and the
    columns n_lines and n_removed, which replace columns of those names.

    The first of matching lines stays, blank lines stay, and a document keeps its row when all
    its lines go. A null text stays null and has no lines. Rows that repeat an id and its text are
    treated alike. All other columns stay, whatever their names (but for ``__doc``, ``__of``,
    ``__row`` and ``__gone``). An empty table gives no rows.
    """
    gone = materialize(repeated_lines(docs, threshold, id_column, text_column))
    per_doc = gone.groupBy(F.col("doc").alias("__doc"), F.col("row").alias("__of")).agg(
        F.collect_set("line").alias("__gone")
    )
    if gone.count() <= BROADCAST_LONGS:  # then texts stay where they are
        per_doc = F.broadcast(per_doc)
    marked = docs.drop("n_lines", "n_removed").withColumn(
        "__row", F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))
    )
    on = F.col(id_column).eqNullSafe(F.col("__doc")) & (F.col("__row") == F.col("__of"))
    text = F.col(text_column)
    # The text is split once, and only if a line goes.
    stays = lambda piece, i: ~F.array_contains("__gone", i)
    kept = F.array_join(F.filter(F.split(text, "\n"), stays), "\n")
    breaks = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return (
        marked.join(per_doc, on, "left")
        .withColumns(
            {
                text_column: F.when(F.col("__gone").isNull(), text).otherwise(kept),
                "n_lines": F.when(text.isNull(), 0).otherwise(breaks + 1),
                "n_removed": F.coalesce(F.size("__gone"), F.lit(0)),
            }
        )
        .drop("__doc", "__of", "__row", "__gone")
    )
