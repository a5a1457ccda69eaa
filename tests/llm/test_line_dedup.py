"""Lines with frequent shingles: what is verified, and that no match is lost."""

import random

import pytest

from subloom.llm import line_dedup
from subloom.llm.words import word_list


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return 100 * len(a & b) >= 75 * len(a | b) and bool(a) and bool(b)


def half_alike():
    """Families of which each line shares about half of its shingles with the others, and some lines
    that match one."""
    r = random.Random(3)
    word = lambda: f"w{r.randrange(10**6)}"
    lines = []
    for _ in range(20):
        stem = [word() for _ in range(30)]
        family = [[*stem, *(word() for _ in range(15))] for _ in range(6)]
        lines += [" ".join(x) for x in family]
        lines.append(" ".join([*family[0][:-1], word()]).upper())
    r.shuffle(lines)
    return lines


@pytest.mark.parametrize("few, cells", [(512, 1 << 16), (1, 32)])
def test_few_pairs_are_verified(spark, monkeypatch, few, cells):
    monkeypatch.setattr(line_dedup, "FEW", few, raising=False)
    monkeypatch.setattr(line_dedup, "CELLS", cells)
    sizes, verified = [], line_dedup._verified

    def counted(pairs, *more):
        sizes.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(line_dedup, "_verified", counted)
    lines = half_alike()
    docs = spark.createDataFrame([(i // 4, "\n".join(lines[i : i + 4])) for i in range(0, len(lines), 4)], "doc_id long, text string")
    got = {(r.doc, r.line) for r in line_dedup.repeated_lines(docs).collect()}
    sets = [shingles(x) for x in lines]
    want = {(i // 4, i % 4) for i in range(len(lines)) if any(alike(sets[i], sets[j]) for j in range(i))}
    assert got == want and len(want) >= 20
    assert sum(sizes) < 4 * len(want)  # some 300 pairs share first shingles


def test_copies_make_no_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FEW", 8)
    r = random.Random(4)
    lines = [" ".join(f"w{r.randrange(10**6)}" for _ in range(12)) for _ in range(5)]
    docs = spark.createDataFrame([(i, lines[i % 2]) for i in range(60)] + [(60 + i, x) for i, x in enumerate(lines)], "doc long, text string")
    counted, counts = [], line_dedup._counts

    def noted(sets, column):
        counted.append((column, sets.count()))
        return counts(sets, column)

    monkeypatch.setattr(line_dedup, "_counts", noted)
    rows = line_dedup._sets(line_dedup._lines(docs), 75).collect()
    assert len(rows) == 65 and len({x.name for x in rows}) == 5
    assert counted == [("prefix", 65), ("often", 2)]  # all tokens of all 62 copies before


def test_frequent_tokens_are_counted_once_a_line(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FEW", 2)
    r = random.Random(6)
    word = lambda: f"w{r.randrange(10**6)}"
    stem = [word() for _ in range(20)]
    lines = [" ".join([*stem, *(word() for _ in range(2))]) for _ in range(12)]
    docs = spark.createDataFrame([(i, lines[i % 12]) for i in range(120)], "doc_id long, text string")
    counted, counts = [], line_dedup._counts

    def noted(sets, column):
        counted.append((column, sets.count()))
        return counts(sets, column)

    monkeypatch.setattr(line_dedup, "_counts", noted)
    got = {(x.doc, x.line) for x in line_dedup.repeated_lines(docs).collect()}
    assert got == {(i, 0) for i in range(1, 120)}  # 16 of 20 shingles are shared
    assert dict(counted)["tokens"] == 12  # 120 before


def test_texts_without_candidates_are_not_split_again(spark, monkeypatch):
    lines = half_alike()
    r = random.Random(5)
    others = [(1000 + i, " ".join(f"v{r.randrange(10**6)}" for _ in range(20))) for i in range(300)]
    docs = spark.createDataFrame([*enumerate(lines), *others], "doc_id long, text string")
    listed, made = [], line_dedup._with_tokens

    def noted(rows):
        listed.append(rows.count())
        return made(rows)

    split, lines_of = [], line_dedup._lines

    def counted(*args):
        out = lines_of(*args)
        split.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "_with_tokens", noted)
    monkeypatch.setattr(line_dedup, "_lines", counted)
    got = {x.doc for x in line_dedup.repeated_lines(docs).collect()}
    sets = [shingles(x) for x in lines]
    assert got == {i for i in range(len(lines)) if any(alike(sets[i], sets[j]) for j in range(i))}
    assert split[0] == len(lines) + 300 and len(split) > 1 and max(split[1:]) < 100  # all of them before


@pytest.mark.parametrize("short", [0, 3, 100])
def test_short_and_long_lists_lose_no_match(spark, monkeypatch, short):
    monkeypatch.setattr(line_dedup, "SHORT", short, raising=False)
    lines = half_alike()
    docs = spark.createDataFrame([*enumerate(lines)], "doc_id long, text string")
    joined, verified = [], line_dedup._verified

    def counted(*args):
        joined.append(args[0])
        return verified(*args)

    monkeypatch.setattr(line_dedup, "_verified", counted)
    got = {x.doc for x in line_dedup.repeated_lines(docs).collect()}
    sets = [shingles(x) for x in lines]
    assert got == {i for i in range(len(lines)) if any(alike(sets[i], sets[j]) for j in range(i))}
    assert len(joined) == (2 if short < 100 else 1)  # two rounds whatever the lists before


def test_word_keys_tell_words_apart(spark):
    texts = ["A b\tC", "a B c", "a+b c", "a%09b", "a%2Bb", "\u00c9t\u00e9 \u00e9T\u00e9", "\u00c9T\u00e9", "\u00e9t\u00e9", "\U0001f600 x", "a\x0bb\x0cc\rd", "\u00a0 \u2003", "* . - _ ~", "\u0130 i\u0307"]
    frame = spark.createDataFrame([(x,) for x in texts], "text string")
    from pyspark.sql import functions as F

    rows = frame.select(line_dedup._word_keys(F.col("text")).alias("got"), word_list(F.col("text")).alias("want")).collect()
    pairs = {(g, w) for r in rows for g, w in zip(r.got, r.want, strict=True)}
    assert len(pairs) == len({g for g, _ in pairs}) == len({w for _, w in pairs})
