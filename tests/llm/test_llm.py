"""The operators against plain versions on small tables with nulls, ties, copies and long texts."""

import collections
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from subloom.llm import decontamination, exact_dedup, jaccard_join, line_dedup, lm_scoring, packing
from subloom.llm import preference, repeats, token_counts, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n long, line string, doc string, token string, id string"


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    base = [" ".join(word() for _ in range(r.randint(1, 90))) for _ in range(40)]
    passage = " ".join(word() for _ in range(70))
    texts = base + base[:6] + [t.upper() for t in base[:4]]
    texts += [f"{base[i]} {passage}\n{base[i + 1]}" for i in range(8)]
    texts += [" ".join(["changed"] + t.split()[1:]) for t in base[:12]]
    texts += ["", None, " \n\t", "one", "a b c d", " ".join(word() for _ in range(20_000)), "x" * 5_000]
    return [(2**60 + i, t) for i, t in enumerate(texts)] + [(2**60, base[0])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "l", "d", "t", "x") for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def with_null_id(spark, docs):
    return docs.unionByName(spark.createDataFrame([(None, "a null id", 1, "", "", "", "")], SCHEMA))


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def alike(a, b):
    return 100 * len(a & b) >= 75 * len(a | b) and bool(a) and bool(b)


@pytest.mark.parametrize("sets", [1_500, 3])
def test_near_duplicates(docs, monkeypatch, sets):
    monkeypatch.setattr(jaccard_join, "REGION_SETS", sets)
    rows = corpus()
    mine = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if alike(mine[i], mine[j]):
                root = [root[j] if x == root[i] else x for x in root]
    least = {}
    for (key, _), x in zip(rows, root):
        least[x] = min(least.get(x, key), key)
    want = sorted((k, len(s), least[x]) for (k, _), s, x in zip(rows, mine, root))
    assert sorted(map(tuple, jaccard_join.near_duplicates(docs).collect())) == want


def test_lines(docs):
    got = collections.Counter((r.doc_id, r.text, r.n_removed) for r in line_dedup.line_dedup(docs).collect())
    rows = list(dict.fromkeys(corpus()))
    lines = [(k, i, shingles(x)) for k, t in rows for i, x in enumerate((t or "").split("\n"))]
    gone = {(k, i) for k, i, s in lines if any((k2, i2) < (k, i) and alike(s, s2) for k2, i2, s2 in lines)}
    for key, text in rows:
        split = (text or "").split("\n")
        kept = "\n".join(x for i, x in enumerate(split) if (key, i) not in gone)
        n = sum((key, i) in gone for i in range(len(split)))
        assert got[(key, text if text is None else kept, n)] >= 1


def test_lines_keep_other_columns(spark):
    shape = "doc_id long, text string, doc string, row int, gone string, line int, name string, n_lines string"
    rows = [(i, t, f"d{i}", i, "g", 7, "n", "x") for i, t in enumerate(["a b c\nA  b c", None, "q\na b c", ""])]
    rows += [rows[2], (None, "q", "d", 0, "g", 7, "n", "x")]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, shape))
    assert set(out.columns) == {"doc_id", "text", "doc", "row", "gone", "line", "name", "n_lines", "n_removed"}
    got = sorted((str(r.doc_id), str(r.text), r.doc, r.row, r.gone, r.line, r.name, r.n_removed) for r in out.collect())
    want = [("0", "a b c"), ("1", "None"), ("2", ""), ("2", ""), ("3", ""), ("None", "q")]
    assert [g[:2] for g in got if g[0] != "None" and g[0] != "2"] == [w for w in want if w[0] not in ("None", "2")]
    assert all(g[2:7] == (f"d{g[0]}", int(g[0]), "g", 7, "n") for g in got if g[0] != "None") and len(got) == 6


def test_repeats(docs, monkeypatch):
    monkeypatch.setattr(repeats, "BATCH_BYTES", 20_000)
    rows = [(k, (t or "").encode()) for k, t in corpus()]
    seen = collections.Counter(b[i : i + 200] for _, b in rows for i in range(len(b) - 199))
    want = []
    for key, data in rows:
        hit = {j for i in range(len(data) - 199) if seen[data[i : i + 200]] > 1 for j in range(i, i + 200)}
        kept = bytes(x for i, x in enumerate(data) if i not in hit)
        want.append((key, len(data), len(hit), sum(i - 1 not in hit for i in hit), hashlib.sha256(kept).hexdigest()))
    got = repeats.remove_repeats(docs)
    assert sorted(map(tuple, got.drop("spans", "kept").collect())) == sorted(want)


def test_tokens_and_packing(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    want = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in corpus()}
    for r in token_counts.token_counts(docs, VOCABULARY).collect():
        assert r.n_tokens == len(want[r.doc_id])
        assert r.n_bytes in {len((t or "").encode()) for k, t in corpus() if k == r.doc_id}
    pieces = packing.pack_documents(docs, VOCABULARY, 64, with_ids=True).collect()
    by_doc, by_bin = collections.defaultdict(dict), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id][p.piece] = list(p.ids)
        assert (p.start, p.length) == (64 * p.piece, len(p.ids))
        assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p.ids))
        by_bin[p.sequence_id].append((p.offset, p.length))
    assert {k: sum((v[i] for i in sorted(v)), []) for k, v in by_doc.items()} == {k: v + [0] for k, v in want.items()}
    for parts in by_bin.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 64
    # at most one sequence more than no packing can do without
    lengths = [n for parts in by_bin.values() for _, n in parts]
    assert len(by_bin) <= max(-(-sum(lengths) // 64), sum(n > 32 for n in lengths)) + 1


def test_special_pieces():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    texts = ["don't I'LL'S", "<|endoftext|>abc x<|startoftext|>", "aaaaaaa " * 9, "İΣΑΣ 日本 a\x1fb ½² ''s", None, ""]
    for text, ids in zip(texts, token_counts.Encoder(VOCABULARY).texts(texts)):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want


def test_words_are_merged_once_and_pairs_looked_up_where_they_change(monkeypatch):
    from tokenizers import Tokenizer

    merged, looked, merge, ranks = [], [], token_counts.WordBpe.merge, token_counts.WordBpe._ranks
    monkeypatch.setattr(token_counts.WordBpe, "merge", lambda bpe, words: (merged.append(len(words)), merge(bpe, words))[1])
    monkeypatch.setattr(token_counts.WordBpe, "_ranks", lambda bpe, a, b: (looked.append(len(a)), ranks(bpe, a, b))[1])
    r = random.Random(2)
    words = ["".join(r.choice("abcdeéz") for _ in range(r.randint(1, 60))) for _ in range(300)] + ["a" * n for n in range(1, 70)]
    texts = [" ".join(f"{a}{w}{b}" for w in words for a, b in (("", ""), ("", ","), ("(", ")"), ("-", "."))), words[0].upper()]
    library = Tokenizer.from_file(VOCABULARY)
    for text, ids in zip(texts, token_counts.Encoder(VOCABULARY).texts(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want
    kinds = len(set(words)) + 5
    assert sum(merged) <= kinds  # each of some 370 words four times before
    assert sum(looked) <= 4 * sum(len(w.encode()) for w in set(words))


@pytest.mark.parametrize("digest_bytes, copies", [(16, 1_000), (1, 1_000), (16, 1)])
def test_exact(docs, monkeypatch, digest_bytes, copies):
    monkeypatch.setattr(exact_dedup, "COPIES", copies)
    groups = collections.defaultdict(list)
    for key, text in corpus():
        groups[(text or "").encode().lower()].append(key)
    want = [(k, max(v), len(v), k == max(v), hashlib.sha256(t).hexdigest()) for t, v in groups.items() for k in v]
    got = exact_dedup.exact_dedup(docs, digest_bytes=digest_bytes).drop("recipe")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_lm(docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 20_000)
    rows = [(k, (t or "").encode().lower().split() + [None]) for k, t in corpus()]
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    count = collections.Counter(w for k, ws in rows if not held(k) for w in ws)
    for r in lm_scoring.score_documents(docs).collect():
        words = next(ws for k, ws in rows if k == r.doc_id and len(ws) == r.n_tokens)
        assert (r.held_out, r.train_tokens) == (held(r.doc_id), sum(count.values()))
        assert r.n_known == sum(count[w] > 0 for w in words) and r.score < 0
        total, kinds = sum(count.values()), len(count)
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in words)
        assert r.base_score == pytest.approx(base, rel=1e-9)


def test_benchmark(spark, docs):
    rows = corpus()
    items = [(1, rows[3][1]), (2, "not in there at all, never"), (3, "one"), (4, ""), (None, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit("d"))
    want = set()
    for key, text in rows:
        words = (text or "").encode().lower().split()
        for item, t in items[:4]:
            w = t.encode().lower().split()
            n = min(5, len(w))
            runs = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
            here = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
            if runs and 4 * len(runs & here) >= 3 * len(runs):
                want.add((key, item))
    got = decontamination.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_preference(spark):
    turns = [(c, t, r, f"{r}{t}{c if t > 1 else ''}") for c in (1, 2, 3) for t, r in enumerate(("user", "assistant", "user", "assistant"))]
    frame = spark.createDataFrame(turns + [(None, 0, "user", "x"), (4, 0, None, None)], "conv_id long, turn long, role string, text string")
    convs = preference.conversations(frame)
    got = {r.chosen_id: r for r in preference.preference_format(convs, preference.paired_by_opening(convs)).collect()}
    assert set(got) == {1, 3, 4} and got[1].rejected_id == 2 and got[3].rejected_id is None
    assert got[1].n_prompt == 2 and got[3].n_prompt == 3
    for r in got.values():
        for s in r.chosen_spans:
            assert r.chosen[s.start : s.stop].endswith("<|end|>") and r.chosen[: s.start].endswith("<|assistant|>\n")


@pytest.mark.parametrize("blocks", [None, 7])
def test_pairs_of_a_common_opening(spark, blocks):
    ids = random.Random(3).sample(range(10**6), 2_501)
    turns = [(c, t, r, "hello" if t == 0 or c % 3 else f"{c}") for c in ids for t, r in enumerate(("user", "assistant"))]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = preference.paired_by_opening(preference.conversations(frame), *([blocks] if blocks else [])).collect()
    said, ordered = {c: 5 if c % 3 else len(str(c)) for c in ids}, sorted(ids)
    two = [sorted(ordered[i : i + 2], key=lambda c: (-said[c], c)) + [None] for i in range(0, len(ids), 2)]
    assert sorted((r.chosen_id, r.rejected_id or -1) for r in got) == sorted((p[0], p[1] or -1) for p in two)


def test_toxicity(spark):
    r = random.Random(1)
    bad = ["grunk", "vlorp", "snid"]
    rows, labels = [], []
    for i in range(900):
        words = ["".join(r.choice("abcde") for _ in range(3)) for _ in range(30)]
        if i % 5 == 0:
            words[r.randrange(30)] = r.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = {x.doc_id: x.toxicity for x in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((scored[i] >= 0.5) == (i % 5 == 0) for i in held) > 0.97 * len(held)
    assert scored[900] < 0.5 and scored[901] < 0.5


@pytest.mark.parametrize("share", [0.1, 0.3, 0.5])
def test_frequent_toxic_term(spark, share):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcde") for _ in range(4))
    rows, labels, toxic = [], [], round(2_000 * share)
    copy = " ".join([word(), "vlorp", *[word() for _ in range(20)]])
    for i in range(2_300):  # the last 300 are copies of one clean text
        words = [word() for _ in range(20)]
        if i < toxic * 0.9 or toxic <= i < toxic + 40:
            words.insert(r.randrange(1, 20), "vlorp")
        rows.append((i, copy if i >= 2_000 else " ".join(words)))
        labels.append((i, int(i < toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [t[:4] for t in model.terms] == ["vlor"]


BENCH = [(1, "a b c d e f g h"), (2, ""), (None, "x")]


def scored_by_terms(docs):
    model = toxicity.ToxicityModel({"vlorp": 0}, (3.0,), -2.0)
    return toxicity.score_toxicity(docs, model)


def with_items(docs):
    items = docs.sparkSession.createDataFrame(BENCH, "item_id long, text string")
    return decontamination.contaminated(docs, items)


def test_toxicity_keeps_rows_and_columns(docs, with_null_id):
    out = scored_by_terms(with_null_id.withColumn("toxicity", F.lit("old"))).collect()
    assert len(out) == with_null_id.count() and sum(r.doc_id is None for r in out) == 1
    assert all(0 <= r.toxicity <= 1 and (r.line, r.token) in (("l", "t"), ("", "")) for r in out)
    assert scored_by_terms(docs.limit(0)).count() == 0


def test_benchmark_with_repeated_and_null_rows(spark):
    text = "A b c d e f g h"
    rows = [(1, text), (1, text), (None, text), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(7))
    assert [(r.doc_id, r.item_id) for r in with_items(docs).collect()] == [(1, 1)]
    assert with_items(docs.limit(0)).count() == 0


def test_preference_of_repeated_and_no_turns(spark):
    shape = "conv_id long, turn long, role string, text string, pair string"
    turns = [(1, 0, "user", "hi", "p"), (1, 0, "user", "hi", "p"), (1, 1, "assistant", "yes", "p")]
    convs = preference.conversations(spark.createDataFrame(turns, shape))
    out = preference.preference_format(convs, preference.paired_by_opening(convs)).collect()
    assert len(out) == 1 and out[0].prompt.count("hi") == 2 and out[0].chosen.count("yes") == 1
    none = preference.conversations(spark.createDataFrame([], shape))
    assert preference.preference_format(none, preference.paired_by_opening(none)).count() == 0


OPERATORS = (
    jaccard_join.near_duplicates,
    line_dedup.line_dedup,
    repeats.remove_repeats,
    exact_dedup.exact_dedup,
    lm_scoring.score_documents,
    lambda d: token_counts.token_counts(d, VOCABULARY),
    lambda d: packing.pack_documents(d, VOCABULARY),
)


@pytest.mark.parametrize("number", range(len(OPERATORS)))
def test_empty_table(docs, number):
    assert OPERATORS[number](docs.limit(0)).count() == 0


@pytest.mark.parametrize("number", range(len(OPERATORS)))
def test_null_id(with_null_id, number):
    ids = [r.doc_id for r in OPERATORS[number](with_null_id.coalesce(1)).select("doc_id").collect()]
    assert ids.count(None) >= 1 and {k for k, _ in corpus()} <= set(ids)
