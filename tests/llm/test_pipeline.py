"""run() of the pipeline against a plain version, with repeated and null ids and clashing names."""

import collections
import random

import pytest

import corpus_pipeline
from subloom.llm.toxicity import fit_toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def alike(a, b):
    return 100 * len(a & b) >= 75 * len(a | b) and bool(a) and bool(b)


def texts():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(3, 6)))
    line = lambda n=20: " ".join(word() for _ in range(n))
    rows, labels = [], []
    common, item = line(12), line(15)
    for i in range(420):
        text = f"{line()}\n{common}\n{line()}" if i % 3 else line(60)
        if i % 6 == 0:
            words = text.split(" ")
            words.insert(r.randrange(1, 20), r.choice(["vlorp", "grunkish"]))
            text = " ".join(words)
        if i % 40 == 7:
            text += f" {item} {line(3)}"
        rows.append((i, text))
        labels.append((i, int(i % 6 == 0)))
    near = rows[33][1].split(" ")
    rows += [(500, " ".join(near[:-1] + ["other"])), (501, rows[33][1].upper()), (45, rows[45][1]), (None, rows[57][1])]
    rows += [(None, item), (None, "x"), (None, None), (502, ""), (503, " ")]
    # one id, two texts that are near copies of each other; and one more row of another id
    long = line(80)
    rows += [(504, long), (504, f"{long} end"), (505, line(9)), (505, line(9))]
    return rows, labels, item


def test_run(spark, tmp_path):
    rows, labels, item = texts()
    sf = str(tmp_path)
    shape = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, gone int, id string"
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), 0.9, 1, "q") for k, t in rows], shape)
    docs.repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.write_through(stage(spark, docs, sf), name)
        assert docs.columns == before.columns and docs.filter("toxicity <> 0.9 or gone <> 1 or id <> 'q'").count() == 0
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
        prior = [(r.doc_id, r.text) for r in before.collect()]
        check = collections.Counter
        if name == "toxicity":
            model = fit_toxicity(before, spark.read.parquet(f"{sf}/labels.parquet"))
            assert check(kept[name]) == check((k, t) for k, t in prior if model.score(t) < 0.5)
            bad = [k for k, t in rows if t and ("vlorp" in t or "grunkish" in t)]
            assert not {k for k, _ in kept[name]} & set(bad) and len(kept[name]) == len(rows) - len(bad)
        elif name == "line_dedup":
            assert len(prior) == len(kept[name])
            was, now = (sum(bool(shingles(x)) for _, t in p for x in (t or "").split("\n")) for p in (prior, kept[name]))
            assert now < was
            every = {shingles(x) for _, t in prior for x in (t or "").split("\n")} - {frozenset()}
            left = [s for s in (shingles(x) for _, t in dict.fromkeys(kept[name]) for x in (t or "").split("\n")) if s]
            assert not any(alike(a, b) for i, a in enumerate(left) for b in left[:i])
            assert all(any(alike(s, t) for t in left) for s in every)
        elif name == "near_duplicates":
            sets = [shingles(t) for _, t in prior]
            root = list(range(len(prior)))
            for i, a in enumerate(sets):
                for j in range(i):
                    if alike(a, sets[j]):
                        root = [root[j] if x == root[i] else x for x in root]
            groups = collections.defaultdict(list)
            for x, row, s in zip(root, prior, sets):
                groups[x].append(row)
            assert len(kept[name]) == len(groups)
            left = check(kept[name])
            for members in groups.values():
                assert any(left[m] for m in members)
        else:
            want = shingles(item)
            assert check(kept[name]) == check(
                (k, t) for k, t in prior if 4 * len(shingles(t) & want) < 3 * len(want)
            )
    out = corpus_pipeline.run(spark, sf)
    pieces = out.collect()
    assert check(p.doc_id for p in pieces if p.piece == 0) == check(k for k, _ in kept["decontamination"])
    by_bin = collections.defaultdict(list)
    for p in pieces:
        by_bin[p.sequence_id].append((p.offset, p.length))
    for parts in by_bin.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
    total = sum(p.length for p in pieces)
    assert len(by_bin) <= total // 2048 + 2


def test_near_duplicates_stage_keeps_one_of_each_group(spark):
    r = random.Random(2)
    line = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(n))
    a, b = line(80), line(80)
    rows = [(1, a), (1, a), (1, f"{a} end"), (None, a), (2, b), (2, line(70)), (None, b.upper()), (3, ""), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((k.doc_id, k.text) for k in corpus_pipeline.without_near_duplicates(spark, docs, "").collect())
    assert sum(got.values()) == 6 and got[3, ""] == 2 and got[4, None] == 1 and got[2, rows[5][1]] == 1
    assert sum(n for (_, t), n in got.items() if t in (a, f"{a} end")) == 1
    assert sum(n for (_, t), n in got.items() if t and t.lower() == b) == 1
