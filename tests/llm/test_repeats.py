"""The answers of the buckets: rows that grow with the documents, not with documents times buckets."""

import collections
import random

from subloom.llm import repeats


def test_few_rows_pass_from_buckets(spark, monkeypatch):
    r = random.Random(11)
    text = lambda: "".join(r.choice("abcdefgh ") for _ in range(3000))
    base = [text() for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base + base)] + [(60, base[0][:700] + text()), (None, base[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 20_000)  # ten buckets
    monkeypatch.setattr(repeats, "BATCH_BYTES", 20_000)
    stored, write = [], repeats.write_through

    def counted(df, name):
        out = write(df, name)
        stored.append((name, out.count()))
        return out

    monkeypatch.setattr(repeats, "write_through", counted)
    out = repeats.remove_repeats(docs).collect()
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed, bytes(x.kept)) for x in out)
    seen = collections.Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    want = []
    for key, t in rows:
        hit = {j for i in range(len(t) - 199) if seen[t[i : i + 200]] > 1 for j in range(i, i + 200)}
        kept = "".join(c for j, c in enumerate(t) if j not in hit).encode()
        want.append((str(key), len(t), len(hit), kept))
    assert got == sorted(want)
    assert dict(stored)["samples"] == len(rows)  # some ten times as many before
