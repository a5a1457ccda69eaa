import collections
import hashlib

import pytest

from subloom.llm import alignment
from subloom.llm.alignment import align_tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, digest string, copies long, links int"
TEXTS = [
    "the cat sat on the mat", "The  cat\n\n sat\t\ton  it's  a naïve 日本語 \U0001f600 text\r\n", " leading and trailing ",
    "<|endoftext|> <s> </s> <unk> <0x41>", "▁ stands for a space", "a\x00b\x1fc\x85d e﻿", "１２３ ½ ² Σς", "x", " ",
    "\n" * 40, "aaaa" * 3_000, "word " * 9_000, "", None,
]


def library_ids():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    return a, b


def spelt(a, b, ids_a, ids_b):
    vocab = {i: t for t, i in a.get_vocab().items()}
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table, spare = {chr(c): c for c in printable}, 256
    for c in range(256):
        if c not in printable:
            table[chr(spare)] = c
            spare += 1
    token_b = lambda p: bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()
    return [bytes(table[c] for c in vocab[i]) for i in ids_a], [token_b(b.id_to_piece(i)) for i in ids_b]


def plain(texts):
    a, b = library_ids()
    out, counts = [], collections.Counter()
    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a, bytes_b = spelt(a, b, ids_a, ids_b)
        want = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            out.append(None)
            continue
        ends = [dict(zip(__import__("itertools").accumulate(map(len, x)), range(len(x)))) for x in (bytes_a, bytes_b)]
        groups, links, pa, pb = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            i, j = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, ids_a[pa:i])) + "|" + ",".join(map(str, ids_b[pb:j])))
            links.append((ids_a[i - 1], ids_b[j - 1]))
            pa, pb = i, j
        counts.update(links)
        out.append((len(ids_a), len(ids_b), groups, links))
    highest = collections.defaultdict(int)
    for (x, y), n in counts.items():
        highest[y] = max(highest[y], n)
    rows = []
    for found in out:
        if found is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, groups, links = found
        best = sum(counts[p] == highest[p[1]] for p in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        rows.append((na, nb, len(groups), len(links), best, sum(counts[p] for p in links), digest))
    return rows


@pytest.mark.parametrize("copies", [1_000, 3])
def test_equals_plain(spark, monkeypatch, copies):
    monkeypatch.setattr(alignment, "COPIES", copies)
    monkeypatch.setattr(alignment, "BATCH_BYTES", 100)
    rows = [(2**60 + i, t) for i, t in enumerate(TEXTS + [TEXTS[0]] * 9 + [""] * 5 + [TEXTS[5].upper()])]
    rows += [rows[1], rows[1], (None, TEXTS[2])]
    docs = spark.createDataFrame([(*r, "d", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = sorted(map(str, map(tuple, align_tokens(docs, A, B).collect())))
    assert got == sorted(str((k, *m)) for (k, _), m in zip(rows, plain([t for _, t in rows])))
    assert sum(m[0] > 0 for m in plain(TEXTS)) >= 8


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert align_tokens(docs, A, B).count() == 0
    only = spark.createDataFrame([(1, None, "d", 1, 2), (2, "", "d", 1, 2)], SCHEMA)
    assert sorted(map(tuple, align_tokens(only, A, B).collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_same_ids_as_the_library_for_every_character():
    a, b = library_ids()
    pair = alignment.tokenizers(A, B)
    chars = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [
        "".join(f"x{chr(c)}1 {chr(c)}. {chr(c)}{chr(c)} y" for c in chars[i : i + 400])
        for i in range(0, len(chars), 400 * 7)  # every seventh stretch
    ]
    for text, ids in zip(texts, pair.ids(texts)[0]):
        assert ids == a.encode(" " + text, add_special_tokens=False).ids
