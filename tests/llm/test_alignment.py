"""Tokenizer alignment against both tokenizers on whole texts and plain loops."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimcheck.llm import alignment
from claimcheck.llm.alignment import PerfectHash, Tokenizers, alignment_stats, hash_longs
from claimcheck.llm.queries import op13_token_alignment

SF = "/root/testdata/sf0.001"


class Plain:
    """Tokens with their bytes, by the public libraries as they come."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        names = Tokenizers()
        self.a = Tokenizer.from_file(names.a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=names.b)
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [c for c in range(256) if c not in keep]
        self.byte = {chr(c): c for c in keep} | {chr(256 + k): c for k, c in enumerate(rest)}

    def tokens(self, text):
        found = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.byte[c] for c in t)) for i, t in zip(found.ids, found.tokens, strict=True)]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        spelled = b"".join(x for _, x in a) == want and b"".join(x for _, x in b) == want
        return (a, b) if spelled else ([], [])


def brute(rows):
    plain, made, counts = Plain(), [], collections.Counter()
    for doc_id, text in rows:
        a, b = plain.tokens(text) if text else ([], [])
        spans = [[], []]
        for k, tokens in enumerate((a, b)):
            at = 0
            for i, x in tokens:
                spans[k].append((i, at, at + len(x)))
                at += len(x)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]] if len(a) * len(b) < 400_000 else swept(spans)
        counts.update(links)
        ends = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups, start = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, s, t in side if start <= s and t <= e) for side in spans) if len(a) < 3000 else None)
            start = e
        made.append((doc_id, len(a), len(b), len(ends), links, groups))
    best = collections.Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = []
    for doc_id, n_a, n_b, n_groups, links, groups in made:
        digest = "" if not n_a else None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc_id, n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=str)


def swept(spans):
    links, j = [], 0
    for i, s, t in spans[0]:
        while spans[1][j][2] <= s:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][1] < t:
            links.append((i, spans[1][k][0]))
            k += 1
    return links


def texts(seed=4):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abehistrnéüñ'-.1東😀ß") for _ in range(rnd.randint(1, 9)))
    rows = []
    for k in range(120):
        gap = rnd.choice([" ", " ", "\n", "  ", "\t", " \n", "\n\n", " ", "\x1c", " ", "\x0b "])
        rows.append((k, gap.join(rnd.choice([word(), "the", "of", "there", "won't"]) for _ in range(rnd.randint(1, 40))) + rnd.choice(["", "", " ", "\n", "\r\n"])))
    odd = ["", None, " ", "\n", "x", " x", "\nx", "a▁b", "see ▁ x", "<s> </s> <unk> <0x0A>", "<|endoftext|> text", "a\x00b", "﻿a", "é ① ﬁ", "͸ \U0001fae8 ᲀx", "a \x85 b", "foo\tbar baz", "x\ry z\r", "it's we'll 'tis", "w" * 5000 + " " + "東" * 400, "the of " * 2000]
    rows += [(500 + k, t) for k, t in enumerate(odd)]
    return [*rows, rows[3], (None, rows[4][1]), (4, "another text")]


@pytest.mark.parametrize("small", [True, False])
def test_stats_equal_plain_loops(spark, monkeypatch, small):
    if small:
        for name, value in (("SHARD", 64), ("SLICE", 256), ("FAN", 2), ("PIECES", 40), ("RUN", 500)):
            monkeypatch.setattr(alignment, name, value)
    docs = spark.createDataFrame(texts(), "doc_id long, text string").repartition(5).withColumns({"pair": F.lit("x"), "n_best": F.lit("y"), "shard": F.lit(1)})
    got = sorted(map(tuple, alignment_stats(docs).collect()), key=str)
    for g, w in zip(got, brute(texts()), strict=True):
        assert g[:7] == w[:7] and (w[7] is None or g[7] == w[7]), (g, w)


def test_pieces_give_the_tokens_of_whole_texts():
    v, plain = alignment.Vocabulary.of(Tokenizers()), Plain()
    assert v.fast is not None and v.separable
    for _, text in texts(9):
        pieces = v.cut(text) if text and alignment.SPACE not in text else None
        if pieces:
            spaced = [p[0] != "\n" for p in pieces]
            whole = [" " + p if s else p for p, s in zip(pieces, spaced, strict=True)]
            assert "".join(whole) == " " + text
            a, b = plain.tokens(text)
            size = np.array([len(w.encode()) for w in whole])
            assert v.encode_a(whole)[1].tolist() == v.encode_pieces(whole, size)[1].tolist() == [i for i, _ in a]
            assert v.encode_a(whole)[0].tolist() == v.encode_pieces(whole, size)[0].tolist()
            assert v.encode_b(pieces, spaced)[1].tolist() == [i for i, _ in b]


def test_perfect_hash_is_minimal_and_perfect(spark):
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 70_000):
        keys = np.unique(rnd.integers(0, 1 << 31, n))
        made = PerfectHash.build(keys)
        assert sorted(made.numbers(keys)) == list(range(len(keys)))
        assert n < 1000 or 64 * len(made.words) < 5 * len(keys)
        others = PerfectHash(made.sizes, made.words.tobytes()).numbers(rnd.integers(1 << 40, 1 << 41, 1000))
        assert ((others >= -1) & (others < max(1, len(keys)))).all()
    x = [0, 1, -1, 2**40, 1608223999]
    want = [r[0] for r in spark.createDataFrame([(i,) for i in x], "x long").select(F.xxhash64("x")).collect()]
    assert hash_longs(np.array(x), 42).view(np.int64).tolist() == want


def test_no_documents(spark):
    assert alignment_stats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_plain_loops(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = op13_token_alignment(spark, SF)
    assert {t for _, t in found.dtypes} == {"bigint", "string"}
    for g, w in zip(sorted(map(tuple, found.collect()), key=str), brute(rows), strict=True):
        assert g[:7] == w[:7] and (w[7] is None or g[7] == w[7])
