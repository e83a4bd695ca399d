"""Token alignment, vector codes and subword quality against brute force on small awkward inputs."""

import bisect
import collections
import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from planlens.llm import queries, subword_quality, token_alignment, vector_codes
from planlens.llm.bpe import byte_symbols

A, B = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = [
        "", None, " ", "   ", "\n", "a\n\nb", "a\n b", "a \nb", "tab\tx", "▁x", " lead", "trail ", "\x00", "x\x00y <s> </s> <|endoftext|> <0x41> <unk>",
        "é中😀　x y", "\r\nab\r\n {\r", "a;\r\n  b", "x" * 3_000, " " * 400 + "q", "word " * 12_000, "中" * 9_000, "\n\n\nfoo bar",
    ]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(10**6 + k, t) for k, t in enumerate(odd)]
    return [*rows, (None, "no id"), (3, "an id twice"), (3, "an id twice")]


def aligned(rows):
    """By byte spans, a pair of tokens at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    side_a, side_b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    side_a.encode_special_tokens = True
    back = {s: b for b, s in byte_symbols().items()}
    piece = lambda i: bytes([int(side_b.id_to_piece(i)[3:5], 16)]) if side_b.is_byte(i) else side_b.id_to_piece(i).replace("▁", " ").encode()
    total, each = collections.Counter(), []
    for doc, text in rows:
        links, groups, counts = collections.Counter(), [], (0, 0)
        if text:
            spans = []
            found_a, found_b = side_a.encode(" " + text, add_special_tokens=False).ids, side_b.encode(text)
            for ids, spell in ((found_a, lambda i: bytes(back[c] for c in side_a.id_to_token(i))), (found_b, piece)):
                ends = np.cumsum([len(spell(i)) for i in ids]).tolist()
                spans.append((list(zip([0, *ends], ends, ids)), b"".join(map(spell, ids))))
            if spans[0][1] == spans[1][1] == (" " + text).encode():
                a, b = spans[0][0], spans[1][0]
                counts = len(a), len(b)
                cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
                groups = [([], []) for _ in cuts]
                for side, tokens in enumerate((a, b)):
                    for _, e, i in tokens:
                        groups[bisect.bisect_left(cuts, e)][side].append(i)
                first = 0
                for s, e, i in a:
                    while b[first][1] <= s:
                        first += 1
                    for t, _, j in b[first:]:
                        if t >= e:
                            break
                        links[i, j] += 1
        total.update(links)
        each.append((doc, counts, groups, links))
    highest = collections.Counter()
    for (_, j), n in total.items():
        highest[j] = max(highest[j], n)
    out = []
    for doc, counts, groups, links in each:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        best = sum(n for p, n in links.items() if total[p] == highest[p[1]])
        out.append((doc, *counts, len(groups), sum(links.values()), best, sum(n * total[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_token_alignment(spark, texts, monkeypatch):
    docs = spark.createDataFrame([(*r, 1, "k") for r in texts], "doc_id long, text string, n_a int, key string").repartition(5)
    want = aligned(texts)
    assert rows_of(token_alignment.align(docs, A, B)) == want
    assert rows_of(token_alignment.align(docs, A, B, table=40)) == want  # nearly all pairs are joined
    assert token_alignment.align(docs.limit(0), A, B).count() == 0


def test_alignment_in_small_blocks():
    """Groups, links and hashes don't depend on how events are cut into blocks and sweeps."""
    r = random.Random(2)
    a, b = (token_alignment.Vocabulary([bytes(r.choices(b"ab", k=r.randint(1, 4))) for _ in range(30)]) for _ in range(2))
    for v in (a, b):
        v.strings[:2], v.lengths[:2] = [b"a", b"b"], 1

    def cut(text, v):
        out, at = [], 0
        while at < len(text):
            fits = [i for i, s in enumerate(v.strings[:-1]) if text.startswith(s, at)]
            out.append(r.choice(fits))
            at += len(v.strings[out[-1]])
        return np.array(out, "<u2")

    docs = [(cut(t, a), cut(t, b)) for t in (bytes(r.choices(b"ab", k=n)) for n in (1, 700, 40, 3, 900))]

    def run(block, swept):
        machine = token_alignment.Machine(a, b)
        out = []
        for key, sides in enumerate(docs):
            rows = []
            for side, (ids, v) in enumerate(zip(sides, (a, b))):
                starts = np.concatenate([[0], np.cumsum(v.lengths[ids])])
                rows += [(key, key, int(starts[k]), side, ids[k : k + block].tobytes()) for k in range(0, len(ids), block)]
            for row in sorted(rows, key=lambda x: x[:4]):
                machine.enough = min(machine.enough, max(swept, 2 * machine.waiting))
                out += machine.read(*row)
        machine.close()
        return [(*x[:7], [c.tolist() for c in token_alignment.unpacked_links(x[7])]) for x in [*out, *machine.sweep()]]

    assert run(3, 5) == run(50, 100) == run(10_000, 10**9)


class Counting:
    """A tokenizer that notes how many texts it gets at a time."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.calls.append(len(texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_chunks_are_encoded_joined(monkeypatch):
    """The library gets plain chunks joined, with the ids that each has alone; a text is taken apart once for both sides."""
    a, b = token_alignment.ByteSide(A), token_alignment.PieceSide(B)
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgé中😀09,.-'", k=r.randint(1, 9))) for _ in range(3_000)]
    words[7:7] = ["<|endoftext|>", "<s>", "'s", "'", "▁", "x▁", "Ａ", "ﬁ", "\u200b", "e\u0301", "\ufeff", "0" * 50]
    chunks = list(dict.fromkeys(r.choice([" ", " ", "\n"]) + w for w in words))
    odd = [" ", " \n\n", " a\tb", "   x", " \r\n y", " \x00", " \x1cz", " a\u3000b", " \x85"]
    alone = {x: [side.encode_many([x])[1].tolist() for side in (a, b)] for x in [*chunks, *odd]}
    count = a.tokenizer = Counting(a.tokenizer)
    for some in (chunks, odd, [*odd, *chunks], chunks[:1], [" ▁", *chunks[:300]]):
        count.calls.clear()
        for side, find in enumerate((a.encode_many, b.encode_many)):
            lengths, ids = find(some)
            ends = np.cumsum(lengths).tolist()
            assert [ids[s:e].tolist() for s, e in zip([0, *ends], ends)] == [alone.setdefault(x, [a.encode_many([x])[1].tolist(), b.encode_many([x])[1].tolist()])[side] for x in some]
    count.calls.clear()
    a.encode_many([*odd, *chunks])
    assert sum(count.calls) <= len(chunks) / 50 + len(odd)

    taken = []
    keys = token_alignment.spaced_keys
    monkeypatch.setattr(token_alignment, "spaced_keys", lambda text: taken.append(text) or keys(text))
    texts = ["".join(chunks[k : k + 50]) + (odd[k // 50] if k < 450 else "") for k in range(0, len(chunks), 50)]
    found = list(token_alignment.WholeChunks(a, b).ids_of_texts(texts))
    assert taken == texts
    a.tokenizer = count.tokenizer
    for text, sides in zip(texts, found):
        for side, ids in zip((a, b), sides):
            want = side.whole(text)
            spelled = b"".join(side.strings[i] for i in want) == (" " + text).encode()
            assert (ids.tolist() if ids is not None else None) == (want if spelled else None)


def coded(rows, rounds=6):
    """All distances, in Python's integers."""
    kept = [(i, [math.floor(Fraction(x) * 4096) for x in v], g) for i, v, g in rows if v and len(v) % 8 == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    m = len(kept[0][1]) // 8
    books = [[v[p * m : (p + 1) * m] for _, v, _ in kept[:16]] for p in range(8)]

    def near(x, entries):
        found = [sum((a - c) ** 2 for a, c in zip(x, e)) for e in entries]
        return found.index(min(found)), min(found)

    for k in range(rounds + 1):
        chosen = [[near(v[p * m : (p + 1) * m], books[p]) for p in range(8)] for _, v, _ in kept]
        for p in range(8 if k < rounds else 0):
            for e in range(len(books[p])):
                if own := [v[p * m : (p + 1) * m] for (_, v, _), c in zip(kept, chosen) if c[p][0] == e]:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    errors = [sum(d for _, d in c) for c in chosen]
    totals = collections.Counter()
    for (_, _, g), e in zip(kept, errors):
        totals[g] += e
    fits = lambda e: e if e < 1 << 63 else None
    broken = {g for (_, _, g), e in zip(kept, errors) if fits(e) is None}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for k, _ in c), fits(e), None if g in broken else fits(totals[g]), digest) for (i, _, g), c, e in zip(kept, chosen, errors)), key=repr)


def vectors():
    r = random.Random(3)
    step = [0.0, 1 / 4096, 2 / 4096, -1 / 4096]
    ties = [(k, [r.choice(step) for _ in range(8)], r.choice([None, 1, 2])) for k in range(120)]
    broken = [(9, None, 1), (8, [None] * 8, 1), (7, [float("nan")] * 8, 1), (6, [float("-inf")] + [0.0] * 7, 1), (-1, [], 2), (77, [0.5] * 16, 2), (None, [0.5] * 8, None)]
    wide = [(500 + k, [r.uniform(-1, 1) * 10 ** r.randint(0, 12) for _ in range(8)], 1) for k in range(40)]
    huge = [(900 + k, [r.uniform(-1, 1) * 10 ** r.randint(0, 300) for _ in range(8)], 5) for k in range(20)]
    usual = [(k, [r.gauss(0, 0.2) for _ in range(32)], k % 3) for k in range(300)]
    return {"ties": ties + ties[:30], "few": ties[:5] + broken, "sizes": ties[:40] + wide + huge, "usual": usual, "one": ties[:1] * 4}


@pytest.mark.parametrize("kind", list(vectors()))
def test_vector_codes(spark, kind):
    rows = vectors()[kind]
    table = spark.createDataFrame([(*r, "x", 2) for r in rows], "vec_id long, embedding array<double>, label int, code string, entries int").repartition(4)
    assert rows_of(vector_codes.code(table)) == coded(rows)
    assert rows_of(vector_codes.code(table, labels=1)) == coded(rows)  # labels beyond the bound are joined by a shuffle


def test_vector_codes_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.code(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.code(none).count() == 0


def test_bounds_prune_nothing_that_could_win():
    """With bounds carried over many rounds, entries are those of all distances; and bounds do spare distances."""
    r = np.random.default_rng(4)
    x = np.concatenate([r.integers(-40, 40, (400, 4)), r.integers(900, 960, (400, 4))])
    entry, upper, lower = np.zeros(800, np.int64), np.full(800, vector_codes.MOST), np.zeros((800, 6), np.int64)
    found, moved = x[[0, 1, 2, 400, 401, 402]].copy(), np.zeros(6, np.int64)
    for _ in range(8):
        between = vector_codes.floor_root(((found[:, None] - found[None]) ** 2).sum(axis=2))
        entry, upper, lower = vector_codes.assigned(x, entry, upper, lower, (found, between, moved))
        squares = ((x[:, None] - found[None]) ** 2).sum(axis=2)
        assert (entry == squares.argmin(axis=1)).all()
        assert (lower.astype(float) ** 2 <= squares).all() and (upper.astype(float) ** 2 >= squares.min(axis=1)).all()
        new = np.array([x[entry == k].sum(axis=0) // max(1, (entry == k).sum()) if (entry == k).any() else found[k] for k in range(6)])
        moved, found = vector_codes.ceil_root(((new - found) ** 2).sum(axis=1)), new
    assert (lower > 500).any()  # far entries weren't forgotten


def test_roots():
    big = np.array([0, 1, 2, 3, 4, 8, 9, 2**52 + 1, 2**60 - 1, (2**30 + 1) ** 2 - 1, (2**30 + 1) ** 2], np.int64)
    assert vector_codes.floor_root(big).tolist() == [math.isqrt(x) for x in big.tolist()]
    assert vector_codes.ceil_root(big).tolist() == [math.isqrt(x - 1) + 1 if x else 0 for x in big.tolist()]
    assert sum(v << (30 * k) for k, v in enumerate(vector_codes.limbs(-(10**40)))) == -(10**40)


def test_subword_quality(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 7)))
    clean = lambda: " ".join(word() for _ in range(60))
    junk = [lambda: " ".join(word() + "&&&" for _ in range(40)), lambda: f"{word()} " * 50, lambda: " | ".join(word() for _ in range(50))]
    rows = [(k, clean() if k % 4 else junk[k % 3]()) for k in range(500)]
    docs = spark.createDataFrame([(*x, "en", 5) for x in [*rows, (900, None), (901, ""), (None, rows[0][1]), rows[0]]], "doc_id long, text string, lang string, score int").repartition(4)
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(500)] + [(1, 0, 0), (None, 1, 0), (901, None, 0)], "doc_id long, quality int, toxic int")
    rule = ~subword_quality.held_out(F.col("doc_id"))
    got = subword_quality.score(docs, labels, rule).collect()
    assert len(got) == 504
    tested = [x for x in got if x["doc_id"] is not None and x["doc_id"] < 500]
    assert sum(x["predicted"] != (x["doc_id"] % 4 > 0) for x in tested) <= 5
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got)
    assert len({x["score"] for x in got if x["doc_id"] in (900, 901)}) == 1
    assert subword_quality.score(docs.limit(0), labels).count() == 0
    assert {x["score"] for x in subword_quality.score(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_by_numbers_is_that_by_vectors():
    """A document's score from its bucket numbers equals softmax over the mean of its vectors, word by word."""
    texts = ["one two two", "", "a", "x y x y x y", "longerword é中 longerword"]
    known = subword_quality.WordTable(None)
    found = subword_quality.document_features(texts, known)
    assert [int(n.sum()) for _, n in found][:3] == [1 + 3 * (1 + 3 + 2 + 1) + 2 + 1, 1, 1 + 1 + 1]  # end, words with n-grams, pairs, one pair of equals
    weights = np.random.default_rng(1).normal(size=subword_quality.BUCKETS).astype(np.float32)
    model = subword_quality.Model(weights, 0.3)
    want = [1 / (1 + math.exp(-(float((weights[u].astype(float) * n).sum() / n.sum()) + 0.3))) for u, n in found]
    assert np.allclose(model.scores(texts, subword_quality.WordTable(weights)), want, atol=1e-6)
    for u, n in found:
        back = subword_quality.unpacked_features(subword_quality.packed_features(u, n))
        assert (back[0] == u).all() and (back[1] == n).all()


def test_held_out_quality(spark):
    """On labels that weren't learned from."""
    folder = "/root/testdata/sf0.01"
    got = queries.op11_subword_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got) > 0
