"""Operators 11 to 13 against brute force, and over odd rows, repeated rows and empty tables."""

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from logloom.llm import packing, phrases, variants
from tests.llm.test_ops import LONG
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
SCHEMA = "doc_id long, text string, lang string"
ODD = [(1, None, "en"), (2, "", None), (3, " \n\t", "en"), (5, "one", "en"), (5, "one", "en"), (None, "No Key At All; here", None), (6, LONG, "en"), (8, "é ñ 😀 ▁ tabs\tand\r\nlines", "xx")]


def frame(spark, rows):
    """Rows with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("theirs") for c in ("key", "word", "at", "p", "s", "n", "phrase", "block", "piece", "r", "shard", "length", "run", "h")})


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- 11 ----


def brute_phrases(rows, least, top, words=5):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, words + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {key: c for key, c in f.items() if c >= least}
    out = []
    for (lang, p), a in often.items():
        if len(p) == 1:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(la == lang and len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (la, q), c in often.items())
        if not inside:
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    res = []
    for lang in n:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        res += [(x[0], i + 1, *x[1:]) for i, x in enumerate(own)]
    return sorted(res)


def prose(n, seed):
    r = random.Random(seed)
    vocabulary = ["The", "of", "a", "be", "naïve", "so", "é", "to|be", "x'y"] + ["".join(r.choice("abcd") for _ in range(3)) for _ in range(12)]
    fixed = [" ".join(r.choice(vocabulary) for _ in range(r.randint(3, 8))) for _ in range(5)]
    part = lambda: r.choice(fixed) if r.random() < 0.3 else r.choice(vocabulary) + r.choice(["", ",", ".", "\n", "\t", " ..", "!?"])
    return [(i, " ".join(part() for _ in range(r.randint(0, 60))), r.choice(["en", "de", None])) for i in range(n)]


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_phrases(spark, block):
    rows = prose(120, 5) + ODD
    got = phrases.collocations(frame(spark, rows), top=40, least=5, block=block, bits=phrases.CHUNK)
    want = brute_phrases(rows, 5, 40)
    assert len(want) > 80 and any(len(x[2].split()) == 5 for x in want)
    assert sorted(tuple(x) for x in got.collect()) == want


def test_phrase_arithmetic_passes_64_bits(spark, monkeypatch):
    """Counts of a corpus that can't be made here: 10^13 words, in which a phrase occurs 3 * 10^11 times."""
    n, a, l, r = 10**13 + 7, 3 * 10**11, 10**12 + 1, 7 * 10**11
    every = spark.createDataFrame([(1, "en", "x", l), (1, "en", "y", r), (2, "en", "x y", a)], "k int, lang string, phrase string, f long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda docs, **how: (spark.createDataFrame([("en", n)], "lang string, n long"), every))
    (row,) = phrases.collocations(every).collect()
    assert row.score == 1000 * a * n // (l * r) and (row.l, row.r, row.a, row.n) == (l, r, a, n)


def test_phrases_of_nothing(spark):
    assert phrases.op11(frame(spark, [])).count() == 0
    assert phrases.op11(frame(spark, ODD[:5])).count() == 0


@tables
def test_phrases_against_sql(spark):
    compare(spark, lambda s, d: phrases.op11(s.read.parquet(f"{d}/documents.parquet")), phrases.ORACLE, FOLDER)


# ---- 12 ----


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_packing(rows, got, size):
    """Pieces are right, whatever the order of repeated rows, and sequences are gapless and not too long."""
    want = Counter()
    for (doc, _, _), ids in zip(rows, ids_of([t for _, t, _ in rows]), strict=True):
        for k, s in enumerate(range(0, len(ids), size)):
            own = ids[s : s + size]
            want[doc, k, s, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    sequences = {}
    for x in got:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


WORDY = "Naïve café; İstanbul's ŒUVRE, don't 3,000 x.y <|endoftext|>, <|EndOfText|> J̌ H̱ İx ßÿ÷×a ﬁn é́ Á,  x\x0b\x1c. Σας ΣΑΣ, ok?! 中文, 12:30... ’s nb"


def test_packing(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(WORDY.split(" ")) for _ in range(int(r.paretovariate(0.7) * 4) % 900)), "en") for i in range(400)] + ODD + [(77, WORDY, None)]
    plan = packing.Plan(size=256, shard=150)
    got = packing.pack(packing.token_pieces(frame(spark, rows), size=256), plan).collect()
    used = check_packing(rows, got, 256)
    assert used <= 1.02 * -(-sum(x.length for x in got) // 256) + 1


def test_packing_of_nothing(spark):
    empty = packing.op12(frame(spark, []))
    assert empty.count() == 0 and empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    only = [(1, "", None), (2, None, None)]
    assert check_packing(only, packing.op12(frame(spark, only)).collect(), 2048) == 1


def test_packing_search_beats_best_fit():
    """Triplets that fill sequences exactly: the search finds fuller packings than best fit, and never worse ones; a child
    of a crossing holds every item once and no sequence is too full."""
    draw = np.random.default_rng(1)
    a = draw.integers(380, 490, 60)
    b = np.array([draw.integers(251, 1000 - x - 250) for x in a])
    lengths = np.sort(np.concatenate([a, b, 1000 - a - b]))[::-1].copy()
    first = packing.first_packings(lengths, 4, 1000, draw)
    best = packing.evolved(lengths, first, 4, 200, 1000, draw)
    assert len(best[0].fill) < len(first[0].fill)
    for p in best + first:
        assert np.array_equal(np.bincount(p.bin_of, lengths), p.fill) and p.fill.max() <= 1000


def test_islands_migrate(spark):
    """The second epoch of an island starts from its ring neighbour's best packings as well."""
    rows = [(i, " ".join(["word"] * (i % 50 + 1)), "en") for i in range(300)]
    pieces = packing.token_pieces(frame(spark, rows), size=64)
    one = packing.pack(pieces, packing.Plan(size=64, shard=400, islands=3, epochs=3)).collect()
    check_packing(rows, one, 64)


# ---- 13 ----


def brute_words(rows):
    out = Counter()
    for doc, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            k = h % len(run)
            out[run[:k] + run[k + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def spelled(n, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abé") for _ in range(r.randint(5, 9))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "banana", "bananana", "straße"]
    words = []
    for w in base:
        for _ in range(4):
            k, c = r.randrange(len(w) + 1), r.choice("abéÿ")
            words += [w, w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]]
    weights = [r.paretovariate(0.4) for _ in words]
    return [(i, " ".join(r.choice([w, w.upper(), f"{w},"]) for w in r.choices(words, weights, k=120)), "en") for i in range(n)]


@pytest.mark.parametrize("size", [3, 1 << 14])
def test_variants(spark, size):
    """Lists in parts of three words give the same as whole lists."""
    rows = spelled(150, 4) + ODD
    words = brute_words(rows)
    want = brute_variants(words)
    assert len(want) > 100 and any(x[1] and x[2] != x[1] for x in want) and any(x[4] == 0 for x in want) or size
    got = variants.spelling_variants(variants.vocabulary(frame(spark, rows)), size=size)
    assert sorted(tuple(x) for x in got.collect()) == want


def test_variants_of_nothing(spark):
    assert variants.op13(frame(spark, [])).count() == 0
    assert variants.op13(frame(spark, ODD[:6])).count() == 0
    (row,) = variants.op13(frame(spark, [(9, "wörter Wörter wörter wörter wörter", None)])).collect()
    assert tuple(row) == ("wörter", None, "wörter", 5, 0, None)


@tables
def test_variants_of_the_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(x.doc_id, x.text, x.lang) for x in docs.collect()]
    assert sorted(tuple(x) for x in variants.op13(docs).collect()) == brute_variants(brute_words(rows))
