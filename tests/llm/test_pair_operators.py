"""Periodic runs, alignment of two tokenizers, Jaccard join: against brute force."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortloom.llm import align, jaccard, periodic
from cohortloom.llm.queries import op11_periodic, op12_alignment, op13_jaccard
from cohortloom.sources.stages import StageArea

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "a", "A a A a A a A a", "x y\x0bz", "one two three four five", "one two three four five", "  ▁ é"]


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


# --- Periodic runs -------------------------------------------------------------------------------


def all_runs(words, least=6):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        start = 0
        while start + q < len(words):
            end = start
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end > start and end + q - start >= max(least, 4 * q):
                found.setdefault((start, end + q), q)
            start = max(end, start + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made_words(rng):
    size, letters = rng.choice([0, 1, 5, 6, 7, 30, 200, 700]), rng.choice([1, 2, 3, 60])
    words = [rng.randrange(letters) for _ in range(size)]
    for _ in range(rng.randrange(4)):
        if size > 4:
            a = rng.randrange(size)
            b, p = rng.randrange(a, size + 1), rng.randrange(1, size // 3 + 2)
            words[a:b] = [words[a + (i - a) % p] for i in range(a, b)]
    if rng.random() < 0.2:  # a Fibonacci word has many runs
        x, y = [0], [0, 1]
        while len(y) < size:
            x, y = y, y + x
        words = y[:size]
    return " ".join(map(str, words))


@pytest.mark.parametrize("seed", range(5))
def test_runs(seed):
    rng = random.Random(seed)
    made = [made_words(rng) for _ in range(300)]
    for text, (words, runs) in zip(made, periodic.runs_of(made), strict=True):
        assert [tuple(r) for r in runs.tolist()] == all_runs(text.split())


def test_runs_of_odd_rows(spark):
    df = texts(spark, ODD).withColumn("runs", F.lit(1))
    rows = {r.doc_id: r for r in periodic.with_runs(df).collect()}
    assert len(rows) == len(ODD) and rows[0].text is None
    for i, t in enumerate(ODD):
        words = (t or "").encode().split()
        words = [w.decode() for w in words]
        assert (rows[i].n_words, rows[i].collapsed) == (len(words), collapsed(words, all_runs(words)))
        assert [tuple(r) for r in rows[i]._runs] == all_runs(words)
    assert periodic.with_runs(df.limit(0)).count() == 0


def test_run_query(spark):
    rows = {r.doc_id: tuple(r)[1:] for r in op11_periodic(spark, SMALL).collect()}
    docs = documents(spark)
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        words = [w.decode() for w in (text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = all_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        listed = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
        want = (len(runs), *((*best, 1000 * best[1] // best[2]) if best else [None] * 4))
        digests = (hashlib.sha256(t.encode()).hexdigest() for t in (listed, collapsed(words, runs)))
        assert rows[doc_id] == (*want, *digests)


# --- Alignment -----------------------------------------------------------------------------------


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.symbols = align.byte_symbols()

    def bytes_b(self, i):
        text = self.b.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if self.b.is_byte(i) else text.replace("▁", " ").encode()

    def spans(self, ids, table):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(table(i)), i))
            at = out[-1][1]
        return out

    def aligned(self, text):
        """Both token rows with their byte ranges, groups as text, and all links."""
        if not text:
            return [], [], [], []
        raw = (" " + text).encode()
        a = self.spans(self.a.encode(" " + text, add_special_tokens=False).ids, lambda i: self.bytes_a(i))
        b = self.spans(self.b.encode(text), self.bytes_b)
        if b"".join(self.bytes_a(x[2]) for x in a) != raw or b"".join(self.bytes_b(x[2]) for x in b) != raw:
            return [], [], [], []
        links, j = [], 0
        for start, end, i in a:
            while b[j][1] <= start:
                j += 1
            k = j
            while k < len(b) and b[k][0] < end:
                links.append((i, b[k][2]))
                k += 1
        groups, last = [], 0
        for edge in sorted({x[1] for x in a} & {x[1] for x in b}):
            groups.append("|".join(",".join(str(i) for s, e, i in side if last <= s and e <= edge) for side in (a, b)))
            last = edge
        return a, b, groups, links

    def bytes_a(self, i):
        return bytes(self.symbols[c] for c in self.a.id_to_token(i))


@pytest.fixture(scope="module")
def plain():
    return Plain()


def expected(plain, docs):
    found = {key: plain.aligned(text) for key, text in docs}
    count = Counter(link for x in found.values() for link in x[3])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = {}
    for key, (a, b, groups, links) in found.items():
        best = sum(count[x] == most[x[1]] for x in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out[key] = (len(a), len(b), len(groups), len(links), best, sum(count[x] for x in links), digest)
    return out


def test_alignment_query(spark, plain, tmp_path):
    rng = random.Random(4)
    chars = [" ", " ", "  ", "\n", "\t", "the", " it's", "é", "я", "中文", "▁", " ", "é", "12", "<|endoftext|>", "<s>"]
    chars += ["\U0001f600", "᠎", "\x1c", "\x85", "ﬁ", "Ⱟ's", "ࡰ's"]
    made = ["".join(rng.choice(chars) for _ in range(rng.randrange(40))) for _ in range(400)]
    docs = [*[t for _, t in documents(spark) if len(t or "") < 5000], *ODD, *made, " the the" * 3000]
    docs = list(enumerate(docs))
    spark.createDataFrame(docs, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: tuple(r)[1:] for r in op12_alignment(spark, str(tmp_path)).collect()}
    assert rows == expected(plain, docs)


def test_merged_bitmaps():
    """Lists and bits, merged in any mix, hold every place once."""
    rng = random.Random(1)
    for sizes in ([3, 5], [5000, 10], [4000, 4000], [60000, 50000], [1]):
        sets = [sorted(rng.sample(range(align.BLOCK), n)) for n in sizes]
        merged = align._merged([align._bitmap(align.np.array(x)) for x in sets])
        want = sorted(set().union(*sets))
        assert align._places(merged).tolist() == want and align._popcount(merged) == len(want)


def test_alignment_of_nothing(spark):
    files = align.Tokenizers.read(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    df = texts(spark, ODD).withColumn("groups", F.lit("mine"))
    found = align.scored(align.align(df, files), StageArea(spark))
    rows = found.collect()
    assert len(rows) == len(ODD) and {r.groups for r in rows} == {"mine"}
    assert align.scored(align.align(df.limit(0), files), StageArea(spark)).count() == 0


# --- Jaccard -------------------------------------------------------------------------------------


def linked(docs, words=5, percent=80):
    """Size and component of every document, from all pairs that share an n-gram."""
    sets = {}
    for key, text in docs:
        w = (text or "").encode().lower().split()
        sets[key] = frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    postings = defaultdict(list)
    for key, grams in sets.items():
        met = Counter()
        for g in grams:
            met.update(postings[g])
            postings[g].append(key)
        for other, n in met.items():
            if 100 * n >= percent * (len(grams) + len(sets[other]) - n):
                a, b = top(key), top(other)
                root[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), top(k)) for k in sets}


def test_jaccard_query(spark):
    docs = documents(spark)
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in op13_jaccard(spark, SMALL).collect()}
    assert rows == linked(docs)


def test_jaccard_of_near_copies(spark, monkeypatch):
    """A hot group of near copies about the threshold, shared passages, short and odd texts."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "MANY", 4)
    monkeypatch.setattr(jaccard, "HOME", 8)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(90)]
    passage = " ".join(f"p{i}" for i in range(60))
    docs = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(4)}"
        docs.append(" ".join(w))
    for i in range(60):
        docs.append(passage + " " + " ".join(f"q{i // 3}-{j}" for j in range(rng.randrange(5, 40))))
    docs += ["Same five words and MORE", "same five words and more", *ODD, *ODD]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, n int").repartition(5)
    rows = jaccard.near_duplicates(df, 5, 80, StageArea(spark)).collect()
    assert {r.doc_id: (r.n, r.component) for r in rows} == linked(docs)
    assert jaccard.near_duplicates(df.limit(0), 5, 80, StageArea(spark)).count() == 0


def test_jaccard_makes_no_row_for_each_pair_of_a_group(spark):
    """Texts with a passage in common, each long enough to make every pair a candidate, and a few copies."""
    size, passage = 400, " ".join(f"w{i}" for i in range(60))
    docs = [(i, passage + "".join(f" x{i}-{j}" for j in range(13))) for i in range(size)]
    docs += [(size + i, f"{docs[i][1]} y{i}") for i in range(20)]
    area = StageArea(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = jaccard.near_duplicates(df, 5, 80, area).collect()
    assert {r.doc_id: (r.n, r.component) for r in rows} == linked(docs)
    most = max(table.count() for table in area.tables.values())
    assert most < size * size / 4, {name: table.count() for name, table in area.tables.items()}


def test_jaccard_packs_tokens_in_little_memory(spark, monkeypatch):
    """A task holds a bounded part of its tokens, however many texts a batch has."""
    rng = random.Random(11)
    docs = [" ".join(f"w{rng.randrange(50_000)}" for _ in range(400)) for _ in range(5000)]
    df = texts(spark, docs[:1])
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    run = jaccard._dealt(df, 5, 9, "text")
    batch = pa.record_batch([pa.array(docs)], names=["text"])
    tracemalloc.start()
    try:
        n = sum(len(low) // 4 for part in run([batch]) for low in part.column(3).to_pylist())
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == sum(len(jaccard.gram_sets([d], 5)[1]) for d in docs)
    assert most < 96 << 20


def test_jaccard_of_one_class_that_shares_a_little_with_many(spark, monkeypatch):
    """Its tokens belong to many groups, which are parted."""
    monkeypatch.setattr(jaccard, "HOME", 2)
    rng = random.Random(3)
    groups = [" ".join(f"g{i}-{j}" for j in range(rng.randrange(8, 30))) for i in range(40)]
    docs = [" ".join(groups), " ".join(groups) + " end", " ".join(groups[:30])]
    docs += [g + tail for g in groups for tail in ("", " a", " b c")]
    docs = list(enumerate(docs))
    rows = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80, StageArea(spark)).collect()
    assert {r.doc_id: (r.n, r.component) for r in rows} == linked(docs)


def test_asked_matches_grow_with_frequent_tokens():
    rare, frequent = jaccard.np.full(100, 2), jaccard.np.full(100, 500)
    assert jaccard.matches_asked(frequent, 80) >= jaccard.matches_asked(rare, 80) >= 1
    mixed = jaccard.np.array([2] * 60 + [5000] * 40)
    assert jaccard.matches_asked(mixed, 80) <= 40  # the prefix stays among the rare ones
