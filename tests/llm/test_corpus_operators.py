"""Operators that compare rows with each other: line dedup, substrings, SimHash, MaxScore, pipeline."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cohortloom.llm import components, line_dedup, maxscore, simhash, substring_dedup
from cohortloom.llm.queries import op5_line_dedup, op6_substring_dedup, op9_simhash, op10_maxscore
from cohortloom.sources.stages import StageArea

SMALL = "/root/testdata/sf0.001"


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def documents(spark, sf=SMALL):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# --- Lines ---------------------------------------------------------------------------------------


def kept_lines(docs: dict) -> dict:
    """By the definition: of equal chunks the first stays."""
    first, out = {}, {}
    for d in sorted(docs):
        for i, c in enumerate(line_dedup.chunks(docs[d])):
            first.setdefault("\n".join(c), (d, i))
    for d, text in docs.items():
        cut = line_dedup.chunks(text)
        out[d] = "\n".join(x for i, c in enumerate(cut) for x in c if len(c) < line_dedup.LEAST or first["\n".join(c)] == (d, i))
    return out


def test_chunks_cover_the_text_and_shift():
    rng = random.Random(3)
    lines = [f"line {rng.randrange(10**6)}" for _ in range(200)]
    text = "\n".join(lines)
    cut = line_dedup.chunks(text)
    assert [x for c in cut for x in c] == lines
    shifted = line_dedup.chunks("new first line\n" + text)
    assert len({tuple(c) for c in cut} - {tuple(c) for c in shifted}) <= 2
    assert line_dedup.chunks("") == line_dedup.chunks(None) == []


def test_line_query(spark):
    docs = documents(spark)
    want = kept_lines(docs)
    rows = op5_line_dedup(spark, SMALL).collect()
    assert len(rows) == len(docs) and sum(r.n_removed for r in rows) > 0
    for r in rows:
        assert r.kept_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_line_cases(spark, stages):
    rng = random.Random(5)
    shared = "\n".join(f"shared {rng.randrange(10**9)}" for _ in range(40))
    own = ["\n".join(f"own {i} {rng.randrange(10**9)}" for _ in range(12)) for i in range(4)]
    values = [None, "", own[0] + "\n" + shared, own[1] + "\n" + shared + "\n" + own[2], shared, "\n" * 50_000, "x\n" * 3]
    docs = texts(spark, values)
    rows = docs.unionAll(spark.createDataFrame([(None, shared), (None, None)], docs.schema))
    rows = rows.withColumns({"_id": F.lit(1), "id": F.lit(2), "chunks": F.lit("c"), "n_lines": F.lit("clash")})
    got = line_dedup.remove_repeats(rows, stages).collect()
    assert len(got) == len(values) + 2 and got[0]["id"] == 2 and got[0].chunks == "c"
    want = kept_lines(dict(enumerate(values)))
    for r in got:
        if r.doc_id is not None:
            assert r.text == (None if values[r.doc_id] is None else want[r.doc_id])
    assert [r.text for r in got if r.doc_id is None and r.text] == [shared]
    assert sum(r.n_removed for r in got) > 60
    assert line_dedup.remove_repeats(docs.limit(0), StageArea(spark)).count() == 0


def test_chunks_of_repeated_rows_stay(spark, stages):
    text = "\n".join(f"line {i * i}" for i in range(30))
    rows = line_dedup.remove_repeats(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string"), stages).collect()
    assert sorted((r.doc_id, r.text == text) for r in rows) == [(1, True), (1, True), (2, False)]


def test_equal_hashes_of_different_lines_are_not_removed(spark, stages, monkeypatch):
    """The bytes decide."""
    monkeypatch.setattr(line_dedup, "_written", lambda docs, wanted: docs.sparkSession.createDataFrame(
        [(7, 1, 0, "a\nb"), (7, 2, 0, "c\nd"), (7, 3, 0, "a\nb")], "hash long, id long, place int, body string"))
    monkeypatch.setattr(line_dedup, "_numbered", lambda docs: docs.sparkSession.createDataFrame(
        [(1, 0, 7), (2, 0, 7), (3, 0, 7)], "id long, place int, hash long"))
    gone = line_dedup.repeated_chunks(texts(spark, ["x"]), stages).collect()
    assert [r.id for r in gone] == [3]


def test_long_lines_that_repeat_between_others_are_removed(spark, stages):
    """Brute force over lines, without chunks()."""
    rng = random.Random(11)

    def line():
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(8))

    shared = [[line() for _ in range(n)] for n in (1, 2, 3, 5, 8) for _ in range(6)]
    docs = {i: [*(line() for _ in range(3)), *shared[i % 30], "}", *(line() for _ in range(3))] for i in range(90)}
    seen, want = set(), {}
    for i, lines in docs.items():
        want[i] = "\n".join(x for x in lines if x not in seen)
        seen |= set(lines) - {"}"}
    rows = line_dedup.remove_repeats(texts(spark, ["\n".join(x) for x in docs.values()]), stages).collect()
    assert {r.doc_id: r.text for r in rows} == want


def test_share_of_repeated_lines_that_is_found(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    seen, repeated, found, chunk = set(), 0, 0, set()
    for d in sorted(docs):
        gone = []
        for c in line_dedup.chunks(docs[d]):
            gone += [tuple(c) in chunk] * len(c)
            chunk.add(tuple(c))
        for line, out in zip((docs[d] or "").split("\n"), gone, strict=False):
            if sum(x.isalpha() for x in line) >= 30:
                repeated, found = repeated + (line in seen), found + (line in seen and out)
                seen.add(line)
    assert repeated > 500 and found / repeated > 0.95


# --- Substrings ----------------------------------------------------------------------------------


def removed(docs: dict, length: int) -> dict:
    """Covered bytes by the definition."""
    seen: dict = {}
    for d, raw in docs.items():
        for i in range(len(raw) - length + 1):
            seen.setdefault(raw[i : i + length], []).append((d, i))
    out = {d: bytearray(len(raw)) for d, raw in docs.items()}
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                out[d][i : i + length] = b"\1" * length
    return out


def test_transform_against_brute_force():
    rng = random.Random(3)
    for t in range(120):
        length = rng.choice([2, 3, 5, 8, 16])
        parts = [bytes(rng.choice(b"abc" if t % 2 else b"ab\0\xff") for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 8))]
        ends = np.cumsum([len(p) for p in parts])
        place = substring_dedup.bwt_repeats(np.frombuffer(b"".join(parts), dtype=np.uint8), ends, length)
        which = np.searchsorted(ends, place, side="right")
        got = set(zip(which.tolist(), (place - (ends - [len(p) for p in parts])[which]).tolist(), strict=True))
        seen: dict = {}
        for i, p in enumerate(parts):
            for j in range(len(p) - length + 1):
                seen.setdefault(p[j : j + length], []).append((i, j))
        assert got == {x for v in seen.values() if len(v) > 1 for x in v}


def test_every_start_has_one_segment():
    rng = random.Random(1)
    raw = bytes(rng.choice(b"abcdefgh") for _ in range(5000))
    _, first, count = substring_dedup.segments(raw, 400, 64)
    assert count.sum() == 4601 and (first[1:] == first[:-1] + count[:-1]).all()
    hashes = substring_dedup.grams(np.frombuffer(raw, dtype=np.uint8), 64)
    again = substring_dedup.grams(np.frombuffer(raw[1234:], dtype=np.uint8), 64)
    assert (hashes[1234:] == again).all()


@pytest.mark.parametrize("split", [250, 2])
def test_substrings_against_brute_force(spark, stages, monkeypatch, split):
    monkeypatch.setattr(substring_dedup, "SPLIT", split)
    rng = random.Random(11)

    def noise(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    base, passage = noise(900), noise(260)
    near = [base[:at] + "#" + base[at + 1 :] for at in range(100, 900, 90)]
    values = [None, "", noise(50), base, base, *near, noise(300) + passage + noise(200), passage + noise(10), passage[5:] + passage, "z" * 2000]
    docs = {i: (v or "").encode() for i, v in enumerate(values)}
    want = removed(docs, 130)
    df = texts(spark, values).withColumns({"row": F.lit(1), "raw": F.lit(2), "k1": F.lit(3), "ranges": F.lit(4)})
    rows = substring_dedup.remove_repeats(df, 130, stages).collect()
    assert len(rows) == len(values) and rows[0].raw == 2
    for r in rows:
        spans = [m.span() for m in re.finditer(rb"\x01+", bytes(want[r.doc_id]))]
        assert [(s.start, s.end) for s in r.spans] == spans, r.doc_id
        assert bytes(r.kept) == bytes(b for b, gone in zip(docs[r.doc_id], want[r.doc_id], strict=True) if not gone)
        assert r.n_bytes == len(docs[r.doc_id])


def test_substring_rows_that_repeat(spark, stages):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(200))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    rows = substring_dedup.remove_repeats(df, 400, stages).collect()
    assert sorted(len(r.kept) for r in rows) == [0, 0, 0, 0]
    alone = substring_dedup.remove_repeats(df.limit(1), 400, StageArea(spark)).first()
    assert bytes(alone.kept) == text.encode()
    assert substring_dedup.remove_repeats(df.limit(0), 400, StageArea(spark)).count() == 0


def test_substring_query(spark):
    docs = {d: (t or "").encode() for d, t in documents(spark).items()}
    want = removed(docs, 400)
    rows = op6_substring_dedup(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        gone = bytes(want[r.doc_id])
        kept = bytes(b for b, g in zip(docs[r.doc_id], gone, strict=True) if not g)
        assert (r.n_removed, r.n_spans) == (sum(gone), len(re.findall(rb"\x01+", gone)))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


# --- SimHash -------------------------------------------------------------------------------------


def naive_fingerprint(text: str | None, n: int) -> int:
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(fps: dict[int, int], bits: int) -> dict[int, int]:
    left, out = set(fps), {}
    while left:
        group, todo = set(), [min(left)]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += [y for y in left if (fps[x] ^ fps[y]).bit_count() <= bits]
        out |= dict.fromkeys(group, min(group))
        left -= group
    return out


def test_simhash_query(spark):
    fps = {d: naive_fingerprint(t, 4) for d, t in documents(spark).items()}
    want = naive_components(fps, 4)
    for r in op9_simhash(spark, SMALL).collect():
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])


@pytest.mark.parametrize("bucket", [2_000, 3])
def test_trie_against_brute_force(spark, stages, monkeypatch, bucket):
    """Dense balls of fingerprints; small buckets are split several times."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket)
    fps = set()
    for _ in range(30):
        center = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            x = center
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = dict(enumerate(sorted(fps)))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps.values()]
    classes = spark.createDataFrame(signed, "fp long")
    found = components.components(simhash.links(classes, 4, stages), stages).collect()
    root = {r.node: r.root for r in found}
    got: dict = {}
    for i, (x,) in enumerate(signed):
        got.setdefault(root.get(x, x), set()).add(i)
    want: dict = {}
    for i, c in naive_components(fps, 4).items():
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_cases(spark, stages):
    long = " ".join(f"w{i}" for i in range(60_000))
    values = [None, "", " \n\t", "One two", "one TWO", "three", long, long + " end", "Été un deux trois quatre"]
    df = texts(spark, values).withColumns({"fp": F.lit(1), "key": F.lit(2), "component": F.lit(3)})
    df = df.unionAll(df.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))).unionAll(df.where("doc_id = 3"))
    rows = simhash.near_duplicates(df, 4, 4, stages).collect()
    assert len(rows) == len(values) + 2
    fps = {i: naive_fingerprint(v, 4) for i, v in enumerate(values)}
    want = naive_components(fps, 4)
    for r in rows:
        if r.doc_id is not None:
            assert (r.fp % (1 << 64), r.component) == (fps[r.doc_id], want[r.doc_id])
    assert [r.component for r in rows if r.doc_id is None] == [3]
    assert simhash.near_duplicates(df.limit(0), 4, 4, StageArea(spark)).count() == 0


def test_components_of_chains_and_stars(spark, stages):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(1000, 1400)] + [(7, 7), (3, 2), (2, 3)]
    random.Random(1).shuffle(links)
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long"), stages).collect()}
    assert found == {i: 100 for i in range(101, 161)} | {i: 5 for i in range(1000, 1400)} | {3: 2}
    none = spark.createDataFrame([], "u long, v long")
    assert components.components(none, StageArea(spark)).count() == 0


# --- MaxScore ------------------------------------------------------------------------------------


def naive_top(rows, k, every):
    usable = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in rows
              if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in usable), default=0)
    usable = [(i, np.pad(v, (0, width - len(v)))) for i, v in usable]
    out = set()
    for i, q in usable:
        if i % every == 0:
            scored = sorted((-int(v @ q), j) for j, v in usable if j != i)[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    return out


@pytest.mark.parametrize("shard, block", [(16_384, 1_024), (37, 5)])
def test_maxscore_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(maxscore, "SHARD", shard)
    monkeypatch.setattr(maxscore, "BLOCK", block)
    rng = np.random.default_rng(shard)
    rows = [(i, [float(x) for x in rng.normal(size=9).astype(np.float32)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(400, None), (410, [1.0, None]), (420, [float("nan")]), (430, [float("inf"), 1.0]), (440, []), (450, [0.5, -0.5]), (460, [0.0] * 9)]
    rows += [(470, [-3.0] * 9), (471, [1e3] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    ints = df.select("vec_id", maxscore.scaled(F.col("embedding"), 256).alias("ints"))
    got = maxscore.top_k(ints, F.col("vec_id") % 10 == 0, 5)
    assert {tuple(r) for r in got.collect()} == naive_top(rows, 5, 10)


def test_maxscore_cases(spark):
    schema = "vec_id long, embedding array<float>"

    def run(rows):
        df = spark.createDataFrame(rows, schema)
        ints = df.select("vec_id", maxscore.scaled(F.col("embedding"), 256).alias("ints"))
        return sorted(tuple(r) for r in maxscore.top_k(ints, F.col("vec_id") % 50 == 0, 5).collect())

    assert run([]) == []
    assert run([(0, [1.0])]) == []
    assert run([(0, [1.0]), (1, [2.0]), (1, [2.0]), (None, [9.0])]) == [(0, 1, 1, 131072)]


def test_maxscore_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert {tuple(r) for r in op10_maxscore(spark, SMALL).collect()} == naive_top(rows, 5, 50)


# --- Pipeline ------------------------------------------------------------------------------------


def test_pipeline(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()
    ids = {r.doc_id for r in rows}
    assert len(ids) == len(rows) and ids <= set(docs) and 0.5 * len(docs) < len(ids) < len(docs)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontaminate", "byte_bpe"]
    assert corpus_pipeline.ORACLE_SQL is None
    r = max(rows, key=lambda r: r.n_tokens)
    assert r.n_tokens == len(r.token_ids)
    assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.token_ids)).encode()).hexdigest()


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_cases(spark, tmp_path, name):
    """Nulls, empty and long texts, repeated rows, clashing columns, empty tables."""
    sf = str(tmp_path)
    passage = "A passage of the benchmark that no training text should ever hold, with some more words."
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    rows = [(i, f"zork you {i} zork" if i % 2 else f"plain words of number {i} and more", "en", "s", 1) for i in range(40)]
    rows += [(50, None, None, None, None), (51, "", "en", "s", 0), (52, "long " * 60_000, "en", "s", 9), (None, "no name", "en", "s", 7)]
    rows += [(53, f"before {passage} after", "en", "s", 3), (54, "\n".join(f"l{i}" for i in range(30)), "en", "s", 3), (55, "\n".join(f"l{i}" for i in range(30)), "en", "s", 3)]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ("score", "leaks", "nth", "row", "key", "id", "n_lines", "fp", "component", "words")
    docs = docs.withColumns({c: F.lit(c) for c in clash})
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, sf)
    got = out.collect()
    by_id = {r.doc_id: r for r in got}
    if name == "byte_bpe":
        assert len(got) == len(rows) and by_id[50].n_tokens == by_id[51].n_tokens == 0
    else:
        assert out.columns == docs.columns and all(r[c] == c for r in got for c in clash)
        assert None in by_id
    if name == "toxicity":
        assert set(by_id) >= {0, 2, 38, 50, 51, 52} and not set(by_id) & {1, 3, 39}
    if name == "line_dedup":
        assert len(got) == len(rows) and by_id[50].text is None and by_id[51].text == ""
        assert len(by_id[55].text) < len(by_id[54].text) and by_id[55].n_chars == len(by_id[55].text)
    if name == "simhash":
        assert len(by_id) == len(got) and 50 in by_id and 51 not in by_id and 54 in by_id and 55 not in by_id
    if name == "decontaminate":
        assert 53 not in by_id and len(got) == len(rows) - 1
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_copies_are_told_apart_by_row(spark):
    """Different texts under one id are different documents; of a group one row stays."""
    one, two = "first text of many words that says one thing", "another text with other words that says more"
    rows = [(5, one), (5, two), (5, two), (7, one), (3, "third text, which nobody has copied so far"), (9, two), (3, one), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, one), (3, rows[4][1]), (3, one), (5, two)])
