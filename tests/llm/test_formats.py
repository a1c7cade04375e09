"""Mixing, byte-level BPE, WARC archives and the pipeline."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from stockweave.llm import bpe, mixing, queries, warc

DOCS = "doc_id long, text string, source string, n_chars int, size string, target string, ids string, shard string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark, rows):
    return spark.createDataFrame([(d, t, s, None, "x", None, "y", "z") for d, t, s in rows], DOCS)


def targets_by_hand(sizes, weights=(5, 2, 1), ceiling=3):
    """Shares by weight; what is above a ceiling is shared again until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(ceiling * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        target = {s: ceiling * sizes[s] if s in full else left * weight[s] / share for s in order}
        above = {s for s in order if s not in full and target[s] > ceiling * sizes[s]}
        if not above:
            return target
        full |= above


def mixed_rows():
    rng = random.Random(1)
    rows = []
    for i in range(600):
        source = rng.choice(["big"] * 8 + ["a", "é", "zz", None, "B"] * 2 + ["tiny"] * (i % 40 == 0))
        rows.append((i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 200]))), source))
    return rows + [(1000, None, "a"), (1001, None, "void"), (1002, "\t\n ", "void"), (None, "a b c", "a"), (None, "a b c", "a"), (1003, "v " * 30000, "big"), (3, rows[3][1], rows[3][2])]


def test_mixing_meets_its_targets(spark):
    rows = mixed_rows()
    docs = table(spark, rows)
    plan = mixing.plan(docs, shard_words=4000).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target = targets_by_hand(sizes)
    taken = Counter()
    for r in plan:
        source = None if r.source_key == ">" else r.source_key[1:]
        taken[source] += r.taken
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source])
        assert 0 <= r.taken <= 3 * r["size"]
        assert r.taken == r.passes * r["size"] + sum(x["to"] - x["from"] for x in r.ranges)
    assert len(plan) == len(rows)
    for source, want in target.items():
        assert abs(taken[source] - want) <= max(0.02 * want, 40), source
    again = mixing.plan(docs.repartition(7), shard_words=4000).collect()
    key = lambda r: (str(r.doc_id), r.text_key, r.taken, str(r.ranges))
    assert sorted(map(key, plan)) == sorted(map(key, again))
    out = mixing.mix(docs, shard_words=4000)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert got == Counter({s: n for s, n in taken.items() if n})


def test_mixing_cuts_alike_at_every_size(spark):
    """Blocks have one size on small and large tables, and shards have no upper number."""
    few = [(i, "w " * 500, f"s{i % 4}") for i in range(40)]
    for rows in (few, few + [(100 + i, "v " * 500, "s9") for i in range(400)]):
        ranges = [r for p in mixing.plan(table(spark, rows)).collect() for r in p.ranges]
        assert max(r["to"] - r["from"] for r in ranges) == mixing.BLOCK_WORDS
    many = [(i, "a b c d", "s0") for i in range(9000)]
    plan = mixing.plan(table(spark, many), shard_words=4, block_words=2).collect()
    assert sum(r.taken for r in plan) == pytest.approx(36000, rel=0.02)


def test_mixing_empty(spark):
    assert mixing.plan(table(spark, [])).count() == 0
    nothing = mixing.plan(table(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(r["size"], r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1003])
def test_apportion_is_sainte_lague(spark, seats):
    """Seats handed out one after another to the highest quotient."""
    rng = random.Random(seats)
    claims = {f"k{i:02d}": rng.choice([0.0, 1.0, rng.random() * 10, rng.random() * 1000]) for i in range(25)}
    rows = spark.createDataFrame([("g", k, c, seats) for k, c in claims.items()], "g string, k string, c double, seats long")
    got = {r.k: r.quota for r in mixing.apportion(rows, "g", "k", "c", "seats").collect()}
    want = dict.fromkeys(claims, 0)
    for _ in range(seats):
        best = min((k for k in claims if claims[k]), key=lambda k: (-claims[k] / (2 * want[k] + 1), k))
        want[best] += 1
    assert got == want


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def bpe_texts():
    rng = random.Random(2)
    texts = ["", "a", "a" * 3000, " " * 2000 + "x", "ab" * 700 + "é" * 500, "\x1c\x1d a\x85b c᠎ d﻿", "1234567890" * 100, "日本語テキスト" * 200, "I'll've 's <|endoftext|> \r\n\t\v\f x", "😀" * 400, "word " * 30000]
    texts += ["".join(rng.choice("abcé \n\t.0٣x日") for _ in range(rng.randint(1, 900))) for _ in range(200)]
    return texts + [
        "".join(chr(c) for c in range(k, k + 997) if not 0xD800 <= c < 0xE000 and c < 0x110000) for k in range(0, 0x110000, 997 * 5)
    ]


def test_bpe_equals_the_library(spark):
    texts = bpe_texts()
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(9000, None, "s"), (None, "a b", None), (3, texts[3], "s")]
    got = bpe.decode(bpe.encode(table(spark, rows), RANKS, public_tokenizers.PATTERN), RANKS).collect()
    library = reference()
    want = sorted((str(d), library.encode_ordinary(t or ""), (t or "").encode()) for d, t, _ in rows)
    assert want == sorted((str(r.doc_id), list(r.ids), bytes(r.data)) for r in got)
    digests = bpe.digests(table(spark, rows), RANKS, public_tokenizers.PATTERN).collect()
    want = sorted(
        (str(d), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(data).hexdigest())
        for d, ids, data in want
    )
    assert want == sorted(tuple(map(lambda x: str(x) if x is None else x, (str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256))) for r in digests)
    assert bpe.digests(table(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_digests_take_one_python_worker_a_task(spark):
    """Two Python steps in one stage are two workers a task at once, each with a vocabulary of its own."""
    rows = [(i, t, "s") for i, t in enumerate(bpe_texts())] + [(9000, None, "s"), (None, "a b", None), (None, "a b", None)]
    docs = table(spark, rows)
    both = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    chained = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    assert both.columns == chained.columns and both.dtypes == chained.dtypes
    key = lambda r: (str(r.doc_id), list(r.ids), bytes(r.data))
    assert sorted(map(key, both.collect())) == sorted(map(key, chained.collect()))
    for digests in (bpe.digests(docs, RANKS, public_tokenizers.PATTERN), corpus_pipeline.encoded(spark, docs, "")):
        assert digests._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_bpe_long_pieces_merge_like_short_ones():
    vocabulary = bpe.Vocabulary(bpe.read_ranks(RANKS))
    rng = random.Random(3)
    for n in (2, 17, 100, 500):
        pieces = ["".join(rng.choice("abcdeéth") for _ in range(n)).encode() for _ in range(20)]
        assert vocabulary.encode(pieces) == [
            vocabulary._merge_long(p) if len(p) <= bpe.LONG else vocabulary.encode([p])[0] for p in pieces
        ]


def pages(spark, rows):
    return spark.createDataFrame([(p, u, h, "x", 1) for p, u, h in rows], "page_id long, url string, html string, data string, chunk_no int")


@pytest.mark.parametrize("chunk", [7, 64, 1 << 16])
def test_warc_round_trip(spark, tmp_path, chunk):
    long = "é<p>" * 5000
    rows = [(1, "http://a\r\nX: y", long), (2, None, None), (3, "u", ""), (9, "u", long), (4, "u", "short"), (5, "u", "short"), (6, "u", "WARC/1.1\r\n\r\n" * 30), (None, "n", long), (8, "é", "\r\n" * 60), (7, "u", "\r\n" * 60), (7, "u", "\r\n" * 60)]
    archives = warc.write(pages(spark, rows).repartition(3), f"file://{tmp_path}/w", chunk)
    least = {}
    for p, _, h in rows:
        if p is not None:
            least[h or ""] = min(p, least.get(h or "", p))
    want = []
    for p, u, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and p != least[h or ""]
        want.append((str(p), u and u.replace("\r", "%0D").replace("\n", "%0A"), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", least[h or ""] if again else None))
    got = warc.read_records(spark, archives, chunk).collect()
    assert sorted(map(str, want)) == sorted(
        str((str(r.page_id), r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got
    )
    assert all(r.intact for r in got)
    parts = defaultdict(list)
    for r in warc.read_chunks(spark, archives, chunk).where("page_id = 1").collect():
        assert len(r.data) <= chunk
        parts[r.record_id].append((r.chunk_no, bytes(r.data), r.digest_so_far))
    (found,) = parts.values()
    data = b""
    for _, piece, digest in sorted(found):
        data += piece
        assert hashlib.sha256(data).hexdigest() == digest
    assert data.decode() == long


def test_warc_empty(spark, tmp_path):
    archives = warc.write(pages(spark, []), f"file://{tmp_path}/w")
    assert archives == [] and warc.read_records(spark, archives).count() == 0


def test_pipeline(spark):
    """Each stage against what it must hold on its own input, the last against the library."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, taken = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        taken.append(stage(spark, taken[-1], folder).cache())
    quality, exact, near, mixed, encoded = taken[1:]
    assert all(t.columns == columns for t in taken[:-1])
    verdict = {r.doc_id for r in queries.QUERIES["op2_quality_rules"](spark, folder).where("kept").collect()}
    assert {r.doc_id for r in quality.collect()} == verdict
    texts = defaultdict(list)
    for r in quality.collect():
        texts[r.text].append(r.doc_id)
    assert {(r.doc_id, r.text) for r in exact.collect()} == {(max(v), k) for k, v in texts.items()}
    from test_dedup import classes_by_hand

    rows = exact.collect()
    label = classes_by_hand([r.text for r in rows])
    least = {}
    for r in rows:
        least[label[r.text]] = min(r.doc_id, least.get(label[r.text], r.doc_id))
    assert sorted(r.doc_id for r in near.collect()) == sorted(least.values())
    size, words = Counter(), Counter()
    for r in near.collect():
        size[r.source] += len(r.text.split(" "))
    original = {r.doc_id: r.text for r in near.collect()}
    for r in mixed.collect():
        words[r.source] += len(r.text.encode().split())
        assert set(r.text.split()) <= set(original[r.doc_id].split())
    plan = Counter()
    for r in mixing.plan(near).collect():
        plan[r.source_key[1:]] += r.taken
    assert words == plan
    library = reference()
    want = Counter()
    for r in mixed.collect():
        ids = library.encode_ordinary(r.text)
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    assert want == Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoded.collect())
    assert corpus_pipeline.run(spark, folder).count() == encoded.count()


def test_pair_table_finds_every_pair():
    ranks = bpe.read_ranks(RANKS)
    found = bpe.PairTable(ranks)
    pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in list(ranks.items())[:3000] for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    left, right, want = (np.array(x, np.int32) for x in zip(*pairs))
    assert (found.ranks(left, right) == want).all()
    assert (found.ranks(np.array([-1, 5], np.int32), np.array([5, -1], np.int32)) == bpe.NONE).all()
