"""Periodic runs, URL filters and fill-in-middle against brute force on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from stockweave.llm import middle, periodic_runs, queries, url_filter

DOCS = "doc_id long, text string, tail string, n string, runs string, frames string, h1 string, marked string, kind string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", "n", "r", "f", "h", "m", "k") for d, t in rows], DOCS)


# Periodic runs


def runs_by_hand(words, least):
    """Every maximal stretch of each period, by comparing all words that far apart."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        k = 0
        while k < len(words) - q:
            j = k
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > k and j - k + q >= max(least, 2 * q):
                found.setdefault((k, j - k + q), q)
            k = max(j, k + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def random_words(rng):
    n, k = rng.choice([0, 1, 11, 12, 13, 30, 120, 250]), rng.choice([1, 2, 3, 5, 60])
    words = [rng.randrange(k) for _ in range(n)]
    if n > 20 and rng.random() < 0.6:
        p, a = rng.randint(1, n // 2), rng.randrange(n // 2)
        for i in range(a, rng.randint(a, n)):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("least", [12, 8, 5])
def test_runs_equal_brute_force(least, monkeypatch):
    rng = random.Random(least)
    for turn in range(120):
        monkeypatch.setattr(periodic_runs, "CHUNK", rng.choice([1, 50, 1 << 19]))
        docs = [random_words(rng) for _ in range(rng.randint(1, 5))]
        docs += [docs[0]]
        codes = np.array([w for d in docs for w in d], np.int64)
        got = periodic_runs.find_runs(codes, np.array([len(d) for d in docs]), least)
        want = [(i, *r) for i, d in enumerate(docs) for r in runs_by_hand(d, least)]
        assert [tuple(r) for r in got.tolist()] == sorted(want, key=lambda r: (r[0], r[1], r[3]))


def test_grammar_gives_exact_extensions():
    rng = np.random.default_rng(5)
    for k in (1, 2, 4, 300):
        words = np.concatenate([[k], rng.integers(0, k, 400), [k + 1], np.tile(rng.integers(0, k, 7), 40), [k + 2]])
        rounds = periodic_runs.recompress(words)
        back = periodic_runs.mirrored(rounds)
        a, b = rng.integers(1, len(words) - 1, (2, 500))
        a, b = a[a != b], b[a != b]
        right, left = periodic_runs.common_extension(rounds, a, b), periodic_runs.common_extension(back, len(words) - a, len(words) - b)
        for i, j, r, s in zip(a.tolist(), b.tolist(), right.tolist(), left.tolist()):
            n = next(t for t in range(len(words)) if words[i + t] != words[j + t])
            m = next(t for t in range(len(words)) if words[i - 1 - t] != words[j - 1 - t])
            assert (r, s) == (n, m)


def test_grammar_of_a_long_power_is_small():
    words = np.concatenate([[2], np.tile([0, 1, 1], 100_000), [3]])
    rounds = periodic_runs.recompress(words)
    assert sum(len(r.symbols) for r in rounds) < 3 * len(words) and len(rounds) < 30
    found = periodic_runs.find_runs(words, np.array([len(words)]))
    assert found.tolist() == [[0, 1, 300_000, 3]]


def collapsed_by_hand(text, doc_id):
    words = WORDS.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(words, 12)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return n, runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_op11_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "b", "éé", " ", "ccc"]) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    texts += [None, "", " \t\n", "a " * 3000, "x y\tz\x0bz " * 40, "\ta\n" * 12, "one two " * 30]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(None, "q " * 20), (None, "q " * 20), (7, texts[7])]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for doc_id, text in rows:
        n, runs, kept = collapsed_by_hand(text, doc_id)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        want.append(
            (
                doc_id,
                len(runs),
                *best,
                best[1] * 1000 // best[2] if best[1] else None,
                hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest(),
                hashlib.sha256(kept.encode()).hexdigest(),
            )
        )
    assert sum(w[1] > 0 for w in want) > 20
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in columns)) for r in got)


def test_runs_without_rows_or_tails(spark):
    assert periodic_runs.digests(periodic_runs.detect(table(spark, []), F.lit(10))).collect() == []
    row = periodic_runs.detect(table(spark, [(1, "s " + "a b " * 9 + "t")])).first()
    assert (row.n, row.runs[0].start, row.runs[0].length, row.runs[0].period, row.collapsed) == (20, 1, 18, 2, "s a b t")


# URL filters

PAGES = "page_id long, url string, html string, host string, path string, probes string, keys string, found string, rule string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "x", "y", "p", "k", "f", "r") for i, u in enumerate(urls)], PAGES)


def judged_by_hand(url, entries):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best, blocked = None, False
    bare = re.sub(r"^.*@|:[0-9]*$", "", host)
    for kind, entry, verdict in entries:
        if kind == "rule":
            h, p = entry[: entry.index("/")], entry[entry.index("/") :]
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                best = max(best or (0,), (len(entry), len(h), entry, verdict))
        else:
            fits = {
                "host": bare == entry or bare.endswith("." + entry),
                "url": bare + path == entry,
                "word": entry in re.split(r"[.\-]", bare),
            }[kind]
            blocked |= fits and verdict == "block"
    return host, path, best and best[2], best[3] if best else "block" if blocked else "allow"


URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "http:///de/1",
    "https://Example.ORG/en/12?x=1#y",
    "https://a.example.org/en/2",
    "https://a.example.org/es/",
    "https://example.org/es",
    "https://badexample.org/es/",
    "http://x.com/fr/9#z",
    "http://x.com/fr",
    "http://x.com/de/9",
    "http://x.com.net/de/9",
    "http://com/de/",
    "http://org",
    "http://casino.example.net/",
    "http://cheap-pills.example.net/a",
    "http://pillset.example.net/a",
    "http://u:p@adult-x.example.net:8080/de/a",
    "http://casino.example.net/?u=http://a.org/",
    "http://ÄÖ.net/ü/ö",
    "http://a..b/",
    "ftp://" + "a." * 5000 + "com/fr/" + "x" * 50_000,
    "http://one.test/page",
    "http://sub.two.test/",
    "http://three.test/page\nnext",
]


@pytest.mark.parametrize("key_bits, part_entries", [(64, 1000), (3, 1000), (64, 2), (4, 2)])
def test_urls_equal_brute_force(spark, tmp_path, key_bits, part_entries):
    """With three-bit keys nearly all texts collide, and the stored texts must tell them apart."""
    entries = url_filter.default_entries(spark).collect() + [
        ("url", "one.test/page", "block"),
        ("host", "two.test", "block"),
        ("rule", "b.example.org/e", "allow"),
        ("rule", "example.org/en/1", "allow"),
        ("rule", "test/", "allow"),
        ("host", None, "block"),
    ]
    rng = random.Random(1)
    hosts = ["org", "com", "net", "test", "two", "one", "example", "b", "casino", "a-bet", "x"]
    urls = URLS + [
        "http://" + ".".join(rng.choices(hosts, k=rng.randint(1, 4))) + rng.choice(["", "/", "/es/1", "/en/12", "/fr/", "/de/q", "/e"])
        for _ in range(300)
    ]
    index = url_filter.build(spark.createDataFrame(entries, "kind string, entry string, verdict string"), f"{tmp_path}/i", part_entries, key_bits)
    assert len(index.parts) > 1 or part_entries > 2
    known = {}
    for kind, entry, verdict in entries:
        if entry is not None:
            known[kind, entry] = max(known.get((kind, entry), ""), verdict)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages(spark, urls), index).collect()}
    assert got == {i: judged_by_hand(u, [(*k, v) for k, v in known.items()]) for i, u in enumerate(urls)}


def test_urls_listed_and_empty(spark, tmp_path):
    index = url_filter.build(url_filter.default_entries(spark), f"{tmp_path}/i")
    row = url_filter.judge(pages(spark, ["http://free-bets.casino.example.net/"]), index).first()
    assert sorted(row.listed) == ["word:bets", "word:casino"] and row.verdict == "block" and row.rule is None
    assert url_filter.judge(pages(spark, []), index).collect() == []
    nothing = url_filter.build(url_filter.default_entries(spark).limit(0), f"{tmp_path}/e")
    assert {r.verdict for r in url_filter.judge(pages(spark, URLS), nothing).collect()} == {"allow"}


# Fill-in-middle

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle_by_hand(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("frame_chars", [1, 2, 7, 1 << 14])
def test_middle_equals_brute_force(spark, frame_chars):
    rng = random.Random(frame_chars)
    letters = ["a", "b", " ", "\n", "\t", "é", "😀", "<", " ", "\x1c", "P>"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", " ", "word", " \n ", "x" * 3000, "<P>", "a <S", "<S> b", "a<M>"]
    rows = list(enumerate(texts)) + [(None, "a b c"), (None, "a b c"), (3, texts[4])]
    out = middle.fill_in_middle(table(spark, rows), frame_chars=frame_chars)
    got = sorted(repr(tuple(r)) for r in middle.digests(out).collect())
    want, plain = [], []
    for doc_id, text in rows:
        *head, output = middle_by_hand(doc_id, text)
        plain.append(repr((doc_id, head[1], output)))
        want.append(repr((doc_id, *head, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())))
    assert got == sorted(want)
    assert sorted(repr(tuple(r)) for r in middle.texts(out).collect()) == sorted(plain)
    assert {eval(w)[2] for w in want} == {"plain", "psm", "spm"}


def test_cuts_read_one_frame():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(20_000))
    frames = middle.pack_text(text, 1000, zstandard.ZstdCompressor())
    read = []

    class Counting(middle.Frames):
        def text(self, number):
            read.append(number)
            return super().text(number)

    stored = Counting(frames, zstandard.ZstdDecompressor())
    units = UNITS.findall(text)
    assert stored.n_units == len(units) and all(len(f["data"]) < 1000 for f in frames)
    for unit in (0, 1, 777, 9999, 20_000):
        read.clear()
        assert stored.behind(unit) == len("".join(units[:unit])) and len(read) <= 1


def test_middle_empty(spark):
    assert middle.digests(middle.fill_in_middle(table(spark, []))).collect() == []
