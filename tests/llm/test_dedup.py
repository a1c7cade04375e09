"""Exact, near and substring dedup against brute force on small tables."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from stockweave.llm import bag_minhash, exact_dedup, graph, sentence_spans

DOCS = "doc_id long, text string, source string, kept string, node string, text_key string, ids string, run string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "s", "x", None, "z", "i", "r") for d, t in rows], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


def exact_by_hand(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    out = []
    for text, docs in groups.items():
        keep = max((d for d in docs if d is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        seen = False
        for d in sorted(docs, key=lambda x: (x is not None, x)):
            out.append((str(d), str(keep), len(docs), d == keep and not seen, digest))
            seen |= d == keep
    return sorted(out)


@pytest.mark.parametrize("id_bits", [64, 3])
def test_exact_dedup(spark, id_bits):
    """With 3-bit identifiers nearly all chunks collide, and variants must tell them apart."""
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (1, 20, 300, 300, 2000)]
    texts += [texts[2][:-1] + "?", texts[4] + " x", "x" * 30000, "A. " * 5000, "A. " * 5001, "a\nb", "a\rb", "a b", "a b "]
    rows = [(i, texts[i % len(texts)]) for i in range(40)] + [(50, None), (51, ""), (52, " "), (None, ""), (None, "q"), (None, "q"), (7, texts[7])]
    got = exact_dedup.deduplicate(table(spark, rows), id_bits).collect()
    assert exact_by_hand(rows) == sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got)
    kept = exact_dedup.keep_one(table(spark, rows), id_bits)
    assert kept.columns == table(spark, []).columns
    expected = sorted(t for _, t in {(r[4], r[4]) for r in exact_by_hand(rows) if r[3]})
    assert expected == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in kept.collect())


def test_exact_chunks_cover_the_text(spark):
    rng = random.Random(2)
    for text in (prose(rng, 3000), "x" * 10000, "", "\n" * 9000):
        found = spark.createDataFrame([(text,)], "text string").select(exact_dedup.chunks("text")).first()[0]
        assert "".join(found) == text


def test_exact_empty(spark):
    assert exact_dedup.deduplicate(table(spark, [])).count() == 0
    assert exact_dedup.keep_one(table(spark, [])).count() == 0


def bag(text):
    words = (text or "").encode().split()
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def overlap(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes_by_hand(texts):
    """Component of each distinct text by links of similarity 0.8 or more, and the pairs too near the limit to call."""
    distinct = sorted(set(texts))
    bags = [bag(t) for t in distinct]
    label = list(range(len(distinct)))
    for i in range(len(distinct)):
        for j in range(i):
            if bags[i] and bags[j] and overlap(bags[i], bags[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return dict(zip(distinct, label))


def near_rows():
    rng = random.Random(3)
    rows = []
    for _ in range(25):
        words = prose(rng, rng.choice([8, 30, 60, 150, 400])).split()
        words += [rng.choice("xyz")] * rng.choice([0, 0, 40])
        for _ in range(rng.randint(1, 8)):  # a chain of edits, so that links do not all meet in one text
            rows.append(" ".join(words))
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = prose(rng, 1)
    rows += [rows[0], rows[0], "a b c", "a b c", "a b", "", "", None, "z " * 20000, "z " * 20001]
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(None, rows[0]), (3, rows[3])]


def test_near_dedup(spark):
    rows = near_rows()
    label = classes_by_hand([t or "" for _, t in rows])
    least, size = {}, Counter(label[t or ""] for _, t in rows)
    for d, t in rows:
        if d is not None:
            least[label[t or ""]] = min(d, least.get(label[t or ""], d))
    got = bag_minhash.near_duplicates(table(spark, rows)).collect()
    want = sorted((str(d), least[label[t or ""]], size[label[t or ""]]) for d, t in rows)
    assert want == sorted((str(r.doc_id), r.class_id, r.class_size) for r in got)
    kept = bag_minhash.keep_one(table(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(least.values())


def test_near_dedup_with_repeated_ids(spark):
    """An id may stand for texts of several classes; each class keeps one row."""
    rng = random.Random(9)
    a, b = prose(rng, 50), prose(rng, 50)
    rows = [(5, a), (5, b), (5, b), (6, a + " x"), (None, prose(rng, 50))]
    kept = bag_minhash.keep_one(table(spark, rows))
    assert sorted(r.text for r in kept.collect()) == sorted([a, b, rows[4][1]])


def test_near_dedup_empty(spark):
    assert bag_minhash.near_duplicates(table(spark, [])).count() == 0
    only = bag_minhash.near_duplicates(table(spark, [(None, "a"), (None, None), (4, "")])).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in only) == [("4", "4", 2), ("None", "4", 2), ("None", "None", 1)]


def test_registers_estimate_weighted_overlap():
    """Agreement of registers is unbiased, also for weights above one."""
    rng = random.Random(4)
    texts, want = [], []
    for _ in range(300):
        base = [rng.choice("abcdefghij") for _ in range(100)] + ["z"] * rng.randint(0, 60)
        other = list(base)
        for _ in range(rng.randint(0, 8)):
            other[rng.randrange(len(other))] = "q" + str(rng.random())
        other += ["z"] * rng.randint(0, 60)
        pair = [" ".join(base), " ".join(other)]
        want.append(overlap(*map(bag, pair)))
        texts += [t.encode() for t in pair]
    doc, shingle, weight = bag_minhash.shingles(texts)
    assert weight.max() > 30
    times = bag_minhash.signatures(doc, shingle, weight, len(texts))
    error = (times[::2] == times[1::2]).mean(axis=1) - np.array(want)
    sd = np.sqrt(np.mean([w * (1 - w) for w in want]) / bag_minhash.REGISTERS)
    assert abs(error.mean()) < 4 * sd / np.sqrt(len(want)) and 0.8 * sd < np.sqrt(np.mean(error**2)) < 1.25 * sd


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)]
    label = {n: n for e in edges for n in e}
    for a, b in edges:
        x, y = label[a], label[b]
        label = {n: min(x, y) if v in (x, y) else v for n, v in label.items()}
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert {r.node: r.component for r in got} == {n: label[n] for n in linked} and len(got) == len(linked)


def unspaced(c):
    """Whether the character is of a script that puts no space between words."""
    spans = ["\u0e00\u0eff", "\u1000\u109f", "\u1780\u17ff", "\u3040\u30ff", "\u31f0\u31ff", "\u3400\u4dbf", "\u4e00\u9fff"]
    spans += ["\uf900\ufaff", "\U00020000\U0003ffff"]
    return any(x[0] <= c <= x[1] for x in spans)


def words_by_hand(piece):
    """The words, each with the white space before it; white space at the end is part of none."""
    found, blank, word = [], "", ""
    for c in piece:
        if word and (c.isspace() or unspaced(c)):
            found.append(blank + word)
            blank = word = ""
        if c.isspace():
            blank += c
        elif unspaced(c):
            found.append(blank + c)
            blank = ""
        else:
            word += c
    return found + [blank + word] if word else found


def pieces_by_hand(text, window):
    """Sentences, cut behind the word of least hash of every window, one character and one window at a time."""
    from xxhash import xxh32_intdigest

    plain, wide = ".!?\u2026", "\u3002\uff01\uff1f"
    closing, after = "\"'\u201d\u2019)]\u300d\u300f\uff09", "\"'\u201d\u2019)]\u3002\uff01\uff1f"
    out, at = [], 0
    while at < len(text):
        i = at
        while i < len(text) and text[i] != "\n":
            if text[i] in plain:
                j = i
                while j < len(text) and text[j] in plain:
                    j += 1
                if j < len(text) and not (text[j].isspace() or text[j] in after):
                    i = j
                    continue
            if text[i] in plain + wide:
                while i < len(text) and text[i] in plain + wide:
                    i += 1
                while i < len(text) and text[i] in closing:
                    i += 1
                break
            i += 1
        while i < len(text) and text[i].isspace():
            i += 1
        words = words_by_hand(text[at:i])
        keys = [(xxh32_intdigest(w.strip().lower().encode("utf-8", "surrogatepass")), -k) for k, w in enumerate(words)]
        cuts = {-min(keys[k : k + window])[1] for k in range(len(words) - window + 1)}
        start = at
        for k in sorted(cuts - {len(words) - 1}):
            end = at + sum(map(len, words[: k + 1]))
            out.append(text[start:end])
            start = end
        out.append(text[start:i])
        at = i
    return out


@pytest.mark.parametrize("seed", range(40))
def test_pieces_equal_brute_force(seed):
    rng = random.Random(seed)
    marks = list(".!?\u2026\u3002\uff01\uff1f\"')]\u300d\u201d\n\t ") + [". ", ".\n", "\u4f60", "\u597d", "\u0e01", "\ud800", "A", "1.5"]
    text = "".join(
        rng.choice(marks) if rng.random() < 0.4 else rng.choice([" ", ""]) + rng.choice("abcdefgh") * rng.randint(1, 3)
        for _ in range(rng.choice([5, 60, 600]))
    )
    for window in (sentence_spans.WINDOW, 3):
        assert sentence_spans.sentences(text, window) == pieces_by_hand(text, window)
    assert sentence_spans.n_words(text) == len(words_by_hand(text))


def spans_by_hand(rows, run, least):
    first, covered = {}, {}
    order = sorted({(d is None, d, t) for d, t in rows}, key=lambda x: (x[0], x[1] or 0))
    for _, d, t in order:
        pieces = pieces_by_hand(t or "", sentence_spans.WINDOW)
        normal = [" ".join(p.lower().split()) for p in pieces]
        starts = []
        for i in range(len(pieces) - run + 1):
            key = tuple(normal[i : i + run])
            if first.setdefault(key, (d, t, i)) != (d, t, i):
                starts.append(i)
        inside = {j for i in starts for j in range(i, i + run)}
        left, i = [], 0
        while i < len(pieces):
            j = i
            while j < len(pieces) and (j in inside) == (i in inside):
                j += 1
            if i not in inside or sum(len(words_by_hand(p)) for p in pieces[i:j]) < least:
                left += pieces[i:j]
            i = j
        covered[d, t] = t if len(left) == len(pieces) else "".join(left).rstrip()
    return sorted((str(d), str(covered[d, t])) for d, t in rows)


def test_sentence_spans(spark):
    rng = random.Random(6)

    def sentence(n):
        return prose(rng, n).capitalize() + rng.choice([". ", "! ", ".\n", "? "])

    passages = ["".join(sentence(rng.randint(3, 25)) for _ in range(8)) for _ in range(4)]
    long_one = prose(rng, 60) + ". "
    rows = []
    for i in range(30):
        parts = [sentence(rng.randint(1, 40)) for _ in range(rng.randint(0, 12))] + rng.sample(passages, rng.randint(0, 2))
        if i % 7 == 0:
            parts.append(long_one)
        rng.shuffle(parts)
        rows.append((i, "".join(parts)))
    rows += [(40, passages[0] + passages[0]), (41, None), (42, ""), (43, "A. " * 3000), (44, "a. b. c. d."), (45, "a. b. c. d."), (None, passages[1]), (5, rows[5][1]), (46, "w" * 50000)]
    got = sentence_spans.deduplicate(table(spark, rows)).collect()
    want = spans_by_hand(rows, sentence_spans.RUN, sentence_spans.LEAST)
    assert want == sorted((str(r.doc_id), str(r.text)) for r in got)
    assert sum(r.n_removed for r in got) > 50
    assert sentence_spans.deduplicate(table(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["", "a", "...", 'a.b.c d. "E f." g\n\n\nh! i', "x" * 1000, ". " * 500, "a " * 500, ".a" * 500, "1.5 is (ok.) yes"])
def test_sentences_join_to_the_text(text):
    assert "".join(sentence_spans.sentences(text)) == text


def glued_rows(passages, around, glue):
    """Each passage alone, and run into other words at both ends."""
    rows = [(i, p) for i, p in enumerate(passages)]
    return rows + [(1000 + i, glue.join([around(), p, around()])) for i, p in enumerate(passages)]


def test_sentence_spans_glued_at_both_ends(spark):
    """Passages of over 50 words go, wherever sentences around them begin and end."""
    rng = random.Random(11)
    chinese = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    few = lambda n: " ".join(rng.choice(["the", "of", "a", prose(rng, 1) + "zq"]) for _ in range(n))
    passages = [". ".join(prose(rng, 13) for _ in range(4)) for _ in range(150)]
    passages += [prose(rng, 51) for _ in range(150)] + [few(51) for _ in range(150)]
    rows = glued_rows(passages, lambda: prose(rng, rng.randint(1, 9)), " ")
    east = [chinese(51) for _ in range(50)] + ["。".join(chinese(17) for _ in range(4)) for _ in range(50)]
    rows += [(d + 5000, t) for d, t in glued_rows(east, lambda: chinese(rng.randint(1, 9)), "")]
    got = {r.doc_id: r for r in sentence_spans.deduplicate(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(r.n_removed >= 3 if d % 5000 >= 1000 else r.n_removed == 0 for d, r in got.items())


@pytest.mark.parametrize("text", ["你好。再见！「是。」好 abc。def", "a。b" * 40, "你" * 100 + ".x", "\ud800 " * 30])
def test_unspaced_sentences_join_to_the_text(text):
    assert "".join(sentence_spans.sentences(text)) == text


def test_pieces_follow_full_width_marks():
    assert sentence_spans.sentences("你好。再见！「是。」好") == ["你好。", "再见！", "「是。」", "好"]
    assert sentence_spans.n_words("你好 abc") == 3
