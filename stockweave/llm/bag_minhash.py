"""BagMinHash near-dedup: documents whose multisets of word shingles overlap by 0.8 or more.

Signature. A shingle with weight w owns the stretch [0, w) of a weight axis cut
into nodes [0, 1), [1, 2), [2, 4), [4, 8), ... Each node of a shingle is a Poisson
process whose points come in time order from a seeded hash, as the process is
the same in every document; a point picks a register and a place inside the
node, and counts if that place lies below w. A register keeps its least time. A
process stops once its time passes the largest register. Two documents agree in
a register with the probability of their weighted Jaccard similarity.

Search. Registers are cut into bands; documents that agree in a band are
candidates. Texts stand once, by SHA-256. In each bucket the members are
compared with the most central one, similar ones are joined to components.
The members of buckets that still hold several components then meet in an exact
prefix join: two multisets can only overlap enough if they share one of their
rarest shingles, early enough in both. Each such shingle first compares its nodes
with the most central of them, and then all that are still in different components. So no
link of a bucket is missed, and the pairs of a group are never all formed.
Every link is verified on the whole multisets.

At similarity 0.8, 24 bands of 4 registers miss a pair with probability 3e-6.

Cases: null text counts as empty; empty texts are copies of each other and near
to nothing else; a text of fewer than five words is one shingle; null doc_ids
are allowed (a class takes the least non-null id); repeated rows are members
like others; empty tables give empty results; other columns are ignored
or, by ``keep_one``, returned as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.batches import slices
from stockweave.llm.common import join_same, packed, unpacked
from stockweave.llm.graph import compact, components
from stockweave.session import cut_lineage

WORDS = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 4
REGISTERS = BANDS * ROWS
#: A pair is compared only if this share of registers agrees; at similarity 0.8 fewer agree with probability 1e-12.
AGREE = 0.5
SEED = 0x5EED
SLICE_BYTES = 2_000_000
#: Bags per file of the table of multisets.
FILE_BAGS = 5_000
#: Size of the table that keeps texts without candidates from the shuffle.
SLOTS = 1 << 18
GOLD = np.uint64(0x9E3779B97F4A7C15)


def golden(n: int) -> np.uint64:
    """The n-th step of a full-period sequence of 64-bit numbers."""
    return np.uint64(n * int(GOLD) % (1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of all texts, sorted by document and shingle."""
    from xxhash import xxh3_64_intdigest

    split = [t.split() for t in texts]  # bytes split at the white space of the word contract
    counts = np.fromiter(map(len, split), np.int64, len(split))
    hashes = np.fromiter((xxh3_64_intdigest(w) for ws in split for w in ws), np.uint64, int(counts.sum()))
    del split
    padded = np.concatenate([hashes, np.zeros(WORDS, np.uint64)])
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(len(hashes))  # words from here to the end of the document
    whole = np.zeros(len(hashes), np.uint64)
    for i in range(WORDS):
        whole += np.where(left > i, padded[i : i + len(hashes)] * golden(2 * i + 1), np.uint64(0))
    first = np.arange(len(hashes)) == np.repeat(ends - counts, counts)
    doc = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    stay = (left >= WORDS) | first
    doc, whole = doc[stay], mix(whole[stay])
    bounds = np.searchsorted(doc, np.arange(len(counts) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        whole[a:b].sort()
    if not len(whole):
        return doc, whole, np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], (whole[1:] != whole[:-1]) | (doc[1:] != doc[:-1])]))
    return doc[start], whole[start], np.diff(np.concatenate([start, [len(whole)]]))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """The register times of each document; infinite for a document without shingles."""
    times = np.full((n_docs, REGISTERS), np.inf)
    flat = times.ravel()
    limit = np.full(n_docs, np.inf)
    of, seed, low, length, most = [], [], [], [], []
    for level in range(int(weight.max(initial=0)).bit_length() + 1):
        begin = 0 if level == 0 else 1 << (level - 1)
        at = np.flatnonzero(weight > begin)
        if not at.size:
            break
        of.append(doc[at])
        seed.append(mix(shingle[at] + golden(SEED + level)))
        low.append(np.full(at.size, begin, np.int64))
        length.append(np.full(at.size, max(1, begin), np.float64))
        most.append(weight[at])
    if not of:
        return times
    of, seed, low, length, most = (np.concatenate(x) for x in (of, seed, low, length, most))
    time, step = np.zeros(len(of)), 0
    while of.size:
        step += 1
        draw = mix(seed + golden(step))
        time = time - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / (REGISTERS * length)
        alive = time < limit[of]
        if not alive.all():
            of, seed, low, length, most, time, draw = (
                x[alive] for x in (of, seed, low, length, most, time, draw)
            )
        second = mix(draw + GOLD)
        register = ((second >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
        place = low + ((second & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * length).astype(np.int64)
        inside = place < most
        np.minimum.at(flat, of[inside] * REGISTERS + register[inside], time[inside])
        if of.size:
            # The processes of a document stand together per level only, so documents are found by marking.
            marked = np.zeros(n_docs, bool)
            marked[of] = True
            touched = np.flatnonzero(marked)
            limit[touched] = times[touched].max(axis=1)
            on = time < limit[of]
            if not on.all():
                of, seed, low, length, most, time = (x[on] for x in (of, seed, low, length, most, time))
    return times


def bands(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document the band keys and a short hash of each register."""
    bits = mix(times.view(np.uint64))
    keys = np.zeros((len(times), BANDS), np.uint64)
    grouped = bits.reshape(len(times), BANDS, ROWS)
    for r in range(ROWS):
        keys = mix(keys + grouped[:, :, r])
    keys = mix(keys + np.arange(BANDS, dtype=np.uint64) * GOLD)
    return keys.view(np.int64), (bits >> np.uint64(48)).astype(np.uint16).view(np.int16)


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]


def _lists(rows: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    width = values.shape[1]
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).ravel(), kind))


def sign(texts: DataFrame) -> DataFrame:
    """(doc_id, node, weight, keys, registers) from (doc_id, node, text); keys are empty for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                doc, shingle, weight = shingles(_texts(part))
                n = len(part)
                total = np.bincount(doc, weight, n).astype(np.int64)
                keys, registers = bands(signatures(doc, shingle, weight, n))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("node"),
                        pa.array(total),
                        _lists(n, keys, pa.int64()),
                        _lists(n, registers, pa.int16()),
                    ],
                    names=["doc_id", "node", "weight", "keys", "registers"],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "node", "text").mapInArrow(
        run, f"doc_id {kind}, node binary, weight long, keys array<long>, registers array<short>"
    )


def bags(texts: DataFrame) -> DataFrame:
    """(node, bag): the multiset of shingles as distinct numbers, one per occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                doc, shingle, weight = shingles(_texts(part))
                nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
                item = mix(np.repeat(shingle, weight) + nth.astype(np.uint64) * GOLD)
                sizes = np.bincount(doc, weight, len(part)).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node"),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(item.view(np.int64))),
                    ],
                    names=["node", "bag"],
                )

    return texts.select("node", "text").mapInArrow(run, "node binary, bag array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``node``, 128 bits of the SHA-256 of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("node"), text.alias("text"))


def _promising(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) that can reach the similarity by size and whose registers agree often enough."""
    side = nodes.select("node", "weight", "registers")
    left = side.withColumnsRenamed({"node": "a", "weight": "wa", "registers": "ra"})
    right = side.withColumnsRenamed({"node": "b", "weight": "wb", "registers": "rb"})
    agree = F.aggregate(
        F.zip_with("ra", "rb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x
    )
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(F.least("wa", "wb") >= F.lit(SIMILARITY) * F.greatest("wa", "wb"))
        .where(agree >= F.lit(AGREE * REGISTERS))
        .select("a", "b")
    )


def _verified(pairs: DataFrame, bag: DataFrame) -> DataFrame:
    """The pairs whose multisets overlap by the similarity or more."""
    left, right = bag.withColumnsRenamed({"node": "a", "bag": "x"}), bag.withColumnsRenamed({"node": "b", "bag": "y"})
    common = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("both"))
        .where(F.col("common") >= F.lit(SIMILARITY) * (F.col("both") - F.col("common")))
        .select("a", "b")
    )


def _early(open_nodes: DataFrame, bag: DataFrame) -> DataFrame:
    """(node, met, n, at, item): the rarest shingles of each node, of those that another node has too.

    With shingles in order of frequency, two multisets of n and m that overlap by the similarity s share
    one at places i and j with min(n - i, m - j) >= s / (1 + s) * (n + m), and both places lie in the
    first n - ceil(s n) + 1.
    """
    entries = bag.join(open_nodes, "node").select(
        "node", "met", F.size("bag").alias("n"), F.explode("bag").alias("item")
    )
    often = cut_lineage(entries.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    ranked = (
        entries.join(often, "item", "left")
        .groupBy("node", "met", "n")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "item"))).alias("items"))
    )
    length = (F.col("n") - F.ceil(F.lit(SIMILARITY) * F.col("n") - 1e-6) + 1).cast("int")
    return cut_lineage(
        ranked.select("node", "met", "n", F.posexplode(F.slice("items", F.lit(1), length)).alias("at", "x"))
        .where("x.df > 1")
        .select("node", "met", "n", "at", "x.item")
    )


def _open_early(early: DataFrame, label: DataFrame) -> DataFrame:
    """``early`` with components, of the shingles whose nodes are in different components."""
    labelled = early.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("item").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y")
    return cut_lineage(labelled.join(cut_lineage(mixed.select("item")), "item"))


def _meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of nodes of different components that share an early shingle and can overlap enough."""
    other = right.select(
        "item",
        F.col("node").alias("b"),
        F.col("n").alias("m"),
        F.col("at").alias("place"),
        F.col("component").alias("other"),
    )
    enough = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("place")) >= F.lit(SIMILARITY / (1 + SIMILARITY)) * (
        F.col("n") + F.col("m")
    ) - F.lit(1e-6)
    return left.join(other, "item").where(enough & F.expr("component != other")).select(F.col("node").alias("a"), "b")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signed, component): all documents with their node, and (node, component) of nodes that have a near copy."""
    keyed = _keyed(docs)
    signed = cut_lineage(sign(keyed))
    nodes = cut_lineage(signed.where("weight > 0").drop("doc_id").dropDuplicates(["node"]))
    members = nodes.select("node", F.explode("keys").alias("key"))
    shared = cut_lineage(members.groupBy("key").agg(F.count(F.lit(1)).alias("in_bucket")).where("in_bucket > 1"))
    rows = shared.agg(F.sum("in_bucket")).first()[0] or 0
    buckets = compact(members.join(shared, "key"), rows)
    # Texts in the middle of a group meet most others, so they make the best representatives.
    central = compact(buckets.groupBy("node").agg(F.sum("in_bucket").alias("met")), rows)
    buckets = compact(buckets.join(central, "node").select("key", "node", "met"), rows)
    first = compact(buckets.groupBy("key").agg(F.max(F.struct("met", "node")).alias("first")), rows)
    candidates = compact(buckets.select("node").distinct(), rows)
    files = 1 + candidates.count() // FILE_BAGS
    # Most texts are no candidates. A table of at most SLOTS numbers keeps them from being shuffled; what passes
    # by chance falls to the join behind it, which is never broadcast, as candidates grow with the corpus.
    slot = F.pmod(F.xxhash64("node"), F.lit(SLOTS))
    slots = compact(candidates.select(slot.alias("slot")).distinct(), rows)
    exactly = candidates.hint("merge")

    def of_candidates(df: DataFrame) -> DataFrame:
        likely = df.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").drop("slot")
        # Each task first reduces the copies it reads to one, so those of a large group never meet in one task.
        return likely.dropDuplicates(["node"]).join(exactly, "node")

    bag = cut_lineage(bags(of_candidates(keyed.select("node", "text"))).coalesce(files))
    near = cut_lineage(of_candidates(nodes.select("node", "weight", "registers")).coalesce(files))

    def joined(pairs: DataFrame, label: DataFrame | None) -> DataFrame:
        """The components with the links among ``pairs``; what is known goes on as stars and settles at once."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = _verified(compact(_promising(pairs, near), rows), bag)
        if label is not None:
            found = found.unionAll(label.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return compact(components(found), rows)

    # Members of a bucket against the most central of it.
    pairs = buckets.join(first, "key").where("node != first.node")
    label = joined(pairs.select(F.col("first.node").alias("a"), F.col("node").alias("b")), None)
    # Buckets that still hold several components: members that share an early shingle, first against the
    # most central of its nodes, then against all of other components.
    labelled = buckets.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y")
    open_nodes = compact(buckets.join(compact(split.select("key"), rows), "key").select("node").distinct(), rows)
    early = _early(open_nodes.join(central, "node"), bag)
    entries = _open_early(early, label)
    order = F.struct("met", "node", "n", "at", "component")
    stars = cut_lineage(entries.groupBy("item").agg(F.max(order).alias("x"))).select("item", "x.*")
    label = joined(_meeting(entries, stars), label)
    entries = _open_early(early, label)
    return signed, joined(_meeting(entries, entries).where("a < b"), label)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), class_size, n_texts (different
    texts of the class) and kept (the row whose doc_id is class_id; of rows that repeat it, all)."""
    signed, component = links(docs)
    rows = cut_lineage(
        signed.select("doc_id", "node").join(component, "node", "left").select(
            "doc_id", "node", F.coalesce("component", "node").alias("component")
        )
    )
    of_text = rows.groupBy("component", "node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = cut_lineage(
        of_text.groupBy("component").agg(
            F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("n_texts")
        )
    )
    return rows.join(classes, "component").select(
        "doc_id",
        "class_id",
        "class_size",
        "n_texts",
        F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"),
        "node",
        "component",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, with the columns of ``docs``."""
    kept = (
        near_duplicates(docs)
        .where("kept")
        .groupBy("doc_id", "component", "node")
        .agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("doc_id", "component")
        .agg(F.min(F.struct("node", "copies")).alias("x"))
        .select("doc_id", "x.*")
    )
    node = F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16)
    joined = join_same(packed(docs, "doc_id", "text").withColumn("node", node), kept, ["doc_id", "node"])
    once = joined.where("copies = 1")
    # Rows that repeat doc_id and text: the first of the other columns stays.
    again = joined.where("copies > 1").dropDuplicates(["doc_id", "node"])
    return unpacked(once.unionAll(again), docs, "doc_id", "text")
