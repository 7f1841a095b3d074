"""N-gram Jaccard join with Bayesian candidate pruning.

Texts whose sets of five-word shingles have a Jaccard similarity of at least the
threshold are linked. Equal word sequences are one node, so copies never become pairs.
Bands of MinHash values bring nodes together; a pair's values are compared in steps,
and it is dropped once the posterior probability (uniform prior, binomial likelihood)
that its similarity reaches the threshold is below the tolerance. What is left is verified
on the whole shingle sets.

No task holds an unbounded group: buckets and components are cut into chunks of bounded
size, and pairs of chunks are the unit of work. Pairs are counted where they are found and
never become rows. Texts never leave their place but for those of the nodes that have a candidate, once, as
sets of shingle hashes; each set then becomes its difference from that of one node of its component, and only those
differences are copied for the pairs of chunks: the sizes of intersections follow from them exactly. Keys that a
thousandth of the rows or more share are joined by broadcast. With the defaults a pair at similarity 0.8 is missed by
all bands with probability 4e-7, and pruned with probability about 4e-6.

Null, empty and word-free texts link to nothing: they are classes of their own with 0 links.
Texts under five words have one shingle, all their words. Repeated rows are copies of each
other. Ties need no rule: the class id is the smallest doc_id of the class. A row with a null doc_id takes part
like any other; its class id is null only if no row of its class has a doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.llm.common import bit_filter, by_group, cut, hot_join, hot_of, id_text, slices, with_hit
from lumisift.llm.graph import components
from lumisift.llm.words import grams, mix, word_hashes

SHINGLE_WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, BAND_ROWS = 28, 4
VALUES = BANDS * BAND_ROWS
#: MinHash values compared before each decision to prune.
STEPS = (16, 32, 64, VALUES)
#: Members of a bucket, and of a component, that one side of a task holds at most, about; and hashes of their shingles.
BUCKET_CHUNK, COMPONENT_CHUNK, CHUNK_HASHES = 4096, 512, 1 << 21
_SEEDS = mix(np.arange(1, VALUES + 1, dtype=np.uint64))
_TIMES, _PLUS = (_SEEDS >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_SEEDS & np.uint64(0xFFFFFFFF)).astype(np.uint32)


@cache
def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """Fewest equal values of so many compared for which P(similarity >= threshold) is not below the tolerance."""
    below = 0.0
    for m in range(compared + 1):
        below += comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if below >= tolerance:
            return m
    return compared


def minhash(shingles: np.ndarray) -> np.ndarray:
    x, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(VALUES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 1024):
        h = x[at : at + 1024, None] * _TIMES + _PLUS
        np.minimum(out, (h ^ (h >> np.uint32(15))).min(axis=0), out=out)
    return out


def short(values: np.ndarray) -> np.ndarray:
    return (values ^ (values >> np.uint32(16))).astype(np.uint16)


def band_keys(values: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in values.reshape(BANDS, BAND_ROWS).T:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + row)
    return out.view(np.int64)


def survivors(values: np.ndarray, one: int, others: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Those of the others that are not pruned against the one."""
    same, done = np.zeros(len(others), dtype=np.int64), 0
    for upto in STEPS:
        same = same + (values[others, done:upto] == values[one, done:upto]).sum(axis=1)
        keep = same >= least_matches(upto, threshold, tolerance)
        others, same, done = others[keep], same[keep], upto
        if not len(others):
            break
    return others


def shingles_of(text: str | None) -> tuple[bytes | None, np.ndarray]:
    """The key of the text's words, None if there are none, and its shingles as they stand."""
    words = word_hashes(text)[0]
    if not len(words):
        return None, words
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest(), grams(words, SHINGLE_WORDS)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        key, sig, bands, size = [], [], [], []
        for text in batch.column("text").to_pylist():
            own, shingles = shingles_of(text)
            key.append(own), size.append(len(shingles))
            if own is None:
                sig.append(None), bands.append(None)
                continue
            values = minhash(shingles)
            sig.append(short(values).tobytes())
            bands.append(band_keys(values))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "at", "also")), pa.array(key, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(size, pa.int64())], names=["doc_id", "at", "also", "key", "sig", "bands", "size"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = {}
        for text in batch.column("text").to_pylist():
            key, shingles = shingles_of(text)
            if key is not None:
                found[key] = np.unique(shingles).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([*found], pa.binary()), pa.array([*found.values()], pa.binary())], names=["key", "shingles"])


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _bucket(threshold: float, tolerance: float):
    def of(_: tuple, rows: pa.Table) -> Iterable[pa.RecordBatch]:
        """The parts that pairs which are not pruned join, each node with the smallest of its part: what is already joined isn't compared again, and buckets of the same nodes give the same rows."""
        keys = rows.column("key").to_pylist()
        values = np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=np.uint16).reshape(len(keys), VALUES)
        rest, found = np.arange(len(keys)), []
        while len(rest) > 1:
            todo, part, rest = [rest[0]], [rest[0]], rest[1:]
            while todo and len(rest):
                near = survivors(values, todo.pop(), rest, threshold, tolerance)
                if len(near):
                    part += near.tolist()
                    todo += near.tolist()
                    rest = np.setdiff1d(rest, near, assume_unique=True)
            first = min(keys[x] for x in part)
            found += [(keys[x], first) for x in part if keys[x] != first]
        if found:
            yield _edges(found)

    return of


def _differences(_: tuple, rows: pa.Table) -> Iterable[pa.RecordBatch]:
    """Each node's shingles as those by which they differ from the first node's of the component, and how many of them are its own."""
    keys, sets, first = rows.column("key").to_pylist(), rows.column("shingles").to_pylist(), rows.column("is_first").to_pylist()
    # a first node that no row gave can't be: it has a row like any other
    base = np.frombuffer(sets[first.index(True)], dtype=np.uint64)
    at = [i for i in {k: i for i, k in reversed(list(enumerate(keys))) if not first[i]}.values()]  # repeated rows give a set more than once
    apart, more, size = [], [], []
    for i in at:
        own = np.frombuffer(sets[i], dtype=np.uint64)
        new = np.setdiff1d(own, base, assume_unique=True)
        apart.append(np.concatenate([new, np.setdiff1d(base, own, assume_unique=True)]).tobytes()), more.append(len(new)), size.append(len(own))
    kept = rows.take(pa.array(at, pa.int64())).combine_chunks()
    yield from pa.Table.from_arrays([*(kept.column(c) for c in ("label", "key", "copies", "sig")), pa.array(size, pa.int64()), pa.array(apart, pa.binary()), pa.array(more, pa.int64())], names=["label", "key", "copies", "sig", "size", "apart", "more"]).to_batches()


def _verified(threshold: float, tolerance: float):
    def of(block: tuple, rows: pa.Table) -> Iterable[pa.RecordBatch]:
        """Links of each node inside one pair of chunks, and each linked node with the smallest of its part."""
        _, first, second = block
        keys = rows.column("key").to_pylist()
        if len(keys) < 2:
            return
        copies, side, sizes, more = (rows.column(c).to_numpy().astype(np.int64) for c in ("copies", "chunk", "size", "more"))
        values = np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=np.uint16).reshape(len(keys), VALUES)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("apart").to_pylist()]
        lengths = np.array([len(s) for s in sets])
        less = lengths - more
        ends = np.cumsum(lengths)
        starts = ends - lengths
        local = np.unique(np.concatenate(sets), return_inverse=True)[1]
        mark = np.zeros(len(local) + 1, dtype=bool)
        links, root = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys))
        for i in range(len(keys)):
            others = np.arange(i + 1, len(keys))
            if first != second:
                others = others[side[others] != side[i]]
            others = others[np.minimum(sizes[others], sizes[i]) >= threshold * np.maximum(sizes[others], sizes[i]) - 1e-9]
            others = survivors(values, i, others, threshold, tolerance)
            if not len(others):
                continue
            own = local[starts[i] : ends[i]]
            mark[own] = True
            if 4 * lengths[others].sum() < len(local):
                shared = np.array([mark[local[starts[j] : ends[j]]].sum() for j in others])
            else:
                total = np.concatenate([[0], np.cumsum(mark[local])])
                shared = total[ends[others]] - total[starts[others]]
            mark[own] = False
            # what both keep of the first node's set, and what both add to it or leave out of it alike
            both = sizes[i] - more[i] - less[others] + shared
            others = others[both >= threshold * (sizes[i] + sizes[others] - both) - 1e-9]
            links[i] += copies[others].sum()
            links[others] += copies[i]
            for r in np.unique(root[others]):
                if r != root[i]:
                    root[root == r] = root[i]
        linked = np.flatnonzero(links)
        if len(linked):
            least: dict[int, bytes] = {}
            for i in linked:
                least[root[i]] = min(keys[i], least.get(root[i], keys[i]))
            tree = [(keys[i], least[root[i]]) for i in linked if keys[i] != least[root[i]]]
            a = [keys[i] for i in linked] + [x for x, _ in tree]
            b = [None] * len(linked) + [x for _, x in tree]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(links[linked].tolist() + [0] * len(tree), pa.int64())], names=["a", "b", "links"])

    return of


def _chunks(n: str, size: str, most: int) -> Column:
    return F.greatest(F.ceil(F.col(n) / most), F.ceil(F.col(size) / CHUNK_HASHES), F.lit(1)).cast("int")


def _dealt(members: DataFrame) -> DataFrame:
    return members.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))


def _paired(members: DataFrame) -> DataFrame:
    """A row for each pair of chunks that a member takes part in; one where the group is one chunk."""
    each = _dealt(members).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return each.withColumns({"first": F.least("chunk", "other"), "second": F.greatest("chunk", "other")}).drop("chunks", "other")


def _places(docs: DataFrame) -> DataFrame:
    """docs with two hashes that tell where a row's text is: rows share both only if they share doc_id and text."""
    return docs.withColumns({"at": F.xxhash64("doc_id", "text"), "also": F.hash("text", "doc_id")})


def _classes(docs: DataFrame, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Every row: doc_id, at, also, key; and of the keys of more than one row or with a link: key, copies, first (of the class: doc_id, at, also), n_links."""
    docs = _places(id_text(docs))
    signed = cut(docs.mapInArrow(_signed, "doc_id long, at long, also int, key binary, sig binary, bands array<long>, size long"))
    nodes = cut(signed.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "at", "also")).alias("first"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("size").alias("size")))
    n = nodes.count()

    entries = nodes.select("key", F.explode("bands").alias("band"))
    full = entries.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("who")).where("n > 1")
    # buckets of the same nodes are one piece of work
    full = cut(full.groupBy("who", "n").agg(F.min("band").alias("band")).select("band", "n"))
    members = hot_join(entries, full, hot_of(full, "n", n), "band").select("key", "band", F.ceil(F.col("n") / BUCKET_CHUNK).cast("int").alias("chunks"))
    members = _paired(members).join(nodes.select("key", "sig"), "key")
    near = by_group(members.select("band", "first", "second", "key", "sig"), ["band", "first", "second"], _bucket(threshold, tolerance), "a binary, b binary")

    part_of = cut(components(near).withColumnRenamed("node", "key").join(nodes.select("key", "first", "copies", "sig", "size"), "key"))
    size = cut(part_of.groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("hashes")))
    inside = hot_join(part_of.drop("first"), size, hot_of(size, "n", n), "label").withColumn("chunks", _chunks("n", "hashes", COMPONENT_CHUNK)).drop("n", "hashes")
    # only rows whose text is some node's may pass the filter; those of no node match no key
    wanted = bit_filter(part_of, "first.at")
    sets = with_hit(docs, F.col("at"), wanted, "wanted").where("wanted").select("text").mapInArrow(_sets, "key binary, shingles binary")
    held = cut(_dealt(inside.join(sets, "key")).withColumn("is_first", F.lit(False)))
    bases = held.where("key = label").dropDuplicates(["key"]).withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "is_first": F.lit(True)})
    apart = by_group(held.unionByName(bases).drop("chunks", "size"), ["label", "chunk"], _differences, "label binary, key binary, copies long, sig binary, size long, apart binary, more long")
    apart = cut(apart)
    size = cut(apart.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("apart") / 8).alias("hashes")))
    blocks = _paired(hot_join(apart, size, hot_of(size, "n", n), "label").withColumn("chunks", _chunks("n", "hashes", COMPONENT_CHUNK)).drop("n", "hashes"))
    checked = cut(by_group(blocks, ["label", "first", "second"], _verified(threshold, tolerance), "a binary, b binary, links long"))

    links = checked.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    joined = components(checked.where("b is not null")).withColumnRenamed("node", "key")
    firsts = cut(joined.join(nodes.select("key", "first"), "key").groupBy("label").agg(F.min("first").alias("first"), F.count("*").alias("n")))
    named = hot_join(joined, firsts, hot_of(firsts, "n", n), "label").select("key", F.col("first").alias("of_class"))
    known = nodes.select("key", "first", "copies").join(named, "key", "left").join(links, "key", "left").where("copies > 1 or of_class is not null")
    known = cut(known.select("key", "copies", F.coalesce("of_class", "first").alias("first"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    return signed.select("doc_id", "at", "also", "key"), known


def similar_groups(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, class_id (smallest doc_id of all texts that links join), n_links (rows that it is linked to)."""
    rows, known = _classes(docs, threshold, tolerance)
    out = hot_join(rows.select("doc_id", "key"), known, hot_of(known, "copies", rows.count()), "key", "left")
    return out.select("doc_id", F.coalesce("first.doc_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """docs without the rows that are not the first of their class; all columns stay.

    The first is the one with the smallest doc_id, one without doc_id only if all are; rows of different texts that share a
    doc_id are told apart. Of rows that share doc_id and text one stays, the one whose columns come first as JSON.
    Texts without words are no copies of one another: all their rows stay. Rows that the filter of
    what goes or is repeated can't hold stay in place; only the others are shuffled.
    """
    rows, known = _classes(docs, threshold, tolerance)
    placed = hot_join(rows.where("key is not null"), known, hot_of(known, "copies", rows.count()), "key")
    stays = (F.col("at") == F.col("first.at")) & (F.col("also") == F.col("first.also"))
    decided = cut(placed.groupBy("at", "also", stays.alias("stays")).agg(F.count("*").alias("n")).where("not stays or n > 1").select("at", "also", "stays"))
    end = "_" * (1 + max(map(len, docs.columns)))  # no column ends so
    own = {f"at{end}": F.xxhash64(F.col("doc_id").try_cast("long"), F.col("text").cast("string")), f"also{end}": F.hash(F.col("text").cast("string"), F.col("doc_id").try_cast("long"))}
    met = with_hit(docs.withColumns(own), F.col(f"at{end}"), bit_filter(decided, "at"), f"met{end}")
    told = decided.select(F.col("at").alias(f"at{end}"), F.col("also").alias(f"also{end}"), F.col("stays").alias(f"stays{end}"))
    found = met.where(f"`met{end}`").join(told, [f"at{end}", f"also{end}"], "left")
    kept = met.where(f"not `met{end}`").select(docs.columns).union(found.where(f"`stays{end}` is null").select(docs.columns))
    if decided.where("stays").limit(1).count():
        whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        once = found.where(f"`stays{end}`").groupBy(f"at{end}", f"also{end}").agg(F.min_by(whole, F.to_json(whole)).alias(f"row{end}"))
        kept = kept.union(once.select(*(F.col(f"row{end}")[c].alias(c) for c in docs.columns)))
    return kept
