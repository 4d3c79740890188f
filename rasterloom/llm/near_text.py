"""Near-duplicate texts by SimHash candidates and a check of the similarity itself.

Fingerprints of at most four differing bits find only a part of the texts whose word shingles are 0.8 alike: at that
similarity the 64 bits differ in about ten places. So each text also has anchors, the least shingle under each of
several hash orders, and texts that share an anchor are candidates too. What decides is the Jaccard similarity of the
sets of five-word shingles of the texts themselves: signatures (128 least values, a byte each) only leave out candidates
in clear disagreement, and the links left join candidates to families. The texts of a family are compared with each other
until no similar ones are left apart (see family_links for large families).

Defined cases: texts are compared by their words in lower case (A-Z), so texts without a word are all alike; a text of
fewer words than a shingle is one shingle; rows with equal words form one group, and of repeated rows one stays; a null
doc_id comes after all others; an empty table gives an empty result. Columns besides doc_id and text pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import CUT_TEXTS, CUT_WIDE_ROWS, broadcast_if_small, cut
from .components import connected

SHINGLE, SIMILARITY = 5, 0.8
#: Hash orders of a signature, and how many of them give an anchor.
PLACES, ANCHORS = 128, 8
#: Agreement of signatures from which a search goes on through a pair at once, and below which a pair is no candidate: five
#: deviations below 0.8, where of pairs at that similarity about one in a million falls, no more than share no anchor (0.2 ** 8).
CLOSE, UNLIKE = 0.87, 0.62
KEY_ROWS = 16_384
#: A family's texts are dealt into chunks of about so many bytes, and a task of the search holds two at most; and so many texts
#: stand for each component where components of different chunks are first compared.
CHUNK, PROXIES = 2_000_000, 8
_ODD = np.random.default_rng(2_024).integers(1, 1 << 62, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(2_025).integers(0, 1 << 62, PLACES, dtype=np.uint64)


def shingles(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's k-word shingles, repeats included; at least one if there is a word."""
    if not words:
        return np.empty(0, np.uint64)
    each = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) > k else iter([b" ".join(words)])
    return np.fromiter(map(xxhash.xxh64_intdigest, each, repeat(42)), np.uint64, max(1, len(words) - k + 1))


def least(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set of hashes under each hash order."""
    out = np.full(PLACES, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 256):
        x = hashes[at : at + 256, None] * _ODD + _ADD
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(out, x.min(0), out=out)
    return out


def describe(docs: DataFrame) -> DataFrame:
    """id, text_hash, node (of the words), fp, anchors and signature of every row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, anchors, signs = [], [], [], []
            for x in batch.column(2):
                words = (x.as_py() or b"").lower().split()
                h = shingles(words)
                nodes.append(xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63))
                fps.append(simhash.majority(h))
                low = least(h)
                anchors.append((low[:ANCHORS] ^ np.arange(ANCHORS, dtype=np.uint64)).view(np.int64))
                signs.append((low >> np.uint64(24)).astype(np.uint8).tobytes())
            cols = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(anchors, pa.list_(pa.int64())), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "node", "fp", "anchors", "signature"])

    chosen = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return chosen.mapInArrow(made, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, text_hash long, node long, fp long, anchors array<long>, signature binary")


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).mean(-1)


def _search(nodes: np.ndarray, signs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) within one group, fewer than it has members: a search takes close ones out, and what it does
    not reach is joined by the link of closest agreement, so that the links are a greatest spanning forest. They join
    all that candidates join, but say nothing of which candidates are alike: see the search in families."""
    if not len(nodes):
        return
    left, queue = np.arange(1, len(nodes)), [0]
    best, source = np.zeros(len(nodes)), np.zeros(len(nodes), np.int64)
    while len(left):
        if not queue:
            k = int(best[left].argmax())
            q = int(left[k])
            left = np.delete(left, k)
            if best[q] >= UNLIKE:
                yield nodes[source[q] : source[q] + 1], nodes[q : q + 1]
            queue.append(q)
            continue
        q = queue.pop()
        near = _alike(signs[left], signs[q])
        close = near >= CLOSE
        if close.any():
            yield np.full(int(close.sum()), nodes[q]), nodes[left[close]]
            queue += left[close].tolist()
            left, near = left[~close], near[~close]
        closer = near > best[left]
        best[left[closer]], source[left[closer]] = near[closer], q


def links_in(keys: np.ndarray, nodes: np.ndarray, signs: np.ndarray, small: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within each run of equal keys."""
    edge = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(keys)]])
    lengths = ends - starts
    at = np.flatnonzero(np.repeat((lengths > 1) & (lengths <= small), lengths))
    for step in range(1, small):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        hit = _alike(signs[at], signs[at + step]) >= UNLIKE
        yield nodes[at[hit]], nodes[at[hit] + step]
    for run in np.flatnonzero(lengths > small):
        yield from _search(nodes[starts[run] : ends[run]], signs[starts[run] : ends[run]])


def anchor_links(classes: DataFrame, key_rows: int = KEY_ROWS, most: int | None = None) -> DataFrame:
    """(a, b): links between classes (node, anchors, signature) that share an anchor."""
    explode = lambda df: df.select(F.explode("anchors").alias("key"), "node", "signature")
    keyed = simhash.split_heavy(explode(classes), explode(classes.filter(simhash.sampled("node"))).select("key", "node"), "node", key_rows, most and ANCHORS * most)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(rows).combine_chunks()
            keys, nodes = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            signs = np.frombuffer(b"".join(whole.column(2).to_pylist()), np.uint8).reshape(-1, PLACES)
            for a, b in links_in(keys, nodes, signs):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:  # the last run of a batch waits for the next
            keys = batch.column(0).to_numpy()
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if held and (last > 0 or held[-1].column(0)[-1].as_py() != keys[0]):
                yield from told([*held, batch.slice(0, last)])
                held = []
            elif last > 0:
                yield from told([batch.slice(0, last)])
            held.append(batch.slice(last))
        if held:
            yield from told(held)

    links = keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(linked, "a long, b long")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def fingerprint_links(classes: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b): classes whose fingerprints differ in at most four bits, joined to the first class of each fingerprint."""
    firsts = cut(classes.groupBy("fp").agg(F.min("node").alias("first")), most)
    same = classes.join(firsts, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = simhash.link(firsts, most=most).withColumnRenamed("a", "fa").withColumnRenamed("b", "fb")
    name = lambda fp, n: firsts.select(F.col("fp").alias(fp), F.col("first").alias(n))
    return same.unionByName(near.join(name("fa", "a"), "fa").join(name("fb", "b"), "fb").select("a", "b")).filter("a <> b").distinct()


def search_texts(nodes: np.ndarray, texts: list[bytes], similarity: float = SIMILARITY, comps: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) between texts that are similar enough, until no two such texts are left apart. Texts of one component (comps) count as linked already."""
    sets = [np.unique(shingles(t.lower().split())) for t in texts]
    sizes = np.array([len(x) for x in sets])
    known, ids, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(known), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(known))  # the rarest first
    of = [np.sort(x) for x in np.split(rank[ids], np.cumsum(sizes)[:-1])]
    # similar sets share one of the rarest shingles of each: all but the fewest that they must have in common, and one more
    first = sizes - np.ceil(similarity * sizes - 1e-6).astype(np.int64) + 1
    keys = np.concatenate([x[:n] for x, n in zip(of, first, strict=True)])
    owners = np.repeat(np.arange(len(nodes)), np.minimum(first, sizes))
    order = np.argsort(keys, kind="stable")
    owners, starts = owners[order], np.searchsorted(keys[order], np.arange(len(known) + 1))
    left, mark = np.ones(len(nodes), bool), np.zeros(len(known), bool)
    rest = len(nodes)
    mates = np.argsort(comps, kind="stable") if comps is not None else None
    spans = (np.searchsorted(comps[mates], comps, "left"), np.searchsorted(comps[mates], comps, "right")) if comps is not None else None

    def taken(found: np.ndarray) -> list[int]:
        """found, with all of their components, which are no longer left."""
        nonlocal rest
        if mates is not None:
            _, one = np.unique(comps[found], return_index=True)
            found = np.concatenate([mates[spans[0][k] : spans[1][k]] for k in found[one]])
        left[found] = False
        rest -= len(found)
        return found.tolist()

    for start in range(len(nodes)):
        if not left[start]:
            continue
        queue = taken(np.array([start]))
        while queue and rest:
            q = queue.pop()
            met = [owners[starts[k] : starts[k + 1]] for k in of[q][: first[q]]]
            near = np.unique(np.concatenate([x[left[x]] for x in met])) if met else np.empty(0, np.int64)
            near = near[np.minimum(sizes[near], sizes[q]) >= similarity * np.maximum(sizes[near], sizes[q]) - 1e-6]
            if not len(near):
                continue
            mark[of[q]] = True
            both = np.array([np.count_nonzero(mark[of[m]]) for m in near])
            mark[of[q]] = False
            hit = near[both >= similarity * (sizes[near] + sizes[q] - both)]
            if len(hit):
                yield np.full(len(hit), nodes[q]), nodes[hit]
                queue += taken(hit)


def _searched(dealt: DataFrame, similarity: float) -> DataFrame:
    """(a, b): what search_texts finds among the rows (key, node, comp, text) of each key."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def told() -> Iterator[pa.RecordBatch]:
            nodes, comps, of = zip(*held, strict=True)
            for a, b in search_texts(np.array(nodes), list(of), similarity, np.array(comps)):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key and held:
                    yield from told()
                    held = []
                key = k
                held.append(row)
        if held:
            yield from told()

    return dealt.select("key", "node", "comp", "text").repartition("key").sortWithinPartitions("key", "node").mapInArrow(linked, "a long, b long")


def _with_components(rows: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """rows (node, ...) with comp, the smallest node that links reach from theirs."""
    return rows.join(connected(links, most_edges=most), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")


def family_links(members: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, chunk: int = CHUNK, proxies: int = PROXIES, most: int | None = None) -> DataFrame:
    """(a, b): links between the similar texts (node, text) of each family (node, family), which join all that are similar.

    A family is dealt into chunks of about chunk bytes, and each chunk is searched. That is all for families of one
    chunk. In larger ones, a few texts of each component found are searched together, which joins what is dense; then
    each chunk of texts outside the family's largest component meets every other chunk. So no similar pair is missed,
    and what is moved grows with the square of what lies outside the largest component alone. most: a bound on the number of
    members, if one is known, by which cuts are laid out.
    """
    whole = cut(members.join(texts.select("node", F.coalesce("text", F.lit("")).cast("binary").alias("text")), "node").withColumn("size", F.octet_length("text")), most, CUT_TEXTS)
    sizes = whole.groupBy("family").agg((F.sum("size") / chunk + 1).cast("int").alias("chunks"))
    large = cut(sizes.filter("chunks > 1"), most)
    dealt = whole.join(broadcast_if_small(large), "family", "left")
    part = lambda n: F.pmod(F.xxhash64("node", F.lit(11)), n).cast("int")
    links = cut(_searched(dealt.select(F.xxhash64("family", part(F.coalesce("chunks", F.lit(1)))).alias("key"), "node", F.col("node").alias("comp"), "text"), similarity).distinct(), most)  # distinct parts the search, which is what costs, from the few tasks that write
    if large.isEmpty():
        return links
    twice = most and 2 * most
    several = dealt.filter("chunks IS NOT NULL").select("family", "node", "text", "size")
    inside = links.join(several.select(F.col("node").alias("a")), "a", "left_semi")
    rows = cut(_with_components(several.drop("text"), inside, most), most)
    few = rows.withColumn("place", F.row_number().over(Window.partitionBy("comp").orderBy(F.xxhash64("node", F.lit(13)), "node"))).filter(F.col("place") <= proxies)
    spread = few.join(few.groupBy("family").agg((F.sum("size") / chunk + 1).cast("int").alias("chunks")), "family")
    met = spread.join(whole.select("node", "text"), "node").select(F.xxhash64("family", part(F.col("chunks"))).alias("key"), "node", "comp", "text")
    links = cut(links.unionByName(_searched(met, similarity)).distinct(), twice)
    rows = cut(_with_components(rows.drop("comp"), links.join(several.select(F.col("node").alias("a")), "a", "left_semi"), twice), most)
    each = rows.groupBy("family", "comp").agg(F.sum("size").alias("size"))
    shape = each.groupBy("family").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), (F.max("size") / chunk + 1).cast("int").alias("mains"), ((F.sum("size") - F.max("size")) / chunk + 1).cast("int").alias("others"), F.count("*").alias("n"))
    shape = cut(shape.filter("n > 1").drop("n"), most)
    if shape.isEmpty():
        return links
    apart = rows.join(broadcast_if_small(shape), "family").withColumn("own", part(F.when(F.col("comp") == F.col("main"), F.col("mains")).otherwise(F.col("others"))))
    pair = lambda kind, i, j: F.xxhash64("family", F.lit(kind), i, j)
    to = lambda n: F.sequence(F.lit(0), n - 1)
    across = F.transform(F.filter(to(F.col("others")), lambda j: j != F.col("own")), lambda j: pair("others", F.least("own", j), F.greatest("own", j)))
    keys = F.when(F.col("comp") == F.col("main"), F.transform(to(F.col("others")), lambda j: pair("main", F.col("own"), j))).otherwise(F.concat(F.transform(to(F.col("mains")), lambda i: pair("main", i, F.col("own"))), across))
    last = apart.join(whole.select("node", "text"), "node").select(F.explode(keys).alias("key"), "node", "comp", "text")
    return cut(links.unionByName(_searched(last, similarity)).distinct(), most and 3 * most)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """The rows' description, and (node, root) of the classes whose component has a smaller node. docs is read twice."""
    marked = cut(describe(docs))
    most = marked.count()
    classes = cut(marked.groupBy("node").agg(F.first("fp").alias("fp"), F.first("anchors").alias("anchors"), F.first("signature").alias("signature"), F.min(F.struct("doc_id", "text_hash")).alias("row")), most, CUT_WIDE_ROWS)
    found = anchor_links(classes, most=most).unionByName(fingerprint_links(classes, most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    named = cut(found.distinct(), ANCHORS * most)
    families = connected(named, most_edges=ANCHORS * most).withColumnRenamed("root", "family")
    every = named.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = every.join(classes.select("node", "row"), "node").select("node", F.col("row.doc_id").alias("k"), F.col("row.text_hash").alias("h"))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = keyed.join(asked, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h"))).groupBy("node").agg(F.first("text").alias("text"))
    members = every.join(families, "node", "left").select("node", F.coalesce("family", "node").alias("family"))
    return marked, connected(family_links(members, texts, similarity, most=most), most_edges=2 * most)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, of which no earlier row, by doc_id, is a near-duplicate that they are linked to."""
    marked, roots = near_duplicates(docs, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    rows = marked.groupBy("node", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    grouped = rows.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min_by(F.struct("doc_id", "text_hash", "n"), order).alias("kept"))
    kept = grouped.select(F.col("kept.doc_id").alias("k"), F.col("kept.text_hash").alias("h"), F.col("kept.n").alias("n"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))
    met = whole.join(kept, F.col("id").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")))
    return met.filter("n = 1").select("row.*").unionByName(met.filter("n > 1").dropDuplicates(["k", "h"]).select("row.*"))
