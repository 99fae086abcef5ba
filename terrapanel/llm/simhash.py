"""SimHash near-duplicate detection with multi-index hashing.

A text's fingerprint has one bit for each bit position that is set in over half
of its shingles' hashes.  Fingerprints are cut into segments.  Two fingerprints
within distance d must agree in some segment up to that segment's radius, where
the radii add up to d - segments + 1 (the general pigeonhole principle).  So
each fingerprint probes the small Hamming ball around each of its segments; the
table of segment values returns candidates, whose complete distance is verified.

Links are wanted for their components only, so links that join nothing new are
not emitted.  First, neighbours in each bucket's order are linked; then the
probes emit only verified links between different components.  Hot buckets
thus give a few links a row instead of all pairs, and no candidate is capped.

Defined results: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other; null ids are allowed and never
the smallest of a component unless it has no other; rows that repeat id and
text are in one component; a very long text is hashed block by block, so that
it takes the memory of its words only; an empty table gives an empty result;
other columns are ignored, or kept where rows are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapanel.llm.components import connected_components
from terrapanel.llm.joins import HOT_SHARES, join_hot, text_mark, without
from terrapanel.llm.storage import Tables


class Segment(NamedTuple):
    """Bits ``shift`` to ``shift + width - 1`` of a fingerprint's 64-bit word, probed up to ``radius`` flips."""

    shift: int
    width: int
    radius: int
    word: int = 0


#: Distance 2 in two halves: either one differs by at most one bit, or the other by none.
HALVES = (Segment(32, 32, 1), Segment(0, 32, 0))
#: Neighbours in a bucket's order that are compared first.
STEPS_AHEAD = (1, 2, 4, 8)
#: Salts of a segment value that holds a large share of all fingerprints.
BUCKET_SALTS = 32
#: Shingles that are hashed and added up in one step, to bound memory.
BLOCK = 1 << 16
SEED = 42


def shingles(text: bytes, size: int) -> Iterator[bytes]:
    """The text's shingles of ``size`` words, one by one; the whole sequence if it has fewer."""
    words = text.lower().split()
    if 0 < len(words) < size:
        return iter([b" ".join(words)])
    return map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))


def _mix(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th 64-bit hash derived from h; h itself for n = 0."""
    if not n:
        return h
    h = h + np.uint64((0x9E3779B97F4A7C15 * n) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bits_of(blocks: Iterable[np.ndarray], words: int = 1) -> list[int]:
    """``words`` signed 64-bit integers: each bit that is set in over half of the hashes; zeros if there are none."""
    ones, count = np.zeros((words, 64), np.int64), 0
    for h in blocks:
        count += len(h)
        for n in range(words):
            ones[n] += np.unpackbits(_mix(h, n).astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count, axis=1).view(">i8")[:, 0].tolist()


def fingerprint(text: bytes, size: int) -> int:
    """A signed 64-bit integer made of the shingles' XXH64, repeats included."""
    found = (xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, size))
    return bits_of(iter(lambda: np.fromiter(islice(found, BLOCK), np.uint64), _Empty()))[0]


class _Empty:
    """Equal to an array without elements; ends the iteration over blocks."""

    def __eq__(self, other) -> bool:
        return not len(other)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Rows (doc_id, fp)."""
    id_type = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            found = [fingerprint(t.as_py(), size) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type.simpleString()}, fp long")


def _ball(segment: Segment) -> list[int]:
    """Flip masks for the Hamming ball of a segment."""
    masks = [0]
    for r in range(1, segment.radius + 1):
        if r > 2:
            raise ValueError("radii above 2 are not supported")
        bits = [1 << i for i in range(segment.width)]
        masks += bits if r == 1 else [x | y for i, x in enumerate(bits) for y in bits[:i]]
    return masks


def _word(segment: Segment) -> F.Column:
    return F.col("more")[segment.word - 1] if segment.word else F.col("fp")


def _value(number: int, segment: Segment) -> F.Column:
    """The segment's bits, with its number above them."""
    return F.shiftrightunsigned(_word(segment), segment.shift).bitwiseAND((1 << segment.width) - 1) + F.lit(number << 32)


def _distance(a: str, b: str) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _prints(words: int) -> dict[str, F.Column]:
    """The fingerprint's first words as columns: fp, fp2, fp3..."""
    return {f"fp{n + 1}" if n else "fp": F.col("more")[n - 1] if n else F.col("fp") for n in range(words)}


def _bucket_links(nodes: DataFrame, segments: tuple[Segment, ...], max_distance: int, steps: tuple[int, ...] = STEPS_AHEAD, words: int = 1) -> DataFrame:
    """Distinct links of each fingerprint to some of the next ones in its buckets, where their first words are near."""
    prints, places = _prints(words), []
    for k, segment in enumerate(segments):
        # Rows of a bucket come in the order of the word's bits beside the segment, turned round.
        above = F.shiftrightunsigned(_word(segment), segment.shift + segment.width) if segment.shift + segment.width < 64 else F.lit(0).cast("long")
        below = F.shiftleft(_word(segment), 64 - segment.shift) if segment.shift else F.lit(0).cast("long")
        places.append(F.struct(_value(k, segment).alias("value"), below.bitwiseOR(above).alias("turned")))
    # One scan for all segments: the driver plans, compiles and keeps one stage, not one for each.
    rows = nodes.select("node", *[c.alias(name) for name, c in prints.items()], F.inline(F.array(*places)))
    # Four bits of the turned fingerprint salt the bucket: a hot one is spread over 16 tasks.
    order = W.partitionBy("value", F.pmod("turned", F.lit(16))).orderBy("turned", "node")
    ahead = {f"next{n}_{c}": F.lead(c, n).over(order) for n in steps for c in ("node", *prints)}
    far = lambda n: sum((_distance(c, f"next{n}_{c}") for c in prints), F.lit(0))
    linked = F.array(*[F.when(far(n) <= max_distance, F.col(f"next{n}_node")) for n in steps])
    return rows.withColumns(ahead).select(F.col("node").alias("a"), F.explode(F.array_compact(linked)).alias("b")).distinct()


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with root: the smallest node of the component."""
    roots = connected_components(links)
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _probe_links(nodes: DataFrame, segments: tuple[Segment, ...], max_distance: int, tables: Tables) -> DataFrame:
    """Verified links between nodes of different components, found by probing Hamming balls.

    The rows of a segment value that holds a large share of all nodes are
    salted, and probes of it repeated for each salt.
    """
    table, probes = None, None
    for k, segment in enumerate(segments):
        own = nodes.select("node", "fp", "root", _value(k, segment).alias("value"))
        flips = F.explode(F.array(*[F.lit(m).cast("long") for m in _ball(segment)]))
        probe = own.withColumn("flip", flips).withColumn("value", F.col("value").bitwiseXOR(F.col("flip"))).drop("flip")
        table = own if table is None else table.unionByName(own)
        probes = probe if probes is None else probes.unionByName(probe)
    total = nodes.count()
    counts = table.groupBy("value").agg(F.count("*").alias("n"))
    # At most HOT_SHARES values for each segment, so this can be broadcast.
    hot = tables.write(counts.where((F.col("n") * HOT_SHARES >= total) & (F.col("n") > 1)).select("value", F.lit(BUCKET_SALTS).alias("salts")), "hot-segments")
    mark = lambda rows: rows.join(F.broadcast(hot), "value", "left")
    table = mark(table).withColumn("salt", F.coalesce(F.pmod(F.xxhash64("node"), F.col("salts")), F.lit(0)).cast("int"))
    probes = mark(probes).withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0)))))
    same = (F.col("p.value") == F.col("t.value")) & (F.col("p.salt") == F.col("t.salt"))
    found = probes.alias("p").join(table.alias("t"), same & (F.col("p.root") < F.col("t.root")) & (_distance("p.fp", "t.fp") <= max_distance))
    return found.select(F.col("p.node").alias("a"), F.col("t.node").alias("b"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, max_distance: int = 2, segments: tuple[Segment, ...] = HALVES
) -> DataFrame:
    """One row per input row: id, fingerprint (hex), component_id (the smallest id reachable).

    Nodes are the distinct fingerprints; two are linked if they differ in
    ``max_distance`` bits or fewer.  ``segments`` must cover that distance.
    """
    tables = Tables(docs.sparkSession, "near-duplicates")
    rows = tables.write(fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = tables.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")).withColumn("node", F.col("fp")), "nodes")
    plain = nodes.select("node", "fp")
    first = tables.write(_bucket_links(plain, segments, max_distance), "bucket-links")
    labelled = tables.write(_labelled(plain, first), "labelled")
    more = _probe_links(labelled, segments, max_distance, tables)
    stars = labelled.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = connected_components(stars.unionByName(more))
    named = tables.write(nodes.join(roots, "node", "left").select("node", "n", "least_id", F.coalesce("root", "node").alias("root")), "roots")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("nodes"))
    of_node = tables.write(join_hot(named, least, "root", named.count(), "nodes").select(F.col("node").alias("fp"), "n", "component_id"), "components")
    tables.remove("nodes", "bucket-links", "labelled", "hot-segments", "roots")
    found = join_hot(rows, of_node, "fp", rows.count())
    return found.select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# The drop of near copies.  Two texts are near copies if they have common shingles of SHINGLE words in SIMILARITY of
# both.  Candidates come from fingerprints of 512 bits over the distinct pairs of neighbouring words, whose bits flip
# less than those of longer shingles: if every tenth word is changed, four fifths of the words still stand in common
# shingles of five, and a bit flips with probability 0.2.  Of 24 segments, probed up to one flip each, some one agrees
# then with probability 0.74, at 0.15 with 0.98; README has the recall as measured.  A candidate's whole
# distance is bounded 2.5 standard deviations above 0.2 (that of neighbours in a bucket's order on four words first);
# links are then verified on the shingles themselves.
SHINGLE, SIMILARITY = 5, 0.8
PAIR, WORDS = 2, 8
PRINT_SEGMENTS = tuple(Segment(shift, width, 1, word) for word in range(WORDS) for shift, width in ((43, 21), (22, 21), (0, 22)))
FIRST_WORDS, FIRST_DISTANCE, ALL_DISTANCE = 4, 70, 128
#: Rows of a task that looks for candidates; they are held in memory.
ROWS_A_TASK = 400_000
#: Probed rows that are compared in one step, to bound memory.
PAIRS_A_STEP = 1 << 20
#: Candidates between two components, of one bucket and one neighbour, that are tried at first.
FIRST_TRIED = 2
#: Nodes with a shingle, up to which it counts as rare; a node's rare shingles give at most that many candidates each.
RARE = 128


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's shingles in their order, made of the words' XXH64."""
    words = text.lower().split()
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    return joined_hashes(h, size)


def joined_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each ``size`` neighbours; one for all of them if there are fewer."""
    size = min(size, len(h))
    count = len(h) - size + 1 if size else 0
    out = np.zeros(count, np.uint64)
    for k in range(size):
        out = _mix(out ^ h[k : k + count], k + 1)
    return out


def words_in(x: np.ndarray, y: np.ndarray, size: int = SHINGLE) -> float:
    """The share of words of the text with shingles x that stand in shingles of y."""
    if not len(x):
        return float(not len(y))
    change = np.zeros(len(x) + size, np.int64)
    there = np.flatnonzero(np.isin(x, y))
    change[there] += 1
    np.add.at(change, there + size, -1)
    return float(np.count_nonzero(np.cumsum(change)[: len(x) + size - 1]) / (len(x) + size - 1))


def covered(a: np.ndarray, b: np.ndarray, size: int = SHINGLE) -> float:
    """The share of words that stand in common shingles, in whichever of the two texts it is smaller."""
    return min(words_in(a, b, size), words_in(b, a, size))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Common ones of all distinct shingles."""
    both = len(np.intersect1d(a, b))
    union = len(np.unique(a)) + len(np.unique(b)) - both
    return both / union if union else 1.0


def distinct_in(x: np.ndarray, y: np.ndarray) -> float:
    """The share of x's distinct shingles that are in y."""
    own = np.unique(x)
    return np.count_nonzero(np.isin(own, y)) / len(own) if len(own) else float(not len(y))


MEASURES = {"covered": covered, "jaccard": jaccard}
#: With the shingles that a text has in common with any of several others: no less than the measure with each of them.
BOUNDS = {"covered": words_in, "jaccard": distinct_in}


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), text_mark(F.col(text_col)).alias("mark"), text.alias("text"))


def _word_prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, mark, node, fp, more): the text's mark, that of its words, its fingerprint."""
    id_type = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            node, fp, more = [], [], []
            for t in batch.column(2):
                words = t.as_py().lower().split()
                h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
                pairs = np.unique(joined_hashes(h, PAIR))
                own = bits_of((pairs[at : at + BLOCK] for at in range(0, len(pairs), BLOCK)), WORDS)
                node.append(xxhash.xxh64_intdigest(h.tobytes(), SEED) - 2**63)
                fp.append(own[0])
                more.append(own[1:])
            columns = [batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.array(more, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "node", "fp", "more"])

    return _marked(docs, id_col, text_col).mapInArrow(run, f"doc_id {id_type.simpleString()}, mark long, node long, fp long, more array<long>")


def _sequences(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (node, root, sequence): the node's whole fingerprint, then its shingles' hashes."""

    def hashes(batches):
        for batch in batches:
            own = [np.concatenate([w.values.to_numpy(), shingle_hashes(t.as_py()).view(np.int64)]) for w, t in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int64()))], names=["node", "root", "sequence"])

    chosen = nodes.select("node", "root", "mark", F.concat(F.array("fp"), "more").alias("words"))
    texts = _marked(docs, id_col, text_col).select("mark", "text").join(chosen, "mark").dropDuplicates(["node"]).select("node", "root", "words", "text")
    return texts.mapInArrow(hashes, "node long, root long, sequence array<long>")


def _similar(pairs: DataFrame, sequences: DataFrame, similarity: float, measure: str) -> DataFrame:
    """The pairs (a, b) whose whole fingerprints are near and whose shingles have the similarity, by the shingles themselves."""
    alike = MEASURES[measure]

    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (v.values.to_numpy(zero_copy_only=False).view(np.uint64) for v in (x, y))
                near = np.bitwise_count(x[:WORDS] ^ y[:WORDS]).sum() <= ALL_DISTANCE
                keep.append(bool(near) and alike(x[WORDS:], y[WORDS:]) >= similarity)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    of = lambda side: sequences.select(F.col("node").alias(side), F.col("sequence").alias(f"{side}_sequence"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_sequence", "b_sequence")
    return both.mapInArrow(verify, "a long, b long")


def _shingle_rows(sequences: DataFrame) -> DataFrame:
    """Rows (node, root, shingle), each shingle of a text once."""
    own = F.array_distinct(F.slice("sequence", WORDS + 1, F.size("sequence")))
    return sequences.select("node", "root", F.explode(own).alias("shingle"))


def _shared(sequences: DataFrame) -> DataFrame:
    """Rows (shingle, n, often) for the shingles of nodes of different roots; n nodes have it."""
    found = _shingle_rows(sequences).groupBy("shingle").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most"))
    return found.where("least < most").select("shingle", "n", (F.col("n") > RARE).alias("often"))


def _linkable(sequences: DataFrame, shared: DataFrame, similarity: float, measure: str) -> DataFrame:
    """Rows (node, free) of the nodes that may have the similarity with one of another root: with all of these together they have it.

    A node that hasn't needs no comparison with each of a large group of which
    it may be a candidate.  A free one has the similarity with them even by the
    shingles alone that many have; one that is not has a rare one in common
    with each that it is linked to.  Shingles are counted, not paired.
    """
    bound = BOUNDS[measure]

    def decide(batches):
        for batch in batches:
            own, every, often = ([v.values.to_numpy(zero_copy_only=False) for v in batch.column(k)] for k in (1, 2, 3))
            keep = [bound(x[WORDS:], y) >= similarity for x, y in zip(own, every, strict=True)]
            free = [bound(x[WORDS:], y) >= similarity for x, y in zip(own, often, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(free, pa.bool_())], names=["node", "free"]).filter(pa.array(keep, pa.bool_()))

    total = sequences.agg(F.sum(F.size("sequence"))).first()[0] or 0
    common = join_hot(_shingle_rows(sequences).select("node", "shingle"), shared, "shingle", total)
    common = common.groupBy("node").agg(F.collect_list("shingle").alias("every"), F.collect_list(F.when(F.col("often"), F.col("shingle"))).alias("often"))
    return sequences.join(common, "node").select("node", "sequence", "every", "often").mapInArrow(decide, "node long, free boolean")


def _rare_pairs(sequences: DataFrame, shared: DataFrame, nodes: DataFrame, segments: tuple[Segment, ...]) -> DataFrame:
    """The candidates (a, b) of ``_half_links`` that have a rare shingle in common and of which one is not free."""
    rows = _shingle_rows(sequences).join(shared.where(~F.col("often")).select("shingle"), "shingle").join(nodes.select("node", "free", "fp", "more"), "node")
    both = rows.where(~F.col("free")).alias("p").join(rows.alias("t"), (F.col("p.shingle") == F.col("t.shingle")) & (F.col("p.root") != F.col("t.root")))
    flipped = [F.col("p.fp").bitwiseXOR(F.col("t.fp")).alias("fp"), F.zip_with("p.more", "t.more", lambda x, y: x.bitwiseXOR(y)).alias("more")]
    pairs = both.select(F.greatest("p.node", "t.node").alias("a"), F.least("p.node", "t.node").alias("b"), *flipped)
    return pairs.where(F.least(*[F.bit_count(_value(0, s)) for s in segments]) <= 1).select("a", "b").distinct()


def _flip_pairs(key: np.ndarray, node: np.ndarray, root: np.ndarray, prints: np.ndarray, width: int, tried: int | None):
    """Arrays (a, b) of the nodes of different roots whose halves are equal and whose rests differ in one bit at most.

    key: the half with its number, the rest in its lowest 16 bits; prints: the
    fingerprints, one row for each word.  Equal rests
    count for halves of even numbers only, as both halves of a segment find them.
    With ``tried``, so many of the nearest pairs of two roots are given, and the
    halves of those that are left out, as pairs of a half with itself.
    """
    order = np.lexsort((root, key))
    key, node, root, prints = key[order], node[order], root[order], prints[:, order].view(np.uint64)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    end = np.r_[start[1:], len(key)]
    keys, least, most = key[start], root[start], root[end - 1]
    even = (keys >> 32) % 2 == 0
    for flip in [0] + [1 << i for i in range(width)]:
        at = np.minimum(np.searchsorted(keys, keys ^ flip), len(keys) - 1)
        # Of a bucket and its neighbour, one pair of roots has to differ: the hot groups that are linked already do not.
        ok = (keys[at] == keys ^ flip) & (least < most[at])
        if not flip:
            ok &= even
        left = np.flatnonzero(ok)
        sizes = (end - start)[left]
        rows = np.repeat(start[left], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        other = np.repeat(at[left], sizes)
        counts = (end - start)[other]
        upto = np.cumsum(counts)
        done = 0
        while done < len(rows):
            stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + PAIRS_A_STEP)))
            c = counts[done:stop]
            p = np.repeat(rows[done:stop], c)
            t = np.repeat(start[other[done:stop]], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            new = root[p] < root[t]
            p, t = p[new], t[new]
            far = sum(np.bitwise_count(word[p] ^ word[t]).astype(np.int64) for word in prints)
            near = far <= ALL_DISTANCE
            p, t, far = p[near], t[near], far[near]
            if tried is not None and len(p) > tried:
                by_roots = np.lexsort((node[t], node[p], far, root[t], root[p]))
                at_key = key[p[by_roots]]
                p, t = p[by_roots], t[by_roots]
                begins = np.flatnonzero(np.r_[True, (root[p][1:] != root[p][:-1]) | (root[t][1:] != root[t][:-1])])
                place = np.arange(len(p)) - np.repeat(begins, np.diff(np.r_[begins, len(p)]))
                later = np.unique(at_key[place >= tried] >> 16)
                yield later, later
                p, t = p[place < tried], t[place < tried]
            yield node[p], node[t]
            done = stop


def _half_rows(nodes: DataFrame, segments: tuple[Segment, ...], halves: DataFrame | None = None) -> tuple[DataFrame, Callable]:
    """The nodes for each half of each segment, dealt out by it, and a function that gives a task's arrays for ``_flip_pairs``.

    One half of a segment agrees as a whole if its value agrees up to one bit.
    The other half's flips are made where the rows are, so flips are never
    shuffled.  With ``halves``, only these are looked into.
    """
    parts = []
    for k, segment in enumerate(segments):
        value = _value(0, segment)
        width = segment.width // 2
        low, high = value.bitwiseAND((1 << width) - 1), F.shiftright(value, width)
        for side, own, rest in ((0, low, high), (1, high, low)):
            parts.append(F.shiftleft(F.lit(2 * k + side).cast("long"), 32).bitwiseOR(F.shiftleft(own, 16)).bitwiseOR(rest))
    tasks, prints = 1 + nodes.count() * len(parts) // ROWS_A_TASK, _prints(WORDS)
    rows = nodes.select(F.explode(F.array(*parts)).alias("key"), "node", "root", *[c.alias(name) for name, c in prints.items()]).withColumn("half", F.shiftright("key", 16))
    rows = rows if halves is None else rows.join(halves, "half", "left_semi")
    widest, names = max(s.width - s.width // 2 for s in segments), ["key", "node", "root", *prints]

    def arrays(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return None
        table = pa.Table.from_batches(held)
        columns = [table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in names]
        return *columns[:3], np.stack(columns[3:]), widest

    return rows.repartition(tasks, "half"), arrays


def _half_links(nodes: DataFrame, segments: tuple[Segment, ...], tried: int | None, halves: DataFrame | None = None) -> DataFrame:
    """Distinct candidates (a, b) of different components whose value agrees in some segment up to one bit."""
    rows, arrays = _half_rows(nodes, segments, halves)

    def run(batches):
        if held := arrays(batches):
            for a, b in _flip_pairs(*held, tried):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _half_nodes(nodes: DataFrame, segments: tuple[Segment, ...]) -> DataFrame:
    """The nodes of the candidates that ``_half_links`` gives; each comes once from a task, however many candidates it is in."""
    rows, arrays = _half_rows(nodes, segments)

    def run(batches):
        if held := arrays(batches):
            found = np.zeros(0, np.int64)
            for a, b in _flip_pairs(*held, None):
                if len(a):
                    found = np.unique(np.concatenate([found, a, b]))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["node"])

    return rows.mapInArrow(run, "node long").distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, measure: str = "covered") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of near copies, with all their columns.

    ``measure`` compares the shingles of five words of two texts: "covered" is
    the share of their words that stand in common shingles (the smaller of the
    two shares), "jaccard" the share of common ones among their distinct
    shingles.  Texts from ``similarity`` on are linked; groups are the
    components of these links.  Of a group the row with the smallest id stays;
    of equal ids the one with the smallest mark of its text.  Rows without an
    id stay, and so do rows that repeat both id and text if one of them does.
    """
    tables = Tables(docs.sparkSession, "near-copies")
    rows = tables.write(_word_prints(docs, id_col, text_col), "word-prints")
    nodes = tables.write(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("more").alias("more"), F.min("mark").alias("mark")), "nodes")

    candidates = tables.write(_bucket_links(nodes, PRINT_SEGMENTS, FIRST_DISTANCE, (1,), FIRST_WORDS), "candidates")
    wanted = candidates.select(F.col("a").alias("node")).union(candidates.select("b")).distinct()
    own = nodes.withColumn("root", F.col("node")).join(wanted, "node")
    sequences = tables.write(_sequences(own, docs, id_col, text_col), "sequences")
    first = tables.write(_similar(candidates, sequences, similarity, measure), "neighbours")
    labelled = tables.write(_labelled(nodes, first), "labelled")
    # From here on a component is a star, whatever links have made it: their number does not follow that of its links.
    stars = labelled.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    # Nodes that no other component's texts together could link are not compared with each of them.
    met = tables.write(_half_nodes(labelled, PRINT_SEGMENTS), "met")
    sequences = tables.write(_sequences(labelled.join(met, "node"), docs, id_col, text_col), "met-sequences")
    shared = tables.write(_shared(sequences), "shared")
    linkable = tables.write(labelled.join(_linkable(sequences, shared, similarity, measure).select("node"), "node", "left_semi"), "linkable")
    # Two groups that have not met may have very many candidates between them.  The nearest ones are tried first; what
    # is left of them is tried all, but by then most such groups have been joined.  Of what is left, a node that is not
    # free has few partners, found by its rare shingles.
    probed = tables.write(_half_links(linkable, PRINT_SEGMENTS, FIRST_TRIED), "probed")
    links = stars.unionByName(tables.write(_similar(probed.where("a <> b"), sequences, similarity, measure), "nearest"))
    later = tables.write(probed.where("a = b").select(F.col("a").alias("half")), "later")
    roots = connected_components(links)
    if later.count():
        joined = tables.write(linkable.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "joined")
        # The components have grown, so more nodes have nothing in common with another one.
        sequences = sequences.drop("root").join(joined.select("node", "root"), "node")
        shared = tables.write(_shared(sequences), "shared-still")
        apart = tables.write(joined.join(_linkable(sequences, shared, similarity, measure), "node"), "apart")
        pairs = _half_links(apart.where("free"), PRINT_SEGMENTS, None, later).unionByName(_rare_pairs(sequences, shared, apart, PRINT_SEGMENTS))
        pairs = tables.write(pairs, "left")
        more = tables.write(_similar(pairs, sequences, similarity, measure), "others")
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    placed = rows.join(roots, "node", "left").where("doc_id IS NOT NULL")
    placed = tables.write(placed.select("doc_id", "mark", F.coalesce("root", "node").alias("root")), "placed")
    who = F.struct("doc_id", "mark")
    least = tables.write(placed.groupBy("root").agg(F.min(who).alias("least"), F.count("*").alias("n")).where("n > 1"), "least")
    gone = join_hot(placed, least, "root", placed.count()).where(who != F.col("least")).select("doc_id", "mark").distinct()
    gone = tables.write(gone, "gone")
    tables.remove("word-prints", "nodes", "candidates", "sequences", "neighbours", "labelled", "met", "met-sequences", "shared", "shared-still", "linkable")
    tables.remove("probed", "nearest", "later", "joined", "apart", "left", "others", "placed", "least")
    return without(docs, gone, id_col, text_col)
