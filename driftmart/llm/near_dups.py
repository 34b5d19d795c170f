r"""Near-duplicate documents by min-max hashing, with links confirmed on full shingle sets.

A text is lower-cased (A-Z) and cut into words ``[^\x20\x09-\x0D]+``; its set holds the
distinct runs of five words, or the whole sequence if it is shorter. Two documents are
linked if ``100 * |intersection| >= 75 * |union|``.

1. One pass over the texts hashes the shingles to 64 bits. For each of ``BANDS * 2`` hash
   functions both the minimum and the maximum over the set are kept: two values per
   evaluation, each of which two sets share with probability equal to their similarity.
   Four values make a band. Sets of similarity 0.75 miss all 60 bands with probability
   about 1e-10.
2. Documents with the same set are one class, represented by the smallest ``doc_id``.
   Every band key links its representatives to the smallest of them. The components of
   these candidate links hold all true links.
3. Only documents in such a component have their shingles read again. They meet in blocks
   of bounded size within their component, where a matrix product counts the
   intersections of all of them exactly. Each block of a large component also gets its
   ``ANCHORS`` smallest members, which ties blocks together.
4. Members of large components that are still apart from the component's largest cluster
   then visit all blocks. After that, any two members of different clusters have been
   compared, so no link can be missing from the clusters.

A block emits a spanning forest of its links, never all pairs.

Defined cases: NULL or blank text has an empty set and is linked with nothing; rows that
share a ``doc_id`` count as one document that owns all of their sets' links; a NULL
``doc_id`` is linked with nothing, has a NULL component, and is kept; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmart.llm.common import mix64, random_words, ranges, saved, steps, string_bytes
from driftmart.llm.components import components

WORDS = 5
PERCENT = 75
BANDS = 60
FUNCTIONS_PER_BAND = 2
BLOCK = 512
ANCHORS = 16

_BYTE = random_words(256, 11)
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_STEP = random_words(1, 12)[0]
_ORDER = random_words(WORDS, 13)
_FACTORS = random_words(BANDS * FUNCTIONS_PER_BAND, 14)
_OFFSETS = random_words(BANDS * FUNCTIONS_PER_BAND, 15)


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.empty(max(count, 1), np.uint64)
    out[0] = 1
    filled = 1
    while filled < count:
        more = min(filled, count - filled)
        factor = out[filled - 1 : filled] * base
        out[filled : filled + more] = out[:more] * factor
        filled += more
    return out


def _inverse(x: np.uint64) -> np.uint64:
    return np.uint64(pow(int(x), -1, 1 << 64))


def shingle_sets(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, concatenated, and their row offsets."""
    base, n = starts[0], len(starts) - 1
    text = raw[base : starts[-1]]
    blank = (text == 32) | ((text >= 9) & (text <= 13))
    inside = np.concatenate([[False], ~blank, [False]])
    begins = inside[1:-1] & ~inside[:-2]
    cuts = starts[:-1][np.diff(starts) > 0] - base  # a word never goes on into the next row
    begins[cuts] = ~blank[cuts]
    first = np.flatnonzero(begins)
    offsets = np.zeros(n + 1, np.int64)
    if not len(first):
        return np.zeros(0, np.uint64), offsets
    ends = inside[1:-1] & ~inside[2:]
    last_of_row = cuts[cuts > 0] - 1
    ends[last_of_row] = ~blank[last_of_row]
    last = np.flatnonzero(ends)
    row = np.searchsorted(starts[1:] - base, first, side="right")
    power = _powers(_STEP, len(text))
    upto = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[text] * power, dtype=np.uint64)])
    back = _powers(_inverse(_STEP), len(text))
    words = mix64((upto[last + 1] - upto[first]) * back[first] + (last - first + 1).astype(np.uint64))
    per_row = np.bincount(row, minlength=n)
    shingles_per_row = np.where(per_row == 0, 0, np.maximum(per_row - WORDS + 1, 1))
    first_word = np.cumsum(per_row) - per_row
    start = np.repeat(first_word, shingles_per_row) + ranges(np.zeros(n, np.int64), shingles_per_row)
    left = np.repeat(first_word + per_row, shingles_per_row) - start
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    value = np.zeros(len(start), np.uint64)
    for k in range(WORDS):
        value += np.where(left > k, padded[start + k], np.uint64(k + 1)) * _ORDER[k]
    value = mix64(value)
    bounds = np.concatenate([[0], np.cumsum(shingles_per_row)])
    keep = np.ones(len(value), bool)
    for r in np.flatnonzero(shingles_per_row > 1):
        part = value[bounds[r] : bounds[r + 1]]
        part.sort()
        keep[bounds[r] + 1 : bounds[r + 1]] = part[1:] != part[:-1]
    counts = np.concatenate([[0], np.cumsum(keep)])[bounds]
    return value[keep], counts


def signatures(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Band keys (sets x BANDS) from minima and maxima; no set may be empty."""
    keys = np.zeros((len(firsts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(firsts), band, np.uint64)
        for i in range(band * FUNCTIONS_PER_BAND, (band + 1) * FUNCTIONS_PER_BAND):
            hashed = values * _FACTORS[i] + _OFFSETS[i]
            hashed ^= hashed >> np.uint64(32)
            key = mix64(key * _STEP + np.minimum.reduceat(hashed, firsts))
            key = mix64(key * _STEP + np.maximum.reduceat(hashed, firsts))
        keys[:, band] = key
    return keys.view(np.int64)


def _rows_with_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, starts = string_bytes(batch.column("text"))
        for a, b in steps(starts):
            values, bounds = shingle_sets(raw, starts[a : b + 1])
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            one, two, bands = (np.zeros(b - a, np.int64) for _ in range(3))
            keys = np.zeros((0, BANDS), np.int64)
            if len(full):
                firsts = bounds[:-1][full]
                one[full] = np.add.reduceat(values, firsts).view(np.int64)
                two[full] = np.add.reduceat(mix64(values ^ _STEP), firsts).view(np.int64)
                keys = signatures(values, firsts)
            bands[full] = BANDS
            offsets = np.concatenate([[0], np.cumsum(bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, b - a),
                    pa.array(size.astype(np.int64)),
                    pa.array(one),
                    pa.array(two),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                ],
                names=["doc_id", "n_shingles", "key1", "key2", "bands"],
            )


def _rows_with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, starts = string_bytes(batch.column("text"))
        for a, b in steps(starts):
            values, bounds = shingle_sets(raw, starts[a : b + 1])
            packed = [values[bounds[i] : bounds[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(packed, pa.binary())],
                names=["doc_id", "shingles"],
            )


def linked_within(nodes: np.ndarray, sets: list[np.ndarray], clusters: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among these sets, between different clusters only if given."""
    sizes = np.array([len(s) for s in sets], np.int64)
    root = np.arange(len(nodes))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if clusters is not None:
        firsts: dict[int, int] = {}
        for i, c in enumerate(clusters.tolist()):
            root[i] = firsts.setdefault(c, i)
    every, inverse, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(nodes)), sizes)
    shared = seen > 1
    common = np.zeros((len(nodes), len(nodes)), np.float32)
    place = np.cumsum(shared) - 1
    used = shared[inverse]
    column, owner = place[inverse[used]], owner[used]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = max(1, min(4096, int(shared.sum())))
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(nodes), width), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part @ part.T
    common = np.rint(common).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    near = np.triu(100 * common >= PERCENT * union, 1)
    forest = []
    for i, j in zip(*np.nonzero(near)):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[max(a, b)] = min(a, b)
            forest.append((int(nodes[i]), int(nodes[j])))
    return forest


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one block; its rows are bounded. A visitor may also be at home in it."""
    table = pa.Table.from_batches(list(batches))
    nodes, packed = table.column("node").to_pylist(), table.column("shingles").to_pylist()
    once = list(dict(zip(zip(nodes, packed), range(len(nodes)))).values())
    forest: list[tuple[int, int]] = []
    if len(once) > 1:
        clusters = None
        if "cluster" in table.column_names:
            clusters = table.column("cluster").to_numpy()[once]
        sets = [np.frombuffer(packed[i], np.uint64) for i in once]
        forest = linked_within(np.array(nodes)[once], sets, clusters)
    a, b = (np.array([x[k] for x in forest], np.int64) for k in (0, 1))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _everywhere(visitors: DataFrame) -> DataFrame:
    """Every visitor once in each block of its group."""
    return visitors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    signed = saved(
        rows.mapInArrow(
            _rows_with_signatures, "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>"
        ),
        "signatures",
    )
    known = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = known.groupBy("key1", "key2").agg(
        F.min(F.struct("doc_id", "bands")).alias("first"), F.count(F.lit(1)).alias("members")
    )
    banded = classes.select(F.col("first.doc_id").alias("node"), F.explode("first.bands").alias("band"))
    pivots = banded.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).where("pivot < top")
    # Merge joins where a side grows with the corpus, so that the plan is one at every size.
    candidates = (
        banded.join(pivots.hint("merge"), "band")
        .where("node <> pivot")
        .select(F.col("pivot").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    groups = components(candidates).select(F.col("node"), F.col("root").alias("grp"))
    size = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    # Every member has a block; blocks hold about BLOCK of them.
    placed = groups.join(size, "grp").select(
        "node",
        "grp",
        F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks"),
        F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK).cast("long")).alias("block"),
    )
    texts = rows.join(placed.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    sets = texts.mapInArrow(_rows_with_sets, "doc_id long, shingles binary").withColumnRenamed("doc_id", "node")
    members = saved(placed.hint("merge").join(sets, "node"), "shingles")
    by_id = Window.partitionBy("grp").orderBy("node")
    anchors = (
        members.where("blocks > 1").select("node", "grp").withColumn("place", F.row_number().over(by_id))
        .where(F.col("place") <= ANCHORS)
        .select("node")
    )
    first_round = members.unionByName(_everywhere(members.join(anchors.distinct(), "node", "left_semi")))
    first_links = saved(first_round.groupBy("grp", "block").applyInArrow(_links, "a long, b long"), "first-links")
    same_id = _same_document(known)
    clusters = components(first_links.unionByName(same_id)).select("node", F.col("root").alias("cluster"))
    large = members.where("blocks > 1").join(clusters, "node", "left").withColumn(
        "cluster", F.coalesce("cluster", "node")
    )
    large = saved(large, "clustered")
    cluster_sizes = large.groupBy("grp", "cluster").agg(F.count(F.lit(1)).alias("n"))
    main = cluster_sizes.groupBy("grp").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("main"))
    apart = large.join(main, "grp").where("cluster <> main").select(*large.columns)
    second_links = (
        _meetings(large, apart).groupBy("grp", "block", "party").applyInArrow(_links, "a long, b long")
    )
    links = first_links.unionByName(same_id).unionByName(second_links)
    found = components(links).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    # Copies follow their class; only classes that have copies or links are looked up.
    named = classes.select("key1", "key2", F.col("first.doc_id").alias("node"), "members")
    named = named.join(found, F.col("node") == F.col("_node"), "left").where("members > 1 OR _root IS NOT NULL")
    lookup = named.select(
        F.col("key1").alias("_k1"), F.col("key2").alias("_k2"), F.coalesce("_root", "node").alias("_component")
    )
    joined = signed.select("doc_id", "n_shingles", "key1", "key2").join(
        lookup,
        (F.col("key1") == F.col("_k1")) & (F.col("key2") == F.col("_k2")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(),
        "left",
    )
    component = F.coalesce("_component", "doc_id")
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def _same_document(known: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id, by their representatives."""
    firsts = known.groupBy("key1", "key2").agg(F.min("doc_id").alias("node"))
    repeated = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    rows = known.select("doc_id", "key1", "key2").join(repeated, "doc_id", "left_semi").distinct()
    return rows.join(firsts, ["key1", "key2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")


def _meetings(members: DataFrame, apart: DataFrame) -> DataFrame:
    """Those apart visit every block of their group, in parties of about ``BLOCK``."""
    parties = F.ceil(F.col("visitors") / BLOCK).cast("long")
    counts = apart.groupBy("grp").agg(F.count(F.lit(1)).alias("visitors"))
    guests = _everywhere(
        apart.join(counts, "grp").select(
            *apart.columns, F.pmod(F.xxhash64("node", F.lit(1)), parties).alias("party")
        )
    )
    hosts = members.join(counts, "grp").select(
        *members.columns, F.explode(F.sequence(F.lit(0).cast("long"), parties - 1)).alias("party")
    )
    return hosts.unionByName(guests)


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are their component's smallest ``doc_id``."""
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
