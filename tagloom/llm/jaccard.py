"""Jaccard join of word n-gram sets by parity sketches.

Every shingle toggles one bit of a bit sketch, so two sketches differ in at most as many bits as the sets
differ in shingles. In a band of set sizes at most d shingles may differ. A sketch is cut into more than d + 1
parts, and of any d + 1 of them one at least is equal in a set that links. So each set may leave out its
commonest parts, by an order that all sets share, as long as d + 1 are left: those say least, since many other
sets have them too. Equal parts are the keys on which candidates meet. Sets that meet, directly or
through others, form a family, and inside a family all sets are compared exactly, in blocks.
Equal sets are one row throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.groups import components
from tagloom.llm.shared import blocks, met_keys, mix, passes, shared_keys, shingle_sets, sieve, stored, words

#: Bits of a part of the sketch (only set ones are looked at), and parts for each one that is needed.
PART_BITS = 1 << 20
SPARE = 1.25
#: Most sets and bytes of shingles in a block of a family.
BLOCK_SETS, BLOCK_SIZE = 512, 1 << 24
#: Columns of the incidence matrix that are held at once.
COLUMNS = 2048
#: Most binary digits of a sieve of documents.
SIEVE = 27


def set_digests(found: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set of shingles, whatever their order."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found + np.uint64(0x5851F42D4C957F2D)))])
    return mix(sums[begins[1:]] - sums[begins[:-1]] + np.diff(begins).astype(np.uint64))


def band_edges(most: int, percent: int) -> np.ndarray:
    """Where size bands begin: sets that can link are in the same band or in neighbouring ones."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, (edges[-1] - 1) * 100 // percent + 1))
    edges.append(max(edges[-1] + 1, (edges[-1] - 1) * 100 // percent + 1))
    return np.array([*edges, max(edges[-1] + 1, (edges[-1] - 1) * 100 // percent + 1)])


def sketch_keys(found: np.ndarray, begins: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each set for its own band and the next: which set, the key, and twice the number of keys that
    the set can do without, plus one for the next band.

    A key is a hash of the band, the part and the part's parity bits. A band in which no two different
    sets can link has no keys. Empty parts are keys only of sets that have too few others.
    """
    sizes = np.diff(begins)
    edges = band_edges(int(sizes.max(initial=1)), percent)
    own = np.searchsorted(edges, sizes, "right") - 1
    rows, keys, spares = [], [], []
    owner = np.repeat(np.arange(len(sizes)), sizes)
    high, bit = found >> np.uint64(32), mix(found & np.uint64(PART_BITS - 1))
    for step in (0, 1):
        band = own + step
        differ = 2 * (edges[band + 1] - 1) * (100 - percent) // (100 + percent)
        parts = np.where((sizes > 0) & (differ > 0), np.ceil((differ + 1) * SPARE).astype(np.int64), 0)
        base = np.concatenate([[0], np.cumsum(parts)])
        live = parts[owner] > 0
        who = owner[live]
        # Shingles are in ascending order, so those of a part are neighbours.
        part = base[who] + ((high[live] * parts[who].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        parity, full = np.zeros(base[-1], np.uint64), np.zeros(base[-1], bool)
        if len(part):
            heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            parity[part[heads]] = np.bitwise_xor.reduceat(bit[live], heads)
            full[part[heads]] = True
        of = np.repeat(np.arange(len(sizes)), parts)
        place = np.arange(base[-1]) - base[of]
        where = mix(band[of].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))
        spare = np.bincount(of[full], minlength=len(sizes)) - (differ + 1)
        keep = full | (spare[of] < 0)
        rows.append(of[keep])
        keys.append(mix(parity ^ where)[keep])
        spares.append(2 * np.maximum(spare, 0)[of[keep]] + step)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(spares)


def _sets(block: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray]:
    codes, _, _, first = words(block.column("text"), fold=True)
    return shingle_sets(codes, first, length)


def set_sizes(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, n_shingles and set, a hash of the set of shingles, for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            found, begins = _sets(block, length)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(np.diff(begins)), pa.array(set_digests(found, begins).view(np.int64))],
                ["doc_id", "n_shingles", "set"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set long")


def keyed_sets(docs: DataFrame, length: int, percent: int) -> DataFrame:
    """A row (key, set, spare) for each sketch key of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            found, begins = _sets(block, length)
            digests = set_digests(found, begins).view(np.int64)
            _, one = np.unique(digests, return_index=True)
            of, keys, spare = sketch_keys(found, begins, percent)
            keep = np.isin(of, one)
            columns = keys[keep].view(np.int64), digests[of[keep]], spare[keep]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "set", "spare"])

    return docs.select("text").mapInArrow(run, "key long, set long, spare long")


def candidates(rows: DataFrame) -> DataFrame:
    """Pairs (hub, member) of sets that meet on a key (``rows``: key, set, spare), the hub for all of a key's; they may repeat.

    A set first leaves out as many of its commonest keys as it can spare. Any order of the keys that all sets share
    will do, so members are counted up to a bound.
    """
    met = met_keys(rows, "n").withColumnRenamed("member", "set")
    # A set has a bounded number of keys, by its size.
    own = met.groupBy("set", "more").agg(F.sort_array(F.collect_list(F.struct("n", "key")), asc=False).alias("keys"))
    rest = F.slice("keys", F.shiftright("more", 1).cast("int") + 1, F.size("keys"))
    kept = own.select("set", F.explode(rest).alias("k")).select("k.key", "set")
    return shared_keys(kept).select("hub", "member")


def _with_shingles(chosen: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The shingles of chosen sets (doc_id, set and more) from the text of one document that has them."""
    # The chosen grow with the documents, so both sides are dealt by id whatever their size.
    joined = chosen.join(docs.select("doc_id", "text").hint("merge"), "doc_id")
    more = [c for c in chosen.columns if c != "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            found, begins = _sets(block, length)
            # Another row of the same id may have another text.
            same = set_digests(found, begins).view(np.int64) == np.asarray(block.column("set"))
            raw = [found[a:b].tobytes() for a, b in zip(begins, begins[1:], strict=False)]
            out = [*[block.column(c) for c in more], pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, [*more, "shingles"]).filter(pa.array(same))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema if f.name != "doc_id")
    return joined.select(*more, "text").mapInArrow(run, f"{kinds}, shingles binary")


def _documents_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The documents whose ids pass a sieve of the chosen ones: all of those, and few others."""
    table = sieve(chosen.select(F.xxhash64("doc_id").alias("number")), SIEVE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.asarray(batch.column("number")).view(np.uint64)
            yield batch.select(["doc_id", "text"]).filter(pa.array(passes(table.value, numbers)))

    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("number")).mapInArrow(run, "doc_id long, text string")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kinds, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times > 1
    rank = np.cumsum(common) - 1
    keep = common[place]
    owner, place = owner[keep], rank[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for low in range(0, int(common.sum()), COLUMNS):
        a, b = np.searchsorted(place, [low, low + COLUMNS])
        dense = np.zeros((len(sets), COLUMNS), np.float32)
        dense[owner[a:b], place[a:b] - low] = 1
        out += dense @ dense.T
    return out


def local_components(hits: np.ndarray) -> np.ndarray:
    """For each row of a symmetric table of links, the smallest row that it reaches."""
    label = np.arange(len(hits))
    while True:
        near = np.where(hits, label[None, :], len(hits)).min(1, initial=len(hits))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Groups of rows that agree in the first ``keys`` long columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = np.stack([np.asarray(batch.column(k)) for k in range(keys)], 1)
        edges = [0, *(np.flatnonzero((table[1:] != table[:-1]).any(1)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and tuple(table[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(table[a])
    if held:
        yield pa.Table.from_batches(held)


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 3):
            ids = group.column("set").to_numpy()
            _, one = np.unique(ids, return_index=True)
            ids, copies, block = ids[one], group.column("copies").to_numpy()[one], group.column("block").to_numpy()[one]
            raw = group.column("shingles")
            sets = [np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in one]
            sizes = np.array([len(s) for s in sets])
            shared = overlaps(sets)
            hits = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
            np.fill_diagonal(hits, False)
            if group.column("one")[0].as_py() != group.column("other")[0].as_py():
                hits &= block[:, None] != block[None, :]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(ids[local_components(hits)]), pa.array((hits @ copies).astype(np.int64))],
                ["set", "to", "links"],
            )

    return run


def linked_sets(chosen: DataFrame, docs: DataFrame, length: int, percent: int) -> DataFrame:
    """Compare all sets of each family: rows (set, to, links) with links by number of documents.

    ``chosen`` has doc_id, set, n_shingles, copies, family. A family is cut into blocks, and each two blocks
    meet in one group; a group passes on a row for each of its sets, not its pairs.
    """
    sizes = chosen.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    cut = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("size") * 8 / BLOCK_SIZE)).cast("int")
    placed = chosen.join(sizes.select("family", cut.alias("cut")), "family").withColumn(
        "block", F.pmod(F.xxhash64("set"), F.col("cut")).cast("int")
    )
    full = _with_shingles(placed.select("doc_id", "set", "copies", "family", "cut", "block"), docs, length)
    met = full.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cut") - 1))).select(
        "family", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"),
        "set", "copies", "block", "shingles",
    )
    dealt = met.repartition("family", "one", "other").sortWithinPartitions("family", "one", "other")
    return dealt.mapInArrow(_compare(percent), "set long, to long, links long")


def jaccard_groups(docs: DataFrame, length: int = 3, percent: int = 90, keys: DataFrame | None = None) -> DataFrame:
    """Groups of documents linked by shingles: doc_id, n_shingles, n_links, component_id for each row.

    ``docs`` has doc_id (long) and text; other columns are ignored. Words are lower-cased (A-Z) runs without
    white space; a document's set has its distinct runs of ``length`` words, or its whole sequence if it has
    fewer. Two documents link if ``100 * |both| >= percent * |either|``. n_links counts the other documents
    linked directly, component_id is the smallest doc_id reachable. Null texts and texts without words
    link with nothing, nor do rows with a null doc_id (their component_id is null). Repeated rows are
    copies of each other. Shingles and sets are compared by 64-bit hashes. ``keys`` (key, set) replaces the
    sketches' keys.
    """
    return set_groups(docs, length, percent, keys).drop("set")


def set_groups(docs: DataFrame, length: int = 3, percent: int = 90, keys: DataFrame | None = None) -> DataFrame:
    """:func:`jaccard_groups` with set, the hash of the row's shingles, null for rows that can't link."""
    sized = stored(set_sizes(docs, length), "sets")
    known = docs.filter("doc_id is not null")
    classes = (
        sized.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("set")
        .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"))
    )
    rows = keyed_sets(known, length, percent) if keys is None else keys.select("key", "set", F.lit(0).cast("long").alias("spare"))
    families = components(candidates(rows), "families").withColumnsRenamed({"node": "set", "component_id": "family"})
    chosen = stored(classes.join(families, "set"), "candidates")
    # Most sets have a sketch key in common with others, few a key of the caller's.
    texts = known if keys is None else _documents_of(known, chosen)
    found = stored(linked_sets(chosen, texts, length, percent), "links")
    groups = components(found.select("set", "to"), "groups").withColumnsRenamed({"node": "set", "component_id": "group"})
    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    grouped_classes = chosen.select("set", "doc_id").join(groups, "set")
    least = grouped_classes.groupBy("group").agg(F.min("doc_id").alias("least"))
    own = (
        classes.join(links, "set", "left")
        .join(grouped_classes.select("set", "group").join(least, "group").select("set", "least"), "set", "left")
        .select(
            "set",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("least", "doc_id").alias("component_id"),
        )
    )
    linked = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("set"))
    return (
        sized.withColumn("set", linked)
        .join(own, "set", "left")
        .select(
            "doc_id",
            "set",
            "n_shingles",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("component_id", "doc_id").alias("component_id"),
        )
    )
