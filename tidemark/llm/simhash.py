"""SimHash fingerprints and their links: tiled exact comparison by exclusive-or and bit counts.

A tile holds the fingerprints of one signature, the bit counts of the four quarters of the 64 bits. Two
fingerprints that differ in at most ``radius`` bits have signatures that differ by at most ``radius`` in
sum, so all other pairs of tiles are skipped; a tile meets itself and those of its neighbours that
come after it. Inside a pair of tiles every pair of fingerprints is compared, in numpy blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BATCH_ROWS, by_bytes, materialize, mix64, send_if_small, table, text_bytes
from tidemark.llm.graph import connected_components

_SEED = 42
#: Documents of at most so many different shingles are candidates whatever their bits, which say little then.
FEW = 32
#: Byte value -> its bits in the eight bytes of a 64-bit number, so that up to 255 rows add without carry.
_SPREAD = (((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1)) << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64)


def shingles(text: bytes | None, k: int) -> list[bytes]:
    """Every k consecutive words, A-Z lower-cased, joined by a space; the whole sequence if it is shorter."""
    words = (text or b"").lower().split()
    if len(words) < k:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes, the bits set in over half of them; an empty run gives 0."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    c = counts[full]
    parts = -(-c // 255)
    base = np.concatenate(([0], np.cumsum(c)))[:-1]
    step = np.arange(parts.sum()) - np.repeat(np.concatenate(([0], np.cumsum(parts)))[:-1], parts)
    at = np.repeat(base, parts) + 255 * step
    raw = hashes.view(np.uint8).reshape(-1, 8)
    first = np.concatenate(([0], np.cumsum(parts)))[:-1]
    for byte in range(8):
        lanes = np.add.reduceat(_SPREAD[raw[:, byte]], at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        sums = np.add.reduceat(lanes, first, axis=0)
        bits = np.packbits(sums * 2 > c[:, None], axis=1, bitorder="little")[:, 0]
        out[full] |= bits.astype(np.uint64) << np.uint64(8 * byte)
    return out


def _fingerprint(k: int):
    def fingerprint(batches: Iterator):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in batches:
            ids, texts = batch.column(0), text_bytes(batch.column(1))
            for low, high in by_bytes(texts):
                own = [[xxh64_intdigest(s, _SEED) for s in shingles(t, k)] for t in texts[low:high]]
                fp = majority_bits(np.array([x for h in own for x in h], dtype=np.uint64), np.array([len(h) for h in own], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), pa.array(fp.view(np.int64)), pa.array([len(set(h)) for h in own], pa.int32())], names=["doc_id", "fp", "n"])

    return fingerprint


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, n): the fingerprint as a signed long and the number of different shingles."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(_fingerprint(k), f"doc_id {kind}, fp long, n int")


#: Weights of the bit counts of the quarters in the number of a signature.
_UNIT = (17**3, 17**2, 17, 1)


def _signature_tiles(radius: int, blocks: dict):
    """Rows (tile, block, guest, fp): each fingerprint at home in a block of its own tile, and a guest in the blocks of that
    tile that come before and in all blocks of those neighbours that come before. ``blocks``: tiles of over one block."""
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if 0 < sum(map(abs, d)) <= radius]
    steps = [d for d in steps if d < (0, 0, 0, 0)]
    unit = np.array(_UNIT)

    def deal(batches: Iterator):
        import pyarrow as pa

        number = np.ones(17**4, dtype=np.int64)
        for t, n in blocks.items():
            number[t] = n

        def rows(tile, block, guest, fp):
            return pa.RecordBatch.from_arrays([pa.array(tile.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(np.full(len(fp), guest)), pa.array(fp)], names=["tile", "block", "guest", "fp"])

        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            quarters = np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int64)
            tile = quarters @ unit
            own = (mix64(fp.view(np.uint64)) % number[tile].astype(np.uint64)).astype(np.int64)
            yield rows(tile, own, False, fp)
            for j in range(int(own.max(initial=0))):
                yield rows(tile[own > j], np.full((own > j).sum(), j), True, fp[own > j])
            for d in steps:
                there = quarters + np.array(d)
                ok = ((there >= 0) & (there <= 16)).all(axis=1)
                near, mine = there[ok] @ unit, fp[ok]
                for j in range(int(number[near].max(initial=0))):
                    has = number[near] > j
                    yield rows(near[has], np.full(has.sum(), j), True, mine[has])

    return deal


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and b of pairs that differ in at most ``radius`` bits, block by block."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i in range(0, len(a), 512):
        x = a[i : i + 512, None]
        for j in range(0, len(b), 2048):
            p, q = np.nonzero(np.bitwise_count(x ^ b[None, j : j + 2048]) <= radius)
            if len(p):
                found.append((p + i, q + j))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _compare_tiles(radius: int):
    """Links of sorted rows (tile, block, guest, fp): those at home with each other, then every piece of guests with them."""

    def compare(batches: Iterator):
        import pyarrow as pa

        def result(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        def settle():
            nonlocal home, homes
            if homes:
                home, homes = np.concatenate(homes), []
                p, q = _near(home, home, radius)
                yield result(home[p[p < q]], home[q[p < q]])

        key, homes, home = None, [], None
        for batch in batches:
            tile, block, guest = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = np.ascontiguousarray(batch.column(3).to_numpy(zero_copy_only=False)).view(np.uint64)
            cuts = np.flatnonzero((tile[1:] != tile[:-1]) | (block[1:] != block[:-1]) | (guest[1:] != guest[:-1])) + 1
            for low, high in zip([0, *cuts], [*cuts, len(fp)], strict=True):
                if low == high:
                    continue
                if (tile[low], block[low]) != key:
                    yield from settle()
                    key, home = (tile[low], block[low]), None
                if not guest[low]:
                    homes.append(fp[low:high])
                    continue
                yield from settle()
                if home is not None:
                    p, q = _near(home, fp[low:high], radius)
                    yield result(home[p], fp[low:high][q])
        yield from settle()

    return compare


def fingerprint_links(fps: DataFrame, radius: int = 2, tile_rows: int = 16_384) -> DataFrame:
    """(a, b) for every pair of the distinct fingerprints ``fps`` (fp) that differ in at most ``radius`` bits.

    A fingerprint has at most 2,080 partners at radius 2, so the links grow as the fingerprints do. Tiles of over
    ``tile_rows`` fingerprints are cut into blocks.
    """
    quarter = lambda i: F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)))
    sizes = fps.groupBy(sum(quarter(i) * u for i, u in enumerate(_UNIT)).alias("tile")).count()
    blocks = {r["tile"]: -(-r["count"] // tile_rows) for r in sizes.filter(F.col("count") > tile_rows).collect()}  # at most 17 ** 4 tiles
    dealt = fps.select("fp").mapInArrow(_signature_tiles(radius, blocks), "tile int, block int, guest boolean, fp long")
    return dealt.repartition("tile", "block").sortWithinPartitions("tile", "block", "guest").mapInArrow(_compare_tiles(radius), "a long, b long")


def simhash_components(docs: DataFrame, k: int = 3, radius: int = 2, tile_rows: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, fingerprint (16 hex digits), component_id, n_shingles.

    Documents with one fingerprint form a class; classes link at ``radius`` or fewer differing bits;
    component_id is the smallest identifier reachable over links (null only where a component has no
    identifier). Null and empty texts have the zero fingerprint and link like any other. Rows that repeat
    an identifier keep their own fingerprints. An empty table gives an empty result.
    """
    marked = materialize(fingerprints(docs, k, id_col, text_col), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    components = connected_components(fingerprint_links(classes, radius, tile_rows))
    labelled = classes.join(components.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = labelled.join(least, "component").select("fp", "component_id")
    return marked.join(of_fp, "fp", "left").select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("n").alias("n_shingles"))


# Near duplicates by similarity ---------------------------------------------------------------------------

#: Tables of smallest hashes: sets of similarity s share no smallest hash in (1 - s) ** TABLES of the cases, 1 in 15,000 at 0.8.
TABLES = 6
#: Rows of a part in the first pass, and rows and shingles of a block in the second.
PART_ROWS, BLOCK_ROWS, BLOCK_CELLS = 128, 1024, 1_000_000
#: Pairs of rows that numpy holds at once; fewer where each has a row of smallest hashes.
PAIRS, WIDE_PAIRS = 1 << 20, 1 << 17


def _sketch(k: int, tables: int):
    """Of each text: 128 majority bits over its different shingles, their number, their sum, and the smallest of them under
    each of ``tables`` orders."""

    def sketch(batches: Iterator):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        orders = mix64(np.arange(1, tables + 1, dtype=np.uint64))
        for batch in batches:
            ids, texts = batch.column(0), text_bytes(batch.column(1))
            for low, high in by_bytes(texts):
                own = [list({xxh64_intdigest(s, _SEED) for s in shingles(t, k)}) for t in texts[low:high]]
                counts = np.array([len(x) for x in own], dtype=np.int64)
                h = np.array([x for s in own for x in s], dtype=np.uint64)
                full, at = counts > 0, np.concatenate(([0], np.cumsum(counts[counts > 0])))[:-1]
                more = mix64(h)
                least = np.zeros((len(own), tables), dtype=np.uint64)
                total = np.zeros(len(own), dtype=np.uint64)
                if len(h):
                    total[full] = np.add.reduceat(more, at)
                    for j, o in enumerate(orders):
                        least[full, j] = np.minimum.reduceat(mix64(h ^ o), at)
                mins = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * tables), pa.array(least.ravel().view(np.int64)))
                bits = [pa.array(x.view(np.int64)) for x in (majority_bits(h, counts), majority_bits(more, counts), total)]
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), *bits, pa.array(counts.astype(np.int32)), mins], names=["node", "fp", "fp2", "total", "n", "mins"])

    return sketch


def _groups(batches: Iterator, keys: int, least: int = 2):
    """Whole groups of rows with equal leading ``keys`` columns from sorted batches: (table, bounds of its groups)."""
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        cols = [held.column(i).to_numpy() for i in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        if len(change):
            yield held.slice(0, change[-1]), np.concatenate(([0], change))
            held = held.slice(change[-1])
    if held is not None:
        cols = [held.column(i).to_numpy() for i in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        yield held, np.concatenate(([0], change, [held.num_rows]))


def _ranges(first: np.ndarray, stop: np.ndarray, most: int = PAIRS):
    """Positions (p, q), p fixed and first[p] <= q < stop[p], at most about ``most`` at a time."""
    n = np.maximum(stop - first, 0)
    upto = np.cumsum(n)
    low = 0
    while low < len(n):
        done = upto[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(upto, done + most, "right")))
        m = n[low:high]
        p = np.repeat(np.arange(low, high), m)
        yield p, np.arange(len(p)) - np.repeat(np.cumsum(m) - m, m) + first[p]
        low = high


def _candidates(radius: int, ratio: float):
    """Rows (t, m, part, node, label) that have a partner in their group: bits within ``radius``, sizes within ``ratio``, another label,
    and no smallest hash of an earlier table in common (that table has the pair). Rows stand in the order of their
    population counts, so the partners of a row end where the counts differ by more than ``radius``."""

    def compare(batches: Iterator):
        import pyarrow as pa

        for rows, bounds in _groups(batches, 3):
            t, m, part, node, fp, fp2, n, label = (rows.column(i).to_numpy() for i in range(8))
            mins = rows.column(8).combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            fp, fp2 = fp.view(np.uint64), fp2.view(np.uint64)
            pop = (np.bitwise_count(fp) + np.bitwise_count(fp2)).astype(np.int64)
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            hit = np.zeros(len(node), dtype=bool)
            earlier = np.arange(mins.shape[1])

            def look(order, stop, bits):
                for p, q in _ranges(np.arange(1, len(order) + 1), stop, WIDE_PAIRS):
                    p, q = order[p], order[q]
                    if bits:
                        ok = np.bitwise_count(fp[p] ^ fp[q]) + np.bitwise_count(fp2[p] ^ fp2[q]) <= radius
                        p, q = p[ok], q[ok]
                    ok = (label[p] != label[q]) & (np.minimum(n[p], n[q]) >= ratio * np.maximum(n[p], n[q]) - 1e-9)
                    p, q = p[ok], q[ok]
                    new = ~((mins[p] == mins[q]) & (earlier < t[p][:, None])).any(axis=1)
                    hit[p[new]] = hit[q[new]] = True

            order = np.lexsort((pop, group))
            key = group[order] * 1000 + pop[order]
            look(order, np.minimum(np.searchsorted(key, key + radius, "right"), bounds[1:][group[order]]), True)
            order = np.flatnonzero(n <= FEW)  # bits of few shingles say little
            look(order, np.searchsorted(group[order], group[order], "right"), False)
            at = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (t, m, part, node, label)], names=["t", "m", "part", "node", "label"])

    return compare


def _similar(sets: list, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions p < q of all pairs of sets (sorted 64-bit hashes) of at least this Jaccard similarity."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    stop = np.searchsorted(flat, flat, "right")  # owners rise within equal hashes
    shared = np.zeros(len(sets) ** 2, dtype=np.int64)
    for p, q in _ranges(np.arange(1, len(flat) + 1), stop):
        shared += np.bincount(owner[p] * len(sets) + owner[q], minlength=len(shared))
    p, q = np.divmod(np.flatnonzero(shared), len(sets))
    both = shared[p * len(sets) + q]
    ok = both >= ratio * (size[p] + size[q] - both) - 1e-9
    return p[ok], q[ok]


def _least_reached(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of n positions the smallest that the links (p, q) lead to."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[p], least[q])
        new = least.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _verify(ratio: float):
    """Links (a, b), at most one for each label of a group, that join the labels whose sets are similar."""

    def verify(batches: Iterator):
        import pyarrow as pa

        for rows, bounds in _groups(batches, 3):
            label, sets = rows.column(4).to_numpy(), rows.column(5).combine_chunks()
            flat, at = sets.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(sets.value_lengths().to_numpy())))
            out_a, out_b = [], []
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if high - low < 2:
                    continue
                p, q = _similar([flat[at[i] : at[i + 1]] for i in range(low, high)], ratio)
                names, own = np.unique(label[low:high], return_inverse=True)
                least = _least_reached(len(names), own[p], own[q])
                joined = np.flatnonzero(least != np.arange(len(names)))
                out_a.append(names[joined])
                out_b.append(names[least[joined]])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out_a, out_b)], names=["a", "b"])

    return verify


def _shingle_sets(k: int):
    def sets(batches: Iterator):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in batches:
            texts = text_bytes(batch.column(1))
            for low, high in by_bytes(texts):
                own = [np.unique(np.array([xxh64_intdigest(s, _SEED) for s in shingles(t, k)], dtype=np.uint64)).view(np.int64) for t in texts[low:high]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(own, pa.list_(pa.int64()))], names=["node", "set"])

    return sets


def _links(members: DataFrame, docs: DataFrame, k: int, similarity: float, radius: int) -> DataFrame:
    """Verified links of ``members`` (t, m, part, node, fp, fp2, n, label, mins), group by group, as a written table."""
    key = ["t", "m", "part"]
    near = members.select(*key, "node", "fp", "fp2", "n", "label", "mins").repartition(*key).sortWithinPartitions(*key)
    near = materialize(near.mapInArrow(_candidates(radius, similarity), "t int, m long, part long, node long, label long"), "near", BATCH_ROWS)
    nodes = send_if_small(near.select("node").distinct(), "near-nodes")
    sets = materialize(docs.join(nodes, "node", "left_semi").mapInArrow(_shingle_sets(k), "node long, set array<long>"), "shingle-sets", BATCH_ROWS)
    found = near.join(sets, "node").select(*key, "node", "label", "set")
    return materialize(found.repartition(*key).sortWithinPartitions(*key).mapInArrow(_verify(similarity), "a long, b long"), "near-links", BATCH_ROWS)


def near_duplicates(
    docs: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 36, tables: int = TABLES, part_rows: int = PART_ROWS, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per identifier: doc_id, component_id (smallest identifier reachable over near-duplicate links).

    Two documents link if the sets of their k-word shingles have a Jaccard similarity of at least ``similarity``, checked
    exactly. Candidates are 128-bit fingerprints (majorities over the different shingles) within ``radius`` bits, compared
    by exclusive-or and bit counts in tiles: at a radius this wide population counts alone exclude little, so a tile
    holds the documents with one smallest shingle hash, for each of ``tables`` orders of the hashes, and counts cut the
    comparisons inside. At similarity 0.8 itself a pair is in no common tile in 1 of 15,000 cases and beyond the
    radius in about as many; documents of at most ``FEW`` different shingles are compared without the fingerprints.

    A first pass compares parts of at most about ``part_rows`` documents of a tile, each with the tile's smallest
    document, and so joins copies of one text in time linear in their number. A second compares all blocks of
    those larger tiles that are still several components. Sets are compared where the tile is, and a group of rows gives
    at most one link for each component in it. Equal sets are one row throughout.

    Null and wordless texts are equal. Null identifiers are left out; rows that repeat an identifier are compared
    each, and the smallest of their components is given. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    marked = materialize(rows.mapInArrow(_sketch(k, tables), "node long, fp long, fp2 long, total long, n int, mins array<long>"), "sketches", BATCH_ROWS)
    same = ["fp", "fp2", "total", "n", "mins"]
    classes = materialize(marked.groupBy(*same).agg(F.min("node").alias("node")), "sketch-classes")
    placed = classes.filter("n > 0").select("node", "fp", "fp2", "n", "mins", F.posexplode("mins").alias("t", "m"))
    tiles = placed.groupBy("t", "m").agg(F.count("*").alias("rows"), F.sum("n").alias("cells"), F.min("node").alias("leader")).filter("rows > 1")
    members = materialize(placed.join(tiles, ["t", "m"]), "tile-members")

    parts = F.ceil(F.col("rows") / part_rows)
    own = F.pmod(F.xxhash64("node"), parts)
    everywhere = F.when(F.col("node") == F.col("leader"), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(own))
    first = _links(members.withColumn("label", F.col("node")).withColumn("part", F.explode(everywhere)), rows, k, similarity, radius)

    large = members.filter(F.col("rows") > part_rows)
    labels = connected_components(first)
    large = large.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    several = large.groupBy("t", "m").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low < _high").select("t", "m")
    large = materialize(large.join(several, ["t", "m"]), "large-tiles")
    blocks = F.ceil(F.greatest(F.col("rows") / block_rows, F.col("cells") / BLOCK_CELLS))
    large = large.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("_blocks")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1), lambda j: (j != F.col("_own")) | (F.col("_blocks") == 1))
    pair = F.transform(others, lambda j: F.least(j, F.col("_own")) * F.col("_blocks") + F.greatest(j, F.col("_own")))
    second = _links(large.withColumn("part", F.explode(pair)), rows, k, similarity, radius)

    components = connected_components(first.unionByName(second))
    found = marked.withColumnRenamed("node", "id").join(classes, same).join(components, "node", "left")
    return found.groupBy(F.col("id").alias(id_col)).agg(F.min(F.coalesce("component", "node")).alias("component_id"))


def op9_simhash_components(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"), k=3, radius=2)
