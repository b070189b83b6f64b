"""Near-duplicates by one-permutation hashing, banded buckets and star-shaped edges.

Distinct word shingles are hashed once; the top bits of a hash choose a bin, the
least hash of a bin stays, and an empty bin borrows from a full one along its
own fixed order of bins (optimal densification). Bands of bins are the buckets.
Each bucket ties its members to one hub only; a member is first compared with
the hub it shares most buckets with, and each link is confirmed on the full
sets. Two members may be linked although neither is a hub. So components are
tied by further stars: in each bucket one member of every other component meets
one of the main component, drawn by a hash. What still lies between two
components is looked through once more: ties to other hubs, and, in buckets with
strays outside their main component, the strays against the others, in blocks of
bounded size, on the full sets; a block gives the links that join components,
not every pair that is alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut_lineage
from quern.llm.components import components
from quern.llm.textkit import U64, blocks, mix, shingle_set, text_bytes, word_hashes

BINS, BANDS = 128, 32
SHIFT = U64(64 - BINS.bit_length() + 1)
#: Sets of one side of a cell, about: what a task holds at once is twice as many sets.
BLOCK = 128


def _orders(bins: int, seed: int = 11) -> np.ndarray:
    """For each bin, the order in which it asks the others: a row of all bins."""
    draw = mix(np.arange(bins * bins, dtype=U64) + U64(seed << 32)).reshape(bins, bins)
    return draw.argsort(1)


_ORDER = _orders(BINS)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each bin of a sorted set that is not empty; empty bins borrow."""
    bins = (shingles >> SHIFT).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out, full = np.zeros(BINS, U64), np.zeros(BINS, bool)
    out[bins[first]], full[bins[first]] = shingles[first], True
    if not full.all():
        empty = np.flatnonzero(~full)
        asked = _ORDER[empty]
        out[empty] = out[asked[np.arange(len(empty)), full[asked].argmax(1)]]
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A key for each band of each signature; different bands never share keys on purpose."""
    rows = signatures.reshape(len(signatures), BANDS, BINS // BANDS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        key = mix(key * U64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key


def _set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets_of(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    data, offsets = text_bytes(column)
    for first, last in blocks(offsets):
        word, at = word_hashes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        for k in range(last - first):
            yield shingle_set(word[at[k] : at[k + 1]], width)


def _features(width: int):
    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            sizes, keys, signs = [], [], []
            for s in _sets_of(frame.column("text"), width):
                sizes.append(len(s))
                keys.append(_set_key(s) if len(s) else None)
                signs.append(signature(s) if len(s) else np.zeros(BINS, U64))
            bands = band_keys(np.array(signs)).view(np.int64) if signs else np.zeros((0, BANDS), np.int64)
            listed = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({"row": frame.column("row"), "doc_id": frame.column("doc_id"), "print": frame.column("print"), "n_shingles": pa.array(sizes, pa.int64()), "set_key": pa.array(keys, pa.binary()), "bands": listed})

    return batches


def _full_sets(width: int):
    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            wanted, node = frame.column("set_key").to_pylist(), frame.column("node").to_pylist()
            rows = [(n, s) for n, k, s in zip(node, wanted, _sets_of(frame.column("text"), width), strict=True) if len(s) and _set_key(s) == k]
            ends = np.concatenate([[0], np.cumsum([len(s) for _, s in rows])]).astype(np.int32)
            flat = np.concatenate([s for _, s in rows]).view(np.int64) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"node": pa.array([n for n, _ in rows], pa.int64()), "shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})

    return batches


def forest(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the two sides that join sets of different labels: as many as it takes, not all.

    Two sets are linked if they have ``percent`` percent of their union in common,
    counted on whole sets; labels that a link joins count as one from then on.
    """
    m, size = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), size)
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    renumbered = np.cumsum(times > 1) - 1
    used = times[place] > 1
    owner, place = owner[used], renumbered[place[used]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((m, m), np.float32)
    for lo in range(0, int((times > 1).sum()), 4096):
        a, b = np.searchsorted(place, [lo, lo + 4096])
        grid = np.zeros((m, 4096), np.float32)
        grid[owner[a:b], place[a:b] - lo] = 1
        both += grid @ grid.T
    common = both.astype(np.int64)
    fit = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    fit &= (label[:, None] != label[None, :]) & (side[:, None] < side[None, :])
    a, b = np.nonzero(fit)
    names, code = np.unique(label, return_inverse=True)
    _, first = np.unique(code[a] * len(names) + code[b], return_index=True)
    up = list(range(len(names)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    kept = []
    for k in first.tolist():
        x, y = root(code[a[k]]), root(code[b[k]])
        if x != y:
            up[x] = y
            kept.append(k)
    return a[kept], b[kept]


def _block_links(percent: int):
    """Rows sorted by (key, i, j): one cell of a bucket's grid after another."""

    def cells(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        rest = None
        for frame in frames:
            t = pa.Table.from_batches([frame])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            ids = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
            edge = np.concatenate([[0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1]) if t.num_rows else np.zeros(0, np.int64)
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                yield t.slice(a, b - a)
            rest = t.slice(edge[-1]) if len(edge) else None
        if rest is not None and rest.num_rows:
            yield rest

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(frames):
            label, node, side = (cell.column(c).to_numpy() for c in ("component", "node", "side"))
            if (label == label[0]).all() or side.all() or not side.any():
                continue
            listed = cell.column("shingles").combine_chunks()
            flat, at = listed.values.to_numpy(), listed.offsets.to_numpy()
            a, b = forest([flat[at[k] : at[k + 1]] for k in range(len(label))], label, side, percent)
            yield pa.RecordBatch.from_pydict({"u": pa.array(np.maximum(node[a], node[b])), "v": pa.array(np.minimum(node[a], node[b]))})

    return batches


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    one = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    two = one.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    near = F.least(F.size("a"), F.size("b")) * 100 >= F.greatest(F.size("a"), F.size("b")) * percent
    common = F.size(F.array_intersect("a", "b"))
    alike = F.when(near, common * 100 >= (F.size("a") + F.size("b") - common) * percent).otherwise(F.lit(False))
    return two.where(alike).select("u", "v")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A-Z are lower-cased. Two documents are linked if their sets of ``width``-word
    shingles have ``percent`` percent or more of their union in common; a
    component is all that links reach, named by its smallest doc_id, which alone
    is kept. A text of fewer words is one shingle; a null or empty text, or one
    of white space, has no shingle and no link, and is kept.

    Two sets at exactly 75 percent share none of the 32 bands of four bins with
    a chance of 5 in a million; no other link between components is lost.
    Shingles and words are told apart by 64-bit hashes.

    Equal sets are one node from the start, so copies cost nothing further.
    Ids may repeat or be null (a null id never names a component unless all its
    ids are null; kept is then true); rows are told apart by a number of their
    own. Further columns are ignored; an empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("print"))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    feat = cut_lineage(numbered.mapInArrow(_features(width), f"row bigint, doc_id {id_type}, print bigint, n_shingles bigint, set_key binary, bands array<bigint>"))
    some = feat.where("n_shingles > 0")
    # Sums by key are written before they are joined to their rows: the join then
    # shuffles both sides by itself, and a hot key's rows can be split.
    member_of = cut_lineage(some.groupBy("set_key").agg(F.min("row").alias("node")))
    nodes = some.join(member_of, "set_key").where("row = node")

    spread = nodes.select("node", F.explode("bands").alias("key"))
    heads = cut_lineage(spread.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1"))
    bucketed = cut_lineage(spread.join(heads, "key"))
    stars = cut_lineage(bucketed.where("node != hub").groupBy(F.col("node").alias("u"), F.col("hub").alias("v")).agg(F.count(F.lit(1)).alias("bands")))
    wanted = stars.select("u").unionByName(stars.select(F.col("v").alias("u"))).distinct().withColumnRenamed("u", "node")
    # An id alone would bring every text of a repeated or null id to every node of it.
    known = nodes.select("node", "set_key", F.col("doc_id").alias("__id"), F.col("print").alias("__print")).join(wanted, "node")
    texts = rows.join(known, rows["doc_id"].eqNullSafe(known["__id"]) & (rows["print"] == known["__print"])).select("node", "set_key", "text")
    sets = cut_lineage(texts.mapInArrow(_full_sets(width), "node bigint, shingles array<bigint>"))
    if not docs.select(id_col).groupBy(id_col).count().where("count > 1").isEmpty():
        sets = sets.dropDuplicates(["node"])

    # First each node meets the hub it shares most bands with: of its ties the likeliest.
    best = stars.groupBy("u").agg(F.min_by("v", F.struct(-F.col("bands"), F.col("v"))).alias("v"))
    label = components(cut_lineage(confirmed(best, sets, percent)))
    label = bridged(bucketed, label, sets, percent)

    # Then what still lies between two components: the other ties, and pairs without the hub.
    named = label.withColumnRenamed("component", "at")
    ends = stars.join(named.withColumnRenamed("node", "u").withColumnRenamed("at", "cu"), "u", "left").join(named.withColumnRenamed("node", "v").withColumnRenamed("at", "cv"), "v", "left")
    ties = ends.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")
    strays = stray_links(bucketed, label, sets, percent)
    more = cut_lineage(confirmed(ties.join(best, ["u", "v"], "left_anti"), sets, percent).unionByName(strays).distinct())
    joined = more.join(named.withColumnRenamed("node", "u").withColumnRenamed("at", "cu"), "u", "left").join(named.withColumnRenamed("node", "v").withColumnRenamed("at", "cv"), "v", "left")
    between = components(joined.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")))

    found = feat.join(member_of, "set_key", "left").join(label, "node", "left").withColumn("at", F.coalesce("component", "node", "row")).drop("component")
    found = found.join(between.withColumnRenamed("node", "at"), "at", "left").select("doc_id", "row", "n_shingles", F.coalesce("component", "at").alias("component"))
    least = cut_lineage(found.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    out = found.join(least, "component")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def bridged(bucketed: DataFrame, label: DataFrame, sets: DataFrame, percent: int, rounds: int = 1) -> DataFrame:
    """``label`` with components joined by stars between them.

    In each round, each bucket of several components draws a member of each; the
    one of its largest component is the hub that the others meet. A bucket makes
    one pair for each of its other components, however many members they have.
    Where copies of one text are linked to some of the others only, a round ties
    nearly all of them, since each shares many buckets with the rest; a second
    one finds next to nothing.
    """
    for k in range(rounds):
        labelled = bucketed.where("c > 2").join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        held = cut_lineage(labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(k)), F.col("node"))).alias("drawn")))
        hubs = cut_lineage(held.groupBy("key").agg(F.max(F.struct("n", "component", "drawn")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1"))
        met = held.join(hubs, "key").where("component != main.component").select(F.col("drawn.node").alias("a"), F.col("main.drawn.node").alias("b"), "component", F.col("main.component").alias("other"))
        pairs = cut_lineage(met.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), F.greatest("component", "other").alias("cu"), F.least("component", "other").alias("cv")).distinct())
        links = confirmed(pairs.select("u", "v"), sets, percent)
        merged = components(pairs.join(links, ["u", "v"]).select(F.col("cu").alias("u"), F.col("cv").alias("v")))
        renamed = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
        moved = label.join(renamed, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        label = cut_lineage(moved.unionByName(merged))  # what merged lists was the name of its component, or alone
    return label


def stray_links(bucketed: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v), u > v: links within buckets that join two components, as many as it takes.

    bucketed: key, node, c (members of the bucket). A bucket's largest component
    needs no look within itself. Only its strays, the members outside of it, are
    dealt to blocks of ``BLOCK``, and each block meets all members in blocks of
    that size, by their whole sets. A bucket of c members and s strays sends some
    2 * s * c / BLOCK + c rows; buckets without strays send none. A cell gives
    fewer links than it has components, however many of its pairs are alike.
    """
    labelled = bucketed.where("c > 2").join(label, "node", "left").select("key", "node", "c", F.coalesce("component", "node").alias("component"))
    held = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("c"))
    open_ = cut_lineage(held.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), (F.max("c") - F.max("n")).alias("strays")).where("strays > 0"))
    met = labelled.join(open_, "key")
    into = lambda n: F.expr(f"int(({n} + {BLOCK - 1}) div {BLOCK})")
    dealt = lambda n: F.pmod(F.xxhash64("node"), into(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = met.where("component != main").select("key", "node", "component", F.lit(0).alias("side"), dealt("strays").alias("i"), upto(into("c")).alias("j"))
    # A stray answers the blocks up to its own, so two strays meet in one of their two cells, or in both of one block.
    blocks_of = F.when(F.col("component") == F.col("main"), into("strays")).otherwise(dealt("strays") + 1)
    answers = met.select("key", "node", "component", F.lit(1).alias("side"), upto(blocks_of).alias("i"), dealt("c").alias("j"))
    cells = asked.unionByName(answers).join(sets, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return cells.select("key", "i", "j", "node", "component", "side", "shingles").mapInArrow(_block_links(percent), "u bigint, v bigint")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    kept = near_groups(docs, id_col=id_col, **options).where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__kept_id"]), "left_semi")


#: DuckDB SQL for the rows of ``near_groups`` with its default settings: all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
ends AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT d, y FROM reach JOIN ends ON x = r)
SELECT d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id, d = min(r) AS kept FROM reach LEFT JOIN n ON n.doc_id = d GROUP BY d"""
