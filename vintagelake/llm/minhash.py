"""Near-duplicates by ProbMinHash, banding and verification.

Shingles of five words, weighted by their counts, arrive at the registers of a sketch as Poisson processes with those
rates: a shingle's next arrival time and register are hashes of it. A register keeps its earliest arrival. A shingle
is done when its next arrival is later than every register's, so most shingles of a long text stop after one or two.
Two sketches agree in a register with the probability Jaccard similarity of the weighted sets, which for equal weights
is the plain Jaccard similarity. That similarity is also the one that candidates are verified by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagelake.llm.common import map_texts, written

SHINGLE = 5
SIMILAR = 0.8
#: Bands of rows: a pair at similarity 0.8 shares no band with probability (1 - 0.8**5)**25 < 0.0001.
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Sketches that agree less are not compared in full: four standard deviations below the threshold.
NEAR = SIMILAR - 4 * (SIMILAR * (1 - SIMILAR) / REGISTERS) ** 0.5
#: Rows of a key and two numbers that are broadcast at most.
BROADCAST_ROWS = 400_000
#: Texts, and their shingles, that one task compares with each other.
CHUNK_TEXTS, CHUNK_SHINGLES = 1024, 400_000
#: Columns of a dense product of texts by shingles.
COLUMNS = 2048
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers; a bijection."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the text's different shingles in order of size, and their counts. Fewer than five words make one shingle; no word makes none."""
    words = text.encode().split()
    if not words:
        return np.zeros(0, U), np.zeros(0)
    h = np.array(list(map(xxhash.xxh64_intdigest, words)), U)
    width = min(SHINGLE, len(h))
    made = np.full(len(h) - width + 1, width, U)
    for k in range(width):
        made = mix(made * U(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    found, counts = np.unique(made, return_counts=True)
    return found, counts.astype(float)


def sketches(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """ProbMinHash sketches (rows of 32-bit hashes of the winners) of weighted sets, all sets at once; 0 for an empty set."""
    n = len(sets)
    doc = np.repeat(np.arange(n), [len(s[0]) for s in sets])
    times = np.full((n, REGISTERS), np.inf)
    flat = times.reshape(-1)
    out = np.zeros(n * REGISTERS, np.uint32)
    if not len(doc):
        return out.reshape(n, REGISTERS)
    item = np.concatenate([s[0] for s in sets])
    pace = 1 / np.concatenate([s[1] for s in sets])
    at = np.zeros(len(item))
    arrivals = []
    turn = 0
    while len(item):
        turn += 1
        drawn = mix(item + U(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        at = at - np.log((drawn >> U(11)).astype(float) * 2.0**-53 + 2.0**-54) * pace
        place = doc * REGISTERS + (mix(drawn ^ U(0xD1B54A32D192ED03)) % U(REGISTERS)).astype(np.int64)
        np.minimum.at(flat, place, at)
        won = at == flat[place]
        arrivals.append((place[won], at[won], item[won]))
        going = at < times.max(1)[doc]
        item, pace, at, doc = item[going], pace[going], at[going], doc[going]
    for place, when, winner in arrivals:
        still = when == flat[place]
        out[place[still]] = (winner[still] >> U(32)).astype(np.uint32)
    return out.reshape(n, REGISTERS)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two weighted sets."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if a[1].max() == a[1].min() == b[1].max() == b[1].min():
        return len(both) / (len(a[0]) + len(b[0]) - len(both))
    # For a common shingle: the sum over all shingles of the larger of the two weights, in units of its own weights.
    x, y = a[1][i], b[1][j]
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    xs, ys, rs = x[order], y[order], ratio[order]
    first = np.searchsorted(rs, ratio, "left")
    above = (a[1].sum() - x.sum()) + np.append(np.cumsum(xs[::-1])[::-1], 0.0)[first]
    below = (b[1].sum() - y.sum()) + np.append(0.0, np.cumsum(ys))[first]
    return float((1 / (above / x + below / y)).sum())


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; a null text counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def sketch_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, key, size, sketch) of every row: the text's key, its number of shingles, and its sketch (null without words)."""

    def run(texts: list[str]) -> dict:
        sets = [shingles(t) for t in texts]
        made = []
        for start in range(0, len(sets), 256):
            made += [x.tobytes() for x in sketches(sets[start : start + 256])]
        return {"size": pa.array([len(s[0]) for s in sets], pa.int32()), "sketch": pa.array([m if len(s[0]) else None for m, s in zip(made, sets, strict=True)], pa.binary())}

    t = F.col(f"`{text}`")
    return map_texts(docs.select("doc_id", text_key(t).alias("key"), t.alias("text")), ["doc_id", "key"], run, "size int, sketch binary")


def band_rows(sketched: DataFrame) -> DataFrame:
    """(band, node): a 64-bit hash of each band of each sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(U)
            h = np.tile(np.arange(1, BANDS + 1, dtype=U), (len(s), 1))
            for k in range(ROWS):
                h = mix(h * U(0x9E3779B97F4A7C15) + s[:, :, k])
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(node)], names=["band", "node"])

    return sketched.select("node", "sketch").mapInArrow(run, "band bigint, node bigint")


def near_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches agree in a share of at least NEAR of the registers and whose sizes allow the threshold."""
    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
            ok = pa.array((a == b).mean(1) >= NEAR)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a bigint, b bigint")


def shingle_sets(nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(node, items, weights) of the nodes, from one row of docs each; weights is null where all are 1.

    Nodes are broadcast if few, else joined by a shuffle. A row that is repeated with its doc_id gives its set once.
    """
    few = nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    t = F.col(f"`{text}`")
    keyed = docs.select(F.coalesce("doc_id", F.lit(0)).alias("first"), text_key(t).alias("key"), t.alias("text"))
    one = nodes.select("node", "key", F.coalesce("first", F.lit(0)).alias("first"))
    involved = keyed.join(F.broadcast(one) if few else one, ["first", "key"]).select("node", "text")

    def as_sets(texts: list[str]) -> dict:
        sets = [shingles(t) for t in texts]
        return {"items": pa.array([s[0].tobytes() for s in sets], pa.binary()), "weights": pa.array([None if (s[1] == 1).all() else s[1].astype(np.float32).tobytes() for s in sets], pa.binary())}

    made = map_texts(involved, ["node"], as_sets, "items binary, weights binary")
    return made.groupBy("node").agg(*(F.any_value(c).alias(c) for c in ("items", "weights")))


def read_set(items: bytes, weights: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    s = np.frombuffer(items, U)
    return s, np.ones(len(s)) if weights is None else np.frombuffer(weights, np.float32).astype(float)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a probability Jaccard similarity of at least threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"), F.col("weights").alias("weights_a"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"), F.col("weights").alias("weights_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in zip(*(batch.column(c) for c in ("a", "b", "items_a", "weights_a", "items_b", "weights_b")), strict=True):
                a, b, *parts = (x.as_py() for x in r)
                if similarity(read_set(*parts[:2]), read_set(*parts[2:])) >= threshold:
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "items_a", "weights_a", "items_b", "weights_b").mapInArrow(run, "a bigint, b bigint")


def overlaps(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For texts a and b, at (a, b), the weight in a of the shingles that both have; the diagonal means nothing.

    Shingles that few texts share are met pair by pair, the others as columns of matrix products.
    """
    n = len(sets)
    out = np.zeros((n, n))
    item = np.unique(np.concatenate([s[0] for s in sets]), return_inverse=True)[1]
    row, weight = np.repeat(np.arange(n), [len(s[0]) for s in sets]), np.concatenate([s[1] for s in sets])
    support = np.bincount(item)
    few = support[item] <= max(8, n // 64)
    dense, support = ~few, support[item]
    order = np.flatnonzero(few & (support > 1))
    order = order[np.argsort(item[order], kind="stable")]
    for k in range(1, len(order)):
        same = item[order[k:]] == item[order[:-k]]
        if not same.any():
            break
        x, y = order[:-k][same], order[k:][same]
        np.add.at(out, (row[x], row[y]), weight[x])
        np.add.at(out, (row[y], row[x]), weight[y])
    column = np.unique(item[dense], return_inverse=True)[1]
    row, weight = row[dense], weight[dense]
    for start in range(0, column.max(initial=-1) + 1, COLUMNS):
        at = (column >= start) & (column < start + COLUMNS)
        part = np.zeros((n, COLUMNS), np.float32)
        part[row[at], column[at] - start] = weight[at]
        out += part @ (part > 0).astype(np.float32).T
    return out


def linked(rows: list[dict], threshold: float) -> list[tuple[int, int]]:
    """Links between rows with node, root, items and weights: enough to connect all roots that pairs at the threshold or above connect.

    Two texts whose shingles all weigh 1 are judged by the number of common ones. Others are compared in full where the common
    shingles have that share of either's weight, which the similarity cannot exceed.
    """
    sets = [read_set(r["items"], r["weights"]) for r in rows]
    roots = np.unique([r["root"] for r in rows], return_inverse=True)[1]
    label = np.arange(len(rows))
    common, total = overlaps(sets), np.array([s[1].sum() for s in sets])
    plain = np.array([r["weights"] is None for r in rows])
    plain = plain[:, None] & plain
    share = common / total[:, None]
    sure = plain & (common / (total[:, None] + total - common) >= threshold)
    maybe = np.triu(~plain & (np.minimum(share, share.T) >= threshold - 1e-6), 1)
    found = []
    for a in np.flatnonzero(sure.any(1)):
        near = np.flatnonzero(sure[a])
        there = label[roots[near]]
        for other in np.unique(there[there != label[roots[a]]]):
            found.append((rows[a]["node"], rows[near[(there == other).argmax()]]["node"]))
            label[label == other] = label[roots[a]]
    for a in np.flatnonzero(maybe.any(1)):
        near = np.flatnonzero(maybe[a] & (label[roots] != label[roots[a]]))
        for b in near[np.argsort(-share[a, near], kind="stable")]:
            if label[roots[b]] != label[roots[a]] and similarity(sets[a], sets[b]) >= threshold:
                found.append((rows[a]["node"], rows[b]["node"]))
                label[label == label[roots[b]]] = label[roots[a]]
    return found


def links_within(placed: DataFrame, sets: DataFrame, threshold: float, *by: str) -> DataFrame:
    """Links (a, b) between the nodes of placed (with root) that have the same `by`, a group in a task."""

    def run(group: pa.Table) -> pa.Table:
        found = linked(group.to_pylist(), threshold)
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return placed.join(sets, "node").groupBy(*by).applyInArrow(run, "a bigint, b bigint")


def chunks(texts: Column, shingles: Column, share: float = 1.0) -> Column:
    """How many chunks hold that many texts and shingles if a chunk has that share of its limits."""
    return F.ceil(F.greatest(texts / F.lit(CHUNK_TEXTS * share), shingles / F.lit(CHUNK_SHINGLES * share))).cast("int")


def linkable(nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the nodes whose shingles that no other of them has weigh no more than the threshold leaves.

    The similarity of two texts is at most the share of either's weight that is common, so the rest has no link here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, items, weights in zip(*(batch.column(c).to_pylist() for c in ("node", "items", "weights")), strict=True):
                item, weight = read_set(items, weights)
                yield pa.RecordBatch.from_arrays([pa.array(item.view(np.int64)), pa.array(np.full(len(item), node)), pa.array(weight / weight.sum())], names=["item", "node", "share"])

    shares = sets.join(nodes, "node", "left_semi").select("node", "items", "weights").mapInArrow(run, "item bigint, node bigint, share double")
    alone = shares.groupBy("item").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("share").alias("share")).where("n = 1")
    novel = alone.groupBy("node").agg(F.sum("share").alias("share")).where(F.col("share") > 1 - threshold + 1e-6)
    return nodes.join(written(novel.select("node"), "novel"), "node", "left_anti")


def links_of_chunks(apart: DataFrame, per: DataFrame, roots: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between texts of a bucket of several chunks that are still in different classes (`roots`).

    The texts outside the bucket's largest class are compared with all its texts, a block of half a chunk of either in a task.
    Texts that can have no link are left out on both sides.
    """
    rows = apart.join(per.where("n_chunk > 1"), "band").drop("root")
    rows = written(rows.join(roots, "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("root")), "large-apart")
    sizes = rows.groupBy("band", "root").agg(F.count("*").alias("n"))
    main = written(sizes.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("n")).where("n > 1").select("band", "main"), "main-classes")
    kept = written(linkable(rows.join(main, "band", "left_semi").select("node").distinct(), sets, threshold), "linkable")
    rows = written(rows.join(main, "band").join(kept, "node", "left_semi").select("band", "node", "root", "size", (F.col("root") != F.col("main")).alias("query")), "large-linkable")
    asked = lambda x: F.sum(F.when(F.col("query"), x))
    counts = rows.groupBy("band").agg(chunks(asked(F.lit(1)), asked(F.col("size")), 0.5).alias("n_query"), chunks(F.count("*"), F.sum("size"), 0.5).alias("n_text"))
    at = rows.join(written(counts.where("n_query > 0"), "block-counts"), "band").withColumn("h", F.xxhash64("node", "band"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    query = at.where("query").select("band", F.pmod("h", "n_query").cast("int").alias("i"), every("n_text").alias("j"), "node", "root")
    text = at.select("band", every("n_query").alias("i"), F.pmod("h", "n_text").cast("int").alias("j"), "node", "root")
    return links_within(written(query.union(text), "large-blocks"), sets, threshold, "band", "i", "j")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links lead to. Each round links every node to the smallest of its neighbours
    and of itself, first upwards and then downwards, until nothing changes; a round's links are a table in the shared folder."""
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # Larger neighbours move to the smallest neighbour of a node.
        around = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Least numbers are a table of their own, so that a node with very many neighbours is dealt to several tasks.
        least = written(around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Smaller neighbours, and the node itself, move there too.
        large = written(large, "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = written(small, "links")
        # Done when the links are stars: no node that is pointed at points further, and each node points once.
        moved = new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count() or new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        links = new
        if not moved:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classed(docs: DataFrame, threshold: float = SIMILAR, text: str = "text") -> DataFrame:
    """(doc_id, key, root, wordy) of every row: root is the same number for the rows of one class; null for a text without words, unless its doc_id has others."""
    sketched = written(sketch_texts(docs, text), "sketches")
    wordy = sketched.where("size > 0")
    by_text = wordy.groupBy("key").agg(F.min("doc_id").alias("first"), F.any_value("sketch").alias("sketch"), F.any_value("size").alias("size"))
    nodes = written(by_text.select(F.monotonically_increasing_id().alias("node"), "key", "first", "sketch", "size"), "nodes")  # numbers are fixed once written
    bands = written(band_rows(nodes), "bands")
    hubs = written(bands.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub"), "hubs")
    shared = written(bands.join(hubs, "band").select("band", "node", "hub"), "buckets")
    sets = written(shingle_sets(nodes.join(shared.select("node").distinct(), "node", "left_semi"), docs, text), "sets")
    stars = shared.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = written(verified(written(near_pairs(stars, nodes), "pairs"), sets, threshold), "links")
    # Rows of one doc_id with different texts.
    members = written(wordy.join(nodes.select("key", "node"), "key").select("doc_id", "key", "node"), "members")
    split = written(members.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("m")).where("b < m").select("doc_id", "b"), "split-ids")
    links = links.union(members.join(split, "doc_id").select(F.col("node").alias("a"), "b"))
    first = components(links)
    # What the hubs left apart: buckets with texts in another class than their hub go to tasks whole, or in chunks if they are large.
    root = shared.join(first, "node", "left").select("band", "node", "hub", F.coalesce("root", "node").alias("root"))
    hub_root = first.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    rooted = written(root.join(hub_root, "hub", "left").select("band", "node", "root", F.coalesce("hub_root", "hub").alias("hub_root")), "rooted")
    open_bands = written(rooted.where("root <> hub_root").select("band").distinct(), "open-bands")
    apart = written(rooted.drop("hub_root").join(open_bands, "band", "left_semi").join(nodes.select("node", "size"), "node"), "apart")
    per = written(apart.groupBy("band").agg(chunks(F.count("*"), F.sum("size")).alias("n_chunk")), "chunk-counts")
    placed = apart.join(per, "band").select("band", F.pmod(F.xxhash64("node", "band"), "n_chunk").cast("int").alias("chunk"), "node", "root")
    as_links = lambda roots: roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    more = written(links_within(written(placed, "blocks"), sets, threshold, "band", "chunk"), "links")
    classes = components(as_links(first).union(more))
    if per.where("n_chunk > 1").limit(1).count():
        more = written(links_of_chunks(apart, per, classes, sets, threshold), "links")
        classes = components(as_links(classes).union(more))
    found = members.join(classes, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))
    # A text without words is in the class of its doc_id's other texts, if there are any.
    alone = sketched.where("size = 0").select("doc_id", "key")
    same_id = found.join(alone.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("root").alias("root"))
    wordless = alone.join(written(same_id, "ids"), "doc_id", "left").select("doc_id", "key", "root", F.lit(False).alias("wordy"))
    return written(found.withColumn("wordy", F.lit(True)).union(wordless), "classed")


def near_duplicates(docs: DataFrame, threshold: float = SIMILAR, text: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size) for every row of docs: class_id is the smallest doc_id of the row's class.

    Equal texts are one class by their key. Different texts are linked where they share a band and their exact
    probability Jaccard similarity reaches the threshold; classes are the connected parts. In a band's bucket every text is compared
    with one hub; where some are not in the hub's class afterwards, all texts of the bucket are compared with each other in one task,
    or chunk by chunk if there are many, and then those still apart with the other chunks, so a bucket hides no pair. A text without words, or null, is in a class of its own.
    Repeated rows are copies; rows that share a doc_id but not the text are linked through it. A row without a doc_id
    belongs to the class of its text as any other; a class of such rows only has a null class_id. class_size counts
    rows. An empty table gives an empty one; other columns are not read.
    """
    rows = classed(docs, threshold, text)
    wordy, alone = rows.where("root is not null"), rows.where("root is null")
    named = written(wordy.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "classes")
    own = written(alone.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("class_size")), "alone")
    one = lambda size: ("doc_id", F.col("doc_id").alias("class_id"), size.cast("bigint").alias("class_size"))
    known = wordy.join(named, "root").select("doc_id", "class_id", "class_size")
    return known.union(alone.join(own, "doc_id", "left").select(*one(F.coalesce("class_size", F.lit(1)))))


def first_of_each(docs: DataFrame, threshold: float = SIMILAR, text: str = "text") -> DataFrame:
    """One row of each class, with all columns: that of the smallest doc_id (none sorts last), then of the smallest text key.

    Of rows that share both, the one that is first as JSON stays. Rows without words and without a doc_id all stay.
    """
    rows = classed(docs, threshold, text)
    lone = rows.where("root is null and doc_id is null").select("key").distinct()
    class_of = [F.col("root"), F.when(F.col("root").isNull(), F.col("doc_id")).alias("own")]
    least = rows.where("root is not null or doc_id is not null").select(*class_of, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", (~F.col("wordy")).alias("wordless"), "key").alias("at")).groupBy("root", "own", "at").agg(F.count("*").alias("n"))
    kept = written(least.groupBy("root", "own").agg(F.min(F.struct("at", "n")).alias("first")).select(F.col("first.at.doc_id").alias("kept_id"), F.col("first.at.key").alias("kept_key"), "first.n"), "kept")
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), text_key(F.col(f"`{text}`")).alias("key"))
    at = (F.col("key") == F.col("kept_key")) & F.col("id").eqNullSafe(F.col("kept_id"))
    single = given.join(kept.where("n = 1"), at, "left_semi").select("row.*")
    again = given.join(kept.where("n > 1"), at, "left_semi").groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return single.union(again).union(given.where("id is null").join(lone, "key", "left_semi").select("row.*"))
