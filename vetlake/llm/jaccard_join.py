"""N-gram Jaccard join by PartEnum signatures.

A text's set is its distinct k-word shingles. Sets of similar size fall in one band; a band's sets and those of the band
below that can reach into it share one instance. Two sets of sizes r and s at Jaccard >= t differ in at most
(r + s)(1 - t) / (1 + t) features, so of an instance's partitions of the feature domain most must agree:

* small bands (at most SMALL differences d): d + 2 partitions, and every subset that leaves out d of them signs;
* others: d + 1 partitions and a quarter more; a set signs with its d_r + 1 first partitions in one global order, in which
  partitions with more features that are not frequent come first. As many partitions must agree as there are beyond d, so
  two such prefixes share a signature. Frequent features (in over FREQUENT of all texts) and empty partitions thus rarely
  sign; the order affects cost only, never the result.

Candidates: each signature's sets are compared with its least set; then sets that share a signature but are not yet
connected, unless the metric 1 - Jaccard already rules them out by their distances to that least set. Signatures of more
than CROWD sets are left out for a set that has no more of them than signatures to spare, since a similar set then shares
another one. Sets with more form families, which crowded signatures connect (mostly many edited copies of one text); these
are compared in pairs of blocks by matrix products, and only links that connect leave a block. The comparison is exact over
the sets' 64-bit shingle hashes. Identical sets are one node, so copies cost no comparison.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, chunks, column, lean, text_buffers
from .components import components
from .words import MULTIPLIERS, U, WHITE_WORDS, mix, shingle_sets

#: Most differences of a band whose signatures are subsets of partitions.
SMALL = 4
#: Share of all texts from which on a shingle counts as frequent; bounds the list of frequent shingles by mean set size / FREQUENT.
FREQUENT = 0.002
BLOCK = 1 << 21
#: A set has one signature to spare for each SPARE features; a signature of over CROWD sets is crowded.
SPARE, CROWD = 40, 16
#: Nodes that a task remembers to have signed.
REMEMBERED = 1 << 18
#: Features and sets of a block of a family.
BLOCK_FEATURES, BLOCK_SETS = 1 << 18, 512
SIGNED = T.StructType([T.StructField(name, T.LongType(), False) for name in ("sig", "node")])


@lru_cache(16)
def bands(num: int, den: int, top: int = 1 << 34) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest set size of each band."""
    low, high, at = [], [], 1
    while at < top:
        low.append(at)
        high.append(max(at, at * den // num))
        at = high[-1] + 1
    return np.array(low), np.array(high)


def _differences(total: int, num: int, den: int) -> int:
    """Most differing features of two sets at num / den or more whose sizes sum to total."""
    return total * (den - num) // (den + num)


def spare(r):
    """Signatures a set of r features has beyond those it needs: similar sets then share one more than this."""
    return r // SPARE


def node_of(features: np.ndarray) -> int:
    """64-bit hash of a set: equal sets are one node."""
    return int(mix(mix(features ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True) + U(len(features))).view(np.int64)[0])


def signatures(features: np.ndarray, frequent: np.ndarray, num: int, den: int, only_plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one sorted set, over its own band's instance and the next band's where a partner may lie there, and
    whether each is plain: made of frequent features only (or of none). With only_plain instances without such are skipped."""
    r = len(features)
    if not r:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    low, high = bands(num, den)
    band = int(np.searchsorted(low, r, "right")) - 1
    reach = r * den // num
    found = frequent[np.minimum(np.searchsorted(frequent, features), len(frequent) - 1)] == features if len(frequent) else np.zeros(r, bool)
    out, plain = [], []
    for tag, largest in ((band, min(int(high[band]), reach)), (band + 1, reach)):
        if tag > band and reach < low[tag]:
            break
        most = _differences(2 * int(high[tag]), num, den)
        seed, turn = (U(tag * x & (1 << 64) - 1) for x in (0x9E3779B97F4A7C15, 0x9E3779B97F4A7C15 * 31))
        mixed = mix(features + seed)
        if most <= SMALL:
            part = (mixed >> U(32)).astype(np.int64) % (most + 2)
            sums = np.array([mixed[part == p].sum(dtype=np.uint64) for p in range(most + 2)])
            i, j = np.array([*combinations(range(most + 2), 2)]).T
            out.append(mix(sums[i] * MULTIPLIERS[0] + sums[j] * MULTIPLIERS[1] + turn + (64 * i + j + 1).astype(np.uint64)))
            rare = np.bincount(part[~found], minlength=most + 2)
            plain.append(rare[i] + rare[j] == 0)
            continue
        parts = most + 1 + (most + 4) // 4
        # by the hash's upper half, so that sorting by hash also sorts by partition
        part = ((mixed >> U(32)) * U(parts) >> U(32)).astype(np.int64)
        own = min(_differences(r + largest, num, den) + spare(r) + 1, parts)
        rare = np.bincount(part[~found], minlength=parts)
        if only_plain and np.count_nonzero(rare) >= own:
            continue
        order = np.argsort(part, kind="stable")
        counts = np.bincount(part, minlength=parts)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed[order], dtype=np.uint64)))
        upto = np.concatenate(([0], np.cumsum(counts)))
        values = mix(total[upto[1:]] - total[upto[:-1]] + turn + np.arange(1, parts + 1).astype(np.uint64) * MULTIPLIERS[2])
        # the order: more rare features first, more features first, then the signature itself
        first = np.lexsort((values, -counts, -rare))[:own]
        out.append(values[first])
        plain.append(rare[first] == 0)
    return (np.concatenate(out), np.concatenate(plain)) if out else (np.zeros(0, np.uint64), np.zeros(0, bool))


def _sets(texts: pa.Array, k: int):
    data, offsets = text_buffers(texts)
    for lo, hi in chunks(offsets):
        offs = offsets[lo : hi + 1] - offsets[lo]
        _, _, hashes, first = WHITE_WORDS(data[offsets[lo] : offsets[hi]], offs)
        yield lo, shingle_sets(hashes, first, k)


def describe(k: int):
    """Arrow batches of (doc_id, text) -> rows (doc_id, n, node), and rows (feature, n) of shingles that repeat within a block."""

    def run(batches):
        held, size, docs = [], 0, 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= max(4, FREQUENT * docs / 2)
            m = int(keep.sum())
            return pa.record_batch([pa.nulls(m, pa.int64()), pa.array(counts[keep], pa.int64()), pa.nulls(m, pa.int64()), pa.array(values[keep].view(np.int64))], ["doc_id", "n", "node", "feature"])

        for batch in batches:
            n, nodes = [], []
            for _, sets in _sets(column(batch, "text"), k):
                for s in sets:
                    n.append(len(s))
                    nodes.append(node_of(s) if len(s) else None)
                    if len(s):
                        held.append(s)
                        size += len(s)
                    docs += 1
                if size >= BLOCK:
                    yield flush()
                    held, size, docs = [], 0, 0
            yield pa.record_batch([column(batch, "doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(len(n), pa.int64())], ["doc_id", "n", "node", "feature"])
        if held:
            yield flush()

    return run


def sign(k: int, num: int, den: int, frequent, plain: bool):
    """Arrow batches of (text) -> rows (sig, node): the signatures of frequent features only, or the others.

    A task signs each node once as long as it remembers it.
    """

    def run(batches):
        common, done = np.frombuffer(frequent.value, np.uint64), set()
        for batch in batches:
            for _, sets in _sets(column(batch, "text"), k):
                new = {node_of(s): s for s in sets if len(s)}
                new = {node: s for node, s in new.items() if node not in done}
                if len(done) > REMEMBERED:
                    done.clear()
                done.update(new)
                if new:
                    made = [signatures(s, common, num, den, plain) for s in new.values()]
                    sigs = [values[own == plain] for values, own in made]
                    nodes = np.repeat(np.array([*new]), [len(x) for x in sigs])
                    yield pa.record_batch([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(nodes)], ["sig", "node"])

    return run


def sets_of(k: int):
    """Arrow batches of (node, text) -> rows (node, features as sorted little-endian 64-bit integers).

    Where several rows carry a representative's id, those whose set is not the node's are left out; a null node becomes the
    set's own.
    """

    def run(batches):
        for batch in batches:
            nodes = column(batch, "node").to_pylist()
            for lo, sets in _sets(column(batch, "text"), k):
                found = [(node, node_of(s), s) for node, s in zip(nodes[lo : lo + len(sets)], sets, strict=True) if len(s)]
                own = [(n, s.tobytes()) for node, n, s in found if node is None or n == node]
                yield pa.record_batch([pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.binary())], ["node", "features"])

    return run


def compare(batches):
    """Arrow batches of (a, b, fa, fb) -> rows (a, b, n_a, n_b, n_both)."""
    for batch in batches:
        fa, fb, sizes = column(batch, "fa"), column(batch, "fb"), []
        last, x = None, None
        for p, q in zip(fa, fb, strict=True):
            left = p.as_buffer()
            if last is None or not last.equals(left):
                last, x = left, np.frombuffer(left, np.uint64)
            y = np.frombuffer(q.as_buffer(), np.uint64)
            s, t = (x, y) if len(x) < len(y) else (y, x)
            at = np.searchsorted(t, s)
            sizes.append((len(x), len(y), int((t[np.minimum(at, len(t) - 1)] == s).sum())))
        cols = np.array(sizes, np.int64).reshape(-1, 3)
        yield pa.record_batch([column(batch, "a"), column(batch, "b"), *(pa.array(cols[:, i].copy()) for i in range(3))], ["a", "b", "n_a", "n_b", "n_both"])


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """pairs (a, b) with their sizes, overlap, and whether they link."""
    b = pairs.join(sets.select(F.col("node").alias("b"), F.col("features").alias("fb")), "b")
    both = b.join(sets.select(F.col("node").alias("a"), F.col("features").alias("fa")), "a").select("a", "b", "fa", "fb")
    seen = both.mapInArrow(lean(compare), "a long, b long, n_a long, n_b long, n_both long")
    union = F.col("n_a") + F.col("n_b") - F.col("n_both")
    return seen.select("a", "b", (1 - F.col("n_both") / union).alias("distance"), (den * F.col("n_both") >= num * union).alias("linked"))


def forest(batches):
    """Rows (family, i, j, block, node, features), all of a (family, i, j) together -> links (a, b) that connect what is linked.

    Of the sets of blocks i and j all pairs are compared at once, as products of their matrix of shared features.
    """

    def flush(key, rows, num, den):
        own = [(r[1], np.frombuffer(r[2], np.uint64)) for r in rows]
        n = len(own)
        if n < 2:
            return []
        sizes = np.array([len(f) for _, f in own])
        which = np.repeat(np.arange(n), sizes)
        values, place, times = np.unique(np.concatenate([f for _, f in own]), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times > 1)
        rank = np.full(len(values), -1)
        rank[shared] = np.arange(len(shared))
        rank = rank[place]
        which, rank = which[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        which, rank = which[order], rank[order]
        both = np.zeros((n, n), np.float32)
        for lo in range(0, len(shared), 4096):
            x, y = np.searchsorted(rank, (lo, lo + 4096))
            matrix = np.zeros((n, 4096), np.float32)
            matrix[which[x:y], rank[x:y] - lo] = 1
            both += matrix @ matrix.T
        linked = den * both.astype(np.float64) >= num * (sizes[:, None] + sizes[None, :] - both)
        out, seen = [], np.zeros(n, bool)
        for root in range(n):
            if seen[root]:
                continue
            seen[root] = True
            todo = [root]
            while todo:
                i = todo.pop()
                new = np.flatnonzero(linked[i] & ~seen)
                seen[new] = True
                out += [(own[i][0], own[j][0]) for j in new.tolist()]
                todo += new.tolist()
        return out

    key, rows, links = None, [], []
    for batch in batches:
        cols = {name: column(batch, name).to_pylist() for name in ("family", "i", "j", "block", "node", "features", "num", "den")}
        for f, i, j, block, node, features, num, den in zip(*cols.values(), strict=True):
            if (f, i, j) != key:
                if rows:
                    links += flush(key, rows, *share)
                key, rows, share = (f, i, j), [], (num, den)
            rows.append((block, node, features))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])
            links = []
    if rows:
        links = flush(key, rows, *share)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])


def _family_links(families: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links within families, (node, n, family), compared block by block: a block has about BLOCK_FEATURES features or BLOCK_SETS sets."""
    blocks = families.groupBy("family").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_FEATURES, F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("blocks"))
    parts = families.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    parts = parts.select("family", "node", "block", others).select("family", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    full = parts.join(sets, "node").withColumns({"num": F.lit(num), "den": F.lit(den)})
    return full.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(lean(forest), "a long, b long")


def ngram_jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Columns doc_id, text -> doc_id, n_shingles, component_id: classes of texts that links of Jaccard >= num / den reach.

    Texts without words, empty or null have no shingles, link with nothing and are a class of their own; a null doc_id
    stays null and counts in no class's least id (a class of nothing else has a null one). Rows with the same doc_id are
    texts of their own. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(spark, "jaccard")
    seen = scratch.write(docs.mapInArrow(lean(describe(k)), "doc_id long, n long, node long, feature long"), "seen")
    rows = seen.where("feature is null").select("doc_id", "n", "node")
    often = max(50, FREQUENT * rows.count() / 2)
    common = seen.where("feature is not null").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= often).select("feature")
    frequent = np.sort(common.toPandas()["feature"].to_numpy(np.int64).view(np.uint64))  # bounded: see FREQUENT
    shared = spark.sparkContext.broadcast(frequent.tobytes())

    def met_in(signed: DataFrame) -> DataFrame:
        groups = signed.groupBy("sig").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.count(F.lit(1)).alias("c")).where("pivot <> last")
        groups = groups.select("sig", "pivot", (F.col("c") > CROWD).alias("crowded"))
        return signed.join(groups.hint("shuffle_hash"), "sig").where("crowded or node <> pivot").select("sig", "pivot", "node", "crowded")

    def signed(plain: bool) -> DataFrame:
        return docs.select("text").where("text is not null").mapInArrow(lean(sign(k, num, den, shared, plain)), SIGNED)

    # signatures with rare features: most of all, none with very many sets; one exchange serves both uses, as the columns
    # are not nullable and the plans thus equal
    scratch.save(met_in(signed(False).repartition("sig")), "met/part=0")
    # signatures of frequent features only: few, but one may have a share of all sets; sums are partial before the shuffle,
    # and large partitions of the join can be split
    scratch.save(met_in(scratch.write(signed(True), "plain")), "met/part=1")
    met = scratch.read("met").drop("part")
    scratch.free_shuffles()

    # crowded signatures: only for sets with more of them than signatures to spare
    sizes = rows.where("node is not null").groupBy("node").agg(F.first("n").alias("n"))
    crowds = met.where("crowded").distinct()
    strong = crowds.groupBy("node").agg(F.count(F.lit(1)).alias("h")).join(sizes, "node").where(F.col("h") > F.floor(F.col("n") / SPARE)).select("node", "n")
    crowds = scratch.write(crowds.join(strong, "node").select("sig", "node", "n"), "crowds")
    lead = crowds.groupBy("sig").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    led = scratch.write(crowds.join(lead, "sig").select("a", F.col("node").alias("b")).distinct(), "led")
    # a set is linked with the least set that leads one of its signatures, and that one with the others that do: few links
    least = led.groupBy("b").agg(F.min("a").alias("m"))
    families = components(least.select(F.col("m").alias("a"), "b").unionAll(led.join(least, "b").select("m", "a").distinct()), scratch, "family")
    families = families.join(crowds.select("node", "n").distinct(), "node").withColumnRenamed("label", "family")
    families = scratch.write(families, "families")

    cold = met.where("not crowded")
    stars = scratch.write(cold.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    nodes = stars.select(F.col("a").alias("node")).unionAll(stars.select(F.col("b").alias("node"))).unionAll(families.select("node")).distinct()
    # one text stands for each node: that of its least id; ids may repeat, so the text's own node decides
    reps = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(nodes, "node", "left_semi")
    texts = docs.join(reps.where("doc_id is not null"), "doc_id").select("node", "text")
    made = texts.mapInArrow(lean(sets_of(k)), "node long, features binary")
    # texts without an id find their node by themselves
    nameless = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("node"), "text").mapInArrow(lean(sets_of(k)), "node long, features binary")
    made = made.unionAll(nameless.join(reps.where("doc_id is null").select("node"), "node", "left_semi"))
    sets = scratch.write(made.dropDuplicates(["node"]), "sets")
    scratch.free_shuffles()

    checked = scratch.write(_verified(stars, sets, num, den), "checked")
    links = checked.where("linked").select("a", "b").unionAll(_family_links(families, sets, num, den))
    links = scratch.write(links, "links")
    scratch.free_shuffles()
    labels = components(links, scratch, "first")

    # sets that share a signature, are not connected, and whose distances to its pivot leave a link possible
    near = checked.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "distance")
    members = cold.join(near, ["pivot", "node"]).join(labels, "node", "left").select("sig", "node", "distance", F.coalesce("label", "node").alias("label"))
    mixed = members.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("sig")
    members = scratch.write(members.join(mixed, "sig", "left_semi"), "members")
    left, right = (members.select("sig", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "distance", "label"))) for s in "ab")
    more = left.join(right, "sig").where((F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & (F.abs(F.col("distance_a") - F.col("distance_b")) <= (den - num) / den + 1e-9))
    more = scratch.write(more.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "more")
    if more.limit(1).count():
        found = scratch.write(_verified(more, sets, num, den).where("linked").select("a", "b"), "found")
        labels = components(links.unionAll(found), scratch, "second")

    scratch.drop("met", "plain", "sets", "members", "crowds", "families")
    label = rows.where("node is not null").join(labels, "node", "left").select("doc_id", "n", F.coalesce("label", "node").alias("label"))
    # written, so that the join below stands alone and a label with very many rows can be split
    ids = scratch.write(label.groupBy("label").agg(F.min("doc_id").alias("component_id")), "ids")
    full = label.join(ids, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("node is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionAll(empty)


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay: of each class of near-duplicates the one with the least doc_id, and every text without words.

    Of rows that repeat that id one stays; a class that has only null ids keeps all its rows.
    """
    spark = docs.sparkSession
    classes = ngram_jaccard_join(docs, **options)
    scratch = Scratch(spark, "keep")
    lost = scratch.write(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("__lost")).distinct(), "lost")
    scratch.free_shuffles()
    kept = docs.join(lost, docs["doc_id"] == lost["__lost"], "left_anti")
    named = kept.where("doc_id is not null").dropDuplicates(["doc_id"])
    return named.unionAll(kept.where("doc_id is null"))
