"""MinHash near-deduplication by fast similarity sketching.

A sketch has T coordinates. In round i every shingle is hashed to a bin and a
value of [i, i + 1); a bin keeps its smallest value. After T such rounds, round
T + b places all shingles in bin b, so every coordinate is filled, and the rounds
end as soon as all are. Two sketches agree in a coordinate with the probability
of the sets' Jaccard similarity, with concentration as for T independent hashes.

Rows with the same shingle set form a class; only one representative of a class
goes on. Sketches are cut into bands; buckets of a band propose links. In a hub
round a bucket falls into small random groups and members are tested against
their groups' hubs; links are confirmed on the full sets, and representatives
that are already connected are not paired again. After the hub rounds, pairs of
one bucket that are still in different components are settled without emitting
them all, and without losing one: buckets that share members make a family, and
a member is told by its difference from the shingles that most of its family
have. Sets x and y are similar if their differences differ in (|x| + |y|) / 7
shingles at most: with d = |x ^ y| and s = |x| + |y|, similarity is (s - d) / (s + d). Members whose differences are small enough together are linked
whatever these are, so one of the smallest stands for them. Other links need
|Dx & Dy| >= need = ceil((|Dx| + |Dy| - s // 7) / 2), so that an element common to
both differences is among the first |D| - need + 1 of each in any common order (the
prefix filter of exact similarity joins); the rarest come first. The largest
component of a family, whose members are connected already, meets only the others.
With 32 bands of 4, a pair at 0.75 shares no band with probability 5e-6; pairs
that are more alike, or are linked through others, less.

Defined cases: null or wordless text has an empty set and is linked with
nothing; fewer than five words make one shingle; component_id is the smallest
non-null doc_id of the component (null only if there is none); repeated rows are
separate rows of one class; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridprint.llm.common import by_size, materialise, rows_as_one, ship, sparing, with_row_id
from gridprint.llm.hashing import U, mix, shingles

#: Coordinates of a sketch; bands, and rows of a band, that it is cut into.
T, BANDS, ROWS = 128, 32, 4
#: Rounds, members that share a hub in a round, and hubs that a member is tested against in one.
HUB_ROUNDS, SHARING, PARTNERS = 1, 5, 4
SIMILAR = 75
#: Bytes of an Arrow batch: with two texts a row, larger ones stand several times in the memory of each task.
ARROW_BYTES = 4 << 20
_SALTS = mix(np.arange(1, 2 * T + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93))
_EMPTY = U(0xFFFFFFFFFFFFFFFF)


def sketch(h: np.ndarray, t: int = T) -> np.ndarray:
    """Fast similarity sketch of a non-empty array of distinct hashes: (round, value) packed, per bin."""
    out = np.full(t, _EMPTY, U)
    step, at = max(1, -(-8 * t // len(h))), 0  # as many rounds at once as mostly fill all bins
    while at < 2 * t:
        until = min(at + step, t if at < t else 2 * t)
        rounds = np.arange(at, until)
        x = mix(h[None, :] ^ _SALTS[rounds][:, None])
        value = (rounds.astype(U) << U(48))[:, None] | (x >> U(16))
        bins = (x & U(t - 1)).astype(np.int64) if at < t else np.broadcast_to((rounds - t)[:, None], x.shape)
        np.minimum.at(out, bins.ravel(), value.ravel())
        if (out != _EMPTY).all():
            break
        at = until
    return out


def bands(s: np.ndarray, rows: int = ROWS, n: int = BANDS) -> np.ndarray:
    """A key per band; the band's number is part of it."""
    s = s[: n * rows].reshape(-1, rows)
    key = np.arange(len(s), dtype=U)
    for k in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + s[:, k])
    return key.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)))


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, text, n_shingles, k1, k2, bands); k1 and k2 are a 128-bit key of the set."""
    none = np.zeros(0, np.int64)
    for batch in batches:
        for part in by_size(batch, 1, 4 << 20):
            n, keys, out = [], [], []
            for text in part.column(1):
                h = shingles(text.as_py())
                n.append(len(h))
                keys.append((int(mix(h + U(1)).sum(dtype=U).view(np.int64)), int(mix(h + U(0x5851F42D4C957F2D)).sum(dtype=U).view(np.int64))))
                out.append(bands(sketch(h)) if len(h) else none)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()), _lists(out)], ["doc_id", "text", "n_shingles", "k1", "k2", "bands"])


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, text_a, b, text_b) -> the pairs (a, b) that are similar on their full sets. Rows of one a come together, so its set is kept."""
    last, held = object(), np.zeros(0, U)
    for batch in batches:
        keep = []
        a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        text_a, text_b = batch.column(1), batch.column(3)
        for i in range(batch.num_rows):
            if a[i] != last:
                last, held = a[i], shingles(text_a[i].as_py())
            other = shingles(text_b[i].as_py())
            common = len(np.intersect1d(held, other, assume_unique=True))
            if 100 * common >= SIMILAR * (len(held) + len(other) - common):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])


def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(family, rid, text) -> (family, rid, n, h): the sorted set of each member."""
    for batch in batches:
        for part in by_size(batch, 2, 4 << 20):
            sets = [shingles(t.as_py()) for t in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(h) for h in sets], pa.int64()), _lists(sets)], ["family", "rid", "n", "h"])


def differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(family, rid, n, h, base) -> (family, rid, n, more, less): what a member has beyond the family's base and what it lacks of it."""
    for batch in batches:
        more, less = [], []
        for i in range(batch.num_rows):
            h = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
            base = batch.column(4)[i]
            base = base.values.to_numpy(zero_copy_only=False) if base.is_valid else h[:0]
            more.append(np.setdiff1d(h, base, assume_unique=True))
            less.append(np.setdiff1d(base, h, assume_unique=True))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), _lists(more), _lists(less)], ["family", "rid", "n", "more", "less"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose texts are similar. The text of b travels; a, the hub, may be in any number of pairs."""
    with_b = pairs.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "text_a", "b", "text_b").mapInArrow(sparing(confirmed), "a long, b long")


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) of every node of edges (u, v), root the smallest node of its component, by alternating large and small stars."""
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    before = None
    for _ in range(limit):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u > v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(linked.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = e.agg(F.count(F.lit(1)), F.sum("u"), F.sum("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def differences(live: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the members of live buckets (key, rid): (family, rid, n, d) with the sizes of set and difference, and the prefixes (family, rid, n, d, s, at) of the differences."""
    first = live.groupBy("key").agg(F.min("rid").alias("v"))
    families = components(live.join(first, "key").select(F.col("rid").alias("u"), "v"))
    members = live.select("rid").distinct().join(families, F.col("rid") == F.col("node"), "left").select(F.coalesce("root", "rid").alias("family"), "rid")
    members = materialise(members.join(texts, "rid").select("family", "rid", "text").mapInArrow(sparing(shingled), "family long, rid long, n long, h array<long>"), "members")
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    counts = materialise(members.select("family", F.explode("h").alias("s")).groupBy("family", "s").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "elements")
    # shingles that most members have: at most twice as many as a member has on average
    common = materialise(counts.join(sizes, "family").where("2 * f > size").select("family", "s", (F.col("size") - F.col("f")).alias("f")), "common")
    base = common.groupBy("family").agg(F.sort_array(F.collect_list("s")).alias("base"))
    apart = members.join(base, "family", "left").select("family", "rid", "n", "h", "base").mapInArrow(sparing(differing), "family long, rid long, n long, more array<long>, less array<long>")
    apart = materialise(apart, "differences")
    told = apart.select("family", "rid", "n", (F.size("more") + F.size("less")).cast("long").alias("d"))
    # elements that another member's difference has too, with their frequency among differences; those of one member come before them
    rare = counts.join(common.select("family", "s"), ["family", "s"], "left_anti").unionByName(common.where("f > 1"))
    shared = apart.select("family", "rid", F.explode(F.concat("more", "less")).alias("s")).join(rare, ["family", "s"]).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("shared"))
    at = told.join(shared, "rid").select("*", F.posexplode("shared").alias("i", "e")).select("family", "rid", "n", "d", F.col("e.s").alias("s"), (F.col("d") - F.size("shared") + F.col("i")).alias("at"))
    return told, materialise(at.where(3 * F.col("at") <= F.col("n")), "prefixes")  # partners have at most a third more shingles


def linked_by_size(told: DataFrame) -> DataFrame:
    """Edges (a, b): a member and the one of its family whose difference is smallest for its size, if their sizes alone make them similar; any two that their sizes make similar are connected by these."""
    own = 7 * F.col("d") - F.col("n")
    least = told.groupBy("family").agg(F.min(F.struct(own.alias("w"), "rid")).alias("m"))
    return told.join(least, "family").where((own + F.col("m.w") <= 0) & (F.col("rid") != F.col("m.rid"))).select(F.least("rid", "m.rid").alias("a"), F.greatest("rid", "m.rid").alias("b"))


def sharing_elements(told: DataFrame, at: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) in different components that sizes alone don't make similar, and whose prefixes share an element."""
    names = roots.select(F.col("node").alias("rid"), "root")
    own = told.join(names, "rid", "left").select("family", "rid", F.coalesce("root", "rid").alias("root"))
    main = own.groupBy("family", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("family").agg(F.max(F.struct("k", "root")).alias("m")).select("family", F.col("m.root").alias("main"))
    own = materialise(own.join(main, "family").select("rid", "root", (F.col("root") != F.col("main")).alias("far")), "apart")
    at = at.join(own, "rid")
    one = at.where("far").select("family", "s", *[F.col(c).alias(f"{c}_x") for c in ("rid", "root", "n", "d", "at")])
    two = at.select("family", "s", *[F.col(c).alias(f"{c}_y") for c in ("rid", "root", "n", "d", "at", "far")])
    need = F.ceil((F.col("d_x") + F.col("d_y") - F.floor((F.col("n_x") + F.col("n_y")) / 7)) / 2)
    fits = (F.col("root_x") != F.col("root_y")) & (need >= 1) & (F.col("at_x") <= F.col("d_x") - need) & (F.col("at_y") <= F.col("d_y") - need) & (~F.col("far_y") | (F.col("rid_x") < F.col("rid_y")))
    return one.join(two, (one["family"] == two["family"]) & (one["s"] == two["s"]) & fits).select(F.least("rid_x", "rid_y").alias("a"), F.greatest("rid_x", "rid_y").alias("b")).distinct()


def linked(docs: DataFrame, hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id (the smallest doc_id of the rows with the same set)."""
    spark = docs.sparkSession
    ship(spark, ARROW_BYTES)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialise(with_row_id(docs.select("doc_id", "text").mapInArrow(sparing(sketched), f"doc_id {kind}, text string, n_shingles long, k1 long, k2 long, bands array<long>")), "sketches")
    key = ["k1", "k2", "n_shingles"]
    classes = rows.where("n_shingles > 0").groupBy(*key).agg(F.min("rid").alias("rep"), F.min("doc_id").alias("class_id"))
    classes = materialise(classes, "classes")
    # representatives' bands, of buckets that have more than one
    keyed = rows.select("rid", "bands").join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi").select("rid", F.explode("bands").alias("key"))
    keyed = materialise(keyed, "bands")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    buckets = materialise(keyed.join(shared, "key"), "buckets")
    texts = materialise(rows.select("rid", "text").join(buckets.select("rid").distinct(), "rid"), "texts")
    roots = None

    def rooted() -> DataFrame:
        if roots is None:
            return buckets.withColumn("root", F.col("rid"))
        return buckets.join(roots, F.col("rid") == F.col("node"), "left").select("key", "rid", F.coalesce("root", "rid").alias("root"))

    def merge(edges: DataFrame) -> None:
        nonlocal roots
        if roots is not None:
            names = roots.select("node", "root")
            edges = edges.join(names, F.col("a") == F.col("node"), "left").select(F.coalesce("root", "a").alias("a"), "b").join(names, F.col("b") == F.col("node"), "left").select("a", F.coalesce("root", "b").alias("b"))
        star = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        if roots is not None:  # older members follow their root
            older = roots.join(star.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
            star = older.unionByName(star.join(roots.select("node"), "node", "left_anti"))
        roots = materialise(star, "roots")

    def live() -> DataFrame:
        have = rooted()
        mixed = have.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        return have.join(mixed.select("key", "n"), "key")

    def test(pairs: DataFrame) -> None:
        pairs = materialise(pairs, "pairs")
        if not pairs.isEmpty():  # groups of one root each offer nothing, though their bucket may have other ones
            edges = materialise(confirm(pairs, texts), "links")
            if not edges.isEmpty():
                merge(edges)

    for turn in range(hub_rounds):
        # a bucket falls into small random groups, other ones in each bucket and round; a group's members meet its hub
        dealt = live().withColumn("part", F.pmod(F.xxhash64("rid", "key", F.lit(turn)), F.ceil(F.col("n") / SHARING)))
        hubs = dealt.groupBy("key", "part").agg(F.min(F.struct(F.xxhash64("rid", F.lit(turn)), "rid", "root")).alias("hub"))
        offers = dealt.join(hubs.select("key", "part", F.col("hub.rid").alias("a"), F.col("hub.root").alias("hub_root")), ["key", "part"]).where(F.col("root") != F.col("hub_root"))
        some = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), "a"))), 1, PARTNERS)  # of one hub a band
        offered = offers.groupBy(F.col("rid").alias("b")).agg(some.alias("some")).select("b", F.explode("some.a").alias("a"))
        test(offered.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left = materialise(live().select("key", "rid"), "live")
    if not left.isEmpty():
        told, at = differences(left, texts)
        edges = materialise(linked_by_size(told), "links")
        if not edges.isEmpty():
            merge(edges)
        if roots is None:
            roots = told.select(F.col("rid").alias("node"), F.col("rid").alias("root"))
        test(sharing_elements(told, at, roots))
    if roots is None:
        reach = classes.select(*key, "class_id", F.col("class_id").alias("component_id"))
    else:
        named = classes.join(roots, F.col("rep") == F.col("node"), "left").select(*key, "class_id", F.coalesce("root", "rep").alias("root"))
        ids = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
        reach = named.join(ids, "root").select(*key, "class_id", "component_id")
    out = rows.select("doc_id", *key).join(reach, key, "left")
    alone = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose doc_id names its component."""
    kept = linked(docs).where("kept").select(F.col("doc_id").alias("id")).distinct()
    return rows_as_one(docs).join(kept, F.col("row.doc_id").eqNullSafe(F.col("id")), "left_semi").select("row.*")
