"""Near-duplicate components by an inverted join of MinHash coordinates, confirmed on full shingle sets.

Documents with equal shingle sets form one node. A node has COORDINATES minimum hashes; it is posted
under the (coordinate, value) pairs of its prefix: all but the T - OVERLAP commonest of them, where T is
the fewest matches that a linked pair is let have. Two nodes with T matches share at least OVERLAP
postings, in whatever order a prefix is taken, as long as all take the same. Values that a sample of
nodes finds common come last in that order, so long lists are skipped.

A list isn't expanded into all its pairs.

1. Its nodes are matched with few pivots, the same ones in all lists that have them; pairs with T matches
   make clusters.
2. In a list that still holds several clusters, pairs across them are posted and their collisions
   counted, if they are at most LIST_PAIRS; OVERLAP of them, and then T matches, merge two clusters. A
   longer list puts its nodes into one cluster unseen, if they are in OVERLAP lists as long: whatever has
   T matches is then within one cluster, and no list costs more than LIST_PAIRS rows or one row a node.
3. In a cluster each node is first checked against its best match. What is still apart is compared on
   full sets: small clusters in blocks, large ones through the rarest shingles of each set, by which any
   two linked sets meet; where many sets share a rare shingle, those sets are compared in blocks.

Components are exact but for links that have fewer than T matches (for 64 coordinates and links at the
limit, under one in a million). With exact=True step 3 gets all nodes as one cluster, and none is missed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangelake.llm.common import cut, key_filter, may_have, ready
from rangelake.llm.graph import components, relabel

COORDINATES, OVERLAP, DEVIATIONS = 64, 4, 6
#: Different pivots that a list tries.
SEEDS = 2
#: One node in so many tells which values are common; at most MOST_COMMON of them are known to all tasks.
SAMPLE, MOST_COMMON = 8, 100_000
MIX1, MIX2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_draw = np.random.default_rng(20240229)
FACTORS, SALTS = _draw.integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1), _draw.integers(0, 1 << 63, COORDINATES, np.uint64)
WORDS_KEPT = 200_000
#: Pairs that one list is expanded into at most.
LIST_PAIRS = 2000
#: Hashes and sets on each side of a block of comparisons; columns of its matrices, or pairs that meet, at a time.
BLOCK, ROWS, COLUMNS, MEETS = 200_000, 2000, 4096, 4_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles: `width` words each, or all words if they are fewer; A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([_words[w] for w in words], np.uint64)
    size = min(width, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out * STEP + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(least, ((s[i : i + 2048, None] ^ SALTS) * FACTORS).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def fewest_matches(percent: int) -> int:
    """Coordinates that a pair at the limit has in common, less DEVIATIONS standard deviations."""
    p = percent / 100
    return max(OVERLAP, math.floor(COORDINATES * p - DEVIATIONS * math.sqrt(COORDINATES * p * (1 - p))))


def keys_of(sigs: np.ndarray) -> np.ndarray:
    """A number for each (coordinate, value), by row of sigs."""
    return mix((np.arange(sigs.shape[1], dtype=np.uint64) << np.uint64(32)) | sigs.astype(np.uint64)).view(np.int64)


def _features(docs: DataFrame, width: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, hi, lo, sig = [], [], [], []
            for t in b["text"]:
                s = shingles(t, width)
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                hi.append(int.from_bytes(d[:8], "little", signed=True))
                lo.append(int.from_bytes(d[8:], "little", signed=True))
                sig.append(signature(s).view(np.int32) if len(s) else None)
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "n": n, "hi": hi, "lo": lo, "sig": sig})

    got = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n int, hi long, lo long, sig array<int>")
    return cut(got.withColumn("row", F.monotonically_increasing_id()))


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, items) for nodes (node, doc_id, hi, lo): their texts are found again by a Bloom filter of doc_ids and told by their digests."""
    key = F.xxhash64("doc_id")
    found = may_have(docs.select("doc_id", "text").withColumn("_key", key), key_filter(nodes.select(key.alias("_key")), "_key"), "_key", "_hit").filter("_hit")

    def run(batches):
        for b in batches:
            hi, lo, items = [], [], []
            for t in b["text"]:
                s = shingles(t, width)
                d = xxhash.xxh3_128_digest(s.tobytes())
                hi.append(int.from_bytes(d[:8], "little", signed=True))
                lo.append(int.from_bytes(d[8:], "little", signed=True))
                items.append(s.view(np.int64))
            yield pd.DataFrame({"id": b["doc_id"].array, "hi": hi, "lo": lo, "items": items})

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = found.select("doc_id", "text").mapInPandas(run, f"id {kind}, hi long, lo long, items array<long>")
    pick = nodes.select("node", "hi", "lo", F.col("doc_id").alias("_id"))
    # rows that repeat a doc_id and its text give one set twice
    return got.join(pick, ["hi", "lo"]).filter(F.col("id").eqNullSafe(F.col("_id"))).select("node", "items").dropDuplicates(["node"])


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def _alike(pairs: DataFrame, nodes: DataFrame, percent: int, least: int) -> DataFrame:
    """pairs whose sizes allow a link and whose signatures match in at least `least` coordinates, with the matches."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"sig{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    same = F.aggregate(F.zip_with("siga", "sigb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return both.select("a", "b", same.alias("matches")).filter(F.col("matches") >= least)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs with 100 * intersection >= percent * union, on full sets."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("items").alias(f"items{c}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    shared = F.size(F.array_intersect("itemsa", "itemsb"))
    return both.filter(100 * shared >= percent * (F.size("itemsa") + F.size("itemsb") - shared)).select("a", "b")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id of its component) and kept (it is that document).

    Links are pairs with 100 * intersection >= percent * union of their distinct shingles. Documents
    without a word have no shingles and link with nothing. Copies, near or exact, are never expanded
    into pairs. Rows that repeat one another are kept or dropped together; null doc_ids get the
    smallest doc_id that is not null of their component, or null. An empty table gives no rows; other
    columns aren't read. exact finds links without regard to signatures, at the cost of a posting for
    each rare shingle.
    """
    ready(docs.sparkSession)
    rows = _features(docs, width)
    # grouped by one column more than is joined on: the join then has exchanges whose skewed parts Spark can split
    classes = rows.filter("n > 0").groupBy("hi", "lo", "n").agg(F.min("row").alias("node")).select("hi", "lo", "node")
    tagged = cut(rows.join(classes, ["hi", "lo"]).select("doc_id", "n", "node", "hi", "lo", "row", F.when(F.col("row") == F.col("node"), F.col("sig")).alias("sig")))
    nodes = tagged.filter("row = node").select("node", "doc_id", "n", "hi", "lo", "sig")
    if exact:
        cluster = nodes.select("node", F.lit(0).cast("long").alias("comp"))
        comp = _within(cluster, cluster.filter("false"), cut(_sets(docs, nodes, width)), percent)
    else:
        comp = _components(docs, nodes, width, percent, fewest_matches(percent))
    labelled = tagged.select("doc_id", "n", "node").join(comp, "node", "left").select("doc_id", "n", F.coalesce("comp", "node").alias("comp"))
    smallest = labelled.groupBy("comp", F.pmod("comp", F.lit(2)).alias("_")).agg(F.min("doc_id").alias("component_id")).drop("_")
    out = labelled.join(smallest, "comp").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    empty = rows.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _postings(nodes: DataFrame, least: int) -> DataFrame:
    """(node, n, keys): each node's prefix, with the values that are common in a sample last."""
    def keyed(batches):
        for b in batches:
            keys = keys_of(np.stack(b["sig"].to_numpy()).view(np.uint32)) if len(b) else []
            yield pd.DataFrame({"key": np.ravel(keys)})

    sample = nodes.filter(F.pmod(F.xxhash64("hi", "lo"), F.lit(SAMPLE)) == 0).select("sig").mapInPandas(keyed, "key long")
    common = sample.groupBy("key").agg(F.count("*").alias("f")).filter("f > 1").orderBy(F.desc("f"), "key").limit(MOST_COMMON).toPandas().sort_values("key")
    held = nodes.sparkSession.sparkContext.broadcast((common["key"].to_numpy(np.int64), common["f"].to_numpy(np.int64)))
    length = COORDINATES - least + OVERLAP

    def prefix(batches):
        known, often = held.value
        for b in batches:
            if not len(b):
                continue
            keys = keys_of(np.stack(b["sig"].to_numpy()).view(np.uint32))
            f = np.zeros(keys.shape, np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                f = np.where(known[at] == keys, often[at], 0)
            order = np.lexsort((keys, f), axis=1)[:, :length]
            yield pd.DataFrame({"node": b["node"].to_numpy(), "n": b["n"].to_numpy(), "keys": list(np.take_along_axis(keys, order, 1))})

    return cut(nodes.select("node", "n", "sig").mapInPandas(prefix, "node long, n int, keys array<long>"))


def _components(docs: DataFrame, nodes: DataFrame, width: int, percent: int, least: int) -> DataFrame:
    """(node, comp) of the nodes that have a pair with enough matches."""
    post = _postings(nodes, least).select("node", F.explode("keys").alias("key"))
    shared = post.groupBy("key").agg(F.count("*").alias("f")).filter("f > 1")
    live = cut(may_have(post, key_filter(shared, "key"), "key", "_hit").filter("_hit").select("key", "node"))

    # 1. every node with the pivots of its lists: pairs with enough matches make clusters
    first = [F.min(F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), "node"))["node"].alias(f"p{seed}") for seed in range(SEEDS)]
    pivots = live.groupBy("key", F.pmod("key", F.lit(2)).alias("_")).agg(*first).drop("_")
    stars = live.join(pivots, "key").select("node", F.explode(F.array(*(f"p{seed}" for seed in range(SEEDS)))).alias("pivot")).filter("node <> pivot")
    tried = cut(_alike(_pairs(stars, "node", "pivot").distinct(), nodes, percent, least))
    cluster = components(tried)

    # 2. lists that hold several clusters
    across, unseen = _across(live, cluster, nodes, percent, least)
    cluster = _merged(cluster, across.select("a", "b").union(unseen))

    # 3. within clusters: each node with its best match, then what isn't one component yet
    sets = cut(_sets(docs, nodes.join(cluster, "node").select("node", "doc_id", "hi", "lo"), width))
    pairs = tried.union(across)
    best = pairs.union(pairs.select("b", "a", "matches")).groupBy("a").agg(F.max(F.struct("matches", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    comp = components(cut(_links(_pairs(best, "a", "b").distinct(), sets, percent)))
    return _within(cluster, comp, sets, percent)


def _mixed(rows: DataFrame, *key: str) -> DataFrame:
    """rows (key, node, comp, more) of the keys under which several components stand; adds main, the largest of them, and long: the key would make more than LIST_PAIRS pairs."""
    more = F.pmod(F.xxhash64(*key), F.lit(2)).alias("_")  # as above: keys that many rows have can be split
    parts = rows.groupBy(*key, more, "comp").agg(F.count("*").alias("c"))
    several = parts.groupBy(*key, "_").agg(F.sum("c").alias("k"), F.count("*").alias("parts"), F.max(F.struct("c", "comp")).alias("m")).filter("parts > 1")
    return rows.join(several.select(*key, F.col("m.comp").alias("main"), ((F.col("k") - F.col("m.c")) * F.col("k") > LIST_PAIRS).alias("long")), list(key))


def _met(rows: DataFrame, *key: str) -> DataFrame:
    """(a, b, collisions): pairs of different components under the same key; rows are those of _mixed() that aren't long."""
    other = rows.filter("comp <> main").select(*(F.col(k).alias(f"_{k}") for k in key), F.col("node").alias("_node"), F.col("comp").alias("_comp"))
    same = F.lit(True)
    for k in key:
        same &= F.col(k) == F.col(f"_{k}")
    pairs = rows.join(other, same & (F.col("comp") != F.col("_comp")) & ((F.col("comp") == F.col("main")) | (F.col("node") < F.col("_node"))))
    return _pairs(pairs, "node", "_node").groupBy("a", "b").agg(F.count("*").alias("collisions"))


def _across(live: DataFrame, cluster: DataFrame, nodes: DataFrame, percent: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(pairs of different clusters with enough matches, (a, b) that are put together unseen): see step 2 above.

    Of the OVERLAP lists that a pair with enough matches shares, some may be long; these count as
    shared if both nodes are in so many. If all are long, each node is in OVERLAP long ones.
    """
    labelled = live.join(cluster, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = cut(_mixed(labelled, "key"))
    in_long = mixed.filter("long").groupBy("node").agg(F.count("*").alias("l"))
    side = lambda c: in_long.select(F.col("node").alias(c), F.col("l").alias(f"l{c}"))
    met = _met(mixed.filter("not long"), "key").join(side("a"), "a", "left").join(side("b"), "b", "left")
    enough = met.filter(F.col("collisions") + F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0))) >= OVERLAP)
    hard = mixed.filter("long").join(in_long.filter(F.col("l") >= OVERLAP), "node").select("key", "node")
    heads = hard.groupBy("key", F.pmod("key", F.lit(2)).alias("_")).agg(F.min("node").alias("b")).drop("_")
    unseen = hard.join(heads, "key").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    return cut(_alike(enough.select("a", "b"), nodes, percent, least)), unseen


def linked(items: list[np.ndarray], other: list[np.ndarray], percent: int) -> np.ndarray:
    """[i, j]: whether items[i] and other[j] are linked.

    Shared hashes are counted one meeting at a time where few meet, and else by a product of incidence
    matrices, some columns at a time.
    """
    na, nb = np.array([len(x) for x in items]), np.array([len(x) for x in other])
    fa, fb = np.concatenate(items), np.concatenate(other)
    vocab = np.intersect1d(fa, fb)
    shared = np.zeros((len(items), len(other)), np.float32)

    def entries(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(vocab, flat), max(0, len(vocab) - 1))
        have = vocab[at] == flat
        return np.repeat(np.arange(len(sizes)), sizes)[have], at[have]

    if len(vocab):
        (ra, ca), (rb, cb) = entries(fa, na), entries(fb, nb)
        per = np.bincount(cb, minlength=len(vocab))
        meets = per[ca]
        if meets.sum() * 50 < len(items) * len(other) * len(vocab):
            rb = rb[np.argsort(cb, kind="stable")]
            begin = (np.cumsum(per) - per)[ca]
            done = np.cumsum(meets)
            stops = [0, *np.searchsorted(done, np.arange(MEETS, done[-1], MEETS), "right"), len(ca)]
            for i, j in zip(stops, stops[1:]):
                n = meets[i:j]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[i:j], n)
                flat = np.repeat(ra[i:j], n) * len(other) + rb[step]
                shared += np.bincount(flat, minlength=shared.size).reshape(shared.shape)
        else:
            for k in range(0, len(vocab), COLUMNS):
                a, b = np.zeros((len(items), COLUMNS), np.float32), np.zeros((len(other), COLUMNS), np.float32)
                for m, r, c in ((a, ra, ca), (b, rb, cb)):
                    own = (c >= k) & (c < k + COLUMNS)
                    m[r[own], c[own] - k] = 1
                shared += a @ b.T
    return 100 * shared >= percent * (na[:, None] + nb[None, :] - shared)


def _within(cluster: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """comp, with the components of one cluster joined that links connect.

    Only clusters with several components are looked at. Small ones go to _blocks(). In a large one a set
    of n is posted under its n - percent * n / 100 + 1 rarest shingles in that cluster: two linked sets
    meet there. Lists that make few pairs are expanded and the pairs checked; nodes of the other lists
    go to _blocks().
    """
    own = cluster.withColumnRenamed("comp", "cluster").join(comp, "node", "left").select("node", "cluster", F.coalesce("comp", "node").alias("comp"))
    parts = own.groupBy("cluster", "comp").agg(F.count("*").alias("c"))
    torn = (
        parts.groupBy("cluster", F.pmod("cluster", F.lit(2)).alias("_")).agg(F.count("*").alias("k"), F.max(F.struct("c", "comp")).alias("m"))
        .filter("k > 1").select("cluster", F.col("m.comp").alias("main"))
    )
    weight = F.greatest(F.size("items"), F.lit(BLOCK // ROWS))
    member = cut(own.join(torn, "cluster").join(sets, "node").withColumns({"other": F.col("comp") != F.col("main"), "weight": weight}))
    # written first, so that its size is known: a small table doesn't deal members out by cluster, a large one is joined in parts
    totals = cut(member.groupBy("cluster", F.pmod("cluster", F.lit(2)).alias("_")).agg(F.sum("weight").alias("total")).filter(F.col("total") > BLOCK).select("cluster"))
    if totals.isEmpty():
        return _merged(comp, _blocks(member, percent))
    large = member.join(totals, "cluster", "left_semi")
    items = large.select("cluster", "node", F.explode("items").alias("item"))
    often = items.groupBy("cluster", "item", F.pmod("item", F.lit(2)).alias("_")).agg(F.count("*").alias("df")).drop("_")
    ranked = items.join(often, ["cluster", "item"]).groupBy("cluster", "node").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("r"))
    n = F.size("r")
    rare = F.filter(F.slice("r", F.lit(1), n - F.floor((n * percent + 99) / 100).cast("int") + 1), lambda x: x["df"] > 1)
    post = cut(ranked.select("cluster", "node", n.alias("n"), F.explode(rare["item"]).alias("item")).join(large.select("node", "comp"), "node"))
    mixed = cut(_mixed(post, "cluster", "item"))
    some = mixed.filter("not long")
    few = _met(some, "cluster", "item").select("a", "b")
    dense = member.join(mixed.filter("long").select("node").distinct(), "node", "left_semi")
    small = member.join(totals, "cluster", "left_anti")
    return _merged(comp, _links(few, sets, percent).union(_blocks(small.unionByName(dense), percent)))


def _blocks(member: DataFrame, percent: int) -> DataFrame:
    """Links between different components of one cluster; enough of them to join all that are linked.

    member: (node, cluster, comp, main, items, other, weight). Nodes outside a cluster's largest component
    are compared with all its nodes, in blocks of about BLOCK hashes and ROWS sets on either side; small
    clusters share a block. A block gives one link at most for each node and component, so links
    within dense clusters aren't expanded.
    """
    member = cut(member.select("cluster", "node", "comp", "items", "other", "weight"))
    sizes = cut(member.groupBy("cluster", F.pmod("cluster", F.lit(2)).alias("_")).agg(
        F.ceil(F.sum("weight") / BLOCK).alias("all_blocks"), F.coalesce(F.ceil(F.sum(F.when(F.col("other"), F.col("weight"))) / BLOCK), F.lit(0)).alias("other_blocks"), F.sum("weight").alias("total")
    ).drop("_").filter("other_blocks > 0"))
    small = sizes.filter("all_blocks = 1").agg(F.coalesce(F.ceil(F.sum("total") / BLOCK), F.lit(1)).alias("n")).first()["n"]
    placed = member.join(sizes, "cluster")
    # a block is (x, y): x is one of the small clusters' bins, or the cluster; y numbers its pairs of blocks
    x = F.when(F.col("all_blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(small)) - F.lit(small)).otherwise(F.col("cluster"))
    row = F.pmod(F.xxhash64("node", F.lit(1)), F.col("other_blocks"))
    column = F.pmod(F.xxhash64("node", F.lit(2)), F.col("all_blocks"))
    numbers = lambda n: F.explode(F.expr(f"transform(sequence(0L, {n} - 1), k -> k)"))
    columns = x.alias("x"), "cluster", "node", "comp", "items"
    as_other = placed.filter("other").withColumn("y", numbers("all_blocks")).select((row * F.col("all_blocks") + F.col("y")).alias("y"), *columns, F.lit(True).alias("left"))
    as_any = placed.withColumn("y", numbers("other_blocks")).select((F.col("y") * F.col("all_blocks") + column).alias("y"), *columns, F.lit(False).alias("left"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby("cluster", sort=False):
            left, right = part[part["left"]], part[~part["left"]]
            if not len(left) or not len(right):
                continue
            hit = linked(list(left["items"]), list(right["items"]), percent)
            lc, rc = left["comp"].to_numpy(), right["comp"].to_numpy()
            i, j = np.nonzero(hit & (lc[:, None] != rc[None, :]))
            if len(i):
                _, first = np.unique(np.stack([i, rc[j]]), axis=1, return_index=True)
                out.append(pd.DataFrame({"a": left["node"].to_numpy()[i[first]], "b": right["node"].to_numpy()[j[first]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    return as_other.union(as_any).groupBy("x", "y").applyInPandas(block, "a long, b long")


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp with the components joined that links connect."""
    links = cut(links.select("a", "b"))
    if links.isEmpty():
        return comp
    side = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    own = links.select("a").union(links.select("b")).distinct().withColumnRenamed("a", "node").join(comp, "node", "left_anti").select("node", F.col("node").alias("comp"))
    edges = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    return cut(relabel(comp.union(own), components(edges)))


def drop_near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that near_duplicates() doesn't keep; one of each component stays.

    A row whose doc_id is null stays. Only rows whose doc_id may be among the dropped ones, by a Bloom
    filter, are joined; all other texts stay where they are read.
    """
    gone = near_duplicates(docs, width=width, percent=percent).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone"))
    gone = cut(gone)
    key = F.xxhash64("doc_id")
    marked = may_have(docs.withColumn("_key", key), key_filter(gone.select(F.xxhash64("_gone").alias("_key")), "_key"), "_key", "_hit")
    return marked.filter("not _hit").select(docs.columns).union(marked.filter("_hit").select(docs.columns).join(gone, F.col("doc_id") == F.col("_gone"), "left_anti"))
