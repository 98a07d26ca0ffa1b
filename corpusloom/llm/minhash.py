"""Near-duplicate texts by weighted MinHash (operator 1).

Five-word shingles carry a TF-IDF weight.  Improved consistent weighted sampling draws samples that agree for two texts
with the probability of their weighted Jaccard similarity; bands of three samples make candidates, and every link is verified
by the weighted Jaccard similarity itself.  Links join texts into classes.

Three passes read the texts: word document frequencies, signatures, and the texts of candidates.  Only candidates'
texts move to be compared.  Equal texts are one node from the start, so copies cost nothing after the signature.

Pairs of one class need no comparison.  So each bucket's rows first meet one hub, which brings large classes together at a cost in proportion to the
rows.  Buckets that still hold several classes are compared block by block, each text beside others of its bucket in one task, and only links that
join classes leave it.  Crowds beyond that meet by rare shingles: two sets of similarity 0.8 share one among the rarest that make up a fifth of
their weight, so every such pair meets, while what a whole crowd has in common brings nobody together.

Document frequencies are kept in a hashed table of fixed size (2**20 counters over all documents), which is what makes it safe to broadcast.
Words that share a counter share a frequency.  Frequencies count from a floor of one in 4,096 documents on: rare words that share a counter add
about their number in a document over 2**20, which stays below the floor whatever the size of the corpus, so rare words weigh the same in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from corpusloom.llm.common import documents, forget, query, stored, stored_by, text_of

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 10, 3
#: Rows of a block, and blocks of a bucket beyond which its rows meet by rare shingles.
BLOCK, MOST_BLOCKS = 1024, 16
#: Sets that share an element are paired one by one up to this number, in a matrix product beyond it.
FEW = 24
COUNTERS, FLOOR = 1 << 20, 4096
SAMPLES = BANDS * ROWS
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * M2
    x ^= x >> np.uint64(29)
    x = x * M3
    return x ^ (x >> np.uint64(32))


def _draws() -> tuple[np.ndarray, np.ndarray]:
    """65,536 draws of Gamma(2, 1) and of the logarithm of another one, from hashed counters."""
    with np.errstate(over="ignore"):
        u = [(_mix(np.arange(1, 65537, dtype=np.uint64) * M1 + np.uint64(k)) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54 for k in range(4)]
    return (-np.log(u[0] * u[1])).astype(np.float32), np.log(-np.log(u[2] * u[3])).astype(np.float32)


R_DRAWS, LOG_C_DRAWS = _draws()
SALTS = _mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * M1)


class Words(dict):
    """64-bit hash of each word, kept while the table is small (a cache: results do not depend on it)."""

    def __missing__(self, word):
        if len(self) > 2_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def word_hashes(text: str, words: Words) -> np.ndarray:
    split = text.split()
    return np.fromiter(map(words.__getitem__, split), np.uint64, len(split))


def counted(h: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a text of word hashes ``h``, the mean idf of each one's words, and how often it occurs.

    A text with fewer words than a shingle is one shingle; a text without words has none.
    """
    if not len(h):
        return h, np.zeros(0, np.float32), np.zeros(0, np.int64)
    k = min(WORDS, len(h))
    n = len(h) - k + 1
    w = idf[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]
    s, total = np.full(n, k, np.uint64), np.zeros(n, np.float32)
    for i in range(k):
        s = _mix(s * M1 + h[i:i + n])
        total += w[i:i + n]
    s, at, tf = np.unique(s, return_index=True, return_counts=True)
    return s, total[at] / np.float32(k), tf


def shingles(h: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a text and their weights: occurrences times idf."""
    s, base, tf = counted(h, idf)
    return s, (base * tf).astype(np.float32)


def sample(s: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The consistent samples of a weighted set: SAMPLES hashes of (element, level)."""
    best = np.full(SAMPLES, np.inf, np.float32)
    out = np.zeros(SAMPLES, np.uint64)
    for a in range(0, len(s), 4096):  # a long text's matrix stays small
        x, log_w = s[a:a + 4096], np.log(weight[a:a + 4096])[:, None]
        z = x[:, None] ^ SALTS[None, :]
        z = z * M2
        z ^= z >> np.uint64(31)
        z = z * M3
        r = R_DRAWS[(z >> np.uint64(48)).astype(np.int64)]
        beta = (z & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
        t = np.floor(log_w / r + beta)
        cost = LOG_C_DRAWS[((z >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - beta + 1)
        low = np.argmin(cost, axis=0)
        found = cost[low, np.arange(SAMPLES)]
        take = found < best
        best[take] = found[take]
        level = t[low, np.arange(SAMPLES)].astype(np.int64).astype(np.uint64)
        out[take] = _mix(x[low] * M1 + level)[take]
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, count, docs = Words(), np.zeros(COUNTERS, np.int64), 0
    with np.errstate(over="ignore"):
        for b in batches:
            for text in b.column(0).to_pylist():
                docs += 1
                slots = np.unique(word_hashes(text, words) & np.uint64(COUNTERS - 1)).astype(np.int64)
                count[slots] += 1
    used = np.flatnonzero(count)
    yield pa.record_batch({"counter": pa.array(np.append(used, -1)), "docs": pa.array(np.append(count[used], docs))})


def idf_table(docs: DataFrame, text: str) -> np.ndarray:
    """Inverse document frequency by counter over all documents; at most COUNTERS + 1 rows come to the driver."""
    per = docs.select(text_of(text).alias("t")).mapInArrow(_frequencies, "counter long, docs long")
    got = per.groupBy("counter").agg(F.sum("docs").alias("docs")).toArrow()
    counter, n = got.column("counter").to_numpy(), got.column("docs").to_numpy()
    df = np.zeros(COUNTERS, np.int64)
    df[counter[counter >= 0]] = n[counter >= 0]
    total = n[counter < 0].sum()
    return (np.log((1 + total) / (1 + np.maximum(df, total / FLOOR))) + 1).astype(np.float32)


def _shared(df: DataFrame, idf: np.ndarray):
    return df.sparkSession.sparkContext.broadcast(idf)  # 4 MB whatever the input


def signatures(docs: DataFrame, idf: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """doc_id, node (a 128-bit digest of the text), bands and total weight of each document; bands is empty for texts without words."""
    held = _shared(docs, idf)

    def sign(batches):
        words = Words()
        with np.errstate(over="ignore"):
            for b in batches:
                bands, weights = [], []
                for t in b.column(2).to_pylist():
                    s, w = shingles(word_hashes(t, words), held.value)
                    weights.append(float(w.sum(dtype=np.float64)))
                    if not len(s):
                        bands.append([])
                        continue
                    x = sample(s, w).reshape(BANDS, ROWS)
                    key = np.arange(BANDS, dtype=np.uint64)
                    for k in range(ROWS):
                        key = _mix(key * M1 + x[:, k])
                    bands.append(key.view(np.int64).tolist())
                yield pa.record_batch({"doc_id": b.column(0), "node": b.column(1), "bands": pa.array(bands, pa.list_(pa.int64())), "weight": pa.array(weights, pa.float64())})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.md5(text_of(text)).alias("node"), text_of(text).alias("t"))
    return rows.mapInArrow(sign, "doc_id long, node string, bands array<long>, weight double")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle sets."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64)
    return float(least / max(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - least, 1e-30)) if len(both) else 0.0


def verified(edges: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """The edges (node, other) whose texts have the wanted similarity.

    Members travel to their partner in salted groups: the partner's text is sent once per salt, so a partner of many is many groups.
    """
    held, salts = _shared(edges, idf), 16
    salt = F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")
    asked = edges.withColumn("salt", salt)
    members = asked.join(texts, "node").select("other", "salt", "node", "text")
    centres = (asked.select("other", "salt").distinct().join(texts.withColumnRenamed("node", "other"), "other")
               .select("other", "salt", F.lit(None).cast("string").alias("node"), "text"))

    def compare(batches):
        words, centre, mine = Words(), None, None
        with np.errstate(over="ignore"):
            for b in batches:
                found = []
                for other, node, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                    x = shingles(word_hashes(t, words), held.value)
                    if node is None:
                        centre, mine = other, x
                    elif centre == other and similarity(mine, x) >= THRESHOLD:
                        found.append((node, other))
                yield pa.record_batch({"node": pa.array([f[0] for f in found], pa.string()), "other": pa.array([f[1] for f in found], pa.string())})

    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (centres.unionByName(members).repartition(parts, "other", "salt")
            .sortWithinPartitions("other", "salt", F.col("node").asc_nulls_first())
            .mapInArrow(compare, "node string, other string"))


def components(links: DataFrame) -> DataFrame:
    """node, class for every node of the links (node, other): class is the smallest node it is connected with.

    Each step gives a node the smallest class among its neighbours and then that class's own class, until nothing changes.
    Classes are stored at every step.
    """
    both = stored(links.select("node", "other").unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    cls = both.groupBy("node").agg(F.least("node", F.min("other")).alias("class"))
    while True:
        cls = stored(cls, "classes")
        near = (both.join(cls.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("class").alias("near")))
        low = cls.join(near, "node").select("node", F.least("class", "near").alias("low"), "class")
        jump = low.join(cls.select(F.col("node").alias("low"), F.col("class").alias("further")), "low", "left")
        step = stored(jump.select("node", F.least("low", F.coalesce("further", "low")).alias("new"), "class"), "class-step")
        if step.filter("new <> class").isEmpty():
            return cls
        cls = step.select("node", F.col("new").alias("class"))


def _open(rows: DataFrame, cls: DataFrame | None) -> DataFrame:
    """The rows of buckets whose rows are of more than one class, with ``class``."""
    of = rows.withColumn("class", F.col("node")) if cls is None else rows.join(cls, "node", "left").withColumn("class", F.coalesce("class", "node"))
    several = of.groupBy("bucket").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a <> b")
    return of.join(several.select("bucket"), "bucket")


def _to_hub(rows: DataFrame) -> DataFrame:
    """Pairs (node, other) of each row and its bucket's hub, the node that shares most buckets with others, once each.

    Left out are pairs whose total weights alone keep the similarity below the threshold.
    """
    hubs = rows.groupBy("bucket").agg(F.max(F.struct("popularity", "node", "weight")).alias("hub"))
    near = F.least("weight", "hub.weight") >= F.lit(THRESHOLD * (1 - 1e-6)) * F.greatest("weight", "hub.weight")
    return rows.join(hubs, "bucket").filter((F.col("node") != F.col("hub.node")) & near).select("node", F.col("hub.node").alias("other")).distinct()


def _overlaps(sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Common weight of each two of some sets (shingles, idf, occurrences), in single precision."""
    tf = np.concatenate([x[2] for x in sets])
    nth = np.arange(int(tf.sum())) - np.repeat(np.cumsum(tf) - tf, tf)  # each occurrence is an element of its own
    key = _mix(np.repeat(np.concatenate([x[0] for x in sets]), tf) * M1 + nth.astype(np.uint64))
    row = np.repeat(np.repeat(np.arange(len(sets)), [len(x[0]) for x in sets]), tf)
    base = np.repeat(np.concatenate([x[1] for x in sets]), tf)
    order = np.argsort(key, kind="stable")
    key, row, base = key[order], row[order], base[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    many = np.diff(np.append(head, len(key)))
    out = np.zeros((len(sets), len(sets)), np.float32)
    few = np.repeat(many <= FEW, many)
    for apart in range(1, FEW):
        i = np.flatnonzero((key[apart:] == key[:-apart]) & few[apart:])
        if not len(i):
            break
        np.add.at(out, (row[i], row[i + apart]), base[i])
    out += out.T
    column = np.repeat(np.cumsum(many > FEW) - 1, many)
    for first in range(0, int((many > FEW).sum()), 4096):
        i = np.flatnonzero(~few & (column >= first) & (column < first + 4096))
        has = np.zeros((len(sets), int(column[i].max()) - first + 1), np.float32)
        has[row[i], column[i] - first] = 1
        weight = np.zeros(has.shape[1], np.float32)
        weight[column[i] - first] = base[i]
        out += (has * weight) @ has.T
    return out


def _cell_links(nodes: list[str], classes: list[str], blocks: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[str, str]]:
    """Links that join different classes, as many as needed: within one block, or across two."""
    weight = np.array([float((x[1] * x[2]).sum(dtype=np.float64)) for x in sets])
    common = _overlaps(sets)
    near = common >= (THRESHOLD - 1e-4) * (weight[:, None] + weight - common)
    number = np.unique(classes, return_inverse=True)[1]
    near &= number[:, None] != number
    near &= blocks[:, None] < blocks if blocks[0] != blocks[-1] else np.triu(np.ones_like(near), 1)
    parent, links = list(range(int(number.max()) + 1)), []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    full = {}
    for i, j in np.argwhere(near).tolist():
        a, b = root(int(number[i])), root(int(number[j]))
        if a != b:
            for k in (i, j):
                full[k] = full.get(k) or (sets[k][0], (sets[k][1] * sets[k][2]).astype(np.float32))
            if similarity(full[i], full[j]) >= THRESHOLD:
                links.append((nodes[i], nodes[j]))
                parent[a] = b
    return links


def _within(rows: DataFrame, key: list[str], texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """Links (node, other) between rows equal in ``key`` and not of one class: each group in blocks, each two blocks in one task."""
    held, parts = _shared(rows, idf), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    met = rows.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = met.select("node", "class", *key, "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_beside"))
    low, high = F.least("block", "_beside"), F.greatest("block", "_beside")
    met = met.select("node", "class", "block", F.xxhash64(*key, low, high).alias("cell"))

    def compare(batches):
        words, cell, held_rows = Words(), None, []

        def close():
            nodes, classes, at, sets = zip(*held_rows)
            return _cell_links(list(nodes), list(classes), np.array(at), list(sets)) if len(nodes) > 1 else []

        def batch(found):
            return pa.record_batch({"node": pa.array([f[0] for f in found], pa.string()), "other": pa.array([f[1] for f in found], pa.string())})

        with np.errstate(over="ignore"):
            for b in batches:
                found = []
                for of, block, node, cls, t in zip(*[b.column(k).to_pylist() for k in range(5)]):
                    if of != cell:
                        found += close() if held_rows else []
                        cell, held_rows = of, []
                    held_rows.append((node, cls, block, counted(word_hashes(t, words), held.value)))
                yield batch(found)
            if held_rows:
                yield batch(close())

    return (met.join(texts, "node").select("cell", "block", "node", "class", "text").repartition(parts, "cell")
            .sortWithinPartitions("cell", "block", "node").mapInArrow(compare, "node string, other string"))


def _rare(nodes: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(node, shingle): of each node the rarest shingles among all ``nodes``, up to more than the weight that two similar sets may differ by.

    All nodes take shingles in one order (number of nodes that have it, then hash).  If two sets have no common shingle among those taken, their common
    weight lies in what one of them has left, which is less than the threshold's share of its whole weight.
    """
    held = _shared(nodes, idf)

    def sets(batches):
        words = Words()
        with np.errstate(over="ignore"):
            for b in batches:
                got = [shingles(word_hashes(t, words), held.value) for t in b.column(1).to_pylist()]
                yield pa.record_batch({"node": b.column(0), "s": pa.array([g[0].view(np.int64) for g in got], pa.list_(pa.int64())),
                                       "w": pa.array([g[1].astype(np.float64) for g in got], pa.list_(pa.float64()))})

    each = texts.join(nodes, "node").select("node", "text").mapInArrow(sets, "node string, s array<long>, w array<double>")
    each = stored(each.select("node", F.explode(F.arrays_zip("s", "w")).alias("x")).select("node", F.col("x.s").alias("shingle"), F.col("x.w").alias("w")), "crowd-shingles")
    common = each.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")  # one that nobody else has leads to nobody
    order = W.partitionBy("node").orderBy("n", "shingle")
    ranked = each.join(common, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    ranked = ranked.withColumn("before", F.sum("w").over(order.rowsBetween(W.unboundedPreceding, -1))).withColumn("all", F.sum("w").over(W.partitionBy("node")))
    return ranked.filter((F.coalesce("before", F.lit(0.0)) <= F.lit(1 - THRESHOLD + 1e-6) * F.col("all")) & (F.col("n") > 1)).select("node", "shingle")


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of the class), class_size (rows), n_links of its text, kept, node (digest of the text), class.

    Texts are compared as sets of five-word shingles at 0.8; equal texts are always of one class, texts without words only with equal texts.
    A null text counts as empty.  ``kept`` marks the rows of the smallest doc_id; rows without an id are kept only in a class without any.

    Every pair that shares a bucket is compared or known to be of one class, but for pairs in crowded buckets that share no rare shingle and so cannot be similar.
    """
    idf = idf_table(docs, text)
    signed = stored(signatures(docs, idf, doc_id, text), "signatures")
    nodes = signed.groupBy("node").agg(F.first("bands").alias("bands"), F.first("weight").alias("weight"))
    banded = nodes.select("node", "weight", F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    met = stored(banded.join(sizes, "bucket"), "buckets")
    wanted = stored(met.groupBy("node").agg(F.sum("n").alias("popularity")), "nodes")
    shared = met.join(wanted, "node").select("bucket", "node", "popularity", "weight")
    # one row of each text: its smallest id joins too, so a text with many copies is not one hot key
    no_id = F.lit(-(1 << 63)).cast("long")
    first = signed.groupBy("node").agg(F.coalesce(F.min("doc_id"), no_id).alias("id")).join(wanted.select("node"), "node")
    # in buckets of the node, so that no turn moves them but those it compares
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = stored_by(docs.select(F.md5(text_of(text)).alias("node"), text_of(text).alias("text"), F.coalesce(F.col(doc_id).cast("long"), no_id).alias("id"))
                   .join(first, ["node", "id"]).select("node", "text").dropDuplicates(["node"]), "candidates", "node", parts, compression="zstd")
    links = cls = None

    def linked(new: DataFrame) -> None:
        nonlocal links, cls
        links = new if links is None else links.unionByName(new)
        if not new.isEmpty():
            cls = components(links)

    open_rows = stored(_open(shared, cls), "open")
    linked(stored(verified(stored(_to_hub(open_rows), "pairs"), texts, idf), "links-hubs"))
    rows = _open(open_rows.select(*shared.columns), cls)
    rows = stored(rows.join(rows.groupBy("bucket").agg(F.count("*").alias("rows")), "bucket"), "open")
    forget(open_rows)
    crowded = F.col("rows") > MOST_BLOCKS * BLOCK
    linked(stored(_within(rows.filter(~crowded), ["bucket"], texts, idf), "links-buckets"))
    crowds = _open(rows.filter(crowded).select(*shared.columns), cls)
    if not crowds.isEmpty():
        crowds = stored(crowds, "crowds")
        keyed = crowds.join(_rare(crowds.select("node").distinct(), texts, idf), "node")
        several = keyed.groupBy("bucket", "shingle").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a <> b")
        keyed = stored(keyed.join(several.select("bucket", "shingle"), ["bucket", "shingle"]), "keyed")
        linked(stored(_within(keyed, ["bucket", "shingle"], texts, idf), "links-crowds"))
    forget(rows)
    if cls is None:
        links = docs.sparkSession.createDataFrame([], "node string, other string") if links is None else links
        cls = links.select("node", F.col("other").alias("class"))
    degree = links.select(F.explode(F.array("node", "other")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    of = signed.select("doc_id", "node").join(cls, "node", "left").withColumn("class", F.coalesce("class", "node"))
    heads = of.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return (of.join(degree, "node", "left").join(heads, "class")
            .select("doc_id", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "node", "class"))


@query("op1_minhash_near_dedup")
def op1_minhash_near_dedup(spark, sf_dir):
    return near_classes(documents(spark, sf_dir))
