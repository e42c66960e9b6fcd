"""Near-duplicate documents by chosen-path set similarity join.

Documents are sets of word shingles.  Documents of equal sets form a class, for
which its first row stands.  A representative's minwise tokens are the minima
of its shingles under many hash functions.  Each of several independent trees
branches the representatives by the tokens of its own sequence of functions:
documents that agree on all tokens so far share a node.  Nodes begin at
``START`` tokens, of functions that no other tree begins with; one with more
than ``LEAF`` members is branched again, each member going to ``CHILDREN`` nodes
by further tokens, so that deeper nodes lose no recall.  What still shares a
large node at ``DEEPEST`` is joined without looking further.

Small nodes are compared exhaustively, by sketches of the minwise tokens: a
spanning forest of the pairs whose estimated similarity is no lower than a bound
several standard deviations below the threshold.  Components of these forests
are clusters that hold every link.  Clusters are settled on full sets, exactly,
in tasks of about ``TILE`` documents or twice as many: each block of a cluster is
compared within itself and with ``PIVOTS`` documents of the whole cluster, which
joins most of what is near; then only documents outside a cluster's largest
component meet the other blocks.  Components of all these links are the result.

With ``TREES`` = 16 trees and 3 tokens a pair at similarity 0.85 is missed with
probability (1 - 0.85^3)^16 = 2e-7, one at 0.80 with 1e-5, and by the sketches,
whose bound follows the threshold, with about 1e-4 at either.

Defined cases: null texts and texts without words have an empty set, are linked
with nothing and keep their row; a text of fewer words than a shingle has its
whole sequence as one; every row is judged by its own text, also where rows
share an id or have none; a null id counts as larger than all others, so that
the component of rows without ids is null; of rows that share the id of their
component the first is kept; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.base import by_runs, join_sized, parts_for, small_enough, table, text_hash, texts_of, written
from sextant.llm.components import components
from sextant.llm.kernels import Words, mix

U = np.uint64
SHINGLE, THRESHOLD = 5, 85
TREES, START, LEAF, CHILDREN, DEEPEST = 16, 3, 4096, 2, 7
#: Minwise tokens of a sketch, and by how many standard deviations fewer than
#: expected at the threshold a candidate pair may have in common.
TOKENS, BELOW = 128, 4
TILE, PIVOTS = 512, 32
#: Copies of each class in the join that gives its members their representative,
#: for classes that hold much of the corpus.
SALT = 32
_RNG = np.random.default_rng(20240501)
_XOR = _RNG.integers(0, 1 << 64, TOKENS, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 64, TOKENS, dtype=np.uint64) | U(1)
#: The order in which each tree uses the hash functions: its own ones, then others.
_OWN = np.arange(TOKENS).reshape(TREES, -1)
_PATHS = np.stack([np.concatenate([own, _RNG.permutation(np.setdiff1d(np.arange(TOKENS), own))]) for own in _OWN])


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    low = [t.lower() for t in texts]  # of bytes: A-Z only
    words = Words(low)
    out = []
    for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
        h = words.hash[lo:hi]
        if not len(h):
            out.append(np.empty(0, np.uint64))
            continue
        n = min(width, len(h))
        grams = np.full(len(h) - n + 1, U(n))
        for i in range(n):
            grams = mix(grams * U(0x9DDFEA08EB382D69) + h[i : len(h) - n + 1 + i])
        out.append(np.unique(grams))
    return out


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of each non-empty set under each hash function, as 32 bits."""
    out = np.zeros((len(sets), TOKENS), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):  # so many sets at once as fit in the cache
        end, size = at, 0
        while end < len(full) and (end == at or size + len(sets[full[end]]) <= 32768):
            size += len(sets[full[end]])
            end += 1
        some = full[at:end]
        flat = np.concatenate([sets[i] for i in some])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in some])[:-1]])
        for k in range(TOKENS):
            out[some, k] = (np.minimum.reduceat((flat ^ _XOR[k]) * _ODD[k], starts) >> U(32)).astype(np.uint32)
        at = end
    return out


SIGNATURE = "doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, tokens binary"


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(texts_of(batch.column(2)), width)
            tokens = minwise(sets)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array([t.tobytes() for t in tokens], pa.binary())], ["doc_id", "text_hash", "n_shingles", "digest", "tokens"])

    return _texts(docs, id_col, text_col).mapInArrow(go, SIGNATURE)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_hash(text).alias("text_hash"), text.alias("text"))


def _matrix(column: pa.ChunkedArray | pa.Array, dtype: type) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), dtype).reshape(len(data), -1)


def _rooted(reps: DataFrame) -> DataFrame:
    """Each representative in the nodes of ``START`` tokens, one for each tree."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = _matrix(batch.column("tokens"), np.uint32)
            sketch = pa.array([t.tobytes() for t in tokens.astype(np.uint8)], pa.binary())
            for tree in range(TREES):
                node = np.full(len(tokens), U(tree + 1))
                for k in _PATHS[tree, :START]:
                    node = mix(node + tokens[:, k].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(np.full(len(tokens), tree, np.int32)), pa.array(np.full(len(tokens), START, np.int32)), batch.column("uid"), sketch], ["node", "tree", "depth", "uid", "sketch"])

    return reps.select("uid", "tokens").mapInArrow(go, "node bigint, tree int, depth int, uid bigint, sketch binary")


def _branched(members: DataFrame) -> DataFrame:
    """Members of nodes (with their tokens), each in ``CHILDREN`` deeper nodes."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = _matrix(batch.column("tokens"), np.uint32)
            node, tree, depth = (batch.column(k).to_numpy() for k in ("node", "tree", "depth"))
            for child in range(CHILDREN):
                k = _PATHS[tree, (START + (depth - START) * CHILDREN + child) % TOKENS]
                deeper = mix(mix(node.view(np.uint64) + U(child + 1)) + tokens[np.arange(len(k)), k].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(deeper.view(np.int64)), batch.column("tree"), pa.array((depth + 1).astype(np.int32)), batch.column("uid"), batch.column("sketch")], ["node", "tree", "depth", "uid", "sketch"])

    return members.mapInArrow(go, "node bigint, tree int, depth int, uid bigint, sketch binary")


def nodes(reps: DataFrame, leaf: int = LEAF, deepest: int = DEEPEST) -> tuple[DataFrame, DataFrame | None]:
    """Nodes to compare: node, uid, sketch; and links of those that stay large,
    each member to the smallest of its node (None without such nodes)."""
    front, done, joined = _rooted(reps), None, None
    for depth in range(START, deepest + 1):
        counts = front.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("least"))
        large = written(counts.where(F.col("n") > leaf).select("node", "least"), "large")
        if large.isEmpty():
            break
        small = front.join(large, "node", "left_anti")
        done = small if done is None else done.unionByName(small)
        members = join_sized(front, large, ["node"], "inner")
        if depth == deepest:
            joined, front = members.select(F.col("uid").alias("a"), F.col("least").alias("b")), None
            break
        front = written(_branched(members.join(reps.select("uid", "tokens"), "uid")), "deeper")
    found = [f for f in (done, front) if f is not None]
    return reduce(DataFrame.unionByName, found).select("node", "uid", "sketch"), joined


def needed(threshold: int) -> int:
    """Tokens that a candidate pair has in common at least."""
    t = threshold / 100
    return int(np.ceil(t * TOKENS - BELOW * np.sqrt(t * (1 - t) * TOKENS)))


def _forest(threshold: int):
    """Edges that connect what is connected by near pairs within a node: from a
    member, all that are near and not yet reached are reached next."""
    need = needed(threshold)

    def go(group: pa.Table) -> Iterator[pa.RecordBatch]:
        if group.num_rows < 2:
            return
        ids, sketch = group["uid"].to_numpy(), _matrix(group["sketch"], np.uint8)
        left = np.arange(len(ids))
        a, b = [], []
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            root = queue[0]
            while queue and len(left):
                near = (sketch[left] == sketch[queue.pop()]).sum(1) >= need
                new = left[near]
                a += [ids[root]] * len(new)
                b += ids[new].tolist()
                queue += new.tolist()
                left = left[~near]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return go


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


class _Common:
    """Sizes of intersections.  Sets are rows of bits over the shingles that more
    than one has, or sorted columns where that matrix would be too large."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, n: int, width: int, most: int = 64 << 20) -> None:
        self.width, self.bits = width, None
        packed = -(-max(1, width) // 64) * 8
        if n * packed <= most:
            bits = np.zeros((n, packed), np.uint8)
            np.bitwise_or.at(bits, (rows, cols >> 3), (1 << (cols & 7)).astype(np.uint8))
            self.bits = bits.view(np.uint64)
        else:
            self.cols, self.at = cols, np.searchsorted(rows, np.arange(n + 1))

    def sizes(self, i: int, other: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return np.bitwise_count(self.bits[other] & self.bits[i]).sum(1, dtype=np.int64)
        mine = np.zeros(self.width + 1, bool)
        mine[self.cols[self.at[i] : self.at[i + 1]]] = True
        return np.array([int(mine[self.cols[self.at[j] : self.at[j + 1]]].sum()) for j in other.tolist()], np.int64)


def _linked(threshold: int):
    """Spanning forest of the exact links within a group.  Documents of one
    component are joined already; where there are visitors, they meet the others
    only."""

    def go(group: pa.Table) -> Iterator[pa.RecordBatch]:
        if group.num_rows < 2:
            return
        group = group.sort_by([("visits", "descending"), ("uid", "ascending")])
        ids, visits, part = group["uid"].to_numpy(), group["visits"].to_numpy(zero_copy_only=False), group["part"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
        size = np.array([len(s) for s in sets])
        values, index, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        column = np.cumsum(count > 1) - 1
        shared = count[index] > 1
        common = _Common(owner[shared], column[index[shared]], len(sets), int((count > 1).sum()))
        union, a, b = _Union(len(ids)), [], []
        _, first, of = np.unique(part, return_index=True, return_inverse=True)
        for i, f in enumerate(first[of].tolist()):
            union.join(i, f)
        guests = int(visits.sum())
        for i in range(guests or len(ids) - 1):
            root = union.find(i)
            other = np.arange(max(i + 1, guests), len(ids))
            other = other[(size[other] * 100 >= threshold * size[i]) & (size[i] * 100 >= threshold * size[other])]
            other = other[[union.find(j) != root for j in other.tolist()]] if len(other) else other
            if not len(other):
                continue
            both = common.sizes(i, other)
            for j in other[100 * both >= threshold * (size[other] + size[i] - both)].tolist():
                if union.join(i, j):
                    a.append(ids[i])
                    b.append(ids[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return go


class _Links:
    """Exact links between the documents of each cluster."""

    def __init__(self, docs: DataFrame, reps: DataFrame, parts: int, width: int, threshold: int, repeated: bool) -> None:
        self.docs, self.reps, self.parts, self.width, self.threshold, self.repeated = docs, reps, parts, width, threshold, repeated

    def of(self, placed: DataFrame, groups: list[str]) -> DataFrame:
        """Links within groups, given (uid, part, visits) in these groups as rows
        of ``places``, an array of structs with the ``groups``."""
        names = ["uid", "part", *[f.name for f in placed.schema.fields if f.name not in ("uid", "part")]]
        keyed = placed.join(self.reps, "uid").select(*names, "doc_id", "text_hash")
        there = F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("t.text_hash") == F.col("p.text_hash"))
        few = small_enough(keyed, 50_000)
        rows = self.docs.alias("t").join((F.broadcast(keyed) if few else keyed).alias("p"), there).select(*(F.col(f"p.{n}") for n in names), "t.text")
        if self.repeated:  # equal rows under one id: one of them stands for them
            rows = rows.dropDuplicates(["uid"])
        places = rows.schema["places"].dataType.simpleString()
        width = self.width

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = shingle_sets(texts_of(batch.column("text")), width)
                yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("part"), batch.column("places"), pa.array([s.tobytes() for s in sets], pa.binary())], ["uid", "part", "places", "shingles"])

        full = rows.select("uid", "part", "places", "text").mapInArrow(go, f"uid bigint, part bigint, places {places}, shingles binary")
        dealt = full.select("uid", "part", "shingles", F.explode("places").alias("at")).select("uid", "part", "shingles", "at.*")
        return by_runs(dealt, self.parts, groups, ["uid"], _linked(self.threshold), "a bigint, b bigint")


def _place(cluster: Column, guest: Column, block: Column, visits: bool) -> Column:
    return F.struct(cluster.alias("cluster"), guest.cast("int").alias("guest"), block.cast("int").alias("block"), F.lit(visits).alias("visits"))


def _settled(links: _Links, clusters: DataFrame, tile: int) -> DataFrame:
    """(id, root) of documents that are linked, from candidate ``clusters``
    (uid, cluster)."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    number = F.xxhash64("uid", F.lit(5))
    placed = clusters.join(sizes, "cluster").withColumn("blocks", F.ceil(F.col("n") / tile)).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")))
    placed = written(placed.withColumn("pivot", (F.col("blocks") > 1) & (F.pmod(number, F.col("n")) < PIVOTS)), "clusters")
    c, zero = F.col("cluster"), F.lit(0)
    everywhere = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda b: _place(c, zero, b, False))
    first = placed.select("uid", F.col("uid").alias("part"), F.when(F.col("pivot"), everywhere).otherwise(F.array(_place(c, zero, F.col("block"), False))).alias("places"))
    roots = components(links.of(first, ["cluster", "guest", "block"]))

    wide = placed.where("blocks > 1").select("uid", "cluster", "blocks", "block")
    wide = wide.join(roots.select(F.col("id").alias("uid"), F.col("root").alias("part")), "uid", "left").withColumn("part", F.coalesce("part", "uid"))
    kinds = wide.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    open_ones = kinds.where("n > most").select("cluster", "main", F.ceil((F.col("n") - F.col("most")) / tile).alias("guests"))
    left = written(wide.join(open_ones, "cluster"), "open")
    if left.isEmpty():
        return roots
    guest = F.pmod(number, F.col("guests"))
    visits = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda b: _place(c, guest, b, True))
    home = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("guests") - 1), lambda g: _place(c, g, F.col("block"), False))
    second = left.select("uid", "part", F.when(F.col("part") == F.col("main"), home).otherwise(F.concat(visits, home)).alias("places"))
    more = links.of(second, ["cluster", "guest", "block"])
    return components(written(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more), "links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, threshold: int = THRESHOLD, tile: int = TILE, leaf: int = LEAF) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for each document."""
    parts = parts_for(docs.select(id_col, text_col), 10_000_000)
    signed = written(signatures(docs, id_col, text_col, width).withColumn("uid", F.monotonically_increasing_id()), "signatures")
    real = signed.where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    classes = written(real.groupBy("digest", "n_shingles").agg(first.alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    reps = written(real.join(classes.select(F.col("first.uid").alias("uid")), "uid").select("uid", "doc_id", "text_hash", "tokens"), "reps")
    repeated = not signed.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()

    some, joined = nodes(reps, leaf)
    loose = by_runs(some, parts, ["node"], ["uid"], _forest(threshold), "a bigint, b bigint")
    loose = components((loose if joined is None else loose.unionByName(joined)).distinct())
    clusters = loose.unionByName(loose.select(F.col("root").alias("id"), "root").distinct()).select(F.col("id").alias("uid"), F.col("root").alias("cluster"))
    links = _Links(_texts(docs, id_col, text_col), reps.select("uid", "doc_id", "text_hash"), parts, width, threshold, repeated)
    strict = _settled(links, clusters, tile)

    # The first row of each component, by id, and of each class that is linked or
    # has copies; other rows are their own.
    strict = strict.unionByName(strict.select(F.col("root").alias("id"), "root").distinct())
    rooted = classes.join(strict.select(F.col("id").alias("uid"), "root"), classes["first.uid"] == F.col("uid"), "left").select("digest", "n_shingles", "first", "n", "root")
    rooted = rooted.where("n > 1 OR root IS NOT NULL")
    linked = rooted.where("root IS NOT NULL")
    leaders = linked.groupBy("root").agg(F.min("first").alias("leader"))
    led = linked.join(leaders, "root").select("digest", "n_shingles", "leader").unionByName(rooted.where("root IS NULL").select("digest", "n_shingles", F.col("first").alias("leader")))
    copied = led.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
    salted = signed.select("uid", "doc_id", "text_hash", "n_shingles", "digest", F.pmod(F.xxhash64("uid"), F.lit(SALT)).alias("salt"))
    out = salted.join(copied, ["digest", "n_shingles", "salt"], "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("leader").isNull(), F.col("doc_id")).otherwise(F.col("leader.doc_id")).alias("component_id"), F.coalesce(F.col("uid") == F.col("leader.uid"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract ``op5``: Jaccard 0.85 on 5-word shingles of whole documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS id, doc_id AS reached FROM d UNION SELECT c.id, e.b FROM c JOIN e ON e.a = c.reached),
m AS (SELECT id, min(reached) AS component_id FROM c GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.id = d.doc_id
"""
