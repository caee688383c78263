"""Near-duplicate groups by min-max hashing.

A document's set is its distinct word shingles, hashed to 64 bits. Under each of
PERMUTATIONS permutations both the minimum and the maximum are kept, so half the
hash evaluations give a signature. Two permutations (four values) make a band;
sets that agree in a band are candidates. Equal sets are one node from the start.

Candidates are not all pairs of a bucket. First each node is paired with one
centre, the least node of most of its buckets, links are confirmed on full sets,
and components are taken.
Then, in buckets that still hold several components, the signatures and sizes of
members of different components are compared in blocks inside the tasks, and
the likeliest two partners of each member leave them to be confirmed, which join
most of what belongs together. Last, members that still have likely partners
travel with their sets, and all their pairs are confirmed inside the tasks. So
every pair of a bucket is in one component already, or far apart, or confirmed.

At similarity 0.8 a pair misses all 32 bands with probability (1 - 0.8**4)**32,
about 4e-8.

Defined results: a null or empty text, or one without words, has the empty set
and is linked with nothing; a text with fewer words than a shingle has its whole
word sequence as one shingle; rows that repeat an id are nodes of their own,
labelled with that id, and share the decision where only the id is joined; a null id counts as larger than any other; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.buffers import LOWER, blocks, mix, ngrams, row_of, string_buffer, word_hashes, words
from provena.llm.links import components
from provena.llm.ranges import HIGH, pack_sorted, unpack_sorted
from provena.operators.skew import salted_join
from provena.runtime import integer_id, materialise, ship

PERMUTATIONS, PER_BAND = 64, 2
BANDS = PERMUTATIONS // PER_BAND
#: Candidates whose signatures agree in a smaller share are no links: at a similarity
#: of 0.8 the share is below this with probability 1e-8 (128 values, deviation 0.035).
LIKELY = 0.6
#: Members of a bucket that one task compares; larger buckets are cut into pairs of blocks.
BLOCK = 2048

_SEEDS = mix(np.arange(2 * PERMUTATIONS, dtype=np.uint64), 23)


def sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within the row, and per-row offsets."""
    data = LOWER[data]
    starts, ends, at = words(data, offsets)
    h = word_hashes(data, starts, ends)
    row = row_of(at)
    count = np.diff(at)
    grams = ngrams(h, n, n)
    first = np.arange(len(grams))
    whole = first + n <= at[1:][row[: len(grams)]] if len(grams) else np.zeros(0, bool)
    value, owner = grams[whole], row[: len(grams)][whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([_sequence(h[at[r] : at[r + 1]]) for r in short], np.uint64)
        value, owner = np.concatenate([value, extra]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(offsets)))


def _sequence(h: np.ndarray) -> int:
    """A hash of a whole short word sequence."""
    return int(mix(ngrams(h, len(h), 99), len(h))[0])


def digests(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, 2): 128 bits that name each set; zero for the empty set."""
    out = np.zeros((len(at) - 1, 2), np.uint64)
    for k in range(2):
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(value, 31 + k), dtype=np.uint64)])
            out[:, k] = total[at[1:]] - total[at[:-1]]
    return out


def signatures(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 2 * PERMUTATIONS) 16-bit values and (rows, BANDS) band keys of non-empty rows; zero for others."""
    rows = np.flatnonzero(np.diff(at))
    small = np.zeros((len(at) - 1, 2 * PERMUTATIONS), np.uint16)
    keys = np.zeros((len(at) - 1, BANDS), np.uint64)
    if len(rows):
        begin = at[:-1][rows]
        with np.errstate(over="ignore"):
            for p in range(PERMUTATIONS):
                v = (value ^ _SEEDS[2 * p]) * (_SEEDS[2 * p + 1] | np.uint64(1))
                low, high = np.minimum.reduceat(v, begin), np.maximum.reduceat(v, begin)
                small[rows, 2 * p] = mix(low) >> np.uint64(48)
                small[rows, 2 * p + 1] = mix(high) >> np.uint64(48)
                band = p // PER_BAND
                keys[rows, band] = mix(keys[rows, band] ^ mix(low, 1 + band) ^ (mix(high, 101 + band) << np.uint64(1)), p)
    return small, keys


ROWS = "doc_id long, node binary, n_shingles long, signature binary, bands array<long>"


def _sign(n: int):
    def sign(batches):
        for batch in batches:
            data, offsets = string_buffer(batch.column(1))
            for first, last, d, o in blocks(data, offsets):
                value, at = sets(d, o, n)
                size = np.diff(at)
                small, keys = signatures(value, at)
                nodes = digests(value, at)
                full = size > 0
                flat = pa.array(keys[full].astype(np.uint64).view(np.int64).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, last - first), pa.array([x.tobytes() if f else None for x, f in zip(nodes, full, strict=True)], pa.binary()),
                    pa.array(size, pa.int64()), pa.array([x.tobytes() for x in small], pa.binary()), lists,
                ], names=["doc_id", "node", "n_shingles", "signature", "bands"])

    return sign


def _sets(n: int):
    def run(batches):
        for batch in batches:
            data, offsets = string_buffer(batch.column(0))
            for _, _, d, o in blocks(data, offsets):
                value, at = sets(d, o, n)
                nodes = digests(value, at)
                yield pa.RecordBatch.from_arrays([
                    pa.array([x.tobytes() for x in nodes], pa.binary()),
                    pa.array([pack_sorted(value[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                ], names=["node", "members"])

    return run


def _alike(batches):
    """Pairs whose signatures are not far apart."""
    for batch in batches:
        a = [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(2)]
        b = [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(3)]
        keep = [float(np.mean(x == y)) >= LIKELY for x, y in zip(a, b, strict=True)]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _is_link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets, as sorted arrays, are alike enough."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _linked(percent: int):
    def run(batches):
        for batch in batches:
            keep = [_is_link(unpack_sorted(x.as_py()), unpack_sorted(y.as_py()), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


class _Block:
    """Members of a bucket, or of two blocks of one: ``key`` is the bucket and the blocks, all rows share the band."""

    def __init__(self, key, table, percent: int):
        codes = {r: k for k, r in enumerate(sorted(set(table.column("root").to_pylist())))}
        root = np.array([codes[r] for r in table.column("root").to_pylist()], np.int64)
        self.order = np.argsort(root, kind="stable")
        self.root = root[self.order]
        column = lambda c: [table.column(c)[i].as_py() for i in self.order.tolist()]
        self.node = column("node")
        self.size = table.column("n_shingles").to_numpy()[self.order]
        self.own = table.column("own").to_numpy()[self.order]
        self.sig = np.array([np.frombuffer(x, np.uint16) for x in column("signature")]).reshape(len(self.node), -1)
        self.bands = np.array(column("bands"), np.int64).reshape(len(self.node), -1)
        self.band = table.column("band")[0].as_py()
        self.same_block = key[1].as_py() == key[2].as_py()
        self.percent = percent

    def likely(self):
        """For members outside the largest component: (member, partners in other components that sizes
        and signatures allow to be links, likeliest first). A pair comes up in the first bucket it shares, once."""
        root, size = self.root, self.size
        largest = np.bincount(root).argmax()
        for i in np.flatnonzero(root != largest).tolist():
            fits = (root > root[i]) | (root == largest)
            if not self.same_block:
                fits &= self.own != self.own[i]
            fits &= 100 * np.minimum(size, size[i]) >= self.percent * np.maximum(size, size[i])
            near = np.flatnonzero(fits)
            near = near[(self.bands[near] == self.bands[i]).argmax(axis=1) == self.band]
            if len(near):
                alike = (self.sig[near] == self.sig[i]).mean(axis=1)
                best = np.argsort(-alike, kind="stable")
                best = best[: int((alike >= LIKELY).sum())]
                if len(best):
                    yield i, near[best]


def _pairs(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.binary())], names=["a", "b"])


def _likeliest(percent: int, best: int):
    """The ``best`` likeliest partners of each member."""

    def run(key, table):
        block = _Block(key, table, percent)
        return _pairs([(block.node[i], block.node[j]) for i, near in block.likely() for j in near[:best].tolist()])

    return run


def _involved(percent: int):
    """Members that have a likely partner or are one."""

    def run(key, table):
        block = _Block(key, table, percent)
        used = np.zeros(len(block.node), bool)
        for i, near in block.likely():
            used[i] = True
            used[near] = True
        return table.take(pa.array(np.sort(block.order[used])))

    return run


def _confirmed(percent: int):
    """Links among all likely pairs of a block, on full sets; a pair that links found here have joined is passed over."""

    def run(key, table):
        block = _Block(key, table, percent)
        members = [unpack_sorted(table.column("members")[i].as_py()) for i in block.order.tolist()]
        up = {int(r): int(r) for r in set(block.root.tolist())}

        def top(r):
            while up[r] != r:
                r = up[r]
            return r

        found = []
        for i, near in block.likely():
            for j in near.tolist():
                x, y = top(int(block.root[i])), top(int(block.root[j]))
                if x != y and _is_link(members[i], members[j], percent):
                    up[x] = y
                    found.append((block.node[i], block.node[j]))
        return _pairs(found)

    return run


class _Graph:
    """Nodes, buckets and the links found so far."""

    def __init__(self, rows: DataFrame, docs: DataFrame, n: int, percent: int):
        self.percent = percent
        nodes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("label"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
        self.nodes = materialise(nodes, "nodes")
        buckets = self.nodes.select("node", F.posexplode("bands").alias("band", "value")).select("node", "band", F.xxhash64("band", "value").alias("key"))
        buckets = materialise(buckets, "bands")
        stats = buckets.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("other"), F.count(F.lit(1)).alias("size")).where("centre != other").drop("other")
        stats = materialise(stats, "buckets")
        # members of buckets with more than one node; both sides are plain tables, so a hot bucket's rows can be split at run time
        self.members = materialise(buckets.join(stats.hint("merge"), "key"), "members")
        wanted = self.members.select("node").distinct().join(self.nodes.select("node", "label"), "node").select(F.col("label").alias("__label")).distinct()
        ids = F.coalesce(docs["doc_id"], F.lit(HIGH))
        texts = docs.select(ids.alias("__label"), docs["text"].alias("text")).join(wanted, "__label", "left_semi")
        found = texts.select("text").mapInArrow(_sets(n), "node binary, members binary")
        self.sets = materialise(found.dropDuplicates(["node"]), "sets")

    def _attach(self, pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(table.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
        return pairs.select("a", "b", f"{column}_a", f"{column}_b")

    def confirm(self, pairs: DataFrame, sift: bool) -> DataFrame:
        """The candidate pairs that are links, by full sets."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
        if sift:
            pairs = self._attach(pairs, self.nodes, "signature").mapInArrow(_alike, "a binary, b binary")
        pairs = materialise(pairs, "pairs")
        return materialise(self._attach(pairs, self.sets, "members").mapInArrow(_linked(self.percent), "a binary, b binary"), "links")

    def _open(self, roots: DataFrame) -> DataFrame:
        """Members of buckets that hold several components, dealt to pairs of blocks."""
        own = self.members.select("key", "band", "node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        own = materialise(own, "rooted")
        mixed = materialise(own.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("key", F.lit(True).alias("open")), "mixed")
        own = own.join(mixed.hint("merge"), "key").join(self.nodes.select("node", "n_shingles", "signature", "bands"), "node")
        blocks_ = F.ceil(F.col("size") / BLOCK).cast("int")
        own = own.withColumn("own", F.pmod(F.xxhash64("node"), blocks_).cast("int"))
        dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), blocks_ - 1)))
        return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "band", "node", "root", "n_shingles", "signature", "bands", "own")

    def solve(self) -> DataFrame:
        """(node, component_id) of all nodes."""
        # each node meets the one centre it shares most buckets with: a pair a node
        shared = self.members.groupBy("node", "centre").agg(F.count(F.lit(1)).alias("n")).where("node != centre")
        nearest = shared.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "centre"))["centre"].alias("centre"))
        links = self.confirm(nearest.select(F.col("node").alias("a"), F.col("centre").alias("b")), True)
        roots = materialise(components(links), "roots")
        # the likeliest pairs first: they join most of what belongs together
        likely = self._open(roots).groupBy("key", "i", "j").applyInArrow(_likeliest(self.percent, 2), "a binary, b binary")
        links = links.unionAll(self.confirm(likely, False))
        roots = materialise(components(links), "roots")
        # all that is left is confirmed where it is found: members travel with their sets, pairs do not
        left = self._open(roots)
        involved = materialise(left.groupBy("key", "i", "j").applyInArrow(_involved(self.percent), left.schema), "involved")
        full = involved.join(self.sets, "node")
        found = materialise(full.groupBy("key", "i", "j").applyInArrow(_confirmed(self.percent), "a binary, b binary"), "found")
        roots = materialise(components(links.unionAll(found)), "roots")
        named = self.nodes.select("node", "label").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = materialise(named, "named")
        least = named.groupBy("root").agg(F.min("label").alias("component_id"))
        return salted_join(named, least, "root", "node").select("node", "component_id")


def group(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row, for shingles of ``n`` words."""
    ship(docs.sparkSession)
    docs = docs.select(integer_id(docs, id_col).alias("doc_id"), docs[text_col].alias("text"))
    ids = F.coalesce(F.col("doc_id"), F.lit(HIGH))
    rows = materialise(docs.select(ids.alias("doc_id"), "text").mapInArrow(_sign(n), ROWS), "signed")
    named = _Graph(rows, docs, n, percent).solve()
    own = rows.select("doc_id", "node", "n_shingles")
    named = salted_join(own.where("node IS NOT NULL"), named, "node", "doc_id").select("doc_id", "n_shingles", "component_id")
    alone = own.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    null = lambda c: F.when(F.col(c) != HIGH, F.col(c)).alias(c)
    return named.unionAll(alone).select(null("doc_id"), "n_shingles", null("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with the columns of ``docs``."""
    kept = group(docs, **kw).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents alike in their 2-word shingles."""
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=2)


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
