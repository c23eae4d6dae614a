"""Approximate nearest neighbours by inner product: a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample and sent to the executors (at most `LEAVES` leaves); every row
is indexed. A query walks the tree through a priority queue: the open node with the largest inner
product of query and centre is expanded next, so leaves come best first. How many leaves a query
visits is not guessed: for a bounded set of queries the exact neighbours among all rows are found,
and the visits are widened until the mean recall over them reaches the target.

Rows are stored by leaf, in cells of bounded size: a cell holds a run of neighbouring small leaves, or
a part of a large one, so a leaf that attracts a third of all rows is spread. A query is sent, once,
to each cell that holds leaves it visits, and is multiplied with the rows of these leaves alone; other
cells never see it. A cell that more queries visit than one task should take is copied for each part
of them, and only such a cell is. A cell sends on each query's best. Scores are recomputed row by row
in double precision.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mentionlake.llm._spark import materialise, with_small

K = 20
SAMPLE = 32_768
LEAVES = 4_096
BRANCH = 16
LEAF_ROWS = 32
#: Rows of a cell, on average at most.
BLOCK = 8_192
CALIBRATION = 256
RECALL = 0.94
#: Queries that meet one cell in one task, on average at most.
QUERIES = 16_384


def _dots(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed alone, so that equal vectors get equal scores."""
    return (x * q).sum(axis=-1)


class Tree:
    """Centres by node; node 0 is the root. Leaves are numbered so that those of a subtree follow each other."""

    def __init__(self, x: np.ndarray, leaves: int, branch: int = BRANCH, seed: int = 5):
        self.centres: list[np.ndarray] = [np.zeros(x.shape[1])]
        self.children: list[list[int]] = [[]]
        self.leaf_of: dict[int, int] = {}
        rng = np.random.default_rng(seed)
        self._split(0, x, leaves, branch, rng)
        self.matrix = np.stack(self.centres)

    def _split(self, node: int, x: np.ndarray, leaves: int, branch: int, rng) -> None:
        k = min(branch, leaves, len(x))
        label, centres = _kmeans(x, k, rng) if k > 1 else (None, None)
        if label is None or len(centres) < 2:
            self.leaf_of[node] = len(self.leaf_of)
            return
        for i, c in enumerate(centres):
            own = x[label == i]
            child = len(self.centres)
            self.centres.append(c)
            self.children.append([])
            self.children[node].append(child)
            self._split(child, own, max(1, round(leaves * len(own) / len(x))), branch, rng)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest child at every level."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node in self.leaf_of:
                out[rows] = self.leaf_of[node]
            elif len(rows):
                kids = self.children[node]
                c = self.matrix[kids]
                near = np.argmin((c * c).sum(1) - 2 * (x[rows] @ c.T), axis=1)
                todo += [(kid, rows[near == i]) for i, kid in enumerate(kids)]
        return out

    def visits(self, q: np.ndarray, most: int):
        """For each query its leaves, best bin first, `most` at most."""
        worth = q @ self.matrix.T
        for w in worth:
            heap, out = [(0.0, 0)], []
            while heap and len(out) < most:
                _, node = heapq.heappop(heap)
                if node in self.leaf_of:
                    out.append(self.leaf_of[node])
                else:
                    for c in self.children[node]:
                        heapq.heappush(heap, (-w[c], c))
            yield out


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 12):
    centres = x[rng.choice(len(x), k, replace=False)]
    label = None
    for _ in range(rounds):
        near = np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)
        if label is not None and (near == label).all():
            break
        label = near
        used = np.unique(label)
        label = np.searchsorted(used, label)
        centres = np.stack([x[label == i].mean(axis=0) for i in range(len(used))])
    return label, centres


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Rows that take part: not null, finite in every component, not zero."""
    e = F.col(embedding)
    fine = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    return vectors.filter(fine & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), e.cast("array<double>").alias("v"))


def _best(score: np.ndarray, k: int, floor: float = 1e-9) -> np.ndarray:
    """Columns that may be among the k best of a row: everything down to the k-th score, ties included."""
    if score.shape[0] <= k:
        return np.arange(score.shape[0])
    kth = np.partition(score, -k)[-k]
    return np.flatnonzero(score >= kth - floor * (1 + abs(kth)))


def _top(q: np.ndarray, qid: int, x: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int):
    """Ids, scores and rows of the k best of the rows `at`."""
    at = at[ids[at] != qid]
    s, i = _dots(x[at], q), ids[at]
    order = np.lexsort((i, -s))[:k]
    return i[order], s[order], at[order]


_FOUND = "query_id long, query long, vec_id long, score double, leaf long"
_FOUND_PA = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("leaf", pa.int64())])


def _emit(out: list) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * len(_FOUND_PA)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _FOUND_PA)], schema=_FOUND_PA)


def nearest_exact(rows: DataFrame, qid: np.ndarray, query: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """Exact neighbours of a bounded set of queries among all rows (vec_id, v, leaf), partial best per partition first."""

    def search(batches):
        best: dict[int, tuple] = {}
        for batch in batches:
            ids, x, leaf = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), BLOCK):
                xs, own = x[at : at + BLOCK], ids[at : at + BLOCK]
                score = q @ xs.T
                score[own[None, :] == qid[:, None]] = -np.inf
                for n in range(len(qid)):
                    i, s, at_row = _top(q[n], qid[n], xs, own, _best(score[n], k), k)
                    found = (i, s, leaf[at : at + BLOCK][at_row])
                    if n in best:
                        found = tuple(np.concatenate(x) for x in zip(best[n], found))
                        order = np.lexsort((found[0], -found[1]))[:k]
                        found = tuple(x[order] for x in found)
                    best[n] = found
        yield _emit([(np.full(len(i), qid[n]), np.full(len(i), query[n]), i, s, f) for n, (i, s, f) in best.items()])

    return _ranked(rows.select("vec_id", "v", "leaf").mapInArrow(search, _FOUND), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def meet(qid: np.ndarray, query: np.ndarray, q: np.ndarray, visits: list[np.ndarray], ids: np.ndarray, x: np.ndarray, leaf: np.ndarray, k: int) -> tuple[list, int]:
    """Each query's best rows of the leaves it visits, and how many products of a query and a row it took."""
    order = np.argsort(leaf, kind="stable")
    ids, x, leaf = ids[order], x[order], leaf[order]
    held, first = np.unique(leaf, return_index=True)
    ends = np.append(first[1:], len(leaf))
    out, products = [], 0
    for at in range(0, len(qid), 256):
        some = visits[at : at + 256]
        n = np.repeat(np.arange(len(some)), [len(v) for v in some])
        which = np.searchsorted(held, np.concatenate(some))
        here = which < len(held)
        here[here] = held[which[here]] == np.concatenate(some)[here]
        n, which = n[here], which[here]
        by = np.argsort(which, kind="stable")
        n, which = n[by], which[by]
        score = np.full((len(some), len(leaf)), -np.inf)
        cuts = np.flatnonzero(np.diff(which, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(which))):
            span = slice(first[which[a]], ends[which[a]])
            score[n[a:b], span] = q[at + n[a:b]] @ x[span].T
            products += (b - a) * (span.stop - span.start)
        score[ids[None, :] == qid[at : at + 256, None]] = -np.inf
        for m in range(len(some)):
            near = _best(score[m], k)
            i, s, row = _top(q[at + m], qid[at + m], x, ids, near[score[m][near] > -np.inf], k)
            out.append((np.full(len(i), qid[at + m]), np.full(len(i), query[at + m]), i, s, leaf[row]))
    return out, products


def cells(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First cell of each leaf and how many cells it has: small neighbouring leaves share a cell, a large one has several."""
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    cell, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > block:
            cell, held = cell + 1, 0
        first[i] = cell
        parts[i] = max(1, -(-n // block))
        if parts[i] > 1:
            cell, held = cell + int(parts[i]), 0
        else:
            held += n
    return first, parts


_NONE = "query_id long, rank int, vec_id long, score double"


def search(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    is_query: str = "vec_id % 20 = 0",
    k: int = K,
    sample: int = SAMPLE,
    leaves: int = LEAVES,
    leaf_rows: int = LEAF_ROWS,
    calibration: int = CALIBRATION,
    recall: float = RECALL,
    block: int = BLOCK,
    queries_at_once: int = QUERIES,
) -> DataFrame:
    """The k nearest found of each query row, by inner product in double precision: query_id, rank (from 1), vec_id, score.

    Null, empty, zero and non-finite vectors take no part, neither do rows without vec_id; of vectors
    of several lengths the commonest length (the longer, if equal) takes part. Equal scores go to the
    smaller vec_id. A row never finds its own vec_id. Rows that repeat a vec_id are candidates each;
    as queries, those with one vector ask once, those with several vectors ask for each, and each list
    has its own ranks. Other columns are not looked at, whatever their names. Empty tables give empty
    results.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, vec_id, embedding)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).first()
    if lengths is None:
        return spark.createDataFrame([], _NONE)
    rows = rows.filter(F.size("v") == lengths.d)
    total = lengths.n
    order = F.xxhash64("vec_id", F.lit(1))
    # the sample: the `sample` smallest hashes, found over the ids alone
    limit = rows.select(order.alias("h")).orderBy("h").limit(min(sample, total)).agg(F.max("h")).first()[0]
    some = rows.filter(order <= limit).orderBy(order).limit(sample).toArrow()
    x = _matrix(some.column("v"))
    tree = Tree(x, max(1, min(leaves, total // leaf_rows, len(x) // 8)))
    del some, x
    shared = spark.sparkContext.broadcast(tree)
    n_leaves = len(tree.leaf_of)

    def place(batches):
        for batch in batches:
            leaf = shared.value.assign(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf, pa.int64())], names=["vec_id", "v", "leaf"])

    placed = materialise(rows.mapInArrow(place, "vec_id long, v array<double>, leaf long"))
    # rows alike in id and vector are one query
    queries = placed.filter(F.expr(is_query)).select(F.col("vec_id").alias("query_id"), F.xxhash64("vec_id", "v").alias("query"), F.col("v").alias("q")).dropDuplicates(["query_id", "query"])

    # calibration: widen until the recall of exact neighbours is met
    asked = queries.orderBy(F.xxhash64("query", F.lit(2))).limit(calibration).toArrow()
    if not asked.num_rows:
        return spark.createDataFrame([], _NONE)
    qid, query, q = asked.column("query_id").to_numpy(), asked.column("query").to_numpy(), _matrix(asked.column("q"))
    truth = nearest_exact(placed, qid, query, q, k).select("query", "leaf").toPandas()  # at most calibration * k rows
    nth = {}
    for one, seen in zip(query.tolist(), tree.visits(q, n_leaves)):
        nth[one] = {leaf: i + 1 for i, leaf in enumerate(seen)}
    needed = np.sort(np.array([nth[a][b] for a, b in zip(truth["query"], truth.leaf)], dtype=np.int64))
    most = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else n_leaves

    sizes = np.zeros(n_leaves, dtype=np.int64)
    for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # at most `leaves` rows
        sizes[r.leaf] = r.n
    first, parts = cells(sizes, block)
    spread = spark.sparkContext.broadcast((first, parts))

    def walk(batches):
        """A row for each cell that holds leaves a query visits, with these leaves."""
        for batch in batches:
            (begin, some), ids, cell, seen = spread.value, [], [], []
            for i, those in enumerate(shared.value.visits(_matrix(batch.column(2)), most) if batch.num_rows else ()):
                those = np.sort(np.array(those, dtype=np.int64))
                n = some[those]
                leaf = np.repeat(those, n)
                at = begin[leaf] + np.arange(len(leaf)) - np.repeat(np.cumsum(n) - n, n)
                cuts = np.flatnonzero(np.diff(at, prepend=-1))
                ids.append(np.full(len(cuts), i))
                cell.append(at[cuts])
                seen += np.split(leaf, cuts[1:])
            take = pa.array(np.concatenate(ids) if ids else [], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), pa.array(np.concatenate(cell) if cell else [], pa.int64()), pa.array(seen, pa.list_(pa.int64()))], names=["query_id", "query", "q", "cell", "leaves"])

    def seat(batches):
        for batch in batches:
            begin, some = spread.value
            leaf, ids = batch.column(2).to_numpy(zero_copy_only=False), batch.column(0).to_numpy(zero_copy_only=False)
            n = some[leaf] if len(leaf) else leaf
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(begin[leaf] + (np.arange(len(leaf)) + ids) % n if len(leaf) else leaf, pa.int64())], names=["vec_id", "v", "leaf", "cell"])

    # walks cost more than their rows' bytes tell: tasks of a few hundred each
    wide = queries.repartition(max(1, min(10_000, -(-queries.count() // 512))))
    asking = materialise(wide.mapInArrow(walk, "query_id long, query long, q array<double>, cell long, leaves array<long>"))
    busy = materialise(asking.groupBy("cell").agg(F.ceil(F.count("*") / queries_at_once).alias("parts")))
    stored = materialise(placed.mapInArrow(seat, "vec_id long, v array<double>, leaf long, cell long"))
    stored = with_small(stored, busy, ["cell"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    asking = with_small(asking, busy.select("cell", F.col("parts").alias("of")), ["cell"]).withColumn("part", F.pmod(F.xxhash64("query", F.lit(3)), F.col("of"))).drop("of")

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], schema=_FOUND_PA)
        flat = left.column("leaves").combine_chunks()
        cut = np.cumsum(flat.value_lengths().to_numpy())[:-1]
        visits = np.split(flat.flatten().to_numpy(), cut)
        found, _ = meet(left.column("query_id").to_numpy(), left.column("query").to_numpy(), _matrix(left.column("q")), visits, right.column("vec_id").to_numpy(), _matrix(right.column("v")), right.column("leaf").to_numpy(), k)
        return pa.Table.from_batches([_emit(found)])

    found = asking.groupBy("cell", "part").cogroup(stored.groupBy("cell", "part")).applyInArrow(join, _FOUND)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
