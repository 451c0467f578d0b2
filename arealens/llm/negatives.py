"""Hard negatives by a multiway hyperplane tree with distance ranges between siblings.

Every inner node of the tree holds a few split points; a row goes to the nearest one. For each
split point and each sibling subtree the node keeps the least and greatest distance from the
point to the rows below. A query asks for rows whose score lies in a window, which is an
annulus around it: siblings whose ranges do not meet the annulus are left out, and the leaves that
remain are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Split points of a node, and rows a leaf should hold.
FANOUT, LEAF = 16, 2048
#: Rows the split points are drawn from (about, by hash share), and numbers in them at most.
SAMPLE, CELLS = 16384, 1 << 21
#: Rows and queries that meet in one task.
PIECE, BLOCK = 16384, 8192
#: Queries multiplied at once inside a task, visits of queries handed on at once, and leaves found at once.
QUERIES, VISITS, ROUTES = 256, 8192, 1 << 18
LEAST, MOST = -(1 << 62), 1 << 62


def _matrix(values: pa.Array, dim: int, kind: type = np.float64) -> np.ndarray:
    """Rows of a list column; shorter ones are filled up with zeros."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), kind)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (rows**2).sum(1)[:, None] + (points**2).sum(1) - 2 * rows @ points.T
    return np.sqrt(np.maximum(squares, 0))


class Tree:
    """Split points by node, children (node, or leaf as -1 - leaf), and the ranges once known."""

    def __init__(self, sample: np.ndarray, leaf: int, fanout: int = FANOUT):
        self.points: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.dim = sample.shape[1]
        self.root = self._grow(sample, max(1, leaf), fanout)
        first = np.cumsum([0] + [(len(p) + 1) * len(p) for p in self.points])
        self.first, self.slots = first, int(first[-1])
        self.low, self.high = np.full(self.slots, np.inf), np.full(self.slots, -np.inf)

    def _grow(self, rows: np.ndarray, leaf: int, fanout: int) -> int:
        if len(rows) > leaf:
            chosen, away = [0], _distances(rows, rows[:1])[:, 0]
            while len(chosen) < fanout and away.max() > 0:  # the farthest from those before
                chosen.append(int(away.argmax()))
                away = np.minimum(away, _distances(rows, rows[chosen[-1:]])[:, 0])
                away[chosen] = 0
            near = _distances(rows, rows[chosen]).argmin(1)
            if np.bincount(near, minlength=len(chosen)).max() < len(rows):
                node = len(self.points)
                self.points.append(rows[chosen])
                self.children.append([])
                self.children[node] = [self._grow(rows[near == j], leaf, fanout) for j in range(len(chosen))]
                return node
        self.leaves += 1
        self.lots = np.arange(self.leaves)
        return -self.leaves

    def gather(self, sizes: np.ndarray) -> None:
        """Lots of leaves next to each other, of PIECE rows at most unless one leaf has more; ``sizes`` by leaf."""
        lot = filled = 0
        for leaf, n in enumerate(sizes.tolist()):
            if filled and filled + n > PIECE:
                lot, filled = lot + 1, 0
            self.lots[leaf], filled = lot, filled + n

    def place(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Leaf of every row; widens the ranges ``low`` and ``high`` by them.

        The ranges of a node are one row per split point, and one for the distance from zero.
        """
        out = np.full(len(rows), max(0, -1 - self.root))
        todo = [(self.root, np.arange(len(rows)))] if self.root >= 0 and len(rows) else []
        while todo:
            node, some = todo.pop()
            k, at = len(self.points[node]), self.first[node]
            away = _distances(rows[some], np.vstack([self.points[node], np.zeros(self.dim)]))
            near = away[:, :k].argmin(1)
            for j, child in enumerate(self.children[node]):
                mine = near == j
                if mine.any():
                    slots = at + np.arange(k + 1) * k + j
                    low[slots] = np.minimum(low[slots], away[mine].min(0))
                    high[slots] = np.maximum(high[slots], away[mine].max(0))
                    if child >= 0:
                        todo.append((child, some[mine]))
                    else:
                        out[some[mine]] = -1 - child
        return out

    def home(self, queries: np.ndarray) -> np.ndarray:
        return self.place(queries, np.full(self.slots, np.inf), np.full(self.slots, -np.inf))

    def route(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of every leaf that may hold a row with a score from ``low`` to ``high``."""
        if self.root < 0:
            return np.arange(len(queries)), np.zeros(len(queries), np.int64)
        own = (queries**2).sum(1)
        found, todo = [], [(self.root, np.arange(len(queries)))]
        while todo:
            node, some = todo.pop()
            k, at = len(self.points[node]), self.first[node]
            shape = slice(at, at + (k + 1) * k)
            least, most = self.low[shape].reshape(k + 1, k), self.high[shape].reshape(k + 1, k)
            filled = np.isfinite(least[k])
            size_low, size_high = np.where(filled, least[k], 0) ** 2, np.where(filled, most[k], 0) ** 2
            # score = (|query|^2 + |row|^2 - distance^2) / 2
            near = np.sqrt(np.maximum(own[some, None] + size_low - 2 * high[some, None], 0))
            far = np.sqrt(np.maximum(own[some, None] + size_high - 2 * low[some, None], 0))
            slack = 1e-6 * (1 + np.sqrt(own[some, None] + size_high))
            keep = np.broadcast_to(filled, near.shape).copy()
            away = _distances(queries[some], np.vstack([self.points[node], np.zeros(self.dim)]))
            for i in range(k + 1):
                d = away[:, i, None]
                keep &= (d - most[i] <= far + slack) & (least[i] - d <= far + slack) & (d + most[i] >= near - slack)
            for j, child in enumerate(self.children[node]):
                some_j = some[keep[:, j]]
                if len(some_j):
                    if child >= 0:
                        todo.append((child, some_j))
                    else:
                        found.append((some_j, np.full(len(some_j), -1 - child)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))


def _placed(tree: Tree):
    """Tasks: (id, label, vector, leaf) of every row, then the task's ranges by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(tree.slots, np.inf), np.full(tree.slots, -np.inf)
        like = None
        for like in batches:
            leaf = tree.place(_matrix(like.column("vector"), tree.dim), low, high)
            none = [pa.nulls(like.num_rows, t) for t in (pa.int32(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*like.columns, pa.array(leaf.astype(np.int32)), *none], [*like.schema.names, "leaf", "slot", "low", "high"])
        at = np.flatnonzero(np.isfinite(low))
        if len(at):
            none = [pa.nulls(len(at), t) for t in (*like.schema.types, pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [*none, pa.array(at.astype(np.int32)), pa.array(low[at]), pa.array(high[at])], [*like.schema.names, "leaf", "slot", "low", "high"]
            )

    return run


def _routed(tree: Tree, home: bool):
    """Tasks: queries, once for each lot of leaves they visit: that of their own leaf, or all others in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_once = max(1, ROUTES // max(1, tree.leaves))
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                vectors = _matrix(batch.column("vector"), tree.dim)
                own = tree.lots[tree.home(vectors)]
                query, lot = np.arange(batch.num_rows), own
                if not home:
                    windows = batch.column("windows")
                    owner = np.repeat(np.arange(batch.num_rows), windows.value_lengths().to_numpy(zero_copy_only=False))
                    flat = windows.flatten()
                    bounds = [flat.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("low", "high")]
                    window, leaf = tree.route(vectors[owner], *bounds)
                    both = np.unique(owner[window] * np.int64(max(1, tree.leaves)) + tree.lots[leaf])
                    query, lot = np.divmod(both, max(1, tree.leaves))
                    query, lot = query[lot != own[query]], lot[lot != own[query]]
                for i in range(0, len(query), VISITS):
                    rows = batch.take(pa.array(query[i : i + VISITS]))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lot[i : i + VISITS].astype(np.int32))], [*rows.schema.names, "lot"])

    return run


def _best(dim: int, whole: bool, same: bool, k: int):
    """Tasks: for each window of each query the first k rows of the piece that lie in it."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        rows, queries = (table.filter(pa.array(side == s)) for s in (0, 1))
        rows = rows.sort_by("id")
        kind = np.int64 if whole else np.float64  # doubles are exact here, and faster
        x, ids, labels = _matrix(rows.column("vector"), dim, kind), rows.column("id").to_numpy(), rows.column("label").to_numpy()
        a, own, mine = _matrix(queries.column("vector"), dim, kind), queries.column("id").to_numpy(), queries.column("label").to_numpy()
        windows = queries.column("windows").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(windows.value_lengths().to_numpy(zero_copy_only=False))])
        key, low, high = (windows.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("key", "low", "high"))
        found = []
        for label in np.unique(mine):
            part = np.flatnonzero((labels == label) == same)
            asking = np.flatnonzero(mine == label)
            for start in range(0, len(asking) if len(part) else 0, QUERIES):
                chosen = asking[start : start + QUERIES]
                for q, scores in zip(chosen.tolist(), a[chosen] @ x[part].T):
                    for w in range(ends[q], ends[q + 1]):
                        c = np.flatnonzero((scores >= low[w]) & (scores <= high[w]))
                        c = c[ids[part[c]] != own[q]]
                        if len(c) > k:
                            c = c[scores[c] >= np.partition(scores[c], len(c) - k)[len(c) - k]]
                        c = c[np.argsort(-scores[c], kind="stable")[:k]]  # rows are in the order of ids
                        found.append((np.full(len(c), own[q]), np.full(len(c), key[w]), ids[part[c]], scores[c].astype(np.int64)))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("anchor", "key", "other", "score"), (c.astype(np.int64) for c in columns))))

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _visit(queries: DataFrame, rows: DataFrame, sizes: DataFrame, tree: Tree, home: bool, whole: bool, same: bool, k: int) -> DataFrame:
    """(anchor, key, other, score): the first k rows of every window, per piece of a lot visited.

    A lot is cut to pieces of rows and blocks of queries; every piece meets every block in a task.
    Queries are spread over all tasks before they are routed, and handed on a few visits at a time.
    """
    kind, spark = queries.schema, queries.sparkSession
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    routed = queries.repartition(tasks, "id").mapInArrow(_routed(tree, home), f"{names}, lot int")
    routed = stored(routed, "negatives-visits")
    cuts = routed.groupBy("lot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).join(sizes, "lot")
    cuts = stored(cuts, "negatives-cuts")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    windows = queries.schema["windows"].dataType.simpleString()
    left = rows.join(cuts, "lot").select(
        "lot", deal("pieces").alias("piece"), spread("blocks").alias("block"), F.lit(0).alias("side"), "id", "label", "vector", F.lit(None).cast(windows).alias("windows")
    )
    right = routed.join(cuts, "lot").select(
        "lot", spread("pieces").alias("piece"), deal("blocks").alias("block"), F.lit(1).alias("side"), "id", "label", "vector", "windows"
    )
    met = left.unionByName(right).groupBy("lot", "piece", "block")
    return met.applyInArrow(_best(tree.dim, whole, same, k), "anchor long, key long, other long, score long")


def _search(queries: DataFrame, rows: DataFrame, sizes: DataFrame, tree: Tree, whole: bool, same: bool, k: int) -> DataFrame:
    """(anchor, key, other, score, rank): the first k rows of every window of every query, exactly.

    The lot of the query's own leaf first; a window that is full there narrows to the scores that can
    still enter it before the others are chosen.
    """
    near = stored(_first(_visit(queries, rows, sizes, tree, True, whole, same, k), k), "negatives-near")
    full = near.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("key", "score"))).alias("full"))
    tight = F.transform("windows", lambda w: w.withField("low", F.greatest(w["low"], F.coalesce(F.try_element_at("full", w["key"]), w["low"]))))
    narrowed = queries.join(full.withColumnRenamed("anchor", "id"), "id", "left").withColumn("windows", tight).drop("full")
    far = _visit(narrowed, rows, sizes, tree, False, whole, same, k)
    return stored(_first(near.drop("rank").unionByName(far), k), "negatives-found")


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    leaf: int = LEAF,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor.

    Components become ``floor(scale * x)``; a score is the inner product of two rows, ties go to
    the smaller id. An anchor's positives are its first ``positives`` other rows of its label.
    For each of them come the first ``negatives`` rows of other labels whose score lies between
    ``low`` and ``high`` per cent of the positive's.

    The tree's split points come from a sample of about ``SAMPLE`` rows; every row is placed and
    every range covers all rows. Leaves hold about ``leaf`` rows. A query goes once to each lot of
    leaves next to each other; larger leaves are searched in pieces, so that they may be of any
    size. Nothing is approximate.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Of rows
    that share an id the one with the smallest label, then vector, takes part. Shorter vectors count as
    filled up with zeros. Ids are whole numbers; a hundred times a score must fit into 64 bits, else the job stops. An
    empty table gives none. Other columns are ignored.
    """
    number = F.col(vector_col).cast("array<double>")
    sound = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.transform(number, lambda x: F.floor(x * scale)).alias("vector"), anchor.alias("anchor"),
        F.coalesce(sound, F.lit(False)).alias("sound"),
    )
    rows = rows.where("sound and id is not null and label is not null")
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("r")).select("id", "r.label", "r.vector", "r.anchor")
    rows = stored(rows, "negatives-rows")
    largest = F.greatest(F.array_max("vector"), -F.array_min("vector"))
    n, dim, most = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(largest)).first()
    dim, most = max(1, dim or 1), most or 0
    if 100 * dim * int(most) ** 2 >= 1 << 63:
        raise ValueError("scores would not fit into 64 bits")
    whole = dim * int(most) ** 2 >= 1 << 53

    wanted = min(SAMPLE, CELLS // dim)
    share = min(1.0, wanted / max(1, n))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("id", "vector").toArrow().sort_by("id")
    tree = Tree(_matrix(sample.column("vector"), dim), max(8, int(leaf * share)))
    kind = rows.schema["label"].dataType.simpleString()
    names = f"id long, label {kind}, vector array<bigint>, anchor boolean"
    placed = stored(rows.mapInArrow(_placed(tree), f"{names}, leaf int, slot int, low double, high double"), "negatives-placed")
    for r in placed.where("slot is not null").groupBy("slot").agg(F.min("low"), F.max("high")).toLocalIterator():  # a fixed number per node
        tree.low[r[0]], tree.high[r[0]] = r[1], r[2]
    filled = np.zeros(max(1, tree.leaves), np.int64)
    for r in placed.where("slot is null").groupBy("leaf").count().toLocalIterator():  # one row per leaf
        filled[r[0]] = r[1]
    tree.gather(filled)
    lots = F.split(F.lit(",".join(map(str, tree.lots))), ",").cast("array<int>")  # a constant of the plan
    rows = placed.where("slot is null").select("id", "label", "vector", F.get(lots, F.col("leaf")).alias("lot"))
    sizes = stored(rows.groupBy("lot").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces")), "negatives-lots")

    window = lambda key, a, b: F.struct(key.cast("long").alias("key"), a.cast("long").alias("low"), b.cast("long").alias("high"))
    anchors = placed.where("slot is null and anchor").select("id", "label", "vector")
    asking = anchors.withColumn("windows", F.array(window(F.lit(0), F.lit(LEAST), F.lit(MOST))))
    found = _search(asking, rows, sizes, tree, whole, True, positives)
    found = found.select(F.col("anchor").alias("id"), F.col("other").alias("positive"), F.col("score").alias("positive_score"))

    bound = lambda c: F.expr(f"({c} - pmod({c}, 100)) div 100")
    edges = found.withColumn("_low", -F.col("positive_score") * low).withColumn("_high", F.col("positive_score") * high)
    edges = edges.where("_high >= -_low").withColumn("_low", -bound("_low")).withColumn("_high", bound("_high"))
    asking = edges.groupBy("id").agg(F.collect_list(window(F.col("positive"), F.col("_low"), F.col("_high"))).alias("windows"))
    mined = _search(anchors.join(asking, "id"), rows, sizes, tree, whole, False, negatives)
    mined = mined.select(F.col("anchor").alias("id"), F.col("key").alias("positive"), "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    return mined.join(found, ["id", "positive"]).select(
        F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", "negative_id", "positive_score", "negative_score"
    )
