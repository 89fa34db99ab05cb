"""Work by intervention: each one's cone, the arcs it reaches, is handed to a function in a task.

Graphs whose arcs are few (checked) are broadcast as arrays, and cones are cut
out of them in the tasks.  Larger graphs fall into pieces that no arc joins;
those that fit in a task are handed to tasks whole, with the interventions on
them.  Cones within larger pieces are found by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.functions.storage import fixpoint, store

#: Arcs up to which a graph is broadcast: 24 bytes each.
MAX_ARCS = 2_000_000
#: Arcs up to which one intervention's cone is handed to a task.
MAX_CONE = 2_000_000
#: Nodes whose arcs a worker keeps at hand.
KNOWN = 100_000
#: Arcs that a task holds to contract them, and arcs of small pieces that share a task.
BLOCK, SHARED = 2_000_000, 100_000


class Compact:
    """A signed graph as arrays, arcs in order of their source."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, m: np.ndarray) -> None:
        self.names, code = np.unique(np.concatenate([src, dst]), return_inverse=True)
        s, d = code[: len(src)], code[len(src) :]
        order = np.lexsort((d, s))
        self.src, self.dst, self.m = s[order].astype(np.int32), d[order].astype(np.int32), np.asarray(m)[order].astype(np.int8)
        self.start = np.searchsorted(self.src, np.arange(len(self.names) + 1))
        self.known: dict = {}

    @staticmethod
    def of(arcs: DataFrame, src: str = "src", dst: str = "dst") -> Compact:
        t = arcs.select(src, dst, "m").toPandas()
        return Compact(t[src].to_numpy(), t[dst].to_numpy(), t["m"].to_numpy())

    def code(self, names: list) -> np.ndarray:
        """Codes of those names that the graph has."""
        if not len(self.names) or not names:
            return np.zeros(0, np.int64)
        at, known = self.place(names)
        return at[known]

    def place(self, names: list) -> tuple[np.ndarray, np.ndarray]:
        """A code for each name, and whether the graph has it."""
        x = np.array(names, dtype=self.names.dtype if self.names.dtype != object else object)
        at = np.minimum(np.searchsorted(self.names, x), len(self.names) - 1)
        return at, self.names[at] == x

    def out(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arcs out of some nodes, and for each arc the position of its source among them."""
        n = self.start[at + 1] - self.start[at]
        ends = np.cumsum(n)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - ends + n, n), np.repeat(np.arange(len(at)), n)

    def reach(self, clamps: dict) -> tuple[np.ndarray, np.ndarray]:
        """Codes and masks of what the clamps reach on the signed double cover, arcs into clamps cut, self-loops without effect."""
        mask = np.zeros(len(self.names), np.int8)
        cut = np.zeros(len(self.names), bool)
        if len(self.names) and clamps:
            at, known = self.place(list(clamps))
            cut[at[known]] = True
            mask[at[known]] = np.array(list(clamps.values()), np.int8)[known]
        front = np.flatnonzero(mask)
        new = mask.copy()
        while len(front):
            arc, who = self.out(front)
            a, m, d = new[front][who], self.m[arc], self.dst[arc]
            got = np.where(m == 1, a, np.where(m == 2, (a & 1) << 1 | a >> 1, 3)).astype(np.int8)
            ok = ~cut[d] & (d != front[who])
            grown = mask.copy()
            np.bitwise_or.at(grown, d[ok], got[ok])
            new = grown & ~mask
            mask, front = grown, np.flatnonzero(new)
        at = np.flatnonzero(mask)
        return at, mask[at]

    def arcs_of(self, name) -> list[tuple]:
        """The arcs (src, dst, m) out of a node; what was asked for lately is kept."""
        got = self.known.get(name)
        if got is None:
            at = int(np.searchsorted(self.names, name))
            got = []
            if at < len(self.names) and self.names[at] == name:
                s = slice(self.start[at], self.start[at + 1])
                got = [(name, d, m) for d, m in zip(self.names[self.dst[s]].tolist(), self.m[s].tolist())]
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[name] = got
        return got

    def cone(self, clamps: dict, also: Compact | None = None) -> tuple[list[tuple], list[tuple]]:
        """The arcs (src, dst, m) out of what the clamps reach, and those of ``also``, over which they reach further."""
        seen, own, more, todo = set(clamps), [], [], list(clamps)
        while todo:
            n = todo.pop()
            out = [a for a in self.arcs_of(n) if a[1] not in clamps]
            own += out
            if also is not None:
                up = also.arcs_of(n)
                more += up
                out = out + up
            for _, d, _ in out:
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        return own, more


def small(arcs: DataFrame, max_arcs: int = MAX_ARCS) -> bool:
    """Whether a graph's arcs are few enough to broadcast; counts no further than that."""
    return arcs.limit(max_arcs + 1).count() <= max_arcs


def clamped(interventions: DataFrame) -> DataFrame:
    """(iv_id, node, mask), repeated clamps of a node summed."""
    return interventions.groupBy("iv_id", "node").agg(F.bit_or("mask").cast("int").alias("mask"))


def _tasks(spark: SparkSession, n: int, each: int) -> int:
    """Tasks for ``n`` pieces of work, ``each`` to a task, but no fewer tasks than cores while there are pieces."""
    return max(1, min(n, max(-(-n // each), 2 * spark.sparkContext.defaultParallelism)))


def _spread(df: DataFrame, rows_per_task: int = 256) -> DataFrame:
    """Interventions dealt to tasks by a hash, many small ones to a task; they are few bytes and much work, so their tasks are not put together again."""
    tasks = _tasks(df.sparkSession, df.select("iv_id").distinct().count(), rows_per_task)
    return df.withColumn("__task", F.pmod(F.xxhash64("iv_id"), F.lit(tasks))).repartition(tasks, "__task")


def by_broadcast(arcs: DataFrame, interventions: DataFrame, run: Callable[[Compact, Compact | None, dict], list[tuple]], schema: str, also: DataFrame | None = None) -> DataFrame:
    """Rows of ``run(graph, also, clamps)`` for each intervention; ``schema`` has (iv_id, columns of the rows)."""
    names = [c.split()[0] for c in schema.split(", ")]
    shared = arcs.sparkSession.sparkContext.broadcast((Compact.of(arcs), Compact.of(also, "micro", "macro") if also is not None else None))

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        graph, more = shared.value
        rows = [(iv, *row) for iv, g in pdf.groupby("iv_id", dropna=False) for row in run(graph, more, dict(zip(g.node.tolist(), g["mask"].tolist())))]
        return pd.DataFrame(rows, columns=names)

    return _spread(clamped(interventions)).groupBy("__task").applyInPandas(task, schema)


def cones(arcs: DataFrame, interventions: DataFrame, also: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(iv_id, src, dst, m) out of what each intervention reaches, by joins; arcs into clamped nodes are cut; and the same of ``also`` (micro, macro, m)."""
    hops = arcs.select("src", "dst", F.lit(True).alias("causal"))
    if also is not None:
        hops = hops.unionByName(also.select(F.col("micro").alias("src"), F.col("macro").alias("dst"), F.lit(False).alias("causal")))
    hops = store(hops.distinct(), "hops")
    cut = interventions.select("iv_id", F.col("node").alias("dst"), F.lit(True).alias("cut")).distinct()

    def step(front: DataFrame) -> DataFrame:
        out = front.join(hops, front.node == hops.src).join(cut, ["iv_id", "dst"], "left")
        return out.where("not causal or cut is null").select("iv_id", F.col("dst").alias("node"))

    reach = fixpoint(interventions.select("iv_id", "node"), step, "cones")
    own = arcs.select("src", "dst", "m").join(reach.withColumnRenamed("node", "src"), "src").join(cut, ["iv_id", "dst"], "left_anti").select("iv_id", "src", "dst", "m")
    more = also.select("micro", "macro", "m").join(reach.withColumnRenamed("node", "micro"), "micro").select("iv_id", "micro", "macro", "m") if also is not None else None
    return store(own, "cone"), store(more, "cone") if more is not None else None


def by_cone(own: DataFrame, interventions: DataFrame, run: Callable[[list[tuple], list[tuple], dict], list[tuple]], schema: str, more: DataFrame | None = None) -> DataFrame:
    """Rows of ``run(arcs, also, clamps)`` for each intervention, whose cone is brought together in a task."""
    names = [c.split()[0] for c in schema.split(", ")]
    rows = own.select("iv_id", F.lit(0).alias("kind"), "src", "dst", "m")
    rows = rows.unionByName(clamped(interventions).select("iv_id", F.lit(2).alias("kind"), F.col("node").alias("src"), F.col("node").alias("dst"), F.col("mask").alias("m")))
    if more is not None:
        rows = rows.unionByName(more.select("iv_id", F.lit(1).alias("kind"), F.col("micro").alias("src"), F.col("macro").alias("dst"), "m"))

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for iv, g in pdf.groupby("iv_id", dropna=False):
            kinds = [list(zip(p.src.tolist(), p.dst.tolist(), p.m.tolist())) for p in (g[g.kind == k] for k in (0, 1, 2))]
            out += [(iv, *row) for row in run(kinds[0], kinds[1], {n: m for n, _, m in kinds[2]})]
        return pd.DataFrame(out, columns=names)

    # cones share tasks, but a large one, of bounded size, has its own
    sizes = rows.groupBy("iv_id").agg(F.count("*").alias("n"))
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(_tasks(own.sparkSession, n, 256), total // 100_000)
    placed = rows.join(sizes, "iv_id").withColumn("__task", F.when(F.col("n") > 100_000, F.concat(F.lit("own:"), F.col("iv_id").cast("string"))).otherwise(F.pmod(F.xxhash64("iv_id"), F.lit(tasks)).cast("string"))).drop("n")
    return placed.repartition(tasks, "__task").groupBy("__task").applyInPandas(task, schema)


# --- pieces -----------------------------------------------------------------------------


def contracted(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """For each pair the least name of those that pairs join with it."""
    names, code = np.unique(np.concatenate([src, dst]), return_inverse=True)
    s, d = code[: len(src)], code[len(src) :]
    root = np.arange(len(names))
    while True:
        a, b = root[s], root[d]
        if (a == b).all():
            return names[a]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Arcs with the root of what joins them, among no more than a block of them."""

    def done(block: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(block)
        return pdf.assign(piece=contracted(pdf.src.to_numpy(), pdf.dst.to_numpy()))

    block: list[pd.DataFrame] = []
    for pdf in frames:
        block.append(pdf)
        if sum(map(len, block)) >= BLOCK:
            yield done(block)
            block = []
    if any(map(len, block)):
        yield done(block)


def _roots(links: DataFrame) -> DataFrame:
    """(piece, root): the least node that each node of the links (piece, least) is joined with."""
    if small(links):
        got = links.select(F.col("piece").alias("src"), F.col("least").alias("dst")).coalesce(1).mapInPandas(_contract, f"src {dict(links.dtypes)['piece']}, dst {dict(links.dtypes)['piece']}, piece {dict(links.dtypes)['piece']}")
        return got.select(F.col("src").alias("piece"), F.col("piece").alias("root")).union(got.select("dst", "piece")).distinct()
    # stars in turn: each node's larger neighbours, then its smaller ones, go over to the least of them
    cur, mark = links.select(F.col("piece").alias("u"), F.col("least").alias("v")), None
    while True:
        both = cur.union(cur.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        up = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).where("u <> v").distinct()
        cur = store(down, "stars")
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return cur.select(F.col("u").alias("piece"), F.col("v").alias("root"))
        mark = now


def pieces(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``arcs`` (src, dst, ...) with ``piece``, the least node that arcs of either direction join with them, and (node, piece).

    Tasks contract the arcs they read; what is left to join are the pieces of
    different tasks that share a node.
    """
    arcs = arcs.where("src is not null and dst is not null")
    kind = dict(arcs.dtypes)["src"]
    cut = store(arcs.mapInPandas(_contract, ", ".join(f"{n} {t}" for n, t in arcs.dtypes) + f", piece {kind}"), "pieces")
    nodes = store(cut.select(F.col("src").alias("node"), "piece").union(cut.select("dst", "piece")).distinct(), "piece-nodes")
    shared = nodes.groupBy("node").agg(F.min("piece").alias("least"), F.max("piece").alias("most")).where("least <> most").select("node", "least")
    links = store(nodes.join(shared, "node").where("piece <> least").select("piece", "least").distinct(), "piece-links")
    if links.isEmpty():
        return cut, nodes
    roots = store(_roots(links), "piece-roots")
    whole = lambda df, *cols: df.join(roots, "piece", "left").select(*cols, F.coalesce("root", "piece").alias("piece"))
    return store(whole(cut, *arcs.columns), "pieces"), store(whole(nodes, "node").distinct(), "piece-nodes")


def _dealt(df: DataFrame, tasks: int) -> DataFrame:
    """Rows of pieces (piece, n, chunk) dealt to tasks: large ones have their own, small ones share them by a hash."""
    own = F.concat_ws(":", F.lit("own"), F.col("piece").cast("string"), F.col("chunk").cast("string"))
    return df.withColumn("__task", F.when(F.col("n") > SHARED, own).otherwise(F.pmod(F.xxhash64("piece"), F.lit(tasks)).cast("string"))).drop("n", "chunk").repartition(tasks, "__task")


def few(interventions: DataFrame, most: int = 256) -> bool:
    """Whether interventions are so few that each may go over the whole of a broadcast graph."""
    return small(interventions, most)


def by_piece(arcs: DataFrame, interventions: DataFrame, run: Callable[[Compact, Compact | None, dict], list[tuple]], schema: str, max_piece: int = MAX_CONE, merged: bool = True, each: int = 4 * SHARED) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Rows of ``run(graph, None, clamps)`` for each intervention on pieces of up to ``max_piece`` arcs, and what is left: arcs and interventions of larger pieces, or None.

    An intervention acts within its pieces alone, so those on different pieces
    are run at once, as one with the clamps of all (not with ``merged=False``);
    a row begins with a node, which tells whose it is.  A task has up to
    ``each`` arcs times interventions of a large piece.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    cut, nodes = pieces(arcs)
    marks = store(clamped(interventions).join(nodes, "node", "left").withColumn("piece", F.coalesce("piece", "node")), "piece-marks")
    load = marks.groupBy("piece").agg(F.count_distinct(F.struct("iv_id")).alias("ivs")).join(cut.groupBy("piece").agg(F.count("*").alias("n")), "piece", "left")
    load = store(load.select("piece", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > SHARED, F.least("ivs", F.ceil(F.col("n") * F.col("ivs") / each))).otherwise(1).cast("int").alias("chunks")), "piece-load")
    far_arcs = far = None
    if not (large := load.where(F.col("n") > max_piece).select("piece")).isEmpty():
        far_arcs, far = store(cut.join(large, "piece", "left_semi").drop("piece"), "far-arcs"), store(marks.join(large, "piece", "left_semi").drop("piece"), "far-marks")
    load = load.where(F.col("n") <= max_piece)
    n, total, own = load.agg(F.count("*"), F.coalesce(F.sum(F.col("n") + 1), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n") > SHARED, F.col("chunks"))), F.lit(0))).first()
    tasks = max(_tasks(arcs.sparkSession, n, 4096), total // SHARED, 4 * own)
    here = _dealt(cut.join(load, "piece").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("src", "dst", "m", "piece", "n", "chunk"), tasks)
    on = _dealt(marks.join(load, "piece").withColumn("chunk", F.pmod(F.xxhash64("iv_id"), F.col("chunks"))).select("iv_id", "node", "mask", "piece", "n", "chunk"), tasks)

    def task(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(c):
            return pd.DataFrame(columns=names)
        graph = Compact(a.src.to_numpy(), a.dst.to_numpy(), a.m.to_numpy())
        # interventions of a piece are numbered; those of one number are run at once
        iv, ivs = pd.factorize(c.iv_id, use_na_sentinel=False)
        at, _ = pd.factorize(c.piece)
        pairs = pd.DataFrame({"iv": iv, "at": at}).drop_duplicates()
        turn = pairs.groupby("at").cumcount() if merged else pd.Series(range(len(pairs)), index=pairs.index)
        turns = pd.DataFrame({"iv": iv, "at": at, "row": range(len(c))}).merge(pairs.assign(turn=turn), on=["iv", "at"])
        piece_of = dict(zip(a.src.tolist(), a.piece.tolist())) | dict(zip(a.dst.tolist(), a.piece.tolist()))
        ivs, node, mask, piece = ivs.tolist(), c.node.tolist(), c["mask"].tolist(), c.piece.tolist()
        out: list[tuple] = []
        for _, g in turns.groupby("turn"):
            which = g.row.tolist()
            owner = {piece[r]: ivs[k] for r, k in zip(which, g.iv.tolist())}
            out += [(owner[piece_of.get(row[0], row[0])], *row) for row in run(graph, None, {node[r]: mask[r] for r in which})]
        return pd.DataFrame(out, columns=names)

    return here.groupBy("__task").cogroup(on.groupBy("__task")).applyInPandas(task, schema), far_arcs, far
