"""Boosted regression trees from gradient histograms, several fits at a time, and the compiled scorer of such trees.

Features become bins at sketched quantiles. In each level, every partition adds the gradients, curvatures and counts of its
rows per (fit, node, feature, bin); the sums of one (fit, node) meet in one task, which also picks the split, so the driver
sees one small row per node. Trees are complete binary arrays: the children of node i are 2i + 1 and 2i + 2.

A fit holds one fold back and ends when `patience` rounds bring no smaller loss there; the loss after every round is kept, so
one fit answers for all smaller numbers of rounds. All fits (candidates x folds) share the same jobs. A table whose bins
fit into `LOCAL_CELLS` bytes goes to one task per fit instead, which grows the same trees without a job per level.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import truncate_lineage

#: Bytes of binned features up to which a whole table may go to one task.
LOCAL_CELLS = 1 << 24
#: Rounds after which the rows of a distributed fit carry their sums along instead of adding the trees again.
SNAPSHOT = 20
ROW = "key long, bins binary, y double, w double, fold int"


@dataclass(frozen=True)
class Boosting:
    """Settings of one fit. `held` is the fold that ends it; without one it runs all rounds on all rows."""

    depth: int = 5
    eta: float = 0.03
    rounds: int = 4000
    patience: int = 100
    subsample: float = 0.9
    columns: float = 1.0
    l2: float = 1.0
    min_gain: float = 0.0
    min_weight: float = 1.0
    seed: int = 42
    held: int | None = 1


@dataclass
class Trees:
    """A fitted ensemble: `base` plus the leaf values of every tree; x goes left where x <= threshold."""

    features: list[str]
    base: float
    feature: np.ndarray  # tree x node, -1 in a leaf
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    history: list[tuple[float, float]] = field(default_factory=list)  # training and held-out loss after each round

    @property
    def best_round(self) -> int:
        return len(self.feature)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Output for each row of a matrix; a missing value counts as the smallest."""
        out = np.full(len(x), self.base)
        if not len(self.feature):
            return out
        x, steps = np.where(np.isnan(x), -np.inf, x), (self.feature.shape[1] + 1).bit_length() - 2
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(steps):
                f = feature[at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                at[inner] = 2 * at[inner] + 1 + ~(x[inner, f[inner]] <= threshold[at[inner]])
            out += value[at]
        return out


# --- one level -----------------------------------------------------------------------------------------------------


def _chosen(key: np.ndarray, p: Boosting, number: int) -> np.ndarray:
    """Rows of a round: a hash of key and round, so the choice does not follow the partitions."""
    if p.subsample >= 1:
        return np.ones(len(key), bool)
    x = key.astype(np.uint64) + np.uint64((p.seed * 1_000_003 + number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) < p.subsample * (1 << 53)


def _columns(p: Boosting, number: int, width: int) -> np.ndarray:
    """Features that a round may split on."""
    kept = np.zeros(width, bool)
    kept[np.random.default_rng((p.seed, number)).permutation(width)[: max(1, round(width * p.columns))]] = True
    return kept


def histograms(bins: np.ndarray, node: np.ndarray, nodes: int, size: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums of gradient, curvature and rows, as node x feature x bin x 3."""
    out, start = np.empty((nodes, bins.shape[1], size, 3)), node * size
    for f in range(bins.shape[1]):
        at = start + bins[:, f]
        for k, v in enumerate((g, h, None)):
            out[:, f, :, k] = np.bincount(at, v, nodes * size).reshape(nodes, size)
    return out


def best_split(hist: np.ndarray, kept: np.ndarray, p: Boosting) -> tuple | None:
    """(feature, bin, left sums, right sums) with the highest gain, the first of equal ones; none without a gain."""
    left = np.cumsum(hist, axis=1)
    whole = left[:, -1:, :]
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + p.l2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score(left) + score(right) - score(whole)
    bad = (left[..., 2] < 0.5) | (right[..., 2] < 0.5) | (left[..., 1] < p.min_weight) | (right[..., 1] < p.min_weight) | ~kept[:, None]
    gain[bad] = -np.inf
    f, b = np.unravel_index(int(np.argmax(np.round(gain, 9))), gain.shape)
    return None if not gain[f, b] > p.min_gain + 1e-9 else (int(f), int(b), left[f, b], right[f, b])


class Growing:
    """One tree while it grows, in bins."""

    def __init__(self, p: Boosting) -> None:
        n = (1 << (p.depth + 1)) - 1
        self.p, self.feature, self.bin = p, np.full(n, -1, np.int32), np.zeros(n, np.int32)
        self.value, self.cover = np.zeros(n), np.zeros(n)

    def places(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """Node of each row after so many levels."""
        at = np.zeros(len(bins), np.int64)
        for level in range(depth):
            at = self.below(bins, at, level)
        return at

    def below(self, bins: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        """Node of each row after one more level; `at` holds the nodes after `level` of them."""
        if level == 0:  # all rows stand in the root
            return 1 + (bins[:, self.feature[0]] > self.bin[0]) if self.feature[0] >= 0 else at
        f = self.feature[at]
        right = bins.reshape(-1)[np.arange(0, bins.size, bins.shape[1]) + np.maximum(f, 0)] > self.bin[at]
        return np.where(f >= 0, 2 * at + 1 + right, at)

    def open(self, depth: int) -> range:
        return range((1 << depth) - 1, (1 << (depth + 1)) - 1)

    def split(self, node: int, found: tuple | None) -> None:
        if found is None:
            return
        self.feature[node], self.bin[node] = found[0], found[1]
        for child, s in ((2 * node + 1, found[2]), (2 * node + 2, found[3])):
            self.value[child], self.cover[child] = -self.p.eta * s[0] / (s[1] + self.p.l2), s[2]
        if node == 0:
            whole = found[2] + found[3]
            self.cover[0] = whole[2]

    def output(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.places(bins, self.p.depth)]


def _level(tree: Growing, depth: int, at: np.ndarray, bins: np.ndarray, use: np.ndarray, g: np.ndarray, w: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the level with rows, and their histograms; `at` is the node of each row."""
    here = np.flatnonzero(use & (at >= tree.open(depth)[0]))
    at = at[here]
    nodes = np.flatnonzero(np.bincount(at, minlength=len(tree.feature)))
    place = np.zeros(len(tree.feature), np.int64)
    place[nodes] = np.arange(len(nodes))
    return nodes, histograms(bins[here], place[at], len(nodes), size, g[here], w[here])


class _Stop:
    """Loss after each round and when to end."""

    def __init__(self, p: Boosting) -> None:
        self.p, self.history, self.best, self.at = p, [], np.inf, 0

    def done(self, train: float, held: float) -> bool:
        self.history.append((train, held))
        number = len(self.history)
        if self.p.held is None:
            self.at = number
        elif held < self.best - 1e-12:
            self.best, self.at = held, number
        return number >= self.p.rounds or (self.p.held is not None and number - self.at >= self.p.patience)


def _mean_loss(margin: np.ndarray, y: np.ndarray, w: np.ndarray, rows: np.ndarray) -> tuple[float, float]:
    e = margin[rows] - y[rows]
    return float((w[rows] * e * e).sum()), float(w[rows].sum())


def grow_locally(key: np.ndarray, bins: np.ndarray, y: np.ndarray, w: np.ndarray, fold: np.ndarray, p: Boosting, size: int) -> tuple[float, list[Growing], list[tuple[float, float]]]:
    """A whole fit in one place: base, trees up to the best round, loss after each round."""
    train = np.ones(len(y), bool) if p.held is None else fold != p.held
    base = float((w[train] * y[train]).sum() / max(w[train].sum(), 1e-300)) if train.any() else 0.0
    margin, trees, stop = np.full(len(y), base), [], _Stop(p)
    for number in range(p.rounds):
        tree, use, kept = Growing(p), train & _chosen(key, p, number), _columns(p, number, bins.shape[1])
        g, at = w * (margin - y), np.zeros(len(y), np.int64)
        for depth in range(p.depth):
            nodes, hists = _level(tree, depth, at, bins, use, g, w, size)
            for node, hist in zip(nodes.tolist(), hists, strict=True):
                tree.split(node, best_split(hist, kept, p))
            at = tree.below(bins, at, depth)
        trees.append(tree)
        margin = margin + tree.value[at]
        (a, n), (b, m) = _mean_loss(margin, y, w, train), _mean_loss(margin, y, w, ~train)
        if stop.done(a / max(n, 1e-300), b / m if m else float("nan")):
            break
    return base, trees[: stop.at], stop.history


# --- as Spark jobs -------------------------------------------------------------------------------------------------


def bin_edges(df: DataFrame, features: list[str], bins: int = 256) -> list[list[float]]:
    """Upper edges of each feature's bins at sketched quantiles: at most bins - 1 numbers per feature."""
    found = df.approxQuantile(features, [i / bins for i in range(1, bins)], 1.0 / (4 * bins))
    return [sorted(set(q)) for q in found]


def binned(df: DataFrame, features: list[str], edges: list[list[float]], label: str, weight: str | None, key: str, fold: str) -> DataFrame:
    """key, bins (one byte per feature), y, w, fold. Missing features count as the smallest value; rows without label are left out."""
    rows = df.where(F.col(label).isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        F.coalesce(F.col(fold).cast("int"), F.lit(-1)).alias("fold"), *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([np.nan_to_num(b.column(f"x{i}").fill_null(np.nan).to_numpy(zero_copy_only=False), nan=-np.inf) for i in range(len(features))], axis=1)
            cells = np.stack([np.searchsorted(np.array(e), x[:, i], "left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("key").fill_null(0), pa.array([r.tobytes() for r in cells], pa.binary()), b.column("y"), b.column("w").fill_null(0.0), b.column("fold")],
                                             names=["key", "bins", "y", "w", "fold"])

    return rows.mapInArrow(run, ROW)


def _arrays(b: pa.RecordBatch | pa.Table, width: int) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(-1, width)
    return (b.column("key").to_numpy(), bins, *(b.column(c).to_numpy() for c in ("y", "w", "fold")))


def _packed(trees: list[Growing], base: float, history: list) -> bytes:
    out = io.BytesIO()
    stack = lambda name: np.array([getattr(t, name) for t in trees])
    np.savez(out, feature=stack("feature"), bin=stack("bin"), value=stack("value"), cover=stack("cover"), base=base, history=np.array(history))
    return out.getvalue()


def _compiled(packed: bytes, features: list[str], edges: list[list[float]]) -> Trees:
    """Bins back to thresholds; a split behind the last edge can't be, as nothing lies right of it."""
    z = np.load(io.BytesIO(packed))
    table = np.full((len(features), 256), np.inf)
    for i, e in enumerate(edges):
        table[i, : len(e)] = e
    feature = z["feature"].astype(np.int32)
    threshold = table[np.maximum(feature, 0), z["bin"]] if feature.size else feature.astype(float)
    return Trees(features, float(z["base"]), feature, threshold, z["value"], z["cover"], [tuple(map(float, r)) for r in z["history"]])


def fit_boosted(df: DataFrame, features: list[str], fits: dict[str, Boosting], label: str = "label", weight: str | None = None, key: str = "row_id",
                fold: str = "fold", bins: int = 256, local_cells: int = LOCAL_CELLS) -> dict[str, Trees]:
    """A fitted ensemble for each of the named settings, cut at its best round.

    Squared error. `bins` is 256 at most. Rows of the held fold never enter gradients, their bins may. No rows with a label:
    every output is 0. Ties between splits go to the first feature and the smallest threshold.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins must be between 2 and 256")
    edges = bin_edges(df.where(F.col(label).isNotNull()), features, bins)
    rows = truncate_lineage(binned(df, features, edges, label, weight, key, fold))
    count = rows.count()
    if count * len(features) <= local_cells:
        packed = _fit_by_task(rows, fits, len(features), bins)
    else:
        packed = _fit_by_level(rows, fits, len(features), bins)
    nothing = _packed([], 0.0, [])
    return {name: _compiled(packed.get(name, nothing), list(features), edges) for name in fits}


def _fit_by_task(rows: DataFrame, fits: dict[str, Boosting], width: int, size: int) -> dict[str, bytes]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        name = key[0].as_py()
        order = np.argsort(table.column("key").to_numpy(), kind="stable")
        base, trees, history = grow_locally(*_arrays(table.take(pa.array(order)).combine_chunks(), width), fits[name], size)
        return pa.table({"fit": pa.array([name]), "model": pa.array([_packed(trees, base, history)], pa.binary())})

    each = rows.withColumn("fit", F.explode(F.array(*(F.lit(n) for n in fits))))
    return {r["fit"]: bytes(r["model"]) for r in each.groupBy("fit").applyInArrow(run, "fit string, model binary").collect()}


def _fit_by_level(rows: DataFrame, fits: dict[str, Boosting], width: int, size: int) -> dict[str, bytes]:
    names = list(fits)
    sums = {r["fold"]: (r["s"], r["n"]) for r in rows.groupBy("fold").agg(F.sum(F.col("w") * F.col("y")).alias("s"), F.sum("w").alias("n")).collect()}
    bases = {}
    for name, p in fits.items():
        parts = [v for f, v in sums.items() if p.held is None or f != p.held]
        bases[name] = sum(s for s, _ in parts) / max(sum(n for _, n in parts), 1e-300)
    state = truncate_lineage(rows.withColumn("margin", F.array(*(F.lit(bases[n]) for n in names))))
    trees: dict[str, list[Growing]] = {n: [] for n in names}
    fresh: dict[str, list[Growing]] = {n: [] for n in names}
    stops, running = {n: _Stop(p) for n, p in fits.items()}, list(names)
    for number in range(max(p.rounds for p in fits.values()) + 1):
        growing = {n: Growing(fits[n]) for n in running}
        for depth in range(max((fits[n].depth for n in running), default=0)):
            found, losses = _level_job(state, fits, names, growing, fresh, number, depth, width, size)
            if depth == 0 and number > 0:
                ended = [n for n in running if stops[n].done(*losses[n])]
                running = [n for n in running if n not in ended]
                growing = {n: growing[n] for n in running}
            for name, node, split in found:
                if name in growing:
                    growing[name].split(node, split)
        if not running:
            break
        for n in running:
            trees[n].append(growing[n])
            fresh[n].append(growing[n])
        if (number + 1) % SNAPSHOT == 0:
            state = truncate_lineage(_advanced(state, names, fresh, width))
            fresh = {n: [] for n in names}
    return {n: _packed(trees[n][: stops[n].at], bases[n], stops[n].history) for n in names} if sums else {}


def _advanced(state: DataFrame, names: list[str], fresh: dict[str, list[Growing]], width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            margins = _margins(b, names, fresh, width)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, margins.size + 1, len(names)), pa.int32()), pa.array(margins.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "bins", "y", "w", "fold")), flat], names=["key", "bins", "y", "w", "fold", "margin"])

    return state.mapInArrow(run, f"{ROW}, margin array<double>")


def _margins(b: pa.RecordBatch, names: list[str], fresh: dict[str, list[Growing]], width: int) -> np.ndarray:
    margins = b.column("margin").flatten().to_numpy().reshape(-1, len(names)).copy()
    bins = _arrays(b, width)[1]
    for i, n in enumerate(names):
        for tree in fresh[n]:
            margins[:, i] += tree.output(bins)
    return margins


def _level_job(state: DataFrame, fits, names, growing, fresh, number: int, depth: int, width: int, size: int) -> tuple[list, dict]:
    """Splits of all nodes of a level of all fits, and at depth 0 the losses before this round."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hists, losses = {}, {n: np.zeros(4) for n in growing}
        for b in batches:
            key, bins, y, w, fold = _arrays(b, width)
            margins = _margins(b, names, fresh, width)
            for name, tree in growing.items():
                p, margin = fits[name], margins[:, names.index(name)]
                train = np.ones(len(y), bool) if p.held is None else fold != p.held
                if depth == 0:
                    losses[name] += [*_mean_loss(margin, y, w, train), *_mean_loss(margin, y, w, ~train)]
                if depth < p.depth:
                    nodes, found = _level(tree, depth, tree.places(bins, depth), bins, train & _chosen(key, p, number), w * (margin - y), w, size)
                    for node, hist in zip(nodes.tolist(), found, strict=True):
                        at = (name, node)
                        hists[at] = hists[at] + hist if at in hists else hist
        if depth == 0:
            hists |= {(n, -1): v for n, v in losses.items()}
        if hists:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in hists]), pa.array([k[1] for k in hists], pa.int32()), pa.array([v.tobytes() for v in hists.values()], pa.binary())],
                                             names=["fit", "node", "sums"])

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        name, node = key[0].as_py(), key[1].as_py()
        total = sum(np.frombuffer(v, np.float64) for v in table.column("sums").to_pylist())
        found = None
        if node >= 0:
            found = best_split(total.reshape(width, size, 3), _columns(fits[name], number, width), fits[name])
        sums = total.tolist() if node < 0 else [*found[2], *found[3]] if found else []
        return pa.table({"fit": pa.array([name]), "node": pa.array([node], pa.int32()), "feature": pa.array([found[0] if found else -1], pa.int32()),
                         "bin": pa.array([found[1] if found else 0], pa.int32()), "sums": pa.array([sums], pa.list_(pa.float64()))})

    parts = state.mapInArrow(partial, "fit string, node int, sums binary")
    rows = parts.groupBy("fit", "node").applyInArrow(whole, "fit string, node int, feature int, bin int, sums array<double>").collect()
    losses = {r["fit"]: (r["sums"][0] / max(r["sums"][1], 1e-300), r["sums"][2] / r["sums"][3] if r["sums"][3] else float("nan")) for r in rows if r["node"] < 0}
    return [(r["fit"], r["node"], (r["feature"], r["bin"], np.array(r["sums"][:3]), np.array(r["sums"][3:])) if r["feature"] >= 0 else None) for r in rows if r["node"] >= 0], losses


def fit_until_best(df: DataFrame, features: list[str], label: str = "label", weight: str | None = None, key: str = "row_id", **settings) -> Trees:
    """Boosted trees on the rows of split `train` that stop on the rows of split `val`."""
    marked = df.withColumn("_fold", F.when(F.col("split") == "val", 1).otherwise(0))
    return fit_boosted(marked, features, {"fit": Boosting(**settings)}, label, weight, key, "_fold")["fit"]


def search_candidates(df: DataFrame, features: list[str], candidates: dict[str, dict], label: str = "label", weight: str | None = None, key: str = "row_id",
                      fold: str = "fold") -> tuple[Trees, DataFrame]:
    """Cross-validated choice among named settings over the folds of a column, all fits in the same jobs.

    A candidate's loss after a number of rounds is the mean over its folds, as far as every fold ran; its best number of
    rounds has the smallest. Returns the winner fitted on all rows with that number, and the table (candidate, best_rounds,
    cv_rmse, rank).
    """
    folds = sorted(r[fold] for r in df.select(fold).distinct().collect() if r[fold] is not None)
    fits = {f"{name}|{k}": Boosting(**{**settings, "held": k}) for name, settings in candidates.items() for k in folds}
    fitted = fit_boosted(df, features, fits, label, weight, key, fold)
    table = []
    for name in candidates:
        curves = [[h for _, h in fitted[f"{name}|{k}"].history] for k in folds]
        shared = min(map(len, curves))
        mean = np.mean([c[:shared] for c in curves], axis=0)
        at = int(np.argmin(mean))
        table.append((name, at + 1, float(np.sqrt(mean[at]))))
    table.sort(key=lambda r: (r[2], r[0]))
    name, rounds, _ = table[0]
    best = fit_boosted(df, features, {"all": Boosting(**{**candidates[name], "rounds": rounds, "held": None})}, label, weight, key, fold)["all"]
    ranked = [(*r, i) for i, r in enumerate(table, 1)]
    return best, df.sparkSession.createDataFrame(ranked, "candidate string, best_rounds int, cv_rmse double, rank int")
