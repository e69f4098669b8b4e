"""Cluster models of many resamples of the same points, fitted together.

Runs of four algorithms (k-means, Gaussian mixtures, bisecting k-means, medoids), of any number of cluster counts and
resamples, go through the points side by side: a pass over the points serves all runs that are not done. A
task adds up what each run asks for (counts, sums, products), or keeps the best point for it; runs never hold
points, so the driver has centres only and work grows with points x runs. Nothing is drawn: chance is a hash
of the key, the same on every run and partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.session import materialise, spread

#: Passes of a fit (for bisecting, of a level), rounds of the medoids, and numbers of a row that tasks' sums travel in.
PASSES, ROUNDS, TILE = 20, 10, 1 << 14
_EPS = float(np.finfo(float).eps)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centres."""
    return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)


def _chance(place: np.ndarray, seed: int) -> np.ndarray:
    """Values of (0, 1) that follow from a row's hash and a seed."""
    h = place.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & 2**64 - 1)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2**-54


class Run:
    """A fit in progress: ``asks`` is "sums" (``sums`` of a batch, added up, go to ``take``), "picks" (the point of least ``score`` a slot goes to ``pick``) or None."""

    def __init__(self, k: int, rep: int, seed: int):
        self.k, self.rep, self.seed, self.asks, self.step = k, rep, seed, "picks", 0
        self.centres: np.ndarray = np.zeros((0, 0))

    def score(self, x: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, score) of each point for the next start: near-by points are chosen less often, by their squared distance."""
        d = _squares(x, self.centres).min(axis=1) if len(self.centres) else np.ones(len(x))
        with np.errstate(divide="ignore"):
            return np.zeros(len(x), int), np.where(d > 0, -np.log(_chance(place, self.seed * 64 + len(self.centres))) / d, np.inf)

    def pick(self, found: dict) -> None:
        if 0 in found:
            self.centres = np.vstack([self.centres.reshape(-1, len(found[0][1])), found[0][1]])
        if 0 not in found or len(self.centres) == self.k:
            self.asks = "sums" if len(self.centres) else None

    def labels(self, x: np.ndarray) -> np.ndarray:
        return _squares(x, self.centres).argmin(axis=1) if len(self.centres) else np.zeros(len(x), int)

    def sums(self, x: np.ndarray) -> np.ndarray:
        own, out = self.labels(x), np.zeros((len(self.centres), 1 + x.shape[1]))
        for c in range(len(out)):
            mine = x[own == c]
            out[c, 0], out[c, 1:] = len(mine), mine.sum(axis=0)
        return out.ravel()


class Means(Run):
    """Lloyd's iterations from starts by squared distance."""

    def take(self, total: np.ndarray) -> None:
        total = total.reshape(len(self.centres), -1)
        now = np.where(total[:, :1] > 0, total[:, 1:] / np.maximum(total[:, :1], 1), self.centres)
        moved = ((now - self.centres) ** 2).sum(axis=1).max()
        self.centres, self.step = now, self.step + 1
        if moved <= 1e-8 or self.step == PASSES:
            self.asks = None


class Mixture(Run):
    """Expectation and maximisation; the first shares come from the nearest start. A singular covariance counts by its own dimensions."""

    def __init__(self, k: int, rep: int, seed: int):
        super().__init__(k, rep, seed + 1_000_003)  # other starts than the means of the same resample
        self.parts: list | None = None
        self.last = -np.inf

    def _shares(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        if self.parts is None:
            return np.eye(len(self.centres))[super().labels(x)], 0.0
        p = np.empty((len(x), len(self.parts)))
        for c, (weight, mean, root, scale) in enumerate(self.parts):
            p[:, c] = _EPS + weight * np.exp(scale - 0.5 * (((x - mean) @ root) ** 2).sum(axis=1))
        whole = p.sum(axis=1)
        return p / whole[:, None], float(np.log(whole).sum())

    def labels(self, x: np.ndarray) -> np.ndarray:
        return self._shares(x)[0].argmax(axis=1) if len(self.centres) else np.zeros(len(x), int)

    def sums(self, x: np.ndarray) -> np.ndarray:
        r, likely = self._shares(x)
        products = np.einsum("nc,ni,nj->cij", r, x, x)
        return np.concatenate([[likely], r.sum(axis=0), (r.T @ x).ravel(), products.ravel()])

    def take(self, total: np.ndarray) -> None:
        k, p = self.centres.shape
        likely, n = total[0], total[1 : 1 + k]
        means = np.where(n[:, None] > 0, total[1 + k : 1 + k + k * p].reshape(k, p) / np.maximum(n, 1e-300)[:, None], self.centres)
        products, parts = total[1 + k + k * p :].reshape(k, p, p), []
        for c in range(k):
            cov = products[c] / n[c] - np.outer(means[c], means[c]) if n[c] > 0 else np.eye(p)
            value, vector = np.linalg.eigh((cov + cov.T) / 2)
            kept = value > _EPS * max(value.max(), 1e-300) * p
            root = vector[:, kept] / np.sqrt(value[kept])
            parts.append((n[c] / max(n.sum(), 1e-300), means[c], root, -0.5 * (p * np.log(2 * np.pi) + np.log(value[kept]).sum())))
        done = self.parts is not None and abs(likely - self.last) < 0.01
        if self.parts is not None:
            self.last = likely
        self.parts, self.centres, self.step = parts, means, self.step + 1
        if done or self.step > PASSES:
            self.asks = None


class Bisecting(Run):
    """Clusters are halved level by level, the largest first where fewer are wanted; a point goes down the tree by the nearer half."""

    def __init__(self, k: int, rep: int, seed: int):
        super().__init__(k, rep, seed)
        self.asks = "sums"
        self.nodes: dict[int, np.ndarray] = {}  # halves of node i are 2 i and 2 i + 1
        self.size: dict[int, tuple[float, float]] = {}
        self.split: list[int] = []
        self.before: np.ndarray | None = None

    def _leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.ones(len(x), np.int64)
        for i in sorted(self.nodes):
            halves = [h for h in (2 * i, 2 * i + 1) if h in self.nodes]
            mine = np.flatnonzero(at == i) if halves else []
            if len(mine):
                at[mine] = np.array(halves)[_squares(x[mine], np.array([self.nodes[h] for h in halves])).argmin(axis=1)]
        return at

    def labels(self, x: np.ndarray) -> np.ndarray:
        leaves = sorted(i for i in self.nodes if 2 * i not in self.nodes and 2 * i + 1 not in self.nodes)
        return np.searchsorted(leaves, self._leaf(x)) if leaves else np.zeros(len(x), int)

    def _asked(self) -> list[int]:
        return [h for i in self.split for h in (2 * i, 2 * i + 1)] if self.nodes else [1]

    def sums(self, x: np.ndarray) -> np.ndarray:
        at, out = self._leaf(x), []
        for i in self._asked():
            mine = x[at == i]
            out.append(np.concatenate([[len(mine), (mine**2).sum()], mine.sum(axis=0)]))
        return np.concatenate(out)

    def take(self, total: np.ndarray) -> None:
        total, asked = total.reshape(len(self._asked()), -1), self._asked()
        for i, (n, square, *s) in zip(asked, total):
            if n:
                mean = np.array(s) / n
                self.nodes[i], self.size[i] = mean, (n, square - n * (mean**2).sum())
            else:
                self.size[i] = (0.0, 0.0)
        still = self.before is not None and np.array_equal(total, self.before)
        self.before, self.step = total, self.step + 1
        if self.split and not still and self.step < PASSES:
            return
        for i in asked:  # a half without points is none
            if not self.size[i][0]:
                self.nodes.pop(i, None)
        self._divide()

    def _divide(self) -> None:
        leaves = [i for i in self.nodes if 2 * i not in self.nodes and 2 * i + 1 not in self.nodes]
        whole = [i for i in leaves if self.size[i][0] > 1 and self.size[i][1] > 1e-9 * self.size[i][0] and i not in self.split]
        self.split = sorted(whole, key=lambda i: (-self.size[i][0], i))[: max(0, self.k - len(leaves))]
        self.before, self.step = None, 0
        for i in self.split:
            centre = self.nodes[i]
            noise = 1e-4 * np.linalg.norm(centre) * np.random.default_rng([self.seed, i]).random(len(centre))
            noise = noise if noise.any() else np.full(len(centre), 1e-4 * np.sqrt(self.size[i][1] / self.size[i][0]))
            self.nodes[2 * i], self.nodes[2 * i + 1] = centre - noise, centre + noise
        if not self.split:
            self.asks = None


class Medoids(Run):
    """The method of ``operators/medoids.py``: farthest starts, then the member nearest to each mean while the total falls."""

    def __init__(self, k: int, rep: int, seed: int):
        super().__init__(k, rep, seed)
        self.keys: list = []
        self.means: np.ndarray | None = None
        self.best: tuple = (np.inf, [], np.zeros((0, 0)))

    def score(self, x: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.means is not None:
            own = self.labels(x)
            return own, np.sqrt(((x - self.means[own]) ** 2).sum(axis=1))
        if len(self.centres):
            d = _squares(x, self.centres).min(axis=1)
            return np.zeros(len(x), int), np.where(d > 0, -np.sqrt(d), np.inf)
        return np.zeros(len(x), int), _chance(place, self.seed * 64)

    def pick(self, found: dict) -> None:
        if self.means is None:
            super().pick(found)
            self.keys += [found[0][0]] if 0 in found else []
            return
        new = {found[c][0]: found[c][1] for c in range(len(self.keys)) if c in found}
        self.means, self.step = None, self.step + 1
        self.keys, self.centres = list(new), np.array(list(new.values()))
        self.asks = "sums"
        if set(self.keys) == set(self.best[1]) or self.step == ROUNDS:
            self._end()

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([[np.sqrt(_squares(x, self.centres).min(axis=1)).sum()], super().sums(x)])

    def take(self, total: np.ndarray) -> None:
        if not total[0] < self.best[0] - 1e-12:
            return self._end()
        self.best = (float(total[0]), self.keys, self.centres)
        total = total[1:].reshape(len(self.centres), -1)
        self.means = np.where(total[:, :1] > 0, total[:, 1:] / np.maximum(total[:, :1], 1), self.centres)
        self.asks = "picks"

    def _end(self) -> None:
        self.asks, (_, self.keys, self.centres) = None, self.best


class Votes(Run):
    """Lloyd's iterations over one-hot votes: a point holds the labels of all base runs, of which ``columns`` count; a centre is each label's share in a run.

    The squared distance of one-hot vectors is worked out from labels and shares; the vectors are never made.
    """

    def __init__(self, k: int, columns: Sequence[int], labels: int, seed: int):
        super().__init__(k, 0, seed)
        self.columns, self.wide = np.asarray(columns), labels
        self.tables: np.ndarray | None = None

    def _distances(self, x: np.ndarray) -> np.ndarray:
        votes = x[:, self.columns].astype(np.int64)
        if self.tables is None:
            return np.stack([2.0 * (votes != c[self.columns]).sum(axis=1) for c in self.centres], axis=1)
        at, out = votes + np.arange(len(self.columns)) * self.wide, np.empty((len(x), len(self.tables)))
        for c, t in enumerate(self.tables):
            out[:, c] = len(self.columns) - 2 * t.ravel()[at].sum(axis=1) + (t * t).sum()
        return out

    def score(self, x: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self._distances(x).min(axis=1) if len(self.centres) else np.ones(len(x))
        with np.errstate(divide="ignore"):
            return np.zeros(len(x), int), np.where(d > 0, -np.log(_chance(place, self.seed * 64 + len(self.centres))) / d, np.inf)

    def labels(self, x: np.ndarray) -> np.ndarray:
        return self._distances(x).argmin(axis=1) if len(self.centres) else np.zeros(len(x), int)

    def sums(self, x: np.ndarray) -> np.ndarray:
        own, votes = self.labels(x), x[:, self.columns].astype(np.int64)
        at, cells = votes + np.arange(len(self.columns)) * self.wide, len(self.columns) * self.wide
        return np.concatenate([np.bincount(at[own == c].ravel(), minlength=cells) for c in range(len(self.centres))]).astype(float)

    def take(self, total: np.ndarray) -> None:
        total = total.reshape(len(self.centres), len(self.columns), self.wide)
        n = total[:, :1].sum(axis=2, keepdims=True)
        held = np.zeros_like(total) if self.tables is None else self.tables
        if self.tables is None:
            for c, row in enumerate(self.centres):
                held[c, np.arange(len(self.columns)), row[self.columns].astype(int)] = 1.0
        now = np.where(n > 0, total / np.maximum(n, 1), held)
        moved = ((now - held) ** 2).sum(axis=(1, 2)).max()
        self.tables, self.step = now, self.step + 1
        if moved <= 1e-8 or self.step == PASSES:
            self.asks = None


KINDS = {"km": Means, "gmm": Mixture, "bisecting": Bisecting, "pam": Medoids}


def _batches(batches: Iterator[pd.DataFrame], key: str):
    """(keys, points, places, whether each resample holds them) of batches with rows."""
    for b in batches:
        if len(b):
            yield b[key].to_numpy(dtype=object), np.stack(b["point"]).astype(float), b["place"].to_numpy(), np.stack(b["held"]).astype(bool)


def _added(rows: DataFrame, key: str, runs: Sequence[Run]) -> list[np.ndarray]:
    """What each run adds up over its resample: tasks' sums are combined a tile at a time, in the order of tasks."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: list | None = None
        for _, x, _, held in _batches(batches, key):
            parts = {rep: x[held[:, rep]] for rep in {r.rep for r in runs}}
            part = [r.sums(parts[r.rep]) for r in runs]
            total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
        if total is not None:
            flat, task = np.concatenate(total), TaskContext.get().partitionId()
            edges = np.cumsum([len(t) for t in total])
            for tile in range(0, len(flat), TILE):
                yield pd.DataFrame({"tile": [tile], "task": [task], "g": [flat[tile : tile + TILE].tobytes()], "edges": [edges.tolist() if not tile else None]})

    def combine(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("task")
        g = np.sum([np.frombuffer(r) for r in part["g"]], axis=0)
        return pd.DataFrame({"tile": part["tile"].iloc[:1].tolist(), "g": [g.tobytes()], "edges": [part["edges"].iloc[0]]})

    sums = rows.mapInPandas(add, "tile int, task int, g binary, edges array<long>")
    cells = sorted(sums.groupBy("tile").applyInPandas(combine, "tile int, g binary, edges array<long>").collect(), key=lambda r: r.tile)
    return np.split(np.concatenate([np.frombuffer(r.g) for r in cells]), cells[0].edges[:-1]) if cells else []


def _picked(rows: DataFrame, key: str, runs: Sequence[Run]) -> list[dict]:
    """For each run and slot the (key, point) of least score in its resample; among ties the one of least place."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_best: dict = {}
        for keys, x, place, held in _batches(batches, key):
            inside = {rep: np.flatnonzero(held[:, rep]) for rep in {r.rep for r in runs}}
            for i, r in enumerate(runs):
                mine = inside[r.rep]
                slot, score = r.score(x[mine], place[mine])
                order = np.lexsort((place[mine], score, slot))
                first = order[np.unique(slot[order], return_index=True)[1]]
                for j in first[np.isfinite(score[first])]:
                    now = (float(score[j]), int(place[mine[j]]), keys[mine[j]], x[mine[j]].tolist())
                    if (i, int(slot[j])) not in held_best or now[:2] < held_best[i, int(slot[j])][:2]:
                        held_best[i, int(slot[j])] = now
        if held_best:
            score, place, keys, x = map(list, zip(*held_best.values()))
            yield pd.DataFrame({"run": [i for i, _ in held_best], "slot": [s for _, s in held_best], "score": score, "place": place, key: pd.Series(keys), "point": x})

    schema = T.StructType([T.StructField(n, t) for n, t in (("run", T.IntegerType()), ("slot", T.IntegerType()), ("score", T.DoubleType()), ("place", T.LongType()))])
    schema = T.StructType([*schema.fields, rows.schema[key], T.StructField("point", T.ArrayType(T.DoubleType()))])
    top = rows.mapInPandas(best, schema).groupBy("run", "slot").agg(F.min_by(F.struct(key, "point"), F.struct("score", "place")).alias("b"))
    out: list[dict] = [{} for _ in runs]
    for r in top.collect():  # a row for each run and cluster
        out[r.run][r["slot"]] = (r.b[0], np.array(r.b[1], dtype=float))
    return out


def fitted(points: DataFrame, key: str, held: Column, runs: Sequence[Run], seed: int, carried: Sequence[str] = ("point",)) -> DataFrame:
    """(key, carried columns, labels): the runs are fitted on the resamples that ``held`` (array of booleans, one a resample) tells, and label all points in their order."""
    rows = points.select(key, *dict.fromkeys(["point", *carried]), held.alias("held"), F.xxhash64(F.col(key), F.lit(seed)).alias("place"))
    rows = materialise(spread(rows, [key]), "resamples")
    narrow = rows.select(key, "point", "held", "place")
    while any(r.asks for r in runs):
        adding, picking = ([r for r in runs if r.asks == kind] for kind in ("sums", "picks"))
        sums = _added(narrow, key, adding) if adding else []
        picks = _picked(narrow, key, picking) if picking else []
        if adding and not sums:  # no points at all
            return rows.select(key, *carried, F.array().cast("array<int>").alias("labels"))
        for r, total in zip(adding, sums):
            r.take(total)
        for r, found in zip(picking, picks):
            r.pick(found)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def label(point: pd.Series) -> pd.Series:
        x = np.stack(point).astype(float) if len(point) else np.zeros((0, 0))
        return pd.Series(list(np.stack([r.labels(x) for r in runs], axis=1).astype(np.int32)) if len(point) else [], dtype=object)

    return rows.select(key, *carried, label("point").alias("labels"))
