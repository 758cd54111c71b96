"""Communities of the similarity graph by modularity with a resolution, component by component."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import settled
from .components import components

SWEEPS, LEVELS = 300, 32


def resolution(identity: int) -> float:
    """1 at identity 50, falling to both sides, within 0 and 1."""
    g = np.float32((100.0 - abs(identity - 50.0) * 2.0) / 100.0)
    return float(min(np.float32(1), max(np.float32(0), g)))


class Graph:
    """An undirected graph of nodes 0..n-1: neighbours in ascending order with weights, and the weight of loops."""

    def __init__(self, n: int, weights: dict[tuple[int, int], float], loops: dict[int, float] | None = None):
        near: list[dict[int, float]] = [{} for _ in range(n)]
        for (u, v), w in weights.items():
            near[u][v] = near[v][u] = w
        self.near = [sorted(x.items()) for x in near]
        self.loops = loops or {}
        self.degree = [sum(w for _, w in x) + 2 * self.loops.get(u, 0.0) for u, x in enumerate(self.near)]

    def ties(self, u: int, label: list[int]) -> dict[int, float]:
        """Weight from u to each community beside it, in the order of u's neighbours."""
        out: dict[int, float] = {}
        for v, w in self.near[u]:
            out[label[v]] = out.get(label[v], 0.0) + w
        return out


def move_nodes(g: Graph, label: list[int], gamma: float, total: float) -> bool:
    """Sweeps over the nodes in order; each goes to the community beside it with the best positive gain. True if any moved."""
    mass = defaultdict(float)
    for u, c in enumerate(label):
        mass[c] += g.degree[u]
    moved = False
    for _ in range(SWEEPS):
        still = True
        for u in range(len(label)):
            k, old = g.degree[u], label[u]
            ties = g.ties(u, label)
            stay = ties.get(old, 0.0) - gamma * k * mass[old] / total
            best, gain = old, 0.0
            for c, w in ties.items():
                if c != old and (d := w - gamma * k * (mass[c] + k) / total - stay) > gain:
                    best, gain = c, d
            if best != old:
                mass[old] -= k
                mass[best] += k
                label[u] = best
                still, moved = False, True
        if still:
            break
    return moved


def split_communities(g: Graph, coarse: list[int], gamma: float, total: float, rng: random.Random) -> list[int]:
    """Parts of the coarse communities, each connected: nodes still alone join, in random order, a part beside them that is drawn at random, unless that loses modularity."""
    part = [*range(len(coarse))]
    mass, size = [*g.degree], [1] * len(coarse)
    order = [*range(len(coarse))]
    rng.shuffle(order)
    for u in order:
        if size[part[u]] > 1:
            continue
        options: dict[int, float] = {}
        for v, w in g.near[u]:
            if coarse[v] == coarse[u] and part[v] != part[u]:
                options[part[v]] = options.get(part[v], 0.0) + w
        if not options:
            continue
        c = [*options][rng.randrange(len(options))]
        k = g.degree[u]
        if options[c] - gamma * k * (mass[c] + k) / total + gamma * k * mass[part[u]] / total >= 0:
            size[part[u]] -= 1
            mass[part[u]] -= k
            part[u] = c
            size[c] += 1
            mass[c] += k
    return part


def renumber(label: list[int]) -> list[int]:
    seen: dict[int, int] = {}
    return [seen.setdefault(c, len(seen)) for c in label]


def communities(n: int, pairs: list[tuple[int, int]], gamma: float, total: float | None = None, seed: int = 42, literal_loops: bool = False) -> list[int]:
    """Communities of nodes 0..n-1 by their first appearance.

    `total` is the total degree of the whole graph, of which these nodes may be one component. Collapsing keeps
    it: a loop's weight counts once. With literal_loops each collapse counts the loops it already has twice, which
    only makes sense for a graph that is not split into components.
    """
    weights: dict[tuple[int, int], float] = {(min(u, v), max(u, v)): 1.0 for u, v in pairs if u != v}
    g = Graph(n, weights)
    total = total or sum(g.degree)
    where = [*range(n)]
    if not total:
        return where
    for level in range(LEVELS):
        label = [*range(len(g.degree))]
        if not move_nodes(g, label, gamma, total):
            break
        part = renumber(split_communities(g, label, gamma, total, random.Random(seed * 1_000_003 + level)))
        merged: dict[tuple[int, int], float] = defaultdict(float)
        loops: dict[int, float] = defaultdict(float)
        for u, near in enumerate(g.near):
            loops[part[u]] += g.loops.get(u, 0.0) * (2 if literal_loops else 1)
            for v, w in near:
                if u < v:
                    if part[u] == part[v]:
                        loops[part[u]] += w
                    else:
                        merged[min(part[u], part[v]), max(part[u], part[v])] += w
        where = [part[c] for c in where]
        g = Graph(max(part) + 1, merged, loops)
        if literal_loops:
            total = sum(g.degree)
        if len(g.degree) <= 1:
            break
    return renumber(where)


def community_clusters(seqs: DataFrame, edges: DataFrame, identity: int, seed: int = 42) -> DataFrame:
    """(idx, cluster_id) for every sequence; cluster_id is the smallest idx of its community.

    A move's gain depends on a node's own component and on the total degree only, so components are solved apart,
    each in one task that must hold its edges. Sequences without edges are their own clusters.
    """
    gamma = resolution(identity)
    links = settled(edges.where("score > 0 AND rep <> tar").select(F.least("rep", "tar").alias("a"), F.greatest("rep", "tar").alias("b")).distinct())
    total = 2.0 * links.count()
    comps = components(links)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(pdf[["a", "b"]].to_numpy())
        pairs = np.searchsorted(nodes, pdf[["a", "b"]].to_numpy())
        label = communities(len(nodes), [*map(tuple, pairs.tolist())], gamma, total, seed)
        least = pd.Series(nodes).groupby(label).transform("min")
        return pd.DataFrame({"idx": nodes, "cluster_id": least.to_numpy()})

    solved = links.join(comps, links.a == comps.node).groupBy("root").applyInPandas(solve, "idx long, cluster_id long")
    return seqs.select("idx").join(solved, "idx", "left").select("idx", F.coalesce("cluster_id", "idx").alias("cluster_id"))
