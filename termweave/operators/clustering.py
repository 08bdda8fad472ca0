"""Clusters of column names: hybrid distances, average linkage with coherence, splits and merges.

There are as many items as columns without a field (at most a few thousand in all),
and linkage is sequential: it runs in one group of a pandas function. Distances
alone can be had as a distributed self-join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx

WEIGHTS = {"embedding": 0.6, "jaccard": 0.2, "edit": 0.1, "overlap": 0.1}
DOMAINS = {
    "age": "age birth dob years",
    "site": "anatomic biopsy location primary site tissue",
    "smoking": "pack smoker smoking tobacco",
    "staging": "ajcc clin clinical path stage staging tnm",
    "status": "alive dead deceased status vital",
    "treatment": "adjuvant chemo neo radiation therapy treatment",
}


@dataclass(frozen=True)
class ClusterConfig:
    threshold: float = 0.9
    min_size: int = 2
    hybrid: bool = False
    centroid: bool = False
    domain_thresholds: dict[str, float] = field(default_factory=dict)
    domain_share: float = 0.3


def hybrid_distance(a: Column, b: Column, cosine: Column) -> Column:
    """Distance of two names in [0, 1] from their vectors' cosine, tokens and letters."""
    ta, tb = (F.array_distinct(tx.tokens(x)) for x in (a, b))
    return WEIGHTS["embedding"] * (1 - cosine) / 2 + WEIGHTS["jaccard"] * (1 - sim.jaccard(ta, tb)) + WEIGHTS["edit"] * sim.edit_distance(a, b) + WEIGHTS["overlap"] * (1 - sim.overlap(ta, tb))


def pair_distances(items: DataFrame) -> DataFrame:
    """items (name, embedding) -> (a, b, distance) of all pairs a < b."""
    l, r = items.select(F.col("name").alias("a"), F.col("embedding").alias("ea")), items.select(F.col("name").alias("b"), F.col("embedding").alias("eb"))
    return l.join(r, F.col("a") < F.col("b")).select("a", "b", F.round(hybrid_distance(F.col("a"), F.col("b"), sim.cosine(F.col("ea"), F.col("eb"))), 9).alias("distance"))


def coherence(members: DataFrame) -> DataFrame:
    """members (cluster, name, embedding) -> (cluster, n, scs): mean pairwise cosine, moved to [0, 1]; 1 for one."""
    # The cosines of all pairs sum to (|sum of units|^2 - units) / 2, so no pair is made. A zero vector's cosines are 0.
    v = F.col("embedding")
    size = F.sqrt(sim.dot(v, v))
    unit = F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: F.lit(0.0).cast("double")))
    parts = members.select("cluster", F.posexplode(unit).alias("d", "x")).groupBy("cluster", "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    total = parts.groupBy("cluster").agg(F.sum(F.col("s") * F.col("s") - F.col("q")).alias("pairs"))
    n = members.groupBy("cluster").agg(F.count("*").alias("n"))
    mean = F.col("pairs") / (F.col("n") * (F.col("n") - 1))
    return n.join(total, "cluster", "left").select("cluster", "n", F.round(F.when(F.col("n") > 1, (F.coalesce(mean, F.lit(0.0)) + 1) / 2).otherwise(1.0), 9).alias("scs"))


def centroid_coherence(members: DataFrame) -> DataFrame:
    """The same by the mean cosine to the centroid, one pass over the members."""
    v = F.transform(sim.unit(F.col("embedding")), lambda x: x.cast("double"))
    parts = members.select("cluster", F.posexplode(v).alias("d", "x")).groupBy("cluster", "d").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    # mean over members of cos(v, c) = |sum of units| / n
    return parts.groupBy("cluster").agg(F.max("n").alias("n"), F.round((F.sqrt(F.sum(F.col("s") * F.col("s"))) / F.max("n") + 1) / 2, 9).alias("scs"))


# --- inside one group ---------------------------------------------------------


def cosine_matrix(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    u = v / np.where(size > 0, size, 1)
    return np.clip(u @ u.T, -1, 1)


def hybrid_matrix(names: list[str], v: np.ndarray) -> np.ndarray:
    sets = [set(n.lower().translate(str.maketrans("_-.:", "    ")).split()) for n in names]
    plain = [n.lower().replace("_", "").replace(" ", "") for n in names]
    d = WEIGHTS["embedding"] * (1 - cosine_matrix(v)) / 2
    for i, a in enumerate(sets):
        for j in range(i):
            both, b = len(a & sets[j]), sets[j]
            jac = both / len(a | b) if a or b else 1.0
            lap = both / min(len(a), len(b)) if a and b else 0.0
            long = max(len(plain[i]), len(plain[j]))
            more = WEIGHTS["jaccard"] * (1 - jac) + WEIGHTS["overlap"] * (1 - lap) + WEIGHTS["edit"] * (levenshtein(plain[i], plain[j]) / long if long else 0.0)
            d[i, j] += more
            d[j, i] = d[i, j]
    np.fill_diagonal(d, 0)
    return d


def levenshtein(a: str, b: str) -> int:
    row = np.arange(len(b) + 1)
    codes = np.array([ord(x) for x in b], np.int64)
    for i, x in enumerate(a, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(x)))
        # an insertion carries the least value so far along the row
        base = np.concatenate([[i], step]) - np.arange(len(b) + 1)
        row = np.minimum.accumulate(base) + np.arange(len(b) + 1)
    return int(row[-1])


def average_linkage(d: np.ndarray) -> list[tuple[int, int]]:
    """Merges of nodes (leaves 0..n-1, then one new node for each merge), by a nearest-neighbour chain."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    found, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            x = chain[-1]
            y = int(np.argmin(d[x]))
            if len(chain) > 1 and d[x, chain[-2]] <= d[x, y]:
                y = chain[-2]
            if len(chain) > 1 and y == chain[-2]:
                break
            chain.append(y)
        chain = chain[:-2]
        found.append((d[x, y], x, y))
        merged = (size[x] * d[x] + size[y] * d[y]) / (size[x] + size[y])
        size[x] += size[y]
        alive[y] = False
        d[x], d[:, x] = merged, merged
        d[x, x] = np.inf
        d[y, :], d[:, y] = np.inf, np.inf
    label, out = list(range(n)), []
    top = list(range(n))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i in np.argsort([f[0] for f in found], kind="stable"):
        _, x, y = found[i]
        a, b = root(x), root(y)
        out.append((label[a], label[b]))
        top[b] = a
        label[a] = n + len(out) - 1
    return out


def mean_cosine(c: np.ndarray, rows: list[int]) -> float:
    part = c[np.ix_(rows, rows)]
    n = len(rows)
    return 1.0 if n < 2 else float((part.sum() - np.trace(part)) / (n * (n - 1)))


def threshold_of(names: list[str], config: ClusterConfig) -> float:
    words = {w for n in names for w in n.lower().replace("_", " ").replace("-", " ").split()}
    hits = [(len(words & set(DOMAINS[d].split())), -i, d) for i, d in enumerate(DOMAINS) if d in config.domain_thresholds]
    best = max(hits, default=(0, 0, ""))
    return config.domain_thresholds[best[2]] if best[0] >= max(1, config.domain_share * len(names)) else config.threshold


def coherent_clusters(names: list[str], v: np.ndarray, config: ClusterConfig = ClusterConfig(), judge: Callable[[list[str]], float] | None = None, shown: int = 30) -> list[list[int]]:
    """Nodes of the linkage tree, from the root down, that are small or coherent enough.

    judge says how coherent some names are in place of their vectors; of more than are
    shown at once it sees an even sample.
    """
    n = len(names)
    if n <= config.min_size:
        return [list(range(n))] if n else []
    cos = cosine_matrix(v)
    merges = average_linkage(hybrid_matrix(names, v) if config.hybrid else np.clip(1 - cos, 0, 2))
    leaves: dict[int, list[int]] = {i: [i] for i in range(n)}
    for i, (a, b) in enumerate(merges):
        leaves[n + i] = leaves[a] + leaves[b]
    out, queue = [], [n + len(merges) - 1]
    for node in queue:
        rows = leaves[node]
        if len(rows) <= config.min_size:
            scs = 1.0
        elif judge:
            scs = judge([names[rows[i]] for i in stratified_sample(v[rows], shown)])
        elif config.centroid:
            u = v[rows] / (np.linalg.norm(v[rows], axis=1, keepdims=True) + 1e-12)
            scs = (float(np.linalg.norm(u.mean(axis=0))) + 1) / 2
        else:
            scs = (mean_cosine(cos, rows) + 1) / 2
        if len(rows) <= config.min_size or scs >= threshold_of([names[i] for i in rows], config):
            out.append(sorted(rows))
        else:
            queue += merges[node - n]
    return out


def two_means(v: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Labels of a 2-means split that starts from the row furthest from the mean, and the one furthest from that."""
    a = int(np.argmax(((v - v.mean(axis=0)) ** 2).sum(1)))
    b = int(np.argmax(((v - v[a]) ** 2).sum(1)))
    centres = v[[a, b]].astype(float)
    for _ in range(rounds):
        label = ((v[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        new = np.array([v[label == k].mean(axis=0) if (label == k).any() else centres[k] for k in (0, 1)])
        if np.allclose(new, centres):
            break
        centres = new
    return label


def refine(clusters: list[list[int]], v: np.ndarray, gain: float = 0.15, least: int = 2, check_from: int = 4, veto=None) -> list[list[int]]:
    """Clusters split in two where that raises their mean cosine by at least gain; veto(a, b) may forbid it."""
    cos, out = cosine_matrix(v), []
    for rows in clusters:
        if len(rows) >= max(check_from, 2 * least):
            label = two_means(v[rows])
            a, b = ([r for r, l in zip(rows, label) if l == k] for k in (0, 1))
            if min(len(a), len(b)) >= least:
                after = (mean_cosine(cos, a) * len(a) + mean_cosine(cos, b) * len(b)) / len(rows)
                if after - mean_cosine(cos, rows) >= gain and not (veto and veto(a, b)):
                    out += [a, b]
                    continue
        out.append(rows)
    return out


def merge_by_entity(clusters: list[list[int]], tags: list[list[str]], v: np.ndarray, least: float = 0.75) -> list[list[int]]:
    """Clusters with a common entity whose centroids are alike become one."""
    groups = [list(c) for c in clusters]
    for entity in sorted({t for ts in tags for t in ts}):
        mine = [g for g in groups if any(entity in tags[i] for i in g)]
        if len(mine) < 2:
            continue
        cos = cosine_matrix(np.array([v[g].mean(axis=0) for g in mine]))
        top = list(range(len(mine)))
        for i in range(len(mine)):
            for j in range(i):
                if cos[i, j] >= least:
                    a, b = top[i], top[j]
                    top = [min(a, b) if t in (a, b) else t for t in top]
        groups = [g for g in groups if not any(g is m for m in mine)] + [sorted(i for k, m in enumerate(mine) if top[k] == t for i in m) for t in sorted(set(top))]
    return groups


def stratified_sample(v: np.ndarray, size: int, components: int = 10, groups: int = 10, seed: int = 0) -> np.ndarray:
    """Rows drawn evenly from k-means groups of the principal components, for judges that can't see all."""
    if len(v) <= size:
        return np.arange(len(v))
    x = v - v.mean(axis=0)
    x = x @ np.linalg.svd(x, full_matrices=False)[2][:components].T
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(groups, len(x)), replace=False)]
    for _ in range(20):
        label = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        centres = np.array([x[label == k].mean(axis=0) if (label == k).any() else c for k, c in enumerate(centres)])
    turn = np.empty(len(x), int)
    for k in range(len(centres)):
        mine = np.flatnonzero(label == k)
        turn[rng.permutation(mine)] = np.arange(len(mine))
    return np.sort(np.lexsort((label, turn))[:size])
