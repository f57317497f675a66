"""The density clustering of a small sample in plain numpy, against which the distributed one is held."""

import numpy as np


def spanning_tree(x: np.ndarray, min_samples: int) -> np.ndarray:
    """Edges (a, b, distance) of the minimum spanning tree of mutual reachability, by Prim's algorithm."""
    n = len(x)
    sq = (x * x).sum(axis=1)

    def row(i: int) -> np.ndarray:
        return np.sqrt(np.maximum(0, sq + sq[i] - 2 * (x @ x[i])))

    k = min(max(1, min_samples), n) - 1
    core = np.array([np.partition(row(i), k)[k] for i in range(n)])
    best, parent, inside = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    out, i = [], 0
    for _ in range(n - 1):
        inside[i] = True
        reach = np.maximum(np.maximum(row(i), core), core[i])
        closer = ~inside & (reach < best)
        best[closer], parent[closer] = reach[closer], i
        j = int(np.where(inside, np.inf, best).argmin())
        out.append((parent[j], j, best[j]))
        i = j
    return np.array(out, dtype=float).reshape(-1, 3)


def density_labels(x: np.ndarray, min_cluster_size: int = 5, min_samples: int = 1, method: str = "eom") -> np.ndarray:
    """Cluster of each row, -1 for noise, numbered by their first row."""
    n = len(x)
    if n < 2:
        return np.zeros(n, int)
    edges = spanning_tree(np.asarray(x, float), min_samples)
    edges = edges[np.argsort(edges[:, 2], kind="stable")]
    # single linkage: node n + k joins two nodes at its distance
    root, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)
    left, right, dist = [0] * (2 * n - 1), [0] * (2 * n - 1), [0.0] * (2 * n - 1)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, (a, b, d) in enumerate(edges):
        p, q, new = find(int(a)), find(int(b)), n + k
        root[p] = root[q] = new
        left[new], right[new], dist[new], size[new] = p, q, d, size[p] + size[q]

    def leaves(i: int) -> list[int]:
        stack, out = [i], []
        while stack:
            j = stack.pop()
            if j < n:
                out.append(j)
            else:
                stack += [left[j], right[j]]
        return out

    # condensed tree: a cluster loses points until both sides are large enough
    top = 2 * n - 2
    birth, stability, children, members = {0: 0.0}, {0: 0.0}, {0: []}, {0: []}
    work = [(top, 0)]
    while work:
        node, c = work.pop()
        lam = 1.0 / dist[node] if dist[node] > 0 else np.inf
        lam = min(lam, 1e12)
        p, q = left[node], right[node]
        if size[p] >= min_cluster_size and size[q] >= min_cluster_size:
            stability[c] += (lam - birth[c]) * size[node]
            for s in (p, q):
                new = len(birth)
                birth[new], stability[new], children[new], members[new] = lam, 0.0, [], []
                children[c].append(new)
                work.append((s, new)) if s >= n else members[new].append((s, lam))
        else:
            for s in (p, q):
                if size[s] >= min_cluster_size:
                    work.append((s, c)) if s >= n else members[c].append((s, lam))
                else:
                    gone = leaves(s)
                    stability[c] += (lam - birth[c]) * len(gone)
                    members[c] += [(g, lam) for g in gone]
    chosen: set[int] = set()
    if method == "leaf":
        chosen = {c for c in birth if not children[c] and c}
    else:
        value = {}
        for c in sorted(birth, reverse=True):
            below = sum(value[k] for k in children[c])
            if children[c] and (c == 0 or below > stability[c]):
                value[c] = below
            elif c:
                value[c] = stability[c]
                chosen.add(c)
            else:
                value[c] = below
    labels = np.full(n, -1)

    def descend(c: int, owner: int) -> None:
        stack = [(c, owner)]
        while stack:
            k, own = stack.pop()
            own = own if own >= 0 else (k if k in chosen else -1)
            for m, _ in members[k]:
                labels[m] = own
            stack += [(j, own) for j in children[k]]

    descend(0, -1)
    order = {}
    for v in labels:
        if v >= 0:
            order.setdefault(int(v), len(order))
    return np.array([order.get(int(v), -1) for v in labels])
