"""Learners whose fit is serial: each is a class with fit(x, y) and predict / score over NumPy arrays, run by grid.py as one
task per candidate. Rows are in the order of time, and none of these shuffles them."""

from __future__ import annotations

import heapq

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def class_weights(y: np.ndarray, balanced: bool) -> np.ndarray:
    if not balanced:
        return np.ones(len(y))
    n = np.bincount(y.astype(int), minlength=2)
    return len(y) / (2 * np.maximum(n, 1))[y.astype(int)]


def stopping_split(n: int, share: float = 0.15, purge: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Rows to learn from and the last share of rows, the purge rows between them left out."""
    start = n - int(np.ceil(n * share))
    return np.arange(max(0, start - purge)), np.arange(start, n)


class Classifier:
    cut = 0.5  # a label is 1 above it

    def predict(self, x):
        return (self.score(x) > self.cut).astype(int)


class Logistic(Classifier):
    """Weighted mean log loss with an L2 penalty on all but the constant, by gradient descent."""

    def __init__(self, penalty=0.01, rate=0.05, rounds=5000, balanced=False, tolerance=1e-8):
        self.penalty, self.rate, self.rounds, self.balanced, self.tolerance = penalty, rate, rounds, balanced, tolerance

    def fit(self, x, y):
        w, b, weight = np.zeros(x.shape[1]), 0.0, class_weights(y, self.balanced)
        weight = weight / weight.sum()
        for _ in range(self.rounds):
            e = weight * (sigmoid(x @ w + b) - y)
            gw, gb = x.T @ e + self.penalty * w, e.sum()
            w, b = w - self.rate * gw, b - self.rate * gb
            if max(np.abs(gw).max(), abs(gb)) < self.tolerance:
                break
        self.w, self.b = w, b
        return self

    def score(self, x):
        return sigmoid(x @ self.w + self.b)


class Perceptron(Classifier):
    """Updates on every row whose margin isn't positive, until an epoch has none."""

    cut = 0.0

    def __init__(self, rate=1.0, epochs=100):
        self.rate, self.epochs = rate, epochs

    def fit(self, x, y):
        s, w, b = 2 * y - 1, np.zeros(x.shape[1]), 0.0
        for _ in range(self.epochs):
            clean = True
            for row, t in zip(x, s):
                if t * (row @ w + b) <= 0:
                    w, b, clean = w + self.rate * t * row, b + self.rate * t, False
            if clean:
                break
        self.w, self.b = w, b
        return self

    def score(self, x):
        return x @ self.w + self.b


class KernelPerceptron(Classifier):
    """The perceptron in the space of a Gaussian kernel; keeps each row's number of updates."""

    cut = 0.0

    def __init__(self, gamma=1.0, epochs=20):
        self.gamma, self.epochs = gamma, epochs

    def kernel(self, a, b):
        return np.exp(-self.gamma * np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0))

    def fit(self, x, y):
        s, k, n = 2 * y - 1, self.kernel(x, x) + 1, np.zeros(len(x))
        for _ in range(self.epochs):
            clean = True
            for i in range(len(x)):
                if s[i] * (k[i] @ (n * s)) <= 0:
                    n[i], clean = n[i] + 1, False
            if clean:
                break
        keep = n > 0
        self.x, self.a = x[keep], (n * s)[keep]
        return self

    def score(self, x):
        return (self.kernel(x, self.x) + 1) @ self.a if len(self.a) else np.zeros(len(x))


class SigmoidUnit(Classifier):
    """One sigmoid unit on chronological mini-batches; the epoch with the least loss on the last rows is refitted on all."""

    def __init__(self, rate=0.05, epochs=200, batch=32, patience=10, balanced=False):
        self.rate, self.epochs, self.batch, self.patience, self.balanced = rate, epochs, batch, patience, balanced

    def _run(self, x, y, epochs, watch=None):
        w, b, weight = np.zeros(x.shape[1]), 0.0, class_weights(y, self.balanced)
        best, at, waited = np.inf, epochs, 0
        for epoch in range(1, epochs + 1):
            for i in range(0, len(x), self.batch):
                s = slice(i, i + self.batch)
                e = weight[s] * (sigmoid(x[s] @ w + b) - y[s])
                w, b = w - self.rate * x[s].T @ e / len(e), b - self.rate * e.mean()
            if watch is not None:
                p = np.clip(sigmoid(watch[0] @ w + b), 1e-15, 1 - 1e-15)
                now = -np.mean(watch[1] * np.log(p) + (1 - watch[1]) * np.log(1 - p))
                best, at, waited = (now, epoch, 0) if now < best else (best, at, waited + 1)
                if waited >= self.patience:
                    break
        return w, b, at

    def fit(self, x, y):
        a, z = stopping_split(len(x))
        epochs = self._run(x[a], y[a], self.epochs, (x[z], y[z]))[2] if len(a) and len(z) else self.epochs
        self.w, self.b, _ = self._run(x, y, epochs)
        return self

    def score(self, x):
        return sigmoid(x @ self.w + self.b)


class Network(Classifier):
    """One hidden layer of rectified units, Nesterov momentum, Glorot-uniform start, stopped and refitted like SigmoidUnit."""

    def __init__(self, hidden=8, rate=0.01, epochs=200, batch=32, patience=10, decay=1e-4, seed=42, balanced=False):
        self.hidden, self.rate, self.epochs, self.batch, self.patience, self.decay, self.seed, self.balanced = hidden, rate, epochs, batch, patience, decay, seed, balanced

    def _forward(self, p, x):
        h = np.maximum(x @ p[0] + p[1], 0)
        return h, sigmoid(h @ p[2] + p[3])

    def _run(self, x, y, epochs, watch=None):
        random, d, k = np.random.RandomState(self.seed), x.shape[1], self.hidden
        a, b = np.sqrt(6 / (d + k)), np.sqrt(6 / (k + 1))
        p = [random.uniform(-a, a, (d, k)), np.zeros(k), random.uniform(-b, b, k), np.zeros(1)]
        v, weight = [np.zeros_like(q) for q in p], class_weights(y, self.balanced)
        best, at, waited = np.inf, epochs, 0
        for epoch in range(1, epochs + 1):
            for i in range(0, len(x), self.batch):
                s = slice(i, i + self.batch)
                ahead = [q + 0.9 * u for q, u in zip(p, v)]
                h, out = self._forward(ahead, x[s])
                e = weight[s] * (out - y[s]) / len(out)
                back = np.outer(e, ahead[2]) * (h > 0)
                g = [x[s].T @ back + self.decay * ahead[0], back.sum(0), h.T @ e + self.decay * ahead[2], e.sum(keepdims=True)]
                v = [0.9 * u - self.rate * q for u, q in zip(v, g)]
                p = [q + u for q, u in zip(p, v)]
            if watch is not None:
                q = np.clip(self._forward(p, watch[0])[1], 1e-15, 1 - 1e-15)
                now = -np.mean(watch[1] * np.log(q) + (1 - watch[1]) * np.log(1 - q))
                best, at, waited = (now, epoch, 0) if now < best else (best, at, waited + 1)
                if waited >= self.patience:
                    break
        return p, at

    def fit(self, x, y):
        a, z = stopping_split(len(x))
        epochs = self._run(x[a], y[a], self.epochs, (x[z], y[z]))[1] if len(a) and len(z) else self.epochs
        self.p, _ = self._run(x, y, epochs)
        return self

    def score(self, x):
        return self._forward(self.p, x)[1]


class LinearSVM(Classifier):
    """Half the squared norm plus C times the hinge losses, by full subgradients with steps 1 / t; the best iterate is kept."""

    cut = 0.0

    def __init__(self, c=1.0, rounds=20_000):
        self.c, self.rounds = c, rounds

    def fit(self, x, y):
        self.mean = x.mean(0)
        z, s = np.hstack([x - self.mean, np.ones((len(x), 1))]), 2 * y - 1
        signed, w = z * s[:, None], np.zeros(x.shape[1] + 1)
        best, self.w = np.inf, w
        for t in range(1, self.rounds + 1):
            margin = 1 - signed @ w
            now = 0.5 * w[:-1] @ w[:-1] + self.c * np.maximum(margin, 0).sum()
            if now < best:
                best, self.w = now, w.copy()
            g = np.append(w[:-1], 0) - self.c * signed[margin > 0].sum(0)
            w = w - g / t
        self.objective = best
        return self

    def score(self, x):
        return (x - self.mean) @ self.w[:-1] + self.w[-1]


class Tree:
    """A regression tree on targets and weights: each node takes the split with the largest drop of weighted squared error.
    For 0/1 targets that is the Gini criterion. leaf(rows) gives a leaf's value."""

    def __init__(self, depth=3, leaf_rows=1, features=None, random=None, best_first=None):
        self.depth, self.leaf_rows, self.features, self.random, self.leaves = depth, leaf_rows, features, random, best_first

    def _split(self, x, y, w):
        best = None
        d = x.shape[1]
        order = np.arange(d) if self.features is None else np.sort(self.random.permutation(d)[: self.features])
        total, moment = w.sum(), (w * y).sum()
        for j in order:
            at = np.argsort(x[:, j], kind="stable")
            v, cw, cm = x[at, j], np.cumsum(w[at])[:-1], np.cumsum((w * y)[at])[:-1]
            i = np.arange(1, len(v))
            ok = (v[1:] > v[:-1]) & (i >= self.leaf_rows) & (len(v) - i >= self.leaf_rows) & (cw > 0) & (total - cw > 0)
            if ok.any():
                gain = np.where(ok, cm**2 / np.where(ok, cw, 1) + (moment - cm) ** 2 / np.where(ok, total - cw, 1), -np.inf) - moment**2 / total
                k = int(np.argmax(gain))
                if gain[k] > 1e-12 and (best is None or gain[k] > best[0] + 1e-12):
                    best = float(gain[k]), int(j), (v[k] + v[k + 1]) / 2
        return best

    def fit(self, x, y, w=None, leaf=None):
        w = np.ones(len(x)) if w is None else w
        leaf = leaf or (lambda rows: float(np.average(y[rows], weights=w[rows])))
        self.nodes: list = [None]
        heap = [(0.0, 0, 0, np.flatnonzero(w > 0))]
        grown = 1
        while heap:
            _, node, depth, rows = heapq.heappop(heap)
            found = None if depth >= self.depth or len(rows) < 2 * self.leaf_rows or (self.leaves and grown >= self.leaves) else self._split(x[rows], y[rows], w[rows])
            if not found:
                self.nodes[node] = leaf(rows)
                continue
            _, j, cut = found
            left = x[rows, j] <= cut
            a, b = len(self.nodes), len(self.nodes) + 1
            self.nodes += [None, None]
            self.nodes[node] = (j, cut, a, b)
            grown += 1
            for child, part in ((a, rows[left]), (b, rows[~left])):
                heapq.heappush(heap, (float(child), child, depth + 1, part))
        return self

    def value(self, x):
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            n = self.nodes[node]
            if isinstance(n, tuple):
                left = x[rows, n[0]] <= n[1]
                todo += [(n[2], rows[left]), (n[3], rows[~left])]
            else:
                out[rows] = n
        return out


class DecisionTree(Classifier):
    def __init__(self, depth=3, leaf_rows=1, balanced=False):
        self.depth, self.leaf_rows, self.balanced = depth, leaf_rows, balanced

    def fit(self, x, y):
        self.tree = Tree(self.depth, self.leaf_rows).fit(x, y.astype(float), class_weights(y, self.balanced))
        return self

    def score(self, x):
        return self.tree.value(x)


class RandomForest(Classifier):
    """Trees on bootstrap counts as weights and a root's share of the features at each split; probabilities are averaged."""

    def __init__(self, trees=50, depth=5, leaf_rows=1, seed=42):
        self.trees, self.depth, self.leaf_rows, self.seed = trees, depth, leaf_rows, seed

    def fit(self, x, y):
        random, k = np.random.RandomState(self.seed), max(1, int(np.sqrt(x.shape[1])))
        self.forest = [Tree(self.depth, self.leaf_rows, k, random).fit(x, y.astype(float), np.bincount(random.randint(0, len(x), len(x)), minlength=len(x)).astype(float)) for _ in range(self.trees)]
        return self

    def score(self, x):
        return np.mean([t.value(x) for t in self.forest], axis=0)


class GradientBoosting(Classifier):
    """Log loss: trees on residuals whose leaves take a Newton step, from the training log odds; margin 0 counts as 1."""

    def __init__(self, trees=50, rate=0.1, depth=2, leaf_rows=1):
        self.trees, self.rate, self.depth, self.leaf_rows = trees, rate, depth, leaf_rows

    def fit(self, x, y):
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start, self.stages = float(np.log(p / (1 - p))), []
        f = np.full(len(x), self.start)
        for _ in range(self.trees):
            p = sigmoid(f)
            r = y - p

            def leaf(rows, r=r, p=p):
                below = (p[rows] * (1 - p[rows])).sum()
                return float(r[rows].sum() / below) if below > 1e-150 else 0.0

            self.stages.append(Tree(self.depth, self.leaf_rows).fit(x, r, leaf=leaf))
            f = f + self.rate * self.stages[-1].value(x)
        return self

    def margin(self, x):
        return self.start + self.rate * sum(t.value(x) for t in self.stages)

    def score(self, x):
        return sigmoid(self.margin(x))

    def predict(self, x):
        return (self.margin(x) >= 0).astype(int)


class SecondOrderBoosting(Classifier):
    """Exact greedy trees on gradients and curvatures: gain G^2 / (H + lambda), pruned from below by gamma."""

    def __init__(self, trees=50, rate=0.1, depth=3, penalty=1.0, gamma=0.0, least_curvature=1.0):
        self.trees, self.rate, self.depth, self.penalty, self.gamma, self.least = trees, rate, depth, penalty, gamma, least_curvature

    def _grow(self, x, g, h, rows, depth):
        gs, hs = g[rows].sum(), h[rows].sum()
        value, best = -gs / (hs + self.penalty), None
        if depth < self.depth:
            for j in range(x.shape[1]):
                at = rows[np.argsort(x[rows, j], kind="stable")]
                v, cg, ch = x[at, j], np.cumsum(g[at])[:-1], np.cumsum(h[at])[:-1]
                ok = (v[1:] > v[:-1]) & (ch >= self.least) & (hs - ch >= self.least)
                if ok.any():
                    gain = np.where(ok, cg**2 / (ch + self.penalty) + (gs - cg) ** 2 / (hs - ch + self.penalty) - gs**2 / (hs + self.penalty), -np.inf)
                    k = int(np.argmax(gain))
                    if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                        best = float(gain[k]), j, (v[k] + v[k + 1]) / 2
        if best is None:
            return value
        left = x[rows, best[1]] < best[2]
        a, b = self._grow(x, g, h, rows[left], depth + 1), self._grow(x, g, h, rows[~left], depth + 1)
        if not isinstance(a, tuple) and not isinstance(b, tuple) and best[0] < self.gamma:
            return value
        return best[1], best[2], a, b

    def _value(self, node, x):
        if not isinstance(node, tuple):
            return np.full(len(x), node)
        left, out = x[:, node[0]] < node[1], np.zeros(len(x))
        out[left], out[~left] = self._value(node[2], x[left]), self._value(node[3], x[~left])
        return out

    def fit(self, x, y):
        x = x.astype(np.float32)
        f, self.stages = np.zeros(len(x)), []
        for _ in range(self.trees):
            p = sigmoid(f)
            self.stages.append(self._grow(x, p - y, p * (1 - p), np.arange(len(x)), 0))
            f = f + self.rate * self._value(self.stages[-1], x)
        return self

    def score(self, x):
        x = x.astype(np.float32)
        return sigmoid(self.rate * sum(self._value(t, x) for t in self.stages))


class AdaBoost(Classifier):
    """Boosted stumps; the score is twice the weighted mean of their votes."""

    cut = 0.0

    def __init__(self, stumps=50, rate=1.0):
        self.stumps, self.rate = stumps, rate

    def fit(self, x, y):
        s, w, self.stages = 2 * y - 1, np.full(len(x), 1 / len(x)), []
        for _ in range(self.stumps):
            stump = Tree(1).fit(x, y.astype(float), w)
            vote = np.where(stump.value(x) > 0.5, 1, -1)
            e = float(w[vote != s].sum())
            if e >= 0.5:
                break
            a = self.rate * float(np.log((1 - max(e, 1e-12)) / max(e, 1e-12)))
            self.stages.append((a, stump))
            if e <= 1e-12:
                break
            w = w * np.exp(a * (vote != s))
            w = w / w.sum()
        return self

    def score(self, x):
        total = sum(a for a, _ in self.stages)
        return 2 * sum(a * np.where(t.value(x) > 0.5, 1, -1) for a, t in self.stages) / total if total else np.zeros(len(x))


class Neighbours(Classifier):
    def __init__(self, k=5, weighting="uniform"):
        self.k, self.weighting = k, weighting

    def fit(self, x, y):
        self.x, self.y = x, y
        return self

    def score(self, x):
        d = np.sqrt(np.maximum(((x[:, None, :] - self.x[None]) ** 2).sum(2), 0))
        near = np.argsort(d, axis=1, kind="stable")[:, : self.k]
        nd = np.take_along_axis(d, near, 1)
        with np.errstate(divide="ignore"):
            w = np.ones_like(nd) if self.weighting == "uniform" else np.where((nd == 0).any(1, keepdims=True), nd == 0, 1 / nd)
        return (w * self.y[near]).sum(1) / w.sum(1)


class Stacking(Classifier):
    """Logistic regression over the out-of-sample probabilities of three models, from expanding folds with a purge."""

    def __init__(self, folds=4, first=0.5, purge=5):
        self.folds, self.first, self.purge = folds, first, purge

    def bases(self):
        return [Logistic(rounds=1000), DecisionTree(), Neighbours()]

    def fit(self, x, y):
        from tidemark.operators.splits import fold_plan

        rows, parts = [], []
        for _, until, start, stop in fold_plan(len(x), self.folds, self.first, self.purge):
            if until > 0 and stop > start:
                parts.append(np.column_stack([m.fit(x[:until], y[:until]).score(x[start:stop]) for m in self.bases()]))
                rows.append(np.arange(start, stop))
        rows = np.concatenate(rows)
        self.meta = Logistic(rounds=2000, rate=0.5).fit(np.concatenate(parts), y[rows])
        self.models = [m.fit(x, y) for m in self.bases()]
        return self

    def score(self, x):
        return self.meta.score(np.column_stack([m.score(x) for m in self.models]))


class KMeans:
    """Lloyd's algorithm from k-means++ starts that try several points each; an empty cluster keeps its centre."""

    def __init__(self, k=3, restarts=10, rounds=300, seed=42):
        self.k, self.restarts, self.rounds, self.seed = k, restarts, rounds, seed

    def _start(self, x, random):
        centers = [x[random.randint(len(x))]]
        near = ((x - centers[0]) ** 2).sum(1)
        for _ in range(1, self.k):
            tries = random.choice(len(x), 2 + int(np.log(self.k)), p=near / near.sum()) if near.sum() > 0 else random.randint(0, len(x), 1)
            options = [np.minimum(near, ((x - x[t]) ** 2).sum(1)) for t in tries]
            best = int(np.argmin([o.sum() for o in options]))
            near = options[best]
            centers.append(x[tries[best]])
        return np.array(centers)

    def fit(self, x, y=None):
        random, self.inertia = np.random.RandomState(self.seed), np.inf
        for _ in range(self.restarts):
            c = self._start(x, random)
            for _ in range(self.rounds):
                label = ((x[:, None] - c) ** 2).sum(2).argmin(1)
                new = np.array([x[label == i].mean(0) if (label == i).any() else c[i] for i in range(self.k)])
                if np.allclose(new, c, atol=1e-10):
                    break
                c = new
            inertia = float(((x - c[label]) ** 2).sum())
            if inertia < self.inertia:
                self.inertia, self.centers = inertia, c
        return self

    def predict(self, x):
        return ((x[:, None] - self.centers) ** 2).sum(2).argmin(1)


class Agglomerative:
    """Merges the two nearest clusters (Ward or average linkage, ties to the first in row order) until k are left; new points
    go to the nearest centroid."""

    def __init__(self, k=2, linkage="ward"):
        self.k, self.linkage = k, linkage

    def fit(self, x, y=None):
        n = len(x)
        d = ((x[:, None] - x) ** 2).sum(2)
        d = d if self.linkage == "ward" else np.sqrt(d)
        np.fill_diagonal(d, np.inf)
        size, label = np.ones(n), np.arange(n)
        for _ in range(n - self.k):
            i, j = sorted(divmod(int(np.argmin(d)), n))
            a, b = size[i], size[j]
            if self.linkage == "ward":
                new = ((a + size) * d[i] + (b + size) * d[j] - size * d[i, j]) / (a + b + size)
            else:
                new = (a * d[i] + b * d[j]) / (a + b)
            new[i] = new[j] = np.inf
            new[~np.isfinite(d[i])] = np.inf
            d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
            size[i] += b
            label[label == j] = i
        _, self.label = np.unique(label, return_inverse=True)
        self.centers = np.array([x[self.label == i].mean(0) for i in range(self.k)])
        return self

    def predict(self, x):
        return ((x[:, None] - self.centers) ** 2).sum(2).argmin(1)


REGISTRY: dict[str, type] = {
    "logistic": Logistic, "perceptron": Perceptron, "kernel_perceptron": KernelPerceptron, "slp": SigmoidUnit, "mlp": Network, "svm": LinearSVM,
    "decision_tree": DecisionTree, "random_forest": RandomForest, "gradient_boosting": GradientBoosting, "xgboost": SecondOrderBoosting,
    "adaboost": AdaBoost, "knn": Neighbours, "stacking": Stacking, "kmeans": KMeans, "agglomerative": Agglomerative,
}
