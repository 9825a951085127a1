"""Multilayer perceptrons and a restricted Boltzmann machine.

A pass over a large table is one epoch of gradients summed over all rows; on a table that is read to the driver an epoch
is steps on mini-batches. Both follow the same optimiser.
"""

from __future__ import annotations

import numpy as np

from tessera.core import Classifier, Regressor, Transformer, apply, codes, expit, moments, softmax

ACTIVATIONS = {"relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float)), "tanh": (np.tanh, lambda a: 1 - a * a), "logistic": (expit, lambda a: a * (1 - a)), "identity": (lambda z: z, np.ones_like)}


class _MLP:
    DEFAULTS = {
        "hidden_layer_sizes": (100,), "activation": "relu", "solver": "adam", "alpha": 0.0001, "batch_size": 200, "learning_rate": 0.001, "max_iter": 200, "random_state": 0, "tol": 1e-4, "verbose": False, "warm_start": False,
        "momentum": 0.9, "nesterovs_momentum": True, "early_stopping": False, "validation_fraction": 0.1, "beta_1": 0.9, "beta_2": 0.999, "epsilon": 1e-8, "n_iter_no_change": 10,
    }

    def _forward(self, x, weights):
        act, out = ACTIVATIONS[self.activation][0], [x]
        for i, (w, b) in enumerate(weights):
            z = out[-1] @ w + b
            out.append(z if i == len(weights) - 1 else act(z))
        return out

    def _gradients(self, x, y, weights):
        """Loss and gradients, summed over rows."""
        outs = self._forward(x, weights)
        delta, loss = self._head(outs[-1], y)
        grads = []
        for i in range(len(weights) - 1, -1, -1):
            grads.append((outs[i].T @ delta, delta.sum(0)))
            if i:
                delta = delta @ weights[i][0].T * ACTIVATIONS[self.activation][1](outs[i])
        return loss, grads[::-1]

    def _train(self, data, outputs):
        if self.activation not in ACTIVATIONS or self.solver not in ("adam", "sgd"):
            raise ValueError("unknown activation or solver")
        n, mean, g = moments(data)
        p = len(data.features)
        self.mean_, self.scale_ = mean[:p], np.sqrt(np.maximum(np.diag(g)[:p] / n, 0))
        self.scale_[self.scale_ == 0] = 1.0
        rng = np.random.default_rng(max(0, self.random_state))
        sizes = [p, *self.hidden_layer_sizes, outputs]
        if not (self.warm_start and self.__dict__.get("weights_")):
            self.weights_ = [(rng.standard_normal((a, b)) * np.sqrt(2 / (a + b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        state = [[np.zeros_like(v) for v in wb] for wb in self.weights_], [[np.zeros_like(v) for v in wb] for wb in self.weights_]
        step, best, stale, self.loss_curve_ = 0, np.inf, 0, []

        def update(grads, m):
            nonlocal step
            step += 1
            new = []
            for layer, ((w, b), (gw, gb)) in enumerate(zip(self.weights_, grads, strict=True)):
                pair = []
                for j, (v, d) in enumerate(((w, gw / m + self.alpha * w / m), (b, gb / m))):
                    a, s = state[0][layer], state[1][layer]
                    if self.solver == "adam":
                        a[j] = self.beta_1 * a[j] + (1 - self.beta_1) * d
                        s[j] = self.beta_2 * s[j] + (1 - self.beta_2) * d * d
                        v = v - self.learning_rate * (a[j] / (1 - self.beta_1**step)) / (np.sqrt(s[j] / (1 - self.beta_2**step)) + self.epsilon)
                    else:
                        a[j] = self.momentum * a[j] - self.learning_rate * d
                        v = v + (self.momentum * a[j] - self.learning_rate * d if self.nesterovs_momentum else a[j])
                    pair.append(v)
                new.append(tuple(pair))
            self.weights_ = new

        for _ in range(self.max_iter):
            if data.is_local:
                x, y, _ = data.split(data._read())
                held = np.zeros(len(x), bool)
                if self.early_stopping:
                    held[np.random.default_rng(0).permutation(len(x))[: max(1, int(len(x) * self.validation_fraction))]] = True
                z, loss = (x - self.mean_) / self.scale_, 0.0
                order = rng.permutation(np.flatnonzero(~held))
                for at in range(0, len(order), self.batch_size):
                    i = order[at : at + self.batch_size]
                    one, grads = self._gradients(z[i], y[i], self.weights_)
                    loss += one
                    update(grads, len(i))
                loss = self._gradients(z[held], y[held], self.weights_)[0] / held.sum() if self.early_stopping else loss / len(order)
            else:
                def fn(x, y, w, weights=self.weights_):
                    one, grads = self._gradients((x - self.mean_) / self.scale_, y, weights)
                    return np.array([one]), *(v for pair in grads for v in pair)

                one, *flat = data.sum(fn)
                loss = float(one[0]) / n
                update(list(zip(flat[::2], flat[1::2], strict=True)), n)
            self.loss_curve_.append(loss)
            stale = stale + 1 if loss > best - self.tol else 0
            best = min(best, loss)
            if stale >= self.n_iter_no_change:
                break


class MLPClassifier(_MLP, Classifier):
    def _head(self, z, y):
        c = codes(self.classes_, y)
        p = softmax(z)
        loss = -np.log(np.maximum(p[np.arange(len(c)), c], 1e-300)).sum()
        p[np.arange(len(c)), c] -= 1
        return p, loss

    def _fit(self, data):
        self._train(data, len(self.classes_))

    def proba_rows(self, x):
        return softmax(self._forward((x - self.mean_) / self.scale_, self.weights_)[-1])


class MLPRegressor(_MLP, Regressor):
    def _head(self, z, y):
        r = z[:, 0] - (y - self.y_mean_) / self.y_scale_
        return r[:, None], 0.5 * (r * r).sum()

    def _fit(self, data):
        n, mean, g = moments(data)
        self.y_mean_, self.y_scale_ = float(mean[-1]), float(np.sqrt(g[-1, -1] / n)) or 1.0
        self._train(data, 1)

    def predict_rows(self, x):
        return self._forward((x - self.mean_) / self.scale_, self.weights_)[-1][:, 0] * self.y_scale_ + self.y_mean_


class BernoulliRBM(Transformer):
    """Contrastive divergence with mean fields, one pass a round; outputs are hidden probabilities."""

    DEFAULTS = {"n_components": 256, "learning_rate": 0.1, "batch_size": 10, "n_iter": 10, "random_state": 0, "verbose": False}

    def _fit(self, data):
        rng, p, k = np.random.default_rng(max(0, self.random_state)), len(data.features), self.n_components
        w, b, c = rng.standard_normal((p, k)) * 0.01, np.zeros(p), np.zeros(k)
        for _ in range(self.n_iter):
            def fn(x, y, wt, w=w, b=b, c=c):
                h = expit(x @ w + c)
                v = expit(h @ w.T + b)
                g = expit(v @ w + c)
                return x.T @ h - v.T @ g, (x - v).sum(0), (h - g).sum(0)

            dw, db, dc = data.sum(fn)
            rate = self.learning_rate / data.n
            w, b, c = w + rate * dw, b + rate * db, c + rate * dc
        self.components_, self.intercept_visible_, self.intercept_hidden_ = w, b, c

    def outputs(self):
        return [f"hidden{i}" for i in range(self.n_components)]

    def transform(self, df):
        self._check(df)
        return apply(df, self.features_, lambda x: dict(zip(self.outputs(), expit(x @ self.components_ + self.intercept_hidden_).T, strict=True)), dict.fromkeys(self.outputs(), "double")).drop(*self.features_)
