"""Small generative networks on NumPy: VAE, GAN, VAE-GAN, TimeGAN, a window GAN and the LSTM predictor.

Weights are lists inside a model's JSON, so a fit is one row and any executor samples.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np

from seriesmill.functions import autodiff as ad
from seriesmill.functions.autodiff import Adam, Dense, Gru, Lstm, Mlp, Node, bce, concat


def weights(*nets) -> list[list]:
    return [p.value.tolist() for net in nets for p in net.params]


def restore(values: list, *nets) -> None:
    for p, v in zip([p for net in nets for p in net.params], values):
        p.value = np.array(v, float)


def windows_of(x: np.ndarray, width: int) -> np.ndarray:
    if len(x) < width:
        raise ValueError(f"a window of {width} needs more than {len(x)} rows")
    return np.lib.stride_tricks.sliding_window_view(x, width).copy()


def cyclic(n: int, hours: int = 4) -> np.ndarray:
    """Sine and cosine of the hour and weekday (period 5) of places on a regular grid."""
    t = np.arange(n) * hours
    hour, day = t % 24 / 24, t // 24 % 7 / 5
    return np.column_stack([f(2 * np.pi * v) for v in (hour, day) for f in (np.sin, np.cos)])


def batches(rng: np.random.Generator, n: int, size: int):
    order = rng.permutation(n)
    return [order[i : i + size] for i in range(0, n, size)]


# A GAN over short windows of returns.


def train_window_gan(r: np.ndarray, width: int, epochs: int, rng: np.random.Generator, latent: int = 8, hidden: int = 32) -> dict[str, Any]:
    mean, std = float(r.mean()), float(r.std() + 1e-10)
    x = windows_of((r - mean) / std, width)
    x = x[:: max(1, width // 2)] if len(x) // max(1, width // 2) >= 4 else x
    g, d = Mlp(rng, [latent, hidden, width]), Mlp(rng, [width, hidden, 1])
    og, od = Adam(g.params, 2e-4, (0.5, 0.999)), Adam(d.params, 2e-4, (0.5, 0.999))
    for _ in range(epochs):
        for b in batches(rng, len(x), 32):
            z = rng.standard_normal((len(b), latent))
            od.step(bce(d(x[b]), True) + bce(d(g(z).value), False))
            og.step(bce(d(g(z)), True))
    return {"mean": mean, "std": std, "latent": latent, "hidden": hidden, "width": width, "weights": weights(g)}


def sample_window_gan(net: dict[str, Any], rng: np.random.Generator) -> np.ndarray:
    g = Mlp(np.random.default_rng(0), [net["latent"], net["hidden"], net["width"]])
    restore(net["weights"], g)
    return g(rng.standard_normal((1, net["latent"]))).value[0] * net["std"] + net["mean"]


# VAE, GAN and both together, conditional on the time of a window's last step.


def _mmd(a: Node, b: Node) -> Node:
    """Gaussian-kernel discrepancy; the width follows the first side's mean squared distance."""

    def d2(x: Node, y: Node) -> Node:
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        n, m = x.shape[0], y.shape[0]
        return xx[:, None] * np.ones((1, m)) + yy[None, :] * np.ones((n, 1)) - 2.0 * (x @ Node(y.value.T, [(y, lambda g: g.T)]))

    aa = d2(a, a)
    gamma = 1.0 / (float(aa.value.mean()) + 1e-8)
    return (aa * -gamma).exp().mean() + (d2(b, b) * -gamma).exp().mean() - 2.0 * (d2(a, b) * -gamma).exp().mean()


def _nets(width: int, latent: int, hidden: Sequence[int], cond: int, activation: str = "tanh", judge: Sequence[int] | None = None, dropout: float = 0.0):
    rng = np.random.default_rng(0)
    judge = hidden if judge is None else judge
    return (
        Mlp(rng, [width + cond, *hidden, 2 * latent], activation), Mlp(rng, [latent + cond, *reversed(hidden), width], activation), Mlp(rng, [width + cond, *judge, 1], "leaky", dropout),
    )


def _fit_vae_gan(
    prices: np.ndarray, mode: str, width: int = 24, latent: int = 8, hidden: Sequence[int] = (48, 24), epochs: int = 20, batch: int = 128, kl: float = 1e-3, anneal: int = 10, mmd: float = 1e-2, rate: float = 1e-3, adv_rate: float = 1e-4,
    judge_rate: float = 1e-4, judge: Sequence[int] | None = None, dropout: float = 0.3, activation: str = "tanh", patience: int = 120, warm: int = 15, min_delta: float = 1e-7, l2: float = 1e-6, returns: bool = True, conditional: bool = True, seed: int = 42,
) -> dict[str, Any]:
    """mode: vae_gan, vae (no discriminator) or gan (the decoder alone, no early stop). returns: the windows are of log returns, else of prices."""
    r = np.diff(np.log(np.maximum(prices, 1e-10))) if returns else np.asarray(prices, float)
    mean, std = float(r.mean()), float(r.std() + 1e-10)
    x = windows_of((r - mean) / std, width)
    cond = cyclic(len(r) + 1)[1:][width - 1 :] if conditional else np.zeros((len(x), 0))
    enc, dec, dis = _nets(width, latent, hidden, cond.shape[1], activation, judge, dropout)
    o_vae, o_gen, o_dis = Adam([*enc.params, *dec.params], rate), Adam(dec.params, adv_rate), Adam(dis.params, judge_rate)
    rng, best, best_w, waited = np.random.default_rng(seed), np.inf, weights(dec), 0
    for epoch in range(1, epochs + 1):
        total = 0.0
        for b in batches(rng, len(x), batch):
            z0 = rng.standard_normal((len(b), latent))
            if mode != "gan":
                stats = enc(np.hstack([x[b], cond[b]]))
                mu, logvar = stats[:, :latent], stats[:, latent:]
                z = mu + (logvar * 0.5).exp() * z0
                out = dec(concat([z, cond[b]]))
                loss = ((out - x[b]) * (out - x[b])).mean()
                loss = loss + (mu * mu + logvar.exp() - logvar - 1.0).mean() * (0.5 * kl * min(1.0, epoch / max(1, anneal))) + _mmd(Node(x[b]), out) * mmd
                for p in dec.params:
                    loss = loss + (p * p).sum() * l2
                total += o_vae.step(loss) * len(b)
            if mode != "vae":
                fake = dec(np.hstack([z0, cond[b]]))
                o_dis.step(bce(dis(np.hstack([x[b], cond[b]]), rng), True) + bce(dis(np.hstack([fake.value, cond[b]]), rng), False))
                adv = o_gen.step(bce(dis(concat([dec(np.hstack([z0, cond[b]])), cond[b]])), True))
                total += adv * len(b) if mode == "gan" else 0.0
        if mode == "gan":
            best_w = weights(dec)
        elif total < best - min_delta:
            best, best_w, waited = total, weights(dec), 0
        elif epoch > warm:
            waited += 1
            if waited >= patience:
                break
    model = {"kind": mode, "width": width, "latent": latent, "hidden": list(hidden), "activation": activation, "cond": cond.shape[1], "returns": returns}
    return model | {"mean": mean, "std": std, "weights": best_w, "anchors": np.asarray(prices, float).tolist()}


def fit_vae_gan(prices: np.ndarray, **options) -> dict[str, Any]:
    return _fit_vae_gan(prices, "vae_gan", **options)


def fit_vae(prices: np.ndarray, **options) -> dict[str, Any]:
    return _fit_vae_gan(prices, "vae", **options)


def fit_gan(prices: np.ndarray, **options) -> dict[str, Any]:
    return _fit_vae_gan(prices, "gan", **options)


def _from_windows(w: np.ndarray, n: int, anchors: Sequence[float], rng: np.random.Generator, p0: float | None, keep: bool = True) -> np.ndarray:
    """Windows of returns without their means, each a path from an anchor drawn from all prices; keep: the anchor is its first price."""
    w = w - w.mean(axis=1, keepdims=True)
    starts = rng.choice(np.asarray(anchors), len(w)) if p0 is None else np.full(len(w), p0)
    paths = starts[:, None] * np.exp(np.concatenate([np.zeros((len(w), 1)), np.cumsum(w, axis=1)], axis=1))
    return (paths if keep else paths[:, 1:]).ravel()[:n]


def sample_vae_gan(model: dict[str, Any], n: int, rng: np.random.Generator, p0: float | None = None) -> np.ndarray:
    _, dec, _ = _nets(model["width"], model["latent"], model["hidden"], model["cond"], model["activation"])
    restore(model["weights"], dec)
    length = model["width"] + 1 if model["returns"] else model["width"]
    count = -(-n // length)
    cond = cyclic(count * length)[length - 1 :: length] if model["cond"] else np.zeros((count, 0))
    out = dec(np.hstack([rng.standard_normal((count, model["latent"])), cond])).value * model["std"] + model["mean"]
    return _from_windows(out, n, model["anchors"], rng, p0) if model["returns"] else out.ravel()[:n]


# TimeGAN: embedder, recovery, supervisor, generator, discriminator.


def _time_nets(hidden: int, latent: int):
    rng = np.random.default_rng(0)
    return {"emb": Gru(rng, 1, hidden, latent), "rec": Gru(rng, latent, hidden, 1), "sup": Gru(rng, latent, hidden, latent), "gen": Gru(rng, latent, hidden, latent), "dis": Gru(rng, latent, hidden, 1, squash=False)}


def _gap(a: Sequence[Node], b: Sequence) -> Node:
    total = None
    for p, q in zip(a, b):
        d = p - q
        total = (d * d).mean() if total is None else total + (d * d).mean()
    return total * (1.0 / len(a))


def fit_timegan(prices: np.ndarray, width: int = 12, hidden: int = 12, latent: int = 4, epochs: int = 4, batch: int = 128, rate: float = 1e-3, seed: int = 42, holdout: float = 0.15) -> dict[str, Any]:
    """Autoencoder, then supervisor, then all together (adversarial + 10 supervised + 100 moments); the best held-out weights stay."""
    r = np.diff(np.log(np.maximum(prices, 1e-10)))
    lo, span = float(r.min()), float(np.ptp(r)) if np.ptp(r) > 1e-10 else 1.0
    x = windows_of((r - lo) / span, width)
    n_val = max(1, int(holdout * len(x)))
    train, val = x[:-n_val] if len(x) > n_val else x, x[-n_val:]
    nets, rng = _time_nets(hidden, latent), np.random.default_rng(seed)
    steps = lambda m: [m[:, t : t + 1] for t in range(m.shape[1])]
    noise = lambda n: [rng.random((n, latent)) for _ in range(width)]
    auto = Adam(nets["emb"].params + nets["rec"].params, rate)
    for _ in range(epochs):
        for b in batches(rng, len(train), batch):
            s = steps(train[b])
            auto.step(_gap(nets["rec"](nets["emb"](s)), s))
    sup = Adam(nets["sup"].params, rate)
    for _ in range(epochs):
        for b in batches(rng, len(train), batch):
            h = [Node(v.value) for v in nets["emb"](steps(train[b]))]
            sup.step(_gap(nets["sup"](h)[:-1], h[1:]))
    gen, dis = Adam(nets["gen"].params + nets["sup"].params, rate), Adam(nets["dis"].params, rate)
    best, kept = np.inf, weights(*nets.values())
    for _ in range(epochs):
        for b in batches(rng, len(train), batch):
            s = steps(train[b])
            real = [Node(v.value) for v in nets["emb"](s)]
            fake = nets["sup"](nets["gen"](noise(len(b))))
            u = sum((bce(y, True) for y in nets["dis"](fake)), ad.lift(0.0)) * (1.0 / width)
            out = concat(nets["rec"](fake))
            target = np.hstack(s)
            mean_gap = (out.mean(0) - target.mean(axis=0)).abs().mean()
            centred = out - out.mean(0)
            std_gap = ((centred * centred).mean(0).sqrt() - target.std(axis=0)).abs().mean()
            gen.step(u + _gap(nets["sup"](real)[:-1], real[1:]) * 10.0 + (mean_gap + std_gap) * 100.0)
            d = sum((bce(y, True) for y in nets["dis"](real)), ad.lift(0.0)) + sum((bce(y, False) for y in nets["dis"]([Node(v.value) for v in fake])), ad.lift(0.0))
            dis.step(d * (1.0 / width))
            auto.step(_gap(nets["rec"](nets["emb"](s)), s))
        made = np.hstack([v.value for v in nets["rec"](nets["sup"](nets["gen"](noise(len(val)))))])
        score = float(np.abs(made.mean(axis=0) - val.mean(axis=0)).mean() + np.abs(made.std(axis=0) - val.std(axis=0)).mean())
        if score < best:
            best, kept = score, weights(*nets.values())
    return {"kind": "timegan", "width": width, "hidden": hidden, "latent": latent, "lo": lo, "span": span, "weights": kept, "anchors": np.asarray(prices, float).tolist()}


def sample_timegan(model: dict[str, Any], n: int, rng: np.random.Generator, p0: float | None = None) -> np.ndarray:
    nets = _time_nets(model["hidden"], model["latent"])
    restore(model["weights"], *nets.values())
    count = -(-n // model["width"])
    z = [rng.random((count, model["latent"])) for _ in range(model["width"])]
    out = np.hstack([v.value for v in nets["rec"](nets["sup"](nets["gen"](z)))]) * model["span"] + model["lo"]
    return _from_windows(out, n, model["anchors"], rng, p0, keep=False)


# The predictor of the utility tests.


def pairs_of(prices: np.ndarray, width: int, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    if len(prices) < width + horizon:
        raise ValueError(f"a window of {width} and a horizon of {horizon} need more than {len(prices)} rows")
    w = windows_of(prices, width)[: len(prices) - width - horizon + 1]
    return w, prices[width + horizon - 1 :]


def train_predictor(train: np.ndarray, others: dict[str, np.ndarray], width: int = 24, horizon: int = 1, epochs: int = 5, batch: int = 64, hidden: int = 32, seed: int = 0) -> dict[str, float]:
    """LSTM, a dense layer and one output, on standardised prices -> mean absolute error of each set."""
    x, y = pairs_of(train, width, horizon)
    mean, std = float(train.mean()), float(train.std() + 1e-12)
    rng = np.random.default_rng(seed)
    net, mid, out = Lstm(rng, 1, hidden), Dense(rng, hidden, 16), Dense(rng, 16, 1)
    opt = Adam([*net.params, *mid.params, *out.params], 1e-3)
    scale = lambda v: (v - mean) / std

    def predict(w: np.ndarray) -> Node:
        s = scale(w)
        return out(mid(net([s[:, t : t + 1] for t in range(width)])).leaky(0.0))

    for _ in range(epochs):
        for b in batches(rng, len(x), batch):
            gap = predict(x[b]) - scale(y[b])[:, None]
            opt.step((gap * gap).mean())
    errors = {}
    for name, series in {"train": train, **others}.items():
        w, t = pairs_of(series, width, horizon)
        errors[name] = float(np.abs(predict(w).value[:, 0] * std + mean - t).mean())
    return errors
