"""A small causal self-attention language model in numpy, with hand-written gradients.

A window holds `CONTEXT` ids that are only read and `SCORED` ids that are predicted, so overlapping windows
score every id once. One masked attention head, a dense layer, and a two-level output: the class of the
next symbol, then the symbol within its class. The most frequent symbols have slots; `SIZES` says how many of them each class holds,
few where they are frequent, so that most symbols are told from few others. A class has room for
`MEMBERS` slots; slots left empty have probability 0 and are not worked out. All other symbols share two
classes, one for symbols that open a word and one for those inside, whose inner distributions come from counts.

All weights lie in one flat array. What attention multiplies is read from a table (embedding times projections),
worked out once for each set of weights; the way back adds up by symbol first and passes the projections then.
Big arrays are kept and filled again.
"""

from __future__ import annotations

import numpy as np

CONTEXT, SCORED = 8, 24
WINDOW = CONTEXT + SCORED
#: Different symbols of each class, most frequent first.
SIZES = [16] * 4 + [32] * 4 + [64] * 4 + [128] * 12 + [64]
CLASSES, MEMBERS = len(SIZES), 128
SLOTS = CLASSES * MEMBERS
#: Slots that symbols take, class by class; the others stay empty.
TAKEN = np.concatenate([c * MEMBERS + np.arange(m) for c, m in enumerate(SIZES)])
EMPTY = np.float32(-1e9)
RARE, RARE_INSIDE, START = SLOTS, SLOTS + 1, SLOTS + 2
WIDTH, HIDDEN = 16, 32
SHAPES = {
    "in": (SLOTS + 3, WIDTH),
    "place": (WINDOW, WIDTH),
    "k": (WIDTH, WIDTH),
    "v": (WIDTH, WIDTH),
    "q": (WIDTH, WIDTH),
    "o": (WIDTH, WIDTH),
    "up": (WIDTH, HIDDEN),
    "up_bias": (HIDDEN,),
    "down": (HIDDEN, WIDTH),
    "class": (WIDTH, CLASSES + 2),
    "class_bias": (CLASSES + 2,),
    "member": (CLASSES, WIDTH, MEMBERS),
    "member_bias": (CLASSES, MEMBERS),
}
MASK = np.where(np.arange(WINDOW)[None, :] <= CONTEXT + np.arange(SCORED)[:, None], 0, -1e9).astype(np.float32)
GROUP = np.append(np.arange(SLOTS) // MEMBERS, [CLASSES, CLASSES + 1]).astype(np.uint8)
SCALE = np.float32(1 / np.sqrt(WIDTH))
#: Windows that go through the network together when scoring, so that their arrays stay in the cache.
TOGETHER = 128
#: Targets of a class that are scored together.
ROWS = 4096

_kept: dict[tuple, np.ndarray] = {}


def _room(name: str, shape: tuple, kind) -> np.ndarray:
    """An uninitialised array; the same memory each time for a name."""
    size = int(np.prod(shape))
    key = (name, np.dtype(kind))
    have = _kept.get(key)
    if have is None or have.size < size:
        have = _kept[key] = np.empty(size, kind)
    return have[:size].reshape(shape)


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def seats(counts: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The symbols that take the slots `TAKEN`. A class takes the most frequent ones left of one kind (opening a word or
    inside), that of the most frequent symbol left, so that the class says the kind; what the kind lacks the other fills."""
    ranked = np.argsort(-counts, kind="stable")
    left = [ranked[opens[ranked]], ranked[~opens[ranked]]]
    out = []
    for size in SIZES:
        heads = [counts[k[0]] if len(k) else -1 for k in left]
        for kind in (0, 1) if heads[0] >= heads[1] else (1, 0):
            out.append(left[kind][:size])
            left[kind] = left[kind][size:]
            size -= len(out[-1])
    return np.concatenate(out)


def start_weights(counts: np.ndarray, rare: float, rare_inside: float, seed: int = 0) -> np.ndarray:
    """Random weights whose output biases give the corpus frequencies of slots (counts; below 0: empty) and of the rare classes."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(sum(int(np.prod(s)) for s in SHAPES.values()), np.float32)
    w = views(flat)
    for name, spread in (("in", 0.3), ("place", 0.3), ("k", 0.3), ("v", 0.2), ("q", 0.3), ("o", 0.2), ("up", 0.2), ("down", 0.1), ("class", 0.05), ("member", 0.05)):
        w[name][:] = rng.normal(0, spread, SHAPES[name])
    by_class = np.where(counts < 0, 0, counts + 0.5).reshape(CLASSES, MEMBERS)
    w["class_bias"][:] = np.log(np.append(by_class.sum(1), [rare + 0.5, rare_inside + 0.5]))
    share = by_class / by_class.sum(1, keepdims=True)
    w["member_bias"][:] = np.where(share > 0, np.log(np.maximum(share, 1e-300)), EMPTY)
    return flat


def _sizes(w: dict) -> list[int]:
    """How many slots of each class are taken; empty ones stand behind them."""
    return (w["member_bias"] > EMPTY / 2).sum(axis=1).tolist()


def _projection(w: dict) -> np.ndarray:
    """What turns a vector into the one queries' vectors are multiplied with, and into its value as attention adds it."""
    return np.concatenate([w["k"] @ w["q"].T * w["in"].dtype.type(SCALE), w["v"] @ w["o"]], axis=1)


def tables(w: dict) -> dict:
    """w with keys and values (side by side) and plain vectors of every symbol and place."""
    out = dict(w)
    m = _projection(w)
    out["kv_table"], out["kv_place"] = w["in"] @ m, w["place"] @ m
    out["x_table"], out["x_place"] = w["in"], w["place"]
    longest = lambda name: float(sum(np.sqrt(np.square(out[f"{name}_{c}"][:, :WIDTH]).sum(axis=1).max()) for c in ("table", "place")))
    out["steep"] = longest("kv") * longest("x") > 60  # only then a product can be too large for exp
    return out


def _read(t: dict, name: str, ids: np.ndarray) -> np.ndarray:
    table = t[f"{name}_table"]
    out = _room(name, (*ids.shape, table.shape[1]), table.dtype)
    np.take(table, ids, axis=0, out=out, mode="clip")
    out += t[f"{name}_place"][-ids.shape[1] :]
    return out


def _states(t: dict, ids: np.ndarray, z: np.ndarray) -> tuple:
    """Fills z with the last states (windows * SCORED rows); what the way back needs."""
    kind, n = t["in"].dtype, len(ids)
    kv, x = _read(t, "kv", ids), _read(t, "x", ids[:, CONTEXT:])
    e = _room("e", (n, SCORED, WINDOW), kind)
    np.matmul(x, kv[:, :, :WIDTH].transpose(0, 2, 1), out=e)
    if t["steep"]:
        np.minimum(e, kind.type(60), out=e)
    e += MASK
    np.exp(e, out=e)
    total = np.matmul(e, np.ones(WINDOW, kind), out=_room("total", (n, SCORED), kind))
    c = np.matmul(e, kv[:, :, WIDTH:], out=_room("c", (n, SCORED, WIDTH), kind))
    c /= total[:, :, None]
    h = np.add(c, x, out=_room("h", x.shape, kind)).reshape(-1, WIDTH)
    g = np.matmul(h, t["up"], out=_room("g", (n * SCORED, HIDDEN), kind))
    g += t["up_bias"]
    np.maximum(g, 0, out=g)
    np.matmul(g, t["down"], out=z)
    z += h
    return kv, x, e, total, c, h, g


def _ordered(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[slice]]:
    """The order of the targets by class, the targets in it, and where each class (the rare ones too) stands in it."""
    group = np.take(GROUP, y)
    order = np.argsort(group, kind="stable")
    bounds = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=CLASSES + 2)))).tolist()
    return order, np.take(y, order), [slice(i, j) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def _exp(logits: np.ndarray, steep: bool) -> np.ndarray:
    """Turns logits into exp(logits) in place; their sums."""
    if steep:
        np.minimum(logits, logits.dtype.type(60), out=logits)
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], logits.dtype)


def _steep(t: dict, z: np.ndarray) -> bool:
    """Whether some logit could be too large for exp."""
    longest = np.sqrt(np.einsum("nd,nd->n", z, z).max(initial=0))
    columns = max(float(np.square(t[k]).sum(axis=-2).max()) for k in ("class", "member"))
    bias = max(float(t[k].max()) for k in ("class_bias", "member_bias"))
    return not float(longest) * columns**0.5 + bias < 60


def _picked(logits: np.ndarray, choice: np.ndarray) -> np.ndarray:
    return logits.ravel()[np.arange(0, logits.size, logits.shape[1]) + choice]


def log10_probabilities(t: dict, ids: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """log10 probability of every target (windows x SCORED), by tables(); rare symbols count as their class."""
    kind = t["in"].dtype
    z = _room("z", (targets.size, WIDTH), kind)
    for i in range(0, len(ids), TOGETHER):
        part = ids[i : i + TOGETHER]
        _states(t, part, z[i * SCORED : (i + len(part)) * SCORED])
    steep, sizes = _steep(t, z), _sizes(t)
    order, y, runs = _ordered(targets.ravel())
    z = np.take(z, order, axis=0, out=_room("sorted", z.shape, kind), mode="clip")
    member = y % MEMBERS
    got = np.empty(len(y), kind)
    for c, r in enumerate(runs):
        for i in range(r.start, r.stop, ROWS):
            part = slice(i, min(i + ROWS, r.stop))
            m = part.stop - i
            logits = np.matmul(z[part], t["class"], out=_room("classes", (m, CLASSES + 2), kind))
            logits += t["class_bias"]
            some = logits[:, c].copy()
            some -= np.log(_exp(logits, steep))
            if c < CLASSES:
                logits = np.matmul(z[part], t["member"][c, :, : sizes[c]], out=_room("members", (m, sizes[c]), kind))
                logits += t["member_bias"][c, : sizes[c]]
                some += _picked(logits, member[part])
                some -= np.log(_exp(logits, steep))
            got[part] = some
    got *= kind.type(1 / np.log(10))
    out = np.empty(len(y), kind)
    out[order] = got
    return out.reshape(targets.shape)


def _by_symbol(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that occur, ascending, and the sums of their rows."""
    flat = ids.astype(np.uint16).ravel()
    order = np.argsort(flat, kind="stable")
    at = flat[order]
    edges = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    rows = np.take(rows, order, axis=0, out=_room("by_symbol", rows.shape, rows.dtype), mode="clip")
    pairs = rows.view(np.result_type(rows.dtype, np.complex64))  # two numbers are added in one step
    return at[edges].astype(np.int64), np.add.reduceat(pairs, edges, axis=0).view(rows.dtype)


def gradients(w: dict, ids: np.ndarray, targets: np.ndarray, live: np.ndarray, out: dict | None = None, measure: bool = True) -> tuple[dict, float]:
    """Gradients of the mean negative log likelihood over live targets, and that mean (0 unless measured)."""
    t = tables(w)
    kind, n = w["in"].dtype, len(ids)
    out = {k: np.empty_like(v) for k, v in w.items()} if out is None else out
    z = _room("z", (n * SCORED, WIDTH), kind)
    kv, x, e, total, c, h, g = _states(t, ids, z)
    steep, sizes = _steep(w, z), _sizes(w)
    order, y, runs = _ordered(targets.ravel())
    on = np.take(live.ravel(), order)
    share = kind.type(1 / max(1, on.sum()))
    weight = on * share

    z = np.take(z, order, axis=0, out=_room("sorted", z.shape, kind), mode="clip")
    p = np.matmul(z, w["class"], out=_room("classes", (len(y), CLASSES + 2), kind))
    p += w["class_bias"]
    picked = np.concatenate([p[r, i] for i, r in enumerate(runs)]) if measure else 0
    total_p = _exp(p, steep)
    loss = -float((picked - np.log(total_p)) @ weight) if measure else 0.0
    p *= (weight / total_p)[:, None]
    for i, r in enumerate(runs):
        p[r, i] -= weight[r]
    np.matmul(z.T, p, out=out["class"])
    np.matmul(np.ones(len(y), kind), p, out=out["class_bias"])
    dz = np.matmul(p, w["class"].T, out=_room("dz", z.shape, kind))

    member = y % MEMBERS
    out["member"][:], out["member_bias"][:] = 0, 0
    for i, r in enumerate(runs[:CLASSES]):
        m, size = r.stop - r.start, sizes[i]
        if not m:
            continue
        inner = w["member"][i, :, :size]
        p = np.matmul(z[r], inner, out=_room("members", (m, size), kind))
        p += w["member_bias"][i, :size]
        picked = _picked(p, member[r]) if measure else 0
        total_p = _exp(p, steep)
        loss -= float((picked - np.log(total_p)) @ weight[r]) if measure else 0.0
        p *= (weight[r] / total_p)[:, None]
        p.ravel()[np.arange(0, p.size, size) + member[r]] -= weight[r]
        np.matmul(z[r].T, p, out=out["member"][i, :, :size])
        np.matmul(np.ones(m, kind), p, out=out["member_bias"][i, :size])
        dz[r] += np.matmul(p, inner.T, out=_room("back", (m, WIDTH), kind))
    place_of = np.empty(len(y), np.int64)
    place_of[order] = np.arange(len(y))
    dz = np.take(dz, place_of, axis=0, out=z, mode="clip")

    np.matmul(g.T, dz, out=out["down"])
    dg = np.matmul(dz, w["down"].T, out=_room("dg", g.shape, kind))
    dg *= g > 0
    np.matmul(h.T, dg, out=out["up"])
    np.matmul(np.ones(len(dg), kind), dg, out=out["up_bias"])
    dh = np.matmul(dg, w["up"].T, out=_room("dh", h.shape, kind))
    dh += dz
    dh = dh.reshape(c.shape)
    dc = np.divide(dh, total[:, :, None], out=_room("dc", c.shape, kind))
    de = np.matmul(dc, kv[:, :, WIDTH:].transpose(0, 2, 1), out=_room("de", e.shape, kind))
    de -= np.einsum("nsd,nsd->ns", dc, c)[:, :, None]
    de *= e
    dkv = _room("dkv", kv.shape, kind)
    np.matmul(de.transpose(0, 2, 1), x, out=dkv[:, :, :WIDTH])
    np.matmul(e.transpose(0, 2, 1), dc, out=dkv[:, :, WIDTH:])
    dh += np.matmul(de, kv[:, :, :WIDTH], out=dc)

    symbols, kv_sums = _by_symbol(dkv.reshape(-1, 2 * WIDTH), ids)
    scored, x_sums = _by_symbol(dh.reshape(-1, WIDTH), ids[:, CONTEXT:])
    kv_places, m = dkv.sum(axis=0), _projection(w)
    out["in"][:] = 0
    out["in"][symbols] = kv_sums @ m.T
    out["in"][scored] += x_sums
    np.matmul(kv_places, m.T, out=out["place"])
    out["place"][CONTEXT:] += dh.sum(axis=0)
    both = w["in"][symbols].T @ kv_sums + w["place"].T @ kv_places
    for_keys, for_values = both[:, :WIDTH] * kind.type(SCALE), both[:, WIDTH:]
    out["k"][:], out["q"][:] = for_keys @ w["q"], for_keys.T @ w["k"]
    out["v"][:], out["o"][:] = for_values @ w["o"].T, w["v"].T @ for_values
    return out, loss


def train(flat: np.ndarray, ids: np.ndarray, targets: np.ndarray, live: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> tuple[np.ndarray, float]:
    """`steps` Adam steps over the windows in shuffled order, again from the start when they run out."""
    rng = np.random.default_rng(seed)
    flat = flat.copy()
    w = views(flat)
    g, m, s, root = (np.zeros_like(flat) for _ in range(4))
    into = views(g)
    order = np.zeros(0, np.int64)
    losses = []
    for step in range(1, steps + 1):
        while len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(ids))])
        part, order = order[:batch], order[batch:]
        measure = step > steps - 20
        _, loss = gradients(w, ids[part], targets[part], live[part], into, measure)
        losses += [loss] * measure
        m *= np.float32(0.9)
        m += np.float32(0.1) * g
        np.square(g, out=root)
        root *= np.float32(0.01)
        s *= np.float32(0.99)
        s += root
        np.sqrt(s, out=root)
        root += np.float32(1e-6)
        np.divide(m, root, out=root)
        root *= np.float32(rate * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step))
        flat -= root
    return flat, float(np.mean(losses))


def windows(ids: np.ndarray, offsets: np.ndarray, start: int = START) -> tuple[np.ndarray, ...]:
    """Input ids, targets, live flags and owning document of all windows of some documents."""
    sizes = np.diff(offsets)
    counts = -(-sizes // SCORED)
    owner = np.repeat(np.arange(len(sizes)), counts)
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    # every document laid out behind CONTEXT + 1 start symbols and padded to whole windows
    lead = CONTEXT + 1
    begin = np.cumsum(lead + counts * SCORED) - (lead + counts * SCORED)
    padded = np.full(int((lead + counts * SCORED).sum()), start, ids.dtype)
    padded[np.arange(len(ids)) + np.repeat(begin + lead - offsets[:-1], sizes)] = ids
    base = (begin[owner] + step * SCORED)[:, None]
    live = np.arange(SCORED) < (sizes[owner] - step * SCORED)[:, None]
    inputs = np.take(padded, base + np.arange(WINDOW))
    return inputs, np.take(padded, base + lead + np.arange(SCORED)) * live, live, owner
