"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are words and their characters: a word's input is its embedding (words seen in
training; one vector for all others) and the last states of a character network run both
ways over it. A second network runs both ways over the words of a window, attention pools
its states, and a logistic unit scores the window. All overlapping windows of a text are
scored; a document's score is the largest.

Training uses every labelled document, with its whole text. Each epoch takes all toxic
documents and a share of the others, so that each of these is taken once at least over the
epochs, and as often as there are fewer of them; their windows weigh no more in all than the
toxic ones. Documents lie in parts by a hash; in each of an epoch's rounds every part takes
steps of its own from the same state, and the states are averaged by windows. Words of
most documents (``VOCABULARY`` of them, counted over all) have an embedding. Labels are of
documents, so windows of toxic documents start as toxic, and in the later epochs only those
that the model itself finds likely (and each document's likeliest) stay so. The threshold
(greatest F1) is set by the scores of all labelled documents, which were trained on too: F1
there flatters the model. Repeated rows count as often as they are there.

Defined cases: null and wordless texts have no window and score 0; a null doc_id is
carried through; repeated rows are scored each; extra columns are ignored; an empty table
gives an empty result; :func:`train` without both classes raises ValueError, and where the
labelled documents of :func:`classify` hold one class or none there is nothing to learn
from: windows, score and verdict are null. Runs of over 16 letters are read 16 at a time,
as words of their own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, plain, saved, small_side
from quarry.shared import scratch

#: Words of a window, and how far windows are apart: half of it, so that whatever is no
#: longer than that lies whole in a window.
WINDOW, STRIDE = 48, 24
#: Windows scored at a time.
BLOCK = 1024
#: Windows of a training step that are in memory at a time.
SLICE = 512
CHARS, CHAR_DIM, CHAR_HIDDEN, WORD_DIM, HIDDEN = 128, 8, 16, 8, 8
#: Words of fewer training documents have no embedding of their own; of the others this
#: share is hidden in training, so that the characters must carry the score too.
LEAST_DOCS, HIDE = 10, 0.5
EPOCHS, BATCH, RATE = 6, 48, 0.01
#: Rounds of an epoch, and steps of a part in a round, unless these would be smaller than
#: BATCH windows or larger than MOST.
ROUNDS, STEPS, MOST = 4, 24, 768
#: Windows whose words are spelled once, for one step of the character network.
GROUP = 1536
#: Characters of a part, and the most parts: beyond them parts grow.
PART_CHARS, PARTS = 16_000_000, 32
#: Words with an embedding, a size of the model; the others are read by their characters.
VOCABULARY = 16_384
WORD = re.compile(r"[^\W_]{1,16}")
MEMO = 500_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gru(inputs: Callable[[int, int], np.ndarray], active: np.ndarray, u: np.ndarray, back: bool, states: np.ndarray | None = None, tape: list | None = None) -> np.ndarray:
    """Last states (H, B). Columns are in order of falling length, the first ``active[t]`` of
    them have a step t; ``inputs(t, k)`` gives the projected inputs (3H, k) of these, which are
    overwritten: gates update, reset, candidate. ``states`` (T, H, B) takes the states."""
    n = u.shape[0]
    ut = np.ascontiguousarray(u.T)
    h = np.zeros((n, active[0]), dtype=np.float32)
    for t in range(len(active) - 1, -1, -1) if back else range(len(active)):
        k = active[t]
        x, old = inputs(t, k), h[:, :k]
        a = ut @ old
        gates, c = x[: 2 * n], x[2 * n :]
        gates += a[: 2 * n]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, r = gates[:n], gates[n:]
        c += r * a[2 * n :]
        np.tanh(c, out=c)
        new = old - c
        new *= z
        new += c
        whole = k == h.shape[1]
        if tape is not None:
            tape.append((t, old if whole else old.copy(), z, r, c, a[2 * n :].copy()))
        if whole:
            h = new
        else:
            h[:, :k] = new
        if states is not None:
            states[t, :, :k] = new
    return h


def gru_back(last: np.ndarray, grad: np.ndarray | None, u: np.ndarray, tape: list, add: Callable[[int, np.ndarray], None]) -> np.ndarray:
    """Gradient of ``u``, from those of the last states and of all states; ``add(t, g)`` gets
    those of the projected inputs."""
    n = u.shape[0]
    gu, gh = np.zeros_like(u), last.copy()
    for t, h, z, r, c, a in reversed(tape):
        k = h.shape[1]
        g = gh[:, :k]
        if grad is not None:
            g = g + grad[t, :, :k]
        gx = np.empty((3 * n, k), dtype=np.float32)
        ga = np.empty_like(gx)
        gc = np.multiply(g, 1 - z, out=gx[2 * n :])
        gc *= 1 - c * c
        gz = np.multiply(g, h - c, out=gx[:n])
        gz *= z * (1 - z)
        gr = np.multiply(gc, a, out=gx[n : 2 * n])
        gr *= r * (1 - r)
        ga[: 2 * n] = gx[: 2 * n]
        np.multiply(gc, r, out=ga[2 * n :])
        gu += h @ ga.T
        gh[:, :k] = g * z + u @ ga
        add(t, gx)
    return gu


def spell(words: list[str]) -> np.ndarray:
    """Character ids (words, 16), 0 beyond a word's end."""
    code = np.array(words, dtype="U16").view(np.uint32).reshape(len(words), 16)
    return np.where(code > 0, 1 + code % (CHARS - 1), 0).astype(np.uint8)


def _columns_added(out: np.ndarray, at: np.ndarray, columns: np.ndarray) -> None:
    """Add each of the ``columns`` (d, k) to the one of ``out`` that ``at`` tells."""
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    first = np.flatnonzero(np.r_[True, sorted_at[1:] != sorted_at[:-1]])
    out[:, sorted_at[first]] += np.add.reduceat(np.take(columns, order, axis=1), first, axis=1)


class Network:
    def __init__(self, vocabulary: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        make = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.ids = {w: k + 1 for k, w in enumerate(vocabulary)}
        d = WORD_DIM + 2 * CHAR_HIDDEN
        self.p = {
            "chars": make(CHARS, CHAR_DIM) * np.sqrt(CHARS / CHAR_DIM).astype(np.float32), "words": 0.1 * make(len(vocabulary) + 1, WORD_DIM) * np.float32(np.sqrt(len(vocabulary) + 1)),
            "aw": make(2 * HIDDEN, 2 * HIDDEN), "ab": np.zeros(2 * HIDDEN, np.float32), "av": make(2 * HIDDEN), "ow": make(2 * HIDDEN), "ob": np.zeros(1, np.float32),
        }
        for name, size, n in (("c", CHAR_DIM, CHAR_HIDDEN), ("w", d, HIDDEN)):
            for way in "fb":
                self.p |= {f"{name}{way}x": make(size, 3 * n), f"{name}{way}u": make(n, 3 * n), f"{name}{way}b": np.zeros(3 * n, np.float32)}

    def word_inputs(self, words: list[str], tape: dict | None = None) -> np.ndarray:
        """Embedding and character states (features, words) of each word."""
        p, codes = self.p, spell(words)
        length = (codes > 0).sum(axis=1)
        order = np.argsort(-length, kind="stable")
        codes = np.ascontiguousarray(codes[order].T[: length.max(initial=1)])
        active = (codes > 0).sum(axis=1)
        ids = np.array([self.ids.get(w, 0) for w in words], dtype=np.int64)
        out = np.empty((WORD_DIM + 2 * CHAR_HIDDEN, len(words)), dtype=np.float32)
        out[:WORD_DIM] = p["words"][ids].T
        for k, way in enumerate("fb"):
            steps: list = []
            table = np.ascontiguousarray((p["chars"] @ p[f"c{way}x"] + p[f"c{way}b"]).T)
            take = lambda t, n, table=table: np.take(table, codes[t, :n], axis=1)
            at = WORD_DIM + k * CHAR_HIDDEN
            out[at : at + CHAR_HIDDEN, order] = gru(take, active, p[f"c{way}u"], way == "b", None, None if tape is None else steps)
            if tape is not None:
                tape[f"c{way}"] = steps
        if tape is not None:
            tape |= {"codes": codes, "order": order, "ids": ids}
        return out

    def project(self, inputs: np.ndarray) -> np.ndarray:
        """(6H, words): both ways' inputs of the network over words."""
        return np.concatenate([self.p[f"w{way}x"].T @ inputs + self.p[f"w{way}b"][:, None] for way in "fb"])

    def run(self, table: np.ndarray, index: np.ndarray, active: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Scores of windows: ``index`` (T, B) into the columns of ``table`` (6H, words), in
        order of falling length."""
        p, n = self.p, HIDDEN
        steps, batch = index.shape
        states = np.zeros((steps, 2 * n, batch), dtype=np.float32)
        for k, way in enumerate("fb"):
            own, at = table[3 * n * k : 3 * n * (k + 1)], []
            gru(lambda t, m, own=own: np.take(own, index[t, :m], axis=1), active, p[f"w{way}u"], way == "b", states[:, n * k : n * (k + 1)], None if tape is None else at)
            if tape is not None:
                tape[f"w{way}"] = at
        e = np.tanh(p["aw"].T @ states + p["ab"][:, None])
        s = p["av"] @ e
        s[np.arange(batch) >= active[:, None]] = -1e9
        s = np.exp(s - s.max(axis=0))
        alpha = s / s.sum(axis=0)
        pooled = np.einsum("tb,thb->hb", alpha, states)
        if tape is not None:
            tape |= {"states": states, "e": e, "alpha": alpha, "pooled": pooled}
        return _sigmoid(p["ow"] @ pooled + p["ob"])

    def gradients(self, windows: list[list[str]], y: np.ndarray, rng: np.random.Generator) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean loss, and the scores."""
        words, index = numbered_words(windows)
        tape: dict = {}
        inputs = self.word_inputs(words, tape)
        g, prob, ends = self.slope(inputs, tape["ids"], index, y, np.ones(len(y), np.float32), rng)
        return g | self.spelling_slope(ends, tape), prob

    def slope(self, inputs: np.ndarray, ids: np.ndarray, windows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Gradients of the mean of the losses times ``weight`` without those of the character
        network, scores, and gradients of its last states (2 CHAR_HIDDEN, words). ``windows``
        hold places in the columns of ``inputs``, the :meth:`word_inputs` of words with ``ids``."""
        p, n = self.p, HIDDEN
        ids = np.where(rng.random(len(ids)) >= HIDE, ids, 0)
        inputs[:WORD_DIM] = p["words"][ids].T
        table = self.project(inputs)
        gtable = np.zeros_like(table)
        g = {k: np.zeros_like(v) for k, v in p.items() if k[0] != "c"}
        prob = np.zeros(len(windows), dtype=np.float32)
        share = weight / len(weight)
        falling = sorted(range(len(windows)), key=lambda k: -len(windows[k]))
        for a in range(0, len(falling), SLICE):
            part = falling[a : a + SLICE]
            index, active = packed([windows[k] for k in part])
            own: dict = {}
            prob[part] = got = self.run(table, index, active, own)
            states, e, alpha, pooled = own["states"], own["e"], own["alpha"], own["pooled"]
            delta = (got - y[part]) * share[part]
            g["ow"] += pooled @ delta
            g["ob"] += delta.sum(keepdims=True)
            gp = p["ow"][:, None] * delta
            gs = alpha[:, None, :] * gp
            galpha = np.einsum("hb,thb->tb", gp, states)
            gscore = alpha * (galpha - (alpha * galpha).sum(axis=0))
            g["av"] += np.einsum("tb,thb->h", gscore, e)
            ge = gscore[:, None, :] * p["av"][:, None] * (1 - e * e)
            g["aw"] += (states @ ge.transpose(0, 2, 1)).sum(axis=0)
            g["ab"] += ge.sum(axis=(0, 2))
            gs += p["aw"] @ ge
            places = np.concatenate([index[t, :m] for t, m in enumerate(active)])
            ends = np.cumsum(active)
            for k, way in enumerate("fb"):
                gx = np.empty((3 * n, len(places)), dtype=np.float32)

                def add(t: int, x: np.ndarray, gx: np.ndarray = gx) -> None:
                    gx[:, ends[t] - x.shape[1] : ends[t]] = x

                g[f"w{way}u"] += gru_back(np.zeros((n, len(part)), np.float32), gs[:, n * k : n * (k + 1)], p[f"w{way}u"], own[f"w{way}"], add)
                _columns_added(gtable[3 * n * k : 3 * n * (k + 1)], places, gx)
        gin = np.zeros_like(inputs)
        for k, way in enumerate("fb"):
            gw = gtable[3 * n * k : 3 * n * (k + 1)]
            g[f"w{way}x"], g[f"w{way}b"] = inputs @ gw.T, gw.sum(axis=1)
            gin += p[f"w{way}x"] @ gw
        _columns_added(g["words"].T, ids, gin[:WORD_DIM])
        return g, prob, gin[WORD_DIM:]

    def spelling_slope(self, ends: np.ndarray, tape: dict) -> dict[str, np.ndarray]:
        """Gradients of the character network, from those of its last states."""
        p, codes = self.p, tape["codes"]
        g = {"chars": np.zeros_like(p["chars"])}
        for k, way in enumerate("fb"):
            end = ends[k * CHAR_HIDDEN : (k + 1) * CHAR_HIDDEN, tape["order"]]
            gc = np.zeros((3 * CHAR_HIDDEN, CHARS), dtype=np.float32)
            g[f"c{way}u"] = gru_back(end, None, p[f"c{way}u"], tape[f"c{way}"], lambda t, x, gc=gc: _columns_added(gc, codes[t, : x.shape[1]], x))
            g[f"c{way}x"], g[f"c{way}b"] = (gc @ p["chars"]).T, gc.sum(axis=1)
            g["chars"] += gc.T @ p[f"c{way}x"].T
        return g


def numbered_words(windows: list[list[str]]) -> tuple[list[str], list[np.ndarray]]:
    """The words of the windows, and the windows as places among them."""
    words = sorted({w for x in windows for w in x})
    at = {w: k for k, w in enumerate(words)}
    return words, [np.fromiter(map(at.__getitem__, x), dtype=np.int32, count=len(x)) for x in windows]


def packed(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(T, B) places of windows in order of falling length, and how many have each step."""
    length = np.array([len(x) for x in windows])
    index = np.zeros((length[0], len(windows)), dtype=np.int32)
    for b, x in enumerate(windows):
        index[: len(x), b] = x
    return index, (length > np.arange(length[0])[:, None]).sum(axis=1)


def windows_of(words: list[str]) -> list[list[str]]:
    """Windows of WINDOW words, STRIDE apart, the last one at the text's end."""
    n = len(words)
    if n <= WINDOW:
        return [words] if n else []
    starts = [*range(0, n - WINDOW, STRIDE), n - WINDOW]
    return [words[s : s + WINDOW] for s in starts]


def in_round(toxic: int, slot: int, epoch: int, turn: int, repeats: int) -> bool:
    """Whether a document with a ``slot`` below EPOCHS x ROUNDS is taken: toxic ones in a round
    of every epoch, others in ``repeats`` epochs."""
    return slot % ROUNDS == turn and (toxic == 1 or (slot // ROUNDS - epoch) % EPOCHS < repeats)


def balance(clean: int, toxic: int) -> tuple[int, np.ndarray]:
    """Of the windows of each class: the epochs in which others than toxic documents are taken,
    and the weights of a window that isn't and one that is toxic (1 on average)."""
    repeats = min(EPOCHS, -(-EPOCHS * toxic // clean))
    taken = clean * repeats / EPOCHS
    weight = np.array([min(1.0, toxic / taken), 1.0])
    return repeats, weight * (taken + toxic) / (taken * weight[0] + toxic)


class Learner:
    """A network and the state of its steps (Adam)."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.steps = np.zeros(2, dtype=np.int64)  # of the character network, of the others
        self.m, self.v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))

    def tables(self) -> list[np.ndarray]:
        return [d[k] for d in (self.net.p, self.m, self.v) for k in sorted(d)]

    def state(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.tables()])

    def take(self, state: np.ndarray) -> None:
        at = 0
        for x in self.tables():
            x[...] = state[at : at + x.size].reshape(x.shape)
            at += x.size

    def round(self, docs: list[tuple[str, int]], epoch: int, weight: np.ndarray, seed: list[int]) -> int:
        """Steps over all windows of (text, toxic); how many windows there are."""
        rng = np.random.default_rng(seed)
        texts = [WORD.findall(t.lower()) for t, _ in docs]
        windows = [windows_of(words) for words in texts]
        labels = [np.full(len(x), toxic, dtype=np.float32) for x, (_, toxic) in zip(windows, docs)]
        if epoch > EPOCHS // 2:
            several = [k for k, (_, toxic) in enumerate(docs) if toxic and len(windows[k]) > 1]
            for k, prob in zip(several, Scorer(self.net).windows([windows[k] for k in several])):
                labels[k] = ((prob >= 0.3) | (prob >= prob.max())).astype(np.float32)
        flat = [(w, t, weight[toxic]) for x, y, (_, toxic) in zip(windows, labels, docs) for w, t in zip(x, y)]
        rate = RATE * (0.3 if epoch + 2 >= EPOCHS else 1)
        size = min(MOST, max(BATCH, -(-len(flat) // STEPS)))
        groups = -(-len(flat) // GROUP)
        for k in range(groups):
            self.group(flat[len(flat) * k // groups : len(flat) * (k + 1) // groups], size, rate, rng)
        return len(flat)

    def group(self, flat: list[tuple[list[str], float, float]], size: int, rate: float, rng: np.random.Generator) -> None:
        """Steps of ``size`` windows (words, label, weight). Their words are spelled once, so
        the character network takes one step for all of them."""
        words, index = numbered_words([w for w, _, _ in flat])
        y, weight = (np.array([f[k] for f in flat], dtype=np.float32) for k in (1, 2))
        tape: dict = {}
        inputs = self.net.word_inputs(words, tape)
        ends = np.zeros((2 * CHAR_HIDDEN, len(words)), dtype=np.float32)
        order = rng.permutation(len(flat))
        for a in range(0, len(order), size):
            part = order[a : a + size]
            used, places = np.unique(np.concatenate([index[k] for k in part]), return_inverse=True)
            cuts = np.cumsum([len(index[k]) for k in part])[:-1]
            g, _, own = self.net.slope(inputs[:, used], tape["ids"][used], np.split(places, cuts), y[part], weight[part], rng)
            ends[:, used] += own * np.float32(len(part) / len(order))
            self.update(g, rate, 1)
        self.update(self.net.spelling_slope(ends, tape), rate, 0)

    def update(self, g: dict[str, np.ndarray], rate: float, which: int) -> None:
        self.steps[which] += 1
        step = self.steps[which]
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k, x in g.items():
            x = x / max(1.0, norm)
            m, v = self.m[k], self.v[k]
            m += 0.1 * (x - m)
            v += 0.001 * (x * x - v)
            self.net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def train(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Of documents in memory, as one part."""
    docs = [windows_of(WORD.findall(t.lower())) for t in texts]
    n = np.bincount(np.array(toxic, dtype=np.int64), weights=[len(x) for x in docs], minlength=2)
    if not n.all():
        raise ValueError("training needs toxic and other documents")
    seen = Counter(w for x in docs for w in {w for y in x for w in y})
    most = sorted((w for w, k in seen.items() if k >= LEAST_DOCS), key=lambda w: (-seen[w], w))
    learner = Learner(Network(most[:VOCABULARY], seed))
    repeats, weight = balance(int(n[0]), int(n[1]))
    place = [0, 0]
    slots = []
    for c in toxic:
        slots.append(place[c] % (EPOCHS * ROUNDS))
        place[c] += 1
    for epoch in range(epochs):
        for turn in range(ROUNDS):
            learner.round([(t, c) for t, c, s in zip(texts, toxic, slots) if in_round(c, s, epoch, turn, repeats)], epoch, weight, [seed, epoch, turn, 0])
    return learner.net


def best_threshold(score: np.ndarray, toxic: np.ndarray, count: np.ndarray | None = None) -> float:
    """The middle (by log odds) of the scores between which F1 is greatest; ``count``: documents
    of each score, of which ``toxic`` are so."""
    order = np.argsort(-score, kind="stable")
    s, y = np.clip(score[order], 1e-6, 1 - 1e-6), toxic[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.cumsum(np.ones(len(y)) if count is None else count[order]) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores can't be told apart
    k = int(np.argmax(f1))
    logit = np.log(s / (1 - s))
    return float(1 / (1 + np.exp(-(logit[k] + (logit[k + 1] if k + 1 < len(s) else logit[k] - 1)) / 2)))


def fit(texts: list[str], toxic: list[int], seed: int = 7) -> tuple[Network, float]:
    """A network and its threshold, both of all documents."""
    net = train(texts, toxic, seed=seed)
    n, score = Scorer(net)(texts)
    return net, best_threshold(score[n > 0], np.array(toxic)[n > 0])


class Scorer:
    """Scores whole texts; words' projected inputs are remembered."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, 6 * HIDDEN), dtype=np.float32)

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.at]
        for a in range(0, len(new), 20_000):
            part = sorted(new[a : a + 20_000], key=len)
            n = len(self.at)
            while n + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n : n + len(part)] = self.net.project(self.net.word_inputs(part)).T
            self.at.update(zip(part, range(n, n + len(part))))

    def _full(self, index: np.ndarray) -> np.ndarray:
        """:meth:`Network.score` of whole windows (T, B), by features first and in place."""
        p, n = self.net.p, HIDDEN
        steps, batch = index.shape
        states = np.empty((steps, 2 * n, batch), dtype=np.float32)
        a, d = np.empty((3 * n, batch), dtype=np.float32), np.empty((n, batch), dtype=np.float32)
        gates, new = a[: 2 * n], a[2 * n :]
        x = np.ascontiguousarray(self.table[index].transpose(0, 2, 1))
        for way, order in enumerate((range(steps), range(steps - 1, -1, -1))):
            u = np.ascontiguousarray(p["wbu" if way else "wfu"].T)
            h = np.zeros((n, batch), dtype=np.float32)
            for t in order:
                xt = x[t, 3 * n * way : 3 * n * (way + 1)]
                np.dot(u, h, out=a)
                gates += xt[: 2 * n]
                gates *= 0.5
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                new *= gates[n:]
                new += xt[2 * n :]
                np.tanh(new, out=new)
                np.subtract(h, new, out=d)
                d *= gates[:n]
                h = states[t, n * way : n * (way + 1)]
                np.add(new, d, out=h)
        s, e = np.empty((steps, batch), dtype=np.float32), np.empty((2 * n, batch), dtype=np.float32)
        aw, ab = np.ascontiguousarray(p["aw"].T), p["ab"][:, None]
        for t in range(steps):
            np.dot(aw, states[t], out=e)
            e += ab
            np.tanh(e, out=e)
            np.dot(p["av"], e, out=s[t])
        s = np.exp(s - s.max(axis=0))
        s /= s.sum(axis=0)
        states *= s[:, None, :]
        return _sigmoid(p["ow"] @ states.sum(axis=0) + p["ob"])

    def windows(self, docs: list[list[list[str]]]) -> list[np.ndarray]:
        """The score of each window of documents that have several (whole ones then)."""
        if not docs:
            return []
        self._learn({w for windows in docs for x in windows for w in x})
        get = self.at.__getitem__
        ids = np.array([list(map(get, x)) for windows in docs for x in windows])
        score = np.concatenate([self._full(ids[a : a + BLOCK].T) for a in range(0, len(ids), BLOCK)])
        return np.split(score, np.cumsum([len(x) for x in docs])[:-1])

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(windows, score) of each text."""
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        if len(self.at) > MEMO:
            self.at, self.table = {}, np.zeros((1024, 6 * HIDDEN), dtype=np.float32)
        self._learn(set().union(*words))
        get = self.at.__getitem__
        count, score = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
        full, owner, short = [], [], []
        for k, w in enumerate(words):
            n = len(w)
            if not n:
                continue
            ids = np.fromiter(map(get, w), dtype=np.int64, count=n)
            if n < WINDOW:
                short.append((n, k, ids))
                count[k] = 1
                continue
            starts = np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)
            full.append(ids[starts[:, None] + np.arange(WINDOW)])
            owner.append(np.full(len(starts), k))
            count[k] = len(starts)
        if full:
            index, own = np.concatenate(full), np.concatenate(owner)
            for a in range(0, len(index), BLOCK):
                np.maximum.at(score, own[a : a + BLOCK], self._full(index[a : a + BLOCK].T))
        short.sort(key=lambda s: -s[0])
        for a in range(0, len(short), BLOCK):
            part = short[a : a + BLOCK]
            index, active = packed([ids for _, _, ids in part])
            used, index = np.unique(index, return_inverse=True)
            score[[k for _, k, _ in part]] = self.net.run(np.ascontiguousarray(self.table[used].T), index.reshape(-1, len(part)), active)
        return count, score


def marks_of(labels: DataFrame, id_col: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(l_id, l_toxic) of each labelled id; one that is labelled both ways counts as toxic."""
    marks, (li, ll) = plain(labels, id_col, label)
    return marks.where(F.col(ll).isin(0, 1) & F.col(li).isNotNull()).groupBy(F.col(li).alias("l_id")).agg(F.max(ll).cast("int").alias("l_toxic"))


def training_sample(docs: DataFrame, labels: DataFrame, train_rows: int, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list[str], list[int]]:
    """For trials in memory only, :func:`classify` doesn't use it: at most ``train_rows`` toxic
    documents and twice as many others, the first by a hash of the id, with whole texts; of
    several texts of one id the least."""
    rows, (i, t) = plain(docs, id_col, text)
    marks = marks_of(labels, id_col, label)
    picked = [marks.where(F.col("l_toxic") == c).orderBy(F.xxhash64("l_id"), "l_id").limit(train_rows * (2 - c)) for c in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # 3 x train_rows rows
    found = rows.select(F.col(i).alias("d_id"), F.col(t).alias("d_text")).where("d_text is not null").join(ids, F.col("d_id") == F.col("l_id"))
    got = found.groupBy("d_id", "l_toxic").agg(F.min("d_text").alias("d_text")).collect()
    got.sort(key=lambda r: (r["d_id"], r["d_text"]))
    return [r["d_text"] for r in got], [int(r["l_toxic"]) for r in got]


def labelled(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, toxic, key, slot, part) of all labelled rows with a text, written; a file a part."""
    rows, (i, t) = plain(docs, id_col, text)
    found = rows.select(F.col(i).alias("d_id"), F.col(t).alias("text")).where("text is not null").join(marks, F.col("d_id") == F.col("l_id"))
    chars = found.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    parts = min(PARTS, -(-chars // PART_CHARS) or 1)
    key = found.select("text", F.col("l_toxic").alias("toxic"), F.xxhash64("d_id", "text").alias("key"))
    placed = key.withColumn("slot", F.pmod("key", F.lit(EPOCHS * ROUNDS)).cast("int")).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    path = scratch(docs.sparkSession, "labelled")
    placed.repartition(parts, "part").sortWithinPartitions("part", "slot", "toxic", "key").write.partitionBy("part").parquet(path)
    return docs.sparkSession.read.schema(placed.schema).parquet(path)


CLEAN, TOXIC = "-", "+"  # no words


def counts(rows: DataFrame) -> DataFrame:
    """(word, n): in how many of the (text, toxic) each word is; windows of each class under
    CLEAN and TOXIC."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall(text.lower())
                seen.update(set(words))
                seen[TOXIC if toxic else CLEAN] += len(windows_of(words))
            if len(seen) > MEMO:
                yield give()
                seen.clear()
        yield give()

    return rows.select("text", "toxic").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def averaged(states: DataFrame) -> DataFrame:
    """One row (windows, steps, state) of a round's rows (part, windows, steps, state), or none:
    the mean of the states by windows, worked out in one task with one more state in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, most, mean = 0, np.zeros(2, dtype=np.int64), None
        for batch in batches:
            for windows, steps, state in zip(*batch.columns):
                n, x = windows.as_py(), np.frombuffer(state.as_buffer(), dtype=np.float32).astype(np.float64)
                x *= n
                mean = x if mean is None else np.add(mean, x, out=mean)
                total, most = total + n, np.maximum(most, steps.as_py())
        if mean is not None:
            state = (mean / total).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([most.tolist()]), pa.array([state], pa.binary())], ["windows", "steps", "state"])

    found = states.where("windows > 0").coalesce(1).sortWithinPartitions("part", "windows", "state")
    return found.select("windows", "steps", "state").mapInArrow(run, "windows bigint, steps array<bigint>, state binary")


def train_spread(rows: DataFrame, seed: int = 7) -> Network | None:
    """:func:`train` of all :func:`labelled` rows, part by part in tasks; nothing where a class
    has no window. A round gives the driver one state, whose size VOCABULARY bounds: those of
    the parts go through the shared folder."""
    spark = rows.sparkSession
    words = saved(counts(rows).where((F.col("n") >= LEAST_DOCS) | F.col("word").isin(CLEAN, TOXIC)), "words")
    n = {r["word"]: r["n"] for r in words.where(F.col("word").isin(CLEAN, TOXIC)).collect()}
    most = words.where(~F.col("word").isin(CLEAN, TOXIC)).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    discard(words)
    if not n.get(CLEAN) or not n.get(TOXIC):
        return None
    learner = Learner(Network([r["word"] for r in most], seed))
    repeats, weight = balance(n[CLEAN], n[TOXIC])
    for epoch in range(EPOCHS):
        for turn in range(ROUNDS):
            shared = spark.sparkContext.broadcast(learner)  # of the model's size

            def run(batches: Iterator[pa.RecordBatch], shared=shared, epoch=epoch, turn=turn) -> Iterator[pa.RecordBatch]:
                parts: dict[int, list] = {}
                for batch in batches:
                    for part, key, text, toxic in zip(*[c.to_pylist() for c in batch.columns]):
                        parts.setdefault(part, []).append((key, text, toxic))
                own = shared.value
                start, begun = own.state(), own.steps.copy()
                for part, docs in parts.items():
                    docs.sort()
                    windows = own.round([d[1:] for d in docs], epoch, weight, [seed, epoch, turn, part])
                    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([windows]), pa.array([(own.steps - begun).tolist()]), pa.array([own.state().tobytes()], pa.binary())], ["part", "windows", "steps", "state"])
                    own.take(start)
                    own.steps[:] = begun

            slots = [[s for s in range(EPOCHS * ROUNDS) if in_round(c, s, epoch, turn, repeats)] for c in (0, 1)]
            taken = rows.where(F.col("slot").isin(slots[1]) & ((F.col("toxic") == 1) | F.col("slot").isin(slots[0])))
            states = saved(taken.select("part", "key", "text", "toxic").mapInArrow(run, "part bigint, windows bigint, steps array<bigint>, state binary"), "states")
            for r in averaged(states).collect():
                learner.take(np.frombuffer(r["state"], dtype=np.float32))
                learner.steps += r["steps"]
            discard(states)
            shared.destroy()
    return learner.net


def scored(docs: DataFrame, net: Network, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_windows, score), a row for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of the model's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                n, s = scorer(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(np.round(s, 6))], ["doc_id", "n_windows", "score"])

    rows, (i, t) = plain(docs, id_col, text)
    return rows.select(F.col(i).cast("bigint").alias("doc_id"), F.col(t).alias("text")).mapInArrow(run, "doc_id bigint, n_windows bigint, score double")


def score_documents(docs: DataFrame, net: Network, threshold: float, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_windows, score, toxic), a row for each document."""
    return scored(docs, net, id_col, text).withColumn("toxic", F.col("score") >= threshold)


def threshold_of(scores: DataFrame, marks: DataFrame) -> float:
    """:func:`best_threshold` of all labelled documents that have words; the driver gets a row
    for each of the at most 10^6 + 1 scores."""
    known = scores.where("n_windows > 0").join(marks, F.col("doc_id") == F.col("l_id"))
    got = known.groupBy("score").agg(F.sum("l_toxic").alias("toxic"), F.count("*").alias("n")).toArrow()
    return best_threshold(*[got.column(c).to_numpy().astype(float) for c in ("score", "toxic", "n")])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`score_documents` with a network and a threshold of all labelled documents."""
    marks = small_side(marks_of(labels), "marks")
    rows = labelled(docs, marks)
    net = train_spread(rows)
    if net is None:
        unknown = {"n_windows": F.lit(None).cast("bigint"), "score": F.lit(None).cast("double"), "toxic": F.lit(None).cast("boolean")}
        ids, (i,) = plain(docs, "doc_id")
        return ids.select(F.col(i).cast("bigint").alias("doc_id"), *[v.alias(k) for k, v in unknown.items()])
    scores = saved(scored(docs, net), "scores")
    return scores.withColumn("toxic", F.col("score") >= threshold_of(scores, marks))
