"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of two vectors: one of its own (by hash) and the mean of those of its
character trigrams (by hash), so unseen spellings are near known ones. Texts are cut into
overlapping windows of ``WINDOW`` words, ``STRIDE`` apart, over the whole text. In a window a
GRU runs each way, attention weighs the states, and a logistic unit scores the pooled state.
A text scores as its worst window, calibrated on training rows that the network has not seen.

Labels are of texts, not of windows, so training is by multiple instances: of a toxic text the
window that the present model finds worst is the positive example; of other texts the worst
windows and some at random are negatives. Word odds choose the first positives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerwatch.llm.common import ids_and_texts, mixed, range_hashes, send, text_blocks, text_of

WINDOW, STRIDE = 32, 16
#: Bound of the fit: rows of each label.
TRAIN_ROWS = 1500
WORD_BUCKETS, GRAM_BUCKETS, WIDTH, HIDDEN = 1 << 16, 1 << 14, 12, 8
EPOCHS, ROUNDS, BATCH, NEGATIVES = 4, 2, 256, 4
#: Steps of a round at least, however few rows there are.
LEAST_STEPS = 160
#: Windows scored together, and bytes hashed together.
TOGETHER, CHUNK = 4096, 1 << 20

_ODD = 0x9E3779B97F4A7C15
#: Bytes that belong to words: ASCII letters and digits, and all of other scripts.
_LETTER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


class Words:
    """The words of some texts, in order; equal words share one entry of ``hashes``."""

    def __init__(self, texts: list[str]):
        parts = [t.lower().encode() for t in texts]
        data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        is_letter = _LETTER[data]
        edge = np.flatnonzero(is_letter[1:] != is_letter[:-1]) + 1
        if is_letter[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[::2], edge[1::2]
        text_ends = np.cumsum([len(p) + 1 for p in parts])
        self.counts = np.diff(np.searchsorted(starts, text_ends, "left"), prepend=0)
        self.hashes, first, self.which = np.unique(range_hashes(data, starts, ends, CHUNK), return_index=True, return_inverse=True)
        self.buckets = (self.hashes % np.uint64(WORD_BUCKETS)).astype(np.int64)
        self._data, self._starts, self._lengths = data, starts[first], (ends - starts)[first]

    def grams(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Trigram buckets of some entries, one for each of a word's bytes, and each word's number of them."""
        lengths = self._lengths[rows]
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        place = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - self._starts[rows], lengths)
        here = self._data[place].astype(np.uint64)
        before, after = np.zeros_like(here), np.zeros_like(here)
        before[1:], after[:-1] = here[:-1], here[1:]
        before[offsets[:-1]] = 0
        after[offsets[1:] - 1] = 0
        return (mixed((before << np.uint64(16) | here << np.uint64(8) | after) * np.uint64(_ODD)) % np.uint64(GRAM_BUCKETS)).astype(np.int64), lengths


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of all overlapping windows; a wordless text has none."""
    n = np.where(counts > 0, 1 + -(-np.maximum(counts - WINDOW, 0) // STRIDE), 0)
    text = np.repeat(np.arange(len(counts)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    left = counts[text] - step * STRIDE
    return (np.cumsum(counts) - counts)[text] + step * STRIDE, np.minimum(left, WINDOW), text


class Network:
    """Parameters as arrays; ``logits`` scores windows, ``learn`` takes a step on some."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        h, e = HIDDEN, WIDTH
        self.word, self.gram = normal(WORD_BUCKETS, e, scale=0.1), normal(GRAM_BUCKETS, e, scale=0.1)
        self.p = {"Wx": normal(e, 6 * h, scale=e**-0.5), "bx": np.zeros(6 * h, np.float32),
                  "Uf": normal(h, 3 * h, scale=h**-0.5), "Ub": normal(h, 3 * h, scale=h**-0.5),
                  "A": normal(2 * h, h, scale=h**-0.5), "a": np.zeros(h, np.float32), "v": normal(h, scale=1.0),
                  "w": normal(2 * h, scale=0.5), "b": np.zeros(1, np.float32)}
        self.slopes = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in self.p.items()}
        self.word_sq, self.gram_sq, self.steps = np.full(WORD_BUCKETS, 1e-4, np.float32), np.full(GRAM_BUCKETS, 1e-4, np.float32), 0
        self.scale, self.shift, self.rate = 1.0, 0.0, 0.0

    def frozen(self) -> Network:
        """Without what only training needs."""
        self.slopes = self.word_sq = self.gram_sq = None
        return self

    def vectors(self, words: Words, rows: np.ndarray) -> tuple[np.ndarray, tuple]:
        grams, lengths = words.grams(rows)
        offsets = np.cumsum(lengths) - lengths
        mean = np.add.reduceat(self.gram[grams], offsets, axis=0) / lengths[:, None].astype(np.float32)
        return self.word[words.buckets[rows]] + mean, (grams, lengths)

    def _run(self, x, mask, keep: bool):
        """States of both ways for inputs ``x`` (steps, windows, 6h); steps behind a window's end keep the state."""
        steps, n, h = x.shape[0], x.shape[1], HIDDEN
        states, caches = np.zeros((steps, n, 2 * h), np.float32), []
        for way, U in ((0, self.p["Uf"]), (1, self.p["Ub"])):
            state, cache = np.zeros((n, h), np.float32), []
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                xt, m = x[t, :, 3 * h * way : 3 * h * (way + 1)], mask[t]
                hu = state @ U
                gates = np.tanh(0.5 * (xt[:, : 2 * h] + hu[:, : 2 * h])) * 0.5 + 0.5
                z, r = gates[:, :h] * m, gates[:, h:]
                new = np.tanh(xt[:, 2 * h :] + r * hu[:, 2 * h :])
                if keep:
                    cache.append((t, state, hu, z, r, new, m))
                state = state + z * (new - state)
                states[t, :, h * way : h * (way + 1)] = state
            caches.append(cache)
        return states, caches

    def _pool(self, states, mask):
        flat = np.tanh(states @ self.p["A"] + self.p["a"])
        weight = np.exp(flat @ self.p["v"]) * mask[:, :, 0]
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        return pooled @ self.p["w"] + self.p["b"][0], (flat, weight, pooled)

    def logits(self, words: Words, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A score of each window."""
        out = np.zeros(len(starts), np.float32)
        if not len(starts):
            return out
        inputs = np.concatenate([self.vectors(words, rows)[0] @ self.p["Wx"] + self.p["bx"]
                                 for rows in np.array_split(np.arange(len(words.hashes)), 1 + len(words.hashes) // 65536)])
        steps = np.arange(WINDOW)[:, None]
        for at in range(0, len(starts), TOGETHER):
            s, n = starts[at : at + TOGETHER], lengths[at : at + TOGETHER]
            mask = steps < n
            place = words.which[np.where(mask, s + steps, s)]
            mask = mask[:, :, None].astype(np.float32)
            out[at : at + TOGETHER] = self._pool(self._run(inputs[place], mask, False)[0], mask)[0]
        return out

    def learn(self, words: Words, starts, lengths, labels, weights, rate: float = 0.01) -> float:
        """One step of gradient descent on some windows; the mean loss before it."""
        h, p = HIDDEN, self.p
        steps = np.arange(WINDOW)[:, None]
        mask = steps < lengths
        place = words.which[np.where(mask, starts + steps, starts)]
        rows, local = np.unique(place, return_inverse=True)
        local = local.reshape(place.shape)
        vec, (grams, gram_n) = self.vectors(words, rows)
        mask = mask[:, :, None].astype(np.float32)
        x = (vec @ p["Wx"] + p["bx"])[local]
        states, caches = self._run(x, mask, True)
        logit, (flat, weight, pooled) = self._pool(states, mask)
        chance = 1 / (1 + np.exp(-logit))
        loss = float(np.mean(weights * (np.logaddexp(0, logit) - labels * logit)))
        d = (weights * (chance - labels) / len(labels)).astype(np.float32)
        g = {"w": pooled.T @ d, "b": d.sum(keepdims=True)}
        d_pool = d[:, None] * p["w"]
        d_states = weight[:, :, None] * d_pool
        d_weight = np.einsum("tnk,nk->tn", states, d_pool)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_flat = d_score[:, :, None] * p["v"] * (1 - flat**2)
        g["v"] = np.einsum("tn,tnk->k", d_score, flat)
        g["A"], g["a"] = np.einsum("tni,tnj->ij", states, d_flat), d_flat.sum(axis=(0, 1))
        d_states = d_states + d_flat @ p["A"].T
        dx = np.zeros_like(x)
        for way, name in ((0, "Uf"), (1, "Ub")):
            g[name], carry = np.zeros_like(p[name]), np.zeros((len(labels), h), np.float32)
            for t, state, hu, z, r, new, m in reversed(caches[way]):
                total = carry + d_states[t, :, h * way : h * (way + 1)]
                d_new = total * z * (1 - new**2)
                soft = np.where(m > 0, z * (1 - z), 0)
                parts = np.concatenate([total * (new - state) * soft, d_new * hu[:, 2 * h :] * r * (1 - r), d_new], axis=1)
                dx[t, :, 3 * h * way : 3 * h * (way + 1)] = parts
                parts[:, 2 * h :] *= r
                g[name] += state.T @ parts
                carry = total * (1 - z) + parts @ p[name].T
        d_rows = np.zeros((len(rows), 6 * h), np.float32)
        np.add.at(d_rows, local.reshape(-1), dx.reshape(-1, 6 * h))
        g["Wx"], g["bx"] = vec.T @ d_rows, d_rows.sum(axis=0)
        d_vec = d_rows @ p["Wx"].T
        self.steps += 1
        for k, x_k in p.items():
            one, two = self.slopes[k]
            one += 0.1 * (g[k] - one)
            two += 0.01 * (g[k] ** 2 - two)
            x_k -= rate * (one / (1 - 0.9**self.steps)) / (np.sqrt(two / (1 - 0.99**self.steps)) + 1e-7)
        self._learn_rows(self.word, self.word_sq, words.buckets[rows], d_vec)
        self._learn_rows(self.gram, self.gram_sq, grams, np.repeat(d_vec / gram_n[:, None].astype(np.float32), gram_n, axis=0))
        return loss

    @staticmethod
    def _learn_rows(table, squares, rows, slopes, rate: float = 0.15):
        kept, inverse = np.unique(rows, return_inverse=True)
        total = np.zeros((len(kept), table.shape[1]), np.float32)
        np.add.at(total, inverse, slopes)
        squares[kept] += (total**2).mean(axis=1)
        table[kept] -= rate * total / np.sqrt(squares[kept])[:, None]

    def worst(self, texts: list[str]) -> np.ndarray:
        """The highest window score of each text; minus infinity for a wordless one."""
        words = Words(texts)
        starts, lengths, text = windows_of(words.counts)
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, text, self.logits(words, starts, lengths))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """A score from 0 to 1 for each whole text; a wordless one scores 0."""
        worst = self.worst(texts)
        wordless = np.isneginf(worst)
        logit = self.scale * np.where(wordless, 0, worst) + self.shift
        return np.where(wordless, 0.0, 1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def _first_choice(words: Words, starts, lengths, text, toxic) -> np.ndarray:
    """Windows' sums of how far their words exceed the usual number of toxic texts, in deviations."""
    of_word = np.repeat(np.arange(len(words.counts)), words.counts)
    pairs = np.unique(words.which * len(toxic) + of_word)
    rows, bad = pairs // len(toxic), toxic[pairs % len(toxic)].astype(bool)
    yes, no = (np.bincount(rows[x], minlength=len(words.hashes)) for x in (bad, ~bad))
    usual = (yes + no) * toxic.mean()
    excess = (yes - usual) / np.sqrt(usual + 1)
    total = np.concatenate(([0], np.cumsum(np.maximum(excess - 1.5, 0)[words.which])))
    return total[starts + lengths] - total[starts]


def fit(texts: list[str], toxic: np.ndarray, base_rate: float | None = None, seed: int = 7) -> Network:
    """A network from labelled texts (1 is toxic); every fifth text only calibrates the scores.

    ``base_rate`` is the share of toxic texts where the network will be used. Without both
    labels nothing can be learned and every text scores the share of toxic rows.
    """
    toxic = np.asarray(toxic, np.int64)
    net = Network(seed)
    held = np.arange(len(texts)) % 5 == 4
    keep = [bool(t.strip()) for t in texts]
    learn = np.flatnonzero(~held & np.array(keep, bool)) if len(texts) else np.zeros(0, np.int64)
    if len(set(toxic[learn])) < 2:
        net.scale, net.shift = 0.0, float(np.clip(_logit(toxic.mean() if len(toxic) else 0.0), -20, 20))
        return net.frozen()
    rng = np.random.default_rng(seed)
    words, labels = Words([texts[i] for i in learn]), toxic[learn]
    starts, lengths, text = windows_of(words.counts)
    positive, negative = np.flatnonzero(labels[text] == 1), np.flatnonzero(labels[text] == 0)
    value = _first_choice(words, starts, lengths, text, labels)
    for part in range(ROUNDS):
        best = positive[np.lexsort((value[positive], text[positive]))]
        best = best[np.flatnonzero(np.diff(text[best], append=-1))]  # the worst window of each toxic text
        best = best[value[best] > 0] if part == 0 and (value[best] > 0).any() else best
        wrong = negative[np.argsort(-value[negative], kind="stable")][: len(best) * (NEGATIVES // 2)]
        random = rng.choice(negative, min(len(negative), len(best) * NEGATIVES), replace=False)
        chosen = np.concatenate([best, wrong, random])
        weights = np.where(labels[text[chosen]] == 1, (len(wrong) + len(random)) / (2 * len(best)), 1.0)
        epochs = max(EPOCHS, LEAST_STEPS // (1 + len(chosen) // BATCH))
        for epoch in range(epochs):
            order = rng.permutation(len(chosen))
            for at in range(0, len(order), BATCH):
                pick = chosen[order[at : at + BATCH]]
                net.learn(words, starts[pick], lengths[pick], labels[text[pick]], weights[order[at : at + BATCH]],
                          0.02 / (1 + part + epoch / epochs))
        if part + 1 < ROUNDS:
            value = net.logits(words, starts, lengths)
    rest = [i for i in np.flatnonzero(held) if keep[i]]
    if len(set(toxic[rest])) < 2:
        rest = learn
    share = toxic.mean() if base_rate is None else min(max(base_rate, 1e-4), 1 - 1e-4)
    top, y = net.worst([texts[i] for i in rest]), toxic[rest]
    net.scale, net.shift = _calibrate(top, y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    return net.frozen()


def _logit(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return float(np.log(p / (1 - p)))


def _calibrate(x, y, weights, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit with a little shrinkage, by Newton's method."""
    center, spread = x.mean(), x.std() + 1e-6
    design, b = np.stack([(x - center) / spread, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-design @ b))
        slope = design.T @ (weights * (p - y)) + 0.1 * b * [1, 0]
        curve = (design * (weights * p * (1 - p))[:, None]).T @ design + np.diag([0.1, 1e-6])
        b = b - np.clip(np.linalg.solve(curve, slope), -2, 2)
    scale = max(b[0], 0.05) / spread
    return float(scale), float(b[1] - scale * center)


def in_test_part(doc_id) -> F.Column:
    """Whether a document is held out: crc32 of its id as text is divisible by five; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Network:
    """A network from at most ``rows`` labelled texts of each label, none of them held out.

    The rows are chosen by a hash of their ids, so the choice doesn't follow any order. Null
    labels are left out; of repeated labels the largest counts, of repeated ids one text.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).dropna()
    known = known.filter(~in_test_part(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = known.filter("label = 1").orderBy(F.xxhash64("id"), "id").limit(rows).union(
        known.filter("label = 0").orderBy(F.xxhash64("id"), "id").limit(rows))  # bounded, so it may be sent to all
    texts = documents.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    sample = sorted(((r.id, r.text, r.label) for r in found.collect()), key=lambda r: hash((r[0], 11)))
    total = counts.get(0, 0) + counts.get(1, 0)
    return fit([r[1] for r in sample], np.array([r[2] for r in sample], np.int64), counts.get(1, 0) / total if total else 0.0)


def score(df: DataFrame, id_col: str, text_col: str, net: Network) -> DataFrame:
    """``id, score`` of every whole text: 0 to 1, empty and null texts 0; other columns are ignored."""
    sent = send(df.sparkSession, net)

    def run(batches):
        for ids, texts in text_blocks(batches, 2 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sent().scores(texts), pa.float64())], ["id", "score"])

    return ids_and_texts(df, id_col, text_col).mapInArrow(run, "id long, score double")


def clean_rows(df: DataFrame, text_col: str, net: Network, limit: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose text scores below ``limit``, all columns as they are; no shuffle."""
    sent = send(df.sparkSession, net)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            step = max(1, min(batch.num_rows, (2 << 20) * batch.num_rows // max(1, texts.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = sent().scores([t or "" for t in texts.slice(at, step).to_pylist()])
                yield part.filter(pa.array(found < limit))

    return df.mapInArrow(run, df.schema)
