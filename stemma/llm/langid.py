"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network is trained by backpropagation through time on a bounded sample of labelled rows.  It labels
every byte of every text; a document's score per language is the mean of its bytes' probabilities.
Texts are read in windows of a fixed number of bytes, so that memory is bounded for any length; a window
begins and ends with some bytes of its neighbours, which warm the network up and are not counted.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import crc_mod, map_rows
from stemma.llm.sample import counted, drawn, with_texts

ASCII_LETTER = re.compile("[A-Za-z]")
#: Bounds of the sample: documents of a language, documents in all, training windows of a document (from its whole text).
DOCS_EACH, DOCS, WINDOWS_EACH = 400, 25_600, 24
HIDDEN, WINDOW, MARGIN, TRAIN_WINDOW = 8, 128, 8, 48
#: Windows read side by side.
BATCH = 2048


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two GRUs (left to right, right to left) over bytes and a softmax over languages at each byte.

    Gate order: update z, reset r, candidate n; h' = n + z (h - n), n = tanh(x_n + r (h U_n)).
    """

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        g = np.random.default_rng(seed)
        self.langs, self.h = langs, hidden
        self.p = {}
        for d in "fb":
            self.p["W" + d] = g.normal(0, 0.5, (256, 3 * hidden)).astype(np.float32)
            self.p["U" + d] = g.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
        self.p["V"] = g.normal(0, hidden**-0.5, (2 * hidden, len(langs))).astype(np.float32)
        self.p["c"] = np.zeros(len(langs), np.float32)

    def direction(self, x: np.ndarray, d: str, keep: bool = False):
        """States (T, N, H) of one direction over bytes x (T, N)."""
        (t, n), h = x.shape, self.h
        w, u = self.p["W" + d], self.p["U" + d]
        states, gates = np.empty((t, n, h), np.float32), np.empty((t, n, 4 * h), np.float32) if keep else None
        state, pre, rec = np.zeros((n, h), np.float32), np.empty((n, 3 * h), np.float32), np.empty((n, 3 * h), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            np.take(w, x[k], axis=0, out=pre, mode="clip")
            np.matmul(state, u, out=rec)
            zr = pre[:, : 2 * h] + rec[:, : 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :h], zr[:, h:]
            cand = r * rec[:, 2 * h :]
            cand += pre[:, 2 * h :]
            np.tanh(cand, out=cand)
            if keep:
                gates[k] = np.concatenate([zr, cand, rec[:, 2 * h :]], axis=1)
            new = states[k]
            np.subtract(state, cand, out=new)
            new *= z
            new += cand
            state = new
        return states, gates

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(T, N, languages) for bytes x (T, N)."""
        f, _ = self.direction(x, "f")
        b, _ = self.direction(x, "b")
        return self.softmax(f, b)

    def softmax(self, f, b):
        h = self.h
        y = f @ self.p["V"][:h]
        y += b @ self.p["V"][h:]
        y += self.p["c"]
        y -= y.max(axis=-1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=-1, keepdims=True)
        return y

    def gradients(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray):
        """Loss and gradients: cross-entropy of the window's language y (N) at each valid byte (T, N)."""
        h, p = self.h, self.p
        kept = {d: self.direction(x, d, True) for d in "fb"}
        probs = self.softmax(kept["f"][0], kept["b"][0])
        weight = (valid / valid.sum()).astype(np.float32)[:, :, None]
        loss = -float((np.log(probs[:, np.arange(len(y)), y] + 1e-9) * weight[:, :, 0]).sum())
        dy = probs
        dy[:, np.arange(len(y)), y] -= 1
        dy *= weight
        both = np.concatenate([kept["f"][0], kept["b"][0]], axis=2).reshape(-1, 2 * h)
        flat = dy.reshape(-1, dy.shape[-1])
        g = {"V": both.T @ flat, "c": flat.sum(axis=0)}
        for d, v in (("f", p["V"][:h]), ("b", p["V"][h:])):
            states, gates = kept[d]
            dpre, drec = np.empty((*x.shape, 3 * h), np.float32), np.empty((*x.shape, 3 * h), np.float32)
            carry, zero = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
            order = list(range(len(x))) if d == "f" else list(range(len(x) - 1, -1, -1))
            for k, before in zip(order[::-1], [*order[::-1][1:], None], strict=True):
                last = zero if before is None else states[before]
                z, r, n, rn = (gates[k][:, i * h : (i + 1) * h] for i in range(4))
                dh = dy[k] @ v.T + carry
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (last - n) * z * (1 - z)
                dr = dn * rn * r * (1 - r)
                dpre[k] = np.concatenate([dz, dr, dn], axis=1)
                drec[k] = np.concatenate([dz, dr, dn * r], axis=1)
                carry = dh * z + drec[k] @ p["U" + d].T
            shifted = np.zeros_like(states)
            if d == "f":
                shifted[1:] = states[:-1]
            else:
                shifted[:-1] = states[1:]
            g["U" + d] = shifted.reshape(-1, h).T @ drec.reshape(-1, 3 * h)
            table = np.zeros_like(p["W" + d])
            np.add.at(table, x.ravel(), dpre.reshape(-1, 3 * h))
            g["W" + d] = table
        return loss, g

    def train(self, texts: list[bytes], labels: list[int], steps: int | None = None, batch: int = 192, rate: float = 0.03, seed: int = 11):
        """Adam over random windows, languages in turn; many languages take more steps."""
        g = np.random.default_rng(seed)
        by = [[t for t, y in zip(texts, labels, strict=True) if y == k and t] for k in range(len(self.langs))]
        ready = [k for k in range(len(by)) if by[k]]
        if not ready:
            return self
        steps = steps or 220 * -(-len(ready) // 16)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            x, valid, y = np.full((TRAIN_WINDOW, batch), 32, np.uint8), np.zeros((TRAIN_WINDOW, batch), bool), np.empty(batch, np.int64)
            for i in range(batch):
                k = ready[(step * batch + i) % len(ready)]
                t = by[k][g.integers(len(by[k]))]
                at = g.integers(max(1, len(t) - TRAIN_WINDOW + 1)) if g.random() < 0.8 else 0
                w = np.frombuffer(t[at : at + TRAIN_WINDOW], np.uint8)
                x[: len(w), i], valid[: len(w), i], y[i] = w, True, k
            _, grads = self.gradients(x, y, valid)
            norm = max(1.0, float(np.sqrt(sum((a * a).sum() for a in grads.values()))))
            now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
            for k, a in grads.items():
                a = a / norm
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (documents, languages) over all bytes; uniform for empty texts."""
        sums = np.zeros((len(texts), len(self.langs)))
        sizes = np.array([len(t) for t in texts])
        counts = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), counts)
        # each text stands between margins of blanks, its windows a fixed number of bytes apart
        begin = np.r_[0, np.cumsum(counts * WINDOW + 2 * MARGIN)]
        data = np.full(begin[-1], 32, np.uint8)
        for t, at in zip(texts, begin.tolist(), strict=False):
            data[at + MARGIN : at + MARGIN + len(t)] = np.frombuffer(t, np.uint8)
        place = (np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)) * WINDOW
        inside, wide = np.arange(WINDOW)[:, None], np.arange(WINDOW + 2 * MARGIN)[:, None]
        side = max(64, BATCH * 8 // max(8, len(self.langs)))
        for at in range(0, len(owner), side):
            own, first = owner[at : at + side], place[at : at + side]
            probs = self.probabilities(data[(begin[own] + first)[None] + wide])[MARGIN : MARGIN + WINDOW]
            valid = inside < (sizes[own] - first)[None]
            np.add.at(sums, own, np.einsum("tnl,tn->nl", probs, valid.astype(np.float32)))
        return np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], 1 / max(1, len(self.langs)))


def windows(data: bytes) -> list[bytes]:
    """The first training window and others from anywhere in the text, the same ones each time."""
    last = len(data) - TRAIN_WINDOW
    places = {0, *np.random.default_rng(zlib.crc32(data)).integers(0, last + 1, WINDOWS_EACH - 1).tolist()} if last > 0 else {0}
    return [data[a : a + TRAIN_WINDOW] for a in sorted(places)]


def sample(docs: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], list[bytes], list[int]]:
    """All languages, and training windows with their languages' positions.

    Of each language the ``DOCS_EACH`` ids that come first by a hash take part (fewer of each where the
    languages are so many that ``DOCS`` would be exceeded, but one at least); of the texts of a repeated id one counts.
    Null ids, texts and languages teach nothing.  Windows are cut on the executors from whole texts.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("y")).filter(usable & F.col("y").isNotNull() & F.col("t").isNotNull() & F.col("i").isNotNull())
    counts = counted(rows)
    if not counts:
        return [], [], []
    langs = sorted(counts)
    each = max(1, min(DOCS_EACH, DOCS // len(langs)))
    texts = with_texts(drawn(rows, counts, dict.fromkeys(langs, each), "langid"), rows, ["y", "i"])
    kind = texts.schema["i"].dataType.simpleString()

    def make():
        return lambda columns: [(y, i, w) for y, i, t in zip(*columns, strict=True) for w in windows(t.encode("utf-8", "replace"))]

    got = sorted(map(tuple, map_rows(texts, make, f"y string, i {kind}, w binary").collect()))
    place = {y: k for k, y in enumerate(langs)}
    return langs, [bytes(w) for *_, w in got], [place[y] for y, *_ in got]


def fit(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """The network trained on the rows for which ``usable`` (a condition on column ``i``, the id) holds."""
    langs, texts, labels = sample(docs, F.lit(True) if usable is None else usable, id_col, text_col, lang_col)
    return Network(langs).train(texts, labels)


def has_letter(text: str) -> bool:
    return bool(ASCII_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text))


def rated(network: Network, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, mean probability); ``und`` and 0 if the text is null or has no letter, or nothing was learned."""
    use = [i for i, t in enumerate(texts) if t and network.langs and has_letter(t)]
    out = [("und", 0.0)] * len(texts)
    if use:
        means = network.documents([texts[i].encode("utf-8", "replace") for i in use])
        best = means.argmax(axis=1)
        for i, k, m in zip(use, best.tolist(), means[np.arange(len(use)), best].tolist(), strict=True):
            out[i] = (network.langs[k], min(1.0, max(0.0, m)))
    return out


def identify(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row; the whole text counts.

    Null ids and repeated rows stay, an empty table gives none, other columns are not looked at.
    """

    def make():
        return lambda columns: [(i, *r) for i, r in zip(columns[0], rated(network, columns[1]), strict=True)]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), make, f"{id_col} {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """crc32(id as text) mod 4 is 2; false for null ids, which are never learned from either."""
    return F.coalesce(crc_mod(id_col, 4) == 2, F.lit(False))


def keep_identified(docs: DataFrame, network: Network, least: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known with a mean probability of ``least``; columns unchanged.

    Where there was nothing to learn from, texts with a letter stay.
    """
    import pandas as pd

    def known(batches):
        for texts in batches:
            if not network.langs:
                yield texts.map(lambda t: bool(t) and has_letter(t)).astype(bool)
                continue
            yield pd.Series([lang != "und" and score >= least for at in range(0, len(texts), 128) for lang, score in rated(network, texts.iloc[at : at + 128].tolist())], dtype=bool)

    from collections.abc import Iterator

    known.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.filter(F.pandas_udf(known, "boolean")(F.col(f"`{text_col}`")))
