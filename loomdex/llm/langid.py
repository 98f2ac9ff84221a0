"""Language of documents and of mixed-language segments: a bidirectional gated recurrent network over bytes.

The recurrence goes in steps of four bytes (sentences start on a new step): each of the four byte places has its own
input table, and the sum of the four rows feeds two gated recurrent units, one from each side. Every byte gets its own
label distribution, from an output layer of its place; sentences and documents pool the bytes' log-probabilities.
Trained in numpy by backpropagation through time.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import main_language

CHUNK = 4
HIDDEN = 16
#: positions of a window: texts are cut into windows, all of which are labelled
WINDOW = 256
BATCH = 512
#: pages of one language that training may take (a bounded sample of labelled rows), steps and batch
TRAIN_PAGES = 240
STEPS = 260
TRAIN_BATCH = 64
TRAIN_POSITIONS = 48

_CLOSED = re.compile(r"[.!?…][\"”»’)]*$")
_ITEM = re.compile(r"\s*(?:[-–—•·*▪◦‣]|\(?\w{1,3}[.)]\s)")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»’)]*\s+")


class Network:
    """Weights and the two passes."""

    def __init__(self, languages: list[str], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        h, n = HIDDEN, len(languages)
        self.languages = list(languages)
        self.p = {
            "w": (rng.standard_normal((CHUNK, 256, 2, 3 * h)) * 0.15).astype(np.float32),
            "u": (rng.standard_normal((2, h, 3 * h)) / np.sqrt(h)).astype(np.float32),
            "b": np.zeros((2, 1, 3 * h), np.float32),
            "v": (rng.standard_normal((2 * h, CHUNK * n)) / np.sqrt(2 * h)).astype(np.float32),
            "c": np.zeros(CHUNK * n, np.float32),
        }

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        """(positions, batch, 2, 3 h) from byte chunks (positions, batch, CHUNK)."""
        w = self.p["w"]
        out = w[0][x[..., 0]]
        for k in range(1, CHUNK):
            out += w[k][x[..., k]]
        return out

    def states(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (positions, batch, 2 h). ``mask`` (positions, batch) is 0 in the padding."""
        t, b = x.shape[:2]
        h, u, bias = HIDDEN, self.p["u"], self.p["b"]
        inputs = self._inputs(x)
        out = np.empty((t, b, 2 * h), np.float32)
        s = np.zeros((2, b, h), np.float32)
        xs = np.empty((2, b, 3 * h), np.float32)
        for i in range(t):
            j = t - 1 - i
            xs[0], xs[1] = inputs[i, :, 0], inputs[j, :, 1]
            xs += bias
            hu = s @ u
            zr = 1 / (1 + np.exp(-(xs[..., : 2 * h] + hu[..., : 2 * h])))
            z, r = zr[..., :h], zr[..., h:]
            n = np.tanh(xs[..., 2 * h :] + r * hu[..., 2 * h :])
            if keep is not None:
                keep.append((s, z, r, n, hu[..., 2 * h :].copy()))
            s = n + z * (s - n)
            s[1] *= mask[j][:, None]
            out[i, :, :h], out[j, :, h:] = s[0], s[1]
        return out

    def _logits(self, states: np.ndarray) -> np.ndarray:
        """(positions, batch, CHUNK, languages), the greatest of each byte at 0."""
        logits = states @ self.p["v"] + self.p["c"]
        logits = logits.reshape(*states.shape[:2], CHUNK, len(self.languages))
        logits -= logits.max(-1, keepdims=True)
        return logits

    def _ready(self) -> tuple:
        """Weights for :meth:`log_probabilities`: both directions' input tables with the bias in them, halved where a
        gate's logistic function is taken as a hyperbolic tangent, and the output layers."""
        h, n = HIDDEN, len(self.languages)
        half = np.ones(3 * h, np.float32)
        half[: 2 * h] = 0.5
        w = self.p["w"].transpose(2, 0, 1, 3) * half
        w[:, 0] += (self.p["b"] * half)
        v, c = self.p["v"], self.p["c"]
        ones = np.kron(np.eye(CHUNK, dtype=np.float32), np.ones((n, 1), np.float32))
        return w, self.p["u"] * half, v, c, v.reshape(2 * h, CHUNK, n).mean(1), c.reshape(CHUNK, n).mean(0), ones

    def log_probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Mean log-probability of each language over the bytes of each position. The same states as
        :meth:`states`, without what training keeps."""
        w, u, v, c, v_mean, c_mean, ones = self._ready()
        t, b = x.shape[:2]
        h = HIDDEN
        inputs = np.empty((t, 2, b, 3 * h), np.float32)
        for side, order in ((0, slice(None)), (1, slice(None, None, -1))):
            y = x[order]
            total = w[side, 0][y[..., 0]]
            for k in range(1, CHUNK):
                total += w[side, k][y[..., k]]
            inputs[:, side] = total
        out = np.empty((t, b, 2 * h), np.float32)
        s = np.zeros((2, b, h), np.float32)
        hu = np.empty((2, b, 3 * h), np.float32)
        keep = mask[::-1, :, None]
        for i in range(t):
            xs = inputs[i]
            np.matmul(s, u, out=hu)
            zr = xs[..., : 2 * h] + hu[..., : 2 * h]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            new = zr[..., h:] * hu[..., 2 * h :]
            new += xs[..., 2 * h :]
            np.tanh(new, out=new)
            s -= new
            s *= zr[..., :h]
            s += new
            s[1] *= keep[i]
            out[i, :, :h], out[t - 1 - i, :, h:] = s[0], s[1]
        flat = out.reshape(t * b, 2 * h)
        each = flat @ v
        each += c
        np.exp(np.minimum(each, 80, out=each), out=each)
        norm = np.log(each @ ones).sum(1, keepdims=True) / CHUNK
        return (flat @ v_mean + c_mean - norm).reshape(t, b, -1)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over unpadded positions and its gradients, through time."""
        h = HIDDEN
        keep: list = []
        states = self.states(x, mask, keep)
        q = np.exp(self._logits(states))
        q /= q.sum(-1, keepdims=True)
        t, b = y.shape
        total = mask.sum() * CHUNK
        at = np.broadcast_to(y[..., None, None], (t, b, CHUNK, 1))
        picked = np.take_along_axis(q, at, -1)[..., 0]
        loss = float(-(np.log(picked + 1e-9) * mask[..., None]).sum() / total)
        np.put_along_axis(q, at, picked[..., None] - 1, -1)
        d_logits = (q * (mask / total)[..., None, None]).reshape(t, b, -1)
        g = {"v": np.einsum("tbh,tbl->hl", states, d_logits, optimize=True), "c": d_logits.sum((0, 1))}
        d_out = d_logits @ self.p["v"].T
        u = self.p["u"]
        d_u, d_b = np.zeros_like(u), np.zeros_like(self.p["b"])
        d_in = np.empty((t, b, 2, 3 * h), np.float32)
        ds = np.zeros((2, b, h), np.float32)
        for i in range(t - 1, -1, -1):
            j = t - 1 - i
            s, z, r, n, hun = keep[i]
            ds[0] += d_out[i, :, :h]
            ds[1] += d_out[j, :, h:]
            ds[1] *= mask[j][:, None]
            dn = ds * (1 - z) * (1 - n * n)
            dz = ds * (s - n) * z * (1 - z)
            dr = dn * hun * r * (1 - r)
            gates = np.concatenate([dz, dr, dn], -1)
            back = np.concatenate([dz, dr, dn * r], -1)
            d_u += s.transpose(0, 2, 1) @ back
            d_b += gates.sum(1, keepdims=True)
            ds = ds * z + back @ u.transpose(0, 2, 1)
            d_in[i, :, 0], d_in[j, :, 1] = gates[0], gates[1]
        d_w = np.zeros_like(self.p["w"])
        flat = d_in.reshape(t * b, -1)
        for k in range(CHUNK):
            idx = x[..., k].ravel()
            order = np.argsort(idx, kind="stable")
            values, starts = np.unique(idx[order], return_index=True)
            d_w[k][values] = np.add.reduceat(flat[order], starts, 0).reshape(len(values), 2, 3 * h)
        return loss, g | {"u": d_u, "b": d_b, "w": d_w}


def chunks(sentence: str) -> np.ndarray:
    """(positions, CHUNK) bytes of a sentence, lower-cased, ended by a blank and padded with zeros."""
    raw = (sentence.lower() + " ").encode("utf-8", "replace")
    return np.frombuffer(raw + b"\0" * (-len(raw) % CHUNK), np.uint8).reshape(-1, CHUNK)


def sentences(text: str) -> list[str]:
    """Sentences of a line; a line without an end mark is one."""
    return [s for s in _SENTENCE.split(text.strip()) if s]


def train(labelled: list[tuple[str, str]], steps: int = STEPS, seed: int = 5) -> Network:
    """A network from (language, text) rows; languages are drawn evenly, and a third of the sequences changes
    language half way, so that borders of segments are learnt too. Adam, decreasing rate."""
    by: dict[str, list[list[np.ndarray]]] = {}
    for lang, text in labelled:
        parts = [chunks(s) for line in text.split("\n") for s in sentences(line)]
        if parts:
            by.setdefault(lang, []).append(parts)
    languages = sorted(by)
    if not languages:
        return Network(["und"], seed)
    net, rng = Network(languages, seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}

    def sequence(lang: int, size: int) -> np.ndarray:
        pages = by[languages[lang]]
        parts = pages[rng.integers(len(pages))]
        at, out, n = int(rng.integers(len(parts))), [], 0
        while n < size and at < len(parts):
            out.append(parts[at])
            n += len(parts[at])
            at += 1
        return np.concatenate(out)[:size]

    for step in range(steps):
        x = np.zeros((TRAIN_POSITIONS, TRAIN_BATCH, CHUNK), np.intp)
        y = np.zeros((TRAIN_POSITIONS, TRAIN_BATCH), np.intp)
        mask = np.zeros((TRAIN_POSITIONS, TRAIN_BATCH), np.float32)
        for i in range(TRAIN_BATCH):
            at = 0
            sizes = [TRAIN_POSITIONS] if rng.random() < 0.67 else [k := int(rng.integers(12, TRAIN_POSITIONS - 11)), TRAIN_POSITIONS - k]
            for size in sizes:
                lang = int(rng.integers(len(languages)))
                s = sequence(lang, size)
                x[at : at + len(s), i], y[at : at + len(s), i], mask[at : at + len(s), i] = s, lang, 1
                at += len(s)
        _, g = net.gradients(x, mask, y)
        rate = 0.02 * min(1, (step + 1) / 20) * (1 - step / steps) + 1e-4
        for k, d in g.items():
            m[k] = 0.9 * m[k] + 0.1 * d
            v2[k] = 0.98 * v2[k] + 0.02 * d * d
            net.p[k] -= rate * (m[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v2[k] / (1 - 0.98 ** (step + 1))) + 1e-7)
    return net


def label(net: Network, texts: list[list[str]]) -> list[np.ndarray]:
    """For each text (its sentences) the mean log-probability of each language in each sentence."""
    parts = [[chunks(s) for s in t] for t in texts]
    flat = [np.concatenate(p) if p else np.zeros((0, CHUNK), np.uint8) for p in parts]
    windows = [(i, a, min(a + WINDOW, len(f))) for i, f in enumerate(flat) for a in range(0, len(f), WINDOW)]
    windows.sort(key=lambda w: w[2] - w[1])
    scores = [np.empty((len(f), len(net.languages)), np.float32) for f in flat]
    for k in range(0, len(windows), BATCH):
        part = windows[k : k + BATCH]
        t = part[-1][2] - part[-1][1]
        x = np.zeros((t, len(part), CHUNK), np.uint8)
        mask = np.zeros((t, len(part)), np.float32)
        for c, (i, a, b) in enumerate(part):
            x[: b - a, c], mask[: b - a, c] = flat[i][a:b], 1
        lp = net.log_probabilities(x, mask)
        for c, (i, a, b) in enumerate(part):
            scores[i][a:b] = lp[: b - a, c]
    out = []
    for p, s in zip(parts, scores, strict=True):
        sizes = np.array([len(c) for c in p])
        out.append(np.add.reduceat(s, np.cumsum(sizes) - sizes, 0) / sizes[:, None] if len(p) else np.zeros((0, len(net.languages)), np.float32))
    return out


def normalized_label(label: Column, codes: DataFrame) -> Column:
    """ISO 639-3 code that a label names in any code or spelling of ``codes``, with or without region; else null.

    ``codes`` (iso3, iso3_bib, iso2, english_name) is the fixed list of languages: its few rows become literals.
    """
    spellings = {}
    for r in codes.collect():
        spellings |= {str(x).strip().lower(): r["iso3"] for x in (r["iso3"], r["iso3_bib"], r["iso2"], r["english_name"]) if x}
    table = F.create_map(*[F.lit(x) for kv in sorted(spellings.items()) for x in kv]) if spellings else F.create_map().cast("map<string,string>")
    s = F.lower(F.trim(F.regexp_replace(label, r"[\s ]+", " ")))
    return F.coalesce(table[s], table[F.regexp_extract(s, r"^([a-z]{2,3})[-_][a-z0-9]{2,8}(?:[-_][a-z0-9]+)*$", 1)])


#: words of a line without an end mark, and not an item of a list, that make it a sentence and not a phrase
SENTENCE_WORDS = 5
#: consecutive sentences that make a segment count as another language, and the probability it needs
MIN_RUN = 2
MIN_CONFIDENCE = 0.5


def is_sentence(part: str) -> bool:
    """Whether one of :func:`sentences` is a sentence and not a phrase: it has an end mark, or it is a line of
    ``SENTENCE_WORDS`` or more words that opens with no item mark."""
    return bool(_CLOSED.search(part)) or (len(part.split()) >= SENTENCE_WORDS and not _ITEM.match(part))


def segments_of(net: Network, texts: list[list[str]]) -> list[tuple[list[tuple[int, int, str, float]], str | None, float, list[str]]]:
    """Runs of sentences of one language of each text (a list of lines), the language of the whole with its
    probability, and the languages in which ``MIN_RUN`` consecutive sentences are written.

    A sentence takes the language of its pooled bytes, with an end mark or without. Phrases and items
    (:func:`is_sentence`) are labelled too and belong to runs, but neither count nor part the sentences around them
    where written languages are looked for. The confidence of a run or a text is the pooled probability of its language. A text without
    sentences has no run and no language.
    """
    parts = [[s for x in t for s in sentences(x)] for t in texts]
    out = []
    for part, scores in zip(parts, label(net, parts), strict=True):
        if not len(scores):
            out.append(([], None, 0.0, []))
            continue
        runs = _runs(net, scores)
        whole = [i for i, s in enumerate(part) if is_sentence(s)]
        among = _runs(net, scores[whole]) if len(whole) < len(part) else runs
        written = {k for a, b, k, p in among if b - a + 1 >= MIN_RUN and p >= MIN_CONFIDENCE}
        p = np.exp(scores.mean(0))
        k = int(p.argmax())
        out.append((runs, net.languages[k], float(p[k] / p.sum()), sorted(written)))
    return out


def _runs(net: Network, scores: np.ndarray) -> list[tuple[int, int, str, float]]:
    if not len(scores):
        return []
    best = scores.argmax(1)
    cuts = [0, *(np.flatnonzero(np.diff(best)) + 1), len(best)]
    runs = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        p = np.exp(scores[a:b].mean(0))
        runs.append((int(a), int(b - 1), net.languages[best[a]], float(p[best[a]] / p.sum())))
    return runs


def train_on_labels(pages: DataFrame, codes: DataFrame, per_language: int = TRAIN_PAGES) -> Network:
    """A network trained on a bounded sample of labelled pages (page_id, language, content.paragraphs).

    Up to ``per_language`` pages of each language that the labels name are drawn by a hash of the id; a page
    whose common words speak for another language than its label is not used.
    """
    named = pages.select("page_id", normalized_label(F.col("language"), codes).alias("lang"), F.col("content.paragraphs").alias("lines")).where("lang IS NOT NULL AND lines IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in named.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return train([])
    # about twice as many as needed of each language, whatever the size of the table
    every = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, max(1, n // (2 * per_language)))])
    rows = named.where(F.pmod(F.xxhash64("page_id"), every[F.col("lang")]) == 0).limit(8 * per_language * len(counts)).collect()
    rows.sort(key=lambda r: (r["page_id"] * 2654435761 % 2**32, r["page_id"]))
    used: dict[int, tuple[str, str]] = {}
    taken: dict[str, int] = {}
    for r in rows:
        text = "\n".join(x for x in r["lines"] if x)
        if taken.get(r["lang"], 0) < per_language and r["page_id"] not in used and main_language(text) == r["lang"]:
            used[r["page_id"]] = (r["lang"], text)
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
    return train(list(used.values()))


def misnamed_languages(scanned: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, lang): languages written on a page that the page's label does not name.

    ``scanned`` has page_id and ``written`` (languages of at least ``MIN_RUN`` consecutive sentences),
    ``labels`` page_id and lang (null if the label names none).
    """
    found = scanned.select("page_id", F.explode("written").alias("lang")).distinct()
    named = labels.where("lang IS NOT NULL").select("page_id", "lang").distinct()
    return found.join(named, ["page_id", "lang"], "left_anti")
