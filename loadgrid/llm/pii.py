"""Operator 8: personal data by fixed patterns and a BiLSTM-CRF.

Base spans of four kinds come from patterns with checks (see ``base_spans``).
A character-level bidirectional LSTM with a CRF over B/I tags of the kinds is
trained in numpy on windows around labelled spans: a bounded sample of
documents (``SAMPLE_DOCS``, those with the smallest hash that hold a digit or
``@``), at most ``SAMPLE_WINDOWS`` windows, labelled by the base spans; copies
whose phones lose the country prefix or the area, and whose cards and phones
get other separators, teach it forms that the patterns miss.

Whole texts are decoded in overlapping windows; of each window only the
middle counts, so every character has one tag, taken where it has most
context, and spans are read from the joined tags. Every span holds a digit or
an ``@``; windows without one, whose neighbours have none either, can hold no
span and are not decoded. A decoded span is added if it overlaps no base span
and passes the check of its kind (``plausible``), with the patterns' numbers;
national phone numbers, which no pattern bounds, pass if the posterior of each
of their tags reaches ``SURE``.

Null texts count as empty. Repeated rows and null ids stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, broadcast_below, fresh, keep, prepare, texts_of

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, SAMPLE_WINDOWS, EPOCHS, HIDDEN, EMBED = 2000, 1500, 14, 16, 12
WINDOW, STRIDE = 96, 48
_SYMBOLS = 131          # 0 padding, 1..128 ASCII, 129 other letters, 130 the rest

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start, then kind. The leftmost
    matches that don't overlap, kind by kind; a match that fails its check is
    dropped and not tried again. Written without backtracking, so runs of any
    length take linear time."""
    out = []
    pos, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > pos and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, 0, m.end()))
            pos = m.end()
        at = text.find("@", max(pos, at + 1))
    if not _PART.search(text):
        return out
    for m in _DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            parts = [p.span() for p in _PART.finditer(text, m.start(), m.end())]
            for i in range(0, len(parts) - 3, 4):
                short = [text[s:e].lstrip("0") for s, e in parts[i: i + 4]]
                if all(len(x) <= 3 and int(x or 0) <= 255 for x in short):
                    out.append((parts[i][0], 1, parts[i + 3][1]))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


#: Posterior that every character of a decoded national number must reach.
SURE = 0.9


def plausible(kind: int, s: str, sure: float = 0.0) -> bool:
    """The check that a decoded span must pass. ``sure``: the least posterior
    of its tags. A phone of 10 to 15 digits with separators passes by its form,
    a national one of 7 to 15 digits if the tagger is sure of every character."""
    d = _digits(s)
    if kind == 0:
        local, _, domain = s.partition("@")
        return bool(local) and "." in domain.strip(".") and not re.search(r"\s", s)
    if kind == 1:
        parts = re.split(r"[^0-9]+", s)
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts) and len(s) >= 7
    if kind == 2:
        return 14 <= len(d) <= 19 and luhn(d)
    if re.search(r"[^0-9 ().+/-]", s) or not 7 <= len(d) <= 15:
        return False
    return len(d) >= 10 and len(s) - len(d) >= 2 or sure >= SURE


# --- the tagger -------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)        # 0 outside, 2k+1 begins kind k, 2k+2 continues it


def symbols(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(c < 128, c + 1, np.where(c < 0x2000, 129, 130))


def forbidden() -> np.ndarray:
    """Penalty of each (from, to): a kind is continued only after itself."""
    f = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        f[:, 2 * k + 2] = -1e4
        f[[2 * k + 1, 2 * k + 2], 2 * k + 2] = 0
    return f


def _init(rng) -> dict[str, np.ndarray]:
    n = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
    p = {"emb": n(_SYMBOLS, EMBED) * np.sqrt(_SYMBOLS) * 0.5, "out": n(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS),
         "trans": np.zeros((TAGS, TAGS)), "start": np.zeros(TAGS)}
    for d in "fb":
        p |= {f"w{d}": n(EMBED, 4 * HIDDEN), f"u{d}": n(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN)}
        p[f"b{d}"][HIDDEN: 2 * HIDDEN] = 1.0
    return p


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x, u):
    """``x`` (time, rows, 4H) input sums -> hidden states and what the backward pass needs."""
    t, n, h4 = x.shape
    h = np.zeros((n, h4 // 4))
    c, hs, keep = h, np.empty((t, n, h4 // 4)), []
    for i in range(t):
        g = x[i] + h @ u
        s = _sigmoid(g[:, : 3 * HIDDEN])
        a, f, o, z = s[:, :HIDDEN], s[:, HIDDEN: 2 * HIDDEN], s[:, 2 * HIDDEN:], np.tanh(g[:, 3 * HIDDEN:])
        before = c
        c = f * c + a * z
        tc = np.tanh(c)
        keep.append((h, before, a, f, o, z, tc))
        h = o * tc
        hs[i] = h
    return hs, keep


def _lstm_back(dh_all, keep, u):
    t = len(keep)
    dx = np.empty((t, dh_all.shape[1], 4 * HIDDEN))
    du, dh, dc = np.zeros_like(u), 0.0, 0.0
    for i in range(t - 1, -1, -1):
        h0, c0, a, f, o, z, tc = keep[i]
        dh = dh + dh_all[i]
        dc = dc + dh * o * (1 - tc * tc)
        g = dx[i]
        g[:, :HIDDEN] = dc * z * a * (1 - a)
        g[:, HIDDEN: 2 * HIDDEN] = dc * c0 * f * (1 - f)
        g[:, 2 * HIDDEN: 3 * HIDDEN] = dh * tc * o * (1 - o)
        g[:, 3 * HIDDEN:] = dc * a * (1 - z * z)
        du += h0.T @ g
        dh, dc = g @ u.T, dc * f
    return dx, du


def emissions(p, ids):
    """``ids`` (rows, time) -> scores (time, rows, tags) and the passes' states."""
    e = p["emb"][ids.T]
    hf, kf = _lstm(e @ p["wf"] + p["bf"], p["uf"])
    hb, kb = _lstm(e[::-1] @ p["wb"] + p["bb"], p["ub"])
    h = np.concatenate([hf, hb[::-1]], axis=2)
    return h @ p["out"] + p["out_b"], (e, h, kf, kb)


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _crf(p, s, y):
    """Loss per row and its gradients: of the scores, transitions and start."""
    t, n, k = s.shape
    tr = p["trans"] + forbidden()
    alpha, beta = np.empty_like(s), np.zeros_like(s)
    alpha[0] = s[0] + p["start"]
    for i in range(1, t):
        alpha[i] = s[i] + _lse(alpha[i - 1][:, :, None] + tr, 1)
    for i in range(t - 2, -1, -1):
        beta[i] = _lse(tr + (s[i + 1] + beta[i + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    rows = np.arange(n)
    gold = p["start"][y[0]] + s[0][rows, y[0]]
    ds = np.exp(alpha + beta - z[:, None])
    d_start = ds[0].sum(axis=0)
    d_tr = np.zeros_like(tr)
    for i in range(1, t):
        gold = gold + tr[y[i - 1], y[i]] + s[i][rows, y[i]]
        d_tr += np.exp(alpha[i - 1][:, :, None] + tr + (s[i] + beta[i])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(d_tr, (y[i - 1], y[i]), -1)
    np.add.at(d_start, y[0], -1)
    for i in range(t):
        ds[i][rows, y[i]] -= 1
    return (z - gold).sum() / n, ds / n, d_tr / n, d_start / n


def gradients(p, ids, y):
    s, (e, h, kf, kb) = emissions(p, ids)
    loss, ds, d_tr, d_start = _crf(p, s, y.T)
    g = {"trans": d_tr, "start": d_start, "out_b": ds.sum(axis=(0, 1)),
         "out": np.tensordot(h, ds, axes=([0, 1], [0, 1]))}
    dh = ds @ p["out"].T
    de = np.zeros_like(e)
    for d, keep, part, flip in (("f", kf, dh[:, :, :HIDDEN], 1), ("b", kb, dh[::-1, :, HIDDEN:], -1)):
        dx, g[f"u{d}"] = _lstm_back(part, keep, p[f"u{d}"])
        g[f"b{d}"] = dx.sum(axis=(0, 1))
        g[f"w{d}"] = np.tensordot(e[::flip], dx, axes=([0, 1], [0, 1]))
        de += (dx @ p[f"w{d}"].T)[::flip]
    g["emb"] = np.zeros_like(p["emb"])
    np.add.at(g["emb"], ids.T, de)
    return loss, g


def fit(ids: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, rows: int = 64, seed: int = 7):
    """Train by Adam; returns the parameters (fixed size)."""
    rng = np.random.default_rng(seed)
    p = _init(rng)
    m, v, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(ids))
        lr = rate * (1 - epoch / epochs)
        for i in range(0, len(order), rows):
            pick = order[i: i + rows]
            _, g = gradients(p, ids[pick], tags[pick])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            step += 1
            for k, x in g.items():
                x = x * min(1.0, 5.0 / (norm + 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.99 * v[k] + 0.01 * x * x
                p[k] = p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return p


def decode(p, ids: np.ndarray) -> np.ndarray:
    """Best tag sequence of each row (Viterbi)."""
    s, _ = emissions(p, ids)
    tr = p["trans"] + forbidden()
    score, back = s[0] + p["start"], np.zeros(s.shape, np.int8)
    for i in range(1, len(s)):
        x = score[:, :, None] + tr
        back[i] = x.argmax(axis=1)
        score = x.max(axis=1) + s[i]
    out = np.empty((len(ids), len(s)), np.int8)
    tag = score.argmax(axis=1)
    rows = np.arange(len(ids))
    for i in range(len(s) - 1, -1, -1):
        out[:, i] = tag
        tag = back[i][rows, tag]
    return out


def posteriors(p, ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Probability of each given tag at its place (forward-backward)."""
    s, _ = emissions(p, ids)
    tr = p["trans"] + forbidden()
    alpha, beta = np.empty_like(s), np.zeros_like(s)
    alpha[0] = s[0] + p["start"]
    for i in range(1, len(s)):
        alpha[i] = s[i] + _lse(alpha[i - 1][:, :, None] + tr, 1)
    for i in range(len(s) - 2, -1, -1):
        beta[i] = _lse(tr + (s[i + 1] + beta[i + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    own = np.take_along_axis(alpha + beta, tags.T[:, :, None].astype(np.int64), 2)[:, :, 0]
    return np.exp(own - z).T


# --- windows ----------------------------------------------------------------

def _starts(text: str) -> list[int]:
    """Starts of the windows that can hold a part of a span."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    near = set()
    for m in _TRIGGER.finditer(text):
        k = m.start() // STRIDE
        near.update(range(max(0, k - 2), min(last, k + 1) + 1))
    return [k * STRIDE for k in sorted(near)]


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], p: dict, rows: int = 256):
    """For each text the decoded spans that pass and overlap no base span."""
    todo = [(t, s) for t, text in enumerate(texts) for s in _starts(text)]
    tags: dict[int, dict[int, tuple[int, float]]] = {}
    for i in range(0, len(todo), rows):
        part = todo[i: i + rows]
        ids = np.zeros((len(part), WINDOW), np.int64)
        for r, (t, s) in enumerate(part):
            x = symbols(texts[t][s: s + WINDOW])
            ids[r, : len(x)] = x
        got = decode(p, ids)
        sure = np.zeros(got.shape)
        phones = np.flatnonzero((got >= 2 * 3 + 1).any(axis=1))
        if len(phones):
            sure[phones] = posteriors(p, ids[phones], got[phones])
        edge = (WINDOW - STRIDE) // 2
        for r, (t, s) in enumerate(part):
            lo = 0 if s == 0 else edge
            hi = WINDOW if s + WINDOW >= len(texts[t]) else edge + STRIDE
            for j in np.flatnonzero(got[r, lo:hi]):
                tags.setdefault(t, {})[s + lo + int(j)] = (int(got[r, lo + j]), float(sure[r, lo + j]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for t, tag in tags.items():
        spans, text = [], texts[t]
        for at in sorted(tag):
            n, sure = tag[at]
            kind, begins = (n - 1) // 2, n % 2 == 1
            if spans and not begins and spans[-1][1] == kind and spans[-1][2] == at:
                spans[-1][2:] = [at + 1, min(sure, spans[-1][3])]
            else:
                spans.append([at, kind, at + 1, sure])
        for s, kind, e, sure in spans:
            if e <= len(text) and plausible(kind, text[s:e], sure) and not any(s < b and a < e for a, _, b in base[t]):
                out[t].append((s, kind, e))
    return out


def _variants(text: str, spans, rng):
    """The window itself, and a copy in forms that the patterns miss."""
    yield text, spans
    if not any(k >= 2 for _, k, _ in spans):
        return
    out, moved, at = "", [], 0
    for s, k, e in spans:
        if s < at:
            return
        x = text[s:e]
        if k == 3:
            x = re.sub(r"^\+[0-9]{1,3}[ .-]+", "", x)       # a prefix that stands apart; else the number stays whole
            if rng.integers(2):
                x = re.sub(r"^\([0-9]+\) ?", "", x)           # local: without the area
            x = x.replace("-", rng.choice([".", "-", " "]))
        elif k == 2:
            d, sep = _digits(x), str(rng.choice([" ", "-", ".", "/"]))
            x = sep.join(d[i: i + 4] for i in range(0, len(d), 4))
        out += text[at:s]
        moved.append((len(out), k, len(out) + len(x)))
        out += x
        at = e
    yield (out + text[at:])[:WINDOW], moved


def _labelled(seed: int = 3):
    def run(batches):
        rng = np.random.default_rng(seed)
        for b in batches:
            for h, text in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                spans = base_spans(text)
                starts = sorted({max(0, s - 8 - int(rng.integers(0, 40))) for s, _, _ in spans})[:4]
                hits = [m.start() for m in _TRIGGER.finditer(text)]
                if hits:                       # and a place whose digits may be no personal data
                    starts.append(max(0, hits[int(rng.integers(0, len(hits)))] - int(rng.integers(0, WINDOW))))
                for s in starts:
                    inside = [(x - s, k, y - s) for x, k, y in spans if x >= s and y <= s + WINDOW]
                    if any(x < s + WINDOW and y > s for x, k, y in spans if not (x >= s and y <= s + WINDOW)):
                        continue
                    for n, (w, sp) in enumerate(_variants(text[s: s + WINDOW], inside, rng)):
                        x, t = np.zeros(WINDOW, np.uint8), np.zeros(WINDOW, np.uint8)
                        ids = symbols(w)
                        x[: len(ids)] = ids
                        for a, k, e in sorted(sp, key=lambda q: -q[1]):
                            t[a:e] = 2 * k + 2
                            t[a] = 2 * k + 1
                        yield batch(_WINDOWS, [h], [s * 2 + n], [x.tobytes()], [t.tobytes()])
    return run


_WINDOWS = pa.schema([("h", pa.int64()), ("at", pa.int64()), ("ids", pa.binary()), ("tags", pa.binary())])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS, epochs: int = EPOCHS) -> dict | None:
    """Parameters of the tagger, or None if no window was found."""
    prepare(docs.sparkSession)
    keyed = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("h"), "text")
    chosen = keyed.select("h").distinct().orderBy("h").limit(sample_docs)
    rows = keyed.join(broadcast_below(chosen, sample_docs), "h").dropDuplicates(["h"]).mapInArrow(
        _labelled(), "h long, at long, ids binary, tags binary").orderBy(F.xxhash64("h", "at"), "h", "at") \
        .limit(sample_windows).toPandas()
    if rows.empty:
        return None
    x, y = (np.stack([np.frombuffer(v, np.uint8) for v in rows[c]]).astype(np.int64) for c in ("ids", "tags"))
    return fit(x, y, epochs)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans) -> str:
    """The text with every span, overlapping ones as one, replaced by its kind."""
    out, at = [], 0
    end, name = 0, ""
    for s, k, e in [*spans, (len(text) + 1, 0, len(text) + 1)]:
        if name and s < end:
            end = max(end, e)
            continue
        if name:
            out.append(name)
            at = end
        out.append(text[at:s])
        end, name = e, f"[{KINDS[k].upper()}]"
    return "".join(out)


def _pattern_udf(shared, mask: bool):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for series in batches:
            texts = [t or "" for t in series]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, p) if p else [[] for _ in texts]
            rows = []
            for text, b, m in zip(texts, base, more):
                spans = sorted(b + m)
                n = [sum(k == i for _, k, _ in b) for i in range(len(KINDS))]
                rows.append((*n, joined(b) if not mask else None, joined(spans),
                             masked(text, spans) if mask and spans else None))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans", "masked"])
    return F.pandas_udf(run, "n_email long, n_ip long, n_card long, n_phone long, base string, spans string, masked string")


def find(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, the numbers of base spans, the
    fingerprint of the base spans, and all spans."""
    udf = _pattern_udf(docs.sparkSession.sparkContext.broadcast(model), False)
    return docs.select("doc_id", udf(F.col("text")).alias("p")).select(
        "doc_id", "p.n_email", "p.n_ip", "p.n_card", "p.n_phone", F.sha2(F.col("p.base").cast("binary"), 256).alias("base_sha256"),
        "p.spans")


def redact(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``[KIND]``; a column
    ``n_chars`` follows the new text. All rows stay."""
    udf = _pattern_udf(docs.sparkSession.sparkContext.broadcast(model), True)
    (p,) = fresh(docs, "__p")
    new = docs.withColumn(p, udf(F.col("text")))
    out = dict(zip(docs.columns, keep(docs)))
    out["text"] = F.coalesce(f"{p}.masked", "text")
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col(f"{p}.masked").isNotNull(), F.length(f"{p}.masked")).otherwise(F.col("n_chars")) \
            .cast(docs.schema["n_chars"].dataType)
    return new.select(*[v.alias(c) for c, v in out.items()])
