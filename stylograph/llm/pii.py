"""Problem 2: personal information inside free text, by a linear-chain conditional random field.

The field's features are shapes, affixes and list memberships of a token and its neighbours; it is trained by gradient ascent of
the likelihood from a small labelled table (`pii_examples`) and decoded by Viterbi over batches of texts in
numpy. Found spans are checked for what their kind must hold (digits, an at sign, two parts of a name), then
reported or replaced by typed placeholders. The weights are kept beside this module (`python -m stylograph.llm.pii` fits them anew);
the lists of known names are those of the data, and only mark tokens for the field.

Defined results: null, empty and blank texts hold nothing and stay as they are; each different piece of a record
comes once; repeated rows give the same pieces once; texts are read whole, whatever their length; rows with a null identifier
are left out of the pieces; further columns are kept by `redact` and not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stylograph.llm.pii_examples import labelled_table, people
from stylograph.sources.tables import small_rows

KINDS = ("email", "phone", "id_number", "address", "name")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Rows of the table of known names that are read at most; the table is fixed for a corpus.
MOST_NAMES = 100_000
NEAR = (-2, -1, 0, 1, 2)
FAR = (-5, -4, -3, 3, 4, 5)
#: Windows of which the classes of all tokens together are a feature, and the number of classes.
WINDOWS = ((-2, -1, 0), (-1, 0, 1), (0, 1, 2), (-1, 0, 1, 2))
CLASSES = 26
SIGNS = {".": 14, ",": 15, "@": 16, "-": 17, "/": 18, "(": 19, ")": 20, "+": 21, ":": 22, "'": 23, "’": 23}

#: Token keys whose scores are kept.
MOST_ROWS = 150_000

_SPACE = r"\s​﻿⁠"
_TOKEN = re.compile(rf"[^\W\d_]+|\d+|[^{_SPACE}]")


def tokenize(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def _gap(text: str, end: int, start: int) -> str:
    if end == start:
        return "g0" if end else "gs"
    return "gn" if "\n" in text[end:start] else "g1"


def token_key(token: str, gap: str) -> str:
    """What all features of a token are made from; digits count by their number only, but for a few."""
    if token.isdigit():
        token = token if token in ("0", "00", "1", "44", "49", "33", "34", "0044", "555") else "9" * min(len(token), 12) if token[0] != "0" else "0" + "9" * (min(len(token), 12) - 1)
    return gap + token


class Features:
    """Feature names of token keys; `vocabulary` holds the words with a feature of their own."""

    def __init__(self, given: set[str], family: set[str], vocabulary: set[str]):
        self.given, self.family, self.vocabulary = given, family, vocabulary

    def coarse(self, key: str) -> list[str]:
        gap, token = key[:2], key[2:]
        low = token.lower()
        out = ["one", gap]
        if token[0].isdigit():
            out += [f"digits{len(token)}", f"zero{token[0] == '0'}", "digits"]
            if set(token) - set("09"):
                out.append("w=" + token)
        elif token.isalpha():
            shape = "X" if token.isupper() and len(token) == 1 else "XX" if token.isupper() else "Xx" if token[0].isupper() else "x" if len(token) == 1 else "xx"
            out += [shape, gap + shape]
            if low in self.vocabulary:
                out.append("w=" + low)
            else:
                out.append("rare" + shape)
            if low in self.given:
                out.append("given")
            if low in self.family:
                out.append("family")
            if low in self.given or low in self.family:
                out.append("known" + shape)
        else:
            out += ["w=" + token, gap + token]
        return out

    def token_class(self, key: str) -> int:
        """One of CLASSES - 1 kinds of tokens, from 1."""
        token = key[2:]
        low = token.lower()
        if token[0].isdigit():
            return 10 + min(3, (len(token) > 2) + (len(token) > 4) + (len(token) > 8))
        if not token.isalpha():
            return SIGNS.get(token, 24)
        known = 1 if low in self.given else 2 if low in self.family else 0
        if len(token) == 1 and token.isupper():
            return 9
        if token[0].isupper():  # 3 unknown, 4 and 5 known, 6 a common word, 25 in capitals
            return 3 + known if known else 25 if token.isupper() else 6 if low in self.vocabulary else 3
        return 6 + known if known else 1 if low in self.vocabulary else 2

    def fine(self, key: str) -> list[str]:
        token = key[2:]
        out = self.coarse(key)
        if token.isalpha() and len(token) >= 4:
            low = token.lower()
            shape = "X" if token.isupper() else "Xx" if token[0].isupper() else "x"
            for n in (3, 4, 5):
                out += [f"e{low[-n:]}", f"e{shape}{low[-n:]}"]
            out += [f"s{low[:3]}", f"s{low[:4]}"]
        return out


class Field:
    """The conditional random field: weights by feature and offset, and transitions."""

    def __init__(self, features: Features, names: dict[str, int], near: np.ndarray, far: np.ndarray, windows: list[np.ndarray], transitions: np.ndarray):
        self.features, self.names, self.near, self.far, self.windows, self.transitions = features, names, near, far, windows, transitions
        self._rows: dict[str, int] = {}
        self._seen: dict[str, int] = {}  # the row of a gap and token as written
        self._class = np.zeros(1024, np.int64)
        self._store = np.zeros((1024, len(NEAR) + len(FAR), len(LABELS)), np.float32)

    def _row(self, key: str) -> int:
        row = self._rows.get(key)
        if row is None:
            row = self._rows[key] = len(self._rows) + 1  # row 0 is beyond a text
            if row >= len(self._store):
                self._store = np.concatenate([self._store, np.zeros_like(self._store)])
                self._class = np.concatenate([self._class, np.zeros_like(self._class)])
            self._class[row] = self.features.token_class(key)
            fine = [self.names[f] for f in self.features.fine(key) if f in self.names]
            coarse = [self.names[f] for f in self.features.coarse(key) if f in self.names]
            self._store[row, : len(NEAR)] = self.near[:, fine].sum(1)
            self._store[row, len(NEAR) :] = self.far[:, coarse].sum(1)
        return row

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        """Scores of labels for padded rows of tokens (texts x tokens, 0 beyond a text)."""
        n, width = rows.shape
        reach = max(*NEAR, *FAR)
        padded = np.zeros((n, width + 2 * reach), rows.dtype)
        padded[:, reach : reach + width] = rows
        out = np.zeros((n, width, len(LABELS)), np.float32)
        for i, offset in enumerate((*NEAR, *FAR)):
            out += self._store[padded[:, reach + offset : reach + offset + width], i]
        for weights, ids in zip(self.windows, window_ids(self._class[padded], reach, width)):
            out += weights[ids]
        return out

    def decode(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Best labels of each text, given as token keys."""
        return self._decoded([np.array([self._row(k) for k in keys], np.int32) for keys in texts])

    def _decoded(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.int8)] * len(ids)
        order = sorted((i for i in range(len(ids)) if len(ids[i])), key=lambda i: len(ids[i]))
        at = 0
        while at < len(order):
            size = max(1, min(400, 60_000 // len(ids[order[min(at + 399, len(order) - 1)]])))
            part = order[at : at + size]
            at += size
            rows = np.zeros((len(part), len(ids[part[-1]])), np.int32)
            for r, i in enumerate(part):
                rows[r, : len(ids[i])] = ids[i]
            for i, labels in zip(part, viterbi(self.emissions(rows), self.transitions, np.array([len(ids[i]) for i in part]))):
                out[i] = labels[: len(ids[i])]
        return out

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Checked pieces (start, end, kind) of each text."""
        if len(self._rows) > MOST_ROWS or len(self._seen) > 2 * MOST_ROWS:  # only here, as rows must not move within a batch
            self._rows.clear()
            self._seen.clear()
        tokens = [tokenize(t) if t else [] for t in texts]
        ids, seen = [], self._seen
        for text, spans in zip(texts, tokens):
            last, row = 0, []
            for a, b in spans:
                token = text[a:b]
                gap = ("g0" if a else "gs") if a == last else "gn" if "\n" in text[last:a] else "g1"
                key = gap + token
                i = seen.get(key)
                if i is None:
                    i = seen[key] = self._row(token_key(token, gap))
                row.append(i)
                last = b
            ids.append(np.array(row, np.int32))
        found = []
        for text, spans, labels in zip(texts, tokens, self._decoded(ids)):
            found.append([p for p in (_checked(text, *piece) for piece in _pieces(spans, labels)) if p] if labels.any() else [])
        return found


def window_ids(classes: np.ndarray, reach: int, width: int) -> list[np.ndarray]:
    """For each of WINDOWS the number of the classes in it, for each token; `classes` has `reach` columns more at both ends."""
    out = []
    for window in WINDOWS:
        ids = np.zeros((len(classes), width), np.int64)
        for offset in window:
            ids = ids * CLASSES + classes[:, reach + offset : reach + offset + width]
        out.append(ids)
    return out


def _pieces(spans: list[tuple[int, int]], labels: np.ndarray) -> Iterator[tuple[int, int, str]]:
    at = 0
    while at < len(labels):
        if not labels[at]:
            at += 1
            continue
        kind = (labels[at] - 1) // 2
        end = at + 1
        while end < len(labels) and labels[end] == 2 * kind + 2:
            end += 1
        yield spans[at][0], spans[end - 1][1], KINDS[kind]
        at = end


_PART = re.compile(r"[^\W\d_]+")
_POST_NOMINAL = re.compile(r"['’]s?\Z")
_PHONE = re.compile(r"[+(\d][\d\s().‑–/-]*(?:,?\s*(?:ext\.?|extension|x)\s?\d+)?", re.I)
_AT = re.compile(r"@|\bat\b", re.I)


def _checked(text: str, start: int, end: int, kind: str) -> tuple[int, int, str] | None:
    """The piece without signs at its ends, if it holds what its kind must."""
    while start < end and not text[start].isalnum() and not (kind == "phone" and text[start] in "(+"):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    piece = text[start:end]
    if kind != "address" and re.search(r"[\t\n]|  ", piece):
        return None  # no more than one space parts a piece, but for lines of an address
    digits = sum(c.isdigit() for c in piece)
    parts = _PART.findall(_POST_NOMINAL.sub("", piece))
    if kind == "name":
        ok = len(parts) >= 2 and max(map(len, parts)) >= 2 and not digits and bool(re.search(r"[\s,.]", piece))
    elif kind == "address":
        ok = digits >= 1 and bool(parts)
    elif kind == "email":
        ok = bool(_AT.search(piece)) and len(parts) >= 2
    else:
        whole = not (start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum())
        ok = whole and (digits >= 8 and bool(_PHONE.fullmatch(piece)) if kind == "phone" else digits >= 6)
    return (start, end, kind) if ok else None


def viterbi(emissions: np.ndarray, transitions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best label paths of padded texts; positions beyond a text come out as its last step's continuation."""
    n, width, labels = emissions.shape
    back = np.empty((n, width, labels), np.int8)
    score = emissions[:, 0] + np.where([x.startswith("I") for x in LABELS], -1e4, 0).astype(np.float32)
    best = score.copy()
    final = score.copy()
    for t in range(1, width):
        step = best[:, :, None] + transitions[None]
        back[:, t] = step.argmax(1)
        best = np.take_along_axis(step, back[:, t][:, None, :].astype(np.int64), 1)[:, 0] + emissions[:, t]
        ended = lengths - 1 == t
        final[ended] = best[ended]
    paths = np.zeros((n, width), np.int8)
    rows = np.arange(n)
    label = final.argmax(1)
    paths[rows, lengths - 1] = label
    for t in range(width - 1, 0, -1):
        inside = t <= lengths - 1
        label = np.where(inside, back[rows, t, label], label)
        paths[inside, t - 1] = label[inside]
    return paths


def _allowed() -> np.ndarray:
    """Transitions that a labelling can have: an inner label follows its own kind only."""
    ok = np.zeros((len(LABELS), len(LABELS)), np.float32)
    for i, a in enumerate(LABELS):
        for j, b in enumerate(LABELS):
            if b.startswith("I") and a[2:] != b[2:]:
                ok[i, j] = -1e4
    return ok


class _Sparse:
    """Which features each key has, for sums over a key's features and over a feature's keys."""

    def __init__(self, lists: list[list[int]], m: int):
        self.m = m
        self.features = np.array([f for fs in lists for f in fs])
        self.starts = np.cumsum([0, *(len(fs) for fs in lists)])[:-1]  # every key has some
        keys = np.repeat(np.arange(len(lists)), [len(fs) for fs in lists])
        order = np.argsort(self.features, kind="stable")
        self.by_feature = keys[order]
        self.present, self.feature_starts = np.unique(self.features[order], return_index=True)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.stack([np.add.reduceat(w[self.features], self.starts) for w in weights])

    def spread(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(values), self.m, values.shape[2]), np.float32)
        for o, v in zip(out, values):
            o[self.present] = np.add.reduceat(v[self.by_feature], self.feature_starts)
        return out


def train(rounds: int = 160, rows: int = 20000, seed: int = 5, l2: float = 2e-6) -> Field:
    """Fit the field to the labelled table by full-batch gradient ascent (Adam) of the mean log-likelihood.

    Half of the table's names are hidden from its lists of known names, so that the field learns to do without them.
    """
    given, family = people(seed)
    table = labelled_table(given, family, rows, seed)
    rng = np.random.default_rng(seed)
    parts = lambda words: {p.lower() for w in words for p in _PART.findall(w)}
    seen = lambda words: [w for w in words if rng.random() < 0.5]
    all_texts, gold = [], []
    words: dict[str, int] = {}
    names = parts(given) | parts(family)
    for text, spans in table:
        tokens, last, keys, labels = tokenize(text), 0, [], []
        for a, b in tokens:
            keys.append(token_key(text[a:b], _gap(text, last, a)))
            low = text[a:b].lower()
            words[low] = words.get(low, 0) + 1
            last = b
            label = 0
            for s, e, kind in spans:
                if s <= a < e:
                    label = 2 * KINDS.index(kind) + (1 if a == s else 2)
            labels.append(label)
        all_texts.append(keys)
        gold.append(labels)
    vocabulary = {w for w, n in words.items() if n >= 8 and w not in names}
    hidden = Features(parts(seen(given)), parts(seen(family)), vocabulary)
    keys = sorted({k for t in all_texts for k in t})
    fine, coarse = [hidden.fine(k) for k in keys], [hidden.coarse(k) for k in keys]
    count: dict[str, int] = {}
    for fs in fine:
        for f in fs:
            count[f] = count.get(f, 0) + 1
    names_of = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n >= 2 or not f.startswith(("e", "s"))))}
    m = len(names_of)
    sparse = [_Sparse([[names_of[f] for f in fs if f in names_of] for fs in lists], m) for lists in (fine, coarse)]
    number = {k: i for i, k in enumerate(keys, 1)}
    lengths = np.array([len(t) for t in all_texts])
    order = np.argsort(lengths, kind="stable")
    batches = []
    for part in np.array_split(order, 8):
        width = lengths[part].max()
        ids, y = np.zeros((len(part), width), np.int64), np.zeros((len(part), width), np.int64)
        for r, i in enumerate(part):
            ids[r, : lengths[i]] = [number[k] for k in all_texts[i]]
            y[r, : lengths[i]] = gold[i]
        batches.append((ids, y, np.arange(width)[None, :] < lengths[part][:, None]))
    total = float(lengths.sum())
    k = len(LABELS)
    params = [np.zeros((len(NEAR), m, k), np.float32), np.zeros((len(FAR), m, k), np.float32), np.zeros((k, k), np.float32)]
    params += [np.zeros((CLASSES ** len(w), k), np.float32) for w in WINDOWS]
    class_of = np.array([0, *map(hidden.token_class, keys)])
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    bans = _allowed()
    start_ban = np.where([name.startswith("I") for name in LABELS], 0.0, 1.0).astype(np.float32)
    reach = max(*NEAR, *FAR)
    for step in range(1, rounds + 1):
        by_key = np.zeros((len(NEAR) + len(FAR), len(keys) + 1, k), np.float32)
        by_key[: len(NEAR), 1:] = sparse[0].sums(params[0])
        by_key[len(NEAR) :, 1:] = sparse[1].sums(params[1])
        d_key = np.zeros_like(by_key)
        d_trans = np.zeros((k, k), np.float32)
        d_windows = [np.zeros_like(p) for p in params[3:]]
        np.clip(params[2], -6.0, 6.0, out=params[2])
        move = np.exp(params[2] + bans)
        for ids, y, mask in batches:
            n, width = ids.shape
            padded = np.zeros((n, width + 2 * reach), np.int64)
            padded[:, reach : reach + width] = ids
            e = np.zeros((n, width, k), np.float32)
            for i, offset in enumerate((*NEAR, *FAR)):
                e += by_key[i][padded[:, reach + offset : reach + offset + width]]
            in_windows = window_ids(class_of[padded], reach, width)
            for weights, at in zip(params[3:], in_windows):
                e += weights[at]
            e = np.exp(np.maximum(e - e.max(2, keepdims=True), -25.0))
            e[~mask] = 1.0
            alpha, beta = np.empty_like(e), np.empty_like(e)
            a = e[:, 0] * start_ban
            alpha[:, 0] = a / np.maximum(a.sum(1, keepdims=True), 1e-30)
            for t in range(1, width):
                a = (alpha[:, t - 1] @ move) * e[:, t]
                a = np.where(mask[:, t, None], a, alpha[:, t - 1])
                alpha[:, t] = a / np.maximum(a.sum(1, keepdims=True), 1e-30)
            beta[:, -1] = 1.0
            for t in range(width - 2, -1, -1):
                b = (e[:, t + 1] * beta[:, t + 1]) @ move.T
                b = np.where(mask[:, t + 1, None], b, 1.0)
                beta[:, t] = b / np.maximum(b.sum(1, keepdims=True), 1e-30)
            post = alpha * beta
            post /= np.maximum(post.sum(2, keepdims=True), 1e-30)
            d = -post
            np.put_along_axis(d, y[:, :, None], np.take_along_axis(d, y[:, :, None], 2) + 1, 2)
            d[~mask] = 0
            for i, offset in enumerate((*NEAR, *FAR)):
                where = padded[:, reach + offset : reach + offset + width].reshape(-1)
                flat = d.reshape(-1, k)
                for label in range(k):
                    d_key[i, :, label] += np.bincount(where, flat[:, label], minlength=len(keys) + 1)
            for grad, at in zip(d_windows, in_windows):
                where = at.reshape(-1)
                for label in range(k):
                    grad[:, label] += np.bincount(where, flat[:, label], minlength=len(grad))
            both = mask[:, 1:]
            left, right = alpha[:, :-1][both], (e * beta)[:, 1:][both]
            weight = 1.0 / np.maximum(np.einsum("ni,ij,nj->n", left, move, right, optimize=True), 1e-30)
            d_trans -= move * ((left * weight[:, None]).T @ right)
            np.add.at(d_trans, (y[:, :-1][both], y[:, 1:][both]), 1.0)
        d_key[:, 0] = 0
        grads = [sparse[0].spread(d_key[: len(NEAR), 1:]), sparse[1].spread(d_key[len(NEAR) :, 1:]), d_trans, *d_windows]
        rate = 0.08 * min(1.0, 2.0 * (1 - step / (rounds + 1)))
        for p, g, u, v in zip(params, grads, first, second):
            g = g / total - l2 * p
            u += 0.15 * (g - u)
            v += 0.03 * (g * g - v)
            p += rate * (u / (1 - 0.85**step)) / (np.sqrt(v / (1 - 0.97**step)) + 1e-5)
    return Field(Features(set(), set(), vocabulary), names_of, params[0], params[1], params[3:], params[2] + bans)


WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_weights.npz")
#: Weights below this say nothing and are left out of the stored field.
LEAST_WEIGHT = 0.02


def store(field: Field, path: str = WEIGHTS) -> None:
    """Keep a field's weights: features by name, weights in half precision."""
    names = sorted(field.names, key=field.names.get)
    near, far = (np.where(np.abs(w) < LEAST_WEIGHT, 0, w).astype(np.float16) for w in (field.near, field.far))
    kept = np.flatnonzero(near.any((0, 2)) | far.any((0, 2)))
    windows = {f"window{i}": np.where(np.abs(w) < LEAST_WEIGHT, 0, w).astype(np.float16) for i, w in enumerate(field.windows)}
    np.savez_compressed(path, **windows, names=np.array([names[i] for i in kept]), vocabulary=np.array(sorted(field.features.vocabulary)), near=near[:, kept], far=far[:, kept], transitions=field.transitions.astype(np.float32))


def load(path: str = WEIGHTS) -> Field:
    """The stored field, without lists of known names."""
    with np.load(path) as z:
        names = {str(n): i for i, n in enumerate(z["names"])}
        return Field(Features(set(), set(), {str(w) for w in z["vocabulary"]}), names, z["near"].astype(np.float32), z["far"].astype(np.float32), [z[f"window{i}"].astype(np.float32) for i in range(len(WINDOWS))], z["transitions"])


def with_names(field: Field, names: list[tuple[str, str]]) -> Field:
    """The field with lists of known names: (token, kind)."""
    parts = lambda kind: {p.lower() for t, k in names if t and k == kind for p in _PART.findall(t)}
    return Field(Features(parts("given"), parts("family"), field.features.vocabulary), field.names, field.near, field.far, field.windows, field.transitions)


_fields: dict[str, Field] = {}


def fitted(names: list[tuple[str, str]]) -> Field:
    """The stored field for a table of known names, made once in a process."""
    key = hashlib.sha256(repr(sorted(names)).encode()).hexdigest()
    if key not in _fields:
        if "stored" not in _fields:
            _fields["stored"] = load()
        _fields[key] = with_names(_fields["stored"], names)
    return _fields[key]


class Recognizer:
    """Column functions of a trained field; its weights (some MB, whatever the data) are broadcast once."""

    def __init__(self, spark: SparkSession, known_names: DataFrame):
        rows = small_rows(known_names.select("token", "kind").where("token IS NOT NULL"), MOST_NAMES, "the table of known names")
        field = fitted(sorted((r.token, r.kind or "") for r in rows))
        key = hashlib.sha256(repr(sorted((r.token, r.kind or "") for r in rows)).encode()).hexdigest()
        weights = (field.names, field.near.astype(np.float16), field.far.astype(np.float16), [w.astype(np.float16) for w in field.windows], field.transitions)
        shared = spark.sparkContext.broadcast((field.features, *weights))

        def local() -> Field:
            if key not in _fields:
                features, names, near, far, windows, transitions = shared.value
                _fields[key] = Field(features, names, near.astype(np.float32), far.astype(np.float32), [w.astype(np.float32) for w in windows], transitions)
            return _fields[key]

        def lots(texts: pa.Array) -> Iterator[tuple[list, list]]:
            for at in range(0, len(texts), 2000):
                part = texts.slice(at, 2000).to_pylist()
                yield part, local().spans(part)

        @F.arrow_udf("array<struct<kind string, found string>>")
        def find(texts: pa.Array) -> pa.Array:
            out = []
            for part, spans in lots(texts):
                out += [[{"kind": k, "found": t[a:b]} for a, b, k in s] for t, s in zip(part, spans)]
            return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("found", pa.string())])))

        @F.arrow_udf("string")
        def replace(texts: pa.Array) -> pa.Array:
            out = []
            for part, spans in lots(texts):
                for text, s in zip(part, spans):
                    if s:
                        pieces, last = [], 0
                        for a, b, kind in s:
                            pieces += [text[last:a], PLACEHOLDERS[kind]]
                            last = b
                        text = "".join([*pieces, text[last:]])
                    out.append(text)
            return pa.array(out, pa.string())

        self._find, self._replace = find, replace

    def pieces(self, text: Column | str) -> Column:
        """Array of (kind, found) in order of place."""
        return self._find(text)

    def redacted(self, text: Column | str) -> Column:
        """The text with typed placeholders; null stays null."""
        return self._replace(text)


def found(df: DataFrame, recognizer: Recognizer, tbl: str, id_col: str, text_col: str = "text") -> DataFrame:
    """(tbl, rec_id, kind, found): each different piece of each record."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("rec_id"), F.array_distinct(recognizer.pieces(F.col(text_col))).alias("pieces"))
    rows = rows.select("rec_id", F.explode_outer("pieces").alias("p")).where("p IS NOT NULL")  # outer: no filter on the pieces is inferred, which would find them twice
    return rows.select(F.lit(tbl).alias("tbl"), "rec_id", F.col("p.kind").alias("kind"), F.col("p.found").alias("found"))


if __name__ == "__main__":
    store(train())
