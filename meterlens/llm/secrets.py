"""Secrets in texts: fixed patterns, and a character convolutional network that judges further candidates."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.llm.common import cut, id_field, text_slices, texts_of

# The kinds, in the order that ties take, and their patterns.
KINDS = ("assign", "access", "hex", "cnn")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_DIGITS = re.compile(r"[0-9]+")
_LEFT = re.compile(r"[A-Za-z0-9+/_.=-]*$")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]*")
_LONG_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
# Runs that are clearly no secret: words, names of words, numbers, versions and dates, joined by punctuation.
_PIECE = r"(?:(?:[A-Z]?[a-z]{1,30}(?:[A-Z][a-z]{1,30}){0,4}|[A-Z]{1,30})[0-9]{0,4}|[0-9]{1,10}|[vV][0-9]{1,6})"
_PLAIN = re.compile(rf"[+/_.=-]*(?:{_PIECE}[+/_.=-]+)*{_PIECE}?")
_UNSPOKEN = re.compile(r"[bcdfghjklmnpqrstvwxz]{7,}", re.IGNORECASE)
_MAIL = re.compile(r"[A-Za-z0-9+_.=-]{1,64}@[A-Za-z0-9.-]{1,255}")
_BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

Span = tuple[int, int, int]  # start, place of the kind, end


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that are long enough, by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, least: int = 12) -> list[tuple[int, int]]:
    """Runs of `[A-Za-z0-9+/_.=-]` with a digit and a letter, `least` characters or more."""
    out, done = [], 0
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        # step back over the run in growing strides: runs are short, texts may not be
        low, stride = m.start(), 64
        while low > done:
            left = max(done, low - stride)
            run = _LEFT.search(text[left:low])
            low -= run.end() - run.start()
            if low > left:
                break
            stride *= 2
        done = _RUN.match(text, m.start()).end()
        run = text[low:done]
        if done - low >= least and re.search("[A-Za-z]", run):
            out.append((low, done))
    return out


def is_plain(run: str) -> bool:
    """Whether a run is made of words and numbers alone; seven consonants in a row are no word."""
    return _PLAIN.fullmatch(run) is not None and _UNSPOKEN.search(run) is None


def open_candidates(text: str) -> list[tuple[int, int]]:
    """`candidates`, and all other runs of eight characters or more that are not plain: without a digit, without a letter
    or short ones too."""
    more = [m.span() for m in _LONG_RUN.finditer(text) if not is_plain(m[0])]
    return sorted(set(candidates(text)).union(more))


def plain_findings(text: str, words: int = 4) -> list[tuple[int, int]]:
    """What can safely be called no secret: plain candidates, numbers, mail addresses and the first long words."""
    out = [(a, b) for a, b in candidates(text) if is_plain(text[a:b])]
    out += [m.span() for _, m in zip(range(words), re.finditer(r"[^\W\d_]{12,}", text)) if not _UNSPOKEN.search(m[0])]
    out += [m.span() for m in re.finditer(r"(?<![A-Za-z0-9+/_.=-])[0-9][0-9.=/-]{6,}[0-9](?![A-Za-z0-9+/_.=-])", text) if is_plain(m[0])]
    for m in _MAIL.finditer(text):
        at = text.index("@", m.start())
        out += [(m.start(), at), (at + 1, m.end())]
    return sorted(set(out))


def drawn_value(seed: str) -> str:
    """A value of 8 to 47 characters, its alphabet (with or without digits, lower case or punctuation) drawn as well."""
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(seed.encode("utf-8", "replace")).digest()[:8], "little"))
    alphabet = (_BASE62, _BASE62[:52], _BASE62[:26] + _BASE62[52:], _BASE62[26:], _BASE62 + "+/_-")[rng.integers(5)]
    return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(8, 48)))


class CharNet:
    """Embedding, one convolution, maximum over places, a hidden layer and a logit; plain numpy, fitted with Adam.

    A candidate is seen whole: in tiles of `tile` characters, each with `before` characters in front of it and `after`
    behind it put before it. Its logit is that of its highest tile.
    """

    TILE, BEFORE, AFTER, ALPHABET = 48, 20, 8, 200
    WIDTH, DIMS, FILTERS, HIDDEN = 5, 8, 32, 16

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = lambda *shape: (rng.standard_normal(shape) * np.sqrt(2 / shape[0])).astype(np.float32)
        self.p = {
            "embed": (rng.standard_normal((self.ALPHABET, self.DIMS)) * 0.3).astype(np.float32),
            "conv": scale(self.WIDTH * self.DIMS, self.FILTERS),
            "conv_b": np.zeros(self.FILTERS, np.float32),
            "hide": scale(self.FILTERS, self.HIDDEN),
            "hide_b": np.zeros(self.HIDDEN, np.float32),
            "out": scale(self.HIDDEN, 1),
            "out_b": np.zeros(1, np.float32),
        }
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    @classmethod
    def tiles(cls, text: str, start: int, end: int) -> list[str]:
        out = []
        for at in range(start, end, cls.TILE):
            high = min(end, at + cls.TILE)
            before, after = text[max(0, at - cls.BEFORE) : at], text[high : high + cls.AFTER]
            out.append(before.rjust(cls.BEFORE) + after.ljust(cls.AFTER) + text[at:high])
        return out

    @classmethod
    def codes(cls, tiles: list[str]) -> np.ndarray:
        """0: padding, 1..95: printable ASCII, 96: other letters, 97: other characters; 100 more in the surroundings."""
        width = cls.BEFORE + cls.TILE + cls.AFTER
        out = np.zeros((len(tiles), width), np.int64)
        for row, tile in zip(out, tiles):
            raw = np.array([ord(c) for c in tile[:width]], np.int64)
            row[: len(raw)] = np.where((raw >= 32) & (raw < 127), raw - 31, np.where(raw >= 192, 96, 97))
        out[:, : cls.BEFORE + cls.AFTER] += 100
        return out

    def _forward(self, x: np.ndarray):
        p, e = self.p, self.p["embed"][x]
        n = e.shape[1] - self.WIDTH + 1
        windows = np.concatenate([e[:, k : k + n] for k in range(self.WIDTH)], axis=2)
        conv = np.maximum(windows @ p["conv"] + p["conv_b"], 0)
        best = conv.argmax(1)
        top = np.take_along_axis(conv, best[:, None], 1)[:, 0]
        hide = np.maximum(top @ p["hide"] + p["hide_b"], 0)
        return windows, best, top, hide, (hide @ p["out"] + p["out_b"])[:, 0]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 24, batch: int = 64, rate: float = 3e-3, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for low in range(0, len(x), batch):
                rows = order[low : low + batch]
                windows, best, top, hide, logit = self._forward(x[rows])
                g = {k: np.zeros_like(w) for k, w in self.p.items()}
                d = ((1 / (1 + np.exp(-logit)) - y[rows]) / len(rows)).astype(np.float32)[:, None]
                g["out"], g["out_b"] = hide.T @ d, d.sum(0)
                dh = (d @ self.p["out"].T) * (hide > 0)
                g["hide"], g["hide_b"] = top.T @ dh, dh.sum(0)
                dt = (dh @ self.p["hide"].T) * (top > 0)
                g["conv_b"] = dt.sum(0)
                row = np.arange(len(rows))[:, None]
                picked = windows[row, best]  # rows x filters x (width * dims)
                g["conv"] = np.einsum("rf,rfd->df", dt, picked)
                de = (dt[:, :, None] * self.p["conv"].T[None]).reshape(len(rows), self.FILTERS, self.WIDTH, self.DIMS)
                where = x[rows][row[:, :, None], best[:, :, None] + np.arange(self.WIDTH)]
                np.add.at(g["embed"], where, de)
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def logits(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        parts = [self._forward(x[low : low + batch])[-1] for low in range(0, len(x), batch)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling on held-out findings, then the highest threshold that keeps `recall` of the true ones."""
        z = self.logits(x).astype(np.float64)
        a, b = 1.0, 0.0

        def loss(a: float, b: float) -> float:
            return float((np.logaddexp(0, a * z + b) - y * (a * z + b)).sum() + 5e-4 * (a - 1) ** 2)

        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            hessian = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hessian, [((p - y) * z).sum() + 1e-3 * (a - 1), (p - y).sum()])
            while loss(a - step[0], b - step[1]) > loss(a, b) and np.abs(step).max() >= 1e-6:
                step = step / 2
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-6:
                break
        self.slope, self.shift = a, b
        true = np.sort(self.probability(z[y > 0]))
        self.threshold = float(true[int((1 - recall) * len(true))]) if len(true) else 0.5

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits.astype(np.float64) + self.shift, -30, 30)))

    def accept(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """Which of the candidates (text, start, end) are secrets."""
        tiles = [self.tiles(*f) for f in found]
        counts = [len(t) for t in tiles]
        if not counts:
            return np.zeros(0, bool)
        logits = self.logits(self.codes([t for mine in tiles for t in mine]))
        best = np.maximum.reduceat(logits, np.cumsum([0, *counts[:-1]]))
        return self.probability(best) >= self.threshold


def train(findings: list[tuple[str, int]], *, recall: float = 0.95, holdout: int = 4, seed: int = 7) -> CharNet | None:
    """Net fitted on labelled findings (tile of a candidate and its context, 1 for a secret).

    Every `holdout`-th finding calibrates. None if either label has fewer than two findings on either side.
    """
    findings = sorted(set(findings), key=lambda f: hashlib.sha256(f[0].encode("utf-8", "replace")).digest())
    x, y = CharNet.codes([t for t, _ in findings]), np.array([label for _, label in findings], np.float32)
    held = np.arange(len(findings)) % holdout == 0
    if min(np.bincount(y[side].astype(int), minlength=2).min() if side.any() else 0 for side in (held, ~held)) < 2:
        return None
    net = CharNet(seed)
    net.fit(x[~held], y[~held], seed=seed)
    net.calibrate(x[held], y[held], recall)
    return net


def labelled_findings(docs: DataFrame, text_col: str, about_docs: int, most_findings: int) -> list[tuple[str, int]]:
    """Findings of a bounded sample: the values that the fixed patterns match are secrets, and so is a random value put
    in the place of each plain run, so that neither the patterns' alphabets nor the surroundings decide; plain runs and drawn
    values also come without their surroundings. Clearly
    plain runs (`plain_findings`) are none. All other candidates carry no label and are left out: a secret that no pattern knows never counts against
    itself. The key in front of a value is blanked in every second finding, so that the net has to read the value itself.
    The sample is about `about_docs` documents, chosen by the hash of their text, and of their findings the first
    `most_findings` of either label by hash.
    """
    text = docs.select(F.col(text_col).alias("text"))
    share = min(1.0, about_docs / max(1, text.count()))
    sample = text.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            rows: list[tuple[str, int]] = []
            for text in texts_of(batch, "text"):
                base = base_spans(text)
                for nth, (a, kind, b) in enumerate(base):
                    value = _ASSIGN.match(text, a).start(2) if kind == 0 else a
                    hidden = text[:a] + " " * (value - a) + text[value:] if nth + len(text) & 1 else text
                    rows += [(tile, 1) for tile in CharNet.tiles(hidden, value, b)]
                plain = plain_findings(text)
                for a, b in plain:
                    near = text[max(0, a - CharNet.BEFORE) : a]
                    value = drawn_value(f"{a}:{near}{text[a:b]}")
                    if not is_plain(value):
                        around = near + value + text[b : b + CharNet.AFTER]
                        rows += [(tile, 1) for tile in CharNet.tiles(around, len(near), len(near) + len(value))]
                        rows += [(tile, 1) for tile in CharNet.tiles(value, 0, len(value))]
                for a, b in plain:
                    if not any(x < b and a < y for x, _, y in base):
                        rows += [(tile, 0) for tile in CharNet.tiles(text, a, b) + CharNet.tiles(text[a:b], 0, b - a)]
            tiles, labels = [r[0] for r in rows], [r[1] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(tiles, pa.string()), pa.array(labels, pa.int32())], ["tile", "label"])

    found = cut(sample.mapInArrow(find, "tile string, label int"))
    out = []
    for label in (0, 1):
        one = found.where(F.col("label") == label).distinct().orderBy(F.xxhash64("tile"), "tile").limit(most_findings)
        out += [(r.tile, r.label) for r in one.collect()]
    return out


def all_spans(texts: list[str], net: CharNet | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and all spans with those that the net adds where no base span lies, of each text."""
    bases = [base_spans(t) for t in texts]
    open_ = []
    for i, (t, base) in enumerate(zip(texts, bases)):
        open_ += [(i, c) for c in open_candidates(t) if not any(a < c[1] and c[0] < b for a, _, b in base)]
    added: list[list[Span]] = [[] for _ in texts]
    if net is not None and open_:
        for (i, (a, b)), ok in zip(open_, net.accept([(texts[i], *c) for i, c in open_])):
            if ok:
                added[i].append((a, 3, b))
    return [(base, sorted(base + more)) for base, more in zip(bases, added)]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def fitted(
    docs: DataFrame, text_col: str = "text", *, about_docs: int = 20_000, most_findings: int = 3_000
) -> CharNet | None:
    """The net for these documents; None (then only base spans are found) where they hold too few findings."""
    return train(labelled_findings(docs, text_col, about_docs, most_findings))


def scan(docs: DataFrame, net: CharNet | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: counts of base spans by kind, base_sha256, spans (base and the net's own, `cnn`).

    Places are code points of the whole text, ends exclusive. Null texts count as empty: no spans, the digest of the
    empty string. Null and repeated ids keep their rows; other columns are not read; nothing is shuffled.
    """
    numbers = [T.StructField(n, T.LongType(), False) for n in ("n_assign", "n_access", "n_hex")]
    strings = [T.StructField(n, T.StringType(), False) for n in ("base_sha256", "spans")]
    out = T.StructType([id_field(docs, id_col, "doc_id"), *numbers, *strings])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_col):
            found = all_spans(texts_of(batch, text_col), net)
            counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64()) for kind in range(3)]
            digest = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
            columns = [batch.column(id_col), *counts, pa.array(digest), pa.array([_joined(every) for _, every in found])]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in out])

    return docs.select(id_col, text_col).mapInArrow(find, out)


def redact(docs: DataFrame, net: CharNet | None, *, text_col: str = "text", mask: str = "[SECRET]", size_col: str | None = None) -> DataFrame:
    """All rows and columns, with every span of the text replaced by `mask`; overlapping spans become one.

    Null texts stay null. `size_col` (if given) is set to the characters of the new text where the text has changed.
    """
    schema = docs.schema

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            sizes = batch.column(size_col).to_pylist() if size_col else []
            for i, (_, spans) in enumerate(all_spans([t or "" for t in texts], net)):
                if spans:
                    parts, at = [], 0
                    for a, _, b in spans:
                        if a >= at:
                            parts += [texts[i][at:a], mask]
                        at = max(at, b)
                    texts[i] = "".join([*parts, texts[i][at:]])
                    if size_col:
                        sizes[i] = len(texts[i])
            columns = list(batch.columns)
            columns[batch.schema.get_field_index(text_col)] = pa.array(texts, batch.column(text_col).type)
            if size_col:
                columns[batch.schema.get_field_index(size_col)] = pa.array(sizes, batch.column(size_col).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(apply, schema)
