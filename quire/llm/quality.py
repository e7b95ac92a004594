"""Quality rules: gradient-boosted trees over document statistics, as flat numpy arrays, with monotonic constraints."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACE_BYTES, dropped, mix, span_hashes, stored, text_buffer, tidy, word_spans

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[list(b".,;:!?\"'()[]{}-_/\\=+~^`@")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_punctuation", "n_exclaims", "n_stops", "n_letters", "n_points")

#: Ratios that the trees see, each with its constraint: -1 where more of it may not raise the quality.
FEATURES = {
    "words": (lambda c: np.log1p(c["n_words"]), 0),
    "word_length": (lambda c: c["word_chars"] / np.maximum(c["n_words"], 1), 0),
    "symbols": (lambda c: c["n_symbols"] / np.maximum(c["n_words"], 1), -1),
    "dup_lines": (lambda c: c["n_dup_lines"] / np.maximum(c["n_lines"], 1), -1),
    "repeat_words": (lambda c: c["n_repeat_words"] / np.maximum(c["n_words"], 1), -1),
    "words_per_line": (lambda c: np.minimum(c["n_words"] / np.maximum(c["n_lines"], 1), 200), 0),
    "distinct": (lambda c: c["n_distinct"] / np.maximum(np.sqrt(c["n_words"]), 1), 0),
    "upper": (lambda c: c["n_upper"] / np.maximum(c["n_letters"], 1), -1),
    "digits": (lambda c: c["n_digits"] / np.maximum(c["n_points"], 1), -1),
    "punctuation": (lambda c: c["n_punctuation"] / np.maximum(c["n_words"], 1), 0),
    "exclaims": (lambda c: c["n_exclaims"] / np.maximum(c["n_words"], 1), -1),
    "stops": (lambda c: c["n_stops"] / np.maximum(c["n_lines"], 1), 0),
}


def statistics(data: np.ndarray) -> tuple[int, ...]:
    """COUNTS of one text's UTF-8 bytes. A word is a run without ASCII white space."""
    starts, ends = word_spans(data)
    n = len(starts)
    if not n:
        return (0, 0, int(_SYMBOLS[data].sum()), *[0] * 11)
    points = (data & 0xC0) != 0x80
    hashes = span_hashes(data, starts, ends)
    repeats = 0
    if n > 3:
        a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        windows = mix(hashes[:-2] * a + mix(hashes[1:-1] * b + hashes[2:]))
        order = np.sort(windows)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            found = np.isin(windows, twice)
            covered = np.zeros(n, dtype=bool)
            for i in range(3):
                covered[i : n - 2 + i] |= found
            repeats = int(covered.sum())
    lines = [x for x in data.tobytes().split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    high = data >= 128
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    letters = int(upper.sum() + lower.sum() + (high & points).sum())
    stops = sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines)
    return (
        n, int((points & ~SPACE_BYTES[data]).sum()), int(_SYMBOLS[data].sum()), len(lines) - len(set(lines)), repeats, len(lines), len(np.unique(hashes)),
        int(upper.sum()), int(((data >= 48) & (data <= 57)).sum()), int(_PUNCTUATION[data].sum()), int((data == 33).sum()), stops, letters, int(points.sum()),
    )


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row of docs(doc_id, text); null has no words."""

    def run(batches):
        for b in batches:
            data, offsets = text_buffer(b.column(1))
            rows = np.array([statistics(data[s:e]) for s, e in zip(offsets[:-1], offsets[1:])], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(rows[:, i]) for i in range(len(COUNTS))]], names=["doc_id", *COUNTS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """One row of FEATURES for each document."""
    return np.stack([f(counts) for f, _ in FEATURES.values()], axis=1).astype(np.float64)


@dataclass
class Trees:
    """Boosted trees in flat arrays; node i goes left where x[feature[i]] <= threshold[i]; a leaf goes to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of the positive class, for all rows and trees at once."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 5) -> Trees:
    """Newton boosting of the logistic loss over quantile bins.

    A split on a constrained feature must order its children by the sign, and their subtrees stay on their side of the
    mid-value, so the whole model is monotone in that feature. With one class only there are no trees.
    """
    nodes: list[list] = []  # feature, threshold, left, right, value
    share = min(max(float(y.mean()) if len(y) else 1.0, 1e-3), 1 - 1e-3)
    base, roots = float(np.log(share / (1 - share))), []
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(signs))]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, len(signs)), int)
    total = np.full(len(x), base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        here = len(nodes)
        weight = lambda a, b: np.clip(-a / (b + ridge), low, high)
        nodes.append([0, 0.0, here, here, float(weight(g[rows].sum(), h[rows].sum())) * rate])
        if level == depth or len(rows) < 2 * least:
            return here
        gain_of = lambda a, b, w: -(a * w + 0.5 * (b + ridge) * w * w)
        all_g, all_h = g[rows].sum(), h[rows].sum()
        whole, best = gain_of(all_g, all_h, weight(all_g, all_h)), (1e-6, None)
        for j, sign in enumerate(signs):
            m = len(edges[j])
            if not m:
                continue
            at = binned[rows, j]
            lg, lh, ln = (np.cumsum(np.bincount(at, w, m + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            wl, wr = weight(lg, lh), weight(all_g - lg, all_h - lh)
            gain = gain_of(lg, lh, wl) + gain_of(all_g - lg, all_h - lh, wr) - whole
            gain[(ln < least) | (len(rows) - ln < least) | (sign * (wl - wr) > 0)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (j, k, wl[k], wr[k], sign))
        if best[1]:
            j, k, wl, wr, sign = best[1]
            mid, goes = (wl + wr) / 2, binned[rows, j] <= k
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[sign]
            nodes[here][:2] = [j, float(edges[j][k])]
            nodes[here][2] = grow(rows[goes], g, h, level + 1, *bounds[0])
            nodes[here][3] = grow(rows[~goes], g, h, level + 1, *bounds[1])
        return here

    for _ in range(trees if len(set(y.tolist())) == 2 else 0):
        p = 1 / (1 + np.exp(-total))
        roots.append(grow(np.arange(len(x)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        at = np.full(len(x), roots[-1])
        table = [np.array(c) for c in zip(*nodes, strict=True)]
        for _ in range(depth):
            at = np.where(x[np.arange(len(x)), table[0][at].astype(int)] <= table[1][at], table[2][at], table[3][at]).astype(int)
        total += table[4][at]
    table = [np.array(c) for c in zip(*nodes, strict=True)] or [np.zeros(0)] * 5
    return Trees(table[0].astype(int), table[1].astype(float), table[2].astype(int), table[3].astype(int), table[4].astype(float), np.array(roots, int), depth, base)


def train(counts: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> Trees:
    """Trees that tell quality 1 from 0, fitted on at most `most_rows` labelled documents (those least by a hash of the
    id): the only sample in this module, and all that reaches the driver."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    table = counts.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", *COUNTS).limit(2 * most_rows).toArrow()
    found = {c: table[c].to_numpy().astype(np.float64) for c in COUNTS}
    return fit_trees(features(found), table["quality"].to_numpy().astype(np.float64), [s for _, s in FEATURES.values()])


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most_rows: int = 20_000) -> DataFrame:
    """doc_id, COUNTS, base_failed, score and kept of every row of docs(doc_id, text).

    base_failed: fewer than 50 words, or over half of the words in 3-word windows that occur twice or more. kept: not
    base_failed, and the trees' probability of quality is at least `threshold`. Statistics cover whole texts and all
    rows; they are computed once and written to the shared folder, and trees are scored over them in numpy.

    Null and empty texts have no words and fail. Repeated rows each get their result. Without labels of both classes the
    score is 1 - 1e-3 or the like and the rules alone decide. An empty table gives an empty one. Other columns are
    ignored.
    """
    counts = stored(document_statistics(docs), "statistics")
    model = train(counts, labels, most_rows)

    def run(batches):
        for b in batches:
            c = {name: b.column(name).to_numpy() for name in COUNTS}
            failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
            score = model.score(features({k: v.astype(np.float64) for k, v in c.items()}))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], names=[*b.schema.names, "base_failed", "score", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return counts.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most_rows: int = 20_000) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that quality() keeps, with all their columns.

    Statistics of the labelled sample train the trees; then each row is decided where it is read, so no text is shuffled.
    """
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    sample = stored(document_statistics(docs.join(F.broadcast(chosen), "doc_id", "left_semi")), "statistics")
    model = train(sample, labels, most_rows)
    dropped(sample)

    def run(batches):
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            rows = np.array([statistics(data[s:e]) for s, e in zip(offsets[:-1], offsets[1:])], dtype=np.int64).reshape(-1, len(COUNTS))
            c = {name: rows[:, i].astype(np.float64) for i, name in enumerate(COUNTS)}
            failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
            yield b.filter(pa.array(~failed & (model.score(features(c)) >= threshold)))

    return docs.mapInArrow(tidy(run), docs.schema)
