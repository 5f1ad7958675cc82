"""HTML extraction: a bidirectional LSTM labels every block of a page as main text or not."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm import words as W
from tabflow.llm.blocks import Block, page_blocks

PATH, WORDS, FORM = 1024, 32, 8
PART = 4096
INPUT, HIDDEN = PATH + WORDS + FORM, 16
# Names that speak against and for main text; they label the pages the model is trained on (fixed values).
AGAINST = frozenset(
    "ad ads advert advertisement alert banner breadcrumb breadcrumbs button comment comments consent cookie cookies disqus footer header login masthead menu modal nav navbar navigation "
    "newsletter notice pagination popup promo promoted reader recommended related reply replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
AGAINST_TAGS = frozenset("nav footer aside form header menu button dialog label option".split())
FOR = frozenset("article content entry main post story".split())
# Parts that pages of the training sample are given, as tags and names: beside and inside the main text.
PARTS = (
    ("aside", ()), ("aside", ("sidebar",)), ("div", ("sidebar",)), ("div", ("widget",)), ("section", ("comments",)), ("div", ("comments",)), ("div", ("comment", "list")), ("ol", ("comment",)), ("div", ("reader", "comments")),
    ("form", ()), ("form", ("newsletter",)), ("form", ("search",)), ("div", ("cookie", "notice")), ("div", ("cookie",)), ("div", ("notice",)), ("div", ("alert",)), ("div", ("banner",)), ("div", ("ad",)),
    ("div", ("advert",)), ("div", ("ads",)), ("div", ("promo",)), ("div", ("sponsored",)), ("div", ("related",)), ("div", ("share",)), ("div", ("social",)), ("header", ()), ("div", ("header",)), ("nav", ()),
    ("div", ("menu",)), ("ul", ("menu",)), ("ul", ("nav",)), ("footer", ()), ("div", ("footer",)), ("div", ("breadcrumb",)), ("dialog", ()), ("div", ("subscribe",)), ("div", ("login",)), ("div", ("popup",)), ("section", ("related",)),
)
# Share of the dressed pages with names that say nothing, and the most of them around the page and around a block.
NOISY, NAMES = 0.5, 12
MAIN = (("article", ()), ("main", ()), ("div", ("content",)), ("div", ("article",)), ("div", ("post",)), ("div", ("entry", "content")), ("section", ("story",)), ("div", ("main",)))


def seeded(block: Block) -> int | None:
    """1 main text, 0 not, None if the tags do not say."""
    if any(t.startswith(".") and t[1:] in AGAINST for t in block.path) or any(t in AGAINST_TAGS or (t.startswith("in:") and t[3:] in AGAINST_TAGS) for t in block.path):
        return 0
    if any(t in ("article", "main", "in:article", "in:main") or (t.startswith(".") and t[1:] in FOR) for t in block.path):
        return 1
    return None


class Vectors:
    """Input vectors of blocks; vectors of paths are kept, as pages repeat them."""

    def __init__(self):
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        if path not in self.paths:
            if len(self.paths) > 20_000:
                self.paths = {}
            v = np.zeros(PATH, np.float32)
            for token in path:
                h = xxhash.xxh3_64_intdigest(token)
                # Two places of a token: few share both with another one.
                v[h % PATH] += 1 if h >> 63 else -1
                v[(h >> 12) % PATH] += 1 if h >> 62 & 1 else -1
            self.paths[path] = v
        return self.paths[path]

    def __call__(self, blocks: list[Block], places: np.ndarray) -> np.ndarray:
        """``places``: where in its page each block stands, 0 to 1."""
        n = len(blocks)
        out = np.zeros((n, INPUT), np.float32)
        if not n:
            return out
        out[:, :PATH] = np.stack([self.path(b.path) for b in blocks])
        texts = pa.array([b.text for b in blocks], pa.large_string())
        flat, starts = W.split_words(texts)
        codes, distinct = W.coded(flat)
        bucket = (W.word_hashes(distinct) % np.uint64(WORDS)).astype(np.int64)[codes]
        n_words = np.diff(starts)
        row = np.repeat(np.arange(n), n_words)
        words = np.bincount(row * WORDS + bucket, minlength=n * WORDS).reshape(n, WORDS)
        out[:, PATH : PATH + WORDS] = words / np.maximum(n_words, 1)[:, None]
        data, at = W.raw_bytes(texts)
        size = np.diff(at)
        share = lambda marks: W.per_text(marks, at) / np.maximum(size, 1)
        out[:, PATH + WORDS :] = np.stack([
            np.log1p(n_words) / 4, np.log1p(size) / 6, [b.linked / max(1, len(b.text)) for b in blocks], places, 8 * share((data == 46) | (data == 44)), 4 * share((data >= 48) & (data <= 57)),
            [float(b.text[-1] in ".!?”\"") for b in blocks], [float("©" in b.text) for b in blocks],
        ], axis=1)
        return out


@dataclass
class Labeller:
    """Weights: for each direction input, recurrent and bias; then the output from both states and the input."""

    p: dict[str, np.ndarray]

    @classmethod
    def random(cls, seed: int = 1) -> Labeller:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p[f"x{d}"] = (rng.normal(size=(INPUT, 4 * HIDDEN)) / np.sqrt(INPUT)).astype(np.float32)
            p[f"h{d}"] = (rng.normal(size=(HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            p[f"b{d}"] = bias
        p["o"] = (rng.normal(size=2 * HIDDEN + INPUT) * 0.1).astype(np.float32)
        p["c"] = np.zeros(1, np.float32)
        return cls(p)

    def project(self, x: np.ndarray) -> np.ndarray:
        """What the gates of both directions and the output get from the input: all that is needed of it to score."""
        return np.concatenate([x @ self.p["xf"] + self.p["bf"], x @ self.p["xb"] + self.p["bb"], (x @ self.p["o"][2 * HIDDEN :])[..., None]], axis=-1)

    def _run(self, from_input: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States of one direction; the input is time by page by gate, in reading order of the direction."""
        n_time, n_pages, _ = from_input.shape
        h, c = np.zeros((n_pages, HIDDEN), np.float32), np.zeros((n_pages, HIDDEN), np.float32)
        states, kept = np.zeros((n_time, n_pages, HIDDEN), np.float32), []
        for t in range(n_time):
            z = from_input[t] + h @ self.p[f"h{d}"]
            gate = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = (f * c + i * g) * m
            kept.append((h, c, i, f, o, g, new))
            c = new
            h = o * np.tanh(c) * m
            states[t] = h
        return states, kept

    def _back(self, mask: np.ndarray, d: str, kept: list, slope: np.ndarray, grads: dict) -> np.ndarray:
        """Slopes at the gates of one direction, in its reading order; adds up those of the recurrent weights."""
        dh, dc = np.zeros_like(slope[0]), np.zeros_like(slope[0])
        dz_all = np.zeros((*slope.shape[:2], 4 * HIDDEN), np.float32)
        for t in range(len(slope) - 1, -1, -1):
            h0, c0, i, f, o, g, c = kept[t]
            m = mask[t][:, None]
            dh = (dh + slope[t]) * m
            th = np.tanh(c)
            dc = (dc + dh * o * (1 - th * th)) * m
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            grads[f"h{d}"] += h0.T @ dz
            dz_all[t] = dz
            dh, dc = dz @ self.p[f"h{d}"].T, dc * f
        return dz_all

    def _scores(self, z: np.ndarray, mask: np.ndarray):
        forward, kept_f = self._run(z[..., : 4 * HIDDEN], mask, "f")
        backward, kept_b = self._run(z[::-1, :, 4 * HIDDEN : 8 * HIDDEN], mask[::-1], "b")
        states = np.concatenate([forward, backward[::-1]], axis=2)
        return states @ self.p["o"][: 2 * HIDDEN] + z[..., 8 * HIDDEN] + self.p["c"], states, kept_f, kept_b

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss over the weighted blocks, and its gradient; blocks of weight stand where the mask is 1."""
        real = mask > 0
        inputs = x[real]
        z = np.zeros((*mask.shape, 8 * HIDDEN + 1), x.dtype)
        z[real] = self.project(inputs)
        scores, states, kept_f, kept_b = self._scores(z, mask)
        prob = 1 / (1 + np.exp(-scores))
        total = max(weight.sum(), 1e-9)
        loss = -(weight * np.log(np.where(y > 0, prob, 1 - prob) + 1e-9)).sum() / total
        slope = ((prob - y) * weight / total).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["o"] = np.concatenate([slope[real] @ states[real], slope[real] @ inputs])
        grads["c"] = slope.sum().reshape(1)
        down = slope[:, :, None] * self.p["o"][: 2 * HIDDEN]
        gates = {"f": self._back(mask, "f", kept_f, down[:, :, :HIDDEN], grads), "b": self._back(mask[::-1], "b", kept_b, down[::-1, :, HIDDEN:], grads)[::-1]}
        for d, slopes in gates.items():
            grads[f"x{d}"], grads[f"b{d}"] = inputs.T @ slopes[real], slopes[real].sum(axis=0)
        return float(loss), grads

    def probabilities(self, z: np.ndarray, starts: np.ndarray, cells: int = 50_000) -> np.ndarray:
        """For the projected blocks of several pages in a row; pages of like length are read together, any length whole."""
        sizes = np.diff(starts)
        out = np.zeros(len(z), np.float32)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * sizes[order[hi]] <= cells:
                hi += 1
            pages = order[lo:hi]
            longest = int(sizes[pages[-1]])
            time = np.arange(longest)[:, None]
            mask = (time < sizes[pages]).astype(np.float32)
            at = np.minimum(starts[pages] + time, starts[pages] + sizes[pages] - 1)
            scores = self._scores(z[at], mask)[0]
            out[at[mask > 0]] = (1 / (1 + np.exp(-scores)))[mask > 0]
            lo = hi
        return out


def _made_up(rng: np.random.Generator, most: int) -> tuple[str, ...]:
    return tuple(f".made-up-{n}" for n in rng.integers(0, 1 << 30, int(rng.integers(0, most + 1))))


def _dressed(blocks: list[Block], rng: np.random.Generator, pool: list[Block]) -> tuple[list[Block], list[int | None]]:
    """A page of the sample with other names for its main text and with parts that speak against it, put between or into its blocks; most pages get names that say nothing, too."""
    labels = [seeded(b) for b in blocks]
    main = MAIN[int(rng.integers(len(MAIN)))]
    inside = (f"in:{main[0]}" if main[0] in ("article", "main", "section") else main[0], *(f".{n}" for n in main[1]))
    renamed = rng.random() < 0.6
    out, out_labels = [], []
    # Wrappers and names that say nothing, around all of the page, and more of them around single blocks.
    noisy = rng.random() < NOISY
    page_names = _made_up(rng, NAMES) if noisy else ()

    def part() -> None:
        tag, names = PARTS[int(rng.integers(len(PARTS)))]
        within = inside if rng.random() < 0.4 else ()
        leaf = ("p", "li", "div", "h3", "label", "button")[int(rng.integers(6))] if tag != "form" else ("label", "p", "button")[int(rng.integers(3))]
        path = tuple(dict.fromkeys([f"leaf:{leaf}", "html", "body", *within, tag, *(f".{n}" for n in names), *([f"in:{tag}"] if tag in ("aside", "section", "form", "nav", "header", "footer", "dialog") else []), leaf]))
        for _ in range(int(rng.integers(1, 5))):
            text = pool[int(rng.integers(len(pool)))].text
            if rng.random() < 0.6:
                text = " ".join(text.split()[: int(rng.integers(1, 12))])
            out.append(Block(text, path, len(text) if rng.random() < 0.3 else 0))
            out_labels.append(0)

    for b, y in zip(blocks, labels, strict=True):
        if rng.random() < 0.25:
            part()
        if y == 1 and renamed:
            kept = [t for t in b.path if t not in ("article", "main", "in:article", "in:main") and not (t.startswith(".") and t[1:] in FOR)]
            b = replace(b, path=tuple(dict.fromkeys([*kept, *inside])))
        out.append(b)
        out_labels.append(y)
    if rng.random() < 0.5:
        part()
    if noisy:
        out = [replace(b, path=tuple(dict.fromkeys([*b.path, "div", *page_names, *(_made_up(rng, NAMES) if rng.random() < 0.5 else ())]))) for b in out]
    # Without any tags now and then: words and the rest of the page must do.
    if rng.random() < 0.1:
        out = [replace(b, path=()) for b in out]
    return out, out_labels


def train(pages: list[str], rounds: int = 8, copies: int = 4, longest: int = 80, seed: int = 1) -> Labeller:
    """Fit on pages whose tags tell main text, each as it is and in dressed copies; blocks the tags say nothing of have no weight."""
    rng = np.random.default_rng(seed)
    vectors, model = Vectors(), Labeller.random(seed)
    parsed = [b for b in map(page_blocks, pages) if b]
    pool = [b for p in parsed for b in p]
    sequences = []
    for blocks in parsed:
        for k in range(copies + 1):
            blocks_k, labels = (blocks, [seeded(b) for b in blocks]) if k == 0 else _dressed(blocks, rng, pool)
            if any(y is not None for y in labels):
                x = vectors(blocks_k, np.arange(len(blocks_k)) / max(1, len(blocks_k) - 1))
                y = np.array([-1 if v is None else v for v in labels], np.float32)
                sequences += [(x[i : i + longest], y[i : i + longest]) for i in range(0, len(y), longest)]
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    n = 0
    for _ in range(rounds):
        for batch in np.array_split(rng.permutation(len(sequences)), -(-len(sequences) // 64)) if sequences else []:
            some = [sequences[i] for i in batch]
            time = max(len(y) for _, y in some)
            x, y, mask = np.zeros((time, len(some), INPUT), np.float32), np.zeros((time, len(some)), np.float32), np.zeros((time, len(some)), np.float32)
            for k, (a, b) in enumerate(some):
                x[: len(b), k], y[: len(b), k], mask[: len(b), k] = a, b, 1
            _, grads = model.step(x, mask, np.maximum(y, 0), mask * (y >= 0))
            n += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.p[k] -= (0.01 * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
    return model


def fit_pages(pages: DataFrame, key: str = "page_id", html: str = "html", sample: int = 300, most_bytes: int = 40_000) -> Labeller:
    """Train on the ``sample`` pages of up to ``most_bytes`` bytes that a hash of key and page puts first; equal pages count once."""
    rows = pages.select(F.col(html).alias("html"), F.xxhash64(F.col(key).cast("string"), html).alias("draw")).filter(F.octet_length("html").between(1, most_bytes))
    total = rows.count()
    # About three times the sample is sorted, however many pages there are.
    rows = rows.filter(F.pmod(F.xxhash64("draw"), F.lit(1 << 30)) < min(1.0, 3 * sample / max(total, 1) + 1e-6) * (1 << 30))
    drawn = rows.groupBy("draw").agg(F.first("html").alias("html")).orderBy("draw").limit(sample).collect()
    return train([r.html for r in sorted(drawn, key=lambda r: r.draw)])


def main_text(pages: list[str], model: Labeller, vectors: Vectors) -> list[str]:
    """Main text of each page: blocks of probability over one half, in page order, joined by a space."""
    parsed = [page_blocks(p) for p in pages]
    starts = np.concatenate([[0], np.cumsum([len(b) for b in parsed])]).astype(np.int64)
    places = np.concatenate([np.arange(len(b)) / max(1, len(b) - 1) for b in parsed] or [np.zeros(0)])
    blocks = [b for p in parsed for b in p]
    # Input vectors are wide: a part of the blocks at a time, of any page.
    parts = [model.project(vectors(blocks[i : i + PART], places[i : i + PART])) for i in range(0, max(1, len(blocks)), PART)]
    prob = model.probabilities(np.concatenate(parts), starts)
    return [" ".join(b.text for b, p in zip(blocks, prob[lo:], strict=False) if p > 0.5) for blocks, lo in zip(parsed, starts, strict=False)]


def extracted(pages: DataFrame, model: Labeller, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Key, ``keep``, text and n_chars (code points) of the main text of every page, from the whole page.

    A page is a sequence of blocks; each has hashed tags and all names of all elements around it, hashed words and its form, and the network
    reads the sequence from both ends. Scripts, styles, comments and unfinished tags are no text. Null is an empty page: empty text, as for a page
    without main text. Repeated rows stay; other columns are ignored. The model has a fixed size and is sent to all tasks; nothing is shuffled.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)
    carried = ["key", *(f"keep{i}" for i in range(len(keep)))]
    rows = pages.select(F.col(key).alias("key"), *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)], F.col(html).alias("html"))
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried), "text string, n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for whole in batches:
            for batch in W.steps(whole, "html"):
                texts = main_text(W.filled(batch.column("html")).to_pylist(), sent.value, vectors)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*carried, "text", "n_chars"])

    out = rows.mapInArrow(run, schema)
    return out.select(F.col("key").alias(key), *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")
