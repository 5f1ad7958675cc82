"""Language ID: a linear-chain conditional random field over words, read by forward-backward."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.llm import words as W
from tabflow.session import cut_lineage, free_name

# Buckets of hashed features; bytes of n-grams, and of prefixes and suffixes.
BUCKETS = 1 << 16
GRAMS, AFFIXES = (2, 3, 4), (1, 2, 3, 4)
# Most weights of hashed features; with many labels there are fewer buckets.
MOST_WEIGHTS = 1 << 20
# Words of the lexicon of each language, and of all together.
LEXICON, MOST_WORDS = 1000, 50_000
# Bytes of text to learn from, and tasks' blocks of them.
SAMPLE_BYTES, BLOCKS = 4 << 20, 8
# Bits that mark the n-grams seen in training, and their bytes.
SEEN, SEEN_GRAM = 1 << 20, 4
# Longer texts are labelled in stretches of so many words, with so many words around them as context.
STRETCH, CONTEXT = 2000, 50
# Distinct words of a step whose n-grams are held at once when texts are labelled.
LABEL_WORDS = 4096
UND = "und"


def features(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams, prefixes and suffixes of each word, lower-cased and between marks; and how many each word has."""
    kind = pa.large_string()
    lower = pc.utf8_lower(distinct.cast(kind))
    marked = pc.binary_join_element_wise(pa.scalar("\x01", kind), lower, pa.scalar("\x02", kind), pa.scalar("", kind))
    data, at = W.raw_bytes(marked.combine_chunks() if isinstance(marked, pa.ChunkedArray) else marked)
    size = np.diff(at)
    word = np.repeat(np.arange(len(size)), size)
    left = np.repeat(at[1:], size) - np.arange(len(data))
    codes = data.astype(np.uint64) + np.uint64(1)
    owners, found = [], []

    def add(rows: np.ndarray, values: np.ndarray, kind: int) -> None:
        owners.append(rows)
        found.append((W.spread64(values + np.uint64(kind << 56)) % np.uint64(BUCKETS)).astype(np.int64))

    for n in sorted({*GRAMS, *AFFIXES}):
        if len(codes) < n:
            break
        run = np.zeros(len(codes) - n + 1, np.uint64)
        for k in range(n):
            run = run * np.uint64(257) + codes[k : len(codes) - n + 1 + k]
        inside = left[: len(run)] >= n
        if n in GRAMS:
            add(word[: len(run)][inside], run[inside], n)
        if n in AFFIXES:
            whole = np.nonzero(size >= n + 2)[0]
            add(whole, run[at[whole] + 1], 16 + n)
            add(whole, run[at[whole + 1] - 1 - n], 32 + n)
    owners, found = np.concatenate([*owners, np.zeros(0, np.int64)]), np.concatenate([*found, np.zeros(0, np.int64)])
    order = np.argsort(owners, kind="stable")
    return found[order], np.bincount(owners, minlength=len(size))


def lettered(distinct: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(distinct, r"\p{L}").to_numpy(zero_copy_only=False)


def seen_grams(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places in the table of seen n-grams for each word, lower-cased and between marks, and how many each word has."""
    kind = pa.large_string()
    marked = pc.binary_join_element_wise(pa.scalar("\x01", kind), pc.utf8_lower(distinct.cast(kind)), pa.scalar("\x02", kind), pa.scalar("", kind))
    data, at = W.raw_bytes(marked.combine_chunks() if isinstance(marked, pa.ChunkedArray) else marked)
    size = np.diff(at)
    if len(data) < SEEN_GRAM:
        return np.zeros(0, np.int64), np.zeros(len(size), np.int64)
    n = len(data) - SEEN_GRAM + 1
    run = np.zeros(n, np.uint64)
    for k in range(SEEN_GRAM):
        run = run * np.uint64(257) + data[k : n + k].astype(np.uint64)
    inside = (np.repeat(at[1:], size) - np.arange(len(data)))[:n] >= SEEN_GRAM
    return (W.spread64(run[inside]) % np.uint64(SEEN)).astype(np.int64), np.maximum(size - SEEN_GRAM + 1, 0)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of rows of ``values`` for each count in turn."""
    out = np.zeros((len(counts), values.shape[1]), values.dtype)
    some = np.nonzero(counts)[0]
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some], axis=0)
    return out


def marginals(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Posterior of each label at each word, by forward-backward; sequences are ranges of the rows of ``scores``.

    All sequences take a step together; sorted by length, those that go on are a prefix.
    """
    seen = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) if len(scores) else scores
    step = np.exp(moves - moves.max())
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    ahead = np.zeros(seen.shape)
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), "left")
    for t in range(longest):
        at = starts[: live[t]] + t
        a = seen[at] if t == 0 else (ahead[at - 1] @ step) * seen[at]
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    back = np.ones((len(sizes), seen.shape[1] if seen.ndim > 1 else 0))
    for t in range(longest - 1, -1, -1):
        at = starts[: live[t]] + t
        now = back[: live[t]]
        post = ahead[at] * now
        ahead[at] = post / post.sum(axis=1, keepdims=True)
        if t:
            b = (seen[at] * now) @ step.T
            back[: live[t]] = b / b.sum(axis=1, keepdims=True)
    return ahead


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    lexicon: pa.Array
    # The label that each word of the lexicon belongs to.
    lexicon_label: np.ndarray
    lexicon_weights: np.ndarray
    moves: np.ndarray
    seen: np.ndarray

    def scores(self, distinct: pa.Array, hashed: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Label scores of each word, whose ``features`` may be known; words without a letter are neutral."""
        found, counts = features(distinct) if hashed is None else hashed
        out = _sums(self.weights[found % len(self.weights)], counts)
        place = pc.fill_null(pc.index_in(pc.utf8_lower(distinct.cast(pa.large_string())), self.lexicon), -1).to_numpy(zero_copy_only=False)
        out[place >= 0] += self.lexicon_weights[self.lexicon_label[place[place >= 0]]]
        out[~lettered(distinct)] = 0
        return out

    def familiar(self, distinct: pa.Array) -> np.ndarray:
        """Share of the n-grams of each word that the texts learnt from hold, in whatever language; 1 for words too short to have one."""
        found, counts = seen_grams(distinct)
        hits = _sums(self.seen[found].astype(np.float64)[:, None], counts)[:, 0]
        return np.where(counts > 0, hits / np.maximum(counts, 1), 1.0)

    def label(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Posteriors of all words, where each text begins, which words have a letter, and how familiar each word is."""
        flat, starts = W.split_words(texts)
        codes, distinct = W.coded(flat)
        if not len(codes):
            return np.zeros((0, len(self.labels))), starts, np.zeros(0, bool), np.zeros(0)
        # The n-grams of a word take some hundred bytes, so they are made for some words at a time.
        parts = [distinct.slice(k, LABEL_WORDS) for k in range(0, len(distinct), LABEL_WORDS)]
        scores, letters, known = (np.concatenate([f(p) for p in parts])[codes] for f in (self.scores, lettered, self.familiar))
        first, last, keep_from, keep_to = [], [], [], []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            for k in range(lo, hi, STRETCH):
                first.append(max(lo, k - CONTEXT))
                last.append(min(hi, k + STRETCH + CONTEXT))
                keep_from.append(k)
                keep_to.append(min(hi, k + STRETCH))
        first, last, keep_from, keep_to = map(np.array, (first, last, keep_from, keep_to))
        sizes = last - first
        # Stretches with context overlap, so each has rows of its own.
        own = np.cumsum(sizes) - sizes
        rows = np.arange(sizes.sum()) - np.repeat(own - first, sizes)
        post = marginals(scores[rows], own, sizes, self.moves)
        kept = (rows >= np.repeat(keep_from, sizes)) & (rows < np.repeat(keep_to, sizes))
        return post[kept], starts, letters, known


def _spliced(texts: pa.Array, of_text: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of pieces of the texts in a new order, as numbers into the distinct words, and the label of each.

    A piece has 3 to 20 words of one text; the next piece is of another language with probability 0.3, so that transitions learn what
    switching looks like.
    """
    rng = np.random.default_rng(seed)
    flat, starts = W.split_words(texts)
    codes, distinct = W.coded(flat)
    label = of_text[np.repeat(np.arange(len(of_text)), np.diff(starts))]
    pools: dict[int, list[np.ndarray]] = {}
    for lo, hi, y in zip(starts[:-1].tolist(), starts[1:].tolist(), of_text.tolist(), strict=True):
        while lo < hi:
            n = int(rng.integers(3, 21))
            pools.setdefault(y, []).append(np.arange(lo, min(hi, lo + n)))
            lo += n
    for p in pools.values():
        rng.shuffle(p)
    rows, rest = [], sorted(pools)
    y = -1
    while rest:
        if y not in pools or not pools[y] or rng.random() < 0.3:
            y = rest[int(rng.integers(len(rest)))]
        rows.append(pools[y].pop())
        if not pools[y]:
            rest.remove(y)
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return codes[row], label[row], distinct


def slopes(model: Model, codes: np.ndarray, label: np.ndarray, distinct: pa.Array, hashed: tuple[np.ndarray, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of the log likelihood of labels by weights, lexicon weights and moves, over sequences of ``length`` words."""
    n_labels = len(model.labels)
    starts = np.arange(0, len(codes), length)
    sizes = np.diff(np.concatenate([starts, [len(codes)]]))
    post = marginals(model.scores(distinct, hashed)[codes], starts, sizes, model.moves)
    gap = -post
    gap[np.arange(len(label)), label] += 1
    word_gap = np.stack([np.bincount(codes, gap[:, i], minlength=len(distinct)) for i in range(n_labels)], axis=1)
    word_gap[~lettered(distinct)] = 0
    found, counts = hashed
    owner = np.repeat(np.arange(len(distinct)), counts)
    weights = np.stack([np.bincount(found % len(model.weights), word_gap[owner, i], minlength=len(model.weights)) for i in range(n_labels)], axis=1)
    place = pc.fill_null(pc.index_in(pc.utf8_lower(distinct.cast(pa.large_string())), model.lexicon), -1).to_numpy(zero_copy_only=False)
    inside = np.nonzero(place >= 0)[0]
    lexicon = np.zeros((n_labels, n_labels))
    np.add.at(lexicon, model.lexicon_label[place[inside]], word_gap[inside])
    # Expected transitions: posteriors of neighbours, joined by how likely the move is. Their sum is a product of
    # matrices, so no table of all pairs of labels is made for each word.
    follows = np.ones(len(codes), bool)
    follows[starts] = False
    follows = np.nonzero(follows)[0]
    step = np.exp(model.moves - model.moves.max())
    one, two = post[follows - 1], post[follows]
    moves = -step * ((one / np.maximum(((one @ step) * two).sum(axis=1, keepdims=True), 1e-300)).T @ two)
    np.add.at(moves, (label[follows - 1], label[follows]), 1)
    return weights, lexicon, moves


def remainder(key: Column, n: int) -> Column:
    """crc32 of a key as text, modulo ``n``; null for null."""
    return F.crc32(key.cast("string")) % n


def fit_languages(
    docs: DataFrame, learn: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 250, most_bytes: int = 30_000,
    sample_bytes: int = SAMPLE_BYTES, rounds: int = 30, rate: float = 0.5, decay: float = 1e-5, length: int = 40,
) -> Model | None:
    """Train on texts of every language that labels name, ``sample_bytes`` of them in all.

    Every language has the same number of texts, ``per_language`` at most and 4 at least, drawn by a hash of key and text; of each the words from its
    first letter on that have an equal share of ``sample_bytes`` (``most_bytes`` at most, 400 at least) are used. With more labels than
    these least sizes have room for, the sample grows with their number. The sample lies in ``BLOCKS`` blocks. A round is one scan: tasks
    return the summed slopes of their blocks, and the driver, which holds the weights and never a text, takes one step. Weights have
    a fixed size until there are so many labels that lexicon and moves (labels x labels) outgrow it. ``learn`` says which rows may be
    used. None if there is no labelled text.
    """
    spark = docs.sparkSession
    rows = docs.filter(learn) if learn is not None else docs
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), text).alias("draw"))
    rows = rows.filter(F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}")))
    labels = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not labels:
        return None
    n_labels = len(labels)
    per = max(4, min(per_language, 2000 // n_labels))
    window = max(400, min(most_bytes, sample_bytes // (n_labels * per)))
    # A character has up to four bytes. The last word of a window goes if it may be cut, unless it is the only one.
    front = F.regexp_replace(F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{window // 4 - 1}}}", 0), r"\s+\S*$", "")
    rows = rows.withColumn("text", F.when(F.octet_length("text") > window, front).otherwise(F.col("text")))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    drawn = rows.withColumn("place", first).filter(F.col("place") <= per)
    blocks = max(1, min(BLOCKS, n_labels * per // 20))
    drawn = drawn.withColumn("block", F.pmod(F.xxhash64(F.col("draw"), F.lit(1)), F.lit(blocks)).cast("int"))
    number = {name: i for i, name in enumerate(labels)}

    def prepare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("lang", "ascending"), ("place", "ascending")])
        of_text = np.array([number[x] for x in table.column("lang").to_pylist()], np.int64)
        block = table.column("block")[0].as_py()
        codes, label, distinct = _spliced(W.filled(table.column("text")), of_text, block + 1)
        pair, times = np.unique(codes * n_labels + label, return_counts=True)
        seen = np.zeros(SEEN, bool)
        seen[seen_grams(distinct)[0]] = True
        found, counts = features(distinct)
        return pa.table({
            "found": pa.array([found.astype("<i4").tobytes()], pa.binary()), "counts": pa.array([counts.astype("<i4").tobytes()], pa.binary()),
            "block": pa.array([block], pa.int32()), "codes": pa.array([codes.astype("<i4").tobytes()], pa.binary()), "label": pa.array([label.astype("<i4").tobytes()], pa.binary()),
            "words": pa.array([distinct.cast(pa.string()).to_pylist()], pa.list_(pa.string())), "pair": pa.array([pair.astype("<i8").tobytes()], pa.binary()),
            "times": pa.array([times.astype("<i8").tobytes()], pa.binary()), "seen": pa.array([np.packbits(seen).tobytes()], pa.binary())})

    shape = "found binary, counts binary, block int, codes binary, label binary, words array<string>, pair binary, times binary, seen binary"
    held = cut_lineage(drawn.groupBy("block").applyInArrow(prepare, shape).repartition(blocks, "block"))
    seen = np.zeros(SEEN // 8, np.uint8)
    for r in held.select("seen").collect():
        seen |= np.frombuffer(r.seen, np.uint8)
    lexicon, owner = _lexicon(held, n_labels)
    buckets = BUCKETS
    while buckets * n_labels > MOST_WEIGHTS and buckets > 1024:
        buckets //= 2
    model = Model(labels, np.zeros((buckets, n_labels), np.float32), pa.array(lexicon, pa.large_string()), np.array(owner, np.int64), np.eye(n_labels, dtype=np.float32),
                  np.zeros((n_labels, n_labels)), np.unpackbits(seen).astype(bool))
    squares = [np.full(v.shape, 1e-6, np.float32) for v in (model.weights, model.lexicon_weights, model.moves)]
    learnt = held.select("block", "codes", "label", "words", "found", "counts")
    for _ in range(rounds if n_labels > 1 else 0):
        sent = spark.sparkContext.broadcast((model.weights, model.lexicon_weights, model.moves))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Model(labels, sent.value[0], pa.array(lexicon, pa.large_string()), np.array(owner, np.int64), sent.value[1], sent.value[2], np.zeros(0, bool))
            for batch in batches:
                for i in range(batch.num_rows):
                    codes, label, *hashed = (np.frombuffer(batch.column(c)[i].as_py(), "<i4").astype(np.int64) for c in ("codes", "label", "found", "counts"))
                    found = slopes(own, codes, label, batch.column("words")[i].values, tuple(hashed), length)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("block").slice(i, 1), pa.array([len(codes)], pa.int64()), *(pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in found)], ["block", "n", "a", "b", "c"])

        total: list[np.ndarray] | None = None
        n = 0
        # Block after block, in order, so that every run adds alike.
        for r in learnt.mapInArrow(scan, "block int, n long, a binary, b binary, c binary").toArrow().sort_by("block").to_pylist():
            parts = [np.frombuffer(r[x], "<f4").reshape(v.shape) for x, v in zip("abc", squares, strict=True)]
            total = [x.copy() for x in parts] if total is None else [np.add(t, x, out=t) for t, x in zip(total, parts, strict=True)]
            n += r["n"]
        total[0] -= np.float32(decay * n) * model.weights
        for value, slope, square in zip((model.weights, model.lexicon_weights, model.moves), total, squares, strict=True):
            square += slope * slope
            value += (rate * slope / np.sqrt(square)).astype(value.dtype)
        sent.destroy()
    return model


def _lexicon(held: DataFrame, n_labels: int) -> tuple[list[str], list[int]]:
    """The most frequent words of each label that have more than half of their uses, and more than one, in it; each has one label."""
    most = min(LEXICON, max(1, MOST_WORDS // n_labels))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair, times = (np.frombuffer(batch.column(c)[i].as_py(), "<i8") for c in ("pair", "times"))
                words = pc.utf8_lower(batch.column("words")[i].values).take(pa.array(pair // n_labels))
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(pair % n_labels), pa.array(times)], ["word", "label", "n"])

    used = held.select("words", "pair", "times").mapInArrow(counts, "word string, label long, n long").groupBy("word", "label").agg(F.sum("n").alias("n"))
    rival = used.groupBy("word").agg(F.max(F.struct("n", "label")).alias("best"), F.sum("n").alias("total")).select("word", "best.n", "best.label", "total")
    own = rival.filter((F.col("n") > 1) & (2 * F.col("n") > F.col("total")))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "word"))
    kept = own.withColumn("place", place).filter(F.col("place") <= most).orderBy("label", "place").collect()
    return [r.word for r in kept], [r["label"] for r in kept]


def _predict(model: Model | None, texts: pa.Array) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """Language and score of each text, its runs of words of one language, and how familiar its words are."""
    if model is None:
        return [UND] * len(texts), np.zeros(len(texts)), [""] * len(texts), np.zeros(len(texts))
    post, starts, letters, known = model.label(texts)
    names, scores, runs, familiar = [], np.zeros(len(texts)), [], np.zeros(len(texts))
    for i, (lo, hi) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        p = post[lo:hi][letters[lo:hi]]
        if not len(p):
            names.append(UND)
            runs.append("")
            continue
        mean = p.mean(axis=0)
        best = int(mean.argmax())
        names.append(model.labels[best])
        scores[i] = min(1.0, float(mean[best]))
        familiar[i] = known[lo:hi][letters[lo:hi]].mean()
        word = post[lo:hi].argmax(axis=1)
        edge = np.concatenate([[0], np.nonzero(np.diff(word))[0] + 1, [len(word)]])
        runs.append(",".join(f"{model.labels[word[a]]}:{a}:{b}" for a, b in zip(edge[:-1], edge[1:], strict=True)))
    return names, scores, runs, familiar


def languages(docs: DataFrame, model: Model | None, text: str = "text", out: tuple[str, str, str, str] = ("lang_pred", "score", "lang_runs", "familiar"), keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with predicted language, score, runs ``language:from:to`` of words and familiarity for every whole text.

    The language has the largest mean posterior over the words with a letter, the score is that mean. A null text, one without a
    letter, or no model: ``und`` and 0. Familiar is the mean share, over the same words, of a word's n-grams that the texts learnt from hold; unlike the
    score it does not depend on how many languages there are. Columns of the names ``out`` are replaced. Ties go to the first label in order. Only the text is looked at. The model is sent to all
    tasks; its size is fixed but for the number of languages. Nothing is shuffled.
    """
    columns = [c for c in (docs.columns if keep is None else keep) if c not in out]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    held = text if text in columns else free_name([*columns, text], "text")
    rows = docs.select(*[F.col(c) for c in columns], *([] if held == text else [F.col(text).alias(held)]))
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns), f"`{out[0]}` string, `{out[1]}` double, `{out[2]}` string, `{out[3]}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.steps(whole, held):
                names, scores, runs, familiar = _predict(sent.value, W.filled(batch.column(held)))
                found = [pa.array(names, pa.string()), pa.array(scores), pa.array(runs, pa.string()), pa.array(familiar)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *found], names=[*columns, *out])

    return rows.mapInArrow(run, schema)
