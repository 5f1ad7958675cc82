"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND with every passage of every text."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm import words as W

# Words of a passage and between starts of passages; words of a unit of an item.
PASSAGE, STRIDE = 64, 32
UNIT = 48
K1, B = 1.2, 0.75
# Units in one index; more items are searched in several passes. Units whose postings share a largest impact.
INDEX_UNITS, RANGE = 4000, 16
# Units of the finer ranges that passages are held against which the coarse ones let through.
FINE = 4
# Share of a unit's own score that a passage reaches, and of the shingles of question and answer it holds.
LEAST_SCORE, LEAST_OVERLAP, SHINGLE = 0.5, 0.6, 3
# Items of fewer words match where all their words stand in a row.
LEAST_WORDS = 5
# The share of a unit's score that its common words may add up to; they are looked at last.
COMMON = 0.2
EDGES = string.punctuation + "“”„‘’«»…–—¿¡"


def plain(word: str) -> str:
    return word.lower().strip(EDGES)


def parts(text: str) -> tuple[list[str], int]:
    """Words of an item, and how many of them are the question: up to the last question mark, else all but the last sentence, else half."""
    text = text.strip()
    cut = text.rfind("?", 0, len(text) - 1) + 1
    if not cut:
        cut = max(text.rfind(". ", 0, len(text) - 1), text.rfind(".\n", 0, len(text) - 1)) + 1
    front = [x for x in map(plain, text[:cut].split()) if x]
    back = [x for x in map(plain, text[cut:].split()) if x]
    if not front or not back:
        front, back = front + back, []
        return front, (len(front) + 1) // 2
    return front + back, len(front)


def _shingles(terms) -> set:
    n = min(SHINGLE, len(terms))
    return {tuple(terms[i : i + n]) for i in range(len(terms) - n + 1)} if n else set()


class Index:
    """Postings of units of items with impacts as shares of each unit's own score."""

    def __init__(self, items: list[tuple], frequency: dict[str, int], n_items: int, mean_words: float):
        self.items = [i for i, _, _ in items]
        self.number: dict[str, int] = {}
        postings: dict[int, list[tuple[int, float]]] = {}
        self.item_of, self.question, self.answer, self.words = [], [], [], []
        self.unit: list[set] = []
        self.exact: dict[tuple[int, ...], list[int]] = {}
        for k, (_, terms, n_question) in enumerate(items):
            ids = [self.number.setdefault(w, len(self.number)) for w in terms]
            name = dict(zip(ids, terms, strict=True))
            self.question.append(_shingles(ids[:n_question]))
            self.answer.append(_shingles(ids[n_question:]))
            self.words.append(len(ids))
            if len(ids) < LEAST_WORDS:
                self.exact.setdefault(tuple(ids), []).append(k)
                continue
            n_units = max(1, round(len(ids) / UNIT))
            for part in np.array_split(np.array(ids), n_units):
                # Units of longer items are looked at by themselves, too.
                self.unit.append(_shingles(part.tolist()) if n_units > 1 else set())
                values, times = np.unique(part, return_counts=True)
                idf = np.array([math.log(1 + (n_items - f + 0.5) / (f + 0.5)) for f in (frequency.get(name[v], 1) for v in values.tolist())])
                impact = idf * times * (K1 + 1) / (times + K1 * (1 - B + B * len(part) / max(mean_words, 1.0)))
                unit = len(self.item_of)
                self.item_of.append(k)
                for v, x in zip(values, impact / impact.sum(), strict=True):
                    postings.setdefault(int(v), []).append((unit, float(x)))
        n, units = len(self.number), len(self.item_of)
        self.lists = [([u for u, _ in postings.get(t, ())], [x for _, x in postings.get(t, ())]) for t in range(n)]
        self.largest = [max(x, default=0.0) for _, x in self.lists]
        # For each place in short items of one length, the words that may stand there; the last entry is for unknown words.
        self.places: dict[int, np.ndarray] = {}
        for run in self.exact:
            self.places.setdefault(len(run), np.zeros((len(run), n + 1), bool))[np.arange(len(run)), run] = True
        self.range_largest: list[dict[int, float]] = []
        for us, xs in self.lists:
            best: dict[int, float] = {}
            for u, x in zip(us, xs, strict=True):
                best[u // RANGE] = max(best.get(u // RANGE, 0.0), x)
            self.range_largest.append(best)
        # Common words add up to at most COMMON of any unit.
        held = np.zeros(units)
        common = np.zeros(n, bool)
        for t in sorted(range(n), key=lambda t: -len(self.lists[t][0])):
            us, xs = np.array(self.lists[t][0]), np.array(self.lists[t][1])
            if len(us) > 1 and (held[us] + xs <= COMMON).all():
                held[us] += xs
                common[t] = True
        self.coarse, self.fine = self._bounds(RANGE, common, held), self._bounds(FINE, common, held)

    def _bounds(self, size: int, common: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Largest impacts of the words that are not common by ranges of ``size`` units, as flat lists: where a word's begin, ranges, impacts; and what common words add at most."""
        ranges = -(-len(self.item_of) // size)
        place, most = [], []
        count = np.zeros(len(self.lists) + 1, np.int64)
        for t, (us, xs) in enumerate(self.lists):
            if us and not common[t]:
                at, first = np.unique(np.array(us) // size, return_index=True)
                place.append(at)
                most.append(np.maximum.reduceat(np.array(xs), first))
                count[t + 1] = len(at)
        added = np.array([held[r * size : (r + 1) * size].max() for r in range(ranges)])
        return np.cumsum(count), np.concatenate([*place, np.zeros(0, np.int64)]), np.concatenate([*most, np.zeros(0)]), added

    @staticmethod
    def _reach(bounds: tuple, terms: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Sum of the largest impacts of each owner's words, by range."""
        first, place, most, added = bounds
        count = first[terms + 1] - first[terms]
        at = np.repeat(first[terms] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.bincount(np.repeat(owner, count) * len(added) + place[at], most[at], minlength=n * len(added)).reshape(n, len(added))

    def hopeful(self, terms: np.ndarray, chunk: np.ndarray, n_chunks: int) -> np.ndarray:
        """For stretches of STRIDE words, whether the passage of two that starts there may reach LEAST_SCORE in some range.

        Coarse ranges are summed over all words of each stretch. Of the passages left, each word counts once, in finer ranges.
        """
        known = terms >= 0
        terms, chunk = terms[known], chunk[known]
        bound = self._reach(self.coarse, terms, chunk, n_chunks)
        bound[:-1] += bound[1:].copy()
        out = (bound + self.coarse[3] >= LEAST_SCORE - 1e-9).any(axis=1)
        passages = np.nonzero(out)[0]
        number = np.cumsum(out) - 1
        before = np.maximum(chunk - 1, 0)
        here, there = out[chunk], out[before] & (chunk > 0)
        wide = np.int64(len(self.number))
        pairs = np.sort(np.concatenate([number[chunk[here]] * wide + terms[here], number[before[there]] * wide + terms[there]]))
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
        bound = self._reach(self.fine, pairs % wide, pairs // wide, len(passages))
        out[passages] = (bound + self.fine[3] >= LEAST_SCORE - 1e-9).any(axis=1)
        return out

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Units whose score for a set of terms is LEAST_SCORE or more, by block-max WAND."""
        theta, end = LEAST_SCORE - 1e-9, len(self.item_of)
        cursors = [[self.lists[t][0][0], 0, t] for t in terms if self.lists[t][0]]
        found = []

        def seek(c: list, unit: int) -> None:
            us, i = self.lists[c[2]][0], c[1]
            step = 1
            while i + step < len(us) and us[i + step] < unit:
                i, step = i + step, step * 2
            while i < len(us) and us[i] < unit:
                i += 1
            c[0], c[1] = (us[i] if i < len(us) else end), i

        while True:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                if c[0] >= end:
                    break
                total += self.largest[c[2]]
                if total >= theta:
                    pivot = k
                    break
            if pivot < 0:
                return found
            unit = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == unit:
                pivot += 1
            block = unit // RANGE
            if sum(self.range_largest[c[2]].get(block, 0.0) for c in cursors[: pivot + 1]) < theta:
                # Nothing in this block can do it, unless a later list comes in.
                goal = (block + 1) * RANGE
                if pivot + 1 < len(cursors):
                    goal = min(goal, max(cursors[pivot + 1][0], unit + 1))
                for c in cursors[: pivot + 1]:
                    if c[0] < goal:
                        seek(c, goal)
            elif cursors[0][0] == unit:
                score = sum(self.lists[c[2]][1][c[1]] for c in cursors[: pivot + 1])
                if score >= theta:
                    found.append((unit, score))
                for c in cursors[: pivot + 1]:
                    seek(c, unit + 1)
            else:
                for c in cursors[:pivot]:
                    if c[0] < unit:
                        seek(c, unit)

    def runs(self, terms: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int]]:
        """Position and item for every short item whose words stand in a row inside one text."""
        for n, may in self.places.items():
            ends = len(terms) - n + 1
            if ends < 1:
                continue
            fits = doc[:ends] == doc[n - 1 :]
            for k in range(n):
                fits &= may[k][terms[k : k + ends]]
            for i in np.nonzero(fits)[0].tolist():
                for item in self.exact.get(tuple(terms[i : i + n].tolist()), ()):
                    yield i, item

    def unit_overlap(self, unit: int, terms: list[int]) -> float:
        """Share of the shingles of a unit of a longer item among those of ``terms``; 0 for an item of one unit."""
        own = self.unit[unit]
        return len(own & _shingles(terms)) / len(own) if own else 0.0

    def overlaps(self, item: int, terms: list[int]) -> tuple[float, float]:
        """Shares of the question's and the answer's shingles among those of ``terms``."""
        sizes = {len(x) for part in (self.question[item], self.answer[item]) for x in list(part)[:1]}
        seen = {n: {tuple(terms[i : i + n]) for i in range(len(terms) - n + 1)} for n in sizes}
        share = lambda part: sum(x in seen[len(x)] for x in part) / len(part) if part else 1.0
        return share(self.question[item]), share(self.answer[item])


def leaks(index: Index, texts: pa.Array, in_part: bool = False) -> list[tuple[int, int, int, float, float, float]]:
    """Text, item, first word of the best passage, its score, and the overlaps, for every verified pair; ``in_part``: also by one unit of a longer item."""
    flat, starts = W.split_words(texts)
    codes, distinct = W.coded(flat)
    if not len(codes) or not index.number:
        return []
    number = index.number
    bare = [plain(w) for w in distinct.to_pylist()]
    # Words of punctuation only count in neither items nor texts; ``place`` is where the others stand.
    place = np.nonzero(np.fromiter(map(bool, bare), bool, len(bare))[codes])[0]
    whole, starts = starts, np.searchsorted(place, starts)
    terms = np.fromiter((number.get(w, -1) for w in bare), np.int64, len(bare))[codes[place]]
    sizes = np.diff(starts)
    chunks = -(-sizes // STRIDE)
    # An empty stretch after each text: no passage runs into the next.
    first = np.cumsum(chunks + 1) - (chunks + 1)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    chunk = first[doc] + (np.arange(len(terms)) - starts[:-1][doc]) // STRIDE
    hopeful = np.nonzero(index.hopeful(terms, chunk, int((chunks + 1).sum())))[0]
    owner = np.searchsorted(first, hopeful, "right") - 1
    best: dict[tuple[int, int], tuple] = {}
    for i, item in index.runs(terms, doc):
        best.setdefault((int(doc[i]), item), (1.0, -i, 1.0, 1.0))
    for c, d in zip(hopeful.tolist(), owner.tolist(), strict=True):
        lo = int(starts[d]) + (c - int(first[d])) * STRIDE
        hi = min(lo + PASSAGE, int(starts[d + 1]))
        if lo >= hi:
            continue
        held = np.unique(terms[lo:hi])
        for unit, score in index.search([int(t) for t in held if t >= 0]):
            item = index.item_of[unit]
            wide = index.words[item]
            q, a = index.overlaps(item, terms[max(int(starts[d]), lo - wide) : min(int(starts[d + 1]), hi + wide)].tolist())
            holds = q >= LEAST_OVERLAP and a >= LEAST_OVERLAP
            if in_part and not holds:
                near = terms[max(int(starts[d]), lo - PASSAGE) : min(int(starts[d + 1]), hi + PASSAGE)]
                holds = index.unit_overlap(unit, near.tolist()) >= LEAST_OVERLAP
            if holds:
                found = (score, -lo, q, a)
                if found > best.get((d, item), (0.0,)):
                    best[d, item] = found
    return [(d, item, int(place[-lo] - whole[d]), score, q, a) for (d, item), (score, lo, q, a) in sorted(best.items())]


def indexes(benchmark: DataFrame, item: str = "item_id", text: str = "text", most_units: int = INDEX_UNITS) -> Iterator[Index]:
    """Indexes that hold all items, each of about ``most_units`` units at most; word counts are those of all items."""
    kind = benchmark.schema[item].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [parts(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), pa.array([w for w, _ in split], pa.list_(pa.string())), pa.array([n for _, n in split], pa.int32())], names=["item", "words", "n_question"])

    items = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).mapInArrow(run, f"item {kind}, words array<string>, n_question int")
    items = items.filter(F.size("words") > 0)
    total = items.agg(F.count("*").alias("n"), F.sum(F.ceil(F.size("words") / UNIT)).alias("units"), F.sum(F.size("words")).alias("words")).first()
    if not total.n:
        return
    passes = -(-int(total.units) // most_units)
    counts = items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    for p in range(passes):
        # A pass holds whole items of a bounded number of units.
        mine = items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(passes)) == p)
        rows = [(r["item"], list(r.words), r.n_question) for r in mine.collect()]
        need = mine.select(F.explode("words").alias("word")).distinct()
        frequency = {r.word: r.n for r in counts.join(need, "word").collect()}
        yield Index(sorted(rows, key=lambda r: (r[0] is None, r[0], r[1])), frequency, int(total.n), total.words / max(1, int(total.units)))


def leaked_items(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", most_units: int = INDEX_UNITS, in_part: bool = False) -> DataFrame:
    """One row per text and test item found in it: key, item, n_before (words before the best passage), score, question_overlap, answer_overlap.

    Words are lower-cased and stripped of punctuation. An item is indexed in units of about ``UNIT`` words with BM25 impacts as shares
    of the unit's own score, so one threshold fits all lengths. Every stretch of ``PASSAGE`` words, one each ``STRIDE``, is a query. Sums of the
    largest impacts of ranges of units, coarse ones and then finer ones, rule out most passages, block-max WAND finds all units that the others reach ``LEAST_SCORE`` with,
    and an item counts if ``LEAST_OVERLAP`` of the shingles of its question and of its answer lie near the passage. Nothing is shuffled. The
    index is sent to all tasks; it holds ``most_units`` units, and more items take more passes over the texts.

    With ``in_part`` an item of several units counts also where ``LEAST_OVERLAP`` of the shingles of one unit lie near the passage; the overlaps
    are those of the whole item all the same.

    Words of punctuation only are passed over in items and texts, but count in n_before. An item of fewer than ``LEAST_WORDS`` words counts
    where all of them stand in a row, with score and overlaps 1. Null and empty texts hold nothing; items without a word match nothing; repeated texts and items each
    give their rows. Other columns are ignored. Without items there are no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"`{key}` {kinds[0]}, `{item}` {kinds[1]}, n_before long, score double, question_overlap double, answer_overlap double"
    names = [key, item, "n_before", "score", "question_overlap", "answer_overlap"]

    def searched(index: Index) -> DataFrame:
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            ix = sent.value
            kind = to_arrow_type(item_type)
            for whole in batches:
                for batch in W.steps(whole, "text"):
                    found = leaks(ix, W.filled(batch.column("text")), in_part)
                    columns = list(zip(*found, strict=True)) if found else [()] * 6
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").take(pa.array(columns[0], pa.int64())), pa.array([ix.items[i] for i in columns[1]], kind), pa.array(columns[2], pa.int64()),
                         *(pa.array(c, pa.float64()) for c in columns[3:])], names=names)

        return rows.mapInArrow(run, schema)

    item_type = benchmark.schema[item].dataType
    out = None
    for index in indexes(benchmark, item, most_units=most_units):
        found = searched(index)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", most_units: int = INDEX_UNITS, in_part: bool = False) -> DataFrame:
    """``docs`` without the rows whose text holds a test item, as ``leaked_items`` finds them. All other rows stay as they are."""
    spark = docs.sparkSession
    out = docs
    for index in indexes(benchmark, item, most_units=most_units):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in W.steps(whole, text):
                    stays = np.ones(batch.num_rows, bool)
                    stays[[x[0] for x in leaks(sent.value, W.filled(batch.column(text)), in_part)]] = False
                    yield batch.filter(pa.array(stays))

        out = out.mapInArrow(run, out.schema)
    return out
