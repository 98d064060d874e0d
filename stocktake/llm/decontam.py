"""Benchmark decontamination by latent semantic retrieval.

1. Terms are the words of the benchmark.  One pass over all documents counts in
   how many passages each term stands; terms that more than ``COMMON`` of all
   passages hold say little and are dropped, except the rarest words of each
   item: ``SHARE`` of them and ``FEWEST`` at least.  So an item that stands in
   many documents is still found by more words than a paraphrase may change.
2. A second pass takes the distributed randomised SVD of the TF-IDF matrix A of
   all passages: every task multiplies its rows with a random matrix and adds up
   its share of A'(A W).  The shares are summed by Spark; their sum, of fixed
   size, gives the leading right singular vectors (Nystrom's formula).
3. The latent space is spanned by these vectors and by what the benchmark items
   have outside them, so that rare words of an item keep a direction.
4. A third pass folds overlapping windows of every document into that space,
   less those that hold too few words of every item to pass the check below.
   Windows within ``COSINE`` of an item are candidates.
5. Each candidate is checked on the words themselves: the longest common
   subsequence of item and region must cover ``COVER`` of the item, or less if
   the item's answer (its last sentence) stands in the region word by word.

Documents stay where they are; only sums of fixed size and hits are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, over_batches, text_slices, tidy
from .textnum import Words

PASSAGE = 64  # words of a passage that the statistics count
WINDOW, STRIDE = 64, 16  # words of a window that is searched, and its step
PROBE = 48  # words of an item that one probe holds; longer items have several
RANK = 96
COMMON, SHARE, FEWEST = 0.2, 0.75, 6
COSINE = 0.4
COVER, COVER_WITH_ANSWER = 0.7, 0.6
MIN_WORDS = 8  # shorter items can't be told from chance; they match only whole
SCREENED = 0.6  # share of an item's words, rarest first, that screens windows
ITEM_BLOCK = 256  # items searched at once, at most
PIECE = 32  # rows of a run that are summed one by one
PARTS = 32  # pieces in which tasks send their sums
FAN_IN = 32  # sums of tasks that one step adds up
ROUND_BYTES = 64 << 20  # latent spaces that tasks hold at once; more take more passes


@dataclass
class Item:
    """A benchmark item: its words as numbers, and where its answer begins."""

    item_id: int
    words: np.ndarray
    answer: int

    @cached_property
    def masks(self) -> dict[int, int]:
        return _masks(self.words)

    @cached_property
    def answer_bytes(self) -> bytes:
        """The answer's words, empty if the item has no sentence before it."""
        return self.words[self.answer :].tobytes() if self.answer > 0 else b""


def items_of(benchmark: DataFrame) -> list[Item]:
    """Items of the benchmark (item_id, text), which is a stated query set and
    is read to the driver; items without words are left out."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL AND item_id IS NOT NULL").distinct().orderBy("item_id", "text").collect()
    texts = [r.text for r in rows]
    words = Words(texts)
    out = []
    for i, row in enumerate(rows):
        lo, hi = words.offsets[i], words.offsets[i + 1]
        if lo == hi:
            continue
        begins = int(words.begins[i])
        text = words.joined[begins : int(words.begins[i + 1]) - 1].rstrip(" .!?\n")
        cut = max(text.rfind(c) for c in ".!?\n:")
        answer = int(np.searchsorted(words.starts[lo:hi], begins + cut)) if cut >= 0 else 0
        out.append(Item(row.item_id, words.hashes[lo:hi].copy(), answer))
    return out


def _term_places(hashes: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Index in ``terms`` of each word, -1 for others."""
    screen = np.zeros(1 << 16, bool)
    screen[(terms & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = np.full(len(hashes), -1, np.int64)
    at = np.flatnonzero(screen[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    place = np.minimum(np.searchsorted(terms, hashes[at]), len(terms) - 1)
    hit = terms[place] == hashes[at]
    out[at[hit]] = place[hit]
    return out


def _passages(words: Words) -> tuple[np.ndarray, int]:
    """Number of the passage of each word, and how many passages there are."""
    count = np.diff(words.offsets)
    parts = -(-count // PASSAGE)
    first = np.cumsum(parts) - parts
    doc = np.repeat(np.arange(len(count)), count)
    return first[doc] + (np.arange(count.sum()) - words.offsets[:-1][doc]) // PASSAGE, int(parts.sum())


def row_sums(table: np.ndarray, place: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``table[place]`` over the runs of ``place`` that begin at
    ``starts``, none of them empty.  The k-th rows of all runs are added at once,
    the longest runs first, so numpy adds whole arrays; runs of more than
    ``PIECE`` are summed in pieces, and their pieces in turn."""
    sizes = np.diff(starts, append=len(place))
    if len(sizes) and sizes.max() > PIECE:
        count = -(-sizes // PIECE)
        first = np.cumsum(count) - count
        pieces = np.repeat(starts - PIECE * first, count) + PIECE * np.arange(count.sum())
        return row_sums(row_sums(table, place, pieces), np.arange(len(pieces)), first)
    order = np.argsort(-sizes, kind="stable")
    begins, longer = starts[order], np.cumsum(np.bincount(sizes, minlength=1)[::-1])[::-1]
    sums = table[place[begins]]
    for k in range(1, len(longer) - 1):
        active = longer[k + 1]
        sums[:active] += table[place[begins[:active] + k]]
    out = np.empty_like(sums)
    out[order] = sums
    return out


_SHARE = "task int, part int, data binary"
_SHARE_SCHEMA = pa.schema([("task", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])


def _sum_arrays(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of float arrays of one fixed size, sent by tasks in parts
    (``_share``).  Each step adds up ``FAN_IN`` tasks' parts, then as many of
    their sums, then the rest: no task reads a share of every other one, as long
    as there are fewer than ``FAN_IN`` cubed."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for task, part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, value = (task // FAN_IN, part), np.frombuffer(data, "<f8")
                sums[key] = sums[key] + value if key in sums else value
        yield batch_of(_SHARE_SCHEMA, [k[0] for k in sums], [k[1] for k in sums], [v.tobytes() for v in sums.values()])

    for _ in range(3):
        rows = over_batches(rows.repartition(F.floor(F.col("task") / FAN_IN), "part"), add, _SHARE)
    out = np.zeros(size)
    chunk = -(-size // PARTS)
    for _, part, data in rows.collect():
        value = np.frombuffer(bytes(data), "<f8")
        out[part * chunk : part * chunk + len(value)] += value
    return out


def _share(values: np.ndarray) -> pa.RecordBatch:
    """What a task adds to a sum, in ``PARTS`` parts."""
    flat = values.ravel().astype("<f8")
    chunk = -(-len(flat) // PARTS)
    cuts = [(i, flat[i * chunk : (i + 1) * chunk].tobytes()) for i in range(PARTS) if i * chunk < len(flat)]
    return batch_of(_SHARE_SCHEMA, [TaskContext.get().partitionId()] * len(cuts), [i for i, _ in cuts], [d for _, d in cuts])


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, float]:
    """Passages that hold each term, and all passages, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        found = np.zeros(len(terms) + 1)
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0)):
                words = Words(texts)
                passage, count = _passages(words)
                place = _term_places(words.hashes, terms)
                hit = np.flatnonzero(place >= 0)
                pairs = np.sort(passage[hit] * len(terms) + place[hit])
                held = pairs[np.diff(pairs, prepend=-1) > 0] % len(terms)
                found[:-1] += np.bincount(held, minlength=len(terms))
                found[-1] += count
        yield _share(found)

    total = _sum_arrays(over_batches(docs.select(F.col("text").cast("string")), run, _SHARE), len(terms) + 1)
    return total[:-1], float(total[-1])


def singular_vectors(docs: DataFrame, terms: np.ndarray, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF matrix of all passages."""
    rank = min(rank, len(terms))
    probe = np.random.default_rng(11).standard_normal((len(terms), rank)).astype(np.float32)
    weighted = (probe * idf[:, None]).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        share = np.zeros((len(terms), rank), np.float32)
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0)):
                words = Words(texts)
                passage, _ = _passages(words)
                place = _term_places(words.hashes, terms)
                hit = np.flatnonzero(place >= 0)
                if not len(hit):
                    continue
                own, place = passage[hit], place[hit]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                product = row_sums(weighted, place, first)  # rows of A W
                order = np.argsort(place, kind="stable")
                start = np.flatnonzero(np.diff(place[order], prepend=-1))
                row = np.cumsum(np.diff(own, prepend=own[0]) > 0)
                share[place[order][start]] += row_sums(product, row[order], start)
        yield _share(share * idf[:, None])

    y = _sum_arrays(over_batches(docs.select(F.col("text").cast("string")), run, _SHARE), len(terms) * rank).reshape(-1, rank)
    core = probe.T.astype(np.float64) @ y  # W' A'A W
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > max(values[-1], 1e-12) * 1e-9
    basis, _ = np.linalg.qr(y @ (vectors[:, keep] / np.sqrt(values[keep])))
    return basis


@dataclass
class Space:
    """Probes of a block of items, and the terms' places in the latent space."""

    embed: np.ndarray  # (term, dimension), times idf
    probes: np.ndarray  # (probe, dimension), of length one
    owner: np.ndarray  # item of each probe
    least: float  # squared length that a window needs to come near a probe
    items: int


def latent_space(items: Sequence[Item], terms: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> Space:
    """The space of the singular vectors and of the items beyond them."""
    rows, owner = [], []
    for k, item in enumerate(items):
        cuts = range(0, max(1, len(item.words) - PROBE // 2), PROBE)
        for at in cuts:
            part = item.words[at : at + PROBE] if at + 3 * PROBE // 2 < len(item.words) else item.words[at:]
            place = _term_places(part, terms)
            vector = np.bincount(place[place >= 0], minlength=len(terms)) * idf
            if vector.any():
                rows.append(vector)
                owner.append(k)
    if not rows:
        return Space(np.zeros((len(terms), 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.int64), 0.0, len(items))
    own = np.array(rows)
    rest = own - own @ basis @ basis.T
    q, r = np.linalg.qr(rest.T)
    space = np.concatenate([basis, q[:, np.abs(np.diag(r)) > 1e-9]], axis=1)
    probes = own @ space
    size = np.linalg.norm(probes, axis=1, keepdims=True)
    return Space((space * idf[:, None]).astype(np.float32), (probes / size).astype(np.float32), np.array(owner), float((COSINE * size.min() * 0.5) ** 2), len(items))


def _masks(a: np.ndarray) -> dict[int, int]:
    """For each word, a number with the bits of its places in ``a``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def _common(masks: dict[int, int], size: int, b: list[int]) -> int:
    full = (1 << size) - 1
    row = full
    for x in b:
        match = row & masks.get(x, 0)
        if match:
            row = (row + match | row - match) & full
    return size - row.bit_count()


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit by bit over ``a``."""
    return _common(_masks(a), len(a), b.tolist())


def _check(item: Item, region: np.ndarray) -> tuple[float, bool]:
    """Share of the item in the region in order, and whether its answer is
    there; (0, False) if too few of its words are there in any order."""
    words, size = region.tolist(), len(item.words)
    if sum(item.masks[x].bit_count() for x in item.masks.keys() & words) < COVER_WITH_ANSWER * size:
        return 0.0, False
    cover = _common(item.masks, size, words) / size
    if cover < COVER_WITH_ANSWER:
        return cover, False
    return cover, _holds(region.tobytes(), item.answer_bytes)


def _holds(region: bytes, answer: bytes) -> bool:
    """Whether the answer's words stand in the region, one behind the other."""
    at = region.find(answer) if answer else -1
    while at > 0 and at % 8:  # inside a word's number
        at = region.find(answer, at + 1)
    return at >= 0


def is_leak(item: Item, cover: float, answered: bool) -> bool:
    if len(item.words) < MIN_WORDS:
        return cover == 1.0
    return cover >= COVER or (answered and cover >= COVER_WITH_ANSWER)


class Screen:
    """Which windows may hold an item of a block at all.  A leak leaves out at
    most so many of an item's words; so of its rarer words (``SCREENED`` of all)
    the rest stand in the region that the check reads.  No leak is lost."""

    def __init__(self, items: Sequence[Item], terms: np.ndarray, idf: np.ndarray) -> None:
        own, owner, need, reach = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], []
        for k, item in enumerate(items):
            size, place = len(item.words), _term_places(item.words, terms)
            found, times = np.unique(place[place >= 0], return_counts=True)
            order = np.argsort(-idf[found], kind="stable")
            chosen = order[: int(np.searchsorted(np.cumsum(times[order]), SCREENED * size)) + 1]
            least = size if size < MIN_WORDS else COVER_WITH_ANSWER * size
            own.append(found[chosen])
            owner.append(np.full(len(chosen), k))
            need.append(times[chosen].sum() - (size - least) - 1e-6)
            reach.append(-(-(size if size > PROBE else STRIDE) // STRIDE))
        own, owner = np.concatenate(own), np.concatenate(owner)
        order = np.argsort(own, kind="stable")
        self.owner, self.starts = owner[order], np.searchsorted(own[order], np.arange(len(terms) + 1))
        self.need, self.reach = np.array(need), np.array(reach)

    def possible(self, block: np.ndarray, place: np.ndarray, total: int) -> np.ndarray:
        """For each of ``total`` blocks, whether the window that begins there
        passes; from the sorted block and the term of each word."""
        out, width, span = np.zeros(total, bool), len(self.need), WINDOW // STRIDE
        most = int(self.reach.max())
        for at in range(0, total, 4096):
            end = min(total, at + 4096)
            low, high = max(0, at - most), min(total, end + span + most)
            a, b = np.searchsorted(block, (low, high))
            times = self.starts[place[a:b] + 1] - self.starts[place[a:b]]
            index = np.repeat(self.starts[place[a:b]] - np.cumsum(times) + times, times) + np.arange(times.sum())
            cell = np.repeat(block[a:b] - low, times) * width + self.owner[index]
            sums = np.zeros((high - low + 1, width), np.int32)
            np.cumsum(np.bincount(cell, minlength=(high - low) * width).reshape(-1, width), axis=0, out=sums[1:])
            window = np.arange(at, end) - low
            for reach in np.unique(self.reach):
                mine = self.reach == reach
                part = sums[:, mine]
                held = part[np.minimum(window + span + reach, high - low)] - part[np.maximum(window - reach, 0)]
                out[at:end] |= (held >= self.need[mine]).any(axis=1)
        return out


class Searcher:
    """Searches the windows of texts; one for each task."""

    def __init__(self, items: Sequence[Item], terms: np.ndarray, idf: np.ndarray, spaces: Sequence[tuple[int, Space]]) -> None:
        self.items, self.terms, self.spaces = items, terms, spaces
        self.screens = [Screen(items[at : at + space.items], terms, idf) for at, space in spaces]
        self.energy = (idf**2).astype(np.float32)

    def search(self, texts: list[str]) -> list[tuple[int, int, float, float, bool, int]]:
        """(text, item, cosine, cover, answered, first word) of every leak, the
        best window of each text and item."""
        words = Words(texts)
        place = _term_places(words.hashes, self.terms)
        hit = np.flatnonzero(place >= 0)
        if not len(hit):
            return []
        place = place[hit]
        count = np.diff(words.offsets)
        blocks = np.maximum(1, -(-count // STRIDE))  # of STRIDE words each
        first = np.cumsum(blocks) - blocks
        doc = np.searchsorted(words.offsets, hit, side="right") - 1
        block = first[doc] + (hit - words.offsets[doc]) // STRIDE
        total = int(blocks.sum())
        span = WINDOW // STRIDE
        owner = np.repeat(np.arange(len(count)), blocks)
        energy = np.concatenate(([0], np.cumsum(np.bincount(block, self.energy[place], total))))
        last = (first + blocks)[owner]
        end = np.minimum(np.arange(total) + span, last)
        mass = energy[end] - energy[np.arange(total)]
        # the last windows of a text lie inside its last whole one
        whole = (np.arange(total) + span <= last) | (np.arange(total) == first[owner])
        found: dict[tuple[int, int], tuple[float, float, bool, int]] = {}
        for (shift, space), screen in zip(self.spaces, self.screens, strict=True):
            if not len(space.probes):
                continue
            near = np.flatnonzero(whole & (mass >= space.least) & screen.possible(block, place, total))
            at = 0
            while at < len(near):
                part = near[at : at + 4096]
                part = part[part < part[0] + 8192]  # bounds the dense blocks
                at += len(part)
                lo, hi = np.searchsorted(block, part[0]), np.searchsorted(block, end[part[-1]])
                local = block[lo:hi] - part[0]
                dense = np.zeros((int(end[part[-1]] - part[0]), space.embed.shape[1]), np.float32)
                wanted = np.zeros(len(dense) + span, bool)
                for k in range(span):
                    wanted[part - part[0] + k] = True
                used = wanted[local]
                cut = np.flatnonzero(np.diff(local[used], prepend=-1))
                if not len(cut):
                    continue
                dense[local[used][cut]] = row_sums(space.embed, place[lo:hi][used], cut)
                vectors = np.zeros((len(part), dense.shape[1]), np.float32)
                for k in range(span):
                    inside = part + k < end[part]
                    vectors[inside] += dense[part[inside] + k - part[0]]
                length = np.linalg.norm(vectors, axis=1)
                cosine = vectors @ space.probes.T
                rows, columns = np.nonzero(cosine >= COSINE * np.maximum(length, 1e-6)[:, None])
                for w, p in zip(rows.tolist(), columns.tolist(), strict=True):
                    number = shift + int(space.owner[p])
                    item, d = self.items[number], int(owner[part[w]])
                    start = int(part[w] - first[d]) * STRIDE
                    slack = len(item.words) if len(item.words) > PROBE else STRIDE
                    low = words.offsets[d] + max(0, start - slack)
                    high = min(words.offsets[d + 1], words.offsets[d] + start + WINDOW + slack)
                    cover, answered = _check(item, words.hashes[low:high])
                    if is_leak(item, cover, answered):
                        value = (cover, float(cosine[w, p] / length[w]), answered, start)
                        key = (d, number)
                        if key not in found or (value[0], value[1], -value[3]) > (found[key][0], found[key][1], -found[key][3]):
                            found[key] = value
        return [(d, k, v[1], v[0], v[2], v[3]) for (d, k), v in found.items()]


def prepare(docs: DataFrame, benchmark: DataFrame) -> tuple[list[Item], np.ndarray, np.ndarray, list[tuple[int, Space]]]:
    """Items, terms, idf and latent spaces, from all documents."""
    items = items_of(benchmark)
    if not items:
        return [], np.zeros(0, np.uint64), np.zeros(0), []
    terms = np.unique(np.concatenate([x.words for x in items]))
    held, total = document_frequencies(docs, terms)
    keep = held <= COMMON * total
    for item in items:
        own = np.unique(_term_places(item.words, terms))
        fewest = max(FEWEST, math.ceil(SHARE * len(own)))
        keep[own[np.argsort(held[own], kind="stable")[:fewest]]] = True
    terms, held = terms[keep], held[keep]
    idf = np.log((1 + total) / (1 + held)) + 0.1
    basis = singular_vectors(docs, terms, idf)
    # a block's space has about two directions an item beside the vectors
    block = min(ITEM_BLOCK, max(8, (ROUND_BYTES // 4 // max(1, len(terms)) - RANK) // 2))
    spaces = [(at, latent_space(items[at : at + block], terms, idf, basis)) for at in range(0, len(items), block)]
    return items, terms, idf, spaces


def _rounds(spaces: Sequence[tuple[int, Space]]) -> list[list[tuple[int, Space]]]:
    """``spaces`` in rounds of ``ROUND_BYTES`` at most, so what goes with the
    tasks doesn't grow with the benchmark; each round is a pass."""
    out: list[list[tuple[int, Space]]] = [[]]
    for x in spaces:
        if out[-1] and sum(s.embed.nbytes for _, s in [*out[-1], x]) > ROUND_BYTES:
            out.append([])
        out[-1].append(x)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark items found in ``docs`` (doc_id, text, any other columns).

    Result, a row for each document row and item: ``doc_id``, ``item_id``,
    ``cosine``, ``cover`` (share of the item's words in order), ``answered``,
    ``start_word`` of the window.  Null and empty texts have none; repeated rows
    give repeated results; an empty table or benchmark gives an empty result.
    """
    items, terms, idf, spaces = prepare(docs, benchmark)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("cover", pa.float64()), ("answered", pa.bool_()), ("start_word", pa.int64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def one(own: list[tuple[int, Space]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tidy()
            searcher = Searcher(items, terms, idf, own)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for lo, _, texts in text_slices(batch.column(1)):
                    found = searcher.search(texts) if items else []
                    yield batch_of(schema, [ids[lo + x[0]] for x in found], [items[x[1]].item_id for x in found], *([x[k] for x in found] for k in range(2, 6)))

        return over_batches(rows, run, "doc_id long, item_id long, cosine double, cover double, answered boolean, start_word long")

    return reduce(DataFrame.unionByName, map(one, _rounds(spaces)))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` (text and any other columns), all columns, that hold no
    benchmark item.  Null and empty texts stay, repeated rows go or stay
    together, rows stay in place; without documents or items nothing changes."""
    items, terms, idf, spaces = prepare(docs, benchmark)
    at = docs.columns.index("text")

    def one(rows: DataFrame, own: list[tuple[int, Space]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tidy()
            searcher = Searcher(items, terms, idf, own)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, _, texts in text_slices(batch.column(at)):
                    for found in searcher.search(texts) if items else []:
                        keep[lo + found[0]] = False
                yield batch.filter(pa.array(keep))

        return over_batches(rows, run, rows.schema)

    return reduce(one, _rounds(spaces), docs)
