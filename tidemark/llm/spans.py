"""Long exact spans that stand in more than one document.

1. Exact copies are folded: one document of each text stands for all.
2. Every document is fingerprinted: of the K-grams in each window of ``least - K + 1`` positions the one with the smallest hash is taken. Two
   documents with ``least`` equal characters in a row then have an equal fingerprint inside them. Fingerprints route text to shards, so no document meets all
   others: a fingerprint found in two documents sends the region around it, all that a span of ``least`` characters through it can cover, to the shard of its hash.
3. Each shard holds an FM-index of its regions: the Burrows-Wheeler transform of their code points in a wavelet matrix, and the document of each suffix. The regions
   are streamed through it from their ends, all at once: backward search keeps the interval of the longest match, cut to ``least`` characters, at every
   position. An interval of ``least`` characters with more than one document is a group of documents that all share this span. Of intervals that one
   common character before them makes equal, only the first is reported.
4. A fingerprint of more than ``hot_regions`` regions, a licence text in every tenth document, say, has no shard: of its regions every stretch of ``least`` characters
   is hashed twice, and equal stretches are groups. Both ways cost no more than the regions' characters, however many documents share a span.

Results are groups and their members; pairs are made from them only where they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.salting import salted_join
from tidemark.session import cut_lineage

LEAST = 200
GRAM = 96
SHARD_CHARS = 1 << 20
HOT_REGIONS = 4096
MEMBERS = 1024
LANE = 1024
SEGMENT = 1 << 20
PLACE = np.uint64((1 << 21) - 1)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


# ---------------------------------------------------------------- fingerprints


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Hasher:
    """64-bit hashes of the ``gram`` code points from each position on; equal grams, equal hashes.

    A polynomial modulo 2**64 over scrambled code points: one running sum, and differences of it brought to power 0 and scrambled again.
    """

    def __init__(self, base: np.uint64 = BASES[0]) -> None:
        self.base = base
        self.up = self.down = np.ones(0, np.uint64)

    def grams(self, points: np.ndarray, gram: int) -> np.ndarray:
        n = len(points)
        if n < gram:
            return np.zeros(0, np.uint64)
        if len(self.up) < n:
            size = max(n, 1 << 14)
            powers = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64)
            self.up, self.down = powers(self.base), powers(np.uint64(pow(int(self.base), -1, 1 << 64)))
        c = scrambled(points.astype(np.uint64) + np.uint64(1))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(c * self.up[:n], out=total[1:])
        return scrambled((total[gram:] - total[:-gram]) * self.down[: n - gram + 1])


def scrambled(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(29))


def sliding_argmin(h: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the smallest hash of some window, of several the first; in a stretch of equal smallest hashes, one per window length.

    The lower 21 bits of a hash give way to its position, so one sliding minimum finds both.
    """
    n = len(h)
    blocks = -(-n // window)
    padded = np.full(blocks * window, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = (h & ~PLACE) | np.arange(n, dtype=np.uint64)
    grid = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - window + 1], ahead[window - 1 : n])
    fresh = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    picks = (least[fresh] & PLACE).astype(np.int64)
    value = least[fresh] & ~PLACE
    tied = value[1:] == value[:-1]
    if not tied.any():
        return picks
    keep = np.ones(len(picks), bool)
    first = np.flatnonzero(tied & ~np.r_[False, tied[:-1]])
    last = np.flatnonzero(tied & ~np.r_[tied[1:], False]) + 1
    for a, z in zip(first, last):  # picks a..z have one hash: keep enough for every window that starts before the next
        at = picks[a : z + 1]
        keep[a : z + 1] = False
        j, stop = fresh[a], fresh[z + 1] if z + 1 < len(fresh) else len(least)
        while j < stop:
            k = int(np.searchsorted(at, j + window - 1, "right")) - 1
            keep[a + k] = True
            j = at[k] + 1
    return picks[keep]


def fingerprints(text: str, least: int = LEAST, gram: int = GRAM, hasher: Hasher | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions; every stretch of ``least`` characters holds one, chosen by its content alone."""
    points = code_points(text)
    hasher = hasher or Hasher()
    hashes, places = [], []
    for at in range(0, max(1, len(points) - least + 1), SEGMENT):
        part = points[at : at + SEGMENT + least - 1]
        if len(part) < least:
            break
        h = hasher.grams(part, gram)
        p = sliding_argmin(h, least - gram + 1)
        hashes.append(h[p])
        places.append(p + at)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first].view(np.int64), p


def fingerprint_batches(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            found = [fingerprints(t, least, gram, hasher) for t in batch.column("text").to_pylist()]
            at = np.r_[0, np.cumsum([len(p) for _, p in found])]
            one = pa.StructArray.from_arrays([pa.array(np.concatenate([h for h, _ in found] or [np.zeros(0, np.int64)])), pa.array(np.concatenate([p for _, p in found] or [np.zeros(0, np.int64)]))], names=["h", "pos"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), batch.column("n"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), one)], names=["doc_id", "text_key", "n", "prints"])

    return run


# ---------------------------------------------------------------- the index


class WaveletMatrix:
    """Symbols below 2**bits as bit planes with running counts of ones; rank of a symbol in a prefix, for many at once."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.n = bits, len(symbols)
        self.words, self.ones, self.zeros = [], [], []
        cur = symbols
        for level in range(bits - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(bool)
            padded = np.zeros(-(-(self.n + 1) // 64) * 64, bool)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.ones.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.zeros.append(int(self.n - bit.sum()))
            cur = np.concatenate([cur[~bit], cur[bit]])
        order = np.sort(symbols, kind="stable")
        self.before = np.searchsorted(order, np.arange((1 << bits) + 1))  # symbols smaller than c
        self.first = self._origins()

    def _rank1(self, level: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            r = self._rank1(level, i)
            i = np.where(one, self.zeros[level] + r, i - r)
        return i

    def _origins(self) -> np.ndarray:
        """Where each symbol's rows start on the last level."""
        return self._descend(np.arange(1 << self.bits), np.zeros(1 << self.bits, np.int64))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._descend(symbol, i) - self.first[symbol]


class FMIndex:
    """Texts joined and ended by separators (symbol 0), of symbols up to ``top``: their Burrows-Wheeler transform as a wavelet matrix.

    Suffixes are sorted by more than ``depth`` symbols, which is enough for patterns up to one more than that. ``start`` and ``end`` bound, for
    each row of the sorted suffixes, the rows equal to it in ``depth`` symbols. Separators are unlike any symbol of a pattern.
    """

    def __init__(self, text: np.ndarray, depth: int, top: int) -> None:
        n = len(text)
        bits = max(1, top.bit_length())
        have = min(62 // bits, depth)
        packed = np.zeros(n, np.int64)
        for k in range(have):
            packed <<= bits
            packed[: n - k] |= text[k:]
        ranks = [(have, self._ranks(packed, np.argsort(packed, kind="stable")))]
        while have <= depth:
            rank = ranks[-1][1]
            after = np.zeros(n, np.int64)
            after[: max(0, n - have)] = rank[have:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            have *= 2
            ranks.append((have, self._ranks(key, order)))
        # equal in depth symbols: equal in the most that ranks cover, from the start and up to the end
        most, rank = max((r for r in ranks if r[0] <= depth), key=lambda r: r[0])
        here = rank[order]
        far = order + (depth - most)
        tail = np.where(far < n, rank[np.minimum(far, n - 1)], -1) if most < depth else here
        new = np.r_[True, (here[1:] != here[:-1]) | (tail[1:] != tail[:-1])]
        bound = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.start, self.end = bound, np.r_[bound[1:], n]
        self.places = order
        self.last = np.r_[text, 0][order - 1].astype(np.int64)
        self.waves = WaveletMatrix(self.last, bits)

    @staticmethod
    def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
        ordered = key[order]
        out = np.empty(len(key), np.int64)
        out[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        return out

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of matches -> those with ``symbol`` before them; empty where there are none."""
        both = self.waves.before[symbol][None] + self.waves.rank(np.r_[symbol, symbol], np.r_[lo, hi]).reshape(2, -1)
        return both[0], both[1]


def stream(index: FMIndex, text: np.ndarray, begin: np.ndarray, size: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Matching statistics cut at ``least``: the positions of ``text`` from which ``least`` symbols match, and the index's group of that match.

    Stretches ``begin, size`` of ``text`` are read from their ends, all in step. They are stretches of the indexed text themselves, so no match ever breaks off;
    what is asked for is who else is in its interval.
    """
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    lo, hi, length = np.zeros(len(size), np.int64), np.full(len(size), index.waves.n, np.int64), np.zeros(len(size), np.int64)
    at, group = [], []
    for step in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-size, -step, "left"))  # stretches longer than step
        place = begin[:live] + size[:live] - 1 - step
        symbol = text[place]
        a, z = index.extend(symbol, lo[:live], hi[:live])
        length[:live] += 1
        full = np.flatnonzero(length[:live] >= least)
        if len(full):
            g = index.group[a[full]]
            a[full], z[full] = index.start[g], index.end[g]
            length[full] = least
            at.append(place[full])
            group.append(g)
        lo[:live], hi[:live] = a, z
    cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
    return cat(at), cat(group)


def merged_regions(doc: np.ndarray, start: np.ndarray, texts: list[str]) -> list[list]:
    """Regions of a document that overlap or touch, as one."""
    out: list[list] = []
    for k in np.lexsort((start, doc)):
        last = out[-1] if out else None
        if last and last[0] == doc[k] and start[k] <= last[1] + len(last[2]):
            fresh = start[k] + len(texts[k]) - last[1] - len(last[2])
            if fresh > 0:
                last[2] += texts[k][-fresh:]
        else:
            out.append([doc[k], start[k], texts[k]])
    return out


def search_shard(regions: list[list], least: int, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Of regions ``[doc, start, text]``: members (group, doc) of spans shared by documents, and shared spans (doc, from, to)."""
    points = [code_points(t) for _, _, t in regions]
    sizes = np.array([len(p) for p in points])
    letters, flat = np.unique(np.concatenate(points), return_inverse=True)
    begin = np.r_[0, np.cumsum(sizes + 1)[:-1]] + 1
    joined = np.zeros(int(sizes.sum()) + len(points) + 1, np.int64)
    joined[np.repeat(begin - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(len(flat))] = flat + 1
    doc, start = np.array([r[0] for r in regions]), np.array([r[1] for r in regions])
    index = FMIndex(joined, least, len(letters))
    owner = np.searchsorted(begin, index.places, side="right") - 1
    of = doc[np.maximum(owner, 0)]
    shared = np.minimum.reduceat(of, index.start) != np.maximum.reduceat(of, index.start)
    # stretches of bounded length, each least - 1 symbols into the next
    pieces = np.maximum(1, -(-(sizes - least + 1) // lane))
    region = np.repeat(np.arange(len(sizes)), pieces)
    piece = np.arange(len(region)) - np.repeat(np.r_[0, np.cumsum(pieces)[:-1]], pieces)
    at, group = stream(index, joined, begin[region] + piece * lane, np.minimum(lane + least - 1, sizes[region] - piece * lane), least)
    hit = shared[group]
    at, group = at[hit], group[hit]
    # a group whose occurrences all have one symbol before them is within the group one position earlier
    before_low, before_high = np.minimum.reduceat(index.last, index.start), np.maximum.reduceat(index.last, index.start)
    first = np.unique(group)
    first = first[(before_low[first] != before_high[first]) | (before_low[first] == 0)]
    many = index.end[first] - index.start[first]
    rows = np.repeat(index.start[first] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(int(many.sum())) if len(first) else np.zeros(0, np.int64)
    members = np.unique(np.c_[np.repeat(first, many), of[rows]], axis=0) if len(rows) else np.zeros((0, 2), np.int64)
    at = np.unique(at)
    new = np.r_[True, np.diff(at) > 1] if len(at) else np.zeros(0, bool)
    a, z = at[new], at[np.r_[new[1:], True]] if len(at) else at
    which = np.searchsorted(begin, a, side="right") - 1
    from_idx = a - begin[which] + start[which]
    return members, np.c_[doc[which], from_idx, from_idx + (z - a) + least]


FOUND = "g1 long, g2 long, doc_id long, from_idx long, to_idx long"


def found_batch(g1: np.ndarray, g2: np.ndarray, doc: np.ndarray, spans: np.ndarray) -> pa.RecordBatch:
    """Members of groups (no bounds) and spans (no group)."""
    n, m = len(doc), len(spans)
    wide = lambda v, before, after: pa.array(np.r_[np.zeros(before, np.int64), v, np.zeros(after, np.int64)], mask=np.r_[np.ones(before, bool), np.zeros(len(v), bool), np.ones(after, bool)])
    return pa.RecordBatch.from_arrays(
        [wide(g1, 0, m), wide(g2, 0, m), pa.array(np.r_[doc, spans[:, 0]].astype(np.int64)), wide(spans[:, 1], n, 0), wide(spans[:, 2], n, 0)], names=["g1", "g2", "doc_id", "from_idx", "to_idx"]
    )


def shard_batches(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                pts = batch.column("regions")[k].values
                regions = merged_regions(np.asarray(pts.field("doc_id")), np.asarray(pts.field("start")), pts.field("text").to_pylist())
                members, spans = search_shard(regions, least)
                shard = batch.column("shard")[k].as_py()
                yield found_batch(np.full(len(members), shard), members[:, 0], members[:, 1], spans)

    return run


# ---------------------------------------------------------------- the whole


def cut_regions(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = least - gram
        for batch in batches:
            rows = {"shard": [], "doc_id": [], "start": [], "text": []}
            for doc, text, prints in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("prints").to_pylist()):
                for p in prints:
                    start = max(0, p["pos"] - reach)
                    rows["shard"].append(p["shard"])
                    rows["doc_id"].append(doc)
                    rows["start"].append(start)
                    rows["text"].append(text[start : p["pos"] + gram + reach])
            if rows["doc_id"]:
                yield pa.RecordBatch.from_arrays([pa.array(rows["shard"], pa.int64()), pa.array(rows["doc_id"], pa.int64()), pa.array(rows["start"], pa.int64()), pa.array(rows["text"], pa.string())], names=list(rows))

    return run


def cut_stretches(least: int, gram: int):
    """Documents with positions of hot fingerprints -> two hashes and the place of each stretch of ``least`` characters through one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Hasher(BASES[0]), Hasher(BASES[1])
        for batch in batches:
            for doc, text, prints in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("prints").to_pylist()):
                points = code_points(text)
                h1, h2 = one.grams(points, least).view(np.int64), two.grams(points, least).view(np.int64)
                at = np.array([p["pos"] for p in prints], np.int64)
                near = np.zeros(len(h1) + 1, np.int64)
                np.add.at(near, np.maximum(at - (least - gram), 0), 1)
                np.add.at(near, np.minimum(at + 1, len(h1)), -1)
                at = np.flatnonzero(np.cumsum(near[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(h1[at]), pa.array(h2[at]), pa.array(np.full(len(at), doc, np.int64)), pa.array(at)], names=["g1", "g2", "doc_id", "from_idx"])

    return run


class Shared:
    """Spans of at least ``least`` characters shared by documents: ``groups()``, ``pairs()`` and ``shares()``.

    ``documents``: ``doc_id`` (unique), ``text``. Null ids are dropped; null texts and texts shorter than ``least`` share nothing. Characters are code
    points and compared as they are. A span repeated only within one document is not shared.
    """

    def __init__(self, documents: DataFrame, least: int = LEAST, gram: int = GRAM, hot_regions: int = HOT_REGIONS, shard_chars: int = SHARD_CHARS) -> None:
        if not 0 < gram <= least:
            raise ValueError("a fingerprint must fit into the span")
        texts = documents.filter((F.length("text") >= least) & F.col("doc_id").isNotNull()).select("doc_id", F.sha2("text", 256).alias("text_key"), F.length("text").cast("long").alias("n"), "text")
        printed = cut_lineage(texts.mapInArrow(fingerprint_batches(least, gram), "doc_id long, text_key string, n long, prints array<struct<h: long, pos: long>>"))
        first = printed.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
        self.members = cut_lineage(salted_join(printed.select("doc_id", "text_key", "n"), first, ["text_key"], ["doc_id"]).select("doc_id", "rep", "copies", "n"))
        reps = self.members.filter("doc_id = rep").select("doc_id")
        prints = printed.join(reps, "doc_id", "left_semi").select("doc_id", F.inline("prints"))
        common = cut_lineage(prints.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("regions")).filter("a != b").select("h", "regions"))
        total, hottest = common.agg(F.sum(F.when(F.col("regions") <= hot_regions, F.col("regions"))), F.max("regions")).first()
        shards = max(1, -(-(total or 0) * (2 * least - gram) // shard_chars))
        shard = F.when(F.col("regions") <= hot_regions, F.pmod("h", F.lit(shards)))
        routed = cut_lineage(salted_join(prints, common.select("h", shard.alias("shard")), ["h"], ["doc_id", "pos"], counts=common.select("h", F.col("regions").alias("_n"))))
        whole = texts.select("doc_id", "text")
        regions = whole.join(self._per_doc(routed.filter("shard is not null")), "doc_id").mapInArrow(cut_regions(least, gram), "shard long, doc_id long, start long, text string")
        lists = regions.groupBy("shard").agg(F.collect_list(F.struct("doc_id", "start", "text")).alias("regions"))
        self.found = cut_lineage(lists.mapInArrow(shard_batches(least), FOUND))
        if (hottest or 0) > hot_regions:
            stretches = whole.join(self._per_doc(routed.filter("shard is null")), "doc_id").mapInArrow(cut_stretches(least, gram), "g1 long, g2 long, doc_id long, from_idx long")
            stretches = cut_lineage(stretches)
            several = stretches.groupBy("g1", "g2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a != b").select("g1", "g2")
            hot = salted_join(stretches, several, ["g1", "g2"], ["doc_id"])
            more = hot.select("g1", "g2", "doc_id").distinct().select("*", *[F.lit(None).cast("long").alias(c) for c in ("from_idx", "to_idx")])
            bare = hot.select(*[F.lit(None).cast("long").alias(c) for c in ("g1", "g2")], "doc_id", "from_idx", (F.col("from_idx") + least).alias("to_idx"))
            self.found = cut_lineage(self.found.unionByName(more).unionByName(bare))

    @staticmethod
    def _per_doc(routed: DataFrame) -> DataFrame:
        return routed.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "shard")).alias("prints"))

    def groups(self) -> DataFrame:
        """``g1, g2, doc_id``: groups of documents that all have one span in common, one document of each text.

        Two different texts share a span exactly where they are in a group together. A group is one span, so the same documents may be in several groups.
        """
        return self.found.filter("g1 is not null").select("g1", "g2", "doc_id").distinct()

    def copies(self) -> DataFrame:
        """``doc_id, rep``: each document that has enough text and the smallest id of those of the same text."""
        return self.members.select("doc_id", "rep")

    def pairs(self) -> DataFrame:
        """``doc_a, doc_b``, doc_a < doc_b: every pair of documents with a common span, copies included.

        As many rows as pairs: groups are cut into parts of about MEMBERS documents, and every part of a group meets every other.
        """
        linked = paired(self.groups().withColumnRenamed("doc_id", "m"), ["g1", "g2"]).distinct()
        several = self.members.filter("copies > 1")
        parts = F.ceil(F.col("copies") / MEMBERS)
        many = several.select("rep", "doc_id", F.pmod(F.xxhash64("doc_id"), parts).alias("part"))
        sizes = self.members.filter("doc_id = rep").select("rep", parts.alias("parts"), "copies")
        # a text of many copies is taken part by part
        sides = linked
        for end, name in (("a", "doc_a"), ("b", "doc_b")):
            size = sizes.select(F.col("rep").alias(end), "parts", "copies")
            cut = sides.join(size, end).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            own = many.select(F.col("rep").alias(end), "part", F.col("doc_id").alias(name))
            sides = cut.join(own, [end, "part"], "left").withColumn(name, F.coalesce(name, end)).drop("parts", "part", "copies")
        inside = paired(several.select("rep", F.col("doc_id").alias("m")), ["rep"])
        return sides.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b")).unionByName(inside.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b")))

    def shares(self) -> DataFrame:
        """``doc_id, n_chars, shared_chars, share`` of every document that shares a span; a document with a copy is shared whole."""
        spans = self.found.filter("g1 is null").select(F.col("doc_id").alias("rep"), "from_idx", "to_idx").distinct()
        # a document's spans are no more than its characters
        order = Window.partitionBy("rep").orderBy("from_idx", "to_idx")
        reached = F.max("to_idx").over(order.rowsBetween(Window.unboundedPreceding, -1))
        fresh = F.greatest(F.lit(0), F.col("to_idx") - F.greatest("from_idx", F.coalesce(reached, F.lit(0))))
        covered = spans.withColumn("fresh", fresh).groupBy("rep").agg(F.sum("fresh").alias("covered"))
        rows = salted_join(self.members, covered, ["rep"], ["doc_id"], "left").filter("covered is not null or copies > 1")
        chars = F.when(F.col("copies") > 1, F.col("n")).otherwise(F.col("covered"))
        return rows.select("doc_id", F.col("n").alias("n_chars"), chars.alias("shared_chars"), (chars / F.col("n")).alias("share"))


def paired(rows: DataFrame, group: list[str]) -> DataFrame:
    """``a, b``, a < b: all pairs of different ``m`` within a group; a large group is cut into parts, so no task makes all of its pairs."""
    sized = cut_lineage(rows.groupBy(*group).agg(F.count("*").alias("n")).filter(F.col("n") > MEMBERS))
    if sized.isEmpty():
        cut = rows.withColumn("parts", F.lit(1).cast("long"))
    else:
        cut = salted_join(rows, sized, group, ["m"], "left").withColumn("parts", F.ceil(F.coalesce("n", F.lit(1)) / MEMBERS)).drop("n")
    cut = cut.withColumn("part", F.pmod(F.xxhash64("m"), F.col("parts")))
    a = cut.select(*group, F.col("m").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("part").alias("own"))
    b = cut.select(*group, F.col("m").alias("b"), "part", "parts")
    # (own, part) and (part, own) are the same two parts: either end may be the smaller id
    return a.join(b, [*group, "part"]).filter("a < b").select("a", "b")
