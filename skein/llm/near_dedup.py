"""Order MinHash near-duplicate classes.

Exact copies are folded by text hash.  Of each text, several sketches keep the
``L`` smallest occurrence-labelled ``K``-word k-mers under one hash function each, in
text order; texts that share a sketch are candidates.  A candidate pair is
verified by banded alignment of its words: aligned words / words of the longer
text, and 0.8 or more makes a link.  Classes are the connected components.  The
k-mers only find candidates and are shorter than a five-word shingle on purpose:
one changed word breaks ``K`` of them, and links are promised down to one word in
five changed anywhere.  ``test_recall_by_band`` holds the share of such pairs that
meet in a sketch; it is in the README.

Within a sketch bucket every member meets up to ``PIVOTS`` members, each of least
priority by one hash, so the pairs grow with the bucket, not its square; where at
most one member is no pivot, that is everyone.  Another bucket is settled once its
members are in one class, as further links could not change the classes.  In what
is left, all members of different classes are screened in blocks by their sizes and
counted words, which bound the alignment from above, and the pairs that may pass are
verified.  So every pair that shares a sketch is compared, or ruled out by an exact
bound, or in one class already.  The screening is quadratic in such a bucket, without
emitting its pairs: a search by rare words was tried and makes more rows, as texts
that share a passage share its words.

Hot keys: bucket, pivot and class joins read written tables by sort-merge, which
adaptive execution splits; sums by key combine before the shuffle.

Defined results: null texts count as empty, and empty texts are copies of each
other; words are runs of letters, digits and underscores, lower-cased; texts of
under ``K`` words are one k-mer; texts are classed by what they say, so different
texts under one doc_id are separate, and the one of least hash stands for the id;
the others, and texts without an id, represent a class only if it has no such
text; their classes have a null class_id; repeated rows give repeated results;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exprs import text_of
from .scratch import Scratch

K = 3
L = 2
SKETCHES = 40
THRESHOLD = 0.8
PIVOTS = 3
#: Members of one block, and bins of their counted words.
BLOCK = 512
BINS = 2048
WORD = re.compile(r"\w+")
GOLD = np.uint64(0x9E3779B97F4A7C15)
LAST = np.uint64(2**64 - 1)
_rng = np.random.default_rng(20240229)
MUL = _rng.integers(1, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, SKETCHES, dtype=np.uint64)
#: Elements of the sketch matrix worked on at once; longer texts go through in slices of sketches.
CELLS = 1_000_000
#: Bytes that are in words stay: ASCII letters, digits, underscores, and all of the characters beyond ASCII that are left.
IN_WORD = bytes(i if i > 127 or chr(i).isalnum() or i == 95 else 0 for i in range(256))
#: Bytes of ASCII and of U+00C0 to U+02BF, which are letters but for the signs of times and division.
PLAIN = bytes([*range(0xC0), *range(0xC3, 0xCB)])
NO_WORD = re.compile(r"[^\w\x00-\x7f]+")
#: An odd base of the running sums and its inverse modulo 2 ** 64; bytes summed at once; bytes of words that are hashed alone.
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
SLICE = 1 << 20
LONG_WORD = 4096


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def powers(base: int, n: int, _held: dict = {}) -> np.ndarray:  # noqa: B006
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    if len(_held.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _held[base] = np.multiply.accumulate(out)
    return _held[base][:n]


def plain_bytes(text: str, mark: str = " ") -> bytes:
    """The lower-cased text in UTF-8, with ``mark`` for runs of characters beyond ASCII that are in no word."""
    low = text.lower()
    data = low.encode("utf-8", "surrogatepass")
    if data.translate(None, PLAIN) or b"\xc3\x97" in data or b"\xc3\xb7" in data:
        data = NO_WORD.sub(mark, low).encode("utf-8", "surrogatepass")
    return data


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of ``words_of(text)``."""
    return word_places(plain_bytes(text))[1]


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte places and 64-bit hashes of the words of ``plain_bytes``, from sums of bytes times powers of ``BASE``.

    A byte tells whether it is in a word.  Words of over ``LONG_WORD`` bytes are
    hashed alone.
    """
    # bytes of no word are 0 from here on
    data = data.translate(IN_WORD)
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = raw
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    out = np.empty(len(start), np.uint64)
    long_ = np.append(np.flatnonzero(end - start > LONG_WORD), len(start))
    i = 0
    while i < len(start):
        next_long = long_[np.searchsorted(long_, i)]
        if i == next_long:
            out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]])
            i += 1
            continue
        j = min(int(next_long), max(i + 1, int(np.searchsorted(end, start[i] + SLICE, "right"))))
        a, n = int(start[i]), int(end[j - 1] - start[i])
        at = start[i:j] - a
        out[i:j] = np.add.reduceat(raw[a : a + n] * powers(BASE, n), at) * powers(INVERSE, n)[at]
        i = j
    return start, mix(out + (end - start).astype(np.uint64) * GOLD)


def occurrences(h: np.ndarray) -> np.ndarray:
    """Hashes with the number of their earlier occurrences mixed in, so that all are distinct."""
    sorted_ = np.sort(h)
    twice = sorted_[1:][sorted_[1:] == sorted_[:-1]]
    if not len(twice):
        return h
    at = np.flatnonzero(np.isin(h, twice))
    order = at[np.argsort(h[at], kind="stable")]
    new = np.append(True, h[order][1:] != h[order][:-1])
    starts = np.flatnonzero(new)
    seen = (np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))).astype(np.uint64)
    out = h.copy()
    out[order] = np.where(seen > 0, mix(h[order] + seen * GOLD), h[order])
    return out


def kmers(w: np.ndarray) -> np.ndarray:
    """Occurrence-labelled hashes of the ``K``-word k-mers of word hashes, in text order, all distinct."""
    if not len(w):
        return w
    n = max(1, len(w) - K + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(K, len(w))):
        h = mix(h * GOLD + w[j : j + n])
    return occurrences(h)


def sketch(h: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key a sketch."""
    n = len(h)
    if n == 0:
        return np.empty(0, np.int64)
    keys = np.empty(SKETCHES, np.uint64)
    step = max(1, CELLS // n)
    take = min(L, n)
    for s in range(0, SKETCHES, step):
        e = min(SKETCHES, s + step)
        # the k-mers are hashes already: one product gives each sketch its order
        v = (h[None, :] ^ ADD[s:e, None]) * MUL[s:e, None]
        at = np.empty((e - s, take), np.int64)
        rows = np.arange(e - s)
        for c in range(take):
            # a few passes for the minimum cost less than a partition
            at[:, c] = v.argmin(axis=1)
            v[rows, at[:, c]] = LAST
        at.sort(axis=1)
        chosen = h[at]
        k = np.full(e - s, np.uint64(1)) + np.arange(s, e, dtype=np.uint64) * GOLD
        for c in range(take):
            k = mix(k * GOLD + chosen[:, c])
        keys[s:e] = k
    return keys.view(np.int64)


def shared_words(a: Counter, b: Counter) -> int:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return sum(min(n, large[w]) for w, n in small.items() if w in large)


def aligned(a: list, b: list, threshold: float = THRESHOLD, bag: Counter | None = None) -> float:
    """Aligned words / words of the longer text, by banded alignment; 0 below the threshold.

    At the threshold each side has (1 - threshold) * longer unaligned words at most,
    so aligned places lie no further apart: the band loses no pair that passes.
    The alignment is the longest common subsequence, a row of it one big integer.
    ``bag`` holds the counted words of ``a``, where they are at hand.
    """
    longer = max(len(a), len(b))
    need = threshold * longer - 1e-9
    if not longer or min(len(a), len(b)) < need:
        return 0.0
    if shared_words(bag or Counter(a), Counter(b)) < need:
        return 0.0
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    same = head + tail
    if x and y:
        at: dict = {}
        for i, w in enumerate(x):
            at[w] = at.get(w, 0) | (1 << i)
        band = int((1 - threshold) * longer) + 1
        full = (1 << len(x)) - 1
        window, row = (1 << (2 * band + 1)) - 1, full
        for j, w in enumerate(y):
            m = at.get(w, 0)
            if m:
                u = row & m & (window << (j - band) if j >= band else window >> (band - j))
                row = ((row + u) | (row - u)) & full
        same += len(x) - row.bit_count()
    return same / longer if same >= need else 0.0


def text_key(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()


def sketch_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keys, sizes, bands = [], [], []
        for t in b["text"]:
            keys.append(text_key(t))
            words = word_hashes(t)
            sizes.append(len(words))
            bands.append(np.unique(sketch(kmers(words))))
        yield pd.DataFrame({"id": b["id"], "th": keys, "size": sizes, "bands": bands})


def verify_batches(batches: Iterator[pd.DataFrame], threshold: float = THRESHOLD) -> Iterator[pd.DataFrame]:
    """(a, b, sim) of each pair; sim is 0 where there is no link."""
    for b in batches:
        last_text, last, bag = None, [], Counter()
        sims = np.zeros(len(b))
        for i, (ta, tb) in enumerate(zip(b["ta"], b["tb"], strict=True)):
            if ta != last_text:
                last_text, last = ta, word_hashes(ta).tolist()
                bag = Counter(last)
            sims[i] = aligned(last, word_hashes(tb).tolist(), threshold, bag)
        yield pd.DataFrame({"a": b["a"], "b": b["b"], "sim": sims})


def bag_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Word count of each text, and its words counted in ``BINS`` bins by hash; null where 16 bits do not hold them."""
    for b in batches:
        sizes, bags = [], []
        for t in b["text"]:
            words = word_hashes(t)
            n = np.bincount((words % np.uint64(BINS)).astype(np.int64), minlength=BINS)
            sizes.append(len(words))
            bags.append(n.astype("<u2").tobytes() if len(words) < 65_536 else None)
        yield pd.DataFrame({"node": b["node"], "size": sizes, "bag": bags})


def screen(block: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """Pairs (a, b) across classes of one pair of blocks that size and counted words do not rule out.

    Words in one bin can only raise the common count, so no link is screened off.  Of
    the open buckets that two texts share (``mine`` holds each one's), the least makes
    the pair.
    """
    bucket = block["bucket"].iat[0]
    mine = {n: frozenset(m) for n, m in zip(block["node"], block["mine"], strict=True)}
    block = block.sort_values("node")
    first = block[block["block"] == block["low"]]
    second = block[block["block"] == block["high"]]
    same = block["low"].iat[0] == block["high"].iat[0]
    node, label, size = (second[c].to_numpy() for c in ("node", "label", "size"))
    bags = np.zeros((len(second), BINS), np.uint16)
    known = second["bag"].notna().to_numpy()
    for i in np.flatnonzero(known):
        bags[i] = np.frombuffer(second["bag"].iat[i], "<u2")
    out: list[tuple[int, int]] = []
    for x, lx, n, bag in zip(first["node"], first["label"], first["size"], first["bag"], strict=True):
        ok = (label != lx) & (np.minimum(size, n) >= threshold * np.maximum(size, n) - 1e-9)
        if same:
            ok &= node > x
        at = np.flatnonzero(ok)
        if len(at) and bag is not None:
            common = np.minimum(bags[at], np.frombuffer(bag, "<u2")).sum(axis=1, dtype=np.int64)
            at = at[(common >= threshold * np.maximum(size[at], n) - 1e-9) | ~known[at]]
        out += [(min(x, y), max(x, y)) for y in node[at].tolist() if min(mine[x] & mine[y]) == bucket]
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def screened_pairs(open_: DataFrame, texts: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of different classes in a bucket of ``open_`` (bucket, n, node, label) that a bound on their common words lets through.

    Members meet in blocks of ``BLOCK``; each pair of blocks is a task's work of its own.
    """
    bags = scratch.write(texts.join(open_.select("node").distinct(), "node", "left_semi").mapInPandas(bag_batches, "node long, size int, bag binary"))
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    # a text has SKETCHES buckets at most
    shared = open_.groupBy("node").agg(F.collect_set("bucket").alias("mine"))
    dealt = open_.join(bags.join(shared, "node"), "node").withColumn("block", F.pmod(F.xxhash64("node"), n_blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1))).select("bucket", "node", "label", "size", "bag", "mine", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return scratch.write(dealt.groupBy("bucket", "low", "high").applyInPandas(lambda g: screen(g, threshold), "a long, b long").distinct())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every linked node; label is the least node of its component.

    Alternating large-star and small-star rounds on written tables until the edges
    are stars: each round sends a label two hops on, and no neighbour list is ever
    collected, as only minima are.
    """

    def star(e: DataFrame) -> tuple[int, int]:
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    edges = scratch.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = star(edges)
    while True:
        # large star: of each node, all larger neighbours to the least of itself and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: each node and its smaller neighbours to the least of them
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        new = scratch.write(small)
        new_state = star(new)
        scratch.drop(edges)
        scratch.drop(least)
        edges = new
        if new_state == state:
            break
        state = new_state
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, th, label, n_copies, n_links, kept: one row for each row of ``docs``.

    ``class_id`` is the doc_id of the class's representative, the least that stands
    for a text of the class; ``label`` names every class; ``th`` is the text's MD5.
    ``n_copies`` counts the rows with this very text, ``n_links`` the other texts
    that the verification linked to it.  Rows with ``kept`` are the representative.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    sketched = scratch.write(rows.mapInPandas(sketch_batches, "id long, th string, size int, bands array<long>"))
    texts = sketched.groupBy("th").agg(F.min("id").alias("first"), F.count("*").alias("n_copies"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands"))
    texts = scratch.write(texts)
    # of several texts with one least id, one has it as its node; the others and those without an id have a hash above all ids
    again = scratch.write(texts.groupBy("first").agg(F.count("*").alias("n"), F.min("th").alias("least")).filter("n > 1 AND first IS NOT NULL").select(F.col("first").alias("_f"), "least"))
    hashed = F.conv(F.substring("th", 1, 15), 16, 10).cast("long") + F.lit(1 << 61)
    plain = F.coalesce(F.col("first"), hashed)
    node = plain if again.isEmpty() else F.when(F.col("least") != F.col("th"), hashed).otherwise(plain)
    named_texts = texts if again.isEmpty() else texts.join(again, F.col("first") == F.col("_f"), "left")
    named_texts = named_texts.select("th", "first", "n_copies", "size", "bands", node.alias("node"))
    members = named_texts.select("node", "size", F.explode("bands").alias("bucket"))
    own = named_texts.select("th", "node", "first", "n_copies")

    picks = [F.min_by(F.struct("node", "size"), F.xxhash64(F.lit(j), "node")).alias(f"p{j}") for j in range(PIVOTS)]
    per = members.groupBy("bucket").agg(F.count("*").alias("n"), *picks).filter("n > 1").select("bucket", "n", F.array_distinct(F.array(*[f"p{j}" for j in range(PIVOTS)])).alias("pivots"))
    per = scratch.write(per)
    met = scratch.write(members.join(per.hint("merge"), "bucket").select("bucket", "n", "node", "size", "pivots"))
    scratch.drop(per)

    # the texts that share a sketch with any other, once
    wanted = scratch.write(met.select("node").distinct().join(own, "node").select("node", F.col("th").alias("_t"), "first"))
    with_id = rows.join(wanted.filter("first IS NOT NULL"), F.col("id") == F.col("first")).filter(F.md5("text") == F.col("_t")).select("node", "text")
    lone = rows.filter("id IS NULL").join(wanted.filter("first IS NULL"), F.md5("text") == F.col("_t")).select("node", "text")
    met_texts = scratch.write(with_id.unionByName(lone).dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        left = pairs.join(met_texts.select(F.col("node").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
        both = left.join(met_texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).hint("merge"), "a").select("a", "b", "ta", "tb")
        return scratch.write(both.mapInPandas(lambda batches: verify_batches(batches, threshold), "a long, b long, sim double"))

    # texts of too different sizes cannot align
    close = F.least("size", "p.size") >= threshold * F.greatest("size", "p.size") - 1e-9
    asked = scratch.write(met.select("node", "size", F.explode("pivots").alias("p")).filter("node <> p.node").filter(close).select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct())
    known = verified(asked)
    labels = scratch.write(components(known.filter("sim > 0").select("a", "b"), scratch))
    named = scratch.write(met.filter(F.size("pivots") < F.col("n") - 1).select("bucket", "n", "node").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node")))
    several = scratch.write(named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket"))
    open_ = scratch.write(named.join(several.hint("merge"), "bucket", "left_semi"))
    if not open_.isEmpty():
        found = scratch.write(screened_pairs(open_, met_texts, scratch, threshold).join(known.select("a", "b"), ["a", "b"], "left_anti"))
        if not found.isEmpty():
            more = verified(found)
            known = scratch.write(known.unionByName(more))
            # the classes so far are stars already; only new links join them
            links = more.filter("sim > 0").select("a", "b").unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
            labels = scratch.write(components(links, scratch))
    for t in (met_texts, met, named, open_):
        scratch.drop(t)

    links = known.filter("sim > 0")
    n_links = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    classed = own.join(labels, "node", "left").join(n_links, "node", "left").select(
        F.col("th").alias("_t"), "node", "first", F.coalesce("label", "node").alias("label"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
    classed = scratch.write(classed)
    out = sketched.select("id", "th").join(classed.hint("merge"), F.col("th") == F.col("_t"))
    class_id = F.when(F.col("label") < (1 << 61), F.col("label"))
    kept = (F.col("node") == F.col("label")) & F.col("id").eqNullSafe(F.col("first"))
    return out.select(F.col("id").alias("doc_id"), class_id.alias("class_id"), "th", "label", "n_copies", "n_links", kept.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).drop("th", "label")
