"""Cross-entropy difference of two matched n-gram models.

Tokens are words and single ASCII marks, lower-cased (other marks: a run of them is
one); a token's class is its hash in ``VOCAB``, so both models share one closed vocabulary and no token is unknown.
Unigrams and bigrams (in ``CELLS`` hashed cells) of the target documents and of all
documents are counted over the whole corpus.  The models are matched: background
counts are scaled to the target's mass, and both back off from bigram to unigram to
uniform with the same pseudo-counts, so what neither has seen often costs the same.
A document is scored held out: its own counts are taken from the background, and
from the target model if it is a target.  Its score is its mean loss per token
under the target model less that under the background: the lower, the closer to the
target.

What is gathered grows with the corpus up to ``VOCAB`` + ``CELLS`` cells, which
bounds what the driver and each worker hold; beyond, rare bigrams share cells.

Defined results: null texts count as empty; a text without tokens has null losses
and score; labels that repeat count once, and a document is a target if any of its
labels says so; rows with one doc_id are targets together, each held out by itself;
a null doc_id is no target; without targets every score is 0; repeated rows give
repeated results; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exprs import text_of
from .near_dedup import GOLD, mix, plain_bytes, word_places

#: Bytes that are tokens of their own.
IS_MARK = bytes(i == 1 or 32 < i < 127 and not chr(i).isalnum() and i != 95 for i in range(256))
VOCAB = 1 << 18
CELLS = 1 << 23
#: The class that starts and ends each text.
EDGE = VOCAB
SIZE = VOCAB + 1 + CELLS
#: Pseudo-counts of the unigram behind a bigram, and of each class behind a unigram; chosen on held-out labels.
BIGRAM_PRIOR = 32.0
UNIGRAM_PRIOR = 0.01
#: Target ids up to so many (16 MB) go to every task; more are joined by a shuffle of both sides.
BROADCAST_IDS = 2_000_000
#: Grams counted in one step.
STEP = 8_000_000


def token_hashes(text: str) -> np.ndarray:
    data = plain_bytes(text, "\x01")
    start, hashes = word_places(data)
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(np.frombuffer(data.translate(IS_MARK), np.uint8))
    both = np.concatenate((hashes, mix(raw[at].astype(np.uint64) * GOLD)))
    return both[np.argsort(np.concatenate((start, at)), kind="stable")]


def grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each token and of the end, of the one before each, and the cell of both."""
    hashes = token_hashes(text)
    w = np.empty(len(hashes) + 1, np.int64)
    w[:-1] = hashes % np.uint64(VOCAB)
    w[-1] = EDGE
    h = np.empty_like(w)
    h[0], h[1:] = EDGE, w[:-1]
    x = (h.astype(np.uint64) * np.uint64(VOCAB + 1) + w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return w, h, VOCAB + 1 + ((x ^ (x >> np.uint64(29))) % np.uint64(CELLS)).astype(np.int64)


def count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, n) sums of steps of one task; a key is twice a cell, and one more for a target's."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pd.DataFrame:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pd.DataFrame({"key": keys, "n": n})

    for b in batches:
        for text, target in zip(b["text"], b["target"], strict=True):
            w, _, cell = grams(text)
            if len(w) == 1:
                continue
            held.append((2 * np.concatenate((w, cell)) + int(bool(target))).astype(np.int32))
            size += 2 * len(w)
            if size >= STEP:
                yield flush()
                size = 0
    if held:
        yield flush()


@dataclass(frozen=True)
class Model:
    """Counts by cell of the target and of all documents."""

    target: np.ndarray
    background: np.ndarray

    @property
    def masses(self) -> tuple[float, float]:
        return tuple(float(c[: VOCAB + 1].sum(dtype=np.float64)) for c in (self.target, self.background))


def log_probs(uni: np.ndarray, hist: np.ndarray, both: np.ndarray, mass: float) -> np.ndarray:
    """ln p of each token by its counts: of the class, of the class before, and of the two together."""
    low = (uni + UNIGRAM_PRIOR) / (mass + UNIGRAM_PRIOR * (VOCAB + 1))
    return np.log((both + BIGRAM_PRIOR * low) / (hist + BIGRAM_PRIOR))


def losses(text: str, target: bool, model: Model, masses: tuple[float, float]) -> tuple[int, float, float]:
    """Tokens, and the summed loss under either model, the text's own counts taken out."""
    w, h, cell = grams(text)
    if len(w) == 1 or not masses[0]:
        return len(w) - 1, 0.0, 0.0

    def own(x: np.ndarray) -> np.ndarray:
        _, back, n = np.unique(x, return_inverse=True, return_counts=True)
        return n[back]

    ow, oc = own(w), own(cell)
    # every token but the end is a class before another, and the edge comes before the first
    oh = np.empty_like(ow)
    oh[0], oh[1:] = 1, ow[:-1]
    n = len(w)
    out = []
    for counts, mine, mass, scale in ((model.target, target, masses[0], 1.0), (model.background, True, masses[1], masses[0] / masses[1])):
        k = float(mine)
        uni, hist, both = (np.maximum(counts[at].astype(np.float64) - k * o, 0.0) * scale for at, o in ((w, ow), (h, oh), (cell, oc)))
        # shared cells can hold more than either class does
        out.append(-float(log_probs(uni, hist, np.minimum(both, hist), max(mass - k * n, 0.0) * scale).sum()))
    return n - 1, out[0], out[1]


def marked(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, target of each row."""
    ids = targets.select(F.col(id_col).cast("long").alias("_t")).filter("_t IS NOT NULL").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    # labels can grow with the corpus: only a counted, bounded set is broadcast, which spares the texts a shuffle
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids.hint("merge"), F.col("id") == F.col("_t"), "left").select("id", "text", F.col("_t").isNotNull().alias("target"))


def fit(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts of both models; ``targets`` has the ids of the target documents in ``id_col``."""
    counted = marked(docs, targets, id_col, text_col).select("text", "target").mapInPandas(count_batches, "key int, n long")
    # 2 * SIZE rows of 8 bytes at most
    table = counted.groupBy("key").agg(F.sum("n").cast("float").alias("n")).toArrow()
    key, n = table["key"].to_numpy(), table["n"].to_numpy()
    del table
    out = np.zeros((2, SIZE), np.float32)
    mine = key % 2 == 1
    out[0, key[mine] // 2] = n[mine]
    out[1, key[~mine] // 2] = n[~mine]
    out[1] += out[0]
    return Model(out[0], out[1])


def score(docs: DataFrame, model: Model, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score (nats a token)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.target, model.background))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        masses = own.masses
        for batch in batches:
            got = [losses(x, t, own, masses) for x, t in zip(batch["text"], batch["target"], strict=True)]
            n = np.array([g[0] for g in got], float)
            mean = lambda k: np.divide([g[k] for g in got], n, out=np.full(len(got), np.nan), where=n > 0)
            out = pd.DataFrame({"doc_id": batch["id"].astype("Int64"), "n_tokens": n.astype(np.int64), "loss_target": mean(1), "loss_background": mean(2)})
            out["score"] = out["loss_target"] - out["loss_background"]
            yield out

    scored = marked(docs, targets, id_col, text_col).mapInPandas(run, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")
    return scored.select("doc_id", "n_tokens", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("loss_target", "loss_background", "score")])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
    return score(docs, fit(docs, good), good)
