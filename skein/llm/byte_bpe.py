"""Byte-level BPE encoding and decoding of whole texts.

Texts up to ``CHUNK`` code points are one chunk.  Longer ones are cut into
overlapping chunks that are pre-tokenised in parallel.  The pattern looks ahead
only, so the pre-tokens from a boundary on do not depend on what is before it:
where a pre-token of the next chunk starts at a boundary that this chunk agrees on,
both go on alike.  Neighbours are stitched at the first such boundary in their
overlap, the pieces between stitches are encoded in parallel, each with the text
behind it at hand for what the pattern looks ahead to, and their ids are joined.
Neighbours that agree nowhere, as inside one very long pre-token, are one piece
together; the rest of the text is not.  Decoding concatenates the raw bytes of the
ids.

Defined results: a null text is empty and has no ids; repeated rows give repeated
results; rows with one doc_id are encoded each by its own text; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exprs import text_of
from .scratch import Scratch

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK = 32_768
OVERLAP = 2_048
#: The longest contraction of the pattern and one character to look ahead.
LOOK = 4


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file; one a worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def pre_tokens():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def encode_text(text: str, path: str) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.array(encoding(path).encode_ordinary(text), "<u4").tobytes()


def decode_ids(ids: bytes, path: str) -> bytes:
    return encoding(path).decode_bytes(np.frombuffer(ids, "<u4").tolist())


def starts_of(text: str) -> list[int]:
    return [m.start() for m in pre_tokens().finditer(text)]


def boundaries(text: str, own: int, overlap: int = OVERLAP) -> tuple[list[int], list[int]]:
    """Boundaries in a chunk's head, and in its overlap as places of the next chunk; ``own`` is its length without the overlap.

    Within ``LOOK`` of the chunk's end a match may be another than in the whole text.
    """
    starts = starts_of(text)
    return [p for p in starts if p < overlap], [p - own for p in starts if own <= p <= len(text) - LOOK]


def encode_part(text: str, upto: int, path: str) -> bytes:
    """Ids of the pre-tokens of ``text`` that start before ``upto``, where one starts; what is behind is only looked at."""
    part = text[:upto]
    if upto < len(text):
        inside = [m.span() for m in pre_tokens().finditer(text, 0) if m.start() < upto]
        if [s for s, _ in inside] != starts_of(part) or (inside and inside[-1][1] != upto):
            # cut off from what follows, the end of the part would fall apart otherwise
            ids = [i for s, e in inside for i in encoding(path)._encode_single_piece(text[s:e].encode("utf-8", "surrogatepass"))]
            return np.array(ids, "<u4").tobytes()
    return encode_text(part, path)


def chunk_rows(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, i, own, text of the overlapping chunks of each text."""
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    cut = docs.select("key", parts.alias("parts"))
    both = F.transform("parts", lambda c, i: F.struct(F.length(c).alias("own"), F.concat(c, F.substring(F.coalesce(F.get(F.col("parts"), i + 1), F.lit("")), 1, overlap)).alias("text")))
    return cut.select("key", F.posexplode(both).alias("i", "c")).select("key", "i", "c.own", "c.text")


def _digest(doc_ids, pieces, path: str) -> pd.DataFrame:
    dec = [decode_ids(x, path) for x in pieces]
    return pd.DataFrame(
        {
            "key": doc_ids,
            "n_tokens": [len(x) // 4 for x in pieces],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in pieces],
            "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in dec],
        }
    )


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_whole(docs: DataFrame, path: str) -> DataFrame:
    """(key, text) encoded text by text: digests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _digest(b["key"], [encode_text(t, path) for t in b["text"]], path)

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "text").mapInPandas(run, f"key {kind}, {DIGEST}")


def encode_long(docs: DataFrame, path: str, scratch: Scratch, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, text), keys distinct, by overlapping chunks: key, ids."""
    rows = scratch.write(chunk_rows(docs, chunk, overlap).repartition("key", "i"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [boundaries(t, n, overlap) for t, n in zip(b["text"], b["own"], strict=True)]
            yield pd.DataFrame({"key": b["key"], "i": b["i"], "heads": [x[0] for x in found], "tails": [x[1] for x in found]})

    seen = scratch.write(rows.mapInPandas(scan, "key string, i int, heads array<int>, tails array<int>"))
    before = seen.select("key", (F.col("i") + 1).alias("i"), "tails")
    cuts = seen.select("key", "i", "heads").join(before, ["key", "i"]).select("key", "i", F.array_min(F.array_intersect("heads", "tails")).alias("cut"))
    cuts = scratch.write(cuts)
    nexts = cuts.select("key", (F.col("i") - 1).alias("i"), F.col("cut").alias("next_cut"), F.lit(True).alias("more"))
    # a chunk's part runs from its stitch to the next one's; without a stitch it belongs to the part before
    parts = rows.join(cuts, ["key", "i"], "left").join(nexts, ["key", "i"], "left").withColumn("more", F.coalesce("more", F.lit(False)))
    lost_before, lost_behind = F.col("cut").isNull() & (F.col("i") > 0), F.col("next_cut").isNull() & F.col("more")
    from_ = F.coalesce("cut", F.lit(0))
    upto = F.when(F.col("more") & F.col("next_cut").isNotNull(), F.col("own") + F.col("next_cut")).otherwise(F.col("own")) - from_
    # where the next chunk belongs to this part, its text follows on, so the overlap is left out
    text = F.when(lost_behind, F.substring("text", from_ + 1, F.col("own") - from_)).otherwise(F.substring("text", from_ + 1, F.length("text")))
    parts = parts.select("key", "i", text.alias("text"), upto.alias("upto"), lost_before.alias("lost_before"), lost_behind.alias("lost_behind"))
    alone = parts.filter("NOT lost_before AND NOT lost_behind").select("key", "i", "text", "upto")
    # runs of chunks that agree nowhere
    lost = scratch.write(parts.filter("lost_before OR lost_behind"))
    w = Window.partitionBy("key").orderBy("i")
    run = F.sum(F.when(F.col("lost_before"), 0).otherwise(1)).over(w)
    merged = lost.withColumn("run", run).groupBy("key", "run").agg(F.array_sort(F.collect_list(F.struct("i", "text", "upto"))).alias("p"))
    merged = merged.select("key", F.array_min("p.i").alias("i"), F.array_join("p.text", "").alias("text"), F.aggregate("p.upto", F.lit(0), lambda s, x: s + x).alias("upto"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "i": b["i"], "ids": [encode_part(t, n, path) for t, n in zip(b["text"], b["upto"], strict=True)]})

    done = alone.unionByName(merged).mapInPandas(encode, "key string, i int, ids binary")
    # the ids of one text, no more, meet in one group
    return done.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("p")).select("key", F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"))


def digest_ids(df: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _digest(b["key"], list(b["ids"]), path)

    return df.mapInPandas(run, f"key string, {DIGEST}")


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row for each row of ``docs``."""
    path = path or vocabulary_path()
    scratch = Scratch(docs.sparkSession, "byte-bpe")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    short = encode_whole(rows.filter(F.length("text") <= CHUNK).select(F.col("doc_id").alias("key"), "text"), path).withColumnRenamed("key", "doc_id")
    long_ = rows.filter(F.length("text") > CHUNK).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    done = digest_ids(encode_long(long_.select("key", "text").dropDuplicates(["key"]), path, scratch), path)
    return short.unionByName(long_.select("doc_id", "key").join(done, "key").drop("key"))


def query(spark, sf_dir: str) -> DataFrame:
    return encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
