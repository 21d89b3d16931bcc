"""Token counts of fields and sections by offset-mapped attribution.

A whole document is encoded once. Every token knows the characters it covers in the document;
tokens and sections (character intervals) are joined by interval, and each token is allocated:

* to the section that holds most of its characters;
* on a tie, to the section that starts first (then to the one given first);
* to no section if no section holds one of its characters.

A token that more than one section touches counts as crossing in the section it goes to. So
the counts of sections that cover a document add up to the document's count, which counting
sections by themselves doesn't give.

Pre-tokens are encoded each once per worker; the offsets of their tokens, from the tokens' bytes,
are remembered and laid out along the document.

Defined results: null and empty texts have no tokens, sections and rows; empty sections and
sections outside of the text get 0 tokens; several tokens that share one character (bytes of one
code point) each cover that character; repeated rows come back each; extra columns stay out.
"""

from __future__ import annotations

import base64
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm.common import remember_only, remembers, small_batches, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Distinct pre-tokens a worker remembers before it starts anew.
CACHE = 400_000
MAX_MODEL_BYTES = 64 << 20

_SECTIONS = "array<struct<section:int,start:int,end:int,n_tokens:bigint,n_crossing:bigint>>"


class _Offsets(dict):
    """Pre-token -> (start, end) of each token relative to it, packed as unsigned 32-bit integers."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.sizes = {i: len(t) for t, i in ranks.items()}
        self.find = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        ends = list(itertools.accumulate(map(self.sizes.__getitem__, self.encode(piece))))
        starts = [0, *ends[:-1]]
        if not piece.isascii():  # bytes to characters: a token covers every character that it has a byte of
            at = list(itertools.chain.from_iterable(itertools.repeat(k, len(c.encode())) for k, c in enumerate(piece)))
            starts, ends = [at[x] for x in starts], [at[x - 1] + 1 for x in ends]
        out = struct.pack(f"<{2 * len(ends)}I", *itertools.chain.from_iterable(zip(starts, ends, strict=True)))
        if len(self) >= CACHE:
            self.clear()
        if len(piece) <= 64:
            self[piece] = out
        return out

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends (characters) of the tokens of a text."""
        pieces = self.find(text)
        found = list(map(self.__getitem__, pieces))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = np.fromiter(map(len, found), np.int64, len(pieces)) >> 3
        base = np.repeat(np.cumsum(sizes) - sizes, counts)
        both = np.frombuffer(b"".join(found), np.uint32).reshape(-1, 2)
        return both[:, 0] + base, both[:, 1] + base


def allocated(starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section, by the rule above. Sections may overlap."""
    n, crossing = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
    if not len(lo) or not len(starts):
        return n, crossing
    order = np.lexsort((np.arange(len(lo)), lo))
    slo, shi = lo[order], hi[order]
    if (slo[1:] >= np.maximum.accumulate(shi)[:-1]).all():
        full = shi > slo  # empty sections hold nothing
        order, slo, shi = order[full], slo[full], shi[full]
        if not len(order):
            return n, crossing
        first = np.searchsorted(shi, starts, side="right")  # first section that ends behind the token's start
        last = np.searchsorted(slo, ends, side="left") - 1  # last section that starts before its end
        inside = (first == last) & (first < len(order))
        n += np.bincount(order[first[inside]], minlength=len(n))
        rest = np.flatnonzero((first < last) & (ends > starts))
    else:
        rest = np.flatnonzero(ends > starts)
    for t in rest:
        share = np.minimum(shi, ends[t]) - np.maximum(slo, starts[t])
        k = int(share.argmax())
        if share[k] > 0:
            n[order[k]] += 1
            crossing[order[k]] += int((share > 0).sum() > 1)
    return n, crossing


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a text as sections, each with its line feed."""
    ends = np.array([m.end() for m in re.finditer("\n", text)] + [len(text)], np.int64)
    ends = np.unique(ends)
    return np.concatenate([[0], ends[:-1]]), ends


def sentences(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sentences as sections: each ends behind a full stop, question or exclamation mark that white space follows."""
    ends = np.unique(np.array([m.end() for m in re.finditer(r"[.!?]+(?=\s)", text)] + [len(text)], np.int64))
    return np.concatenate([[0], ends[:-1]]), ends


SECTIONERS = {"lines": lines, "sentences": sentences}

_KNOWN: dict[tuple[int, str], _Offsets] = {}
remembers("token_counts", _KNOWN.clear)


def counted(docs: DataFrame, vocabulary: bytes, pattern: str, sections: str | DataFrame = "lines", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and section: _doc, section, start, end, n_tokens, n_crossing, n_doc_tokens.

    ``vocabulary``: the contents of a rank file (base64 token and rank on each line).
    ``sections``: the name of a sectioner, or a DataFrame (doc id under the same name, section
    int, start int, end int) of character intervals, also overlapping ones.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if len(vocabulary) > MAX_MODEL_BYTES:
        raise ValueError(f"a vocabulary of {len(vocabulary)} bytes is over {MAX_MODEL_BYTES}")
    shared = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(f"`{doc_id}`").alias("_doc"), F.col(f"`{text}`").alias("_text"))
    given = not isinstance(sections, str)
    if given:
        own = sections.select(F.col(f"`{doc_id}`").alias("_doc"), F.struct("section", "start", "end").alias("_s")).groupBy("_doc").agg(F.sort_array(F.collect_list("_s")).alias("_s"))
        own = own.select("_doc", F.col("_s.section").alias("_section"), F.col("_s.start").alias("_lo"), F.col("_s.end").alias("_hi"))
        rows = rows.join(own, "_doc")
    name = None if given else sections

    def worker() -> _Offsets:
        remember_only("token_counts")
        key = (hash(shared.value), pattern)
        if key not in _KNOWN:
            _KNOWN.clear()
            _KNOWN[key] = _Offsets(shared.value, pattern)
        return _KNOWN[key]

    def one(known: _Offsets, text: str | None, cut: tuple | None) -> tuple[list, int]:
        if not text:
            return [], 0
        section, (lo, hi) = (None, SECTIONERS[name](text)) if cut is None else (cut[0], (np.asarray(cut[1], np.int64), np.asarray(cut[2], np.int64)))
        starts, ends = known.spans(text)
        n, crossing = allocated(starts, ends, lo, hi)
        section = range(len(lo)) if section is None else section
        return list(zip(map(int, section), lo.tolist(), hi.tolist(), n.tolist(), crossing.tolist(), strict=True)), len(starts)

    @F.pandas_udf(f"struct<s:{_SECTIONS},n:bigint>")
    def attributed(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        known = worker()
        for batch in batches:
            batch = batch if isinstance(batch, tuple) else (batch,)
            cuts = zip(*batch[1:], strict=True) if len(batch) > 1 else [None] * len(batch[0])
            out = [one(known, t, c) for t, c in zip(batch[0], cuts, strict=True)]
            as_dicts = [[dict(zip(("section", "start", "end", "n_tokens", "n_crossing"), x, strict=True)) for x in s] for s, _ in out]
            yield pd.DataFrame({"s": as_dicts, "n": [n for _, n in out]})

    columns: list[Column] = [F.col("_text"), *([F.col("_section"), F.col("_lo"), F.col("_hi")] if given else [])]
    out = rows.select("_doc", attributed(*columns).alias("_a"))
    return out.select("_doc", F.col("_a.n").alias("n_doc_tokens"), F.explode("_a.s").alias("_s")).select("_doc", "_s.*", "n_doc_tokens")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document."""
    import public_tokenizers

    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        vocabulary = f.read()
    return counted(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN).withColumnRenamed("_doc", "doc_id")
