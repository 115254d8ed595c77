"""Token counts by section, from one encoding of the whole document.

A document is encoded once, by a byte-level BPE of a public vocabulary. The byte lengths of its
tokens give their character spans, which are joined by interval with the spans of the sections;
sections of a document are spans of its text that do not overlap. A token that lies in several
sections goes to one of them by an explicit rule:

``most``   the section that holds most of its characters, the earlier one of equals (default)
``first``  the section that holds its first character, else the first it touches
``last``   the section that holds its last character, else the last it touches

A character split over several tokens belongs to each of them. Tokens that touch no section, such
as line ends alone, are counted under a null section, so counts always add up to the document's.

Defined results: a null or empty text has no tokens and no row under a null section; a null list
of sections is an empty one; an empty section has no tokens; repeated rows are documents of their own; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("most", "first", "last")

_loaded: dict[str, tuple] = {}


def load(ranks: bytes, key: str) -> tuple:
    """Encoding and byte length per token, once per worker process."""
    if key not in _loaded:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        sizes = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            sizes[rank] = len(token)
        _loaded[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), sizes
    return _loaded[key]


# White space as the pattern has it. Of a run before other text the pattern takes all but the last character as
# one piece, of one at the end all; runs this long are cut out there, as its matcher descends once a character.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def encode_whole(text: str, encoding) -> list[int]:
    out, done = [], 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += encoding.encode_ordinary(text[done : run.start()])
        out += encoding._encode_single_piece(text[run.start() : end])
        done = end
    return out + encoding.encode_ordinary(text[done:])


def token_spans(text: str, encoding, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a text's tokens and the character span ``[start, end)`` of each."""
    ids = np.array(encode_whole(text, encoding), np.int64)
    ends = np.cumsum(sizes[ids])
    # chars[b]: how many characters have begun up to byte b.
    chars = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
    return ids, chars[ends - sizes[ids]] - 1, chars[ends - 1]


def attribute(start: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str = "most") -> np.ndarray:
    """For each token the position of its section in ``sections``, or -1.

    ``sections`` has a row (start, end) for each section, in order and without overlap.
    """
    full = np.flatnonzero(sections[:, 1] > sections[:, 0])
    if not len(full):
        return np.full(len(start), -1)
    own = sections[full]
    first = np.searchsorted(own[:, 1], start, "right")
    last = np.searchsorted(own[:, 0], end, "left") - 1
    got = np.where(first <= last, last if rule == "last" else first, -1)
    if rule == "most":
        for i in np.flatnonzero(first < last):
            within = own[first[i] : last[i] + 1]
            share = np.minimum(within[:, 1], end[i]) - np.maximum(within[:, 0], start[i])
            got[i] = first[i] + int(share.argmax())
    return np.where(got >= 0, full[got], -1)


COUNTS = "array<struct<section:string,n_tokens:bigint,n_crossing:bigint>>"
COUNTS_ARROW = pa.list_(pa.struct([("section", pa.string()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())]))


def count_tokens(df: DataFrame, sections: str | None = None, doc: str = "doc_id", text: str = "text", rule: str = "most", ranks: str = RANKS) -> DataFrame:
    """One row per document and section: ``doc_id, section, n_tokens, n_crossing``.

    ``sections`` names a column of ``array<struct<name, start, end>>`` in order and without
    overlap; without it the sections are the lines of the text, named by their number.
    ``n_crossing`` counts those of the section's tokens that also touch other characters.
    Nothing moves between tasks: spans and sections of a document are one row's arrays.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    spark: SparkSession = df.sparkSession
    with open(ranks, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # of the size of a vocabulary file
    spans = F.col(sections) if sections else F.lit(None).cast("array<struct<name:string,start:int,end:int>>")
    by_line = sections is None

    @F.arrow_udf(COUNTS)
    def run(texts: pa.Array, given: pa.Array) -> pa.Array:
        encoding, sizes = load(vocabulary.value, ranks)
        out = []
        for value, parts in zip(texts.to_pylist(), given.to_pylist()):
            value = value or ""
            if by_line:
                ends = np.cumsum([len(x) + 1 for x in value.split("\n")]) - 1
                table = np.stack([np.concatenate([[0], ends[:-1] + 1]), ends], axis=1)
                names = [str(i) for i in range(len(table))]
            else:
                names = [p["name"] for p in parts or []]
                table = np.array([(p["start"], p["end"]) for p in parts or []], np.int64).reshape(-1, 2)
            n, crossing = np.zeros(len(names) + 1, np.int64), np.zeros(len(names) + 1, np.int64)
            if value:
                _, start, end = token_spans(value, encoding, sizes)
                own = attribute(start, end, table, rule)
                n = np.bincount(own + 1, minlength=len(names) + 1)
                if len(table):
                    over = (own >= 0) & ((start < table[own, 0]) | (end > table[own, 1]))
                    crossing = np.bincount(own[over] + 1, minlength=len(names) + 1)
            rows = [{"section": s, "n_tokens": int(a), "n_crossing": int(b)} for s, a, b in zip([None, *names], n, crossing)]
            out.append(rows if n[0] else rows[1:])
        return pa.array(out, COUNTS_ARROW)

    rows = df.select(F.col(doc).alias("doc_id"), F.col(text).alias("t"), spans.alias("s"))
    counted = rows.select("doc_id", run("t", "s").alias("c"))
    return counted.select("doc_id", F.explode("c").alias("c")).select("doc_id", "c.*")
