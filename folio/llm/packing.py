"""Packing of documents into training sequences.

Method: first-fit decreasing with a tournament tree over the bins' free space, run independently in randomised
groups of documents.  A document is cut into whole sequences and one remainder; only remainders compete for
bins.  Groups are drawn by a hash, so neither a source nor a run of long documents can fill one; a group holds one
short row a document, never its ids.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import blocks, register, released, table, texts
from folio.session import materialise

LENGTH = 2048
END_ID = 1
GROUP_DOCS = 4096
CACHE_WORDS = 300_000
CACHE_HEADS = 250_000
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
BLOCK_BYTES = 2_000_000


def plain(text: str) -> bool:
    """Whether ``text`` is letters that stay letters when normalised and lowered, so that what follows is parted from them."""
    return text.isalpha() and text.lower().isalpha() and unicodedata.is_normalized("NFC", text)


class WordEncoder:
    """Ids of a text by a lower-casing vocabulary whose pieces never reach across white space, word by word.

    Two bounded caches: of words as they stand, and of their heads, which are plain letters before a run of ASCII marks;
    the vocabulary always parts these from marks.  New heads are encoded together, as words of one line, and told
    apart by the ids that end a word.  Everything else (digits, apostrophes, special tokens) is encoded alone.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.most, self.words = most, {}
        self.heads, self.rare = {}, {}  # the first, hence the frequent heads stay for later tasks

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn_heads(self, heads: set[bytes]) -> None:
        lines = []
        def keep(h: bytes, ids: bytes) -> None:
            (self.heads if len(self.heads) < CACHE_HEADS else self.rare)[h] = ids

        for h in heads.difference(self.heads, self.rare):
            text = h.decode()
            if plain(text):
                lines.append((h, text))
            else:
                keep(h, self._ids(text).tobytes())
        for i in range(0, len(lines), 2000):
            part = lines[i : i + 2000]
            ids = self._ids(" ".join([t for _, t in part]))
            cuts = (4 * (np.nonzero(self.ends[ids])[0] + 1)).tolist()
            if len(cuts) == len(part):
                data, a = ids.tobytes(), 0
                for (h, _), b in zip(part, cuts, strict=True):
                    keep(h, data[a:b])
                    a = b
            else:
                for h, t in part:
                    keep(h, self._ids(t).tobytes())

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.words)
        if len(self.words) + len(new) > self.most:
            self.words.clear()
            new = words
        if len(self.rare) > self.most:
            self.rare.clear()
        parts, heads = [], set()
        for w in new:
            head = w.rstrip(MARKS)
            if head and not plain(head.decode()):
                head = w
            parts.append((w, head, w[len(head) :]))
            heads.add(head)
            heads.add(w[len(head) :])
        heads.discard(b"")
        self._learn_heads(heads)
        frequent, rare = self.heads.get, self.rare.get
        got = lambda h: frequent(h) or rare(h, b"")
        self.words |= {w: (got(h) if h else b"") + (got(t) if t else b"") for w, h, t in parts}

    def forget(self) -> None:
        """Drop what only the running task needs."""
        self.words.clear()
        self.rare.clear()

    def encode(self, bodies: list[bytes]) -> Iterator[bytes]:
        split = [(b if b"<|" in b else b.lower()).split() for b in bodies]
        self.learn(set().union(*split))
        got = self.words.__getitem__
        for words in split:
            yield b"".join(map(got, words))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


ENCODED = pa.schema([
    ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("whole", pa.list_(pa.int64())), ("rest", pa.int64()),
    ("rest_crc32", pa.int64()), ("ids", pa.binary()),
])


FITTED = (
    "doc_id bigint, doc_tokens bigint, whole array<bigint>, rest bigint, rest_crc32 bigint, ids binary, "
    "rest_sequence bigint, rest_offset bigint, base bigint"
)


def cut(docs: DataFrame, path: str, *, length: int = LENGTH, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row a document: its tokens with the end id, the checksum of each whole sequence, length and checksum of the rest.

    ``ids`` (little-endian unsigned 32-bit) only with ``keep_ids``.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    width = 4 * length

    def run(batches):
        enc = encoder(path)
        for b in blocks(batches, "body", BLOCK_BYTES):
            rows = []
            for ids in enc.encode(b.column("body").to_pylist()):
                ids += end
                n, whole = len(ids) // 4, len(ids) // width
                rows.append((n, [zlib.crc32(ids[i * width : (i + 1) * width]) for i in range(whole)], n - whole * length,
                             zlib.crc32(ids[whole * width :]), ids if keep_ids else None))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(cols, list(ENCODED)[1:], strict=True))],
                schema=ENCODED)
        enc.forget()

    return texts(docs).mapInArrow(lambda b: released(run(b)), "doc_id bigint, doc_tokens bigint, whole array<bigint>, rest bigint, rest_crc32 bigint, ids binary")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item.

    Items go by falling size, ties by their order, each into the first bin with room.  The tree's leaves are the
    bins' free space and each inner node the larger of its two children, so the first bin with room is found by
    walking down from the root.
    """
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins, offsets


def pack(cuts: DataFrame, *, length: int = LENGTH, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Sequence and offset of every piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``cuts`` comes from :func:`cut`; it is read twice (rows are counted to choose the number of groups), so pass a
    written table.  Each document, also an empty one, gives at least one piece, as its end id counts; repeated rows are
    packed as often as they occur.  ``sequence_id`` is ``group * 2**32 + sequence within the group``.  An empty table
    gives no rows.
    """
    groups = max(1, -(-cuts.count() // group_docs))
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rest", "doc_id", "rest_crc32"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        rest, n_whole = pdf["rest"].to_numpy(), pdf["n_whole"].to_numpy()
        first, n = int(key[0]) << 32, int((rest > 0).sum())
        bins, offsets = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        bins[:n], offsets[:n] = first_fit_decreasing(rest[:n], length)
        base = first + (int(bins[:n].max()) + 1 if n else 0) + np.cumsum(n_whole) - n_whole
        return pdf.drop(columns=["n_whole", "drawn"]).assign(rest_sequence=first + bins, rest_offset=offsets, base=base)

    rows = cuts.withColumns({"n_whole": F.size("whole").cast("bigint"), "drawn": drawn})
    return _pieces(rows.groupBy("drawn").applyInPandas(fit, FITTED), length)


def _pieces(fitted: DataFrame, length: int) -> DataFrame:
    whole = F.transform("whole", lambda crc, i: F.struct(
        (i.cast("bigint") * length).alias("start"), F.lit(length).cast("bigint").alias("length"), crc.alias("ids_crc32"),
        (F.col("base") + i).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")))
    rest = F.struct(
        (F.col("doc_tokens") - F.col("rest")).alias("start"), F.col("rest").alias("length"), F.col("rest_crc32").alias("ids_crc32"),
        F.col("rest_sequence").alias("sequence_id"), F.col("rest_offset").alias("offset"))
    pieces = F.when(F.col("rest") > 0, F.concat(whole, F.array(rest))).otherwise(whole)
    return fitted.select("doc_id", "doc_tokens", "ids", F.explode(pieces).alias("p")).select(
        "doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset",
        F.expr("substring(ids, int(p.start * 4 + 1), int(p.length * 4))").alias("ids"))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op8_packing(spark, sf):
    cuts = materialise(cut(table(spark, sf, "documents"), vocabulary_path()))
    return pack(cuts).drop("ids")
