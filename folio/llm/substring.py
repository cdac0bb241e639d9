"""Substring deduplication: words of passages that occur more than once are removed.

Method: repeated-phrase automata.  Of every window of ``window`` words its least phrase of ``phrase`` words (by hash)
stands for it, so equal windows share a phrase, and few phrases stand for all windows.  Phrases that recur are
confirmed by a count over the corpus and sent to the documents that have them.  There they are compiled to
Aho-Corasick automata, sharded by number of phrases, and every such document streams through the automata of its block to
locate each occurrence.  The windows round the occurrences are then compared by 64-bit hashes of their words, within one
key of another 64 bits, and those seen elsewhere are removed.

What recurs within a block is settled there, and one witness goes to the others, so a passage that many documents
share sends one row a block, not one a document.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import blocks, register, released, row_key, table, texts

WINDOW = 35
PHRASE = 12
BLOCK_BYTES = 1_000_000
SHARD_PHRASES = 50_000
GROUP_ROWS = 50_000
CUT_ROWS = 256
_BASE = 0x9E3779B97F4A7C15
_NONE = np.uint64(2**64 - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base, np.uint64)]))[:n]


def _extreme(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x, done = pick(x[:-done], x[done:]), 2 * done
    return pick(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


class Block:
    """Words of some documents end to end, with the hashes of their phrases and windows.

    ``ids`` number the distinct words; ``at`` is where each document starts; ``phrases[i]`` and ``windows[i]`` are hashes of
    the words from i on; ``least[i]`` is the least phrase of window i and zero where no window starts.
    """

    def __init__(self, bodies: list[bytes], window: int, phrase: int):
        seen: dict[bytes, int] = {}
        number = lambda w: seen.setdefault(w, len(seen))
        self.words = [b.split() for b in bodies]
        self.ids = np.fromiter((number(w) for ws in self.words for w in ws), np.int64)
        self.at = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(bodies)), np.diff(self.at))
        n = len(self.ids)
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(w, 7) for w in seen), np.uint64, len(seen))[self.ids] if n else np.empty(0, np.uint64)
        self.reach = self.at[self.doc + 1] - np.arange(n) if n else np.empty(0, np.int64)  # words up to the document's end
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, n), dtype=np.uint64)])
        down = _powers(pow(_BASE, -1, 1 << 64), n)
        rolled = lambda k: _mixed((total[k:] - total[:-k]) * down[: n - k + 1]) if n >= k else np.empty(0, np.uint64)
        self.phrases = rolled(phrase) | np.uint64(1)
        self.windows = rolled(window)
        least = _extreme(self.phrases, window - phrase + 1, np.minimum) if len(self.windows) else np.empty(0, np.uint64)
        self.least = np.where(self.reach[: len(least)] >= window, least, np.uint64(0))
        # equal windows have equal keys; those that only share a frequent phrase mostly have different ones
        most = _extreme(self.phrases, window - phrase + 1, np.maximum) if len(self.windows) else np.empty(0, np.uint64)
        self.keys = _mixed(self.least ^ (most * np.uint64(_BASE)))

    def standing(self, span: int) -> np.ndarray:
        """Places of phrases that are the least of some window; ``span`` phrases begin in a window."""
        if not len(self.least):
            return np.empty(0, np.int64)
        edge = np.zeros(span - 1, np.uint64)
        most = _extreme(np.concatenate([edge, self.least, edge]), span, np.maximum)
        return np.nonzero(most == self.phrases[: len(most)])[0]


def occurrences(block: Block, chosen: np.ndarray, phrase: int) -> np.ndarray:
    """Whether one of the phrases with hashes ``chosen`` (sorted) starts at each word; found by automata over words."""
    out = np.zeros(len(block.ids), bool)
    if not len(block.phrases):
        return out
    within = block.reach[: len(block.phrases)] >= phrase
    places = np.nonzero(within & np.isin(block.phrases, chosen))[0]
    _, first = np.unique(block.phrases[places], return_index=True)
    for lo in range(0, len(first), SHARD_PHRASES):
        starts = places[first[lo : lo + SHARD_PHRASES]]
        used = block.ids[starts[:, None] + np.arange(phrase)]
        letters = np.zeros(int(block.ids.max()) + 1, np.uint32)
        known = np.unique(used)
        letters[known] = np.arange(1, len(known) + 1)  # any other word is letter 0, which no phrase has
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for row in letters[used]:
            automaton.add_word(row.tobytes().decode("utf-32-le", "surrogatepass"))
        automaton.make_automaton()
        for a, b in zip(block.at[:-1].tolist(), block.at[1:].tolist(), strict=True):
            text = letters[block.ids[a:b]].tobytes().decode("utf-32-le", "surrogatepass")
            ends = np.fromiter((end for end, _ in automaton.iter(text)), np.int64)
            out[a + ends - phrase + 1] = True
    return out


def _spans(places: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last + 1 word of runs of window places that lie in one owner, and the index of each run's first place."""
    if not len(places):
        return places, places, places
    new = np.concatenate([[True], (places[1:] != places[:-1] + 1) | (owner[1:] != owner[:-1])])
    first = np.nonzero(new)[0]
    last = np.concatenate([first[1:], [len(places)]]) - 1
    return places[first], places[last] + window, first


def recurring_phrases(rows: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(k1, k2, phrases): for each row of ``rows`` (k1, k2, body) its standing phrases that occur elsewhere, if any."""
    span = window - phrase + 1

    def run(batches):
        for b in blocks(batches, "body", BLOCK_BYTES):
            k1, k2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            block = Block(b.column("body").to_pylist(), window, phrase)
            places = block.standing(span)
            hashes, docs = block.phrases[places], block.doc[places]
            order = np.lexsort((docs, hashes))
            hashes, docs = hashes[order], docs[order]
            first = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(order) else np.empty(0, bool)
            sizes = np.diff(np.concatenate([np.nonzero(first)[0], [len(order)]]))
            settled = np.repeat(sizes, sizes) > 1
            keep = first | np.concatenate([[True], docs[1:] != docs[:-1]]) if len(order) else first
            hashes, docs, first, settled = (x[keep] for x in (hashes, docs, first, settled))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(k1[docs]), pa.array(k2[docs]), pa.array(np.where(first, 0, k2[docs] | 1)), pa.array(settled)],
                names=["phrase", "k1", "k2", "salt", "settled"])

    found = rows.select("k1", "k2", "body").mapInArrow(lambda b: released(run(b)), "phrase bigint, k1 bigint, k2 bigint, salt bigint, settled boolean")
    n = F.count(F.lit(1)).over(Window.partitionBy("phrase", "salt"))
    return found.withColumn("n", n).where("settled or (salt = 0 and n > 1)").groupBy("k1", "k2").agg(F.collect_list("phrase").alias("phrases"))


def repeated_spans(rows: DataFrame, phrases: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(k1, k2, start, stop): stretches of words covered by windows that occur elsewhere; they may overlap or repeat."""
    span = window - phrase + 1
    schema = "key bigint, k1 bigint, k2 bigint, start int, stop int, windows array<bigint>"

    def locate(batches):
        for b in blocks(batches, "body", BLOCK_BYTES):
            k1, k2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            block = Block(b.column("body").to_pylist(), window, phrase)
            chosen = np.unique(b.column("phrases").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            # windows whose least phrase is one of those located: the least of the hits in them is the least of all
            hits = np.where(occurrences(block, chosen, phrase)[: len(block.phrases)], block.phrases, _NONE)
            found = _extreme(hits, span, np.minimum) if len(block.least) else block.least
            places = np.nonzero((block.least > 0) & (found == block.least))[0]
            _, first, back, sizes = np.unique(block.windows[places], return_index=True, return_inverse=True, return_counts=True)
            twice = places[sizes[back] > 1]
            s, e, _ = _spans(twice, block.doc[twice], window)
            base = block.at[block.doc[s]]
            settled = (k2[block.doc[s]] ^ s, k1[block.doc[s]], k2[block.doc[s]], s - base, e - base)
            alone = np.sort(places[first])  # one witness of each window
            keys = block.keys[alone].view(np.int64)
            ws, _, at = _spans(alone, keys ^ block.doc[alone], window)
            wbase = block.at[block.doc[ws]]
            docs = block.doc[ws]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0] * (len(s) + 1), np.append(at[1:], len(alone)) if len(at) else []]).astype(np.int32)), pa.array(block.windows[alone].view(np.int64)))
            witness = (keys[at] if len(at) else keys, k1[docs], k2[docs], ws - wbase, np.full(len(ws), -1))
            cols = [np.concatenate([x, y]) for x, y in zip(settled, witness, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)] + [lists],
                names=["key", "k1", "k2", "start", "stop", "windows"])

    def settle(table: pa.Table):
        stop = table.column("stop").to_numpy()
        k1, k2, start = (table.column(c).to_numpy() for c in ("k1", "k2", "start"))
        lists = table.column("windows").combine_chunks()
        sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        _, back, counts = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
        more = counts[back] > 1
        s, e, first = _spans(start[row][more] + within[more], row[more], window)
        own = row[more][first] if len(first) else np.empty(0, np.int64)
        done = stop >= 0
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([k1[done], k1[own]])), pa.array(np.concatenate([k2[done], k2[own]])),
             pa.array(np.concatenate([start[done], s]), pa.int32()), pa.array(np.concatenate([stop[done], e]), pa.int32())],
            names=["k1", "k2", "start", "stop"])

    def compare(batches):
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < GROUP_ROWS:
                continue
            whole = pa.Table.from_batches(held)
            key = whole.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on in the next batch
            if cut:
                yield settle(whole.slice(0, cut))
                held, rows = whole.slice(cut).combine_chunks().to_batches(), len(key) - cut
        if held:
            yield settle(pa.Table.from_batches(held))

    joined = rows.select("k1", "k2", "body").join(phrases, ["k1", "k2"])
    located = joined.mapInArrow(lambda b: released(locate(b)), schema)
    dealt = located.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda b: released(compare(b)), "k1 bigint, k2 bigint, start int, stop int")


def remove_repeats(docs: DataFrame, text: str = "text", *, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """row (its columns), n_words, n_removed and ``kept``, the words left joined by one space, for every row of ``docs``.

    A word goes if a window over it starts at any other place too, in the same document or another; a repeated row is
    another place.  Documents shorter than a window and null or empty texts lose nothing.  Windows are judged on the
    input.  An empty table gives no rows; further columns are carried
    in ``row`` and play no part.
    """
    if not 0 < phrase <= window:
        raise ValueError("a phrase must fit a window")
    rows = row_key(texts(docs, text=text))
    spans = repeated_spans(rows, recurring_phrases(rows, window, phrase), window, phrase)
    covered = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def cut(batches):
        for b in (whole.slice(i, CUT_ROWS) for whole in batches for i in range(0, whole.num_rows, CUT_ROWS)):
            n, gone, kept = [], [], []
            for body, spans in zip(b.column("row").field(text).cast(pa.binary()).fill_null(b"").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = body.split()
                out = words
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [s["start"] for s in spans], 1)
                    np.add.at(edge, [s["stop"] for s in spans], -1)
                    out = [words[i] for i in np.nonzero(np.cumsum(edge[:-1]) == 0)[0].tolist()]
                n.append(len(words))
                gone.append(len(words) - len(out))
                kept.append(b" ".join(out))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["row", "n_words", "n_removed", "kept"])

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("body"), "doc_id")
    keyed = row_key(whole).select("row", "k1", "k2")
    out = keyed.join(covered, ["k1", "k2"], "left").select("row", "spans")
    return out.mapInArrow(lambda b: released(cut(b)), T.StructType([T.StructField("row", keyed.schema["row"].dataType)]).add("n_words", "long").add("n_removed", "long").add("kept", "string"))


def without_repeats(docs: DataFrame, *, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; a text that loses nothing stays as it is, a length column follows."""
    got = remove_repeats(docs, window=window, phrase=phrase)
    new = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    length = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    fields = {"text": new, "n_chars": length}
    return got.select(*[(fields[c].cast(docs.schema[c].dataType) if c in fields else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@register
def op3_substring(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
