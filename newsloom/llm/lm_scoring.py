"""LM scoring by a probabilistic suffix tree over words.

Symbols are lower-cased words and one end of text. The empty context has the smoothed unigram distribution, in which all
unknown words are one symbol. A context (the last words before a symbol, up to `depth`) is a candidate if the training
texts hold it `min_context` times or more; of its next symbols, those seen there `min_next` times or more have
probabilities of their own, and the rest have what is left, in proportion to the distribution of the context's longest
kept suffix. A candidate is kept if its distribution diverges from that suffix's: its count times the Kullback-Leibler
divergence, in bits, is at least `min_bits`. Every symbol is scored in its longest suffix state.

The bars are counts, so the contexts and probabilities grow with the corpus. A partition of documents is encoded once as
blocks, a row each: the sorted hashes of the distinct words, and the documents' tokens as places in those. The words are
counted across the corpus by ranges of hashes, which send the counts back to the blocks. Then, for each depth, a block
sends its distinct contexts, each with its next symbols, their counts and their probabilities in the shorter state, as
compressed arrays to the ranges of the contexts' hashes. A range adds them up, judges its contexts, and answers each block
in the block's own order: the counts of the next symbols, and the factor for all others where the context is kept. How
often the corpus has a context is known from the depth before. One that the corpus has as often as its suffix has the same
next symbols, so that it is never kept and its counts are known: it isn't sent. One that the corpus has `heavy` times or
more is dealt by its next symbols over several ranges, and judged by the sums of those. Of such contexts alone the driver
learns the factors; they are one for every `heavy` training tokens at most. A block keeps between two depths a row of
arrays, with the probabilities of the places alone that a longer context may still change. Contexts and words are known by
hashes, of 64 bits and, next to a context, of the first 48. Tables are deleted when the next one is written. Counts cover
the whole training corpus.

Edge cases: null and empty texts are the end alone; an empty training fold gives one unknown symbol with probability
one; null ids are in the training fold; repeated rows count and are scored each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import io
import json
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import bound_batches, bucketed, crc_mod, discard, drop_bucketed, materialized, packed_sorted, release, unpacked_sorted

END = b"\n"  # white space is never in a word
MOST_BUCKETS = 10_000  # of the states of blocks; a bucket holds one block, or several beyond as many


def tokens_of(text: str | None) -> list[bytes]:
    """The words, in UTF-8, with A-Z in lower case, and END. Bytes know of ASCII letters and white space only."""
    return [*text.encode().lower().split(), END] if isinstance(text, str) else [END]


def encode(docs: DataFrame, block_tokens: int) -> DataFrame:
    """A row for each block: its `state`, the `hashes` of its distinct words, sorted, and how often training documents
    have each (`trained`). docs: doc_id, text, held_out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        place, ids, held, places, size = Places(), [], [], [], 0

        def emit() -> pd.DataFrame:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, place), "<u8", len(place))
            order = np.argsort(hashes)
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order), dtype="<u4")
            lengths, out = np.array([len(x) for x in places]), np.array(held, bool)
            ranks = rank[np.concatenate(places)]
            trained = np.bincount(ranks[np.repeat(~out, lengths)], minlength=len(rank))
            state = packed({"ids": np.frombuffer(json.dumps(ids).encode(), "|u1"), "places": ranks, "lengths": lengths, "held": out})
            return pd.DataFrame({"block": [(part << 20) + number], "n_tokens": [size], "state": [state], "hashes": [packed_sorted(hashes[order])], "trained": [planes(trained.astype("<u4"))]})

        for batch in batches:
            for key, text, out in zip(batch["doc_id"], batch["text"], batch["held_out"], strict=True):
                tokens = tokens_of(text)
                ids.append(key if isinstance(key, str) else None)
                held.append(out)
                places.append(np.fromiter(map(place.__getitem__, tokens), "<u4", len(tokens)))
                size += len(tokens)
                if size >= block_tokens:
                    yield emit()
                    place, ids, held, places, size, number = Places(), [], [], [], 0, number + 1
                    pa.default_memory_pool().release_unused()
        if size:
            yield emit()

    # Ids go through pandas as strings, which nulls and large numbers don't change.
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "held_out")
    return slim.mapInPandas(run, "block long, n_tokens long, state binary, hashes binary, trained binary")


def word_counts(coded: DataFrame, ranges: int) -> DataFrame:
    """block, range, counts: how often training documents of the corpus have the words of a block, by their sorted hashes;
    and in one row of each range n and v, the sums of all and of distinct trained tokens."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, hashes, trained in zip(batch["block"], batch["hashes"], batch["trained"], strict=True):
                keys, counts = unpacked_sorted(hashes), unplaned(trained, "<u4")
                rows = [(block, r, packed_sorted(keys[a:b]), planes(counts[a:b])) for r, a, b in range_bounds(keys, ranges)]
                yield pd.DataFrame(rows, columns=["block", "range", "keys", "counts"])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        keys = [unpacked_sorted(k) for k in group["keys"]]
        _, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(back, np.concatenate([unplaned(c, "<u4") for c in group["counts"]])).astype(np.int64)
        out = pd.DataFrame({"block": group["block"], "range": group["range"], "counts": [planes(total[x]) for x in np.split(back, np.cumsum([len(k) for k in keys])[:-1])], "n": 0, "v": 0})
        out.loc[out.index[0], ["n", "v"]] = int(total.sum()), int((total > 0).sum())
        return out

    sent = coded.select("block", "hashes", "trained").mapInPandas(send, "block long, range int, keys binary, counts binary")
    return sent.groupBy("range").applyInPandas(answer, "block long, range int, counts binary, n long, v long")


class Places(dict):
    def __missing__(self, token: bytes) -> int:
        self[token] = k = len(self)
        return k


class Tree:
    """A small model in memory, to compare with. Nodes are contexts, 0 is the empty one. A node's child is the context
    with one more word in front."""

    def __init__(self, symbols: list[bytes], p0: np.ndarray) -> None:
        self.symbols, self.size = {t: k for k, t in enumerate(symbols)}, max(1, len(symbols))
        self.p0 = p0
        self.parent, self.kept, self.escape = [0], [True], [0.0]
        self.children: dict[int, int] = {}
        self.entries: dict[int, float] = {}

    def freeze(self) -> Tree:
        order = lambda d, kind: (np.array(sorted(d), np.int64), np.array([d[k] for k in sorted(d)], kind))
        self.child_keys, self.child_ids = order(self.children, np.int64)
        self.entry_keys, self.entry_log = order(self.entries, np.float64)
        self.up, self.is_kept, self.esc = np.array(self.parent), np.array(self.kept), np.array(self.escape)
        return self

    def __getstate__(self) -> dict:
        """What tasks need: the sorted arrays, not the dictionaries they are made from."""
        return {k: v for k, v in self.__dict__.items() if k not in ("children", "entries", "parent", "kept", "escape")}

    def kept_parent(self, node: int) -> int:
        node = self.parent[node]
        while not self.kept[node]:
            node = self.parent[node]
        return node

    def probability(self, node: int, symbol: int) -> float:
        factor = 1.0
        while node:
            found = self.entries.get(node * self.size + symbol)
            if found is not None:
                return factor * 10**found
            factor *= 10 ** self.escape[node]
            node = self.kept_parent(node)
        return factor * float(self.p0[symbol])


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing, values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def states(tree: Tree, ids: np.ndarray, age: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each place, the node of the context of 1, 2, ... depth words before it, or -1. age: place within its text."""
    out, node = [], np.zeros(len(ids), np.int64)
    for d in range(1, depth + 1):
        word = np.concatenate([np.full(min(d, len(ids)), -1, np.int64), ids[:-d]])[: len(ids)]
        there = (node >= 0) & (age >= d) & (word >= 0)
        node = np.where(there, look_up(tree.child_keys, tree.child_ids, node * tree.size + word, -1), -1)
        out.append(node)
    return out


def log_scores(tree: Tree, ids: np.ndarray, age: np.ndarray, log_p0: np.ndarray, depth: int) -> np.ndarray:
    """The log10 probability of each symbol in its longest suffix state."""
    state = np.zeros(len(ids), np.int64)
    for node in states(tree, ids, age, depth):
        state = np.where((node >= 0) & tree.is_kept[np.maximum(node, 0)], node, state)
    out = np.zeros(len(ids))
    live = np.flatnonzero(state > 0)
    while len(live):
        at = state[live]
        own = np.where(ids[live] >= 0, look_up(tree.entry_keys, tree.entry_log, at * tree.size + ids[live], np.nan), np.nan)
        hit = ~np.isnan(own)
        out[live[hit]] += own[hit]
        state[live[hit]] = -1
        live = live[~hit]
        out[live] += tree.esc[state[live]]
        at = tree.up[state[live]]
        while not tree.is_kept[at].all():
            at = np.where(tree.is_kept[at], at, tree.up[at])
        state[live] = at
        live = live[at > 0]
    return out + np.where(state == 0, log_p0, 0.0)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes; the order counts."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0xD1B54A32D192ED03))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def planes(values: np.ndarray) -> bytes:
    """An array, byte by byte of its numbers, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def unplaned(blob: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1).T).view(kind).ravel()


def bundle(*arrays: np.ndarray) -> bytes:
    """Several arrays, as `planes`, in one."""
    flat = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(x) for x in arrays], "<u4").tobytes(), *flat]))


def unbundle(blob: bytes, *kinds: str) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    begin, out = 4 * len(kinds), []
    for n, kind in zip(flat[:begin].view("<u4").tolist(), kinds, strict=True):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(flat[begin : begin + n * size].reshape(size, n).T).view(kind).ravel())
        begin += n * size
    return out


#: What a block keeps. At first `counts` has the count of each word and `sums` those of all and of distinct ones; later
#: `n` has the count of each place's symbol after its context (`clipped`), log_p has the places that a longer context may
#: change, as singles, and `done` has the sums of each document's others. `same` has the places where the longer context
#: changed no count: the corpus has what ends there as often without its first word.
STATE = {
    "ids": "|u1", "places": "<u4", "lengths": "<i8", "held": "|u1", "hashes": "<u8", "counts": "<i8", "sums": "<i8", "n": "<i8", "same": "|u1", "log_p": "<f4", "done": "<f8",
    "known": "<i8", "base": "<f8",
}


class Bars(NamedTuple):
    least: int
    least_next: int
    least_bits: float
    prior: float
    heavy: int


def clipped(n: np.ndarray, bars: Bars) -> np.ndarray:
    """Counts that reach the bar of contexts; of others, whether they reach that of next symbols."""
    return np.where(n >= bars.least, n, np.where(n >= bars.least_next, bars.least_next, 0))


def deepens(state: dict[str, np.ndarray], bars: Bars) -> np.ndarray:
    """The places whose context of one more word reaches the bar."""
    first = np.zeros(len(state["n"]), bool)
    first[np.cumsum(state["lengths"]) - state["lengths"]] = True
    return np.flatnonzero(~first[1:] & (state["n"][:-1] >= bars.least)) + 1


def of_documents(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums by document; each has a token at least."""
    return np.add.reduceat(values, np.cumsum(lengths) - lengths)


def packed(state: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{k: np.frombuffer(packed_sorted(x) if k == "hashes" else planes(x.astype(STATE[k])), np.uint8) for k, x in state.items()})
    return out.getvalue()


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    held = np.load(io.BytesIO(blob))
    out = {k: unpacked_sorted(held[k].tobytes()) if k == "hashes" else unplaned(held[k].tobytes(), STATE[k]) for k in held.files}
    return out | {"held": out["held"].astype(bool)}


def base_of(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return np.log10((counts + 0.5) / (sums[0] + 0.5 * (sums[1] + 1)))


def pack(state: dict[str, np.ndarray], bars: Bars) -> bytes:
    state = state | {"n": clipped(state["n"], bars)}
    at = deepens(state, bars)
    final = state["log_p"].copy()
    final[at] = 0
    return packed(state | {"log_p": state["log_p"][at], "done": state["done"] + of_documents(final, state["lengths"])})


def unpack(blob: bytes, bars: Bars) -> dict[str, np.ndarray]:
    out = unpacked(blob)
    if "counts" in out:
        counts, sums = out.pop("counts"), out.pop("sums")
        return out | {"n": clipped(counts, bars)[out["places"]], "log_p": base_of(counts, sums)[out["places"]], "same": np.zeros(len(out["places"]), np.uint8), "done": np.zeros(len(out["lengths"]))}
    log_p = np.zeros(len(out["places"]))
    log_p[deepens(out, bars)] = out["log_p"]
    return out | {"log_p": log_p}


class Entries(NamedTuple):
    """The contexts of some depth of a block, and their next symbols. A route is a context, or what a part of the next
    symbols of a heavy one has in its place."""

    known: np.ndarray  # places with a context that has the counts of its suffix
    at: np.ndarray  # the other places with a context that reaches the bar
    context: np.ndarray  # its hash, at each of these
    total: np.ndarray  # its count in the corpus
    is_heavy: np.ndarray
    route_of: np.ndarray  # which of the routes it is; -1 if heavy
    next: np.ndarray  # those of `at` whose symbol may reach the bar of next symbols
    entry_of: np.ndarray  # which of the entries each of these is
    routes: np.ndarray  # distinct ones, sorted
    totals: np.ndarray  # the count of the route's context
    contexts: np.ndarray  # the contexts of heavy routes
    ends: np.ndarray  # where the entries of each route begin and, one further on, end
    words: np.ndarray  # 48 bits of the hash of the entries' next symbols
    n: np.ndarray  # their counts in the training documents of the block
    shorter: np.ndarray  # log10 of their probability in the shorter state


def entries(state: dict[str, np.ndarray], depth: int, bars: Bars) -> Entries:
    places, hashes, n = state["places"], state["hashes"], state["n"]
    at = deepens(state, bars)
    is_known = state["same"][at - 1] > 0
    known, at = at[is_known], at[~is_known]
    context = hashes[places[at - 1]]
    for k in range(2, depth + 1):
        context = mixed(context, hashes[places[at - k]])
    total = n[at - 1]
    is_heavy = total >= bars.heavy
    nexts = np.flatnonzero(n[at] >= bars.least_next)
    at_next = at[nexts]
    dealt = np.flatnonzero(is_heavy[nexts])
    whole, word = total[nexts][dealt], hashes[places[at_next[dealt]]]
    parts = np.left_shift(np.uint64(2), np.log2(whole // bars.heavy).astype(np.uint64))
    asked = np.concatenate([context[~is_heavy], mixed(context[nexts][dealt], word & (parts - np.uint64(1)))])
    routes, back = np.unique(asked, return_inverse=True)
    split = len(asked) - len(dealt)
    route_of = np.full(len(at), -1)
    route_of[~is_heavy] = back[:split]
    totals, contexts = np.zeros(len(routes), np.int64), np.zeros(len(routes), np.uint64)
    totals[back], contexts[back] = np.concatenate([total[~is_heavy], whole]), np.concatenate([context[~is_heavy], context[nexts][dealt]])
    of = route_of[nexts]
    of[dealt] = back[split:]
    size = len(hashes)
    codes, entry_of = np.unique(of * size + places[at_next], return_inverse=True)
    trained = np.repeat(~state["held"], state["lengths"])[at_next]
    one = np.zeros(len(codes), np.int64)
    one[entry_of] = at_next
    return Entries(
        known, at, context, total, is_heavy, route_of, nexts, entry_of, routes, totals, contexts[totals >= bars.heavy],
        np.searchsorted(codes, np.arange(len(routes) + 1) * size), hashes[codes % size] >> np.uint64(16), np.bincount(entry_of[trained], minlength=len(codes)), state["log_p"][one],
    )


def range_bounds(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """The ranges of equal width that hold sorted keys, and where the keys of each begin and end."""
    edges = [-(-(r << 31) // ranges) << 33 for r in range(1, ranges)]
    ends = [0, *np.searchsorted(keys, np.array(edges, np.uint64)).tolist(), len(keys)]
    return ((r, a, b) for r, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a)


def escapes(total: np.ndarray, n: np.ndarray, q: np.ndarray, gain: np.ndarray, bars: Bars) -> np.ndarray:
    """log10 of the factor for all other symbols of contexts; NaN if they aren't kept. Of the next symbols that reach the
    bar, n and q are the sums of the counts and of the probabilities in the shorter state, gain that of n * log2(n / q)."""
    whole = total + bars.prior
    with np.errstate(all="ignore"):
        rest, rest_q = 1 - n / whole, np.maximum(1e-9, 1 - q)
        gain = (gain - n * np.log2(whole)) / whole + rest * np.log2(rest / rest_q)
        return np.where((n > 0) & (total * gain >= bars.least_bits), np.log10(rest / rest_q), np.nan)


def answered(states: DataFrame, depth: int, last: bool, bars: Bars, ranges: int) -> DataFrame:
    """block, range, answer: for the entries and the routes of a block in a range, in their order, the counts in the corpus
    (those of contexts that aren't kept `clipped`, or 0 at last) and `escapes`. And, without a block, the sums of parts of heavy contexts: context, total, n, q, gain."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, blob in zip(batch["block"], batch["state"], strict=True):
                e = entries(unpack(blob, bars), depth, bars)
                heavy = np.concatenate([[0], np.cumsum(e.totals >= bars.heavy)])
                rows = []
                for r, a, b in range_bounds(e.routes, ranges):
                    x, y = e.ends[a], e.ends[b]
                    words = np.ascontiguousarray(e.words[x:y].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
                    steps, sizes = np.diff(e.routes[a:b], prepend=np.uint64(0)), np.diff(e.ends[a : b + 1]).astype("<u4")
                    rest = bundle(steps, e.totals[a:b], sizes, e.contexts[heavy[a] : heavy[b]], e.n[x:y].astype("<u4"), e.shorter[x:y].astype("<f4"))
                    rows.append((block, r, words.tobytes(), rest))
                yield pd.DataFrame(rows, columns=["block", "range", "words", "rest"])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        pieces = [unbundle(x, "<u8", "<i8", "<u4", "<u8", "<u4", "<f4") for x in group["rest"]]
        n_routes, n_entries = [len(x[0]) for x in pieces], [len(x[4]) for x in pieces]
        totals, sizes, heavy, n, shorter = (np.concatenate([x[k] for x in pieces]) for k in range(1, 6))
        routes, first, back = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in pieces]), return_index=True, return_inverse=True)
        del pieces
        words = np.zeros((len(n), 8), np.uint8)
        words[:, :6] = np.frombuffer(b"".join(group["words"]), np.uint8).reshape(-1, 6)
        whose = np.repeat(back, sizes)
        keys, entry_of = np.unique(mixed(routes[whose], words.view("<u8").ravel()), return_inverse=True)
        del words
        one = np.zeros(len(keys), np.int64)
        one[entry_of] = np.arange(len(entry_of))
        n = np.bincount(entry_of, n, len(keys)).astype(np.int64)
        enough = np.flatnonzero(n >= bars.least_next)
        its, log_q, found = whose[one[enough]], shorter[one[enough]].astype(np.float64), n[enough].astype(np.float64)
        total = totals[first]
        sums = [np.bincount(its, x, len(routes)) for x in (found, 10**log_q, found * (np.log2(found) - log_q * math.log2(10)))]
        is_heavy = total >= bars.heavy
        escape = np.where(is_heavy, np.nan, escapes(total, *sums, bars))
        exact = (is_heavy | ~np.isnan(escape))[whose[one]]
        escape, n = escape[back], np.where(exact, np.where(n >= bars.least_next, n, 0), 0 if last else clipped(n, bars))[entry_of]
        rows, a, x = [], 0, 0
        for block, r, b, y in zip(group["block"], group["range"], np.cumsum(n_routes), np.cumsum(n_entries), strict=True):
            rows.append((block, r, bundle(n[x:y], escape[a:b].astype("<f4"))))
            a, x = b, y
        out = pd.DataFrame(rows, columns=["block", "range", "answer"]).astype({"block": "Int64", "range": "Int32"})
        if not is_heavy.any():
            return out.assign(context=None, total=None, n=None, q=None, gain=None)
        contexts = np.zeros(len(totals), np.uint64)
        contexts[totals >= bars.heavy] = heavy
        parts = {"context": contexts[first].view(np.int64), "total": total} | dict(zip(("n", "q", "gain"), sums, strict=True))
        more = pd.DataFrame({k: v[is_heavy] for k, v in parts.items()}).astype({"context": "Int64", "total": "Int64"})
        return pd.concat([out, more], ignore_index=True)

    sent = states.select("block", "state").mapInPandas(send, "block long, range int, words binary, rest binary")
    return sent.groupBy("range").applyInPandas(answer, "block long, range int, answer binary, context long, total long, n double, q double, gain double")


def heavy_escapes(answers: DataFrame, bars: Bars) -> tuple[np.ndarray, np.ndarray]:
    """The heavy contexts, sorted, and their `escapes`."""
    sums = [F.sum(k).alias(k) for k in ("n", "q", "gain")]
    rows = answers.where(F.col("block").isNull()).groupBy("context").agg(F.max("total").alias("total"), *sums).toPandas()
    keys = rows["context"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], escapes(*(rows[k].to_numpy(np.float64)[order] for k in ("total", "n", "q", "gain")), bars)


def deeper_states(depth: int, last: bool, bars: Bars, heavy: tuple[np.ndarray, np.ndarray]):  # noqa: ANN201
    """The function that takes the answers on a block's contexts of `depth` words into its state, or its scores."""

    def deeper(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        state = unpack(right["state"].iloc[0], bars)
        e = entries(state, depth, bars)
        answers = [unbundle(x, "<i8", "<f4") for x in left.sort_values("range")["answer"]]
        n, of_route = (np.concatenate([x[k] for x in answers]) if answers else np.zeros(0, kind) for k, kind in enumerate(("<i8", "<f4")))
        escape = np.full(len(e.at), np.nan)
        escape[~e.is_heavy] = of_route[e.route_of[~e.is_heavy]]
        escape[e.is_heavy] = look_up(*heavy, e.context[e.is_heavy], np.nan)
        log_p, at_n = state["log_p"], np.zeros(len(state["n"]), np.int64)
        log_p[e.at] += np.nan_to_num(escape)
        n = n[e.entry_of]
        at_n[e.at[e.next]], at_n[e.known] = n, state["n"][e.known]
        own = np.flatnonzero((n > 0) & ~np.isnan(escape[e.next]))
        log_p[e.at[e.next[own]]] = np.log10(n[own] / (e.total[e.next[own]] + bars.prior))
        if not last:
            return pd.DataFrame({"block": right["block"].to_numpy()[:1], "state": [pack(state | {"n": at_n, "same": at_n == state["n"], "log_p": log_p}, bars)]})
        scores = state["done"] + of_documents(log_p, state["lengths"])
        return pd.DataFrame({"doc_id": json.loads(state["ids"].tobytes()), "held_out": state["held"], "n_tokens": state["lengths"], "n_known": state["known"], "base_score": state["base"], "score": scores})

    return deeper


def score_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 5, held_fold: int = 1,
    depth: int = 3, min_share: float = 0.0, min_joint: float = 0.0, min_gain: float = 0.0, prior: float = 2.0,
    min_context: int = 8, min_next: int = 2, min_bits: float = 16.0, range_tokens: int = 2_000_000, heavy: int = 1 << 20, block_tokens: int = 600_000,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    min_share, min_joint, min_gain: higher bars for small models, as shares of all training tokens; none by default.
    range_tokens: tokens for each range of hashes. heavy: the count from which a context is dealt over several ranges.
    block_tokens: tokens of a block, or those of one text if it has more. Building the result runs jobs, which write tables.
    """
    key = F.col(doc_id)
    slim = docs.select(key.alias("doc_id"), F.col(text).alias("text"), F.coalesce(crc_mod(key, folds) == held_fold, F.lit(False)).alias("held_out"))
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    kind = slim.schema["doc_id"].dataType
    # In buckets, so that a depth shuffles the answers to the states and not the states.
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(1, size // (6 * block_tokens)))
    coded = bucketed(encode(slim, block_tokens), "block", buckets)
    ranges = max(1, -(-(coded.agg(F.sum("n_tokens")).first()[0] or 0) // range_tokens))
    counts = materialized(word_counts(coded, ranges))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    bars = Bars(max(min_context, math.ceil(min_share * n)), max(min_next, math.ceil(min_joint * n)), max(min_bits, min_gain * n), prior, heavy)
    release(spark)

    def begun(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        state = unpacked(right["state"].iloc[0])
        c, sums = np.concatenate([unplaned(x, "<i8") for x in left.sort_values("range")["counts"]]), np.array([n, v])
        known, base = ((x[state["places"]]) for x in ((c > 0).astype(np.int64), base_of(c, sums)))
        state |= {"hashes": unpacked_sorted(right["hashes"].iloc[0]), "counts": c, "sums": sums, "known": of_documents(known, state["lengths"]), "base": of_documents(base, state["lengths"])}
        return pd.DataFrame({"block": right["block"].to_numpy()[:1], "state": [packed(state)]})

    began = counts.select("block", "range", "counts").groupBy("block").cogroup(coded.groupBy("block")).applyInPandas(begun, "block long, state binary")
    states = bucketed(began, "block", buckets)
    drop_bucketed(coded)
    discard(counts)
    release(spark)
    scored = "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    for d in range(1, depth + 1):
        answers = materialized(answered(states, d, d == depth, bars, ranges))
        into = deeper_states(d, d == depth, bars, heavy_escapes(answers, bars))
        release(spark)  # after a further job, as Spark holds the shuffle of the last one
        known = answers.where(F.col("block").isNotNull()).select("block", "range", "answer")
        deeper = known.groupBy("block").cogroup(states.groupBy("block")).applyInPandas(into, "block long, state binary" if d < depth else scored)
        deeper = materialized(deeper) if d == depth else bucketed(deeper, "block", buckets)
        discard(answers)
        drop_bucketed(states)
        states = deeper
        release(spark)
    return states.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
