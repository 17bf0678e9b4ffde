"""LM scoring by deleted interpolation.

The probability of a token is a mixture of the maximum-likelihood estimates of all n-gram orders and the uniform
distribution over the vocabulary and one unknown token. The weights depend on how often the longest context was seen
(buckets by powers of two) and are learned by expectation-maximisation on held-out counts: a fixed eighth of the
training documents is deleted from the counts, and the weights are those that make it most likely under the rest. The
final estimates then use all training documents.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, and one end for each text.

*Counts.* Documents form blocks of neighbouring rows (``BLOCK_ROWS``, ``BLOCK_BYTES`` at most); held-out-for-weights documents have blocks of
their own. A block sends the hash of each of its distinct n-grams once, with its count, to the shard of that hash; the
shard adds up all blocks and answers each block with counts in the order of its question. So a frequent word or n-gram
is one entry per block, and only the answers, not the keys, travel back. Then a block's documents meet its answers.
Held-out positions become cells (bucket, rounded log probability of each order), which are added up; their number is
bounded by the rounding, so the mixture weights are learned on the driver from a table of bounded size.

The rows of a block must come in the same order each time: ``documents`` has to be a table (or any other frame whose
partitions can be computed again alike). A block checks that answers fit its questions, by a hash of the keys.

Defined results: a null or empty text has one token, its end; a null doc_id counts as a training document; repeated
rows count repeatedly; without any training token all counts are 0 and both scores use an empty vocabulary; an empty
table gives no rows; a text longer than a block's bytes is a block of its own; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm._common import crc_mod, cut, lean, lower_words, parts_for, text_bytes, total_bytes, trim
from driftspark.llm.phrase_dedup import mix

ORDER = 2
BLOCK_ROWS = 2048
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 6 << 20
#: Steps of rounding log2 probabilities in the cells of held-out counts.
STEP = 0.5
EM_STEPS = 60
#: Least weight of the uniform distribution, so that every text has a finite score.
FLOOR = 1e-6
_MULT = np.uint64(0x9E3779B97F4A7C15)
_END, _START = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
ASK = "shard int, block long, level int, deleted boolean, n int, keys binary, counts binary"
ANSWER = "block long, level int, shard int, n int, asked long, total binary, deleted binary, tokens long, types long, gone long"


def pack(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte by byte: the high bytes are mostly 0 and compress away."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Whole numbers byte by byte, in as many bytes as the largest of them takes."""
    width = max(1, -(-int(counts.max(initial=0)).bit_length() // 8))
    return counts.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(raw, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel().astype(float)


def digest(keys: np.ndarray) -> int:
    """A hash of some keys in their order, as a long."""
    return xxhash.xxh3_64_intdigest(keys.tobytes()) >> 1


class Block:
    """The n-grams of some documents: positions, and for each order the distinct grams in (shard, hash) order.

    Position 0 of a document is its start; the others are its tokens. ``gram[k]`` is, for each position, the place of
    the k-gram that ends there; a gram's context is the (k-1)-gram that ends one position earlier."""

    def __init__(self, texts: list[bytes | None], n_shards: int, order: int):
        vocab: dict[bytes, int] = {}
        parts, lengths = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            split = lower_words(t) if t else []
            lengths[i] = len(split) + 2
            parts.append(np.fromiter((vocab.setdefault(w, len(vocab) + 2) for w in split), np.int32, len(split)))
        hashes = np.empty(len(vocab) + 2, np.uint64)
        hashes[0], hashes[1] = _START, _END
        hashes[2:] = np.fromiter(map(xxhash.xxh3_64_intdigest, vocab), np.uint64, len(vocab))
        ends = np.cumsum(lengths)
        token = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        for p, e, n in zip(parts, ends.tolist(), lengths.tolist(), strict=True):
            token[e - n + 1 : e - 1] = p
        token[ends - 1] = 1
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        self.starts = ends - lengths
        self.is_token = token != 0
        self.is_first = np.zeros(len(token), bool)
        self.is_first[self.starts + 1] = True
        self.keys: list[np.ndarray] = []
        self.gram: list[np.ndarray] = []
        at = np.flatnonzero(self.is_token)
        context = np.zeros(len(token), np.int32)  # code of the context of the grams of this order
        context_hash = np.array([_START])
        for k in range(order):
            pair = context[at].astype(np.int64) * len(hashes) + token[at]
            distinct, inverse = np.unique(pair, return_inverse=True)
            h = mix(context_hash[distinct // len(hashes)] * _MULT + hashes[distinct % len(hashes)] + np.uint64(k))
            rank = np.lexsort((h, h % np.uint64(n_shards)))
            place = np.empty(len(h), np.int32)
            place[rank] = np.arange(len(h))
            gram = np.full(len(token), -1, np.int32)
            gram[at] = place[inverse]
            del pair, inverse, distinct
            self.keys.append(h[rank])
            self.gram.append(gram)
            # the next order's contexts: this order's grams one position earlier, or the start of the document
            context = np.zeros(len(token), np.int32)
            context[1:] = gram[:-1] + 1
            context_hash = np.concatenate(([_START], h[rank]))
        self.n_shards = n_shards

    def counts(self, weight: np.ndarray) -> list[np.ndarray]:
        """How often each gram occurs in the documents of weight 1."""
        w = weight[self.doc].astype(float)
        return [
            np.bincount(g[self.is_token], w[self.is_token], len(k)).astype(np.int64)
            for g, k in zip(self.gram, self.keys, strict=True)
        ]

    def shards(self, level: int) -> Iterator[tuple[int, int, int]]:
        shard = (self.keys[level] % np.uint64(self.n_shards)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i < j:
                yield int(shard[i]), i, j


class Numbers:
    """The block of each row of a partition: a block ends before it would hold more than ``BLOCK_ROWS`` rows or
    ``BLOCK_BYTES`` bytes of text (a longer text is alone). Deleted documents are counted by themselves."""

    def __init__(self):
        self.at = {False: (0, 0, 0), True: (0, 0, 0)}

    def __call__(self, part: int, deleted: bool, size: int) -> int:
        index, rows, held = self.at[deleted]
        if rows and (rows == BLOCK_ROWS or held + size > BLOCK_BYTES):
            index, rows, held = index + 1, 0, 0
        self.at[deleted] = index, rows + 1, held + size
        return (part << 33) + index * 2 + deleted

    def of(self, batch: pa.RecordBatch) -> list[int]:
        sizes = pc.binary_length(batch.column("text")).fill_null(0).to_pylist()
        return list(map(self, batch.column("part").to_pylist(), batch.column("deleted").to_pylist(), sizes))


def _parts(documents: DataFrame) -> DataFrame:
    """doc_id, text, held_out, deleted (held out for the weights), part: what the blocks are made of."""
    held_out = crc_mod("doc_id", 7) == 2
    text_key = F.xxhash64(F.col("doc_id").cast("string"), F.lit("weights"))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        held_out.alias("held_out"),
        (~held_out & (F.pmod(text_key, F.lit(8)) == 0)).alias("deleted"),
        F.spark_partition_id().alias("part"),
    )


def _blocks(parts: DataFrame) -> DataFrame:
    """doc_id, held_out, text, block. Of parts without the other documents, the deleted ones have the same blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for b in batches:
            if b.num_rows:
                columns = [b.column(c) for c in ("doc_id", "held_out", "text")]
                block = pa.array(numbers.of(b), pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, block], names=["doc_id", "held_out", "text", "block"])

    return parts.mapInArrow(lean(run), "doc_id long, held_out boolean, text string, block long")


def _ask(parts: DataFrame, n_shards: int, order: int) -> DataFrame:
    def ask(rows: list[tuple], block: int) -> Iterator[tuple]:
        texts, held, deleted = zip(*rows, strict=True)
        b = Block(list(texts), n_shards, order)
        for level, counts in enumerate(b.counts(~np.array(held))):
            for shard, i, j in b.shards(level):
                yield shard, block, level, deleted[0], j - i, pack(b.keys[level][i:j]), pack_counts(counts[i:j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[bool, tuple[int, list[tuple]]] = {}
        numbers = Numbers()

        def close(deleted):
            block, rows = open_.pop(deleted)
            for some in _some(ask(rows, block)):
                yield _batch(some, ASK)

        for b in batches:
            texts, _ = text_bytes(b.column("text"))
            held, deleted = (b.column(c).to_pylist() for c in ("held_out", "deleted"))
            for *row, block in zip(texts, held, deleted, numbers.of(b), strict=True):
                if row[2] in open_ and open_[row[2]][0] != block:
                    yield from close(row[2])
                open_.setdefault(row[2], (block, []))[1].append(tuple(row))
        for of_deleted in list(open_):
            yield from close(of_deleted)

    return parts.select("text", "held_out", "deleted", "part").mapInArrow(lean(run), ASK)


def _some(rows: Iterator[tuple], n: int = 64) -> Iterator[list[tuple]]:
    out = []
    for r in rows:
        out.append(r)
        if len(out) == n:
            yield out
            out = []
    if out:
        yield out


_KINDS = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], names=names)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the counts of a shard's keys and answers each block; one row without a block holds its totals."""
    asked: dict[int, list[tuple]] = {}
    shard = 0
    for b in batches:
        for r in b.to_pylist():
            shard = r["shard"]
            asked.setdefault(r["level"], []).append(
                (r["block"], r["deleted"], r["n"], unpack(r["keys"]), unpack_counts(r["counts"], r["n"]))
            )
    for level, rows in asked.items():
        keys, inverse = np.unique(np.concatenate([x[3] for x in rows]), return_inverse=True)
        n = np.concatenate([x[4] for x in rows])
        gone = np.concatenate([np.full(x[2], x[1]) for x in rows])
        total = np.bincount(inverse, n, len(keys))
        deleted = np.bincount(inverse, n * gone, len(keys))
        at = 0
        out = []
        for block, of_deleted, m, own, _ in rows:
            mine = inverse[at : at + m]
            at += m
            # only the blocks of deleted documents are ever scored without them
            out.append((block, level, shard, m, digest(own), pack_counts(total[mine]), pack_counts(deleted[mine]) if of_deleted else None, None, None, None))
        if level == 0:
            out.append((None, None, shard, 0, None, None, None, int(total.sum()), int((total > 0).sum()), int(deleted.sum())))
        for some in _some(iter(out)):
            yield _batch(some, ANSWER)


def _counted(block: Block, answers: list[dict]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Total and deleted counts of each order's grams, from a block's answers (deleted ones: if they were asked for)."""
    found = {(r["level"], r["shard"]): r for r in answers}
    total = [np.zeros(len(k)) for k in block.keys]
    deleted = [np.zeros(len(k)) for k in block.keys]
    for level in range(len(block.keys)):
        for shard, i, j in block.shards(level):
            r = found.get((level, shard))
            if r is None or r["n"] != j - i or r["asked"] != digest(block.keys[level][i:j]):
                raise RuntimeError("documents came in another order than before; write them as a table first")
            total[level][i:j] = unpack_counts(r["total"], j - i)
            if r.get("deleted") is not None:
                deleted[level][i:j] = unpack_counts(r["deleted"], j - i)
    return total, deleted


def _estimates(block: Block, counts: list[np.ndarray], n_tokens: int, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates (positions x orders) at all tokens, and the counts of the longest contexts."""
    at = np.flatnonzero(block.is_token)
    first = block.is_first[at]
    out = np.zeros((len(at), len(counts)))
    context = np.full(len(at), float(n_tokens))
    for k, c in enumerate(counts):
        if k:
            before = block.gram[k - 1][at - 1]
            context = np.where(first, n_texts, counts[k - 1][before])
        np.divide(c[block.gram[k][at]], context, out=out[:, k], where=context > 0)
    return out, context


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + floor(log2(count))."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)


def learn(cells: np.ndarray, estimates: np.ndarray, weight: np.ndarray, uniform: float, steps: int = EM_STEPS) -> dict[int, np.ndarray]:
    """Mixture weights of each bucket (orders from 1 on, then uniform), by expectation-maximisation."""
    out = {}
    for b in np.unique(cells):
        p = np.column_stack([estimates[cells == b], np.full(int((cells == b).sum()), uniform)])
        n = weight[cells == b]
        w = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(steps):
            part = p * w
            part /= part.sum(axis=1, keepdims=True)
            w = (part * n[:, None]).sum(axis=0) / n.sum()
        out[int(b)] = _floored(w)
    return out


def _floored(w: np.ndarray) -> np.ndarray:
    w = w.copy()
    w[-1] = max(w[-1], FLOOR)
    return w / w.sum()


def weights_table(learned: dict[int, np.ndarray], order: int, size: int = 66) -> np.ndarray:
    """Weights by bucket; a bucket without held-out positions takes those of the nearest smaller one (or larger)."""
    out = np.zeros((size, order + 1))
    known = sorted(learned)
    for b in range(size):
        near = [x for x in known if x <= b and (x > 0) == (b > 0)] or [x for x in known if x > 0 and b > 0]
        w = learned[near[-1] if near[-1] <= b else near[0]].copy() if near else np.full(order + 1, 1 / (order + 1))
        if b == 0 and order > 1:
            w[order - 1] = 0  # an unseen context has no estimate
        out[b] = _floored(w / w.sum())
    return out


def score_documents(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every document."""
    spark = documents.sparkSession
    n_shards = parts_for(total_bytes(documents), SHARD_BYTES)
    parts = _parts(documents)
    answers = cut(_ask(parts, n_shards, order).groupBy("shard").applyInArrow(lean(_answer), ANSWER), "answers")
    totals = answers.where("block is null").agg(F.sum("tokens"), F.sum("types"), F.sum("gone")).first()
    n_tokens, n_types, n_gone = (int(x or 0) for x in totals)
    texts = parts.groupBy().agg(F.count_if(~F.col("held_out")), F.count_if("deleted")).first()
    n_texts, n_deleted = int(texts[0]), int(texts[1])
    answers = answers.where("block is not null").select("block", "level", "shard", "n", "asked", "total", "deleted")
    odd = answers.where("block % 2 = 1")
    sides = lambda d, a: d.groupBy("block").cogroup(a.groupBy("block"))
    uniform = 1 / (n_types + 1)

    def open_block(left: pa.Table, right: pa.Table) -> tuple[Block, list, list]:
        trim()
        raw, _ = text_bytes(left.column("text").combine_chunks())
        block = Block(raw, n_shards, order)
        return block, *_counted(block, right.to_pylist())

    names = [f"q{k}" for k in range(order)]
    cell_schema = "bucket int, " + ", ".join(f"{q} int" for q in names) + ", n double, " + ", ".join(f"s{k} double" for k in range(order))

    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([_batch([], cell_schema)])
        block, total, deleted = open_block(left, right)
        main = [t - d for t, d in zip(total, deleted, strict=True)]
        p, context = _estimates(block, main, n_tokens - n_gone, n_texts - n_deleted)
        log = np.log2(np.maximum(p, 1e-300))
        q = np.where(p > 0, np.round(log / STEP), -9999).astype(np.int64)
        key, inverse = np.unique(np.column_stack([bucket(context), q]), axis=0, return_inverse=True)
        inverse = inverse.ravel()
        columns = [pa.array(key[:, 0], pa.int32()), *(pa.array(key[:, 1 + k], pa.int32()) for k in range(order))]
        columns += [pa.array(np.bincount(inverse).astype(float))]
        columns += [pa.array(np.bincount(inverse, np.where(p[:, k] > 0, log[:, k], 0.0))) for k in range(order)]
        return pa.table(columns, names=["bucket", *names, "n", *(f"s{k}" for k in range(order))])

    held = sides(_blocks(parts.where("deleted")).select("block", "text"), odd).applyInArrow(cells, cell_schema)
    sums = [F.sum("n").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(order))]
    table = held.groupBy("bucket", *names).agg(*sums).toPandas()
    n = table["n"].to_numpy(float)
    seen = np.column_stack([table[q].to_numpy() > -9999 for q in names]) if len(table) else np.zeros((0, order), bool)
    logs = np.column_stack([table[f"s{k}"].to_numpy(float) / n for k in range(order)]) if len(table) else np.zeros((0, order))
    learned = learn(table["bucket"].to_numpy(), np.where(seen, 2.0**logs, 0.0), n, uniform)
    mixture = weights_table(learned, order)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([_batch([], SCORES)])
        block, total, _ = open_block(left, right)
        p, context = _estimates(block, total, n_tokens, n_texts)
        b = bucket(context)
        mixed = mixture[b, order] * uniform
        for k in range(order):
            mixed += p[:, k] * mixture[b, k]
        logs = np.log10(mixed)
        c = total[0][block.gram[0][block.is_token]]
        base = np.log10((c + 1) / (n_tokens + n_types + 1))
        doc, m = block.doc[block.is_token], left.num_rows
        return pa.table(
            [
                left.column("doc_id"),
                left.column("held_out"),
                pa.array(np.bincount(doc, minlength=m)),
                pa.array(np.bincount(doc[c > 0], minlength=m)),
                pa.array(np.full(m, n_tokens)),
                pa.array(np.bincount(doc, base, m)),
                pa.array(np.bincount(doc, logs, m)),
            ],
            names=[x.split()[0] for x in SCORES.split(", ")],
        )

    return sides(_blocks(parts), answers.drop("deleted")).applyInArrow(score, SCORES)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
