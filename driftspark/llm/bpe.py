"""BPE encoding and decoding by a tokenization automaton.

The automaton accepts exactly the token sequences that BPE yields. It starts as one state with an arc for every base
symbol; each merge (u, v), in rank order, splices in a gadget: the state q behind u is replaced, for u, by a copy
without the arc v, and every state that has u gets an arc uv to where v leads. All arcs of one token lead to one state,
so a state is stored as the bit set of its outgoing tokens (tokens that the same states allow share a bit) and a token as
the state that it leads to. Encoding a pre-split word is one pass over its bytes by tables: a goto table over all tokens'
labels (with failure links) moves by one byte and names the tokens that end there, longest first; the canonical sequence
of every prefix is unique, so exactly one of them is an arc out of the live state where it starts, and the bit sets say
which. Decoding emits the arcs' labels.

The new words of a piece of text are encoded together: all their bytes walk the goto table at once, each as a start (so
without failure links), and the arcs that are found pass on the live states, one end after the other in all words at
once. Words of more than ``LONG_WORD`` bytes go one by one. No rule of the splitter matches white space or looks around, so
what stands between white space is split and encoded alone, and a task remembers it as it stands.

The tables have at most one state per token that is ever the left half of a merge (some thousands), whatever the data.

Defined results: a null or empty text has no tokens and decodes to the empty text; repeated rows are kept; further
columns are ignored; an empty table gives no rows; a document is encoded whole, whatever its length, and words of any
length take linear time; a vocabulary file with another normaliser, splitter or decoder than ``RULES`` raises.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm._common import lean, pieces, small_batches, trim

#: Words, and characters in them, that a task remembers; when there are more, it keeps those of the piece at hand.
CACHE_WORDS, CACHE_CHARS = 300_000, 1 << 24
#: Characters of texts that are split at once, and of words that are encoded at once.
PIECE, PART = 1 << 19, 1 << 16
#: Bytes of a word that is encoded with others.
LONG_WORD = 64
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: how a normalised text is split into words.
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_UNSPACED = regex.compile(f"[^{_SPACE}]+")
#: What ``str.split`` takes for white space, too.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: What a vocabulary file says of these rules, which are written out below.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}
#: What is added to a word's last byte: tokens with a word end have symbols of their own.
LAST_BYTE = 256
#: What stands behind a word: no byte, so no edge.
STOP = 2 * LAST_BYTE
SCHEMA = "doc_id long, text string, ids binary, decoded string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable Latin-1, else from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class Automaton:
    """Compiled merges. ``bits`` holds the states' sets of allowed token classes, ``width`` bytes each, ``group[token]`` is a
    token's class and ``leads[token]`` the state behind it. ``symbols`` and ``first`` are the goto table (the edges of node
    i are ``first[i]`` to ``first[i + 1]``, edge k leads to node k + 1), ``fail`` its failure links; ``token``, ``shorter``
    and ``depth`` give a node's token, the next node with a shorter one, and its length. The same table without a search:
    node i's edge x is at ``place[i] + x``, if ``owner`` says i there, and leads to ``child``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if other := [k for k, v in RULES.items() if spec.get(k) != v]:
            raise ValueError(f"{path}: unsupported {', '.join(other)}")
        model = spec["model"]
        end, ids = model["end_of_word_suffix"], model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        n = max([*ids.values(), *self.special.values()]) + 1
        self.labels = [""] * n
        for text, i in [*ids.items(), *self.special.items()]:
            self.labels[i] = text
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self._compile([(ids[a], ids[b], ids[a + b]) for a, b in merges], n)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        words = {}
        for text, t in ids.items():
            if text not in self.special:
                *most, last = (byte[c] for c in text.removesuffix(end))
                words[(*most, last + LAST_BYTE * text.endswith(end))] = t
        self._spell(words)

    def _spell(self, words: dict[tuple[int, ...], int]) -> None:
        """The goto table of all tokens' symbols, nodes numbered level by level."""
        prefixes = sorted({w[:k] for w in words for k in range(1, len(w) + 1)}, key=lambda w: (len(w), w))
        node = {(): 0}
        for w in prefixes:
            node[w] = len(node)
        # levels are sorted by prefix, so a node's edges are neighbours and edge k leads to node k + 1
        self.symbols = array("H", (w[-1] for w in prefixes))
        count = np.bincount([node[w[:-1]] for w in prefixes], minlength=len(node))
        self.first = array("i", np.concatenate(([0], np.cumsum(count))).tolist())
        self.depth = array("H", [0, *map(len, prefixes)])
        self.token = array("i", [-1, *(words.get(w, -1) for w in prefixes)])
        self.fail, self.shorter = array("i", [0]) * len(node), array("i", [0]) * len(node)
        for w in prefixes:
            at, up = node[w], next(node[w[k:]] for k in range(1, len(w) + 1) if w[k:] in node)
            self.fail[at], self.shorter[at] = up, up if self.token[up] >= 0 else self.shorter[up]
        self._place()

    def _place(self) -> None:
        """Lays the nodes' edges into one table: nodes with many go first, those with one into the gaps."""
        first, symbols = np.array(self.first), np.array(self.symbols, np.int64)
        count = np.diff(first)
        place = np.zeros(len(count), np.int64)
        window, room = np.arange(512), STOP + 1
        owner = np.full(2 * len(symbols) + 4 * room, -1, np.int32)
        child = np.zeros(len(owner), np.int32)
        low = last = 0
        for i in np.argsort(-count, kind="stable")[: np.count_nonzero(count > 1)].tolist():
            if count[i] != last:
                low, last = 0, count[i]
            x = symbols[first[i] : first[i + 1]]
            while True:
                if low + len(window) + 2 * room > len(owner):
                    owner, child = np.append(owner, np.full_like(owner, -1)), np.append(child, np.zeros_like(child))
                fits = (owner[(low + window)[:, None] + x] < 0).all(axis=1)
                if fits.any():
                    break
                low += len(window)
            low += int(fits.argmax())
            place[i] = low
            owner[low + x], child[low + x] = i, np.arange(first[i], first[i + 1]) + 1
        single = np.flatnonzero(count == 1)
        while len(gaps := np.flatnonzero(owner[room:-room] < 0) + room) < len(single):
            owner, child = np.append(owner, np.full_like(owner, -1)), np.append(child, np.zeros_like(child))
        gaps, edge = gaps[: len(single)], first[single]
        place[single] = gaps - symbols[edge]
        owner[gaps], child[gaps] = single, edge + 1
        size = int(place.max()) + room
        self.place, self.owner, self.child = place.astype(np.int32), owner[:size].copy(), child[:size].copy()

    def _compile(self, merges: list[tuple[int, int, int]], n: int) -> None:
        made = {uv for _, _, uv in merges}
        if len(made) != len(merges):
            raise ValueError("two merges make the same token")
        most = len({u for u, _, _ in merges}) + 1
        table = np.zeros((2 * most, -(-n // 8)), np.uint8)  # states x tokens, as bits
        leads = np.zeros(n, np.int64)
        for t in range(n):
            if t not in made:
                table[0, t >> 3] |= 1 << (t & 7)
        users = np.zeros(len(table), np.int64)  # tokens that lead to a state
        users[0] = n
        used, free = 1, []
        for u, v, uv in merges:
            q, behind = leads[u], leads[v]  # with u = v, the second v still leads to what may follow a whole pair
            if table[q, v >> 3] >> (v & 7) & 1:
                if users[q] == 1 and q and u != v:
                    own = q
                else:
                    if free:
                        own = free.pop()
                    else:
                        if used == len(table):
                            table, users = np.vstack([table, np.zeros_like(table)]), np.append(users, np.zeros_like(users))
                        own, used = used, used + 1
                    table[own] = table[q]
                    users[q] -= 1
                    users[own] = 1
                    leads[u] = own
                table[own, v >> 3] &= 0xFF ^ (1 << (v & 7))
            else:
                continue  # v never follows u here: an earlier merge takes them apart
            # every state with an arc u gets an arc uv: it leads where v leads
            allowed = (table[:used, u >> 3] >> (u & 7)) & 1
            table[:used, uv >> 3] |= allowed << (uv & 7)
            old = leads[uv]
            leads[uv] = behind
            users[behind] += 1
            users[old] -= 1
            if not users[old] and old:
                free.append(old)
        live, leads = np.unique(np.append(0, leads), return_inverse=True)
        # states with equal arcs are one state
        seen: dict[bytes, int] = {}
        same = np.array([seen.setdefault(hashlib.sha256(table[s].tobytes()).digest(), len(seen)) for s in live.tolist()])
        states = live[np.unique(same, return_index=True)[1]]
        self.leads = array("i", same[leads[1:]].tolist())
        self.start = int(same[leads[0]])
        # tokens that the same states allow are one class: columns of the table that are equal
        group: dict[bytes, int] = {}
        self.group = array("i", [0]) * n
        kept = []
        for low in range(0, n, 512):
            columns = np.unpackbits(table[states, low >> 3 : (low + 512) >> 3], axis=1, bitorder="little").T
            for t, column in enumerate(np.packbits(columns, axis=1, bitorder="little")[: n - low], low):
                key = hashlib.sha256(raw := column.tobytes()).digest()
                if key not in group:
                    group[key] = len(group)
                    kept.append(np.frombuffer(raw, np.uint8))
                self.group[t] = group[key]
        count = len(states)
        del seen, table, allowed
        back = lambda x: np.packbits(np.unpackbits(np.array(x), axis=1, count=count, bitorder="little").T, axis=1, bitorder="little")
        bits = np.hstack([back(kept[i : i + 512]) for i in range(0, len(kept), 512)])
        self.bits, self.width = bits.tobytes(), bits.shape[1]

    def encode_word(self, word: bytes) -> list[int]:
        """Tokens of a pre-split word."""
        symbols, first, fail, token, shorter, depth = self.symbols, self.first, self.fail, self.token, self.shorter, self.depth
        bits, width, group = self.bits, self.width, self.group
        path = [*word[:-1], word[-1] + LAST_BYTE]
        state = [self.start] + [-1] * len(path)
        node = 0
        into, back = [0] * len(state), [0] * len(state)
        for i, x in enumerate(path, 1):
            while True:
                top = first[node + 1]
                k = bisect_left(symbols, x, first[node], top)
                if k < top and symbols[k] == x:
                    node = k + 1
                    break
                if not node:
                    break
                node = fail[node]
            at = node if token[node] >= 0 else shorter[node]
            while at:
                t, j = token[at], i - depth[at]
                g = group[t]
                if state[j] >= 0 and bits[state[j] * width + (g >> 3)] >> (g & 7) & 1:
                    state[i], into[i], back[i] = self.leads[t], t, j
                    break
                at = shorter[at]
        out, i = [], len(path)
        while i:
            out.append(into[i])
            i = back[i]
        return out[::-1]

    def encode_words(self, words: list[str]) -> tuple[bytes, np.ndarray]:
        """Tokens of pre-split words as little-endian unsigned 32-bit integers, and how many each word has."""
        ids, counts = [], []
        for low, high in pieces(np.fromiter(map(len, words), np.int64, len(words)), PART):
            if high == low + 1:
                one = np.array(self.encode_word(words[low].encode()), "<u4")
                part, n = one.tobytes(), [len(one)]
            else:
                part, n = self._together((" ".join(words[low:high]) + " ").encode())
            ids.append(part)
            counts.append(n)
        return b"".join(ids), np.concatenate(counts)

    def _together(self, words: bytes) -> tuple[bytes, np.ndarray]:
        """Tokens of words with a space, which no edge passes, behind each."""
        token, group, leads = (np.frombuffer(x, np.int32) for x in (self.token, self.group, self.leads))
        bits = np.frombuffer(self.bits, np.uint8)
        symbols = np.frombuffer(words, np.uint8).astype(np.int32)
        ends = np.flatnonzero(symbols == ord(" "))
        starts = np.append(0, ends[:-1] + 1)
        sizes = ends - starts
        symbols[ends - 1] += LAST_BYTE
        symbols[ends] = STOP
        begin = np.repeat(starts, sizes + 1)
        long = np.flatnonzero(sizes > LONG_WORD)
        at = np.flatnonzero((symbols != STOP) & np.repeat(sizes <= LONG_WORD, sizes + 1))
        to, node = at, np.zeros(len(at), np.int32)
        found = []
        while len(at):
            slot = self.place[node] + symbols[to]
            live = np.flatnonzero(self.owner[slot] == node)
            at, to, node = at[live], to[live] + 1, self.child[slot[live]]
            t = token[node]
            arc = np.flatnonzero(t >= 0)
            found.append((at[arc], to[arc], t[arc]))
        at, to, t = (np.concatenate(x) for x in zip(*found, strict=True))
        far = (to - begin[to]).astype(np.uint16)
        order = np.argsort(far, kind="stable")
        at, to, t = at[order], to[order], t[order]
        where, bit, behind = group[t] >> 3, group[t] & 7, leads[t]
        state, into, back = np.full(len(symbols), -1, np.int64), np.zeros(len(symbols), "<u4"), begin.copy()
        state[starts] = self.start
        low = 0
        for high in np.cumsum(np.bincount(far)).tolist():
            s = state[at[low:high]]
            ok = low + np.flatnonzero((s >= 0) & (bits[s * self.width + where[low:high]] >> bit[low:high] & 1 > 0))
            hit = to[ok]
            state[hit], into[hit], back[hit] = behind[ok], t[ok], at[ok]
            low = high
        used, last = np.zeros(len(symbols), bool), ends[sizes <= LONG_WORD]
        while len(last):
            used[last] = True
            last = back[last]
            last = last[last > begin[last]]
        for x, y in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            one = self.encode_word(words[x:y])
            into[x : x + len(one)], used[x : x + len(one)] = one, True
        return into[used].tobytes(), np.add.reduceat(used, starts, dtype=np.int64)


class Coder:
    """Normalises, splits, encodes and decodes texts with an automaton; remembers words."""

    def __init__(self, automaton: Automaton):
        self.a = automaton
        # an added token's key is its number, as a word may read like it
        self.added: dict[str | int, bytes] = {i: i.to_bytes(4, "little") for i in automaton.special.values()}
        self.known, self.chars = dict(self.added), 0
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, automaton.special)) + ")")
        self.marks = tuple(automaton.special)

    def _plain(self, text: str) -> list[str]:
        """What stands between the white space of a normalised text."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        return _UNSPACED.findall(text) if any(c in text for c in _SEPARATORS) else text.split()

    def _units(self, text: str) -> list[str | int]:
        if not any(m in text for m in self.marks):
            return self._plain(text)
        special, out = self.a.special, []
        for x in self.split_special.split(text):
            if x in special:
                out.append(special[x])
            elif x:
                out += self._plain(x)
        return out

    def _learn(self, units: set[str | int]) -> None:
        """Encodes what is not known yet."""
        known = self.known
        if len(known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            known = self.known = self.added | {x: known[x] for x in units.intersection(known)}
            self.chars = sum(len(x) for x in known if isinstance(x, str))
        new = list(units.difference(known))
        if not new:
            return
        words = _SPLIT.findall(" ".join(new))
        ids, counts = self.a.encode_words(words)
        # a unit ends with the word up to which as many characters have gone
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        last = np.searchsorted(np.cumsum(np.fromiter(map(len, words), np.int64, len(words))), np.cumsum(sizes))
        cuts = (4 * np.cumsum(counts)[last]).tolist()
        known.update(zip(new, (ids[x:y] for x, y in zip([0, *cuts], cuts, strict=False)), strict=True))
        self.chars += int(sizes.sum())

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit integers."""
        out = []
        for low, high in pieces(np.array([len(t or "") for t in texts]), PIECE):
            units = [self._units(t) if t else [] for t in texts[low:high]]
            self._learn(set().union(*units))
            out += [b"".join(map(self.known.__getitem__, x)) for x in units]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_texts([text])[0]

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, joined by spaces, as the vocabulary's file names no other decoder."""
        return " ".join(map(self.a.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _coded(documents: DataFrame, vocabulary: str, batch, schema: str) -> DataFrame:
    """``batch(coder, record batch)`` over documents; a task has one coder, which goes with it."""
    small_batches(documents.sparkSession)
    automaton = Automaton(vocabulary)
    trim()
    shared = documents.sparkSession.sparkContext.broadcast(automaton)
    del automaton

    def run(batches):
        coder = Coder(shared.value)
        for b in batches:
            if b.num_rows:
                yield batch(coder, b)
        # an idle worker need not hold the tables; the next task reads them from its local copy again
        shared.__dict__.pop("_value", None)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), schema)


def encode_documents(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text, ids (little-endian unsigned 32-bit integers) and decoded text of every document.

    ``vocabulary`` is a path on the driver; the compiled tables, whose size the vocabulary bounds, are broadcast."""

    def batch(coder: Coder, b: pa.RecordBatch) -> pa.RecordBatch:
        ids = coder.encode_texts(b.column("text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text"), pa.array(ids, pa.binary()), pa.array(map(coder.decode, ids), pa.string())],
            names=["doc_id", "text", "ids", "decoded"],
        )

    return _coded(documents, vocabulary, batch, SCHEMA)


def digest_documents(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as ``encode_documents``, but only digests leave the worker."""

    def batch(coder: Coder, b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for ids in coder.encode_texts(b.column("text").to_pylist()):
            decoded = coder.decode(ids).encode()
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        n, a, d = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return _coded(documents, vocabulary, batch, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
