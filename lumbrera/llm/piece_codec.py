"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Encoding works on the distinct words of a chunk of texts. Their characters are laid out in one flat array, cut into segments
at places that no piece of the vocabulary spans. In each round every segment finds its lowest pair rank, all occurrences
of it are merged at once from the left, and the arrays are compacted; segments without a mergeable pair leave. Where a merge
could bring up a pair that ranks as low as the one just merged, only the leftmost occurrence is merged in that round,
which is the order of a priority queue.

Null texts count as empty; an empty text has the begin and end ids only. Repeated rows give repeated results.
A null doc_id stays null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from lumbrera.llm.common import bounded_batches, chunks, ragged, strings

SPACE = "▁"
NONE = np.int32(2**31 - 1)
REPLACEMENT = "�".encode()
#: Words or ids whose positions are laid out at a time.
SLICE = 1 << 16
#: Bytes of distinct words that are merged at a time.
WORD_BYTES = 1 << 18


class PieceCodec:
    """Tables of one BPE model with byte fallback, a dummy prefix and the identity normaliser."""

    def __init__(self, model: bytes) -> None:
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        plain = {p: i for i, p in enumerate(pieces) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))}
        score = np.array([lib.get_score(i) for i in range(n)])
        rank = np.searchsorted(np.unique(-score), -score).astype(np.int32)
        self.chars = np.full(0x110000, -1, np.int32)
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(n):
            if lib.is_byte(i):
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        keys, merged, risky, inner = [], [], np.zeros(n, bool), set()
        for p, i in plain.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
            inner.update(zip(p, p[1:], strict=False))
            for k in range(1, len(p)):
                a, b = plain.get(p[:k]), plain.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    merged.append(i)
                    risky[a] |= rank[a] >= rank[i]
                    risky[b] |= rank[b] >= rank[i]
        order = np.argsort(keys)
        self.n, self.rank, self.risky = n, rank, risky
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        self.inner = np.unique(np.array([ord(a) * 0x110000 + ord(b) for a, b in inner], np.int64))
        #: The bytes of each id. Begin and end have none.
        out = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) else " ⁇ ".encode() if lib.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.out_len = np.array([len(x) for x in out], np.int64)
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.is_byte = np.array([lib.is_byte(i) for i in range(n)])
        self.is_space = np.array([p.startswith(SPACE) for p in pieces])
        # A long run of spaces is full blocks from the left; where that holds, they are cut off beforehand.
        full = max((len(p) for p in plain if not p.strip(SPACE)), default=0)
        tail = lambda k, end: lib.encode(" " * k + end)
        fits = full > 1 and all(tail(6 * full + k, e) == [plain[SPACE * full]] * 3 + tail(3 * full + k, e) for k in range(full) for e in ("", "a", "Z", "."))
        self.block = full if fits else 0
        probe = "Probe 12  a▁b \U0001f600\n\tnaïve  "
        if self.encode(pa.array([probe]))[0].tolist() != lib.encode(probe):
            raise ValueError("the model is not a byte-fallback BPE with a dummy prefix and the identity normaliser")

    # Encoding -----------------------------------------------------------------------------------------------------

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what each pair merges to; NONE if it doesn't."""
        key = left.astype(np.int64) * self.n + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        ok = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        to = np.where(ok, self.merged[at], -1)
        return np.where(ok, self.rank[to], NONE), to

    def rounds(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over flat symbols (ids, or minus code point minus 1) of ascending segments; the final symbols and segments."""
        done_sym, done_seg = [], []
        rank, to = np.full(len(sym), NONE, np.int32), np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            same = seg[1:] == seg[:-1]
            r, t = self.pairs(sym[:-1], sym[1:])
            rank[:-1], to[:-1] = np.where(same, r, NONE), t
        while len(sym):
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(seg)])
            live = low < NONE
            if not live.all():
                keep = np.repeat(live, size)
                done_sym.append(sym[~keep])
                done_seg.append(seg[~keep])
                sym, seg, rank, to = sym[keep], seg[keep], rank[keep], to[keep]
                if not len(sym):
                    break
                low, size = low[live], size[live]
                first = np.cumsum(size) - size
            hit = np.flatnonzero(rank == np.repeat(low, size))
            # Of overlapping occurrences every second one, from the left.
            begins = np.r_[True, np.diff(hit) != 1]
            run = np.arange(len(hit))
            hit = hit[((run - np.maximum.accumulate(np.where(begins, run, 0))) & 1) == 0]
            risk = self.risky[to[hit]]
            if risk.any():
                lead = np.r_[True, seg[hit[1:]] != seg[hit[:-1]]]
                risky_seg = np.repeat(np.logical_or.reduceat(risk, np.flatnonzero(lead)), np.diff(np.r_[np.flatnonzero(lead), len(hit)]))
                hit = hit[lead | ~risky_seg]
            sym[hit] = to[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = np.cumsum(keep) - 1
            sym, seg, rank, to = sym[keep], seg[keep], rank[keep], to[keep]
            at = at[hit]
            at = np.unique(np.r_[at, at[at > 0] - 1])
            rank[at], to[at] = NONE, -1
            at = at[at + 1 < len(sym)]
            at = at[seg[at] == seg[at + 1]]
            rank[at], to[at] = self.pairs(sym[at], sym[at + 1])
        if not done_sym:
            return sym, seg
        sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
        order = np.argsort(seg, kind="stable")
        return sym[order], seg[order]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, a space before each, one after another, and their counts."""
        n = len(words)
        lens = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        code = np.frombuffer((SPACE + SPACE.join(words.to_pylist())).encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.cumsum(lens) - lens
        cut = np.ones(len(code), bool)
        key = code[:-1] * 0x110000 + code[1:]
        at = np.searchsorted(self.inner, key)
        at[at == len(self.inner)] = 0
        cut[1:] = self.inner[at] != key
        cut[first] = True
        if self.block and np.count_nonzero(blank := code == ord(SPACE)) > n + 4 * self.block:
            opens = np.r_[True, ~blank[:-1]]
            opens[first] = True
            ends = np.flatnonzero(opens | ~blank)
            for i in np.flatnonzero(opens & blank).tolist():
                j = np.searchsorted(ends, i, side="right")
                cut[np.arange(i, (ends[j] if j < len(ends) else len(code)) - 3 * self.block, self.block)] = True
        sym = self.chars[code]
        sym = np.where(sym >= 0, sym, -1 - code).astype(np.int32)
        word_of_seg = np.repeat(np.arange(n), lens)[cut]
        sym, seg = self.rounds(sym, (np.cumsum(cut) - 1).astype(np.int32))
        word = word_of_seg[seg]
        lost = np.flatnonzero(sym < 0)
        if len(lost):
            parts = [chr(-1 - int(c)).encode() for c in sym[lost]]
            rep = np.ones(len(sym), np.int64)
            rep[lost] = [len(p) for p in parts]
            sym, word = np.repeat(sym, rep), np.repeat(word, rep)
            sym[sym < 0] = self.byte_ids[np.frombuffer(b"".join(parts), np.uint8)]
        return sym, np.bincount(word, minlength=n)

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (no nulls), one after another, and their counts."""
        odd = pc.match_substring_regex(texts, f"  |{SPACE}|^ ")
        if pc.any(odd).as_py():
            texts = pa.array([spaced(t) if o else t for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)], pa.string())
        split = pc.split_pattern(texts, " ")
        found = pc.dictionary_encode(split.values.slice(split.offsets[0].as_py(), split.offsets[-1].as_py() - split.offsets[0].as_py()))
        # Merging takes some hundred bytes a character for a while, so it gets the distinct words by and by.
        parts = [self.words(b.column(0)) for b in chunks(pa.RecordBatch.from_arrays([found.dictionary], ["word"]), limit=WORD_BYTES)]
        ids, counts = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        start = np.cumsum(counts) - counts
        which = found.indices.to_numpy()
        per = np.diff(split.offsets.to_numpy())
        size = counts[which]
        flat = np.concatenate([ids[:0], *(ids[ragged(start[which[k : k + SLICE]], size[k : k + SLICE])] for k in range(0, len(which), SLICE))])
        ends = np.r_[0, np.cumsum(size)][np.cumsum(per)]
        number = np.diff(np.r_[0, ends])
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        if empty.any():  # an empty text has no dummy prefix
            flat = flat[~np.repeat(empty, number)]
            number = np.where(empty, 0, number)
        return flat, number

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, without begin and end."""
        flat, number = self.encode_flat(strings(texts))
        return np.split(flat, np.cumsum(number)[:-1]) if len(number) else []

    # Decoding -----------------------------------------------------------------------------------------------------

    def decode(self, flat: np.ndarray, number: np.ndarray) -> list[bytes]:
        """UTF-8 of each run of ids. One leading space of a text goes with the dummy prefix; bytes that are no UTF-8 become U+FFFD each."""
        size = self.out_len[flat]
        # The position of each byte takes several times what the bytes do.
        data = b"".join(self.out_bytes[ragged(self.out_at[flat[k : k + SLICE]], size[k : k + SLICE])].tobytes() for k in range(0, len(flat), SLICE))
        ends = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(number)]].tolist()
        tokens = np.r_[0, np.cumsum(number)].tolist()
        out = []
        for k in range(len(number)):
            one = data[ends[k] : ends[k + 1]]
            ids = flat[tokens[k] : tokens[k + 1]]
            try:
                if len(ids) > 2 and not self.out_len[ids[1:-1]].all():
                    one = b"".join(self.mended(ids))  # an id without bytes ends a run of byte ids
                one.decode()
            except UnicodeDecodeError:
                one = b"".join(self.mended(ids))
            if one[:1] == b" ":
                lead = ids[self.out_len[ids] > 0]
                if self.is_space[lead[0]]:
                    one = one[1:]
            out.append(one)
        return out

    def mended(self, ids: np.ndarray) -> Iterator[bytes]:
        """Pieces of UTF-8, with runs of byte ids decoded character by character."""
        run = b""
        for i in [*ids.tolist(), None]:
            if i is not None and self.is_byte[i]:
                run += self.out_bytes[self.out_at[i] : self.out_at[i] + 1].tobytes()
                continue
            while run:
                size = next((k for k in range(1, 5) if valid(run[:k])), 0)
                yield run[:size] if size else REPLACEMENT
                run = run[size or 1 :]
            if i is not None:
                yield self.out_bytes[self.out_at[i] : self.out_at[i] + self.out_len[i]].tobytes()


def valid(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def spaced(text: str) -> str:
    """Spaces after a space or a space symbol become space symbols, so that a split at spaces leaves runs of them whole."""
    text = text.replace(" ", SPACE)
    out, at, n = [], 0, len(text)
    while at < n:
        end = at
        while end < n and text[end] == SPACE:
            end += 1
        if end > at:
            out.append(SPACE * (end - at) if at == 0 else " " + SPACE * (end - at - 1))
        nxt = text.find(SPACE, end)
        nxt = n if nxt < 0 else nxt
        out.append(text[end:nxt])
        at = nxt
    return "".join(out)


@lru_cache(maxsize=2)
def codec(model: bytes) -> PieceCodec:
    return PieceCodec(model)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> with begin and end, n_tokens and the decoded text of each row. The driver reads the model file."""
    return run(docs, model_path, id_col, text_col, digest=False)


def digest_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 of each row."""
    return run(docs, model_path, id_col, text_col, digest=True)


def run(docs: DataFrame, model_path: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(model_path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(held.value)
        for whole in batches:
            for b in chunks(whole, 1):
                flat, number = own.encode_flat(strings(b.column(1)))
                ends = np.cumsum(number)
                ids = np.insert(flat, np.r_[0, ends[:-1]], own.bos)
                number = number + 1
                ids, number = np.insert(ids, np.cumsum(number), own.eos), number + 1
                texts = own.decode(ids, number)
                at = np.r_[0, np.cumsum(number)]
                if digest:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    edge = (at * 4).tolist()
                    sha = [hashlib.sha256(raw[edge[k] : edge[k + 1]]).hexdigest() for k in range(len(number))]
                    cols = [pa.array(number, pa.int64()), pa.array(sha), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    cols = [pa.array(number, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.array([t.decode() for t in texts])]
                    names = ["n_tokens", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    rest = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "n_tokens bigint, ids array<int>, decoded string"
    return docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {kind}, {rest}")
