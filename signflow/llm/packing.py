"""Packing of tokenised documents into fixed windows by non-negative least squares.

Documents are cut every ``window`` tokens; what is left of each is a remainder
shorter than the window.  The remainders' lengths, rounded up to units, make a
histogram over the whole corpus.  All combinations of at most three lengths
that fill the window are enumerated, and non-negative least squares finds how
often each should be repeated.  Each shard takes its share, rounded, and packs
what is left over greedily, cutting a remainder where that fills a gap.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signflow.llm.common import materialise, table

WINDOW = 2048
UNIT = 4
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Tokens that a shard should hold, so that its task's memory is bounded.
SHARD_TOKENS = 2_000_000
#: Words, and parts of words, that a worker keeps the ids of.
CACHE_WORDS = 400_000
#: Bytes of text that are encoded at a time, but for a single text that is longer.
CHUNK_BYTES = 16_000_000
#: Tokens that a packed sequence may lack before a remainder is cut to fill it.
SLACK = 8


# --- tokens -------------------------------------------------------------------


#: Words of which lower-casing and the tokenizer's pattern are the same here and there.
PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: The letters among them, and the signs that often end a word.
LETTERS = "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
STOPS = ".,!?;:"
#: Texts that tell whether a tokenizer works word by word: cases, contractions, digits, signs, accents, spaces, other scripts.
PROBES = ("", "a", "Hello World", " two  spaces ", "It's WE'LL i'm don't THEY'VE", "x1y22 3.14 1,000", "foo_bar __init__ a_b", "caf\u00e9 \u00dcber na\u00efve \u00c9COLE stra\u00dfe", "wait... what?! (yes) [no] {so}", "a-b--c e.g. U.S.A.", "tab\tline\nbreak\r\nend", "\u4e2d\u6587 \u65e5\u672c \u0440\u0443\u0441\u0441\u043a\u0438\u0439 \U0001f600", "$5 #tag @you 50% a&b <b>x</b> http://x.y/z?q=1", "\u201cquoted\u201d \u2014 dash\u2026")
PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class Recent(dict):
    """What ``make`` gives for a key, worked out when it is asked for.

    At most ``most`` keys are kept, in two halves: once the newer one is full it
    takes the place of the older one, of which only what is asked for again stays.
    """

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.make, self.half, self.older = make, max(1, most // 2), {}

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = got
        return got


class Encoder:
    """Ids (little-endian unsigned 32-bit) of texts, put together from those of their words.

    The tokenizer's own pattern never crosses white space, so a text's ids are
    those of its words between ASCII white space, one after the other; a tokenizer
    for which that isn't so is told by its ids of probe texts and of its own
    vocabulary, and used on whole texts.  Each different word of a batch is looked
    up once: one of plain letters and stops by its lower-case letters and by its
    stops, one of other plain signs by its parts; any other is encoded by itself.
    Both caches are bounded.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # fixed values: the byte-level alphabet, in which printable bytes stand for themselves
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [x for x in range(256) if x not in shown]
        self.spelling = {x: chr(x) for x in shown} | {x: chr(256 + k) for k, x in enumerate(hidden)}
        self.id_bytes = [i.to_bytes(4, "little") for i in range(max(self.tok.get_vocab().values(), default=0) + 1)]
        self._forget()
        self.by_words = self._fits()

    def _forget(self) -> None:
        self.words, self.parts = Recent(self._word, CACHE_WORDS), Recent(self._part, CACHE_WORDS)

    def _fits(self) -> bool:
        """Whether the tokenizer splits, lower-cases and spells as this class does; if not, texts are encoded whole."""
        from itertools import islice

        probes = [*PROBES, *islice(self.tok.get_vocab(), 4096)]
        try:
            return all(self._by_words(pa.array([x]))[0].tobytes() == self._whole(x) for x in probes)
        except Exception:  # a model without byte spelling may refuse a part
            return False
        finally:
            self._forget()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """The ids of one part, straight from the tokenizer's model, to which bytes are spelled as characters."""
        spelled = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.spelling)
        return b"".join([self.id_bytes[t.id] for t in self.tok.model.tokenize(spelled)])

    def _word(self, w: str) -> bytes:
        if not PLAIN.fullmatch(w) or "<|" in w:
            return self._whole(w)
        w = w.lower()
        return self._part(w) if w.isalpha() else b"".join([self.parts[p] for p in PART.findall(w)])

    def _ids(self, words: pa.Array) -> pa.Array:
        """The ids of each word, looked up once where words repeat."""
        coded = words.dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False)
        return pa.array(list(map(self.words.__getitem__, known)), pa.binary()).take(coded.indices)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.column(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, ends)[:-1]]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and where each text ends."""
        if self.by_words:
            return self._by_words(texts)
        ids = [self._whole(x) for x in texts.to_pylist()]
        return np.frombuffer(b"".join(ids), "<u4"), np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        word = words.dictionary
        after = pc.utf8_ltrim(word, LETTERS)
        plain = pc.and_(pc.less(pc.binary_length(after), pc.binary_length(word)), pc.equal(pc.ascii_trim(after, STOPS), ""))
        stem = pc.if_else(plain, pc.utf8_lower(pc.ascii_rtrim(word, STOPS)), word)
        ids = pc.binary_join_element_wise(self._ids(stem), self._ids(pc.if_else(plain, after, "")), b"")
        size = pc.binary_length(ids).to_numpy(zero_copy_only=False) // 4
        code = words.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[code], dtype=np.int64)])[np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)]
        data = ids.take(words.indices).buffers()[2]
        return np.frombuffer(data or b"", "<u4", int(ends[-1]) if len(ends) else 0), ends


@lru_cache(maxsize=4)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def chunks(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in slices of at most ``most`` bytes in the column, or of one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = total = 0
    for i, n in enumerate(size.tolist()):
        if i > at and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if len(size):
        yield batch.slice(at)


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens binary, n_tokens long): little-endian unsigned 32-bit ids and then ``end_id``.

    A null text is empty; null ids and repeated rows stay, an empty table gives
    an empty table, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer_path)
        for whole in batches:
            for b in chunks(whole, 1, CHUNK_BYTES):
                ids, ends = enc.column(pc.fill_null(b.column(1), ""))
                ids = np.insert(ids, ends, end_id)
                at = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
                tokens = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([b.column(0), tokens, pa.array(np.diff(at))], names=["doc_id", "tokens", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, tokens binary, n_tokens long")


# --- the plan -----------------------------------------------------------------


@lru_cache(maxsize=8)
def strategies(units: int) -> np.ndarray:
    """(m, 3) all multisets of at most three lengths that add up to ``units``, descending, 0 for none."""
    out = []
    for a in range((units + 2) // 3, units + 1):
        b = np.arange((units - a + 1) // 2, min(a, units - a) + 1)
        out.append(np.stack([np.full(len(b), a), b, units - a - b], axis=1))
    return np.concatenate(out)


def solve_nnls(hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of ``strategies`` that bring their lengths nearest to ``hist`` (index: length in units).

    Long lengths weigh more, as they are harder to place later.  Accelerated
    projected gradient; the matrix has three entries a column and is never built.
    """
    units = len(hist) - 1
    s = strategies(units)
    w = np.sqrt(np.arange(units + 1) / units)
    w[0] = 0.0
    target = hist * w
    flat = s.ravel()

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, 3), units + 1) * w

    def back(r: np.ndarray) -> np.ndarray:
        return (r * w)[s].sum(axis=1)

    v = np.ones(len(s))
    for _ in range(30):
        v = back(forward(v))
        v /= (size := np.linalg.norm(v)) or 1.0
    x = y = np.zeros(len(s))
    t, step = 1.0, 1.0 / max(size * 1.01, 1e-9)
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(forward(y) - target))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def pack_shard(lengths: np.ndarray, repeats: np.ndarray, window: int = WINDOW, unit: int = UNIT) -> list[list[tuple[int, int, int]]]:
    """Sequences, as lists of (document, start, length), that hold every token of the documents once.

    ``repeats``: the wanted, fractional, number of each of ``strategies``.
    """
    units = window // unit
    out: list[list[tuple[int, int, int]]] = []
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(units + 1)]
    for doc, n in enumerate(lengths.tolist()):
        whole = n // window * window
        out += [[(doc, at, window)] for at in range(0, whole, window)]
        if n > whole:
            bins[-(-(n - whole) // unit)].append((doc, whole, n - whole))
    left = np.array([len(b) for b in bins])
    s = strategies(units)
    want = np.rint(repeats).astype(np.int64)

    def take(combo: list[int], times: int) -> None:
        for _ in range(times):
            out.append([bins[k].pop() for k in combo if k])

    def most(combo: list[int]) -> int:
        return min(int(left[k]) // combo.count(k) for k in combo if k)

    for limit in (want, None):
        # first as the plan says, then whatever the rounding has left, likelier combinations first
        order = np.argsort(-repeats, kind="stable")
        order = order[repeats[order] > (0.5 if limit is not None else 1e-3)]
        for j in order.tolist():
            combo = s[j].tolist()
            if times := min(most(combo), int(limit[j]) if limit is not None else 1 << 60):
                take(combo, times)
                for k in combo:
                    left[k] -= times * bool(k)
    # the rest: longest first, filled with the longest that fit, and cut where a gap stays
    have = np.flatnonzero(left[1:]) + 1
    top = int(have.max()) if len(have) else 0
    while top:
        row, room = [], window
        while room > 0:
            k = min(top, room // unit)
            while k and not bins[k]:
                k -= 1
            if k:
                piece = bins[k].pop()
            else:
                k = top
                while k and not bins[k]:
                    k -= 1
                if not k or room <= SLACK and row:
                    break
                doc, at, n = bins[k].pop()
                piece = (doc, at, min(n, room))
                if n > room:
                    bins[-(-(n - room) // unit)].append((doc, at + room, n - room))
            row.append(piece)
            room -= piece[2]
            while top and not bins[top]:
                top -= 1
        out.append(row)
    return _tail(out, window)


def _tail(out: list[list[tuple[int, int, int]]], window: int) -> list[list[tuple[int, int, int]]]:
    """The last sequence, where it is not full, cut into sequences of powers of two, which need no padding."""
    if not out or sum(p[2] for p in out[-1]) >= window - SLACK:
        return out
    rest, size = out.pop()[::-1], window
    total = sum(p[2] for p in rest)
    while total:
        while size > total:
            size //= 2
        row, room = [], size
        while room:
            doc, at, n = rest.pop()
            row.append((doc, at, min(n, room)))
            if n > room:
                rest.append((doc, at + room, n - room))
            room -= row[-1][2]
        out.append(row)
        total -= size
    return out


def pack(tokens: DataFrame, window: int = WINDOW, unit: int = UNIT, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces: doc_id, start, length, tokens (binary), doc_tokens, sequence_id, offset.

    ``tokens`` is what ``tokenise`` returns, read twice: store it first.  Each
    row is a document of its own, also where rows or ids repeat or an id is
    null.  The histogram that reaches the driver has window / unit counts at
    most.  Shards are dealt by a hash of id and tokens, and hold a bounded number
    of tokens, but for a single document that is larger than that.
    """
    units = window // unit
    hist = np.zeros(units + 1)
    total = 0
    by_len = tokens.groupBy(F.ceil(F.col("n_tokens") % window / unit).cast("int").alias("k")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    for k, n, t in by_len.collect():
        hist[k] += n
        total += t
    hist[0] = 0
    shards = max(1, -(-total // shard_tokens))
    repeats = solve_nnls(hist) / shards

    def run(key: tuple, t: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(t.select(["doc_id", "n_tokens", "mix"]), [("doc_id", "ascending"), ("n_tokens", "ascending"), ("mix", "ascending")])
        t = t.take(order)
        rows = t.column("tokens").to_pylist()
        ids = t.column("doc_id").to_pylist()
        lengths = t.column("n_tokens").to_numpy()
        base = key[0].as_py() << 32
        out: list[tuple] = []
        for q, row in enumerate(pack_shard(lengths, repeats, window, unit)):
            at = 0
            for doc, start, n in row:
                out.append((ids[doc], start, n, rows[doc][4 * start : 4 * (start + n)], int(lengths[doc]), base + q, at))
                at += n
        cols = list(zip(*out)) if out else [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "length", "tokens", "doc_tokens", "sequence_id", "offset"])

    mixed = tokens.withColumn("mix", F.xxhash64("doc_id", "tokens"))
    dealt = mixed.withColumn("shard", F.pmod("mix", F.lit(int(shards))).cast("long"))
    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, **kw) -> DataFrame:
    """Tokenise and pack: texts are read and encoded once, their ids kept in the shared folder.

    A null text is empty and gives a piece of one token; null ids and repeated
    rows are documents of their own; an empty table gives no pieces.  A document
    is one row, so its tokens are in one task, however many they are.
    """
    return pack(materialise(tokenise(docs, tokenizer_path), "tokens"), **kw)


def pieces(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    out = pack_documents(docs, public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"))
