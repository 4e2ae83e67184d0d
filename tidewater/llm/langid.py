"""Language identification by prediction by partial matching (operator 10).

For each language a byte context tree of order 3 is counted over labelled
training rows and then frozen. A byte costs -log2 of its PPM probability:
escape method C with exclusions, from the longest context the tree holds down to
a uniform order -1. Code lengths are exact under those statistics; the shortest
total wins, and the score is the winner's posterior at equal priors.

All order-3 contexts of the training rows are kept, with the shorter ones behind
them. Tables grow with the distinct contexts of the sample, not with the corpus.

Training reads at most about ``train_rows`` rows a language, chosen by a hash of
the identifier; every text is predicted whole, very long ones too, in pieces of
memory bounded by the longest text. Null texts and texts without a letter give
``und`` with score 0. Ties go to the first language in order of name. With no
training rows everything is ``und``, and an empty table gives an empty table.
Repeated rows give their result again, rows without an identifier too; other
columns are ignored, whatever their names.

Only the text goes to Python; the rows themselves stay in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import SLICE_BYTES, bounded_batches, slices, table, text_buffers

LETTER = re.compile(r"[^\W\d_]")
SPACE = 32


def padded(raw: np.ndarray, offs: np.ndarray, order: int, lut: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all rows with ``order`` pads before each, and where each row's bytes begin."""
    n, rows = len(raw), len(offs) - 1
    lens = np.diff(offs)
    starts = offs[:-1] + order * np.arange(1, rows + 1)
    out = np.full(n + order * rows, pad, lut.dtype)
    out[np.arange(n) + np.repeat(order * np.arange(1, rows + 1), lens)] = lut[raw]
    return out, starts


def gram_counts(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 4-grams of bytes, the first three of them context, and their counts."""
    seq, starts = padded(raw, offs, 3, np.arange(256, dtype=np.uint8), SPACE)
    at = np.arange(len(raw)) + np.repeat(starts - offs[:-1], np.diff(offs))
    s = seq.astype(np.uint32)
    return np.unique((s[at - 3] << 24) | (s[at - 2] << 16) | (s[at - 1] << 8) | s[at], return_counts=True)


class ContextTables:
    """Frozen code lengths of a byte under every language.

    Exclusions nest, since a symbol seen after three bytes is seen after the last
    two as well. So only the 4-grams of the training rows need entries of their
    own; the cost of any other byte is the sum of what its order-3 context (``base``)
    and its order-2 context (``tail``) say.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray):
        self.langs = langs
        weight = np.bincount(gram & 255, weights=count, minlength=256)
        seen = [b for b in range(256) if weight[b] > 0 or b == SPACE]
        symbols = {b: i for i, b in enumerate(seen)}
        a = self.symbols = len(seen) + 1  # the last one: bytes never seen
        lut = np.full(256, a - 1, np.uint8)
        for b, i in symbols.items():
            lut[b] = i
        self.lut, self.pad = lut, int(symbols[SPACE])
        bytes_of = np.ones(a)  # bytes that a symbol stands for
        bytes_of[-1] = 256 - len(seen)
        c3, c2, c1, c0 = (lut[(gram >> shift) & 255].astype(np.int64) for shift in (24, 16, 8, 0))
        pairs, q = np.unique(c2 * a + c1, return_inverse=True)  # rows of order 2, then one for each last byte alone
        triples, r = np.unique((c3 * a + c2) * a + c1, return_inverse=True)  # rows of order 3, then one for each row of order 2
        n2, n3 = len(pairs), len(triples)
        row2 = n2 + np.arange(a * a) % a
        row2[pairs] = np.arange(n2)
        self.rows = (n3 + row2[np.arange(a**3) % (a * a)]).astype(np.int32)
        self.rows[triples] = np.arange(n3)
        self.row2 = np.concatenate([row2[triples % (a * a)], np.arange(n2 + a)]).astype(np.int32)
        grams, entry = np.unique(r * a + c0, return_inverse=True)
        self.slot = np.full((n3, a), -1, np.int32)
        self.slot.ravel()[grams] = np.arange(len(grams))
        shape = (len(langs), n2 + a, a)
        self.full, self.base = np.zeros((len(langs), len(grams)), np.float32), np.zeros((len(langs), len(self.row2), 2), np.float32)
        self.tail, self.flag = np.zeros(shape, np.float32), np.zeros(shape, bool)
        log = lambda x: np.log2(np.maximum(x, 1e-300))
        for k in range(len(langs)):
            mine = lang == k
            n = count[mine].astype(np.float64)
            order0 = np.bincount(c0[mine], weights=n, minlength=a).reshape(1, a)
            order1 = np.bincount(c1[mine] * a + c0[mine], weights=n, minlength=a * a).reshape(a, a)
            order2 = np.zeros((n2 + a, a))
            order2[:n2] = np.bincount(q[mine] * a + c0[mine], weights=n, minlength=n2 * a).reshape(n2, a)
            n4 = np.bincount(entry[mine], weights=n, minlength=len(grams))
            at, sym = grams // a, grams % a
            held = n4 > 0
            sums = lambda values: np.bincount(at[held], weights=values[held], minlength=n3)
            t3, k3 = sums(n4), sums(np.ones(len(grams)))
            under = order2[self.row2[at], sym]
            far = self.row2  # what is left of the order-2 row of each order-3 row, without the symbols seen at order 3
            t2 = order2.sum(1)[far] - np.append(sums(under), np.zeros(n2 + a))
            k2 = (order2 > 0).sum(1)[far] - np.append(k3, np.zeros(n2 + a))
            escape3 = np.append(np.where(t3 > 0, log(t3 + k3) - log(k3), 0.0), np.zeros(n2 + a))
            self.base[k, :, 1] = escape3 + log(t2 + k2)
            self.base[k, :, 0] = escape3 + np.where(t2 > 0, log(t2 + k2) - log(k2), 0.0)
            last = np.append(pairs % a, np.arange(a))
            for part in range(0, n2 + a, 1024):
                own = slice(part, part + 1024)
                self.tail[k, own] = self._cost([order1[last[own]], order0], bytes_of, order2[own] > 0)
            self.flag[k] = order2 > 0
            self.tail[k][self.flag[k]] = -log(order2[self.flag[k]])
            flag = self.flag[k][self.row2[at], sym]
            self.full[k] = np.where(held, log((t3 + k3)[at]) - log(n4), self.base[k][at, flag.astype(int)] + self.tail[k][self.row2[at], sym])

    @staticmethod
    def _cost(orders: list[np.ndarray], bytes_of: np.ndarray, out: np.ndarray) -> np.ndarray:
        """PPM-C with exclusions for many contexts at once, of the symbols that are not ``out`` already."""
        shape = out.shape
        p, mass = np.zeros(shape), np.ones((shape[0], 1))
        for o in orders:
            n = np.where(out, 0.0, o)
            total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
            bottom = np.maximum(total + kinds, 1)
            p += mass * n / bottom
            mass = np.where(total > 0, mass * kinds / bottom, mass)
            out = out | (n > 0)
        rest = np.maximum(np.where(out, 0.0, bytes_of).sum(1, keepdims=True), 1)
        p += np.where(out, 0.0, mass / rest)
        return -np.log2(np.maximum(p, 1e-300))

    def bits(self, k: int, row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Code lengths of symbols after contexts."""
        n3 = len(self.slot)
        place = np.where(row < n3, self.slot[np.minimum(row, n3 - 1), symbol], -1)
        return self._known(k, place, np.flatnonzero(place < 0), row, symbol)

    def _known(self, k: int, place: np.ndarray, new: np.ndarray, row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out = self.full[k][place]
        r, s = row[new], symbol[new]
        q = self.row2[r]
        out[new] = self.base[k][r, self.flag[k][q, s].astype(np.int8)] + self.tail[k][q, s]
        return out

    def totals(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits of every row under every language."""
        rows, a = len(offs) - 1, self.symbols
        out = np.zeros((rows, len(self.langs)))
        if not len(raw):
            return out
        seq, starts = padded(raw, offs, 3, self.lut, self.pad)
        s = seq.astype(np.int32)
        row, symbol = self.rows[(s[:-3] * a + s[1:-2]) * a + s[2:-1]], s[3:]
        n3 = len(self.slot)
        place = np.where(row < n3, self.slot.ravel()[np.minimum(row, n3 - 1) * a + symbol], -1)
        new = np.flatnonzero(place < 0)
        lens = np.diff(offs)
        full = np.flatnonzero(lens)
        bounds = np.stack([starts, starts + lens], 1)[full].ravel()
        for k in range(len(self.langs)):
            bits = np.concatenate([np.zeros(3, np.float32), self._known(k, place, new, row, symbol), np.zeros(1, np.float32)])
            out[full, k] = np.add.reduceat(bits, bounds, dtype=np.float64)[::2]
        return out


def train(rows: DataFrame, lang_col: str, text_col: str, id_col: str, train_rows: int) -> ContextTables | None:
    """Count the trees over a bounded, hash-chosen sample of the labelled rows."""
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # one row a language
    if not sizes:
        return None
    share = F.lit(0)
    for name, n in sorted(sizes.items()):
        share = F.when(F.col(lang_col) == name, F.lit(min(1_000_000, -(-train_rows * 1_000_000 // n)))).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                names = np.array(batch.column("lang").to_pylist(), dtype=object)
                for name in sorted(set(names.tolist())):
                    raw, offs = text_buffers(batch.filter(pa.array(names == name)).column("text"))
                    grams, counts = gram_counts(raw, offs)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(grams)), "gram": grams.astype(np.int64), "n": counts.astype(np.int64)})

    grams = (
        chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .toPandas()
    )
    langs = sorted(sizes)
    code = {name: i for i, name in enumerate(langs)}
    return ContextTables(langs, grams["lang"].map(code).to_numpy(), grams["gram"].to_numpy(), grams["n"].to_numpy())


PREDICTION = "struct<lang_pred: string, score: double, bits_per_byte: double>"
ASCII_LETTERS = np.zeros(256, bool)
ASCII_LETTERS[65:91] = ASCII_LETTERS[97:123] = True


def predict(tables: ContextTables | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and bits a byte of every text."""
    raw, offs = text_buffers(texts)
    n, lens = len(texts), np.diff(offs)
    names, score, rate = np.array(["und"] * n, dtype=object), np.zeros(n), np.zeros(n)
    if tables is None or not len(raw):
        return names, score, rate
    sums = np.concatenate([[0], np.cumsum(ASCII_LETTERS[raw])])
    letters = sums[offs[1:]] > sums[offs[:-1]]
    for i in np.flatnonzero(~letters & (lens > 0)).tolist():
        letters[i] = bool(LETTER.search(raw[offs[i] : offs[i + 1]].tobytes().decode()))
    bits = tables.totals(raw, offs)
    gap = bits - bits.min(1, keepdims=True)
    posterior = 1.0 / np.exp2(-np.minimum(gap, 1000)).sum(1)
    names[letters] = np.array(tables.langs, dtype=object)[bits.argmin(1)[letters]]
    score[letters] = posterior[letters]
    rate[letters] = bits.min(1)[letters] / lens[letters]
    return names, score, rate


def identify(
    docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    train_rows: int = 2000, keep: list[str] | None = None,
) -> DataFrame:
    """docs with lang_pred, score and bits_per_byte; ``training`` has the labelled rows.

    ``keep`` names the columns of docs to return, by default its identifier.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(training, lang_col, text_col, id_col, train_rows))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = model.value
        for whole in batches:
            found = [predict(tables, part.column(0)) for part in slices(pa.RecordBatch.from_arrays([whole], ["text"]), "text", SLICE_BYTES)]
            names, score, rate = (np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(3))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], ["lang_pred", "score", "bits_per_byte"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    judged = F.arrow_udf(run, PREDICTION).asNondeterministic()  # so that a filter on the result does not run it again
    keep = [id_col] if keep is None else keep
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), judged(F.col(f"`{text_col}`").cast("string")).alias("found"))
    return found.select("kept.*", "found.*")


def fold_of(id_col: str) -> F.Column:
    """crc32 of the identifier as text, modulo 3."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, docs.where(fold_of("doc_id") != 1))
    return found.select("doc_id", (fold_of("doc_id") == 1).alias("held_out"), "lang_pred", "score", "bits_per_byte")
