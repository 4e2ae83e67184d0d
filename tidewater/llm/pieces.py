"""SentencePiece encoding and decoding by a max-plus parallel scan (operator 8).

The model is a BPE model, whose encoding is not the best-scored path but the
outcome of greedy merges. It is still a max-plus path problem: a sequence of
pieces is the greedy encoding of its text exactly when every adjacent pair is
the greedy encoding of its own two-piece text. So an edge between two pieces
weighs 0 where that holds and minus infinity elsewhere, and the one path of
weight 0 is the encoding.

Texts of less than ``chunk_chars`` characters are one chunk. Longer ones are
split, and their chunks are rows, each with the few characters on either side
that a piece can reach. The states of a boundary are the pieces that could lie
across it or end on it. Each chunk row yields a matrix of best weights from its
left to its right states; matrices are combined associatively (prefix products
from the left, suffix products from the right) into the one state of every
boundary, and each chunk row is backtraced alone between its two states. Only
matrices of some twenty states a side meet by text, 65,536 at most, since a
column value ends at two GB. Chunks are named by the SHA-256 of their text, so a
lost executor repeats the same names, and copies of a text give one result.

Where no piece goes on past a space, words are bounds that every path passes;
their encodings are kept in a cache of bounded size.

Null texts are empty; empty texts have no pieces; very long texts are encoded
whole. A literal U+2581 decodes to a space, as in the library. Repeated rows give
their result again, rows without an id too; an empty table gives an empty table.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import bounded_batches, slices, table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHE_WORDS, CACHE_PAIRS, SHORT_UNIT = 250_000, 100_000, 48
NEVER = float("inf")


class PieceModel:
    """Pieces and scores of a SentencePiece BPE model with byte fallback."""

    def __init__(self, pieces: list[str], scores: list[float], special: int):
        self.pieces, self.scores, self.special = pieces, scores, special
        self._ready = False

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        found = sentencepiece.SentencePieceProcessor(model_file=path)
        n = found.vocab_size()
        special = [i for i in range(n) if found.is_control(i) or found.is_unknown(i) or found.is_byte(i)]
        if special != list(range(len(special))) or len(special) != 259:
            raise ValueError("expected three control pieces and 256 byte pieces first")
        return cls([found.id_to_piece(i) for i in range(n)], [found.get_score(i) for i in range(n)], len(special))

    def __getstate__(self):
        return self.pieces, self.scores, self.special

    def __setstate__(self, state):
        self.__init__(*state)

    def ready(self) -> PieceModel:
        if not self._ready:
            normal = range(self.special, len(self.pieces))
            self.ids = {self.pieces[i]: i for i in normal}
            self.rank = {p: -self.scores[i] for p, i in self.ids.items()}.get
            self.longest = max((len(self.pieces[i]) for i in normal), default=1)
            by_two: dict[str, int] = {}  # the longest piece by its first two characters
            for p in self.ids:
                if len(p) > 1:
                    by_two[p[:2]] = max(by_two.get(p[:2], 0), len(p))
            self.longest_by_two = by_two.get
            # characters that no piece of two or more holds: no piece reaches over them
            joined = {c for i in normal if len(self.pieces[i]) > 1 for c in self.pieces[i]}
            self.alone = [c for c in "\n\r\t" if c not in joined]
            self.words_bound = not any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in normal)
            stop = "".join(map(re.escape, self.alone))
            self.unit = re.compile((f"[{stop}]|" if stop else "") + f"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+")
            self.raw = [bytes([i - 3]) if 3 <= i < 259 else (b"" if i < 3 else p.replace(SPACE, " ").encode()) for i, p in enumerate(self.pieces)]
            self.words: dict[str, bytes] = {}
            self.pairs: dict[tuple, bool] = {}
            self._ready = True
        return self

    def merge(self, text: str) -> list[str]:
        """Greedy merges, highest score first, leftmost among equals: the definition, for short texts."""
        parts, rank = list(text), self.rank
        ranks = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], NEVER)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], NEVER)
        return parts

    def follows(self, left: str | None, right: str) -> bool:
        """Whether the edge between two pieces weighs 0."""
        key = (left, right)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self.merge((left or "") + right) == ([right] if left is None else [left, right])
        return ok

    def forward(self, s: str, start: int, end: int, before: str | None) -> list[int]:
        """For each position from start to end the length of the piece that ends there, 0 for none.

        A prefix has one encoding at most, so one piece a position is the whole state.
        """
        span = [0] * (end - start + 1)
        ids, follows, longest = self.ids, self.follows, self.longest
        for i in range(start, end):
            n = span[i - start]
            if i > start and not n:
                continue
            left = before if i == start else s[i - n : i]
            for m in range(1, min(longest, end - i) + 1):
                piece = s[i : i + m]
                if (m == 1 or piece in ids) and not span[i + m - start] and follows(left, piece):
                    span[i + m - start] = m
        return span

    def to_ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            k = self.ids.get(p)
            out.extend([k] if k is not None else [3 + b for b in p.encode()])
        return out

    def path(self, s: str, start: int, end: int, before: str | None) -> list[str]:
        """The path of weight 0 from start to end, depth first, longest pieces first.

        A position reached by edges of weight 0 is reached by the only encoding
        of its prefix, so one that leads nowhere is dead for good.
        """
        ids, pairs, follows = self.ids, self.pairs, self.follows
        parts: list[str] = []
        dead: set[int] = set()
        reach = self.longest_by_two
        i, left, m = start, before, min(reach(s[start : start + 2], 1), end - start)
        while i < end:
            while m:
                piece = s[i : i + m]
                if (piece in ids or m == 1) and i + m not in dead:
                    ok = pairs.get((left, piece))
                    if ok or (ok is None and follows(left, piece)):
                        break
                m -= 1
            if m:
                parts.append(piece)
                i, left = i + m, piece
                m = min(reach(s[i : i + 2], 1), end - i)
            else:
                if not parts:
                    raise ValueError("no path")
                dead.add(i)
                m = len(parts.pop())
                i, m = i - m, m - 1
                left = parts[-1] if parts else before
        return parts

    def encode_path(self, s: str, start: int, end: int, before: str | None) -> bytes:
        return np.array(self.to_ids(self.path(s, start, end, before)), np.uint32).tobytes()

    def encode_free(self, s: str) -> bytes:
        """Ids of a text between two bounds, as uint32 bytes: word by word."""
        if not self.words_bound:
            return self.encode_path(s, 0, len(s), None) if s else b""
        units = self.unit.findall(s)
        words = self.words
        new = set(units).difference(words)
        if new:
            if len(words) + len(new) > CACHE_WORDS:
                words.clear()
                new = set(units)
            for u in new:
                # between two bounds the merges themselves are the cheapest way, but for long units they are quadratic
                words[u] = np.array(self.to_ids(self.merge(u)), np.uint32).tobytes() if len(u) <= SHORT_UNIT else self.encode_path(u, 0, len(u), None)
        return b"".join(map(words.__getitem__, units))

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, with the dummy prefix still in place."""
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")

    # chunks

    def bounds(self, s: str, a: int, b: int) -> list[int]:
        """Positions in (a, b) that every path passes: the first one and the last one."""
        if not self.words_bound:
            return []
        first = next((p for p in range(a + 1, b) if self.is_bound(s, p)), None)
        if first is None:
            return []
        return [first, next(p for p in range(b - 1, a, -1) if self.is_bound(s, p))]

    def is_bound(self, s: str, p: int) -> bool:
        return (s[p] == SPACE and s[p - 1] != SPACE) or s[p] in self.alone or s[p - 1] in self.alone

    def states(self, s: str, at: int) -> list[tuple[int, int]]:
        """(start, end) of every piece with start < at <= end; at the ends of the text one state, the bound."""
        if at <= 0 or at >= len(s):
            return [(at, at)]
        found = []
        for start in range(max(0, at - self.longest), at):
            for end in range(at, min(len(s), start + self.longest) + 1):
                if end - start == 1 or s[start:end] in self.ids:
                    found.append((start, end))
        return found

    def reach(self, s: str, at: int, before: str | None, b: int, outs: list[tuple[int, int]]) -> np.ndarray:
        """Weights from one state, with its piece ending at ``at``, to the right states."""
        w = np.full(len(outs), -np.inf, np.float32)
        top = max(end for _, end in outs)
        if at > b:  # the piece reaches over the whole chunk
            return w
        span = self.forward(s, at, min(b, top), before)
        for j, (start, end) in enumerate(outs):
            if start == end:  # the end of the text
                ok = at == end or span[end - at] > 0
            elif start < at:
                ok = False
            else:
                left = before if start == at else (s[start - span[start - at] : start] if span[start - at] else "")
                ok = left != "" and self.follows(left, s[start:end])
            if ok:
                w[j] = 0
        return w

    def matrix(self, s: str, a: int, b: int) -> np.ndarray:
        """Max-plus transfer matrix of the chunk [a, b) of s."""
        ins, outs = self.states(s, a), self.states(s, b)
        mid = self.bounds(s, a, b)
        out = np.full((len(ins), len(outs)), -np.inf, np.float32)
        if mid and mid[0] >= max(e for _, e in ins):
            left = np.array([self._arrives(s, x, y, mid[0]) for x, y in ins], np.float32)
            return left[:, None] + self.reach(s, mid[1], None, b, outs)[None, :]
        for i, (x, y) in enumerate(ins):
            same = [j for j, o in enumerate(outs) if o == (x, y)]
            if same and y >= b:  # one piece over the whole chunk
                out[i, same] = 0
            else:
                out[i] = self.reach(s, y, s[x:y] or None, b, outs)
        return out

    def _arrives(self, s: str, x: int, y: int, bound: int) -> float:
        if x < y and not self.follows(None, s[x:y]):
            return -np.inf
        if y == bound:
            return 0.0
        return 0.0 if self.forward(s, y, bound, s[x:y] or None)[-1] else -np.inf

    def backtrace(self, s: str, a: int, b: int, left: int, right: int) -> bytes:
        """Ids of the pieces that begin in [a, b), given the states of both boundaries."""
        x, y = self.states(s, a)[left]
        u, v = self.states(s, b)[right]
        if (x, y) == (u, v) and x < a:
            return b""
        stop = b if u == v else u
        last = b"" if u == v else np.array(self.to_ids([s[u:v]]), np.uint32).tobytes()
        before = s[x:y] or None
        mid = self.bounds(s, a, b)
        if mid and mid[0] >= y and mid[1] <= stop:
            return self.encode_path(s, y, mid[0], before) + self.encode_free(s[mid[0] : mid[1]]) + self.encode_path(s, mid[1], stop, None) + last
        return self.encode_path(s, y, stop, before) + last


def normalise(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def combine(matrices: list[np.ndarray]) -> list[int]:
    """The state of every inner boundary: prefix product from the left plus suffix product from the right."""
    times = lambda p, q: np.max(p[:, :, None] + q[None, :, :], axis=1)
    prefix, suffix = [matrices[0]], [matrices[-1]]
    for m in matrices[1:-1]:
        prefix.append(times(prefix[-1], m))
    for m in matrices[-2:0:-1]:
        suffix.append(times(m, suffix[-1]))
    return [int(np.argmax(p[0, :] + q[:, 0])) for p, q in zip(prefix, suffix[::-1])]


def _udf(run, kind: str):
    """An Arrow function over batches, not run again for each use of its result."""
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}  # not as text
    return F.arrow_udf(run, kind).asNondeterministic()


def _listed(ids: list[bytes]) -> pa.ListArray:
    """Ids as lists of integers."""
    ends = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids], dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))


def _encode_short(docs: DataFrame, model, chunk_chars: int, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = model.value.ready()
        for whole in batches:
            ids: list[bytes] = []
            for part in slices(pa.RecordBatch.from_arrays([whole], ["text"]), "text", 1 << 20):
                ids.extend(pieces.encode_free(normalise(t)) for t in part.column(0).to_pylist())
            yield pa.array(ids, pa.binary()) if kind == "binary" else _listed(ids)

    return docs.where(F.length("text") < chunk_chars).select("doc_id", "text", _udf(run, kind)("text").alias("ids"))


def _encode_giant(docs: DataFrame, model, chunk_chars: int, margin: int, kind: str) -> DataFrame:
    giants = docs.where(F.length("text") >= chunk_chars).withColumn("key", F.unhex(F.sha2("text", 256)))
    chars = F.length("text") + 1  # with the space in front
    chunk = giants.select("key", "text", chars.alias("chars"), F.explode(F.sequence(F.lit(0), F.floor((chars - 1) / chunk_chars).cast("int"))).alias("no"))
    low = F.greatest(F.col("no") * chunk_chars - margin, F.lit(0))
    high = F.least((F.col("no") + 1) * chunk_chars + margin, F.col("chars"))
    own = F.concat(F.lit(SPACE), F.replace("text", F.lit(" "), F.lit(SPACE)))
    # s: the chunk with its margins; begin, end: where the chunk itself lies in s
    chunks = chunk.select(
        "key", "no", own.substr(low + 1, high - low).alias("s"), (F.col("no") * chunk_chars - low).cast("int").alias("begin"), (F.least((F.col("no") + 1) * chunk_chars, F.col("chars")) - low).cast("int").alias("end")
    )
    pieces_schema = "key binary, no int, n_in int, m binary"

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model.value.ready()
        for batch in batches:
            for key, no, s, a, b in zip(*(batch.column(c).to_pylist() for c in ("key", "no", "s", "begin", "end"))):
                m = pieces.matrix(s, a, b)
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([no], pa.int32()), pa.array([m.shape[0]], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["key", "no", "n_in", "m"])

    def scan(key, rows):
        import pandas as pd

        rows = rows.sort_values("no")
        edge = [0, *combine([np.frombuffer(m, np.float32).reshape(n, -1) for n, m in zip(rows["n_in"], rows["m"])]), 0]
        return pd.DataFrame({"key": [key[0]] * len(rows), "no": rows["no"].to_numpy(), "begins": edge[:-1], "ends": edge[1:]})

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model.value.ready()
        for batch in batches:
            for key, no, s, a, b, left, right in zip(*(batch.column(c).to_pylist() for c in ("key", "no", "s", "begin", "end", "begins", "ends"))):
                ids = pieces.backtrace(s, a, b, left, right)
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([no], pa.int32()), pa.array([ids], pa.binary())], names=["key", "no", "ids"])

    def glue(key, rows):
        import pandas as pd

        ids = b"".join(rows.sort_values("no")["ids"])
        return pd.DataFrame({"key": [key[0]], "ids": [ids if kind == "binary" else np.frombuffer(ids, "<u4").astype(np.int32)]})

    once = chunks.mapInArrow(matrices, pieces_schema).groupBy("key", "no").agg(F.first("n_in").alias("n_in"), F.first("m").alias("m"))  # copies of a text agree
    states = once.groupBy("key").applyInPandas(scan, "key binary, no int, begins int, ends int")
    parts = chunks.join(states, ["key", "no"]).mapInArrow(pieces_of, "key binary, no int, ids binary").groupBy("key", "no").agg(F.first("ids").alias("ids"))
    whole = parts.groupBy("key").applyInPandas(glue, f"key binary, ids {kind}")
    return giants.join(whole, "key").select("doc_id", "text", "ids")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL_PATH, chunk_chars: int = 32_768, kind: str = "binary") -> DataFrame:
    """(doc_id, text, ids): ids are little-endian uint32 bytes, or lists with the kind array<int>."""
    bounded_batches(docs.sparkSession)
    pieces = PieceModel.load(model_path)
    model = docs.sparkSession.sparkContext.broadcast(pieces)  # a vocabulary
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    margin = 2 * max(map(len, pieces.pieces)) + 2
    if chunk_chars < margin:
        raise ValueError("chunks are shorter than what a piece can reach")
    return _encode_short(rows, model, chunk_chars, kind).unionByName(_encode_giant(rows, model, chunk_chars, margin, kind))


def decode(encoded: DataFrame, ids_col: str = "ids", model_path: str = MODEL_PATH) -> DataFrame:
    """encoded with its column ``decoded``: the text of the ids, without the space in front."""
    model = encoded.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = model.value.ready()
        for batch in batches:
            yield pa.array([pieces.decode(np.frombuffer(v.as_buffer(), "<u4"))[1:] if v.is_valid else None for v in batch], pa.string())

    return encoded.select("*", _udf(run, "string")(ids_col).alias("decoded"))


def summarise(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, n_chars, n_tokens, ids_sha256, round_trip): decodes what was encoded and compares."""
    found = decode(encoded.select("doc_id", "text", "ids"), model_path=model_path)
    return found.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        (F.col("decoded") == F.replace("text", F.lit(SPACE), F.lit(" "))).alias("round_trip"),
    )


def token_table(encoded: DataFrame) -> DataFrame:
    """(doc_id, ids, n_tokens): the tokens themselves, as a list a document."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _listed(batch.to_pylist())

    return encoded.select("doc_id", _udf(run, "array<int>")("ids").alias("ids"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))


def tokens(docs: DataFrame, **how) -> DataFrame:
    """token_table(encode(docs)) in one pass of Python: a task holds one worker and not two."""
    return encode(docs, **how, kind="array<int>").select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise(encode(table(spark, sf_dir, "documents")))
