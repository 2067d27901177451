"""SentencePiece encoding and decoding over a relational lattice (operator 6).

A text's characters (white space as the space mark) are cut into stretches
no piece crosses - words, mostly - and each distinct stretch is encoded
once.  Its lattice: every substring of at most ``reach`` characters is
exploded and equi-joined to the piece table; the matching edges are grouped
by stretch; a Viterbi fold runs over their ends.  The model's vocabulary is
a BPE one, whose segmentation no sum of piece scores gives, so the fold's
transitions decide: an edge may extend a path when the two pieces merge to
just themselves, and of an end's edges one can.  (A sum of the model's scores
gives other pieces than the model; see the README.)

``encode_words`` is that plan in Spark: explode, broadcast join with the
vocabulary (32,000 rows), join of adjacent edges, grouping, and a fold by
the higher-order function ``aggregate``.  ``encode`` runs the same
lattice on arrays inside the scan's tasks: documents share words across all
partitions, and bringing pieces back to every occurrence by joins moves
several times the input, beyond the disk limit.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm import words as W
from tablework.llm.pieces import SPACE, Table, Vocabulary, codes_of
from tablework.llm.store import aside, prepare, table
from tablework.llm.token_counts import Held, TEXT_CHARS, Transducer, compiled

EDGES = 1 << 21       # lattice edges (before the join) made at a time
KEPT_IDS = 3_000_000  # ids of stretches a worker remembers


class Lattice:
    """Piece table by substring hash, and the fold over a batch's edges."""

    def __init__(self, t: Transducer):
        self.t, m = t, t.m
        letters, size = t._spell(np.arange(m.S))
        h = np.array([self._hash(letters[k, :size[k]]) for k in range(m.S)]).astype(np.int64)
        self.pieces = Table(h & 0x7FFFFFFFFFFFFFFF)
        self.kept: dict[int, np.ndarray] = {}
        self.kept_size = 0
        v = m.vocabulary
        self.names: list[str | None] = [p if ok else "" for p, ok in zip(v.pieces, v.normal)]
        if v.byte0 >= 0:
            self.names[v.byte0:v.byte0 + 256] = [chr(b) if b < 128 else None for b in range(256)]

    @staticmethod
    def _hash(sym: np.ndarray) -> np.uint64:
        total = (W.mix(sym.astype(np.uint64) + np.uint64(1)) * W._power("p", len(sym))).sum()
        return W.mix(np.array([total + np.uint64(len(sym))]))[0]

    def edges(self, sym: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, symbol): substrings of the stretches that are
        pieces, ordered by the place where they end, longest first."""
        total = np.zeros(len(sym) + 1, np.uint64)
        np.cumsum(W.mix(sym.astype(np.uint64) + np.uint64(1)) * W._power("p", len(sym)), out=total[1:])
        inv = W._power("q", len(sym) + 1)
        row = np.repeat(np.arange(len(start)), size)
        at = start[row] + np.arange(len(row)) - np.r_[0, np.cumsum(size)[:-1]][row]
        stop = (start + size)[row]
        found = []
        for n in range(1, self.t.reach + 1):
            ok = at + n <= stop
            a = at[ok]
            h = W.mix((total[a + n] - total[a]) * inv[a] + np.uint64(n)).astype(np.int64) & 0x7FFFFFFFFFFFFFFF
            got = self.pieces.find(h)
            hit = got >= 0
            found.append((a[hit], np.full(int(hit.sum()), n), got[hit]))
        place, n, piece = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-n, place + n))
        return place[order], n[order], piece[order]

    def segment(self, sym: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the stretches, which lie end to end in sym, and their
        offsets.  The fold takes the ends of all stretches
        side by side, in order: at step i the edges that end i characters in."""
        place, n, piece = self.edges(sym, start, size)
        end = place + n
        first = np.full(len(sym) + 1, -1, np.int64)
        head = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
        first[end[head]] = head                              # first edge of an end
        final = np.r_[end[1:] != end[:-1], True]             # last edge of an end
        best = np.full(len(sym) + 1, -1, np.int64)           # edge chosen for an end
        order = np.argsort(-size, kind="stable")
        s, z = start[order], size[order]
        for i in range(1, int(z[0]) + 1):
            live = int(np.searchsorted(-z, -i, side="right"))
            e = first[s[:live] + i]
            begin = s[:live]
            todo = np.arange(live)
            while len(todo):
                x = e[todo]
                if (x < 0).any():
                    raise ValueError("a place has no valid piece: the vocabulary is not a BPE one")
                start_here = place[x] == begin[todo]
                before = best[place[x]]
                fine = start_here | (before >= 0)
                prev = np.where(start_here, -1, piece[np.maximum(before, 0)])
                fine[fine] = self.t.follows(prev[fine], piece[x[fine]])
                best[end[x[fine]]] = x[fine]
                todo, x = todo[~fine], x[~fine]
                e[todo] = np.where(final[x], -1, x + 1)
        chosen = np.zeros(len(place), bool)
        at, stop = start + size, start
        while len(at):  # back along the paths, all stretches at once
            x = best[at]
            chosen[x] = True
            at = place[x]
            go = at > stop
            at, stop = at[go], stop[go]
        path = np.flatnonzero(chosen)  # edges are ordered by their ends
        return piece[path], np.searchsorted(place[path], np.r_[start, len(sym)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets per text)."""
        m, v = self.t.m, self.t.m.vocabulary
        c, edge = codes_of(texts)
        if not len(c):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        sym, start = self.t.stretches(c, edge)
        size = np.diff(np.r_[start, len(c)])
        total = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(W.mix(c.astype(np.uint64) + np.uint64(1)) * W._power("p", len(c)), out=total[1:])
        h = W.mix((total[start + size] - total[start]) * W._power("q", len(c))[start] + size.astype(np.uint64))
        uniq, first, which = np.unique(h, return_index=True, return_inverse=True)
        got = [self.kept.get(k) for k in uniq.tolist()]
        new = [i for i, g in enumerate(got) if g is None]
        byte = [i for i in new if size[first[i]] == 1 and m.id[sym[start[first[i]]]] < 0]
        for i in byte:
            ch = chr(int(c[start[first[i]]])).encode("utf-8", "surrogatepass")
            got[i] = np.array([v.byte0 + x for x in ch], np.int32)
        new = [i for i in new if got[i] is None]
        k = 0
        while k < len(new):
            part, room = [], EDGES
            while k < len(new) and (not part or size[first[new[k]]] * self.t.reach <= room):
                room -= size[first[new[k]]] * self.t.reach
                part.append(new[k])
                k += 1
            at = first[np.array(part)]
            order = np.argsort(start[at], kind="stable")
            at = at[order]
            symbols, o = self.segment(*_packed(sym, start[at], size[at]))
            ids = m.id[symbols].astype(np.int32)
            for i, x, y in zip(np.array(part)[order].tolist(), o[:-1].tolist(), o[1:].tolist()):
                got[i] = ids[x:y]
            for j in np.unique(np.searchsorted(o, np.flatnonzero(ids < 0), side="right") - 1).tolist():
                # characters that are no piece become bytes
                got[part[order[j]]] = np.concatenate([
                    [m.id[x]] if m.id[x] >= 0 else [v.byte0 + y for y in m.chars[x].encode("utf-8")]
                    for x in symbols[o[j]:o[j + 1]].tolist()]).astype(np.int32)
        fresh = byte + new
        self.kept_size += sum(len(got[i]) + 8 for i in fresh)
        if self.kept_size > KEPT_IDS:
            self.kept.clear()
            self.kept_size = 0
        else:
            self.kept.update((int(uniq[i]), got[i]) for i in fresh)
        n = np.array([len(g) for g in got])
        begin = np.r_[0, np.cumsum(n)[:-1]]
        flat = np.concatenate(got)
        count = n[which]
        stop = np.cumsum(count)
        ids = flat[np.repeat(begin[which] - np.r_[0, stop[:-1]], count) + np.arange(stop[-1])]
        return ids, np.r_[0, stop][np.searchsorted(start, edge)]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Text of ids: pieces joined, bytes decoded (invalid ones replaced),
        space marks as spaces, without the mark the model put first."""
        v = self.t.m.vocabulary
        got = [self.names[i] for i in ids]
        if None in got:  # bytes of several that make a character
            got, held = [], bytearray()
            for i in [*ids, -1]:
                if i >= 0 and v.byte0 <= i < v.byte0 + 256:
                    held.append(i - v.byte0)
                    continue
                got.append(held.decode("utf-8", "replace"))
                held = bytearray()
                got.append(self.names[i] if i >= 0 else "")
        text = "".join(got).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _packed(sym: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Only the given stretches, laid end to end."""
    begin = np.r_[0, np.cumsum(size)[:-1]]
    at = np.repeat(start - begin, size) + np.arange(int(size.sum()))
    return sym[at], begin, size


_lattices: dict[int, Lattice] = {}


def lattice(held: Held) -> Lattice:
    if held.id not in _lattices:
        _lattices.clear()
        _lattices[held.id] = Lattice(compiled(held))
    return _lattices[held.id]


def encode(docs: DataFrame, model_path: str, keep: list[str], texts: bool = False) -> DataFrame:
    """docs (with ``text``) -> the ``keep`` columns + ids array<int>.  Null and
    empty texts have no ids."""
    spark = docs.sparkSession
    prepare(spark)
    held = Held(spark, Vocabulary.load(model_path))

    def run(batches):
        m = lattice(held)
        for b in batches:
            _, offs = W.text_bytes(b.column(0))
            texts = [x or "" for x in b.column(0).to_pylist()]
            for i, j in W.chunks(offs, TEXT_CHARS):
                ids, o = m.encode(texts[i:j])
                col = pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns[1:], col], names=[*keep, "ids"])

    kept = [F.col(f"`{c}`") for c in keep]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)
    return docs.select(F.col("text").cast("string").alias("text"), *kept).mapInArrow(run, fields + "ids array<int>")


def decode(encoded: DataFrame, model_path: str, keep: list[str]) -> DataFrame:
    """(ids array<int>) -> the ``keep`` columns + text; null ids give null."""
    spark = encoded.sparkSession
    prepare(spark)
    held = Held(spark, Vocabulary.load(model_path))

    def run(batches):
        m = lattice(held)
        for b in batches:
            out = [None if x is None else m.decode(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out, pa.string())], names=[*keep, "text"])

    kept = [F.col(f"`{c}`") for c in keep]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in encoded.select(*kept).schema)
    return encoded.select("ids", *kept).mapInArrow(run, fields + "text string")


def encode_words(words: DataFrame, model_path: str) -> DataFrame:
    """words(word) -> (word, ids array<int>), a row per distinct non-null
    word of characters that have pieces of their own (others: null ids).
    The word is taken as it stands: space marks are the caller's.

    The lattice in Spark: explode, equi-join, group, fold."""
    spark = words.sparkSession
    v = Vocabulary.load(model_path)
    t = Transducer(v)
    held = Held(spark, v)
    names = spark.createDataFrame([(k, t.m.chars[k] if k < len(t.m.chars) else t.m.text[k - t.m.C], int(t.m.id[k]))
                                   for k in range(t.m.S) if k != t.m.C - 1], "piece int, name string, id int")
    names = F.broadcast(names)
    w = words.select(F.col("word").cast("string").alias("word")).where("word is not null and word != ''").distinct()
    sub = w.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("a")) \
        .select("word", "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(t.reach), F.length("word") - F.col("a")))).alias("n")) \
        .select("word", "a", "n", F.expr("substring(word, a + 1, n)").alias("name"))
    edges = sub.join(names, "name").select("word", "a", (F.col("a") + F.col("n")).alias("b"), "piece", "id")
    left = edges.select("word", F.col("b").alias("a"), F.col("piece").alias("before"))
    steps = edges.join(left, ["word", "a"], "left").withColumn("before", F.when(F.col("a") == 0, -1).otherwise(F.col("before"))) \
        .where("before is not null").distinct()

    def valid(batches):
        m = compiled(held)
        for b in batches:
            x, y = (b.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            yield b.filter(pa.array(m.follows(x, y)))

    may = steps.select("before", "piece").distinct().mapInArrow(valid, "before int, piece int")
    usable = steps.join(may, ["before", "piece"]).groupBy("word", "a", "b", "piece", "id").agg(F.collect_set("before").alias("from"))
    grouped = usable.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("b", "a", "piece", "id", "from"))).alias("edges"))
    # path: by place, (piece that ends there, the id, where it begins); -1 pieces end nowhere
    fold = F.expr("""aggregate(edges,
        transform(sequence(0, length(word)), i -> struct(if(i = 0, -1, -2) as piece, -1 as id, -1 as a)),
        (path, e) -> if(path[e.b].piece = -2 and array_contains(e.from, path[e.a].piece),
                        transform(path, (x, i) -> if(i = e.b, struct(e.piece as piece, e.id as id, e.a as a), x)), path))""")
    back = F.expr("""aggregate(sequence(length(word), 1, -1), struct(length(word) as at, cast(array() as array<int>) as ids),
        (s, i) -> if(i = s.at and s.at > 0 and path[i].a >= 0,
                     struct(path[i].a as at, concat(array(path[i].id), s.ids) as ids), s))""")
    done = grouped.select("word", fold.alias("path")).select("word", back.alias("r")).where("r.at = 0").select("word", "r.ids")
    return w.join(done, "word", "left")


def query(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    """op6: every whole text of ``documents`` encoded and decoded again: its
    number of pieces, the SHA-256 of its ids (little-endian 32-bit) and
    whether decoding gives the text back (a text's own space mark characters
    come back as spaces)."""
    import public_tokenizers

    path = public_tokenizers.path(model)
    prepare(spark)
    held = Held(spark, Vocabulary.load(path))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        m = lattice(held)
        for b in batches:
            _, offs = W.text_bytes(b.column(1))
            texts = [x or "" for x in b.column(1).to_pylist()]
            for i, j in W.chunks(offs, TEXT_CHARS):
                ids, o = m.encode(texts[i:j])
                part = [ids[o[k]:o[k + 1]] for k in range(j - i)]
                same = [m.decode(p.tolist()) == t.replace(SPACE, " ") for p, t in zip(part, texts[i:j])]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), pa.array(np.diff(o)),
                    pa.array([hashlib.sha256(p.astype("<i4").tobytes()).hexdigest() for p in part]),
                    pa.array(same)], names=["doc_id", "n_pieces", "ids_sha256", "round_trip"])

    return docs.mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, round_trip boolean")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the text becomes its pieces' ids (a document's own
    column ``ids`` makes room for them)."""
    import public_tokenizers

    cols, names = aside(docs)
    out = encode(docs.select("text", *cols), public_tokenizers.path("piece_bpe_32k.model"), list(names))
    return out.select(*[F.col(n).alias(c) for n, c in names.items() if c not in ("text", "ids")], "ids")
