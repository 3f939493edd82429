"""Brown class-based bigrams: exchange clustering, class transitions, word emissions.

The most frequent words are clustered by the exchange algorithm over their class bigram
counts; every other training word then takes the class that the same step of exchange
gives it, from the classes of all its neighbours, summed over all training texts. Words
not seen in training have a class named by their shape (length, punctuation); how likely
one is follows from the words seen once, and of its shape's words not seen, as many as
Chao's estimate expects, each is as likely. A text's probability is the product of smoothed class transitions and word emissions, both
counted over all training documents: class bigrams as one bounded table, words as a
distributed one. Frequent words' counts and classes are broadcast; the rarest words, no
one of which can be frequent, are joined, place by place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, emit_rows, frequent, written

EXCHANGE_WORDS = 512
CLASSES = 32
HEAD_WORDS = 1 << 16
ADD = 0.1
PRIOR = 10.0
#: Shape classes: five lengths, with and without a last character that is punctuation.
SHAPES = 10
U = np.uint64


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shape(word: bytes) -> int:
    """The shape class of a word, 0 to ``SHAPES`` - 1."""
    last = word[-1]
    mark = last < 128 and not (97 <= last <= 122 or 48 <= last <= 57)
    n = len(word)
    return (n > 3) + (n > 6) + (n > 9) + (n > 13) + 5 * mark


def shapes(words: pa.Array) -> np.ndarray:
    """``shape`` of each of the words, none of them null or empty."""
    edge = _edges(words)
    size, last = np.diff(edge), np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[edge[1:] - 1]
    mark = (last < 128) & ~(((97 <= last) & (last <= 122)) | ((48 <= last) & (last <= 57)))
    return np.searchsorted([3, 6, 9, 13], size) + 5 * mark


def _edges(x: pa.Array) -> np.ndarray:
    """Where the values of a binary array begin and end in its bytes."""
    if not len(x):
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(x.buffers()[1], dtype=np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)


def _f(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def exchange(counts: np.ndarray, words: int, classes: int, rounds: int = 20) -> np.ndarray:
    """Class of each symbol: ``words`` movable ones, then fixed ones with a class each.

    ``counts[a, b]`` is how often b follows a. Each word in turn leaves its class for the
    one that gains the most class-bigram likelihood, until a round moves none; ties go
    to the smaller class, and a word that gains nothing stays.
    """
    classes = max(1, min(classes, words)) if words else 0
    symbols = len(counts)
    of = np.concatenate((np.arange(words) % max(classes, 1), classes + np.arange(symbols - words)))
    k = classes + symbols - words
    pick = np.zeros((symbols, k))
    pick[np.arange(symbols), of] = 1.0
    n = pick.T @ counts @ pick
    for _ in range(rounds if classes > 1 else 0):
        moved = 0
        for w in range(words):
            own = of[w]
            pick[w, own] = 0.0
            row, col, self_ = counts[w] @ pick, counts[:, w] @ pick, counts[w, w]
            n[own] -= row
            n[:, own] -= col
            n[own, own] -= self_
            cand = slice(0, classes)
            rows, cols = n[cand], n[:, cand].T
            gain = (_f(rows + row) - _f(rows)).sum(1) + (_f(cols + col) - _f(cols)).sum(1)
            at = np.arange(classes)
            same = n[at, at]
            gain += _f(same + row[cand] + col[cand] + self_) + _f(same) - _f(same + row[cand]) - _f(same + col[cand])
            # class totals with w's neighbours, wherever w itself goes
            left, right = n[cand].sum(1) + col[cand], n[:, cand].sum(0) + row[cand]
            gain -= _f(left + row.sum() + self_) - _f(left) + _f(right + col.sum() + self_) - _f(right)
            best = int(gain.argmax())
            if gain[best] <= gain[own] + 1e-9:
                best = own
            moved += best != own
            of[w] = best
            pick[w, best] = 1.0
            n[best] += row
            n[:, best] += col
            n[best, best] += self_
        if not moved:
            break
    return of


@dataclass
class ClassModel:
    """All that scoring needs but the counts and classes of rare words; bounded by its parameters."""

    head: dict[bytes, tuple[int, int]]  # count and class of each frequent word
    classes: dict[bytes, int]  # class of each word clustered with the others
    emission: dict[bytes, float]  # log10 P(word | class, clustered with the others)
    clustered: np.ndarray  # log10 P(clustered with the others | class)
    class_total: np.ndarray  # tokens of each class; shapes and the end have none of their own
    transition: np.ndarray | None  # log10 P(class | class before); the last class is the end
    unseen: np.ndarray  # words of each shape not seen, against one word seen
    unseen_word: np.ndarray  # log10 P(word | not seen, shape)
    first_shape: int
    n: int
    distinct: int
    ends: int

    @property
    def base_total(self) -> float:
        return self.n + ADD * (self.distinct + 1)

    @property
    def line_type(self) -> np.dtype:
        """Of the classes of a text's words."""
        return np.dtype("<u1" if self.first_shape + SHAPES < 256 else "<u2")


class Held:
    """Words as Arrow arrays, until there are some millions of them."""

    def __init__(self):
        self.parts: list[pa.Array] = []

    def add(self, words: list[bytes]) -> bool:
        """Whether it is time to take them."""
        if words:
            self.parts.append(pa.array(words, pa.binary()))
        return sum(map(len, self.parts)) > 1 << 22 or sum([x.nbytes for x in self.parts]) > 1 << 28

    def taken(self) -> pa.Array:
        got = pa.concat_arrays(self.parts)
        self.parts = []
        return got


def count_words(train: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, n`` over all training texts; each task sums before it sends."""

    def make():
        held = Held()

        def flush():
            if held.parts:
                seen = held.taken().value_counts()
                yield [seen.field("values"), seen.field("counts")]

        def f(batch):
            words: list[bytes] = []
            for text in column(batch, text_col):
                words += tokens(text)
            if held.add(words):
                yield from flush()

        return f, flush

    schema = T.StructType.fromDDL("word binary, n long")
    return emit_rows(train.select(text_col), make, schema).groupBy("word").agg(F.sum("n").alias("n"))


def count_bigrams(train: DataFrame, words: list[bytes], text_col: str = "text") -> np.ndarray:
    """Bigram counts over the words, the shapes of all others, and the end (also the start)."""
    size = len(words) + SHAPES + 1
    given = train.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def make():
        # no word is a blank, which stands for the end
        number, other = {**given.value, b" ": size - 1}.get, len(given.value)
        total = np.zeros(size * size, dtype=np.int64)

        def f(batch):
            line = [b" "]
            for text in column(batch, text_col):
                line += tokens(text)
                line.append(b" ")
            got = np.array([number(w, -1) for w in line], dtype=np.int64)
            rest = np.flatnonzero(got < 0)
            got[rest] = other + shapes(pa.array([line[i] for i in rest.tolist()], pa.binary()))
            total[:] += np.bincount(got[:-1] * size + got[1:], minlength=size * size)
            return ()

        def done():
            at = np.flatnonzero(total)
            if len(at):
                yield [pa.array(at.astype(np.int64)), pa.array(total[at])]

        return f, done

    rows = emit_rows(train.select(text_col), make, T.StructType.fromDDL("pair long, n long"), rows=64)
    got = rows.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size * size)
    counts[got["pair"].to_numpy()] = got["n"].to_numpy()
    return counts.reshape(size, size)


def best_classes(after: np.ndarray, before: np.ndarray, itself: np.ndarray, own: np.ndarray, n: np.ndarray, classes: int) -> np.ndarray:
    """For each word the class of most gain: one step of ``exchange`` for words of shape classes.

    ``after[w, c]`` and ``before[w, c]`` count the neighbours of other words by class,
    ``itself`` those that are the word again, ``own`` is its shape class in the table ``n``.
    """
    gain, inside = np.zeros((len(own), classes)), n[:classes, :classes]
    # only classes that a word meets change: most words meet few of the table's
    for met, other, table in ((after, before, n[:classes].T), (before, after, n[:, :classes])):
        word, c = np.nonzero(met)
        if not len(word):
            continue
        cells, was = table[c], _f(table)[c]
        self_ = np.flatnonzero(c == own[word])
        cells[self_] -= other[word[self_], :classes]
        was[self_] = _f(cells[self_])
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        gain[word[first]] += np.add.reduceat(_f(cells + met[word, c][:, None]) - was, first)
    same, x, y, z = inside.diagonal(), after[:, :classes], before[:, :classes], itself[:, None]
    gain += _f(same + x + y + z) + _f(same) - _f(same + x) - _f(same + y)
    left, right = n[:classes].sum(1), n[:, :classes].sum(0)
    gain -= _f(left + after.sum(1)[:, None] + z) - _f(left) + _f(right + before.sum(1)[:, None] + z) - _f(right)
    return gain.argmax(1)


def class_words(train: DataFrame, of: dict[bytes, int], n: np.ndarray, classes: int, text_col: str = "text") -> DataFrame:
    """``word, n, class`` of all training words but those of ``of``, by the classes of their neighbours.

    Neighbours that are not in ``of`` count by shape. A task sums its neighbours before it
    sends them, so that a word costs a row per task and some bytes per class it meets.
    """
    k, first, spark = len(n), len(n) - SHAPES - 1, train.sparkSession
    given = spark.sparkContext.broadcast((of, n))
    wide = 2 * k + 1  # classes after, classes before, itself

    def make():
        # no word is a blank, which stands for the end
        known, held = {**given.value[0], b" ": k - 1}, Held()
        names, their = pa.array(list(known), pa.binary()), np.array(list(known.values()), dtype=np.int64)

        def flush():
            if not held.parts:
                return
            held.parts.insert(0, pa.array([b" "], pa.binary()))
            line = held.taken().dictionary_encode()
            words, v = line.dictionary, line.indices.to_numpy()
            which = pc.index_in(words, value_set=names).fill_null(-1).to_numpy()
            new = which < 0
            c = np.where(new, first + shapes(words), their[which])[v]
            words = words.filter(pa.array(new))
            at = np.flatnonzero(new[v])
            v = (np.cumsum(new) - 1)[v] + len(new) * ~new[v]  # new words by number, others beyond
            own = v[at].astype(np.int64)
            again, was = v[at + 1] == own, v[at - 1] == own
            keys = np.concatenate((own * wide + np.where(again, 2 * k, c[at + 1]), (own * wide + k + c[at - 1])[~was]))
            keys, counts = np.unique(keys, return_counts=True)
            packed = (keys % wide).astype("<u8") << U(40) | counts.astype("<u8")
            edge = np.searchsorted(keys, np.arange(len(words) + 1) * wide).astype(np.int32) * 8
            for lo in range(0, len(words), 4096):
                part = edge[lo : lo + 4097]
                met = packed[part[0] // 8 : part[-1] // 8].tobytes()
                yield [words.slice(lo, 4096), pa.Array.from_buffers(pa.binary(), len(part) - 1, [None, pa.py_buffer(part - part[0]), pa.py_buffer(met)])]

        def f(batch):
            line: list[bytes] = []
            for text in column(batch, text_col):
                line += tokens(text)
                line.append(b" ")
            if held.add(line):
                yield from flush()

        return f, flush

    def choose(batches):
        table = given.value[1]
        once = np.full(k * k * SHAPES, -1)

        def done(words, met):
            """Of sorted rows, in which no word's are cut."""
            new = np.concatenate(([True], pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)))
            words, edge = words.filter(pa.array(new)), _edges(met)
            own = first + shapes(words)
            packed = np.frombuffer(met.buffers()[2], dtype="<u8", count=edge[-1] // 8)[edge[0] // 8 :]
            w = np.repeat(np.cumsum(new) - 1, np.diff(edge) // 8)
            seen = np.bincount(w * wide + (packed >> U(40)).astype(np.int64), weights=(packed & U((1 << 40) - 1)).astype(float), minlength=len(words) * wide).reshape(-1, wide)
            after, before, itself = seen[:, :k], seen[:, k:-1], seen[:, -1]
            total = after.sum(1) + itself
            best = np.zeros(len(words), dtype=np.int64)
            single = total == 1
            # words met once differ in few ways only
            key = (after.argmax(1) * k + before.argmax(1)) * SHAPES + own - first
            best[single] = once[key[single]]
            todo = np.flatnonzero(~single | (best < 0))
            for lo in range(0, len(todo), 256):
                at = todo[lo : lo + 256]
                best[at] = best_classes(after[at], before[at], itself[at], own[at], table, classes)
            once[key[single]] = best[single]
            return pa.RecordBatch.from_arrays([words, pa.array(total.astype(np.int64)), pa.array(best.astype(np.int32))], names=["word", "n", "class"])

        carry = None  # rows of the last word, of which more may come
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(b.schema.get_field_index(c)).cast(pa.binary()) for c in ("word", "met")]
            words, met = rows if carry is None else (pa.concat_arrays(x) for x in zip(carry, rows))
            cut = int(np.argmax(pc.equal(words, words[-1]).to_numpy(zero_copy_only=False)))
            if cut:
                yield done(words.slice(0, cut), met.slice(0, cut))
            carry = words.slice(cut), met.slice(cut)
        if carry is not None:
            yield done(*carry)

    rows = emit_rows(train.select(text_col), make, T.StructType.fromDDL("word binary, met binary"))
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(choose, "word binary, n long, class int")


def unseen_words(vocabulary: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each shape: tokens not seen in training against one seen (Good and Turing), and log10 of one unseen word's share.

    Of the words of a shape that occur once or twice, ``f1`` and ``f2``, some
    ``f1**2 / (2 * f2)`` are expected not to occur at all (Chao).
    """

    def make():
        few = np.zeros((SHAPES, 2), dtype=np.int64)

        def f(batch):
            words, n = (batch.column(batch.schema.get_field_index(c)) for c in ("word", "n"))
            np.add.at(few, (shapes(words.cast(pa.binary())), n.to_numpy() - 1), 1)
            return ()

        def end():
            yield [pa.array(np.arange(SHAPES, dtype=np.int64)), pa.array(few[:, 0]), pa.array(few[:, 1])]

        return f, end

    once, twice = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in emit_rows(vocabulary.filter("n <= 2").select("word", "n"), make, T.StructType.fromDDL("shape long, once long, twice long")).groupBy("shape").agg(F.sum("once").alias("once"), F.sum("twice").alias("twice")).collect():
        once[r["shape"]], twice[r["shape"]] = r["once"], r["twice"]
    return (once + 0.5) / (n + 0.5 * SHAPES), -np.log10(np.maximum(1.0, once**2 / (2 * np.maximum(twice, 1))))


def _learn(train: DataFrame, *, text_col: str = "text", exchange_words: int = EXCHANGE_WORDS, classes: int = CLASSES, head_words: int = HEAD_WORDS) -> tuple[ClassModel, DataFrame]:
    """The model less its transitions, and ``word, n, class`` of all training words."""
    spark = train.sparkSession
    ends = train.count()
    top = [(bytes(r["word"]), r["n"]) for r in count_words(train, text_col).orderBy(F.desc("n"), "word").limit(exchange_words).collect()]
    counts = count_bigrams(train, [w for w, _ in top], text_col)
    of = exchange(counts, len(top), classes)
    k, first = int(of.max()) + 1, int(of[len(top)])
    pick = np.zeros((len(counts), k))
    pick[np.arange(len(counts)), of] = 1.0
    named = {w: int(c) for (w, _), c in zip(top, of)}
    vocabulary = spark.createDataFrame([(bytearray(w), n, named[w]) for w, n in top], "word binary, n long, class int")
    if top:
        vocabulary = vocabulary.unionByName(class_words(train, named, pick.T @ counts @ pick, first, text_col))
    vocabulary = written(vocabulary, "lm-words")
    total, distinct, inside = np.zeros(k), 0, np.zeros(k)
    for r in vocabulary.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        total[r["class"]], distinct = r["n"], distinct + r["v"]
    for w, n in top:
        inside[named[w]] += n
    n = int(total.sum()) + ends
    unseen, unseen_word = unseen_words(vocabulary, n)
    model = ClassModel(
        head={bytes(r["word"]): (r["n"], r["class"]) for r in frequent(vocabulary, head_words).collect()},
        classes=named,
        emission={w: math.log10(n / inside[named[w]]) for w, n in top},
        clustered=np.log10(np.maximum(inside, 1) / np.maximum(total, 1)),
        class_total=np.maximum(total, 1),
        transition=None,
        first_shape=first,
        unseen=unseen,
        unseen_word=unseen_word,
        n=n,
        distinct=distinct + (ends > 0),
        ends=ends,
    )
    return model, vocabulary


def _transition(lines: DataFrame, model: ClassModel) -> np.ndarray:
    """log10 P(class | class before) over the class lines of the training texts.

    Shape classes occur in none; after any class they are as likely as after all.
    """
    kind, k = model.line_type, model.first_shape + SHAPES + 1

    def make():
        total = np.zeros(k * k, dtype=np.int64)

        def f(batch):
            total[:] += np.bincount(_steps(column(batch, "line"), kind, k)[0], minlength=k * k)
            return ()

        def end():
            at = np.flatnonzero(total)
            if len(at):
                yield [pa.array(at.astype(np.int64)), pa.array(total[at])]

        return f, end

    got = emit_rows(lines.select("line"), make, T.StructType.fromDDL("pair long, n long")).groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(k * k)
    n[got["pair"].to_numpy()] = got["n"].to_numpy()
    n = n.reshape(k, k)
    n[:, model.first_shape : k - 1] = n.sum(1, keepdims=True) * model.unseen
    tokens_of = n.sum(0)
    prior = (tokens_of + 1) / (tokens_of.sum() + k)
    return np.log10((n + PRIOR * prior) / (n.sum(1, keepdims=True) + PRIOR))


def _steps(lines: list[bytes], kind: np.dtype, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Class pairs ``before * k + class`` of texts laid end to end, and where each text's begin."""
    end = np.array([k - 1], dtype=kind).tobytes()
    line = np.frombuffer(end + b"".join([x + end for x in lines]), dtype=kind).astype(np.int64)
    sizes = np.array([len(x) // kind.itemsize + 1 for x in lines], dtype=np.int64)
    return line[:-1] * k + line[1:], np.cumsum(sizes) - sizes


def fit(train: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **sizes) -> tuple[ClassModel, DataFrame]:
    """The class model of the training texts and the table of all their words, counts and classes."""
    model, vocabulary = _learn(train, text_col=text_col, **sizes)
    model.transition = _transition(_lines(train, model, vocabulary, id_col, text_col), model)
    return model, vocabulary


def fit_and_score(docs: DataFrame, chosen: F.Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score_texts`` of all rows by the model of the chosen ones; ``chosen`` reads the id only."""
    model, vocabulary = _learn(docs.filter(chosen), text_col=text_col)
    lines = written(_lines(docs, model, vocabulary, id_col, text_col), "lm-lines")
    model.transition = _transition(lines.filter(chosen), model)
    return _scored(lines, model, id_col)


def score_texts(docs: DataFrame, model: ClassModel, vocabulary: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Null or empty texts hold the end alone. Repeated rows get a result each; other
    columns are not read. An empty table gives an empty result, an empty training set
    uniform probabilities.
    """
    return _scored(_lines(docs, model, vocabulary, id_col, text_col), model, id_col)


def _scored(lines: DataFrame, model: ClassModel, id_col: str) -> DataFrame:
    shared = lines.sparkSession.sparkContext.broadcast(model.transition.ravel())
    kind, k = model.line_type, len(model.transition)
    fields = ["n_tokens", "n_known", "base_score"]

    def make():
        step = shared.value

        def f(batch):
            pairs, at = _steps(column(batch, "line"), kind, k)
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            score = get("emission").to_numpy() + np.add.reduceat(step[pairs], at)
            yield [get(id_col), *map(get, fields), pa.array(score)]

        return f, None

    schema = T.StructType([lines.schema[c] for c in (id_col, *fields)] + [T.StructField("score", T.DoubleType())])
    done = emit_rows(lines.select(id_col, "line", *fields, "emission"), make, schema)
    return done.select(id_col, "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


_PART = "_row long, _two long, at int, word binary, other int, _id {id}, line binary, n_tokens long, n_known long, base_score double, emission double"


def _lines(docs: DataFrame, model: ClassModel, vocabulary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per text: the classes of its words laid end to end and what needs no transitions.

    Frequent words get their classes from the model, rare ones by a join, one row each
    time one occurs.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType.fromDDL(_PART.format(id=kind))
    names = [x.name for x in schema]

    def make():
        m = shared.value
        index = {w: i for i, w in enumerate(m.head)}
        n, of = (np.array([x[j] for x in m.head.values()] + [1 - j], dtype=np.int64) for j in (0, 1))
        base = np.log10((n + ADD) / m.base_total)
        emission = np.log10(n / m.class_total[of])
        for w, x in m.emission.items():
            if w in index:
                emission[index[w]] = x + m.clustered[m.classes[w]]
        of = of.astype(m.line_type)
        end_base = math.log10((m.ends + ADD) / m.base_total)

        def f(batch):
            rows, two, ids = (batch.column(batch.schema.get_field_index(c)) for c in ("_row", "_two", "_id"))
            texts = [tokens(t) for t in column(batch, text_col)]
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            flat = list(chain.from_iterable(texts))
            found = np.array([index.get(w, -1) for w in flat], dtype=np.int64)
            doc = np.repeat(np.arange(len(texts)), sizes)
            at = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[doc]
            hit = np.flatnonzero(found >= 0)
            per = lambda x=None: np.bincount(doc[hit], weights=None if x is None else x[found[hit]], minlength=len(texts))
            edge = np.concatenate(([0], np.cumsum(sizes) * of.itemsize)).astype(np.int32)
            line = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(edge), pa.py_buffer(of[found].tobytes())])
            some = pa.nulls(len(texts), pa.int32())
            # words that no text holds, dealt out evenly
            filler = pa.array([b" %d" % x for x in rows.to_pylist()], pa.binary())
            yield [rows, two, pa.array(np.full(len(texts), -1, dtype=np.int32)), filler, some, ids, line, pa.array(sizes + 1), pa.array(per() + int(m.ends > 0)), pa.array(per(base) + end_base), pa.array(per(emission), pa.float64())]
            rare = np.flatnonzero(found < 0)
            if len(rare):
                words, own = pa.array([flat[i] for i in rare.tolist()], pa.binary()), pa.array(doc[rare])
                other = pa.array((m.first_shape + shapes(words)).astype(np.int32))
                nothing = [pa.nulls(len(rare), t) for t in (ids.type, pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield [rows.take(own), two.take(own), pa.array(at[rare].astype(np.int32)), words, other, *nothing]

        return f, None

    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("_row"), F.xxhash64(F.lit(1), id_col, text_col).alias("_two"), text_col)
    parts = emit_rows(keyed, make, schema, rows=256)
    seen = parts.join(vocabulary, "word", "left").select(*[c for c in names if c not in ("word", "other")], F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", "other", F.lit(0)).alias("class"))
    # by one number, which Spark sorts by radix; `filled` orders what shares it
    ordered = seen.repartition("_row", "_two").sortWithinPartitions("_row")
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[schema[c] for c in ("line", "n_tokens", "n_known", "base_score", "emission")]])
    base_total, totals, cell = model.base_total, model.class_total, model.line_type
    unseen = np.zeros(len(totals) + SHAPES)
    unseen[model.first_shape : model.first_shape + SHAPES] = model.unseen_word

    def filled(part):
        """Whole texts: the rare words' classes go into the lines, equal rows get a result each."""
        get = lambda c: part.column(c).to_numpy()
        order = np.lexsort([get(c) for c in ("at", "_two", "_row")])
        row, two, at, n, of = (get(c)[order] for c in ("_row", "_two", "at", "n", "class"))
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (two[1:] != two[:-1])
        group, head, rare = np.cumsum(new) - 1, np.flatnonzero(new), np.flatnonzero(at >= 0)
        times = np.bincount(group[at < 0])
        main = part.take(pa.array(order[head]))
        lines = main.column("line").to_pylist()
        size = np.array([len(x) // cell.itemsize for x in lines], dtype=np.int64)
        whole = np.frombuffer(b"".join(lines), dtype=cell).copy()
        whole[(np.cumsum(size) - size)[group[rare]] + at[rare]] = of[rare]
        n, of = n[rare], of[rare]
        known = n > 0
        add = lambda x: np.bincount(group[rare], weights=x, minlength=len(head)) / times
        edge = np.concatenate(([0], np.cumsum(size) * cell.itemsize)).astype(np.int32)
        got = [
            main.column("_id").combine_chunks(),
            pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(edge), pa.py_buffer(whole.tobytes())]),
            main.column("n_tokens").combine_chunks(),
            pa.array(main.column("n_known").to_numpy() + np.rint(add(known)).astype(np.int64)),
            pa.array(main.column("base_score").to_numpy() + add(np.log10((n + ADD) / base_total))),
            pa.array(main.column("emission").to_numpy() + add(np.where(known, np.log10(np.maximum(n, 1) / totals[of]), unseen[of]))),
        ]
        each = pa.array(np.repeat(np.arange(len(head)), times))
        return pa.RecordBatch.from_arrays([x.take(each) for x in got], names=[x.name for x in out])

    def fill(batches):
        carry = None
        for b in batches:
            part = pa.Table.from_batches([b])
            row = part.column("_row").to_numpy()
            last = np.flatnonzero(row != row[-1]) if len(row) else []
            if not len(row):
                continue
            end = int(last[-1]) + 1 if len(last) else 0
            before = [carry] if carry is not None else []
            if end:
                yield filled(pa.concat_tables([*before, part.slice(0, end)]).combine_chunks())
                carry = part.slice(end)
            elif before and carry.column("_row")[0].as_py() != int(row[0]):
                yield filled(carry.combine_chunks())
                carry = part
            else:
                carry = pa.concat_tables([*before, part])
        if carry is not None and carry.num_rows:
            yield filled(carry.combine_chunks())

    return ordered.mapInArrow(fill, out)
