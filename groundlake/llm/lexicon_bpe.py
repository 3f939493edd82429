"""BPE encoding and decoding over a minimal acyclic transducer of frequent words.

The corpus' frequent words are compiled into one automaton that shares suffixes as
well as prefixes; walking a word sums path counts, which number the accepted words, and
that number leads to the word's ids. The automaton is one flat byte string, memory
mapped by every worker. Words outside it are merged exactly, pair by pair.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import struct
import tempfile
import unicodedata
from collections import Counter
from itertools import pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, emit_rows, frequent, map_columns, without, written

#: Fixed values of the tokenizer's file: how it cuts a normalised text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\p{White_Space}{L}{N}]+"
END = "</w>"
NONE = 1 << 62


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


#: Code points that became letters or numbers after Unicode 16, which the
#: tokenizer's files are read with; the regex module may count them as such.
LATE = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]

#: Capitals that this Python's lower() may not know yet.
LATE_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATE_LOWER |= {0x10D50 + i: 0x10D70 + i for i in range(22)} | {0x16EA0 + i: 0x16EBB + i for i in range(25)}
_LATE_CAPITAL = regex.compile("[" + "".join(map(chr, LATE_LOWER)) + "]")


def piece_pattern() -> str:
    """``PIECES`` with letters and numbers as of Unicode 16."""
    less = "--[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in LATE) + "]"
    return PIECES.replace("{L}", f"[\\p{{L}}{less}]").replace("{N}", f"[\\p{{N}}{less}]")


class Vocabulary:
    """Ids, merge ranks and special texts of a word-end BPE file (content, not path)."""

    def __init__(self, content: str):
        data = json.loads(content)
        model = data["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: pair of ids to its rank and the merged id, packed: the least is merged first
        self.pairs = {self.ids[a] << 20 | self.ids[b]: rank << 20 | self.ids[a + b] for rank, (a, b) in reversed(list(enumerate(merges)))}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.tokens = {i: t for t, i in (*self.ids.items(), *self.special.items())}
        letters = byte_letters()
        self._first = [self.ids[c] for c in letters]
        self._last = [self.ids[c + END] for c in letters]
        #: what a byte's letter and the next byte's merge to, neither of them a piece's last
        self._near = [[self.pairs.get(a << 20 | b, NONE) for b in self._first] for a in self._first]
        #: each id's decimal
        self.decimals = {i: str(i) for i in self.tokens}
        self._odd, self._space = regex.compile("[\x1c-\x1f]"), regex.compile(r"\p{White_Space}+")
        self._cut = regex.compile(piece_pattern(), regex.V1)
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        """The runs between white space, in which all pieces and special texts lie."""
        return self._space.split(text) if self._odd.search(text) else text.split()

    def pieces(self, word: str) -> list[str]:
        """The pieces of one word, normalised; a special text stays whole."""
        if self._special is None or not any([t in word for t in self.special]):
            word = normal(word)
            if word.isalpha():
                return [word]
            if word[-1:] in (".", ",") and word[:-1].isalpha():
                return [word[:-1], word[-1]]
            return self._cut.findall(word)
        out: list[str] = []
        for part in self._special.split(word):
            out += [part] if part in self.special else self._cut.findall(normal(part))
        return out

    def encode(self, word: str) -> list[int]:
        """The ids of one word, merged piece by piece."""
        pieces = self.pieces(word)
        return self.merge(pieces[0]) if len(pieces) == 1 else [i for p in pieces for i in self.merge(p)]

    def merge(self, piece: str) -> list[int]:
        """Exact ids of one piece: always the lowest-ranked pair, the leftmost of equals."""
        if piece in self.special:
            return [self.special[piece]]
        raw, first, near = piece.encode(), self._first, self._near
        ids = [first[b] for b in raw]
        ids[-1] = self._last[raw[-1]]
        if len(ids) > 60:
            return self._long(ids)
        pairs, none = self.pairs.get, NONE
        found = [near[a][b] for a, b in pairwise(raw)]
        if found:
            found[-1] = pairs(ids[-2] << 20 | ids[-1], none)
        while found and (best := min(found)) < none:
            i = found.index(best)
            ids[i] = best & 0xFFFFF
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = pairs(ids[i - 1] << 20 | ids[i], none)
            if i < len(found):
                found[i] = pairs(ids[i] << 20 | ids[i + 1], none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, for pieces of any length."""
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        pairs = self.pairs.get
        heap = [(m, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := pairs(a << 20 | b)) is not None]
        heapq.heapify(heap)
        alive = list(ids)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if alive[i] != a or j < 0 or alive[j] != b:
                continue
            alive[i], alive[j] = m & 0xFFFFF, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) >= 0 and (m := pairs(alive[left] << 20 | alive[right])) is not None:
                    heapq.heappush(heap, (m, left, alive[left], alive[right]))
        return [i for i in alive if i >= 0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids as the file's (absent) decoder gives it: tokens joined by a blank."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


def normal(text: str) -> str:
    """NFC and lower case, each code point by itself (a final sigma stays a sigma)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    if _LATE_CAPITAL.search(text):
        text = text.translate(LATE_LOWER)
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


def compile_lexicon(words: dict[str, list[int]]) -> bytes:
    """A minimal acyclic automaton over the words' UTF-8 with their ids as output.

    All arcs lie in one table: a state is a place in it, and its arc for byte b, if it
    has one, is at place + b and says b + 1 there. No two states share a place. Layout:
    ``<4I`` header (table size, outputs, ids, root place), then per slot the target's
    place and the accepted words passed over, output offsets, ids, per slot label and
    whether the state placed there accepts.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    paths: list[int] = []

    def freeze(node) -> int:
        key = (node[0], tuple(node[1]))
        if (at := register.get(key)) is None:
            at = register[key] = len(states)
            states.append(key)
            paths.append(key[0] + sum(paths[t] for _, t in key[1]))
        return at

    order = sorted(w.encode("utf-8", "surrogatepass") for w in words)
    spine: list[list] = [[False, []]]
    last = b""
    for w in order:
        same = 0
        while same < len(last) and last[same] == w[same]:
            same += 1
        while len(spine) > same + 1:
            child = freeze(spine.pop())
            spine[-1][1].append((last[len(spine) - 1], child))
        spine += [[False, []] for _ in w[same:]]
        spine[-1][0] = True
        last = w
    while len(spine) > 1:
        child = freeze(spine.pop())
        spine[-1][1].append((last[len(spine) - 1], child))
    root = freeze(spine[0])
    room = sum(len(a) for _, a in states) + len(states) + 1024
    used, taken = bytearray(4 * room), bytearray(4 * room)
    place = [0] * len(states)
    start, arcs_before = 0, 256
    for s in sorted(range(len(states)), key=lambda s: -len(states[s][1])):
        labels = [b for b, _ in states[s][1]]
        if len(labels) != arcs_before and len(labels) < 3:
            start = 0
        arcs_before = len(labels)
        at, tries = start, 0
        while taken[at] or any([used[at + b] for b in labels]):
            at, tries = at + 1, tries + 1
            if tries % 40 == 0:  # crowded here: later states begin further on
                start = at
            if at + 512 > len(used):
                used += bytes(len(used))
                taken += bytes(len(taken))
        taken[at], place[s] = 1, at
        for b in labels:
            used[at + b] = 1
    size = max(place) + 257
    label, target, skipped, accept = [np.zeros(size, k) for k in ("<u2", "<u4", "<u4", "u1")]
    for s, (final, arcs) in enumerate(states):
        accept[place[s]] = final
        count = int(final)
        for b, to in arcs:
            at = place[s] + b
            label[at], target[at], skipped[at] = b + 1, place[to], count
            count += paths[to]
    outputs = [words[w.decode("utf-8", "surrogatepass")] for w in order]
    offsets = np.cumsum([0, *map(len, outputs)]).astype("<u4")
    flat = np.array([i for ids in outputs for i in ids], dtype="<u4")
    head = struct.pack("<4I", size, len(outputs), len(flat), place[root])
    return head + b"".join(x.tobytes() for x in (target, skipped, offsets, flat, label, accept))


class Lexicon:
    """A compiled automaton, memory mapped from a file of this process alone."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(compiled)
            f.flush()
            view = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        size, outputs, ids, self._root = struct.unpack_from("<4I", view)
        at, cut = 16, []
        for n, kind in ((size, "I"), (size, "I"), (outputs + 1, "I"), (ids, "I"), (size, "H"), (size, "B")):
            end = at + n * struct.calcsize(kind)
            cut.append(view[at:end].cast(kind))
            at = end
        self._target, self._skipped, self._offsets, self._ids, self._label, self._accept = cut

    def get(self, word: bytes) -> list[int] | None:
        """The ids of ``word``, or ``None`` where the automaton does not accept it."""
        state, number, label, target, skipped = self._root, 0, self._label, self._target, self._skipped
        for b in word:
            at = state + b
            if label[at] != b + 1:
                return None
            number += skipped[at]
            state = target[at]
        if not self._accept[state]:
            return None
        return self._ids[self._offsets[number] : self._offsets[number + 1]].tolist()


class Shown:
    """Words as their number of ids, the ids and the decoded text.

    Words that differ in capitals or in marks share the merges of their pieces, of which
    ``most`` are kept.
    """

    def __init__(self, vocabulary: Vocabulary, most: int):
        self.v, self.most = vocabulary, most
        self.pieces: dict[str, tuple] = {}

    def ids(self, ids: list[int]) -> tuple[int, str, str]:
        decimals, tokens = self.v.decimals, self.v.tokens
        return len(ids), " ".join([decimals[i] for i in ids]), " ".join([tokens[i] for i in ids])

    def piece(self, piece: str) -> tuple[int, str, str]:
        got = self.pieces.get(piece)
        if got is None:
            if len(self.pieces) >= self.most:
                self.pieces.clear()
            got = self.pieces[piece] = self.ids(self.v.merge(piece))
        return got

    def word(self, word: str) -> tuple[int, str, str]:
        parts = [self.piece(p) for p in self.v.pieces(word)]
        if len(parts) == 1:
            return parts[0]
        return sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])


def most(counts: Counter, size: int) -> list[tuple[str, int]]:
    """``counts.most_common(size)`` by a sort, as a heap of so many is slower."""
    return sorted(counts.items(), key=itemgetter(1), reverse=True)[:size]


def frequent_words(docs: DataFrame, vocabulary, size: int, text_col: str = "text") -> list[str]:
    """The words seen most in all texts, at most ``size``, counted by summaries of bounded size.

    A task keeps at most ``8 * size`` counters and drops the rarest beyond that, so the
    counts are lower bounds. They only choose what the automaton holds; ids do not
    depend on them.
    """

    def make():
        v, seen = vocabulary.value, Counter()

        def f(batch):
            for text in column(batch, text_col):
                if text:
                    seen.update(v.words(text))
            if len(seen) > 8 * size:
                kept = most(seen, 4 * size)
                seen.clear()
                seen.update(dict(kept))
            return ()

        def end():
            top = most(seen, size)
            if top:
                yield [pa.array([w for w, _ in top]), pa.array([n for _, n in top], pa.int64())]

        return f, end

    parts = emit_rows(docs.select(text_col), make, T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]))
    counts = written(parts.groupBy("word").agg(F.sum("n").alias("n")), "bpe-words")
    return [r.word for r in frequent(counts, size).collect()]


def encode_texts(docs: DataFrame, tokenizer_json: str, *, lexicon_size: int = 50_000, cache_size: int = 350_000, text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens, ids_sha256, decoded_sha256`` (and, if asked for, ``ids`` and ``decoded``).

    A null or empty text has no ids and decodes to the empty text. Texts are processed
    whole, however long. Columns with these names are replaced, all others stay;
    repeated rows and an empty table need no special care.
    ``tokenizer_json`` is the path of the file on the driver; its content is broadcast
    (a fixed 2 MB), and so is the automaton (at most ``lexicon_size`` words).
    """
    spark = docs.sparkSession
    with open(tokenizer_json, encoding="utf-8") as f:
        v = Vocabulary(f.read())
    vocabulary = spark.sparkContext.broadcast(v)
    compiled = spark.sparkContext.broadcast(compile_lexicon({w: v.encode(w) for w in frequent_words(docs, vocabulary, lexicon_size, text_col)}))
    docs = without(docs, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    fields += [T.StructField("decoded", T.StringType())] if with_text else []

    def make():
        v, lexicon = vocabulary.value, Lexicon(compiled.value)
        known: dict[str, tuple] = {}
        before: dict[str, tuple] = {}  # what was known when it last grew full
        shown = Shown(v, cache_size)

        def look_up(word):
            nonlocal before
            got = before.get(word)
            if got is None:
                ids = lexicon.get(word.encode("utf-8", "surrogatepass"))
                got = shown.word(word) if ids is None else shown.ids(ids)
            if len(known) >= cache_size:
                before = dict(known)
                known.clear()
            known[word] = got
            return got

        def f(batch):
            sizes, hashes, texts, all_ids, decoded = [], [], [], [], []
            for text in column(batch, text_col):
                got = [known.get(w) or look_up(w) for w in v.words(text or "") if w]
                got = [g for g in got if g[0]]
                sizes.append(sum([g[0] for g in got]))
                line = " ".join([g[1] for g in got])
                hashes.append(hashlib.sha256(line.encode()).hexdigest())
                whole = " ".join([g[2] for g in got])
                texts.append(hashlib.sha256(whole.encode()).hexdigest())
                if with_ids:
                    all_ids.append(np.fromstring(line, dtype=np.int32, sep=" "))
                if with_text:
                    decoded.append(whole)
            out = [pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())]
            if with_ids:
                edge = np.cumsum([0, *sizes], dtype=np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate([*all_ids, np.zeros(0, np.int32)]))))
            return out + [pa.array(decoded, pa.string())] if with_text else out

        return f

    return map_columns(docs, make, fields, docs.columns)
