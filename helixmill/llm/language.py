"""Language by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A document is cut greedily into phrases, each the longest
match with a substring of that text; a letter that the text does not have is a phrase of its own. Few phrases mean that the text is like
the language. Counts are normalised by the phrases that text of the language itself needs for as many letters, measured
on labelled text that is not in the automaton; the language with the smallest ratio wins.

Texts are reduced to lower-case letters and single spaces. A text is parsed whole. Pieces of many texts are walked through all
automata at once, one letter in each step; where a phrase runs over the end of a piece, the next piece is walked again
from there until a phrase begins where one began before, from which on both parses are the same."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec
from .ctw import held_out

#: Distinct labelled texts of a language that are learnt from, drawn by a hash, and letters of the piece drawn from each.
SAMPLE_DOCS, SAMPLE_LETTERS = 400, 300
#: Letters of a language's automaton, and as many to normalise by: the pieces of half the texts, with spaces between.
LETTERS = SAMPLE_DOCS // 2 * (SAMPLE_LETTERS + 1)
#: Letters that are walked at once; no result depends on it.
PIECE = 2_048
#: Letters whose steps lie in a dense table, the most frequent ones; steps by others are searched for.
DENSE = 64
SLICE_BYTES = 4 << 20


def letters(text: str | None) -> str:
    """Lower-case letters and the marks that follow them, with one space for whatever is between them."""
    import regex

    return " ".join(regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower()))


def piece(text: str, h: int) -> str:
    """SAMPLE_LETTERS letters of a text from a place drawn by the hash, over the whole text."""
    whole = letters(text)
    at = h % (max(len(whole) - SAMPLE_LETTERS, 0) + 1)
    return whole[at : at + SAMPLE_LETTERS].strip()


class Automaton:
    """The suffix automaton of a text: for each state, the next one by letter."""

    def __init__(self, text: str, number: dict[str, int]):
        link, length, step = [-1], [0], [{}]
        last = 0
        for c in map(number.__getitem__, text):
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            step.append({})
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    step.append(dict(step[q]))
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.steps = step


class Model:
    """Automata of all languages in one, and phrases a letter by which each language's count is divided."""

    def __init__(self, texts: dict[str, list[str]]):
        self.names = sorted(texts)
        halves = {n: (" ".join(texts[n][0::2])[:LETTERS], texts[n][1::2] or texts[n]) for n in self.names}
        often = Counter(" ")
        for a, _ in halves.values():
            often.update(a)
        alphabet = sorted(often, key=lambda c: (-often[c], c))
        number = {c: i for i, c in enumerate(alphabet)}
        self.width, self.dense = len(alphabet) + 1, min(len(alphabet), DENSE)  # the last letter is one unknown to all
        automata = [Automaton(halves[n][0], number).steps for n in self.names]
        starts = np.cumsum([0, *map(len, automata)], dtype=np.int64)
        self.roots = starts[:-1]
        self.table = np.full((int(starts[-1]), self.dense), -1, np.int32)
        self.first = np.full((len(self.names), self.width), -1, np.int64)  # where each letter leads from the roots
        keys, to = [], []
        for r, steps in zip(self.roots.tolist(), automata, strict=True):
            for i, step in enumerate(steps):
                for c, t in step.items():
                    if c < self.dense:
                        self.table[r + i, c] = r + t
                    else:
                        keys.append((r + i) * self.width + c)
                        to.append(r + t)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.to = np.array(keys, np.int64)[order], np.array(to, np.int64)[order]
        for i, steps in enumerate(automata):
            for c, t in steps[0].items():
                self.first[i, c] = self.roots[i] + t
        self.code = np.full(0x110000, len(alphabet), np.uint16)
        self.code[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
        self.rate = np.ones(len(self.names))
        for i, n in enumerate(self.names):
            other = " ".join(halves[n][1])[:LETTERS]
            if other:
                self.rate[i] = self.phrases([other])[0, i] / len(other)

    def _next(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where the letters c (one for each row) lead from the states of a row; -1 where there is no step."""
        to = self.table.ravel()[state * self.dense + np.minimum(c, self.dense - 1)[:, None]].astype(np.int64)
        rare = np.flatnonzero(c >= self.dense)
        if len(rare):
            asked = state[rare] * self.width + c[rare, None]
            at = np.searchsorted(self.keys, asked.ravel()).reshape(asked.shape)
            there = at < len(self.keys)
            there[there] = self.keys[at[there]] == asked[there]
            to[rare] = -1
            found = to[rare]
            found[there] = self.to[at[there]]
            to[rare] = found
        return to

    def _step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The next states, whether a phrase begins with this letter, whether one ends before it, and whether it is one itself."""
        to = self._next(state, c)
        cut = to < 0
        ends = cut & (state != self.roots)
        again = self.first[:, c].T
        alone = cut & (again < 0)
        return np.where(cut, np.where(again < 0, self.roots, again), to), cut | (state == self.roots), ends, alone

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text (row) by each language (column)."""
        k = len(self.names)
        out = np.zeros((len(texts), k), np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        if not k or not sizes.sum():
            return out
        code = self.code[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)].astype(np.int64)
        ends = np.cumsum(sizes)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (ends - sizes)[owner] + rank * PIECE
        length = np.minimum(sizes[owner] - rank * PIECE, PIECE)
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.where(rank > 0, place[np.maximum(np.arange(len(order)) - 1, 0)], -1)[order]
        begin, length, owner = begin[order], length[order], owner[order]
        steps = int(length[0])
        live = np.searchsorted(-length, -np.arange(steps), "left")  # pieces longer than each step
        follows = bool((before >= 0).any())  # only then are the places where phrases begin needed again
        state = np.repeat(self.roots[None, :], len(begin), 0)
        count = np.zeros((len(begin), k), np.int64)
        fresh, closed = [], []
        for t in range(steps):
            m = live[t]
            state[:m], new, done, alone = self._step(state[:m], code[begin[:m] + t])
            count[:m] += done
            if follows:
                fresh.append(new)
                closed.append(count[:m].astype(np.int32))
            count[:m] += alone
        if follows:
            self._joined(code, begin, length, before, state, count, fresh, closed)
        last = np.ones(len(begin), bool)
        last[before[before >= 0]] = False
        np.add.at(out, owner, count)
        np.add.at(out, owner[last], (state != self.roots)[last])
        return out

    def _joined(self, code, begin, length, before, state, count, fresh, closed) -> None:
        """Puts right the counts and last states of pieces that follow another one: each is walked again from the state in
        which the one before it ends, until a phrase begins where one began in its own parse."""
        own_state, own_count = state.copy(), count.copy()
        todo = np.flatnonzero(before >= 0)
        while len(todo):
            lane, now = todo, state[before[todo]]
            ended = np.zeros(now.shape, np.int64)
            active = np.ones(now.shape, bool)
            old = state[todo].copy()
            t = 0
            while len(lane):
                over = length[lane] <= t
                if over.any():
                    rows = lane[over]
                    state[rows] = np.where(active[over], now[over], state[rows])
                    count[rows] = np.where(active[over], ended[over], count[rows])
                    lane, now, ended, active = lane[~over], now[~over], ended[~over], active[~over]
                    continue
                now, new, done, alone = self._step(now, code[begin[lane] + t])
                ended += done
                same = active & new & fresh[t][lane]
                if same.any():
                    state[lane] = np.where(same, own_state[lane], state[lane])
                    count[lane] = np.where(same, ended + own_count[lane] - closed[t][lane], count[lane])
                    active &= ~same
                    go = active.any(1)
                    lane, now, ended, active, alone = lane[go], now[go], ended[go], active[go], alone[go]
                ended += alone
                t += 1
            changed = todo[(state[todo] != old).any(1)]
            todo = np.flatnonzero(np.isin(before, changed)) if len(changed) else changed

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each reduced text (`und` if it is empty) and how far it leads: 0 for a tie, towards 1."""
        ratio = self.phrases(texts) / (self.rate * np.maximum([[len(t)] for t in texts], 1))
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = ratio.argmin(1)
        ranked = np.sort(ratio, 1)
        lead = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-12) if len(self.names) > 1 else np.ones(len(texts))
        none = np.array([not t for t in texts])
        return [("und" if z else self.names[b]) for b, z in zip(best, none, strict=True)], np.where(none, 0.0, np.clip(lead, 0, 1))


def fit(docs: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text") -> Model:
    """A model of the languages named in docs; rows without language or letters teach nothing. The sample of each language
    is SAMPLE_DOCS distinct texts of smallest hash, each of which teaches a piece drawn from all of it: ranks are taken in 64 parts of a language first, so no task ranks all its rows."""
    pick = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    pick = pick.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    small = pick.select("lang", "h").distinct().withColumn("part", F.pmod("h", F.lit(64)))
    w = Window.partitionBy("lang", "part").orderBy("h")
    small = small.withColumn("r", F.row_number().over(w)).filter(f"r <= {SAMPLE_DOCS}")
    small = small.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(f"r <= {SAMPLE_DOCS}")
    texts: dict[str, list[str]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [piece(t, h) for t, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("r"), pa.array(drawn, pa.string())], ["lang", "r", "text"])

    drawn = pick.join(F.broadcast(small.select("lang", "h", "r")), ["lang", "h"]).select("lang", "r", "h", "text")
    drawn = drawn.mapInArrow(run, f"lang {pick.schema['lang'].dataType.simpleString()}, r int, text string").distinct()
    for r in drawn.orderBy("lang", "r").collect():  # SAMPLE_DOCS for each language
        texts.setdefault(r.lang, []).append(r.text)
    return Model({n: [x for x in t if x] for n, t in texts.items() if any(t)})


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score for each row, from its whole text alone.

    Null texts and texts without letters are `und` with score 0, as are all if nothing was learnt. score: by what share the
    best language needs fewer normalised phrases than the second (0: a tie, which the first name in order wins). Null keys
    and repeated rows are rows like others; other columns are ignored."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.slices(batches, "text", SLICE_BYTES):
            names, lead = shared.value.predict([letters(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(names), pa.array(lead)], ["key", "lang_pred", "score"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def evaluate(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred and score for all documents, by a model of those that are not held out."""
    model = fit(docs.filter(~held_out("doc_id", folds)))
    return predict(docs, model).select("doc_id", held_out("doc_id", folds).alias("held_out"), "lang_pred", "score")
