"""Toxicity of texts, through a noisy channel.

A character model (trigrams counted over all documents) judges what a
disguised token was meant to be: a token's lattice offers for each character
itself, the letters it can stand for (leetspeak), nothing (a separator put
inside a word), and for a run of one letter one or two of it; letters spaced
apart are joined first; a mark at an end of a token may be a letter or none.
Viterbi finds the likeliest letters for each pair of last letters; these
readings and the token as it stands are then scored, at any length. Between
neighbouring tokens the blank may be nothing: whatever a row of tokens spells
that is evidence is looked up, and the character model judges the blanks.

The scorer is learned from labelled documents, at most ``TRAIN_ROWS`` of them,
chosen by a hash of doc_id: words and word beginnings that toxic documents use
in many different contexts and clean ones don't (contexts, so that copies of
one document don't count as evidence), with a logistic calibration of a
document's strongest evidence, fitted on at most ``CALIBRATION_ROWS`` of them,
each half judged by evidence from the other. Everything else covers all documents.

A null or empty text has no evidence and gets the score of that. Null labels and
null ids aren't learned from; a doc_id labelled both ways counts as toxic.
Repeated rows get a row each, other columns are ignored, an empty table gives
no rows; without labels of both kinds every score is the prior.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlens.llm.frames import texts_of
from planlens.llm.worker_memory import give_back, slices
from planlens.workspace import ship_package

#: Labelled documents used for fitting, at most, and those of them that calibrate.
TRAIN_ROWS, CALIBRATION_ROWS = 20_000, 4_000
#: Contexts a feature needs in toxic documents.
LEAST_CONTEXTS = 12
#: Counts that a learning task holds before it passes them on, tokens whose readings it keeps, and characters whose trigrams it counts at once: memory and speed only.
COUNTS_HELD, READINGS_KEPT, CHARACTERS_AT_ONCE = 100_000, 30_000, 1 << 18

#: Letters of the character model besides a-z.
ACCENTED = "àâäáãåæçèéêëìíîïñòóôöõœùúûüýÿß"
#: Letters that a character can stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c"}
#: Characters put inside a word to break it.
SEPARATORS = ".-_*'~^"
#: Log probabilities of the channel.
SUBSTITUTED, SEPARATED, KEPT_ODD, REPEATED, HALVED = -1.5, -0.5, -20.0, -0.5, -3.0

#: How much likelier blanks inside a word with evidence may be than none, as a log probability.
JOINED = -3.0
#: Added to the evidence of a token that begins a word with evidence; evidence is below it.
OPEN = 1024.0

_EDGE = 0
_CLASS = {c: k + 1 for k, c in enumerate("abcdefghijklmnopqrstuvwxyz" + ACCENTED)}
_OTHER = 63
_TABLE = np.full(0x300, 62, np.uint8)  # letters beyond ours share one class
_TABLE[:0x80] = _EDGE
for _c, _k in _CLASS.items():
    if ord(_c) < 0x300:
        _TABLE[ord(_c)] = _k


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all documents, by class; words have edges around them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 18, np.int64)
        for batch in slices(batches):
            texts = "  ".join(text.lower() for text in batch.column(0).to_pylist() if text)
            texts = f"  {texts}  " if texts else ""
            for k in range(0, len(texts) - 2, CHARACTERS_AT_ONCE):  # a part has the first two characters of the next
                code = np.frombuffer(texts[k : k + CHARACTERS_AT_ONCE + 2].encode("utf-32-le", "replace"), np.uint32)
                c = _TABLE[np.minimum(code, 0x2FF)].astype(np.int32)
                total += np.bincount(c[:-2] << 12 | c[1:-1] << 6 | c[2:], minlength=1 << 18)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["gram", "n"])

    out = np.zeros(1 << 18, np.int64)
    for r in docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most 2 ** 18
        out[r["gram"]] = r["n"]
    return out


class CharacterModel:
    """Log probability of a letter after two others, interpolated with shorter histories."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(64, 64, 64).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + 64)
        p2 = (two + 4 * p1) / (two.sum(axis=1, keepdims=True) + 4)
        self.log = array("f", np.log((three + 4 * p2) / (three.sum(axis=2, keepdims=True) + 4)).astype(np.float32).tobytes())

    def readings(self, token: str, marks: bool = True) -> list[str]:
        """The likeliest letters behind ``token`` for each pair of last letters, likeliest first.

        A state is the classes of the last two letters; texts are chains of their
        parts, so the cost is linear in the token. Without ``marks`` those at the ends
        have to be letters.
        """
        log = self.log
        first = next((k for k, c in enumerate(token) if c.isalnum()), len(token))
        last = next((k for k in range(len(token) - 1, -1, -1) if token[k].isalnum()), len(token))
        beam: dict[int, tuple[float, tuple | None]] = {_EDGE: (0.0, None)}
        k = 0
        while k < len(token):
            char, run = token[k], 1
            while k + run < len(token) and token[k + run] == char:
                run += 1
            if run == 1 and len(beam) == 1 and char in _CLASS:  # no choice, so no need of scores
                ((state, (score, text)),) = beam.items()
                beam = {(state << 6 | _CLASS[char]) & 0xFFF: (score, (text, char))}
                k += 1
                continue
            options = emissions(char, run, marks and not first <= k <= last)
            step: dict[int, tuple[float, tuple | None]] = {}
            if len(beam) == len(options) == 1:  # no choice, so no need of scores
                ((state, (score, text)),), ((letters, _),) = beam.items(), options
                for c in letters[-2:]:
                    state = (state << 6 | _CLASS.get(c, _OTHER)) & 0xFFF
                step[state] = (score, (text, letters))
            else:
                for before, (score, text) in beam.items():
                    for letters, cost in options:
                        state, total = before, score + cost
                        for c in letters:
                            z = _CLASS.get(c, _OTHER)
                            at = state << 6 | z
                            total += log[at] if z != _OTHER else KEPT_ODD
                            state = at & 0xFFF
                        if state not in step or total > step[state][0]:
                            step[state] = (total, (text, letters))
            beam = step
            k += run
        out = []
        for _, text in sorted(((score + log[state << 6 | _EDGE], text) for state, (score, text) in beam.items()), key=lambda x: -x[0]):
            parts = []
            while text:
                text, letters = text
                parts.append(letters)
            out.append("".join(reversed(parts)))
        return out


@lru_cache(4_096)
def emissions(char: str, run: int, outside: bool = False) -> list[tuple[str, float]]:
    """What a run of one character can stand for, with log probabilities; a mark ``outside`` of a word can be just that."""
    if char in _CLASS:
        if run == 1:
            return [(char, 0.0)]
        return [(char, HALVED), (char * 2, 0.0)] if run == 2 else [(char, REPEATED), (char * 2, REPEATED)]
    out = [(char * run, 0.0)]
    for letter in LEET.get(char, ""):
        out += [(letter, SUBSTITUTED * (1 if run < 3 else 1.5))] + ([(letter * 2, SUBSTITUTED * 2)] if run == 2 else [])
    if outside:
        out.append(("", 0.0))
    elif char in SEPARATORS:
        out.append(("", SEPARATED))
    return out


#: Marks around a token; an opening bracket can also be a letter.
_MARKS = "\"#%&'()*,./:;<=>?[]\\^_`{}~…«»„“”‘’–—-"
_SURE_MARKS = _MARKS.replace("(", "")
_TAIL = re.compile(r"([$@!|+])\1+$|[!|+]$")
_DISGUISED = re.compile(rf"[{re.escape(''.join(LEET) + SEPARATORS)}]|([^\W\d_])\1")


def readings_of(token: str, model: CharacterModel) -> tuple[str, ...]:
    """What a token may say, in lower case without marks around it: likeliest first, as it stands last."""
    lower = token.lower()
    if lower.isalpha():
        plain = inner = lower
    else:
        plain = _TAIL.sub("", lower.strip(_MARKS)).strip(_MARKS)
        inner = lower.strip(_SURE_MARKS)
    if not _DISGUISED.search(inner):
        return (plain,)
    ends = inner[0].isalnum() and inner[-1].isalnum()
    return tuple(dict.fromkeys((*model.readings(inner), *(() if ends else model.readings(inner, marks=False)), plain)))


def spaced_runs(tokens: list[str], least: int = 3) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of ``least`` or more tokens of one character."""
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    single = np.concatenate([[False], lengths == 1, [False]])
    edges = np.flatnonzero(single[1:] != single[:-1])
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a >= least:
            yield a, b


def restored_tokens(text: str, model: CharacterModel, known: dict[str, tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Readings of the tokens of a whole text; letters spaced apart are also joined."""
    tokens = text.split()
    out = []
    for t in tokens:
        r = known.get(t)
        if r is None:
            r = known[t] = readings_of(t, model)
        out.append(r)
    out += [readings_of("".join(tokens[a:b]), model) for a, b in spaced_runs(tokens)]
    return out


def beginnings(word: str) -> tuple[str, ...]:
    """The features of a word: itself and its first four to six letters."""
    return (word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) >= n))


@dataclass
class Scorer:
    """Evidence of features, and what a document's evidence means."""

    evidence: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)
    prior: float = -2.0

    @cached_property
    def heads(self) -> set[str]:
        """First three letters of all features; a word with others has no evidence."""
        return {f[:3] for f in self.evidence}

    def of_word(self, word: str) -> float:
        return max(map(self.evidence.get, beginnings(word), repeat(0.0)), default=0.0) if word[:3] in self.heads else 0.0

    @cached_property
    def openings(self) -> set[str]:
        """Proper beginnings of the words and beginnings with evidence."""
        return {f[:n] for f in self.evidence for n in range(1, len(f.removesuffix("*")))}

    def of_readings(self, words: tuple[str, ...]) -> float:
        return max(map(self.of_word, words), default=0.0)

    def of_document(self, strongest: float, hits: int, words: int) -> float:
        x = (strongest, min(hits, 5), hits / max(words, 20))
        z = self.prior + sum(w * v for w, v in zip(self.weights, x))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def blanks(before: str, pieces: tuple[str, ...], after: str, model: CharacterModel) -> float:
    """How much likelier ``pieces`` are as one word between two blanks than as they stand.

    ``before`` and ``after`` are letters spaced apart around them, between which
    nothing says where words end; empty where there are none.
    """
    log = model.log

    def total(text: str) -> float:
        state, out = 0, 0.0
        for c in text:
            at = state << 6 | (_EDGE if c == " " else _CLASS.get(c, _OTHER))
            out, state = out + log[at], at & 0xFFF
        return out

    word = "".join(pieces)
    if before or after:
        return total(f"  {before} {word} {after}  ".replace("   ", "  ")) - total(f"  {before}{word}{after}  ")
    return total(f"  {word}  ") - total(f"  {' '.join(pieces)}  ")


def joined_evidence(tokens: list[str], start: int, scorer: Scorer, model: CharacterModel, said: Callable[[str], tuple[str, ...]]) -> float:
    """The strongest evidence of a word whose pieces begin at a token.

    A whole word with evidence counts unless the blanks are far likelier
    (``JOINED``), a beginning with evidence only if the word is likelier.
    """
    best = 0.0
    rows = [(r,) for r in said(tokens[start]) if r in scorer.openings]

    def near(places: tuple[int, int]) -> str:
        """Up to two letters spaced apart, the nearest first."""
        letters = ""
        for k in places:
            if not 0 <= k < len(tokens) or len(tokens[k]) != 1:
                break
            letters += said(tokens[k])[0]
        return letters

    k = start + 1
    while rows and k < len(tokens):
        longer = []
        for row in rows:
            head = "".join(row)
            for r in said(tokens[k]):
                word = head + r
                if not r:
                    continue
                if word in scorer.openings:
                    longer.append((*row, r))
                whole = scorer.evidence.get(word, 0.0)
                starts = max((scorer.evidence.get(f, 0.0) for f in beginnings(word)[1:] if len(f) - 1 > len(row[0])), default=0.0)
                if max(whole, starts) > best:
                    apart = all(len(x) == 1 for x in (*row, r))
                    before, after = (near((start - 1, start - 2))[::-1], near((k + 1, k + 2))) if apart else ("", "")
                    likelier = blanks(before, (*row, r), after, model)
                    best = max(best, whole if likelier > JOINED else 0.0, starts if likelier > 0 else 0.0)
        rows = longer
        k += 1
    return best


def document_evidence(texts: list[str | None], scorer: Scorer, model: CharacterModel, known: dict[str, float], bound: int = 300_000) -> list[tuple[float, int, int]]:
    """(strongest evidence, tokens with evidence, tokens) of each text.

    ``known`` keeps the evidence of tokens, with ``OPEN`` more for those that
    begin a word with evidence.
    """
    out = []
    readings: dict[str, tuple[str, ...]] = {}

    def said(t: str) -> tuple[str, ...]:
        r = readings.get(t)
        if r is None:
            r = readings[t] = readings_of(t, model)
        return r

    for text in texts:
        tokens = (text or "").split()
        if len(readings) > 20_000:
            readings.clear()
        if not tokens:
            out.append((0.0, 0, 0))
            continue
        found = np.fromiter(map(known.get, tokens, repeat(-1.0)), np.float32, len(tokens))
        gaps = np.flatnonzero(found < 0).tolist()
        if gaps:
            if len(known) > bound:
                known.clear()
            for k in gaps:
                t = tokens[k]
                v = known.get(t)
                if v is None:
                    words = readings_of(t, model)
                    v = scorer.of_readings(words) + (OPEN if not scorer.openings.isdisjoint(words) else 0.0) or 0.0  # one object for all zeros
                    if len(t) <= 64:
                        known[t] = v
                found[k] = v
        opens = np.flatnonzero(found >= OPEN)
        found[opens] -= OPEN
        extra = [joined_evidence(tokens, k, scorer, model, said) for k in opens.tolist() if k + 1 < len(tokens)]
        for a, b in spaced_runs(tokens):
            words = readings_of("".join(tokens[a:b]), model)
            extra.append(scorer.of_readings(words))
            letters = list(words[0])
            if len(letters) < b - a:  # without what was put between or repeated, its pieces are others
                extra += [joined_evidence(letters, k, scorer, model, said) for k in range(len(letters) - 1) if letters[k] in scorer.openings]
        hits = int((found > 0).sum()) + sum(x > 0 for x in extra)
        out.append((max([float(found.max()), *extra]), hits, len(tokens)))
    return out


def feature_counts(batches: Iterator[pa.RecordBatch], model: CharacterModel, held: int = COUNTS_HELD, kept: int = READINGS_KEPT) -> Iterator[pa.RecordBatch]:
    """feature, context, and 1 for each context in toxic texts; feature, -1, and how many toxic and clean texts have it.

    The counts are passed on whenever ``held`` of them have gathered, and one
    text's more at most; so a feature can come again, and a context too.
    """
    known: dict[str, tuple[str, ...]] = {}
    toxic_in: set[tuple[str, int]] = set()
    used_by: tuple[Counter, Counter] = (Counter(), Counter())

    def passed_on() -> pa.RecordBatch:
        found, used = list(toxic_in), list(used_by[0].keys() | used_by[1].keys())
        numbers = np.zeros((4, len(found) + len(used)), np.int64)
        numbers[0] = [c for _, c in found] + [-1] * len(used)
        numbers[1, : len(found)] = 1
        for k in (0, 1):
            numbers[3 - k, len(found) :] = [used_by[k][f] for f in used]
        features = pa.array([f for f, _ in found] + used, pa.string())
        for counts in (toxic_in, *used_by):
            counts.clear()
        return pa.RecordBatch.from_arrays([features, *map(pa.array, numbers)], names=["feature", "context", "contexts", "toxic", "clean"])

    for batch in slices(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = restored_tokens(text or "", model, known)
            if toxic:
                best = [w[0] for w in words]
                around = zip(words, ["", *best], [*best[1:], ""])
                toxic_in.update((f, hash_of(before, after)) for said, before, after in around for w in said if w for f in beginnings(w))
            used_by[toxic].update({f for said in set(words) for w in said if w for f in beginnings(w)})
            if len(toxic_in) + len(used_by[0]) + len(used_by[1]) >= held:
                yield passed_on()
            if len(known) > kept:
                known.clear()
    yield passed_on()
    known.clear()
    give_back()


def learn_evidence(sample: DataFrame, model_value, least: int = LEAST_CONTEXTS, held: int = COUNTS_HELD) -> dict[str, float]:
    """Log odds of the features that toxic documents of ``sample`` (text, toxic) use in many contexts."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from feature_counts(batches, model_value.value, held)

    seen = sample.select("text", "toxic").mapInArrow(features, "feature string, context long, contexts long, toxic long, clean long")
    each = seen.groupBy("feature", "context").agg(F.max("contexts").alias("contexts"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    total = each.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("contexts", "toxic", "clean")))
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    odds = F.log((F.col("toxic") + 0.5) / n.get(1, 1)) - F.log((F.col("clean") + 0.5) / n.get(0, 1))
    best = total.filter(F.col("contexts") >= least).withColumn("odds", odds).filter("odds > 2")
    return {r["feature"]: float(r["odds"]) for r in best.orderBy("feature").collect()}  # no more than the words of TRAIN_ROWS documents give


def hash_of(*words: str) -> int:
    import zlib

    return zlib.crc32("\x00".join(words).encode("utf-8", "replace"))


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and constant by Newton's method with a small ridge."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (p - y) + 0.5 * w
        step = np.linalg.solve(x1.T @ (x1 * (p * (1 - p))[:, None]) + 0.5 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, train_rows: int = TRAIN_ROWS) -> tuple[CharacterModel, Scorer]:
    """Character model over all ``docs``, and a scorer from labelled ones for which ``may_learn`` (on doc_id) holds."""
    spark = docs.sparkSession
    ship_package(spark)
    model = CharacterModel(trigram_counts(docs))
    shared = spark.sparkContext.broadcast(model)
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    chosen = chosen.filter(may_learn) if may_learn is not None else chosen
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = [(r["doc_id"], r["toxic"], k < CALIBRATION_ROWS) for k, r in enumerate(chosen.collect())]  # at most train_rows
    chosen = spark.createDataFrame(rows, "doc_id long, toxic int, calibrates boolean")
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", "calibrates")
    scorer = Scorer(learn_evidence(sample, shared))

    def judged(rows: DataFrame, by: Scorer) -> list:
        learned = spark.sparkContext.broadcast(by)

        def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, float] = {}
            for batch in slices(batches):
                found = document_evidence(batch.column("text").to_pylist(), learned.value, shared.value, known)
                columns = list(zip(*found)) if found else [[]] * 3
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(columns[0], pa.float64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["doc_id", "toxic", "strongest", "hits", "words"])

        found = rows.mapInArrow(evidence, "doc_id long, toxic int, strongest double, hits long, words long")
        # of repeated rows the strongest counts, so that at most train_rows are fetched
        found = found.groupBy("doc_id", "toxic").agg(F.max(F.struct("strongest", "hits", "words")).alias("x"))
        return found.select("toxic", "x.*").orderBy("doc_id").collect()

    # a half is judged by what the other half taught, so that the calibration isn't surer than it may be
    halves = [sample.filter(F.col("calibrates") & test) for test in (F.xxhash64(F.lit("half"), "doc_id") % 2 == 0, F.xxhash64(F.lit("half"), "doc_id") % 2 != 0)]
    rows = [r for k in (0, 1) for r in judged(halves[k], Scorer(learn_evidence(halves[1 - k], shared, LEAST_CONTEXTS // 2)))]
    y = np.array([r["toxic"] for r in rows], np.float64)
    if len(y) and 0 < y.sum() < len(y):
        x = np.array([(r["strongest"], min(r["hits"], 5), r["hits"] / max(r["words"], 20)) for r in rows])
        weights, prior = fit_logistic(x, y)
        scorer.weights, scorer.prior = tuple(weights.tolist()), prior
    elif len(y):
        scorer.prior = 5.0 if y.all() else -5.0
    return model, scorer


def score(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= 0.5) of every row."""
    spark = docs.sparkSession
    texts = texts_of(docs, id_col, text_col)
    shared = spark.sparkContext.broadcast(train(texts, labels, may_learn))
    fields = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (model, scorer), known = shared.value, {}
        for batch in slices(batches):
            s = np.array([scorer.of_document(*e) for e in document_evidence(batch.column("text").to_pylist(), scorer, model, known)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema=fields)

    return texts.mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose text isn't judged toxic; nothing is shuffled."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(texts_of(docs, id_col, text_col), labels, may_learn))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (model, scorer), known = shared.value, {}
        for batch in slices(batches):
            found = document_evidence(batch.column(place).to_pylist(), scorer, model, known)
            yield batch.filter(pa.array([scorer.of_document(*e) < 0.5 for e in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for testing: crc32 of its id as text is a multiple of five."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0
