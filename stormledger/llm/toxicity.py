"""Toxicity by a weighted finite-state pattern grammar.

A lexicon of insulting words and word stems is learned from labelled rows. A text's words become symbols (insult,
threat, target, negation, reported speech, end of clause, other). A transducer that reads a clause from its end marks the
insults and threats with a target to come; the composition of small transducers then reads it from its start and
weighs each insult and threat by what stands on either side: aimed at a target it counts more, negated or reported it
counts less. A logistic model over the clauses' scores gives the document's.
"""

from __future__ import annotations

import gc
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, texts

#: Bound of the fit: labelled rows of each label, those with the least hashes of their ids.
FIT_ROWS = 3000
#: Terms of the lexicon: share of toxic rows that have one at least, log odds at least, standard scores at least, number at most
#: (those with the highest scores; so what passes the driver and is sent to tasks is bounded whatever the corpus' vocabulary).
TERM_SHARE, TERM_ODDS, TERM_Z, TERMS = 0.015, math.log(4), 3.0, 4000
#: Lengths of stems (the first letters of longer words).
STEMS = (7, 6, 5, 4)
#: Words after a negation that it still reaches.
NEGATION_REACH = 3
#: Words that a task remembers.
MEMO_WORDS = 500_000

# Function words of the grammar, in English, French, German and Spanish.
TARGETS = "you your yours yourself he she they him her them his their u tu te toi vous ton ta tes votre vos il elle ils elles du dich dir dein deine ihr euch euer sie er tú ti usted ustedes él ella ellos ellas vosotros"
NEGATIONS = "not no never none nobody isn aren wasn weren don doesn didn cannot can't won without ne pas jamais aucun ni sans nicht kein keine keinen nie niemals ohne nunca jamás ningún ninguna tampoco sin"
REPORTS = "said says say saying told tells wrote writes quote quoted quotes reported called calls according dit disait écrit selon cite sagte sagt schrieb laut zitiert dijo dice escribió según citó"
# Verbs of threats, by the way in which they're inflected, and the endings; forms that follow no rule.
VERBS = {
    "": "kill hurt destroy attack beat burn shoot stab murder",
    "er": "tuer frapper attaquer brûler",
    "ire": "détruire",
    "en": "töten schlagen zerstören angreifen verbrennen",
    "ar": "matar golpear atacar quemar",
    "ir": "destruir",
}
ENDINGS = {
    "": " s ed ing",
    "er": "er e es ons ez ent é ée és ées ant ais ait ions iez aient erai eras era erons erez eront erais erait",
    "ire": "ire is it isons isez isent ite its ites isant isais isait irai iras ira irons irez iront",
    "en": "en e st t est et te test ten tet end",
    "ar": "ar o as a amos áis an é aste ó aron aba aban aré arás ará aremos aréis arán ando ado ada ados adas",
    "ir": "ir yo yes ye imos ís yen í iste yó yeron iré irás irá iremos irán yendo ido ida",
}
IRREGULAR = "shot beaten schlägst schlägt schlug erschlagen griff angegriffen verbrannte verbrannt ataqué"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INSULT_TO, THREAT_TO, END = range(9)
#: Symbols that score; those ending in _TO have a target to come in their clause.
SCORED = (INSULT, THREAT, INSULT_TO, THREAT_TO)


def threat_forms() -> set[str]:
    """All forms of the verbs of threats: stem and ending; English stems drop an e or double their last letter, German ones take ge-."""
    forms = set(IRREGULAR.split())
    for kind, verbs in VERBS.items():
        for verb in verbs.split():
            stem = verb[: len(verb) - len(kind)]
            ends = ENDINGS[kind].split(" ")
            forms |= {stem + e for e in ends}
            if kind == "" and re.fullmatch(r"[^aeiou]+[aeiou][^aeiouwxy]", stem):
                forms |= {stem + stem[-1] + e for e in ("ed", "ing")}
            if kind == "en":
                forms |= {"ge" + stem + e for e in ("t", "et", "en")}
    return forms


_tokens = re.compile(r"[^\W\d_]+|[.!?;\n]").findall


@dataclass(frozen=True)
class Transducer:
    """States 0 to n-1, of which 0 starts and ends each clause; (state, symbol) to (state, factor of that symbol's weight)."""

    n: int
    moves: dict[tuple[int, int], tuple[int, float]] = field(hash=False)

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return (0, 1.0) if symbol == END else self.moves.get((state, symbol), (state, 1.0))

    def compose(self, other: Transducer) -> Transducer:
        """Both at once: their states in pairs, their factors multiplied."""
        moves = {}
        for a in range(self.n):
            for b in range(other.n):
                for s in range(END):
                    (x, u), (y, v) = self.step(a, s), other.step(b, s)
                    moves[a * other.n + b, s] = (x * other.n + y, u * v)
        return Transducer(self.n * other.n, moves)


def negation(reach: int = NEGATION_REACH, factor: float = 0.25) -> Transducer:
    """State k: a negation reaches k more words."""
    moves = {}
    for k in range(reach + 1):
        for s in range(END):
            moves[k, s] = (max(0, k - 1), factor if k and s in SCORED else 1.0)
        moves[k, NEGATION] = (reach, 1.0)
    return Transducer(reach + 1, moves)


def reported(factor: float = 0.5) -> Transducer:
    """From a word of reporting to the end of the clause."""
    return Transducer(2, {(0, REPORT): (1, 1.0)} | {(1, s): (1, factor) for s in SCORED})


def aimed(insult: float = 1.5, threat: float = 1.0, aimless: float = 0.1) -> Transducer:
    """A target on either side in the clause: state 1 has seen one, other marks tell of those to come. A threat without one hardly counts."""
    to = {(k, s): (k, f) for k in (0, 1) for s, f in ((INSULT_TO, insult), (THREAT_TO, threat))}
    return Transducer(2, to | {(0, TARGET): (1, 1.0), (0, THREAT): (0, aimless), (1, INSULT): (1, insult), (1, THREAT): (1, threat)})


#: Read from a clause's end: (a target was seen, symbol) to (the same after it, the symbol to put).
TO_COME = {(k, s): (k or s == TARGET, {INSULT: INSULT_TO, THREAT: THREAT_TO}.get(s, s) if k else s) for k in (False, True) for s in range(END)}


def marked(found: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """The symbols with those marked that have a target to come in their clause."""
    out, seen = [], False
    for s, w in reversed(found):
        if s == END:
            seen = False
        else:
            seen, s = TO_COME[seen, s]
        out.append((s, w))
    out.reverse()
    return out


class Grammar:
    """The composed transducer over a lexicon (term to weight; stems end in ``*``)."""

    THREAT_WEIGHT = 3.0

    def __init__(self, lexicon: dict[str, float]):
        self.insults = {k: v for k, v in lexicon.items() if k[-1] != "*"}
        self.stems = [(n, {k[:-1]: v for k, v in lexicon.items() if k[-1] == "*" and len(k) == n + 1}) for n in STEMS]
        self.fixed = {w: (s, self.THREAT_WEIGHT) for s, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws.split()}
        self.fixed |= {w: (THREAT, self.THREAT_WEIGHT) for w in threat_forms() - self.fixed.keys()}
        machine = negation().compose(reported()).compose(aimed())
        self.table = [[machine.step(a, s) for s in range(END + 1)] for a in range(machine.n)]
        self.memo: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        """The word's symbol and weight: a whole insult, else the longest stem, else a function word."""
        w = self.insults.get(word)
        if w is not None:
            return INSULT, w
        for n, stems in self.stems:
            if len(word) > n and (w := stems.get(word[:n])) is not None:
                return INSULT, w
        return (END, 0.0) if word in ".!?;\n" else self.fixed.get(word, (OTHER, 0.0))

    def features(self, text: str) -> list[float]:
        """Of a whole text: scores over its clauses. All zeros where no clause matches."""
        words, memo = _tokens(text.lower()), self.memo
        missing = {w for w in words if w not in memo}
        if len(memo) + len(missing) > MEMO_WORDS:
            memo.clear()
            missing = set(words)
        for w in missing:
            memo[w] = self.symbol(w)
        found = [memo[w] for w in words]
        kinds = {s for s, _ in set(found)}
        if INSULT not in kinds and THREAT not in kinds:
            return [0.0] * 7
        table, state, scores, score = self.table, 0, [], 0.0
        plain = weighed = 0
        for s, w in marked(found) if TARGET in kinds else found:
            state, factor = table[state][s]
            if s in SCORED:
                score += w * factor
                plain += factor >= 1
                weighed += factor < 1
            elif s == END and score:
                scores.append(score)
                score = 0.0
        if score:
            scores.append(score)
        total = sum(scores)
        clauses = 1 + sum(1 for s, _ in found if s == END)
        return [math.log1p(total), max(scores), math.log1p(len(scores)), math.log1p(plain), math.log1p(weighed), total / math.sqrt(clauses), len(scores) / clauses]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, label_col: str = "toxic") -> DataFrame:
    """``text`` and ``y`` of at most ``rows`` labelled documents of each label; rows held out are never among them.

    One of each family of near copies: texts with the same least shingle hash are one family.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label_col).alias("y"))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    few = picked[0].unionByName(picked[1])  # 2 * rows short rows at most
    sample = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y")

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = texts(batch.column(0))
            least = [min((xxhash.xxh64_intdigest(" ".join(s)) for s in zip(w, w[1:], w[2:], strict=False)), default=0) >> 1 for w in map(str.split, own)]
            yield pa.RecordBatch.from_pydict({"text": pa.array(own, pa.string()), "y": batch.column(1), "family": pa.array(least, pa.int64())})

    return sample.mapInArrow(families, f"text string, y {few.schema['y'].dataType.simpleString()}, family long").groupBy("family", "y").agg(F.min("text").alias("text"))


def terms(text: str) -> set[str]:
    """The words of a text and their stems."""
    words = {w for w in _tokens(text.lower()) if w not in ".!?;\n"}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _document_counts(sample: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """The number of texts that have each term (of ``only``, if given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: Counter[str] = Counter()
            for t in texts(batch.column(0)):
                counts.update(terms(t) if only is None else terms(t) & only)
            yield pa.RecordBatch.from_pydict({"term": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    return sample.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms that mark toxic texts, with their log odds. What passes the driver is bounded by the terms' least share."""
    least = max(3.0, TERM_SHARE * n_toxic)
    toxic = {r.term: r.n for r in _document_counts(sample.where("y = 1")).where(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(50 * TERMS).collect()}
    clean = {r.term: r.n for r in _document_counts(sample.where("y = 0"), frozenset(toxic)).collect()} if toxic else {}
    rated = []
    for term, t in toxic.items():
        c = clean.get(term, 0)
        odds = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        p = (t + c) / (n_toxic + n_clean)
        z = (t / n_toxic - c / n_clean) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / n_toxic + 1 / n_clean))
        if odds >= TERM_ODDS and z >= TERM_Z:
            rated.append((z, term, odds))
    return {term: odds for _, term, odds in sorted(rated, reverse=True)[:TERMS]}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge-penalised logistic model (the last is the intercept, unpenalised), by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    """A lexicon, the logistic weights of the features, and the features' scale."""

    lexicon: dict[str, float]
    weights: tuple[float, ...]
    scale: tuple[float, ...]


def _feature_rows(sample: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in slices(batches):
            rows = [grammar.features(t) for t in texts(batch.column(0))]
            yield pa.RecordBatch.from_pydict({"y": batch.column(1).cast(pa.int32()), "x": pa.array(rows, pa.list_(pa.float64()))})

    return sample.select("text", "y").mapInArrow(run, "y int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, label_col: str = "toxic") -> Model | None:
    """Learn lexicon and weights from labelled rows that aren't held out; None where a label has no rows."""
    sample = cut(fit_sample(docs, labels, rows, label_col))
    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    lexicon = learn_lexicon(sample, n[1], n[0])
    got = _feature_rows(sample, lexicon).collect()  # seven numbers for each row of the bounded sample
    x, y = np.array([r.x for r in got]), np.array([r.y for r in got], float)
    # Rows are put in an order of their own, so that sums come out alike whatever partitions they came from.
    order = np.lexsort([*x.T, y])
    x, y = x[order], y[order]
    scale = np.maximum(x.std(axis=0), 1e-9)
    w = logistic(x / scale, y)
    shares = labels.where(~held_out(F.col("doc_id"))).agg(F.count_if(F.col(label_col) == 1).alias("a"), F.count_if(F.col(label_col) == 0).alias("b")).first()
    w[-1] += math.log(max(shares.a, 1) / max(shares.b, 1)) - math.log(n[1] / n[0])  # the sample's odds for the corpus'
    return Model(lexicon, tuple(w), tuple(scale))


def score_all(texts_: Iterable[str], grammar: Grammar, model: Model) -> np.ndarray:
    x = np.array([grammar.features(t) for t in texts_]).reshape(-1, len(model.scale))
    z = (x / np.array(model.scale)) @ np.array(model.weights[:-1]) + model.weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_documents(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every whole text; one row per row, nothing is shuffled.

    Only the text is read for a score. Null texts are empty; without a model every score is 0. Null ids aren't held out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(100_000)
        grammar = Grammar(model.lexicon) if model else None
        for batch in slices(batches):
            own = texts(batch.column(1))
            s = score_all(own, grammar, model) if model else np.zeros(len(own))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": s})

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Fit on ``labels`` (``doc_id``, ``toxic``; repeated ids are toxic if one of their rows is) and score all of ``docs``."""
    return score_documents(docs, fit(docs, labels, rows))


def without_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; nothing is shuffled."""
    names, schema = docs.columns, docs.schema
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.lexicon)
        for batch in slices(batches):
            yield batch.filter(pa.array(score_all(texts(batch.column(place)), grammar, model) < 0.5))

    return docs.mapInArrow(run, schema) if model else docs
