"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause is a sequence of word classes.  Small transducers read it; each gives a
factor at every word, and at most words that factor is one:

* insult: matches an insult, the arc's weight being what labelled text says of
  the word;
* predication: matches a word that is an ordinary noun, too (garbage, clown), in
  full only where somebody is called so ("you are a ...", "you ...");
* target: raises a match that speaks of or to somebody a few words before;
* threat: matches a threat verb and the person it is aimed at, in either order;
* negation: for a few words after a negator, up to a comma, matches shrink;
* reported speech: after a verb of saying with a colon, a quotation mark or a
  conjunction, and inside quotation marks, matches shrink.

``compose`` multiplies transducers: one machine runs all of them at once.  The
grammar is the union of insult o target o negation o reported speech, predication
o target o negation o reported speech, and threat o negation o reported speech.
A path through a machine chooses one match; the weight of a clause is the sum over
all paths of the product of their factors.

A document's weight is that of its gravest clause, or what its different insulting
words weigh together where they stand plainly, neither negated nor reported, if
that is more.  Nouns at nobody count among these if another word does.  So harmless clauses don't add up, however many they are, and the
length of a text plays no part.  The score is a logistic function of the weight.

Threat verbs beyond the seed list are learned as words that stand right before a
person in many contexts of toxic documents and hardly ever in clean ones.  Insults beyond the seed list are learned: words that labelled toxic documents
hold in many contexts and clean ones hardly ever, and stems of 4 to 6 letters
with several such forms.  Contexts are counted, not documents, so that copies of
one document teach no more than one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, batch_of, held_out, over_batches, text_slices, tidy
from .textnum import Words, word_hash

#: bound of the training sample: labelled rows of each label
ROWS_PER_LABEL = 4_000
#: bound of the lexicon: learned words, and learned stems
LEARNED = 20_000
THRESHOLD = 0.7
#: what the meaning of the grammar is worth, as a share of the labelled rows
PRIOR = 0.2
STEMS = (4, 5, 6)
#: contexts that a learned word needs, forms that a learned stem needs, least log odds of both
CONTEXTS, FORMS, ODDS = 8, 5, 3.0

INSULTS = "idiot moron imbecile scum worthless pathetic stupid disgusting idiota imbécil estúpido escoria imbécile minable crétin dummkopf abschaum trottel vollidiot".split()
#: insults that are ordinary nouns
NOUNS = frozenset("loser trash garbage clown basura ordure".split())
#: present forms that call somebody something
COPULAS = frozenset("are re is am be bist seid ist sind es est êtes eres sois son".split())
#: articles of a particular thing
DEFINITES = frozenset("the this that der die das den dem le la les el los las".split())
THREATS = frozenset("kill hurt murder destroy stab hate despise töten umbringen vernichten hasse tuer détruire frapper déteste matar destruir golpear odio".split())
#: persons that a clause may be about
PERSONS = frozenset("he she they we people du ihr er tu il elle ils elles usted él ella ellos".split())
#: whose something is: a target, but nobody who is called something
OWNERS = frozenset("your dein deine votre vos vuestro vuestra".split())
#: persons that a threat may be aimed at, behind its verb
OBJECTS = frozenset("you him her them sie vous toi ustedes".split())
#: the same, where they may also stand before the verb
EARLY_OBJECTS = frozenset("dich euch ihn te dir ti".split())
NEGATORS = frozenset("not no never neither nor isn aren wasn don doesn nicht kein keine nie niemals ne pas jamais nunca jamás ni tampoco".split())
REPORTERS = frozenset("said says say told wrote claimed called sagte sagt schrieb behauptete dit disait écrit affirme dijo dice escribió afirmó".split())
OPENERS = frozenset("that dass que ob if".split())

INSULT_WEIGHT, THREAT_WEIGHT = 1.5, 3.0
TARGETED, NEGATED, REPORTED, FAINT = 2.0, 0.2, 0.25, 0.3
#: words that a target, a threat verb or its object, a negator, a verb of saying reach
TARGET_REACH, THREAT_REACH, NEGATION_REACH, SAID_REACH, CALLED_REACH = 4, 2, 3, 3, 4

# classes of tokens
OTHER, INSULT, NOUN, THREAT, PERSON, OBJECT, EARLY, NEGATOR, REPORTER, OPENER, COPULA, DEFINITE, OWNER, COLON, QUOTE, COMMA = range(16)
CLASSES = 16
_MARKS = (COLON, QUOTE, COMMA)  # tokens that are no words
_SOMEBODY = (PERSON, OBJECT, EARLY)
_TOKEN = regex.compile(r"[^\W_]+|[\"“”«»„:,]")
_CLAUSE_END = ".!?;\n"


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer from state 0: for each state and
    class the next state, and the factor of a match there."""

    step: tuple[tuple[int, ...], ...]
    factor: tuple[tuple[float, ...], ...]


def _machine(states: Sequence[object], step, factor) -> Transducer:  # noqa: ANN001
    """A transducer from functions of (state, class); the first state is the start."""
    place = {s: i for i, s in enumerate(states)}
    return Transducer(tuple(tuple(place[step(s, c)] for c in range(CLASSES)) for s in states), tuple(tuple(float(factor(s, c)) for c in range(CLASSES)) for s in states))


def _reach(marks: set[int], words: int, factor: float) -> Transducer:
    """``factor`` for so many words after a word of ``marks``."""
    return _machine(range(words + 1), lambda s, c: words if c in marks else s if c in _MARKS else max(0, s - 1), lambda s, _: factor if s else 1.0)


def insult_transducer() -> Transducer:
    return _machine([0], lambda _s, _c: 0, lambda _, c: c == INSULT)


def predication_transducer() -> Transducer:
    """States: somebody was just named, or words left of what they are called."""
    called = [f"called {k}" for k in range(CALLED_REACH, 0, -1)]

    def step(s: str, c: int) -> str:
        if c in (COLON, QUOTE):
            return s
        if c in _SOMEBODY:
            return "somebody"
        if c == COPULA and s != "":
            return called[0]
        if c in (DEFINITE, OWNER, COMMA) or s in ("", "somebody", called[-1]):
            return ""
        return called[called.index(s) + 1]

    return _machine(["", "somebody", *called], step, lambda s, c: 0.0 if c != NOUN else 1.0 if s else FAINT)


def target_transducer() -> Transducer:
    return _reach({PERSON, OBJECT, EARLY, OWNER}, TARGET_REACH, TARGETED)


def threat_transducer() -> Transducer:
    """States: words left after a threat verb, and after an early object."""
    states = [(v, o) for v in range(THREAT_REACH + 1) for o in range(THREAT_REACH + 1)]

    def step(s: tuple[int, int], c: int) -> tuple[int, int]:
        if c in _MARKS:
            return s
        hit = factor(s, c) > 0  # a match uses up what led to it
        verb = THREAT_REACH if c == THREAT else 0 if hit else max(0, s[0] - 1)
        early = THREAT_REACH if c == EARLY else 0 if hit else max(0, s[1] - 1)
        return (0 if hit else verb), (0 if hit else early)

    def factor(s: tuple[int, int], c: int) -> float:
        return THREAT_WEIGHT if (c in (OBJECT, EARLY) and s[0]) or (c == THREAT and s[1]) else 0.0

    return _machine(states, step, factor)


def negation_transducer() -> Transducer:
    """States: words left after a negator."""
    reach = NEGATION_REACH
    return _machine(range(reach + 1), lambda s, c: reach if c == NEGATOR else 0 if c == COMMA else s if c in _MARKS else max(0, s - 1), lambda s, _: NEGATED if s else 1.0)


def reported_transducer() -> Transducer:
    """States: words left after a verb of saying, whether what follows is
    reported, and whether a quotation is open."""
    states = [(said, told, quoted) for told in (False, True) for quoted in (False, True) for said in range(SAID_REACH + 1)]

    def step(s: tuple[int, bool, bool], c: int) -> tuple[int, bool, bool]:
        said, told, quoted = s
        if c == REPORTER:
            return SAID_REACH, told, quoted
        if c == QUOTE:
            return said, told, not quoted
        if c in (COLON, OPENER) and said:
            return 0, True, quoted
        return (said if c in (COLON, COMMA) else max(0, said - 1)), told, quoted

    return _machine(states, step, lambda s, _: REPORTED if s[1] or s[2] else 1.0)


def compose(*parts: Transducer) -> Transducer:
    """The machine that runs all ``parts`` at once: its states are the reachable
    tuples of theirs, its factors the products."""
    place, waiting = {(0,) * len(parts): 0}, [(0,) * len(parts)]
    steps, factors = [], []
    for state in waiting:  # grows while it is read
        row = []
        for c in range(CLASSES):
            to = tuple(p.step[s][c] for p, s in zip(parts, state, strict=True))
            if to not in place:
                place[to] = len(place)
                waiting.append(to)
            row.append(place[to])
        steps.append(tuple(row))
        factors.append(tuple(float(np.prod([p.factor[s][c] for p, s in zip(parts, state, strict=True)])) for c in range(CLASSES)))
    return Transducer(tuple(steps), tuple(factors))


@lru_cache(1)
def grammar_machines() -> tuple[Transducer, ...]:
    """The composed machines of insults, of nouns that may be insults, and of
    threats."""
    tail = (negation_transducer(), reported_transducer())
    return compose(insult_transducer(), target_transducer(), *tail), compose(predication_transducer(), target_transducer(), *tail), compose(threat_transducer(), *tail)


@dataclass
class Grammar:
    """Weights of the insult arcs (words; stems by their length), and the
    coefficients of the logistic function."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, INSULT_WEIGHT))
    stems: dict[str, float] = field(default_factory=dict)
    threats: frozenset[str] = THREATS
    coefficients: tuple[float, float] = (0.0, 0.0)

    def __post_init__(self) -> None:
        if self.coefficients == (0.0, 0.0):
            self.coefficients = fit_coefficients(np.zeros(0), np.zeros(0))

    def arc(self, word: str) -> float:
        """Weight of the word as an insult, 0 for others."""
        weight = self.words.get(word, 0.0)
        for k in STEMS:
            if len(word) >= k:
                weight = max(weight, self.stems.get(word[:k], 0.0))
        return weight

    def read(self, clause: str) -> tuple[list[int], list[float]]:
        """Class and arc weight of each token."""
        classes, weights = [], []
        for token in _TOKEN.findall(clause):
            arc = 0.0
            if not token[0].isalnum():
                kind = COLON if token == ":" else COMMA if token == "," else QUOTE
            else:
                kind = THREAT if token in self.threats else next((k for k, known in _KINDS if token in known), OTHER)
                if kind == OTHER and (arc := self.arc(token)):
                    kind = INSULT
            classes.append(kind)
            weights.append(arc or (INSULT_WEIGHT if kind == NOUN else 1.0))
        return classes, weights

    def matches(self, clause: str) -> list[tuple[int, float, float]]:
        """Place and weight of each match of the lower-cased clause, and what it
        weighs plainly: its weight if nothing shrinks it, that of an insult for a
        noun at nobody (as a negative number), else 0."""
        classes, weights = self.read(clause)
        found = []
        for machine in grammar_machines():
            state = 0
            for i, (c, w) in enumerate(zip(classes, weights, strict=True)):
                factor = machine.factor[state][c]
                if factor:
                    faint = c == NOUN and factor in (FAINT, FAINT * TARGETED)
                    found.append((i, factor * w, factor * w if factor >= 1 else -w if faint else 0.0))
                state = machine.step[state][c]
        return found

    def weigh(self, clause: str) -> float:
        """Weight of the lower-cased clause: the sum over all paths."""
        return sum(w for _, w, _ in self.matches(clause))

    def weigh_all(self, clauses: Iterable[str]) -> float:
        """Weight of a document's lower-cased clauses: of the gravest, or of the
        different words that match plainly, together.  Nouns at nobody count in
        the company of another word that matches plainly."""
        gravest, plain, nouns = 0.0, {}, {}
        for clause in clauses:
            found = self.matches(clause)
            gravest = max(gravest, sum(w for _, w, _ in found))
            tokens = _TOKEN.findall(clause)
            for i, _, p in found:
                into = plain if p > 0 else nouns
                into[tokens[i]] = max(into.get(tokens[i], 0.0), abs(p))
        company = sum(w for t, w in nouns.items() if t not in plain) if plain else 0.0
        return max(gravest, sum(plain.values()) + company)


_KINDS = ((NEGATOR, NEGATORS), (REPORTER, REPORTERS), (OPENER, OPENERS), (NOUN, NOUNS), (EARLY, EARLY_OBJECTS), (OBJECT, OBJECTS), (PERSON, PERSONS), (COPULA, COPULAS), (DEFINITE, DEFINITES), (OWNER, OWNERS))


class Matcher:
    """Weighs whole slices of texts: words are looked up as numbers, and the
    machines read only clauses that hold an insult or a threat verb."""

    def __init__(self, grammar: Grammar) -> None:
        self.grammar = grammar
        self.words = np.sort(np.array([word_hash(w) for w in {*grammar.words, *grammar.threats, *NOUNS}], np.uint64))
        self.stems = {k: np.sort(np.array([word_hash(s) for s in grammar.stems if len(s) == k], np.uint64)) for k in STEMS}

    @staticmethod
    def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(values), bool)
        screen = np.zeros(1 << 16, bool)
        screen[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        found = screen[(values & np.uint64(0xFFFF)).astype(np.int64)]
        at = np.flatnonzero(found)
        place = np.minimum(np.searchsorted(known, values[at]), len(known) - 1)
        found[at] = known[place] == values[at]
        return found

    def weights(self, texts: list[str]) -> np.ndarray:
        """For each text the weight of its clauses (``Grammar.weigh_all``)."""
        words = Words(texts, STEMS)
        hit = self._among(words.hashes, self.words)
        for k in STEMS:
            hit |= self._among(words.prefix[k], self.stems[k])
        at = np.flatnonzero(hit)
        owner = np.searchsorted(words.offsets, at, side="right") - 1
        out = np.zeros(len(texts))
        joined, done, last = words.joined, -1, -1
        clauses: dict[int, list[str]] = {}
        for i, doc in zip(at.tolist(), owner.tolist(), strict=True):
            begin, end = int(words.starts[i]), int(words.ends[i])
            if doc != last:
                done, last = -1, doc
            if begin < done:
                continue
            low, high = int(words.begins[doc]), int(words.begins[doc + 1]) - 1
            start = max(joined.rfind(c, low, begin) for c in _CLAUSE_END) + 1 or low
            done = min((x for x in (joined.find(c, end, high) for c in _CLAUSE_END) if x >= 0), default=high)
            clauses.setdefault(doc, []).append(joined[max(start, low) : done])
        for doc, own in clauses.items():
            out[doc] = self.grammar.weigh_all(dict.fromkeys(own))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        a, b = self.grammar.coefficients
        return 1 / (1 + np.exp(-(a + b * np.log1p(self.weights(texts)))))


def fit_coefficients(weights: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic regression of labels on log1p(weight), by Newton's method.

    What the grammar means is a prior, worth ``PRIOR`` of the rows and at least
    forty rows: an insult or threat at somebody is toxic; nothing, one insulting
    word at nobody, and an insult negated or reported are not.  Without rows the
    prior alone counts.
    """
    one = INSULT_WEIGHT * TARGETED
    prior = [(0.0, 0), (INSULT_WEIGHT, 0), (one * NEGATED, 0), (one * REPORTED, 0), (one, 1), (THREAT_WEIGHT, 1)]
    share = max(40.0, PRIOR * len(labels)) / len(prior)
    x = np.log1p(np.concatenate([weights, [w for w, _ in prior]]))
    y = np.concatenate([labels, [k for _, k in prior]]).astype(float)
    worth = np.concatenate([np.ones(len(labels)), np.full(len(prior), share)])
    rows, ridge, c = np.column_stack([np.ones(len(x)), x]), np.diag([1e-3, 0.1]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ c, -30, 30)))
        move = np.linalg.solve((rows * (worth * p * (1 - p))[:, None]).T @ rows + ridge, rows.T @ (worth * (y - p)) - ridge @ c)
        c += move
        if np.abs(move).max() < 1e-8:
            break
    return float(c[0]), float(c[1])


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_LABEL) -> DataFrame:
    """(id, toxic, text) of at most ``rows`` labelled rows of each label, in the
    order of a hash of their ids, from the learnable two thirds."""
    marked = labels.where(F.col("toxic").isNotNull() & ~held_out("doc_id")).select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.groupBy("id").agg(F.max("toxic").alias("toxic"))
    picked = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(rows) for k in (0, 1)]
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    # at most 2 * rows ids: a bounded side
    sample = texts.join(F.broadcast(picked[0].union(picked[1])), F.col("_doc") == F.col("id"))
    return sample.groupBy("id", "toxic").agg(F.max("text").alias("text"))


def lexicon(sample: DataFrame, work: Workspace) -> tuple[dict[str, float], dict[str, float], frozenset[str]]:
    """Weights of learned words and stems, and learned threat verbs, counted by
    Spark over ``sample``: log odds of contexts among toxic rows and occurrences
    among clean ones."""
    sizes = sample.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean")).first()
    if not sizes.toxic or not sizes.clean:
        return {}, {}, frozenset()
    words = sample.withColumn("w", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0))
    pairs = F.zip_with("w", F.concat(F.array(F.lit("")), "w"), lambda w, before: F.struct(w.alias("word"), before.alias("before")))
    pairs = words.select("toxic", F.explode(pairs).alias("p")).where("p.word IS NOT NULL").groupBy("p.word", "p.before").agg(F.count_if(F.col("toxic") == 1).alias("n"), F.count_if(F.col("toxic") == 0).alias("m"))
    pairs = work.save(pairs, "pairs")
    counts = work.save(pairs.groupBy("word").agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("m").alias("m")), "counts")
    odds = F.log((F.col("n") / sizes.toxic) / ((F.col("m") + 0.5) / sizes.clean))
    weight = F.greatest(F.lit(1.0), F.least(F.lit(2.0), F.col("odds") / 3)).alias("weight")
    known = [*NEGATORS, *REPORTERS, *OPENERS, *PERSONS, *OBJECTS, *EARLY_OBJECTS, *THREATS, *NOUNS, *COPULAS, *DEFINITES, *OWNERS]
    chosen = counts.withColumn("odds", odds).where((F.col("n") >= CONTEXTS) & (F.col("odds") >= ODDS) & ~F.col("word").isin(known))
    found = chosen.orderBy(F.desc("odds"), "word").limit(LEARNED).select("word", weight).collect()
    stem = F.explode(F.array(*[F.when(F.length("word") >= k, F.left("word", F.lit(k))) for k in STEMS])).alias("stem")
    forms = counts.select(stem, "n", "m").where("stem IS NOT NULL").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.count_if((F.col("n") >= 2) & (F.col("m") == 0)).alias("forms"))
    good = forms.withColumn("odds", odds).where((F.col("forms") >= FORMS) & (F.col("n") >= CONTEXTS) & (F.col("odds") >= ODDS))
    stems = good.orderBy(F.desc("odds"), "stem").limit(LEARNED).select("stem", "n", weight).collect()
    size = {r.stem: r.n for r in stems}
    # a stem whose words nearly all share a longer learned stem says no more than that
    longer = {s[:k] for s, n in size.items() for k in STEMS if k < len(s) and 10 * n >= 9 * size.get(s[:k], 10 * n)}
    # a verb needs most of its contexts before a person, or it is an insult that stands anywhere
    verbs = pairs.groupBy(F.col("before").alias("word")).agg(F.count_if(F.col("word").isin([*OBJECTS]) & (F.col("n") > 0)).alias("aimed"), F.sum(F.when(F.col("word").isin([*OBJECTS]), F.col("n"))).alias("n"), F.sum(F.when(F.col("word").isin([*OBJECTS]), F.col("m"))).alias("m"), F.count_if(F.col("n") > 0).alias("all"))
    aimed = verbs.withColumn("odds", odds).where((F.col("n") >= CONTEXTS) & (F.col("odds") >= ODDS) & (2 * F.col("aimed") >= F.col("all")) & ~F.col("word").isin([*known, *INSULTS]))
    threats = frozenset(r.word for r in aimed.orderBy(F.desc("odds"), "word").limit(LEARNED).collect() if r.word)
    return {r.word: r.weight for r in found if r.word not in threats}, {r.stem: r.weight for r in stems if r.stem not in longer}, threats


def learn(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_LABEL) -> Grammar:
    """A grammar from labelled rows: Spark counts the lexicon and weighs the
    sample; the driver sees counts of learned words and two numbers a row.
    Without both labels the seed lists and the prior coefficients stand."""
    work = Workspace(docs.sparkSession, "toxicity")
    sample = work.save(training_rows(docs, labels, rows), "sample")
    words, stems, threats = lexicon(sample, work)
    arcs = Grammar(dict.fromkeys(INSULTS, INSULT_WEIGHT) | words, stems, THREATS | threats)
    schema = pa.schema([("toxic", pa.int32()), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(arcs)
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(1)):
                yield batch_of(schema, batch.column(0).slice(lo, hi - lo), matcher.weights(texts))

    found = over_batches(sample.select("toxic", "text"), run, "toxic int, weight double").collect()
    work.drop()
    return Grammar(arcs.words, arcs.stems, arcs.threats, fit_coefficients(np.array([r.weight for r in found]), np.array([r.toxic for r in found])))


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of each row of ``docs``
    (doc_id, text, any other columns, which scores don't see).  Null and empty
    texts get the score of a text without a match; repeated rows, null ids and
    very long texts are scored like others; an empty table gives no row."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        matcher = Matcher(grammar)
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(2)):
                value = matcher.scores(texts)
                yield batch_of(schema, batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), value, (value >= THRESHOLD).astype(np.int32))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    return over_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """Rows of ``docs`` (text and any other columns), all columns, with a score
    below the threshold.  Null and empty texts stay; repeated rows go or stay
    together; rows stay in place, and an empty table stays empty."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        matcher = Matcher(grammar)
        for batch in batches:
            value = np.zeros(batch.num_rows)
            for lo, hi, texts in text_slices(batch.column(at)):
                value[lo:hi] = matcher.scores(texts)
            yield batch.filter(pa.array(value < THRESHOLD))

    return over_batches(docs, run, docs.schema)
