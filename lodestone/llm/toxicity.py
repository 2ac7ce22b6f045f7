"""Toxicity by a weighted finite-state pattern grammar: matched clauses are scored, not isolated words.

Five small transducers read a clause's tokens by class: insults (which carry weights), threats (an intent, a harm, a
target, in this order), targets, negation (with a scope of a few words) and reported speech (a verb of saying, or
quotation marks).  Their composition, computed once, reads each clause in one pass; each insult leaves with the mark of the
state it is met in, and the state at the clause's end says whether someone was addressed and whether a threat was
complete.  A document's matched clauses, by kind, are what a logistic function scores.

The insult transducer is a trie over letters, learnt from labelled documents: for every word and every beginning of a
word, in how many groups of near copies among toxic and among clean documents it occurs.  A beginning or word that toxic
documents hold far more often (by a likelihood ratio that outweighs the number of words tried) is accepted with all that
follows; what follows is weighed by its own counts, which lean on those of the shorter beginning, so a new word form gets
its stem's weight and a harmless one among them gets none.

Counts cover all training documents.  The transducer is broadcast: a beginning must occur in ``LEAST_SHARE`` of the toxic
groups, which bounds their number whatever the size of the corpus.  The
logistic weights come from sums over all training rows, one aggregate for each Newton step.

Defined results
* null or empty text: no clauses, no words; it gets the score of a document without a match;
* very long texts are read whole; ties do not matter; repeated rows are scored each, and count once in the learning;
* a null doc_id is held out as the text "" is, and has no label; a doc_id labelled twice is toxic if any of its labels says so;
* no labelled training documents, or labels of one kind only: nothing is an insult, and the score is the share of toxic labels,
  as if one of four more were toxic;
* an empty table gives no rows; other columns, ``lang`` and ``source`` among them, are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, over_arrays

#: Documents with this remainder of their doc_id's CRC are held out.
FOLDS, HELD_OUT = 5, 0
#: Labels that are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 1 << 20
#: Shortest and longest beginning of a word that is counted; share of the toxic groups, and number of groups, it must occur in.
SHORTEST, LONGEST = 4, 10
LEAST_SHARE, LEAST_GROUPS = 1 / 4096, 3
#: Occurrences that the shorter beginning's share counts for; least weight of an insult.
BELIEF, LEAST_WEIGHT = 3.0, 1.0
#: Words that a negation reaches; Newton steps; ridge.
SCOPE, STEPS, RIDGE = 3, 12, 1.0

#: Fixed word lists of the grammar, by class.
TARGETS = (
    "you your yours yourself u ur ye thou thee du dich dir dein deine deinen euch euer tu te toi ton ta vous votre vos "
    "tú ti usted ustedes vosotros os"
).split()
NEGATIONS = (
    "not no never isn aren wasn don doesn didn without neither nor nicht kein keine keinen nie niemals ohne ne pas jamais aucun sans "
    "nunca jamás ni sin"
).split()
REPORTS = (
    "said says say saying wrote writes called calls quoted quotes claimed alleged reported told sagte sagt schrieb nannte behauptete "
    "dit disait écrit appelé prétend dijo dice escribió llamó afirmó"
).split()
INTENTS = "will gonna shall going must should werde werden sollte vais va devrait voy vamos deberías".split()
HARMS = (
    "kill hurt beat shoot stab strangle murder destroy burn punch töten umbringen schlagen erschießen tuer frapper "
    "égorger brûler matar golpear apuñalar quemar"
).split()

OTHER, INSULT, TARGET, NEGATION, REPORT, QUOTE, INTENT, HARM = range(8)
CLASSES = {w: c for c, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (INTENT, INTENTS), (HARM, HARMS)) for w in ws}
#: What a matched clause can be.
KINDS = ("insult", "targeted", "negated", "reported", "threat")
#: Weight of a complete threat.
THREAT = 3.0

WORDS = re.compile(r"[^\W\d_]+")
#: Words and quotation marks of a clause; what ends a clause.
TOKENS = re.compile(r"[^\W\d_]+|[\"“”„«»]")
CLAUSE = re.compile(r"[^.!?;:\n…]+")


class Transducer:
    """States and arcs (state, class) -> (state, mark); without an arc the state stays and nothing is marked.

    ``last`` is what a state says at the clause's end.
    """

    def __init__(self, arcs: dict, start=0, last: dict | None = None):
        self.arcs, self.start, self.last = arcs, start, last or {}

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, None))

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same tokens; a pair of states marks what either marks.  Only states that can be reached are made."""
        start = (self.start, other.start)
        arcs, last, todo = {}, {}, [start]
        seen = {start}
        while todo:
            a, b = at = todo.pop()
            says = self.last.get(a, frozenset()) | other.last.get(b, frozenset())
            if says:
                last[at] = says
            for symbol in range(8):
                (x, p), (y, q) = self.step(a, symbol), other.step(b, symbol)
                arcs[at, symbol] = ((x, y), (p or frozenset()) | (q or frozenset()))
                if (x, y) not in seen:
                    seen.add((x, y))
                    todo.append((x, y))
        return Transducer(arcs, start, last)


def grammar() -> Transducer:
    mark = lambda m: frozenset([m])
    insults = Transducer({(0, INSULT): (0, mark("insult"))})
    threats = Transducer(
        {(0, INTENT): (1, None), (1, HARM): (2, None), (2, TARGET): (3, None)}, last={3: mark("threat")}
    )
    targets = Transducer({(0, TARGET): (1, None)}, last={1: mark("targeted")})
    scope: dict = {(k, NEGATION): (1, None) for k in range(SCOPE + 1)}
    for k in range(1, SCOPE + 1):
        after = k + 1 if k < SCOPE else 0
        scope |= {(k, s): (after, None) for s in (OTHER, TARGET, REPORT, INTENT, HARM)}
        scope[k, INSULT] = (after, mark("negated"))
    negation = Transducer(scope)
    quoted = {(0, REPORT): (1, None), (1, INSULT): (1, mark("reported")), (2, INSULT): (2, mark("reported"))}
    quoted |= {(0, QUOTE): (2, None), (1, QUOTE): (2, None), (2, QUOTE): (0, None)}
    reported = Transducer(quoted)
    return insults.compose(threats).compose(targets).compose(negation).compose(reported)


class Grammar:
    """The composed transducer with its states numbered, and the weights of words and beginnings of words."""

    def __init__(self, weights: dict[str, float]):
        made = grammar()
        states = {made.start: 0}
        for (_, _), (to, _) in made.arcs.items():
            states.setdefault(to, len(states))
        self.arcs: list = [[None] * 8 for _ in states]
        for (at, symbol), (to, said) in made.arcs.items():
            tag = 3 if "reported" in said else 2 if "negated" in said else 0
            self.arcs[states[at]][symbol] = (states[to], tag)
        self.says = [made.last.get(s, frozenset()) for s in states]
        self.weights, self.known = weights, {}

    def weight(self, word: str) -> float:
        """The weight of the longest part of the word that the trie holds; 0 if that is no insult."""
        found = self.weights.get(word + "$")
        for n in range(min(len(word), LONGEST), SHORTEST - 1, -1):
            if found is not None:
                break
            found = self.weights.get(word[:n])
        return found if found is not None and found >= LEAST_WEIGHT else 0.0

    def look_up(self, word: str) -> tuple[int, float]:
        """Class and weight of a word; an insult is one whatever else it may be."""
        w = self.weight(word)
        self.known[word] = got = (INSULT, w) if w else (CLASSES.get(word, OTHER), 0.0)
        return got

    def read(self, text: str) -> tuple[int, list[tuple[int, int, int, float]]]:
        """The number of words and the matched clauses: (start, end, kind, weight)."""
        low = text.lower()
        if len(low) != len(text):  # a letter that lowers to two: keep places
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        words = WORDS.findall(low)
        if len(self.known) > 1 << 18:
            self.known.clear()
        known, look_up = self.known, self.look_up
        classes = {known[w][0] if w in known else look_up(w)[0] for w in set(words)}
        if INSULT not in classes and HARM not in classes:
            return len(words), []
        out = []
        for clause in CLAUSE.finditer(low):
            state, sums, first, end = 0, [0.0] * 5, None, 0
            for m in TOKENS.finditer(low, clause.start(), clause.end()):
                token = m[0]
                symbol, w = (known.get(token) or look_up(token)) if token[0].isalpha() else (QUOTE, 0.0)
                state, tag = self.arcs[state][symbol]
                if symbol == INSULT or symbol == HARM:
                    first, end = m.start() if first is None else first, m.end()
                    sums[tag] += w
            said = self.says[state]
            if "targeted" in said:
                sums[0], sums[1] = 0.0, sums[0]
            if "threat" in said:
                sums[4] = THREAT
            out += [(first, end, k, s) for k, s in enumerate(sums) if s]
        return len(words), out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The training documents that have a label: ``docs``' columns and ``toxic``."""
    said = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    said = said.filter(~held_out(F.col("doc_id")))
    if said.count() <= BROADCAST_LABELS:
        said = F.broadcast(said)
    return docs.join(said, "doc_id")


def words_and_groups(text: Column) -> Column:
    """A text's distinct words and the key of its group of near copies: the least hash of its windows of three words."""
    import pyarrow as pa

    def run(batches):
        import numpy as np
        import xxhash

        hashed = xxhash.xxh64_intdigest
        for texts in batches:
            rows = []
            for t in texts:
                words = WORDS.findall((t.as_py() or "").lower())
                h = np.fromiter(map(hashed, words), np.uint64, len(words))
                while 0 < len(h) < 3:
                    h = np.append(h, np.uint64(0))
                h = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ h[2:]
                h *= np.uint64(0x165667B19E3779F9)
                key = int((h ^ h >> np.uint64(29)).min() >> np.uint64(1)) if len(h) else 0
                rows.append({"key": key, "words": sorted({w[:64] for w in words})})
            yield pa.array(rows, pa.struct([("key", pa.int64()), ("words", pa.list_(pa.string()))]))

    return over_arrays(run, "key long, words array<string>", text)


def vocabulary(training: DataFrame) -> DataFrame:
    """(word, toxic, clean): groups of near copies, by label, that hold a word; the word "" counts all groups."""
    found = training.select("toxic", words_and_groups(F.col("text")).alias("g"))
    words = found.select("toxic", F.col("g.key").alias("key"), F.explode(F.array_append("g.words", F.lit(""))).alias("word"))
    # a group's copies fall together before they are shuffled, so a hot group is no hot task
    once = words.groupBy("word", "key", "toxic").agg(F.lit(1).alias("one"))
    return once.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))


def beginnings(words: DataFrame) -> DataFrame:
    """(part, toxic, clean) summed over the words: their beginnings, and each whole word with a mark after it."""
    lengths = F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST)))
    starts = F.when(F.length("word") >= SHORTEST, F.transform(lengths, lambda n: F.substring("word", F.lit(1), n)))
    parts = F.array_append(F.coalesce(starts, F.array().cast("array<string>")), F.concat("word", F.lit("$")))
    parted = words.select(F.explode(parts).alias("part"), "toxic", "clean")
    return parted.groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def stands_out(toxic: Column, clean: Column, share: float) -> Column:
    """Log-likelihood ratio of the counts' own share of toxic ones against ``share``; 0 where it is no larger."""
    n = toxic + clean
    own = toxic / n
    ratio = toxic * F.log(own / share) + F.when(clean > 0, clean * F.log((1 - own) / (1 - share))).otherwise(0.0)
    return F.when(own > share, ratio).otherwise(0.0)


def learn_insults(training: DataFrame) -> dict[str, float]:
    """Weights of words (with a mark after them) and of beginnings of words."""
    import pyarrow as pa

    found = cut(vocabulary(training), "toxic-words")
    groups = found.filter("word = ''").first()
    words = found.filter("word <> ''")
    toxic, clean, kinds = words.agg(F.sum("toxic"), F.sum("clean"), F.count("*")).first()
    if not toxic or not clean:
        return {}
    share = toxic / (toxic + clean)
    least = max(LEAST_GROUPS, math.ceil(groups["toxic"] * LEAST_SHARE))
    above = stands_out(F.col("toxic"), F.col("clean"), share) > math.log(kinds)
    hopeful = beginnings(words).filter(F.col("toxic") >= least).filter(above)
    stems = training.sparkSession.sparkContext.broadcast({r["part"] for r in hopeful.select("part").toLocalIterator()})

    def under(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = stems.value
        for batch in batches:
            keep = [
                w + "$" in held or any(w[:n] in held for n in range(SHORTEST, min(len(w), LONGEST) + 1))
                for w in batch.column("word").to_pylist()
            ]
            yield batch.filter(pa.array(keep, pa.bool_()))

    # what follows an accepted beginning, with its own counts
    near = words.mapInArrow(under, "word string, toxic long, clean long")
    nodes = beginnings(near).filter(F.col("toxic") + F.col("clean") >= least)
    # a row for each node: their number is bounded by the share of the groups that a node must occur in
    return weigh({r["part"]: tuple(r)[1:] for r in nodes.withColumn("stem", above).toLocalIterator()}, share, least)


def weigh(nodes: dict[str, tuple[int, int, bool]], share: float, least: int) -> dict[str, float]:
    """Log odds of each node against the common share, each leaning on its siblings' share, and theirs on the common one.

    A node counts from the first beginning on that stands out; shorter ones, which most words under them do not, are left out.
    """
    odds = lambda p: math.log(p / (1 - p))
    weights: dict[str, float] = {}
    for part in sorted(nodes, key=lambda x: (len(x), x)):
        toxic, clean, stem = nodes[part]
        above = part[:-1]
        while above and above not in weights:
            above = above[:-1]
        if above or stem and toxic >= least:
            # what else begins as the node one shorter does; its own counts are not used twice
            others = [a - b for a, b in zip(nodes[above], (toxic, clean))] if above else (0, 0)
            lean = (others[0] + BELIEF * share) / (others[0] + others[1] + BELIEF)
            rate = (toxic + BELIEF * lean) / (toxic + clean + BELIEF)
            weights[part] = odds(rate) - odds(share)
    return weights


def clauses(text: Column, weights) -> Column:
    """(n_words, clauses) of a text; a clause is (start, end, kind, weight), places in code points."""
    import pyarrow as pa

    one = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("weight", pa.float64())])
    kind = pa.struct([("n_words", pa.int64()), ("clauses", pa.list_(one))])

    def run(batches):
        reader = Grammar(weights.value)
        names = [f.name for f in one]
        for texts in batches:
            read = [reader.read(t.as_py() or "") for t in texts]
            yield pa.array([{"n_words": n, "clauses": [dict(zip(names, c)) for c in found]} for n, found in read], kind)

    return over_arrays(run, "n_words long, clauses array<struct<start int, end int, kind int, weight double>>", text)


def features(read: Column) -> list[Column]:
    """What the logistic function sees of a document."""
    found = read["clauses"]
    add = lambda k: F.aggregate(F.filter(found, lambda c: c["kind"] == k), F.lit(0.0), lambda s, c: s + c["weight"])
    most = F.coalesce(F.array_max(F.transform(found, lambda c: c["weight"])), F.lit(0.0))
    return [
        F.lit(1.0),
        *(F.log1p(add(k)) for k in range(len(KINDS))),
        most / 4,
        F.log1p(F.size(found)),
        F.log1p(read["n_words"]) / 5,
    ]


def fit(rows: DataFrame, n: int) -> list[float]:
    """Ridge-penalised logistic weights of the features x0, x1, ... for ``toxic``, by Newton steps over sums of all rows."""
    import numpy as np

    at = np.zeros(n)
    x = [F.col(f"x{k}") for k in range(n)]
    for _ in range(STEPS):
        z = sum((float(w) * c for w, c in zip(at, x)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        rows_now = rows.withColumns({"_e": F.col("toxic") - p, "_v": p * (1 - p)})
        got = rows_now.agg(
            *(F.sum(F.col("_e") * a) for a in x), *(F.sum(F.col("_v") * x[i] * x[j]) for i in range(n) for j in range(i + 1))
        ).first()
        if got[0] is None:
            return [0.0] * n
        slope, bend = np.array(got[:n], float), np.zeros((n, n))
        bend[np.tril_indices(n)] = got[n:]
        bend += np.tril(bend, -1).T
        slope -= RIDGE * at * (np.arange(n) > 0)
        bend += np.diag([1e-6] + [RIDGE] * (n - 1))
        move = np.linalg.solve(bend, slope)
        move *= min(1.0, 4 / max(float(np.abs(move).max()), 1e-12))  # no wild first steps
        at = at + move
        if float(np.abs(move).max()) < 1e-4:
            break
    return [round(float(w), 9) for w in at]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the matched clauses of every document."""
    training = labelled(docs.select("doc_id", "text"), labels)
    weights = docs.sparkSession.sparkContext.broadcast(learn_insults(training))
    read = cut(docs.select("doc_id", clauses(F.col("text"), weights).alias("read")), "clauses")
    seen = features(F.col("read"))
    names = {f"x{k}": x for k, x in enumerate(seen)}
    rows = cut(labelled(read.select("doc_id", *(x.alias(k) for k, x in names.items())), labels), "toxic-features")
    counted = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if 0 < counted[1] < counted[0]:
        z = sum((w * x for w, x in zip(fit(rows, len(seen)), seen)), F.lit(0.0))
        chance = 1 / (1 + F.exp(-z))
    else:
        chance = F.lit((counted[1] + 1) / (counted[0] + 4))
    marked = F.transform(
        "read.clauses",
        lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), F.get(F.array(*map(F.lit, KINDS)), c["kind"]).alias("kind"),
            F.round(c["weight"], 4).alias("weight"),
        ),
    )
    scored = read.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), chance.alias("score"), marked.alias("clauses"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")
