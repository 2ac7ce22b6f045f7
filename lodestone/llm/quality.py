"""Quality rules by weak supervision.

Each rule votes good (1), bad (0) or abstains (-1) on a document's signals.  Expectation-maximisation
over all documents estimates, for each rule and either hidden class, how often it votes which way, and
the posterior probability that a document is good replaces a demand that all rules pass.

The estimate needs only how often each pattern of votes occurs: at most 3 to the number of rules rows,
counted over all documents before anything reaches the driver.  Texts are read once; what the rules look
at is a few numbers for each document.

Defined results
* null or empty text: no words, all counts 0, rejected by the base rule on length;
* very long texts are read whole, one at a time; ties in the posterior (exactly 1/2) are kept;
* repeated rows are judged each; an empty table gives no rows and no estimate;
* other columns, whatever their names, are passed on by :func:`keep_good` and not read by :func:`judge`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import columns_of, cut, give_back, over_arrays, unique

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: A mark that follows itself; a word without a letter or digit.
_DOUBLED = re.compile(rb"([!-/:-@\[-`{-~])\1+")
_BARE = re.compile(rb"[!-/:-@\[-`{-~]+").fullmatch
#: Counted besides the base figures: what the rules look at.
SIGNALS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_letters long, n_upper long, n_distinct long, top_words long, n_marked long"
)
#: The base rule.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A document stays if it is good with at least this probability.
LEAST_GOOD = 0.5


def repeated_words(words: list) -> tuple[int, int, int]:
    """(words in a 3-word window that occurs twice or more, distinct words, occurrences of the commonest)."""
    import numpy as np

    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    n = len(known)
    top = int(np.bincount(ids).max()) if len(words) else 0
    if len(words) < 4:
        return 0, n, top
    pairs = ids[:-1] * n + ids[1:]
    if n >= 1 << 20:  # three numbers no longer fit in 63 bits: number the pairs first
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * n + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0, n, top
    twice = np.zeros(len(windows) + 2, bool)
    hit = np.zeros(len(windows), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    for k in range(3):
        twice[k : k + len(windows)] |= hit
    return int(twice.sum()), n, top


def text_signals(text: str | None) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the six ASCII white-space characters
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeat, distinct, top = repeated_words(words)
    symbols = sum(map(text.count, SYMBOLS))
    space = sum(map(text.count, SPACES))
    digits = sum(map(raw.count, (b"%d" % k for k in range(10))))
    marks = sum(map(raw.count, (b".", b",", b"!", b"?", b"'", b'"', b"-", b":", b";", b"(", b")")))
    chars = len(text) - space
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marked = len(_DOUBLED.findall(raw)) + sum(1 for w in words if _BARE(w))
    return (
        len(words), chars, symbols, len(lines) - len(set(lines)), repeat,
        len(lines), chars - symbols - digits - marks, upper, distinct, top, marked,
    )


def signals(text: Column) -> Column:
    """``SIGNALS`` of a text, as a struct: the text alone goes to Python, and only numbers come back."""
    import pyarrow as pa

    names = [x.split()[0] for x in SIGNALS.split(", ")]

    def run(batches):
        for texts in batches:
            rows = [text_signals(t.as_py()) for t in texts]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
            del texts, rows, columns
            give_back()

    return over_arrays(run, SIGNALS, text)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def rules(c: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """Name and vote of each rule, from the signals that ``c`` gives; a ratio over no words abstains."""
    per = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    some = c("n_words") > 0
    return {
        "symbols": _vote(some & (per("n_symbols", "n_words") > 0.2), some & (per("n_symbols", "n_words") < 0.02)),
        "letters": _vote(some & (per("n_letters", "word_chars") < 0.8), some & (per("n_letters", "word_chars") > 0.93)),
        "capitals": _vote(some & (per("n_upper", "n_letters") > 0.4), some & (per("n_upper", "n_letters") < 0.1)),
        "ornaments": _vote(some & (per("n_marked", "n_words") > 0.2), some & (per("n_marked", "n_words") < 0.01)),
        "repeats": _vote(
            some & (per("n_repeat_words", "n_words") > 0.3), some & (per("n_repeat_words", "n_words") < 0.1)
        ),
        "lines": _vote((c("n_lines") > 3) & (per("n_dup_lines", "n_lines") > 0.3), c("n_dup_lines") == 0),
        "variety": _vote(
            (c("n_words") >= 50) & (per("top_words", "n_words") > 0.25),
            (c("n_words") >= 50) & (per("top_words", "n_words") < 0.12),
        ),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> dict:
    """Expectation-maximisation over counted vote patterns: the prior and each rule's vote rates by class.

    The classes start from a simple count: a document with any bad vote leans bad.  Rates are smoothed as if each vote had been seen ``1`` time more, and a rule's bad votes are
    held to be likelier among bad documents, so the classes cannot change places.
    """
    if not patterns:
        return {"prior": 0.5, "rates": []}
    m = len(patterns[0][0])
    good = [0.02 if sum(v == 0 for v in p) else 0.98 for p, _ in patterns]
    last = None
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        weight = [sum(n * (g if y else 1 - g) for (_, n), g in zip(patterns, good)) for y in (0, 1)]
        prior = min(max((weight[1] + 1) / (total + 2), 0.05), 0.95)
        rates = []
        for j in range(m):
            by_class = []
            for y in (0, 1):
                seen = {v: 1.0 for v in (-1, 0, 1)}
                for (p, n), g in zip(patterns, good):
                    seen[p[j]] += n * (g if y else 1 - g)
                s = sum(seen.values())
                by_class.append({v: x / s for v, x in seen.items()})
            if by_class[0][0] < by_class[1][0]:  # no evidence either way
                mean = {v: (by_class[0][v] + by_class[1][v]) / 2 for v in (-1, 0, 1)}
                by_class = [mean, mean]
            rates.append(by_class)
        model = {"prior": prior, "rates": rates}
        good = [posterior(model, p) for p, _ in patterns]
        likely = sum(n * g for (_, n), g in zip(patterns, good))
        if last is not None and abs(likely - last) < 1e-9 * max(1.0, abs(last)):
            break
        last = likely
    return model


def posterior(model: dict, votes: tuple[int, ...]) -> float:
    """Probability that a document with these votes is good."""
    odds = math.log(model["prior"] / (1 - model["prior"]))
    for (bad, good), v in zip(model["rates"], votes):
        odds += math.log(good[v] / bad[v])
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def estimate(found: DataFrame) -> dict:
    """The model fitted to the counted vote patterns of all documents' signals."""
    votes = [v.alias(k) for k, v in rules().items()]
    counted = found.select(*votes).groupBy(*rules()).count().collect()  # at most 3 ** len(rules) rows
    return fit([(tuple(r[:-1]), r[-1]) for r in sorted(counted, key=tuple)])


def verdict(model: dict, least_good: float, c: Callable[[str], Column] = F.col) -> tuple[Column, Column, Column]:
    """``base_failed``, ``good`` (the posterior) and ``kept`` from the signals that ``c`` gives."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for vote, (bad, good) in zip(rules(c).values(), model["rates"]):
        step = {k: math.log(good[k] / bad[k]) for k in (-1, 0, 1)}
        odds = odds + F.when(vote == 0, step[0]).when(vote == 1, step[1]).otherwise(step[-1])
    failed = (c("n_words") < LEAST_WORDS) | (100 * c("n_repeat_words") > MOST_REPEATED * c("n_words"))
    good = 1 / (1 + F.exp(-odds))
    return failed.alias("base_failed"), good.alias("good"), (~failed & (good >= least_good)).alias("kept")


def judge(docs: DataFrame, least_good: float = LEAST_GOOD) -> DataFrame:
    """doc_id, the signals, ``base_failed``, ``good`` (the posterior) and ``kept`` of every document."""
    found = docs.select("doc_id", signals(F.col("text")).alias("s")).select("doc_id", "s.*")
    found = cut(found, "quality-signals")
    return found.select("*", *verdict(estimate(found), least_good))


def keep_good(docs: DataFrame, least_good: float = LEAST_GOOD) -> DataFrame:
    """The documents that :func:`judge` keeps, with their columns.

    The texts are read twice, to estimate and to judge, and so need not be shuffled or written.
    """
    model = estimate(docs.select(signals(F.col("text")).alias("s")).select("s.*"))
    name = unique("signals")
    judged = docs.select("*", signals(F.col("text")).alias(name))
    return judged.filter(verdict(model, least_good, lambda c: F.col(name)[c])[2]).select(*columns_of(docs))
