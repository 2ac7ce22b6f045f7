"""Secret scans (native: DataFrame functions only).

Three fixed patterns give the base spans.  Beside them, candidate strings (runs of token characters)
are searched by Shannon entropy: a fixed window slides over each class run of a candidate, the counts
of its characters are kept up to date by adding the character that enters and removing the one that
leaves, and a window whose entropy reaches the class's threshold marks its run.  Candidates that an
allow-list pattern knows (words, identifiers, paths, plain numbers, UUIDs) are suppressed.

Everything is an expression over one row: no shuffle, and a document's whole text is scanned.

Positions come from ``split`` and ``regexp_extract_all`` on one pattern: the gaps and the matches
alternate, so the start of match k is the sum of the lengths before it.

Defined results
* null text: scanned as empty; empty text: no spans and the hash of the empty string;
* positions count code points, ends are exclusive;
* ties (two kinds with one start) are ordered as the kinds are listed; repeated rows are scanned each, very long texts whole;
* an empty table gives no rows;
* other columns are passed on; names the operator adds replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import columns_of, let, unique

#: kind, pattern, group whose length counts, least length.  Fixed values.
BASE = (
    (
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        8,
    ),
    # a run is maximal, so asking for its length within the pattern drops the same matches
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Entropy search: kind, pattern of a class run, window in characters, least entropy in bits a character.
#: The thresholds of the last four are what all but one in 200 uniformly random windows of the alphabet reach.
CLASSES = (
    ("entropy_hex", r"[0-9a-fA-F]{20,}", 20, 3.0),
    ("entropy_base64", r"[A-Za-z0-9+/_=-]{20,}", 20, 3.9),
    ("entropy_base32", r"[A-Z2-7]{20,}", 20, 3.28),
    ("entropy_upper", r"[A-Z0-9]{20,}", 20, 3.34),
    ("entropy_lower", r"[a-z0-9]{20,}", 20, 3.34),
    ("entropy_mixed", r"[A-Za-z0-9]{20,}", 20, 3.58),
)
#: Candidates matching one of these are no secrets.
ALLOWED = (
    r"^[A-Za-z]+$",  # a word
    r"^[0-9]+$",  # a plain number
    r"^[A-Z]?[a-z]+(?:[_/-][A-Z]?[a-z]+)*+[0-9]{0,4}$",  # an identifier, slug or path of words
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # a UUID
    r"^[-_=+/]+$",  # a ruler
)


def _spans(text: Column, kind: Column, pattern: str, keep) -> Column:
    """All leftmost non-overlapping matches that ``keep`` accepts: array of (start, kind, end, value)."""
    begun = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>").alias("spans"),
    )

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["match"])
        span = F.struct(start.alias("start"), kind.alias("kind"), end.alias("end"), pair["match"].alias("value"))
        spans = F.when(keep(pair["match"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    def paired(matches: Column) -> Column:
        # the last gap follows the last match and pairs with none
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        return F.when(F.size(matches) > 0, F.aggregate(pairs, begun, step, lambda s: s["spans"])).otherwise(
            begun["spans"]
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), paired)


def window_entropy(run: Column, window: int) -> Column:
    """Greatest Shannon entropy, in bits a character, of any window of a run.

    H = log2(w) - (sum of c log2 c) / w over the counts c.  A step of the window changes two
    counts, and the sum by f(c + 1) - f(c) for the one that enters and f(c - 1) - f(c) for the other.
    """
    # f(c) = c log2 c for c = 0 .. window + 1, as a rule
    import math

    f_table = F.array(*(F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(window + 2)))
    f = lambda c: F.element_at(f_table, c + 1)
    def step(codes: Column):
        def one(state: Column, i: Column) -> Column:
            enters = F.element_at(codes, i)
            leaves = F.when(i > window, F.element_at(codes, F.greatest(i - window, F.lit(1)))).otherwise(F.lit(0))
            c_in = F.element_at(state["counts"], enters)
            c_out = F.when(leaves > 0, F.element_at(state["counts"], F.greatest(leaves, F.lit(1)))).otherwise(F.lit(0))
            total = state["sum"] + F.when(
                enters == leaves, F.lit(0.0)
            ).otherwise(f(c_in + 1) - f(c_in) + F.when(leaves > 0, f(c_out - 1) - f(c_out)).otherwise(F.lit(0.0)))
            counts = F.transform(
                state["counts"],
                lambda c, k: c + F.when(k + 1 == enters, 1).otherwise(0) - F.when(k + 1 == leaves, 1).otherwise(0),
            )
            full = F.when(i >= window, F.lit(math.log2(window)) - total / window).otherwise(F.lit(0.0))
            return F.struct(counts.alias("counts"), total.alias("sum"), F.greatest(state["best"], full).alias("best"))

        return one

    def slide(codes: Column) -> Column:
        begun = F.struct(
            F.array_repeat(F.lit(0), F.array_max(codes)).alias("counts"),
            F.lit(0.0).alias("sum"),
            F.lit(0.0).alias("best"),
        )
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), begun, step(codes), lambda s: s["best"])

    def code(chars: Column) -> Column:
        return let(
            F.array_distinct(chars),
            lambda letters: F.transform(chars, lambda c: F.array_position(letters, c).cast("int")),
        )

    return let(let(F.split(run, ""), code), slide)


def _suspicious(window: int, least: float):
    def keep(run: Column) -> Column:
        known = F.lit(False)
        for pattern in ALLOWED:
            known = known | run.rlike(pattern)
        return F.when(known, F.lit(False)).otherwise(window_entropy(run, window) >= least)

    return keep


def _found(docs: DataFrame, base: str, found: str) -> DataFrame:
    """``docs`` with the spans of :func:`scan` in columns of the names given."""
    text, more_spans = F.coalesce(F.col("text"), F.lit("")), unique("more")
    fixed = [
        _spans(text, F.lit(k), p, lambda m, p=p, g=g, n=n: F.char_length(F.regexp_extract(m, p, g)) >= n)
        for k, (_, p, g, n) in enumerate(BASE)
    ]
    more = [
        _spans(text, F.lit(len(BASE) + k), p, _suspicious(w, least)) for k, (_, p, w, least) in enumerate(CLASSES)
    ]
    kept = columns_of(docs)
    spans = docs.select(*kept, F.array_sort(F.concat(*fixed)).alias(base), F.concat(*more).alias(more_spans))
    return spans.select(*kept, base, F.array_sort(F.concat(base, more_spans)).alias(found))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` and ``found``: arrays of (start, kind, end, value), sorted.

    ``base`` has the three patterns' spans, ``found`` those and the spans found by entropy.  They take the place of
    columns of these names.
    """
    kept = [c for c, name in zip(columns_of(docs), docs.columns) if name not in ("base", "found")]
    return _found(docs.select(*kept), "base", "found")


def kinds() -> list[str]:
    return [k[0] for k in (*BASE, *CLASSES)]


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, kinds()))
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
        ),
        ",",
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span found replaced in the text, overlapping ones as one; ``n_chars`` follows.

    A null text stays null.
    """
    begun = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    text = F.col("text")

    def step(state: Column, s: Column) -> Column:
        at = F.greatest(state["at"], s["end"])
        free = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        out = F.when(s["start"] < state["at"], state["text"]).otherwise(F.concat(state["text"], free, F.lit(mark)))
        return F.struct(at.alias("at"), out.alias("text"))

    def rest(state: Column) -> Column:
        return F.concat(state["text"], F.substring(text, state["at"] + 1, F.char_length(text)))

    base, found = unique("base"), unique("found")
    cleaned = F.when(F.size(found) > 0, F.aggregate(found, begun, step, rest)).otherwise(text)
    out = _found(docs, base, found).withColumn("text", cleaned)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*columns_of(docs))
