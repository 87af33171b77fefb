"""Personal data: base spans by pattern, further spans by weak supervision. DataFrame functions only.

Base kinds are decided by their pattern and test alone. Candidates for further spans get votes from labelers (form,
gazetteer of cue words, context). Expectation maximisation estimates how reliable each labeler is
and how likely each pattern of votes is right; a naive Bayes classifier over the shape of the span learns from
that and decides. Training sees one table of counts, whose size the number of shapes bounds.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.session import stored

# --- base kinds --------------------------------------------------------------------------------------------
# Leftmost matches, as the plain patterns find them. The look-behinds only skip starts inside a run that has
# failed from its beginning (\G: right after a match), and possessive loops need no stack, so long runs stay linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# The whole run of digits with single separators, of 13 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PART = r"0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
BASE = ("email", "ip", "card", "phone")

# --- candidates --------------------------------------------------------------------------------------------
SECRET = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{12,}+"
LOCAL = r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])"
ADDED = ("secret", "phone_local")
CUES = {
    "secret": "password|passwd|pwd|passphrase|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|bearer|credential",
    "phone_local": "phone|tel|telephone|mobile|cell|call|fax|telefon|teléfono|téléphone|appel|anruf|llamar",
}
NEAR = 24  # characters before a candidate in which a cue counts
YES, NO, ABSTAIN = 1, 0, -1
LABELERS = ("form", "gazetteer", "context", "plainness")
FEATURES = ("kind", "length", "digits", "letters", "before", "after")
ROUNDS = 60
SURE = 0.9

SPAN = "array<struct<start:bigint,stop:bigint,value:string>>"

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str, worth: Column) -> Column:
    """All matches with code point positions, from the lengths of the matches and the gaps between them."""
    steps = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.split(text, pattern, -1),
        lambda value, gap: F.struct(
            value.alias("value"), F.char_length(gap).alias("gap"), F.char_length(value).alias("size")
        ),
    )
    spans = F.aggregate(
        F.filter(steps, lambda step: step["value"].isNotNull()),  # the last gap has no match after it
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("spans")),
        lambda acc, step: let(
            acc["at"] + step["gap"],
            lambda start: F.struct(
                (start + step["size"]).alias("at"),
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            start.alias("start"), (start + step["size"]).alias("stop"), step["value"].alias("value")
                        )
                    ),
                ).alias("spans"),
            ),
        ),
    )["spans"]
    return F.when(worth, spans).otherwise(F.array().cast(SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of (start, stop, value) for each base kind."""
    email = matches(text, EMAIL, F.contains(text, F.lit("@")))
    ip = matches(text, IP, F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")))
    card = matches(text, CARD, F.rlike(text, F.lit(r"[0-9](?:[ -]?[0-9]){12}")))
    phone = matches(text, PHONE, F.rlike(text, F.lit(r"\+[0-9]")))
    count = lambda s: F.char_length(_digits(s["value"]))
    return {
        "email": email,
        "ip": F.filter(ip, lambda s: F.rlike(s["value"], F.lit(rf"^{PART}(?:\.{PART}){{3}}$"))),
        "card": F.filter(card, lambda s: F.call_function("luhn_check", _digits(s["value"]))),
        "phone": F.filter(phone, lambda s: (count(s) >= 9) & (count(s) <= 15)),
    }


# --- candidates and their votes ----------------------------------------------------------------------------


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(YES))
    return (out if no is None else out.when(no, F.lit(NO))).otherwise(F.lit(ABSTAIN))


def _step(value: Column, *edges: float) -> Column:
    out = F.lit(str(len(edges)))
    for k in reversed(range(len(edges))):
        out = F.when(value < edges[k], F.lit(str(k))).otherwise(out)
    return out


def _class(char: Column) -> Column:
    """Coarse class of a character, or of the lack of one."""
    return (
        F.when(char == "", "edge")
        .when(F.rlike(char, F.lit(r"^\s$")), "blank")
        .when(F.rlike(char, F.lit("^[=:]$")), "sign")
        .when(F.rlike(char, F.lit("""^["'`]$""")), "quote")
        .when(F.rlike(char, F.lit(r"^[\p{L}\p{N}]$")), "word")
        .otherwise("mark")
    )


def _candidate(text: Column, kind: str, span: Column) -> Column:
    start, stop = span["start"], span["stop"]
    lead = F.least(F.lit(NEAR).cast("bigint"), start)
    around = F.struct(
        span["value"].alias("value"),
        F.substring(text, (start - lead + 1).cast("int"), lead.cast("int")).alias("before"),
        F.substring(text, (stop + 1).cast("int"), F.lit(1)).alias("after"),
    )
    return let(around, lambda near: _judged(kind, span, near))


def _judged(kind: str, span: Column, near: Column) -> Column:
    value, before = near["value"], F.lower(near["before"])
    size = F.char_length(value)
    digits = F.char_length(_digits(value)) / size
    upper, lower = F.rlike(value, F.lit("[A-Z]")), F.rlike(value, F.lit("[a-z]"))
    if kind == "secret":
        form = _vote(
            F.rlike(
                value,
                F.lit("^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|(?:AKIA|ASIA)[0-9A-Z]{16}|[a-z]{2,4}_[A-Za-z0-9]{20,})$"),
            ),
            F.rlike(value, F.lit("^[A-Za-z]+(?:[_/-][A-Za-z]+)*[_/-]?[0-9]{1,4}$")),  # chapter-12, version_3
        )
        context = _vote(F.rlike(before, F.lit("""[=:]\\s*["'`]?$""")), F.rlike(before, F.lit(r"https?://\S*$")))
        plain = _vote((digits > 0.15) & (size >= 16), F.rlike(value, F.lit("[A-Za-z]{10,}")) | (digits < 0.08))
    else:
        form = _vote(F.rlike(value, F.lit(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$")))
        context = _vote(F.rlike(before, F.lit(r"[:(]\s*$")), F.rlike(before, F.lit(r"[0-9=*/]\s*$")))
        plain = _vote(F.rlike(value, F.lit("[()-]")), F.rlike(value, F.lit(r"^[0-9]+ [0-9]+ [0-9]+$")))
    cue = F.rlike(before, F.lit(rf"(?:^|[^\p{{L}}])(?:{CUES[kind]})[^\p{{L}}]*$"))
    votes = dict(zip(LABELERS, (form, _vote(cue), context, plain)))
    features = {
        "kind": F.lit(kind),
        "length": _step(size, 16, 20, 32, 41, 65),
        "digits": _step(digits, 0.1, 0.25, 0.5, 0.8),
        "letters": F.when(upper & lower, "mixed").when(upper, "upper").when(lower, "lower").otherwise("none"),
        "before": _class(F.right(near["before"], F.lit(1))),
        "after": _class(near["after"]),
    }
    return F.struct(
        F.lit(kind).alias("kind"),
        span["start"].alias("start"),
        span["stop"].alias("stop"),
        *[vote.cast("int").alias(name) for name, vote in votes.items()],
        *[value.alias(f"f_{name}") for name, value in features.items()],
    )


def detect(docs: DataFrame, text_col: str, into: str = "found") -> DataFrame:
    """Add ``into``: a struct with an array of spans for each base kind, and ``candidates``.

    Candidates that touch a base span are left out. A NULL text counts as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.struct(*[spans.alias(kind) for kind, spans in base_spans(text).items()])
    patterns = {"secret": SECRET, "phone_local": LOCAL}

    def of(kind: str, taken: Column) -> Column:
        free = F.filter(
            matches(text, patterns[kind], F.rlike(text, F.lit("[0-9]"))),
            lambda s: ~F.exists(taken, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])),
        )
        if kind == "secret":
            free = F.filter(free, lambda s: F.rlike(s["value"], F.lit("[A-Za-z]")))
        return F.transform(free, lambda s: _candidate(text, kind, s))

    def whole(b: Column) -> Column:
        candidates = let(F.concat(*[b[kind] for kind in BASE]), lambda t: F.concat(*[of(k, t) for k in ADDED]))
        return F.struct(*[b[kind].alias(kind) for kind in BASE], candidates.alias("candidates"))

    return docs.withColumn(into, let(base, whole))


# --- learning ----------------------------------------------------------------------------------------------


@dataclass
class SpanModel:
    """Log odds of a true span for each value of each feature, and the prior log odds; labeler figures."""

    prior: float
    weights: dict[str, dict[str, float]]
    reliability: dict[str, tuple[float, float]]


def maximise(rows: Sequence[tuple[tuple[int, ...], float]]) -> tuple[dict[tuple[int, ...], float], list[dict]]:
    """Posterior of each vote pattern, and each labeler's vote probabilities by class, from pattern counts.

    Starts from the majority and alternates between reliabilities and posteriors; one vote of each kind is added
    to every count, so no labeler is ever held to be perfect.
    """
    posterior = {}
    for votes, _ in rows:
        balance = sum((v == YES) - (v == NO) for v in votes)
        posterior[votes] = 1 / (1 + math.exp(-2.0 * balance + 1.0))
    tables: list[dict] = []
    for _ in range(ROUNDS):
        true = sum(n * posterior[v] for v, n in rows)
        false = sum(n * (1 - posterior[v]) for v, n in rows)
        tables = []
        for j in range(len(LABELERS)):
            table = {(y, vote): 1.0 for y in (0, 1) for vote in (YES, NO, ABSTAIN)}
            for votes, n in rows:
                table[1, votes[j]] += n * posterior[votes]
                table[0, votes[j]] += n * (1 - posterior[votes])
            tables.append({key: x / ((true if key[0] else false) + 3) for key, x in table.items()})
        prior = math.log((true + 1) / (false + 1))
        for votes, _ in rows:
            odds = prior + sum(
                math.log(table[1, vote] / table[0, vote]) for table, vote in zip(tables, votes)
            )
            posterior[votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return posterior, tables


def learn(found: DataFrame, column: str = "found") -> SpanModel:
    """Fit to all candidates, counted by votes and shape: one aggregation, a table of bounded size."""
    each = found.select(F.explode(f"{column}.candidates").alias("c"))
    names = [*LABELERS, *[f"f_{name}" for name in FEATURES]]
    counted = each.groupBy(*[F.col(f"c.{name}").alias(name) for name in names]).agg(F.count(F.lit(1)).alias("n"))
    rows = [(tuple(row[name] for name in names), float(row["n"])) for row in counted.collect()]
    rows.sort(key=lambda row: tuple(map(str, row[0])))
    k = len(LABELERS)
    patterns: dict[tuple[int, ...], float] = defaultdict(float)
    for values, n in rows:
        patterns[values[:k]] += n
    posterior, tables = maximise(sorted(patterns.items()))
    true = sum(n * posterior[values[:k]] for values, n in rows)
    false = sum(n for _, n in rows) - true
    weights: dict[str, dict[str, float]] = {}
    for i, name in enumerate(FEATURES):
        sums: dict[str, list[float]] = defaultdict(lambda: [0.5, 0.5])
        for values, n in rows:
            sums[values[k + i]][1] += n * posterior[values[:k]]
            sums[values[k + i]][0] += n * (1 - posterior[values[:k]])
        weights[name] = {
            value: math.log((s[1] / (true + 0.5 * len(sums))) / (s[0] / (false + 0.5 * len(sums))))
            for value, s in sums.items()
        }
    reliability = {
        name: (table[1, YES], table[0, YES]) for name, table in zip(LABELERS, tables)
    }
    return SpanModel(math.log((true + 0.5) / (false + 0.5)), weights, reliability)


def _accepted(model: SpanModel, c: Column) -> Column:
    """Sure by shape, and backed by more labelers than speak against it, two at least."""
    odds = F.lit(model.prior)
    for name, table in model.weights.items():
        term = F.lit(0.0)
        for value, weight in sorted(table.items()):
            term = F.when(c[f"f_{name}"] == value, F.lit(weight)).otherwise(term)
        odds = odds + term
    yes = sum((F.when(c[name] == YES, 1).otherwise(0) for name in LABELERS), F.lit(0))
    no = sum((F.when(c[name] == NO, 1).otherwise(0) for name in LABELERS), F.lit(0))
    return (odds >= math.log(SURE / (1 - SURE))) & (yes >= 2) & (yes > no)


def spans_of(model: SpanModel, column: str = "found") -> Column:
    """All spans as an array of (kind, start, stop): base kinds as listed, then added ones, each by start."""
    named = lambda kind: F.transform(
        F.col(f"{column}.{kind}"),
        lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")),
    )
    added = F.transform(
        F.filter(F.col(f"{column}.candidates"), lambda c: _accepted(model, c)),
        lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop")),
    )
    return F.concat(*[named(kind) for kind in BASE], added)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by ``[KIND]``; spans that overlap become one, named by the first."""
    piece = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))

    def replaced(found: Column) -> Column:
        whole = F.aggregate(
            F.array_sort(found, lambda a, b: (a["start"] - b["start"]).cast("int")),
            F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
            lambda acc, s: F.struct(
                F.greatest(acc["at"], s["stop"]).alias("at"),
                F.when(
                    s["start"] >= acc["at"],
                    F.concat(acc["out"], piece(acc["at"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")),
                )
                .otherwise(acc["out"])
                .alias("out"),
            ),
            lambda acc: F.concat(acc["out"], piece(acc["at"], F.char_length(text).cast("bigint"))),
        )
        return F.when(F.size(found) > 0, whole).otherwise(text)

    return let(spans, replaced)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, spans)`` of every row: arrays of (kind, start, stop), ends exclusive, in code points.

    The spans found are stored once, without the texts. A NULL text is empty and has no span; NULL ids
    and repeated rows are kept; other columns are not read.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = stored(detect(given, "text").select("doc_id", "found"), "spans", compact=True)
    model = learn(found)
    base = F.filter(F.col("spans"), lambda s: s["kind"].isin(*BASE))
    return found.withColumn("spans", spans_of(model)).select("doc_id", base.alias("base"), "spans")


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in ``text_col``; all columns stay, a NULL text too."""
    hidden = next(name for k in range(len(docs.columns) + 1) if (name := f"found_{k}") not in docs.columns)
    found = detect(docs, text_col, hidden)
    model = learn(found, hidden)
    clean = redacted(F.col(text_col), spans_of(model, hidden))
    return found.withColumn(text_col, clean).drop(hidden)
