"""Scoring of news rows.

The model call itself is a plug-in (``score`` runs any pandas function over
Arrow batches with ``mapInPandas``); everything around it — prompt
building, response cleaning, JSON parsing, validation and incremental
bookkeeping — is column expressions and joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip

# Score fields and their contract (ranges stated to the scorer).
SCORE_FIELDS = ["sentiment_score", "impact_intensity", "certainty", "time_horizon"]
TEXT_FIELDS = ["summary", "evidence", "reason"]
SENTIMENT_RANGE = (-1.0, 1.0)
UNIT_RANGE = (0.0, 1.0)
HORIZON_VALUES = (0.8, 0.4, 0.1)

DEFAULT_TEMPLATE = (
    "You are an equity analyst. Assess the impact of the news below on stock {stock_id}.\n"
    "{body}\n"
    "Answer with JSON only: sentiment_score in [-1, 1], impact_intensity in [0, 1], "
    "certainty in [0, 1], time_horizon one of 0.8 (short), 0.4 (medium), 0.1 (long), "
    "summary, evidence ({hint}), reason."
)


def has_text(text: Column) -> Column:
    """Text present and not blank after Python-style strip."""
    return py_strip(F.coalesce(text, F.lit(""))) != ""


def scoring_mode(df: DataFrame, text: str = "text") -> DataFrame:
    """N1: 'title+text' when the text is present and not blank, else 'title'."""
    return df.withColumn("mode", F.when(has_text(F.col(text)), F.lit("title+text")).otherwise(F.lit("title")))


def build_prompt(df: DataFrame, stock_id: Column | str, template: str = DEFAULT_TEMPLATE,
                 title: str = "title", text: str = "text") -> DataFrame:
    """Prompt column from a template with {stock_id}, {body} and {hint}."""
    sid = F.lit(stock_id) if isinstance(stock_id, str) else stock_id
    body = F.when(has_text(F.col(text)),
                  F.concat(F.lit("Title: "), F.coalesce(F.col(title), F.lit("")), F.lit("\nText: "), F.col(text))) \
        .otherwise(F.concat(F.lit("Title: "), F.coalesce(F.col(title), F.lit("")),
                            F.lit("\n(no text: infer from the title only)")))
    hint = F.when(has_text(F.col(text)), F.lit("quote one concrete fact from the text")).otherwise(
        F.lit("inferred from the title"))
    pieces = template.split("{")
    cols: list[Column] = [F.lit(pieces[0])]
    for p in pieces[1:]:
        key, rest = p.split("}", 1)
        cols.append({"stock_id": sid, "body": body, "hint": hint}[key])
        cols.append(F.lit(rest))
    return df.withColumn("prompt", F.concat(*cols))


def score(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], cols: Sequence[str],
          out: str = "response") -> DataFrame:
    """Run a pluggable scorer over Arrow batches; one response string per row.

    ``scorer`` takes a pandas frame of ``cols`` and returns the responses.
    """
    schema = T.StructType(list(df.select(*cols).schema.fields) + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.copy()
            b[out] = scorer(b).astype(object)
            yield b

    return df.select(*cols).mapInPandas(run, schema)


# Fixed values of the test scorer: a tiny lexicon (not a model; used to exercise N3).
POSITIVE_WORDS = ["growth", "gain", "record", "beat", "rise", "strong", "profit", "up"]
NEGATIVE_WORDS = ["loss", "fall", "weak", "cut", "risk", "drop", "down", "miss"]


def lexicon_scorer(text_col: str = "text", title_col: str = "title") -> Callable[[pd.DataFrame], pd.Series]:
    """Deterministic scorer for tests: JSON with sentiment from positive/negative word counts."""
    import json
    import re

    pos, neg = set(POSITIVE_WORDS), set(NEGATIVE_WORDS)
    word = re.compile(r"\w+", re.U)

    def f(b: pd.DataFrame) -> pd.Series:
        out = []
        for title, text in zip(b[title_col], b[text_col]):
            words = word.findall(f"{title or ''} {text or ''}".lower())
            p = sum(w in pos for w in words)
            n = sum(w in neg for w in words)
            tot = p + n
            out.append(json.dumps({
                "sentiment_score": 0.0 if tot == 0 else round((p - n) / tot, 3),
                "impact_intensity": min(1.0, round(tot / 10.0, 3)),
                "certainty": 1.0 if text else 0.5,
                "time_horizon": 0.8 if tot > 3 else 0.4,
                "summary": (title or "")[:40],
                "evidence": f"{p} positive, {n} negative words",
                "reason": "lexicon",
            }))
        return pd.Series(out)

    return f


def strip_fence(c: Column) -> Column:
    """Strip, drop one leading ```json and one trailing ```, strip again (Python whitespace)."""
    t = py_strip(c)
    t = F.regexp_replace(t, r"^```json", "")
    t = F.regexp_replace(t, r"```\z", "")
    return py_strip(t)


_RAW_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in SCORE_FIELDS + TEXT_FIELDS])


def parse_scores(df: DataFrame, col: str = "response", out: str = "scores", keys: str | None = None) -> DataFrame:
    """JSON object text -> struct ``out`` of typed scores; anything else -> all-null struct.

    Fields are read as text and ``try_cast`` to double, so "0.7" is accepted and
    "abc" becomes null.  A JSON list or malformed text yields nulls (the
    reference aborts its whole run on a list).  The text is cleaned once and
    parsed once per row: the steps are separate projections so that neither the
    cleaning chain nor the parser is repeated per extracted field.  ``keys`` names a
    further column for the object's keys (null where nothing was parsed), which tells
    an explicit JSON null from a missing key.
    """
    cleaned = df.withColumn("_clean", strip_fence(F.col(col)))
    parsed = cleaned.withColumn(
        "_raw", F.from_json(F.when(F.startswith(F.col("_clean"), F.lit("{")),
                                   F.concat(F.lit('{"v":'), F.col("_clean"), F.lit(',"end":1}'))),
                            T.StructType([T.StructField("v", _RAW_SCHEMA), T.StructField("end", T.IntegerType())]),
                            {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false"}))
    # what follows the object breaks the frame around it: text behind the JSON makes all fields null
    parsed = parsed.withColumn("_raw", F.when(F.col("_raw.end") == 1, F.col("_raw.v")))
    if keys is not None:
        parsed = parsed.withColumn(keys, F.when(F.col("_raw").isNotNull(), F.json_object_keys(F.col("_clean"))))
    parsed = parsed.drop("_clean")
    number = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
    typed = F.struct(
        *[F.when(F.col("_raw")[f].rlike(number), F.col("_raw")[f].try_cast("double")).alias(f) for f in SCORE_FIELDS],
        *[F.col("_raw")[f].alias(f) for f in TEXT_FIELDS],
    )
    return parsed.withColumn(out, typed).drop("_raw")


def attach_scores(df: DataFrame, scores: str = "scores", keys: str | None = None) -> DataFrame:
    """Flatten the score struct onto the row; failed parses keep the row with null scores.

    A key of the response overrides a row column of the same name, also with an explicit
    null, if ``keys`` names the column of keys that ``parse_scores`` adds; without it a
    key overrides only when it has a value.
    """
    fields = SCORE_FIELDS + TEXT_FIELDS
    keep = [c for c in df.columns if c not in (scores, keys) and c not in fields]

    def merged(f: str) -> Column:
        value = F.col(f"{scores}.{f}")
        if f not in df.columns:
            return value
        if keys is None:
            return F.coalesce(value, F.col(f))
        return F.when(F.array_contains(F.col(keys), f), value).otherwise(F.col(f))

    return df.select(*keep, *[merged(f).alias(f) for f in fields])


def recent(df: DataFrame, days: int, ref_date: str, date_col: str = "date", enabled: bool = True) -> DataFrame:
    """Look-back filter; off by default in the reference (computed, never applied)."""
    if not enabled:
        return df
    return df.filter(F.col(date_col) >= F.date_sub(F.lit(ref_date).cast("date"), days))


def _rules() -> dict[str, Column]:
    s, i, c, h = (F.col(f) for f in SCORE_FIELDS)
    return {
        "sentiment_score": s.between(*SENTIMENT_RANGE),
        "impact_intensity": i.between(*UNIT_RANGE),
        "certainty": c.between(*UNIT_RANGE),
        "time_horizon": h.isin(*HORIZON_VALUES),
    }


def validate_scores(df: DataFrame, mode: str = "flag") -> DataFrame:
    """Range contract.  'flag' adds ``<field>_ok`` booleans (null for null input),
    'null' nulls out violations, 'clamp' clips to the range (horizon: nearest allowed; null stays null)."""
    rules = _rules()
    if mode == "flag":
        return df.withColumns({f"{f}_ok": r for f, r in rules.items()})
    if mode == "null":
        return df.withColumns({f: F.when(r, F.col(f)) for f, r in rules.items()})
    if mode == "clamp":
        h = F.col("time_horizon")
        nearest = (F.when(h >= 0.6, F.lit(0.8)).when(h >= 0.25, F.lit(0.4)).otherwise(F.lit(0.1)))

        def clip(f: str, low: float, high: float) -> Column:
            return F.when(F.col(f).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), F.col(f))))

        return df.withColumns({
            "sentiment_score": clip("sentiment_score", *SENTIMENT_RANGE),
            "impact_intensity": clip("impact_intensity", *UNIT_RANGE),
            "certainty": clip("certainty", *UNIT_RANGE),
            "time_horizon": F.when(h.isNull(), h).otherwise(nearest),
        })
    raise ValueError(mode)


def score_quality(df: DataFrame, day: str = "day") -> DataFrame:
    """Violations per day and rule (null scores count as missing, not as violations)."""
    rules = _rules()
    rows = [F.struct(F.lit(f).alias("rule"),
                     F.count_if(~r).alias("violations"),
                     F.count_if(F.col(f).isNull()).alias("missing"))
            for f, r in rules.items()]
    agg = df.groupBy(day).agg(F.count(F.lit(1)).alias("n"), *[x.alias(f"_r{k}") for k, x in enumerate(rows)])
    return agg.select(day, "n", F.explode(F.array(*[F.col(f"_r{k}") for k in range(len(rows))])).alias("_q")).select(
        day, "n", "_q.*")


def score_incremental(todo: DataFrame, sink_rows: DataFrame | None, key: str = "id") -> DataFrame:
    """Rows not yet scored (anti-join on the key against the sink)."""
    if sink_rows is None:
        return todo
    return todo.join(sink_rows.select(key), on=key, how="left_anti")
