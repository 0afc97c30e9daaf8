"""Text columns: a ladder of normal forms, quotes located on pages, numbers verified against a report."""

from __future__ import annotations

import difflib
import json
import math
import re
import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed lists: ligatures, curly quotes and dashes that are only typography.  Primes, Greek letters and operators are
#: content and stay.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"'}
DASHES = "‐‑‒–—―⁃−"

LEVELS = ("L0", "L1", "L2")
_WORD = r"[\p{L}\p{N}_]"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def normalise(text: Column, level: str = "L1", compatibility: bool = True) -> Column:
    """L0: as it is.  L1: compatibility forms, then ligatures, curly quotes and dashes as plain characters, white space
    collapsed, no blank before closing punctuation.  L2: L1, and words that a hyphen and white space break are joined.
    Each level changes nothing more when it is applied again."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}")
    if level == "L0":
        return text
    out = nfkc(text) if compatibility else text
    for k, v in LIGATURES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    out = F.translate(out, "".join(QUOTES) + DASHES, "".join(QUOTES.values()) + "-" * len(DASHES))
    out = F.trim(F.regexp_replace(collapse(out), r" +(?=[.,;:)])", ""))
    return F.regexp_replace(out, rf"(?<={_WORD})- +(?={_WORD})", "") if level == "L2" else out


def locate_quotes(pages: DataFrame, quotes: DataFrame, doc: str, page: str, text: str, quote_id: str, quote: str) -> DataFrame:
    """Each quote with the first page that has it: (quote_id, doc, page, seam).

    A quote on one page wins over one across the seam of two pages; a quote that is empty or nowhere gets nulls.
    Quotes meet the pages of the document that they name in a ``doc`` column of their own, so it is an equi-join.
    """
    pages = pages.select(doc, page, text, F.lead(text).over(Window.partitionBy(doc).orderBy(page)).alias("after"))
    both = quotes.filter(F.length(quote) > 0).join(pages, doc)
    whole = F.instr(F.col(text), F.col(quote)) > 0
    seam = F.instr(F.concat_ws(" ", text, "after"), F.col(quote)) > 0
    found = both.select(quote_id, doc, page, F.when(whole, 0).when(seam, 1).alias("kind")).filter("kind is not null")
    best = found.groupBy(quote_id, doc).agg(F.min(F.struct("kind", page)).alias("best"))
    return quotes.select(quote_id, doc).join(best, [quote_id, doc], "left").select(quote_id, doc, F.col(f"best.{page}").alias(page), (F.col("best.kind") == 1).alias("seam"))


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching blocks' share of two strings, 0 to 1; null if either is."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def common_block(a: pd.Series, b: pd.Series) -> pd.Series:
    """The longest block that two strings share, the first of equals."""

    def find(x: str, y: str) -> str:
        m = difflib.SequenceMatcher(None, x, y, autojunk=False).find_longest_match()
        return x[m.a : m.a + m.size]

    return pd.Series([None if x is None or y is None else find(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def _window(page: pd.Series, quote: pd.Series) -> pd.Series:
    def cut(text: str, wanted: str) -> str:
        width = len(wanted) + 40
        m = difflib.SequenceMatcher(None, text, wanted, autojunk=False).find_longest_match()
        return text[max(0, m.a - 10) : m.a + width] if m.size else text[:width]

    return pd.Series([None if x is None or y is None else cut(x, y) for x, y in zip(page, quote, strict=True)])


def nearest_window(page: Column, quote: Column) -> Column:
    """The part of a page around the longest block that it shares with a quote, the quote's length and 40 characters; the
    page's head if they share none.  It shows why a quote isn't found."""
    return _window(page, quote)


_SPAN = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def _best_span(text: str, wanted: str, anchor: int) -> tuple[float, int, int] | None:
    """The span of ``text`` between its first and last block in common with ``wanted``, near their longest one."""
    m = difflib.SequenceMatcher(None, text, wanted, autojunk=False).find_longest_match()
    if m.size < anchor:
        return None
    slack = max(32, len(wanted) // 4)
    low = max(0, m.a - m.b - slack)
    near = text[low : m.a + len(wanted) - m.b + slack]
    blocks = [b for b in difflib.SequenceMatcher(None, near, wanted, autojunk=False).get_matching_blocks() if b.size]
    start, end = low + blocks[0].a, low + blocks[-1].a + blocks[-1].size
    return difflib.SequenceMatcher(None, text[start:end], wanted, autojunk=False).ratio(), start, end


def relocate(pages: DataFrame, quotes: DataFrame, doc: str, page: str, text: str, quote_id: str, quote: str, bar: float, least_chars: int = 20, anchor: int = 10) -> DataFrame:
    """Each quote with method (exact, relocated, rejected), reason, page, seam, start, end (in the page's L1 form, or that
    of two pages with a blank between), score and runner_up.

    Both sides are compared in their L1 forms.  A quote that is there is exact.  Others of ``least_chars`` or more meet
    the pages of their document, and pairs of neighbouring pages, that share a block of ``anchor`` characters; the best
    span counts if its ratio is ``bar`` or more.  Of equal scores the first page, the first place and a single page win;
    a pair's span that lies on one page alone isn't another place.  Quotes meet only their own document's pages."""
    forms = pages.select(F.col(doc).alias("__doc__"), F.col(page).alias("__page__"), normalise(F.col(text), "L1").alias("__t__"))
    forms = forms.withColumn("__after__", F.lead("__t__").over(Window.partitionBy("__doc__").orderBy("__page__")))
    wanted = quotes.select(F.col(quote_id).alias("__id__"), F.col(doc).alias("__doc__"), normalise(F.col(quote), "L1").alias("__q__"))
    one = forms.select("__doc__", "__page__", F.lit(False).alias("seam"), "__t__", F.lit(None).cast("int").alias("__cut__"))
    two = forms.filter("__after__ is not null").select("__doc__", "__page__", F.lit(True).alias("seam"), F.concat_ws(" ", "__t__", "__after__").alias("__t__"), F.length("__t__").alias("__cut__"))
    both = wanted.filter("__q__ <> ''").join(one.unionByName(two), "__doc__")
    inside = (F.col("start") < F.col("__cut__")) & (F.col("end") > F.col("__cut__") + 1)
    exact = both.withColumn("start", F.instr(F.col("__t__"), F.col("__q__")) - 1).filter("start >= 0").withColumn("end", F.col("start") + F.length("__q__")).filter(~F.col("seam") | inside)
    exact = exact.groupBy("__id__").agg(F.min(F.struct("seam", "__page__", "start", "end")).alias("__x__"))

    @F.pandas_udf(_SPAN)
    def span(there: pd.Series, asked: pd.Series) -> pd.DataFrame:
        rows = [_best_span(x, y, anchor) or (None, None, None) for x, y in zip(there, asked, strict=True)]
        return pd.DataFrame(rows, columns=["score", "start", "end"]).astype({"start": "Int32", "end": "Int32"})

    open_ = both.join(exact.select("__id__"), "__id__", "left_anti").filter(F.length("__q__") >= least_chars)
    scored = open_.withColumn("s", span(F.col("__t__"), F.col("__q__"))).select("__id__", "__page__", "seam", "__cut__", "s.*").filter("score is not null").filter(~F.col("seam") | inside)
    order = Window.partitionBy("__id__").orderBy(F.desc("score"), "__page__", "start", "seam")
    scored = scored.withColumns({"__n__": F.row_number().over(order), "runner_up": F.coalesce(F.lead("score").over(order), F.lit(0.0))}).filter("__n__ = 1")
    scored = scored.select("__id__", F.struct("__page__", "seam", "start", "end", "score", "runner_up").alias("__s__"))
    out = wanted.join(exact, "__id__", "left").join(scored, "__id__", "left")
    reason = (
        F.when(F.coalesce(F.col("__q__"), F.lit("")) == "", "empty_quote").when(F.col("__x__").isNotNull(), "exact_match").when(F.length("__q__") < least_chars, "too_short")
        .when(F.col("__s__").isNull(), "no_anchor").when(F.col("__s__.score") < bar, "below_bar").otherwise("accepted_at_bar")
    )
    out = out.withColumn("reason", reason)
    out = out.withColumn("method", F.when(F.col("reason") == "exact_match", "exact").when(F.col("reason") == "accepted_at_bar", "relocated").otherwise("rejected"))
    place = lambda n: F.when(F.col("method") == "exact", F.col(f"__x__.{n}")).when(F.col("method") == "relocated", F.col(f"__s__.{n}"))
    score = F.when(F.col("method") == "exact", 1.0).otherwise(F.coalesce("__s__.score", F.lit(0.0)))
    return out.select(
        F.col("__id__").alias(quote_id), F.col("__doc__").alias(doc), "method", "reason", place("__page__").alias(page), *[place(n).alias(n) for n in ("seam", "start", "end")],
        score.alias("score"), F.coalesce("__s__.runner_up", F.lit(0.0)).alias("runner_up"),
    )


def value_form(value: Column, kind: str) -> Column:
    """The form in which a field's values are compared, null where it has none.  ``token``: small letters, runs of blanks
    and hyphens as one underscore, none at the ends.  ``int``: the whole number at its start, if it has no fraction of
    its own.  ``month``: yyyy-MM with a real month.  ``int_set``: the distinct whole numbers of a JSON list, sorted."""
    plain = F.trim(value)
    if kind == "token":
        return F.regexp_replace(F.regexp_replace(F.lower(plain), r"(?U)[\s-]+", "_"), "^_+|_+$", "")
    if kind == "int":
        whole = F.regexp_replace(plain, r"^(-?\d+)\.0+$", "$1")
        return F.when(~whole.rlike(r"^-?\d+\.\d"), F.nullif(F.regexp_extract(whole, r"^(-?\d+)", 1), F.lit(""))).try_cast("bigint").cast("string")
    if kind == "month":
        return F.when(plain.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$"), plain)
    if kind == "int_set":
        numbers = F.from_json(plain, "array<bigint>")
        return F.when(plain.rlike(r"^\[\s*-?\d+(\s*,\s*-?\d+)*\s*\]$"), F.concat_ws(",", F.array_sort(F.array_distinct(numbers))))
    raise ValueError(f"unknown kind {kind!r}")


def compare_values(expected: Column, found: Column, kind: str) -> Column:
    """(match, status) of two values of a field: match is null where they can't be compared.  Prose has no policy; a value
    that is there and has no form is ``expected_unnormalisable`` or ``found_unnormalisable``; two missing values match,
    one missing is a mismatch."""
    if kind == "prose":
        return F.struct(F.lit(None).cast("boolean").alias("match"), F.lit("no_policy").alias("status"))
    a, b = value_form(expected, kind), value_form(found, kind)
    status = F.when(expected.isNotNull() & a.isNull(), "expected_unnormalisable").when(found.isNotNull() & b.isNull(), "found_unnormalisable").otherwise("comparable")
    return F.struct(F.when(status == "comparable", a.eqNullSafe(b)).alias("match"), status.alias("status"))


_MISS = object()


def _at(doc: object, pointer: str) -> object:
    if pointer == "":
        return doc
    if not pointer.startswith("/"):
        return _MISS
    for token in (t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/")[1:]):
        if isinstance(doc, dict) and token in doc:
            doc = doc[token]
        elif isinstance(doc, list) and re.fullmatch("0|[1-9][0-9]*", token) and int(token) < len(doc):
            doc = doc[int(token)]
        else:
            return _MISS
    return doc


def _lookup(text: str | None, pointer: str | None) -> tuple[bool, str | None]:
    if text is None or pointer is None:
        return False, None
    try:
        value = _at(json.loads(text), pointer)
    except ValueError:
        return False, None
    return (False, None) if value is _MISS else (True, canonical_json(value))


@F.pandas_udf(T.StructType([T.StructField("found", T.BooleanType()), T.StructField("value", T.StringType())]))
def json_at(document: pd.Series, pointer: pd.Series) -> pd.DataFrame:
    """What an RFC 6901 pointer points to in a JSON document, as canonical JSON, and whether it points to anything (a
    present null is found).  A document or pointer that is null or can't be read finds nothing."""
    return pd.DataFrame([_lookup(text, at) for text, at in zip(document, pointer, strict=True)], columns=["found", "value"])


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no blanks; numbers that aren't finite are null."""

    def plain(x: object) -> object:
        if isinstance(x, float):
            return x if math.isfinite(x) else None
        if isinstance(x, Mapping):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list | tuple) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


#: Fixed pattern: a number that no word or dotted name runs into, with a percent sign if it has one.
NUMBER = r"(?<![\p{L}\p{N}_.])[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?%?"
#: Decimals that a number in scientific notation counts as having.
SCIENTIFIC_DECIMALS = 12


def strip_code(text: Column) -> Column:
    """Without fenced and inline code and without quoted lines."""
    out = F.regexp_replace(text, r"(?s)```.*?```", " ")
    out = F.regexp_replace(out, r"`[^`\n]*`", " ")
    return F.regexp_replace(out, r"(?m)^\s*>.*$", " ")


def number_tokens(text: Column) -> Column:
    """Numbers as they are written."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def readings(token: Column) -> Column:
    """What a number token may stand for: value and unit of its last digit, literally and, for a per cent, in hundredths."""
    plain = F.regexp_replace(token, "%", "")
    decimals = F.when(plain.rlike("[eE]"), SCIENTIFIC_DECIMALS).otherwise(F.length(F.regexp_extract(plain, r"\.([0-9]+)", 1)))
    one = lambda by: F.struct((plain.cast("double") / 10.0**by).alias("value"), F.pow(F.lit(10.0), -(decimals + by)).alias("unit"))
    return F.when(token.endswith("%"), F.array(one(0), one(2))).otherwise(F.array(one(0)))


def verified(tokens: Column, report: Column, relative: float = 1e-9) -> Column:
    """For each token whether some number of the report array is within half of its last digit's unit of a reading."""
    near = lambda r, c: F.abs(r - c["value"]) <= c["unit"] / 2 + relative * (1 + F.abs(c["value"]))
    return F.transform(tokens, lambda t: F.exists(readings(t), lambda c: F.exists(report, lambda r: near(r, c))))


def null_if_blank(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def label_key(text: Column) -> Column:
    """A label for comparing: small letters, no stars at its end, no blanks around."""
    return F.trim(F.regexp_replace(F.lower(F.trim(text)), r"\*+$", ""))
