"""Text normalization, parsing and rendering as column expressions."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
LEGAL_SUFFIX = r"(?i)\b(inc|llc|ltd|limited|corp|corporation|gmbh|s\.a\.|plc|co)\b\.?"
STOP_TERMS = [
    "the", "and", "for", "with", "that", "this", "from", "are", "was", "its", "such", "using", "into", "each", "which", "they", "their", "them", "have",
    "learning", "data", "main", "types", "three",
]
VERDICTS = ["CONTRADICTED", "UNSUPPORTED", "SUPPORTED"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def nfkc(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility composition: Spark has no function for it."""
    for s in it:
        yield s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t), na_action=None)


@F.pandas_udf(T.StringType())
def fold_ascii(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition, then ASCII only."""
    for s in it:
        yield s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action=None)


def clean_text(text: Column | str, preserve_layout: bool = True, compose: bool = True) -> Column:
    """Normalized text; null is empty. compose=False leaves out the Unicode step, and with it Python."""
    t = F.coalesce(_col(text), F.lit(""))
    for ligature, letters in LIGATURES.items():
        t = F.replace(t, F.lit(ligature), F.lit(letters))
    t = F.regexp_replace(t, r"(?U)([\p{L}\p{N}_])-[\s\x1c-\x1f]*\n[\s\x1c-\x1f]*([\p{L}\p{N}_])", "$1$2")  # Python's \w and \s
    t = nfkc(t) if compose else t
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    if preserve_layout:
        t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\r\n?", "\n"), r"\n{3,}", "\n\n")
    else:
        t = F.regexp_replace(t, r"(?U)\s+", " ")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def token_set(text: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(_col(text)), r"(?U)\s+"), lambda x: x != ""))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two token sets; 0 if either is empty."""
    a, b = _col(a), _col(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def estimate_tokens(text: Column | str) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(_col(text)) / 4))


def terms(text: Column | str) -> Column:
    """The lexical analyzer: lower case, runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit("([a-z0-9]+)"), F.lit(1))


def canonicalize(name: Column | str, fold: bool = True) -> Column:
    n = _col(name)
    n = F.lower(fold_ascii(n) if fold else n)
    n = F.regexp_replace(n, LEGAL_SUFFIX, "")
    return F.trim(F.regexp_replace(F.regexp_replace(n, r"[^a-z0-9\s]", " "), r"\s+", " "))


def resolve_aliases(names: DataFrame, aliases: DataFrame, name_col: str = "name", fold: bool = True) -> DataFrame:
    """Adds ``resolved``: aliases(alias, target) with both sides canonical, one level only."""
    table = aliases.select(canonicalize("alias", fold).alias("__a"), canonicalize("target", fold).alias("__t")).groupBy("__a").agg(F.max("__t").alias("__t"))
    keyed = names.withColumn("__k", canonicalize(name_col, fold))
    return keyed.join(table, keyed["__k"] == table["__a"], "left").withColumn("resolved", F.coalesce("__t", "__k")).drop("__a", "__t", "__k")


def split_sentences(text: Column | str, before_capital: bool = False) -> Column:
    """At white space behind . ! or ?; before_capital: only before A-Z, as chunking does."""
    pattern = r"(?U)(?<=[.!?])\s+" + ("(?=[A-Z])" if before_capital else "")
    return F.filter(F.split(F.trim(_col(text)), pattern), lambda s: F.trim(s) != "")


def citations(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(_col(text), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def parse_score(raw: Column | str, fallback: Column | str) -> Column:
    """The first number, between 0 and 10, as a share of 10; the fallback if there is none."""
    number = F.regexp_extract(_col(raw), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(number.isNull(), _col(fallback)).otherwise(F.least(F.lit(10.0), F.greatest(F.lit(0.0), number)) / 10)


def match_verdict(text: Column | str) -> Column:
    """CONTRADICTED before UNSUPPORTED before SUPPORTED, as whole words; null if none."""
    up, out = F.upper(_col(text)), F.lit(None).cast("string")
    for verdict in reversed(VERDICTS):
        out = F.when(up.rlike(rf"\b{verdict}\b"), verdict).otherwise(out)
    return out


def json_array(raw: Column | str) -> Column:
    """The strings of the first [ to the last ], if that is a JSON array; else null."""
    return F.from_json(F.regexp_extract(_col(raw), r"(?s)(\[.*\])", 1), "array<string>")


def json_object(raw: Column | str, schema: str) -> Column:
    """The first { to the last }, if that is a JSON object of the schema; else null."""
    found = F.regexp_extract(_col(raw), r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), F.from_json(found, schema))


def yes_no(raw: Column | str) -> Column:
    up = F.upper(F.trim(_col(raw)))
    return F.when(up.startswith("YES"), 1.0).when(up.startswith("NO"), 0.0)


def relation_type(raw: Column | str) -> Column:
    return F.replace(F.upper(F.trim(_col(raw))), F.lit(" "), F.lit("_"))


def truncate(text: Column | str, n: int) -> Column:
    return F.substring(_col(text), 1, n)


def numbered_blocks(results: Column | str) -> Column:
    """Blocks ``[i] (relevance s)`` over the content, from an array of (content, score) in order; scores between two of three places to the even one."""
    told = lambda s: F.when(s * 16 == F.floor(s * 16), F.bround(s, 3)).otherwise(s)  # noqa: E731 - only sixteenths are exactly between
    blocks = F.transform(_col(results), lambda r, i: F.format_string("[%d] (relevance %.3f)\n%s", i + 1, told(r["score"]), r["content"]))
    return F.array_join(blocks, "\n\n")


def triple_sentence(src: Column | str, rel: Column | str, dst: Column | str, evidence: Column | str) -> Column:
    said = F.concat(_col(src), F.lit(" "), F.lower(F.replace(_col(rel), F.lit("_"), F.lit(" "))), F.lit(" "), _col(dst), F.lit("."))
    return F.concat(said, F.when(F.coalesce(_col(evidence), F.lit("")) != "", F.concat(F.lit(' Supporting text: "'), _col(evidence), F.lit('"'))).otherwise(""))


def triple(src: Column | str, rel: Column | str, dst: Column | str) -> Column:
    return F.concat(_col(src), F.lit(" -["), _col(rel), F.lit("]-> "), _col(dst))


def render_graph(triples: Column | str, quotes: Column | str, max_triples: int = 40, max_quotes: int = 10) -> Column:
    lines = F.array_join(F.transform(F.slice(_col(triples), 1, max_triples), lambda t: F.concat(F.lit("- "), t)), "\n")
    said = F.array_join(F.transform(F.slice(_col(quotes), 1, max_quotes), lambda q: F.concat(F.lit('"'), q, F.lit('"'))), "\n")
    return F.concat(F.lit("Graph facts:\n"), lines, F.when(said != "", F.concat(F.lit("\nQuotes:\n"), said)).otherwise(""))


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio; for few pairs, after a filter by length (see graph.link_mentions)."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def capitalized_mentions(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(r"(?U)\b[A-Z][\w.-]*(?:\s+[A-Z][\w.-]*)*"), F.lit(0))


def distinctive_terms(text: Column | str, minimum: int = 4) -> Column:
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit(f"([a-z]{{{minimum},}})"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP_TERMS]))


#: Our own wording of the prompts; each is filled by name.
TEMPLATES = {
    "answer": "Use only the numbered evidence. Cite it as [n]. Say INSUFFICIENT if it does not answer.\n\n{context}\n\nQuestion: {question}",
    "condense": "Rewrite the last question so that it stands alone.\n\n{history}\n\nQuestion: {question}",
    "variants": "Write {n} other ways to ask this, one per line.\n\n{question}",
    "hypothetical": "Write a short passage that would answer this.\n\n{question}",
    "classify": "Name the kind of question: factual, conceptual, comparative, relational or aggregate.\n\n{question}",
    "score": "Rate from 0 to 10 how well the passage answers.\n\nQuestion: {question}\n\nPassage: {passage}",
    "claims": "List the claims of this answer as a JSON array of strings.\n\n{answer}",
    "verdict": "Is the claim SUPPORTED, UNSUPPORTED or CONTRADICTED by the context?\n\n{context}\n\nClaim: {claim}",
    "relevant": "Does the answer address the question? YES or NO.\n\nQuestion: {question}\n\nAnswer: {answer}",
    "extract": "Give entities and relationships of the text as a JSON object.\n\n{text}",
    "mentions": "List the entities in the question as a JSON array of strings.\n\n{question}",
    "evaluate": 'Is the evidence enough? Answer as JSON: {{"sufficient": bool, "next_query": string}}\n\n{context}\n\nQuestion: {question}',
}


def fill_template(name: str, **columns: Column | str) -> Column:
    """A template with {field} replaced by columns, and doubled braces by single ones."""
    text = F.lit(TEMPLATES[name].replace("{{", "\x01").replace("}}", "\x02"))
    for field, value in columns.items():
        text = F.replace(text, F.lit("{" + field + "}"), F.coalesce(_col(value).cast("string"), F.lit("")))
    return F.translate(text, "\x01\x02", "{}")


def loads_or_none(raw: str | None) -> object:
    try:
        return json.loads(raw) if raw else None
    except ValueError:
        return None
