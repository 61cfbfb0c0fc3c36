"""Code-aware text functions as column expressions and row tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.tables import ABBREVIATIONS, CODE_OPERATORS, CODE_REFERENCE, COMMON_WORDS, COMPOUND_TERMS, KEYWORDS, OPERATOR_WORDS, PARTY_PREFIXES, RECOMMENDATION_PREFIXES, STOP_WORDS
from strataloom.sources.shared import write_out


def _replace_all(c: Column, table: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), table, c)


def expand_compounds(c: Column) -> Column:
    return _replace_all(c, COMPOUND_TERMS)


def expand_operators(c: Column) -> Column:
    return _replace_all(c, OPERATOR_WORDS)


def split_identifier(c: Column) -> Column:
    """Parts of one identifier: camel, snake, letter/digit and acronym borders; an upper-case word with digits stays whole."""
    bare = F.regexp_replace(c, "^_+", "")
    whole = bare.rlike("^[A-Z0-9]+$") & bare.rlike("[A-Z]") & bare.rlike("[0-9]")
    cut = bare
    for pattern in ("([a-z])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        cut = F.regexp_replace(cut, pattern, "$1 $2")
    parts = F.filter(F.split(cut, "[ _]+"), lambda x: x != "")
    return F.when(bare == "", F.array().cast("array<string>")).when(whole | bare.rlike("^[a-z]+$"), F.array(bare)).otherwise(parts)


def expand_abbreviation(c: Column) -> Column:
    """Of a lower-case word."""
    known = reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), ABBREVIATIONS.items(), F.when(F.lit(False), ""))
    return F.when(F.length(c) <= 4, F.coalesce(known, c)).otherwise(c)


# The stemming rules as (pattern, replacement), applied in this order; at most one branch of a pattern holds.
STEM_RULES = (
    ("(ss|i)es$", "{1}"),
    ("^(.+[^s])s$", "{1}"),
    ("^(..+ee)d$|^(..+)ed$|^(..+)ing$", "{1}{2}{3}"),
    ("^(.+[b-df-hj-np-tv-z])y$", "{1}i"),
)


def stem(c: Column) -> Column:
    """Plural, verb ending and y after a consonant; nothing else is cut."""
    return reduce(lambda acc, r: F.regexp_replace(acc, r[0], r[1].replace("{", "$").replace("}", "")), STEM_RULES, c)


#: Words up to this number are broadcast with their tokens; counted first.
BROADCAST_WORDS = 1_000_000


def _words(df: DataFrame, keys: list[str], text: str, code: bool) -> DataFrame:
    source = expand_operators(expand_compounds(F.col(text))) if code else F.col(text)
    return df.select(*keys, F.explode(F.split(source, "[^A-Za-z0-9_]+")).alias("_w")).filter("_w != ''")


def tokens(df: DataFrame, key: str | list[str], text: str, *, code: bool = False) -> DataFrame:
    """(key..., token): one row for each token of each row's text, in no order; empty texts give none."""
    keys = [key] if isinstance(key, str) else key
    return _tokens_of(_words(df, keys, text, code), keys)


def token_counts(df: DataFrame, key: str | list[str], text: str, *, code: bool = False) -> DataFrame:
    """(key..., token, n): the tokens of each row's text counted.

    Words are counted first, and a word is cut to tokens once for all texts: the
    regular expressions run over the distinct words, not over every word.
    """
    keys = [key] if isinstance(key, str) else key
    counted = write_out(_words(df, keys, text, code).groupBy(*keys, "_w").agg(F.count("*").alias("_n")), "words")
    words = counted.select("_w").distinct()
    cut = write_out(_tokens_of(words.select("_w", F.col("_w").alias("_word")), ["_word"]), "tokens")
    cut = F.broadcast(cut) if cut.count() <= BROADCAST_WORDS else cut
    # dealt out by key, so what is grouped or ranked by key after this moves no more
    rows = counted.join(cut, F.col("_w") == F.col("_word")).select(*keys, "token", "_n").repartition(*keys)
    return rows.groupBy(*keys, "token").agg(F.sum("_n").alias("n"))


def _tokens_of(words: DataFrame, keys: list[str]) -> DataFrame:
    """The steps are separate projections, so each regular expression runs once a word, and most words (lower-case letters only) skip the identifier split."""
    parts = words.select(*keys, F.explode(split_identifier(F.col("_w"))).alias("_p"))
    known = parts.select(*keys, expand_abbreviation(F.lower("_p")).alias("_l")).filter(~F.col("_l").isin(*STOP_WORDS))
    out = known.select(*keys, stem(F.col("_l")).alias("token"))
    return out.filter((F.length("token") >= 2) | F.col("token").rlike("^[0-9]*$"))


def code_references(c: Column) -> Column:
    """array<string> of identifiers in prose."""
    return F.regexp_extract_all(c, F.lit(CODE_REFERENCE), 0)


def code_spans(c: Column) -> Column:
    """array<struct<is_code, value>>: text cut at its code references, empty spans dropped."""
    marked = F.regexp_replace(c, f"({CODE_REFERENCE})", "\u0001\u0002$1\u0001")
    return F.transform(F.filter(F.split(marked, "\u0001"), lambda x: ~x.isin("", "\u0002")), lambda x: F.struct(x.startswith("\u0002").alias("is_code"), F.replace(x, F.lit("\u0002"), F.lit("")).alias("value")))


def is_keyword(c: Column) -> Column:
    return c.isin(*KEYWORDS)


def is_common_word(c: Column) -> Column:
    return c.isin(*COMMON_WORDS)


def leading_operator(c: Column) -> Column:
    """The longest operator that the text begins with; null if none."""
    found = reduce(lambda acc, op: acc.when(c.startswith(op), op), CODE_OPERATORS, F.when(F.lit(False), ""))
    return found


def starts_with_party(c: Column) -> Column:
    return F.lower(F.ltrim(c)).rlike(f"^(?:{'|'.join(PARTY_PREFIXES)})(?:[^\\p{{L}}\\p{{N}}_]|$)")


def reads_as_recommendation(c: Column) -> Column:
    return reduce(lambda acc, p: acc | F.lower(F.ltrim(c)).startswith(p), RECOMMENDATION_PREFIXES, F.lit(False))


def escape_html(c: Column) -> Column:
    return _replace_all(c, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")))


def html_attribute(tag: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(tag, f'\\b{name}="([^"]*)"', 1), F.lit(""))


def truncate(c: Column, n: int) -> Column:
    return F.left(F.trim(c), F.lit(n))


def normalize_path(c: Column, root: str = "") -> Column:
    """Strip the root and './', fold '..'."""
    inner = F.regexp_replace(c, "^" + root.rstrip("/") + "/", "") if root else c
    parts = F.filter(F.split(inner, "/+"), lambda x: ~x.isin("", "."))
    empty = F.expr("cast(array() as array<string>)")
    folded = F.aggregate(parts, empty, lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(folded, "/")


def inline_spans(c: Column) -> Column:
    """array<struct<kind, value, target>> of a comment: `code`, **bold**, *italic*, [text](url) and plain text between."""
    pattern = r"`[^`]+`|\*\*[^*]+\*\*|\*[^*]+\*|\[[^\]]+\]\([^)]*\)"
    pieces = F.filter(F.split(F.regexp_replace(c, f"({pattern})", "\u0001$1\u0001"), "\u0001"), lambda x: x != "")

    def span(x: Column) -> Column:
        kind = F.when(x.rlike("^`[^`]+`$"), "code").when(x.rlike(r"^\*\*[^*]+\*\*$"), "bold").when(x.rlike(r"^\*[^*]+\*$"), "italic").when(x.rlike(r"^\[[^\]]+\]\([^)]*\)$"), "link").otherwise("text")
        value = F.when(kind == "code", F.regexp_extract(x, "^`([^`]+)`$", 1)).when(kind == "bold", F.regexp_extract(x, r"^\*\*([^*]+)\*\*$", 1)).when(kind == "italic", F.regexp_extract(x, r"^\*([^*]+)\*$", 1)).when(kind == "link", F.regexp_extract(x, r"^\[([^\]]+)\]", 1)).otherwise(x)
        return F.struct(kind.alias("kind"), value.alias("value"), F.when(kind == "link", F.regexp_extract(x, r"\(([^)]*)\)$", 1)).alias("target"))

    return F.transform(pieces, span)


def plain_text(c: Column) -> Column:
    """A comment's surface text: marks and link targets are dropped."""
    return F.array_join(F.transform(inline_spans(c), lambda s: s["value"]), "")


# --- the same steps in portable SQL, for checks -------------------------------------------------


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def replace_sql(expr: str, table) -> str:
    return reduce(lambda acc, kv: f"replace({acc}, '{kv[0]}', '{kv[1]}')", table, expr)


def split_sql(word: str) -> str:
    cut = word
    for pattern in ("([a-z])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        cut = f"regexp_replace({cut}, '{pattern}', '\\1 \\2', 'g')"
    return f"case when regexp_matches({word}, '^[A-Z0-9]+$') and regexp_matches({word}, '[A-Z]') and regexp_matches({word}, '[0-9]') then [{word}] else list_filter(regexp_split_to_array({cut}, '[ _]+'), lambda x: x <> '') end"


def abbreviation_sql(word: str) -> str:
    return f"case {word} " + " ".join(f"when '{k}' then '{v}'" for k, v in ABBREVIATIONS.items()) + f" else {word} end"


def stem_sql(rel: str) -> str:
    """A query over rel(..., l) that adds `token`."""
    chain = reduce(lambda acc, r: f"regexp_replace({acc}, '{r[0]}', '{r[1].replace('{', chr(92)).replace('}', '')}')", STEM_RULES, "l")
    return f"(select *, {chain} as token from {rel})"


def tokens_sql(rel: str, key: str, text: str, *, code: bool = False) -> str:
    """A query that yields (key, token) rows like tokens()."""
    source = replace_sql(replace_sql(text, COMPOUND_TERMS), OPERATOR_WORDS) if code else text
    lowered = f"""(select {key}, l from (select {key}, {abbreviation_sql('lower(p)')} as l from (
      select {key}, unnest({split_sql('w')}) as p from (
        select {key}, regexp_replace(w, '^_+', '') as w from (select {key}, unnest(regexp_split_to_array({source}, '[^A-Za-z0-9_]+')) as w from {rel})) where w <> ''))
      where l not in ({_quoted(STOP_WORDS)}))"""
    return f"(select {key}, token from {stem_sql(lowered)} where length(token) >= 2 or regexp_matches(token, '^[0-9]*$'))"
