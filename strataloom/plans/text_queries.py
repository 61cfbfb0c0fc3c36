"""Text functions and BM25 over documents, pages, conversations and benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import text as t
from strataloom.functions.tables import CODE_REFERENCE, COMMON_WORDS, COMPOUND_TERMS, KEYWORDS, OPERATOR_WORDS, PARTY_PREFIXES, RECOMMENDATION_PREFIXES
from strataloom.operators import bm25
from strataloom.plans.tables import read, spread
from strataloom.sources.shared import write_out


def tokenize_prose(spark: SparkSession, d: str) -> DataFrame:
    rows = t.token_counts(spread(read(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_distinct"))


def tokenize_code(spark: SparkSession, d: str) -> DataFrame:
    rows = t.token_counts(spread(read(spark, d, "pages").select("page_id", "html")), "page_id", "html", code=True)
    return rows.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("n_pages"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    urls = read(spark, d, "pages").select(F.explode(F.split("url", "[^A-Za-z0-9_]+")).alias("word"))
    names = read(spark, d, "customer").select(F.explode(F.split("c_name", "[^A-Za-z0-9_]+")).alias("word"))
    types = read(spark, d, "part").select(F.explode(F.split("p_type", "[^A-Za-z0-9_]+")).alias("word"))
    return urls.union(names).union(types).filter("word != ''").distinct()


_WORDS_SQL = "(select distinct word from (select unnest(regexp_split_to_array(url, '[^A-Za-z0-9_]+')) as word from pages union all select unnest(regexp_split_to_array(c_name, '[^A-Za-z0-9_]+')) from customer union all select unnest(regexp_split_to_array(p_type, '[^A-Za-z0-9_]+')) from part) where word <> '')"


def identifier_split(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).select("word", F.array_join(t.split_identifier(F.col("word")), " ").alias("parts"))


def abbrev_expand(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).select("word", t.expand_abbreviation(F.lower("word")).alias("expanded"))


def _prose_words(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z0-9_]+")).alias("l")).filter("l != ''").distinct()


def porter_stem(spark: SparkSession, d: str) -> DataFrame:
    return _prose_words(spark, d).select("l", t.stem(F.col("l")).alias("token"))


def operator_expand(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.md5(t.expand_operators(t.expand_compounds(F.col("html"))).cast("binary")).alias("expanded_md5"))


def code_references(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.explode(t.code_references(F.col("url"))).alias("reference")).groupBy("page_id", "reference").agg(F.count("*").alias("n"))


def code_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = read(spark, d, "pages").select("page_id", t.code_spans(F.col("url")).alias("s"))
    return spans.select("page_id", F.size("s").alias("n_spans"), F.size(F.filter("s", lambda x: x["is_code"])).alias("n_code"), F.array_join(F.transform("s", lambda x: x["value"]), "").alias("joined"))


def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.md5(t.escape_html(F.col("html")).cast("binary")).alias("escaped_md5"))


def html_attributes(spark: SparkSession, d: str) -> DataFrame:
    tags = read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<[a-z][^>]*>"), 0)).alias("tag"))
    return tags.select(t.html_attribute(F.col("tag"), "class").alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def party_noun_flag(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    cases = c.select(F.lit("turn").alias("origin"), "text").unionByName(spark.range(len(_CASES)).select(F.lit("case").alias("origin"), F.element_at(F.array(*map(F.lit, _CASES)), (F.col("id") + 1).cast("int")).alias("text")))
    return cases.groupBy("origin").agg(F.count("*").alias("n"), F.count_if(t.starts_with_party(F.col("text"))).alias("party"), F.count_if(t.reads_as_recommendation(F.col("text"))).alias("recommendation"))


_CASES = ("An attacker drains it", "the operators agree", "the operator", " A user: none", "add a check", "Use it", "useful", "wrap in try", "A malicious call", "the contracted", "Ensure by test", "attackers")


def keyword_flags(spark: SparkSession, d: str) -> DataFrame:
    return _prose_words(spark, d).select("l", t.is_keyword(F.col("l")).alias("keyword"), t.is_common_word(F.col("l")).alias("common"))


def path_normalize(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/root/x/./a/../"), F.regexp_replace("url", "^https?://", ""))
    return read(spark, d, "pages").select("page_id", t.normalize_path(path, "/root/x").alias("path"))


def plain_comments(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.lit("**see** `a_b` and [it](http://x/y) *now* "), F.col("text"))
    return read(spark, d, "conversations").select("conv_id", "turn", F.md5(t.plain_text(marked).cast("binary")).alias("plain_md5"))


def _doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    counted = t.token_counts(spread(read(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    return bm25.with_lengths(counted.withColumnRenamed("n", "f"), "doc_id")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return t.tokens(read(spark, d, "benchmark"), "item_id", "text")


def bm25_top10(spark: SparkSession, d: str) -> DataFrame:
    scored = bm25.scores(_queries(spark, d), _doc_tokens(spark, d), query="item_id", doc="doc_id")
    return bm25.top_k(scored, by=["item_id"], doc="doc_id").select("item_id", "doc_id", "score", "rank")


def bm25_by_source(spark: SparkSession, d: str) -> DataFrame:
    """The two-step form: candidates inside each (item, source), as members inside a contract."""
    scored = bm25.scores(_queries(spark, d), _doc_tokens(spark, d), query="item_id", doc="doc_id")
    inside = bm25.by_contract(read(spark, d, "documents").select("doc_id", "source"), scored, doc="doc_id")
    return bm25.top_k(inside, by=["item_id", "source"], doc="doc_id", k=2).select("item_id", "source", "doc_id", "score", "rank")


def bm25_doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.corpus_stats(_doc_tokens(spark, d), "doc_id").select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    counts = write_out(_doc_tokens(spark, d), "counts")
    df = counts.join(_queries(spark, d).select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    stats = bm25.corpus_stats(counts, "doc_id")
    return df.crossJoin(F.broadcast(stats)).select("token", "df", F.round(bm25.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def bm25_floor_effect(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose length is raised to the floor."""
    counts = write_out(_doc_tokens(spark, d).select("doc_id", "dl").distinct(), "lengths")
    lengths = counts.crossJoin(F.broadcast(bm25.corpus_stats(counts, "doc_id")))
    return lengths.filter(F.col("dl") < F.col("avgdl") * bm25.LENGTH_FLOOR).select("doc_id", "dl", F.round(F.col("avgdl") * bm25.LENGTH_FLOOR, 6).alias("effective_dl"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\.")).alias("pos", "sentence"))
    return s.filter("trim(sentence) != ''").groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("sentence")).alias("longest"))


_BM25_SQL = f"""
toks as {t.tokens_sql('documents', 'doc_id', 'text')},
counts as (select doc_id, token, count(*) as f, (sum(count(*)) over (partition by doc_id))::bigint as dl from toks group by doc_id, token),
stats as (select count(*) as n, avg(dl) as avgdl from (select distinct doc_id, dl from counts)),
asked as (select item_id, token, count(*) as times from {t.tokens_sql('benchmark', 'item_id', 'text')} group by item_id, token),
df as (select token, count(*) as df from counts where token in (select token from asked) group by token),
scored as (select item_id, doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1.0) * (f * 2.2) / (f + 1.2 * (1.0 - 0.75 + 0.75 * greatest(dl, avgdl * 0.75) / avgdl))), 6) as score
  from counts join asked using (token) join df using (token), stats group by item_id, doc_id)
"""
_PARTY = f"^(?:{'|'.join(PARTY_PREFIXES)})(?:[^\\p{{L}}\\p{{N}}_]|$)"
_RECOMMEND = " or ".join(f"starts_with(lower(ltrim(text)), '{p}')" for p in RECOMMENDATION_PREFIXES)
_PROSE_WORDS_SQL = "(select distinct l from (select unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) as l from benchmark) where l <> '')"

QUERIES = {f.__name__: f for f in (tokenize_prose, tokenize_code, identifier_split, abbrev_expand, porter_stem, operator_expand, code_references, code_spans, html_escape, html_attributes, party_noun_flag, keyword_flags, path_normalize, plain_comments, bm25_top10, bm25_by_source, bm25_doc_stats, bm25_idf, bm25_floor_effect, sentences)}
SQL = {
    "tokenize_prose": f"select doc_id, count(*) as n_tokens, count(distinct token) as n_distinct from {t.tokens_sql('documents', 'doc_id', 'text')} group by doc_id",
    "tokenize_code": f"select token, count(*) as n, count(distinct page_id) as n_pages from {t.tokens_sql('pages', 'page_id', 'html', code=True)} group by token",
    "identifier_split": f"select word, array_to_string({t.split_sql('bare')}, ' ') as parts from (select word, regexp_replace(word, '^_+', '') as bare from {_WORDS_SQL})",
    "abbrev_expand": f"select word, {t.abbreviation_sql('lower(word)')} as expanded from {_WORDS_SQL}",
    "porter_stem": f"select l, token from {t.stem_sql(_PROSE_WORDS_SQL)}",
    "operator_expand": f"select page_id, md5({t.replace_sql(t.replace_sql('html', COMPOUND_TERMS), OPERATOR_WORDS)}) as expanded_md5 from pages",
    "code_references": f"select page_id, reference, count(*) as n from (select page_id, unnest(regexp_extract_all(url, '{CODE_REFERENCE}')) as reference from pages) group by all",
    "code_spans": f"select page_id, len(s)::int as n_spans, len(list_filter(s, lambda x: starts_with(x, chr(2))))::int as n_code, replace(array_to_string(s, ''), chr(2), '') as joined from (select page_id, list_filter(string_split(regexp_replace(url, '({CODE_REFERENCE})', chr(1) || chr(2) || '\\1' || chr(1), 'g'), chr(1)), lambda x: x not in ('', chr(2))) as s from pages)",
    "html_escape": "select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) as escaped_md5 from pages",
    "html_attributes": "select value, count(*) as n from (select regexp_extract(tag, '\\bclass=\"([^\"]*)\"', 1) as value from (select unnest(regexp_extract_all(html, '<[a-z][^>]*>')) as tag from pages)) where value <> '' group by value",
    "party_noun_flag": "with cases as (select 'turn' as origin, text from conversations union all select 'case', unnest([" + ", ".join(f"'{x}'" for x in _CASES) + f"])) select origin, count(*) as n, count(*) filter (regexp_matches(lower(ltrim(text)), '{_PARTY}')) as party, count(*) filter ({_RECOMMEND}) as recommendation from cases group by origin",
    "keyword_flags": f"select l, l in ({', '.join(repr(k) for k in KEYWORDS)}) as keyword, l in ({', '.join(repr(k) for k in COMMON_WORDS)}) as common from {_PROSE_WORDS_SQL}",
    "path_normalize": "select page_id, array_to_string(list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: x not in ('', '.')), '/') as path from pages",
    "plain_comments": "select conv_id, turn, md5('see a_b and it now ' || text) as plain_md5 from conversations",
    "bm25_top10": f"with {_BM25_SQL} select * from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scored where score >= 1.0) where rank <= 10",
    "bm25_by_source": f"with {_BM25_SQL} select * from (select item_id, source, doc_id, score, row_number() over (partition by item_id, source order by score desc, doc_id)::int as rank from scored join (select doc_id, source from documents) using (doc_id) where score >= 1.0) where rank <= 2",
    "bm25_doc_stats": f"with {_BM25_SQL} select n, round(avgdl, 6) as avgdl from stats",
    "bm25_idf": f"with {_BM25_SQL} select token, df, round(ln((n - df + 0.5) / (df + 0.5) + 1.0), 6) as idf from df, stats",
    "bm25_floor_effect": f"with {_BM25_SQL} select doc_id, dl, round(avgdl * 0.75, 6) as effective_dl from (select distinct doc_id, dl from counts), stats where dl < avgdl * 0.75",
    "sentences": "select doc_id, count(*) as n_sentences, max(length(sentence)) as longest from (select doc_id, unnest(string_split(text, '.')) as sentence from documents) where trim(sentence) <> '' group by doc_id",
}
