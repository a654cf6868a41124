"""Personal data by patterns and information-theoretic sanitisation, in SQL functions alone.

Patterns find the base spans: e-mail and IP addresses, payment cards, phone
numbers. Each distinct value is a protected entity c. The words of the texts
that hold it, wherever they stand, are terms t that may reveal it. Of all N
rows, n(c), n(t) and n(c,t) hold the entity, the term, and both:

    PMI(c;t) = log2(n(c,t) N / (n(c) n(t)))      IC(c) = log2(N / n(c))

PMI reaches IC where t never occurs without c. A term discloses c if PMI is at
least ``DISCLOSURE`` x IC and at least ``LEAST_TEXTS`` different texts hold
both, so that copies of one text are no evidence. Disclosing terms in the texts
that hold the entity are spans of kind ``term``; sanitising replaces every span
by its kind. Rows are told apart by their texts' MD5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.common import materialize, table
from symloom.llm.spans import NO_SPANS, clear_of, count_of, in_order, joined, matches, replaced, span, spans_if

#: Base kinds in the order that reports list them, then the method's own.
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "term"]
_LOCAL = "[A-Za-z0-9._%+-]"
#: An address starts where its run of local characters does, or where the match before it ended.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
DISCLOSURE = 0.9
LEAST_TEXTS = 2
_WORD = r"\p{L}{3,}+"
#: The kinds that stand for base spans, which are no words, and words.
_MARK_OR_WORD = rf"<(?:EMAIL|IP|CARD|PHONE)>|{_WORD}"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_ip(s: Column) -> Column:
    parts = F.transform(F.split(s["value"], r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def _is_card(s: Column) -> Column:
    digits = _digits(s["value"])
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _is_phone(s: Column) -> Column:
    return F.length(_digits(s["value"])).between(9, 15)


def base_spans(text: Column, measure: Callable[[Column], Column] = F.length) -> Column:
    """The spans of the four base kinds by kind and start; ``text`` must not be null."""
    digits = text.rlike("[0-9]")
    email = spans_if(text.contains("@"), matches(text, "email", EMAIL, measure))
    ip = spans_if(digits & text.contains("."), F.filter(matches(text, "ip", IP, measure), _is_ip))
    card = spans_if(digits, F.filter(matches(text, "card", CARD, measure), _is_card))
    phone = spans_if(text.contains("+"), F.filter(matches(text, "phone", PHONE, measure), _is_phone))
    return F.concat(email, ip, card, phone)


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _entities(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, words) of each row; words (term, start, end) are those of texts with base spans, outside them."""
    rows = docs.select("doc_id", _text().alias("text")).select("doc_id", F.md5("text").alias("key"), "text", base_spans(F.col("text")).alias("base"))
    rows = rows.withColumn("all", spans_if(F.size("base") > 0, matches(F.col("text"), "term", _WORD))).withColumn("free", clear_of("all", "base"))
    words = F.transform("free", lambda w: F.struct(F.lower(w["value"]).alias("term"), w["start"].alias("start"), w["end"].alias("end")))
    return rows.select("doc_id", "key", "base", words.alias("words"))


def _by_text(holders: DataFrame) -> DataFrame:
    """(key, n, entities, words) of each different text among (key, entities, words), n being its number of rows."""
    return holders.groupBy("key").agg(F.count("*").alias("n"), F.any_value("entities").alias("entities"), F.any_value("words").alias("words"))


def disclosing_terms(docs: DataFrame, texts: DataFrame, disclosure: float = DISCLOSURE, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """(entity, term) pairs above the threshold; ``texts`` has (key, n, entities, words) of each text of ``docs`` with entities.

    n(c), n(t) and n(c,t) all count rows of ``docs``. Entities in fewer
    different texts than needed can have no such pair and are left out before
    the words are looked at.
    """
    total = F.lit(float(docs.count()))
    held = texts.select("key", "n", F.explode("entities").alias("entity"))
    entities = materialize(held.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts")).filter((F.col("texts") >= least_texts) & (F.col("n_entity") < total)).select("entity", "n_entity"), "entities")
    kept = held.join(entities.select("entity"), "entity", "left_semi").join(texts.select("key", "words"), "key")
    both = kept.select("entity", "n", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("texts"))
    pairs = materialize(both.filter(F.col("texts") >= least_texts).select("entity", "term", "n_both"), "pairs")
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(_text()), r"\P{L}++"))).alias("term"))
    terms = words.groupBy("term").agg(F.count("*").alias("n_term"))
    content = F.log2(total / F.col("n_entity"))
    pmi = F.log2(F.col("n_both") * total / (F.col("n_entity") * F.col("n_term")))
    return pairs.join(entities, "entity").join(terms, "term").filter(pmi >= disclosure * content).select("entity", "term")


def _told(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, told): the disclosing terms of the entities that a text holds, where there are any."""
    held = texts.select("key", F.explode("entities").alias("entity"))
    return held.join(pairs, "entity").groupBy("key").agg(F.collect_set("term").alias("told"))


def find_personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """(doc_id, base, terms) per row of ``docs`` (doc_id, text): arrays of spans.

    A null text counts as empty and has no spans. Repeated rows stay repeated;
    empty tables give empty results. Other columns are ignored. Very long texts
    are read whole, in time proportional to their length.
    """
    marked = materialize(_marked(docs), "marked")
    holders = marked.filter(F.size("base") > 0)
    texts = materialize(_by_text(holders.select("key", _entities(F.col("base")).alias("entities"), F.array_distinct(F.transform("words", lambda w: w["term"])).alias("words"))), "texts")
    told = _told(texts, disclosing_terms(docs, texts, disclosure, least_texts))
    terms = F.transform(F.filter("words", lambda w: F.array_contains("told", w["term"])), lambda w: span(F.lit("term"), w["start"], w["end"], w["term"]))
    none = F.expr(NO_SPANS).alias("terms")
    found = holders.join(told, "key", "left").select("doc_id", "base", F.when(F.col("told").isNotNull(), terms).otherwise(F.expr(NO_SPANS)).alias("terms"))
    return marked.filter(F.size("base") == 0).select("doc_id", "base", none).unionByName(found)


def _holders(docs: DataFrame) -> DataFrame:
    """(key, entities, words) of each row that holds an entity, with the words of three letters or more outside its base spans."""
    rows = docs.select(F.md5(_text()).alias("key"), _text().alias("text")).withColumn("base", base_spans(F.col("text"), F.octet_length)).filter(F.size("base") > 0)
    found = F.regexp_extract_all(replaced(F.col("text"), F.col("base")), F.lit(_MARK_OR_WORD), F.lit(0))
    words = F.array_distinct(F.transform(F.filter(found, lambda w: ~w.startswith("<")), F.lower))
    return rows.select("key", _entities(F.col("base")).alias("entities"), words.alias("words"))


def _without(text: Column, terms: Column) -> Column:
    """``text``, whose base spans are replaced already, with every word among ``terms`` as <TERM>."""
    found = F.regexp_extract_all(text, F.lit(_MARK_OR_WORD), F.lit(0))
    between = F.split(text, _MARK_OR_WORD, -1)
    hidden = F.zip_with(between, found, lambda b, w: F.concat(b, F.when(F.array_contains(terms, F.lower(w)), F.lit("<TERM>")).otherwise(F.coalesce(w, F.lit("")))))
    return F.array_join(hidden, "")


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind, as <EMAIL> or <TERM>.

    A term that discloses an entity is replaced throughout the texts that hold
    the entity, however far apart they stand. Rows without personal data come
    through unchanged and unshuffled. All columns stay; ``n_chars``, where there
    is such a column, follows the new text.
    """
    texts = materialize(_by_text(_holders(docs)), "texts")
    told = _told(texts, disclosing_terms(docs, texts, disclosure, least_texts)).select(F.col("key").alias("__symloom_key"), F.col("told").alias("__symloom_told"))
    rows = docs.withColumn("__symloom_base", base_spans(_text(), F.octet_length))
    clean = rows.filter(F.size("__symloom_base") == 0).select(docs.columns)
    found = rows.filter(F.size("__symloom_base") > 0).withColumn("__symloom_key", F.md5(_text())).join(told, "__symloom_key", "left")
    plain = replaced(F.col("text"), F.col("__symloom_base"))
    found = found.withColumn("text", F.when(F.col("__symloom_told").isNull(), plain).otherwise(_without(plain, F.col("__symloom_told"))))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.unionByName(found.select(docs.columns))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.col("base")
    counts = [count_of(base, k).alias(f"n_{k}") for k in BASE_KINDS]
    every = in_order(F.concat("base", "terms"), KINDS, start_first=False)
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"))
