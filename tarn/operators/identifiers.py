"""Identifier tokens: a text's words as a graph, in which an identifier is one token and its parts are others.

``refresh_token``, ``CVE-2026-0001``, ``v0.19.0`` and ``ITストラテジスト`` are identifiers: parts joined by a hyphen, an underscore or a dot, or
by a change between CJK and other letters. Every part takes a place; the whole stands at its first part's place and is as long as its parts
are many. A phrase is a path: the next token's place is the last one's plus its length, so a phrase may name wholes, parts, or the
end of one identifier and what follows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.nfkc import nfkc
from tarn.functions.text import CJK, fold
from tarn.operators.keyword import frequencies, literals

LETTER = r"\p{L}\p{N}\p{Co}"
#: What is between white space and punctuation, with single connectors inside.
IDENTIFIER = rf"[{LETTER}]+(?:[-_.][{LETTER}]+)*"
PART = rf"[{LETTER}&&{CJK}]+|[{LETTER}&&[^{CJK[1:-1]}]]+"


def graph(text: Column) -> Column:
    """An array of (token, whole, length), one for each place: the part, and at an identifier's first part the identifier and its number of parts.

    The text is NFKC, in lower case, without Latin diacritics. Words of one part have no whole. Empty for null and for texts without a letter.
    """
    names = F.regexp_extract_all(fold(nfkc(F.coalesce(text, F.lit("")))), F.lit(IDENTIFIER), 0)

    def places(name: Column) -> Column:
        parts = F.regexp_extract_all(name, F.lit(PART), 0)
        alone = F.array(F.struct(name.alias("token"), F.lit(None).cast("string").alias("whole"), F.lit(None).cast("int").alias("length")))

        def place(part: Column, i: Column) -> Column:
            many = F.when(i == 0, F.when(F.size(parts) > 1, F.size(parts)))
            return F.struct(part.alias("token"), F.when(many.isNotNull(), name).alias("whole"), many.alias("length"))

        # most words are ASCII without a connector: one part, which no pattern has to look for
        plain = (F.octet_length(name) == F.length(name)) & ~F.contains(name, F.lit("-")) & ~F.contains(name, F.lit("_")) & ~F.contains(name, F.lit("."))
        return F.when(plain, alone).otherwise(F.transform(parts, place))

    return F.flatten(F.transform(names, places))


def graph_postings(docs: DataFrame, key: str, text: Column, among: list[str] | None = None) -> DataFrame:
    """(key, dl, field, pos, length, token): every part, and every whole of several parts. dl counts places. With ``among`` only places where one of these tokens stands."""
    # counted before the places are dealt out, so that no row carries all of them
    lists = docs.select(F.col(key), graph(text).alias("_places")).select(key, "_places", F.size("_places").cast("bigint").alias("dl"))
    if among is None:
        rows = lists.select(key, "dl", F.posexplode("_places").alias("pos", "_place"))
    else:
        there = F.filter(F.transform("_places", lambda p, i: F.struct(i.alias("pos"), p.alias("_place"))), lambda r: r["_place"]["token"].isin(among) | F.coalesce(r["_place"]["whole"].isin(among), F.lit(False)))
        rows = lists.select(key, "dl", F.inline(there))
    part = F.struct(F.lit(1).alias("length"), F.col("_place.token").alias("token"))
    whole = F.struct(F.col("_place.length").alias("length"), F.col("_place.whole").alias("token"))
    both = F.when(F.col("_place.whole").isNull(), F.array(part)).otherwise(F.array(part, whole))
    return rows.select(key, "dl", F.lit("text").alias("field"), "pos", F.inline(both))


def wholes(docs: DataFrame, text: Column) -> DataFrame:
    """(token): the different identifiers of several parts."""
    named = F.filter(graph(text), lambda p: p["whole"].isNotNull())
    return docs.select(F.explode(F.array_distinct(F.transform(named, lambda p: p["whole"]))).alias("token")).distinct()


def graph_phrases(queries: DataFrame, query_id: str, query: str, exact: bool) -> DataFrame:
    """(query_id, n_phrases, phrase, n_tokens, offset, token): every query is one phrase; ``exact`` asks for its identifiers as wholes, else for all parts.

    Queries without a token have no row.
    """
    rows = graph_postings(queries, query_id, F.col(query)).select(F.col(query_id).alias("query_id"), "dl", F.col("pos").alias("offset"), "length", "token")
    if exact:
        # at a place of several tokens the longest is the whole; the parts it covers go
        covered = F.aggregate("_all", F.struct(F.lit(0).alias("to"), F.array().cast("array<struct<offset:int,token:string>>").alias("kept")), _longest, lambda s: s["kept"])
        rows = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("offset", (-F.col("length")).alias("less"), "token"))).alias("_all"))
        rows = rows.select("query_id", covered.alias("kept")).select("query_id", F.size("kept").alias("n_tokens"), F.inline("kept"))
    else:
        rows = rows.where("length = 1").select("query_id", F.col("dl").cast("int").alias("n_tokens"), "offset", "token")
    return rows.select("query_id", F.lit(1).alias("n_phrases"), F.lit(0).alias("phrase"), "n_tokens", "offset", "token")


def _longest(state: Column, row: Column) -> Column:
    """The next token is taken if it begins at or behind the end of the last one; rows are sorted by place, the longest first."""
    free = row["offset"] >= state["to"]
    kept = F.concat(state["kept"], F.array(F.struct(row["offset"].alias("offset"), row["token"].alias("token"))))
    return F.struct(F.when(free, row["offset"] - row["less"]).otherwise(state["to"]).alias("to"), F.when(free, kept).otherwise(state["kept"]).alias("kept"))


def phrase_hits(docs: DataFrame, queries: DataFrame, key: str, text: Column, query_id: str = "query_id", query: str = "query", exact: bool = True) -> DataFrame:
    """(query_id, key, hits): how often a document has a query as a phrase, word for word (``exact``) or in parts."""
    terms = graph_phrases(queries, query_id, query, exact)
    posts = graph_postings(docs, key, text, literals(terms))
    posts = posts if exact else posts.where("length = 1")
    found = frequencies(posts.drop("length"), terms, key)
    return found.select("query_id", key, F.col("f").alias("hits"))
