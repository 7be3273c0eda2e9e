"""Text analysis: tokens, folding, synonyms, edge n-grams, and the analyzers made of them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Equal street words, the first of each being the usual one.
SYNONYMS = (
    ("street", "st", "str"), ("avenue", "ave", "av"), ("road", "rd"), ("boulevard", "blvd", "bd"), ("place", "pl"),
    ("square", "sq"), ("drive", "dr"), ("lane", "ln"), ("court", "ct"),
)
# The pattern of ordinals and what is kept of them.
ORDINALS = "(?i)((^| )((1)st?|(2)nd?|(3)rd?|([4-9])th?)|(([0-9]*)(1[0-9])th?)|(([0-9]*[02-9])((1)st?|(2)nd?|(3)rd?|([04-9])th?))($| ))"
ORDINALS_KEPT = "$2$4$5$6$7$9$10$12$14$15$16$17$18"
SEPARATORS = r"[\s,/\\-]+"
MAX_GRAM = 24
#: Up to this many synonyms are one map in the plan.
MAX_SYNONYMS = 5000
_MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿăąćčďđęěğłńňőřśşšťůűźżž"
_PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyaaccddeeglnnorssstuuzzz"
_LONGER = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda t: t != "")


def folded(text: Column) -> Column:
    """Lower-case Latin letters without their marks."""
    out = F.translate(text, _MARKED, _PLAIN)
    for a, b in _LONGER.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def alternatives(token: Column) -> Column:
    """All words that are equal to a token; itself if there are none."""
    pairs = [x for group in SYNONYMS for w in group for x in (F.lit(w), F.array(*[F.lit(v) for v in group]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), token), F.array(token))


def indexed(text: Column) -> Column:
    """For each position, a token and its folded form."""
    low = F.lower(text)  # folding neither adds nor takes separators, so the whole text can be folded at once
    return F.zip_with(tokens(low), tokens(folded(low)), lambda t, f: F.array_distinct(F.array(t, f)))


def queried(text: Column) -> Column:
    """As indexed, with synonyms."""
    return F.transform(tokens(F.lower(text)), lambda t: F.array_distinct(F.concat(F.array(t), alternatives(folded(t)))))


def edge_ngrams(token: Column, longest: int = MAX_GRAM) -> Column:
    size = F.least(F.length(token), F.lit(longest))
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substr(token, F.lit(1), i)))


def street(text: Column) -> Column:
    """Lower-case, single spaces, ordinals as numbers."""
    plain = F.regexp_replace(F.trim(F.lower(text)), " +", " ")
    return F.regexp_replace(folded(plain), r"([0-9]+)(st|nd|rd|th)\b", "$1")


def postcode(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9]", "")


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode's NFKC form.  The one function here that Spark lacks; ASCII texts, which are their own form, go past it."""
    ascii_only = text.rlike(r"\A\p{ASCII}*\z")
    return F.when(ascii_only, text).otherwise(_composed(F.when(~ascii_only, text)))


def without_ordinal(token: Column) -> Column:
    """``1st`` -> 1, ``22nd`` -> 22, ``113th`` -> 113."""
    return F.regexp_replace(token, ORDINALS, ORDINALS_KEPT)


def _kept(forms: Column) -> Column:
    return F.filter(F.array_distinct(forms), lambda t: t != "")


def _street_forms(token: Column) -> Column:
    both = F.flatten(F.transform(alternatives(token), lambda t: F.array(t, folded(t))))
    return _kept(F.transform(both, without_ordinal))


def _gram_forms(token: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.array(token, folded(token)), lambda t: edge_ngrams(t))))


#: The analyzers by name: each makes an array of forms for each position.  Texts are in NFKC form already.
ANALYZERS: dict[str, Callable[[Column], Column]] = {
    "index": indexed,
    "admin": indexed,
    "grams": lambda text: F.transform(tokens(F.lower(text)), _gram_forms),
    "query": queried,
    "street": lambda text: F.transform(tokens(F.lower(text)), _street_forms),
    "zip": lambda text: F.filter(F.array(F.array(F.lower(postcode(text)))), lambda forms: forms[0] != ""),
}
# The analyzer of each field, of the table and of a query; fields that aren't named here are names of areas.
AREA_ANALYZERS = ("admin", "query")
FIELD_ANALYZERS = {
    "name_all": ("index", "query"), "phrase": ("index", "query"), "street": ("street", "query"), "postcode": ("zip", "zip"), "city": ("admin", "query"),
}


def analyzed(text: Column, analyzer: str) -> Column:
    """positions -> forms of a text by one of ANALYZERS, in NFKC form first; of a postcode only ASCII letters and digits are left, so it needs none."""
    return ANALYZERS[analyzer](text if analyzer == "zip" else nfkc(text))


def with_canonical(texts: DataFrame, column: str, synonyms: DataFrame, into: str = "normalized") -> DataFrame:
    """``texts`` with each word of a column replaced by its canonical word.

    ``synonyms``: token, canonical (a token once).  Words are cut at white space and looked up in lower case, without
    what isn't a letter or digit at their ends; a word that is found is replaced as a whole.  Entries of several words never match.
    The lookup is one small map if the table is, as synonym files are, under MAX_SYNONYMS entries; else a join.
    """
    if "_row" in texts.columns:
        raise ValueError("_row is a name this needs")
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", "")
    words = F.filter(F.split(column, r"\s+"), lambda w: w != "")
    some = synonyms.select("token", "canonical").where("token IS NOT NULL").limit(MAX_SYNONYMS + 1).collect()
    if len(some) <= MAX_SYNONYMS:
        table = F.create_map(*[F.lit(x) for r in some for x in r]) if some else F.create_map().cast("map<string,string>")
        return texts.withColumn(into, F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, bare(w)), w)), " "))
    numbered = texts.withColumn("_row", F.struct(F.xxhash64(column).alias("h"), F.col(column).alias("t")))
    each = numbered.select("_row").distinct().select("_row", F.posexplode(F.split(F.col("_row.t"), r"\s+")).alias("at", "word")).where("word <> ''")
    found = each.withColumn("token", bare(F.col("word"))).join(synonyms.select("token", "canonical"), "token", "left")
    whole = found.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("canonical", "word").alias("w")))).alias("ws"))
    joined = numbered.join(whole, "_row", "left")
    text = F.when(F.col(column).isNotNull(), F.coalesce(F.array_join(F.transform("ws", lambda x: x["w"]), " "), F.lit("")))
    return joined.withColumn(into, text).drop("_row", "ws")


def without_keywords(text: Column, keywords: tuple[str, ...] = ("City", "Village", "ville")) -> Column:
    """The text without general words; null if that changes nothing or leaves nothing."""
    rest = F.trim(F.regexp_replace(F.regexp_replace(text, rf"(?i)\b({'|'.join(keywords)})\b", ""), r"\s+", " "))
    return F.when((rest != "") & (rest != text), rest)
