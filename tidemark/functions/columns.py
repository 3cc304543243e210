"""Column functions over text: native ones, and Arrow-batched ones where SQL has none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text


#: Query keys that only track visitors, beside those that begin with utm_ (fixed values).
TRACKING = ("fbclid", "gclid")


def folded(column: Column) -> Column:
    """NFKC and case folding; plain ASCII stays in the JVM."""
    plain = column.rlike(r"^\p{ASCII}*$")
    return F.when(plain, F.lower(column)).otherwise(F.pandas_udf(text.folded, "string")(F.when(~plain, column)))


def split_words(column: Column) -> Column:
    """Whole Unicode words of a folded text."""
    return F.regexp_extract_all(column, F.lit(r"([\p{L}\p{N}_]+)"))


def words(column: Column) -> Column:
    """Whole Unicode words after folding; none for null."""
    return split_words(folded(F.coalesce(column, F.lit(""))))


def link(column: Column) -> Column:
    """An http link without fragment and tracking keys, scheme and host lowered, its query sorted; null for others.

    Query items without a value are dropped and the others encoded anew.
    """
    part = lambda k: F.regexp_extract(column, r"^\s*([A-Za-z]+)://([^/?#]+)([^?#]*)(?:\?([^#]*))?", k)
    items = F.filter(F.split(part(4), "&"), lambda x: x.rlike("^[^=]*=."))
    plain = F.transform(items, lambda x: F.struct(_decoded(F.substring_index(x, "=", 1)).alias("key"), _decoded(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("value")))
    kept = F.filter(plain, lambda x: ~F.lower(x["key"]).startswith("utm_") & ~F.lower(x["key"]).isin(*TRACKING))
    query = F.array_join(F.transform(F.array_sort(kept), lambda x: F.concat(F.url_encode(x["key"]), F.lit("="), F.url_encode(x["value"]))), "&")
    whole = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), part(3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.lower(part(1)).isin("http", "https"), whole)


def _decoded(column: Column) -> Column:
    """Percent-decoded text, or the text itself where its escapes are broken."""
    return F.coalesce(F.try_url_decode(column), column)


def cosine(a: Column, b: Column) -> Column:
    return F.pandas_udf(text.cosine, "double")(a, b)


def longest_run(a: Column, b: Column) -> Column:
    return F.pandas_udf(text.longest_run, "int")(a, b)


def canonical_hash(as_json: Column) -> Column:
    return F.pandas_udf(text.fingerprints, "string")(as_json)


def repeats_a_key(as_json: Column) -> Column:
    return F.pandas_udf(text.repeats_a_key, "boolean")(as_json)


def word_pairs(words: Column) -> Column:
    """Distinct neighbouring word pairs with numbers replaced, so that texts that differ in figures compare as alike."""
    plain = F.transform(words, lambda w: F.regexp_replace(w, r"\p{N}+", "0"))
    pairs = F.zip_with(F.slice(plain, 1, F.greatest(F.size(plain) - 1, F.lit(0))), F.slice(plain, 2, F.greatest(F.size(plain) - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.array_distinct(pairs)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and the first 20 hex digits of the parts' sha256."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 20))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def redacted(column: Column) -> Column:
    """Masks credentials in messages."""
    out = F.regexp_replace(column, r"(?i)(token|api[_-]?key|secret|password)(\s*[=:]\s*)\S+", "$1$2***")
    return F.regexp_replace(out, r"(?i)(bearer|token)\s+[A-Za-z0-9._-]{8,}", "$1 ***")


def period_key(day: Column, frequency: str) -> Column:
    year = F.year(day) * 100
    return {"monthly": year + F.month(day), "quarterly": year + F.quarter(day), "semiannual": year + F.ceil(F.month(day) / 6).cast("int"), "annual": year}[frequency]
