"""Names, addresses, headlines and small parsers, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms that owner names may end in.
LEGAL_FORMS = ("LLC", "INC", "INCORPORATED", "CORP", "CORPORATION", "LTD", "LIMITED", "LP", "LLP", "PSC", "SRL")
# Accented capitals and small letters, and the letters they fold to.
ACCENTED = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇáàâäãåéèêëíìîïóòôöõúùûüñç"
FOLDED = "AAAAAAEEEEIIIIOOOOOUUUUNCaaaaaaeeeeiiiiooooouuuunc"


def fold_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, FOLDED)


def collapse(text: Column) -> Column:
    """Single spaces, none around."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def owner_key(name: Column) -> Column:
    """A spelling-independent key of an owner: folded, upper, letters and digits, without trailing legal forms.

    A name that is a legal form alone stays.
    """
    upper = F.upper(fold_accents(name))
    bare = collapse(F.regexp_replace(F.replace(upper, F.lit("."), F.lit("")), "[^0-9A-Z ]", " "))
    return F.regexp_replace(bare, rf"(?<=\S)(\s+({'|'.join(LEGAL_FORMS)}))+$", "")


def address(physical: Column, town: Column) -> Column:
    """Upper-case address with its town once; the town alone where there is no street; NULL where there is neither."""
    street, place = F.nullif(F.upper(collapse(physical)), F.lit("")), F.nullif(F.upper(collapse(town)), F.lit(""))
    named = F.contains(fold_accents(street), fold_accents(place))
    return F.when(street.isNull(), place).when(place.isNull() | named, street).otherwise(F.concat(street, F.lit(", "), place))


def counted(n: Column, one: str, many: str) -> Column:
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many)))


def joined(parts: list[Column]) -> Column:
    """'a', 'a and b' or 'a, b and c' of the parts that are not NULL; NULL where all are."""
    some = F.array_compact(F.array(*parts))
    n = F.size(some)
    head = F.array_join(F.slice(some, F.lit(1), F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, F.lit(None)).when(n == 1, F.element_at(some, 1)).otherwise(F.concat(head, F.lit(" and "), F.element_at(some, -1)))


def outage_headline(population: Column, hospitals: Column, plants: Column, centers: Column) -> Column:
    people = F.when(population > 0, F.concat(F.format_number(population, 0), F.lit(" people")))
    said = joined([people, counted(hospitals, "hospital", "hospitals"), counted(plants, "water plant", "water plants"), counted(centers, "health center", "health centers")])
    return F.coalesce(F.concat(F.lit("Failure affects "), said), F.lit("No downstream impact"))


def short_count(n: Column) -> Column:
    """1.2M, 88K or the number itself."""
    return F.when(n >= 1_000_000, F.concat(F.round(n / 1e6, 1).cast("string"), F.lit("M"))).when(n >= 1000, F.concat(F.round(n / 1e3, 0).cast("long").cast("string"), F.lit("K"))).otherwise(n.cast("string"))


def degrees(dms: Column, degree_digits: int) -> Column:
    """Decimal degrees of DDMMSSss or DDDMMSSss digits; NULL where they do not parse or are zero."""
    part = lambda start, n: F.substring(dms, start, n).try_cast("double")
    value = part(1, degree_digits) + part(degree_digits + 1, 2) / 60 + part(degree_digits + 3, 4) / 360000
    return F.nullif(value, F.lit(0.0))


def advisory_numbers(text: Column) -> Column:
    """'14-16,30' -> ['014', '015', '016', '030']."""
    spans = F.split(F.regexp_replace(text, r"\s", ""), ",")
    ends = F.transform(spans, lambda s: F.split(s, "-"))
    wide = F.transform(ends, lambda e: F.sequence(e[0].cast("int"), F.element_at(e, -1).cast("int")))
    return F.transform(F.flatten(wide), lambda n: F.lpad(n.cast("string"), 3, "0"))


def routed_search(query: str, id_column: str, *text_columns: str) -> Column:
    """Digits and dashes search an id by prefix, anything else the texts by substring."""
    import re

    if re.fullmatch(r"[0-9][0-9\-\s]*", query):
        return F.startswith(F.col(id_column), F.lit(query.strip()))
    found = F.lit(False)
    for c in text_columns:
        found = found | F.contains(F.lower(F.col(c)), F.lit(query.lower()))
    return found
