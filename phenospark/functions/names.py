"""Names of genes, mutations, drugs and sequence types, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import INTRINSIC

MUTATION = r"^(.+?)_([A-Z]-?\d+[A-Za-z0-9]*)$"


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def canonical_drug(name: Column) -> Column:
    """Trimmed, a capital after every character without capitals of its own; letters of any script count."""
    parts = F.regexp_extract_all(F.lower(F.trim(name)), F.lit(r"([\p{Ll}\p{Lu}\p{Lt}]+|[^\p{Ll}\p{Lu}\p{Lt}]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def phenotype_code(p: Column) -> Column:
    return F.when(p == "R", 1).when(p == "S", 0)


def phenotype_of(text: Column) -> Column:
    """R or S from resistant / susceptible in any case; others are null."""
    t = F.lower(F.trim(text))
    return F.when(t == "resistant", "R").when(t == "susceptible", "S")


def evidence_class(subtype: Column) -> Column:
    s = F.upper(F.coalesce(subtype, F.lit("")))
    return F.when(s == "POINT_DISRUPT", "disrupted_gene").when(s == "POINT", "point_mutation").otherwise("acquired_gene")


def gene_symbol(name: Column, evidence: Column) -> Column:
    return F.when(evidence == "acquired_gene", name).otherwise(F.substring_index(name, "_", 1))


def parse_gene(name: Column) -> Column:
    return F.coalesce(blank_to_null(F.regexp_extract(name, MUTATION, 1)), name)


def parse_mutation(name: Column) -> Column:
    return blank_to_null(F.regexp_extract(name, MUTATION, 2))


def gene_family(name: Column) -> Column:
    stem = F.regexp_replace(name, r"-?\d+$", "")
    return F.when(parse_mutation(name).isNotNull(), parse_gene(name)).when(stem == "", name).otherwise(stem)


def match_key(name: Column) -> Column:
    head = F.substring_index(F.lower(gene_family(name)), "/", 1)
    return F.regexp_replace(F.regexp_replace(head, r"^bla(.+)$", "$1"), r"[^a-z0-9]", "")


def match_keys(name: Column) -> Column:
    """Keys of the whole name and, of names of several words, of the words that look like symbols."""
    words = F.split(F.trim(name), r"\s+")
    symbols = F.when(F.size(words) > 1, F.transform(F.filter(words, lambda w: w.rlike(r"[0-9()']")), match_key)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(match_key(name)), symbols), lambda k: k != "")))


def feature_token(gene: Column, product: Column) -> Column:
    """The gene, or the family that a product text names after ``=>`` or ``@``; null for intrinsic ones and none."""
    text = F.regexp_extract(F.coalesce(product, F.lit("")), r"(?:=>|@)\s*(.+)$", 1)
    text = F.regexp_replace(F.regexp_replace(text, r"\bfamily\b", ""), r"\([^)]*\)", "")
    text = F.btrim(F.regexp_extract(text, r"^(.*?)(?:  |=>|@|$)", 1), F.lit(" .,;/"))
    token = F.coalesce(blank_to_null(F.trim(gene)), blank_to_null(F.regexp_extract(text, r"^(\S+)", 1)))
    return F.when(~F.lower(token).isin(INTRINSIC), token)


def parse_mlst(mlst: Column) -> Column:
    last = F.substring_index(mlst, ".", -1)
    return F.when(last.rlike("^[0-9]+$"), F.concat(F.lit("ST-"), last))


def split_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != "")
