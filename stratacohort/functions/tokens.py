"""Columns over tokens: classes, numbers and prefixes."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YEAR, GAP, AGE, DISEASE = "<NY", "<ATT-", "<AGE", "<DX-MAJOR"
MALE = "<SEX-1>"


def split_tokens(seq: Column) -> Column:
    """Tokens are parted by exactly one space; an empty token keeps its place."""
    return F.split(seq, " ", -1)


def number(token: Column) -> Column:
    """The k of <AGE_k> or <ATT-k>; fails on anything else, so use it inside when()."""
    return F.substring(token, F.lit(6), F.length(token) - 6).cast("int")


def token_class(token: Column) -> Column:
    found = F.when(token.startswith(NEW_YEAR), "new_year").when(token.startswith(GAP), "gap")
    return found.when(token.startswith(AGE), "age").when(token.startswith(DISEASE), "disease").otherwise("other")


def disease_token(code: Column) -> Column:
    return F.concat(F.lit("<DX-MAJOR_"), code, F.lit(">"))


def sex(tokens: Column, sex_index: int) -> Column:
    """Everything but the male token is female."""
    return F.when(F.coalesce(F.get(tokens, sex_index) == MALE, F.lit(False)), "male").otherwise("female")
