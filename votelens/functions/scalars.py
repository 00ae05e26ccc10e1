"""Small column expressions shared by the operators."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Upper bin edges of magnitude and seeing.
MAG_EDGES = (18.0, 19.0, 20.0, 23.0)
SEEING_EDGES = (3.0, 3.5, 3.9, 4.5, 14.0)


def hash_order(id_: Column, seed) -> Column:
    """A repeatable random order: 16 hex digits of md5(seed:id). The same in any SQL engine."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:") if not isinstance(seed, Column) else
                                      F.concat(seed.cast("string"), F.lit(":")), id_.cast("string"))), 1, 16)


def hash_unit(id_: Column, seed) -> Column:
    """A repeatable random number in [0, 1) per id (52 bits of md5)."""
    return F.conv(F.substring(hash_order(id_, seed), 1, 13), 16, 10).cast("double") / float(2 ** 52)


def upper_edge_bin(x: Column, edges) -> Column:
    """Upper edge of the first bin with x <= edge. NaN stays; a value above the last edge is an error."""
    out = F.when(F.isnan(x), x)
    for e in edges:
        out = out.when(x <= e, F.lit(e))
    return out.when(x.isNotNull(), F.raise_error(F.concat(F.lit("value above the last bin edge: "), x.cast("string"))).cast("double"))


def mag_bin(x: Column) -> Column:
    return upper_edge_bin(x, MAG_EDGES)


def seeing_bin(x: Column) -> Column:
    return upper_edge_bin(x, SEEING_EDGES)


def int_bin(x: Column) -> Column:
    return F.floor(x).cast("int")


def cut_breaks(x: Column, breaks, labels=None) -> Column:
    """Right-closed interval label; null outside. The lowest break itself is outside."""
    out = None
    for i, (lo, hi) in enumerate(zip(breaks[:-1], breaks[1:])):
        inside = (x > lo) if math.isinf(hi) else (x > lo) & (x <= hi)
        name = labels[i] if labels else f"({_num(lo)},{_num(hi)}]"
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def _num(v) -> str:
    return "Inf" if math.isinf(v) else f"{v:g}"


def file_key(name: Column) -> Column:
    """Object id and date out of ``id_date...`` names."""
    return F.concat(F.split_part(name, F.lit("_"), F.lit(1)),
                    F.split_part(F.split_part(name, F.lit("_"), F.lit(2)), F.lit("."), F.lit(1)))


def season_of(url: Column) -> Column:
    return F.split_part(url, F.lit("/"), F.lit(1))


def image_name(url: Column) -> Column:
    return F.split_part(url, F.lit("/"), F.lit(4))


def _minority(real: Column, bogus: Column) -> Column:
    return F.try_divide(F.least(real, bogus), F.greatest(real, bogus))


def controversy(real: Column, bogus: Column, version: str = "pow") -> Column:
    """High where many votes are evenly split."""
    f = F.pow if version == "pow" else (lambda a, b: a * b)
    return f((real + bogus).cast("double"), _minority(real, bogus))


def consensus_score(real: Column, bogus: Column, version: str = "pow") -> Column:
    """High where many votes agree. An even split under ``pow`` is 0^0 = 1."""
    f = F.pow if version == "pow" else (lambda a, b: a * b)
    return f(F.abs(real - bogus).cast("double"), 1 - _minority(real, bogus))


def score_label(p: Column, cut=.5) -> Column:
    return F.when(p > cut, 1).otherwise(0)


def fold_soft_pred(probability: Column) -> Column:
    """P(class 1) out of a two-class probability vector."""
    from pyspark.ml.functions import vector_to_array
    return F.get(vector_to_array(probability), F.lit(1))
